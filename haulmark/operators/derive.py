"""Derived columns: origin, destination, distance, transit proxy, ranks, repaired lead time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulmark.functions.geo import haversine_km
from haulmark.functions.portable import uniform
from haulmark.params import Network
from haulmark.session import staged, staged_path
from haulmark.sources.dims import factories

KM_PER_DAY = 800.0  # fixed value: distance covered in one proxy transit day


def modal_factory(product_factory: DataFrame, product_division: DataFrame) -> DataFrame:
    """The factory most products of a division are mapped to; ties go to the first name."""
    votes = (product_factory.join(product_division, "product_name")
             .groupBy("division", "factory").agg(F.count(F.lit(1)).alias("products")))
    first = F.min(F.struct((-F.col("products")).alias("n"), "factory"))
    return (votes.groupBy("division").agg(first.alias("m"))
            .select("division", F.col("m.factory").alias("factory"),
                    (-F.col("m.n")).alias("products")))


def resolve_factory(df: DataFrame, product_factory: DataFrame, division_factory: DataFrame
                    ) -> DataFrame:
    """Add ``current_factory`` and ``factory_provenance`` (explicit, division-fallback, unmapped)."""
    explicit = product_factory.select("product_name", F.col("factory").alias("_explicit"))
    fallback = division_factory.select("division", F.col("factory").alias("_fallback"))
    return (df.join(explicit, "product_name", "left").join(fallback, "division", "left")
            .withColumns({
                "current_factory": F.coalesce("_explicit", "_fallback"),
                "factory_provenance": F.when(F.col("_explicit").isNotNull(), "explicit")
                .when(F.col("_fallback").isNotNull(), "division-fallback").otherwise("unmapped")})
            .drop("_explicit", "_fallback"))


def geocode(df: DataFrame, centroids: DataFrame, key: str = "state") -> DataFrame:
    """Add destination ``lat`` and ``lon`` by centroid; unresolved places stay null."""
    return df.join(centroids.select(key, "lat", "lon"), key, "left")


def unresolved_places(df: DataFrame, centroids: DataFrame, key: str = "state") -> DataFrame:
    """Distinct places without a centroid."""
    return df.select(key).distinct().join(centroids.select(key), key, "left_anti")


def require_resolved(df: DataFrame, centroids: DataFrame, key: str = "state") -> DataFrame:
    """The geocoded frame, or a ``ValueError`` with the number of places without a centroid and the
    table that lists them all."""
    path = staged_path(unresolved_places(df, centroids, key), "unresolved")
    count = df.sparkSession.read.parquet(path).count()
    if count:
        raise ValueError(f"no centroid for {count} values of {key}, listed in {path}")
    return geocode(df, centroids, key)


def unmapped_products(df: DataFrame) -> DataFrame:
    """Products that neither the explicit map nor their division's factory resolves, with their rows."""
    return (df.where(F.col("current_factory").isNull()).groupBy("product_name", "division")
            .agg(F.count(F.lit(1)).alias("rows")))


def require_mapped(df: DataFrame) -> DataFrame:
    """The resolved frame, or a ``ValueError`` with the number of products without a factory and the
    table that lists them all."""
    path = staged_path(unmapped_products(df), "unmapped")
    count = df.sparkSession.read.parquet(path).count()
    if count:
        raise ValueError(f"no factory mapping for {count} products, listed in {path}")
    return df


def geocode_chain(df: DataFrame, postal: DataFrame, state: DataFrame) -> DataFrame:
    """Add ``lat``, ``lon`` and ``geo_source``: postal-code centroid first, then state centroid.

    Places are many times fewer than rows: the distinct (postal code, state) pairs are resolved
    first and stored, so that Spark knows their size when the rows meet them, in one join on the
    pair rather than one on each of its hot halves.
    """
    p = postal.select("postal_code", F.col("lat").alias("_plat"), F.col("lon").alias("_plon"))
    s = state.select("state", F.col("lat").alias("_slat"), F.col("lon").alias("_slon"))
    places = (df.select("postal_code", "state").distinct()
              .join(p, "postal_code", "left").join(s, "state", "left")
              .select(F.col("postal_code").alias("_code"), F.col("state").alias("_state"),
                      F.coalesce("_plat", "_slat").alias("lat"),
                      F.coalesce("_plon", "_slon").alias("lon"),
                      F.when(F.col("_plat").isNotNull(), "postal")
                      .when(F.col("_slat").isNotNull(), "state").otherwise("unresolved")
                      .alias("geo_source")))
    found = staged(places, "places")
    return df.join(found, F.col("postal_code").eqNullSafe(F.col("_code"))
                   & F.col("state").eqNullSafe(F.col("_state")), "left").drop("_code", "_state")


def share_by(df: DataFrame, key: str) -> DataFrame:
    """Rows and percentage share per value of ``key``; the total is taken over the few counts."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    total = F.sum("rows").over(Window.partitionBy())
    return counts.select(key, "rows", (F.col("rows") * 100.0 / total).alias("share_pct"))


def with_distance(df: DataFrame, network: Network, factory: str = "current_factory",
                  name: str = "distance_km") -> DataFrame:
    """Add the great-circle distance from a factory column to the destination."""
    sites = factories(df.sparkSession, network).select(
        F.col("factory").alias("_site"), F.col("lat").alias("_flat"), F.col("lon").alias("_flon"))
    km = haversine_km(F.col("_flat"), F.col("_flon"), F.col("lat"), F.col("lon"))
    return (df.join(sites, F.col(factory) == F.col("_site"), "left").withColumn(name, km)
            .drop("_site", "_flat", "_flon"))


def each_factory(df: DataFrame, network: Network, name: str = "candidate_factory") -> DataFrame:
    """Every row next to every factory, with the distance between destination and factory.

    The site table is read once, as one array that is exploded inside the row's own stage.
    """
    sites = factories(df.sparkSession, network)
    every = sites.agg(F.collect_list(F.struct(*sites.columns)).alias("s")).scalar()
    return (df.withColumn("_sites", every).withColumn("_site", F.explode("_sites")).drop("_sites")
            .withColumns({
                name: F.col("_site.factory"),
                "candidate_setup_cost": F.col("_site.setup_cost"),
                "candidate_distance_km": haversine_km(F.col("_site.lat"), F.col("_site.lon"),
                                                      F.col("lat"), F.col("lon"))})
            .drop("_site"))


def distance_matrix(order_lines: DataFrame, network: Network) -> DataFrame:
    """Destination x factory distances in long form, one row per distinct destination and site."""
    places = order_lines.select("state", "lat", "lon").distinct()
    return (each_factory(places, network, "factory")
            .select("state", "factory", F.col("candidate_distance_km").alias("distance_km")))


def distance_matrix_wide(matrix: DataFrame, network: Network) -> DataFrame:
    """One column per factory, for export."""
    return (matrix.groupBy("state").pivot("factory", [s.name for s in network.sites])
            .agg(F.first("distance_km")))


def transit_days(distance: Column, multiplier: Column, a: Column, b: Column | int = 0) -> Column:
    """Transit-day proxy: scaled distance plus a seeded jitter of half a day, at least 1."""
    jitter = uniform(a, b) - 0.5
    return F.greatest(F.lit(1), F.rint(distance / KM_PER_DAY * multiplier + jitter).cast("int"))


def with_rank(df: DataFrame, ranks: DataFrame, key: str, rank: str) -> DataFrame:
    """Ordinal encoding of a category; an unknown category gets null."""
    return df.join(ranks.select(key, rank), key, "left")


def repaired_lead(df: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Add ``year_gap`` and ``repaired_lead_days``: lead minus the least lead of its year gap.

    The offset table has one row per year difference, at most the calendar's range of years, so
    it is looked up as a map; the rows themselves are not shuffled. ``dates`` may be a cheaper source
    of the same dates and lead times.
    """
    gap = F.year("ship_date") - F.year("order_date")
    least = ((df if dates is None else dates).where(F.col("lead_time_days").isNotNull()).groupBy(gap.alias("g"))
             .agg(F.min("lead_time_days").alias("m")))
    offsets = least.agg(F.map_from_entries(F.collect_list(F.struct("g", "m"))).alias("o")).scalar()
    return (df.withColumn("year_gap", gap)
            .withColumn("repaired_lead_days",
                        F.col("lead_time_days") - F.try_element_at(offsets, F.col("year_gap"))))
