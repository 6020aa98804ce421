"""Order lines from the star schema lineitem / orders / customer / nation / region / part.

The star schema stands in for the flat order file: ship mode is the order priority, state is the
customer's nation, product is the part's brand, and the division is the brand number modulo three.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.functions.text import lead_days
from haulmark.operators.derive import modal_factory, resolve_factory, with_distance
from haulmark.params import Assumptions, Network
from haulmark.sources.dims import local_table, product_factory

# Thresholds under which this data has moves on both sides of every gate.
MIN_ORDERS = 2200
MIN_MATERIAL_DAYS = 0.25
LANE_MIN_ORDERS = 320
ASSUMPTIONS = Assumptions(min_orders_for_recommendation=MIN_ORDERS,
                          min_material_days=MIN_MATERIAL_DAYS)
# Transit multiplier by rank of the order priority.
MODES = (("1-URGENT", 1, 0.1), ("2-HIGH", 2, 1.0), ("3-MEDIUM", 3, 1.5),
         ("4-NOT SPECIFIED", 4, 2.0), ("5-LOW", 5, 2.0))
BRANDS = range(1, 26)
LAST_MAPPED_BRAND = 22


# Declared schemas spare a footer-reading job per table and query.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                "c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
            "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
              "value DOUBLE, props STRING",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def product_of(brand: int) -> str:
    return f"Brand - {brand}"


def site_index(brand: int) -> int:
    return (2 * (brand % 3) + brand % 2) % 5


def explicit_map(spark: SparkSession, network: Network) -> DataFrame:
    """Brands up to 22 are mapped; later ones resolve through their division."""
    return product_factory(spark, {product_of(b): network.sites[site_index(b)].name
                                   for b in BRANDS if b <= LAST_MAPPED_BRAND})


def mode_table(spark: SparkSession) -> DataFrame:
    return local_table(spark, ["ship_mode", "ship_mode_rank", "multiplier"], MODES).withColumn(
        "ship_mode_rank", F.col("ship_mode_rank").cast("int"))


def region_table(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "region").select(
        F.col("r_name").alias("region"), F.col("r_regionkey").cast("int").alias("region_rank"))


def products(spark: SparkSession, folder: str) -> DataFrame:
    """Parts with product name and division."""
    brand = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    return table(spark, folder, "part").select(
        "p_partkey", "p_retailprice",
        F.concat(F.lit("Brand - "), brand.cast("string")).alias("product_name"),
        F.concat(F.lit("div_"), (brand % 3).cast("string")).alias("division"))


def product_divisions(spark: SparkSession, folder: str) -> DataFrame:
    return products(spark, folder).select("product_name", "division").distinct()


def state_table(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as states with a centroid."""
    key = F.col("n_nationkey")
    return table(spark, folder, "nation").select(
        "n_nationkey", "n_regionkey", F.col("n_name").alias("state"),
        (F.lit(25) + (key * 7) % 25).cast("double").alias("lat"),
        (F.lit(-125) + (key * 13) % 55).cast("double").alias("lon"))


def destinations(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with state, region and centroid."""
    return (table(spark, folder, "customer").select("c_custkey", "c_nationkey")
            .join(state_table(spark, folder), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region_table(spark, folder), F.col("n_regionkey") == F.col("region_rank"))
            .select("c_custkey", "state", "lat", "lon", "region", "region_rank"))


def placed_orders(spark: SparkSession, folder: str) -> DataFrame:
    return (table(spark, folder, "orders")
            .join(destinations(spark, folder), F.col("o_custkey") == F.col("c_custkey"))
            .select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
                    F.to_date("o_orderdate").alias("order_date"),
                    F.col("o_orderpriority").alias("ship_mode"),
                    F.substring("o_orderpriority", 1, 1).cast("int").alias("ship_mode_rank"),
                    "state", "region", "region_rank", "lat", "lon"))


def order_lines(spark: SparkSession, folder: str, network: Network | None = None) -> DataFrame:
    """The prepared order-line table.

    Products are resolved on the part table, before it meets the lines, and the order join comes
    last: its output stays partitioned by order, which the distinct-order counts then reuse.
    """
    network = network or Network()
    divisions = local_table(spark, ["product_name", "division"],
                            [(product_of(b), f"div_{b % 3}") for b in BRANDS])
    explicit = explicit_map(spark, network)
    parts = resolve_factory(products(spark, folder), explicit, modal_factory(explicit, divisions))
    quantity, price = F.col("l_quantity"), F.col("l_extendedprice")
    sales = price * (F.lit(1.0) - F.col("l_discount"))
    cost = quantity * F.col("p_retailprice")
    lines = (table(spark, folder, "lineitem")
             .join(parts, F.col("l_partkey") == F.col("p_partkey"))
             .select(F.col("l_orderkey").alias("order_id"),
                     (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("line_key"),
                     F.to_date("l_shipdate").alias("ship_date"), "product_name", "division",
                     "current_factory", "factory_provenance", quantity.alias("units"),
                     sales.alias("sales"), cost.alias("cost"),
                     (sales - cost).alias("gross_profit")))
    joined = lines.join(placed_orders(spark, folder), "order_id")
    return with_distance(joined, network).withColumn(
        "lead_time_days", lead_days(F.col("order_date"), F.col("ship_date")))


def order_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Order date, ship date and lead time of every line."""
    orders = table(spark, folder, "orders").select("o_orderkey",
                                                   F.to_date("o_orderdate").alias("order_date"))
    dated = (table(spark, folder, "lineitem").select("l_orderkey",
                                                     F.to_date("l_shipdate").alias("ship_date"))
             .join(orders, F.col("l_orderkey") == F.col("o_orderkey")))
    return dated.select("order_date", "ship_date", lead_days(
        F.col("order_date"), F.col("ship_date")).alias("lead_time_days"))


RAW_COLUMNS = ("row_id", "order_id", "order_date", "ship_date", "ship_mode", "customer_id",
               "country", "city", "state", "postal_code", "division", "region", "product_id",
               "product_name", "sales", "units", "gross_profit", "cost")
RAW_HEADER = ("Row ID", "Order ID", "Order Date", "Ship Date", "Ship Mode", "Customer ID",
              "Country/Region", "City", "State/Province", "Postal Code", "Division", "Region",
              "Product ID", "Product Name", "Sales", "Units", "Gross Profit", "Cost")
COPY_OFFSET = 10 ** 15


def raw_order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """All-text order lines with planted defects, as a careless export would hold them.

    Repeated headers (one per 1,000 orders), blank rows (one per 1,500), exact copies under a new
    row id (order % 97 = 0), bad dates (% 101), text in a money column (% 103), missing cost
    (% 89), an unnormalised product name (% 7) and an unknown state (% 499).
    """
    o = F.col("order_id")
    parts = products(spark, folder)
    orders = (table(spark, folder, "orders")
              .join(destinations(spark, folder), F.col("o_custkey") == F.col("c_custkey"))
              .withColumnRenamed("o_orderkey", "order_id"))
    quantity = F.col("l_quantity").cast("decimal(12,0)")
    sales = (F.col("l_extendedprice").cast("decimal(16,2)")
             * (F.lit(1).cast("decimal(3,2)") - F.col("l_discount").cast("decimal(3,2)"))
             ).cast("decimal(18,4)")
    cost = (quantity * F.col("p_retailprice").cast("decimal(12,2)")).cast("decimal(18,4)")
    joined = (table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "order_id")
              .join(parts, F.col("l_partkey") == F.col("p_partkey"))
              .join(orders, "order_id"))
    row_id = (o % 10 ** 9) * 10 ** 6 + (F.col("l_partkey") * 10 + F.col("l_linenumber")) % 10 ** 6
    bad_date = o % 101 == 0
    order_date = F.date_format("o_orderdate", "dd-MM-yyyy")
    ship_date = F.date_format("l_shipdate", "dd-MM-yyyy")
    typed = joined.select(
        row_id.alias("row_id"), o.cast("string").alias("order_id"),
        F.when(bad_date & (o % 2 == 0), "31-02-1998").otherwise(order_date).alias("order_date"),
        F.when(bad_date & (o % 2 == 1), "n/a").otherwise(ship_date).alias("ship_date"),
        F.col("o_orderpriority").alias("ship_mode"),
        F.col("o_custkey").cast("string").alias("customer_id"), F.lit("Home").alias("country"),
        F.concat(F.lit("City "), (F.col("o_custkey") % 100).cast("string")).alias("city"),
        F.when(o % 499 == 0, "Atlantis").otherwise(F.col("state")).alias("state"),
        F.lpad((F.col("o_custkey") % 1000).cast("string"), 5, "0").alias("postal_code"),
        "division", "region", F.col("l_partkey").cast("string").alias("product_id"),
        F.when(o % 7 == 0, F.replace("product_name", F.lit(" - "), F.lit(" -")))
        .otherwise(F.col("product_name")).alias("product_name"),
        F.when(o % 103 == 0, "abc").otherwise(sales.cast("string")).alias("sales"),
        quantity.cast("string").alias("units"),
        (sales - cost).cast("decimal(18,4)").cast("string").alias("gross_profit"),
        F.when(o % 89 == 0, "").otherwise(cost.cast("string")).alias("cost"),
        (o % 97 == 0).alias("_copied"))
    # A copied row appears twice, the second time under another row id.
    rows = typed.withColumn("_offset", F.explode(
        F.when(F.col("_copied"), F.array(F.lit(0), F.lit(COPY_OFFSET)))
        .otherwise(F.array(F.lit(0).cast("bigint")))))
    rows = rows.select((F.col("row_id") + F.col("_offset")).cast("string").alias("row_id"),
                       *RAW_COLUMNS[1:])
    keys = table(spark, folder, "orders").select("o_orderkey")
    headers = keys.where(F.col("o_orderkey") % 1000 == 0).select(
        *[F.lit(h).alias(c) for c, h in zip(RAW_COLUMNS, RAW_HEADER, strict=True)])
    blanks = keys.where(F.col("o_orderkey") % 1500 == 0).select(
        *[F.lit("").alias(c) for c in RAW_COLUMNS])
    return rows.unionByName(headers).unionByName(blanks)


def postal_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Postal codes with a centroid near their first customer's state; one code in ten has none."""
    code = F.col("c_custkey") % 1000
    nation = F.min(F.col("c_nationkey")).alias("n_nationkey")
    codes = (table(spark, folder, "customer").where(code % 10 != 0)
             .groupBy(code.alias("code")).agg(nation))
    return (codes.join(state_table(spark, folder), "n_nationkey")
            .select(F.lpad(F.col("code").cast("string"), 5, "0").alias("postal_code"),
                    (F.col("lat") + (F.col("code") % 100 - 50) / 100.0).alias("lat"),
                    (F.col("lon") + (F.col("code") % 70 - 35) / 100.0).alias("lon")))
