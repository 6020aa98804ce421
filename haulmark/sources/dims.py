"""Dimension tables.

Tables are created from Arrow, so that Spark knows their exact size and chooses a broadcast join by
its own size threshold. Nothing in the library forces a broadcast of a table that can grow.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from haulmark.params import Network

# Ship modes with rank and transit multiplier.
SHIP_MODES = (("Same Day", 0, 0.1), ("First Class", 1, 1.0), ("Second Class", 2, 1.5),
              ("Standard Class", 3, 2.0))

# Region order.
REGIONS = (("Atlantic", 0), ("Gulf", 1), ("Interior", 2), ("Pacific", 3))

# Centroids of states and provinces (name, latitude, longitude).
STATE_CENTROIDS = (
    ("Alabama", 32.806671, -86.791130), ("Alaska", 61.3707, -152.4044),
    ("Arizona", 33.729759, -111.431221), ("Arkansas", 34.969704, -92.373123),
    ("California", 36.116203, -119.681564), ("Colorado", 39.059811, -105.311104),
    ("Connecticut", 41.597782, -72.755371), ("Delaware", 39.318523, -75.507141),
    ("District of Columbia", 38.897438, -77.026817), ("Florida", 27.766279, -81.686783),
    ("Georgia", 33.040619, -83.643074), ("Hawaii", 21.0943, -157.4983),
    ("Idaho", 44.240459, -114.478828), ("Illinois", 40.349457, -88.986137),
    ("Indiana", 39.849426, -86.258278), ("Iowa", 42.011539, -93.210526),
    ("Kansas", 38.526600, -96.726486), ("Kentucky", 37.668140, -84.670067),
    ("Louisiana", 31.169546, -91.867805), ("Maine", 44.693947, -69.381927),
    ("Maryland", 39.063946, -76.802101), ("Massachusetts", 42.230171, -71.530106),
    ("Michigan", 43.326618, -84.536095), ("Minnesota", 45.694454, -93.900192),
    ("Mississippi", 32.741646, -89.678696), ("Missouri", 38.456085, -92.288368),
    ("Montana", 46.921925, -110.454353), ("Nebraska", 41.125370, -98.268082),
    ("Nevada", 38.313515, -117.055374), ("New Hampshire", 43.452492, -71.563896),
    ("New Jersey", 40.298904, -74.521011), ("New Mexico", 34.840515, -106.248482),
    ("New York", 42.165726, -74.948051), ("North Carolina", 35.630066, -79.806419),
    ("North Dakota", 47.528912, -99.784012), ("Ohio", 40.388783, -82.764915),
    ("Oklahoma", 35.565342, -96.928917), ("Oregon", 44.572021, -122.070938),
    ("Pennsylvania", 40.590752, -77.209755), ("Rhode Island", 41.680893, -71.511780),
    ("South Carolina", 33.856892, -80.945007), ("South Dakota", 44.299782, -99.438828),
    ("Tennessee", 35.747845, -86.692345), ("Texas", 31.054487, -97.563461),
    ("Utah", 40.150032, -111.862434), ("Vermont", 44.045876, -72.710686),
    ("Virginia", 37.769337, -78.169968), ("Washington", 47.400902, -121.490494),
    ("West Virginia", 38.491226, -80.954453), ("Wisconsin", 44.268543, -89.616508),
    ("Wyoming", 42.755966, -107.302490),
    ("Alberta", 53.933271, -116.576504), ("British Columbia", 53.726669, -127.647621),
    ("Manitoba", 53.760861, -98.813873), ("New Brunswick", 46.565314, -66.461914),
    ("Newfoundland and Labrador", 53.135509, -57.660435),
    ("Nova Scotia", 44.681987, -63.744311), ("Ontario", 51.253775, -85.323214),
    ("Prince Edward Island", 46.510712, -63.416814), ("Quebec", 52.939916, -73.549136),
    ("Saskatchewan", 52.939916, -106.450864),
)


def local_table(spark: SparkSession, names: Iterable[str], rows: Iterable[tuple]) -> DataFrame:
    """A small table from driver-side rows, with a size the optimizer knows."""
    columns = list(zip(*rows, strict=True))
    return spark.createDataFrame(pa.table(dict(zip(names, map(list, columns), strict=True))))


def factories(spark: SparkSession, network: Network | None = None) -> DataFrame:
    sites = (network or Network()).sites
    return local_table(spark, ["factory", "lat", "lon", "setup_cost"],
                       [(s.name, s.lat, s.lon, s.setup_cost) for s in sites])


def state_centroids(spark: SparkSession) -> DataFrame:
    return local_table(spark, ["state", "lat", "lon"], STATE_CENTROIDS)


def ship_modes(spark: SparkSession) -> DataFrame:
    return local_table(spark, ["ship_mode", "ship_mode_rank", "multiplier"], SHIP_MODES)


def regions(spark: SparkSession) -> DataFrame:
    return local_table(spark, ["region", "region_rank"], REGIONS)


def product_factory(spark: SparkSession, mapping: Mapping[str, str]) -> DataFrame:
    """The caller's explicit product -> incumbent factory map."""
    return local_table(spark, ["product_name", "factory"], sorted(mapping.items()))
