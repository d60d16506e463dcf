"""Map-like tables derived from the given tables, in Spark and as SQL text.

Each view has a Spark builder and a SQL body. ``with_views`` puts the SQL bodies a query needs in
front of it as common table expressions. Every derivation keeps all source rows' information and
uses arithmetic both engines repeat exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

VIEWS: dict[str, tuple[list[str], str]] = {}
NET_CUSTOMERS = 60
RASTER_WIDTH = 150
RASTER_PIXELS = 15000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(names: str, body: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        needs, _ = VIEWS[name]
        for need in needs:
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    head = ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in order)
    body = body.strip()
    lead = "WITH RECURSIVE " if "RECURSIVE" in body or any("RECURSIVE" in VIEWS[n][1] for n in order) else "WITH "
    body = body.replace("RECURSIVE ", "", 1) if body.startswith("WITH RECURSIVE") else body
    if body.startswith("WITH "):
        return f"{lead}{head},\n{body[5:]}"
    return f"{lead}{head}\n{body}"


VIEWS["maps"] = (
    [],
    """SELECT c_custkey AS map_id, 2000 AS width, 1500 AS height, c_name AS name,
  CASE c_custkey % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'similarity' WHEN 2 THEN 'affine' ELSE 'tps' END AS requested
FROM customer""",
)


def maps(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    requested = (
        F.when(k % 4 == 0, "auto").when(k % 4 == 1, "similarity").when(k % 4 == 2, "affine").otherwise("tps")
    )
    return table(spark, sf, "customer").select(
        k.alias("map_id"),
        F.lit(2000).alias("width"),
        F.lit(1500).alias("height"),
        F.col("c_name").alias("name"),
        requested.alias("requested"),
    )


VIEWS["anchors"] = (
    [],
    """SELECT o_custkey AS map_id, o_orderkey AS anchor_id,
  CAST((o_orderkey * 37) % 2000 AS DOUBLE) AS x, CAST((o_orderkey * 53) % 1500 AS DOUBLE) AS y,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 38.6e0 - ((o_orderkey * 53) % 1500) * 0.000009e0
    + ((o_orderkey % 7) - 3) * 0.000001e0 + CASE WHEN o_orderkey % 97 = 0 THEN 0.002e0 ELSE 0.0e0 END END AS lat,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE -78.4e0 + ((o_orderkey * 37) % 2000) * 0.0000115e0
    + ((o_orderkey % 5) - 2) * 0.000001e0 END AS lon
FROM orders""",
)


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    x, y = k * 37 % 2000, k * 53 % 1500
    off = F.when(k % 97 == 0, 0.002).otherwise(0.0)
    lat = F.lit(38.6) - y * F.lit(0.000009) + (k % 7 - 3) * F.lit(0.000001) + off
    lon = F.lit(-78.4) + x * F.lit(0.0000115) + (k % 5 - 2) * F.lit(0.000001)
    gone = k % 17 == 0
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("map_id"),
        k.alias("anchor_id"),
        x.cast("double").alias("x"),
        y.cast("double").alias("y"),
        F.when(~gone, lat).alias("lat"),
        F.when(~gone, lon).alias("lon"),
    )


# A net puts the trails of sixty customers on one map, so that lines meet; its density does not
# grow with the number of customers.
VIEWS["rawpts"] = (
    [],
    """SELECT l_orderkey AS feature_id, l_linenumber AS ln,
  MIN(l_partkey * 1000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT)) AS code
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
)
VIEWS["openpts"] = (
    ["rawpts"],
    """SELECT feature_id, ROW_NUMBER() OVER (PARTITION BY feature_id ORDER BY ln) - 1 AS idx,
  CAST((code // 1000000) % 2000 AS DOUBLE) AS x,
  CAST((((code // 100) % 10000) * 15 + code % 100) % 1500 AS DOUBLE) AS y,
  COUNT(*) OVER (PARTITION BY feature_id) AS n
FROM rawpts""",
)
VIEWS["pts"] = (
    ["openpts"],
    """SELECT feature_id, idx, x, y FROM openpts
UNION ALL SELECT feature_id, n, x, y FROM openpts WHERE idx = 0 AND n >= 3 AND feature_id % 7 = 0""",
)
VIEWS["features"] = (
    ["openpts"],
    """SELECT o.o_custkey AS map_id, o.o_custkey // 60 AS net_id, o.o_orderkey AS feature_id, o.o_orderkey AS seq,
  CASE WHEN p.n = 1 THEN 'poi' WHEN p.n >= 3 AND o.o_orderkey % 10 = 1 AND o.o_orderkey % 7 <> 0 THEN 'area' ELSE 'trail' END AS kind,
  'Way <' || o.o_orderkey || '> & "' || o.o_orderpriority || '" it''s' AS name,
  CASE o.o_orderkey % 4 WHEN 0 THEN '#ab' || (o.o_orderkey % 10) WHEN 1 THEN '#1f6f' || (10 + o.o_orderkey % 90) WHEN 2 THEN 'teal' ELSE '3a7d44' END AS color,
  CASE WHEN o.o_orderstatus = 'P' THEN 'Notes & "' || o.o_orderpriority || '"' ELSE '' END AS notes,
  CASE WHEN p.n = 1 THEN CASE o.o_orderkey % 9 WHEN 0 THEN 'Trailhead' WHEN 1 THEN 'Parking' WHEN 2 THEN 'Restroom' WHEN 3 THEN 'Viewpoint'
    WHEN 4 THEN 'Campsite' WHEN 5 THEN 'Water' WHEN 6 THEN 'Information' WHEN 7 THEN 'Junction' ELSE 'Waypoint' END END AS poi_type,
  CASE WHEN p.n = 1 OR (p.n >= 3 AND o.o_orderkey % 10 = 1 AND o.o_orderkey % 7 <> 0) THEN NULL
    WHEN o.o_orderkey % 3 = 0 THEN 'one-way' WHEN o.o_orderkey % 3 = 1 THEN 'loop' END AS route_kind,
  CASE WHEN p.n = 1 OR (p.n >= 3 AND o.o_orderkey % 10 = 1 AND o.o_orderkey % 7 <> 0) THEN NULL
    WHEN o.o_orderkey % 3 = 1 THEN CASE WHEN o.o_orderkey % 2 = 0 THEN 'clockwise' ELSE 'counterclockwise' END END AS route_direction
FROM orders o JOIN (SELECT feature_id, n FROM openpts WHERE idx = 0) p ON p.feature_id = o.o_orderkey""",
)
VIEWS["vertices"] = (
    ["features", "pts"],
    """SELECT f.map_id, f.feature_id, p.idx, p.x, p.y, f.kind FROM pts p JOIN features f ON f.feature_id = p.feature_id""",
)
VIEWS["net_vertices"] = (
    ["features", "pts"],
    """SELECT f.net_id AS map_id, f.feature_id, p.idx, p.x, p.y, f.kind FROM pts p JOIN features f ON f.feature_id = p.feature_id""",
)
VIEWS["trail_vertices"] = (["net_vertices"], "SELECT map_id, feature_id, idx, x, y FROM net_vertices WHERE kind = 'trail'")
VIEWS["segs"] = (
    ["net_vertices"],
    """SELECT * FROM (SELECT map_id, feature_id, kind, idx AS seg, x AS x1, y AS y1,
  LEAD(x) OVER w AS x2, LEAD(y) OVER w AS y2 FROM net_vertices WINDOW w AS (PARTITION BY feature_id ORDER BY idx)) WHERE x2 IS NOT NULL""",
)
VIEWS["trail_segs"] = (["segs"], "SELECT map_id, feature_id, seg, x1, y1, x2, y2 FROM segs WHERE kind = 'trail'")


def raw_points(spark: SparkSession, sf: str) -> DataFrame:
    code = F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("bigint")
    raw = (
        table(spark, sf, "lineitem")
        # One shuffle by line serves the aggregation, the windows and the join with the orders.
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
        .repartition("l_orderkey")
        .groupBy(F.col("l_orderkey").alias("feature_id"), F.col("l_linenumber").alias("ln"))
        .agg(F.min(code).alias("code"))
    )
    # An order has at most seven line numbers, so these windows stay tiny after the aggregation.
    w = Window.partitionBy("feature_id")
    return raw.select(
        "feature_id",
        (F.row_number().over(w.orderBy("ln")) - 1).cast("bigint").alias("idx"),
        (F.floor(F.col("code") / 1000000) % 2000).cast("double").alias("x"),
        ((F.floor(F.col("code") / 100) % 10000 * 15 + F.col("code") % 100) % 1500).cast("double").alias("y"),
        F.count("*").over(w).alias("n"),
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Open points plus, for some lines, the first point again so that loops exist."""
    raw = raw_points(spark, sf)
    closes = (F.col("idx") == 0) & (F.col("n") >= 3) & (F.col("feature_id") % 7 == 0)
    spread = raw.withColumn("idx", F.explode(F.when(closes, F.array("idx", "n")).otherwise(F.array("idx"))))
    return spread.select("feature_id", "idx", "x", "y", "n")


def _pick(index, values):
    out = None
    for i, v in enumerate(values[:-1]):
        out = F.when(index == i, v) if out is None else out.when(index == i, v)
    return out.otherwise(values[-1])


def _feature_columns(n):
    k = F.col("o_orderkey")
    area = (n >= 3) & (k % 10 == 1) & (k % 7 != 0)
    trail = (n > 1) & ~area
    kinds = ["Trailhead", "Parking", "Restroom", "Viewpoint", "Campsite", "Water", "Information", "Junction", "Waypoint"]
    color = (
        F.when(k % 4 == 0, F.concat(F.lit("#ab"), (k % 10).cast("string")))
        .when(k % 4 == 1, F.concat(F.lit("#1f6f"), (k % 90 + 10).cast("string")))
        .when(k % 4 == 2, "teal")
        .otherwise("3a7d44")
    )
    turn = F.when(k % 2 == 0, "clockwise").otherwise("counterclockwise")
    return [
        F.col("o_custkey").alias("map_id"),
        F.floor(F.col("o_custkey") / NET_CUSTOMERS).cast("bigint").alias("net_id"),
        k.alias("feature_id"),
        k.alias("seq"),
        F.when(n == 1, "poi").when(area, "area").otherwise("trail").alias("kind"),
        F.concat(F.lit("Way <"), k.cast("string"), F.lit('> & "'), F.col("o_orderpriority"), F.lit("\" it's")).alias("name"),
        color.alias("color"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit('Notes & "'), F.col("o_orderpriority"), F.lit('"')))
        .otherwise("")
        .alias("notes"),
        F.when(n == 1, _pick(k % 9, kinds)).alias("poi_type"),
        F.when(trail, F.when(k % 3 == 0, "one-way").when(k % 3 == 1, "loop")).alias("route_kind"),
        F.when(trail & (k % 3 == 1), turn).alias("route_direction"),
    ]


def features(spark: SparkSession, sf: str) -> DataFrame:
    heads = raw_points(spark, sf).where("idx = 0").select("feature_id", "n")
    orders = table(spark, sf, "orders").join(heads, F.col("o_orderkey") == F.col("feature_id")).drop("feature_id")
    return orders.select(*_feature_columns(F.col("n")))


def vertices(spark: SparkSession, sf: str, net: bool = False) -> DataFrame:
    """One row per point with its map (or net), kind and dense index."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    joined = points(spark, sf).join(orders, F.col("feature_id") == F.col("o_orderkey")).drop("feature_id")
    owner = "net_id" if net else "map_id"
    wide = joined.select(*_feature_columns(F.col("n")), "idx", "x", "y")
    return wide.select(F.col(owner).alias("map_id"), "feature_id", "idx", "x", "y", "kind")


def trail_vertices(spark: SparkSession, sf: str) -> DataFrame:
    return vertices(spark, sf, net=True).where("kind = 'trail'").drop("kind")


VIEWS["pixels"] = (
    [],
    """SELECT map_id, x, y,
  CASE WHEN ink = 'A' THEN 200 WHEN ink = 'B' THEN 30 WHEN ink = 'C' THEN 40 ELSE 240 END + noise AS r,
  CASE WHEN ink = 'A' THEN 30 WHEN ink = 'B' THEN 60 WHEN ink = 'C' THEN 140 ELSE 236 END + noise AS g,
  CASE WHEN ink = 'A' THEN 30 WHEN ink = 'B' THEN 200 WHEN ink = 'C' THEN 60 ELSE 220 END + noise AS b
FROM (SELECT *, CASE WHEN (x + 3 * y) % 40 < 3 THEN 'A' WHEN x % 50 < 2 THEN 'B'
    WHEN x BETWEEN 90 AND 124 AND y BETWEEN 45 AND 84 THEN 'C' ELSE 'P' END AS ink
  FROM (SELECT o_orderkey // 15000 AS map_id, CAST(o_orderkey % 150 AS INTEGER) AS x,
      CAST((o_orderkey % 15000) // 150 AS INTEGER) AS y, CAST(o_custkey % 7 - 3 AS INTEGER) AS noise FROM orders))""",
)


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    grid = table(spark, sf, "orders").select(
        F.floor(k / RASTER_PIXELS).cast("bigint").alias("map_id"),
        (k % RASTER_WIDTH).cast("int").alias("x"),
        F.floor(k % RASTER_PIXELS / RASTER_WIDTH).cast("int").alias("y"),
        (F.col("o_custkey") % 7 - 3).cast("int").alias("noise"),
    )
    a = (F.col("x") + F.col("y") * 3) % 40 < 3
    b = F.col("x") % 50 < 2
    c = F.col("x").between(90, 124) & F.col("y").between(45, 84)
    level = lambda p, q, s, t: F.when(a, p).when(b, q).when(c, s).otherwise(t) + F.col("noise")
    return grid.select(
        "map_id", "x", "y",
        level(200, 30, 40, 240).alias("r"), level(30, 60, 140, 236).alias("g"), level(30, 200, 60, 220).alias("b"),
    )


VIEWS["boundaries"] = (
    [],
    """SELECT s_suppkey AS map_id, CAST(i AS BIGINT) AS idx,
  27.0e0 + (s_suppkey % 50) * 0.002e0 + CASE WHEN i < 2 THEN 0.0e0 ELSE 0.0012e0 + (s_nationkey % 5) * 0.0001e0 END + i * 0.0001e0 AS lat,
  -80.3e0 + (s_suppkey // 50) * 0.004e0 + CASE WHEN i IN (1, 2) THEN 0.0015e0 + (s_nationkey % 3) * 0.0002e0 ELSE 0.0e0 END + i * 0.0001e0 AS lon
FROM supplier, (SELECT unnest([0, 1, 2, 3]) AS i)""",
)


def boundaries(spark: SparkSession, sf: str) -> DataFrame:
    k, i = F.col("s_suppkey"), F.col("idx")
    rise = F.when(i < 2, F.lit(0.0)).otherwise(F.lit(0.0012) + F.col("s_nationkey") % 5 * F.lit(0.0001))
    run = F.when(i.isin(1, 2), F.lit(0.0015) + F.col("s_nationkey") % 3 * F.lit(0.0002)).otherwise(F.lit(0.0))
    corners = F.array(*[F.lit(v).cast("bigint") for v in range(4)])
    return table(spark, sf, "supplier").withColumn("idx", F.explode(corners)).select(
        k.alias("map_id"),
        "idx",
        (F.lit(27.0) + k % 50 * F.lit(0.002) + rise + i * F.lit(0.0001)).alias("lat"),
        (F.lit(-80.3) + F.floor(k / 50) * F.lit(0.004) + run + i * F.lit(0.0001)).alias("lon"),
    )


VIEWS["frames"] = (
    [],
    """SELECT s_suppkey AS frame_id, 27.0e0 + s_nationkey * 0.01e0 + 0.01e0 * (1 + s_suppkey % 13) AS north, 27.0e0 + s_nationkey * 0.01e0 AS south,
  -80.5e0 + s_suppkey % 40 * 0.01e0 AS west, -80.5e0 + s_suppkey % 40 * 0.01e0 + 0.012e0 * (1 + s_suppkey % 17) AS east FROM supplier""",
)


def frames(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    south = F.lit(27.0) + n * F.lit(0.01)
    west = F.lit(-80.5) + k % 40 * F.lit(0.01)
    return table(spark, sf, "supplier").select(
        k.alias("frame_id"),
        (south + F.lit(0.01) * (k % 13 + 1)).alias("north"),
        south.alias("south"),
        west.alias("west"),
        (west + F.lit(0.012) * (k % 17 + 1)).alias("east"),
    )


VIEWS["fixes"] = (
    [],
    """SELECT user_id AS device_id, event_id, ts, 27.0e0 + (event_id % 600) * 0.0001e0 AS lat, -80.3e0 + (user_id % 10) * 0.001e0 + (event_id % 37) * 0.00005e0 AS lon,
  value AS accuracy_m FROM events""",
)


def fixes(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("device_id"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        (F.lit(27.0) + e % 600 * F.lit(0.0001)).alias("lat"),
        (F.lit(-80.3) + F.col("user_id") % 10 * F.lit(0.001) + e % 37 * F.lit(0.00005)).alias("lon"),
        F.col("value").alias("accuracy_m"),
    )


# Requests: six tries of one tile are six consecutive events, so each key has a short log.
VIEWS["requests"] = (
    [],
    """SELECT event_type AS source_id, user_id AS map_id, (user_id || '/' || (event_id // 6)) AS key, event_id, ts,
  CAST(ROW_NUMBER() OVER (PARTITION BY user_id, event_id // 6 ORDER BY event_id) AS INTEGER) AS attempt,
  CASE event_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 404 ELSE 408 END AS status,
  CAST(floor(value * 100) AS BIGINT) AS bytes, CASE WHEN event_id % 5 = 1 THEN CAST(event_id % 90 AS DOUBLE) END AS retry_after_s FROM events""",
)


def requests(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    slot = F.floor(e / 6)
    # A key covers six consecutive events at most, so this window cannot grow.
    w = Window.partitionBy("user_id", slot).orderBy("event_id")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("source_id"),
        F.col("user_id").alias("map_id"),
        F.concat(F.col("user_id").cast("string"), F.lit("/"), slot.cast("string")).alias("key"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.row_number().over(w).alias("attempt"),
        _pick(e % 5, [200, 429, 503, 404, 408]).alias("status"),
        F.floor(F.col("value") * 100).cast("bigint").alias("bytes"),
        F.when(e % 5 == 1, (e % 90).cast("double")).alias("retry_after_s"),
    )


Builder = Callable[[SparkSession, str], DataFrame]
