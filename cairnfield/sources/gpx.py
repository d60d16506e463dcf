"""GPX files and GPX text as point rows, lines, decimation and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.operators.ordered import chunk_of, number_rows, running
from cairnfield.session import cut

_POINT = (
    "STRUCT<_lat: STRING, _lon: STRING, name: STRING, desc: STRING, ele: STRING, time: STRING>"
)
GPX_SCHEMA = (
    f"wpt ARRAY<{_POINT}>, rte ARRAY<STRUCT<name: STRING, rtept: ARRAY<{_POINT}>>>,"
    f" trk ARRAY<STRUCT<name: STRING, trkseg: ARRAY<STRUCT<trkpt: ARRAY<{_POINT}>>>>>"
)


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """Points of all GPX files under ``path``; any version, any namespace prefix."""
    docs = spark.read.format("xml").option("rowTag", "gpx").option("ignoreNamespace", True).schema(GPX_SCHEMA).load(path)
    return points(docs.select(F.col("_metadata.file_name").alias("file"), "wpt", "rte", "trk"))


def from_gpx_text(df: DataFrame, key: str, column: str) -> DataFrame:
    """The same rows from a text column; a text that is not GPX gives none."""
    parsed = df.select(F.col(key).alias("file"), F.from_xml(column, GPX_SCHEMA, {"ignoreNamespace": "true"}).alias("d"))
    return points(parsed.select("file", "d.wpt", "d.rte", "d.trk"))


def _number(text: Column) -> Column:
    """The number a text starts with, as lenient readers take it."""
    return F.regexp_extract(F.trim(text), r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def _valid(pts: Column) -> Column:
    """The valid points with their numbers; each text is read once."""
    read = F.transform(pts, lambda p: F.struct(p.alias("p"), _number(p["_lat"]).alias("lat"), _number(p["_lon"]).alias("lon")))
    return F.filter(read, lambda q: F.coalesce((F.abs(q["lat"]) <= 90) & (F.abs(q["lon"]) <= 180), F.lit(False)))


def _text(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t != "", t)


def points(docs: DataFrame) -> DataFrame:
    """Waypoints, route points and track points in file order.

    Invalid points are dropped inside their array first, so positions number valid points only and
    no window is needed. Lists of all kinds go one way, so that a document is read once.
    """
    c = F.col
    s = lambda col: col.cast("string")
    none = F.lit(None).cast("int")

    def part(kind: str, track: Column, seg: Column, name: Column, line: Column, pts: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), track.alias("track_no"), seg.alias("seg_no"), name.cast("string").alias("name"), line.cast("string").alias("line_name"), pts.alias("pts"))

    def named(name: Column, word: str, number: Column) -> Column:
        return F.coalesce(_text(name), F.concat(F.lit(word), s(number)))

    def route(r: Column, i: Column) -> Column:
        label = named(r["name"], "Route ", i + 1)
        return part("rtept", i + 1, none, label, label, r["rtept"])

    def track(t: Column, i: Column) -> Column:
        label, many = named(t["name"], "Track ", i + 1), F.size(t["trkseg"]) > 1
        line = lambda k: F.when(many, F.concat(label, F.lit(" (seg "), s(k + 1), F.lit(")"))).otherwise(label)
        return F.transform(t["trkseg"], lambda g, k: part("trkpt", i + 1, k + 1, label, line(k), g["trkpt"]))

    way = F.when(c("wpt").isNotNull(), F.array(part("wpt", none, none, F.lit(None), F.lit(None), c("wpt"))))
    tracks = F.flatten(F.filter(F.transform("trk", track), lambda x: x.isNotNull()))
    lists = F.array_compact(F.array(way, F.transform("rte", route), tracks))
    spread = docs.select("file", F.explode(F.flatten(lists)).alias("l"))
    spread = spread.select("file", "l.kind", "l.track_no", "l.seg_no", c("l.name").alias("_name"), "l.line_name", F.posexplode(_valid(c("l.pts"))).alias("_i", "q"))
    spread = spread.withColumn("pt_no", c("_i") + 1)
    pt = s(c("pt_no"))
    label = F.when(c("kind") == "wpt", F.concat(F.lit("Waypoint "), pt)).otherwise(F.concat(c("_name"), F.lit(" pt "), pt))
    ident = (
        F.when(c("kind") == "wpt", F.concat(F.lit("wpt-"), pt)).when(c("kind") == "rtept", F.concat(F.lit("rte-"), s(c("track_no")), F.lit("-"), pt))
        .otherwise(F.concat(F.lit("trk-"), s(c("track_no")), F.lit("-"), s(c("seg_no")), F.lit("-"), pt))
    )
    return spread.select(
        "file", "kind", ident.alias("point_id"), F.coalesce(_text(c("q.p.name")), label).alias("name"), c("q.lat").alias("lat"), c("q.lon").alias("lon"),
        _number(c("q.p.ele")).alias("ele"), _text(c("q.p.desc")).alias("desc"), _text(c("q.p.time")).alias("time"), "track_no", "seg_no", "pt_no", "line_name",
    )


def gps_lines(pts: DataFrame) -> DataFrame:
    """Routes and track segments as ordered point lists, cut into chunks so a long track stays whole.

    Chunks of one line share (file, kind, track_no, seg_no) and sort by ``chunk``.
    """
    rows = pts.where("kind <> 'wpt'").withColumn("chunk", chunk_of(F.col("pt_no") - 1))
    return rows.groupBy("file", "kind", "track_no", "seg_no", "line_name", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("pt_no", "lat", "lon"))).alias("points")
    )


def decimate(pts: DataFrame, budget: int, least: int = 1) -> DataFrame:
    """Thin the lines of every file to about ``budget`` points, waypoints included; all waypoints and both line ends stay.

    Lines get ``least`` points at least, however many waypoints there are. A point's place in its
    file is its number within its segment plus the lengths of the segments before it, so only one
    row per segment is put in order.
    """
    c = F.col
    linear = pts.where("kind <> 'wpt'")
    keys = ["kind", "track_no", "seg_no"]
    segs = linear.groupBy("file", *keys).agg(F.count("*").alias("_n"))
    order = [c("kind"), c("track_no"), F.coalesce("seg_no", F.lit(0))]
    segs = number_rows(segs, ["file"], order, "_k", start=0)
    segs = cut(running(segs, ["file"], c("_n"), "_before", idx="_k", inclusive=False))
    total = segs.groupBy("file").agg(F.sum("_n").alias("_linear"))
    way = pts.where("kind = 'wpt'").groupBy("file").agg(F.count("*").alias("_way"))
    per_file = total.join(way, "file", "left").fillna(0, ["_way"])
    room = F.greatest(F.lit(least), F.lit(budget) - c("_way"))
    per_file = per_file.select("file", "_linear", F.greatest(F.lit(1), F.ceil(c("_linear") / room)).alias("_stride"))
    on = segs.select(c("file").alias("_f"), c("kind").alias("_kd"), c("track_no").alias("_t"), c("seg_no").alias("_s"), "_before")
    rows = linear.join(on, (c("file") == c("_f")) & (c("kind") == c("_kd")) & (c("track_no") == c("_t")) & c("seg_no").eqNullSafe(c("_s")))
    rows = rows.join(per_file, "file").withColumn("_i", c("_before") + c("pt_no") - 1)
    kept = rows.where((c("_i") == 0) | (c("_i") == c("_linear") - 1) | (c("_i") % c("_stride") == 0))
    return pts.where("kind = 'wpt'").unionByName(kept.select(*pts.columns))


def search_points(pts: DataFrame, text: str, limit: int = 100) -> DataFrame:
    """The first matches, in file order, of a case-insensitive search in name, description or kind."""
    q = text.strip().lower()
    has = lambda n: F.coalesce(F.lower(n).contains(q), F.lit(False))
    found = pts.where(has("name") | has("desc") | has("kind")) if q else pts
    rank = F.when(F.col("kind") == "wpt", 0).when(F.col("kind") == "rtept", 1).otherwise(2)
    return found.orderBy("file", rank, "track_no", F.coalesce("seg_no", F.lit(0)), "pt_no").limit(limit)


