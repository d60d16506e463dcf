"""Project documents: scan, version steps, legacy import, bulk validation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.constants import DEFAULT_COLORS, POI_SYMBOLS
from cairnfield.functions.geo import finite, round_half_up
from cairnfield.operators.lines import KEYS, ring_facts

CURRENT_VERSION = 4
_FEATURE = (
    "STRUCT<id: STRING, name: STRING, color: STRING, notes: STRING, kind: STRING, pts: ARRAY<ARRAY<DOUBLE>>, at: ARRAY<DOUBLE>,"
    " poiType: STRING, ink: ARRAY<DOUBLE>, route: STRUCT<kind: STRING, direction: STRING>>"
)
PROJECT_SCHEMA = (
    "version INT, name STRING, fitMethod STRING, units STRING, seq BIGINT, updatedAt STRING,"
    " image STRUCT<fileName: STRING, width: DOUBLE, height: DOUBLE, originalWidth: DOUBLE, originalHeight: DOUBLE, sha256: STRING,"
    " attribution: STRING, acquisitionYear: INT, source: STRUCT<kind: STRING, mimeType: STRING, page: DOUBLE, pageCount: DOUBLE,"
    " renderScale: DOUBLE, sourceId: STRING, z: INT, tileSize: INT, origin: STRUCT<x: DOUBLE, y: DOUBLE>, boundary: ARRAY<ARRAY<DOUBLE>>, tileCount: INT>>,"
    f" anchors ARRAY<STRUCT<id: STRING, px: ARRAY<DOUBLE>, ll: ARRAY<DOUBLE>, source: STRING>>, features ARRAY<{_FEATURE}>,"
    " trace STRUCT<smartFollow: BOOLEAN, tolerance: DOUBLE, ink: ARRAY<DOUBLE>>,"
    " autoTrace STRUCT<gapPx: DOUBLE, minLengthPct: DOUBLE, chips: ARRAY<STRUCT<id: STRING, rgb: ARRAY<DOUBLE>, name: STRING, enabled: BOOLEAN, share: DOUBLE, named: BOOLEAN>>>"
)

Step = Callable[[DataFrame], DataFrame]


def _drop_routes(df: DataFrame) -> DataFrame:
    """Version 3 documents may hold trail routes of an older meaning; version 4 starts without."""
    old = F.col("version") == 3
    bare = F.transform("features", lambda f: f.withField("route", F.when(f["kind"] == "trail", F.lit(None)).otherwise(f["route"])))
    return df.withColumn("features", F.when(old, bare).otherwise(F.col("features")))


MIGRATIONS: dict[int, Step] = {1: lambda df: df, 2: lambda df: df, 3: _drop_routes}


def register_migration(from_version: int, step: Step) -> None:
    """Replace or add the step that lifts documents of one version; it must leave others alone."""
    MIGRATIONS[from_version] = step


def migrate(docs: DataFrame) -> DataFrame:
    """Lift every document to the current version, one column transform per step."""

    def lift(df: DataFrame, version: int) -> DataFrame:
        stepped = df.transform(MIGRATIONS[version])
        at = F.col("version") == version
        return stepped.withColumn("version", F.when(at, version + 1).otherwise(F.col("version")))

    return reduce(lift, sorted(MIGRATIONS), docs)


def read_projects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents at the current version, rejected documents) from JSON files, one document each."""
    raw = spark.read.schema(PROJECT_SCHEMA).option("multiLine", True).json(path)
    return accept(raw.withColumn("map_id", F.col("_metadata.file_name")))


def from_project_text(df: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    docs = df.select(F.col(key).alias("map_id"), F.from_json(column, PROJECT_SCHEMA).alias("d")).select("map_id", "d.*")
    return accept(docs)


def accept(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(F.col("version").between(1, CURRENT_VERSION), F.lit(False))
    return migrate(docs.where(ok)), docs.where(~ok)


def tables(docs: DataFrame) -> dict[str, DataFrame]:
    """Documents exploded into maps, anchors, features, vertices and chips."""
    c = F.col
    maps = docs.select(
        "map_id", "name", c("fitMethod").alias("requested"), "units", c("image.width").alias("width"), c("image.height").alias("height"),
        c("image.attribution").alias("attribution"), c("image.acquisitionYear").alias("year"), c("image.source").alias("source"),
        c("trace.tolerance").alias("tolerance"), c("autoTrace.gapPx").alias("gap_px"), c("autoTrace.minLengthPct").alias("min_length_pct"),
    )
    a = docs.select("map_id", F.posexplode("anchors").alias("seq", "a"))
    anchors = a.select(
        "map_id", c("a.id").alias("anchor_id"), "seq", F.get("a.px", F.lit(0)).alias("x"), F.get("a.px", F.lit(1)).alias("y"),
        F.get("a.ll", F.lit(0)).alias("lat"), F.get("a.ll", F.lit(1)).alias("lon"), c("a.source").alias("source"),
    )
    f = docs.select("map_id", F.posexplode("features").alias("seq", "f"))
    features = f.select(
        "map_id", c("f.id").alias("feature_id"), "seq", c("f.kind").alias("kind"), c("f.name").alias("name"), c("f.color").alias("color"), c("f.notes").alias("notes"),
        c("f.poiType").alias("poi_type"), c("f.route.kind").alias("route_kind"), c("f.route.direction").alias("route_direction"), c("f.ink").alias("ink"),
    )
    pts = F.when(c("f.kind") == "poi", F.array("f.at")).otherwise(c("f.pts"))
    v = f.select("map_id", c("f.id").alias("feature_id"), c("f.kind").alias("kind"), F.posexplode(pts).alias("_i", "p"))
    vertices = v.select("map_id", "feature_id", c("_i").cast("bigint").alias("idx"), F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"), "kind")
    chips = docs.select("map_id", F.posexplode("autoTrace.chips").alias("seq", "k"))
    rgb = lambda i: F.get("k.rgb", F.lit(i))
    chips = chips.select(
        "map_id", c("k.id").alias("chip_id"), "seq", rgb(0).alias("r"), rgb(1).alias("g"), rgb(2).alias("b"), c("k.name").alias("name"),
        c("k.enabled").alias("enabled"), c("k.share").alias("share"), c("k.named").alias("named"),
    )
    return {"maps": maps, "anchors": anchors, "features": features, "vertices": vertices, "chips": chips}


# The exporter that wrote the legacy format marked its files with its own name; callers pass it.
LEGACY_SCHEMA = (
    "app STRING, image STRING, meta STRUCT<W: DOUBLE, H: DOUBLE, name: STRING, gap: DOUBLE, minPct: DOUBLE, tol: DOUBLE, smart: BOOLEAN, units: STRING,"
    " method: STRING, seq: DOUBLE, savedAt: STRING, gcps: ARRAY<STRUCT<id: STRING, x: DOUBLE, y: DOUBLE, lat: DOUBLE, lon: DOUBLE>>,"
    " features: ARRAY<STRUCT<id: STRING, type: STRING, name: STRING, notes: STRING, color: STRING, sym: STRING, pts: ARRAY<ARRAY<DOUBLE>>, ink: ARRAY<DOUBLE>>>,"
    " chips: ARRAY<STRUCT<id: STRING, rgb: ARRAY<DOUBLE>, name: STRING, on: BOOLEAN, share: DOUBLE, fromLegend: BOOLEAN>>>"
)


def read_legacy(spark: SparkSession, path: str, marker: str) -> dict[str, DataFrame]:
    raw = spark.read.schema(LEGACY_SCHEMA).option("multiLine", True).json(path)
    return legacy_tables(raw.withColumn("map_id", F.col("_metadata.file_name")), marker)


def _filled(col: Column, default: Column) -> Column:
    return F.when(F.coalesce(col, F.lit("")) == "", default).otherwise(col)


def legacy_tables(docs: DataFrame, marker: str) -> dict[str, DataFrame]:
    """Legacy documents with the given app marker and a base64 image, as current tables."""
    c = F.col
    data = r"(?s)^data:([^;,]+)?(?:;[^,]*)?;base64,(.+)$"
    docs = docs.where((c("app") == marker) & F.coalesce(c("image").rlike(data), F.lit(False)))
    side = lambda n: F.when(c(n) > 0, c(n)).otherwise(1.0)
    bytes_ = F.unbase64(F.regexp_replace(F.regexp_extract("image", data, 2), r"\s+", ""))
    w, h = side("meta.W"), side("meta.H")
    gap = F.least(F.lit(120.0), F.greatest(F.lit(6.0), round_half_up(F.greatest(w, h) / 80)))
    method = F.when(c("meta.method").isin("similarity", "affine", "tps"), c("meta.method")).otherwise("auto")
    maps = docs.select(
        "map_id", _filled(F.trim("meta.name"), F.lit("Park map")).alias("name"), w.alias("width"), h.alias("height"),
        _filled(F.regexp_extract("image", data, 1), F.lit("image/png")).alias("mime_type"), F.sha2(bytes_, 256).alias("sha256"), method.alias("requested"),
        F.when(c("meta.units") == "km", "km").otherwise("mi").alias("units"), F.coalesce("meta.gap", gap).alias("gap_px"),
        F.coalesce("meta.minPct", F.lit(4.0)).alias("min_length_pct"), F.coalesce("meta.tol", F.lit(60.0)).alias("tolerance"),
        F.coalesce("meta.smart", F.lit(True)).alias("smart_follow"),
    )
    n = lambda word, i: F.concat(F.lit(word), (c(i) + 1).cast("string"))
    g = docs.select("map_id", F.posexplode("meta.gcps").alias("seq", "g"))
    both = c("g.lat").isNotNull() & c("g.lon").isNotNull()
    anchors = g.select(
        "map_id", _filled(c("g.id"), n("g", "seq")).alias("anchor_id"), "seq", F.coalesce("g.x", F.lit(0.0)).alias("x"), F.coalesce("g.y", F.lit(0.0)).alias("y"),
        F.when(both, c("g.lat")).alias("lat"), F.when(both, c("g.lon")).alias("lon"), F.lit("paste").alias("source"),
    )
    f = docs.select("map_id", F.posexplode("meta.features").alias("seq", "f"))
    kind = F.when(c("f.type") == "point", "poi").when(c("f.type") == "area", "area").otherwise("trail")
    pair_ok = lambda p: (F.size(p) == 2) & F.coalesce(finite(p[0]) & finite(p[1]), F.lit(False))
    pts = F.coalesce(F.filter("f.pts", pair_ok), F.array().cast("array<array<double>>"))
    head = F.get("f.pts", F.lit(0))
    spot = F.array(F.when(F.coalesce(pair_ok(head), F.lit(False)), head).otherwise(F.array(F.lit(0.0), F.lit(0.0))))
    f = f.withColumn("kind", kind).withColumn("pts", F.when(c("kind") == "poi", spot).otherwise(pts))
    need = F.when(c("kind") == "poi", 1).when(c("kind") == "area", 3).otherwise(2)
    f = f.where(F.size("pts") >= need).withColumn("feature_id", _filled(c("f.id"), n("f", "seq")))
    known = c("f.sym").isin(*[s[0] for s in POI_SYMBOLS])
    default = F.when(c("kind") == "poi", DEFAULT_COLORS["poi"]).when(c("kind") == "area", DEFAULT_COLORS["area"]).otherwise(DEFAULT_COLORS["trail"])
    features = f.select(
        "map_id", "feature_id", "seq", "kind", _filled(c("f.name"), n("Feature ", "seq")).alias("name"), _filled(c("f.color"), default).alias("color"),
        F.coalesce("f.notes", F.lit("")).alias("notes"), F.when(c("kind") == "poi", F.when(known, c("f.sym")).otherwise("Waypoint")).alias("poi_type"),
        F.when((c("kind") == "trail") & (F.size("f.ink") == 3), c("f.ink")).alias("ink"),
    )
    v = f.select("map_id", "feature_id", "kind", F.posexplode("pts").alias("_i", "p"))
    vertices = v.select("map_id", "feature_id", c("_i").cast("bigint").alias("idx"), c("p")[0].alias("x"), c("p")[1].alias("y"), "kind")
    k = docs.select("map_id", F.posexplode("meta.chips").alias("seq", "k"))
    rgb = lambda i: F.when(F.size("k.rgb") == 3, round_half_up(F.get("k.rgb", F.lit(i)))).otherwise(0).cast("int")
    chips = k.select(
        "map_id", _filled(c("k.id"), n("c", "seq")).alias("chip_id"), "seq", rgb(0).alias("r"), rgb(1).alias("g"), rgb(2).alias("b"),
        F.coalesce("k.name", F.lit("")).alias("name"), F.coalesce("k.on", F.lit(False)).alias("enabled"), "k.share", F.coalesce("k.fromLegend", F.lit(False)).alias("named"),
    )
    return {"maps": maps, "anchors": anchors, "features": features, "vertices": vertices, "chips": chips}


def validate(maps: DataFrame, anchors: DataFrame, features: DataFrame, v: DataFrame) -> DataFrame:
    """One row (map_id, path, message) per broken rule; every rule is checked on every row.

    ``maps`` may carry the columns of its kind of source; rules on absent columns are skipped.
    """
    c = F.col

    def broken(df: DataFrame, path: Column, rules: list[tuple[Column, Column | str]]) -> DataFrame:
        text = lambda m: m if isinstance(m, Column) else F.lit(m)
        hits = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), text(m)) for bad, m in rules]))
        return df.select("map_id", path.alias("path"), F.explode(hits).alias("message"))

    blank = lambda n: F.coalesce(c(n), F.lit("")) == ""
    map_rules = [(~(c("width") > 0), "image.width must be a positive number"), (~(c("height") > 0), "image.height must be a positive number")]
    if "tolerance" in maps.columns:
        map_rules.append((~finite(c("tolerance")), "trace.tolerance must be a finite number"))
    if "gap_px" in maps.columns:
        map_rules.append((~(c("gap_px") >= 0), "autoTrace.gapPx must be a non-negative number"))
    if "min_length_pct" in maps.columns:
        map_rules.append((~(c("min_length_pct") >= 0), "autoTrace.minLengthPct must be a non-negative number"))
    if "source" in maps.columns:
        s = "source."
        is_ = lambda k: c(s + "kind") == k
        map_rules += [
            (~F.coalesce(c(s + "kind").isin("image", "pdf", "tiles"), F.lit(False)), F.concat(F.lit('unknown image.source.kind "'), F.coalesce(c(s + "kind"), F.lit("")), F.lit('"'))),
            (is_("image") & blank(s + "mimeType"), "image.source.mimeType must be a non-empty string"),
            (is_("pdf") & ~F.coalesce(c(s + "page") >= 1, F.lit(False)), "image.source.page must be an integer >= 1"),
            (is_("pdf") & ~F.coalesce(c(s + "pageCount") >= 1, F.lit(False)), "image.source.pageCount must be an integer >= 1"),
            (is_("pdf") & ~F.coalesce(c(s + "renderScale") > 0, F.lit(False)), "image.source.renderScale must be a positive number"),
            (is_("tiles") & blank(s + "sourceId"), "image.source.sourceId must be a non-empty string"),
            (is_("tiles") & ~F.coalesce(F.size(c(s + "boundary")) >= 3, F.lit(False)), "image.source.boundary must contain at least three coordinates"),
            (is_("tiles") & ~F.coalesce(c(s + "tileCount") >= 1, F.lit(False)), "image.source.tileCount must be a positive integer"),
        ]
    out = broken(maps, F.lit("image"), map_rules)
    half = c("lat").isNull() != c("lon").isNull()
    unreal = c("lat").isNotNull() & c("lon").isNotNull() & ~finite(c("lat"), c("lon"))
    anchor_rules = [
        (~finite(c("x"), c("y")), "px must be a finite [x, y] pair"),
        (half | unreal, "ll must be null or a finite [lat, lon] pair"),
    ]
    if "source" in anchors.columns:
        anchor_rules.append((~c("source").isin("paste", "basemap"), "source must be 'paste' or 'basemap'"))
    out = out.unionByName(broken(anchors, F.concat(F.lit("anchor/"), c("anchor_id").cast("string")), anchor_rules))
    facts = features.join(ring_facts(v), KEYS, "left").join(
        v.groupBy(*KEYS).agg(F.max(~finite(c("x"), c("y"))).alias("_unreal")), KEYS, "left"
    ).withColumn("n", F.coalesce("n", F.lit(0)))
    trail, loop = c("kind") == "trail", (c("kind") == "trail") & F.coalesce(c("route_kind") == "loop", F.lit(False))
    no = F.lit(False)
    feature_rules = [
        (~F.coalesce(c("kind").isin("trail", "area", "poi"), no), F.concat(F.lit('unknown kind "'), F.coalesce("kind", F.lit("")), F.lit('"'))),
        (trail & (c("n") < 2), "pts must contain at least 2 points"),
        ((c("kind") == "area") & (c("n") < 3), "pts must contain at least 3 points"),
        (F.coalesce("_unreal", no), "pts must be finite [x, y] pairs"),
        ((c("kind") == "poi") & ~F.coalesce(c("poi_type").isin(*[s[0] for s in POI_SYMBOLS]), no), "poiType must be one of the known kinds"),
        (trail & F.coalesce(c("route_kind") == "one-way", no) & F.coalesce("touching", no), "has one-way route but is closed or degenerate"),
        (loop & ~F.coalesce(c("route_direction").isin("clockwise", "counterclockwise"), no), "route.direction must be 'clockwise' or 'counterclockwise'"),
        (loop & ~F.coalesce("closed", no), "loop must be closed with at least 3 distinct vertices"),
        (loop & F.coalesce("closed", no) & c("winding").isNull(), "loop must have non-zero signed area"),
        (loop & F.coalesce("closed", no) & F.coalesce(c("winding") != c("route_direction"), no), "loop direction does not match geometry winding"),
        (trail & F.coalesce(~c("route_kind").isin("one-way", "loop"), no), F.concat(F.lit('unknown route.kind "'), F.coalesce("route_kind", F.lit("")), F.lit('"'))),
    ]
    return out.unionByName(broken(facts, F.concat(F.lit("feature/"), c("feature_id").cast("string")), feature_rules))
