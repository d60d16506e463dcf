"""Candidates under review: naming, ranking, merging across colours, acceptance, ink fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.constants import CONFIDENCE_HIGH, CONFIDENCE_MEDIUM, DEFAULT_COLORS
from cairnfield.functions.color import color_distance, feature_color_for_ink
from cairnfield.functions.geo import round_half_up
from cairnfield.operators.graph import connected_components, greedy_match
from cairnfield.operators.grid import point_cells, point_cells_around
from cairnfield.operators.lines import end_directions, stations
from cairnfield.operators.ordered import number_rows, with_next
from cairnfield.operators.pixels import pixel_at, upper_median
from cairnfield.operators.simplify import renumber
from cairnfield.operators.topology import assemble_chains, chain_vertices
from cairnfield.session import cut

CAND = ["map_id", "candidate_id"]


def review(cands: DataFrame) -> DataFrame:
    """Add the pre-selection flag and the confidence band."""
    f = F.col("confidence")
    band = F.when(f >= CONFIDENCE_HIGH, "High").when(f >= CONFIDENCE_MEDIUM, "Medium").when(f.isNotNull(), "Low")
    return cands.withColumn("selected", f.isNull() | (f >= CONFIDENCE_MEDIUM)).withColumn("band", band)


def rank_candidates(cands: DataFrame) -> DataFrame:
    """Review position per map: most confident first, unscored last, found order on ties."""
    return number_rows(cands, ["map_id"], [F.col("confidence").desc_nulls_last(), F.col("seq")], "position")


def name_candidates(cands: DataFrame, chips: DataFrame) -> DataFrame:
    """Names by chip and found order: "Red trail 2", or "Loop (part 2)" for named chips."""
    c = F.col
    on = ["map_id", "chip_id"]
    numbered = number_rows(cands, on, [c("seq")], "_k")
    total = cands.groupBy(*on).agg(F.count("*").alias("_n"))
    rows = numbered.join(total, on).join(chips.select(*on, c("name").alias("_chip"), "named"), on, "left")
    k = c("_k").cast("string")
    base = F.when(c("named"), c("_chip")).otherwise(F.concat(c("_chip"), F.lit(" trail")))
    many = F.when(c("named"), F.concat(base, F.lit(" (part "), k, F.lit(")"))).otherwise(F.concat(base, F.lit(" "), k))
    name = F.when(c("_chip").isNull(), "Trail").when(c("_n") == 1, base).otherwise(many)
    return rows.withColumn("name", name).drop("_k", "_n", "_chip", "named")


def continuation_links(cands: DataFrame, v: DataFrame, gap: float) -> DataFrame:
    """Ends of different candidates within ``gap`` that run on into each other, with a same-colour flag."""
    c = F.col
    ends = end_directions(v, CAND).join(cands.select(*CAND, "chip_id"), CAND)
    size = max(gap, 1e-9)
    right = point_cells(ends.select("map_id", *[c(n).alias(f"q_{n}") for n in ("candidate_id", "side", "x", "y", "dx", "dy", "chip_id")]), size, "q_x", "q_y")
    met = point_cells_around(ends, size).join(right, ["map_id", "_cx", "_cy"]).where("candidate_id < q_candidate_id")
    met = met.withColumn("distance", F.hypot(c("x") - c("q_x"), c("y") - c("q_y")))
    met = met.where((c("distance") <= gap) & (c("dx") * c("q_dx") + c("dy") * c("q_dy") < -0.7))
    return met.select(
        "map_id", c("candidate_id").alias("a_id"), c("side").alias("a_side"), c("q_candidate_id").alias("b_id"), c("q_side").alias("b_side"), "distance",
        (c("chip_id") == c("q_chip_id")).alias("same_chip"),
    )


def match_links(links: DataFrame) -> DataFrame:
    """Greedy matching by (distance, ids) that uses each port once and closes no ring.

    Without the ring rule, rounds of mutual first choices equal the sequential walk. The first ring
    in order is where the walk would refuse its last link; that link is banned and the matching is
    repeated until no ring is left.
    """
    c = F.col
    port = lambda s: F.struct("map_id", c(f"{s}_id").alias("id"), c(f"{s}_side").alias("side"))
    rest = cut(links.select("map_id", "a_id", "a_side", "b_id", "b_side", "distance").withColumn("a", port("a")).withColumn("b", port("b")))
    while True:
        got = cut(greedy_match(rest, ["distance", "a_id", "a_side", "b_id", "b_side"]))
        node = lambda s: F.struct("map_id", c(f"{s}_id").alias("id"))
        groups = connected_components(got.select(node("a").alias("a"), node("b").alias("b")))
        sizes = groups.groupBy("root").agg(F.count("*").alias("_n"))
        tagged = got.withColumn("id", node("a")).join(groups, "id").withColumn("_o", F.struct("distance", "a_id", "a_side", "b_id", "b_side"))
        worst = tagged.groupBy("root").agg(F.count("*").alias("_l"), F.max("_o").alias("_w")).join(sizes, "root").where("_l >= _n")
        first = cut(worst.groupBy(c("root.map_id").alias("map_id")).agg(F.min("_w").alias("w")))
        if first.isEmpty():
            return got.select("map_id", "a_id", "a_side", "b_id", "b_side", "distance")
        ban = first.select("map_id", "w.a_id", "w.a_side", "w.b_id", "w.b_side")
        rest = cut(rest.join(ban, ["map_id", "a_id", "a_side", "b_id", "b_side"], "left_anti"))


def merge_attrs(parts: DataFrame) -> DataFrame:
    """Attributes of merged candidates from their parts (map_id, chain_id, pos, candidate columns).

    The longest part leads. Other chips are kept in chain order; a map has few chips, so first
    positions per chip are a short list.
    """
    c = F.col
    on = ["map_id", "chain_id"]
    lead = F.struct((-c("length_px")).alias("l"), "candidate_id", "chip_id")
    agg = parts.groupBy(*on).agg(
        F.min(lead).alias("_p"), F.sum("length_px").alias("length_px"), F.count_if(c("confidence").isNull()).alias("_null"),
        F.sum(c("confidence") * c("length_px")).alias("_w"),
    )
    chips = parts.groupBy(*on, "chip_id").agg(F.min("pos").alias("_at")).join(agg.select(*on, c("_p.chip_id").alias("_own")), on).where("chip_id <> _own")
    also = chips.groupBy(*on).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "chip_id"))), lambda s: s["chip_id"]).alias("also_chips"))
    score = F.when(c("_null") == 0, c("_w") / F.greatest(c("length_px"), F.lit(2.220446049250313e-16)))
    empty = F.array().cast(dict(also.dtypes)["also_chips"])
    return agg.join(also, on, "left").select(
        *on, c("_p.candidate_id").alias("candidate_id"), c("_p.chip_id").alias("chip_id"), "length_px", score.alias("confidence"), F.coalesce("also_chips", empty).alias("also_chips")
    )


def merge_cross_color(cands: DataFrame, v: DataFrame, gap: float) -> dict[str, DataFrame]:
    """Join candidates of different colours that continue each other; unmerged ones pass through."""
    c = F.col
    links = cut(continuation_links(cands, v, gap))
    taken = links.where("same_chip")
    ports = taken.select("map_id", c("a_id").alias("id"), c("a_side").alias("side")).unionByName(taken.select("map_id", c("b_id").alias("id"), c("b_side").alias("side"))).distinct()
    free = links.where("not same_chip")
    for s in ("a", "b"):
        free = free.join(ports.select("map_id", c("id").alias(f"{s}_id"), c("side").alias(f"{s}_side")), ["map_id", f"{s}_id", f"{s}_side"], "left_anti")
    flat = v.select("map_id", c("candidate_id").alias("feature_id"), "idx", "x", "y")
    chains = cut(assemble_chains(flat, match_links(free)))
    joined = chain_vertices(flat, chains, drop_first=False).withColumnRenamed("feature_id", "chain_id")
    # Equal neighbours are one point.
    back = with_next(joined, ["map_id", "chain_id"], {"x": "_px", "y": "_py"}, back=True)
    from cairnfield.operators.simplify import renumber

    joined = renumber(back.where("_px is null or x <> _px or y <> _py").drop("_px", "_py"), ["map_id", "chain_id"])
    parts = cands.join(chains.withColumnRenamed("feature_id", "candidate_id"), CAND)
    merged = cut(merge_attrs(parts))
    alone = cands.join(chains.select("map_id", c("feature_id").alias("candidate_id")), CAND, "left_anti")
    empty = F.array().cast(dict(merged.dtypes)["also_chips"])
    out = merged.drop("chain_id").unionByName(alone.select(*CAND, "chip_id", "length_px", "confidence", empty.alias("also_chips")))
    lines = joined.join(merged.select("map_id", "chain_id", "candidate_id"), ["map_id", "chain_id"]).select(*CAND, "idx", "x", "y")
    return {"candidates": out, "vertices": lines.unionByName(v.join(alone.select(*CAND), CAND, "left_semi").select(*CAND, "idx", "x", "y"))}


def accept(cands: DataFrame, chips: DataFrame) -> DataFrame:
    """Selected candidates as trail features, noting the other colours they follow."""
    c = F.col
    picked = cands.where("selected")
    rows = picked.join(chips.select("map_id", "chip_id", "r", "g", "b"), ["map_id", "chip_id"], "left")
    others = picked.select(*CAND, F.posexplode("also_chips").alias("_i", "chip_id")).join(chips.select("map_id", "chip_id", c("name").alias("_name")), ["map_id", "chip_id"]).where("_name <> ''")
    # A candidate lists each of its map's few chips at most once.
    text = others.groupBy(*CAND).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_name"))), lambda s: s["_name"]), ", ").alias("_also"))
    notes = F.coalesce(F.concat(F.lit("Also follows: "), c("_also"), F.lit(".")), F.lit(""))
    return rows.join(text, CAND, "left").select(
        "map_id", c("candidate_id").alias("feature_id"), F.lit("trail").alias("kind"), "name",
        feature_color_for_ink(c("r"), c("g"), c("b"), F.lit(DEFAULT_COLORS["trail"])).alias("color"), notes.alias("notes"), F.array("r", "g", "b").alias("ink"),
    )


def corridor_px(meters_per_pixel: float | None, least: float = 0.0, most: float = float("inf")) -> float:
    return 12.0 if not meters_per_pixel else max(least, min(most, 4.0 / meters_per_pixel))


LINE = ["map_id", "feature_id"]


def line_ink(v: DataFrame, px: DataFrame, maps: DataFrame, corridor: int, tolerance: float) -> DataFrame:
    """Ink under each line: the median centre colour when it stands out from both flanks, else the
    colour that most stations find across the line."""
    c = F.col
    two = stations(v.select(*LINE, "idx", "x", "y"), 2.0).where("not pinned or d = 0 or d is not null")
    two = two.withColumn("k", (c("d") / 2)).where("k = floor(k)").select(*LINE, c("k").cast("bigint").alias("idx"), "x", "y")
    around = with_next(two, LINE, {"x": "_nx", "y": "_ny"})
    around = with_next(around, LINE, {"x": "_px", "y": "_py"}, back=True).where("idx % 2 = 0")
    dx, dy = F.coalesce("_nx", "x") - F.coalesce("_px", "x"), F.coalesce("_ny", "y") - F.coalesce("_py", "y")
    norm = F.hypot(dx, dy)
    norm = F.when(norm == 0, 1.0).otherwise(norm)
    st = around.select(*LINE, "idx", "x", "y", (-dy / norm).alias("nx"), (dx / norm).alias("ny"))
    look = st.withColumn("o", F.explode(F.sequence(F.lit(-corridor), F.lit(corridor)))).select(
        *LINE, "idx", "o", (c("x") + c("nx") * c("o")).alias("x"), (c("y") + c("ny") * c("o")).alias("y")
    )
    seen = cut(pixel_at(look, px, maps).select(*LINE, "idx", "o", "r", "g", "b"))
    flank = lambda o, p: seen.where(c("o") == o).select(*LINE, "idx", *[c(k).alias(f"{p}{k}") for k in "rgb"])
    flanks = cut(flank(-corridor, "l").join(flank(corridor, "q"), [*LINE, "idx"]))
    # The upper median of two values is the greater one.
    back = upper_median(flanks.select(*LINE, *[F.greatest(f"l{k}", f"q{k}").alias(k) for k in "rgb"]), LINE, ["r", "g", "b"])
    centre = upper_median(seen.where("o = 0"), LINE, ["r", "g", "b"])
    rows = seen.join(flanks, [*LINE, "idx"])
    contrast = F.least(*[color_distance(c("r"), c("g"), c("b"), c(f"{p}r"), c(f"{p}g"), c(f"{p}b")) for p in "lq"])
    best = rows.withColumn("_c", contrast).where(c("_c") > tolerance).groupBy(*LINE, "idx").agg(F.min(F.struct((-c("_c")).alias("c"), "o", "r", "g", "b")).alias("w"))
    bins = F.struct(*[F.shiftright(c(f"w.{k}").cast("int"), 4).alias(k) for k in "rgb"])
    votes = best.groupBy(*LINE, bins.alias("bin")).agg(F.count("*").alias("n"), F.min("idx").alias("first"), *[F.avg(f"w.{k}").alias(k) for k in "rgb"])
    top = votes.groupBy(*LINE).agg(F.min(F.struct((-c("n")).alias("o"), "first", "n", "r", "g", "b")).alias("v"))
    total = st.groupBy(*LINE).agg(F.count("*").alias("stations"))
    out = total.join(centre, LINE).join(back.select(*LINE, *[c(k).alias(f"f{k}") for k in "rgb"]), LINE).join(top, LINE, "left")
    clear = color_distance(c("r"), c("g"), c("b"), c("fr"), c("fg"), c("fb")) > tolerance
    mean = {k: round_half_up(c(f"v.{k}")) for k in "rgb"}
    strong = (c("v.n") / c("stations") >= 0.5) & (color_distance(mean["r"], mean["g"], mean["b"], c("fr"), c("fg"), c("fb")) > tolerance)
    pick = lambda k: F.when(clear, c(k)).when(F.coalesce(strong, F.lit(False)), mean[k]).cast("int")
    return out.select(*LINE, "stations", pick("r").alias("ink_r"), pick("g").alias("ink_g"), pick("b").alias("ink_b"))


def moved_stations(v: DataFrame, px: DataFrame, inks: DataFrame, corridor: float, tolerance: float, pinned: DataFrame | None = None) -> DataFrame:
    """Stations every 60 pixels, numbered, moved to the best ink pixel in the corridor; ends and pinned ones stay.

    Stored. The best pixel is the one whose colour, with a price for its distance, is nearest to the
    line's ink, and only one that is within ``tolerance`` moves a station.
    """
    c = F.col
    st = cut(number_rows(stations(v.select(*LINE, "idx", "x", "y"), 60.0, pinned), LINE, [c("d")], "idx", start=0).join(inks, LINE))
    free = st.where("not pinned").select(*LINE, "idx", c("x").alias("sx"), c("y").alias("sy"), "ink_r", "ink_g", "ink_b")
    size = corridor + 1
    met = point_cells_around(free, size, "sx", "sy").join(point_cells(px, size), ["map_id", "_cx", "_cy"])
    boxed = (c("x") >= F.floor(c("sx") - corridor)) & (c("x") <= F.ceil(c("sx") + corridor)) & (c("y") >= F.floor(c("sy") - corridor)) & (c("y") <= F.ceil(c("sy") + corridor))
    tint = color_distance(c("r"), c("g"), c("b"), c("ink_r"), c("ink_g"), c("ink_b"))
    cost = tint + F.hypot(c("x") - c("sx"), c("y") - c("sy")) * (tolerance / max(1.0, corridor))
    best = met.where(boxed).withColumn("_c", cost).where(c("_c") <= tolerance).groupBy(*LINE, "idx").agg(F.min(F.struct("_c", "y", "x")).alias("b"))
    moved = st.join(best, [*LINE, "idx"], "left").withColumn("x", F.coalesce(c("b.x").cast("double"), "x")).withColumn("y", F.coalesce(c("b.y").cast("double"), "y"))
    return cut(moved.drop("b"))


def refine_lines(v: DataFrame, px: DataFrame, maps: DataFrame, inks: DataFrame, corridor: float, tolerance: float, pinned: DataFrame | None = None) -> DataFrame:
    """Stations every 60 pixels, moved to the best ink pixel in the corridor; ends and pinned ones stay.

    Each row also says whether the run that leads to it is supported: at least 60 % of its samples,
    taken every 10 pixels on the straight line between stations, match the ink.
    """
    c = F.col
    moved = moved_stations(v, px, inks, corridor, tolerance, pinned)
    runs = with_next(moved, LINE, {"x": "px0", "y": "py0"}, back=True).where("px0 is not null")
    n = F.greatest(F.lit(1), F.ceil(F.hypot(c("x") - c("px0"), c("y") - c("py0")) / 10))
    walk = runs.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), c("_n"))))
    t = c("_k") / c("_n")
    walk = walk.select(*LINE, "idx", "ink_r", "ink_g", "ink_b", (c("px0") + (c("x") - c("px0")) * t).alias("x"), (c("py0") + (c("y") - c("py0")) * t).alias("y"))
    match = color_distance(c("r"), c("g"), c("b"), c("ink_r"), c("ink_g"), c("ink_b")) <= tolerance
    share = pixel_at(walk, px, maps).groupBy(*LINE, "idx").agg(F.avg(match.cast("double")).alias("confidence"))
    return moved.select(*LINE, "idx", "d", "x", "y", "pinned").join(share, [*LINE, "idx"], "left").withColumn("refined", F.coalesce(c("confidence") >= 0.6, F.lit(False)))
