"""Iterative graph steps as joins: components, list ranking, greedy matching.

Every round is cut reliably and works on a smaller table than the one before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label every id that occurs in ``edges`` with the least id of its component.

    Each round hooks every id to its least neighbour, follows that pointer four steps, and contracts
    the edges, so paths shrink fourfold per round. Ids may be numbers, strings or structs. The
    result has columns (id, root). Hot roots only meet unique keys in joins, which AQE can split.
    """
    live = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    live = cut(live.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("m"))
        hook = hook.select(F.col("a").alias("id"), F.least("a", "m").alias("p"))
        hook = cut(hook)
        for _ in range(2):
            up = hook.select(F.col("id").alias("_u"), F.col("p").alias("_p"))
            hook = hook.join(up, F.col("p") == F.col("_u")).select("id", F.col("_p").alias("p"))
        hook = cut(hook)
        steps.append(hook)
        left = hook.select(F.col("id").alias("a"), F.col("p").alias("pa"))
        right = hook.select(F.col("id").alias("b"), F.col("p").alias("pb"))
        moved = live.join(left, "a").join(right, "b").where("pa <> pb")
        live = cut(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if not steps:
        return edges.select(F.col(a).alias("id"), F.col(a).alias("root")).limit(0)
    roots = steps[-1].select("id", F.col("p").alias("root"))
    for step in reversed(steps[:-1]):
        later = roots.select(F.col("id").alias("_i"), F.col("root").alias("_r"))
        roots = step.join(later, F.col("p") == F.col("_i"), "left").select(
            "id", F.coalesce("_r", "p").alias("root")
        )
    return roots


def list_rank(nodes: DataFrame, weight: str | None = None) -> DataFrame:
    """Rank linked lists by pointer doubling.

    ``nodes`` has (id, nxt) with ``nxt`` null at each list's end and no cycles. The result has
    (id, tail, rank): the last id of the list and the number of steps (or the summed ``weight``) to
    it. Takes ceil(log2(longest list)) rounds.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1).cast("bigint")
    zero = F.lit(0).cast("double" if weight else "bigint")
    state = nodes.select(
        "id",
        "nxt",
        F.coalesce("nxt", "id").alias("tail"),
        F.when(F.col("nxt").isNull(), zero).otherwise(w).alias("rank"),
    )
    state = cut(state)
    while not state.where("nxt is not null").limit(1).isEmpty():
        ahead = state.select(
            F.col("id").alias("_id"),
            F.col("nxt").alias("_nxt"),
            F.col("tail").alias("_tail"),
            F.col("rank").alias("_rank"),
        )
        state = cut(
            state.join(ahead, F.col("nxt") == F.col("_id"), "left").select(
                "id",
                F.col("_nxt").alias("nxt"),
                F.coalesce("_tail", "tail").alias("tail"),
                (F.col("rank") + F.coalesce("_rank", zero)).alias("rank"),
            )
        )
    return state.select("id", "tail", "rank")


def greedy_match(links: DataFrame, order: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """Links that a walk in ``order`` would keep when each port may be used once.

    Rounds of links that are the first choice of both their ports give the same set as the walk,
    because ``order`` (extended by the ports) is total.
    """
    cols = links.columns
    rest = cut(links.where(F.col(a) != F.col(b)))
    kept: DataFrame | None = None
    rank: Column = F.struct(*[F.col(c) for c in order], F.col(a), F.col(b))
    while not rest.isEmpty():
        ranked = rest.withColumn("_o", rank)
        ports = ranked.select(F.col(a).alias("_p"), "_o").unionByName(ranked.select(F.col(b).alias("_p"), "_o"))
        best = ports.groupBy("_p").agg(F.min("_o").alias("_best"))
        first = best.select(F.col("_p").alias("_pa"), F.col("_best").alias("_ba"))
        second = best.select(F.col("_p").alias("_pb"), F.col("_best").alias("_bb"))
        chosen = cut(
            ranked.join(first, F.col(a) == F.col("_pa"))
            .where("_o = _ba")
            .join(second, F.col(b) == F.col("_pb"))
            .where("_o = _bb")
            .select(*cols)
        )
        kept = chosen if kept is None else kept.unionByName(chosen)
        used = chosen.select(F.col(a).alias("_p")).unionByName(chosen.select(F.col(b).alias("_p")))
        rest = cut(
            rest.join(used, F.col(a) == F.col("_p"), "left_anti").join(
                used, F.col(b) == F.col("_p"), "left_anti"
            )
        )
    return kept if kept is not None else links.limit(0)
