"""Near-duplicate join by Jaccard similarity of word shingles: chosen-path splitting.

In each run every set starts at one root. A node's set picks each of its tokens with chance
1 / (similarity * size), by a hash of the run, the path so far and the token, and goes down one
branch for every picked token. Two sets as similar as asked share at least one picked token a level
in expectation, so they stay together with a chance that many runs bring up to the target recall.

Small buckets are compared by brute force on sketches. In a large one all sets meet its head: those
like it are linked to it, and those very near to it are done there, since whatever is like them is
like the head as well. The others are split further, and take part in more runs. What shares a
large bucket after three levels is taken as a whole.

What survives is only a candidate. Candidates form clusters, and inside each cluster the exact
similarity of all pairs is counted in blocks of bounded size, so no pair is written out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.llm.common import Texts, grams, mix, slices, small_batches
from cairnfield.operators.graph import connected_components
from cairnfield.session import cut

SHINGLE = 5
#: Similarity as a fraction, so that the exact test needs no rounding: shared * 5 >= 4 * union.
OVER, UNDER = 4, 5
LEVELS = 3
RECALL = 0.9999
#: Buckets up to this size are compared by brute force.
SMALL = 200
#: Numbers of a sketch; from LIKE on two sets are candidates (over four deviations below the
#: threshold), from NEAR on they are so near that one can stand for the other.
SKETCH, LIKE, NEAR = 64, 0.55, 0.92
#: Bytes of shingle hashes, and number of sets, of one block of a cluster.
BLOCK_BYTES, BLOCK_SETS = 4 << 20, 2000
#: Ids up to this number, counted beforehand, are sent to every task; beyond, texts are shuffled to them.
BROADCAST_ROWS = 500_000
PROFILE = "id long, n long, s long, sketch binary, paths array<long>"


def shingles(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in order, their text, and offsets. A text of one to four words is one shingle."""
    h, doc, n = t.word_hashes(), t.docs_of_words(), t.n_words
    g = grams(h, SHINGLE)
    ok = np.flatnonzero(doc[: len(g)] == doc[SHINGLE - 1 :]) if len(g) else np.zeros(0, np.int64)
    value, own = g[ok], doc[ok]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        extra = np.array([int(mix(np.array([np.bitwise_xor.reduce(mix(h[t.first[k] : t.first[k + 1]] + np.arange(n[k], dtype=np.uint64)))], np.uint64))[0]) for k in short], np.uint64)
        value, own = np.concatenate([value, extra]), np.concatenate([own, short])
    order = np.lexsort((value, own))
    value, own = value[order], own[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    value, own = value[new], own[new]
    return value, own, np.searchsorted(own, np.arange(len(n) + 1))


def fingerprint(own: np.ndarray) -> int:
    """A 64-bit sum that only depends on the set."""
    return int(mix(own).sum(dtype=np.uint64).view(np.int64))


def runs_needed(recall: float, similarity: float, levels: int) -> int:
    """Runs after which two sets of the given similarity have met in a deepest bucket with the given chance.

    They share a Poisson number of picked tokens a level, with mean one at least.
    """
    meet = 1.0
    for _ in range(levels):
        meet = 1 - math.exp(-meet)
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def roots(runs: range) -> np.ndarray:
    return mix(np.array(runs, np.uint64) + np.uint64(1))


def branches(own: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The nodes below ``nodes`` that a set goes to."""
    bar = np.uint64(min((1 << 64) - 1, int((1 << 64) / (OVER / UNDER * len(own)))))
    out = []
    for k in range(0, len(nodes), 16):
        some = nodes[k : k + 16]
        picked = mix(own[None] ^ some[:, None])
        node, token = np.nonzero(picked < bar)
        out.append(mix(picked[node, token] + some[node]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _profiles(runs: range):
    seeds = mix(np.arange(101, 101 + SKETCH, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                ids = part.column("id").to_pylist()
                value, _, at = shingles(Texts(part.column("body")))
                out = []
                for k, i in enumerate(ids):
                    own = value[at[k] : at[k + 1]]
                    if not len(own):
                        continue
                    low = np.full(SKETCH, np.uint64((1 << 64) - 1))
                    for b in range(0, len(own), 4096):
                        low = np.minimum(low, (own[None, b : b + 4096] * seeds[:, None] ^ (own[None, b : b + 4096] >> np.uint64(29))).min(1))
                    sketch = (mix(low) >> np.uint64(32)).astype(np.uint32)
                    out.append((i, len(own), fingerprint(own), sketch.tobytes(), branches(own, roots(runs)).view(np.int64)))
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names=[x.split()[0] for x in PROFILE.split(", ")])

    return run


def _deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Branches of sets below given nodes: (s, path) for rows (s, nodes, body)."""
    for batch in batches:
        for part in slices(batch, "body"):
            value, _, at = shingles(Texts(part.column("body")))
            s, path = [], []
            for k, (own_s, nodes) in enumerate(zip(part.column("s").to_pylist(), part.column("nodes").to_pylist(), strict=True)):
                own = value[at[k] : at[k + 1]]
                if len(own) and fingerprint(own) == own_s:
                    below = branches(own, np.array(nodes, np.int64).view(np.uint64)).view(np.int64)
                    s += [own_s] * len(below)
                    path += below.tolist()
            if s:
                yield pa.RecordBatch.from_pydict({"path": pa.array(path, pa.int64()), "s": pa.array(s, pa.int64())})


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join all sets of a bucket whose sketches agree, as few as join them."""
    least = int(SKETCH * LIKE)
    for batch in batches:
        a, b = [], []
        for members in batch.column("members").to_pylist():
            ids = np.array([m["s"] for m in members])
            s = np.frombuffer(b"".join(m["sketch"] for m in members), np.uint32).reshape(len(ids), -1)
            root = np.arange(len(ids))
            for i in range(1, len(ids)):
                near = np.flatnonzero((s[:i] == s[i]).sum(1) >= least)
                groups = np.unique(root[near])
                if len(groups):
                    a += [int(ids[g]) for g in groups]
                    b += [int(ids[i])] * len(groups)
                    root[np.isin(root, groups)] = groups[0]
                    root[i] = groups[0]
        if a:
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _to_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How like its bucket's head each set is."""
    for batch in batches:
        own, head = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, SKETCH) for c in ("sketch", "lead"))
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("s"), batch.column("head"), pa.array((own == head).mean(1))], names=["path", "s", "head", "like"])


def _met(thin: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(thin) if rows <= BROADCAST_ROWS else thin


def candidate_links(sets: DataFrame, slim: DataFrame, first: range, more: range) -> DataFrame:
    """Links (a, b) between sets that met in a small bucket and look alike, or in a large one and are like its head.

    ``sets`` has (s, id, sketch, paths) with the branches of the ``first`` runs; only sets that large
    buckets leave over take part in the ``more`` runs, as they alone need them for the recall.
    """
    sketches = sets.select("s", "sketch")
    nodes, found = sets.select("s", F.explode("paths").alias("path")), []
    for level in range(1, LEVELS + 1):
        sizes = nodes.groupBy("path").agg(F.count("*").alias("size"), F.min("s").alias("head")).where("size > 1")
        # Most buckets hold one set; what is left is a fraction of the nodes.
        members = cut(nodes.join(sizes, "path"))
        # Bounded lists: SMALL members of some hundred bytes.
        lists = members.where(F.col("size") <= SMALL).join(sketches, "s").groupBy("path").agg(F.collect_list(F.struct("s", "sketch")).alias("members"))
        found.append(lists.select("members").mapInArrow(_compare, "a long, b long"))
        large = members.where(F.col("size") > SMALL)
        if large.isEmpty():
            break
        lead = large.select("path", "head").distinct().join(sketches.withColumnRenamed("s", "head"), "head").select("path", F.col("sketch").alias("lead"))
        seen = cut(large.join(sketches, "s").join(lead, "path").select("path", "s", "head", "sketch", "lead").mapInArrow(_to_head, "path long, s long, head long, like double"))
        # After the last level all of a bucket are candidates.
        found.append(seen.where(F.col("like") >= (LIKE if level < LEVELS else 0.0)).select(F.col("head").alias("a"), F.col("s").alias("b")))
        rest = cut(seen.where(F.col("like") < NEAR).groupBy("s").agg(F.collect_list("path").alias("nodes")))
        n = rest.count()
        if level == LEVELS or not n:
            break
        if level == 1:
            extra = F.array(*(F.lit(int(x)) for x in roots(more).view(np.int64)))
            rest = rest.withColumn("nodes", F.concat("nodes", extra))
        thin = sets.select("s", "id").join(rest, "s")
        nodes = cut(slim.join(_met(thin, n), "id").select("s", "nodes", "body").mapInArrow(_deeper, "path long, s long").distinct())
    links = found[0]
    for other in found[1:]:
        links = links.unionByName(other)
    return cut(links.where("a <> b").distinct())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "body"):
            value, _, at = shingles(Texts(part.column("body")))
            held = [value[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            # Of rows that repeat an id, only those with the set that counts.
            ok = pa.array([bool(len(x)) and fingerprint(x) == own for x, own in zip(held, part.column("s").to_pylist(), strict=True)])
            cols = [part.column(c) for c in ("s", "cluster", "blocks")] + [pa.array([x.tobytes() for x in held], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["s", "cluster", "blocks", "tokens"]).filter(ok)


def _count(rows: list[tuple[int, int, bytes]], i: int, j: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Of one pair of blocks: each set's number of links, and links enough to join all that are linked."""
    ids = np.array([r[0] for r in rows])
    block = np.array([r[1] for r in rows])
    sets = [np.frombuffer(r[2], np.uint64) for r in rows]
    n = np.array([len(s) for s in sets])
    who = np.repeat(np.arange(len(ids)), n)
    _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = often > 1
    number = np.cumsum(common) - 1
    keep = common[token]
    who, token = who[keep], number[token[keep]]
    left = np.flatnonzero(block == i)
    right = left if i == j else np.flatnonzero(block == j)
    shared = np.zeros((len(left), len(right)), np.float32)
    width = max(1, min(int(common.sum()), (16 << 20) // (4 * len(ids))))
    order = np.argsort(token, kind="stable")
    who, token = who[order], token[order]
    for lo in range(0, int(common.sum()), width):
        a, z = np.searchsorted(token, (lo, lo + width))
        m = np.zeros((len(ids), width), np.float32)
        m[who[a:z], token[a:z] - lo] = 1
        shared += m[left] @ m[right].T
    union = n[left][:, None] + n[right][None] - shared
    near = shared * UNDER >= OVER * union
    if i == j:
        np.fill_diagonal(near, False)
    links = np.zeros(len(ids), np.int64)
    links[left] += near.sum(1)
    if i != j:
        links[right] += near.sum(0)
    root, edges = np.arange(len(ids)), []
    for r in range(len(left)):
        for q in np.flatnonzero(near[r] & (root[right] != root[left[r]])):
            x, y = root[left[r]], root[right[q]]
            if x != y:
                edges.append((int(ids[left[r]]), int(ids[right[q]])))
                root[root == y] = x
    return ids, links, edges


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for members, i, j in zip(batch.column("members").to_pylist(), batch.column("i").to_pylist(), batch.column("j").to_pylist(), strict=True):
            rows = sorted({m["s"]: (m["s"], m["block"], m["tokens"]) for m in members}.values())
            if len(rows) < 2 or len({r[1] for r in rows}) < 1 + (i != j):
                continue
            ids, links, edges = _count(rows, i, j)
            some = np.flatnonzero(links)
            a = ids[some].tolist() + [x for x, _ in edges]
            b = [None] * len(some) + [y for _, y in edges]
            n = links[some].tolist() + [0] * len(edges)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})


def verified(slim: DataFrame, clusters: DataFrame) -> DataFrame:
    """Exact comparison inside clusters: rows (a, null, number of links) and links (a, b, 0) that join what is linked.

    ``slim`` has (id, body), ``clusters`` (s, id, n, cluster), where the document ``id`` holds the set
    ``s``. A cluster falls into blocks by a hash, and every two of its blocks meet in one place.
    """
    weight = clusters.groupBy("cluster").agg(F.greatest(F.ceil(8 * F.sum("n") / BLOCK_BYTES), F.ceil(F.count("*") / BLOCK_SETS)).cast("int").alias("blocks"))
    known = cut(clusters.join(weight, "cluster").select("id", "s", "cluster", "blocks"))
    held = slim.join(_met(known, known.count()), "id").select("s", "cluster", "blocks", "body").mapInArrow(_sets, "s long, cluster long, blocks int, tokens binary")
    own = F.pmod(F.xxhash64("s", F.lit(9)), F.col("blocks").cast("long")).cast("int")
    dealt = held.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = dealt.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.struct("s", "block", "tokens").alias("m"))
    # Bounded lists: two blocks' bytes.
    return pairs.groupBy("cluster", "i", "j").agg(F.collect_list("m").alias("members")).mapInArrow(_verify, "a long, b long, n long")


def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", recall: float = RECALL) -> DataFrame:
    """One row a distinct non-null doc_id: doc_id, class_id, same_id, n_same and n_links.

    Two texts are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or
    more; words are runs without ASCII blanks. ``same_id`` is the least id among documents with
    the same set, ``n_same`` their number, ``n_links`` the number of other sets linked to it, and
    ``class_id`` the least id of all that links join, directly or through others. A text of one to
    four words is one shingle; null and empty texts have none and stand alone. Of rows that repeat
    an id, the one with the least fingerprint of its set counts.
    """
    small_batches(docs.sparkSession)
    slim = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("body"))
    first = range(runs_needed(recall, OVER / UNDER, 1))
    more = range(len(first), runs_needed(recall, OVER / UNDER, LEVELS))
    profiles = cut(slim.mapInArrow(_profiles(first), PROFILE))
    one = profiles.groupBy("id").agg(F.min("s").alias("s"))
    # Equal sets are one from here on. Each task joins its own equal ones first, however many there are.
    sizes = one.groupBy("s").agg(F.min("id").alias("id"), F.count("*").alias("n_same"))
    alike = profiles.groupBy("s").agg(F.min(F.struct("id", "n", "sketch", "paths")).alias("x"))
    sets = cut(alike.join(sizes, "s").select("s", "id", "n_same", "x.n", "x.sketch", "x.paths"))
    clusters = connected_components(candidate_links(sets, slim, first, more)).select(F.col("id").alias("s"), F.col("root").alias("cluster"))
    checked = cut(verified(slim, clusters.join(sets.select("s", "id", "n"), "s")))
    joined = connected_components(checked.where("b is not null").select("a", "b")).select(F.col("id").alias("s"), "root")
    joined = cut(joined.join(sets.select("s", "id"), "s"))
    classes = joined.join(joined.groupBy("root").agg(F.min("id").alias("class_id")), "root").select("s", "class_id")
    links = checked.where("b is null").groupBy(F.col("a").alias("s")).agg(F.sum("n").alias("n_links"))
    info = sets.select("s", F.col("id").alias("same_id"), "n_same").join(classes, "s", "left").join(links, "s", "left")
    known = one.join(info, "s").select("id", F.coalesce("class_id", "same_id").alias("class_id"), "same_id", "n_same", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    every = slim.select("id").distinct().join(known, "id", "left")
    return every.select(
        F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("same_id", "id").alias("same_id"),
        F.coalesce("n_same", F.lit(1)).alias("n_same"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
