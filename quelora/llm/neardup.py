"""Near copies by the exact similarity of their shingle sets: the verification and the completion of SimHash links.

Two documents link if the Jaccard similarity of their sets of shingles is at least 4/5. SimHash proposes pairs whose
fingerprints differ in two bits at most (simhash.py). Fingerprints of similar sets differ in up to 14 of 64 bits,
though, for which deletion variants would be of eight bits and select nothing; so an exact join finds the rest. Similar
sets share at least one of the first n - ceil(4n/5) + 1 shingles of each in any order that is the same for all (prefix
filter), so documents meet by equality of those shingles and every link is found. The order puts shingles that are
frequent in a sample last. The sample decides how many pairs are verified, never which are linked.

A pair is verified in steps. Every set has sketches, one of 512 bits and one of about a bit for each shingle: the parity
of the shingles whose hash falls on the bit. Two sketches differ in at most as many bits as the sets in shingles, so a
pair whose sketches differ in more than a ninth of both sizes is not similar. The short sketches are compared where pairs
meet; only what passes both is read again and compared by its whole sets.

Copies never meet: equal sets are one node, named by a number of its own, from 128 bits of the set. At each shared
shingle all nodes are first compared with a pivot, the node of which the most shingles are shared: in a group of near
copies that is the text they are copies of. While links leave too many pairs of nodes in different components, further
rounds take other pivots, so a group of near copies takes a few rows a member. What is left is compared pair by pair.

Pairs meet only where the first shingle that they have in common may be: at places i and j of sets of n and m shingles
they share 1 + min(n - i, m - j) at most, which must be 4/9 of n + m. So of two sets of like size the shingle is among
the first ninth of both, and a passage that many texts quote joins only texts that are nearly all of it.

Defined results: texts without words are one node; a text of fewer words is one shingle; repeated rows are one entry;
of each component the row of least id (then of least hash of id and text) stays; other columns are carried, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quelora.llm import simhash
from quelora.llm.common import blocks, identity, in_filter, key_filter, map_batches, materialize, packed, release, unpacked
from quelora.llm.components import connected_components

SHINGLE = 5
#: Pairs to a row that are left to be compared one by one; else further rounds of so many pivots a shingle come first,
#: this many at most.
LEFT = 4
PIVOTS = 8
ROUNDS = 6
#: Longs of a short sketch, and their columns.
SHORT = 8
SKETCH = [f"s{k}" for k in range(SHORT)]
#: Documents of the sample that orders the shingles, about; how often a shingle stands in it to go last, and how many do.
SAMPLE = 5_000
FREQUENT = 3
MOST = 1 << 16


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    return np.unique(simhash.shingle_hashes(text, size))


def prefix(shingles: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of which a set of similarity 4/5 or more has one as well, first in the order: those that aren't
    frequent (ascending) by their hash, then the others by rank."""
    n = len(shingles)
    if len(frequent) and n:
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        last = frequent[at] == shingles
        shingles = np.concatenate((shingles[~last], shingles[last][np.argsort(rank[at[last]])]))
    return shingles[: n - -(-4 * n // 5) + 1]


def sketch(shingles: np.ndarray) -> bytes:
    """Parities of the shingles on 64 bits or the next power of two of their number."""
    bits = 1 << max(6, (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def short_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the shingles on 512 bits, as SHORT signed longs."""
    odd = np.bincount((shingles & np.uint64(64 * SHORT - 1)).astype(np.int64), minlength=64 * SHORT) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def sketch_distance(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ; the longer is folded to the shorter, which keeps parities."""
    x, y = sorted((x, y), key=len)
    wide, bits = int.from_bytes(y, "big"), 8 * len(y)
    while bits > 8 * len(x):
        bits //= 2
        wide = (wide >> bits) ^ (wide & (1 << bits) - 1)
    return (wide ^ int.from_bytes(x, "big")).bit_count()


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    values = np.concatenate([np.zeros(0, np.uint64), *sets]).astype(np.uint64).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _frequent(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (ascending) that are frequent in the sample, and their ranks, the most frequent last."""
    every = max(1, rows.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([_lists([shingle_set(t, size) for t in batch.column("text").to_pylist()])], ["shingles"])

    sample = map_batches(rows.where(F.pmod("a", F.lit(every)) == 0).select("text"), run, "shingles array<long>")
    counts = sample.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    found = counts.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "s").limit(MOST).collect()
    shingles = np.array([r.s for r in found], dtype=np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], (len(found) - np.arange(len(found)))[order]


def _entries(rows: DataFrame, size: int) -> DataFrame:
    """(id, a, b, x, y, n, fp, short sketch, sketch, prefix) of each row: x and y name its set, n is the set's size."""
    shared = rows.sparkSession.sparkContext.broadcast(_frequent(rows, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 1 << 20):
            hashes = [simhash.shingle_hashes(t, size) for t in batch.column("text").to_pylist()]
            sets = [np.unique(h) for h in hashes]
            names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), dtype="<i8").reshape(-1, 2)
            fps = np.array([simhash.fingerprint(h) for h in hashes], dtype=np.uint64).view(np.int64)
            short = np.stack([short_sketch(s) for s in sets])
            found = [
                pa.array(names[:, 0].copy()),
                pa.array(names[:, 1].copy()),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.array(fps),
                *(pa.array(short[:, k].copy()) for k in range(SHORT)),
                pa.array([sketch(s) for s in sets], pa.binary()),
                _lists([prefix(s, *shared.value) for s in sets]),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "a", "b")), *found], ["id", "a", "b", "x", "y", "n", "fp", *SKETCH, "sketch", "prefix"])

    short_kinds = ", ".join(f"{c} long" for c in SKETCH)
    return materialize(map_batches(rows, run, f"id long, a long, b long, x long, y long, n int, fp long, {short_kinds}, sketch binary, prefix array<long>"), "near-entries")


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (p, q) of nodes whose sketches allow that they are similar."""
    of = lambda p: nodes.select(F.col("node").alias(p), *(F.col(c).alias(f"{c}_{p}") for c in ("n", "sketch")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("n_p").to_numpy().astype(np.int64) + batch.column("n_q").to_numpy()
            apart = np.array(list(map(sketch_distance, batch.column("sketch_p").to_pylist(), batch.column("sketch_q").to_pylist())), dtype=np.int64)
            yield batch.filter(pa.array(9 * apart <= size)).select(["p", "q"])

    # sets whose sizes differ more can't be similar
    both = pairs.join(of("p"), "p").join(of("q"), "q").where("5L * n_p >= 4L * n_q AND 5L * n_q >= 4L * n_p")
    return materialize(map_batches(both, run, "p long, q long"), "near-possible")


def _sets(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the wanted (node, a, b); texts of no candidate don't move."""
    bound = rows.sparkSession.sparkContext.broadcast(key_filter(wanted, "a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 1 << 20):
            batch = batch.filter(pa.array(in_filter(bound.value, batch.column("a").to_numpy())))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), _lists([shingle_set(t, size) for t in batch.column("text").to_pylist()])], ["a", "b", "shingles"])

    found = map_batches(rows.select("a", "b", "text"), run, "a long, b long, shingles array<long>")
    return materialize(found.join(wanted, ["a", "b"]).select("node", "shingles").dropDuplicates(["node"]), "near-sets")


def _similar(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """The pairs (p, q) of nodes whose sets are similar."""
    pairs = _possible(pairs, nodes)
    ends = pairs.select(F.col("p").alias("node")).union(pairs.select("q")).distinct()
    wanted = materialize(nodes.join(ends, "node").select("node", "a", "b"), "near-wanted")
    sets = _sets(rows, wanted, size)
    left = sets.select(F.col("node").alias("p"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("q"), F.col("shingles").alias("right"))
    both = F.size(F.array_intersect("left", "right")).cast("long")
    similar = 9 * both >= 4 * (F.size("left").cast("long") + F.size("right"))
    edges = materialize(pairs.join(left, "p").join(right, "q").where(similar).select(F.col("p").alias("a"), F.col("q").alias("b")), "near-edges")
    release(pairs, wanted, sets)
    return edges


def _proposed(nodes: DataFrame) -> DataFrame:
    """Pairs (p, q) of nodes by SimHash: of one fingerprint with its least node, and the least nodes of linked ones."""
    least = materialize(nodes.groupBy("fp").agg(F.min("node").alias("q"), F.max("node").alias("hi")), "near-fingerprints")
    same = nodes.select("node", "fp").join(least.where("q < hi"), "fp").where("node > q").select(F.col("node").alias("p"), "q")
    of = lambda end, name: least.select(F.col("fp").alias(end), F.col("q").alias(name))
    linked = simhash.links(least.select("fp")).join(of("a", "p"), "a").join(of("b", "q"), "b").select("p", "q")
    return same.unionByName(linked)


def _meetings(nodes: DataFrame) -> DataFrame:
    """(key, node, n, i, low, short sketch, share) for each shingle that several nodes have in their prefixes, i its place there: low is
    whether a set of no more shingles may share it first, which one of a pair must; share is the part of the node's
    prefix that is shared."""
    at = nodes.select("node", "n", F.size("prefix").alias("size"), F.posexplode("prefix").alias("i", "key")).withColumn("i", F.col("i") + 1)
    at = at.withColumn("low", F.expr("9L * (1 + n - i) >= 8L * n"))
    several = at.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.max("low").alias("low")).where("lo < hi AND low").select("key")
    met = materialize(at.join(several, "key"), "near-met")
    shares = met.groupBy("node").agg(F.count("*").alias("shared")).join(nodes.select("node", *SKETCH), "node")
    out = materialize(met.join(shares, "node").select("key", "node", "n", "i", "low", *SKETCH, (F.col("shared") / F.col("size")).cast("float").alias("share")), "near-shared")
    release(met)
    return out


def _pivot(*more: str) -> Column:
    return F.struct(F.col("node").alias("q"), F.col("n").alias("m"), F.col("i").alias("j"), *(F.col(c).alias(f"other_{c}") for c in SKETCH), *(F.col(c).alias(f"other_{c}") for c in more))


def _pairs(left: DataFrame, right: DataFrame, which: str) -> DataFrame:
    """The distinct pairs (p, q), p above q, of nodes that meet at a key and may be similar with it as their first."""
    apart = " + ".join(f"bit_count({c} ^ other_{c})" for c in SKETCH)
    met = left.join(right, "key").where(f"{which} AND 9L * (1 + least(n - i, m - j)) >= 4L * (n + m) AND 9L * ({apart}) <= n + m")
    return met.select(F.greatest("node", "q").alias("p"), F.least("node", "q").alias("q")).distinct()


def _mixed(shared: DataFrame, parts: DataFrame, name: str) -> tuple[DataFrame, int, int]:
    """(key, node, n, i, low, short sketch, part) of the shingles whose nodes are in several components, how many rows these are, and
    how many pairs they have at most."""
    of_part = shared.join(parts, "node", "left").select("key", "node", "n", "i", "low", *SKETCH, F.coalesce("part", "node").alias("part"))
    of_key = of_part.groupBy("key", "part").agg(F.count("*").cast("double").alias("c"), F.count_if("low").cast("double").alias("l")).groupBy("key")
    keys = of_key.agg(F.sum("c").alias("k"), (F.sum("c") * F.sum("l") - F.sum(F.col("c") * F.col("l"))).alias("apart"), F.count("*").alias("parts"))
    keys = materialize(keys.where("parts > 1 AND apart > 0").select("key", "k", "apart"), "near-mixed")
    total = keys.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("k", "apart"))).first()
    return materialize(of_part.join(keys.select("key"), "key"), name), int(total.k), int(total.apart)


def links(rows: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, part) of each node with a link, part the least node of its component."""
    shared = _meetings(nodes)
    pivots = shared.groupBy("key").agg(F.max_by(_pivot(), F.struct("share", "node")).alias("pivot")).select("key", "pivot.*")
    tried = materialize(_pairs(shared, pivots, "node <> q").unionByName(_proposed(nodes).select(F.greatest("p", "q").alias("p"), F.least("p", "q").alias("q"))).distinct(), "near-first")
    found = _similar(tried, rows, nodes, size)
    release(tried)
    parts = connected_components(found)
    mixed, many, pairs = _mixed(shared, parts, "near-parts")
    for step in range(ROUNDS):
        if pairs <= LEFT * many:
            break
        chosen = [F.min_by(_pivot("part"), F.xxhash64("node", F.lit(step * PIVOTS + k))) for k in range(PIVOTS)]
        pivots = mixed.groupBy("key").agg(F.array_distinct(F.array(*chosen)).alias("pivots")).select("key", F.inline("pivots"))
        found = materialize(found.unionByName(_similar(_pairs(mixed, pivots, "part <> other_part"), rows, nodes, size)), "near-edges")
        parts, last = connected_components(found), pairs
        mixed, many, pairs = _mixed(mixed.drop("part"), parts, "near-parts")
        if pairs > 0.9 * last:
            break
    # of two similar sets the smaller one, or either of equal ones, is low
    left_over = _pairs(mixed.where("low"), mixed.select("key", _pivot("part").alias("pivot")).select("key", "pivot.*"), "node <> q AND part <> other_part")
    more = _similar(left_over, rows, nodes, size)
    release(shared, mixed)
    return connected_components(found.unionByName(more))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """The row of least id (then of least hash of id and text) of each component, with all its columns."""
    a, b = identity(id_col, text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), a.alias("a"), b.alias("b"), F.col(f"`{text_col}`").cast("string").alias("text"))
    entries = _entries(rows, size)
    # the numbers are fixed when the table is written
    distinct = entries.select("x", "y", "a", "b", "n", "fp", *SKETCH, "sketch", "prefix").dropDuplicates(["x", "y"])
    nodes = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    named = materialize(entries.select("id", "a", "b", "x", "y").join(nodes.select("x", "y", "node"), ["x", "y"]).drop("x", "y"), "near-named")
    release(entries)
    parts = links(rows, nodes, size)
    first = named.join(parts, "node", "left").groupBy(F.coalesce("part", "node").alias("part")).agg(F.min(F.struct("id", "a", "b")).alias("first"))
    kept = materialize(first.select("first.a", "first.b"), "near-kept")
    release(nodes)
    # rows that repeat id and text have one identity, and one of them stays
    return unpacked(packed(docs, a=a, b=b).join(kept, ["a", "b"], "left_semi").dropDuplicates(["a", "b"]), docs.columns)
