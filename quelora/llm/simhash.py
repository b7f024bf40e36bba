"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint links to those that differ in at most two bits. Cut into two segments of 32 bits, two linked
fingerprints have one segment that differs in at most one bit. So each distinct fingerprint is indexed, for each
segment, under the whole segment and under its 32 variants with one bit as a wildcard; fingerprints that share a
variant meet by equality and are verified by their Hamming distance.

Copies never meet: equal fingerprints are one entry. A variant that more than ``BUCKET`` distinct fingerprints share
isn't gathered; its members are cut again, over the bits that the variant leaves free, and so on. Each level about
halves the free bits, and from the fourth level on at most 64 values are left, so every bucket that is compared is
bounded and no link is lost. A bucket yields a star for each of its connected parts, not its pairs: as many rows as
members. Components then come from alternating large-star and small-star steps on tables in the shared folder.

Defined results: a null text, or one without words, has the fingerprint zero and links like any other; repeated
rows each get a result; a null doc_id never names a component unless all its ids are null; columns other than id and
text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quelora.llm.common import blocks, map_batches, materialize, space_words
from quelora.llm.components import connected_components

SHINGLE = 3
SEED = 42
BITS = 64
DISTANCE = 2
#: Distinct fingerprints that are compared in one bucket; larger buckets are cut again. At least 64, below which a cut
#: may leave a bucket as it is.
BUCKET = 2048
#: Fingerprints that one task indexes, and the most tasks.
TASK_ROWS = 16_384
TASKS = 100_000

_POP = np.array([bin(k).count("1") for k in range(1 << 16)], dtype=np.uint8)


def popcount(x: np.ndarray) -> np.ndarray:
    """Set bits of unsigned 64-bit integers."""
    return _POP[np.ascontiguousarray(x).view(np.uint16).reshape(*x.shape, 4)].sum(axis=-1, dtype=np.uint8)


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of ``size`` words, joined by a space; of the whole sequence if there are fewer."""
    words = space_words(text, lower=True)
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), SEED)], dtype=np.uint64)
    runs = zip(*(words[k:] for k in range(size)), strict=False)
    return np.fromiter((digest(b" ".join(r), SEED) for r in runs), dtype=np.uint64, count=len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit set where over half of the hashes have it; zero without hashes."""
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big") if len(hashes) else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """id and fp (the fingerprint's bits as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            found = [fingerprint(shingle_hashes(t, size)) for t in batch.column("text").to_pylist()]
            fps = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps)], ["id", "fp"])

    key, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    return map_batches(docs.select(key.alias("id"), text.alias("text")), run, "id long, fp long")


def _halves(free: list[int]) -> tuple[list[int], list[int]]:
    return free[: len(free) // 2], free[len(free) // 2 :]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def _variants(free: list[int]) -> list[tuple[int, int, list[int]]]:
    """(fixed bits, wildcard bit or -1, bits left free) of each variant of the two segments of the free bits."""
    out = []
    for own, other in (_halves(free), _halves(free)[::-1]):
        out.append((_mask(own), -1, other))
        out += [(_mask([b for b in own if b != w]), w, [*other, w]) for w in own]
    return out


def _signatures(fps: DataFrame) -> DataFrame:
    """A row for each fingerprint and variant of its 64 bits: key, free (the bits that the variant leaves free), bit
    (the wildcard bit's value; null without one), fp."""
    rows = [
        F.struct(
            F.lit(_mask(rest)).cast("long").alias("free"),
            F.lit(mask).cast("long").alias("mask"),
            F.col("fp").bitwiseAND(F.lit(mask)).alias("value"),
            (F.shiftrightunsigned("fp", wild).bitwiseAND(F.lit(1)).cast("byte") if wild >= 0 else F.lit(None).cast("byte")).alias("bit"),
        )
        for mask, wild, rest in _variants(list(range(BITS)))
    ]
    out = fps.select("fp", F.explode(F.array(*rows)).alias("s"))
    return out.select(F.xxhash64("s.mask", "s.value").alias("key"), "s.free", "s.bit", "fp")


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit integers over all values, one to one."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _cut_again(members: DataFrame) -> DataFrame:
    """The signature rows of the members (key, free, fp) of large buckets: variants of the bits that their key leaves
    free, under that key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, free, fps = (batch.column(c).to_numpy().view(np.uint64) for c in ("key", "free", "fp"))
            for mask in np.unique(free):
                at = free == mask
                fp, under = fps[at], _mix(bucket[at])
                bits = [b for b in range(BITS) if int(mask) >> b & 1]
                for own, wild, rest in _variants(bits):
                    key = _mix(under ^ _mix((fp & np.uint64(own & (1 << 64) - 1)) ^ _mix(np.uint64([(own ^ wild) & (1 << 64) - 1]))))
                    bit = pa.nulls(len(fp), pa.int8()) if wild < 0 else pa.array(((fp >> np.uint64(wild)) & np.uint64(1)).astype(np.int8))
                    left = np.full(len(fp), _mask(rest), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(left), bit, pa.array(fp.view(np.int64))], ["key", "free", "bit", "fp"])

    return map_batches(members.select("key", "free", "fp"), run, "key long, free long, bit byte, fp long")


def _shared(signatures: DataFrame) -> DataFrame:
    """The signatures whose key holds several fingerprints: with a wildcard, both of the bit's values."""
    keys = signatures.groupBy("key").agg(F.count("*").alias("n"), F.min("bit").alias("lo"), F.max("bit").alias("hi"))
    several = materialize(keys.where("n > 1 AND (lo IS NULL OR lo < hi)").select("key", "n"), "simhash-keys")
    return materialize(signatures.join(several, "key"), "simhash-buckets")


def _stars(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member of its connected part) for the members of a bucket that have a link."""
    found = [np.nonzero(popcount(fps[k : k + 256, None] ^ fps[None, :]) <= DISTANCE) for k in range(0, len(fps), 256)]
    left = np.concatenate([x + 256 * k for k, (x, _) in enumerate(found)])
    right = np.concatenate([y for _, y in found])
    root = np.arange(len(fps))
    while True:  # hooks each member to the least root among its neighbours, then shortens the paths
        least = root.copy()
        np.minimum.at(least, left, root[right])
        least = least[least]
        if (least == root).all():
            break
        root = least
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return fps[linked], fps[root[linked]]


def _link(rows: DataFrame) -> DataFrame:
    """Star edges (a, b) between distinct fingerprints of bounded buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found_a, found_b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            members = batch.column("fps")
            values = members.values.to_numpy(zero_copy_only=False).view(np.uint64)
            ends = members.offsets.to_numpy()
            two = np.flatnonzero(np.diff(ends) == 2)
            a, b = values[ends[two]], values[ends[two] + 1]
            near = popcount(a ^ b) <= DISTANCE
            found_a.append(np.maximum(a, b)[near])
            found_b.append(np.minimum(a, b)[near])
            for k in np.flatnonzero(np.diff(ends) > 2):
                a, b = _stars(np.sort(values[ends[k] : ends[k + 1]]))
                found_a.append(a)
                found_b.append(b)
            a, b = np.concatenate(found_a).view(np.int64), np.concatenate(found_b).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    groups = rows.groupBy("key").agg(F.collect_set("fp").alias("fps"))
    return map_batches(groups.select("fps"), run, "a long, b long").distinct()


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b), b below a as unsigned, that connect the distinct fingerprints of ``fps`` as all links do."""
    found: DataFrame | None = None
    # a row becomes 66, so the tasks follow the rows and not the few bytes of the fingerprints
    tasks = min(TASKS, -(-fps.count() // TASK_ROWS))
    signatures = _signatures(fps.repartition(tasks, "fp") if tasks > 1 else fps)
    while True:
        shared = _shared(signatures)
        edges = _link(shared.where(F.col("n") <= BUCKET).select("key", "fp"))
        found = edges if found is None else found.unionByName(edges)
        large = shared.where(F.col("n") > BUCKET)
        if not large.limit(1).count():
            return found
        signatures = materialize(_cut_again(large), "simhash-level")


def components(rows: DataFrame) -> DataFrame:
    """(fp, part, component_id) of each distinct fingerprint of rows (id, fp); part names its component."""
    smallest = materialize(rows.groupBy("fp").agg(F.min("id").alias("id")), "simhash-distinct")
    edges = materialize(links(smallest.select("fp")), "simhash-edges")
    # only fingerprints with a link take part in the components; all others are their own
    parts = connected_components(edges)
    named = parts.join(smallest, parts["node"] == smallest["fp"]).groupBy("part").agg(F.min("id").alias("component"))
    members = parts.join(named, "part").withColumn("linked", F.lit(True))
    every = smallest.join(members, smallest["fp"] == members["node"], "left")
    return every.select(
        "fp",
        F.coalesce("part", "fp").alias("part"),
        F.when(F.col("linked"), F.col("component")).otherwise(F.col("id")).alias("component_id"),
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """id, fingerprint (16 hexadecimal digits) and component_id (the smallest id reachable) of each row."""
    rows = materialize(fingerprints(docs, id_col, text_col, size), "simhash-rows")
    found = components(rows)
    return rows.join(found, "fp").select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """The row of least id of each group of near copies, with all its columns. Fingerprints of shingles of ``size``
    words propose links; a link holds if the sets of shingles have a Jaccard similarity of 4/5, and those of such
    links that no two bits show come from an exact join (neardup.py)."""
    from quelora.llm import neardup

    return neardup.one_of_each(docs, id_col, text_col, size)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document, three-word shingles, links at two or fewer differing bits."""
    from quelora.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
