"""Line deduplication by a segment-partition edit join.

Lines that aren't blank take part. Equal lines are one class, and so are lines within the edit threshold, and what they
reach. The threshold of two lines is an edit for each ``EDIT_CHARS`` characters of the shorter, ``EDITS`` at most. Of each
class the first line in document order stays (by id, then the hashes of id and text, then line number); all others are
deleted.

The join cuts each line into segments, one more than its threshold; two lines within the distance share a segment, at a
place that the length difference and the segment's number confine to a few starts. Each line is indexed under its own
segments and probes those starts for each length from its own down to EDITS less, by the partition of lines of that
length. Keys are hashes of length, segment number and content; keys that only one line has are dropped, and the members
of the others are verified by a banded bit-parallel edit distance.

Keys are counted before their members meet, so none is gathered unless it is small. A key that more than ``BUCKET`` lines
share has its members cut again: what a line holds besides the shared segment goes through the same partition, under the
key, so lines part further at each level. The rest shrinks until it is short, where lines link by equal variants with up
to two characters wild or deleted, which is exact and needs no bucket. No line and no link is lost. A bucket yields a star
for each connected part, not pairs, and components come from the shared folder. Lines are named by 128 bits, and those
that meet by numbers of their own.

Defined results: a null text stays null and has no lines; rows that repeat both id and text lose the same lines; a
document may become empty; other columns are carried by ``dedup_lines``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quelora.llm.common import blocks, identity, in_filter, key_filter, map_batches, materialize, packed, release
from quelora.llm.components import connected_components

EDITS = 2
EDIT_CHARS = 20
#: Lines that are verified against each other at one key.
BUCKET = 1024
#: Length up to which what is left of a line is linked by its variants.
SHORT = 12
#: Stands for a shared segment that was cut out; any character does, as members of a bucket have it at the same cut.
CUT = "\x00"
#: Stands for any character in a variant; a lone surrogate, which no text holds.
WILD = "\udc80"


def threshold(length: int) -> int:
    """Edits that may part a line of this length from one that is as long or longer."""
    return min(EDITS, length // EDIT_CHARS)


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of the even partition; the later segments are the longer ones."""
    short, longer = divmod(length, parts)
    out, at = [], 0
    for k in range(parts):
        size = short + (k >= parts - longer)
        out.append((at, size))
        at += size
    return out


def probes(length: int, edits: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """(length probed, segment number, start in the line, segment length, edits): where a line can hold a segment of one
    that is as long or shorter, for the threshold of that length or for ``edits``. The bounds are those that both the
    edits before and after the segment allow."""
    out = []
    for less in range((EDITS if edits is None else edits) + 1):
        most = threshold(length - less) if edits is None else edits
        if less > most or not most or length - less <= most:
            continue
        for k, (start, size) in enumerate(segments(length - less, most + 1)):
            low = max(0, start - k, start + less - (most - k))
            high = min(length - size, start + k, start + less + (most - k))
            out += [(length - less, k, at, size, most) for at in range(low, high + 1)]
    return out


_PLANS: dict[tuple[int, int | None], list[tuple[int, bool, int, int, int]]] = {}


def _plan(length: int, edits: int | None) -> list[tuple[int, bool, int, int, int]]:
    """(seed, whether it is one of the line's own segments, start, end, edits)."""
    found = _PLANS.get((length, edits))
    if found is None:
        own = {(length, k, start) for k, (start, _) in enumerate(segments(length, (threshold(length) if edits is None else edits) + 1))}
        found = [(size_of * 8 + k, (size_of, k, at) in own, at, at + size, most) for size_of, k, at, size, most in probes(length, edits)]
        if len(_PLANS) < 2_000:
            _PLANS[length, edits] = found
    return found


def signatures(line: str, salt: int = 0, edits: int | None = None) -> list[tuple[int, bool, int, int, int]]:
    """(key, whether it is one of the line's own segments, start, end, edits) of a line; with ``edits`` for that many,
    whatever the length. Keys are unsigned."""
    digest, salt = xxhash.xxh64_intdigest, salt * 31
    if line.isascii():
        raw = line.encode()
        return [(digest(raw[a:b], (salt + seed) & 0xFFFFFFFF), own, a, b, n) for seed, own, a, b, n in _plan(len(line), edits)]
    return [(digest(line[a:b].encode("utf-8", "surrogatepass"), (salt + seed) & 0xFFFFFFFF), own, a, b, n) for seed, own, a, b, n in _plan(len(line), edits)]


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``, by bit-parallel columns over a diagonal band."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > edits:
        return False
    if a == b:
        return True
    n = _common_prefix(a, b)
    a, b = a[n:], b[n:]
    n = _common_prefix(a[::-1], b[::-1])
    a, b = a[: len(a) - n], b[: len(b) - n]
    if len(a) <= edits:
        return True
    if len(b) <= edits:
        return _small(a, b) <= edits
    return _band(a, b, edits)


def _common_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _small(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _band(a: str, b: str, edits: int) -> bool:
    """Rows are a's characters; a column's band is rows j - edits to j + edits, the last in the top bit. The distance
    is followed down the band's lower diagonal to the last row and then along it."""
    width = 2 * edits + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    up, down = full << edits & full, 0
    distance, last = edits, top >> 1
    slack = len(a) - len(b)
    for j, c in enumerate(b):
        shift = j - edits
        found = at.get(c, 0)
        match = (found >> shift if shift >= 0 else found << -shift) & full
        diagonal = (((match & up) + up) ^ up | match | down) & full
        right_up = (down | ~(diagonal | up)) & full
        right_down = diagonal & up
        if j + edits < len(a):
            distance += not diagonal & top
            if distance > 2 * edits + slack:
                return False
        else:
            distance += bool(right_up & last) - bool(right_down & last)
            last >>= 1
        shifted = diagonal >> 1
        up = (right_down | ~(shifted | right_up)) & full
        down = shifted & right_up
    return distance <= edits


def _long(x: int) -> int:
    return x - (x >> 63 << 64)


def line_ids(lines: list[str]) -> np.ndarray:
    """[line, 2]: 128 bits of each line as two signed longs."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines), dtype=">i8").astype(np.int64).reshape(-1, 2)


def takes_part(line: str) -> bool:
    return bool(line.strip(" \t\n\x0b\x0c\r"))


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, a and b (the hashes of id and text) and text."""
    a, b = identity(id_col, text_col)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), a.alias("a"), b.alias("b"), F.col(f"`{text_col}`").cast("string").alias("text"))


def line_table(rows: DataFrame) -> DataFrame:
    """(id, a, b, n_lines, lines: array of (no, x, y)) of each document: its lines that take part, by their 128 bits."""
    kind = pa.struct([("no", pa.int32()), ("x", pa.int64()), ("y", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 2 << 20):
            counts, ends, numbers, found = [], [0], [], []
            for text in batch.column("text").to_pylist():
                lines = text.split("\n") if text else []
                taken = [k for k, x in enumerate(lines) if takes_part(x)]
                numbers += taken
                found += [lines[k] for k in taken]
                counts.append(len(lines))
                ends.append(len(found))
            ids = line_ids(found)
            parts = pa.StructArray.from_arrays([pa.array(numbers, pa.int32()), pa.array(ids[:, 0].copy()), pa.array(ids[:, 1].copy())], fields=list(kind))
            columns = [*(batch.column(c) for c in ("id", "a", "b")), pa.array(counts, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "a", "b", "n_lines", "lines"])

    return map_batches(rows, run, "id long, a long, b long, n_lines int, lines array<struct<no:int,x:long,y:long>>")


def _near_lines(batch: pa.RecordBatch) -> list[str]:
    """The distinct lines of a block that may have near ones."""
    return [x for x in {x for t in batch.column("text").to_pylist() if t for x in t.split("\n")} if threshold(len(x)) and takes_part(x)]


def _signature_rows(rows: DataFrame) -> DataFrame:
    """(key, own, line) of the lines long enough for near matches; a block's repeated lines go once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 2 << 20):
            lines = _near_lines(batch)
            keys, own, counts = [], [], []
            for x in lines:
                found = signatures(x)
                counts.append(len(found))
                keys += [f[0] for f in found]
                own += [f[1] for f in found]
            ids = np.repeat(line_ids(lines)[:, 0], counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(own, pa.bool_()), pa.array(ids)], ["key", "own", "line"])

    return map_batches(rows.select("text"), run, "key long, own boolean, line long")


def _shared(rows: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(key, line, ...) of keys that several lines have, at least one as its own segment, with the number n of its
    lines. A key's rows are only counted and joined with the counts, never gathered; the counts are hashed, so the rows
    needn't be sorted."""
    keys = rows.groupBy("key").agg(F.count("*").alias("rows"), F.max("own").alias("any")).where("any AND rows > 1").select("key")
    met = rows.select("key", "line", *carried).join(keys.hint("shuffle_hash"), "key").dropDuplicates(["key", "line", *carried])
    met = materialize(met, "lines-met")
    # rows that repeat a line of another block are one now
    sizes = met.groupBy("key").agg(F.count("*").alias("n"), F.min("line").alias("lo"), F.max("line").alias("hi")).where("lo < hi").select("key", "n")
    return met.join(sizes, "key")


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, y, node, text) of the wanted lines: their bits, a number of their own, and the text. Lines that aren't
    wanted don't move."""
    bound = rows.sparkSession.sparkContext.broadcast(key_filter(wanted, "line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 2 << 20):
            lines = _near_lines(batch)
            ids = line_ids(lines)
            at = np.flatnonzero(in_filter(bound.value, ids[:, 0]))
            columns = [pa.array(ids[at, 0]), pa.array(ids[at, 1]), pa.array([lines[k] for k in at], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["line", "y", "text"])

    every = map_batches(rows.select("text"), run, "line long, y long, text string")
    found = every.join(wanted, "line", "left_semi").dropDuplicates(["line", "y"])
    return materialize(found.withColumn("node", F.monotonically_increasing_id()), "lines-text")


def stars(lines: list[int], texts: list[str]) -> list[tuple[int, int]]:
    """(member, least member) of each connected part; pairs that are connected already aren't compared."""
    root = list(range(len(lines)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i in range(len(lines)):
        for j in range(i):
            x, y = find(i), find(j)
            if x != y and within(texts[i], texts[j], threshold(min(len(texts[i]), len(texts[j])))):
                root[max(x, y)] = min(x, y)
    least: dict[int, int] = {}
    for k, line in enumerate(lines):
        least[find(k)] = min(line, least.get(find(k), line))
    return [(line, least[find(k)]) for k, line in enumerate(lines) if line != least[find(k)]]


def _verified(members: DataFrame, of: str, texts: DataFrame) -> DataFrame:
    """Star edges (a, b) between the nodes of small buckets; members: (key, line), line being the texts' column ``of``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges: list[tuple[int, int]] = []
            for found in batch.column("members").to_pylist():
                edges += stars([m["node"] for m in found], [m["text"] for m in found])
            a, b = zip(*edges, strict=True) if edges else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    # many keys have the same lines
    sets = members.groupBy("key").agg(F.sort_array(F.collect_set("line")).alias("lines")).select("lines").distinct()
    each = sets.select(F.explode("lines").alias("line"), F.xxhash64("lines").alias("set"))
    met = each.join(texts.select(F.col(of).alias("line"), F.col("node").alias("number"), "text"), "line")
    groups = met.groupBy("set").agg(F.sort_array(F.collect_list(F.struct(F.col("number").alias("node"), "text"))).alias("members"))
    return map_batches(groups.select("members"), run, "a long, b long").distinct()


def neighbours(text: str, edits: int = 2) -> list[tuple[str, bool]]:
    """(variant, whether it may be the centre) of a short text, for one or two edits. A variant has up to that many
    characters wild or deleted. Two texts are within the edits exactly if they share a variant of which one may be the
    centre: of those that delete as many characters as there are edits, or one besides a wild one, only a text that
    deletes nothing may."""
    n, out = len(text), {}
    cut = lambda k, by="": text[:k] + by + text[k + 1 :]

    def add(tag: str, variant: str, centre: bool) -> None:
        out[tag + variant] = out.get(tag + variant, False) or centre

    add("a", text, True)
    if edits == 1:
        for j in range(n):
            add("a", cut(j), False)
            add("c", cut(j, WILD), True)
        return list(out.items())
    add("b", text, True)
    for j in range(n):
        add("a", cut(j), True)
        wild = cut(j, WILD)
        add("c", wild, True)
        for k in range(n):
            if k != j:
                add("c", wild[:k] + wild[k + 1 :], False)
            if k < j:
                add("b", cut(j)[:k] + cut(j)[k + 1 :], False)
                add("d", wild[:k] + WILD + wild[k + 1 :], True)
    return list(out.items())


_LEVEL = [("key", pa.int64()), ("own", pa.bool_()), ("line", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("edits", pa.int32()), ("text", pa.string())]
_LEVEL_SCHEMA = "key long, own boolean, line long, start int, stop int, edits int, text string"


def _level_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_LEVEL)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _LEVEL, strict=True)], [n for n, _ in _LEVEL])


def _places(members: DataFrame) -> DataFrame:
    """The places in the texts of members (key, node, text) that give their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                rows += [(r["key"], own, r["node"], start, stop, n, r["text"]) for k, own, start, stop, n in signatures(r["text"]) if _long(k) == r["key"]]
            yield _level_batch(rows)

    return map_batches(members.select("key", "node", "text"), run, _LEVEL_SCHEMA)


def _rest(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For members (as _places gives them) of large buckets: signature rows under their key of what the line holds
    besides the shared segment (with that text), and star edges of the members whose rest is short. The two ranges of
    lengths overlap by the edits, so every pair is in one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                found = []
                for r in batch.slice(first, 256).to_pylist():
                    text, key, n = r["text"][: r["start"]] + CUT + r["text"][r["stop"] :], r["key"], r["edits"]
                    if len(text) > SHORT:
                        found += [(_long(k) ^ key, own, r["line"], start, stop, n, text) for k, own, start, stop, _ in signatures(text, key & 0x7FFFFFFF, n)]
                    if len(text) <= SHORT + n:
                        seed = key & (1 << 64) - 1
                        for variant, centre in neighbours(text, n):
                            found.append((_long(xxhash.xxh64_intdigest(variant.encode("utf-8", "surrogatepass"), seed)), None, r["line"], int(not centre), 0, n, ""))
                yield _level_batch(found)

    found = materialize(map_batches(rows, run, _LEVEL_SCHEMA), "lines-rest")
    short = found.where("own IS NULL")
    centres = short.where("start = 0").groupBy("key").agg(F.min("line").alias("b"))
    edges = short.join(centres, "key").select(F.col("line").alias("a"), "b").where("a <> b").distinct()
    return found.where("own IS NOT NULL"), edges


def near_edges(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between distinct lines that connect them as all pairs within the distance do, and the lines' texts."""
    signed = materialize(_signature_rows(rows), "lines-signed")
    shared = materialize(_shared(signed), "lines-shared")
    release(signed)
    texts = _texts(rows, shared.select("line").distinct())
    found = _verified(shared.where(F.col("n") <= BUCKET), "line", texts)
    large = shared.where(F.col("n") > BUCKET)
    if not large.limit(1).count():
        return found, texts
    level = materialize(_places(large.join(texts, "line")), "lines-level")
    while True:
        rest, edges = _rest(level)
        shared = materialize(_shared(rest.select("*"), ("own", "start", "stop", "edits", "text")), "lines-shared")
        found = found.unionByName(edges).unionByName(_verified(shared.where(F.col("n") <= BUCKET), "node", texts))
        level = shared.where(F.col("n") > BUCKET).drop("n")
        if not level.limit(1).count():
            return found, texts


def _classed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The line table, and for each document (a, b) its lines in classes of several: an array of (no, class_id, kept_id,
    kept_no, dropped, n_links)."""
    rows = _documents(docs, id_col, text_col)
    table = materialize(line_table(rows), "lines-table")
    edges, texts = near_edges(rows)
    parts = connected_components(materialize(edges, "lines-edges"))
    near = materialize(parts.join(texts.select("node", F.col("line").alias("x"), "y"), "node").select("x", "y", "part"), "lines-parts")
    each = table.dropDuplicates(["a", "b"]).select("id", "a", "b", F.explode("lines").alias("l")).select("id", "a", "b", "l.no", "l.x", "l.y")
    place = F.struct("id", "a", "b", "no")
    distinct = each.groupBy("x", "y").agg(F.min(place).alias("first"), F.count("*").alias("n")).join(near, ["x", "y"], "left")
    alone = distinct.where("part IS NULL AND n > 1").select("x", "y", F.col("x").alias("class_id"), "first", F.lit(0).cast("long").alias("n_links"))
    linked = materialize(distinct.where("part IS NOT NULL").select("x", "y", "part", "first"), "lines-linked")
    firsts = linked.groupBy("part").agg(F.min(F.struct("first", "x")).alias("least"), (F.count("*") - 1).alias("n_links"))
    joined = linked.drop("first").join(firsts, "part").select("x", "y", F.col("least.x").alias("class_id"), F.col("least.first").alias("first"), "n_links")
    several = materialize(alone.unionByName(joined), "lines-classes")
    line = F.struct("no", "class_id", F.col("first.id").alias("kept_id"), F.col("first.no").alias("kept_no"), (place != F.col("first")).alias("dropped"), "n_links")
    found = each.join(several, ["x", "y"]).groupBy("a", "b").agg(F.sort_array(F.collect_list(line)).alias("found"))
    found = materialize(found, "lines-found")
    release(texts, linked, several)
    return table, found


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_lines, n_dropped, dropped (line numbers, ascending), kept (for each of these the document and line that
    stays of its class), classes (number and class_id of each line that takes part; lines of one class have one class_id)
    and n_links (other distinct lines in the classes of its near lines, for each such line)."""
    table, found = _classed(docs, id_col, text_col)
    out = table.join(found, ["a", "b"], "left")
    none = F.array().cast(found.schema["found"].dataType)
    out = out.withColumn("found", F.coalesce("found", none))
    gone = F.filter("found", lambda x: x["dropped"])
    named = F.map_from_entries(F.transform("found", lambda x: F.struct(x["no"], x["class_id"])))
    return out.select(
        "id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_dropped"),
        F.transform(gone, lambda x: x["no"]).alias("dropped"),
        F.transform(gone, lambda x: F.struct(x["kept_id"].alias("id"), x["kept_no"].alias("no"))).alias("kept"),
        F.transform("lines", lambda x: F.struct(x["no"].alias("no"), F.coalesce(F.try_element_at(named, x["no"]), x["x"]).alias("class_id"))).alias("classes"),
        F.aggregate("found", F.lit(0).cast("long"), lambda n, x: n + x["n_links"]).alias("n_links"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated lines taken out of their texts."""
    found = _classed(docs, id_col, text_col)[1]
    drop = found.select("a", "b", F.transform(F.filter("found", lambda x: x["dropped"]), lambda x: x["no"]).alias("drop")).where(F.size("drop") > 0)
    a, b = identity(id_col, text_col)
    columns = docs.columns
    named = packed(docs, a=a, b=b, text=F.col(f"`{text_col}`").cast("string")).join(drop, ["a", "b"], "left").select("row", "text", "drop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 2 << 20):
            texts = []
            for t, drops in zip(batch.column("text").to_pylist(), batch.column("drop").to_pylist(), strict=True):
                gone = set(drops or ())
                texts.append("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone) if gone else t)
            row = batch.column("row")
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text_col else row.field(k) for k, c in enumerate(columns)], columns)

    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == text_col else f for f in docs.schema.fields])
    return map_batches(named, run, schema)


def op6_lines(spark, sf_dir: str) -> DataFrame:
    """Every line of every document, up to two edits."""
    from quelora.llm.common import table

    return line_report(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
