"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` cuts the training documents into blocks of bounded text size and stores, for each block, an
inverted index: every distinct term with the ascending list of its positions. ``search`` evaluates windows of the
test items against each block: it takes the window's terms from the rarest to the most frequent in that block,
starts with the rarest term's positions minus its offset in the window, and intersects them with the
offset-adjusted positions of each further term. With a slop, ``search`` finds proximity matches from the same lists.

The index is partitioned by document, so building it moves no rows between executors, a very common term or
passage is spread over all blocks, and a block's result needs nothing from other blocks. Test items go to the
executors in passes of at most ``PASS_WORDS`` words, which bounds what is broadcast; a longer item goes in parts that
overlap by a window. With more items there are more passes over the stored index, and no item is left out. Each of
several passes writes its hits alone, which meet the documents once at the end.

Defined results: a null or empty text has no words and no hits; an item without words has no windows; an item of
fewer words than the window is one window of its own length; repeated rows each get their own result; repeated
item ids count once; a null item id counts as the empty string; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quelora.llm.common import alnum_words, map_batches, materialize, merged

WINDOW = 10
#: Words of test items that one pass broadcasts (about 20 bytes each).
PASS_WORDS = 500_000
#: Text bytes in one index block.
INDEX_BYTES = 6 << 20
#: Candidate positions that one step of a search holds.
STEP = 1 << 21

INDEX_SCHEMA = "block long, ids array<long>, tags array<long>, lens array<int>, terms array<binary>, counts binary, gaps binary"
HIT_SCHEMA = "block long, row int, id long, tag long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,stop:int>>"
HIT_COLUMNS = ["block", "row", "id", "tag", "n_words", "n_hit", "items", "spans"]


def _index_block(block: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    lens, numbers, ids = [], {}, []
    for text in batch.column("text").to_pylist():
        words = alnum_words(text)
        lens.append(len(words))
        ids += [numbers.setdefault(w, len(numbers)) for w in words]
    term_of = np.fromiter(ids, dtype=np.int32, count=len(ids))
    positions = np.argsort(term_of, kind="stable").astype(np.int32)
    counts = np.bincount(term_of, minlength=len(numbers)).astype(np.int32)
    gaps = np.diff(positions, prepend=np.int32(0)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block], pa.int64()),
            *(pa.array([batch.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("id", "tag")),
            pa.array([lens], pa.list_(pa.int32())),
            pa.array([list(numbers)], pa.list_(pa.binary())),
            pa.array([counts.tobytes()], pa.binary()),
            pa.array([gaps.tobytes()], pa.binary()),
        ],
        ["block", "ids", "tags", "lens", "terms", "counts", "gaps"],
    )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "positions", tag_col: str | None = None) -> DataFrame:
    """Stores the positional index of all documents in the shared folder; one row for each block. A document may have a
    tag, a second long that goes with its id."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for k, batch in enumerate(merged(batches, "text", INDEX_BYTES)):
            yield _index_block(first + k, batch)

    tag = F.col(f"`{tag_col}`") if tag_col else F.lit(None)
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), tag.cast("long").alias("tag"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return materialize(map_batches(slim, build, INDEX_SCHEMA), name)


class Postings:
    """One block's index, restricted to the terms that a pass asks for."""

    def __init__(self, row: dict, vocabulary: pa.Array):
        self.lens = np.asarray(row["lens"], dtype=np.int64)
        self.bases = np.concatenate(([0], np.cumsum(self.lens)))
        self.length = int(self.bases[-1])
        counts = np.frombuffer(row["counts"], dtype=np.int32)
        positions = np.cumsum(np.frombuffer(row["gaps"], dtype=np.int32), dtype=np.int32)
        at = pa.compute.index_in(vocabulary, value_set=pa.array(row["terms"], pa.binary()))
        local = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        self.n = np.where(local >= 0, counts[np.maximum(local, 0)] if len(counts) else 0, 0).astype(np.int64)
        begin = np.where(local >= 0, starts[np.maximum(local, 0)], 0)
        self.starts = np.concatenate(([0], np.cumsum(self.n)))
        take = np.repeat(begin - self.starts[:-1], self.n) + np.arange(self.starts[-1])
        self.positions = positions[take].astype(np.int64)
        #: term * length + position, ascending: a posting is present if its key is
        self.keys = np.repeat(np.arange(len(self.n)), self.n) * max(1, self.length) + self.positions

    def has(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether each term has a posting at the position."""
        inside = (positions >= 0) & (positions < self.length)
        want = terms * max(1, self.length) + positions
        at = np.minimum(np.searchsorted(self.keys, want), max(0, len(self.keys) - 1))
        return inside & (self.keys[at] == want) if len(self.keys) else np.zeros(len(want), bool)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bases, positions, side="right") - 1


class Windows:
    """The distinct windows of one pass of items: vocabulary, term numbers, lengths, item numbers."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        numbers: dict[bytes, int] = {}
        self.items = [i for i, _ in items]
        rows, seen = [], set()
        for k, (_, words) in enumerate(items):
            terms = [numbers.setdefault(w, len(numbers)) for w in words]
            size = min(window, len(terms))
            for start in range(len(terms) - size + 1 if size else 0):
                key = (k, tuple(terms[start : start + size]))
                if key not in seen:
                    seen.add(key)
                    rows.append(key)
        self.vocabulary = list(numbers)
        self.item = np.array([k for k, _ in rows], dtype=np.int32)
        self.size = np.array([len(t) for _, t in rows], dtype=np.int64)
        self.terms = np.full((len(rows), window), -1, dtype=np.int32)
        for r, (_, t) in enumerate(rows):
            self.terms[r, : len(t)] = t


def _rarest_first(index: Postings, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows whose terms all occur, their offsets from the rarest term on, and the rarest term's frequency."""
    if not len(windows.terms):
        return np.zeros(0, int), np.zeros((0, 0), int), np.zeros(0, int)
    n = np.where(windows.terms >= 0, index.n[windows.terms], np.iinfo(np.int64).max)
    live = np.flatnonzero(n.min(axis=1) > 0)
    order = np.argsort(n[live], axis=1, kind="stable")
    return live, order, n[live, order[:, 0]]


def _steps(counts: np.ndarray, limit: int) -> Iterator[slice]:
    """Slices of windows with about ``limit`` candidates each."""
    ends = np.cumsum(counts)
    start = 0
    while start < len(counts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield slice(start, stop)
        start = stop


def occurrences(index: Postings, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of every exact occurrence, by intersecting offset-adjusted lists from the rarest term on."""
    live, order, n = _rarest_first(index, windows)
    found_w, found_s = [], []
    for part in _steps(n, STEP):
        w, o, c = live[part], order[part], n[part]
        rare = windows.terms[w, o[:, 0]]
        take = np.repeat(index.starts[rare] - np.concatenate(([0], np.cumsum(c)[:-1])), c) + np.arange(c.sum())
        of = np.repeat(np.arange(len(w)), c)
        start = index.positions[take] - o[of, 0]
        good = (start >= 0) & (start + windows.size[w[of]] <= index.length)
        of, start = of[good], start[good]
        for k in range(1, windows.terms.shape[1]):
            if not len(of):
                break
            offset = o[of, k]
            term = windows.terms[w[of], offset].astype(np.int64)
            keep = (term < 0) | index.has(term, start + offset)
            of, start = of[keep], start[keep]
        keep = index.doc_of(start) == index.doc_of(start + windows.size[w[of]] - 1)
        found_w.append(w[of[keep]])
        found_s.append(start[keep])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(found_w), join(found_s)


def near_occurrences(index: Postings, windows: Windows, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, start, stop) of the tightest spans around each posting of a window's rarest term that hold all
    words of the window, in any order, within its length plus ``slop`` words of one document."""
    live, order, n = _rarest_first(index, windows)
    out: set[tuple[int, int, int]] = set()
    for w, o in zip(live, order, strict=True):
        terms, need = np.unique(windows.terms[w][windows.terms[w] >= 0], return_counts=True)
        reach = int(windows.size[w]) + slop
        lists = [index.positions[index.starts[t] : index.starts[t + 1]] for t in terms]
        for p in index.positions[index.starts[windows.terms[w, o[0]]] :][: index.n[windows.terms[w, o[0]]]]:
            doc = int(index.doc_of(np.array([p]))[0])
            lo, hi = max(int(index.bases[doc]), int(p) - reach + 1), min(int(index.bases[doc + 1]), int(p) + reach)
            near = [x[np.searchsorted(x, lo) : np.searchsorted(x, hi)] for x in lists]
            if any(len(x) < c for x, c in zip(near, need, strict=True)):
                continue
            best = None
            for first in np.unique(np.concatenate(near)):
                at = [np.searchsorted(x, first) + c - 1 for x, c in zip(near, need, strict=True)]
                if any(a >= len(x) for a, x in zip(at, near, strict=True)):
                    break
                stop = max(int(x[a]) for a, x in zip(at, near, strict=True)) + 1
                if first <= p < stop and stop - first <= reach and (best is None or stop - first < best[1] - best[0]):
                    best = (int(first), stop)
            if best:
                out.add((int(w), *best))
    rows = sorted(out)
    return tuple(np.array([r[k] for r in rows], dtype=np.int64) for k in range(3))


def _results(row: dict, windows: Windows, vocabulary: pa.Array, slop: int | None, every: bool) -> pa.RecordBatch:
    """A row for each document of a block, or with every=False for each that is hit."""
    index = Postings(row, vocabulary)
    if slop is None:
        w, start = occurrences(index, windows)
        stop = start + windows.size[w]
    else:
        w, start, stop = near_occurrences(index, windows, slop)
    docs = len(index.lens)
    change = np.bincount(start, minlength=index.length + 1) - np.bincount(stop, minlength=index.length + 1)
    hit = np.concatenate(([0], np.cumsum(np.cumsum(change)[: index.length] > 0)))
    n_hit = hit[index.bases[1:]] - hit[index.bases[:-1]]
    items: list[list[str]] = [[] for _ in range(docs)]
    spans: list[list[dict]] = [[] for _ in range(docs)]
    if len(w):
        doc = index.doc_of(start)
        for d, i in sorted(set(zip(doc.tolist(), windows.item[w].tolist(), strict=True))):
            items[d].append(windows.items[i])
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(change)[: index.length] > 0).astype(np.int8), [0]))))
        # a run of hit words is cut where the document changes
        cuts = np.unique(np.concatenate((edges, index.bases)))
        inside = np.cumsum(change)[np.minimum(cuts[:-1], index.length - 1)] > 0
        for a, b in zip(cuts[:-1][inside], cuts[1:][inside], strict=True):
            d = int(index.doc_of(np.array([a]))[0])
            spans[d].append({"start": int(a - index.bases[d]), "stop": int(b - index.bases[d])})
    found = pa.RecordBatch.from_arrays(
        [
            pa.array([row["block"]] * docs, pa.int64()),
            pa.array(np.arange(docs, dtype=np.int32)),
            pa.array(row["ids"], pa.int64()),
            pa.array(row["tags"], pa.int64()),
            pa.array(index.lens),
            pa.array(n_hit.astype(np.int64)),
            pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
        ],
        HIT_COLUMNS,
    )
    return found if every else found.filter(pa.array(n_hit > 0))


def _passes(items: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items with words, in passes of at most PASS_WORDS words; parts of a longer item hold all its windows."""
    held, size, most = [], 0, max(PASS_WORDS, 2 * window)
    for item, text in items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.col(f"`{text_col}`").cast("string")).toLocalIterator():
        words = alnum_words(text)
        starts = range(0, max(1, len(words) - window + 1), most - window + 1)
        for part in (words[k : k + most] for k in starts):
            if held and size + len(part) > most:
                yield held
                held, size = [], 0
            if part:
                held.append((item, part))
                size += len(part)
    yield held


def search(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """One row for each indexed document: id, n_words, n_hit (words inside an occurrence), items (ids with an
    occurring window, ascending as strings) and spans (runs of hit words, as word offsets).

    slop None: exact phrases. Else proximity: all words of the window, in any order, within its length plus slop."""

    def one(bound, every: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = bound.value
            vocabulary = pa.array(windows.vocabulary, pa.binary())
            for batch in batches:
                for k in range(batch.num_rows):
                    yield _results(batch.slice(k, 1).to_pylist()[0], windows, vocabulary, slop, every)

        return map_batches(index, run, HIT_SCHEMA)

    context, hits, bound = index.sparkSession.sparkContext, None, None
    for part in _passes(items, id_col, text_col, window):
        if bound is not None:
            more = materialize(one(bound, False), "hits")
            bound.destroy()
            hits = more if hits is None else hits.unionByName(more)
        bound = context.broadcast(Windows(part, window))
    if hits is None:
        return one(bound, True)
    hits = hits.unionByName(materialize(one(bound, False), "hits"))
    bound.destroy()
    # the passes meet by row; each adds a few spans, and n_hit is the length of the spans' union
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    union = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["stop"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(acc["end"], s["start"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    of_doc = hits.groupBy("block", "row").agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    each = index.select("block", F.posexplode(F.arrays_zip("ids", "tags", "lens")).alias("row", "d"))
    rows = each.select("block", "row", F.col("d.ids").alias("id"), F.col("d.tags").alias("tag"), F.col("d.lens").cast("long").alias("n_words"))
    found = rows.join(of_doc.withColumn("n_hit", union), ["block", "row"], "left")
    none = {"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>"), "spans": F.array().cast("array<struct<start:int,stop:int>>")}
    return found.withColumns({c: F.coalesce(c, v) for c, v in none.items()}).select(HIT_COLUMNS)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Exact matches of the items' windows in every document; see search()."""
    return search(build_index(docs), items, window=window)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item, windows of 10 words."""
    from quelora.llm.common import table

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT doc_id, i, bw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
