"""Quality rules and a hashed n-gram log-likelihood ratio.

Two multinomials over ``BUCKETS`` hashed word unigrams and bigrams are counted: the target over trusted documents
(labelled as good and not toxic), the raw one over all documents. A document's score is the mean, over its
n-grams, of log P_target(bucket) - log P_raw(bucket); the mean normalises for length. Counts are of fixed size
(two numbers for each bucket) whatever the corpus, and each task sums its own before the shuffle.

The target is counted over the trusted documents of one half of the ids, all of them. Those of the other half and the
rejected ones (quality 0) of both halves, none of which the target has counted, set the threshold, all of them, by the
balanced accuracy of telling trusted documents from rejected ones; without both kinds it is ``FALLBACK``. Every trusted or
rejected document is thus used once, but those of under ``MIN_WORDS`` words, which fail whatever the threshold, have no say
in it. The scores are counted by value and dealt out by ranges; each range finds its best
cut by itself, and the driver gets one row a range. A document passes if its score is at or above the threshold:
deterministic, for every document.

Defined results: a null or empty text has no words, no score and fails the base rules; without trusted documents the
ratio is zero everywhere and only the base rules decide; repeated rows each get a result; labels that contradict
each other count as the worse; null labels are not used; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quelora.llm.common import blocks, in_filter, key_filter, map_batches, materialize, space_words

BUCKETS = 1 << 16
FALLBACK = -1.0
MIN_WORDS = 20
#: Percent of the words in repeated windows that fail a document.
MAX_REPEATED = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)


def ngram_buckets(words: list[bytes], cache: dict[bytes, int]) -> np.ndarray:
    """Buckets of the lower-cased unigrams and bigrams of a text."""
    if len(cache) > 300_000:
        cache.clear()
    missing = set(words).difference(cache)
    for w in missing:
        cache[w] = xxhash.xxh64_intdigest(w.lower(), 7)
    ones = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    with np.errstate(over="ignore"):
        twos = (ones[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (ones[1:] + np.uint64(0x165667B19E3779F9))
        both = np.concatenate((ones, twos)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (both >> np.uint64(64 - 16)).astype(np.int64)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more in the text, the first included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    rank = ids
    # ranks of runs of 2, 4 and 8 words from those of half the length: equal ranks are equal runs
    width = 1
    while width < window:
        pairs = rank[:-width].astype(np.int64) * (int(rank.max()) + 1) + rank[width:]
        rank = np.unique(pairs, return_inverse=True)[1]
        width *= 2
    again = np.bincount(rank)[rank] > 1
    if not again.any():
        return 0
    change = np.zeros(len(ids) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    return int((np.cumsum(change)[:-1] > 0).sum())


def base_features(text: str | None, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not words:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))
    symbols = len(raw.translate(None, _NOT_SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    numbers: dict[bytes, int] = {}
    distinct = len(set(words))
    repeated = 0
    if len(words) >= WINDOW + 1 and distinct < len(words):
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
        repeated = repeated_words(ids)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def _counts(slim: DataFrame) -> np.ndarray:
    """Bucket counts over all rows; each task sums its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, cache = np.zeros(BUCKETS, dtype=np.int64), {}
        for batch in blocks(batches, "text", 4 << 20):
            parts = [ngram_buckets(words, cache) for words in map(space_words, batch.column("text").to_pylist()) if words]
            if parts:
                total += np.bincount(np.concatenate(parts), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = map_batches(slim.select("text"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log P_target - log P_raw of each bucket, add-one smoothed; zeros without target counts."""
    if not target.sum():
        return np.zeros(len(raw), dtype=np.float32)
    smooth = lambda c: np.log((c + 1.0) / (c.sum() + len(c)))
    return (smooth(target) - smooth(raw)).astype(np.float32)


class Cut(NamedTuple):
    """What a range of scores tells of cuts in it: its ends, its counts, and of its best cut the score that is the least
    kept, the one before it in the range, and the gain within the range."""

    first: float
    last: float
    good: int
    bad: int
    at: float
    before: float | None
    gain: int


def best_cut(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], n_good: int, n_bad: int) -> Cut | None:
    """The best cut of a range, from its distinct scores in rising order with their counts of good and bad; None of no
    score. The gain of a cut is (bad below it) * n_good - (good below it) * n_bad: balanced accuracy in whole numbers."""
    found: Cut | None = None
    for scores, good, bad in parts:
        if not len(scores):
            continue
        if found is None:
            found = Cut(float(scores[0]), float(scores[0]), 0, 0, float(scores[0]), None, 0)
        gains = (found.bad + np.cumsum(bad) - bad) * n_good - (found.good + np.cumsum(good) - good) * n_bad
        k = int(np.argmax(gains))
        if gains[k] > found.gain:
            found = found._replace(at=float(scores[k]), before=float(scores[k - 1]) if k else found.last, gain=int(gains[k]))
        found = found._replace(last=float(scores[-1]), good=found.good + int(good.sum()), bad=found.bad + int(bad.sum()))
    return found


def cut_of(ranges: list[Cut], n_good: int, n_bad: int) -> float:
    """The best cut of all ranges, the lowest of equals, halfway between the scores beside it."""
    best, gain, below, last = None, -1, 0, None
    for r in sorted(ranges):
        if below + r.gain > gain:
            best, gain = (r.at, last if r.before is None else r.before), below + r.gain
        below, last = below + r.bad * n_good - r.good * n_bad, r.last
    at, before = best
    if before is None:
        return at - 1.0
    middle = (before + at) / 2
    return middle if middle > before else at


def best_threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut of greatest balanced accuracy, halfway between the scores beside it; FALLBACK without both kinds."""
    if not len(good) or not len(bad):
        return FALLBACK
    scores, at = np.unique(np.concatenate((good, bad)), return_inverse=True)
    counts = (np.bincount(x, minlength=len(scores)) for x in (at[: len(good)], at[len(good) :]))
    return cut_of([best_cut(iter([(scores, *counts)]), len(good), len(bad))], len(good), len(bad))


def threshold_of(rows: DataFrame) -> float:
    """best_threshold() of the rows (trusted, score), trusted ones being good; what reaches the driver is a row a range."""
    counts = rows.groupBy("score").agg(F.count_if("trusted").alias("good"), F.count_if(~F.col("trusted")).alias("bad"))
    counts = materialize(counts, "quality-scores")
    n_good, n_bad = (int(n or 0) for n in counts.agg(F.sum("good"), F.sum("bad")).first())
    if not n_good or not n_bad:
        return FALLBACK

    types = [pa.float64()] * 2 + [pa.int64()] * 2 + [pa.float64()] * 2 + [pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = best_cut((tuple(b.column(c).to_numpy() for c in ("score", "good", "bad")) for b in batches), n_good, n_bad)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(found, types, strict=True)], list(Cut._fields))

    dealt = counts.repartitionByRange("score").sortWithinPartitions("score")
    schema = "first double, last double, good long, bad long, at double, before double, gain long"
    return cut_of([Cut(*r) for r in map_batches(dealt, run, schema).collect()], n_good, n_bad)


def verdicts(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, trusted, rejected): one row for each id with a quality label; neither holds for good but toxic ones."""
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
    found = known.agg(F.min("quality").alias("quality"), F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"))
    return found.select("id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("trusted"), (F.col("quality") == 0).alias("rejected"))


class Model:
    """Log ratios of the buckets and the threshold."""

    def __init__(self, ratio: np.ndarray, threshold: float = FALLBACK):
        self.ratio, self.threshold = ratio, threshold

    def score(self, words: list[bytes], cache: dict[bytes, int]) -> float:
        return float(self.ratio[ngram_buckets(words, cache)].mean(dtype=np.float64)) if words else 0.0


def _scored(slim: DataFrame, model: Model) -> DataFrame:
    bound = slim.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, cache = bound.value, {}
        for batch in blocks(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                words = space_words(text)
                rows.append((*base_features(text, words), fitted.score(words, cache)))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.float64())],
                ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"],
            )

    return map_batches(slim, run, "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double")


def _own_scores(slim: DataFrame, labelled: DataFrame, model: Model) -> DataFrame:
    """(trusted, score) of the rows of labelled ids (id, trusted) with MIN_WORDS words or more. Texts are scored where they
    are: a filter spares those without labels, and scores alone meet the labels."""
    bound = slim.sparkSession.sparkContext.broadcast((model, key_filter(labelled, "id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fitted, wanted), cache = bound.value, {}
        for batch in blocks(batches, "text"):
            batch = batch.filter(pa.array(in_filter(wanted, batch.column("id").to_numpy())))
            found = [(k, fitted.score(words, cache)) for k, words in enumerate(map(space_words, batch.column("text").to_pylist())) if len(words) >= MIN_WORDS]
            at, scores = pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), scores], ["id", "score"])

    return map_batches(slim.where("id IS NOT NULL"), run, "id long, score double").join(labelled, "id").select("trusted", "score")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Counts both multinomials, the raw one over all rows and the target over the trusted ones of one half of the ids,
    and fits the threshold on all other trusted and on all rejected ones."""
    slim = _slim(docs, id_col, text_col)
    found = materialize(verdicts(labels, id_col).withColumn("half", F.pmod(F.xxhash64("id"), F.lit(2))), "quality-labels")
    target = _counts(slim.join(found.where("trusted AND half = 0").select("id"), "id", "left_semi"))
    model = Model(log_ratio(target, _counts(slim)))
    model.threshold = threshold_of(_own_scores(slim, found.where("rejected OR trusted AND half = 1").select("id", "trusted"), model))
    return model


def quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base measures, score and verdict of every row."""
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    rows = _scored(_slim(docs, id_col, text_col), model)
    return rows.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & (F.col("score") >= F.lit(model.threshold)))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Every document, with the labelled documents as trusted target."""
    from quelora.llm.common import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality(docs, fit(docs, labels)).withColumnRenamed("id", "doc_id")
