"""Language ID by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A word's probability in a language is
the sum over all its segmentations into pieces, which the forward algorithm gives in one sweep; a text's is the
product over its words. The predicted language has the greatest posterior, under the languages' shares as prior, and
the score is that posterior.

Training takes at most about ``TRAIN_DOCS`` labelled documents a language (those whose hash of id and text falls
under the share that gives so many), counts their words by language, and fits the piece probabilities
by expectation maximisation: forward and backward sums give each piece's expected count. What reaches the driver is
one number for each language and piece. Everything else covers all rows and whole texts.

All words of a block are swept together: the sums of all words at one position are one numpy step, and each distinct
word is computed once and remembered. Characters without a piece cost the same in every language. A
word of over ``LONG_WORD`` characters counts as several, so an endless one needs no more memory than others.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text if nothing was
learned; repeated rows each get a result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quelora.llm.common import blocks, map_batches, materialize, merged
from quelora.llm.pieces import Vocabulary, model_path, vocabulary

#: Labelled documents of each language that training reads, about.
TRAIN_DOCS = 3_000
ROUNDS = 2
#: Log-probability of a character that has no piece.
UNKNOWN = -25.0
#: Pseudo-count of each piece, shared out by the vocabulary's own probabilities.
SMOOTH = 2_000.0
REMEMBERED = 100_000
#: Characters from which a word is cut into several, so that one endless word needs bounded memory.
LONG_WORD = 512
UND = "und"

_SHIFT = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Finds the pieces of many words at once, by a rolling hash of code points."""

    def __init__(self, vocab: Vocabulary):
        texts = sorted(vocab.ids)
        self.longest = vocab.longest
        self.size = len(texts)
        hashes = np.array([self._hash(t) for t in texts], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("pieces of the vocabulary share a hash")
        self.prior = np.exp(vocab.logp[[vocab.ids[t] for t in texts]])

    @staticmethod
    def _hash(text: str) -> int:
        value = 0
        for c in text:
            value = ((value + ord(c) + 1) * int(_SHIFT)) & (1 << 64) - 1
        return value

    def matches(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Lengths, and for each piece length k an array [word, end] of piece numbers, -1 where none ends there."""
        lens = np.array([len(w) for w in words], dtype=np.int64)
        width = int(lens.max())
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        codes = np.zeros((len(words), width), dtype=np.uint64)
        inside = np.arange(width) < lens[:, None]
        codes[inside] = flat.astype(np.uint64) + np.uint64(1)
        found, hashes = [], np.zeros((len(words), width), dtype=np.uint64)
        for k in range(1, min(self.longest, width) + 1):
            # hashes[:, e] becomes the hash of the k characters that end at e
            hashes[:, 1:] = hashes[:, :-1].copy()
            hashes[:, 0] = 0
            with np.errstate(over="ignore"):
                hashes = (hashes + codes) * _SHIFT
            live = inside.copy()
            live[:, : k - 1] = False
            want = hashes[live]
            at = np.minimum(np.searchsorted(self.hashes, want), self.size - 1)
            numbers = np.full((len(words), width), -1, dtype=np.int32)
            numbers[live] = np.where(self.hashes[at] == want, self.numbers[at], -1)
            found.append(numbers)
        return lens, found

    def forward(self, lens: np.ndarray, found: list[np.ndarray], prob: np.ndarray, keep: bool = False):
        """Log-probability [word, language] of each word, summed over its segmentations; with keep also the scaled
        sums and log scales at each position. prob: [piece + 1, language], zeros last."""
        width, langs = found[0].shape[1], prob.shape[1]
        unknown = np.exp(UNKNOWN)
        window = [np.ones((len(lens), langs))]  # sums at the last positions, newest first
        scale, out = np.zeros(len(lens)), np.zeros((len(lens), langs))
        sums, scales = [window[0]], [scale.copy()]
        for end in range(width):
            total = window[0] * np.where(found[0][:, end] < 0, unknown, 0.0)[:, None]
            for k in range(min(len(window), len(found))):
                total += window[k] * prob[found[k][:, end]]
            window.insert(0, total)
            del window[len(found) :]
            low = total.max(axis=1)
            if (low < 1e-60).any():
                by = np.where((low < 1e-60) & (low > 0), 1 / np.maximum(low, 1e-300), 1.0)
                window = [w * by[:, None] for w in window]
                scale = scale - np.log(by)
            if keep:
                sums.append(window[0])
                scales.append(scale.copy())
            done = lens == end + 1
            if done.any():
                out[done] = np.log(np.maximum(window[0][done], 1e-300)) + scale[done, None]
        return (out, sums, scales) if keep else out


def by_length(words: list[str], most: int = 1 << 17) -> Iterator[list[int]]:
    """Indexes of words in groups of like length, so that a group's table has about ``most`` cells or one word."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    group: list[int] = []
    for k in order:
        if group and (len(group) + 1) * len(words[k]) > most:
            yield group
            group = []
        group.append(k)
    if group:
        yield group


class Model:
    """Languages, their prior, and [piece + 1, language] probabilities."""

    def __init__(self, langs: list[str], prior: np.ndarray, prob: np.ndarray, path: str):
        self.langs, self.prior, self.path = langs, np.log(prior), path
        self.prob = np.vstack((prob, np.zeros((1, prob.shape[1]))))


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(vocabulary(path))
    return _PIECES[path]


def has_letter(text: str | None) -> bool:
    return text is not None and (re.search("[A-Za-z]", text) is not None or any(map(str.isalpha, text)))


def cut_words(text: str) -> list[str]:
    """The words of a text; each stretch of LONG_WORD characters of a longer word counts as a word."""
    words = text.split()
    if words and max(map(len, words)) > LONG_WORD:
        return [w[k : k + LONG_WORD] for w in words for k in range(0, len(w), LONG_WORD)]
    return words


class Scorer:
    """Log-probabilities of texts, with each distinct word computed once for a while."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, pieces(model.path)
        self._forget()

    def _forget(self) -> None:
        self.row: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.langs)))

    def logs(self, texts: list[str]) -> np.ndarray:
        """[text, language] log-probabilities of the words."""
        if len(self.row) > REMEMBERED:
            self._forget()
        row, first = self.row, len(self.row)
        words, ends = [], [0]
        for text in texts:
            words += [row.setdefault(w, len(row)) for w in cut_words(text)]
            ends.append(len(words))
        new = [" " + w for w in list(row)[first:]]
        fresh = np.zeros((len(new), len(self.model.langs)))
        for group in by_length(new):
            lens, found = self.pieces.matches([new[k] for k in group])
            fresh[group] = self.pieces.forward(lens, found, self.model.prob)
        self.table = np.concatenate((self.table, fresh))
        sums = np.concatenate((np.zeros((1, fresh.shape[1])), np.cumsum(self.table[words], axis=0)))
        return sums[ends[1:]] - sums[ends[:-1]]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [k for k, t in enumerate(texts) if has_letter(t)] if self.model.langs else []
        langs, scores = [UND] * len(texts), np.zeros(len(texts))
        if known:
            logs = self.logs([texts[k] for k in known]) + self.model.prior
            top = logs.argmax(axis=1)
            scores[known] = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            for k, t in zip(known, top, strict=True):
                langs[k] = self.model.langs[t]
        return langs, scores


def _word_counts(labelled: DataFrame) -> DataFrame:
    """(lang, word, n) of labelled texts (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merged(batches, "text"):
            counts: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for word, n in Counter(cut_words(text)).items():
                    counts[lang, word] += n
            langs, words = zip(*counts, strict=True) if counts else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"]
            )

    return map_batches(labelled, run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def expected_counts(words: list[str], counts: np.ndarray, at: Pieces, prob: np.ndarray) -> np.ndarray:
    """[piece, language] expected numbers of each piece in words that occur counts[word, language] times."""
    total = np.zeros((at.size + 1, prob.shape[1]))
    for group in by_length([" " + w for w in words]):
        lens, found = at.matches([" " + words[k] for k in group])
        n = counts[group]
        logs, sums, scales = at.forward(lens, found, prob, keep=True)
        width = found[0].shape[1]
        unknown = np.exp(UNKNOWN)
        # after[p]: the sum over what follows position p, with its own log scale, kept for the last positions
        after = {width: np.zeros((len(lens), prob.shape[1]))}
        log_scale = {width: np.zeros(len(lens))}
        after[width][lens == width] = 1.0
        for p in range(width - 1, -1, -1):
            ahead = range(1, min(len(found), width - p) + 1)
            base = np.max([log_scale[p + k] for k in ahead], axis=0)
            value = np.zeros((len(lens), prob.shape[1]))
            for k in ahead:
                numbers = found[k - 1][:, p + k - 1]
                step = prob[numbers]
                if k == 1:
                    step = step + np.where(numbers < 0, unknown, 0.0)[:, None]
                value += step * after[p + k] * np.exp(log_scale[p + k] - base)[:, None]
            ends = lens == p
            value[ends], base[ends] = 1.0, 0.0
            high = value.max(axis=1)
            by = np.where(high > 0, high, 1.0)
            after[p], log_scale[p] = value / by[:, None], base + np.log(by)
            for k in ahead:
                numbers = found[k - 1][:, p + k - 1]
                use = np.flatnonzero((numbers >= 0) & (lens >= p + k))
                if len(use):
                    weight = sums[p][use] * prob[numbers[use]] * after[p + k][use]
                    shift = scales[p][use, None] + log_scale[p + k][use, None] - logs[use]
                    np.add.at(total, numbers[use], n[use] * weight * np.exp(np.minimum(shift, 700)))
            after.pop(p + len(found) + 1, None)
            log_scale.pop(p + len(found) + 1, None)
    return total[:-1]


def normalise(counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Piece probabilities by language from expected counts."""
    smoothed = counts + SMOOTH * prior[:, None] / prior.sum()
    return smoothed / smoothed.sum(axis=0)


def fit(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", path: str | None = None) -> Model:
    """Learns from the texts and non-null languages of the rows where ``learn`` holds."""
    path = path or model_path()
    at = pieces(path)
    named = {"key": id_col, "lang": lang_col, "text": text_col}
    rows = docs.where(learn).select(*(F.col(c).cast("string").alias(n) for n, c in named.items())).where("lang IS NOT NULL AND text IS NOT NULL")
    shares = sorted((r.lang, r["count"]) for r in rows.groupBy("lang").count().collect())
    langs = [s[0] for s in shares]
    if not langs:
        return Model([], np.zeros(0), np.zeros((at.size, 0)), path)
    share = F.element_at(F.create_map(*(F.lit(x) for lang, n in shares for x in (lang, min(1.0, TRAIN_DOCS / n)))), F.col("lang"))
    chosen = rows.select("key", "lang", "text").where(F.pmod(F.xxhash64("key", "text"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")
    words = materialize(_word_counts(chosen), "language-words")
    prob = np.repeat(at.prior[:, None] / at.prior.sum(), len(langs), axis=1)
    number = {lang: k for k, lang in enumerate(langs)}
    for _ in range(ROUNDS):
        bound = words.sparkSession.sparkContext.broadcast(np.vstack((prob, np.zeros((1, len(langs))))))

        def run(batches: Iterator[pa.RecordBatch], bound=bound) -> Iterator[pa.RecordBatch]:
            total, now = 0.0, pieces(path)
            for batch in blocks(batches, "word", 1 << 21):
                rank: dict[str, int] = {}
                place = [rank.setdefault(w, len(rank)) for w in batch.column("word").to_pylist()]
                counts = np.zeros((len(rank), len(number)))
                counts[place, [number[x] for x in batch.column("lang").to_pylist()]] = batch.column("n").to_numpy()
                total = total + expected_counts(list(rank), counts, now, bound.value)
            if not np.isscalar(total):
                piece, lang = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], ["piece", "lang", "n"])

        found = map_batches(words, run, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros_like(prob)
        counts[found["piece"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
        prob = normalise(counts, at.prior)
        bound.destroy()
    n = np.array([s[1] for s in shares], dtype=float)
    return Model(langs, (n + 1) / (n + 1).sum(), prob, path)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score to every row, in place of any columns of these names."""
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    source = docs.select(*(F.col(f"`{c}`") for c in kept))
    bound = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(bound.value)
        for batch in merged(batches, text_col, 2 << 20):
            langs, scores = scorer.predict(batch.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores)], [*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType(list(source.schema.fields)).add("lang_pred", T.StringType()).add("score", T.DoubleType())
    return map_batches(source, run, schema)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3: rows of remainder 1 are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3, F.lit(0))


def op4_language(spark, sf_dir: str) -> DataFrame:
    """Every document; learned from the rows that are not held out."""
    from quelora.llm.common import table

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, fold() != 1)
    rows = docs.select("doc_id", (fold() == 1).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
