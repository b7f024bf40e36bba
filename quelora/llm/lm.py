"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation.

The model gives log P(w | v) = q_v . r_w + b_w - log Z_v over classes of words, with v the class of the word before.
Classes are the end token, each of the ``FREQUENT`` most frequent words, and ``ENDINGS`` classes of all other words, by a
hash of their last three bytes, so that rare words keep vectors of their own kind. Context is one word so that the
normaliser is a table over v, computed exactly by batched matrix products; the probabilities of each context sum to one.
A word of an ending class has the class's probability times its add-half share of the class, in which one unseen word
takes part.

Words are counted over all training documents, and so are the pairs of neighbouring classes. The pairs are all that the
model learns from, and their number is bounded by the classes, whatever the corpus. Training climbs the NCE objective
over all pairs with its noise in expectation rather than by samples: each of ``ROUNDS`` rounds takes the gradient in
``BLOCKS`` fixed blocks of contexts, as products of matrices, and the driver adds the blocks up in order and makes an
Adam step. So the result doesn't depend on how the corpus or the work is dealt out.

Scoring looks words up in a table of the ``TOP`` most frequent, whose size is fixed. All other words go through a join
with the full counts, which is exact however large the vocabulary grows.

Defined results: a null or empty text is the end token alone; repeated rows each get a result; a null doc_id trains;
without training documents the base score is zero and the model is uniform over its classes; other columns are not
read.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quelora.llm.common import blocks, map_batches, materialize, merged, space_words

#: Words that executors look up without a join.
TOP = 250_000
#: Words that are a class each, and classes of all others.
FREQUENT = 4096
ENDINGS = 4096
ENDING_BYTES = 3
WIDTH = 16
#: Noise words to a true one.
NOISE = 64.0
ROUNDS = 16
RATE = 0.2
#: Pseudo-count of a class when its gradient is scaled by how often it occurs.
STEADY = 10.0
BLOCKS = 32
#: The token that ends a text; no word holds a space.
END = b" "
END_ID = 0
#: Distinct words, or pairs of classes, that a counting task holds before it hands them on.
HELD = 1_000_000


def _slim(docs: DataFrame, id_col: str, text_col: str, learn: Column) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all rows, the end token included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in blocks(batches, "text"):
            for text in batch.column("text").to_pylist():
                counts.update(space_words(text, lower=True))
            counts[END] += batch.num_rows
            if len(counts) > HELD:
                yield _count_rows(counts)
                counts = Counter()
        yield _count_rows(counts)

    return map_batches(texts.select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _count_rows(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def ending(word: bytes, frequent: int, endings: int) -> int:
    """Class of a word that isn't one of the frequent."""
    return 1 + frequent + zlib.crc32(word[-ENDING_BYTES:]) % endings


class Table:
    """The most frequent words with their counts, and the totals of all words and of the ending classes."""

    def __init__(self, words: list[bytes], counts: list[int], n_tokens: int, n_words: int, by_ending: dict[int, tuple[int, int]]):
        """by_ending: (tokens, distinct words) of all words, the frequent included, by the hash of their ending."""
        self.key = uuid.uuid4().hex
        self.joined, self.counts = b"\n".join(words), np.array(counts, dtype=np.int64)
        self.n_tokens, self.n_words, self.size = n_tokens, n_words, len(words)
        self.frequent, self.endings = FREQUENT, ENDINGS
        self.classes = 1 + FREQUENT + ENDINGS
        #: class of each word of the table, and zero last
        self.class_of = np.zeros(self.size + 1, dtype=np.int32)
        tokens, distinct = np.zeros(self.classes), np.zeros(self.classes)
        for k, (n, v) in by_ending.items():
            tokens[1 + FREQUENT + k], distinct[1 + FREQUENT + k] = n, v
        self.end_count, alone = 0, 0
        for k, (word, n) in enumerate(zip(words, counts, strict=True)):
            if word == END:
                self.end_count = n
                continue
            self.class_of[k] = kind = ending(word, FREQUENT, ENDINGS)
            if alone < FREQUENT:  # words come in order of their counts
                tokens[kind], distinct[kind] = tokens[kind] - n, distinct[kind] - 1
                alone += 1
                self.class_of[k] = alone
                tokens[alone], distinct[alone] = n, 1
        tokens[END_ID], distinct[END_ID] = self.end_count, 1
        distinct[1 + FREQUENT :] += 1  # an unseen word
        #: add-half total of each class
        self.mass = tokens + 0.5 * distinct
        self.live = distinct > 0
        self.unigram = np.where(self.live, self.mass, 0.5) / np.where(self.live, self.mass, 0.5).sum()

    @property
    def base_total(self) -> float:
        return self.n_tokens + 0.5 * (self.n_words + 1)


_NUMBERS: dict[str, dict[bytes, int]] = {}


def numbers(table: Table) -> dict[bytes, int]:
    """The words' places in the table; built once in each Python worker."""
    if table.key not in _NUMBERS:
        _NUMBERS.clear()
        words = table.joined.split(b"\n") if table.size else []
        _NUMBERS[table.key] = {w: k for k, w in enumerate(words)}
    return _NUMBERS[table.key]


class Model:
    """Context vectors q, output vectors r and biases b of a log-bilinear model."""

    def __init__(self, q: np.ndarray, r: np.ndarray, b: np.ndarray):
        self.q, self.r, self.b = q, r, b
        self.log_z: np.ndarray | None = None

    @classmethod
    def start(cls, unigram: np.ndarray, seen: np.ndarray, width: int = WIDTH) -> Model:
        """The unigram distribution in every context; contexts that weren't seen stay at it."""
        q = (np.random.default_rng(20).standard_normal((len(unigram), width)) * 0.1).astype(np.float32)
        return cls(np.where(seen[:, None], q, np.float32(0)), np.zeros_like(q), np.log(unigram).astype(np.float32))

    def normalise(self) -> Model:
        """Fills the table of log Z by matrix products over blocks of contexts."""
        parts = []
        for k in range(0, len(self.q), 256):
            scores = self.q[k : k + 256] @ self.r.T + self.b
            top = scores.max(axis=1)
            parts.append(top + np.log(np.exp(scores - top[:, None]).sum(axis=1, dtype=np.float64)))
        self.log_z = np.concatenate(parts)
        return self

    def logs(self, before: np.ndarray, now: np.ndarray) -> np.ndarray:
        """Normalised natural log-probabilities of tokens after their contexts."""
        return np.einsum("ij,ij->i", self.q[before], self.r[now]).astype(np.float64) + self.b[now] - self.log_z[before]


def nce_gradient(model: Model, log_noise: np.ndarray, contexts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient of the NCE objective over the pairs counts[context, word]: of the contexts' q, of r and of b. The noise is
    exp(log_noise) words a true one, in expectation."""
    right = 1 / (1 + np.exp(log_noise - (model.q[contexts] @ model.r.T + model.b)))  # that a word is no noise
    noise = counts.sum(axis=1, keepdims=True) * np.exp(log_noise)
    slope = (counts * (1 - right) - noise * right).astype(np.float32)
    return slope @ model.r, slope.T @ model.q[contexts], slope.sum(axis=0)


class Adam:
    """Adaptive steps uphill on several arrays."""

    def __init__(self, arrays: list[np.ndarray]):
        self.arrays = arrays
        self.means, self.squares = ([np.zeros_like(x) for x in arrays] for _ in range(2))
        self.steps = 0

    def step(self, grads: list[np.ndarray], rate: float) -> None:
        self.steps += 1
        for x, g, m, s in zip(self.arrays, grads, self.means, self.squares, strict=True):
            m *= 0.8
            m += 0.2 * g
            s *= 0.95
            s += 0.05 * g * g
            x += (rate * (m / (1 - 0.8**self.steps)) / (np.sqrt(s / (1 - 0.95**self.steps)) + 0.02)).astype(x.dtype)


def _tokens(texts: list[str | None], places: dict[bytes, int], table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
    """Places of all words, with an end after each text (-1; words outside the table: its size), the classes of these
    tokens, the texts' token counts, and each text's words outside the table."""
    flat, counts, outside, size = [], [], [], table.size
    for text in texts:
        words = space_words(text, lower=True)
        found = [places.get(w, size) for w in words]
        outside.append([w for w, k in zip(words, found, strict=True) if k == size] if size in found else [])
        found.append(-1)
        flat += found
        counts.append(len(found))
    at = np.array(flat, dtype=np.int64)
    now = np.where(at < 0, END_ID, table.class_of[at])
    rare = [ending(w, table.frequent, table.endings) for ws in outside for w in ws]
    now[at == size] = rare
    return at, now, np.array(counts, dtype=np.int64), outside


def _before(now: np.ndarray) -> np.ndarray:
    """Class before each token; a text begins after an end."""
    return np.concatenate(([END_ID], now[:-1]))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of (keys, counts) parts, with their sums."""
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def pair_counts(texts: DataFrame, table: Table) -> DataFrame:
    """(block, pairs, n): the pairs (context * classes + class, ascending) of each block of contexts and how often
    they occur in all texts, as bytes of 64-bit integers."""
    bound = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bound.value
        places = numbers(words)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in merged(batches, "text", 4 << 20):
            now = _tokens(batch.column("text").to_pylist(), places, words)[1].astype(np.int64)
            held.append(np.unique(_before(now) * words.classes + now, return_counts=True))
            if sum(len(k) for k, _ in held) > HELD:
                held = [_summed(held)]
                if len(held[0][0]) > HELD // 2:
                    yield _pair_rows(*held.pop())
        if held:
            yield _pair_rows(*_summed(held))

    counted = map_batches(texts.select("text"), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("pair").to_numpy(), b.column("n").to_numpy(), b.column("block").to_numpy()) for b in batches if b.num_rows]
        if parts:
            pairs, n, block = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(pairs)
            row = [pa.array([int(block[0])], pa.int32()), pa.array([pairs[order].tobytes()], pa.binary()), pa.array([n[order].tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(row, ["block", "pairs", "n"])

    # a task holds a block: at most the square of the classes over BLOCKS, whatever the corpus
    dealt = counted.withColumn("block", (F.floor(F.col("pair") / table.classes) % BLOCKS).cast("int")).repartitionById(BLOCKS, F.col("block"))
    out = materialize(map_batches(dealt, pack, "block int, pairs binary, n binary"), "lm-pairs")
    bound.destroy()
    return out


def _pair_rows(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])


def _gradient_rows(row: dict, model: Model, log_noise: np.ndarray, classes: int) -> pa.RecordBatch:
    """Gradient of a block, as bytes: of its contexts' q, and of r and b."""
    pairs, n = np.frombuffer(row["pairs"], np.int64), np.frombuffer(row["n"], np.int64)
    contexts, starts = np.unique(pairs // classes, return_index=True)
    starts = np.append(starts, len(pairs))
    of_q, of_r, of_b = [], np.zeros_like(model.r, dtype=np.float64), np.zeros(classes)
    for k in range(0, len(contexts), 64):
        some = contexts[k : k + 64]
        part = slice(starts[k], starts[min(k + 64, len(contexts))])
        counts = np.zeros((len(some), classes), dtype=np.float32)
        counts[np.searchsorted(some, pairs[part] // classes), pairs[part] % classes] = n[part]
        q, r, b = nce_gradient(model, log_noise, some, counts)
        of_q.append(q)
        of_r += r
        of_b += b
    values = (contexts, np.concatenate(of_q).astype(np.float32), of_r.astype(np.float32), of_b)
    names = ["block", "contexts", "q", "r", "b"]
    return pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in values)], names)


def train(texts: DataFrame, table: Table) -> Model:
    """Trains on the pairs of all rows. A round brings the driver BLOCKS rows of as many numbers as r has."""
    pairs, context = pair_counts(texts, table), texts.sparkSession.sparkContext
    classes = table.classes
    seen = np.zeros((2, classes))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                key, n = np.frombuffer(row["pairs"], np.int64), np.frombuffer(row["n"], np.int64)
                sums = [np.bincount(k, weights=n, minlength=classes).tobytes() for k in (key // classes, key % classes)]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in sums], ["v", "w"])

    for r in map_batches(pairs, totals, "v binary, w binary").collect():
        seen += np.stack([np.frombuffer(bytes(x), np.float64) for x in (r.v, r.w)])
    model = Model.start(table.unigram, seen[0] > 0)
    log_noise = (np.log(table.unigram) + math.log(NOISE)).astype(np.float32)
    steady = (seen + STEADY).astype(np.float32)
    adam = Adam([model.q, model.r, model.b])
    for step in range(ROUNDS if seen.any() else 0):
        bound = context.broadcast((model, log_noise))

        def run(batches: Iterator[pa.RecordBatch], bound=bound) -> Iterator[pa.RecordBatch]:
            now, noise = bound.value
            for batch in batches:
                for row in batch.to_pylist():
                    yield _gradient_rows(row, now, noise, classes)

        found = map_batches(pairs, run, "block int, contexts binary, q binary, r binary, b binary").collect()
        bound.destroy()
        grads = [np.zeros_like(model.q), np.zeros(model.r.shape), np.zeros(classes)]
        for row in sorted(found, key=lambda x: x.block):
            grads[0][np.frombuffer(bytes(row.contexts), np.int64)] = np.frombuffer(bytes(row.q), np.float32).reshape(-1, WIDTH)
            grads[1] += np.frombuffer(bytes(row.r), np.float32).reshape(-1, WIDTH)
            grads[2] += np.frombuffer(bytes(row.b), np.float64)
        adam.step([grads[0] / steady[0][:, None], (grads[1] / steady[1][:, None]).astype(np.float32), (grads[2] / steady[1]).astype(np.float32)], RATE * math.sqrt(1 - step / ROUNDS))
    return model.normalise()


def _first_pass(slim: DataFrame, table: Table, model: Model) -> DataFrame:
    """Scores but for the words outside the table, which come along with their numbers."""
    bound = slim.sparkSession.sparkContext.broadcast((table, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, fitted = bound.value
        places = numbers(words)
        # log10 of the add-half probability of each word of the table; of one outside it but for its count; of the end
        base = np.concatenate((np.log10((words.counts + 0.5) / words.base_total), [-math.log10(words.base_total), math.log10((words.end_count + 0.5) / words.base_total)]))
        mass = np.log10(words.mass, out=np.zeros(words.classes), where=words.mass > 0)
        alone = words.class_of[: words.size] <= words.frequent
        # of a word's share of its class
        share = np.concatenate((np.where(alone, 0.0, np.log10(words.counts + 0.5) - mass[words.class_of[: words.size]]), [0.0, 0.0]))
        known = np.concatenate((np.ones(words.size, np.int64), [0, words.end_count > 0]))
        first, done = TaskContext.get().partitionId() << 33, 0
        for batch in merged(batches, "text", 2 << 20):
            at, now, counts, outside = _tokens(batch.column("text").to_pylist(), places, words)
            starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
            logs = fitted.logs(_before(now), now) / math.log(10) + share[at] - np.where(at == words.size, mass[now], 0.0)
            rare = [Counter(x) for x in outside]
            kinds = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(first + done + np.arange(batch.num_rows)),
                    batch.column("id"),
                    batch.column("learn"),
                    pa.array(counts),
                    pa.array(np.add.reduceat(known[at], starts)),
                    pa.array(np.add.reduceat(base[at], starts)),
                    pa.array(np.add.reduceat(logs, starts)),
                    pa.array([[{"word": w, "times": n} for w, n in c.items()] for c in rare], kinds),
                ],
                ["row", "id", "learn", "n_tokens", "n_known", "base_score", "score", "rare"],
            )
            done += batch.num_rows

    schema = "row long, id long, learn boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<word:binary,times:long>>"
    return map_batches(slim, run, schema)


def fit(texts: DataFrame) -> tuple[DataFrame, Table, Model]:
    """Counts and trains on all rows of texts; the counts stay in the shared folder."""
    counts = materialize(word_counts(texts), "lm-counts")
    is_end = F.col("word") == F.lit(END)
    kind = F.when(~is_end, F.pmod(F.crc32(F.substring("word", -ENDING_BYTES, ENDING_BYTES)), F.lit(ENDINGS)))
    sums = counts.groupBy(kind.alias("kind")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()  # a row for each ending class
    top = counts.where(~is_end).orderBy(F.desc("n"), "word").limit(TOP).unionByName(counts.where(is_end)).toArrow()
    by_ending = {r.kind: (r.n, r.v) for r in sums if r.kind is not None}
    table = Table(top["word"].to_pylist(), top["n"].to_pylist(), sum(r.n for r in sums), sum(r.v for r in sums), by_ending)
    return counts, table, train(texts, table)


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from the rows where ``learn`` holds and scores all: id, held_out, n_tokens, n_known, train_tokens,
    base_score and score (log10)."""
    slim = _slim(docs, id_col, text_col, learn)
    counts, table, model = fit(slim.where("learn"))
    first = materialize(_first_pass(slim, table, model), "lm-scores")
    words = first.select("row", F.explode("rare").alias("w")).select("row", F.col("w.word").alias("word"), F.col("w.times").alias("times"))
    found = words.join(counts, "word", "left")
    c = F.coalesce(F.col("n"), F.lit(0))
    rest = found.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10(c + 0.5)).alias("more"),
    )
    both = first.drop("rare").join(rest, "row", "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    return both.select(
        "id",
        (~F.col("learn")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + zero("more_known")).alias("n_known"),
        F.lit(table.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero("more")).alias("base_score"),
        (F.col("score") + zero("more")).alias("score"),
    )


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5: rows of remainder 1 are held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5, F.lit(0))


def op10_lm(spark, sf_dir: str) -> DataFrame:
    """Every document; learned from those that are not held out."""
    from quelora.llm.common import table

    return score(table(spark, sf_dir, "documents"), fold() != 1).withColumnRenamed("id", "doc_id")
