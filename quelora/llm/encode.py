"""SentencePiece encoding and decoding by Viterbi with shared prefixes.

A text is marked with a leading space and cut before each line feed and each run of spaces: no piece of the vocabulary
holds a space after other characters or a line feed, so the best segmentation of the text is that of its parts. The distinct parts
of a block are sorted, which is the depth-first order of their trie; the forward scores of a common prefix are kept
from one word to the next, and only the positions that follow it are computed. Characters without a piece become
byte pieces, so decoding gives back every text exactly.

The scores are the vocabulary's Zipf log-probabilities (see pieces.py). Between segmentations of equal score the one
whose last piece is longest wins, and so on from the end.

Defined results: a null text encodes as null and decodes as null; an empty text is the mark alone; repeated rows
each get a result; all other columns are carried along by ``encode`` unless they are named like its outputs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quelora.llm.common import map_batches, merged
from quelora.llm.pieces import Vocabulary, model_path, vocabulary

#: Distinct parts that a task remembers between blocks.
REMEMBERED = 150_000
#: Text bytes that are encoded at a time.
BLOCK_BYTES = 2 << 20
_PARTS = re.compile("(?: +|\n)[^ \n]*")


def parts(text: str) -> list[str]:
    """The marked text, cut before each line feed and each run of spaces."""
    marked = " " + text
    if "\x00" in marked or "  " in marked:
        return _PARTS.findall(marked)
    return marked.replace("\n", "\x00\n").replace(" ", "\x00 ").split("\x00")[1:]


def viterbi(words: Iterable[str], vocab: Vocabulary) -> dict[str, list[int]]:
    """Best segmentation of each distinct word, by a walk over their sorted order."""
    ids, logp, longest = vocab.ids, vocab.logp.tolist(), vocab.longest
    scores, back, starts = [0.0], [()], [0]  # for each prefix: best score, last piece's ids, where that piece starts
    found, last = {}, ""
    for word in sorted(words):
        shared, most = 0, min(len(word), len(last))
        while shared < most and word[shared] == last[shared]:
            shared += 1
        del scores[shared + 1 :], back[shared + 1 :], starts[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            best, piece, at = -1e300, (), 0
            for start in range(max(0, end - longest), end):
                number = ids.get(word[start:end])
                if number is not None and scores[start] + logp[number] > best:
                    best, piece, at = scores[start] + logp[number], (number,), start
            if word[end - 1] not in ids:
                raw = [int(vocab.byte_ids[b]) for b in word[end - 1].encode("utf-8", "surrogatepass")]
                value = scores[end - 1] + sum(logp[b] for b in raw)
                if value > best:
                    best, piece, at = value, tuple(raw), end - 1
            scores.append(best)
            back.append(piece)
            starts.append(at)
        out, end = [], len(word)
        while end:
            out.append(back[end])
            end = starts[end]
        found[word] = [i for piece in reversed(out) for i in piece]
        last = word
    return found


class Encoder:
    """Encodes texts to the bytes of little-endian 32-bit ids, remembering the parts it has met."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        cut = [None if t is None else parts(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = {p for c in cut if c for p in c}.difference(self.known)
        for word, numbers in viterbi(new, self.vocab).items():
            self.known[word] = np.array(numbers, dtype="<u4").tobytes()
        return [None if c is None else b"".join(map(self.known.__getitem__, c)) for c in cut]

    def decode(self, numbers: np.ndarray) -> str:
        raw = b"".join(map(self.vocab.bytes_of.__getitem__, numbers.tolist()))
        return raw[1:].decode("utf-8", "surrogatepass")  # without the mark at the start


def _coded(found: list[bytes | None]) -> tuple[pa.ListArray, pa.Array, pa.Array]:
    """Ids, their numbers and the checksums of encoded texts."""
    ends = np.cumsum([0, *(len(x or b"") // 4 for x in found)])
    flat = np.frombuffer(b"".join(x or b"" for x in found), dtype="<u4").astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=pa.array([x is None for x in found]))
    counts = pa.array([None if x is None else len(x) // 4 for x in found], pa.int64())
    return lists, counts, pa.array([None if x is None else zlib.crc32(x) for x in found], pa.int64())


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """Adds piece_ids (array of int), n_pieces and ids_crc32 (unsigned, of the ids as little-endian 32-bit
    integers) to every row, in place of any columns of these names."""
    path = path or model_path()
    outputs = ["piece_ids", "n_pieces", "ids_crc32"]
    kept = [c for c in docs.columns if c.lower() not in outputs]
    source = docs.select(*(F.col(f"`{c}`") for c in kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in merged(batches, text_col, BLOCK_BYTES):
            lists, counts, sums = _coded(encoder.encode(batch.column(text_col).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, counts, sums], [*batch.schema.names, *outputs])

    schema = T.StructType(list(source.schema.fields))
    schema = schema.add("piece_ids", T.ArrayType(T.IntegerType())).add("n_pieces", T.LongType()).add("ids_crc32", T.LongType())
    return map_batches(source, run, schema)


def decode(rows: DataFrame, ids_col: str = "piece_ids", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Adds the text that the ids stand for, in place of any column of its name."""
    path = path or model_path()
    kept = [c for c in rows.columns if c.lower() != text_col.lower()]
    source = rows.select(*(F.col(f"`{c}`") for c in kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            column = batch.column(ids_col)
            values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            missing = column.is_null().to_pylist()
            texts = [None if m else encoder.decode(values[a:b]) for a, b, m in zip(ends[:-1], ends[1:], missing, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, text_col])

    return map_batches(source, run, T.StructType(list(source.schema.fields)).add(text_col, T.StringType()))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, piece_ids, n_pieces, ids_crc32, n_bytes and text_crc32 of the text that the ids decode to, and whether it is
    the given text. One pass of one worker: what is decoded is the ids that are returned."""
    path = path or model_path()
    slim = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("__text"))
    outputs = {"piece_ids": "array<int>", "n_pieces": "long", "ids_crc32": "long", "n_bytes": "long", "text_crc32": "long", "round_trip": "boolean"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in merged(batches, "__text", BLOCK_BYTES):
            texts = batch.column("__text").to_pylist()
            lists, counts, sums = _coded(encoder.encode(texts))
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            back = [None if t is None else encoder.decode(flat[ends[k] : ends[k + 1]]) for k, t in enumerate(texts)]
            raw = [None if t is None else t.encode("utf-8", "surrogatepass") for t in back]
            checks = [
                pa.array([None if x is None else len(x) for x in raw], pa.int64()),
                pa.array([None if x is None else zlib.crc32(x) for x in raw], pa.int64()),
                pa.array([x == t for x, t in zip(back, texts, strict=True)]),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, counts, sums, *checks], [id_col, *outputs])

    schema = T.StructType([slim.schema[0], *T.StructType.fromDDL(", ".join(f"{n} {k}" for n, k in outputs.items())).fields])
    return map_batches(slim, run, schema)


def op9_encode(spark, sf_dir: str) -> DataFrame:
    """Every document, encoded and decoded again."""
    from quelora.llm.common import table

    return round_trip(table(spark, sf_dir, "documents")).drop("piece_ids")
