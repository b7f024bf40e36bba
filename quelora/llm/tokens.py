"""Token ids in fixed-width bit-packed files.

Every id takes the minimum number of bits for the vocabulary. A file holds blocks of ``BLOCK_IDS`` ids, then the
blocks' byte offsets, the documents' token offsets and their ids, and a trailer that says where these are. A block is
unpacked by one numpy call, and any document or token range is read by seeking to its blocks.

    payload blocks | block offsets u64 | document starts u64 (one more than documents) | document ids i64 |
    null flags u8 for each document | trailer (struct TRAILER, little endian)

Files hold documents in ascending id order (nulls first; equal ids by number of tokens, then by the text's hash), and
their names are in that order too. The range of each file comes from quantiles of the ids, so the texts are tokenised
before the shuffle and only packed ids move. A file is written under a temporary name and renamed, so a task that
runs again replaces it by the same bytes. Reading is one task for each file.

A cache of words spares the tokenizer most of its work: ids of a text are those of its parts between spaces and line
feeds, as the tokenizer drops white space and never joins across it.

Defined results: null texts count as empty and hold the end id alone; repeated rows are all stored; an empty table
gives no files; other columns are not read.
"""

from __future__ import annotations

import array
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quelora.llm.common import merged, scratch

TRAILER = struct.Struct("<8sIIQQQQQ")
MAGIC = b"QTOKENS1"
BLOCK_IDS = 1 << 16
END_ID = 1
#: Rows of a file, about, and the most files that a table is cut into.
FILE_ROWS = 8192
FILES = 10_000
#: Distinct parts that a task remembers between blocks, and the length from which a part isn't remembered.
REMEMBERED = 400_000
LONG_PART = 100


def min_bits(vocabulary: int) -> int:
    """Bits of the largest id."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive big-endian fields of ``bits`` bits, padded to a byte."""
    out = []
    if bits % 8 == 0:
        return ids.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - bits // 8 :].tobytes()
    for start in range(0, len(ids), BLOCK_IDS):  # a multiple of 8 ids fills whole bytes
        raw = ids[start : start + BLOCK_IDS].astype(">u4").view(np.uint8).reshape(-1, 4)
        out.append(np.packbits(np.unpackbits(raw, axis=1)[:, 32 - bits :]).tobytes())
    return b"".join(out)


def unpack(raw: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of what pack() gave."""
    if bits % 8 == 0:
        fields = np.zeros((count, 4), dtype=np.uint8)
        fields[:, 4 - bits // 8 :] = np.frombuffer(raw, np.uint8, count=count * bits // 8).reshape(count, bits // 8)
        return fields.view(">u4").ravel().astype("<u4")
    out = np.empty(count, dtype="<u4")
    for start in range(0, count, BLOCK_IDS):
        n = min(BLOCK_IDS, count - start)
        part = np.frombuffer(raw, np.uint8, count=(n * bits + 7) // 8, offset=start * bits // 8)
        fields = np.zeros((n, 32), dtype=np.uint8)
        fields[:, 32 - bits :] = np.unpackbits(part, count=n * bits).reshape(n, bits)
        out[start : start + n] = np.packbits(fields, axis=1).view(">u4").ravel()
    return out


class TokenWriter:
    """Streams documents into one file; holds a block of ids and the documents' offsets."""

    def __init__(self, sink, bits: int):
        self.sink, self.bits = sink, bits
        self.at, self.n_tokens = 0, 0
        self.blocks: list[int] = []
        self.starts, self.ids, self.nulls = [0], [], []
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.n_tokens += len(ids)
        self.starts.append(self.n_tokens)
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK_IDS:
            self._flush(BLOCK_IDS)

    def _flush(self, least: int) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        start = 0
        while len(flat) - start >= max(1, least):
            raw = pack(flat[start : start + BLOCK_IDS], self.bits)
            self.blocks.append(self.at)
            self.sink.write(raw)
            self.at += len(raw)
            start += BLOCK_IDS
        self.held = [flat[start:].copy()]
        self.n_held = len(self.held[0])

    def close(self) -> None:
        self._flush(0)
        tables = (np.array(self.blocks, "<u8"), np.array(self.starts, "<u8"), np.array(self.ids, "<i8"), np.array(self.nulls, np.uint8))
        for table in tables:
            self.sink.write(table.tobytes())
        self.sink.write(TRAILER.pack(MAGIC, self.bits, BLOCK_IDS, self.n_tokens, len(self.ids), len(self.blocks), self.at, 0))


class TokenFile:
    """Random access to a file that TokenWriter wrote; source: a seekable binary file."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        self._seek(size - TRAILER.size)
        magic, self.bits, self.block_ids, self.n_tokens, self.n_docs, n_blocks, tables, _ = TRAILER.unpack(source.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self._seek(tables)
        self.blocks = np.frombuffer(source.read(8 * n_blocks), "<u8")
        self.starts = np.frombuffer(source.read(8 * (self.n_docs + 1)), "<u8").astype(np.int64)
        self.ids = np.frombuffer(source.read(8 * self.n_docs), "<i8")
        self.nulls = np.frombuffer(source.read(self.n_docs), np.uint8).astype(bool)

    def _seek(self, at: int) -> None:
        self.source.seek(int(at))

    def block(self, k: int) -> np.ndarray:
        count = min(self.block_ids, self.n_tokens - k * self.block_ids)
        self._seek(self.blocks[k])
        return unpack(self.source.read((count * self.bits + 7) // 8), self.bits, count)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids of a range of the file's tokens, from the blocks that hold them."""
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        flat = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return flat[start - first * self.block_ids : stop - first * self.block_ids]

    def doc(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))

    def docs(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(id, ids) of all documents in order; each block is unpacked once."""
        held, first = np.zeros(0, "<u4"), 0  # ids from token ``first`` on
        following = 0
        for k in range(self.n_docs):
            start, stop = int(self.starts[k]), int(self.starts[k + 1])
            parts = [held[start - first :]]
            while following * self.block_ids < stop:
                parts.append(self.block(following))
                following += 1
            if len(parts) > 1 or start - first > self.block_ids:
                held, first = np.concatenate(parts), start
            yield (None if self.nulls[k] else int(self.ids[k])), held[start - first : stop - first]


def _byte_letters() -> dict[int, str]:
    """Code points by which byte-level tokenizers write the bytes that aren't printable; other bytes are their own."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()
#: Marks that may end a plain part: neither letters, digits, white space nor the apostrophe of a contraction.
MARKS = ".,;:!?|#*$%&-+=/()[]{}\"_~@^"


class Parts(dict):
    """Ids (little-endian 32-bit) of the parts between spaces, each computed when it is first asked for.

    The library normalises, splits and merges. Its split makes one piece of a run of letters and one of a run of marks,
    so a plain part (Latin letters, then marks) is given to its merge model as these pieces, lower-cased; it need not
    be normalised. All other parts go through the whole tokenizer."""

    def __init__(self, library):
        super().__init__({"": b""})
        self.library, self.model = library, library.model
        self.pieces: dict[str, bytes] = {"": b""}

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_LETTERS)
            found = _raw([t.id for t in self.model.tokenize(shown)])
            if len(piece) <= LONG_PART:
                self.pieces[piece] = found
        return found

    def __missing__(self, part: str) -> bytes:
        core = part.rstrip(MARKS)
        if not core or (core.isalpha() and max(core) <= "\xff"):
            found = self._piece(core.lower()) + self._piece(part[len(core) :])
        else:
            found = _raw(self.library.encode(part, add_special_tokens=False).ids)
        if len(part) <= LONG_PART:
            self[part] = found
        return found


def _raw(ids: list[int]) -> bytes:
    return array.array("I", ids).tobytes() if sys.byteorder == "little" and array.array("I").itemsize == 4 else np.array(ids, "<u4").tobytes()


class Tokenizer:
    """Ids of texts by the tokenizers library, with the parts between spaces remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        self.parts = Parts(Library.from_file(path))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.parts) > REMEMBERED:
            self.parts = Parts(self.parts.library)
        look = self.parts.__getitem__
        return [b"".join(map(look, (t or "").replace("\n", " ").split(" "))) for t in texts]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer as Library

    return Library.from_file(path).get_vocab_size(with_added_tokens=True)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI or local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def write_tokens(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Tokenises all rows and writes the files to ``folder``. Gives a row for each file, in order: shard, file,
    n_docs, n_tokens and start, the number of ids in all files before it."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    bits = min_bits(max(vocabulary_size(path), end_id + 1))
    rows = slim.count()
    shards = max(1, min(FILES, -(-rows // FILE_ROWS)))
    cuts = []
    if shards > 1:
        cuts = slim.select(F.percentile_approx("id", [k / shards for k in range(1, shards)], 100 * shards)).first()[0] or []
    bounds = np.array(cuts, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = Tokenizer(path), np.array([end_id], "<u4").tobytes()
        for batch in merged(batches, "text", 2 << 20):
            ids = batch.column("id")
            found = [np.frombuffer(x + end, "<u4") for x in tokenizer.encode(batch.column("text").to_pylist())]
            at = np.searchsorted(bounds, ids.fill_null(np.iinfo(np.int64).min).to_numpy())
            columns = [
                pa.array(at.astype(np.int32)),
                ids,
                batch.column("tie"),
                pa.array([len(x) for x in found], pa.int64()),
                pa.array([pack(x, bits) for x in found], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "id", "tie", "n", "packed"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, names = None, None
        for batch in batches:
            for shard, doc, n, packed in zip(*(batch.column(c).to_pylist() for c in ("shard", "id", "n", "packed")), strict=True):
                if writer is None:
                    fs, base = filesystem(folder)
                    fs.create_dir(base, recursive=True)
                    final = f"{base}/tokens-{shard:05d}.qtok"
                    names = (fs, f"{final}.{uuid.uuid4().hex}", final, shard)
                    writer = TokenWriter(fs.open_output_stream(names[1]), bits)
                writer.add(doc, unpack(packed, bits, n))
        if writer is not None:
            writer.close()
            writer.sink.close()
            fs, temporary, final, shard = names
            if fs.type_name != "local" and fs.get_file_info(final).type.name == "File":
                fs.delete_file(final)
            fs.move(temporary, final)
            name = final.rsplit("/", 1)[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([len(writer.ids)], pa.int64()), pa.array([writer.n_tokens], pa.int64())],
                ["shard", "file", "n_docs", "n_tokens"],
            )

    packed = slim.withColumn("tie", F.xxhash64("text")).mapInArrow(run, "shard int, id long, tie long, n long, packed binary")
    dealt = packed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "id", "n", "tie")
    written = dealt.mapInArrow(write, "shard int, file string, n_docs long, n_tokens long").collect()  # at most FILES rows
    start, out = 0, []
    for r in sorted(written, key=lambda r: r.shard):
        out.append((r.shard, r.file, r.n_docs, r.n_tokens, start))
        start += r.n_tokens
    return spark.createDataFrame(out, "shard int, file string, n_docs long, n_tokens long, start long")


def read_tokens(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """A row for each document of the files: id, start (ids of all documents before it), n_tokens, ids_crc32 (unsigned, of the ids as
    little-endian 32-bit integers) and, with_ids, the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, at = filesystem(file)
                with fs.open_input_file(at) as source:
                    tokens = TokenFile(source)
                    rows, size = [], 0
                    for k, (doc, ids) in enumerate(tokens.docs()):
                        crc = zlib.crc32(ids.astype("<u4").tobytes())
                        rows.append((doc, base + int(tokens.starts[k]), len(ids), crc, ids.astype(np.int64) if with_ids else None))
                        size += len(ids) if with_ids else 1
                        if size > 1 << 20:
                            yield _rows(rows, with_ids)
                            rows, size = [], 0
                    if rows:
                        yield _rows(rows, with_ids)

    n = max(1, files.count())
    dealt = files.withColumn("k", (F.row_number().over(_by_shard()) - 1).cast("int")).repartitionById(n, F.col("k")).select("file", "start")
    return dealt.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def _by_shard():
    from pyspark.sql import Window

    return Window.orderBy("shard")


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    arrays = [pa.array(c, pa.int64()) for c in columns[:4]]
    names = ["id", "start", "n_tokens", "ids_crc32"]
    if with_ids:
        arrays.append(pa.array(list(columns[4]), pa.list_(pa.int64())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names)


def op1_tokens(spark, sf_dir: str) -> DataFrame:
    """Every document, written and read back."""
    import public_tokenizers

    from quelora.llm.common import table

    files = write_tokens(table(spark, sf_dir, "documents"), scratch(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(files, with_ids=False).withColumnRenamed("id", "doc_id")
