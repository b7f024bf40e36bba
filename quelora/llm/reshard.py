"""Resharding by minimum-cost flow.

Old shards hold blocks of rows; new shards have capacities. A flow network carries each block's rows from its old
shard either to the new shard of the same number, at no cost, or through a hub to any other, at the block's bytes a
row; its cheapest flow moves the fewest bytes. It is solved on the driver, from a table with
a row for each old shard, kind and size class (at most ``OLD_SHARDS`` times about 400, whatever the data).

The law is ``rows``: capacities differ by one row at most, and the shards that keep the larger ones are chosen by the
flow. Within an old shard rows are numbered by kind, size class, hash part, then size, so what leaves is its smallest
rows, and a new shard is made of a few runs of such numbers; slots follow from the runs. Costs are the blocks' own mean
bytes to a 32nd of an octave. A class of many rows has several parts, so a hot class or shard is numbered by many tasks;
the table of blocks that is broadcast has at most ``BLOCKS`` rows besides one for each class.

Copies of a text are a group and are kept together: their home is the old shard that the text's hash names, they are a
kind of their own that leaves only when all other rows of the shard have left, and they are numbered side by side. So a
group is split only if its home has more rows of groups than a new shard holds (a group larger than a shard has to be),
or at one of the few cuts between the runs of such a shard. Whether a row belongs to a group is looked up in a filter of
fixed size: beyond some million groups some single rows count as groups as well, which costs bytes and splits none.

``reshard`` writes the shards whose rows change as files, a folder each, in slot order within a file, and leaves the
others where they are. Texts move once.

Defined results: a null text has 0 bytes; null ids are placed like any other; equal rows are interchangeable; an empty
table gives no rows; columns beside id, text and the old shard are carried into the files unless their names clash
with those the operator adds, which win. A null old shard counts as 0.
"""

from __future__ import annotations

import dataclasses
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quelora.llm.common import map_batches, materialize, scratch

OLD_SHARDS = 32
NEW_SHARDS = 40
ROW_BYTES = 16
#: Rows of a block, at least, and the blocks that the rows are cut into beside their classes, at most.
BLOCK_ROWS = 200_000
BLOCKS = 100_000
#: 64-bit words of the filter that knows the texts of several rows.
FILTER_WORDS = 1 << 18
#: Bytes that a task deals out, about, and the most tasks.
TASK_BYTES = 8 << 20
TASKS = 100_000
#: Columns that the operator adds; those of the input with these names are replaced.
ADDED = ("old_shard", "home", "size", "kind", "class", "part", "first", "task", "copy", "identity", "shard", "slot", "word", "bits")


class Flow:
    """Minimum-cost flow by the primal-dual method: shortest distances, then a blocking flow; costs must not be negative."""

    def __init__(self, nodes: int):
        self.edges: list[list[float]] = []  # to, capacity left, cost
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def edge(self, a: int, b: int, capacity: int, cost: float) -> int:
        self.out[a].append(len(self.edges))
        self.edges.append([b, capacity, cost])
        self.out[b].append(len(self.edges))
        self.edges.append([a, 0, -cost])
        return len(self.edges) - 2

    def run(self, source: int, sink: int) -> float:
        """Sends all it can at the least cost; gives the cost. Each round finds the cheapest distance and fills all
        paths of that distance, so there are as many rounds as there are costs of paths."""
        n, total = len(self.out), 0.0
        level = [0.0] * n
        while True:
            far = [float("inf")] * n
            far[source], heap = 0.0, [(0.0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > far[a]:
                    continue
                for e in self.out[a]:
                    b, left, cost = self.edges[e]
                    if left > 0 and (t := d + cost + level[a] - level[b]) < far[b] - 1e-6:
                        far[b] = t
                        heapq.heappush(heap, (t, b))
            if far[sink] == float("inf"):
                return total
            level = [x + min(f, far[sink]) for x, f in zip(level, far, strict=True)]
            total += self._fill(source, sink, level)

    def _fill(self, source: int, sink: int, level: list[float]) -> float:
        """Sends all it can along edges without reduced cost; gives the cost."""
        total, nearer = 0.0, [0] * len(self.out)
        path: list[int] = []
        inside = {source}
        at = source
        while True:
            if at == sink:
                push = min(self.edges[e][1] for e in path)
                for e in path:
                    self.edges[e][1] -= push
                    self.edges[e ^ 1][1] += push
                    total += push * self.edges[e][2]
                path, inside, at = [], {source}, source
                continue
            while nearer[at] < len(self.out[at]):
                b, left, cost = self.edges[self.out[at][nearer[at]]]
                if left > 0 and b not in inside and abs(cost + level[at] - level[b]) < 1e-6:
                    break
                nearer[at] += 1
            else:
                if not path:
                    return total
                inside.discard(at)
                at = int(self.edges[path.pop() ^ 1][0])
                nearer[at] += 1
                continue
            path.append(self.out[at][nearer[at]])
            at = int(b)
            inside.add(at)

    def sent(self, e: int) -> int:
        return int(self.edges[e ^ 1][1])


#: Numbers of blocks of groups begin here, above those of all size classes; what moving a row of a group costs more.
GROUPED = 1024
SPLIT = float(1 << 24)


def _cost(size: float) -> float:
    """Bytes a row to a 32nd of an octave, so that few costs differ."""
    return 2.0 ** (round(math.log2(max(size, 1.0)) * 32) / 32)


def capacities(total: int, shards: int) -> tuple[int, int]:
    """Rows of every shard at least, and how many shards hold one more."""
    return total // shards, total % shards


def solve(blocks: list[tuple[int, int, int, int]], new: int, total: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(rows kept, rows moved) of each block (old shard, number of its kind and class, rows, bytes), and under (-1, j)
    the size of shard j. Rows of groups cost more than all others."""
    least, larger = capacities(total, new)
    n = len(blocks)
    source, hub, sink, extra = n, n + 1, n + 2, n + 3
    first = n + 4
    flow = Flow(first + new)
    stay, move, into = [], [], []
    for k, (old, c, rows, size) in enumerate(blocks):
        flow.edge(source, k, rows, 0)
        cost = _cost(size / rows) + (SPLIT if c >= GROUPED else 0)
        stay.append(flow.edge(k, first + old, rows, 0) if old < new else None)
        move.append(flow.edge(k, hub, rows, cost))
    for j in range(new):
        flow.edge(hub, first + j, total, 0)
        into.append((flow.edge(first + j, sink, least, 0), flow.edge(first + j, extra, 1, 0)))
    flow.edge(extra, sink, larger, 0)
    flow.run(source, sink)
    out = {(old, c): (flow.sent(s) if s is not None else 0, flow.sent(m)) for (old, c, _, _), s, m in zip(blocks, stay, move, strict=True)}
    return out | {(-1, j): (flow.sent(a) + flow.sent(b), 0) for j, (a, b) in enumerate(into)}


def transfers(blocks: list[tuple[int, int, int, int]], new: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (old shard, first number, end, new shard, slot of the first) that place every row of the blocks."""
    total = sum(b[2] for b in blocks)
    if not total:
        return []
    blocks = sorted(blocks)
    plan = solve(blocks, new, total)
    leave, held = {}, {}
    for old, c, rows, _ in blocks:
        leave[old] = leave.get(old, 0) + plan[old, c][1]
        held[old] = held.get(old, 0) + rows
    runs, filled = [], [0] * new
    for old in sorted(held):  # what stays has the largest numbers and the first slots
        if held[old] > leave[old]:
            runs.append((old, leave[old], held[old], old, 0))
            filled[old] = held[old] - leave[old]
    target = 0
    for old in sorted(held):
        at = 0
        while at < leave[old]:
            while filled[target] >= plan[-1, target][0]:
                target += 1
            n = min(leave[old] - at, plan[-1, target][0] - filled[target])
            runs.append((old, at, at + n, target, filled[target]))
            filled[target] += n
            at += n
    return runs


def size_class(size: Column) -> Column:
    """Eight classes an octave: rows of a class differ by an eighth in size at most."""
    octave = F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int")
    part = F.floor((F.greatest(size, F.lit(1)) / F.pow(F.lit(2.0), octave) - 1) * 8).cast("int")
    return octave * 8 + part


@dataclasses.dataclass(frozen=True)
class Plan:
    """runs: as transfers() gives them; blocks: (home, kind and class, part, number of the first row, task); parts: of
    each home and class; tasks: how many deal out the rows."""

    runs: list[tuple[int, int, int, int, int]]
    blocks: list[tuple[int, int, int, int, int]]
    parts: dict[tuple[int, int], int]
    tasks: int


def _copies(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, bits): the filter of the texts that several rows have."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    hashes = docs.select(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    at = hashes.where("n > 1").select(*_place_in_filter(F.col("a")))
    return materialize(at.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")), "reshard-copies")


def _place_in_filter(key: Column) -> tuple[Column, Column]:
    return F.pmod(F.shiftright(key, 6), F.lit(FILTER_WORDS)).alias("word"), key.bitwiseAND(F.lit(63)).cast("int").alias("bit")


def _keyed(docs: DataFrame, old: Column, id_col: str, text_col: str, copies: DataFrame, shards: int) -> DataFrame:
    """docs with old shard, home, size, number of kind and size class, the text's hash and identity."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED]
    word, bit = _place_in_filter(F.col("copy"))
    rows = docs.select(*kept, old.cast("int").alias("old_shard"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.xxhash64(text).alias("copy"))
    # the filter has FILTER_WORDS rows at most
    rows = rows.withColumn("identity", F.xxhash64(F.col(f"`{id_col}`"), "copy")).withColumn("word", word).join(F.broadcast(copies), "word", "left")
    grouped = F.coalesce(F.expr("shiftrightunsigned(bits, CAST(copy & 63 AS INT)) & 1") == 1, F.lit(False))
    number = size_class(F.col("size")) + F.when(grouped, GROUPED).otherwise(0)
    home = F.when(grouped, home_of(F.col("copy"), shards)).otherwise(F.col("old_shard"))
    return rows.withColumns({"class": number.cast("int"), "home": home.cast("int")}).drop("word", "bits")


def home_of(copy: Column, shards: int) -> Column:
    """The old shard where the copies of a text belong; copy: xxhash64 of the text."""
    return F.pmod(copy, F.lit(shards)).cast("int")


def _with_part(rows: DataFrame, parts: dict[tuple[int, int], int]) -> DataFrame:
    """Adds the hash part; only classes of many rows have several. Copies are in one part but in a class of too many."""
    several = [n for n in parts.values() if n > 1]
    if not several:
        return rows.withColumn("part", F.lit(0))
    table = rows.sparkSession.createDataFrame([(o, c, n) for (o, c), n in parts.items()], "home int, class int, parts int")
    spread = F.pmod(F.xxhash64("identity", "size"), F.col("parts")).cast("int")
    return rows.join(F.broadcast(table), ["home", "class"]).withColumn("part", spread).drop("parts")


def plan(docs: DataFrame, old: Column, new: int = NEW_SHARDS, id_col: str = "doc_id", text_col: str = "text", copies: DataFrame | None = None, shards: int = OLD_SHARDS) -> Plan:
    """Counts the blocks (light rows, no text moves) and solves the flow. old: the shard so far, an int from 0."""
    copies = _copies(docs, text_col) if copies is None else copies
    rows = _keyed(docs, old, id_col, text_col, copies, shards)
    sums = rows.groupBy("home", "class").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()
    block_rows = max(BLOCK_ROWS, sum(r.n for r in sums) // BLOCKS)
    parts = {(r.home, r["class"]): -(-r.n // block_rows) for r in sums}
    counts = sorted((r.home, r["class"], 0, r.n, r.bytes) for r in sums)
    if max(parts.values(), default=1) > 1:
        found = _with_part(rows, parts).groupBy("home", "class", "part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
        counts = sorted((r.home, r["class"], r.part, r.n, r.bytes) for r in found.collect())
    a_task = max(TASK_BYTES, sum(c[4] for c in counts) // TASKS)
    blocks, first, at = [], 0, 0
    for k, (o, c, part, n, size) in enumerate(counts):
        first = 0 if k == 0 or counts[k - 1][0] != o else first
        blocks.append((o, c, part, first, at // a_task))
        first += n
        at += size
    runs = transfers([(r.home, r["class"], r.n, r.bytes) for r in sums], new)
    return Plan(runs, blocks, parts, blocks[-1][4] + 1 if blocks else 1)


def place(docs: DataFrame, old: Column, found: Plan, id_col: str = "doc_id", text_col: str = "text", copies: DataFrame | None = None, shards: int = OLD_SHARDS) -> DataFrame:
    """Adds old_shard, size, shard and slot to every row, in one shuffle: a task gets neighbouring blocks, numbers
    their rows in order and looks the numbers up in the runs."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    table = spark.createDataFrame(found.blocks, "home int, class int, part int, first long, task int")
    copies = _copies(docs, text_col) if copies is None else copies
    rows = _with_part(_keyed(docs, old, id_col, text_col, copies, shards), found.parts).join(F.broadcast(table), ["home", "class", "part"])
    dealt = rows.repartitionById(found.tasks, F.col("task")).sortWithinPartitions("home", "class", "part", "size", "copy", "identity")
    starts = np.array([(o, a) for o, a, *_ in sorted(found.runs)], dtype=np.int64).reshape(-1, 2)
    goal = np.array([(shard, base) for _, _, _, shard, base in sorted(found.runs)], dtype=np.int64).reshape(-1, 2)
    keys = starts[:, 0] << 44 | starts[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            block = np.stack([batch.column(c).to_numpy() for c in ("home", "class", "part")])
            new = np.concatenate(([last is None or tuple(block[:, 0]) != last], (np.diff(block) != 0).any(axis=0)))
            index = np.arange(batch.num_rows)
            begin = np.maximum.accumulate(np.where(new, index, -1))
            number = np.where(begin >= 0, index - begin, index + seen)
            last, seen = tuple(block[:, -1]), int(number[-1]) + 1
            number = number + batch.column("first").to_numpy()
            at = np.searchsorted(keys, block[0].astype(np.int64) << 44 | number, side="right") - 1
            slot = goal[at, 1] + number - starts[at, 1]
            columns = [batch.column(c) for c in (*kept, "old_shard", "size")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(goal[at, 0].astype(np.int32)), pa.array(slot)], [*kept, "old_shard", "size", "shard", "slot"])

    schema = T.StructType([rows.schema[c] for c in (*kept, "old_shard", "size")]).add("shard", T.IntegerType()).add("slot", T.LongType())
    return map_batches(dealt.select(*(F.col(f"`{c}`") for c in kept), "old_shard", "home", "size", "class", "part", "first"), run, schema)


def rewrite(placed: DataFrame, folder: str, only: list[int] | None = None) -> DataFrame:
    """Writes all shards (or only the affected ones), a folder each, and gives what the files hold. A task's rows are
    neighbours in their shard, so it writes a file or two."""
    rows = placed if only is None else placed.where(F.col("shard").isin(only))
    schema = T.StructType([f for f in rows.schema.fields if f.name != "shard"]).add("shard", T.IntegerType())
    rows.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(folder)
    return rows.sparkSession.read.schema(schema).parquet(folder)


def affected(placed: DataFrame) -> list[int]:
    """Shards whose rows are not just those of the old shard of the same number."""
    moved = placed.where("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct()
    return sorted(r.s for r in moved.collect())


def reshard(docs: DataFrame, old: Column, folder: str, new: int = NEW_SHARDS, id_col: str = "doc_id", text_col: str = "text", shards: int = OLD_SHARDS) -> DataFrame:
    """Plans and places all rows and writes the shards that change; gives what the new shards hold, from the files or,
    for the others, from where they are."""
    old = F.coalesce(old, F.lit(0))
    copies = _copies(docs, text_col)
    found = plan(docs, old, new, id_col, text_col, copies, shards)
    placed = place(docs, old, found, id_col, text_col, copies, shards)
    whole = unmoved(docs, old, found, text_col, copies, shards)
    if not whole:
        return rewrite(placed, folder)
    changed = [k for k in range(new) if k not in whole]
    files = rewrite(placed, folder, only=changed) if changed else placed.limit(0)
    return files.unionByName(placed.where(F.col("shard").isin(whole)))


def unmoved(docs: DataFrame, old: Column, found: Plan, text_col: str, copies: DataFrame, shards: int) -> list[int]:
    """New shards that hold just the rows of the old shard of their number."""
    into: dict[int, list[tuple]] = {}
    for run in found.runs:
        into.setdefault(run[3], []).append(run)
    out_of = {run[0] for run in found.runs if run[0] != run[3]}
    same = [j for j, runs in into.items() if [r[0] for r in runs] == [j] and j not in out_of]
    if not same:
        return []
    keyed = _keyed(docs.select(F.col(f"`{text_col}`"), old.alias("old_shard")), F.col("old_shard"), text_col, text_col, copies, shards)
    homed = keyed.where("home <> old_shard").select(F.explode(F.array("home", "old_shard")).alias("s")).distinct().collect()  # shards
    return sorted(set(same) - {r.s for r in homed})


def op8_reshard(spark, sf_dir: str) -> DataFrame:
    """Every document, from 32 shards by the text's hash to 40, the law of rows."""
    from quelora.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    files = reshard(docs, home_of(F.xxhash64(text), OLD_SHARDS), scratch(spark, "shards"))
    return files.select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
