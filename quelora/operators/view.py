"""The materialised view: the last revision of each aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quelora.schemas import CHANGELOG_FIELDS


def _pane() -> Column:
    return F.coalesce(F.col("pane_index"), F.lit(-1))


def latest(changes: DataFrame, arrival: list[str]) -> DataFrame:
    """The row of the highest pane of each id, the later arrival between equals. One partial aggregation, no sort."""
    best = F.max_by(F.struct(*changes.columns), F.struct(_pane(), *arrival))
    return changes.where("aggregate_id IS NOT NULL").groupBy("aggregate_id").agg(best.alias("r")).select("r.*")


def counters(changes: DataFrame, arrival: list[str]) -> DataFrame:
    """One row: messages seen, aggregates, revisions that replaced one, and those that came out of order."""
    before = Window.partitionBy("aggregate_id").orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    seen = changes.where("aggregate_id IS NOT NULL").select("aggregate_id", *arrival, _pane().alias("pane"))
    top = seen.withColumn("top", F.max("pane").over(before))
    return top.agg(
        F.count("*").alias("messages_seen"),
        F.count_if(F.col("top").isNull()).alias("aggregates"),
        F.count_if(F.col("pane") >= F.col("top")).alias("revisions_replaced"),
        F.count_if(F.col("pane") < F.col("top")).alias("out_of_order_ignored"),
    )


def dashboard(view: DataFrame) -> DataFrame:
    """The view's table for display: eleven text columns; blanks where a metric is of the other kind."""
    shown = lambda c, form=None: F.coalesce(F.format_string(form, F.col(c)) if form else F.col(c).cast("string"), F.lit(""))
    number = lambda c, form: F.when(F.col(c).isNull(), "").otherwise(shown(c, form))
    return view.select(
        F.substring("window_start", 12, 8).alias("window"),
        F.substring(F.replace("metric_type", F.lit("_"), F.lit(" ")), 1, 12).alias("metric"),
        F.substring("dimension_id", 1, 12).alias("dimension"),
        shown("pane_index").alias("pane"),
        shown("offered").alias("offered"),
        shown("connected").alias("connected"),
        shown("abandoned").alias("abandoned"),
        number("ns20", "%.2f").alias("ns20"),
        number("avg_wait_seconds", "%.1f").alias("avg_wait"),
        number("p90_wait_seconds", "%.1f").alias("p90_wait"),
        shown("transitions").alias("transitions"),
    )


def render(view: DataFrame, rows: int | None = None) -> str:
    """The display table as padded text, in order of window and id: all of it, or the first rows and how many there are."""
    ordered = dashboard(view.orderBy("window_start", "aggregate_id"))
    table = (ordered if rows is None else ordered.limit(rows)).toPandas()
    if table.empty:
        return "  (no aggregates)"
    every = len(table) if rows is None else view.count()
    return table.to_string(index=False) + (f"\n  ({len(table)} of {every} aggregates)" if every > len(table) else "")


class ViewStore:
    """The view as Parquet in buckets of ids; usable as ``foreachBatch``.

    A micro-batch writes the buckets that it changes, and then a manifest that names the version of every bucket. A batch
    that runs again starts from the manifest before its own and writes the same again, so replays converge. What the last
    two manifests don't name is deleted."""

    BUCKETS = 64

    def __init__(self, path: str):
        self.path = path

    def _files(self, spark):
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self, spark) -> list[int]:
        jvm, files = self._files(spark)
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        if not files.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in files.listStatus(folder) if s.getPath().getName().isdigit())

    def _manifest(self, spark, batch: int) -> dict[int, int]:
        """The version of each bucket."""
        rows = spark.read.text(f"{self.path}/manifests/{batch}").collect()  # at most BUCKETS lines
        return {int(k): int(v) for k, v in (r.value.split() for r in rows if r.value.strip())}

    def _save(self, spark, batch: int, versions: dict[int, int]) -> None:
        jvm, files = self._files(spark)
        at, temporary = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{n}") for n in (batch, f"_{batch}"))
        out = files.create(temporary, True)
        out.write(bytearray("".join(f"{k} {v}\n" for k, v in sorted(versions.items())).encode()))
        out.close()
        files.delete(at, False)
        files.rename(temporary, at)

    def _read(self, spark, versions: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.path}/data/v={v}/bucket={k}" for k, v in sorted(versions.items())]
        return spark.read.schema(_STORED).parquet(*paths) if paths else None

    def read(self, spark, before: int | None = None) -> DataFrame | None:
        """The newest state (before a batch), or None."""
        found = [m for m in self._manifests(spark) if before is None or m < before]
        return self._read(spark, self._manifest(spark, found[-1])) if found else None

    def _drop(self, spark, kept: list[dict[int, int]], manifests: list[int]) -> None:
        jvm, files = self._files(spark)
        path = jvm.org.apache.hadoop.fs.Path
        named = {(v, k) for m in kept for k, v in m.items()}
        for version in files.listStatus(path(f"{self.path}/data")):
            v = int(version.getPath().getName()[2:])
            buckets = [b.getPath() for b in files.listStatus(version.getPath()) if b.getPath().getName().startswith("bucket=")]
            gone = [b for b in buckets if (v, int(b.getName()[7:])) not in named]
            for b in [version.getPath()] if len(gone) == len(buckets) else gone:
                files.delete(b, True)
        for m in manifests:
            files.delete(path(f"{self.path}/manifests/{m}"), False)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fields = [F.col(c).cast(k).alias(c) for c, k in CHANGELOG_FIELDS.items()]
        bucket = F.pmod(F.xxhash64("aggregate_id"), F.lit(self.BUCKETS)).cast("int").alias("bucket")
        rows = batch.where("aggregate_id IS NOT NULL").select(*fields, F.lit(batch_id).cast("long").alias("version"), bucket).persist()
        changed = sorted(r.bucket for r in rows.select("bucket").distinct().collect())  # at most BUCKETS
        before = [m for m in self._manifests(spark) if m < batch_id]
        versions = self._manifest(spark, before[-1]) if before else {}
        held = self._read(spark, {k: v for k, v in versions.items() if k in changed})
        every = rows if held is None else held.withColumn("bucket", bucket).unionByName(rows)
        if changed:
            latest(every, ["version"]).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={batch_id}")
        rows.unpersist()
        now = versions | dict.fromkeys(changed, batch_id)
        self._save(spark, batch_id, now)
        if changed:
            self._drop(spark, [versions, now], before[:-1])


_STORED = ", ".join(f"{n} {k}" for n, k in CHANGELOG_FIELDS.items()) + ", version bigint"
