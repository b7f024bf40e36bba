"""The append-only log, on files or on Kafka, behind one interface.

Records have the columns of schemas.LOG. The file log is Parquet; a file is a batch of records in order, and streams
take files by their modification time. A record's partition follows from its key, and its offset from when its file was
written and its place there, so arrival has an order as on a broker; offsets grow but have gaps. Kafka needs its connector
on the class path.
"""

from __future__ import annotations

import dataclasses
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quelora.schemas import LOG

_COLUMNS = ("key", "value", "topic", "partition", "offset", "timestamp", "headers")


#: Partitions of a topic of the file log.
PARTITIONS = 6
#: Bits of an offset that number the records of a file.
PLACE_BITS = 20


@dataclasses.dataclass(frozen=True)
class Delivery:
    """Records that were to be written, that the log has taken, and that failed."""

    published: int
    delivered: int
    failed: int


def publish(log, records: DataFrame) -> Delivery:
    """Appends records and counts what was delivered, in the same job. A write that fails delivers nothing for sure: its
    error is raised unless the records can still be counted."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException
    from pyspark.sql import Observation

    seen = Observation()
    try:
        log.append(records.observe(seen, F.count(F.lit(1)).alias("n")))
    except (PySparkException, Py4JJavaError):
        return Delivery(n := records.count(), 0, n)
    return Delivery(seen.get["n"], seen.get["n"], 0)


def conform(records: DataFrame) -> DataFrame:
    """Records with all log columns; missing ones are null."""
    from pyspark.sql.types import StructType

    kinds = {f.name: f.dataType for f in StructType.fromDDL(LOG)}
    return records.select(*((F.col(c) if c in records.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in _COLUMNS))


def _partitioned(records: DataFrame) -> DataFrame:
    return records.withColumn("partition", F.coalesce("partition", F.pmod(F.xxhash64("key"), F.lit(PARTITIONS)).cast("int")))


def _arrived(records: DataFrame) -> DataFrame:
    place = F.shiftleft(F.unix_millis("_metadata.file_modification_time"), PLACE_BITS) + F.col("_metadata.row_index")
    return records.withColumn("offset", F.coalesce("offset", place))


@dataclasses.dataclass(frozen=True)
class FileLog:
    """A folder of Parquet files."""

    path: str

    def append(self, records: DataFrame) -> None:
        _partitioned(conform(records)).write.mode("append").parquet(self.path)

    def batch(self, spark: SparkSession, limit: int | None = None) -> DataFrame:
        rows = _arrived(spark.read.schema(LOG).parquet(self.path))
        return rows if limit is None else rows.limit(limit)

    def order(self, spark: SparkSession) -> None:
        """Makes streams take the files that there are in the order of their names, as one job writes ranges."""
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = sorted((s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
        now = int(time.time() * 1000)
        for k, path in enumerate(found):
            files.setTimes(path, now - 1000 * (len(found) - k), -1)

    def stream(self, spark: SparkSession, files_per_trigger: int | None = None) -> DataFrame:
        reader = spark.readStream.schema(LOG)
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        return _arrived(reader.parquet(self.path))

    def writer(self, stream: DataFrame, checkpoint: str):
        return _partitioned(conform(stream)).writeStream.format("parquet").option("path", self.path).option("checkpointLocation", checkpoint)


@dataclasses.dataclass(frozen=True)
class KafkaLog:
    """Topics of a Kafka cluster; writes are idempotent and wait for all replicas."""

    servers: str
    topics: tuple[str, ...]
    starting: str = "earliest"
    ending: str = "latest"

    def _read(self, reader):
        options = {"kafka.bootstrap.servers": self.servers, "subscribe": ",".join(self.topics), "startingOffsets": self.starting, "includeHeaders": "true"}
        return reader.format("kafka").options(**options)

    def _sink(self, writer):
        options = {"kafka.bootstrap.servers": self.servers, "kafka.acks": "all", "kafka.enable.idempotence": "true", "kafka.compression.type": "snappy", "kafka.linger.ms": "20", "includeHeaders": "true"}
        return writer.format("kafka").options(**options)

    def append(self, records: DataFrame) -> None:
        kept = [c for c in ("key", "value", "topic", "headers") if c in records.columns]
        self._sink(records.select(*kept).write).save()

    def batch(self, spark: SparkSession, limit: int | None = None) -> DataFrame:
        rows = conform(self._read(spark.read).option("endingOffsets", self.ending).load())
        return rows if limit is None else rows.limit(limit)

    def stream(self, spark: SparkSession, records_per_trigger: int | None = None) -> DataFrame:
        reader = self._read(spark.readStream)
        if records_per_trigger:
            reader = reader.option("maxOffsetsPerTrigger", records_per_trigger)
        return conform(reader.load())

    def writer(self, stream: DataFrame, checkpoint: str):
        kept = [c for c in ("key", "value", "topic", "headers") if c in stream.columns]
        return self._sink(stream.select(*kept).writeStream).option("checkpointLocation", checkpoint)
