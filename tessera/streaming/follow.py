"""Streams that keep an index or a derived table up to date.

Batches are applied as whole snapshots, so one that is repeated after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..index import Index
from ..operators import maintenance

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def follow_directory(index: Index, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Refreshes an index whenever files arrive under its root; without an interval it works on what is there and ends.

    The stream only wakes the refresh (contents are not read by it), and the refresh finds changes and deletions by itself.
    The index's own folder must not lie under the root, as it does not by default.
    """
    if Path(index.data).resolve().is_relative_to(Path(index.root).resolve()):
        raise ValueError("an index inside the directory that it follows would wake itself")
    source = index.spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
    arrivals = source.load(Path(index.root).resolve().as_uri()).select("path")
    writer = arrivals.writeStream.foreachBatch(lambda batch, number: index.refresh()).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def follow_table(spark: SparkSession, source: str, schema: str, derive: Callable[[DataFrame], DataFrame], keys: list[str], target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keeps target/b<batch> as the newest snapshot of derive(rows), rows arriving as Parquet files of a folder.

    Derived rows replace those of equal keys; each batch reads the snapshot before it and writes its own, so a batch that
    runs twice writes the same again. derive must give one row for each key.
    """

    def apply(batch: DataFrame, number: int) -> None:
        rows = derive(batch)
        before = latest(spark, target, number)
        (rows if before is None else maintenance.upsert(before, rows, keys)).write.mode("overwrite").parquet(f"{target}/b{number}")

    writer = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def latest(spark: SparkSession, target: str, below: int | None = None) -> DataFrame | None:
    """The newest whole snapshot under target (of batches below a number), or None."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/b*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    numbers = [n for n in (int(f.getPath().getParent().getName()[1:]) for f in found) if below is None or n < below]
    return spark.read.parquet(f"{target}/b{max(numbers)}") if numbers else None
