"""What the operators of this subpackage share: column checks, scratch tables, text helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A word is a run of ASCII letters or digits, or anything outside ASCII; text is lower-cased (A-Z) first.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: What lies between words of ALNUM_WORD.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes of an Arrow batch between the JVM and Python, where the session leaves Spark's own bound (64 MB).
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def small_batches(spark: SparkSession) -> None:
    """Lowers the bytes of Arrow batches unless the session has set them: several lie in memory for each task at a time."""
    if spark.conf.get(BATCH[0]) in ("67108864b", "64MB", "67108864"):
        spark.conf.set(*BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; letters outside ASCII stay as they are."""
    return F.translate(text, _UPPER, _LOWER)


def bound(value: Column, use) -> Column:
    """use(value) with value worked out once, however often use mentions it (inside other lambdas too)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Elements of a chunk in running().
RUN = 128


def running(values: Column, merge, zero: Column) -> Column:
    """For each element of an array the merge (associative, with the neutral zero) of all before it.

    A fold that appends copies what it has so far at each step; two levels of chunks keep that to RUN copies an element.
    """

    def fold(array: Column) -> Column:
        start = F.struct(zero.alias("now"), F.slice(F.array(zero), 1, 0).alias("seen"))
        return F.aggregate(array, start, lambda s, x: F.struct(merge(s["now"], x).alias("now"), F.concat(s["seen"], F.array(s["now"])).alias("seen")))

    def scanned(array: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(array) / RUN).cast("int") - 1), lambda c: F.slice(array, c * RUN + 1, F.lit(RUN)))
        folded = F.transform(chunks, fold)
        return bound(folded, lambda parts: F.flatten(F.zip_with(parts, fold(F.transform(parts, lambda p: p["now"]))["seen"], lambda p, before: F.transform(p["seen"], lambda x: merge(before, x)))))

    return bound(values, lambda array: F.when(F.size(array) > 0, scanned(array)).otherwise(F.slice(F.array(zero), 1, 0)))


#: Characters of a piece in pieces().
PIECE = 1024


def pieces(text: Column) -> Column:
    """A text in pieces of PIECE characters, so that a part far on is found without a walk from the beginning."""
    return F.regexp_extract_all(text, F.lit(r"(?s).{1,%d}" % PIECE), F.lit(0))


def part(cut: Column, start: Column, stop: Column) -> Column:
    """Characters start to stop (exclusive) of the text that pieces() has cut."""
    first = F.floor(start / PIECE).cast("int")
    near = F.array_join(F.slice(cut, first + 1, F.floor(stop / PIECE).cast("int") - first + 1), "")
    return F.substring(near, (start - first * PIECE + 1).cast("int"), (stop - start).cast("int"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a local master gets a folder of its own (tests); any other master is refused, as executors would write
    to their own disks.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df to a table in the shared folder and reads it back with the same schema.

    The files outlive lost executors; their size is known to the planner, so a join against them is
    broadcast only if it is under spark.sql.autoBroadcastJoinThreshold. They go when the session ends.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a table made by written() that no later plan reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
