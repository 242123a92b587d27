"""What several operators share: word patterns, checkpoints, and per-process caches."""

from __future__ import annotations

import atexit
import re
import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space (space, tab, LF, VT, FF, CR).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a session has none and runs in one process (tests, a laptop) is a local one set; on a cluster that is
    an error, since its machines share no temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if found is None:
        set_before = context._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            found = set_before.get()
        elif re.fullmatch(r"local(\[.*\])?", context.master):
            found = tempfile.mkdtemp(prefix="resultfeed-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Like ``cut``, as a Parquet table in the shared folder: smaller than a checkpoint where rows are many.

    Shuffle files that only this table needed are garbage then; the driver's JVM is asked to notice.
    The table goes when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/resultfeed-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    atexit.register(_remove, spark, path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number of each row in ``name``, given once and stored with the row.

    Never number rows in each scan: the number holds the partition, and Spark deals files to partitions by the
    settings and the executors' cores at the time of the scan.
    """
    return stored(df.withColumn(name, F.monotonically_increasing_id()), codec="zstd")


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it.

    Inside higher-order functions Catalyst may inline a column into a lambda and compute it
    again for each element; a lambda variable is bound once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    blank = F.lit(" \t\n\x0b\x0c\r")
    trimmed = F.btrim(text, blank)
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE_PATTERN)).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """Number of words as a long; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long"), F.lit(0).cast("long"))


def process_cache(key: str, build):
    """One object per Python worker process, kept across tasks (tokenizers, lookup tables)."""
    store = sys.modules.setdefault("_resultfeed_process_cache", types.ModuleType("_resultfeed_process_cache"))
    if not hasattr(store, key):
        setattr(store, key, build())
    return getattr(store, key)


def free_name(columns: list[str], wanted: str) -> str:
    """A column name that clashes with none of ``columns`` (Spark compares without case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
