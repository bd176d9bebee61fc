"""Record files and append-only logs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import filled
from ..functions.labels import NO_DATE
from .schema import LOG, RECORD
from .scratch import stored


def read_records(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Records of JSON files that hold an array each. A file that is no such array fails the read, it does not count as empty."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


#: Characters of an array file, but for one whose only record is longer.
FILE_SIZE = 4 << 20


def _as_arrays(batches: Iterator[pa.RecordBatch], size: int = FILE_SIZE) -> Iterator[pa.RecordBatch]:
    """Arrays of records, one in each row and batch; without records, an empty one."""
    array = lambda texts: pa.RecordBatch.from_pydict({"value": ["[" + ",\n".join(texts) + "]"]})
    held, length, empty = [], 0, True
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if held and length + len(text) > size:
                yield array(held)
                held, length, empty = [], 0, False
            held.append(text)
            length += len(text)
    if held or empty:
        yield array(held)


def write_records(records: DataFrame, path: str) -> None:
    """Write files that hold a JSON array each, of bounded size; no row goes to another task. ``path`` must be new.

    A reader can't split such a file and holds its records at once, so a large partition becomes many files.
    """
    lines = records.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    lines.mapInArrow(_as_arrays, "value string").write.option("maxRecordsPerFile", 1).text(path)


CORRUPT, FILE = "__corrupt", "__file"


def checked_records(spark: SparkSession, path: str, schema: str = RECORD) -> tuple[DataFrame, DataFrame]:
    """Records of the sound files of a folder, and ``file`` and ``start`` (of its text) of each file that is no array of such records.

    A file with one record that is none is faulty as a whole. No file ends the read, and faulty ones are told apart by
    their paths, so it does not matter which files a task reads together.
    """
    rows = spark.read.schema(f"{schema}, `{CORRUPT}` string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    rows = stored(rows.withColumn(FILE, F.col("_metadata.file_path")), "parsed")  # parsed once, for what is decided and for what is read
    faulty = rows.where(F.col(CORRUPT).isNotNull()).groupBy(F.col(FILE).alias("file")).agg(F.min(F.left(CORRUPT, F.lit(200))).alias("start"))
    sound = rows.join(faulty.select(F.col("file").alias(FILE)), FILE, "left_anti").drop(CORRUPT, FILE)
    return sound, faulty


def records_or_seed(spark: SparkSession, path: str, seed: DataFrame, keep_sound: bool = False) -> DataFrame:
    """Records of ``path``, or ``seed`` where it is missing, empty, or holds a faulty file; with ``keep_sound`` the records of the sound files, if there are any.

    All files are read before either is given out, so the result does not depend on how files are dealt to tasks.
    """
    try:
        sound, faulty = checked_records(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in seed.schema))
        if not keep_sound and not faulty.isEmpty():
            return seed
        return seed if sound.isEmpty() else sound.select(*seed.columns)
    except Exception as failed:  # the reader's own errors come as several classes
        if "FAILED_READ_FILE" in str(failed) or "PATH_NOT_FOUND" in str(failed) or "MALFORMED_RECORD" in str(failed):
            return seed
        raise


def with_default_date(rows: DataFrame, column: str = "lastUpdated") -> DataFrame:
    """Rows whose null or empty date is the default."""
    return rows.withColumn(column, F.coalesce(filled(F.col(column)), F.lit(NO_DATE)))


def stamped_log(steps: DataFrame) -> DataFrame:
    """Steps in the columns of the log, with the time of writing where a step has none."""
    names = [c.split()[0] for c in LOG.split(", ")]
    stamped = steps.withColumn("at", F.coalesce("at", F.current_timestamp())) if "at" in steps.columns else steps.withColumn("at", F.current_timestamp())
    return stamped.select(*names)


def append_log(steps: DataFrame, path: str) -> None:
    """Add steps to the log."""
    stamped_log(steps).write.mode("append").parquet(path)
