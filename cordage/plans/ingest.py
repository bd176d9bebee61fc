"""A batch from extracted records to a committed table."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import bounds
from ..operators.upsert import latest, upsert
from ..operators.validate import validated
from ..sources.batches import BEGUN, CHECKED, COMMITTING, DONE, MOVED, UNDONE, BatchStates
from ..sources.merge_on_read import MergeTable
from ..sources.records import stamped_log
from ..sources.versions import VersionedTable


def extracted(pages: DataFrame, extract: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Records that ``extract`` makes of batches of pages: the place for a model, which is no part of this library.

    Retries belong into ``extract``: a repeated task repeats its calls.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield extract(batch)

    return pages.mapInPandas(run, schema)


def with_bounds(records: DataFrame) -> DataFrame:
    """Records with the least and greatest annual amount of their tiers."""
    low, high = bounds(F.col("tuition_by_grade"), "annual_thb")
    return records.withColumns({"tuition_min_thb": low, "tuition_max_thb": high})


def split(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid records, and failed ones with their errors."""
    checked = validated(records)
    return checked.where("validation = 'success'").drop("errors", "validation"), checked.where("validation = 'failed'")


def steps(checked: DataFrame, key: str, saved: bool) -> DataFrame:
    """Log rows of what became of each record: checked, and if valid saved, or undone with the whole batch."""
    good = F.col("validation") == "success"
    step = lambda name, action, status, why: F.struct(F.lit(name).alias("step"), F.lit(action).alias("action_taken"), status.alias("status"), why.alias("decision_reasoning"))
    none = F.lit(None).cast("string")
    check = step("validate", "check record", F.when(good, "ok").otherwise("failed"), F.when(~good, F.array_join("errors", " ")))
    save = step("save", "upsert record", F.lit("ok" if saved else "failed"), none)
    undo = step("compensate", "keep the version before", F.lit("ok"), none)
    done = F.array_compact(F.array(check, F.when(good, save), *([] if saved else [F.when(good, undo)])))
    rows = checked.select(F.col(key).alias("school_name"), F.explode_outer(done).alias("s")).select("school_name", "s.*")
    return rows.withColumns({"url_visited": none, "confidence": F.lit(None).cast("double")})


def quarantined(spark: SparkSession, path: str) -> DataFrame:
    """Failed records of all batches under ``path``, with their errors and their ``batch``."""
    return spark.read.parquet(path).where("validation = 'failed'")


def _states(table: VersionedTable, quarantine: str) -> BatchStates:
    return BatchStates(table.spark, f"{quarantine}/_states")  # readers of the folder pass over it


def _write_log(table: VersionedTable, quarantine: str, batch: str, key: str, log: str | None, saved: bool) -> None:
    """The batch's own folder of the log, written anew: once or many times, its rows are there once."""
    if log:
        rows = steps(table.spark.read.parquet(f"{quarantine}/batch={batch}"), key, saved)
        stamped_log(rows).write.mode("overwrite").parquet(f"{log}/batch={batch}")


def _settle(table: VersionedTable, quarantine: str, batch: str, key: str, log: str | None) -> str:
    """Bring a batch to one of its two ends by what its last state and the table's pointer tell; repeating it changes nothing."""
    states = _states(table, quarantine)
    state, version = states.last(batch)
    if state in (DONE, UNDONE):
        return state
    saved = state == MOVED or state == COMMITTING and table.was_published(version)
    if state != BEGUN:  # else the checked records may be there in part, and the table was never touched
        _write_log(table, quarantine, batch, key, log, saved)
    states.mark(batch, DONE if saved else UNDONE, version)
    return DONE if saved else UNDONE


def recover(table: VersionedTable, quarantine: str, key: str, log: str | None = None) -> dict[str, str]:
    """Settle every batch that a failure has left open: ``done`` if the table had moved on to it, else ``undone``."""
    return {batch: _settle(table, quarantine, batch, key, log) for batch in _states(table, quarantine).open()}


def ingest(table: VersionedTable, quarantine: str, records: DataFrame, key: str, seq: str, log: str | None = None, batch: str | None = None) -> int:
    """Validate, upsert what is valid and publish; returns the new version. On an error the table stays as it was.

    Each step is announced in the states of ``batch`` before the next begins. A batch's checked records and its log have folders of its
    own, ``batch=<id>``, so a repeated call with the same id never touches another's and adds nothing twice: a done batch returns its
    version, an open one is settled first, an undone one begins anew. Without an id it is that of the table's last move, so a call
    repeated after a failure is the same batch. ``quarantined`` reads the failed records. Once the table has moved nothing is raised: a log that could not be written is left for ``recover``. One writer at a time.
    """
    batch = batch or f"after {table.moves()}"
    states = _states(table, quarantine)
    if states.last(batch) and _settle(table, quarantine, batch, key, log) == DONE:
        return states.last(batch)[1]
    before = table.version()
    states.mark(batch, BEGUN)
    try:
        validated(records).write.mode("overwrite").parquet(f"{quarantine}/batch={batch}")
        states.mark(batch, CHECKED)
        good = table.spark.read.parquet(f"{quarantine}/batch={batch}").where("validation = 'success'").drop("errors", "validation")
        version = table.next_version()
        states.mark(batch, COMMITTING, version)
        if not isinstance(table, MergeTable):
            table.commit(upsert(good.drop(seq).limit(0) if before is None else table.read(), good, key, seq))
        elif before is None:
            table.commit(latest(good, key, seq))
        else:
            table.upsert(good, seq)
    except Exception:
        _settle(table, quarantine, batch, key, log)
        raise
    try:
        states.mark(batch, MOVED, version)
        _settle(table, quarantine, batch, key, log)
    except Exception as failed:
        warnings.warn(f"batch {batch} is in the table, but not settled; recover settles it: {failed}", stacklevel=2)
    return version
