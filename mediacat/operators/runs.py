"""Scan runs: their life, their order and how long they are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mediacat import fixed, schemas


def start_run(spark: SparkSession, scan_run_id: str, started: Column) -> DataFrame:
    """The row of a run that has just begun; counters are zero."""
    values = {
        "scan_run_id": F.lit(scan_run_id),
        "status": F.lit("running"),
        "start_timestamp": started,
        "end_timestamp": F.lit(None).cast("timestamp"),
        "duration_seconds": F.lit(None).cast("double"),
        "files_per_second": F.lit(None).cast("double"),
    }
    return spark.range(1).select(
        *[
            values.get(c, F.lit(0).cast("bigint")).alias(c)
            for c in schemas.columns(schemas.SCAN_RUNS)
        ]
    )


def update_run(run: DataFrame, **counters: Column | int) -> DataFrame:
    """``run`` with counters set."""
    unknown = set(counters) - set(fixed.RUN_COUNTERS)
    if unknown:
        raise ValueError(f"not run counters: {sorted(unknown)}")
    return run.withColumns(
        {
            name: (value if isinstance(value, Column) else F.lit(value)).cast("bigint")
            for name, value in counters.items()
        }
    )


def complete_run(run: DataFrame, ended: Column, status: str = "completed") -> DataFrame:
    """``run`` closed, with duration and rate; the rate is 0 when nothing was processed."""
    seconds = (F.unix_micros(ended) - F.unix_micros("start_timestamp")) / F.lit(1_000_000)
    rate = F.when(
        F.col("media_files_processed") > 0, F.try_divide(F.col("media_files_processed"), seconds)
    ).otherwise(F.lit(0.0))
    return run.withColumns(
        {
            "status": F.lit(status),
            "end_timestamp": ended,
            "duration_seconds": seconds,
            "files_per_second": rate,
        }
    )


def latest_state(run_rows: DataFrame, written: str) -> DataFrame:
    """Current row of each run from an append-only log, by its write order column."""
    row = F.struct(*[c for c in run_rows.columns if c != written])
    return run_rows.groupBy("scan_run_id").agg(F.max_by(row, written).alias("row")).select("row.*")


def latest_run(runs: DataFrame) -> DataFrame:
    """The run that started last."""
    return runs.orderBy(F.desc("start_timestamp"), F.desc("scan_run_id")).limit(1)


def expired_runs(runs: DataFrame, keep: int = 10) -> DataFrame:
    """Ids of all but the ``keep`` most recent runs."""
    recent = (
        runs.select("scan_run_id", "start_timestamp")
        .orderBy(F.desc("start_timestamp"), F.desc("scan_run_id"))
        .limit(keep)
    )
    return runs.select("scan_run_id").join(recent.select("scan_run_id"), "scan_run_id", "left_anti")


def retain_runs(
    runs: DataFrame, errors: DataFrame, keep: int = 10
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept runs, kept errors and (scan_runs_deleted, errors_deleted). Media and albums stay."""
    old = expired_runs(runs, keep)
    kept_runs = runs.join(old, "scan_run_id", "left_anti")
    kept_errors = errors.join(old, "scan_run_id", "left_anti")
    gone = old.select(F.lit(1).alias("run"), F.lit(0).alias("error")).unionAll(
        errors.join(old, "scan_run_id", "left_semi").select(F.lit(0), F.lit(1))
    )
    counts = gone.agg(
        F.count_if(F.col("run") == 1).alias("scan_runs_deleted"),
        F.count_if(F.col("error") == 1).alias("errors_deleted"),
    )
    return kept_runs, kept_errors, counts
