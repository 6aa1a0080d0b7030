"""Verdicts on run logs, kept per run while the events arrive.

The state of a run is small and does not depend on the order of arrival: counts of its start, step and end records, the
earliest and latest time of each, and the ids of its completed cases. Every batch emits the runs it changed, so a verdict stands as soon as the
end record is there and is corrected by whatever comes after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

START, STEP, END = "job_started", "case_completed", "evaluation_completed"
FIGURES = ["started", "completed", "ended", "different", "started_at", "first_step", "last_step", "ended_at"]


def kinds(start: str = START, step: str = STEP, end: str = END) -> dict[str, str]:
    return {start: "start", step: "step", end: "end"}


def _relevant(events: DataFrame, names: dict[str, str]) -> DataFrame:
    """(run_id, kind, case_id, at) of the records that count; times in microseconds."""
    kind = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("event")]
    return events.select(
        "run_id", kind.alias("kind"), F.col("case_id").cast("string").alias("case_id"), F.unix_micros(F.col("at").cast("timestamp")).alias("at")
    ).filter(F.col("kind").isNotNull())


def log_figures(events: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """The same figures from a finished log: run_id and FIGURES."""
    rows = _relevant(events, names or kinds())

    def of(kind: str, value: str = "at") -> Column:
        return F.when(F.col("kind") == kind, F.col(value))

    return rows.groupBy("run_id").agg(
        *[F.count_if(F.col("kind") == k).alias(n) for k, n in (("start", "started"), ("step", "completed"), ("end", "ended"))],
        F.count_distinct(of("step", "case_id")).alias("different"), F.min(of("start")).alias("started_at"),
        F.min(of("step")).alias("first_step"), F.max(of("step")).alias("last_step"), F.max(of("end")).alias("ended_at"),
    )


def verdicts(figures: DataFrame, expected: DataFrame) -> DataFrame:
    """(run_id, cases, started, completed, ended, violations) of every expected run; a run without any record is judged as well.

    ``incomplete``: not one start, one end and as many steps as cases; ``repeated``: a case completed twice; ``surplus``: more different cases than the run
    has; ``disorder``: a step before the start or after the end; ``no_end``: the log is still open.
    """
    counts = ("started", "completed", "ended", "different")
    joined = expected.select("run_id", "cases").join(figures, "run_id", "left").fillna(0, list(counts))
    flags = {
        "incomplete": (F.col("started") != 1) | (F.col("completed") != F.col("cases")) | (F.col("ended") != 1),
        "repeated": F.col("completed") > F.col("different"), "surplus": F.col("different") > F.col("cases"),
        "disorder": F.coalesce((F.col("first_step") < F.col("started_at")) | (F.col("last_step") > F.col("ended_at")), F.lit(False)),
        "no_end": F.col("ended") == 0,
    }
    violations = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in flags.items()]))
    return joined.select("run_id", "cases", "started", "completed", "ended", violations.alias("violations"))


def _least(a: int | None, b: float) -> int | None:
    return a if pd.isna(b) else int(b) if a is None else min(a, int(b))


def _greatest(a: int | None, b: float) -> int | None:
    return a if pd.isna(b) else int(b) if a is None else max(a, int(b))


def track(events: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """A stream of the changed runs: run_id, version and FIGURES; the highest version of a run holds.

    A run's state holds the ids of its completed cases, as many as the run has cases and surplus ones.
    """
    rows = _relevant(events, names or kinds())

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            version, started, completed, ended, seen, started_at, first_step, last_step, ended_at = state.get
        else:
            version, started, completed, ended, seen, started_at, first_step, last_step, ended_at = 0, 0, 0, 0, [], None, None, None, None
        known = set(seen)
        for frame in frames:
            start, step, end = (frame[frame["kind"] == k] for k in ("start", "step", "end"))
            started, completed, ended = started + len(start), completed + len(step), ended + len(end)
            known.update(step["case_id"].dropna())
            started_at, first_step = _least(started_at, start["at"].min()), _least(first_step, step["at"].min())
            last_step, ended_at = _greatest(last_step, step["at"].max()), _greatest(ended_at, end["at"].max())
        version += 1
        state.update((version, started, completed, ended, sorted(known), started_at, first_step, last_step, ended_at))
        out = [(key[0], version, started, completed, ended, len(known), started_at, first_step, last_step, ended_at)]
        frame = pd.DataFrame(out, columns=["run_id", "version", *FIGURES])
        yield frame.astype({c: "Int64" for c in FIGURES})

    kind = dict(events.dtypes)["run_id"]
    times = "started_at bigint, first_step bigint, last_step bigint, ended_at bigint"
    return rows.groupBy("run_id").applyInPandasWithState(
        update, f"run_id {kind}, version bigint, started bigint, completed bigint, ended bigint, different bigint, {times}",
        f"version bigint, started bigint, completed bigint, ended bigint, seen array<string>, {times}",
        "update", GroupStateTimeout.NoTimeout,
    )


def watch_logs(events: DataFrame, path: str, checkpoint: str, names: dict[str, str] | None = None) -> StreamingQuery:
    """Keep the figures of every run under ``path``; a replayed batch replaces its rows."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        track(events, names).writeStream.outputMode("update").foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_figures(spark: SparkSession, path: str) -> DataFrame:
    """The latest figures of each run."""
    latest = F.max_by(F.struct(*FIGURES), "version").alias("f")
    return spark.read.parquet(path).groupBy("run_id").agg(latest).select("run_id", "f.*")
