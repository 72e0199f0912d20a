"""Run records: the event log of a run, and the history of runs."""

from __future__ import annotations

from datetime import datetime, timezone
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.display import group_label

# Event types, in the order in which a run tells them.
EVENT_TYPES = ("sql_generated", "plan_ready", "approx_progress", "approx_final", "exact_result")

_PER_GROUP = (
    "group_value estimate display_value relative_error ci_low ci_high sample_rows population_rows"
).split()
_HISTORY = (
    "prompt string, dataset_id string, dataset_label string, "
    "live_mode boolean, error_tolerance double, confidence_level double, created_at timestamp"
)


def _line(type_: Column, order: list[Column], payload: Column) -> list[Column]:
    return [type_.alias("type"), *order, payload.alias("payload")]


def event_log(
    session_id: str,
    question: DataFrame,
    verdict: DataFrame,
    progress: DataFrame,
    comparison: DataFrame,
) -> DataFrame:
    """All events of one run: ``session_id``, ``sequence``, ``type``, ``payload`` (JSON).

    ``question`` and ``verdict`` are one-row frames; ``progress`` a trace with progress columns;
    ``comparison`` the exact result beside the last estimate. The last step is told once, as
    ``approx_final``. A run has tens of events, so that one window numbers them.
    """
    whole = F.to_json(F.struct("*"))
    place = [F.lit(0).alias("iteration")]
    steps = progress
    if "group_value" in progress.columns:
        # groups of a step become one payload; approximated questions have few groups
        shared = [c for c in progress.columns if c not in _PER_GROUP]
        members = [
            group_label(F.col("group_value")).alias("group_value"),
            *[c for c in _PER_GROUP[1:] if c in progress.columns],
        ]
        steps = progress.groupBy(*shared).agg(
            F.array_sort(F.collect_list(F.struct(*members))).alias("group_rows")
        )
    kind = F.when(F.col("is_final"), EVENT_TYPES[3]).otherwise(EVENT_TYPES[2])
    compared = comparison
    if "group_value" in comparison.columns:
        line = F.struct("group_value", *[c for c in comparison.columns if c != "group_value"])
        compared = comparison.agg(
            F.count(F.lit(1)).alias("group_count"),
            F.array_sort(F.collect_list(line)).alias("rows"),
        )
    events = (
        question.select(*_line(F.lit(EVENT_TYPES[0]), place, whole))
        .unionByName(verdict.select(*_line(F.lit(EVENT_TYPES[1]), place, whole)))
        .unionByName(steps.select(*_line(kind, [F.col("iteration")], whole)))
        .unionByName(compared.select(*_line(F.lit(EVENT_TYPES[4]), place, whole)))
    )
    phase = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("type"))
    return events.select(
        F.lit(session_id).alias("session_id"),
        F.row_number().over(Window.orderBy(phase, "iteration")).alias("sequence"),
        "type",
        F.current_timestamp().alias("sent_at"),
        "payload",
    )


def write_events(events: DataFrame, path: str, session_id: str) -> None:
    """Writes the events of a run as JSON lines; a run that is told again replaces what it told before."""
    events.drop("session_id").write.mode("overwrite").json(f"{path}/session_id={quote(session_id, safe='')}")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    schema = "sequence int, type string, sent_at timestamp, payload string, session_id string"
    told = spark.read.schema(schema).json(path)
    return told.select("session_id", "sequence", "type", "sent_at", "payload")


def append_run(
    spark: SparkSession,
    path: str,
    session_id: str,
    prompt: str,
    dataset_id: str,
    dataset_label: str,
    live_mode: bool = False,
    error_tolerance: float = 0.05,
    confidence_level: float = 0.95,
    created_at: datetime | None = None,
) -> None:
    """Adds one run to the history table; a run that is added again replaces its line."""
    created = created_at or datetime.now(timezone.utc)
    row = (
        prompt,
        dataset_id,
        dataset_label,
        live_mode,
        error_tolerance,
        confidence_level,
        created,
    )
    place = f"{path}/session_id={quote(session_id, safe='')}"
    spark.createDataFrame([row], _HISTORY).coalesce(1).write.mode("overwrite").parquet(place)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.schema(f"{_HISTORY}, session_id string").parquet(path)
    return lines.select("session_id", *[c for c in lines.columns if c != "session_id"])


def newest_first(history: DataFrame, when: str = "created_at", *ties: str) -> DataFrame:
    return history.orderBy(F.col(when).desc(), *ties)


def search(history: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows of which any of the columns contains the text, in any case; blank finds all."""
    wanted = text.strip().lower()
    if not wanted:
        return history
    found = [F.coalesce(F.lower(c).contains(wanted), F.lit(False)) for c in columns]
    hit = found[0]
    for other in found[1:]:
        hit = hit | other
    return history.where(hit)
