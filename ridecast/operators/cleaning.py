"""Row cleaning in an explicit order, with an audit of what each step removes.

The order matters: training trims at a quantile of the covered trips and drops null
averages last, the exploratory study drops nulls first and trims after.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ridecast.operators.projection import any_null
from ridecast.operators.ranks import quantile_row
from ridecast.schemas import TARGET

_BOUND = "_bound"


@dataclass(frozen=True)
class KeepFlag:
    """Keep rows whose 0/1 flag has the value."""

    column: str
    value: int = 1

    @property
    def name(self) -> str:
        return f"{self.column} == {self.value}"


@dataclass(frozen=True)
class TrimQuantile:
    """Keep rows above a lower limit and not above an exact quantile of the rows left so far."""

    column: str
    quantile: float
    above: float = 0.0

    @property
    def name(self) -> str:
        return f"{self.above:g} < {self.column} <= p{self.quantile * 100:g}"


@dataclass(frozen=True)
class DropNulls:
    """Keep rows without a null in the columns."""

    columns: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"{', '.join(self.columns)} not null"


Step = KeepFlag | TrimQuantile | DropNulls

TRAINING_STEPS: tuple[Step, ...] = (
    KeepFlag("has_precip_data"),
    TrimQuantile(TARGET, 0.95),
    DropNulls(("avg_duration_prev_7days",)),
)
STUDY_COLUMNS = (
    "is_registered", "dow", "has_trace", "has_precip_data", "avg_duration_prev_7days", "HPCP", TARGET,
)
STUDY_STEPS: tuple[Step, ...] = (DropNulls(STUDY_COLUMNS), TrimQuantile(TARGET, 0.98))


def _with_condition(df: DataFrame, kept: DataFrame, step: Step, bound: str) -> tuple[DataFrame, Column]:
    """The step's condition; a quantile of the kept rows is attached as a one-row broadcast."""
    match step:
        case KeepFlag(column, value):
            return df, F.coalesce(F.col(column) == value, F.lit(False))
        case DropNulls(columns):
            return df, ~any_null(columns)
        case TrimQuantile(column, quantile, above):
            row = quantile_row(kept, column, [quantile], [bound])
            within = (F.col(column) > above) & (F.col(column) <= F.col(bound))
            return df.crossJoin(F.broadcast(row)), F.coalesce(within, F.lit(False))


def clean(df: DataFrame, steps: Sequence[Step] = TRAINING_STEPS) -> DataFrame:
    """Apply the steps in order."""
    for step in steps:
        marked, condition = _with_condition(df, df, step, _BOUND)
        df = marked.where(condition).drop(_BOUND)
    return df


def _counted(df: DataFrame, steps: Sequence[Step]) -> tuple[DataFrame, list[Column], Column]:
    """The rows with the steps' bounds, the counts of the audit, and whether a row passes all steps."""
    marked, kept, passed = df, df, F.lit(True)
    counts: list[Column] = []
    for i, step in enumerate(steps):
        marked, condition = _with_condition(marked, kept, step, f"{_BOUND}{i}")
        counts += [
            F.count_if(passed & ~condition).alias(f"removed{i}"),
            F.count_if(passed).alias(f"total{i}"),
        ]
        passed = passed & condition
        kept = clean(kept, [step])
    return marked, counts, passed


def _audit_rows(row: DataFrame, steps: Sequence[Step]) -> DataFrame:
    entries = [
        F.struct(
            F.lit(i + 1).alias("step"),
            F.lit(step.name).alias("rule"),
            F.col(f"removed{i}").alias("removed"),
            F.col(f"total{i}").alias("total"),
        )
        for i, step in enumerate(steps)
    ]
    return row.select(F.inline(F.array(*entries)))


def audit(df: DataFrame, steps: Sequence[Step] = TRAINING_STEPS) -> DataFrame:
    """Rows removed by each step out of the rows it saw, counted in one pass."""
    marked, counts, _ = _counted(df, steps)
    return _audit_rows(marked.agg(*counts), steps)


def clean_and_audit(
    df: DataFrame, write: Callable[[DataFrame], None], steps: Sequence[Step] = TRAINING_STEPS
) -> DataFrame:
    """Write the cleaned rows and return their audit, counted while the rows pass to the writer.

    `write` must write the DataFrame it is given exactly once. Where it shuffles, the counts
    lie before the shuffle and a stage that runs again counts its rows again; a writer that
    does not shuffle (`files_per_month=None`) counts each row once whatever is lost.
    """
    marked, counts, passed = _counted(df, steps)
    seen = Observation()
    write(marked.observe(seen, *counts).where(passed).select(*df.columns))
    found = seen.get  # two numbers a step
    names = [name for i in range(len(steps)) for name in (f"removed{i}", f"total{i}")]
    row = df.sparkSession.range(1).select(*[F.lit(found[name]).cast("long").alias(name) for name in names])
    return _audit_rows(row, steps)
