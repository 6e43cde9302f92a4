"""Results that carry their failures and warnings as columns: value columns are null where ``error_code`` is set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Worst last; ``worst_completeness`` takes the maximum of these places.
COMPLETENESS = ("COMPLETE", "INSUFFICIENT_HISTORY", "PARTIAL", "TRUNCATED", "GAP_DETECTED")


def completeness_rank(state: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, COMPLETENESS)), state)


def worst_completeness(state: Column) -> Column:
    """Aggregate: the most severe of the states."""
    return F.max_by(state, completeness_rank(state))


def coverage_error(state: Column, initial_state_known: Column) -> Column:
    """The error that a coverage state alone causes, or null. PARTIAL needs a known initial state."""
    return (
        F.when(state.isin("GAP_DETECTED", "TRUNCATED", "INSUFFICIENT_HISTORY"), state)
        .when((state == "PARTIAL") & ~F.coalesce(initial_state_known, F.lit(False)), F.lit("MISSING_INITIAL_STATE"))
    )


def coverage_warnings(state: Column) -> Column:
    return reasons((state == "PARTIAL", "PARTIAL_HISTORY"))


def reasons(*rules: tuple[Column, str]) -> Column:
    """The codes whose condition holds, in the order given; a null condition does not hold."""
    return F.array_compact(F.array(*(F.when(condition, F.lit(code)) for condition, code in rules)))


def guarded(df: DataFrame, error: Column, *values: str) -> DataFrame:
    """Adds ``error_code`` and ``status`` and nulls the value columns of failed rows."""
    out = df.withColumn("error_code", error)
    ok = F.col("error_code").isNull()
    out = out.withColumns({v: F.when(ok, F.col(v)) for v in values})
    return out.withColumn("status", F.when(ok, "OK").otherwise("FAILED"))
