"""Traces flattened to decision boundaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scoring import falsy_or


def flatten_boundaries(traces: DataFrame, keep: Sequence[str], states: str = "boundary_states", modes: str = "mode_trace") -> DataFrame:
    """One row by boundary, from the first of three sources that a trace has.

    ``boundary_states`` events, else ``mode_trace`` events, else one row for the trace as a whole. An event's index is its
    place in the raw list, null events included, which give no row. Top-level ratios default where they are 0.
    """
    has = lambda c: F.coalesce(F.size(F.filter(c, lambda x: x.isNotNull())), F.lit(0)) > 0
    event = "struct<info_mode:int,cot_mode:int,progress_ratio:double,remaining_budget_ratio:double,boundary_kind:string>"
    whole = F.array(F.struct("info_mode", "cot_mode", falsy_or(F.col("progress_ratio"), 1.0).alias("progress_ratio"), F.lit(1.0).alias("remaining_budget_ratio"), F.lit("initial").alias("boundary_kind")).cast(event))
    chosen = F.when(has(states), F.col(states).cast(f"array<{event}>")).when(has(modes), F.col(modes).cast(f"array<{event}>")).otherwise(whole)
    branch = F.when(has(states), F.lit("boundary_states")).when(has(modes), F.lit("mode_trace")).otherwise(F.lit("trace"))
    flat = traces.select(*keep, F.col("info_mode").alias("i0"), F.col("cot_mode").alias("c0"), branch.alias("branch"), F.posexplode(chosen).alias("boundary_index", "e")).where("e is not null")
    return flat.select(
        *keep, "branch", "boundary_index",
        F.coalesce("e.info_mode", "i0").alias("chosen_info_mode"), F.coalesce("e.cot_mode", "c0").alias("chosen_cot_mode"),
        falsy_or(F.col("e.progress_ratio"), 1.0).alias("progress_ratio"), falsy_or(F.col("e.remaining_budget_ratio"), 1.0).alias("remaining_budget_ratio"),
        F.coalesce(F.nullif(F.col("e.boundary_kind"), F.lit("")), F.lit("none")).alias("boundary_kind"),
    )
