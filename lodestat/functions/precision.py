"""How far a figure can be trusted, and why one may be missing (F36), as metadata of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

# Kinds of figures, and the reasons for which one is null.
EXACT, ESTIMATE, INFERRED = "exact", "estimate", "inferred"
MISSING = {
    "legacy_field": "old data has no record of the field",
    "not_recorded": "the field was not recorded",
    "cost_not_recorded": "no cost was recorded; a cost of 0 means the same",
    "zero_denominator": "the denominator is 0 or was not recorded",
    "no_samples": "there are no samples to take a statistic of",
    "channel_no_cache": "the channel reports no cache",
    "non_positive_duration": "the last update is not after the start",
    "no_tool_calls": "no tool was called",
    "inconsistent_count": "the count differs between its two sources",
    "no_comparison_baseline": "there is no window before to compare with",
}
#: Precision of figures by column, and the reason for which it may be null. What is read or counted is exact; a figure that isn't listed counts as an estimate.
FIGURES = {
    **dict.fromkeys(("steps", "tokens", "previous_tokens", "input", "output", "reasoning", "cache_read", "cache_write", "sessions", "first_seen", "last_seen", "tool_calls", "errors", "total", "today_input", "today_output", "yesterday_steps"), (EXACT, None)),
    **dict.fromkeys(("token_share", "output_per_step", "context_avg", "context_median", "context_p95", "reasoning_share"), (EXACT, "no_samples")),
    "cost": (EXACT, "cost_not_recorded"),
    "cost_estimate": (ESTIMATE, "cost_not_recorded"),
    "tool_estimated_tokens": (ESTIMATE, "no_tool_calls"),
    "hit_rate": (EXACT, "channel_no_cache"),
    "yesterday_hit_rate": (EXACT, "channel_no_cache"),
    "strict_hit_rate": (EXACT, "zero_denominator"),
    "cache_hit_rate": (EXACT, "zero_denominator"),
    "relative_delta": (EXACT, "no_comparison_baseline"),
    "pp_delta": (EXACT, "no_comparison_baseline"),
    "duration_ms": (INFERRED, "non_positive_duration"),
    "error_rate": (EXACT, "no_tool_calls"),
    "residual_ratio": (EXACT, "zero_denominator"),
}


def tagged(df: DataFrame) -> DataFrame:
    """`df` with `precision` and, where a null has one, `missing` in the metadata of its numeric columns."""

    def metadata(name: str) -> dict[str, str]:
        kind, reason = FIGURES.get(name, (ESTIMATE, "not_recorded"))
        return {"precision": kind} | ({"missing": MISSING[reason]} if reason else {})

    numeric = {f.name for f in df.schema if isinstance(f.dataType, NumericType)}
    return df.select(*(F.col(f"`{c}`").alias(c, metadata=metadata(c)) if c in numeric else F.col(f"`{c}`") for c in df.columns))


def figures(df: DataFrame) -> DataFrame:
    """(figure, precision, missing, rows, nulls) of each tagged column: how far its figures hold, and how many are missing for that reason."""
    about = [(f.name, f.metadata["precision"], f.metadata.get("missing")) for f in df.schema if "precision" in f.metadata]
    counts = df.agg(F.count("*").alias("__rows"), *(F.count(F.col(f"`{name}`")).alias(name) for name, _, _ in about))
    row = lambda name, kind, missing: F.struct(F.lit(name).alias("figure"), F.lit(kind).alias("precision"), F.lit(missing).cast("string").alias("missing"), F.col("__rows").alias("rows"), (F.col("__rows") - F.col(f"`{name}`")).alias("nulls"))
    return counts.select(F.explode(F.array(*(row(*x) for x in about))).alias("r")).select("r.*")
