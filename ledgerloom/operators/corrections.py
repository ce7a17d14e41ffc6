"""Field-level corrections replayed over re-read items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import strip
from ledgerloom.operators.records import upsert

KEYS = ["file_key", "description_key"]


def keyed(df: DataFrame, file: str = "file_name", description: str = "original_description") -> DataFrame:
    return df.withColumns({"file_key": strip(F.col(file)), "description_key": F.lower(strip(F.col(description)))})


def merge_corrections(old: DataFrame, new: DataFrame) -> DataFrame:
    """One correction per item: later values win, the sets of corrected fields unite."""
    return upsert(old, new, ["file_name", "original_description"], unions=["corrected_fields"])


def apply_corrections(items: DataFrame, corrections: DataFrame) -> DataFrame:
    """items with the named fields overwritten, their confidence raised and the review flag cleared.

    A correction that names no field is a dismissal: it changes no value and clears the flag."""
    fixes = keyed(corrections).select(*KEYS, F.col("rate").alias("_rate"), F.col("unit").alias("_unit"), F.col("venue").alias("_venue"), F.coalesce("corrected_fields", F.array().cast("array<string>")).alias("_fields"))
    joined = keyed(items).join(fixes, KEYS, "left")
    names = lambda f: F.array_contains("_fields", f) & F.col(f"_{f}").isNotNull()
    fixed = F.col("_fields").isNotNull()
    new = {
        "historical_rate": F.when(names("rate"), F.col("_rate")).otherwise(F.col("historical_rate")),
        "unit": F.when(names("unit"), F.col("_unit")).otherwise(F.col("unit")),
        "venue": F.when(names("venue"), F.col("_venue")).otherwise(F.col("venue")),
        "rate_confidence": F.when(names("rate"), "high").otherwise(F.col("rate_confidence")),
        "venue_confidence": F.when(names("venue"), "high").otherwise(F.col("venue_confidence")),
        "needs_review": F.when(fixed, False).otherwise(F.col("needs_review")),
        "flag_reason": F.when(fixed & (F.size("_fields") > 0), F.concat(F.lit("corrected: "), F.array_join(F.array_sort("_fields"), ", "))).when(fixed, "dismissed").otherwise(F.col("flag_reason")),
    }
    return joined.withColumns(new).select(items.columns)


def review_reasons(rate: str = "historical_rate", description: str = "original_description", venue: str = "venue", confidence: str = "venue_confidence", reason: str = "flag_reason"):
    """array<string>: why an item needs a look; empty for items whose flag was corrected or dismissed."""
    text = F.coalesce(F.col(reason), F.lit(""))
    place = strip(F.coalesce(F.col(venue), F.lit("")))
    marks = F.array(
        F.when(F.coalesce(F.col(rate).cast("double"), F.lit(0.0)) <= 0, "missing unit rate"),
        F.when(F.length(strip(F.coalesce(F.col(description), F.lit("")))) < 3, "missing description"),
        F.when((place == "") | (place == "Venue Unspecified") | F.col(confidence).isin("low", "none"), "unverified venue"),
        F.when(F.lower(text).contains("reconcile"), "totals do not reconcile"),
    )
    return F.when(text.rlike("^(corrected|dismissed)"), F.array().cast("array<string>")).otherwise(F.filter(marks, lambda m: m.isNotNull()))
