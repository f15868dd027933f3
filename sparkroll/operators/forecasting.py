"""Forecast rows: answer and probability lists that arrive as strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkroll.functions.grading import grade_numeric_tolerant


def parse_lists(rows: DataFrame, answers: str = "answers_str", probs: str = "probs_str") -> DataFrame:
    """JSON list strings to arrays; `valid` means both parsed, not empty and of equal length."""
    parsed = rows.withColumns({"answers": F.from_json(answers, "array<string>"), "probs": F.from_json(probs, "array<double>")})
    valid = F.col("answers").isNotNull() & F.col("probs").isNotNull() & (F.size("answers") > 0) & (F.size("answers") == F.size("probs"))
    return parsed.withColumn("valid", F.coalesce(valid, F.lit(False)))


def forecast_unroll(parsed: DataFrame, key: str) -> DataFrame:
    """One row per pair of a valid row; probabilities outside [0, 1] are dropped."""
    pairs = F.arrays_zip("answers", "probs")
    rows = parsed.where("valid").select(key, F.posexplode(pairs).alias("idx", "p"))
    return rows.select(key, F.col("idx").cast("bigint").alias("idx"), F.col("p.answers").alias("answer"), F.col("p.probs").alias("prob")).where("prob between 0 and 1 and answer is not null")


def extraction_target(parsed: DataFrame) -> DataFrame:
    """Distinct answers after the first, joined; "No Answer" for a single one; all null for an invalid row, which stays."""
    rest = F.array_distinct(F.slice("answers", F.lit(2), F.greatest(F.size("answers") - 1, F.lit(0))))
    target = F.when(F.size("answers") == 1, "No Answer").otherwise(F.array_join(rest, "; "))
    return parsed.withColumn("target", F.when(F.col("valid"), target))


def list_set_match(predictions: Column, answers: Column, same=grade_numeric_tolerant) -> Column:
    """After removing repeats and cutting predictions to the last len(answers), each side is covered by the other."""
    wanted = F.array_distinct(answers)
    given = F.array_distinct(predictions)
    given = F.when(F.size(given) > F.size(wanted), F.slice(given, -F.size(wanted), F.size(wanted))).otherwise(given)
    return F.forall(given, lambda g: F.exists(wanted, lambda w: same(g, w))) & F.forall(wanted, lambda w: F.exists(given, lambda g: same(g, w)))
