"""Dropping findings: by file and category, and by markers in the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Suppression rules up to this many are sent to every executor; more are joined by category.
MOST_BROADCAST = 10_000


def without_suppressed(findings: DataFrame, rules: DataFrame, path: str = "abs_path") -> DataFrame:
    """Findings that no rule of their category fits: the same path, or a pattern that matches it."""
    r = rules.select(F.col("category").alias("_category"), F.col("path").alias("_path"), "is_glob", "regex")
    if rules.count() <= MOST_BROADCAST:
        r = F.broadcast(r)
    fits = (F.col("category") == F.col("_category")) & F.expr(f"CASE WHEN is_glob THEN `{path}` RLIKE regex ELSE `{path}` = _path END")
    return findings.join(r, fits, "left_anti")


def mark_inline(findings: DataFrame, markers: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """findings with suppressed: whether a marker that is still unused drops the row.

    In order, a row uses up every next-diagnostic marker above it that no earlier row has used, and the
    same-line marker of its line. A marker has been used by the rows before if it lies above the highest
    line any of them has; so a running maximum and a row number by line replace the running state.
    markers: key, line, kind ('next' or 'same').
    """
    seen = Window.partitionBy(*key).orderBy(order)
    lines = markers.groupBy(*key).agg(F.collect_set(F.when(F.col("kind") == "next", F.col("line"))).alias("_next"), F.collect_set(F.when(F.col("kind") == "same", F.col("line"))).alias("_same"))
    state = (
        findings.withColumn("_high", F.coalesce(F.max("line").over(seen.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_nth", F.row_number().over(Window.partitionBy(*key, "line").orderBy(order)))
        .join(lines, key, "left")
    )
    above = F.exists("_next", lambda m: (m >= F.col("_high")) & (m < F.col("line")))
    here = (F.col("_nth") == 1) & F.array_contains("_same", F.col("line"))
    return state.withColumn("suppressed", F.coalesce(above, F.lit(False)) | F.coalesce(here, F.lit(False))).drop("_high", "_nth", "_next", "_same")


def without_marked(findings: DataFrame, markers: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    return mark_inline(findings, markers, key, order).where(~F.col("suppressed")).drop("suppressed")
