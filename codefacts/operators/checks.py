"""Checks beside the call rules: environment use, allocation sizes, double release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Findings of these checks stand after all findings on calls.
LATER = 1 << 32


def _finding(events: DataFrame, name: str, symbol: Column, message: Column) -> DataFrame:
    return events.select("file_idx", "path", (F.col("seq") * 4 + LATER).cast("long").alias("seq"), "line", "column", symbol.alias("symbol"), F.lit(name).alias("category"), F.lit(name).alias("kind"), message.alias("message"), F.lit(False).alias("issue_format"))


def environment_findings(events: DataFrame) -> DataFrame:
    """Every use of the process environment in a function; a literal name is reported as the symbol."""
    f, named = F.col("function"), F.col("var").isNotNull()
    symbol = F.when(named & (F.col("var") != ""), F.col("var").substr(1, 63)).otherwise(f)
    message = F.when(named, F.concat(F.lit("insecure_env_usage: environment variable '"), symbol, F.lit("' accessed via "), f, F.lit("()"))).otherwise(F.concat(F.lit("insecure_env_usage: environment accessed via "), f, F.lit("()")))
    return _finding(events.where("kind = 'env'"), "insecure_env_usage", symbol, message).withColumn("seq", F.col("seq") + 1)


def allocation_findings(events: DataFrame) -> DataFrame:
    """Declarations whose allocation is sized by the pointer that they declare."""
    v = F.col("var")
    message = F.concat(F.lit("malloc_size_mismatch: allocation for '"), v, F.lit("' uses sizeof("), v, F.lit("); did you mean sizeof(*"), v, F.lit(") or sizeof(type)?"))
    return _finding(events.where("kind = 'alloc'"), "malloc_size_mismatch", v, message)


def repeated_release(events: DataFrame, by: list[str], order: str, *, is_clear: Column, keeps: Column, value: Column) -> DataFrame:
    """events with first_release: of each row the value of the first release that still counted before it.

    A clear starts a new epoch of its partition; a release counts unless keeps is false. Two windows over one
    sort of the partition: the epoch's running number, then the first counting value in the epoch.
    """
    w = Window.partitionBy(*by).orderBy(order)
    epochs = events.withColumn("_epoch", F.sum(is_clear.cast("int")).over(w))
    inside = Window.partitionBy(*by, "_epoch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return epochs.withColumn("first_release", F.first(F.when(keeps, value), ignorenulls=True).over(inside)).drop("_epoch")


def double_close_findings(events: DataFrame) -> DataFrame:
    """Releases of a variable that was released before on a path that goes on, and not assigned since."""
    marked = repeated_release(
        events.where("kind in ('close', 'clear')"), ["file_idx", "path", "func_id", "var"], "seq",
        is_clear=F.col("kind") == "clear", keeps=(F.col("kind") == "close") & ~F.col("terminal"), value=F.col("line"),
    ).where("kind = 'close' and first_release is not null")
    message = F.concat(F.lit("double_close: second call to "), F.col("function"), F.lit("("), F.col("var"), F.lit("); first at line "), F.col("first_release").cast("string"))
    return _finding(marked, "double_close", F.col("var"), message)


def extra_findings(events: DataFrame) -> DataFrame:
    return environment_findings(events).unionByName(allocation_findings(events)).unionByName(double_close_findings(events))
