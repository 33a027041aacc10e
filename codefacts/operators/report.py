"""Reports: text, compiler style, JSON, SARIF, and the dump of views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOOL = "codefacts"


def text_lines(findings: DataFrame, *, gcc: bool = False) -> DataFrame:
    """(file_idx, seq, line_text) of each finding."""
    place = F.concat_ws(":", "path", "line", "column")
    said = F.when(F.col("issue_format"), F.concat(F.lit("ignored return of "), F.col("symbol"), F.lit("(): "), F.col("message"))).otherwise(F.col("message"))
    if gcc:
        said = F.when(said.startswith("warning: "), said).otherwise(F.concat(F.lit("warning: "), said))
    return findings.select("file_idx", "seq", F.concat(place, F.lit(": "), said).alias("line_text"))


def json_files(files: DataFrame, calls: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(file_idx, json): one object a file: its ruled calls, the findings of the extra checks, and the number of issues.

    calls: file_idx, seq, function, status, category, line, column, is_issue; diagnostics: findings.
    """
    rows = lambda df, *cols: F.transform(F.array_sort(F.collect_list(F.struct("seq", *cols))), lambda x: F.struct(*[x[c].alias(c) for c in cols]))
    c = calls.groupBy("file_idx").agg(rows(calls, "function", "status", "category", "line", "column").alias("calls"), F.sum(F.col("is_issue").cast("int")).alias("n_calls"))
    d = diagnostics.groupBy("file_idx").agg(rows(diagnostics, "category", "symbol", "message", "line", "column").alias("diagnostics"), F.count(F.lit(1)).alias("n_diagnostics"))
    none = lambda name, like: F.coalesce(F.col(name), F.array().cast(like)).alias(name)
    count = (F.coalesce("n_calls", F.lit(0)) + F.coalesce("n_diagnostics", F.lit(0))).alias("issue_count")
    joined = files.select("file_idx", "path").join(c, "file_idx", "left").join(d, "file_idx", "left")
    kinds = dict(joined.dtypes)
    return joined.select("file_idx", F.to_json(F.struct("path", none("calls", kinds["calls"]), none("diagnostics", kinds["diagnostics"]), count)).alias("json"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """(file_idx, seq, json): one SARIF result a finding."""
    region = F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("category").alias("ruleId"), F.lit("warning").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.select("file_idx", "seq", F.to_json(result).alias("json"))


def view_lines(views: DataFrame) -> DataFrame:
    """(file_idx, json): one object a file with all views; a missing one is null."""
    return views.select("file_idx", F.to_json(F.struct("path", "raw", "min", "pp_user"), {"ignoreNullFields": "false"}).alias("json"))


def view_pages(views: DataFrame) -> DataFrame:
    """(file_idx, page): all views of a file, one after the other, to be read by people."""
    part = lambda c: F.concat(F.lit(f"=== {c} ===\n"), F.coalesce(F.col(c), F.lit("(none)")), F.lit("\n"))
    return views.select("file_idx", F.concat(F.lit("##### "), F.col("path"), F.lit("\n"), *[part(c) for c in ("raw", "min", "pp_user")]).alias("page"))


def exit_status(failed: bool, issues: int, *, warn_exit: bool, gcc: bool, sarif: bool, as_json: bool) -> int:
    """1 if anything failed, or if there are issues and the mode or an option asks for it."""
    return int(failed or issues > 0 and (warn_exit and not sarif or gcc and not as_json and not sarif or sarif))
