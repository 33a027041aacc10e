"""The analysis as one plan: files to views, events, findings, and what is left after suppression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.operators.calls import call_findings, ruled_calls
from codefacts.operators.checks import extra_findings
from codefacts.operators.suppress import without_marked, without_suppressed
from codefacts.sources.code import TOOL, parsed_events, parsed_markers, source_views
from codefacts.sources.shipping import ship

KEY = ["file_idx", "path"]


@dataclass
class Analysis:
    files: DataFrame
    views: DataFrame
    calls: DataFrame  # every call that has a rule
    all_findings: DataFrame
    findings: DataFrame  # those that are not suppressed
    suppressions: DataFrame
    markers: DataFrame
    events: DataFrame

    def release(self) -> None:
        """Drop the cached views and events, once no output is taken any more."""
        self.views.unpersist()
        self.events.unpersist()


def located(findings: DataFrame, files: DataFrame) -> DataFrame:
    return findings.join(files.select("file_idx", "abs_path"), "file_idx")


def kept(findings: DataFrame, files: DataFrame, suppressions: DataFrame, markers: DataFrame, order: str = "seq") -> DataFrame:
    """Findings that neither a rule for their file nor a marker drops; markers see only what the rules leave."""
    return without_marked(without_suppressed(located(findings, files), suppressions), markers, KEY, order).drop("abs_path")


def analyze(files: DataFrame, rules: DataFrame, suppressions: DataFrame, *, compiler: str | None = "clang", tool: str = TOOL) -> Analysis:
    """Everything there is to know about the files. Events are parsed once: persist them in the caller's session if several outputs are taken."""
    ship(files.sparkSession)
    views = source_views(files, compiler).persist()
    events = parsed_events(views).persist()
    calls = ruled_calls(events, rules)
    every = call_findings(calls).unionByName(extra_findings(events))
    markers = parsed_markers(views, tool)
    return Analysis(files, views, calls, every, kept(every, files, suppressions, markers), suppressions, markers, events)


def json_parts(a: Analysis) -> tuple[DataFrame, DataFrame]:
    """(calls, diagnostics) of the JSON report: all ruled calls but suppressed diagnostics, whose category is that of their flags, and the extra findings that are kept.

    The markers are used up by both in one order: calls first.
    """
    extra = a.all_findings.where(F.col("seq") >= F.lit(1 << 32))
    issue = a.calls.where("verdict is not null")
    both = issue.select(*KEY, F.col("seq").cast("long").alias("seq"), "line", "category").unionByName(extra.select(*KEY, "seq", "line", "category"))
    left = kept(both, a.files, a.suppressions, a.markers).select("file_idx", "seq")
    plain = a.calls.where("verdict is null")
    told = issue.join(left, ["file_idx", "seq"], "left_semi").withColumn("is_issue", F.lit(True)).unionByName(plain.withColumn("is_issue", F.lit(False)))
    return told.select("file_idx", "seq", "function", "status", "category", "line", "column", "is_issue"), extra.join(left, ["file_idx", "seq"], "left_semi")
