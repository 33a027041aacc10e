"""Command line: analyse C files; build the contract store from documentation."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codefacts.operators import report, rundb, specs
from codefacts.operators.rules import contract_rules, rules
from codefacts.plans.analyze import analyze, json_parts
from codefacts.schemas import FINDINGS
from codefacts.sources import pages, stores
from codefacts.sources.code import TOOL, folder_files, listed_files
from codefacts.sources.compdb import compile_database, with_compile_entry
from codefacts.sources.suppressions import suppress_rules


COMPILER = "clang"


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        self.print_usage(sys.stderr)
        print(message, file=sys.stderr)
        raise SystemExit(1)


def session() -> SparkSession:
    spark = SparkSession.builder.appName("codefacts").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def analyzer_options() -> argparse.ArgumentParser:
    p = _Parser(prog="codefacts-analyze", description="Report unchecked results, dangerous calls and resource mistakes in C files.", allow_abbrev=False)
    p.add_argument("files", nargs="*")
    p.add_argument("--json", action="store_true", help="one JSON document")
    p.add_argument("--sarif", action="store_true", help="one SARIF 2.1.0 document")
    p.add_argument("--gcc", action="store_true", help="compiler style, to stderr; findings make the status 1")
    p.add_argument("--warn-exit", action="store_true", help="findings make the status 1")
    p.add_argument("--db", default="codefacts.db", help="folder of the run store")
    p.add_argument("--no-db", action="store_true")
    p.add_argument("--contracts", help="folder of the contract store")
    p.add_argument("--compile-commands", "--compdb", dest="compdb", help="compile database")
    p.add_argument("--dump-views", help="file for all views, one JSON object a line")
    p.add_argument("--suppressions", help="file of suppression rules")
    p.add_argument("--folder", help="all sources below a folder of any file system, read by the executors, instead of files")
    p.add_argument("--marker-name", default=TOOL, help="the name that NOLINT(...) must have")
    return p


def run_analyzer(argv: list[str]) -> int:
    try:
        o = analyzer_options().parse_intermixed_args(argv)
    except SystemExit as stop:
        return int(stop.code or 0)
    fail = lambda text: print(text, file=sys.stderr) or 1
    if not o.files and not o.folder:
        return fail("no files")
    if o.files and o.folder:
        return fail("files and --folder exclude one another")
    if o.json and o.sarif:
        return fail("--json and --sarif exclude one another")
    if o.suppressions and not os.access(o.suppressions, os.R_OK):
        return fail(f"cannot read {o.suppressions}")
    spark = session()
    contracts = None
    if o.contracts:
        try:
            contracts = contract_rules(*(stores.read_table(spark, o.contracts, t) for t in ("functions", "function_sections", "function_aliases")))
        except Exception as e:  # a store that can't be opened costs its rules, not the run
            print(f"warning: no contract store: {e}", file=sys.stderr)
    files = folder_files(spark, o.folder) if o.folder else listed_files(spark, o.files)
    if o.compdb:
        try:
            database = compile_database(spark, o.compdb)
            database.count()
        except Exception:
            return fail(f"cannot load {o.compdb}")
        files = with_compile_entry(files, database)
        if shutil.which(COMPILER) is None and files.where("in_database").count():
            return fail(f"no preprocessed text for files of {o.compdb}: {COMPILER} is not there")
    try:
        a = analyze(files, rules(spark, contracts), suppress_rules(spark, o.suppressions), tool=o.marker_name)
        if o.dump_views:
            with open(o.dump_views, "w", encoding="utf-8") as f:
                f.writelines(r.json + "\n" for r in report.view_lines(a.views).orderBy("file_idx").toLocalIterator())
        return emit(spark, a, o)
    except OSError as e:
        return fail(str(e))
    except Exception as e:
        return fail(f"analysis failed: {e}")


def emit(spark: SparkSession, a, o) -> int:
    findings = a.findings.persist()
    if o.sarif:
        try:
            findings.count()
        except Exception as e:  # nothing is printed; the runs tell of the failure
            print(f"analysis failed: {e}", file=sys.stderr)
            if not o.no_db:
                failed = {r.path: 1 for r in a.files.select("path").collect()}
                write_runs(spark, a.files, spark.createDataFrame([], FINDINGS), o.db, failed)
            return 1
    if o.json:
        calls, diagnostics = json_parts(a)
        told = [json.loads(r.json) for r in report.json_files(a.files, calls, diagnostics).orderBy("file_idx").toLocalIterator()]
        print(json.dumps({"files": told}, indent=1, ensure_ascii=False))
        counts = {f["path"]: f["issue_count"] for f in told}
        issues = sum(counts.values())
    elif o.sarif:
        results = [json.loads(r.json) for r in report.sarif_results(findings).orderBy("file_idx", "seq").toLocalIterator()]
        print(json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": report.TOOL}}, "results": results}]}, indent=1, ensure_ascii=False))
        issues = len(results)
    else:
        issues, out = 0, sys.stderr if o.gcc else sys.stdout
        for r in report.text_lines(findings, gcc=o.gcc).orderBy("file_idx", "seq").toLocalIterator():
            issues += 1
            print(r.line_text, file=out)
    if not o.no_db:
        try:
            write_runs(spark, a.files, findings, o.db, None if not o.json else counts)
        except Exception as e:
            print(f"warning: no run store: {e}", file=sys.stderr)
    return report.exit_status(False, issues, warn_exit=o.warn_exit, gcc=o.gcc, sarif=o.sarif, as_json=o.json)


def write_runs(spark: SparkSession, files, findings, store: str, counts: dict | None = None) -> None:
    """Append a run for each file; and a fact, with its terms, for each finding unless counts are given instead."""
    last = stores.read_table(spark, store, "runs").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    runs = rundb.run_rows(files, findings, int(last) + 1).persist()
    if counts is not None:
        told = spark.createDataFrame([*counts.items()], "filename string, told int")
        runs = runs.join(told, "filename", "left").withColumn("error_count", F.coalesce("told", F.lit(0))).select(runs.columns)
    else:
        facts = rundb.fact_rows(findings, runs).persist()
        stores.append(facts, store, "facts")
        stores.append(rundb.fact_terms(facts), store, "fact_terms")
    stores.append(runs.drop("file_idx"), store, "runs")


def run_builder(argv: list[str]) -> int:
    """STORE SECTION NAME..., STORE --scan-section S, STORE --scan-all, or STORE --folder PATH of rendered pages."""
    if len(argv) < 2 or argv[1] in ("--scan-section", "--folder") and len(argv) != 3 or not argv[1].startswith("--") and len(argv) < 3:
        print(run_builder.__doc__, file=sys.stderr)
        return 1
    spark, store = session(), argv[0]
    if argv[1] == "--folder":
        found = pages.rendered_pages(spark, argv[2])
    elif argv[1] == "--scan-section":
        found = pages.host_pages(pages.host_index(spark, argv[2]))
    elif argv[1] == "--scan-all":
        found = pages.host_pages(pages.host_index(spark))
    else:
        found = pages.host_pages(spark.createDataFrame([(n, argv[1]) for n in argv[2:]], "name string, section string"))
    return build_store(spark, found, store)


def build_store(spark: SparkSession, found, store: str) -> int:
    names = ("functions", "function_sections", "function_aliases")
    read = found.where("raw <> ''").persist()
    if read.isEmpty():
        print("no page has any text; the store stays as it is", file=sys.stderr)
        return 1
    after = specs.upsert(tuple(stores.read_table(spark, store, n) for n in names), specs.parse_pages(read))
    stores.swap(dict(zip(names, after)), store)
    read.unpersist()
    return 0


def run_search(argv: list[str]) -> int:
    """STORE QUERY: the facts of the latest runs that a full-text query fits."""
    if len(argv) != 2:
        print(run_search.__doc__, file=sys.stderr)
        return 1
    spark = session()
    facts, runs, index = (stores.read_table(spark, argv[0], t) for t in ("facts", "runs", "fact_terms"))
    try:
        for r in rundb.find_similar(facts, runs, argv[1], index).collect():
            print("|".join((r.filename, r.kind, r.symbol, r.details)))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def main() -> int:
    argv = sys.argv[1:]
    if argv[:1] == ["search"]:
        return run_search(argv[1:])
    if argv[:1] == ["build-contracts"]:
        return run_builder(argv[1:])
    return run_analyzer(argv)


if __name__ == "__main__":
    sys.exit(main())
