"""Own small programs with the findings they must give: one scenario each."""

import json
import os
import random

import pytest

from codefacts.functions.cparse import c_events
from codefacts.operators import report, rundb
from codefacts.operators.rules import STATIC, rules
from codefacts.plans.analyze import analyze, json_parts
from codefacts.schemas import C_FILES, SUPPRESS_RULES

BODY = "int f(int fd, char *b, int n) {{\n{}\n}}\n"


def run(spark, sources, suppressions=(), contracts=None):
    rows = [(k, name, f"/src/{name}", text) for k, (name, text) in enumerate(sources.items())]
    return analyze(spark.createDataFrame(rows, C_FILES), rules(spark, contracts), spark.createDataFrame([*suppressions], SUPPRESS_RULES), compiler=None)


def found(analysis):
    return [(r.path, r.line, r.column, r.kind, r.symbol) for r in analysis.findings.orderBy("file_idx", "seq").collect()]


SCENARIOS = {
    "bare": ("  read(fd, b, n);", [(2, 3, "retval_unchecked", "read")]),
    "void": ("  (void)read(fd, b, n);", [(2, 9, "retval_unchecked", "read")]),
    "void_pointer": ("  (void *)read(fd, b, n);", [(2, 11, "retval_unchecked", "read")]),
    "conditions": ("  if (read(fd, b, n) < 0) n = 1;\n  while (write(fd, b, n) > 0) n--;\n  do { n++; } while (close(fd));\n  for (; fsync(fd) < 0;) n++;", []),
    "returned": ("  return read(fd, b, n);", []),
    "stored_and_checked": ("  int r = read(fd, b, n);\n  if (r < 0) return 1;", []),
    "stored_in_switch": ("  int r = read(fd, b, n);\n  switch (r) { case 0: n = 1; }", []),
    "stored_and_acknowledged": ("  int r = read(fd, b, n);\n  (void)r;", []),
    "stored_and_helper": ("  int r;\n  r = read(fd, b, n);\n  check_result(r);", []),
    "stored_and_passed_on": ("  int r = read(fd, b, n);\n  use(r);", [(2, 11, "return_value_check", "read")]),
    "stored_part_of_name": ("  int r = read(fd, b, n);\n  if (rr) return 1;", [(2, 11, "return_value_check", "read")]),
    "stored_in_condition": ("  if ((n = read(fd, b, n)) < 0) n = 0;", [(2, 12, "return_value_check", "read")]),
    "switch_on_call": ("  switch (open(b, n)) { default: n = 1; }", []),
    "comparison_statement": ("  read(fd, b, n) < 0;", [(2, 3, "retval_unchecked", "read")]),
    "two_on_a_line": ("  read(fd, b, n); write(fd, b, n);", [(2, 3, "retval_unchecked", "read"), (2, 19, "retval_unchecked", "write")]),
    "nested": ("  if (f(read(fd, b, n), b, n)) n = 1;", []),
    "argument": ("  use(read(fd, b, n));", []),
    "comma_in_return": ("  return (read(fd, b, n), 0);", []),
    "member_call_ignored": ("  ops->read(fd, b, n);", []),
    "dangerous": ("  strcpy(b, b);\n  sprintf(b, \"x\");", [(2, 3, "dangerous_function", "strcpy"), (3, 3, "dangerous_function", "sprintf")]),
    "formats": ("  printf(b);\n  fprintf(f, b);\n  if (snprintf(b, n, b) < 0) n = 1;\n  printf(\"%d\", n);", [(2, 3, "format_string", "printf"), (3, 3, "format_string", "fprintf"), (4, 7, "format_string", "snprintf")]),
    "joined_literals": ('  printf("a" "b");', [(2, 3, "format_string", "printf")]),
    "format_missing": ("  printf();", []),
    "environment": ('  char *h = getenv("HOME");\n  if (h) n = 1;\n  clearenv();\n  getenv(b);', [(2, 13, "insecure_env_usage", "HOME"), (4, 3, "insecure_env_usage", "clearenv"), (5, 3, "insecure_env_usage", "getenv")]),
    "allocation": ("  char *p = malloc(sizeof (p));", [(2, 13, "return_value_check", "malloc"), (2, 13, "malloc_size_mismatch", "p")]),
    "allocation_cast_hides": ("  char *p = (char *)malloc(sizeof(p));\n  if (!p) n = 1;", []),
    "double_free": ("  free(b);\n  n = 1;\n  free(b);", [(4, 3, "double_close", "b")]),
    "freed_three_times": ("  free(b);\n  free(b);\n  free(b);", [(3, 3, "double_close", "b"), (4, 3, "double_close", "b")]),
    "free_assign_free": ("  free(b);\n  b = 0;\n  free(b);", []),
    "both_terminal": ("  free(b);\n  free(b);\n  return 0;", []),
    "goto_terminal": ("  if (n) { free(b); goto out; }\n  free(b);\nout:\n  return 0;", []),
    "goto_elsewhere": ("  if (n) { free(b); goto out; }\n  free(b);\nout:\n  n = 2;", [(3, 3, "double_close", "b")]),
    "close_uses_result": ("  free(b);\n  b = g(free(b));", [(3, 9, "double_close", "b")]),
    "address_ignored": ("  free(&b);\n  free(&b);", []),
    "macro_body_ignored": ("#define R read(fd, b, n)\n  n = 1;", []),
    "comment_and_string": ('  n = 1; /* read(fd, b, n); */\n  use("read(fd, b, n);"); // write(1, b, n);', []),
    "clean": ("  int r = open(b, n);\n  if (r < 0) { return -1; }\n  if (close(r) != 0) { return -1; }\n  return 0;", []),
}


@pytest.fixture(scope="module")
def scenarios(spark):
    return found(run(spark, {f"{name}.c": BODY.format(text) for name, (text, _) in SCENARIOS.items()}))


@pytest.mark.parametrize("name", SCENARIOS)
def test_scenario(scenarios, name):
    assert [r[1:] for r in scenarios if r[0] == f"{name}.c"] == SCENARIOS[name][1]


def test_order_calls_first_then_checks(spark):
    text = BODY.format("  free(b);\n  free(b);\n  gets(b);") + "int g(char *p) { getenv(p); read(1, p, 2); return 0; }\n"
    assert [r[3] for r in found(run(spark, {"a.c": text}))] == ["dangerous_function", "retval_unchecked", "double_close", "insecure_env_usage"]


def test_markers(spark):
    text = BODY.format(
        "  read(fd, b, n); // mc:ignore\n  read(fd, b, n); write(fd, b, n); // NOLINT(codefacts)\n  // mc:ignore\n  // mc:ignore\n  fsync(fd);\n  close(fd);\n  use(\"// mc:ignore\"); lseek(fd, 0, 0);\n  /* mc:ignore */ dup(fd);"
    )
    assert [(r[1], r[4]) for r in found(run(spark, {"a.c": text}))] == [(3, "write"), (7, "close"), (8, "lseek"), (9, "dup")]


def test_file_suppression_and_runs(spark):
    from codefacts.functions.text import glob_regex

    src = BODY.format("  read(fd, b, n);\n  gets(b);")
    rows = [("/src/a.c", "return_value_check", False, None), ("/src/b*.c", "dangerous_function", True, glob_regex("/src/b*.c"))]
    a = run(spark, {"a.c": src, "b1.c": src, "c.c": "int x;\n"}, rows)
    assert [(r[0], r[4]) for r in found(a)] == [("a.c", "gets"), ("b1.c", "read")]
    runs = rundb.run_rows(a.files, a.findings)
    assert {(r.filename, r.error_count) for r in runs.collect()} == {("a.c", 1), ("b1.c", 1), ("c.c", 0)}
    facts = rundb.fact_rows(a.findings, runs)
    assert {(r.run_id, r.kind, r.symbol, r.details) for r in facts.collect()} == {(1, "dangerous_function", "gets", "col 3: warning: use of dangerous function gets()"), (2, "retval_unchecked", "read", "col 3: unchecked return value of read()")}
    found_rows = rundb.find_similar(facts, runs, "gets").collect()
    assert [(r.filename, r.symbol) for r in found_rows] == [("a.c", "gets")]
    assert rundb.find_similar(facts, runs, '"return value" AND symbol:re*').count() == 1
    assert rundb.find_similar(facts, runs, "function NOT gets").count() == 0
    assert rundb.find_similar(facts, runs, "(gets OR read) col").count() == 2


def test_reports(spark):
    a = run(spark, {"a.c": BODY.format('  read(fd, b, n);\n  snprintf(b, n, "x");\n  if (close(fd)) n = 1;\n  getenv("A\\"B");')})
    assert [r.line_text for r in report.text_lines(a.findings).orderBy("seq").collect()][:1] == ["a.c:2:3: ignored return of read(): unchecked return value of read()"]
    assert all(": warning: " in r.line_text for r in report.text_lines(a.findings, gcc=True).collect())
    doc = json.loads(report.json_files(a.files, *json_parts(a)).first().json)
    assert [(c["function"], c["status"], c["category"]) for c in doc["calls"]] == [("read", "unchecked", "return_value_check"), ("snprintf", "unchecked", "format_string"), ("close", "checked_cond", "return_value_check")]
    assert doc["issue_count"] == 3 and doc["diagnostics"][0]["category"] == "insecure_env_usage"
    result = json.loads(report.sarif_results(a.findings).orderBy("seq").first().json)
    assert result["ruleId"] == "return_value_check" and result["locations"][0]["physicalLocation"]["region"] == {"startLine": 2, "startColumn": 3}
    assert json.loads(report.view_lines(a.views).first().json)["pp_user"] is None


def test_exit_status():
    plain = dict(warn_exit=False, gcc=False, sarif=False, as_json=False)
    assert report.exit_status(False, 2, **plain) == 0
    assert report.exit_status(False, 2, **(plain | {"warn_exit": True})) == 1
    assert report.exit_status(False, 2, **(plain | {"gcc": True})) == 1
    assert report.exit_status(False, 2, **(plain | {"gcc": True, "as_json": True})) == 0
    assert report.exit_status(False, 0, **(plain | {"sarif": True})) == 0
    assert report.exit_status(True, 0, **plain) == 1


def test_static_table():
    assert len(STATIC) == 141
    assert sum(v == 1 for v in STATIC.values()) == 119


def test_line_map_and_bytes():
    events = c_events("int f(void) {\n  /* é */ read(1, 0, 0);\n}\n", [10, 20, 30])
    assert [(e["line"], e["column"]) for e in events if e["kind"] == "call"] == [(20, 12)]


def test_parser_takes_anything():
    rnd = random.Random(3)
    pieces = ["int ", "x", "(", ")", "{", "}", ";", "=", "*", "if", "for", "while", "case", '"s"', "'c'", "//x\n", "/*", "*/", "#d\n", ",", "[", "]", "return ", "goto ", ":", "?", "read", "é"]
    for _ in range(1500):
        c_events("".join(rnd.choice(pieces) for _ in range(rnd.randrange(40))))


def test_double_release_equals_a_sequential_model(spark):
    from pyspark.sql import functions as F

    from codefacts.operators.checks import repeated_release

    rnd, rows, expected = random.Random(1), [], []
    for func in range(60):
        held = {}
        for seq in range(25):
            var, kind, terminal = rnd.choice("abc"), rnd.choice(["close", "close", "clear"]), rnd.random() < 0.3
            rows.append((func, seq, var, kind, terminal, seq + 100))
            if kind == "clear":
                held.pop(var, None)
            elif var in held:
                expected.append((func, seq, held[var]))
            elif not terminal:
                held[var] = seq + 100
    df = spark.createDataFrame(rows, "func int, seq int, var string, kind string, terminal boolean, line int")
    out = repeated_release(df, ["func", "var"], "seq", is_clear=F.col("kind") == "clear", keeps=(F.col("kind") == "close") & ~F.col("terminal"), value=F.col("line")).where("kind = 'close' and first_release is not null")
    assert sorted((r.func, r.seq, r.first_release) for r in out.collect()) == sorted(expected)


def test_markers_equal_a_sequential_model(spark):
    from codefacts.operators.suppress import mark_inline

    rnd, findings, markers, expected = random.Random(2), [], [], []
    for f in range(80):
        nexts, sames = {rnd.randrange(30) for _ in range(4)}, {rnd.randrange(30) for _ in range(4)}
        markers += [(f, m, "next") for m in nexts] + [(f, m, "same") for m in sames]
        free, same = set(nexts), set(sames)
        for seq in range(12):
            line = rnd.randrange(1, 30)
            findings.append((f, seq, line))
            used = {m for m in free if m < line}
            here = line in same
            free -= used
            same.discard(line)
            expected.append((f, seq, bool(used) or here))
    out = mark_inline(spark.createDataFrame(findings, "f int, seq int, line int"), spark.createDataFrame(markers, "f int, line int, kind string"), ["f"])
    assert sorted((r.f, r.seq, r.suppressed) for r in out.collect()) == sorted(expected)


def test_minimal_view_equals_a_sequential_model(spark):
    from codefacts.functions.text import minimal_view

    def model(s):
        out, k = [], 0
        put = lambda: out.append(" ") if not out or out[-1] != " " else None
        while k < len(s):
            if s.startswith("//", k):
                end = s.find("\n", k)
                if end < 0:
                    break
                put()
                k = end + 1
            elif s.startswith("/*", k):
                end = s.find("*/", k + 2)
                if end < 0:
                    break
                put()
                k = end + 2
            elif s[k] in " \t\n":
                put()
                k += 1
            elif s[k] == "/" and out and out[-1] == " ":
                out.append("/")
                k += 1
                while k < len(s) and s[k] in " \t\n":  # the blank after such a slash is swallowed
                    k += 1
                if s[k : k + 2] in ("//", "/*"):
                    raise ValueError("not modelled")
            else:
                out.append(s[k])
                k += 1
        return "".join(out)

    rnd, cases = random.Random(5), []
    while len(cases) < 400:
        s = "".join(rnd.choice(["a", "b", " ", "\n", "\t", "*", "//", "/*", "*/", '"']) for _ in range(rnd.randrange(14)))
        try:
            if "/ /" in s or "/\n/" in s or "/\t/" in s:
                continue
            cases.append((s, model(s)))
        except ValueError:
            continue
    from pyspark.sql import functions as F

    got = spark.createDataFrame(cases, "s string, want string").withColumn("got", minimal_view(F.col("s"))).where("got <> want").collect()
    assert not got


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from codefacts.plans import cli

    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.c").write_text(BODY.format("  read(fd, b, n);"))
    assert cli.run_analyzer(["a.c", "--db", str(tmp_path / "db")]) == 0
    assert capsys.readouterr().out == "a.c:2:3: ignored return of read(): unchecked return value of read()\n"
    assert cli.run_analyzer(["a.c", "missing.c", "--db", str(tmp_path / "db"), "--gcc"]) == 1
    assert "warning: ignored return" in capsys.readouterr().err
    assert sorted((r.id, r.error_count) for r in spark.read.parquet(str(tmp_path / "db/runs")).collect()) == [(1, 1), (2, 1)]
    assert cli.run_search([str(tmp_path / "db"), "return NOT write"]) == 0
    assert capsys.readouterr().out == 2 * "a.c|retval_unchecked|read|col 3: unchecked return value of read()\n"
    assert cli.run_search([str(tmp_path / "db"), "( x"]) == 1
    assert cli.run_analyzer(["--json", "--sarif", "a.c"]) == 1 and cli.run_analyzer([]) == 1 and cli.run_analyzer(["--nothing"]) == 1 and cli.run_analyzer(["--help"]) == 0
    capsys.readouterr()
    (tmp_path / "rules").write_text("# rules\na.c return_value_check\nshort\n")
    assert cli.run_analyzer(["a.c", "--no-db", "--warn-exit", "--suppressions", "rules"]) == 0
    assert cli.run_analyzer(["a.c", "--no-db", "--sarif"]) == 1
    assert json.loads(capsys.readouterr().out)["version"] == "2.1.0"
    assert not os.path.exists("codefacts.db")
    (tmp_path / "db.json").write_text(json.dumps([{"directory": ".", "file": "a.c", "command": "cc a.c"}]))
    monkeypatch.setattr(cli, "COMPILER", "no-such-compiler")
    assert cli.run_analyzer(["a.c", "--no-db", "--compdb", "db.json"]) == 1
    assert cli.run_analyzer(["a.c", "--no-db", "--compdb", "nothing.json"]) == 1


def test_failed_sarif_run_prints_nothing(spark, tmp_path, capsys, monkeypatch):
    from pyspark.sql import functions as F

    from codefacts.plans import cli

    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.c").write_text(BODY.format("  read(fd, b, n);"))
    a = run(spark, {"a.c": "int x;\n"})
    a.findings = a.findings.unionByName(spark.range(1).select(*[F.lit(None).cast(t).alias(c) for c, t in a.findings.dtypes if c != "message"], F.raise_error(F.lit("injected")).cast("string").alias("message")))
    options = cli.analyzer_options().parse_args(["a.c", "--sarif", "--db", str(tmp_path / "db")])
    assert cli.emit(spark, a, options) == 1
    assert capsys.readouterr().out == ""
    assert [r.error_count for r in spark.read.parquet(str(tmp_path / "db/runs")).collect()] == [1]


def test_contracts_add_findings(spark):
    src = {"a.c": BODY.format("  mmap(0, n, 1, 2, fd, 0);\n  logf_(b);")}
    contracts = spark.createDataFrame([("mmap", 1), ("logf_", 4)], "name string, flags int")
    assert found(run(spark, src)) == []
    assert [r[3:] for r in found(run(spark, src, contracts=contracts))] == [("retval_unchecked", "mmap"), ("format_string", "logf_")]


def test_view_pages(spark):
    page = report.view_pages(run(spark, {"a.c": "int x; // y\n"}).views).first().page
    assert "=== min ===\nint x; " in page and "=== pp_user ===\n(none)" in page
