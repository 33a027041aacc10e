"""Documentation pages, contracts, compile databases, and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from codefacts.functions.text import glob_regex, terms
from codefacts.operators import specs
from codefacts.operators.rules import DANGEROUS, FORMAT, MUST_CHECK, contract_answer, contract_rules, rules
from codefacts.sources import code, compdb, pages, stores
from codefacts.operators import rundb

PAGE = """PAGE(2)
NAME
       grab, take - obtain - a thing

SYNOPSIS
       #include <grab.h>
       int grab(const char *fmt, ...);

DESCRIPTION
       This call is deprecated.
RETURN VALUE
       Zero.
       EAGAIN
       later
"""


@pytest.fixture(scope="module")
def batch(spark):
    rows = [("grab", "2", PAGE), ("plain", "3", "NAME\n  plain\nBUGS\n none\n"), ("empty", "3", "no title")]
    return specs.parse_pages(spark.createDataFrame(rows, "name string, section string, raw string"))


def test_sections_metadata_aliases(batch):
    functions, sections, aliases = batch
    got = [(r.section_name, r.content) for r in sections.where("name = 'grab'").orderBy("ord").collect()]
    assert got == [
        ("PAGE(2)", ""), ("NAME", "grab, take - obtain - a thing"), ("SYNOPSIS", "#include <grab.h>\n       int grab(const char *fmt, ...);"),
        ("DESCRIPTION", "This call is deprecated."), ("RETURN VALUE", "Zero."), ("EAGAIN", "later"),
    ]
    meta = {r.name: (r.short_name, r.short_desc, r.header, r.proto) for r in functions.collect()}
    assert meta == {"grab": ("grab, take", "obtain - a thing", "<grab.h>", "#include <grab.h>"), "plain": ("plain", None, None, None), "empty": (None, None, None, None)}
    assert {(r.name, r.alias_name) for r in aliases.collect()} == {("grab", "grab"), ("grab", "take"), ("plain", "plain"), ("empty", "empty")}


def test_store_upsert_contracts_lookup(spark, batch, tmp_path):
    from codefacts.plans.cli import build_store

    store = str(tmp_path / "contracts")
    page = lambda *rows: spark.createDataFrame([*rows], "name string, section string, raw string")
    build_store(spark, page(("grab", "2", PAGE), ("old", "3", "NAME\n old - x\n")), store)
    read = lambda: tuple(stores.read_table(spark, store, t) for t in ("functions", "function_sections", "function_aliases"))
    first = {r.name: r.id for r in read()[0].collect()}
    assert sorted(first.values()) == [1, 2]
    build_store(spark, page(("grab", "2", PAGE.replace("take", "seize")), ("new", "3", "NAME\n new - x\nRETURN VALUE\n y\n")), store)
    functions, sections, aliases = read()
    ids = {r.name: r.id for r in functions.collect()}
    assert ids == first | {"new": 3}
    assert {(r.function_id, r.alias_name) for r in aliases.collect()} == {(ids["grab"], "grab"), (ids["grab"], "seize"), (ids["old"], "old"), (ids["new"], "new")}
    found = {r.name: r.flags for r in contract_rules(functions, sections, aliases).collect()}
    assert found == {"grab": MUST_CHECK | DANGEROUS | FORMAT, "seize": MUST_CHECK | DANGEROUS | FORMAT, "new": MUST_CHECK}
    merged = {r.name: r.flags for r in rules(spark, spark.createDataFrame([("read", 2), ("mmap", 1)], "name string, flags int")).collect()}
    assert merged["read"] == 1 and merged["mmap"] == 1
    left = specs.delete_pages((functions, sections, aliases), functions.where("name = 'grab'"))
    assert [df.join(functions.where("name = 'grab'").selectExpr("id as function_id"), "function_id", "left_semi").count() for df in left[1:]] == [0, 0] and left[0].count() == 2
    asked = spark.createDataFrame([("seize",), ("old",)], "name string")
    assert {(r.name, r.answer) for r in contract_answer(contract_rules(functions, sections, aliases), asked, MUST_CHECK).collect()} == {("seize", True), ("old", False)}
    hit = specs.lookup(spark.createDataFrame([("seize", "2"), ("seize", "3")], "name string, section string"), functions, sections, aliases).collect()
    assert [(r.name, r.page_name, [s.name for s in r.sections][:3]) for r in hit] == [("seize", "grab", ["PAGE(2)", "NAME", "SYNOPSIS"])]


def test_missing_store_is_empty(spark, tmp_path):
    assert stores.read_table(spark, str(tmp_path / "none"), "runs").count() == 0


def test_page_index_and_warnings(spark):
    lines = spark.createDataFrame([("read (2)  - read it",), ("  open ( 3p ) - x",), ("nothing",)], "value string")
    assert {(r.name, r.section) for r in pages.page_index(lines).collect()} == {("read", "2"), ("open", "3p")}
    assert pages.page_index(lines, "2").count() == 1
    text = spark.createDataFrame([("a\n  warning: x\nb",), ("",)], "value string").select(pages.without_warnings(F.col("value")).alias("v"))
    assert [r.v for r in text.collect()] == ["a\nb\n", ""]


def test_compile_database(spark, tmp_path):
    (tmp_path / "a.c").write_text("int x;\n")
    entries = [{"directory": ".", "file": "a.c", "arguments": ["cc", "-D", "X=it's", "-O2"]}, {"directory": str(tmp_path), "file": "a.c", "command": "cc -DY a.c"}, {"file": "/no/b.c", "command": "cc"}]
    path = tmp_path / "compile_commands.json"
    path.write_text(json.dumps(entries))
    db = compdb.compile_database(spark, str(path))
    rows = db.orderBy("entry").collect()
    assert rows[0].resolved_file == str(tmp_path / "a.c") and rows[0].command == "'cc' '-D' 'X=it'\\''s' '-O2'" and rows[2].resolved_file == "/no/b.c"
    files = spark.createDataFrame([(0, "a.c", str(tmp_path / "a.c"), "")], "file_idx long, path string, abs_path string, raw string")
    assert compdb.with_compile_entry(files, db).first().arguments == ["cc", "-D", "X=it's", "-O2"]
    path.write_text("[{")
    with pytest.raises(Exception):
        compdb.compile_database(spark, str(path)).collect()


def test_shell_words_and_flags():
    assert compdb.shell_words(r"""cc -I'a b' "c\"d" e\ f 'x\'y' """) == ["cc", "-Ia b", 'c"d', "e f", "x'y"]
    assert compdb.preprocessor_flags(["cc", "-std", "c99", "-DX", "-U", "Y", "-I", "p", "-O2", "-c", "a.c"]) == ["-std=c99", "-DX", "-U", "Y", "-I", "p"]
    with pytest.raises(ValueError):
        compdb.preprocessor_flags(["-D"])


def test_user_lines(spark):
    pp = '# 1 "/s/a.c"\nint a;\n# 1 "/usr/h.h"\nint h;\n# 5 "/s/a.c" 2\n#pragma x\nint b;\nint c;'
    row = code.user_lines(spark.createDataFrame([(0, "/s/a.c", pp)], "file_idx long, abs_path string, pp string"), ["file_idx", "abs_path"]).first()
    assert row.pp_user == "int a;\nint b;\nint c;" and row.line_map == [1, 5, 6]


def test_globs_and_terms(spark):
    import re

    assert re.match(glob_regex("/s/*.c"), "/s/a.c") and not re.match(glob_regex("/s/*.c"), "/s/t/a.c")
    assert re.match(glob_regex("/s/[!a]?.c"), "/s/bb.c") and not re.match(glob_regex("/s/[!a]?.c"), "/s/ab.c")
    assert spark.range(1).select(terms(F.lit("Pthread_Create: Été-2")).alias("t")).first().t == ["pthread", "create", "ete", "2"]


def test_stream(spark, tmp_path):
    from codefacts.operators.rules import static_rules
    from codefacts.schemas import SUPPRESS_RULES
    from codefacts.streaming.watch import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.c").write_text("int f(int d) { close(d); return 0; }\n")
    q = watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), static_rules(spark), spark.createDataFrame([], SUPPRESS_RULES), checkpoint=str(tmp_path / "cp"))
    q.awaitTermination()
    assert [r.symbol for r in spark.read.parquet(str(tmp_path / "out/facts")).collect()] == ["close"]
    assert [r.error_count for r in spark.read.parquet(str(tmp_path / "out/runs")).collect()] == [1]


def test_search_equals_a_full_text_engine(spark):
    import random
    import sqlite3

    rnd, words = random.Random(5), ["a", "b", "c", "ab", "n"]
    rows = [(k, " ".join(rnd.choices(words, k=rnd.randrange(6))), " ".join(rnd.choices(words, k=rnd.randrange(9)))) for k in range(60)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(symbol, details)")
    con.executemany("INSERT INTO t(rowid, symbol, details) VALUES (?, ?, ?)", rows)
    index = rundb.fact_terms(spark.createDataFrame(rows, "id long, symbol string, details string")).persist()
    phrase = lambda: rnd.choice(["a", "b", "c", "a*", '"a b"', "a + c", "^b", '^"a b"', "n", "zz"])
    item = lambda: rnd.choice([phrase, lambda: f"NEAR(a {rnd.choice('bc')}, {rnd.randrange(4)})", lambda: f"symbol:{phrase()}", lambda: f"-symbol : {phrase()}", lambda: f"{{symbol details}} : {phrase()}", lambda: "details:NEAR(a b c, 2)"])()
    fixed = ["a NOT b c", "a b NOT c OR n", "a OR b AND c NOT n", "(a OR b) AND c", "symbol:(a OR b)", "NEAR(a c)", "^a", "a NOT b NOT c"]
    asked = fixed + [rnd.choice([" ", " AND ", " OR ", " NOT "]).join(item() for _ in range(rnd.randrange(1, 4))) for _ in range(22)]
    for q in asked:
        want = sorted(x for (x,) in con.execute("SELECT rowid FROM t WHERE t MATCH ?", (q,)))
        assert sorted(r.fact_id for r in rundb.matching(index, q).collect()) == want, q
    index.unpersist()


def test_marks_stay_in_their_word(spark):
    index = rundb.fact_terms(spark.createDataFrame([(1, "cafe\u0301 noir", "x")], "id long, symbol string, details string"))
    assert [r.fact_id for r in rundb.matching(index, "café").collect()] == [1] and {r.term for r in index.collect()} == {"cafe", "noir", "x"}


def test_latest_runs(spark):
    runs = spark.createDataFrame([(1, "a.c", 3), (2, "b.c", 0), (3, "a.c", 1)], "id long, filename string, error_count int")
    assert {(r.filename, r.id, r.error_count) for r in rundb.latest_runs(runs).collect()} == {("a.c", 3, 1), ("b.c", 2, 0)}
    assert [r.id for r in rundb.latest_runs(runs, "b%").collect()] == [2]


def test_a_store_is_replaced_at_once(spark, tmp_path):
    from codefacts.sources import stores

    store = str(tmp_path / "store")
    row = lambda k: spark.createDataFrame([(k, 1, f"alias{k}")], "id long, function_id long, alias_name string")
    read = lambda: [r.id for r in stores.read_table(spark, store, "function_aliases").collect()]
    assert read() == []
    for k in range(1, 5):
        early = stores.read_table(spark, store, "function_aliases")
        stores.swap({"function_aliases": row(k)}, store)
        assert read() == [k] and [r.id for r in early.collect()] == ([k - 1] if k > 1 else [])
    stores.append(row(9), store, "function_aliases")
    assert sorted(read()) == [4, 9]
    row(7).write.parquet(f"{store}/function_aliases-torn")  # a writer that stopped before its manifest
    assert sorted(read()) == [4, 9]
