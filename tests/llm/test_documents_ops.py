"""URL filter, near duplicates, language, line templates and the pipeline."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codefacts.llm import components, language_id, line_templates, near_dedup, url_filter
from codefacts.llm.common import wide_hash
from codefacts.llm.queries import QUERIES, SQL
from tests.conftest import SF, as_rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, tables, name):
    assert as_rows(QUERIES[name](spark, SF).toPandas()) == as_rows(tables.sql(SQL[name]).df())


def test_components_equal_union_find(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, 2001 + k) for k in range(60)] + [(5, 5), (None, 3), (1000, 1001)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in [*root]}
    assert components.components(spark.createDataFrame([], "src long, dst long")).count() == 0


URLS = [
    (1, "HTTP://A.Evil.NET/x?q#f", None), (2, "http://shop.org/a", '<LINK REL="canonical" href="http://A.evil.net/x?q">'), (3, None, "x"), (4, "nope", ""),
    (5, "http://c.com/1", '<meta http-equiv=refresh content="0; URL=/2">'), (6, "http://c.com/2", "<link href=//shop.org/a rel=canonical>"), (7, "http://www.c.com/2?ref=1&utm_s=3", None),
    (7, "http://www.c.com/2?ref=1&utm_s=3", None), (8, "http://e.example.net/en/a", '<link rel=canonical href="http://z.com/">'), (9, "http://z.com", '<link rel=canonical href="http://bad.net/">'),
    (None, "http://x.example.com/de/1", ""), (11, "http://net/", ""), (12, "http://anet/", ""), (13, "http://q.net", None), (14, "a://b\nc.net/d", None), (15, "http://x.org/fr/a", "<link rel=canonical href=>"),
    (21, "http://www.dup.com/p?utm_a=1", "one body"), (22, "http://dup.com/p", "one body"), (23, "http://m.dup.com/p", "another body"), (24, "http://w.net/1", "<link rel=canonical href='http://dup.com/p'>"),
]


def test_url_filter_on_odd_pages(spark):
    import duckdb

    pages = spark.createDataFrame([(*r, "clash", "x") for r in URLS], "page_id long, url string, html string, host string, node string")
    rules = url_filter.rule_table(spark, url_filter.RULES)
    got = url_filter.filter_urls(pages, rules).toPandas()
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(URLS, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    want = con.sql(url_filter.OP2_SQL).df()
    plain = lambda f: as_rows(f.astype({"page_id": "Int64"}))
    assert plain(got) == plain(want)
    verdict = {r.page_id: r.verdict for r in got.itertuples()}
    assert [verdict[k] for k in (1, 2, 5, 6, 21, 22, 24)] == ["block"] * 7 and [verdict[k] for k in (7, 8, 9, 12, 15, 23)] == ["allow"] * 6
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    redirects = spark.createDataFrame([("http://anet/", "http://w.net/a")], "src string, dst string")
    assert {r.page_id: r.verdict for r in url_filter.filter_urls(pages, rules, redirects).collect()}[12] == "block"


def test_relative_and_repeated_links_reach_their_pages(spark):
    links = [
        ("<link rel=canonical href='page2.html'>", "shop.org/a/page2.html"), ("<link rel=canonical href='?id=1'>", "shop.org/a/b.html?id=1"), ("<link rel=canonical href='../x'>", "shop.org/x"), ("<link rel=canonical href='./../../y/.'>", "shop.org/y/"),
        ("<link rel=canonical href='http://h.org/a?x=1&amp;y=2&#38;z=&#x3b1;&amp;lt;'>", "h.org/a?x=1&y=2&z=\u03b1&lt;"), ('<link rel="alternate canonical" href=/c>', "shop.org/c"), ("<link rel='shortcut canonical' href=/s>", "shop.org/s"),
        ("<meta http-equiv=refresh content='5; url=one'><meta http-equiv='refresh' content='0; url=&quot;two&quot;'>", "shop.org/a/two"), ("<link rel=canonical href=/first><link rel=canonical href=/second>", "shop.org/second"),
        ("<base href='/deep/er/'><link rel=canonical href='f'>", "shop.org/deep/er/f"), ("<link rel=canonical href='mailto:a@b.c'>", None), ("<link rel=canonical href='#top'>", None), ("<link rel=stylesheet href='canonical'>", None),
    ]
    pages = spark.createDataFrame([(k, f"http://shop.org/a/b.html#{k}" if dst else f"http://none.org/{k}", html) for k, (html, dst) in enumerate(links)], "page_id long, url string, html string")
    edges = {tuple(r) for r in url_filter.page_edges(pages).collect()}
    assert {d for s, d in edges if s == "shop.org/a/b.html"} >= {d for _, d in links if d} and not [d for s, d in edges if s != "shop.org/a/b.html" and d]
    table = [(1, "http://a.net/x/1", "<link rel=canonical href='../z/2'>"), (2, "http://a.net/z/2", None), (3, "http://b.net/", "<meta http-equiv=refresh content='0; url=http://c.org/?p=1&amp;q=2'>"), (4, "http://c.org/?p=1&q=2", None)]
    pages = spark.createDataFrame(table, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, url_filter.rule_table(spark, url_filter.RULES)).collect()}
    assert got[4].verdict == "block" and got[1].alias_of == got[2].alias_of == "a.net/x/1"


def words(rnd, n):
    return [f"w{rnd.randrange(4000)}" for _ in range(n)]


def test_near_duplicates_equal_brute_force(spark):
    rnd, texts = random.Random(7), []
    for _ in range(12):  # groups of copies that differ more and more
        base = words(rnd, 160)
        for k in range(12):
            t = [*base]
            for _ in range(rnd.randrange(1 + k)):
                t[rnd.randrange(len(t))] = f"x{rnd.randrange(10**6)}"
            texts.append(" ".join(t))
        texts += [" ".join(base[:cut]) for cut in (100, 120, 135, 150)]
    texts += [" ".join(words(rnd, 50)) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(1000 + k, texts[5]) for k in range(60)] + [(2000, None), (2001, None), (2002, ""), (2003, ""), (2004, "..."), (2005, "two words"), (2006, "Two, words!"), (None, texts[5]), (None, "alone here now"), (3, texts[3])]
    rows += [(3000, "a b c d e f g " * 30_000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, class_id string, h int")
    got = near_dedup.near_duplicate_classes(df).toPandas()
    assert len(got) == len(rows)
    distinct = near_dedup.distinct_texts(df.select("doc_id", "text", wide_hash("text").alias("h")))
    documents, sketch = near_dedup.document_frequencies(distinct.select("text"))
    assert documents == len({t for _, t in rows if t is not None}) + 1  # one row is repeated, id and all
    of = near_dedup.Weights(documents, sketch)
    first, vectors = {}, {}
    for k, t in rows:
        if t is not None and k is not None:
            first[t] = min(first.get(t, k), k)
    vectors = {t: of(t) for t in first}
    root = {t: t for t in first}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(first, 2):
        if near_dedup.weighted_jaccard(vectors[a], vectors[b]) >= 0.8:
            root[find(a)] = find(b)
    least = {}
    for t, k in first.items():
        least[find(t)] = min(least.get(find(t), k), k)
    want = {k: least[find(t)] for k, t in rows if t is not None and k is not None} | {2000: 2000, 2001: 2001}
    assert {r.doc_id: r.class_id for r in got.dropna(subset=["doc_id"]).itertuples()} == want
    kept = got[got.kept].doc_id.tolist()
    assert sorted(set(x for x in kept if x == x)) == sorted(set(want.values()))
    assert near_dedup.near_duplicate_classes(df.limit(0)).count() == 0


def test_a_stray_meets_its_leaders_members_once(spark):
    rows = [("L", f"h{k}", "main") for k in range(5000)] + [("L", "stray", "other")] + [("M", f"m{k}", "one") for k in range(300)]
    rows += [("N", f"n{k}", f"c{k % 3}") for k in range(700)]
    members = spark.createDataFrame(rows, "leader string, h string, component string")
    met = near_dedup.members_in_blocks(members).toPandas()
    assert len(met[met.leader == "L"]) < 3 * 5001 and not len(met[met.leader == "M"])
    assert met.groupby(["leader", "i", "j", "among"]).size().max() <= 4 * near_dedup.BLOCK
    pairs = set()
    for _, g in met[met.leader == "N"].groupby(["i", "j", "among"]):
        pairs |= {frozenset((a, b)) for (a, x), (b, y) in itertools.combinations(zip(g.h, g.component), 2) if x != y}
    assert len(pairs) == sum(1 for (_, _, x), (_, _, y) in itertools.combinations(rows[-700:], 2) if x != y)


def test_weights_are_built_once_a_task_not_once_a_group(spark, tmp_path):
    import numpy as np

    class Sent:  # stands for the broadcast; notes each reading
        def __init__(self, path):
            self.path = path

        @property
        def value(self):
            with open(self.path, "a") as f:
                f.write("x")
            return 100, np.zeros((near_dedup.DEPTH, 1 << 16), np.int64)

    rnd, rows, want = random.Random(5), [], set()
    for k in range(40):
        base = words(rnd, 60)
        rows += [(f"L{k}", f"h{k}.{j}".encode(), f"c{k}.{j}".encode(), " ".join(base if j < 2 else words(rnd, 60)) + f" tail{j}") for j in range(3)]
        want.add((f"h{k}.0".encode(), f"h{k}.1".encode()))
    table = spark.createDataFrame(rows, "leader string, h binary, component binary, text string")
    found = near_dedup.links_among_members(table.drop("text"), table.select("h", "text"), Sent(str(tmp_path / "read")), 5, 0.8)
    assert {(bytes(r.a), bytes(r.b)) for r in found.collect()} == want
    assert (tmp_path / "read").stat().st_size <= 4  # the partitions


def test_samples_agree_as_weighted_jaccard():
    import numpy as np

    rnd = np.random.default_rng(3)
    keys = np.unique(rnd.integers(0, 2**63, 900).astype(np.uint64))
    wa, wb = rnd.uniform(0.5, 3, 700).astype(np.float32), rnd.uniform(0.5, 3, 700).astype(np.float32)
    a, b = (keys[:700], wa), (keys[150:850], wb)
    s = near_dedup.samples(np.concatenate([a[0], b[0]]), np.concatenate([wa, wb]), np.array([0, 700]), 2000)
    assert abs((s[0] == s[1]).mean() - near_dedup.weighted_jaccard(a, b)) < 0.05


def test_language_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = language_id.op9(spark, SF).join(docs, "doc_id").toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.95 and 0.1 < got.held_out.mean() < 0.35


def test_language_odd_texts(spark):
    rows = [(1, "le chat est sur la table et le chien aussi", "fr"), (2, "the cat is on the table and the dog too", "en"), (3, None, "en"), (4, "", None), (5, "123 !! ½ ² Ⅷ", "fr"), (6, "zqx", None), (7, "the dog " * 50_000, "en"), (1, "le chien", "fr")]
    df = spark.createDataFrame([(*r, "clash", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    model = language_id.fit(df)
    assert model.languages == ["en", "fr"]
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert [got[k].lang_pred for k in range(1, 8)] == ["fr", "en", "und", "und", "und", "en", "en"]
    assert got[6].score == 0 and language_id.identify(df, model).count() == len(rows)
    assert language_id.identify(df.limit(0), model).count() == 0
    nothing = language_id.fit(df.limit(0))
    assert {r.lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"}


def test_bit_slices_hold_every_inserted_ngram(spark):
    import numpy as np

    model = language_id.fit(spark.createDataFrame([("alpha beta", "a"), ("gamma delta", "b")], "text string, lang string"))
    for j, t in enumerate(("alpha beta", "gamma delta")):
        f = language_id.features(t)
        assert model.hits(f, np.array([0]))[0, j] == len(f)


@pytest.mark.parametrize("n", [20_000, 60_000, 200_000])
def test_false_positive_rate_is_as_claimed(n):
    import numpy as np

    rnd = np.random.default_rng(n)
    grams = rnd.integers(0, 2**64, 2 * n, dtype=np.uint64)
    for rows in (language_id.rows_for(n), language_id.rows_for(n) // 2):
        slices = np.zeros(rows, np.uint64)
        for at in language_id.places(grams[:n], rows):
            slices[at] = 1
        model = language_id.Filters(["x"], 0, [slices])
        measured = model.hits(grams[n:], np.array([0]))[0, 0] / n
        assert abs(model.wrong[0] / measured - 1) < 0.2
    assert language_id.rows_for(n) < 32 * n


def test_ngrams_of_real_letters_spread_over_the_rows():
    import numpy as np

    text = " ".join(a + b + c + d for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzabcd" for d in "efghijklmn")
    known, other = (np.unique(language_id.features(t)) for t in (text, text.upper().translate({k: k + 1000 for k in range(65, 91)})))
    other = np.setdiff1d(other, known)
    rows = language_id.rows_for(len(known))
    slices = np.zeros(rows, np.uint64)
    for at in language_id.places(known, rows):
        slices[at] = 1
    model = language_id.Filters(["x"], 0, [slices])
    assert abs(model.hits(other, np.array([0]))[0, 0] / len(other) - model.wrong[0]) < 0.004


LINES = [(k, f"Own line {chr(97 + k)}{chr(98 + k)} of this text\nPrinted page {k} of 900\nShared footer of all pages\n  Error at place {'xyzuvwqrst'[k]} in module main of app\n", "en") for k in range(10)]


def test_line_templates_on_odd_texts(spark):
    import duckdb

    rows = LINES + [(20, None, None), (21, "", "x"), (22, "\n\n", "x"), (23, "Shared footer of all pages", "x"), (None, "tab\tline 1\r\nShared footer of all pages\nmore of this\nand more words here", None), (3, LINES[3][1], "en")]
    rows += [(100 + k, "copy one line\ncopy two line\nThe same", "x") for k in range(50)]
    rows += [(200, "word " * 100_000, "x")]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, lang string, leaf string, n_lines_dropped int")
    got = line_templates.drop_recurring_lines(df)
    assert got.columns == ["doc_id", "text", "lang", "leaf", "n_lines_dropped"]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang"]).astype({"doc_id": "Int64"}))
    want = con.sql(line_templates.OP10_SQL).df()
    plain = lambda f: as_rows(f.astype({"doc_id": "Int64"}))
    assert plain(got.select("doc_id", "text", "n_lines_dropped").toPandas()) == plain(want)
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[4].text == LINES[4][1].split("\n")[0] + "\n" and by_id[4].n_lines_dropped == 3
    assert by_id[23].text == "" and by_id[23].n_lines_dropped == 1 and by_id[110].n_lines_dropped == 0
    assert line_templates.drop_recurring_lines(df.limit(0)).count() == 0


def test_every_template_of_a_leaf_is_found(spark):
    kinds = [("file was read by %s from disk alpha on host", 8), ("file was read in %s under lock beta at night", 8), ("user has gone off %s without any last word", 8), ("user has gone to the same old place again", 60)]
    own = lambda n, k: " ".join(f"{x}{chr(97 + n)}{chr(97 + k // 26)}{chr(97 + k % 26)}" for x in "pqrst")
    rows = [(100 * n + k, f"{own(n, k)}\n{line.replace('%s', own(n, k)[:4])}\nz{own(n, k)}") for n, (line, many) in enumerate(kinds) for k in range(many)]
    for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        n, k = divmod(r.doc_id, 100)
        assert (r.text, r.n_lines_dropped) == (f"{own(n, k)}\nz{own(n, k)}", 1)


def test_few_lines_are_dealt_once_a_vote(spark):
    rows = [(k % 7, f"s{k}", 2, f"a b c w{k % 5} x{k % 3}") for k in range(400)]
    lines = spark.createDataFrame(rows, "part long, sig string, docs long, masked string")
    seen = line_templates.voted(*line_templates.dealt(lines, len(rows)))
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2  # of the lines and of their words, and no more for the join
    assert seen.count() == len(rows) and seen.where("same >= 0.6").count() > 0


def test_garbage_of_the_driver_is_collected_between_tables(spark):
    from codefacts.llm.common import COLLECT, Scratch, cut

    beans = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    work = Scratch(spark, "garbage")
    for kept in (work.keep, cut):
        before = beans()
        for k in range(COLLECT):
            assert kept(spark.range(k)).count() == k
        assert beans() > before
    work.remove()


def test_shingles_are_runs_of_five_words(spark):
    texts = ["a b c d e f g", "a b c d e", " a  b\tc\r\nd ", "one", "f g a b c d e f g a b c d e f g"]
    got = [len(r.s) for r in spark.createDataFrame([(t,) for t in texts], "text string").select(line_templates.shingles(F.col("text")).alias("s")).collect()]
    assert got == [len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) for w in map(str.split, texts)]


def test_pages_of_nothing_but_boilerplate_are_cleaned(spark):
    rows = [(k, f"Cookie notice accept all\nSign in to continue here\nown{chr(97 + k)}") for k in range(10)]
    rows += [(100 + k, f"job step done alpha beta gamma delta v{chr(97 + k)}") for k in range(10)] + [(200 + k, f"job step done one two three four v{chr(97 + k)}") for k in range(6)]
    got = {r.doc_id: (r.text, r.n_lines_dropped) for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: (f"own{chr(97 + k)}", 2) for k in range(10)} | {k: ("", 1) for k, _ in rows[10:]}


def test_what_only_copies_share_stays(spark):
    rnd = random.Random(3)
    base = [" ".join(words(rnd, 12)) for _ in range(40)]
    near = [(k, "\n".join([*base[:k], f"changed{chr(97 + k)} here", *base[k + 1 :], "Common footer"])) for k in range(20)]
    other = [(100 + k, " ".join(words(rnd, 30)) + "\nCommon footer") for k in range(4)]
    passage = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    held = [(200 + k, " ".join(words(rnd, 90)) + f"\n{passage}") for k in range(3)]
    rows = near + other + held
    got = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in near + other:
        assert got[k] == text.removesuffix("\nCommon footer")
    assert sorted(passage in got[k] for k, _ in held) == [False, False, True]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).persist()
        assert docs.columns == before.columns and docs.dtypes == before.dtypes
        assert docs.count() <= n
    classes = near_dedup.near_duplicate_classes(docs).toPandas()
    assert classes.class_id.nunique() == len(classes)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, SF).count() == len(packed)


def test_pipeline_takes_odd_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "the cat sat on the mat", "en", "s", 22), (2, None, None, None, None), (None, "the cat sat on the mat", None, "s", 22), (3, "", "en", "s", 0), (1, "the cat sat on the mat", "en", "s", 22)]
    for table, left in ((rows, 1), ([], 0)):
        docs = spark.createDataFrame(table, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
        assert docs.count() == left
    wide = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], schema + ", _h int, _id int, _drop int, _found int, coverage int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        wide = stage(spark, wide, SF)
    assert [tuple(r) for r in wide.collect()] == [(1, "the cat sat on the mat", "en", "s", 22, 1, 2, 3, 4, 5)]
