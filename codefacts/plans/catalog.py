"""Every query of the engine on the driver's tables, with the SQL that states its result.

The tables hold no source code, so each operator runs here on data of the same shape: events stand for
positions in a file, documents for pages, users for files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.functions.text import glob_regex, has_word, minimal_view, terms
from codefacts.operators import report, rundb, specs
from codefacts.operators.checks import repeated_release
from codefacts.operators.rules import DANGEROUS, FORMAT, MUST_CHECK, WARNING_PHRASES, WARNING_SECTIONS, category, contract_answer, contract_rules, mentions_any, section_flags, two_tier
from codefacts.operators.suppress import mark_inline, without_suppressed
from codefacts.sources.code import user_lines
from codefacts.sources.pages import without_warnings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PHRASES = ("token", "password", "license", "rights reserved")
GLOBS = (("*://*.example.com/*", "com"), ("http://*.example.net/en/[0-9]*", "net"), ("https://www.*", "any"), ("*://?.*/??/*", "one"))
LINE_SQL = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents"


@query(
    "q01_two_tier_rules",
    """
WITH fixed(name, flags) AS (VALUES ('FRANCE', 1), ('GERMANY', 2), ('CHINA', 6), ('ATLANTIS', 4)),
looked_up AS (SELECT n_name AS name, CAST(1 + count(*) % 7 AS INTEGER) AS flags FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name),
rules AS (SELECT * FROM fixed UNION ALL SELECT * FROM looked_up WHERE name NOT IN (SELECT name FROM fixed))
SELECT n_nationkey, n_name, flags FROM nation JOIN rules ON n_name = name""",
)
def q01(spark, d):
    nation = table(spark, d, "nation")
    fixed = spark.createDataFrame([("FRANCE", 1), ("GERMANY", 2), ("CHINA", 6), ("ATLANTIS", 4)], "name string, flags int")
    looked_up = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("name")).agg((1 + F.count(F.lit(1)) % 7).cast("int").alias("flags"))
    return nation.join(two_tier(fixed, looked_up), F.col("n_name") == F.col("name")).select("n_nationkey", "n_name", "flags")


@query(
    "q02_category",
    """
WITH f AS (SELECT o_orderkey, CAST((CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) + (CASE WHEN o_orderpriority LIKE '1%' THEN 2 ELSE 0 END) + (CASE WHEN o_orderstatus = 'O' THEN 4 ELSE 0 END) AS INTEGER) AS flags FROM orders)
SELECT category, count(*) AS n FROM (SELECT CASE WHEN flags & 2 <> 0 THEN 'dangerous_function' WHEN flags & 4 <> 0 THEN 'format_string' WHEN flags & 1 <> 0 THEN 'return_value_check' ELSE 'other' END AS category FROM f) GROUP BY category""",
)
def q02(spark, d):
    bit = lambda test, b: F.when(test, b).otherwise(0)
    flags = bit(F.col("o_totalprice") > 100000, 1) + bit(F.col("o_orderpriority").startswith("1"), 2) + bit(F.col("o_orderstatus") == "O", 4)
    return table(spark, d, "orders").groupBy(category(flags).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("q03_warning_phrases", "SELECT doc_id FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{p}')" for p in PHRASES))
def q03(spark, d):
    return table(spark, d, "documents").where(mentions_any(F.col("text"), PHRASES)).select("doc_id")


@query("q04_format_string", """SELECT doc_id FROM (SELECT doc_id, replace(replace(text, '. ', '... '), 'License', 'format') AS t FROM documents) WHERE contains(t, '...') AND (contains(t, 'format') OR contains(t, 'fmt'))""")
def q04(spark, d):
    content = F.replace(F.replace("text", F.lit(". "), F.lit("... ")), F.lit("License"), F.lit("format"))
    return table(spark, d, "documents").where(section_flags(F.lit("SYNOPSIS"), content).bitwiseAND(FORMAT) != 0).select("doc_id")


def documented(spark, d):
    """(functions, sections, aliases): a document is a function; its labels, its text and its text with some words replaced are sections."""
    docs = table(spark, d, "documents")
    name = F.concat(F.lit("d"), "doc_id")
    functions = docs.select(F.col("doc_id").alias("id"), name.alias("name"), F.col("lang").alias("section"))
    part = lambda df, title, content: df.select(F.col("doc_id").alias("function_id"), F.lit(title).alias("section_name"), content.alias("content"))
    said = F.replace("text", F.lit("License"), F.lit(WARNING_PHRASES[0].upper()))
    form = F.replace(F.replace("text", F.lit(". "), F.lit("... ")), F.lit("License"), F.lit("format"))
    sections = part(table(spark, d, "labels"), "RETURN VALUE", F.lit("")).unionByName(part(docs, WARNING_SECTIONS[0], said)).unionByName(part(docs, "SYNOPSIS", form))
    return functions, sections, docs.where("lang = 'fr'").select(F.col("doc_id").alias("function_id"), F.concat(F.lit("s"), "source").alias("alias_name"))


_LICENSED = "(" + " OR ".join(f"contains(lower(replace(text, 'License', '{WARNING_PHRASES[0]}')), '{p}')" for p in WARNING_PHRASES) + ")"
_FORMED = "(contains(replace(text, '. ', '... '), '...') AND (contains(replace(text, 'License', 'format'), 'format') OR contains(text, 'fmt')))"
DOC_FLAGS_SQL = f"""SELECT doc_id, lang, source, (CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1 ELSE 0 END) + (CASE WHEN {_LICENSED} THEN 2 ELSE 0 END) + (CASE WHEN {_FORMED} THEN 4 ELSE 0 END) AS flags FROM documents"""


@query("q05_flags", f"SELECT doc_id, CAST(flags AS INTEGER) AS flags FROM ({DOC_FLAGS_SQL})")
def q05(spark, d):
    functions, sections, aliases = documented(spark, d)
    rules = contract_rules(functions, sections, aliases.limit(0))
    return functions.join(rules, "name", "left").select(F.col("id").alias("doc_id"), F.coalesce("flags", F.lit(0)).alias("flags"))


@query(
    "q06_exists",
    f"""
WITH f AS ({DOC_FLAGS_SQL}), n AS (SELECT 'd' || doc_id AS name, flags FROM f UNION ALL SELECT 's' || source, flags FROM f WHERE lang = 'fr'),
r AS (SELECT name, bit_or(flags) AS flags FROM n GROUP BY name)
SELECT DISTINCT asked.name, b.flag, coalesce(r.flags & b.flag <> 0, false) AS answer FROM (SELECT 's' || source AS name FROM documents UNION SELECT 'unknown') asked
CROSS JOIN (VALUES (1), (2), (4)) b(flag) LEFT JOIN r ON r.name = asked.name""",
)
def q06(spark, d):
    rules = contract_rules(*documented(spark, d))
    asked = table(spark, d, "documents").select(F.concat(F.lit("s"), "source").alias("name")).unionByName(spark.createDataFrame([("unknown",)], "name string"))
    answers = [contract_answer(rules, asked, flag).select("name", F.lit(flag).alias("flag"), "answer") for flag in (MUST_CHECK, DANGEROUS, FORMAT)]
    return answers[0].unionByName(answers[1]).unionByName(answers[2])


@query(
    "q07_name_or_alias",
    """
SELECT DISTINCT p_name AS name FROM part p JOIN lineitem l ON l.l_partkey = p.p_partkey WHERE l_quantity > 49 AND p_brand LIKE '%1%'
UNION SELECT DISTINCT p_type AS name FROM part p JOIN lineitem l ON l.l_partkey = p.p_partkey WHERE l_quantity > 49 AND p_brand LIKE '%1%'""",
)
def q07(spark, d):
    part = table(spark, d, "part").where(F.col("p_brand").like("%1%"))
    functions = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    aliases = part.select(F.col("p_partkey").alias("function_id"), F.col("p_type").alias("alias_name"))
    from codefacts.operators.rules import names_of

    hit = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("id"))
    return names_of(functions, aliases).join(hit, "id", "left_semi").select("name").distinct()


@query("q08_error_count", "SELECT c_custkey + 7 AS id, c_name AS filename, CAST(count(o_orderkey) AS INTEGER) AS error_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name")
def q08(spark, d):
    files = table(spark, d, "customer").select(F.col("c_custkey").alias("file_idx"), F.col("c_name").alias("path"))
    return rundb.run_rows(files, table(spark, d, "orders").select(F.col("o_custkey").alias("file_idx")), 7).select("id", "filename", "error_count")


def event_findings(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.floor("value").cast("long").alias("line"), "event_type")
    kind = F.when(F.col("event_type") == "view", "next").when(F.col("event_type") == "click", "same")
    return rows.where("event_type = 'error'").drop("event_type"), rows.select("user_id", "line", kind.alias("kind")).where("kind is not null")


@query(
    "q09_inline_suppression",
    """
WITH e AS (SELECT user_id, event_id AS seq, CAST(floor(value) AS BIGINT) AS line, event_type FROM events),
f AS (SELECT user_id, seq, line, coalesce(max(line) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS high,
  row_number() OVER (PARTITION BY user_id, line ORDER BY seq) AS nth FROM e WHERE event_type = 'error')
SELECT user_id, seq, line, EXISTS (SELECT 1 FROM e m WHERE m.event_type = 'view' AND m.user_id = f.user_id AND m.line >= f.high AND m.line < f.line)
  OR (nth = 1 AND EXISTS (SELECT 1 FROM e m WHERE m.event_type = 'click' AND m.user_id = f.user_id AND m.line = f.line)) AS suppressed FROM f""",
)
def q09(spark, d):
    findings, markers = event_findings(spark, d)
    return mark_inline(findings, markers, ["user_id"]).select("user_id", "seq", "line", "suppressed")


@query(
    "q10_one_shot",
    """
WITH e AS (SELECT user_id, event_id AS seq, CAST(floor(value) AS BIGINT) AS line, event_type FROM events)
SELECT user_id, line, count(*) AS n, CAST(sum(CASE WHEN nth = 1 AND EXISTS (SELECT 1 FROM e m WHERE m.event_type = 'click' AND m.user_id = f.user_id AND m.line = f.line) THEN 1 ELSE 0 END) AS BIGINT) AS dropped
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, line ORDER BY seq) AS nth FROM e WHERE event_type = 'error') f GROUP BY user_id, line""",
)
def q10(spark, d):
    findings, markers = event_findings(spark, d)
    return mark_inline(findings, markers.where("kind = 'same'"), ["user_id"]).groupBy("user_id", "line").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("suppressed").cast("long")).alias("dropped"))


@query(
    "q11_double_release",
    """
WITH e AS (SELECT user_id, event_id, event_type, value, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS epoch FROM events WHERE event_type IN ('error', 'signup')),
w AS (SELECT *, first_value(CASE WHEN event_type = 'error' AND value >= 20 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, epoch ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS first_event FROM e)
SELECT user_id, event_id, first_event FROM w WHERE event_type = 'error' AND first_event IS NOT NULL""",
)
def q11(spark, d):
    e = table(spark, d, "events").where("event_type in ('error', 'signup')")
    marked = repeated_release(e, ["user_id"], "event_id", is_clear=F.col("event_type") == "signup", keeps=(F.col("event_type") == "error") & (F.col("value") >= 20), value=F.col("event_id"))
    return marked.where("event_type = 'error' and first_release is not null").select("user_id", "event_id", F.col("first_release").alias("first_event"))


@query(
    "q12_line_map",
    """
WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(x, '#')) AS own FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(own || own, chr(10)) AS pp_user, array_to_string(range(10, 10 + len(own)) || range(3, 3 + len(own)), ',') AS line_map FROM l WHERE len(own) > 0""",
)
def q12(spark, d):
    text = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~x.startswith("#")), "\n")
    pp = F.concat(F.lit('# 1 "other.h"\nnot own\n# 10 "own.c" 1\n'), text, F.lit('\n#line 1 "other.h"\nnot own\n# 3 "own.c"\n#pragma x\n'), text, F.lit('\n# 1 "<built-in>"'))
    rows = table(spark, d, "documents").where(F.size(F.filter(F.split("text", "\n"), lambda x: ~x.startswith("#"))) > 0)
    found = user_lines(rows.select("doc_id", F.lit("own.c").alias("abs_path"), pp.alias("pp")), ["doc_id", "abs_path"])
    return found.select("doc_id", "pp_user", F.array_join("line_map", ",").alias("line_map"))


@query(
    "q13_sections",
    rf"""
WITH l AS (SELECT doc_id, pos, line, regexp_matches(trim(line, ' ' || chr(9)), '^[A-Z0-9[:punct:] \t]{{1,40}}$') AND regexp_matches(line, '[A-Z]') AS title FROM ({LINE_SQL})),
n AS (SELECT *, sum(CASE WHEN title THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS ord FROM l)
SELECT doc_id, CAST(ord AS INTEGER) AS ord, max(CASE WHEN title THEN trim(line, ' ' || chr(9)) END) AS section_name,
  trim(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT title), ''), ' ' || chr(9) || chr(10)) AS content FROM n WHERE ord >= 0 GROUP BY doc_id, ord""",
)
def q13(spark, d):
    return specs.page_sections(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text")


@query(
    "q14_split_first",
    """
WITH l AS (SELECT doc_id, trim(string_split(text, chr(10))[1], ' ' || chr(9)) AS line FROM documents)
SELECT doc_id, CASE WHEN instr(line, '. ') > 0 THEN trim(split_part(line, '. ', 1), ' ' || chr(9) || chr(10)) ELSE trim(line, ' ' || chr(9) || chr(10)) END AS short_name,
  CASE WHEN instr(line, '. ') > 0 THEN trim(substr(line, instr(line, '. ') + 2), ' ' || chr(9) || chr(10)) END AS short_desc FROM l WHERE line <> ''""",
)
def q14(spark, d):
    line = F.trim(F.get(F.split("text", "\n"), F.lit(0)), F.lit(" \t"))
    rows = table(spark, d, "documents").select("doc_id", line.alias("line")).where("line <> ''")
    name, rest = specs.split_first(F.col("line"), ". ")
    return rows.select("doc_id", name.alias("short_name"), rest.alias("short_desc"))


@query(
    "q15_aliases",
    """
SELECT DISTINCT p_partkey AS function_id, alias_name FROM (SELECT p_partkey, unnest(list_concat([p_brand], string_split(replace(p_name, ' ', ','), ','))) AS alias_name FROM part) WHERE alias_name <> ''""",
)
def q15(spark, d):
    names = specs.aliases_of(F.col("p_brand"), F.replace("p_name", F.lit(" "), F.lit(",")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("function_id"), F.explode(names).alias("alias_name"))


@query(
    "q16_lookup",
    """
WITH f AS (SELECT p_partkey AS id, p_name AS name, p_type AS section FROM part),
a AS (SELECT p_partkey AS function_id, unnest(string_split(p_name, ' ')) AS alias_name FROM part),
asked AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS name, p_type AS section FROM part UNION SELECT p_name, p_type FROM part),
c AS (SELECT q.name, q.section, 0 AS prio, f.id FROM asked q JOIN f USING (name, section)
  UNION ALL SELECT q.name, q.section, 1, a.function_id FROM asked q JOIN a ON a.alias_name = q.name JOIN f ON f.id = a.function_id AND f.section = q.section)
SELECT c.name, c.section, id, p_name AS page_name, p_brand AS proto, '2:' || p_brand || '|1:' || p_name AS sections
FROM (SELECT *, row_number() OVER (PARTITION BY name, section ORDER BY prio, id) AS nth FROM c) c JOIN part ON p_partkey = id WHERE nth = 1""",
)
def q16(spark, d):
    part = table(spark, d, "part")
    functions = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("section"), F.col("p_brand").alias("proto"), *[F.lit(None).cast("string").alias(c) for c in ("short_name", "short_desc", "header", "man_source", "raw")])
    aliases = part.select(F.col("p_partkey").alias("function_id"), F.explode(F.split("p_name", " ")).alias("alias_name"))
    asked = part.select(F.get(F.split("p_name", " "), F.lit(0)).alias("name"), F.col("p_type").alias("section")).unionByName(functions.select("name", "section"))
    listed = F.array(F.struct(F.lit(7).alias("ord"), F.lit("1").alias("section_name"), F.col("p_name").alias("content")), F.struct(F.lit(3).alias("ord"), F.lit("2").alias("section_name"), F.col("p_brand").alias("content")))
    sections = part.select(F.col("p_partkey").alias("function_id"), F.explode(listed).alias("x")).select("function_id", "x.*")
    told = F.array_join(F.transform("sections", lambda x: F.concat_ws(":", x["name"], x["content"])), "|")
    return specs.lookup(asked, functions, sections, aliases).select("name", "section", "id", "page_name", "proto", told.alias("sections"))


@query(
    "q17_ordered_collect",
    """
SELECT conv_id, CAST(to_json(list({'turn': turn, 'role': role} ORDER BY turn, role)) AS VARCHAR) AS turns FROM conversations GROUP BY conv_id""",
)
def q17(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(rows).alias("turns"))


@query(
    "q18_upsert",
    """
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1""",
)
def q18(spark, d):
    return specs.latest(table(spark, d, "events"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_type", "event_id", "value")


@query(
    "q19_replace_children",
    """
WITH touched AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000)
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM touched)
UNION ALL SELECT l_orderkey, l_linenumber, l_quantity + 1 FROM lineitem WHERE l_linenumber = 1 AND l_orderkey IN (SELECT o_orderkey FROM touched)""",
)
def q19(spark, d):
    touched = table(spark, d, "orders").where("o_orderstatus = 'F' and o_totalprice > 200000").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = lines.where("l_linenumber = 1").join(touched, "l_orderkey", "left_semi").withColumn("l_quantity", F.col("l_quantity") + 1)
    return specs.replace_children(lines, new, touched, "l_orderkey")


def doc_index(spark, d):
    return rundb.fact_terms(table(spark, d, "documents"), ("text",), "doc_id")


# Latin letters with a decomposition lose their marks; DuckDB's function does it for these texts alike.
TERMS_SQL = "SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos FROM (SELECT doc_id, unnest(string_split_regex(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+')) AS term, unnest(range(len(string_split_regex(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+')))) AS k FROM documents) WHERE term <> ''"


@query(
    "q20_search_all_terms",
    f"""
WITH t AS ({TERMS_SQL}), hit AS (SELECT doc_id FROM t WHERE term IN ('license', 'the') GROUP BY doc_id HAVING count(DISTINCT term) = 2)
SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM hit) ORDER BY n_chars DESC, doc_id LIMIT 32""",
)
def q20(spark, d):
    hits = rundb.matching(doc_index(spark, d), "License the").withColumnRenamed("fact_id", "doc_id")
    return table(spark, d, "documents").select("doc_id", "source", "n_chars").join(hits, "doc_id", "left_semi").orderBy(F.col("n_chars").desc(), "doc_id").limit(32)


@query("q21_search_phrase", f"WITH t AS ({TERMS_SQL}) SELECT DISTINCT a.doc_id FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN t c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2 WHERE a.term = 'the' AND b.term = 'apache' AND c.term = 'license'")
def q21(spark, d):
    return rundb.matching(doc_index(spark, d), '"the Apache License"').withColumnRenamed("fact_id", "doc_id")


@query("q22_search_prefix_not", f"WITH t AS ({TERMS_SQL}) SELECT DISTINCT doc_id FROM t WHERE starts_with(term, 'licen') AND doc_id NOT IN (SELECT doc_id FROM t WHERE term = 'mit')")
def q22(spark, d):
    return rundb.matching(doc_index(spark, d), "licen* NOT MIT").withColumnRenamed("fact_id", "doc_id")


@query(
    "q23_minimal_view",
    r"""
WITH p AS (SELECT page_id, regexp_extract_all(html, '(?s)//[^\n]*\n|/\*.*?\*/|//[^\n]*\z|/\*.*\z|[^/]+|/') AS t FROM pages),
j AS (SELECT page_id, regexp_replace(array_to_string(list_transform(t, lambda x: CASE WHEN (starts_with(x, '//') AND ends_with(x, chr(10))) OR (starts_with(x, '/*') AND ends_with(x, '*/') AND length(x) > 3) THEN ' '
  WHEN starts_with(x, '//') OR starts_with(x, '/*') THEN '' ELSE x END), ''), '[ \t\r\n\f\x0B]+', ' ', 'g') AS s FROM p)
SELECT page_id, regexp_replace(s, ' / ', ' /', 'g') AS min FROM j""",
)
def q23(spark, d):
    return table(spark, d, "pages").select("page_id", minimal_view(F.col("html")).alias("min"))


@query(
    "q24_glob_suppression",
    r'''
WITH u AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN 'com' WHEN 1 THEN 'net' WHEN 2 THEN 'any' ELSE 'one' END AS category FROM pages),
r(category, regex) AS (VALUES ('com', '^[^/]*://[^/]*[.]example[.]com/[^/]*$'), ('net', '^http://[^/]*[.]example[.]net/en/[0-9][^/]*$'), ('any', '^https://www[.][^/]*$'), ('one', '^[^/]*://[^/][.][^/]*/[^/][^/]/[^/]*$'))
SELECT page_id, category FROM u WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.category = u.category AND regexp_matches(u.url, r.regex))''',
)
def q24(spark, d):
    rules = spark.createDataFrame([(g, c, True, glob_regex(g)) for g, c in GLOBS], "path string, category string, is_glob boolean, regex string")
    named = F.element_at(F.array(*[F.lit(c) for c in ("com", "net", "any", "one")]), (F.col("page_id") % 4 + 1).cast("int"))
    rows = table(spark, d, "pages").select("page_id", "url", named.alias("category"))
    return without_suppressed(rows, rules, "url").select("page_id", "category")


@query(
    "q25_latest_runs",
    """
SELECT 'f' || o_custkey AS filename, o_orderstatus AS kind, o_orderpriority AS symbol, 'total ' || CAST(floor(o_totalprice) AS BIGINT) AS details
FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 32""",
)
def q25(spark, d):
    o = table(spark, d, "orders")
    details = F.concat(F.lit("total "), F.floor("o_totalprice").cast("string"))
    facts = o.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("symbol"), details.alias("details"))
    return rundb.find_similar(facts, o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("f"), "o_custkey").alias("filename"), F.col("o_orderdate").alias("ts")), "symbol:urgent NOT medium")


@query("q26_ad_hoc", "SELECT 'f' || o_custkey AS filename, max(o_orderkey) AS id, arg_max(o_totalprice, o_orderkey) AS total FROM orders WHERE CAST(o_custkey AS VARCHAR) LIKE '%7%' GROUP BY o_custkey")
def q26(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("f"), "o_custkey").alias("filename"), F.col("o_totalprice").alias("total"))
    return rundb.latest_runs(runs, "%7%")


@query("q27_whole_word", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z0-9_])of([^A-Za-z0-9_]|$)')")
def q27(spark, d):
    return table(spark, d, "documents").where(has_word(F.col("text"), "of")).select("doc_id")


@query(
    "q28_output_lines",
    r"""
WITH o AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, 'The ', '  warning: The ') ELSE text END AS text FROM documents)
SELECT doc_id, coalesce(array_to_string(list_transform(list_filter(string_split(regexp_replace(text, '\n\z', ''), chr(10)), lambda x: NOT regexp_matches(x, '^[ \t]*warning:')), lambda x: x || chr(10)), ''), '') AS text FROM o""",
)
def q28(spark, d):
    text = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("The "), F.lit("  warning: The "))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", without_warnings(text).alias("text"))


@query(
    "q29_nested_json",
    """
WITH l AS (SELECT l_orderkey, list({'function': l_returnflag, 'status': l_linestatus, 'category': 'c' || l_suppkey, 'line': l_linenumber, 'column': l_partkey} ORDER BY l_linenumber, l_returnflag, l_linestatus, 'c' || l_suppkey, l_partkey) AS calls,
  count(*) FILTER (l_quantity > 25) AS n FROM lineitem WHERE l_discount > 0.03 GROUP BY l_orderkey),
e AS (SELECT l_orderkey, list({'category': l_linestatus, 'symbol': l_returnflag, 'message': 'm' || l_partkey, 'line': l_linenumber, 'column': l_suppkey} ORDER BY l_linenumber, l_linestatus, l_returnflag, 'm' || l_partkey, l_suppkey) AS diagnostics, count(*) AS n
  FROM lineitem WHERE l_discount <= 0.03 GROUP BY l_orderkey)
SELECT o_orderkey AS file_idx, CAST(to_json({'path': 'o' || o_orderkey, 'calls': coalesce(calls, []), 'diagnostics': coalesce(diagnostics, []), 'issue_count': coalesce(l.n, 0) + coalesce(e.n, 0)}) AS VARCHAR) AS json
FROM orders LEFT JOIN l ON l.l_orderkey = o_orderkey LEFT JOIN e ON e.l_orderkey = o_orderkey""",
)
def q29(spark, d):
    files = table(spark, d, "orders").select(F.col("o_orderkey").alias("file_idx"), F.concat(F.lit("o"), "o_orderkey").alias("path"))
    l, at = table(spark, d, "lineitem"), [F.col("l_orderkey").alias("file_idx"), F.col("l_linenumber").alias("seq"), F.col("l_linenumber").alias("line")]
    calls = l.where("l_discount > 0.03").select(*at, F.col("l_returnflag").alias("function"), F.col("l_linestatus").alias("status"), F.concat(F.lit("c"), "l_suppkey").alias("category"), F.col("l_partkey").alias("column"), (F.col("l_quantity") > 25).alias("is_issue"))
    extra = l.where("l_discount <= 0.03").select(*at, F.col("l_linestatus").alias("category"), F.col("l_returnflag").alias("symbol"), F.concat(F.lit("m"), "l_partkey").alias("message"), F.col("l_suppkey").alias("column"))
    return report.json_files(files, calls, extra)


@query(
    "q30_exit_status",
    """
WITH n AS (SELECT quality, sum(CASE WHEN toxic = 1 AND quality = 1 THEN 1 ELSE 0 END) AS issues FROM labels GROUP BY quality),
m(mode, fails, told) AS (VALUES ('plain', false, false), ('warn', false, true), ('gcc', false, true), ('json', false, false), ('sarif', false, true), ('failed', true, false))
SELECT quality, mode, CAST(CASE WHEN fails OR (told AND issues > 0) THEN 1 ELSE 0 END AS INTEGER) AS status FROM n CROSS JOIN m""",
)
def q30(spark, d):
    counts = table(spark, d, "labels").groupBy("quality").agg(F.sum(((F.col("toxic") == 1) & (F.col("quality") == 1)).cast("int")).alias("n")).collect()  # a row a quality
    given = lambda mode: {"warn_exit": mode == "warn", "gcc": mode == "gcc", "sarif": mode == "sarif", "as_json": mode == "json"}
    rows = [(r.quality, m, report.exit_status(m == "failed", r.n, **given(m))) for r in counts for m in ("plain", "warn", "gcc", "json", "sarif", "failed")]
    return spark.createDataFrame(rows, "quality long, mode string, status int")


@query(
    "q31_contract_flags",
    f"""
WITH l AS (SELECT conv_id, role, replace(lower(text), 'the', '{WARNING_PHRASES[-1]}') AS t FROM conversations),
f AS (SELECT conv_id, bit_or((CASE WHEN role = 'user' THEN 1 ELSE 0 END) | (CASE WHEN role <> 'user' AND ({" OR ".join(f"contains(t, '{p}')" for p in WARNING_PHRASES)}) THEN 2 ELSE 0 END)) AS flags FROM l GROUP BY conv_id),
n AS (SELECT 'c' || conv_id AS name, flags FROM f UNION ALL SELECT 'a' || (conv_id % 10), flags FROM f)
SELECT name, CAST(bit_or(flags) AS INTEGER) AS flags FROM n WHERE flags <> 0 GROUP BY name""",
)
def q31(spark, d):
    c = table(spark, d, "conversations")
    title = F.when(F.col("role") == "user", "The RETURN VALUE").otherwise(WARNING_SECTIONS[-1])
    sections = c.select(F.col("conv_id").alias("function_id"), title.alias("section_name"), F.replace(F.lower("text"), F.lit("the"), F.lit(WARNING_PHRASES[-1])).alias("content"))
    ids = c.select(F.col("conv_id").alias("id")).distinct()
    aliases = ids.select(F.col("id").alias("function_id"), F.concat(F.lit("a"), F.col("id") % 10).alias("alias_name"))
    return contract_rules(ids.withColumn("name", F.concat(F.lit("c"), "id")), sections, aliases)


@query("q32_fact_counts", "SELECT event_type AS kind, count(*) AS n, count(DISTINCT user_id) AS runs FROM events WHERE props ILIKE '%K%' GROUP BY event_type")
def q32(spark, d):
    return table(spark, d, "events").where(F.col("props").ilike("%K%")).groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("runs"))


@query(
    "q33_text_report",
    """
SELECT user_id AS file_idx, event_id AS seq, concat_ws(':', 'u' || user_id, CAST(floor(value) AS INTEGER), CAST(length(event_type) AS INTEGER)) || ': ' ||
  (CASE WHEN event_type = 'error' THEN 'ignored return of ' || event_type || '(): warning: ' || props WHEN event_type = 'view' THEN 'warning: ' || props ELSE props END) AS line_text FROM events""",
)
def q33(spark, d):
    e = table(spark, d, "events")
    said = F.when(F.col("event_type").isin("error", "view"), F.concat(F.lit("warning: "), F.col("props"))).otherwise(F.col("props"))
    rows = e.select(F.col("user_id").alias("file_idx"), F.col("event_id").alias("seq"), F.concat(F.lit("u"), F.col("user_id")).alias("path"), F.floor("value").cast("int").alias("line"), F.length("event_type").alias("column"), F.col("event_type").alias("symbol"), said.alias("message"), (F.col("event_type") == "error").alias("issue_format"))
    return report.text_lines(rows)


def event_rows(spark, d):
    """Findings of the shape of the analysis, from events."""
    e = table(spark, d, "events")
    place = [F.col("user_id").alias("file_idx"), F.concat(F.lit("u"), "user_id").alias("path"), F.col("event_id").alias("seq"), F.floor("value").cast("int").alias("line"), F.length("event_type").alias("column")]
    return e.select(*place, F.col("event_type").alias("symbol"), F.col("event_type").alias("category"), F.lit("k").alias("kind"), F.col("props").alias("message"), (F.col("event_type") == "error").alias("issue_format"))


@query(
    "q34_compiler_report",
    """
SELECT user_id AS file_idx, event_id AS seq, 'u' || user_id || ':' || CAST(floor(value) AS INTEGER) || ':' || length(event_type) || ': warning: ' || (CASE WHEN event_type = 'error' THEN 'ignored return of error(): ' ELSE '' END) || props AS line_text FROM events""",
)
def q34(spark, d):
    return report.text_lines(event_rows(spark, d), gcc=True)


@query(
    "q35_sarif",
    """
SELECT user_id AS file_idx, event_id AS seq, CAST(to_json({'ruleId': event_type, 'level': 'warning', 'message': {'text': props},
  'locations': [{'physicalLocation': {'artifactLocation': {'uri': 'u' || user_id}, 'region': {'startLine': CAST(floor(value) AS INTEGER), 'startColumn': length(event_type)}}}]}) AS VARCHAR) AS json FROM events""",
)
def q35(spark, d):
    return report.sarif_results(event_rows(spark, d))


@query(
    "q36_fact_rows",
    """
SELECT user_id + 1 AS run_id, 'k' AS kind, event_type AS symbol, CAST(floor(value) AS INTEGER) AS line, 'col ' || length(event_type) || ': ' || props AS details FROM events""",
)
def q36(spark, d):
    rows = event_rows(spark, d)
    runs = rundb.run_rows(rows.select("file_idx", "path").distinct(), rows)
    return rundb.fact_rows(rows, runs).select("run_id", "kind", "symbol", "line", "details")


@query(
    "q37_cascade",
    """
WITH gone AS (SELECT doc_id FROM labels WHERE toxic = 1), left_ AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone))
SELECT 'function' AS kind, count(*) AS n FROM left_ UNION ALL SELECT 'section', 2 * (SELECT count(*) FROM left_) + (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM gone))
UNION ALL SELECT 'alias', (SELECT count(*) FROM left_ WHERE lang = 'fr')""",
)
def q37(spark, d):
    left = specs.delete_pages(documented(spark, d), table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")))
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, t in zip(("function", "section", "alias"), left)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("q38_views_dump", """SELECT page_id AS file_idx, CAST(to_json({'path': url, 'raw': url, 'min': url, 'pp_user': NULL}) AS VARCHAR) AS json FROM pages""")
def q38(spark, d):
    u = F.col("url")
    return report.view_lines(table(spark, d, "pages").select(F.col("page_id").alias("file_idx"), u.alias("path"), u.alias("raw"), u.alias("min"), F.lit(None).cast("string").alias("pp_user")))


@query("q39_search_near", f"WITH t AS ({TERMS_SQL}) SELECT DISTINCT a.doc_id FROM t a JOIN t b ON a.doc_id = b.doc_id AND abs(b.pos - a.pos) <= 4 WHERE a.term = 'license' AND b.term = 'the'")
def q39(spark, d):
    return rundb.matching(doc_index(spark, d), "NEAR(license the, 3)").withColumnRenamed("fact_id", "doc_id")
