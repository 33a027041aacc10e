"""URL filtering with rules by host and path, and decisions that reach a page's aliases.

Pages that redirect or point to one another are one resource: connected components over canonical
links, refresh redirects, given redirects and urls of one plain form and equal html join them. A url that no rule
fits takes over its component's decision; an allowed member clears the component, otherwise a
blocked member blocks it. A url's own rule always stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, wide_hash
from .components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rule, decision.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Most rules that are sent to every executor; more are joined by host.
MOST_BROADCAST = 10_000
#: Query parameters that do not change which page is meant.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """(rule, rule_host, rule_path, decision) from pairs of a rule such as 'example.net/en/' and allow or block."""
    return spark.createDataFrame([(r, r.partition("/")[0], "/" + r.partition("/")[2], d) for r, d in rules], "rule string, rule_host string, rule_path string, decision string")


def decide_by_rule(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, decision): for each distinct place the longest rule that fits it.

    A place's host is looked up with each of its suffixes, so work follows its labels, not the number
    of rules; ties in length go to the first rule in order.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    by_host = rules.select(F.col("rule_host").alias("suffix"), "rule", "rule_path", "decision")
    if rules.count() <= MOST_BROADCAST:
        by_host = F.broadcast(by_host)
    fits = places.where("host <> ''").select("host", "path", F.explode(suffixes).alias("suffix")).join(by_host, "suffix").where(F.col("path").startswith(F.col("rule_path")))
    best = F.min(F.struct((-F.length("rule")).alias("n"), "rule", "decision")).alias("best")
    return fits.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.decision")


def node_of(url: Column) -> Column:
    """A url without scheme, default port and fragment: one name for one resource."""
    host = F.regexp_replace(host_of(url), r":(80|443)?$", "")
    query = F.regexp_extract(url, r"(?s)^[^#]*?(\?[^#]*)", 1)
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    return F.when(host != "", F.concat(host, path, F.coalesce(query, F.lit(""))))


def plain_form(node: Column) -> Column:
    """A node without the host prefixes www. and m. and without tracking parameters."""
    bare = F.regexp_replace(node, r"^(?:www|m)\.([^/]*\.)", "$1")
    cleared = F.regexp_replace(bare, rf"([?&])(?:{TRACKING})=[^&]*", "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(cleared, "&{2,}", "&"), r"\?&", "?"), "[?&]$", "")


def let(value: Column, then) -> Column:
    """then(value), with value stated once however often then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def without_dots(path: Column) -> Column:
    """A path from / on without the segments . and .. (RFC 3986, 5.2.4)."""
    parts = F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/")))
    step = lambda kept, x: F.when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(x == ".", kept).otherwise(F.concat(kept, F.array(x)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step, lambda kept: F.array_join(F.concat(kept, F.when(path.rlike(r"(?s)/\.\.?$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), "/"))
    return F.concat(F.lit("/"), kept)


def linked(url: Column, target: Column) -> Column:
    """A link's target as a url, relative references resolved against url; null for other schemes, for #..., and for a relative one where url has no ://."""
    start, path = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), path_of(url)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, "(?s)^(.*/)", 1))
    to, tail = F.regexp_extract(target, "(?s)^([^?#]*)", 1), F.regexp_extract(target, "(?s)^[^?#]*(.*)$", 1)
    merged = F.when(to == "", path).otherwise(let(F.when(target.startswith("/"), to).otherwise(F.concat(folder, to)), without_dots))
    relative = F.when((start != "") & ~target.startswith("#") & ~target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(start, merged, tail))
    return F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(F.lit("http:"), target)).otherwise(relative)


def decoded(value: Column) -> Column:
    """An attribute's value with numeric character references and &amp; &lt; &gt; &quot; &apos; replaced, each once."""

    def meaning(x: Column) -> Column:
        code = F.when(x.rlike("^&#[xX]"), F.conv(F.regexp_extract(x, "^&#[xX]([^;]+)", 1), 16, 10)).otherwise(F.regexp_extract(x, "^&#([0-9]+)", 1))
        number = code.try_cast("int")
        valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        named = F.when(x == "&amp;", "&").when(x == "&lt;", "<").when(x == "&gt;", ">").when(x == "&quot;", '"').when(x == "&apos;", "'")
        return F.coalesce(named, F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")), x)

    known = "&(?:amp|lt|gt|quot|apos|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});"
    found = F.transform(F.regexp_extract_all(value, F.lit(known), 0), meaning)
    return F.when(value.contains("&"), F.array_join(F.zip_with(F.split(value, known, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")).otherwise(value)


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) nodes: all canonical links and refresh redirects in the pages' html; relative ones start from the page's base, if it has one."""
    url, html = F.col("url"), F.col("html")

    def values(tag: str, marked: str, name: str) -> Column:
        tags = F.filter(F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>"), 0), lambda t: t.rlike(marked))
        return F.transform(tags, lambda t: F.regexp_extract(t, rf"""(?is)\b{name}\s*=\s*["']?\s*([^"'\s>]+)""", 1))

    canonical = values("link", r"""(?is)\brel\s*=\s*(?:["']?|"(?:[^">]*\s)?|'(?:[^'>]*\s)?)canonical\b""", "href")
    refresh = values("meta", r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b""", "url")
    base = F.regexp_extract(html, r"""(?is)<base\b[^>]*\bhref\s*=\s*["']?\s*([^"'\s>]+)""", 1)
    targets = pages.select("url", base.alias("base"), F.explode(F.concat(canonical, refresh)).alias("target")).where("target <> ''").distinct()
    start = let(decoded(F.col("base")), lambda b: F.when(b == "", url).otherwise(F.coalesce(linked(url, b), url)))
    target = F.regexp_replace(decoded(F.col("target")), r"""^["'\s]+|["'\s]+$""", "")
    dst = let(start, lambda s: let(target, lambda t: F.when(t != "", let(linked(s, t), node_of))))
    return targets.select(node_of(url).alias("src"), dst.alias("dst"))


def same_pages(pages: DataFrame) -> DataFrame:
    """(src, dst) nodes that differ only in what plain_form takes away and whose pages have equal, not empty html: each with the least one."""
    seen = pages.where("html <> ''").select(node_of(F.col("url")).alias("src"), wide_hash("html").alias("page")).where("src is not null")
    seen = seen.select("src", plain_form(F.col("src")).alias("plain"), "page")
    least = seen.groupBy("plain", "page").agg(F.min("src").alias("dst"), F.max("src").alias("last")).where("dst < last").select("plain", "page", "dst")
    return seen.join(least, ["plain", "page"]).where("src <> dst").select("src", "dst")


def filter_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, *, default: str = "allow") -> DataFrame:
    """Each page's verdict: page_id, host, path, rule, verdict, alias_of.

    pages: page_id, url, html. rules: rule, rule_host, rule_path, decision. redirects: src, dst urls.
    rule is the longest rule that fits the url itself, else null; verdict its decision, else that of the
    component, else `default`; alias_of is the least node of the url's component (null without host).
    A null url, or one without ://, has empty host and path and gets `default`. Null html has no links.
    Repeated rows and ids each give their row; rules of equal length: the first in order; very long urls and html are read
    whole; an empty table gives none; other columns are not read.
    """
    pages = columns(pages, "page_id", "url", "html")
    url = F.col("url")
    urls = pages.select("url").where("url is not null").distinct().select("url", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")))
    joined = components(edges.unionByName(same_pages(pages)))

    place = lambda n: (F.regexp_extract(n, r"(?s)^([^/?#]*)", 1).alias("host"), F.regexp_extract(n, r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"))
    at_nodes = joined.select("node", "component", *place(F.col("node")))
    places = urls.select("host", "path").unionByName(at_nodes.select("host", "path")).distinct()
    decided = decide_by_rule(places, rules)
    spread = (
        at_nodes.join(decided, ["host", "path"]).groupBy("component")
        .agg(F.max((F.col("decision") == "allow").cast("int")).alias("allowed"))
        .select("component", F.when(F.col("allowed") == 1, "allow").otherwise("block").alias("passed_on"))
    )
    own = urls.join(decided, ["host", "path"], "left").join(joined, "node", "left").join(spread, "component", "left")
    verdict = own.select("url", "rule", F.coalesce("decision", "passed_on").alias("found"), F.coalesce("component", "node").alias("alias_of"))
    out = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path")).join(verdict, "url", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("found", F.lit(default)).alias("verdict"), "alias_of")


def op2(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's url; see filter_urls."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark, RULES))


def _sql_node(url: str) -> str:
    host = rf"regexp_replace(translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), ':(80|443)?$', '')"
    path = rf"regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    query = rf"regexp_extract({url}, '(?s)^[^#]*?(\?[^#]*)', 1)"
    return f"CASE WHEN {host} <> '' THEN {host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || {query} END"


def _sql_plain(node: str) -> str:
    out = rf"regexp_replace(regexp_replace({node}, '^(?:www|m)\.([^/]*\.)', '\1'), '([?&])(?:{TRACKING})=[^&]*', '\1', 'g')"
    return rf"regexp_replace(regexp_replace(regexp_replace({out}, '&{{2,}}', '&', 'g'), '\?&', '?', 'g'), '[?&]$', '')"


def _sql_linked(target: str) -> str:
    start = "regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1)"
    return f"CASE WHEN regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {target} WHEN starts_with({target}, '//') THEN 'http:' || {target} WHEN starts_with({target}, '/') AND {start} <> '' THEN {start} || {target} END"


_Q = r"""["'']?"""
_END = r"""[^"''\s>]"""
OP2_SQL = rf"""
WITH RECURSIVE rules(rule, rule_host, rule_path, decision) AS (
  SELECT rule, split_part(rule, '/', 1), substr(rule, length(split_part(rule, '/', 1)) + 1), decision
  FROM (VALUES {", ".join(f"('{r}', '{d}')" for r, d in RULES)}) v(rule, decision)
), urls AS (
  SELECT DISTINCT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, {_sql_node("url")} AS node FROM pages WHERE url IS NOT NULL
), targets AS (
  SELECT url, unnest([
    regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*{_Q}canonical\b[^>]*>', 0), '(?is)\bhref\s*=\s*{_Q}\s*({_END}+)', 1),
    regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*{_Q}refresh\b[^>]*>', 0), '(?is)\burl\s*=\s*{_Q}\s*({_END}+)', 1)]) AS target FROM pages
), linked AS (
  SELECT url, {_sql_linked("target")} AS target FROM targets WHERE target <> ''
), given AS (
  SELECT {_sql_node("url")} AS src, {_sql_node("target")} AS dst FROM linked
), same AS (
  SELECT node, min(node) OVER (PARTITION BY {_sql_plain("node")}, html) AS least FROM pages JOIN urls USING (url) WHERE html <> '' AND node IS NOT NULL
), edges AS (
  SELECT src, dst FROM (SELECT src, dst FROM given UNION SELECT node, least FROM same) WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst
), both_ways AS (
  SELECT src, dst FROM edges UNION SELECT dst, src FROM edges
), reach(node, seen) AS (
  SELECT src, src FROM both_ways UNION SELECT r.node, e.dst FROM reach r JOIN both_ways e ON r.seen = e.src
), joined AS (
  SELECT node, min(seen) AS component, regexp_extract(node, '(?s)^([^/?#]*)', 1) AS host, regexp_extract(node, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM reach GROUP BY node
), decided AS (
  SELECT host, path, rule, decision FROM (SELECT host, path FROM urls UNION SELECT host, path FROM joined) p
  JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, rule) = 1
), spread AS (
  SELECT component, CASE WHEN bool_or(decision = 'allow') THEN 'allow' ELSE 'block' END AS passed_on FROM joined JOIN decided USING (host, path) GROUP BY component
), verdicts AS (
  SELECT u.url, d.rule, coalesce(d.decision, s.passed_on) AS found, coalesce(j.component, u.node) AS alias_of
  FROM urls u LEFT JOIN decided d ON u.host = d.host AND u.path = d.path LEFT JOIN joined j ON u.node = j.node LEFT JOIN spread s ON j.component = s.component
)
SELECT page_id, coalesce(translate(regexp_extract(p.url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
  coalesce(regexp_extract(p.url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, rule, coalesce(found, 'allow') AS verdict, alias_of
FROM pages p LEFT JOIN verdicts v ON p.url = v.url
"""
