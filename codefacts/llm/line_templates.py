"""Line deduplication by a log-template tree.

Every line is parsed to words; a word with a digit is a variable field, <*>. The tree has a fixed depth:
a line's leaf is its number of words and its `depth` leading words. Equal masked lines are one
template. Inside a leaf, the most frequent word of each place (weighted by distinct texts) makes a
general template: lines that agree with it in `alike` of their places belong to it, and the other
places are its variable fields. The lines of a leaf that are neither in it nor exact templates vote again,
and are split by the word of one place whenever a vote finds no template in `min_docs` texts, until no
part can reach so many.

A template recurs if `min_docs` texts hold it that are no copies of one another, so what only a group of
copies shares is left to document deduplication. Copies are texts whose lengths and whose sets of five-word
shingles are alike by `similarity`. Texts are taken in the order of their hashes: one that is no copy of
those taken before is taken, until enough are. Texts of 2 * min_docs - 1 size classes need no such proof.
Lines of recurring templates are dropped from all texts. A line of more than `long_words` words recurs
with two such texts already, and then stays in the first of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, columns, cut, fresh, held_bytes, small, wide_hash
from .url_filter import let

FIELD = "<*>"
#: Lines of which all votes of a round may lie in one task.
FEW_LINES = 100_000
#: Bytes of the table of repeated texts up to which it is broadcast.
MOST_SENT = 32 << 20


def parsed_lines(docs: DataFrame, depth: int) -> DataFrame:
    """(row, doc_id, body, chars, k, once, masked, leaf, sig, n): each line with a word; masked has its words, one blank apart (null where no vote asks for them), body and sig are hashes of the text and of the masked line.

    row numbers the rows of docs; once is true for one of a row's lines of equal masked words, which sorting a row's own lines tells.
    """
    text = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", wide_hash("text").alias("body"), F.length("text").alias("chars"), "text")
    own = ["row", "doc_id", "body", "chars"]
    fields = F.when(F.col("text").rlike("[0-9]"), F.regexp_replace("text", r"(?<![^ \t\r\n])[^ \t\r\n0-9]*+[0-9][^ \t\r\n]*+", FIELD)).otherwise(F.col("text"))
    spaced = F.when(F.col("m").rlike("[\t\r]|  "), F.regexp_replace("m", "[ \t\r]+", " ")).otherwise(F.col("m"))
    trimmed = F.transform(F.split("m", "\n"), lambda x, k: F.struct(F.trim(x).alias("masked"), k.alias("k")))
    keyed = F.transform(F.filter(trimmed, lambda e: e["masked"] != ""), lambda e: F.struct(wide_hash(e["masked"]).alias("sig"), e["k"].alias("k"), e["masked"].alias("masked")))
    flagged = let(F.sort_array(keyed), lambda s: F.transform(s, lambda e, i: F.struct(e["sig"].alias("sig"), e["k"].alias("k"), e["masked"].alias("masked"), ((i == 0) | (F.get(s, i - 1)["sig"] != e["sig"])).alias("once"))))
    line = text.select(*own, fields.alias("m")).select(*own, spaced.alias("m")).select(*own, F.explode(flagged).alias("e")).select(*own, "e.*")
    n = F.length("masked") - F.length(F.replace("masked", F.lit(" "))) + 1
    words = F.when(F.col("once") & (n > depth), F.col("masked"))
    return line.select(*own, "k", "once", words.alias("masked"), F.xxhash64(n, F.substring_index("masked", " ", depth)).alias("leaf"), "sig", n.alias("n"))


def of_distinct_texts(lines: DataFrame, keep) -> DataFrame:
    """(sig, body, doc_id, chars, leaf, n, masked): the masked lines of each distinct text once, so that rows with a sig are texts that hold it."""
    rows = lines.groupBy("body").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row")).where("first_row <> last_row")
    repeated = keep(rows.select("body", "first_row"))
    sent = held_bytes(repeated) <= MOST_SENT
    own = lines.where("once").join(F.broadcast(repeated) if sent else repeated, "body", "left").where("first_row is null or first_row = row")
    own = own.select("sig", "body", "doc_id", "chars", "leaf", "n", "masked")
    return own if sent else keep(own)


def general_templates(own: DataFrame, sigs: DataFrame, keep, *, depth: int, min_docs: int, alike: float) -> list[DataFrame]:
    """Of each vote (key, sig): the lines of general templates that min_docs distinct texts hold.

    Exact templates vote once, with all others; from then on they do not, so a line that still votes is held by fewer than
    min_docs texts and carries their hashes.
    """
    may = lambda lines, part: lines.groupBy(part).agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("sigs")).where((F.col("docs") >= min_docs) & (F.col("sigs") > 1)).select(part)
    leaves = keep(may(sigs.where(F.col("n") > depth), "leaf"))
    # one line of words for each masked line of the leaves that may hold a general template
    worded = own.where(F.col("n") > depth).join(leaves, "leaf", "left_semi").groupBy("sig").agg(F.min("leaf").alias("part"), F.count(F.lit(1)).alias("docs"), F.min("masked").alias("masked"))
    rest = keep(worded)
    if (n := rest.count()) == 0:
        return []
    seen = keep(voted(*dealt(rest, n)))
    like = seen.where(F.col("same") >= alike).select("part", "sig")
    texts = own.select("sig", "body")
    reach = keep(texts.join(small(like, 16), "sig").groupBy("part").agg(F.countDistinct("body").alias("texts")).where(F.col("texts") >= min_docs).select("part", F.lit(True).alias("reached")))
    key = lambda vote: wide_hash(F.concat_ws(":", F.col("part"), F.lit(vote)))
    found = [like.join(reach, "part", "left_semi").select(key(0).alias("key"), "sig")]
    left = seen.join(reach, "part", "left").where((F.col("reached").isNull() | (F.col("same") < alike)) & (F.col("docs") < min_docs)).select("part", "sig", "docs", "masked")
    rest = keep(left.join(may(left, "part"), "part", "left_semi"))
    rest = keep(rest.join(texts.join(small(rest.select("sig"), 16), "sig", "left_semi").groupBy("sig").agg(F.collect_list("body").alias("bodies")), "sig"))
    while (n := rest.count()) > 0:
        near, how = dealt(rest, n)
        seen = voted(near.join(hinted(may(near, "part"), how), "part", "left_semi"), how)
        holders = seen.where(F.col("same") >= alike).select("part", F.explode("bodies").alias("body")).distinct()
        reach = holders.groupBy("part").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= min_docs).select("part", F.lit(True).alias("reached"))
        seen = keep(seen.join(hinted(reach, how), "part", "left").withColumn("hit", F.col("reached").isNotNull() & (F.col("same") >= alike)))
        found.append(seen.where("hit").select(key(len(found)).alias("key"), "sig"))
        part = F.when(F.col("reached"), F.col("part")).otherwise(F.xxhash64("part", "word"))
        rest = seen.where("not hit").select(part.alias("part"), "sig", "docs", "masked", "bodies")
    return found


def dealt(rest: DataFrame, n: int) -> tuple[DataFrame, str]:
    """The n lines of rest, dealt by part once if they are few, which serves every step of a vote, and the joins' hint; many are not, as one part may have most of them.

    No number of partitions is given: with fewer than Spark's own, the joins would deal the lines anew.
    """
    return (rest.repartition("part"), "merge") if n <= FEW_LINES else (rest, "")


def hinted(df: DataFrame, how: str) -> DataFrame:
    return df.hint(how) if how else df


def voted(rest: DataFrame, how: str = "") -> DataFrame:
    """rest (part, sig, docs, masked and others) with same, the share of its places that hold their part's most frequent word, and word, that of the place on which the part is best split.

    That is the place whose most frequent word has the most texts, of the places that differ within the part.
    """
    counted = rest.select("part", "docs", F.posexplode(F.split("masked", " ")).alias("place", "word")).groupBy("part", "place", "word").agg(F.sum("docs").alias("docs"))
    usual = counted.groupBy("part", "place").agg(F.max(F.struct("docs", "word")).alias("top"), F.count(F.lit(1)).alias("kinds"))
    tops = usual.groupBy("part").agg(
        F.sort_array(F.collect_list(F.struct("place", "top.word"))).alias("tops"), F.max(F.when(F.col("kinds") > 1, F.struct("top.docs", -F.col("place")))).alias("split")
    )
    words = F.split("masked", " ")
    alike = F.zip_with(words, "tops", lambda w, t: (w == t["word"]).cast("int"))
    same = F.aggregate(alike, F.lit(0), lambda n, x: n + x) / F.size(words)
    return rest.join(hinted(tops, how), "part").select(*rest.columns, same.alias("same"), F.get(words, -F.col("split.col2")).alias("word"))


def shingles(text: F.Column) -> F.Column:
    """The distinct 32-bit hashes of a text's runs of five words, the words as they stand and hashed once each; one run of all words if there are fewer."""
    words = F.transform(F.array_remove(F.split(text, "[ \t\r\n]+"), ""), lambda x: F.xxhash64(x))
    run = lambda w: lambda x, i: F.hash(x, *[F.get(w, i + k) for k in range(1, 5)])
    return let(words, lambda w: F.array_distinct(F.transform(F.slice(w, 1, F.greatest(F.size(w) - 4, F.lit(1))), run(w))))


def spread(held: DataFrame, docs: DataFrame, keep, similarity: float) -> DataFrame:
    """(key, first): the keys of held(key, body, doc_id, chars, need) that `need` texts hold which are no copies of one another, and the first text of each."""
    size_class = F.least(F.lit(63), F.floor(F.log(F.greatest("chars", F.lit(1))) / F.log(F.lit(1 / similarity)))).cast("int")
    kinds = F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), size_class)))
    found = held.groupBy("key").agg(F.max("need").alias("need"), kinds.alias("kinds"), F.min("body").alias("first"))
    found = keep(found.withColumn("sure", F.col("kinds") >= 2 * F.col("need") - 1))
    out = [found.where("sure").select("key", "first")]
    left = keep(held.join(found.where("not sure").select("key", "first"), "key"))
    if left.isEmpty():
        return out[0]
    # each text's set once, by one of its documents; sets stay where they are, what is joined to them is sent if its size allows
    one = small(keep(left.groupBy("body").agg(F.min("doc_id").alias("_one"))).withColumnRenamed("body", "_body"), 64)
    own = docs.select("doc_id", wide_hash("text").alias("body"), "text")
    sets = keep(own.join(one, (own["body"] == one["_body"]) & own["doc_id"].eqNullSafe(one["_one"]), "left_semi").select("body", shingles(F.col("text")).alias("set")))
    # the same row may stand in the table several times
    if not sets.groupBy("body").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        sets = keep(sets.dropDuplicates(["body"]))
    for taken in range(1, left.agg(F.max("need")).first()[0]):
        next_ = keep(left.groupBy("key").agg(F.min(F.struct("body", "chars")).alias("x")).select("key", F.col("x.body").alias("taken"), F.col("x.chars").alias("taken_chars")))
        met = left.join(next_, "key").where("body <> taken")
        near = F.least("chars", "taken_chars") / F.greatest("chars", "taken_chars") >= similarity
        pairs = keep(met.where(near).select("body", "taken").distinct())
        sent = F.broadcast if held_bytes(pairs) <= 64 << 20 else lambda df: df  # what is taken is in pairs, so it is no larger
        leaders = sets.join(sent(pairs.select(F.col("taken").alias("body")).distinct()), "body", "left_semi").select(F.col("body").alias("taken"), F.col("set").alias("taken_set"))
        both = sets.join(sent(pairs), "body").join(keep(leaders), "taken")
        shared = F.size(F.array_intersect("set", "taken_set"))
        copies = both.where(shared / (F.size("set") + F.size("taken_set") - shared) >= similarity).select("body", "taken").distinct()
        left = keep(met.join(copies, ["body", "taken"], "left_anti").select(*left.columns))
        out.append(left.where(F.col("need") == taken + 1).select("key", "first").distinct())
        left = left.where(F.col("need") > taken + 1)
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)


def recurring(docs: DataFrame, lines: DataFrame, keep, *, depth: int, min_docs: int, alike: float, similarity: float, long_words: int) -> DataFrame:
    """(sig, stays): the masked lines whose template recurs, and the text in which the line stays all the same, else null."""
    own = of_distinct_texts(lines, keep)
    sigs = keep(own.groupBy("sig").agg(F.count(F.lit(1)).alias("docs"), F.min("leaf").alias("leaf"), F.min("n").alias("n")))
    need = F.when(F.col("docs") >= min_docs, min_docs).when((F.col("n") > long_words) & (F.col("docs") > 1), 2)
    cover = sigs.select(F.col("sig").alias("key"), "sig", need.alias("need")).where("need is not null")
    for got in general_templates(own, sigs, keep, depth=depth, min_docs=min_docs, alike=alike):
        cover = cover.unionByName(got.withColumn("need", F.lit(min_docs)))
    cover = keep(cover)
    held = own.select("sig", "body", "doc_id", "chars").join(small(cover, 16), "sig").groupBy("key", "body")
    held = keep(held.agg(F.min("doc_id").alias("doc_id"), F.max("chars").alias("chars"), F.max("need").alias("need")))
    found = cover.join(keep(spread(held, docs, keep, similarity)), "key").withColumn("stays", F.when(F.col("need") < min_docs, F.col("first")))
    return found.groupBy("sig").agg(F.when(~F.bool_or(F.col("stays").isNull()), F.min("stays")).alias("stays"))


def drop_recurring_lines(docs: DataFrame, *, depth: int = 3, min_docs: int = 5, alike: float = 0.75, similarity: float = 0.8, long_words: int = 50) -> DataFrame:
    """docs with the lines of recurring templates taken out of text, and n_lines_dropped added.

    docs: doc_id, text and any other columns, which are kept as they are (a column named n_lines_dropped is
    replaced). Lines end at a line feed; a line without a word is never a template and stays. Recurrence counts
    distinct texts that are no copies of one another; a text of nothing but recurring lines is left empty. Null and empty
    texts stay. Repeated rows are each cleaned alike; a null doc_id is a value like any other. Very long texts and
    lines are read whole. Words with equally many texts in a vote: the last in order wins. An empty table gives no rows.
    """
    docs = docs.drop("n_lines_dropped")
    narrow = columns(docs, "doc_id", "text").where("text is not null")
    work = Scratch(docs.sparkSession, "lines")
    lines = work.keep(parsed_lines(narrow, depth))
    bad = work.keep(recurring(narrow, lines, work.keep, depth=depth, min_docs=min_docs, alike=alike, similarity=similarity, long_words=long_words))
    hit = lines.select("doc_id", "body", "k", "sig").join(small(bad, 16), "sig").where("stays is null or stays <> body")
    key, body, drop = fresh(docs, "_id", "_body", "_drop")
    act = cut(hit.groupBy("doc_id", "body").agg(F.collect_set("k").alias("drop")).select(F.col("doc_id").alias(key), F.col("body").alias(body), F.col("drop").alias(drop)))
    work.remove()
    joined = docs.join(small(act, 32), docs["doc_id"].eqNullSafe(act[key]) & (wide_hash(docs["text"]) == act[body]), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, k: ~F.array_contains(drop, k)), "\n")
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(kept)
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.size(drop), F.lit(0)).alias("n_lines_dropped"))


def op10(spark, sf_dir: str) -> DataFrame:
    """All documents without recurring lines; see drop_recurring_lines."""
    return drop_recurring_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "text", "n_lines_dropped")


def _rounds(min_docs: int) -> str:
    """CTEs that take one text of each open key a round and leave those that are no copies of it."""
    out = ""
    for r in range(1, min_docs):
        out += f"""
, taken{r} AS MATERIALIZED (
  SELECT key, min(body) AS taken FROM left{r - 1} GROUP BY key
), left{r} AS MATERIALIZED (
  SELECT l.key, l.need, l.body FROM left{r - 1} l JOIN taken{r} t USING (key) JOIN sets a ON a.body = l.body JOIN sets b ON b.body = t.taken
  WHERE l.body <> t.taken AND l.need > {r} AND NOT (least(a.chars, b.chars) / greatest(a.chars, b.chars) >= 0.8
    AND len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) >= 0.8)
)"""
    return out


def oracle(documents: str = "documents", min_docs: int = 5) -> str:
    """CTEs that end in `cleaned`: documents with text replaced and n_lines_dropped (depth 3, 0.75 alike, 0.8 similar, 50 words); one vote a leaf."""
    return rf"""
line AS (
  SELECT doc_id, text, CAST(k - 1 AS INTEGER) AS k, ln FROM (
    SELECT doc_id, text, unnest(string_split(text, chr(10))) AS ln, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM {documents} WHERE text IS NOT NULL)
), masked AS (
  SELECT doc_id, text, k, trim(regexp_replace(ln, '[^ \t\r]*[0-9][^ \t\r]*', '<*>', 'g'), ' ' || chr(9) || chr(13)) AS m FROM line
), worded AS (
  SELECT doc_id, text, k, string_split_regex(m, '[ \t\r]+') AS w FROM masked WHERE m <> ''
), leafed AS (
  SELECT *, len(w) AS n, [CAST(len(w) AS VARCHAR)] || w[1:3] AS leaf FROM worded
), in_text AS (
  SELECT DISTINCT leaf, w, n, text FROM leafed
), sigs AS (
  SELECT leaf, w, n, count(*) AS docs FROM in_text GROUP BY ALL
), leaves AS (
  SELECT leaf FROM sigs WHERE n > 3 GROUP BY leaf HAVING sum(docs) >= {min_docs} AND count(*) > 1
), placed AS (
  SELECT leaf, w, docs, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM sigs WHERE leaf IN (SELECT leaf FROM leaves)
), usual AS (
  SELECT leaf, place, word AS usual FROM (SELECT leaf, place, word, sum(docs) AS docs FROM placed GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY leaf, place ORDER BY docs DESC, word DESC) = 1
), alike AS (
  SELECT leaf, w FROM placed JOIN usual USING (leaf, place) GROUP BY leaf, w HAVING avg(CASE WHEN word = usual THEN 1.0 ELSE 0.0 END) >= 0.75
), reach AS (
  SELECT leaf FROM in_text JOIN alike USING (leaf, w) GROUP BY leaf HAVING count(DISTINCT text) >= {min_docs}
), cover AS (
  SELECT 'e' || array_to_string(w, ' ') AS key, leaf, w, CASE WHEN docs >= {min_docs} THEN {min_docs} ELSE 2 END AS need FROM sigs WHERE docs >= {min_docs} OR (n > 50 AND docs > 1)
  UNION ALL SELECT 'g' || array_to_string(leaf, ' '), leaf, w, {min_docs} FROM alike WHERE leaf IN (SELECT leaf FROM reach)
), held AS MATERIALIZED (
  SELECT DISTINCT key, need, md5(text) AS body, text, length(text) AS chars FROM in_text JOIN cover USING (leaf, w)
), kinds AS MATERIALIZED (
  SELECT key, min(body) AS first, count(DISTINCT least(63, floor(ln(greatest(chars, 1)) / ln(1 / CAST(0.8 AS DOUBLE))))) >= 2 * any_value(need) - 1 AS sure FROM held GROUP BY key
), sets AS MATERIALIZED (
  SELECT body, any_value(chars) AS chars, list_distinct(list_transform(range(1, greatest(len(any_value(ws)) - 4, 1) + 1), lambda i: array_to_string(any_value(ws)[i:i + 4], chr(10)))) AS s
  FROM (SELECT body, chars, list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda x: x <> '') AS ws FROM held JOIN kinds USING (key) WHERE NOT sure) GROUP BY body
), left0 AS MATERIALIZED (
  SELECT key, need, body FROM held JOIN kinds USING (key) WHERE NOT sure
){_rounds(min_docs)}, recurs AS (
  SELECT key FROM kinds WHERE sure {" ".join(f"UNION SELECT key FROM left{r} WHERE need = {r + 1}" for r in range(1, min_docs))}
), bad AS (
  SELECT leaf, w, CASE WHEN min(need) = {min_docs} OR max(need) = {min_docs} THEN NULL ELSE min(first) END AS stays FROM cover JOIN recurs USING (key) JOIN kinds USING (key) GROUP BY leaf, w
), act AS (
  SELECT doc_id AS id, text AS body, list(DISTINCT k) AS gone FROM leafed l JOIN bad b ON l.leaf = b.leaf AND l.w = b.w WHERE stays IS NULL OR stays <> md5(text) GROUP BY doc_id, text
), cleaned AS (
  SELECT d.* EXCLUDE (text), CASE WHEN a.gone IS NULL THEN d.text ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(a.gone, CAST(i - 1 AS INTEGER))), chr(10)) END AS text,
    CAST(coalesce(len(a.gone), 0) AS INTEGER) AS n_lines_dropped
  FROM {documents} d LEFT JOIN act a ON d.doc_id IS NOT DISTINCT FROM a.id AND d.text = a.body
)"""


OP10_SQL = f"WITH {oracle()} SELECT doc_id, text, n_lines_dropped FROM cleaned"
