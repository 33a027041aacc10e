"""Runs, facts, and search in facts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.functions.text import cut_bytes, terms

MOST_FOUND = 32


def run_rows(files: DataFrame, findings: DataFrame, first_id: int = 1) -> DataFrame:
    """One run a file, with the number of its findings; files without any have 0."""
    counts = findings.groupBy("file_idx").agg(F.count(F.lit(1)).cast("int").alias("error_count"))
    return files.select("file_idx", "path").join(counts, "file_idx", "left").select((F.col("file_idx") + first_id).cast("long").alias("id"), F.col("path").alias("filename"), F.current_timestamp().alias("ts"), F.coalesce("error_count", F.lit(0)).alias("error_count"), "file_idx")


def fact_rows(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """One fact a finding; ids follow run and order without a common counter."""
    details = cut_bytes(F.concat(F.lit("col "), F.col("column").cast("string"), F.lit(": "), F.col("message")), 255)
    return findings.join(runs.select("file_idx", F.col("id").alias("run_id")), "file_idx").select(F.xxhash64("run_id", "seq").alias("id"), "run_id", "kind", "symbol", "line", details.alias("details"))


def warning_rows(rows: DataFrame) -> DataFrame:
    """Facts of the generic kind."""
    return rows.select("id", "run_id", F.lit("warning").alias("kind"), "symbol", "line", "details")


def fact_terms(facts: DataFrame, columns: tuple[str, ...] = ("symbol", "details"), key: str = "id") -> DataFrame:
    """(fact_id, column, pos, term): the search index, derived from the facts; store it bucketed by term for repeated searches."""
    per = F.array(*[F.struct(F.lit(c).alias("column"), terms(F.col(c)).alias("terms")) for c in columns])
    listed = facts.select(F.col(key).alias("fact_id"), F.explode(per).alias("x"))
    return listed.select("fact_id", "x.column", F.posexplode("x.terms").alias("pos", "term"))


def phrase_places(index: DataFrame, words: list[str], *, prefix: bool = False, start: bool = False) -> DataFrame:
    """(fact_id, column, at): where the terms stand next to one another in one column, in order; with prefix, the last one begins a term; with start, only at a column's start."""
    last = len(words) - 1
    fits = lambda k, w: F.col("term").startswith(w) if prefix and k == last else F.col("term") == w
    parts = [index.where(fits(k, w)).select("fact_id", "column", (F.col("pos") - k).alias("at")) for k, w in enumerate(words)]
    out = reduce(lambda a, b: a.join(b, ["fact_id", "column", "at"], "left_semi"), parts)
    return (out.where("at = 0") if start else out).distinct()


def near_one_another(phrases: list[tuple[DataFrame, int]], most: int) -> DataFrame:
    """Ids with all the phrases (places, number of words) in one column, so that from no phrase's end to the last one's start there are more than `most` terms."""
    tagged = [places.select("fact_id", "column", F.struct(F.lit(k).alias("k"), "at").alias("x")) for k, (places, _) in enumerate(phrases)]
    held = reduce(DataFrame.unionByName, tagged).groupBy("fact_id", "column").agg(F.collect_list("x").alias("all"))
    reached = lambda k, n, top: F.exists("all", lambda y: (y["k"] == k) & (y["at"] <= top) & (y["at"] >= top - n - most))
    every = lambda x: reduce(lambda a, b: a & b, [reached(k, n, x["at"]) for k, (_, n) in enumerate(phrases)])
    return held.where(F.exists("all", every)).select("fact_id").distinct()


TOKEN = re.compile(r'\s*(?:(?P<phrase>"(?:[^"]|"")*")|(?P<sign>[(){}:^+*,-])|(?P<word>[\w\x1a\x80-\U0010ffff]+))')


class _Query:
    """term, "a phrase", a + b, prefix*, ^start, NEAR(a b, n), column:..., {columns}:..., -column:..., AND (or nothing between), OR, NOT, parentheses.

    From tight to loose: nothing between, NOT, AND, OR.
    """

    def __init__(self, text: str, index: DataFrame, split):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"cannot read the query at: {text[at:]}")
            self.tokens.append(m)
            at = m.end()
        self.index, self.split, self.k = index, split, 0

    def sees(self, sign: str, ahead: int = 0) -> bool:
        k = self.k + ahead
        return k < len(self.tokens) and sign in (self.tokens[k]["sign"], self.tokens[k]["word"])

    def take(self, sign: str) -> bool:
        there = self.sees(sign)
        self.k += there
        return there

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise ValueError(f"missing {sign}")

    def any_of(self) -> DataFrame:
        out = self.all_of()
        while self.take("OR"):
            out = out.unionByName(self.all_of()).distinct()
        return out

    def all_of(self) -> DataFrame:
        out = self.without()
        while self.take("AND"):
            out = out.join(self.without(), "fact_id", "left_semi")
        return out

    def without(self) -> DataFrame:
        out = self.side_by_side()
        while self.take("NOT"):
            out = out.join(self.side_by_side(), "fact_id", "left_anti")
        return out

    def side_by_side(self) -> DataFrame:
        out = self.one()
        while self.k < len(self.tokens) and not any(self.sees(x) for x in ("AND", "OR", "NOT", ")")):
            found = self.one()
            out = found if out is None else out if found is None else out.join(found, "fact_id", "left_semi")
        return self.index.select("fact_id").limit(0) if out is None else out

    def columns(self) -> list[str] | None:
        """The names before a colon, if a column filter stands here."""
        k = self.k + self.sees("-")
        names, named = [], lambda m: m["word"] or (m["phrase"] or "")[1:-1]
        if k < len(self.tokens) and self.tokens[k]["sign"] == "{":
            k += 1
            while k < len(self.tokens) and named(self.tokens[k]):
                names.append(named(self.tokens[k]).lower())
                k += 1
            if k >= len(self.tokens) or self.tokens[k]["sign"] != "}":
                raise ValueError("missing }")
        elif k < len(self.tokens):
            names = [named(self.tokens[k]).lower()]
        if not names or k + 1 >= len(self.tokens) or self.tokens[k + 1]["sign"] != ":":
            return None
        self.k = k + 2
        return names

    def one(self) -> DataFrame | None:
        if self.k >= len(self.tokens):
            raise ValueError("the query ends where a term is expected")
        index, other = self.index, self.sees("-")
        if (names := self.columns()) is not None:
            held = F.lower("column").isin(*names)
            self.index = index.where(~held if other else held)
            out = self.one()
            self.index = index
            return out
        if self.take("("):
            out = self.any_of()
            self.need(")")
            return out
        if self.sees("NEAR") and self.sees("(", 1):
            self.k += 2
            phrases, most = [], 10
            while not self.sees(")") and not self.sees(","):
                phrases.append(self.phrase())
            if self.take(","):
                if self.k >= len(self.tokens) or not (self.tokens[self.k]["word"] or "").isdigit():
                    raise ValueError("NEAR needs a number")
                most, self.k = int(self.tokens[self.k]["word"]), self.k + 1
            self.need(")")
            phrases = [x for x in phrases if x]
            return near_one_another(phrases, most) if phrases else None
        found = self.phrase()
        return found and found[0].select("fact_id").distinct()

    def phrase(self) -> tuple[DataFrame, int] | None:
        """(places, number of words) of a phrase; null if it has no word."""
        start, words, prefix = self.take("^"), [], False
        while True:
            m = self.tokens[self.k] if self.k < len(self.tokens) else None
            if m is None or m["sign"]:
                raise ValueError("a term is expected" + (f" before {m['sign']}" if m else " at the end"))
            self.k += 1
            words += self.split(m["phrase"][1:-1].replace('""', '"') if m["phrase"] else m["word"])
            prefix = self.take("*")
            if prefix or not self.take("+"):
                break
        return (phrase_places(self.index, words, prefix=prefix, start=start), len(words)) if words else None


def matching(index: DataFrame, query: str) -> DataFrame:
    """Ids of the facts that a full-text query fits."""
    spark = index.sparkSession
    asked = sorted({t for m in TOKEN.finditer(query) for t in (m["phrase"], m["word"]) if t})
    plain = lambda t: t[1:-1].replace('""', '"') if t.startswith('"') else t
    known = {r.t: r.words for r in spark.createDataFrame([(plain(t),) for t in asked], "t string").select("t", terms(F.col("t")).alias("words")).collect()} if asked else {}
    q = _Query(query, index, lambda t: known.get(t, []))
    out = q.any_of() if q.tokens else index.select("fact_id").limit(0)
    if q.k < len(q.tokens):
        raise ValueError("unexpected )")
    return out


def latest_runs(runs: DataFrame, pattern: str | None = None) -> DataFrame:
    """The last run of each file name that is LIKE the pattern (of each, without one): the one of the largest id."""
    asked = runs if pattern is None else runs.where(F.col("filename").like(pattern))
    return asked.groupBy("filename").agg(F.max_by(F.struct(*[c for c in runs.columns if c != "filename"]), "id").alias("x")).select("filename", "x.*")


def find_similar(facts: DataFrame, runs: DataFrame, query: str, index: DataFrame | None = None, most: int = MOST_FOUND) -> DataFrame:
    """The facts that fit, those of the latest runs first: filename, kind, symbol, details; equal times by run and fact."""
    hits = matching(fact_terms(facts) if index is None else index, query)
    rows = facts.join(hits.withColumnRenamed("fact_id", "id"), "id", "left_semi").join(runs.select(F.col("id").alias("run_id"), "filename", "ts"), "run_id")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return rows.orderBy(F.col("ts").desc(), F.col("run_id").desc(), "id").limit(most).select("filename", "kind", empty("symbol"), empty("details"))
