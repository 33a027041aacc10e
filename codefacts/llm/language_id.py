"""Language identification by bit-sliced Bloom filters of character n-grams.

All labelled texts are counted: how often each n-gram occurs in each language. A language's filter
takes the n-grams whose rate in it is at least `share` of their highest rate in any language, so that
stray foreign words, which any large corpus has, do not fill it, and at least LEAST_RATE, so that no
filter holds more than 1 / LEAST_RATE n-grams however many a language has. The filters of all
languages are sliced by bit: row r holds, as a mask, the languages whose filter has bit r. The number of rows
follows the fullest filter, of which at most three tenths are set. An n-gram's languages are the AND of
four rows, which its 64-bit hash gives. A text's hits for each language are counted, corrected by that
filter's rate of false positives, and the largest corrected count decides.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, columns, fresh, in_parts, release, ship

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Rows of an n-gram: low half of its hash + k * (high half | 1) + STEPS[k], modulo the number of rows.
STEPS = (0, 0, 1, 4)
LEAST_RATE = 2e-6
NOT_LETTERS = re.compile(r"[\W\d_]+")
SIZE = 4
#: Characters of texts that are judged at once (a longer text alone), and n-grams that a task counts at once.
AT_ONCE, COUNTED = 1 << 16, 1 << 18


def features(text: str | None) -> np.ndarray:
    """64-bit hashes of the n-grams of the lower-case letters, every other run taken as one blank, in order."""
    letters = NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    if not any(map(str.isalpha, letters)):  # number forms are no letters
        return np.empty(0, np.uint64)
    code = np.frombuffer(f"  {letters}  ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(code) - SIZE + 1
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SIZE):
            h = (h ^ code[k : k + n]) * MIX
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def places(feature: np.ndarray, rows: int) -> list[np.ndarray]:
    """Of each n-gram its place in each of the four rows; rows is a power of two."""
    a, b = feature & np.uint64(0xFFFFFFFF), (feature >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(k) * b + np.uint64(c)) & np.uint64(rows - 1)).astype(np.int64) for k, c in enumerate(STEPS)]


def rows_for(ngrams: int) -> int:
    """The least power of two of rows of which so many n-grams set at most three tenths."""
    return 1 << max(10, int(np.ceil(np.log2(max(ngrams, 1) * len(STEPS) / -np.log(0.7)))))


class Filters:
    """slices: for each 64 languages a mask for each row; wrong: each language's rate of false positives."""

    def __init__(self, languages: list[str], common: int, slices: list[np.ndarray]):
        self.languages, self.common, self.slices = languages, common, slices
        fill = [np.mean((slices[j // 64] >> np.uint64(j % 64)) & np.uint64(1)) for j in range(len(languages))]
        # an n-gram that was not inserted hits when all its rows are set
        self.wrong = np.array(fill) ** len(STEPS)

    def hits(self, feature: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of each text (its features begin at starts) the hits for each language."""
        out = np.zeros((len(starts), len(self.languages)))
        at = places(feature, len(self.slices[0])) if self.slices else []
        for w, rows in enumerate(self.slices):
            mask = rows[at[0]]
            for a in at[1:]:
                mask = mask & rows[a]
            for k in range(min(64, len(self.languages) - 64 * w)):
                run = np.concatenate([[0], np.cumsum(((mask >> np.uint64(k)) & np.uint64(1)).astype(np.int64))])
                out[:, 64 * w + k] = run[np.append(starts[1:], len(feature))] - run[starts]
        return out

    def decide(self, texts: list[str | None]):
        """(language, share of the corrected hits, corrected hits an n-gram) of each text."""
        grams = [features(t) for t in texts]
        sizes = np.array([len(g) for g in grams])
        if not self.languages or not sizes.sum():
            return [(None if not len(g) else (self.languages[self.common] if self.languages else None), 0.0, 0.0) for g in grams]
        rate = self.hits(np.concatenate(grams), np.cumsum(sizes) - sizes) / np.maximum(sizes, 1)[:, None]
        true = np.maximum(0, (rate - self.wrong) / np.maximum(1 - self.wrong, 1e-9))
        best, total = true.argmax(1), true.sum(1)
        out = []
        for n, b, row, t in zip(sizes, best, true, total):
            if not n:
                out.append((None, 0.0, 0.0))
            elif t <= 0:
                out.append((self.languages[self.common], 0.0, 0.0))
            else:
                out.append((self.languages[b], float(min(1.0, row[b] / t)), float(min(1.0, row[b]))))
        return out


def counted(rows: Iterator[tuple[str, str]], at_once: int = COUNTED, most: int = 1 << 20) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, n-grams, how often each) of (text, lang); a language may come again.

    At most at_once n-grams (and one text's) wait, over all languages together, and at most `most` counts (and what waits) are held.
    """
    waiting: dict[str, list] = {}
    counts: dict[str, tuple] = {}
    held = 0

    def add():
        for lang, parts in waiting.items():
            f, n = np.unique(np.concatenate(parts), return_counts=True)
            old, m = counts.get(lang, (f[:0], n[:0]))
            both, at = np.unique(np.concatenate([old, f]), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            np.add.at(total, at, np.concatenate([m, n]))
            counts[lang] = both, total
        waiting.clear()

    for text, lang in rows:
        if len(f := features(text)):
            waiting.setdefault(lang, []).append(f)
            held += len(f)
        if held > at_once:
            held = 0
            add()
            if sum(len(f) for f, _ in counts.values()) > most:
                yield from ((lang, *x) for lang, x in counts.items())
                counts.clear()
    add()
    yield from ((lang, *x) for lang, x in counts.items())


def held_out(doc_id) -> F.Column:
    """The fifth of the documents from which nothing is learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(labelled: DataFrame, *, share: float = 0.25) -> Filters:
    """The filters of all languages from text and lang of every row that has both.

    Counting is spread over the tasks and summed by (language, n-gram); only the finished slices, at most
    rows_for(1 / LEAST_RATE) masks for each 64 languages, come to the driver.
    """
    ship(labelled.sparkSession)

    def count(batches):
        for lang, f, n in counted((r for b in in_parts(batches) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f), pa.string()), pa.array(f.view(np.int64)), pa.array(n)], names=["lang", "feature", "n"])

    counts = columns(labelled, "text", "lang").where("text is not null and lang is not null").mapInArrow(count, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    work = Scratch(labelled.sparkSession, "ngrams")
    try:
        counts = work.keep(counts)
        totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        languages = sorted(totals)
        slices = []
        if languages:
            number = F.create_map(*[F.lit(x) for j, lang in enumerate(languages) for x in (lang, j)])
            total = F.create_map(*[F.lit(x) for lang in languages for x in (lang, float(totals[lang]))])
            rated = counts.select("feature", number[F.col("lang")].alias("j"), (F.col("n") / total[F.col("lang")]).alias("rate"))
            kept = rated.groupBy("feature").agg(F.max("rate").alias("top"), F.collect_list(F.struct("j", "rate")).alias("langs")).select(
                "feature", F.explode(F.filter("langs", lambda x: (x["rate"] >= F.col("top") * share) & (x["rate"] >= LEAST_RATE))).alias("x")
            )
            kept = work.keep(kept.select("feature", "x.j"))
            rows = rows_for(kept.groupBy("j").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0)
            low, high = F.col("feature").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("feature", 32).bitwiseOR(F.lit(1))
            row = F.explode(F.array(*[(low + k * high + c).bitwiseAND(rows - 1) for k, c in enumerate(STEPS)]))
            bits = kept.select(row.alias("row"), F.floor(F.col("j") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, j % 64)").alias("bit"))
            slices = [np.zeros(rows, np.uint64) for _ in range(-(-len(languages) // 64))]
            for r in bits.groupBy("w", "row").agg(F.bit_or("bit").alias("mask")).toArrow().to_batches():
                w, at, mask = (c.to_numpy(zero_copy_only=False) for c in r.columns)
                for k in np.unique(w):
                    slices[k][at[w == k]] = mask[w == k].astype(np.uint64)
    finally:
        work.remove()
    common = max(range(len(languages)), key=lambda j: (totals[languages[j]], languages[j])) if languages else 0
    return Filters(languages, common, slices)


def judge(filters: Filters, texts: pd.Series) -> pd.DataFrame:
    """lang, score and coverage of each text, taken together as far as their characters come to AT_ONCE."""
    got, wait, held = [], [], 0
    for t in texts:
        size = len(t) if isinstance(t, str) else 0
        if wait and held + size > AT_ONCE:
            got += filters.decide(wait)
            wait, held = [], 0
        wait.append(t if size else None)
        held += size
    got += filters.decide(wait) if wait else []
    return pd.DataFrame(got, columns=["lang", "score", "coverage"])


def identify(docs: DataFrame, model: Filters, *, undecided: str = "und") -> DataFrame:
    """docs with lang_pred, score (share of the corrected hits) and coverage (corrected hits an n-gram) added.

    Only text is an input. Null texts and texts without a letter get `undecided`, score 0. A text none of
    whose n-grams is known gets the language with the most n-grams learned, score 0. If nothing was learned, all
    get `undecided`. Texts of any length are read whole. Ties go to the first language in alphabetical order. Every row gives one row; columns named
    lang_pred, score or coverage are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((model.languages, model.common, model.slices))

    @F.pandas_udf("lang string, score double, coverage double")
    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        filters = Filters(*shared.value)
        for texts in batches:
            yield judge(filters, texts)
            del texts  # before the next ones are read
            release()

    docs = docs.drop("lang_pred", "score", "coverage")
    (name,) = fresh(docs, "_found")
    found = docs.withColumn(name, decide("text"))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(f"{name}.lang", F.lit(undecided)).alias("lang_pred"), F.col(f"{name}.score").alias("score"), F.col(f"{name}.coverage").alias("coverage"))


def op9(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the four fifths that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model).drop("text")
