"""A corpus pipeline: language, recurring lines, near duplicates, packing.

Every stage takes any table with doc_id and text, of any other columns, which it hands on as they are; lang and
n_chars are used if they are there. Repeated rows are treated alike, ids may be null or repeated, texts of any
length are read whole, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.llm.common import Scratch, fresh, wide_hash
from codefacts.llm.language_id import fit, held_out, identify
from codefacts.llm.line_templates import drop_recurring_lines
from codefacts.llm.near_dedup import near_duplicate_classes
from codefacts.llm.packing import pack_documents

#: Texts of whose n-grams fewer than this share are known in any language are rejected.
LEAST_COVERAGE = 0.1


def plain(docs: DataFrame) -> tuple[DataFrame, list]:
    """docs with numbered names for all columns but doc_id and text, and the columns that give the old names back."""
    names = [c if c in ("doc_id", "text") else f"_{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns)]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: those with null text, without letters or of unknown n-grams go.

    Where no document has a lang to learn from, no language is unknown: only texts without a letter go.
    """
    numbered, named = plain(docs)
    labelled = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    model = fit(labelled.where(~held_out(F.col("doc_id"))))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = identify(numbered, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("coverage") >= LEAST_COVERAGE)).select(named)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines of recurring templates; n_chars, if there, follows the text. Null texts stay null."""
    numbered, named = plain(docs)
    if "n_chars" in docs.columns:
        at = docs.columns.index("n_chars")
        kind = docs.schema["n_chars"].dataType
        named[at] = F.when(F.col("n_lines_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col(f"_{at}")).alias("n_chars")
    return drop_recurring_lines(numbered).select(*named)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one of the least doc_id, once. Null texts are no duplicates unless their ids are equal."""
    own, key = fresh(docs, "_row", "_kept")
    # one key that is never null, so that the join and the choice of one row share a partitioning
    row = lambda doc_id, text: wide_hash(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("none")), F.coalesce(F.hex(text), F.lit("none"))))
    kept = near_duplicate_classes(docs).where("kept").select(row(F.col("doc_id"), F.col("text_hash")).alias(key)).distinct()
    hashed = docs.withColumn(own, row(F.col("doc_id"), wide_hash("text")))
    return hashed.join(kept, hashed[own] == kept[key], "left_semi").dropDuplicates([own]).select(*[F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in windows of 2048: one row a piece, with its ids. Null texts are empty documents."""
    return pack_documents(docs, with_ids=True)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("packing", packing)]
#: SQL can't express the models and encodings of three of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; each other stage's rows are a table in the shared checkpoint folder, which goes once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        work = Scratch(spark, name)
        docs = work.keep(stage(spark, docs, sf_dir))
        if before is not None:
            before.remove()
        before = work
    return STAGES[-1][1](spark, docs, sf_dir)
