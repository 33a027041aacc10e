"""Sharding along a Hilbert curve over document metadata.

Language, source and size are quantised to quantile bins, whose Hilbert index orders the documents so
that neighbours are alike in all three; runs of that order are the shards, which a reader can then
skip by the range of any of the dimensions. Equal texts stand together at one place of the curve (their
least language and source) and stay in one shard, unless equal sizes need them cut.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, ship, wide_hash

BITS = 5


def hilbert_index(coordinates: list[np.ndarray], bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with coordinates of `bits` bits (Skilling's transposed form)."""
    x = [c.astype(np.int64).copy() for c in coordinates]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:  # undo excess work of the inverse transform
        p = q - 1
        for i in range(n):
            swap = (x[i] & q) == 0
            t = np.where(swap, (x[0] ^ x[i]) & p, 0)
            x[0] = np.where(swap, x[0] ^ t, x[0] ^ p)
            x[i] = x[i] ^ t if i else x[0]
        q >>= 1
    for i in range(1, n):  # Gray encode
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ t) >> b) & 1)
    return out


def string_cuts(rows: DataFrame, name: str, bins: int) -> list[str]:
    """At most bins - 1 values that cut the ordered rows into near equal parts; nulls count as first. The driver gets one value a bin."""
    counts = rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    total, missing = counts.agg(F.sum("n"), F.sum(F.when(F.col(name).isNull(), F.col("n")))).first()
    run = running_totals(counts.where(F.col(name).isNotNull()), [name], ["n"])
    middle = F.col("before_n") + F.col("n") / 2 + (missing or 0)
    tops = run.groupBy(F.floor(middle * bins / (total or 1)).alias("bin")).agg(F.max(name).alias("top")).collect()
    return sorted(r.top for r in tops)[:-1]


def bin_of(value: F.Column, cuts: list, bins: int) -> F.Column:
    """How many cuts are under the value, stretched to 0 .. bins - 1; 0 for null."""
    under = F.lit(0)
    for c in cuts:
        under = under + (value > F.lit(c)).cast("int")
    return F.coalesce(F.floor(under * bins / (len(cuts) + 1)), F.lit(0)).cast("int")


def running_totals(rows: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """rows with before_<c>: the sum of c over all rows that stand before it in the given total order.

    Rows are dealt by ranges of the order and kept, so that partition numbers stay; the driver gets
    one total a partition, and each partition adds up its own rows.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order))
    totals = kept.groupBy(F.spark_partition_id().alias("p")).agg(*[F.sum(c).alias(c) for c in sums]).collect()
    first = {c: dict(zip((t.p for t in sorted(totals)), np.cumsum([0] + [t[c] for t in sorted(totals)])[:-1].tolist())) for c in sums}

    def run(batches):
        from pyspark import TaskContext

        p = TaskContext.get().partitionId()
        at = {c: first[c].get(p, 0) for c in sums}
        for b in batches:
            extra = []
            for c in sums:
                v = b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64)
                done = np.cumsum(v) + at[c]
                extra.append(pa.array(done - v))
                at[c] = int(done[-1]) if len(done) else at[c]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, *(f"before_{c}" for c in sums)])

    schema = T.StructType([*kept.schema.fields, *(T.StructField(f"before_{c}", T.LongType()) for c in sums)])
    return kept.mapInArrow(run, schema)


def hilbert_shards(docs: DataFrame, shards: int = 8, *, tolerance: float = 1 / 64, carry: str | None = None) -> DataFrame:
    """Every document's shard: doc_id, size, text_crc32, curve, shard, slot, lang_bin, source_bin, size_bin, group_cut.

    docs: doc_id, text, lang, source. size is the text's UTF-8 bytes (null: none) plus 1; shards are runs of
    the curve with near equal sums of size; slot counts from 0 without gaps in each shard. The bins are quantiles, over all
    rows, of the whole values. A group of equal texts at the border of two shards goes whole to the one that has more of it, if that
    moves the border by at most `tolerance` of a shard's mean size or by the largest document; other groups over a
    border are cut document by document, which group_cut tells. Null texts form one group, apart from empty ones; null
    languages and sources come first; equal values share a bin; very long texts count with their size and may leave shards uneven; repeated rows each
    get a slot; a null doc_id is placed like any other. Fewer documents than shards leave shards empty; an empty table
    gives no rows. carry names a column that holds the row's other columns as a struct; else they are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    raw, bins = F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 1 << BITS
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(carry)] if carry else []
    rows = cut(
        docs.select(
            F.col("doc_id").cast("long"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), wide_hash("text").alias("body"), "lang", "source",
            F.spark_partition_id().alias("salt"), *carried,
        )
    )
    key = ["body", "text_crc32", "size"]
    found = rows.agg(F.percentile_approx("size", [k / bins for k in range(1, bins)], 10_000)).first()[0]
    binned = rows.select(
        "*", bin_of(F.col("lang"), string_cuts(rows, "lang", bins), bins).alias("lang_bin"), bin_of(F.col("source"), string_cuts(rows, "source", bins), bins).alias("source_bin"),
        bin_of(F.col("size"), sorted({*(found or [])}), bins).alias("size_bin"),
    )

    @F.pandas_udf("long")
    def curve(lang: pd.Series, source: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([v.to_numpy() for v in (lang, source, size)], BITS))

    places = ["lang_bin", "source_bin", "size_bin"]
    salted = binned.groupBy(*key, "salt").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in places])
    groups = salted.groupBy(*key).agg(F.sum("n").alias("n"), *[F.min(c).alias(c) for c in places])
    groups = groups.select(*key, "n", (F.col("n") * F.col("size")).alias("bytes"), curve(*places).alias("curve"))
    placed = cut(running_totals(groups, ["curve", *key], ["n", "bytes"]))
    total, largest = (x or 1 for x in placed.agg(F.sum("bytes"), F.max("size")).first())
    mean = total / shards
    end = F.col("before_bytes") + F.col("bytes")
    border = F.ceil(F.col("before_bytes") / mean) * mean
    moved = F.least(border - F.col("before_bytes"), end - border)
    whole = (F.col("bytes") <= largest) | (border >= end) | ((border + mean >= end) & (moved <= max(tolerance * mean, largest)))
    placed = placed.select("*", (~whole).alias("group_cut"))

    before = Window.partitionBy(*key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = salted.select(*key, "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip")).withColumnRenamed("body", "_body")
    placed = placed.withColumnRenamed("body", "_body")
    same = lambda a, b: a["body"].eqNullSafe(b["_body"]) if "body" in a.columns else a["_body"].eqNullSafe(b["_body"])
    joined = parts.join(placed, parts["_body"].eqNullSafe(placed["_body"]) & (parts["text_crc32"] == placed["text_crc32"]) & (parts["size"] == placed["size"]))
    joined = joined.select(parts["_body"], parts["text_crc32"].alias("_crc"), parts["size"].alias("_size"), parts["salt"].alias("_salt"), "skip", "bytes", "before_n", "before_bytes", "curve", "group_cut")
    inside = F.row_number().over(Window.partitionBy(*key, "salt").orderBy("doc_id")) - 1
    ranked = binned.withColumn("inside", inside)
    ranked = ranked.join(joined, same(ranked, joined) & (F.col("text_crc32") == F.col("_crc")) & (F.col("size") == F.col("_size")) & (F.col("salt") == F.col("_salt")))
    ranked = ranked.withColumn("inside", F.col("inside") + F.col("skip"))
    middle = F.when(F.col("group_cut"), F.col("before_bytes") + (F.col("inside") + 0.5) * F.col("size")).otherwise(F.col("before_bytes") + F.col("bytes") / 2)
    shard = F.least(F.floor(middle * shards / total), F.lit(shards - 1)).cast("int")
    last = [*places, "group_cut", *([carry] if carry else [])]
    done = cut(ranked.select("doc_id", "size", "text_crc32", "curve", shard.alias("shard"), (F.col("before_n") + F.col("inside")).alias("place"), *last))
    starts = {r.shard: r.first for r in done.groupBy("shard").agg(F.min("place").alias("first")).collect()}
    start = F.create_map(*[F.lit(x) for k in range(shards) for x in (k, starts.get(k, 0))])[F.col("shard")]
    return done.select("doc_id", "size", "text_crc32", "curve", "shard", (F.col("place") - start).cast("long").alias("slot"), *last)


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """docs, every row once and with all its columns, as a folder of Parquet files a shard, named shard=k; each file is a run of the curve.

    A column of docs that is named shard, in any case, is written as _shard (with more underscores if that is taken too).
    """
    placed = hilbert_shards(docs, shards, carry="row")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = placed.repartitionByRange(max(n, shards), "shard", "slot").sortWithinPartitions("shard", "slot")
    names = [fresh(docs, "_shard")[0] if c.lower() == "shard" else c for c in docs.columns]
    run.select("shard", *[F.col(f"row.`{c}`").alias(n) for c, n in zip(docs.columns, names)]).write.mode("overwrite").partitionBy("shard").parquet(path)


def op7(spark, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes; see hilbert_shards."""
    placed = hilbert_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve", "group_cut")
