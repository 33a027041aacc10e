"""Extension: analyse source files as they arrive in a folder.

No rule looks at more than one file, so every micro-batch is analysed by itself and there is no state
to keep; runs and facts are written with the batch's number, so that a batch that is repeated after a
failure replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.operators import rundb
from codefacts.plans.analyze import analyze


def watch(spark: SparkSession, folder: str, store: str, rules: DataFrame, suppressions: DataFrame, *, checkpoint: str, pattern: str = "*.c"):
    """A started query; every batch of new files becomes runs and facts under store/<table>/batch=N."""
    arriving = spark.readStream.format("text").schema("value string").option("wholetext", "true").option("pathGlobFilter", pattern).load(folder)
    name = F.regexp_replace(F.col("_metadata.file_path"), "^file:(//)?(?=/)", "")
    files = arriving.select(F.xxhash64(name).alias("file_idx"), name.alias("path"), name.alias("abs_path"), F.col("value").alias("raw"))

    def one(batch: DataFrame, number: int) -> None:
        a = analyze(batch.persist(), rules, suppressions, compiler=None)
        runs = rundb.run_rows(a.files, a.findings, 0).persist()
        rundb.fact_rows(a.findings, runs).write.mode("overwrite").parquet(f"{store}/facts/batch={number}")
        runs.drop("file_idx").write.mode("overwrite").parquet(f"{store}/runs/batch={number}")
        for kept in (runs, a.views, batch):
            kept.unpersist()

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
