"""Stores as folders of Parquet tables; a table that is missing is empty."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from codefacts import schemas

CONTRACTS = {"functions": schemas.FUNCTIONS, "function_sections": schemas.FUNCTION_SECTIONS, "function_aliases": schemas.FUNCTION_ALIASES}
RUN_STORE = {"runs": schemas.RUNS, "facts": schemas.FACTS, "fact_terms": schemas.FACT_TERMS}


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def table_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def current(spark: SparkSession, store: str, name: str) -> str:
    """The folder that holds a table: the one that the store's newest manifest names, else the folder of its name."""
    fs, folder = _fs(spark, f"{store}/_versions")
    if not fs.exists(folder):
        return f"{store}/{name}"
    named = sorted(x.getPath().getName() for x in fs.listStatus(folder) if x.getPath().getName().endswith(".json"))
    if not named:
        return f"{store}/{name}"
    return f"{store}/{names_of(spark, store, named[-1]).get(name, name)}"


def read_table(spark: SparkSession, store: str, name: str) -> DataFrame:
    schema = (CONTRACTS | RUN_STORE)[name]
    path = current(spark, store, name)
    return spark.read.schema(schema).parquet(path) if table_exists(spark, path) else spark.createDataFrame([], schema)


def append(rows: DataFrame, store: str, name: str) -> None:
    rows.write.mode("append").parquet(current(rows.sparkSession, store, name))


def swap(tables: dict[str, DataFrame], store: str) -> None:
    """Replace tables of a store, all at once: they are written beside the old ones, then one rename puts a manifest of all in place.

    A crash before the rename leaves the old tables, one after it the new ones; the folders of the version before stay for readers
    that have begun, those of older ones go.
    """
    if not tables:
        return
    spark = next(iter(tables.values())).sparkSession
    tag = uuid.uuid4().hex
    fs, folder = _fs(spark, f"{store}/_versions")
    fs.mkdirs(folder)
    before = sorted(x.getPath().getName() for x in fs.listStatus(folder) if x.getPath().getName().endswith(".json"))
    names = {n: current(spark, store, n).rpartition("/")[2] for n in CONTRACTS | RUN_STORE} | {n: f"{n}-{tag}" for n in tables}
    for name, rows in tables.items():
        rows.write.parquet(f"{store}/{names[name]}")
    number = int(before[-1].partition("-")[0]) + 1 if before else 1
    _, draft = _fs(spark, f"{store}/_versions/.{tag}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(names).encode()))
    out.close()
    if not fs.rename(draft, _fs(spark, f"{store}/_versions/{number:012}-{tag}.json")[1]):
        raise OSError(f"cannot put the new tables of {store} in place")
    kept = {*names.values(), *(names_of(spark, store, before[-1]).values() if before else names)}
    for old in before[:-1]:
        for gone in {*names_of(spark, store, old).values()} - kept:
            fs.delete(_fs(spark, f"{store}/{gone}")[1], True)
        fs.delete(_fs(spark, f"{store}/_versions/{old}")[1], False)


def names_of(spark: SparkSession, store: str, manifest: str) -> dict[str, str]:
    """table -> folder, as a manifest says."""
    fs, path = _fs(spark, f"{store}/_versions/{manifest}")
    stream = fs.open(path)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
