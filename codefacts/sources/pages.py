"""Documentation pages: rendered text from folders or from the host's page reader."""

from __future__ import annotations

import shutil
import subprocess

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.schemas import MAN_PAGES

LISTED = r"^\s*([^(]+?)\s*\(\s*([^)]+?)\s*\)"


def without_warnings(text: Column) -> Column:
    """Output of a command without its warning lines, each line that stays ended by a line feed."""
    lines = F.split(F.regexp_replace(text, r"\n\z", ""), "\n")
    kept = F.filter(lines, lambda x: ~x.rlike(r"^[ \t]*warning:"))
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.array_join(F.transform(kept, lambda x: F.concat(x, F.lit("\n"))), ""))


def page_index(lines: DataFrame, section: str | None = None) -> DataFrame:
    """(name, section) of lines such as 'read (2) - read from a file descriptor'; other lines are skipped."""
    found = lines.select(F.regexp_extract("value", LISTED, 1).alias("name"), F.regexp_extract("value", LISTED, 2).alias("section")).where("name <> '' and section <> ''")
    return found if section is None else found.where(F.col("section") == section)


def rendered_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages below a folder of files named name.section, read by the executors."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.([^./]+)$", 1)
    part = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.([^./]+)$", 2)
    read = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return read.select(name.alias("name"), part.alias("section"), without_warnings(F.col("value")).alias("raw")).where("name <> ''")


def host_pages(index: DataFrame) -> DataFrame:
    """Pages that the executors' page reader prints; a page without output is left out."""

    def run(batches):
        man, col = shutil.which("man"), shutil.which("col")
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                text = ""
                if man and col:
                    page = subprocess.run([man, r.section, r.name], capture_output=True, check=False)
                    text = subprocess.run([col, "-b"], input=page.stdout, capture_output=True, check=False).stdout.decode("utf-8", "replace")
                if text:
                    out.append((r.name, r.section, text))
            yield pd.DataFrame(out, columns=["name", "section", "raw"])

    return index.select("name", "section").mapInPandas(run, MAN_PAGES).withColumn("raw", without_warnings(F.col("raw"))).where("raw <> ''")


def host_index(spark: SparkSession, section: str | None = None) -> DataFrame:
    """What the host's page reader lists."""
    man = shutil.which("man")
    listed = subprocess.run([man, "-k", "."], capture_output=True, check=False).stdout.decode("utf-8", "replace").splitlines() if man else []
    return page_index(spark.createDataFrame([(x,) for x in listed], "value string"), section)
