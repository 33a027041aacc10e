"""C sources: files, their views, and their events and markers."""

from __future__ import annotations

import os
import re
import shutil
import subprocess

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codefacts.functions.cparse import TOKEN, c_events
from codefacts.functions.text import minimal_view
from codefacts.schemas import C_FILES, EVENTS, MARKERS
from codefacts.sources.compdb import preprocessor_flags, shell_words

#: The tool whose name in NOLINT(...) counts.
TOOL = "codefacts"
STANDARD = "-std=c11"


def listed_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """files of a command line, in its order; those that can't be read are left out."""
    rows = []
    for k, p in enumerate(paths):
        try:
            with open(p, "rb") as f:
                rows.append((k, p, os.path.realpath(p), f.read().decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode("utf-8")))
        except OSError:
            continue
    return spark.createDataFrame(rows, C_FILES)


def folder_files(spark: SparkSession, path: str, pattern: str = "*.[ch]") -> DataFrame:
    """All sources below a folder of any file system, read by the executors, one row a file."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    name = F.regexp_replace(F.col("_metadata.file_path"), "^file:(//)?(?=/)", "")
    return read.select(F.xxhash64(name).alias("file_idx"), name.alias("path"), name.alias("abs_path"), F.col("value").alias("raw"))


def preprocessed(files: DataFrame, compiler: str = "clang") -> DataFrame:
    """files with pp: what the preprocessor prints with each file's flags; null where there is no compiler or no output.

    A file of the compile database for which nothing is printed is an error.
    """
    schema = files.schema.simpleString()[7:-1]

    def run(batches):
        there = shutil.which(compiler)
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                listed = bool(getattr(r, "in_database", False))
                words = preprocessor_flags([*r.arguments] if listed and r.arguments is not None else []) + preprocessor_flags(shell_words(r.command or "") if listed else [])
                text = None
                if there:
                    done = subprocess.run([there, "-E", STANDARD, *words, r.abs_path], cwd=r.compile_dir if listed else None, capture_output=True, check=False)
                    text = done.stdout.decode("utf-8", "replace") or None
                    if listed and text is None:
                        raise RuntimeError(f"no preprocessed text for {r.path}")
                out.append(text)
            yield rows.assign(pp=pd.Series(out, dtype=object, index=rows.index))

    return files.mapInPandas(run, f"{schema}, pp string")


def user_lines(files: DataFrame, key: list[str], pp: str = "pp") -> DataFrame:
    """(key, pp_user, line_map): the lines that line markers assign to the file itself, and their numbers in it.

    A line marker holds until the next; any line that starts with # is one and is not counted.
    """
    lines = files.where(F.col(pp).isNotNull()).select(*key, F.posexplode(F.split(pp, "\n")).alias("pos", "line"))
    directive = F.col("line").startswith("#")
    number, name = F.regexp_extract("line", r"^#\s*(?:line\s+)?(\d+)", 1), F.regexp_extract("line", r'^#[^"]*"([^"]*)"', 1)
    mark = F.when(directive & (number != ""), F.struct(number.cast("int").alias("n"), name.alias("name")))
    w = Window.partitionBy(*key).orderBy("pos")
    marked = lines.withColumn("directive", directive).withColumn("mark", F.last(mark, ignorenulls=True).over(w)).withColumn("block", F.count(mark).over(w))
    nth = F.sum((~F.col("directive")).cast("int")).over(Window.partitionBy(*key, "block").orderBy("pos")) - 1
    own = marked.withColumn("n", F.col("mark.n") + nth).where(~F.col("directive") & (F.col("mark.name") == F.col("abs_path")))
    rows = F.array_sort(F.collect_list(F.struct("pos", "line", "n")))
    return own.groupBy(*key).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("pp_user"), F.transform(rows, lambda r: r["n"].cast("int")).alias("line_map"))


def source_views(files: DataFrame, compiler: str | None = "clang") -> DataFrame:
    """file_idx, path, abs_path, raw, min, pp_user, line_map."""
    base = files.select("file_idx", "path", "abs_path", "raw", minimal_view(F.col("raw")).alias("min"))
    if compiler is None or shutil.which(compiler) is None:
        return base.select("*", F.lit(None).cast("string").alias("pp_user"), F.lit(None).cast("array<int>").alias("line_map"))
    for c, kind in (("compile_dir", "string"), ("command", "string"), ("arguments", "array<string>"), ("in_database", "boolean")):
        files = files if c in files.columns else files.withColumn(c, F.lit(None).cast(kind))
    user = user_lines(preprocessed(files, compiler), ["file_idx", "abs_path"])
    return base.join(user.drop("abs_path"), "file_idx", "left")


def source_markers(text: str, tool: str = TOOL) -> list[tuple[int, str]]:
    """(line, kind) of each line comment that starts with a marker, mc:ignore or NOLINT(tool): 'next' if only blanks stand before it, else 'same'."""
    out, marker = [], re.compile(rf"//[ \t]*(?:mc:ignore|NOLINT\({re.escape(tool)}\))")
    for m in TOKEN.finditer(text):
        if m.lastgroup == "comment" and marker.match(m.group()):
            start = text.rfind("\n", 0, m.start()) + 1
            out.append((text.count("\n", 0, m.start()) + 1, "next" if not text[start : m.start()].strip(" \t") else "same"))
    return out


def parsed_events(views: DataFrame) -> DataFrame:
    """The events of every file, from its user lines if it has any, else from its raw text."""
    columns = [c.split()[0] for c in EVENTS.split(", ")]
    text = F.coalesce(F.when(F.col("pp_user") != "", F.col("pp_user")), F.col("raw"))
    chosen = views.select("file_idx", "path", text.alias("text"), F.when(F.coalesce(F.col("pp_user"), F.lit("")) != "", F.col("line_map")).alias("line_map"))

    def run(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                out += [{"file_idx": r.file_idx, "path": r.path, **e} for e in c_events(r.text or "", None if r.line_map is None else [*r.line_map])]
            frame = pd.DataFrame(out, columns=columns).astype(object)
            yield frame.where(frame.notna(), None)

    return chosen.mapInPandas(run, EVENTS)


def parsed_markers(views: DataFrame, tool: str = TOOL) -> DataFrame:
    """The markers of every file, from its raw text; in NOLINT(...) only the tool's name counts."""

    def run(batches):
        for rows in batches:
            out = [(r.file_idx, r.path, line, kind) for r in rows.itertuples(index=False) for line, kind in source_markers(r.raw or "", tool)]
            yield pd.DataFrame(out, columns=["file_idx", "path", "line", "kind"])

    return views.select("file_idx", "path", "raw").mapInPandas(run, MARKERS)
