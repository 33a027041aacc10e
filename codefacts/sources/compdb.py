"""Compile databases: entries, resolved paths, and the flags that matter for preprocessing."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codefacts.schemas import COMPILE_COMMANDS

WITH_VALUE = ("-std", "-D", "-U", "-I")


def resolved(base: str, path: str) -> str:
    """The canonical path if it exists, else the joined one."""
    joined = path if os.path.isabs(path) or not base else f"{base.rstrip('/')}/{path}"
    return os.path.realpath(joined) if os.path.exists(joined) else joined


def shell_words(text: str) -> list[str]:
    """Words of a command: blanks separate, quotes group, a backslash takes the next character as it is, in any quotes."""
    words, word, quote, k = [], None, "", 0
    while k < len(text):
        c = text[k]
        if c == "\\" and k + 1 < len(text):
            k += 1
            word = (word or "") + text[k]
        elif quote:
            if c == quote:
                quote = ""
            else:
                word += c
        elif c in "'\"":
            quote, word = c, word or ""
        elif c in " \t\r\n":
            if word is not None:
                words.append(word)
            word = None
        else:
            word = (word or "") + c
        k += 1
    return words + ([word] if word is not None else [])


def preprocessor_flags(words: list[str]) -> list[str]:
    """The -std, -D, -U and -I flags, each with its value; a flag whose value is missing is an error."""
    words = words[1:] if words and not words[0].startswith("-") else words
    out, k = [], 0
    while k < len(words):
        w = words[k]
        if w in WITH_VALUE:
            if k + 1 >= len(words):
                raise ValueError(f"no value for {w}")
            k += 1
            out += [f"-std={words[k]}"] if w == "-std" else [w, words[k]]
        elif w.startswith("-std=") or w[:2] in ("-D", "-U", "-I"):
            out.append(w)
        k += 1
    return out


def quoted(arguments: F.Column) -> F.Column:
    """Arguments as one command line, each in single quotes."""
    return F.array_join(F.transform(arguments, lambda a: F.concat(F.lit("'"), F.regexp_replace(a, "'", r"'\\''"), F.lit("'"))), " ")


def compile_database(spark: SparkSession, path: str) -> DataFrame:
    """(entry, directory, file, resolved_file, command, arguments) in file order; a malformed file is an error."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in COMPILE_COMMANDS.split(', '))}>>", {"mode": "FAILFAST"}).alias("entries"))
    entries = raw.select(F.posexplode("entries").alias("entry", "e")).select("entry", "e.*")
    home = os.path.dirname(os.path.abspath(path.removeprefix("file://")))
    rows = []  # one file on the driver's disk, whose paths only the driver can resolve
    for r in entries.collect():
        folder = resolved(home, r.directory) if r.directory else home
        rows.append((*r[: entries.columns.index("directory")], folder, *r[entries.columns.index("directory") + 1 :], resolved(folder, r.file) if r.file else None))
    out = spark.createDataFrame(rows, T.StructType([*entries.schema.fields, T.StructField("resolved_file", T.StringType())]))
    return out.withColumn("command", F.when(F.col("command").isNull() & (F.size("arguments") > 0), quoted(F.col("arguments"))).otherwise(F.col("command")))


def with_compile_entry(files: DataFrame, database: DataFrame) -> DataFrame:
    """files with directory, command and arguments of the first entry, in file order, for their canonical path."""
    first = database.withColumn("_nth", F.row_number().over(Window.partitionBy("resolved_file").orderBy("entry"))).where("_nth = 1")
    return files.join(first.select(F.col("resolved_file").alias("abs_path"), F.col("directory").alias("compile_dir"), "command", "arguments", F.lit(True).alias("in_database")), "abs_path", "left")
