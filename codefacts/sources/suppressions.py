"""Suppression files: one rule a line, a path or pattern and a category."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from codefacts.functions.text import glob_regex, is_glob
from codefacts.schemas import SUPPRESS_RULES

DEFAULT = ".codefactsrc"


def read_rules(path: str) -> list[tuple[str, str, bool, str | None]]:
    """(path, category, is_glob, regex); comments, blank and short lines are skipped, paths are relative to the file, exact ones must exist."""
    home, out = os.path.dirname(os.path.abspath(path)), []
    with open(path, encoding="utf-8", errors="replace") as f:
        for line in f:
            words = line.split()
            if len(words) < 2 or words[0].startswith("#"):
                continue
            full = words[0] if words[0].startswith("/") else f"{home}/{words[0]}"
            if is_glob(full):
                out.append((full, words[1], True, glob_regex(full)))
            elif os.path.exists(full):
                out.append((os.path.realpath(full), words[1], False, None))
    return out


def suppress_rules(spark: SparkSession, path: str | None) -> DataFrame:
    """The rules of the given file, else of the default one in the working folder if it can be read, else none."""
    if path is None and os.access(DEFAULT, os.R_OK):
        path = DEFAULT
    return spark.createDataFrame(read_rules(path) if path else [], SUPPRESS_RULES)
