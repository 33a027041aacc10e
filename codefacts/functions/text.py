"""Column functions on text: views, words, globs, terms."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "[ \\t\\r\\n\\f\\x0B]+"


def minimal_view(raw: Column) -> Column:
    """Source text without comments and with each white-space run as one blank.

    Literals are not honoured; a comment that ends is a blank, one that does not is dropped; a blank after
    a slash that follows a blank is swallowed.
    """
    pieces = F.regexp_extract_all(raw, F.lit(r"(?s)//[^\n]*\n|/\*.*?\*/|//[^\n]*\z|/\*.*\z|[^/]+|/"), F.lit(0))
    ends = lambda t: (t.startswith("//") & t.endswith("\n")) | (t.startswith("/*") & t.endswith("*/") & (F.length(t) > 3))
    said = F.transform(pieces, lambda t: F.when(ends(t), " ").when(t.startswith("//") | t.startswith("/*"), "").otherwise(t))
    return F.regexp_replace(F.regexp_replace(F.array_join(said, ""), BLANK, " "), "(?<= )/ ", "/")


def trimmed(text: Column, characters: str = " \t\n") -> Column:
    return F.trim(text, F.lit(characters))


def has_word(text: Column, word: str) -> Column:
    """Whether text holds the identifier, not as part of a longer one."""
    return text.rlike(f"(^|[^A-Za-z0-9_]){word}([^A-Za-z0-9_]|$)")


def glob_regex(pattern: str) -> str:
    """The regular expression of a path pattern; * and ? stay within one folder, classes may be negated with !."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        close = pattern.find("]", k + 2) if c == "[" else -1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif close > 0:
            inner = pattern[k + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[{'^/' + inner[1:] if inner[0] in '!^' else inner}]")
            k = close
        elif c == "\\" and k + 1 < len(pattern):
            k += 1
            out.append(f"\\{pattern[k]}" if not pattern[k].isalnum() else pattern[k])
        else:
            out.append(c if c.isalnum() or c in "_/ -" else f"\\{c}")
        k += 1
    return f"^{''.join(out)}$"


def is_glob(path: str) -> bool:
    return any(c in path for c in "*?[")


def plain_letters(text: Column) -> Column:
    """Text without the diacritics of Latin letters; the pairs follow from their decompositions."""
    pairs = {chr(c): d[0] for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(c))) > 1}
    return F.translate(text, "".join(pairs), "".join(pairs.values()))


def terms(text: Column) -> Column:
    """Lower-case terms in order; every character that is no letter or digit separates, but for combining marks, which are dropped."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\u0300-\\u036f]", "")
    return F.filter(F.split(F.lower(plain_letters(bare)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def cut_bytes(text: Column, most: int) -> Column:
    """The first `most` UTF-8 bytes, without a torn last character."""
    cut = F.decode(F.substring(F.encode(text, "UTF-8"), 1, most), "UTF-8")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.regexp_replace(cut, "�+$", ""))
