"""Token counts of sections and fields from one encoding of the whole text.

A text is encoded once, whole, by a byte-level BPE vocabulary; every token has a character span. Spans
are joined with the sections' intervals, and a token that crosses a boundary is given away by a
stated rule: "most" (the section with most of its characters, the first if equal), "start" (the section
of its first character) or "share" (each section its share of the characters). So the counts of
sections add up to the text's count, which separate encodings of the parts do not.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, ship
from .wordbpe import NOT_PLAIN, UNSURE, Memo, byte_alphabet, default_vocabulary

SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\t-\r \x85\p{Z}\p{L}\p{N}]+|[\t-\r \x85\p{Z}]+(?![^\t-\r \x85\p{Z}])|[\t-\r \x85\p{Z}]+")
PLAIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class SpanEncoder:
    """Character spans of a text's tokens, as the tokenizers library gives them."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.library.no_truncation()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.memo = Memo(self._spans, 500_000)
        self.model, self.letters = self.library.model, dict(enumerate(byte_alphabet()[:128]))

    def _spans(self, piece: str) -> bytes:
        if piece.isascii():  # one character a byte: the merge model's tokens give the spans
            out, at = array("i"), 0
            for t in self.model.tokenize(piece.translate(self.letters)):
                out.append(at)
                at += len(t.value)
                out.append(at)
            return out.tobytes()
        return np.array(self.library.encode(piece, add_special_tokens=False).offsets, np.int32).tobytes()

    def spans(self, text: str) -> np.ndarray:
        """[start, end) of each token, in characters."""
        if not text:
            return np.empty((0, 2), np.int32)
        if any(s in text for s in self.special) or (NOT_PLAIN.search(text) and UNSURE.search(text)):
            return np.array(self.library.encode(text, add_special_tokens=False).offsets, np.int32).reshape(-1, 2)
        pieces = (SPLIT if NOT_PLAIN.search(text) else PLAIN_SPLIT).findall(text)
        found = [*map(self.memo.__getitem__, pieces)]
        sizes = np.fromiter(map(len, pieces), np.int32, len(pieces))
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 8
        return np.frombuffer(b"".join(found), np.int32).reshape(-1, 2) + np.repeat(starts, counts)[:, None]


def pieces(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint ascending intervals and the section that owns each: a character belongs to the first section that covers it."""
    if np.all(start < end) and np.all(end[:-1] <= start[1:]):
        return start, end, np.arange(len(start))
    marks = np.unique(np.concatenate([start, end]))
    owner = np.full(max(len(marks) - 1, 0), -1)
    for k in range(len(start) - 1, -1, -1):
        if start[k] < end[k]:
            owner[np.searchsorted(marks, start[k]) : np.searchsorted(marks, end[k])] = k
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.empty(0, np.int64)
    last = np.append(first[1:], len(owner))
    held = owner[first] >= 0 if len(first) else np.empty(0, bool)
    return marks[first[held]], marks[last[held]], owner[first[held]]


def allocate(spans: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """(tokens of each section, boundary-crossing tokens it touches, tokens of no section).

    Sections are [start, end) in any order; gaps are allowed; where they overlap, the first one in order has the characters.
    """
    n = np.zeros(len(start))
    crossing = np.zeros(len(start), np.int64)
    start, end, owner = pieces(start, end)
    if not len(spans) or not len(start):
        return n, crossing, float(len(spans))
    s, e = spans[:, 0], spans[:, 1]
    at = np.searchsorted(end, s, side="right")
    inside = at < len(start)
    inside[inside] = (start[at[inside]] <= s[inside]) & (e[inside] <= end[at[inside]])
    np.add.at(n, owner[at[inside]], 1)
    outside = 0.0
    for a, b, j in zip(s[~inside].tolist(), e[~inside].tolist(), at[~inside].tolist()):
        touched: dict[int, int] = {}
        first = []
        while j < len(start) and start[j] < b:
            if (over := min(b, int(end[j])) - max(a, int(start[j]))) > 0:
                touched[int(owner[j])] = touched.get(int(owner[j]), 0) + over
                first += [int(owner[j])] if start[j] <= a else []
            j += 1
        left = (b - a) - sum(touched.values())
        if len(touched) > 1 or left:
            for j in touched:
                crossing[j] += 1
        if rule == "share":
            for j, over in touched.items():
                n[j] += over / (b - a)
            outside += left / (b - a)
        elif rule == "start":
            n[first] += 1
            outside += not first
        else:
            over, j = max(((o, -k) for k, o in touched.items()), default=(0, 0))
            if over >= left and over:
                n[-j] += 1
            else:
                outside += 1
    return n, crossing, outside


def attribute_tokens(docs: DataFrame, *, vocabulary: str | None = None, rule: str = "most", sections: str | None = None) -> DataFrame:
    """Tokens of every section: doc_id, section, section_start, section_chars, n_tokens, n_crossing.

    docs: doc_id, text and, if `sections` names it, a column array<struct<start int, end int>> of character
    intervals; else, or where it is null, the sections are the text's lines, each with its line feed. Where intervals overlap, the first one in order has
    the characters. A null entry, one with a null bound and one that ends before it starts are empty sections at 0. Ties under
    "most" go to the first section, and to a section before none. n_tokens is
    double for the rule "share", else whole. Section -1 stands for tokens of no section and is given if it has any. Very
    long texts are encoded whole.
    Null and empty texts have one empty section 0. Repeated rows each give their sections; a null
    doc_id stays null; an empty table gives no rows; other columns are not read.
    """
    if rule not in ("most", "start", "share"):
        raise ValueError(f"unknown rule: {rule}")
    vocabulary = vocabulary or default_vocabulary("byte_bpe_50k.json")
    ship(docs.sparkSession)
    fields = F.col(f"`{sections}`") if sections else F.lit(None).cast("array<struct<start:int,end:int>>")
    number = pa.float64() if rule == "share" else pa.int64()

    def run(batches):
        encoder = SpanEncoder(vocabulary)
        out: list[tuple] = []

        def flush():
            cols = [np.concatenate(c) for c in zip(*[o[1:] for o in out])]
            ids = pa.array([i for i, *o in out for _ in range(len(o[0]))], pa.int64())
            out.clear()
            kinds = (pa.int32(), pa.int32(), pa.int32(), number, pa.int64())
            return pa.RecordBatch.from_arrays([ids, *(pa.array(c).cast(k) for c, k in zip(cols, kinds))], names=["doc_id", "section", "section_start", "section_chars", "n_tokens", "n_crossing"])

        held = 0
        for b in batches:
            for doc_id, text, given in zip(*(c.to_pylist() for c in b.columns)):
                text = text or ""
                spans = encoder.spans(text)
                if given is None:
                    sizes = np.array([len(x) + 1 for x in text.split("\n")])
                    sizes[-1] -= 1
                    end = np.cumsum(sizes)
                    start = end - sizes
                else:
                    whole = [(x["start"], x["end"]) if x and None not in (x["start"], x["end"]) and x["start"] < x["end"] else (0, 0) for x in given]
                    start, end = np.array(whole, np.int64).reshape(-1, 2).T
                n, crossing, outside = allocate(spans, start, end, rule)
                names = np.arange(len(start))
                if outside or not len(start):
                    names, start, end, n, crossing = (np.append(v, x) for v, x in ((names, -1), (start, 0), (end, 0), (n, outside), (crossing, 0)))
                out.append((doc_id, names, start, end - start, n, crossing))
                held += len(names)
            if held > 20_000:
                held = 0
                yield flush()
        if out:
            yield flush()

    kind = "double" if rule == "share" else "long"
    narrow = columns(docs, "doc_id", "text", *([sections] if sections else [])).select(F.col("doc_id").cast("long"), "text", fields.alias("given"))
    return narrow.mapInArrow(run, f"doc_id long, section int, section_start int, section_chars int, n_tokens {kind}, n_crossing long")


def op1(spark, sf_dir: str) -> DataFrame:
    """The tokens of every line of every document; see attribute_tokens."""
    return attribute_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
