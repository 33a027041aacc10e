"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

Words are counted over all texts; the `lexicon_words` most frequent, found by counts of counts, are compiled, in sorted order,
into a minimal acyclic automaton whose equal suffixes are shared. Every arc carries a number; along
the arcs of a word they add up to the word's place in the table of id sequences, which is the
automaton's output. The arcs, sorted by state and byte, lie in one file that Spark ships to the
executors, where every worker maps it into memory. All words of a batch walk through it together,
one byte a step, each step one binary search over the arcs; words it does not hold are merged exactly.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, columns, ship
from .wordbpe import LibraryWords, WordSplitter, default_vocabulary

FIELDS = ("key", "target", "add", "final", "offset", "ids")


class Transducer:
    """word -> ids; built from sorted (word bytes, ids), held as arrays that a file can map."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.key, self.target, self.add, self.final, self.offset, self.ids = (arrays[f] for f in FIELDS)

    @classmethod
    def build(cls, words: list[tuple[bytes, list[int]]]) -> Transducer:
        words = sorted(dict(words).items())
        arcs: list[dict[int, int]] = [{}]  # of each state: byte -> state
        final = [False]
        register: dict[tuple, int] = {}
        path = [0]  # states along the last word

        def close(down_to: int) -> None:
            """Make the states after place down_to permanent, reusing any that have the same future."""
            while len(path) - 1 > down_to:
                state, parent = path.pop(), path[-1]
                key = (final[state], tuple(sorted(arcs[state].items())))
                same = register.setdefault(key, state)
                if same != state:
                    arcs[parent][last[len(path) - 1]] = same

        last = b""
        for word, _ in words:
            common = len(os.path.commonprefix([word, last]))
            close(common)
            for byte in word[common:]:
                arcs.append({})
                final.append(False)
                arcs[path[-1]][byte] = len(arcs) - 1
                path.append(len(arcs) - 1)
            final[path[-1]] = True
            last = word
        close(0)
        return cls(cls._arrays(arcs, final, [ids for _, ids in words]))

    @staticmethod
    def _arrays(arcs, final, outputs) -> dict[str, np.ndarray]:
        live, seen, stack = [], {0}, [0]
        while stack:
            s = stack.pop()
            live.append(s)
            for t in arcs[s].values():
                if t not in seen:
                    seen.add(t)
                    stack.append(t)
        name = {s: k for k, s in enumerate(live)}
        below = [0] * len(live)  # accepted words from here on

        order, state = [], [0] * len(live)
        stack = [0]
        while stack:
            s = stack[-1]
            k = name[s]
            if state[k]:
                stack.pop()
                if state[k] == 1:
                    order.append(s)
                    state[k] = 2
                continue
            state[k] = 1
            stack += [t for t in arcs[s].values() if not state[name[t]]]
        for s in order:
            below[name[s]] = int(final[s]) + sum(below[name[t]] for t in arcs[s].values())
        key, target, add = [], [], []
        for s in live:
            total = int(final[s])
            for x in sorted(arcs[s]):
                t = arcs[s][x]
                key.append(name[s] * 256 + x)
                target.append(name[t])
                add.append(total)
                total += below[name[t]]
        by_key = np.argsort(np.array(key, np.int64), kind="stable")
        key, target, add = (np.array(x, np.int32)[by_key] for x in (key, target, add))
        offset = np.concatenate([[0], np.cumsum([len(o) for o in outputs])]).astype(np.int32)
        ids = np.fromiter((i for o in outputs for i in o), np.int32, int(offset[-1]))
        return {"key": key, "target": target, "add": add, "final": np.array([final[s] for s in live], np.int32), "offset": offset, "ids": ids}

    def save(self, path: str) -> None:
        """One file: the lengths of the arrays, then the arrays, all 32-bit."""
        arrays = [getattr(self, f) for f in FIELDS]
        with open(path, "wb") as f:
            f.write(np.array([len(a) for a in arrays], np.int32).tobytes())
            for a in arrays:
                f.write(np.ascontiguousarray(a, np.int32).tobytes())

    @classmethod
    def load(cls, path: str) -> Transducer:
        whole = np.memmap(path, np.int32, "r")
        ends = np.cumsum([len(FIELDS), *whole[: len(FIELDS)]])
        return cls({f: whole[a:b] for f, a, b in zip(FIELDS, ends, ends[1:])})

    def places(self, words: list[bytes]) -> np.ndarray:
        """Of each word its place in the table of id sequences, -1 if it isn't held."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.key) or not words:
            return out
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        on = np.flatnonzero(lengths > 0)
        state, number = np.zeros(len(on), np.int64), np.zeros(len(on), np.int64)
        step = 0
        while len(on):
            wanted = (state * 256 + data[starts[on] + step]).astype(np.int32)
            at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            ok = self.key[at] == wanted
            on, at, number = on[ok], at[ok], number[ok]
            number = number + self.add[at]
            state = self.target[at].astype(np.int64)
            step += 1
            done = lengths[on] == step
            held = done & (self.final[state] > 0)
            out[on[held]] = number[held]
            on, state, number = on[~done], state[~done], number[~done]
        return out

    def sequence(self, place: int) -> list[int]:
        return self.ids[self.offset[place] : self.offset[place + 1]].tolist()


def frequent_words(docs: DataFrame, vocabulary: str, most: int) -> list[str]:
    """The most frequent words over all texts (ties by a hash of the word), at most `most`; the driver gets these and counts of a fixed number."""

    def count(batches):
        splitter = WordSplitter(vocabulary)
        seen: Counter = Counter()

        def flush():
            words, counts = [*seen], [*seen.values()]
            seen.clear()
            data = [w.encode("utf-8", "surrogateescape") for w in words]
            return pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), pa.array(counts, pa.int64())], names=["word", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    seen.update(splitter.words(text))
                if len(seen) > 400_000:
                    yield flush()
        yield flush()

    counted = columns(docs, "text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    work = Scratch(docs.sparkSession, "words")
    try:
        words = work.keep(counted.where(F.octet_length("word") <= 64)).select("word", (-F.col("n")).alias("rare"), F.pmod(F.xxhash64("word"), F.lit(1 << 52)).alias("mark"))
        bound, held = first_values(words, "rare", most)
        tied = words.where(F.col("rare") == bound)
        mark, _ = first_values(tied, "mark", most - held)
        taken = words.where((F.col("rare") < bound) | ((F.col("rare") == bound) & (F.col("mark") < mark))).select("word").collect()
    finally:
        work.remove()
    return [bytes(r.word).decode("utf-8", "surrogateescape") for r in taken]


def first_values(rows: DataFrame, value: str, most: int, parts: int = 1024) -> tuple[int, int]:
    """(bound, n): the largest bound such that the n rows whose integer value is under it are at most `most`; found by counting ever narrower ranges."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    if low is None:
        return 0, 0
    held = 0
    while True:
        width = (high - low) // parts + 1
        at = F.floor((F.col(value) - low) / width)
        counts = {r.at: r.n for r in rows.where(F.col(value).between(low, high)).groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for k in sorted(counts):
            if held + counts[k] > most:
                break
            held += counts[k]
        else:
            return high + 1, held
        if width == 1:
            return low + k, held
        low, high = low + k * width, min(high, low + (k + 1) * width - 1)


def publish(spark: SparkSession, words: list[str], vocabulary: str) -> str:
    """Compile the words, let Spark ship the file to every executor; its name there."""
    merges = LibraryWords(vocabulary)
    made = Transducer.build([(w.encode("utf-8", "surrogateescape"), merges.ids(w)) for w in words])
    path = os.path.join(tempfile.mkdtemp(), f"lexicon_{uuid.uuid4().hex}.bin")
    made.save(path)
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


class Coder:
    """Encodes and decodes texts with a mapped lexicon; words outside it are merged exactly and remembered."""

    def __init__(self, lexicon: Transducer, vocabulary: str, remembered: int = 300_000):
        self.lexicon, self.merges = lexicon, LibraryWords(vocabulary)
        self.splitter = self.merges.splitter
        self.known: dict[str, tuple] = {}
        self.remembered = remembered

    def _entry(self, ids: list[int]) -> tuple:
        return len(ids), " ".join(map(str, ids)), " ".join(self.merges.token[i] for i in ids)

    def learn(self, words: set[str]) -> None:
        """Look up all words of a batch at once."""
        if len(self.known) > self.remembered:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        places = self.lexicon.places([w.encode("utf-8", "surrogateescape") for w in new])
        for w, p in zip(new, places.tolist()):
            self.known[w] = self._entry(self.lexicon.sequence(p) if p >= 0 else self.merges.ids(w))

    def texts(self, texts: list[str | None]):
        """(n, ids as decimal text, decoded text) of each."""
        split = [self.splitter.words(t or "") for t in texts]
        self.learn({w for ws in split for w in ws})
        for words in split:
            got = [e for e in map(self.known.__getitem__, words) if e[0]]
            yield sum(e[0] for e in got), " ".join([e[1] for e in got]), " ".join([e[2] for e in got])


def code_documents(docs: DataFrame, *, vocabulary: str | None = None, lexicon_words: int = 60_000, with_texts: bool = True) -> DataFrame:
    """Each document's ids and their decoding: doc_id, n_tokens, ids_text, decoded, ids_sha256, decoded_sha256.

    docs: doc_id, text. ids_text has the decimal ids joined by one blank, decoded what the library's
    decode(ids, skip_special_tokens=False) gives (both null unless with_texts); the digests are of
    their UTF-8 bytes. Null and empty texts have no ids. Every row gives one row, repeated ones too; a null
    doc_id stays null; an empty table gives none; other columns are not read. The lexicon only
    decides which words are looked up and which are merged, never the ids.
    """
    vocabulary = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    ship(spark)
    name = publish(spark, frequent_words(docs, vocabulary, lexicon_words), vocabulary)

    def run(batches):
        coder = Coder(Transducer.load(SparkFiles.get(name)), vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                n, ids, decoded = zip(*coder.texts(part.column(1).to_pylist()))
                sha = [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in v], pa.string()) for v in (ids, decoded)]
                whole = [pa.array(v if with_texts else [None] * len(n), pa.string()) for v in (ids, decoded)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *whole, *sha], names=["doc_id", "n_tokens", "ids_text", "decoded", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_text string, decoded string, ids_sha256 string, decoded_sha256 string"
    return columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def op8(spark, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded; see code_documents."""
    return code_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_texts=False).drop("ids_text", "decoded")
