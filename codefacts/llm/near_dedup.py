"""Near-duplicate documents by consistent weighted sampling over TF-IDF word shingles.

A text is the weighted set of its five-word shingles. A weight is (1 + ln tf) times a damped inverse
document frequency between 1 and 1 + DAMP, read from a count-min sketch over all distinct texts whose noise
stays under a NOISE-th of them: what a thousandth of the texts or fewer hold counts fully. Improved consistent weighted sampling
draws `bands` times `rows` samples, of which two texts agree on each with the probability of their
weighted Jaccard similarity; equal bands make buckets. In a bucket every text is verified, exactly,
against the bucket's leader, the member that shares most buckets with other texts. Links join texts
to components. Of one leader's members, those outside its largest component are then compared with all
that are in other components, block by block: a product of matrices bounds every overlap from above, pairs that the
bound leaves are verified exactly, and only links come out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, cut, in_parts, ship, small, wide_hash
from .components import components
from .wordbpe import Memo

WORD = re.compile(r"[^\W_]+")
U = np.uint64
DEPTH, FAN_IN = 2, 32
DAMP, RARE, NOISE = 0.25, 1000.0, 1500.0
#: Texts in a block when members of one leader are compared with one another.
BLOCK = 128


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; the same everywhere."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class Shingler:
    def __init__(self, words: int = 5):
        self.n = words
        self.hash = Memo(lambda w: xxhash.xxh64_intdigest(w), 50_000)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingles (hashes) of the lower-case words, and how often each occurs; fewer words make one shingle."""
        found = WORD.findall(text.lower())
        if not found:
            return np.empty(0, U), np.empty(0, np.int64)
        h = np.fromiter(map(self.hash.__getitem__, found), U, len(found))
        n = min(self.n, len(h))
        out = np.full(len(h) - n + 1, n, U)
        with np.errstate(over="ignore"):
            for k in range(n):
                out = (out ^ h[k : k + len(out)]) * U(0x9E3779B97F4A7C15)
                out ^= out >> U(32)
        return np.unique(mix(out), return_counts=True)


def cells(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [(keys * U(m) >> U(64 - bits)).astype(np.int64) for m in (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)[:DEPTH]]


def distinct_texts(hashed: DataFrame) -> DataFrame:
    """(h, text): each text of hashed(doc_id, text, h) once, from the row of its least doc_id (and as often as that row is repeated). Only hashes are shuffled while the repeated ones are few."""
    known = hashed.where("h is not null")
    repeated = known.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("_least")).where("n > 1")
    repeated = small(cut(repeated.select(F.col("h").alias("_h"), "_least")))
    return known.join(repeated, known["h"] == repeated["_h"], "left").where(F.col("_h").isNull() | F.col("doc_id").eqNullSafe(F.col("_least"))).select("h", "text")


def document_frequencies(docs: DataFrame, words: int = 5) -> tuple[int, np.ndarray]:
    """(texts, count-min sketch of the number of texts that hold a shingle), over every text of docs(text).

    The sketch is as wide as NOISE times the shingles of a mean text, so that noise stays under a NOISE-th of the texts
    however many they are (2**23 cells at most). Each task adds up its own sketch; levels of FAN_IN tasks add up the tasks'; the sums of
    64 ranges of cells come to the driver, whatever the input.
    """
    mean = docs.agg(F.avg(F.length("text"))).first()[0] or 0.0
    bits = int(np.clip(np.ceil(np.log2(NOISE * (mean / 6 + 1))), 16, 23))
    parts, size = 64, DEPTH << bits

    def run(batches):
        from pyspark import TaskContext

        shingle, counts, n, wait = Shingler(words), np.zeros((DEPTH, 1 << bits), np.int32), 0, []

        def add():
            for d, at in enumerate(cells(np.concatenate([np.empty(0, U), *wait]), bits)):
                np.add.at(counts[d], at, np.int32(1))
            wait.clear()

        held = 0
        for b in in_parts(batches):
            for text in b.column(0).to_pylist():
                wait.append(shingle(text)[0])
                n, held = n + 1, held + len(wait[-1])
                if held > 1 << 18:
                    held = 0
                    add()
        add()
        if n:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([task] * parts, pa.int32()), pa.array([n] * parts, pa.int64()), pa.array([c.tobytes() for c in counts.reshape(parts, -1)], pa.binary())], names=["part", "task", "n", "counts"])

    def total(table: pa.Table) -> pa.Table:
        out, n = np.zeros(size // parts, np.int64), 0
        for k, c in zip(table.column("n").to_pylist(), table.column("counts").to_pylist()):
            out, n = out + np.frombuffer(c, np.int32 if len(c) == size // parts * 4 else np.int64), n + k
        return pa.table({"part": table.column("part").slice(0, 1), "task": table.column("task").slice(0, 1), "n": pa.array([n], pa.int64()), "counts": pa.array([out.tobytes()], pa.binary())})

    schema = "part int, task int, n long, counts binary"
    sums = cut(docs.mapInArrow(run, schema))
    many = (sums.agg(F.max("task")).first()[0] or 0) + 1
    while many > 1:  # a level: what up to FAN_IN tasks found becomes one
        sums = sums.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("part", "task").applyInArrow(total, schema)
        many = -(-many // FAN_IN)
    sketch, documents = np.zeros(size, np.int64).reshape(parts, -1), 0
    for r in sums.collect():
        sketch[r.part], documents = np.frombuffer(r.counts, np.int32 if len(r.counts) == size // parts * 4 else np.int64), r.n
    return documents, sketch.reshape(DEPTH, -1)


class Weights:
    """Shingle weights by term and document frequency."""

    def __init__(self, documents: int, sketch: np.ndarray, words: int = 5):
        self.idf = np.empty(sketch.shape, np.float32)
        for at in range(0, sketch.shape[1], 1 << 16):  # a range of cells at a time: the table may have millions
            top = np.log(max(documents, 1) / np.maximum(sketch[:, at : at + (1 << 16)], 1)) / np.log(RARE)
            self.idf[:, at : at + (1 << 16)] = 1 + DAMP * np.clip(top, 0, 1)
        self.shingle, self.bits = Shingler(words), int(np.log2(sketch.shape[1]))

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        keys, tf = self.shingle(text)
        # the smallest count of a shingle's cells is its largest idf
        idf = np.max([self.idf[d][at] for d, at in enumerate(cells(keys, self.bits))], axis=0) if len(keys) else np.empty(0, np.float32)
        return keys, ((1 + np.log(tf)) * idf).astype(np.float32)


def weighted_jaccard(a: tuple, b: tuple) -> float:
    """Similarity of two weighted sets with sorted keys."""
    (ka, wa), (kb, wb) = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    if not len(ka):
        return 0.0
    at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    same = kb[at] == ka
    over = float(np.minimum(wa[same], wb[at[same]]).sum(dtype=np.float64))
    return over / (float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - over)


def gamma_table() -> np.ndarray:
    """4096 quantiles of the gamma distribution with shape 2."""
    p, x = (np.arange(4096) + 0.5) / 4096, np.full(4096, 1.0)
    for _ in range(60):  # Newton's rule on 1 - (1 + x) exp(-x) = p
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-12), 1e-6)
    return x.astype(np.float32)


def samples(keys: np.ndarray, weights: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """k consistent weighted samples, as hashes, of each of the sets that begin at starts (none empty).

    For element x and sample i, r is drawn from gamma(2), b uniformly, c from gamma(2), all from a hash of (x, i).
    t = floor(ln w / r + b); the element with the least ln c - r (t - b + 1) is drawn, with its t; of equal
    ones the first.
    """
    n, table, log_w = len(keys), gamma_table(), np.log(weights).astype(np.float32)
    sizes = np.diff(np.append(starts, n))
    out = np.empty((len(starts), k), U)
    h, low = np.empty(n, U), np.empty(n, U)
    own = mix(np.arange(1, k + 1, dtype=U)) | U(1)
    scale = np.float32(2**-16)
    for i in range(k):
        with np.errstate(over="ignore"):
            np.multiply(keys, own[i], out=h)
            np.right_shift(h, U(29), out=low)
            np.bitwise_xor(h, low, out=h)
            np.multiply(h, U(0x94D049BB133111EB), out=h)
        np.right_shift(h, U(32), out=low)
        np.bitwise_xor(h, low, out=h)
        high, lower = low.astype(np.uint32).view(np.int32), h.astype(np.uint32).view(np.int32)
        r = table[(high >> 20) & 0xFFF]
        b = (high & 0xFFFFF).astype(np.float32)
        b *= np.float32(2**-20)
        u = (lower & 0xFFFF).astype(np.float32)
        u += np.float32(0.5)
        u *= scale
        v = ((lower >> 16) & 0xFFFF).astype(np.float32)
        v += np.float32(0.5)
        v *= scale
        u *= v
        np.log(u, out=u)
        np.negative(u, out=u)
        np.log(u, out=u)
        t = log_w / r
        t += b
        np.floor(t, out=t)
        np.subtract(t, b, out=b)
        b += 1
        b *= r
        u -= b
        least = np.flatnonzero(u == np.repeat(np.minimum.reduceat(u, starts), sizes))
        won = least[np.searchsorted(least, starts)]
        out[:, i] = mix(keys[won] ^ mix(t[won].astype(np.int64).astype(U)))
    return out


def signatures(docs: DataFrame, weights, bands: int, rows: int, words: int) -> DataFrame:
    """(h, buckets array<long>) of each text(h, text) that has a word."""

    def run(batches):
        of = Weights(*weights.value, words)
        for b in in_parts(batches):
            wait: list[tuple] = []

            def flush():
                sizes = np.array([len(k) for _, k, _ in wait])
                s = samples(np.concatenate([k for _, k, _ in wait]), np.concatenate([w for *_, w in wait]), np.cumsum(sizes) - sizes, bands * rows)
                key = np.zeros((len(wait), bands), U)
                for j in range(rows):
                    key = mix(key ^ s[:, j::rows])
                key = mix(key ^ mix(np.arange(1, bands + 1, dtype=U))[None]).astype(np.int64)
                flat = pa.ListArray.from_arrays(np.arange(0, key.size + 1, bands, dtype=np.int32), pa.array(key.ravel()))
                out = pa.RecordBatch.from_arrays([pa.array([h for h, *_ in wait], pa.binary()), flat], names=["h", "buckets"])
                wait.clear()
                return out

            held = 0
            for h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys, w = of(text)
                if len(keys):
                    wait.append((h, keys, w))
                    held += len(keys)
                if held > 50_000:
                    held = 0
                    yield flush()
            if wait:
                yield flush()

    return docs.mapInArrow(run, "h binary, buckets array<long>")


def verified(pairs: DataFrame, texts: DataFrame, weights, words: int, similarity: float) -> DataFrame:
    """(a, b) of the pairs(a, b) of text hashes whose weighted Jaccard similarity, taken exactly, is at least `similarity`."""
    one, two = texts.select(F.col("h").alias("a"), F.col("text").alias("ta")), texts.select(F.col("h").alias("b"), F.col("text").alias("tb"))

    def run(batches):
        of = Weights(*weights.value, words)
        held: dict[bytes, tuple] = {}

        def vector(h, text):
            if h not in held:
                if len(held) > 256:
                    held.clear()
                held[h] = of(text)
            return held[h]

        for t in in_parts(batches):
            a, b, ta, tb = (t.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))
            alike = [weighted_jaccard(of(tx), vector(y, ty)) >= similarity for y, tx, ty in zip(b, ta, tb)]
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], names=["a", "b"]).filter(pa.array(alike, pa.bool_()))

    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb")
    return joined.mapInArrow(run, "a binary, b binary")


def links_in_block(h: list, component: list, left: np.ndarray, right: np.ndarray, vectors: list[tuple], similarity: float) -> list[tuple]:
    """(a, b) of the pairs of a left and a right text, in different components, that are alike.

    The sum of sqrt(w_a w_b) over common shingles is no less than their overlap, the sum of min(w_a, w_b).
    """
    sizes = np.array([float(w.sum(dtype=np.float64)) for _, w in vectors])
    all_keys, counts = np.unique(np.concatenate([k for k, _ in vectors]), return_counts=True)
    shared = all_keys[counts > 1]
    bound = np.zeros((len(left), len(right)), np.float32)
    at = [(p := np.searchsorted(shared, k)) * (p < len(shared)) for k, _ in vectors] if len(shared) else []
    for first in range(0, len(shared), 4096):
        width = min(4096, len(shared) - first)
        m = np.zeros((len(vectors), width), np.float32)
        for row, ((k, w), p) in enumerate(zip(vectors, at)):
            ok = (shared[p] == k) & (p >= first) & (p < first + width)
            m[row, p[ok] - first] = np.sqrt(w[ok])
        bound += m[left] @ m[right].T
    needed = (sizes[left][:, None] + sizes[right][None]) * (similarity / (1 + similarity)) * (1 - 1e-4)
    apart = np.array(component)[left][:, None] != np.array(component)[right][None]
    return [(h[left[i]], h[right[j]]) for i, j in zip(*np.nonzero((bound >= needed) & apart)) if weighted_jaccard(vectors[left[i]], vectors[right[j]]) >= similarity]


def members_in_blocks(members: DataFrame) -> DataFrame:
    """members(leader, h, component), once for each block they meet: leader, i, j, among, h, component, own.

    Only pairs in different components can be links that are still open. So the members outside a leader's largest
    component, the strays, are dealt into blocks; each meets the other strays' blocks (among: true) and the blocks of the
    largest component (among: false). With n members the rows grow as n times the blocks of strays, at most BLOCK rows a side.
    """
    sizes = members.groupBy("leader", "component").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.groupBy("leader").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    most = most.select("leader", F.col("main.component").alias("main"), blocks(F.col("n") - F.col("main.n")).alias("strays"), blocks(F.col("main.n")).alias("rest"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    own = members.join(most, "leader").withColumn("stray", F.col("component") != F.col("main"))
    own = own.withColumn("own", F.pmod(F.xxhash64("h"), F.when(F.col("stray"), F.col("strays")).otherwise(F.col("rest"))).cast("int"))
    meet = lambda i, j, among: F.struct(i.alias("i"), j.alias("j"), F.lit(among).alias("among"))
    mine = F.col("own")
    of_stray = F.concat(F.transform(every(F.col("strays")), lambda k: meet(F.least(k, mine), F.greatest(k, mine), True)), F.transform(every(F.col("rest")), lambda k: meet(mine, k, False)))
    of_main = F.transform(every(F.col("strays")), lambda k: meet(k, mine, False))
    return own.select("leader", "h", "component", "own", "stray", F.explode(F.when(F.col("stray"), of_stray).otherwise(of_main)).alias("x")).select("leader", "x.*", "h", "component", "own", "stray")


def links_among_members(members: DataFrame, texts: DataFrame, weights, words: int, similarity: float) -> DataFrame:
    """(a, b) of the alike pairs among members(leader, h, component) of one leader that are in different components."""
    keyed = members_in_blocks(members).join(texts, "h")
    made: list[Weights] = []  # once a task, not once a group: the table of weights has millions of cells

    def run(key, t):
        if not made:
            made.append(Weights(*weights.value, words))
        of = made[0]
        h, component = (t.column(c).to_pylist() for c in ("h", "component"))
        own, stray = (np.array(t.column(c).to_pylist()) for c in ("own", "stray"))
        vectors = [of(x) for x in t.column("text").to_pylist()]
        i, j, among = (k.as_py() for k in key[1:])
        left, right = (np.flatnonzero(own == i), np.flatnonzero(own == j)) if among else (np.flatnonzero(stray), np.flatnonzero(~stray))
        got = links_in_block(h, component, left, right, vectors, similarity) if len(left) and len(right) else []
        a, b = zip(*got) if got else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    found = keyed.groupBy("leader", "i", "j", "among").applyInArrow(run, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicate_classes(docs: DataFrame, *, similarity: float = 0.8, words: int = 5, bands: int = 16, rows: int = 4) -> DataFrame:
    """Each document's class: doc_id, class_id, n_links (links of its text that were verified), kept.

    docs: doc_id, text. class_id is the least doc_id of the class. Equal texts are one class; different texts
    are linked when the weighted Jaccard similarity of their shingles is at least `similarity`, and classes are
    the connected components. kept is true for the row whose doc_id is class_id: one text of each class (and as
    often as that row is repeated). A text of fewer words is one shingle; texts without a word are alike only if equal. A null text
    belongs to no class but its own document's. A null doc_id never names a class that has other ids.
    Very long texts are read whole; equal similarities need no order. An empty table gives no rows; other columns are not
    read. 128-bit hashes stand for texts.
    """
    spark = docs.sparkSession
    ship(spark)
    hashed = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", wide_hash("text").alias("h"))
    texts = distinct_texts(hashed)
    weights = spark.sparkContext.broadcast(document_frequencies(texts.select("text"), words))

    signed = cut(signatures(texts, weights, bands, rows, words).dropDuplicates(["h"]))
    member = signed.select("h", F.explode("buckets").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = cut(member.join(shared, "bucket"))
    popular = member.groupBy("h").agg(F.sum("n").alias("popular"))
    ranked = member.select("h", "bucket").join(popular, "h").select("bucket", F.struct("popular", "h").alias("rank"))
    leaders = ranked.groupBy("bucket").agg(F.max("rank").alias("rank")).select("bucket", F.col("rank.h").alias("leader"))
    led = cut(member.select("h", "bucket").join(leaders, "bucket"))
    pairs = cut(led.where("h <> leader").select(F.col("h").alias("a"), F.col("leader").alias("b")).distinct())
    wanted = led.select("h").distinct()
    # whole texts of those that share a bucket with another, once each
    held = cut(texts.join(wanted, "h", "left_semi").dropDuplicates(["h"]))
    links = cut(verified(pairs, held, weights, words, similarity))
    grouped = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))

    # what one leader a bucket leaves open: its members in different components
    members = pairs.select(F.col("a").alias("h"), F.col("b").alias("leader")).join(grouped.select(F.col("node").alias("h"), "component"), "h", "left")
    members = cut(members.select("leader", "h", F.coalesce("component", "h").alias("component")))
    links = cut(links.unionByName(links_among_members(members, held, weights, words, similarity)))
    grouped = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    degree = links.select(F.explode(F.array("a", "b")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n_links"))
    ids = hashed.where("h is not null").groupBy("h").agg(F.min("doc_id").alias("least"))
    ids = ids.join(grouped.select(F.col("node").alias("h"), "component"), "h", "left").join(degree, "h", "left").withColumn("component", F.coalesce("component", "h"))
    named = ids.groupBy("component").agg(F.min("least").alias("class_id"), F.min(F.struct(F.col("least").isNull().alias("none"), "least", "h")).alias("first"))
    classes = ids.join(named, "component").select("h", "class_id", F.col("first.h").alias("first"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = hashed.select("doc_id", "h").join(classes, "h", "left")
    class_id = F.when(F.col("h").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    kept = F.col("h").isNull() | (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("h") == F.col("first")))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), kept.alias("kept"), F.col("h").alias("text_hash"))


def op5(spark, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates; see near_duplicate_classes."""
    return near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")
