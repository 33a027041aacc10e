"""Searches and shards against brute force."""

import numpy as np
import pytest

from codefacts.llm import ann_codes, exact_topk, hilbert_shards
from tests.conftest import SF, as_rows

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def odd_vectors(spark, tmp_path_factory):
    """A table with every kind of bad vector, ties and repeated rows, written as the query reads it."""
    rnd = np.random.default_rng(5)
    rows = [(k, rnd.normal(size=8).astype("float32").tolist()) for k in range(230)]
    rows[30:60] = [(k, rows[7][1]) for k in range(30, 60)]  # one very common vector
    rows += [(300, None), (400, []), (500, [None] * 8), (600, [NAN] * 8), (700, [INF] * 8), (800, [0.0] * 8), (900, [1.0, 2.0]), (1000, [2.0, 1.0]), (None, rows[3][1]), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, id string").repartition(3)
    path = str(tmp_path_factory.mktemp("vectors"))
    df.write.parquet(f"{path}/embeddings.parquet")
    good = {i: v for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    return path, good


def brute(good, every, k, scale, skip_zero):
    out = []
    use = {i: (np.floor(1024 * np.array(v, np.float64)) if scale else np.array(v, np.float64)) for i, v in good.items() if not (skip_zero and not any(v))}
    for q, x in use.items():
        if q % every == 0:
            best = sorted(((-float(x @ y), c) for c, y in use.items() if c != q and len(y) == len(x)))[:k]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    return sorted(out)


def test_exact_query_equals_sql(spark, tables):
    assert as_rows(exact_topk.op4(spark, SF).toPandas()) == as_rows(tables.sql(exact_topk.OP4_SQL).df())


def test_exact_on_odd_vectors(spark, odd_vectors):
    path, good = odd_vectors
    got = sorted(map(tuple, exact_topk.op4(spark, path).collect()))
    assert got == brute(good, 100, 10, True, False)


def test_exact_in_blocks_and_empty(spark, odd_vectors):
    path, good = odd_vectors
    v = spark.read.parquet(f"{path}/embeddings.parquet").where("vec_id < 230").selectExpr("vec_id as id", "transform(embedding, x -> cast(floor(cast(x as double) * 1024) as long)) as vector")
    got = exact_topk.exact_top_k(v, v, 3, most_candidates=40, most_queries=50).collect()
    want = brute({i: x for i, x in good.items() if i < 230}, 1, 3, True, False)
    assert sorted(map(tuple, got)) == want
    assert exact_topk.exact_top_k(v.limit(0), v.limit(0), 3).count() == 0
    assert exact_topk.exact_top_k(v, v.limit(0), 3).count() == 0


def test_exact_over_ranges_of_length(spark):
    rnd = np.random.default_rng(4)
    x = np.floor(1024 * rnd.normal(size=(2500, 8)) * np.geomspace(1, 0.01, 2500)[:, None]).astype(int)
    x[900:1700] = x[900]  # a third of all rows are one vector
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000 + k, [7, k]) for k in range(5)]
    v = spark.createDataFrame(rows, "id long, vector array<long>")
    ends = exact_topk.length_ranges(v.selectExpr("sqrt(aggregate(vector, 0D, (a, x) -> a + x * x)) as length"), len(rows), 512)
    assert len(ends) >= 1 and ends == sorted(ends, reverse=True)
    got = exact_topk.exact_top_k(v, v.where("id % 25 = 0"), 10, most_candidates=300, most_queries=40).collect()
    want = []
    for q, a in rows:
        if q % 25 == 0:
            best = sorted((-int(np.dot(a, b)), c) for c, b in rows if c != q and len(a) == len(b))[:10]
            want += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_exact_with_large_numbers():
    rnd = np.random.default_rng(1)
    c, q = rnd.integers(-(2**27), 2**27, (300, 6)), rnd.integers(-(2**27), 2**27, (5, 6))
    ids, qid = np.arange(300), np.arange(1000, 1005)
    got = exact_topk.search_block(ids, c, qid, q, np.eye(6), 3, 4)
    for n, x in enumerate(q):
        best = sorted((-int(s), int(i)) for s, i in zip(c @ x, ids))[:4]
        assert [(int(-s), int(i)) for a, i, s in zip(*got) if a == 1000 + n] == best


def test_search_prunes():
    rnd = np.random.default_rng(2)
    c = rnd.normal(size=(4000, 16)) * np.linspace(3, 0.05, 16)
    c = np.floor(1024 * c).astype(np.int64)
    axes = np.linalg.eigh(c.T.astype(float) @ c)[1][:, ::-1]
    a = exact_topk.search_block(np.arange(4000), c, np.array([9]), c[9:10], axes, 4, 10)
    b = exact_topk.search_block(np.arange(4000), c, np.array([9]), c[9:10], np.eye(16), 16, 10, step=4000)
    assert a[1].tolist() == b[1].tolist() and a[2].tolist() == b[2].tolist()
    counts = {}
    exact_topk.search_block(np.arange(4000), c, np.arange(0, 4000, 40), c[::40], axes, 8, 10, counts=counts)
    assert counts["pairs"] == 400_000 and counts["scored"] < 0.2 * counts["pairs"]
    floor = np.full(100, 1e12)
    assert len(exact_topk.search_block(np.arange(4000), c, np.arange(0, 4000, 40), c[::40], axes, 4, 10, floor=floor)[0]) == 0


def test_ann_recall_and_scores(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    good = dict(zip(vectors.vec_id, vectors.embedding))
    got = ann_codes.op6(spark, SF).toPandas()
    want = brute({int(i): list(v) for i, v in good.items()}, 20, 20, False, True)
    pairs = {(q, c) for q, _, c, _ in want}
    assert len(pairs & set(zip(got.query_id, got.vec_id))) / len(pairs) >= 0.95
    for r in got.sample(100, random_state=1).itertuples():
        assert np.isclose(r.score, np.array(good[r.query_id], float) @ np.array(good[r.vec_id], float), rtol=0, atol=1e-12)
    assert (got.sort_values(["query_id", "rank"]).groupby("query_id").score.diff().dropna() <= 0).all()


def test_ann_on_odd_vectors(spark, odd_vectors):
    path, good = odd_vectors
    got = ann_codes.op6(spark, path).toPandas()
    want = brute(good, 20, 20, False, True)
    assert len(got) == len(want) and 800 not in set(got.query_id) | set(got.vec_id)
    pairs = {(q, c) for q, _, c, _ in want}
    assert len(pairs & set(zip(got.query_id, got.vec_id))) / len(pairs) >= 0.95
    v = spark.read.parquet(f"{path}/embeddings.parquet").selectExpr("vec_id as id", "embedding as vector")
    assert ann_codes.nearest(v.limit(0), v.limit(0), 3).count() == 0


def test_code_estimates_are_unbiased():
    rnd = np.random.default_rng(3)
    x, q = rnd.normal(size=(3000, 64)), rnd.normal(size=64)
    turn = ann_codes.rotation(64)
    bits, length, fit = ann_codes.encode(x, x.mean(0), turn)
    signs = (np.unpackbits(bits, axis=1, count=64) * 2.0 - 1) / 8
    error = (signs @ (q @ turn)) * length / fit + q @ x.mean(0) - x @ q
    bound = np.linalg.norm(q) * length * np.sqrt(1 - fit**2) / fit / np.sqrt(63)
    assert abs(error.mean()) < 0.2 and 0.93 < np.mean(np.abs(error) <= 2 * bound) < 0.98


def test_hilbert_curve_visits_neighbours():
    for n, bits in ((2, 4), (3, 3)):
        grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij")).reshape(n, -1)
        at = hilbert_shards.hilbert_index([*grid], bits)
        assert sorted(at.tolist()) == [*range(1 << bits * n)]
        assert np.abs(np.diff(grid[:, np.argsort(at)], axis=1)).sum(0).max() == 1


def check_shards(got, docs):
    import zlib

    assert len(got) == len(docs)
    sizes = got.groupby("shard")["size"].sum().reindex(range(8), fill_value=0)
    assert got["size"].sum() == sum(len((t or "").encode()) + 1 for _, t in docs)
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == [*range(len(g))]
    if None not in [i for i, _ in docs] and len({i for i, _ in docs}) == len(docs):
        by_id = dict(docs)
        for r in got.itertuples():
            raw = (by_id[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    return sizes


def test_shards_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    got = hilbert_shards.op7(spark, SF).toPandas()
    sizes = check_shards(got, [*docs.itertuples(index=False, name=None)])
    assert sizes.max() - sizes.min() <= 2 * got["size"].max()
    together = got.merge(docs, on="doc_id").groupby("text").agg(shards=("shard", "nunique"), total=("size", "sum"))
    assert (together[together.total <= got["size"].max()].shards == 1).all()


def test_shards_odd_tables(spark, tmp_path):
    rows = [(k, f"text {k % 7} " * (k % 5), None if k % 4 == 0 else "en", f"s{k % 3}", "clash") for k in range(300)]
    rows += [(None, "none", None, None, "x"), (7, rows[7][1], "en", "s1", "x"), (1000, None, "é", "ü", "x"), (1001, "", "é", None, "x"), (1002, "é" * 20, None, None, "x")]
    rows += [(2000 + k, "a hot copy", "de", f"s{k}", "x") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, slot string")
    got = hilbert_shards.hilbert_shards(df).toPandas()
    sizes = check_shards(got, [(r[0], r[1]) for r in rows])
    assert sizes.max() <= 1.2 * sizes.mean()
    assert hilbert_shards.hilbert_shards(df.limit(0)).count() == 0
    hilbert_shards.write_shards(df, str(tmp_path / "out"))
    written = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(repr, written.select(*df.columns).collect())) == sorted(map(repr, df.collect()))
    clash = df.withColumnRenamed("slot", "Shard").unionByName(df.withColumnRenamed("slot", "Shard"))
    hilbert_shards.write_shards(clash, str(tmp_path / "again"))
    again = spark.read.parquet(str(tmp_path / "again"))
    assert again.count() == 2 * len(rows) and {"shard", "_Shard" if "_Shard" in again.columns else "_shard"} <= set(again.columns)


def test_bins_are_quantiles_of_whole_strings(spark, tmp_path):
    rows = [(k, f"{k:04}" + "t" * (7 * k % 1999), f"language{k % 11}", f"https://common.prefix/site{k % 9}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = hilbert_shards.hilbert_shards(df).toPandas().merge(df.toPandas(), on="doc_id")
    assert got.groupby("source").source_bin.nunique().max() == 1 and got.source_bin.nunique() == 9 and got.lang_bin.nunique() == 11 and got.size_bin.nunique() > 20
    assert got.sort_values("source").source_bin.is_monotonic_increasing
    for axis in ("lang_bin", "source_bin", "size_bin"):  # a reader of one value's rows skips shards by their range
        ranges = got.groupby("shard")[axis].agg(["min", "max"])
        read = [((ranges["min"] <= x) & (x <= ranges["max"])).sum() for x in sorted(got[axis].unique())]
        assert np.mean(read) <= 6, axis


def test_groups_are_cut_only_for_size(spark):
    rows = [(k, f"own text {k} of some length", "en", "s") for k in range(400)] + [(1000 + k, "a copy of some text here", "en", "s") for k in range(40)]
    hot = [(5000 + k, "the same text again and again", "en", "s") for k in range(400)]
    for table, cut in ((rows, False), (rows + hot, True)):
        got = hilbert_shards.hilbert_shards(spark.createDataFrame(table, "doc_id long, text string, lang string, source string")).toPandas()
        assert got.group_cut.any() == cut and not got[got.doc_id < 1000].group_cut.any()
        sizes = got.groupby("shard")["size"].sum()
        assert sizes.max() - sizes.min() <= sizes.mean() / 16 + 2 * got["size"].max()
