"""Encoders, packing and attribution against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from codefacts.llm import lexicon_bpe, packing, token_attribution
from codefacts.llm.wordbpe import UNSURE, LibraryWords, WordSplitter, default_vocabulary
from tests.conftest import SF

WORD, BYTE = default_vocabulary(), default_vocabulary("byte_bpe_50k.json")
ODD = [
    None, "", "   ", "\n\n", "Hello, WORLD!! it's 12½ ²x", "<|startoftext|>Ab<|endoftext|> <|ENDOFTEXT|>", "ΑΣ σς İstanbul ſ ﬁ é é", "a\x1cb\x85c\xa0d　e",
    "日本語 テキスト 한국어 ไทย हिन्दी", "🙂👍🏽 \U0001f9d1‍\U0001f4bb", "x" * 5000, "ab " * 4000, "don't we'll I'M", "￿ޱ߽ ͸", "\t lead\n\n\ntrail  ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "clash", 1) for k, t in enumerate(ODD)] + [(3, ODD[4], "again", 2), (None, "no id", "x", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, n_tokens int")


def test_splitter_agrees_over_code_points():
    s = WordSplitter(WORD)
    for c in range(1, 0x3000):
        if not UNSURE.match(chr(c)):
            for t in (f"ab{chr(c)}cd 1{chr(c)}\u0301 ", f"A'{chr(c)}RE_{chr(c)}{chr(c)}2"):
                assert s._by_library(t) == s.words(t), hex(c)


def test_splitter_agrees_on_mixtures(library):
    s, rnd = LibraryWords(WORD), random.Random(4)
    for _ in range(2000):
        t = "".join(rnd.choice(["a", "É", "ß", " ", "\n", "'s", "'RE", "_", "9", "½", "Σ", "\u0301", "日", "<|endoftext|>", "<|", "!", "\x1d", "\u2028"]) for _ in range(rnd.randrange(20)))
        assert [i for w in s.splitter.words(t) for i in s.ids(w)] == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_transducer_is_exact_and_minimal():
    words = {f"{a}{b}ing".encode(): [k, n] for k, a in enumerate(["s", "st", "", "z"]) for n, b in enumerate(["op", "and", "é"])}
    t = lexicon_bpe.Transducer.build([*words.items()])
    asked = [*words, b"", b"s", b"stop", b"stopings", b"q", "zé".encode()]
    got = [t.sequence(p) if p >= 0 else None for p in t.places(asked).tolist()]
    assert got == [words.get(w) for w in asked]
    assert len(t.final) < sum(map(len, words)) / 2  # suffixes are shared
    assert lexicon_bpe.Transducer.build([]).places([b"a"]).tolist() == [-1]


def test_transducer_equals_a_dictionary(tmp_path):
    rnd = random.Random(9)
    words = {bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 7))): [rnd.randrange(99) for _ in range(rnd.randrange(4))] for _ in range(400)}
    lexicon_bpe.Transducer.build([*words.items()]).save(str(tmp_path / "t"))
    t = lexicon_bpe.Transducer.load(str(tmp_path / "t"))
    asked = [bytes(rnd.choice(b"abcd") for _ in range(rnd.randrange(8))) for _ in range(2000)]
    assert [t.sequence(p) if p >= 0 else None for p in t.places(asked).tolist()] == [words.get(w) for w in asked]


def check_codes(rows, library):
    for r in rows:
        e = library.encode(r.text or "", add_special_tokens=False)
        assert r.n_tokens == len(e.ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("words", [0, 5, 60_000])
def test_codes_of_odd_texts(odd, library, words):
    got = lexicon_bpe.code_documents(odd, lexicon_words=words)
    assert got.count() == odd.count()
    want = {k: library.encode(t or "", add_special_tokens=False) for k, t in enumerate(ODD)}
    for r in got.collect():
        if r.doc_id is not None:
            e = want[r.doc_id]
            assert (r.n_tokens, r.ids_text, r.decoded) == (len(e.ids), " ".join(map(str, e.ids)), library.decode(e.ids, skip_special_tokens=False)) or r.doc_id == 3


def test_codes_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lexicon_bpe.op8(spark, SF).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    check_codes(rows, library)


def check_packing(pieces, texts, library, size=2048):
    """texts: rows of (doc_id, text) with distinct ids."""
    pieces = pieces.sort_values(["doc_id", "start"])
    for doc_id, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], np.uint32)
        own, at = pieces[pieces.doc_id == doc_id], 0
        for r in own.itertuples():
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.cumsum(g.length) - g.length).all() and g.length.sum() <= size


def test_packing_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    pieces = packing.op3(spark, SF).toPandas()
    check_packing(pieces, docs.itertuples(index=False), library)
    assert pieces.length.sum() / (2048 * pieces.sequence_id.nunique()) > 0.9


@pytest.mark.parametrize("open_windows", [1, 3])
def test_packing_odd_texts(spark, odd, library, open_windows):
    one = odd.where("sequence_id <> 'again' and doc_id is not null")
    pieces = packing.pack_documents(one.repartition(3), size=64, open_windows=open_windows, with_ids=True).toPandas()
    check_packing(pieces, [*enumerate(ODD)], library, 64)
    assert all(zlib.crc32(bytes(i)) == c for i, c in zip(pieces.ids, pieces.ids_crc32))
    again = packing.pack_documents(odd).toPandas()
    assert again.length.sum() == pieces.length.sum() + sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in (ODD[4], "no id"))
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_leftovers_of_many_tasks_meet(spark, library):
    texts = [(k, "word " * (1 + k % 23)) for k in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(70)
    pieces = packing.pack_documents(docs, open_windows=4).toPandas()
    check_packing(pieces, texts, library)
    n = pieces.length.sum()
    assert pieces.sequence_id.nunique() <= -(-n // 2048) + 2  # 70 tasks, 9 groups, 2 groups of groups, 1


def test_open_windows_are_bounded():
    w, rnd, live = packing.OpenWindows(100, 4), random.Random(1), set()
    for _ in range(500):
        n = rnd.randrange(1, 100)
        k, offset, closed = w.place(n)
        assert offset + n <= 100 and len(w.free) <= 4
        live.add(k)
        live -= set(closed)
    assert len(live) == len(w.free)


def test_spans_equal_the_library(spark):
    lib, s = Tokenizer.from_file(BYTE), token_attribution.SpanEncoder(BYTE)
    for t in [*(x or "" for x in ODD), "naïve 日本 a\n\n b  c\t", "tail   "]:
        assert s.spans(t).tolist() == [list(o) for o in lib.encode(t, add_special_tokens=False).offsets], repr(t)


def brute(spans, start, end, rule):
    n, outside = np.zeros(len(start)), 0.0
    for a, b in spans:
        over = [max(0, min(b, e) - max(a, s)) for s, e in zip(start, end)]
        if rule == "share":
            for j, o in enumerate(over):
                n[j] += o / (b - a)
            outside += (b - a - sum(over)) / (b - a)
        elif rule == "start":
            hit = [j for j, (s, e) in enumerate(zip(start, end)) if s <= a < e]
            n[hit] += 1
            outside += not hit
        else:
            best = max(range(len(over)), key=lambda j: (over[j], -j), default=None)
            if best is not None and over[best] and over[best] >= b - a - sum(over):
                n[best] += 1
            else:
                outside += 1
    return n, outside


@pytest.mark.parametrize("rule", ["most", "start", "share"])
def test_allocation_equals_brute_force(rule):
    rnd = random.Random(2)
    for _ in range(300):
        cuts = sorted(rnd.sample(range(60), 10))
        start, end = np.array(cuts[::2]), np.array(cuts[1::2])
        ends = sorted(rnd.sample(range(1, 61), 15))
        spans = np.array([*zip([0, *ends], ends)])
        n, _, outside = token_attribution.allocate(spans, start, end, rule)
        want, out = brute(spans, start, end, rule)
        assert np.allclose(n, want) and np.isclose(outside, out)


def test_attribution_query_and_odd_texts(spark, odd):
    lib = Tokenizer.from_file(BYTE)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    got = token_attribution.op1(spark, SF).toPandas()
    want = {r.doc_id: len(lib.encode(r.text).ids) for r in docs.itertuples()}
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == want
    assert got.groupby("doc_id").section_chars.sum().to_dict() == {r.doc_id: len(r.text) for r in docs.itertuples()}
    rows = token_attribution.attribute_tokens(odd, rule="share").toPandas()
    assert rows[rows.doc_id == 0][["section", "n_tokens"]].values.tolist() == [[0, 0.0]]
    assert np.isclose(rows[rows.doc_id == 8].n_tokens.sum(), len(lib.encode(ODD[8]).ids))
    spans = spark.createDataFrame([(1, "hello world", [(0, 3), (8, 11)])], "doc_id long, text string, parts array<struct<start:int,end:int>>")
    assert token_attribution.attribute_tokens(spans, sections="parts").orderBy("section").toPandas().n_tokens.tolist() == [1, 1]
    assert token_attribution.attribute_tokens(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        token_attribution.attribute_tokens(odd, rule="none")


def test_first_values_and_frequent_words(spark):
    rnd = random.Random(2)
    values = [rnd.choice([rnd.randrange(50), rnd.randrange(10**6), -rnd.randrange(2**50)]) for _ in range(800)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for most in (0, 1, 100, 799, 800, 5000):
        bound, n = lexicon_bpe.first_values(df, "v", most, parts=7)
        assert n == sum(v < bound for v in values) <= most and (n == len(values) or n + values.count(bound) > most)
    assert lexicon_bpe.first_values(df.limit(0), "v", 3) == (0, 0)
    texts = ["many many many many words words words here here now", "many here words", "single ones only once each"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert {*lexicon_bpe.frequent_words(df, WORD, 3)} == {"many", "words", "here"}
    assert len(lexicon_bpe.frequent_words(df, WORD, 6)) == 6 and len(lexicon_bpe.frequent_words(df, WORD, 99)) == 9


def test_spans_agree_over_code_points():
    encoder = token_attribution.SpanEncoder(BYTE)
    library = Tokenizer.from_file(BYTE)
    for c in range(1, 0x3000):
        if not UNSURE.match(chr(c)):
            t = f"ab{chr(c)}cd 1{chr(c)}\u0301 A'{chr(c)}re_{chr(c)}{chr(c)}2"
            assert encoder.spans(t).tolist() == [list(x) for x in library.encode(t, add_special_tokens=False).offsets], hex(c)


@pytest.mark.parametrize("rule", ["most", "start", "share"])
def test_any_sections_equal_brute_force(spark, rule):
    rnd, rows = random.Random(8), []
    for k in range(60):
        text = " ".join(rnd.choice(["token", "boundaries", "unbelievable", "x", "\n"]) for _ in range(12))
        given = [None if rnd.random() < 0.1 else (rnd.choice([None, 5]) if rnd.random() < 0.1 else (a := rnd.randrange(len(text))), a + rnd.randrange(-3, 25) if (a := rnd.randrange(len(text))) else 4) for _ in range(rnd.randrange(5))]
        rows.append((k, text, given))
    df = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<start int, end int>>")
    encoder, got = token_attribution.SpanEncoder(BYTE), {}
    for r in token_attribution.attribute_tokens(df, rule=rule, sections="parts").collect():
        got[r.doc_id, r.section] = (r.n_tokens, r.n_crossing)
    for k, text, given in rows:
        owner = [-1] * (len(text) + 40)
        for j in reversed(range(len(given))):
            x = given[j]
            if x and None not in x and x[0] < x[1]:
                owner[x[0] : x[1]] = [j] * (x[1] - x[0])
        want = {j: [0.0, 0] for j in range(-1, len(given))}
        for a, b in encoder.spans(text).tolist():
            here = owner[a:b]
            for j in {*here}:
                want[j][1] += j >= 0 and len({*here}) > 1
                if rule == "share":
                    want[j][0] += here.count(j) / (b - a)
            if rule == "start":
                want[here[0]][0] += 1
            elif rule == "most":
                want[max({*here}, key=lambda j: (here.count(j), j >= 0, -j))][0] += 1
        for j, (n, crossing) in want.items():
            if j >= 0 or n > 1e-9:
                assert abs(got[k, j][0] - n) < 1e-9 and got[k, j][1] == crossing, (k, j)
