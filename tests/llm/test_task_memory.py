"""What the tasks of the pipeline's Python stages hold does not grow with a batch, nor with the number of languages."""

import itertools
import random
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from codefacts.llm import language_id, near_dedup, packing


class Taken(Exception):
    """Carries the function that a plan would have run in its tasks."""


class Table:
    """A table of which every step is itself, up to the first function that would run in tasks."""

    sparkSession = None

    def __getattr__(self, name):
        return lambda *args, **named: self

    def first(self):
        return [1500.0]

    def mapInArrow(self, function, schema):
        raise Taken(function)


class Value:
    value = (4000, np.ones((2, 1 << 16), np.int64))


CALLS = {
    "count": (language_id, lambda: language_id.fit(Table()), ["text", "lang"]),
    "sketch": (near_dedup, lambda: near_dedup.document_frequencies(Table()), ["text"]),
    "sign": (near_dedup, lambda: near_dedup.signatures(Table(), Value, 16, 1, 5), ["id", "text"]),
    "pack": (packing, lambda: packing.pack_documents(Table(), with_ids=True), ["id", "text"]),
}


@pytest.mark.parametrize("name", CALLS)
def test_a_task_holds_few_texts_of_a_batch(spark, monkeypatch, name):
    module, call, wanted = CALLS[name]
    monkeypatch.setattr(module, "ship", lambda spark: None)
    if hasattr(module, "columns"):
        monkeypatch.setattr(module, "columns", lambda df, *names: df)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": staticmethod(lambda: 0)}))
    with pytest.raises(Taken) as taken:
        call()
    function = taken.value.args[0]
    rnd = random.Random(1)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=7)) for _ in range(3000)]
    parts = [" ".join(rnd.choices(words, k=45)) for _ in range(200)]
    texts = [" ".join(rnd.choices(parts, k=4)) for _ in range(4000)]
    ids = pa.array(range(len(texts)), pa.int64()) if name == "pack" else pa.array([str(k).encode() for k in range(len(texts))], pa.binary())
    whole = pa.RecordBatch.from_arrays([ids, pa.array(texts), pa.array([f"l{k % 7}" for k in range(len(texts))])], names=["id", "text", "lang"]).select(wanted)
    del texts
    list(function(iter([whole.slice(0, 20)])))  # what is loaded once
    peak = largest = 0
    tracemalloc.start()
    try:
        for b in function(iter([whole])):
            peak, largest = max(peak, tracemalloc.get_traced_memory()[1]), max(largest, b.nbytes)
    finally:
        tracemalloc.stop()
    print(name, peak / 1e6, largest / 1e6)
    assert peak < BOUND_MB[name] * 1e6 and largest < 8e6


BOUND_MB = {"count": 16, "sketch": 20, "sign": 6, "pack": 22}


def test_counts_over_many_languages_are_whole_and_bounded():
    rnd = random.Random(2)
    rows = [("".join(rnd.choices("abcdefgh ", k=200)), f"l{k % 50}") for k in range(1500)]
    want = Counter((lang, f) for text, lang in rows for f in language_id.features(text).tolist())
    got, times = Counter(), 0
    for _, run in itertools.groupby(enumerate(language_id.counted(iter(rows), at_once=2000, most=20_000)), lambda x: x[0] // 50):
        for _, (lang, f, n) in run:
            got.update({(lang, x): m for x, m in zip(f.tolist(), n.tolist())})
            times += 1
    assert got == want and times > 50
    assert list(language_id.counted(iter([]))) == []


def test_texts_are_judged_alike_alone_and_together(monkeypatch):
    rng = np.random.default_rng(3)
    model = language_id.Filters(["a", "b", "c"], 0, [rng.integers(0, 8, 1 << 12).astype(np.uint64)])
    rnd = random.Random(3)
    texts = ["".join(rnd.choices("abcdefgh ", k=rnd.choice((0, 1, 30, 3000)))) for _ in range(300)] + [None, "1 2", "x" * 100_000, ""]
    seen, decide = [], language_id.Filters.decide
    monkeypatch.setattr(language_id.Filters, "decide", lambda self, part: seen.append([len(t or "") for t in part]) or decide(self, part))
    got = language_id.judge(model, pd.Series(texts, dtype=object))
    assert [tuple(r) for r in got.astype(object).where(got.notna(), None).itertuples(index=False)] == [decide(model, [t])[0] for t in texts]
    assert all(sum(part) <= language_id.AT_ONCE or len(part) == 1 for part in seen)
    assert language_id.judge(model, pd.Series([], dtype=object)).columns.tolist() == ["lang", "score", "coverage"]
