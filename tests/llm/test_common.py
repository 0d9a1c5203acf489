import random

import pyarrow as pa
import pytest

from tidemark.llm import common, graph, words


def test_components_equal_union_find(spark, monkeypatch):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(50)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "u long, v long")
    for few in (graph.FEW, 10):
        monkeypatch.setattr(graph, "FEW", few)
        assert {r.node: r.root for r in graph.components(df).collect()} == want
    assert graph.components(df.limit(0)).count() == 0


def test_saved_tables_can_be_dropped(spark):
    df = common.saved(spark.range(3), "x")
    assert df.count() == 3
    path = spark.sparkContext._tidemark_paths[-1].removeprefix("file:")
    common.drop_saved(spark)
    import os

    assert not os.path.exists(path) and common.saved_paths(spark) == []
    (a, kept), (b, gone) = common.saved_at(spark.range(3), "x"), common.saved_at(spark.range(4), "y")
    common.drop_saved(spark, but=[kept])
    assert common.saved_paths(spark) == [kept] and a.count() == 3 and not os.path.exists(gone.removeprefix("file:"))
    common.drop_saved(spark)


def test_free_name(spark):
    assert common.free_name(spark.range(1).selectExpr("id as FP", "id as _fp"), "fp") == "__fp"


@pytest.mark.parametrize("chunk", [words.CHUNK, 50, 3])
def test_word_hashes(monkeypatch, chunk):
    """Equal for equal words in either case, different for others, however a batch is sliced and cut up."""
    monkeypatch.setattr(words, "CHUNK", chunk)
    monkeypatch.setattr(words, "_powers", {})
    rng, seen = random.Random(1), {}
    texts = [None, "", " ", "a", "A b", "ab  cd\n"] + ["".join(rng.choice("aBé \t\n漢x") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for batch in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(texts).slice(3, 100), pa.array(texts, pa.large_string()).slice(7, 200), pa.array([], pa.string())):
        found, bounds = words.hashes(batch)
        for i, t in enumerate(batch.to_pylist()):
            own = (t or "").encode().lower().split()
            assert bounds[i + 1] - bounds[i] == len(own)
            assert all(seen.setdefault(w, h) == h for w, h in zip(own, found[bounds[i] : bounds[i + 1]].tolist(), strict=True))
    assert len(set(seen.values())) == len(seen) > 300
