import pytest

from tidemark.llm import mixing


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if rest * w[s] / total > most * sizes[s] + 1e-9]
        if not over:
            return target | {s: rest * w[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
            free.discard(s)
            rest -= target[s]
    return target


def test_targets_and_taken(docs):
    rows = [(i, "w " * (1 + i % 7), "en", s) for i, s in enumerate(["a"] * 5 + ["b"] * 90 + ["c"] * 200 + ["é"] * 3 + [None] * 40 + ["Z"] * 10)]
    rows += [(500, None, "en", "a"), (501, "", "en", "b"), (3, "w w w w", "en", "a"), (None, "w w", "en", "b"), (600, "", "en", "empty")]
    got = mixing.plan(docs(*rows)).collect()
    assert len(got) == len(rows) and sorted(r.taken for r in got) == sorted(r.taken for r in mixing.plan(docs(*rows).repartition(7)).collect())
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = slow_targets(sizes)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    for s, target in want.items():
        key = (sizes[s], round(target, 6))
        assert key in by
        if sizes[s]:
            assert abs(sum(by[key]) - target) < 1
    assert sum(r.taken for r in got) == pytest.approx(sum(sizes.values()), abs=len(sizes))


@pytest.mark.parametrize("few", [mixing.FEW_SOURCES, 0])
def test_mix_gives_whole_copies(docs, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    rows = [(i, f"w{i} " * (2 + i % 3), "en", "a" if i < 10 else "b") for i in range(100)]
    got = mixing.mix(docs(*rows)).collect()
    words = {"a": 0, "b": 0}
    for r in got:
        words[r.source] += len(r.text.split())
    sizes = {s: sum(len(t.split()) for _, t, _, x in rows if x == s) for s in "ab"}
    want = slow_targets(sizes)
    assert all(abs(words[s] - want[s]) <= 4 for s in "ab")
    assert max(sum(1 for r in got if r.doc_id == i) for i in range(10)) == 3
    assert got[0].asDict().keys() == set(docs().columns)


def test_odd_and_empty(docs, odd):
    assert mixing.plan(docs()).count() == 0 and mixing.mix(docs()).count() == 0
    assert mixing.plan(odd).count() == odd.count()


def test_many_sources(spark, docs):
    """A source for each host: targets equal those that are found one source at a time."""
    rows = [(i, "w " * (1 + (i * i) % 40), "en", f"host{i % 400}") for i in range(1200)]
    got = mixing.plan(docs(*rows)).collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = slow_targets(sizes)
    source = {r[0]: r[3] for r in rows}
    assert all(r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]]) for r in got)
