import random
import re

import pytest

from tidemark.llm import suffixdedup

from odd_rows import ODD

LENGTH, GRAM = 24, 8


def slow(rows, length):
    seen = {}
    data = [(t or "").encode() for _, t in rows]
    for i, b in enumerate(data):
        for k in range(len(b) - length + 1):
            seen.setdefault(b[k : k + length], []).append((i, k))
    marks = [bytearray(len(b)) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for i, k in places:
                marks[i][k : k + length] = b"\1" * length
    out = []
    for (doc, _), b, m in zip(rows, data, marks, strict=True):
        spans = [(x.start(), x.end()) for x in re.finditer(b"\1+", bytes(m))]
        out.append((doc, len(b), spans, bytes(c for c, f in zip(b, m, strict=True) if not f)))
    return sorted(out, key=repr)


def run(df, **how):
    found = suffixdedup.remove_repeats(df, length=LENGTH, gram=GRAM, **how).collect()
    return sorted(((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in found), key=repr)


def corpus(seed, n=60):
    rng = random.Random(seed)
    chars = "abcdé "
    text = lambda k: "".join(rng.choice(chars) for _ in range(k))
    passages = [text(rng.randint(20, 120)) for _ in range(6)]
    rows = []
    for i in range(n):
        rows.append((i, "".join(rng.choice([text(rng.randint(0, 60)), rng.choice(passages)]) for _ in range(rng.randint(0, 5)))))
    return rows + [(1000 + i, rows[i][1]) for i in range(8)] + [(2000, "ab" * 60), (2001, "a" * 90)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(docs, seed):
    rows = corpus(seed)
    assert run(docs(*rows)) == slow(rows, LENGTH)


def test_hot_anchors_in_parts(docs, monkeypatch):
    rows = corpus(3, 80)
    hot = "the very common passage of them all, in every text"
    rows += [(5000 + i, f"{i:06d}{hot}{i * 7:06d}") for i in range(80)]
    for room in (suffixdedup.ROOM, 400):
        monkeypatch.setattr(suffixdedup, "ROOM", room)
        assert run(docs(*rows), most=3) == slow(rows, LENGTH)


def test_odd_rows(docs):
    rows = [r for r in ODD if r[1] is None or len(r[1]) < 1000] + [(6, "word " * 300), (7, "x" * 2000), (None, "q" * 100), (8, None)]
    assert run(docs(*rows)) == slow(rows, LENGTH)
    assert run(docs()) == []


def test_periodic_contexts():
    for contexts in ([b"a" * 50], [b"ab" * 30, b"ab" * 30], [b"abc" * 20, b"bca" * 20]):
        got = [[t for a, b in zip(*x, strict=True) for t in range(a, b + 1)] for x in suffixdedup.repeated_windows(contexts, 20)]
        seen = {}
        for i, c in enumerate(contexts):
            for k in range(len(c) - 19):
                seen.setdefault(c[k : k + 20], []).append((i, k))
        hit = {x for v in seen.values() if len(v) > 1 for x in v}
        assert got == [sorted(k for j, k in hit if j == i) for i in range(len(contexts))]
