import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import syncmers

from odd_rows import ODD


def test_edited_texts_follow_the_next_document(docs):
    rows = [(i * 37, "".join(random.Random(i).choice("aé漢 \n") for _ in range(i % 23))) for i in range(60)] + [(10**6, "last one"), (10**7, None)]
    got = {r.doc_id: r for r in syncmers.fingerprints(docs(*rows)).collect()}
    rows.sort()
    assert len(got) == len(rows)
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        assert got[doc].text == text and got[doc].edited == text[: len(text) - half] + after[:half]


@pytest.mark.parametrize("few", [syncmers.FEW, 0])
def test_next_rows_of_sparse_equal_and_missing_ids(spark, monkeypatch, few):
    """Ids drawn from 64 bits, many rows of one id, and of none: each row but the last by id, hash and text has the next."""
    monkeypatch.setattr(syncmers, "FEW", few)
    monkeypatch.setattr(syncmers, "LARGE", 20)
    monkeypatch.setattr(syncmers, "BLOCK", 8)
    rng = random.Random(4)
    rows = [(rng.randrange(-(1 << 63), 1 << 63), f"sparse {i}") for i in range(100)] + [(7, f"same id {rng.randrange(90)}") for i in range(150)] + [(None, f"no id {i}") for i in range(90)] + [(i, f"dense {i}") for i in range(60)]
    rng.shuffle(rows)
    got = syncmers.with_next(spark.createDataFrame(rows, "doc_id long, text string"), ["text"]).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, _signed(xxhash.xxh64_intdigest(r[1].encode(), 42)), r[1]))
    want = [(*r, order[(i + 1) % len(order)][1]) for i, r in enumerate(order)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_anchors_are_closed_syncmers(docs, spark):
    rng = random.Random(1)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rng.randrange(30)) for _ in range(300))
    got = {(r["at"], r["hash"]) for r in syncmers.anchors(docs((1, text))).collect()}
    h = spark.createDataFrame([(w,) for w in text.split()], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    hashes = [r.h for r in h]
    pairs = [r.p for r in spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(hashes, hashes[1:], strict=False))], "i int, a long, b long").select("i", F.xxhash64("a", "b").alias("p")).orderBy("i").collect()]
    want = {i for i in range(len(hashes) - 4) if min(pairs[i : i + 4]) in (pairs[i], pairs[i + 3])}
    assert {a for a, _ in got} == want
    assert hashes[0] == _signed(xxhash.xxh64_intdigest(text.split()[0].encode(), 42))


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_likeness(docs):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(5000)]
    one = " ".join(rng.choice(words) for _ in range(800))
    two = " ".join(rng.choice(words) for _ in range(800))
    got = {r.doc_id: r for r in syncmers.fingerprints(docs((1, one), (2, two), (3, one))).select("doc_id", "sketch", syncmers.likeness(F.col("sketch"), F.col("edited_sketch")).alias("edited"), syncmers.likeness(F.col("sketch"), F.col("next_sketch")).alias("next")).collect()}
    assert got[1].sketch == got[3].sketch and got[3].next == 1.0 and got[1].next < 0.1
    assert got[1].edited == pytest.approx(1 / 3, abs=0.15)


def test_texts_of_few_words_are_alike_by_their_characters(docs):
    """Without spaces, or with a few long words: half of the text kept is half of the anchors kept."""
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("漢字仮名交文章例見本abcdefgh\U0001f600") for _ in range(n))
    rows = docs((1, text(400)), (2, text(400)), (3, text(90) + " " + text(90)), (4, text(200)))
    got = {r.doc_id: r for r in syncmers.fingerprints(rows).select("doc_id", syncmers.likeness(F.col("sketch"), F.col("edited_sketch")).alias("edited"), syncmers.likeness(F.col("sketch"), F.col("next_sketch")).alias("next")).collect()}
    assert all(0.15 < r.edited < 0.55 and r.next < 0.1 for r in got.values())


def test_fingerprint_is_the_least_anchors(docs):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(n)) for n in (0, 1, 4, 5, 6, 40, 900)]
    rows = docs(*enumerate(texts))
    found = {}
    for r in syncmers.anchors(rows).collect():
        found.setdefault(r.doc_id, set()).add((r["hash"] % (1 << 64)) >> 33)
    got = {r.doc_id: r.sketch for r in syncmers.with_fingerprint(rows, "text", "sketch").collect()}
    assert got == {i: sorted(found[i])[: syncmers.SKETCH] for i in range(len(texts))}


def test_odd_rows(odd, docs):
    got = syncmers.fingerprints(odd).collect()
    assert len(got) == len(ODD)
    empty = [r for r in got if not r.text.strip()]
    assert len({tuple(r.sketch) for r in empty}) == 1
    assert syncmers.fingerprints(docs()).count() == 0
    alone = syncmers.fingerprints(docs((9, "abcdef"))).collect()
    assert alone[0].edited == "abcabc"
    assert hashlib.sha256(b"").hexdigest()
