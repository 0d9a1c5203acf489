import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

from tidemark.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, docs.filter(~langid.held_out()), keep=["doc_id", "lang"]).withColumn("held_out", langid.held_out()).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spoiled = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    run = lambda d: sorted((r.doc_id, r.lang_pred, round(r.score, 6)) for r in langid.identify(d, d.filter(~langid.held_out())).collect())
    assert run(docs) == run(spoiled)


def test_mixture_of_two_languages(spark, docs):
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    of = lambda lang: " ".join(r["text"] for r in table if r["lang"] == lang)[:3000]
    labelled = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    half = docs((1, of("en")[:1500] + " " + of("de")[:1500]), (2, of("fr")))
    got = {r.doc_id: r for r in langid.identify(half, labelled).collect()}
    assert {m.lang for m in got[1].mixture} == {"en", "de"} and all(0.3 < m.share < 0.7 for m in got[1].mixture)
    assert [m.lang for m in got[2].mixture] == ["fr"] and got[2].score > 0.99


def test_odd_rows(spark, docs, odd):
    labelled = docs((1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "x", None))
    got = langid.identify(odd, labelled).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3))
    assert by[4].lang_pred in ("en", "de")
    digits = langid.identify(docs((1, "123 456 --- !!"), (2, "und der hund")), labelled).collect()
    assert [r.lang_pred for r in sorted(digits, key=lambda r: r.doc_id)] == ["und", "de"]
    assert langid.identify(docs(), labelled).count() == 0
    assert [r.lang_pred for r in langid.identify(docs((1, "some text")), docs()).collect()] == ["und"]


def slow_mixture(likely, penalty):
    """One text's proportions by the same steps, a word and a language at a time."""
    n, k = likely.shape
    shares = [1 / k] * k

    def refine(shares, steps):
        for _ in range(steps):
            sums = [0.0] * k
            for w in likely:
                whole = sum(w[j] * shares[j] for j in range(k))
                for j in range(k):
                    sums[j] += w[j] * shares[j] / whole
            shares = [x / n for x in sums]
        return shares

    def fit(shares):
        return sum(np.log(sum(w[j] * shares[j] for j in range(k)) + 1e-300) for w in likely)

    shares = refine(shares, langid.STEPS)
    for out in sorted(range(k), key=lambda j: shares[j])[: k - 1]:
        less = [0.0 if j == out else x for j, x in enumerate(shares)]
        less = [x / sum(less) for x in less]
        if fit(shares) - fit(less) < penalty * np.log(n + 1):
            shares = less
    return refine(shares, langid.STEPS // 2)


def test_inference_equals_brute_force():
    rng = np.random.default_rng(3)
    for n, k, penalty in ((1, 2, 2.0), (5, 3, 2.0), (40, 4, 0.5), (120, 3, 2.0), (60, 5, 1.0)):
        own = rng.integers(0, k, n) if n > 1 else np.zeros(1, int)
        likely = rng.random((n, k)) * 0.2
        likely[np.arange(n), np.where(own == k - 1, 0, own)] = 1
        likely = np.maximum(likely, langid.FLOOR).astype(np.float32)
        got = langid.mixtures(likely, np.array([0, n]), penalty)[0]
        assert np.allclose(got, slow_mixture(likely.astype(float), penalty), atol=2e-3)


def test_a_text_does_not_depend_on_the_others():
    rng = np.random.default_rng(5)
    likely = np.maximum(rng.random((300, 4)).astype(np.float32), langid.FLOOR)
    bounds = np.array([0, 3, 100, 300])
    whole = langid.mixtures(likely, bounds, 2.0)
    for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        assert np.allclose(whole[i], langid.mixtures(likely[a:b], np.array([0, b - a]), 2.0)[0], atol=1e-4)


def test_counts_equal_brute_force(docs):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("Ab abc", "en"), ("x", "en"), ("über ab", "de"), ("ab", None), (None, "fr")])]
    languages, table = langid.train(docs(*rows))
    assert languages == ["de", "en"]
    want = np.full((langid.BUCKETS, 2), langid.SMOOTH)
    for _, text, lang in rows:
        for w in (text or "").split() if lang else []:
            raw = f" {w.lower()} ".encode()
            for i in range(len(raw) - 2):
                want[((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % 2**32) >> 18, languages.index(lang)] += 1
    assert np.allclose(table, np.log(want / want.sum(axis=0)), atol=1e-5)


def test_many_labels(spark, docs):
    rows = spark.range(1500).selectExpr("id AS doc_id", "concat('w', id, ' ab') AS text", "concat('l', id % 300) AS lang")
    languages, table = langid.train(rows)
    assert len(languages) == 300 and table.shape == (langid.BUCKETS, 300)
    with pytest.raises(ValueError, match="10000 values"):
        langid.train(spark.range(10000).selectExpr("'ab' AS text", "concat('l', id) AS lang"))


def test_proportions_are_probabilities():
    rng = np.random.default_rng(1)
    likely = np.maximum(rng.random((500, 5)).astype(np.float32), langid.FLOOR)
    shares = langid.mixtures(likely, np.array([0, 1, 50, 500]), 2.0)
    assert shares.shape == (3, 5) and np.allclose(shares.sum(axis=1), 1, atol=1e-4)
