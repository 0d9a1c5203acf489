import hashlib
import importlib

import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import credentials, pieces

pipeline = importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark):
    out, docs = [], spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out.append(docs)
    for _, f in pipeline.STAGES:
        docs = f(spark, docs, "/root/testdata/sf0.001")
        out.append(docs.cache())
    return out


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_dedup", "secret_scan", "source_mix", "sentencepiece"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_language_stage_keeps_clean_documents(stages):
    before, after = {r.doc_id: r for r in stages[0].collect()}, {r.doc_id: r for r in stages[1].collect()}
    lettered = {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}
    assert after.keys() <= lettered and len(after) >= 0.98 * len(lettered)
    assert all(after[i].text == before[i].text for i in after)


def test_no_near_copies_remain_and_only_copies_go(stages):
    before, after = {r.doc_id: r.text for r in stages[1].collect()}, {r.doc_id: r.text for r in stages[2].collect()}
    sets = {i: shingles(t) for i, t in before.items()}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for i in before.keys() - after.keys():
        assert max(like(i, j) for j in before if j != i) >= 0.7
    kept = sorted(after)
    assert sum(like(a, b) >= 0.85 for k, a in enumerate(kept) for b in kept[:k]) == 0


def test_secrets_are_gone(stages):
    before, after = {r.doc_id: r for r in stages[2].collect()}, {r.doc_id: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert not credentials.scan_text(r.text)[0] and r.n_chars == len(r.text)
        if not credentials.scan_text(before[i].text)[0]:
            assert r.text == before[i].text


def test_mix_meets_its_targets(stages):
    size = lambda rows: {s: sum(len(r.text.split()) for r in rows if r.source == s) for s in {r.source for r in rows}}
    rows = stages[3].collect()
    before, after = size(rows), size(stages[4].collect())
    longest = max(len(r.text.split()) for r in rows)
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(before))}
    target, free, rest = {}, set(before), sum(before.values())
    while free:
        total = sum(weights[s] for s in free)
        over = [s for s in free if rest * weights[s] / total > 3 * before[s]]
        target |= {s: 3 * before[s] for s in over} if over else {s: rest * weights[s] / total for s in free}
        rest -= sum(target[s] for s in over)
        free = free - set(over) if over else set()
    assert all(abs(after.get(s, 0) - target[s]) <= longest for s in target)


def test_tokens_are_the_librarys(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = []
    for r in stages[4].collect():
        ids = [*library.encode(r.text), 2]
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    assert sorted(want) == sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in stages[5].collect())


def test_stages_stand_odd_rows(spark, odd):
    docs = odd
    for _, f in pipeline.STAGES:
        docs = f(spark, docs, "/root/testdata/sf0.001")
    docs.count()
    empty = odd.filter("false")
    for _, f in pipeline.STAGES:
        empty = f(spark, empty, "/root/testdata/sf0.001")
    assert empty.count() == 0


def test_stages_stand_clashing_columns(spark, odd):
    names = ["score", "lang_pred", "Mixture", "fp", "rid", "spans", "links", "s", "epochs", "cut_at", "d", "k", "z", "key", "scanned_text", "hashed_text", "judged_text", "_score"]
    docs = odd.withColumns({n: F.lit(n) for n in names})
    columns = docs.columns
    for _, f in pipeline.STAGES[:-1]:
        docs = f(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == columns
    assert {r["Mixture"] for r in docs.collect()} <= {"Mixture"}
    assert pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_run_leaves_the_last_stage_alone(spark, stages):
    from tidemark.llm import common

    others = common.saved_paths(spark)
    got = pipeline.run(spark, "/root/testdata/sf0.001")
    left = set(common.saved_paths(spark)) - set(others)
    assert len(left) == 1 and "source_mix" in left.pop()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[-1].collect()))
    common.drop_saved(spark, but=others)
