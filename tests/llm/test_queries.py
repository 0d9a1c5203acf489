import hashlib
import random

import duckdb
import pytest

from tidemark.llm import queries

SF = "/root/testdata/sf0.001"
CONTRACT = {
    "op1_simhash_dedup": ("documents", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}),
    "op2_quality_rules": ("documents", {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"}),
    "op3_mixing": ("documents", {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}),
    "op4_syncmers": ("documents", {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}),
    "op5_suffix_dedup": ("documents", {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}),
    "op6_chat_format": ("conversations", {"action": "string", "rendered": "string"}),
    "op7_sentencepiece": ("documents", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}),
    "op8_secrets": ("documents", {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"}),
    "op9_warc": ("pages", {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"}),
    "op10_language_id": ("documents", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}),
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns_and_rows(spark, name):
    table, columns = CONTRACT[name]
    df = queries.QUERIES[name](spark, SF)
    types = dict(df.dtypes)
    assert {c: types[c] for c in columns} == columns
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name in queries.ORACLES:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        cursor = con.execute(queries.ORACLES[name])
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in cursor.fetchall()), key=repr)
        assert sorted(map(tuple, rows), key=repr) == want


def test_repeats_are_told_by_what_is_removed(spark, tmp_path):
    rng = random.Random(5)
    prose = lambda n, k: " ".join("".join(rng.choices("abcdefghij", k=k)) for _ in range(n))
    long, short = [prose(70, 7) for _ in range(4)], [prose(60, 4) for _ in range(4)]  # 559 and 299 bytes
    of = {i: long[i % 4] if i < 12 else short[i % 4] if i < 24 else prose(70, 7) for i in range(40)}
    rows = [(i, f"{prose(30 + i, 6)} {p} {prose(20, 6)}") for i, p in of.items()]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.QUERIES["op5_suffix_dedup"](spark, str(tmp_path))
    assert df.columns == list(CONTRACT["op5_suffix_dedup"][1])
    found = {r.doc_id: r for r in df.collect()}
    assert {i for i, r in found.items() if r.n_removed} == set(range(12))
    # the size is that of the whole text, whether something goes or not
    assert all(found[i].n_bytes == len(t) for i, t in rows)
    for i, t in rows[:12]:
        # the spaces around a passage are common to its documents too
        a, b = t.index(of[i]) - 1, t.index(of[i]) + len(of[i]) + 1
        same = [u for j, u in rows[:12] if j != i and j % 4 == i % 4]
        while any(t[a - 1 : b] in u for u in same):
            a -= 1
        while any(t[a : b + 1] in u for u in same):
            b += 1
        assert (found[i].n_removed, found[i].n_spans) == (b - a, 1)
        assert found[i].kept_sha256 == hashlib.sha256((t[:a] + t[b:]).encode()).hexdigest()


def test_secret_digests(spark):
    from tidemark.llm import credentials

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.QUERIES["op8_secrets"](spark, SF).collect():
        spans, _ = credentials.scan_text(texts[r.doc_id])
        shown = [f"{k}:{a}:{b}" for k, a, b in spans]
        base = ",".join(s for s, (k, *_) in zip(shown, spans, strict=True) if k in credentials.KINDS[:3])
        assert r.spans == ",".join(shown) and r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, *_ in spans) for x in credentials.KINDS[:3])


def test_all_are_registered():
    assert set(CONTRACT) == set(queries.QUERIES)
