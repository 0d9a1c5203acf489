import hashlib
import random

import pyarrow.parquet as pq
import pytest
import sentencepiece
from odd_rows import ODD

from tidemark.llm import pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.fixture(scope="module")
def coder():
    return pieces.Coder(pieces.model_bytes(pieces.default_model()))


PARTS = ["a", "e", "th", "the", " ", "  ", "\n", pieces.MARK, "é", "漢", "\0", "\t", "\U0001f600", "\r", "=", "   ", "1", "  \n", " \n ", "​", "ﬁ"]


def test_agenda_equals_library(coder, library):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(2000)] + ["".join(rng.choice(PARTS) for _ in range(2000)), "x" * 500, "ab" * 700, "don't " * 50]
    for t in texts:
        ids = [*library.encode(t), 2]
        assert coder.encode_text(t) == " ".join(map(str, ids)), repr(t)
        assert coder.decode(ids) == coder.coded_text(t)[1] == library.decode(ids), repr(t)


def test_list_and_heap_agree(coder):
    rng = random.Random(2)
    for _ in range(200):
        s = pieces.MARK + "".join(rng.choice("abcdeinorst' ,") for _ in range(rng.randint(1, 80))).replace(" ", pieces.MARK)
        assert coder._merge_list(list(s)) == coder._merge_heap(s)


def test_broken_bytes(coder, library):
    for ids in ([coder.bytes[0xE6], coder.bytes[0xBC]], [coder.bytes[0xFF], 263, coder.bytes[0x41]], [coder.bytes[b] for b in "漢".encode()]):
        assert coder.decode(ids) == library.decode(ids)


def test_queries_over_documents(spark, docs, library):
    rows = ODD + [(100 + i, t) for i, t in enumerate(pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:60])]
    got = pieces.digests(docs(*rows)).collect()
    want = []
    for doc, t in rows:
        ids = [*library.encode(t or ""), 2]
        want.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    whole = {r.doc_id: r for r in pieces.encode(docs(*rows[-5:])).collect()}
    assert all(whole[d].ids == [*library.encode(t), 2] and whole[d].decoded == t for d, t in rows[-5:])


def test_empty_and_kept_columns(docs):
    assert pieces.digests(docs()).count() == 0
    got = pieces.digests(docs((1, None)), keep=["doc_id", "lang", "source"]).collect()[0]
    assert got.n_tokens == 1 and got.source == "a"


def test_clashing_columns(spark, docs):
    rows = docs((1, "a b")).selectExpr("doc_id", "text", "1 AS ids", "2 AS n_tokens", "3 AS encoded_text", "4 AS decoded")
    keep = ["doc_id", "ids", "n_tokens", "encoded_text", "decoded"]
    assert pieces.digests(rows, keep=keep).columns == [*keep, "_n_tokens", "ids_sha256", "decoded_sha256"]
    got = pieces.encode(rows, keep=keep)
    assert got.columns == [*keep, "_ids", "_decoded"] and got.collect()[0]._decoded == "a b"


def test_a_wrong_agenda_stops_the_job(coder, library):
    broken = pieces.Coder(pieces.model_bytes(pieces.default_model()))
    broken.merge = lambda symbols: [i for x in symbols for i in ([broken.ids[x]] if x in broken.ids else [broken.bytes[b] for b in x.encode()])]
    with pytest.raises(RuntimeError):
        pieces._coded_batch(broken, ["hello wonderful world"])
    decoder = pieces.Coder(pieces.model_bytes(pieces.default_model()))
    decoder.pieces = [x.upper() for x in decoder.pieces]
    with pytest.raises(RuntimeError):
        pieces._coded_batch(decoder, ["hello wonderful world"])
    with pytest.raises(RuntimeError):
        coder.hold("hello", [1, 2])


def test_memory_keeps_what_comes_again():
    made = []
    m = pieces.Memory(lambda k: made.append(k) or k.upper(), lambda k, v: 1, 300)
    assert [m[k] for k in "aabbxyzuvwab"] == list("AABBXYZUVWAB")
    assert made == list("abxyzuvw") and set(m) == {"a", "b"}


def test_memory_is_bounded_by_bytes():
    m = pieces.Memory(lambda k: (k, k), pieces._weight, 50_000)
    for i in [*range(3000), *range(3000)]:
        assert m[str(i)] == (str(i), str(i))
    for part in (m, m.old, m.once, m.once_old):
        assert sum(pieces._weight(k, v) for k, v in part.items()) <= 50_000
    assert m["x" * 1000] == ("x" * 1000,) * 2 and all("x" * 1000 not in part for part in (m, m.old, m.once, m.once_old))
