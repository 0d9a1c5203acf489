import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import gray, prefixes, simhash, similar

from odd_rows import ODD


def slow_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, radius=2):
    fps = [slow_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fps[i] ^ fps[j]).count("1") <= radius:
                    group[i] = group[j] = min(group[i], group[j])
    low = {}
    for i, g in enumerate(group):
        if rows[i][0] is not None:
            low[g] = min(rows[i][0], low.get(g, rows[i][0]))
    return sorted(((rows[i][0], fps[i], low.get(group[i])) for i in range(len(rows))), key=repr)


def test_equals_brute_force(docs):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t.upper()) for i, t in enumerate(base)] + [(200 + i, t + " tail") for i, t in enumerate(base)]
    rows += [r for r in ODD if r[1] is None or len(r[1]) < 1000]
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs(*rows)).collect()]
    assert sorted(got, key=repr) == slow_components(rows)


def test_index_finds_all_pairs_and_forest_joins_them():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    one = lambda n: np.uint64(1) << rng.integers(0, n, 80, dtype=np.uint64)
    codes = np.unique(np.concatenate([b ^ one(16) ^ one(64) ^ one(64) for b in base]))
    far = np.bitwise_count(codes[:, None] ^ codes[None, :])
    for radius in (0, 1, 2, 5):
        q, hit, bits = simhash.GrayIndex(codes).search(codes, radius)
        assert (far[q, hit] == bits).all()
        assert set(zip(q.tolist(), hit.tolist(), strict=True)) == set(zip(*np.where(far <= radius), strict=True))
    links = simhash.spanning_links(codes, 2)
    assert len(links) < len(codes) and all(far[a, b] <= 2 for a, b in links)


def test_hot_groups_are_dealt_again(spark):
    fps = [(1 << a) ^ (1 << b) for a in range(40) for b in range(a + 1, 40)] + [(1 << 62) | (1 << a) for a in range(20)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = {tuple(sorted(simhash_roots)) for simhash_roots in _sets(fps, simhash.clusters(df, 2))}
    small = {tuple(sorted(s)) for s in _sets(fps, _clusters(df, 64))}
    assert want == small and len(want) == 1


def _clusters(df, group):
    from tidemark.llm.graph import components

    return components(simhash.links_within(df, 2, group)).withColumnRenamed("node", "fp")


def _sets(fps, found):
    out = {}
    for r in found.collect():
        out.setdefault(r.root, set()).add(r.fp)
    return out.values()


def test_empty_table_and_clashing_columns(spark, docs):
    assert simhash.near_duplicates(docs()).count() == 0
    clash = docs((1, "a b c d"), (2, "a b c d")).withColumns({"fp": F.lit("x"), "rid": F.lit("y")})
    found = simhash.deduplicate(clash)
    assert found.columns == clash.columns and [r.doc_id for r in found.collect()] == [1]


@pytest.mark.parametrize("few", [simhash.FEW, 0])
def test_deduplicate_keeps_one_of_each_group(docs, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(4000)]
    clean = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(30)]
    near = []
    for t in clean[:10]:
        w = t.split()
        w[rng.randrange(5, 110)] = "edited"
        near.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(clean)] + [(100 + i, t) for i, t in enumerate(near)] + [(200 + i, t) for i, t in enumerate(clean[20:])] + [(3, clean[3]), (None, clean[4])]
    kept = simhash.deduplicate(docs(*rows)).collect()
    assert sorted(r.doc_id for r in kept) == list(range(30))


def test_deduplicate_odd_rows(odd):
    kept = simhash.deduplicate(odd).collect()
    texts = [r.text for r in kept]
    assert len(texts) == len(set(texts))
    assert sorted((r.doc_id for r in kept), key=repr) == sorted([1, 4, 5, None, 6, 7], key=repr)


def shingle_set(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def slow_kept(rows, similarity=0.8):
    """The least ids of the groups that pairs of similarity or more join."""
    sets, group = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted(min(r[0] for r, g in zip(rows, group, strict=True) if g == x) for x in set(group))


def on_a_template(rng, n, changed, words=300):
    """Texts that share a template but for a run of words that begins at random places; each has one near copy."""
    vocabulary = [f"w{i}" for i in range(5000)]
    template = [rng.choice(vocabulary) for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(template)
        at = rng.randrange(words - changed)
        w[at : at + changed] = [rng.choice(vocabulary) for _ in range(changed)]
        out.append(" ".join(w))
        w[rng.randrange(words)] = "edited"
        out.append(" ".join(w))
    return out


def test_pairs_are_checked_before_they_are_left_out(docs):
    """Texts on a template are alike to many by half to three quarters, and to one by more: no such pair is left out."""
    rng = random.Random(7)
    rows = list(enumerate(on_a_template(rng, 40, 60, 180)))
    kept = sorted(r.doc_id for r in simhash.deduplicate(docs(*rows)).collect())
    assert kept == slow_kept(rows) and 1 < len(kept) < len(rows)


def test_all_pairs_at_the_threshold_are_found(docs):
    """Pairs of similarity 0.8 to 0.83, of which fingerprints show only a part."""
    rng = random.Random(8)
    rows = []
    for i in range(150):
        w = [f"w{rng.randrange(9000)}" for _ in range(204)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[: 183 + i % 4] + [f"x{rng.randrange(9000)}" for _ in range(21 - i % 4)]))]
    kept = sorted(r.doc_id for r in simhash.deduplicate(docs(*rows)).collect())
    assert kept == slow_kept(rows) == list(range(0, 300, 2))


@pytest.mark.parametrize("few", [similar.FEW, 0])
@pytest.mark.parametrize("searched", [True, False])
def test_links_join_all_pairs_however_common_their_shingles(spark, few, searched):
    rng = random.Random(9)
    rows = list(enumerate([t + " one line that all of the texts have at their end" for t in on_a_template(rng, 30, 55, 160)] + ["", "a b", "a b c d e f"]))
    docs = spark.createDataFrame(rows, "id long, text string")
    common = prefixes.common_shingles(docs, 5, sample=1, least=3)
    assert len(common[0]) > 100
    nodes = similar.with_sets(docs, ["whole", "outline", "code", "prefix", "parity"], prefixes.prefix_of(spark.sparkContext.broadcast(common), 0.8))

    def exact(pairs):
        sets = {i: shingle_set(t) for i, t in rows}
        good = [(u, v) for u, v in pairs.collect() if len(sets[u] & sets[v]) >= 0.8 * len(sets[u] | sets[v]) - 1e-9]
        return spark.createDataFrame(good, "u long, v long")

    for group in (5, 1000):
        links = similar.fingerprint_links(nodes, exact, 0.8, group=group, few=few) if searched else spark.createDataFrame([], "u long, v long")
        roots = simhash.components(links).withColumnRenamed("node", "id")
        links = links.unionByName(prefixes.remaining_links(nodes, roots, common, exact, 0.8, sample=1, group=group, few=few))
        root = {r.node: r.root for r in simhash.components(links).collect()}
        assert sorted({root.get(i, i) for i, _ in rows}) == slow_kept(rows)


@pytest.mark.parametrize("similarity, least", [(0.8, 0.93), (0.85, 0.97), (0.9, 0.99)])
def test_fingerprints_find_most_pairs(spark, similarity, least):
    """By fingerprints alone, of pairs at a similarity among unlike texts, about as many as found_by() says."""
    rng = np.random.default_rng(4)
    pairs, rows = 600, []
    for _ in range(pairs):
        n = int(rng.integers(40, 400))
        shared = round(2 * similarity / (1 + similarity) * n)
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        rows += [a, np.concatenate((a[:shared], rng.integers(0, 2**64, n - shared, dtype=np.uint64)))]
    codes = [(i, similar.code_of(x).tolist()) for i, x in enumerate(rows)]
    seen = []
    keep = lambda df: seen.append(df.collect()) or df
    similar.fingerprint_links(spark.createDataFrame(codes, "id long, code array<long>"), keep, 0.8)
    found = sum(v == u + 1 and u % 2 == 0 for u, v in seen[0])
    assert found >= least * pairs
    masks = similar.drawn_masks(2 * pairs, 0.8)
    assert abs(found / pairs - similar.found_by(len(masks), len(masks[0]), similarity)) < 0.03


def test_as_many_masks_as_the_chance_needs():
    for n in (10, 5000, 10**6, 10**9):
        masks = similar.drawn_masks(n, 0.8)
        assert similar.found_by(len(masks), len(masks[0]), 0.8) >= similar.RECALL or n > 10**6 and len(masks) == similar.MASKS
        assert all(len(set(m)) == len(masks[0]) for m in masks)


def test_sets_of_a_slice_are_those_of_its_texts():
    """Of each text the same, whatever rows stand beside it in a batch; as many as there are different shingles."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["A", "bé", "Cc", "漢字", "dd,"]) for _ in range(rng.randint(0, 60))) for _ in range(200)] + [None, "", " \t", "one", "a b c d e"]
    for kind in (pa.string(), pa.large_string()):
        batch = pa.array(texts, kind)
        whole = similar.shingle_sets(batch)
        alone = [similar.shingle_sets(pa.array([t], kind))[0] for t in texts]
        parts = [x for at in range(0, len(texts), 37) for x in similar.shingle_sets(batch.slice(at, 37))]
        for t, a, b, c in zip(texts, whole, alone, parts, strict=True):
            assert a.tolist() == b.tolist() == c.tolist() and len(a) == len(shingle_set(t))
    lower = [similar.shingle_sets(pa.array([(t or "").encode().lower().decode()]))[0].tolist() for t in texts]
    assert lower == [x.tolist() for x in whole]


def test_parities_rule_out_no_similar_pair(spark):
    """Of pairs of sets of many sizes all that are similar stay, and few of those well below the threshold."""
    rng = np.random.default_rng(7)
    rows, pairs, like = [], [], {}
    for i in range(400):
        n, j = int(rng.integers(1, 1500)), float(rng.choice([0.5, 0.7, 0.79, 0.8, 0.81, 0.9, 1.0]))
        shared = min(n, round(2 * j / (1 + j) * n))
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        b = np.concatenate((a[:shared], rng.integers(0, 2**64, int((n - shared) * rng.random() * 2), dtype=np.uint64)))
        for x, k in ((a, 2 * i), (b, 2 * i + 1)):
            size = max(512, 1 << (2 * len(x) - 1).bit_length()) if len(x) else 512
            rows.append((k, len(x), similar.parities_of(x, size).tobytes()))
        pairs.append((2 * i, 2 * i + 1))
        like[2 * i] = shared / (n + len(b) - shared)
    got = {r.u for r in similar.parities_fit(spark.createDataFrame(pairs, "u long, v long"), spark.createDataFrame(rows, "id long, n long, parity binary"), 0.8).collect()}
    assert got >= {u for u, x in like.items() if x >= 0.8} and not [u for u in got if like[u] < 0.6 and rows[u][1] > 50]
    odd = similar.parities_of(rng.integers(0, 2**64, 900, dtype=np.uint64), 2048)
    assert similar.folded(odd, 64).tolist() == np.bitwise_xor.reduce(odd.reshape(4, 64), axis=0).tolist()


def test_code_is_the_majority_of_each_bit():
    rng = np.random.default_rng(8)
    for n in (1, 2, 5, 254, 255, 256, 1000):
        x = rng.integers(0, 2**64, n, dtype=np.uint64)
        first = int(similar.code_of(x).view(np.uint64)[0])
        assert first == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in x) > n)


def test_gray_order_of_wide_codes():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 2**64, (2, 300), dtype=np.uint64)
    whole = [(int(a) << 64) | int(b) for a, b in codes.T]

    def rank(x):
        r = 0
        while x:
            r, x = r ^ x, x >> 1
        return r

    assert gray.gray_order(codes).tolist() == sorted(range(300), key=lambda i: rank(whole[i]))
    q, hit, bits = gray.GrayIndex(codes).search(codes[:, :50], 60)
    want = {(i, j): (whole[i] ^ whole[j]).bit_count() for i in range(50) for j in range(300)}
    assert dict(zip(zip(q.tolist(), hit.tolist(), strict=True), bits.tolist(), strict=True)) == {k: v for k, v in want.items() if v <= 60}


def test_equal_fingerprints_are_no_proof(docs):
    """A line that is repeated 60 times decides all bits of a fingerprint; the sets still differ."""
    rng = random.Random(10)
    line = " ".join(f"common{i}" for i in range(9))
    rows = [(i, " ".join([*(f"w{rng.randrange(9000)}" for _ in range(100)), *[line] * 60])) for i in range(12)]
    assert len({simhash.fingerprint(t.encode(), 5) for _, t in rows}) == 1
    rows += [(100 + i, " ".join(["own words", line, line, f"tail{i // 2}", *[f"r{i // 2} s t u v"] * (2 if i % 2 else 20)])) for i in range(4)]
    kept = sorted(r.doc_id for r in simhash.deduplicate(docs(*rows)).collect())
    assert kept == slow_kept(rows) == [*range(12), 100, 102]


def test_long_texts_are_checked_exactly(docs):
    """Pairs of about 1000 shingles a little below and above 0.8, which a sample of their shingles can't tell apart."""
    rng = random.Random(11)
    rows = []
    for i in range(60):
        shared = 893 + (-8, 8)[i % 2]
        w = [f"w{rng.randrange(90000)}" for _ in range(1004)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:shared] + [f"x{rng.randrange(90000)}" for _ in range(1004 - shared)]))]
    kept = sorted(r.doc_id for r in simhash.deduplicate(docs(*rows)).collect())
    assert kept == slow_kept(rows) and 60 < len(kept) < 120
