import collections
import random

from tidemark.llm import quality

from odd_rows import ODD


def slow(text, least):
    text = text or ""
    words = text.encode().split()
    n = len(words)

    def covered(k):
        grams = [tuple(words[i : i + k]) for i in range(n - k + 1)]
        count, hit = collections.Counter(grams), set()
        for i, g in enumerate(grams):
            if count[g] > 1:
                hit.update(range(i, i + k))
        return len(hit)

    longest = 0
    while longest < n and any(c > 1 for c in collections.Counter(tuple(words[i : i + longest + 1]) for i in range(n - longest)).values()):
        longest += 1
    lines = [x for x in text.split("\n") if x.encode().split()]
    return n, sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), covered(3), covered(least), longest


def test_figures_equal_brute_force(docs):
    rng = random.Random(3)
    texts = ["\n".join(" ".join(rng.choice(["a", "b", "cc", "d#", "é|"]) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, (_, t) in enumerate(ODD) if t is None or len(t) < 500]
    got = {r.doc_id: tuple(r)[1:] for r in quality.measure(docs(*rows), min_repeat=4).collect()}
    assert got == {i: slow(t, 4) for i, t in rows}


def test_long_and_odd_texts(odd):
    got = {r.doc_id: r for r in quality.judge(quality.measure(odd)).collect()}
    assert got[6].n_words == 30000 and got[6].longest_repeat == 29999 and not got[6].kept
    assert got[7].n_words == 1 and got[7].word_chars == 200000
    assert got[1].n_words == got[2].n_words == got[3].n_words == 0 and got[1].base_failed
    assert quality.measure(odd.filter("false")).count() == 0


def test_verdict(docs):
    rng = random.Random(4)
    clean = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))
    passage, long = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("p", 30), ("q", 101)))
    rows = [(1, clean), (2, clean + " " + clean), (3, f"{clean} {passage} {passage}"), (4, clean[:100]), (5, f"{clean} {passage} {passage} {passage}"), (6, " ".join(f"v{rng.randrange(10**7)}" for _ in range(2000)) + f" {long} x {long}")]
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(quality.measure(docs(*rows))).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (False, 60 <= 0.2 * 360), 4: (True, False), 5: (False, 90 <= 0.2 * 390), 6: (False, False)}


def test_repeats_do_not_cross_texts(docs):
    text = " ".join(f"w{i}" for i in range(100))
    got = quality.measure(docs(*[(i, text) for i in range(50)])).collect()
    assert {(r.n_repeat_words, r.covered_words) for r in got} == {(0, 0)}
