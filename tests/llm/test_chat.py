import itertools
import random

import pytest

from tidemark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def slow_cost(roles):
    best = [1 << 40]

    def go(i, state, cost):
        if cost >= best[0]:
            return
        if i == len(roles):
            best[0] = min(best[0], cost + chat.END[state])
            return
        for inserted in ((), (1,), (2,), (3,), (2, 3), (3, 2), (1, 2)):
            x = state
            for s in inserted:
                if s not in chat.NEXT[x]:
                    break
                x = s
            else:
                c = cost + chat.INSERT * len(inserted)
                for t in chat.NEXT[x]:
                    go(i + 1, t, c + (0 if t == roles[i] + 1 else chat.RELABEL))
                if x and x == roles[i] + 1:
                    go(i + 1, x, c + chat.MERGE)

    go(0, 0, 0)
    return best[0]


def test_cost_is_least():
    for n in range(1, 6):
        for roles in itertools.product(range(4), repeat=n):
            assert chat.repair(bytes(roles))[0] == slow_cost(roles)


def test_matrices_compose():
    rng = random.Random(1)
    for _ in range(100):
        roles = bytes(rng.randrange(4) for _ in range(9))
        k = rng.randrange(1, 8)
        a, b, m = chat.matrix(roles[:k]), chat.matrix(roles[k:]), chat.matrix(roles)
        for s, t in itertools.product(range(4), repeat=2):
            least = min(a[s][x] + b[x][t] for x in range(4))
            assert least == m[s][t] or m[s][t] >= chat.NEVER <= least


def slow_render(turns):
    turns = sorted(turns, key=lambda x: (x[1] is None, x[1] or 0, x[2] is not None, x[2] or "", x[3] or ""))
    roles = bytes(chat.ROLES.index(r) if (r := (x[2] or "").strip().lower()) in chat.ROLES else 3 for x in turns)
    out, state = "", 0
    for x, (action, after, inserted) in zip(turns, chat.repair(roles)[1], strict=True):
        if inserted:
            out += ("<|end|>\n" if state else "") + f"<|{chat.ROLES[inserted - 1]}|>\n"
            state = inserted
        out += "\n" + (x[3] or "") if action == "merge" else ("<|end|>\n" if state else "") + f"<|{chat.ROLES[after - 1]}|>\n" + (x[3] or "")
        state = after
    return out + ("<|end|>\n<|user|>\n" if state == 1 else "") + "<|end|>\n"


@pytest.mark.parametrize("parts", [1, 5])
def test_conversations_over_borders(spark, parts):
    rng = random.Random(parts)
    rows = []
    for conv in [None, *range(20)]:
        for turn in range(300 if conv == 7 else rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "USER ", None, "tool"]), rng.choice(["hi", "", None, f"t{turn}"])))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = chat.repaired(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows)
    by, want = {}, {}
    for r in got:
        by.setdefault(r.conv_id, []).append(r)
    for r in rows:
        want.setdefault(r[0], []).append(r)
    for conv, own in by.items():
        # rows come in order within a conversation
        text = "".join(r.rendered for r in own)
        assert text.endswith("<|end|>\n")
        if parts == 1:
            assert text == slow_render(want[conv])
        cost = sum({"keep": 0, "merge": 1, "relabel": 2}[r.action] + (3 if r.inserted else 0) for r in own)
        codes = bytes(chat.ROLES.index(x) if (x := (r.role or "").strip().lower()) in chat.ROLES else 3 for r in own)
        assert cost + (3 if own[-1].new_role == "system" else 0) == chat.repair(codes)[0]


def test_empty_and_extra_columns(spark):
    assert chat.repaired(spark.createDataFrame([], SCHEMA)).count() == 0
    extra = spark.createDataFrame([(1, 0, "user", "a", "x", 5), (1, 0, "user", "a", "x", 5)], SCHEMA + ", action string, code int")
    got = chat.repaired(extra).collect()
    assert [r.action for r in got] == ["keep", "merge"]
