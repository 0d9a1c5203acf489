"""Chat formatting with minimum-cost role repair.

Legal conversations are those of an automaton: at most one system turn, first, then user and assistant by turns, user
first. Dynamic programming over its states picks the cheapest way to read a conversation: keep a turn, merge it into the
one before, relabel it, or insert an empty turn before it. A run of turns acts on costs as a (min, +) matrix, so a
conversation may span tasks: the runs at the edges of partitions give matrices, these give the states at the borders, and
each task then repairs its own runs between them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import cut, lean, ship

ROLES = ("system", "user", "assistant")
#: States: nothing yet, then the role of the last turn. What may follow each.
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
KEEP, MERGE, RELABEL, INSERT = 0, 1, 2, 3
NEVER = 1 << 40
Option = tuple[int, str, int]  # cost, action, role inserted before as a state or 0


def _options(role: int) -> dict[tuple[int, int], Option]:
    """The cheapest way from a state to a state over a turn; role 3 is any but ROLES. Ties go to the action named first."""
    best: dict[tuple[int, int], Option] = {}

    def offer(s: int, t: int, cost: int, action: str, inserted: int = 0) -> None:
        if cost < best.get((s, t), (NEVER,))[0]:
            best[s, t] = (cost, action, inserted)

    for s in range(4):
        for t in NEXT[s]:
            offer(s, t, *((KEEP, "keep") if t == role + 1 else (RELABEL, "relabel")))
        if s and s == role + 1:
            offer(s, s, MERGE, "merge")
        for x in NEXT[s]:
            for t in NEXT[x]:
                offer(s, t, *((INSERT, "keep") if t == role + 1 else (INSERT + RELABEL, "relabel")), x)
    return best


_TABLE = [_options(r) for r in range(4)]
_MOVES = [[(s, t, o[0]) for (s, t), o in sorted(x.items())] for x in _TABLE]
#: What it costs to end in a state: a system turn alone gets an empty user turn.
END = {0: 0, 1: INSERT, 2: 0, 3: 0}


def _forward(roles: bytes, start: list[int]) -> list[list[int]]:
    """Costs of the states after each turn, before the first in front."""
    costs = [start]
    for r in roles:
        now, before = [NEVER] * 4, costs[-1]
        for s, t, c in _MOVES[r]:
            if before[s] + c < now[t]:
                now[t] = before[s] + c
        costs.append(now)
    return costs


def matrix(roles: bytes) -> list[list[int]]:
    """Cost from each state to each state over a run of turns."""
    return [_forward(roles, [0 if i == s else NEVER for i in range(4)])[-1] for s in range(4)]


def repair(roles: bytes, first: int = 0, last: int | None = None) -> tuple[int, list[tuple[str, int, int]]]:
    """(cost, (action, state after, state inserted before or 0) for each turn) from state first to last, or to any end."""
    costs = _forward(roles, [0 if i == first else NEVER for i in range(4)])
    state = min(range(4), key=lambda s: costs[-1][s] + END[s]) if last is None else last
    total = costs[-1][state] + (END[state] if last is None else 0)
    out = []
    for i in range(len(roles) - 1, -1, -1):
        table = _TABLE[roles[i]]
        before = next(s for s in range(4) if (s, state) in table and costs[i][s] + table[s, state][0] == costs[i + 1][state])
        out.append((table[before, state][1], state, table[before, state][2]))
        state = before
    return total, out[::-1]


def _borders(edges: list[tuple[int, bool, bool, object, list[list[int]]]]) -> dict[tuple[int, bool], tuple[int, int, bool]]:
    """(state before, state after, whether it goes on) of the runs of conversations that cross a border of partitions.

    edges: (partition, is first run, is last run, conversation, matrix). The keys are (partition, is first run).
    """
    out: dict[tuple[int, bool], tuple[int, int, bool]] = {}
    for _, runs in groupby(sorted(edges, key=lambda e: (e[0], not e[1])), key=_Linked()):
        chain = list(runs)
        if len(chain) < 2:
            continue
        costs = [[0, NEVER, NEVER, NEVER]]
        for *_, m in chain:
            costs.append([min(costs[-1][s] + m[s][t] for s in range(4)) for t in range(4)])
        after = min(range(4), key=lambda s: costs[-1][s] + END[s])
        for i in range(len(chain) - 1, -1, -1):
            part, is_first, _, _, m = chain[i]
            before = next(s for s in range(4) if costs[i][s] + m[s][after] == costs[i + 1][after])
            out[part, is_first] = (before, after, i < len(chain) - 1)
            after = before
    return out


class _Linked:
    """A key that stays the same while runs continue the conversation of the run before in the next partition."""

    def __init__(self):
        self.group, self.before = 0, None

    def __call__(self, e) -> int:
        b = self.before
        if not (b and b[3] == e[3] and b[2] and e[1] and e[0] > b[0]):
            self.group += 1
        self.before = e
        return self.group


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[object, list[tuple]]]:
    """(conversation, rows) of a sorted partition."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in columns), strict=True))
    return ((k, list(g)) for k, g in groupby(rows, key=lambda r: r[0]))


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, action, new_role, inserted, rendered) for every row of conversations.

    Turns go by turn, null last, then role and the text's hash. Roles are compared in lower case without spaces around; a null or
    unknown role has to be relabelled. inserted is the role of the empty turn put before, if any. The rendered segments of
    a conversation in order are its text: "<|role|>\\n", the texts, "<|end|>\\n". Null texts count as empty; null conv_ids
    make one conversation; repeated rows are turns of their own; an empty table gives an empty one. Other columns are not
    read.
    """
    spark = conversations.sparkSession
    ship(spark)
    name = F.lower(F.trim(F.col("role").cast("string")))
    code = F.coalesce(*[F.when(name == r, i) for i, r in enumerate(ROLES)], F.lit(3)).cast("int")
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), code.alias("code")).withColumn("h", F.xxhash64("text")).withColumn("p", F.spark_partition_id())
    order = ["conv_id", F.col("turn").asc_nulls_last(), "role"]
    placed = cut(rows.repartitionByRange(*order, "h", "p").sortWithinPartitions(*order, "h", "p").select("conv_id", "turn", "role", "text", "code"))
    placed = placed.withColumn("part", F.spark_partition_id())
    id_type = placed.schema["conv_id"]

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for key, own in _runs(batches, ["conv_id", "part", "code"]):
            last = (own[0][1], key, bytes(r[2] for r in own))
            first = first or last
        found = [] if first is None else [first] if first is last else [first, last]
        columns = [[x[0] for x in found], [x is first for x in found], [x is last for x in found], [x[1] for x in found], [sum(matrix(x[2]), []) for x in found]]
        types = [pa.int32(), pa.bool_(), pa.bool_(), key_type, pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "is_first", "is_last", "conv_id", "m"])

    key_type = to_arrow_type(id_type.dataType)
    edge_schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("is_first", T.BooleanType()), T.StructField("is_last", T.BooleanType()), T.StructField("conv_id", id_type.dataType), T.StructField("m", T.ArrayType(T.LongType()))])
    # two rows at most for each partition
    seen = placed.select("conv_id", "part", "code").mapInArrow(edges, edge_schema).collect()
    borders = _borders([(e.part, e.is_first, e.is_last, e.conv_id, [e.m[4 * i : 4 * i + 4] for i in range(4)]) for e in seen])
    schema = T.StructType([T.StructField("conv_id", id_type.dataType), T.StructField("turn", placed.schema["turn"].dataType), *[T.StructField(c, T.StringType()) for c in ("role", "action", "new_role", "inserted", "rendered")]])
    types = [to_arrow_type(f.dataType) for f in schema]

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rendered() -> Iterator[list[tuple]]:
            runs, held, is_first = _runs(batches, ["conv_id", "turn", "role", "text", "code", "part"]), None, True
            for run in runs:
                if held:
                    yield one(held, is_first, False)
                    is_first = False
                held = run
            if held:
                yield one(held, is_first, True)

        def one(run: tuple, is_first: bool, is_last: bool) -> list[tuple]:
            key, own = run
            start, stop, goes_on = borders.get((own[0][5], is_first), (0, None, False)) if is_first or is_last else (0, None, False)
            _, steps = repair(bytes(r[4] for r in own), start, stop)
            out, state = [], start
            for r, (action, after, inserted) in zip(own, steps, strict=True):
                text = ""
                if inserted:
                    text += ("<|end|>\n" if state else "") + f"<|{ROLES[inserted - 1]}|>\n"
                    state = inserted
                text += "\n" + r[3] if action == "merge" else ("<|end|>\n" if state else "") + f"<|{ROLES[after - 1]}|>\n" + r[3]
                state = after
                out.append([key, r[1], r[2], action, ROLES[after - 1], ROLES[inserted - 1] if inserted else None, text])
            if not goes_on:
                out[-1][6] += ("<|end|>\n<|user|>\n" if state == 1 else "") + "<|end|>\n"
            return out

        held: list = []
        for rows_ in rendered():
            held += rows_
            if len(held) >= 2000:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    def _batch(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=schema.names)

    return placed.mapInArrow(lean(mend), schema)
