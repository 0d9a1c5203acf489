"""Removal of long byte strings that occur more than once, decided on Burrows-Wheeler transforms.

Every window of LENGTH bytes names one anchor: the string of GRAM bytes in it with the least hash, the first of equals.
Equal windows name equal anchors at the same place in them, so only windows of one anchor need comparing. The windows
that name one anchor occurrence lie side by side; their bytes are its context. Equal contexts are counted by hash. Anchors
with several different contexts are settled on a Burrows-Wheeler transform of these: intervals are extended backward
breadth-first, which gives common prefixes by increasing value, and whatever is not settled when the length reaches LENGTH
shares at least as much. Anchors with more contexts than one transform should hold are dealt over several, and windows
that lie in different ones are compared by hash, dealt by that hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import suffixes
from tidemark.llm.common import lean, saved, ship

#: Bytes of a string that may not occur twice, and of the strings that anchor it.
LENGTH, GRAM = 400, 48
#: Different contexts of an anchor that one transform takes, and bytes of contexts in one transform.
CONTEXTS, SHARD = 1000, 1 << 19
#: Bytes that are hashed together, and of window hashes that are compared in one task.
CHUNK, ROOM = 1 << 20, 1 << 21

_BASE, _MIX = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD
_LUT = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** n modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        steps = np.full(max(n, CHUNK) + 1, base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if n <= CHUNK:
            _powers[base] = have
    return have[: n + 1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_MIX)
    return h ^ (h >> np.uint64(29))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width values in a row."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, first window, last window, context hash) of every anchor of the texts raw[bounds[i]:bounds[i + 1]].

    Windows are counted from the start of their text.
    """
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none
    inverse = pow(_BASE, -1, 1 << 64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LUT[raw] * _power(_BASE, n)[:n], out=sums[1:])
    back = _power(inverse, n)
    grams = _mixed((sums[gram:] - sums[:-gram]) * back[: n - gram + 1])
    places = np.arange(len(grams), dtype=np.uint64)
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | places
    named = (_sliding_min(keys, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(named)]
    valid = np.arange(len(named)) + length <= bounds[text + 1]
    new = valid.copy()
    new[1:] &= (named[1:] != named[:-1]) | ~valid[:-1] | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    stops = np.flatnonzero(valid & ~np.append(valid[1:] & ~new[1:], False))
    end = stops + length
    context = _mixed((sums[end] - sums[first]) * back[first] + (end - first).astype(np.uint64))
    of = text[first]
    return of, grams[named[first]].view(np.int64), first - bounds[of], stops - bounds[of], context.view(np.int64)


def _scan(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in batches:
            texts = b.column("bytes").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            body = texts.buffers()[2]
            raw = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
            parts, at = [], 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
                own = offsets[at : end + 1] - offsets[at]
                of, *rest = anchors(raw[offsets[at] : offsets[end]], own, length, gram)
                parts.append((of + at, *rest))
                at = end
            of, ah, first, last, ch = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 5
            ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(texts))))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (ah, first.astype(np.int32), last.astype(np.int32), ch)]
            keys = pa.array(np.array([xxh64_intdigest(t.as_buffer(), 42) for t in texts], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), keys, *lists], names=["doc_id", "key", "ah", "p1", "p2", "ch"])

    return run


#: Symbols that are packed into one integer, 9 bits each; 0 is the separator.
PACKED = 7


def _ordered(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(sa, lcp): suffixes in order of their first length symbols at least; lcp[i], what suffixes i - 1 and i share, up to
    PACKED. Separators match nothing."""
    n = len(symbols)
    padded = np.concatenate((symbols, np.zeros(PACKED, np.int64)))
    key = np.zeros(n, np.int64)
    until = np.full(n, PACKED, np.int64)
    for j in range(PACKED):
        s = padded[j : j + n]
        key = (key << 9) | s
        until[(s == 0) & (until == PACKED)] = j
    # what follows a separator must not decide the order: equal beginnings stay in order of place
    cut_off = (9 * (PACKED - until)).astype(np.int64)
    key = (key >> cut_off) << cut_off
    sa = np.argsort(key, kind="stable")
    key, until = key[sa], until[sa]
    differ = key[1:] ^ key[:-1]
    # the first field that differs, from the place of the highest bit; a double holds the exponent of these integers
    high = np.frexp(differ.astype(np.float64))[1]
    field = np.where(differ > 0, PACKED - 1 - (high - 1) // 9, PACKED)
    lcp = np.concatenate(([0], np.minimum(np.minimum(field, until[1:]), until[:-1])))
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(lcp < PACKED, np.arange(n), 0))
    for _ in suffixes.refined(sa, rank, PACKED, length):
        pass
    return sa, lcp


def long_prefixes(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(sa, big): the suffixes in order, and whether suffixes i - 1 and i share at least length symbols; 0 is a separator.

    An interval of rows holds the suffixes with one prefix; the rows that the last-to-first map takes it to, split by
    symbol, hold those with one symbol more in front. When an interval of prefix length l ends where no smaller common
    prefix ended one, the common prefix there is l. Prefixes of up to PACKED symbols are read off the packed symbols.
    """
    n = len(symbols)
    sa, lcp = _ordered(symbols, length)
    isa = np.empty(n, np.int32)
    isa[sa] = np.arange(n, dtype=np.int32)
    before = np.where(sa > 0, sa - 1, n - 1)
    step = isa[before]
    extends = symbols[before] > 0
    head = symbols[sa]
    big = np.append(lcp >= PACKED, False)
    starts = np.flatnonzero(~big[:n])
    ends = np.append(starts[1:], n)
    met = np.append(lcp, 0)[ends] == PACKED - 1
    lb, rb = starts[met], ends[met]
    for _ in range(PACKED, length):
        if not len(lb) or not big.any():
            break
        one = rb - lb == 1
        single = lb[one]
        single = step[single[extends[single]]]
        wide_lb, wide_n = lb[~one], (rb - lb)[~one]
        owner = np.repeat(np.arange(len(wide_lb)), wide_n)
        rows = np.arange(len(owner)) + np.repeat(wide_lb - (np.cumsum(wide_n) - wide_n), wide_n)
        go = extends[rows]
        to, owner = step[rows[go]], owner[go]
        order = np.argsort(to)
        to, owner = to[order], owner[order]
        cuts = np.flatnonzero(np.concatenate(([True], (np.diff(to) != 1) | (np.diff(owner) != 0) | (np.diff(head[to]) != 0)))) if len(to) else np.zeros(0, np.int64)
        child_rb = to[np.append(cuts[1:], len(to)) - 1] + 1 if len(to) else to
        lb, rb = np.concatenate((single, to[cuts])), np.concatenate((single + 1, child_rb))
        fresh = big[rb]
        lb, rb = lb[fresh], rb[fresh]
        big[rb] = False
    return sa, big[:n]


def repeated_windows(contexts: list[bytes], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each context, the runs (first, last) of starts of length bytes that also start elsewhere in the contexts."""
    k = len(contexts)
    ends = np.cumsum([len(c) + 1 for c in contexts]) - 1
    symbols = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int64) + 1
    symbols[ends] = 0
    sa, big = long_prefixes(symbols, max(length, PACKED))
    rows = np.flatnonzero(big)
    hit = np.zeros(len(symbols) + 1, np.bool_)
    hit[sa[rows]] = hit[sa[rows - 1]] = True
    edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0))
    first, last = edges[::2], edges[1::2] - 1
    of = np.searchsorted(ends, first)
    starts = np.concatenate(([0], ends[:-1] + 1))
    cuts = np.searchsorted(of, np.arange(k + 1))
    return [(first[a:b] - starts[i], last[a:b] - starts[i]) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def _settle(length: int):
    """Rows (shard, ah, ch, context) sorted by shard come in; (ah, ch, a, b), runs of repeated windows, go out."""

    def flush(rows: list) -> pa.RecordBatch:
        found = repeated_windows([x[2] for x in rows], length)
        out = [(x[0], x[1], a.tolist(), b.tolist()) for x, (a, b) in zip(rows, found, strict=True) if len(a)]
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["ah", "ch", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        for batch in batches:
            for shard, ah, ch, context in zip(*(batch.column(c).to_pylist() for c in ("shard", "ah", "ch", "context")), strict=True):
                if size >= SHARD and held[-1][3] != shard:
                    yield flush(held)
                    held, size, seen = [], 0, set()
                if (ah, ch) in seen:
                    continue  # the same row of documents, repeated
                seen.add((ah, ch))
                held.append((ah, ch, context, shard))
                size += len(context)
        if held:
            yield flush(held)

    return run


_RUNS = ("ah", "ch", "a", "b")
_RUN_TYPES = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))


def _window_hashes(length: int, room: int):
    """Rows (ah, ch, kinds, context) come in; (shard, ah, ch, h, at) go out, the hashes and starts of a context's windows
    dealt by hash over as many shards as keep each within room bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inverse = pow(_BASE, -1, 1 << 64)
        for batch in batches:
            out = []
            for ah, ch, kinds, context in zip(*(batch.column(c).to_pylist() for c in ("ah", "ch", "kinds", "context")), strict=True):
                raw = np.frombuffer(context, np.uint8)
                sums = np.zeros(len(raw) + 1, np.uint64)
                np.cumsum(_LUT[raw] * _power(_BASE, len(raw))[: len(raw)], out=sums[1:])
                h = _mixed((sums[length:] - sums[:-length]) * _power(inverse, len(raw))[: len(raw) - length + 1])
                shards = 1 + kinds * length * 12 // room
                part = ((h >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
                for own in np.split(order, cuts[1:]):
                    key = (ah * 0x9E3779B1 + int(part[own[0]]) * 0x85EBCA6B) & 0x7FFFFFFFFFFFFFFF
                    out.append((key, ah, ch, h[own].view(np.int64), own.astype(np.int32)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["shard", "ah", "ch", "h", "at"])

    return run


def _met_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, ah, ch, h, at) sorted by shard come in; (ah, ch, a, b), runs of windows whose hash came twice, go out."""

    def flush(rows: list) -> pa.RecordBatch:
        h = np.concatenate([r[3] for r in rows])
        sizes = np.array([len(r[3]) for r in rows])
        bounds, of = np.concatenate(([0], np.cumsum(sizes))), np.repeat(np.arange(len(rows)), sizes)
        at = np.concatenate([r[4] for r in rows])
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        hit = np.zeros(len(h), np.bool_)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        out = []
        for i in np.unique(of[hit]).tolist():
            own = slice(bounds[i], bounds[i + 1])
            starts = np.sort(at[own][hit[own]])
            new = np.flatnonzero(np.diff(starts, prepend=-2) != 1)
            out.append((rows[i][1], rows[i][2], starts[new].tolist(), starts[np.append(new[1:], len(starts)) - 1].tolist()))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _RUN_TYPES, strict=True)], names=list(_RUNS))

    held: list = []
    for batch in batches:
        hs, ats = batch.column("h"), batch.column("at")
        for i, (shard, ah, ch) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shard", "ah", "ch")), strict=True)):
            if held and held[-1][0] != shard:
                yield flush(held)
                held = []
            held.append((shard, ah, ch, hs[i].values.to_numpy(), ats[i].values.to_numpy()))
    if held:
        yield flush(held)


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal runs."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        spans, kept = [], []
        for text, found in zip(b.column("bytes").to_pylist(), b.column("found").to_pylist(), strict=True):
            if not found:
                spans.append([])
                kept.append(text)
                continue
            s, e = _merge(np.array([x["s"] for x in found], np.int64), np.array([x["e"] for x in found], np.int64))
            s, e = s.tolist(), e.tolist()
            spans.append([{"start": x, "end": y} for x, y in zip(s, e, strict=True)])
            kept.append(b"".join(text[x:y] for x, y in zip([0, *e], [*s, len(text)], strict=True)))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(spans, spans_type), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row of docs: the maximal removed runs (start, end) and the bytes left.

    A byte goes if a string of length bytes over it also starts elsewhere, in any row. Null texts count as empty; repeated
    rows are copies of each other, so theirs go whole if long enough; an empty table gives an empty one.
    """
    if not PACKED <= gram <= length:
        raise ValueError(f"{PACKED} <= gram <= length must hold")
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("bytes"))
    schema = "doc_id long, key long, ah array<long>, p1 array<int>, p2 array<int>, ch array<long>"
    scanned = saved(rows.mapInArrow(lean(_scan(length, gram)), schema), "anchors")

    # most anchors occur once, and nothing that they anchor can be found twice
    every = scanned.select("doc_id", "key", F.inline(F.arrays_zip("ah", "p1", "p2", "ch")))
    # (aggregates are written before joins on them, so that both sides are shuffles whose hot keys can be split)
    common = saved(every.groupBy("ah").agg(F.count("*").alias("n")).filter("n > 1").select("ah"), "common")
    met = saved(every.join(common, "ah", "left_semi"), "met")
    kinds = saved(met.groupBy("ah", "ch").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "key", "p1", "p2")).alias("who")), "kinds")
    several = saved(kinds.groupBy("ah").agg(F.count("*").alias("kinds")), "several")
    live = kinds.join(several, "ah")

    asked = live.filter("kinds > 1").select("ah", "ch", "kinds", "who.doc_id", "who.key", "who.p1", "who.p2")
    lists = asked.groupBy("doc_id", "key").agg(F.collect_list(F.struct("ah", "ch", "kinds", "p1", "p2")).alias("asked"))
    here = rows.withColumn("key", F.xxhash64("bytes")).alias("x")
    wanted = here.join(lists.alias("y"), _same_text("x", "y")).select("x.bytes", F.inline("asked"))
    sliced = saved(wanted.select("ah", "ch", "kinds", F.expr(f"substring(bytes, p1 + 1, p2 - p1 + {length})").alias("context")), "contexts")

    # an anchor with more contexts than most is settled in parts, and its windows are compared by hash over all of them
    shard = F.expr(f"xxhash64(ah, pmod(ch, (kinds + {most - 1}) div {most}))")
    dealt = sliced.select(shard.alias("shard"), "ah", "ch", "context").repartition("shard").sortWithinPartitions("shard")
    found = saved(dealt.mapInArrow(lean(_settle(length)), "ah long, ch long, a array<int>, b array<int>"), "runs")
    settled = found.select("ah", "ch", F.inline(F.arrays_zip("a", "b")))
    hashed = sliced.filter(F.col("kinds") > most).mapInArrow(lean(_window_hashes(length, ROOM)), "shard long, ah long, ch long, h array<long>, at array<int>")
    again = hashed.repartition("shard").sortWithinPartitions("shard").mapInArrow(lean(_met_twice), "ah long, ch long, a array<int>, b array<int>")
    hot = again.select("ah", "ch", F.inline(F.arrays_zip("a", "b")))
    same = kinds.filter("c > 1").select("ah", "ch", F.lit(0).alias("a"), (F.col("who.p2") - F.col("who.p1")).alias("b"))
    runs = settled.unionByName(hot).unionByName(same)

    span = F.struct((F.col("p1") + F.col("a")).alias("s"), (F.col("p1") + F.col("b") + length).alias("e"))
    hits = met.join(runs, ["ah", "ch"]).select("doc_id", "key", span.alias("span")).distinct()
    spans = hits.groupBy("doc_id", "key").agg(F.collect_list("span").alias("found"))
    marked = here.join(spans.alias("y"), _same_text("x", "y"), "left")
    out = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    return marked.select("x.doc_id", "x.bytes", F.length("x.bytes").cast("long").alias("n_bytes"), "y.found").mapInArrow(lean(_remove), out)


def _same_text(a: str, b: str) -> Column:
    """Rows of one document: doc_id and the text's hash. Rows with equal both have equal texts, so either stands for all."""
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.key") == F.col(f"{b}.key"))
