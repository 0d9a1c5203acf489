"""SimHash near-duplicates, found with a Gray-order hierarchical index.

Distinct fingerprints are dealt into groups that share a band of bits: of radius + 1 bands, two fingerprints that differ
in at most radius bits share one. Within a task the fingerprints of a group are sorted by Gray rank; runs of them form
the leaves of a tree whose upper nodes hold the bits that all below them share. A search adds up the differences on the
way down and leaves a whole group as soon as they exceed the radius. A group gives a spanning forest of its links, never
its pairs; components are then joined over the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, few_rows, free_name, lean, saved, ship
from tidemark.llm.graph import components
from tidemark.llm.gray import QUERIES, GrayIndex
from tidemark.llm.prefixes import common_shingles, prefix_of, remaining_links
from tidemark.llm.similar import asked, ends, fingerprint_links, needed, parities_fit, shingle_sets, with_sets, without

BITS = 64
#: Fingerprints that one search may hold; larger groups are dealt again by their other bits.
GROUP = 8192
#: Rows of two longs of which a list may be broadcast.
FEW = 200_000

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_AT = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash (signed) of the lower-cased words' shingles under XXH64 with seed 42; no word: 0."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return _signed(xxh64_intdigest(b" ".join(words), 42))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    hashes = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    cells = np.array(hashes, dtype=np.uint64).view(np.uint8).reshape(-1, 8).astype(np.int64) + _BYTE_AT
    counts = np.bincount(cells.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    bits = (2 * counts.ravel() > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all of docs if None) and fp long, the fingerprint; null or wordless texts have 0."""
    ship(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    fp = free_name(docs, "fp")
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(free_name(docs, "hashed_text")))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).withColumn(fp, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            texts = texts.cast(pa.large_binary()) if pa.types.is_large_string(texts.type) else texts.cast(pa.binary())
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], fps], names=[*keep, fp])

    return source.mapInArrow(lean(run), schema)


def spanning_links(codes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between the places of codes that join what is joined by pairs within radius: fewer than len(codes)."""
    label = np.arange(len(codes))
    links: list[tuple[int, int]] = []
    index = GrayIndex(codes)
    for at in range(0, len(codes), QUERIES):
        q, hit, _ = index.search(codes[at : at + QUERIES], radius)
        a, b = q + at, hit
        while len(a := a[far := label[a] != label[b]]):
            b = b[far]
            _, first = np.unique(np.maximum(label[a], label[b]), return_index=True)
            parent = np.arange(len(codes))
            for i, j in zip(a[first].tolist(), b[first].tolist(), strict=True):
                x, y = label[i], label[j]
                parent[max(x, y)] = min(x, y)
                links.append((i, j))
            while len(up := np.flatnonzero(parent[parent] != parent)):
                parent[up] = parent[parent[up]]
            label = parent[label]
    return links


def _link_sorted(radius: int):
    """Rows (key, fp) sorted by key come in; links (u, v) go out."""

    def flush(held: list[np.ndarray], whole: bool) -> tuple[list, list[np.ndarray]]:
        keys, fps = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        ends = np.append(starts[1:], len(keys))
        if not whole:
            rest, starts, ends = starts[-1], starts[:-1], ends[:-1]
        out = []
        many = ends - starts > 1
        for a, b in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
            group = fps[a:b]
            if b - a == 2:
                if int(group[0] ^ group[1]).bit_count() <= radius:
                    out.append((group[0], group[1]))
            else:
                out += [(group[i], group[j]) for i, j in spanning_links(group, radius)]
        return out, [] if whole else [(keys[rest:], fps[rest:])]

    def emit(links: list) -> pa.RecordBatch:
        both = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for b in batches:
            if b.num_rows:
                held.append((b.column("key").to_numpy(), b.column("fp").to_numpy().view(np.uint64)))
                links, held = flush(held, False)
                yield emit(links)
        if held:
            yield emit(flush(held, True)[0])

    return run


def _deal(rows: DataFrame, bands: int) -> DataFrame:
    """Each (key, fp, x, left) once for each band of the low left bits of x, those that its group doesn't share yet."""
    j = rows.select("*", F.explode(F.lit(list(range(bands)))).alias("j"))
    cuts = j.select("*", F.expr(f"int((j * left + {bands // 2}) div {bands})").alias("a"), F.expr(f"int(((j + 1) * left + {bands // 2}) div {bands})").alias("b"))
    return cuts.select(
        F.expr("xxhash64(key, j, shiftrightunsigned(x, a) & (shiftleft(1L, b - a) - 1))").alias("key"),
        "fp",
        F.expr("(x & (shiftleft(1L, a) - 1)) | if(b >= left, 0L, shiftleft(shiftrightunsigned(x, b), a))").alias("x"),
        F.expr("left - (b - a)").alias("left"),
    )


def links_within(fps: DataFrame, radius: int = 2, group: int = GROUP) -> DataFrame:
    """Links (u, v) over the distinct longs in column fp that join all that lie within radius bits, directly or in turn.

    Groups above group fingerprints are dealt again by bands of the bits that they don't share, so the data can't make a
    task's search larger: 12 bits that differ allow 4096 fingerprints.
    """
    ship(fps.sparkSession)
    rows = fps.select("fp").distinct().select(F.lit(0).cast("long").alias("key"), "fp", F.col("fp").alias("x"), F.lit(BITS).alias("left"))
    out = None
    while True:
        rows = _deal(rows, radius + 1)
        sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("left").alias("l"))
        big = cut(sizes.filter((F.col("n") > group) & (F.col("l") > 12)).select("key"))
        last = big.isEmpty()
        small = rows if last else rows.join(big, "key", "left_anti")
        found = small.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(lean(_link_sorted(radius)), "u long, v long")
        out = found if out is None else out.unionByName(found)
        if last:
            return out
        rows = cut(rows.join(big, "key", "left_semi"))


def clusters(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, root): the group of every distinct fingerprint that has a link, under its smallest one."""
    roots = components(links_within(fps, radius))
    return roots.select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs.

    component_id is the smallest doc_id that links reach. Null and wordless texts have fingerprint 0 and link like any
    other; rows with a null doc_id are kept and give no component_id unless nothing else does (then it is null).
    Repeated rows come out repeated. An empty table gives an empty one.
    """
    rows = cut(fingerprints(docs.select("doc_id", "text"), shingle, keep=["doc_id"]))
    least = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    linked = least.join(few_rows(clusters(rows, radius), FEW), "fp")
    low = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    named = linked.select("fp", "root").join(low, "root").select("fp", "component_id")
    # written first, so that both sides of the last join are shuffles and a fingerprint of very many rows can be split
    of = cut(least.join(few_rows(named, FEW), "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")))
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def _hash_sets(shingle: int):
    """Rows (id, text) come in; (id, n, hashes) go out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = shingle_sets(b.column("text"), shingle)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(x) for x in made], pa.int64()), pa.array([x.view(np.int64) for x in made], pa.list_(pa.int64()))], names=["id", "n", "hashes"])

    return run


def _alike(texts: DataFrame, sets: DataFrame, shingle: int, similarity: float):
    """A function from pairs (u, v) of ids to those whose sets of shingles, by hashes of 64 bits, have similarity or more.

    Parities of the sets, a sixteenth of their bytes, rule out nearly all others before whole sets travel.
    """

    def check(pairs: DataFrame) -> DataFrame:
        left = cut(parities_fit(pairs, asked(sets, ends(pairs), FEW), similarity))
        of = cut(asked(texts, ends(left), FEW).mapInArrow(lean(_hash_sets(shingle)), "id long, n long, hashes array<long>"))
        out = left.join(of.toDF("u", "n", "a"), "u").join(of.toDF("v", "m", "b"), "v")
        return out.filter(F.size(F.array_intersect("a", "b")) >= needed(F.col("n"), F.col("m"), similarity)).select("u", "v")

    return check


def deduplicate(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without all but one document of each group of near copies; the columns of docs.

    Rows with equal sets of shingles, lower-cased words, are copies, by a hash of 128 bits. Others are linked if their whole
    sets have similarity or more. Fingerprints of the sets, in Gray order, find nearly all such links, see similar; pairs that
    these don't join are found by prefixes of the sets, which lose none. Of a group stays the row with the least doc_id, null
    last, of repeated rows one. Wordless and null texts are copies of each other. An empty table gives an empty one.
    """
    names = [free_name(docs, x) for x in ("whole", "outline", "code", "prefix", "parity")]
    whole, outline, code, prefix, parity = names
    rid = free_name(docs, "rid")
    common = common_shingles(docs.select(F.col("text").cast("string").alias("text")), shingle)
    cast = docs.sparkSession.sparkContext.broadcast(common)
    rows = saved(with_sets(docs.withColumn(rid, F.monotonically_increasing_id()), names, prefix_of(cast, similarity), shingle), "hashed")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", F.col(rid).alias("rid"))
    sets = cut(rows.groupBy(F.col(whole).alias("whole")).agg(F.min(rid).alias("id"), F.min(order).alias("best")).drop("whole"))
    copies = rows.select(F.col(rid).alias("id")).join(sets, "id", "left_anti")
    nodes = without(rows.select(F.col(rid).alias("id"), F.col(outline).alias("outline"), F.col(code).alias("code"), F.col(prefix).alias("prefix")), copies, FEW)
    check = _alike(rows.select(F.col(rid).alias("id"), F.col("text").cast("string").alias("text")), rows.select(F.col(rid).alias("id"), F.col(outline)[0].alias("n"), F.col(parity).alias("parity")), shingle, similarity)
    links = fingerprint_links(nodes.select("id", "code"), check, similarity, few=FEW)
    roots = cut(components(links).select(F.col("node").alias("id"), "root"))
    links = links.unionByName(remaining_links(nodes.drop("code"), roots, common, check, similarity, few=FEW))
    groups = components(links).select(F.col("node").alias("id"), "root")
    best = sets.join(groups, "id", "left").select("best", F.coalesce("root", "id").alias("root"))
    kept = best.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.rid").alias("rid"))
    gone = rows.select(F.col(rid).alias("rid")).join(kept, "rid", "left_anti").select(F.col("rid").alias(rid))
    return without(rows, gone, FEW).select(*[F.col(f"`{c}`") for c in docs.columns])


def hex16(fp: Column | str) -> Column:
    """A fingerprint as 16 hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
