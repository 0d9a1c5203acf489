"""Document fingerprints from closed syncmers, with DataFrame functions alone.

A k-mer is K words in a row, or K code points in a text of fewer words. Of the S-word strings in it, the one with the least hash must be its first or its last:
whether a k-mer is chosen depends on its own words alone, so equal passages give equal anchors wherever they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import by_range, few_rows

#: Words of a k-mer and of an inner string; half of the k-mers are chosen.
K, S = 5, 2
#: Anchors in a fingerprint: those with the least hashes.
SKETCH = 128
#: Rows of a block, rows from which a block is dealt by id and text, and rows of which a list may be broadcast.
BLOCK, LARGE, FEW = 256, 4096, 200_000
_SPACE = " \t\n\x0b\x0c\r"


def _symbol_hashes(text: Column) -> Column:
    """Hashes of a text's words, or where it has fewer than K, of its code points."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    return F.transform(F.when(F.size(words) >= K, words).otherwise(F.split(trimmed, "")), lambda w: F.xxhash64(w))


def with_anchors(rows: DataFrame, text: str, out: str) -> DataFrame:
    """rows with out: array of (at, hash) for the closed syncmers of a text, at the number of their first symbol.

    Symbols are words, or code points in a text of fewer than K words, be it short or without spaces. A text with no chosen
    k-mer, be it too short or by chance, has one anchor for the whole sequence. Null counts as empty, and empty texts are alike.
    """
    h, m = f"{out}_words", f"{out}_pairs"
    n = F.size(h)
    hashed = rows.withColumn(h, _symbol_hashes(F.col(text)))
    paired = hashed.withColumn(m, F.zip_with(F.slice(h, 1, F.greatest(n - 1, F.lit(0))), F.slice(h, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b)))
    count = F.greatest(n - (K - 1), F.lit(0))
    shifted = [F.slice(m, 1 + i, count).alias(f"m{i}") for i in range(K - S + 1)]
    zipped = F.arrays_zip(*shifted, F.slice(h, K, count).alias("last"), F.sequence(F.lit(0), F.greatest(count, F.lit(1))).alias("at"))
    inner = [f"m{i}" for i in range(K - S + 1)]
    chosen = F.filter(F.slice(zipped, 1, count), lambda x: F.least(x["m0"], x[inner[-1]]) <= F.least(*[x[i] for i in inner[1:-1]]))
    anchors = F.transform(chosen, lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["m0"], x["m2"], x["last"]).alias("hash")))
    found = paired.withColumn(out, anchors)
    whole = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(h).alias("hash")))
    return found.withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(whole)).drop(h, m)


def anchors(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, at, hash): a row for each anchor of each row of docs, for positional matching."""
    found = with_anchors(docs.select("doc_id", F.col(text).cast("string").alias("t")), "t", "a")
    return found.select("doc_id", F.inline("a"))


def with_fingerprint(rows: DataFrame, text: str, out: str) -> DataFrame:
    """rows with out: the SKETCH least 31-bit anchor hashes of a text, in order."""
    found = with_anchors(rows, text, f"{out}_anchors")
    short = F.transform(F.col(f"{out}_anchors.hash"), lambda x: F.shiftrightunsigned(x, 33).cast("int"))
    return found.withColumn(out, F.slice(F.sort_array(F.array_distinct(short)), 1, SKETCH)).drop(f"{out}_anchors")


def likeness(a: Column, b: Column) -> Column:
    """What part of the anchors in either text are in both, from their fingerprints: of the SKETCH least hashes of the union."""
    least = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(F.array_intersect(least, a), b)).cast("double") / F.size(least)


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


#: Groups by which neighbours meet, in order; of a large block each id has groups of its own, of equal ids by ranges of the hash.
_GROUP = ["no_id", "block", "own_id", "slice"]


def _grouped(rows: DataFrame) -> DataFrame:
    """rows with h, a hash of the text, and the columns of _GROUP; ids spread evenly make blocks of about BLOCK rows."""
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id")).first()
    width = BLOCK * (1 + (high - low) // n) if n else BLOCK
    placed = rows.withColumn("no_id", F.col("doc_id").isNull()).withColumn("block", F.coalesce(F.expr(f"doc_id div {min(width, (1 << 63) - 1)}L"), F.lit(0).cast("long"))).withColumn("h", F.xxhash64("text"))
    sizes = placed.groupBy("no_id", "block").agg(F.count("*").alias("n")).filter(F.col("n") > LARGE).withColumn("bits", F.ceil(F.log2(F.col("n") / LARGE)).cast("int"))
    met = placed.join(few_rows(sizes.select("no_id", "block", "bits"), FEW), ["no_id", "block"], "left")
    large = F.col("bits").isNotNull()
    return met.withColumn("own_id", F.when(large, F.coalesce("doc_id", F.lit(0)))).withColumn("slice", F.when(large, F.expr("shiftright(h, 64 - bits)"))).drop("bits")


def _firsts(rows: DataFrame) -> DataFrame:
    """(_GROUP, first_id, first_h, to_<_GROUP>): each group, its first row's id and hash, and the group before it; before the first, the last."""
    groups = rows.groupBy(*_GROUP).agg(F.min(F.struct("doc_id", "h")).alias("first"))
    order = [F.col(c) for c in _GROUP]
    dealt = by_range(groups, *order)
    me, near = F.struct(*_GROUP), W.partitionBy("range").orderBy(*order)
    # a row for each range: where it ends
    tops = dealt.groupBy("range").agg(F.max(me).alias("top"))
    ends = tops.select("range", F.coalesce(F.lag("top").over(W.orderBy("range")), F.max("top").over(W.partitionBy())).alias("ahead"))
    prev = F.coalesce(F.lag(me).over(near), F.col("ahead"))
    return dealt.join(F.broadcast(ends), "range").select(*_GROUP, F.col("first.doc_id").alias("first_id"), F.col("first.h").alias("first_h"), prev.alias("prev")).select("*", *[F.col(f"prev.{c}").alias(f"to_{c}") for c in _GROUP]).drop("prev")


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows (doc_id, text, ...) with next_<c> for each of columns: the row's that follows by ascending doc_id, null last.

    After the last row comes the first; rows with the same doc_id follow each other by a hash of their texts, then by text. Rows
    travel once, to their group of ids; the first rows of a group also go to the group before.
    """
    placed = _grouped(rows)
    firsts = few_rows(_firsts(placed.select("doc_id", "h", *_GROUP)), FEW)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    a, b = placed.alias("a"), firsts.alias("b")
    on = same("a.block", "b.block") & same("a.doc_id", "b.first_id") & (F.col("a.h") == F.col("b.first_h"))
    for c in ("no_id", "own_id", "slice"):
        on = on & same(f"a.{c}", f"b.{c}")
    own = F.struct(*[F.col(f"a.{c}").alias(c) for c in _GROUP], F.lit(False).alias("guest"))
    guest = F.struct(*[F.col(f"b.to_{c}").alias(c) for c in _GROUP], F.lit(True).alias("guest"))
    sent = a.join(b, on, "left").select("a.doc_id", "a.text", *[f"a.{c}" for c in rows.columns if c not in ("doc_id", "text")], "a.h", F.explode(F.when(F.col("b.first_h").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("go"))
    order = W.partitionBy(*[f"go.{c}" for c in _GROUP]).orderBy("go.guest", F.col("doc_id").asc_nulls_last(), "h", "text")
    led = sent.select(*rows.columns, "go", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return led.filter(~F.col("go.guest")).drop("go")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text, edited, sketch, next_sketch, edited_sketch) for every row of docs.

    edited is the text whose last half, in code points and rounded down, is replaced by as many first code points of the
    next document, or all if it has fewer. Null texts count as empty. Repeated rows follow each other and come out
    repeated; one row follows itself; an empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    led = with_next(with_fingerprint(rows, "text", "sketch"), ["text", "sketch"])
    half = F.expr("length(text) div 2")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    return with_fingerprint(led.withColumn("edited", edited).drop("next_text"), "edited", "edited_sketch")
