"""Mixing sources to target weights, with DataFrame functions alone.

Rows get hash-random keys. Within a source they are ordered by key in ranges: a range is a key's first three digits, so a
source of any size spreads over 4096 groups. Sums of the ranges, then of the rows within a range, give every row the words
before it; the source's budget cuts there, after as many whole epochs as it holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import by_range, cut, few_rows, n_words

WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
MAX_EPOCHS = 3
SEED = "mix-1"
FEW_SOURCES = 50_000


def _keyed(docs: DataFrame, seed: str) -> DataFrame:
    """s: the source after "=", or empty for null. Sorting by s = "" and s is by code point with null last."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("s"),
        n_words(F.col("text").cast("string")).alias("size"),
        _key(seed).alias("key"),
    ).withColumn("part", F.substring("key", 1, 3))


def _key(seed: str):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).cast("binary"))


def _sources(parts: DataFrame, weights: tuple, most: float) -> DataFrame:
    """(s, source_size, target, epochs, rest) from sums of ranges; a row for each source.

    The shares fill up like water: with the sources in order of cap / weight, the level is the largest of what the
    sources from one on would get for each unit of weight if all before it stood at their caps.
    """
    sizes = parts.groupBy("s").agg(F.sum("part_size").alias("source_size"))
    named = _before(sizes, [(F.col("s") == "").cast("int"), F.col("s")], place=F.lit(1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = named.select("s", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    filled = _before(weighed, [F.col("cap") / F.col("weight"), F.col("s")], capped=F.col("cap"), used=F.col("weight"))
    totals = filled.agg(F.sum("source_size").cast("double").alias("total"), F.sum("weight").alias("weights"))
    level = filled.crossJoin(F.broadcast(totals)).agg(F.max((F.col("total") - F.col("capped")) / (F.col("weights") - F.col("used"))).alias("level"))
    target = filled.crossJoin(F.broadcast(level)).select("s", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0)
    return target.withColumn("epochs", epochs.cast("long")).withColumn("rest", (budget - F.col("epochs") * F.col("source_size")).cast("long"))


def _before(rows: DataFrame, order: list, **sums) -> DataFrame:
    """rows with a column for each of sums: its sum over the rows that come before by order, 0 for the first.

    Rows are dealt by ranges of order; only the sums of whole ranges, a row for each, meet in one task.
    """
    dealt = by_range(rows, *order)
    ahead = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    within = W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    whole = dealt.groupBy("range").agg(*[F.sum(c).alias(n) for n, c in sums.items()]).select("range", *[F.coalesce(F.sum(n).over(ahead), zero).alias(f"{n}_ahead") for n in sums])
    met = dealt.join(F.broadcast(whole), "range")
    return met.select(*rows.columns, *[(F.coalesce(F.sum(c).over(within), zero) + F.col(f"{n}_ahead")).alias(n) for n, c in sums.items()])


def _planned(rows: DataFrame, weights: tuple, most: float) -> DataFrame:
    """Keyed rows with before, the words of their source that come first, and their source's figures."""
    parts = cut(rows.groupBy("s", "part").agg(F.sum("size").alias("part_size")))
    offsets = parts.select("s", "part", (F.sum("part_size").over(W.partitionBy("s").orderBy("part")) - F.col("part_size")).alias("offset"))
    within = W.partitionBy("s", "part").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.withColumn("before", F.sum("size").over(within) - F.col("size")).join(offsets, ["s", "part"])
    return placed.withColumn("before", F.col("before") + F.col("offset")).join(few_rows(_sources(parts, weights, most), FEW_SOURCES), "s")


def plan(docs: DataFrame, weights: tuple = WEIGHTS, most: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs.

    A size is a text's number of words, 0 for null. Sources by code point, null last, weigh weights in turn; they share
    all words, none above most times its own, what is over going to the others by weight. taken is the number of words
    that the mix takes, repeats counted: whole epochs, then in key order up to the budget, so the last document may be
    taken in part. A source's taken words add up to its target rounded down. Rows with the same doc_id keep their order by
    size; repeated rows come out repeated; an empty table gives an empty one. Reruns agree, for keys depend on doc_id alone.
    """
    rows = cut(_keyed(docs, seed))
    last = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before")))
    return _planned(rows, weights, most).select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; a row for each copy, with the columns of docs.

    As plan(), in whole documents: of the last epoch a source gives those of which at least half lies within its budget.
    Each document is compared with the key at which its source was cut, so the documents are not shuffled unless there
    are more than FEW_SOURCES sources.
    """
    rows = cut(_keyed(docs, seed))
    planned = _planned(rows, weights, most)
    taken = 2 * F.col("before") + F.col("size") <= 2 * F.col("rest")
    cuts = planned.groupBy("s").agg(F.first("epochs").alias("epochs"), F.max(F.when(taken & (F.col("rest") > 0), F.struct("key", "doc_id", "size"))).alias("cut_at"))
    s = F.coalesce(F.concat(F.lit("="), F.col("d.source").cast("string")), F.lit(""))
    here = F.struct(F.col("k").alias("key"), F.col("d.doc_id").cast("long").alias("doc_id"), F.col("z").alias("size"))
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), _key(seed).alias("k"), n_words(F.col("text").cast("string")).alias("z"))
    cuts = cut(cuts)
    # a row for each source: up to FEW_SOURCES go to every task, so documents stay where they are
    found = marked.withColumn("s", s).join(F.broadcast(cuts) if cuts.count() <= FEW_SOURCES else cuts, "s")
    copies = (F.col("epochs") + F.when(here <= F.col("cut_at"), 1).otherwise(0)).cast("int")
    return found.select(F.explode(F.array_repeat("d", copies)).alias("d")).select("d.*")
