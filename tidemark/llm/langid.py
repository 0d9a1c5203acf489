"""Language identification by mixture inference.

A model holds, for each language, how likely each letter trigram (of bytes, hashed to BUCKETS) is within words. A text's
words come from a mixture of languages; expectation-maximisation finds the proportions, and a language stays in the mixture
only if leaving it out costs more log-likelihood than a penalty for each parameter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import words
from tidemark.llm.common import cut, free_name, lean, ship

BUCKETS = 1 << 14
#: Words times languages that a task infers on at once, and steps of expectation-maximisation.
CELLS, STEPS = 1 << 18, 8
#: Added to every trigram's count; the least that a word's likelihood in a language counts against its best.
SMOOTH, FLOOR = 0.1, np.float32(1e-6)
UNKNOWN = "und"
#: Languages that a model may have; a table with more labels is refused, for a model of any size would not fit a worker.
MOST = 512
#: Languages that a task counts at once.
COUNTED = 64
_LETTER = re.compile(r"[^\W\d_]")


def _trigrams(flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, bounds) of the trigrams of each lower-cased word with a space on both sides."""
    lowered = pc.utf8_lower(flat).cast(pa.large_string())
    n = len(lowered)
    offsets = np.frombuffer(lowered.buffers()[1], np.int64)[lowered.offset : lowered.offset + n + 1] if n else np.zeros(1, np.int64)
    sizes = np.diff(offsets)
    raw = np.full(int(sizes.sum()) + 2 * n, 32, np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes + 2)))
    body = np.frombuffer(lowered.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if n and lowered.buffers()[2] is not None else np.zeros(0, np.uint8)
    place = np.arange(len(body)) + np.repeat(2 * np.arange(n) + 1, sizes)
    raw[place] = body
    x = raw.astype(np.uint32)
    grams = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:] if len(x) > 2 else np.zeros(0, np.uint32)
    hashed = (grams * np.uint32(2654435761)) >> np.uint32(18)
    # a word of n bytes has n trigrams, each around one of its bytes
    first = place - 1
    return hashed[first].astype(np.int64), np.concatenate(([0], np.cumsum(sizes)))


def _count():
    """(lang, text) come in; (lang, bucket, n) go out: trigram counts of a partition, a language's once or more."""

    def flush(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, own in sorted(counts.items()):
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "bucket", "n"])
        counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            flat, bounds = words.split(b.column(1))
            coded = flat.dictionary_encode()
            if not len(flat):
                continue
            ids = coded.indices.to_numpy()
            buckets, ends = _trigrams(coded.dictionary)
            sizes = np.diff(ends)
            langs = b.column(0).dictionary_encode()
            of = np.repeat(langs.indices.to_numpy(), np.diff(bounds))
            for k, name in enumerate(langs.dictionary.to_pylist()):
                times = np.bincount(ids[of == k], minlength=len(sizes))
                own = np.bincount(buckets, weights=np.repeat(times, sizes), minlength=BUCKETS).astype(np.int64)
                counts[name] = counts.get(name, 0) + own
                if len(counts) >= COUNTED:
                    yield from flush(counts)
        yield from flush(counts)

    return run


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihoods of shape (BUCKETS, languages)) from all rows with a lang and a text.

    Counts are summed where the rows are; the model has BUCKETS figures for each language, whatever the data's size. More
    than MOST languages are a ValueError.
    """
    ship(labelled.sparkSession)
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    summed = rows.mapInArrow(lean(_count()), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = cut(summed.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("counts")))
    if (n := found.count()) > MOST:
        raise ValueError(f"lang has {n} values; a model may have {MOST}")
    got = found.orderBy("lang").toArrow()
    table = np.full((BUCKETS, n), SMOOTH)
    for k in range(n):
        table[got["buckets"][k].values.to_numpy(), k] += got["counts"][k].values.to_numpy()
    return got["lang"].to_pylist(), np.log(table / table.sum(axis=0)).astype(np.float32)


def mixtures(likely: np.ndarray, bounds: np.ndarray, penalty: float) -> np.ndarray:
    """Proportions of languages for texts with at least one word each; likely: each word's likelihoods, largest 1."""
    n, k = len(bounds) - 1, likely.shape[1]
    sizes = np.diff(bounds)
    starts = bounds[:-1]
    shares = np.full((n, k), 1 / k, np.float32)

    def refine(steps: int) -> None:
        for _ in range(steps):
            part = likely * np.repeat(shares, sizes, axis=0)
            part /= part.sum(axis=1, keepdims=True)
            shares[:] = np.add.reduceat(part, starts, axis=0) / sizes[:, None]

    refine(STEPS)
    # each language but the first is left out where that costs less than the penalty, the smallest share first
    cost = penalty * np.log(sizes + 1)
    order = np.argsort(shares, axis=1)
    for place in range(k - 1):
        out = order[:, place]
        without = shares.copy()
        without[np.arange(n), out] = 0
        without /= without.sum(axis=1, keepdims=True)
        full = np.log((likely * np.repeat(shares, sizes, axis=0)).sum(axis=1))
        less = np.log((likely * np.repeat(without, sizes, axis=0)).sum(axis=1) + np.float32(1e-12))
        loss = np.add.reduceat(full - less, starts)
        drop = loss < cost
        shares[drop] = without[drop]
    refine(STEPS // 2)
    return shares


def _infer(model, names: list[str], penalty: float, threshold: float = 0.02):
    mix_type = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, table = model.value
        k = len(languages)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            flat, bounds = words.split(texts)
            n = len(texts)
            shares = np.zeros((n, k), np.float32)
            if k and len(flat):
                coded = flat.dictionary_encode()
                buckets, ends = _trigrams(coded.dictionary)
                sums = np.zeros((len(buckets) + 1, k), np.float64)
                np.cumsum(table[buckets], axis=0, dtype=np.float64, out=sums[1:])
                scores = sums[ends[1:]] - sums[ends[:-1]]
                likely = np.maximum(np.exp(scores - scores.max(axis=1, keepdims=True)), FLOOR).astype(np.float32)
                ids = coded.indices.to_numpy()
                for first, end in words.chunks(bounds, max(1, CELLS // k)):
                    own = bounds[first : end + 1]
                    filled = np.flatnonzero(np.diff(own))
                    if len(filled):
                        at = np.append(own[filled], own[-1]) - own[0]
                        shares[first + filled] = mixtures(likely[ids[own[0] : own[-1]]], at, penalty)
            lettered = [bool(t and _LETTER.search(t)) for t in texts.to_pylist()]
            found, scores_, mixes = [], [], []
            for row, letters in zip(shares.tolist(), lettered, strict=True):
                if not letters or not k:
                    found.append(UNKNOWN)
                    scores_.append(0.0)
                    mixes.append([])
                    continue
                best = max(range(k), key=row.__getitem__)
                found.append(languages[best])
                scores_.append(min(1.0, row[best]))
                mixes.append([{"lang": languages[i], "share": row[i]} for i in sorted(range(k), key=lambda i: -row[i]) if row[i] >= threshold])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.string()), pa.array(scores_, pa.float64()), pa.array(mixes, mix_type)], names=names)

    return run


def held_out(doc_id: str = "doc_id"):
    """Whether a row is never learned from: crc32 of doc_id as text, mod 4, is 2. A null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, labelled: DataFrame, keep: list[str] | None = None, penalty: float = 2.0) -> DataFrame:
    """The columns in keep (default doc_id), lang_pred, score and mixture for every row of docs.

    labelled gives (lang, text) to learn from. lang_pred is the language with the largest share, score that share, mixture
    all languages kept with their shares; a name that a kept column has gets underscores in front (common.free_name).
    Texts that are null or have no letter, and all if nothing could be learned, are und with score 0. Repeated rows come
    out repeated, an empty table empty.
    """
    spark = docs.sparkSession
    ship(spark)
    keep = keep or ["doc_id"]
    model = spark.sparkContext.broadcast(train(labelled))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias(free_name(docs, "judged_text")))
    mix = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    made = zip((free_name(kept, n) for n in ("lang_pred", "score", "mixture")), (T.StringType(), T.DoubleType(), mix), strict=True)
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(n, t) for n, t in made]])
    return rows.mapInArrow(lean(_infer(model, schema.names, penalty)), schema)
