"""Quality rules on the repetition within a text, read off a suffix array of its words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import suffixes, words
from tidemark.llm.common import free_name, lean, ship

#: A repeat counts from so many words on.
MIN_REPEAT = 10
#: The largest part of the words that repeats may cover, and the longest repeat, in words.
MAX_COVERED, MAX_REPEAT = 0.2, 100
#: Words whose suffixes are sorted together.
CHUNK = 400_000
_SYMBOL = np.zeros(256, np.bool_)
_SYMBOL[list(b"#*$%&|<>")] = True
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def repetition(ids: np.ndarray, bounds: np.ndarray, min_repeat: int = MIN_REPEAT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: words in repeated 3-word windows, words that repeats of min_repeat words or more cover, longest repeat.

    ids are the words of all texts; repeats never cross texts.
    """
    out = [np.zeros(len(bounds) - 1, np.int64) for _ in range(3)]
    for first, end in words.chunks(bounds, CHUNK):
        own = bounds[first : end + 1] - bounds[first]
        n = int(own[-1])
        if not n:
            continue
        text = np.repeat(np.arange(end - first), np.diff(own))
        symbols = text * (int(ids.max()) + 1) + ids[bounds[first] : bounds[end]]
        sa, ranks = suffixes.suffix_array(symbols)
        longest = suffixes.longest_repeats(sa, suffixes.adjacent_lcp(sa, ranks))
        windows = np.flatnonzero(longest >= 3)
        out[0][first:end] = words.totals(suffixes.covered(windows, np.full(len(windows), 3), n), own)
        spans = np.flatnonzero(longest >= min_repeat)
        out[1][first:end] = words.totals(suffixes.covered(spans, longest[spans], n), own)
        filled = np.flatnonzero(np.diff(own))
        out[2][first + filled] = np.maximum.reduceat(longest, own[filled])
    return out[0], out[1], out[2]


def _dup_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _measure(min_repeat: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).cast(pa.large_string()).fill_null("")
            flat, bounds = words.split(texts)
            chars = words.totals(pc.utf8_length(flat).to_numpy(), bounds)
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            body = texts.buffers()[2]
            raw = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
            symbols = words.totals(_SYMBOL[raw], offsets - offsets[0])
            dup = [_dup_lines(t.as_py()) for t in texts.cast(pa.large_binary())]
            ids = pc.dictionary_encode(flat).indices.to_numpy().astype(np.int64)
            found = [np.diff(bounds), chars, symbols, np.array(dup, np.int64), *repetition(ids, bounds, min_repeat)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(x.astype(np.int64)) for x in found]], names=[*b.schema.names[:-1], *COLUMNS])

    return run


def measure(docs: DataFrame, keep: list[str] | None = None, min_repeat: int = MIN_REPEAT) -> DataFrame:
    """The columns in keep (default doc_id) and the figures in COLUMNS (long) for every row of docs.

    Null texts have no words and no lines: all figures are 0. Repeated rows come out repeated, an empty table empty.
    Other columns of docs are not read, so clashing names do no harm; a kept column named like a figure is refused.
    """
    ship(docs.sparkSession)
    keep = keep or ["doc_id"]
    if clash := {c.lower() for c in keep} & set(COLUMNS):
        raise ValueError(f"columns {sorted(clash)} clash with the figures")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias(free_name(docs, "measured_text")))
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(c, T.LongType()) for c in COLUMNS]])
    return rows.mapInArrow(lean(_measure(min_repeat)), schema)


def judge(figures: DataFrame, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """figures with base_failed and kept.

    The base fails texts under 50 words, or with over half of the words in repeated 3-word windows. Of the others the
    method keeps those whose repeats cover at most max_covered of the words and span at most max_repeat words.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = (F.col("covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_repeat)
    return figures.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & good)
