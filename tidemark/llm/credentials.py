"""Secret scans: single patterns, and parts of credentials that count only together."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import free_name, lean, ship

#: Kinds in the order in which spans with the same start are listed; the first three stand on their own.
KINDS = ("assign", "access", "hex", "ident", "secret", "endpoint")
#: Code points between parts that may belong together.
REACH = 300
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
_ASSIGN_NEEDS = ("passw", "secret", "token", "api")
_IDENT = re.compile(r"""(?:client_?id|access_?key_?id|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}""", re.I | re.A)
_IDENT_NEEDS = ("client", "access", "user", "login")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"""(?:(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+|(?:host|endpoint|server|region)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{4,})""", re.I | re.A)
_ENDPOINT_NEEDS = ("://", "host", "endpoint", "server", "region")
_BLANK = re.compile(r"\n[ \t\r]*\n")


def _is_mixed(s: str) -> bool:
    """Whether a token looks drawn at random: capitals, small letters and digits, and many different characters."""
    return any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s) and len(set(s)) >= 12


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what single patterns find, leftmost and not overlapping within a kind; code points."""
    low = text.lower()
    out = []
    if any(x in low for x in _ASSIGN_NEEDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def _near(spans: list[tuple[int, int]], start: int, end: int, low: int, high: int) -> list[tuple[int, int]]:
    """The spans in the scope (low, high) within REACH of (start, end); spans are sorted and don't overlap."""
    first = bisect_left(spans, max(low, start - REACH), key=lambda s: s[1])
    out = []
    for s in spans[first:]:
        if s[0] > end + REACH or s[1] > high:
            break
        if s[0] >= low:
            out.append(s)
    return out


def linked_spans(text: str, base: list[tuple[str, int, int]]) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, int]]]:
    """(weak spans, links (identifier, secret, endpoint) by their starts, -1 for none).

    A secret's links name each identifier and each endpoint near it once, side by side in the order of the text.

    Scopes are the parts of a text between blank lines. A weak secret counts where an identifier is near it in its scope; a
    weak identifier and an endpoint count where they are near a secret that is strong or so linked.
    """
    strong_ids = sorted((a, b) for k, a, b in base if k == "access")
    strong = sorted((a, b) for k, a, b in base if k != "access")
    low = text.lower()
    weak_ids = [m.span() for m in _IDENT.finditer(text)] if any(x in low for x in _IDENT_NEEDS) else []
    if not (strong or strong_ids or weak_ids):
        return [], []
    taken = _union((a, b) for _, a, b in base)

    def apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        return [s for s in spans if not _covers(taken, s)]

    weak_ids = apart(weak_ids)
    ids = _disjoint(sorted(strong_ids + weak_ids))
    ends = [m.span() for m in _ENDPOINT.finditer(text)] if any(x in low for x in _ENDPOINT_NEEDS) else []
    endpoints = apart(ends)
    within = _union(ids + ends)
    weak = [s for s in apart([m.span() for m in _SECRET.finditer(text) if _is_mixed(m[0])]) if not _covers(within, s)]
    if not (weak or strong):
        return [], []
    cuts = [0, *[m.end() for m in _BLANK.finditer(text)], len(text) + 1]

    def scope(at: int) -> tuple[int, int]:
        i = bisect_left(cuts, at + 1) - 1
        return cuts[i], cuts[i + 1]

    found: set[tuple[str, int, int]] = set()
    links: list[tuple[int, int, int]] = []
    weak_id_set, strong_set = set(weak_ids), set(strong)
    for s in sorted(strong + weak):
        here = scope(s[0])
        near_ids = _near(ids, *s, *here)
        if not near_ids and s not in strong_set:
            continue
        near_ends = _near(endpoints, *s, *here)
        links += [(i[0], s[0], e[0]) for i, e in zip_longest(near_ids, near_ends, fillvalue=(-1, -1))]
        found.add(("secret", *s))
        found.update(("ident", *i) for i in near_ids if i in weak_id_set)
        found.update(("endpoint", *e) for e in near_ends)
    return [x for x in found if x[1:] not in strong_set], links


def _disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def _union(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order that cover what spans cover and don't overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _covers(spans: list[tuple[int, int]], s: tuple[int, int]) -> bool:
    """Whether s overlaps one of spans, which are in order and don't overlap."""
    i = bisect_left(spans, s)
    return any(x < s[1] and y > s[0] for x, y in spans[max(0, i - 1) : i + 1])


def scan_text(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, int]]]:
    """All spans of a text by start, then kind, and the links between parts."""
    if not text:
        return [], []
    base = base_spans(text)
    more, links = linked_spans(text, base)
    return sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]))), links


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_LINKS = T.ArrayType(T.StructType([T.StructField("ident", T.IntegerType()), T.StructField("secret", T.IntegerType()), T.StructField("endpoint", T.IntegerType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_ARROW_LINKS = pa.list_(pa.struct([("ident", pa.int32()), ("secret", pa.int32()), ("endpoint", pa.int32())]))


def scan(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (default doc_id), spans (kind, start, end) and links (ident, secret, endpoint) for every row.

    Offsets are code points, ends exclusive. Null and empty texts have none; repeated rows come out repeated; an empty
    table gives an empty one. A name that a kept column has gets underscores in front.
    """
    ship(docs.sparkSession)
    keep = keep or ["doc_id"]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias(free_name(docs, "scanned_text")))
    kept = rows.drop(rows.columns[-1])
    schema = T.StructType([*kept.schema.fields, T.StructField(free_name(kept, "spans"), _SPANS), T.StructField(free_name(kept, "links"), _LINKS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan_text(t) for t in b.column(b.num_columns - 1).to_pylist()]
            spans = pa.array([[{"kind": k, "start": a, "end": e} for k, a, e in s] for s, _ in found], _ARROW_SPANS)
            links = pa.array([[{"ident": i, "secret": s, "endpoint": e} for i, s, e in x] for _, x in found], _ARROW_LINKS)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], spans, links], names=schema.names)

    return rows.mapInArrow(lean(run), schema)


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in angle brackets; overlapping spans go as one, under the first.

    Null and empty texts stay as they are, repeated rows come out repeated, an empty table empty. Other columns pass as
    they are, whatever their names.
    """
    ship(docs.sparkSession)
    at = docs.columns.index("text")
    schema = docs.schema

    def clean(text: str | None) -> str | None:
        spans = scan_text(text)[0]
        if not spans:
            return text
        out, reach, last = [], 0, -1
        for kind, a, b in spans:
            if a >= reach:
                out.append(text[reach:a])
                out.append(f"<{kind}>")
            reach, last = max(reach, b), a
        return "".join([*out, text[reach:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([clean(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:at], texts, *b.columns[at + 1 :]], names=b.schema.names)

    return docs.mapInArrow(lean(run), schema)
