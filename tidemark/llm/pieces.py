"""SentencePiece encoding and decoding for merge-type vocabularies.

A text becomes symbols, one for each character; an agenda of adjacent pairs, ordered by the score of the piece that a pair
makes and then from the left, gives the next merge until no pair makes a piece. Characters without a piece become bytes.
As no piece goes from another character into a space mark, and none of several characters has a line feed, a text falls into segments that
never merge with each other; a worker remembers the ids of segments and what these ids decode to. In each Arrow batch the
library encodes and decodes two whole texts and a sample of the new segments; any difference stops the job.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import free_name, lean, ship

MARK = "▁"
#: Bytes of segments in each of the four generations that a worker remembers: see Memory.
REMEMBERED = 1 << 25
#: Of so many distinct segments one is held against the library when it is first met.
SAMPLED = 16
#: From so many symbols on the agenda is a heap; below, a list.
HEAP_FROM = 48
_NEVER = 1 << 60
_SEGMENT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def model_bytes(path: str) -> bytes:
    """The model file, read where the driver runs; refused unless it is of the kind this module encodes."""
    from pathlib import Path

    from sentencepiece import sentencepiece_model_pb2

    data = Path(path).read_bytes()
    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(data)
    n = m.normalizer_spec
    plain = n.name == "identity" and n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces
    if m.trainer_spec.model_type != 2 or not plain or not m.trainer_spec.byte_fallback or m.trainer_spec.treat_whitespace_as_suffix or any(p.type in (4, 5) for p in m.pieces):
        raise ValueError(f"{path} is not a merge-type vocabulary with identity normalisation, dummy prefix and byte fallback")
    if any(p.type == 1 and (re.search(f"[^{MARK}]{MARK}", p.piece) or len(p.piece) > 1 and "\n" in p.piece) for p in m.pieces):
        raise ValueError(f"{path} has pieces that cross segments")
    return data


class Memory(dict):
    """What make(key) gives, remembered for keys that come again, within a bound in bytes.

    A key is on probation when it is first met, and enters the dict when it is met again, so keys that come once don't
    push others out. Each part is kept in two generations of most bytes at most, by weigh(key, value); a value that
    weighs over a hundredth of that is never kept.
    """

    def __init__(self, make, weigh, most: int):
        super().__init__()
        self.make, self.weigh, self.most = make, weigh, most
        self.forget()

    def __missing__(self, key: str):
        value = self.old.get(key) or self.once.get(key) or self.once_old.get(key)
        met = value is not None
        if not met:
            value = self.make(key)
        size = self.weigh(key, value)
        if 100 * size > self.most:
            return value
        if met:
            if self.held + size > self.most:
                self.old, self.held = dict(self), 0
                self.clear()
            self[key] = value
            self.held += size
        else:
            if self.held_once + size > self.most:
                self.once_old, self.once, self.held_once = self.once, {}, 0
            self.once[key] = value
            self.held_once += size
        return value

    def forget(self) -> None:
        self.clear()
        self.old, self.once, self.once_old = {}, {}, {}
        self.held = self.held_once = 0


def _weight(key: str, value: tuple[str, str]) -> int:
    """About the bytes that an entry takes: four for each character, and what Python adds for three strings, a pair and a slot."""
    return 420 + 4 * (len(key) + len(value[1])) + len(value[0])


class Coder:
    """Encodes and decodes texts as the library does with the same model."""

    def __init__(self, model: bytes, remembered: int = REMEMBERED):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        self.kind = ["byte" if lib.is_byte(i) else "control" if lib.is_control(i) else "unknown" if lib.is_unknown(i) else "" for i in range(size)]
        normal = [i for i in range(size) if not self.kind[i]]
        self.special = {i for i in range(size) if self.kind[i]}
        by_score = sorted({lib.get_score(i) for i in normal}, reverse=True)
        place = {s: k for k, s in enumerate(by_score)}
        self.ids = {self.pieces[i]: i for i in normal}
        self.rank = {self.pieces[i]: place[lib.get_score(i)] for i in normal}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.mark = self.ids[MARK]
        self.end = lib.eos_id()
        self.words = Memory(self._coded, _weight, remembered)

    def merge(self, symbols: str) -> list[int]:
        """The ids of a run of symbols, by the agenda alone."""
        parts = self._merge_list(list(symbols)) if len(symbols) < HEAP_FROM else self._merge_heap(symbols)
        out: list[int] = []
        for p in parts:
            i = self.ids.get(p)
            if i is None:
                out.extend(self.bytes[b] for b in p.encode())
            else:
                out.append(i)
        return out

    def _merge_list(self, parts: list[str]) -> list[str]:
        rank = self.rank.get
        agenda = [rank(a + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while agenda:
            best = min(agenda)
            if best == _NEVER:
                break
            i = agenda.index(best)
            parts[i] += parts.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = rank(parts[i - 1] + parts[i], _NEVER)
            if i < len(agenda):
                agenda[i] = rank(parts[i] + parts[i + 1], _NEVER)
        return parts

    def _merge_heap(self, symbols: str) -> list[str]:
        parts: list[str] = list(symbols)
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank = self.rank.get
        agenda = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, made = heapq.heappop(agenda)
            j = after[i]
            if j >= n or not parts[i] or parts[i] + parts[j] != made:
                continue
            parts[i], parts[j] = made, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(made + parts[k])) is not None:
                    heapq.heappush(agenda, (r, i, made + parts[k]))
            if (h := before[i]) >= 0 and (r := rank(parts[h] + made)) is not None:
                heapq.heappush(agenda, (r, h, parts[h] + made))
        return [p for p in parts if p]

    def _coded(self, key: str) -> tuple[str, str]:
        """(ids of a key of keys() in decimal, the text that they decode to)."""
        if key[:1] == "\n":
            ids = [self.bytes[10], *(self.merge(key[1:]) if len(key) > 1 else [])]
        else:
            ids = self.merge(key[1:] if key[:1] == "\0" else MARK + key)
        if crc32(key.encode()) % SAMPLED == 0:
            self.hold(key, ids)
        return " ".join(map(str, ids)), self.decode_run(ids)

    def hold(self, key: str, ids: list[int]) -> None:
        """Raise unless the library gives these ids to a key of keys()."""
        if key[:1] == "\n":
            theirs = self.library.encode(key)[1:]
        elif key[:1] == "\0":
            theirs = self.library.encode("\n" + key[1:])[2:]
        else:
            theirs = self.library.encode(key) if key else self.library.encode("\n")[:1]
        if ids != theirs:
            raise RuntimeError(f"segment {key!r}: the agenda gives {ids}, the library {theirs}")

    def keys(self, text: str) -> list[str]:
        """Segments of a text: a word stands for itself after a space mark; one after a line feed has it in front; other
        segments have a zero in front."""
        if not text:
            return []
        if text[0] != " " and "  " not in text and MARK not in text and "\0" not in text:
            return text.replace("\n", " \n").split(" ")
        out = []
        for s in _SEGMENT.findall(MARK + text.replace(" ", MARK)):
            if s == "\n":
                out.append(s)
            elif s[0] == MARK and s[1:2] != MARK and s[1:2] != "\0":
                out.append(s[1:])
            else:
                out.append("\0" + s)
        return out

    def coded_text(self, text: str) -> tuple[str, str]:
        """(decimal ids of a text with the end id, joined by one space; the text that these ids decode to).

        The decoded text is that of the segments' ids in a row, less the space of the mark put in front. A segment's bytes
        are whole characters, so no run of bytes needs its neighbours.
        """
        found = [self.words[k] for k in self.keys(text)]
        if not found:
            return str(self.end), ""
        decoded = "".join([x[1] for x in found])
        ids = " ".join([x[0] for x in found])
        if not self.kind[int(ids.split(" ", 1)[0])] and decoded[:1] == " ":
            decoded = decoded[1:]
        return f"{ids} {self.end}", decoded

    def encode_text(self, text: str) -> str:
        """The decimal ids of a text, with the end id, joined by one space."""
        return self.coded_text(text)[0]

    def decode_run(self, ids: list[int]) -> str:
        """Pieces as text, space marks as spaces, bytes as UTF-8, broken ones as U+FFFD each; controls give nothing."""
        if not self.special.intersection(ids):
            return "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
        out, held = [], bytearray()
        for i in ids:
            kind = self.kind[i]
            if kind == "byte":
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            if kind == "unknown":
                out.append(" ⁇ ")
            elif not kind:
                out.append(self.pieces[i].replace(MARK, " "))
        if held:
            out.append(_utf8(bytes(held)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.decode_run(ids)
        first = next((i for i in ids if self.kind[i] != "control"), None)
        return text[1:] if first is not None and not self.kind[first] and text.startswith(" ") else text

    def hold_text(self, text: str, ids: str, decoded: str) -> None:
        """Raise unless the library encodes text to ids and decodes these to decoded."""
        theirs = [*self.library.encode(text), self.end]
        if ids != " ".join(map(str, theirs)) or decoded != self.library.decode(theirs):
            raise RuntimeError(f"text of {len(text)} characters, {text[:80]!r}: the library encodes or decodes it otherwise")


def _utf8(data: bytes) -> str:
    """Bytes as UTF-8, U+FFFD for each byte that isn't part of a character."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


_coders: dict[tuple[bytes, int], Coder] = {}


def coder(model: bytes, remembered: int = REMEMBERED) -> Coder:
    """The worker's coder for a model."""
    key = (hashlib.md5(model).digest(), remembered)
    if key not in _coders:
        _coders[key] = Coder(model, remembered)
    return _coders[key]


def _texts(b: pa.RecordBatch) -> list[str]:
    return [x or "" for x in b.column(b.num_columns - 1).to_pylist()]


def _coded_batch(c: Coder, texts: list[str]) -> list[tuple[str, str]]:
    """coded_text() of the texts; the first and the shortest are held against the library."""
    out = [c.coded_text(t) for t in texts]
    for i in {0, min(range(len(texts)), key=lambda i: len(texts[i]))} if texts else ():
        c.hold_text(texts[i], *out[i])
    return out


def _rows(docs: DataFrame, keep: list[str]) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias(free_name(docs, "encoded_text")))


def _schema(rows: DataFrame, **made: T.DataType) -> T.StructType:
    """The kept columns and those made, under names that no kept column has."""
    kept = rows.drop(rows.columns[-1])
    return T.StructType([*kept.schema.fields, *[T.StructField(free_name(kept, n), t) for n, t in made.items()]])


def _broadcast(spark: SparkSession, path: str | None):
    ship(spark)
    return spark.sparkContext.broadcast(model_bytes(path or default_model()))


def encode(docs: DataFrame, model_path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (default doc_id), ids array<int> with the end id, and decoded, the text that the ids give back.

    Null texts count as empty and have the end id alone. Repeated rows come out repeated, an empty table empty; a name that
    a kept column has gets underscores in front. The model file, of fixed size, is broadcast.
    """
    keep = keep or ["doc_id"]
    model = _broadcast(docs.sparkSession, model_path)
    rows = _rows(docs, keep)
    schema = _schema(rows, ids=T.ArrayType(T.IntegerType()), decoded=T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model.value)
        for b in batches:
            coded = _coded_batch(c, _texts(b))
            ids = pa.array([list(map(int, x.split(" "))) for x, _ in coded], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids, pa.array([x for _, x in coded], pa.string())], names=schema.names)

    return rows.mapInArrow(lean(run), schema)


def digests(docs: DataFrame, model_path: str | None = None, keep: list[str] | None = None, remembered: int = REMEMBERED, over_tasks: bool = False) -> DataFrame:
    """As encode(), with n_tokens, ids_sha256 and decoded_sha256 in place of ids and text.

    Neither ids nor decoded text leave the worker: their digests do. remembered bounds what a worker remembers, in bytes
    of one generation of four; more of it trades memory for merging fewer segments again; so does over_tasks, by which a
    worker remembers them from one task to the next.
    """
    keep = keep or ["doc_id"]
    model = _broadcast(docs.sparkSession, model_path)
    rows = _rows(docs, keep)
    schema = _schema(rows, n_tokens=T.LongType(), ids_sha256=T.StringType(), decoded_sha256=T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model.value, remembered)
        for b in batches:
            coded = _coded_batch(c, _texts(b))
            n = [x.count(" ") + 1 for x, _ in coded]
            of_ids, of_text = ([hashlib.sha256(x[k].encode()).hexdigest() for x in coded] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=schema.names)
        if not over_tasks:
            c.words.forget()

    return rows.mapInArrow(lean(run), schema)
