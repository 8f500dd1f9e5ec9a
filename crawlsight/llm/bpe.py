"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over 16 bytes cuts every text where the hash says so, so a
passage that several documents share is cut alike in each of them. A Python
worker encodes each different chunk once and keeps its ids in a bounded cache; a document is put together
from the ids of its chunks. At a join the ids may differ from those of the whole
text, so the join is encoded again from the last sure boundary before it to the
first sure boundary after it, and taken in place of the ids there unless they
agree. Where a chunk holds no sure boundary, the window grows over the next
chunks until one does.

A sure boundary is ASCII white space after a character that is none, or a
fullwidth comma or full stop after an ideograph: the pattern that splits a text
before merging (letters, digits, other characters, each with one leading space at
most; white space) always starts a piece there, whatever stands around it. Chunks
never cut a special token.

Defined cases: a null text is encoded as an empty one, with no ids; texts may be
of any length; repeated rows give repeated results; other columns stay.

The merges come from a ``tokenizers`` file (byte-level BPE). They are applied by
``tiktoken``, which is several times faster; a test compares the two over every
assigned code point.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, read_table, slices, utf8_view

#: The pattern of byte-level BPE files (a fixed value).
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WINDOW, CUT_BITS = 16, 10
#: Bytes of chunks that a task remembers.
CACHE_BYTES = 8 << 20
#: Ids that are put together at a time.
DECODED = 1 << 16

_ROLL = np.uint32(0x01000193)
_SCATTER = np.uint32(0x9E3779B1)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The bytes that a byte-level vocabulary's characters stand for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Ids of bytes and bytes of ids for one vocabulary file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path}: byte-level BPE without prefix space or normaliser is asked for")
        as_byte = _byte_of_char()
        ranks = {bytes(as_byte[c] for c in token): i for token, i in model["vocab"].items() if all(c in as_byte for c in token)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content in self.special:
            if model["vocab"].get(content) is not None:
                ranks.pop(content.encode(), None)
        order = [ranks[b"".join(bytes(as_byte[c] for c in part) for part in (m.split(" ") if isinstance(m, str) else m))] for m in model["merges"]]
        if order != sorted(order):
            raise ValueError(f"{path}: ids don't follow the order of the merges")
        self._engine = tiktoken.Encoding("file", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        pieces = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
        for piece, i in ranks.items():
            pieces[i] = piece
        for content, i in self.special.items():
            pieces[i] = content.encode()
        # One array, not an object for each piece: objects that live as long as the worker keep what was freed around them from going back.
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self._starts = np.cumsum(self.lengths) - self.lengths
        self._bytes = np.frombuffer(b"".join(pieces), np.uint8)
        ranks.clear()  # the engine has its own copy
        self._specials = [s.encode() for s in self.special]

    def encode(self, raw: bytes) -> np.ndarray:
        text = raw.decode("utf-8")
        if any(s in raw for s in self._specials):
            return np.asarray(self._engine.encode(text, allowed_special="all"), np.int32)
        return np.asarray(self._engine.encode_ordinary(text), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        out = []
        for at in range(0, len(ids), DECODED):
            own = ids[at : at + DECODED]
            n = self.lengths[own]
            ends = np.cumsum(n)
            out.append(self._bytes[np.arange(ends[-1]) + np.repeat(self._starts[own] - ends + n, n)].tobytes())
        return b"".join(out).decode("utf-8", "replace")

    def guarded(self, raw: bytes) -> list[tuple[int, int]]:
        """Where special tokens lie."""
        found = []
        for s in self._specials:
            at = raw.find(s)
            while at >= 0:
                found.append((at, at + len(s)))
                at = raw.find(s, at + len(s))
        return found


def cuts(raw: np.ndarray, offsets: np.ndarray, bits: int = CUT_BITS) -> np.ndarray:
    """Positions at which the rolling hash cuts; never inside a character or in a text's first bytes."""
    if len(raw) <= WINDOW:
        return np.zeros(0, np.int64)
    h = raw.astype(np.uint32) + np.uint32(1)
    step, power = 1, _ROLL
    while step < WINDOW:  # h[i] covers the step bytes up to i
        grown = h.copy()
        grown[step:] += h[:-step] * power
        h, step, power = grown, step * 2, np.uint32((int(power) * int(power)) & 0xFFFFFFFF)
    at = np.flatnonzero((h * _SCATTER) >> np.uint32(32 - bits) == 0) + 1
    at = at[at < len(raw)]
    at = at[(raw[at] & 0xC0) != 0x80]
    start = offsets[np.searchsorted(offsets, at, side="right") - 1]
    return at[at - start >= WINDOW]


#: Bytes after which white space begins a piece: printable ASCII, and those beyond ASCII that end no white space.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_SOLID[0x80:0xC0] = True
_SOLID[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False
_GAP = np.zeros(256, bool)
_GAP[[0x09, 0x0A, 0x0D, 0x20]] = True


def _sync(raw: bytes) -> tuple[int, int]:
    """A sure boundary near the start of a chunk and one near its end, or -1."""
    first, last = raw.find(b" ", 1), raw.rfind(b" ", 1)
    if 0 < first and _SOLID[raw[first - 1]] and _SOLID[raw[last - 1]]:
        return first, last
    b = np.frombuffer(raw, np.uint8)
    sure = _GAP[b[1:]] & _SOLID[b[:-1]]
    if len(b) > 5:  # U+5000 to U+8FFF before U+3001, U+3002 or U+FF0C
        ideograph = (b[:-5] >= 0xE5) & (b[:-5] <= 0xE8)
        stop = (b[3:-2] == 0xE3) & (b[4:-1] == 0x80) & ((b[5:] == 0x81) | (b[5:] == 0x82)) | (b[3:-2] == 0xEF) & (b[4:-1] == 0xBC) & (b[5:] == 0x8C)
        sure[2:-2] |= ideograph & stop
    at = np.flatnonzero(sure) + 1
    return (int(at[0]), int(at[-1])) if len(at) else (-1, -1)


class ChunkEncoder:
    """Encodes texts from chunks; remembers chunks and joins."""

    def __init__(self, codec: Codec, cache_bytes: int = CACHE_BYTES):
        self.codec, self.cache_bytes = codec, cache_bytes
        self.young: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}
        self.joins: dict[bytes, np.ndarray] = {}
        self.held = self.held_joins = 0
        self.stats = {"chunks": 0, "encoded": 0, "joins": 0, "repaired": 0}

    def _chunk(self, raw: bytes) -> tuple:
        self.stats["chunks"] += 1
        found = self.young.get(raw) or self.old.get(raw)
        if found is None:
            self.stats["encoded"] += 1
            ids = self.codec.encode(raw)
            first, last = _sync(raw)
            i = j = 0
            if first >= 0:
                ends = np.cumsum(self.codec.lengths[ids])
                i, j = (int(x) for x in np.searchsorted(ends, (first, last)) + 1)
            found = (ids, first, last, i, j)
        if raw not in self.young:
            self.young[raw] = found
            self.held += len(raw)
            if self.held > self.cache_bytes // 2:
                self.old, self.young, self.held = self.young, {}, 0
        return found

    def _join(self, raw: bytes) -> np.ndarray:
        found = self.joins.get(raw)
        if found is None:
            found = self.codec.encode(raw)
            self.held_joins += len(raw) + found.nbytes
            if self.held_joins > self.cache_bytes // 4:
                self.joins.clear()
                self.held_joins = len(raw) + found.nbytes
            self.joins[raw] = found
        return found

    def encode(self, raw: bytes, at: list[int]) -> np.ndarray:
        """The ids of ``raw``, cut at the given places."""
        if at and (guarded := self.codec.guarded(raw)):
            at = [x for x in at if not any(a < x < b for a, b in guarded)]
        edges = [0, *at, len(raw)]
        out: list[np.ndarray] = []
        carry, tail = b"", None
        for k in range(len(edges) - 1):
            chunk = raw[edges[k] : edges[k + 1]]
            ids, first, last, i, j = self._chunk(chunk)
            if k == 0:
                if first < 0:
                    carry, tail = chunk, ids
                else:
                    out.append(ids[:j])
                    carry, tail = chunk[last:], ids[j:]
                continue
            if first < 0:
                carry, tail = carry + chunk, None
                continue
            self.stats["joins"] += 1
            window = self._join(carry + chunk[:first])
            if tail is None or len(window) != len(tail) + i or not np.array_equal(window, np.concatenate([tail, ids[:i]])):
                self.stats["repaired"] += 1
            out.append(window)
            out.append(ids[i:j])
            carry, tail = chunk[last:], ids[j:]
        out.append(tail if tail is not None else self.codec.encode(carry))
        return np.concatenate(out)


@functools.cache
def _encoder(path: str) -> ChunkEncoder:
    """One for each Python worker, which serves many tasks."""
    return ChunkEncoder(Codec(path))


def _worker(path: str, columns: list[str], text: str, ids_name: str, decoded: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        codec = encoder.codec
        for batch in slices(batches, text):
            raw, offsets = utf8_view(batch.column(text))
            where = cuts(raw, offsets)
            data, lists = raw.tobytes(), []
            bounds = np.searchsorted(where, offsets)
            for k in range(batch.num_rows):
                a, b = int(offsets[k]), int(offsets[k + 1])
                lists.append(encoder.encode(data[a:b], (where[bounds[k] : bounds[k + 1]] - a).tolist()) if b > a else np.zeros(0, np.int32))
            ends = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            values = np.concatenate(lists) if lists else np.zeros(0, np.int32)
            arrays = [batch.column(c) for c in columns]
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))
            names = [*columns, ids_name]
            if decoded:
                arrays.append(pa.array([codec.decode(x) for x in lists], pa.string()))
                names.append(decoded)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def encode(df: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add the ids of ``text`` and, if named, the text that they decode to. No shuffle."""
    path = path or default_path()
    kept = [f for f in df.schema.fields if f.name not in (ids, decoded)]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType(), False))])
    if decoded:
        schema = schema.add(decoded, T.StringType())
    names = [f.name for f in kept]
    return in_batches(df).select(*[F.col(f"`{n}`") for n in names]).mapInArrow(_worker(path, names, text, ids, decoded), schema)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """Add the text of ``ids``; null ids decode to null."""
    path = path or default_path()
    schema = T.StructType([*[f for f in df.schema.fields if f.name != out], T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _encoder(path).codec
        for batch in batches:
            texts = [None if x is None else codec.decode(np.asarray(x, np.int64)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in schema.fields[:-1]], pa.array(texts, pa.string())], names=schema.names)

    return df.drop(out).mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """The columns of the contract from ``ids`` and ``decoded``."""
    joined = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode(docs, decoded="decoded").drop("text"))
