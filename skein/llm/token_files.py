"""Token ids in bit-plane files.

Texts are tokenised in ascending order of doc_id and written as shards. A shard cuts its ids into blocks of
a fixed number, transposes each block into byte or bit planes, compresses each plane with zstandard, and
keeps an index of the chunks and of the documents. A shard is one self-contained value in a Parquet table,
so Spark's writer commits it as a whole, on any file system, and a lost executor's shards are written again.

Layout of a shard, little-endian: 4 bytes ``SKP1``; the length of the header as 8 bytes; the header as
JSON (ids, block size, plane kind, and for each block the lengths of its planes); the compressed document
index (doc_id, null flag and number of ids, as byte planes); the planes of all blocks in order.
"""

from __future__ import annotations

import json
import re
import sys
import types
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.words import documents_only
from skein.plans.durable import durable

MAGIC = b"SKP1"
#: Marks that may follow a word.
MARKS = ".,;:!?|$%&*#\"()[]"


@dataclass(frozen=True)
class TokenFiles:
    tokenizer: str
    end_id: int = 0
    block_ids: int = 65_536
    planes: str = "byte"
    shard_ids: int = 2_000_000
    level: int = 3
    #: Pieces whose ids a worker remembers in each of its two tables; a table with more is emptied.
    remembered: int = 200_000
    #: Bytes of text for each range of doc_ids.
    range_bytes: int = 48_000_000


_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: The byte-level alphabet: bytes of visible Latin-1 characters stand for themselves, the others follow from 256 on.
BYTE_LETTERS = [chr(b if b in _VISIBLE else 256 + sum(c not in _VISIBLE for c in range(b))) for b in range(256)]


class WordEncoder:
    """The tokenizer's ids of whole texts, as little-endian 32-bit integers, remembered by word.

    The byte-level pre-tokenizer always cuts before a blank that a character other than white space
    follows, and around a single line break between such characters. Texts are cut there, and the library
    encodes each distinct piece once. A text that holds the content of an added token (such as an end mark)
    goes to the library whole, unless ``added_as_text``: then such contents are words like any others.
    """

    _blank = re.compile(r" (?=\s|\Z)")
    _cut = re.compile(r" (?=\S)")
    def __init__(self, path: str, remembered: int, added_as_text: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = added_as_text
        added = [] if added_as_text else [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        self.model = self.tokenizer.model
        self.remembered = remembered
        self.first, self.spaced = _Pieces(self, ""), _Pieces(self, " ")

    def ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word_ids(self, word: str) -> bytes:
        """Ids of one pre-token, straight from the library's merge model."""
        mapped = word.replace(" ", BYTE_LETTERS[32]) if word.isascii() else "".join([BYTE_LETTERS[b] for b in word.encode()])
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def encode(self, text: str) -> bytes:
        if self.added and self.added.search(text):
            return self.ids(text)
        parts = self._cut.split(text) if self._blank.search(text) else text.split(" ")
        if len(self.spaced) > self.remembered:
            self.spaced.clear()
        if len(self.first) > self.remembered:
            self.first.clear()
        spaced = self.spaced
        return self.first[parts[0]] + b"".join([spaced[p] for p in parts[1:]])


class _Pieces(dict):
    def __init__(self, encoder: WordEncoder, lead: str):
        super().__init__()
        self.encoder, self.lead = encoder, lead

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha():  # letters alone, after at most one blank, are one pre-token
            out = self[piece] = self.encoder.word_ids(self.lead + piece)
            return out
        body = piece.rstrip(MARKS)
        if len(body) < len(piece) and body and body[-1].isalpha():  # letters and marks never share a pre-token
            again = body in self
            out = self[body] + self.encoder.first[piece[len(body) :]]
            if again:
                self[piece] = out
            return out
        lines = piece.split("\n")
        if len(lines) > 1 and all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
            line = self.encoder.first
            out = self[lines[0]] + b"".join([line["\n"] + line[x] for x in lines[1:]])
            if len(lines) > 2:
                return out  # long pieces seldom come again
        else:
            out = self.encoder.ids(self.lead + piece)
        if len(piece) <= 64:
            self[piece] = out
        return out


def worker_encoder(path: str, remembered: int) -> WordEncoder:
    """The encoder of this worker process, which serves many tasks."""
    state = sys.modules.setdefault("_token_worker", types.ModuleType("_token_worker"))
    known = state.__dict__.setdefault("encoders", {})
    if path not in known:
        known[path] = WordEncoder(path, remembered, added_as_text=False)
    return known[path]


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes of one block of 32-bit ids, lowest first."""
    if kind == "byte":
        return [p.tobytes() for p in np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)]
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return [np.packbits(p, bitorder="little").tobytes() for p in np.ascontiguousarray(bits.T)]


def from_planes(planes: list[bytes], kind: str, n: int) -> np.ndarray:
    stacked = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    if kind == "bit":
        stacked = np.packbits(np.unpackbits(stacked, axis=1, bitorder="little")[:, :n].T, axis=1, bitorder="little").T
    return np.ascontiguousarray(stacked.T).view("<u4").reshape(-1)[:n]


def write_shard(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, settings: TokenFiles) -> bytes:
    import zstandard

    press = zstandard.ZstdCompressor(level=settings.level)
    index = np.array([(-1 if d is None else d, d is None, n) for d, n in zip(doc_ids, counts.tolist(), strict=True)], np.int64).reshape(-1, 3)
    index[:, 0] = np.diff(index[:, 0], prepend=0)
    documents = press.compress(np.ascontiguousarray(index.T).view(np.uint8).reshape(-1, 8).T.tobytes())
    blocks = [[press.compress(p) for p in to_planes(ids[k : k + settings.block_ids], settings.planes)] for k in range(0, len(ids), settings.block_ids)]
    header = {"ids": len(ids), "documents": len(doc_ids), "index": len(documents), "block": settings.block_ids, "kind": settings.planes, "chunks": [[len(p) for p in b] for b in blocks]}
    head = json.dumps(header).encode()
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, documents, *(p for b in blocks for p in b)])


def read_shard(value: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, numbers of ids, and all ids of a shard."""
    import zstandard

    if value[:4] != MAGIC:
        raise ValueError("not a shard of token ids")
    press = zstandard.ZstdDecompressor()
    size = int.from_bytes(value[4:12], "little")
    header, at = json.loads(value[12 : 12 + size]), 12 + size
    raw = np.frombuffer(press.decompress(value[at : at + header["index"]]), np.uint8)
    index = np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).reshape(3, -1)
    at += header["index"]
    out = []
    for k, lengths in enumerate(header["chunks"]):
        n = min(header["block"], header["ids"] - k * header["block"])
        planes = []
        for length in lengths:
            planes.append(press.decompress(value[at : at + length]))
            at += length
        out.append(from_planes(planes, header["kind"], n))
    doc_ids = [None if null else d for d, null in zip(np.cumsum(index[0]).tolist(), index[1].tolist(), strict=True)]
    return doc_ids, index[2], np.concatenate(out) if out else np.zeros(0, "<u4")


def write_tokens(docs: DataFrame, settings: TokenFiles, order: list[Column] | None = None, text: str = "text") -> DataFrame:
    """The table of shards: part, seq, n_ids, shard. Documents stand in ascending doc_id (nulls first, ties by text), or in ``order``."""
    import pyarrow as pa

    spark = docs.sparkSession
    keys = order or [F.col("`doc_id`"), F.col(f"`{text}`")]
    names = [f"__k{k}" for k in range(len(keys))]
    columns = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), *(k.alias(n) for k, n in zip(keys[: 1 if order is None else len(keys)], names, strict=False)))
    ranged = [c for c in columns.columns if c.startswith("__k")]
    total = columns.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // settings.range_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, encoder = TaskContext.get().partitionId(), 0, None
        held, doc_ids, n = [], [], 0

        def shard() -> pa.RecordBatch:
            counts = np.array([len(x) // 4 for x in held], np.int64)
            value = write_shard(doc_ids, counts, np.frombuffer(b"".join(held), "<u4"), settings)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([n], pa.int64()), pa.array([value], pa.binary())], names=["part", "seq", "n_ids", "shard"])

        end = np.array([settings.end_id], "<u4").tobytes()
        for batch in batches:
            encoder = encoder or worker_encoder(settings.tokenizer, settings.remembered)
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(encoder.encode(body) + end)
                doc_ids.append(doc_id)
                n += len(held[-1]) // 4
                if n >= settings.shard_ids:
                    yield shard()
                    held, doc_ids, n, seq = [], [], 0, seq + 1
        if held:
            yield shard()

    sorting = [*ranged, *(["text"] if order is None else [])]
    dealt = columns.repartitionByRange(parts, *ranged).sortWithinPartitions(*sorting).select("doc_id", "text")
    return durable(dealt.mapInArrow(run, "part int, seq int, n_ids long, shard binary"), "tokens")


def read_tokens(shards: DataFrame, most_broadcast: int = 500_000) -> DataFrame:
    """doc_id, start (ids before it), n_tokens and ids_crc32 of every document, from the shards."""
    import pyarrow as pa

    sizes = shards.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    base = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.join(base, "part").select("part", "seq", (F.coalesce(F.sum("n_ids").over(inner), F.lit(0)) + F.col("base")).alias("first"))
    if sizes.count() <= most_broadcast:
        offsets = F.broadcast(offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids, counts, ids = read_shard(value)
                ends = np.cumsum(counts)
                raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
                starts = ends - counts
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts + first), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.join(offsets, ["part", "seq"]).select("shard", "first").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, settings: TokenFiles) -> DataFrame:
    """Write the files and read them back: doc_id, start, n_tokens (with the end id), ids_crc32 of every row.

    Null and empty texts hold the end id alone; repeated rows are written again; an empty table gives no row.
    """
    return read_tokens(write_tokens(documents_only(docs, "doc_id", "text"), settings))
