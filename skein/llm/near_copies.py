"""Documents whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

Candidates come by SimHash: a fingerprint bit says whether most of a set's shingle hashes, mixed anew for each
lane, have it set. Equal texts count once. Texts meet in tables of buckets, each by bits of its own; within a
bucket ``simhash.bucket_stars`` compares 256 other bits, bit-sliced, and texts that chain within the radius share a
key. What shared keys connect is brought together, and links are decided there by the shingle sets themselves, so
a group holds what chains of verified pairs connect and nothing else. Where that is more than a task should hold,
it is cut into chunks: a few pivots meet every chunk and link most of its texts. Similar texts that are still in
different groups share one of their rarest shingles (``rarest``, exact). What such shingles connect is brought
together anew; where it is still too large, all texts but those of the shingle's largest group meet every chunk.

A bit of two sets at similarity 0.8 differs with probability 0.1612 at most, 0.1875 where one set has four shingles
and the other five, so those stand in more tables, with a wider radius. A pair shares no key with probability
2.5e-5 at most: its bits agree in none of the tables, 1.5e-5, or more than the radius of the 256 differ, 1e-5.
Texts are named by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.components import star_components
from skein.llm.simhash import bucket_stars, lane_steps, majority, mixed
from skein.llm.words import documents_only
from skein.plans.durable import durable


@dataclass(frozen=True)
class NearCopies:
    shingle: int = 5
    #: Least similarity in hundredths, so that the test is one of whole numbers.
    percent: int = 80
    #: 64-bit lanes that are compared; the bits of them that may differ, for short sets and for others.
    lanes: int = 4
    radius: int = 68
    short_radius: int = 76
    #: Sets of so many shingles at most are short.
    short: int = 5
    #: Most a bit of two sets at ``percent`` differs with, and of two short sets; probability that no table has both.
    apart: float = 0.1612
    short_apart: float = 0.1875
    missed: float = 1.5e-5
    #: Least bits of a bucket; texts of a bucket on average beyond which another bit is taken.
    bucket_bits: int = 12
    bucket_texts: int = 512
    #: Texts of a table that are sent together, about.
    part_texts: int = 16_000
    seed: int = 42
    #: Texts and bytes that one task compares; what is connected beyond that is cut into chunks.
    task_texts: int = 1_000
    task_bytes: int = 16_000_000
    #: Texts of each large part that meet all others first, about.
    pivots: int = 32
    #: Most shingles whose counts are sent to all tasks; they decide an order, not what is found.
    counted: int = 100_000


def shingles(text: bytes | None, settings: NearCopies) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a shorter text is one shingle."""
    import xxhash

    words, k = (text or b"").lower().split(), settings.shingle
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(joined, settings.seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: len(words) - k + 1].tolist()
    return np.unique(np.array([digest(joined[a:b], settings.seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64))


@dataclass(frozen=True)
class Tables:
    """Tables for a number of texts: all sets stand in the first ``common``, short ones in ``short`` more."""

    bits: int
    common: int
    short: int
    parts: int
    #: Buckets beyond this are searched from text to text.
    large: int

    @classmethod
    def of(cls, texts: int, settings: NearCopies) -> Tables:
        bits = max(settings.bucket_bits, (texts // settings.bucket_texts).bit_length())
        tables = lambda apart: math.ceil(math.log(settings.missed) / math.log(1 - (1 - apart) ** bits))
        return cls(bits, tables(settings.apart), tables(settings.short_apart), texts // settings.part_texts + 1, 64 + 4 * (texts >> bits))

    def lanes(self, settings: NearCopies, short: bool) -> int:
        """Lanes of a fingerprint: those compared, then those that name buckets."""
        return settings.lanes + -(-self.bits * (self.common + self.short * short) // 64)

    def buckets(self, named: np.ndarray, table: int) -> np.ndarray:
        """Bucket of each row in a table. named: unpacked bits that name buckets."""
        own = np.zeros((len(named), 32), np.uint8)
        own[:, : self.bits] = named[:, table * self.bits : (table + 1) * self.bits]
        return np.packbits(own, axis=1, bitorder="little").view("<u4").ravel()


def set_print(hashes: np.ndarray, tables: Tables, settings: NearCopies) -> bytes:
    """SimHash of a shingle set; only short sets have the bits of the tables for those."""
    lanes = tables.lanes(settings, len(hashes) <= settings.short)
    return majority(hashes, lane_steps(lanes + 1)[1:]).tobytes()


def frontier_stars(prints: np.ndarray, radius: int, cells: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """As ``simhash.bucket_stars`` for one bucket: (item, root) of what chains within ``radius`` connect.

    Goes from each text to those not reached yet, so that a bucket of near copies takes about one pass.
    """
    left, items, roots = np.arange(len(prints)), [], []
    while len(left):
        first, front, left = left[0], [left[:1]], left[1:]
        while front and len(left):
            now = front.pop()
            most = max(1, cells // len(left))
            for at in range(0, len(now), most):
                some = now[at : at + most]
                apart = np.zeros((len(some), len(left)), np.uint16)
                for lane in range(prints.shape[1]):
                    apart += np.bitwise_count(prints[some, lane][:, None] ^ prints[left, lane][None])
                near = (apart <= radius).any(0)
                if near.any():
                    front.append(left[near])
                    items.append(left[near])
                    roots.append(np.full(near.sum(), first))
                    left = left[~near]
                    if not len(left):
                        break
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *items]), np.concatenate([none, *roots])


def part_keys(node: np.ndarray, table: np.ndarray, bucket: np.ndarray, prints: np.ndarray, tables: Tables, settings: NearCopies) -> tuple[np.ndarray, np.ndarray]:
    """(node, key) of the texts that bucket and radius connect to others, whole buckets given."""
    place = table.astype(np.uint64) << np.uint64(32) | bucket
    _, inverse, counts = np.unique(place, return_inverse=True, return_counts=True)
    large, stars = counts[inverse] > tables.large, [(np.zeros(0, np.int64),) * 2]
    short = table >= tables.common
    for radius, own in ((settings.radius, ~short), (settings.short_radius, short)):
        at = np.flatnonzero(own & ~large)
        a, b = bucket_stars(prints[at], inverse[at], radius)
        stars.append((at[a], at[b]))
    for k in np.unique(inverse[large]):
        at = np.flatnonzero(inverse == k)
        a, b = frontier_stars(prints[at], settings.short_radius if short[at[0]] else settings.radius)
        stars.append((at[a], at[b]))
    item, root = (np.concatenate([s[k] for s in stars]) for k in (0, 1))
    both = np.concatenate([item, np.unique(root)]), np.concatenate([root, np.unique(root)])
    key = mixed(place[both[1]], lane_steps(2)[1]) ^ node[both[1]].view(np.uint64)
    return node[both[0]], mixed(key, lane_steps(2)[1]).view(np.int64)


def verified(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """A group number for each set: what chains of pairs with that similarity or more connect.

    Sets are compared with all others until each has met one that it was compared with. Two sets of
    different groups can then be left; at least one of them is outside the largest group, and those are
    compared with all as well.
    """
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    own, ids = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(own), bool)
    label, met, done = np.arange(len(sets)), np.zeros(len(sets), bool), np.zeros(len(sets), bool)

    def compare(x: int) -> None:
        mine = ids[starts[x] : starts[x] + sizes[x]]
        marked[mine] = True
        common = np.add.reduceat(marked[ids].astype(np.int64), starts)
        marked[mine] = False
        near = 100 * common >= percent * (sizes + sizes[x] - common)
        label[np.isin(label, label[near])] = label[near].min()
        met[near], done[x] = True, True

    for x in range(len(sets)):
        if not met[x]:
            compare(x)
    largest = np.bincount(label).argmax()
    for x in np.flatnonzero(~done & (label != largest)).tolist():
        compare(x)
    return label


def text_name(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def near_pairs(pivots: list[np.ndarray], sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(pivot, set) numbers of the pairs with that similarity or more."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    own, ids = np.unique(np.concatenate(sets), return_inverse=True)
    marked, out = np.zeros(len(own) + 1, bool), []
    for k, pivot in enumerate(pivots):
        at = np.minimum(np.searchsorted(own, pivot), len(own) - 1)
        at = at[own[at] == pivot]
        marked[at] = True
        common = np.add.reduceat(marked[ids].astype(np.int64), starts)
        marked[at] = False
        near = np.flatnonzero(100 * common >= percent * (sizes + len(pivot) - common))
        out.append((np.full(len(near), k), near))
    return tuple(np.concatenate([np.zeros(0, np.int64), *(x[k] for x in out)]) for k in (0, 1))


def rarest(hashes: np.ndarray, counts: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first of a set's shingles by count and hash, and which of them are leading ones.

    So many that of two sets with that similarity or more, the larger has among them a leading one of the smaller:
    at p, the sets have p of the larger and 2p / (1 + p) of the smaller in common, and the first of these has all
    others after it in both. counts: ascending hashes with their counts; others count 0.
    """
    n = len(hashes)
    most, leading = n + -percent * n // 100 + 1, n + -2 * percent * n // (100 + percent) + 1
    at = np.searchsorted(counts[0], hashes)
    known = np.append(counts[0], np.uint64(0))[at] == hashes
    count = np.where(known & (at < len(counts[0])), np.append(counts[1], 0)[at], 0)
    return hashes[np.lexsort((hashes, count))[:most]], np.arange(most) < leading


def forest(a: np.ndarray, b: np.ndarray, names: list[int], others: list[int]) -> tuple[list[int], list[int]]:
    """(name, root) for all but one node of each part that the pairs of a name and another name connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    for k, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(names[k]), root(others[j])
        parent[max(x, y)] = min(x, y)
    below = [x for x in parent if root(x) != x]
    return below, [root(x) for x in below]


def _prints(docs: DataFrame, tables: Tables, settings: NearCopies, text: str) -> DataFrame:
    """node, print: the fingerprint of each distinct text."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                prints = [set_print(shingles(t, settings), tables, settings) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.binary())], names=["node", "print"])

    named = docs.select(text_name(text).alias("node"), F.col(f"`{text}`").cast("binary").alias("text"))
    return durable(named.mapInArrow(run, "node long, print binary").distinct(), "fingerprints")


def _dealt(prints: DataFrame, tables: Tables, settings: NearCopies) -> DataFrame:
    """t, part, body: buckets, nodes and compared lanes of the texts that a part of a table has, packed."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, raw = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            size = np.array([len(x) for x in raw], np.int64)
            for short in (False, True):
                lanes = tables.lanes(settings, short)
                at = np.flatnonzero(size == 8 * lanes)
                if not len(at):
                    continue
                node = nodes[at]
                words = np.frombuffer(b"".join(raw[k] for k in at), "<u8").reshape(-1, lanes)
                compared = np.ascontiguousarray(words[:, : settings.lanes])
                named = np.unpackbits(np.ascontiguousarray(words[:, settings.lanes :]).view(np.uint8), axis=1, bitorder="little")
                for t in range(tables.common + tables.short * short):
                    bucket = tables.buckets(named, t)
                    part = bucket % np.uint32(tables.parts)
                    order = np.argsort(part, kind="stable")
                    own, first = np.unique(part[order], return_index=True)
                    bodies = [bucket[x].tobytes() + node[x].tobytes() + compared[x].tobytes() for x in np.split(order, first[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t, np.int32)), pa.array(own.astype(np.int32)), pa.array(bodies, pa.binary())], names=["t", "part", "body"])

    return prints.mapInArrow(run, "t int, part int, body binary")


def _keys(docs: DataFrame, settings: NearCopies, text: str, held_texts: int = 100_000) -> DataFrame:
    """node, key: the keys that each distinct text shares with others."""
    import pyarrow as pa

    tables = Tables.of(docs.count(), settings)
    width = 4 + 8 + 8 * settings.lanes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, now = [], 0, None

        def flush() -> pa.RecordBatch:
            sizes = [len(body) // width for _, body in held]
            column = lambda start, end, kind: np.frombuffer(b"".join(body[start * k : end * k] for k, (_, body) in zip(sizes, held, strict=True)), kind)
            table = np.repeat(np.array([t for t, _ in held], np.int64), sizes)
            found = part_keys(column(4, 12, "<i8"), table, column(0, 4, "<u4"), column(12, width, "<u8").reshape(-1, settings.lanes), tables, settings)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "key"])

        for batch in batches:
            for t, part, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n >= held_texts and (t, part) != now:
                    yield flush()
                    held, n = [], 0
                now = (t, part)
                held.append((t, body))
                n += len(body) // width
        if n:
            yield flush()

    dealt = _dealt(_prints(docs, tables, settings, text), tables, settings)
    return durable(dealt.repartition("t", "part").sortWithinPartitions("t", "part").mapInArrow(run, "node long, key long"), "keys")


def _candidates(keys: DataFrame) -> DataFrame:
    """(a, b): each text that shares keys with others but the smallest that they lead to, with that."""
    shared = keys.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b")
    return star_components(keys.join(shared, "key").select(F.col("node").alias("a"), "b").where("a != b").distinct())


def _small_groups(texts: DataFrame, settings: NearCopies) -> DataFrame:
    """(node, root) of verified groups of two or more. texts: near, node, text, where a task holds each near whole."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sets, now = [], [], None

        def group() -> Iterator[pa.RecordBatch]:
            label = verified(sets, settings.percent)
            _, at, n = np.unique(label, return_inverse=True, return_counts=True)
            names, many = np.array(nodes, np.int64), n[at] > 1
            least = np.full(len(n), 2**63 - 1, np.int64)
            np.minimum.at(least, at, names)
            if many.any():
                yield pa.RecordBatch.from_arrays([pa.array(names[many]), pa.array(least[at][many])], names=["node", "root"])

        for batch in batches:
            for near, node, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if near != now and sets:
                    yield from group()
                    nodes, sets = [], []
                now = near
                nodes.append(node)
                sets.append(shingles(body, settings))
        if sets:
            yield from group()

    return texts.repartition("near").sortWithinPartitions("near").mapInArrow(run, "node long, root long")


def _links(texts: DataFrame, pivots: DataFrame, settings: NearCopies) -> DataFrame:
    """(a, b): stars of what verified pairs of a pivot and any text of its near connect, chunk by chunk. texts: near, chunks, node, text; pivots: near, node.

    A chunk gives at most one row for each of its texts and pivots.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [], [])

        def compared() -> pa.RecordBatch:
            pivot_names, pivot_sets, names, sets = held
            a, b = near_pairs(pivot_sets, sets, settings.percent) if pivot_sets and sets else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest(a, b, pivot_names, names)], names=["a", "b"])

        for batch in batches:
            for near, chunk, block, pivot, node, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (near, chunk, block) != now and now is not None:
                    yield compared()
                    held = ([], [], [], [])
                now = (near, chunk, block)
                held[0 if pivot else 2].append(node)
                held[1 if pivot else 3].append(shingles(body, settings))
        if now is not None:
            yield compared()

    chosen = durable(texts.join(pivots, ["near", "node"], "left_semi"), "pivots")
    blocks = chosen.groupBy("near").agg(F.ceil(F.greatest(F.sum(F.octet_length("text")) / settings.task_bytes, F.count("*") / settings.task_texts)).cast("int").alias("blocks"))
    spots = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    whole = texts.join(blocks, "near").select("near", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"), spots("blocks").alias("block"), F.lit(False).alias("pivot"), "node", "text")
    sent = chosen.join(blocks, "near").select("near", spots("chunks").alias("chunk"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("pivot"), "node", "text")
    place = ["near", "chunk", "block"]
    return whole.union(sent).repartition(*place).sortWithinPartitions(*place).mapInArrow(run, "a long, b long")


def _shingle_counts(texts: DataFrame, settings: NearCopies) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes of the most frequent shingles and about how many texts have them, by some 1,000 texts of each near. texts: near, n, node, text."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(t, settings) for t in part.column(1).to_pylist()]
                weight = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(x) for x in sets])
                own, inverse = np.unique(np.concatenate(sets), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.bincount(inverse, weight).astype(np.int64))], names=["shingle", "n"])

    weight = F.greatest(F.col("n") / settings.task_texts, F.lit(1)).cast("long")
    some = texts.withColumn("weight", weight).where(F.pmod(F.xxhash64("node", F.lit(3)), "weight") == 0).select("weight", "text")
    counts = durable(some.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1"), "shingle-counts")
    least, total = None, 0
    for level, n in sorted(counts.groupBy(F.floor(F.log2("n")).cast("int")).count().collect(), reverse=True):
        total += n
        if total > settings.counted:
            break
        least = 1 << level
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = counts.where(F.col("n") >= least).toArrow()
    names, numbers = (found.column(k).to_numpy() for k in (0, 1))
    order = np.argsort(names.view(np.uint64))
    return names.view(np.uint64)[order], numbers[order]


def _rarest(texts: DataFrame, counts: tuple[np.ndarray, np.ndarray], settings: NearCopies) -> DataFrame:
    """near, node, label, shingle, leading: the rarest shingles of each text. texts: near, node, label, text."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [rarest(shingles(t, settings), counts, settings.percent) for t in part.column(3).to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(found)), [len(x) for x, _ in found]))
                hashes, leading = (np.concatenate([x[k] for x in found]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(rows) for k in range(3)), pa.array(hashes.view(np.int64)), pa.array(leading)], names=["near", "node", "label", "shingle", "leading"])

    return texts.select("near", "node", "label", "text").mapInArrow(run, "near long, node long, label long, shingle long, leading boolean")


def _large_groups(texts: DataFrame, settings: NearCopies) -> DataFrame:
    """(node, root) of verified groups of two or more. texts: near, n, chunks, node, text, where nears are cut into chunks."""
    few = F.pmod(F.xxhash64("node", F.lit(2)), F.greatest(F.col("n") / settings.pivots, F.lit(1)).cast("long")) == 0
    links = durable(_links(texts, texts.where(few | (F.col("near") == F.col("node"))).select("near", "node"), settings), "pivot-links")
    labels = star_components(links).withColumnsRenamed({"a": "node", "b": "label"})
    labelled = texts.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    shared = durable(_rarest(labelled, _shingle_counts(texts, settings), settings), "rarest")
    place = ["near", "shingle"]
    most = shared.groupBy(*place, "label").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.max("leading").alias("leading"))
    most = most.groupBy(*place).agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.min("least").alias("least"), F.count("*").alias("labels"), F.max("leading").alias("any")).where("labels > 1 and any")
    apart = durable(shared.join(most.select(*place, "largest", "least"), place).groupBy("node", "least").agg(F.max(F.col("label") != F.col("largest")).alias("minor")), "apart")
    finer = star_components(apart.select(F.col("node").alias("a"), F.col("least").alias("b"))).select(F.explode(F.array("a", "b")).alias("node"), F.col("b").alias("near")).distinct()
    again = durable(texts.select("node", "text").join(finer, "node").select("near", "node", "text"), "again")
    large = _large(again, settings)
    links = links.unionAll(durable(_small_groups(again.join(large, "near", "left_anti"), settings), "small-links").select("node", "root"))
    if not large.isEmpty():
        cut = again.join(large, "near")
        left = durable(cut.join(apart.where("minor").select("node").distinct(), "node", "left_semi").select("near", "node"), "left")
        links = links.unionAll(durable(_links(cut, left, settings), "more-links"))
    return star_components(links).select(F.explode(F.array("a", "b")).alias("node"), F.col("b").alias("root")).distinct()


def _large(texts: DataFrame, settings: NearCopies) -> DataFrame:
    """near, n, chunks of the nears that are more than a task should hold. texts: near, text."""
    sizes = texts.groupBy("near").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    chunks = F.ceil(F.greatest(F.col("n") / settings.task_texts, F.col("bytes") / settings.task_bytes)).cast("int")
    return durable(sizes.select("near", "n", chunks.alias("chunks")).where("chunks > 1"), "large")


def _groups(docs: DataFrame, settings: NearCopies, text: str) -> DataFrame:
    """(node, root) of the texts in verified groups of two or more."""
    keys = _keys(docs, settings, text)
    members = _candidates(keys).select(F.explode(F.array("a", "b")).alias("node"), F.col("b").alias("near")).distinct()
    bodies = docs.select(text_name(text).alias("node"), F.col(f"`{text}`").cast("binary").alias("text"))
    texts = durable(bodies.join(members, "node").dropDuplicates(["node"]).select("near", "node", "text"), "candidates")
    large = _large(texts, settings)
    found = _small_groups(texts.join(large, "near", "left_anti"), settings)
    if large.isEmpty():
        return found
    cut = texts.join(large, "near").select("near", "n", "chunks", "node", "text")
    return durable(found, "small-groups").unionAll(durable(_large_groups(cut, settings), "large-groups"))


def _grouped(docs: DataFrame, settings: NearCopies, text: str) -> DataFrame:
    """(node, root) of the texts in verified groups of two or more."""
    return durable(_groups(docs, settings, text), "near-copies")


def near_copies(docs: DataFrame, settings: NearCopies | None = None, text: str = "text") -> DataFrame:
    """doc_id and ``component_id`` (smallest doc_id of its group, itself included) for every row.

    Null and empty texts are equal. Rows with a null doc_id take part, but name a group only by its other rows.
    """
    settings = settings or NearCopies()
    groups = _grouped(docs, settings, text)
    prints = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), text_name(text).alias("node"))
    distinct = prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).join(groups, "node", "left")
    least = distinct.where("root is not null").groupBy("root").agg(F.min("least").alias("component"))
    named = distinct.where("rows > 1 or root is not null").join(least, "root", "left").select("node", F.coalesce("component", "least").alias("component"))
    return prints.join(named, "node", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, settings: NearCopies | None = None) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one of smallest doc_id.

    Of rows that share doc_id and text one stays; rows that share a doc_id alone are judged by their own texts.
    Null and empty texts are one group. Of rows with a null doc_id, one stays for a group that has no other.
    Columns stay as they are, whatever their names; an empty table stays empty.
    """
    settings = settings or NearCopies()
    plain = documents_only(docs, "doc_id", "text")
    named = plain.select(F.col("doc_id").alias("id"), text_name("text").alias("node")).groupBy("id", "node").agg(F.count("*").alias("n"))
    led = named.join(_grouped(plain, settings, "text"), "node", "left").select(F.coalesce("root", "node").alias("root"), F.struct(F.col("id").isNull().alias("no"), "id", "node").alias("k"), "n")
    first = led.groupBy("root").agg(F.min("k").alias("first"))
    judged = led.join(first, "root")
    gone = judged.where("k != first").select(F.col("k.id").alias("gone_id"), F.col("k.node").alias("gone_node"))
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text_name("text").alias("own"))
    kept = row.join(gone, F.col("row.doc_id").eqNullSafe(F.col("gone_id")) & (F.col("own") == F.col("gone_node")), "left_anti")
    if led.where("n > 1").limit(1).count():  # rows that share doc_id and text
        kept = kept.groupBy("own").agg(F.first("row").alias("row"))
    return kept.select(*(F.col(f"row.`{c}`") for c in docs.columns))
