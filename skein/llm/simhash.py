"""SimHash near-duplicates, compared bit-sliced.

Word shingles are hashed (XXH64), and each fingerprint bit says whether most hashes have it set. Equal
fingerprints are gathered first, so a group of exact copies counts once. Candidates share a bucket: either
``match`` of ``blocks`` bit blocks agree, which finds every pair within ``blocks - match`` bits, or a sample
of bits agrees in one of several tables. Within a bucket the fingerprints are stored as vertical bit
planes; one pass compares each with its s-th neighbour, 64 pairs to a word, adding the differing bits
with carry-save counters and abandoning words in which all pairs exceed the radius. A bucket gives a star
for each group that it finds, never its pairs; the stars are merged to components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.components import star_components
from skein.llm.words import documents_only
from skein.plans.durable import durable


@dataclass(frozen=True)
class SimHash:
    shingle: int = 4
    #: 64-bit lanes of a fingerprint.
    lanes: int = 1
    radius: int = 4
    #: Exact search: any two fingerprints within blocks - match bits agree in match blocks.
    blocks: int = 6
    match: int = 2
    #: Above 0: so many tables of sampled bits instead, for radii that blocks can't serve.
    tables: int = 0
    sampled_bits: int = 12
    seed: int = 42
    #: Buckets above this are cut further by the bits that the bucket leaves open (exact search).
    bucket_rows: int = 20_000

    def masks(self) -> list[tuple[int, ...]]:
        """Bits that must agree in each table, by lane."""
        width = 64 * self.lanes
        if self.tables:
            rng = np.random.default_rng(self.seed)
            chosen = [sorted(rng.choice(width, self.sampled_bits, replace=False).tolist()) for _ in range(self.tables)]
        else:
            if self.blocks - self.match < self.radius:
                raise ValueError("blocks - match must reach the radius")
            cuts = [range(width * k // self.blocks, width * (k + 1) // self.blocks) for k in range(self.blocks)]
            chosen = [[bit for k in group for bit in cuts[k]] for group in combinations(range(self.blocks), self.match)]
        return [tuple(sum(1 << (bit % 64) for bit in bits if bit // 64 == lane) for lane in range(self.lanes)) for bits in chosen]


def fingerprint(text: bytes | None, settings: SimHash) -> np.ndarray:
    """Fingerprint lanes of one text, as unsigned 64-bit integers."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(settings.lanes, np.uint64)
    k, seed, digest = settings.shingle, settings.seed, xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= k:
        hashes = [digest(joined, seed)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths) - 1
        starts = (ends - lengths + 1)[: len(words) - k + 1].tolist()
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)]
    base = np.array(hashes, np.uint64)
    out = np.empty(settings.lanes, np.uint64)
    for lane in range(settings.lanes):
        h = base if not lane else mixed(base, lane_steps(lane + 1)[lane])
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out[lane] = np.packbits(2 * bits.sum(0, dtype=np.int64) > len(h), bitorder="little").view("<u8")[0]
    return out


def lane_steps(lanes: int) -> np.ndarray:
    """What sets lanes apart before their hashes are mixed."""
    return np.array([lane * 0x9E3779B97F4A7C15 % 2**64 for lane in range(lanes)], np.uint64)


def mixed(h: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Further hash bits from a hash: one round of multiply and shift, another for each lane."""
    with np.errstate(over="ignore"):
        z = h + step
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z ^= z >> np.uint64(shift)
            z *= np.uint64(factor)
        z ^= z >> np.uint64(31)
    return z


def majority(hashes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """A lane for each step: the bits that over half the hashes, mixed with that step, have set.

    Each three words are added to a sum and a carry, and bits are counted eight to a word, in bytes that 255 words can't fill.
    """
    count = np.zeros((8, len(steps), 8), np.int64)  # bit of a byte, lane, byte
    ones, places = np.uint64(0x0101010101010101), np.arange(8, dtype=np.uint64)[:, None, None]
    for at in range(0, len(hashes), 255):
        words = mixed(hashes[at : at + 255, None], steps[None])
        third = len(words) // 3
        a, b, c = words[:third], words[third : 2 * third], words[2 * third : 3 * third]
        differ = a ^ b
        carries = (a & b) | (differ & c)
        differ ^= c
        ways = [((part[None] >> places) & ones).sum(1) for part in (differ, carries, words[3 * third :])]
        count += (ways[0] + 2 * ways[1] + ways[2]).view(np.uint8).reshape(count.shape)
    most = (2 * count > len(hashes)).transpose(1, 2, 0).reshape(-1, 64)
    return np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()


def lane_names(settings: SimHash) -> list[str]:
    return [f"f{k}" for k in range(settings.lanes)]


def fingerprints(docs: DataFrame, settings: SimHash, text: str = "text") -> DataFrame:
    """doc_id and the lanes f0, f1, … of every row; null and empty texts have fingerprint zero."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, settings) for t in batch.column(1).to_pylist()], np.uint64).reshape(-1, settings.lanes)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(prints[:, k]).view(np.int64)) for k in range(settings.lanes))], names=["doc_id", *lane_names(settings)])

    columns = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    return columns.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in lane_names(settings)))


def _shifted(planes: np.ndarray, by: int, words: int) -> np.ndarray:
    at, bits = divmod(by, 64)
    low = planes[:, at : at + words]
    if not bits:
        return low
    return (low >> np.uint64(bits)) | (planes[:, at + 1 : at + 1 + words] << np.uint64(64 - bits))


def _packed(flags: np.ndarray, words: int) -> np.ndarray:
    raw = np.zeros(words * 8, np.uint8)
    some = np.packbits(flags, bitorder="little")
    raw[: len(some)] = some
    return raw.view(np.uint64)


def within_radius(planes: np.ndarray, by: int, valid: np.ndarray, radius: int, step: int = 12) -> np.ndarray:
    """Which items differ from the item ``by`` places on in at most ``radius`` bits.

    planes: a row of words for each bit, with at least by + 64 bits of padding. valid: items that have such
    a neighbour. Counters are kept as planes as well; ``over`` is sticky.
    """
    words = (len(valid) + 63) // 64
    alive = _packed(valid, words)
    where = np.flatnonzero(alive)
    levels = max(1, radius.bit_length())
    count = [np.zeros(len(where), np.uint64) for _ in range(levels)]
    over = ~alive[where]

    def add(x: np.ndarray, level: int) -> None:
        nonlocal over
        for k in range(level, levels):
            count[k], x = count[k] ^ x, count[k] & x
        over = over | x

    def exceeded() -> np.ndarray:
        greater, equal = np.zeros_like(over), np.full_like(over, np.uint64(2**64 - 1))
        for k in reversed(range(levels)):
            if radius >> k & 1:
                equal = equal & count[k]
            else:
                greater = greater | (equal & count[k])
                equal = equal & ~count[k]
        return over | greater

    for first in range(0, len(planes), step):
        part = planes[first : first + step]
        differ = (part[:, :words] ^ _shifted(part, by, words))[:, where] if len(where) < words else part[:, :words] ^ _shifted(part, by, words)
        third = len(differ) // 3
        a, b, c = differ[:third], differ[third : 2 * third], differ[2 * third : 3 * third]
        both = a ^ b
        for x in both ^ c:
            add(x, 0)
        for x in (a & b) | (both & c):  # carries
            add(x, 1) if levels > 1 else add(x, levels)
        for x in differ[3 * third :]:
            add(x, 0)
        keep = exceeded() != np.uint64(2**64 - 1)
        if not keep.any():
            return np.zeros(0, np.int64)
        if keep.mean() < 0.7:
            where, over, count = where[keep], over[keep], [x[keep] for x in count]
    found = np.unpackbits((~exceeded()).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(found)
    return where[row] * 64 + bit


def bucket_stars(prints: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (item, root) that connect all items of a bucket that chains within ``radius`` connect."""
    _, inverse, counts = np.unique(bucket, return_inverse=True, return_counts=True)
    size = counts[inverse]
    order = np.lexsort((inverse, -size))
    order = order[size[order] > 1]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size, group = size[order], inverse[order]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    bits = np.unpackbits(np.ascontiguousarray(prints[order]).view(np.uint8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    planes = np.zeros((packed.shape[0], (packed.shape[1] // 8 + 2 + int(size[0]) // 64 + 1) * 8), np.uint8)
    planes[:, : packed.shape[1]] = packed
    planes = planes.view(np.uint64)
    label = np.arange(len(order))
    for by in range(1, int(size[0])):
        active = int(np.searchsorted(-size, -by, side="left"))  # buckets larger than by stand first
        i = within_radius(planes, by, place[:active] + by < size[:active], radius)
        i = i[label[i] != label[i + by]]
        if not len(i):
            continue
        parent = {}

        def root(x: int, parent: dict = parent) -> int:
            while x in parent:
                x = parent[x]
            return x

        for x, y in zip(label[i].tolist(), label[i + by].tolist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
        moved, to = np.array(list(parent), np.int64), np.array([root(x) for x in parent], np.int64)
        table = np.arange(len(order))
        table[moved] = to
        label = table[label]
    own = np.flatnonzero(label != np.arange(len(order)))
    return order[own], order[label[own]]


def _open_blocks(mask: tuple[int, ...], radius: int) -> list[tuple[int, ...]]:
    """The bits outside ``mask`` in radius + 1 blocks; pairs within the radius agree in one of them."""
    lanes = len(mask)
    free = [b for b in range(64 * lanes) if not mask[b // 64] >> (b % 64) & 1]
    cuts = [free[len(free) * k // (radius + 1) : len(free) * (k + 1) // (radius + 1)] for k in range(radius + 1)]
    return [tuple(sum(1 << (b % 64) for b in bits if b // 64 == lane) for lane in range(lanes)) for bits in cuts]


def _stars(prints: np.ndarray, key: np.ndarray, table: np.ndarray, settings: SimHash, masks: list[tuple[int, ...]]) -> list[tuple[np.ndarray, np.ndarray]]:
    values, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    large = np.flatnonzero(counts > settings.bucket_rows) if not settings.tables else []
    small = ~np.isin(inverse, large)
    at = np.flatnonzero(small)
    a, b = bucket_stars(prints[at], key[at], settings.radius)
    out = [(at[a], at[b])]
    for k in large:
        at = np.flatnonzero(inverse == k)
        for block in _open_blocks(masks[table[at[0]]], settings.radius):
            sub = np.zeros(len(at), np.uint64)
            for lane, m in enumerate(block):
                sub = sub * np.uint64(31) + (prints[at, lane] & np.uint64(m))
            a, b = bucket_stars(prints[at], sub, settings.radius)
            out.append((at[a], at[b]))
    return out


def links(distinct: DataFrame, settings: SimHash, flush_rows: int = 150_000) -> DataFrame:
    """(a, b) nodes of linked fingerprints: stars that connect what buckets connect. distinct: one row for each fingerprint."""
    import pyarrow as pa

    lanes, masks = lane_names(settings), settings.masks()
    signed = lambda m: F.lit(m - 2**64 if m >= 2**63 else m).cast("long")
    keys = [F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), *(F.col(n).bitwiseAND(signed(m)) for n, m in zip(lanes, mask, strict=True))).alias("key")) for t, mask in enumerate(masks)]
    rows = distinct.select(*lanes, F.explode(F.array(*keys)).alias("k")).select("k.t", "k.key", *lanes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            t, key, *parts = (np.concatenate([x[k] for x in held]) for k in range(2 + len(lanes)))
            cut = len(key)
            if not last:  # the last key may go on
                cut = int(np.searchsorted(key, key[-1], side="left"))
            prints = np.stack(parts, axis=1).view(np.uint64)
            if cut:
                for a, b in _stars(prints[:cut], key[:cut], t[:cut], settings, masks):
                    if len(a):
                        ends = [np.ascontiguousarray(prints[x][:, k]).view(np.int64) for x in (a, b) for k in range(len(lanes))]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in ends], names=[f"{side}{k}" for side in "ab" for k in range(len(lanes))])
            held = [tuple(x[cut:] for x in (t, key, *parts))]
            n = len(key) - cut

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
                n += batch.num_rows
                if n >= flush_rows:
                    yield from flush(False)
        if n:
            yield from flush(True)

    schema = ", ".join(f"{side}{k} long" for side in "ab" for k in range(len(lanes)))
    found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)
    return found.select(node([f"a{k}" for k in range(len(lanes))]).alias("a"), node([f"b{k}" for k in range(len(lanes))]).alias("b"))


def node(lanes: list[str]) -> Column:
    """What names a fingerprint: the lane itself, or all lanes in hexadecimal."""
    return F.col(lanes[0]) if len(lanes) == 1 else F.concat(*(F.lpad(F.hex(n), 16, "0") for n in lanes))


def near_duplicates(docs: DataFrame, settings: SimHash | None = None, text: str = "text") -> DataFrame:
    """doc_id, the lanes, ``component_id`` (smallest doc_id reachable over links, itself included) for every row.

    Rows with a null doc_id take part, but name a component only by its other rows; a component of such
    rows alone has a null id. Repeated rows give repeated results; an empty table gives an empty result.
    """
    settings = settings or SimHash()
    lanes = lane_names(settings)
    prints = durable(fingerprints(docs, settings, text), "fingerprints")
    distinct = prints.groupBy(*lanes).agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    stars = star_components(links(distinct, settings))
    rooted = stars.select(F.explode(F.array("a", "b")).alias("a"), "b").distinct()
    named = distinct.select(node(lanes).alias("a"), "least", "rows")
    linked = rooted.join(named, "a")
    least = linked.groupBy("b").agg(F.min("least").alias("component"))
    of_linked = rooted.join(least, "b").select(F.col("a"), "component")
    groups = named.join(of_linked, "a", "left").where("rows > 1 or component is not null").select("a", F.coalesce("component", "least").alias("component"))
    out = prints.withColumn("a", node(lanes)).join(groups, "a", "left")
    return out.select("doc_id", *lanes, F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, settings=None) -> DataFrame:  # noqa: ANN001
    """The pipeline's stage: ``near_copies`` decides by shingle sets what fingerprints bring together."""
    from skein.llm import near_copies

    return near_copies.one_of_each_group(docs, settings)


def near_duplicate_digest(docs: DataFrame, settings: SimHash | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits to a lane) and component_id of every row."""
    settings = settings or SimHash()
    found = near_duplicates(documents_only(docs, "doc_id", "text"), settings)
    return found.select("doc_id", F.lower(F.concat(*(F.lpad(F.hex(n), 16, "0") for n in lane_names(settings)))).alias("fingerprint"), "component_id")
