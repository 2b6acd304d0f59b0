"""Substring dedup by prefix-partitioned suffix trees.

A suffix stands for the words from one place of a document on, to the depth of a window. Suffixes with the
same window share all shorter prefixes, so they are dealt out by prefixes of variable length: by their first
2 words, by 5 where too many suffixes share those, and by the whole window where too many share 5. The
counts behind this come from all texts, before anything is exchanged. Prefixes of little use are put together
until a group fills its share of memory (``group_windows``); those dealt out by whole windows split evenly,
as a portion of texts sends a window once. Each group's subtree is built from its suffixes in order: neighbours that
agree to the depth of the window lie below one internal node. All but its earliest suffix are repeated
windows, and consecutive ones join to maximal repeats, whose words go.

Words are represented by 64-bit hashes, and the edge from a prefix to the window's depth by one 64-bit hash of
the window's words; labels of edges aren't compared word by word. Two windows can only be mistaken for one
another within a group: the chance of any such case among n windows in g groups is about n² / (g 2⁶⁵).

Suffixes travel as packed arrays, and so do the repeats, which come back to the portion of texts that sent them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.packing import pack, unpack
from skein.llm.words import documents_only, gram_hashes, hashed_words, portions


@dataclass(frozen=True)
class SubstringDedup:
    window: int = 20
    #: Words of the prefixes that deal suffixes out, and the number of buckets in which each is counted.
    prefixes: tuple[int, ...] = (2, 5)
    buckets: tuple[int, ...] = (4_096, 65_536)
    #: Suffixes of a group.
    group_windows: int = 500_000
    #: Text that a task works on at once.
    portion_bytes: int = 5_000_000
    #: Text for each task that builds subtrees, at least as many tasks as shuffle partitions.
    part_bytes: int = 64_000_000


def windows(rows: list[tuple], window: int, prefixes: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """Row numbers, starts, hashes of windows and of prefixes of all suffixes of (doc_id, text) rows, by doc_id and place."""
    words, counts = hashed_words([r[-1] for r in rows])
    turn = np.array(sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k)), np.int64)
    held = np.maximum(counts - window + 1, 0)[turn]
    row = np.repeat(turn, held)
    start = np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held)
    at = start + np.repeat((np.cumsum(counts) - counts)[turn], held)
    return row, start, gram_hashes(words, window)[at], *(gram_hashes(words, k)[at] for k in prefixes)


def prefix_counts(docs: DataFrame, settings: SubstringDedup) -> DataFrame:
    """level, bucket, n: suffixes of all texts by bucket of their prefix, for each length of prefix."""
    import pyarrow as pa

    window, prefixes, buckets, most = settings.window, settings.prefixes, settings.buckets, settings.portion_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(b, np.int64) for b in buckets]
        for rows in portions(batches, most):
            for total, h in zip(totals, windows(rows, window, prefixes)[3:], strict=True):
                total += np.bincount((h % np.uint64(len(total))).astype(np.int64), minlength=len(total))
        for level, total in enumerate(totals):
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), level, np.int32)), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["level", "bucket", "n"])

    return docs.mapInArrow(run, "level int, bucket int, n long").groupBy("level", "bucket").agg(F.sum("n").alias("n"))


def groups_of_prefixes(counts: list[np.ndarray], group_windows: int) -> tuple[list[np.ndarray], int, int]:
    """The group of each bucket of each level (-1: its prefix must be longer), the first group of whole windows, and the number of groups.

    Buckets are put together in order while they fit.
    """
    out, first, passed = [], 0, int(counts[0].sum()) if counts else 0
    for n in counts:
        hot = n > group_windows
        filled = np.cumsum(np.where(hot, 0, n)) // max(1, group_windows // 2)
        out.append(np.where(hot, -1, first + filled).astype(np.int32))
        first += int(filled[-1]) + 1
        passed = min(passed, int(n[hot].sum()))
    return out, first, first + max(1, -(-2 * passed // group_windows))


def _sent(rows: list[tuple], settings: SubstringDedup, tables: list[np.ndarray], first: int, groups: int) -> Iterator[tuple[int, bytes]]:
    """(group, packed suffixes) of one portion of texts, and under group -1 the repeats that it found itself."""
    row, start, window, *prefixes = windows(rows, settings.window, settings.prefixes)
    if not len(window):
        return
    order = np.argsort(window)
    edge = np.flatnonzero(np.r_[True, window[order][1:] != window[order][:-1]])
    lead = np.sort(np.minimum.reduceat(order, edge))  # the earliest of equal windows; suffixes stand by doc_id and place
    repeat = np.ones(len(window), bool)
    repeat[lead] = False
    if repeat.any():
        yield -1, pack(row[repeat].astype(np.uint32), start[repeat].astype(np.uint32))
    group = np.full(len(lead), -1, np.int64)
    for h, table in zip(prefixes, tables, strict=True):
        group = np.where(group < 0, table[(h[lead] % np.uint64(len(table))).astype(np.int64)], group)
    group = np.where(group < 0, first + (window[lead] % np.uint64(groups - first)).astype(np.int64), group)
    dealt = np.argsort(group.astype(np.uint16) if groups < 1 << 16 else group, kind="stable")
    lead, group = lead[dealt], group[dealt]
    ids = np.array([-(2**63) if r[0] is None else r[0] for r in rows], np.int64)
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        mine = lead[a:b]
        begin = np.flatnonzero(np.r_[True, row[mine][1:] != row[mine][:-1]])
        own = row[mine][begin]
        steps = np.diff(start[mine], prepend=0)
        steps[begin] = start[mine][begin]
        yield int(group[a]), pack(window[mine], np.diff(ids[own], prepend=0).view(np.uint64), own.astype(np.uint32), np.diff(np.r_[begin, b - a]).astype(np.uint32), steps.astype(np.uint32))


def suffixes(docs: DataFrame, settings: SubstringDedup, tables: list[np.ndarray], first: int, groups: int) -> DataFrame:
    """grp, portion, value: packed suffixes of a group, or the repeats (grp -1) that a portion met itself."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(tables)
    schema = pa.schema([("grp", pa.int64()), ("portion", pa.int64()), ("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, rows in enumerate(portions(batches, settings.portion_bytes)):
            sent = [(group, (task << 32) | number, value) for group, value in _sent(rows, settings, shared.value, first, groups)]
            if sent:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*sent, strict=True), schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, "grp long, portion long, value binary")


def subtree_repeats(values: list[tuple[int, bytes]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(portion, rows, starts) of the suffixes that aren't the earliest below their internal node of window depth."""
    parts = [unpack(v) for _, v in values]
    sizes = [len(p[0]) for p in parts]
    window = np.concatenate([p[0] for p in parts])
    order = np.argsort(window)
    deep = window[order][1:] == window[order][:-1]  # neighbours in suffix order that agree to the window's depth
    inner = order[np.r_[deep, False] | np.r_[False, deep]]
    if not len(inner):
        return
    ids = np.concatenate([np.repeat(np.cumsum(p[1].view(np.int64)), p[3].astype(np.int64)) for p in parts])[inner]
    row = np.concatenate([np.repeat(p[2], p[3].astype(np.int64)) for p in parts])[inner]
    start = []
    for p in parts:
        n, total = p[3].astype(np.int64), np.cumsum(p[4].astype(np.int64))
        start.append(total - np.repeat(np.r_[0, total[np.cumsum(n)[:-1] - 1]], n))
    start = np.concatenate(start)[inner]
    source = np.repeat(np.arange(len(parts)), sizes)[inner]
    portion = np.array([p for p, _ in values])[source]
    by = np.lexsort((start, row, portion, ids, window[inner]))
    gone = by[1:][window[inner][by][1:] == window[inner][by][:-1]]
    gone = gone[np.argsort(source[gone], kind="stable")]
    cuts = np.searchsorted(source[gone], np.arange(len(parts) + 1))
    for k, (name, _) in enumerate(values):
        mine = gone[cuts[k] : cuts[k + 1]]
        if len(mine):
            yield name, row[mine], start[mine]


def repeats(sent: DataFrame) -> DataFrame:
    """portion and value (packed rows and starts) of the repeats of each group; rows stand by group."""
    import pyarrow as pa

    schema = pa.schema([("portion", pa.int64()), ("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            out = [(portion, pack(row.astype(np.uint32), start.astype(np.uint32))) for portion, row, start in subtree_repeats(sorted(held))] if now is not None and now >= 0 else held
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for group, portion, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != now or (group < 0 and len(held) >= 100):
                    if held:
                        yield from done()
                    now, held = group, []
                held.append((portion, value))
        if held:
            yield from done()

    return sent.mapInArrow(run, "portion long, value binary")


def texts_of_portions(docs: DataFrame, settings: SubstringDedup) -> DataFrame:
    """portion and value: the documents of a portion, their words joined by blanks, compressed."""
    import pyarrow as pa

    most = settings.portion_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, rows in enumerate(portions(batches, most)):
            texts = [b" ".join((t or b"").split()) for _, t in rows]
            lengths = np.array([(len(t), d is None, d or 0) for t, (d, _) in zip(texts, rows, strict=True)], np.int64).T
            value = pack(*(np.ascontiguousarray(c).view(np.uint64) for c in lengths))
            body = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
            out = len(value).to_bytes(8, "little") + value + body
            yield pa.RecordBatch.from_arrays([pa.array([(task << 32) | number]), pa.array([b"T" + out], pa.binary())], names=["portion", "value"])

    return docs.mapInArrow(run, "portion long, value binary")


def maximal_repeats(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """(start, length) of the runs that windows at ascending ``starts`` join to."""
    edge = np.flatnonzero(np.r_[True, np.diff(starts) > 1, True])
    return [(int(starts[a]), int(starts[b - 1] - starts[a]) + window) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def without(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    """``words`` outside the spans, which are ascending and may overlap."""
    out, at = [], 0
    for start, length in spans:
        out += words[at : max(at, start)]
        at = max(at, start + length)
    return out + words[at:]


def dedup_substrings(docs: DataFrame, settings: SubstringDedup | None = None, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by single blanks, as binary) and repeats (start and length in words) of every row.

    Null and empty texts have no words; documents shorter than a window lose none. Rows that share a doc_id
    are ordered by their place in the input, null ids come first; an empty table gives no row. doc_id must be
    whole numbers. The input must be the same when it is read again (files, or a table written before), as
    documents are recognised by portion and place.
    """
    import pyarrow as pa

    settings = settings or SubstringDedup()
    spark = docs.sparkSession
    columns = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    counts = [np.zeros(b, np.int64) for b in settings.buckets]
    for r in prefix_counts(columns, settings).collect():  # one for each bucket
        counts[r.level][r.bucket] = r.n
    tables, first, groups = groups_of_prefixes(counts, settings.group_windows)
    # A window has its own word and a blank at least, about six bytes as a rule.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 6 * int(counts[0].sum()) // settings.part_bytes)
    sent = suffixes(columns, settings, tables, first, groups).repartitionById(parts, F.expr(f"cast(if(grp < 0, portion, grp) % {parts} as int)"))
    found = repeats(sent.sortWithinPartitions("grp"))
    window = settings.window
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("repeats", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))])

    def portion_rows(values: list[bytes]) -> Iterator[pa.RecordBatch]:
        import zstandard

        value = next(v for v in values if v[:1] == b"T")
        cut = 9 + int.from_bytes(value[1:9], "little")
        lengths, null, ids = (x.view(np.int64) for x in unpack(value[9:cut]))
        body = zstandard.ZstdDecompressor().decompress(value[cut:]) if lengths.any() else b""
        packed = [unpack(v[1:]) for v in values if v[:1] == b"R"]
        row, start = (np.concatenate([p[k] for p in packed] or [np.zeros(0, np.uint32)]).astype(np.int64) for k in (0, 1))
        order = np.lexsort((start, row))
        row, start = row[order], start[order]
        cuts, ends = np.searchsorted(row, np.arange(len(lengths) + 1)), np.cumsum(lengths)
        out = []
        for k, (end, length) in enumerate(zip(ends.tolist(), lengths.tolist(), strict=True)):
            kept, spans = body[end - length : end], []
            n = left = kept.count(b" ") + 1 if length else 0
            if cuts[k] < cuts[k + 1]:
                spans = maximal_repeats(start[cuts[k] : cuts[k + 1]], window)
                words = without(kept.split(b" "), spans)
                kept, left = b" ".join(words), len(words)
            out.append((None if null[k] else int(ids[k]), n, n - left, kept, [{"start": a, "length": b} for a, b in spans]))
            if len(out) == 2_000 or k == len(lengths) - 1:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for portion, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if portion != now and held:
                    yield from portion_rows(held)
                    held = []
                now = portion
                held.append(value)
        if held:
            yield from portion_rows(held)

    marked = found.select("portion", F.concat(F.lit(b"R"), F.col("value")).alias("value"))
    met = texts_of_portions(columns, settings).union(marked).repartition("portion").sortWithinPartitions("portion")
    return met.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary, repeats array<struct<start:int,length:int>>")


def dedup_digest(docs: DataFrame, settings: SubstringDedup | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    found = dedup_substrings(documents_only(docs, "doc_id", "text"), settings)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i:i + 19], ' ') AS win FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
again AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY win ORDER BY doc_id NULLS FIRST, r, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS p FROM again),
place AS (SELECT d.r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT place.r, string_agg(word, ' ' ORDER BY place.p) AS body, count(*) AS n FROM place ANTI JOIN gone ON gone.r = place.r AND gone.p = place.p GROUP BY place.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.r = d.r
"""
