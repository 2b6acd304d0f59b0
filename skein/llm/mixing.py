"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a fixed shuffled order, are cut into blocks. Of a period of slots a source gets
a whole number, which is its target weight times the period; block k of a source with ``share`` slots is released at
slot floor(k * period / share) and due by slot ceil((k + 1) * period / share). Earliest deadline first among
the released blocks meets every window, so that at any slot a source is less than one block from its share.
The schedule repeats each period: one period is computed, and a block's slot follows from its number.

Slots of a source that has run out stay empty, so every document is kept and the others go on at their
rates. All of it is DataFrame operations. Ranks within a source are found in buckets of the shuffled order,
so no task holds a source, and positions follow from block numbers without a global sort.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_SOURCES = 2_000
#: Slots of a period of given weights.
MOST_SLOTS = 100_000


@dataclass(frozen=True)
class Mixing:
    block_documents: int = 16
    period: int = 1_000
    #: Weights are proportional to a source's number of documents to this power, unless given.
    temperature: float = 0.5
    weights: dict[str, float] | None = None
    #: Rows of a source that one bucket may hold, on average.
    bucket_rows: int = 20_000


def shares(sizes: dict[str, int], settings: Mixing) -> dict[str, int]:
    """Slots of each source in a period.

    Given weights are taken as the decimal fractions that they are written as, and the period is their common
    denominator, so the shares are exact; a source without a positive weight has no slots. Without weights a
    source gets one slot and more by its size, with largest remainders; these shares are then its target.
    """
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    names = sorted(sizes)
    if settings.weights is not None:
        exact = {s: Fraction(str(settings.weights[s])) for s in names if settings.weights.get(s, 0) > 0}
        if not exact:
            raise ValueError("no source has a positive weight")
        total = sum(exact.values())
        period = math.lcm(*((w / total).denominator for w in exact.values()))
        if period > MOST_SLOTS:
            raise ValueError(f"the weights have a common period of {period} slots, more than {MOST_SLOTS}")
        return {s: int(w / total * period) for s, w in exact.items()}
    weight = {s: sizes[s] ** settings.temperature for s in names}
    total, free = sum(weight.values()) or 1.0, max(settings.period, 2 * len(names)) - len(names)
    part = {s: free * weight[s] / total for s in names}
    out = {s: 1 + math.floor(part[s]) for s in names}
    left = free + len(names) - sum(out.values())
    for s in sorted(names, key=lambda s: (math.floor(part[s]) - part[s], s))[:left]:
        out[s] += 1
    return out


def schedule(frame: DataFrame, share: list[int]) -> DataFrame:
    """slot, source number, k and ``before`` (each source's blocks in earlier slots) of one period. frame: any table, for its session."""
    period, n = sum(share), len(share)
    a = f"array({','.join(map(str, share))})"
    pick = f"""array_min(filter(transform(acc.k, (v, i) -> if(v * {period} div {a}[i] <= t and v < {a}[i],
        struct(((v + 1) * {period} + {a}[i] - 1) div {a}[i] as due, i as s), null)), x -> x is not null)).s"""
    step = f"element_at(transform(array({pick}), p -> named_struct('k', transform(acc.k, (v, i) -> if(i = p, v + 1, v)), 'p', array_append(acc.p, p), 'b', array_append(acc.b, acc.k))), 1)"
    zero = f"named_struct('k', array_repeat(0L, {n}), 'p', cast(array() as array<int>), 'b', cast(array() as array<array<bigint>>))"
    made = f"aggregate(sequence(0, {period - 1}), {zero}, (acc, t) -> {step}, acc -> arrays_zip(acc.p, acc.b))"
    rows = frame.sparkSession.range(1).select(F.posexplode(F.expr(made)).alias("slot", "x")).select("slot", F.col("x.p").alias("s"), F.col("x.b").alias("before"))
    return rows.select("slot", "s", "before", F.get("before", F.col("s")).alias("k"))


def shuffled_key(key: Column) -> Column:
    return F.md5(F.coalesce(key.cast("string"), F.lit("")))


def place(docs: DataFrame, settings: Mixing | None = None) -> DataFrame:
    """``docs`` with block, release, deadline, slot and position (all long, from 0) of every row of a source with a positive weight.

    A null source is a source of its own. Within a source rows are ordered by the MD5 of doc_id, then
    doc_id; repeated rows are placed one after another. An empty table gives an empty result.
    """
    settings = settings or Mixing()
    named = docs.select("*", F.coalesce("source", F.lit("\x00")).alias("__source"), shuffled_key(F.col("doc_id")).alias("__key"))
    # One row for each source comes to the driver; their number is checked.
    sizes = {r["__source"]: r["n"] for r in named.groupBy("__source").agg(F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()}
    share = shares(sizes, settings) if sizes else {"": 1}
    if len(share) < len(sizes):  # given weights leave sources out
        placed_sources = [F.lit(s) for s in sorted(share)]
        named = named.where(F.col("__source").isin(*placed_sources))
        sizes = {s: sizes[s] for s in share}
    names, slots = sorted(share), [share[s] for s in sorted(share)]
    period, block = sum(slots), settings.block_documents
    digits = max(2, math.ceil(math.log(max(sizes.values(), default=1) / settings.bucket_rows + 1, 16)))
    placed = named.withColumn("__bucket", F.substring("__key", 1, digits))
    counts = placed.groupBy("__source", "__bucket").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__source", "__bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__offset"))
    within = Window.partitionBy("__source", "__bucket").orderBy("__key", "doc_id")
    ranked = placed.withColumn("__row", F.row_number().over(within) - 1).join(offsets, ["__source", "__bucket"])
    lookup = F.create_map(*(x for k, s in enumerate(names) for x in (F.lit(s), F.lit(k))))
    ranked = ranked.select(*(F.col(f"`{c}`") for c in docs.columns), F.element_at(lookup, F.col("__source")).alias("__s"), (F.col("__row") + F.col("__offset")).alias("__rank"))
    own = F.get(F.array(*map(F.lit, slots)), F.col("__s")).cast("long")
    ranked = ranked.select("*", F.floor(F.col("__rank") / block).cast("long").alias("__block"), own.alias("__own"))
    ranked = ranked.select("*", F.expr("__block div __own").alias("__period"), F.expr("__block % __own").alias("__k"))
    # One period: bounded by MOST_SOURCES, whatever the size of the input.
    template = F.broadcast(schedule(docs, slots).select(F.col("s").alias("__s"), F.col("k").alias("__k"), F.col("slot").alias("__slot"), F.col("before").alias("__before")))
    met = ranked.join(template, ["__s", "__k"])
    limits = F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(sizes.get(s, 0)).cast("long").alias("n")) for s, a in zip(names, slots, strict=True)))
    earlier = F.zip_with("__before", limits, lambda b, x: F.least(x["n"], (F.col("__period") * x["a"] + b) * block))
    position = F.aggregate(earlier, F.lit(0).cast("long"), lambda acc, x: acc + x) + F.col("__rank") % block
    return met.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        F.col("__block").alias("block"),
        F.expr(f"__block * {period} div __own").alias("release"),
        F.expr(f"((__block + 1) * {period} + __own - 1) div __own").alias("deadline"),
        (F.col("__period") * period + F.col("__slot")).cast("long").alias("slot"),
        position.cast("long").alias("position"),
    )


def mixing_digest(docs: DataFrame, settings: Mixing | None = None) -> DataFrame:
    """doc_id, source, block, release, deadline, slot, position of every row."""
    return place(docs.select("doc_id", "source"), settings)


def mixed(docs: DataFrame, settings: Mixing | None = None, partition_bytes: int = 64_000_000) -> DataFrame:
    """``docs`` in mixed order: partition i holds the i-th run of positions, sorted, of about ``partition_bytes`` of text.

    Columns stay as they are, whatever their names; nulls, repeated rows and empty tables as in :func:`place`.
    """
    total, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "source")
    parts = max(1, min(total, -(-(size or 0) // partition_bytes)))
    run = max(1, -(-total // parts))
    placed = place(inner, settings).select("row", "position")
    dealt = placed.repartitionById(parts, F.expr(f"cast(position div {run} as int)")).sortWithinPartitions("position")
    return dealt.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


ORACLE_SQL = r"""
WITH RECURSIVE sizes AS (
  SELECT coalesce(source, chr(1)) AS source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY 1
), exact AS (
  SELECT source, n, (greatest(1000, 2 * count(*) OVER ()) - count(*) OVER ()) * w / sum(w) OVER () AS x, greatest(1000, 2 * count(*) OVER ()) AS period FROM sizes
), base AS (
  SELECT *, 1 + floor(x)::BIGINT AS f, row_number() OVER (ORDER BY floor(x) - x, source) AS r, (row_number() OVER (ORDER BY source) - 1)::INT AS s FROM exact
), share AS (
  SELECT source, n, s, period::BIGINT AS period, (f + CASE WHEN r <= period - sum(f) OVER () THEN 1 ELSE 0 END)::BIGINT AS a FROM base
), lists AS (
  SELECT list(a ORDER BY s) AS a, max(period) AS period, count(*)::INT AS n FROM share
), run(t, k, pick, a, period) AS (
  SELECT 0::BIGINT, list_transform(range(n), lambda x: 0::BIGINT), NULL::INT, a, period FROM lists
  UNION ALL
  SELECT t + 1, list_transform(k, lambda v, i: CASE WHEN i = pick2 THEN v + 1 ELSE v END), pick2, a, period
  FROM (
    SELECT t, k, a, period, (list_min(list_filter(list_transform(k, lambda v, i:
      CASE WHEN (v * period) // a[i] <= t AND v < a[i] THEN ((v + 1) * period + a[i] - 1) // a[i] * 10000 + i END), lambda x: x IS NOT NULL)) % 10000)::INT AS pick2
    FROM run WHERE t < period
  )
), picks AS (
  SELECT t - 1 AS slot, pick - 1 AS s, k[pick] - 1 AS kk, list_transform(k, lambda v, i: CASE WHEN i = pick THEN v - 1 ELSE v END) AS before FROM run WHERE pick IS NOT NULL
), ranked AS (
  SELECT d.doc_id, d.source, h.s, h.a, h.period, row_number() OVER (PARTITION BY h.s ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id) - 1 AS rank
  FROM documents d JOIN share h ON h.source = coalesce(d.source, chr(1))
), blocks AS (
  SELECT *, rank // 16 AS block, (rank // 16) // a AS p, (rank // 16) % a AS kk FROM ranked
), ends AS (SELECT list(n ORDER BY s) AS n, list(a ORDER BY s) AS a FROM share)
SELECT b.doc_id, b.source, b.block::BIGINT AS block, ((b.block * b.period) // b.a)::BIGINT AS release, (((b.block + 1) * b.period + b.a - 1) // b.a)::BIGINT AS deadline,
  (b.p * b.period + x.slot)::BIGINT AS slot,
  (list_sum(list_transform(x.before, lambda v, i: least(e.n[i], (b.p * e.a[i] + v) * 16))) + b.rank % 16)::BIGINT AS position
FROM blocks b JOIN picks x ON x.s = b.s AND x.kk = b.kk CROSS JOIN ends e
"""
