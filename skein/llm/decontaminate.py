"""Benchmark decontamination by a hash set of test n-grams.

Items are cut into windows of ``n`` words (an item of fewer words is one window). The hashes of the
distinct windows are the lookup side of a join with the windows of every training document; a hit counts
once its words equal the window's. The lookup side is broadcast while its counted size is within
``broadcast_windows``; beyond that the same join runs as a shuffled one, to which each window sends its own words.

All of it is DataFrame operations. Documents aren't shuffled: each sends one row and one for each hit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.words import documents_only, word_array


@dataclass(frozen=True)
class Decontamination:
    n: int = 8
    least_items: int = 2
    #: At about 200 bytes a window, the broadcast side stays within 50 MB.
    broadcast_windows: int = 250_000


def item_windows(items: DataFrame, n: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """One row for each distinct window: its words, hash, length and the ids of the items that hold it."""
    worded = items.select(F.col(f"`{key}`").cast("string").alias("item"), word_array(F.col(f"`{text}`")).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))
    windows = F.when(F.size("w") > 0, F.transform(starts, lambda i: F.slice("w", i + 1, n)))
    return (
        worded.where("item is not null")
        .select("item", F.explode(F.array_distinct(windows)).alias("window"))
        .groupBy("window")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .select("window", "items", F.size("window").alias("length"), F.xxhash64("window").alias("hash"))
    )


def _window_hashes(lengths: list[int], words: Column, position: Column) -> list[Column]:
    return [F.struct(F.lit(k).alias("k"), F.when(position + k <= F.size(words), F.xxhash64(F.slice(words, position + 1, k))).alias("h")) for k in lengths]


def hits(docs: DataFrame, items: DataFrame, settings: Decontamination | None = None, text: str = "text") -> DataFrame:
    """``doc_id``, ``digest`` (of the text), ``n_words``, ``copies`` and ``spans`` (start, length, items) for each distinct (doc_id, text).

    Rows that repeat a doc_id with the same text are gathered into one row with their number in ``copies``.
    """
    settings = settings or Decontamination()
    windows = item_windows(items, settings.n)
    sizes = {r["length"]: r["n"] for r in windows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    lookup = windows.withColumnsRenamed({"hash": "lookup_hash", "length": "lookup_length"})
    small = sum(sizes.values()) <= settings.broadcast_windows
    if small:
        lookup = F.broadcast(lookup)
    lengths = sorted(sizes) or [settings.n]
    body = F.col(f"`{text}`")
    worded = docs.select(F.col("`doc_id`").alias("doc_id"), F.xxhash64(body).alias("digest"), word_array(body).alias("w"))
    # The outer form keeps documents without words, and spares the filter that would cut the text into words again.
    placed = worded.select("doc_id", "digest", "w", F.posexplode_outer("w").alias("p", "word"))
    if len(lengths) == 1:
        keyed = placed.select("*", _window_hashes(lengths, F.col("w"), F.col("p"))[0].alias("key"))
    else:
        keyed = placed.select("*", F.explode_outer(F.array(*_window_hashes(lengths, F.col("w"), F.col("p")))).alias("key"))
    # A broadcast side is met in place, so the words stay where they are; a shuffled one is sent each window's own words.
    own = F.col("w") if small else F.slice("w", F.col("p") + 1, F.col("key.k"))
    sized = keyed.select("doc_id", "digest", F.size("w").alias("n"), "p", F.col("key.k").alias("k"), F.col("key.h").alias("h"), own.alias("own"))
    met = sized.join(lookup, (F.col("h") == F.col("lookup_hash")) & (F.col("k") == F.col("lookup_length")), "left")
    same = F.col("window").isNotNull() & ((F.slice("own", F.col("p") + 1, F.col("k")) if small else F.col("own")) == F.col("window"))
    first = (F.coalesce(F.col("p"), F.lit(0)) == 0) & (F.col("k") == lengths[0])
    found = met.select(
        "doc_id",
        "digest",
        F.when(first, F.greatest("n", F.lit(0)).cast("long")).alias("n_words"),
        F.when(same, F.struct(F.col("p").alias("start"), F.col("k").alias("length"), F.col("items").alias("items"))).alias("span"),
    ).where("n_words is not null or span is not null")
    return found.groupBy("doc_id", "digest").agg(F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"), F.array_sort(F.collect_set("span")).alias("spans"))


def hit_words(spans: Column) -> Column:
    """Number of words inside any span. Spans are sorted by start; each adds what lies beyond those before it."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def add(acc: Column, x: Column) -> Column:
        end = x["start"] + x["length"]
        more = F.greatest(end - F.greatest(x["start"], acc["end"]), F.lit(0))
        return F.struct((acc["n"] + more).cast("long").alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(spans, zero, add, lambda acc: acc["n"])


def contamination_digest(docs: DataFrame, items: DataFrame, settings: Decontamination | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document row.

    Null texts have no words; an empty benchmark hits nothing; rows with a null item_id are no items.
    """
    settings = settings or Decontamination()
    found = hits(docs, items, settings).withColumn("ids", F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda x: x["items"])))))
    digest = found.select(
        "doc_id",
        "n_words",
        hit_words(F.col("spans")).alias("n_hit"),
        F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"),
        (F.size("ids") >= settings.least_items).alias("contaminated"),
        "copies",
    )
    return digest.select("*", F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int"))).alias("copy")).drop("copies", "copy")


def decontaminate(docs: DataFrame, items: DataFrame, mode: str = "documents", settings: Decontamination | None = None) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window, or (``mode='spans'``) without the words hit.

    Columns stay as they are, whatever their names. Null texts hold nothing; rows that repeat a doc_id are judged
    by their own texts; an empty benchmark leaves all rows, an empty table stays empty. In span mode the words
    left are joined by single blanks, and only in documents hit.
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode is 'documents' or 'spans'")
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(F.col("`text`")).alias("own"))
    hit = hits(documents_only(docs, "doc_id", "text"), items, settings).where(F.size("spans") > 0).select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest"), F.col("spans").alias("hit_spans"))
    on = F.col("row.doc_id").eqNullSafe(F.col("hit_id")) & (F.col("own") == F.col("hit_digest"))
    if mode == "documents":
        return row.join(hit.drop("hit_spans"), on, "left_anti").select(*(F.col(f"row.`{c}`") for c in docs.columns))
    words = word_array(F.col("row.text"))
    inside = lambda i: F.exists("hit_spans", lambda s: (i >= s["start"]) & (i < s["start"] + s["length"]))
    left = F.when(F.col("hit_spans").isNotNull(), F.array_join(F.filter(words, lambda w, i: ~inside(i)), " ")).otherwise(F.col("row.text"))
    return row.join(hit, on, "left").select(*(left.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, array_to_string(w[i:i + 7], ' ') AS win, len(w[i:i + 7]) AS k FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
pos AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT k FROM win) WHERE i + k - 1 <= len(w)),
hit AS (SELECT pos.r, pos.i, pos.k, win.item FROM pos JOIN win ON pos.win = win.win AND pos.k = win.k),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
held AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(held.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(held.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN covered ON covered.r = d.r LEFT JOIN held ON held.r = d.r
"""
