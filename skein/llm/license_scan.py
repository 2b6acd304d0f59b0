"""License scan: a positional index of rare licence words.

The templates' words form a fixed vocabulary. Their document frequencies over the whole corpus give
inverse document frequencies (IDF). A file is looked up by its highest-IDF licence words and by the rarest
word of each template's mandatory phrase, so no place is lost to other words of the file: each occurrence
of one proposes, through the templates' postings, the place where a template would start. A place is kept
when the template words that stand at their relative positions carry enough of the template's IDF and the
template's mandatory phrase stands where it must. Fixed phrases are found through their rarest word, at
every place.

All of it is column expressions: one scan for the frequencies (a sum of at most one row for each
vocabulary word and task), one scan for the matches, and no exchange of documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.words import documents_only, word_array

# Base phrases and their labels.
BASE_PHRASES = {
    "cc-by": "cc by",
    "gpl": "general public license",
    "reserved": "all rights reserved",
}

# Licence notices as their licences word them, each with its mandatory phrase.
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "cc by nc"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "cc by sa"),
    "cc0": ("released under the creative commons cc0 1 0 universal public domain dedication", "cc0 1 0"),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose"),
    "lgpl": ("licensed under the gnu lesser general public license", "lesser general public license"),
    "mit": ("released under the mit license", "mit license"),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "unencumbered software released"),
}


PLACES = "array<struct<label:string,start:bigint>>"
NOTICES = "array<struct<label:string,start:bigint,coverage:double>>"


@dataclass(frozen=True)
class LicenseIndex:
    """Phrases, templates and the parameters of the search. Its size is fixed by the templates, not the corpus."""

    phrases: dict = field(default_factory=lambda: dict(BASE_PHRASES))
    templates: dict = field(default_factory=lambda: dict(TEMPLATES))
    rare_words: int = 6
    least_coverage: float = 0.6

    def vocabulary(self) -> list[str]:
        return sorted({w for p in self.phrases.values() for w in p.split()} | {w for t, _ in self.templates.values() for w in t.split()})


def document_frequencies(docs: DataFrame, index: LicenseIndex, text: str = "text") -> tuple[dict[str, int], int]:
    """Documents that hold each vocabulary word, and all documents. One row for each vocabulary word reaches the driver."""
    vocabulary = index.vocabulary()
    words = word_array(F.col(f"`{text}`"))
    found = docs.select(F.explode_outer(F.concat(F.array(F.lit("")), F.array_intersect(words, F.array(*map(F.lit, vocabulary))))).alias("word"))
    counts = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: counts.get(w, 0) for w in vocabulary}, counts.get("", 0)


def inverse_frequencies(df: dict[str, int], n: int) -> dict[str, float]:
    return {w: round(math.log((n + 1) / (c + 1)) + 0.01, 9) for w, c in df.items()}


def _texts(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def scan(docs: DataFrame, index: LicenseIndex | None = None, text: str = "text", idf: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with ``n_words``, ``places`` (base phrases: label, start) and ``notices`` (templates: label, start, coverage).

    Each row is judged alone: repeated rows give repeated results, null and empty texts give no words and
    empty arrays, and an empty table gives an empty result. Starts count words from 0.
    """
    index = index or LicenseIndex()
    if idf is None:
        idf = inverse_frequencies(*document_frequencies(docs, index, text))
    anchors = {label: min(p.split(), key=lambda w: (-idf[w], w)) for label, p in index.phrases.items()}
    rarest = sorted(set(anchors.values()) | {min(m.split(), key=lambda w: (-idf[w], w)) for _, m in index.templates.values()})
    source = F.col(f"`{text}`")
    out = docs.withColumn("__all", word_array(source))
    # Files without any of these words can hold neither a phrase nor a mandatory phrase.
    found = F.when(F.arrays_overlap("__all", _texts(rarest)), F.col("__all")).otherwise(F.array().cast("array<string>"))
    out = out.select("*", F.size("__all").cast("long").alias("__n_words"), found.alias("__words")).drop("__all")
    weights = F.create_map(*(x for w in index.vocabulary() for x in (F.lit(w), F.lit(idf[w]))))
    vocabulary = _texts(index.vocabulary())
    out = out.withColumn("__posted", F.filter(F.transform(F.col("__words"), lambda w, i: F.when(F.array_contains(vocabulary, w), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull()))
    words, posted = F.col("__words"), F.col("__posted")

    def at(start: Column, phrase: list[str]) -> Column:
        return (start >= 0) & F.when(start >= 0, F.slice(words, F.greatest(start, F.lit(0)) + 1, len(phrase)) == _texts(phrase)).otherwise(F.lit(False))

    def starts_of(word: str, offset: int) -> Column:
        return F.transform(F.filter(posted, lambda x: x["w"] == word), lambda x: x["i"] - offset)

    def phrase_places(label: str, tokens: list[str]) -> Column:
        starts = starts_of(anchors[label], tokens.index(anchors[label]))
        return F.transform(F.filter(starts, lambda s: at(s, tokens)), lambda s: F.struct(F.lit(label).alias("label"), s.cast("long").alias("start")))

    # The file's rarest licence words look up the templates' postings, beside each template's anchor.
    ranked = F.array_sort(F.array_distinct(F.transform(posted, lambda x: F.struct((-F.element_at(weights, x["w"])).alias("k"), x["w"].alias("w")))))
    out = out.withColumn("__rare", F.transform(F.slice(ranked, 1, index.rare_words), lambda x: x["w"]))
    rare = F.col("__rare")

    def template_notices(label: str, tokens: list[str], needed: list[str]) -> Column:
        shift = next(i for i in range(len(tokens)) if tokens[i : i + len(needed)] == needed)
        total = sum(idf[w] for w in tokens)
        anchor = shift + needed.index(min(needed, key=lambda w: (-idf[w], w)))
        looked_up = [starts_of(w, o) if o == anchor else F.when(F.array_contains(rare, w), starts_of(w, o)).otherwise(F.array().cast("array<int>")) for o, w in enumerate(tokens)]
        starts = F.filter(F.array_distinct(F.concat(*looked_up)), lambda s: at(s + shift, needed))

        def coverage(start: Column) -> Column:
            held = [F.when(F.when(start + j >= 0, F.get(words, start + j)) == w, F.lit(idf[w])).otherwise(F.lit(0.0)) for j, w in enumerate(tokens)]
            return F.least(F.lit(1.0), sum(held[1:], held[0]) / F.lit(total))

        made = F.transform(starts, lambda s: F.struct(F.lit(label).alias("label"), s.cast("long").alias("start"), coverage(s).alias("coverage")))
        return F.filter(made, lambda x: x["coverage"] >= index.least_coverage)

    places = [phrase_places(label, phrase.split()) for label, phrase in sorted(index.phrases.items())]
    notices = [template_notices(label, t.split(), m.split()) for label, (t, m) in sorted(index.templates.items())]
    # Evaluated for the files that the lookup let through alone.
    found = F.when(F.size(words) > 0, F.struct(F.concat(*places).alias("places"), F.concat(*notices).alias("notices")))
    none = F.struct(F.array().cast(PLACES).alias("places"), F.array().cast(NOTICES).alias("notices"))
    out = out.withColumn("__found", F.coalesce(found, none))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), F.col("__n_words").alias("n_words"), F.col("__found.places").alias("places"), F.col("__found.notices").alias("notices"))


def summary(scanned: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each scanned row: counts, first and last place, labels and the best coverage."""
    starts = F.transform("places", lambda x: x["start"])
    base = F.array_distinct(F.transform("places", lambda x: x["label"]))
    own = F.array_distinct(F.concat(base, F.transform("notices", lambda x: x["label"])))
    best = F.coalesce(F.array_max(F.transform("notices", lambda x: x["coverage"])), F.lit(0.0))
    return scanned.select(
        *keep,
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(own), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.round(best, 6)).alias("score"),
    )


def license_digest(docs: DataFrame, index: LicenseIndex | None = None) -> DataFrame:
    """The digest of every document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A document without a place has null first_word and last_word, empty labels and score 0.
    """
    return summary(scan(documents_only(docs, "doc_id", "text"), index), ["doc_id"])


def oracle_sql() -> str:
    """The digest in DuckDB SQL, by comparing every place with every phrase."""
    quoted = lambda words: "[" + ",".join(f"'{w}'" for w in words) + "]"
    base = ",".join(f"('{label}', {quoted(p.split())})" for label, p in BASE_PHRASES.items())
    rows = []
    for label, (template, phrase) in TEMPLATES.items():
        t, m = template.split(), phrase.split()
        rows.append(f"('{label}', {quoted(t)}, {quoted(m)}, {next(i for i in range(len(t)) if t[i : i + len(m)] == m)})")
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
base(label, p) AS (VALUES {base}),
templates(label, t, m, shift) AS (VALUES {",".join(rows)}),
vocabulary AS (SELECT DISTINCT unnest(p) AS word FROM base UNION SELECT DISTINCT unnest(t) FROM templates),
held AS (SELECT word, count(*) AS c FROM (SELECT r, unnest(list_distinct(w)) AS word FROM d) SEMI JOIN vocabulary USING (word) GROUP BY word),
idf AS (SELECT word, round(ln(((SELECT count(*) FROM d) + 1) / (coalesce(c, 0) + 1)) + 0.01, 9) AS idf FROM vocabulary LEFT JOIN held USING (word)),
firsts AS (SELECT DISTINCT p[1] AS word FROM base UNION SELECT DISTINCT m[1] FROM templates),
spots AS MATERIALIZED (SELECT r, w, i, w[i] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE w[i] IN (SELECT word FROM firsts)),
places AS (SELECT spots.r, base.label, spots.i - 1 AS start FROM spots JOIN base ON spots.word = p[1] AND w[i:i + len(p) - 1] = p),
starts AS (SELECT spots.r, spots.w, label, t, spots.i - 1 - shift AS start FROM spots JOIN templates ON spots.word = m[1] AND w[i:i + len(m) - 1] = m),
worded AS (SELECT r, label, start, t[j] AS word, start + j - 1 >= 0 AND start + j <= len(w) AND w[greatest(start + j, 1)] = t[j] AS same FROM (SELECT *, unnest(range(1, len(t) + 1)) AS j FROM starts)),
notices AS (SELECT r, label, start, least(1, sum(CASE WHEN same THEN idf ELSE 0 END) / sum(idf)) AS coverage FROM worded JOIN idf USING (word) GROUP BY ALL HAVING coverage >= 0.6),
found AS (SELECT r, count(*) AS n, min(start) AS a, max(start) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY r),
best AS (SELECT r, max(coverage) AS score FROM notices GROUP BY r),
own AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM places UNION SELECT r, label FROM notices) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word, coalesce(found.labels, '') AS base_labels,
  coalesce(own.labels, '') AS labels, CASE WHEN n > 0 THEN 1.0 ELSE round(coalesce(best.score, 0), 6) END::DOUBLE AS score
FROM d LEFT JOIN found ON found.r = d.r LEFT JOIN best ON best.r = d.r LEFT JOIN own ON own.r = d.r
"""
