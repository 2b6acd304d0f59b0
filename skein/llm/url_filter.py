"""URL allow and block lists as a trie over reversed host labels and path segments.

The rules are a parameter of bounded size (``most_rules`` is checked), so the trie is broadcast. Each URL
walks down its host labels from the right; at every label it tries the rules' paths, segment by segment.
The rule that fits with most host labels wins, among those the one with the longest path.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the query.
RULES = (
    UrlRule("block", "net", "/"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)
MOST_RULES = 1_000_000


def trie_of(rules: tuple[UrlRule, ...]) -> dict:
    """The rules as nested dicts, which workers can read without this package.

    A label, as a tuple of one, leads to the host below it; under the empty key stands the trie of paths. A
    path node maps whole segments to nodes; under the empty key it lists (rest, path length, verdict, name),
    where rest is the part after the last slash, which need only begin the next segment.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules are too many to broadcast")
    root: dict = {}
    for rule in rules:
        at = root
        for label in reversed(rule.host.split(".")):
            at = at.setdefault((label,), {})
        at = at.setdefault("", {})
        *segments, rest = rule.path.split("/")
        for segment in segments:
            at = at.setdefault((segment,), {})
        at.setdefault("", []).append((rest, len(rule.path), rule.verdict, rule.name))
    return root


def _longest_path(at: dict, path: str) -> tuple | None:
    segments, best = path.split("/"), None
    for k, segment in enumerate(segments):
        fits = [r for r in at.get("", ()) if segment.startswith(r[0])]
        best = max(fits, key=lambda r: r[1:3], default=best)
        if k == len(segments) - 1 or (at := at.get((segment,))) is None:
            break
    return best


def longest(trie: dict, host: str, path: str) -> tuple | None:
    """The rule that fits with most host labels, then with the longest path: (rest, path length, verdict, name)."""
    best = None
    for label in reversed(host.split(".")):
        if (trie := trie.get((label,))) is None:
            break
        if "" in trie:
            best = _longest_path(trie[""], path) or best
    return best


def host_and_path(url: str | None) -> tuple[str, str]:
    """The host with A-Z lower-cased and the path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    for stop in "?#":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, default: str = "allow", url: str = "url", key: str = "page_id") -> DataFrame:
    """``key``, host, path, rule and verdict of every row.

    A URL that no rule fits has a null rule and the default verdict; so have null URLs and those without
    ``://``, whose host and path are empty. Repeated rows give repeated results, an empty table gives none.
    """
    import pyarrow as pa

    trie = pages.sparkSession.sparkContext.broadcast(trie_of(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [host_and_path(u) for u in batch.column(1).to_pylist()]
            found = [longest(trie.value, h, p) if h else None for h, p in split]
            columns = [[h for h, _ in split], [p for _, p in split], [r and r[3] for r in found], [r[2] if r else default for r in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], names=["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema[key].dataType.simpleString()
    out = pages.select(F.col(f"`{key}`").alias("page_id"), F.col(f"`{url}`").alias("url"))
    return out.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("page_id", key)


ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest
  FROM pages
), cut AS (
  SELECT page_id, regexp_replace(rest, '[?#].*$', '', 's') AS rest FROM parts
), split AS (
  SELECT page_id,
    translate(CASE WHEN position('/' IN rest) > 0 THEN substr(rest, 1, position('/' IN rest) - 1) ELSE rest END,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN position('/' IN rest) > 0 THEN substr(rest, position('/' IN rest)) ELSE '' END AS path
  FROM cut
), rules(verdict, host, path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fitting AS (
  SELECT s.page_id, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.host) DESC, length(r.path) DESC) AS k
  FROM split s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM split s LEFT JOIN fitting f ON f.page_id = s.page_id AND f.k = 1
"""
