"""Word rules and native column helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters that separate words: all but digits and letters.
SEPARATORS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.translate(text, UPPER, LOWER)


def word_array(text: Column) -> Column:
    """Words of ``text`` in order, A-Z lower-cased; null and empty texts have none.

    One pass maps letters and separators; a split at one literal blank needs no regular expression.
    """
    mapped = F.translate(F.coalesce(text, F.lit("")), UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    return F.array_remove(F.split(mapped, " "), "")


def documents_only(docs: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, so that clashing names among further columns can't matter."""
    return docs.select(*(F.col(f"`{n}`") for n in names))


#: Odd, so that it has an inverse modulo 2 ** 64.
RADIX = 0xA0761D6478BD642F
_AFTER_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_TABLES: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers, at least, of the radix and of its inverse."""
    if len(_TABLES.get("up", ())) < n:
        for name, base in (("up", RADIX), ("down", pow(RADIX, -1, 2**64))):
            steps = np.full(max(n, 1 << 18), base, np.uint64)
            steps[0] = 1
            _TABLES[name] = np.cumprod(steps, dtype=np.uint64)
    return _TABLES["up"], _TABLES["down"]


def _letters(lower: bool) -> np.ndarray:
    """A fixed random value for each byte; 0 for white space. With ``lower``, A-Z have the values of a-z."""
    if ("letters", lower) not in _TABLES:
        values = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        values[[32, *range(9, 14)]] = 0
        if lower:
            values[65:91] = values[97:123]
        _TABLES["letters", lower] = values
    return _TABLES["letters", lower]


def spread(h: np.ndarray) -> np.ndarray:
    """Mixes the bits of each value, one to one."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values ascending, and for each value its number among them; by one unstable sort."""
    order = np.argsort(values)
    ordered = values[order]
    first = np.r_[True, ordered[1:] != ordered[:-1]][: len(values)]
    inverse = np.empty(len(values), np.int64)
    inverse[order] = np.cumsum(first) - 1
    return ordered[first], inverse


def _pieces(texts: list[bytes | None], most: int) -> Iterator[tuple[int, bytes]]:
    """Texts with their numbers; those of more than ``most`` bytes are cut at white space."""
    for k, text in enumerate(texts):
        text, at = text or b"", 0
        while len(text) - at > most:
            blank = _AFTER_BLANK.search(text, at + most)
            end = blank.start() if blank else len(text)
            yield k, text[at:end]
            at = end
        yield k, text[at:] if at else text


def hashed_runs(buffer: bytes, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the runs of bytes whose letters aren't 0. ``buffer`` begins and ends outside any run."""
    raw = np.frombuffer(buffer, np.uint8)
    up, down = _powers(len(raw))
    with np.errstate(over="ignore"):
        value = letters.take(raw) * up[: len(raw)]
        blank = value == 0
        before = np.flatnonzero(blank[:-1] & ~blank[1:])
        last = np.flatnonzero(~blank[:-1] & blank[1:])
        total = np.cumsum(value)
        return spread((total[last] - total[before]) * down[before + 1]), before + 1, last + 1


def hashed_words(texts: list[bytes | None], lower: bool = False, most: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts in order, and the number of words of each text.

    A word's hash is a polynomial of its bytes' values, taken for a whole buffer by one running sum.
    """
    out, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    letters, held, size = _letters(lower), [], 0

    def flush() -> None:
        found, start, _ = hashed_runs(b" " + b" ".join([p for _, p in held]) + b" ", letters)
        out.append(found)
        offsets = np.cumsum([len(p) + 1 for _, p in held])
        np.add.at(counts, [k for k, _ in held], np.diff(np.searchsorted(start, offsets + 1), prepend=0))

    for k, piece in _pieces(texts, most):
        held.append((k, piece))
        size += len(piece) + 1
        if size >= most:
            flush()
            held, size = [], 0
    if held:
        flush()
    return np.concatenate(out), counts


def gram_hashes(words: np.ndarray, n: int, block: int = 1 << 19) -> np.ndarray:
    """Hash of the ``n`` words from each place on; places with fewer words ahead have that of the rest."""
    out = np.empty(len(words), np.uint64)
    for at in range(0, len(words), block):
        part = words[at : at + block + n - 1]
        up, down = _powers(len(part))
        with np.errstate(over="ignore"):
            total = np.r_[np.uint64(0), np.cumsum(part * up[: len(part)])]
            m = min(block, len(words) - at)
            out[at : at + m] = spread((total[np.minimum(np.arange(m) + n, len(part))] - total[:m]) * down[:m])
    return out


def portions(batches: Iterator, most_bytes: int) -> Iterator[list[tuple]]:
    """Rows of Arrow batches in runs of about ``most_bytes`` of their last column, a binary text."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            for row in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True):
                held.append(row)
                size += len(row[-1] or b"") + 1
                if size >= most_bytes:
                    yield held
                    held, size = [], 0
    if held:
        yield held
