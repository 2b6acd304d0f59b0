"""Language-model scores from a probabilistic suffix tree over words.

Symbols are words and one end mark. A context of words is a candidate when it occurs often enough, and is a
state of the tree when its next-symbol distribution diverges from that of its longest proper suffix (a
state's suffixes are states as well). Distributions are smoothed towards the suffix's; the root is the
unigram distribution of every training word. A text is scored by the longest suffix state at each place.

The tree has two parts. Its top holds the contexts whose share of the training tokens reaches
``least_share``, so it has at most 1 / least_share contexts of a length and is broadcast. Below it, every
context that occurs ``least_count`` times is a candidate, whatever the size of the corpus: the places of a
portion of texts are dealt out by the shortest suffix that the top doesn't hold, so that each subtree is
built whole in one group, of at most the share ``least_share`` of all places, and is met there by all the
places that it scores. Words too rare for the vocabulary are counted in the same exchange.

Words are represented by 64-bit hashes: among n distinct words any two coincide with a chance of n² / 2⁶⁵.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.packing import pack, unpack
from skein.llm.quality import fold
from skein.llm.words import documents_only, hashed_words, numbered, portions, spread
from skein.plans.durable import durable

WIDE = np.int64(1 << 21)
#: What stands for the end mark among word hashes.
END = 0x656E64
#: Subtree keys: older word, then word or TOP + state of the top, then symbol.
BITS, TOP = 20, 1 << 20


@dataclass(frozen=True)
class SuffixTree:
    #: Words of the top's contexts, at most; subtrees go one word further, or two below the root.
    depth: int = 3
    #: At most 2,000 contexts of a length in the top, and 500 symbols of such a state.
    least_share: float = 5e-4
    least_symbol: float = 2e-3
    #: At most 1,000,000 words in the vocabulary.
    vocabulary_share: float = 1e-6
    #: Places of a word in the vocabulary, and of a context below the top.
    least_count: int = 20
    #: Divergence in nats from the suffix's distribution.
    divergence: float = 0.002
    smoothing: float = 20.0
    unigram: float = 0.1
    folds: int = 10
    #: Text that a task works on at once, and places of a group.
    portion_bytes: int = 5_000_000
    part_tokens: int = 1_000_000


@dataclass
class Level:
    """Contexts of one length: keys (shorter context * WIDE + symbol), and their states."""

    keys: np.ndarray
    symbols: np.ndarray
    values: np.ndarray
    rest: np.ndarray
    kept: np.ndarray

    def plain(self) -> tuple:
        return self.keys, self.symbols, self.values, self.rest, self.kept


def bare(keys: np.ndarray) -> Level:
    return Level(keys, np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, bool))


@dataclass
class Model:
    #: Hashes of the vocabulary; symbol k + 1 is the k-th.
    words: np.ndarray
    #: log10 root probability by symbol; 0 is any word outside the vocabulary, whose part comes later.
    root: np.ndarray
    levels: list[Level]
    total: int
    distinct: int
    unigram: float

    def plain(self) -> tuple:
        """The model without classes of this package, for workers that don't have it."""
        return self.words, self.root, [x.plain() for x in self.levels], self.total, self.distinct, self.unigram

    @property
    def norm(self) -> float:
        return self.total + self.unigram * (self.distinct + 1)

    def root_with_rest(self) -> np.ndarray:
        """The root with the probability of all words outside the vocabulary under symbol 0."""
        root = self.root.copy()
        root[0] = np.log10(max(1 - (10.0 ** root[1:]).sum(), 1e-9))
        return root


def restored(plain: tuple) -> Model:
    words, root, levels, total, distinct, unigram = plain
    return Model(words, root, [Level(*x) for x in levels], total, distinct, unigram)


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted value among sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def contexts(ids: np.ndarray, levels: list[Level]) -> list[np.ndarray]:
    """For each level, the context that ends at each place (-1: none). ids: symbols, with -1 between texts."""
    out = []
    before = np.zeros(len(ids), np.int64)
    for level in levels:
        now = find(level.keys, np.where((before >= 0) & (ids >= 0), before * WIDE + ids, -1))
        out.append(now)
        before = np.r_[-1, now[:-1]]
    return out


def log_probabilities(ids: np.ndarray, root: np.ndarray, levels: list[Level], ending: list[np.ndarray] | None = None) -> np.ndarray:
    """log10 probability of each symbol after those before it, by the longest state of the top."""
    out = np.where(ids >= 0, root[ids], 0.0)
    for level, at in zip(levels, ending or contexts(ids, levels), strict=True):
        before = np.r_[-1, at[:-1]]
        before = np.where((before >= 0) & (ids >= 0), before, -1)
        inside = (before >= 0) & level.kept[before] if len(level.kept) else np.zeros(len(ids), bool)
        place = find(level.symbols, np.where(inside, before * WIDE + ids, -1))
        given = level.values[place] if len(level.values) else out
        out = np.where(inside, np.where(place >= 0, given, out + (level.rest[before] if len(level.rest) else 0)), out)
    return out


class Symbols:
    """Symbol numbers of texts; 0 stands for words outside the vocabulary."""

    def __init__(self, words: np.ndarray):
        self.order = np.argsort(words)
        self.sorted = words[self.order]
        self.end = int(np.flatnonzero(words == END)[0]) + 1

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols with an end mark and -1 after each text, hashes at the same places, and the texts' numbers of words."""
        words, counts = hashed_words(texts, lower=True)
        distinct, inverse = numbered(words)
        at = find(self.sorted, distinct)
        number = np.where(at >= 0, self.order[at] + 1, 0) if len(self.order) else np.zeros(len(distinct), np.int64)
        place = np.arange(len(words)) + 2 * np.repeat(np.arange(len(texts)), counts)
        ends = np.cumsum(counts) + 2 * np.arange(len(texts))
        ids, hashes = np.empty(len(words) + 2 * len(texts), np.int64), np.zeros(len(words) + 2 * len(texts), np.uint64)
        ids[place], ids[ends], ids[ends + 1] = number[inverse], self.end, -1
        hashes[place] = words
        return ids, hashes, counts


def _training(docs: DataFrame, settings: SuffixTree) -> DataFrame:
    return docs.where(fold(F.col("doc_id"), settings.folds) != 0).select(F.col("text").cast("binary").alias("text"))


def word_counts(docs: DataFrame, settings: SuffixTree) -> DataFrame:
    """word (its hash) and c over all training texts, the end mark included."""
    import pyarrow as pa

    most = settings.portion_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in portions(batches, most):
            words, c = np.unique(hashed_words([r[-1] for r in rows], lower=True)[0], return_counts=True)
            words, c = np.r_[words, np.uint64(END)], np.r_[c, len(rows)]
            for k in range(0, len(words), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[k : k + 100_000].view(np.int64)), pa.array(c[k : k + 100_000])], names=["word", "c"])

    return _training(docs, settings).mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _followers(docs: DataFrame, words: np.ndarray, levels: list[Level], settings: SuffixTree) -> DataFrame:
    """key (deepest context * WIDE + next symbol) and c, over all training texts."""
    import pyarrow as pa

    shared, most = docs.sparkSession.sparkContext.broadcast((words, [x.plain() for x in levels])), settings.portion_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, plain = shared.value
        symbols, levels = Symbols(words), [Level(*x) for x in plain]
        for rows in portions(batches, most):
            ids = symbols([r[-1] for r in rows])[0]
            before, after = contexts(ids, levels)[-1][:-1], ids[1:]
            good = (before >= 0) & (after >= 0)
            keys, c = np.unique(before[good] * WIDE + after[good], return_counts=True)
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(c)], names=["key", "c"])

    return _training(docs, settings).mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _states(keys: np.ndarray, parents: list[Level], chains: np.ndarray, followers: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, root: np.ndarray, settings: SuffixTree) -> Level:
    """A level of the top: smoothed probabilities, the rest's weight, and which contexts diverge from their suffix.

    chains: the words of each context, oldest first. followers: sorted keys with their counts.
    """
    pairs, counts = followers
    context, symbol = pairs // WIDE, pairs % WIDE
    width = chains.shape[1]
    ids = np.concatenate([chains[context][:, 1:], symbol[:, None], np.full((len(pairs), 1), -1)], axis=1).reshape(-1) if len(pairs) else np.zeros(0, np.int64)
    below = 10.0 ** log_probabilities(ids, root, parents).reshape(len(pairs), width + 1)[:, width - 1] if len(pairs) else np.zeros(0)
    smooth = (counts + settings.smoothing * below) / (sizes[context] + settings.smoothing)
    n = len(keys)
    held, held_below = np.bincount(context, smooth, n), np.bincount(context, below, n)
    left, left_below = np.maximum(1 - held, 1e-9), np.maximum(1 - held_below, 1e-9)
    rest = np.log10(left / left_below)
    kept = np.bincount(context, smooth * np.log(smooth / below), n) + left * np.log(left / left_below) >= settings.divergence
    return Level(keys, pairs, np.log10(smooth), rest, kept)


def fit(docs: DataFrame, counts: DataFrame, settings: SuffixTree) -> Model:
    """Vocabulary and top of the tree from all training texts. What reaches the driver is bounded by the shares."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least_word = max(settings.least_count, settings.vocabulary_share * total)
    frequent = counts.where((F.col("c") >= least_word) | (F.col("word") == END)).toArrow()
    words, often = frequent["word"].to_numpy(), frequent["c"].to_numpy()
    order = np.lexsort((words, -often))
    words, often = words[order].view(np.uint64), often[order]
    if not len(words):
        words, often = np.array([END], np.uint64), np.zeros(1, np.int64)
    norm = total + settings.unigram * (distinct + 1)
    root = np.log10(np.r_[norm, often + settings.unigram] / norm)
    model = Model(words, root, [], total, distinct, settings.unigram)
    least = max(settings.least_share * total, 1)
    end = int(np.flatnonzero(words == END)[0]) + 1
    keys = np.flatnonzero((often >= least) & (words != END)).astype(np.int64) + 1
    chains = keys[:, None]
    for _ in range(settings.depth):
        if not len(keys):
            break
        found = durable(_followers(docs, words, [*model.levels, bare(keys)], settings), "followers")
        own = F.expr(f"key div {WIDE}")
        sizes = found.groupBy(own.alias("context")).agg(F.sum("c").alias("n"))
        bound = found.withColumn("context", own).join(F.broadcast(sizes), "context").where(F.expr(f"key % {WIDE} > 0") & (F.col("c") >= settings.least_symbol * F.col("n")) & (F.col("c") >= settings.least_symbol * least)).select("key", "c", "context", "n")
        rows = bound.toArrow().sort_by("key")
        pairs = rows["key"].to_numpy(), rows["c"].to_numpy().astype(float)
        number = np.ones(len(keys))
        number[rows["context"].to_numpy()] = rows["n"].to_numpy()
        model.levels.append(_states(keys, model.levels, chains, pairs, number, root, settings))
        longer = pairs[0][(pairs[1] >= least) & (pairs[0] % WIDE != end)]
        chains = np.concatenate([chains[longer // WIDE], (longer % WIDE)[:, None]], axis=1)
        keys = longer
    # A state needs all its suffixes: those of kept contexts are kept as well.
    for depth in range(len(model.levels) - 1, 0, -1):
        level = model.levels[depth]
        chain = _chains(model.levels, depth)[level.kept]
        if len(chain):
            padded = np.concatenate([chain[:, 1:], np.full((len(chain), 1), -1)], axis=1).reshape(-1)
            suffix = contexts(padded, model.levels[:depth])[-1].reshape(len(chain), -1)[:, depth - 1]
            model.levels[depth - 1].kept[suffix[suffix >= 0]] = True
    return model


def _chains(levels: list[Level], depth: int) -> np.ndarray:
    out = levels[0].keys[:, None]
    for level in levels[1 : depth + 1]:
        out = np.concatenate([out[level.keys // WIDE], (level.keys % WIDE)[:, None]], axis=1)
    return out


def subtree_places(ids: np.ndarray, ending: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places whose context leaves the top, their keys, and what names the subtree of each.

    The shortest suffix outside the top is one word (the key adds the word before it, or 0), or a context of
    the top with one more word.
    """
    def back(values: np.ndarray, by: int) -> np.ndarray:
        return np.r_[np.full(min(by, len(values)), -1, np.int64), values[: max(0, len(values) - by)]]

    older = [back(ids, by) for by in range(1, len(ending) + 3)]
    # An end mark stands before a separator only, and what lies behind a separator isn't a context.
    reach, open_ = [], np.ones(len(ids), bool)
    for word in older:
        open_ = open_ & (word >= 0)
        reach.append(np.where(open_, word, 0))
    x, y = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    outside = reach[0] > 0
    if ending:
        outside = outside & (back(ending[0], 1) < 0)
    x[outside], y[outside] = reach[1][outside], reach[0][outside]
    base = 0
    for k, level in enumerate(ending):
        state = back(level, 1)
        here = (state >= 0) & (reach[k + 1] > 0)
        if k + 1 < len(ending):
            here &= back(ending[k + 1], 1) < 0
        x[here], y[here] = reach[k + 1][here], TOP + base + state[here]
        base += 1 << 16
    at = np.flatnonzero((y > 0) & (ids >= 0))
    x, y = x[at], y[at]
    with np.errstate(over="ignore"):
        name = spread(y.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.where(y >= TOP, x, 0).astype(np.uint64))
    return at, (x << (BITS + 21)) | (y << BITS) | ids[at], name


def _sent(docs: DataFrame, model: Model, settings: SuffixTree, parts: int) -> DataFrame:
    """dest, portion, part, value: packed places for the group ``part``; or a portion's documents (part -1)."""
    import pyarrow as pa

    shared, most = docs.sparkSession.sparkContext.broadcast(model.plain()), settings.portion_bytes
    schema = pa.schema([("dest", pa.int32()), ("portion", pa.int64()), ("part", pa.int32()), ("value", pa.binary())])

    def grouped(keys: np.ndarray, names: np.ndarray, refs: np.ndarray) -> list[list[np.ndarray]]:
        """For each part: distinct keys ascending (as steps), numbers of their places, and references."""
        order = np.argsort(keys, kind="stable")
        part = (names[order] % np.uint64(parts)).astype(np.int64)
        order = order[np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")]
        cuts = np.searchsorted((names[order] % np.uint64(parts)).astype(np.int64), np.arange(parts + 1))
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            mine = keys[order[a:b]]
            first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]]) if b > a else np.zeros(0, np.int64)
            out.append([np.diff(mine[first], prepend=mine.dtype.type(0)).view(np.uint64), np.diff(np.r_[first, b - a]).astype(np.uint32), refs[order[a:b]]])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, task = restored(shared.value), TaskContext.get().partitionId()
        symbols = Symbols(model.words)
        for number, rows in enumerate(portions(batches, most)):
            ids, hashes, counts = symbols([r[-1] for r in rows])
            ending = contexts(ids, model.levels)
            starts = np.cumsum(counts + 2) - counts - 2
            unigram, chain = np.where(ids >= 0, model.root[ids], 0.0), log_probabilities(ids, model.root, model.levels, ending)
            base, top, known = (np.add.reduceat(v, starts) for v in (unigram, chain, (ids > 0).astype(float)))
            doc_id, null, held = (np.array(v, np.int64) for v in zip(*((d or 0, d is None, h) for d, h, _ in rows), strict=True))
            portion = (task << 32) | number
            value = pack(doc_id.view(np.uint64), null.astype(np.uint8), held.astype(np.uint8), (counts + 1).astype(np.uint32), known.astype(np.uint32), base.view(np.uint64), top.view(np.uint64))
            out = [((task + number) % parts, portion, -1, value)]
            refs = np.repeat(2 * np.arange(len(rows)) + held, counts + 2).astype(np.uint32)
            at, keys, names = subtree_places(ids, ending)
            rare = np.flatnonzero(ids == 0)
            for part, both in enumerate(zip(grouped(keys, names, refs[at]), grouped(hashes[rare], spread(hashes[rare]), refs[rare]), strict=True)):
                if len(both[0][0]) or len(both[1][0]):
                    out.append((part, portion, part, pack(*both[0], *both[1])))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), settings.folds) == 0).alias("held"), F.col("text").cast("binary").alias("text"))
    return columns.mapInArrow(run, "dest int, portion long, part int, value binary")


def _divergence(node: np.ndarray, n: int, size: np.ndarray, p: np.ndarray, below: np.ndarray, smoothing: float) -> np.ndarray:
    """Divergence of each node's smoothed distribution from its suffix's: the symbols seen, and all others at once."""
    seen = np.bincount(node, p * np.log(p / below), n)
    share = smoothing / (size + smoothing)
    return seen + np.maximum(1 - np.bincount(node, below, n), 0) * share * np.log(share)


def subtree_scores(keys: np.ndarray, counts: np.ndarray, model: Model, settings: SuffixTree) -> tuple[np.ndarray, np.ndarray]:
    """log10 probabilities by the longest state, and by the top alone, for each key. keys are distinct, with all of their subtrees."""
    x, y, w = keys >> (BITS + 21), (keys >> BITS) & (2 * TOP - 1), keys & (TOP - 1)
    root, m = model.root_with_rest(), settings.smoothing
    pairs, pair = np.unique(keys & ((1 << (BITS + 21)) - 1), return_inverse=True)
    py, pw = pairs >> BITS, pairs & (TOP - 1)
    top = root[pw]
    deep = np.flatnonzero(py >= TOP)
    if len(deep):
        width = len(model.levels)
        chains = {k: _chains(model.levels, k) for k in range(width)}
        before = np.full((len(deep), width), -1, np.int64)
        for k in range(width):
            own = (py[deep] - TOP) >> 16 == k
            before[own, width - k - 1 :] = chains[k][(py[deep][own] - TOP) & 0xFFFF]
        ids = np.concatenate([np.full((len(deep), 1), -1), before, pw[deep, None]], axis=1)
        top[deep] = log_probabilities(ids.reshape(-1), root, model.levels).reshape(ids.shape)[:, -1]
    given = 10.0**top
    # One word: its followers after any older word.
    words, word = np.unique(py, return_inverse=True)
    pair_count = np.bincount(pair, counts, len(pairs))
    size = np.bincount(word, pair_count, len(words))
    state = (words < TOP) & (size >= settings.least_count)
    p = (pair_count + m * given) / (size[word] + m)
    seen = pair_count > 0
    one_far = state & (_divergence(word[seen], len(words), size, p[seen], given[seen], m) >= settings.divergence)
    below = np.where(state[word], p, given)
    # One more word.
    nodes, node = np.unique(keys >> BITS, return_inverse=True)
    node_size = np.bincount(node, counts, len(nodes))
    node_word = np.zeros(len(nodes), np.int64)
    node_word[node] = word[pair]
    more = (nodes >> 21 > 0) & (node_size >= settings.least_count)
    q = (counts + m * below[pair]) / (node_size[node] + m)
    seen = counts > 0
    two_far = more & (_divergence(node[seen], len(nodes), node_size, q[seen], below[pair][seen], m) >= settings.divergence)
    one_far |= state & (np.bincount(node_word, two_far, len(words)) > 0)
    final = np.where(two_far[node], q, np.where(one_far[word][pair], p[pair], given[pair]))
    return np.log10(final), top[pair]


def _met(sent: DataFrame, model: Model, settings: SuffixTree) -> DataFrame:
    """portion, part, value: what a group adds to each document of a portion, packed; or the portion's documents (part -1) as they came."""
    import pyarrow as pa

    shared = sent.sparkSession.sparkContext.broadcast(model.plain())
    schema = pa.schema([("portion", pa.int64()), ("part", pa.int32()), ("value", pa.binary())])

    def all_of(packed: list[list[np.ndarray]], first: int) -> tuple[np.ndarray, ...]:
        """Distinct keys, and for each place the number of its key, its packet and its reference."""
        keys = np.concatenate([np.cumsum(p[first]) for p in packed])
        n = np.concatenate([p[first + 1] for p in packed]).astype(np.int64)
        distinct, inverse = numbered(keys)
        packet = np.repeat(np.arange(len(packed)), [len(p[first + 2]) for p in packed])
        return distinct, np.repeat(inverse, n), packet, np.concatenate([p[first + 2] for p in packed]).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, groups = restored(shared.value), {}
        for batch in batches:
            for _, portion, part, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((portion, part, value), schema, strict=True)], schema=schema)
                else:
                    groups.setdefault(part, []).append((portion, value))
        for part, values in groups.items():
            values.sort()
            packed = [unpack(v) for _, v in values]
            keys, key, packet, ref = all_of(packed, 0)
            gains = np.subtract(*subtree_scores(keys.view(np.int64), np.bincount(key, ref % 2 == 0, len(keys)), model, settings)) if len(keys) else np.zeros(0)
            words, word, rare_packet, rare_ref = all_of(packed, 3)
            c = np.bincount(word, rare_ref % 2 == 0, len(words))
            unigram = np.log10((c + model.unigram) / model.norm)
            code = np.r_[(packet << 32) + ref, (rare_packet << 32) + rare_ref]
            own, inverse = numbered(code)
            gain = np.bincount(inverse, np.r_[gains[key], np.zeros(len(word))], len(own))
            base = np.bincount(inverse, np.r_[np.zeros(len(key)), unigram[word]], len(own))
            known = np.bincount(inverse, np.r_[np.zeros(len(key)), c[word] > 0], len(own)).astype(np.uint32)
            cuts = np.searchsorted(own >> 32, np.arange(len(values) + 1))
            out = [(portion, part, pack(((own[a:b] & 0xFFFFFFFF) >> 1).astype(np.uint32), gain[a:b].view(np.uint64), base[a:b].view(np.uint64), known[a:b])) for (portion, _), a, b in zip(values, cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return sent.mapInArrow(run, "portion long, part int, value binary")


def _summed(met: DataFrame, total: int) -> DataFrame:
    """Scores of the documents of each portion."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grouped: dict[int, list] = {}
        for batch in batches:
            for portion, part, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                grouped.setdefault(portion, []).append((part, value))
        for parts in grouped.values():
            parts.sort()  # the documents stand first, and sums are equal in every run
            doc_id, null, held, tokens, known, base, top = unpack(parts[0][1])
            base, top, known = base.view(np.float64).copy(), top.view(np.float64).copy(), known.astype(np.int64)
            for _, value in parts[1:]:
                at, gain, more, seen = unpack(value)
                base[at] += more.view(np.float64)
                top[at] += more.view(np.float64) + gain.view(np.float64)
                known[at] += seen
            yield pa.RecordBatch.from_arrays([pa.array(doc_id.view(np.int64), mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(tokens.astype(np.int64)), pa.array(known), pa.array(np.full(len(base), total)), pa.array(base), pa.array(top)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return met.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, model: Model, settings: SuffixTree) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-model.total // settings.part_tokens))
    dealt = _sent(docs, model, settings, parts).repartitionById(parts, F.col("dest"))
    return _summed(_met(dealt, model, settings).repartition("portion"), model.total)


def score_digest(docs: DataFrame, settings: SuffixTree | None = None) -> DataFrame:
    """Scores of every row, learnt from the documents outside fold 0.

    Null and empty texts are the end mark alone; null ids belong to no fold and are learnt from; repeated
    rows count as often as they stand; an empty table gives no row. Without training documents every word
    is unknown. doc_id must be whole numbers; other columns aren't read.
    """
    settings = settings or SuffixTree()
    plain = documents_only(docs, "doc_id", "text")
    counts = durable(word_counts(plain, settings), "word-counts")
    return score(plain, fit(plain, counts, settings), settings)
