"""Each operator against a brute-force version, on small rows with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skein.llm import avi, decontaminate, license_scan, mixing, near_copies, quality, simhash, substring_dedup, suffix_tree_lm, token_files, url_filter

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, spans string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def make_rows():
    rng = random.Random(5)
    vocabulary = ["the", "of", "Éa", "tion", "ing", "a1", "x", "Zo", "que", "und", "there", "by", "all"]
    prose = lambda n: " ".join(rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(n))
    shared, long = prose(60), prose(6000)
    texts = [None, "", " \n\t", "CC BY", "x cc-by, Licensed under CC BY-NC 4.0. All rights reserved!", "GNU General Public License, version 3. cc by cc by"]
    texts += [prose(30) + " " + shared + "\n" + prose(10) for _ in range(6)] + [long, long + " more", shared, shared]
    texts += [prose(rng.randrange(1, 80)) for _ in range(20)]
    near = prose(300).split(" ")
    texts += [" ".join(near), " ".join([*near[:100], "changed", *near[101:]]), "K" + " KELVIN K"]
    rows = [(k, t, "en", f"s{k % 3}" if k % 7 else None, k, "n", "s") for k, t in enumerate(texts)]
    return [*rows, (None, "a text without an id", None, None, None, None, None), rows[9], rows[9]]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def key(row):
    return tuple((x is None, str(x)) for x in row)


def same(found, expected):
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)


def test_license_places(docs, rows):
    expected = []
    for doc_id, text, *_ in rows:
        w, starts, labels = words(text), [], set()
        for label, phrase in license_scan.BASE_PHRASES.items():
            p = phrase.split()
            found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            starts += found
            labels |= {label} if found else set()
        expected.append((doc_id, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))))
    found = license_scan.license_digest(docs).collect()
    same([r[:6] for r in found], expected)
    by_id = {r.doc_id: r for r in found}
    assert by_id[4].labels == "cc-by,cc-by-nc,reserved" and by_id[5].labels == "cc-by,gpl" and by_id[0].labels == "" and by_id[0].score == 0
    assert all(0 <= r.score <= 1 for r in found)


def test_all_notices_of_a_file(spark):
    from itertools import combinations

    templates = license_scan.TEMPLATES
    chosen = [*combinations(templates, 1), *combinations(templates, 2), tuple(templates)]
    rows = [(k, " and then some ".join(templates[t][0] for t in c)) for k, c in enumerate(chosen)]
    found = license_scan.license_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in found:
        assert set(chosen[r.doc_id]) <= set(r.labels.split(",")) and r.score == pytest.approx(1)


def windows(text, n=8):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("broadcast", [250_000, 0])
def test_contamination(spark, docs, rows, broadcast):
    passage = rows[6][1].split(" ")
    items = [(10, " ".join(passage[3:15])), (9, " ".join(passage[20:40])), (8, "CC, by"), (7, ""), (6, None), (None, "the of"), (5, "no such words here at all in any of them")]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    lookup = {}
    for item, text in items:
        for w in windows(text) if item is not None else ():
            lookup.setdefault(w, set()).add(str(item))
    expected = []
    for doc_id, text, *_ in rows:
        w, hit, ids = words(text), set(), set()
        for size in {len(x) for x in lookup}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in lookup:
                    hit |= set(range(i, i + size))
                    ids |= lookup[tuple(w[i : i + size])]
        expected.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(ids) >= 2))
    settings = decontaminate.Decontamination(broadcast_windows=broadcast)
    same(decontaminate.contamination_digest(docs, table, settings).collect(), expected)
    hit_ids = {e[0] for e in expected if e[2]}
    assert hit_ids
    kept = decontaminate.decontaminate(docs, table).collect()
    assert len(kept) == sum(e[2] == 0 for e in expected) and kept[0].asDict().keys() == set(docs.columns)
    spans = decontaminate.decontaminate(docs, table, "spans")
    assert spans.count() == len(rows) and all(len(words(r.text)) == e for r in spans.collect() for e in [{x[0]: x[1] - x[2] for x in expected}[r.doc_id]])


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    found = [license_scan.license_digest(none), decontaminate.contamination_digest(none, items), quality.quality_digest(none, labels), suffix_tree_lm.score_digest(none), avi.media_digest(none), simhash.near_duplicate_digest(none), mixing.mixing_digest(none), substring_dedup.dedup_digest(none)]
    found.append(url_filter.judge(spark.createDataFrame([], "page_id long, url string")))
    public = pytest.importorskip("public_tokenizers")
    found.append(token_files.token_digest(none, token_files.TokenFiles(public.path("byte_bpe_50k.json"))))
    assert [f.count() for f in found] == [0] * 10


@pytest.mark.parametrize("seed", range(3))
def test_notices_by_brute_force(spark, seed):
    """Labels and scores over random mixtures of cut and changed notices."""
    rng, templates = random.Random(seed), license_scan.TEMPLATES
    rows = []
    for k in range(60):
        out = []
        for _ in range(rng.randrange(0, 9)):
            w = rng.choice(list(templates.values()))[0].split()
            w = w[rng.randrange(0, 3) :] if rng.random() < 0.4 else w
            out += [rng.choice(["the", "free", "zz"]) if rng.random() < 0.15 else x for x in w] + ["and", "so"] * rng.randrange(0, 2)
        rows.append((k, " ".join(out) or None))
    n, idf = len(rows), {}
    for word in license_scan.LicenseIndex().vocabulary():
        idf[word] = round(np.log((n + 1) / (sum(word in words(t) for _, t in rows) + 1)) + 0.01, 9)
    found = {r.doc_id: r for r in license_scan.license_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc_id, text in rows:
        w, best, labels = words(text), 0.0, set()
        for label, phrase in license_scan.BASE_PHRASES.items():
            p = phrase.split()
            if any(w[i : i + len(p)] == p for i in range(len(w))):
                labels.add(label)
                best = 1.0
        for label, (template, phrase) in templates.items():
            t, m = template.split(), phrase.split()
            shift = next(i for i in range(len(t)) if t[i : i + len(m)] == m)
            for i in range(len(w)):
                if w[i : i + len(m)] == m:
                    own = sum(idf[x] for j, x in enumerate(t) if 0 <= i - shift + j < len(w) and w[i - shift + j] == x) / sum(idf[x] for x in t)
                    if own >= 0.6:
                        labels.add(label)
                        best = max(best, min(1.0, own))
        assert found[doc_id].labels == ",".join(sorted(labels)) and found[doc_id].score == pytest.approx(best, abs=1e-5)


def test_follow_the_regularised_leader():
    """Training against the published update rules, one coordinate after another, in plain Python."""
    from math import exp, sqrt

    rng, settings = np.random.default_rng(1), quality.QualityModel(bits=5, epochs=2)
    rows = [(rng.integers(0, 32, rng.integers(0, 12)), int(rng.integers(0, 2))) for _ in range(80)]
    z, n = [0.0] * 33, [0.0] * 33

    def weight(i):
        if abs(z[i]) <= settings.l1:
            return 0.0
        return -(z[i] - (settings.l1 if z[i] > 0 else -settings.l1)) / ((settings.beta + sqrt(n[i])) / settings.alpha + settings.l2)

    for _ in range(settings.epochs):
        for features, label in rows:
            x = {32: 1.0}
            for f in features.tolist():
                x[f] = x.get(f, 0.0) + settings.scale / len(features)
            w = {i: weight(i) for i in x}
            p = 1 / (1 + exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                z[i] += g - (sqrt(n[i] + g * g) - sqrt(n[i])) / settings.alpha * w[i]
                n[i] += g * g
    assert quality.train(rows, settings) == pytest.approx([weight(i) for i in range(33)], abs=1e-5)


def test_quality_on_held_out_rows(spark):
    """Area under the curve over labelled documents that were held out."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = quality.quality_digest(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()
    scores = [(r.score, labels[r.doc_id]) for r in found if r.held_out and r.doc_id in labels]
    good, bad = [s for s, q in scores if q], [s for s, q in scores if not q]
    assert good and bad and np.mean([[a > b for b in bad] for a in good]) >= 0.9


def test_workers_without_the_package(tmp_path):
    """All ten operators from another folder, with the package on the driver's path alone."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parents[2]
    script = tmp_path / "run.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {str(repo)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
from skein.llm import queries
for name, query in queries.queries().items():
    rows = query(spark, "/root/testdata/sf0.001").count()
    assert rows == (50 if name.startswith("op7") else 200), (name, rows)
print("all ten ran")
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600, check=False)
    assert "all ten ran" in done.stdout, done.stderr[-3000:]


def test_quality(spark):
    rng = random.Random(3)
    good = [" ".join(rng.choice(["the", "of", "thing", "nation", "other"]) for _ in range(40)) + "." for _ in range(150)]
    bad = [" | ".join(rng.choice(["buy", "thing", "nation"]) for _ in range(30)) for _ in range(50)]
    rows = [(k, t, int(k < 150)) for k, t in enumerate(good + bad)]
    docs = spark.createDataFrame([*rows, (900, None, 1), (901, "", 1), (None, "the of thing", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, q, 0) for k, _, q in rows] + [(None, 1, 0), (5000, 0, 0)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality.quality_digest(docs, labels).collect()}
    assert len(found) == 203
    for k, _, q in rows:
        assert found[k].predicted == q and found[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0)
    assert found[900].score == found[901].score and not found[None].held_out
    assert quality.accepted(docs, labels).columns == docs.columns


def test_suffix_tree(docs, rows):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    counts = Counter(w for r in rows if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    found = suffix_tree_lm.score_digest(docs).collect()
    expected = {r[0]: (held(r[0]), len(tokens(r[1])), sum(counts[w] > 0 for w in tokens(r[1])), n) for r in rows}
    base = {r[0]: sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(r[1])) for r in rows}
    assert len(found) == len(rows)
    for r in found:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == expected[r.doc_id]
        assert r.base_score == pytest.approx(base[r.doc_id], abs=1e-7) and r.score <= 0


def brute_tree(texts, settings):
    """Scorer of a tree without a top: contexts of one and two words, by plain counting."""
    lines = [(t or "").encode().lower().split() for t in texts]
    unigrams = Counter(w for x in lines for w in [*x, b""])
    n, v = sum(unigrams.values()), len(unigrams)
    known = {w for w, c in unigrams.items() if c >= settings.least_count} | {b""}
    root = lambda w: (unigrams[w] + 0.1) / (n + 0.1 * (v + 1))
    other = 1 - sum(map(root, known))
    seen = Counter()
    for x in lines:
        s = [w if w in known else None for w in x]
        for i, w in enumerate([*s, b""]):
            for k in (1, 2):
                if k <= i and None not in s[i - k : i]:
                    seen[tuple(s[i - k : i]), w] += 1
    size = Counter()
    for (context, _), c in seen.items():
        size[context] += c
    flat = {w: root(w) for w in known} | {None: other}
    states = {}
    for context in sorted(size, key=len):
        if size[context] >= settings.least_count:
            below = states.get(context[1:], (flat, True))[0]
            own = {w: (seen[context, w] + settings.smoothing * below[w]) / (size[context] + settings.smoothing) for w in flat}
            states[context] = [own, sum(p * np.log(p / below[w]) for w, p in own.items()) >= settings.divergence]
    for context, (_, kept) in states.items():
        if len(context) == 2 and kept:
            states[context[1:]][1] = True

    def score(text):
        x, total = (text or "").encode().lower().split(), 0
        s = [w if w in known else None for w in x]
        for i, w in enumerate([*s, b""]):
            given = flat
            for k in (1, 2):
                if k <= i and states.get(tuple(s[i - k : i]), (0, False))[1]:
                    given = states[tuple(s[i - k : i])][0]
            total += np.log10(given[w]) + (np.log10(root(x[i]) / other) if w is None else 0)
        return total

    return score, states


def chained_texts(n):
    rng, texts = random.Random(1), []
    for _ in range(n):
        out = ["a"]
        for _ in range(60):
            out.append(rng.choice({"a": "bbbc", "b": "aacd", "c": "dddd", "d": "abcd"}[out[-1][0]]) + rng.choice(["", "", "", "1", "2", f"x{rng.randrange(99)}"]))
        texts.append(" ".join(out))
    return texts


def test_suffix_tree_by_counting(spark, docs, rows):
    settings = suffix_tree_lm.SuffixTree(least_share=2, least_count=3, part_tokens=900, portion_bytes=3000)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    chained = [(k, t) for k, t in enumerate(chained_texts(60))]
    for table, pairs in ((docs, [(r[0], r[1]) for r in rows]), (spark.createDataFrame(chained, "doc_id long, text string"), chained)):
        score, states = brute_tree([t for d, t in pairs if not held(d)], settings)
        assert any(len(c) == 2 and kept for c, (_, kept) in states.items())
        expected = sorted(((d is None, d), score(t)) for d, t in pairs)
        found = sorted(((r.doc_id is None, r.doc_id), r.score) for r in suffix_tree_lm.score_digest(table, settings).collect())
        assert [k for k, _ in found] == [k for k, _ in expected]
        assert [x for _, x in found] == pytest.approx([x for _, x in expected], abs=1e-6)


def test_suffix_tree_distributions(spark):
    texts = chained_texts(80)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    settings = suffix_tree_lm.SuffixTree(least_share=0.004, least_symbol=0.02, least_count=3, portion_bytes=4000)
    model = suffix_tree_lm.fit(docs, suffix_tree_lm.word_counts(docs, settings).cache(), settings)
    assert len(model.levels) == 3 and model.levels[0].kept.any()
    every, root = np.arange(len(model.words) + 1), model.root_with_rest()
    for before in ([1], [2], [3], [2, 1], [1, 2, 3], [0, 5]):
        p = [10 ** suffix_tree_lm.log_probabilities(np.array([*before, s]), root, model.levels)[-1] for s in every]
        assert sum(p) == pytest.approx(1, abs=1e-6)
    ids = suffix_tree_lm.Symbols(model.words)([t.encode() for t in texts])[0]
    at, keys, _ = suffix_tree_lm.subtree_places(ids, suffix_tree_lm.contexts(ids, model.levels))
    assert len(np.unique((keys >> 20) & (2**21 - 1) >= 2**20)) == 2  # subtrees below the root and below states of the top
    nodes = np.unique(keys >> 20)
    full, inverse = np.unique(np.r_[keys, (nodes[:, None] << 20 | every).reshape(-1)], return_inverse=True)
    counts = np.bincount(inverse[: len(keys)], minlength=len(full))
    own, top = suffix_tree_lm.subtree_scores(full, counts, model, settings)
    for values in (own, top):
        sums = np.bincount(np.searchsorted(nodes, full >> 20), 10.0**values)
        assert sums == pytest.approx(np.ones(len(nodes)), abs=1e-6)
    assert (own != top).any()
    scored = suffix_tree_lm.score_digest(docs, settings).collect()
    held = [r for r in scored if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_suffix_tree_grows(spark):
    sizes = []
    for n in (40, 400):
        docs = spark.createDataFrame(list(enumerate(chained_texts(n))), "doc_id long, text string")
        settings = suffix_tree_lm.SuffixTree(least_count=5)
        model = suffix_tree_lm.fit(docs, suffix_tree_lm.word_counts(docs, settings).cache(), settings)
        ids = suffix_tree_lm.Symbols(model.words)([r.text.encode() for r in docs.collect()])[0]
        _, keys, _ = suffix_tree_lm.subtree_places(ids, suffix_tree_lm.contexts(ids, model.levels))
        sizes.append(len(model.words) + int((np.unique(keys >> 20, return_counts=True)[1] >= 5).sum()))
    assert sizes[1] > 2 * sizes[0]


@pytest.mark.parametrize("payload", [b"", b"hello", bytes(range(256)) * 9, random.Random(1).randbytes(5000), b"\xff" * 700])
def test_avi_round_trip(payload):
    settings = avi.Avi()
    body = avi.payload_of(payload)
    data = avi.write_avi(body, settings)
    samples, fps, shots = avi.read_avi(data, settings)
    assert samples.tobytes() == body and fps == 25 and shots[0][0] == 0
    frame = avi.parse_avi(data)["frames"][0]
    assert (avi.decode_frame(frame) == np.kron(avi.decode_samples(frame), np.ones((8, 8), np.uint8))).all()
    without = data[: data.index(b"idx1")]
    assert avi.parse_avi(without)["frames"] == avi.parse_avi(data)["frames"]


def test_avi_shots():
    still = np.concatenate([np.full((6, 64), 20, np.uint8), np.full((5, 64), 200, np.uint8), np.full((4, 64), 90, np.uint8)])
    assert avi.shots(still, avi.Avi()) == [(0, 6), (6, 11), (11, 15)]


def test_media(docs, rows):
    found = {r.doc_id: r for r in avi.media_digest(docs).collect()}
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        body = avi.payload_of(raw)
        r = found[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))
    clips = avi.clips(avi.media_column(docs, key="doc_id")).collect()
    assert {c.doc_id for c in clips} == set(found) and all(c.start_s < c.end_s for c in clips)


def brute_components(prints, radius):
    ids = list(range(len(prints)))
    parent = dict(zip(ids, ids, strict=True))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids[:i]:
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in ids]


def test_simhash(docs, rows):
    import xxhash

    def fingerprint(text):
        w = (text or "").encode().lower().split()
        grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    distinct = {r[0]: fingerprint(r[1]) for r in rows}
    ids = sorted(d for d in distinct if d is not None) + [None]
    component = dict(zip(ids, (ids[k] for k in brute_components([distinct[d] for d in ids], 4)), strict=True))
    expected = [(r[0], f"{distinct[r[0]]:016x}", component[r[0]]) for r in rows]
    same(simhash.near_duplicate_digest(docs).collect(), expected)


@pytest.mark.parametrize("radius", [0, 4, 7])
def test_bit_sliced_stars(radius):
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = np.array([c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False))) for c in centres for _ in range(9)], np.uint64)
    bucket = np.repeat([0, 1, 1], 36)
    a, b = simhash.bucket_stars(prints[:, None], bucket, radius)
    found = np.arange(len(prints))
    found[a] = b
    for k in (0, 1):
        at = np.flatnonzero(bucket == k)
        want = brute_components([int(x) for x in prints[at]], radius)
        groups = lambda labels: {frozenset(np.flatnonzero(np.array(labels) == x)) for x in labels}
        assert groups(want) == groups(found[at].tolist())


def test_one_of_each_group(docs, rows):
    kept = simhash.one_of_each_group(docs).collect()
    ids = [r.doc_id for r in kept]
    texts = [r[1] for r in rows]
    near = texts.index(next(t for t in texts if t and "changed" in t))
    assert near not in ids and near - 1 in ids and set(ids) <= {r[0] for r in rows} and len(ids) == len(set(ids))
    blank = [r[0] for r in rows if not (r[1] or "").split()]
    assert [d for d in ids if d in blank] == [0]  # null, empty and blank texts are one group
    assert kept[0].asDict().keys() == set(docs.columns)


def test_groups_with_shared_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(5, a, 0), (5, b, 1), (5, a, 0), (3, b, 2), (None, a + " more", 3), (None, c, 4), (None, c, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id int")
    kept = sorted((r.doc_id or 0, r.text) for r in near_copies.one_of_each_group(docs).collect())
    assert kept == [(0, c), (3, b), (5, a)]


def test_clashing_names(spark, rows):
    """Extra columns with the names that the stages use themselves; empty tables; repeated rows."""
    names = "quality_score string, hit_id string, hit_digest int, hit_spans string, gone_id int, row string, own int, node int, position int, slot int, n_words int, w string, k int, h int"
    table = [(r[0], r[1], "en", "s", *("x" if kind == "string" else 1 for kind in (f.split()[1] for f in names.split(", ")))) for r in rows]
    docs = spark.createDataFrame(table, f"doc_id long, text string, lang string, source string, {names}")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, rows[6][1][:200], "x")], "item_id long, text string, doc_id string")
    stages = [lambda d: quality.accepted(d, labels), simhash.one_of_each_group, lambda d: decontaminate.decontaminate(d, items), lambda d: decontaminate.decontaminate(d, items, "spans"), mixing.mixed]
    for stage in stages:
        found = stage(docs)
        assert found.columns == docs.columns and 0 < found.count() <= len(rows)
        assert {r["lang"] for r in found.collect()} == {"en"}
        none = stage(docs.limit(0))
        assert none.columns == docs.columns and none.count() == 0


def test_similarity_decides(spark):
    rng = random.Random(8)
    rows, expected = [], set()
    for k in range(40):
        text = [f"w{rng.randrange(10**9)}" for _ in range(104)]
        # The first m words of n hold m - 4 of n - 4 shingles: 0.80 and 0.79 of the whole.
        rows += [(3 * k, " ".join(text)), (3 * k + 1, " ".join(text[:84])), (3 * k + 2, " ".join([*text[21:], "end"][:83]))]
        expected |= {3 * k, 3 * k + 2}
    chain = [f"c{k}" for k in range(150)]
    rows += [(200 + k, " ".join(chain[8 * k : 8 * k + 104])) for k in range(5)]  # neighbours at 92 / 108
    kept = {r.doc_id for r in simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == expected | {200}


@pytest.mark.parametrize("task_texts", [4, 25, 1000])
def test_large_groups(spark, task_texts):
    """Chains, near copies of one text, and texts that share bands without being similar enough, in chunks of few texts."""
    rng, rows = random.Random(9), []
    base = [f"b{rng.randrange(10**9)}" for _ in range(200)]
    for _ in range(60):
        text = list(base)
        for at in rng.sample(range(200), rng.choice([1, 2, 6, 9, 12])):
            text[at] = f"n{rng.randrange(10**9)}"
        rows.append(" ".join(text))
    chain = [f"c{k}" for k in range(400)]
    rows += [" ".join(chain[9 * k : 9 * k + 104]) for k in range(30)]
    rows += [f"single {k} " * 9 for k in range(10)]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (r.split() for r in rows)]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(docs, near_copies.NearCopies(task_texts=task_texts, pivots=3)).collect()}
    assert [found[k] for k in range(len(rows))] == label
    assert 3 < len(set(label)) < 90


def test_texts_apart_meet_no_chunks(spark, monkeypatch):
    """Texts with a common passage are near but not similar: of those, few may meet every chunk, and no pair is lost."""
    rng, met, links = random.Random(13), [], near_copies._links
    word = lambda: f"w{rng.randrange(10**9)}"
    base = [word() for _ in range(160)]
    texts = [base + [word() for _ in range(36)] for _ in range(120)]
    rows = [" ".join(t) for t in [*texts, *([*t[:-6], *(word() for _ in range(6))] for t in texts[:5])]]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    monkeypatch.setattr(near_copies, "_links", lambda texts, pivots, settings: met.append((texts.count(), pivots.distinct().count())) or links(texts, pivots, settings))
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(docs, near_copies.NearCopies(task_texts=25, pivots=3)).collect()}
    assert found == {k: k if k < 120 else k - 120 for k in range(125)}
    assert met[0][0] == 125 and sum(n * p for n, p in met[1:]) <= 12 * 125


@pytest.mark.parametrize("counted", [0, 40, 400])
def test_rarest_shingles(counted):
    """Of sets of similarity 0.8 or more, the larger has a leading one of the smaller, whatever is counted."""
    rng, tried = np.random.default_rng(6), 0
    names = np.unique(rng.integers(0, 2**64, 400, dtype=np.uint64))
    counts = names[:counted], rng.integers(1, 9, len(names[:counted]))
    for _ in range(2000):
        a = np.sort(rng.permutation(names)[: rng.integers(1, 60)])
        b = np.unique(np.r_[rng.permutation(a)[: rng.integers(len(a) * 8 // 10, len(a) + 1)], rng.permutation(names)[: rng.integers(0, 6)]])
        common = len(np.intersect1d(a, b))
        if len(b) and 5 * common >= 4 * (len(a) + len(b) - common):
            (x, leading), (y, _) = (near_copies.rarest(s, counts, 80) for s in sorted((a, b), key=len))
            assert len(np.intersect1d(x[leading], y)) and len(y) <= max(len(a), len(b)) // 5 + 1
            tried += 1
    assert tried > 300


def test_verified_groups():
    rng = np.random.default_rng(4)
    for _ in range(60):
        base = np.unique(rng.integers(0, 2**63, 40, dtype=np.uint64))
        sets = [np.sort(rng.permutation(base)[: rng.integers(28, 41)]) for _ in range(14)]
        want = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                common = len(np.intersect1d(sets[i], sets[j]))
                if 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                    want = [want[j] if x == want[i] else x for x in want]
        label = near_copies.verified(sets, 80)
        assert len(set(zip(want, label.tolist(), strict=True))) == len(set(want)) == len(set(label.tolist()))


def test_candidates_come_by_simhash(spark):
    """The pipeline's candidates against plain SimHash: majority bits, buckets, and what the radius connects in each."""
    import xxhash

    rng, settings = random.Random(10), near_copies.NearCopies()
    word = lambda: f"w{rng.randrange(10**9)}"
    texts = ["", "one two"]
    for n in (9, 9, 9, 60, 104, 400):
        base = [word() for _ in range(n)]
        texts += [" ".join(base), " ".join(base[: n - (n - 4) // 5]), " ".join([*base[: n // 2], word(), *base[n // 2 :]])]
    tables = near_copies.Tables.of(len(texts), settings)
    sets, prints = {t: near_copies.shingles(t.encode(), settings) for t in texts}, {}

    def mixed(h, lane):
        z = (h + lane * 0x9E3779B97F4A7C15) % 2**64
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
        return z ^ z >> 31

    for text in texts:
        w = text.encode().split()
        hashes = {xxhash.xxh64_intdigest(b" ".join(w[i : i + 5]), 42) for i in range(max(1, len(w) - 4))}
        bits = 256 + 12 * (tables.common + (tables.short if len(hashes) <= 5 else 0))
        lanes = [[mixed(h, k + 1) for h in hashes] for k in range(-(-bits // 64))]
        prints[text] = sum(1 << (64 * k + b) for k, lane in enumerate(lanes) for b in range(64) if 2 * sum(h >> b & 1 for h in lane) > len(hashes))
        assert int.from_bytes(near_copies.set_print(sets[text], tables, settings), "little") == prints[text]
    expected = []
    for t in range(tables.common + tables.short):
        buckets = {}
        for text in texts:
            if t < tables.common or len(sets[text]) <= 5:
                buckets.setdefault(prints[text] >> (256 + 12 * t) & 0xFFF, []).append(text)
        for held in buckets.values():
            roots = brute_components([prints[x] % 2**256 for x in held], 68 if t < tables.common else 76)
            groups = [sorted(x for x, r in zip(held, roots, strict=True) if r == root) for root in set(roots)]
            expected += [g for g in groups if len(g) > 1]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, *texts[:5]])], "doc_id long, text string")
    names = {r.node: r.text for r in docs.select(near_copies.text_name("text").alias("node"), "text").collect()}
    found = {}
    for r in near_copies._keys(docs, settings, "text").collect():
        found.setdefault(r.key, []).append(names[r.node])
    assert sorted(map(sorted, found.values())) == sorted(expected)
    together = {(a, b) for g in expected for a in g for b in g}
    assert all((a, b) in together for a in texts for b in texts if a != b and 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b])))


def test_simhash_recall_by_calculation():
    """What NearCopies says of bits, radius and tables, from exact binomials."""
    from math import comb

    settings = near_copies.NearCopies()

    def differ(c, a, b):
        over = lambda i, more: sum(comb(more, x) for x in range(more + 1) if 2 * (i + x) > c + more) / 2**more
        return sum(comb(c, i) / 2**c * (over(i, a) * (1 - over(i, b)) + over(i, b) * (1 - over(i, a))) for i in range(c + 1))

    short, rest = [], []
    for c in range(4, 64):
        for own in range(1, c // 4 + 1):
            (short if c + own <= settings.short else rest).extend(differ(c, own - b, b) for b in range(own // 2 + 1))
    assert max(short) <= settings.short_apart and max(rest) <= settings.apart
    for p, radius in ((settings.apart, settings.radius), (settings.short_apart, settings.short_radius)):
        assert sum(comb(256, d) * p**d * (1 - p) ** (256 - d) for d in range(radius + 1, 257)) <= 1e-5
    for texts in (0, 200_000, 10**7, 10**9):
        t = near_copies.Tables.of(texts, settings)
        assert (1 - (1 - settings.apart) ** t.bits) ** t.common <= 1.5e-5 >= (1 - (1 - settings.short_apart) ** t.bits) ** t.short
        assert texts >> t.bits <= settings.bucket_texts


@pytest.mark.parametrize("cells", [1, 50, 4_000_000])
def test_frontier_stars(cells):
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 2**63, (40, 2), dtype=np.uint64)
    for k in range(1, 40):  # chains and a crowd, a few bits apart
        if k % 8:
            prints[k] = prints[k - 1] ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(2)], np.uint64)
    a, b = near_copies.frontier_stars(prints, 8, cells)
    found = np.arange(len(prints))
    found[a] = b
    want = brute_components([int(x) << 64 | int(y) for x, y in prints], 8)
    assert len(set(zip(want, found.tolist(), strict=True))) == len(set(want)) == len(set(found.tolist())) and 1 < len(set(want)) < 40


def test_url_rules(spark):
    urls = [None, "", "no mark", "HTTP://A.NET/x", "http://net/", "http://net", "http://example.net/en/a", "http://b.Example.net/en", "http://x.example.com/de/1?y", "http://example.com/deutsch/", "https://q.org/fr/#z", "http://org/fr/a/b", "http://notnet/", "a://b://c.net/", "http://u@h.net:80/"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert found[0] == found[1] == found[2] == ("", "", None, "allow")
    assert found[3] == ("a.net", "/x", "net/", "block") and found[4][2] == "net/" and found[5] == ("net", "", None, "allow")
    assert found[6][2:] == ("example.net/en/", "allow") and found[7][2:] == ("net/", "block") and found[8][2:] == ("example.com/de/", "block")
    assert found[9][2] is None and found[10][2:] == ("org/fr/", "allow") and found[11][2] == "org/fr/" and found[12][2] is None
    assert found[13][:2] == ("b:", "//c.net/") and found[14][0] == "u@h.net:80"


def test_mixing(docs, rows):
    found = mixing.mixing_digest(docs, mixing.Mixing(block_documents=2, period=30)).collect()
    assert sorted(r.position for r in found) == list(range(len(rows)))
    assert all(r.release <= r.slot < r.deadline for r in found)
    ordered = sorted(found, key=lambda r: r.position)
    assert [r.slot for r in ordered] == sorted(r.slot for r in found)
    assert mixing.mixed(docs).count() == len(rows)


@pytest.mark.parametrize("share", [[5, 3, 2], [1, 1, 8], [7, 2, 2, 1, 1]])
def test_schedule_deviation(docs, share):
    picks = [r.s for r in mixing.schedule(docs, share).orderBy("slot").collect()]
    period = sum(share)
    for t in range(1, period + 1):
        for s, a in enumerate(share):
            assert abs(picks[:t].count(s) - a * t / period) < 1


def test_given_weights(spark):
    """Deviation from the given weight itself, over several periods; a source without a weight has no slots."""
    from fractions import Fraction

    weights = {"a": 0.5, "b": 0.3, "c": 0.1999, "d": 0.0001, "e": 0.0}
    docs = spark.createDataFrame([(k, "abcde"[min(4, k % 7)]) for k in range(3000)], "doc_id long, source string")
    settings = mixing.Mixing(block_documents=1, weights=weights)
    assert mixing.shares(dict.fromkeys("abcde", 1), settings) == {"a": 5000, "b": 3000, "c": 1999, "d": 1}
    found = mixing.place(docs, settings).collect()
    assert {r.source for r in found} == set("abcd") and sorted(r.position for r in found) == list(range(len(found)))
    three = mixing.Mixing(block_documents=1, weights={"a": 0.2, "b": 0.7, "c": 0.1})
    by_slot = {r.slot: r.source for r in mixing.place(docs, three).collect()}
    seen = Counter()
    for t in range(1, 400):  # no source has run out yet
        seen[by_slot[t - 1]] += 1
        for s, w in three.weights.items():
            assert abs(seen[s] - t * Fraction(str(w))) < 1
    with pytest.raises(ValueError):
        mixing.shares({"a": 1, "b": 1}, mixing.Mixing(weights={"a": 1.0, "b": 0.1234567}))


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_word_encoder(tokenizer):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    rng, texts = random.Random(2), []
    letters = [*"ab \n\t's  .,!1é ßö", "\x1c", "\u00a0", "\u2003", "don't", " 've", "<|endoftext|>", "😀", "\r\n", "e\u0301", "word,", "Été.", '"']
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 14)))
        texts.append(text)
    for encoder, added_as_text in ((token_files.WordEncoder(tokenizer, 50), True), (token_files.WordEncoder(tokenizer, 50, False), False)):
        library.encode_special_tokens = added_as_text
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(encoder.encode(t), "<u4").tolist() for t in texts] == want


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_files(docs, rows, tokenizer, planes):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    settings = token_files.TokenFiles(tokenizer, planes=planes, block_ids=500, shard_ids=3000, range_bytes=20_000)
    start, expected = 0, []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    same(token_files.token_digest(docs, settings).collect(), expected)


def test_added_tokens(spark, tokenizer):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    start, expected, texts = 0, [], ["a <|endoftext|> b", "<|endoftext|>", "word<|endoftext|>\n<|endoftext|> word, twice", "a <|endoftext| > b", "plain text"]
    for k, text in enumerate(texts):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        expected.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = token_files.token_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), token_files.TokenFiles(tokenizer))
    same(found.collect(), expected)


def brute_dedup(rows):
    seen, expected = set(), []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = (text or "").encode().split()
        covered = [False] * len(w)
        for i in range(len(w) - 19):
            window = tuple(w[i : i + 20])
            if window in seen:
                covered[i : i + 20] = [True] * 20
            seen.add(window)
        expected.append((doc_id, len(w), sum(covered), hashlib.sha256(b" ".join(x for x, c in zip(w, covered, strict=True) if not c)).hexdigest()))
    return expected


@pytest.mark.parametrize("group_windows", [300, 20, 500_000])
def test_substrings(docs, rows, group_windows):
    # Rows that share an id are ordered by their place in the input, so equal rows may swap; their totals can't.
    settings = substring_dedup.SubstringDedup(portion_bytes=7000, group_windows=group_windows)
    expected = brute_dedup(rows)
    same(substring_dedup.dedup_digest(docs, settings).collect(), expected)
    assert any(e[2] for e in expected)
    for r in substring_dedup.dedup_substrings(docs, settings).collect():
        covered = {i for x in r.repeats for i in range(x.start, x.start + x.length)}
        assert len(covered) == r.n_removed and all(x.length >= 20 for x in r.repeats)


def test_hot_prefix(spark):
    """One prefix of two words, and one of five, before many different windows: more than a group holds."""
    rng = random.Random(4)
    tails = [" ".join(rng.choice("pqrs") for _ in range(18)) for _ in range(300)]
    rows = [(k, " x ".join(["of the " + tails[rng.randrange(300)], "all of the same words " + tails[rng.randrange(300)]])) for k in range(400)]
    settings = substring_dedup.SubstringDedup(portion_bytes=3000, group_windows=100)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).cache()
    same(substring_dedup.dedup_digest(docs, settings).collect(), brute_dedup(rows))
    plain = docs.selectExpr("doc_id", "cast(text as binary) as text")
    counts = [np.zeros(b, np.int64) for b in settings.buckets]
    for r in substring_dedup.prefix_counts(plain, settings).collect():
        counts[r.level][r.bucket] = r.n
    tables, first, groups = substring_dedup.groups_of_prefixes(counts, 100)
    assert all((t < 0).any() and (t >= 0).any() for t in tables) and groups > first > 2
