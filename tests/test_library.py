"""Invariants of spectral operators, detectors, ETL, sources and the stream, and every query against its SQL."""

import math
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein import catalog
from skein.functions import encoders
from skein.functions import vectors as V
from skein.functions.queueing import queue_wait
from skein.operators import detect, etl, graph, models, retrieval, simulate, stats
from skein.plans import events as plans
from skein.sources import sinks, tables
from skein.streaming import session

SF = "/root/testdata/sf0.001"


def normalized(w):
    d = w.sum(1)
    r = np.divide(1, np.sqrt(d), out=np.zeros_like(d), where=d > 0)
    return np.eye(len(w)) - r[:, None] * w * r[None, :]


@pytest.mark.parametrize("n", [3, 5, 8, 12])
def test_closed_spectra(n):
    complete = np.ones((n, n)) - np.eye(n)
    path = np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
    cycle = path.copy()
    cycle[0, -1] = cycle[-1, 0] = 1
    assert graph.fiedler(normalized(complete))[0] == pytest.approx(n / (n - 1))
    assert graph.fiedler(normalized(path))[0] == pytest.approx(1 - math.cos(math.pi / (n - 1)))
    assert graph.fiedler(normalized(cycle))[0] == pytest.approx(1 - math.cos(2 * math.pi / n))
    two = np.kron(np.eye(2), np.ones((3, 3)) - np.eye(3))
    assert graph.fiedler(normalized(two))[0] == pytest.approx(0, abs=1e-9)
    assert graph.fiedler(np.eye(1))[0] == 0.0


def test_filters_agree():
    rng = np.random.default_rng(1)
    w = rng.random((20, 20))
    lap = normalized((w + w.T) / 2 * (1 - np.eye(20)))
    x = rng.random(20)
    exact = graph.spectral_filter(lap, x)
    assert np.abs(graph.filter_signal(lap, x, exact_size=5) - exact).max() < 0.02
    constant = np.sqrt(((w + w.T) / 2 * (1 - np.eye(20))).sum(1))
    assert np.abs(graph.chebyshev_filter(lap, constant, 0.5, order=60)).max() < np.abs(constant).max() * 0.2
    active, seed = graph.attenuate(lap, graph.fiedler(lap)[1], rng.random((20, 4)))
    assert active.any() and np.linalg.norm(seed) == pytest.approx(1)


def test_detectors():
    calm = np.r_[np.ones(12), np.full(6, 9.0)][:, None] + np.random.default_rng(0).normal(0, 0.1, (18, 1))
    assert detect.bocpd(calm)[12:14].any() and not detect.bocpd(calm[:12]).any()
    assert detect.mmd_shift(np.r_[np.zeros((8, 2)), np.full((4, 2), 3.0)] + np.random.default_rng(1).normal(0, 0.05, (12, 2)))[8]
    assert detect.merge_distances(np.array([[0.0], [1.0], [3.0]])).tolist() == [1.0, 2.0]
    assert detect.persistence_gap(np.array([[0.0], [1.0], [3.0]])) == 1.0
    assert detect.isolation(calm)[12]
    assert detect.message_drift(np.eye(4)).dtype == bool


def test_failed_detector_is_isolated(spark):
    frame = spark.createDataFrame([("a", k, float(k > 5)) for k in range(10)], "s string, k long, v double")
    detect.REGISTRY["broken"] = lambda values: 1 / 0
    try:
        rows = detect.run_detectors(frame, "s", "k", ["v"], ["bocpd", "broken"]).collect()
    finally:
        del detect.REGISTRY["broken"]
    assert {r.method for r in rows if r.error} == {"broken"} and len(rows) == 20


def test_queue_matches_published_pairs(spark):
    saved = spark.createDataFrame([(0.0,), (19.562,), (8.568,), (25.553,)], "s double")
    wait = queue_wait(F.lit(0.8), F.lit(6.0), 8, F.col("s") / 3600)
    found = [round(r[0] * 60, 1) for r in saved.select(wait["wait"]).collect()]
    assert found == [121.1, 111.5, 116.7, 108.8]


def test_context_beyond_a_block(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(400, 5))
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)] + [(1_000, [0.0] * 5), (1_001, None)], "vec_id long, embedding array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = (np.maximum(unit @ unit[::2].T, 0) ** 2).sum(1)
    found = {r.vec_id: r.total for r in graph.squared_cosine_sums(frame.where("vec_id % 2 = 0"), frame, block_rows=30).collect()}
    assert [found[k] for k in range(400)] == pytest.approx(want) and found[1_000] == found[1_001] == 0 and len(found) == 402


def test_info_gain_has_no_limit(spark, monkeypatch):
    limits, cut = [], type(spark.range(1)).limit
    monkeypatch.setattr(type(spark.range(1)), "limit", lambda self, n: limits.append(n) or cut(self, n))
    assert catalog.queries()["info_gain"](spark, SF).count() and not limits


def test_knapsack_skips_what_does_not_fit(spark):
    items = spark.createDataFrame([([(3.0, 1, 4.0), (2.0, 2, 5.0), (1.0, 3, 2.0)],)], "x array<struct<score:double,id:long,cost:double>>")
    assert items.select(graph.greedy_knapsack(F.col("x"), 7.0)).first()[0] == [1, 3]


def test_record_clusters(spark):
    notes = ["Patient reported fever and cough after travel.", "Blood pressure remained elevated throughout admission.", "Chest x-ray showed mild infiltrates.", "Medication was adjusted following review."]
    rows = spark.createDataFrame([(k, g, t) for k, (g, t) in enumerate(zip("abaa", notes, strict=True))] + [(9, None, "x")], "k long, g string, t string")
    found = {r.g: r for r in etl.record_clusters(rows, "g", "t", "k").collect()}
    assert found["a"].n == 3 and found["a"].signature == notes[0] and "fever" in found["a"].keywords and found["a"].examples.count(" || ") == 1 and found["b"].n == 1


def test_adjudication_overwrites_all_arms(spark):
    results = spark.createDataFrame([("v1", "control", 3), ("v1", "cma", 5)], "vignette_id string, condition string, trust int")
    decisions = spark.createDataFrame([("v1", "trust", "2", 1), ("v1", "trust", "4", 2)], "vignette_id string, field string, value string, at int")
    assert [r.trust for r in stats.apply_adjudications(results, decisions, "vignette_id", ["trust"]).collect()] == [4, 4]


def test_age(spark):
    ages = spark.createDataFrame([("> 89",), ("45",), ("x",)], "a string")
    assert [r[0] for r in ages.select(etl.age_of(F.col("a"))).collect()] == [90, 45, None]


def test_shift_ratio(spark):
    steps = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 1.0), ("a", 2, 4.0)], "s string, k int, d double")
    kappa = [r.kappa for r in retrieval.shift_ratio(steps, "s", "k", "d").orderBy("k").collect()]
    assert kappa[0] == 1 and kappa[1] == 1 and kappa[2] > 1.5


def test_crossover_is_complete(spark):
    out = simulate.crossover(spark.range(5).withColumnRenamed("id", "s"), "s", ["x", "y", "z"]).groupBy("s").agg(F.sum("period").alias("p")).collect()
    assert [r.p for r in out] == [6] * 5


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("p1", "n1", "text one"), ("p2", "n2", "text two")], "patient_id string, note_id string, text string")
    sinks.json_lines(rows, str(tmp_path / "notes"))
    assert tables.notes(spark, str(tmp_path / "notes")).count() == 2
    (tmp_path / "s.txt").write_text("# made up\nwavelength,depth,depth_err\n1.0,0.01,0.001\nx,1,2\n2.0,0.02,0.001\n")
    assert tables.sniffed_spectrum(spark, str(tmp_path / "s.txt")).count() == 2
    (tmp_path / "t.tsv").write_text("# c\n1.0\t2.0\na\tb\n3.0\t4.0\n")
    assert tables.number_table(spark, str(tmp_path / "t.tsv"), ["a", "b"]).count() == 2
    (tmp_path / "r1.report").write_text("whole\ntext")
    assert tables.reports(spark, str(tmp_path / "r1.report")).first() == ("r1", "whole\ntext")
    assert tables.annotations(spark, str(tmp_path), "session").count() == 0
    assert tables.first_existing(spark, str(tmp_path), "missing", "t.tsv").endswith("t.tsv")
    batch = pa.record_batch({"a": pa.array([1, 2]), "b": pa.array(["x", "y"])})
    with pa.OSFile(str(tmp_path / "one.arrow"), "wb") as f, pa.ipc.new_stream(f, batch.schema) as w:
        w.write_batch(batch)
    spark.dataSource.register(tables.ArrowShards)
    shards = spark.read.format("arrow_shards").option("path", str(tmp_path / "one.arrow")).option("schema_ddl", "a long, b string").load()
    assert sorted(map(tuple, shards.collect())) == [(1, "x"), (2, "y")]
    infinite = spark.createDataFrame([("m", float("inf"))], "m string, pdl double")
    sinks.json_documents(infinite, str(tmp_path / "doc"))
    assert spark.read.text(str(tmp_path / "doc")).first()[0] == '{"m":"m"}'
    assert sinks.fixed_width(infinite, {"m": 3, "pdl": 8}).first()[0].startswith("  m")


def brute_session(rows, gate):
    """The observation step by plain loops over a growing list of nodes and a dict of edges."""
    nodes, out, moves, before = [], [], [], None

    def cosine(a, b):
        la, lb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / (la * lb) if la * lb > 0 else 0.0

    for step, new in enumerate(rows, 1):
        nodes = [*nodes, new][-gate.most_nodes :]
        n = len(nodes)
        a = np.zeros((n, n))
        for i in range(n):
            for j in range(i):
                x, y = nodes[i], nodes[j]
                c, gap, ws = cosine(x["e"], y["e"]), abs(x["at"] - y["at"]), []
                if x["m"] != y["m"] and c >= 0.35:
                    ws.append(c)
                ws.append(math.exp(-gap / 3))
                if {x["m"], y["m"]} == {"spectral", "model"}:
                    chi2 = x["chi2"] if x["m"] == "model" else y["chi2"]
                    ws.append(math.exp(-(2.0 if chi2 is None else chi2)) * c)
                if "literature" in (x["m"], y["m"]):
                    ws.append(c * (0.5 + 0.5 * math.exp(-gap / (2 * 3.15e7))))
                w = sum(v for v in ws if v >= 0.10)
                gi, gj = V.GAMMA[x["m"]], V.GAMMA[y["m"]]
                scale = w / max(gi + gj, 1.0)
                a[i, j] += gi * gj * scale
                a[j, i] += gi * gj * scale
                a[i, i] += gi * gi * scale
                a[j, j] += gj * gj * scale
        lambda2, vector = graph.fiedler(normalized(np.where(a.sum(1)[:, None] > 0, a, 0)))
        delta = None if before is None else before - lambda2
        before, threshold, fired, stale = lambda2, None, False, None
        if delta is not None and step > 2:
            moves = [*moves, abs(delta)][-20:]
            threshold = 0.15 if len(moves) < 3 else min(max(np.mean(moves) + 2.326 * (np.std(moves) + 1e-8), 0.03), 0.15)
            fired = abs(delta) > threshold
        if fired and n >= 4:
            sign = -1 if vector[-1] < -1e-10 else 1
            stale = [x["id"] for k, x in enumerate(nodes[:-1]) if sign * vector[k] < 0]
            nodes = [x for x in nodes if x["id"] not in stale]
        out.append((new["id"], lambda2, delta, threshold, fired, stale))
    return out


def test_observation_step_by_brute_force(spark):
    rng, rows = np.random.default_rng(5), []
    for user in range(6):
        for k in range(45):
            turn = np.eye(6)[(k // 11 + user) % 6]
            chi2 = float(rng.random() * 3) if rng.random() < 0.5 else None
            rows.append((user, k * 10**6, 1000 * user + k, str(rng.choice(list(V.GAMMA))), (turn + rng.normal(0, 0.3, 6)).tolist(), k + float(rng.random()) + 40 * (k // 15), chi2, 1.0))
    gate = session.Gate(most_nodes=12)
    table = spark.createDataFrame(rows, session.INPUT).repartition(5)
    found = session.batch_trace(table, gate).collect()
    assert any(r.stale for r in found) and any(r.recommended for r in found)
    for user in range(6):
        mine = sorted((r for r in found if r.session == user), key=lambda r: r.step)
        want = brute_session([{"id": r[2], "m": r[3], "e": r[4], "at": r[5], "chi2": r[6]} for r in rows if r[0] == user], gate)
        for r, (node, lambda2, delta, threshold, fired, stale) in zip(mine, want, strict=True):
            assert r.node == node and r.lambda2 == pytest.approx(lambda2, abs=1e-8) and r.fired == fired and (r.stale or None) == (stale or None)
            assert (r.delta is None) == (delta is None) and (delta is None or r.delta == pytest.approx(delta, abs=1e-8))
            assert (r.threshold is None) == (threshold is None) and (threshold is None or r.threshold == pytest.approx(threshold, abs=1e-8))
    gone = session.archive(session.batch_trace(table, gate)).collect()
    assert len(gone) == sum(len(r.stale or []) for r in found)
    assert all(len(r.recent) <= 20 for r in session.trend(session.batch_trace(table, gate)).collect())


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    row = lambda r: (r.step, r.n_nodes, r.lambda2, r.delta, r.fired, r.stale, r.bound, r.recommended)
    batch = {(r.session, r.node): row(r) for r in catalog.flagship(spark, SF).collect()}
    assert len({r[2] for r in batch.values()}) > len(batch) / 2  # connectivity follows the events' contents
    for k in range(3):
        events.where((F.col("event_id") >= k * 334) & (F.col("event_id") < (k + 1) * 334)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = session.stream_trace(plans.observed(stream)).writeStream.format("memory").queryName("trace").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("trace").where("not late").collect()
    assert {(r.session, r.node): row(r) for r in rows} == batch


def test_codes_and_reports(spark):
    codes = {"5723": "icd9_digestive", "572.3": "icd9_digestive", "57.3": "icd9_infectious", "V58": "icd9_supplemental", "V58.1": "icd9_supplemental", "E880": "icd9_external", "I10": "icd10_chapter_I", "e11.9": "icd9_external", "Z": "unknown", "": "unknown", "abc": "unknown", "000": "unknown", " 41401 ": "icd9_circulatory", None: "unknown"}
    frame = spark.createDataFrame([(c,) for c in codes], "c string")
    assert {r.c: r.x for r in frame.withColumn("x", etl.icd_chapter(F.col("c"))).collect()} == codes
    texts = {"Consolidation seen": "cxr_pneumonia", "pleural thickening, pneumothorax": "cxr_effusion", "Vascular congestion": "cxr_cardiac", "No acute process": "cxr_no_acute", "abnormality": "cxr_no_acute", "edema": "cxr_abnormal", "  ": "cxr_unknown", None: "cxr_unknown"}
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.x for r in frame.withColumn("x", etl.report_class(F.col("t"))).collect()} == texts


def test_record_clusters_by_counting(spark):
    import re
    from collections import Counter

    rng = np.random.default_rng(2)
    words = ["The", "a", "don't", "x-ray", "Fever", "and", "cough,", "of", "3", "fever"]
    rows = [(["alpha", "beta", None][int(rng.integers(0, 3))], " ".join(rng.choice(words, rng.integers(0, 25))) if rng.random() > 0.1 else None, k) for k in range(60)]
    found = etl.record_clusters(spark.createDataFrame(rows, "g string, t string, k int"), "g", "t", "k").collect()
    for r in found:
        mine = [re.sub(r"\s+", " ", t or "").strip() for g, t, _ in rows if g == r.g]
        tokens, examples = Counter(), []
        for t in mine:
            w = re.findall(r"[A-Za-z0-9']+", t.lower())
            tokens.update(w[:12])
            if w and len(examples) < 2:
                examples.append(" ".join(w[:16])[:140])
        assert r.n == len(mine) and r.signature == next(t for t in mine if t)[:120] and r.examples == " || ".join(examples)
        assert r.keywords == ",".join(w for w, _ in tokens.most_common(4))
    assert [r.n for r in found] == sorted((r.n for r in found), reverse=True) and len(found) == 2


def cosines(x, n):
    k, i = np.arange(n)[:, None], np.arange(len(x))[None, :]
    c = (np.cos(np.pi * k * (2 * i + 1) / (2 * len(x))) @ x) * np.where(np.arange(n) == 0, np.sqrt(1 / len(x)), np.sqrt(2 / len(x)))
    return np.r_[c[: len(x)], np.zeros(max(0, n - len(x)))]


def test_encoders(spark):
    rng = np.random.default_rng(3)
    unit = lambda v: (lambda p: p / (np.linalg.norm(p) + 1e-10))(np.r_[v, np.zeros(max(0, 64 - len(v)))][:64])
    spectra = [(sorted(rng.uniform(0.6, 11, n).tolist()), rng.uniform(0.01, 0.02, n).tolist(), rng.uniform(1e-4, 1e-3, n).tolist()) for n in (5, 40, 90)]
    out = spark.createDataFrame(spectra, "w array<double>, d array<double>, u array<double>").select("*", encoders.spectrum(F.col("w"), F.col("d"), F.col("u")).alias("e"), encoders.light_curve(F.col("d")).alias("l")).collect()
    for r in out:
        w, d, u = map(np.array, (r.w, r.d, r.u))
        feats = []
        for low, high in encoders.FEATURE_BINS:
            m = (w >= low) & (w < high)
            feats.append(np.average(d[m], weights=1 / (u[m] ** 2 + 1e-20)) if m.any() else 0.0)
        so2, h2o = (w >= 4.0) & (w < 4.2), (w >= 1.3) & (w < 1.5)
        feats.append((d[so2].mean() if so2.any() else 0.0) / ((d[h2o].mean() if h2o.any() else 1e-5) + 1e-8))
        feats.append(np.clip(np.polyfit(np.log(w + 1e-6), np.log(np.clip(d, 1e-6, None)), 1)[0], -5, 5))
        assert r.e == pytest.approx(unit(np.r_[feats, cosines((d - d.mean()) / (d.std() + 1e-10), 32)]).tolist(), abs=1e-7)
        f = d / (d.max() + 1e-10)
        outside = f[f > 0.98]
        head = [1 - f.min(), (f < 0.99).mean(), f.var(), outside.std() if len(outside) > 2 else 0.0, np.corrcoef(f[:-1], f[1:])[0, 1]]
        assert r.l == pytest.approx(unit(np.r_[head, cosines(f - f.mean(), 32)]).tolist(), abs=1e-7)
    params = {"T_eq": 1300.0, "log_SO2": -5.0}
    r = spark.createDataFrame([(params, 2.0, "photochem")], "p map<string,double>, c double, l string").select(encoders.model(F.col("p"), F.col("c"), F.col("l"))).first()[0]
    fingerprint = np.sin(np.linspace(0, np.pi * 2.6, 32)) * 10**-3.5 * 10 + np.cos(np.linspace(0, np.pi, 32)) * 1e-5 * 50
    head = [300 / 400, 0, 0, 0, 2 / 2.5, 0, 0, np.log1p(2.0), 1.0]
    assert r == pytest.approx(unit(np.r_[head, cosines(fingerprint, 32)]).tolist(), abs=1e-7)
    text = "SO2 and so2: Water vapour, WATER; photochemistry of WASP"
    r = spark.createDataFrame([(text,)], "t string").select(encoders.literature(F.col("t"))).first()[0]
    counts = [text.lower().count(t.lower()) for t in encoders.LITERATURE_TERMS]
    assert r == pytest.approx(unit(np.r_[counts, 1.0, 1.0]).tolist())
    waves = spark.createDataFrame([([1.0, 2.0],), ([0.5] * 300,)], "s array<double>").select("s", encoders.waveform(F.col("s")).alias("e")).collect()
    assert all(len(x.e) == 128 and np.linalg.norm(x.e) == pytest.approx(1, abs=1e-5) for x in waves)
    assert set(encoders.ENCODERS) == {"spectrum", "light_curve", "model", "literature"} and encoders.register_functions(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM cut_windows(array(1D, 2D, 3D), 2)").collect()] == [(0, [1.0, 2.0]), (2, [3.0])]


def test_manifold_gate():
    rng = np.random.default_rng(42)
    same = [np.ones(10)] * 6
    assert retrieval.curvature(same[:3]) == 0.0 and retrieval.manifold_gate(same, [0.5, 0.3, 1.0, 0.7, 0.2, 0.9]) == ([0.5, 0.3, 1.0, 0.7, 0.2, 0.9], False)
    wild = [rng.normal(0, 5, 10) for _ in range(6)]
    weights, fired = retrieval.manifold_gate(wild, [1.0] * 6)
    assert fired and weights == [0.5] * 5 + [1.0]
    m = retrieval.symmetric_matrix(np.arange(10), 4)
    assert (m == m.T).all() and np.linalg.eigvalsh(retrieval.of_eigenvalues(m, np.exp)).min() > 0
    p, q = (retrieval.of_eigenvalues(retrieval.symmetric_matrix(rng.normal(size=10), 4), np.exp) for _ in range(2))
    assert retrieval.manifold_distance(p, q) == pytest.approx(retrieval.manifold_distance(q, p)) and retrieval.manifold_distance(p, p) == pytest.approx(0, abs=1e-6)


def test_random_intercept(spark):
    rng, rows = np.random.default_rng(1), []
    for g in range(60):
        shift = rng.normal(0, 0.7)
        for _ in range(int(rng.integers(1, 5))):
            x = float(rng.integers(0, 2))
            rows.append((g, "b" if x else "a", float(rng.normal()), 1.0 + 0.5 * x + shift + rng.normal(0, 0.4)))
    frame = spark.createDataFrame(rows, "g int, arm string, z double, y double")
    columns, names = models.design(frame, "arm", ("a", "b"), ["z"], [])
    found = models.random_intercept(frame, "g", F.col("y"), columns, names)
    x = np.array([[1.0, r[1] == "b", r[2]] for r in rows], float)
    y, g = np.array([r[3] for r in rows]), np.array([r[0] for r in rows])
    same = (g[:, None] == g[None, :]).astype(float)

    def dense(ratio):
        v = np.eye(len(y)) + ratio * same
        inverse = np.linalg.inv(v)
        beta = np.linalg.solve(x.T @ inverse @ x, x.T @ inverse @ y)
        r = y - x @ beta
        s2 = r @ inverse @ r / len(y)
        return -0.5 * (len(y) * np.log(s2) + np.linalg.slogdet(v)[1]), beta, np.sqrt(np.diag(np.linalg.inv(x.T @ inverse @ x)) * s2)

    best = max((dense(np.exp(t)) for t in np.linspace(-3, 4, 701)), key=lambda d: d[0])
    assert [f["estimate"] for f in found] == pytest.approx(best[1].tolist(), abs=1e-3)
    assert [f["error"] for f in found] == pytest.approx(best[2].tolist(), abs=1e-3)


def test_clustered_logistic(spark):
    rng = np.random.default_rng(6)
    rows = [(k, "b" if k % 2 else "a", int(rng.random() < (0.7 if k % 2 else 0.4))) for k in range(400)]
    frame = spark.createDataFrame(rows, "g int, arm string, y int")
    columns, names = models.design(frame, "arm", ("a", "b"), [], [])
    alone = models.clustered_logistic(frame, "g", F.col("y"), columns, names)
    share = {a: np.mean([y for _, b, y in rows if a == b]) for a in "ab"}
    logit = lambda p: math.log(p / (1 - p))
    assert [f["estimate"] for f in alone] == pytest.approx([logit(share["a"]), logit(share["b"]) - logit(share["a"])], abs=1e-6)
    assert alone[1]["error"] == pytest.approx(math.sqrt(sum(1 / (200 * share[a] * (1 - share[a])) for a in "ab")), rel=1e-3) and alone[1]["converged"]
    # Two equal rows in a cluster say what one says.
    twice = models.clustered_logistic(frame.union(frame), "g", F.col("y"), columns, names)
    assert [f["estimate"] for f in twice] == pytest.approx([f["estimate"] for f in alone], abs=1e-6)
    assert [f["error"] for f in twice] == pytest.approx([f["error"] for f in alone], rel=1e-3)


def test_cells_and_visits(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = graph.cells(vectors, most=8).select("vec_id", "cell").collect()
    assert len(found) == 500 and 1 < len({r.cell for r in found}) <= 8
    visits = spark.createDataFrame([(k, float(k % 4)) for k in range(20)], "i long, visits double")
    assert [r.i for r in graph.most_visited(visits, 6).collect()] == [3, 7, 11, 15, 19, 2]


def test_splits_of_a_kernel():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(5, 2)), rng.normal(1, 1, (4, 2))
    both = np.vstack([x, y])
    kernel = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(2) / 2)
    want = (kernel(x, x).sum() - 5) / 20 + (kernel(y, y).sum() - 4) / 12 - 2 * kernel(x, y).mean()
    assert detect.mmd2(np.arange(9)[None] < 5, kernel(both, both))[0] == pytest.approx(max(0, want))
    jumps = np.r_[np.ones(5), np.full(4, 3.0)][:, None]
    assert detect.cusum_resets(jumps).tolist() == [False] * 5 + [True] * 4 and detect.mean_shift(jumps)[5] and not detect.never(jumps).any()


def exchanges(frame):
    """Keys of the plan's exchanges by hash."""
    return re.findall(r"hashpartitioning\((.*?), \d+\)", frame._jdf.queryExecution().executedPlan().toString())


def test_bm25_exchanges_documents_by_key_only(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha"), (1, "beta"), (2, "beta gamma"), (3, "")], "doc long, text string")
    items = spark.createDataFrame([(7, "alpha beta")], "item long, text string")
    scores = retrieval.bm25_scores(docs, items, "doc", "item", "text")
    assert not [keys for keys in exchanges(scores) if "doc#" in keys or "k#" in keys and "," in keys]
    got = {r.doc: r.score for r in scores.collect()}
    idf = {"alpha": math.log(1 + 3.5 / 1.5), "beta": math.log(1 + 2.5 / 2.5)}
    part = lambda tf, n: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n * 4 / 6))
    assert got == pytest.approx({1: idf["alpha"] * part(2, 4) + idf["beta"] * part(2, 4), 2: idf["beta"] * part(1, 2)})


@pytest.mark.parametrize("most_sent", [0, 2, 100])
def test_tfidf_index_exchanges_rare_terms_only(spark, most_sent):
    rows = [(1, "alpha beta alpha gamma"), (1, "beta delta"), (2, None), (3, "alpha zeta"), (None, "alpha beta")]
    docs = spark.createDataFrame(rows, "doc long, text string")
    index = retrieval.tfidf_index(docs, "doc", "text", most_sent)
    assert not [keys for keys in exchanges(index) if "doc#" in keys and "term#" in keys]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {(d, t): w for d, t, w in con.execute(catalog.oracle_sql()["tfidf_index"]).fetchall()}
    assert {(r.doc, r.term): round(r.weight, 6) for r in index.collect()} == pytest.approx(want)


def test_top_terms_exchanges_by_key_only(spark):
    docs = spark.createDataFrame([(1, "with alpha beta beta"), (1, "gamma alpha alpha"), (2, "with")], "doc long, text string")
    top = etl.top_terms(docs, "doc", F.col("text"), 2)
    assert not [keys for keys in exchanges(top) if "," in keys]
    assert [(r.doc, r.term, r.n) for r in top.orderBy("doc", "place").collect()] == [(1, "alpha", 3), (1, "beta", 2)]


def test_blended_search_exchanges_no_pairs(spark):
    pairs = spark.createDataFrame([(1, 1, 3.0, 0.1), (1, 2, 1.0, 0.3), (2, 1, 5.0, 0.2)], "item long, doc long, lex double, sem double")
    first = pairs.where("doc = 1").select("item", "doc")
    out = retrieval.blended_pairs(pairs, "item", "doc", first, few_queries=True)
    assert not [keys for keys in exchanges(out) if "doc" in keys and "item" not in keys]
    alone = [retrieval.blended(pairs.withColumnRenamed("lex", "score"), pairs.withColumnRenamed("sem", "score"), "item", "doc", first), out]
    assert [{(r.item, r.doc): round(r.score, 9) for r in x.collect()} for x in alone] == [{(1, 1): 0.9, (1, 2): -0.8, (2, 1): 0.1}] * 2


def test_all_pairs_top_k_meets_blocks_exactly(spark):
    words = ["alpha", "beta", "gamma", "delta", "zeta", "theta", "kappa"]
    docs = [(n, " ".join(words[(n * k) % 7] for k in range(1, 2 + n % 5))) for n in range(1, 41)]
    items = [(q, " ".join(words[q % 7 : q % 7 + 3])) for q in range(1, 15)] + [(15, "unknown"), (16, None)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = retrieval.all_pairs_top_k(*frames, "doc_id", "item_id", "text", 10, doc_pairs=9, query_pairs=5, doc_parts=2)
    assert not [keys for keys in exchanges(got) if "term#" in keys or "doc_id#" in keys]
    con = duckdb.connect()
    for name, rows in (("documents", docs), ("benchmark", items)):
        con.execute(f"CREATE TABLE {name} ({'doc' if name == 'documents' else 'item'}_id BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    want = con.execute(catalog.oracle_sql()["lexical_topk"]).fetchall()
    assert {(r.item_id, r.doc_id, round(r.score, 6), r.rank) for r in got.collect()} == set(want)


@pytest.mark.parametrize("name", ["retrieval_metrics", "lexical_topk"])
def test_searches_exchange_no_postings(spark, name):
    assert not [keys for keys in exchanges(catalog.queries()[name](spark, SF)) if "doc_id#" in keys and "term#" in keys]


NAMES = sorted(catalog.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "lineitem", "events", "documents", "embeddings", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    clean = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    order = lambda r: tuple((x is None, str(x)) for x in r)
    found = sorted((tuple(clean(r[c]) for c in names) for r in df.collect()), key=order)
    rel = con.sql(catalog.oracle_sql()[name])
    at = [list(rel.columns).index(c) for c in names]
    assert found == sorted((tuple(clean(r[k]) for k in at) for r in rel.fetchall()), key=order)
