"""Session graphs as edge tables: weights, adjacency, Laplacians, cuts, filters and walks.

Both directions of an edge come from one explode rather than a union of the table with itself: it reads the
input once, and Spark 4.1.2 can give wrong rows for a union of equally partitioned sides whose exchange is
reused (spark.sql.unionOutputPartitioning).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import vectors as V


def last_nodes(nodes: DataFrame, session: str, order: list[str], k: int) -> DataFrame:
    """The last k nodes of each session with their place ``ord`` from 1; earlier ones have left the window."""
    newest = Window.partitionBy(session).orderBy(*(F.col(c).desc() for c in order))
    oldest = Window.partitionBy(session).orderBy(*order)
    kept = nodes.withColumn("__rank", F.row_number().over(newest)).where(F.col("__rank") <= k).drop("__rank")
    return kept.withColumn("ord", F.row_number().over(oldest))


def pair_weights(nodes: DataFrame, session: str, node: str, sigma: float = 3.0, least: float = 0.10) -> DataFrame:
    """session, a, b, gap, weight for pairs of a session's nodes (a before b) of enough weight.

    Sessions are windows of bounded length, and weights fall with the gap, so the join adds the largest gap
    that can still reach ``least``.
    """
    reach = int(-sigma * np.log(least))
    left = nodes.select(session, F.col(node).alias("a"), F.col("ord").alias("oa"))
    right = nodes.select(session, F.col(node).alias("b"), F.col("ord").alias("ob"))
    pairs = left.join(right, session).where((F.col("oa") < F.col("ob")) & (F.col("ob") - F.col("oa") <= reach))
    weighted = pairs.select(session, "a", "b", (F.col("ob") - F.col("oa")).cast("long").alias("gap")).withColumn("weight", V.temporal_decay(F.col("gap"), F.lit(0), sigma))
    return weighted.where(F.col("weight") >= least)


def both_ways(pairs: DataFrame, session: str) -> DataFrame:
    ends = F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("a").alias("j")))
    return pairs.select(session, "weight", F.explode(ends).alias("x")).select(session, "x.i", "x.j", "weight")


def adjacency(pairs: DataFrame, session: str, ridge: float = 1e-6) -> DataFrame:
    """session, i, j, value: half the weight over either node's degree, ones and a ridge on the diagonal."""
    arcs = both_ways(pairs, session)
    degree = arcs.groupBy(session, "i").agg(F.sum("weight").alias("d"))
    di, dj = degree.select(session, "i", F.col("d").alias("di")), degree.select(session, F.col("i").alias("j"), F.col("d").alias("dj"))
    entry = lambda i, j, w: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), w.alias("weight"))
    ends = F.array(entry("a", "b", F.col("weight")), entry("b", "a", F.col("weight")), entry("a", "a", F.lit(0.0)), entry("b", "b", F.lit(0.0)))
    cells = pairs.select(session, F.explode(ends).alias("x")).select(session, "x.i", "x.j", "x.weight").groupBy(session, "i", "j").agg(F.sum("weight").alias("weight"))
    off = F.col("weight") * 0.5 * (1 / F.col("di") + 1 / F.col("dj"))
    own = F.when(F.col("di") > 0, F.lit(1.0)).otherwise(F.lit(0.0)) + ridge
    return cells.join(di, [session, "i"]).join(dj, [session, "j"]).select(session, "i", "j", F.when(F.col("i") == F.col("j"), own).otherwise(off).alias("value"))


def normalized_laplacian(entries: DataFrame, session: str, least_degree: float = 0.0) -> DataFrame:
    """session, i, j, value of I - D^-1/2 A D^-1/2; nodes without degree keep their row of the identity."""
    degree = entries.groupBy(session, "i").agg(F.sum("value").alias("d")).withColumn("d", F.greatest("d", F.lit(least_degree)))
    di, dj = degree.select(session, "i", F.col("d").alias("di")), degree.select(session, F.col("i").alias("j"), F.col("d").alias("dj"))
    scaled = F.when((F.col("di") > 0) & (F.col("dj") > 0), F.col("value") / F.sqrt(F.col("di") * F.col("dj"))).otherwise(F.lit(0.0))
    own = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.lit(0.0))
    return entries.join(di, [session, "i"]).join(dj, [session, "j"]).select(session, "i", "j", (own - scaled).alias("value"))


def gamma_adjacency(pairs: DataFrame, session: str) -> DataFrame:
    """Entries of pair edges whose ends carry trust ``ga`` and ``gb``: products, and squares on the diagonal, over the larger of their sum and one."""
    total = F.greatest(F.col("ga") + F.col("gb"), F.lit(1.0))
    cross = F.col("ga") * F.col("gb") * F.col("weight") / total
    entry = lambda i, j, v: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), v.alias("value"))
    squared = lambda g: F.col(g) * F.col(g) * F.col("weight") / total
    ends = F.array(entry("a", "b", cross), entry("b", "a", cross), entry("a", "a", squared("ga")), entry("b", "b", squared("gb")))
    return pairs.select(session, F.explode(ends).alias("x")).groupBy(session, F.col("x.i").alias("i"), F.col("x.j").alias("j")).agg(F.sum("x.value").alias("value"))


def dense_laplacian(weights: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    """Normalised Laplacian of a small session from its symmetric pair weights."""
    b = weights.sum(1)
    inverse = np.divide(1.0, b, out=np.zeros_like(b), where=b > 0)
    a = 0.5 * weights * (inverse[:, None] + inverse[None, :])
    np.fill_diagonal(a, (b > 0) + ridge)
    if not (b > 0).any():
        a = np.eye(len(b))
    d = a.sum(1)
    root = np.divide(1.0, np.sqrt(d), out=np.zeros_like(d), where=d > 0)
    return np.eye(len(d)) - root[:, None] * a * root[None, :]


def fiedler(laplacian: np.ndarray) -> tuple[float, np.ndarray]:
    """Second-smallest eigenvalue, clipped to [0, 2], and its vector, turned so that the newest node isn't negative."""
    n = len(laplacian)
    if n < 2:
        return 0.0, np.ones(n) / max(1, np.sqrt(n))
    values, vecs = np.linalg.eigh((laplacian + laplacian.T) / 2)
    v = vecs[:, 1]
    return float(np.clip(values[1], 0.0, 2.0)), -v if v[-1] < 0 else v


def vector_lambda2(nodes: DataFrame, session: str, order: list[str], vector: Column, k: int = 8, alpha: float = 0.5, sigma: float = 3.0, least: float = 0.10) -> DataFrame:
    """Rows of ``nodes`` with step, n_window and lambda2 of the window of at most k nodes that ends there.

    Weights mix closeness in time and cosine of the nodes' vectors. Each row carries its own window, so no
    session is gathered in a worker.
    """
    trailing = Window.partitionBy(session).orderBy(*order).rowsBetween(-(k - 1), 0)
    running = Window.partitionBy(session).orderBy(*order)
    framed = nodes.withColumns({"step": F.row_number().over(running).cast("long"), "n_window": F.count(F.lit(1)).over(trailing), "__window": F.collect_list(vector).over(trailing)})

    @F.pandas_udf("double")
    def connectivity(windows: pd.Series) -> pd.Series:
        def one(rows: np.ndarray) -> float:
            x = np.stack([np.asarray(r, float) for r in rows])
            size = np.linalg.norm(x, axis=1)
            flat = np.divide(x, size[:, None], out=np.zeros_like(x), where=size[:, None] > 1e-9)
            gaps = np.abs(np.subtract.outer(np.arange(len(x)), np.arange(len(x))))
            w = alpha * np.exp(-gaps / sigma) + (1 - alpha) * (flat @ flat.T)
            w[(w < least) | (gaps == 0)] = 0.0
            return fiedler(dense_laplacian(w))[0]

        return windows.map(one)

    return framed.withColumn("lambda2", F.round(connectivity("__window"), 10)).drop("__window")


def pivot_gate(trace: DataFrame, session: str, tau: float = 0.15, least_nodes: int = 3) -> DataFrame:
    """Adds delta (fall of lambda2) and fired: at least two earlier values, enough nodes, and a fall beyond tau."""
    ordered = Window.partitionBy(session).orderBy("step")
    usable = F.when(F.col("n_window") >= least_nodes, F.col("lambda2"))
    with_value = trace.withColumn("__value", usable)
    earlier = F.count("__value").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    drop = F.lag("__value").over(ordered) - F.col("__value")
    return with_value.withColumns({"delta": drop, "fired": F.coalesce((earlier >= 2) & (drop > tau), F.lit(False))}).drop("__value")


def two_sided_gate(deltas: DataFrame, session: str, order: list[str], delta: str, tau: float = 0.15, z: float = 2.326, floor: float = 0.03, warm_up: int = 2, history: int = 20) -> DataFrame:
    """Adds threshold and fired: |delta| beyond a trailing mean plus z population deviations, within [floor, tau]."""
    ordered = Window.partitionBy(session).orderBy(*order)
    frame = ordered.rowsBetween(-(history - 1), 0)
    past = deltas.withColumn("__step", F.row_number().over(ordered) - 1).withColumn("__warm", F.when(F.col("__step") >= warm_up, F.abs(F.col(delta))))
    n, m, s = F.count("__warm").over(frame), F.avg("__warm").over(frame), F.stddev_pop("__warm").over(frame)
    limit = F.when(n < 3, F.lit(tau)).otherwise(F.least(F.greatest(m + z * (s + 1e-8), F.lit(floor)), F.lit(tau)))
    return past.withColumns({"threshold": limit, "fired": F.coalesce((F.abs(F.col(delta)) > limit) & (F.col("__step") >= warm_up), F.lit(False))}).drop("__step", "__warm")


def matvec(entries: DataFrame, vector: DataFrame, session: list[str]) -> DataFrame:
    """session, i, x of a matrix (i, j, value) times a vector (i, x)."""
    right = vector.select(*session, F.col("i").alias("j"), "x")
    return entries.join(right, [*session, "j"]).groupBy(*session, "i").agg(F.sum(F.col("value") * F.col("x")).alias("x"))


def high_pass_coefficients(gamma: float = 3.0, degree: int = 5, points: int = 200) -> list[float]:
    """Least-squares monomials of 1 - exp(-gamma * x) on [0, 2]."""
    x = np.linspace(0, 2, points)
    return [float(c) for c in np.linalg.lstsq(np.vander(x, degree + 1, increasing=True), 1 - np.exp(-gamma * x), rcond=None)[0]]


def polynomial_filter(laplacian: DataFrame, signal: DataFrame, session: list[str], coefficients: list[float]) -> DataFrame:
    """session, i, x of the sum of coefficients times powers of the Laplacian applied to the signal."""
    power, out = signal, signal.select(*session, "i", (F.col("x") * coefficients[0]).alias("sum"))
    for c in coefficients[1:]:
        power = matvec(laplacian, power, session)
        out = out.join(power, [*session, "i"], "left").select(*session, "i", (F.col("sum") + F.coalesce("x", F.lit(0.0)) * c).alias("sum"))
    return out.withColumnRenamed("sum", "x")


def chebyshev_coefficients(cut: float, top: float, order: int = 20, points: int = 400) -> list[float]:
    """Chebyshev series of the step that is one above ``cut`` on [0, top]."""
    theta = (np.arange(points) + 0.5) * np.pi / points
    step = (top / 2 * (np.cos(theta) + 1) >= cut).astype(float)
    return [float((1 if k == 0 else 2) / points * (step * np.cos(k * theta)).sum()) for k in range(order + 1)]


def chebyshev_filter(laplacian: np.ndarray, signal: np.ndarray, cut: float, top: float = 2.0, order: int = 20) -> np.ndarray:
    """The high-pass series applied to a small session's signal by its three-term recurrence."""
    shifted = laplacian * (2 / top) - np.eye(len(laplacian))
    c = chebyshev_coefficients(cut, top, order)
    before, now = signal, shifted @ signal
    out = c[0] * before + c[1] * now
    for k in range(2, order + 1):
        before, now = now, 2 * shifted @ now - before
        out = out + c[k] * now
    return out


def spectral_filter(laplacian: np.ndarray, signal: np.ndarray, gamma: float = 3.0) -> np.ndarray:
    values, vecs = np.linalg.eigh((laplacian + laplacian.T) / 2)
    return vecs @ ((1 - np.exp(-gamma * values)) * (vecs.T @ signal))


def filter_signal(laplacian: np.ndarray, signal: np.ndarray, gamma: float = 3.0, degree: int = 5, exact_size: int = 64) -> np.ndarray:
    """Exact on small sessions, by the polynomial beyond."""
    if len(laplacian) <= exact_size:
        return spectral_filter(laplacian, signal, gamma)
    out, power = np.zeros_like(signal), signal
    for c in high_pass_coefficients(gamma, degree):
        out = out + c * power
        power = laplacian @ power
    return out


def sign_cut(vector: np.ndarray, least_active: int = 1) -> np.ndarray:
    """Which nodes are active: those whose entry isn't negative, or all if too few are."""
    active = vector >= 0
    return active if active.sum() >= least_active else np.ones(len(vector), bool)


def attenuate(laplacian: np.ndarray, vector: np.ndarray, embeddings: np.ndarray, gamma: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Active nodes, and the unit mean of their embeddings weighted by the filtered norms."""
    active = sign_cut(vector)
    sub = laplacian[np.ix_(active, active)]
    weights = np.abs(filter_signal(sub, np.linalg.norm(embeddings[active], axis=1), gamma)) + 1e-9
    seed = (weights / weights.sum()) @ embeddings[active]
    size = np.linalg.norm(seed)
    return active, seed / size if size > 1e-9 else seed


def normalized_cut(arcs: DataFrame, side: str) -> DataFrame:
    """side value, cut, volume, ncut. arcs: i, j, weight with ``side_i`` and ``side_j``; each side against the rest."""
    crossing = F.when(F.col("side_i") != F.col("side_j"), F.col("weight")).otherwise(F.lit(0.0))
    own = arcs.groupBy(F.col("side_i").alias(side)).agg(F.sum(crossing).alias("cut"), F.sum("weight").alias("volume"))
    total = own.agg(F.sum("volume").alias("total"))
    least = F.least("volume", F.col("total") - F.col("volume"))
    return own.join(F.broadcast(total)).select(side, "cut", "volume", F.when(least > 0, F.col("cut") / least).otherwise(F.lit(0.0)).alias("ncut"))


def sever(arcs: DataFrame) -> DataFrame:
    return arcs.where("side_i = side_j")


def quadratic_form(laplacian: DataFrame, sides: DataFrame, session: str) -> DataFrame:
    """session, proxy: s' L s over the trace, for s in -1, 1."""
    left = sides.select(session, "i", F.col("s").alias("si"))
    right = sides.select(session, F.col("i").alias("j"), F.col("s").alias("sj"))
    met = laplacian.join(left, [session, "i"]).join(right, [session, "j"])
    diagonal = F.sum(F.when(F.col("i") == F.col("j"), F.col("value")).otherwise(F.lit(0.0)))
    return met.groupBy(session).agg((F.sum(F.col("value") * F.col("si") * F.col("sj")) / F.greatest(diagonal, F.lit(1e-10))).alias("proxy"))


def remove_nodes(incidence: DataFrame, gone: DataFrame, edge: str = "edge_id", node: str = "node_id") -> DataFrame:
    """Incidences without removed nodes, and without edges that keep fewer than two members."""
    left = incidence.join(gone.select(node).distinct(), node, "left_anti")
    alive = left.groupBy(edge).agg(F.count("*").alias("n")).where("n >= 2").select(edge)
    return left.join(alive, edge, "left_semi")


def nearest(queries: DataFrame, corpus: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", most_queries: int = 100_000) -> DataFrame:
    """query, neighbour, cosine, rank: the k corpus rows of largest cosine for each query (its own row left out), ties by id.

    The queries are a stated set whose number is checked, and go to every task as one matrix; a task keeps
    its k best for each query, so only those are exchanged.
    """
    rows = queries.select(key, vector).limit(most_queries + 1).toArrow()
    if rows.num_rows > most_queries:
        raise ValueError(f"more than {most_queries} queries; search in several calls")
    ids = rows[key].to_numpy()
    matrix = _unit_rows(rows[vector].to_pylist())
    shared = corpus.sparkSession.sparkContext.broadcast((ids, matrix))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        for frame in batches:
            own, flat = frame[key].to_numpy(), _unit_rows(frame[vector].tolist())
            order = np.argsort(own, kind="stable")
            own, flat = own[order], flat[order]
            for first in range(0, len(ids), 512):
                scores = np.round(matrix[first : first + 512] @ flat.T, 12)
                scores[ids[first : first + 512, None] == own[None, :]] = -np.inf
                top = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
                q = np.repeat(ids[first : first + 512], top.shape[1])
                out = pd.DataFrame({"query": q, "neighbour": own[top.ravel()], "cosine": np.take_along_axis(scores, top, 1).ravel()})
                yield out[np.isfinite(out.cosine)]

    kind = corpus.schema[key].dataType.simpleString()
    found = corpus.select(key, vector).mapInPandas(best, f"query {kind}, neighbour {kind}, cosine double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")))
    return ranked.where(F.col("rank") <= k)


def squared_cosine_sums(context: DataFrame, corpus: DataFrame, key: str = "vec_id", vector: str = "embedding", block_rows: int = 20_000) -> DataFrame:
    """key, total: the sum of squared positive cosines of each corpus key with all context rows.

    The context goes to every task in blocks of about ``block_rows``, one after the other; a row gives one
    partial sum to a block. Null and zero vectors add nothing.
    """
    from skein.plans.durable import durable

    parts, made = -(-context.count() // block_rows), None
    named = corpus.select(F.col(key).alias("key"), V.unit(vector).alias("e"))
    for part in range(parts):
        rows = context.where((F.pmod(F.xxhash64(key, vector), F.lit(parts)) == part) & F.col(vector).isNotNull()).select(V.unit(vector).alias("e")).toArrow()["e"].to_pylist()
        if not rows:
            rows = [[0.0]]
        shared = corpus.sparkSession.sparkContext.broadcast(np.array(rows).T)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matrix = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    some = batch.slice(at, 256)
                    rows = np.array([r if r is not None and len(r) == len(matrix) else np.zeros(len(matrix)) for r in some.column(1).to_pylist()])
                    total = (np.maximum(rows @ matrix, 0) ** 2).sum(1)
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array(total)], names=["key", "total"])

        found = durable(named.mapInArrow(sums, f"key {named.schema['key'].dataType.simpleString()}, total double"), "gains")
        made = found if made is None else made.union(found)
    if made is None:
        made = named.where("false").select("key", F.lit(0.0).alias("total"))
    return made.groupBy(F.col("key").alias(key)).agg(F.sum("total").alias("total"))


def _unit_rows(rows: list) -> np.ndarray:
    x = np.array(rows, float).reshape(len(rows), -1)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 1e-9)


def nearest_in_block(vectors: DataFrame, block: str, k: int, key: str = "vec_id", vector: str = "embedding", chunk: int = 2_000) -> DataFrame:
    """i, j, cosine: for each row the k rows of its block with the largest positive cosine, ties by id.

    Blocks are dealt in chunks, and each pair of chunks is one group, so a large block is many tasks.
    """
    place = Window.partitionBy(block).orderBy(key)
    sized = vectors.select(block, key, vector).withColumn("__chunk", F.floor((F.row_number().over(place) - 1) / chunk).cast("int"))
    chunks = sized.groupBy(block).agg((F.max("__chunk") + 1).alias("__chunks"))
    held = sized.join(chunks, block)
    each = F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1))
    left = held.select(block, F.col("__chunk").alias("qc"), each.alias("dc"), key, vector)
    right = held.select(F.col(block).alias("__block"), each.alias("__qc"), F.col("__chunk").alias("__dc"), F.col(key).alias("__key"), F.col(vector).alias("__vector"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"i": pd.Series(dtype="int64"), "j": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})
        if a.empty or b.empty:
            return empty
        b = b.sort_values("__key")
        scores = np.round(_unit_rows(a[vector].tolist()) @ _unit_rows(b["__vector"].tolist()).T, 12)
        scores[a[key].to_numpy()[:, None] == b["__key"].to_numpy()[None, :]] = -np.inf
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"i": np.repeat(a[key].to_numpy(), top.shape[1]), "j": b["__key"].to_numpy()[top.ravel()], "cosine": np.take_along_axis(scores, top, 1).ravel()})
        return out[out.cosine > 0]

    found = left.groupBy(block, "qc", "dc").cogroup(right.groupBy("__block", "__qc", "__dc")).applyInPandas(best, "i long, j long, cosine double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("cosine"), "j")))
    return ranked.where(F.col("rank") <= k).drop("rank")


def cells(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 2_048, rows: int = 50, seed: int = 42) -> DataFrame:
    """``vectors`` with ``cell``: the nearest of min(most, n / rows) k-means centres, on vectors of length one.

    Cells are the blocks for :func:`nearest_in_block`; cells larger than a chunk are many tasks there.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    flat = vectors.withColumn("__unit", array_to_vector(V.unit(vector)))
    k = max(1, min(most, flat.count() // rows))
    if k == 1:
        return vectors.withColumn("cell", F.lit(0))
    fitted = KMeans(k=k, seed=seed, featuresCol="__unit", predictionCol="cell", maxIter=10).fit(flat)
    return fitted.transform(flat).drop("__unit")


def most_visited(visits: DataFrame, k: int = 50) -> DataFrame:
    """The k nodes of most expected visits, ties by id; nodes without visits are left out."""
    return visits.where("visits > 0").orderBy(F.desc("visits"), "i").limit(k)


def symmetrised(arcs: DataFrame) -> DataFrame:
    """i, j, weight: half the sum of both directions."""
    ends = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    return arcs.select("cosine", F.explode(ends).alias("x")).groupBy(F.col("x.i").alias("i"), F.col("x.j").alias("j")).agg((F.sum("cosine") / 2).alias("weight"))


def transitions(arcs: DataFrame, phi: DataFrame, tau: float = 2.0) -> DataFrame:
    """i, j, p: arc weights damped by the squared distance of the ends' coordinates, normalised by node."""
    pi, pj = phi.select("i", F.col("phi").alias("pi")), phi.select(F.col("i").alias("j"), F.col("phi").alias("pj"))
    out = Window.partitionBy("i")
    base = arcs.withColumn("w0", F.col("weight") / F.sum("weight").over(out)).join(pi, "i").join(pj, "j")
    damped = base.withColumn("w", F.col("w0") * F.exp(F.lit(-tau) * F.pow(V.distance("pi", "pj"), F.lit(2))))
    total, n = F.sum("w").over(out), F.count("*").over(out)
    return damped.select("i", "j", F.when(total < 1e-12, 1 / n).otherwise(F.col("w") / total).alias("p"))


def expected_visits(steps: DataFrame, start: DataFrame, count: int) -> DataFrame:
    """i, visits: expected visits of a walk of ``count`` steps from the start weights (i, x)."""
    now, out = start, start.select("i", F.col("x").alias("visits"))
    for _ in range(count):
        now = now.join(steps, "i").groupBy(F.col("j").alias("i")).agg(F.sum(F.col("x") * F.col("p")).alias("x"))
        out = out.join(now, "i", "full").select("i", (F.coalesce("visits", F.lit(0.0)) + F.coalesce("x", F.lit(0.0))).alias("visits"))
    return out


def greedy_knapsack(items: Column, budget: float) -> Column:
    """Ids taken from an array of (score, id, cost) structs: best score first, skipping what no longer fits.

    Arrays are candidates of one session, bounded by the ranking that made them.
    """
    ordered = F.array_sort(F.transform(items, lambda x: F.struct((-x["score"]).alias("k"), x["id"].alias("id"), x["cost"].alias("cost"))))
    zero = F.struct(F.lit(budget).alias("left"), F.array().cast("array<bigint>").alias("ids"))

    def take(acc: Column, x: Column) -> Column:
        fits = x["cost"] <= acc["left"]
        return F.struct(F.when(fits, acc["left"] - x["cost"]).otherwise(acc["left"]).alias("left"), F.when(fits, F.concat(acc["ids"], F.array(x["id"].cast("bigint")))).otherwise(acc["ids"]).alias("ids"))

    return F.aggregate(ordered, zero, take, lambda acc: acc["ids"])


def spectral_coordinates(arcs: DataFrame, m: int = 16, rounds: int = 30, seed: int = 7) -> DataFrame:
    """i, phi: leading eigenvectors but the first of the normalised weights, by block power iteration.

    Each round is one join and one sum over the arcs; only the (m + 1)-square Gram matrix comes to the
    driver. Rounds are written to the shared folder every few steps to bound the lineage.
    """
    from skein.plans.durable import durable

    degree = arcs.groupBy("i").agg(F.sum("weight").alias("d"))
    scaled = arcs.join(degree, "i").join(degree.select(F.col("i").alias("j"), F.col("d").alias("dj")), "j").select("i", "j", (F.col("weight") / F.sqrt(F.col("d") * F.col("dj"))).alias("value"))
    scaled = durable(scaled, "arcs")
    width = m + 1
    draws = [(F.pmod(F.xxhash64("i", F.lit(k), F.lit(seed)), F.lit(1_000_003)) / 1_000_003 - 0.5) for k in range(width)]
    block = durable(degree.select("i", F.array(*draws).alias("x")), "block")
    for step in range(rounds):
        moved = scaled.join(block.select(F.col("i").alias("j"), "x"), "j")
        sums = moved.groupBy("i").agg(*(F.sum(F.col("value") * F.col("x")[k]).alias(f"x{k}") for k in range(width)))
        shifted = sums.join(block, "i").select("i", F.array(*(F.col(f"x{k}") + F.col("x")[k] for k in range(width))).alias("x"))
        shifted = durable(shifted, "block")
        gram = shifted.agg(*(F.sum(F.col("x")[a] * F.col("x")[b]) for a in range(width) for b in range(a + 1))).first()
        g = np.zeros((width, width))
        g[np.tril_indices(width)] = gram
        g = g + np.tril(g, -1).T + 1e-12 * np.eye(width)
        inverse = np.linalg.inv(np.linalg.cholesky(g)).T
        turned = [sum((F.col("x")[a] * float(inverse[a, k]) for a in range(k + 1)), F.lit(0.0)) for k in range(width)]
        block = shifted.select("i", F.array(*turned).alias("x"))
        if step % 3 == 2:
            block = durable(block, "block")
    return block.select("i", F.slice("x", 2, m).alias("phi"))
