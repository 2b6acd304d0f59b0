"""The observation step as one transition, run over a table or over a stream.

An observation becomes a node of its session's graph. Four kinds of edges join it to the nodes before it; the
graph's connectivity (second eigenvalue of its Laplacian) follows, then the gate on how far it moved. When the
gate fires, the graph is cut by the signs of its second eigenvector: the newest node's side stays, the other is
archived, and candidates for the next observations are ranked by their gain for their cost. State is bounded by
``most_nodes``: beyond it the oldest node leaves. Observations older than the last one of their session come
out with ``late`` true and change nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.functions.vectors import COST, GAMMA, SECONDS_A_YEAR
from skein.operators.graph import fiedler

INPUT = "session long, us long, node long, modality string, embedding array<double>, at double, chi2 double, quality double"
OUTPUT = "session long, node long, step long, n_nodes int, lambda2 double, delta double, threshold double, fired boolean, stale array<bigint>, bound double, recommended array<string>, late boolean"
# Candidates for the next observation with their modalities.
CANDIDATES = [("MIRI_MRS_followup", "spectral"), ("NIRSpec_G395H_repeat", "spectral"), ("TESS_monitoring", "photometric"), ("photochem_retrieval", "model")]


@dataclass(frozen=True)
class Gate:
    sigma: float = 3.0
    least_cosine: float = 0.35
    least_weight: float = 0.10
    beta: float = 0.5
    years: float = 2.0
    tau: float = 0.15
    z: float = 2.326
    floor: float = 0.03
    warm_up: int = 2
    history: int = 20
    #: A cut needs so many nodes.
    least_nodes: int = 4
    most_nodes: int = 32
    budget: float = 10.0


@dataclass
class Session:
    """Nodes in order with their vectors and pair weights, and what the gate remembers. All of it is plain values."""

    last: tuple = (-(2**62), -1)
    step: int = 0
    before: float = float("nan")
    moves: list = field(default_factory=list)
    nodes: list = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


def unit_rows(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 1e-12)


def edge_weights(new: tuple, nodes: list[tuple], gate: Gate) -> np.ndarray:
    """Summed weight of the edges from a node to each earlier one. A node: id, modality, vector, time, chi2, quality."""
    vectors = unit_rows(np.array([n[2] for n in [*nodes, new]], float))
    cosine = vectors[:-1] @ vectors[-1]
    modality = np.array([n[1] for n in nodes])
    gap = np.abs(np.array([n[3] for n in nodes], float) - new[3])
    across = np.where((modality != new[1]) & (cosine >= gate.least_cosine), cosine, 0.0)
    coherent = np.exp(-gap / gate.sigma)
    model, spectral = ("model", "spectral") if new[1] == "model" else ("spectral", "model")
    fitting = (modality == spectral) if new[1] == model else np.zeros(len(nodes), bool)
    chi2 = np.array([new[4] if new[1] == "model" else n[4] for n in nodes], float)
    quality = np.array([n[5] for n in nodes], float) * new[5]
    physical = np.where(fitting, np.exp(-np.where(np.isnan(chi2), 2.0, chi2)) * cosine * quality, 0.0)
    recent = gate.beta + (1 - gate.beta) * np.exp(-gap / (gate.years * SECONDS_A_YEAR))
    cited = np.where((modality == "literature") | (new[1] == "literature"), cosine * recent, 0.0)
    return sum(np.where(w >= gate.least_weight, w, 0.0) for w in (across, coherent, physical, cited))


def laplacian(weights: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """I - D^-1/2 A D^-1/2 of pair edges whose ends are weighted by their modality's trust."""
    scaled = weights / np.maximum(trust[:, None] + trust[None, :], 1.0)
    a = scaled * trust[:, None] * trust[None, :]
    np.fill_diagonal(a, (trust**2) * scaled.sum(1))
    root = 1 / np.sqrt(np.maximum(a.sum(1), 1e-10))
    return np.eye(len(a)) - root[:, None] * a * root[None, :]


def recommendations(step: int, vectors: np.ndarray, influence: np.ndarray, lambda2: float, budget: float) -> list[str]:
    """Names of the candidates taken within the budget, by gain over cost. Candidates have seeded random directions."""
    drawn = np.array([np.random.default_rng(step * 10 + k).normal(0, 1, vectors.shape[1]) for k in range(len(CANDIDATES))])
    gain = (np.maximum(unit_rows(drawn) @ unit_rows(vectors).T, 0) ** 2) @ influence**2 / max(lambda2, 1e-4)
    cost = np.array([COST[m] for _, m in CANDIDATES])
    taken = []
    for k in np.argsort(-(gain / cost), kind="stable").tolist():
        if cost[k] <= budget:
            taken.append(CANDIDATES[k][0])
            budget -= cost[k]
    return taken


def advance(state: Session, us: int, node: tuple, gate: Gate) -> tuple:
    """One observation: changes the state and gives the row that follows from it, without the session."""
    if (us, node[0]) <= state.last:
        return node[0], state.step, len(state.nodes), None, None, None, False, None, None, None, True
    state.last, state.step = (us, node[0]), state.step + 1
    n = len(state.nodes)
    grown = np.zeros((n + 1, n + 1))
    grown[:n, :n] = state.weights
    if n:
        grown[n, :n] = grown[:n, n] = edge_weights(node, state.nodes, gate)
    state.nodes, state.weights = [*state.nodes, node][-gate.most_nodes :], grown[-gate.most_nodes :, -gate.most_nodes :]
    lambda2, vector = fiedler(laplacian(state.weights, np.array([GAMMA[x[1]] for x in state.nodes])))
    lambda2 = round(lambda2, 10)
    delta = None if state.step == 1 else round(state.before - lambda2, 10)
    state.before, threshold, fired, stale, bound, recommended = lambda2, None, False, None, None, None
    if delta is not None and state.step > gate.warm_up:
        state.moves = [*state.moves, abs(delta)][-gate.history :]
        seen = np.array(state.moves)
        threshold = gate.tau if len(seen) < 3 else float(np.clip(seen.mean() + gate.z * (seen.std() + 1e-8), gate.floor, gate.tau))
        fired = abs(delta) > threshold
    size = len(state.nodes)
    if fired and size >= gate.least_nodes:
        side = vector * (np.sign(vector[-1]) if abs(vector[-1]) > 1e-10 else 1.0) >= 0
        side[-1] = True
        stale = [state.nodes[k][0] for k in np.flatnonzero(~side)]
        bound = float(0.08 * np.sqrt(min(gate.tau / max(abs(delta), 1e-4), 1.0)))
        state.nodes, state.weights = [x for x, s in zip(state.nodes, side, strict=True) if s], state.weights[np.ix_(side, side)]
        influence = vector if side.all() else np.full(len(state.nodes), len(state.nodes) ** -0.5)
        recommended = recommendations(state.step, np.array([x[2] for x in state.nodes], float), influence, lambda2, gate.budget)
    return node[0], state.step, size, lambda2, delta, threshold, bool(fired), stale, bound, recommended, False


def observations(frame: DataFrame, session: str, ts: str, node: str, modality: Column, embedding: Column, at: Column, chi2: Column | None = None, quality: Column | None = None) -> DataFrame:
    """Rows as the transition takes them; ``at`` is the time that weights use. Rows of an unknown modality raise when they are met."""
    none = F.lit(None).cast("double")
    return frame.select(F.col(session).alias("session"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(node).alias("node"), modality.alias("modality"), embedding.alias("embedding"), at.cast("double").alias("at"), (none if chi2 is None else chi2).alias("chi2"), (F.lit(1.0) if quality is None else quality).alias("quality"))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    for session, us, node, modality, embedding, at, chi2, quality in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        yield session, us, (node, modality, embedding, at, float("nan") if chi2 is None else chi2, quality)


def batch_trace(rows: DataFrame, gate: Gate | None = None) -> DataFrame:
    """The trace of every session of a table. A task reads its sessions in order and holds one bounded state, so no session is gathered."""
    gate = gate or Gate()
    names = [f.split()[0] for f in OUTPUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, Session()
        for batch in batches:
            out = []
            for session, us, node in _rows(batch):
                if session != now:
                    now, state = session, Session()
                out.append((session, *advance(state, us, node, gate)))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.float64()] * 3, pa.bool_(), pa.list_(pa.int64()), pa.float64(), pa.list_(pa.string()), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows.repartition("session").sortWithinPartitions("session", "us", "node").mapInArrow(run, OUTPUT)


def stream_trace(rows: DataFrame, gate: Gate | None = None, lateness: str = "7 days", idle_ms: int = 86_400_000) -> DataFrame:
    """The same trace over a stream; a session's state goes when the watermark has passed it by ``idle_ms`` without rows."""
    gate = gate or Gate()
    names = [f.split()[0] for f in OUTPUT.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state, out = Session(), []
        if held.exists:
            last_us, last_node, kept = held.get
            state.last, (state.step, state.before, state.moves, state.nodes, state.weights) = (last_us, last_node), pickle.loads(kept)  # noqa: S301
        fresh = [r for pdf in batches for r in _rows(pa.RecordBatch.from_pandas(pdf[[f.split()[0] for f in INPUT.split(", ")]], preserve_index=False))]
        for session, us, node in sorted(fresh, key=lambda r: (r[1], r[2][0])):
            out.append((session, *advance(state, us, node, gate)))
        held.update((*state.last, pickle.dumps((state.step, state.before, state.moves, state.nodes, state.weights))))
        held.setTimeoutTimestamp(max(state.last[0] // 1000, held.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(out, columns=names).astype({"lambda2": "float64", "delta": "float64", "threshold": "float64", "bound": "float64"})

    timed = rows.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", lateness)
    return timed.groupBy("session").applyInPandasWithState(run, OUTPUT, "us long, node long, kept binary", "append", GroupStateTimeout.EventTimeTimeout)


def archive(trace: DataFrame) -> DataFrame:
    """session, step, delta, bound, node: one row for each node that a cut made stale, for appending to an archive."""
    return trace.where(F.size("stale") > 0).select("session", "step", "delta", "bound", F.explode("stale").alias("node"))


def trend(trace: DataFrame, length: int = 20) -> DataFrame:
    """session, step, the last ``length`` values of lambda2 in order, and their mean change."""
    from pyspark.sql import Window

    last = Window.partitionBy("session").orderBy("step").rowsBetween(-(length - 1), 0)
    held = trace.where("not late").select("session", "step", F.collect_list("lambda2").over(last).alias("recent"))
    change = (F.element_at("recent", -1) - F.element_at("recent", 1)) / (F.size("recent") - 1)
    return held.select("session", "step", "recent", F.when(F.size("recent") > 1, F.round(change, 10)).otherwise(F.lit(0.0)).alias("trend"))
