"""Queries over the event stream: session graphs, gates, detectors, arm statistics and simulated costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import vectors as V
from skein.functions.queueing import queue_wait
from skein.operators import detect, graph, models, simulate, stats
from skein.plans.registry import query, table
from skein.streaming import session

USER, ORDER = "user_id", ["ts", "event_id"]
ARMS = ["click", "error", "purchase", "signup", "view"]
#: The modality that each kind of event stands for in these queries.
MODALITIES = {"error": "spectral", "signup": "photometric", "purchase": "imaging", "click": "model", "view": "literature"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def modality(kind):
    return F.element_at(F.create_map(*(F.lit(x) for pair in MODALITIES.items() for x in pair)), kind)


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.last_nodes(events(spark, sf_dir), USER, ORDER, 8)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


PAIRS = """WITH last8 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events),
nodes AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord FROM last8 WHERE r <= 8),
pairs AS (SELECT x.user_id, x.event_id AS a, y.event_id AS b, (y.ord - x.ord)::BIGINT AS gap, exp(-(y.ord - x.ord) / 3.0) AS weight,
  x.event_type AS ta, y.event_type AS tb FROM nodes x JOIN nodes y ON x.user_id = y.user_id AND x.ord < y.ord WHERE exp(-(y.ord - x.ord) / 3.0) >= 0.10)"""
ADJACENCY = (
    PAIRS
    + """, arcs AS (SELECT user_id, a AS i, b AS j, weight FROM pairs UNION ALL SELECT user_id, b, a, weight FROM pairs),
deg AS (SELECT user_id, i, sum(weight) AS d FROM arcs GROUP BY ALL),
adj AS (SELECT r.user_id, r.i, r.j, 0.5 * r.weight * (1 / p.d + 1 / q.d) AS value FROM arcs r JOIN deg p ON p.user_id = r.user_id AND p.i = r.i
  JOIN deg q ON q.user_id = r.user_id AND q.i = r.j UNION ALL SELECT user_id, i, i, 1 + 1e-6 FROM deg)"""
)
LAPLACIAN = (
    ADJACENCY
    + """, rows AS (SELECT user_id, i, sum(value) AS d FROM adj GROUP BY ALL),
lap AS (SELECT e.user_id, e.i, e.j, CASE WHEN e.i = e.j THEN 1 ELSE 0 END - e.value / sqrt(p.d * q.d) AS value FROM adj e
  JOIN rows p ON p.user_id = e.user_id AND p.i = e.i JOIN rows q ON q.user_id = e.user_id AND q.i = e.j)"""
)


@query(PAIRS + " SELECT user_id, a, b, gap, round(weight, 6) AS weight FROM pairs")
def event_pair_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.pair_weights(windowed(spark, sf_dir), USER, "event_id"), "weight")


def _adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(graph.pair_weights(windowed(spark, sf_dir), USER, "event_id"), USER)


@query(ADJACENCY + " SELECT user_id, i, j, round(value, 6) AS value FROM adj")
def event_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_adjacency(spark, sf_dir), "value")


@query(LAPLACIAN + " SELECT user_id, i, j, round(value, 6) AS value FROM lap")
def event_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.normalized_laplacian(_adjacency(spark, sf_dir), USER), "value")


def _event_vector():
    """Kind and size of an event."""
    return F.array(*((F.col("event_type") == a).cast("double") for a in ARMS), F.coalesce(F.log1p(F.abs("value")), F.lit(0.0)) / 6)


def observed(frame: DataFrame) -> DataFrame:
    """Events as observations of their user: five modalities, small vectors, hours as time; errors are models with a misfit."""
    misfit = F.when(modality(F.col("event_type")) == "model", F.abs("value") / 50)
    return session.observations(frame, USER, "ts", "event_id", modality(F.col("event_type")), _event_vector(), F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9, misfit)


@query()
def event_observation_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observation step over every user's events: four kinds of edges, connectivity, gate, cut, bound, candidates."""
    return session.batch_trace(observed(events(spark, sf_dir)))


@query()
def stale_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.archive(session.batch_trace(observed(events(spark, sf_dir))))


@query()
def lambda2_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.trend(session.batch_trace(observed(events(spark, sf_dir))))


@query()
def event_lambda2_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connectivity of every user's window at every step, by closeness in time and cosine of event vectors, its fall and the gate."""
    trace = graph.vector_lambda2(events(spark, sf_dir), USER, ORDER, _event_vector())
    return graph.pivot_gate(trace, USER).select(USER, "step", "event_id", "n_window", "lambda2", "delta", "fired")


EDGE_SQL = """WITH v AS (SELECT user_id, event_id, epoch_us(ts) / 3.6e9 AS at, event_type, [(event_type = 'click')::INT::DOUBLE, (event_type = 'error')::INT::DOUBLE, (event_type = 'purchase')::INT::DOUBLE, (event_type = 'signup')::INT::DOUBLE, (event_type = 'view')::INT::DOUBLE, ln(1 + abs(value)) / 6] AS e,
  CASE WHEN event_type = 'click' THEN abs(value) / 50 END AS chi2, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
p AS (SELECT x.user_id, x.event_id AS a, y.event_id AS b, list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e)) AS c, abs(x.at - y.at) AS gap, x.event_type AS ta, y.event_type AS tb, coalesce(x.chi2, y.chi2, 2.0) AS chi2
  FROM v x JOIN v y ON x.user_id = y.user_id AND y.k BETWEEN x.k + 1 AND x.k + 3)
SELECT user_id, a, b, round(CASE WHEN ta <> tb AND c >= 0.35 THEN c ELSE 0 END, 6) AS cross_modality, round(exp(-gap / 3), 6) AS temporal,
  round(CASE WHEN (ta = 'error' AND tb = 'click') OR (ta = 'click' AND tb = 'error') THEN exp(-chi2) * c ELSE 0 END, 6) AS spectro_physical,
  round(CASE WHEN ta = 'view' OR tb = 'view' THEN c * (0.5 + 0.5 * exp(-gap / (2 * 3.15e7))) ELSE 0 END, 6) AS literature FROM p"""


@query(EDGE_SQL)
def event_edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four edge weights of each event and the three after it, as columns."""
    from pyspark.sql import Window

    rows = observed(events(spark, sf_dir)).withColumn("k", F.row_number().over(Window.partitionBy("session").orderBy("us", "node")))
    node = F.struct("node", "modality", "embedding", "at", "chi2", "quality")
    later = Window.partitionBy("session").orderBy("k").rowsBetween(1, 3)
    held = rows.select("session", node.alias("x"), F.collect_list(node).over(later).alias("later"))
    pairs = held.select("session", "x", F.explode("later").alias("y"))
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    differ = x("modality") != y("modality")
    fits = F.array_sort(F.array(x("modality"), y("modality"))) == F.array(F.lit("model"), F.lit("spectral"))
    cited = (x("modality") == "literature") | (y("modality") == "literature")
    zero = F.lit(0.0)
    out = pairs.select(
        F.col("session").alias(USER),
        x("node").alias("a"),
        y("node").alias("b"),
        F.when(differ, V.cross_modality_weight(x("embedding"), y("embedding"))).otherwise(zero).alias("cross_modality"),
        V.temporal_decay(x("at"), y("at")).alias("temporal"),
        F.when(fits, V.spectro_physical_weight(x("embedding"), y("embedding"), F.coalesce(x("chi2"), y("chi2")), x("quality"), y("quality"))).otherwise(zero).alias("spectro_physical"),
        F.when(cited, V.literature_weight(x("embedding"), y("embedding"), x("at"), y("at"))).otherwise(zero).alias("literature"),
    )
    return rounded(out, "cross_modality", "temporal", "spectro_physical", "literature")


GAMMA_SQL = "CASE {0} WHEN 'error' THEN 1.0 WHEN 'signup' THEN 0.9 WHEN 'purchase' THEN 0.8 WHEN 'click' THEN 0.7 WHEN 'view' THEN 0.5 END"


@query(
    PAIRS
    + f""", g AS (SELECT *, ({GAMMA_SQL.format("ta")})::DOUBLE AS ga, ({GAMMA_SQL.format("tb")})::DOUBLE AS gb FROM pairs),
parts AS (SELECT user_id, a AS i, b AS j, ga * gb * weight / greatest(ga + gb, 1.0) AS v FROM g UNION ALL SELECT user_id, b, a, ga * gb * weight / greatest(ga + gb, 1.0) FROM g
  UNION ALL SELECT user_id, a, a, ga * ga * weight / greatest(ga + gb, 1.0) FROM g UNION ALL SELECT user_id, b, b, gb * gb * weight / greatest(ga + gb, 1.0) FROM g),
m AS (SELECT user_id, i, j, sum(v) AS value FROM parts GROUP BY ALL), d AS (SELECT user_id, i, greatest(sum(value), 1e-10) AS d FROM m GROUP BY ALL)
SELECT m.user_id, m.i, m.j, round(CASE WHEN m.i = m.j THEN 1 ELSE 0 END - m.value / sqrt(p.d * q.d), 6) AS value FROM m
  JOIN d p ON p.user_id = m.user_id AND p.i = m.i JOIN d q ON q.user_id = m.user_id AND q.i = m.j"""
)
def gamma_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = windowed(spark, sf_dir)
    pairs = graph.pair_weights(nodes, USER, "event_id")
    trust = nodes.select(USER, "event_id", V.gamma_of(modality(F.col("event_type"))).alias("g"))
    ends = pairs.join(trust.select(USER, F.col("event_id").alias("a"), F.col("g").alias("ga")), [USER, "a"]).join(trust.select(USER, F.col("event_id").alias("b"), F.col("g").alias("gb")), [USER, "b"])
    return rounded(graph.normalized_laplacian(graph.gamma_adjacency(ends, USER), USER, 1e-10), "value")


@query(
    LAPLACIAN
    + """, x0 AS (SELECT user_id, event_id AS i, value AS x FROM nodes), x1 AS (SELECT l.user_id, l.i, sum(l.value * x.x) AS x FROM lap l JOIN x0 x ON x.user_id = l.user_id AND x.i = l.j GROUP BY ALL),
x2 AS (SELECT l.user_id, l.i, sum(l.value * x.x) AS x FROM lap l JOIN x1 x ON x.user_id = l.user_id AND x.i = l.j GROUP BY ALL)
SELECT x0.user_id, x0.i, round(0.1 * x0.x + 0.7 * x1.x - 0.2 * x2.x, 6) AS x FROM x0 JOIN x1 USING (user_id, i) JOIN x2 USING (user_id, i)"""
)
def laplacian_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lap = graph.normalized_laplacian(_adjacency(spark, sf_dir), USER)
    paired = lap.select(USER, "i").distinct()
    signal = windowed(spark, sf_dir).select(USER, F.col("event_id").alias("i"), F.col("value").alias("x")).join(paired, [USER, "i"], "left_semi")
    return rounded(graph.polynomial_filter(lap, signal, [USER], [0.1, 0.7, -0.2]), "x")


@query(
    LAPLACIAN
    + """, s AS (SELECT user_id, event_id AS i, CASE WHEN event_type IN ('error', 'purchase') THEN 1.0 ELSE -1.0 END AS s FROM nodes)
SELECT l.user_id, round(sum(l.value * p.s * q.s) / greatest(sum(CASE WHEN l.i = l.j THEN l.value ELSE 0 END), 1e-10), 6) AS proxy
FROM lap l JOIN s p ON p.user_id = l.user_id AND p.i = l.i JOIN s q ON q.user_id = l.user_id AND q.i = l.j GROUP BY l.user_id"""
)
def cut_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = windowed(spark, sf_dir).select(USER, F.col("event_id").alias("i"), F.when(F.col("event_type").isin("error", "purchase"), F.lit(1.0)).otherwise(F.lit(-1.0)).alias("s"))
    return rounded(graph.quadratic_form(graph.normalized_laplacian(_adjacency(spark, sf_dir), USER), sides, USER), "proxy")


@query(
    PAIRS
    + """, sides AS (SELECT ta AS side_i, tb AS side_j, weight FROM pairs UNION ALL SELECT tb, ta, weight FROM pairs),
own AS (SELECT side_i AS side, sum(CASE WHEN side_i <> side_j THEN weight ELSE 0 END) AS cut, sum(weight) AS volume FROM sides GROUP BY 1), t AS (SELECT sum(volume) AS total FROM own)
SELECT side, round(cut, 6) AS cut, round(volume, 6) AS volume, round(CASE WHEN least(volume, total - volume) > 0 THEN cut / least(volume, total - volume) ELSE 0 END, 6) AS ncut FROM own, t"""
)
def ncut_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = windowed(spark, sf_dir)
    arcs = graph.both_ways(graph.pair_weights(nodes, USER, "event_id"), USER)
    kind = nodes.select("event_id", "event_type")
    sided = arcs.join(kind.select(F.col("event_id").alias("i"), F.col("event_type").alias("side_i")), "i").join(kind.select(F.col("event_id").alias("j"), F.col("event_type").alias("side_j")), "j")
    return rounded(graph.normalized_cut(sided, "side"), "cut", "volume", "ncut")


@query(
    PAIRS
    + """, inc AS (SELECT a::VARCHAR || '-' || b::VARCHAR AS edge_id, a AS node_id FROM pairs UNION ALL SELECT a::VARCHAR || '-' || b::VARCHAR, b FROM pairs),
kept AS (SELECT * FROM inc WHERE node_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view'))
SELECT edge_id, node_id FROM kept WHERE edge_id IN (SELECT edge_id FROM kept GROUP BY 1 HAVING count(*) >= 2)"""
)
def removed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = graph.pair_weights(windowed(spark, sf_dir), USER, "event_id").withColumn("edge_id", F.concat_ws("-", "a", "b"))
    incidence = pairs.select("edge_id", F.explode(F.array("a", "b")).alias("node_id"))
    gone = events(spark, sf_dir).where("event_type = 'view'").select(F.col("event_id").alias("node_id"))
    return graph.remove_nodes(incidence, gone).select("edge_id", "node_id")


STANDARD = """WITH z AS (SELECT user_id, event_id, ts, event_type, value, (value - avg(value) OVER (PARTITION BY user_id)) / nullif(stddev_pop(value) OVER (PARTITION BY user_id), 0) AS z FROM events)"""


def _standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(USER)
    spread = F.stddev_pop("value").over(w)
    return events(spark, sf_dir).withColumn("z", F.when(spread != 0, (F.col("value") - F.avg("value").over(w)) / spread))


@query(
    STANDARD
    + """, s AS (SELECT *, sum(coalesce(z, 0) - 0.25) OVER w AS s FROM z WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
c AS (SELECT user_id, event_id, s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS score FROM s)
SELECT user_id, event_id, round(score, 6) AS score, round(score, 6) > 5 AS fired FROM c"""
)
def clamped_cumsum_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = detect.clamped_sum(_standard(spark, sf_dir), USER, ORDER, F.coalesce("z", F.lit(0.0)) - 0.25)
    return scored.select(USER, "event_id", F.round("score", 6).alias("score"), (F.round("score", 6) > 5).alias("fired"))


def _fold_sql(increment: str, limit: str) -> str:
    return f"""WITH RECURSIVE z AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, k, greatest(0.0, {increment.format("value")}) AS score FROM z WHERE k = 1
  UNION ALL SELECT z.user_id, z.event_id, z.k, greatest(0.0, CASE WHEN f.score >= {limit} THEN 0 ELSE f.score END + {increment.format("z.value")}) FROM f JOIN z ON z.user_id = f.user_id AND z.k = f.k + 1)
SELECT user_id, event_id, round(score, 6) AS score, score >= {limit} AS fired FROM f"""


@query(_fold_sql("(({0} / 50.0 - 1.0) / 0.5 - 0.25)", "1.5"))
def cusum_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect.cusum(events(spark, sf_dir), USER, ORDER, F.col("value") / 50.0, "event_id")
    return rounded(out.select(USER, "event_id", "score", "fired"), "score")


@query(_fold_sql("(({0} - 40.0) / 20.0 * 0.5)", "ln(99.0)"))
def sprt_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect.sprt(events(spark, sf_dir), USER, ORDER, (F.col("value") - 40.0) / 20.0, "event_id")
    return rounded(out.select(USER, "event_id", "score", "fired"), "score")


CLAMPED = """, s AS (SELECT *, sum({0}) OVER w AS s FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
c AS (SELECT user_id, event_id, s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS score FROM s)
SELECT user_id, event_id, round(score, 6) AS score, score > {1} AS fired FROM c"""
FITS = "WITH x AS (SELECT *, value / 50.0 AS c1, abs(value - 60) / 60.0 AS c2, (10 + event_id % 7)::DOUBLE AS n FROM events)"


def _fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumns({"c1": F.col("value") / 50.0, "c2": F.abs(F.col("value") - 60) / 60.0, "n": (F.col("event_id") % 7 + 10).cast("double")})


@query(FITS + CLAMPED.format("least(n, 50) * 0.5 * (c1 - c2)", "5"))
def sequential_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect.sequential_bayes(_fits(spark, sf_dir), USER, ORDER, F.col("c1"), F.col("c2"), F.col("n"))
    return rounded(out.select(USER, "event_id", "score", "fired"), "score")


@query(FITS + CLAMPED.format("c1 * n + 5 * ln(n) - (c2 * n + 7 * ln(n))", "10"))
def bic_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect.bic_comparison(_fits(spark, sf_dir), USER, ORDER, F.col("c1"), F.col("c2"), F.col("n"))
    return rounded(out.select(USER, "event_id", "score", "fired"), "score")


@query(
    """WITH p AS (SELECT user_id, event_id, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, count(value) OVER w AS n FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, event_id, round(abs(value - m), 9) AS shift, coalesce(n >= 2 AND abs(value - m) > 2 * s, false) AS fired FROM p"""
)
def running_mean_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect.running_mean_shift(events(spark, sf_dir), USER, ORDER, F.col("value"))
    return out.select(USER, "event_id", F.round("shift", 9).alias("shift"), "fired")  # sixth places can be exact halves


@query(
    """WITH d AS (SELECT user_id, event_id, ts, (value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000.0 AS delta,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events), q AS (SELECT *, CASE WHEN k >= 2 THEN abs(delta) END AS v FROM d),
p AS (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s, count(v) OVER w AS n FROM q WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
t AS (SELECT *, CASE WHEN n < 3 THEN 0.15 ELSE least(greatest(m + 2.326 * (s + 1e-8), 0.03), 0.15) END AS threshold FROM p)
SELECT user_id, event_id, round(delta, 6) AS delta, round(threshold, 6) AS threshold, coalesce(abs(delta) > threshold AND k >= 2, false) AS fired FROM t"""
)
def adaptive_threshold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    deltas = events(spark, sf_dir).withColumn("delta", (F.col("value") - F.lag("value").over(Window.partitionBy(USER).orderBy(*ORDER))) / 1000.0)
    out = graph.two_sided_gate(deltas, USER, ORDER, "delta")
    return rounded(out.select(USER, "event_id", "delta", "threshold", "fired"), "delta", "threshold")


@query(
    """WITH c AS (SELECT user_id, event_id, ts, sum((event_type = 'click')::INT) OVER w AS a, sum((event_type = 'purchase')::INT) OVER w AS b, row_number() OVER w AS k FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), l AS (SELECT *, CASE WHEN b > a THEN 2 ELSE 1 END AS leader FROM c)
SELECT user_id, event_id, leader, coalesce(leader <> lag(leader) OVER (PARTITION BY user_id ORDER BY ts, event_id) AND k > 2, false) AS fired FROM l"""
)
def leader_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect.leader_change(events(spark, sf_dir), USER, ORDER, (F.col("event_type") == "click").cast("int"), (F.col("event_type") == "purchase").cast("int"))
    return out.select(USER, "event_id", "leader", "fired")


@query(
    STANDARD
    + """, st AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, coalesce(z > 1.5, false) AS fired, event_type FROM z),
truth AS (SELECT user_id, min(step) AS truth FROM st WHERE event_type = 'error' GROUP BY 1)
SELECT st.user_id, truth::BIGINT AS truth, coalesce((coalesce(min(CASE WHEN fired AND step >= truth THEN step END), max(CASE WHEN fired THEN step END)) - truth)::DOUBLE, 'Infinity'::DOUBLE) AS pdl,
  round(count(CASE WHEN fired AND abs(step - truth) > 2 THEN 1 END) / count(*), 6) AS fpr, round(CASE WHEN count(CASE WHEN fired THEN 1 END) = 0 THEN 0 ELSE count(*) / (truth + greatest(coalesce(min(CASE WHEN fired AND step >= truth THEN step END) - truth, 0), 0) + 1) END, 6) AS oe
FROM st JOIN truth USING (user_id) GROUP BY st.user_id, truth"""
)
def pdl_fpr_oe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    steps = _standard(spark, sf_dir).select(USER, (F.row_number().over(Window.partitionBy(USER).orderBy(*ORDER)) - 1).cast("long").alias("step"), F.coalesce(F.col("z") > 1.5, F.lit(False)).alias("fired"), "event_type")
    truth = steps.where("event_type = 'error'").groupBy(USER).agg(F.min("step").alias("truth"))
    return rounded(detect.detection_metrics(steps, truth, USER), "fpr", "oe")


@query(
    STANDARD
    + """, st AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, z, event_type FROM z), p AS (SELECT user_id, step FROM st WHERE z > 1), t AS (SELECT user_id, step FROM st WHERE event_type = 'error'),
r AS (SELECT (SELECT count(*) FROM p WHERE EXISTS (SELECT 1 FROM t WHERE t.user_id = p.user_id AND abs(t.step - p.step) <= 1)) / (SELECT count(*) FROM p) AS precision,
  (SELECT count(*) FROM t WHERE EXISTS (SELECT 1 FROM p WHERE t.user_id = p.user_id AND abs(t.step - p.step) <= 1)) / (SELECT count(*) FROM t) AS recall)
SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM r"""
)
def pivot_f1_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    steps = _standard(spark, sf_dir).withColumn("step", F.row_number().over(Window.partitionBy(USER).orderBy(*ORDER)))
    out = stats.band_f1(steps.where("z > 1").select(USER, "step"), steps.where("event_type = 'error'").select(USER, "step"), [USER])
    return rounded(out, "precision", "recall", "f1")


@query()
def registered_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registered detector over each day's hourly activity (24 rows a session)."""
    hourly = events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").alias("hour")).agg((F.avg("value") / 50).alias("level"), (F.count("*") / 10).alias("rate"))
    return detect.run_detectors(hourly, "day", "hour", ["level", "rate"])


@query(
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS value_mean, round(stddev_samp(value) / sqrt(count(value)), 6) AS value_se,
  round(avg(k), 6) AS k_mean, round(stddev_samp(k) / sqrt(count(k)), 6) AS k_se FROM (SELECT *, (props->>'$.k')::DOUBLE AS k FROM events) GROUP BY 1"""
)
def arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return rounded(stats.arm_summary(frame, "event_type", ["value", "k"]), "value_mean", "value_se", "k_mean", "k_se")


@query(
    """WITH m AS (SELECT event_type, avg(value) AS value, avg((props->>'$.k')::DOUBLE) AS k FROM events GROUP BY 1), l AS (SELECT event_type, 'value' AS metric, value FROM m UNION ALL SELECT event_type, 'k', k FROM m)
SELECT l.event_type, l.metric, round(l.value, 6) AS value, round(100 * (l.value - b.value) / b.value, 6) AS pct_change FROM l JOIN l b ON b.metric = l.metric AND b.event_type = 'view' WHERE b.value <> 0"""
)
def pct_change_vs_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return rounded(stats.change_against_control(frame, "event_type", ["value", "k"], "view"), "value", "pct_change")


@query(
    """WITH o AS (SELECT event_type, avg(value) AS mean, median(value) AS median, stddev_samp(value) AS sd FROM events GROUP BY 1)
SELECT o.event_type, round(o.mean, 6) AS mean, round(o.median, 6) AS median, round(o.sd, 6) AS sd, round(100 * (o.mean - b.mean) / b.mean, 6) AS pct_change FROM o, (SELECT mean FROM o WHERE event_type = 'view') b"""
)
def outcome_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.outcome_summary(events(spark, sf_dir), "event_type", "value", "view"), "mean", "median", "sd")


PAIRED = """WITH w AS (SELECT user_id, avg(value) FILTER (event_type = 'view') AS a, avg(value) FILTER (event_type = 'click') AS b FROM events GROUP BY 1), p AS (SELECT * FROM w WHERE a IS NOT NULL AND b IS NOT NULL)"""


@query(
    PAIRED
    + """, d AS (SELECT b - a AS d, round(abs(b - a), 9) AS size FROM p), k AS (SELECT *, rank() OVER (ORDER BY size) + (count(*) OVER (PARTITION BY size) - 1) / 2.0 AS r FROM d),
s AS (SELECT sum(CASE WHEN size = 0 THEN r / 2 WHEN d > 0 THEN r ELSE 0 END) AS wp, sum(CASE WHEN size = 0 THEN r / 2 WHEN d < 0 THEN r ELSE 0 END) AS wm FROM k)
SELECT count(*) AS n, round(any_value(wp), 6) AS w_plus, round(any_value(wm), 6) AS w_minus, round(avg(d), 6) AS mean_diff, round(median(d), 6) AS median_diff, round(avg(d) / stddev_samp(d), 6) AS cohens_d FROM d, s"""
)
def paired_arm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.paired_stats(stats.paired(events(spark, sf_dir), USER, "event_type", "value", "view", "click"))
    return rounded(out.drop("p_value"), "w_plus", "w_minus", "mean_diff", "median_diff", "cohens_d")


@query()
def paired_arm_p_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed-rank p values of every arm against the control arm."""
    out = None
    for arm in ARMS[:-1]:
        one = stats.paired_stats(stats.paired(events(spark, sf_dir), USER, "event_type", "value", "view", arm)).select(F.lit(arm).alias("arm"), "n", "w_plus", "p_value")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    PAIRED
    + """, m AS (SELECT median(value) AS m FROM events), c AS (SELECT count(*) FILTER (a > m AND b > m) AS both, count(*) FILTER (a > m AND NOT b > m) AS only_a, count(*) FILTER (NOT a > m AND b > m) AS only_b, count(*) FILTER (NOT a > m AND NOT b > m) AS neither FROM p, m)
SELECT *, round(CASE WHEN only_a + only_b > 0 THEN (abs(only_a - only_b) - 1) ** 2 / (only_a + only_b) ELSE 0 END, 6) AS statistic FROM c"""
)
def mcnemar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    middle = events(spark, sf_dir).agg(F.percentile("value", F.lit(0.5)).alias("m"))
    pairs = stats.paired(events(spark, sf_dir), USER, "event_type", "value", "view", "click").join(F.broadcast(middle))
    return rounded(stats.mcnemar(pairs.select((F.col("a") > F.col("m")).alias("a"), (F.col("b") > F.col("m")).alias("b"))), "statistic")


@query(
    PAIRED
    + """, g AS (SELECT user_id % 4 AS grp, (b - a) / a * 100 AS pct FROM p WHERE a <> 0)
SELECT grp, count(*) AS n, round(avg(pct), 6) AS mean, round(median(pct), 6) AS median, round(quantile_cont(pct, 0.025), 6) AS low, round(quantile_cont(pct, 0.975), 6) AS high FROM g GROUP BY 1 HAVING count(*) >= 3"""
)
def subgroup_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = stats.paired(events(spark, sf_dir), USER, "event_type", "value", "view", "click").withColumn("grp", F.col(USER) % 4)
    return rounded(stats.subgroup_effects(pairs, "grp"), "mean", "median", "low", "high")


@query(
    """WITH c AS (SELECT date_trunc('day', ts) AS d, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT strftime(d, '%Y-%m-%d') AS day, event_type, n, round(n / sum(n) OVER (PARTITION BY d), 6) AS share FROM c"""
)
def value_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = events(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return rounded(stats.value_shares(daily, "day", "event_type"), "share")


@query(
    """WITH x AS (SELECT event_type, least(value, 200) AS v FROM events), m AS (SELECT event_type, avg(v) AS level, count(*)::DOUBLE AS n FROM x GROUP BY 1), l AS (SELECT event_type, 'level' AS metric, level AS v FROM m UNION ALL SELECT event_type, 'n', n FROM m)
SELECT event_type, metric, round(CASE WHEN max(v) OVER w = min(v) OVER w THEN 0.5 ELSE 1 - (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) END, 6) AS scaled FROM l WINDOW w AS (PARTITION BY metric)"""
)
def minmax_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = events(spark, sf_dir).groupBy("event_type").agg(F.avg(F.least("value", F.lit(200.0))).alias("level"), F.count("*").cast("double").alias("n"))
    long = means.unpivot("event_type", ["level", "n"], "metric", "v")
    return long.select("event_type", "metric", F.round(stats.min_max(long, "v", ["metric"], flip=True), 6).alias("scaled"))


@query("SELECT user_id, " + ", ".join(f"round(avg(value) FILTER (event_type = '{a}'), 6) AS \"{a}\"" for a in ARMS) + " FROM events GROUP BY 1")
def two_key_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.two_key_means(events(spark, sf_dir), USER, "event_type", ARMS, "value"), *ARMS)


@query(
    "SELECT event_type, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(median(v), 6) AS median, count(v) AS n FROM (SELECT event_type, CASE WHEN value > 100 THEN NULL ELSE value END AS v FROM events) GROUP BY 1"
)
def finite_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = events(spark, sf_dir).withColumn("v", F.when(F.col("value") > 100, F.lit(float("inf"))).otherwise(F.col("value")))
    return rounded(stats.finite_summary(frame, ["event_type"], "v"), "mean", "sd", "median")


@query("SELECT user_id, event_id, " + ", ".join(f"(event_type = '{a}')::INT AS event_type_{a}" for a in ARMS[1:]) + " FROM events")
def one_hot_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.one_hot(events(spark, sf_dir), "event_type", ARMS).select(USER, "event_id", *(f"event_type_{a}" for a in ARMS[1:]))


@query(
    """WITH w AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS va, count(*) FILTER (event_type = 'click') AS vb, max(value) FILTER (event_type = 'view') AS ma, max(value) FILTER (event_type = 'click') AS mb FROM events WHERE event_type IN ('view', 'click') GROUP BY 1)
SELECT user_id, 'n' AS field, va::VARCHAR AS value_a, vb::VARCHAR AS value_b FROM w WHERE va <> vb AND va > 0 AND vb > 0 UNION ALL SELECT user_id, 'most', floor(ma)::BIGINT::VARCHAR, floor(mb)::BIGINT::VARCHAR FROM w WHERE floor(ma) <> floor(mb)"""
)
def contested_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = events(spark, sf_dir).groupBy(USER, "event_type").agg(F.count("*").alias("n"), F.floor(F.max("value")).cast("long").alias("most"))
    return stats.contested(arms, [USER], "event_type", "view", "click", ["n", "most"])


QUEUE = """WITH arm AS (SELECT event_type, 1 / 0.8 AS service, avg(value) / 600 AS saved FROM events GROUP BY 1), m AS (SELECT event_type, 1 / greatest(service - saved, 1e-6) AS mu FROM arm),
r AS (SELECT event_type, mu, least(6.0 / (8 * mu), 0.9999) AS rho FROM m),
t AS (SELECT event_type, mu, rho, list_sum(list_transform(range(0, 8), lambda k: pow(8 * rho, k) / factorial(k::INT))) AS head, pow(8 * rho, 8) / factorial(8) / (1 - rho) AS tail FROM r)
SELECT event_type, round(rho, 6) AS rho, round(tail / (head + tail), 6) AS p_wait, round(tail / (head + tail) / (8 * mu * (1 - rho)) * 60, 6) AS wait_minutes FROM t"""


@query(QUEUE)
def queue_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = events(spark, sf_dir).groupBy("event_type").agg((F.avg("value") / 600).alias("saved"))
    wait = queue_wait(F.lit(0.8), F.lit(6.0), 8, F.col("saved"))
    return saved.select("event_type", F.round(wait["rho"], 6).alias("rho"), F.round(wait["p_wait"], 6).alias("p_wait"), F.round(wait["wait"] * 60, 6).alias("wait_minutes"))


@query(
    """WITH u AS (SELECT DISTINCT user_id FROM events), x AS (SELECT user_id, arm, md5(user_id::VARCHAR || arm) AS h FROM u, (VALUES ('view'), ('click'), ('error')) t(arm))
SELECT user_id, arm, (row_number() OVER (PARTITION BY user_id ORDER BY h, arm))::INT AS period FROM x"""
)
def crossover_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = events(spark, sf_dir).select(USER).distinct()
    return simulate.crossover(users, USER, ["view", "click", "error"], F.md5(F.concat(F.col(USER).cast("string"), F.col("arm"))))


@query(
    """WITH t AS (SELECT user_id, event_type, ts, event_id, value > 30 AS found, least(value / 10, 5) AS latency, least(value / 4, 20) AS dwell FROM events),
c AS (SELECT *, sum(CASE WHEN found THEN 8 + latency + 0.3 * dwell ELSE 35 + dwell + latency END) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS done_at FROM t),
s AS (SELECT user_id, event_type, count(*) AS n_turns, count(*) FILTER (found) AS n_found, max(done_at) AS whole, max(done_at) FILTER (found) AS hit FROM c GROUP BY 1, 2)
SELECT user_id, event_type, n_turns, n_found, round(least(CASE WHEN n_turns = n_found THEN hit ELSE whole + 45 * (n_turns - n_found) END, 300), 6) AS seconds FROM s"""
)
def session_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = events(spark, sf_dir).withColumns({"found": F.col("value") > 30, "latency": F.least(F.col("value") / 10, F.lit(5.0)), "dwell": F.least(F.col("value") / 4, F.lit(20.0))})
    return rounded(simulate.session_cost(turns, [USER, "event_type"], "event_id", "found", "latency", "dwell"), "seconds")


@query(
    """SELECT user_id, event_id, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), false) AS pivot FROM events"""
)
def topic_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.pivots(events(spark, sf_dir), USER, "event_id", "event_type").select(USER, "event_id", "pivot")


@query(
    """SELECT user_id, event_id, round(CASE WHEN d + p > 0 THEN 2 * d / (d + p) ELSE 1 END, 6) AS kappa, round(1 - exp(-2 * greatest(CASE WHEN d + p > 0 THEN 2 * d / (d + p) ELSE 1 END - 1, 0)), 6) AS gate
FROM (SELECT user_id, event_id, value AS d, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)"""
)
def shift_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.operators import retrieval

    out = retrieval.shift_ratio(events(spark, sf_dir), USER, "event_id", "value")
    return rounded(out.withColumn("gate", retrieval.soft_gate(F.col("kappa"))).select(USER, "event_id", "kappa", "gate"), "kappa", "gate")


@query(
    """SELECT event_id, round(CASE WHEN d <= 0 THEN 1 ELSE 0.08 * sqrt(0.15 / d) END, 6) AS bound, round(0.08 * sqrt(least(0.15 / greatest(abs(d), 1e-4), 1)), 6) AS capped FROM (SELECT event_id, (value - 20) / 100 AS d FROM events)"""
)
def contamination_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = (F.col("value") - 20) / 100
    return events(spark, sf_dir).select("event_id", F.round(V.contamination_bound(F.lit(0.15), d), 6).alias("bound"), F.round(V.capped_contamination_bound(F.lit(0.15), d), 6).alias("capped"))


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each user and kind of event that stands for an arm: means and whether many are large."""
    return events(spark, sf_dir).groupBy(USER, F.col("event_type").alias("arm")).agg(F.avg("value").alias("time"), F.count("*").cast("double").alias("load"), (F.avg("value") > 50).cast("int").alias("success"), F.min(F.pmod("event_id", F.lit(2))).alias("period"), F.pmod(USER, F.lit(3)).alias("specialty"))


@query()
def arm_against_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.against_benchmarks(_arms(spark, sf_dir), USER, "arm", "purchase", ["click", "view"], ["time", "load"])


@query(
    """WITH a AS (SELECT user_id, event_type AS arm, avg(value) AS time, count(*)::DOUBLE AS load FROM events GROUP BY ALL), m AS (SELECT user_id % 3 AS variant, arm, avg(time) AS time, avg(load) AS load FROM a GROUP BY ALL),
l AS (SELECT variant, arm, 'time' AS metric, time AS value FROM m UNION ALL SELECT variant, arm, 'load', load FROM m)
SELECT x.variant, x.arm, x.metric, round(x.value, 6) AS value, round(100 * (x.value - c.value) / c.value, 4) AS pct_change FROM l x JOIN l c ON x.variant = c.variant AND x.metric = c.metric AND c.arm = 'click' WHERE x.arm <> 'click' AND c.value <> 0"""
)
def ablation_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _arms(spark, sf_dir).withColumnRenamed("specialty", "variant")
    _, changes = models.ablation_summary(frame, "variant", "arm", ["time", "load"], "click")
    return changes.select("variant", "arm", "metric", F.round("value", 6).alias("value"), F.round("pct_change", 4).alias("pct_change"))


@query()
def mixed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log mean value of purchases against clicks, with a random intercept for each user."""
    frame = _arms(spark, sf_dir).where(F.col("arm").isin("click", "purchase"))
    columns, names = models.design(frame, "arm", ("click", "purchase"), ["period"], ["specialty"])
    return spark.createDataFrame(models.random_intercept(frame, USER, F.log1p("time"), columns, names), "name string, estimate double, error double, p_value double")


@query()
def clustered_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _arms(spark, sf_dir).where(F.col("arm").isin("click", "purchase"))
    columns, names = models.design(frame, "arm", ("click", "purchase"), ["period"], ["specialty"])
    return spark.createDataFrame(models.clustered_logistic(frame, USER, F.col("success"), columns, names), "name string, odds_ratio double, estimate double, error double, p_value double, converged boolean")
