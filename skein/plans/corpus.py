"""Queries over documents, conversations, benchmark items, embeddings and the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import encoders, spectra
from skein.functions import vectors as V
from skein.operators import etl, graph, retrieval, simulate, stats
from skein.plans.events import rounded
from skein.plans.registry import query, table

NORMED = "n AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS len FROM embeddings)"


@query(
    f"""WITH {NORMED}, c AS (SELECT q.vec_id AS query, d.vec_id AS neighbour, list_dot_product(q.e, d.e) / (q.len * d.len) AS cosine FROM n q JOIN n d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(cosine, 12) DESC, neighbour) AS rank FROM c) SELECT query, neighbour, round(cosine, 6) AS cosine, rank::INT AS rank FROM r WHERE rank <= 10"""
)
def embedding_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector as a query against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return rounded(graph.nearest(vectors.where("vec_id % 20 = 0"), vectors, 10), "cosine")


KNN = f"""WITH {NORMED}, c AS (SELECT a.vec_id AS i, b.vec_id AS j, round(list_dot_product(a.e, b.e) / (a.len * b.len), 12) AS cosine FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY cosine DESC, j) AS r FROM c WHERE cosine > 0) WHERE r <= 10),
sym AS (SELECT i, j, sum(cosine) / 2 AS weight FROM (SELECT i, j, cosine FROM k UNION ALL SELECT j, i, cosine FROM k) GROUP BY i, j)"""


def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.symmetrised(graph.nearest_in_block(table(spark, sf_dir, "embeddings"), "label", 10))


@query(KNN + " SELECT i, j, round(weight, 6) AS weight FROM sym")
def embedding_knn_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn(spark, sf_dir), "weight")


SIDES = ", s AS (SELECT sym.*, a.vec_id % 3 AS side_i, b.vec_id % 3 AS side_j FROM sym JOIN embeddings a ON a.vec_id = i JOIN embeddings b ON b.vec_id = j)"


def _sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(spark, sf_dir).withColumns({"side_i": F.col("i") % 3, "side_j": F.col("j") % 3})


@query(
    KNN
    + SIDES
    + """, own AS (SELECT side_i AS side, sum(CASE WHEN side_i <> side_j THEN weight ELSE 0 END) AS cut, sum(weight) AS volume FROM s GROUP BY 1), t AS (SELECT sum(volume) AS total FROM own)
SELECT side, round(cut, 6) AS cut, round(volume, 6) AS volume, round(cut / least(volume, total - volume), 6) AS ncut FROM own, t"""
)
def ncut_on_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.normalized_cut(_sided(spark, sf_dir), "side"), "cut", "volume", "ncut")


@query(KNN + SIDES + " SELECT i, j, round(weight, 6) AS weight FROM s WHERE side_i = side_j")
def severed_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.sever(_sided(spark, sf_dir)).select("i", "j", "weight"), "weight")


@query(
    KNN
    + """, phi AS (SELECT vec_id AS i, embedding[1:16]::DOUBLE[] AS phi FROM embeddings), b AS (SELECT sym.i, j, weight / sum(weight) OVER (PARTITION BY sym.i) * exp(-2 * list_distance(p.phi, q.phi) ** 2) AS w FROM sym JOIN phi p ON p.i = sym.i JOIN phi q ON q.i = sym.j),
t AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS p FROM b), x0 AS (SELECT DISTINCT i, 1.0 / (SELECT count(DISTINCT i) FROM sym) AS x FROM sym),
x1 AS (SELECT t.j AS i, sum(x * p) AS x FROM x0 JOIN t ON t.i = x0.i GROUP BY 1), x2 AS (SELECT t.j AS i, sum(x * p) AS x FROM x1 JOIN t ON t.i = x1.i GROUP BY 1), x3 AS (SELECT t.j AS i, sum(x * p) AS x FROM x2 JOIN t ON t.i = x2.i GROUP BY 1)
SELECT i, round(sum(x), 6) AS visits FROM (SELECT * FROM x0 UNION ALL SELECT * FROM x1 UNION ALL SELECT * FROM x2 UNION ALL SELECT * FROM x3) GROUP BY 1"""
)
def spectral_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected visits of a three-step walk from all nodes alike."""
    from skein.plans.durable import durable

    arcs = durable(knn(spark, sf_dir), "knn")
    phi = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.slice("embedding", 1, 16).alias("phi"))
    steps = durable(graph.transitions(arcs, phi), "transitions")
    nodes = arcs.select("i").distinct()
    start = nodes.join(F.broadcast(nodes.agg((F.lit(1.0) / F.count("*")).alias("x"))))
    return rounded(graph.expected_visits(steps, start, 3), "visits")


@query()
def spectral_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen spectral coordinates of the k-NN graph by distributed block power iteration."""
    return graph.spectral_coordinates(knn(spark, sf_dir), m=16, rounds=6)


@query(
    f"""WITH {NORMED}, ctx AS (SELECT * FROM n WHERE vec_id % 20 = 0), g AS (SELECT c.vec_id, sum(greatest(list_dot_product(c.e, x.e) / (c.len * x.len), 0) ** 2 / (SELECT count(*) FROM ctx)) / 0.5 AS gain FROM n c, ctx x GROUP BY 1)
SELECT vec_id, round(gain, 6) AS gain, round(exp(2 * gain) * gain, 6) AS weight FROM g"""
)
def info_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain of every vector against the context of every twentieth, weighted evenly, at connectivity one half."""
    vectors = table(spark, sf_dir, "embeddings")
    context = vectors.where("vec_id % 20 = 0")
    size = context.agg(F.count("*").alias("size"))
    held = graph.squared_cosine_sums(context, vectors).join(F.broadcast(size))
    gain = F.col("total") / F.col("size") / F.lit(0.5)
    return held.select("vec_id", F.round(gain, 6).alias("gain"), F.round(V.gain_weight(gain), 6).alias("weight"))


@query()
def knapsack_prefetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy choice of each label's vectors under a budget, best first, costs by surprise."""
    v = table(spark, sf_dir, "embeddings")
    scored = v.select("label", "vec_id", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("score"))
    best = etl.top_per_key(scored, "label", [F.desc("score"), F.asc("vec_id")], 50)
    cost = V.node_cost(F.least(F.abs("score"), F.lit(1.0)))
    items = best.groupBy("label").agg(F.collect_list(F.struct("score", F.col("vec_id").alias("id"), cost.alias("cost"))).alias("items"))
    return items.select("label", graph.greedy_knapsack(F.col("items"), 7.0).alias("chosen"))


TERMS = "t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL)"
INDEX = f"""WITH {TERMS}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), raw AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)),
ix AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""
WANTED = "qt AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS term FROM benchmark) GROUP BY ALL)"


@query(INDEX + " SELECT doc_id, term, round(weight, 6) AS weight FROM ix")
def tfidf_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(retrieval.tfidf_index(table(spark, sf_dir, "documents"), "doc_id", "text"), "weight")


@query(
    INDEX
    + f""", {WANTED}, s AS (SELECT item_id, doc_id, round(sum(weight * (1 + ln(qt.tf))), 9) AS score FROM ix JOIN qt USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT item_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10"""
)
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    scores = retrieval.lexical_scores(docs, items, "doc_id", "item_id", "text").withColumn("score", F.round("score", 9))
    return rounded(retrieval.top_k(scores, "item_id", "doc_id", 10), "score")


BM25 = f"""WITH {TERMS}, {WANTED}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), len AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY 1), c AS (SELECT (SELECT count(*) FROM documents) AS total, sum(len) AS words FROM len),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * len * total / words))), 9) AS score FROM tf JOIN qt USING (term) JOIN df USING (term) JOIN len USING (doc_id), c GROUP BY ALL)"""


@query(BM25 + ", r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT item_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = retrieval.bm25_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", "text").withColumn("score", F.round("score", 9))
    return rounded(retrieval.top_k(scores, "item_id", "doc_id", 10), "score")


@query(
    BM25
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s), top AS (SELECT r.item_id, r.rank, l.doc_id IS NOT NULL AS good FROM r LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = r.doc_id WHERE rank <= 10),
x AS (SELECT item_id, min(rank) FILTER (good) AS first, count(*) FILTER (good) AS g, count(*) AS n FROM top GROUP BY 1)
SELECT count(*) AS n, round(avg(CASE WHEN first IS NOT NULL THEN 10 ELSE 300 END), 6) AS ttci, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(g / n), 6) AS contextual_precision FROM x"""
)
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of BM25 rankings, with documents of good quality as relevant and the first of them as target."""
    scores = retrieval.bm25_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", "text").withColumn("score", F.round("score", 9))
    top = retrieval.top_k(scores, "item_id", "doc_id", 10)
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit(True).alias("good"))
    ranked = top.join(good, "doc_id", "left").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "good"))).alias("r"))
    ids = ranked.select("item_id", F.transform("r", lambda x: x["doc_id"]).alias("retrieved"), F.transform(F.filter("r", lambda x: x["good"]), lambda x: x["doc_id"]).alias("relevant"))
    out = stats.retrieval_metrics(ids.withColumns({"active": F.col("retrieved"), "target": F.get("relevant", F.lit(0)), "seconds": F.lit(10.0)}))
    return rounded(out, "ttci", "mrr", "contextual_precision")


@query(
    """WITH c AS (SELECT conv_id, turn, role, text, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS context FROM conversations)
SELECT conv_id, turn, length(context)::INT AS n_chars, md5(context) AS context_md5 FROM c WHERE role = 'user'"""
)
def session_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.with_history(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return out.where("role = 'user'").select("conv_id", "turn", F.length("context").alias("n_chars"), F.md5("context").alias("context_md5"))


@query(
    INDEX
    + """, h AS (SELECT conv_id, turn, role, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS context FROM conversations),
u AS (SELECT conv_id * 1000 + turn AS q, term, 1 + ln(count(*)) AS qw FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(context), '[a-z]{4,}')) AS term FROM h WHERE role = 'user') GROUP BY ALL),
s AS (SELECT q, doc_id, round(sum(weight * qw), 9) AS score FROM ix JOIN u USING (term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT q, doc_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10"""
)
def session_history_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = retrieval.with_history(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").where("role = 'user'").withColumn("q", F.col("conv_id") * 1000 + F.col("turn"))
    top = retrieval.all_pairs_top_k(table(spark, sf_dir, "documents"), turns.select("q", F.col("context").alias("text")), "doc_id", "q", "text", 10)
    return rounded(top, "score")


@query()
def blended_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical scores blended with a bounded second signal and a bonus, restricted to labelled documents, best five."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    pairs = retrieval.search_scores(docs, items, "doc_id", "item_id", "text").where("doc_id is not null")
    few = items.limit(100_001).count() <= 100_000
    prefetched = retrieval.top_k(pairs.withColumnRenamed("sem", "score"), "item_id", "doc_id", 3)
    scores = retrieval.blended_pairs(pairs, "item_id", "doc_id", prefetched, few_queries=few)
    return retrieval.top_k(retrieval.restricted(scores, table(spark, sf_dir, "labels"), "doc_id"), "item_id", "doc_id", 5)


STOP = "string_split('a about after all also an and any are as at be because been before being between both but by can could did do does during each even for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours yourself yourselves', ' ')"


@query(
    f"""WITH u AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS term, generate_subscripts(regexp_extract_all(lower(text), '[a-z]{{4,}}'), 1) AS p FROM documents), c AS (SELECT doc_id, term, count(*) AS n, min(p) AS first FROM u WHERE NOT list_contains({STOP}, term) GROUP BY ALL)
SELECT doc_id, term, n, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first, term) AS place FROM c) WHERE place <= 3"""
)
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.top_terms(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), 3).select("doc_id", "term", "n", "place")


@query(
    """WITH u AS (SELECT lang, doc_id AS o, trim(regexp_replace(text, '[ \\t\\n\\f\\r\\x0B]+', ' ', 'g')) AS t FROM documents WHERE lang IS NOT NULL), s AS (SELECT lang, count(*) AS n, substr(arg_min(t, o) FILTER (t <> ''), 1, 120) AS signature FROM u GROUP BY 1),
t AS (SELECT lang, o, regexp_extract_all(lower(t), '[a-z0-9'']+') AS w FROM u), w AS (SELECT lang, o, unnest(w[1:12]) AS w, generate_subscripts(w[1:12], 1) AS p FROM t),
c AS (SELECT lang, w, count(*) AS c, min((o, p)) AS first_at FROM w GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY c DESC, first_at, w) AS r FROM c),
kk AS (SELECT lang, string_agg(w, ',' ORDER BY r) AS keywords FROM k WHERE r <= 4 GROUP BY 1), e AS (SELECT lang, substr(array_to_string(w[1:16], ' '), 1, 140) AS e, row_number() OVER (PARTITION BY lang ORDER BY o) AS r FROM t WHERE len(w) > 0),
ee AS (SELECT lang, string_agg(e, ' || ' ORDER BY r) AS examples FROM e WHERE r <= 2 GROUP BY 1) SELECT s.lang, n, coalesce(signature, '') AS signature, coalesce(keywords, '') AS keywords, coalesce(examples, '') AS examples FROM s LEFT JOIN kk USING (lang) LEFT JOIN ee USING (lang)"""
)
def record_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.record_clusters(table(spark, sf_dir, "documents"), "lang", "text", "doc_id")


@query(
    """SELECT doc_id, CASE WHEN contains(t, 'pneumonia') OR contains(t, 'consolidation') THEN 'cxr_pneumonia' WHEN contains(t, 'effusion') OR contains(t, 'pleural') THEN 'cxr_effusion'
  WHEN contains(t, 'pneumothorax') THEN 'cxr_pneumothorax' WHEN contains(t, 'cardiomegaly') OR contains(t, 'heart failure') OR contains(t, 'vascular congestion') THEN 'cxr_cardiac' WHEN contains(t, 'fracture') THEN 'cxr_fracture'
  WHEN contains(t, 'no acute') OR contains(t, 'no evidence') OR contains(t, 'no significant') OR contains(t, 'normal') OR contains(t, 'unremarkable') THEN 'cxr_no_acute' WHEN regexp_matches(t, '[^ \\t\\n\\f\\r]') THEN 'cxr_abnormal' ELSE 'cxr_unknown' END AS class
FROM (SELECT doc_id, lower(coalesce(text, '')) || CASE doc_id % 9 WHEN 0 THEN ' Consolidation' WHEN 1 THEN ' pleural' WHEN 2 THEN ' heart failure' WHEN 3 THEN ' fractured' WHEN 4 THEN ' abnormal' ELSE '' END AS t0, lower(t0) AS t FROM documents)"""
)
def report_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reports; five of nine carry a finding."""
    found = F.element_at(F.array(*map(F.lit, [" Consolidation", " pleural", " heart failure", " fractured", " abnormal", "", "", "", ""])), (F.pmod("doc_id", F.lit(9)) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", etl.report_class(F.concat(F.coalesce("text", F.lit("")), found)).alias("class"))


@query(
    """WITH x AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'V' || (l_partkey % 90)::VARCHAR WHEN 1 THEN (l_partkey % 1000)::VARCHAR || '.' || (l_suppkey % 10)::VARCHAR WHEN 2 THEN 'E' || (800 + l_partkey % 200)::VARCHAR ELSE chr((65 + l_partkey % 26)::INT) || (l_suppkey % 100)::VARCHAR END AS code FROM lineitem),
y AS (SELECT *, string_split(upper(trim(code)), '.')[1] AS c FROM x), z AS (SELECT *, try_cast(substr(regexp_replace(c, '[^0-9]', '', 'g'), 1, 3) AS INT) AS n FROM y)
SELECT l_orderkey, l_linenumber, code, CASE WHEN regexp_full_match(c, 'V[0-9]+') THEN 'icd9_supplemental' WHEN regexp_full_match(c, 'E[0-9]+') THEN 'icd9_external' WHEN regexp_matches(c, '^[A-Z][0-9]') THEN 'icd10_chapter_' || c[1]
  WHEN n IS NULL OR n < 1 OR n > 999 THEN 'unknown' WHEN n < 140 THEN 'icd9_infectious' WHEN n < 240 THEN 'icd9_neoplasms' WHEN n < 280 THEN 'icd9_endocrine_nutritional' WHEN n < 290 THEN 'icd9_blood' WHEN n < 320 THEN 'icd9_mental'
  WHEN n < 390 THEN 'icd9_nervous_sense' WHEN n < 460 THEN 'icd9_circulatory' WHEN n < 520 THEN 'icd9_respiratory' WHEN n < 580 THEN 'icd9_digestive' WHEN n < 630 THEN 'icd9_genitourinary' WHEN n < 680 THEN 'icd9_pregnancy'
  WHEN n < 710 THEN 'icd9_skin' WHEN n < 740 THEN 'icd9_musculoskeletal' WHEN n < 760 THEN 'icd9_congenital' WHEN n < 780 THEN 'icd9_perinatal' WHEN n < 800 THEN 'icd9_symptoms_signs' ELSE 'icd9_injury_poisoning' END AS chapter FROM z"""
)
def icd_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnosis codes made from line items, by chapter."""
    k, p, s = F.col("l_linenumber") % 4, F.col("l_partkey"), F.col("l_suppkey")
    code = F.when(k == 0, F.concat(F.lit("V"), (p % 90).cast("string"))).when(k == 1, F.concat((p % 1000).cast("string"), F.lit("."), (s % 10).cast("string"))).when(k == 2, F.concat(F.lit("E"), (p % 200 + 800).cast("string"))).otherwise(F.concat(F.char(p % 26 + 65), (s % 100).cast("string")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", code.alias("code")).withColumn("chapter", etl.icd_chapter(F.col("code")))


@query(
    """WITH f AS (SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY 1),
i AS (SELECT o_custkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY o_custkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
t AS (SELECT o_custkey, string_agg(l_orderkey::VARCHAR || ':' || l_linenumber::VARCHAR, '; ' ORDER BY r) AS items FROM i WHERE r <= 5 GROUP BY 1)
SELECT c_custkey, c_mktsegment, coalesce(first_order, -1) AS first_order, coalesce(items, '') AS items FROM customer LEFT JOIN f ON f.o_custkey = c_custkey LEFT JOIN t ON t.o_custkey = c_custkey"""
)
def first_and_topk_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines, customers = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    first = etl.first_per_key(orders, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey"]).withColumnsRenamed({"o_orderkey": "first_order", "o_custkey": "c_custkey"})
    owned = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    listed = etl.listed_per_key(owned, "o_custkey", order, 5, F.concat_ws(":", "l_orderkey", "l_linenumber"), "items").withColumnRenamed("o_custkey", "c_custkey")
    return customers.join(first, "c_custkey", "left").join(listed, "c_custkey", "left").select("c_custkey", "c_mktsegment", F.coalesce("first_order", F.lit(-1)).alias("first_order"), F.coalesce("items", F.lit("")).alias("items"))


@query(
    """WITH o AS (SELECT o_custkey AS k, string_agg(o_orderstatus, '; ' ORDER BY r) AS v FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r <= 3 GROUP BY 1),
p AS (SELECT o_custkey AS k, string_agg(o_orderpriority, '; ' ORDER BY r) AS v FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F') WHERE r <= 2 GROUP BY 1)
SELECT coalesce(o.k, p.k) AS o_custkey, concat_ws(' | ', 'Status: ' || o.v, 'Priority: ' || p.v) AS text FROM o FULL JOIN p ON o.k = p.k"""
)
def key_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    a = etl.listed_per_key(orders, "o_custkey", [F.asc("o_orderdate"), F.asc("o_orderkey")], 3, F.col("o_orderstatus"), "a")
    b = etl.listed_per_key(orders.where("o_orderstatus = 'F'"), "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 2, F.col("o_orderpriority"), "b")
    return etl.summary_text([a, b], "o_custkey", {"a": "Status", "b": "Priority"})


@query("SELECT c_custkey, coalesce(n_name, 'unknown') AS n_name, coalesce(r_name, 'unknown') AS r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def dimension_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    region = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    named = etl.looked_up(table(spark, sf_dir, "customer"), nation, "c_nationkey", "n_name", "unknown")
    return etl.looked_up(named.join(nation.select("c_nationkey", "n_regionkey"), "c_nationkey", "left"), region, "n_regionkey", "r_name", "unknown").select("c_custkey", "n_name", "r_name")


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def missing_work_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT DISTINCT d.doc_id, d.source, d.lang FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) OR lang IN (SELECT lang FROM documents GROUP BY 1 HAVING count(*) < (SELECT count(*) FROM documents) * 0.15)")
def either_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    total = docs.agg(F.count("*").alias("total"))
    rare = docs.groupBy("lang").agg(F.count("*").alias("n")).join(F.broadcast(total)).where("n < total * 0.15").select("lang")
    return retrieval.either_candidate(docs, toxic, rare, "doc_id", "lang")


@query(
    """WITH r AS (SELECT c_custkey, c_mktsegment, percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey::VARCHAR), c_custkey) AS p FROM customer)
SELECT c_custkey, c_mktsegment, CASE WHEN p < 0.7 THEN 'train' WHEN p < 0.85 THEN 'val' ELSE 'test' END AS split FROM r"""
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = etl.stratified_split(table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment", F.md5(F.col("c_custkey").cast("string")), validation=0.15)
    return out.select("c_custkey", "c_mktsegment", "split")


@query(
    """WITH e AS (SELECT doc_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n = 8 ORDER BY doc_id LIMIT 10), l AS (SELECT CASE WHEN count(*) = 10 AND (SELECT count(*) FROM documents) >= 100 THEN greatest(max(doc_id), (SELECT max(doc_id) FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100))) END AS last FROM e)
SELECT doc_id, source FROM documents, l WHERE last IS NULL OR doc_id <= last"""
)
def bounded_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.bounded_prefix(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "source", 100, 10, 8)


@query(
    """SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '\\[\\*\\*.*?\\*\\*\\]', '', 'g'), '[ \\t\\n\\f\\r\\x0B]+', ' ', 'g'))) AS text_md5 FROM documents WHERE length(trim(regexp_replace(regexp_replace(text, '\\[\\*\\*.*?\\*\\*\\]', '', 'g'), '[ \\t\\n\\f\\r\\x0B]+', ' ', 'g'))) >= 30"""
)
def note_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = etl.notes(docs, "documents", {"note_id": F.col("doc_id").cast("string"), "text": F.col("text")})
    return made.select(F.col("note_id").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"))


@query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.keep_first(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", ["doc_id"])


@query(
    "WITH p AS (SELECT l_suppkey, list_filter(['1:' || l_returnflag, '2:' || l_linestatus], lambda x: x LIKE '%R' OR x LIKE '%F') AS h, l_orderkey, l_linenumber, l_partkey FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN len(h) > 0 THEN array_to_string(list_transform(h, lambda x: CASE x[1] WHEN '1' THEN 'returned' ELSE 'finished' END), ',') ELSE 'no_finding' END AS diagnosis FROM p"
)
def positive_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", F.lit("1.0")).alias("returned"), F.when(F.col("l_linestatus") == "F", F.lit("yes")).otherwise(F.lit("0")).alias("finished"))
    made = etl.positive_labels(wide.withColumn("key", F.struct("l_orderkey", "l_linenumber")), "key", ["returned", "finished"])
    return made.select("key.l_orderkey", "key.l_linenumber", "diagnosis")


@query(
    """WITH x AS (SELECT user_id % 10 AS target, event_type AS instrument, event_id / 1000.0 + 0.5 AS w, value AS d, value / 10 AS u FROM events), h AS (SELECT target, instrument, list(w ORDER BY w) AS w, list(d ORDER BY w) AS d, median(d) AS m, count(*) AS n FROM x GROUP BY ALL HAVING count(*) >= 3)
SELECT target, instrument, (row_number() OVER (PARTITION BY target ORDER BY instrument) - 1) AS step, n::INT AS points, round(list_sum(d), 2) AS total FROM h"""
)
def spectral_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("target"), F.col("event_type").alias("instrument"), (F.col("event_id") / 1000 + 0.5).cast("string").alias("w"), F.col("value").cast("string").alias("d"), (F.col("value") / 10).cast("string").alias("up"), (-F.col("value") / 10).cast("string").alias("low"))
    made = etl.observations(x, "target", "instrument", "w", "d", "up", "low")
    return made.select("target", "instrument", "step", F.size("depths").alias("points"), F.round(F.aggregate("depths", F.lit(0.0), lambda s, v: s + v * 1e6), 2).alias("total"))


def _spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = simulate.model_grid(spark, [800.0, 1000.0, 1200.0, 1400.0])
    params = grid.select(F.concat_ws("/", "T_eq", "log_H2O", "log_SO2").alias("model"), F.create_map(F.lit("T_eq"), F.col("T_eq"), F.lit("log_H2O"), F.col("log_H2O"), F.lit("log_SO2"), F.col("log_SO2")).alias("params"))
    return simulate.synthetic_spectra(params, "model", 0.8, 10.0, 60, 1e-4)


@query()
def spectrum_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector embeddings, chi-square against their own model and parameters of a grid of synthetic spectra."""
    from skein.plans.durable import durable

    made = durable(_spectra(spark, sf_dir), "spectra")
    model = spectra.forward_model(F.col("wavelengths"), F.col("params"))
    return made.select("model", spectra.detector_embedding(F.col("wavelengths"), F.col("depths"), 16).alias("embedding"), spectra.reduced_chi2(F.col("depths"), model, F.col("uncertainties")).alias("chi2"), spectra.parameter_vector(F.col("params")).alias("parameters"))


@query(
    "SELECT t.v AS \"T_eq\", w.v AS \"log_H2O\", s.v AS \"log_SO2\" FROM (VALUES (800.0::DOUBLE), (1000.0), (1200.0), (1400.0)) t(v), (VALUES (-4.0::DOUBLE), (-3.5), (-3.0)) w(v), (VALUES (-10.0::DOUBLE), (-5.5)) s(v)"
)
def model_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.model_grid(spark, [800.0, 1000.0, 1200.0, 1400.0])


@query()
def synthetic_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.synthetic_notes(spark, table(spark, sf_dir, "customer").count(), ["sepsis", "asthma", "stroke", "fracture"])


@query()
def note_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions over each customer's orders as notes, with priority as topic."""
    notes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("note_id"), F.col("o_orderpriority").alias("diagnosis"))
    return simulate.sessions(notes, "patient_id", "note_id", "diagnosis")


@query("SELECT conv_id, turn, (length(text) - length(replace(lower(text), 'ion', ''))) // 3 AS n_ion, (length(text) - length(replace(lower(text), 'the', ''))) // 3 AS n_the FROM conversations")
def substring_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", V.substring_count(low, "ion").alias("n_ion"), V.substring_count(low, "the").alias("n_the"))


@query(
    """WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]{2,}') AS tok FROM conversations), c AS (SELECT *, len(list_filter(tok, lambda x: x = 'the'))::DOUBLE AS a, len(list_filter(tok, lambda x: x = 'que'))::DOUBLE AS b, len(tok)::DOUBLE AS n FROM t)
SELECT conv_id, turn, round(CASE WHEN a > 0 THEN ln(1 + 1 / (a + 0.5)) * a * 2.5 / (a + 1.5 * (0.25 + 0.75 * n / 20)) ELSE 0 END + CASE WHEN b > 0 THEN ln(1 + 1 / (b + 0.5)) * b * 2.5 / (b + 1.5 * (0.25 + 0.75 * n / 20)) ELSE 0 END, 6) AS score FROM c"""
)
def keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = retrieval.terms_of(F.col("text"), "[a-z]{2,}")
    turns = table(spark, sf_dir, "conversations").withColumn("tok", tokens)
    return turns.select("conv_id", "turn", F.round(V.keyword_score("tok", ["the", "que"]), 6).alias("score"))


@query("SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user, list(turn ORDER BY turn)::VARCHAR AS turns FROM conversations GROUP BY 1")
def case_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.array_sort(F.collect_list("turn")).alias("t"))
    return held.select("conv_id", "n_turns", "n_user", F.concat(F.lit("["), F.array_join("t", ", "), F.lit("]")).alias("turns"))


@query()
def knn_by_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors within k-means cells, as symmetric weights."""
    return graph.symmetrised(graph.nearest_in_block(graph.cells(table(spark, sf_dir, "embeddings")), "cell", 10))


TERMS = "'water', 'carbon dioxide', 'sulfur dioxide', 'photochemistry', 'equilibrium', 'cloud', 'haze', 'transmission', 'emission', 'retrieval', 'atmosphere', 'exoplanet', 'jwst', 'miri', 'nirspec', 'niriss', 'nircam', 'wasp', 'trappist', 'temperature', 'metallicity', 'abundance', 'biosignature', 'habitability', 'rayleigh', 'scattering', 'nested sampling', 'bayesian', 'petitradtrans', 'poseidon', 'aurora', 'so2', 'co2', 'h2o', 'ch4', 'co', 'na', 'k', 'disequilibrium'"


@query(
    f"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), c AS (SELECT doc_id, list_transform([{TERMS}], lambda w: ((length(t) - length(replace(t, w, ''))) // length(w))::DOUBLE) || [(contains(t, 'so2') OR contains(t, 'sulfur dioxide'))::INT::DOUBLE, contains(t, 'photochem')::INT::DOUBLE] || list_transform(range(23), lambda x: 0.0::DOUBLE) AS v FROM d)
SELECT doc_id, list_transform(v, lambda x: round(x / (sqrt(list_dot_product(v, v)) + 1e-10), 6)) AS embedding FROM c"""
)
def literature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(encoders.literature(F.col("text")), lambda x: F.round(x, 6)).alias("embedding"))


@query(
    """SELECT 'CXR_' || (conv_id % 7) AS patient_id, 'CXR_' || conv_id AS note_id, 'radiology' AS note_type, 'radiology' AS specialty, -1 AS age, CASE WHEN conv_id % 2 = 0 THEN 'F' ELSE 'U' END AS gender, coalesce(l.diagnosis, 'cxr_unknown') AS primary_diagnosis, coalesce(l.diagnosis, 'cxr_unknown') AS diagnosis,
  coalesce(nullif(r.text, ''), 'MIMIC-CXR study ' || conv_id || ' for patient ' || (conv_id % 7) || '. View position ' || CASE WHEN conv_id % 5 = 0 THEN 'unknown' ELSE 'AP' END || '.') AS text, '' AS keywords
FROM (SELECT DISTINCT conv_id FROM conversations) s LEFT JOIN (SELECT conv_id, text FROM conversations WHERE turn = 0 AND conv_id % 3 > 0) r USING (conv_id) LEFT JOIN (SELECT doc_id AS conv_id, 'cxr_' || quality AS diagnosis FROM labels) l USING (conv_id)"""
)
def report_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as studies: two of three have a report, some a label."""
    talks = table(spark, sf_dir, "conversations")
    ids = talks.select("conv_id").distinct()
    studies = ids.select((F.col("conv_id") % 7).alias("subject_id"), F.col("conv_id").alias("study_id"), F.when(F.col("conv_id") % 5 != 0, F.lit("AP")).alias("view"), F.when(F.col("conv_id") % 2 == 0, F.lit("F")).otherwise(F.lit("")).alias("gender"))
    reports = talks.where("turn = 0 and conv_id % 3 > 0").select(F.col("conv_id").alias("study_id"), "text")
    named = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("study_id"), F.concat(F.lit("cxr_"), F.col("quality").cast("string")).alias("diagnosis"))
    return etl.report_notes(studies, reports, named)


@query("SELECT o_custkey, list_sort(list(o_orderkey)) AS sessions, count(*) AS n, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY 1")
def subject_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.subject_groups(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderpriority", "o_orderkey")


@query(
    """WITH q AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS query_index, text AS query_text, CASE WHEN turn % 3 = 0 THEN 'unknown' ELSE (conv_id * 10 + turn)::VARCHAR END AS target_note_id FROM conversations WHERE role = 'user')
SELECT conv_id, query_index, query_text, target_note_id, coalesce(substr(d.text, 1, 200), '') AS target_text_preview FROM q LEFT JOIN documents d ON d.doc_id::VARCHAR = q.target_note_id"""
)
def retrieval_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").where("role = 'user'")
    target = F.when(F.col("turn") % 3 != 0, (F.col("conv_id") * 10 + F.col("turn")).cast("string"))
    asked = F.array_sort(F.collect_list(F.struct("turn", "text", target.alias("target_note_id"))))
    return etl.retrieval_log(talks.groupBy("conv_id").agg(asked.alias("queries")), table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("note_id"), "text"), "conv_id")


@query()
def manifold_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label as a session's latents: curvature of the last six and the history's weights."""
    latents = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.slice("embedding", 1, 10).alias("latent"))
    return retrieval.manifold_gates(latents, "label", "vec_id", "latent").select("label", "vec_id", F.round("curvature", 9).alias("curvature"), "history_weights")
