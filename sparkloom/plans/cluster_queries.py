"""Queries of clustering, recommendation, image sets, sources and streams."""

from __future__ import annotations


from pyspark.sql import functions as F

from sparkloom.functions import columns as C
from sparkloom.operators import cluster, recommend, stats
from sparkloom.plans.registry import query, table
from sparkloom.sources import tables


def points(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")


E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"
DIST = "sqrt(list_sum(list_transform(range(1, len({0}) + 1), lambda i: ({0}[i] - {1}[i]) ** 2)))"


@query(f"WITH {E} SELECT a.vec_id, b.vec_id AS center, round({DIST.format('a.x', 'b.x')}, 6) AS d FROM e a, e b WHERE b.vec_id < 5")
def clu_distance(spark, d):
    e = points(spark, d)
    centers = e.filter("vec_id < 5").select(F.col("vec_id").alias("center"), F.col("x").alias("c"))
    return e.join(F.broadcast(centers)).select("vec_id", "center", F.round(cluster.distance(F.col("x"), F.col("c")), 6).alias("d"))


ASSIGN = f"SELECT vec_id, label, x, arg_min(c, (round(dd, 12), c)) AS g FROM (SELECT a.vec_id, a.label, a.x, b.vec_id AS c, {DIST.format('a.x', 'b.x')} AS dd FROM e a, e b WHERE b.vec_id < 5) GROUP BY ALL"


def assigned(spark, d):
    e = points(spark, d)
    model = cluster.KMeans(5, "first", steps=0).fit(e, "vec_id", "x")
    return model.transform(e, "x", "g"), model


@query(f"WITH {E} SELECT vec_id, g::INTEGER AS g FROM ({ASSIGN})")
def clu_assign(spark, d):
    return assigned(spark, d)[0].select("vec_id", "g")


@query(f"WITH {E}, s AS ({ASSIGN}), u AS (SELECT g, unnest(range(0, 64)) AS i, unnest(x) AS v FROM s) SELECT g::INTEGER AS g, i::INTEGER AS i, round(avg(v), 6) AS m FROM u GROUP BY ALL")
def clu_update(spark, d):
    centers = cluster.centers_of(assigned(spark, d)[0], "x", "g")
    return spark.createDataFrame([(g, i, round(v, 6)) for g, c in centers.items() for i, v in enumerate(c)], "g int, i int, m double")


def _lloyd(rounds: int) -> str:
    parts = ["c0 AS (SELECT vec_id AS g, x AS c FROM e WHERE vec_id < 5)"]
    for r in range(rounds):
        parts.append(f"s{r} AS (SELECT vec_id, x, arg_min(g, (round(dd, 12), g)) AS g FROM (SELECT vec_id, x, g, {DIST.format('x', 'c')} AS dd FROM e, c{r}) GROUP BY ALL)")
        parts.append(f"c{r + 1} AS (SELECT g, list(m ORDER BY i) AS c FROM (SELECT g, i, avg(v) AS m FROM (SELECT g, unnest(range(0, 64)) AS i, unnest(x) AS v FROM s{r}) GROUP BY ALL) GROUP BY 1)")
    return ", ".join(parts)


@query(f"WITH {E}, {_lloyd(3)} SELECT g::INTEGER AS g, count(*) AS n FROM (SELECT vec_id, arg_min(g, (round(dd, 12), g)) AS g FROM (SELECT vec_id, g, {DIST.format('x', 'c')} AS dd FROM e, c3) GROUP BY 1) GROUP BY 1")
def clu_lloyd3(spark, d):
    e = points(spark, d)
    return cluster.KMeans(5, "first", steps=3).fit(e, "vec_id", "x").transform(e, "x", "g").groupBy("g").agg(F.count("*").alias("n"))


@query()
def clu_kmeans_plus(spark, d):
    e = points(spark, d)
    return cluster.KMeans(4, "plus", steps=5, seed=1).fit(e, "vec_id", "x").transform(e, "x", "g").groupBy("g").agg(F.count("*").alias("n"))


@query(f"WITH {E}, s AS ({ASSIGN}), p AS (SELECT count(*) FILTER (a.label = b.label AND a.g = b.g) AS two, count(*) FILTER (a.label = b.label OR a.g = b.g) AS one FROM s a, s b WHERE a.vec_id < b.vec_id) SELECT round(two / one, 8) AS jaccard FROM p")
def clu_jaccard(spark, d):
    return stats.jaccard(assigned(spark, d)[0], "label", "g").select(F.round("jaccard", 8).alias("jaccard"))


PAIR = f"p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS ga, b.label AS gb, {DIST.format('a.x', 'b.x')} AS d FROM e a, e b WHERE a.vec_id <> b.vec_id)"
CENTERS = "c AS (SELECT label AS g, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(range(0, 64)) AS i, unnest(x) AS v FROM e) GROUP BY ALL) GROUP BY 1)"


@query(f"WITH {E}, {CENTERS}, s AS (SELECT g, c, avg({DIST.format('x', 'c')}) AS r FROM e JOIN c ON g = label GROUP BY ALL) SELECT round(avg(m), 6) AS dbi FROM (SELECT a.g, max((a.r + b.r) / {DIST.format('a.c', 'b.c')}) AS m FROM s a, s b WHERE a.g <> b.g GROUP BY 1)")
def clu_dbi(spark, d):
    return cluster.davies_bouldin(points(spark, d), "x", "label").select(F.round("dbi", 6).alias("dbi"))


@query(f"WITH {E}, {PAIR} SELECT round(min(d) FILTER (ga <> gb) / max(d) FILTER (ga = gb), 6) AS dunn FROM p")
def clu_dunn(spark, d):
    return cluster.dunn(points(spark, d), "vec_id", "x", "label").select(F.round("dunn", 6).alias("dunn"))


@query(f"WITH {E}, {PAIR}, m AS (SELECT a, ga, gb, avg(d) AS d FROM p GROUP BY ALL), s AS (SELECT a, max(d) FILTER (ga = gb) AS i, min(d) FILTER (ga <> gb) AS o FROM m GROUP BY 1) SELECT a AS vec_id, round((o - i) / greatest(i, o), 6) AS silhouette FROM s")
def clu_silhouette(spark, d):
    return cluster.silhouette(points(spark, d), "vec_id", "x", "label").select("vec_id", F.round("silhouette", 6).alias("silhouette"))


@query(f"WITH {E}, {PAIR}, {CENTERS} SELECT (SELECT round(avg(d), 6) FROM (SELECT avg(d) AS d FROM p WHERE ga = gb GROUP BY ga)) AS compactness, (SELECT round(avg({DIST.format('a.c', 'b.c')}), 6) FROM c a, c b WHERE a.g < b.g) AS separation")
def clu_compact_separation(spark, d):
    return cluster.compactness(points(spark, d), "vec_id", "x", "label").select(F.round("compactness", 6).alias("compactness"), F.round("separation", 6).alias("separation"))


@query(f"WITH {E}, {PAIR} SELECT vec_id, coalesce(n, 0) AS n, coalesce(n, 0) >= 2 AS core FROM e LEFT JOIN (SELECT a, count(*) AS n FROM p WHERE d <= 1.15 GROUP BY 1) ON a = vec_id")
def clu_dbscan_core_counts(spark, d):
    return cluster.DBSCAN(1.15, 2).cores(points(spark, d), "vec_id", "x").select("vec_id", F.col("n").cast("long").alias("n"), "core")


@query(f"""WITH RECURSIVE {E}, {PAIR}, near AS (SELECT * FROM p WHERE d <= 1.15), core AS (SELECT a FROM near GROUP BY 1 HAVING count(*) >= 2),
link AS (SELECT n.a, n.b FROM near n JOIN core x ON x.a = n.a JOIN core y ON y.a = n.b), r AS (SELECT a, a AS c FROM core UNION SELECT link.a, r.c FROM r JOIN link ON link.b = r.a), lab AS (SELECT a, min(c) AS c FROM r GROUP BY 1),
border AS (SELECT n.a, arg_min(lab.c, (n.d, n.b)) AS c FROM near n JOIN lab ON lab.a = n.b GROUP BY 1)
SELECT vec_id, coalesce(lab.c, border.c, -1) AS prediction FROM e LEFT JOIN lab ON lab.a = vec_id LEFT JOIN border ON border.a = vec_id""")
def clu_dbscan(spark, d):
    return cluster.DBSCAN(1.15, 2).fit_predict(points(spark, d), "vec_id", "x").select("vec_id", "prediction")


@query(f"WITH {E}, {PAIR}, l AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN -1 ELSE vec_id % 3 END AS g FROM e) SELECT a AS vec_id, arg_min(y.g, (d, b)) AS prediction FROM p JOIN l x ON x.vec_id = a AND x.g = -1 JOIN l y ON y.vec_id = b AND y.g <> -1 GROUP BY 1 UNION ALL SELECT vec_id, g FROM l WHERE g <> -1")
def clu_outlier_nearest(spark, d):
    e = points(spark, d)
    labelled = e.select("vec_id", F.when(F.col("vec_id") % 3 == 0, F.lit(-1)).otherwise(F.col("vec_id") % 3).cast("long").alias("prediction"))
    return cluster.DBSCAN(1.0).noise_to_nearest(e, labelled, "vec_id", "x")


@query()
def clu_agglomerative(spark, d):
    e = points(spark, d)
    means = e.select((F.col("vec_id") % 40).alias("k"), F.posexplode("x").alias("i", "v")).groupBy("k", "i").agg(F.avg("v").alias("m")).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("c")).select("k", F.col("c.m").alias("x"))
    return cluster.Agglomerative(5).fit_predict(means, "k", "x").groupBy("prediction").agg(F.count("*").alias("n"))


@query("SELECT 5 AS clusters, count(*) AS n FROM embeddings")
def clu_agglomerative_rows(spark, d):
    """Over all rows: how many clusters there are and how many rows they hold."""
    return cluster.Agglomerative(5).fit_predict(points(spark, d), "vec_id", "x").agg(F.countDistinct("prediction").cast("int").alias("clusters"), F.count("*").alias("n"))


# recommendation: customers rate brands by how often they buy them, 5 at most

R = "r AS (SELECT o_custkey AS u, p_brand AS i, least(count(*), 5)::DOUBLE AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL)"


def ratings(spark, d):
    li, o, p = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "part")
    bought = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return bought.groupBy(F.col("o_custkey").alias("user"), F.col("p_brand").alias("item")).agg(F.least(F.count("*"), F.lit(5)).cast("double").alias("rating"))


SIM = f"{R}, n AS (SELECT i, sum(v * v) AS n FROM r GROUP BY 1), t AS (SELECT a.i AS x, b.i AS y, sum(a.v * b.v) AS dot FROM r a JOIN r b ON a.u = b.u AND a.i <> b.i GROUP BY ALL), s AS (SELECT x, y, dot / sqrt(nx.n * ny.n) AS s, 1 / (1 + sqrt(greatest(0, nx.n + ny.n - 2 * dot))) AS ds FROM t JOIN n nx ON nx.i = x JOIN n ny ON ny.i = y)"


@query(f"WITH {SIM} SELECT x, y, round(s, 6) AS s FROM s")
def rec_similarity_cosine(spark, d):
    return recommend.similarities(ratings(spark, d), "item", "user").select("x", "y", F.round("s", 6).alias("s"))


@query(f"WITH {SIM} SELECT x, y, round(ds, 6) AS s FROM s")
def rec_similarity_distance(spark, d):
    return recommend.similarities(ratings(spark, d), "item", "user", "distance").select("x", "y", F.round("s", 6).alias("s"))


NEAR = f"{SIM}, k AS (SELECT x, y, s, row_number() OVER (PARTITION BY x ORDER BY round(s, 10) DESC, y) AS rank FROM s), near AS (SELECT * FROM k WHERE rank <= 5)"


@query(f"WITH {NEAR} SELECT x, y, rank::INTEGER AS rank FROM near")
def rec_item_topn(spark, d):
    return recommend.top(recommend.similarities(ratings(spark, d), "item", "user"), 5).select("x", "y", "rank")


ITEM = f"{NEAR}, w AS (SELECT y, sum(s) AS t FROM near GROUP BY 1), f AS (SELECT r.u AS user, near.y AS item, sum(s * v) / max(t) AS score FROM near JOIN r ON r.i = near.x JOIN w ON w.y = near.y GROUP BY ALL), g AS (SELECT f.* FROM f ANTI JOIN r ON r.u = f.user AND r.i = f.item)"


@query(f'WITH {ITEM} SELECT "user", item, round(score, 6) AS score FROM g')
def rec_item_cf(spark, d):
    return recommend.item_cf(ratings(spark, d), 5).select("user", "item", F.round("score", 6).alias("score"))


@query(f'WITH {ITEM} SELECT "user", item, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY round(score, 10) DESC, item) AS rank FROM g WHERE score > 0) WHERE rank <= 3')
def rec_list(spark, d):
    return recommend.recommend(recommend.item_cf(ratings(spark, d), 5), 3).select("user", "item", "rank")


@query(f"""WITH {R}, n AS (SELECT u, sum(v * v) AS n FROM r GROUP BY 1), t AS (SELECT a.u AS x, b.u AS y, sum(a.v * b.v) AS dot FROM r a JOIN r b ON a.i = b.i AND a.u <> b.u GROUP BY ALL),
s AS (SELECT x, y, dot / sqrt(nx.n * ny.n) AS s FROM t JOIN n nx ON nx.u = x JOIN n ny ON ny.u = y), k AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY round(s, 10) DESC, y) AS rank FROM s WHERE round(s, 10) < 1), near AS (SELECT * FROM k WHERE rank <= 10),
w AS (SELECT x, sum(s) AS t FROM near GROUP BY 1), f AS (SELECT near.x AS user, r.i AS item, sum(s * v) / max(t) AS score FROM near JOIN r ON r.u = near.y JOIN w ON w.x = near.x GROUP BY ALL)
SELECT "user", item, round(score, 6) AS score FROM f ANTI JOIN r ON r.u = f.user AND r.i = f.item""")
def rec_user_cf(spark, d):
    return recommend.user_cf(ratings(spark, d), 10).select("user", "item", F.round("score", 6).alias("score"))


#: Suppliers as users that the ratings don't know: how often they delivered a brand, 5 at most.
R0 = "q AS (SELECT l_suppkey AS u, p_brand AS i, least(count(*), 5)::DOUBLE AS v FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey % 10 = 0 GROUP BY ALL)"


def unseen(spark, d):
    li, p = table(spark, d, "lineitem").filter("l_orderkey % 10 = 0"), table(spark, d, "part")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("user"), F.col("p_brand").alias("item")).agg(F.least(F.count("*"), F.lit(5)).cast("double").alias("rating"))


@query(f"""WITH {NEAR}, {R0}, w AS (SELECT y, sum(s) AS t FROM near GROUP BY 1), f AS (SELECT q.u AS user, near.y AS item, sum(s * v) / max(t) AS score FROM near JOIN q ON q.i = near.x JOIN w ON w.y = near.y GROUP BY ALL)
SELECT "user", item, round(score, 6) AS score FROM f ANTI JOIN q ON q.u = f.user AND q.i = f.item""")
def rec_item_fold_in(spark, d):
    return recommend.item_cf(ratings(spark, d), 5, queries=unseen(spark, d)).select("user", "item", F.round("score", 6).alias("score"))


@query(f"""WITH {R}, {R0}, n AS (SELECT u, sum(v * v) AS n FROM r GROUP BY 1), m AS (SELECT u, sum(v * v) AS n FROM q GROUP BY 1), t AS (SELECT a.u AS x, b.u AS y, sum(a.v * b.v) AS dot FROM q a JOIN r b ON a.i = b.i GROUP BY ALL),
s AS (SELECT m.u AS x, n.u AS y, 1 / (1 + sqrt(greatest(0, m.n + n.n - 2 * coalesce(dot, 0)))) AS s FROM m CROSS JOIN n LEFT JOIN t ON t.x = m.u AND t.y = n.u), k AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY round(s, 10) DESC, y) AS rank FROM s WHERE round(s, 10) < 1), near AS (SELECT * FROM k WHERE rank <= 10),
w AS (SELECT x, sum(s) AS t FROM near GROUP BY 1), f AS (SELECT near.x AS user, r.i AS item, sum(s * v) / max(t) AS score FROM near JOIN r ON r.u = near.y JOIN w ON w.x = near.x GROUP BY ALL)
SELECT "user", item, round(score, 6) AS score FROM f ANTI JOIN q ON q.u = f.user AND q.i = f.item""")
def rec_user_fold_in(spark, d):
    return recommend.user_cf(ratings(spark, d), 10, "distance", unseen(spark, d)).select("user", "item", F.round("score", 6).alias("score"))


# images, sources, streams

@query("SELECT p_partkey, (11 * (p_size * 5) + 16 * (p_partkey % 256) + 5 * 100) / 32 AS gray FROM part")
def img_gray(spark, d):
    pixel = F.array(F.col("p_size") * 5, F.col("p_partkey") % 256, F.lit(100))
    return table(spark, d, "part").select("p_partkey", C.gray(pixel).alias("gray"))


@query("SELECT p_partkey, p_size, p_retailprice FROM part")
def io_whitespace(spark, d):
    """Parts as lines with white space of all kinds around their numbers, read again."""
    lines = table(spark, d, "part").select(F.concat(F.lit("  "), F.concat_ws("\t\t", "p_partkey", F.concat_ws(" \t ", "p_size", "p_retailprice"))).alias("value"))
    return tables.split_whitespace(lines, "p_partkey long, p_size int, p_retailprice double")


@query("SELECT * FROM (VALUES ('r_regionkey', 'int', true), ('r_name', 'string', true)) AS t(name, type, nullable)")
def io_catalog(spark, d):
    table(spark, d, "region").createOrReplaceTempView("catalog_region")
    return tables.columns(spark, "catalog_region")


@query("SELECT CASE WHEN value <= 50 THEN 'low' ELSE 'high' END AS prediction, count(*) AS n FROM events GROUP BY 1")
def stream_scores(spark, d):
    """A fixed tree over events as a stream: windows by event time, in append mode to memory."""
    from sparkloom.operators.tree import Node, TreeModel
    from sparkloom.streaming.scoring import score_stream

    model = TreeModel([Node(0, 0, -1, 2, (1.0, 1.0), childs=[1, 2]), Node(1, 1, 0, 1, (1.0, 0.0), "value", "<=", 50.0), Node(2, 1, 0, 1, (0.0, 1.0), "value", ">", 50.0)], ["low", "high"], "gini")
    static = table(spark, d, "events")
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    running = score_stream(stream, model).groupBy("prediction").agg(F.count("*").alias("n")).writeStream.outputMode("complete").format("memory").queryName("stream_scores").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table("stream_scores")
