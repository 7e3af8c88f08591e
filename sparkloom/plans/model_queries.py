"""Queries of ensembles, regression, naive Bayes, support vector machines, perceptrons and isolation forests."""

from __future__ import annotations


import numpy as np
from pyspark.sql import functions as F

from sparkloom.functions import columns as C
from sparkloom.operators import ensemble, isolation, linear, mesh, mlp, svm
from sparkloom.operators.bayes import NaiveBayes
from sparkloom.operators.optimizers import NAMES, Optimizer, minimise
from sparkloom.plans.registry import query, table
from sparkloom.plans.tree_queries import KIND, lines

EVENTS = "SELECT event_id, value, user_id % 100 AS u, CASE WHEN value > 50 THEN 'hi' ELSE 'lo' END AS y FROM events"


def events(spark, d):
    return table(spark, d, "events").select("event_id", "value", (F.col("user_id") % 100).cast("double").alias("u"), F.expr("CASE WHEN (value > 50) <> (xxhash64(event_id) % 10 = 0) THEN 'hi' ELSE 'lo' END").alias("y"))


FEATURES = ["value", "u"]


@query()
def forest_fit_predict(spark, d):
    rows = events(spark, d)
    model = ensemble.RandomForest(5, depth_max=3, max_bins=32, seed=7).fit(rows, FEATURES, "y", "event_id")
    return model.transform(rows).groupBy("y", "prediction").agg(F.count("*").alias("n"))


@query()
def forest_oob(spark, d):
    rows = events(spark, d)
    return ensemble.RandomForest(5, depth_max=3, max_bins=32, seed=7).fit(rows, FEATURES, "y", "event_id").out_of_bag(rows, "y")


@query()
def forest_select(spark, d):
    rows = events(spark, d)
    train, test = rows.filter("event_id % 4 > 0"), rows.filter("event_id % 4 = 0")
    model = ensemble.RandomForest(5, depth_max=3, max_bins=32, seed=7).fit(train, FEATURES, "y", "event_id")
    chosen = [("oob", ensemble.select_by_oob(model, train, test, "y")), ("random", ensemble.select_at_random(model, test, "y", 3))]
    return spark.createDataFrame([(n, m.numbers, float(ensemble.score(m, test, "y"))) for n, m in chosen], "method string, units array<int>, score double")


STUMP = "CASE WHEN l_quantity <= 25 THEN 'c' ELSE 'a' END"


@query(f"""WITH e AS (SELECT avg((kind <> p)::INTEGER) AS e FROM (SELECT {KIND} AS kind, {STUMP} AS p FROM lineitem)) SELECT round(e, 8) AS error, round(ln((1 - e) / e) + ln(2.0), 6) AS alpha FROM e""")
def ada_error_alpha(spark, d):
    row = lines(spark, d).agg(F.avg(ensemble.row_error(F.col("kind"), F.expr(STUMP))).alias("e")).first()
    return spark.createDataFrame([(round(row.e, 8), round(ensemble.unit_weight(row.e, 1.0, 3), 6))], "error double, alpha double")


@query(f"""WITH x AS (SELECT ({KIND} <> {STUMP})::INTEGER AS wrong FROM lineitem), e AS (SELECT avg(wrong) AS e, count(*) AS n FROM x), a AS (SELECT ln((1 - e) / e) + ln(2.0) AS alpha, n FROM e),
w AS (SELECT wrong, count(*) AS n, sum(exp(alpha * wrong)) AS w FROM x, a GROUP BY 1) SELECT wrong::INTEGER AS wrong, n, round(w / sum(w) OVER (), 6) AS share FROM w""")
def ada_weights_round1(spark, d):
    x = lines(spark, d).select(ensemble.row_error(F.col("kind"), F.expr(STUMP)).alias("wrong"))
    alpha = ensemble.unit_weight(x.agg(F.avg("wrong")).first()[0], 1.0, 3)
    w = x.groupBy(F.col("wrong").cast("int").alias("wrong")).agg(F.count("*").alias("n"), F.sum(ensemble.reweighted(F.lit(1.0), alpha, F.col("wrong"))).alias("w"))
    return w.join(F.broadcast(w.agg(F.sum("w").alias("t")))).select("wrong", "n", F.round(F.col("w") / F.col("t"), 6).alias("share"))


def _stumps_sql(rounds: int) -> str:
    """Stumps on quantity and discount by weighted gini, each on the rows as the ones before have weighted them."""
    names, out = "abc", [f"r0 AS (SELECT {KIND} AS kind, l_quantity AS q, l_discount AS d, 1.0::DOUBLE AS w FROM lineitem)"]
    best = lambda side: "CASE " + " ".join(f"WHEN {c}{side} >= greatest({', '.join(x + side for x in names)}) THEN '{c}'" for c in names) + " END"
    gini = lambda side, n: f"{n} * (1 - {' - '.join(f'({c}{side} / {n}) ** 2' for c in names)})"
    for r in range(rounds):
        sums = ", ".join(f"sum(CASE WHEN kind = '{c}' THEN w ELSE 0.0 END) AS {c}" for c in names)
        out.append(f"v{r} AS (SELECT f, v, {sums} FROM (SELECT kind, w, unnest(['q', 'd']) AS f, unnest([q, d]) AS v FROM r{r}) GROUP BY f, v)")
        out.append(f"s{r} AS (SELECT f, v, lead(v) OVER o AS nxt, {', '.join(f'sum({c}) OVER o AS {c}l, sum({c}) OVER t - sum({c}) OVER o AS {c}r' for c in names)} FROM v{r} WINDOW o AS (PARTITION BY f ORDER BY v), t AS (PARTITION BY f))")
        out.append(f"z{r} AS (SELECT *, al + bl + cl AS nl, ar + br + cr AS nr FROM s{r} WHERE nxt IS NOT NULL)")
        out.append(f"b{r} AS (SELECT *, (v + nxt) / 2 AS cut, {best('l')} AS pl, {best('r')} AS pr FROM z{r} ORDER BY round(({gini('l', 'nl')} + {gini('r', 'nr')}) / (nl + nr), 10), f DESC, v LIMIT 1)")
        out.append(f"p{r} AS (SELECT x.*, (CASE WHEN f = 'q' THEN x.q ELSE x.d END) <= cut AS lower, kind <> CASE WHEN (CASE WHEN f = 'q' THEN x.q ELSE x.d END) <= cut THEN pl ELSE pr END AS wrong FROM r{r} x, b{r})")
        out.append(f"e{r} AS (SELECT ln((1 - e) / e) + ln(2.0) AS alpha, n / t AS again FROM (SELECT sum(w * wrong::INTEGER) / sum(w) AS e, count(*) AS n, sum(w) AS t FROM p{r}))")
        out.append(f"r{r + 1} AS (SELECT kind, q, d, w * exp(alpha * wrong::INTEGER) * again AS w FROM p{r}, e{r})")
    side = lambda r: f"(CASE WHEN b{r}.f = 'q' THEN x.q ELSE x.d END) <= b{r}.cut"
    score = lambda c: " + ".join(f"e{r}.alpha * CASE WHEN {side(r)} THEN b{r}.{c}l / b{r}.nl ELSE b{r}.{c}r / b{r}.nr END" for r in range(rounds))
    models = ", ".join(f"b{r}, e{r}" for r in range(rounds))
    return f"""WITH {', '.join(out)}, y AS (SELECT kind, {', '.join(f'{score(c)} AS {c}' for c in names)} FROM r0 x, {models})
SELECT kind, CASE WHEN a >= greatest(a, b, c) THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS prediction, count(*) AS n FROM y GROUP BY 1, 2"""


@query(_stumps_sql(3))
def ada_fit_predict(spark, d):
    rows = lines(spark, d)
    model = ensemble.AdaBoost(3).fit(rows, ["l_quantity", "l_discount"], "kind")
    return model.transform(rows).groupBy("kind", "prediction").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT l_quantity / 10 AS y, CASE WHEN l_quantity <= 25 THEN 1.0 ELSE 4.0 END AS f FROM lineitem) SELECT round(avg(y - f), 6) AS residual, round(avg((y - f) ** 2) / 2, 6) AS cost FROM x""")
def gbdt_residual_round1(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_quantity") / 10).alias("y"), F.when(F.col("l_quantity") <= 25, 1.0).otherwise(4.0).alias("f"))
    return x.agg(F.round(F.avg(F.col("y") - F.col("f")), 6).alias("residual"), F.round(F.avg((F.col("y") - F.col("f")) ** 2) / 2, 6).alias("cost"))


@query("""WITH x AS (SELECT l_quantity / 10 AS r, CASE WHEN l_quantity <= 25 THEN 1.0 ELSE 4.0 END AS p FROM lineitem) SELECT round(sum(r * p) / sum(p * p), 6) AS gamma FROM x""")
def gbdt_line_search(spark, d):
    row = table(spark, d, "lineitem").select((F.col("l_quantity") / 10).alias("r"), F.when(F.col("l_quantity") <= 25, 1.0).otherwise(4.0).alias("p")).agg(F.sum(F.col("r") * F.col("p")), F.sum(F.col("p") * F.col("p"))).first()
    return spark.createDataFrame([(round(ensemble.line_search(*row), 6),)], "gamma double")


@query()
def gbdt_fit_predict(spark, d):
    rows = lines(spark, d)
    model = ensemble.GradientBoosting(2, depth_max=2).fit(rows, ["l_quantity", "l_discount"], "kind")
    return model.transform(rows).groupBy("kind", "prediction").agg(F.count("*").alias("n"))


@query()
def gbdt_regression(spark, d):
    rows = table(spark, d, "lineitem").select("l_quantity", "l_discount", (F.col("l_quantity") * 2 - F.col("l_discount") * 100).alias("y"))
    model = ensemble.GradientBoosting(3, regression=True, depth_max=2).fit(rows, ["l_quantity", "l_discount"], "y")
    return model.transform(rows).agg(F.round(1 - F.sum((F.col("y") - F.col("prediction")) ** 2) / (F.var_pop("y") * F.count("y")), 4).alias("r2"))


@query("""WITH x AS (SELECT CASE WHEN l_quantity > 25 THEN 10.0 ELSE 0.0 END + CASE WHEN l_discount > 0.05 THEN 3.0 ELSE 0.0 END AS y, l_quantity > 25 AS q, l_discount > 0.05 AS t FROM lineitem),
f AS (SELECT *, avg(y) OVER (PARTITION BY q) AS f1 FROM x), g AS (SELECT *, avg(y - f1) OVER (PARTITION BY t) AS p2 FROM f), w AS (SELECT sum((y - f1) * p2) / sum(p2 * p2) AS w FROM g)
SELECT round(f1 + w * p2, 6) AS prediction, count(*) AS n FROM g, w GROUP BY 1""")
def gbdt_two_stumps(spark, d):
    """Two rounds of boosted stumps on a target that is a sum of two steps."""
    rows = table(spark, d, "lineitem").withColumn("y", F.expr("CASE WHEN l_quantity > 25 THEN 10.0D ELSE 0.0D END + CASE WHEN l_discount > 0.05 THEN 3.0D ELSE 0.0D END"))
    model = ensemble.GradientBoosting(2, regression=True, depth_max=1).fit(rows, ["l_quantity", "l_discount"], "y")
    return model.transform(rows).groupBy(F.round("prediction", 6).alias("prediction")).agg(F.count("*").alias("n"))


# regression

XY = ["l_quantity", "l_discount"]


@query("""SELECT unnest(['n', 'x1', 'x2', 'x1x1', 'x1x2', 'x2x2', 'y', 'x1y', 'x2y']) AS name, unnest([round(count(*)::DOUBLE, 4), round(sum(a), 4), round(sum(b), 4), round(sum(a * a), 4), round(sum(a * b), 4), round(sum(b * b), 4), round(sum(y), 4), round(sum(a * y), 4), round(sum(b * y), 4)]) AS value FROM (SELECT l_quantity AS a, l_discount AS b, l_tax AS y FROM lineitem)""")
def lin_moments(spark, d):
    a, b = linear.moments(table(spark, d, "lineitem"), XY, "l_tax")
    values = [a[0, 0], a[0, 1], a[0, 2], a[1, 1], a[1, 2], a[2, 2], *b]
    return spark.createDataFrame([(n, round(float(v), 4)) for n, v in zip(("n", "x1", "x2", "x1x1", "x1x2", "x2x2", "y", "x1y", "x2y"), values, strict=True)], "name string, value double")


@query("""SELECT 'x0' AS feature, round(regr_intercept(l_extendedprice, l_quantity), 4) AS theta FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem""")
def lin_normal_equation(spark, d):
    return linear.LinearRegression().fit(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice").to_df(spark).select("feature", F.round("theta", 4).alias("theta"))


@query("""WITH m AS (SELECT count(*) + 5.0 AS a, sum(l_quantity) AS b, sum(l_quantity * l_quantity) + 5.0 AS c, sum(l_extendedprice) AS u, sum(l_quantity * l_extendedprice) AS v FROM lineitem)
SELECT 'x0' AS feature, round((u * c - b * v) / (a * c - b * b), 4) AS theta FROM m UNION ALL SELECT 'l_quantity', round((a * v - b * u) / (a * c - b * b), 4) FROM m""")
def lin_ridge(spark, d):
    return linear.LinearRegression(l2=5.0).fit(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice").to_df(spark).select("feature", F.round("theta", 4).alias("theta"))


SCALED = "(SELECT p_size / 50.0 AS x, p_retailprice / 1000.0 AS y FROM part)"


def scaled(spark, d):
    return table(spark, d, "part").select((F.col("p_size") / 50.0).alias("x"), (F.col("p_retailprice") / 1000.0).alias("y"))


@query(f"""WITH RECURSIVE m AS (SELECT count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy FROM {SCALED}),
g AS (SELECT 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL SELECT i + 1, a - 0.5 * (n * a + sx * b - sy) / n, b - 0.5 * (sx * a + sxx * b - sxy) / n FROM g, m WHERE i < 5)
SELECT round(a, 6) AS theta0, round(b, 6) AS theta1 FROM g WHERE i = 5""")
def lin_gd_steps(spark, d):
    model = linear.LinearRegression("sgd", optimizer=Optimizer("sgd", 0.5), steps=5).fit(scaled(spark, d), ["x"], "y")
    return spark.createDataFrame([tuple(round(float(t), 6) for t in model.theta)], "theta0 double, theta1 double")


def half_labelled(spark, d):
    return scaled(spark, d).withColumn("y", F.when(F.col("y") > 0.95, "hi").otherwise("lo"))


@query()
def log_fit_ovr(spark, d):
    rows = lines(spark, d).select((F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("t"), "kind")
    model = linear.LogisticRegression("ovr", optimizer=Optimizer("adam", 0.5), steps=15).fit(rows, ["q", "t"], "kind")
    return model.transform(rows).groupBy("kind", "prediction").agg(F.count("*").alias("n"))


@query()
def log_fit_ovo(spark, d):
    rows = lines(spark, d).select((F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("t"), "kind")
    model = linear.LogisticRegression("ovo", optimizer=Optimizer("adam", 0.5), steps=15).fit(rows, ["q", "t"], "kind")
    return model.transform(rows).groupBy("kind", "prediction").agg(F.count("*").alias("n"))


@query(f"""WITH g0 AS (SELECT avg(0.5 - y) AS a, avg((0.5 - y) * x) AS b FROM (SELECT x, CASE WHEN y > 0.95 THEN 0.0 ELSE 1.0 END AS y FROM {SCALED})),
t1 AS (SELECT -0.5 * a AS a, -0.5 * b AS b FROM g0),
g1 AS (SELECT avg(1 / (1 + exp(-(a + b * x))) - y) AS ga, avg((1 / (1 + exp(-(a + b * x))) - y) * x) AS gb FROM t1, (SELECT x, CASE WHEN y > 0.95 THEN 0.0 ELSE 1.0 END AS y FROM {SCALED}))
SELECT round(a - 0.5 * ga, 6) AS theta0, round(b - 0.5 * gb, 6) AS theta1 FROM t1, g1""")
def log_gd_steps(spark, d):
    model = linear.LogisticRegression("ovr", optimizer=Optimizer("sgd", 0.5), steps=2).fit(half_labelled(spark, d), ["x"], "y")
    return spark.createDataFrame([tuple(round(float(t), 6) for t in model.theta[0])], "theta0 double, theta1 double")


THETA = np.array([[0.5, -1.0], [-0.25, 0.75], [0.1, 0.2]])
SIG = "1 / (1 + exp(-({} + {} * x)))"
P = [SIG.format(*t) for t in THETA]


def fixed_logistic(mode):
    return linear.LogisticModel(["x"], ["a", "b", "c"], mode, [(0, 1), (0, 2), (1, 2)] if mode == "ovo" else [], THETA)


@query(f"SELECT x, round(p1 / (p1 + p2 + p3), 6) AS a, round(p2 / (p1 + p2 + p3), 6) AS b, round(p3 / (p1 + p2 + p3), 6) AS c FROM (SELECT x, {P[0]} AS p1, {P[1]} AS p2, {P[2]} AS p3 FROM {SCALED})")
def log_predict_ovr(spark, d):
    return scaled(spark, d).select("x", fixed_logistic("ovr").predict_proba().alias("p")).select("x", *[F.round(F.col("p")[i], 6).alias(c) for i, c in enumerate("abc")])


@query(f"SELECT x, round((p1 + p2) / 3, 6) AS a, round((1 - p1 + p3) / 3, 6) AS b, round((2 - p2 - p3) / 3, 6) AS c FROM (SELECT x, {P[0]} AS p1, {P[1]} AS p2, {P[2]} AS p3 FROM {SCALED})")
def log_predict_ovo(spark, d):
    return scaled(spark, d).select("x", fixed_logistic("ovo").predict_proba().alias("p")).select("x", *[F.round(F.col("p")[i], 6).alias(c) for i, c in enumerate("abc")])


@query(f"SELECT round(avg(-(y * ln({P[0]}) + (1 - y) * ln(1 - {P[0]}))), 6) AS cost FROM (SELECT x, CASE WHEN y > 0.95 THEN 0.0 ELSE 1.0 END AS y FROM {SCALED})")
def log_cost(spark, d):
    y = F.when(F.col("y") > 0.95, 0.0).otherwise(1.0)
    return scaled(spark, d).agg(F.round(F.avg(linear.log_loss(C.sigmoid(0.5 - F.col("x")), y)), 6).alias("cost"))


# naive Bayes

JOINED = "(SELECT d.doc_id, lang, source, quality::VARCHAR AS y FROM documents d JOIN labels l USING (doc_id))"


def rated(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id").select("doc_id", "lang", "source", F.col("quality").cast("string").alias("y"))


@query(f"SELECT y AS class, round(count(*) / sum(count(*)) OVER (), 8) AS p, count(*) AS n FROM {JOINED} GROUP BY 1")
def nb_priors(spark, d):
    return NaiveBayes().fit(rated(spark, d), ["lang", "source"], "y").priors.select("class", F.round("p", 8).alias("p"), "n")


LONG = f"(SELECT doc_id, y, unnest(['lang', 'source']) AS feature, unnest([lang, source]) AS value FROM {JOINED})"


@query(f"SELECT feature, value, class, round(n / sum(n) OVER (PARTITION BY feature, class), 8) AS p, n FROM (SELECT feature, value, y AS class, count(*) AS n FROM {LONG} GROUP BY ALL)")
def nb_conditionals(spark, d):
    return NaiveBayes().fit(rated(spark, d), ["lang", "source"], "y").conditionals.select("feature", "value", "class", F.round("p", 8).alias("p"), "n")


POSTERIOR = f"""WITH l AS {LONG}, c AS (SELECT y, count(*) AS n FROM {JOINED} GROUP BY 1), t AS (SELECT count(*) AS t FROM {JOINED}),
xy AS (SELECT feature, value, l.y, count(*) / max(c.n) AS p FROM l JOIN c ON c.y = l.y GROUP BY ALL), x AS (SELECT feature, value, count(*) / max(t) AS p FROM l, t GROUP BY ALL),
r AS (SELECT l.doc_id, c.y, bool_or(xy.p IS NULL) AS gone, sum(ln(xy.p / x.p)) + ln(max(c.n / t)) AS s FROM l JOIN x USING (feature, value) CROSS JOIN c CROSS JOIN t LEFT JOIN xy ON xy.feature = l.feature AND xy.value = l.value AND xy.y = c.y GROUP BY ALL),
q AS (SELECT doc_id, y, CASE WHEN gone THEN 0 ELSE exp(s) END AS s FROM r), p AS (SELECT doc_id, y, coalesce(s / nullif(sum(s) OVER (PARTITION BY doc_id), 0), 1 / count(*) OVER (PARTITION BY doc_id)) AS p FROM q)"""


@query(f"{POSTERIOR} SELECT doc_id, y AS class, round(p, 6) AS p FROM p")
def nb_predict(spark, d):
    rows = rated(spark, d)
    return NaiveBayes().fit(rows, ["lang", "source"], "y").predict_proba(rows, "doc_id").select("doc_id", "class", F.round("p", 6).alias("p"))


@query(f"{POSTERIOR} SELECT y AS prediction, count(*) AS n FROM (SELECT y, row_number() OVER (PARTITION BY doc_id ORDER BY round(p, 10) DESC, y) AS r FROM p) WHERE r = 1 GROUP BY 1")
def nb_classes(spark, d):
    rows = rated(spark, d)
    return NaiveBayes().fit(rows, ["lang", "source"], "y").predict(rows, "doc_id").groupBy("prediction").agg(F.count("*").alias("n"))


# support vector machines

def vectors(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return e, e.filter("vec_id < 8").select(F.col("vec_id").alias("sv"), F.col("x").alias("v"))


def kernel_query(name, column, sql):
    @query(f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), k AS (SELECT a.vec_id, b.vec_id AS sv, list_dot_product(a.x, b.x) AS dot, list_sum(list_transform(range(1, len(a.x) + 1), lambda i: (a.x[i] - b.x[i]) ** 2)) AS d2 FROM e a, e b WHERE b.vec_id < 8) SELECT vec_id, sv, round({sql}, 6) AS k FROM k")
    def run(spark, d):
        e, sv = vectors(spark, d)
        return e.join(F.broadcast(sv)).select("vec_id", "sv", F.round(column(F.col("x"), F.col("v")), 6).alias("k"))

    return run


def _register(name, column, sql):
    from sparkloom.plans.registry import QUERIES, SQL

    kernel_query(name, column, sql)
    QUERIES[name], SQL[name] = QUERIES.pop("run"), SQL.pop("run")


_register("svm_kernel_linear", C.linear_kernel, "dot")
_register("svm_kernel_poly", lambda a, b: C.polynomial_kernel(a, b, 1.0, 3), "(dot + 1) ** 3")
_register("svm_kernel_rbf", lambda a, b: C.rbf_kernel(a, b, 1.0), "exp(-d2 / 2)")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) SELECT a.vec_id, round(0.25 + sum((CASE WHEN b.vec_id % 2 = 0 THEN 1 ELSE -1 END) * (b.vec_id + 1) / 10 * exp(-list_sum(list_transform(range(1, len(a.x) + 1), lambda i: (a.x[i] - b.x[i]) ** 2)) / 2)), 6) AS u FROM e a, e b WHERE b.vec_id < 8 GROUP BY 1""")
def svm_decision(spark, d):
    e, sv = vectors(spark, d)
    rows = sv.orderBy("sv").collect()
    model = svm.SVMModel([(np.array([r.v for r in rows]), np.array([(1 if r.sv % 2 == 0 else -1) * (r.sv + 1) / 10 for r in rows]), 0.25)], ["a", "b"], "binary", [], "rbf", 1.0, 3, 1.0)
    return e.select("vec_id", F.round(model.decision(F.col("x")), 6).alias("u"))


@query("""SELECT round(2.0 * sum(greatest(0, 1 - y * (0.5 * a - 0.25 * b + 0.1))) + 0.5 * (0.25 + 0.0625), 6) AS cost FROM (SELECT CASE WHEN label % 2 = 0 THEN 1.0 ELSE -1.0 END AS y, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings)""")
def svm_hinge_cost(spark, d):
    x = table(spark, d, "embeddings").select(F.when(F.col("label") % 2 == 0, 1.0).otherwise(-1.0).alias("y"), F.col("embedding").cast("array<double>").alias("x"))
    u = 0.5 * F.col("x")[0] - 0.25 * F.col("x")[1] + 0.1
    return svm.hinge_cost(x, "y", u, [0.5, -0.25], 2.0).select(F.round("cost", 6).alias("cost"))


def few(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x")).withColumn("y", F.when(F.col("x")[0] > 0.05, "hi").when(F.col("x")[0] < -0.05, "lo").otherwise("mid"))


@query()
def svm_fit(spark, d):
    rows = few(spark, d)
    model = svm.SVM(10.0, "linear").fit(rows, "vec_id", "x", "y")
    return model.transform(rows, "x").groupBy("y", "prediction").agg(F.count("*").alias("n"))


@query()
def svm_fit_tree(spark, d):
    rows = few(spark, d)
    model = svm.SVM(10.0, "rbf", "tree").fit(rows, "vec_id", "x", "y")
    return model.transform(rows, "x").groupBy("y", "prediction").agg(F.count("*").alias("n"))


@query()
def svr_fit(spark, d):
    rows = few(spark, d).withColumn("t", F.col("x")[0] * 3 + F.col("x")[1])
    model = svm.SVM(10.0, "linear", "regression", eps=0.01).fit(rows, "vec_id", "x", "t")
    return model.transform(rows, "x").agg(F.round(F.max(F.abs(F.col("t") - F.col("prediction"))), 2).alias("largest_residual"))


# perceptrons

W1 = np.array([[0.1, -0.2], [0.5, 0.25], [-0.3, 0.4]])
W2 = np.array([[0.05, -0.05], [1.0, -1.0], [0.5, 0.75]])
NET = mlp.Network([W1, W2], "tanh", "softmax", ["a", "b"])
POINTS = "(SELECT event_id, value / 100 AS x, user_id % 100 / 100 AS z, (value > 50)::INTEGER AS hi FROM events)"
HIDDEN = f"(SELECT *, tanh(0.1 + 0.5 * x - 0.3 * z) AS h1, tanh(-0.2 + 0.25 * x + 0.4 * z) AS h2 FROM {POINTS})"
OUT = f"(SELECT *, exp(0.05 + h1 + 0.5 * h2) AS o1, exp(-0.05 - h1 + 0.75 * h2) AS o2 FROM {HIDDEN})"


def points(spark, d):
    return table(spark, d, "events").select("event_id", F.array(F.col("value") / 100, F.col("user_id") % 100 / 100).alias("p"), (F.col("value") > 50).cast("double").alias("hi"))


@query(f"SELECT event_id, round(o1 / (o1 + o2), 6) AS a, round(o2 / (o1 + o2), 6) AS b FROM {OUT}")
def mlp_forward_fixed(spark, d):
    return points(spark, d).select("event_id", NET.output("p").alias("o")).select("event_id", F.round(F.col("o")[0], 6).alias("a"), F.round(F.col("o")[1], 6).alias("b"))


@query(f"SELECT round(avg(((a - hi) ** 2 + (b - 1 + hi) ** 2) / 2), 6) AS mse, round(avg(-(hi * ln(a + 1e-10) + (1 - hi) * ln(1 - a + 1e-10) + (1 - hi) * ln(b + 1e-10) + hi * ln(1 - b + 1e-10))), 6) AS ce, round(avg(-(hi * ln(a + 1e-10) + (1 - hi) * ln(b + 1e-10))), 6) AS log FROM (SELECT hi, o1 / (o1 + o2) AS a, o2 / (o1 + o2) AS b FROM {OUT})")
def mlp_costs(spark, d):
    x = points(spark, d).select(NET.output("p").alias("o"), F.array(F.col("hi"), 1 - F.col("hi")).alias("y"))
    return x.agg(*[F.round(F.avg(mlp.cost_column(F.col("o"), F.col("y"), k)), 6).alias(k) for k in ("mse", "ce", "log")])


@query(f"SELECT round(avg(a - hi), 6) AS bias, round(avg((a - hi) * h1), 6) AS h1, round(avg((a - hi) * h2), 6) AS h2 FROM (SELECT *, o1 / (o1 + o2) AS a FROM {OUT})")
def mlp_backprop_step(spark, d):
    """The last layer's gradients for the first class."""
    x = points(spark, d).select(F.col("p").alias("x"), F.when(F.col("hi") == 1, "a").otherwise("b").alias("y"))
    g, _, n = mlp.gradient_sums(x, NET, NET.weights)
    last = g[W1.size :].reshape(W2.shape)[:, 0] / n
    return spark.createDataFrame([tuple(round(float(v), 6) for v in last)], "bias double, h1 double, h2 double")


@query(f"""WITH o AS (SELECT *, o1 / (o1 + o2) AS a, o2 / (o1 + o2) AS b FROM {OUT}), g AS (SELECT *, a * ((a - hi) - (a * (a - hi) + b * (b - 1 + hi))) AS delta FROM o)
SELECT round(avg(delta), 8) AS bias, round(avg(delta * h1), 8) AS h1, round(avg(delta * h2), 8) AS h2 FROM g""")
def mlp_softmax_mse_step(spark, d):
    """The last layer's gradients for the first class when softmax is trained on squared errors, through its Jacobian."""
    x = points(spark, d).select(F.col("p").alias("x"), F.when(F.col("hi") == 1, "a").otherwise("b").alias("y"))
    net = mlp.Network([W1, W2], "tanh", "softmax", ["a", "b"], cost="mse")
    g, _, n = mlp.gradient_sums(x, net, net.weights)
    last = g[W1.size :].reshape(W2.shape)[:, 0] / n
    return spark.createDataFrame([tuple(round(float(v), 8) for v in last)], "bias double, h1 double, h2 double")


@query("SELECT (epoch - 1)::INTEGER AS epoch, (SELECT count(*) FROM events WHERE event_id % 5 > 0) AS n_rows, true AS better FROM range(1, 4) AS t(epoch)")
def mlp_epochs(spark, d):
    """Every epoch takes every row once, and the last one scores over 0.9 on rows held out."""
    rows = points(spark, d).withColumn("y", F.when(F.col("p")[0] > 0.5, "hi").otherwise("lo"))
    n = rows.filter("event_id % 5 > 0").count()
    net = mlp.MLP((4,), "tanh", optimizer=Optimizer("adam", 0.2), seed=5, batch=n // 6, epochs=3)
    net.fit(rows.filter("event_id % 5 > 0"), "event_id", "p", "y", rows.filter("event_id % 5 = 0"))
    return spark.createDataFrame([(r["epoch"], r["rows"], net.history[-1]["test_score"] > 0.9) for r in net.history], "epoch int, n_rows long, better boolean")


def trained(spark, d, optimizer, **how):
    rows = points(spark, d).withColumn("y", F.when(F.col("p")[0] > 0.5, "hi").otherwise("lo"))
    net = mlp.MLP((4,), "tanh", optimizer=optimizer, steps=8, seed=5, **how).fit(rows, "event_id", "p", "y")
    return net.transform(rows, "p").groupBy("y", "prediction").agg(F.count("*").alias("n"))


@query()
def mlp_fit_sgd(spark, d):
    return trained(spark, d, Optimizer("sgd", 1.0), share=0.5)


@query()
def mlp_fit_momentum(spark, d):
    return trained(spark, d, Optimizer("momentum", 0.5))


@query()
def mlp_fit_nesterov(spark, d):
    return trained(spark, d, Optimizer("nesterov", 0.5))


@query()
def mlp_fit_adam(spark, d):
    return trained(spark, d, Optimizer("adam", 0.2), keep=0.75)


@query()
def mlp_regression(spark, d):
    rows = points(spark, d).withColumn("t", F.col("p")[0] * 2)
    net = mlp.MLP((4,), "relu", regression=True, optimizer=Optimizer("adam", 0.1), steps=15, seed=5).fit(rows, "event_id", "p", "t")
    return net.transform(rows, "p").agg(F.round(F.sqrt(F.avg((F.col("t") - F.col("prediction")) ** 2)), 2).alias("rmse"))


# optimizers, on half the mean of (x - discount)^2 + 50 (y - tax)^2 over the rows, from (1.2, 0.8)

MEANS = "m AS (SELECT avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem)"


def slope(spark, d):
    """The loss's gradient, from the rows' means."""
    m = table(spark, d, "lineitem").agg(F.avg("l_discount"), F.avg("l_tax")).first()
    return lambda t: np.array([t[0] - m[0], 50 * (t[1] - m[1])])


def _descent(name: str, ahead: str) -> str:
    step = lambda v, x, scale, mean: f"0.9 * {v} - 0.006 * {scale} * ({x}{ahead.format(v)} - {mean})"
    return f"""{name} AS (SELECT 0 AS i, 1.2::DOUBLE AS x, 0.8::DOUBLE AS y, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy FROM m UNION ALL
SELECT i + 1, x + {step('vx', 'x', 1, 'd')}, y + {step('vy', 'y', 50, 't')}, {step('vx', 'x', 1, 'd')}, {step('vy', 'y', 50, 't')} FROM {name}, m WHERE i < 20)"""


@query(f"""WITH RECURSIVE {MEANS}, {_descent('momentum', '')}, {_descent('nesterov', ' + 0.9 * {}')},
sgd AS (SELECT 0 AS i, 1.2::DOUBLE AS x, 0.8::DOUBLE AS y FROM m UNION ALL SELECT i + 1, x - 0.006 * (x - d), y - 0.006 * 50 * (y - t) FROM sgd, m WHERE i < 20)
SELECT name, i::BIGINT AS i, round(x, 6) AS x, round(y, 6) AS y FROM (SELECT 'sgd' AS name, i, x, y FROM sgd UNION ALL SELECT 'momentum', i, x, y FROM momentum UNION ALL SELECT 'nesterov', i, x, y FROM nesterov)""")
def opt_quadratic_trace(spark, d):
    gradient = slope(spark, d)
    rows = [(n, i, float(round(p[0], 6)), float(round(p[1], 6))) for n in ("sgd", "momentum", "nesterov") for i, p in enumerate(minimise(gradient, np.array([1.2, 0.8]), Optimizer(n, 0.006), 20))]
    return spark.createDataFrame(rows, "name string, i long, x double, y double")


@query("SELECT unnest(['sgd', 'momentum', 'nesterov', 'adagrad', 'rmsprop', 'adadelta', 'adam', 'adamax', 'nadam']) AS name, count(*) AS n, true AS lower FROM lineitem")
def opt_all(spark, d):
    """All optimizers come down from the start's loss, over so many rows."""
    rows, gradient = table(spark, d, "lineitem"), slope(spark, d)
    n, start = rows.count(), np.array([1.2, 0.8])
    loss = lambda p: 0.5 * ((F.col("l_discount") - float(p[0])) ** 2 + 50 * (F.col("l_tax") - float(p[1])) ** 2)
    ends = {name: minimise(gradient, start, Optimizer(name, 1.0 if name == "adadelta" else 0.006), 100)[-1] for name in NAMES}
    found = rows.agg(F.avg(loss(start)).alias("start"), *[F.avg(loss(p)).alias(name) for name, p in ends.items()]).first()
    return spark.createDataFrame([(name, n, found[name] < found.start) for name in NAMES], "name string, n long, lower boolean")


# isolation forest

@query("SELECT event_id, round(1 - (CASE WHEN value < 10 THEN 1 WHEN value < 50 THEN 2 ELSE 2 END + CASE WHEN value < 90 THEN 1 ELSE 1 END) / 2.0 / 3, 6) AS score FROM events")
def iforest_score_fixed(spark, d):
    model = isolation.IsolationModel([(0, 10.0, 1, (0, 50.0, 3, 4)), (0, 90.0, 7, 1)], ["value"], 8)
    return table(spark, d, "events").select("event_id", F.round(model.score(), 6).alias("score"))


@query()
def iforest_fit(spark, d):
    rows = table(spark, d, "events")
    model = isolation.IsolationForest(10, 128, 3).fit(rows, ["value"], "event_id")
    return rows.select("event_id", F.round(model.score(), 6).alias("score"), F.round(model.score(classic=True), 6).alias("classic"))


@query("""WITH b AS (SELECT min(l_quantity) - 0.2 AS x0, max(l_quantity) + 0.2 AS x1, min(l_discount) - 0.2 AS y0, max(l_discount) + 0.2 AS y1 FROM lineitem)
SELECT i::INTEGER AS i, j::INTEGER AS j, round(0.5 + 0.1 * (x0 + i * ((x1 - x0) / 20)) - 2 * (y0 + j * ((y1 - y0) / 20)), 6) AS z FROM b, range(21) AS a(i), range(21) AS c(j)""")
def mesh_predict(spark, d):
    model = linear.LinearModel(["l_quantity", "l_discount"], np.array([0.5, 0.1, -2.0]))
    points = mesh.around(table(spark, d, "lineitem"), "l_quantity", "l_discount", 21)
    return mesh.grid_predict(points, F.round(model.predict(), 6)).select("i", "j", "z")


@query("""WITH b AS (SELECT min(l_quantity) - 0.2 AS x0, max(l_quantity) + 0.2 AS x1, min(l_discount) - 0.2 AS y0, max(l_discount) + 0.2 AS y1 FROM lineitem)
SELECT i::INTEGER AS i, j::INTEGER AS j, round(tanh(-0.2 + 0.25 * (x0 + i * ((x1 - x0) / 20)) + 0.4 * (y0 + j * ((y1 - y0) / 20))), 6) AS z FROM b, range(21) AS a(i), range(21) AS c(j)""")
def mesh_neuron(spark, d):
    """The output of the second hidden neuron on a mesh around the rows."""
    points = mesh.around(table(spark, d, "lineitem"), "l_quantity", "l_discount", 21).withColumn("p", F.array("l_quantity", "l_discount"))
    return mesh.grid_predict(points, F.round(NET.output("p", 1)[1], 6)).select("i", "j", "z")
