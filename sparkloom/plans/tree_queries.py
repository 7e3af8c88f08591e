"""Queries of decision trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import columns as C
from sparkloom.operators import tree
from sparkloom.operators.tree import DecisionTree, Node, TreeModel
from sparkloom.plans.registry import query, table

#: A target with signal: the tables' own labels are independent of their features.
KIND = "CASE WHEN l_quantity > 25 AND l_discount < 0.05 THEN 'a' WHEN l_quantity > 25 THEN 'b' ELSE 'c' END"


def lines(spark, d):
    return table(spark, d, "lineitem").withColumn("kind", F.expr(KIND))


def shares(df, column, weight="l_quantity"):
    sums = df.groupBy(column).agg(F.sum(weight).alias("w"))
    return sums, sums.agg(F.sum("w").alias("t"))


WEIGHTS = "(SELECT sum(l_quantity) AS w, sum(sum(l_quantity)) OVER () AS t FROM lineitem GROUP BY l_returnflag)"


@query(f"SELECT round(-sum(w / t * log2(w / t)), 6) AS entropy FROM {WEIGHTS}")
def tree_entropy(spark, d):
    sums, whole = shares(table(spark, d, "lineitem"), "l_returnflag")
    p = F.col("w") / F.col("t")
    return sums.join(F.broadcast(whole)).agg(F.round(-F.sum(p * F.log2(p)), 6).alias("entropy"))


@query(f"SELECT round(1 - sum((w / t) ** 2), 6) AS gini FROM {WEIGHTS}")
def tree_gini(spark, d):
    sums, whole = shares(table(spark, d, "lineitem"), "l_returnflag")
    p = F.col("w") / F.col("t")
    return sums.join(F.broadcast(whole)).agg(F.round(1 - F.sum(p * p), 6).alias("gini"))


@query("SELECT round(sum(w * y * y) / sum(w) - (sum(w * y) / sum(w)) ** 2, 4) AS variance FROM (SELECT l_quantity AS w, l_discount * 100 AS y FROM lineitem)")
def tree_variance(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_quantity").alias("w"), (F.col("l_discount") * 100).alias("y"))
    sums = x.agg(*[c.alias(f"s{i}") for i, c in enumerate(tree.sum_columns("y", F.col("w"), None))])
    return sums.select(F.round(tree.impurity_column([F.col(f"s{i}") for i in range(3)], "variance")[1], 4).alias("variance"))


CLASSES = ("a", "b", "c")
PARTS = ", ".join(f"sum(CASE WHEN kind = '{c}' THEN 1.0 ELSE 0 END)::DOUBLE AS {c}" for c in CLASSES)
SIDES = f"SELECT l_quantity <= 25 AS side, count(*) AS n, {PARTS} FROM (SELECT *, {KIND} AS kind FROM lineitem) GROUP BY 1"


def sides(spark, d, classes=CLASSES):
    x = lines(spark, d).groupBy((F.col("l_quantity") <= 25).alias("side"))
    return x.agg(*[c.alias(n) for c, n in zip(tree.sum_columns("kind" if classes else "l_discount", F.lit(1.0), classes), classes or ("n", "s", "q"), strict=True)])


def children(df, names, criterion, digits=6):
    w, i = tree.impurity_column([F.col(n) for n in names], criterion)
    return df.select(w.alias("w"), i.alias("i")).agg(F.round(F.sum(F.col("w") * F.col("i")) / F.sum("w"), digits).alias("impurity"))


@query(f"SELECT round(sum(n * (-(CASE WHEN a > 0 THEN a / n * log2(a / n) ELSE 0 END) - (CASE WHEN b > 0 THEN b / n * log2(b / n) ELSE 0 END) - (CASE WHEN c > 0 THEN c / n * log2(c / n) ELSE 0 END))) / sum(n), 6) AS impurity FROM ({SIDES})")
def tree_child_entropy(spark, d):
    return children(sides(spark, d), CLASSES, "entropy")


@query(f"SELECT round(sum(n * (1 - (a / n) ** 2 - (b / n) ** 2 - (c / n) ** 2)) / sum(n), 6) AS impurity FROM ({SIDES})")
def tree_child_gini(spark, d):
    return children(sides(spark, d), CLASSES, "gini")


@query("SELECT round(sum(n * v) / sum(n), 8) AS impurity FROM (SELECT l_quantity <= 25 AS side, count(*) AS n, var_pop(l_discount) AS v FROM lineitem GROUP BY 1)")
def tree_child_variance(spark, d):
    return children(sides(spark, d, None), ("n", "s", "q"), "variance", 8)


GAIN_FEATURES = ("l_returnflag", "l_linestatus", "size")


def gains(spark, d):
    x = lines(spark, d).withColumn("size", F.when(F.col("l_quantity") > 25, "large").otherwise("small"))
    sums = ["a", "b", "c"]
    made = [c.alias(n) for c, n in zip(tree.sum_columns("kind", F.lit(1.0), CLASSES), sums, strict=True)]
    long_ = x.select("kind", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in GAIN_FEATURES])).alias("x")).select("kind", "x.*")
    w, i = tree.impurity_column([F.col(n) for n in sums], "entropy")
    parts = long_.groupBy("feature", "value").agg(*made).select("feature", *sums, w.alias("w"), i.alias("i"))
    by = parts.groupBy("feature").agg(F.sum(F.col("w") * F.col("i")).alias("below"), F.sum("w").alias("w"), *[F.sum(n).alias(n) for n in sums], F.sum(-F.col("w") * F.log2("w")).alias("own"))
    before = tree.impurity_column([F.col(n) for n in sums], "entropy")[1]
    return by.select("feature", (before - F.col("below") / F.col("w")).alias("gain"), (F.col("own") / F.col("w") + F.log2("w")).alias("h"))


GAINS = f"""WITH x AS (SELECT {KIND} AS kind, l_returnflag, l_linestatus, CASE WHEN l_quantity > 25 THEN 'large' ELSE 'small' END AS size FROM lineitem),
l AS (SELECT kind, unnest(['l_returnflag', 'l_linestatus', 'size']) AS feature, unnest([l_returnflag, l_linestatus, size]) AS value FROM x),
k AS (SELECT feature, value, kind, count(*) AS n FROM l GROUP BY ALL), v AS (SELECT feature, value, sum(n) AS n, -sum(n * log2(n)) AS s FROM k GROUP BY ALL),
f AS (SELECT feature, sum(s + n * log2(n)) / sum(n) AS below, -sum(n * log2(n)) / sum(n) + log2(sum(n)) AS h FROM v GROUP BY 1),
b AS (SELECT -sum(n * log2(n)) / sum(n) + log2(sum(n)) AS before FROM (SELECT kind, count(*) AS n FROM x GROUP BY 1))"""


@query(f"{GAINS} SELECT feature, round(before - below, 6) + 0.0 AS gain FROM f, b")
def tree_info_gain(spark, d):
    return gains(spark, d).select("feature", (F.round("gain", 6) + 0.0).alias("gain"))


@query(f"{GAINS} SELECT feature, round((before - below) / h, 6) + 0.0 AS ratio FROM f, b")
def tree_gain_ratio(spark, d):
    return gains(spark, d).select("feature", (F.round(F.col("gain") / F.col("h"), 6) + 0.0).alias("ratio"))


def scanned(spark, d, criterion):
    classes = None if criterion == "variance" else list(CLASSES)
    x = lines(spark, d).withColumn("y", F.col("l_discount") * 2 + F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0))
    sums = [f"s{i}" for i in range(3)]
    made = [c.alias(s) for c, s in zip(tree.sum_columns("kind" if classes else "y", F.lit(1.0), classes), sums, strict=True)]
    long_ = x.select("kind", "y", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in ("l_quantity", "l_discount", "l_tax")])).alias("x")).select("kind", "y", "x.*")
    values = long_.groupBy("feature", "value").agg(F.count("*").alias("n"), *made)
    return tree.split_scan(values, ["feature"], sums, criterion).select("feature", F.round("threshold", 6).alias("threshold"), F.round("score", 6).alias("score"), "n_left")


def scan_sql(impurity: str, extra: str = "") -> str:
    return f"""WITH x AS (SELECT {KIND} AS kind, l_discount * 2 + CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END AS y, l_quantity, l_discount, l_tax FROM lineitem),
l AS (SELECT kind, y, unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_discount, l_tax]) AS value FROM x),
v AS (SELECT feature, value, count(*) AS n, {PARTS}, sum(y) AS s, sum(y * y) AS q FROM l GROUP BY ALL),
p AS (SELECT feature, value, lead(value) OVER w AS nxt, sum(n) OVER w AS nl, sum(a) OVER w AS al, sum(b) OVER w AS bl, sum(c) OVER w AS cl, sum(s) OVER w AS sl, sum(q) OVER w AS ql,
sum(n) OVER f AS nt, sum(a) OVER f AS ta, sum(b) OVER f AS bt, sum(c) OVER f AS ct, sum(s) OVER f AS st, sum(q) OVER f AS qt FROM v WINDOW w AS (PARTITION BY feature ORDER BY value), f AS (PARTITION BY feature)),
z AS (SELECT feature, (value + nxt) / 2 AS threshold, nl AS n_left, round({impurity}, 10) AS score FROM p WHERE nxt IS NOT NULL)
SELECT feature, round(threshold, 6) AS threshold, round(score, 6) AS score, n_left::BIGINT AS n_left FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY score, threshold) AS r FROM z) WHERE r = 1"""


def _h(x: str, n: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN -({x}) / ({n}) * log2(({x}) / ({n})) ELSE 0 END)"


@query(scan_sql("(nl * (1 - (al / nl) ** 2 - (bl / nl) ** 2 - (cl / nl) ** 2) + (nt - nl) * (1 - ((ta - al) / (nt - nl)) ** 2 - ((bt - bl) / (nt - nl)) ** 2 - ((ct - cl) / (nt - nl)) ** 2)) / nt"))
def tree_best_split_gini(spark, d):
    return scanned(spark, d, "gini")


@query(scan_sql(f"(nl * ({_h('al', 'nl')} + {_h('bl', 'nl')} + {_h('cl', 'nl')}) + (nt - nl) * ({_h('ta - al', 'nt - nl')} + {_h('bt - bl', 'nt - nl')} + {_h('ct - cl', 'nt - nl')})) / nt"))
def tree_best_split_entropy(spark, d):
    return scanned(spark, d, "entropy")


@query(scan_sql("(ql - sl * sl / nl + (qt - ql) - (st - sl) ** 2 / (nt - nl)) / nt"))
def tree_best_split_variance(spark, d):
    return scanned(spark, d, "variance")


@query("""WITH x AS (SELECT p_type AS v, CASE WHEN p_type IN ('SMALL', 'MEDIUM') OR p_size > 45 THEN 1 ELSE 0 END AS y FROM part), t AS (SELECT count(*) AS n, sum(y) AS s FROM x),
g AS (SELECT v, count(*) AS n, sum(y) AS s FROM x GROUP BY 1)
SELECT v AS value, round((g.n * (1 - (g.s / g.n) ** 2 - (1 - g.s / g.n) ** 2) + (t.n - g.n) * (1 - ((t.s - g.s) / (t.n - g.n)) ** 2 - (1 - (t.s - g.s) / (t.n - g.n)) ** 2)) / t.n, 8) AS impurity FROM g, t""")
def tree_best_split_onevsrest(spark, d):
    x = table(spark, d, "part").select(F.col("p_type").alias("value"), F.expr("CASE WHEN p_type IN ('SMALL', 'MEDIUM') OR p_size > 45 THEN 1.0 ELSE 0.0 END").alias("y"))
    sums = x.groupBy("value").agg(F.sum(1 - F.col("y")).alias("a"), F.sum("y").alias("b"))
    whole = sums.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    both = sums.join(F.broadcast(whole))
    (wl, il), (wr, ir) = tree.impurity_column([F.col("a"), F.col("b")], "gini"), tree.impurity_column([F.col("ta") - F.col("a"), F.col("tb") - F.col("b")], "gini")
    return both.select("value", F.round((wl * il + wr * ir) / (wl + wr), 8).alias("impurity"))


@query("""WITH v AS (SELECT l_quantity AS value, min(kind) AS a, max(kind) AS b FROM (SELECT *, CASE WHEN l_quantity > 25 THEN 'b' WHEN l_quantity > 10 THEN 'c' ELSE 'd' END AS kind FROM lineitem) GROUP BY 1),
p AS (SELECT value, a, b, lead(value) OVER (ORDER BY value) AS nxt, lead(a) OVER (ORDER BY value) AS na, lead(b) OVER (ORDER BY value) AS nb FROM v)
SELECT (value + nxt) / 2 AS threshold FROM p WHERE nxt IS NOT NULL AND NOT (a = b AND na = nb AND a = na)""")
def tree_split_candidates(spark, d):
    """Boundaries where the label changes; no others can be best."""
    x = table(spark, d, "lineitem").select(F.col("l_quantity").alias("value"), F.expr("CASE WHEN l_quantity > 25 THEN 'b' WHEN l_quantity > 10 THEN 'c' ELSE 'd' END").alias("kind"), F.lit("l_quantity").alias("feature"))
    made = [c.alias(s) for c, s in zip(tree.sum_columns("kind", F.lit(1.0), ["b", "c", "d"]), ("s0", "s1", "s2"), strict=True)]
    found = tree.thresholds(x.groupBy("feature", "value").agg(F.count("*").alias("n"), *made), ["feature"], ["s0", "s1", "s2"], True)
    return found.select(((F.col("value") + F.col("after")) / 2).alias("threshold"))


def fixed() -> TreeModel:
    """l_quantity <= 25 is c; above it, l_discount <= 0.05 is a and the rest b."""
    nodes = [Node(0, 0, -1, 100, (30.0, 20.0, 50.0), childs=[1, 2]), Node(1, 1, 0, 50, (0.0, 0.0, 50.0), "l_quantity", "<=", 25.0), Node(2, 1, 0, 50, (30.0, 20.0, 0.0), "l_quantity", ">", 25.0, [3, 4]), Node(3, 2, 2, 28, (26.0, 2.0, 0.0), "l_discount", "<=", 0.05), Node(4, 2, 2, 22, (4.0, 18.0, 0.0), "l_discount", ">", 0.05)]
    return TreeModel(nodes, list(CLASSES), "gini")


@query("SELECT prediction, count(*) AS n FROM (SELECT CASE WHEN l_quantity <= 25 THEN 'c' WHEN l_discount <= 0.05 THEN 'a' ELSE 'b' END AS prediction FROM lineitem) GROUP BY 1")
def tree_predict_fixed(spark, d):
    return fixed().transform(table(spark, d, "lineitem")).groupBy("prediction").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_quantity, l_discount FROM lineitem WHERE l_quantity > 25 AND l_discount <= 0.05")
def tree_flow_to_node(spark, d):
    return fixed().flow_to(table(spark, d, "lineitem"), 3).select("l_orderkey", "l_quantity", "l_discount")


@query("SELECT path, count(*) AS n FROM (SELECT CASE WHEN l_quantity <= 25 THEN '0-1' WHEN l_discount <= 0.05 THEN '0-2-3' ELSE '0-2-4' END AS path FROM lineitem) GROUP BY 1")
def tree_path(spark, d):
    return table(spark, d, "lineitem").select(F.array_join(fixed().decision_path().cast("array<string>"), "-").alias("path")).groupBy("path").agg(F.count("*").alias("n"))


FEATURES = ["l_quantity", "l_discount", "l_tax"]


def nodes(model, spark, digits=4):
    return model.to_df(spark).select("nid", "depth", "parent", "sample_n", "feature", "op", F.round(F.element_at("value", 1).try_cast("double"), digits).alias("threshold"), F.coalesce("label", F.round("output", digits).cast("string")).alias("output"))


@query("""SELECT * FROM (VALUES (0, NULL, NULL), (1, 'l_quantity', '<='), (2, 'l_quantity', '>')) AS t(nid, feature, op)""")
def tree_cart_depth1_class(spark, d):
    return DecisionTree("gini", depth_max=1).fit(lines(spark, d), FEATURES, "kind").to_df(spark).select("nid", "feature", "op")


@query(f"""WITH x AS (SELECT {KIND} AS kind, l_quantity, l_discount FROM lineitem)
SELECT 0 AS nid, count(*) AS sample_n FROM x UNION ALL SELECT 1, count(*) FROM x WHERE l_quantity <= 25 UNION ALL SELECT 2, count(*) FROM x WHERE l_quantity > 25
UNION ALL SELECT 3, count(*) FROM x WHERE kind = 'a' UNION ALL SELECT 4, count(*) FROM x WHERE kind = 'b'""")
def tree_cart_depth2_class(spark, d):
    return DecisionTree("gini", depth_max=2).fit(lines(spark, d), FEATURES, "kind").to_df(spark).select("nid", "sample_n")


@query("""WITH x AS (SELECT l_quantity > 25 AS q, l_discount > 0.05 AS t, CASE WHEN l_quantity > 25 THEN 10.0 ELSE 0.0 END + CASE WHEN l_discount > 0.05 THEN 3.0 ELSE 0.0 END AS y FROM lineitem)
SELECT round(avg(y), 6) AS output, count(*) AS n FROM x GROUP BY q, t""")
def tree_cart_depth2_regr(spark, d):
    x = table(spark, d, "lineitem").withColumn("y", F.expr("CASE WHEN l_quantity > 25 THEN 10.0D ELSE 0.0D END + CASE WHEN l_discount > 0.05 THEN 3.0D ELSE 0.0D END"))
    model = DecisionTree("variance", depth_max=2).fit(x, FEATURES, "y")
    return model.transform(x).groupBy(F.round("prediction", 6).alias("output")).agg(F.count("*").alias("n"))


def words(spark, d):
    return lines(spark, d).select("kind", "l_returnflag", "l_linestatus", F.when(F.col("l_quantity") > 25, "large").otherwise("small").alias("size"), F.when(F.col("l_discount") < 0.05, "low").otherwise("high").alias("cut"), "l_tax")


def _leaf_sql() -> str:
    """The rows of each leaf of an ID3 tree of depth 2 on three words: a node splits on the word of the largest gain (the
    first of equal ones), unless it is pure."""
    names = ["l_returnflag", "size", "cut"]
    h = "-sum(n / w * log2(n / w))"

    def level(rows: str, out: str) -> str:
        return f"""l_{out} AS (SELECT node, kind, unnest(['{"', '".join(names)}']) AS f, unnest([{', '.join(names)}]) AS v FROM {rows}),
k_{out} AS (SELECT node, f, v, kind, count(*) AS n, sum(count(*)) OVER (PARTITION BY node, f, v) AS w FROM l_{out} GROUP BY node, f, v, kind),
v_{out} AS (SELECT node, f, v, w, {h} AS h FROM k_{out} GROUP BY node, f, v, w), i_{out} AS (SELECT node, f, round(sum(w * h) / sum(w), 10) AS below, count(*) AS parts FROM v_{out} GROUP BY node, f),
p_{out} AS (SELECT node, count(DISTINCT kind) AS kinds FROM {rows} GROUP BY 1),
b_{out} AS (SELECT node, f FROM i_{out} JOIN p_{out} USING (node) WHERE parts > 1 AND kinds > 1 QUALIFY row_number() OVER (PARTITION BY node ORDER BY below, list_position(['{"', '".join(names)}'], f)) = 1),
{out} AS (SELECT r.* EXCLUDE (node), CASE WHEN b.f IS NULL THEN r.node ELSE r.node || '/' || b.f || '=' || CASE b.f {' '.join(f"WHEN '{n}' THEN {n}" for n in names)} END END AS node FROM {rows} r LEFT JOIN b_{out} b ON b.node = r.node)"""

    return f"""WITH a AS (SELECT {KIND} AS kind, l_returnflag, CASE WHEN l_quantity > 25 THEN 'large' ELSE 'small' END AS size, CASE WHEN l_discount < 0.05 THEN 'low' ELSE 'high' END AS cut, '' AS node FROM lineitem),
{level('a', 'd1')}, {level('d1', 'd2')}, c AS (SELECT node, kind, count(*) AS n FROM d2 GROUP BY node, kind)
SELECT sum(n)::BIGINT AS sample_n, arg_min(kind, (-n, kind)) AS output FROM c GROUP BY node"""


@query(_leaf_sql())
def tree_id3(spark, d):
    """The leaves of a tree of depth 2."""
    model = DecisionTree("id3", depth_max=2).fit(words(spark, d), ["l_returnflag", "size", "cut"], "kind")
    return model.to_df(spark).filter("is_leaf").select("sample_n", F.col("label").alias("output"))


@query()
def tree_c45(spark, d):
    return nodes(DecisionTree("c45", depth_max=3).fit(words(spark, d), ["l_returnflag", "size", "cut", "l_tax"], "kind"), spark)


@query("""WITH x AS (SELECT p_type AS v, CASE WHEN p_type LIKE '%E%' OR p_size > 45 THEN 1 ELSE 0 END AS y FROM part),
g AS (SELECT v, count(*) AS n, sum(y) AS s, row_number() OVER (ORDER BY v) - 1 AS i FROM x GROUP BY 1), t AS (SELECT sum(n) AS n, sum(s) AS s, count(*) AS k FROM g),
p AS (SELECT mask, sum(n) AS n, sum(s) AS s FROM range(1, (SELECT 1 << (k - 1) FROM t)::BIGINT) AS r(mask), g WHERE (mask >> i) & 1 = 1 GROUP BY 1),
q AS (SELECT mask, p.n, p.s, t.n - p.n AS m, t.s - p.s AS u, round((p.n * (1 - (p.s / p.n) ** 2 - (1 - p.s / p.n) ** 2) + (t.n - p.n) * (1 - ((t.s - p.s) / (t.n - p.n)) ** 2 - (1 - (t.s - p.s) / (t.n - p.n)) ** 2)) / t.n, 10) AS score FROM p, t),
b AS (SELECT * FROM q ORDER BY score, mask LIMIT 1)
SELECT 0 AS nid, n::BIGINT AS sample_n, CASE WHEN 2 * s >= n THEN 'x' ELSE 'y' END AS output FROM t UNION ALL SELECT 1, n::BIGINT, CASE WHEN 2 * s >= n THEN 'x' ELSE 'y' END FROM b UNION ALL SELECT 2, m::BIGINT, CASE WHEN 2 * u >= m THEN 'x' ELSE 'y' END FROM b""")
def tree_best_split_subsets(spark, d):
    x = table(spark, d, "part").withColumn("y", F.expr("CASE WHEN p_type LIKE '%E%' OR p_size > 45 THEN 'x' ELSE 'y' END"))
    return nodes(DecisionTree("gini", depth_max=1, subsets=True).fit(x, ["p_type"], "y"), spark).select("nid", "sample_n", "output")


def noisy(spark, d):
    x = table(spark, d, "events").select("event_id", "event_type", F.col("value"), (F.col("user_id") % 100).alias("u"))
    return x.withColumn("y", F.expr("CASE WHEN (value > 50) <> (xxhash64(event_id) % 10 = 0) THEN 'hi' ELSE 'lo' END"))


def grown(spark, d):
    x = noisy(spark, d)
    model = DecisionTree("gini", depth_max=5, max_bins=32).fit(x.filter("event_id % 2 = 0"), ["value", "u", "event_type"], "y")
    return x.filter("event_id % 2 = 1"), model


@query()
def tree_prune_rep(spark, d):
    test, model = grown(spark, d)
    return nodes(tree.prune_rep(model, test, "y"), spark)


@query()
def tree_prune_pep(spark, d):
    return nodes(tree.prune_pep(grown(spark, d)[1]), spark)


@query()
def tree_prune_ccp(spark, d):
    test, model = grown(spark, d)
    return nodes(tree.prune_ccp(model, test, "y"), spark)
