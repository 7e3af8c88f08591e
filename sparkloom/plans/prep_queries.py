"""Queries of data preparation and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import columns as C
from sparkloom.operators import prep, stats
from sparkloom.plans.registry import query, table


@query("""SELECT l_orderkey, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)::INTEGER AS "A", max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END)::INTEGER AS "N", max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::INTEGER AS "R" FROM lineitem GROUP BY 1""")
def prep_onehot_returnflag(spark, d):
    hot = prep.one_hot(table(spark, d, "lineitem").select("l_orderkey", "l_returnflag"), "l_returnflag")
    return hot.groupBy("l_orderkey").agg(*[F.max(c).alias(c) for c in hot.columns[2:]])


@query("""SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS o_orderpriority FROM orders""")
def prep_label_index(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return prep.label_to_index(orders, "o_orderpriority", prep.label_mapping(orders, ["o_orderpriority"]))


@query("""SELECT o_orderkey, o_orderpriority FROM orders""")
def prep_index_label(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    mapping = prep.label_mapping(orders, ["o_orderpriority"])
    return prep.index_to_label(prep.label_to_index(orders, "o_orderpriority", mapping), "o_orderpriority", mapping)


@query("""SELECT * FROM (VALUES ('p_brand', false), ('p_name', false), ('p_partkey', true), ('p_retailprice', true), ('p_size', true), ('p_type', false)) AS t(feature, continuous)""")
def prep_continuity(spark, d):
    return prep.continuity_table(table(spark, d, "part"), ["p_brand", "p_name", "p_partkey", "p_retailprice", "p_size", "p_type"])


EDGES = "SELECT min(p_retailprice) AS a, max(p_retailprice) AS b FROM part"


@query(f"""SELECT k AS i, round(CASE WHEN k = 10 THEN b ELSE a + (b - a) * k / 10 END, 6) AS edge FROM ({EDGES}), range(11) AS r(k)""")
def prep_equal_width_edges(spark, d):
    edges = prep.equal_width_edges(table(spark, d, "part"), ["p_retailprice"])["p_retailprice"]
    return spark.createDataFrame(list(enumerate(edges)), "i long, edge double").select("i", F.round("edge", 6).alias("edge"))


BIN = "least(9, greatest(0, (SELECT count(*) FROM range(1, 10) AS r(k) WHERE p_retailprice > CASE WHEN k = 10 THEN b ELSE a + (b - a) * k / 10 END)))::INTEGER"


@query(f"""SELECT bin, count(*) AS n FROM (SELECT {BIN} AS bin FROM part, ({EDGES})) GROUP BY 1""")
def prep_discretise(spark, d):
    part = table(spark, d, "part")
    edges = prep.equal_width_edges(part, ["p_retailprice"])["p_retailprice"]
    return part.select(C.bin_index("p_retailprice", edges).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


@query("""SELECT label, count(*) AS n FROM (SELECT CASE WHEN p_size < 10 THEN 'nan' WHEN p_size <= 20 THEN '(10.0, 20.0]' WHEN p_size <= 30 THEN '(20.0, 30.0]' WHEN p_size <= 40 THEN '(30.0, 40.0]' ELSE 'nan' END AS label FROM part) GROUP BY 1""")
def prep_discretise_closed(spark, d):
    return table(spark, d, "part").select(C.bin_label("p_size", [10, 20, 30, 40], open_bounds=False).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("""SELECT feature, round(min, 6) AS min, round(max, 6) AS max, round(mean, 6) AS mean, round(std, 6) AS std FROM (SELECT 's_acctbal' AS feature, min(s_acctbal) AS min, max(s_acctbal) AS max, avg(s_acctbal) AS mean, stddev_samp(s_acctbal) AS std FROM supplier UNION ALL SELECT 's_nationkey', min(s_nationkey)::DOUBLE, max(s_nationkey)::DOUBLE, avg(s_nationkey), stddev_samp(s_nationkey) FROM supplier)""")
def prep_scaler_reference(spark, d):
    return prep.scaler_reference(table(spark, d, "supplier"), ["s_acctbal", "s_nationkey"]).select("feature", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std")])


@query("""SELECT c_custkey, round((c_acctbal - a) / nullif(b - a, 0), 6) AS scaled FROM customer, (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer)""")
def prep_minmax(spark, d):
    customer = table(spark, d, "customer")
    r = prep.scaler_reference(customer, ["c_acctbal"]).first()
    return customer.select("c_custkey", F.round(C.min_max("c_acctbal", r["min"], r["max"]), 6).alias("scaled"))


@query("""SELECT c_custkey, round((c_acctbal - m) / nullif(s, 0), 6) AS scaled FROM customer, (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer)""")
def prep_standard(spark, d):
    customer = table(spark, d, "customer")
    r = prep.scaler_reference(customer, ["c_acctbal"]).first()
    return customer.select("c_custkey", F.round(C.standard("c_acctbal", r["mean"], r["std"]), 6).alias("scaled"))


@query("""SELECT p_partkey, pow(p_size, 2)::DOUBLE AS "p_size^2", pow(p_size, 3)::DOUBLE AS "p_size^3" FROM part""")
def prep_poly_features(spark, d):
    return table(spark, d, "part").select("p_partkey", *C.polynomials(["p_size"], 3))


@query("""SELECT p_partkey, pow(a, 2)::DOUBLE AS "a^2", pow(b, 2)::DOUBLE AS "b^2", a * b AS "a^1_b^1" FROM (SELECT p_partkey, p_size::DOUBLE AS a, p_partkey % 7::DOUBLE AS b FROM part)""")
def prep_poly_cross(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_partkey") % 7).cast("double").alias("b")).select("p_partkey", *C.polynomials(["a", "b"], 2, cross=True))


@query("""SELECT round_even(0.8 * count(*), 0)::BIGINT AS train, count(*) - round_even(0.8 * count(*), 0)::BIGINT AS test, 0::BIGINT AS shared, count(*) AS together FROM orders""")
def prep_split_counts(spark, d):
    train, test = prep.split_train_test(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.8, 42)
    both = train.withColumn("t", F.lit(1)).union(test.withColumn("t", F.lit(0)))
    keys = both.groupBy("o_orderkey").agg(F.sum("t").alias("t"), F.count("*").alias("n"))
    return keys.agg(F.sum("t").alias("train"), F.sum(F.col("n") - F.col("t")).alias("test"), F.sum((F.col("n") > 1).cast("long")).alias("shared"), F.sum("n").alias("together"))


SUBSETS = "SELECT s AS subset, v AS value, ((s >> (i - 1)) & 1)::INTEGER AS chosen FROM (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY o_orderpriority) AS i, count(*) OVER () AS k FROM (SELECT DISTINCT o_orderpriority FROM orders)), range(1, 1000) AS r(s) WHERE s < "


@query(f"{SUBSETS} (1 << k::INTEGER) - 1")
def prep_subsets(spark, d):
    return prep.subsets(table(spark, d, "orders"), "o_orderpriority")


@query(f"{SUBSETS} (1 << (k::INTEGER - 1))")
def prep_bipartitions(spark, d):
    return prep.subsets(table(spark, d, "orders"), "o_orderpriority", split_mode=True)


PAIRS = "SELECT a.v AS positive, b.v AS negative FROM (SELECT DISTINCT o_orderpriority AS v FROM orders) a, (SELECT DISTINCT o_orderpriority AS v FROM orders) b WHERE a.v "


@query(f"{PAIRS} < b.v")
def prep_pairs(spark, d):
    return prep.pairs(table(spark, d, "orders"), "o_orderpriority")


@query(f"{PAIRS} <> b.v")
def prep_pairs_symmetric(spark, d):
    return prep.pairs(table(spark, d, "orders"), "o_orderpriority", ordered=True)


@query("""SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1""")
def prep_unique_count(spark, d):
    return prep.value_counts(table(spark, d, "events"), "event_type")


@query("""SELECT l_returnflag AS value, sum(l_quantity) AS weight FROM lineitem GROUP BY 1""")
def prep_weight_sum(spark, d):
    return prep.weight_sums(table(spark, d, "lineitem"), "l_returnflag", "l_quantity")


@query("""SELECT n_name, n_regionkey IN (1, 3) AS chosen FROM nation""")
def prep_isin(spark, d):
    return table(spark, d, "nation").select("n_name", F.col("n_regionkey").isin(1, 3).alias("chosen"))


@query("""SELECT 1.0::DOUBLE AS x0, r_regionkey, r_name FROM region""")
def prep_fill_x0(spark, d):
    return prep.with_constant(table(spark, d, "region")).select("x0", "r_regionkey", "r_name")


@query("""SELECT 'l_discount' AS feature, count(l_discount) AS n, round(avg(l_discount), 6) AS mean, round(stddev_samp(l_discount), 6) AS std, min(l_discount) AS min, round(quantile_cont(l_discount, 0.25), 6) AS q1, round(quantile_cont(l_discount, 0.5), 6) AS median, round(quantile_cont(l_discount, 0.75), 6) AS q3, max(l_discount) AS max FROM lineitem""")
def prep_summary(spark, d):
    return prep.describe(table(spark, d, "lineitem"), ["l_discount"]).select("feature", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "q1", "median", "q3", "max")])


@query("""SELECT user_id % 10 AS u, coalesce(sum(CASE WHEN event_type = 'click' THEN 1 END), 0)::BIGINT AS click, coalesce(sum(CASE WHEN event_type = 'view' THEN 1 END), 0)::BIGINT AS "view" FROM events GROUP BY 1""")
def prep_pivot(spark, d):
    counts = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("u"), "event_type").agg(F.count("*").alias("n"))
    return prep.to_matrix(counts, "u", "event_type", "n", ["click", "view"])


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def prep_semi_filter(spark, d):
    customer = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'")
    orders = table(spark, d, "orders")
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"], "left_semi").select("o_orderkey", "o_totalprice")


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in NUMBERS for b in NUMBERS))
def stat_corr_matrix(spark, d):
    return stats.correlation(table(spark, d, "lineitem"), NUMBERS).select("x", "y", F.round("r", 6).alias("r"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS x, 'l_extendedprice' AS y, round(corr({a}, l_extendedprice), 6) AS r FROM lineitem" for a in NUMBERS))
def stat_corr_vector(spark, d):
    return stats.correlation(table(spark, d, "lineitem"), NUMBERS, "l_extendedprice").select("x", "y", F.round("r", 6).alias("r"))


PRICED = "(SELECT l_extendedprice AS y, 1000 * l_quantity + 500 AS p FROM lineitem)"


def priced(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (1000 * F.col("l_quantity") + 500).alias("p"))


@query(f"SELECT round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2 FROM {PRICED}")
def stat_r2(spark, d):
    return priced(spark, d).agg(F.round(stats.r_squared("y", "p"), 6).alias("r2"))


@query(f"SELECT round(1 - (sum((y - p) ** 2) / (var_pop(y) * count(*))) * (count(*) - 1) / (count(*) - 2), 6) AS r2 FROM {PRICED}")
def stat_adj_r2(spark, d):
    return priced(spark, d).agg(F.round(stats.adjusted_r_squared("y", "p", 2), 6).alias("r2"))


RULE = "CASE WHEN o_totalprice > 150000 THEN 'O' WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'P' END"


@query(f"SELECT avg((o_orderstatus = {RULE})::INTEGER) AS accuracy FROM orders")
def stat_accuracy(spark, d):
    return table(spark, d, "orders").withColumn("p", F.expr(RULE)).agg(stats.accuracy("o_orderstatus", "p").alias("accuracy"))


@query(f"""WITH x AS (SELECT {RULE} AS p, o_orderstatus AS y FROM orders), c AS (SELECT p AS v FROM x UNION SELECT y FROM x)
SELECT a.v AS predicted, b.v AS actual, (SELECT count(*) FROM x WHERE p = a.v AND y = b.v) / (SELECT count(*) FROM x) AS share FROM c a, c b""")
def stat_confusion(spark, d):
    return stats.confusion(table(spark, d, "orders").withColumn("p", F.expr(RULE)), "o_orderstatus", "p")


@query("""SELECT p_partkey, round(exp(a) / (exp(a) + exp(b)), 6) AS first, round(exp(b) / (exp(a) + exp(b)), 6) AS second FROM (SELECT p_partkey, p_size / 10.0 AS a, p_retailprice / 1000.0 AS b FROM part)""")
def stat_softmax(spark, d):
    x = table(spark, d, "part").select("p_partkey", C.softmax(F.array(F.col("p_size") / 10.0, F.col("p_retailprice") / 1000.0)).alias("s"))
    return x.select("p_partkey", F.round(F.col("s")[0], 6).alias("first"), F.round(F.col("s")[1], 6).alias("second"))


@query("""SELECT p_partkey, round(ln(exp(p_size / 10.0) + exp(p_retailprice / 1000.0)), 6) AS value FROM part""")
def stat_logsumexp(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(C.logsumexp(F.array(F.col("p_size") / 10.0, F.col("p_retailprice") / 1000.0)), 6).alias("value"))


@query(f"""WITH x AS (SELECT {RULE} AS p, o_orderstatus AS y FROM orders), n AS (SELECT count(*) * (count(*) - 1) / 2 AS t FROM x),
c AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT count(*) AS n FROM x GROUP BY p, y)), a AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT count(*) AS n FROM x GROUP BY y)), b AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT count(*) AS n FROM x GROUP BY p))
SELECT c.v::DOUBLE AS both, (a.v - c.v)::DOUBLE AS only_y, (b.v - c.v)::DOUBLE AS only_p, (t - a.v - b.v + c.v)::DOUBLE AS neither FROM n, a, b, c""")
def stat_pair_counts(spark, d):
    return stats.pair_counts(table(spark, d, "orders").withColumn("p", F.expr(RULE)), "o_orderstatus", "p")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round_even((l_orderkey % 1000) / 8.0::DOUBLE, 1) AS rounded FROM lineitem""")
def prep_round_even(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", C.round_even((F.col("l_orderkey") % 1000) / F.lit(8.0), 1).alias("rounded"))
