"""Trees, pruning and ensembles on small tables with known answers."""

import functools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import ensemble, tree
from sparkloom.operators.tree import DecisionTree, TreeModel
from sparkloom.operators.walk import Walker

#: The loan table (age, work, house, credit, decision).
LOANS = [
    ("young", "no", "no", "fair", "no"), ("young", "no", "no", "good", "no"), ("young", "yes", "no", "good", "yes"), ("young", "yes", "yes", "fair", "yes"), ("young", "no", "no", "fair", "no"),
    ("middle", "no", "no", "fair", "no"), ("middle", "no", "no", "good", "no"), ("middle", "yes", "yes", "good", "yes"), ("middle", "no", "yes", "best", "yes"), ("middle", "no", "yes", "best", "yes"),
    ("old", "no", "yes", "best", "yes"), ("old", "no", "yes", "good", "yes"), ("old", "yes", "no", "good", "yes"), ("old", "yes", "no", "best", "yes"), ("old", "no", "no", "fair", "no"),
]
NAMES = ["age", "work", "house", "credit"]


@pytest.fixture(scope="module")
def loans(spark):
    return spark.createDataFrame(LOANS, "age string, work string, house string, credit string, y string")


@pytest.mark.parametrize("criterion", ["id3", "c45", "gini"])
def test_loans_are_split_by_house_then_work(loans, criterion):
    model = DecisionTree(criterion).fit(loans, NAMES, "y")
    assert [model.nodes[c].feature for c in model.nodes[0].childs] == ["house", "house"]
    assert {n.feature for n in model.nodes} == {None, "house", "work"}
    assert model.transform(loans).filter("prediction <> y").count() == 0


def test_best_gain_is_the_known_one():
    before = tree.impurity((6, 9), "entropy")
    after = tree.children_impurity([(0, 6), (6, 3)], "entropy")
    assert round(before, 3) == 0.971 and round(before - after, 3) == 0.420


def test_thresholds_are_midpoints_and_weights_repeat_rows(spark):
    rows = spark.createDataFrame([(1.0, "a", 2), (2.0, "a", 1), (4.0, "b", 3), (8.0, "b", 1)], "x double, y string, w int")
    model = DecisionTree().fit(rows, ["x"], "y", "w")
    assert model.nodes[1].value == 3.0 and model.nodes[0].sums == (3.0, 4.0)


def test_unknown_category_stops_at_the_deepest_node(spark, loans):
    model = DecisionTree("id3").fit(loans, NAMES, "y")
    row = spark.createDataFrame([("old", "no", "tent", "fair")], "age string, work string, house string, credit string")
    assert model.transform(row).first().prediction == "yes"
    assert row.select(model.decision_path().alias("p")).first().p == [0]


def test_save_and_load(spark, loans, tmp_path):
    model = DecisionTree("gini").fit(loans, NAMES, "y")
    model.save(spark, str(tmp_path / "m"))
    again = TreeModel.load(spark, str(tmp_path / "m"))
    assert again.to_text() == model.to_text()
    assert again.transform(loans).filter("prediction <> y").count() == 0


def test_pruning_removes_what_does_not_help(spark):
    rows = spark.createDataFrame([(float(i), float(i % 7), "a" if (i < 20) != (i % 9 == 0) else "b") for i in range(40)], "x double, z double, y string")
    clean = spark.createDataFrame([(float(i), float(i % 7), "a" if i < 20 else "b") for i in range(40)], "x double, z double, y string")
    model = DecisionTree(depth_max=8).fit(rows, ["x", "z"], "y")
    for small in (tree.prune_rep(model, clean, "y"), tree.prune_ccp(model, clean, "y"), tree.prune_pep(model)):
        assert 1 <= len(small.leaves()) < len(model.leaves())
        assert small.transform(clean).filter("prediction = y").count() >= 38 or len(small.leaves()) == 1
    assert [n.nid for n in small.nodes] == list(range(len(small.nodes)))


def test_regression_tree_predicts_means(spark):
    rows = spark.createDataFrame([(float(i), 1.0 if i < 5 else 3.0 if i < 8 else 9.0) for i in range(10)], "x double, y double")
    model = DecisionTree("variance", depth_max=3).fit(rows, ["x"], "y")
    assert model.transform(rows).filter("abs(prediction - y) > 1e-9").count() == 0


def test_forest_does_not_depend_on_partitions(spark, loans):
    keyed = spark.createDataFrame([(i, *r) for i, r in enumerate(LOANS * 4)], "id int, age string, work string, house string, credit string, y string")
    forest = ensemble.RandomForest(4, seed=3)
    first, second = (forest.fit(keyed.repartition(n), NAMES, "y", "id") for n in (1, 5))
    assert [t.to_text() for t in first.trees] == [t.to_text() for t in second.trees]
    assert first.out_of_bag(keyed, "y").count() == 5


def test_a_perfect_first_unit_is_kept(spark):
    rows = spark.createDataFrame([(float(i), "a" if i < 5 else "b") for i in range(10)], "x double, y string")
    model = ensemble.AdaBoost(5).fit(rows, ["x"], "y")
    assert len(model.units) == 1 and model.transform(rows).filter("prediction <> y").count() == 0


def test_gradient_boosting_fits_string_labels(spark):
    rows = spark.createDataFrame([(float(i), "abc"[i // 4]) for i in range(12)], "x double, y string")
    model = ensemble.GradientBoosting(2, depth_max=2).fit(rows, ["x"], "y")
    assert model.transform(rows).filter("prediction <> y").count() == 0


def test_id3_rejects_numbers(spark):
    with pytest.raises(ValueError):
        DecisionTree("id3").fit(spark.createDataFrame([(1.0, "a")], "x double, y string"), ["x"], "y")


# splits by ranges, walks, boosting

def test_splits_do_not_depend_on_ranges_and_screening(spark):
    draw = np.random.default_rng(3)
    rows = [(int(g), float(v), int(n), float(a), float(n - a)) for g in range(3) for v in range(40) for n in [draw.integers(1, 5)] for a in [0 if v < 12 + g else n if v < 25 else draw.integers(0, n + 1)]]
    values = spark.createDataFrame(rows, "g int, value double, n long, s0 double, s1 double")

    def brute(g, criterion):
        mine = sorted(r for r in rows if r[0] == g)
        best = None
        for i in range(1, len(mine)):
            left, right = (tuple(map(sum, zip(*[r[3:] for r in part], strict=True))) for part in (mine[:i], mine[i:]))
            score = round(tree.children_impurity([left, right], criterion), 10)
            if best is None or score < best[0]:
                best = (score, (mine[i - 1][1] + mine[i][1]) / 2, sum(r[2] for r in mine[:i]), left)
        return best

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for criterion in ("gini", "entropy"):
            for ranges in ("1", "4", "17"):
                spark.conf.set("spark.sql.shuffle.partitions", ranges)
                for screen in (True, False):
                    found = {r.g: r for r in tree.split_scan(values, ["g"], ["s0", "s1"], criterion, screen).collect()}
                    for g in range(3):
                        r = found[g]
                        score, *rest = brute(g, criterion)
                        assert abs(r.score - score) < 1e-9 and [r.threshold, r.n_left, tuple(r.left)] == rest
                        assert r.thresholds == 39 and (r.scored < 30 if screen else r.scored == 39)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_walk_goes_where_the_expression_goes(spark, loans):
    draw = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, float(draw.integers(0, 9)), ["red", "blue", "green"][i % 3], "ab"[(i * i) % 5 % 2]) for i in range(120)], "id int, x double, c string, y string")
    model = ensemble.RandomForest(6, depth_max=5, features_use="all", seed=2).fit(rows, ["x", "c"], "y", "id")
    odd = rows.unionByName(spark.createDataFrame([(900, None, "red", "a"), (901, float("nan"), None, "a"), (902, 3.0, "new", "b"), (903, float("inf"), "blue", "b")], rows.schema))
    nested = odd.select("id", F.array(*[t.route() for t in model.trees]).alias("a"), F.array(*[F.array(*[F.get(t.predict_proba(), F.lit(i)) for t in model.trees]) for i in range(2)]).alias("p"))
    walked = odd.select("id", Walker(model.trees).nodes().alias("a"), model.predict_proba().alias("p"), model.by_unit().alias("u"), model.paths().alias("s"), model.predict().alias("best"), F.array(*[t.predict() for t in model.trees]).alias("v"), F.array(*[t.decision_path() for t in model.trees]).alias("d"))
    found = {r.id: r for r in walked.collect()}
    for r in nested.collect():
        w = found[r.id]
        assert w.a == r.a and w.u == w.v and w.s == w.d
        assert w.p == [functools.reduce(lambda a, b: a + b, p, 0.0) / 6.0 for p in r.p] and w.best == "ab"[w.p.index(max(w.p))]
    several = DecisionTree("id3").fit(loans, NAMES, "y")
    assert loans.filter(F.get(Walker([several]).nodes(), F.lit(0)) != several.route()).count() == 0


def test_big_forests_predict_in_one_call(spark):
    """500 trees of depth 12."""

    def full(depth, seed):
        nodes = [tree.Node(0, 0, -1, 1, (1.0, 1.0))]
        for n in nodes:
            if n.depth < depth and len(nodes) < 2 ** (depth + 1) - 1 and (n.depth < 4 or (n.nid + seed) % 3):
                for op in ("<=", ">"):
                    n.childs.append(len(nodes))
                    nodes.append(tree.Node(len(nodes), n.depth + 1, n.nid, 1, (float(len(nodes) % 7), 3.0), "xz"[(n.nid + seed) % 2], op, (n.nid * 37 + seed) % 100 / 100, []))
        return TreeModel(nodes, ["a", "b"], "gini")

    trees = [full(12 if i < 3 else 6, i) for i in range(500)]
    model = ensemble.ForestModel(trees, ["a", "b"], "id", 0, list(range(500)))
    rows = spark.range(300).select("id", (F.col("id") * 17 % 100 / 100).alias("x"), (F.col("id") * 29 % 97 / 97).alias("z"))
    out = rows.withColumn("p", model.predict_proba())
    assert len(out._jdf.queryExecution().toString()) < 20_000
    some = [r for r in out.orderBy("id").limit(5).collect()]
    few = rows.orderBy("id").limit(5).select("id", *[F.get(t.predict_proba(), F.lit(0)).alias(f"t{i}") for i, t in enumerate(trees[100:140])]).collect()
    part = {r.id: r.p for r in rows.withColumn("p", model.subset(range(100, 140)).predict_proba()).filter("id < 5").collect()}
    assert all(abs(sum(r[1:]) / 40 - part[r.id][0]) < 1e-12 for r in few) and all(abs(sum(r.p) - 1) < 1e-9 for r in some)


def test_a_hundred_rounds_of_boosting_keep_the_plan_small(spark, monkeypatch):
    rows = spark.createDataFrame([(float(i % 10), float(i % 7), float((i % 10) ** 2 + i % 7)) for i in range(140)], "x double, z double, y double")
    sizes = []
    real = ensemble.grow
    monkeypatch.setattr(ensemble, "grow", lambda df, *a, **k: sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString())) or real(df, *a, **k))
    rounds = 12
    model = ensemble.GradientBoosting(rounds, regression=True, depth_max=1, rate=0.5).fit(rows, ["x", "z"], "y")
    assert len(model.units) == rounds and max(sizes[2:]) < 1.2 * min(sizes[2:])
    assert ensemble.score(model, rows, "y") > 0.8


def test_unit_scores_of_a_regression_forest(spark):
    rows = spark.createDataFrame([(i, float(i % 11), float((i % 11) * 2 + i % 3)) for i in range(150)], "id int, x double, y double")
    model = ensemble.RandomForest(4, "variance", depth_max=4, features_use="all", seed=5).fit(rows, ["x"], "y", "id")
    data = {r.id: r for r in rows.select("id", "y", F.array(*[t.predict() for t in model.trees]).alias("p"), F.array(*[ensemble.bootstrap_weight("id", F.lit(t), 5) == 0 for t in model.numbers]).alias("out")).collect()}
    found = {r.unit: r for r in model.out_of_bag(rows, "y").collect()}
    r2 = lambda ys, ps: 1 - sum((y - p) ** 2 for y, p in zip(ys, ps, strict=True)) / (np.var(ys) * len(ys))
    for t in range(4):
        mine = [r for r in data.values() if r.out[t]]
        assert found[t].n == len(mine) and abs(found[t].score - r2([r.y for r in mine], [r.p[t] for r in mine])) < 1e-9
    some = [(r.y, np.mean([p for p, o in zip(r.p, r.out, strict=True) if o])) for r in data.values() if any(r.out)]
    assert found[-1].n == len(some) and abs(found[-1].score - r2(*map(list, zip(*some, strict=True)))) < 1e-9
    chosen = ensemble.select_by_oob(model, rows, rows, "y")
    best = max(ensemble.score(model.subset(s), rows, "y") for s in [sorted(range(4), key=lambda i: (-found[i].score, i))[: n + 1] for n in range(4)])
    assert abs(ensemble.score(chosen, rows, "y") - best) < 1e-9


def test_rows_that_match_nothing_are_filled_in_proportion(spark):
    rows = spark.createDataFrame([(i, "rgb"[i % 3], "abb"[i % 3]) for i in range(300)], "id int, c string, y string")
    model = DecisionTree("id3").fit(rows, ["c"], "y")
    more = rows.unionByName(spark.createDataFrame([(1000 + i, "new" if i % 2 else None, "?") for i in range(2000)], rows.schema))
    one, two = ({r.id: r.prediction for r in model.transform_filled(more.repartition(n), "id", seed=4).collect()} for n in (1, 5))
    assert one == two and all(one[i] == "abb"[i % 3] for i in range(300))
    drawn = [one[1000 + i] for i in range(2000)]
    assert set(drawn) == {"a", "b"} and abs(drawn.count("a") / 2000 - 1 / 3) < 0.04
    assert one != {r.id: r.prediction for r in model.transform_filled(more, "id", seed=5).collect()}
    alone = model.transform_filled(more.filter("id >= 1000"), "id").groupBy("prediction").count().collect()
    assert {r.prediction for r in alone} == {"a", "b"}


def test_forests_score_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i % 10), "ab"[i % 10 > 4]) for i in range(60)], "id int, x double, y string")
    model = ensemble.RandomForest(3, depth_max=3, features_use="all", seed=1).fit(rows, ["x"], "y", "id")
    rows.write.parquet(str(tmp_path / "in"))
    stream = model.transform(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).filter("prediction = y").count() >= 55
