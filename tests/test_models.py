"""The other models, sources and expressions on small tables with known answers."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import columns as C
from sparkloom.operators import cluster, isolation, linear, mlp, prep, recommend, svm
from sparkloom.operators.bayes import NaiveBayes
from sparkloom.operators.optimizers import NAMES, Optimizer, minimise
from sparkloom.sources import images, tables
from sparkloom import validate


def test_split_is_exact_and_ignores_partitions(spark):
    df = spark.range(1003)
    keep = []
    for n in (1, 7):
        train, test = prep.split_train_test(df.repartition(n), "id", 0.8, 5)
        keep.append(sorted(r.id for r in train.collect()))
        assert train.count() == 802 and test.count() == 201 and train.intersect(test).count() == 0
    assert keep[0] == keep[1]


def test_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 1.0, 1.5, 2.0, 3.0)], "x double")
    labels = [r[0] for r in df.select(C.bin_label("x", [0, 1, 2], open_bounds=False)).collect()]
    assert labels == ["nan", "(0.0, 1.0]", "(0.0, 1.0]", "(1.0, 2.0]", "(1.0, 2.0]", "nan"]
    assert [r[0] for r in df.select(C.bin_index("x", [0, 1, 2])).collect()] == [0, 0, 0, 1, 1, 1]
    assert C.interval_labels([0.000123456, 0.00256, 12.7084]) == ["(0.000123, 0.00256]", "(0.00256, 12.708]"]


def test_softmax_does_not_overflow(spark):
    row = spark.range(1).select(C.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("s"), C.logsumexp(F.array(F.lit(-1000.0), F.lit(-1000.0))).alias("l"), C.sigmoid(F.lit(-1000.0)).alias("z")).first()
    assert row.s == [0.5, 0.5] and row.l == pytest.approx(-1000 + np.log(2)) and row.z == 0.0


@pytest.mark.parametrize("name", NAMES)
def test_optimizers_go_downhill(name):
    how = Optimizer(name, {"adagrad": 0.5, "adam": 0.1, "adamax": 0.1, "nadam": 0.1, "rmsprop": 0.01}.get(name, 0.006))
    path = minimise(lambda t: np.array([2 * t[0], 100 * t[1]]), np.array([1.2, 0.8]), how, 400)
    value = lambda t: t[0] ** 2 + 50 * t[1] ** 2
    assert value(path[-1]) < (0.9 if name == "adadelta" else 0.05) * value(path[0])


def test_linear_regression_agrees_with_least_squares(spark):
    x = np.random.default_rng(1).normal(size=(50, 2))
    y = 3 + x @ [2.0, -1.0]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, y double")
    assert linear.LinearRegression().fit(df, ["a", "b"], "y").theta == pytest.approx([3, 2, -1])
    model = linear.LinearRegression("sgd", optimizer=Optimizer("sgd", 0.5), steps=30).fit(df, ["a", "b"], "y")
    costs = [h["cost"] for h in model.history]
    assert costs == sorted(costs, reverse=True) and model.theta == pytest.approx([3, 2, -1], abs=0.05)


@pytest.mark.parametrize("mode", ["ovr", "ovo"])
def test_logistic_regression_separates(spark, mode):
    df = spark.createDataFrame([(float(i % 10), "abc"[(i % 10) // 4]) for i in range(30)], "x double, y string")
    model = linear.LogisticRegression(mode, optimizer=Optimizer("adam", 0.5), steps=40).fit(df, ["x"], "y")
    total = df.select(F.aggregate(model.predict_proba(), F.lit(0.0), lambda s, v: s + v).alias("t")).agg(F.min("t"), F.max("t")).first()
    assert total[0] == pytest.approx(1) and total[1] == pytest.approx(1)
    assert model.transform(df).filter("prediction = y").count() >= 20


def test_naive_bayes_rules_out_and_falls_back(spark):
    df = spark.createDataFrame([(1, "r", "x", "p"), (2, "r", "y", "p"), (3, "b", "y", "q"), (4, "b", "x", "q")], "id int, c string, d string, y string")
    model = NaiveBayes().fit(df, ["c", "d"], "y")
    p = {(r.id, r["class"]): r.p for r in model.predict_proba(df, "id").collect()}
    assert p[1, "p"] == pytest.approx(1) and p[1, "q"] == 0
    new = spark.createDataFrame([(9, "green", "z")], "id int, c string, d string")
    assert [r.p for r in model.predict_proba(new, "id").collect()] == pytest.approx([0.5, 0.5])
    assert model.predict(new, "id").first().prediction == "p"


def test_svm_meets_its_conditions(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(60, 2))
    y = np.where(x[:, 0] + x[:, 1] > 0, 1.0, -1.0)
    k = svm.gram(x, x, "linear", 0, 0, 0)
    alpha, b = svm.solve(k, y, -np.ones(60), 1.0, 1e-4, 20000)
    u = k @ (alpha * y) + b
    assert abs(alpha @ y) < 1e-8 and alpha.min() >= 0 and alpha.max() <= 1
    assert (y * u)[alpha < 1e-9].min() > 1 - 1e-2 and (y * u)[alpha > 1 - 1e-9].max(initial=-9) < 1 + 1e-2
    df = spark.createDataFrame([(i, list(map(float, p)), ["left", "right"][int(v > 0)]) for i, (p, v) in enumerate(zip(x, y, strict=True))], "id int, x array<double>, y string")
    model = svm.SVM(10.0, "linear").fit(df, "id", "x", "y")
    assert model.transform(df, "x").filter("prediction = y").count() >= 58


@pytest.mark.parametrize(("kernel", "mode"), [("linear", "regression"), ("linear", "ovr")])
def test_svm_learns_from_more_rows_than_a_task_solves(spark, kernel, mode):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(150, 2))
    t = x @ [3.0, 1.0] + 0.5 + draw.normal(size=150) / 5
    df = spark.createDataFrame([(i, list(map(float, p)), float(v), "left" if v < 0 else "right") for i, (p, v) in enumerate(zip(x, t, strict=True))], "id int, x array<double>, t double, y string")
    found = []
    for most in (100, 150):
        model = svm.SVM(1.0, kernel, mode, most=most).fit(df, "id", "x", "t" if mode == "regression" else "y")
        found.append([r.u for r in df.orderBy("id").select(model.decision(F.col("x")).alias("u")).collect()])
    assert found[0] == pytest.approx(found[1], abs=0.05)


def test_linear_svm_of_many_rows_is_solved_by_sums(spark, monkeypatch):
    """Few passes over rows that are written once, and the optimum to more digits than rounds would reach."""
    draw = np.random.default_rng(12)
    x = draw.normal(size=(400, 3))
    y = np.where(x @ [1.0, -2.0, 0.5] + draw.normal(size=400) / 2 > 0.3, 1.0, -1.0)
    df = spark.createDataFrame([(i, p.tolist(), "ab"[int(v > 0)]) for i, (p, v) in enumerate(zip(x, y, strict=True))], "id int, x array<double>, y string").repartition(3)
    made, real = [], svm.written
    monkeypatch.setattr(svm, "written", lambda *a: made.append(1) or real(*a))
    model = svm.SVM(10.0, "linear", most=50).fit(df, "id", "x", "y")
    (vector,), _, b = model.vectors[0]
    alpha, wanted = svm.solve(x @ x.T, y, -np.ones(400), 10.0, 1e-7, 200_000)
    assert vector == pytest.approx((alpha * y) @ x, abs=1e-3) and b == pytest.approx(wanted, abs=1e-3) and len(made) <= 2
    u = x @ vector + b
    assert vector @ vector / 2 + 10 * np.maximum(0, 1 - y * u).sum() - (alpha.sum() - (alpha * y) @ x @ x.T @ (alpha * y) / 2) < 1e-3


def test_many_support_vectors_are_multiplied(spark):
    draw = np.random.default_rng(9)
    vectors, weight = draw.normal(size=(50_000, 3)), draw.normal(size=50_000) / 1000
    x = draw.normal(size=(40, 3))
    rows = spark.createDataFrame([(i, list(map(float, p))) for i, p in enumerate(x)], "id int, x array<double>")
    for kernel in ("rbf", "poly"):
        wanted = svm.gram(x, vectors, kernel, 1.0, 2, 1.5) @ weight + 0.25
        sent = svm.SVMModel([(vectors, weight, 0.25)], ["a", "b"], "binary", [], kernel, 1.0, 2, 1.5)
        out = rows.select("id", sent.decision(F.col("x")).alias("u"))
        assert [r.u for r in out.orderBy("id").collect()] == pytest.approx(wanted) and len(out._jdf.queryExecution().toString()) < 5000
    table = spark.createDataFrame([(i % 2, float(w), list(map(float, v))) for i, (w, v) in enumerate(zip(weight[:9000], vectors[:9000], strict=True))], "g int, weight double, x array<double>")
    none = np.zeros((0, 3)), np.zeros(0)
    held = svm.SVMModel([(*none, 0.5), (*none, -0.5)], ["a", "b"], "ovr", [], "rbf", 1.0, 3, 1.5, table)
    k = svm.gram(x, vectors[:9000], "rbf", 1.0, 3, 1.5)
    wanted = np.stack([k[:, g::2] @ weight[g:9000:2] + (0.5 - g) for g in (0, 1)], 1)
    assert np.array([r.u for r in held.score(rows, "id", "x").orderBy("id").collect()]) == pytest.approx(wanted)
    assert [r.prediction for r in held.transform(rows, "x", key="id").orderBy("id").collect()] == ["ab"[i] for i in wanted.argmax(1)]
    with pytest.raises(ValueError):
        held.transform(rows, "x")


def test_a_model_whose_vectors_stay_a_table(spark, monkeypatch):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(150, 2))
    df = spark.createDataFrame([(i, list(map(float, p)), "in" if p @ p < 1.2 else "out") for i, p in enumerate(x)], "id int, x array<double>, y string")
    plain = svm.SVM(1.0, "rbf", most=100).fit(df, "id", "x", "y")
    monkeypatch.setattr(svm, "SENT", 0)
    large = svm.SVM(1.0, "rbf", most=100).fit(df, "id", "x", "y")
    assert large.table is not None and plain.table is None
    u = [[r.u[0] for r in m.score(df, "id", "x").orderBy("id").collect()] for m in (plain, large)]
    assert u[0] == pytest.approx(u[1])


def test_svm_classes_keep_whole_names_in_a_tree(spark):
    df = spark.createDataFrame([(i, [float(i % 4) * 3, 0.1 * (i // 4)], ["north", "east", "south", "west"][i % 4]) for i in range(24)], "id int, x array<double>, y string")
    model = svm.SVM(10.0, "rbf", "tree").fit(df, "id", "x", "y")
    assert len(model.vectors) == 3 and model.transform(df, "x").filter("prediction = y").count() == 24


def test_mlp_gradient_is_the_slope_of_the_cost():
    draw = np.random.default_rng(3)
    for out, y in (("softmax", np.eye(2)[draw.integers(0, 2, 9)]), ("sigmoid", np.eye(2)[draw.integers(0, 2, 9)]), ("identity", draw.normal(size=(9, 2)))):
        net = mlp.Network(mlp.start_weights([3, 4, 2], 1), "tanh", out, None)
        x = draw.normal(size=(9, 3))
        g, _ = net.gradients(x, y)
        for layer, i, j in ((0, 1, 2), (1, 0, 1), (1, 3, 0)):
            moved = []
            for step in (1e-5, -1e-5):
                w = [v.copy() for v in net.weights]
                w[layer][i, j] += step
                moved.append(net.gradients(x, y, w)[1])
            assert (moved[0] - moved[1]) / 2e-5 == pytest.approx(g[layer][i, j], rel=1e-3, abs=1e-5)


@pytest.mark.parametrize("out", mlp.ACTIVATIONS)
@pytest.mark.parametrize("cost", mlp.COSTS)
@pytest.mark.parametrize("masked", [False, True])
def test_gradients_of_all_pairs_of_output_and_cost(out, cost, masked):
    draw = np.random.default_rng(7)
    hidden = ("tanh", "softmax", "relu", "sigmoid")
    sizes = [3, 4, 3, 4, 3, 2]
    weights = [np.vstack([draw.random(b), draw.normal(size=(a, b))]) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
    if out in ("identity", "tanh", "relu"):  # outputs between 0 and 1, where logarithms exist
        weights[-1] = np.vstack([np.full(2, 0.4), np.abs(draw.normal(size=(3, 2))) * 0.03])
    net = mlp.Network(weights, hidden, out, ["a", "b"], cost=cost)
    x, y = draw.normal(size=(5, 3)), np.eye(2)[draw.integers(0, 2, 5)]
    masks = [(draw.random(n) < 0.7) / 0.7 for n in sizes[1:-1]] if masked else None
    g, _ = net.gradients(x, y, masks=masks)
    for i, w in enumerate(weights):
        for at in np.ndindex(*w.shape):
            ends = []
            for step in (1e-6, -1e-6):
                moved = [v.copy() for v in weights]
                moved[i][at] += step
                ends.append(mlp.costs(net.forward(x, moved, masks)[-1], y, cost).sum())
            assert g[i][at] == pytest.approx((ends[0] - ends[1]) / 2e-6, rel=1e-4, abs=1e-6)


def test_layers_and_costs_are_checked():
    with pytest.raises(ValueError):
        mlp.Network([np.ones((2, 1))], ["tanh"], "sigmoid", None)
    with pytest.raises(ValueError):
        mlp.Network([np.ones((2, 1))], "tanh", "sigmoid", None, cost="hinge")


def test_every_epoch_takes_every_row_once(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 13), float(i % 7)], "ab"[i % 13 > 6]) for i in range(203)], "k int, x array<double>, y string").repartition(3)
    taken: list[list] = []
    real = mlp.gradient_sums
    monkeypatch.setattr(mlp, "gradient_sums", lambda r, *a: taken.append(sorted(x.key for x in r.select("key").collect())) or real(r, *a))
    net = mlp.MLP((3,), "tanh", optimizer=Optimizer("adam", 0.1), batch=60, epochs=2, seed=3, l2=0.01)
    net.fit(rows, "k", "x", "y", rows.limit(50))
    each = len(taken) // 2
    assert each in (3, 4) and [r["rows"] for r in net.history] == [203, 203] and "test_score" in net.history[0]
    for epoch in (taken[:each], taken[each:]):
        assert sorted(sum(epoch, [])) == list(range(203))
    assert taken[:each] != taken[each:]


def test_training_ends_when_test_rows_are_served_no_better(spark):
    rows = spark.createDataFrame([(i, [float(i % 10)], "ab"[i % 10 > 4]) for i in range(100)], "k int, x array<double>, y string")
    swapped = rows.withColumn("y", F.translate("y", "ab", "ba"))
    net = mlp.MLP((3,), "tanh", optimizer=Optimizer("adam", 0.1), batch=50, epochs=30, seed=1, patience=2)
    net.fit(rows, "k", "x", "y", swapped)
    assert len(net.history) < 30 and net.history[-1]["score"] > net.history[-1]["test_score"]
    fast = mlp.MLP((3,), "tanh", optimizer=Optimizer("sgd", 1e3), steps=6, attenuation=0.5, attenuations=2, patience=99)
    fast.fit(rows, "k", "x", "y")
    assert fast.optimizer.rate >= 1e3 * 0.5**4


def test_mlp_saves_and_goes_on(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i % 2), float(i // 2 % 2)], "ab"[(i % 2) ^ (i // 2 % 2)]) for i in range(40)], "id int, x array<double>, y string")
    trainer = mlp.MLP((6,), "tanh", optimizer=Optimizer("adam", 0.2), steps=15, seed=1)
    net = trainer.fit(df, "id", "x", "y")
    first = trainer.history[-1]["cost"]
    trainer.fit(df, "id", "x", "y")
    assert trainer.history[-1]["cost"] <= first + 1e-9
    net.save(spark, str(tmp_path / "net"))
    again = mlp.Network.load(spark, str(tmp_path / "net"))
    assert again.transform(df, "x").filter("prediction = y").count() == 40


def test_empty_cluster_keeps_its_center(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [5.0, 5.0])], "id int, x array<double>")
    model = cluster.KMeans(2, "first", steps=5).fit(df, "id", "x")
    assert model.centers[1] in ([0.0, 0.0], [5.0, 5.0]) and len(model.centers) == 2


def test_dbscan_and_average_linkage(spark):
    rows = [(i, [float(i % 5) * 0.1 + (10.0 if i >= 5 else 0.0), 0.0]) for i in range(10)] + [(10, [100.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, x array<double>")
    found = {r.id: r.prediction for r in cluster.DBSCAN(0.15, 2).fit_predict(df, "id", "x").collect()}
    assert len({found[i] for i in range(5)}) == 1 and len({found[i] for i in range(5, 10)}) == 1 and found[10] == -1 and found[0] != found[9]
    merged = {r.id: r.prediction for r in cluster.Agglomerative(3).fit_predict(df, "id", "x").collect()}
    assert merged == {i: 0 if i < 5 else 1 if i < 10 else 2 for i in range(11)}


@pytest.mark.parametrize("scale", [1.0, 1e-30, 1e20])
def test_dunn_takes_single_precision_as_a_hint_only(spark, monkeypatch, scale):
    """Products of single precision tell which pairs could be the least; differences settle it. Groups of copies and a far row."""
    monkeypatch.setattr(cluster, "LEAST", 60)
    monkeypatch.setattr(cluster, "MANY", 8)
    draw = np.random.default_rng(3)
    x, g = draw.normal(size=(200, 6)), draw.integers(0, 3, 200)
    x[:40], x[41], x[199] = 5.0, x[40] + 1e-5, 300.0
    g[:40], g[40], g[41], x = 0, 1, 2, x * scale
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    same, other = g[:, None] == g[None], g[:, None] != g[None]
    df = spark.createDataFrame([(i, x[i].tolist(), int(g[i])) for i in range(200)], "id int, x array<double>, g int")
    singles, real = [], cluster.block_pairs
    watched = lambda df, key, point, group, fold, *rest, **more: real(df, key, point, group, lambda pairs: {**fold(pairs), "single": [pairs.products()[0][0].dtype == np.float32]}, rest[0] + ", single boolean", *rest[1:], **more)
    monkeypatch.setattr(cluster, "block_pairs", lambda *a, **k: singles.append(watched(*a, **k)) or singles[0])
    assert cluster.dunn(df, "id", "x", "g").first().dunn == pytest.approx(d[other].min() / d[same].max(), rel=1e-9)
    assert all(r.single for r in singles[0].select("single").collect())


def test_groups_meet_only_themselves_for_compactness(spark, monkeypatch):
    """Blocks of one large group meet each other, small groups share blocks, and no two large ones meet."""
    monkeypatch.setattr(cluster, "LEAST", 10)
    monkeypatch.setattr(cluster, "TILE", (8, 16))
    monkeypatch.setattr(cluster, "CELLS", 1)
    draw = np.random.default_rng(5)
    x, g = draw.normal(size=(180, 3)), [*["a"] * 60, *["b"] * 70, *(f"c{i % 12}" for i in range(40)), *[None] * 10]
    df = spark.createDataFrame([(i, x[i].tolist(), g[i]) for i in range(180)], "id int, x array<double>, g string")
    met, real = [], cluster._grouped
    monkeypatch.setattr(cluster, "_grouped", lambda *a: met.append(real(*a)) or met[0])
    names = {v for v in g if v is not None}
    inner = [[np.linalg.norm(x[i] - x[j]) for i in range(180) for j in range(i) if g[i] == g[j] == name] for name in names]
    assert cluster.compactness(df.filter("g is not null"), "id", "x", "g").first().compactness == pytest.approx(np.mean([np.mean(d) for d in inner]))
    rows, pairs = met[0]
    blocks = {r.block: set() for r in rows.select("block").collect()}
    for r in rows.collect():
        blocks[r.block].add(r.group)
    assert len(blocks) > 12 and all(r.i == r.j or blocks.get(r.i, set()) & blocks.get(r.j, set()) or not blocks.get(r.i) or not blocks.get(r.j) for r in pairs.collect())
    assert pairs.count() < len(blocks) * (len(blocks) + 1) / 3


@pytest.mark.parametrize("far", [0.0, 1e6])
def test_neighbours_at_the_edge_of_eps_come_from_differences(spark, monkeypatch, far):
    monkeypatch.setattr(cluster, "LEAST", 40)
    x = [[0.1 * i, 0.0] for i in range(90)] + [[0.1 * i, 0.3 * (1 + (i - 5) * 2.0**-52)] for i in range(10)] + [[far + 50.0, 0.0]]
    d = np.sqrt(((np.array(x)[:, None] - np.array(x)[None]) ** 2).sum(2))
    df = spark.createDataFrame(list(enumerate(x)), "id int, x array<double>")
    wanted = {i: int((d[i] <= 0.3).sum()) - 1 for i in range(len(x))}
    assert {r.id: r.n for r in cluster.DBSCAN(0.3, 3).cores(df, "id", "x").collect()} == wanted
    assert {(r.a_id, r.b_id) for r in cluster.DBSCAN(0.3, 3).neighbours(df, "id", "x").collect()} == {(i, j) for i, j in zip(*np.nonzero(d <= 0.3), strict=True) if i != j}
    assert callable(cluster.Pairs.near)


def test_ratings_of_four_users(spark):
    matrix = [[4, 0, 3, 0], [0, 2, 0, 0], [3, 0, 3, 4], [5, 0, 0, 0]]
    df = spark.createDataFrame([(u, i, float(v)) for u, r in enumerate(matrix) for i, v in enumerate(r) if v], "user int, item int, rating double")
    s = {(r.x, r.y): r.s for r in recommend.similarities(df, "user", "item").collect()}
    assert s[0, 2] == pytest.approx(21 / (5 * np.sqrt(34))) and (0, 1) not in s
    scores = {(r.user, r.item): r.score for r in recommend.user_cf(df, 2).collect()}
    s03, s02 = s[0, 3], s[0, 2]
    assert scores[0, 3] == pytest.approx(s02 * 4 / (s02 + s03))
    assert all((u, i) not in scores for u, r in enumerate(matrix) for i, v in enumerate(r) if v)


@pytest.mark.parametrize("kind", ["cosine", "distance"])
def test_nearest_users_agree_with_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(recommend, "BLOCK", 4)
    draw = np.random.default_rng(4)
    x = np.where(draw.random((40, 12)) < 0.3, draw.integers(1, 6, (40, 12)), 0).astype(float)
    x[7], x[8], x[20:24] = x[3], 2 * x[3], [0] * 10 + [5, 1]
    frame = lambda rows: spark.createDataFrame([(u, f"i{i}", float(v)) for u, r in rows for i, v in enumerate(r) if v], "user int, item string, rating double")
    seen, other = frame(list(enumerate(x))), frame([(100 + u, x[u]) for u in range(0, 40, 3)])
    for queries, known in ((None, {u: x[u] for u in range(40)}), (other, {100 + u: x[u] for u in range(0, 40, 3)})):
        wanted = set()
        for u, a in known.items():
            found = []
            for v, b in enumerate(x):
                if a.any() and b.any():
                    s = a @ b / np.sqrt((a @ a) * (b @ b)) if kind == "cosine" else 1 / (1 + np.sqrt(max(0, a @ a + b @ b - 2 * a @ b)))
                    found.append((-round(s, 10), v)) if 0 < round(s, 10) < 1 else None
            wanted |= {(u, v, i + 1) for i, (_, v) in enumerate(sorted(found)[:3])}
        assert {(r.x, r.y, r["rank"]) for r in recommend.nearest_users(seen, 3, kind, queries).collect()} == wanted


def test_blocks_that_cannot_help_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(recommend, "BLOCK", 5)
    rows = [(100 * g + u, f"{g}/{i}", float(1 + (u * i) % 5)) for g in range(8) for u in range(5) for i in range(4)]
    seen = spark.createDataFrame(rows, "user int, item string, rating double")
    met = []
    real = recommend._matched
    monkeypatch.setattr(recommend, "_matched", lambda x, y, pairs, *a: met.append(pairs.count()) or real(x, y, pairs, *a))
    assert recommend.nearest_users(seen, 2).filter("floor(x / 100) <> floor(y / 100)").count() == 0
    blocks = recommend._blocked(seen).select("block").distinct().count()
    assert met[0] == blocks and sum(met) < blocks * blocks / 2


def test_pairs_of_blocks_are_dealt_over_tasks(spark, monkeypatch):
    """Packed blocks have few bytes, which must not put them all into one task."""
    monkeypatch.setattr(recommend, "BLOCK", 4)
    seen = spark.createDataFrame([(u, i, float(1 + (u * i + u // 5) % 5)) for u in range(40) for i in range(6)], "user int, item int, rating double")
    tasks = []
    real = recommend._matched
    monkeypatch.setattr(recommend, "_matched", lambda *a: tasks.append((out := real(*a)).rdd.getNumPartitions()) or out)
    recommend.nearest_users(seen, 3).collect()
    assert len(tasks) == 2 and min(tasks) >= 4 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("kind", ["cosine", "distance"])
def test_single_precision_settles_nothing(monkeypatch, kind):
    """Rows that differ by less than single precision tells, ties, negative ratings, items in several parts, known orders."""
    import pyarrow as pa

    monkeypatch.setattr(recommend, "ITEMS", 5)
    monkeypatch.setattr(recommend, "TILE", (7, 16))
    draw = np.random.default_rng(3)
    x = np.where(draw.random((150, 12)) < 0.5, draw.integers(1, 6, (150, 12)), 0).astype(float)
    x[40:80] = x[3] + draw.random((40, 12)) * 1e-3
    x[90:100, :2] *= -1
    x[:, 0] += ~x.any(1)
    row, item = np.nonzero(x)
    block = pa.array(np.arange(150)), (x * x).sum(1), row, pa.array([f"i{i}" for i in item]), x[row, item]
    found = {}
    for least in (np.full(150, -(1 << 62)), None):
        task = recommend.Nearest(block, block, 6, kind)
        r, c, s = task.best(known if least is None else least)
        got = {i: sorted((-round(v, 9), j) for v, j in zip(s[r == i], c[r == i].tolist(), strict=True)) for i in range(150)}
        known = np.array([np.rint(s[r == i].min() * 1e10) for i in range(150)]).astype(np.int64)
        found = found or got
        assert got == found
    n = (x * x).sum(1)
    s = x @ x.T / np.sqrt(n[:, None] * n[None]) if kind == "cosine" else 1 / (1 + np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)))
    for i in range(150):
        wanted = sorted(-v for v in s[i] if v != 0 and np.rint(v * 1e10) != 10**10)[:6]
        assert [v for v, _ in found[i]] == pytest.approx(wanted, abs=1e-7)


@pytest.mark.parametrize("other", [False, True])
def test_copies_of_users_are_compared_once(spark, monkeypatch, other):
    """Users with the same ratings are one row of a block, and each of them can serve others."""
    monkeypatch.setattr(recommend, "BLOCK", 4)
    draw = np.random.default_rng(8)
    x = np.tile(np.where(draw.random((10, 6)) < 0.5, draw.integers(1, 6, (10, 6)), 0).astype(float), (7, 1))
    x[:, 0] += x.sum(1) == 0
    seen = spark.createDataFrame([(u, i, float(v)) for u, r in enumerate(x) for i, v in enumerate(r) if v], "user int, item int, rating double")
    compared = []
    real = recommend._matched
    monkeypatch.setattr(recommend, "_matched", lambda a, b, *rest: compared.append(a.count()) or real(a, b, *rest))
    found = {(r.user, r.item): r.score for r in recommend.user_cf(seen, 3, "distance", seen if other else None).collect()}
    s = 1 / (1 + np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)))
    wanted = {}
    for u in range(len(x)):
        near = sorted((-round(s[u, v], 10), v) for v in range(len(x)) if round(s[u, v], 10) < 1)[:3]
        for i in np.flatnonzero((x[u] == 0) & (x[[v for _, v in near]].sum(0) > 0)):
            wanted[u, int(i)] = sum(s[u, v] * x[v, i] for _, v in near) / sum(s[u, v] for _, v in near)
    assert found == pytest.approx(wanted) and max(compared) == 10


def test_unseen_users_are_served_by_a_stored_table(spark, tmp_path):
    seen = spark.createDataFrame([(u, i, float(v)) for u, r in enumerate([[4, 0, 3, 0], [0, 2, 0, 0], [3, 0, 3, 4], [5, 0, 0, 0]]) for i, v in enumerate(r) if v], "user int, item int, rating double")
    recommend.item_neighbours(seen, 2).write.parquet(str(tmp_path / "near"))
    near = spark.read.parquet(str(tmp_path / "near"))
    s = {(r.x, r.y): r.s for r in near.collect()}
    scores = {(r.user, r.item): r.score for r in recommend.fold_in(near, spark.createDataFrame([(9, 0, 2.0), (8, 1, 5.0)], "user int, item int, rating double")).collect()}
    assert scores[9, 3] == pytest.approx(2 * s[0, 3] / (s[0, 3] + s[2, 3])) and all(u == 9 for u, _ in scores)


def test_outliers_score_high(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(200)] + [(200, 1000.0)], "id int, x double")
    model = isolation.IsolationForest(15, 64, 1).fit(df, ["x"], "id")
    best = df.withColumn("s", model.score()).orderBy(F.desc("s")).first()
    assert best.id == 200 and model.to_text().startswith("tree 0")


def test_idx_cifar_and_png(spark, tmp_path):
    pixels = np.arange(2 * 3 * 4, dtype=np.uint8).reshape(2, 3, 4)
    (tmp_path / "i").write_bytes(struct.pack(">IIII", 2051, 2, 3, 4) + pixels.tobytes())
    (tmp_path / "l").write_bytes(struct.pack(">II", 2049, 2) + bytes([7, 1]))
    rows = images.read_idx(spark, str(tmp_path / "i"), str(tmp_path / "l"))
    got = {r.id: r for r in rows.collect()}
    assert got[0].label == "7" and got[1].shape == [3, 4] and got[1].pixels == pixels[1].ravel().tolist()
    images.write_pngs(rows, str(tmp_path / "png"))
    back = {r.id: r for r in images.read_pngs(spark, str(tmp_path / "png")).collect()}
    assert back[1].label == "1" and back[1].pixels == pixels[1].ravel().tolist()
    record = bytes([3]) + bytes(1024) + bytes([9]) * 1024 + bytes([5]) * 1024
    (tmp_path / "c").write_bytes(record)
    row = images.read_cifar(spark, str(tmp_path / "c")).first()
    assert row.label == "cat" and row.pixels[:3] == [0.0, 9.0, 5.0] and row.shape == [32, 32, 3]


def test_generators_and_readers(spark, tmp_path):
    assert tables.blobs(spark, 30, [[0, 0], [9, 9]], 0.1).groupBy("label").count().count() == 2
    assert tables.circles(spark, 20).count() == 20 and tables.moons(spark, 20).count() == 20
    (tmp_path / "x.csv").write_text("1,2.5,a\n3,4.5,b\n")
    assert tables.read_delimited(spark, str(tmp_path / "x.csv"), "a int, b double, c string").collect()[1].c == "b"


def test_checks():
    with pytest.raises(TypeError):
        validate.of_type(1, float)
    with pytest.raises(ValueError):
        validate.within(1.5, 0, 1)


def test_table_checks(spark):
    df = spark.createDataFrame([(1, None), (1, "x")], "a int, b string")
    with pytest.raises(ValueError):
        validate.no_nulls(df, ["b"])
    with pytest.raises(ValueError):
        validate.unique_key(df, "a")
    with pytest.raises(ValueError):
        validate.columns(df, ["a", "c"])
    with pytest.raises(TypeError):
        validate.continuity(spark.sql("SELECT date'2020-01-01' AS d"), ["d"])


def test_cross_terms(spark):
    row = spark.createDataFrame([(2.0, 3.0)], "a double, b double").select(*C.polynomials(["a", "b"], 3, cross=True)).first().asDict()
    assert row == {"a^2": 4.0, "a^3": 8.0, "b^2": 9.0, "b^3": 27.0, "a^1_b^1": 6.0, "a^1_b^2": 18.0, "a^2_b^1": 12.0}


# sources, streams and checks

def test_databases_are_read_and_written(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/store;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = tables.literal(spark, [(1, "a"), (2, None)], "k int, v string")
    tables.write_sql(rows, url, "things", "overwrite", **driver)
    tables.write_sql(rows, url, "things", **driver)
    found = tables.read_sql(spark, url, 'SELECT "k", "v" FROM things WHERE "k" > 1', **driver)
    assert [tuple(r) for r in found.collect()] == [(2, None), (2, None)]


def test_white_space_separates_columns(spark, tmp_path):
    (tmp_path / "rows.txt").write_text("1.5\t\t2\n  3.25 4 \n\n-1.0 \t 0\nx 7\n")
    found = tables.read_whitespace(spark, f"{tmp_path}/rows.txt", "a double, b int").collect()
    assert sorted(map(tuple, found), key=str) == sorted([(1.5, 2), (3.25, 4), (-1.0, 0), (None, 7)], key=str)


def test_catalogue_and_literals(spark):
    tables.literal(spark, [(1, "a")], "k int, v string").createOrReplaceTempView("catalogued")
    assert "default" in {r[0] for r in tables.databases(spark).collect()}
    assert ("catalogued", True) in {(r.name, r.temporary) for r in tables.tables(spark).collect()}
    assert [tuple(r) for r in tables.columns(spark, "catalogued").collect()] == [("k", "int", True), ("v", "string", True)]
    assert tables.literal(spark, [], "k int").count() == 0


def test_drift_counts_predictions_by_window(spark, tmp_path):
    from sparkloom.operators import linear
    from sparkloom.streaming import scoring

    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", float(m)) for h in range(4) for m in (0, 20, 40)]
    frame = spark.createDataFrame(rows, "t string, x double").select(F.col("t").cast("timestamp").alias("t"), "x")
    frame.write.parquet(f"{tmp_path}/in")
    model = linear.LinearModel(["x"], np.array([0.0, 1.0]))
    stream = scoring.score_stream(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"), model)
    drift = scoring.score_drift(stream.withColumn("prediction", F.col("prediction") > 30), "t")
    query = drift.writeStream.outputMode("complete").format("memory").queryName("drift").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = {(r.start.hour, r.prediction): r.n for r in spark.table("drift").collect()}
    assert found == {(h, p): 1 if p else 2 for h in range(4) for p in (True, False)}


def test_columns_are_matched(spark):
    from sparkloom import validate

    df = spark.createDataFrame([(1, 2)], "a int, b int")
    for how, good, bad in (("len", ["x", "y"], ["a"]), ("left", ["a", "b", "c"], ["a"]), ("right", ["a"], ["c"]), ("equal", ["b", "a"], ["a"])):
        validate.columns(df, good, how)
        with pytest.raises(ValueError):
            validate.columns(df, bad, how)


def test_one_class_is_predicted_always(spark):
    from sparkloom.operators import linear
    from sparkloom.operators.optimizers import Optimizer

    rows = spark.createDataFrame([(float(i), "only") for i in range(5)] + [(9.0, None)], "x double, y string")
    for mode in ("ovr", "ovo"):
        model = linear.LogisticRegression(mode, optimizer=Optimizer("sgd", 0.5), steps=2).fit(rows, ["x"], "y")
        assert {r[0] for r in model.transform(rows).select("prediction").collect()} == {"only"} and model.theta.shape == (1, 2)
        with pytest.raises(ValueError):
            linear.LogisticRegression(mode).fit(rows.filter("y is null"), ["x"], "y")


def test_inner_metrics_by_name(spark):
    from sparkloom.operators import cluster

    draw = np.random.default_rng(3)
    points = [(i, (draw.normal(size=3) + 6 * (i % 3)).tolist(), i % 3) for i in range(60)]
    df = spark.createDataFrame(points, "k long, p array<double>, g int")
    x, g = np.array([p for _, p, _ in points]), np.array([c for _, _, c in points])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    same = g[:, None] == g[None]
    assert cluster.assess_inner(df, "k", "p", "g", "dvi") == pytest.approx(d[~same].min() / d[same].max())
    a = np.array([d[i][same[i]].sum() / (same[i].sum() - 1) for i in range(60)])
    b = np.array([min(d[i][g == c].mean() for c in range(3) if c != g[i]) for i in range(60)])
    assert cluster.assess_inner(df, "k", "p", "g", "sc") == pytest.approx(((b - a) / np.maximum(a, b)).mean())
    assert cluster.assess_inner(df, "k", "p", "g", "cp_sp")[0] == pytest.approx(np.mean([d[np.ix_(g == c, g == c)][np.triu_indices(20, 1)].mean() for c in range(3)]))
    with pytest.raises(ValueError):
        cluster.assess_inner(df, "k", "p", "g", "other")


@pytest.mark.parametrize("eps", [0.3, 0.9, 2.5, 40.0])
def test_neighbours_in_cells_are_all_neighbours(spark, monkeypatch, eps):
    """Cells and blocks lose no pair, on negative and repeated coordinates and in crowded cells."""
    from sparkloom.operators import cluster

    monkeypatch.setattr(cluster, "BLOCK", 7)
    draw = np.random.default_rng(4)
    x = np.concatenate([draw.normal(size=(50, 3)) * 2, np.repeat([[1.0, -1.0, 0.5]], 12, 0)])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "k long, p array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    found = [(r.a_k, r.b_k) for r in cluster.DBSCAN(eps).neighbours(df, "k", "p").collect()]
    assert sorted(found) == [(i, j) for i in range(62) for j in range(62) if i != j and d[i, j] <= eps]


def test_blocks_that_are_apart_do_not_meet(spark, monkeypatch):
    from sparkloom.operators import cluster

    monkeypatch.setattr(cluster, "BLOCK", 10)
    draw = np.random.default_rng(2)
    x = np.concatenate([c + draw.normal(size=(40, 20)) for c in draw.normal(size=(6, 20)) * 30])
    rows = spark.createDataFrame([(i, p.tolist(), 0) for i, p in enumerate(x)], "key long, point array<double>, group int")
    placed, met = cluster._ringed(rows, 4.0)
    blocks = placed.select("block").distinct().count()
    assert blocks >= 20 and met.count() < blocks * blocks / 4 and placed.count() == 240
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert cluster.DBSCAN(4.0).neighbours(rows, "key", "point").count() == int((d <= 4.0).sum()) - 240


def test_pairs_stay_where_blocks_meet(spark, monkeypatch):
    """DBSCAN over many blocks, with copies, noise, border rows and distances of exactly eps; blocks hand on rows, not pairs."""
    from sparkloom.operators import cluster

    monkeypatch.setattr(cluster, "BLOCK", 30)
    monkeypatch.setattr(cluster, "TILE", (8, 16))
    draw = np.random.default_rng(7)
    x = np.concatenate([draw.normal(size=(60, 2)) / 4, np.repeat([[1e3 + 1, 0.25]], 40, 0), 1e3 + draw.normal(size=(20, 2)) * 3, [[-50.0, 0.0], [-49.5, 0.0], [-49.0, 0.0]]])
    keys = draw.permutation(len(x)).tolist()
    df = spark.createDataFrame([(k, p.tolist()) for k, p in zip(keys, x, strict=True)], "k long, p array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = (d <= 0.5) & ~np.eye(len(x), dtype=bool)
    core, label = near.sum(1) >= 2, np.array(keys)
    for _ in range(len(x)):
        label = np.array([min([label[i], *label[near[i] & core]]) if core[i] else label[i] for i in range(len(x))])
    wanted = {}
    for i, k in enumerate(keys):
        around = sorted((d[i, j], keys[j], int(label[j])) for j in np.flatnonzero(near[i] & core))
        wanted[k] = (int(near[i].sum()), int(label[i]) if core[i] else around[0][2] if around else -1)
    handed = []
    real = cluster.written
    monkeypatch.setattr(cluster, "written", lambda *a: handed.append(real(*a)) or handed[-1])
    assert {r.k: (r.n, r.prediction) for r in cluster.DBSCAN(0.5, 2).fit_predict(df, "k", "p").collect()} == wanted
    assert max(t.count() for t in handed) < near.sum() / 2
    labelled = spark.createDataFrame([(k, -1 if k % 3 == 0 else k % 3) for k in keys], "k long, prediction long")
    order = lambda i: min((d[i, j], keys[j]) for j in range(len(x)) if keys[j] % 3)[1] % 3
    assert {r.k: r.prediction for r in cluster.DBSCAN(0.5).noise_to_nearest(df, labelled, "k", "p").collect()} == {k: k % 3 or order(i) for i, k in enumerate(keys)}


def test_linkage_in_rounds_is_linkage_by_steps(spark, monkeypatch):
    from sparkloom.operators import cluster

    monkeypatch.setattr(cluster, "BLOCK", 9)
    draw = np.random.default_rng(6)
    x = draw.normal(size=(30, 3)) + draw.integers(0, 3, (30, 1)) * 3
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    groups = [[i] for i in range(30)]
    while len(groups) > 4:
        a, b = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: d[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[b] += groups.pop(a)
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "k long, p array<double>")
    found: dict[int, list] = {}
    for r in cluster.Agglomerative(4).fit_predict(rows, "k", "p").collect():
        found.setdefault(r.prediction, []).append(r.k)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups)) and sorted(found) == [0, 1, 2, 3]
    assert cluster.Agglomerative(1).fit_predict(rows.limit(1), "k", "p").count() == 1


@pytest.mark.parametrize("share", [0.0, 0.004, 0.5, 1.0])
def test_places_and_products_of_a_tile(share):
    draw = np.random.default_rng(3)
    for n in (0, 5, 8, 4099):
        mask = draw.random(n) < share
        assert (cluster.true_places(mask) == np.flatnonzero(mask)).all()
    room = np.empty(30)
    for rows in (5, 2):  # a smaller tile in the same place
        p, q = draw.normal(size=(rows, 3)), draw.normal(size=(3, 9))[:, 2:8]
        found = cluster.product(p, q, room)
        assert np.allclose(found, p @ q) and np.shares_memory(found, room)


@pytest.mark.parametrize("least", [6, 2000])
def test_average_linkage_stores_few_pairs(spark, monkeypatch, least):
    """Many clusters keep their nearest one, not a table of pairs; copies, clusters over several blocks, the whole tree."""
    monkeypatch.setattr(cluster, "LEFT", 5, raising=False)
    monkeypatch.setattr(cluster, "LEAST", least)
    monkeypatch.setattr(cluster, "BLOCK", 12)
    sizes, written = [], cluster.written

    def counted(df, before=None):
        out = written(df, before)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(cluster, "written", counted)
    draw = np.random.default_rng(8)
    x = draw.normal(size=(40, 3)) + draw.integers(0, 3, (40, 1)) * 2
    x[[7, 20, 33]] = x[4]
    x[30] = x[11]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    groups, heights = [[i] for i in range(40)], []
    while len(groups) > 1:
        h, a, b = min((d[np.ix_(groups[i], groups[j])].mean(), j, i) for i in range(len(groups)) for j in range(i))
        heights.append(h)
        groups[a] += groups.pop(b)
        if len(groups) == 4:
            wanted = sorted(map(sorted, groups))
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "k long, p array<double>").repartition(5)
    model = cluster.Agglomerative(4)
    tree = model.merges(rows, "k", "p")
    monkeypatch.setattr(model, "merges", lambda *_: tree)
    assert np.allclose(sorted(r.height for r in tree.collect()), heights)
    assert max(sizes) <= 40
    found: dict[int, list] = {}
    for r in model.fit_predict(rows, "k", "p").collect():
        found.setdefault(r.prediction, []).append(r.k)
    assert sorted(map(sorted, found.values())) == wanted


def test_average_linkage_of_equal_distances(spark, monkeypatch):
    """On a grid nearly all nearest clusters are tied; each round still merges."""
    monkeypatch.setattr(cluster, "LEFT", 3, raising=False)
    rows = spark.createDataFrame([(i, [i % 5 * 0.1, i // 5 * 0.1, 0.7]) for i in range(25)], "k long, p array<double>")
    found = cluster.Agglomerative(1).merges(rows, "k", "p").collect()
    assert len(found) == 24 and len({r.b for r in found}) == 24 and all(r.a < r.b for r in found)


def test_description_length_counts_against_thresholds(spark):
    """The number and the name separate the classes equally well, but the number has many thresholds to name."""
    from sparkloom.operators import tree

    rows = [(float(i), "u" if (i < 10) != (i == 3) else "v", int(i < 10)) for i in range(20)]
    rows = [(x if i not in (4,) else 19.5, n, y) for i, (x, n, y) in enumerate(rows)]
    df = spark.createDataFrame(rows, "x double, n string, y int")
    plain = tree.DecisionTree("c45", depth_max=1).fit(df, ["x", "n"], "y")
    less = tree.DecisionTree("c45", depth_max=1, mdl_penalty=True).fit(df, ["x", "n"], "y")
    assert plain.nodes[1].feature == "x" and less.nodes[1].feature == "n"
    wide = spark.createDataFrame([(f"c{i % 13}", i % 2) for i in range(52)], "n string, y int")
    with pytest.raises(ValueError):
        tree.DecisionTree("gini", subsets=True).fit(wide, ["n"], "y")


def test_pruning_by_name(spark):
    from sparkloom.operators import tree

    draw = np.random.default_rng(5)
    rows = [(float(v), int((v > 0.5) != (draw.random() < 0.2))) for v in draw.random(120)]
    df = spark.createDataFrame(rows, "x double, y int")
    model = tree.DecisionTree("gini", depth_max=4).fit(df, ["x"], "y")
    for how, direct in (("rep", tree.prune_rep(model, df, "y")), ("ccp", tree.prune_ccp(model, df, "y")), ("pep", tree.prune_pep(model))):
        cut = tree.prune(model, how, df, "y")
        assert len(cut.nodes) == len(direct.nodes) and cut is not model
    with pytest.raises(ValueError):
        tree.prune(model, "rep")
    with pytest.raises(ValueError):
        tree.prune(model, "none", df, "y")
