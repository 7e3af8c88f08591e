"""Decision trees that are grown a level at a time: one job serves all open nodes of all trees.

Rows are never moved into nodes; a CASE expression over the features says where a row is. A level's job sums weights
by (tree, node, feature, value) and finds each feature's best threshold with prefix sums; the driver sees one row for
each open node and feature, and the categories of discrete features, which become part of the model anyway."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.columns import entropy, gini, total
from sparkloom.operators.keep import discard, written
from sparkloom.operators.walk import Walker
from sparkloom.validate import columns as check_columns
from sparkloom.validate import continuity, no_nulls, of_type

CRITERIA = ("id3", "c45", "gini", "variance")
MAX_CATEGORIES, MAX_SUBSET_CATEGORIES = 1000, 12
NODE_SCHEMA = "nid int, depth int, parent int, childs array<int>, sample_n long, error double, is_leaf boolean, feature string, op string, value array<string>, sums array<double>, output double, label string, proba map<string,double>"


@dataclass
class Node:
    """op and value say how a row gets here from the parent: '<=' or '>' a number, 'in' or 'not in' a list of labels.
    sums: weight of each class, or of 1, y and y * y."""

    nid: int
    depth: int
    parent: int
    sample_n: int
    sums: tuple[float, ...]
    feature: str | None = None
    op: str | None = None
    value: object = None
    childs: list[int] = field(default_factory=list)
    used: frozenset = frozenset()

    def condition(self) -> Column:
        x = F.col(f"`{self.feature}`")
        if self.op in ("<=", ">"):
            return x <= F.lit(float(self.value)) if self.op == "<=" else x > F.lit(float(self.value))
        among = x.cast("string").isin([str(v) for v in self.value])
        return among if self.op == "in" else ~among


def impurity(sums: Sequence[float], criterion: str) -> float:
    """Times nothing: entropy in bits, gini index, or variance of y about its weighted mean."""
    if criterion == "variance":
        w, s, q = sums
        return max(0.0, q / w - (s / w) ** 2) if w > 0 else 0.0
    w = sum(sums)
    shares = [x / w for x in sums if x > 0] if w > 0 else []
    return 1 - sum(p * p for p in shares) if criterion == "gini" else -sum(p * math.log2(p) for p in shares)


def children_impurity(parts: Sequence[Sequence[float]], criterion: str) -> float:
    """The parts' impurities, weighted by their shares."""
    mass = [p[0] if criterion == "variance" else sum(p) for p in parts]
    whole = sum(mass)
    return sum(m * impurity(p, criterion) for m, p in zip(mass, parts, strict=True)) / whole if whole else 0.0


def impurity_column(sums: Sequence[Column], criterion: str) -> tuple[Column, Column]:
    """(weight, impurity) of sums."""
    if criterion == "variance":
        w, s, q = sums
        return w, F.coalesce(F.greatest(F.lit(0.0), F.try_divide(q, w) - F.pow(F.try_divide(s, w), F.lit(2.0))), F.lit(0.0))
    w = total(sums)
    shares = [F.coalesce(F.try_divide(x, w), F.lit(0.0)) for x in sums]
    return w, gini(shares) if criterion == "gini" else entropy(shares)


def sum_columns(label: str, weight: Column, classes: Sequence[str] | None) -> list[Column]:
    """Aggregates that make up sums."""
    if classes is None:
        y = F.col(label).cast("double")
        return [F.sum(weight), F.sum(weight * y), F.sum(weight * y * y)]
    return [F.sum(F.when(F.col(label).cast("string") == c, weight).otherwise(0.0)) for c in classes]


def thresholds(values: DataFrame, keys: Sequence[str], sums: Sequence[str], classes: bool, screen: bool = True, tables: list | None = None) -> DataFrame:
    """keys, value, after, n_left, l_<sum>, t_<sum>, thresholds for each place between neighbouring values of a key, from
    values (keys, value, n, sums): the sums up to the place and of all, and how many places there are.

    Prefix sums have two levels: values lie in ranges of (keys, value), which tasks sort and sum up by themselves; the
    totals of ranges, of which there are few, are carried over to the ranges behind. So no task sees a whole feature.
    With screen (for classes), places between two values that have one and the same class are left out, also where
    they lie between two ranges: no such place is the best. The ranges are a written table; callers that discard it
    after use pass a list that gets it."""
    names = ["n", *sums]
    held = [F.when(F.col(s) > 0, 1).otherwise(0) for s in sums]
    only = F.when(total(held) == 1.0, total([i * h for i, h in enumerate(held)])).otherwise(-1.0) if classes and screen else F.lit(-1.0)
    ranges = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(values.select(*keys, "value", *names, only.alias("only")).repartitionByRange(ranges, *keys, "value").withColumn("range", F.spark_partition_id()))
    if tables is not None:
        tables.append(rows)
    across = Window.partitionBy(*keys).orderBy("range")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, "range").agg(F.count("*").alias("m"), F.min(F.struct("value", "only")).alias("first"), *[F.sum(c).alias(c) for c in names])
    ends = ends.select(*[F.col(k).alias(f"its {k}") for k in [*keys, "range"]], F.lead("first").over(across).alias("next"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"b_{c}") for c in names], *[F.sum(s).over(Window.partitionBy(*keys)).alias(f"t_{s}") for s in sums], (F.sum("m").over(Window.partitionBy(*keys)) - 1).alias("thresholds"))
    inside = Window.partitionBy(*keys, "range").orderBy("value")
    along = inside.rowsBetween(Window.unboundedPreceding, 0)
    scan = rows.select(*keys, "range", "value", "only", F.lead(F.struct("value", "only")).over(inside).alias("following"), *[F.sum(c).over(along).alias(f"l_{c}") for c in names])
    scan = scan.join(ends, [F.col(k) == F.col(f"its {k}") for k in [*keys, "range"]]).withColumn("following", F.coalesce("following", "next")).filter("following is not null")
    scan = scan.filter("only < 0 or only <> following.only") if classes and screen else scan
    sides = [(F.col(f"l_{c}") + F.col(f"b_{c}")).alias("n_left" if c == "n" else f"l_{c}") for c in names]
    return scan.select(*keys, "value", F.col("following.value").alias("after"), *sides, *[f"t_{s}" for s in sums], "thresholds")


def split_scan(values: DataFrame, keys: Sequence[str], sums: Sequence[str], criterion: str, screen: bool = True, tables: list | None = None) -> DataFrame:
    """keys, score, threshold, n_left, left, thresholds (how many there are), scored (how many were compared): the best
    binary split of each key's rows, from values (keys, value, n, sums).

    Thresholds lie midway between neighbouring values; of equal scores (to ten digits) the lowest threshold wins."""
    scan = thresholds(values, keys, sums, criterion != "variance", screen, tables)
    criterion = "entropy" if criterion in ("id3", "c45") else criterion
    (wl, il), (wr, ir) = (impurity_column(x, criterion) for x in ([F.col(f"l_{s}") for s in sums], [F.col(f"t_{s}") - F.col(f"l_{s}") for s in sums]))
    score = F.round(F.try_divide(wl * il + wr * ir, wl + wr), 10)
    best = scan.groupBy(*keys).agg(F.min(F.struct(score.alias("score"), ((F.col("value") + F.col("after")) / 2).alias("threshold"), "n_left", F.array(*[F.col(f"l_{s}") for s in sums]).alias("left"))).alias("x"), F.first("thresholds").alias("thresholds"), F.count("*").alias("scored"))
    return best.select(*keys, "x.*", "thresholds", "scored")


class TreeModel:
    """A tree as a list of nodes; node 0 is the root and a node's number is its place."""

    def __init__(self, nodes: list[Node], classes: list[str] | None, criterion: str) -> None:
        self.nodes, self.classes, self.criterion = nodes, classes, criterion

    # structure
    def leaves(self, nid: int = 0) -> list[int]:
        kids = self.nodes[nid].childs
        return [leaf for k in kids for leaf in self.leaves(k)] if kids else [nid]

    def path(self, nid: int) -> list[int]:
        return [nid] if nid == 0 else [*self.path(self.nodes[nid].parent), nid]

    def depth(self, nid: int = 0) -> int:
        return max(self.nodes[leaf].depth for leaf in self.leaves(nid)) - self.nodes[nid].depth

    def features(self) -> set[str]:
        return {n.feature for n in self.nodes if n.feature}

    def cut(self, nid: int) -> TreeModel:
        """A copy in which the node is a leaf; the others are numbered anew, breadth first."""
        return cut_all(self, {nid})

    # values
    def error(self, nid: int) -> float:
        """Weight that the node's output gets wrong, or its sum of squares."""
        s = self.nodes[nid].sums
        return sum(s) - max(s) if self.classes else impurity(s, "variance") * s[0]

    def proba(self, nid: int) -> list[float]:
        s = self.nodes[nid].sums
        return [x / sum(s) for x in s] if sum(s) else [1 / len(s)] * len(s)

    def output(self, nid: int) -> float | str:
        """Mean of y, or the class of most weight (the first of equal ones)."""
        s = self.nodes[nid].sums
        return self.classes[s.index(max(s))] if self.classes else (s[1] / s[0] if s[0] else 0.0)

    # prediction
    def route(self) -> Column:
        """Number of the deepest node that a row reaches: a leaf, or where its category is unknown."""

        def walk(nid: int) -> Column:
            out = None
            for child in self.nodes[nid].childs:
                out = (F if out is None else out).when(self.nodes[child].condition(), walk(child))
            return F.lit(nid) if out is None else out.otherwise(F.lit(nid))

        return walk(0)

    def predict(self) -> Column:
        return F.get(F.array(*[F.lit(self.output(n.nid)) for n in self.nodes]), self.route())

    def predict_proba(self) -> Column:
        """Shares of the classes, in their order."""
        return F.get(F.array(*[F.array(*[F.lit(p) for p in self.proba(n.nid)]) for n in self.nodes]), self.route())

    def decision_path(self) -> Column:
        return F.get(F.array(*[F.array(*[F.lit(i) for i in self.path(n.nid)]) for n in self.nodes]), self.route())

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        check_columns(df, sorted(self.features()))
        return df.withColumn(prediction, self.predict())

    def matched(self) -> Column:
        """Whether a row reaches a leaf; one with an unknown category or a null may not."""
        return ~self.route().isin([n.nid for n in self.nodes if n.childs]) if len(self.nodes) > 1 else F.lit(True)

    def transform_filled(self, df: DataFrame, key: str, prediction: str = "prediction", seed: int = 0) -> DataFrame:
        """As transform(), but rows that reach no leaf get a class drawn from those predicted for the others, in proportion to
        their numbers (from the root's shares if there are no others), by a hash of seed and key: the draw doesn't depend
        on partitions."""
        check_columns(df, sorted(self.features()))
        rows = df.withColumn(prediction, F.when(self.matched(), self.predict()))
        counts = dict(rows.groupBy(prediction).agg(F.count("*")).filter(F.col(prediction).isNotNull()).collect())  # one row for each class
        shares = [counts.get(c, 0) for c in self.classes] if counts else self.proba(0)
        u = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)) / float(1 << 40)
        drawn, below = F.lit(self.classes[max(i for i, n in enumerate(shares) if n)]), sum(shares)
        for c, n in reversed(list(zip(self.classes, shares, strict=True))):
            below -= n
            drawn = F.when(u < (below + n) / sum(shares), c).otherwise(drawn) if n else drawn
        return rows.withColumn(prediction, F.coalesce(prediction, drawn))

    def flow_to(self, df: DataFrame, nid: int) -> DataFrame:
        """The rows that pass through a node. The conditions are plain predicates, so scans can use them."""
        for step in self.path(nid)[1:]:
            df = df.filter(self.nodes[step].condition())
        return df

    # storage
    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = []
        for n in self.nodes:
            value = None if n.value is None else [str(v) for v in (n.value if isinstance(n.value, (list, tuple)) else [repr(float(n.value))])]
            out = self.output(n.nid)
            rows.append((n.nid, n.depth, n.parent, n.childs, n.sample_n, float(self.error(n.nid)), not n.childs, n.feature, n.op, value, [float(x) for x in n.sums], None if self.classes else float(out), out if self.classes else None, dict(zip(self.classes, [round(p, 4) for p in self.proba(n.nid)], strict=True)) if self.classes else None))
        return spark.createDataFrame(rows, NODE_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        head = spark.createDataFrame([(self.classes, self.criterion)], "classes array<string>, criterion string")
        self.to_df(spark).write.parquet(f"{path}/nodes")
        head.write.parquet(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TreeModel:
        head = spark.read.parquet(f"{path}/model").first()
        nodes = []
        for r in spark.read.parquet(f"{path}/nodes").orderBy("nid").collect():
            value = None if r.value is None else float(r.value[0]) if r.op in ("<=", ">") else list(r.value)
            nodes.append(Node(r.nid, r.depth, r.parent, r.sample_n, tuple(r.sums), r.feature, r.op, value, list(r.childs)))
        return TreeModel(nodes, head.classes, head.criterion)

    def to_text(self) -> str:
        """One line for each node, indented by depth."""

        def line(nid: int) -> list[str]:
            n = self.nodes[nid]
            how = "all" if n.feature is None else f"{n.feature} {n.op} {n.value}"
            return ["  " * n.depth + f"[{nid}] {how}: {self.output(nid)} (n={n.sample_n}, error={self.error(nid):.4g})", *(x for c in n.childs for x in line(c))]

        return "\n".join(line(0))


@dataclass
class Growth:
    """How trees grow. criterion: id3 (information gain, each category a child), c45 (gain ratio), gini or variance.
    features_use: all, sqrt, log2, a share or a number of features that each node may use, drawn by hash of seed, tree
    and node. subsets: try all two-part divisions instead of one against the rest; more than 12 categories raise.
    mdl_penalty: c45's gain on a number is less by the bits that name its threshold, log2(thresholds) / rows."""

    criterion: str = "gini"
    depth_max: int = 5
    split_sample_n: int = 2
    leaf_sample_n: int = 1
    features_use: str | int | float = "all"
    features_reuse: bool = True
    subsets: bool = False
    max_bins: int | None = None
    seed: int = 0
    mdl_penalty: bool = False

    def count(self, n: int) -> int:
        use = self.features_use
        found = {"all": n, "sqrt": int(math.sqrt(n)), "log2": int(math.log2(n))}[use] if isinstance(use, str) else int(use * n) if isinstance(use, float) else use
        return max(1, min(n, found))

    def allowed(self, features: Sequence[str], tree: int, node: Node) -> list[str]:
        import hashlib

        free = [f for f in features if self.features_reuse or f not in node.used]
        n = self.count(len(features))
        if n >= len(free):
            return free
        return sorted(sorted(free, key=lambda f: hashlib.md5(f"{self.seed}/{tree}/{node.nid}/{f}".encode()).digest())[:n], key=list(features).index)


def binned(df: DataFrame, names: Sequence[str], bins: int) -> DataFrame:
    """Continuous columns moved up to the next of their `bins` quantiles, so that scans see few values."""
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), [i / bins for i in range(1, bins + 1)], 100 * bins).alias(c) for c in names]).first()
    for c in names:
        cuts = F.array(*[F.lit(float(x)) for x in sorted(set(row[c]))])
        df = df.withColumn(c, F.element_at(F.filter(cuts, _at_least(c)), 1))
    return df


def _at_least(column: str) -> Callable[[Column], Column]:
    return lambda x: x >= F.col(column)


def grow(df: DataFrame, features: Sequence[str], label: str, how: Growth, weight: str | None = None, tree: str | None = None, trees: int = 1, classes: list[str] | None = None) -> list[TreeModel]:
    """Trees on df. With `tree`, that column says which tree a row is for, 0 to trees - 1. Features and label must not be null."""
    of_type(how.criterion, str)
    if how.criterion not in CRITERIA:
        raise ValueError(f"criterion is one of {CRITERIA}")
    kinds = continuity(df, list(features))
    numbers, labels = [f for f in features if kinds[f]], [f for f in features if not kinds[f]]
    if how.criterion == "id3" and numbers:
        raise ValueError(f"id3 takes discrete features only, not {numbers}")
    no_nulls(df, [*features, label])
    regression = how.criterion == "variance"
    if not regression and classes is None:
        classes = sorted(r[0] for r in df.select(F.col(label).cast("string")).distinct().collect())
    if how.max_bins and numbers:
        df = binned(df, numbers, how.max_bins)
    measure = "entropy" if how.criterion in ("id3", "c45") else how.criterion
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    base = df.select(*[F.col(f).cast("double" if kinds[f] else "string").alias(f) for f in features], F.col(label), w.alias("_w"), (F.col(tree) if tree else F.lit(0)).cast("int").alias("_tree")).filter("_w > 0")
    sums = [f"s{i}" for i in range(len(classes) if classes else 3)]
    made = [c.alias(s) for c, s in zip(sum_columns(label, F.col("_w"), None if regression else classes), sums, strict=True)]

    models = [TreeModel([], None if regression else classes, how.criterion) for _ in range(trees)]
    for row in base.groupBy("_tree").agg(F.count("*").alias("n"), *made).collect():
        models[row["_tree"]].nodes.append(Node(0, 0, -1, row.n, tuple(row[s] for s in sums)))
    models_open = [(t, 0) for t, m in enumerate(models) if m.nodes]
    while models_open:
        todo = {}
        for t, nid in models_open:
            node = models[t].nodes[nid]
            pure = impurity(node.sums, measure) <= 1e-12
            if not (node.depth >= how.depth_max or node.sample_n < how.split_sample_n or pure):
                todo[t, nid] = how.allowed(features, t, node)
        if not todo:
            break
        here = base.withColumn("_node", route_of(models, [t for t, _ in todo])).filter(F.struct("_tree", "_node").isin([F.struct(F.lit(t).alias("_tree"), F.lit(n).alias("_node")) for t, n in todo]) if len(todo) > 1 else (F.col("_tree") == next(iter(todo))[0]) & (F.col("_node") == next(iter(todo))[1]))
        keys, found, cats = ["_tree", "_node", "_feature"], {}, {}
        used = {f for fs in todo.values() for f in fs}
        if some := [f for f in numbers if f in used]:
            long_ = here.select("_tree", "_node", label, "_w", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in some])).alias("x")).select("_tree", "_node", label, "_w", F.col("x.f").alias("_feature"), F.col("x.v").alias("value"))
            values = long_.groupBy(*keys, "value").agg(F.count("*").alias("n"), *made)
            tables: list[DataFrame] = []
            found = {(r["_tree"], r["_node"], r["_feature"]): r for r in split_scan(values, keys, sums, measure, tables=tables).collect()}
            for t in tables:
                discard(t)
        if some := [f for f in labels if f in used]:
            long_ = here.select("_tree", "_node", label, "_w", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in some])).alias("x")).select("_tree", "_node", label, "_w", F.col("x.f").alias("_feature"), F.col("x.v").alias("value"))
            for r in long_.groupBy(*keys, "value").agg(F.count("*").alias("n"), *made).limit(MAX_CATEGORIES * len(todo) * len(some) + 1).collect():
                cats.setdefault((r["_tree"], r["_node"], r["_feature"]), []).append((r.value, r.n, tuple(r[s] for s in sums)))
            if max(map(len, cats.values()), default=0) > MAX_CATEGORIES:
                raise ValueError(f"a discrete feature has over {MAX_CATEGORIES} values")
        models_open = []
        for (t, nid), allowed in todo.items():
            node = models[t].nodes[nid]
            best = choose(node, nid, t, allowed, found, cats, how, measure)
            if best is None:
                continue
            feature, parts = best
            if min(n for *_, n, _ in parts) < how.leaf_sample_n:
                continue
            for op, value, n, part in parts:
                new = Node(len(models[t].nodes), node.depth + 1, nid, n, part, feature, op, value, used=node.used | {feature})
                models[t].nodes.append(new)
                node.childs.append(new.nid)
                models_open.append((t, new.nid))
    return models


#: Up to so many nodes rows find theirs by an expression, beyond by a walk through arrays.
EXPRESSION = 200


def route_of(models: list[TreeModel], which: list[int]) -> Column:
    """The node that a row has reached in its tree (_tree), for the trees in which."""
    if sum(len(models[t].nodes) for t in set(which)) > EXPRESSION:
        return F.get(Walker(models).nodes(), F.col("_tree")).cast("int")
    at = None
    for t in sorted(set(which)):
        at = (F if at is None else at).when(F.col("_tree") == t, models[t].route())
    return at


def divisions(values: list[tuple], how: Growth, measure: str):
    """(parts, ...) that a discrete feature offers; a part is (op, value, n, sums)."""
    add = lambda rows: tuple(map(sum, zip(*(r[2] for r in rows), strict=True)))
    values = sorted(values)
    if how.criterion in ("id3", "c45"):
        yield [("in", [v], n, s) for v, n, s in values]
        return
    k = len(values)
    if how.subsets and k > MAX_SUBSET_CATEGORIES:
        raise ValueError(f"all divisions are tried for {MAX_SUBSET_CATEGORIES} categories at most, not {k}")
    masks = range(1, 1 << (k - 1)) if how.subsets else [1 << i for i in range(k if k > 2 else 1)]
    for mask in masks:
        inside = [v for i, v in enumerate(values) if mask >> i & 1]
        outside = [v for i, v in enumerate(values) if not mask >> i & 1]
        yield [("in", [v[0] for v in inside], sum(v[1] for v in inside), add(inside)), ("in", [v[0] for v in outside], sum(v[1] for v in outside), add(outside))]


def choose(node: Node, nid: int, t: int, allowed: Sequence[str], found: dict, cats: dict, how: Growth, measure: str):
    """(feature, parts) of the node's best split; the first of equal ones."""
    best, top = None, None
    before = impurity(node.sums, measure)
    for f in allowed:
        options, penalty = [], 0.0
        if (t, nid, f) in found:
            r = found[t, nid, f]
            if how.criterion == "c45" and how.mdl_penalty:
                penalty = math.log2(r.thresholds) / node.sample_n
            left = tuple(r.left)
            options = [[("<=", r.threshold, r.n_left, left), (">", r.threshold, node.sample_n - r.n_left, tuple(a - b for a, b in zip(node.sums, left, strict=True)))]]
        elif len(cats.get((t, nid, f), ())) > 1:
            options = divisions(cats[t, nid, f], how, measure)
        for parts in options:
            gain = before - children_impurity([p[3] for p in parts], measure) - penalty
            if how.criterion == "c45":
                h = impurity([p[3][0] if measure == "variance" else sum(p[3]) for p in parts], "entropy")
                if h <= 0:
                    continue
                gain /= h
            gain = round(gain, 10)
            if top is None or gain > top:
                best, top = (f, parts), gain
    return best


class DecisionTree:
    """fit(df, features, label, weight) gives a TreeModel; see Growth for the parameters."""

    def __init__(self, criterion: str = "gini", **how) -> None:
        self.how = Growth(criterion, **how)

    def fit(self, df: DataFrame, features: Sequence[str], label: str, weight: str | None = None) -> TreeModel:
        return grow(df, features, label, self.how, weight)[0]


# pruning

def node_sums(model: TreeModel, df: DataFrame, label: str) -> list[list[float]]:
    """Each node's sums over df, from one aggregate by the node that rows end in."""
    made = sum_columns(label, F.lit(1.0), model.classes)
    sums = [[0.0] * len(made) for _ in model.nodes]
    for row in df.groupBy(model.route().alias("_node")).agg(*made).collect():
        for at in model.path(row[0]):
            sums[at] = [a + b for a, b in zip(sums[at], row[1:], strict=True)]
    return sums


def leaf_loss(model: TreeModel, nid: int, sums: Sequence[float]) -> float:
    """Errors, or squared errors, that the node's output makes on rows with these sums."""
    if model.classes:
        return sum(sums) - sums[model.classes.index(model.output(nid))]
    mean = model.output(nid)
    return sums[2] - 2 * mean * sums[1] + mean * mean * sums[0]


def loss(model: TreeModel, sums: list[list[float]], nid: int = 0) -> float:
    """Of the subtree below nid on the rows that sums counts, with leaves as they are; rows that end inside count there."""
    kids = model.nodes[nid].childs
    if not kids:
        return leaf_loss(model, nid, sums[nid])
    rest = [a - sum(sums[k][i] for k in kids) for i, a in enumerate(sums[nid])]
    return leaf_loss(model, nid, rest) + sum(loss(model, sums, k) for k in kids)


def prune_rep(model: TreeModel, test: DataFrame, label: str) -> TreeModel:
    """Reduced error: from the last node up, cut where the test set is served as well; never at the root."""
    sums = node_sums(model, test, label)
    cuts: set[int] = set()
    cost: dict[int, float] = {}
    for n in reversed(model.nodes):
        whole = leaf_loss(model, n.nid, sums[n.nid])
        if n.childs:
            rest = [a - sum(sums[k][i] for k in n.childs) for i, a in enumerate(sums[n.nid])]
            kept = leaf_loss(model, n.nid, rest) + sum(cost[k] for k in n.childs)
            if n.nid and whole <= kept + 1e-9:
                cuts.add(n.nid)
            else:
                whole = kept
        cost[n.nid] = whole
    return cut_all(model, cuts)


def prune_pep(model: TreeModel, penalty: float = 0.5) -> TreeModel:
    """Pessimistic: from the root down, cut where the errors as a leaf are within one standard error of the subtree's,
    both in counts and with `penalty` for each leaf; never at the root. No test set."""
    cuts, queue = set(), list(model.nodes[0].childs)
    scale = lambda n: model.nodes[n].sample_n / max(sum(model.nodes[n].sums), 1e-300)
    while queue:
        at = queue.pop(0)
        node = model.nodes[at]
        if not node.childs:
            continue
        leaves, n = model.leaves(at), node.sample_n
        below = sum(model.error(x) * scale(x) for x in leaves) + penalty * len(leaves)
        if model.error(at) * scale(at) + penalty <= below + math.sqrt(max(0.0, below * (n - below) / n)):
            cuts.add(at)
        else:
            queue += node.childs
    return cut_all(model, cuts)


def prune_ccp(model: TreeModel, test: DataFrame, label: str) -> TreeModel:
    """Cost complexity: cut the weakest link again and again; of the trees so made the smallest that serves the test set best."""
    sums = node_sums(model, test, label)
    cuts: set[int] = set()
    best, least = set(), math.inf

    def state(at: int) -> tuple[float, int, float]:
        """Training error, leaves and test loss of what is left below."""
        kids = [] if at in cuts else model.nodes[at].childs
        if not kids:
            return model.error(at), 1, leaf_loss(model, at, sums[at])
        below = [state(k) for k in kids]
        rest = [a - sum(sums[k][i] for k in kids) for i, a in enumerate(sums[at])]
        return sum(b[0] for b in below), sum(b[1] for b in below), leaf_loss(model, at, rest) + sum(b[2] for b in below)

    while True:
        if (now := state(0)[2]) <= least + 1e-12:
            best, least = set(cuts), now
        inner, links = [0], []
        while inner:
            at = inner.pop()
            if at not in cuts and model.nodes[at].childs:
                error, leaves, _ = state(at)
                links.append((round((model.error(at) - error) / (leaves - 1), 12) if leaves > 1 else 0.0, -leaves, at))
                inner += model.nodes[at].childs
        if not links:
            return cut_all(model, best)
        cuts.add(min(links)[2])


def prune(model: TreeModel, how: str = "rep", test: DataFrame | None = None, label: str | None = None, penalty: float = 0.5) -> TreeModel:
    """A pruned copy of the tree, by name: rep and ccp judge by the test rows, pep needs none."""
    if how == "pep":
        return prune_pep(model, penalty)
    if how not in ("rep", "ccp"):
        raise ValueError("how is rep, pep or ccp")
    if test is None or label is None:
        raise ValueError(f"{how} needs test rows and their label")
    return {"rep": prune_rep, "ccp": prune_ccp}[how](model, test, label)


def cut_all(model: TreeModel, cuts: set[int]) -> TreeModel:
    """Cuts several nodes; those below another cut go with it."""
    kept, queue = [], [0]
    while queue:
        at = queue.pop(0)
        kept.append(at)
        queue += [] if at in cuts else model.nodes[at].childs
    new = {old: i for i, old in enumerate(kept)}
    return TreeModel([Node(**{**model.nodes[o].__dict__, "nid": new[o], "parent": new.get(model.nodes[o].parent, -1), "childs": [] if o in cuts else [new[c] for c in model.nodes[o].childs]}) for o in kept], model.classes, model.criterion)
