"""Collaborative filtering on sparse ratings (user, item, rating); pairs that aren't there count as 0."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.cluster import product, true_places
from sparkloom.operators.keep import kept, written

#: Rows of a block (up to 32 times as many, where there are many blocks): similarities of users are computed block against block.
BLOCK = 2048
#: Rows of either side, and items, of the products that a task holds at once; numbers of a side that it keeps; pairs that wait at most.
TILE, ITEMS, CELLS, MANY = (256, 2048), 1024, 1 << 23, 1 << 21
#: Similarities are compared to so many digits.
DIGITS = 10


def similarities(ratings: DataFrame, of: str, over: str, kind: str = "cosine") -> DataFrame:
    """x, y, s for pairs of `of` that share an `over`: cosine, or 1 / (1 + Euclidean distance) of the sparse rows.

    Pairs come from a join on the shared side; those that share nothing have cosine 0 and are left out."""
    r = ratings.select(F.col(of).alias("k"), F.col(over).alias("o"), F.col("rating").cast("double").alias("v"))
    norms = r.groupBy("k").agg(F.sum(F.col("v") * F.col("v")).alias("n"))
    a, b = r.select(F.col("k").alias("x"), "o", F.col("v").alias("vx")), r.select(F.col("k").alias("y"), "o", F.col("v").alias("vy"))
    dots = a.join(b, "o").filter("x <> y").groupBy("x", "y").agg(F.sum(F.col("vx") * F.col("vy")).alias("dot"))
    full = dots.join(norms.select(F.col("k").alias("x"), F.col("n").alias("nx")), "x").join(norms.select(F.col("k").alias("y"), F.col("n").alias("ny")), "y")
    if kind == "cosine":
        s = F.try_divide(F.col("dot"), F.sqrt(F.col("nx") * F.col("ny")))
    else:
        s = 1 / (1 + F.sqrt(F.greatest(F.lit(0.0), F.col("nx") + F.col("ny") - 2 * F.col("dot"))))
    return full.select("x", "y", s.alias("s")).filter("s is not null")


def top(similar: DataFrame, n: int) -> DataFrame:
    """The n most similar y of each x; the smaller of equally similar ones first (to ten digits)."""
    by = Window.partitionBy("x").orderBy(F.desc(F.round("s", DIGITS)), "y")
    return similar.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n)


def _profiles(ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(user, profile), and a row for each profile: user, n (squared norm), w (its ratings), dearest. A profile stands for all
    users with the same ratings and is named by the smallest of them: whoever is similar to one is so to all."""
    r = ratings.select("user", "item", F.col("rating").cast("double").alias("v"))
    rows = r.groupBy("user").agg(F.array_sort(F.collect_list(F.struct("item", "v"))).alias("w"), F.sum(F.col("v") * F.col("v")).alias("n")).filter("n > 0")
    rows = written(rows.select("user", "w"))
    same = written(rows.groupBy("w").agg(F.min("user").alias("user")))
    members = rows.join(same.withColumnRenamed("user", "profile"), "w").select("user", "profile")
    norm = F.aggregate("w", F.lit(0.0), lambda t, x: t + x["v"] * x["v"])
    dearest = F.array_max(F.transform("w", lambda x: F.struct(F.abs(x["v"]).alias("v"), x["item"].alias("item"))))["item"]
    return written(members), same.select("user", norm.alias("n"), "w", dearest.alias("dearest"))


def _blocked(ratings: DataFrame) -> DataFrame:
    """user, n, w, block of the profiles. Those with one dearest item stand in the same blocks, as far as a block holds
    them, so blocks differ in what they hold."""
    return _dealt(_profiles(ratings)[1])


def _dealt(rows: DataFrame) -> DataFrame:
    count = rows.count()
    size = max(BLOCK, min(32 * BLOCK, count // 8))  # a block meets many others, so more rows need larger blocks
    cells = max(1, count // size)
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("dearest"), F.lit(cells)))
    parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("long").alias("parts"))
    rows = rows.join(F.broadcast(parts) if cells <= BLOCK else parts, "cell")
    return rows.select("user", "n", "w", F.concat_ws("/", "cell", F.pmod(F.xxhash64("user"), F.col("parts"))).alias("block"))


def _bounds(x: DataFrame, y: DataFrame, kind: str) -> DataFrame:
    """q, r, bound: no user of block q is more similar to one of block r than that. Blocks whose users can only have
    cosine 0 are left out. From each block's largest shares of each item and its shortest and longest row."""

    def largest(rows: DataFrame, name: str, value: str) -> DataFrame:
        each = rows.select(F.col("block").alias(name), "n", F.explode("w").alias("w"))
        return each.groupBy(name, "w.item").agg(F.max(F.abs(F.col("w.v")) / F.sqrt("n")).alias(value))

    cosine = largest(x, "q", "a").join(largest(y, "r", "b"), "item").groupBy("q", "r").agg(F.least(F.lit(1.0), F.sum(F.col("a") * F.col("b"))).alias("c"))
    if kind == "cosine":
        return cosine.select("q", "r", F.col("c").alias("bound"))
    ends = lambda rows, name: rows.groupBy(F.col("block").alias(name)).agg(F.sqrt(F.min("n")).alias(f"{name}0"), F.sqrt(F.max("n")).alias(f"{name}1"))
    both = ends(x, "q").join(ends(y, "r")).join(cosine, ["q", "r"], "left")  # of blocks, not of users
    apart = F.greatest(F.lit(0.0), F.col("q0") - F.col("r1"), F.col("r0") - F.col("q1"))
    squared = F.greatest(apart * apart, F.pow("q0", F.lit(2)) + F.pow("r0", F.lit(2)) - 2 * F.coalesce("c", F.lit(0.0)) * F.col("q1") * F.col("r1"))
    return both.select("q", "r", (1 / (1 + F.sqrt(squared))).alias("bound"))


def _packed(rows: DataFrame) -> DataFrame:
    """block, held: the rows (user, n, w) of each block as one Arrow stream, so that a pair of blocks is sent as two values."""

    def one(table):
        import pyarrow as pa

        lists = table["w"].combine_chunks()
        flat = lists.flatten()
        item = flat.field("item")
        users = pa.table({"user": table["user"], "n": table["n"], "size": pa.array(np.diff(lists.offsets.to_numpy()))})
        held = []
        for part in (users, pa.table({"item": item.dictionary_encode(), "v": flat.field("v")})):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                out.write_table(part.combine_chunks())
            held.append(sink.getvalue().to_pybytes())
        return pa.table({"block": [table["block"][0].as_py()], "users": held[:1], "rated": held[1:]})

    return written(rows.select("block", "user", "n", "w").groupBy("block").applyInArrow(one, "block string, users binary, rated binary"))


def _opened(users: bytes, rated: bytes) -> tuple:
    """user, n, owner, item, v of a block that _packed() made; owner is the row's number."""
    import pyarrow as pa

    people, flat = pa.ipc.open_stream(users).read_all(), pa.ipc.open_stream(rated).read_all().combine_chunks()
    owner = np.repeat(np.arange(len(people)), people["size"].to_numpy())
    item = flat["item"].combine_chunks()
    return people["user"].combine_chunks(), people["n"].to_numpy(), owner, item.dictionary_decode() if len(item) else item.cast(item.type.value_type), flat["v"].to_numpy()


class Nearest:
    """The n best rows of y for each row of x, both as _opened() gives them. Single-precision products look for those that can
    be among them, each of which is then settled in double precision; only n are held for each row."""

    def __init__(self, x: tuple, y: tuple, n: int, kind: str) -> None:
        import pyarrow as pa
        import pyarrow.compute as pc

        (self.xu, self.xn, xo, xi, xv), (self.yu, self.yn, yo, yi, yv) = x, y
        self.n, self.cosine = n, kind == "cosine"
        codes = pa.chunked_array([xi, yi]).combine_chunks().dictionary_encode().indices.to_numpy()
        self.width = int(codes.max()) + 1
        self.x, self.y = (self._rows(*r) for r in ((xo, codes[: len(xi)], xv, len(self.xn)), (yo, codes[len(xi) :], yv, len(self.yn))))
        ints = pa.types.is_integer(self.yu.type)
        self.rank = self.yu.to_numpy() if ints else pc.rank(self.yu, tiebreaker="dense").to_numpy().astype(np.int64)
        self.positive = len(xv) == 0 or len(yv) == 0 or min(xv.min(), yv.min()) >= 0
        top = max(self.xn.max(initial=0), self.yn.max(initial=0))
        self.kind = np.float32 if top < 1e30 and (self.cosine or top > 1e-25) else np.float64
        # what the rounding of single products, of their sum and of their parts can amount to at most
        self.margin = 4 * (self.width + 8) * float(np.finfo(self.kind).eps) * (1.0 if self.cosine else 3 * top)

    @staticmethod
    def _rows(owner, code, v, count: int) -> tuple:
        """The entries in order of their rows, and where each row's begin."""
        order = np.argsort(owner, kind="stable")
        return code[order], v[order], np.searchsorted(owner[order], np.arange(count + 1))

    def _matrix(self, side: tuple, first: int, last: int, low: int, high: int) -> np.ndarray:
        """The rows first .. last with the items low .. high."""
        code, v, starts = side
        a, b = starts[first], starts[last]
        owner = np.repeat(np.arange(last - first), np.diff(starts[first : last + 1]))
        code, v = code[a:b], v[a:b]
        held = (code >= low) & (code < high)
        m = np.zeros((last - first, high - low))
        np.add.at(m, (owner[held], code[held] - low), v[held])
        return m

    def _some(self, side: tuple, norms: np.ndarray, first: int, last: int, ours: bool) -> list[np.ndarray]:
        out = []
        for low in range(0, self.width, ITEMS):
            m = self._matrix(side, first, last, low, min(self.width, low + ITEMS))
            if self.cosine:
                m /= np.sqrt(norms[first:last, None])
            elif ours:
                m *= 2
            out.append(m.astype(self.kind))
        return out

    def _settled(self, row: np.ndarray, column: np.ndarray, ours: list, theirs: list, at: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """row, column, s, order of the pairs that count."""
        parts = []
        for some in np.array_split(np.arange(len(row)), -(-len(row) // 65_536)) if len(row) else ():
            r, c = row[some], column[some]
            both = [(a[r - at], b[c - to]) for a, b in zip(ours, theirs, strict=True)]
            if self.cosine:
                s = sum(np.einsum("ij,ij->i", a, b) for a, b in both) / np.sqrt(self.xn[r] * self.yn[c])
            else:  # by differences, so that equal rows are at no distance
                s = 1 / (1 + np.sqrt(sum(np.einsum("ij,ij->i", d, d) for d in (a - b for a, b in both))))
            order = np.rint(s * 10.0**DIGITS).astype(np.int64)
            held = (order != 10**DIGITS) & (s != 0)
            parts.append((r[held], c[held], s[held], order[held]))
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, int))

    def _exact(self, side: tuple, first: int, last: int) -> list[np.ndarray]:
        return [self._matrix(side, first, last, low, min(self.width, low + ITEMS)) for low in range(0, self.width, ITEMS)]

    def _floor(self, order: np.ndarray, row: np.ndarray) -> np.ndarray:
        """What a single-precision product is at least where the similarity is of that order or a higher one."""
        s = (order - 1) * 10.0**-DIGITS
        if self.cosine:
            return s - self.margin
        with np.errstate(divide="ignore", over="ignore"):
            return np.where(s > 0, self.xn[row] - (1 / np.maximum(s, 1e-300) - 1) ** 2 - self.margin, -np.inf)

    def best(self, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, column, s. least: orders that are known to be reached by n others of each row, or -1 << 62."""
        known = least > -(1 << 62)
        floor = np.full(len(self.xn), -np.inf)
        floor[known] = self._floor(least[known], np.flatnonzero(known))
        held = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, int))]
        room, waiting = np.empty(TILE[0] * TILE[1], self.kind), 0
        whole = len(self.xn) * self.width <= CELLS
        kept_rows: dict[int, tuple[list, list]] = {}

        def sift() -> None:
            row, column, s, order = (np.concatenate(c) for c in zip(*held, strict=True))
            by = np.lexsort((self.rank[column], -order, row))
            row, column, s, order = row[by], column[by], s[by], order[by]
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
            place = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
            last = place == self.n - 1
            floor[row[last]] = np.maximum(floor[row[last]], self._floor(order[last], row[last]))
            held[:] = [tuple(c[place < self.n] for c in (row, column, s, order))]

        # a slice of y is as long as all before it: each lets about n through for a row
        first, end = 0, min(len(self.yn), 64 if not known.all() else len(self.yn))
        while first < len(self.yn):
            for to in range(first, end, TILE[1]):
                upto = min(end, to + TILE[1])
                theirs, exact = self._some(self.y, self.yn, to, upto, False), self._exact(self.y, to, upto)
                shift = None if self.cosine else self.yn[to:upto].astype(self.kind)
                for at in range(0, len(self.xn), TILE[0]):
                    after = min(len(self.xn), at + TILE[0])
                    if at not in kept_rows:
                        made = self._some(self.x, self.xn, at, after, True), self._exact(self.x, at, after)
                        if whole:
                            kept_rows[at] = made
                    ours, plain = kept_rows[at] if whole else made
                    u = product(ours[0], theirs[0].T, room)
                    for a, b in zip(ours[1:], theirs[1:], strict=True):
                        u += a @ b.T
                    if shift is not None:
                        u -= shift
                    near = u >= np.nextafter(floor[at:after].astype(self.kind), self.kind(-np.inf))[:, None]
                    if self.positive and self.cosine:
                        open_ = ~np.isfinite(floor[at:after])
                        if open_.any():
                            near[open_] &= u[open_] > 0
                    found = true_places(near.ravel())
                    if len(found):
                        row, column = np.divmod(found, upto - to)
                        held.append(self._settled(row + at, column + to, plain, exact, at, to))
                        waiting += len(held[-1][0])
                        if waiting > MANY:
                            sift()
                            waiting = 0
            sift()
            waiting = 0
            first, end = end, min(len(self.yn), 2 * end)
        row, column, s, order = held[0]
        keep = order >= least[row]
        return row[keep], column[keep], s[keep]


def _matched(x: DataFrame, y: DataFrame, pairs: DataFrame, n: int, kind: str, packs: tuple[DataFrame, DataFrame] | None = None, known: DataFrame | None = None) -> DataFrame:
    """x, y, s, q: for each pair of blocks (q, r) the n most similar users of r to each user of q; all other similarities stay
    in the task. packs: _packed() of both sides. known: q and a list (x, s) of users that have n others with s or more."""
    kinds = dict(x.dtypes)
    px, py = packs or (_packed(x), _packed(y))

    def fold(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        one = lambda mark: table.filter(pc.equal(table["side"], mark)).combine_chunks()
        sides = [_opened(*(one(mark)[c][0].as_buffer().to_pybytes() for c in ("users", "rated"))) for mark in (0, 1)]
        task, told = Nearest(*sides, n, kind), one(2)
        least = np.full(len(task.xn), -(1 << 62))
        if len(told):
            rows = told["known"].combine_chunks().flatten()
            place = pc.index_in(rows.field("x"), value_set=task.xu).to_numpy(zero_copy_only=False).astype(np.int64)
            least[place] = np.rint(rows.field("s").to_numpy() * 10.0**DIGITS).astype(np.int64)
        row, best, s = task.best(least)
        return pa.table({"x": task.xu.take(pa.array(row)), "y": task.yu.take(pa.array(best)), "s": pa.array(s), "q": pa.array([table["q"][0].as_py()] * len(row), pa.string())})

    pairs, none = pairs.select("q", "r"), F.lit(None).cast(f"array<struct<x:{kinds['user']},s:double>>")
    side = lambda rows, name, mark: pairs.join(rows.withColumnRenamed("block", name), name).select("q", "r", F.lit(mark).alias("side"), "users", "rated", none.alias("known"))
    met = side(px, "q", 0).unionByName(side(py, "r", 1))
    if known is not None:
        met = met.unionByName(pairs.join(known, "q").select("q", "r", F.lit(2).alias("side"), F.lit(None).cast("binary").alias("users"), F.lit(None).cast("binary").alias("rated"), "known"))
    # few bytes stand for much work, so their size must not tell in how many tasks they are done
    parts = max(4 * x.sparkSession.sparkContext.defaultParallelism, min(2048, px.count() * py.count()))
    return met.repartition(parts, "q", "r").groupBy("q", "r").applyInArrow(fold, f"x {kinds['user']}, y {kinds['user']}, s double, q string")


def nearest_users(ratings: DataFrame, n: int = 10, kind: str = "cosine", queries: DataFrame | None = None) -> DataFrame:
    """x, y, s, rank: the n most similar users y of ratings to each user x of queries (ratings, unless given), the smaller
    of equally similar ones first. Users that are alike exactly (similarity 1, to ten digits) and those of cosine 0
    don't count.

    Users with the same ratings are served as one profile, so work grows with the number of different profiles.
    Exact: a first round compares each block of users with the one that promises most; the pairs of blocks whose bound
    shows that they can't improve any user's n best aren't compared at all, the others in a second round."""
    members, near, _ = _served(ratings, n, kind, queries)
    return members.join(near.withColumnRenamed("x", "profile"), "profile").select(F.col("user").alias("x"), "y", "s", "rank")


def _served(ratings: DataFrame, n: int, kind: str, queries: DataFrame | None) -> tuple[DataFrame, DataFrame, tuple[DataFrame, DataFrame]]:
    """(user, profile) of those to serve; x, y, s, rank, profile: the n users y, of a profile, that serve profile x; and the
    profiles of those to serve and of the others."""
    givers, given = _profiles(ratings)
    members, asked = (givers, given) if queries is None else _profiles(queries)
    near = _nearest_profiles(asked, given, n, kind, queries is None)
    # the n best users are among the first n users of the n best profiles
    first = Window.partitionBy("profile").orderBy("user")
    some = givers.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= n).select("user", "profile")
    users = near.select("x", F.col("y").alias("profile"), "s").join(some, "profile").select("x", F.col("user").alias("y"), "s", "profile")
    return members, kept(top(users, n)), (asked, given)


def _nearest_profiles(asked: DataFrame, given: DataFrame, n: int, kind: str, same: bool) -> DataFrame:
    """x, y, s, rank: the n most similar of the given profiles to each of those asked for."""
    y = kept(_dealt(given))
    x = y if same else kept(_dealt(asked))
    bounds = kept(_bounds(x, y, kind))
    first = Window.partitionBy("q").orderBy(F.desc(F.col("q") == F.col("r")), F.desc("bound"), "r")
    chosen = bounds.withColumn("turn", F.row_number().over(first)).filter("turn = 1")
    py = _packed(y)
    packs = (py if same else _packed(x)), py
    found = kept(_matched(x, y, chosen, n, kind, packs))
    worst = found.groupBy("q", "x").agg(F.count("*").alias("have"), F.min("s").alias("least")).groupBy("q").agg(F.count("*").alias("served"), F.min("have").alias("have"), F.min("least").alias("least"))
    users = x.groupBy(F.col("block").alias("q")).agg(F.count("*").alias("users"))
    reached = users.join(worst, "q", "left").select("q", F.when((F.col("served") == F.col("users")) & (F.col("have") >= n), F.col("least")).otherwise(float("-inf")).alias("least"))
    rest = bounds.join(chosen.select("q", "r"), ["q", "r"], "left_anti").join(reached, "q").filter(F.col("bound") >= F.col("least") - 1e-9)
    full = found.groupBy("q", "x").agg(F.count("*").alias("have"), F.min("s").alias("s")).filter(F.col("have") >= n)
    known = full.groupBy("q").agg(F.collect_list(F.struct("x", "s")).alias("known"))
    return top(found.drop("q").unionByName(_matched(x, y, rest, n, kind, packs, known).drop("q")), n)


def unrated(scores: DataFrame, ratings: DataFrame) -> DataFrame:
    return scores.join(ratings.select("user", "item"), ["user", "item"], "left_anti")


def user_cf(ratings: DataFrame, n: int = 10, kind: str = "cosine", queries: DataFrame | None = None) -> DataFrame:
    """user, item, score of items that the user hasn't rated: the mean of the n most similar users' ratings, weighted
    by similarity, unrated as 0. Users that are alike exactly (similarity 1, to ten digits) don't count. The users of
    `queries` (those of ratings, unless given) are served from the users of ratings."""
    members, near, (asked, given) = _served(ratings, n, kind, queries)
    whole = near.groupBy("x").agg(F.sum("s").alias("t"))
    rated = lambda rows, name: rows.select(F.col("user").alias(name), F.explode("w").alias("w")).select(name, "w.item", "w.v")
    lent = near.groupBy("x", "profile").agg(F.sum("s").alias("s"))
    sums = lent.join(rated(given, "profile"), "profile").groupBy("x", "item").agg(F.sum(F.col("s") * F.col("v")).alias("r"))
    scores = sums.join(whole, "x").select("x", "item", F.try_divide("r", "t").alias("score")).join(rated(asked, "x"), ["x", "item"], "left_anti")
    return members.join(scores.withColumnRenamed("x", "profile"), "profile").select("user", "item", "score")


def item_neighbours(ratings: DataFrame, n: int = 10, kind: str = "cosine") -> DataFrame:
    """x, y, s, rank: the n most similar items y of each item x; a table that can be written once and serve any users."""
    return top(similarities(ratings, "item", "user", kind), n)


def fold_in(near: DataFrame, queries: DataFrame) -> DataFrame:
    """user, item, score for the users of queries, also unseen ones, from item_neighbours(): an item that the user rated
    lends its rating to its n neighbours, weighted by similarity; an item's score is divided by the sum of the
    similarities of all items whose neighbour it is, whether the user rated them or not."""
    whole = near.groupBy("y").agg(F.sum("s").alias("t"))
    sums = near.join(queries.select(F.col("item").alias("x"), "user", "rating"), "x").groupBy("y", "user").agg(F.sum(F.col("s") * F.col("rating")).alias("r"))
    return unrated(sums.join(whole, "y").select("user", F.col("y").alias("item"), F.try_divide("r", "t").alias("score")), queries)


def item_cf(ratings: DataFrame, n: int = 10, kind: str = "cosine", queries: DataFrame | None = None) -> DataFrame:
    """user, item, score of fold_in() for the users of queries (those of ratings, unless given)."""
    return fold_in(item_neighbours(ratings, n, kind), ratings if queries is None else queries)


def recommend(scores: DataFrame, n: int = 5) -> DataFrame:
    """user, item, score, rank: the n best scores above 0 of each user; the smaller item of equal ones first."""
    by = Window.partitionBy("user").orderBy(F.desc(F.round("score", DIGITS)), "item")
    return scores.filter("score > 0").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n)
