"""Merkle manifest of a table: leaves in order, a subroot for each group, one root, and a proof for every row.

Trees are built from the bottom in blocks of 2**STRIDE neighbours. Every built node that a climb can pass is stored as a row
that links to its parent: the ancestor up to STRIDE levels up, with the siblings on the way. Tops of groups link onto the
tree over the groups. A recursive query then takes each leaf up from parent to parent, appends the siblings that it meets
and folds the leaf's hash with them, so that a row that was tampered with ends at another root."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import read, save, shuffle_partitions, union_all

#: Levels that a link spans at most; with 1, links go from level to level.
STRIDE = 10
#: A node row is stored once for each share of so many leaves below it, so no task joins all climbers of a node.
CLIMBERS = 128
#: The number of the tree over the groups.
TOP = -1
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Spark's bound on all rows of a recursive query.
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def encoded(column: Column) -> Column:
    """A value as `-` if null, else its UTF-8 byte count, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, columns)), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with `index`, the place in its group from 0 by the columns of order (nulls first), and `size`, the group's rows.

    Rows are dealt out by ranges of (group, order), so a large group is spread over many tasks; only the counts of each
    group in each range meet."""
    by = [F.col(c).asc_nulls_first() for c in order]
    ordered = save(rows.repartitionByRange(shuffle_partitions(rows.sparkSession), F.col(group).asc_nulls_first(), *by).withColumn("range", F.spark_partition_id()), "ranges")
    whole = Window.partitionBy("g")
    counts = ordered.groupBy(F.col(group).alias("g"), F.col("range").alias("r")).agg(F.count("*").alias("n"))
    counts = counts.select("g", "r", (F.sum("n").over(whole.orderBy("r")) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("size"))
    ordered = ordered.withColumn("place", F.row_number().over(Window.partitionBy("range", group).orderBy(*by)) - 1)
    return ordered.join(counts, F.col(group).eqNullSafe(F.col("g")) & (F.col("range") == F.col("r"))).withColumn("index", F.col("place") + F.col("before")).drop("g", "r", "range", "place", "before")


@dataclass
class Trees:
    """leaves: the rows of level 0 with their links; above: the links of all other levels; tops: tree, hash."""

    leaves: DataFrame
    above: DataFrame | None
    tops: DataFrame


def trees(leaves: DataFrame, stride: int = STRIDE, onto: int | None = None) -> Trees:
    """Merkle trees over leaves (tree long, index long, size long, hash string, row of any type).

    Links are tree, level, index, hash, row, path, next_tree, next_level, next_index, shares, next_shares: path has for
    each level of the link (left, hash) of the sibling, with a null hash where the node is the only one of its run; next_*
    is the node that the link leads to, in the tree `onto` at the top, or null. A run of 2 makes a parent."""
    most = shuffle_partitions(leaves.sparkSession)
    share = lambda level: f"least({most}L, greatest(1L, cast(pow(2, {level}) / {CLIMBERS} as bigint)))"
    level, at, links, tops = leaves, 0, [], []
    while not at or not level.isEmpty():
        blocks = level.groupBy("tree", F.shiftright("index", stride).alias("block")).agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("index", "hash", "row"))).alias("members"))
        blocks = blocks.selectExpr("*", "length(regexp_replace(bin(size - 1), '^0+', '')) AS height").selectExpr("*", f"least({stride}, height - {at}) AS up")
        runs = "transform(sequence(1, size(element_at(acc, -1)), 2), a -> sha2(concat_ws('', slice(element_at(acc, -1), a, 2)), 256))"
        blocks = save(blocks.selectExpr("*", f"aggregate(slice(sequence(1, {stride}), 1, up), array(transform(members, m -> m.hash)), (acc, i) -> concat(acc, array({runs}))) AS levels"), "blocks")
        path = f"transform(slice(sequence(0, {stride - 1}), 1, up), i -> struct((shiftright(o, i) & 1) = 1 AS left, unhex(get(get(levels, i), shiftright(o, i) ^ 1)) AS hash))"
        last = f"{at} + up = height"
        nodes = blocks.selectExpr("tree", f"transform(sequence(0, size(members) - 1), o -> struct(members[o].index AS index, members[o].hash AS hash, members[o].row AS row, {path} AS path)) AS nodes", f"CASE WHEN {last} THEN {'cast(null as bigint)' if onto is None else f'{onto}L'} ELSE tree END AS next_tree", f"CASE WHEN {last} THEN 0 ELSE {at} + up END AS next_level", f"CASE WHEN {last} THEN tree ELSE block END AS next_index", f"{most}L AS next_shares" if onto is None else f"CASE WHEN {last} THEN {most}L ELSE {share(f'{at} + up')} END AS next_shares")
        nodes = nodes.selectExpr("tree", "inline(nodes)", "next_tree", "next_level", "next_index", "next_shares")
        shares = share(at) if onto is not None else f"{most}L"
        links.append(save(nodes.selectExpr("tree", f"{at} AS level", "index", "hash", "row", "path", "next_tree", "next_level", "next_index", f"{shares} AS shares", "next_shares"), "links"))
        tops.append(blocks.filter(last).selectExpr("tree", "levels[up][0] AS hash"))
        level = blocks.filter(f"not ({last})").selectExpr("tree", "block AS index", "size", "levels[up][0] AS hash", "if(false, members[0].row, null) AS row")
        at += stride
    return Trees(links[0], union_all(links[1:]) if links[1:] else None, union_all(tops))


CLIMB = """WITH RECURSIVE climb AS (
SELECT row, unhex(hash) AS leaf, tree, index, {folded} AS folded, {proof} AS proof, next_tree, next_level, next_index, pmod(index, next_shares) AS share
FROM (SELECT *, coalesce(row.tampered, hash) AS start FROM {leaves})
UNION ALL
SELECT c.row, c.leaf, c.tree, c.index, {folded_on}, concat(c.proof, {proof_on}), n.next_tree, n.next_level, n.next_index, pmod(c.index, n.next_shares)
FROM climb c JOIN {links} n ON n.tree = c.next_tree AND n.level = c.next_level AND n.index = c.next_index AND n.share = c.share)
SELECT row, leaf, tree, folded, proof FROM climb WHERE next_tree IS NULL"""


def climbed(leaves: DataFrame, links: DataFrame) -> DataFrame:
    """row, leaf, tree, folded, proof of every leaf, hashes as bytes: what row.tampered (else the leaf's hash) folds to at
    the root, and the siblings from the leaf up, one after the other. One written table."""
    spark = leaves.sparkSession
    fold = "unhex(aggregate({}, {}, (h, s) -> sha2(concat(if(s.left, lower(hex(s.hash)), ''), h, if(s.left, '', coalesce(lower(hex(s.hash)), ''))), 256)))"
    append = "aggregate(filter({}, s -> s.hash IS NOT NULL), cast('' AS binary), (a, s) -> concat(a, s.hash))"
    sql = CLIMB.format(folded=fold.format("path", "start"), proof=append.format("path"), folded_on=fold.format("n.path", "lower(hex(c.folded))"), proof_on=append.format("n.path"), leaves="{leaves}", links="{links}")
    before = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        return save(spark.sql(sql, leaves=leaves, links=links.selectExpr("*", "explode(sequence(0L, shares - 1)) AS share")), "climbed")
    finally:
        spark.conf.unset(ROW_LIMIT) if before is None else spark.conf.set(ROW_LIMIT, before)


def proofs(leaves: DataFrame, stride: int = STRIDE) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified for each row of leaves (key, group, hash, tampered).

    Leaves stand by group (nulls first) and by key (nulls first; equal keys by hash), and each row is one. tampered is the
    hash of what stands there at the time of the check, null if that is unchanged. proof_sha256 is the hash of the siblings
    from the leaf to the root. A table without rows gives none."""
    groups = numbered(leaves.select("group").distinct().withColumn("all", F.lit(0)), "all", ["group"]).select(F.col("group").alias("g"), F.col("index").alias("tree"))
    groups = save(groups, "groups")
    rows = numbered(leaves, "group", ["key", "hash"]).join(groups, F.col("group").eqNullSafe(F.col("g")))
    rows = rows.select("tree", "index", "size", "hash", F.struct("key", "tampered").alias("row"))
    lower = trees(rows, stride, TOP)
    subroots = save(lower.tops, "subroots")
    upper = trees(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("index"), F.lit(subroots.count()).alias("size"), "hash", F.lit(None).cast(rows.schema["row"].dataType).alias("row")), stride)
    top = upper.tops.first()
    links = union_all([t.drop("row", "hash") for t in (lower.above, upper.leaves, upper.above) if t is not None])
    found = climbed(lower.leaves, links).join(subroots.select("tree", F.col("hash").alias("subroot")), "tree")
    text = lambda c: F.lower(F.hex(c))
    root = F.lit(top.hash if top else None).cast("string")
    return found.select("row.key", text("leaf").alias("leaf"), "subroot", root.alias("root"), F.sha2(text("proof"), 256).alias("proof_sha256"), text("folded").alias("folded_root"), (text("folded") == root).alias("verified"))


def manifest(docs: DataFrame, columns: list[str], group: str, key: str, tampered: Column | None = None, stride: int = STRIDE) -> DataFrame:
    """proofs() of the rows of docs: a leaf is the hash of the row's columns, with nulls as `-`. tampered is the hash of a
    changed row, null where there is none."""
    none = F.lit(None).cast("string")
    return proofs(docs.select(F.col(key).alias("key"), F.col(group).alias("group"), leaf_hash([F.col(c) for c in columns]).alias("hash"), (none if tampered is None else tampered).alias("tampered")), stride)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents by lang, and what each row folds to after a check in which n_chars of every seventh doc_id
    (by its checksum) is one more. Nulls are hashed as such, rows of one doc_id are leaves each, no rows give none."""
    changed = leaf_hash([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in COLUMNS])
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return manifest(read(spark, sf_dir, "documents"), COLUMNS, "lang", "doc_id", F.when(hit, changed)).withColumnRenamed("key", "doc_id")


_ENCODED = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
_LEAF = lambda chars: "sha256(" + " || ".join(_ENCODED(chars if c == "n_chars" else c) for c in COLUMNS) + ")"
_BYTES = "list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)"
_TABLE = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))))"
_CRC = f"xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
_LEVELS = "SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {} WHERE n > 1 GROUP BY tree, level, i // 2, n"
_UP = """SELECT f.id, f.tree, f.level + 1, f.i // 2, (f.n + 1) // 2, sha256(CASE WHEN f.i % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END), f.p || coalesce(s.h, '')
FROM {} f LEFT JOIN {} s ON s.tree = f.tree AND s.level = f.level AND s.i = xor(f.i, 1) WHERE f.n > 1"""
SQL = f"""WITH RECURSIVE crc AS (SELECT {_TABLE} AS t),
d AS (SELECT row_number() OVER () AS id, doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, leaf, CASE WHEN hit THEN changed ELSE leaf END AS start
  FROM (SELECT *, {_LEAF('n_chars')} AS leaf, {_LEAF('(n_chars + 1)')} AS changed, coalesce({_CRC} % 7 = 0, false) AS hit FROM documents, crc)),
low(tree, level, i, n, h) AS (SELECT tree, 0, i, n, leaf FROM d UNION ALL {_LEVELS.format('low')}),
sub AS (SELECT tree, h FROM low WHERE n = 1),
top(tree, level, i, n, h) AS (SELECT -1, 0, tree, (SELECT count(*) FROM sub), h FROM sub UNION ALL {_LEVELS.format('top')}),
up(id, tree, level, i, n, h, p) AS (SELECT id, tree, 0, i, n, start, '' FROM d UNION ALL {_UP.format('up', 'low')}),
ready AS (SELECT * FROM up WHERE n = 1),
over(id, tree, level, i, n, h, p) AS (SELECT id, -1, 0, tree, (SELECT count(*) FROM sub), h, p FROM ready UNION ALL {_UP.format('over', 'top')})
SELECT d.doc_id, d.leaf, sub.h AS subroot, top.h AS root, sha256(o.p) AS proof_sha256, o.h AS folded_root, o.h = top.h AS verified
FROM d JOIN sub USING (tree) JOIN (SELECT * FROM over WHERE n = 1) o ON o.id = d.id CROSS JOIN (SELECT h FROM top WHERE n = 1) top"""
