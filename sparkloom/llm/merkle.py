"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections of each text.

Pieces are runs of up to 64 code points of a paragraph (a line), paragraphs hold pieces, sections hold 8 paragraphs
and the root holds sections; each node is the SHA-256 of its children's digests. Equal roots mean equal texts, and
trees that differ are walked from the root: only branches whose digests differ hold edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import read, shuffle_partitions

PIECE, SECTION = 64, 8
LAST = 2**63 - 1


def leaves(text: str) -> Column:
    """The pieces' digests by paragraph."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.transform(F.regexp_extract_all(p, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda x: F.sha2(x, 256)))


def paragraphs(leaf: str) -> Column:
    return F.transform(leaf, lambda pieces: F.sha2(F.array_join(pieces, ""), 256))


def sections(paragraph: str) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(paragraph), F.lit(SECTION)), lambda at: F.sha2(F.array_join(F.slice(paragraph, at, SECTION), ""), 256))


def root(section: str) -> Column:
    return F.sha2(F.array_join(section, ""), 256)


def trees(df: DataFrame, text: str, name: str, *keep: str) -> DataFrame:
    """keep, <name>_leaves, <name>_paragraphs, <name>_sections, <name>_root."""
    level = [f"{name}_{x}" for x in ("leaves", "paragraphs", "sections", "root")]
    df = df.withColumn(level[0], leaves(text))
    df = df.withColumn(level[1], paragraphs(level[0]))
    df = df.withColumn(level[2], sections(level[1]))
    return df.withColumn(level[3], root(level[2])).select(*keep, *level)


def likeness(a: str, b: str) -> Column:
    """Of two trees, from 0 to 1: 1 for equal roots, else the share of distinct pieces that both hold."""
    x, y = F.array_distinct(F.flatten(f"{a}_leaves")), F.array_distinct(F.flatten(f"{b}_leaves"))
    shared = F.size(F.array_intersect(x, y))
    return F.when(F.col(f"{a}_root") == F.col(f"{b}_root"), 1.0).otherwise(F.coalesce(F.try_divide(2.0 * shared, F.size(x) + F.size(y)), F.lit(0.0)))


def edits(a: str, b: str) -> Column:
    """Numbers, from 0, of the sections and then the paragraphs where two trees differ; sections that agree aren't entered."""
    differ = lambda level: F.filter(F.sequence(F.lit(0), F.greatest(F.size(f"{a}_{level}"), F.size(f"{b}_{level}")) - 1), lambda i: ~F.get(f"{a}_{level}", i).eqNullSafe(F.get(f"{b}_{level}", i)))
    inside = F.filter(F.flatten(F.transform(differ("sections"), lambda s: F.sequence(s * SECTION, s * SECTION + SECTION - 1))), lambda i: ~F.get(f"{a}_paragraphs", i).eqNullSafe(F.get(f"{b}_paragraphs", i)))
    return F.struct(differ("sections").alias("sections"), inside.alias("paragraphs"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, root, sections, paragraphs, leaves for each row of docs (doc_id, text); null is the empty text."""
    return trees(docs, "text", "t", "doc_id").select("doc_id", F.col("t_root").alias("root"), F.col("t_sections").alias("sections"), F.col("t_paragraphs").alias("paragraphs"), F.col("t_leaves").alias("leaves"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next for each row: the text of the next row by doc_id, and of the first row after the last.

    Rows of one doc_id follow each other by text; rows without doc_id come last. doc_id is cut into ranges of about
    equal size, and each range also gets the first row of the range after it, so no task sees all rows."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("key"))
    n = min(1000, shuffle_partitions(docs.sparkSession))
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    place = F.lit(0)
    if cuts:
        place = F.size(F.filter(F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>"), lambda c: c < F.col("key")))
    rows = rows.withColumn("range", place)
    firsts = [tuple(r) for r in rows.groupBy("range").agg(F.min("key")).orderBy("range").collect()]  # one for each range
    if not firsts:
        return rows.select("doc_id", "text", F.col("text").alias("next"))
    keys = [key for _, key in firsts]
    after = dict(zip(keys[1:] + keys[:1], [r for r, _ in firsts], strict=True))
    ghosts = rows.filter(F.col("key").isin(keys)).groupBy("key").agg(F.min("text").alias("text"))
    ghosts = ghosts.join(F.broadcast(docs.sparkSession.createDataFrame(list(after.items()), "key long, range int")), "key")
    both = rows.select("doc_id", "text", "key", "range", F.lit(False).alias("ghost")).unionByName(ghosts.select(F.lit(None).cast("long").alias("doc_id"), "text", "key", "range", F.lit(True).alias("ghost")))
    order = Window.partitionBy("range").orderBy("ghost", "key", "text")
    return both.withColumn("next", F.lead("text").over(order)).filter("not ghost").select("doc_id", "text", "next")


def op10_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text, its edited text and their likeness to it and the next document. Null is the empty text,
    whose fingerprint is that of one empty paragraph; repeated rows follow each other by text; no rows give none."""
    rows = with_next(read(spark, sf_dir, "documents")).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 4) as int))"), F.substring("next", F.lit(1), cut)))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    keep = ["doc_id", "n_chars", "edited_sha256"]
    rows = trees(rows, "text", "t", *keep, "edited", "next")
    rows = trees(rows, "edited", "e", *keep, "next", *(c for c in rows.columns if c[:2] == "t_"))
    rows = trees(rows, "next", "n", *keep, *(c for c in rows.columns if c[:2] in ("t_", "e_")))
    return rows.select(*keep, F.col("t_root").alias("fingerprint"), F.col("e_root").alias("edited_fingerprint"), likeness("t", "e").alias("near_edited"), likeness("t", "n").alias("near_next"), F.get(edits("t", "e")["paragraphs"], F.lit(0)).alias("first_edited_paragraph"))


def _sql_tree(text: str, name: str) -> str:
    return f"""{name}l AS (SELECT *, list_transform(string_split({text}, chr(10)), lambda p: list_transform(regexp_extract_all(p, '(?s).{{1,{PIECE}}}'), lambda x: sha256(x))) AS {name}_leaves FROM {{}}),
{name}p AS (SELECT *, list_transform({name}_leaves, lambda l: sha256(array_to_string(l, ''))) AS {name}_paragraphs FROM {name}l),
{name}r AS (SELECT *, sha256(array_to_string(list_transform(range(1, len({name}_paragraphs) + 1, {SECTION}), lambda a: sha256(array_to_string({name}_paragraphs[a:a + {SECTION - 1}], ''))), '')) AS {name}_root FROM {name}p)"""


def _sql_likeness(b: str) -> str:
    both = f"len(list_intersect(list_distinct(flatten(t_leaves)), list_distinct(flatten({b}_leaves))))"
    return f"CASE WHEN t_root = {b}_root THEN 1.0::DOUBLE ELSE coalesce(2.0::DOUBLE * {both} / nullif(len(list_distinct(flatten(t_leaves))) + len(list_distinct(flatten({b}_leaves))), 0), 0) END"


SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT doc_id, text, length(text) AS n_chars, coalesce(lead(text) OVER (ORDER BY doc_id, text), first_value(text) OVER (ORDER BY doc_id, text)) AS next FROM d),
x AS (SELECT *, substring(text, 1, n_chars - n_chars // 4) || substring(next, 1, n_chars // 4) AS edited FROM o),
{_sql_tree('text', 't').replace('FROM {}', 'FROM x')},
{_sql_tree('edited', 'e').replace('FROM {}', 'FROM tr')},
{_sql_tree('next', 'n').replace('FROM {}', 'FROM er')}
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, t_root AS fingerprint, e_root AS edited_fingerprint, {_sql_likeness('e')} AS near_edited, {_sql_likeness('n')} AS near_next,
list_filter(range(greatest(len(t_paragraphs), len(e_paragraphs))), lambda i: t_paragraphs[i + 1] IS DISTINCT FROM e_paragraphs[i + 1])[1]::INTEGER AS first_edited_paragraph FROM nr"""
