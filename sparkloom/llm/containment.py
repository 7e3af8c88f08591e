"""Size-partitioned MinHash containment search for short texts inside long ones, in DataFrame functions only.

Short texts are grouped into size classes: class c holds those with more than 2**(c-1) and at most 2**c shingles. For
each class, documents are cut into windows of 2**(c+1) shingles that overlap by half, so each run of up to 2**c
shingles lies in a window. A window with 80 % of a text's shingles has a Jaccard similarity of at least 0.19 with it;
of BANDS bands of one MinHash value each, none agrees with probability 0.81**64 = 1.4e-6 or less. Pairs that share a
band are verified on exact shingle sets. Before a window is signed, a bitmap of fixed size over the short texts'
shingles drops windows that hold too few of them for any match; it has no false negatives, so no match is lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import save

BANDS = 64
WORD_GAP = r"[^\p{L}\p{N}]+"
#: At most so many bits in the bitmap, whatever the number of short texts.
MAX_BITS = 1 << 21
#: The short texts' bands and shingles are broadcast up to so many rows and bytes, and shuffled beyond.
MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES = 500_000, 32 << 20


def shingle_hashes(df: DataFrame, words: int, *keep: str) -> DataFrame:
    """keep, and the hashes of each run of so many words of `text` as `s`. Words are lower-case runs of letters and digits."""
    hashed = df.select(*keep, F.transform(F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), WORD_GAP), ""), lambda w: F.xxhash64(w)).alias("w"))
    run = lambda x, i: F.xxhash64(x, *[F.get("w", i + k) for k in range(1, words)])
    return hashed.select(*keep, F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - (words - 1), F.lit(0))), run).alias("s"))


def signature(values: str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda seed: F.array_min(F.transform(values, lambda x: F.xxhash64(x, seed))))


def contained(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80, evidence: bool = False) -> DataFrame:
    """doc_id, item_id, n_item, n_found, containment, first_word for each item found in a document.

    docs has doc_id and text, items has item_id and text; other columns are ignored. n_item is the item's number of
    distinct shingles, n_found how many of them the best window holds (the first, if several do), first_word where
    that window begins. A pair is returned if 100 * n_found >= percent * n_item. Null, empty and short texts on either
    side have no shingles and match nothing. Rows that repeat a doc_id or item_id count as one with the best match.
    evidence: also return the found shingles' hashes, as an array."""
    items = save(shingle_hashes(items.select("item_id", "text"), words, "item_id"), "shingles")  # a filter would hash the words anew for each shingle
    items = items.select("item_id", F.array_distinct("s").alias("s")).filter(F.size("s") > 0)
    items = save(items.select("item_id", "s", F.size("s").alias("n"), F.length(F.bin((F.size("s") - 1).cast("long"))).alias("class")), "items")
    classes = items.groupBy("class").agg(F.min("n").alias("n")).orderBy("class").collect()  # one row for each power of two
    empty = docs.select("doc_id", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("n_item"), F.lit(0).alias("n_found"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("first_word"), *([F.array().cast("array<long>").alias("evidence")] if evidence else [])).limit(0)
    if not classes:
        return empty
    total = items.agg(F.sum("n")).first()[0]
    bits = min(MAX_BITS, max(1 << 12, 1 << (64 * total - 1).bit_length()))
    places = lambda x: (x.bitwiseAND(bits - 1), F.shiftrightunsigned(x, 32).bitwiseAND(bits - 1))
    hashes = items.select(F.explode("s").alias("x"))
    marks = hashes.select(F.explode(F.array(*places(F.col("x")))).alias("p")).select(F.shiftright("p", 6).alias("i"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    bitmap = [0] * (bits // 64)
    for row in marks.groupBy("i").agg(F.bit_or("b").alias("b")).collect():  # as many rows as the bitmap has words
        bitmap[row.i] = row.b
    held = F.split(F.lit(",".join(map(str, bitmap))), ",").cast("array<bigint>")
    is_set = lambda p: F.getbit(F.get(held, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1
    known = lambda x: is_set(places(x)[0]) & is_set(places(x)[1])

    rows = shingle_hashes(docs.select("doc_id", "text"), words, "doc_id")
    rows = rows.select("doc_id", "s", F.filter(F.sequence(F.lit(0), F.greatest(F.size("s") - 1, F.lit(0))), lambda i: F.coalesce(known(F.get("s", i)), F.lit(False))).alias("hits"))

    def cut(level: int, least: int) -> Column:
        """The windows of a class that have a marked shingle."""
        m = 1 << level
        at = F.array_distinct(F.flatten(F.transform("hits", lambda p: F.array((p / m).cast("int"), (p / m).cast("int") - 1))))
        return F.transform(F.filter(at, lambda k: k >= 0), lambda k: F.struct(F.lit(level).alias("class"), (k * m).cast("long").alias("first_word"), F.lit((least * percent + 99) // 100).alias("least"), F.slice("s", k * m + 1, 2 * m).alias("s")))

    windows = rows.select("doc_id", F.explode_outer(F.concat(*[cut(c["class"], c["n"]) for c in classes])).alias("x")).filter("x is not null").select("doc_id", "x.*")
    windows = windows.withColumn("hits", F.array_distinct(F.filter("s", known))).filter(F.size("hits") >= F.col("least"))
    signed = windows.select("doc_id", "class", "first_word", "hits", F.posexplode(signature("s")).alias("band", "key"))
    bands = items.select("item_id", "class", F.posexplode(signature("s")).alias("band", "key"))
    texts = items.select("item_id", F.col("s").alias("of_item"), F.col("n").alias("n_item"))
    if items.count() * BANDS <= MAX_BROADCAST_ROWS and 8 * total <= MAX_BROADCAST_BYTES:
        bands, texts = F.broadcast(bands), F.broadcast(texts)
    found = signed.join(bands, ["class", "band", "key"]).join(texts, "item_id").withColumn("evidence", F.array_intersect("hits", "of_item")).withColumn("n_found", F.size("evidence"))
    best = found.filter(F.col("n_found") * 100 >= F.col("n_item") * percent).groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_found") / F.col("n_item"), "n_item", "n_found", -F.col("first_word"), *(["evidence"] if evidence else []))).alias("x"))
    return best.select("doc_id", "item_id", "x.n_item", "x.n_found", F.col("x.col1").alias("containment"), (-F.col("x.col4")).alias("first_word"), *(["x.evidence"] if evidence else []))


def sql(items: str, words: int = 5, percent: int = 80, evidence: bool = False) -> str:
    """DuckDB SQL for contained() of documents and a subquery that has item_id and text."""
    split = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    runs = lambda key, table: f"SELECT {key}, p, array_to_string(w[p + 1:p + {words}], ' ') AS s FROM (SELECT {key}, w, unnest(range(len(w) - {words - 1})) AS p FROM (SELECT {key}, {split} AS w FROM {table}))"
    return f"""WITH i AS (SELECT DISTINCT item_id, s FROM ({runs('item_id', items)})),
n AS (SELECT item_id, count(*) AS n_item, (1 << length(bin(count(*) - 1)))::BIGINT AS m FROM i GROUP BY 1),
hit AS (SELECT d.doc_id, i.item_id, d.p // m AS k, n_item, m, d.s FROM ({runs('doc_id', 'documents')}) d JOIN i ON d.s = i.s JOIN n ON n.item_id = i.item_id),
win AS (SELECT doc_id, item_id, k - o AS k, n_item, m, count(DISTINCT s) AS n_found{', list(DISTINCT s) AS evidence' if evidence else ''} FROM hit, (VALUES (0), (1)) AS v(o) WHERE k >= o GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_found DESC, k) AS r FROM win WHERE 100 * n_found >= {percent} * n_item)
SELECT doc_id, item_id, n_item::INTEGER AS n_item, n_found::INTEGER AS n_found, n_found / n_item AS containment, (k * m)::BIGINT AS first_word{', evidence' if evidence else ''} FROM best WHERE r = 1"""
