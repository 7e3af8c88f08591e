"""Near duplicates by HyperMinHash: banded compressed registers find candidates, full shingle sets confirm them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import all_columns, components, hashed_shingles, hashed_words, mix, read, save, union_all, utf8

#: 24 bands of 4 registers: a pair with Jaccard similarity 0.8 shares no band with probability (1 - 0.8**4)**24 = 3e-6.
BANDS, ROWS = 24, 4
MANTISSA_BITS = 10
#: Registers that agree by chance, by the HyperMinHash analysis, for sets of about equal size.
BY_CHANCE = 0.169919487 * 2.0 ** (1 - MANTISSA_BITS)
#: Bits of a set's parity bitmap.
PARITY = 512
#: A bucket may make so many pairs per member before its members are linked to further ones in turns, at most so many, and
#: it is dealt out in blocks of about so many members.
PAIRS_PER_MEMBER, TURNS, BLOCK = 64, 8, 512
#: A turn that gives a link for fewer than one in so many rows is the last one.
WORTH = 16
SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def registers(shingles: np.ndarray, seeds: np.ndarray = SEEDS) -> np.ndarray:
    """16 bits for each hash function: the leading zeros of its smallest hash (6 bits) and the bits after them."""
    if len(shingles) < 500:
        low = ((shingles ^ (seeds >> np.uint64(7))[:, None]) * seeds[:, None]).min(1)
    else:
        low = np.array([((shingles ^ (seed >> np.uint64(7))) * seed).min() for seed in seeds], np.uint64)
    return compressed(low)


def compressed(low: np.ndarray) -> np.ndarray:
    """Leading zeros and the bits after them of the smallest hashes."""
    part, exponent = np.frexp(low.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 63).astype(np.uint16)
    bits = ((part * 2 - 1) * 2**MANTISSA_BITS).clip(0, 2**MANTISSA_BITS - 1).astype(np.uint16)
    return (zeros << np.uint16(MANTISSA_BITS)) | bits


def estimate(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sketches, corrected for registers that agree by chance."""
    split = lambda x: np.ascontiguousarray(x).view(np.uint16).reshape(len(x), -1)
    same = (split(left) == split(right)).mean(1)
    return (same - BY_CHANCE) / (1 - BY_CHANCE)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, h1 and h2 (a digest of the shingle set), sketch (a long for each band; null for empty sets)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, h1, h2, sketch = [], [], [], []
            for data in utf8(batch.column(1)):
                found = np.unique(hashed_shingles(hashed_words(data)[0], words))
                n.append(len(found))
                h1.append(int(found.sum(dtype=np.uint64).view(np.int64)))
                h2.append(int(mix(found + np.uint64(7)).sum(dtype=np.uint64).view(np.int64)))
                sketch.append(registers(found).view(np.int64) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sketch, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "h1", "h2", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, sketch array<long>")


def brief(sketch: str) -> Column:
    """The low four bits of each register, sixteen to a long."""
    nibbles = lambda i: F.coalesce(F.get(sketch, i), F.lit(0).cast("long")).bitwiseAND(0x000F000F000F000F)
    packed = lambda j: nibbles(j).bitwiseOR(F.shiftleft(nibbles(j + 1), 4)).bitwiseOR(F.shiftleft(nibbles(j + 2), 8)).bitwiseOR(F.shiftleft(nibbles(j + 3), 12))
    return F.transform(F.sequence(F.lit(0), F.size(sketch) - 1, F.lit(4)), packed)


def agree(x: str, y: str, threshold: float, errors: float) -> Column:
    """Whether two briefs don't rule the threshold out: so many standard errors below it or more. Registers that differ
    agree in four bits by chance in a sixteenth of cases."""
    ones = 0x1111111111111111

    def differing(a: Column, b: Column) -> Column:
        z = a.bitwiseXOR(b)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseAND(ones))

    differ = F.aggregate(F.zip_with(f"{x}.brief", f"{y}.brief", differing), F.lit(0), lambda s, n: s + n)
    share = threshold + (1 - threshold) / 16
    n = F.col(f"{x}.registers")
    return n - differ >= n * share - errors * F.sqrt(n * share * (1 - share))


def likely(pairs: DataFrame, classes: DataFrame, threshold: float, errors: float) -> DataFrame:
    """Those pairs (a, b) whose sketches don't rule the threshold out: so many standard errors below it or more."""
    n = classes.select(F.size("sketch")).filter("sketch is not null").limit(1).collect()
    least = threshold - errors * (threshold * (1 - threshold) / (ROWS * n[0][0] if n else 1)) ** 0.5

    @F.pandas_udf("double")
    def similarity(x, y):
        import pandas as pd

        return pd.Series(estimate(np.stack(x), np.stack(y)) if len(x) else [], dtype=float)

    side = lambda c: classes.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    return pairs.join(side("a"), "a").filter(F.col("sketch_a").isNotNull()).join(side("b"), "b").filter(similarity("sketch_a", "sketch_b") >= least).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those pairs (a, b) that have 100 * intersection >= percent * union on their full shingle sets."""

    def run(batches):
        import pyarrow as pa

        known, found = None, None
        for batch in batches:
            keep = []
            b = batch.column(1).to_pylist()
            for i, (x, y) in enumerate(zip(utf8(batch.column(2)), utf8(batch.column(3)), strict=True)):
                if known != b[i]:
                    known, found = b[i], np.unique(hashed_shingles(hashed_words(y)[0], words))
                other = np.unique(hashed_shingles(hashed_words(x)[0], words))
                both = len(np.intersect1d(other, found, assume_unique=True))
                keep.append(100 * both >= percent * (len(other) + len(found) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def own_shingles(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """rep, own: how many shingles of a text no other of the wanted (doc_id) has; ids with several texts are left out."""

    def run(batches):
        import pyarrow as pa

        def told(held):
            return pa.RecordBatch.from_arrays([pa.array(np.repeat([d for d, _ in held], [len(s) for _, s in held]), pa.int64()), pa.array(np.concatenate([s for _, s in held]).view(np.int64), pa.int64())], ["rep", "shingle"])

        for batch in batches:
            held, n = [], 0
            for doc, data in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                held.append((doc, np.unique(hashed_shingles(hashed_words(data)[0], words))))
                n += len(held[-1][1])
                if n > 250_000:
                    yield told(held)
                    held, n = [], 0
            if held:
                yield told(held)

    chosen = texts.join(wanted, "doc_id", "left_semi")
    single = chosen.groupBy(F.col("doc_id").alias("rep")).agg(F.count("*").alias("n")).filter("n = 1").select("rep")
    once = chosen.select("doc_id", "text").mapInArrow(run, "rep long, shingle long").groupBy("shingle").agg(F.count("*").alias("n"), F.min("rep").alias("rep")).filter("n = 1")
    return once.groupBy("rep").agg(F.count("*").alias("own")).join(single, "rep", "left_semi")


def parities(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """rep, parity for the wanted (doc_id): bit i is 1 if an odd number of shingles falls on i; null for ids with several texts."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for data in utf8(batch.column(1)):
                found = np.unique(hashed_shingles(hashed_words(data)[0], words))
                odd = np.bincount((mix(found) % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) % 2
                out.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["rep", "parity"])

    found = texts.join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "rep long, parity array<long>")
    return found.groupBy("rep").agg(F.when(F.count("*") == 1, F.first("parity")).alias("parity"))


def near(x: str, y: str, percent: int) -> Column:
    """False only for pairs that can't be linked: each shingle that one set has alone flips a bit, so the bits that
    differ are no more than those shingles."""
    differ = F.aggregate(F.zip_with(f"{x}.parity", f"{y}.parity", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, n: s + n)
    return F.coalesce(differ, F.lit(0)) * (100 + percent) <= (F.col(f"{x}.n_shingles") + F.col(f"{y}.n_shingles")) * (100 - percent)


def linked(classes: DataFrame, texts_of, words: int, percent: int, rows: int = ROWS, errors: float = 7.0) -> DataFrame:
    """(node, component) of the classes (rep, n_shingles, sketch) that are linked with others.

    texts_of takes a table of doc_id, which are reps, and gives doc_id and text for each. Buckets link their members
    to the smallest one, and where very many pairs are still apart to further members in turns; what is apart then is
    compared across components only, so a group of near copies makes no square of pairs. A shingle that only one of those left has is in no intersection: classes with too many of them
    for any link leave before pairs are made, and pairs must be able to share enough of the others and have parity
    bitmaps that differ in few enough bits; both tests are exact. Buckets with very many such pairs are dealt out in
    blocks, and each pair of blocks is compared in a task of its own. rows: registers of a band that make its key;
    errors: how many standard errors below the threshold a sketch may be."""
    banded = classes.select("rep", "n_shingles", F.posexplode("sketch").alias("i", "v")).select("rep", "n_shingles", F.xxhash64("i", F.col("v").bitwiseAND((1 << 16 * rows) - 1 if rows < ROWS else -1)).alias("key"))
    full = banded.select("key").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    full = save(full, "full")  # a written side lets Spark split the join's hot keys
    buckets = save(banded.join(full.hint("shuffle_hash"), "key"), "buckets")
    star = save(buckets.groupBy("key").agg(F.min("rep").alias("star")), "stars")
    reps = save(buckets.select("rep").distinct(), "reps")
    texts = save(texts_of(reps.withColumnRenamed("rep", "doc_id")), "texts")
    classes = save(classes.join(reps.hint("shuffle_hash"), "rep", "left_semi"), "met")  # the others are in no pair

    apart = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    sized = classes.select(F.col("rep").alias("star"), F.col("n_shingles").alias("n_star")).distinct()
    stars = buckets.join(star, "key").filter("rep <> star").select(F.col("rep").alias("a"), "star", "n_shingles").distinct().join(sized, "star").filter(apart(F.col("n_shingles"), F.col("n_star"))).select("a", F.col("star").alias("b"))
    first = save(confirmed(likely(stars, classes, percent / 100, errors), texts, words, percent), "links")
    found = components(first)

    labelled = lambda rows: rows.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", "rep", "n_shingles", F.coalesce("component", "rep").alias("label"))
    heavy = (F.col("n") * F.col("n") - F.col("within")) / 2 > F.col("n") * PAIRS_PER_MEMBER
    counted = lambda rows: rows.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("within"), F.count("*").alias("labels")).filter("labels > 1")
    joined = lambda more: components(found.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    inside, links = labelled(buckets), []
    for turn in range(TURNS):  # over the rows of crowded buckets alone, which only get fewer
        crowded = save(counted(inside).filter(heavy).select("key"), "crowded")
        if crowded.isEmpty():
            break
        inside = save(inside.join(crowded, "key"), "crowd")
        other = inside.groupBy("key").agg(F.min_by(F.struct("rep", "n_shingles", "label"), F.xxhash64(F.lit(turn), "rep")).alias("o"))
        near_other = inside.join(other, "key").filter((F.col("label") != F.col("o.label")) & apart(F.col("n_shingles"), F.col("o.n_shingles")))
        tried = near_other.select(F.greatest("rep", "o.rep").alias("a"), F.least("rep", "o.rep").alias("b")).distinct()
        more = save(confirmed(likely(tried, classes, percent / 100, errors), texts, words, percent), "links")
        links.append(more)
        if more.count() * WORTH < inside.count():
            break
        of = lambda c: inside.select(F.col("rep").alias(c), F.col("label").alias(f"label_{c}")).distinct()  # noqa: E731, B023
        merged = components(more.join(of("a"), "a").join(of("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
        inside = inside.join(merged.select(F.col("node").alias("label"), "component"), "label", "left").select("key", "rep", "n_shingles", F.coalesce("component", "label").alias("label"))
    if links:
        found = joined(union_all(links))

    placed = save(labelled(buckets), "placed")
    mixed = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    members = save(placed.join(save(mixed, "mixed"), "key"), "members")
    alone = own_shingles(texts, members.select(F.col("rep").alias("doc_id")).distinct(), words)
    members = members.join(alone, "rep", "left").withColumn("common", F.col("n_shingles") - F.coalesce("own", F.lit(0)))
    members = save(members.filter(F.col("common") * 100 >= F.col("n_shingles") * percent).drop("own"), "members")
    load = save(counted(members).select("key", F.when(heavy, F.greatest(F.lit(2), F.ceil(F.col("n") / BLOCK))).otherwise(1).cast("long").alias("blocks")), "load")
    briefs = classes.select("rep", brief("sketch").alias("brief"), (F.size("sketch") * ROWS).alias("registers"))
    bits = parities(texts, members.select(F.col("rep").alias("doc_id")).distinct(), words)
    mixed = save(members.join(load, "key").join(briefs, "rep").join(bits, "rep"), "mixed")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda other: F.struct(F.least(F.col("block"), other).alias("i"), F.greatest(F.col("block"), other).alias("j")))
    sides = mixed.withColumn("block", block).withColumn("met", F.explode(met)).select("key", "met.i", "met.j", "block", "rep", "n_shingles", "common", "label", "brief", "registers", "parity")
    once = (F.col("x.block") != F.col("y.block")) | (F.col("x.i") == F.col("x.j"))
    shared = F.least("x.common", "y.common")
    reachable = shared * 100 >= (F.col("x.n_shingles") + F.col("y.n_shingles") - shared) * percent
    pairs = sides.alias("x").join(sides.alias("y"), ["key", "i", "j"]).filter(once & (F.col("x.rep") > F.col("y.rep")) & (F.col("x.label") != F.col("y.label")) & reachable & near("x", "y", percent) & agree("x", "y", percent / 100, errors))
    pairs = pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    second = save(confirmed(likely(pairs, classes, percent / 100, errors), texts, words, percent), "links")
    if not second.isEmpty():
        found = joined(second)
    return found


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text; other columns are ignored).

    Documents are linked if their sets of distinct word shingles have 100 * intersection >= percent * union;
    component_id is the smallest doc_id reachable over links. A text with fewer words than a shingle has all of them
    as its one shingle. Null, empty and blank texts have no shingle and are linked with nothing. Rows that repeat
    a doc_id are one document in links, and each is returned. A row without doc_id has no component and is kept.

    Equal sets collapse to one class first, so copies cost one row each."""
    all_rows = save(sketches(docs, words), "sketches")
    rows = all_rows.filter("doc_id is not null and n_shingles > 0")
    classes = save(rows.groupBy("h1", "h2", "n_shingles").agg(F.min(F.struct("doc_id", "sketch")).alias("m")).select("h1", "h2", "n_shingles", F.col("m.doc_id").alias("rep"), F.col("m.sketch").alias("sketch")), "classes")
    known = docs.select(F.col("doc_id").cast("long"), "text")
    found = linked(classes, lambda wanted: known.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), words, percent)
    located = classes.join(found, classes["rep"] == found["node"], "left").select("h1", "h2", "n_shingles", F.coalesce("component", "rep").alias("class_component"))
    out = all_rows.drop("sketch").join(located, ["h1", "h2", "n_shingles"], "left").join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.least("class_component", F.coalesce("component", "class_component")), "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_repeated_rows(docs: DataFrame) -> DataFrame:
    """docs, with all its columns, where rows with the same doc_id and text are one: that whose JSON is the first.

    Only the hashes of rows are grouped, unless rows do repeat; rows without doc_id all stay."""
    key = lambda: F.array(F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "text", "doc_id"))
    twice = docs.filter("doc_id is not null").select(key().alias("repeated_key")).groupBy("repeated_key").agg(F.count("*").alias("n")).filter("n > 1").select("repeated_key")
    twice = save(twice, "twice")
    if twice.isEmpty():
        return docs
    match = key() == F.col("repeated_key")
    whole = F.struct(*all_columns(docs))
    again = docs.join(twice, match, "left_semi").select(key().alias("k"), whole.alias("row")).groupBy("k").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return docs.join(twice, match, "left_anti").select(all_columns(docs)).union(again.select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs, with all its columns, less the rows that near_duplicates() does not keep and those that repeat another.

    A doc_id names a document: rows with one doc_id and different texts stay or go together."""
    docs = without_repeated_rows(docs)
    gone = near_duplicates(docs, words, percent).filter("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti").select(all_columns(docs))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents with shingles of four words: null, empty and blank texts are linked with
    nothing, rows that repeat a doc_id are one document in links, no rows give none."""
    return near_duplicates(read(spark, sf_dir, "documents"), words=4)
