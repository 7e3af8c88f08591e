"""Repeated passages: paragraphs that are alike by MinHash banding, and equal passages inside longer paragraphs.

Paragraphs are lines. Equal ones are one class; classes are banded by HyperMinHash registers, colliding ones are verified
on exact shingle sets, and components of links are clusters, of which one place stays and the others are removals. Sets
of fewer than LEAST shingles can't be alike without being equal, all others are banded.

Copies often lose their line breaks, and passages are pasted into longer lines. No paragraph then holds the passage
alone and the Jaccard similarity says nothing, so repeated runs of 50 words are also found whatever the lines. Each run
of SPARSE shingles has an anchor, its smallest hash, so repeated runs have anchors that are repeated. Around those,
texts are cut into blocks at content-defined places: of a repeated run of 50 words, whole blocks cover 20 words or more
in a row. A block has at most 18 shingles and a changed word is in five of them, so blocks are alike if they are equal.
Words of equal units are compared by a cryptographic digest beside the polynomial one that finds them."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import INVERSE, PLAIN, hashed_shingles, mix, plain_words, powers, read, save, utf8
from sparkloom.llm.near_dedup import compressed, linked

WORDS, PERCENT = 5, 80
#: Two different sets of which one has fewer shingles are less alike: 3 / 4 at most.
LEAST = 4
#: 8 bands whose keys are 3 of their 4 registers: a pair at 0.8 shares none with probability (1 - 0.8**3)**8 = 0.003,
#: at 0.9 with 0.00003. Sketches may be ERRORS standard errors below the threshold.
BANDS, ROWS, ERRORS = 8, 3, 4.0
SEEDS = mix(np.arange(1001, 1001 + BANDS * 4, dtype=np.uint64)) | np.uint64(1)
#: Each WINDOW shingles in a row have a cut; a block ends STEP words or more after it starts. A repeated run of n words
#: shares the cuts from its first window's to its last window's, so n - 2 * WINDOW - 4 words of blocks that touch (its
#: ends can have STEP - 1 words in no block): with n = 50 the PASSAGE words that count.
WINDOW, STEP = 13, 6
#: Words of the shortest run of repeated units that counts as a passage.
PASSAGE = 20


#: Shingles in whose each run an anchor lies: as many as a run of 50 words has. Blocks are cut so many words around anchors.
SPARSE = 50 - WORDS + 1
AROUND = SPARSE + WORDS
#: Bytes of texts that are cut together.
TOGETHER = 1 << 18


def cuts(shingles: np.ndarray, window: int = WINDOW, room: np.ndarray | None = None) -> np.ndarray:
    """The places of the smallest hash in each run of `window` shingles. Hashes that agree in all but their last 20
    bits count as equal, and of equal ones the first is taken. room: of each shingle's first word, how many words its
    text has from there on; runs that reach into the next text don't count."""
    if len(shingles) < window:
        return np.zeros(0, np.int64)
    if len(shingles) > 1 << 20:  # in parts, so that a place has 20 bits
        step = (1 << 20) - window + 1
        return np.unique(np.concatenate([at + cuts(shingles[at : at + (1 << 20)], window, None if room is None else room[at:]) for at in range(0, len(shingles) - window + 1, step)]))
    bits = np.uint64(20)
    key = np.full(-(-len(shingles) // window) * window, 2**64 - 1, np.uint64)
    key[: len(shingles)] = (shingles >> bits << bits) | np.arange(len(shingles), dtype=np.uint64)
    blocks = key.reshape(-1, window)
    down = np.minimum.accumulate(blocks, 1).ravel()
    up = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    n = len(shingles) - window + 1
    low = np.minimum(up[:n], down[window - 1 : window - 1 + n]) & ((np.uint64(1) << bits) - np.uint64(1))
    if room is not None:
        low = low[room[:n] >= window + WORDS - 1]
    return low[np.concatenate([[True], low[1:] != low[:-1]])[: len(low)]].astype(np.int64)


def digests(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of the runs of words from first to end."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(len(words)), out=sums[1:])
    return mix((sums[end] - sums[first]) * powers(len(words) + 1, INVERSE)[first] + (end - first).astype(np.uint64)).view(np.int64)


def lines(data: np.ndarray, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of each line."""
    edges = np.concatenate([[0], np.searchsorted(at, np.flatnonzero(data == 10)), [len(words)]])
    return edges[:-1], edges[1:]


class Joined:
    """Texts as one, each with a line's end behind it, so that all are cut at once. edge: the first word of each text, then
    the number of words."""

    def __init__(self, texts: list[np.ndarray]):
        raw = b"\n".join([*texts, b""])
        self.data, self.text = np.frombuffer(raw, np.uint8), raw.translate(PLAIN)
        self.words, self.at, self.end = plain_words(self.text)
        self.edge = np.searchsorted(self.at, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        self.letters = np.concatenate([[0], np.cumsum(self.end - self.at)])

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """From each word, also those that reach into the next text; the room of each for cuts()."""
        found = hashed_shingles(self.words, WORDS) if len(self.words) >= WORDS else np.zeros(0, np.uint64)
        return found, (np.repeat(self.edge[1:], np.diff(self.edge)) - np.arange(len(self.words)))[: len(found)]

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """First and end word of each line that has words."""
        first, end = lines(self.data, self.words, self.at)
        return first[end > first], end[end > first]

    def of(self, words: np.ndarray) -> np.ndarray:
        """The texts that words are in."""
        return np.searchsorted(self.edge, words, "right") - 1

    def spelled(self, first: np.ndarray, end: np.ndarray) -> list[bytes]:
        """The words of runs in lower case (A-Z) with one space between them."""
        if not len(first):
            return []
        a, b = self.at[first], self.end[end - 1]
        found = [self.text[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        for i in np.flatnonzero(b - a != self.letters[end] - self.letters[first] + end - first - 1).tolist():
            found[i] = b" ".join(found[i].split())
        return found

    def checks(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return np.frombuffer(b"".join([blake2b(x, digest_size=8).digest() for x in self.spelled(first, end)]), np.int64)


def paragraphs(texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Of the lines of texts: text, first word, number of words, number of shingles, two digests of the words, and registers
    (zero for lines of fewer than LEAST shingles). Anchors follow: text, first word, no words, no shingles, hash, 0."""
    all_ = Joined(texts)
    first, end = all_.lines()
    if not len(first):
        return (*(np.zeros(0, np.int64) for _ in range(6)), np.zeros((0, BANDS), np.int64))
    shingles, room = all_.shingles()
    n = np.maximum(end - first - WORDS + 1, 0)
    sketch = np.zeros((len(first), BANDS), np.int64)
    long_ = np.flatnonzero(n)
    n_shingles = np.ones(len(first), np.int64)
    if len(long_):
        n_shingles[long_], low = distinct(shingles, first[long_], n[long_])
        sketch[long_] = compressed(low).T.copy().view(np.int64)
    place = cuts(shingles, SPARSE, room)
    none = np.zeros(len(place), np.int64)
    text, anchors = all_.of(first), all_.of(place)
    found = (text, anchors), (first - all_.edge[text], place - all_.edge[anchors]), (end - first, none), (n_shingles, none), (digests(all_.words, first, end), shingles[place].view(np.int64)), (all_.checks(first, end), none), (sketch, np.zeros((len(place), BANDS), np.int64))
    return tuple(np.concatenate(x) for x in found)


def blocks(data: np.ndarray, spots: np.ndarray) -> tuple[np.ndarray, ...]:
    """First word, number of words and two digests of the blocks of a text that lie near the spots (words)."""
    return blocks_of([data], spots, np.array([len(spots)]))[1:]


def blocks_of(texts: list[np.ndarray], spots: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """blocks() of several texts at once, of which each has so many of the spots, and before them the text of each block."""
    all_ = Joined(texts)
    shingles, room = all_.shingles()
    place = cuts(shingles, WINDOW, room)
    then, text = np.searchsorted(place, place + STEP), all_.of(place)
    held = np.append(text, -1)[then] == text
    first, end, text = place[held], place[then[held]] + WORDS - 1, text[held]
    low, high = np.repeat(all_.edge[:-1], counts), np.repeat(all_.edge[1:], counts)
    marks = lambda words: np.bincount(np.clip(low + words, low, high), minlength=len(all_.words) + 1)
    near = np.cumsum(marks(spots - AROUND) - marks(spots + AROUND)) > 0
    held = near[first] & near[np.maximum(end - 1, 0)]
    first, end, text = first[held], end[held], text[held]
    return text, first - all_.edge[text], end - first, digests(all_.words, first, end), all_.checks(first, end)


def distinct(shingles: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run of n shingles from first: how many are distinct, and the smallest hash under each seed."""
    start = np.cumsum(n) - n
    line = np.repeat(np.arange(len(n)), n)
    values = shingles[np.arange(n.sum()) - np.repeat(start - first, n)]
    order = np.argsort(values ^ mix(line.astype(np.uint64)))  # equal ones of a line in a row
    new = np.concatenate([[True], (np.diff(line[order]) != 0) | (np.diff(values[order]) != 0)])
    low = np.array([np.minimum.reduceat((values ^ (seed >> np.uint64(7))) * seed, start) for seed in SEEDS])
    return np.bincount(line[order][new], minlength=len(n)), low


def all_paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, first, n_words, n_shingles (0 for anchors), key, check, sketch (null for anchors and short lines)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for ids, texts in parts(batch):
                text, first, n_words, n, key, check, sketch = paragraphs(texts)
                held = n >= LEAST
                offsets = np.concatenate([[0], np.cumsum(np.where(held, BANDS, 0))])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(sketch[held].ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(text)), *(pa.array(c, pa.int64()) for c in (first, n_words, n, key, check)), lists], ["doc_id", "first", "n_words", "n_shingles", "key", "check", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, first long, n_words long, n_shingles long, key long, check long, sketch array<long>")


def all_blocks(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """doc_id, first, n_words, key, check of the blocks near anchors (doc_id, first, key) that are repeated."""
    again = anchors.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    spots = anchors.join(save(again, "again").hint("shuffle_hash"), "key", "left_semi").groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("first").alias("spots"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            offsets, values = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy(zero_copy_only=False)
            texts = utf8(batch.column(2))
            for a, b in ranges(texts):
                text, *columns = blocks_of(texts[a:b], values[offsets[a] : offsets[b]], np.diff(offsets[a : b + 1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + text)), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "first", "n_words", "key", "check"])

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    near = known.join(spots.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "spots", "text")
    return near.mapInArrow(run, "doc_id long, first long, n_words long, key long, check long")


def ranges(texts: list[np.ndarray], size: int = TOGETHER):
    """(from, to) of texts that have so many bytes together, or of one longer text."""
    total = np.cumsum([0, *map(len, texts)])
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(total, total[at] + size, "right")) - 1)
        yield at, end
        at = end


def parts(batch, size: int = TOGETHER):
    """(ids, texts) of a batch, so many bytes at once, or one longer text."""
    texts = utf8(batch.column(1))
    for a, b in ranges(texts, size):
        yield batch.column(0)[a:b], texts[a:b]


def paragraph_texts(docs: DataFrame, wanted: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id (a line's key) and its words, for the keys in wanted (doc_id): from the one document and word that places
    (key, id, first) name for each, so other documents are not cut into lines again."""
    spots = places.join(wanted.withColumnRenamed("doc_id", "key"), "key", "left_semi").groupBy("id").agg(F.collect_list("first").alias("first"), F.collect_list("key").alias("keys"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            offsets, spot, key = batch.column(1).offsets.to_numpy(), *(batch.column(c).values.to_numpy(zero_copy_only=False) for c in (1, 2))
            texts = utf8(batch.column(0))
            for a, b in ranges(texts):
                all_, asked = Joined(texts[a:b]), key[offsets[a] : offsets[b]]
                first, end = all_.lines()
                low, high = (np.repeat(x, np.diff(offsets[a : b + 1])) for x in (all_.edge[:-1], all_.edge[1:]))
                word = low + spot[offsets[a] : offsets[b]]
                line = np.searchsorted(first, word)
                there = (np.append(first, -1)[line] == word) & (word < high)  # a doc_id can have several texts
                line, asked = line[there], asked[there]
                there = digests(all_.words, first[line], end[line]) == asked
                line, asked = line[there], asked[there]
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array(all_.spelled(first[line], end[line]), pa.binary()).cast(pa.string())], ["doc_id", "text"])

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    near = known.join(spots.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id"))).select("text", "first", "keys")
    return near.mapInArrow(run, "doc_id long, text string").dropDuplicates(["doc_id", "text"])


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, first, n_words, paragraph, cluster, keeper, keeper_first, removed: each unit of docs (doc_id, text) that is
    in a cluster of two or more, of whatever length; paragraph is false for blocks. The keeper is the place with the
    smallest doc_id, then the first word; removed is true everywhere else."""
    lines_ = save(all_paragraphs(docs), "paragraphs")
    place = F.min(F.struct("doc_id", "first")).alias("keeper")
    cut = save(all_blocks(docs, lines_.filter("n_shingles = 0").select("doc_id", "first", "key")), "blocks")
    lines_ = lines_.filter("n_shingles > 0")
    equal = cut.groupBy("key", "check").agg(F.count("*").alias("n"), place).filter("n > 1").select("key", "check", "n", "keeper", F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("array<long>").alias("sketch"))
    groups = lines_.groupBy("key", "check").agg(F.count("*").alias("n"), place, F.max("n_shingles").alias("n_shingles"), F.max("sketch").alias("sketch"))
    groups = save(groups.unionByName(equal).withColumn("paragraph", F.col("n_shingles") > 0), "groups")
    banded = groups.filter(f"n_shingles >= {LEAST}").select(F.col("key").alias("rep"), "n_shingles", "sketch")
    places = groups.filter(f"n_shingles >= {LEAST}").select("key", F.col("keeper.doc_id").alias("id"), F.col("keeper.first").alias("first"))
    alike = linked(banded, lambda wanted: paragraph_texts(docs, wanted, places), WORDS, PERCENT, ROWS, ERRORS)
    alike = alike.withColumnRenamed("node", "key").hint("shuffle_hash")
    met = groups.filter(f"n_shingles >= {LEAST}").drop("sketch").join(alike, "key", "left").filter("n > 1 or component is not null")
    met = save(met, "met")
    # only classes that are linked with others need another look at their cluster
    sizes = met.filter("component is not null").groupBy("component").agg(F.sum("n").alias("total"), F.min("keeper").alias("kept")).filter("total > 1")
    linked_ = met.drop("keeper").join(sizes.withColumnRenamed("kept", "keeper"), "component").withColumn("cluster", F.col("component"))
    alone = groups.filter(f"n > 1 and n_shingles < {LEAST}").unionByName(met.filter("component is null"), allowMissingColumns=True).withColumn("cluster", F.xxhash64("key", "check"))
    known_columns = ["key", "check", "paragraph", "cluster", "keeper"]
    known = save(linked_.select(known_columns).union(alone.select(known_columns)), "clusters")
    placed = ["doc_id", "first", "n_words", "key", "check"]
    found = lines_.select(*placed, F.lit(True).alias("paragraph")).union(cut.select(*placed, F.lit(False)))
    out = found.join(known.hint("shuffle_hash"), ["key", "check", "paragraph"])
    here = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("first") == F.col("keeper.first"))
    return out.select("doc_id", "first", "n_words", "paragraph", "cluster", F.col("keeper.doc_id").alias("keeper"), F.col("keeper.first").alias("keeper_first"), (~here).alias("removed"))


def merged(text: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of spans of a text that touch: text, first, last of each, and the run of each span. Spans ascend by text and first."""
    step = int(last.max(initial=0)) + 3
    far = np.maximum.accumulate(text * step + last)
    new = np.concatenate([[True], (text * step + first)[1:] > far[:-1] + 1])[: len(first)]
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(first))[: len(at)] - 1
    return text[at], first[at], far[end] - text[at] * step, np.cumsum(new) - 1


def passages(ids, units, passage: int) -> list:
    """Of Arrow columns of doc_ids and lists of units (first, last, removed, keeper): the columns of report(), for the
    documents that have passages."""
    import pyarrow as pa

    flat = units.flatten()
    long_ = lambda name: flat.field(name).to_numpy(zero_copy_only=False)
    sizes = units.value_lengths().to_numpy(zero_copy_only=False)
    text, first, last, removed = np.repeat(np.arange(len(units)), sizes), long_("first"), long_("last"), long_("removed").astype(bool)
    order = np.lexsort((last, first, text))
    text, first, last, removed = text[order], first[order], last[order], removed[order]
    of, start, end, run = merged(text, first, last)
    held = end - start + 1 >= passage
    inside = held[run]
    docs, n_passages = np.unique(of[held], return_counts=True)
    gone = inside & removed
    of, start, end, _ = merged(text[gone], first[gone], last[gone])
    n_removed = np.bincount(of, end - start + 1, len(units)).astype(np.int64)[docs]
    spans = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["first", "last"])
    keeper = flat.field("keeper").take(pa.array(order))
    known = inside & keeper.is_valid().to_numpy(zero_copy_only=False)
    text, keeper = text[known], keeper.filter(pa.array(known)).to_numpy(zero_copy_only=False)
    order = np.lexsort((keeper, text))
    text, keeper = text[order], keeper[order]
    once = np.concatenate([[True], (np.diff(text) != 0) | (np.diff(keeper) != 0)])[: len(text)]
    text, keeper = text[once], keeper[once].astype(np.int64)
    edges = lambda places: np.searchsorted(places, np.append(docs, len(units)))
    lists = lambda places, values: pa.ListArray.from_arrays(pa.array(edges(places), pa.int32()), values)
    at = edges(text)
    some = at[1:] > at[:-1]
    class_id = pa.array(np.append(keeper, 0)[at[:-1]], pa.int64(), mask=~some)
    return [ids.take(pa.array(docs)), class_id, pa.array(n_passages, pa.int64()), pa.array(n_removed, pa.int64()), lists(of, spans), lists(text, pa.array(keeper, pa.int64()))]


def by_document(batches):
    """(doc_ids, lists of their rows' other columns) of Arrow batches that are sorted by doc_id, their first column."""
    import pyarrow as pa

    def whole(rows, starts):
        one = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        flat = pa.StructArray.from_arrays(one.columns[1:], one.schema.names[1:])
        return one.column(0).take(pa.array(starts)), pa.ListArray.from_arrays(pa.array([*starts, len(flat)], pa.int32()), flat)

    held, starts, size, last = [], [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0)
        known, value = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        new = np.concatenate([[last != (known[0], value[0])], (value[1:] != value[:-1]) | (known[1:] != known[:-1])])
        at, last = np.flatnonzero(new), (known[-1], value[-1])
        if len(at) and (held or at[-1]):  # the document that the batch ends with can go on in the next one
            end = int(at[-1])
            rows, begun = [*held, batch.slice(0, end)] if end else held, [*starts, *(size + at[:-1]).tolist()]
            yield whole(rows, begun)
            held, starts, size = [batch.slice(end)], [0], batch.num_rows - end
        else:
            held, starts, size = [*held, batch], starts or [0], size + batch.num_rows
    if held:
        yield whole(held, starts)


def report(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """One row for each document: doc_id, class_id, n_passages, n_removed, removed, shared_with.

    A passage is a run of repeated units of `passage` words or more; shorter runs, like a stock phrase or a license
    line, don't count here (repeats() lists them). shared_with lists the doc_ids that keep units of the passages and
    class_id is the smallest of them; a document without passages is its own class. n_removed counts the passages' words that are kept
    elsewhere and removed lists their spans (first, last word). A passage repeated inside a document counts too. Null,
    empty and blank texts have no passages. Rows that repeat a doc_id are one document; so are rows without one."""
    units = repeats(docs).select("doc_id", "first", (F.col("first") + F.col("n_words") - 1).alias("last"), "removed", "keeper")

    def run(batches):
        import pyarrow as pa

        for ids, lists in by_document(batches):
            yield pa.RecordBatch.from_arrays(passages(ids, lists, passage), ["doc_id", "class_id", "n_passages", "n_removed", "removed", "shared_with"])

    spans = "array<struct<first:long,last:long>>"
    found = units.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, f"doc_id long, class_id long, n_passages long, n_removed long, removed {spans}, shared_with array<long>")
    every = docs.select(F.col("doc_id").cast("long").alias("id")).distinct()
    zero = lambda c, kind: F.coalesce(c, F.lit(0).cast("long") if kind == "long" else F.array().cast(kind)).alias(c)
    return every.join(found, F.col("id").eqNullSafe(F.col("doc_id")), "left").select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), zero("n_passages", "long"), zero("n_removed", "long"), zero("removed", spans), zero("shared_with", "array<long>"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report() of all documents: null, empty and blank texts have no passages, repeated rows are one document, no
    rows give none."""
    return report(read(spark, sf_dir, "documents"))
