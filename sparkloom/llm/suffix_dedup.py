"""Removal of long byte strings that occur twice, by sorting suffixes that are compared through prefix hashes.

Not every suffix is sorted. Each string of LENGTH bytes has an anchor, the place of its smallest hash of K bytes, which
depends on the string alone: equal strings have equal anchors. The starts whose strings share one anchor are a cell,
about 85 on average. Cells whose bytes are equal elsewhere, by 128 bits of BLAKE2b, are repeated as a whole and one of
them stands for all; no cell's bytes are compared for that. Of the different cells of one anchor, the texts after and before their anchors are
sorted by a merge sort, which compares by the longest common extension, found by binary search over polynomial prefix
hashes; common extensions of neighbours are verified on the bytes, and runs of them say which strings are equal.

An anchor with very many different cells is no single task: all strings that hold the anchor at a place from lo to hi
have the bytes between in common, so crowded groups are split by halves of that range and by those bytes, until they
are small or each is one string."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import BYTE, INVERSE, mix, powers, read, save, shuffle_partitions, union_all, utf8

LENGTH, K = 200, 32
WINDOW = LENGTH - K + 1
#: Texts are scanned in parts of so many starts.
PART = 1 << 22
PLACE_BITS = np.uint64(23)
#: Cells that are compared at once in a task; groups with more are split.
TOGETHER = 8_000
#: A cell with over HOT copies is known to all tasks, so that these copies needn't meet; if there are MOST_HOT such at most.
HOT, MOST_HOT = 1_000, 100_000


def prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(len(data)), out=sums[1:])
    return sums


def hashes(sums: np.ndarray, first: np.ndarray, length) -> np.ndarray:
    """Polynomial hashes, modulo 2**64, of the strings of these lengths that begin at first."""
    return (sums[first + length] - sums[first]) * powers(len(sums), INVERSE)[first]


def cell_hashes(sums: np.ndarray, first: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix(hashes(sums, first, size - 1 + LENGTH) + (size * 256 + place).astype(np.uint64))


def cells(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor hash, two hashes of the cell, first start, number of starts, anchor - first start) of a text's cells."""
    out = []
    raw = data.tobytes()
    for at in range(0, max(0, len(data) - LENGTH + 1), PART):
        part = data[at : at + PART + LENGTH - 1]
        sums = prefix_sums(part)
        g = mix(hashes(sums, np.arange(len(part) - K + 1), K))
        key = (g >> PLACE_BITS << PLACE_BITS) | np.arange(len(g), dtype=np.uint64)
        padded = np.full(-(-len(key) // WINDOW) * WINDOW, 2**64 - 1, np.uint64)
        padded[: len(key)] = key
        blocks = padded.reshape(-1, WINDOW)
        down = np.minimum.accumulate(blocks, 1).ravel()
        up = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        n = len(part) - LENGTH + 1
        anchor = (np.minimum(up[:n], down[WINDOW - 1 : WINDOW - 1 + n]) & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        size = np.diff(first, append=n)
        place = anchor[first] - first
        whole = cell_hashes(sums, first, size, place)
        begin = first + at
        check = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), (begin + size - 1 + LENGTH).tolist(), strict=True)])
        low, high = np.frombuffer(check, np.uint64).reshape(-1, 2).T
        out.append((g[anchor[first]], whole ^ high, low, begin, size, place))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else tuple(np.zeros(0, t) for t in (np.uint64,) * 3 + (np.int64,) * 3)


def anchored(rows: DataFrame) -> DataFrame:
    """row, h (anchor hash), e and f (cell hashes), cell (first start, number of starts and anchor's place in 8 bits each)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [cells(data) for data in utf8(batch.column(1))]
            counts = [len(x[0]) for x in found]
            h, e, f, first, size, place = (np.concatenate([x[i] for x in found]) for i in range(6)) if found else [np.zeros(0, np.int64)] * 6
            row = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (row, h.view(np.int64), e.view(np.int64), f.view(np.int64), first << 16 | size << 8 | place)], ["row", "h", "e", "f", "cell"])

    return rows.select("row", "text").mapInArrow(run, "row long, h long, e long, f long, cell long")


def common_extension(sums: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """Length of the longest common prefix of the texts from x and y (or suffix of those up to x and y), at most `most`."""
    low, high = np.zeros_like(most), most.copy()
    while (open_ := low < high).any():
        half = (low + high + 1) >> 1
        same = (hashes(sums, x - half, half) == hashes(sums, y - half, half)) if back else (hashes(sums, x, half) == hashes(sums, y, half))
        low, high = np.where(open_ & same, half, low), np.where(open_ & ~same, half - 1, high)
    return low


def sorted_order(data, sums, group, at, room, back: bool) -> np.ndarray:
    """Order of the suffixes (prefixes, read backwards, if back) from `at`, within groups that are given in order."""
    n = len(at)

    def before(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before suffix y; equal ones by number."""
        most = np.minimum(room[x], room[y])
        same = common_extension(sums, at[x], at[y], most, back)
        ended = same == most
        step = -1 - same if back else same
        cx, cy = data[np.where(ended, 0, at[x] + step)], data[np.where(ended, 0, at[y] + step)]
        short = (room[x] < room[y]) | ((room[x] == room[y]) & (x < y))
        return np.where(ended, short, cx < cy)

    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    begin = np.repeat(first, np.diff(first, append=n))
    end = np.repeat(np.append(first[1:], n), np.diff(first, append=n))
    order, width = np.arange(n), 1
    place = np.arange(n)
    while width < int((end - begin).max(initial=0)):
        run = (place - begin) // width
        left = run % 2 == 0
        other = begin + (run + np.where(left, 1, -1)) * width
        low = np.minimum(other, end)
        high = np.minimum(low + width, end)
        start = low.copy()
        while (open_ := low < high).any():  # how many of the sibling run come before
            half = (low + high) >> 1
            at_ = np.where(open_, half, 0)
            ahead = before(order[at_], order[place])
            low, high = np.where(open_ & ahead, half + 1, low), np.where(open_ & ~ahead, half, high)
        own = place - begin - run * width
        target = np.where(left, begin + run * width, begin + (run - 1) * width) + own + (low - start)
        new = np.empty_like(order)
        new[target] = order
        order, width = new, width * 2
    return order


def verified(data, order, group, at, same, back: bool) -> np.ndarray:
    """Common extensions of neighbours in order, cut to what the bytes themselves have in common."""
    out = same.copy()
    step = np.arange(1, LENGTH * 2)
    for i in range(0, len(same), 4096):
        x, y, n = at[order[:-1][i : i + 4096]], at[order[1:][i : i + 4096]], same[i : i + 4096]
        width = int(n.max(initial=0))
        if not width:
            continue
        offset = -step[:width] if back else step[:width] - 1
        inside = step[:width] <= n[:, None]
        equal = data[np.where(inside, x[:, None] + offset, 0)] == data[np.where(inside, y[:, None] + offset, 0)]
        out[i : i + 4096] = np.minimum(n, np.where((~equal & inside).any(1), (~equal & inside).argmax(1), n))
    return out


def repeated(group: np.ndarray, texts: list[np.ndarray], size: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """(cell, first start, last start) of the runs of starts, from 0 in each cell, whose strings two cells of a group
    have. Only strings with the anchor from lo to hi count."""
    data = np.concatenate(texts)
    sums = prefix_sums(data)
    begin = np.cumsum([0, *map(len, texts)])[:-1]
    at = begin + place
    ends = begin + size - 1 + LENGTH
    label = []
    for back, room in ((False, ends - at), (True, place)):
        order = sorted_order(data, sums, group, at, room, back)
        x, y = order[:-1], order[1:]
        same = common_extension(sums, at[x], at[y], np.where(group[x] == group[y], np.minimum(room[x], room[y]), 0), back)
        label.append((order, np.where(group[x] == group[y], verified(data, order, group, at, same, back), -1)))
    n = len(texts)
    flags = np.zeros((WINDOW + 1, n), bool)  # by start minus anchor, from -(WINDOW - 1) to 0
    for back in range(WINDOW):
        inside = np.flatnonzero((place >= back) & (place - size < back) & (lo <= back) & (back <= hi))
        if len(inside) < 2:
            continue
        kinds = []
        for (order, same), least in zip(label, (LENGTH - back, back), strict=True):
            kind = np.empty(n, np.int64)
            kind[order] = np.concatenate([[0], np.cumsum(same < least)])
            kinds.append(kind[inside])
        key = kinds[0] * n + kinds[1]
        by = np.argsort(key, kind="stable")
        pair = key[by[1:]] == key[by[:-1]]
        flags[WINDOW - 1 - back, inside[by[np.concatenate([pair, [False]]) | np.concatenate([[False], pair])]]] = True
    edge = np.diff(flags.T.astype(np.int8), axis=1, prepend=0)
    cell, start = np.nonzero(edge == 1)
    stop = np.nonzero(edge == -1)[1]
    return cell, start - (WINDOW - 1) + place[cell], stop - WINDOW + place[cell]


def compared(cut: DataFrame, n: int) -> DataFrame:
    """row, first, last of repeated starts, from cut (g, lo, hi, row, cell, bytes), whose groups g are small."""

    def run(batches):
        import pyarrow as pa

        held: list[tuple] = []

        def told(rows):
            g, lo, hi, row, cell, texts = (list(x) for x in zip(*rows, strict=True))
            cell = np.array(cell)
            group = np.concatenate([[0], np.cumsum(np.diff(g) != 0)])
            found, first, last = repeated(group, [np.frombuffer(t, np.uint8) for t in texts], cell >> 8 & 255, cell & 255, np.array(lo), np.array(hi))
            base = (cell >> 16)[found]
            return pa.RecordBatch.from_arrays([pa.array(np.array(row)[found], pa.int64()), pa.array(base + first, pa.int64()), pa.array(base + last, pa.int64())], ["row", "first", "last"])

        for batch in batches:
            held += zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True)
            while len(held) > TOGETHER:  # whole groups only
                end = next((i for i in range(TOGETHER, 0, -1) if held[i][0] != held[i - 1][0]), None)
                if end is None:
                    end = next((i for i in range(TOGETHER, len(held)) if held[i][0] != held[i - 1][0]), None)
                    if end is None:
                        break
                yield told(held[:end])
                held = held[end:]
        if held:
            yield told(held)

    return cut.select("g", "lo", "hi", "row", "cell", "bytes").repartition(n, "g").sortWithinPartitions("g").mapInArrow(run, "row long, first long, last long")


def halves(cut: DataFrame) -> DataFrame:
    """The rows of cut for either half of their ranges from lo to hi, where the cell has strings in it, and the groups of
    those that agree in all bytes that strings of that half have in common."""
    size, place = F.shiftright("cell", 8).bitwiseAND(255), F.col("cell").bitwiseAND(255)
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("long")
    both = F.array(F.struct(F.col("lo").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("hi").alias("b")))
    rows = cut.select("row", "cell", "bytes", F.explode(both).alias("x")).select("row", "cell", "bytes", F.col("x.a").alias("lo"), F.col("x.b").alias("hi"))
    rows = rows.filter((place >= F.col("lo")) & (place - size < F.col("hi")))
    common = F.substring("bytes", (place - F.col("lo") + 1).cast("int"), (LENGTH - F.col("hi") + F.col("lo")).cast("int"))
    return rows.withColumn("common", common).withColumn("g", F.xxhash64("lo", "hi", "common"))


def repeated_starts(cut: DataFrame, crowded: DataFrame, n: int) -> DataFrame:
    """row, first, last of repeated starts, from cut (g, lo, hi, row, cell, bytes); crowded (g) are its large groups."""
    out = []
    while not crowded.isEmpty():
        out.append(compared(cut.join(crowded, "g", "left_anti"), n))
        cut = save(halves(cut.join(crowded, "g", "left_semi")), "halves")
        one = cut.filter("lo = hi")  # strings: those with equal bytes are counted
        counts = one.groupBy("lo", "common").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
        start = F.shiftright("cell", 16) + F.col("cell").bitwiseAND(255) - F.col("lo")
        out.append(one.join(counts, ["lo", "common"], "left_semi").select("row", start.alias("first"), start.alias("last")))
        cut = cut.filter("lo < hi")
        crowded = save(cut.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > TOGETHER).select("g"), "crowded")
    return union_all([*out, compared(cut, n)])


def row_key(docs: DataFrame, hashed=F.xxhash64) -> Column:
    """A hash of doc_id and text that no two different rows of docs share: one that they do is replaced."""
    seed = 0
    while True:
        key = hashed(F.lit(seed), "doc_id", "text")
        twice = docs.select(key.alias("a"), F.xxhash64("text", "doc_id", F.lit(seed)).alias("b")).distinct().groupBy("a").agg(F.count("*").alias("n")).filter("n > 1")
        if twice.isEmpty():
            return key
        seed += 1


def covered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): row (a key of doc_id and text), doc (all columns of docs), doc_id and text; and row, text, and
    the spans (list of first and last starts of repeated strings) of the rows that have any."""
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(row_key(docs).alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "text")
    found = anchored(rows)
    mixed = (F.min("e") != F.max("e")) | (F.min("f") != F.max("f"))
    twice = found.groupBy("h").agg(F.count("*").alias("n"), mixed.alias("mixed")).filter("n > 1").select("h", "mixed")
    twice = save(twice, "twice")  # a written side lets Spark split the join's hot keys
    again = save(found.join(twice, "h"), "anchors")
    kinds = save(again.groupBy("h", "e", "f", "mixed").agg(F.count("*").alias("n"), F.min(F.struct("row", "cell")).alias("x")), "cells")
    first = F.shiftright("cell", 16)
    starts = F.shiftright("cell", 8).bitwiseAND(255) - 1
    cell = ["h", "e", "f"]
    hot = kinds.filter(F.col("n") > HOT).select(cell)
    if 0 < hot.count() <= MOST_HOT:
        less = again.join(F.broadcast(hot), cell, "left_anti").join(kinds.filter(F.col("n").between(2, HOT)).select(cell), cell)
        whole = again.join(F.broadcast(hot), cell, "left_semi").unionByName(less)
    else:
        whole = again.join(kinds.filter("n > 1").select(cell), cell)
    whole = whole.select("row", first.alias("first"), (first + starts).alias("last"))
    texts = save(rows.select("row", "text").join(again.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"]), "texts")
    apart = kinds.filter("mixed").select(F.col("h").alias("g"), "x.row", "x.cell")
    wide = F.substring(F.col("text").cast("binary"), (first + 1).cast("int"), (starts + LENGTH).cast("int"))
    cut = apart.join(texts, "row").select("g", F.lit(0).cast("long").alias("lo"), F.lit(WINDOW - 1).cast("long").alias("hi"), "row", "cell", wide.alias("bytes"))
    crowded = save(apart.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > TOGETHER).select("g"), "crowded")
    by_row = whole.union(repeated_starts(cut, crowded, n)).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return rows, by_row.join(texts, "row")


def removals(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which bytes lie in a string that begins from first to last."""
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def cut_spans(spans: DataFrame, what: str) -> DataFrame:
    """row, n_removed, n_spans, and the rest of the text: its SHA-256 (what = 'digest') or itself (what = 'text';
    bytes of characters that were cut through are left out)."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            out = [], [], []
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            first, last = (lists.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            for i, data in enumerate(utf8(batch.column(2))):
                a, b = offsets[i], offsets[i + 1]
                gone = removals(data, first[a:b], last[a:b])
                rest = data[~gone].tobytes()
                out[0].append(int(gone.sum()))
                out[1].append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                out[2].append(hashlib.sha256(rest).hexdigest() if what == "digest" else rest.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["row", "n_removed", "n_spans", "rest"])

    return spans.select("row", "spans", "text").mapInArrow(run, "row long, n_removed long, n_spans long, rest string")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs (doc_id, text).

    Every byte in a string of LENGTH bytes that also begins anywhere else, in any row, counts as removed. Null is the
    empty text; texts shorter than LENGTH lose nothing. Equal rows are two texts, so long ones lose everything."""
    rows, spans = covered(docs.select("doc_id", "text"))
    rows = rows.select("row", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("whole"))
    out = rows.join(cut_spans(spans, "digest"), "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("rest", "whole").alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs, with all its columns, whose texts lack the bytes that report() counts as removed; n_chars follows if there is one."""
    rows, spans = covered(docs)
    out = rows.join(cut_spans(spans, "text").select("row", "rest"), "row", "left")
    new = {"text": F.coalesce("rest", "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("rest").isNotNull(), F.char_length("rest").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return out.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report() of all documents: null and empty texts have no bytes, equal rows are two texts, no rows give none."""
    return report(read(spark, sf_dir, "documents"))
