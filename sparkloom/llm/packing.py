"""Packing documents into token sequences: dominance reduction fixes sets of pieces, best fit packs the rest.

The instance is the histogram of piece lengths, which has at most one entry for each length up to the capacity
however many documents there are; plans are made over it, and pieces find their places by rank within a length."""

from __future__ import annotations

import bisect
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import read, save

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
END = 0
#: Ranks within a length are counted in so many parts, so that one length with most pieces is no single task.
PARTS = 64
#: Words whose ids a task keeps at once, and texts that it tokenizes at once.
KEPT_WORDS, TEXTS = 600_000, 1_000
#: The normalizer and the pre-tokenizer of the vocabulary whose words can be looked up one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, row: documents' token ids, cut only where longer than the capacity.

    Where the vocabulary's rules allow, each word is tokenized once per task and its ids are reused (see word_ids).
    doc_id is cast to long; null and empty texts are one piece, the end token; repeated rows are pieces each."""
    tokenizer = tokenizer or tokenizer_path()

    def run(batches):
        import zlib

        import pyarrow as pa

        ids = word_ids(tokenizer)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                out: list[list] = [[], [], [], [], [], []]
                for doc, row, words in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), ids(part.column(1).to_pylist()), strict=True):
                    data = words + end
                    for k, first in enumerate(range(0, len(data), 4 * capacity)):
                        piece = data[first : first + 4 * capacity]
                        for column, value in zip(out, (doc, k, first // 4, len(piece) // 4, zlib.crc32(piece), row), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, row long")


def word_ids(tokenizer: str):
    """A function from texts to the bytes of their ids, the same as the tokenizer's for whole texts.

    Under the rules above no token reaches across white space, letters are one run and marks around them another, so a
    word of Latin letters with marks before or behind is looked up as three parts. Its letters have one lower case and
    no shorter form, so the model itself takes them, in the byte-level alphabet. Every other word goes through the
    whole tokenizer as it is. Under other rules every text does."""
    import json
    import re
    from array import array

    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(tokenizer)
    rules = json.loads(whole.to_str())
    encoded = lambda texts: [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    if (rules["normalizer"], rules["pre_tokenizer"]) != (NORMALIZER, PRE_TOKENIZER):
        return lambda texts: encoded([t or "" for t in texts])
    gaps = re.compile("[\x1c-\x1f]")  # str.split() splits at these too, the tokenizer doesn't
    latin = re.compile(r"([!-&(-/:-@\[-`{-~]*)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)").fullmatch
    model, level = whole.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    in_bytes = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xC0, 0x100))}
    known: dict[str, bytes] = {}
    parts: dict[str, bytes] = {"": b""}

    def part(letters: str) -> bytes:
        found = parts.get(letters)
        if found is None:
            found = parts[letters] = array("I", [t.id for t in model.tokenize(letters if letters.isascii() else letters.translate(in_bytes))]).tobytes()
        return found

    def marks(text: str) -> bytes:
        if text not in parts:
            parts[text] = encoded([text])[0]
        return parts[text]

    def learn(words: set[str]) -> None:
        odd = []
        for w in words:
            m = latin(w)
            if m is None or "<|" in w:  # special tokens begin so
                odd.append(w)
                continue
            before, letters, after = m.groups()
            ids = part(letters.lower())
            known[w] = marks(before) + ids + marks(after) if before or after else ids
        known.update(zip(odd, encoded(odd), strict=True))

    def ids(texts: list) -> list[bytes]:
        split = [None if gaps.search(t or "") else (t or "").split() for t in texts]
        new = {w for words in split if words for w in words}.difference(known)
        if len(known) + len(new) > KEPT_WORDS:
            known.clear()
            parts.clear()
            parts[""] = b""
            new = {w for words in split if words for w in words}
        learn(new)
        return [b"".join(map(known.__getitem__, words)) if words is not None else encoded([t])[0] for t, words in zip(texts, split, strict=True)]

    return ids


class Plan:
    """Bins of equal content are one group: (number of bins, ((length, pieces of it in each bin), ...))."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.groups = capacity, []

    def fix(self, left: Counter, bins: int, content: dict[int, int]) -> None:
        self.groups.append((bins, tuple(content.items())))
        for length, n in content.items():
            left[length] -= bins * n


def reduce_by_dominance(left: Counter, plan: Plan) -> None:
    """Martello and Toth: fixes bins that are at least as good as any other bin for one of their pieces.

    Let k be the longest piece that fits into a bin with piece j (0 if none does). If no set of the other pieces has a
    total above k that still fits beside j, then whatever lies beside j in an optimal packing fits into the place of
    k, so the two can be swapped: {j, k} dominates every bin that j can be in, and is fixed. That is so for each
    further j and k as well, since fewer pieces have fewer totals. Totals are kept as the bits of a number, over the pieces
    that were left when a pass began: a superset, which fixes less but nothing wrong. left keeps the rest."""
    changed = True
    while changed:
        changed = False
        totals, lengths = 1, sorted(x for x in left if left[x] > 0)
        added = 0
        for j in reversed(lengths):
            room = plan.capacity - j
            while added < len(lengths) and lengths[added] <= room:
                x, copies = lengths[added], min(left[lengths[added]], plan.capacity // lengths[added])
                added, step = added + 1, 1
                while copies > 0:  # 1, 2, 4, ... copies at once
                    totals |= totals << x * min(step, copies)
                    copies, step = copies - step, step * 2
            at = bisect.bisect_right(lengths, room) - 1
            while left[j] > 0:
                while at >= 0 and left[lengths[at]] - (lengths[at] == j) <= 0:
                    at -= 1
                k = lengths[at] if at >= 0 else 0
                if totals >> (k + 1) & ((1 << (room - k)) - 1):
                    break
                bins = left[j] if not k else left[j] // 2 if k == j else min(left[j], left[k])
                plan.fix(left, bins, {j: 1} if not k else {j: 2} if k == j else {j: 1, k: 1})
                changed = True


def best_fit(left: Counter, plan: Plan) -> None:
    """Best fit decreasing over groups of equal bins."""
    open_bins: dict[int, list] = {}  # room: groups [bins, content]
    rooms: list[int] = []

    def put(room: int, bins: int, content: dict) -> None:
        if room not in open_bins:
            bisect.insort(rooms, room)
            open_bins[room] = []
        open_bins[room].append([bins, content])

    for length in sorted((x for x in left if left[x] > 0), reverse=True):
        n = left[length]
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                room, (bins, content) = plan.capacity, (-(-n // (plan.capacity // length)), {})
            else:
                room = rooms[at]
                bins, content = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            each = room // length
            full = min(bins, n // each)
            if full:
                put(room - each * length, full, content | {length: each})
            n -= full * each
            rest = bins - full
            if rest and n:
                some = min(n, each - 1) if n < each else 0
                if some:
                    put(room - some * length, 1, content | {length: some})
                    n, rest = n - some, rest - 1
            if rest and content:
                put(room, rest, content)
        left[length] = 0
    for groups in open_bins.values():
        plan.groups += [(bins, tuple(content.items())) for bins, content in groups]


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    left, plan = Counter(histogram), Plan(capacity)
    reduce_by_dominance(left, plan)
    best_fit(left, plan)
    return plan


def places(plan: Plan) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, runs of ranks: first rank, first sequence, pieces in each sequence, first offset."""
    runs: dict[int, list] = {}
    used: Counter = Counter()
    first = 0
    for bins, content in plan.groups:
        offset = 0
        for length, n in content:
            runs.setdefault(length, []).append((used[length], first, n, offset))
            used[length] += bins * n
            offset += n * length
        first += bins
    return {length: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for length, rows in runs.items()}


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs (doc_id, text).

    Null and empty texts are their end token alone. Rows that repeat a doc_id are packed each. An empty table gives
    no rows. Sequences hold at most `capacity` tokens without gaps; only documents longer than that are cut."""
    found = save(pieces(docs, tokenizer, capacity), "pieces")
    ranked = found.withColumn("part", F.pmod(F.xxhash64("row", "piece"), F.lit(PARTS)).cast("int"))
    counts = ranked.groupBy("length", "part").agg(F.count("*").alias("n")).collect()  # at most capacity * PARTS rows
    histogram: Counter = Counter()
    before: dict[tuple[int, int], int] = {}
    for row in sorted(counts):
        before[row.length, row.part] = histogram[row.length]
        histogram[row.length] += row.n
    located = places(plan_bins(dict(histogram), capacity))
    spark = docs.sparkSession
    starts = spark.createDataFrame([(*k, v) for k, v in before.items()], "length long, part int, before long")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("row", "piece")) - 1)
    ranked = ranked.join(F.broadcast(starts), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        length, rank = length.to_numpy(), rank.to_numpy()
        out = np.zeros((2, len(length)), np.int64)
        for x in np.unique(length):
            at = np.flatnonzero(length == x)
            ranks, sequences, each, offsets = located[int(x)]
            run = np.searchsorted(ranks, rank[at], "right") - 1
            bin_, slot = np.divmod(rank[at] - ranks[run], each[run])
            out[0, at], out[1, at] = sequences[run] + bin_, offsets[run] + slot * x
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    return ranked.withColumn("at", place("length", "rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack() of all documents. Null and empty texts are one token, repeated rows are packed each, no rows give none."""
    return pack(read(spark, sf_dir, "documents"))
