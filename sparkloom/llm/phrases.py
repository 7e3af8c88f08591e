"""Phrase collocations by dynamic itemset counting.

Documents are dealt into SHARDS shards that are scanned in turns, cyclically. All lengths are counted in the same scans: words
from the first scan on, a longer phrase from the scan after both of its subphrases (without the last and without the first
word) have reached the threshold so far. Each phrase is counted for one full cycle, so its count is exact, and leaves the
table of open counts then; scans go on until the last phrase has completed its cycle.

What has reached the threshold is told to the scans by a table of SLOTS bytes: the place of a phrase's hash holds the scan from
which on phrases around it are counted. Phrases that share a place only make others begin earlier, for a full cycle too."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import BASE, BYTE, LOWER, discard, mix, powers, read, save, union_all

SHARDS = 2
#: Bytes of the table of scans, whatever the input's size: a power of 2.
SLOTS = 1 << 24
#: Words that a task counts at once, bytes of texts that it joins for that, words that it hashes and rows that it sends at once.
TOGETHER, JOINED, HASHED, SENT = 1 << 18, 1 << 21, 1 << 15, 1 << 16
LONGEST, LEAST, PERCENT, SCALE, FIRST = 4, 30, 80, 2_000_000, 2000
#: Parts of a language in which its first phrases are found before they meet.
PARTS = 64
#: Bytes that end a piece, and those that stand between words.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = ENDS.copy()
GAP[[0x20, 0x09]] = True
#: A second odd multiplier, for digests that are independent of the first.
OTHER = 0xD1B54A32D192ED03
#: A language, a tab and a phrase. The empty phrase stands for all words.
COLUMNS = "key string, begin int, n long"


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, piece) of each word of lower-cased UTF-8 bytes."""
    gap = np.concatenate([[True], GAP[data], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    first, end = edge[::2], edge[1::2]
    return first, end, np.cumsum(ENDS[data], dtype=np.int64)[first] if len(first) else first


def word_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A hash of each word, from differences of prefix sums over HASHED words at once."""
    out = np.empty(len(first), np.uint64)
    for at in range(0, len(first), HASHED):
        a, b = first[at : at + HASHED], end[at : at + HASHED]
        part = data[a[0] : b[-1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE[part] * powers(len(part), base), out=sums[1:])
        out[at : at + HASHED] = mix((sums[b - a[0]] - sums[a - a[0]]) * powers(len(part) + 1, pow(base, -1, 1 << 64))[a - a[0]] + (b - a).astype(np.uint64))
    return out


def counted(data: np.ndarray, seed: int, scan: int, slots: np.ndarray, shards: int):
    """(words of each phrase as columns of word numbers, counts, scans in which they began, texts of words) of the phrases of
    a language's text that this scan counts, once for each run of TOGETHER words."""
    first, end, piece = word_spans(data)
    for at in range(0, len(first), TOGETHER):
        own = min(TOGETHER, len(first) - at)
        to = min(at + own + LONGEST - 1, len(first))  # phrases may reach beyond the run
        a, b = first[at:to] - first[at], end[at:to] - first[at]
        part, pieces = data[first[at] : end[to - 1]], piece[at:to]
        h = word_hashes(part, a, b, BASE)
        grown = mix(h + np.uint64(seed))  # hashes of the phrases of k words that begin at each word
        chosen, involved = [], np.zeros(len(h), bool)
        if scan < shards:
            chosen.append((1, np.arange(own), np.zeros(own, np.int32)))
            involved[:] = True
        for k in range(2, LONGEST + 1):
            begins = slots[(grown & np.uint64(len(slots) - 1)).astype(np.int64)]  # of the phrases of k - 1 words
            n = max(len(h) - k + 1, 0)
            begin = np.maximum(begins[:-1], begins[1:])[:n]
            here = np.flatnonzero((begin <= scan) & (begin > scan - shards) & (pieces[:n] == pieces[len(pieces) - n :]))
            here = here[here < own]
            grown = mix(grown[:-1] * np.uint64(BASE) + mix(h[k - 1 :]))
            if len(here):
                chosen.append((k, here, begin[here].astype(np.int32)))
                for j in range(k):
                    involved[here + j] = True
        if not chosen:
            continue
        seen = np.flatnonzero(involved)
        check = word_hashes(part, a, b, OTHER)[seen]
        _, one, of_seen = np.unique(h[seen], return_index=True, return_inverse=True)
        if (check[one][of_seen] != check).any():  # two words with one hash
            _, one, of_seen = np.unique(np.stack([h[seen], check]), axis=1, return_index=True, return_inverse=True)
        number = np.zeros(len(h), np.int64)
        number[seen] = of_seen.reshape(-1)
        texts = [part[x:y].tobytes() for x, y in zip(a[seen[one]], b[seen[one]], strict=True)]
        for k, here, begin in chosen:
            key, size = number[here], len(texts)
            for j in range(1, k):
                if size * len(texts) >= 1 << 62:
                    found, key = np.unique(key, return_inverse=True)
                    size = len(found)
                key, size = key * len(texts) + number[here + j], size * len(texts)
            _, where, n = np.unique(key, return_index=True, return_counts=True)
            yield [number[here[where] + j] for j in range(k)], n, begin[where], texts


def phrase_hashes(langs: list[str], phrases: list[str]) -> np.ndarray:
    """The hashes by which counted() knows phrases (words with a space between them)."""
    data = np.frombuffer("\n".join(phrases).encode(), np.uint8)
    first, end, piece = word_spans(data)
    h = word_hashes(data, first, end, BASE)
    begin = np.searchsorted(piece, np.arange(len(phrases) + 1))
    grown = mix(h[begin[:-1]] + np.array([seed_of(x) for x in langs], np.uint64))
    for j in range(1, LONGEST):
        more = np.flatnonzero(begin[:-1] + j < begin[1:])
        grown[more] = mix(grown[more] * np.uint64(BASE) + mix(h[begin[:-1][more] + j]))
    return grown


def seed_of(lang: str) -> int:
    return zlib.crc32(lang.encode()) << 20


def scanned(shard: DataFrame, scan: int, held: Broadcast, shards: int = SHARDS) -> DataFrame:
    """COLUMNS of the phrases that this scan counts in a shard (lang, text), once for each batch of texts. held: the slots."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def batch_of(key, begin, n):
            return pa.RecordBatch.from_arrays([key, pa.array(begin, pa.int32()), pa.array(n, pa.int64())], ["key", "begin", "n"])

        def flush(lang: str, texts: list[bytes]):
            data = LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
            if scan < shards:
                yield batch_of(pa.array([f"{lang}\t"]), [0], [len(word_spans(data)[0])])
            for words, n, begin, known in counted(data, seed_of(lang), scan, held.value, shards):
                known = pa.array(known, pa.binary()).cast(pa.string())
                parts = [known.take(pa.array(w)) for w in words]
                for a in range(0, len(n), SENT):
                    some = pc.binary_join_element_wise(*[p.slice(a, SENT) for p in parts], " ")
                    yield batch_of(pc.binary_join_element_wise(pa.scalar(f"{lang}\t"), some, ""), begin[a : a + SENT], n[a : a + SENT])

        waiting: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                waiting.setdefault(lang, []).append(text.as_buffer().to_pybytes() if text.is_valid else b"")
                sizes[lang] = sizes.get(lang, 0) + len(waiting[lang][-1])
                if sizes[lang] >= JOINED or sum(sizes.values()) >= 2 * JOINED:
                    lang = max(sizes, key=sizes.get)
                    yield from flush(lang, waiting.pop(lang))
                    del sizes[lang]
        for lang, texts in waiting.items():
            yield from flush(lang, texts)

    return shard.select("lang", "text").mapInArrow(run, COLUMNS)


def reached(counts: DataFrame, slots: int) -> np.ndarray:
    """Which places of the table of scans the phrases of counts (lang, phrase) have: a bitmap, whose parts Spark puts together."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            p = (phrase_hashes(batch.column(0).to_pylist(), batch.column(1).to_pylist()) & np.uint64(slots - 1)).astype(np.int64) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(p)], ["p"])

    marks = counts.select("lang", "phrase").mapInArrow(run, "p long")
    marks = marks.groupBy(F.shiftright("p", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()  # at most slots / 64 rows
    words = np.zeros(slots // 64, np.uint64)
    words[marks["i"].to_numpy()] = marks["b"].to_numpy().view(np.uint64)
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)


def phrase_counts(docs: DataFrame, least: int = LEAST, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """lang, k, phrase, n: exact counts of the phrases of up to 4 words that occur `least` times or more, and with k = 0 and
    an empty phrase of all words of the language.

    docs has lang and text; null languages are `und`, null texts are empty. Each row counts, also repeated ones."""
    dealt = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"))
    dealt = save(dealt.sortWithinPartitions("shard"), "shards")
    begins, scan, counts, finished = np.full(slots, 255, np.uint8), 0, None, []
    phrase = F.substring_index("key", "\t", -1)  # no word holds a tab
    named = [F.expr("left(key, length(key) - length(substring_index(key, '\t', -1)) - 1)").alias("lang"), F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " "))).alias("k"), phrase.alias("phrase"), "n"]
    while scan < shards or (begins[begins < 255].astype(np.int64) + shards > scan).any():
        held = dealt.sparkSession.sparkContext.broadcast(begins)
        rows = scanned(dealt.filter(F.col("shard") == scan % shards), scan, held, shards)
        if counts is not None:
            rows = rows.unionByName(counts.filter(F.col("begin") > scan - shards))
        found = rows.groupBy("key", "begin").agg(F.sum("n").alias("n"))
        complete = F.col("begin") == scan - shards + 1
        before, counts = counts, save(found.filter(~complete | (F.col("n") >= least) | F.endswith("key", F.lit("\t"))), "counts")
        held.unpersist()  # workers let go of it
        if before is not None:
            discard(before)
        finished.append(save(counts.filter(complete).select(*named), "finished"))
        marks = reached(counts.filter(F.col("n") >= least).select(*named).filter(F.col("k").between(1, LONGEST - 1)), slots)
        scan += 1
        begins[marks & (begins == 255)] = scan
    discard(counts)
    return union_all(finished)


def first_of(rows: DataFrame, first: int, *order) -> DataFrame:
    """The first rows of each lang with their rank: first of PARTS parts, then of what these leave."""
    parts = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= first)
    return parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= first).drop("part")


def collocations(docs: DataFrame, least: int = LEAST, percent: int = PERCENT, first: int = FIRST, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score.

    a is the phrase's count, l and r those of the two parts of its lowest-scoring cut, n all words of the language. Phrases
    that a longer one with `percent` of their occurrences holds are left out. Empty tables give no rows."""
    counts = phrase_counts(docs, least, shards, slots)
    words = counts.filter("k = 0").select("lang", F.col("n").alias("n_words"))
    phrases = counts.filter("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = phrases.select("lang", "phrase", "a", F.explode(F.expr("transform(sequence(1, k - 1), i -> struct(i as cut, array_join(slice(w, 1, i), ' ') as left, array_join(slice(w, i + 1, k - i), ' ') as right))")).alias("c")).select("lang", "phrase", "a", "c.*")
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr(f"cast({SCALE} as decimal(18,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + r)"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    inner = phrases.filter("k > 2").select("lang", "a", F.explode(F.array_distinct(F.expr("flatten(transform(sequence(2, k - 1), s -> transform(sequence(1, k - s + 1), i -> array_join(slice(w, i, s), ' '))))"))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | F.expr(f"100 * cast(longer as decimal(20,0)) < {percent} * cast(a as decimal(20,0))")).drop("longer")
    ranked = first_of(kept, first, F.desc("score"), F.desc("a"), "phrase")
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of documents, over whole texts. Null languages are `und`, null and empty texts
    hold no words, repeated rows count each, no rows give none."""
    return collocations(read(spark, sf_dir, "documents"))


_WORDS = "list_filter(string_split_regex(p, '[ \\t]+'), lambda x: x <> '')"
SQL = f"""WITH pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\n\\x0B\\f\\r]')) AS p FROM (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL)),
w AS (SELECT lang, {_WORDS} AS w FROM pieces),
f AS MATERIALIZED ({' UNION ALL '.join(f"SELECT lang, {k} AS k, phrase, count(*) AS n FROM (SELECT lang, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS phrase FROM w WHERE len(w) >= {k}) GROUP BY 1, 2, 3" for k in range(1, LONGEST + 1))}),
words AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= {LEAST}),
cuts AS (SELECT lang, phrase, c.n AS a, cut, array_to_string(w[1:cut], ' ') AS lp, array_to_string(w[cut + 1:], ' ') AS rp FROM c, range(1, {LONGEST}) AS t(cut) WHERE cut < k),
scored AS (SELECT cuts.lang, cuts.phrase, a, cut, l.n AS l, r.n AS r, (({SCALE}::HUGEINT * a) // (l.n + r.n))::BIGINT AS score FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = lp JOIN f r ON r.lang = cuts.lang AND r.phrase = rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(n) AS n FROM c, range(2, {LONGEST}) AS t(s), range(1, {LONGEST}) AS u(i) WHERE s < k AND i + s - 1 <= k GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN longer x ON x.lang = best.lang AND x.phrase = best.phrase WHERE x.n IS NULL OR 100::HUGEINT * x.n < {PERCENT}::HUGEINT * a)
SELECT kept.lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) kept JOIN words ON words.lang = kept.lang WHERE rank <= {FIRST}"""
