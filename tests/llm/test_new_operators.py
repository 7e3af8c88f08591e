"""Token counts, phrases and manifests against brute force, on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import manifest, phrases, suffix_dedup, token_counts
from tests.llm.test_operators import awkward, prose, removed


@pytest.fixture(scope="module")
def docs(spark):
    more = [(100, "Ünïcode 中文字 🙂🙂 über\n\n\tx<s></s><unk><0x0A>"), (101, " " * 70), (102, "a" * 300 + "▁b"), (103, "² 12. 3²."), (None, None)]
    return spark.createDataFrame([(d, t, "kept", 1) for d, t in awkward() + more], "doc_id long, text string, prefixes string, n_tokens int").repartition(3)


# 11

@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=token_counts.tokenizer_path())


def test_every_prefix_has_the_count_of_the_library(library):
    found, draw = token_counts.Prefixes(token_counts.tokenizer_path()), random.Random(3)
    texts = ["".join(draw.choice("ab eé \n\t▁xyzthe ing中文🙂.,<s>01²") for _ in range(draw.randint(0, 60))) for _ in range(300)]
    for text in [*texts, " " * 40, "ab" * 60, "<s> </s> <unk> <0x0A>", "one two", "x\u0000y"]:
        stored, n = found.of_text(text)
        counts = token_counts.counts_of(stored).tolist()
        assert counts == [len(library.encode(text[:k])) for k in range(len(text) + 1)] and counts[-1] == n


def test_long_units_and_texts_are_cut_without_loss(library, monkeypatch):
    monkeypatch.setattr(token_counts, "STEP", 50)
    monkeypatch.setattr(token_counts, "KEPT_UNITS", 20)
    monkeypatch.setattr(token_counts, "KEPT_PAIRS", 20)
    found = token_counts.Prefixes(token_counts.tokenizer_path())
    for text in (prose(1, 400), "x" * 3000, prose(2, 30) + " " * 200 + "\n" * 90 + prose(3, 30)):
        assert token_counts.counts_of(found.of_text(text)[0])[::17].tolist() == [len(library.encode(text[:k])) for k in range(0, len(text) + 1, 17)]


def test_counts_that_pairs_do_not_settle_are_encoded(library):
    found = token_counts.Prefixes(token_counts.tokenizer_path())
    found.compatible = lambda a, b: False
    text = "thinking of things"
    assert token_counts.counts_of(found.of_text(text)[0]).tolist() == [len(library.encode(text[:k])) for k in range(len(text) + 1)]


def test_token_prefixes(spark, docs, library):
    table = token_counts.token_prefixes(docs).cache()
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted([tuple(r) for r in table.select("doc_id", "n_bytes", "n_tokens").collect()], key=key) == sorted([(d, len((t or "").encode()), len(library.encode(t or ""))) for d, t in texts], key=key)
    for budget in (0, 3, 50):
        wanted = {(d, max(k for k in range(len(t or "") + 1) if len(library.encode((t or "")[:k])) <= budget)) for d, t in texts if len((t or "").encode()) < 500}
        found = table.select("doc_id", token_counts.longest_prefix("prefixes", budget).alias("n"), token_counts.tokens_before("prefixes", F.lit(10**6)).alias("all"), "n_tokens", "n_bytes").collect()
        assert {(r.doc_id, r.n) for r in found if r.n_bytes < 500} == wanted
        assert all(r["all"] == r.n_tokens for r in found)
    assert token_counts.token_prefixes(docs.limit(0)).count() == 0


def test_op11(spark, library):
    out = {r.doc_id: r for r in token_counts.op11_token_counts(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        n = len(library.encode(r.text or ""))
        assert (out[r.doc_id].n_tokens, out[r.doc_id].n_bytes, out[r.doc_id].over_limit) == (n, len((r.text or "").encode()), n > 4096)
        assert len(library.encode((r.text or "")[: out[r.doc_id].fit_chars])) <= 4096


# 12

def brute_phrases(rows, least, percent, first):
    """rows: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    held = Counter()
    for p, a in found.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                held[p[0], *p[i : i + k]] = max(held[p[0], *p[i : i + k]], a)
    out = {}
    for p, a in found.items():
        if 100 * held[p] < percent * a:
            score, _, left, right = min((2_000_000 * a // (f[p[: 1 + k]] + f[p[0], *p[1 + k :]]), k, f[p[: 1 + k]], f[p[0], *p[1 + k :]]) for k in range(1, len(p) - 1))
            out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for lang, x in out.items() for i, (score, a, p, left, right) in enumerate(sorted(x)[:first]))


def phrase_rows():
    draw, words = random.Random(8), ["A", "b", "é", "of", "The", "中", "x\u00a0y", "don't", "z"]
    text = lambda n: "".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", ". ", "\n", " ,"]) for _ in range(n))
    rows = [(draw.choice(["en", "en", "en", "de", None, ""]), text(draw.randint(0, 80))) for _ in range(120)]
    return rows + [("en", "a b " * 300), ("en", None), ("fr", ""), ("one", "a"), ("two", "a b"), *[("en", "copied words stand here")] * 40]


@pytest.mark.parametrize(("shards", "slots", "together"), [(4, 1 << 16, 1 << 20), (1, 1 << 16, 7), (3, 64, 50)])
def test_phrases(spark, monkeypatch, shards, slots, together):
    monkeypatch.setattr(phrases, "TOGETHER", together)
    rows = phrase_rows()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, n int, shard int").repartition(3)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    for least, percent, first in ((5, 80, 2000), (2, 50, 7)):
        found = phrases.collocations(docs, least, percent, first, shards, slots)
        assert found.columns == columns
        assert sorted(map(tuple, found.collect())) == brute_phrases(rows, least, percent, first)


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, " . ")], "lang string, text string")).count() == 0


def test_words_of_one_hash_are_told_apart(monkeypatch):
    import numpy as np

    text = np.frombuffer(b"one two one two three", np.uint8)
    real = phrases.word_hashes
    monkeypatch.setattr(phrases, "word_hashes", lambda *a: real(*a) if a[3] == phrases.OTHER else np.zeros(len(a[1]), np.uint64))
    found = {tuple(texts[w[i]] for w in words): int(n[i]) for words, n, _, texts in phrases.counted(text, 0, 0, np.full(64, 255, np.uint8), 1) for i in range(len(n))}
    assert found == {(b"one",): 2, (b"two",): 2, (b"three",): 1}


# 13

def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def climb(tree, at, start):
    proof, h = [], start
    for level in tree[:-1]:
        other = at ^ 1
        if other < len(level):
            proof.append(level[other])
        h = digest(level[other], h) if other < at else digest(h, *level[other : other + 1])
        at //= 2
    return proof, h


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    low = lambda v: (v is not None, v if v is not None else 0)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((low(r[0]), leaf(*r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: levels([h for _, h, _ in sorted(groups[g], key=lambda x: x[:2])]) for g in names}
    top = levels([made[g][-1][0] for g in names])
    out = []
    for g in names:
        for i, (_, h, r) in enumerate(sorted(groups[g], key=lambda x: x[:2])):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            start = leaf(*r[:3], r[3] + 1, r[4]) if hit else h
            proof, sub = climb(made[g], i, start)
            more, root = climb(top, names.index(g), sub)
            out.append((r[0], h, made[g][-1][0], top[-1][0], digest(*proof, *more), root, root == top[-1][0]))
    return out


def test_manifest(spark, monkeypatch):
    draw = random.Random(5)
    rows = [(i, draw.choice(["a", None, ""]), draw.choice(["en", "en", "en", "de", None, "", "é", "z"]), draw.choice([5, None, i]), draw.choice(["x", "", None, "中🙂" * 3])) for i in range(300)]
    rows += [(3, "a", "en", 1, "x"), (3, "a", "en", 1, "x"), (3, "b", "en", None, "x"), (None, "a", "en", 7, "x"), (None, None, None, None, None), (8, "a", "alone", 4, "y" * 5000)]
    key = lambda r: str(r)
    columns = "doc_id long, source string, lang string, n_chars long, text string"
    wanted = sorted(brute_manifest(rows), key=key)
    spark.createDataFrame([(*r, 1, 2) for r in rows], columns + ", hash int, tree int").repartition(5).createOrReplaceTempView("rows_of_13")
    docs = spark.table("rows_of_13")
    monkeypatch.setattr(manifest, "CLIMBERS", 4)
    monkeypatch.setattr(manifest, "read", lambda *_: docs)
    assert sorted([tuple(r) for r in manifest.op13_merkle_manifest(spark, "").collect()], key=key) == wanted
    for stride in (1, 3):
        plain = manifest.manifest(docs, manifest.COLUMNS, "lang", "doc_id", stride=stride).collect()
        assert sorted([tuple(r)[:5] for r in plain], key=key) == sorted([r[:5] for r in wanted], key=key)
        assert all(r.verified and r.folded_root == r.root for r in plain)
    for few in (rows[:1], rows[:2]):
        docs = spark.createDataFrame(few, columns)
        assert sorted([tuple(r) for r in manifest.op13_merkle_manifest(spark, "").collect()], key=key) == sorted(brute_manifest(few), key=key)
    docs = docs.limit(0)
    assert manifest.op13_merkle_manifest(spark, "").count() == 0


# 8

@pytest.mark.parametrize(("hot", "most"), [(1, 100), (2, 100), (1, 0)])
def test_copies_of_hot_cells_are_all_removed(spark, monkeypatch, hot, most):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "MOST_HOT", most)
    texts = [*[prose(900, 120)] * 5, prose(901, 100), prose(901, 100), prose(902, 90) + prose(900, 120)[100:500], prose(903, 200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup.report(df).orderBy("doc_id").collect()] == [int(g.sum()) for g in removed([t.encode() for t in texts])]


def test_passages_of_a_batch_are_merged_at_once():
    """Units that touch are one run; short runs don't count; documents without passages and units without keeper are there too."""
    import numpy as np
    import pyarrow as pa

    from sparkloom.llm import substring_dedup

    draw = np.random.default_rng(2)
    unit = lambda f, n, gone, keeper: {"first": f, "last": f + n, "removed": gone, "keeper": keeper}
    drawn = [[unit(int(draw.integers(0, 60)), int(draw.integers(0, 9)), bool(draw.random() < 0.6), None if draw.random() < 0.3 else int(draw.integers(-3, 5))) for _ in range(draw.integers(0, 12))] for _ in range(200)]
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("removed", pa.bool_()), ("keeper", pa.int64())]))
    ids = pa.array([9, *(None if i == 5 else i for i in range(200))], pa.int64()).slice(1)
    found = substring_dedup.passages(ids, pa.array([[unit(0, 50, True, 1)], *drawn], kind).slice(1), 6)
    wanted = []
    for i, units in enumerate(drawn):
        covered = {w for u in units for w in range(u["first"], u["last"] + 1)}
        runs = lambda words: [(w, min(v for v in range(w, 99) if v + 1 not in words)) for w in sorted(words) if w - 1 not in words]
        held = [r for r in runs(covered) if r[1] - r[0] + 1 >= 6]
        inside = [u for u in units if any(a <= u["first"] <= b for a, b in held)]
        gone = runs({w for u in inside if u["removed"] for w in range(u["first"], u["last"] + 1)})
        keepers = sorted({u["keeper"] for u in inside if u["keeper"] is not None})
        if held:
            wanted.append((None if i == 5 else i, keepers[0] if keepers else None, len(held), sum(b - a + 1 for a, b in gone), [{"first": a, "last": b} for a, b in gone], keepers))
    assert list(zip(*(c.to_pylist() for c in found), strict=True)) == wanted
    assert [len(c) for c in substring_dedup.passages(ids[:0], pa.array([], kind), 6)] == [0] * 6
