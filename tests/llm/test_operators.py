"""Each corpus operator against a brute-force version, on awkward rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import common, containment, decontamination, licenses, merkle, near_dedup, packing, substring_dedup, suffix_dedup, toxicity, url_filter, warc

WORDS = [a + b for a in "ba de ki lo mu ne ra so ti vo".split() for b in "n r s t l m".split()]


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) for _ in range(n))


def awkward() -> list[tuple]:
    """(doc_id, text): nulls, empty, short, repeated, long and near copies, repeated doc_ids, odd white space."""
    base = prose(1, 120)
    words = base.split()
    changed = " ".join(words[:60] + ["CHANGED"] + words[61:])
    longer = " ".join(words + prose(2, 20).split())
    rows = [(1, base), (2, base), (3, changed), (4, longer), (5, base.upper()), (6, None), (7, ""), (8, "   \t"), (9, "one two"), (10, "ONE  two"), (11, "x " * 400), (12, prose(3, 4000)), (13, "é" * 250), (14, prose(4, 50) + " " + base[:300]), (None, "lost " + prose(5, 30)), (15, prose(6, 40)), (15, prose(7, 40)), (16, base), (16, base)]
    return rows + [(20 + i, prose(30 + i, 30) + ". " + prose(9, 60) + ". " + prose(60 + i, 30)) for i in range(6)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "kept") for r in awkward()], "doc_id long, text string, row string").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def shingles(text, k):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


# 7

@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, k):
    rows = awkward()
    sets = defaultdict(list)
    for d, t in rows:
        sets[d].append(shingles(t, k))
    parent = {d: d for d in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    found = near_dedup.near_duplicates(docs, k).collect()
    wanted = [(d, len(shingles(t, k)), None if d is None else root(d), d is None or root(d) == d) for d, t in rows]
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(map(tuple, found), key=key) == sorted(wanted, key=key)


def test_near_duplicates_in_a_crowded_group(spark, monkeypatch):
    """Chains of copies, each near the next only, with pairs that must share two bands."""
    monkeypatch.setattr(near_dedup, "PAIRS_PER_MEMBER", 0)
    words = prose(11, 200).split()
    rows = []
    for i in range(40):
        for j in range(5):
            words[(i * 5 + j) % 200 // 2 * 2] = f"w{i}x{j}" if j == 0 else words[(i * 5 + j) % 200 // 2 * 2]
        rows.append((i, " ".join(words)))
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}
    parent = list(range(40))
    for a in range(40):
        for b in range(a):
            x, y = shingles(rows[a][1], 5), shingles(rows[b][1], 5)
            if 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((parent[a], parent[b]))
                parent = [low if p == high else p for p in parent]
    assert found == dict(enumerate(parent))


@pytest.mark.parametrize(("bands", "rows", "errors"), [(24, 4, 7.0), (8, 3, 4.0)])
def test_pairs_in_one_crowded_bucket_only_are_linked(spark, monkeypatch, bands, rows, errors):
    """Pairs 10, 11 and 12, 13 and ...: each shares one bucket, which is crowded by unlike texts."""
    monkeypatch.setattr(near_dedup, "PAIRS_PER_MEMBER", 0)
    monkeypatch.setattr(near_dedup, "BLOCK", 4, raising=False)
    draw = np.random.default_rng(5)
    made, texts = [], [(i, prose(800 + i, 60)) for i in range(10)]
    for i in range(10, 40, 2):
        words = prose(900 + i, 60).split()
        texts += [(i, " ".join(words)), (i + 1, " ".join([*words, "changed"]))]
    for i, text in texts:
        sketch = draw.integers(0, 1 << 16, (bands, 4), np.uint16) if i < 10 or i % 2 == 0 else sketch.copy()  # noqa: F821
        if i >= 10 and i % 2:
            sketch[1:, 0] ^= 1
        sketch[0] = 7
        made.append((i, len(shingles(text, 5)), sketch.view(np.int64).ravel().tolist()))
    classes = spark.createDataFrame(made, "rep long, n_shingles long, sketch array<long>")
    known = spark.createDataFrame(texts, "doc_id long, text string")
    found = near_dedup.linked(classes, lambda wanted: known.join(wanted, "doc_id", "left_semi"), 5, 80, rows, errors)
    assert {(r.node, r.component) for r in found.collect()} == {(i, i // 2 * 2) for i in range(10, 40)}


def test_near_duplicates_of_nothing(none):
    assert near_dedup.near_duplicates(none).count() == 0


def test_registers_estimate_similarity():
    draw = np.random.default_rng(1)
    a = draw.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:700], draw.integers(0, 2**63, 300).astype(np.uint64)])
    both = [near_dedup.registers(x).view(np.int64) for x in (a, b)]
    assert near_dedup.estimate(both[0][None], both[1][None])[0] == pytest.approx(700 / 1300, abs=0.16)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7)]
    found = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 120)}


# 8

def removed(texts):
    seen = Counter(t[s : s + 200] for t in texts for s in range(len(t) - 199))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for s in range(len(t) - 199):
            if seen[t[s : s + 200]] > 1:
                gone[s] += 1
                gone[s + 200] -= 1
        out.append(np.cumsum(gone[:-1]) > 0)
    return out


def crowd(seed):
    """Texts that share passages with edits, so that cells differ on either side."""
    draw = random.Random(seed)
    base = prose(seed, 300)
    rows = []
    for i in range(25):
        text = list(base)
        for _ in range(draw.randint(0, 6)):
            text[draw.randrange(len(text))] = draw.choice("XYZ ")
        at = draw.randrange(len(text))
        rows.append("".join(text[at : at + draw.randint(100, 1500)]) + prose(seed + i, draw.randint(0, 40)))
    return rows + ["ab" * 150, "ba" * 150 + "c"]


@pytest.mark.parametrize("together", [suffix_dedup.TOGETHER, 12, 1])
def test_repeated_strings(spark, docs, monkeypatch, together):
    """With small groups, crowded ones are split, down to single strings."""
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    texts = [(d, t) for d, t in awkward()] + [(1000 + i, t) for i, t in enumerate(crowd(5))]
    df = spark.createDataFrame([(*r, 5) for r in texts], "doc_id long, text string, rest int")
    data = [(t or "").encode() for _, t in texts]
    wanted = sorted((d or 0, len(b), int(g.sum()), int((np.diff(g.astype(int), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest()) for (d, _), b, g in zip(texts, data, removed(data), strict=True))
    found = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.report(df).collect())
    assert found == wanted
    cut = suffix_dedup.without_repeats(df)
    assert cut.columns == df.columns and cut.filter("rest <> 5").count() == 0 and cut.count() == len(texts)


def test_colliding_hashes_remove_nothing_else(spark, monkeypatch):
    """Polynomial hashes of whole cells that all collide, and keys of rows that do at first."""
    monkeypatch.setattr(suffix_dedup, "cell_hashes", lambda sums, first, size, place: np.zeros(len(first), np.uint64))
    texts = [*crowd(6), prose(900, 100), prose(900, 100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = [int(g.sum()) for g in removed([t.encode() for t in texts])]
    assert [r.n_removed for r in suffix_dedup.report(df).orderBy("doc_id").collect()] == wanted
    weak = lambda seed, *columns: F.when(seed == 0, F.lit(7)).otherwise(F.xxhash64(seed, *columns))
    assert df.select(suffix_dedup.row_key(df, weak).alias("k")).distinct().count() == len({*enumerate(texts)})


def test_order_is_that_of_the_bytes():
    draw = random.Random(4)
    texts = [("".join(draw.choice("ab") for _ in range(draw.randint(0, 30)))).encode() for _ in range(60)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.cumsum([0, *map(len, texts)])[:-1]
    room = np.array(list(map(len, texts)))
    order = suffix_dedup.sorted_order(data, suffix_dedup.prefix_sums(data), np.zeros(60, int), at, room, False)
    assert [texts[i] for i in order] == sorted(texts)
    back = suffix_dedup.sorted_order(data, suffix_dedup.prefix_sums(data), np.zeros(60, int), at + room, room, True)
    assert [texts[i][::-1] for i in back] == sorted(t[::-1] for t in texts)


# 3

def test_passages(docs, none):
    found = {r.doc_id: r for r in substring_dedup.report(docs).collect()}
    assert set(found) == {d for d, _ in awkward()}
    repeated = {d for d, r in found.items() if r.n_passages}
    assert {1, 2, 3, 4, 5, 14, 16, *range(20, 26)} <= repeated and not {6, 7, 8, 9, 10, 13, 15} & repeated
    assert found[1].class_id == 1 and 1 in found[2].shared_with and found[20].n_removed == 0 and found[25].n_removed >= 40
    assert all(20 in found[i].shared_with for i in range(20, 26))
    assert (found[7].class_id, found[7].n_removed, found[7].removed, found[7].shared_with) == (7, 0, [], [])
    assert substring_dedup.report(none).count() == 0


def paragraph_clusters(rows):
    """(doc_id, line's first word): cluster by brute force, as the set of its places; lines of repeated or similar words."""
    places = []
    for d, t in rows:
        at = 0
        for line in (t or "").split("\n"):
            n = len(re.findall(r"[^\x20\x09-\x0D]+", line))
            if n:
                places.append(((d, at), shingles(line, 5), re.findall(r"[^\x20\x09-\x0D]+", line.lower())))
            at += n
    parent = list(range(len(places)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a, u) in enumerate(places):
        for j in range(i):
            _, b, v = places[j]
            if u == v or 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    groups = defaultdict(set)
    for i, (place, _, _) in enumerate(places):
        groups[root(i)].add(place)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def found_clusters(rows):
    groups = defaultdict(set)
    for r in rows:
        if r.paragraph:
            groups[r.cluster].add((r.doc_id, r.first))
    return {frozenset(g) for g in groups.values()}


LENGTHS = [*range(1, 31), 13, 14, 16, 18, 19, 40, 45, 50, 55, 60, 70] * 3


def similar_lines():
    """Pairs of lines of each length that differ at an end or in the middle, among unlike lines; words of one to 70."""
    rows = []
    for i, n in enumerate(LENGTHS):
        words = prose(30_000 + i, n).split()
        where = (n - 1, 0, n // 2)[i % 3]
        other = [*words[:where], "changed", *words[where + 1 :]]
        rows += [(2 * i, prose(40_000 + i, 9) + "\n" + " ".join(words) + "\n" + prose(50_000 + i, 25)), (2 * i + 1, "  ".join(other).upper() + "\n\n" + prose(60_000 + i, 12))]
    return rows


def test_paragraphs_of_every_length_are_linked(spark):
    rows = similar_lines()
    wanted = paragraph_clusters(rows)
    units = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = found_clusters(units)
    pairs = lambda clusters: {(a, b) for g in clusters for a in g for b in g if a < b}
    assert pairs(found) <= pairs(wanted)
    assert len(pairs(wanted) - pairs(found)) <= 0.02 * len(pairs(wanted)) and len(wanted) > 60
    for n in set(LENGTHS):
        held = {(a, b) for a, b in pairs(wanted) if a[0] // 2 == b[0] // 2 and LENGTHS[a[0] // 2] == n}
        assert len(held & pairs(found)) >= 0.9 * len(held), n
        assert held or n < 13, n  # in shorter lines a changed word at an end leaves less than 0.8


def test_awkward_paragraphs_agree_with_brute_force(spark, docs):
    assert found_clusters(substring_dedup.repeats(docs).filter("doc_id is not null").collect()) == paragraph_clusters([r for r in awkward() if r[0] is not None])


def test_words_are_compared_where_digests_collide(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "digests", lambda words, first, end: (end - first).astype(np.int64))
    rows = [(i, prose(70_000 + i // 2, 20 + i // 2 % 3)) for i in range(24)]
    assert found_clusters(substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == {frozenset({(i, 0), (i + 1, 0)}) for i in range(0, 24, 2)}


def test_every_run_of_fifty_words_holds_a_block():
    passage = prose(77, 50)
    for seed in range(40):
        found, texts, anchors = [], [], []
        for side in (0, 1):
            text = f"{prose(100 + 2 * seed + side, 33)} {passage} {prose(300 + 2 * seed + side, 41)}"
            data = np.frombuffer(text.encode(), np.uint8)
            _, spots, _, n, keys, _, _ = substring_dedup.paragraphs([data])
            anchors.append(dict(zip(keys[n == 0].tolist(), spots[n == 0].tolist(), strict=True)))
            texts.append(data)
        shared = set(anchors[0]) & set(anchors[1])
        assert shared
        for data, known in zip(texts, anchors, strict=True):
            first, size, key, check = substring_dedup.blocks(data, np.array([known[x] for x in shared]))
            assert size.max() <= 22 and size.min() >= 10
            found.append(set(zip(key.tolist(), check.tolist(), strict=True)))
        assert found[0] & found[1]


def test_every_inline_passage_of_fifty_words_is_reported(spark):
    rows = []
    for i, n in enumerate([50] * 200 + [51, 52, 53, 54, 56, 60] * 25):
        passage = prose(5000 + i, n)
        rows += [(2 * i + side, f"{prose(10000 + 2 * i + side, 37)} {passage} {prose(20000 + 2 * i + side, 41)}") for side in (0, 1)]
    found = {r.doc_id: r for r in substring_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [d for d, _ in rows if d not in found or d // 2 * 2 not in found[d].shared_with] == []
    assert all(r.n_removed >= 20 for r in found.values() if r.doc_id % 2)


# 1 and 5

def brute_contained(docs, items, words=5):
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    runs = lambda t: [tuple(w[i : i + words]) for w in [split(t)] for i in range(len(w) - words + 1)]
    out = {}
    for item, t in items:
        wanted = set(runs(t))
        if not wanted:
            continue
        m = 1 << len(bin(len(wanted) - 1)[2:])
        for d, text in docs:
            s = runs(text)
            best = max(((len(wanted & set(s[k : k + 2 * m])), -k) for k in range(0, len(s), m)), default=(0, 0))
            if 100 * best[0] >= 80 * len(wanted) and best[0] > out.get((d, item), (0,))[0]:
                out[d, item] = (best[0], len(wanted), -best[1])
    return out


def test_items_inside_documents(spark, docs, none):
    rows = awkward()
    items = [(0, prose(9, 60)), (1, rows[0][1][:200]), (2, "too short"), (3, None), (4, prose(3, 4000)[5000:5400]), (5, prose(999, 30)), (6, prose(9, 60))]
    table = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, s string")
    found = {(r.doc_id, r.item_id): (r.n_found, r.n_item, r.first_word) for r in containment.contained(docs, table).collect()}
    assert found == brute_contained(rows, items)
    kept = {r.doc_id for r in decontamination.without_leaks(docs, table).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in found}
    assert containment.contained(docs, table.limit(0)).count() == 0 and containment.contained(none, table).count() == 0


def test_bitmap_only_saves_work(spark, docs, monkeypatch):
    items = spark.createDataFrame([(i, prose(9, 60)[i * 10 :]) for i in range(5)], "item_id long, text string")
    full = sorted(containment.contained(docs, items).collect())
    monkeypatch.setattr(containment, "MAX_BITS", 64)
    monkeypatch.setattr(containment, "MAX_BROADCAST_ROWS", 0)
    assert sorted(containment.contained(docs, items).collect()) == full and full


def test_licenses(spark):
    texts = [(1, "a b c\nLicensed under the Apache License, Version 2.0."), (2, "RELEASED under the MIT license!"), (3, "licensed under nothing at all"), (4, None), (5, prose(8, 500) + " " + licenses.NOTICES[4][1] + " " + prose(9, 500))]
    found = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert found == {(1, "Apache-2.0"), (2, "MIT"), (5, "MIT")}


def test_only_the_best_license_of_a_place_is_reported(spark):
    """Full texts, headers and sentences of one family, alone and together."""
    at = {(name, text): i for i, (name, text) in enumerate(licenses.templates())}
    full = {name: text for name, text in licenses.templates()}
    headers = [text for name, text in licenses.NOTICES if name.startswith(("GPL-", "LGPL-", "AGPL-")) and "free software" in text]
    texts = [full["GPL-3.0"], full["GPL-2.0"], full["LGPL-2.1"], full["Apache-2.0"], full["BSD-2-Clause"], full["BSD-3-Clause"], full["ISC"], full["MPL-2.0"], *headers]
    texts = [f"{prose(90_000 + i, 50)}\n{t}\n{prose(91_000 + i, 50)}" for i, t in enumerate(texts)]
    wanted = [{"GPL-3.0"}, {"GPL-2.0"}, {"LGPL-2.1"}, {"Apache-2.0"}, {"BSD-2-Clause"}, {"BSD-3-Clause"}, {"ISC"}, {"MPL-2.0"}, *({name} for name, text in licenses.NOTICES if text in headers)]
    texts += [texts[8] + " " + texts[9], "It is licensed under the GNU General Public License, version 2, so this work is licensed under the GNU General Public License, version 2."]
    wanted += [wanted[8] | wanted[9], {"GPL-2.0"}]
    assert len(at) == len(licenses.templates()) and len(headers) >= 5
    found = defaultdict(set)
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        found[r.doc_id].add(r.license)
    assert [found[i] for i in range(len(texts))] == wanted


# 2

RULES = url_filter.RULES


def judged(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = re.split(r"[?#]", rest[end:])[0]
    fits = [(len(h) + len(p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


def test_urls_against_rules_and_labels(spark):
    urls = ["http://A.Example.COM/en/7?x", "https://b.example.com/en/6", "x://net/de/1", "http://example.net/de/8#/a", "http://notnet/de/", "http://y.org/es/", "http://y.org?/es/", "nothing", None, "", "http://spam.biz/buy/pills", "http://spam.biz/buy/other", "http://good.biz/read/pills", "a://b://c/d", "http://spam.biz/buy/pills"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    labelled = spark.createDataFrame([(f"http://spam.biz/buy/pills{i}", True) for i in range(8)] + [(f"http://s{i}.biz/buy/pills", i < 7) for i in range(8)] + [(f"http://good.biz/read/{i}", False) for i in range(20)] + [(None, True)], "url string, bad boolean")
    rows = {r.page_id: r for r in url_filter.judge(pages, labelled, min_support=0.1, min_confidence=0.8).collect()}
    # brute-force mining: every token set that is frequent with the label and sure enough
    baskets = [(set(r.t), r.bad) for r in labelled.filter("url is not null").select(url_filter.tokens().alias("t"), "bad").collect()]
    from itertools import combinations
    rules = {}
    for n in range(1, 5):
        for s in {c for t, _ in baskets for c in combinations(sorted(t), n)}:
            both, freq = sum(b for t, b in baskets if set(s) <= t), sum(set(s) <= t for t, _ in baskets)
            if both >= 0.1 * len(baskets) and both / freq >= 0.8:
                rules[s] = both / freq
    has = {r.page_id: set(r.t) for r in pages.select("page_id", url_filter.tokens().alias("t")).collect()}
    for i, u in enumerate(urls):
        host, path, rule = judged(u)
        blocked = u is not None and any(set(s) <= has[i] for s in rules)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule[0] if rule else None)
        assert rows[i].verdict == (rule[1] if rule else "block" if blocked else "allow"), u
    assert rows[10].verdict == "block" and len(rows) == len(urls)
    assert url_filter.judge(pages, labelled.limit(0)).filter("verdict = 'block' and rule is null").count() == 0


# 4

def test_packing_is_gapless_and_exact(spark, docs, none):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack(docs).collect()
    seen = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    wanted = Counter()
    for d, t in awkward():
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            wanted[d, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert seen == wanted
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == -(-sum(r.length for r in rows) // 2048)
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("text", ["a\x1cb c\x1fd", "ﬁ ½ İstanbul \u0301x e\u0301", "<|endoftext|> it's WE'LL don't 12.5%", "a\u00a0b\u2003c\u0085d\u200bz", "日本語 テスト\n\n🙂🙂"])
def test_words_are_tokenized_as_texts_are(spark, text):
    from tokenizers import Tokenizer

    ids = np.array([*Tokenizer.from_file(packing.tokenizer_path()).encode(text, add_special_tokens=False).ids, 0], "<u4")
    row = packing.pieces(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.length, row.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_ids_are_the_tokenizers_on_fuzzed_texts():
    from tokenizers import Tokenizer

    path, draw = packing.tokenizer_path(), random.Random(1)
    model, ids = Tokenizer.from_file(path), packing.word_ids(path)
    alphabet = [*"aZ'stbİıſﬁΣσςßéÉ\u0301\u0307 \n.,!?;:|<>-_#0½Ⅷªµ日ÅK\u200b\xa0\x85\x1d🙂×÷Ÿ", "'s", "'LL", "<|endoftext|>", "<|", "|>", "ǅ", "…"]
    texts = [None, *("".join(draw.choice(alphabet) for _ in range(draw.randint(0, 12))) for _ in range(30_000))]
    wanted = [np.array(e.ids, "<u4").tobytes() for e in model.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, ids(texts), wanted, strict=True) if a != b] == []


def test_other_vocabularies_tokenize_whole_texts():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path("byte_bpe_50k.json")
    texts = ["Hello,  world's\n\n x", "", "é ü|"]
    assert packing.word_ids(path)(texts) == [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]


def fewest_bins(pieces: list[int], capacity: int) -> int:
    """Exhaustive search."""
    pieces, best, bins = sorted(pieces, reverse=True), len(pieces), []

    def place(i: int) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(pieces):
            best = len(bins)
            return
        for b in {full: b for b, full in enumerate(bins) if full + pieces[i] <= capacity}.values():
            bins[b] += pieces[i]
            place(i + 1)
            bins[b] -= pieces[i]
        bins.append(pieces[i])
        place(i + 1)
        bins.pop()

    place(0)
    return best


def test_dominance_never_costs_a_bin():
    draw, fixed = random.Random(7), 0
    cases = [(20, [4, 5, 8, 9, 9, 11, 11]), (12, [3, 3, 4, 5, 9, 10, 12]), (10, []), (10, [10, 10]), (10, [5, 5, 5])]
    for _ in range(4000):
        capacity = draw.choice([10, 12, 20, 30])
        cases.append((capacity, [draw.randint(1, capacity) for _ in range(draw.randint(1, 9))]))
    for capacity, lengths in cases:
        left, plan = Counter(lengths), packing.Plan(capacity)
        packing.reduce_by_dominance(left, plan)
        bins = sum(b for b, _ in plan.groups)
        fixed += bins
        assert bins + fewest_bins(list(left.elements()), capacity) == fewest_bins(lengths, capacity), (capacity, lengths)
    assert fixed > 4000


def least_bins(lengths: Counter, capacity: int) -> int:
    """A lower bound: pieces over half a bin, and what the rest needs beyond the room beside them, for each cut a."""
    best = -(-sum(x * n for x, n in lengths.items()) // capacity)
    for a in range(capacity // 2 + 1):
        alone = sum(n for x, n in lengths.items() if x > capacity - a)
        half = [(x, n) for x, n in lengths.items() if capacity < 2 * x and x <= capacity - a]
        room = sum(n * (capacity - x) for x, n in half)
        rest = sum(x * n for x, n in lengths.items() if a <= x and 2 * x <= capacity)
        best = max(best, alone + sum(n for _, n in half) + max(0, -(-(rest - room) // capacity)))
    return best


def test_plans_hold_every_piece_and_meet_the_bound():
    for seed in range(60):
        draw = random.Random(seed)
        capacity = draw.choice([10, 30, 100])
        lengths = Counter(draw.randint(1, capacity) for _ in range(draw.randint(1, 400)))
        plan, used = packing.plan_bins(dict(lengths), capacity), Counter()
        for bins, content in plan.groups:
            assert bins > 0 and sum(a * n for a, n in content) <= capacity
            for a, n in content:
                used[a] += bins * n
        assert used == lengths
        assert sum(b for b, _ in plan.groups) <= least_bins(lengths, capacity) + 1


# 6

def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "u1", "same"), (2, "u2", "same"), (3, None, None), (4, "u", ""), (5, "u\r\nX: y", "é" * 9), (6, "u6", "same"), (None, "lost", "alone")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    found = {r.page_id: r for r in warc.archive_and_read(pages).collect()}
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), i or -1)
    for i, _, h in rows:
        data = (h or "").encode()
        r = found[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        revisit = i is not None and last[h or ""] != i
        assert (r.record_type, r.refers_to) == (("revisit", last[h or ""]) if revisit else ("response", None))
        assert bytes(r.payload) == (b"" if revisit else data)
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_repeated_pages_have_one_response_on_every_plan(spark, tmp_path):
    """Equal rows, equal page_ids with other payloads or urls, lost page_ids and a hot payload."""
    rows = [(i, f"u{i}", f"page {i}") for i in range(60)] * 2 + [(i, "v", "hot") for i in range(100, 160)] + [(159, "w", "hot")] * 3 + [(None, "n", "hot"), (None, "n", None), (7, "other", "page 7"), (500, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.repartition(8).write.parquet(f"{tmp_path}/pages")
    seen = Counter((i, u or "", h or "") for i, u, h in rows)
    wanted = Counter()
    for (i, u, h), n in seen.items():
        last = max(((j, v) for j, v, x in seen if x == h and j is not None), default=None)
        if i is None or (i, u) == last:
            wanted[i, u, len(h), "response", None] += n if i is None else 1
            n = 0 if i is None else n - 1
        if n:
            wanted[i, u, len(h), "revisit", last[0]] += n
    for table in (pages.repartition(1), pages.repartition(8), spark.read.parquet(f"{tmp_path}/pages")):
        found = Counter((r.page_id, r.url, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_and_read(table).collect())
        assert found == wanted
    alike = warc.archive_and_read(pages, least=5).filter("page_id between 100 and 160")
    assert alike.filter("record_type <> 'response'").count() == 0 and alike.count() == 63


def test_full_bitmaps_only_cost_time(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", f"page {i % 90}") for i in range(120)], "page_id long, url string, html string")
    found = [sorted(tuple(r[:6]) for r in warc.archive_and_read(pages).collect())]
    monkeypatch.setattr(warc, "BITS", 64)
    found.append(sorted(tuple(r[:6]) for r in warc.archive_and_read(pages).collect()))
    assert found[0] == found[1] and len(found[0]) == 120


def test_directories_agree_with_another_writer(tmp_path):
    import io
    import zipfile

    buffer = io.BytesIO()
    writer = warc.Writer(buffer)
    writer.member("a", iter([b"hello ", b"world"]))
    writer.member("b", iter([]))
    writer.close()
    with zipfile.ZipFile(io.BytesIO(buffer.getvalue())) as z:
        assert z.read("a") == b"hello world" and z.read("b") == b"" and z.testzip() is None
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w", zipfile.ZIP_STORED) as z:
        z.writestr("x", b"12345")
        with z.open("y", "w", force_zip64=True) as f:
            f.write(b"678")
        z.comment = b"a comment PK"
    other.seek(0)
    members = {m.name: m for m in warc.directory(other, len(other.getvalue()))}
    for name, data in (("x", b"12345"), ("y", b"678")):
        start = warc.data_start(other, members[name])
        assert other.getvalue()[start : start + members[name].size] == data
    with pytest.raises(ValueError):
        warc.directory(io.BytesIO(b"nothing"), 7)


# 9

def test_toxicity_on_held_out_rows(spark):
    draw = random.Random(3)
    bad = ["scum", "moron", "idiotes", "idiotas", "idiotic"]
    rows = []
    for i in range(700):
        words = prose(1000 + i, 40).split()
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            words.insert(draw.randrange(40), draw.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs = df.select("doc_id", "text", F.lit("x").alias("toxic")).union(spark.createDataFrame([(None, None, "x"), (9001, "", "x")], "doc_id long, text string, toxic string"))
    found = {r.doc_id: r.score for r in toxicity.score(docs, df.filter("doc_id % 3 > 0")).collect()}
    test = [(found[i] >= 0.5, t == 1) for i, _, t in rows if i % 3 == 0]
    assert sum(a == b for a, b in test) / len(test) > 0.97
    assert all(0 <= s <= 1 for s in found.values()) and found[9001] < 0.5 and found[None] == found[9001]
    assert toxicity.score(docs, df.limit(0)).filter("score <> 0").count() == 0
    kept = {r.doc_id for r in toxicity.clean(docs, df.filter("doc_id % 3 > 0")).collect()}
    assert None in kept and 9001 in kept and 1 in kept and 0 not in kept


def test_label_model_and_classifier_follow_brute_force(spark):
    """Expectation maximisation and logistic regression written out in numpy, over every row."""
    draw = np.random.default_rng(5)
    n, toxic = 4, draw.random(400) < 0.3
    x = draw.random((400, n)) < np.where(toxic[:, None], [0.7, 0.5, 0.4, 0.2], [0.02, 0.1, 0.05, 0.2])
    x[:, 1] |= x[:, 0] & (draw.random(400) < 0.8)
    label = np.where(draw.random(400) < 0.25, toxic.astype(float), np.nan)
    rows = [(np.flatnonzero(v).tolist(), None if np.isnan(t) else int(t), 1) for v, t in zip(x, label, strict=True)]
    patterns = spark.createDataFrame(rows, "votes array<int>, toxic int, docs long").groupBy("votes", "toxic").agg(F.sum("docs").alias("docs"))
    model = toxicity.fit_label_model(patterns, n, rounds=3)

    p, known = np.where(np.isnan(label), 0, label), ~np.isnan(label)
    use = known
    for step in range(4):
        t, c = (p * use).sum(), ((1 - p) * use).sum()
        rates = np.stack([(((1 - p) * use) @ x + 0.5) / (c + 1), ((p * use) @ x + 0.5) / (t + 1)], 1)
        prior, weight = (t + 0.5) / (t + c + 1), np.ones(n)
        if step:
            for i in range(n):
                for j in range(n):
                    if i != j:
                        both = x[:, i] & x[:, j]
                        joint = np.array([((1 - p) * both).sum(), (p * both).sum()])
                        a, b = rates[i], rates[j]
                        r = (joint / (np.array([c, t]) + 1) - a * b) / np.sqrt(a * (1 - a) * b * (1 - b))
                        weight[i] += max(0.0, (joint * r).sum() / (joint.sum() + 1e-9) - toxicity.INDEPENDENT) / (1 - toxicity.INDEPENDENT)
        weight = 1 / weight
        odds = np.log(prior / (1 - prior)) + (weight * np.where(x, np.log(rates[:, 1] / rates[:, 0]), np.log((1 - rates[:, 1]) / (1 - rates[:, 0])))).sum(1)
        p, use = np.where(known, np.nan_to_num(label), 1 / (1 + np.exp(-odds))), np.ones(400)
    assert model.prior == pytest.approx(prior) and model.rates == pytest.approx(rates) and model.weight == pytest.approx(weight)

    def logistic_regression(x, y):
        theta = np.zeros(x.shape[1])
        for _ in range(50):
            g = 1 / (1 + np.exp(-x @ theta))
            theta -= np.linalg.solve((x * (g * (1 - g))[:, None]).T @ x + 0.05 * np.eye(len(theta)), x.T @ (g - y) + 0.05 * theta)
        return theta

    assert (model.scale, model.shift) == pytest.approx(tuple(logistic_regression(np.stack([odds[known], np.ones(known.sum())], 1), label[known])), rel=1e-3)
    posterior = 1 / (1 + np.exp(-(model.scale * odds + model.shift)))
    bias, weights = toxicity.fit_classifier(patterns, model, n)
    assert [*weights, bias] == pytest.approx(logistic_regression(np.concatenate([x, np.ones((400, 1))], 1).astype(float), posterior), rel=1e-3, abs=1e-3)


def test_training_rows_are_bounded_and_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i % 900, f"text {i % 1000}", "x") for i in range(3000)], "doc_id long, text string, toxic string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(800)], "doc_id long, toxic int")
    found = [sorted(map(tuple, toxicity.sampled(docs.repartition(n), marks, 100).collect())) for n in (1, 7)]
    assert found[0] == found[1] and 60 <= len(found[0]) <= 100
    every = toxicity.sampled(docs, marks, 10_000).collect()
    assert len(every) == len({(i % 900, f"text {i % 1000}") for i in range(3000) if i % 900 < 800})


def test_toxicity_judges_rows_by_their_texts(spark):
    """Repeated rows, rows that share a doc_id or lack one, very long texts and columns with clashing names."""
    train = [(i, prose(1000 + i, 40) + (" scum moron" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    odd = [(9000, "nice words here"), (9000, "scum moron you scum"), (9001, "scum moron"), (9001, "scum moron"), (None, "moron scum"), (None, "fine"), (9002, prose(5, 60_000)), (9003, prose(6, 60_000) + " scum moron"), (9004, None), (9005, "")]
    docs = spark.createDataFrame([(d, t, "v", 0.0) for d, t, *_ in [*train, *odd]], "doc_id long, text string, votes string, score double")
    labels = spark.createDataFrame([(d, t) for d, _, t in train] + [(9004, 0), (None, 1)], "doc_id long, toxic int")
    kept = sorted((r.doc_id or 0, len(r.text or "")) for r in toxicity.clean(docs, labels).collect() if r.doc_id is None or r.doc_id >= 9000)
    assert kept == sorted((d or 0, len(t or "")) for d, t in odd if "scum" not in (t or ""))
    assert toxicity.score(docs, labels).count() == len(train) + len(odd)
    assert toxicity.score(docs.limit(0), labels).count() == 0 and toxicity.clean(docs.limit(0), labels).count() == 0


def test_held_out_is_crc_of_the_id(spark):
    rows = spark.range(50).select("id", toxicity.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


# 10

def test_next_document_wraps_and_passes_ranges(spark, docs, none):
    rows = awkward()
    order = sorted(((2**63 - 1 if d is None else d), t or "") for d, t in rows)
    wanted = sorted((k, t, order[(i + 1) % len(order)][1]) for i, (k, t) in enumerate(order))
    found = sorted(((2**63 - 1 if r.doc_id is None else r.doc_id), r.text, r.next) for r in merkle.with_next(docs).collect())
    assert found == wanted and merkle.with_next(none).count() == 0
    one = merkle.with_next(spark.createDataFrame([(1, "a")], "doc_id long, text string")).first()
    assert one.next == "a"


def test_trees_locate_edits(spark):
    lines = [f"line {i} " + "y" * 70 for i in range(30)]
    other = [*lines[:17], "edited", *lines[18:]]
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other), "\n".join(lines))], "a string, b string, c string")
    df = merkle.trees(df, "a", "a", "b", "c")
    df = merkle.trees(df, "b", "b", "c", *[c for c in df.columns if c[:2] == "a_"])
    df = merkle.trees(df, "c", "c", *[c for c in df.columns if c[:2] in ("a_", "b_")])
    row = df.select(merkle.edits("a", "b").alias("e"), merkle.likeness("a", "b").alias("ab"), merkle.likeness("a", "c").alias("ac"), (F.col("a_root") == F.col("c_root")).alias("same")).first()
    assert row.e.sections == [2] and row.e.paragraphs == [17] and 0.9 < row.ab < 1 and row.ac == 1 and row.same


def test_op3_fetches_the_wanted_lines_only(spark):
    """A line's words come from the one place that is named; other lines with its key and other documents are not cut."""
    from sparkloom.llm import substring_dedup as sd

    line = "one two  three four five six seven EIGHT"
    docs = spark.createDataFrame([(1, f"short\n{line}\nalpha beta gamma delta epsilon zeta eta theta"), (1, "other text"), (2, line), (3, None)], "doc_id long, text string")
    rows = sd.all_paragraphs(docs).filter("n_shingles > 3").collect()
    key = next(r.key for r in rows if r.doc_id == 2)
    assert [r.first for r in rows if r.key == key and r.doc_id == 1] == [1]
    wanted = spark.createDataFrame([(key,)], "doc_id long")
    places = spark.createDataFrame([(key, 1, 1), (key + 1, 1, 9), (key, 2, 5)], "key long, id long, first long")
    found = sd.paragraph_texts(docs, wanted, places).collect()
    assert [(r.doc_id, r.text) for r in found] == [(key, "one two three four five six seven eight")]


def test_op3_cuts_texts_together(monkeypatch):
    """Many texts are hashed at once, with what each gives alone: nothing reaches from one text into the next."""
    from sparkloom.llm import substring_dedup as sd

    texts = ["", prose(1, 80), "a b c", " \n\n", f"{prose(2, 300)}\n{prose(3, 9)}  \r\n\t{prose(4, 60)}", "one two three four", prose(1, 80), "É\x0bÉ  x\n", *(prose(50 + i, 5 * i) for i in range(40)), ""]
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    runs = []
    monkeypatch.setattr(sd, "hashed_shingles", lambda words, k, f=sd.hashed_shingles: runs.append(len(words)) or f(words, k))
    places = lambda columns, of: sorted(zip(of(columns[0]), *(x.tolist() for x in columns[1:]), strict=True))
    found = places(sd.paragraphs(data), lambda text: text.tolist())
    assert len(runs) == 1
    assert found == sorted(x for i, d in enumerate(data) for x in places(sd.paragraphs([d]), lambda text, i=i: [i] * len(text)))
    spots = [np.arange(i % 3, 400 * (i % 4), 150) for i in range(len(data))]
    runs.clear()
    found = places(sd.blocks_of(data, np.concatenate(spots), np.array([len(s) for s in spots])), lambda text: text.tolist())
    assert len(runs) == 1 and len(found) > 100
    assert found == sorted((i, *map(int, x)) for i, d in enumerate(data) for x in zip(*sd.blocks(d, spots[i]), strict=True))


def test_op3_gathers_the_rows_of_a_document_across_batches():
    """Rows are sorted by doc_id, null first; a document can go on over several batches."""
    import pyarrow as pa

    from sparkloom.llm import substring_dedup as sd

    ids = [None, None, -3, 0, 0, 0, 0, 0, 0, 0, 4, 5, 5, 9]
    rows = pa.table({"doc_id": pa.array(ids, pa.int64()), "first": pa.array(range(len(ids)), pa.int64())})
    wanted = {d: [{"first": i} for i, x in enumerate(ids) if x == d] for d in ids}
    for cut in ([14], [1, 13], [2, 1, 3, 2, 2, 4], [1] * 14, [3, 0, 7, 4]):
        ends = np.cumsum(cut)
        batches = [b for e, n in zip(ends, cut, strict=True) for b in rows.slice(e - n, n).to_batches() or [pa.RecordBatch.from_pylist([], rows.schema)]]
        found = [x for keys, lists in sd.by_document(iter(batches)) for x in zip(keys.to_pylist(), lists.to_pylist(), strict=True)]
        assert found == list(wanted.items()), cut
    assert list(sd.by_document(iter([]))) == []


def test_op3_gathers_no_lists_in_aggregates(spark, docs):
    """A list for each document in a hash aggregate falls back to sorting them; the rows are sorted at once instead."""
    plan = substring_dedup.report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "SortMergeJoin [key" not in plan
