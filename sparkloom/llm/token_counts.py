"""Token counts of every prefix of every text, stored once and asked often.

A text is cut where no piece of the vocabulary can reach across. Within such a unit the counts of all prefixes come from
dynamic programming: the last token of a prefix is the one piece that ends there, stands alone as one token and is
compatible with the last token before it, so each prefix has the count of a shorter one and one more. A unit's counts are
made once per task; a text's are those of its units after each other, stored as differences. Truncation and budgets are
answered from the stored counts."""

from __future__ import annotations

import operator
import re
import sys
from array import array

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import read, save

TOKENIZER = "piece_bpe_32k.model"
LIMIT = 4096
SPACE = "▁"
#: Units and pairs of tokens that a task keeps at once, and the longest such unit in code points; texts in a batch; code
#: points of a text that are cut into units at once.
KEPT_UNITS, KEPT_PAIRS, LONGEST, TEXTS, STEP = 800_000, 1_000_000, 64, 500, 1 << 20
#: Longer units are not held against the library as well.
HELD = 1 << 16
#: How the vocabulary's file marks ordinary pieces, pieces set by hand and byte-pair models.
ORDINARY, BY_HAND, BYTE_PAIRS = 1, 4, 2
#: Ways to cut a text into units and the places where one begins, the finest first. The first one that leaves every piece
#: of the vocabulary whole is taken. Letters come without the superscript two, which public vocabularies join with marks.
LETTER = r"[^\W\d_²]"
CUTS = [
    (rf"\n+|{SPACE}*{LETTER}+|{SPACE}*(?:(?!{LETTER})[^{SPACE}\n])+|{SPACE}+", rf"(?<=[^{SPACE}]){SPACE}"),
    (rf"{SPACE}*[^{SPACE}]+|{SPACE}+", rf"(?<=[^{SPACE}]){SPACE}"),
    (r"(?s).+", None),
]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Prefixes:
    """Counts of prefixes under a sentencepiece byte-pair model with byte fallback and without normalization."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != BYTE_PAIRS or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix or rules.name != "identity" or rules.remove_extra_whitespaces or not rules.escape_whitespaces or any(p.type == BY_HAND for p in model.pieces):
            raise ValueError("only byte-pair models with byte fallback, without normalization and without symbols set by hand")
        self.before = SPACE if rules.add_dummy_prefix else ""
        rules.add_dummy_prefix = False
        self.library = SentencePieceProcessor(model_proto=model.SerializeToString())
        pieces = [p.piece for p in model.pieces if p.type == ORDINARY]
        units, edge = next((re.compile(u), e) for u, e in CUTS if all(len(re.findall(u, p)) == 1 for p in pieces))
        self.units, self.edge = units, edge and re.compile(edge)
        #: Tokens by number: text and ids. Number 0 is the beginning of a unit.
        self.texts, self.ids = ["", *pieces], [[], *self.library.encode(pieces)]
        self.automaton = ahocorasick.Automaton()
        for number, (piece, ids) in enumerate(zip(self.texts, self.ids, strict=True)):
            if number and len(ids) == 1:  # else the piece is never a token
                self.automaton.add_word(piece, (len(piece), number))
        self.automaton.make_automaton()
        self.rare: dict[str, int] = {}
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether b stays the token that it is after a."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        found = self.pairs[a << 32 | b] = self.library.encode(self.texts[a] + self.texts[b]) == self.ids[a] + self.ids[b]
        return found

    def in_bytes(self, letter: str) -> int:
        """The number of a code point that is no piece: its bytes."""
        if letter not in self.rare:
            self.rare[letter] = len(self.texts)
            self.texts.append(letter)
            self.ids.append(self.library.encode(letter))
        return self.rare[letter]

    def of_unit(self, unit: str) -> list[int]:
        """Token counts of the unit's prefixes of 0, 1, 2, ... code points."""
        count, last, pairs, i = [0], [0], self.pairs, 1  # i: the prefix that is looked at
        for end, (size, number) in [*self.automaton.iter(unit), (len(unit), (0, 0))]:
            while i <= end:  # no piece is the last token of prefix i
                letter = self.in_bytes(unit[i - 1])
                if i > 1 and not self.compatible(last[-1], letter):  # under no model known
                    return self.one_by_one(unit)
                count.append(count[-1] + len(self.ids[letter]))
                last.append(letter)
                i += 1
            if i == end + 1 and size:
                before = last[i - size]
                if before:
                    fits = pairs.get(before << 32 | number)
                    if fits is None:
                        fits = self.compatible(before, number)
                else:
                    fits = size == i
                if fits:
                    count.append(count[i - size] + 1)
                    last.append(number)
                    i += 1
        return count

    def one_by_one(self, unit: str) -> list[int]:
        """For a model under which tokens aren't settled by pairs: each prefix is encoded."""
        return [len(self.library.encode(unit[:i])) for i in range(len(unit) + 1)]

    def learn(self, units: list[str]) -> dict[str, np.ndarray]:
        """Keeps the counts of new units, held against the library's for the whole unit; returns those too large to be kept."""
        large, held = {}, self.library.encode([u if len(u) <= HELD else "" for u in units], num_threads=1)
        for u, ids in zip(units, held, strict=True):
            count = self.of_unit(u)
            if count[-1] != len(ids) and len(u) <= HELD:
                count = self.one_by_one(u)
            step = list(map(operator.sub, count[1:], count))
            if len(u) <= LONGEST and max(step) < 128 and min(step) >= -128:
                self.known[u] = array("b", step).tobytes()
            else:
                large[u] = np.array(step, np.int32)
        return large

    def of_units(self, units: list[str]) -> np.ndarray:
        """Differences of the counts of all prefixes of the units after each other."""
        new = set(units).difference(self.known)
        if len(self.known) + len(new) > KEPT_UNITS:
            self.known.clear()
            new = set(units)
        large = self.learn(list(new))
        if not large:
            return np.frombuffer(b"".join(map(self.known.__getitem__, units)), np.int8)
        return np.concatenate([large[u] if u in large else np.frombuffer(self.known[u], np.int8) for u in units])

    def of_text(self, text: str) -> tuple[bytes, int]:
        """(stored counts, tokens): a byte with the width of a number, then the differences of the counts of all prefixes."""
        s = self.before + text.replace(" ", SPACE) if text else ""
        parts, at = [np.zeros(0 if s and self.before else 1, np.int8)], 0
        while at < len(s):
            cut = self.edge.search(s, at + STEP) if self.edge and at + STEP < len(s) else None
            end = cut.start() if cut else len(s)
            parts.append(self.of_units(self.units.findall(s, at, end)))
            at = end
        step = np.concatenate(parts)
        width = 1 if -128 <= step.min() and step.max() < 128 else 4
        return bytes([width]) + step.astype(f"<i{width}").tobytes(), int(step.sum(dtype=np.int64))


def prefixes_of(tokenizer: str) -> Prefixes:
    """The worker's own, kept between its tasks: the package is pickled by value, so its modules keep nothing there."""
    kept = sys.__dict__.setdefault("_sparkloom_prefixes", {})
    if tokenizer not in kept:
        kept[tokenizer] = Prefixes(tokenizer)
    return kept[tokenizer]


def counts_of(stored: bytes) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, 2, ... code points."""
    out = np.cumsum(np.frombuffer(stored, f"<i{stored[0]}", offset=1), dtype=np.int64)
    out[0] = 0
    return out


def token_prefixes(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, prefixes for each row of docs (doc_id, text); prefixes holds the token count of every prefix.

    Counts are the library's for the same prefix. Null is the empty text, which has no tokens; repeated rows are counted
    each; a table without rows gives none."""
    tokenizer = tokenizer or tokenizer_path()

    def run(batches):
        import pyarrow as pa

        prefixes = prefixes_of(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                found = [prefixes.of_text(t or "") for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([n for _, n in found], pa.int64()), pa.array([p for p, _ in found], pa.binary())], ["doc_id", "n_bytes", "n_tokens", "prefixes"])

    rows = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, prefixes binary")


def tokens_before(prefixes: str | Column, n_chars: str | Column) -> Column:
    """Tokens of the first n_chars code points of the text (of all, if it has fewer)."""

    @F.pandas_udf("long")
    def count(stored, n):
        import pandas as pd

        found = [counts_of(p) for p in stored]
        return pd.Series([int(c[min(max(int(k), 0), len(c) - 1)]) for c, k in zip(found, n, strict=True)])

    return count(prefixes, n_chars)


def longest_prefix(prefixes: str | Column, budget: int) -> Column:
    """Code points of the longest prefix of at most `budget` tokens."""

    @F.pandas_udf("long")
    def longest(stored):
        import pandas as pd

        return pd.Series([int(np.flatnonzero(counts_of(p) <= budget)[-1]) for p in stored])

    return longest(prefixes)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents from their stored prefix counts, and the code points that fit into the limit. Null
    and empty texts have no tokens, repeated rows are counted each, no rows give none."""
    stored = save(token_prefixes(read(spark, sf_dir, "documents")), "prefixes")
    return stored.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), longest_prefix("prefixes", LIMIT).alias("fit_chars"))
