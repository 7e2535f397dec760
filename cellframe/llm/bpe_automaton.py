"""Byte-level BPE by a tokenization automaton.

``MergeAutomaton`` compiles a merge list into a deterministic automaton over
tokens that accepts exactly the tokenizations the merges produce.  It starts
with one state whose arcs are the single bytes.  Each merge (u, v) adds one
gadget: the state reached by u is replaced by a copy without the arc v, and
wherever u could be read, an arc for the merged token is added that leads to
where v led.  So there is one state more per merge, and all arcs of a token
lead to one state.  Arcs are looked up in the merge table along the two spines
of a pair of tokens and kept in a transition table.

Encoding walks a pre-split word with table lookups: for every prefix there is
exactly one token whose arc leads to it.  Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm.common import rows_of

# The pattern that byte-level pre-tokenizers split with.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 60


def byte_letters() -> list[str]:
    """Letter that stands for each byte: itself if printable in Latin-1, else the next one from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class MergeAutomaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], letters: list[str]):
        self.token = {}  # label to token, of tokens that have an arc
        self.after = {}  # token to the state its arcs lead to
        self.without = [(-1, -1)]  # state to (state it copies, arc it lacks)
        self.parts: dict[int, tuple[int, int, int]] = {}  # token to (left, right, when)
        self.rule: dict[tuple[int, int], int] = {}
        self.arcs: dict[tuple[int, int], bool] = {}
        self.longest = 1
        for c in letters:
            if c in vocab:
                self.token[c] = vocab[c]
                self.after[vocab[c]] = 0
        for at, (a, b) in enumerate(merges):
            self._gadget(at, a, b, vocab[a + b])
        self.arcs.clear()  # those seen while merges were still missing

    def _gadget(self, at: int, a: str, b: str, merged: int) -> None:
        u, v = self.token.get(a), self.token.get(b)
        if u is None or v is None or merged in self.after or not self._arc(u, v):
            return  # no word ever reaches this merge
        self.token[a + b] = merged
        self.longest = max(self.longest, len(a) + len(b))
        self.parts[merged] = (u, v, at)
        self.after[merged] = self.after[v]
        self.without.append((self.after[u], v))
        self.after[u] = len(self.without) - 1
        self.rule[u, v] = at

    def _arc(self, u: int, w: int) -> bool:
        """Whether w may follow u: no gadget took an arc off a spine before the token over it was made."""
        rule, parts = self.rule, self.parts
        spine, x, made = [], w, NEVER
        while True:
            spine.append((x, made))
            if x not in parts:
                break
            x, _, made = parts[x]
        z, made = u, NEVER
        while True:
            for x, limit in spine:
                at = rule.get((z, x))
                if at is not None and at < made and at <= limit:
                    return False
            if z not in parts:
                return True
            _, z, made = parts[z]

    def encode(self, word: str) -> list[int]:
        """Tokens of one pre-split word, given in byte letters."""
        whole = self.token.get(word)
        if whole is not None:
            return [whole]
        n, token, arcs, after, longest = len(word), self.token, self.arcs, self.after, self.longest
        last, start = [0] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for j in range(max(0, i - longest), i):
                w = token.get(word[j:i])
                if w is None:
                    continue
                if j:
                    key = (after[last[j]], w)
                    ok = arcs.get(key)
                    if ok is None:
                        ok = arcs[key] = self._arc(last[j], w)
                    if not ok:
                        continue
                last[i], start[i] = w, j
                break
        out, i = [], n
        while i:
            out.append(last[i])
            i = start[i]
        return out[::-1]


class Codec:
    """Whole texts to ids and back, for one tokenizer file.

    Words met before are kept up to a bound, long ones never.  Arcs met before
    are kept likewise.
    """

    KEEP_WORDS, KEEP_ARCS, KEEP_LENGTH = 300_000, 2_000_000, 64
    _made: dict[str, Codec] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        letters = byte_letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, letters)
        self.letter_of = dict(enumerate(letters))
        byte_of = {c: b for b, c in enumerate(letters)}
        self.label = {str(i): bytes(byte_of[c] for c in t) for t, i in model["vocab"].items()}
        self.special = {t["content"]: str(t["id"]) for t in spec.get("added_tokens", [])}
        self.label |= {i: t.encode() for t, i in self.special.items()}
        self.label_of = {int(i): t for i, t in self.label.items()}
        self.split = regex.compile(SPLIT_PATTERN)
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.words: dict[str, str] = {}

    @classmethod
    def of(cls, path: str) -> Codec:
        """One per Python worker; workers serve many tasks."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _word(self, piece: str) -> str:
        a = self.automaton
        ids = ",".join(map(str, a.encode(piece.encode().decode("latin-1").translate(self.letter_of))))
        if len(piece) <= self.KEEP_LENGTH:
            if len(self.words) >= self.KEEP_WORDS:
                self.words.clear()
            self.words[piece] = ids
        if len(a.arcs) > self.KEEP_ARCS:
            a.arcs.clear()
        return ids

    def encode(self, text: str) -> str:
        """Decimal ids joined by commas."""
        known, out = self.words.get, []
        for segment in self.marks.split(text) if self.marks else [text]:
            if segment in self.special:
                out.append(self.special[segment])
            elif segment:
                out += [known(p) or self._word(p) for p in self.split.findall(segment)]
        return ",".join(out)

    def decode(self, ids: str) -> str:
        if not ids:
            return ""
        return b"".join(map(self.label.__getitem__, ids.split(","))).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with its token ids as an array, for every whole text.

    A null text counts as empty and has no ids.  A column that is named like the
    new one is replaced; all others, and repeated rows, are kept as they are.
    """
    def run(s: pd.Series) -> pd.Series:
        codec = Codec.of(path)
        return pd.Series([np.array(t.split(",") if t else [], dtype=np.int32) for t in map(codec.encode, s)], dtype=object)

    of = F.pandas_udf(run, "array<int>")
    return docs.withColumn(ids, of(F.coalesce(F.col(text), F.lit(""))))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Text of an array of token ids; null ids decode to the empty text."""
    def run(s: pd.Series) -> pd.Series:
        codec = Codec.of(path)
        return pd.Series([b"".join(map(codec.label_of.__getitem__, x.tolist())).decode("utf-8", "replace") for x in s], dtype=object)

    of = F.pandas_udf(run, "string")
    return df.withColumn(text, of(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


DIGEST_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): token count, digest of the ids and of the text decoded from them.

    A null text counts as empty: no tokens, digests of the empty string.  A null
    doc_id is kept.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for cols in rows_of(batches):
            out = {"doc_id": cols["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in cols["text"]:
                ids = codec.encode(text)
                out["n_tokens"].append(ids.count(",") + 1 if ids else 0)
                out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_pydict(out, schema=DIGEST_ARROW)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, DIGEST)
