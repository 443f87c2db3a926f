"""Token counts by rank-synchronous merging of ragged numpy arrays, for a word-level BPE vocabulary file (.json).

Pre-tokens that are new to a worker are laid out one after another in one symbol array. In each round every sequence
finds its pair of lowest rank and merges all places of it at once, left to right; sequences without a pair leave.
The symbols that survive are the tokens. Counts are kept per white-space word in a bounded cache of the worker.

Null and empty texts have no tokens; repeated rows and ties need no rule; only doc_id and text are read.
"""

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import text_chunks

#: Words held by a worker's cache at most, and their letters; beyond, it starts anew.
CACHE, LETTERS = 400_000, 1 << 25
_WORDS = re.compile(r"[^ \t\n\r\x0b\x0c]+")


def byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: printable ones stand for themselves, others follow from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def load(path: str) -> dict:
    """From a vocabulary file: the pre-tokenizer's pattern, special strings, first symbols of bytes, and the merge table."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    end = spec["model"].get("end_of_word_suffix") or ""
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
    keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
    order = np.argsort(keys)
    return {
        "pattern": spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"],
        "special": [t["content"] for t in spec["added_tokens"]],
        "inner": np.array([vocab[c] for c in byte_letters()], np.int64),
        "last": np.array([vocab[c + end] for c in byte_letters()], np.int64),
        "keys": keys[order],
        "ranks": order.astype(np.int64),
        "made": np.array([vocab[a + b] for a, b in pairs], np.int64)[order],
    }


def merged_counts(tokens: list[bytes], model: dict) -> np.ndarray:
    """How many symbols survive of each non-empty pre-token."""
    lens = np.array([len(t) for t in tokens], np.int64)
    out = np.zeros(len(tokens), np.int64)
    if not len(tokens):
        return out
    data = np.frombuffer(b"".join(tokens), np.uint8)
    symbols = model["inner"][data]
    ends = np.cumsum(lens)
    symbols[ends - 1] = model["last"][data[ends - 1]]
    owner = np.repeat(np.arange(len(tokens)), lens)
    keys, never = model["keys"], np.int64(1 << 60)
    rank, made = np.full(len(symbols), never), np.zeros(len(symbols), np.int64)

    def look_up(places):
        """Ranks and merged symbols of the pairs that begin at these places."""
        places = places[(places >= 0) & (places < len(symbols) - 1)]
        rank[places] = never
        places = places[owner[places] == owner[places + 1]]
        pair = symbols[places] << 32 | symbols[places + 1]
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        ok = keys[at] == pair
        rank[places[ok]], made[places[ok]] = model["ranks"][at[ok]], model["made"][at[ok]]

    look_up(np.arange(len(symbols)))
    while len(symbols):
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        least = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.append(starts, len(owner)))
        done = least == never
        out[owner[starts[done]]] = sizes[done]
        hit = np.flatnonzero((rank == np.repeat(least, sizes)) & (rank != never))
        # of overlapping places of a pair of equal symbols every second one merges
        run = np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) != 1, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
        symbols[hit] = made[hit]
        keep = np.repeat(~done, sizes)
        keep[hit + 1] = False
        hit = np.cumsum(keep)[hit] - 1
        symbols, owner, rank, made = symbols[keep], owner[keep], rank[keep], made[keep]
        rank[-1:] = never
        look_up(hit)
        look_up(hit - 1)
    return out


class Counter:
    """Token counts of words, remembered. A word is a run without ASCII white space, in which no token can cross an end."""

    def __init__(self, model: dict):
        self.model, self.seen, self.held = model, {}, 0
        self.pattern = regex.compile(model["pattern"])
        self.special = re.compile("(" + "|".join(map(re.escape, model["special"])) + ")") if model["special"] else None

    def _learn(self, words: list[str]) -> None:
        tokens, of, plain = [], [], np.zeros(len(words), np.int64)
        for i, word in enumerate(words):
            parts = self.special.split(word) if self.special else [word]
            plain[i] = len(parts) // 2
            for part in parts[::2]:
                part = part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")
                for t in self.pattern.findall(part.lower()):
                    tokens.append(t.encode())
                    of.append(i)
        np.add.at(plain, np.array(of, np.int64), merged_counts(tokens, self.model))
        self.seen.update(zip(words, plain.tolist(), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        words = [_WORDS.findall(t) for t in texts]
        if len(self.seen) > CACHE or self.held > LETTERS:
            self.seen, self.held = {}, 0
        new = set().union(*words).difference(self.seen)
        self.held += sum(map(len, new))
        self._learn(list(new))
        get = self.seen.__getitem__
        return [sum(map(get, w)) for w in words]


_counters: dict = {}


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of docs(doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        counter = _counters.setdefault(path, None) or _counters.__setitem__(path, Counter(model.value)) or _counters[path]
        for batch, texts in text_chunks(batches):
            n = counter.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()),
                    pa.array([x > limit for x in n])
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
