"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary (letter pieces only; characters outside
it have a small fixed probability). A word's probability is the sum over all its segmentations into pieces, by a
forward recursion; a text's is the product over its words. Piece probabilities are learned by expectation-maximisation
on a bounded sample of texts whose language is known: about `sample` documents of each language. Learning and scoring
sum over all segmentations of words of any length; long words pass in stretches, in bounded memory.

Null texts and texts without letters give `und` with score 0; ties go to the language that sorts first; repeated rows
are scored alike. Only doc_id, text and lang are read, lang for learning alone.
"""

import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import text_chunks
from pagesift.llm.lattice import PieceTable

#: Words held by a worker's cache at most, and their letters; beyond, it starts anew.
CACHE, LETTERS = 400_000, 1 << 25
#: Words over LONG characters are scored one by one, in stretches.
LONG, STRETCH = 64, 4096
_FLOOR = 1e-9
_LETTERS = re.compile(r"[^\W\d_]+")
_WORD_END = "▁"


def letter_pieces(path: str) -> list[str]:
    """The vocabulary: pieces of a SentencePiece model that are letters (a leading mark of a word's start stays), in lower case."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if _LETTERS.fullmatch(p.lstrip(_WORD_END)) and p.count(_WORD_END) <= 1})


class Unigrams:
    """probs: (pieces + 1, languages); the last row is for a single character that is no piece."""

    def __init__(self, pieces: list[str], probs: np.ndarray):
        self.table, self.probs = PieceTable(pieces), probs
        self.seen, self.scores, self.held = {}, np.zeros((0, probs.shape[1])), 0

    def _weights(self, words: list[str], size: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each piece length: its index at each start (-1: none; the last row of probs for single characters), and its probabilities."""
        out = []
        for n, e in self.table.edges(words, size):
            if n == 1:
                e = np.where(e < 0, len(self.probs) - 1, e)
            p = self.probs[e]
            if n > 1:
                p[e < 0] = 0
            out.append((n, e, p))
        return out

    def forward(self, words: list[str], size: int) -> tuple[list, np.ndarray, np.ndarray]:
        """Log probabilities (words, languages) of words of one length; alpha is kept scaled, a scale for each position."""
        weights = self._weights(words, size)
        alpha = np.zeros((size + 1, len(words), self.probs.shape[1]))
        alpha[0], log = 1, np.zeros((size + 1, len(words), self.probs.shape[1]))
        for end in range(1, size + 1):
            for n, _, p in weights:
                if n <= end:  # alpha before end - n has been scaled down by exp(log)
                    alpha[end] += alpha[end - n] * p[end - n] * np.exp(log[end - n] - log[end - 1])
            log[end] = log[end - 1] + np.log(alpha[end])
            alpha[end] = 1
        return weights, log, log[size]

    def expected(self, words: list[str], size: int, counts: np.ndarray) -> np.ndarray:
        """Expected piece counts (as probs) of words that occur counts (words, languages) times."""
        weights, log, total = self.forward(words, size)
        back = np.full_like(log, 0.0)
        for start in range(size - 1, -1, -1):
            terms = [
                np.where(p[start] > 0, np.log(np.maximum(p[start], 1e-300)) + back[start + n], -np.inf) for n, _, p in weights if n <= size - start
            ]
            back[start] = np.logaddexp.reduce(terms, axis=0)
        out = np.zeros_like(self.probs)
        for n, e, p in weights:
            post = np.exp(log[: size - n + 1] + np.log(np.maximum(p, 1e-300)) + back[n:] - total) * (p > 0) * counts
            np.add.at(out, e[e >= 0], post[e >= 0])
        return out

    def _steps(self, word: str, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Of a stretch of a long word: the piece of each length (axis 1) from each start on, and its log probabilities (-inf: none)."""
        far, m = self.table.longest, min(STRETCH, len(word) - first)
        part = word[first : first + STRETCH + far - 1]
        index, steps = np.full((m, far), -1), np.full((m, far, self.probs.shape[1]), -np.inf)
        for n, e, p in self._weights([part], len(part)):
            index[: len(e), n - 1] = e[:m, 0]
            with np.errstate(divide="ignore"):
                steps[: len(p), n - 1] = np.log(p[:m, 0])
        return index, steps

    @staticmethod
    def _onward(edge: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """Forward log probabilities of a stretch's places and as many beyond as edge has, which are those known at its start."""
        far = len(edge)
        log = np.concatenate([edge, np.full((len(steps), edge.shape[1]), -np.inf)])
        for k in range(len(steps)):
            ends = log[k + 1 : k + 1 + far]
            np.logaddexp(ends, log[k] + steps[k], out=ends)
        return log

    def _edges(self, word: str):
        """Forward log probabilities of the places from each stretch's start on, as far as a piece reaches, and those behind the word."""
        edge = np.full((self.table.longest, self.probs.shape[1]), -np.inf)
        edge[0] = 0
        for first in range(0, len(word), STRETCH):
            yield edge
            steps = self._steps(word, first)[1]
            edge = self._onward(edge, steps)[len(steps) :]
        yield edge

    def long(self, word: str) -> np.ndarray:
        """Log probabilities (languages) of one word, by the same recursion from each start on."""
        for edge in self._edges(word):
            pass
        return edge[0]

    def expected_long(self, word: str, counts: np.ndarray) -> np.ndarray:
        """Expected piece counts (as probs) of a long word that occurs counts (languages) times; only the stretches' edges are held."""
        *edges, end = self._edges(word)
        out = np.zeros_like(self.probs)
        ahead = np.full_like(end, -np.inf)
        ahead[0] = 0
        for first in reversed(range(0, len(word), STRETCH)):
            index, steps = self._steps(word, first)
            m, far = index.shape
            log = self._onward(edges.pop(), steps)
            back = np.concatenate([np.full((m, steps.shape[2]), -np.inf), ahead])
            for k in reversed(range(m)):
                steps[k] += back[k + 1 : k + 1 + far]
                back[k] = np.logaddexp.reduce(steps[k], axis=0)
            some = index >= 0
            post = np.exp(log[:m, None] + steps - end[0]) * counts
            np.add.at(out, index[some], post[some])
            ahead = back[:far]
        return out

    def words(self, words: list[str]) -> None:
        """Learn the scores of new words."""
        by_size = defaultdict(list)
        for i, w in enumerate(words):
            by_size[min(len(w) + 1, LONG + 1)].append(i)
        scores = np.zeros((len(words), self.probs.shape[1]))
        for i in by_size.pop(LONG + 1, []):
            scores[i] = self.long(_WORD_END + words[i])
        for size, group in by_size.items():
            step = max(1, 400_000 // (size * self.probs.shape[1]))
            for k in range(0, len(group), step):
                at = group[k : k + step]
                scores[at] = self.forward([_WORD_END + words[i] for i in at], size)[2]
        self.seen.update(zip(words, range(len(self.scores), len(self.scores) + len(words)), strict=True))
        self.scores = np.concatenate([self.scores, scores])
        self.held += sum(map(len, words))

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods (texts, languages), and which texts have letters."""
        split = [_LETTERS.findall(t.lower()) for t in texts]
        if len(self.seen) > CACHE or self.held > LETTERS:
            self.seen, self.scores, self.held = {}, np.zeros((0, self.probs.shape[1])), 0
        self.words(list(set().union(*split).difference(self.seen)))
        out, some = np.zeros((len(texts), self.probs.shape[1])), np.zeros(len(texts), bool)
        for i, w in enumerate(split):
            if w:
                out[i] = self.scores.take(np.fromiter(map(self.seen.__getitem__, w), np.int64, len(w)), 0).sum(0)
                some[i] = any(c.isalpha() for x in w for c in x)
        return out, some


def learn(docs: DataFrame, pieces: list[str], sample: int = 300, rounds: int = 3) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors and piece probabilities from docs(doc_id, text, lang): about `sample` documents of each language."""
    docs = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros(0), np.zeros((len(pieces) + 1, 0))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample / sizes[k]))])
    chance = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) / float(1 << 20)
    words = docs.where(chance < share[F.col("lang")]).select(
        "lang", F.explode(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)")).alias("word")
    )
    rows = words.groupBy("lang", "word").agg(F.count("*").alias("n")).toPandas()
    table = rows.pivot_table(
        index="word", columns="lang", values="n", fill_value=0
    ).reindex(columns=langs, fill_value=0).sort_index() if len(rows) else pd.DataFrame(columns=langs)
    by_size = defaultdict(list)
    for i, w in enumerate(table.index):
        by_size[min(len(w) + 1, LONG + 1)].append((_WORD_END + w, i))
    long = by_size.pop(LONG + 1, [])
    model = Unigrams(pieces, np.full((len(pieces) + 1, len(langs)), 1.0 / (len(pieces) + 1)))
    counts = table.to_numpy(float)
    for _ in range(rounds):
        got = np.zeros_like(model.probs)
        for size, which in by_size.items():
            for k in range(0, len(which), 4000):
                words, at = zip(*which[k : k + 4000], strict=True)
                got += model.expected(list(words), size, counts[list(at)])
        for word, i in long:
            got += model.expected_long(word, counts[i])
        got += 1e-3
        model.probs = got / got.sum(0)
        model.probs[-1] = _FLOOR
    prior = np.array([sizes[k] for k in langs], float)
    return langs, np.log(prior / prior.sum()), model.probs


_models: dict = {}


def identify(docs: DataFrame, train: DataFrame, path: str, sample: int = 300) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs(doc_id, text), by a model learned from train(doc_id, text, lang).

    score is the posterior of the language, with log likelihoods tempered to a mean over the root of the text's length.
    """
    import uuid

    pieces = letter_pieces(path)
    langs, prior, probs = learn(train, pieces, sample)
    shared, key = docs.sparkSession.sparkContext.broadcast((pieces, probs)), uuid.uuid4().hex

    def run(batches):
        if key not in _models:
            _models.clear()
            _models[key] = Unigrams(*shared.value)
        for batch, texts in text_chunks(batches):
            if langs:
                likely, some = _models[key].texts(texts)
                z = likely / np.sqrt(np.maximum(1, [len(t) for t in texts]))[:, None] + prior
                z = np.exp(z - z.max(1, keepdims=True))
                top = z.argmax(1)
                score = np.where(some, z.max(1) / z.sum(1), 0.0)
                pred = [langs[k] if ok else "und" for k, ok in zip(top, some, strict=True)]
            else:
                pred, score = ["und"] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "held_out")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
