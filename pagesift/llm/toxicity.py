"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found in block-max inverted indexes.

A bounded sample of labelled documents (about `per_class` of each class) is the index. Its terms are lower-case words
and their first 4 to 8 letters where more follow (words of one stem) that tell the classes apart in the sample: by
chi-square (25 or more), by their rates (three times apart) and by their documents (eight and a hundredth of a class);
all such terms are taken, and copies count once, for the least doc_id. The cosine is over these terms. Each term's
postings are cut into blocks of 64 examples with the largest weight of each; the sum of a query's block maxima bounds
every example in a block, so blocks are read from the highest bound down until none can beat the k-th best: the k
nearest are exact. Their votes, weighted by cosine, are turned into a score by a logistic curve that is fitted to
left-one-out votes of the examples, weighted to the true shares of the classes. Documents that meet no example get the
smoothed share of toxic ones among the examples that meet none.

Null and empty texts meet no example; ties of cosine go to the smaller example id; labels that are null are left out,
of several labels of a document the largest holds. Only doc_id and text (and doc_id, toxic of labels) are read.
"""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import text_chunks

BLOCK = 64
#: Words held by a model's cache in a worker at most (beyond, it starts anew), and their letters; longer ones are not held.
CACHE, LONGEST = 200_000, 64
#: Lengths of the word starts that are terms too.
STEMS = (4, 5, 6, 7, 8)
_LETTERS = re.compile(r"[^\W\d_]+")


class BlockMax:
    """Unit vectors of examples over a vocabulary, by term and block."""

    def __init__(self, vectors: list[dict[int, float]], n_terms: int):
        self.size = len(vectors)
        self.blocks = -(-len(vectors) // BLOCK) or 1
        self.maxima = np.zeros((n_terms, self.blocks))
        lists: dict = {}
        for i, vector in enumerate(vectors):
            for t, w in vector.items():
                lists.setdefault((t, i // BLOCK), []).append((i % BLOCK, w))
                self.maxima[t, i // BLOCK] = max(self.maxima[t, i // BLOCK], w)
        self.lists = {k: (np.array([i for i, _ in v]), np.array([w for _, w in v])) for k, v in lists.items()}

    def nearest(self, query: dict[int, float], k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Indexes and cosines of the k nearest examples with a positive cosine; `without` is left out."""
        terms = list(query)
        bound = np.array([query[t] for t in terms]) @ self.maxima[terms] if terms else np.zeros(self.blocks)
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(ids) == k and bound[b] < scores[-1]:
                break
            sums = np.zeros(BLOCK)
            for t in terms:
                if (t, b) in self.lists:
                    at, w = self.lists[t, b]
                    sums[at] += query[t] * w
            if 0 <= without - b * BLOCK < BLOCK:
                sums[without - b * BLOCK] = 0
            hit = np.flatnonzero(sums > 0)
            ids, scores = np.append(ids, hit + b * BLOCK), np.append(scores, sums[hit])
            order = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[order], scores[order]
        return ids, scores


class Model:
    def __init__(self, terms: dict[str, int], idf: np.ndarray, examples: list[tuple[int, int, dict[int, int]]], shares: tuple[float, float], k: int):
        """examples: id, label and counts by term; shares: of labels 0 and 1 among all labelled documents."""
        self.terms, self.idf, self.k, self.seen = terms, idf, k, {}
        self.ids = [e[0] for e in examples]
        self.labels = np.array([e[1] for e in examples], float)
        vectors = [self.unit(e[2]) for e in examples]
        self.index = BlockMax(vectors, len(terms))
        weight = np.array([shares[int(y)] for y in self.labels]) / np.maximum(
            1, np.bincount(self.labels.astype(int), minlength=2)[self.labels.astype(int)]
        )
        votes = np.array([self.vote(v, i)[0] for i, v in enumerate(vectors)])
        alone = np.isnan(votes)
        total = weight.sum() or 1.0
        self.none = float((weight[alone] @ self.labels[alone] / total + 1e-4) / (weight[alone].sum() / total + 1e-3))
        # two weak pseudo-examples keep the curve finite; Newton steps
        x = np.append(votes[~alone], [0.0, 1.0])
        y, w = np.append(self.labels[~alone], [0.0, 1.0]), np.append(weight[~alone] / total * len(examples), [1.0, 1.0])
        z = np.stack([x, np.ones_like(x)], 1)
        self.curve = np.zeros(2)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.curve, -30, 30)))
            grad = z.T @ (w * (y - p)) - 0.01 * self.curve
            self.curve = self.curve + np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) + 0.01 * np.eye(2), grad)

    def unit(self, counts: dict[int, int]) -> dict[int, float]:
        out = {t: (1 + np.log(n)) * self.idf[t] for t, n in counts.items()}
        norm = np.sqrt(sum(v * v for v in out.values()))
        return {t: v / norm for t, v in out.items()} if norm else {}

    def vote(self, vector: dict[int, float], without: int = -1) -> tuple[float, np.ndarray]:
        ids, cosines = self.index.nearest(vector, self.k, without)
        return (float(cosines @ self.labels[ids] / cosines.sum()) if len(ids) else np.nan), ids

    def score(self, text: str) -> tuple[float, list[int]]:
        words, counts = _LETTERS.findall(text.lower()), Counter()
        if len(self.seen) > CACHE:
            self.seen = {}
        for word in dict.fromkeys(words):  # in the text's order, so that sums are the same at each run
            if (found := self.seen.get(word)) is None:
                found = tuple(self.terms[t] for t in (word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)) if t in self.terms)
                if len(word) <= LONGEST:
                    self.seen[word] = found
            if found:
                times = words.count(word)
                for t in found:
                    counts[t] += times
        if not counts:
            return self.none, []
        vote, ids = self.vote(self.unit(counts))
        if not len(ids):
            return self.none, []
        return float(1 / (1 + np.exp(-np.clip(vote * self.curve[0] + self.curve[1], -30, 30)))), [self.ids[i] for i in ids]


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 2000, k: int = 7) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, toxic), whose rows are those to learn from."""
    labels = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    chance = F.pmod(F.xxhash64("doc_id", F.lit(53)), F.lit(1 << 20)) / float(1 << 20)
    picked = labels.where(chance < F.when(F.col("toxic") == 1, min(1.0, per_class / max(n1, 1))).otherwise(min(1.0, per_class / max(n0, 1))))
    words = F.explode(F.expr(r"regexp_extract_all(lower(text), '[\\p{L}]+', 0)"))
    starts = [F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in STEMS]
    some = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most about 2 per_class rows
    some = some.groupBy("text", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic", words.alias("word"))
    some = some.select("doc_id", "toxic", F.explode(F.array("word", *starts)).alias("term")).where("term is not null")
    counts = some.groupBy("doc_id", "toxic", "term").agg(F.count("*").alias("n")).cache()
    sizes = {r.toxic: r.n for r in counts.groupBy("toxic").agg(F.countDistinct("doc_id").alias("n")).collect()}
    a, b = max(sizes.get(1, 0), 1), max(sizes.get(0, 0), 1)
    rates = counts.groupBy("term").agg(F.sum(F.col("toxic").cast("long")).alias("p"), F.sum((1 - F.col("toxic")).cast("long")).alias("q"))
    rate1, rate0 = (F.col("p") + 0.5) / (a + 1.0), (F.col("q") + 0.5) / (b + 1.0)
    both = (F.col("p") + F.col("q")) / float(a + b)
    chi = ((rate1 - rate0) ** 2) / (both * (1 - both) + 1e-9) * (a * b / float(a + b))
    rates = rates.withColumn("chi", chi).where(
        (chi >= 25) & (F.greatest(F.col("p") / float(a), F.col("q") / float(b)) >= 0.01) & (F.greatest("p", "q") >= 8)
        & (F.abs(F.log(rate1 / rate0)) >= float(np.log(3.0)))
    )
    chosen = rates.orderBy(F.desc("chi"), "term").collect()  # terms of the examples alone
    at = {r.term: i for i, r in enumerate(chosen)}
    idf = np.array([np.log((1 + a + b) / (1 + r.p + r.q)) + 1 for r in chosen])
    examples: dict = {(r.doc_id, r.toxic): {} for r in counts.select("doc_id", "toxic").distinct().collect()}
    for r in counts.where(F.col("term").isin(list(at))).collect() if at else []:
        examples[r.doc_id, r.toxic][at[r.term]] = r.n
    counts.unpersist()
    return Model(at, idf, [(i, y, c) for (i, y), c in sorted(examples.items())], (n0 / max(n0 + n1, 1), n1 / max(n0 + n1, 1)), k)


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and evidence (ids of the examples that voted) of every row of docs(doc_id, text, held_out)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, texts in text_chunks(batches):
            scores, evidence = zip(*map(shared.value.score, texts), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.int64()))],
                names=["doc_id", "held_out", "score", "evidence"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "held_out")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, evidence array<long>")


def without_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below the limit."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, texts in text_chunks(batches):
            yield batch.filter(pa.array([shared.value.score(t)[0] < limit for t in texts]))

    return docs.mapInArrow(run, docs.schema)
