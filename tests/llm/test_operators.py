"""The training-data operators against brute force, public libraries and held-out labels, and on awkward rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagesift.llm import bpe, langid, mixing, neardup, pieces, pii, queries, repeats, search, toxicity

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string, size int, key string, t string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names clash with those the operators make."""
    ids = ids or range(len(texts))
    return spark.createDataFrame(
        [
            (i, t, None if i is None or i % 3 == 0 else "en", None if i is None or i % 2 else "s", 0, 0.0, "x", 1, "k", "t") for i,
            t in zip(ids, texts, strict=True)
        ],
        SCHEMA
    )


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


AWKWARD = [None, "", " \n\t", "one", "a b c d e f", "a b c d e f", "é" * 9000, "x " * 20_000, "<|endoftext|> ▁   ’s", "5" * 3000]


@pytest.fixture(scope="module", params=["awkward", "empty"])
def odd(spark, request):
    if request.param == "empty":
        return frame(spark, [])
    return frame(spark, AWKWARD + ["repeated row here"] * 2 + ["no id"], [*range(len(AWKWARD)), 50, 50, None])


def counted(got, odd):
    assert len(got) == odd.count()
    return {r.doc_id: r for r in got}


def test_awkward_rows(spark, odd):
    vocabulary = queries.vocabulary("piece_bpe_32k.model")
    r = counted(pii.find(odd).collect(), odd)
    assert not r or r[0].n_email == 0 and r[1].spans == ""
    held = odd.drop("held_out").withColumn("held_out", F.lit(False))
    r = counted(langid.identify(held, odd.drop("held_out"), vocabulary).collect(), odd)
    assert not r or r[0].lang_pred == r[2].lang_pred == "und"
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    counted(toxicity.with_scores(held, toxicity.learn(odd, labels)).collect(), odd)
    r = counted(repeats.repeated_out(odd).collect(), odd)
    assert not r or (r[0].n_words, r[7].n_words, r[7].n_removed) == (0, 20_000, 20_000)
    rows = counted(mixing.mix(odd.withColumn("weight", F.lit(None).cast("double"))).collect(), odd)
    assert not rows or sum(x.taken for x in rows.values()) > 0
    r = counted(pieces.encode(odd, vocabulary).collect(), odd)
    assert all(x.round_trip for x in r.values())
    r = counted(bpe.token_counts(odd, queries.vocabulary("word_bpe_49k.json")).collect(), odd)
    assert not r or r[1].n_tokens == 0
    r = counted(neardup.near_duplicates(odd).collect(), odd)
    assert not r or (r[5].class_id, r[50].class_size, r[1].class_id) == (4, 2, 1)
    assert neardup.one_of_each(odd).count() == (0 if not r else odd.count() - 2)


def test_base_spans(docs, texts):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    )
    extra = ["a@b@c.d_x@y.z", "1.2.3.4.5.6.7.8 256.1.1.1 ..1.2.3", "+1 (988) 555-2485+44 20 7946 0018", "4111 1111 1111 1111-2"]
    for text in [*texts.values(), *extra]:
        want = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0]))
        assert pii.base_spans(text) == want
    got = pii.find(docs).toPandas().set_index("doc_id")
    for i, text in texts.items():
        base = pii.named(pii.base_spans(text))
        assert got.base_sha256[i] == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) <= set(got.spans[i].split(","))


def test_redacted(docs):
    assert pii.find(pii.redact(docs)).agg(F.sum(F.expr("n_email + n_ip + n_phone"))).first()[0] == 0


def test_toxicity_held_out(spark):
    r = queries.op2_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((r.score >= 0.5) == (r.predicted == 1)).all() and (r.predicted == r.toxic).mean() > 0.9


def test_block_max_is_exact():
    rng = np.random.default_rng(1)
    vectors = [{int(t): float(w) for t, w in zip(rng.choice(30, 5, False), rng.random(5), strict=True)} for _ in range(500)]
    index = toxicity.BlockMax(vectors, 30)
    for q in vectors[:40]:
        scores = np.array([sum(q.get(t, 0) * w for t, w in v.items()) for v in vectors])
        ids, found = index.nearest(q, 7)
        np.testing.assert_allclose(found, np.sort(scores)[::-1][:7])


def test_language_held_out(spark, docs):
    r = queries.op3_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (r.lang_pred == r.lang).mean() > 0.95 and r.score.between(0, 1).all()


def test_forward_sums_all_segmentations():
    vocab = ["a", "b", "ab", "ba", "▁a", "▁"]
    probs = np.array([[0.2], [0.1], [0.3], [0.1], [0.2], [0.1], [1e-9]])
    p = dict(zip(vocab, probs[:, 0], strict=False))

    def total(w):
        return 1.0 if not w else sum(p.get(w[:n], 1e-9 if n == 1 else 0) * total(w[n:]) for n in (1, 2) if n <= len(w))

    model = langid.Unigrams(vocab, probs)
    for w in ("▁ab", "▁aba", "▁abc", "▁babab"):
        assert np.isclose(model.forward([w], len(w))[2][0, 0], np.log(total(w)))


def test_repeats(spark, docs, texts):
    extra = docs.select("doc_id", "text").unionByName(docs.where("doc_id < 5").select("doc_id", "text"))
    got = {r.doc_id: r for r in repeats.repeated_out(extra).collect()}
    words = [(i, WORDS.findall(t)) for i, t in texts.items()] + [(i, WORDS.findall(texts[i])) for i in range(5)]
    seen = Counter(tuple(w[k : k + 35]) for _, w in words for k in range(len(w) - 34))
    for i, w in words:
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), len(gone), kept)


def test_mix(docs, texts):
    rows = docs.select("doc_id", "text", "source", mixing.quality().alias("weight"))
    got, again = (mixing.mix(rows, steps=7).toPandas().sort_values("doc_id", ignore_index=True) for _ in range(2))
    pd.testing.assert_frame_equal(got, again)
    assert [*got["size"]] == [len(WORDS.findall(texts[i])) for i in got.doc_id]
    sizes = got.groupby("source")["size"].sum()
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes.index))}
    low, high = 0.0, float(sizes.sum())
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * n, mid * weight[s]) for s, n in sizes.items()) < sizes.sum() else (low, mid)
    for s, g in got.groupby("source"):
        assert np.isclose(g.target.iloc[0], min(3 * sizes[s], high * weight[s]))
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()
    assert (got.taken <= 3 * got["size"]).all()
    assert mixing.mixed_copies(rows).count() == (got.taken / got["size"].clip(lower=1)).sum() + (got["size"] == 0).sum()


def test_stopped_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1), (None, 30)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["c"] == 3 and got["a"] == 30 and got[None] == 90 and np.isclose(got["b"], 1041 - 123)


def test_n_best():
    model = pieces.load(queries.vocabulary("piece_bpe_32k.model"))
    lattice, known = pieces.Lattice(model, 4), model["pieces"]

    def every(w):
        return [(0.0, ())] if not w else [
            (known[w[:n]][1] + s, (known[w[:n]][0], *i)) for n in range(1, len(w) + 1) if w[:n] in known for s, i in every(w[n:])
        ]

    for word in ("▁hello", "▁thand", "▁world", "tion"):
        want = sorted((s for s, _ in every(word)), reverse=True)[:4]
        np.testing.assert_allclose([s for s, _ in lattice.search(word)], want)
    text = "hello tion\nx  world"
    (raw, scores, same), = lattice.encode([text])
    assert same and lattice.decode(np.frombuffer(raw, "<i4").tolist()) == text and scores == sorted(scores, reverse=True)


def test_decoded(spark, docs, texts):
    path = queries.vocabulary("piece_bpe_32k.model")
    got = pieces.decode(pieces.encode(docs, path), path).collect()
    assert all(r.text == texts[r.doc_id] for r in got)


def test_token_counts(docs, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    got = {r.doc_id: r.n_tokens for r in bpe.token_counts(docs, queries.vocabulary("word_bpe_49k.json")).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    odd = ["<|endoftext|>x<|ENDOFTEXT|>", "ΑΣ Σ İK½²٣_-", "aaaaaaaaaaaaa" * 9, "é\x1cb\x85c　d's"]
    assert bpe.Counter(
        bpe.load(queries.vocabulary("word_bpe_49k.json"))
    ).counts(odd) == [len(library.encode(t, add_special_tokens=False).ids) for t in odd]


def test_near_duplicates(docs, texts):
    got = neardup.near_duplicates(docs).toPandas().set_index("doc_id")
    bags = {
        i: Counter(zip(*(w[k:] for k in range(5)), strict=False))
        if len(w := WORDS.findall(t)) > 4 else Counter([tuple(w)]) if w else Counter() for i, t in texts.items()
    }
    where: dict = {}
    for i, b in bags.items():
        for s in b:
            where.setdefault(s, []).append(i)
    pairs = {(v[0], x) for v in where.values() if len(v) < 200 for x in v[1:]}
    near = [(a, b) for a, b in pairs if sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values())]
    assert len(near) > 20 and sum(got.class_id[a] != got.class_id[b] for a, b in near) <= 0.01 * len(near)
    linked = got[got.n_links > 0]
    for i in linked.index[:200]:
        assert any(
            sum((bags[i] & bags[j]).values()) >= 0.75 * sum((bags[i] | bags[j]).values())
            for j in linked.index[linked.class_id == linked.class_id[i]] if j != i
        )


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    bad = [(1000, None), (1020, [0.0] * 64), (1040, [float("nan")] * 64), (1060, [None] * 64), (1080, [])]
    return spark.createDataFrame(
        rows + [(2000 + i, rows[0][1]) for i in range(30)] + bad, "vec_id long, embedding array<double>"
    ), dict(rows + [(2000 + i, rows[0][1]) for i in range(30)])


def test_exact_search(vectors):
    df, known = vectors
    ids, x = np.array([*known]), np.array([*known.values()]) > 0
    got = search.exact_top_k(df).toPandas()
    assert set(got.query_id) == {i for i in known if i % 100 == 0}
    for q, g in got.groupby("query_id"):
        far = (x != x[ids == q]).sum(1)
        far[ids == q] = 999
        assert [*ids[np.lexsort((ids, far))[:10]]] == [*g.sort_values("rank").vec_id]


def test_nearest(vectors):
    df, known = vectors
    ids, x = np.array([*known]), np.array([*known.values()])
    got, hits, total = search.approximate_top_k(df).toPandas(), 0, 0
    for q, g in got.groupby("query_id"):
        near = (x * x[ids == q]).sum(1)
        near[ids == q] = -9
        top = np.lexsort((ids, -near))[:20]
        hits, total = hits + len({*ids[top]} & {*g.vec_id}), total + 20
        assert np.allclose(g.score, [near[ids == v][0] for v in g.vec_id])
    assert hits / total >= 0.9


def test_pipeline(spark, texts):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF)
    assert got.where("not round_trip").count() == 0 and got.select("doc_id").distinct().count() > 0.3 * len(texts)
