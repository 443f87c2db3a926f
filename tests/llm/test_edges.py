"""Repeated, missing and very long rows; clashing columns; SQL; the parts of operators against brute force."""

import itertools
import random
import resource
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesift.llm import langid, mixing, neardup, pieces, pii, queries, repeats, search

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    duck = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = duck.execute(queries.ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    rows = sorted(map(str, duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()))
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns and sorted(str(tuple(r)) for r in got.select(*columns).collect()) == rows


# searches


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=20)]) for i in range(260)]
    rows += [(300 + i, [float(x) for x in rng.normal(size=7)]) for i in range(12)]  # another dimension, fewer than k
    rows += [(400, [1.0, 2.0]), (500 + 20, [3.0])]  # alone in their dimensions
    rows += [rows[0], rows[0], rows[3]]  # repeated rows
    rows += [(5, [9.0] * 20), (7, [-9.0] * 20)]  # a second vector of an id
    rows += [(1000 + i, rows[1][1]) for i in range(60)]  # many equal vectors
    return rows + [(None, [1.0] * 20), (2000, None), (2020, [0.0] * 20), (2040, [float("nan")] * 20), (2060, [None] * 20), (2080, [])]


def brute(vectors, every, k, key):
    """key(query, rows): the smaller the nearer."""
    known = {}
    for i, v in vectors:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            known[i] = min(known.get(i, v), v)
    out = {}
    for q, v in known.items():
        if q % every == 0:
            rest = sorted((key(np.array(v), np.array(w)), i) for i, w in known.items() if i != q and len(w) == len(v))
            out[q] = [(i, s) for s, i in rest[:k]]
    return {q: x for q, x in out.items() if x}


def listed(rows, name):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r[name]))
    return out


@pytest.mark.parametrize("width", [4, 16])
def test_exact_search_on_odd_rows(spark, vectors, width):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("distance", F.lit(1)).withColumn("dim", F.lit("x"))
    got = search.exact_top_k(df, every=20, k=10, width=width).collect()
    assert listed(got, "distance") == brute(vectors, 20, 10, lambda a, b: int(((a > 0) != (b > 0)).sum()))


def test_approximate_search_on_odd_rows(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("r", F.lit("x"))
    got = listed(search.approximate_top_k(df, every=20, k=20).collect(), "score")
    want = brute(vectors, 20, 20, lambda a, b: -float((a * b).sum()))
    assert {q: len(x) for q, x in got.items()} == {q: len(x) for q, x in want.items()}
    hits = sum(len({i for i, _ in x} & {i for i, _ in got[q]}) for q, x in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and len({i for i, _ in found}) == len(found)


def test_empty_search(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert search.exact_top_k(none).count() == search.approximate_top_k(none).count() == 0


def test_probes_read_a_part_of_the_codes(spark, capsys):
    """Recall at the share of codes that probing retrieves and of vectors that are reranked."""
    x = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").collect()], float)
    model = search.Codes(x[:5000], 20, 0.92)
    codes = search.segments(model.bits(x), 16)
    index, asked = search.Index(codes, 16), np.arange(0, len(x), 40)
    who, found, far = index.within(codes[asked], model.radius)
    probed = reranked = hits = 0
    long = model.long(x)
    for k, i in enumerate(asked.tolist()):
        own = found[who == k]
        assert len(np.unique(own)) == len(own)
        near = own[far[who == k] <= model.radius]
        every = np.bitwise_count(codes ^ codes[i]).sum(1) <= model.radius
        assert every.sum() == len(near)  # the pigeonhole principle: probing loses no code within the radius
        near = near[np.bitwise_count(long[near] ^ long[i]).sum(1) <= model.reach]
        top = np.argsort(-(x @ x[i]), kind="stable")[1:21]
        probed, reranked, hits = probed + len(own), reranked + len(near), hits + len({*top} & {*near})
    n = len(asked) * len(x)
    with capsys.disabled():
        print(
            f"\n  radius {model.radius} of 64: recall {hits / len(asked) / 20:.3f}, codes probed {probed / n:.2f}, vectors reranked "
            f"{reranked / n:.2f}"
        )
    assert hits >= 0.9 * len(asked) * 20 and probed < 0.85 * n and reranked < 0.15 * n


def test_probing_by_address_beats_the_scan_of_its_block(capsys):
    """Exact nearest codes of 100 queries in a block of the size used, against a scan with a partial sort of all distances."""
    import time

    rng = np.random.default_rng(5)
    codes = np.unique(rng.integers(0, 1 << 16, (search.CODES, 4), dtype=np.uint16), axis=0)
    ids, one, wanted = np.arange(len(codes)), np.ones(len(codes), np.int64), codes[rng.choice(len(codes), 100, replace=False)]
    index = search.Index(codes, 16)
    index.nearest(wanted[:5], 11, ids, ids, one)
    began = time.perf_counter()
    who, far, best = index.nearest(wanted, 11, ids, ids, one)
    probing, began, scanned = time.perf_counter() - began, time.perf_counter(), []
    whole = np.ascontiguousarray(codes).view(np.uint64)[:, 0]
    for q in np.ascontiguousarray(wanted).view(np.uint64)[:, 0]:
        d = np.bitwise_count(whole ^ q).astype(np.int64) * len(codes) + ids
        scanned.append(np.sort(np.partition(d, 10)[:11]))
    scan = time.perf_counter() - began
    assert [*(far * len(codes) + best).reshape(100, 11).ravel()] == [*np.concatenate(scanned)]
    with capsys.disabled():
        print(f"\n  100 exact searches in a block of {len(codes)} codes: probing {probing:.2f} s, scan {scan:.2f} s")
    assert probing < scan


def test_many_spans_take_time_in_proportion():
    import time

    model = pii.SemiMarkov()
    text = "".join(f"user{k}@mail{k % 90}.example " for k in range(16_000))
    began = time.perf_counter()
    base = pii.base_spans(text)
    alone = time.perf_counter() - began
    model.decode = lambda shapes: [(0, 0, pii.length(shapes))]  # a span over each island
    began = time.perf_counter()
    assert pii.all_spans(text, model)[0] == base and len(base) == 16_000
    islands = sum(1 for _ in pii.islands(text))
    assert islands and time.perf_counter() - began < 2 + 3 * alone


def test_model_spans_keep_off_base_spans():
    rng = random.Random(8)

    class Fixed(pii.SemiMarkov):
        def decode(self, shapes):
            n, r = pii.length(shapes), random.Random(str(shapes))
            cuts = sorted(r.sample(range(n + 1), min(n + 1, 4)))
            return [(a, 3, b) for a, b in zip(cuts[::2], cuts[1::2], strict=False)]

    for _ in range(60):
        text = " ".join(rng.choice(["a@b.de", "10.1.2.3", "4111 1111 1111 1111", "+49 (30) 1234567", "word", "12-3", "x@", "+1"]) for _ in range(30))
        base, every = pii.all_spans(text, Fixed())
        wanted = list(base)
        for starts, shapes in pii.islands(text):
            for i, kind, j in Fixed().decode(shapes):
                s, e = starts[i], starts[j]
                if not any(s < b and a < e for a, _, b in base):
                    wanted.append((s, kind, e))
        assert every == sorted(wanted)


# pieces


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattice(pieces.load(queries.vocabulary("piece_bpe_32k.model")), 3)


def test_long_word_in_linear_memory(lattice):
    draw = random.Random(1)
    word = "".join(draw.choice("abcdefghijklmnop") for _ in range(200_000))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    (raw, scores, same), = lattice.encode([word])
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / (1 << 10 if sys.platform != "darwin" else 1 << 20)
    assert same and scores == sorted(scores, reverse=True) and len(scores) == 3 and grown < 400
    assert lattice.decode(np.frombuffer(raw, "<i4").tolist()) == word


def test_arrays_and_queue_agree(lattice):
    draw = random.Random(2)
    words = ["".join(draw.choice("thenaio") for _ in range(9)) for _ in range(200)]
    ids, scores, losses = lattice._many([pieces.SPACE + w for w in words], 10)
    for word, raw, score, loss in zip(words, ids, scores, losses, strict=True):
        first, second, *_ = lattice.search(pieces.SPACE + word)
        assert np.isclose(first[0], score) and np.isclose(second[0] - first[0], loss) and first[1].tobytes() == raw


def test_decode_odd_rows(spark):
    path = queries.vocabulary("piece_bpe_32k.model")
    rows = spark.createDataFrame(
        [(1, "a  b\n\n▁c", "x"), (2, None, "y"), (None, "", "z"), (3, "\u0000 é ☃", "w")], "doc_id long, text string, ids string"
    )
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(rows, path), path).collect()}
    assert back == {1: "a  b\n\n▁c", 2: "", None: "", 3: "\u0000 é ☃"}
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), path).first().text == ""


# languages


def test_long_words_are_summed_whole():
    vocab = ["a", "b", "ab", "ba", "▁a", "▁", "aab"]
    probs = np.random.default_rng(1).random((8, 3))
    model = langid.Unigrams(vocab, probs)
    draw = random.Random(4)
    for size in (5, 70, 200):
        word = "▁" + "".join(draw.choice("abc") for _ in range(size))
        np.testing.assert_allclose(model.long(word), model.forward([word], len(word))[2][0])
    stretch, counts = langid.STRETCH, np.array([3.0, 0.0, 1.0])
    try:
        for langid.STRETCH in (1, 17, stretch):
            np.testing.assert_allclose(model.long(word), model.forward([word], len(word))[2][0])
            np.testing.assert_allclose(model.expected_long(word, counts), model.expected([word], len(word), counts[None]))
    finally:
        langid.STRETCH = stretch


def test_long_words_are_learned_whole(spark):
    """A word of many letters teaches the pieces across its 64th letter as those before it; nothing is cut."""
    rows = [(i, ("ab" * 200 if i % 2 else "ba" * 200)[: 399 - i], "x" if i % 2 else "y") for i in range(40)]
    langs, _, probs = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ["a", "ab", "b", "ba", "▁", "▁a", "▁b"])
    assert langs == ["x", "y"]
    assert probs[5, 0] > probs[6, 0] and probs[6, 1] > probs[5, 1]  # one start a word, so no part began with another letter
    assert probs[6, 0] < 1e-3 > probs[5, 1]


# substring dedup


@pytest.mark.parametrize("first", [2, 3, 5, 9])
def test_levels(spark, first):
    """However short the first windows are, the same words go."""
    draw = random.Random(5)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for k in range(30):
        words = [draw.choice("abcdefgh") for _ in range(60)]
        if k % 3 == 0:
            at = draw.randrange(20)
            words[10:10] = passage[at : at + 20]
        texts.append(" ".join(words))
    rows = spark.createDataFrame([*enumerate(texts), (None, texts[1]), (30, None)], "doc_id long, text string")
    keyed = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert keyed(repeats.repeated_out(rows, 12, first=first)) == keyed(repeats.repeated_out(rows, 12))
    assert repeats.repeated_out(rows, 12, first=first).where("n_removed > 0").count() > 5


def test_no_window_survives(spark):
    rows = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(50))) for i in range(5)], "doc_id long, text string")
    assert repeats.repeated_out(rows, 12, first=3).agg(F.sum("n_removed")).first()[0] == 0


# mixing


def test_order_of_the_mix(spark):
    """What is taken is the start of the order by key, whatever the weights; each row's copies come with all its columns."""
    draw = random.Random(6)
    rows = [(i, "w " * draw.randrange(0, 30), draw.choice("ab") if i % 7 else None, draw.choice([0.001, 1.0, 1000.0]), "kept", 7) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double, key string, size int")
    got = mixing.mix(docs).collect()
    for _, group in itertools.groupby(sorted(got, key=lambda r: (str(r.source), r.key)), key=lambda r: str(r.source)):
        group = list(group)
        budget, before = group[0].target - group[0].epochs * group[0].source_size, 0
        for r in group:
            more = r.epochs < 3 and before + r["size"] / 2 <= budget
            assert r.taken == (r.epochs + more) * r["size"], (r, before, budget)
            before += r["size"]
    copies = mixing.mixed_copies(docs)
    assert copies.columns == ["doc_id", "text", "source", "key", "size"]
    assert {(r.key, r["size"]) for r in copies.collect()} == {("kept", 7)}
    want = {r.doc_id: r.taken // r["size"] if r["size"] else 1 for r in got}
    assert {r.doc_id: r["count"] for r in copies.groupBy("doc_id").count().collect()} == {i: n for i, n in want.items() if n}


def test_heavier_documents_come_first(spark):
    rows = [(i, "one two", "s", 10.0 if i % 2 else 1.0) for i in range(2000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, weight double")).toPandas().sort_values("key")
    assert 0.85 < (got.doc_id[:500] % 2).mean() < 0.95  # of the first quarter about ten of eleven at its start


# personal data


def test_decoding_is_the_best_of_all_segmentations():
    rng = np.random.default_rng(2)
    model = pii.SemiMarkov(rng.normal(size=(len(pii.KINDS), pii.FEATURES)))
    for text in ("call +44 20 79 now", "a@b.cd 12", "(555) 12-34"):
        _, shapes = next(pii.islands(text))
        spans, rows = pii.segments(shapes)
        scores = {(i, k, j): s for (i, j), all_ in zip(spans.tolist(), rows @ model.weights.T, strict=True) for k, s in enumerate(all_)}
        best = 0.0
        for n in range(1, 4):
            for chosen in itertools.combinations(sorted(scores), n):
                if all(a[2] <= b[0] for a, b in itertools.pairwise(chosen)):
                    best = max(best, sum(scores[c] for c in chosen))
        assert np.isclose(sum(scores[c] for c in model.decode(shapes)), best)


def test_model_adds_what_the_base_patterns_miss(spark):
    """Phones without the sign and with spaced digits are found; dates, prices and plain numbers are left alone."""
    model = pii.SemiMarkov(pii.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")))
    found = {
        "call 44 20 7946 0018 now": "phone:5:20",
        "call (555) 248-5123 today": "phone:5:19",
        "phone 020 7946 0018.": "phone:6:19",
        "tel: 0049 30 901820": "phone:5:19",
        "on 2024-05-04 at 12:30": "",
        "room 12 of 300": "",
        "price 1,234.50": "",
        "id 12345678901": "",
        "mail bob@corp now": "",
    }
    for text, want in found.items():
        base, every = pii.all_spans(text, model)
        assert not base and pii.named(every) == want


# near duplicates and the pipeline


def test_near_duplicates_by_brute_force(spark):
    """All pairs, edited in many degrees: links of 0.8 or more are in one class, and classes hold by such links alone."""
    draw, texts = random.Random(8), []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(90)]
        for k in range(6):
            words = list(base)
            for at in draw.sample(range(90), k):
                words[at] = f"e{g}x{k}x{at}"
            texts.append(" ".join(words))
    texts += ["", None, "two words", "two words", "Two words"]
    bags = [neardup.shingles([t or ""])[0] for t in texts]
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(np.intersect1d(bags[i], bags[j]))
        if both and both >= 0.8 * (len(bags[i]) + len(bags[j]) - both):
            old, new = sorted((label[i], label[j]))
            label = [old if x == new else x for x in label]
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").withColumn("t", F.lit(1)).withColumn("bands", F.lit("x"))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(rows).collect()}
    assert got == dict(enumerate(label))


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_odd_rows(spark, tmp_path, empty):
    import corpus_pipeline

    texts = [None, "", " ", "x " * 5000, "y" * 9000, "same text here", "same text here", "mail a@b.cd or +44 20 7946 0018"]
    docs = spark.createDataFrame(
        [] if empty else [(None if i == 5 else i, t, None, None if i % 2 else "s", 0, "extra", 1.0, 2) for i, t in enumerate(texts)],
        "doc_id long, text string, lang string, source string, n_chars long, t string, weight double, key int"
    )
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.round_trip for r in got) and (not got if empty else len(got) >= 3)


@pytest.mark.parametrize("parts", [1, 40])
def test_frequent_shingles_are_counted_exactly(spark, parts):
    """However the rows are dealt, just the shingles in over a twentieth of them are named, with their exact counts."""
    draw = random.Random(9)
    lines = [f"common line {k} of five words" for k in range(12)]
    texts = [" ".join(draw.sample(lines, draw.randrange(4))) + f" own{i} text{i} of{i} this{i} row{i}" for i in range(300)] + [None, ""]
    rows = spark.createDataFrame([(t or "",) for t in texts], "text string").repartition(parts)
    n, keys, counts = neardup.frequent(rows, neardup.Shelf(spark))
    every, want = np.unique(np.concatenate([neardup.shingles([t or ""])[0] for t in texts]), return_counts=True)
    often = want * 20 > len(texts)
    assert n == len(texts) and often.sum() > 12
    np.testing.assert_array_equal(keys, every[often])
    np.testing.assert_array_equal(counts, want[often])
