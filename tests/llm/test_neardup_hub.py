"""A base text and many independently edited copies are one class, though copies alone are below the bound."""

import random

import numpy as np

from pagesift.llm import neardup


def edited(words, n, salt):
    out = list(words)
    for k, at in enumerate(random.Random(salt).sample(range(5, len(words) - 5, 6), n)):
        out[at] = f"edit{salt}x{k}"
    return " ".join(out)


def test_hub_of_edited_copies(spark):
    base = [f"word{i}" for i in range(200)]
    texts = [" ".join(base)] + [edited(base, 3, i) for i in range(300)] + [
        f"apart {i} " + " ".join(f"w{i}x{k}" for k in range(30)) for i in range(50)
    ]
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert sum(got[i].class_id == 0 for i in range(301)) == 301 and got[0].class_size == 301
    assert all(got[i].class_size == 1 for i in range(301, 351))


def test_settled_without_a_centre(spark):
    """Pairs that no centre meets are judged in cells, over several blocks and levels."""
    texts = {}
    for g in range(40):
        words = [f"shared{i}" for i in range(60)] + [f"own{g}x{i}" for i in range(40)]
        texts |= {len(texts): " ".join(words), len(texts) + 1: edited(words, 1, g)}
    block, neardup.BLOCK = neardup.BLOCK, 16
    try:
        got = {
            r.doc_id: r.class_id
            for r in neardup.near_duplicates(spark.createDataFrame([*texts.items()], "doc_id long, text string"), bands=48, width=1).collect()
        }
    finally:
        neardup.BLOCK = block
    assert all(got[i] == i - i % 2 for i in texts)


def test_samples_agree_with_the_weighted_similarity():
    """Independent samples: their agreement has the mean and the spread of coin tosses at the weighted Jaccard similarity."""
    rng, gaps = np.random.default_rng(5), []
    for _ in range(300):
        both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (260, 40, 40))
        a, b = np.sort(np.append(both, a)), np.sort(np.append(both, b))
        keys = np.append(a, b)
        w = 1 + (keys % np.uint64(7) == 0) - 0.2 * (keys % np.uint64(5) == 0)
        one, two = neardup.samples(keys, w, np.repeat([0, 1], 300), 48)
        common = w[:300][np.isin(a, both)].sum()
        gaps.append((one == two).mean() - common / (w.sum() - common))
    assert abs(np.mean(gaps)) < 0.015 and abs(np.std(gaps) - np.sqrt(0.76 * 0.24 / 48)) < 0.01


def test_all_pairs_of_a_template_corpus(spark):
    """Texts of one template: all pairs just below the bound but for those of 150 pairs, of which none may be lost."""
    shared, texts = [f"shared{i}" for i in range(400)], []
    for g in range(150):
        words = list(shared)
        for k in range(8):
            words[20 + 45 * k] = f"own{g}x{k}"
        for side in range(2):
            other = list(words)
            other[10 + side] = f"edit{g}x{side}"
            texts.append(" ".join(other))
    bags = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(rows).collect()}
    for i in range(len(texts)):
        for j in range(i):
            if len(bags[i] & bags[j]) >= 0.8 * len(bags[i] | bags[j]):
                assert got[i] == got[j]
    assert all(got[2 * g] == got[2 * g + 1] == 2 * g for g in range(150))
