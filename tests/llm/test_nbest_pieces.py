"""The n best segmentations of a text, not their scores alone."""

import hashlib

import numpy as np
import pytest

from pagesift.llm import pieces, queries

PATH = queries.vocabulary("piece_bpe_32k.model")


def test_n_best_segmentations_of_texts(spark):
    texts = {1: "hello tion\nx  world", 2: "thand", 3: "", 4: None, 5: "a1b2-c3 ☃\n\n▁d", 6: "word " * 200 + "x" * 60}
    model = pieces.load(PATH)
    lattice, score_of = pieces.Lattice(model, 4), dict(model["pieces"].values())
    got = {r.doc_id: r for r in pieces.encode(spark.createDataFrame([*texts.items()], "doc_id long, text string"), PATH, 4).collect()}
    for i, text in texts.items():
        r = got[i]
        assert len(r.nbest_ids) == len(r.nbest_sha256) == len(r.nbest_scores) == len({*map(tuple, r.nbest_ids)}) and r.nbest_ids[0] == r.ids
        assert len(r.nbest_ids) == (4 if i in (1, 2, 6) else 2 if i == 5 else 1)
        for ids, score, digest in zip(r.nbest_ids, r.nbest_scores, r.nbest_sha256, strict=True):
            assert lattice.decode(ids) == (text or "") and hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest() == digest
            assert score == pytest.approx(sum(score_of.get(x, model["byte_score"]) for x in ids))
    (raws, scores, _), = lattice.n_best(["hello"])
    whole = lattice.search("▁hello")
    assert [np.frombuffer(x, "<i4").tolist() for x in raws] == [ids.tolist() for _, ids in whole] and scores == pytest.approx([s for s, _ in whole])
