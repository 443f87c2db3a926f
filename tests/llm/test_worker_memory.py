"""What a worker's Python holds: a part of a batch at a time, few powers, and a lattice no longer than its own stage."""

import gc
import tracemalloc

import numpy as np
import pyarrow as pa

from pagesift.llm import common, pieces
from pagesift.llm.queries import vocabulary


def test_texts_leave_a_batch_in_parts():
    texts = [None, "", *(f"{i} " + "x" * 20_000 for i in range(1_500)), None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    at = 0
    for part, found in common.text_chunks([batch, batch.slice(0, 0)]):
        assert part.column("doc_id").to_pylist() == [*range(at, at + len(found))] and found == [t or "" for t in texts[at : at + len(found)]]
        at += len(found)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at == len(texts) and most < 8 << 20


def test_few_powers_are_kept():
    tracemalloc.start()
    for k in range(12, 24):
        p, inv = common.powers(common._BYTE_BASE, 1 << k)
        assert len(p) > 1 << k and (p[-1:] * inv[-1:])[0] == 1 and p[1] == np.uint64(common._BYTE_BASE)
    p = inv = None
    left = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert left < 48 << 20


def test_a_lattice_goes_with_its_stage(spark):
    docs = spark.range(0, 40, 1, 4).selectExpr("id as doc_id", "concat('some words ', id) as text")
    assert pieces.encode(docs, vocabulary("piece_bpe_32k.model")).where("round_trip").count() == 40

    def held(batches):
        for batch in batches:
            gc.collect()
            yield pa.RecordBatch.from_arrays([pa.array([sum(type(x).__name__ == "Lattice" for x in gc.get_objects())] * len(batch))], names=["n"])

    assert docs.select("doc_id").mapInArrow(held, "n long").where("n > 0").count() == 0
