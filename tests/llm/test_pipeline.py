"""The pipeline stage by stage against brute force: which documents stay, what is masked, and how often each is taken."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from pagesift.llm import mixing, pii, queries, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage over the smallest tables and planted rows."""
    rng, words = random.Random(3), [f"w{k}" for k in range(400)]
    long = " ".join(rng.choices(words, k=300))
    near = long.replace(long.split()[150], "changed", 1)
    personal = "Write to jane.doe@example.org or +49 (30) 1234567 please. " + " ".join(rng.choices(words, k=60))
    planted = [
        (900_001, long, "en", "src1", None), (900_002, near, "en", "src2", 7), (900_003, long, "en", None, 7), (900_004, None, None, None, None), (900_005, "", "en", "src1", 0),
        (900_006, personal, "en", "src1", 1), (None, personal + " tail", None, "src3", 1), (900_007, " ".join(rng.choices(words, k=50)), "en", "src3", 1)
    ]
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    docs.unionByName(spark.createDataFrame(planted, SCHEMA)).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    now, out = spark.read.parquet(f"{path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, path).write.parquet(f"{path}/{k}")
        after = spark.read.parquet(f"{path}/{k}")
        out.append((name, now, after))
        now = after
    return spark, path, {name: (before, [r.asDict() for r in before.collect()], [r.asDict() for r in after.collect()]) for name, before, after in out}, long, near, personal


def test_toxic_documents_go_and_all_others_stay(stages):
    spark, _, done, *_ = stages
    assert {900_001, 900_004, 900_005, 900_006, None} <= {r["doc_id"] for r in done["toxicity"][2]}
    path = "/root/testdata/sf0.01"
    before, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    model = toxicity.learn(before, labels.where(queries.fold("doc_id", 5) != 0))
    rows, kept = before.collect(), corpus_pipeline.toxic_out(spark, before, path).collect()
    assert sorted(r.doc_id for r in rows if model.score(r.text or "")[0] < 0.5) == sorted(r.doc_id for r in kept)
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    left = {r.doc_id for r in kept}
    assert len(toxic & left) <= 0.4 * len(toxic) and len(clean & left) >= 0.95 * len(clean)


def test_one_document_of_each_group_stays(stages):
    _, _, done, long, near, _ = stages
    _, rows, kept = done["near duplicates"]

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])

    bags = [shingles(r["text"]) for r in rows]
    alike = lambda a, b: sum((a & b).values()) >= 0.8 * sum((a | b).values())
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and min(sum(bags[i].values()), sum(bags[j].values())) >= 0.8 * max(sum(bags[i].values()), sum(bags[j].values())) and alike(bags[i], bags[j]):
                group[root(i)] = root(j)
    classes: dict = {}
    for i, r in enumerate(rows):
        classes.setdefault(root(i) if bags[i] else ("bare", i), []).append((r["doc_id"] is None, r["doc_id"]))
    want = sorted(min(x) for x in classes.values())
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept) == want
    assert [r["doc_id"] for r in kept if r["text"] in (long, near)] == [900_001]


def test_personal_data_is_masked(stages):
    _, _, done, _, _, personal = stages
    _, rows, kept = done["personal data"]
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in kept)
    assert all(not pii.base_spans(r["text"] or "") for r in kept)
    assert all(r["n_chars"] == len(r["text"]) for r in kept if r["text"] is not None)
    masked = [r["text"] for r in kept if r["text"] and r["text"].startswith("Write to")]
    assert masked and all(m.startswith("Write to [EMAIL] or [PHONE] please. w") for m in masked)
    same = {r["doc_id"]: r["text"] for r in rows if not pii._SIGN.search(r["text"] or "")}
    assert all(r["text"] == same[r["doc_id"]] for r in kept if r["doc_id"] in same)


def test_documents_are_taken_as_often_as_the_mix_says(stages):
    _, _, done, *_ = stages
    before, rows, kept = done["source mixing"]
    taken = mixing.mix(before.withColumn("weight", mixing.quality())).collect()
    want = Counter({r.doc_id: r.taken // r["size"] if r["size"] else 1 for r in taken})
    got = Counter(r["doc_id"] for r in kept)
    assert got == +want
    sizes, targets = Counter(), {r.source: r.target for r in taken}
    for r in taken:
        sizes[r.source] += r.taken
    largest = max(r["size"] for r in taken)
    assert all(abs(sizes[s] - t) <= largest for s, t in targets.items()) and len(rows) >= len(want) - 1


def test_pieces_give_back_the_text(stages):
    _, _, done, *_ = stages
    _, rows, kept = done["pieces"]
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in kept) and all(r["round_trip"] for r in kept)
