"""Conversation repair, spelling variants and decontamination: by brute force, on awkward rows, and in parts of any size."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from pagesift.llm import conversations, decontaminate, queries, spelling

SF = "/root/testdata/sf0.01"

# conversation repair


def brute_edits(rows):
    """rows (role initial, fault): the cheapest edits, the ASCII-least of them; over all strings, from the back."""
    n = len(rows)

    @functools.cache
    def best(i, done, inserted):
        found = []
        if i == n and re.fullmatch("(s?(ua)+)?", done):
            found.append((0, ""))
        if inserted < 2:
            for c in "ua":
                if re.fullmatch("(s?(ua)*u?)?", done + c):
                    cost, rest = best(i, done + c, inserted + 1)
                    found.append((cost + 3, "I" + rest))
        if i < n:
            role, fault = rows[i]
            ways = [("D", done, 4)]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                ways += [("K", done + (role or "-"), more)] + [("R", done + c, 3 + more) for c in "ua"]
            for edit, to, price in ways:
                if re.fullmatch("(s?(ua)*u?)?", to):
                    cost, rest = best(i + 1, to, 0)
                    found.append((cost + price, edit + rest))
        return min(found, default=(10**6, ""))

    return best(0, "", 0)


@pytest.mark.parametrize("seed", range(6))
def test_search_finds_the_cheapest_least_edits(seed):
    rng = random.Random(seed)
    for _ in range(250):
        rows = [(rng.choice("ssuuuaaax"), rng.choice([None, None, None, "truncated", "blank", "duplicate"])) for _ in range(rng.randrange(8))]
        search, out = conversations.Search(), []
        for k, (role, fault) in enumerate(rows):
            out += search.add(role, fault, (k, role, "", fault))
        out += search.end()
        edits = "".join(e for e, _, _ in out)
        price = {"K": 0, "R": 3, "D": 4, "I": 3}
        faults = [rows[r[0]][1] for _, _, r in out if r] if rows else []
        cost = sum(price[e] for e in edits) + 3 * sum(f == "truncated" and e != "D" for f, (e, _, _) in zip(faults, [x for x in out if x[2]], strict=True))
        assert (cost, edits) == brute_edits(tuple(rows)), rows
        assert [r[0] for _, _, r in out if r] == list(range(len(rows)))
        assert re.fullmatch("(s?(ua)+)?", "".join(role[:1] for e, role, _ in out if e != "D"))


def test_settled_rows_are_forgotten():
    search, held, out = conversations.Search(), 0, 0
    for k in range(20_000):
        role = "ua"[k % 2] if k % 50 else "u"
        out += len(list(search.add(role, "truncated" if k % 7 == 0 else None, (k, role, "", None))))
        held = max(held, search.held())
    assert held < 120 and out > 19_800


def brute_summary(rows):
    """rows (conv_id, turn, role, text) of one conversation after damage, in order."""
    seen, found = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        found.append((role[:1], fault))
    cost, audit = brute_edits(tuple(found))
    turns = {t for _, t, _, _ in rows if t is not None}
    out, at, k = [], "", 0
    for e in audit:
        fits = "assistant" if at[-1:] == "u" else "user"
        if e == "I":
            out.append(f"{fits}:")
        elif e != "D":
            out.append(f"{rows[k][2] if e == 'K' else fits}:{rows[k][3]}")
        if e != "D":
            at += out[-1][:1]
        k += e != "I"
    pairs = [a[0] + b[0] for a, b in zip(found, found[1:], strict=False)]
    count = Counter(f for _, f in found)
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"], sum(p not in ("su", "ua", "au") for p in pairs),
        cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()
    )


def brute_repair(rows):
    kept = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        kept.setdefault(conv, []).extend([(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1))
    order = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())
    return {conv: brute_summary(sorted(x, key=order)) for conv, x in kept.items()}


def summaries(df):
    got = conversations.summary(conversations.repaired(conversations.damaged(df))).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def odd_conversations():
    rng, rows = random.Random(5), []
    for conv in [*range(150), None]:
        texts = ["Yes.", "no", "", " \t", "What? ", "é!\n", None, "Yes.", "x" * 500]
        rows += [(conv, rng.choice([None, 0, 1, 2, 3, 7]), rng.choice(["user", "assistant", "system", "tool", "", None, "u"]), rng.choice(texts)) for _ in range(rng.randrange(1, 7))]
    return rows + [(900, 1, "user", "same.")] * 6 + [(901, k, "user", "a.") for k in range(9)]


def test_repair_of_odd_conversations(spark):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"copies": F.lit("x"), "fault": F.lit(1), "h": F.lit(1)})
    assert summaries(df) == brute_repair(rows)
    assert summaries(df.where("false")) == {}


def test_sql_of_odd_conversations():
    """The SQL that checks the query takes odd rows as brute force does."""
    rows, duck = odd_conversations(), duckdb.connect()
    duck.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert {r[0]: r[1:] for r in duck.execute(queries.ORACLE_SQL["op11_conversation_repair"]).fetchall()} == brute_repair(rows)


def test_repair_of_the_given_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert summaries(df) == brute_repair([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_very_long_conversation(spark):
    df = spark.range(30_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"))
    r = conversations.summary(conversations.repaired(df)).collect()
    assert len(r) == 1 and r[0].audit == "K" * 30_000 and r[0].cost == 0


# spelling variants


def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def brute_variants(words):
    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, n in words.items():
        others = [(-m, v) for v, m in words.items() if v != w and near(v, w)]
        m, v = min(others, default=(0, None))
        out[w] = (v, n, len(others), -m) if v is not None and -m >= 2 * n else (None, n, len(others), None)
    def root(w):
        return w if out[w][0] is None else root(out[w][0])
    return {w: (form, root(w), n, k, form_n) for w, (form, n, k, form_n) in out.items()}


def test_spelling_variants_of_odd_texts(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(4, 8))) for _ in range(120)] + ["aaaaa", "aaaaaa", "aaaaaaa", "×÷×÷×", "Ünïcø", "ünïcø"]
    texts = [" ".join(rng.choices(words, weights=range(1, len(words) + 1), k=80)) for _ in range(80)] + [None, "", "$$$ 12", "é" * 5000, "AAAAA Āaaaaa"]
    rows = [(None if i % 17 == 0 else i, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("x"), "key": F.lit(0)})
    want = brute_words(rows)
    counts = spelling.word_counts(df, held=50)
    assert {r.word: r.n for r in counts.collect()} == want
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(counts).collect()}
    assert got == brute_variants(want)
    assert any(form != root for form, root, *_ in got.values() if form)
    assert spelling.variants(spelling.word_counts(df.where("false"))).collect() == []


def test_long_ways_to_a_root(spark):
    chain = ["x" * (5 + k) for k in range(12)]
    words = spark.createDataFrame([(w, 3 * 2**k) for k, w in enumerate(chain)], "word string, n long")
    got = spelling.variants(words).collect()
    assert {r.root for r in got} == {chain[-1]} and {r.form for r in got} == {*chain[1:], None}


# decontamination


def brute_scan(docs, bench, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    items = {}
    for i, t in bench:
        w = words(t)
        m = min(size, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            items.setdefault(tuple(w[k : k + m]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for m in {len(g) for g in items}:
            for k in range(len(w) - m + 1):
                if g := items.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    found |= g
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [200_000, 7])
def test_decontamination_of_odd_texts(spark, limit):
    rng = random.Random(4)
    some = lambda n: " ".join(rng.choices(["alpha", "Beta", "γάμμα", "4", "délta-x", "b"], k=n))
    bench = [(i, some(rng.randrange(1, 25))) for i in range(30)] + [(1, some(12)), (None, some(11)), (40, None), (41, " --- "), (42, some(10))]
    bench += [(100 + k, bench[3][1]) for k in range(3)]
    texts = [some(40) for _ in range(20)] + [f"Intro,{bench[k][1].upper()}!! and {bench[k + 1][1]}" for k in range(30)] + [None, "", "...", "b " * 5000, bench[-4][1]]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[25]), (None, texts[26])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item": F.lit(1), "n_hit": F.lit("x"), "k1": F.lit(0)})
    b = spark.createDataFrame(bench, "item_id long, text string").withColumns({"window": F.lit(1), "size": F.lit("x")})
    digest = lambda docs, bench: sorted((tuple(r) for r in decontaminate.digests(decontaminate.scan(docs, bench, limit=limit)).collect()), key=str)
    assert digest(d, b) == brute_scan(docs, bench)
    assert digest(d, b.where("false")) == brute_scan(docs, [])
    assert digest(d.where("false"), b) == []


def test_spans_and_documents_are_removed(spark):
    item = "one two three four five six seven eight nine ten eleven"
    d = spark.createDataFrame([(1, f"É vor; {item.upper()}, nach"), (2, "clean text"), (3, None), (4, item)], "doc_id long, text string")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r.doc_id: r.text for r in decontaminate.decontaminated(d, b).collect()} == {1: "É vor; , nach", 2: "clean text", 3: None, 4: ""}
    assert {r.doc_id for r in decontaminate.decontaminated(d, b, "documents").collect()} == {2, 3}
    span = {r.doc_id: [tuple(s) for s in r.spans] for r in decontaminate.scan(d, b).collect()}
    assert span == {1: [(7, 7 + len(item))], 2: [], 3: [], 4: [(0, len(item))]}
    assert {queries.QUERIES[f"op{k}_{n}"].__name__ for k, n in ((11, "conversation_repair"), (12, "spelling_variants"), (13, "decontamination"))}
