"""Benchmark decontamination: a broadcast set of normalised test n-grams, looked up in every window of the documents.

Normalised: A-Z in lower case; words are runs of digits, a-z and anything beyond ASCII. A window is `size` consecutive
words of an item; an item of fewer words, but not none, is one window of its own length. A document's windows are
compared by 64-bit hashes first, and each hit by the words themselves. Words inside any occurrence of a window are hit.

The windows are counted before they are broadcast. Up to `limit` they are one set; beyond it they are dealt by hash into
sets of about `limit`, the documents are scanned with one set after the other, and what was found is put together by row.

Null and empty texts have no words; an item without words has no window. Repeated rows of documents are scanned alike;
repeated rows of an item_id are one item with the windows of all; a null item_id counts as an item named by the empty
string. Without benchmark rows nothing is hit. Only doc_id and text (item_id and text) are read, so extra columns can't clash.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import arrow, hashed, row_key, saved, text_chunks, window_hashes, word_places

#: Bytes that end a word: all of ASCII but digits and lower-case letters.
GAPS = np.ones(256, bool)
GAPS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_RESULT = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
_FOUND = "k1 long, k2 int, starts array<int>, sizes array<int>, items array<string>"


def _words(texts: list[str]):
    """Lower-cased bytes of all texts, starts and ends of their words, how many each text has, and the words' hashes."""
    raw, starts, ends, counts = word_places([t.encode().lower() for t in texts], GAPS)
    return raw, starts, ends, counts, hashed(raw, starts, ends)


def _windows(size: int):
    def run(batches):
        for batch, texts in text_chunks(batches):
            raw, starts, ends, counts, _ = _words(texts)
            words = [raw[s:e].decode() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            rows, at = [], 0
            for item, n in zip(batch.column("item").to_pylist(), counts.tolist(), strict=True):
                m = min(size, n)
                rows += [(item, m, " ".join(words[i : i + m])) for i in range(at, at + n - m + 1) if m]
                at += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.string(), pa.int32(), pa.string()), strict=True)],
                names=["item", "size", "window"]
            )

    return run


def windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """item, size and window (its words joined by spaces) of benchmark(item_id, text), each once for an item."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_windows(size), "item string, size int, window string").distinct()


class Grams:
    """A set of windows: their sorted hashes by length, and the items of each."""

    def __init__(self, table: pa.Table):
        self.items: dict[bytes, list[str]] = {}
        by_size: dict[int, list[bytes]] = {}
        for item, size, window in zip(*(table.column(c).to_pylist() for c in ("item", "size", "window")), strict=True):
            key = window.encode()
            if key not in self.items:
                self.items[key] = []
                by_size.setdefault(size, []).append(key)
            self.items[key].append(item)
        self.hashes = {}
        for size, keys in by_size.items():
            raw, starts, ends, _ = word_places(keys, GAPS)
            self.hashes[size] = np.unique(window_hashes(hashed(raw, starts, ends), size)[::size])

    def hits(self, texts: list[str]) -> tuple[np.ndarray, list[tuple[list[int], list[int], set[str]]]]:
        """Numbers of words of the texts; of each text the starts (by word) and sizes of occurring windows, and their items."""
        raw, starts, ends, counts, words = _words(texts)
        text, base = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
        out = [([], [], set()) for _ in texts]
        for size, known in self.hashes.items():
            h = window_hashes(words, size)
            at = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
            at = at[text[at] == text[at + size - 1]] if len(at) else at
            for i, k in zip(at.tolist(), text[at].tolist(), strict=True):
                own = b" ".join([raw[s:e] for s, e in zip(starts[i : i + size].tolist(), ends[i : i + size].tolist(), strict=True)])
                if items := self.items.get(own):
                    out[k][0].append(i - int(base[k]))
                    out[k][1].append(size)
                    out[k][2].update(items)
        return counts, out


def _hit_words(n: int, starts, sizes) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.asarray(starts, np.int64), 1)
    np.add.at(edge, np.asarray(starts, np.int64) + np.asarray(sizes, np.int64), -1)
    return np.cumsum(edge[:-1]) > 0


def _row(doc_id, text: str, n: int, starts, sizes, items) -> tuple:
    """A result's row. Spans reach from the first to the last of neighbouring hit words, in code points."""
    if not len(starts):
        return doc_id, n, 0, [], []
    hit = _hit_words(n, starts, sizes)
    raw, first, last, _ = word_places([text.encode().lower()], GAPS)
    flips = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    spans, chars, at = [], 0, 1  # one blank stands before the text
    for a, b in zip(flips[::2].tolist(), flips[1::2].tolist(), strict=True):
        start = chars + len(raw[at : first[a]].decode())
        chars, at = start + len(raw[first[a] : last[b - 1]].decode()), int(last[b - 1])
        spans.append({"start": start, "end": chars})
    return doc_id, n, int(hit.sum()), sorted(items), spans


def _batch(rows: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(shape)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, shape.types, strict=True)], schema=shape)


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 10, limit: int = 200_000, keep_text: bool = False) -> DataFrame:
    """Of every row of docs(doc_id, text): n_words, n_hit, the sorted item_ids whose windows occur, spans of hit words, and the text if asked for."""
    spark = docs.sparkSession
    rows = row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    result_ddl = _RESULT + ", text string" * keep_text
    result, found_shape = arrow(result_ddl, spark), arrow(_FOUND, spark)
    grams = windows(benchmark, size)
    n = grams.count()
    sets = max(1, -(-n // limit))

    def told(batch, rows):
        made = _batch(rows, result if not keep_text else pa.schema(list(result)[:-1]))
        return pa.RecordBatch.from_arrays([*made.columns, batch.column("text")], schema=result) if keep_text else made

    def whole(grams):
        def run(batches):
            for batch, texts in text_chunks(batches):
                counts, found = grams.value.hits(texts)
                yield told(batch, [_row(i, t, k, *f) for i, t, k, f in zip(batch.column("doc_id").to_pylist(), texts, counts.tolist(), found, strict=True)])

        return run

    def partly(grams):
        def run(batches):
            for batch, texts in text_chunks(batches):
                _, found = grams.value.hits(texts)
                keys = zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), found, strict=True)
                yield _batch([(k1, k2, f[0], f[1], sorted(f[2])) for k1, k2, f in keys if f[0]], found_shape)

        return run

    if sets == 1:
        return rows.mapInArrow(whole(spark.sparkContext.broadcast(Grams(grams.toArrow()))), result_ddl)
    grams, parts = saved(grams), None
    for k in range(sets):
        own = grams.where(F.pmod(F.xxhash64("window"), F.lit(sets)) == k).toArrow()
        found = rows.mapInArrow(partly(spark.sparkContext.broadcast(Grams(own))), _FOUND)
        parts = found if parts is None else parts.unionByName(found)
    together = lambda name: F.flatten(F.transform("found", lambda x: x[name])).alias(name)
    # copies of a row give equal finds, so a key gathers one entry for each set
    parts = parts.groupBy("k1", "k2").agg(F.collect_set(F.struct("starts", "sizes", "items")).alias("found"))
    parts = parts.select("k1", "k2", together("starts"), together("sizes"), F.array_distinct(F.flatten(F.transform("found", lambda x: x["items"]))).alias("items"))

    def last(batches):
        for batch, texts in text_chunks(batches):
            counts = word_places([t.encode().lower() for t in texts], GAPS)[3].tolist()
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "starts", "sizes", "items"))
            yield told(batch, [_row(i, t, n, a or [], b or [], c or []) for i, a, b, c, t, n in zip(*columns, texts, counts, strict=True)])

    return rows.join(parts, ["k1", "k2"], "left").select("doc_id", "text", "starts", "sizes", "items").mapInArrow(last, result_ddl)


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", size: int = 10, limit: int = 200_000) -> DataFrame:
    """docs(doc_id, text) without what the benchmark holds: without the spans (remove="spans"), or without hit documents ("documents")."""
    found = scan(docs, benchmark, size, limit, keep_text=True)
    if remove == "documents":
        return found.where("n_hit = 0").select("doc_id", "text")
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("spans", i - 1)["end"])
    part = lambda i: F.substring(F.col("text"), begin(i) + 1, F.coalesce(F.get("spans", i)["start"], F.length("text")) - begin(i))
    kept = F.array_join(F.transform(F.sequence(F.lit(0), F.size("spans")), part), "")
    return found.select("doc_id", F.when(F.col("n_hit") > 0, kept).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of scan()."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated")
    )
