"""Exact substring dedup over words by level-wise doubling.

A window of `length` words can only repeat if every shorter window in it repeats. So a level looks at windows of fewer
words, and of these only at one in each long window, which the long window's own words pick (the one with the smallest
hash): equal long windows pick equal short ones. Short windows that occur once are dropped with all long windows that
picked them. Survivors alone are extended to windows twice as long (the last level is clipped to `length`), until the
length is reached or nothing survives. From `first` words on there are as many levels as doublings; by default the first
level has half the length, which leaves few windows that the last one drops.

Windows are judged by hashes: 64 bits for each word, then 64 and 31 bits of two sums over the words; words themselves
are not compared. Nulls and empty texts have no words; repeated rows are further documents; ties of hashes pick the
leftmost window. Only columns doc_id and text are read, so extra columns can't clash.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import Shelf, row_key, text_chunks, window_hashes, word_hashes

_ANCHORS = "k1 long, k2 int, pos int, h long"
_WINDOWS = "k1 long, k2 int, pos int, h long, h2 int"
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def picked(words: np.ndarray, counts: np.ndarray, length: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all long windows that stay in one text, the short window that each picks, and the short windows' hashes."""
    text = np.repeat(np.arange(len(counts)), counts)
    n = len(words) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    short = window_hashes(words, first)
    best, at, width, span = short, np.arange(len(short)), 1, length - first + 1
    while width < span:
        step = min(width, span - width)
        left = best[:-step] <= best[step:]
        best, at, width = np.where(left, best[:-step], best[step:]), np.where(left, at[:-step], at[step:]), width + step
    starts = np.flatnonzero(text[:n] == text[length - 1 :])
    return starts, at[starts], short


def _anchors(length: int, first: int):
    """The windows of `first` words that the long windows pick."""

    def run(batches):
        for batch, texts in text_chunks(batches):
            words, counts = word_hashes([t.encode() for t in texts])
            starts, at, short = picked(words, counts, length, first)
            if not len(starts):
                continue
            at = at[np.diff(at, prepend=-1) != 0]
            base = np.cumsum(counts) - counts
            row = np.searchsorted(base + counts, at, side="right")
            k1, k2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("k1", "k2"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1[row]), pa.array(k2[row]), pa.array((at - base[row]).astype(np.int32)), pa.array(short[at].view(np.int64))],
                names=["k1", "k2", "pos", "h"]
            )

    return run


def _longer(length: int, sizes: list[int]):
    """The windows of the last of `sizes` words that the long windows pick which are left after the levels before."""

    def run(batches):
        for batch, texts in text_chunks(batches):
            for k1, k2, flagged, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "flagged")), texts, strict=True):
                words, starts = _candidates(text, flagged, length, sizes[:-1])
                every, at, short = picked(words, np.array([len(words)]), length, sizes[-1])
                at = np.unique(at[np.isin(every, starts)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(at), k1)), pa.array(np.full(len(at), k2, np.int32)), pa.array(at.astype(np.int32)),
                        pa.array(short[at].view(np.int64))
                    ],
                    names=["k1", "k2", "pos", "h"]
                )

    return run


def _candidates(text: str, flagged, length: int, sizes: list[int]):
    """Of one text with flagged short windows for each level: its words' hashes, and starts of the long windows that picked one at each."""
    words, counts = word_hashes([text.encode()])
    left = None
    for size, places in zip(sizes, flagged, strict=True):
        starts, at, _ = picked(words, counts, length, size)
        hit = starts[np.isin(at, places)]
        left = hit if left is None else np.intersect1d(left, hit, assume_unique=True)
    return words, left


def _windows(length: int, sizes: list[int]):
    def run(batches):
        for batch, texts in text_chunks(b.filter(b.column("flagged").is_valid()) for b in batches):
            out: list[list[np.ndarray]] = []
            for k1, k2, flagged, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "flagged")), texts, strict=True):
                words, starts = _candidates(text, flagged, length, sizes)
                out.append(
                    [
                        np.full(len(starts), k1), np.full(len(starts), k2, np.int32), starts.astype(np.int32),
                        window_hashes(words, length)[starts].view(np.int64),
                        (window_hashes(words, length, True)[starts] >> np.uint64(33)).astype(np.int32)
                    ]
                )
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["k1", "k2", "pos", "h", "h2"])

    return run


def _removal(length: int, sizes: list[int], keep_text: bool):
    def run(batches):
        for batch, texts in text_chunks(batches):
            rows = []
            for doc_id, flagged, single, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "flagged", "single")), texts, strict=True):
                words = text.encode().split()
                n = len(words)
                if flagged is not None:
                    _, starts = _candidates(text, flagged, length, sizes)
                    starts = starts[~np.isin(starts, single or [])]
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + length, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = b" ".join(words)
                rows.append((doc_id, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(c, t) for c,
                    t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
            )

    return run


def repeated_out(docs: DataFrame, length: int = 35, keep_text: bool = True, first: int | None = None) -> DataFrame:
    """Remove every word covered by a window of `length` words that also starts anywhere else in docs(doc_id, text).

    Returns doc_id, n_words, n_removed, kept_sha256 and kept (null unless keep_text), a row for each row of docs.
    """
    sizes = [first or (length + 1) // 2]
    rows = row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    flags, key, shelf = None, ["k1", "k2"], Shelf(docs.sparkSession)
    while True:
        if flags is None:
            anchors = rows.select(*key, "text").mapInArrow(_anchors(length, sizes[0]), _ANCHORS)
        else:
            anchors = rows.join(flags, key).select(*key, "text", "flagged").mapInArrow(_longer(length, list(sizes)), _ANCHORS)
        anchors = shelf.save(anchors)
        again = shelf.save(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
        found = anchors.join(again, "h", "left_semi").groupBy(*key).agg(F.collect_set("pos").alias("places"))
        if flags is not None:
            found = found.join(flags, key)
        before = F.array().cast("array<array<int>>") if flags is None else F.col("flagged")
        flags = shelf.save(found.select(*key, F.array_append(before, F.col("places")).alias("flagged")))
        shelf.drop(anchors, again)
        if 2 * sizes[-1] >= length or not flags.limit(1).count():
            break
        sizes.append(2 * sizes[-1])
    joined = rows.join(flags, key, "left")
    # the same plan as below, unflagged rows and all, so that one exchange of the texts serves both
    long = joined.select("doc_id", *key, "text", "flagged").mapInArrow(_windows(length, sizes), _WINDOWS)
    once = long.groupBy("h", "h2").agg(
        F.count("*").alias("n"), F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.first("pos").alias("pos")
    ).where("n = 1")
    single = once.groupBy(*key).agg(F.collect_list("pos").alias("single"))
    out = joined.join(single, key, "left").select("doc_id", "text", "flagged", "single")
    return out.mapInArrow(_removal(length, sizes, keep_text), _RESULT)
