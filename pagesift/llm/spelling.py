"""Spelling variants by permuterm rotations.

Words are marked with an end sign and rotated. A replaced letter stands last in one rotation of either word, and what
stands before it is the same; a word that lacks the letter has just that part as a rotation. So rotations are sorted by
all but their last letter (`skip`) or as a whole (`full`), and each group of equal ones holds all words that differ from
each other by that letter: at most one for each letter of the alphabet and one without it, however many words there are.
One scan over the sorted rotations counts each word's neighbours and keeps its best one; pairs are never written.

A letter of a run (`aab`) gives the shorter word more than once; only the run's last letter counts for it. Null texts
have no words; repeated rows are further documents; a null doc_id is written as the empty string; without words there
are no rows; only doc_id and text are read, so extra columns can't clash.
"""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import Shelf, text_chunks

_RUN = re.compile(rb"[a-z\xc0-\xff]+")
END = "$"


def runs(text: str):
    """Runs of Latin letters with A-Z in lower case, a byte for each code point."""
    return (m[0] for m in _RUN.finditer(text.encode("latin-1", "replace").lower()))


def misspelt(doc_id, run: bytes, every: int) -> bytes:
    """The run, without one letter if `every` divides the check sum of the document's id and the run."""
    h = zlib.crc32(b"%b:%b" % (str("" if doc_id is None else doc_id).encode(), run.decode("latin-1").encode()))
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, every: int | None = 97, letters: int = 5, least: int = 3, held: int = 300_000) -> DataFrame:
    """word and n of docs(doc_id, text): words of `letters` letters or more that occur `least` times; a task holds up to about `held`.

    Every run whose check sum `every` divides loses a letter first (None: none does).
    """

    def run(batches):
        found: Counter = Counter()

        def flushed():
            words = [w for w in found if len(w) >= letters]
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array([found[w] for w in words], pa.int64())], names=["word", "m"])
            found.clear()
            return out

        for batch, texts in text_chunks(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                own = Counter(runs(text))
                if every:
                    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for w in [w for w in own if zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), seed) % every == 0]:
                        found[misspelt(doc_id, w, every)] += own.pop(w)
                found.update(own)
                if len(found) > held:
                    yield flushed()
        yield flushed()

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, m long")
    return rows.groupBy("word").agg(F.sum("m").alias("n")).where(F.col("n") >= least)


def rotations(words: DataFrame) -> DataFrame:
    """key, letter, last and n of words(word, n): each rotation without its last letter, and each whole one (letter is empty).

    last tells whether the letter ends a run of equal ones.
    """
    part = lambda i, n: F.substring(F.col("word"), i, n)
    size = F.length("word")
    whole = lambda i, letter, p, last: F.struct(F.concat(part(i + 1, size), F.lit(END), part(F.lit(1), p)).alias("key"), letter.alias("letter"), last.alias("last"))
    skip = F.transform(F.sequence(F.lit(1), size), lambda i: whole(i, part(i, F.lit(1)), i - 1, part(i, F.lit(1)) != part(i + 1, F.lit(1))))
    full = F.transform(F.sequence(F.lit(0), size), lambda i: whole(i, F.lit(""), i, F.lit(False)))
    return words.select("n", F.explode(F.concat(skip, full)).alias("r")).select("r.key", "r.letter", "r.last", "n")


_NEAR = "word string, near long, best_n long, best string"


def _emitted(key: str, letters: list[str], last: list[bool], n: list[int]):
    """Each word of a group: its word, how many neighbours of it are counted here, and the best of them (n, word)."""
    after, _, before = key.partition(END)
    members = sorted((-m, before + c + after, c, x) for c, m, x in zip(letters, n, last, strict=True))
    n_skip, n_last = sum(c != "" for _, _, c, _ in members), sum(x for _, _, _, x in members)
    has_full = n_skip < len(members)
    for k, (_, word, c, x) in enumerate(members):
        other = members[1 if k == 0 else 0]
        yield word, (n_skip - 1 + (x and has_full)) if c else n_last, -other[0], other[1]


def _scanned(batches):
    """Neighbours over rows sorted by key; a group that goes on in the next batch is carried over."""
    shape = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    rest = None

    def run(table: pa.Table):
        out = []
        if len(table) > 1:
            key = table.column("key").combine_chunks()
            same = np.concatenate([[False], pc.equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False), [False]])
            some = table.filter(pa.array(same[:-1] | same[1:]))
            key, letters, last, n = (some.column(c).to_pylist() for c in ("key", "letter", "last", "n"))
            start = 0
            for i in range(1, len(key) + 1):
                if i == len(key) or key[i] != key[start]:
                    out += _emitted(key[start], letters[start:i], last[start:i], n[start:i])
                    start = i
        columns = zip(*out, strict=True) if out else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, shape.types, strict=True)], schema=shape)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        if not len(table):
            continue
        keys = table.column("key")
        # groups are no larger than the alphabet, so that the end is near
        cut = len(table) - 1
        while cut and keys[cut - 1].as_py() == keys[cut].as_py():
            cut -= 1
        yield run(table.slice(0, cut))
        rest = table.slice(cut)
    if rest is not None:
        yield run(rest)


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near and the best neighbour (best, best_n: largest n, then least word) of words(word, n) that have any."""
    sorted_rows = rotations(words).repartition("key").sortWithinPartitions("key")
    near = sorted_rows.mapInArrow(_scanned, _NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    out = near.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b"))
    return out.select("word", "n_near", F.col("b.w").alias("best"), (-F.col("b.m")).alias("best_n"))


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n of words(word, n).

    The form is the best neighbour, if it occurs at least `times` as often. Roots are found by doubling: each round
    follows the forms found so far twice as far, so rounds grow with the logarithm of the longest way.
    """
    shelf = Shelf(words.sparkSession)
    words = shelf.save(words)
    rows = words.join(neighbours(words), "word", "left")
    is_form = F.col("best_n") >= times * F.col("n")
    rows = shelf.save(
        rows.select(
            "word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("best_n")).alias("form_n")
        )
    )
    ways = shelf.save(rows.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = shelf.save(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = further.where("moved").limit(1).count()
        shelf.drop(ways)
        ways = further
        if not moved:
            break
        ways = further.select("word", "root")
        shelf.paths[id(ways)] = (ways, shelf.paths.pop(id(further))[1])
    return rows.join(ways.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
