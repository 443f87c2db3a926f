"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

Shingles are five consecutive words (all words of shorter texts). A shingle weighs its count in the text times an
inverse-document-frequency factor: 1 while it is in at most a twentieth of all documents, falling with the logarithm of
its frequency to 0.75 for one in all. (The plain logarithm tears large groups of near copies apart: what they share is
then frequent and weighs little next to their edits.) Frequencies are exact, over all documents.

A text's signature has `bands` times `width` samples, each drawn by improved consistent weighted sampling from all its
shingles, so that two texts agree in a sample with the probability of their weighted Jaccard similarity. Samples are
banded, and texts that share a bucket of some band are candidates. In each bucket a centre is compared with all others
(in cells of about `STAR` texts). Of a bucket whose texts are not all linked to its centre, all pairs are then judged
but those of two linked texts: its texts are dealt into blocks, and each two blocks meet in a cell of their own. A pair
in several buckets is judged in the first one. So no two texts that share a bucket and have a similarity of `least` end
in different classes, which are the connected components of the links.

Equal texts are one text from the start (by their 128-bit digest), so copies are never paired. Texts without words
(null, empty, white space) are alone in their class. Only doc_id and text are read, so extra columns can't clash.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import Shelf, mixed, text_chunks, text_slices, window_hashes, word_hashes

SHINGLE, LEAST, SHARE, LOWEST = 5, 0.8, 20, 0.75
#: Texts of a block, texts that meet a centre in one cell, and words of either about.
BLOCK, STAR, WORDS = 256, 64, 1 << 20
#: The place of the low half of a 64-bit number.
_LOW = int(sys.byteorder == "big")


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all texts (sorted within each), how often each occurs in its text, and the text's place."""
    words, counts = word_hashes([t.encode() for t in texts])
    owner = np.repeat(np.arange(len(counts)), counts)
    long = window_hashes(words, SHINGLE)
    inside = owner[: len(long)] == owner[len(owner) - len(long) :]
    keys, owners = long[inside], owner[: len(long)][inside]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        starts = np.cumsum(counts) - counts
        keys = np.concatenate([keys, *(mixed(window_hashes(words[starts[i] : starts[i] + counts[i]], int(counts[i]))) for i in short)])
        owners = np.append(owners, short)
    order = np.lexsort((keys, owners))
    keys, owners = keys[order], owners[order]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1]))) if len(keys) else order
    return keys[first], np.diff(np.append(first, len(keys))), owners[first]


def frequent(texts: DataFrame, shelf: Shelf) -> tuple[int, np.ndarray, np.ndarray]:
    """How many rows there are, the shingles in more than a SHARE-th of them (sorted), and in how many rows each is.

    Partitions are gone through in groups of about a million shingles; a group names those that are in a part of its rows
    that is half as large. What groups don't name then bounds a shingle's count, and only those that can still reach the
    share are collected: at most 2 SHARE times the mean number of shingles of a text, whatever the number of rows.
    """

    def grouped(rows: int, keys: list):
        every, counts = np.unique(np.concatenate(keys), return_counts=True)
        often = counts * 2 * SHARE >= rows
        wide = rows if rows > 2 * SHARE else 0  # smaller groups name all they hold
        n = int(often.sum()) + 1
        columns = (
            np.append(every[often].view(np.int64), 0), np.append(counts[often], 0), np.append(np.zeros(n - 1, np.int64), rows), np.full(n, wide)
        )
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["h", "n", "rows", "wide"])

    def local(batches):
        rows, keys, size = 0, [np.zeros(0, np.uint64)], 0
        for _, part in text_chunks(batches, 1 << 18):
            found = shingles(part)[0]
            rows, size = rows + len(part), size + len(found)
            keys.append(found)
            if size > 1 << 20:
                yield grouped(rows, keys)
                rows, keys, size = 0, [np.zeros(0, np.uint64)], 0
        if rows:
            yield grouped(rows, keys)

    found = shelf.save(texts.select("text").mapInArrow(local, "h long, n long, rows long, wide long"))
    total = found.where("rows > 0").agg(F.sum("rows").alias("rows"), F.sum("wide").alias("wide")).first()
    rows, wide = total.rows or 0, total.wide or 0
    named = found.where("rows = 0").groupBy("h").agg(F.sum("n").alias("n"), F.sum("wide").alias("wide"))
    named = named.where((F.col("n") * 2 * SHARE + F.lit(wide) - F.col("wide") > 2 * rows)).toArrow()
    shelf.drop(found)
    h, n, whole = named.column("h").to_numpy(), named.column("n").to_numpy(), named.column("wide").to_numpy() == wide
    known = np.sort(h[~whole].view(np.uint64))

    def exact(batches):
        n = np.zeros(len(known), np.int64)
        for _, part in text_chunks(batches, 1 << 18):
            keys = shingles(part)[0]
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            n += np.bincount(at[known[at] == keys], minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(n)], names=["h", "n"])

    if len(known):
        counts = texts.select("text").mapInArrow(exact, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).toArrow()
        h, n = np.append(h[whole], counts.column("h").to_numpy()), np.append(n[whole], counts.column("n").to_numpy())
    often = n * SHARE > rows
    keys, n = h[often].view(np.uint64), n[often]
    order = np.argsort(keys)
    return rows, keys[order], n[order]


class Weights:
    """Weights of shingles: counts, those of frequent shingles times a factor between LOWEST and 1."""

    def __init__(self, rows: int, keys: np.ndarray, n: np.ndarray):
        self.keys = keys
        self.idf = 1 - (1 - LOWEST) * np.log(np.maximum(1, n * SHARE / max(rows, 1))) / np.log(SHARE)

    def __call__(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = counts.astype(float)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            w = np.where(self.keys[at] == keys, w * self.idf[at], w)
        return w


def _quantiles(steps: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of the gamma distribution of shape 2, in the middle of `steps` even steps, and their logarithms."""
    u = (np.arange(steps) + 0.5) / steps
    low, high = np.zeros(steps), np.full(steps, 64.0)
    for _ in range(60):
        x = (low + high) / 2
        below = 1 - (1 + x) * np.exp(-x) < u
        low, high = np.where(below, x, low), np.where(below, high, x)
    return high.astype(np.float32), np.log(high).astype(np.float32)


_tables: list = []


def samples(keys: np.ndarray, weights: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """`count` samples of each text that has shingles, a row for each, as 64-bit numbers of a shingle and a level.

    Of a shingle's hash for the sample, 16 bits tell r and 16 bits c (both gamma of shape 2), and 32 bits beta (even).
    The level is floor(log w / r + beta), and the shingle with the least log c - r (level - beta) - r is drawn.
    """
    if not _tables:
        _tables.append(_quantiles())
    gamma, log_gamma = _tables[0]
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    sizes = np.diff(np.append(starts, len(owner)))
    base, odd = mixed(keys), np.flatnonzero(weights != 1)  # for a weight of 1 the level is 0
    log_w = np.log(weights[odd]).astype(np.float32)
    seeds = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = np.zeros((len(starts), count), np.uint64)
    for d in range(count):
        h = (base + seeds[2 * d]) * seeds[2 * d + 1]
        h ^= h >> np.uint64(32)
        r = gamma.take((h >> np.uint64(48)).view(np.int64), mode="wrap")
        beta = h.view(np.uint32)[_LOW::2].astype(np.float32) * np.float32(2.0**-32)
        a = log_gamma.take((h >> np.uint64(32) & np.uint64(0xFFFF)).view(np.int64), mode="wrap") - r * (1 - beta)
        levels = np.zeros(len(base), np.int64)
        if len(odd):
            levels[odd] = level = np.floor(log_w / r[odd] + beta[odd])
            a[odd] -= r[odd] * level
        least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), sizes))
        if len(least) > len(starts):  # of equals the first
            least = least[np.diff(owner[least], prepend=-1) > 0]
        out[:, d] = mixed(keys[least] ^ mixed(levels[least].view(np.uint64)))
    return out


def _signed(weights: Weights, bands: int, width: int):
    def run(batches):
        for batch, texts in text_chunks(batches, 1 << 18):
            keys, n, owner = shingles(texts)
            sizes = np.zeros(len(texts) + 1, np.int64)
            values = np.zeros(0, np.int64)
            if len(keys):
                drawn = samples(keys, weights(keys, n), owner, bands * width).reshape(-1, bands, width)
                h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(drawn), 1), np.uint64)
                for c in range(width):
                    h = mixed(h ^ drawn[:, :, c]) + np.uint64(c)
                values = np.ascontiguousarray(h).view(np.int64).ravel()
                sizes[1 + np.unique(owner)] = bands
            words = np.bincount(owner, n, len(texts)).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column("t"), batch.column("doc_id"), lists, pa.array(words)], names=["t", "doc_id", "bands", "words"]
            )

    return run


def _grouped(batches, keys: tuple[str, ...]):
    """Lists of rows that are next to each other and agree in the keys."""
    key, rows = None, []
    for batch in text_slices(batches):
        for row in batch.to_pylist():
            if (at := tuple(row[k] for k in keys)) != key:
                if rows:
                    yield rows
                key, rows = at, []
            rows.append(row)
    if rows:
        yield rows


def _pairs(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["c", "t"])


class Bags:
    """Weighted shingles of several texts, of which one at a time is compared with all."""

    def __init__(self, texts: list[str], weights: Weights):
        keys, n, self.owner = shingles(texts)
        self.w, self.size = weights(keys, n), len(texts)
        every, self.ids = np.unique(keys, return_inverse=True)
        self.total = np.bincount(self.owner, self.w, self.size)
        self.starts = np.searchsorted(self.owner, np.arange(self.size + 1))
        self.dense = np.zeros(len(every))

    def similar(self, a: int, least: float) -> np.ndarray:
        """Which texts have a weighted Jaccard similarity of `least` or more to text a."""
        own = slice(self.starts[a], self.starts[a + 1])
        self.dense[self.ids[own]] = self.w[own]
        common = np.bincount(self.owner, np.minimum(self.dense[self.ids], self.w), self.size)
        self.dense[self.ids[own]] = 0
        return common >= least * (self.total + self.total[a] - common)


def _star_cell(rows: list[dict], weights: Weights, least: float) -> list[tuple[bytes, bytes]]:
    """Links of the centre, which comes first, to the other texts of a cell."""
    near = Bags([r["text"] for r in rows], weights).similar(0, least)
    return [(rows[0]["t"], rows[k]["t"]) for k in np.flatnonzero(near) if k]


def _block_cell(rows: list[dict], weights: Weights, least: float) -> list[tuple[bytes, bytes]]:
    """Links between the texts of two blocks (or of one) that join what is apart yet in this cell."""
    rows = sorted(rows, key=lambda r: r["t"])
    bags, bands, block = Bags([r["text"] for r in rows], weights), np.array([r["bands"] for r in rows]), np.array([r["block"] for r in rows])
    band, low, high = (rows[0][k] for k in ("band", "low", "high"))
    label, out = np.arange(len(rows)), []
    for a in np.flatnonzero(block == low):
        use = block == high
        if low == high:
            use[: a + 1] = False
        use &= label != label[a]
        use &= np.minimum(bags.total, bags.total[a]) >= least * np.maximum(bags.total, bags.total[a])
        same = bands == bands[a]
        use &= bands[a][same.argmax(1)] == band  # a pair is judged in the first bucket it shares
        if not use.any():
            continue
        for b in np.flatnonzero(use & bags.similar(a, least)):
            if label[a] != label[b]:
                out.append((rows[a]["t"], rows[b]["t"]))
                label[label == label[b]] = label[a]
    return out


def components(links: DataFrame, shelf: Shelf) -> DataFrame:
    """t, label for the nodes of links(c, t): the least node of each connected component. Labels are halved in depth each turn."""
    both = shelf.save(links.select(F.col("c").alias("a"), F.col("t").alias("b")).union(links.select("t", "c")))
    labels = shelf.save(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("t"), F.least("a", "b").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("t", "b"), "b").groupBy(F.col("a").alias("t")).agg(F.min("label").alias("m"))
        new = shelf.save(labels.join(near, "t").select("t", F.col("label").alias("old"), F.least("label", "m").alias("label")))
        over = new.select(F.col("t").alias("label"), F.col("label").alias("top"))
        jumped = shelf.save(new.join(over, "label").select("t", "old", F.least("label", "top").alias("label")))
        shelf.drop(labels, new)
        labels = jumped
        if not labels.where("old <> label").limit(1).count():
            shelf.drop(both)
            return labels


def _dealt(column: str, rows: str, words: str, block: int | None = None):
    """Into how many blocks so many texts of so many words go."""
    return F.greatest(F.ceil(F.col(rows) / (block or BLOCK)), F.ceil(F.col(words) / WORDS), F.lit(1)).cast("int").alias(column)


def _star(live: DataFrame, there: DataFrame, weights: Weights, least: float, shelf: Shelf) -> DataFrame:
    """c, t: verified links between centres and the other texts of their buckets."""
    pairs = live.groupBy("centre", "t").agg(F.max("blocks").alias("blocks"))
    pairs = shelf.save(pairs.select("centre", F.pmod(F.xxhash64("t"), F.col("blocks")).alias("cell"), "t"))
    others = pairs.hint("merge").join(there, "t").select("centre", "cell", F.lit(1).alias("place"), "t", "text")
    # a centre's text goes to each of its cells once, not to each pair
    centres = pairs.select("centre", "cell").distinct().withColumn("t", F.col("centre"))
    centres = centres.hint("merge").join(there, "t").select("centre", "cell", F.lit(0).alias("place"), "t", "text")

    def run(batches):
        centre, rows, size = None, [], 0
        for batch in text_slices(batches):
            for row in batch.to_pylist():
                if not row["place"] or len(rows) > BLOCK or size > 8 * WORDS:
                    if len(rows) > 1:
                        yield _pairs(_star_cell(rows, weights, least))
                    centre = centre if row["place"] else row
                    rows, size = [centre] if row["place"] else [], 0
                rows.append(row)
                size += len(row["text"])
        if len(rows) > 1:
            yield _pairs(_star_cell(rows, weights, least))

    met = others.unionByName(centres).repartition("centre", "cell").sortWithinPartitions("centre", "cell", "place")
    out = shelf.save(met.mapInArrow(run, "c binary, t binary"))
    shelf.drop(pairs)
    return out


def _settled(live: DataFrame, linked: DataFrame, there: DataFrame, weights: Weights, least: float, shelf: Shelf) -> DataFrame:
    """c, t: links that join what is left apart in each bucket; all pairs are judged but those of two texts linked to its centre."""
    own = linked.select(F.col("c").alias("centre"), "t", F.lit(True).alias("own"))
    status = shelf.save(live.join(own, ["centre", "t"], "left").select("band", "t", "words", F.coalesce("own", F.lit(False)).alias("own")))
    apart = F.when(~F.col("own"), F.col("words"))
    sums = status.groupBy("band").agg(
        F.count(apart).alias("n"), F.coalesce(F.sum(apart), F.lit(0)).alias("nw"), F.count("*").alias("all"), F.sum("words").alias("all_words")
    )
    sums = sums.where("n > 0 and all > 1").withColumns({"m": F.col("all") - F.col("n"), "mw": F.col("all_words") - F.col("nw")})
    # a table of its own: so a hot bucket is split when it is joined
    sums = shelf.save(sums.select("band", _dealt("first", "n", "nw"), F.when(F.col("m") > 0, _dealt("x", "m", "mw")).otherwise(0).alias("more")))
    # unlinked texts are in the first blocks and meet all blocks; linked texts meet only those
    rows = status.join(sums, "band")
    h = F.xxhash64("t")
    rows = rows.withColumn(
        "block",
        F.when(
            F.col("own"), F.col("first") + F.try_mod(F.abs(h % 1_000_003).cast("int"), F.col("more"))
        ).otherwise(F.pmod(h, F.col("first")).cast("int")).cast("int")
    )
    last = F.when(F.col("own"), F.col("first")).otherwise(F.col("first") + F.col("more"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last - 1)))
    rows = shelf.save(rows.select("t", "band", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")))

    def run(batches):
        for cell in _grouped(batches, ("band", "low", "high")):
            if len(cell) > 1:
                yield _pairs(_block_cell(cell, weights, least))

    met = rows.hint("merge").join(there, "t").repartition("band", "low", "high").sortWithinPartitions("band", "low", "high")
    out = shelf.save(met.mapInArrow(run, "c binary, t binary"))
    shelf.drop(status, sums, rows)
    return out


def _digest(text: str = "text"):
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def _classes(docs: DataFrame, bands: int, width: int, least: float) -> tuple[int, DataFrame, DataFrame]:
    """How many rows there are; doc_id and digest t of each; of every digest: how many rows (n), its least doc_id (rep), bare
    (no words), label (its component), class_id, class_size and n_links."""
    shelf = Shelf(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), _digest().alias("t")
    )
    n_rows, *often = frequent(rows, shelf)
    weights = Weights(n_rows, *often)
    signed = shelf.save(rows.mapInArrow(_signed(weights, bands, width), "t binary, doc_id long, bands array<long>, words long"))
    texts = shelf.save(
        signed.groupBy("t").agg(
            F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("words").alias("words")
        )
    )
    buckets = texts.select("t", "words", F.explode("bands").alias("band"))
    # four orders take turns over the buckets, so that one text is the centre of many
    order = F.xxhash64("t", F.pmod("band", F.lit(4)))
    centres = buckets.groupBy("band").agg(F.max_by("t", order).alias("centre"), F.count("*").alias("n"), F.sum("words").alias("nw")).where("n > 1")
    centres = shelf.save(centres.select("band", "centre", _dealt("blocks", "n", "nw", STAR)))
    live = shelf.save(buckets.join(centres, "band").where("t <> centre"))
    nodes = live.select("t").union(live.select("centre")).distinct()
    # the same joins at every size: texts are never broadcast
    there = rows.groupBy("t").agg(F.first("text").alias("text")).join(nodes.hint("merge"), "t").join(texts.select("t", "bands"), "t")
    there = shelf.save(there)
    links = _star(live, there, weights, least, shelf)
    more = _settled(live, links, there, weights, least, shelf)
    every = shelf.save(links.union(more).select(F.least("c", "t").alias("c"), F.greatest("c", "t").alias("t")).distinct())
    labels = components(every, shelf)
    degree = every.select("c").union(every.select("t")).groupBy(F.col("c").alias("t")).agg(F.count("*").alias("n_links"))
    classes = labels.join(texts, "t").groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("n").alias("class_size"))
    linked = labels.join(classes, "label").join(degree, "t").select("t", "label", "class_id", "class_size", "n_links")
    each = texts.join(linked, "t", "left").select(
        "t",
        "rep",
        "n",
        (F.size("bands") == 0).alias("bare"),
        F.coalesce("label", "t").alias("label"),
        F.coalesce("class_id", "rep").alias("class_id"),
        F.coalesce("class_size", "n").alias("class_size"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    each = shelf.save(each)
    shelf.drop(texts, centres, live, there, links, more, every, labels)
    return n_rows, signed.select("doc_id", "t"), each


def near_duplicates(docs: DataFrame, bands: int = 16, width: int = 3, least: float = LEAST) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), class_size, n_links and class_key of every row of docs(doc_id, text).

    n_links counts the links of the row's text to other texts that were needed and verified. class_key tells classes apart
    where doc_id is null or repeats: it is the least digest of the class; rows without words, each alone in its class, have none.
    """
    n_rows, rows, each = _classes(docs, bands, width, least)
    # texts that are over a thousandth of all rows are under a thousand: these are broadcast, so that their rows stay where they are
    hot = F.broadcast(each.where(F.col("n") * 1000 > n_rows))
    out = rows.join(hot, "t").unionByName(rows.join(hot.select("t"), "t", "left_anti").join(each, "t"))
    bare = F.col("bare")
    return out.select(
        "doc_id", F.when(bare, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(bare, F.lit(1)).otherwise(F.col("class_size")).alias("class_size"), "n_links",
        F.when(~bare, F.lower(F.hex("label"))).alias("class_key")
    )


def one_of_each(docs: DataFrame, bands: int = 16, width: int = 3, least: float = LEAST) -> DataFrame:
    """Rows of docs, all columns: those without words, and of each class the row of least doc_id (one, if that repeats;
    one of null doc_id, if all are null). Unrelated texts of one doc_id, or of none, are classes of their own.

    Texts move once, to be joined with the digests that stay; rows of a digest are told apart by their least doc_id.
    """
    _, _, each = _classes(docs, bands, width, least)
    first = F.min(F.struct(F.col("rep").isNull(), "rep", "t"))
    keep = each.where("not bare").groupBy("label").agg(first.alias("first")).select(
        F.col("first.t").alias("__first"), F.col("first.rep").alias("__rep")
    )
    tagged = docs.withColumn("__t", _digest())
    bare = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__rep"))
    chosen = tagged.where(~bare).join(keep.hint("merge"), (F.col("__t") == F.col("__first")) & same).dropDuplicates(["__t"])
    return tagged.where(bare).select(*docs.columns).unionByName(chosen.select(*docs.columns))
