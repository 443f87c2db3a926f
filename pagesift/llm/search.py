"""Nearest-vector searches over binary codes by multi-index hashing.

A code is cut into segments, and each segment is an index of its own. By the pigeonhole principle, codes within a
Hamming radius agree with the query in some segment to within the radius shared out over the segments, so probing each
index at all values that near retrieves every such code.

`exact_top_k`: radii of the segments grow together until the k-th best verified distance is provably covered. Equal codes
are one code from the start, with their least ids; so are queries of equal codes.

`approximate_top_k`: codes are signs of learned rotated components (principal axes, then iterative quantisation, fitted
on a bounded sample of vectors); all codes within a radius, also fitted on the sample, are reranked by inner products.

Codes (or rows) are dealt into blocks by a hash, and so are the queries; each pair of blocks is a task's work, with an
index of its own, and gives the best of each query, of which the best over all blocks are kept. An index is probed by
address: a table holds for each value of a segment where its rows begin, and the values at a radius are the query's own
with so many bits flipped. Many queries are probed at once.

Vectors that are null, empty, zero or hold null or non-finite components take no part; repeated rows are one, and of
several vectors of a vec_id the least (by components in order) stands for it; a query meets only vectors of its own
dimension; ties go to the smaller vec_id; with fewer than k candidates all are returned. Only vec_id and embedding are read.
"""

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagesift.llm.common import saved

QUERIES, ROWS, CODES, PAIRS = 8192, 16_384, 1 << 19, 8


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and dim of the vectors that take part, one for each vec_id."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("embedding").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _blocks(n_queries: int, n_rows: int, size: int) -> tuple[int, int]:
    """Blocks of queries and of rows: of bounded size, rows in as few as may be, and pairs of blocks enough to share the work."""
    n_r = max(1, -(-n_rows // size))
    return max(1, -(-n_queries // QUERIES), -(-PAIRS // n_r)), n_r


def in_blocks(rows: DataFrame, every: int, k: int, search) -> DataFrame:
    """query_id, rank, vec_id and score: search(candidates, queries) in each pair of blocks, then the k best of each query."""
    n_q, n_r = _blocks(-(-(n := rows.select("vec_id").count()) // every), n, ROWS)
    candidates = rows.withColumn(
        "r", F.pmod(F.xxhash64("vec_id"), F.lit(n_r))
    ).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)).cast("array<bigint>")))
    queries = rows.where(F.col("vec_id") % every == 0).withColumn("q", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_q)))
    queries = queries.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n_r - 1)).cast("array<bigint>")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [
            (np.full(len(ids), q), ids, s) for q, ids,
            s in search(left.column("vec_id").to_numpy(), _matrix(left), right.column("vec_id").to_numpy(), _matrix(right))
        ] if len(left) and len(right) else []
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
            names=["query_id", "vec_id", "score"]
        )

    keys = ["q", "r", "dim"]
    best = candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    return _firsts(best, k, ["query_id"], F.desc("score"), "vec_id").select("query_id", "rank", "vec_id", "score")


def segments(bits: np.ndarray, width: int) -> np.ndarray:
    """Codes (rows of bits) as numbers of `width` bits, a column for each segment."""
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % width)))
    return (bits.reshape(len(bits), -1, width) @ (1 << np.arange(width))).astype(np.uint16)


@functools.lru_cache
def flips(width: int) -> list[np.ndarray]:
    """By radius: what turns an address of `width` bits into those at just this Hamming distance."""
    masks = np.arange(1 << width, dtype=np.uint16)
    return [masks[np.bitwise_count(masks) == radius] for radius in range(width + 1)]


def packed(values: np.ndarray) -> np.ndarray:
    """Codes in segments as rows of 64-bit words."""
    return np.ascontiguousarray(np.pad(values, ((0, 0), (0, -values.shape[1] % 4)))).view(np.uint64)


class Index:
    """Codes in a table for each segment: the rows in order of its values, and for each address where its rows begin."""

    def __init__(self, values: np.ndarray, width: int):
        self.values, self.width, self.n = values, width, values.shape[1]
        self.order = [np.argsort(values[:, s], kind="stable").astype(np.int32) for s in range(self.n)]
        self.starts = [np.append(0, np.cumsum(np.bincount(values[:, s], minlength=1 << width))).astype(np.int32) for s in range(self.n)]
        whole = packed(values)
        self.codes = [whole[order] for order in self.order]  # in order of each segment, so that an address's codes lie side by side

    def at(self, queries: np.ndarray, radius: int, upto: int | None = None, bound: np.ndarray | None = None):
        """Which query, row and whole distance of all codes found by probing the first `upto` segments (all) at this radius,
        of those alone that are no farther than the query's bound.

        A code is found where its nearest segment is, once: nearer ones were found at smaller radii.
        """
        masks, found, wanted = flips(self.width)[radius], [], packed(queries)
        # about as many codes at once as a processor's cache holds
        for a in range(0, len(queries), step := max(1, (1 << 16) // (len(masks) * max(1, len(self.values) >> self.width)))):
            part = queries[a : a + step]
            for s in range(self.n if upto is None else upto):
                address = (part[:, s, None] ^ masks).ravel()
                low = self.starts[s][address]
                n = self.starts[s][1:][address] - low
                each = n.reshape(len(part), -1).sum(1)
                place = np.repeat(low - np.cumsum(n, dtype=np.int32) + n, n)
                place += np.arange(len(place), dtype=np.int32)
                far = np.bitwise_count(self.codes[s][place] ^ np.repeat(wanted[a : a + step], each, axis=0))
                far = far[:, 0] if far.shape[1] == 1 else far.sum(1, dtype=np.int32)
                who = np.repeat(np.arange(a, a + len(part), dtype=np.int32), each)
                if bound is not None:
                    near = np.flatnonzero(far <= bound[who])
                    who, place, far = who[near], place[near], far[near]
                rows = self.order[s][place]
                apart = np.bitwise_count(self.values[rows] ^ queries[who])
                new = (apart >= radius).all(1) & ~(apart[:, :s] == radius).any(1)
                found.append((who[new].astype(np.int64), rows[new], far[new].astype(np.int64)))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def within(self, queries: np.ndarray, radius: int, bound: np.ndarray | None = None):
        """Which query, row and distance of all codes (within the bound) that probing retrieves for whole distances up to the radius.

        Within the radius some segment is within a share of it: `least`, or one less for the segments past `extra`.
        """
        least, extra = divmod(radius, self.n)
        parts = [self.at(queries, r, bound=bound) for r in range(min(least, self.width + 1))]
        if least <= self.width:
            parts.append(self.at(queries, least, extra + 1, bound))
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))

    def nearest(self, queries: np.ndarray, k: int, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """Which query, distance and id of the k nearest ids: of the code in row i, ids[starts[i]] and the next, sizes[i] in all.

        Radii grow together until the k-th verified distance is covered: codes not found yet differ by more than the
        radius in every segment.
        """
        who, far, best = (np.zeros(0, np.int64) for _ in range(3))
        active, bound = np.arange(len(queries)), np.full(len(queries), 1 << 30)  # distance of the k-th so far
        for radius in range(self.width + 1):
            if not len(active):
                break
            q, rows, d = self.at(queries[active], radius, bound=bound[active])
            q = active[q]
            n = sizes[rows]
            each = np.repeat(starts[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
            who, far, best = np.append(who, np.repeat(q, n)), np.append(far, np.repeat(d, n)), np.append(best, ids[each])
            order = np.lexsort((best, far, who))
            who, far, best = who[order], far[order], best[order]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            last = place == k - 1
            bound[who[last]] = far[last]
            who, far, best = who[place < k], far[place < k], best[place < k]
            active = active[bound[active] >= self.n * (radius + 1)]
        return who, far, best


def _best(ids: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, keys))[:k]


def _firsts(rows: DataFrame, n: int, by: list[str], *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def exact_top_k(vectors: DataFrame, every: int = 100, k: int = 10, width: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and distance: the k rows nearest by Hamming distance of sign codes (component > 0) to each
    row whose id is divisible by `every`, exactly. Segments have `width` bits: by default about log2 of the rows in a block,
    4 at least and 16 at most."""
    if width is None:
        n = vectors.count()
        width = int(np.clip(round(np.log2(max(1, n / _blocks(1, n, CODES)[1]))), 4, 16))

    def coded(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for dim in np.unique(table.column("dim").to_numpy()):
                part = table.filter(pc.equal(table.column("dim"), int(dim)))
                code = segments(_matrix(part) > 0, width).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(code) + 1) * code.shape[1], pa.int32()), pa.array(code.ravel()))
                columns = [part.column("vec_id").combine_chunks(), part.column("dim").combine_chunks(), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "dim", "code"])

    rows = saved(usable(vectors).mapInArrow(coded, "vec_id long, dim int, code array<int>"))
    of, key = ["dim", "code"], ["dim", "query"]
    # more ids of one code than a result can hold never matter
    codes = saved(_firsts(rows, k + 1, of, "vec_id").groupBy(*of).agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    asked = rows.where(F.col("vec_id") % every == 0).select("dim", F.col("code").alias("query"), F.col("vec_id").alias("query_id"))
    n_q, n_r = _blocks(asked.count(), codes.count(), CODES)
    deal = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n))
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    left = codes.withColumn("r", deal("code", n_r)).withColumn("q", every_one(n_q))
    right = asked.select(*key).distinct().withColumn("q", deal("query", n_q)).withColumn("r", every_one(n_r))

    def numbers(column: pa.ChunkedArray) -> np.ndarray:
        column = column.combine_chunks()
        return column.flatten().to_numpy().reshape(len(column), -1).astype(np.uint16)

    def run(codes: pa.Table, queries: pa.Table) -> pa.Table:
        out = [pa.nulls(0, t) for t in kinds]
        if len(codes) and len(queries):
            lists = codes.column("ids").combine_chunks()
            ids, sizes, wanted = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()), numbers(queries.column("query"))
            who, far, best = Index(numbers(codes.column("code")), width).nearest(wanted, k + 1, ids, np.cumsum(sizes) - sizes, sizes)
            own = queries.column("query").combine_chunks().take(pa.array(who))
            out = [pa.array(np.full(len(who), queries.column("dim")[0].as_py()), pa.int32()), own, pa.array(far, pa.int32()), pa.array(best, pa.int64())]
        return pa.table(out, names=[*key, "distance", "vec_id"])

    kinds = (pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int64())
    met = left.groupBy("q", "r", "dim").cogroup(right.groupBy("q", "r", "dim"))
    best = _firsts(met.applyInArrow(run, "dim int, query array<int>, distance int, vec_id long"), k + 1, key, "distance", "vec_id").drop("rank")
    out = _firsts(asked.join(best, key).where("query_id <> vec_id"), k, ["query_id"], "distance", "vec_id")
    return out.select("query_id", "rank", "vec_id", F.col("distance").cast("long").alias("distance"))


class Codes:
    """Signs of rotated components of vectors of one dimension, fitted on a sample, and the radius that holds enough of
    each one's k nearest in it. `more` further rotations give longer codes with a radius (`reach`) of their own, which sift
    what the first code finds: it loses `lost` of the nearest."""

    def __init__(self, sample: np.ndarray, k: int, recall: float, turns: int = 30, more: int = 3, lost: float = 0.015):
        self.mean = sample.mean(0)
        centred = sample - self.mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        projected = centred @ axes[:, ::-1]
        rotations = []
        for seed in range(7, 8 + more):
            turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(sample.shape[1],) * 2))[0]
            for _ in range(turns):
                u, _, v = np.linalg.svd(np.sign(projected @ turn).T @ projected)
                turn = (u @ v).T
            rotations.append(axes[:, ::-1] @ turn)
        self.rotation, self.rotations = rotations[0], np.concatenate(rotations, axis=1)
        bits, long = self.bits(sample), self.long(sample)
        packed = np.packbits(bits, axis=1)
        distances, far = [], []
        for i in range(0, len(sample), max(1, len(sample) // 500)):
            near = sample @ sample[i]
            near[i] = -np.inf
            top = np.argpartition(-near, min(k, len(sample) - 1) - 1)[:k] if len(sample) > 1 else []
            distances.append(np.bitwise_count(packed[top] ^ packed[i]).sum(1))
            far.append(np.bitwise_count(long[top] ^ long[i]).sum(1))
        self.radius = int(np.quantile(np.concatenate(distances), recall, method="higher")) if len(sample) > 1 else sample.shape[1]
        self.reach = int(np.quantile(np.concatenate(far), 1 - lost, method="higher")) if len(sample) > 1 else self.rotations.shape[1]

    def long(self, rows: np.ndarray) -> np.ndarray:
        """The longer codes, as rows of bytes."""
        return np.packbits((rows - self.mean) @ self.rotations > 0, axis=1)

    def bits(self, rows: np.ndarray) -> np.ndarray:
        return (rows - self.mean) @ self.rotation > 0


def approximate_top_k(vectors: DataFrame, every: int = 20, k: int = 20, sample: int = 5000, recall: float = 0.92, width: int = 16) -> DataFrame:
    """query_id, rank, vec_id and score: of each row whose id is divisible by `every`, the k rows with the largest inner
    product among those whose codes, the longer ones too, are near. Rotations and radii come from about `sample` vectors of each dimension, one
    dimension after the other; the radius is wide enough for `recall` of the nearest ones in the sample."""
    rows = saved(usable(vectors))
    sizes = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    chance = F.pmod(F.xxhash64("vec_id", F.lit(61)), F.lit(1 << 20)) / float(1 << 20)
    codes = {}
    for dim, n in sorted(sizes.items()):
        part = rows.where((F.col("dim") == dim) & (chance < min(1.0, sample / n))).orderBy("vec_id").select("embedding").toArrow()
        codes[dim] = Codes(_matrix(part) if len(part) else np.zeros((1, dim)), k, recall)

    def search(ids, rows, query_ids, queries):
        model = codes[rows.shape[1]]
        index, long = Index(segments(model.bits(rows), width), width), model.long(rows)
        for a in range(0, len(query_ids), 16):
            part, wanted = query_ids[a : a + 16], segments(model.bits(queries[a : a + 16]), width)
            left, radius, reach, asked = np.arange(len(part)), model.radius, model.reach, model.long(queries[a : a + 16])
            while len(left):  # wider only where a block holds too few
                who, found, _ = index.within(wanted[left], radius, np.full(len(left), radius))
                who = left[who]
                near = ids[found] != part[who]
                who, found = who[near], found[near]
                near = np.bitwise_count(long[found] ^ asked[who]).sum(1) <= reach
                who, found = who[near], found[near]
                short = []
                for i in left.tolist():
                    own = found[who == i]
                    if len(own) < min(k, int((ids != part[i]).sum())) and (radius < index.n * width or reach < 8 * long.shape[1]):
                        short.append(i)
                        continue
                    scores = (rows[own] * queries[a + i]).sum(1)
                    best = _best(ids[own], -scores, k)
                    yield part[i], ids[own[best]], scores[best]
                left, radius, reach = np.array(short, np.int64), radius + index.n, reach + len(model.rotations)

    return in_blocks(rows, every, k, search)
