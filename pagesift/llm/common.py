"""Shared small helpers of the training-data operators: tables, scratch storage, text batches, word hashes."""

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions.batches import parts

#: A word, everywhere in this subpackage unless said otherwise: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MASK = (1 << 64) - 1
_BYTE_BASE, _WORD_BASE, _WORD_BASE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder of the cluster (spark.checkpoint.dir); in the warehouse only where that is unset.

    A warehouse on a local disk will do for a single machine alone.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/pagesift-scratch"
        if root.startswith(("file:", "/")) and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str | None = None) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: it cuts lineage and survives lost executors."""
    path = path or scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Shelf:
    """Tables of one operator in a folder of their own; those that no result reads any more are taken down."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n, self.paths = spark, scratch(spark), 0, {}

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        out = saved(df, path := f"{self.root}/{self.n}")
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _, path = self.paths.pop(id(table))
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def row_key(df: DataFrame) -> DataFrame:
    """df (doc_id, text) with a 96-bit key k1, k2 of the row. Repeated rows share it, and so every result drawn by it."""
    return df.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.hash("text", "doc_id")})


def text_slices(batches, limit: int = 1 << 20):
    """Arrow batches (with a column text) in slices of about `limit` bytes; what Arrow keeps of batches gone by is given back."""
    for batch in batches:
        for start, n in parts(batch.column("text"), limit):
            yield batch.slice(start, n)
        pa.default_memory_pool().release_unused()


def text_chunks(batches, limit: int = 1 << 20):
    """Arrow batches (with a column text) as (batch slice, list of str) of about `limit` bytes; null texts are empty."""
    for batch in text_slices(batches, limit):
        yield batch, [t or "" for t in batch.column("text").to_pylist()]


#: By base, the powers that a worker keeps, in steps of 2**18; more than 2**21 are made anew each time.
_kept: dict = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.ones(n + 1, np.uint64)
        p[1:] = np.uint64(b)
        out.append(np.cumprod(p))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n at least."""
    if n > 1 << 21:
        return _powers(base, n)
    if base not in _kept or len(_kept[base][0]) <= n:
        _kept[base] = _powers(base, max(1 << 18, -(-n >> 18 << 18)) if n > 1 << 14 else 1 << 14)
    return _kept[base]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_places(texts: list[bytes], gaps: np.ndarray = _SPACE) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts with a blank around each, starts and ends of their words (runs of bytes that aren't gaps), and how many each text has."""
    raw = b" ".join([b"", *texts, b""])
    flips = np.flatnonzero(np.diff(gaps[np.frombuffer(raw, np.uint8)])) + 1
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)]) + 1
    return raw, flips[::2], flips[1::2], np.diff(np.searchsorted(flips[::2], bounds))


def hashed(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at these places."""
    buf = np.frombuffer(raw, np.uint8)
    p, inv = powers(_BYTE_BASE, len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[: len(buf)], out=total[1:])
    return mixed((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * np.uint64(_WORD_BASE))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and how many words each text has."""
    raw, starts, ends, counts = word_places(texts)
    return hashed(raw, starts, ends), counts


def window_hashes(words: np.ndarray, n: int, second: bool = False) -> np.ndarray:
    """Hashes of each n consecutive words (windows may cross texts: the caller masks those)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    p, inv = powers(_WORD_BASE2 if second else _WORD_BASE, len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * p[: len(words)], out=total[1:])
    return mixed((total[n:] - total[:-n]) * inv[: len(words) - n + 1])


def arrow(schema: str, spark: SparkSession) -> pa.Schema:
    """The Arrow schema of a DDL string, for use inside tasks."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
