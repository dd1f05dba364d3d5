"""What the training-data operators share: the scratch folder, text batches, hashing of words.

Every operator takes whole texts as bytes. A null text counts as empty. Rows travel as Arrow
batches, so a Python worker never holds more than one batch besides its own bounded tables.
"""

from __future__ import annotations

import ctypes
import gc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.scratch import scratch_uri


def materialise(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors."""
    uri = scratch_uri(spark, name)
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(key: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as remainder -1."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % F.lit(m), F.lit(-1))


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's UTF-8 bytes; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def _halves(batch, size: int):
    if batch.num_rows < 2 or batch.nbytes <= size:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from _halves(batch.slice(0, half), size)
        yield from _halves(batch.slice(half), size)


def slices(batches, rows: int = 512, size: int = 1 << 24):
    """The batches in slices of a few rows and bytes (no copy), so that what a worker makes of one stays small; a row is
    never split."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield from _halves(batch.slice(at, rows), size)


def map_rows(df: DataFrame, fn, schema) -> DataFrame:
    """mapInArrow; fn takes one batch and gives one batch or None."""

    def run(batches):
        for batch in slices(batches):
            if (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


_HELD: dict = {}


def held(key, make=bool):
    """What this worker process holds for ``key``, made on first use. Workers serve one operator after the other, and Spark deals tasks to all of
    an executor's workers in turn, so each holds one such thing: that of another operator goes first, and its memory goes back to the system."""
    if key not in _HELD:
        _HELD.clear()
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Give freed memory back: the allocators keep it otherwise, for as long as the worker lives."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def lower_ascii(raw: bytes) -> bytes:
    return raw.lower()


def unsigned_crc(data) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


# --- word hashing on byte buffers ------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MASK = (1 << 64) - 1
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Values of the 256 bytes, spread over 64 bits by a fixed rule.
BYTE_VALUE = np.array([(pow(i + 3, 5) * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D * (i + 1)) & _MASK for i in range(256)], np.uint64)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class PowerTable:
    """Powers of the hash base and of its inverse, grown to the longest buffer met."""

    def __init__(self):
        self.up = self.down = powers(_BASE, 1)

    def get(self, n: int):
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = powers(_BASE, size), powers(_INVERSE, size)
        return self.up, self.down


_POWERS = PowerTable()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(H, D): the hash of buffer[i:j] is (H[j] - H[i]) * D[i], whatever its place."""
    up, down = _POWERS.get(len(buffer) + 1)
    out = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[buffer] * up[: len(buffer)], out=out[1:])
    return out, down


#: Bytes that part words: the ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space."""
    inside = np.concatenate(([False], ~SPACE[buffer], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def hash_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows, chosen by the hash of an id and the same in every run; all if there are fewer."""
    n = rows.count()
    if n <= bound:
        return rows
    steps = 1 << 20
    return rows.filter(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(steps)) < F.lit(int(steps * bound / n)))


class WordMemory:
    """Rows of a table for words: known ones from a dict, others by ``make`` and then remembered.

    At most ``limit`` words are remembered; then the made ones are forgotten, which changes no result.
    """

    def __init__(self, known: dict, table: np.ndarray, make, limit: int = 300_000):
        self.known, self.fixed, self.make, self.limit = known, len(table), make, limit
        self.table = np.zeros((len(table) + limit + 65536, *table.shape[1:]), np.float32)
        self.table[: len(table)] = table
        self.made: dict = {}

    def rows(self, words: list) -> np.ndarray:
        """The words' row numbers, valid until the next call."""
        if len(self.made) > self.limit:
            self.made.clear()
        known, made = self.known, self.made
        out = [known.get(w, -1) for w in words] if known else [-1] * len(words)
        if -1 in out:
            new = [w for w in dict.fromkeys(w for w, i in zip(words, out) if i < 0) if w not in made]
            for at in range(0, len(new), 65536):
                part = new[at : at + 65536]
                if self.fixed + len(made) + len(part) > len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                first = self.fixed + len(made)
                self.table[first : first + len(part)] = self.make(part)
                made.update(zip(part, range(first, first + len(part))))
            out = [i if i >= 0 else made[w] for w, i in zip(words, out)]
        return np.array(out, np.int64)


#: A key is hot if it has more rows than the first, and more than one in the second of all rows.
LEAST_HOT, MOST_HOT = 256, 100_000


def hot_limit(rows: int) -> int:
    """The most rows of one key that go to one task, for a table of so many rows; at most MOST_HOT keys have more."""
    return max(LEAST_HOT, rows // MOST_HOT)


def deal_join(big: DataFrame, small: DataFrame, key, rows: int, count: str) -> DataFrame:
    """``big`` joined with ``small``, whose column ``count`` tells how many of the about ``rows`` rows of ``big`` have the key.

    Hot keys stay where they are and meet a broadcast of at most MOST_HOT keys; the others are shuffled, so no task gets more than
    hot_limit rows of one key. ``small`` is read three times: a written table.
    """
    keys = [key] if isinstance(key, str) else key
    hot, cold = small.filter(F.col(count) > hot_limit(rows)), small.filter(F.col(count) <= hot_limit(rows))
    if hot.isEmpty():
        return big.join(small, keys)
    rest = big.join(F.broadcast(hot.select(*keys).distinct()), keys, "left_anti")
    return big.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))


def frequent(df: DataFrame, most: int) -> DataFrame:
    """The rows with the greatest n_all, at most ``most``: by a histogram of at most 512 steps, so ties stay out together."""
    step = F.floor(F.log2("n_all") * 8)
    least, kept = 1 << 62, 0
    for r in sorted(df.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):
        kept += r["count"]
        if kept > most:
            break
        least = r.step
    return df.filter(step >= F.lit(least))


def even_join(spark: SparkSession, big: DataFrame, small: DataFrame, key: str, rows: int, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``, which has one row a key, where the counts are not known: as deal_join, with the hot keys counted here."""
    hot = materialise(spark, big.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_limit(rows)).select(key), "hot")  # at most MOST_HOT
    if hot.isEmpty():
        return big.join(small, key, how)
    hot = F.broadcast(hot)
    often = big.join(hot, key, "left_semi").join(F.broadcast(small.join(hot, key, "left_semi")), key, how)
    return often.unionByName(big.join(hot, key, "left_anti").join(small, key, how))
