"""Packing documents into training sequences: variable-capacity best fit.

Several sequence lengths are permitted. Documents, each with an end token, are cut into pieces of the greatest length at
most. Pieces are dealt by hash to shards of about ``SHARD`` pieces, and each shard is packed on its own: longest first, a
piece goes where the least room is left over; where it fits nowhere a new bin is opened, of the length with the
least cost per token that the bin can expect to hold (the piece and as much of the remaining pieces as would fit).
Finally every bin is downsized to the least permitted length that holds its contents, and room for several is spent
jointly: a bin's length is settled only then. Only ids and lengths are shuffled.

``SHARD`` trades nothing but the few part-filled bins a shard ends with; no piece is left out.

Defined cases: null text is empty text (a piece of one end token); null ids are packed like others; repeated rows are
packed as often as they occur (``copy`` numbers them); a text longer than the greatest length gives full
pieces and a rest; ties go by id, piece and copy; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, raw_texts, slices
from .sstable import default_tokenizer, encoder_of

CAPACITIES, OVERHEAD, SHARD, STRETCH = (512, 1024, 2048, 4096, 8192), 32, 5000, 1000
SCHEMA = "bin_id long, capacity int, used int, doc_id long, copy int, piece int, start long, length int, bin_offset int"


@dataclass
class Bin:
    capacity: int
    used: int
    members: list


def cost(capacity: int, overhead: int = OVERHEAD) -> int:
    """What a bin costs: its padded length and a fixed part."""
    return capacity + overhead


def pack(lengths: list[int], capacities: tuple = CAPACITIES, overhead: int = OVERHEAD) -> list[Bin]:
    """Bins with the indexes of their pieces. ``lengths`` must be in descending order."""
    capacities = sorted(capacities)
    behind = np.concatenate((np.cumsum(lengths[::-1])[::-1], [0])) if lengths else np.zeros(1)
    ascending = [-x for x in lengths]
    bins: list[Bin] = []
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    for i, n in enumerate(lengths):
        at = bisect.bisect_left(room, (n, -1))
        if at < len(room):
            left, b = room.pop(at)
            bins[b].members.append(i)
            bins[b].used += n
            if left > n:
                bisect.insort(room, (left - n, b))
            continue
        fits = [c for c in capacities if c >= n]
        if not fits:
            raise ValueError(f"a piece of {n} is longer than {capacities[-1]}")

        def per_token(c):
            rest = behind[max(i + 1, bisect.bisect_left(ascending, n - c))]
            return cost(c, overhead) / min(c, n + rest), c

        c = min(fits, key=per_token)
        bins.append(Bin(c, n, [i]))
        if c > n:
            bisect.insort(room, (c - n, len(bins) - 1))
    for b in bins:  # downsize
        b.capacity = next(c for c in capacities if c >= b.used)
    return bins


def token_lengths(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) with the end token, by the tokenizers library."""
    path = tokenizer_path or default_tokenizer()

    def run(batches):
        encoder = encoder_of(path)
        width = len(encoder.pack([1]))
        for batch in slices(batches):
            if batch.num_rows:
                n = [len(x) // width + 1 for x in encoder.encode_batch(raw_texts(batch))]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("text", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, n_tokens long")


def pack_documents(spark: SparkSession, docs: DataFrame, capacities: tuple = CAPACITIES, overhead: int = OVERHEAD, shard: int = SHARD, tokenizer_path: str | None = None) -> DataFrame:
    """The segments of all bins: which part of which document lies where."""
    most = max(capacities)
    counted = token_lengths(docs, tokenizer_path).groupBy("doc_id", "n_tokens").agg(F.count("*").alias("copies"))
    counted = materialise(spark, counted, "lengths")
    # Copies are made in stretches, dealt out first: a row that occurs very often is not unfolded in one task.
    stretches = counted.withColumn("stretch", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / STRETCH).cast("int")))).repartition("doc_id", "n_tokens", "stretch")
    least = F.col("stretch") * STRETCH
    pieces = (
        stretches.withColumn("copy", F.explode(F.sequence(least, F.least(least + STRETCH, F.col("copies")).cast("int") - 1)))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / most).cast("int"))))
        .withColumn("start", F.col("piece").cast("long") * most)
        .withColumn("length", F.least(F.lit(most), F.col("n_tokens") - F.col("start")).cast("int"))
        .select("doc_id", "copy", "piece", "start", "length")
    )
    n = counted.agg(F.sum(F.col("copies") * F.ceil(F.col("n_tokens") / most))).first()[0] or 0
    shards = max(1, -(-n // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(shards)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("copy", "ascending")])
        number = table.column("shard")[0].as_py() << 32
        rows = {name: table.column(name).to_pylist() for name in ("doc_id", "copy", "piece", "start", "length")}
        out: list = [[] for _ in range(9)]
        for k, b in enumerate(pack(rows["length"], capacities, overhead)):
            offset = 0
            for i in b.members:
                for column, value in zip(out, (number + k, b.capacity, b.used, rows["doc_id"][i], rows["copy"][i], rows["piece"][i], rows["start"][i], rows["length"][i], offset)):
                    column.append(value)
                offset += rows["length"][i]
        i32, i64 = pa.int32(), pa.int64()
        return pa.table([pa.array(c, t) for c, t in zip(out, (i64, i32, i32, i64, i32, i32, i64, i32, i32))], [x.split()[0] for x in SCHEMA.split(", ")])

    return dealt.groupBy("shard").applyInArrow(run, SCHEMA)
