"""Near duplicates: ProbMinHash over weighted word shingles, banding, exact verification, classes.

Words are runs of ASCII letters and digits (A-Z in lower case) and bytes beyond ASCII. The elements of a
text are its shingles of five words (one shingle of all its words if it has fewer), weighted by how
often they occur. ProbMinHash draws for each element the arrivals of a Poisson process of its weight's rate,
each on a random component; a component keeps the element that arrives first. Arrivals later than the latest kept
one cannot matter, so elements stop early. Two texts agree on a component with the probability Jaccard
similarity of their weights, J_P, which is the plain one for equal weights. 125 components make 25 bands of 5: at a
similarity of 0.8 a pair shares no band with probability 5e-5. A text with repeated shingles has 25 more, of its shingles
with weight 1 (the plain MinHash, which is the same for a text without repeats), so that holds for either similarity.

Exact copies fold into one representative first, by a sum before the shuffle, so a large group of copies costs
one row. Pairs of a bucket are not all made, but two members of a bucket are either compared or already in one class. A
text's weight is the number of texts that it shares buckets with; the heaviest member of a bucket, the hub, is the one
that most others were made from. First every text is verified against the heaviest hub of its buckets. Then, in each bucket whose members still
lie in several classes, those outside the largest one meet all others in the task, in cells of a bounded size. A cell hands on no pairs, only those of
its texts that may be alike to one of another class; these come again with their shingles, and the task verifies
them pair by pair, the likeliest first, passes over what has become one class by then, and gives the links that joined two classes: fewer than it has
texts. So no row is made for a pair, however large a group is, and none is left out. Only a bucket of more than
``PAIRS`` such pairs goes by a prefix filter instead, which is exact as well: in one order of all
shingles, rare ones first, the first shingle that two texts of similarity 0.8 have in common lies within the first fifth of either, and
the shares behind it bound their similarity. All that is linked was
verified on the whole shingle sets (set or probability Jaccard of at least 0.8), after a bound that is exact as well: the parities of
a text's shingles in ``PARITIES`` cells (more for more than as many shingles) differ in no more cells than the texts in shingles. Links join into classes by
spreading least labels with pointer jumping, in Spark.

Most texts share no bucket. What is sent for a join is filtered first by the keys that it will meet (``Filter``, a Bloom filter; the join stays, so
results do not depend on it): members by the shared buckets, bands by the copied texts, shingles by the hubs or the texts of a cell. So the shuffle does
not depend on which tables are small enough to be broadcast.

No key is joined in one task if it is frequent: a digest, bucket or shingle with more rows than ``LEAST_HOT`` and than one in ``MOST_HOT``
of all is broadcast (at most ``MOST_HOT`` of these) or salted. What the driver sees are counts, and the ``FREQUENT`` most frequent shingles of the last step.

Result: a row a document with its class id, the least document id of the class.
Defined cases: null text is empty text; texts without words are alike only if equal; null ids form classes
like others, a class with null ids only has a null class id; repeated rows return as often as they occur, and one row of a class
is ``kept``; ties between ids go to one row; a very long text is one set of shingles, alone in its batch; an empty table gives no
rows; other columns are not read (``one_of_each`` keeps them, whatever their names).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import deal_join, even_join, frequent, held, hot_limit, materialise, mix64, prefix_hash, raw_texts, slices

SHINGLE, BANDS, ROWS, LEAST = 5, 25, 5, 0.8
COMPONENTS = BANDS * ROWS
#: The most shingles whose frequency is sent.
FREQUENT = 1 << 20
#: Cells of the parity bound (most for a long text), and likeliest partners of a text that are verified before all others.
PARITIES, MOST_PARITIES, NEAREST = 1024, 1 << 16, 4
#: Bytes of shingles beyond which a cell is dealt further.
CELL_BYTES = 1 << 25
#: The most pairs of a bucket that are tried one by one (half a microsecond each).
PAIRS = 1 << 28
#: Bits of a filter that spares a shuffle most rows: 32 a key or more between these bounds; when full it lets more through.
FILTER_BITS, MOST_FILTER_BITS = 1 << 16, 1 << 27

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
_STEP = np.array([pow(0xA0761D6478BD642F, k + 1, 1 << 64) for k in range(SHINGLE)], np.uint64)
_STREAM = mix64(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word; a word's hash does not depend on its place."""
    buffer = np.frombuffer(data, np.uint8)
    inside = np.concatenate(([False], WORD[buffer], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[0::2], edges[1::2]
    sums, down = prefix_hash(buffer)
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), start


def shingle_sets(raws: list[bytes], piece: int = 1 << 18) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingle hashes in ascending order and their counts."""
    out, at = [], 0
    while at < len(raws):
        end, size = at, 0
        while end < len(raws) and (end == at or size + len(raws[end]) < piece):
            size += len(raws[end]) + 1
            end += 1
        words, start = _word_hashes(b"\n".join(raws[at:end]).lower())
        ends = np.cumsum([len(r) + 1 for r in raws[at:end]])
        stop = np.searchsorted(start, ends)
        sums = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            sums += words[k : k + len(sums)] * _STEP[k]
        sums, first = mix64(sums), 0
        for last in stop.tolist():
            n = last - first
            if n >= SHINGLE:
                out.append(np.unique(sums[first : last - SHINGLE + 1], return_counts=True))
            elif n:
                out.append((mix64((words[first:last] * _STEP[:n]).sum(keepdims=True, dtype=np.uint64)), np.ones(1, np.int64)))
            else:
                out.append((np.empty(0, np.uint64), np.empty(0, np.int64)))
            first = last
        at = end
    return out


def shingles(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    return shingle_sets([raw])[0]


def prob_minhash_many(sets: list[tuple[np.ndarray, np.ndarray]], m: int = COMPONENTS, piece: int = 1 << 16) -> np.ndarray:
    """prob_minhash of many weighted sets, one arrival of every live element a round."""
    out = np.zeros((len(sets), m), np.uint64)
    large = []
    for i, (e, w) in enumerate(sets):
        if len(e) >= m:
            large.append(i)
        elif len(e):
            out[i] = prob_minhash(e, w, m)
    at = 0
    while at < len(large):
        end, size = at, 0
        while end < len(large) and (end == at or size + len(sets[large[end]][0]) < piece):
            size += len(sets[large[end]][0])
            end += 1
        group = large[at:end]
        live = np.concatenate([sets[i][0] for i in group])
        rate = np.concatenate([sets[i][1] for i in group]).astype(float)
        base = np.repeat(np.arange(len(group)) * m, [len(sets[i][0]) for i in group])
        time, turn = np.zeros(len(live)), 0
        first, kept = np.full(len(group) * m, np.inf), np.zeros(len(group) * m, np.uint64)
        while len(live):
            bits = mix64(live + (_STREAM[turn % len(_STREAM)] + np.uint64(turn // len(_STREAM))))
            turn += 1
            time -= np.log(((bits >> np.uint64(24)).astype(float) + 0.5) * 2.0**-40) / rate
            if turn > 1:
                go = time < first.reshape(-1, m).max(1)[base // m]
                live, rate, base, time, bits = live[go], rate[go], base[go], time[go], bits[go]
            slot = base + ((bits & np.uint64(0xFFFFFF)) % np.uint64(m)).astype(np.int64)
            np.minimum.at(first, slot, time)
            won = time == first[slot]
            kept[slot[won]] = live[won]
        out[group] = kept.reshape(-1, m)
        at = end
    return out


def prob_minhash(elements: np.ndarray, weights: np.ndarray, m: int = COMPONENTS) -> np.ndarray:
    """The element that arrives first on each of m components."""
    first, kept = np.full(m, np.inf), np.zeros(m, np.uint64)
    time, live, rate, drawn = np.zeros(len(elements)), elements, weights.astype(float), 0
    while len(live):
        step = min(64, max(1, -(-8 * m // len(live))))  # many arrivals at once where elements are few
        salt = _STREAM[np.arange(drawn, drawn + step) % len(_STREAM)] + np.uint64(drawn // len(_STREAM))
        bits = mix64(live[:, None] + salt[None, :])
        gaps = -np.log(((bits >> np.uint64(24)).astype(float) + 0.5) * 2.0**-40) / rate[:, None]
        at = time[:, None] + np.cumsum(gaps, 1)
        drawn += step
        latest = first.max()
        r, c = np.nonzero(at < latest) if np.isfinite(latest) else np.divmod(np.arange(at.size), step)
        t, slot = at[r, c], ((bits[r, c] & np.uint64(0xFFFFFF)) % np.uint64(m)).astype(np.int64)
        order = np.argsort(-t, kind="stable")  # the earliest is written last
        t, slot, r = t[order], slot[order], r[order]
        best, who = np.full(m, np.inf), np.zeros(m, np.uint64)
        best[slot], who[slot] = t, live[r]
        better = best < first
        first[better], kept[better] = best[better], who[better]
        go = at[:, -1] < first.max()
        time, live, rate = at[go, -1], live[go], rate[go]
    return kept


def band_hashes(kept: np.ndarray) -> np.ndarray:
    rows = kept.reshape(BANDS, ROWS)
    return mix64((rows * _STEP[None, :ROWS]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def all_bands(sets: list[tuple[np.ndarray, np.ndarray]]) -> list[list[int]]:
    """The bands of each weighted set and, where an element repeats, of the plain set too; both share their buckets."""
    out = [band_hashes(kept).tolist() if len(e) else [] for (e, _), kept in zip(sets, prob_minhash_many(sets))]
    repeats = [i for i, (e, w) in enumerate(sets) if len(e) and w.max() > 1]
    plain = prob_minhash_many([(sets[i][0], np.ones(len(sets[i][0]), np.int64)) for i in repeats])
    for i, kept in zip(repeats, plain):
        out[i] = list(dict.fromkeys(out[i] + band_hashes(kept).tolist()))
    return out


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> tuple[float, float]:
    """(set Jaccard, probability Jaccard) of two sorted sets with weights."""
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0, 0.0
    plain = len(both) / (len(a) + len(b) - len(both))
    if wa.max() == 1 and wb.max() == 1:
        return plain, plain
    # J_P = sum over common d of 1 / sum over all e of max(wa[e]/wa[d], wb[e]/wb[d])
    every = np.union1d(a, b)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a)], y[np.searchsorted(every, b)] = wa, wb
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio)
    sx, sy = np.cumsum(x[order][::-1])[::-1], np.cumsum(y[order])
    r, d = ratio[order], np.searchsorted(every, both)
    p, q, k = x[d], y[d], np.searchsorted(r, ratio[d], "left")
    above, under = np.append(sx, 0.0)[k], np.append(0.0, sy)[k]
    return plain, float((1 / (above / p + under / q)).sum())


def parities(sets: list[tuple[np.ndarray, np.ndarray]]) -> list[bytes]:
    """For each set a bit a cell: whether the cell has an odd number of its elements."""
    out = []
    for e, _ in sets:
        cell = (e >> np.uint64(7)) % np.uint64(PARITIES)
        out.append(np.packbits(np.bincount(cell.astype(np.int64), minlength=PARITIES).astype(np.uint8) & 1).tobytes())
    return out


def finer_parities(sets: list[tuple[np.ndarray, np.ndarray]]) -> list[bytes]:
    """The parities of sets of more than PARITIES elements in twice as many cells as elements or more; a power of two, so that fewer cells are their folds."""
    out = []
    for e, _ in sets:
        cells = min(MOST_PARITIES, 2 << (len(e) - 1).bit_length()) if len(e) > PARITIES else 0
        cell = (e >> np.uint64(7)) % np.uint64(max(cells, 1))
        out.append(np.packbits(np.bincount(cell.astype(np.int64), minlength=cells).astype(np.uint8) & 1).tobytes() if cells else b"")
    return out


def possible(bits_a, size_a, weight_a, bits_b, size_b, weight_b) -> np.ndarray:
    """How far the parities leave room for a similarity of 0.8: at least 0 where it is possible.

    With d elements in one set only, set Jaccard is 0.8 or more if 9 d <= |a| + |b|, and probability Jaccard at most
    (1 - q) / (1 + q) for q = d / 2 W, W the greater weight, since an element weighs 1 at least. The parities differ in d cells at most.
    """
    differ = np.bitwise_count(bits_a ^ bits_b).sum(-1, dtype=np.int64)
    return np.maximum(size_a + size_b, 2 * np.maximum(weight_a, weight_b)) - 9 * differ


def possible_finely(a: bytes, size_a: int, weight_a: int, b: bytes, size_b: int, weight_b: int) -> bool:
    """Whether the finer parities of two texts leave room, on the cells of the one with fewer; True where one has none."""
    if not a or not b:
        return True
    a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    n = min(len(a), len(b))
    return possible(*(x for bits, *sizes in ((a, size_a, weight_a), (b, size_b, weight_b)) for x in (np.bitwise_xor.reduce(bits.reshape(-1, n)), *sizes))) >= 0


def _bits(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, PARITIES // 64)


def _pack(elements: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    return elements.tobytes(), b"" if not len(counts) or counts.max() == 1 else counts.astype(np.uint32).tobytes()


def _unpack(elements: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    e = np.frombuffer(elements, np.uint64)
    return e, np.frombuffer(counts, np.uint32).astype(np.int64) if counts else np.ones(len(e), np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(row, doc_id, digest, bands) of every document."""

    def run(batches):
        held("near-dedup")
        for batch in slices(batches):
            raws = raw_texts(batch)
            digests, bands = [hashlib.md5(raw).digest() for raw in raws], []
            for i in range(0, len(raws), 256):
                sets = shingle_sets(raws[i : i + 256])
                bands += all_bands(sets)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["row", "doc_id", "digest", "bands"])

    return docs.select("text", F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row")).mapInArrow(run, "row long, doc_id long, digest binary, bands array<long>")


class Filter:
    """A Bloom filter of the 64-bit hashes ``key`` of a table's rows, broadcast: at most MOST_FILTER_BITS / 8 bytes (16 MB), and a row for each four of them comes here."""

    def __init__(self, spark: SparkSession, keys: DataFrame):
        bits = min(MOST_FILTER_BITS, max(FILTER_BITS, 1 << (32 * keys.count()).bit_length()))
        spots = F.explode(F.array(F.pmod("key", F.lit(bits)), F.pmod(F.shiftrightunsigned("key", 32), F.lit(bits)))).alias("spot")
        words = keys.select(spots).groupBy(F.shiftright("spot", 5).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 31 as int))")).alias("bits")).toArrow()
        table = np.zeros(bits // 32, np.uint32)
        table[words.column(0).to_numpy()] = words.column(1).to_numpy().astype(np.uint32)
        self.sent = spark.sparkContext.broadcast(table)

    def has(self, key: np.ndarray) -> np.ndarray:
        """True for every key of the table, and for few others."""
        table, key = self.sent.value, key.view(np.uint64)
        hit = np.ones(len(key), bool)
        for spot in (key, key >> np.uint64(32)):
            spot = spot & np.uint64(32 * len(table) - 1)
            hit &= (table[spot >> np.uint64(5)] >> (spot & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool)
        return hit

    def rows(self, df: DataFrame, key, wanted: bool = True) -> DataFrame:
        """The rows of ``df`` whose key it has (or has not)."""

        def run(batches):
            for batch in slices(batches):
                if (hit := self.has(batch.column(0).to_numpy()) == wanted).any():
                    part = batch.filter(pa.array(hit))
                    yield pa.RecordBatch.from_arrays(part.columns[1:], part.schema.names[1:])

        return df.select(key.alias("_key"), *df.columns).mapInArrow(run, df.schema)


def _text_key():
    return F.xxhash64("digest", F.coalesce("least", F.lit(-1)))


def _members(spark: SparkSession, texts: DataFrame, shared: DataFrame) -> DataFrame:
    """(digest, least, bucket) of the texts' shared buckets, and of few others: most buckets have one text, and go before any shuffle."""
    known = Filter(spark, shared.select(F.col("bucket").alias("key")))

    def run(batches):
        for batch in slices(batches, 4096):
            bands = batch.column(2)
            bucket, text = bands.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), bands.value_lengths().to_numpy())
            hit = known.has(bucket)
            text = pa.array(text[hit])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(text), batch.column(1).take(text), pa.array(bucket[hit])], ["digest", "least", "bucket"])

    return texts.select("digest", "least", "bands").mapInArrow(run, "digest binary, least long, bucket long")


def _shingles_of(spark: SparkSession, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted (digest, least id, ...) with their elements, weights and parities, from a second pass over the texts: one copy of each is read.
    The texts are shuffled, as they are smaller than their elements."""
    rows = docs.select("text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest"), F.col("doc_id").cast("long").alias("least"))
    found = Filter(spark, wanted.select(_text_key().alias("key"))).rows(rows, _text_key()).drop("least").dropDuplicates(["digest"])
    kept = [f for f in wanted.schema if f.name != "least"]
    made = "elements binary, weights binary, size long, weight long, bits binary, fine binary"

    def run(batches):
        for batch in slices(batches):
            sets = shingle_sets(raw_texts(batch))
            rows = [(*_pack(*x), len(x[0]), int(x[1].sum()), *b) for x, *b in zip(sets, parities(sets), finer_parities(sets))]
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*batch.schema.names[1:], *(x.split()[0] for x in made.split(", "))])

    met = found.join(wanted.drop("least"), "digest").select("text", *(f.name for f in kept))
    return met.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", " + made)


def _near_hubs(spark: SparkSession, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of a text and its hub that are alike. A hub of very many texts is dealt to several tasks, with a copy of its set each."""
    mine = sets.filter("hub != digest")
    hubs = materialise(spark, mine.groupBy("hub").agg(F.count("*").alias("n")), "hubs")
    limit = hot_limit(mine.count())
    salts = F.ceil(F.col("n") / limit).cast("int")
    hot = F.broadcast(hubs.filter(F.col("n") > limit).select("hub", salts.alias("salts")))  # at most MOST_HOT
    names = ["bits", "size", "weight", "elements", "weights"]
    left = mine.select("hub", "digest", *names).join(hot, "hub", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("digest"), "salts").cast("int"), F.lit(0))).drop("salts")
    right = Filter(spark, hubs.select(F.xxhash64("hub").alias("key"))).rows(sets.select("digest", *names), F.xxhash64("digest"))
    right = right.select(F.col("digest").alias("hub"), *[F.col(c).alias(f"hub_{c}") for c in names]).join(hubs, "hub").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")

    def exact(batches):
        for batch in slices(batches, 64):
            c = dict(zip(batch.schema.names, batch.columns))
            sides = [x for k in ("", "hub_") for x in (_bits(c[f"{k}bits"]), c[f"{k}size"].to_numpy(), c[f"{k}weight"].to_numpy())]
            alike = possible(*sides) >= 0
            for i in np.flatnonzero(alike).tolist():
                alike[i] = max(similarity(*(x for k in ("", "hub_") for x in _unpack(c[f"{k}elements"][i].as_py(), c[f"{k}weights"][i].as_py())))) >= LEAST
            yield pa.RecordBatch.from_arrays([c["digest"], c["hub"]], ["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return materialise(spark, left.join(right, ["hub", "salt"]).mapInArrow(exact, "a binary, b binary"), "alike")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(digest, root): least digest reachable over links (a, b); only digests with links."""
    ends = links.select(F.col("a").alias("x"), F.col("b").alias("y"))
    ends = materialise(spark, ends.union(ends.select("y", "x")).distinct(), "links")
    rows = ends.count()
    labels = materialise(spark, ends.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("root")), "labels")
    while True:
        near = even_join(spark, ends, labels.withColumnRenamed("x", "y"), "y", rows).groupBy("x").agg(F.min("root").alias("other"))
        step = materialise(spark, labels.join(near, "x").select("x", F.least("root", "other").alias("root"), F.col("root").alias("old")), "step")
        jump = step.select(F.col("x").alias("root"), F.col("root").alias("next"))
        step = even_join(spark, step, jump, "root", rows, "left").select("x", F.least("root", F.coalesce("next", "root")).alias("root"), "old")
        step = materialise(spark, step, "labels")
        labels = step.select("x", "root")
        if step.filter(F.col("root") != F.col("old")).isEmpty():
            return labels.select(F.col("x").alias("digest"), "root")


def _pairs(left, right) -> list:
    """Columns a and b of an unordered pair."""
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def _mixed(rows: DataFrame, key: str, total: int, spark: SparkSession) -> DataFrame:
    """The rows (key, digest, root, ...) of keys with several classes, with the number of the class's rows there (n), of all rows
    there (total), the class that has most (main) and the number of all others' rows (rest)."""
    size = materialise(spark, rows.groupBy(key, "root").agg(F.count("*").alias("n")), "sizes")
    several = size.groupBy(key).agg(F.count("*").alias("classes"), F.sum("n").alias("total"), F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("rest")).filter("classes > 1")
    several = materialise(spark, several, "several")
    classes = materialise(spark, deal_join(size, several, key, total, "classes").drop("classes"), "classes")
    return deal_join(rows, classes, [key, "root"], total, "n")


class Classes:
    """The classes so far: (digest, root) of every digest that has a link."""

    def __init__(self, spark: SparkSession):
        self.spark, self.roots = spark, None

    def of(self, rows: DataFrame) -> DataFrame:
        """Rows with their digest's class; without a link that is the digest itself."""
        if self.roots is None:
            return rows.withColumn("root", F.col("digest"))
        return rows.join(self.roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))

    def add(self, links: DataFrame) -> None:
        """Join the classes of linked digests (a, b), as a graph of classes."""
        for end in ("a", "b"):
            links = self.of(links.withColumnRenamed(end, "digest")).withColumnRenamed("root", f"root_{end}").drop("digest")
        links = materialise(self.spark, links.select(*_pairs(F.col("root_a"), F.col("root_b"))).filter("a != b").distinct(), "links")
        if links.isEmpty():
            return
        joined = components(self.spark, links)
        if self.roots is not None:
            step = joined.select(F.col("digest").alias("root"), F.col("root").alias("now"))
            known = even_join(self.spark, self.roots, step, "root", self.roots.count(), "left").select("digest", F.coalesce("now", "root").alias("root"))
            joined = known.union(joined.join(self.roots, "digest", "left_anti").select("digest", "root"))
        self.roots = materialise(self.spark, joined, "roots")


def prefixes(elements: np.ndarray, weights: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(elements, shares of the weight from each on) of a text's prefix in the order of (rank, element), in that order: all from
    which on either count or weight is 0.8 of the whole."""
    order = np.lexsort((elements, rank))
    behind = np.cumsum(weights[order][::-1])[::-1] / weights.sum()
    count = 1 - np.arange(len(order)) / len(order)
    n = int(((behind >= LEAST - 1e-9) | (count >= LEAST - 1e-9)).sum())  # both fall, so this is a prefix
    return elements[order[:n]], behind[:n]


def meet(x: dict, y: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of texts of different classes that no bound rules out: places in x, places in y, and the room that the bound leaves."""
    out = []
    for at in range(0, len(x["root"]), 64):
        one = {k: v[at : at + 64] for k, v in x.items()}
        may = one["root"][:, None] != y["root"][None, :]
        if "place" in one:
            common = np.minimum((one["size"] - one["place"])[:, None], (y["size"] - y["place"])[None, :])
            plain = common / (one["size"][:, None] + y["size"][None, :] - common)
            weighted = 1 / (1 / one["share"][:, None] + 1 / y["share"][None, :] - 1)
            may &= np.maximum(plain, weighted) >= LEAST - 1e-9
        i, j = np.nonzero(may)
        room = possible(one["bits"][i], one["size"][i], one["weight"][i], y["bits"][j], y["size"][j], y["weight"][j])
        may = room >= 0
        out.append((at + i[may], j[may], room[may]))
    i, j, room = (np.concatenate(c) for c in zip(*out))
    fine = [possible_finely(x["fine"][a], x["size"][a], x["weight"][a], y["fine"][b], y["size"][b], y["weight"][b]) for a, b in zip(i.tolist(), j.tolist())]
    fine = np.array(fine, bool)
    return i[fine], j[fine], room[fine]


def _cells(batches, names: list[str]):
    """The rows of one cell, which ``names`` tell, at a time, as a table and the places of its two sides; cells with an empty side are left out."""

    def tables(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = [table.column(c).to_numpy() for c in names]
            cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], 0)) + 1
            for i, j in zip([0, *cut.tolist()], cut.tolist()):
                yield table.slice(i, j - i)
            held = table.slice(int(cut[-1]) if len(cut) else 0)
        if held is not None and held.num_rows:
            yield held

    for table in tables(batches):
        side = table.column("x").to_numpy(zero_copy_only=False)
        if side.any() and not side.all():
            yield table, np.flatnonzero(side), np.flatnonzero(~side)


def _sides(whole: dict, i: np.ndarray, j: np.ndarray) -> list[dict]:
    return [{k: v[at] for k, v in whole.items()} for at in (i, j)]


def _codes(column) -> np.ndarray:
    return column.combine_chunks().dictionary_encode().indices.to_numpy()


def joining(sets: list[tuple[np.ndarray, np.ndarray]], root: list[int], pairs, wanted) -> list[tuple[int, int]]:
    """Of the pairs (places in ``sets``), those alike and not in one class by then; ``wanted`` tells which are to be tried."""
    above, out, tried = list(range(max(root, default=-1) + 1)), [], set()

    def find(k: int) -> int:
        while above[k] != k:
            above[k] = k = above[above[k]]
        return k

    for a, b in pairs:
        if find(root[a]) == find(root[b]) or (a, b) in tried or not wanted(a, b):
            continue
        tried |= {(a, b), (b, a)}
        if max(similarity(*sets[a], *sets[b])) >= LEAST:
            above[find(root[a])] = find(root[b])
            out.append((a, b))
    return out


def _by_prefix(spark: SparkSession, sets: DataFrame, left: DataFrame, classes: Classes) -> None:
    """Join the classes of all that are alike among the digests of ``left``: by shared prefix shingles."""
    mine = sets.join(left, "digest")

    def count(batches):
        for batch in slices(batches):
            found, n = np.unique(np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(e, np.uint64) for e in batch.column(0).to_pylist())]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["element", "n"])

    counts = mine.select("elements").mapInArrow(count, "element long, n long").groupBy("element").agg(F.sum("n").alias("n_all")).filter("n_all > 1")
    common = frequent(materialise(spark, counts, "frequencies"), FREQUENT).select("element", "n_all").toArrow()  # any order gives whole results; this one makes few pairs
    known, often = common.column(0).to_numpy().view(np.uint64), common.column(1).to_numpy()
    order = known.argsort()
    sent = spark.sparkContext.broadcast((known[order], often[order]))

    def keys(batches):
        known, often = sent.value
        for batch in slices(batches, 256):
            out = []
            for digest, e, w in zip(*(batch.column(i).to_pylist() for i in range(3))):
                e, w = _unpack(e, w)
                if not len(e):
                    continue
                rank = np.zeros(len(e), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, e), len(known) - 1)
                    rank = np.where(known[at] == e, often[at], 0)
                first, share = prefixes(e, w, rank)
                out += [(k, digest, i, s) for i, (k, s) in enumerate(zip(first.view(np.int64).tolist(), share.tolist()))]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.float64()))], ["key", "digest", "place", "share"])

    keyed = mine.select("digest", "elements", "weights").mapInArrow(keys, "key long, digest binary, place long, share double")
    keyed = materialise(spark, keyed, "prefixes")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = keyed.count()
    keyed = materialise(spark, deal_join(keyed, materialise(spark, shared, "shared"), "key", rows, "n").drop("n"), "prefixes")
    _by_key(spark, sets, _mixed(classes.of(keyed), "key", rows, spark), rows, classes)


def _by_key(spark: SparkSession, sets: DataFrame, live: DataFrame, rows: int, classes: Classes, buckets: bool = False) -> None:
    """Join the classes of all that are alike among the rows of one key; ``live`` are those (of about ``rows``) of keys with several classes, as ``_mixed``
    gives them, with place and share unless the keys are ``buckets``."""
    small, limit = sets.select("digest", "size", "weight", "bits", "fine"), hot_limit(rows)
    more = [] if buckets else ["place", "share"]
    names, cell = ["key", "salt", "x", "digest", "root", *more, "size", "weight", "bits", "fine"], ["key", "salt", "part"]

    def candidates(batches):
        """The texts of a cell that may be alike to one of another class there, for a verification in the same cell or, if they are large, in parts of it."""
        for table, i, j in _cells(batches, ["key", "salt"]):
            whole = {"root": _codes(table.column("root")), "bits": _bits(table.column("bits")), "fine": np.array(table.column("fine").to_pylist(), object)}
            a, b, _ = meet(*_sides(whole | {c: table.column(c).to_numpy() for c in (*more, "size", "weight")}, i, j))
            a, b = np.unique(i[a]), np.unique(j[b])
            if not len(a):
                continue
            size = table.column("size").to_numpy()
            n = -(-12 * int(size[a].sum() + size[b].sum()) // CELL_BYTES)
            own = np.arange(len(a)) % n, np.arange(len(b)) % n
            every, ones = np.arange(n), np.ones(n, np.int64)
            part = np.concatenate([(own[0][:, None] * n + every).ravel(), (every * n + own[1][:, None]).ravel()])
            took = table.select(["key", "salt", "x", "digest", "root"]).take(pa.array(np.concatenate([np.kron(a, ones), np.kron(b, ones)])))
            for batch in took.append_column("part", pa.array(part)).combine_chunks().to_batches():
                yield batch

    def links(batches):
        for table, i, j in _cells(batches, cell):
            packed = zip(*(table.column(c).to_pylist() for c in ("elements", "weights")))
            code, root, digest = _codes(table.column("digest")), _codes(table.column("root")), table.column("digest").to_pylist()
            at = dict(zip(code.tolist(), range(len(code))))  # a text of both sides once
            chosen = [_unpack(*x) for x in packed]
            whole = {"root": root, "bits": np.frombuffer(b"".join(parities(chosen)), np.uint64).reshape(len(chosen), -1), "fine": np.array(finer_parities(chosen), object)}
            whole |= {"size": np.array([len(e) for e, _ in chosen]), "weight": np.array([int(w.sum()) for _, w in chosen])}
            a, b, room = meet(*_sides(whole, i, j))
            order = np.lexsort((-room, a))
            rank = np.empty(len(a), np.int64)
            rank[order] = np.arange(len(a)) - np.searchsorted(a[order], a[order], "left")
            order = np.lexsort((-room, rank >= NEAREST))
            pairs = [(at[x], at[y]) for x, y in zip(code[i[a[order]]].tolist(), code[j[b[order]]].tolist())]
            here, wanted = table.column("key")[0].as_py(), lambda x, y: True
            if buckets:  # a pair of several buckets is tried in the least of them
                met = [set(x) for x in table.column("bands").to_pylist()]
                wanted = lambda x, y: min(met[x] & met[y]) == here
            found = joining(chosen, root.tolist(), pairs, wanted)
            ends = [pa.array([digest[p[k]] for p in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    live = materialise(spark, live.join(small, "digest"), "mixed")
    # Both sides of a frequent key are dealt out: cell (i, j) has the i-th part of those outside the largest class and the j-th of all.
    outside, whole = (F.ceil(F.col(c) / limit).cast("int") for c in ("rest", "total"))
    own = lambda parts: F.pmod(F.xxhash64("digest"), parts).cast("int")
    each = lambda parts: F.sequence(F.lit(0), parts - 1)
    one = live.filter("root != main").withColumn("salt", F.explode(F.transform(each(whole), lambda j: own(outside) * whole + j))).withColumn("x", F.lit(True))
    two = live.withColumn("salt", F.explode(F.transform(each(outside), lambda i: i * whole + own(whole)))).withColumn("x", F.lit(False))
    dealt = one.select(*names).union(two.select(*names)).repartition("key", "salt").sortWithinPartitions("key", "salt")
    near = materialise(spark, dealt.mapInArrow(candidates, "key long, salt int, x boolean, digest binary, root binary, part long"), "near")
    if near.isEmpty():
        return
    whole = Filter(spark, near.select(F.xxhash64("digest").alias("key"))).rows(sets.select("digest", "elements", "weights", *(["bands"] if buckets else [])), F.xxhash64("digest"))
    dealt = near.join(whole, "digest").repartition(*cell).sortWithinPartitions(*cell)
    classes.add(materialise(spark, dealt.mapInArrow(links, "a binary, b binary"), "alike"))


def _classes(spark: SparkSession, docs: DataFrame, texts: DataFrame, count: int) -> Classes:
    """The classes of digests: any two that share a bucket were compared, ruled out by a bound, or are in one class. ``texts`` are ``count`` rows (digest, least, bands)."""
    classes = Classes(spark)
    shared = texts.select(F.explode("bands").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialise(spark, shared, "shared")
    total = count * BANDS
    by_text = deal_join(_members(spark, texts, shared), shared, "bucket", total, "n").groupBy("digest").agg(F.first("least").alias("least"), F.sum("n").alias("weight"), F.collect_list(F.struct("bucket", "n")).alias("met"))
    by_text = materialise(spark, by_text, "met")
    met = materialise(spark, by_text.select("digest", "weight", F.explode("met").alias("met")).select("met.*", "digest", "weight"), "weights")
    hubs = materialise(spark, met.groupBy("bucket").agg(F.max(F.struct("weight", "digest")).alias("hub"), F.count("*").alias("n")), "hubs")
    rows = met.select("bucket", "digest")
    best = deal_join(rows, hubs, "bucket", total, "n").groupBy("digest").agg(F.max("hub")["digest"].alias("hub"))
    wanted = materialise(spark, best.join(by_text.select("digest", "least", F.col("met.bucket").alias("bands")), "digest"), "wanted")
    sets = materialise(spark, _shingles_of(spark, docs, wanted), "shingles")
    classes.add(_near_hubs(spark, sets))
    keyed = rows.select(F.col("bucket").alias("key"), "digest")
    live, large = materialise(spark, _mixed(classes.of(keyed), "key", total, spark), "untested"), F.col("rest") * F.col("total") > PAIRS
    far = materialise(spark, live.filter(large).select("digest").distinct(), "large")
    live = live.filter(~large)
    if not live.isEmpty():
        _by_key(spark, sets, live, total, classes, buckets=True)
    if not far.isEmpty():
        _by_prefix(spark, sets, far, classes)
    return classes


def _each_once(spark: SparkSession, signed: DataFrame, texts: DataFrame) -> DataFrame:
    """(digest, least, bands) of every text. The bands of copied texts alone are shuffled; those of others are read where they are. Written, so that no task of
    what follows needs a second Python worker for the filter: an executor keeps as many as its tasks ever needed at once."""
    copied, key = Filter(spark, texts.filter("copies > 1").select(F.xxhash64("digest").alias("key"))), F.xxhash64("digest")
    rows = signed.select("digest", F.col("doc_id").alias("least"), "bands")
    least = F.min(F.struct(F.col("least").isNull().alias("null"), "least"))["least"].alias("least")
    once = copied.rows(rows, key).groupBy("digest").agg(least, F.first("bands").alias("bands"))
    return materialise(spark, copied.rows(rows, key, wanted=False).unionByName(once), "once")


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size and kept (one row a class), with the text's digest."""
    signed = materialise(spark, signatures(docs), "signatures")
    row = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")
    texts = materialise(spark, signed.groupBy("digest").agg(F.min(row).alias("top"), F.count("*").alias("copies")), "texts")
    members = materialise(spark, _classes(spark, docs, _each_once(spark, signed, texts), texts.count()).of(texts), "rooted")
    rows = signed.count()
    # A class of very many different texts has as many rows of one root.
    whole = materialise(spark, members.groupBy("root").agg(F.sum("copies").alias("class_size"), F.min("top").alias("class")), "whole")
    classes = materialise(spark, deal_join(members, whole, "root", rows, "class_size").select("digest", "copies", "class_size", "class"), "classed")
    out = deal_join(signed.select("row", "doc_id", "digest"), classes, "digest", rows, "copies")
    return out.select("doc_id", F.col("class.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("class.row")).alias("kept"), "digest")


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents with one of each class, columns as they are. The kept row is found by its id and text; where that pair repeats, one of its rows."""
    key = lambda doc_id, digest: F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.hex(digest))
    signed = near_duplicates(spark, docs).select(key(F.col("doc_id"), F.col("digest")).alias("_key"), "kept")
    chosen = materialise(spark, signed.groupBy("_key").agg(F.max("kept").alias("kept"), F.count("*").alias("_n")).filter("kept").drop("kept"), "kept")
    digest = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    row = docs.select(F.struct("*").alias("_row"), key(F.col("doc_id").cast("long"), digest).alias("_key"))
    met = deal_join(row, chosen, "_key", docs.count(), "_n")
    if chosen.filter("_n > 1").isEmpty():
        return met.select("_row.*")
    return met.filter("_n = 1").select("_row.*").union(met.filter("_n > 1").groupBy("_key").agg(F.first("_row").alias("_row")).select("_row.*"))
