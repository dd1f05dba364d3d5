"""Language-model scores: context-tree weighting over bytes, beside a word unigram base.

A text, with A-Z in lower case, is a byte string ended by the byte 0xFF, which no UTF-8 text holds; ``DEPTH`` of these stand before
it. Each byte is eight binary decisions, most significant bit first. A decision has a context tree of its own (one for each of
the 255 bit prefixes) whose nodes at depth 0 to ``DEPTH`` are told apart by as many of the last bytes. A node with n0 zeros and
n1 ones in the training texts has the Krichevsky-Trofimov probability Pe; its weighted probability is Pw = (Pe + product of
its children's Pw) / 2, and Pw = Pe at the greatest depth. The model predicts a bit by mixing the KT estimates of all depths with
the weights that this recursion gives: a node stops with weight Pe / 2 / Pw, else hands on to its child.

The table has a row for each gram, a byte with the ``DEPTH`` bytes before it, that occurs in the corpus, and so grows with it; counts cover all
training texts. Grams are dealt by their last two context bytes, whose subtree depends on nothing else (at most 2 ** 24 grams, however
large the corpus); above that only 256 x 255 numbers are left, which are the same for all. So every gram gets its log probability in Spark.
The most frequent grams, at most ``GRAMS``, are broadcast for scoring; occurrences of all others are joined by the gram, so none is left
out, and no gram of the join is frequent.

The base needs the training count of every word. Words are counted once, with a map-side sum a task. Frequent
words, at most ``head`` of them, are broadcast; all others are joined by the word, so no count is left out, and
no word of the join is frequent. A word of more than 64 bytes stands under its digest, so long words can be frequent ones too.

Defined cases: null text is empty text (one end token, one end byte); a null id belongs to the training
part; repeated rows count and return as often as they occur; very long texts are counted and scored in overlapping pieces, each byte
once; ties (grams or words as frequent as the last one broadcast) are joined, with the same result; with no training rows every
count is 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import crc_mod, frequent, materialise, raw_texts, slices

DEPTH, GRAMS, WORD_BYTES, PIECE = 4, 1 << 20, 64, 1 << 20
PAD, END = b"\xff" * DEPTH, b"\xff"


def word_key(word: bytes) -> bytes:
    """The word, or a space (which no word holds) and its digest."""
    return word if len(word) <= WORD_BYTES else b" " + hashlib.md5(word).digest()


def _windows(x: np.ndarray) -> np.ndarray:
    """Every byte but the first ``DEPTH`` with those before it, as one number."""
    n = len(x) - DEPTH
    keys = x[:n].astype(np.uint64)
    for i in range(1, DEPTH + 1):
        keys <<= np.uint64(8)
        keys |= x[i : n + i]
    return keys


def grams_of(raws: list[bytes], size: int = PIECE):
    """(keys, owners) of every byte of every text and its end, in pieces of about ``size``."""
    at = 0
    while at < len(raws):
        raw = raws[at]
        if len(raw) > size:  # pieces that overlap by the context
            whole = np.frombuffer(PAD + raw + END, np.uint8)
            for i in range(0, len(raw) + 1, size):
                keys = _windows(whole[i : min(i + size, len(raw) + 1) + DEPTH])
                yield keys, np.full(len(keys), at)
            at += 1
            continue
        end, total = at, 0
        while end < len(raws) and total + len(raws[end]) <= size:
            total += len(raws[end]) + 1
            end += 1
        keys = _windows(np.frombuffer(PAD + (END + PAD).join(raws[at:end]) + END, np.uint8))
        lengths = np.array([len(r) + 1 for r in raws[at:end]])
        owners = np.repeat(np.arange(at, end), lengths + DEPTH)[: len(keys)]  # a text's bytes and the padding behind it
        places = np.arange(len(keys)) - np.repeat(np.cumsum(lengths + DEPTH) - lengths - DEPTH, lengths + DEPTH)[: len(keys)]
        real = places < lengths[owners - at]
        yield keys[real], owners[real]
        at = end


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0: Stirling's series after a shift by eight."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1) - np.log(np.pi)



def _nodes(context: np.ndarray, byte: np.ndarray, n: np.ndarray, level: int):
    """Nodes of contexts after ``level`` bits: (row of each gram, first gram of each node, zeros, ones)."""
    prefix = context << np.uint64(8) | byte >> np.uint64(8 - level)
    _, first, row = np.unique(prefix, return_index=True, return_inverse=True)
    bit = (byte >> np.uint64(7 - level) & np.uint64(1)).astype(bool)
    return row, first, np.bincount(row, n * ~bit), np.bincount(row, n * bit)


def subtree(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From all grams with the same last two context bytes, and their training counts: for each gram the probability of a one at
    each of its eight decisions, mixed over depths 2 to ``DEPTH``; the 256 counts at depth 2; ln Pw of its 255 nodes."""
    keys, n = keys.astype(np.uint64), n.astype(float)
    byte = keys & np.uint64(255)
    ones, below = np.empty((len(keys), 8)), np.zeros(255)
    half = np.log(0.5)
    for level in range(8):
        mixed = inner = None
        for depth in range(DEPTH, 1, -1):
            row, first, n0, n1 = _nodes(keys >> np.uint64(8) & np.uint64((1 << 8 * depth) - 1), byte, n, level)
            estimate, weighted = ((n1 + 0.5) / (n0 + n1 + 1))[row], log_kt(n0, n1)
            if inner is None:
                mixed = estimate
            else:  # children are nodes of the depth below, each counted once
                children = np.bincount(row[inner[0]], inner[1], len(first))
                plain, weighted = weighted, half + np.logaddexp(weighted, children)
                stop = np.exp(half + plain - weighted)[row]
                mixed = stop * estimate + (1 - stop) * mixed
            inner = first, weighted
        ones[:, level] = mixed
        below[((1 << level) - 1 + (byte[inner[0]] >> np.uint64(8 - level))).astype(np.int64)] = inner[1]
    return ones, np.bincount(byte.astype(np.int64), n, 256), below


def _bits(counts: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of the decision after each prefix of ``level`` bits: (rows, 2**level) each."""
    x = counts.reshape(len(counts), 1 << level, 2, 1 << 7 - level).sum(-1).astype(float)
    return x[..., 0], x[..., 1]


def top(counts: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From counts (256 last bytes, 256) and sums of ln Pw at depth 2 (256, 255): parts (a, b) of each node's probability
    of a one, a + b * (that of depths 2 on)."""
    part, rest, half = np.zeros((256, 255)), np.zeros((256, 255)), np.log(0.5)
    for level in range(8):
        nodes = slice((1 << level) - 1, (1 << level + 1) - 1)
        m0, m1 = _bits(counts, level)
        t0, t1 = _bits(counts.sum(0, keepdims=True), level)
        plain1, plain0 = log_kt(m0, m1), log_kt(t0, t1)
        weighted1 = half + np.logaddexp(plain1, below[:, nodes])
        weighted0 = half + np.logaddexp(plain0, weighted1.sum(0, keepdims=True))
        stop0, stop1 = np.exp(half + plain0 - weighted0), np.exp(half + plain1 - weighted1)
        part[:, nodes] = stop0 * (t1 + 0.5) / (t0 + t1 + 1) + (1 - stop0) * stop1 * (m1 + 0.5) / (m0 + m1 + 1)
        rest[:, nodes] = (1 - stop0) * (1 - stop1)
    return part, rest


def log10_of(keys: np.ndarray, ones: np.ndarray, part: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """log10 probability of each gram's byte after its context."""
    keys = keys.astype(np.int64)
    byte, last, out = keys & 255, keys >> 8 & 255, np.zeros(len(keys))
    for level in range(8):
        node = (1 << level) - 1 + (byte >> 8 - level)
        one = part[last, node] + rest[last, node] * ones[:, level]
        out += np.log10(np.where(byte >> 7 - level & 1, one, 1 - one))
    return out


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, row = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(row, np.concatenate([p[1] for p in parts])).astype(np.int64)


COUNTS = "kind byte, word binary, gram long, n_train long, n_all long"


def corpus_counts(docs: DataFrame, most_words: int = 400_000, most_grams: int = 2_000_000) -> DataFrame:
    """(kind, word, gram, n_train, n_all): kind 0 grams, 1 words, 2 documents; a task hands on its sums whenever it holds ``most``."""
    schema = pa.schema([("kind", pa.int8()), ("word", pa.binary()), ("gram", pa.int64()), ("n_train", pa.int64()), ("n_all", pa.int64())])

    def rows(kind, words, grams, train, every):
        n = len(every)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), pa.nulls(n, pa.binary()) if words is None else pa.array(words, pa.binary()), pa.nulls(n, pa.int64()) if grams is None else pa.array(grams.astype(np.int64)), pa.array(train, pa.int64()), pa.array(every, pa.int64())], schema=schema)

    def count(batches):
        words, trained, grams = Counter(), Counter(), ([], [])
        docs_all = docs_train = 0

        def held(train):
            return sum(len(k) for k, _ in grams[train])

        def word_rows():
            keys = list(words)
            out = rows(1, keys, None, [trained.get(k, 0) for k in keys], list(words.values()))
            words.clear()
            trained.clear()
            return out

        def gram_rows(train):
            keys, n = _merge(grams[train])
            grams[train].clear()
            return rows(0, None, keys, n if train else np.zeros_like(n), n)

        for batch in slices(batches):
            raws, flags = [r.lower() for r in raw_texts(batch)], batch.column(1).to_pylist()
            for raw, train in zip(raws, flags):
                split = list(map(word_key, raw.split()))
                words.update(split)
                if train:
                    trained.update(split)
                if len(words) > most_words:
                    yield word_rows()
            docs_all += len(raws)
            docs_train += sum(flags)
            for train in (0, 1):
                for keys, _ in grams_of([r for r, t in zip(raws, flags) if t == train]):
                    grams[train].append(np.unique(keys, return_counts=True))
                    if len(grams[train]) > 16:
                        grams[train][:] = [_merge(grams[train])]
                        if held(train) > most_grams:
                            yield gram_rows(train)
        if docs_all:
            yield word_rows()
            yield rows(2, None, None, [docs_train], [docs_all])
        for train in (0, 1):
            if grams[train]:
                yield gram_rows(train)

    picked = docs.select("text", (crc_mod("doc_id", 5) != 1).alias("train"))
    return picked.mapInArrow(count, COUNTS).groupBy("kind", "word", "gram").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


def gram_table(spark: SparkSession, grams: DataFrame) -> DataFrame:
    """(gram, n_all, log10) of every gram, from (gram, n_train, n_all)."""

    def tree(table: pa.Table) -> pa.Table:
        keys, n = table.column("gram").to_numpy(), table.column("n_train").to_numpy()
        ones, counts, below = subtree(keys, n)
        whole = pa.array([keys[0] >> 8 & 255], pa.int64()), pa.array([None], pa.int64()), pa.array([counts.tobytes() + below.tobytes()], pa.binary())
        names = ["gram", "n_all", "figures"]
        each = pa.table([pa.array(keys), table.column("n_all").combine_chunks(), pa.array([row.tobytes() for row in ones], pa.binary())], names)
        return pa.concat_tables([each, pa.table(list(whole), names)])

    dealt = grams.withColumn("subtree", F.expr("shiftright(gram, 8) & 65535")).groupBy("subtree")
    parts = materialise(spark, dealt.applyInArrow(tree, "gram long, n_all long, figures binary"), "ctw-subtrees")

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(256 + 255)
        for figures in table.column("figures").to_pylist():
            total += np.frombuffer(figures)
        return pa.table({"last": table.column("gram").slice(0, 1).cast(pa.int64()), "figures": pa.array([total.tobytes()], pa.binary())})

    # A row for each last byte, at most 256: sums over its at most 256 subtrees.
    sums = parts.filter("n_all is null").groupBy("gram").applyInArrow(add, "last long, figures binary").collect()
    counts, below = np.zeros((256, 256)), np.zeros((256, 255))
    for r in sums:
        figures = np.frombuffer(bytes(r.figures))
        counts[r.last], below[r.last] = figures[:256], figures[256:]
    sent = spark.sparkContext.broadcast(top(counts, below))

    def finish(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            ones = np.frombuffer(b"".join(batch.column(2).to_pylist())).reshape(-1, 8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(log10_of(keys, ones, *sent.value))], ["gram", "n_all", "log10"])

    return materialise(spark, parts.filter("n_all is not null").mapInArrow(finish, "gram long, n_all long, log10 double"), "ctw-grams")


SCORED = "rid long, word binary, gram long, n long, doc_id long, held_out boolean, n_bytes long, known long, base double, score double"


def lm_scores(spark: SparkSession, docs: DataFrame, head: int = 100_000, most: int = GRAMS) -> DataFrame:
    """Base and model scores of every text."""
    counts = materialise(spark, corpus_counts(docs), "ctw-counts")
    total = counts.groupBy("kind").agg(F.sum("n_train").alias("n"), F.count(F.when(F.col("n_train") > 0, 1)).alias("v")).collect()
    total = {r.kind: r for r in total}
    ends = total[2].n if 2 in total else 0
    n_tokens, distinct = (total[1].n if 1 in total else 0) + ends, (total[1].v if 1 in total else 0) + (ends > 0)
    below = n_tokens + 0.5 * (distinct + 1)
    words = frequent(counts.filter("kind = 1"), head).select("word", "n_train").toArrow()
    known = dict(zip(words.column(0).to_pylist(), words.column(1).to_pylist()))
    grams = gram_table(spark, counts.filter("kind = 0").select("gram", "n_train", "n_all"))
    common = frequent(grams, most).select("gram", "log10").toArrow()
    keys, values = common.column(0).to_numpy().astype(np.uint64), common.column(1).to_numpy()
    order = keys.argsort()
    model = spark.sparkContext.broadcast((known, keys[order], values[order]))
    end_base = float(np.log10((ends + 0.5) / below))
    schema = pa.schema([("rid", pa.int64()), ("word", pa.binary()), ("gram", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_bytes", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def score(batches):
        known, keys, values = model.value
        log = {c: float(np.log10((c + 0.5) / below)) for c in set(known.values())}
        value = {w: log[c] for w, c in known.items()}

        def left(rids, name, found, n):
            """Rows of what is joined below."""
            return pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()) if f.name == "rid" else pa.array(found, f.type) if f.name == name else pa.array(n, pa.int64()) if f.name == "n" else pa.nulls(len(n), f.type) for f in schema], schema=schema)

        for batch in slices(batches):
            raws, (ids, held, rids) = [r.lower() for r in raw_texts(batch)], (batch.column(i).to_pylist() for i in (1, 2, 3))
            sums = np.zeros(len(raws))
            for found, owner in grams_of(raws):
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                    hit = keys[at] == found
                else:
                    at, hit = np.zeros(len(found), np.int64), np.zeros(len(found), bool)
                sums += np.bincount(owner[hit], values[at[hit]], len(raws))
                if not hit.all():
                    pairs, n = np.unique(np.stack([owner[~hit].astype(np.uint64), found[~hit]]), axis=1, return_counts=True)
                    yield left(np.array(rids, np.int64)[pairs[0].astype(np.int64)], "gram", pairs[1].astype(np.int64), n)
            docs_out, tail = [], ([], [], [])
            for raw, i, h, rid, s in zip(raws, ids, held, rids, sums.tolist()):
                base, seen, n = end_base, int(ends > 0), 1
                for w, c in Counter(raw.split()).items():
                    n += c
                    w = word_key(w)
                    v = value.get(w)
                    if v is None:
                        tail[0].append(rid)
                        tail[1].append(w)
                        tail[2].append(c)
                    else:
                        base += c * v
                        if known[w]:
                            seen += c
                docs_out.append((rid, None, None, n, i, h, len(raw), seen, base, s))
            if docs_out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*docs_out), schema)], schema=schema)
            if tail[0]:
                yield left(tail[0], "word", tail[1], tail[2])

    picked = docs.select("text", F.col("doc_id").cast("long"), (crc_mod("doc_id", 5) == 1).alias("held_out"), F.monotonically_increasing_id().alias("rid"))
    scored = materialise(spark, picked.mapInArrow(score, SCORED), "ctw-scored")
    count_of = counts.filter((F.col("kind") == 1) & (F.col("n_train") > 0)).select("word", "n_train")
    c = F.coalesce("n_train", F.lit(0))
    rare_words = scored.filter("word is not null").select("rid", "word", "n").join(count_of, "word", "left")
    rare_words = rare_words.select("rid", (F.col("n") * F.log10((c + 0.5) / F.lit(below))).alias("base"), F.when(c > 0, F.col("n")).otherwise(0).alias("known"), F.lit(0.0).alias("score"))
    rare_grams = scored.filter("gram is not null").select("rid", "gram", "n").join(grams.select("gram", "log10"), "gram")
    rare_grams = rare_grams.select("rid", F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("known"), (F.col("n") * F.col("log10")).alias("score"))
    sums = rare_words.unionByName(rare_grams).groupBy("rid").agg(*[F.sum(x).alias(f"rare_{x}") for x in ("base", "known", "score")])
    out = scored.filter("word is null and gram is null").join(sums, "rid", "left").withColumn("whole", F.col("score") + F.coalesce("rare_score", F.lit(0.0)))
    return out.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), F.col("whole").alias("score"), (-F.col("whole") * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
