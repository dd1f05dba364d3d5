"""Toxicity: averaged subword vectors in a linear softmax.

A word is a run of letters, digits and bytes beyond ASCII, in lower case, and not of digits only. Its subwords are its byte
n-grams of 3 to 6 with marks at both ends, and the marked word itself, hashed to ``BUCKETS`` rows of an embedding table. A text's
bag holds the subwords of all its words, as often as they occur; the bag's vectors are averaged over the whole text, with ``SHRINK``
zero vectors (so a text of few words decides little) and times a fixed ``SCALE`` (averages of a long text are small numbers), and go
through a linear softmax of two classes. Misspelt words share n-gram vectors with those that were seen.

Embeddings and softmax are trained jointly in numpy on whole batches, by steps with momentum of one size for all embeddings, after each of
which every embedding is shortened by a fixed length, so those that tell nothing become zero and stay out. Only buckets that
occur in at least ``SEEN`` texts are trained. Every fifth text is left out of it, tells which epoch is best, and fits the logistic curve
that makes the logit a probability.

Fitted on a bounded sample, about ``SAMPLE`` toxic and clean texts, chosen by the hash of their ids; labels count
only from rows whose crc32 of the id is not 2 modulo 4.

Defined cases: null text is empty text; a text without words has the average 0, so its score is that of the bias; with
no label of either kind each score is 0; equal texts of equal label count once, and of the texts of one id the least, so repeated rows do not swell the
sample; a null label is no label; repeated rows return as often as they occur, with equal scores; ties do not matter, as each text
is scored alone; very long texts are averaged as a whole, and are alone in their batch; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WordMemory, crc_mod, hash_sample, mix64, prefix_hash, raw_texts, slices

BUCKETS, DIMENSIONS, SHORTEST, LONGEST, CUT = 1 << 20, 4, 3, 6, 0.3
#: About so many toxic and so many clean texts are fitted.
SAMPLE = (2000, 4000)
SCALE, SHRINK, SEEN, EPOCHS = 64.0, 256, 10, 300
#: Other bytes become spaces; A-Z become a-z.
TO_WORDS = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32 for i in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return [w for w in raw.translate(TO_WORDS).split() if not w.isdigit()]


def bags(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of every subword of every word."""
    data = b"".join(b"<" + w + b">" for w in words)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    sums, down = prefix_hash(np.frombuffer(data, np.uint8))
    end = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    left = end[word] - np.arange(len(data))
    buckets, owners = [], []
    for n in range(SHORTEST, LONGEST + 1):
        at = np.flatnonzero(left >= n)
        buckets.append((mix64((sums[at + n] - sums[at]) * down[at] + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int32))
        owners.append(word[at])
    buckets.append((mix64((sums[end] - sums[end - sizes]) * down[end - sizes] + np.uint64(99)) & np.uint64(BUCKETS - 1)).astype(np.int32))
    owners.append(np.arange(len(words), dtype=np.int32))
    bucket, owner = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return bucket[order], owner[order]


class Model:
    """What scoring needs: a logit for each bucket, the softmax's bias, and the calibration."""

    def __init__(self, logit: np.ndarray, bias: float, slope: float, offset: float):
        self.logit, self.bias, self.slope, self.offset = logit.astype(np.float32), bias, slope, offset

    def word_sums(self, words: list[bytes]) -> np.ndarray:
        """For each word the sum of its subwords' logits, and their number."""
        bucket, owner = bags(words)
        return np.stack([np.bincount(owner, self.logit[bucket], len(words)), np.bincount(owner, minlength=len(words))], 1)

    def memory(self) -> WordMemory:
        """The worker's memory of words: a broadcast model is one object for all tasks of a worker."""
        if not hasattr(self, "_memory"):
            self._memory = WordMemory({}, np.zeros((0, 2), np.float32), self.word_sums)
        return self._memory

    def raw(self, raw: bytes, memory: WordMemory) -> float:
        """The logit of the averaged bag."""
        words = words_of(raw)
        if not words:
            return self.bias
        total, n = memory.table[memory.rows(words)].sum(0, dtype=np.float64)
        return SCALE * total / (n + SHRINK) + self.bias

    def score(self, raw: bytes, memory: WordMemory) -> float:
        return float(_sigmoid(self.slope * self.raw(raw, memory) + self.offset))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class _Bags:
    """Texts as counts of words; one text's words at a time."""

    def __init__(self, texts: list[bytes], vocabulary: dict[bytes, int]):
        word, count, size = array("i"), array("i"), array("i")
        for t in texts:
            found = Counter(words_of(t))
            word.extend(vocabulary.setdefault(w, len(vocabulary)) for w in found)
            count.extend(found.values())
            size.append(len(found))
        self.word, self.count = np.array(word, np.int32), np.array(count, np.float32)
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), np.array(size, np.int64))

    def share(self, sizes: np.ndarray) -> np.ndarray:
        """How much of its text's average each row's word has, for one of its subwords."""
        return self.count / (np.bincount(self.text, self.count * sizes[self.word])[self.text] + SHRINK)


def _in_parts(names: list[bytes], part: int = 20_000):
    """bags of many words, a part at a time: (bucket, word number)."""
    for at in range(0, len(names), part):
        bucket, owner = bags(names[at : at + part])
        yield bucket, owner + np.int32(at)


def train(texts: list[bytes], toxic: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, sparse: float = 0.02, seed: int = 7) -> Model:
    """Joint training of embeddings and softmax; every fifth text chooses the epoch and calibrates."""
    rng = np.random.default_rng(seed)
    toxic = np.array(toxic, float)
    held = np.arange(len(texts)) % 5 == 4
    vocabulary: dict[bytes, int] = {}
    every = _Bags(texts, vocabulary)
    names = list(vocabulary)
    if not names or len(set(toxic[~held].tolist())) < 2:
        return Model(np.zeros(BUCKETS), 0.0, 0.0, -40.0)
    texts_of = np.bincount(every.word, minlength=len(names))
    sizes, within = np.zeros(len(names)), np.zeros(BUCKETS)
    for bucket, owner in _in_parts(names):
        sizes += np.bincount(owner, minlength=len(names))
        within += np.bincount(bucket, texts_of[owner], BUCKETS)
    share = SCALE * every.share(sizes)
    # How many texts hold a bucket, counted by word: never less than the number of texts.
    seen = within >= min(SEEN, len(texts) // 10 + 1)
    parts = [(b[seen[b]], o[seen[b]]) for b, o in _in_parts(names)]
    rows = np.flatnonzero(seen)
    bucket, owner = (np.cumsum(seen, dtype=np.int32) - 1)[np.concatenate([b for b, _ in parts])], np.concatenate([o for _, o in parts])
    del parts, within, names
    first_rows, first_bucket, first_owner, n_words = rows, bucket, owner, len(vocabulary)
    embedding = rng.normal(0, 0.01, (DIMENSIONS, len(rows))).astype(np.float32)
    softmax, bias = rng.normal(0, 0.5, DIMENSIONS).astype(np.float32), np.array([np.log(toxic.mean() / (1 - toxic.mean()))], np.float32)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (embedding, softmax, bias)]
    best, shorten, fits = (np.inf, np.zeros(BUCKETS, np.float32), float(bias[0])), None, ~held[every.text]

    def logits_of(logit: np.ndarray, bias: float) -> np.ndarray:
        words = np.bincount(owner, logit[bucket], n_words)
        return np.bincount(every.text, share * words[every.word], len(texts)) + bias

    for epoch in range(1, epochs + 1):
        logit = softmax @ embedding
        p = _sigmoid(logits_of(logit, bias[0]))
        loss = -np.where(toxic > 0, np.log(p + 1e-12), np.log(1 - p + 1e-12))[held if held.any() else slice(None)].mean()
        if loss < best[0]:
            whole = np.zeros(BUCKETS, np.float32)
            whole[rows] = logit
            best = (loss, whole, float(bias[0]))
        error = np.where(held, 0, p - toxic) / (~held).sum()
        to_words = np.bincount(every.word[fits], (share * error[every.text])[fits], n_words)
        to_buckets = np.bincount(bucket, to_words[owner], len(rows)).astype(np.float32)
        if shorten is None:
            shorten = sparse * float(np.abs(to_buckets).max(initial=0))
        slope = rate * min(1.0, 2 * (1 - epoch / (epochs + 1)))
        grads = (softmax[:, None] * to_buckets[None, :], embedding @ to_buckets, np.array([error.sum()], np.float32))
        for k, (x, g, (m, v)) in enumerate(zip((embedding, softmax, bias), grads, state)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            size, scale = (slope, v.mean() if x.size else 1.0) if not k else (0.02, v)
            step = size / (np.sqrt(scale / (1 - 0.99**epoch)) + 1e-12)
            x -= (step * m / (1 - 0.9**epoch)).astype(np.float32)
            if not k:
                length = np.sqrt((x * x).sum(0)) + 1e-12
                x *= np.maximum(0, 1 - step * shorten * np.sqrt((softmax * softmax).sum()) / length).astype(np.float32)
        if epoch % 25 == 0:  # what has become zero stays out
            alive = (embedding != 0).any(0)
            place, keep = np.cumsum(alive, dtype=np.int32) - 1, alive[bucket]
            bucket, owner, rows, embedding = place[bucket[keep]], owner[keep], rows[alive], np.ascontiguousarray(embedding[:, alive])
            state[0] = [np.ascontiguousarray(x[:, alive]) for x in state[0]]
    model = Model(best[1], best[2], 1.0, 0.0)
    if len(set(toxic[held].tolist())) == 2:
        bucket, owner = first_bucket, first_owner
        model.slope, model.offset = _logistic(logits_of(best[1][first_rows], best[2])[held], toxic[held])
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with a small ridge, in units of the spread."""
    centre, scale = x.mean(), x.std() + 1e-9
    x, slope, offset = (x - centre) / scale, 1.0, 0.0
    for _ in range(60):
        p = _sigmoid(slope * x + offset)
        g = np.array([((p - y) * x).sum() + 0.1 * slope, (p - y).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        d = np.clip(np.linalg.solve(h, g), -2, 2)
        slope, offset = slope - d[0], offset - d[1]
    return float(slope / scale), float(offset - slope * centre / scale)


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Model:
    """A model of the sampled texts, calibrated to the shares of both labels in the whole table."""
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isNotNull() & (crc_mod("doc_id", 4) != 2)).distinct()  # an id that is labelled very often is one row
    parts = [marked.filter(F.col("toxic") == k) for k in (1, 0)]
    chosen = hash_sample(parts[0], "doc_id", sample[0]).union(hash_sample(parts[1], "doc_id", sample[1]))
    one = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = one.select("text", "toxic").distinct().withColumn("order", F.xxhash64("text")).toArrow()  # bounded by the sample
    order = np.argsort(rows.column("order").to_numpy(), kind="stable")
    texts = [(t or "").encode() for t in rows.column("text").to_pylist()]
    toxic = rows.column("toxic").to_numpy()
    model = train([texts[i] for i in order], toxic[order])
    whole, taken = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}, {r.toxic: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    if len(taken) == 2:
        model.offset += float(np.log(whole[1] / whole[0] * taken[0] / taken[1]))
    return model


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = spark.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches):
        memory = model.value.memory()
        for batch in slices(batches):
            scores = np.array([model.value.score(raw, memory) for raw in raw_texts(batch)])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(scores, pa.float64()), pa.array((scores >= CUT).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("text", F.col("doc_id").cast("long"), (crc_mod("doc_id", 4) == 2).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
