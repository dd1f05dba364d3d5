"""Quality: ordinal cumulative-link regression on graded ratings over hashed text.

A text is a bag of hashed features: its white-space tokens with A-Z in lower case, their shapes (letters a or A, digits 0,
other signs as they are, runs folded), and steps of its length, of its share of distinct tokens, and of its share of
distinct lines. The bag's weights are averaged into one score s; P(grade > k) is the logistic of s - t_k with thresholds
t_0 < t_1 < ...: one set of weights shared by all grades. Thresholds stay in order as each is the one before plus
the exponential of a free number. Trained in numpy by Adam on whole batches of a bounded sample (about ``SAMPLE`` rated texts, chosen by
the hash of their ids); ratings count only from rows whose crc32 of the id is not 2 modulo 5.

Grades come from the labels: 0 for quality 0, 1 for quality 1 where ``toxic`` is 1, 2 for quality 1 otherwise.

Defined cases: null text is empty text (its length steps are its features); a null rating is no rating; equal texts of equal grade count once; of the texts of
one id the least counts; with fewer than two grades each text gets the only grade, or 0; a null id is not held out and has no
rating; repeated rows return as often as they occur, with equal values; ties do not matter, as each text is scored alone; very
long texts are whole bags, a batch of them is small; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WordMemory, crc_mod, hash_sample, raw_texts, slices

BUCKETS, SAMPLE = 1 << 18, 6000
_SHAPE = bytes(65 if 65 <= i <= 90 else 97 if 97 <= i <= 122 or i > 127 else 48 if 48 <= i <= 57 else i for i in range(256))
_FOLD = re.compile(rb"(.)\1+", re.S)


def _bucket(feature: bytes) -> int:
    return xxhash.xxh64_intdigest(feature) & (BUCKETS - 1)


def token_features(token: bytes) -> tuple[int, int]:
    return _bucket(b"w" + token.lower()), _bucket(b"s" + _FOLD.sub(rb"\1", token.translate(_SHAPE))[:24])


def text_features(raw: bytes, tokens: list[bytes]) -> list[int]:
    lines = raw.split(b"\n")
    n = max(1, len(tokens))
    steps = (len(tokens).bit_length(), int(10 * len(set(tokens)) / n), int(10 * len(set(lines)) / len(lines)), int(20 * sum(map(len, tokens)) / n) // 10)
    return [_bucket(b"t%d:%d" % pair) for pair in enumerate(steps)]


#: A text's own features weigh as so many tokens' together.
TEXT_SHARE = 0.5


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights.astype(np.float32), thresholds

    def token_weights(self, tokens: list[bytes]) -> np.ndarray:
        return np.array([self.weights[list(token_features(t))].sum() / 2 for t in tokens], np.float32)

    def memory(self) -> WordMemory:
        """The worker's memory of words: a broadcast model is one object for all tasks of a worker."""
        if not hasattr(self, "_memory"):
            self._memory = WordMemory({}, np.zeros(0, np.float32), self.token_weights)
        return self._memory

    def tails(self, raw: bytes, memory: WordMemory) -> np.ndarray:
        """P(grade > k) for every threshold."""
        tokens = raw.split()
        own = self.weights[text_features(raw, tokens)].mean()
        words = memory.table[memory.rows(tokens)].mean() if tokens else 0.0
        s = (1 - TEXT_SHARE) * words + TEXT_SHARE * own
        return 1 / (1 + np.exp(-np.clip(float(s) - self.thresholds, -40, 40)))


def train(texts: list[bytes], grades: np.ndarray, epochs: int = 120, rate: float = 0.5, ridge: float = 1e-7) -> Model:
    top = int(grades.max()) if len(grades) else 0
    if top == 0:
        return Model(np.zeros(BUCKETS), np.empty(0))
    seen: dict[bytes, tuple[int, int]] = {}
    columns, values, sizes = [], [], []
    for raw in texts:
        tokens = raw.split()
        row: Counter = Counter()
        for t, c in Counter(tokens).items():
            for f in seen.get(t) or seen.setdefault(t, token_features(t)):
                row[f] += (1 - TEXT_SHARE) * c / (2 * len(tokens))
        for f in text_features(raw, tokens):
            row[f] += TEXT_SHARE / 4
        columns += row.keys()
        values += row.values()
        sizes.append(len(row))
    columns, values, sizes = np.array(columns), np.array(values, np.float32), np.array(sizes)
    used, columns = np.unique(columns, return_inverse=True)
    starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(texts)), sizes)
    above = (grades[:, None] > np.arange(top)[None, :]).astype(float)
    share = np.clip(above.mean(0), 1e-3, 1 - 1e-3)
    start = -np.log(share / (1 - share))
    free = np.concatenate(([start[0]], np.log(np.maximum(np.diff(start), 1e-2))))
    weights = np.zeros(len(used))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, free)]
    for epoch in range(1, epochs + 1):
        thresholds = free[0] + np.concatenate(([0], np.cumsum(np.exp(free[1:]))))
        s = np.add.reduceat(weights[columns] * values, starts)
        error = 1 / (1 + np.exp(-np.clip(s[:, None] - thresholds, -40, 40))) - above  # of the sum over all cuts
        to_s, to_t = error.sum(1) / len(texts), -error.sum(0) / len(texts)
        grad_w = np.bincount(columns, values * to_s[owner], len(used)) + ridge * weights
        behind = np.cumsum(to_t[::-1])[::-1]
        grad_f = np.concatenate(([behind[0]], behind[1:] * np.exp(free[1:])))
        for x, g, (m, v), r in ((weights, grad_w, state[0], rate), (free, grad_f, state[1], 0.05)):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= r * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-10)
    whole = np.zeros(BUCKETS)
    whole[used] = weights
    return Model(whole, free[0] + np.concatenate(([0], np.cumsum(np.exp(free[1:])))))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the rated rows that may be learned from."""
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2)
    return labels.filter(F.col("quality").isNotNull() & (crc_mod("doc_id", 5) != 2)).select("doc_id", grade.cast("int").alias("grade"))


def fit(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> Model:
    chosen = F.broadcast(hash_sample(ratings.distinct(), "doc_id", sample))
    # One text an id and grade, whatever repeats, so the rows are bounded by the sample.
    one = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    rows = one.select("text", "grade").distinct().withColumn("order", F.xxhash64("text")).toArrow()
    order = np.argsort(rows.column("order").to_numpy(), kind="stable")
    texts, grades = [(t or "").encode() for t in rows.column("text").to_pylist()], rows.column("grade").to_numpy()
    return train([texts[i] for i in order], grades[order])


def quality(spark: SparkSession, docs: DataFrame, ratings: DataFrame, cut: int = 0, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, expected_grade, tail (P(grade > cut)) and selected (tail at least ``least``) of every document."""
    model = spark.sparkContext.broadcast(fit(docs, ratings, sample))

    def run(batches):
        memory = model.value.memory()
        for batch in slices(batches):
            tails = [model.value.tails(raw, memory) for raw in raw_texts(batch)]
            expected = [float(t.sum()) for t in tails]
            tail = np.array([float(t[min(cut, len(t) - 1)]) if len(t) else 0.0 for t in tails])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(expected, pa.float64()), pa.array(tail, pa.float64()), pa.array(tail >= least, pa.bool_())], ["doc_id", "held_out", "expected_grade", "tail", "selected"])

    return docs.select("text", F.col("doc_id").cast("long"), (crc_mod("doc_id", 5) == 2).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, expected_grade double, tail double, selected boolean")
