"""Language identification: known words by their log frequency, unseen words by shorter and shorter n-grams.

Training counts the words (runs of letters in lower case) of the labelled texts by language, and the character
n-grams of these words (1 to 4 letters, with marks at both ends). A known word scores its smoothed log frequency in each
language. A word that was not seen falls back to its 4-grams; if none of them is known to its 3-grams, and so on; its
score is the mean over the known ones. A text's scores add up to a posterior through the languages' shares.

The labelled texts are sampled by the hash of their ids down to about ``SAMPLE`` documents of each language, a documented bound
on what is fitted, so a rare language is not drowned by a frequent one. All words and n-grams of the sample are kept, however
rare; they lie in sorted arrays of 64-bit hashes, a few bytes each.

Defined cases: a text that is null or has no letter (Unicode's category L) is ``und`` with score 0; with no labelled row every
text is ``und``; ties go to the language first in order of its code; a null id is not held out; repeated rows return as often as they
occur, and repeated labelled rows count once; a very long text is scored as a whole; an empty table gives no rows; other columns are
not read (the filter keeps them). Language labels, source and id are never inputs of a prediction.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WordMemory, crc_mod, held, slices

SAMPLE, LONGEST = 3000, 4


def _letters() -> re.Pattern:
    """Runs of Unicode letters: what ``re`` calls a word, less digits and the number signs among them (as \u00bd or \u2167)."""
    other = [c for c in range(128, sys.maxunicode + 1) if chr(c).isalnum() and not chr(c).isdecimal() and unicodedata.category(chr(c))[0] != "L"]
    spans, at = [], 0
    while at < len(other):
        end = at
        while end + 1 < len(other) and other[end + 1] == other[end] + 1:
            end += 1
        spans.append(f"\\U{other[at]:08x}-\\U{other[end]:08x}")
        at = end + 1
    return re.compile(rf"[^\W\d_{''.join(spans)}]+")


LETTERS = _letters()
UND = "und"


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def grams_of(word: str, n: int) -> list[str]:
    """n-grams of the marked word; for n = 1 its letters."""
    if n == 1:
        return list(word)
    w = f"<{word}>"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def key_of(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode())


class Table:
    """Log frequencies by hashed key: sorted hashes, and a row of the languages for each."""

    def __init__(self, keys, rows: np.ndarray):
        hashed = np.fromiter((key_of(str(k)) for k in keys), np.uint64, len(keys))
        order = hashed.argsort()
        self.keys, self.rows = hashed[order], np.asarray(rows, np.float32)[order]

    def places(self, words: list[str]) -> np.ndarray:
        """Row numbers, -1 for a key that is not known."""
        if not len(self.keys):
            return np.full(len(words), -1, np.int64)
        hashed = np.array([key_of(w) for w in words], np.uint64)
        at = np.minimum(np.searchsorted(self.keys, hashed), len(self.keys) - 1)
        return np.where(self.keys[at] == hashed, at, -1)


class Model:
    """Log frequencies of words and n-grams for every language."""

    def __init__(self, langs: list[str], prior: np.ndarray, words: Table, grams: Table):
        self.langs, self.prior, self.words, self.grams = langs, prior, words, grams

    def rows_of(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word: its own if it is known, else its n-grams'."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        at = self.words.places(words)
        out[at >= 0] = self.words.rows[at[at >= 0]]
        left = np.flatnonzero(at < 0)
        for n in range(LONGEST, 0, -1):  # the longest n-grams of which any is known
            grams = [grams_of(words[i], n) for i in left.tolist()]
            size = [len(g) for g in grams]
            place = self.grams.places([g for one in grams for g in one])
            owner = np.repeat(np.arange(len(left)), size)
            known = place >= 0
            count = np.bincount(owner[known], minlength=len(left))
            for j in range(len(self.langs)):
                total = np.bincount(owner[known], self.grams.rows[place[known], j], len(left))
                out[left[count > 0], j] = (total / np.maximum(count, 1))[count > 0]
            left = left[count == 0]
            if not len(left):
                break
        return out

    def memory(self) -> WordMemory:
        """The worker's memory of words: a broadcast model is one object for all tasks of a worker."""
        if not hasattr(self, "_memory"):
            self._memory = WordMemory({}, np.zeros((0, len(self.langs)), np.float32), self.rows_of, 150_000)
        return self._memory

    def predict(self, text: str | None, memory: WordMemory) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.langs:
            return UND, 0.0
        total = self.prior + memory.table[memory.rows(words)].sum(0, dtype=np.float64)
        share = np.exp(total - total.max())
        best = int(share.argmax())
        return self.langs[best], float(share[best] / share.sum())


def _log_table(counts: pa.Table, langs: list[str]) -> Table:
    """Smoothed log frequencies of all keys in (lang, key, n)."""
    if not counts.num_rows:
        return Table([], np.zeros((0, len(langs))))
    keys = counts.column("key").combine_chunks().dictionary_encode()
    lang = pc.index_in(counts.column("lang"), pa.array(langs)).to_numpy()
    n = np.zeros((len(keys.dictionary), len(langs)))
    np.add.at(n, (keys.indices.to_numpy(), lang), counts.column("n").to_numpy())
    return Table(keys.dictionary, np.log((n + 0.1) / (n.sum(0) + 0.1 * (len(n) + 1))))


def _sampled(labelled: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` rows of each language, by the hash of the id."""
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row a language
    large = {lang: n for lang, n in sizes.items() if n > sample}
    if not large:
        return labelled
    steps = 1 << 20
    cut = F.create_map(*[F.lit(x) for lang, n in sorted(large.items()) for x in (lang, int(steps * sample / n))])
    return labelled.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(steps)) < F.coalesce(cut[F.col("lang")], F.lit(steps)))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the labelled texts whose crc32 of the id is not 0 modulo 5."""
    labelled = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", 5) != 0))
    # Equal texts of one language count once, so an id that repeats very often does not swell the sample.
    chosen = _sampled(labelled, sample).select("text", "lang").distinct()

    def count(batches):
        held("language fit")
        words, grams, seen = defaultdict(Counter), defaultdict(Counter), Counter()
        for batch in slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words[lang].update(words_of(text))
                seen[lang] += 1
        rows = [(2, lang, "", n) for lang, n in seen.items()]
        for lang, found in words.items():
            for w, c in found.items():
                for n in range(1, LONGEST + 1):
                    for g in grams_of(w, n):
                        grams[lang][g] += c
        for kind, table in ((0, words), (1, grams)):
            rows += [(kind, lang, k, c) for lang, found in table.items() for k, c in found.items()]
        for i in range(0, len(rows), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 100_000]), (pa.int8(), pa.string(), pa.string(), pa.int64()))], ["kind", "lang", "key", "n"])

    sums = chosen.mapInArrow(count, "kind byte, lang string, key string, n long").groupBy("kind", "lang", "key").agg(F.sum("n").alias("n"))
    found = sums.toArrow()  # bounded by the sample
    words, grams, seen = (found.filter(pc.equal(found.column("kind"), k)) for k in range(3))
    seen = dict(zip(seen.column("lang").to_pylist(), seen.column("n").to_pylist()))
    langs = sorted(seen)
    prior = np.log(np.array([seen[x] for x in langs], float) / max(1, sum(seen.values()))) if langs else np.zeros(0)
    return Model(langs, prior, _log_table(words, langs), _log_table(grams, langs))


def _predictor(model):
    """A function of texts that keeps one memory of words a worker task."""
    held("language")
    memory = model.memory()
    return lambda texts: [model.predict(t, memory) for t in texts]


def identify(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = spark.sparkContext.broadcast(fit(docs, sample))

    def run(batches):
        predict = _predictor(model.value)
        for batch in slices(batches):
            if batch.num_rows:
                langs, scores = zip(*predict(batch.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), (crc_mod("doc_id", 5) == 0).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(spark: SparkSession, docs: DataFrame, least_score: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The documents, columns as they are, whose language is told with at least this score."""
    model = spark.sparkContext.broadcast(fit(docs, sample))
    at = docs.columns.index("text")

    def run(batches):
        predict = _predictor(model.value)
        for batch in slices(batches):
            if batch.num_rows:
                found = predict(batch.column(at).to_pylist())
                yield batch.filter(pa.array([lang != UND and score >= least_score for lang, score in found]))

    return docs.mapInArrow(run, docs.schema)
