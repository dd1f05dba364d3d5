"""Benchmark decontamination: a BM25 inverted index of test items searched by block-max WAND.

Words are runs of word characters in lower case. The index holds the items' terms with BM25 impacts (k1 1.2, b 0.75),
each divided by the item's own full score, so a score is the share of an item that a passage holds. Postings lie in item
order in blocks of ``BLOCK`` with the greatest impact of each; WAND moves over them by upper bounds and skips blocks
that cannot reach the threshold.

Every document is cut into passages of ``2 L`` words that start every ``L`` words, L being the longest item's words (64 at
least), so every run as long as an item lies whole in some passage. Each passage is a query. A vectorised bound comes first: terms whose
impacts sum to no more than ``SLACK`` in every item are left out, and a passage whose remaining terms give no item the
threshold less that slack cannot have a hit, so WAND need not run; the result is the same. All items at or above
``THRESHOLD`` are retrieved, and then verified on the document's words around the passage: an item has a question and an answer (the
words after a last ``answer:``, else its last quarter of words), and both must overlap in shingles of three words by at least
``OVERLAP``.

Items are indexed in blocks of ``ITEMS`` at most, one pass of broadcast each, so the broadcast is bounded whatever the
benchmark's size. The figures of BM25 are those of all items in every block.

Defined cases: null text is empty text; items without words are never met; items with the same text are each reported, so ties
stay side by side; a null id is kept as it is; repeated rows return as often as they occur; a very long text is cut into passages
like any other, all of them searched; no items means no hits; an empty table gives no rows; other columns are not read
(the filter keeps them, whatever their names).
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import held, materialise, slices

K1, B, BLOCK, ITEMS, THRESHOLD, SLACK, OVERLAP, GRAM = 1.2, 0.75, 16, 20_000, 0.5, 0.2, 0.5, 3
_WORD = re.compile(r"\w+")
_ANSWER = re.compile(r"\banswer\s*:", re.I)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams(words: list) -> set:
    return {tuple(words[i : i + GRAM]) for i in range(max(1, len(words) - GRAM + 1))} if words else set()


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's question and answer: after the last ``answer:``, else the last quarter of its words (three at least, if it has six)."""
    cut = max((m.start() for m in _ANSWER.finditer(text)), default=-1)
    if cut > 0 and words_of(text[cut:])[1:]:
        return words_of(text[:cut]), words_of(text[cut:])[1:]
    words = words_of(text)
    n = max(len(words) // 4, min(3, len(words) // 2))
    return words[: len(words) - n], words[len(words) - n :]


@dataclass
class Figures:
    """What BM25 needs to know of all items: their number, words, longest length, and in how many of them a term occurs."""

    items: int
    words: int
    longest: int
    within: dict

    @classmethod
    def of(cls, items: list[list[str]]) -> Figures:
        return cls(len(items), sum(map(len, items)), max(map(len, items), default=0), Counter(t for w in items for t in set(w)))


class Index:
    """The inverted index of one block of items, [(item id, text)], with the figures of all blocks."""

    def __init__(self, items: list[tuple], figures: Figures | None = None):
        items = [(i, t, w) for i, t in items if (w := words_of(t))]
        figures = figures or Figures.of([w for _, _, w in items])
        self.ids = [i for i, _, _ in items]
        self.halves = [tuple(grams(x) for x in question_answer(t)) for _, t, _ in items]
        self.length = figures.longest
        mean = figures.words / max(1, figures.items)
        tf = [Counter(w) for _, _, w in items]
        self.terms = {t: k for k, t in enumerate(sorted({t for c in tf for t in c}))}
        idf = {t: float(np.log(1 + (figures.items - figures.within[t] + 0.5) / (figures.within[t] + 0.5))) for t in self.terms}
        postings: list[list] = [[] for _ in self.terms]
        for i, c in enumerate(tf):
            norm = K1 * (1 - B + B * sum(c.values()) / mean)
            raw = {t: idf[t] * n * (K1 + 1) / (n + norm) for t, n in c.items()}
            whole = sum(raw.values())
            for t, x in raw.items():
                postings[self.terms[t]].append((i, x / whole))
        self.docs = [[i for i, _ in p] for p in postings]
        self.impacts = [[x for _, x in p] for p in postings]
        self.block_max = [[max(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)] for x in self.impacts]
        self.most = [max(x) for x in self.impacts]
        # Terms that may be left out of the bound: most frequent first, while no item gives more than SLACK.
        spent, essential = np.zeros(len(items)), np.ones(len(postings), bool)
        for t in sorted(range(len(postings)), key=lambda t: -len(postings[t])):
            if len(postings[t]) > 1 and (spent[self.docs[t]] + self.impacts[t]).max() <= SLACK:
                spent[self.docs[t]] += self.impacts[t]
                essential[t] = False
        sizes = np.array([len(p) if e else 0 for p, e in zip(postings, essential)], np.int64)
        self.essential, self.size, self.start = essential, sizes, np.cumsum(sizes) - sizes
        kept = [p for p, e in zip(postings, essential) if e]
        self.flat_doc = np.array([i for p in kept for i, _ in p], np.int64)
        self.flat_impact = np.array([x for p in kept for _, x in p])

    def possible(self, passage: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Passages that may have a hit, from distinct pairs of passage and essential term."""
        size = self.size[term]
        if not size.sum():
            return np.empty(0, np.int64)
        at = np.repeat(self.start[term] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        keys = np.repeat(passage, size) * len(self.ids) + self.flat_doc[at]
        pairs, row = np.unique(keys, return_inverse=True)
        enough = np.bincount(row, self.flat_impact[at]) >= THRESHOLD - SLACK - 1e-9
        return np.unique(pairs[enough] // len(self.ids))

    def search(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[float, int]]:
        """Block-max WAND: (score, item number) of all items at or above the threshold."""
        end = len(self.ids)
        cursors = [[self.docs[t][0], t, 0] for t in terms]  # item, term, place
        heapq.heapify(cursors)
        out = []

        def advance(cursor, to):
            docs, at = self.docs[cursor[1]], cursor[2]
            while at < len(docs) and docs[at] < to:
                block_end = min((at // BLOCK + 1) * BLOCK, len(docs))
                at = block_end if docs[block_end - 1] < to else at + 1
            cursor[0], cursor[2] = (docs[at] if at < len(docs) else end), at

        cursors.sort()
        while True:
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                if c[0] >= end:
                    break
                bound += self.most[c[1]]
                if bound >= threshold - 1e-12:
                    pivot = k
                    break
            if pivot < 0:
                return out
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # Bounds of the blocks that would hold the pivot.
            exact, block_ends = 0.0, end
            for c in cursors[: pivot + 1]:
                docs, b = self.docs[c[1]], c[2] // BLOCK
                while b < len(self.block_max[c[1]]) and docs[min((b + 1) * BLOCK, len(docs)) - 1] < item:
                    b += 1
                if b < len(self.block_max[c[1]]):
                    exact += self.block_max[c[1]][b]
                    block_ends = min(block_ends, docs[min((b + 1) * BLOCK, len(docs)) - 1] + 1)
            if exact < threshold - 1e-12:
                to = max(item + 1, min(block_ends, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end))
                for c in cursors[: pivot + 1]:
                    advance(c, to)
            elif cursors[0][0] == item:
                score = sum(self.impacts[c[1]][c[2]] for c in cursors[: pivot + 1])
                if score >= threshold - 1e-12:
                    out.append((score, item))
                for c in cursors[: pivot + 1]:
                    advance(c, item + 1)
            else:
                for c in cursors[: pivot + 1]:
                    if c[0] < item:
                        advance(c, item)
            cursors.sort()

    def verify(self, item: int, words: list[str]) -> tuple[float, float]:
        """Shares of the question's and the answer's shingles that the words hold."""
        have = grams(words)
        if len(words) > GRAM:
            have |= {tuple(words[i : i + n]) for n in (1, 2) for i in range(len(words) - n + 1)}  # for halves shorter than a shingle
        return tuple(len(half & have) / len(half) if half else 1.0 for half in self.halves[item])

    def hits(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text its verified items: (item id, best score, question overlap, answer overlap)."""
        step = max(64, self.length)
        get, found = self.terms.get, [{} for _ in texts]
        words = [words_of(t) for t in texts]
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < 200_000):
                size += len(words[end])
                end += 1
            group = words[at:end]
            sizes = np.array([len(w) for w in group], np.int64)
            term = np.array([get(x, -1) for w in group for x in w], np.int64)
            # Word j of a text lies in the passages j // step and, but for the first stretch, the one before.
            stretch = np.concatenate([np.arange(n) // step for n in sizes]) if len(sizes) else np.empty(0, np.int64)
            passages = np.maximum(1, -(-sizes // step))
            first = np.cumsum(passages) - passages
            own = np.repeat(first, sizes) + stretch
            use = np.flatnonzero(term >= 0)
            use = use[self.essential[term[use]]]
            n = max(1, len(self.terms))
            both = np.unique(np.concatenate([own[use] * n + term[use], (own[use] - 1)[stretch[use] > 0] * n + term[use][stretch[use] > 0]]))
            owner = np.repeat(np.arange(len(group)), passages)
            for p in self.possible(both // n, both % n).tolist():
                d = int(owner[p])
                k = (p - int(first[d])) * step
                part = group[d][k : k + 2 * step]
                for score, item in self.search(sorted({t for x in part if (t := get(x)) is not None})):
                    q, a = self.verify(item, part)
                    if q >= OVERLAP and a >= OVERLAP:
                        best = found[at + d].get(item)
                        if best is None or score > best[0]:
                            found[at + d][item] = (score, q, a)
            at = end
        return [[(self.ids[i], *found_[i]) for i in sorted(found_)] for found_ in found]


def _figures(items: DataFrame) -> tuple[Figures, DataFrame]:
    """Figures of all items, and (block, term, within) of the column ``block``'s terms, counted in Spark."""
    tokens = items.select("block", "text")

    def run(batches):
        for batch in slices(batches):
            rows = [(b, t, int(k == 0), len(w), len(w)) for b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (w := words_of(text)) for k, t in enumerate(sorted(set(w)))]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["block", "term", "first", "words", "longest"])

    found = tokens.mapInArrow(run, "block long, term string, first long, words long, longest long")
    one = found.filter("first = 1").agg(F.sum("first").alias("n"), F.sum("words").alias("words"), F.max("longest").alias("longest")).first()
    own = found.groupBy("block", "term").agg(F.count("*").alias("n"))
    within = own.groupBy("term").agg(F.sum("n").alias("within"))
    return Figures(one.n or 0, one.words or 0, one.longest or 0, {}), own.join(within, "term").select("block", "term", "within")


def index_blocks(spark: SparkSession, items: DataFrame, size: int = ITEMS):
    """Indexes of at most about ``size`` items, one at a time, by the hash of id and text.

    Document frequencies, the number of items, mean and longest length are those of all items, so the blocks change no score. With one
    block its own figures are those of all items.
    """
    n = items.count()
    blocks = max(1, -(-n // size))
    dealt = items.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block"))
    figures = None
    if blocks > 1:
        whole, terms = _figures(dealt)
        terms = materialise(spark, terms.repartition("block"), "terms")
    for k in range(blocks):
        rows = sorted(((r.item_id, r.text) for r in dealt.filter(F.col("block") == k).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        if blocks > 1:  # the block's own terms only: bounded by its items
            figures = Figures(whole.items, whole.words, whole.longest, {r.term: r.within for r in terms.filter(F.col("block") == k).collect()})
        yield Index(rows, figures)


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, size: int = ITEMS) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: the verified hits."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    rows, out = docs.select(F.col("doc_id").cast("long"), "text"), None
    for index in index_blocks(spark, items, size):
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            held("decontamination")
            for batch in slices(batches):
                hits = sent.value.hits(batch.column(1).to_pylist())
                found = [(i, *h) for i, hs in zip(batch.column(0).to_pylist(), hits) for h in hs]
                cols = list(zip(*found)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, size: int = ITEMS) -> DataFrame:
    """The documents without a verified hit, columns as they are; one pass a block of items."""
    at = docs.columns.index("text")
    for index in index_blocks(spark, items, size):
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            held("decontamination")
            for batch in slices(batches):
                if batch.num_rows:
                    yield batch.filter(pa.array([not h for h in sent.value.hits(batch.column(at).to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(run, T.StructType(docs.schema.fields))
    return docs
