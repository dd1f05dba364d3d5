"""Text search: tokens, a web-style query language, BM25 ranking."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
# Common English words that carry no meaning for search.
STOP_WORDS = tuple("a an and are as at be but by for from has have if in into is it its no not of on or such that the their then there these they this to was were will with".split())


#: What parts words: everything but Unicode letters and numbers. (``re`` has no such classes; a word sign that is no underscore is the same.)
_PARTS, _WORD = r"[^\p{L}\p{N}]+", re.compile(r"[^\W_]+")
# The first step of Porter's published stemmer (1980), plurals and -ed, -ing, -y, as (pattern, replacement); ~ marks a
# stem that lost -ed or -ing.
_STEM = (
    ("sses$", "ss"), ("ies$", "i"), ("([^s])s$", r"\1"),
    ("^([^aeiouy]*[aeiouy]+[^aeiouy].*)eed$", r"\1ee"), ("^(.*[aeiouy].*?)(?:(?<!e)ed|ing)$", r"\1~"),
    ("(at|bl|iz)~$", r"\1e"), (r"([^aeioulsz])\1~$", r"\1"), ("^([^aeiou]*[aeiouy][^aeiouwxy])~$", r"\1e"), ("~$", ""),
    ("^(.*[aeiouy].*)y$", r"\1i"),
)


def _stem_column(x: Column) -> Column:
    out = x
    for pattern, to in _STEM:
        out = F.regexp_replace(out, pattern, to.replace("\\1", "$1"))
    return F.when(F.length(x) > 2, out).otherwise(x)


def stem(word: str) -> str:
    if len(word) > 2:
        for pattern, to in _STEM:
            word = re.sub(pattern, to, word)
    return word


def tokens(text, config: str = "simple") -> Column:
    """Lower-case runs of letters and numbers in order. ``english`` drops stop words and stems."""
    column = F.col(text) if isinstance(text, str) else text
    out = F.filter(F.split(F.lower(column), _PARTS), lambda x: x != "")
    if config == "english":
        out = F.transform(F.filter(out, lambda x: ~x.isin(*STOP_WORDS)), _stem_column)
    elif config != "simple":
        raise ValueError(f"text search configuration {config!r} is not known: simple or english")
    return out


def with_terms(df: DataFrame, text_col: str, name: str, config: str = "simple") -> DataFrame:
    """Adds the token array, computed once a row: as the output of a generator, which no filter or projection is merged into."""
    return df.select("*", F.explode(F.array(tokens(text_col, config))).alias(name))


def query_tokens(text: str, config: str = "simple") -> list[str]:
    found = _WORD.findall(text.lower())
    return [stem(t) for t in found if t not in STOP_WORDS] if config == "english" else found


@dataclass(frozen=True)
class Query:
    """An OR of ANDs; a part is (negated, the words of a phrase)."""

    any_of: tuple[tuple[tuple[bool, tuple[str, ...]], ...], ...]

    def terms(self) -> list[str]:
        """The words that score: those of parts that are not negated."""
        return list(dict.fromkeys(w for one in self.any_of for no, words in one if not no for w in words))


def parse_query(text: str, config: str = "simple") -> Query:
    """Words are ANDed; ``"a b"`` is a phrase; ``OR`` parts alternatives; ``-x`` excludes. Never raises."""
    groups: list[list] = [[]]
    for m in re.finditer(r'(-?)"([^"]*)"?|(\S+)', text):
        minus, phrase, word = m.groups()
        if word is not None:
            if word.lower() == "or" and groups[-1]:
                groups.append([])
                continue
            minus, phrase = ("-", word[1:]) if word.startswith("-") and len(word) > 1 else ("", word)
        words = tuple(query_tokens(phrase, config))
        if words:
            groups[-1].append((minus == "-", words))
    return Query(tuple(tuple(g) for g in groups if g))


def matches(query: Query, terms: Column) -> Column:
    """Whether a token array satisfies the query. An empty query matches nothing."""

    def part(no: bool, words: tuple[str, ...]) -> Column:
        if len(words) == 1:
            test = F.array_contains(terms, words[0])
        else:  # the words in a row
            test = F.concat(F.lit(" "), F.array_join(terms, " "), F.lit(" ")).contains(" " + " ".join(words) + " ")
        return ~test if no else test

    out = F.lit(False)
    for one in query.any_of:
        every = F.lit(True)
        for no, words in one:
            every = every & part(no, words)
        out = out | every
    return out


def _is(word: str):
    return lambda x: x == word


def bm25(df: DataFrame, query: Query, terms_col: str, k1: float = K1, b: float = B) -> DataFrame:
    """The rows that match, with ``score``. Collection figures come from one aggregate row of all rows with text."""
    words = query.terms()
    counts = [F.size(F.filter(terms_col, _is(w))).cast("double") for w in words]
    has = [F.sum(F.array_contains(terms_col, w).cast("long")).alias(f"_df{i}") for i, w in enumerate(words)]
    figures = df.filter(F.col(terms_col).isNotNull()).agg(F.count("*").alias("_n"), F.avg(F.size(terms_col)).alias("_mean"), *has)
    hits = df.filter(matches(query, F.col(terms_col))).crossJoin(F.broadcast(figures))  # one row
    score = F.lit(0.0)
    for i, tf in enumerate(counts):
        idf = F.log(F.lit(1.0) + (F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (F.lit(1 - b) + F.lit(b) * F.size(terms_col) / F.col("_mean")))
    return hits.withColumn("score", score).drop("_n", "_mean", *[f"_df{i}" for i in range(len(words))])
