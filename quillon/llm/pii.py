"""Personal data: candidate spans, boosted trees, calibrated thresholds; in SQL functions throughout.

*Generators* propose spans with high recall, and may overlap: the four base kinds' patterns, whether valid or not, and
disguised addresses, national telephone numbers, and IPv6 addresses. Positions come from the texts between matches (``split``)
and the matches (``regexp_extract_all``), summed in blocks, so a text with very many matches takes linear time. Patterns are
possessive and start at the edges of runs only; they find what the plain patterns find, in linear time and without recursion.

*Features* tell a candidate's format (digits, groups, separators, checksums, dates) and context (signs beside it, cue words
within 24 characters before it). *Trees*: gradient boosting for the logistic loss, trained on a fixed set of made-up
lines whose spans are known (``fixture``: rule-made, seeded, about 3 000 lines; nothing is learned from the corpus), whose
features the same SQL expressions compute. The trees become CASE expressions. *Thresholds*: for each kind, the least score on lines
held out of training from which on 98 % of the candidates are right. A candidate at or above is selected unless a base span or a better
candidate overlaps it. Base spans are valid matches of the base patterns and always stay.

Offsets count code points, ends are exclusive. Defined cases: null text is empty text and has no spans (``redact`` leaves null as it is); null
ids stay; of overlapping candidates of equal score the first in the text stays, then the kind listed first; overlapping spans are redacted as
one, under the kind of the first and, of those that start together, the longest; very long texts, with very many spans, are taken whole; repeated rows return as often as they occur; an empty table gives no rows; other columns are not read (``redact``
keeps them, whatever their names).
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# Generators: name, kind, a cheap test of the text, the pattern.
GENERATORS = (
    ("email", "email", "contains(_t, '@')", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", "ip", "_digits", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", "card", "_digits", r"[0-9](?:[ -]?[0-9])++"),
    ("phone", "phone", "contains(_t, '+')", r"\+[0-9][ ().0-9-]+[0-9]"),
    ("hidden", "email", "_t rlike '(?i)[ (\\\\[]dot[ )\\\\]]|[(\\\\[]at[)\\\\]]'", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: ?[\[(]at[\])] ?| at )[A-Za-z0-9-]++(?:(?: ?[\[(]dot[\])] ?| dot |\.)[A-Za-z0-9-]++){1,4}+"),
    ("national", "phone", "_digits", r"(?<![0-9A-Za-z+.,-])(?:\([0-9]{2,5}\)|[0-9]{2,5})[ /.-][0-9]{2,8}(?:[ .-][0-9]{2,8}){0,4}+(?![0-9A-Za-z])"),
    ("six", "ip", "contains(_t, ':')", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}+(?::?[0-9A-Fa-f]{1,4}){1,4}+(?![0-9A-Za-z:])"),
)
CUES = (
    ("cue_phone", r"(?i)(?:tel|phone|call|fax|mobile|ring|dial|handy|telefon|llame)[^A-Za-z0-9]{0,4}(?:\\w{1,6}[^A-Za-z0-9]{1,3})?$"),
    ("cue_mail", r"(?i)(?:mail|write|contact|reach|address|schreib|correo|send)[^A-Za-z0-9]{0,4}(?:\\w{1,6}[^A-Za-z0-9]{1,3})?$"),
    ("cue_card", r"(?i)(?:card|visa|mastercard|amex|credit|karte|tarjeta|carte)[^A-Za-z0-9]{0,4}(?:\\w{1,6}[^A-Za-z0-9]{1,3})?$"),
    ("cue_host", r"(?i)(?:ip|ipv6|host|server|addr|address|ping|from)[^A-Za-z0-9]{0,4}(?:\\w{1,6}[^A-Za-z0-9]{1,3})?$"),
    ("cue_other", r"(?i)(?:order|isbn|version|date|id|no|nr|ref|part|build|serial|page|invoice|since|year)[^A-Za-z0-9]{0,4}$"),
)
BLOCK, BEFORE, AFTER = 256, 24, 12


def _digits_of(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    """Whether the digits pass Luhn's test."""
    x = f"cast(substring({d}, length({d}) - i, 1) as int)"
    return f"aggregate(sequence(0, length({d}) - 1), 0, (a, i) -> a + if(i % 2 = 0, {x}, if({x} > 4, 2 * {x} - 9, 2 * {x}))) % 10 = 0"


def _octets(m: str) -> str:
    return f"forall(split({m}, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(p as int), 256) <= 255)"


def _valid(kind: str) -> str:
    """A base match's test, of x.m."""
    digits = f"length({_digits_of('x.m')})"
    return {
        "email": "true",
        "ip": _octets("x.m"),
        "card": f"{digits} between 13 and 19 and {_luhn(_digits_of('x.m'))}",
        "phone": f"{digits} between 9 and 15",
    }[kind]


#: Features of a candidate x, each a number.
FEATURES = {
    **{f"is_{name}": f"int(x.g = '{name}')" for name, *_ in GENERATORS},
    "length": "length(x.m)",
    "digits": f"length({_digits_of('x.m')})",
    "groups": "size(split(x.m, '[^0-9A-Fa-f]+'))",
    "signs": "length(regexp_replace(x.m, '[0-9A-Za-z]', ''))",
    "kinds_of_sign": "size(array_distinct(split(regexp_replace(x.m, '[0-9A-Za-z]', ''), '')))",
    "longest_group": "array_max(transform(split(x.m, '[^0-9A-Fa-f]+'), p -> length(p)))",
    "shortest_group": "array_min(transform(filter(split(x.m, '[^0-9A-Fa-f]+'), p -> p <> ''), p -> length(p)))",
    "fours": "int(x.m rlike '^[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}$')",
    "luhn": f"int(length({_digits_of('x.m')}) between 13 and 19 and {_luhn('x.d')})",
    "date": "int(x.m rlike '^(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}([-./ ][0-9]{1,2}|$)|^[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:19|20)?[0-9]{2}$|^(?:19|20)[0-9]{2}[- ](?:19|20)[0-9]{2}$')",
    "isbn": "int(x.m rlike '^97[89]')",
    "zero_first": "int(x.m rlike '^[(]?0')",
    "brackets": "int(x.m rlike '[(\\\\[]')",
    "top_domain": "int(lower(x.m) rlike '(?:com|org|net|edu|io|de|fr|es|info|eu)$')",
    "hex_letters": "int(x.m rlike '[A-Fa-f]')",
    "sign_before": "int(x.l rlike '[-A-Za-z0-9_./#$=:]$')",
    "sign_after": "int(x.r rlike '^[-A-Za-z0-9_/#%=:]')",
    **{name: f"int(x.l rlike '{pattern}')" for name, pattern in CUES},
}


def _sums(steps: str) -> str:
    """Sums of the elements before each, in blocks."""
    blocks = f"transform(sequence(0, int((size({steps}) - 1) div {BLOCK})), b -> slice({steps}, b * {BLOCK} + 1, {BLOCK}))"
    return f"""if(size({steps}) = 0, array(), transform(array({blocks}), bs -> transform(
        array(aggregate(bs, array(0), (a, b) -> array_append(a, element_at(a, -1) + aggregate(b, 0, (s, y) -> s + y)))),
        tops -> flatten(transform(bs, (b, i) -> slice(aggregate(b, array(tops[i]), (a, y) -> array_append(a, element_at(a, -1) + y)), 1, size(b))))
    )[0])[0])"""


def _ends(spans: str) -> str:
    """The greatest end of the spans before each (0 before the first), in blocks, so that very many take linear time."""
    blocks = f"transform(sequence(0, int((size({spans}) - 1) div {BLOCK})), b -> transform(slice({spans}, b * {BLOCK} + 1, {BLOCK}), x -> x.e))"
    return f"""if(size({spans}) = 0, array(), transform(array({blocks}), bs -> transform(
        array(aggregate(bs, array(0), (a, b) -> array_append(a, greatest(element_at(a, -1), array_max(b))))),
        tops -> flatten(transform(bs, (b, i) -> slice(aggregate(b, array(tops[i]), (a, y) -> array_append(a, greatest(element_at(a, -1), y))), 1, size(b))))
    )[0])[0])"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def with_candidates(texts: DataFrame) -> DataFrame:
    """Adds _base and _more, arrays of spans with features, to rows that have _t, a text without nulls."""
    out = texts.withColumn("_digits", F.expr("_t rlike '[0-9]'"))
    for name, _, test, pattern in GENERATORS:
        out = out.withColumn(f"_m_{name}", F.expr(f"if({test}, regexp_extract_all(_t, {_quoted(pattern)}, 0), cast(array() as array<string>))"))
    for name, _, _, pattern in GENERATORS:
        out = out.withColumn(f"_s_{name}", F.expr(f"if(size(_m_{name}) > 0, split(_t, {_quoted(pattern)}, -1), cast(array() as array<string>))"))
    for name, *_ in GENERATORS:
        steps = f"transform(_m_{name}, (m, i) -> length(m) + length(_s_{name}[i]))"
        out = out.withColumn(f"_n_{name}", F.expr(steps))
    for name, *_ in GENERATORS:
        out = out.withColumn(f"_a_{name}", F.expr(_sums(f"_n_{name}")))
    for name, kind, *_ in GENERATORS:
        start = f"_a_{name}[i] + length(_s_{name}[i])"
        out = out.withColumn(
            f"_c_{name}",
            F.expr(
                f"transform(_m_{name}, (m, i) -> named_struct('k', {KINDS.index(kind)}, 's', {start}, 'e', {start} + length(m), 'g', '{name}', 'm', m, 'd', {_digits_of('m')}, 'l', right(_s_{name}[i], {BEFORE}), 'r', left(_s_{name}[i + 1], {AFTER})))"
            ),
        )
    base = [f"filter(_c_{k}, x -> {_valid(k)})" for k in KINDS]
    more = [f"filter(_c_{k}, x -> not ({_valid(k)}))" for k in KINDS[1:]] + [f"_c_{name}" for name, *_ in GENERATORS[len(KINDS) :]]
    out = out.withColumn("_base", F.expr(f"concat({', '.join(base)})")).withColumn("_loose", F.expr(f"concat({', '.join(more)})"))
    wanted = "filter(_loose, x -> length(x.d) >= 7 or x.g = 'hidden' or x.g = 'six')"
    features = ", ".join(f"'{n}', {e}" for n, e in FEATURES.items())
    return out.withColumn("_wanted", F.expr(wanted)).withColumn("_more", F.expr(f"transform(_wanted, x -> named_struct('k', x.k, 's', x.s, 'e', x.e, 'm', x.m, 'f', named_struct({features})))"))


# --- training --------------------------------------------------------------------------------


def fixture(n: int = 3000, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """Made-up lines: (text, kind, start, end) of the personal datum, or kind -1 where there is none."""
    r = random.Random(seed)
    pick, num = r.choice, lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(pick("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))
    hexes = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))

    def phone():
        return pick((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(2)} {num(4)} {num(4)}", f"0{num(3)}/{num(7)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"0{num(3)}-{num(6)}"))

    def hidden():
        end = pick(("com", "org", "net", "de", "fr", "es", "io"))
        return pick((f"{word()} [at] {word()} [dot] {end}", f"{word()}(at){word()}(dot){end}", f"{word()} at {word()} dot {end}", f"{word()}[at]{word()}.{end}"))

    def six():
        return pick((":".join(hexes(4) for _ in range(8)), ":".join(hexes(r.randint(1, 4)) for _ in range(8)), f"2001:db8:{hexes(4)}:{hexes(3)}::{hexes(2)}"))

    def card():
        return pick((f"{num(4)} {num(4)} {num(4)} {num(4)}", f"{num(4)}-{num(4)}-{num(4)}-{num(4)}"))

    def other():
        return pick(
            (
                f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.{r.randint(1950, 2030)}", f"{r.randint(1900, 2020)}-{r.randint(1900, 2030)}", f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}",
                f"{num(16)}", f"{num(13)}", f"{num(4)} {num(4)} {num(4)} {num(4)}", f"{num(2)}:{num(2)}:{num(2)}:{num(2)}", ":".join(hexes(2) for _ in range(6)), f"{num(3)}.{r.randint(256, 999)}.{num(2)}.{num(3)}", f"{num(5)}-{num(5)}", f"{num(2)} {num(3)} {num(3)}",
                f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02} {r.randint(0, 23):02}:{num(2)}", f"{r.randint(1990, 2030)}{r.randint(10, 12)}{r.randint(10, 28)} {num(6)}", f"{num(3)},{num(3)}", f"{num(1)}.{num(9)}", f"{num(8)}", f"{word()} at {word()} dot {word()}", f"{num(12)}-{num(6)}", f"{num(2)}-{num(7)}", f"{num(6)} {num(8)}", f"{num(4)}-{num(4)}", f"+{num(6)}",
            )
        )

    cue = {
        0: ("mail", "write to", "contact", "reach me", "send it to"), 1: ("host", "server", "ip", "ping", "from"), 2: ("card", "visa", "my credit card", "card no", "mastercard"), 3: ("tel", "call", "phone:", "fax", "mobile", "ring me")
    }
    made = {0: hidden, 1: six, 2: card, 3: phone}
    out = []
    for _ in range(n):
        kind = pick((0, 1, 2, 3, 3, -1, -1, -1, -1))
        if kind < 0:
            lead, datum = pick(("order", "isbn", "version", "id", "ref", "invoice", "since", word(), word(), "look", "page")), other()
        else:
            lead, datum = (pick(cue[kind]) if kind == 2 or r.random() < 0.7 else word()), made[kind]()
        before = " ".join(word() for _ in range(r.randint(0, 3)))
        before = f"{before} {lead}{pick((' ', ' ', ': '))}".lstrip()
        after = pick(("", ".", ", " + word(), " " + word()))
        out.append((before + datum + after, kind, len(before), len(before) + len(datum)))
    return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, least: int = 8) -> tuple[float, list]:
    """Gradient boosting for the logistic loss: (prior, trees); a tree is a leaf value or (feature, cut, left, right)."""
    prior = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    score, out = np.full(len(y), prior), []

    def grow(rows, g, h, d):
        gs, hs = g[rows].sum(), h[rows].sum()
        leaf = float(-rate * gs / (hs + 1.0))
        if not d or len(rows) < 2 * least:
            return leaf
        best = (1e-6, 0, 0.0)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, cg, ch = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            cut = cut[(cut >= least - 1) & (cut < len(order) - least)]
            if len(cut):
                gain = cg[cut] ** 2 / (ch[cut] + 1) + (gs - cg[cut]) ** 2 / (hs - ch[cut] + 1) - gs**2 / (hs + 1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, float((v[cut[k]] + v[cut[k] + 1]) / 2))
        if best[1:] == (0, 0.0):
            return leaf
        go = x[rows, best[1]] < best[2]
        return best[1], best[2], grow(rows[go], g, h, d - 1), grow(rows[~go], g, h, d - 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(len(y)), p - y, p * (1 - p), depth)
        out.append(tree)
        score = score + np.array([_walk(tree, row) for row in x])
    return prior, out


def _walk(tree, row) -> float:
    while not isinstance(tree, float):
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree


def tree_sql(tree, names: list[str]) -> str:
    if isinstance(tree, float):
        return f"{tree!r}D"
    return f"if(x.f.{names[tree[0]]} < {tree[1]!r}D, {tree_sql(tree[2], names)}, {tree_sql(tree[3], names)})"


class Trees:
    def __init__(self, prior: float, trees: list, thresholds: tuple):
        self.prior, self.trees, self.thresholds = prior, trees, thresholds

    def sql(self) -> str:
        """The score of a candidate x as SQL."""
        return " + ".join([f"{self.prior!r}D", *(tree_sql(t, list(FEATURES)) for t in self.trees)])


_MODEL: Trees | None = None


def fitted(spark: SparkSession, precision: float = 0.98) -> Trees:
    """The trees, fitted once a process: the fixture never changes."""
    global _MODEL
    if _MODEL is None:
        lines = fixture()
        values = ", ".join(f"({i}, {_quoted(t)})" for i, (t, *_) in enumerate(lines))
        rows = with_candidates(spark.sql(f"select * from values {values} as _lines(_i, _t)")).select("_i", F.explode("_more").alias("c")).select("_i", "c.k", "c.s", "c.e", "c.f").collect()
        x = np.array([[float(v) if v is not None else 0.0 for v in r.f] for r in rows])
        right = [lines[r._i][1] == r.k and r.s == lines[r._i][2] and r.e == lines[r._i][3] for r in rows]
        y, kind, held = np.array(right, float), np.array([r.k for r in rows]), np.array([r._i % 4 == 3 for r in rows])
        prior, trees = boost(x[~held], y[~held])
        score = prior + np.array([sum(_walk(t, row) for t in trees) for row in x])
        cuts = []
        for k in range(len(KINDS)):
            s, t = score[held & (kind == k)], y[held & (kind == k)]
            order = np.argsort(-s, kind="stable")
            good = np.cumsum(t[order]) / np.arange(1, len(order) + 1) >= precision
            cuts.append(float(s[order][np.flatnonzero(good)[-1]]) if good.any() else 1e9)
        _MODEL = Trees(prior, trees, tuple(cuts))
    return _MODEL


def with_spans(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """Adds _base and _spans (sorted by kind and start) to rows that have _t."""
    model = fitted(spark)
    cut = "case x.k " + " ".join(f"when {k} then {c!r}D" for k, c in enumerate(model.thresholds)) + " end"
    out = with_candidates(texts)
    out = out.withColumn("_scored", F.expr(f"transform(_more, x -> named_struct('s', x.s, 'p', {model.sql()}, 'k', x.k, 'e', x.e))"))
    out = out.withColumn("_good", F.expr(f"filter(_scored, x -> x.p >= {cut})"))
    plain = "transform(_base, x -> named_struct('s', x.s, 'p', double('infinity'), 'k', x.k, 'e', x.e))"
    # All by start, cut where a span starts behind the ends of all before it; within such a run every overlap is looked at.
    kind = "array<struct<s:int,p:double,k:int,e:int>>"
    out = out.withColumn("_sorted", F.expr(f"if(size(_good) = 0, cast(array() as {kind}), array_sort(concat({plain}, _good), (a, b) -> case when a.s < b.s then -1 when a.s > b.s then 1 when a.p > b.p then -1 when a.p < b.p then 1 else a.k - b.k end))"))
    out = out.withColumn("_ends", F.expr(_ends("_sorted"))).withColumn("_heads", F.expr("filter(transform(_ends, (e, i) -> if(_sorted[i].s >= e, i, -1)), i -> i >= 0)"))
    out = out.withColumn("_runs", F.expr("transform(_heads, (h, j) -> slice(_sorted, h + 1, coalesce(get(_heads, j + 1), size(_sorted)) - h))"))
    better = "y.s < x.e and x.s < y.e and (y.p > x.p or y.p = x.p and (y.s < x.s or y.s = x.s and y.k < x.k))"
    out = out.withColumn("_picked", F.expr(f"flatten(transform(_runs, run -> filter(run, x -> x.p < double('infinity') and not exists(run, y -> {better}))))"))
    key = "x -> named_struct('k', x.k, 's', x.s, 'e', x.e)"
    return out.withColumn("_spans", F.expr(f"array_sort(concat(transform(_base, {key}), transform(_picked, {key})))")).withColumn("_base", F.expr(f"transform(_base, {key})"))


def _joined(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(array({names})[x.k], ':', x.s, ':', x.e)), ',')"


def find_spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, the base spans' counts and digest, and all spans of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_t"))
    out = with_spans(spark, rows)
    counts = [F.expr(f"cast(size(filter(_base, x -> x.k = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(F.expr(_joined("_base")), 256).alias("base_sha256"), F.expr(_joined("_spans")).alias("spans"))


def redact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents, columns as they are, with every span replaced by its kind in brackets; n_chars follows the text."""
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce("text", F.lit("")).alias("_t"))
    out = with_spans(spark, rows).withColumn("_by_start", F.expr("array_sort(transform(_spans, x -> named_struct('s', x.s, 'o', -x.e, 'k', x.k, 'e', x.e)))"))
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    out = out.withColumn("_past", F.expr(_ends("_by_start")))
    pieces = f"transform(_by_start, (x, i) -> if(i = 0 or x.s >= _past[i], concat(substring(_t, _past[i] + 1, x.s - _past[i]), array({names})[x.k]), ''))"
    clean = f"if(size(_spans) = 0, _row.text, concat(array_join({pieces}, ''), substring(_t, array_max(transform(_by_start, y -> y.e)) + 1)))"
    out = out.withColumn("_clean", F.expr(clean))
    kept = []
    for f in docs.schema.fields:
        c = F.col("_row").getField(f.name)
        if f.name == "text":
            c = F.col("_clean")
        elif f.name == "n_chars":
            c = F.when(F.size("_spans") > 0, F.length("_clean")).otherwise(c)
        kept.append(c.cast(f.dataType).alias(f.name))
    return out.select(*kept)
