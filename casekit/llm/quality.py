"""Quality rules as a short-circuit cascade: rules in the order of rejections per cost.

DataFrame functions only. A rule is a condition on statistics of one text; a document is
kept if no rule holds for it. Conditions are evaluated lazily, one after the other, so the
order changes what a document costs and never whether it is kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from casekit.functions.text import let

from ._common import discard, materialize

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Words of a window of which repeats are counted.
WINDOW = 8
#: Rows of the sample that costs and rejections are estimated on, at most about so many.
SAMPLE_ROWS = 2000
_SPACES = " \t\n\x0b\f\r"
_INTS = "cast(array() as array<int>)"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lines(text: Column) -> Column:
    """The lines (split at \\n) that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))


def repeated_words(text: Column, window: int = WINDOW) -> Column:
    """Words that lie in windows of ``window`` words found twice or more in the text.

    Windows are hashed to 64 bits each. Where all hashes differ, that is all; else places
    are sorted by hash, those that have an equal neighbour are put in order again, and the
    stretches that they cover are added: n log n steps for n words, however many repeat.
    """

    def hashes(w: Column) -> Column:
        starts = F.when(F.size(w) >= window, F.sequence(F.lit(0), F.size(w) - window)).otherwise(F.expr(_INTS))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    def equal(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        found = F.filter(s, lambda x, j: same(x, j + 1) | ((j > 0) & same(x, j - 1)))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        more = lambda a, i: F.struct((i + window).alias("end"), (a["n"] + F.least(F.lit(window), i + window - a["end"])).alias("n"))
        return F.aggregate(places, start, more, lambda a: a["n"])

    def count(h: Column) -> Column:
        some = let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), equal)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(some))

    return let(let(words(text), hashes), count)


def _long(x: Column) -> Column:
    return x.cast("long")


def _letters(text: Column, kind: str) -> Column:
    return _long(F.length(F.regexp_replace(text, rf"\P{{{kind}}}+", "")))


#: Statistic -> its expression over a text that is not null.
STATISTICS: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda t: _long(F.size(words(t))),
    "word_chars": lambda t: _long(F.length(F.translate(t, _SPACES, ""))),
    "n_symbols": lambda t: _long(F.length(t) - F.length(F.translate(t, SYMBOLS, ""))),
    "n_dup_lines": lambda t: let(lines(t), lambda x: _long(F.size(x) - F.size(F.array_distinct(x)))),
    "n_repeat_words": repeated_words,
    "n_lines": lambda t: _long(F.size(lines(t))),
    "n_capitals": lambda t: _letters(t, "Lu"),
    "n_letters": lambda t: _letters(t, "L"),
    "n_lettered": lambda t: _long(F.size(F.filter(words(t), lambda w: w.rlike(r"\p{L}")))),
    "n_bullets": lambda t: _long(F.size(F.filter(lines(t), lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•‣]")))),
    "n_ellipses": lambda t: _long(F.size(F.filter(lines(t), lambda x: x.rlike(r"(?:\.\.\.|…)[\x20\x09-\x0D]*$")))),
}
#: Statistics that every document of the query gets.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

Stats = Mapping[str, Column]
#: Rule -> the condition on statistics under which it rejects a text.
BASE_RULES: dict[str, Callable[[Stats], Column]] = {
    "few_words": lambda s: s["n_words"] < 20,
    "repeated_windows": lambda s: s["n_repeat_words"] * 100 > s["n_words"] * 30,
}
RULES: dict[str, Callable[[Stats], Column]] = BASE_RULES | {
    "symbols": lambda s: s["n_symbols"] * 10 > s["n_words"],
    "word_length": lambda s: (s["word_chars"] < s["n_words"] * 3) | (s["word_chars"] > s["n_words"] * 10),
    "repeated_lines": lambda s: s["n_dup_lines"] * 2 > s["n_lines"],
    "capitals": lambda s: s["n_capitals"] * 2 > s["n_letters"],
    "few_letters": lambda s: s["n_lettered"] * 10 < s["n_words"] * 8,
    "bullets": lambda s: s["n_bullets"] * 10 > s["n_lines"] * 9,
    "ellipses": lambda s: s["n_ellipses"] * 10 > s["n_lines"] * 3,
}


class _Lazy(dict):
    """Statistics of a text column, built when a rule asks for them."""

    def __init__(self, text: Column, known: Stats):
        super().__init__(known)
        self.text = text

    def __missing__(self, name: str) -> Column:
        return STATISTICS[name](self.text)


@dataclass(frozen=True)
class Estimate:
    """A rule's place in the cascade: seconds a sampled row, and the share of the rows that
    reach it there which it rejects."""

    rule: str
    cost: float
    rejects: float


def order_rules(masks: Mapping[int, int], costs: Mapping[str, float]) -> list[Estimate]:
    """Rules by rejections per cost among what the rules before them leave.

    ``masks`` counts sampled rows by the set of rules that reject them (bit i: the i-th
    rule of ``costs``). Greedy; rules that reject as much per cost come cheapest first, then
    by name. A rule that rejects nothing more comes after all that do.
    """
    left, rest, out = dict(masks), dict(enumerate(costs)), []
    while rest:
        total = sum(left.values())
        shares = {i: sum(n for m, n in left.items() if m >> i & 1) / total if total else 0.0 for i in rest}
        best = min(rest, key=lambda i: (-shares[i] / costs[rest[i]], costs[rest[i]], rest[i]))
        out.append(Estimate(rest.pop(best), costs[list(costs)[best]], shares[best]))
        left = {m: n for m, n in left.items() if not m >> best & 1}
    return out


def _seconds(sample: DataFrame, condition: Column, runs: int) -> float:
    took = []
    for _ in range(runs):
        began = time.perf_counter()
        sample.agg(F.count_if(condition)).collect()
        took.append(time.perf_counter() - began)
    return min(took)


def estimate(docs: DataFrame, rules: Mapping[str, Callable[[Stats], Column]] = RULES, text_col: str = "text", known: tuple[str, ...] = (), rows: int = SAMPLE_ROWS, runs: int = 2, seed: int = 7) -> list[Estimate]:
    """The cascade for ``docs``: costs and rejections of ``rules`` on about ``rows`` rows.

    The statistics ``known`` are taken to be there already: they are computed with the sample
    and cost nothing more. A rule's cost is the least time of ``runs`` passes over the sample,
    less that of a pass that only reads it; a table without rows costs the same for every rule.
    """
    n_rows = docs.count()
    some = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).sample(min(1.0, rows / max(n_rows, 1)), seed)
    sample = materialize(some.select("text", *[STATISTICS[k](F.col("text")).alias(k) for k in known]), "quality_sample")
    stats = _Lazy(F.col("text"), {k: F.col(k) for k in known})
    bits = [F.when(F.coalesce(fails(stats), F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, fails in enumerate(rules.values())]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    masks = {r["m"]: r["n"] for r in sample.groupBy(mask.alias("m")).agg(F.count("*").alias("n")).collect()}
    n = max(sum(masks.values()), 1)
    idle = _seconds(sample, F.length("text") < 0, runs)
    costs = {name: max(_seconds(sample, fails(stats), runs) - idle, 1e-3) / n if masks else 1.0 for name, fails in rules.items()}
    discard(sample)
    return order_rules(masks, costs)


def cascade(text: Column, order: list[str], rules: Mapping[str, Callable[[Stats], Column]] = RULES, known: Stats | None = None) -> Column:
    """The first rule in ``order`` that rejects a text, or null; later rules aren't evaluated."""
    stats, out = _Lazy(F.coalesce(text, F.lit("")), known or {}), None
    for name in order:
        hit = F.coalesce(rules[name](stats), F.lit(False))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out if out is not None else F.lit(None).cast("string")


def filter_quality(docs: DataFrame, rules: Mapping[str, Callable[[Stats], Column]] = RULES, text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """``docs`` without the rows that a rule rejects, in one pass that evaluates as few rules
    as the order allows (estimated here where none is given).

    A null text counts as empty and has no words. Rows are judged one by one: ids don't
    matter, repeated rows are judged alike, other columns are kept, whatever their names, and
    an empty table stays empty.
    """
    order = order if order is not None else [e.rule for e in estimate(docs, rules, text_col)]
    return docs.where(cascade(F.col(text_col), order, rules).isNull())


def judge(docs: DataFrame, rules: Mapping[str, Callable[[Stats], Column]] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, the statistics ``BASE`` (long), ``base_failed`` and
    ``kept``, both true or false, never null.

    The statistics are computed once for a row; the cascade takes them as they are, in its
    order, and computes what its other rules need only for rows that come so far. A null
    text has no words, so it isn't kept; ids may be null; an empty table gives none.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", "text", *[STATISTICS[k](F.col("text")).alias(k) for k in BASE])
    known = {k: F.col(k) for k in BASE}
    order = [e.rule for e in estimate(docs, rules, text_col, BASE)]
    base = F.lit(False)
    for fails in BASE_RULES.values():
        base = base | fails(known)
    kept = cascade(F.col("text"), order, rules, known).isNull()
    return rows.select(F.col("id").alias(id_col), *BASE, base.alias("base_failed"), (~base & kept).alias("kept"))
