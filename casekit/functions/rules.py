"""Ordered pattern rules compiled to CASE WHEN, and label vocabularies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from ..vocabulary import BINARY_RULES, CANONICAL, CASE_TYPE_ALIASES, LABELS, SUMMARY_RULES, TERNARY_RULES
from .text import NOT_WORD

Rules = Sequence[tuple[str, Sequence[str]]]


def normalise_case_type(case_type: str) -> str:
    """``dv`` or ``boc``; aliases are resolved, anything else raises."""
    name = CASE_TYPE_ALIASES.get(case_type.strip().lower(), case_type.strip().lower())
    if name not in LABELS:
        raise ValueError(f"unknown case type {case_type!r}; one of {sorted(LABELS)} is expected")
    return name


def apply_rules(text: Column, rules: Rules) -> Column:
    """The label of the first rule with a pattern that is found in ``text``, or null. One
    pass per rule: its patterns are alternatives of one expression."""
    out = None
    for label, patterns in rules:
        hit = text.rlike("(?U)(?:" + "|".join(patterns) + ")")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def ruled(text: Column, rules: Rules) -> Column:
    """``apply_rules`` to lower-cased text without punctuation; null and blank give null."""
    return apply_rules(F.regexp_replace(F.lower(text), NOT_WORD, " "), rules)


def decision_summary(text: Column) -> Column:
    """Short decision of a long text."""
    return ruled(text, SUMMARY_RULES)


def decision_label(text: Column, case_type: str) -> Column:
    """Outcome label of a short decision."""
    return ruled(text, BINARY_RULES if normalise_case_type(case_type) == "dv" else TERNARY_RULES)


def _lookup(key: Column, values: Mapping[str, int | str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def normalise_label(label: Column) -> Column:
    """Trimmed and in upper case."""
    return F.upper(F.trim(label))


def label_code(label: Column, case_type: str, strict: bool = False) -> Column:
    """Code of a label (normalised first); unknown gives null, or an error if ``strict``."""
    code = _lookup(normalise_label(label), LABELS[normalise_case_type(case_type)])
    if not strict:
        return code
    return F.coalesce(code, F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null")))).cast("int"))


def canonical_label(label: Column, case_type: str) -> Column:
    """Canonical output label of any known spelling of a label; unknown raises."""
    case_type = normalise_case_type(case_type)
    names = {code: name for name, code in CANONICAL[case_type].items()}
    known = {k.lower(): names[c] for k, c in LABELS[case_type].items()} | {n: n for n in names.values()}
    found = _lookup(F.lower(F.trim(label)), known)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null")))))


def label_hits(label: Column) -> dict[str, Column]:
    """Per case type, the number of rows with one of its labels: the vocabulary with more
    hits is the data's (binary where equal)."""
    return {case: F.count_if(normalise_label(label).isin(*names)) for case, names in LABELS.items()}
