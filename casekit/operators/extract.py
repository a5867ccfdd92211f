"""Fields, sections, decisions, links and repairs from page texts and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rules import normalise_case_type
from ..functions.text import let
from ..vocabulary import (
    AFTER_HEADING,
    ANY_DATE,
    CASCADE,
    CASCADE_STARTS,
    CITY_COURTS,
    COURT_PATTERNS,
    COURT_SUFFIX,
    DECISION_VERBS,
    DESCRIPTOR_EXCLUDE,
    DESCRIPTORS,
    FIELDS,
    FULL_TEXT,
    LINK_EXCLUDE,
    PEACE_COURT,
    REPAIR_DATE,
    REVIEW,
    SUMMARY_HEADING,
    SUMMARY_TEXT,
)
from .dom import page_text, section_and_text


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _field(text: Column, pattern: str, flags: str = "(?iu)") -> Column:
    """Group 1 of the first match, trimmed; null where there is none or it is empty."""
    return F.nullif(_strip(F.regexp_extract(text, flags + pattern, 1)), F.lit(""))


# Text of HTML -------------------------------------------------------------------------------


def html_text(source: Column, drop: tuple[str, ...] = ("script", "style")) -> Column:
    """Stripped texts between tags, one a line, without the elements in ``drop``, comments
    and declarations. Named and numbered references that pages commonly use are decoded."""
    out = source
    for tag in drop:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?(?:</{tag}\s*>|$)", "\x01")
    out = F.regexp_replace(out, r"(?s)<!--.*?(?:-->|$)", "\x01")
    out = F.regexp_replace(out, r"(?s)<[/!?]?[A-Za-z][^>]*(?:>|$)|<![^>]*>", "\x01")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("nbsp", " "), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    parts = F.filter(F.transform(F.split(out, "\x01"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    return F.array_join(parts, "\n")


def page_title(source: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(source, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


# Fields -------------------------------------------------------------------------------------


def extract_fields(df: DataFrame, case_type: str, text_col: str = "text", court: str | None = None) -> DataFrame:
    """``df`` with the fields of a judgment's page text, null where a field is missing.

    For ``boc`` the date is the sentence's, else the decision's, else any that follows a
    label with ``Data``; and ``tribunal`` is ``JP_`` and the place of a peace court, else
    ``court``.
    """
    case_type = normalise_case_type(case_type)
    text = F.col(text_col)
    found = {name: _field(text, pattern) for name, pattern in FIELDS[case_type].items()}
    if case_type == "boc":
        found["data_acordao"] = F.coalesce(found.pop("data_sentenca"), found["data_acordao"], _field(text, ANY_DATE))
        place = _field(text, PEACE_COURT)
        found["tribunal"] = F.coalesce(F.concat(F.lit("JP_"), F.regexp_replace(F.upper(place), r"(?U)\s+", "_")), F.lit(court))
    return df.withColumns(found)


def descriptors(text: Column, case_type: str) -> Column:
    """Entries of the descriptor block: trimmed, three characters or more, no field names."""
    block = _strip(F.regexp_extract(text, "(?iu)" + DESCRIPTORS, 1))
    entries = F.transform(F.split(block, r"[;,\n]+"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    bad = "(?iu)(?:" + "|".join(DESCRIPTOR_EXCLUDE[normalise_case_type(case_type)]) + ")"
    return F.filter(entries, lambda x: (F.length(x) > 2) & ~x.rlike(bad))


def summary(text: Column, least: int = 21) -> Column:
    """What follows the summary heading up to the next heading; null under ``least`` characters."""
    found = _field(text, SUMMARY_TEXT, "(?isu)")
    return F.when(F.length(found) >= least, found)


def summary_of_page(source: Column, closed: bool = False, least: int = 21) -> Column:
    """Summary of an HTML page: what the elements after a bold heading with the word hold, up
    to the next bold one beside them, else as of ``summary`` of its text. A summary has
    ``least`` characters. With ``closed``, character references count only with their
    semicolon."""
    page = section_and_text(source, SUMMARY_HEADING, closed, least)
    return F.coalesce(page["section"], summary(page["text"], least))


def full_text(source: Column, case_type: str, closed: bool = False) -> Column:
    """Text of a page without scripts, styles, menus, headers, footers and forms, from the
    heading of the full decision on if it is there; ``closed`` as of ``summary_of_page``."""
    text = page_text(source, ("script", "style", "nav", "header", "footer", "form"), closed)
    return F.coalesce(_field(text, FULL_TEXT[normalise_case_type(case_type)], "(?isu)"), text)


# Decision cascade ---------------------------------------------------------------------------

_DECISION = "struct<decisao_extraida:string,texto_sem_decisao:string,metadata:struct<extraction_method:string,confidence:string,keyword_found:string,requires_manual_review:boolean,review_reason:string,document_position:string>>"


def _match_starts(text: Column, pattern: str) -> Column:
    """(place from 0, matched text) of all matches: pieces between them add up to it."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.arrays_zip(F.slice(pieces, 1, F.size(hits)).alias("piece"), hits.alias("hit"))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,hit:string>>)").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        start = acc["at"] + F.length(row["piece"])
        one = F.struct(start.alias("start"), row["hit"].alias("hit"))
        return F.struct((start + F.length(row["hit"])).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(rows, zero, step, lambda acc: acc["out"])


def _layer(text: Column, part: Column, start: Column, layer: tuple) -> Column:
    """struct(result) if the layer decides for ``part``, the text from ``start`` on, else
    null; the result is null where what it decides on fails the checks. Every step is bound
    to a name once, as a CASE would compute it for each use."""
    name, confidence, pattern, ignore, which, verbs, goes_on = layer
    pattern = ("(?ium)" if ignore else "(?m)") + pattern

    def outcome(match: Column) -> Column:
        return let(F.struct((start + match["start"]).alias("at"), match["hit"].alias("hit")), lambda m: let(_strip(F.substring(text, m["at"] + 1, F.length(text))), lambda d: checked(m, d)))

    def checked(m: Column, decision: Column) -> Column:
        valid = (F.length(decision) > 50) & (F.length(decision) < 50000)
        if verbs:
            valid = valid & F.substring(decision, 1, 1000).rlike("(?iuU)" + DECISION_VERBS)
        metadata = F.struct(
            F.lit(name).alias("extraction_method"), F.lit(confidence).alias("confidence"),
            F.substring(_strip(m["hit"]), 1, 50).alias("keyword_found"), F.lit(name in REVIEW).alias("requires_manual_review"),
            F.lit(REVIEW.get(name)).cast("string").alias("review_reason"),
            F.concat(F.floor(m["at"] * 100 / F.length(text)).cast("string"), F.lit("%")).alias("document_position"),
        )
        result = F.struct(decision.alias("decisao_extraida"), _strip(F.substring(text, F.lit(1), m["at"])).alias("texto_sem_decisao"), metadata.alias("metadata")).cast(_DECISION)
        return F.when(valid, F.struct(result.alias("result"))) if goes_on else F.struct(F.when(valid, result).alias("result"))

    return F.when(part.rlike(pattern), let(F.element_at(_match_starts(part, pattern), 1 if which == "first" else -1), outcome))


def _undecided(text: Column, reason: str) -> Column:
    metadata = F.struct(*[F.lit(v).cast(t).alias(n) for n, v, t in (("extraction_method", "none", "string"), ("confidence", "low", "string"), ("keyword_found", None, "string"), ("requires_manual_review", True, "boolean"), ("review_reason", reason, "string"), ("document_position", None, "string"))])
    return F.struct(F.lit(None).cast("string").alias("decisao_extraida"), F.coalesce(text, F.lit("")).alias("texto_sem_decisao"), metadata.alias("metadata"))


def split_decision(df: DataFrame, text_col: str = "texto_integral_completo", out_col: str = "decision") -> DataFrame:
    """``df`` with struct(decisao_extraida, texto_sem_decisao, metadata).

    The last 30 % of the text, then the last 40 % and 50 %, are searched by layers of
    markers in their order; the first layer with a match decides (some only if a decision
    verb follows). Its decision reaches to the text's end and must have 51 to 49,999
    characters; a deciding layer whose decision does not moves the search to the next
    share of the text. Shorter texts than 100 characters, and null, are left for review.
    """
    text = F.col(text_col)

    def searched(share: int) -> Column:
        start = F.floor(F.length(text) * share / 100).cast("int")
        layers = lambda part: F.coalesce(*[_layer(text, part, start, layer) for layer in CASCADE])
        return let(F.substring(text, start + 1, F.length(text)), layers)["result"]

    short = F.when(F.coalesce(F.length(text), F.lit(0)) < 100, _undecided(text, REVIEW["short"]).cast(_DECISION))
    none = _undecided(text, REVIEW["none"]).cast(_DECISION)
    return df.withColumn(out_col, F.coalesce(short, *[searched(share) for share in CASCADE_STARTS], none))


# Repairs ------------------------------------------------------------------------------------


def repair_court(df: DataFrame, court: str = "tribunal", text_col: str = "texto_integral_completo") -> DataFrame:
    """Courts that are missing or ``CSM``, from the text: the first pattern that is found
    in its first 30 %, else a city's name there, else one in its last 30 %."""
    text = F.col(text_col)
    size = F.greatest(F.lit(1), F.floor(F.length(text) * 0.3)).cast("int")
    header, footer = F.substring(text, F.lit(1), size), F.when(F.length(text) > size, F.substring(text, F.length(text) - size + 1, size)).otherwise("")

    def city(part: Column, inside: bool = False) -> Column:
        out = F.lit(None).cast("string")
        for name, code in reversed(list(CITY_COURTS.items())):
            out = F.when(F.contains(F.lower(part), F.lit(name)), code).otherwise(out)
        return out

    by_pattern = []
    for pattern in COURT_PATTERNS:
        if "(" in pattern.replace("(?:", ""):
            by_pattern.append(city(F.nullif(F.regexp_extract(header, "(?iuU)" + pattern, 1), F.lit(""))))
        else:
            by_pattern.append(F.when(header.rlike("(?iuU)" + pattern), "STJ"))
    found = F.coalesce(*by_pattern, city(header), city(footer))
    open_ = F.col(court).isNull() | F.col(court).isin("CSM", "")
    return df.withColumn(court, F.when(open_ & (F.length(text) > 0), F.coalesce(found, F.col(court))).otherwise(F.col(court)))


def after_heading(text: Column) -> Column:
    """What follows the full decision's heading; the text itself without one."""
    pattern = "(?isu)" + AFTER_HEADING
    return F.when(text.rlike(pattern), F.regexp_replace(F.regexp_extract(text, pattern, 1), r"(?U)^\s+", "")).otherwise(text)


def repair_date(text: Column) -> Column:
    return _field(text, REPAIR_DATE)


def repair_peace_court(court: Column) -> Column:
    return F.replace(court, F.lit(COURT_SUFFIX), F.lit(""))


def between(text: Column, begin: str, end: str) -> Column:
    """From one literal snippet to the nearest other, with both as given and something
    between; letters in any case; null where they are not found."""
    inner = F.regexp_extract(text, f"(?isu)\\Q{begin}\\E(.+?)\\Q{end}\\E", 1)
    return F.when(F.length(inner) > 0, _strip(F.concat(F.lit(begin), inner, F.lit(end))))


# Links --------------------------------------------------------------------------------------


def page_links(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per distinct link of a page: ``keep`` and ``href``."""
    found = F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1)))
    return df.select(*keep, F.explode(found).alias("href"))


def court_links(links: DataFrame, court: str, base: str, href: str = "href") -> DataFrame:
    """Links to documents of a court's database, made absolute, each once."""
    link = F.col(href)
    wanted = F.contains(F.lower(link), F.lit(f"{court}.nsf")) & (F.contains(link, F.lit("OpenDocument")) | link.rlike(r"(?i)/[a-f0-9]{32}/") | link.rlike(rf"(?i)^.*{court}\.nsf/[a-f0-9]{{32}}"))
    for word in LINK_EXCLUDE:
        wanted = wanted & ~F.contains(link, F.lit(word))
    return links.where(wanted).select(F.when(F.startswith(link, F.lit("http")), link).otherwise(F.concat(F.lit(base), link)).alias(href)).distinct()


def unseen_links(found: DataFrame, seen: DataFrame, href: str = "href") -> DataFrame:
    return found.join(seen, href, "left_anti").distinct()
