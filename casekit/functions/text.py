"""String expressions: cleaning, tokens, sentences, budgets, model output."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from ..vocabulary import STOP_WORDS, TRUNCATION_MARK

#: What is neither a letter, a digit, an underscore nor white space, in any script.
NOT_WORD = r"[^\p{L}\p{N}_\s]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where it is used inside a lambda,
    which would otherwise compute it for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_basic(text: Column) -> Column:
    """Lower case, other characters than words and white space to spaces, white space to
    one space, trimmed; null gives an empty text."""
    spaced = F.regexp_replace(F.lower(text), NOT_WORD, " ")
    return F.coalesce(F.trim(F.regexp_replace(spaced, r"(?U)\s+", " ")), F.lit(""))


def clean_advanced(text: Column) -> Column:
    """``clean_basic`` without numbers (with or without an ordinal sign) and single characters."""
    out = F.regexp_replace(clean_basic(text), r"(?U)\b\d+º?\b", " ")
    out = F.regexp_replace(out, r"(?U)\b\w\b", " ")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def squeeze(text: Column) -> Column:
    """White space to one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def words(clean: Column) -> Column:
    """The words of a cleaned text; none of an empty one."""
    return F.filter(F.split(clean, " "), lambda w: w != "")


def without_stop_words(tokens: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    listed = F.array(*[F.lit(w) for w in stop])
    return F.filter(tokens, lambda w: ~F.array_contains(listed, w))


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` tokens, space-joined; none where there are fewer tokens."""

    def runs(words: Column) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))

    return let(tokens, runs)


def sentences(text: Column, min_chars: int = 8) -> Column:
    """White space squeezed, split after one of ``.!?;:`` before white space, trimmed, and
    only sentences of ``min_chars`` or more; null gives none."""
    if min_chars < 1:
        raise ValueError("min_chars must be 1 or more")
    parts = F.transform(F.split(squeeze(F.coalesce(text, F.lit(""))), r"(?<=[.!?;:])\s+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) >= min_chars)


def sentence_tokens(sentence: Column) -> Column:
    """Estimate of a sentence's tokens: a quarter of its characters, and two; one at least."""
    return F.greatest(F.lit(1), (F.floor(F.length(sentence) / 4) + 2).cast("int"))


def text_tokens(text: Column) -> Column:
    """Estimate of a text's tokens: a quarter of its characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def truncate_middle(text: Column, token_budget: Column | int, mark: str = TRUNCATION_MARK) -> Column:
    """struct(text, truncated): ``text`` within four characters a token, keeping 55 % of
    the room for its beginning, the rest for its end, and ``mark`` between them. Where the
    mark alone does not fit, the beginning only."""
    if isinstance(token_budget, int) and token_budget <= 0:
        raise ValueError("the token budget must be positive")
    most = (F.lit(token_budget) if isinstance(token_budget, int) else token_budget) * 4
    room = most - len(mark)
    head = F.floor(room * 0.55).cast("int")
    tail = (room - head).cast("int")
    begin = F.regexp_replace(F.substring(text, F.lit(1), head), r"(?U)\s+$", "")
    end = F.regexp_replace(F.substring(text, F.length(text) - tail + 1, tail), r"(?U)^\s+", "")
    cut = F.substring(F.concat(begin, F.lit(mark), end), F.lit(1), most.cast("int"))
    fits = F.length(text) <= most
    out = F.when(fits, text).when(F.lit(len(mark)) >= most, F.substring(text, F.lit(1), most.cast("int"))).otherwise(cut)
    return F.struct(out.alias("text"), (~fits).alias("truncated"))


_THINK = r"(?is)<(?:think|thinking)>(.*?)</(?:think|thinking)>"


def strip_thinking(text: Column) -> Column:
    """``text`` without reasoning blocks, trimmed."""
    return F.regexp_replace(F.regexp_replace(text, _THINK, ""), r"(?U)^\s+|\s+$", "")


def thinking(text: Column) -> Column:
    """The reasoning blocks' texts, trimmed, without empty ones, separated by a blank line."""
    found = F.transform(F.regexp_extract_all(text, F.lit(_THINK), F.lit(1)), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(found, lambda x: x != ""), "\n\n")


def compose_output(content: Column, reasoning: Column) -> Column:
    """Model output with a separate reasoning field put in front as a block, unless there
    is none or the content has a block already."""
    content, reasoning = F.coalesce(content, F.lit("")), F.coalesce(reasoning, F.lit(""))
    block = F.concat(F.lit("<think>"), reasoning, F.lit("</think>"))
    return F.when((reasoning == "") | content.rlike(_THINK), content).when(content != "", F.concat(block, F.lit("\n"), content)).otherwise(block)


def first_name(name: Column) -> Column:
    """The first word without dots and commas, in lower case; null if nothing is left."""
    first = F.split(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")), " ")[0]
    return F.nullif(F.lower(F.trim(F.regexp_replace(first, "[.,]", ""))), F.lit(""))


def safe_name(text: Column) -> Column:
    """Characters that file names must not have become underscores."""
    return F.regexp_replace(text, r'[/\\:*?"<>|]', "_")


def safe_fragment(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_")


def url_middle(url: Column) -> Column:
    """What stands between the host and the last part of an address."""
    return F.nullif(F.regexp_extract(url, r"^[a-z]+://[^/]+/(.*)/[^/]*$", 1), F.lit(""))


def display_label(text: Column, most: int = 90) -> Column:
    """``text`` cut to ``most`` characters with an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("…"))).otherwise(text)


def span_colour(value: Column, most: Column) -> Column:
    """rgb() of an attribution: white at 0, red towards ``most``, blue towards ``-most``."""
    share = F.least(F.lit(1.0), F.abs(value) / F.greatest(most, F.lit(1e-12)))
    fade = F.floor(F.lit(255) * (F.lit(1.0) - share)).cast("int")
    return F.when(value >= 0, F.format_string("rgb(255,%d,%d)", fade, fade)).otherwise(F.format_string("rgb(%d,%d,255)", fade, fade))


def blend_with_white(colour: str, share: Column) -> Column:
    """#rrggbb between white (0) and ``colour`` (1)."""
    base = [int(colour.lstrip("#")[i : i + 2], 16) for i in (0, 2, 4)]
    parts = [F.lower(F.lpad(F.hex(F.round(F.lit(255.0) + share * (b - 255.0)).cast("int")), 2, "0")) for b in base]
    return F.concat(F.lit("#"), *parts)
