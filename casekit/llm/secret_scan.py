"""Secrets in whole texts, and weak credential parts linked where they co-occur.

DataFrame functions only. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casekit.functions.text import let

from ._common import materialize

#: kind -> (pattern, group whose length counts, least length). All are matched leftmost,
#: without overlaps within a kind; matches that are too short are dropped afterwards.
BASE = {
    "assign": ("""(?i)(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]{24,}", 0, 24),  # a run of 24 or more is found whole, as with [0-9a-f]+
}
#: Parts that mean little alone.
WEAK = {
    "weak_id": ("""(?i)(?:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9@._-]+)""", 1, 3),
    "weak_secret": ("(?<![A-Za-z0-9+/=])(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", 0, 40),
    "endpoint": ("(?i)[a-z][a-z0-9+.-]{1,15}://[^\\x00-\\x20\"'<>]+", 0, 8),
}
ROLES = {"access": "identifier", "weak_id": "identifier", "assign": "secret", "hex": "secret", "weak_secret": "secret", "endpoint": "endpoint"}
#: What must co-occur with a weak part for it to be reported.
NEEDS = {"weak_id": ("secret",), "weak_secret": ("identifier",), "endpoint": ("identifier", "secret")}
#: Order of kinds that start at the same place.
KINDS = (*BASE, *WEAK)
SCOPE = 300
_SPAN = "array<struct<start: int, rank: int, kind: string, end: int>>"


#: Matches of a text that are placed together.
_BLOCK = 256


def match_spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of struct(start, rank, kind, end) of the matches of ``pattern`` in ``text``.

    The pieces between the matches give their places: splitting and extracting follow the
    same leftmost matches. Places are summed in blocks, then over blocks, so that very many
    matches of one text don't copy a growing array for each.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rank = KINDS.index(kind)
    none = F.expr(f"cast(array() as {_SPAN})")

    def placed(rows: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / _BLOCK).cast("int")), lambda b: F.slice(rows, b * _BLOCK + 1, F.lit(_BLOCK)))
        sums = F.transform(blocks, lambda some: F.struct(some.alias("rows"), F.aggregate(some, F.lit(0), lambda a, r: a + r["skip"] + r["size"]).alias("sum")))
        return let(sums, spread)

    def spread(sums: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        bases = F.aggregate(sums, zero, lambda acc, x: F.struct((acc["at"] + x["sum"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(sums, bases, lambda x, base: F.aggregate(x["rows"], F.struct(base.alias("at"), none.alias("out")), step, lambda acc: acc["out"])))

    def step(acc: Column, row: Column) -> Column:
        start = acc["at"] + row["skip"]
        end = start + row["size"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(row["counts"] >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    rows = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("piece"), found.alias("hit"), sized.alias("sized"))
    rows = F.transform(rows, lambda r: F.struct(F.length(r["piece"]).alias("skip"), F.length(r["hit"]).alias("size"), F.length(r["sized"]).alias("counts")))
    return F.when(text.rlike(pattern), let(rows, placed)).otherwise(none)


def _bins(low: Column, high: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(F.greatest(low, F.lit(0)) / width), F.floor(F.greatest(high, F.lit(0)) / width)))


def link_parts(parts: DataFrame, keys: list[str], scope: int = SCOPE) -> DataFrame:
    """The weak parts of ``parts`` (keys, start, rank, kind, end) whose needs are met:
    of each role that it needs, some part lies within ``scope`` code points.

    Interval join on bins of one scope's width: a weak part's interval, widened by the
    scope on both sides, meets the parts of the needed roles bin by bin. As it reaches
    over a bin's end in every bin, the least start and greatest end of a role there say
    whether one of them overlaps, so that parts are aggregated before the join and no
    pairs are made. Keys must not be null.
    """
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    needed = parts.withColumn("role", role[F.col("kind")]).where("role <> 'endpoint'")
    needed = needed.select(*keys, "role", "start", "end", _bins(F.col("start"), F.col("end"), scope).alias("bin"))
    needed = needed.groupBy(*keys, "bin", "role").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    weak = parts.where(F.col("kind").isin(*WEAK)).distinct()
    weak = weak.select("*", _bins(F.col("start") - scope, F.col("end") + scope, scope).alias("bin"))
    near = weak.join(needed, [*keys, "bin"]).where((F.col("first") <= F.col("end") + scope) & (F.col("last") >= F.col("start") - scope))
    got = near.groupBy(*keys, "start", "rank", "kind", "end").agg(F.collect_set("role").alias("roles"))
    met = F.lit(False)
    for kind, roles in NEEDS.items():
        met = met | ((F.col("kind") == kind) & F.forall(F.array(*[F.lit(r) for r in roles]), lambda r: F.array_contains("roles", r)))
    return got.where(met).select(*keys, "start", "rank", "kind", "end")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs``: (id, ``base``, ``linked``), arrays of
    struct(start, rank, kind, end) in the order of start, then kind.

    ``base`` has the matches of ``BASE``, ``linked`` the weak parts whose complementary
    parts co-occur within ``scope``. A null text counts as empty; ids may be null; repeated
    rows have equal results. Whole texts are searched once, what is found is written to
    the shared folder, and only documents with weak parts take part in the join.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = {name: F.concat(*[match_spans(F.col("text"), k, *p) for k, p in kinds.items()]) for name, kinds in (("base", BASE), ("weak", WEAK))}
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.select("id", F.coalesce(F.col("id").cast("string"), F.lit("\0")).alias("key"), F.xxhash64("text").alias("mark"), spans["base"].alias("base"), spans["weak"].alias("weak"))
    rows = materialize(rows, "spans")
    parts = rows.where((F.size("weak") > 0) & (F.size("base") + F.size("weak") > 1))
    parts = parts.select("key", "mark", F.explode(F.concat("base", "weak")).alias("s")).select("key", "mark", "s.*")
    linked = link_parts(parts, ["key", "mark"], scope).groupBy("key", "mark").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("linked"))
    out = rows.join(linked, ["key", "mark"], "left")
    return out.select(F.col("id").alias(id_col), F.array_sort("base").alias("base"), F.coalesce("linked", F.expr(f"cast(array() as {_SPAN})")).alias("linked"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column | str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
