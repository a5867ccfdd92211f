"""Annotation services as tables: matrices, state, progress, assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

FIELDS = ("decision", "confidence", "justification")
TRUE_WORDS = ("1", "true", "sim", "yes")


def assign_branch(user: Column) -> Column:
    """``dv`` or ``ic``: by the prefix of the trimmed upper-case name, else by the parity of
    the first byte of its SHA-256."""
    name = F.upper(F.trim(user))
    even = F.pmod(F.conv(F.substring(F.sha2(name, 256), 1, 2), 16, 10).cast("int"), F.lit(2)) == 0
    return F.when(F.startswith(name, F.lit("J_DV_")), "dv").when(F.startswith(name, F.lit("J_IC_")), "ic").when(even, "dv").otherwise("ic")


def case_order(cases: DataFrame, id_col: str, user: Column, branch: Column) -> DataFrame:
    """``cases`` (one row per user and case) with ``place``, a fixed shuffle per user and
    branch: by the SHA-256 of user, branch and case."""
    mark = F.sha2(F.concat_ws("|", F.trim(user), branch, F.col(id_col).cast("string")), 256)
    return cases.withColumn("_m", mark).withColumn("place", F.row_number().over(Window.partitionBy(user, branch).orderBy("_m", id_col))).drop("_m")


def matrix_to_long(matrix: DataFrame, id_col: str, field: str) -> DataFrame:
    """(id, judge, field, value) of a matrix with one column per judge."""
    judges = [c for c in matrix.columns if c != id_col]
    return matrix.unpivot(id_col, judges, "judge", "value").select(id_col, "judge", F.lit(field).alias("field"), F.coalesce("value", F.lit("")).alias("value"))


def long_to_matrix(long: DataFrame, base: DataFrame, id_col: str, field: str, judges: Sequence[str]) -> DataFrame:
    """One row per distinct, non-blank case of ``base`` and one column per judge, empty
    where nothing was answered."""
    ids = base.where(F.coalesce(F.trim(id_col) != "", F.lit(False))).select(id_col).distinct()
    cells = long.where(F.col("field") == field).groupBy(id_col).pivot("judge", list(judges)).agg(F.max("value"))
    return ids.join(cells, id_col, "left").na.fill("", list(judges))


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` with the changes' values that are not null, and new rows; keys are unique
    on each side. Columns are those of ``table``."""
    fields = [c for c in table.columns if c not in keys]
    new = changes.select(*keys, *[(F.col(c) if c in changes.columns else F.lit(None).cast(table.schema[c].dataType)).alias(f"_{c}") for c in fields])
    joined = table.join(new, list(keys), "full_outer")
    return joined.select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in fields])


def answered() -> Column:
    """Whether decision and confidence are both filled."""
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return filled("decision") & filled("confidence")


def progress(responses: DataFrame, by: Sequence[str] = ("judge",)) -> DataFrame:
    """(by, total, done, ratio): answered cases; a ratio of 0 for none."""
    out = responses.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(answered()).alias("done"))
    return out.withColumn("ratio", F.when(F.col("total") > 0, F.col("done") / F.col("total")).otherwise(F.lit(0.0)))


def pending(responses: DataFrame, by: Sequence[str] = ("judge",), place: str = "place") -> DataFrame:
    """(by, first_incomplete, pending): the first open place (0 if none), and all of them."""
    open_ = F.when(~answered(), F.col(place))
    return responses.groupBy(*by).agg(F.coalesce(F.min(open_), F.lit(0)).alias("first_incomplete"), F.array_sort(F.collect_list(open_)).alias("pending"))


def parse_state(df: DataFrame, flag: str = "finalizado", stamps: Sequence[str] = ("finalizado_em", "ultima_gravacao_em")) -> DataFrame:
    """State rows with a boolean flag (1, true, sim, yes) and stamps that are never null."""
    true = F.coalesce(F.lower(F.trim(F.col(flag).cast("string"))).isin(*TRUE_WORDS), F.lit(False))
    return df.withColumns({flag: true, **{s: F.coalesce(F.col(s), F.lit("")) if s in df.columns else F.lit("") for s in stamps}})
