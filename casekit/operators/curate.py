"""Curation: filters, backfill, de-duplication, labels, splits and guarded joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import parse_date
from ..functions.rules import decision_label, decision_summary, normalise_case_type
from ..functions.text import squeeze
from ..sources.shared import written
from ..vocabulary import COMMON_DROP, CUTOFFS, GOLD_DROP, GOLD_SIZE, IDENTIFYING_DROP, LABEL_COLUMNS


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise if a column is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def blank(text: Column) -> Column:
    """Null, or nothing but white space."""
    return F.coalesce(squeeze(text) == "", F.lit(True))


def keep_available(df: DataFrame, court: str = "tribunal", flag: str = "texto_integral_disponivel") -> DataFrame:
    """Rows of peace courts (``JP_``), and others whose availability flag is not null."""
    return df.where(F.coalesce(F.startswith(court, F.lit("JP_")), F.lit(False)) | F.col(flag).isNotNull())


def drop_unavailable(df: DataFrame, flag: str = "texto_integral_disponivel") -> DataFrame:
    """Rows whose flag is not ``N``; null stays."""
    return df.where(~F.col(flag).eqNullSafe("N"))


def require_decision(df: DataFrame, column: str = "decisao_extraida_do_texto_integral") -> DataFrame:
    return df.where(F.col(column).isNotNull())


def update_from(df: DataFrame, other: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``df`` with the values of ``other`` on the same key, where these are not null.
    Raises if a key stands more than once in ``other``, as the result would be undefined."""
    if not other.groupBy(key).count().where(F.col(key).isNotNull() & (F.col("count") > 1)).isEmpty():
        raise ValueError(f"{key} is not unique")
    new = other.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = df.join(new, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


def backfill_decisions(df: DataFrame, short: str = "decisao", long: str = "decisao_extraida_do_texto_integral") -> DataFrame:
    """A blank short decision becomes the rule's reading of the long one, which also goes
    to ``decisao_resumo_extraida``."""
    missing = blank(F.col(short))
    found = decision_summary(F.col(long))
    return df.withColumns({"decisao_resumo_extraida": F.when(missing, found), short: F.when(missing, found).otherwise(F.col(short))})


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key by ``order``; nulls are one key. A key with most of the
    rows is thinned to its least row by a partial aggregate, so it is no hot task."""
    rank = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, rank).alias("_row")).select("_row.*")


def views(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classification view, descriptive view): the first also drops what identifies."""
    return df.drop(*COMMON_DROP, *IDENTIFYING_DROP), df.drop(*COMMON_DROP)


def curate(df: DataFrame, order: Sequence[str] = ("_row_id",)) -> DataFrame:
    """All steps in their order: availability, backfill, unavailable, decision, first row
    of each case number. Views are taken from the result."""
    out = df.transform(keep_available).transform(backfill_decisions).transform(drop_unavailable).transform(require_decision)
    return keep_first(out, ["n_processo"], order)


def with_labels(df: DataFrame, case_type: str, column: str = "decisao") -> DataFrame:
    """The outcome label as a new column; rows without one are dropped."""
    case_type = normalise_case_type(case_type)
    name = LABEL_COLUMNS[case_type]
    return df.withColumn(name, decision_label(F.col(column), case_type)).where(F.col(name).isNotNull())


def profile_nulls(df: DataFrame, flag: str = "texto_integral_disponivel", decision: str = "decisao_extraida_do_texto_integral") -> DataFrame:
    """Shares of rows with a null flag, with ``N``, and with text but no decision."""
    odd = F.coalesce(F.col(flag) == "S", F.lit(False)) & F.col(decision).isNull()
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return df.agg(F.count("*").alias("n_rows"), share(F.col(flag).isNull()).alias("share_null"), share(F.col(flag).eqNullSafe("N")).alias("share_n"), share(odd).alias("share_no_decision"))


def validate_dataset(df: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Required columns and a unique id, or an error; then rows with text and label, text
    squeezed and not empty."""
    require_columns(df, [id_col, text_col, label_col])
    bad = df.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1))
    if not bad.isEmpty():
        raise ValueError(f"{id_col} has nulls or repeats")
    out = df.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).withColumn(text_col, squeeze(F.col(text_col)))
    return out.where(F.col(text_col) != "")


# Splits -------------------------------------------------------------------------------------


def gold_split(df: DataFrame, case_type: str, n: int = GOLD_SIZE, date_col: str = "data_acordao", tie: str = "_row_id", cutoff: str | None = None, keep_undated: bool = True) -> tuple[DataFrame, DataFrame]:
    """(gold, train): the ``n`` latest rows on or after the cutoff, ties by ``tie``; and all
    rows before it, with those without a date if ``keep_undated``. Later rows beyond ``n``
    are in neither. Fewer than ``n`` raise."""
    dated = df.withColumn("_acordao_date", parse_date(F.col(date_col)))
    edge = F.to_date(F.lit(cutoff or CUTOFFS[normalise_case_type(case_type)]))
    late = dated.where(F.col("_acordao_date") >= edge)
    found = late.count()
    if found < n:
        raise ValueError(f"Not enough cases on or after the cutoff: {found} of {n}")
    gold = late.orderBy(F.col("_acordao_date").desc(), F.col(tie).asc()).limit(n)
    early = F.col("_acordao_date") < edge
    train = dated.where(early | F.col("_acordao_date").isNull() if keep_undated else early)
    return gold, train


def gold_columns(df: DataFrame) -> DataFrame:
    """``df`` without provenance and helper columns."""
    return df.drop(*GOLD_DROP)


def attach_text(df: DataFrame, corpus: DataFrame, key: str = "url", text_col: str = "texto_integral_completo") -> DataFrame:
    """Left join of the text on ``key``, one to one: repeated keys on either side, missing
    columns and rows without a match raise, with examples."""
    require_columns(df, [key])
    require_columns(corpus, [key, text_col])
    wanted = corpus.join(df.select(key).distinct(), key, "left_semi").select(key, text_col)
    for side, name in ((df, "left"), (wanted, "right")):
        twice = [r[0] for r in side.groupBy(key).count().where("count > 1").orderBy(key).limit(5).collect()]
        if twice:
            raise ValueError(f"{key} repeats on the {name}: {twice}")
    lost = [r[0] for r in df.join(wanted, key, "left_anti").select(key).orderBy(key).limit(5).collect()]
    if lost:
        raise ValueError(f"no text for {lost}")
    return df.join(wanted, key, "left")


def select_ids(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the wanted ids, ids that no row has)."""
    wanted = ids.select(key).distinct()
    return df.join(wanted, key, "left_semi"), wanted.join(df, key, "left_anti")


def inner_or_raise(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join; nothing in common raises."""
    out = left.join(right, key)
    if out.isEmpty():
        raise RuntimeError(f"no {key} in common")
    return out


def disjoint(a: DataFrame, b: DataFrame, key: str) -> bool:
    return a.join(b.select(key).distinct(), key, "left_semi").isEmpty()


def fraction_split(df: DataFrame, order: Sequence[Column], ratio: float = 0.15, whole: Column | None = None) -> DataFrame:
    """``df`` with ``part``: the first ``floor(n * (1 - ratio))`` rows by ``order`` train,
    the others validate. The rank of a row counts over all, so the order must be total;
    undated rows sort last if the order says so.

    Ranks come from one sorted window per bucket of the leading order column's range and
    the buckets' counts, so that no task ranks all rows.
    """
    ranked = global_rank(df, order)
    n = df.count()
    return ranked.withColumn("part", F.when(F.col("_rank") <= int(n * (1 - ratio)), "train").otherwise("val")).drop("_rank")


def global_rank(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` with ``_rank``, the place of each row (from 1) by ``order`` over all rows.

    Rows are dealt out by ranges of the order, written, and numbered within their range;
    the counts of the ranges (one number for each task) give what to add. They are written
    as the bounds of ranges are drawn anew whenever rows are dealt out.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = sorted((r[0], r[1]) for r in dealt.groupBy("_part").count().collect())
    starts, at = {}, 0
    for part, n in counts:
        starts[part] = at
        at += n
    within = Window.partitionBy("_part").orderBy(*order)
    add = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])[F.col("_part")] if starts else F.lit(0)
    return dealt.withColumn("_rank", (F.row_number().over(within) + add).cast("long")).drop("_part")


def expanding_folds(df: DataFrame, order: Sequence[Column], k: int = 5) -> DataFrame:
    """``df`` times its folds: (fold, role, columns of ``df``). Fold i of ``k`` validates on
    the i-th of the last ``k`` blocks of ``n // (k + 1)`` rows and trains on all before it."""
    n = df.count()
    size = n // (k + 1)
    if size < 1:
        raise ValueError(f"{n} rows are too few for {k} folds")
    ranked = global_rank(df, order)
    fold = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    out = ranked.withColumn("fold", fold).withColumn("_start", F.lit(n) - (F.lit(k) - F.col("fold")) * size)
    role = F.when(F.col("_rank") <= F.col("_start"), "train").when(F.col("_rank") <= F.col("_start") + size, "val")
    return out.withColumn("role", role).where("role is not null").drop("_start", "_rank")


def bucket_by_date(df: DataFrame, date_col: str, cutoff: str) -> DataFrame:
    """``df`` with ``period``: before, from (the cutoff on) or undated."""
    when = parse_date(F.col(date_col))
    return df.withColumn("period", F.when(when.isNull(), "undated").when(when >= F.to_date(F.lit(cutoff)), "from").otherwise("before"))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, drawn by a hash of ``key``: reruns agree."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames; columns that one lacks are null there."""
    if not frames:
        raise ValueError("nothing to unite")
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def resolve_limit(wanted: object, total: int, default: int = 5) -> int:
    """``wanted`` as a number of rows, at most ``total``; ``default`` for what is none."""
    try:
        n = int(str(wanted).strip())
    except ValueError:
        n = default
    return max(0, min(n if n > 0 else default, total))


def first_rows(df: DataFrame, n: int, order: str = "_row_id") -> DataFrame:
    return df.orderBy(order).limit(n)


def over_splits(splits: dict[str, DataFrame], work) -> DataFrame:
    """``work`` on every named split, results united with the name in ``split``."""
    return union_all([work(df).withColumn("split", F.lit(name)) for name, df in splits.items()])


def epoch_order(df: DataFrame, key: str, epochs: int, seed: int = 42) -> DataFrame:
    """``df`` once per epoch with ``epoch`` (from 0) and ``place`` (long, from 1): a fixed
    shuffle, by a hash of seed, epoch and key; ties by key, rows of one key in any order.
    Places are total ranks over all epochs, less those of the epochs before, so that an
    epoch is not one task's."""
    n = df.count()
    each = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.col(key).cast("string")))
    ranked = global_rank(each.withColumn("_m", mark), [F.col("epoch"), F.col("_m"), F.col(key)])
    return ranked.withColumn("place", F.col("_rank") - F.col("epoch") * F.lit(n)).drop("_m", "_rank")


def exact_quantiles(df: DataFrame, by: str, value: str, shares: Sequence[float]) -> DataFrame:
    """(by, n, quantiles): exact percentiles of ``value`` (nulls left out) per group, by
    linear interpolation. Equal values are counted before they move; the values of a group
    are dealt out by ranges, and the counts of the ranges give every value's ranks, so that
    no task holds a group. A null group is a group."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    dealt = written(counts.repartitionByRange(parts, "_by", "_v").withColumn("_part", F.spark_partition_id()), "quantiles")
    sums = dealt.groupBy(F.col("_by").alias("_g"), F.col("_part").alias("_p")).agg(F.sum("_c").alias("_s"))
    earlier = Window.partitionBy("_g").orderBy("_p")
    sums = sums.select("_g", "_p", (F.sum("_s").over(earlier) - F.col("_s")).alias("_before"), F.sum("_s").over(Window.partitionBy("_g")).alias("_n"))
    ranked = dealt.join(sums, F.col("_by").eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy("_part", "_by").orderBy("_v"))
    ranked = ranked.select("_by", "_n", "_v", upto.alias("_b"), (upto - F.col("_c")).alias("_a"))
    at = [F.lit(float(q)) * (F.col("_n") - 1) for q in shares]
    ends = [end for x in at for end in (F.floor(x), F.ceil(x))]
    wanted = F.exists(F.array(*ends), lambda r: (F.col("_a") <= r) & (r < F.col("_b")))
    few = ranked.where(wanted).groupBy("_by").agg(F.first("_n").alias("_n"), F.collect_list(F.struct("_a", "_b", "_v")).alias("_r"))
    pick = lambda r: F.element_at(F.filter("_r", lambda x: (x["_a"] <= r) & (r < x["_b"])), 1)["_v"]
    values = [F.when(F.floor(x) == F.ceil(x), pick(F.floor(x))).otherwise((F.ceil(x) - x) * pick(F.floor(x)) + (x - F.floor(x)) * pick(F.ceil(x))) for x in at]
    return few.select(F.col("_by").alias(by), F.col("_n").alias("n"), F.array(*values).alias("quantiles"))
