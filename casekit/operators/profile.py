"""Descriptive tables: counts, shares, drift, lengths, terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import clean_basic, first_name, ngrams, sentences, words
from ..sources.shared import written
from .curate import exact_quantiles

#: Classes, and terms of very many documents, that may go to all tasks.
_CLASSES, _HOT_TERMS = 100_000, 100_000
#: What a missing text is shown as.
_NULL_TEXT = "nan"


def counts_by(df: DataFrame, key: Column | str, name: str = "key") -> DataFrame:
    """(name, n): rows per value; null values are left out."""
    key = F.col(key) if isinstance(key, str) else key
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n")).where(F.col(name).isNotNull())


def class_shares(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share): share of the labelled rows. One row per class is summed up."""
    counts = counts_by(df, label, label)
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def row_shares(df: DataFrame, row: Column | str, label: str, labels: Sequence[str], name: str = "row") -> DataFrame:
    """Cross table in row percentages: (name, n, one column per label); missing cells are
    0, null rows and labels that are not listed are left out."""
    row = F.col(row) if isinstance(row, str) else row
    known = df.where(F.col(label).isin(*labels)).withColumn(name, row).where(F.col(name).isNotNull())
    table = known.groupBy(name).pivot(label, list(labels)).agg(F.count(F.lit(1))).na.fill(0, list(labels))
    total = sum((F.col(f"`{x}`") for x in labels), F.lit(0))
    return table.select(name, total.alias("n"), *[(F.lit(100.0) * F.col(f"`{x}`") / total).alias(x) for x in labels])


def box_statistics(df: DataFrame, label: str, value: Column | str) -> DataFrame:
    """(label, n, low, q1, median, q3, high, whisker_low, whisker_high), exact percentiles
    by linear interpolation. Whiskers end at the last values within 1.5 ranges. Raises for
    more than 100,000 classes, whose bounds go to all tasks."""
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(F.col(label), value.cast("double").alias("v")).where(F.col(label).isNotNull() & F.col("v").isNotNull())
    q = exact_quantiles(rows, label, "v", (0.0, 0.25, 0.5, 0.75, 1.0))
    q = written(q.select(label, "n", *[F.col("quantiles")[i].alias(x) for i, x in enumerate(("low", "q1", "median", "q3", "high"))]), "boxes")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    if q.count() > _CLASSES:
        raise ValueError(f"more than {_CLASSES} classes")
    near = rows.join(F.broadcast(q), label)  # one row a class
    ends = near.groupBy(label).agg(F.min(F.when(F.col("v") >= F.col("q1") - reach, F.col("v"))).alias("whisker_low"), F.max(F.when(F.col("v") <= F.col("q3") + reach, F.col("v"))).alias("whisker_high"))
    return q.join(ends, label)


def text_metrics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with clean_text, raw_length, clean_length, word_count and sentence_count. The
    raw length of a null is that of the text it is shown as."""
    text = F.col(text_col)
    clean = clean_basic(text)
    return df.withColumns({
        "clean_text": clean, "raw_length": F.coalesce(F.length(text), F.lit(len(_NULL_TEXT))), "clean_length": F.length(clean),
        "word_count": F.size(words(clean)), "sentence_count": F.size(sentences(text, 1)),
    })


def top_terms(df: DataFrame, label: str, terms: Column, n: int = 20) -> DataFrame:
    """(label, term, freq, rank): the most frequent terms of each class, ties by the term."""
    counted = df.select(F.col(label), F.explode(terms).alias("term")).where(F.col(label).isNotNull()).groupBy(label, "term").agg(F.count("*").alias("freq"))
    return _top(counted, label, "freq", n)


def _top(counted: DataFrame, label: str, value: str, n: int) -> DataFrame:
    """The first ``n`` terms of each class. Classes are few: terms are thinned to the best
    ``n`` of each of many shares of a class before they meet."""
    share = F.pmod(F.xxhash64("term"), F.lit(64))
    best = lambda *by: Window.partitionBy(label, *by).orderBy(F.col(value).desc(), F.col("term").asc())
    thin = counted.withColumn("_share", share).withColumn("_r", F.row_number().over(best("_share"))).where(F.col("_r") <= n)
    return thin.withColumn("rank", F.row_number().over(best())).where(F.col("rank") <= n).select(label, "term", value, "rank")


def top_ngrams(df: DataFrame, label: str, tokens: Column, size: int, n: int = 20) -> DataFrame:
    return top_terms(df, label, ngrams(tokens, size), n)


def top_tfidf(df: DataFrame, label: str, doc: str, tokens: Column, n: int = 20) -> DataFrame:
    """(label, term, score, rank): mean over the documents of a class of each term's share
    in the document's unit vector of count * (ln((1 + docs) / (1 + docs with it)) + 1),
    fitted on the class; documents without terms count in the mean."""
    rows = df.where(F.col(label).isNotNull()).select(F.col(label), F.col(doc).alias("_doc"), tokens.alias("_tokens"))
    docs = rows.groupBy(label).agg(F.count("*").alias("_n"))
    tf = written(rows.select(label, "_doc", F.explode("_tokens").alias("term")).groupBy(label, "_doc", "term").agg(F.count("*").alias("tf")), "tf")
    df_ = written(tf.groupBy(label, "term").agg(F.count("*").alias("_df")), "df")
    idf = df_.join(docs, label).select(label, "term", "_n", "_df", (F.log((1.0 + F.col("_n")) / (1.0 + F.col("_df"))) + 1.0).alias("idf"))
    # Terms of very many documents are few: they go to all tasks, the others are dealt out.
    hot = F.col("_df") > max(1000, (df_.agg(F.sum("_df")).first()[0] or 0) // _HOT_TERMS)
    known = F.broadcast(idf.where(hot).select(label, "term", "_n", "idf"))
    rest = tf.join(known.select(label, "term"), [label, "term"], "left_anti").join(idf.where(~hot).select(label, "term", "_n", "idf"), [label, "term"])
    raw = tf.join(known, [label, "term"]).unionByName(rest).withColumn("w", F.col("tf") * F.col("idf"))
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(label, "_doc")))
    mean = raw.withColumn("w", F.col("w") / size).groupBy(label, "term").agg((F.sum("w") / F.first("_n")).alias("score"))
    return _top(mean.withColumn("score", F.round("score", 9)), label, "score", n)


def court_group(court: Column) -> Column:
    """The court, peace courts as one."""
    return F.when(F.startswith(court, F.lit("JP")), "JP").otherwise(court)


def shares_by_court(df: DataFrame, court: str, label: str, labels: Sequence[str]) -> DataFrame:
    """Row shares by court with its number of cases as ``n`` and in ``shown``."""
    out = row_shares(df, court_group(F.col(court)), label, labels, "court")
    return out.withColumn("shown", F.concat("court", F.lit(" (n="), F.col("n").cast("string"), F.lit(")")))


def with_gender(df: DataFrame, names: DataFrame, column: str = "juiz_relator") -> DataFrame:
    """``df`` with judge_first_name, judge_gender_raw and judge_gender by a lookup table
    ``names`` (name, gender); unknown names are Unknown. Descriptive only."""
    keyed = df.withColumn("judge_first_name", first_name(F.col(column)))
    look = names.select(F.lower("name").alias("judge_first_name"), F.col("gender").alias("judge_gender_raw")).dropDuplicates(["judge_first_name"])
    raw = F.coalesce("judge_gender_raw", F.lit("unknown"))
    joined = keyed.join(look, "judge_first_name", "left").withColumn("judge_gender_raw", raw)
    simple = F.when(F.col("judge_gender_raw").isin("male", "mostly_male"), "Male").when(F.col("judge_gender_raw").isin("female", "mostly_female"), "Female").otherwise("Unknown")
    return joined.withColumn("judge_gender", simple)


def normalised(df: DataFrame, value: str, out: str = "normalised") -> DataFrame:
    """``df`` with min-max normalised values; 1 where all are equal."""
    low, high = df.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    spread = F.lit(1.0) if low == high else (F.col(value) - F.lit(low)) / F.lit(high - low)
    return df.withColumn(out, F.when(F.col(value).isNotNull(), spread))
