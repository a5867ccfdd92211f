"""Queries on case records: filters, labels, splits, joins, shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.rules import decision_label, decision_summary, label_code, label_hits
from ..operators import curate, profile
from .stand_ins import BINARY_SQL, CASES_SQL, DAY_SQL, SUMMARY_SQL, TERNARY_SQL, cases, table

BINARY = ["DECISÃO MANTIDA", "DECISÃO ALTERADA"]
_C = f"with cases as ({CASES_SQL})"
_L = f"{_C}, labelled as (select * from (select *, {BINARY_SQL} as label, {DAY_SQL} as day from cases) where label is not null)"


def _labelled(spark, sf_dir):
    return curate.with_labels(cases(spark, sf_dir), "dv").withColumn("day", parse_date(F.col("data_acordao")))


def label_distribution_by_year(spark, sf_dir):
    rows = _labelled(spark, sf_dir).withColumn("year", F.year("day"))
    out = profile.row_shares(rows, "year", "decisao_binaria", BINARY, "year")
    return out.select("year", "n", F.round(BINARY[0], 6).alias("kept"), F.round(BINARY[1], 6).alias("altered"))


def class_profile(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    out = profile.class_shares(rows, "decisao_binaria")
    return out.select("decisao_binaria", "n", F.round("share", 6).alias("share"))


def class_by_group_share(spark, sf_dir):
    out = profile.shares_by_court(_labelled(spark, sf_dir), "tribunal", "decisao_binaria", BINARY)
    return out.select("court", "shown", "n", F.round(BINARY[0], 6).alias("kept"), F.round(BINARY[1], 6).alias("altered"))


def cases_per_year(spark, sf_dir):
    return profile.counts_by(cases(spark, sf_dir), F.year(parse_date(F.col("data_acordao"))), "year")


def label_ternary_counts(spark, sf_dir):
    rows = curate.with_labels(cases(spark, sf_dir), "boc")
    return rows.groupBy("decisao_ternaria", label_code(F.col("decisao_ternaria"), "boc").alias("code")).agg(F.count("*").alias("n"))


def label_vocabulary_hits(spark, sf_dir):
    hits = label_hits(F.col("label"))
    label = F.when(F.col("_row_id") % 3 == 0, F.lower("decisao_binaria")).when(F.col("_row_id") % 3 == 1, " parcial ").otherwise(F.col("decisao_binaria"))
    return _labelled(spark, sf_dir).withColumn("label", label).agg(hits["dv"].alias("dv_hits"), hits["boc"].alias("boc_hits"))


def decision_rules(spark, sf_dir):
    d, long = F.col("decisao"), F.col("decisao_extraida_do_texto_integral")
    out = cases(spark, sf_dir).select("_row_id", decision_summary(long).alias("summary"), decision_label(d, "dv").alias("two"), decision_label(d, "boc").alias("three"))
    return out


def decision_backfill(spark, sf_dir):
    return curate.backfill_decisions(cases(spark, sf_dir)).groupBy("decisao", "decisao_resumo_extraida").agg(F.count("*").alias("n"))


def peace_court_filter(spark, sf_dir):
    return curate.keep_available(cases(spark, sf_dir)).groupBy("tribunal", "texto_integral_disponivel").agg(F.count("*").alias("n"))


def null_safe_not_n(spark, sf_dir):
    return curate.drop_unavailable(cases(spark, sf_dir)).groupBy("texto_integral_disponivel").agg(F.count("*").alias("n"))


def dedupe_keep_first(spark, sf_dir):
    return curate.keep_first(cases(spark, sf_dir), ["n_processo"], ["_row_id"]).select("n_processo", "_row_id", "tribunal")


def curation_chain(spark, sf_dir):
    return curate.curate(cases(spark, sf_dir)).select("_row_id", "n_processo", "tribunal", "decisao")


def profile_nulls(spark, sf_dir):
    out = curate.profile_nulls(cases(spark, sf_dir))
    return out.select("n_rows", *[F.round(c, 6).alias(c) for c in ("share_null", "share_n", "share_no_decision")])


def temporal_gold_test(spark, sf_dir):
    gold, _ = curate.gold_split(cases(spark, sf_dir), "dv", cutoff="1998-01-01")
    return gold.select("_row_id", "data_acordao")


def temporal_train_pool(spark, sf_dir):
    _, train = curate.gold_split(cases(spark, sf_dir), "dv", cutoff="1998-01-01")
    return train.agg(F.count("*").alias("n"), F.count_if(F.col("_acordao_date").isNull()).alias("undated"), F.sum("_row_id").alias("sum_ids"))


def date_buckets(spark, sf_dir):
    return curate.bucket_by_date(cases(spark, sf_dir), "data_acordao", "1998-01-01").groupBy("period").agg(F.count("*").alias("n"))


def split_fraction(spark, sf_dir):
    rows = cases(spark, sf_dir).withColumn("day", parse_date(F.col("data_acordao")))
    out = curate.fraction_split(rows, [F.col("day").asc_nulls_last(), F.col("_row_id").asc()])
    return out.groupBy("part").agg(F.count("*").alias("n"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"), F.sum("_row_id").alias("sum_ids"))


def expanding_cv_folds(spark, sf_dir):
    rows = cases(spark, sf_dir).withColumn("day", parse_date(F.col("data_acordao"))).select("_row_id", "day")
    out = curate.expanding_folds(rows, [F.col("day").asc_nulls_last(), F.col("_row_id").asc()])
    return out.groupBy("fold", "role").agg(F.count("*").alias("n"), F.sum("_row_id").alias("sum_ids"))


def attach_text_left_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url"), "text")
    marked = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("url"), "quality")
    return curate.attach_text(marked, docs, "url", "text").select("url", "quality", F.md5("text").alias("text_md5"))


def update_coalesce_join(spark, sf_dir):
    left = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    right = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "flagged").alias("source"))
    return curate.update_from(left, right, "doc_id", ["source"])


def semi_ids(spark, sf_dir):
    found, missing = curate.select_ids(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")
    return found.agg(F.count("*").alias("n_found"), F.sum("doc_id").alias("sum_ids"), F.lit(missing.count()).alias("n_missing"))


def anti_resume(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return table(spark, sf_dir, "documents").join(done, "doc_id", "left_anti").select("doc_id", "lang")


def sample_without_replacement(spark, sf_dir):
    return curate.sample_rows(table(spark, sf_dir, "documents").select("doc_id", "lang"), 100, "doc_id")


def gender_shares(spark, sf_dir):
    names = spark.createDataFrame([("1-urgent", "male"), ("2-high", "mostly_female"), ("5-low", "andy")], "name string, gender string")
    rows = profile.with_gender(_labelled(spark, sf_dir), names)
    out = profile.row_shares(rows, "judge_gender", "decisao_binaria", BINARY, "judge_gender")
    return out.select("judge_gender", "n", F.round(BINARY[0], 6).alias("kept"), F.round(BINARY[1], 6).alias("altered"))


def year_box_by_class(spark, sf_dir):
    rows = _labelled(spark, sf_dir).withColumn("year", F.year("day"))
    return profile.box_statistics(rows, "decisao_binaria", "year")


_SHARE = "round(100.0 * count(*) filter (label = '{}') / count(*), 6)"
_TWO = f"{_SHARE.format(BINARY[0])} as kept, {_SHARE.format(BINARY[1])} as altered"

PAIRS = {
    "label_distribution_by_year": (label_distribution_by_year, f"{_L} select year(day)::int as year, count(*) as n, {_TWO} from labelled where day is not null group by 1"),
    "class_profile": (class_profile, f"{_L} select label as decisao_binaria, count(*) as n, round(count(*) / sum(count(*)) over (), 6)::double as share from labelled group by 1"),
    "class_by_group_share": (class_by_group_share, f"{_L} select court, court || ' (n=' || n || ')' as shown, n, kept, altered from (select case when tribunal like 'JP%' then 'JP' else tribunal end as court, count(*) as n, {_TWO} from labelled where tribunal is not null group by 1)"),
    "cases_per_year": (cases_per_year, f"{_C} select year({DAY_SQL})::int as year, count(*) as n from cases where {DAY_SQL} is not null group by 1"),
    "label_ternary_counts": (label_ternary_counts, f"{_C} select l as decisao_ternaria, case l when 'DESFAVORÁVEL' then 0 when 'PARCIAL' then 1 else 2 end as code, count(*) as n from (select {TERNARY_SQL} as l from cases) where l is not null group by 1, 2"),
    "label_vocabulary_hits": (label_vocabulary_hits, f"{_L} select count(*) filter (_row_id % 3 <> 1) as dv_hits, count(*) filter (_row_id % 3 = 1) as boc_hits from labelled"),
    "decision_rules": (decision_rules, f"{_C} select _row_id, {SUMMARY_SQL} as summary, {BINARY_SQL} as two, {TERNARY_SQL} as three from cases"),
    "decision_backfill": (decision_backfill, f"{_C} select case when b then s else decisao end as decisao, case when b then s end as decisao_resumo_extraida, count(*) as n from (select decisao, coalesce(trim(decisao) = '', true) as b, {SUMMARY_SQL} as s from cases) group by 1, 2"),
    "peace_court_filter": (peace_court_filter, f"{_C} select tribunal, texto_integral_disponivel, count(*) as n from cases where coalesce(tribunal like 'JP\\_%' escape '\\', false) or texto_integral_disponivel is not null group by 1, 2"),
    "null_safe_not_n": (null_safe_not_n, f"{_C} select texto_integral_disponivel, count(*) as n from cases where texto_integral_disponivel is distinct from 'N' group by 1"),
    "dedupe_keep_first": (dedupe_keep_first, f"{_C} select n_processo, _row_id, tribunal from cases qualify row_number() over (partition by n_processo order by _row_id) = 1"),
    "curation_chain": (curation_chain, f"""{_C}, a as (select *, coalesce(trim(decisao) = '', true) as b, {SUMMARY_SQL} as s from cases where coalesce(tribunal like 'JP\\_%' escape '\\', false) or texto_integral_disponivel is not null),
      f as (select * from a where texto_integral_disponivel is distinct from 'N' and decisao_extraida_do_texto_integral is not null)
      select _row_id, n_processo, tribunal, case when b then s else decisao end as decisao from f qualify row_number() over (partition by n_processo order by _row_id) = 1"""),
    "profile_nulls": (profile_nulls, f"{_C} select count(*) as n_rows, round(avg((texto_integral_disponivel is null)::int), 6) as share_null, round(avg((texto_integral_disponivel is not distinct from 'N')::int), 6) as share_n, round(avg((coalesce(texto_integral_disponivel = 'S', false) and decisao_extraida_do_texto_integral is null)::int), 6) as share_no_decision from cases"),
    "temporal_gold_test": (temporal_gold_test, f"{_C} select _row_id, data_acordao from cases where {DAY_SQL} >= date '1998-01-01' order by {DAY_SQL} desc, _row_id limit 50"),
    "temporal_train_pool": (temporal_train_pool, f"{_C} select count(*) as n, count(*) filter (day is null) as undated, sum(_row_id)::bigint as sum_ids from (select *, {DAY_SQL} as day from cases) where day < date '1998-01-01' or day is null"),
    "date_buckets": (date_buckets, f"{_C} select case when day is null then 'undated' when day >= date '1998-01-01' then 'from' else 'before' end as period, count(*) as n from (select {DAY_SQL} as day from cases) group by 1"),
    "split_fraction": (split_fraction, f"{_C}, r as (select *, row_number() over (order by day nulls last, _row_id) as k, count(*) over () as m from (select _row_id, {DAY_SQL} as day from cases)) select case when k <= floor(m * 0.85) then 'train' else 'val' end as part, count(*) as n, min(day)::varchar as first_day, max(day)::varchar as last_day, sum(_row_id)::bigint as sum_ids from r group by 1"),
    "expanding_cv_folds": (expanding_cv_folds, f"{_C}, r as (select *, row_number() over (order by day nulls last, _row_id) as k, count(*) over () as m from (select _row_id, {DAY_SQL} as day from cases)), f as (select *, m - (5 - fold) * (m // 6) as s, m // 6 as t from r, (select unnest(range(5))::int as fold)) select fold, case when k <= s then 'train' else 'val' end as role, count(*) as n, sum(_row_id)::bigint as sum_ids from f where k <= s + t group by 1, 2"),
    "attach_text_left_join": (attach_text_left_join, "select l.doc_id::varchar as url, quality, md5(text) as text_md5 from labels l left join documents d on l.doc_id = d.doc_id"),
    "update_coalesce_join": (update_coalesce_join, "select d.doc_id, lang, coalesce(case when toxic = 1 then 'flagged' end, source) as source from documents d left join labels l on d.doc_id = l.doc_id"),
    "semi_ids": (semi_ids, "select count(*) as n_found, sum(doc_id)::bigint as sum_ids, (select count(distinct doc_id) from labels where quality = 1 and doc_id not in (select doc_id from documents))::int as n_missing from documents where doc_id in (select doc_id from labels where quality = 1)"),
    "anti_resume": (anti_resume, "select doc_id, lang from documents where doc_id not in (select doc_id from labels)"),
    "sample_without_replacement": (sample_without_replacement, "select doc_id, lang from documents order by md5('42|' || doc_id), doc_id limit 100"),
    "gender_shares": (gender_shares, f"{_L} select judge_gender, count(*) as n, {_TWO} from (select *, case when lower(split_part(juiz_relator, ' ', 1)) = '1-urgent' then 'Male' when lower(split_part(juiz_relator, ' ', 1)) = '2-high' then 'Female' else 'Unknown' end as judge_gender from labelled) group by 1"),
    "year_box_by_class": (year_box_by_class, f"{_L}, y as (select label, year(day)::double as v from labelled where day is not null), q as (select label, count(*) as n, min(v) as low, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.75) as q3, max(v) as high from y group by 1) select q.label as decisao_binaria, any_value(n) as n, any_value(low) as low, any_value(q1) as q1, any_value(median) as median, any_value(q3) as q3, any_value(high) as high, min(v) filter (v >= q1 - 1.5 * (q3 - q1)) as whisker_low, max(v) filter (v <= q3 + 1.5 * (q3 - q1)) as whisker_high from q join y on q.label = y.label group by 1"),
}
