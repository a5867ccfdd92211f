"""Judgment-like columns derived from the star schema, in both engines alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..vocabulary import BINARY_RULES, SUMMARY_RULES, TERNARY_RULES

PHRASES = (
    "Negado provimento ao recurso.", "Recurso provido.", "Provido parcialmente.", "Sentença revogada.", "Não procede.",
    "Totalmente procedente.", "Decisão mantida.", "Parcialmente improcedente.", "O tribunal reuniu na terça-feira.",
    "Recurso procedente em parte.", "Apelação improcedente.", "Julgada improcedência total.", None,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def phrase() -> Column:
    out = F.lit(None).cast("string")
    for i, p in enumerate(PHRASES):
        out = F.when(F.pmod("o_orderkey", F.lit(len(PHRASES))) == i, F.lit(p)).otherwise(out)
    return out


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as case records: _row_id, url, n_processo, tribunal, data_acordao, …"""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    day = F.when(key % 11 == 0, None).when(key % 7 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "dd-MM-yyyy"))
    return o.select(
        key.alias("_row_id"), F.concat(F.lit("http://c/"), key.cast("string")).alias("url"),
        F.when(key % 17 == 0, None).otherwise(F.concat((key % 4000).cast("string"), F.lit("/20"))).alias("n_processo"),
        F.when(key % 13 == 0, None).when(key % 5 == 0, "JP_LISBOA").when(key % 5 == 1, "TRP").when(key % 5 == 2, "TRL").otherwise("TRC").alias("tribunal"),
        F.when(key % 3 == 0, "S").when(key % 3 == 1, "N").alias("texto_integral_disponivel"),
        day.alias("data_acordao"), F.when(key % 6 == 0, " ").otherwise(phrase()).alias("decisao"),
        F.when(key % 4 == 0, None).otherwise(phrase()).alias("decisao_extraida_do_texto_integral"),
        F.col("o_totalprice").alias("preco"), F.concat(F.col("o_orderpriority"), F.lit(" X")).alias("juiz_relator"),
    )


def _sql_text(x: str | None) -> str:
    return "null" if x is None else "'" + x.replace("'", "''") + "'"


_PHRASE_SQL = f"case o_orderkey % {len(PHRASES)} " + " ".join(f"when {i} then {_sql_text(p)}" for i, p in enumerate(PHRASES)) + " end"

CASES_SQL = f"""select o_orderkey as _row_id, 'http://c/' || o_orderkey as url,
  case when o_orderkey % 17 = 0 then null else (o_orderkey % 4000) || '/20' end as n_processo,
  case when o_orderkey % 13 = 0 then null when o_orderkey % 5 = 0 then 'JP_LISBOA' when o_orderkey % 5 = 1 then 'TRP' when o_orderkey % 5 = 2 then 'TRL' else 'TRC' end as tribunal,
  case when o_orderkey % 3 = 0 then 'S' when o_orderkey % 3 = 1 then 'N' end as texto_integral_disponivel,
  case when o_orderkey % 11 = 0 then null when o_orderkey % 7 = 0 then strftime(o_orderdate, '%d/%m/%Y') else strftime(o_orderdate, '%d-%m-%Y') end as data_acordao,
  case when o_orderkey % 6 = 0 then ' ' else {_PHRASE_SQL} end as decisao,
  case when o_orderkey % 4 = 0 then null else {_PHRASE_SQL} end as decisao_extraida_do_texto_integral,
  o_totalprice as preco, o_orderpriority || ' X' as juiz_relator from orders"""

DAY_SQL = "coalesce(try_strptime(data_acordao, '%d-%m-%Y'), try_strptime(data_acordao, '%d/%m/%Y'))::date"


def clean_sql(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')"


def rules_sql(x: str, rules) -> str:
    """CASE WHEN of ordered rules for an engine without look-around or Unicode word ends:
    a cleaned text has only words and white space."""
    import re

    arms = []
    for label, patterns in rules:
        alts = []
        for p in patterns:
            p = re.sub(r"\(\?!.*\)$", "", p)
            open_end = not p.endswith(r"\b")
            core = p.removeprefix(r"\b").removesuffix(r"\b")
            alts.append(rf"(^|\s){core}" + ("" if open_end else r"(\s|$)"))
        arms.append(f"when regexp_matches({clean_sql(x)}, '{'|'.join(alts)}') then '{label}'")
    return "case " + " ".join(arms) + " end"


BINARY_SQL = rules_sql("decisao", BINARY_RULES)
TERNARY_SQL = rules_sql("decisao", TERNARY_RULES)
SUMMARY_SQL = rules_sql("decisao_extraida_do_texto_integral", SUMMARY_RULES)
