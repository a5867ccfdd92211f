"""A corpus pipeline over ``documents``: five stages, each one operator of ``casekit.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result
as Parquet in the shared folder and hands the next stage what it reads back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from casekit.llm import decontam, langid, mixing, simhash, tokens
from casekit.llm._common import free_name, materialize, table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification does not reject; ``lang`` stays as given."""
    (name,) = free_name(docs, "language")
    model = langid.fit(docs)
    return langid.identify(docs, model, out_col=name).where(~F.col(name)["rejected"]).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-copies (five-word shingles, Jaccard similarity
    of 0.8 or more): that with the smallest doc_id."""
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # what is found has names of its own
    text = names[docs.columns.index("text")]
    found = decontam.find_contamination(docs.toDF(*names), table(spark, sf_dir, "benchmark"), text_col=text, keep=tuple(names))
    return found.where(~decontam.contaminated()).select(*names).toDF(*docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    copies = mixing.mix_documents(docs)
    return copies.select(*docs.columns)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the token ids as written, one row per copy."""
    return tokens.encode_to_directory(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_to_targets),
    ("token_output", write_token_ids),
]

#: No stage but one can be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
