"""Schemas of raw records and of the tables made from them."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType


def _text(*names: str) -> list[StructField]:
    return [StructField(n, StringType()) for n in names]


METADATA = StructType([
    *_text("extraction_method", "confidence", "keyword_found"), StructField("requires_manual_review", BooleanType()),
    *_text("review_reason", "document_position"),
])
RAW = StructType([
    *_text("url", "tribunal", "tipo_direito", "tipo_caso", "n_processo", "juiz_relator", "data_acordao"),
    StructField("descritores", ArrayType(StringType())),
    *_text("votacao", "meio_processual", "decisao", "sumario", "texto_integral_disponivel", "texto_integral_completo",
           "decisao_extraida_do_texto_integral", "texto_integral_sem_decisao"),
    StructField("metadata_decisao", METADATA),
])
