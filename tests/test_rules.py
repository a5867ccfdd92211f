"""Label and summary rules on the phrases that fix them."""

import pytest
from pyspark.sql import functions as F

from casekit.functions import rules

CASES = [
    ("Recurso improcedente.", "DECISÃO MANTIDA", "DESFAVORÁVEL"),
    ("Negado provimento ao recurso.", "DECISÃO MANTIDA", "DESFAVORÁVEL"),
    ("Negado provimento.", "DECISÃO MANTIDA", "DESFAVORÁVEL"),
    ("Apelação improcedente.", "DECISÃO MANTIDA", "DESFAVORÁVEL"),
    ("Não provido.", "DECISÃO MANTIDA", "DESFAVORÁVEL"),
    ("Desprovido.", "DECISÃO MANTIDA", "DESFAVORÁVEL"),
    ("Não procede.", None, "DESFAVORÁVEL"),
    ("Recurso provido.", "DECISÃO ALTERADA", "FAVORÁVEL"),
    ("Decisão alterada.", "DECISÃO ALTERADA", None),
    ("Sentença revogada.", "DECISÃO ALTERADA", "FAVORÁVEL"),
    ("Procedente.", "DECISÃO ALTERADA", "FAVORÁVEL"),
    ("Provido parcialmente.", "DECISÃO ALTERADA", "PARCIAL"),
    ("Procedente em parte.", "DECISÃO ALTERADA", "PARCIAL"),
    ("Totalmente procedente.", "DECISÃO ALTERADA", "FAVORÁVEL"),
    ("Decisão mantida.", "DECISÃO MANTIDA", "DESFAVORÁVEL"),
    ("Sentença confirmada.", "DECISÃO MANTIDA", "DESFAVORÁVEL"),
    ("Parcialmente improcedente.", "DECISÃO MANTIDA", "DESFAVORÁVEL"),
    (None, None, None), ("", None, None), ("   ", None, None), ("O tribunal reuniu na terça-feira.", None, None),
]


def test_labels(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    got = df.select("i", rules.decision_label(F.col("t"), "dv"), rules.decision_label(F.col("t"), "ic")).orderBy("i").collect()
    assert [tuple(r[1:]) for r in got] == [c[1:] for c in CASES]


def test_summary(spark):
    rows = [None, "", "Recurso provido parcialmente.", "Recurso julgado procedente.", "Recurso negado.", "O tribunal reuniu na terça-feira.", "Negado provimento."]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    got = [r[1] for r in df.select("i", rules.decision_summary(F.col("t"))).orderBy("i").collect()]
    assert got == [None, None, "PARCIALMENTE PROCEDENTE", "REVOGADA", "NEGADO PROVIMENTO", None, "REVOGADA"]


def test_vocabularies(spark):
    df = spark.createDataFrame([(" decisão mantida ",), ("decisao_alterada",)], "t string")
    assert [r[0] for r in df.select(rules.canonical_label(F.col("t"), "dv")).collect()] == ["decisao_mantida", "decisao_alterada"]
    assert [r[0] for r in df.select(rules.label_code(F.col("t"), "dv")).collect()] == [0, None]
    with pytest.raises(Exception, match="unknown label"):
        df.select(rules.label_code(F.col("t"), "dv", strict=True)).collect()
    with pytest.raises(ValueError, match="case type"):
        rules.normalise_case_type("x")
