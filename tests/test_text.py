from pyspark.sql import functions as F

from casekit.functions import dates, text as t, vectors as v
from casekit.operators import prompts


def one(spark, *cols, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(*cols).first()


def test_cleaning(spark):
    got = one(spark, t.clean_basic(F.col("x")), t.clean_advanced(F.col("x")), t.clean_basic(F.lit(None)), x="Improcedência!  Art. 5º, a b 12 fim")
    assert tuple(got) == ("improcedência art 5º a b 12 fim", "improcedência art fim", "")


def test_sentences_and_ngrams(spark):
    got = one(spark, t.sentences(F.col("x")), t.ngrams(F.split(F.lit("a b c"), " "), 2), t.ngrams(F.split(F.lit("a"), " "), 2), x="Primeira frase. Segunda: curta; terceira  frase!")
    assert got[0] == ["Primeira frase.", "Segunda:", "terceira frase!"]
    assert (got[1], got[2]) == (["a b", "b c"], [])


def test_truncation(spark):
    text = "a" * 3000 + "b" * 3000
    got = one(spark, t.truncate_middle(F.col("x"), 200).alias("c"), t.truncate_middle(F.lit("ab"), 200).alias("d"), t.truncate_middle(F.col("x"), 5).alias("e"), x=text)
    room = 800 - len(t.TRUNCATION_MARK)
    head = int(room * 0.55)
    assert got.c.text == "a" * head + t.TRUNCATION_MARK + "b" * (room - head) and got.c.truncated
    assert (got.d.text, got.d.truncated, got.e.text) == ("ab", False, "a" * 20)


def test_thinking(spark):
    raw = "<think> one </think>A<THINKING>two</THINKING> \n"
    got = one(spark, t.strip_thinking(F.col("x")), t.thinking(F.col("x")), t.compose_output(F.lit("c"), F.lit("r")), t.compose_output(F.col("x"), F.lit("r")), x=raw)
    assert tuple(got) == ("A", "one\n\ntwo", "<think>r</think>\nc", raw)


def test_dates_and_names(spark):
    df = spark.createDataFrame([("01-06-2025",), ("28/05/2002",), ("x",), (None,), ("31-02-2020",)], "d string")
    assert [str(r[0]) for r in df.select(dates.parse_date(F.col("d"))).collect()] == ["2025-06-01", "2002-05-28", "None", "None", "None"]
    got = one(spark, t.first_name(F.lit(" ANA. Maria ")), t.first_name(F.lit(" . ")), t.safe_name(F.lit('a/b:c?"')), t.display_label(F.lit("x" * 95)))
    assert tuple(got) == ("ana", None, "a_b_c__", "x" * 87 + "…")


def test_vectors(spark):
    got = one(
        spark, v.rank_weights(F.lit(3)), v.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))), v.softmax(F.array(F.lit(0.0), F.lit(0.0))),
        v.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))), v.smoothed(F.lit(None).cast("int"), 3), v.centroid(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(6.0)))),
    )
    assert [round(x, 6) for x in got[0]] == [0.545455, 0.272727, 0.181818]
    assert tuple(got[1:4]) == (0.0, [0.5, 0.5], 1) and got[4] == [0.9, 0.05, 0.05] and got[5] == [2.0, 4.0]


def test_prompts(spark):
    row = spark.createDataFrame([("1/20", "texto", [("2/20", "t2", ["s1", "s2"], "decisao_mantida")])], "id string, text string, ex array<struct<n_processo:string,text:string,selected_sentences:array<string>,label:string>>")
    built = row.select(prompts.messages("dv", prompts.user_message(F.col("id"), F.col("text")), F.col("ex"))).first()[0]
    assert [m.role for m in built] == ["system", "user"]
    assert built[1].content.startswith("Aqui estão 1 exemplos") and "- s1\n- s2" in built[1].content
    assert built[1].content.endswith("Agora classifica este processo:\n\nProcesso: 1/20\n\nTexto da decisão:\ntexto")
    out = row.withColumn("text", F.repeat(F.lit("palavra "), 2000)).transform(prompts.with_prompts, "dv", "id", "text", None, False, 1000).first()
    assert out.prompt_truncated and sum(-(-len(m.content) // 4) for m in out.messages) <= 1001
    got = row.select(*[prompts.predicted_label(F.lit(x), ["a"]) for x in ('<think>{"predicted_label": "b"}</think>{"predicted_label": "a"}', '{"predicted_label": "z"}', "none")]).first()
    assert tuple(got) == ("a", None, None)
