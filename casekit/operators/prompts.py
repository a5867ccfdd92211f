"""Prompt messages, budgets, and validation of model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import strip_thinking, text_tokens, truncate_middle
from ..vocabulary import CANONICAL

MAX_PROMPT_TOKENS, LEAST_TEXT_TOKENS = 28000, 512

#: System texts and the reasoning instruction; pass others where a study has its own.
SYSTEM = {
    case: f"Classifica o resultado do recurso descrito no texto. Responde só com JSON: {{\"predicted_label\": \"<LABEL>\"}}. Labels: {', '.join(names)}."
    for case, names in CANONICAL.items()
}
REASONING = "\n\nAntes do JSON, raciocina por passos: questão central, factos, normas, jurisprudência, apreciação, classificação."
CONDENSED_NOTE = "Nota de contexto: o texto contém só as frases mais relevantes do documento, na ordem original.\n\n"


def user_message(case_id: Column, text: Column, condensed: Column | None = None, note: str = CONDENSED_NOTE) -> Column:
    """Case number, a note if the text is condensed, and the text."""
    extra = F.lit("") if condensed is None else F.when(condensed, note).otherwise("")
    return F.concat(F.lit("Processo: "), case_id, F.lit("\n\n"), extra, F.lit("Texto da decisão:\n"), text)


def example_text(example: Column) -> Column:
    """Bullets of an example's selected sentences, or its text without any."""
    chosen = F.coalesce(F.when(F.size(example["selected_sentences"]) > 0, example["selected_sentences"]))
    return F.coalesce(F.array_join(F.transform(chosen, lambda s: F.concat(F.lit("- "), s)), "\n"), example["text"], F.lit(""))


def example_block(examples: Column) -> Column:
    """Numbered examples (struct(n_processo, text, selected_sentences, label))."""
    one = F.transform(
        examples,
        lambda e, i: F.concat(
            F.lit("[Exemplo "), (i + 1).cast("string"), F.lit("]\nProcesso: "), e["n_processo"], F.lit("\nTexto da decisão:\n"), example_text(e),
            F.lit('\nClassificação: {"predicted_label": "'), e["label"], F.lit('"}\n'),
        ),
    )
    head = F.concat(F.lit("Aqui estão "), F.size(examples).cast("string"), F.lit(" exemplos de classificações corretas:\n"))
    return F.concat_ws("\n", head, F.array_join(one, "\n"), F.lit("Agora classifica este processo:"))


def messages(case_type: str, user: Column, examples: Column | None = None, reasoning: bool = False, system: str | None = None) -> Column:
    """array<struct(role, content)>: the four kinds of prompt, by whether there are examples
    (before the user message, a blank line between) and whether reasoning is asked for."""
    text = (SYSTEM[case_type] if system is None else system) + (REASONING if reasoning else "")
    content = user if examples is None else F.concat(example_block(examples), F.lit("\n\n"), user)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(text).alias("content")), F.struct(F.lit("user").alias("role"), content.alias("content")))


def message_tokens(built: Column) -> Column:
    """Estimate of the tokens of all messages."""
    return F.aggregate(built, F.lit(0).cast("long"), lambda s, m: s + text_tokens(m["content"]))


def with_prompts(df: DataFrame, case_type: str, id_col: str, text_col: str, examples_col: str | None = None, reasoning: bool = False, max_tokens: int = MAX_PROMPT_TOKENS, out: str = "messages") -> DataFrame:
    """``df`` with messages within ``max_tokens``: where the estimate is above, the text is
    truncated in the middle to what the rest of the prompt leaves, ``LEAST_TEXT_TOKENS`` at
    least, and the prompt is built again. ``prompt_truncated`` says where."""
    build = lambda text: messages(case_type, user_message(F.col(id_col).cast("string"), text), F.col(examples_col) if examples_col else None, reasoning)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.withColumn("_full", build(text)).withColumn("_n", message_tokens(F.col("_full")))
    fixed = F.col("_n") - text_tokens(text)
    room = F.greatest(F.lit(LEAST_TEXT_TOKENS).cast("long"), F.lit(max_tokens) - fixed)
    rows = rows.withColumn("_cut", F.when(F.col("_n") > max_tokens, truncate_middle(text, room)))
    rows = rows.withColumn(out, F.when(F.col("_cut").isNull(), F.col("_full")).otherwise(build(F.col("_cut.text"))))
    return rows.withColumn("prompt_truncated", F.coalesce(F.col("_cut.truncated"), F.lit(False))).drop("_full", "_n", "_cut")


def substitute_text(df: DataFrame, summaries: DataFrame, id_col: str, text_col: str, summary_col: str) -> DataFrame:
    """``df`` with its text replaced by the case's summary where that is not blank, and
    ``condensed`` saying so. A case has one summary at most, or an error is raised."""
    one = summaries.select(id_col, F.col(summary_col).alias("_s"))
    if not one.groupBy(id_col).count().where("count > 1").isEmpty():
        raise ValueError(f"{id_col} repeats among the summaries")
    joined = df.join(one, id_col, "left")
    has = F.coalesce(F.trim("_s") != "", F.lit(False))
    return joined.withColumns({text_col: F.when(has, F.col("_s")).otherwise(F.col(text_col)), "condensed": has}).drop("_s")


def predicted_label(output: Column, labels: list[str]) -> Column:
    """The label in a model's output: reasoning blocks are dropped, the first JSON object
    with the field counts, and a label that is not listed gives null."""
    answer = strip_thinking(output)
    raw = F.regexp_extract(answer, r'(?s)(\{[^{}]*"predicted_label"[^{}]*\})', 1)
    label = F.get_json_object(F.nullif(raw, F.lit("")), "$.predicted_label")
    return F.when(label.isin(*labels), label)


def attempts(df: DataFrame, id_col: str, attempt_col: str, output_col: str, labels: list[str], most: int = 3) -> DataFrame:
    """(id, label, attempt): the first of at most ``most`` attempts with a valid label; null
    where none has."""
    tried = df.where(F.col(attempt_col) <= most).withColumn("_l", predicted_label(F.col(output_col), labels))
    best = F.min(F.when(F.col("_l").isNotNull(), F.struct(F.col(attempt_col).alias("attempt"), F.col("_l").alias("label"))))
    return tried.groupBy(id_col).agg(best.alias("b")).select(id_col, "b.label", "b.attempt")
