"""Queries of models and of what explains them, and the SQL that states the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import lexicon, owen
from ..sources.shared import written
from .stand_ins import table


def _vowel_share():
    """Class scores that no sentence adds to alone: the share of e, and of other characters."""

    def predict(texts):
        e = np.array([t.count("e") / max(len(t), 1) for t in texts])
        return np.stack([e, 1 - e], 1)

    return predict


def owen_values(spark, sf_dir):
    """Four pieces of every document, valued by what they add to the share of the letter e."""
    d = table(spark, sf_dir, "documents").withColumn("w", F.ceil(F.length("text") / 4).cast("int"))
    pieces = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.substring(F.col("text"), F.lit(1) + i * F.col("w"), F.col("w")))
    docs = d.select("doc_id", F.when(F.col("text").isNotNull(), pieces).alias("pieces"))
    out = owen.owen_values(docs, _vowel_share, case="doc_id", sentences="pieces", max_evals=12)
    value = lambda i: F.round(F.get(F.get("values", F.lit(i)), F.lit(0)), 8).alias(f"value_{i}")
    return out.select("doc_id", F.round(F.get("prediction", F.lit(0)) - F.get("base", F.lit(0)), 8).alias("gap"), *[value(i) for i in range(4)])


def _owen_sql() -> str:
    """Every masked text by its counts, and each piece's change averaged over contexts: its
    neighbour there or not, the other half all there or not."""
    score = lambda on: f"({' + '.join(f'e[{i + 1}]' for i in on) or '0'}) / (3 + {' + '.join(f'n[{i + 1}]' if i in on else '3' for i in range(4))})::double"
    values = []
    for i in range(4):
        pair, other = i ^ 1, [2, 3] if i < 2 else [0, 1]
        contexts = [[*a, *b] for a in ([], [pair]) for b in ([], other)]
        values.append(f"round(({' + '.join(f'{score([*c, i])} - {score(c)}' for c in contexts)}) / 4, 8) as value_{i}")
    return f"""with d as (select doc_id, text, ceil(length(text) / 4.0)::int as w from documents),
p as (select doc_id, text, list_transform(range(4), lambda i: substr(text, (1 + i * w)::int, w)) as s from d),
c as (select doc_id, text, list_transform(s, lambda x: length(x)) as n, list_transform(s, lambda x: length(x) - length(replace(x, 'e', ''))) as e from p)
select doc_id, round({score(range(4))} - {score([])}, 8) as gap, {', '.join(values)} from c"""


#: Words of the vocabulary of the query.
_WORDS = 200


def word_information(spark, sf_dir):
    """Pairs of the most frequent words of all documents that are near each other more often
    than by chance, with their counts."""
    d = table(spark, sf_dir, "documents")
    known = [r["word"] for r in lexicon.vocabulary(d, F.col("text"), _WORDS).collect()]
    # Read for sums, their total and the pairs: counted once.
    counts = written(lexicon.near_counts(d, F.col("text"), known), "near_counts")
    both = lexicon.information(counts).join(counts, ["i", "j"])
    name = F.array(*[F.lit(w) for w in known])
    return both.select(F.get(name, F.col("i")).alias("word"), F.get(name, F.col("j")).alias("other"), "c", F.round("v", 6).alias("information"))


_WORD_INFORMATION = rf"""with d as (select row_number() over () as r, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w <> '') as t from documents),
w as (select r, unnest(t) as word, unnest(range(len(t))) as i from d),
known as (select word, count(*) as n from w group by 1 having count(*) >= {lexicon.LEAST} order by n desc, word limit {_WORDS}),
k as (select w.* from w join known using (word)),
c as (select a.word, b.word as other, count(*) as c from k a join k b on a.r = b.r and b.i between a.i - {lexicon.NEAR} and a.i + {lexicon.NEAR} and a.i <> b.i group by 1, 2),
s as (select word, sum(c) as s from c group by 1)
select c.word, other, c, round(ln(c * (select sum(c) from c)::double / (s.s::double * o.s)), 6) as information from c join s using (word) join s o on o.word = c.other where c * (select sum(c) from c)::double / (s.s::double * o.s) > 1"""

PAIRS = {
    "word_information": (word_information, _WORD_INFORMATION),
    "owen_values": (owen_values, _owen_sql()),
}
