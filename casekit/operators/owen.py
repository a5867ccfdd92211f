"""Owen values of sentences under a text classifier, down a binary tree over each document.

A document's tree halves its run of sentences until single ones are left. A part of the
tree is valued by what adding it changes, averaged over contexts: each sibling on the way up
is there or not, with equal weight. Splitting a part asks the classifier for its two halves
alone in its context, and gives four parts: each half with its sibling absent and present.
Their weighted changes add up to the part's, so values add up to prediction minus base after
any number of splits.

Parts are rows. Each round ranks the open parts of a document by their weighted change,
splits the first ones, and scores the masked texts of all documents in Arrow batches; rounds
double in width, so that a budget takes as many as it has binary digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.shared import discarded, written
from .attribution import MASK
from .models import Predictor, score_texts

MAX_EVALS = 200
_RUNS = "array<struct<lo: int, hi: int>>"
_PART = ("row", "case_id", "n", "lo", "hi", "weight", "present", "f_off", "f_on", "base", "prediction")


def masked_text(sentences: Column, present: Column, mask: str = MASK) -> Column:
    """Sentences whose place lies in a run of ``present`` (array of lo, hi, the end left
    out), the others as ``mask``, space-joined."""
    there = lambda i: F.exists(present, lambda r: (r["lo"] <= i) & (i < r["hi"]))
    return F.array_join(F.transform(sentences, lambda s, i: F.when(there(i), F.coalesce(s, F.lit(""))).otherwise(F.lit(mask))), " ")


def _run(lo: Column, hi: Column) -> Column:
    return F.array(F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi")))


def _effect() -> Column:
    """The largest weighted change over the classes."""
    return F.col("weight") * F.coalesce(F.array_max(F.zip_with("f_on", "f_off", lambda a, b: F.abs(a - b))), F.lit(0.0))


def widths(max_evals: int) -> list[int]:
    """Splits of each round: 1, 2, 4, … up to what ``max_evals`` evaluations pay for, two a
    split after the two of the whole and of nothing."""
    left, out = max(0, (max_evals - 2) // 2), []
    while left:
        out.append(min(left, 1 << len(out)))
        left -= out[-1]
    return out


def _scored_halves(open_: DataFrame, docs: DataFrame, predictor: Callable[[], Predictor], mask: str, batch: int) -> DataFrame:
    """``open_`` with the scores of each part's two halves in its context."""
    lo, hi, on = F.col("lo"), F.col("hi"), F.col("present")
    texts = open_.join(docs.select("row", "sentences"), "row")
    texts = texts.withColumns({name: masked_text(F.col("sentences"), F.concat(on, run), mask) for name, run in (("t_left", _run(lo, _mid())), ("t_right", _run(_mid(), hi)))}).drop("sentences")
    # One document's parts are dealt out, as scoring is the work.
    dealt = texts.repartition(F.xxhash64("row", "lo", "present"))
    return score_texts(dealt, {"t_left": "f_left", "t_right": "f_right"}, predictor, batch)


def _mid() -> Column:
    return F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")


def _after(state: DataFrame) -> DataFrame:
    """The parts of ``state``: four for each that was split."""

    def part(low: Column, high: Column, weight: Column, present: Column, off: Column, full: Column) -> Column:
        return F.struct(low.alias("lo"), high.alias("hi"), weight.alias("weight"), present.alias("present"), off.alias("f_off"), full.alias("f_on"))

    lo, hi, on, w, off, full, left, right = (F.col(c) for c in ("lo", "hi", "present", "weight", "f_off", "f_on", "f_left", "f_right"))
    with_left, with_right = F.concat(on, _run(lo, _mid())), F.concat(on, _run(_mid(), hi))
    four = F.array(
        part(lo, _mid(), w / 2, on, off, left), part(lo, _mid(), w / 2, with_right, right, full),
        part(_mid(), hi, w / 2, on, off, right), part(_mid(), hi, w / 2, with_left, left, full),
    )
    made = F.when(F.col("go"), four).otherwise(F.array(part(lo, hi, w, on, off, full)))
    return state.select("row", "case_id", "n", "base", "prediction", F.explode(made).alias("p")).select("row", "case_id", "n", "p.*", "base", "prediction").select(*_PART)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of an array of lists one after the other, and where each list begins and the last ends."""
    ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))))
    return lists.flatten(), ends


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (case_id, n, base, prediction, parts) to values: each part's weighted change,
    spread evenly over its sentences."""
    for batch in batches:
        parts, ends = _flat(batch.column("parts"))
        lo, hi, weight = (parts.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi", "weight"))
        (off, many), (on, _) = (_flat(parts.field(c)) for c in ("f_off", "f_on"))
        off, on = (x.to_numpy(zero_copy_only=False).astype(float) for x in (off, on))
        sizes, values = batch.column("n").to_numpy(), []
        for row, n in enumerate(sizes):
            some = slice(ends[row], ends[row + 1])
            a, b = many[ends[row]], many[ends[row + 1]]
            change = (on[a:b] - off[a:b]).reshape(ends[row + 1] - ends[row], -1)
            at, to = lo[some], hi[some]
            share = weight[some, None] * change / np.maximum(to - at, 1)[:, None]
            steps = np.zeros((n + 1, change.shape[1]))
            np.add.at(steps, at, share)
            np.add.at(steps, to, -share)
            values.append(np.cumsum(steps, axis=0)[:n])
        inner = np.concatenate(([0], np.cumsum(np.repeat([v.shape[1] for v in values], sizes)))).astype(np.int32)
        each = pa.ListArray.from_arrays(pa.array(inner), pa.array(np.concatenate([np.zeros(0), *(v.ravel() for v in values)])))
        outer = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("case_id", "base", "prediction")), pa.ListArray.from_arrays(pa.array(outer), each)], ["case_id", "base", "prediction", "values"])


def owen_values(df: DataFrame, predictor: Callable[[], Predictor], max_evals: int = MAX_EVALS, case: str = "case_id", sentences: str = "sentences", mask: str = MASK, batch: int = 32) -> DataFrame:
    """(case, base, prediction, values) of every row of ``df``: scores of the text with no
    and with all sentences, and one array over the classes per sentence.

    At most ``max_evals`` masked texts of a document are scored (2 at least); what the budget
    leaves undivided is spread evenly over the part's sentences. Where it pays for the whole
    tree, values are the Owen values of the nested halves. The part with the largest change
    comes first, ties in the document's order. Null sentences count as empty ones; a null or
    empty array gives no values; cases may be null or repeat. ``predictor`` makes, once a
    task, the function from texts to rows of class scores.

    A document is at most 1.5 ``max_evals`` parts, which is what its groups hold; they are
    folded for a batch of documents at once. Rounds are written to the shared folder.
    """
    spark = df.sparkSession
    docs = df.select(F.col(case).alias("case_id"), F.coalesce(F.col(sentences), F.expr("cast(array() as array<string>)")).alias("sentences"))
    docs = written(docs.withColumn("row", F.monotonically_increasing_id()), "owen_docs")
    none, n = F.expr(f"cast(array() as {_RUNS})"), F.size("sentences")
    ends = docs.withColumns({"t_off": masked_text(F.col("sentences"), none, mask), "t_on": masked_text(F.col("sentences"), _run(F.lit(0), n), mask)})
    ends = ends.select("row", "case_id", n.alias("n"), "t_off", "t_on")
    last = written(score_texts(ends, {"t_off": "base", "t_on": "prediction"}, predictor, batch), "owen_ends")
    parts = last.select("row", "case_id", "n", F.lit(0).alias("lo"), F.col("n").alias("hi"), F.lit(1.0).alias("weight"), none.alias("present"), F.col("base").alias("f_off"), F.col("prediction").alias("f_on"), "base", "prediction")
    budget, whole = max(0, (max_evals - 2) // 2), F.col("hi") - F.col("lo") > 1
    for width in widths(max_evals):
        if not parts.where(whole).limit(1).count():
            break
        first = Window.partitionBy("row").orderBy(whole.desc(), _effect().desc(), "lo", "hi", "present")
        done = F.floor((F.count("*").over(Window.partitionBy("row")) - 1) / 3)  # each split turns one part into four
        go = whole & (F.col("turn") <= F.least(F.lit(width), F.lit(budget) - F.col("spent")))
        marked = parts.withColumns({"turn": F.row_number().over(first), "spent": done}).withColumn("go", go).drop("turn", "spent")
        rest = marked.where(~F.col("go")).withColumns({"f_left": F.lit(None).cast("array<double>"), "f_right": F.lit(None).cast("array<double>")})
        state = written(rest.unionByName(_scored_halves(marked.where("go"), docs, predictor, mask, batch)), "owen_parts")
        discarded(spark, last)
        parts, last = _after(state), state
    # Of all documents of a batch at once: a Python call a document costs far more than its sums.
    one = F.array_sort(F.collect_list(F.struct("lo", "hi", "weight", "f_off", "f_on"))).alias("parts")
    folded = parts.groupBy("row").agg(*[F.first(c).alias(c) for c in ("case_id", "n", "base", "prediction")], one).drop("row")
    kind = docs.schema["case_id"].dataType.simpleString()
    out = folded.mapInArrow(_folded, f"case_id {kind}, base array<double>, prediction array<double>, values array<array<double>>")
    return out.withColumnRenamed("case_id", case)
