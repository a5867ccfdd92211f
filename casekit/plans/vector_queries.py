"""Queries on labels, vectors, attributions and annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as v
from ..functions.text import clean_basic, words
from ..operators import annotate, attribution, evaluate, nearest, pooling, profile, projection, retrieve, training
from .stand_ins import table

LABELS = [0, 1]
_CELLS = "cells as (select quality as t, toxic as p, count(*) as n from labels where quality is not null and toxic is not null group by all)"
_M = """m as (select sum(n) as s, sum(n) filter (t = p) as c, {sums} from cells)"""
_SUMS = ", ".join(f"coalesce(sum(n) filter (t = {x}), 0)::double as t{x}, coalesce(sum(n) filter (p = {x}), 0)::double as p{x}, coalesce(sum(n) filter (t = {x} and p = {x}), 0)::double as h{x}" for x in LABELS)
_MCC = "case when (s * s - p0 * p0 - p1 * p1) * (s * s - t0 * t0 - t1 * t1) > 0 then (c * s - t0 * p0 - t1 * p1) / sqrt((s * s - p0 * p0 - p1 * p1) * (s * s - t0 * t0 - t1 * t1)::double) else 0 end"
_F1 = "((case when t0 + p0 > 0 then 2 * h0 / (t0 + p0) else 0 end) + (case when t1 + p1 > 0 then 2 * h1 / (t1 + p1) else 0 end)) / 2"


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "labels")


def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(_labels(spark, sf_dir), "quality", "toxic", LABELS)


def class_metrics(spark, sf_dir):
    out = evaluate.class_metrics(evaluate.confusion_counts(_labels(spark, sf_dir), "quality", "toxic"), LABELS)
    return out.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def mcc_macro_f1(spark, sf_dir):
    out = evaluate.overall_metrics(evaluate.confusion_counts(_labels(spark, sf_dir), "quality", "toxic"), LABELS)
    return out.select("n_samples", "n_correct", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "mcc")])


def bootstrap_ci(spark, sf_dir):
    out = evaluate.bootstrap_intervals(_labels(spark, sf_dir), "quality", "toxic", LABELS, 200)
    return out.where("label is null").select("metric", *[F.round(c, 6).alias(c) for c in ("point", "ci_lower", "ci_upper")])


def metrics_wide(spark, sf_dir):
    long = evaluate.bootstrap_intervals(_labels(spark, sf_dir), "quality", "toxic", LABELS, 100)
    out = evaluate.metrics_wide(long, {0: "LOW", 1: "HIGH"})
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def mann_whitney_auc(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(_labels(spark, sf_dir), "doc_id")
    out = evaluate.mann_whitney(docs, F.col("toxic") == 1, "n_chars")
    return out.select("n1", "n2", "u", F.round("auc", 6).alias("auc"), F.round("z", 6).alias("z"))


def mann_whitney_small(spark, sf_dir):
    """For each customer: are open orders priced unlike the others? Exact where few."""
    out = evaluate.mann_whitney_by(table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderstatus") == "O", "o_totalprice")
    return out.select("o_custkey", "n1", "n2", "u", F.round("p_value", 7).alias("p_value"), "exact")


def projected_points(spark, sf_dir):
    """Three coordinates of every vector."""
    out = projection.projected(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return out.select("vec_id", *[F.get("point", F.lit(i)).alias(c) for i, c in enumerate("xyz")])


def fit_diagnosis(spark, sf_dir):
    rows = _labels(spark, sf_dir).withColumn("split", F.when(F.col("doc_id") % 2 == 0, "train").otherwise("gold"))
    m = evaluate.overall_metrics(evaluate.confusion_counts(rows, "quality", "toxic", ["split"]), LABELS, ["split"])
    out = evaluate.fit_diagnosis(m)
    return out.select(F.round("gap_f1", 6).alias("gap_f1"), F.round("gap_mcc", 6).alias("gap_mcc"), "verdict")


def baseline_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("p"))
    out = evaluate.baseline_summary(rows, "label", "p")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("majority_share", "confidence_min", "confidence_mean", "confidence_max", "confidence_std")])


def rank_weights(spark, sf_dir):
    w = v.rank_weights(F.col("label") + 1)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.get(w, F.lit(0)), 6).alias("first"), F.round(F.aggregate(w, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def _sets(spark, sf_dir):
    """Documents of five ranked vectors, with a case type and a class."""
    e = table(spark, sf_dir, "embeddings").withColumn("doc", F.expr("vec_id div 5"))
    sets = e.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("vectors"), F.min("label").alias("class"))
    return sets.withColumn("case_type", F.when(F.col("doc") % 2 == 0, "dv").otherwise("boc"))


def _placed_sets(spark, sf_dir):
    """``_sets`` where a vector's weight goes by its place among five, as in the SQL: a missing
    vector is zero. A document of null vectors alone, on which the SQL raises, is like nothing."""
    e = table(spark, sf_dir, "embeddings").withColumn("doc", F.expr("vec_id div 5"))
    one = F.when(F.col("embedding").isNotNull(), F.struct((F.col("vec_id") % 5).alias("place"), "embedding"))
    found = e.groupBy("doc").agg(F.collect_list(one).alias("z"), F.min("label").alias("class"))
    none = F.transform(F.get("z", F.lit(0))["embedding"], lambda x: F.lit(0).cast("float"))
    at = lambda i: F.coalesce(F.get(F.filter("z", lambda x: x["place"] == i), F.lit(0))["embedding"], none)
    case_type = F.when(F.col("doc") % 2 == 0, "dv").otherwise("boc")
    return found.select("doc", F.array(*[at(i) for i in range(5)]).alias("vectors"), "class", case_type.alias("case_type"))


def _best(spark, sf_dir, n, group=None, direction=True):
    sets = _sets(spark, sf_dir)
    return retrieve.best_candidates(sets.where("doc % 20 = 0"), sets, "doc", "case_type", "vectors", n, group, direction)


def set_similarity_topk(spark, sf_dir):
    out = _best(spark, sf_dir, 3, direction=False)
    return out.select("query_id", "doc", F.round("similarity", 5).alias("similarity"), "candidate_rank")


def indexed_topk(spark, sf_dir):
    """The twenty nearest by the inverted file, exact."""
    sets = _sets(spark, sf_dir)
    index = nearest.build_vector_index(sets, "doc", "case_type", "vectors", ("class",))
    out = nearest.nearest(index, sets.where("doc % 20 = 0"), "doc", "case_type", "vectors", 20)
    return out.select("query_id", "doc", F.round("similarity", 5).alias("similarity"), "candidate_rank", "class")


def indexed_few_shot(spark, sf_dir):
    """Diverse examples among the ten nearest by the inverted file."""
    sets = _sets(spark, sf_dir)
    index = nearest.build_vector_index(sets, "doc", "case_type", "vectors")
    out = retrieve.diverse(nearest.nearest(index, sets.where("doc % 20 = 0"), "doc", "case_type", "vectors", 10), "doc", 3, 0.5)
    return out.select("query_id", "doc", F.round("similarity", 5).alias("similarity"), "diversity_rank")


def diverse_topk(spark, sf_dir):
    out = retrieve.diverse(_best(spark, sf_dir, 10), "doc", 3, 0.5)
    return out.select("query_id", "doc", F.round("similarity", 5).alias("similarity"), "diversity_rank")


def few_shot_balanced(spark, sf_dir):
    """Examples for every document."""
    best = retrieve.best_of_all(_placed_sets(spark, sf_dir), "doc", "case_type", "vectors", 10, "class")
    out = retrieve.few_shot_of(best, "doc", "class", per_class=2, most=None)
    return out.select("query_id", "class", "doc", "few_shot_rank")


def few_shot_map(spark, sf_dir):
    picks = retrieve.few_shot_of(_best(spark, sf_dir, 10, "class"), "doc", "class", per_class=1, max_total=5)
    return retrieve.few_shot_map(picks, "class", ("doc",)).select("query_id", F.size("examples").alias("n"), F.to_json("examples").alias("examples"))


def candidate_pools(spark, sf_dir):
    out = retrieve.candidate_pools(_sets(spark, sf_dir), "case_type", "class", "doc", 20)
    return out.select("case_type", "class", F.array_join("ids", ",").alias("ids"), F.size("ranks").alias("n"))


def pool_places(spark, sf_dir):
    return retrieve.pool_places(_sets(spark, sf_dir).select("doc", "class", "case_type"), "case_type", "class", "doc")


def binary_decisions(spark, sf_dir):
    """Both classes' scores of a logit, and what each row weighs by its class."""
    e = table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") < 3).cast("int"))
    both = v.binary_scores(F.get("embedding", F.lit(0)).cast("double") * 9 - 1)
    weight = F.when(F.col("y") == 1, pooling.positive_weight(e, "y")).otherwise(F.lit(1.0))
    return e.select("vec_id", F.round(both[0], 6).alias("p0"), F.round(both[1], 6).alias("p1"), (both[1] >= 0.5).alias("positive"), F.round(weight, 6).alias("weight"))


def window_slices(spark, sf_dir):
    wins = pooling.token_windows(words(clean_basic(F.col("text"))), 130, 28)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(wins).alias("n_windows"), F.size(F.element_at(wins, -1)).alias("last_size"), F.size(pooling.spaced_subset(wins, 4)).alias("n_spaced"))


def weighted_pool(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("doc", F.expr("vec_id div 4")).withColumn("w", F.col("label") + 1)
    out = pooling.pooled(e, "doc", "embedding", "w")
    return out.select("doc", "window_count", F.round(F.get("embedding", F.lit(0)), 5).alias("x0"), F.round(F.get("embedding", F.lit(63)), 5).alias("x63"))


def centroid(spark, sf_dir):
    out = _sets(spark, sf_dir).withColumn("c", v.centroid(F.col("vectors")))
    return out.select("doc", F.round(F.get("c", F.lit(0)), 5).alias("x0"), F.round(v.cosine(F.col("c"), F.get("vectors", F.lit(0))), 5).alias("cos"))


def class_weights(spark, sf_dir):
    out = pooling.class_weights(table(spark, sf_dir, "embeddings"), "label")
    return out.select("label", "n", F.round("weight", 6).alias("weight"))


#: The head of the queries: softmax regression, a few epochs of AdamW, stopped by every fifth vector.
HEAD = training.Settings(hidden=(), epochs=4, rate=0.05, patience=2)


def _head(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("held_out", F.col("vec_id") % 5 == 0)
    return e, training.fit_network(e, "embedding", "label", "held_out", HEAD)


def head_predictions(spark, sf_dir):
    e, head = _head(spark, sf_dir)
    out = training.score_network(e.select("vec_id", "label", "embedding", F.coalesce("held_out", F.lit(True)).alias("held_out")), head, "embedding")
    return out.select("vec_id", "label", "y_pred", "held_out")


def head_losses(spark, sf_dir):
    """Losses of each epoch, their moving average, and the epoch whose weights were kept."""
    _, head = _head(spark, sf_dir)
    rows = [(i + 1, a, b, head.best_epoch) for i, (a, b) in enumerate(zip(head.train_losses, head.val_losses))]
    out = spark.createDataFrame(rows, "epoch int, train_loss double, val_loss double, best_epoch int")
    return out.select("epoch", F.round("train_loss", 6).alias("train_loss"), F.round("val_loss", 6).alias("val_loss"), "best_epoch")


def _head_sql(last: str) -> str:
    """The same epochs, written out: one table of weights (class, place) for each."""
    s, parts = HEAD, [
        "x as (select vec_id, unnest(embedding)::double as v, unnest(range(1, len(embedding) + 1)) as j from embeddings union all select vec_id, 1.0, 0 from embeddings where embedding is not null)",
        "k as (select label as c, (select count(*) from embeddings where vec_id % 5 <> 0) / ((select count(distinct label) from embeddings where vec_id % 5 <> 0) * count(*))::double as w from embeddings where vec_id % 5 <> 0 group by 1)",
        "t0 as (select c, j, 0.0::double as t, 0.0::double as m, 0.0::double as v from k, (select distinct j from x))",
    ]
    for e in range(s.epochs + 1):
        parts += [
            f"z{e} as (select vec_id, c, sum(t * x.v) as z from x join t{e} using (j) group by all)",
            f"p{e} as (select vec_id, c, z - max(z) over (partition by vec_id) - ln(sum(exp(z - m)) over (partition by vec_id)) as l from (select *, max(z) over (partition by vec_id) as m from z{e}))",
            f"l{e} as (select vec_id % 5 = 0 as held, sum(-l * w) / sum(w) as loss from p{e} join embeddings e using (vec_id) join k using (c) where e.label = c group by 1)",
        ]
        if e < s.epochs:
            b1, b2 = s.betas
            parts += [
                f"g{e} as (select p.c, j, sum(y.w * (exp(l) - (e.label = p.c)::int) * x.v) / (select sum(w) from embeddings join k on label = c where vec_id % 5 <> 0) as g from p{e} p join embeddings e using (vec_id) join k y on y.c = e.label join x using (vec_id) where vec_id % 5 <> 0 group by all)",
                f"n{e} as (select c, j, t, {b1} * m + {1 - b1} * g as m, {b2} * v + {1 - b2} * g * g as v from t{e} join g{e} using (c, j))",
                f"t{e + 1} as materialized (select c, j, t * {1 - s.rate * s.weight_decay} - {s.rate} * (m / {1 - b1 ** (e + 1)}) / (sqrt(v / {1 - b2 ** (e + 1)}) + {s.eps}) as t, m, v from n{e})",
            ]
    # Smoothed losses after each epoch; the least one's weights count.
    smooth = ["(select loss from l1 where held)"]
    for e in range(2, s.epochs + 1):
        smooth.append(f"({s.smooth} * (select loss from l{e} where held) + {1 - s.smooth} * s{e - 1})")
    chain = "s as (select *" + "".join(f" from (select *, {v} as s{i + 1}" for i, v in reversed(list(enumerate(smooth)))) + " from (select 1 as one)" + ")" * len(smooth) + ")"
    rows = "losses as (select unnest(range(1, " + str(s.epochs + 1) + ")) as epoch, unnest([" + ", ".join(f"s{i + 1}" for i in range(s.epochs)) + "]) as v from s)"
    least = "least_so_far as (select a.epoch, arg_min(b.epoch, struct_pack(v := b.v, e := b.epoch)) as best from losses a join losses b on b.epoch <= a.epoch group by 1)"
    stop = f"stop as (select coalesce(min(epoch) filter (epoch - best >= {s.patience}), {s.epochs}) as last from least_so_far)"
    best = "best as (select best from least_so_far where epoch = (select last from stop))"
    parts += [chain, rows, least, stop, best]
    return "with " + ",\n".join(parts) + "\n" + last


_HEAD_PREDICTIONS = _head_sql(
    "select e.vec_id, e.label, arg_max(c, struct_pack(l := l, c := -c)) as y_pred, coalesce(e.vec_id % 5 = 0, true) as held_out from embeddings e join ("
    + " union all ".join(f"select {e} as epoch, * from p{e}" for e in range(1, HEAD.epochs + 1))
    + ") p on p.vec_id = e.vec_id and p.epoch = (select best from best) group by all"
)
_HEAD_LOSSES = _head_sql(
    "select * from (" + " union all ".join(f"select {e}::int as epoch, round((select loss from l{e - 1} where not held), 6) as train_loss, round((select loss from l{e} where held), 6) as val_loss, (select best from best)::int as best_epoch" for e in range(1, HEAD.epochs + 1)) + ") where epoch <= (select last from stop)"
)


def _long(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("case_id", F.expr("vec_id div 10"))
    docs = e.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", F.concat(F.lit("sentence "), (F.col("vec_id") % 7).cast("string")).alias("s"), F.array(F.get("embedding", F.lit(0)).cast("double"), -F.get("embedding", F.lit(0)).cast("double")).alias("v"))).alias("z")).alias("z"))
    shaped = docs.select("case_id", F.transform("z", lambda x: x["s"]).alias("sentences"), F.transform("z", lambda x: x["v"]).alias("values"), (F.col("case_id") % 2).cast("int").alias("predicted_class"))
    return attribution.attribution_long(shaped)


def attribution_long(spark, sf_dir):
    return _long(spark, sf_dir).select("case_id", "sentence_idx", "sentence_text", F.round("shap_value", 6).alias("shap_value"))


def attribution_topn(spark, sf_dir):
    means = attribution.mean_by_sentence(_long(spark, sf_dir))
    return attribution.top_both_ways(means, 2).select("case_id", "key", F.round("mean", 6).alias("mean"), "sign", "rank")


def attribution_corr(spark, sf_dir):
    cases = _long(spark, sf_dir).groupBy("case_id").agg(F.count_if(F.col("shap_value") > 0).alias("n_sentences"), F.round(F.sum("shap_value"), 6).alias("total"))
    out = attribution.length_effect(cases)
    return out.select(F.round("r", 6).alias("r"), "at_shortest", "at_longest")


def attribution_spread(spark, sf_dir):
    out = attribution.spread(_long(spark, sf_dir).withColumn("case_type", F.col("case_id") % 2), "case_type")
    return out.select("case_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std", "mean_abs", "max_abs", "share_positive")])


def anchor_enrichment(spark, sf_dir):
    long = _long(spark, sf_dir).withColumn("sentence_text", F.when(F.col("sentence_idx") % 3 == 0, "Dos factos provados resulta").otherwise(F.col("sentence_text")))
    out = attribution.anchor_enrichment(long, 4)
    return out.select("case_id", F.round("rate", 6).alias("rate"), F.round("top_rate", 6).alias("top_rate"))


def normalised_values(spark, sf_dir):
    counts = profile.counts_by(table(spark, sf_dir, "events"), "event_type", "event_type")
    return profile.normalised(counts, "n").select("event_type", F.round("normalised", 6).alias("normalised"))


def _responses(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", (F.col("user_id") % 5).alias("judge"), (F.col("event_id") % 20).alias("case_id"), F.col("event_type").alias("decision"), F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.col("event_type")).alias("confidence"))
    last = rows.groupBy("judge", "case_id").agg(F.max_by(F.struct("decision", "confidence"), "event_id").alias("r"))
    return last.select(F.concat(F.lit("J"), F.col("judge").cast("string")).alias("judge"), F.col("case_id").cast("string").alias("case_id"), F.col("case_id").alias("place"), "r.*")


def annotation_matrix(spark, sf_dir):
    r = _responses(spark, sf_dir)
    long = r.select("case_id", "judge", F.lit("decision").alias("field"), F.col("decision").alias("value"))
    return annotate.long_to_matrix(long, r, "case_id", "decision", ["J0", "J1", "J2", "J3", "J4"])


def annotation_progress(spark, sf_dir):
    out = annotate.progress(_responses(spark, sf_dir))
    return out.select("judge", "total", "done", F.round("ratio", 6).alias("ratio"))


def annotation_pending(spark, sf_dir):
    out = annotate.pending(_responses(spark, sf_dir))
    return out.select("judge", "first_incomplete", F.array_join(F.transform("pending", lambda x: x.cast("string")), ",").alias("pending"))


def state_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    state = c.select(F.col("c_custkey").alias("username"), F.lit("dv").alias("ramo"), F.col("c_mktsegment").alias("finalizado_em"), F.lit("old").alias("ultima_gravacao_em"))
    new = c.where("c_custkey % 3 = 0").select((F.col("c_custkey") * 2).alias("username"), F.lit("dv").alias("ramo"), F.when(F.col("c_custkey") % 2 == 0, "now").alias("ultima_gravacao_em"))
    return annotate.upsert(state, new, ["username", "ramo"])


def branch_assignment(spark, sf_dir):
    user = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit(" j_dv_"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", annotate.assign_branch(user).alias("branch"))


def case_orders(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("user"))
    return annotate.case_order(rows, "n_nationkey", F.col("user"), F.lit("dv"))


_E = "e as (select *, embedding[1]::double as x from embeddings)"
_LONG = f"with {_E}, long as (select vec_id // 10 as case_id, (vec_id % 10)::int as sentence_idx, 'sentence ' || (vec_id % 7) as sentence_text, case when (vec_id // 10) % 2 = 0 then x else -x end as shap_value from e)"
_RESP = "with r as (select 'J' || judge as judge, case_id::varchar as case_id, case_id as place, decision, confidence from (select event_id, user_id % 5 as judge, event_id % 20 as case_id, event_type as decision, case when event_id % 3 = 0 then ' ' else event_type end as confidence from events) qualify row_number() over (partition by judge, place order by event_id desc) = 1)"
_SETS = """with w as (select unnest([1.0, 1.0/2, 1.0/3, 1.0/4, 1.0/5]) / (1.0 + 1.0/2 + 1.0/3 + 1.0/4 + 1.0/5) as w, unnest([0, 1, 2, 3, 4]) as r),
  parts as (select vec_id // 5 as doc, label, w, embedding::double[] as v, sqrt(list_dot_product(embedding::double[], embedding::double[])) as s from embeddings join w on vec_id % 5 = r),
  long as (select doc, unnest(v) * w / s as x, unnest(range(1, 65)) as i from parts),
  sums as (select doc, i, sum(x) as x from long group by all),
  sets as (select doc, list(x order by i) as d from sums group by doc),
  named as (select sets.doc, d, (select min(label) from embeddings where vec_id // 5 = sets.doc) as class, doc % 2 as ct from sets),
  pairs as (select q.doc as query_id, c.doc, c.class, list_dot_product(q.d, c.d) as similarity from named q join named c on q.ct = c.ct and q.doc <> c.doc where q.doc % 20 = 0)"""



def _resampled(n: int) -> str:
    """Sums of the cells of ``n`` resamples (m) and of the table itself (o): the first cell of a
    class is a binomial quantile, the second what is left."""
    return f"""with {_CELLS}, sz as (select t, sum(n)::bigint as z, min(p) as p, arg_min(n, p)::double as n from cells group by t),
      mass as (select t, k, exp(lgamma(z + 1) - lgamma(k + 1) - lgamma(z - k + 1) + k * ln(n / z) + (z - k) * ln(1 - n / z)) as w from (select *, unnest(range(z + 1)) as k from sz where n < z)),
      upto as (select t, k, sum(w) over (partition by t order by k) / sum(w) over (partition by t) as w from mass),
      us as (select b, t, p, z, n, (('0x' || substr(md5('42|' || b || '|' || t || '|' || p), 1, 8))::bigint + 0.5) / 4294967296 as u from sz, (select unnest(range({n})) as b)),
      firsts as (select b, us.t, p, z, case when any_value(n) = z then z else count(*) filter (w < u) end as k from us left join upto on us.t = upto.t group by b, us.t, p, z),
      c2 as (select b, t, p, k as n from firsts union all select b, f.t, cells.p, z - k from firsts f join cells on cells.t = f.t and cells.p <> f.p),
      m as (select b, sum(n) as s, sum(n) filter (t = p) as c, {_SUMS} from c2 group by b), {_M.format(sums=_SUMS).replace('m as', 'o as')}"""


def _wide_sql(n: int) -> str:
    each = {"macro_f1": _F1, "mcc": _MCC}
    for code, name in ((0, "LOW"), (1, "HIGH")):
        each[f"precision_{name}"] = f"case when p{code} > 0 then h{code} / p{code} else 0 end"
        each[f"recall_{name}"] = f"case when t{code} > 0 then h{code} / t{code} else 0 end"
        each[f"f1_{name}"] = f"case when t{code} + p{code} > 0 then 2 * h{code} / (t{code} + p{code}) else 0 end"
    parts = [f"(select round({x}, 6) from o) as {k}_point, (select round(quantile_cont({x}, 0.025), 6) from m) as {k}_ci_lower, (select round(quantile_cont({x}, 0.975), 6) from m) as {k}_ci_upper" for k, x in each.items()]
    return f"{_resampled(n)} select {', '.join(parts)}"


#: Ways to choose m of the first n ranks with a given sum, rank by rank; U is the sum less m (m + 1) / 2.
#: Larger groups, and those with ties, have the normal tail, its density summed by Simpson's rule.
_SMALL_U = f"""with recursive d as (select o_custkey, o_totalprice::double as v, o_orderstatus = 'O' as g from orders where o_totalprice is not null),
  r as (select *, rank() over (partition by o_custkey order by v) + (count(*) over (partition by o_custkey, v) - 1) / 2.0 as r from d),
  k as (select o_custkey, count(*) filter (g)::bigint as n1, count(*) filter (not g)::bigint as n2, coalesce(sum(r) filter (g), 0) as r1, count(*) <> count(distinct v) as tied from r group by 1),
  t as (select o_custkey, sum(c * c * c - c)::double as t from (select o_custkey, count(*)::double as c from d group by o_custkey, v) group by 1),
  s as (select k.*, t, case when n1 > 0 and n2 > 0 then r1 - n1 * (n1 + 1) / 2.0 end as u, n1 > 0 and n2 > 0 and least(n1, n2) <= {evaluate.SMALL} and not tied as exact from k join t using (o_custkey)),
  ways(n, m, total, c) as (select 0, 0, 0, 1::double union all
    select n + 1, m + take, total + take * (n + 1), sum(c) from ways, (select unnest([0, 1]) as take) where n < (select max(n1 + n2) from s) and m + take <= {evaluate.SMALL} group by 1, 2, 3, n),
  far as (select o_custkey, 2 * sum(c) filter (total - m * (m + 1) / 2 >= greatest(u, n1 * n2 - u)) / sum(c) as p from s join ways on n = n1 + n2 and m = least(n1, n2) where exact group by 1),
  z as (select *, greatest((abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - t / ((n1 + n2) * (n1 + n2 - 1)))), 0) as z from s where u is not null),
  tails as (select o_custkey, 1 - 2 * sum((case when i in (0, 400) then 1 when i % 2 = 1 then 4 else 2 end) * exp(-0.5 * pow(z * i / 400, 2))) * z / 400 / 3 / sqrt(2 * pi()) as p from z, (select unnest(range(401)) as i) group by o_custkey, z)
select o_custkey, n1, n2, u::double as u, round(case when exact then least(1, far.p) else tails.p end, 7) as p_value, exact from s left join far using (o_custkey) left join tails using (o_custkey)"""
#: The pairs of every document, not only of those divisible by 20.
_ALL_SETS = _SETS.replace(" where q.doc % 20 = 0", "")
_DIVERSE = f"""{_SETS}, t as (select pairs.*, named.d, row_number() over (partition by query_id order by similarity desc, pairs.doc) as r from pairs join named on pairs.doc = named.doc qualify r <= 10),
      p1 as (select * from t where r = 1), p2 as (select t.* from t join p1 on t.query_id = p1.query_id where t.r > 1 and list_dot_product(t.d, p1.d) < 0.5 qualify row_number() over (partition by t.query_id order by t.r) = 1),
      p3 as (select t.* from t join p1 on t.query_id = p1.query_id join p2 on t.query_id = p2.query_id where t.r > p2.r and list_dot_product(t.d, p1.d) < 0.5 and list_dot_product(t.d, p2.d) < 0.5 qualify row_number() over (partition by t.query_id order by t.r) = 1)
      """ + " union all ".join(f"select query_id, doc, round(similarity, 5) as similarity, {k} as diversity_rank from p{k}" for k in (1, 2, 3))

PAIRS = {
    "confusion_matrix": (confusion_matrix, f"with {_CELLS} select x::int as y_true, coalesce(sum(n) filter (p = 0), 0)::bigint as pred_0, coalesce(sum(n) filter (p = 1), 0)::bigint as pred_1 from (select unnest([0, 1]) as x) left join cells on t = x group by 1"),
    "class_metrics": (class_metrics, f"with {_CELLS}, {_M.format(sums=_SUMS)} " + " union all ".join(f"select {x}::int as label, t{x}::bigint as support, round(case when p{x} > 0 then h{x} / p{x} else 0 end, 6) as precision, round(case when t{x} > 0 then h{x} / t{x} else 0 end, 6) as recall, round(case when t{x} + p{x} > 0 then 2 * h{x} / (t{x} + p{x}) else 0 end, 6) as f1 from m" for x in LABELS)),
    "mcc_macro_f1": (mcc_macro_f1, f"with {_CELLS}, {_M.format(sums=_SUMS)} select s::bigint as n_samples, c::bigint as n_correct, round(c::double / s, 6) as accuracy, round({_F1}, 6) as macro_f1, round({_MCC}, 6) as mcc from m"),
    "bootstrap_ci": (bootstrap_ci, f"""{_resampled(200)}, v as (select {_F1} as f, {_MCC} as k from m), ov as (select {_F1} as f, {_MCC} as k from o)
      select 'macro_f1' as metric, round((select f from ov), 6) as point, round(quantile_cont(f, 0.025), 6) as ci_lower, round(quantile_cont(f, 0.975), 6) as ci_upper from v
      union all select 'mcc', round((select k from ov), 6), round(quantile_cont(k, 0.025), 6), round(quantile_cont(k, 0.975), 6) from v"""),
    "metrics_wide": (metrics_wide, _wide_sql(100)),
    "mann_whitney_auc": (mann_whitney_auc, """with d as (select n_chars::double as v, toxic = 1 as g from documents d join labels l on d.doc_id = l.doc_id), r as (select g, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as r from d),
      k as (select count(*) filter (g)::double as n1, count(*) filter (not g)::double as n2, sum(r) filter (g) as r1 from r), t as (select sum(c * c * c - c)::double as t from (select count(*)::double as c from d group by v)),
      u as (select n1, n2, r1 - n1 * (n1 + 1) / 2 as u, t from k, t) select n1::bigint as n1, n2::bigint as n2, u, round(u / (n1 * n2), 6) as auc, round(greatest((abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - t / ((n1 + n2) * (n1 + n2 - 1)))), 0), 6) as z from u"""),
    "mann_whitney_small": (mann_whitney_small, _SMALL_U),
    "projected_points": (projected_points, None),
    "fit_diagnosis": (fit_diagnosis, f"""with cells as (select doc_id % 2 = 0 as tr, quality as t, toxic as p, count(*) as n from labels group by all), m as (select tr, sum(n) as s, sum(n) filter (t = p) as c, {_SUMS} from cells group by tr), v as (select tr, {_F1} as f, {_MCC} as k from m),
      g as (select max(f) filter (tr) - max(f) filter (not tr) as gf, max(k) filter (tr) - max(k) filter (not tr) as gk, max(k) filter (tr) as tk from v) select round(gf, 6) as gap_f1, round(gk, 6) as gap_mcc, case when abs(tk) < 0.05 and gf < 0.10 then 'under' when gf > 0.20 then 'over' else 'inconclusive' end as verdict from g"""),
    "baseline_summary": (baseline_summary, "select count(*) as n, round((select max(c) / sum(c) from (select count(*) as c from embeddings group by label)), 6)::double as majority_share, round(min(m), 6) as confidence_min, round(avg(m), 6) as confidence_mean, round(max(m), 6) as confidence_max, round(stddev_pop(m), 6) as confidence_std from (select list_max(embedding[1:3])::double as m from embeddings)"),
    "rank_weights": (rank_weights, "select vec_id, round(1.0 / list_sum(list_transform(range(1, label + 2), lambda i: 1.0::double / i)), 6)::double as first, 1.0::double as total from embeddings"),
    "set_similarity_topk": (set_similarity_topk, f"{_SETS} select query_id, doc, round(similarity, 5) as similarity, row_number() over (partition by query_id order by similarity desc, doc)::int as candidate_rank from pairs qualify candidate_rank <= 3"),
    "indexed_topk": (indexed_topk, f"{_SETS} select query_id, doc, round(similarity, 5) as similarity, row_number() over (partition by query_id order by pairs.similarity desc, doc)::int as candidate_rank, class from pairs qualify candidate_rank <= 20"),
    "diverse_topk": (diverse_topk, _DIVERSE),
    "indexed_few_shot": (indexed_few_shot, _DIVERSE),
    "few_shot_balanced": (few_shot_balanced, f"{_ALL_SETS}, t as (select *, row_number() over (partition by query_id, class order by similarity desc, doc) as r from pairs qualify r <= 2), n as (select query_id, class, max(r) as n from t group by all), l as (select query_id, min(n) as l from n group by 1) select t.query_id, class, doc, r::int as few_shot_rank from t join l on t.query_id = l.query_id where r <= l"),
    "few_shot_map": (few_shot_map, f"""{_SETS}, b as (select *, row_number() over (partition by query_id order by class) as k, count(*) over (partition by query_id) as n from (select * from pairs qualify row_number() over (partition by query_id, class order by similarity desc, doc) = 1)),
      c as (select query_id, class, doc, case when n > 5 then k else 1 end as k from b where k <= 5)
      select query_id, count(*)::int as n, '[' || string_agg('{{"class":' || class || ',"few_shot_rank":' || k || ',"doc":' || doc || '}}', ',' order by class, k, doc) || ']' as examples from c group by 1"""),
    "candidate_pools": (candidate_pools, "with s as (select doc, class, case when doc % 2 = 0 then 'dv' else 'boc' end as case_type from (select vec_id // 5 as doc, min(label) as class from embeddings group by 1)), r as (select *, row_number() over (partition by case_type, class order by doc) as k from s qualify k <= 20) select case_type, class, string_agg(doc::varchar, ',' order by doc) as ids, count(*)::int as n from r group by all"),
    "pool_places": (pool_places, "with s as (select doc, class, case when doc % 2 = 0 then 'dv' else 'boc' end as case_type from (select vec_id // 5 as doc, min(label) as class from embeddings group by 1)) select *, row_number() over (partition by case_type, class order by doc) as place from s"),
    "binary_decisions": (binary_decisions, "with w as (select count(*) filter (label >= 3) / greatest(count(*) filter (label < 3), 1)::double as w from embeddings), e as (select vec_id, label, 1.0::double / (1.0::double + exp(-(embedding[1]::double * 9 - 1))) as p from embeddings) select vec_id, round(1.0::double - p, 6) as p0, round(p, 6) as p1, p >= 0.5 as positive, round(case when label < 3 then w else 1.0::double end, 6) as weight from e, w"),
    "window_slices": (window_slices, r"select doc_id, case when n <= 128 then 1 else (ceil((n - 128) / 100.0) + 1)::int end as n_windows, case when n <= 128 then n else (n - 100 * ceil((n - 128) / 100.0))::int end as last_size, least(4, case when n <= 128 then 1 else (ceil((n - 128) / 100.0) + 1)::int end)::int as n_spaced from (select doc_id, len(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w <> ''))::int as n from documents)"),
    "weighted_pool": (weighted_pool, "select vec_id // 4 as doc, count(*) as window_count, round(sum(embedding[1]::double * (label + 1)) / sum(label + 1), 5) as x0, round(sum(embedding[64]::double * (label + 1)) / sum(label + 1), 5) as x63 from embeddings group by 1"),
    "centroid": (centroid, "with l as (select vec_id // 5 as doc, unnest(embedding)::double as x, unnest(range(1, 65)) as i from embeddings), s as (select doc, i, avg(x) as x from l group by all), c as (select doc, list(x order by i) as c from s group by doc), f as (select vec_id // 5 as doc, embedding::double[] as v from embeddings where vec_id % 5 = 0) select c.doc, round(c[1], 5) as x0, round(list_dot_product(c, v) / (greatest(sqrt(list_dot_product(c, c)), 1e-9) * greatest(sqrt(list_dot_product(v, v)), 1e-9)), 5) as cos from c join f on c.doc = f.doc"),
    "class_weights": (class_weights, "select label, count(*) as n, round((select count(*) from embeddings) / ((select count(distinct label) from embeddings) * count(*))::double, 6) as weight from embeddings group by label"),
    "head_predictions": (head_predictions, _HEAD_PREDICTIONS),
    "head_losses": (head_losses, _HEAD_LOSSES),
    "attribution_long": (attribution_long, f"{_LONG} select case_id, sentence_idx, sentence_text, round(shap_value, 6) as shap_value from long"),
    "attribution_topn": (attribution_topn, f"{_LONG}, m as (select case_id, sentence_text as key, avg(shap_value) as mean from long group by all) select case_id, key, round(mean, 6) as mean, 'positive' as sign, row_number() over (partition by case_id order by m.mean desc, key)::int as rank from m where m.mean > 0 qualify rank <= 2 union all select case_id, key, round(mean, 6) as mean, 'negative' as sign, row_number() over (partition by case_id order by m.mean, key)::int as rank from m where m.mean < 0 qualify rank <= 2"),
    "attribution_corr": (attribution_corr, f"{_LONG}, c as (select case_id, count(*) filter (shap_value > 0) as n, round(sum(shap_value), 6) as t from long group by 1) select round(corr(n::double, t), 6) as r, (select t from c order by n, t limit 1) as at_shortest, (select t from c order by n desc, t desc limit 1) as at_longest from c"),
    "attribution_spread": (attribution_spread, f"{_LONG} select case_id % 2 as case_type, count(*) as n, round(avg(shap_value), 6) as mean, round(median(shap_value), 6) as median, round(stddev_samp(shap_value), 6) as std, round(avg(abs(shap_value)), 6) as mean_abs, round(max(abs(shap_value)), 6) as max_abs, round(avg((shap_value > 0)::int), 6) as share_positive from long group by 1"),
    "anchor_enrichment": (anchor_enrichment, f"{_LONG}, r as (select case_id, (sentence_idx % 3 = 0)::int as a, row_number() over (partition by case_id order by abs(shap_value) desc, sentence_idx) as k from long) select case_id, round(avg(a), 6) as rate, round(avg(a) filter (k <= 4), 6) as top_rate from r group by 1 union all select null, round(avg(a), 6), round(avg(a) filter (k <= 4), 6) from r"),
    "normalised_values": (normalised_values, "with c as (select event_type, count(*) as n from events where event_type is not null group by 1) select event_type, round((n - min(n) over ()) / nullif(max(n) over () - min(n) over (), 0)::double, 6) as normalised from c"),
    "annotation_matrix": (annotation_matrix, f"{_RESP} select case_id, " + ", ".join(f"coalesce(max(decision) filter (judge = 'J{i}'), '') as J{i}" for i in range(5)) + " from r group by 1"),
    "annotation_progress": (annotation_progress, f"{_RESP} select judge, count(*) as total, count(*) filter (trim(decision) <> '' and trim(confidence) <> '') as done, round(count(*) filter (trim(decision) <> '' and trim(confidence) <> '') / count(*)::double, 6) as ratio from r group by 1"),
    "annotation_pending": (annotation_pending, f"{_RESP}, o as (select judge, case when not (trim(decision) <> '' and trim(confidence) <> '') then place end as k from r) select judge, coalesce(min(k), 0) as first_incomplete, coalesce(string_agg(k::varchar, ',' order by k) filter (k is not null), '') as pending from o group by 1"),
    "state_upsert": (state_upsert, "with s as (select c_custkey as username, 'dv' as ramo, c_mktsegment as f, 'old' as u from customer), n as (select c_custkey * 2 as username, 'dv' as ramo, case when c_custkey % 2 = 0 then 'now' end as u from customer where c_custkey % 3 = 0) select coalesce(s.username, n.username) as username, 'dv' as ramo, s.f as finalizado_em, coalesce(n.u, s.u) as ultima_gravacao_em from s full join n on s.username = n.username"),
    "branch_assignment": (branch_assignment, "select c_custkey, case when c_custkey % 4 = 0 then 'dv' when ('0x' || substr(sha256(upper(trim(c_name))), 1, 2))::bigint % 2 = 0 then 'dv' else 'ic' end as branch from customer"),
    "case_orders": (case_orders, "select n_nationkey, n_regionkey::varchar as user, row_number() over (partition by n_regionkey order by sha256(n_regionkey || '|dv|' || n_nationkey), n_nationkey)::int as place from nation"),
}
