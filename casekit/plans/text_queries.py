"""Queries on texts, pages, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.vectors import argmax, one_hot, smoothed, softmax
from ..operators import extract, profile, prompts, sentences
from ..vocabulary import ANCHOR_WEIGHTS, ANCHORS, CITY_COURTS, COURT_PATTERNS, TRUNCATION_MARK
from .stand_ins import table

_CLEAN = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_JOINED = f"with d as (select d.doc_id, quality, list_filter(string_split({_CLEAN}, ' '), lambda w: w <> '') as w, text from documents d join labels l on d.doc_id = l.doc_id)"
_SQUEEZED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace({_SQUEEZED}, '([.!?;:])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) >= 8)"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")


def _tokens():
    return t.words(t.clean_basic(F.col("text")))


def text_metrics(spark, sf_dir):
    out = profile.text_metrics(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.md5("clean_text").alias("clean_md5"), "raw_length", "clean_length", "word_count")


def length_quantiles_by_class(spark, sf_dir):
    return profile.box_statistics(_docs(spark, sf_dir), "quality", F.length("text")).select("quality", "n", "q1", "median", "q3", "low", "high")


def top_tokens_by_class(spark, sf_dir):
    return profile.top_terms(_docs(spark, sf_dir), "quality", _tokens())


def top_tokens_no_stop_words(spark, sf_dir):
    return profile.top_terms(_docs(spark, sf_dir), "quality", t.without_stop_words(_tokens(), ("the", "de", "und", "la")))


def top_bigrams_by_class(spark, sf_dir):
    return profile.top_ngrams(_docs(spark, sf_dir), "quality", _tokens(), 2)


def top_trigrams_by_class(spark, sf_dir):
    return profile.top_ngrams(_docs(spark, sf_dir), "quality", _tokens(), 3)


def tfidf_top_terms(spark, sf_dir):
    out = profile.top_tfidf(_docs(spark, sf_dir), "quality", "doc_id", _tokens(), 15)
    return out.select("quality", "term", F.round("score", 6).alias("score"), "rank")


def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t.sentences(F.col("text"))).alias("n"), F.md5(F.array_join(t.sentences(F.col("text")), "|")).alias("md5"))


def anchor_scores(spark, sf_dir):
    rows = sentences.sentence_table(table(spark, sf_dir, "documents").withColumn("text", F.concat("text", F.when(F.col("doc_id") % 3 == 0, ". Dos factos provados resulta dos autos; não assiste razão.").otherwise(""))), "doc_id", "text")
    out = rows.select("doc_id", F.round(sentences.anchor_score(F.col("sentence")), 6).alias("score"), F.array_join(sentences.anchor_groups(F.col("sentence")), ",").alias("groups"), t.sentence_tokens(F.col("sentence")).alias("tokens"))
    return out.where("score > 0")


def truncate_head_tail(spark, sf_dir):
    cut = t.truncate_middle(F.col("text"), 200)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(cut["text"]).alias("md5"), cut["truncated"].alias("truncated"), t.text_tokens(F.col("text")).alias("tokens"))


def think_strip(spark, sf_dir):
    turn = table(spark, sf_dir, "conversations")
    raw = t.compose_output(F.col("text"), F.when(F.col("turn") % 2 == 1, F.concat(F.lit("why "), F.col("role"))))
    return turn.select("conv_id", "turn", F.md5(t.strip_thinking(raw)).alias("answer_md5"), t.thinking(raw).alias("thinking"))


def prompt_messages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = prompts.with_prompts(docs, "dv", "doc_id", "text", max_tokens=600)
    system, user = (F.col("messages")[i]["content"] for i in (0, 1))
    return out.select("doc_id", "prompt_truncated", F.md5(system).alias("system_md5"), F.md5(user).alias("user_md5"), F.length(user).alias("user_chars"), F.size("messages").alias("n_messages"))


def prompt_examples(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 100).alias("text"))
    one = F.struct(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("n_processo"), F.lit("some text").alias("text"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("first."), F.lit("second."))).alias("selected_sentences"), F.lit("decisao_mantida").alias("label"))
    docs = docs.withColumn("examples", F.array(one, one))
    out = prompts.with_prompts(docs, "boc", "doc_id", "text", "examples", reasoning=True)
    return out.select("doc_id", F.md5(F.col("messages")[0]["content"]).alias("system_md5"), F.md5(F.col("messages")[1]["content"]).alias("user_md5"))


def json_label_validate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 5 == 0, "nope").otherwise(F.col("event_type"))
    raw = F.when(F.col("event_id") % 7 == 0, "no json").otherwise(F.concat(F.lit("<think>x</think>So: {\"predicted_label\": \""), kind, F.lit("\"}")))
    types = ["click", "view", "purchase", "login", "logout", "signup", "search", "error"]
    out = e.select("event_id", prompts.predicted_label(raw, types).alias("label"))
    return out.groupBy("label").agg(F.count("*").alias("n"))


def one_hot_smoothing(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    code = F.col("label").cast("int")
    hot, soft = one_hot(code, 10), smoothed(code, 10)
    return v.select("vec_id", F.array_join(F.transform(hot, lambda x: x.cast("int")), "").alias("hot"), argmax(soft).alias("pick"), F.round(F.get(softmax(hot), code), 6).alias("soft"), F.round(F.get(soft, F.lit(0)), 6).alias("first"))


def page_title_and_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", extract.page_title(F.col("html")).alias("title"), F.md5(extract.html_text(F.col("html"))).alias("text_md5"))


def page_links(spark, sf_dir):
    return extract.page_links(table(spark, sf_dir, "pages"), "html", ("page_id",))


def court_link_rules(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.concat(F.when(F.col("page_id") % 2 == 0, "/jtrl.nsf/").otherwise("/other.nsf/"), F.md5(F.col("page_id").cast("string")), F.when(F.col("page_id") % 3 == 0, "?OpenDocument").when(F.col("page_id") % 3 == 1, "?SearchView").otherwise("/x")).alias("href"))
    return extract.court_links(pages, "jtrl", "https://host.example")


def field_extract(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Processo: "), F.col("doc_id").cast("string"), F.lit("/20\nRelator:  ANA "), F.col("source"), F.lit("\nData do Acordão: 01-02-2020\nVotação: UNANIMIDADE\nTexto Integral: S\nDescritores: contrato; mora, "), F.col("lang"), F.lit("\nDecisão: Negado provimento.\n")).alias("page"))
    out = extract.extract_fields(d, "dv", "page")
    return out.select("doc_id", "n_processo", "juiz_relator", "data_acordao", "votacao", "meio_processual", "decisao", "texto_integral_disponivel", F.array_join(extract.descriptors(F.col("page"), "dv"), "|").alias("descritores"))


def decision_cascade(spark, sf_dir):
    marker = F.when(F.col("doc_id") % 4 == 0, "\nIII - DECISÃO\n").when(F.col("doc_id") % 4 == 1, "\nPelo exposto, ").when(F.col("doc_id") % 4 == 2, "\nAcordam os juízes ").otherwise("\n")
    text = F.concat("text", marker, F.lit("julga-se improcedente o recurso e confirma-se a decisão recorrida nos seus precisos termos."))
    d = table(spark, sf_dir, "documents").select("doc_id", text.alias("full"))
    out = extract.split_decision(d, "full")
    return out.select("doc_id", "decision.metadata.extraction_method", "decision.metadata.confidence", "decision.metadata.requires_manual_review", F.length("decision.decisao_extraida").alias("n_decision"), F.length("decision.texto_sem_decisao").alias("n_rest"))


def court_repair(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "CSM").otherwise("TRX").alias("tribunal"), F.concat(F.when(F.col("doc_id") % 4 == 0, "Acordam no Tribunal da Relação de Lisboa. ").when(F.col("doc_id") % 4 == 2, "no supremo tribunal de justiça ").otherwise(""), F.col("text"), F.lit(" Porto")).alias("texto_integral_completo"))
    return extract.repair_court(d).select("doc_id", "tribunal")


def name_cleaning(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", t.safe_name(F.col("url")).alias("safe"), t.url_middle(F.col("url")).alias("middle"), t.display_label(F.col("url"), 20).alias("label"), t.safe_fragment(F.col("url")).alias("fragment"))


_TOP = "select quality, term, count(*) as freq, (row_number() over (partition by quality order by count(*) desc, term))::int as rank from ({}) group by 1, 2 qualify rank <= 20"


def _grams(n: int) -> str:
    return f"{_JOINED} " + _TOP.format(f"select quality, array_to_string(w[i : i + {n - 1}], ' ') as term from (select quality, w, unnest(range(1, len(w) - {n} + 2)) as i from d)")


_MARK = TRUNCATION_MARK.replace("\n", "' || chr(10) || '")
_ROOM = 800 - len(TRUNCATION_MARK)
_HEAD = int(_ROOM * 0.55)

_WITH_ANCHORS = "(select doc_id, text || case when doc_id % 3 = 0 then '. Dos factos provados resulta dos autos; não assiste razão.' else '' end as text from documents)"


def _anchor_sql() -> str:
    hit = {g: "(" + " or ".join(f"contains(lower(s), '{p}')" for p in phrases) + ")" for g, phrases in ANCHORS.items()}
    score = " + ".join(f"case when {hit[g]} then {w}::double else 0 end" for g, w in ANCHOR_WEIGHTS.items())
    groups = ", ".join(f"case when {c} then '{g}' end" for g, c in hit.items())
    return f"select * from (select doc_id, round(({score}) / {sum(ANCHOR_WEIGHTS.values())}, 6) as score, concat_ws(',', {groups}) as groups, greatest(1, floor(length(s) / 4) + 2)::int as tokens from (select doc_id, unnest({_SENTENCES}) as s from {_WITH_ANCHORS})) where score > 0"


def _court_sql() -> str:
    text = "case when doc_id % 4 = 0 then 'Acordam no Tribunal da Relação de Lisboa. ' when doc_id % 4 = 2 then 'no supremo tribunal de justiça ' else '' end || text || ' Porto'"
    city = lambda x: "case " + " ".join(f"when contains(lower({x}), '{n}') then '{c}'" for n, c in CITY_COURTS.items()) + " end"
    arms = [city(f"regexp_extract(h, '{p}', 1, 'i')") if "(" in p.replace("(?:", "") else f"case when regexp_matches(h, '{p}', 'i') then 'STJ' end" for p in COURT_PATTERNS]
    return f"select doc_id, case when t = 'CSM' then coalesce({', '.join(arms)}, {city('h')}, {city('f')}, t) else t end as tribunal from (select doc_id, case when doc_id % 2 = 0 then 'CSM' else 'TRX' end as t, substr(x, 1, n) as h, substr(x, length(x) - n + 1) as f from (select doc_id, x, greatest(1, floor(length(x) * 0.3))::int as n from (select doc_id, {text} as x from documents)))"


def _html_sql() -> str:
    out = "html"
    for tag in ("script", "style"):
        out = rf"regexp_replace({out}, '(?is)<{tag}\b[^>]*>.*?(?:</{tag}\s*>|$)', chr(1), 'g')"
    out = f"regexp_replace({out}, '(?s)<!--.*?(?:-->|$)', chr(1), 'g')"
    out = f"regexp_replace({out}, '(?s)<[/!?]?[A-Za-z][^>]*(?:>|$)|<![^>]*>', chr(1), 'g')"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("apos", "''"), ("nbsp", " "), ("amp", "&")):
        out = f"replace({out}, '&{name};', '{char}')"
    lines = rf"list_filter(list_transform(string_split({out}, chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
    return rf"select page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') as title, md5(array_to_string({lines}, chr(10))) as text_md5 from pages"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _prompt_sql(budget: int) -> str:
    least, mark = prompts.LEAST_TEXT_TOKENS, len(TRUNCATION_MARK)
    system = prompts.SYSTEM["dv"]
    return rf"""with a as (select doc_id, coalesce(text, '') as x, 'Processo: ' || doc_id || chr(10) || chr(10) || 'Texto da decisão:' || chr(10) as lead from documents),
  b as (select *, ceil({len(system)} / 4.0) + ceil((length(lead) + length(x)) / 4.0) as n, ceil(length(x) / 4.0) as own from a),
  c as (select *, 4 * greatest({least}, {budget} - (n - own))::bigint as most, n > {budget} as over from b),
  d as (select *, floor((most - {mark}) * 0.55::double)::bigint as head from c),
  e as (select *, over and length(x) > most as cut, case when over and length(x) > most then substr(regexp_replace(substr(x, 1, head), '\s+$', '') || '{_MARK}' || regexp_replace(substr(x, length(x) - (most - {mark} - head) + 1), '^\s+', ''), 1, most) else x end as y from d)
select doc_id, cut as prompt_truncated, md5({_quoted(system)}) as system_md5, md5(lead || y) as user_md5, length(lead || y)::int as user_chars, 2 as n_messages from e"""


def _examples_sql() -> str:
    one = lambda i: f"'[Exemplo {i}]' || chr(10) || 'Processo: p' || doc_id || chr(10) || 'Texto da decisão:' || chr(10) || case when doc_id % 2 = 0 then '- first.' || chr(10) || '- second.' else 'some text' end || chr(10) || 'Classificação: {{\"predicted_label\": \"decisao_mantida\"}}' || chr(10)"
    block = f"'Aqui estão 2 exemplos de classificações corretas:' || chr(10) || chr(10) || {one(1)} || chr(10) || {one(2)} || chr(10) || 'Agora classifica este processo:'".replace("{{", "{").replace("}}", "}")
    user = f"{block} || chr(10) || chr(10) || 'Processo: ' || doc_id || chr(10) || chr(10) || 'Texto da decisão:' || chr(10) || substr(coalesce(text, ''), 1, 100)"
    return f"select doc_id, md5({_quoted(prompts.SYSTEM['boc'] + prompts.REASONING)}) as system_md5, md5({user}) as user_md5 from documents"


def _cascade_sql() -> str:
    """The layers of each share of the text as columns, and a CASE over them."""
    from ..vocabulary import CASCADE, CASCADE_STARTS, DECISION_VERBS, REVIEW

    ctes = [
        rf"f as (select doc_id, text || case doc_id % 4 when 0 then chr(10) || 'III - DECISÃO' || chr(10) when 1 then chr(10) || 'Pelo exposto, ' when 2 then chr(10) || 'Acordam os juízes ' else chr(10) end || 'julga-se improcedente o recurso e confirma-se a decisão recorrida nos seus precisos termos.' as x from documents)"
    ]
    codes = []
    strip = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    for share in CASCADE_STARTS:
        columns, arms = [], []
        for i, (_, _, pattern, ignore, which, verbs, goes_on) in enumerate(CASCADE):
            scoped = f"({'?im' if ignore else '?m'}:{pattern})".replace("'", "''").replace("(?=", "(?:")  # no look-ahead there
            lead = "(?s:^(.*?))" if which == "first" else "(?s:^(.*))"
            columns.append(f"regexp_matches(part, '{scoped}') as m{i}, start + length(regexp_extract(part, '{lead}{scoped}', 1)) as a{i}")
            decision = strip(f"substr(x, a{i} + 1)")
            ok = f"length({decision}) > 50 and length({decision}) < 50000" + (f" and regexp_matches(substr({decision}, 1, 1000), '(?i){DECISION_VERBS}')" if verbs else "")
            arms.append(f"when m{i} and ({ok}) then {{'layer': {i}, 'at': a{i}}}" + ("" if goes_on else f" when m{i} then {{'layer': -1, 'at': 0}}"))
        ctes.append(f"s{share} as (select *, {', '.join(columns)} from (select doc_id, x, floor(length(x) * {share} / 100.0)::bigint as start, substr(x, floor(length(x) * {share} / 100.0)::bigint + 1) as part from f))")
        ctes.append(f"c{share} as (select doc_id, case {' '.join(arms)} end as c from s{share})")
        codes.append(f"case when c{share}.c.layer >= 0 then c{share}.c end")
    found = " ".join(f"join c{share} using (doc_id)" for share in CASCADE_STARTS)
    ctes.append(f"r as (select doc_id, x, case when length(x) >= 100 then coalesce({', '.join(codes)}) end as c from f {found})")
    name = "case c.layer " + " ".join(f"when {i} then '{layer[0]}'" for i, layer in enumerate(CASCADE)) + " else 'none' end"
    sure = "case c.layer " + " ".join(f"when {i} then '{layer[1]}'" for i, layer in enumerate(CASCADE)) + " else 'low' end"
    review = [i for i, layer in enumerate(CASCADE) if layer[0] in REVIEW]
    return f"with {', '.join(ctes)} select doc_id, {name} as extraction_method, {sure} as confidence, c is null or c.layer in ({', '.join(map(str, review))}) as requires_manual_review, length({strip('substr(x, c.at + 1)')})::int as n_decision, case when c is null then length(x) else length({strip('substr(x, 1, c.at)')}) end::int as n_rest from r"


PAIRS = {
    "text_metrics": (text_metrics, rf"select doc_id, md5(c) as clean_md5, coalesce(length(text), 3)::int as raw_length, length(c)::int as clean_length, len(list_filter(string_split(c, ' '), lambda w: w <> ''))::int as word_count from (select doc_id, text, {_CLEAN} as c from documents)"),
    "length_quantiles_by_class": (length_quantiles_by_class, "select quality, count(*) as n, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.75) as q3, min(v) as low, max(v) as high from (select quality, length(text)::double as v from documents d join labels l on d.doc_id = l.doc_id) group by 1"),
    "top_tokens_by_class": (top_tokens_by_class, f"{_JOINED} " + _TOP.format("select quality, unnest(w) as term from d")),
    "top_tokens_no_stop_words": (top_tokens_no_stop_words, f"{_JOINED} " + _TOP.format("select * from (select quality, unnest(w) as term from d) where term not in ('the', 'de', 'und', 'la')")),
    "top_bigrams_by_class": (top_bigrams_by_class, _grams(2)),
    "top_trigrams_by_class": (top_trigrams_by_class, _grams(3)),
    "tfidf_top_terms": (tfidf_top_terms, f"""{_JOINED}, tf as (select quality, doc_id, term, count(*) as tf from (select quality, doc_id, unnest(w) as term from d) group by all),
      n as (select quality, count(*) as n from d group by 1), df as (select quality, term, count(*) as df from tf group by all),
      w as (select tf.quality, doc_id, tf.term, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) as w, n from tf join df on tf.quality = df.quality and tf.term = df.term join n on tf.quality = n.quality),
      u as (select quality, term, w / sqrt(sum(w * w) over (partition by quality, doc_id)) as u, n from w),
      m as (select quality, term, round(sum(u) / any_value(n), 9) as score from u group by all)
      select quality, term, round(score, 6) as score, (row_number() over (partition by quality order by m.score desc, term))::int as rank from m qualify rank <= 15"""),
    "sentence_split": (sentence_split, f"select doc_id, len(s)::int as n, md5(array_to_string(s, '|')) as md5 from (select doc_id, {_SENTENCES} as s from documents)"),
    "anchor_scores": (anchor_scores, _anchor_sql()),
    "truncate_head_tail": (truncate_head_tail, rf"select doc_id, md5(case when length(text) <= 800 then text else substr(regexp_replace(substr(text, 1, {_HEAD}), '\s+$', '') || '{_MARK}' || regexp_replace(substr(text, length(text) - {_ROOM - _HEAD} + 1), '^\s+', ''), 1, 800) end) as md5, length(text) > 800 as truncated, ceil(length(text) / 4)::bigint as tokens from documents"),
    "think_strip": (think_strip, r"select conv_id, turn, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) as answer_md5, case when turn % 2 = 1 then 'why ' || role else '' end as thinking from conversations"),
    "prompt_messages": (prompt_messages, _prompt_sql(600)),
    "prompt_examples": (prompt_examples, _examples_sql()),
    "json_label_validate": (json_label_validate, "select case when event_id % 7 = 0 or event_id % 5 = 0 then null when event_type in ('click', 'view', 'purchase', 'login', 'logout', 'signup', 'search', 'error') then event_type end as label, count(*) as n from events group by 1"),
    "one_hot_smoothing": (one_hot_smoothing, "select vec_id, array_to_string(list_transform(range(10), lambda i: case when i = label then 1 else 0 end), '') as hot, label::int as pick, round(exp(1.0) / (exp(1.0) + 9), 6) as soft, round(case when label = 0 then 0.9 else 0.1 / 9 end, 6) as first from embeddings"),
    "page_title_and_text": (page_title_and_text, _html_sql()),
    "page_links": (page_links, r"select distinct page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*[\"'']([^\"'']*)[\"'']', 1)) as href from pages"),
    "court_link_rules": (court_link_rules, "select distinct 'https://host.example/jtrl.nsf/' || md5(page_id::varchar) || case when page_id % 3 = 0 then '?OpenDocument' else '/x' end as href from pages where page_id % 2 = 0 and page_id % 3 <> 1"),
    "field_extract": (field_extract, "select doc_id, doc_id || '/20' as n_processo, 'ANA ' || source as juiz_relator, '01-02-2020' as data_acordao, 'UNANIMIDADE' as votacao, null::varchar as meio_processual, 'Negado provimento.' as decisao, 'S' as texto_integral_disponivel, case when length(lang) > 2 then 'contrato|mora|' || lang || '|Decisão' else 'contrato|mora|Decisão' end as descritores from documents"),
    "decision_cascade": (decision_cascade, _cascade_sql()),
    "court_repair": (court_repair, _court_sql()),
    "name_cleaning": (name_cleaning, r"""select page_id, regexp_replace(url, '[/\\:*?"<>|]', '_', 'g') as safe, nullif(regexp_extract(url, '^[a-z]+://[^/]+/(.*)/[^/]*$', 1), '') as middle, case when length(url) > 20 then rtrim(substr(url, 1, 17)) || '…' else url end as label, regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g') as fragment from pages"""),
}
