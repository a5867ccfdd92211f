"""The registered queries of the training-data operators (opN_<name>) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontam, html_tree, langid, lexical, media, mixing, passages, quality, secret_scan, simhash, tokens, whitening
from ._common import table


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, distance=simhash.DISTANCE)
    return out.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256 and all spans of every document."""
    out = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    every = secret_scan.spans_text(F.array_sort(F.concat("base", "linked")))
    return out.select(
        "doc_id", *[secret_scan.count_kind("base", k).alias(f"n_{k}") for k in secret_scan.BASE],
        F.sha2(secret_scan.spans_text(F.col("base")), 256).alias("base_sha256"), every.alias("spans"),
    )


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the files of token ids."""
    return tokens.encode_to_directory(table(spark, sf_dir, "documents"))


def op4_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, class_id, n_links of the image of every vector and of the edited copies
    of those whose id is divisible by 20 (under the id -vec_id - 1)."""
    images = media.media_of_vectors(table(spark, sf_dir, "embeddings"))
    return media.image_copies(images)[0].withColumnRenamed("id", "image_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    out = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontam.contaminated().alias("contaminated"),
    )


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, source and copies of every document."""
    out = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = html_tree.extract_text(pages, html_tree.train())
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_repeated, spans of every document that has repeated passages."""
    out = passages.repeated_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_repeated", F.array_join("spans", ",").alias("spans"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return out.select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"),
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, and of conversation -7, read back from the windows."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = ", ".join(f"cast({v} as {turns.schema[c].dataType.simpleString()}) as {c}" for c, v in (("conv_id", "-7"), ("turn", "turn"), ("role", "role"), ("text", "'</s>[INST] ok [/INST]'")))
    hard = spark.sql(f"select {kinds} from values (0, 'user'), (1, 'assistant') as t(turn, role)")
    return chat.conversation_digests(chat.format_conversations(turns.unionByName(hard)))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score of the ten best documents of every benchmark item."""
    index = lexical.build_index(table(spark, sf_dir, "documents"))
    found = lexical.search(index, table(spark, sf_dir, "benchmark"))
    lexical.drop_index(spark, index)
    return found


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept of every document."""
    return quality.judge(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable
    vector and its four largest components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_token_output": op3_token_output,
    "op4_image_copies": op4_image_copies,
    "op5_decontamination": op5_decontamination,
    "op6_source_mix": op6_source_mix,
    "op7_html_extraction": op7_html_extraction,
    "op8_repeated_passages": op8_repeated_passages,
    "op9_language_id": op9_language_id,
    "op10_chat_format": op10_chat_format,
    "op11_lexical_search": op11_lexical_search,
    "op12_quality_rules": op12_quality_rules,
    "op13_embedding_whitening": op13_embedding_whitening,
}

def _escaped_sql(x: str) -> str:
    """``chat.escape`` in SQL."""
    out = f"replace({x}, '\\', '\\\\')"
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


_MARK_CHARS = len(chat.TURN) + len(chat.TEXT) + len(chat.END)

ORACLE_SQL: dict[str, str] = {
    "op10_chat_format": rf"""
with recursive t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
  p as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as place,
    len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\x20\x09-\x0D]')) + {chat.MARKS} as n, length({_escaped_sql('role')}) + length({_escaped_sql('text')}) + {_MARK_CHARS} as chars from t),
  c as (select conv_id, max(case when place = 0 and role = 'system' then 1 else 0 end) as first, {chat.BUDGET} - sum(case when place = 0 and role = 'system' then n else 0 end) as room,
    sum(case when place = 0 and role = 'system' then chars else 0 end) as head, count(*) as many from p group by conv_id),
  s as (select p.conv_id, place, n, chars, c.first, c.room, c.head, sum(n) over (partition by p.conv_id order by place) as upto from p join c on p.conv_id is not distinct from c.conv_id),
  w(conv_id, win, a) as (select conv_id, 0, first from c where many > first
    union all select any_value(w.conv_id), any_value(w.win) + 1, min(x.place) from w
      join s on s.conv_id is not distinct from w.conv_id and s.place = w.a
      join s x on x.conv_id is not distinct from w.conv_id and x.place > w.a
        and x.upto - s.upto + s.n > s.room - case when w.win = 0 then 0 else greatest(0, least({chat.HISTORY}, s.room - s.n)) end
      group by w.conv_id, w.win),
  again as (select w.conv_id, w.win, any_value(s.head) as head, coalesce(sum(x.chars), 0) as chars from w
    join s on s.conv_id is not distinct from w.conv_id and s.place = w.a
    left join s x on x.conv_id is not distinct from w.conv_id and x.place < w.a and x.place >= s.first
      and s.upto - s.n - x.upto + x.n <= greatest(0, least({chat.HISTORY}, s.room - s.n))
    where w.win > 0 group by w.conv_id, w.win),
  more as (select conv_id, sum(head + chars) as chars from again group by conv_id)
select p.conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by place) filter (role = 'assistant'), '')) as loss_sha256,
  (sum(p.chars) + coalesce(any_value(more.chars), 0))::bigint as formatted_chars
from p left join more on more.conv_id is not distinct from p.conv_id group by p.conv_id
""",
    "op5_decontamination": r"""
with docs as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (select distinct item_id, least(13, len(w)) as n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from items where len(w) > 0)),
lengths as (select distinct n from windows),
places as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, lengths where len(w) >= n)),
hits as (select distinct p.doc_id, p.n, p.i, x.item_id from places p join windows x on p.n = x.n and p.g = x.g),
words as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from hits) group by doc_id),
named as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hits group by doc_id)
select d.doc_id, coalesce(len(d.w), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= coalesce(len(d.w), 0) as contaminated
from docs d left join words using (doc_id) left join named using (doc_id)
""",
    "op11_lexical_search": r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
q as (select row_number() over () as i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from benchmark),
c as (select count(*) as n_docs, sum(len(t))::bigint as n_terms from d where len(t) > 0),
asked as (select i, x, count(*) as repeats from (select i, unnest(t) as x from q) group by i, x),
p as (select r, x, count(*) as tf from (select r, unnest(t) as x from d) where x in (select x from asked) group by r, x),
w as (select x, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)))::bigint as w from p, c group by x),
m as (select r, doc_id, 25 + (75 * len(t)::bigint * n_docs) // n_terms as m from d, c where len(t) > 0),
scores as (select i, r, any_value(doc_id) as doc_id, sum(repeats * w.w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from asked join p using (x) join w using (x) join m using (r) group by i, r),
ranked as (select i, doc_id, score, row_number() over (partition by i order by score desc, doc_id nulls first)::integer as rank from scores where score > 0)
select item_id, rank, doc_id, score from ranked join q using (i) where rank <= 10
""",
    "op12_quality_rules": r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
windows as (select doc_id, any_value(len(w)) as n, list(i) as places from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)
  group by doc_id, array_to_string(w[i : i + 7], ' ') having count(*) > 1),
repeats as (select doc_id, count(distinct k) as n_repeat_words from (select doc_id, unnest(range(i, i + 8)) as k from (select doc_id, unnest(places) as i from windows)) group by doc_id),
s as (select d.doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    len(l) as n_lines, length(regexp_replace(t, '\P{Lu}+', '', 'g')) as n_capitals, length(regexp_replace(t, '\P{L}+', '', 'g')) as n_letters,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) as n_lettered, len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣]'))) as n_bullets,
    len(list_filter(l, lambda x: regexp_matches(x, '(?:\.\.\.|…)[\x20\x09-\x0D]*$'))) as n_ellipses
  from d left join repeats using (doc_id)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or n_symbols * 10 > n_words or word_chars < n_words * 3 or word_chars > n_words * 10 or n_dup_lines * 2 > n_lines
    or n_capitals * 2 > n_letters or n_lettered * 10 < n_words * 8 or n_bullets * 10 > n_lines * 9 or n_ellipses * 10 > n_lines * 3) as kept
from b
""",
}
