"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lowstress.llm import bitsliced_topk, byte_bpe, chat_format, cross_polytope, decontaminate, divergence, importance, interpolated_lm, language_id, line_dedup, ngram_join, toxicity, url_filter
from lowstress.llm.sampling import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = (
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules=URL_RULES)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat_format.format_conversations(turns)
    out = out.withColumn("turns", chat_format.read_turns(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["in_loss"]), lambda s: chat_format.unescape(s["piece"])), "")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.withColumn("loss", loss).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "n_blocks",
    )


TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(TOKENIZER)
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, path).select(
        "doc_id", "n_tokens", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op7_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm.score_texts(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit_on(docs.where(crc_mod("doc_id", 3) != 1))
    return language_id.identify(docs, model).withColumn("held_out", crc_mod("doc_id", 3) == 1)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return bitsliced_topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op11_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_groups(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), share=(25, 100), seed=7)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_line_dedup": op2_line_dedup,
        "op3_ngram_join": op3_ngram_join,
        "op5_chat_format": op5_chat_format,
        "op4_toxicity": op4_toxicity,
        "op7_interpolated_lm": op7_interpolated_lm,
        "op8_language_id": op8_language_id,
        "op6_byte_bpe": op6_byte_bpe,
        "op9_decontaminate": op9_decontaminate,
        "op10_bitsliced_topk": op10_bitsliced_topk,
        "op11_cross_polytope": op11_cross_polytope,
        "op12_source_divergence": op12_source_divergence,
        "op13_importance_resample": op13_importance_resample,
    }


def _url_sql() -> str:
    lower = "translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    term = lambda t: f"coalesce(regexp_matches({lower}, '(^|[^\\p{{L}}\\p{{N}}]){t}([^\\p{{L}}\\p{{N}}]|$)'), false)"
    hits = lambda ts: "list_filter([" + ", ".join(f"case when {term(t)} then '{t}' end" for t in sorted(ts)) + "], lambda x: x is not null)"
    rule = "case " + " ".join(
        f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{r.action} {r.host}{r.path}'"
        for r in sorted(URL_RULES, key=lambda r: -len(r.host + r.path))
    ) + " end"
    return f"""
    with parts as (
      select page_id, url, strpos(coalesce(url, ''), '://') as pos, regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') as rest from pages),
    hp as (
      select page_id, url,
        case when pos > 0 then translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
        case when pos > 0 then regexp_extract(rest, '^[^/]*(.*)$', 1) else '' end as path from parts),
    judged as (select page_id, host, path, {rule} as r, {hits(url_filter.STRICT)} as strict_hits, {hits(url_filter.SOFT)} as soft_hits from hp)
    select page_id, host, path, substr(r, strpos(r, ' ') + 1) as rule,
      coalesce(substr(r, 1, strpos(r, ' ') - 1), case when len(strict_hits) + 0.5 * len(soft_hits) >= 1 then 'block' else 'allow' end) as verdict,
      strict_hits, soft_hits, cast(len(strict_hits) + 0.5 * len(soft_hits) as double) as weight
    from judged"""


def _chat_sql() -> str:
    esc = "replace({}, '\\', '\\\\')"
    for c in chat_format.CONTROL:
        esc = f"replace({esc}, '{c}', '{c[0]}\\{c[1:]}')"
    markers = f"{len(chat_format.START) + len(chat_format.SEP) + len(chat_format.END)} + length({esc.format('role')})"
    return f"""
    with t as (
      select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    m as (select *, coalesce(role <> lag(role) over (partition by conv_id order by turn, role, text), true) as starts from t)
    select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
      cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
      sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
      cast(sum(length({esc.format('text')}) + case when starts then {markers} else {len(chat_format.NEXT)} end) as bigint) as formatted_chars,
      count_if(starts) as n_blocks
    from m group by conv_id"""


_TOPK_SQL = """
    with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q from embeddings
      where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as bigint) as score
      from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)),
    r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
    select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5"""


_NEAR_SQL = """
    with recursive v as (
      select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
    good as (
      select vec_id, e, sqrt(list_dot_product(e, e)) as size from v
      where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
    links as (
      select a.vec_id as a, b.vec_id as b from good a join good b
      on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.9::double),
    reach(a, b) as (select vec_id, vec_id from v union select r.a, l.b from reach r join links l on l.a = r.b),
    least as (select a, min(b) as component_id from reach group by a),
    degree as (select a, count(*) as n from links group by a)
    select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
    from v join least on least.a = vec_id left join degree on degree.a = vec_id"""


_DIVERGENCE_SQL = """
    with docs as (
      select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
    in_docs as (select r, lang, source, term, count(*) as n from (select r, lang, source, unnest(w) as term from docs) group by all),
    kept as (select lang, term, sum(n)::hugeint as n from in_docs group by lang, term having count(*) >= 10),
    in_groups as (select lang, source, term, sum(n)::hugeint as n from in_docs join (select lang, term from kept) using (lang, term) group by all),
    groups as (select distinct lang, source from docs),
    v as (select lang, count(term)::hugeint as v, coalesce(sum(n), 0)::hugeint as total from (select distinct lang from docs) left join kept using (lang) group by lang),
    totals as (select lang, source, coalesce(sum(n), 0)::hugeint as total from groups left join in_groups using (lang, source) group by all),
    shares as (
      select g.lang, g.source, k.term, coalesce(i.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(i.n, 0) + 2) // (t.total + 2 * v.v) as p,
        1 + 1000000000::hugeint * (k.n + 2) // (v.total + 2 * v.v) as q
      from groups g join kept k using (lang) join v using (lang) join totals t using (lang, source) left join in_groups i on i.lang = g.lang and i.source = g.source and i.term = k.term),
    pairs as (
      select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
      from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
    every_pair as (
      select a.lang, a.source, b.source as item, coalesce(p.value, 0)::bigint as value from groups a join groups b on a.lang = b.lang and a.source <> b.source
      left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source),
    terms as (select lang, source, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from shares where n > 0 and p > q),
    found as (select lang, source, 'pair' as part, item, value from every_pair union all select lang, source, 'term', item, value from terms),
    ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from found)
    select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= 10"""


#: CRC-32 by its byte table, one feature at a time; every distinct feature is hashed once.
_RESAMPLE_SQL = """
    with texts as (
      select 0 as side, row_number() over () as r, doc_id, text from documents
      union all select 1, row_number() over (), null, text from benchmark),
    words as (
      select side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from texts),
    runs as (
      select side, r, unnest(w) as f from words
      union all select side, r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from words where len(w) > 1),
    counted as (select side, r, f, count(*) as n from runs group by all),
    byte_table as (
      select list(list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) order by i) as tab from range(256) t(i)),
    hashed as (
      select f, xor(4294967295, list_reduce(list_prepend(4294967295::bigint,
        list_transform(range(0, length(x), 2), lambda i: 16 * (strpos('0123456789ABCDEF', x[i + 1]) - 1) + strpos('0123456789ABCDEF', x[i + 2]) - 1)),
        lambda s, b: xor(s >> 8, tab[(xor(s, b) & 255) + 1]))) % 10000 as bucket
      from (select distinct f, hex(encode(f)) as x from counted), byte_table),
    by_bucket as (
      select bucket, coalesce(sum(n) filter (where side = 0), 0)::double as s, coalesce(sum(n) filter (where side = 1), 0)::double as t
      from counted join hashed using (f) group by bucket),
    total as (select coalesce(sum(s), 0) as s_all, coalesce(sum(t), 0) as t_all from by_bucket),
    gains as (select bucket, floor(1000 * ln(((t + 1) * (s_all + 10000)) / ((s + 1) * (t_all + 10000))))::bigint as gain from by_bucket, total),
    weights as (
      select r, sum(n)::bigint as n_features, floor(sum(n * gain) / sum(n)::double)::bigint as weight
      from counted join hashed using (f) join gains using (bucket) where side = 0 group by r),
    scored as (
      select r, doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((cast(concat('0x', substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8)) as bigint) + 0.5::double) / 4294967296)))::bigint as score
      from words left join weights using (r) where side = 0),
    ranked as (
      select r, row_number() over (order by score desc, doc_id nulls last, weight desc, n_features desc) as k from scored where n_words >= 20)
    select doc_id, n_features, weight, score, case when k <= (select count(*) * 25 // 100 from ranked) then k end as rank
    from scored left join ranked using (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _url_sql(), "op5_chat_format": _chat_sql(), "op10_bitsliced_topk": _TOPK_SQL, "op11_cross_polytope": _NEAR_SQL, "op12_source_divergence": _DIVERGENCE_SQL, "op13_importance_resample": _RESAMPLE_SQL}
