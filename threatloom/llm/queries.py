"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import balltree, bpe, chat, decontam, importance, langid, linededup, neardup, ngram_lm, pii, token_blocks, topk, urlfilter
from .common import held_path, stored, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
EVENT = "struct<seq:bigint,kind:string,turn:bigint,role:string,text:string>"


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = held_path(spark, "token-blocks")
    token_blocks.write_blocks(table(spark, sf_dir, "documents").select("doc_id", "text"), path, WORD_BPE, end_id=1)
    back = token_blocks.read_blocks(spark, path)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").cast("long").alias("ids_crc32"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~langid.held_out()), familiar=False)  # no column reads it
    return langid.predict(docs.select("doc_id", langid.held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"), 10)


OP3_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id vec_id, list_inner_product(q.v, c.v)::bigint score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::integer "rank", vec_id, score from s)
select query_id, "rank", vec_id, score from r where "rank" <= 10
"""


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE).select("doc_id", "ids")
    decoded = bpe.decode(encoded, BYTE_BPE)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP5_SQL = r"""
with d as (select doc_id, row_number() over () r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
n as (select item_id, w, least(10, len(w)) n from b where len(w) > 0),
i as (select distinct item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k : k + n - 1], ' '))) win from n),
s as (select r, n, unnest(range(1, len(w) - n + 2)) k, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k : k + n - 1], ' '))) win
      from d, (select distinct n from n) where len(w) >= n),
h as (select r, k, s.n, item_id from s join i on s.n = i.n and s.win = i.win),
p as (select r, count(distinct spot) n_hit from (select r, unnest(range(k, k + n)) spot from h) group by r),
q as (select r, count(*) n_items, sha256(string_agg(item_id::varchar, ',' order by item_id::varchar)) items_sha256 from (select distinct r, item_id from h) group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, coalesce(items_sha256, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join p using (r) left join q using (r)
"""


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "block_odds")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitised(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", *[n(k) for k in range(4)], digest(pii.listed("base")).alias("base_sha256"), pii.listed("spans").alias("spans"), digest(F.col("sanitised")).alias("sanitised_sha256"))


def conversation_log(rows: DataFrame) -> DataFrame:
    """A log whose fold gives the rows (conv_id, turn, role, text) back, the n-th of a conversation as turn 2 n.

    Every text is streamed in two deltas. One in three is a regeneration of an abandoned draft; one in
    three is a draft that an edit mends while the next turns are already under way; and one in four is
    followed by a turn that is deleted later.
    """
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    event = lambda step, kind, role, text, turn=0: F.struct((100 * F.col("n") + step).alias("seq"), F.lit(kind).alias("kind"), (2 * F.col("n") + turn).alias("turn"), role.cast("string").alias("role"), text.cast("string").alias("text"))
    some = lambda rest, of, *events: F.when(F.col("n") % of == rest, F.array(*events)).otherwise(F.array().cast(f"array<{EVENT}>"))
    none, role = F.lit(None), F.col("role")
    events = F.concat(
        some(1, 3, event(0, "delta", role, F.lit("an abandoned draft")), event(1, "regenerate", none, none)),
        F.array(event(10, "delta", role, F.when(F.col("n") % 3 == 2, F.lit("a draft")).otherwise(first)), event(11, "delta", none, second)),
        some(2, 3, event(250, "edit", none, F.col("text"))),
        some(0, 4, event(20, "delta", F.lit("user"), F.lit("withdrawn"), 1), event(120, "delete", none, none, 1)),
    )
    each = rows.withColumn("n", n.cast("long")).select("conv_id", F.explode(events).alias("e"))
    return each.select(F.col("conv_id").alias("conv"), "e.*")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    return chat.read_back(stored(chat.render(conversation_log(rows)), "chat-pieces"))


OP10_SQL = r"""
with c as (select conv_id, turn, coalesce(nullif(role, ''), 'user') as speaker, coalesce(text, '') as said, role, text
           from (select conv_id, turn, role, text from conversations
                 union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'))
select conv_id, count(*)::bigint n_turns,
       sha256(string_agg(speaker || chr(10) || said || chr(10), '' order by turn nulls first, role nulls first, text nulls first)) turns_sha256,
       coalesce(sum(length(said)) filter (where speaker = 'assistant'), 0)::bigint loss_chars,
       sha256(coalesce(string_agg(said, '' order by turn nulls first, role nulls first, text nulls first) filter (where speaker = 'assistant'), '')) loss_sha256,
       sum(length('### ' || regexp_replace(speaker, '[\\#<:]', '__', 'g') || ': ' || regexp_replace(said, '[\\#<]', '__', 'g') || ' </turn>' || chr(10)))::bigint formatted_chars
from c group by conv_id
"""


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(table(spark, sf_dir, "documents"), ngram_lm.held_out())


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.cluster(balltree.integer_vectors(table(spark, sf_dir, "embeddings")))


def _op12_sql(rounds: int = balltree.ROUNDS) -> str:
    """Rounds of assignment and means, one after the other."""
    near = lambda t: f"(select vec_id, v, row_number() over (partition by vec_id, v order by d, n) first, n, d from (select vec_id, v, n, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint d from v, {t}))"
    parts = [
        "v as materialized (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) v from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)",
        "c0 as materialized (select row_number() over (order by sha256('3:' || vec_id)) - 1 n, v c from v order by sha256('3:' || vec_id) limit 8)",
    ]
    for i in range(rounds):
        parts.append(f"a{i} as materialized (select n, v from {near(f'c{i}')} where first = 1)")
        parts.append(f"m{i} as materialized (select n, list(x order by i) c from (select n, i, floor(sum(x) / count(*))::bigint x from (select n, generate_subscripts(v, 1) i, unnest(v) x from a{i}) group by n, i) group by n)")
        parts.append(f"c{i + 1} as materialized (select n, coalesce(m{i}.c, c{i}.c) c from c{i} left join m{i} using (n))")
    parts.append(f"z as materialized (select * from {near(f'c{rounds}')} where first = 1)")
    last = f"select vec_id, n::integer \"cluster\", d distance, sum(d) over (partition by n)::bigint cluster_inertia, sum(d) over ()::bigint inertia, sha256(array_to_string(c, ',')) centroid_sha256 from z join c{rounds} using (n)"
    return f"with {', '.join(parts)} {last}"


OP12_SQL = _op12_sql()


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = r"""
with recursive bits(b, k, c) as (select b, 0, b::bigint from range(256) r(b) union all select b, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8),
tab as materialized (select list(c order by b) t from bits where k = 8),
texts as (select row_number() over () r, doc_id, text from documents union all select -row_number() over (), null, text from benchmark),
words as materialized (select r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from texts),
grams as materialized (select r, g, count(*) m from (select r, array_to_string(w[i : i + n - 1], ' ') g from (select r, w, n, unnest(range(1, len(w) - n + 2)) i from words, range(1, 4) o(n))) group by r, g),
hashed as materialized (select g, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(regexp_replace(hex(encode(g)), '(..)', '\1 ', 'g')[:-2], ' '), lambda x: ('0x' || x)::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 10000 bucket
                        from (select distinct g from grams), tab),
held as materialized (select r, bucket, sum(m) m from grams join hashed using (g) group by r, bucket),
counts as (select bucket, coalesce(sum(m) filter (r > 0), 0)::double s, coalesce(sum(m) filter (r < 0), 0)::double t from held group by bucket),
gains as (select bucket, floor(1000 * ln((t + 1) * ((select sum(s) from counts) + 10000) / ((s + 1) * ((select sum(t) from counts) + 10000)))) gain from counts),
weights as (select r, sum(m)::bigint n_features, sum(m * gain)::bigint weight from held join gains using (bucket) group by r),
scored as (select r, doc_id, len(w) n, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight,
                  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[:8])::bigint + 0.5::double) / 4294967296)))::bigint score from words left join weights using (r) where r > 0),
ranked as (select *, row_number() over (partition by n >= 20 order by score desc, doc_id) place, count(*) over (partition by n >= 20) able from scored)
select doc_id, n_features, weight, score, case when n >= 20 and place <= 5 * able // 100 then place end "rank" from ranked
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    named = (op1_token_blocks, op2_language_id, op3_top_k, op4_byte_bpe, op5_decontamination, op6_near_duplicates, op7_line_dedup, op8_url_filter, op9_pii, op10_chat_format, op11_lm_scores, op12_centroid_clusters, op13_importance_resampling, pipeline)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op3_top_k": OP3_SQL, "op5_decontamination": OP5_SQL, "op10_chat_format": OP10_SQL, "op12_centroid_clusters": OP12_SQL, "op13_importance_resampling": OP13_SQL}
