"""Registered queries of the operators in this package, with their check SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm import (
    chat, collocations, decontam, jaccard, langid, lm, minhash, packing, quality, secrets, suffix, warc, whitening)
from winnow.llm.common import remainder

LLM_QUERIES: dict = {}
LLM_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def keep(build):
        LLM_QUERIES[name] = build
        if oracle is not None:
            LLM_ORACLES[name] = oracle
        return build

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_quality_rules")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, against those that are labelled good."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    return quality.with_quality(docs, trusted).drop("score")


@register("op2_warc", oracle="""
with p as (
  select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n from pages),
f as (select html, min(page_id) as first from p where n >= 100 group by html)
select p.page_id, cast(p.n as bigint) as payload_bytes, sha256(p.html) as payload_digest,
       case when p.page_id > f.first then 'revisit' else 'response' end as record_type,
       case when p.page_id > f.first then f.first end as refers_to
from p left join f on p.html = f.html and p.n >= 100""")
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as an archive record, read back: payloads for responses, heads for revisits."""
    path = warc.write_warc(warc.as_records(table(spark, sf_dir, "pages")))
    full = warc.read_warc(spark, path, types=["response"]).select(
        warc.page_id("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    heads = warc.read_warc(spark, path, types=["revisit"], payload=False).select(
        warc.page_id("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"),
        F.substring("payload_digest", 8, 64).alias("payload_digest"), "record_type",
        warc.page_id("refers_to").alias("refers_to"))
    return full.unionByName(heads)


@register("op3_decontamination")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that documents hold."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op4_chat_formatting", oracle=r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'),
                                  (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v),
written as (select *, length(regexp_replace(regexp_replace(text, '<(\\*)(s>|/s>)', '<\\\1\2', 'g'),
    '\[(\\*)(INST\]|/INST\]|ROLE\]|/ROLE\]|END\])', '[\\\1\2', 'g')) as n from rows)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(3 + sum(n + case role when 'user' then 15 when 'assistant' then 5 else 18 + length(role) end) as bigint)
    as formatted_chars
from written group by conv_id""")
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that is full of markers, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)],
                                  "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(rows.unionByName(added)))


@register("op5_lm_scoring")
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log-probability of every document, learned from nine tenths of them."""
    return lm.score(table(spark, sf_dir, "documents"))


@register("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_model(docs.select("doc_id", "text", "lang"))
    held_out = (remainder("doc_id", 4) == 2).alias("held_out")
    return langid.with_language(docs.select("doc_id", held_out, "text"), model).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected")


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


@register("op7_secret_scan")
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.with_secrets(docs, secrets.fit_field(docs))
    spans = F.col("secret_spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"] != "crf")
    return found.select("doc_id", *map(count, secrets.PATTERNS),
                        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register("op8_near_duplicates")
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@register("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@register("op10_suffix_array")
def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the strings of 400 bytes that occur elsewhere."""
    return suffix.without_repeats(table(spark, sf_dir, "documents"))


@register("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the unit-variance axes of all."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@register("op12_jaccard_join", oracle=r"""
with recursive words as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
places as (select doc_id, len(w) as size, unnest(w) as w1, generate_subscripts(w, 1) as i from words),
runs as (select *, lead(w1, 1) over p as w2, lead(w1, 2) over p as w3, lead(w1, 3) over p as w4, lead(w1, 4) over p as w5
  from places window p as (partition by doc_id order by i)),
shingles as materialized (select distinct doc_id, hash(concat_ws(' ', w1, w2, w3, w4, w5)) as s
  from runs where i <= greatest(size - 4, 1)),
sizes as materialized (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as n from shingles a join shingles b on a.s = b.s
  where a.doc_id < b.doc_id group by all),
links as materialized (select x, y from shared c join sizes p on p.doc_id = x join sizes q on q.doc_id = y
  where 100 * c.n >= 80 * (p.n + q.n - c.n)),
reach as (select x, y from links union select y, x from links
  union select r.x, l.y from reach r join (select x, y from links union select y, x from links) l on r.y = l.x),
least as (select x as doc_id, min(y) as y from reach group by x)
select d.doc_id, coalesce(s.n, 0) as n_shingles, least(d.doc_id, coalesce(l.y, d.doc_id)) as component_id
from documents d left join sizes s using (doc_id) left join least l using (doc_id)""")
def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of Jaccard similarity 0.8 or more."""
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


@register("op13_phrase_collocations", oracle=r"""
with lowered as (
  select doc_id, coalesce(lang, 'und') as lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as (select lang, row_number() over () as piece, words from (
  select lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as words from lowered)),
places as (select lang, piece, unnest(words) as w1, generate_subscripts(words, 1) as i from pieces),
runs as (select lang, w1, lead(w1, 1) over p as w2, lead(w1, 2) over p as w3, lead(w1, 3) over p as w4
  from places window p as (partition by piece order by i)),
grams as materialized (
  select lang, 1 as k, w1 as phrase, count(*) as f from runs group by all
  union all select lang, 2, w1 || ' ' || w2, count(*) from runs where w2 is not null group by all
  union all select lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) from runs where w3 is not null group by all
  union all select lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) from runs where w4 is not null group by all),
n as (select lang, cast(sum(f) as bigint) as n from grams where k = 1 group by lang),
cand as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from grams where k > 1 and f >= 30),
parts as materialized (
  select lang, phrase, a, j, lang || chr(9) || array_to_string(w[1:j], ' ') as p,
    lang || chr(9) || array_to_string(w[j + 1:k], ' ') as q
  from cand, (values (1), (2), (3)) js(j) where j < k),
cuts as (
  select c.lang, c.phrase, c.a, j, x.f as l, y.f as r, cast((2000000::hugeint * c.a) // (x.f + y.f) as bigint) as score
  from parts c join grams x on x.lang || chr(9) || x.phrase = c.p join grams y on y.lang || chr(9) || y.phrase = c.q),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
inside as (select c.lang, array_to_string(c.w[i:i + m - 1], ' ') as phrase, max(c.a) as within
  from cand c, (values (2), (3)) ms(m), (values (1), (2), (3)) is_(i)
  where m < c.k and i + m - 1 <= c.k group by all),
alone as (select b.* from best b left join inside x on x.lang = b.lang and x.phrase = b.phrase
  where x.within is null or 100::hugeint * x.within < 80::hugeint * b.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from alone)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000""")
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language that occur together rather than apart."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
