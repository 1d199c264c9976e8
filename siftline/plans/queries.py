"""One query for each operator, over whole tables of the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions import dates, urls
from siftline.functions import text as t
from siftline.functions.chunking import chunks as cut
from siftline.functions.chunking import hashed
from siftline.functions.dom import with_text
from siftline.operators import context, lexical, merge, quality, ranking
from siftline.plans import inputs
from siftline.plans.engine import Engine
from siftline.sources.scratch import materialized
from siftline.sources import tables
from siftline.sources.tables import as_json, page_texts, prompt_name, table

def documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _scored(s: SparkSession, d: str) -> DataFrame:
    return ranking.scored(inputs.chunks(s, d))


def _kept(s: SparkSession, d: str) -> DataFrame:
    """Scored chunks in rank order, as if all were selected."""
    return materialized(_scored(s, d).drop("tokens").withColumn("sel_pos", F.col("pos")), "scored")


def _turns(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").select("conv_id", "turn", F.col("text").alias("query"))


def lang_detect(s, d):
    return documents(s, d).select("doc_id", t.language("text").alias("detected"), t.query_language("text").alias("query_lang"))


def url_normalize(s, d):
    return table(s, d, "pages").select("page_id", urls.normalized(F.col("url")).alias("norm"), urls.engine_key(F.col("url")).alias("engine_key"))


def url_domain(s, d):
    return table(s, d, "pages").select("page_id", urls.domain(F.col("url")).alias("domain"), urls.authority(F.col("url")).alias("netloc"))


def redirect_unwrap(s, d):
    """All pages' addresses as both engines wrap them, unwrapped; a link that is not wrapped stays."""
    url = F.col("url")
    code = F.translate(F.rtrim(F.base64(url.cast("binary")), F.lit("=")), "+/", "-_")
    a = F.concat(F.lit("https://www.bing.com/ck/a?!&&p=1&u=a1"), code, F.lit("&ntb=1"))
    r = F.concat(F.lit("https://www.bing.com/ck/a?u=a1zzzz&r="), F.url_encode(url))
    b = F.concat(F.lit("https://duckduckgo.com/l/?uddg="), F.url_encode(url), F.lit("&rut=1"))
    rows = table(s, d, "pages").select("page_id", url, a.alias("a"), r.alias("r"), b.alias("b"))
    return rows.select("page_id", urls.unwrapped_a(F.col("a")).alias("a"), urls.unwrapped_a(F.col("r")).alias("r"), urls.unwrapped_b(F.col("b")).alias("b"), urls.unwrapped_a(urls.unwrapped_b(url)).alias("plain"))


def publish_date(s, d):
    """All events' times as pages write them, in forms that change with the hour, read back."""
    ts = F.col("ts").cast("timestamp_ntz")
    forms = ["yyyy-MM-dd'T'HH:mm:ss'+03:00'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH", "yyyy-MM-dd'T'HH:mm:ss'-05:00'", "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "yyyy", "yyyy-'13'-dd"]
    raw = F.get(F.array(*(F.date_format(ts, f) for f in forms)), F.hour(ts) % len(forms))
    return table(s, d, "events").select("event_id", F.date_format(dates.published(raw), "yyyy-MM-dd HH:mm:ss").alias("published"))


def result_hits(s, d):
    return tables.result_hits(inputs.result_pages(s, d))


def tokenize_df(s, d):
    rows = documents(s, d).select(F.explode(t.tokens("text")).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("n"))


def sentence_split(s, d):
    x = t.sentences("text")
    return documents(s, d).select("doc_id", F.size(x).cast("long").alias("sentences"), F.length(F.get(x, F.lit(0))).cast("long").alias("first_len"), F.size(t.paragraphs("text")).cast("long").alias("paragraphs"))


def query_topk(s, d):
    return _turns(s, d).select("conv_id", "turn", t.breadth("query").alias("top_k"))


def query_weights(s, d):
    w = t.weights("query")
    return _turns(s, d).select("conv_id", "turn", w["bm25"].alias("bm25_w"), w["semantic"].alias("semantic_w"))


def query_profile(s, d):
    rows = inputs.queries(s, d)
    p = t.profile("query")
    return rows.select("query_id", p["type"].alias("type"), p["intent"].alias("intent"), p["expected_length"].alias("expected_length"), F.array_join(p["critical_attributes"], ", ").alias("attributes"))


def news_flag(s, d):
    return _turns(s, d).select("conv_id", "turn", t.is_news("query").alias("news"), t.is_factoid("query").alias("factoid"))


def factual_flag(s, d):
    return documents(s, d).select("doc_id", t.has_facts("text").alias("factual"))


def garbage_lines(s, d):
    x = t.without_garbage("text")
    return documents(s, d).select("doc_id", F.length(x).cast("long").alias("n"), F.md5(x).alias("digest"))


def chunk_incomplete(s, d):
    return documents(s, d).select("doc_id", t.is_incomplete("text").alias("incomplete"))


def chunk_low_quality(s, d):
    return documents(s, d).select("doc_id", t.is_low_quality("text").alias("low_quality"))


def content_page(s, d):
    return documents(s, d).select("doc_id", t.is_content("text").alias("content"))


def hit_admission(s, d):
    rows = inputs.hits(s, d).withColumn("engine", F.lit("a")).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank", "url")))
    return merge.admitted(rows).select("query_id", "rank", "url")


def merge_results(s, d):
    out = merge.merged(inputs.hits(s, d).join(inputs.queries(s, d).select("query_id", "lang"), "query_id"), 20, F.col("lang"))
    return out.select("query_id", F.col("source_idx").cast("long").alias("source_idx"), "title", "url", "snippet", "score", F.array_join("engines", "+").alias("engines"))


def snippet_fallback(s, d):
    """Pages of the first results; a page whose words, tags cut off, are no content is missing."""
    results = merge.merged(inputs.hits(s, d), 20)
    pages = table(s, d, "pages").select("url", F.regexp_replace("html", "<[^>]*>", " ").alias("text"), F.lit(None).cast("timestamp_ntz").alias("pub_date"))
    out = merge.with_pages(results, pages.where(t.is_content("text")), keep=lambda text: F.length(text) > 50)
    return out.select("query_id", F.col("source_idx").cast("long").alias("source_idx"), "text", "fetched")


def html_extract(s, d):
    rows = with_text(table(s, d, "pages"))
    return rows.select("page_id", "page.text", "page.title", dates.published(F.col("page.date")).alias("pub_date"))


def page_fetch(s, d):
    return page_texts(table(s, d, "pages"))


def chunk_text(s, d):
    return documents(s, d).select("doc_id", F.posexplode(cut("text")).alias("chunk_idx", "chunk"))


def semantic_chunks(s, d):
    return documents(s, d).select("doc_id", F.posexplode(cut("text", embed=hashed)).alias("chunk_idx", "chunk"))


def chunk_filter(s, d):
    return quality.chunked(documents(s, d).select("doc_id", "text")).select("doc_id", "chunk_idx", "text")


def idf_stats(s, d):
    return lexical.idf(inputs.chunks(s, d)).select("query_id", "token", "df", F.round("idf", 6).alias("idf"))


def tfidf_cosine(s, d):
    return lexical.tfidf(inputs.chunks(s, d)).select("doc_id", F.round("similarity", 6).alias("similarity"))


def bm25_scores(s, d):
    return lexical.bm25(inputs.chunks(s, d)).select("doc_id", F.round("bm25", 6).alias("bm25"))


def bm25_topk(s, d):
    rows = lexical.bm25(inputs.chunks(s, d)).select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bm25"), "doc_id"))
    return rows.withColumn("place", place.cast("long")).where("place <= 8")


def answer_spans(s, d):
    rows = inputs.chunks(s, d).withColumn("a", ranking.answer_span(F.col("query"), F.col("text"))).where("a is not null")
    return rows.select("doc_id", F.round("a.score", 6).alias("score"), F.md5("a.full_sentence").alias("sentence"), F.length("a.span").cast("long").alias("span_len"))


def hybrid_score(s, d):
    return _scored(s, d).select("doc_id", "relevance", "bm25", F.col("pos").cast("long").alias("pos"))


def _similar(s, d):
    """Cosine of all vectors with the query's, which is vector 0: a scalar, an error if there are several."""
    asked = table(s, d, "embeddings").where("vec_id = 0").select("embedding").scalar()
    return table(s, d, "embeddings").select("vec_id", "embedding", asked.alias("q")).select("vec_id", merge.cosine(F.col("embedding"), F.col("q")).alias("similarity"))


def semantic_prefilter(s, d):
    return merge.relevant(_similar(s, d), F.col("similarity"), F.lit("en")).select("vec_id", F.round("similarity", 6).alias("similarity"))


def semantic_topk(s, d):
    return _similar(s, d).orderBy(F.desc("similarity"), "vec_id").limit(10).select("vec_id", F.round("similarity", 6).alias("similarity"))


def hybrid_semantic(s, d):
    v = table(s, d, "embeddings")
    rows = inputs.chunks(s, d).join(v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("e")), "doc_id", "left").join(v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qe")), "query_id", "left")
    return ranking.scored(rows, semantic=merge.cosine(F.col("e"), F.col("qe"))).select("doc_id", "semantic", "relevance")


def near_dedup(s, d):
    return ranking.selected(_scored(s, d), steps="dedup").select("doc_id", F.col("sel_pos").cast("long").alias("sel_pos"))


def source_caps(s, d):
    return ranking.selected(_scored(s, d), steps="caps").select("doc_id", F.col("sel_pos").cast("long").alias("sel_pos"))


def mmr_select(s, d):
    return ranking.selected(_scored(s, d), top_k=8, steps="mmr").select("doc_id", F.col("sel_pos").cast("long").alias("sel_pos"))


def island_merge(s, d):
    return ranking.islands(ranking.selected(_scored(s, d))).select("query_id", F.col("island").cast("long").alias("island"), F.md5("text").alias("digest"), "relevance", "doc_id")


def _ranked(s, d):
    return materialized(ranking.rerank(inputs.chunks(s, d), t.breadth("query")), "ranked")


def confidence(s, d):
    return ranking.confidence(_scored(s, d).drop("tokens")).select("doc_id", "points", "confidence", "confidence_note")


def source_relevance(s, d):
    rows = context.surviving(_kept(s, d), F.col("fetched"))
    return rows.groupBy("query_id", F.col("source_idx").cast("long").alias("source_idx")).agg(F.max("source_no").cast("long").alias("source_no"), F.count("*").alias("chunks"))


def ghost_sources(s, d):
    return context.ghosts(inputs.chunks(s, d), F.col("fetched")).withColumn("source_idx", F.col("source_idx").cast("long"))


def rerank(s, d):
    return _ranked(s, d).select("query_id", "island", "doc_id", "relevance", "confidence")


def context_build(s, d):
    ranked = _ranked(s, d)
    return context.contexts(ranked, context.surviving(ranked, F.col("fetched")))


def source_list(s, d):
    rows = _kept(s, d)
    return context.contexts(rows, context.surviving(rows, F.col("fetched"))).select("query_id", "source_list", F.length("context").cast("long").alias("context_len"), F.md5("context").alias("context_digest"))


def freshness_warning(s, d):
    rows = _kept(s, d)
    asked = rows.select("query_id", "query", "as_of").distinct()
    return context.freshness(context.surviving(rows, F.col("fetched")), asked)


def prompt_build(s, d):
    ranked = _ranked(s, d)
    return context.prompts(inputs.chunks(s, d).select("query_id", "query", "as_of").distinct(), ranked, F.col("fetched"))


def prompt_file_name(s, d):
    rows = inputs.queries(s, d)
    return rows.select("query_id", prompt_name(F.col("query"), F.col("as_of")).alias("file_name"))


def json_rows(s, d):
    return as_json(table(s, d, "conversations").select("conv_id", "turn", "role", "text"))


def search(s, d):
    engine = Engine(inputs.hits(s, d), table(s, d, "pages"))
    return engine.search(inputs.queries(s, d)).select("query_id", "source_idx", "title", "url", "score")


def search_and_read(s, d):
    engine = Engine(inputs.hits(s, d), table(s, d, "pages"))
    return engine.contexts(inputs.queries(s, d))


def ask(s, d):
    engine = Engine(inputs.hits(s, d), table(s, d, "pages"))
    return engine.ask(inputs.queries(s, d))


_OPERATORS = (
    lang_detect, url_normalize, url_domain, redirect_unwrap, publish_date, result_hits, tokenize_df, sentence_split, query_topk, query_weights, query_profile, news_flag, factual_flag,
    garbage_lines, chunk_incomplete, chunk_low_quality, content_page, hit_admission, merge_results, snippet_fallback, html_extract, page_fetch, chunk_text, semantic_chunks, chunk_filter,
    idf_stats, tfidf_cosine, bm25_scores, bm25_topk, answer_spans, hybrid_score, semantic_prefilter, semantic_topk, hybrid_semantic, near_dedup, source_caps, mmr_select, island_merge,
    confidence, source_relevance, ghost_sources, rerank, context_build, source_list, freshness_warning, prompt_build, prompt_file_name, json_rows, search, search_and_read, ask,
)
QUERIES = {f.__name__: f for f in _OPERATORS}
