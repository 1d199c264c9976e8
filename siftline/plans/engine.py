"""The engine: search, evidence and prompts for many queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.config import Config
from siftline.functions import text as t
from siftline.operators import context, merge, quality, ranking
from siftline.scoring import Scorer
from siftline.sources.scratch import materialized
from siftline.sources.tables import page_texts


@dataclass
class Engine:
    """hits (query_id, engine, rank, title, url, snippet), pages (url, html) or their texts (url, text, pub_date), settings.

    Queries are (query_id, query, lang, as_of). ``scorer`` holds models of texts, ``extract`` may be another extractor of pages' text. Where hits have a
    flag ``news``, those of engine b count that were asked for as the query is news or not.
    """

    hits: DataFrame
    pages: DataFrame
    config: Config = field(default_factory=Config)
    scorer: Scorer = field(default_factory=Scorer)
    extract: Callable[[str], str | None] | None = None

    def search(self, queries: DataFrame, num: int = 20) -> DataFrame:
        """Merged results, best first."""
        rows = self.hits.where(F.col("rank") <= self.config.num_per_engine).join(queries.select("query_id", "query", "lang"), "query_id")
        if "news" in rows.columns:
            rows = rows.where((F.col("engine") != "b") | (F.coalesce("news", F.lit(False)) == t.is_news("query"))).drop("news")
        out = merge.merged(rows.drop("query"), num, F.col("lang"))
        return out.join(queries.select("query_id", "query", "lang", "as_of"), "query_id")

    def results(self, queries: DataFrame) -> DataFrame:
        """The results whose pages are read."""
        found = self.search(queries)
        near = self.scorer.similarity(F.col("query"), F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))), F.col("lang"))
        if near is not None:
            found = merge.renumbered(merge.relevant(found.withColumn("_near", near), F.col("_near"), F.col("lang")).drop("_near"))
        return materialized(found.where(F.col("source_idx") < self.config.top_n_fetch), "results")

    def _is_content(self, text: Column) -> Column:
        listed = F.when(t.is_price_list(text), t.preview(text))
        return (F.length(text) > 50) & t.is_content(text, self.scorer.similarity(F.col("query"), listed, F.col("lang")))

    def evidence(self, queries: DataFrame) -> DataFrame:
        """Chunks of the results' pages, or snippets where pages are missing. Only the pages that results name are parsed."""
        found, pages, c = self.results(queries), self.pages, self.config
        keep = None
        if "html" in pages.columns:
            wanted = pages.join(found.select("url").distinct(), "url", "left_semi")
            pages, keep = page_texts(wanted, gate=False, extract=self.extract), self._is_content
        rows = merge.with_pages(found, pages, c.top_n_fetch, keep).withColumnsRenamed({"url": "source_url", "title": "source_title"}).drop("score", "engines", "snippet")
        return quality.chunked(rows, c.chunk_size, c.chunk_overlap, c.max_content_chars, self.scorer.embed, "lang")

    def read(self, queries: DataFrame) -> DataFrame:
        """Ranked chunks with confidence."""
        pair = F.col("query"), F.col("text"), F.col("lang")
        ranked = ranking.rerank(self.evidence(queries), t.breadth("query"), self.config, self.scorer.similarity(*pair), self.scorer.relevance(*pair))
        return materialized(ranked, "ranked")

    def contexts(self, queries: DataFrame) -> DataFrame:
        ranked = self.read(queries)
        return context.contexts(ranked, context.surviving(ranked, F.col("fetched")))

    def prompts(self, queries: DataFrame) -> DataFrame:
        return context.prompts(queries, self.read(queries), F.col("fetched"))

    def ask(self, queries: DataFrame, answer: Callable[[str], str] | None = None) -> DataFrame:
        """Prompts, and with a model's function their answers."""
        rows = self.prompts(queries)
        if answer is None:
            return rows

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(answer=[answer(p) for p in b["prompt"]])

        return rows.mapInPandas(run, "query_id long, prompt string, answer string")
