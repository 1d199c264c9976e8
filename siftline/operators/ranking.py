"""Ranking a query's chunks: hybrid scores, selection in order, merging of neighbours, confidence."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.config import Config
from siftline.functions import dates, urls
from siftline.functions import text as t
from siftline.operators.lexical import bm25, counted
from siftline.sources.scratch import materialized

SAME, MIX = 0.85, 0.7
DOMAIN, DROP = 3, 0.9


def answer_span(query: Column, text: Column, window: int = 200) -> Column:
    """(span, score, full_sentence): the sentence that holds most of a factoid query's tokens, and what stands around it; else null."""

    def asked(words: Column) -> Column:
        def score(s: Column, i: Column) -> Column:
            def of(own: Column) -> Column:
                value = F.size(F.array_intersect(words, own)) / F.size(words) + F.when(s.rlike(r"(?U)\d"), 0.3).otherwise(0.0)
                return F.struct(F.when(F.size(own) > 0, value).otherwise(0.0).alias("score"), (-i).alias("at"), s.alias("sentence"))

            return t.let(F.array_distinct(t.tokens(s)), of)

        def around(best: Column) -> Column:
            at = F.position(best["sentence"], text)
            start = F.greatest(F.lit(0), at - 1 - window // 2)
            end = F.least(F.length(text), at - 1 + F.length(best["sentence"]) + window // 2)
            span = F.struct(t.strip(F.substring(text, start + 1, end - start)).alias("span"), best["score"].alias("score"), best["sentence"].alias("full_sentence"))
            return F.when(best["score"] > 0.3, span)

        return F.when(F.size(words) > 0, t.let(F.array_max(F.transform(t.sentences(text), score)), around))

    return F.when(t.is_factoid(query), t.let(F.array_distinct(t.tokens(query)), asked))


def scored(chunks: DataFrame, config: Config | None = None, semantic: Column | None = None) -> DataFrame:
    """The chunks with bm25, semantic, answer_span, facts, relevance (four places) and pos, their rank in the query.

    Columns: query_id, query, text, source_idx, source_url, source_title, chunk_idx, pub_date, as_of. What is read from texts is written once;
    statistics and scores then read their own columns of that, and what ties and ranks need is narrow.
    """
    c = config or Config()
    rows = counted(chunks).withColumn("semantic", F.coalesce(semantic, F.lit(0.0)) if semantic is not None else F.lit(0.0))
    rows = rows.withColumn("answer_span", answer_span(F.col("query"), F.col("text"))).withColumn("facts", t.has_facts("text")).withColumn("_tie", F.md5("text"))
    rows = bm25(materialized(rows, "chunks"))
    w = t.weights("query")
    value = w["bm25"] * F.col("bm25") + w["semantic"] * F.col("semantic")
    value = value * F.when(F.col("answer_span").isNotNull(), 1.5).otherwise(1.0)
    if c.position_bonus:
        title = F.lower(F.coalesce("source_title", F.lit("")))
        value = value * F.when(F.col("chunk_idx") < 3, c.early_chunk_bonus).otherwise(1.0)
        value = value * F.when(F.exists("q", lambda x: F.contains(title, x)), c.title_match_bonus).otherwise(1.0)
    value = value * F.when(F.col("facts"), c.factual_data_bonus).otherwise(1.0)
    age = dates.hours(F.col("pub_date"), F.col("as_of"))
    fresh = F.when(age < 24, c.fresh_content_bonus).when(age < 168, c.recent_content_bonus).otherwise(1.0)
    value = value * F.when(t.is_news("query") & F.col("pub_date").isNotNull(), fresh).otherwise(1.0)
    rows = rows.withColumn("relevance", F.round(value, 4)).withColumn("bm25", F.round("bm25", 4)).withColumn("semantic", F.round("semantic", 4))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("relevance"), "source_idx", "chunk_idx", "_tie"))
    return rows.withColumn("pos", place).drop("q", "_tie")


class Picker:
    """Takes a query's chunks in rank order, one by one, until it has enough.

    A chunk falls if an earlier one that did not fall covers it: shared distinct tokens over the longer list's length. Of the others, a source gives
    ``per_source`` at most, and a domain's fourth and later must come near the mean relevance of what is taken. ``most`` of 0: all that do not fall.
    """

    def __init__(self, per_source: int = 0, most: int = 0):
        self.per_source, self.most = per_source, most
        self.covers: list[tuple[frozenset, int]] = []
        self.taken: list[tuple[int, float, frozenset]] = []
        self.held: Counter = Counter()
        self.total = 0.0

    @property
    def full(self) -> bool:
        return 0 < self.most <= len(self.taken)

    def see(self, pos: int, relevance: float, tokens: Iterable, size: int, source: int = 0, domain: str = "") -> None:
        own = frozenset(tokens)
        # a list that repeats itself too often for its distinct tokens to make up the share covers none, and none covers it
        if len(own) > SAME * size:
            if any(len(own & other) > SAME * max(size, n) for other, n in self.covers if min(len(own), len(other)) > SAME * max(size, n)):
                return
            self.covers.append((own, size))
        if self.most:
            crowded = self.held["domain", domain] >= DOMAIN and self.taken and relevance < DROP * (self.total / len(self.taken))
            if crowded or self.held["source", source] >= self.per_source:
                return
            self.held.update((("source", source), ("domain", domain)))
            self.total += relevance
        self.taken.append((pos, relevance, own))

    def diverse(self, k: int) -> list[tuple[int, float]]:
        """k of those taken: each the best by relevance less its greatest likeness to those before it; all in their order if there are no more than k."""
        if len(self.taken) <= k:
            return [x[:2] for x in self.taken]
        rest = {i: 0.0 for i in range(1, len(self.taken))}
        order, last = [0], self.taken[0][2]
        while rest and len(order) < k:
            for i, like in rest.items():
                own = self.taken[i][2]
                if own and last:
                    both = len(own & last)
                    rest[i] = max(like, both / (len(own) + len(last) - both))
            best = max(rest, key=lambda i: MIX * self.taken[i][1] - (1 - MIX) * rest[i])  # the first of equals
            del rest[best]
            order.append(best)
            last = self.taken[best][2]
        return [self.taken[i][:2] for i in order]


def per_source_cap(top_k: int, default: int) -> int:
    return 5 if top_k >= 25 else 4 if top_k >= 15 else default


def _fold(batches: Iterator[pa.RecordBatch], steps: str, default: int) -> Iterator[pa.RecordBatch]:
    """(query_id, pos, sel_pos) of rows sorted by query and rank. Holds one query's picks; what follows once they are full is passed over."""
    now, picker, k = None, None, 0

    def done() -> pa.RecordBatch:
        if steps in ("mmr", "all"):
            chosen = picker.diverse(min(int(1.5 * k), len(picker.taken)))
        else:
            chosen = [x[:2] for x in picker.taken]
        return pa.RecordBatch.from_arrays([pa.array([now] * len(chosen), pa.int64()), pa.array([p for p, _ in chosen], pa.int32()), pa.array(range(1, len(chosen) + 1), pa.int32())], ["query_id", "pos", "sel_pos"])

    for b in batches:
        query, pos, relevance, size, source, domain, top = (b.column(n).to_pylist() for n in (0, 1, 2, 4, 5, 6, 7))
        tokens = b.column(3)
        ends, hashes = tokens.offsets.to_pylist(), tokens.values.to_numpy()
        for i, q in enumerate(query):
            if picker is None or q != now:
                if picker is not None:
                    yield done()
                now, k = q, top[i]
                picker = Picker() if steps == "dedup" else Picker(per_source_cap(k, default), 2 * k)
            if not picker.full:
                picker.see(pos[i], relevance[i], hashes[ends[i] : ends[i + 1]].tolist(), size[i], source[i], domain[i])
    if picker is not None:
        yield done()


def selected(rows: DataFrame, top_k: Column | int | None = None, config: Config | None = None, steps: str = "all", cross: Column | None = None) -> DataFrame:
    """Scored rows that are chosen, with sel_pos. ``steps`` may end at "dedup", "caps" or "mmr".

    The order matters at each step, so each query's keys, token hashes and scores, without texts, are folded in rank order; a query's chunks need
    not fit into memory. ``cross``, a model's score, is computed for the chosen alone; where more than top_k are, they are ranked anew by 0.6 relevance + 0.4 of it.
    """
    default = (config or Config()).top_chunks_per_page
    top = t.breadth("query") if top_k is None else F.lit(top_k) if isinstance(top_k, int) else top_k
    hashes = F.transform(F.array_distinct("tokens"), lambda x: F.xxhash64(x))
    domain = urls.domain(F.coalesce("source_url", F.lit("")))
    keys = rows.select("query_id", "pos", "relevance", hashes.alias("tokens"), F.size("tokens").alias("size"), "source_idx", domain.alias("domain"), top.cast("int").alias("top_k"))
    folded = keys.repartition("query_id").sortWithinPartitions("query_id", "pos").mapInArrow(lambda it: _fold(it, steps, default), "query_id long, pos int, sel_pos int")
    out = rows.drop("tokens").join(folded, ["query_id", "pos"])
    if steps != "all":
        return out
    out = out.withColumn("_top", top)
    if cross is not None:
        by = W.partitionBy("query_id")
        out = out.withColumn("_cross", cross)
        again = (F.count("*").over(by) > F.col("_top")) & (F.count("_cross").over(by) == F.count("*").over(by))
        out = out.withColumn("relevance", F.when(again, 0.6 * F.col("relevance") + 0.4 * F.col("_cross")).otherwise(F.col("relevance"))).withColumn("_again", again)
        place = F.row_number().over(by.orderBy(F.when(F.col("_again"), -F.col("relevance")), "sel_pos"))
        out = out.withColumn("sel_pos", place).drop("_cross", "_again")
    return out.where(F.col("sel_pos") <= F.col("_top")).drop("_top")


def islands(rows: DataFrame) -> DataFrame:
    """Neighbours in selection order, of one source and at most two chunks apart, as one row: texts joined, best relevance, the rest of the first."""
    by = W.partitionBy("query_id").orderBy("sel_pos")
    joined = (F.lag("source_idx").over(by) == F.col("source_idx")) & (F.abs(F.col("chunk_idx") - F.lag("chunk_idx").over(by)) <= 2)
    rows = rows.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_new")
    rest = [c for c in rows.columns if c not in ("query_id", "island", "text", "relevance", "facts")]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sel_pos", "text"))), lambda x: x["text"]), "\n\n")
    first = F.min_by(F.struct(*rest), "sel_pos").alias("first")
    return rows.groupBy("query_id", "island").agg(text.alias("text"), F.max("relevance").alias("relevance"), first).select("query_id", "island", "text", "relevance", "first.*")


def confidence(rows: DataFrame) -> DataFrame:
    """The rows with confidence (HIGH, MEDIUM, LOW) and confidence_note, from relevance, age, facts, source and length."""
    mean = F.avg("relevance").over(W.partitionBy("query_id"))
    age = dates.hours(F.col("pub_date"), F.col("as_of"))
    news, days = t.is_news("query"), age / 24
    dated = F.col("pub_date").isNotNull()
    number = F.size(t.pieces("text"))
    points = (
        F.when(F.col("relevance") > 0.7, 3.0).when(F.col("relevance") > 0.4, 2.0).when(F.col("relevance") > 0.2, 1.0).otherwise(0.0)
        + F.when((F.col("_mean") > 0) & (F.col("relevance") > F.col("_mean") * 1.3), 1.0).otherwise(0.0)
        + F.when(~dated, 1.0).when(age < 24, 3.0).when(age < 168, 2.0).when(age < 720, 1.0).otherwise(0.0)
        - F.when(dated & news & (days > 30), 2.0).when(dated & news & (days > 7), 1.0).otherwise(0.0)
        + F.when(F.col("facts") if "facts" in rows.columns else t.has_facts("text"), 2.0).otherwise(0.0)
        + F.when(F.col("source_idx") < 3, 1.0).when(F.col("source_idx") < 6, 0.5).otherwise(0.0)
        + F.when(number > 100, 1.0).when(number > 50, 0.5).otherwise(0.0)
    )
    whole = days.cast("int").cast("string")
    note = F.when(dated & news & (days > 30), F.concat(F.lit("outdated ("), whole, F.lit(" days old)"))).when(dated & news & (days > 7), F.concat(F.lit("dated ("), whole, F.lit(" days old)")))
    rows = rows.withColumn("_mean", mean).withColumn("points", points)
    label = F.when(F.col("points") >= 7, "HIGH").when(F.col("points") >= 4, "MEDIUM").otherwise("LOW")
    return rows.withColumn("confidence", label).withColumn("confidence_note", note).drop("_mean")


def rerank(chunks: DataFrame, top_k: Column | int | None = None, config: Config | None = None, semantic: Column | None = None, cross: Column | None = None) -> DataFrame:
    """All steps: scores, selection, islands, confidence."""
    return confidence(islands(selected(scored(chunks, config, semantic), top_k, config, "all", cross)))
