"""Mixing sources to target weights by weighted fair queueing.

Sources by code point, null last, weigh WEIGHTS, repeating, and share a budget of words; a target stops at
MOST times its source's size and the excess is reshared by weight (water-filling, in whole numbers). Within a source the
documents stand in an order shuffled by hash and go through the queue up to MOST times. Each time is a service with a virtual finish time:
the words of its source up to its end, over the source's weight. Services are range-sorted by finish time over all sources, and
the mix is what comes before the total budget is used up. The service in which a source reaches its target is two, one up
to the target's last whole word and the rest of it, so that a source's words are its target rounded down.

A source's running sum is made in two steps, over hash buckets of about BUCKET rows and then within each, so a
source with a third of all rows is spread over tasks like any other; totals of buckets are summed in blocks. The range sort carries no texts and
gives one number, the last finish time within the budget. ``mixed`` then shuffles whole texts once, by source and bucket.

Defined results: null text has size 0 and takes nothing; null sources are one source; repeated rows are documents of
their own (ties in an order that doesn't change the result); an empty table gives an empty result; null ids are
allowed; a source without words has target 0; other columns are ignored by ``mix`` and kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.llm.common import WORD, Scratch
from siftline.sources.reading import table

WEIGHTS = (5, 2, 1)
MOST = 3
BUCKET = 4096
#: Numbers that are summed up in one go; totals of such blocks are summed up in a second.
BLOCK = 4096
#: Rows up to which bucket totals are broadcast (about 40 bytes each); beyond it Spark shuffles.
BROADCAST = 200_000
_GAP = r"[\x20\x09-\x0D]*+"


def targets(sources: DataFrame, budget: int | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, n, source_size, w, target) from (source, n, source_size), a row a source. Budget: all words unless given."""
    by_name = W.orderBy(F.col("source").isNull(), "source")
    rank = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    rows = sources.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    everything = W.partitionBy()
    rows = rows.withColumn("budget", F.sum("source_size").over(everything) if budget is None else F.least(F.lit(budget), F.sum("cap").over(everything)))
    # those that fill first stand first; each stops if its share of what is left then reaches its cap
    filled = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(filled), F.lit(0))
    of = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(filled), F.lit(0))
    rows = rows.withColumn("full", F.col("cap") * of <= F.col("w") * left)
    free = F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything)
    share = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(everything)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise((free * F.col("w")).cast("double") / share)
    return rows.select("source", "n", "source_size", "w", target.alias("target"))


def _before(rows: DataFrame, at: str, value: str, *by: str) -> DataFrame:
    """Adds ``before``, the sum of ``value`` of the rows with a lower ``at``, a whole number of its own for each row of a group."""
    block = F.floor(F.col(at) / BLOCK)
    rows = rows.withColumn("_block", block)
    blocks = rows.groupBy(*by, "_block").agg(F.sum(value).alias("_sum"))
    past = lambda c, order, *own: F.coalesce(F.sum(c).over(W.partitionBy(*own).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("_past", past("_sum", "_block", *by)).drop("_sum")
    joined = rows.withColumn("_own", past(value, at, *by, "_block")).join(blocks.withColumnsRenamed({c: f"_of_{c}" for c in (*by, "_block")}), _same(*by, "_block"))
    return joined.withColumn("before", F.col("_past") + F.col("_own")).drop("_past", "_own", "_block", *(f"_of_{c}" for c in (*by, "_block")))


def _same(*names: str) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return out


def _sized(docs: DataFrame, *keep: str) -> DataFrame:
    """Size, source and place in the shuffled order, called _size, _source, _h, and the columns in ``keep``."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    hashed = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.col("text").cast("string"), F.lit("")), F.lit(":mix")))  # rows without an id are dealt by their text
    return docs.select(*keep, F.col("doc_id").alias("_id"), F.col("source").cast("string").alias("_source"), size.alias("_size"), hashed.alias("_h"))


def _queued(rows: DataFrame, sources: DataFrame, totals: DataFrame | None, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows with _end, the words of their source up to theirs, n, source_size, w and target; and the buckets' totals, made if not given."""
    few = lambda x: F.broadcast(x) if x.limit(BROADCAST + 1).count() <= BROADCAST else x
    rows = rows.join(few(sources.withColumnsRenamed({c: f"_{c}" for c in ("n", "source_size", "w", "target")} | {"source": "_of_source"})), F.col("_source").eqNullSafe(F.col("_of_source")))
    place = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("_bucket", F.floor(place * F.ceil(F.col("_n") / BUCKET) / F.lit(2**32))).drop("_of_source")
    if totals is None:
        totals = rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_words"))
        totals = scratch.table(_before(totals, "_bucket", "_words", "_source").select(F.col("_source").alias("_of__source"), F.col("_bucket").alias("_of__bucket"), F.col("before").alias("_before")))
    own = F.sum("_size").over(W.partitionBy("_source", "_bucket").orderBy("_h", "_id", "_size").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_own", own).join(few(totals), _same("_source", "_bucket")).withColumn("_end", F.col("_before") + F.col("_own"))
    return rows.drop("_own", "_before", "_bucket", "_of__source", "_of__bucket", "_h"), totals


def _services(most: int) -> Column:
    """A document's services (p, words, finish), in order: its first, and as many more as begin before its source's target is reached."""
    share = F.floor("_target")
    none = F.array().cast("array<struct<p:int,words:bigint,finish:double>>")
    service = lambda p, words, end: F.struct(F.lit(p).alias("p"), words.cast("long").alias("words"), (end / F.col("_w")).alias("finish"))

    def turn(p: int) -> Column:
        end = F.col("_end") + F.col("_source_size") * p
        start = end - F.col("_size")
        crosses = (start < share) & (share < end)
        whole = F.array(service(p, F.col("_size"), end))
        return F.when(crosses, F.array(service(p, share - start, share), service(p, end - share, end))).when((start < share) | F.lit(p == 0), whole).otherwise(none)

    return F.when(F.col("_size") > 0, F.concat(*map(turn, range(most)))).otherwise(none)


def _last(rows: DataFrame, sources: DataFrame, scratch: Scratch) -> float:
    """The finish time of the last service within the budget: all services in order of finish, summed up."""
    budget = sources.agg(F.sum(F.floor("target"))).first()[0] or 0
    services = rows.select(F.explode("services").alias("x")).select("x.words", "x.finish")
    ordered = scratch.table(services.repartitionByRange("finish").withColumn("part", F.spark_partition_id()))
    parts = _before(ordered.groupBy("part").agg(F.sum("words").alias("words")), "part", "words").select("part", "before")
    running = F.col("before") + F.sum("words").over(W.partitionBy("part").orderBy("finish").rangeBetween(W.unboundedPreceding, 0))
    taken = ordered.join(F.broadcast(parts), "part").select("finish", running.alias("running")).where(F.col("running") <= budget)  # a row a task of the sort
    return taken.agg(F.max("finish")).first()[0] or 0.0


def _plan(docs: DataFrame, budget: int | None, weights: tuple[int, ...], most: int) -> tuple[DataFrame, DataFrame, DataFrame, float, Scratch]:
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.table(_sized(docs))
    sources = sized.groupBy(F.col("_source").alias("source")).agg(F.count("*").alias("n"), F.sum("_size").alias("source_size"))
    sources = scratch.table(targets(sources, budget, weights, most))
    rows, totals = _queued(sized, sources, None, scratch)
    rows = scratch.table(rows.withColumn("services", _services(most)))
    return rows, sources, totals, _last(rows, sources, scratch), scratch


def mix(docs: DataFrame, budget: int | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken, finish) of all documents; finish is that of the first service's last word."""
    rows, _, _, last, _ = _plan(docs, budget, weights, most)
    taken = F.aggregate(F.filter("services", lambda x: x["finish"] <= last), F.lit(0).cast("long"), lambda n, x: n + x["words"])
    return rows.select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken"), (F.col("_end") / F.col("_w")).alias("finish")
    )


def mixed(docs: DataFrame, budget: int | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: a row a service within the budget, so a document up to ``most`` times, with its columns and size, target, taken (the service's words) and finish.

    A service that ends at its source's target has that many of its text's words; n_chars follows where there is one.
    """
    _, sources, totals, last, scratch = _plan(docs, budget, weights, most)
    rows, _ = _queued(_sized(docs, *docs.columns), sources, totals, scratch)
    rows = rows.withColumn("_x", F.explode(F.filter(_services(most), lambda x: x["finish"] <= last)))
    cut = F.col("_x.words") < F.col("_size")
    pattern = F.concat(F.lit(rf"^{_GAP}(?:{WORD}+{_GAP}){{"), (F.col("_x.words") - 1).cast("string"), F.lit(rf"}}+{WORD}+"))
    rows = rows.withColumn("text", F.when(cut, F.regexp_substr("text", pattern)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    own = {"size": "_size", "target": "_target", "taken": "_x.words", "finish": "_x.finish"}
    return rows.select(*docs.columns, *(F.col(c).alias(name) for name, c in own.items() if name not in docs.columns))


def op2_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, text, '') || ':mix') AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::BIGINT AS w,
             3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS budget FROM s),
f AS (SELECT *, cap * ((sum(w) OVER ()) - coalesce(sum(w) OVER o, 0)) <= w * (budget - coalesce(sum(cap) OVER o, 0)) AS is_full
      FROM w WINDOW o AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, w, CASE WHEN is_full THEN cap::DOUBLE ELSE
        ((budget - (sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())) * w)::DOUBLE
        / (sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ())::DOUBLE END AS target FROM f),
q AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.w,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS done
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, floor(target)::BIGINT - (done - size)))
        + greatest(0, least(size, floor(target)::BIGINT - (done - size + source_size)))
        + greatest(0, least(size, floor(target)::BIGINT - (done - size + 2 * source_size))))::BIGINT AS taken,
       done::DOUBLE / w AS finish
FROM q
"""
