"""Benchmark decontamination by SimHash of item-sized windows, in SQL functions alone.

Words are lower-cased and cut at white space; SHINGLE of them make a shingle (an item of fewer words is one
shingle). A document is contaminated by an item if some window of the item's size, at any start, has a weighted-shingle
similarity of at least SIMILARITY with it: shingles weigh their number of occurrences, and the similarity is the sum of
the lesser weights over the sum of the greater.

Windows of m shingles are taken at every start at which enough of their shingles stand in some item of m shingles: a window that
similar to one of them cannot have fewer, so no start is lost, and which item it is stays open. Windows get a 64-bit
SimHash of their shingles. Fingerprints are cut into BLOCKS blocks; of two within RADIUS bits, some block differs in FLIPS bits
at most, so the items' blocks with all such flips are an index that proposes every item within RADIUS of a window
(multi-index). At the least similarity fingerprints differ by about 10 bits, give or take 3, so RADIUS lies over
four deviations off. Proposed items are verified exactly.

Defined results: null text and null items are empty and match nothing; documents shorter than an item are compared whole;
repeated rows give one result a (doc_id, item_id); a null doc_id is reported as null; equal items each report; empty tables give an
empty result; other columns are kept by ``clean`` and ignored by ``leaks``.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import SPACE, Scratch
from siftline.sources.reading import table

SHINGLE = 5
SIMILARITY = 0.8
#: Blocks of 8 bits, and the bits that may differ in the nearest: a radius under BLOCKS * (FLIPS + 1).
BLOCKS, FLIPS = 8, 2
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Rows up to which the items' side of a join is broadcast (about 50 bytes each); beyond it Spark shuffles.
BROADCAST = 500_000


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words(text: Column) -> Column:
    """Hashes of a text's words."""
    return F.transform(F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))


def _shingles(words: str, size: int) -> Column:
    """Hashes of ``size`` words each, in order; none if there are fewer."""
    whole = F.size(words) >= size
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0)))
    return F.when(whole, F.transform(at, lambda i: F.xxhash64(*(F.get(F.col(words), i + k) for k in range(size))))).otherwise(F.array().cast("array<bigint>"))


def _fingerprint(rows: DataFrame, *by: str) -> DataFrame:
    """A row a group: fp, whose bits are set if over half of the ``h`` have them; a sum counts two bits, in its halves."""
    two = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit((1 << 32) + 1))).alias(f"b{b}") for b in range(32)]
    out = rows.groupBy(*by).agg(*two, F.count("*").alias("_n"))
    half = lambda b, high: F.shiftrightunsigned(f"b{b}", 32) if high else F.col(f"b{b}").bitwiseAND(F.lit((1 << 32) - 1))
    bit = lambda b, high: F.when(half(b, high) * 2 > F.col("_n"), F.shiftleft(F.lit(1).cast("long"), b + 32 * high)).otherwise(F.lit(0).cast("long"))
    fp = reduce(Column.bitwiseOR, [bit(b, high) for high in (False, True) for b in range(32)])
    return out.select(*by, fp.alias("fp"))


def _blocks_of(column: str, flips: int) -> Column:
    """Each block's number and bits, as they are and with up to ``flips`` of them flipped."""
    masks = F.array(*(F.lit(sum(1 << b for b in bits)) for n in range(flips + 1) for bits in combinations(range(8), n)))
    own = F.array(*(F.shiftrightunsigned(column, 8 * i).bitwiseAND(F.lit(255)).cast("int").bitwiseOR(F.lit(i << 8)) for i in range(BLOCKS)))
    return F.flatten(F.transform(own, lambda x: F.transform(masks, lambda m: x.bitwiseXOR(m)))) if flips else own


def _maybe(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(BROADCAST + 1).count() <= BROADCAST else rows


def _places(similarity: float) -> Column:
    """(m, start) of all windows that hold enough of ``hits``, a document's sorted (p, ms): positions of shingles and the sizes of the items they stand in."""
    n = F.col("n") - F.col("size") + 1

    def of_size(m: Column) -> Column:
        w = F.least(m, n)
        need = F.greatest(F.ceil((m + w) * (similarity / (1 + similarity)) - 1e-9).cast("int"), F.lit(1))

        def ranges(p: Column) -> Column:
            # need hits from the j-th on fit into a window that starts at the j-th or before it; starts up to the hit before were its own
            def starts(j: Column) -> Column:
                low = F.greatest(F.lit(0), F.get(p, j + need - 1) - w + 1, F.coalesce(F.get(p, j - 1) + 1, F.lit(0)))
                high = F.least(F.get(p, j), n - w)
                return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

            all_ = F.flatten(F.transform(F.sequence(F.lit(0), F.size(p) - need), starts))
            return F.when(F.size(p) >= need, F.transform(all_, lambda s: F.struct(m.alias("m"), s.alias("start")))).otherwise(F.array().cast("array<struct<m:int,start:int>>"))

        return _let(F.transform(F.filter("hits", lambda x: F.array_contains(x["ms"], m)), lambda x: x["p"]), ranges)

    return F.flatten(F.transform(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["ms"]))), of_size))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, k, item_id, start, similarity): the best window, first of equals, of each document and item that match; k tells texts apart."""
    scratch = Scratch(docs.sparkSession, "leaks")
    item = F.xxhash64("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")))  # ids may be null or repeat with another text
    items = benchmark.select("item_id", item.alias("item"), _words(F.col("text")).alias("words")).where("size(words) > 0").dropDuplicates(["item"])
    items = scratch.table(items.withColumn("size", F.least(F.size("words"), F.lit(SHINGLE))).withColumn("m", F.size("words") - F.col("size") + 1))
    sizes = [r[0] for r in items.select("size").distinct().collect()]  # SHINGLE values at most
    if not sizes:
        return docs.select("doc_id", F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("start"), F.lit(0.0).alias("similarity")).where("false")
    own = F.array().cast("array<bigint>")
    for s in sizes:
        own = F.when(F.col("size") == s, _shingles("words", s)).otherwise(own)
    rows = scratch.table(items.select("item", "size", "m", F.explode(own).alias("h")))
    weights = rows.groupBy("item", "m", "h").agg(F.count("*").alias("theirs"))
    prints = scratch.table(_fingerprint(rows, "item", "size", "m"))

    text = F.col("text").cast("string")
    texts = docs.select("doc_id", F.xxhash64(F.coalesce(text, F.lit(""))).alias("k"), _words(text).alias("words"))
    index = _maybe(rows.groupBy("h", "size").agg(F.collect_set("m").alias("ms")))
    each = F.concat(*(F.transform(_shingles("words", s), lambda h, i: F.struct(i.alias("p"), h.alias("h"))) for s in sizes))
    met = texts.select("doc_id", "k", F.size("words").alias("n"), F.explode(each).alias("x")).select("doc_id", "k", "n", "x.p", "x.h").join(index, "h")
    hits = met.groupBy("doc_id", "k", "n", "size").agg(F.array_sort(F.collect_set(F.struct("p", "ms"))).alias("hits"))
    placed = scratch.table(hits.select(F.col("doc_id").alias("i"), F.col("k").alias("j"), "size", _places(similarity).alias("places")).where("size(places) > 0"))

    held = _maybe(placed.select("i", "j").distinct())
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("k") == F.col("j"))
    texts = texts.join(held, same, "left_semi").dropDuplicates(["doc_id", "k"])
    all_ = F.array().cast("array<bigint>")
    for s in sizes:
        all_ = F.when(F.col("size") == s, _shingles("words", s)).otherwise(all_)
    windows = texts.join(placed, same).select("doc_id", "k", "size", all_.alias("all"), "places").select("doc_id", "k", "size", "all", F.explode("places").alias("x"))
    windows = windows.select("doc_id", "k", "size", "x.m", "x.start", F.slice("all", F.col("x.start") + 1, F.col("x.m")).alias("hs"))
    windows = scratch.table(windows.withColumn("w", F.monotonically_increasing_id()))
    proposed = prints.select("item", "size", "m", F.col("fp").alias("theirs"), F.explode(_blocks_of("fp", FLIPS)).alias("block"))
    near = _fingerprint(windows.select("w", "size", "m", F.explode("hs").alias("h")), "w", "size", "m").withColumn("block", F.explode(_blocks_of("fp", 0))).join(_maybe(proposed), ["size", "m", "block"])
    near = scratch.table(near.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("theirs"))) <= RADIUS).select("w", "item").distinct())
    mine = windows.select("w", "hs").join(near, "w").select("w", "item", F.size("hs").alias("n"), F.explode("hs").alias("h")).groupBy("w", "item", "n", "h").agg(F.count("*").alias("mine"))
    both = mine.join(_maybe(scratch.table(weights)), ["item", "h"]).groupBy("w", "item", "n", "m").agg(F.sum(F.least("mine", "theirs")).alias("shared"))
    value = F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))
    good = both.select("w", "item", value.alias("similarity")).where(F.col("similarity") >= similarity - 1e-12)
    best = windows.select("w", "doc_id", "k", "start").join(good, "w").join(_maybe(items.select("item", "item_id")), "item")
    best = best.groupBy("doc_id", "k", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("x"))
    return scratch.table(best.select("doc_id", "k", "item_id", (-F.col("x.s")).alias("start"), F.col("x.similarity").alias("similarity")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that any item contaminates."""
    bad = _maybe(leaks(docs, benchmark).select(F.col("doc_id").alias("_i"), F.col("k").alias("_j")).distinct())
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_i")) & (text == F.col("_j")), "left_anti")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    out = leaks(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    out = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("x"))
    return out.select("doc_id", "item_id", (-F.col("x.s")).alias("start"), F.col("x.similarity").alias("similarity"))


#: The same by plain exact comparison: the first of the best of all windows of each item's size, in documents that hold four fifths as many of its shingles.
OP8_SQL = r"""
WITH it AS (SELECT item_id, w, least(len(w), 5) AS s FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0),
ish AS (SELECT item_id, s, array_to_string(w[q:q + s - 1], ' ') AS h, len(w) - s + 1 AS m FROM (SELECT item_id, w, s, unnest(range(1, len(w) - s + 2)) AS q FROM it)),
ic AS (SELECT item_id, s, m, h, count(*) AS c FROM ish GROUP BY ALL),
dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
dsh AS (SELECT doc_id, s, p, array_to_string(w[p + 1:p + s], ' ') AS h, len(w) - s + 1 AS n
        FROM (SELECT doc_id, w, s, unnest(range(0, len(w) - s + 1)) AS p FROM dw, (SELECT DISTINCT s FROM it))),
hit AS (SELECT dsh.doc_id, ic.item_id, ic.m, dsh.n, dsh.p, dsh.h, ic.c FROM dsh JOIN ic ON ic.s = dsh.s AND ic.h = dsh.h),
pair AS (SELECT doc_id, item_id, m, n, least(m, n) AS mine FROM hit GROUP BY ALL HAVING count(*) >= 0.8 * m),
win AS (SELECT *, unnest(range(0, n - mine + 1)) AS start FROM pair),
wc AS (SELECT win.doc_id, win.item_id, win.m, win.mine, win.start, hit.h, hit.c, count(*) AS k
       FROM win JOIN hit ON hit.doc_id = win.doc_id AND hit.item_id = win.item_id AND hit.p >= win.start AND hit.p < win.start + win.mine GROUP BY ALL),
sim AS (SELECT doc_id, item_id, start, sum(least(k, c))::DOUBLE / (m + mine - sum(least(k, c)))::DOUBLE AS similarity FROM wc GROUP BY doc_id, item_id, m, mine, start)
SELECT doc_id, item_id, start::INTEGER AS start, similarity FROM sim WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""
