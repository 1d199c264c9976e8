"""Personal data, and what reveals it, in SQL functions alone.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Information-theoretic sanitisation adds
terms: over the whole corpus, the words beside an entity (a base span's value), the nearest NEAR that stand whole within AROUND characters on either side, are counted
with it. A term discloses an entity if, of the documents that hold the term, a share of at least SHARE
holds it beside that entity, that is at least BITS bits above the entity's own frequency, and chance does not explain
that: the surprise of so many meetings (Chernoff's bound on the binomial tail, in bits) is BITS or more above the logarithm of the number
of pairs looked at. Meetings are documents, but no more than there are different contexts (copies of a passage are one). How often
an entity has to be seen follows from that: two documents are enough in most corpora, one is where few pairs
are looked at for the number of documents. Every occurrence of a disclosing term is generalised like a base span.

Defined results: null text is empty text and has no spans; a null doc_id is allowed; repeated rows get equal results and count as
documents of their own; an empty table gives an empty result; other columns are kept by ``sanitise`` and ignored by ``find``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import Scratch
from siftline.llm.spans import occurrences, replaced
from siftline.sources.reading import table

KINDS = ("email", "ip", "card", "phone")
NEAR, SHARE, BITS = 8, 0.5, 4.0
#: Characters on either side within which context words stand, and the shortest word that counts.
AROUND, LEAST = 240, 4
#: Rows up to which a table of terms or spans is broadcast (under 100 bytes each); beyond it Spark shuffles.
BROADCAST = 200_000
_LOCAL = "[A-Za-z0-9._%+-]"
#: The contract's patterns. A match starts where no longer one could have, or where the last one ended.
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def _luhn(v: Column) -> Column:
    digits = F.reverse(F.regexp_replace(v, "[^0-9]", ""))
    at = F.sequence(F.lit(1), F.length(digits))

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(at, F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """Array of (kind, s, e, v) by kind, then start."""
    none = F.array().cast("array<struct<kind:string,s:int,e:int,v:string>>")
    digit = text.rlike("[0-9]")
    count = lambda x: F.length(F.regexp_replace(x["v"], "[^0-9]", ""))
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    address = rf"^{part}(?:\.{part}){{3}}$"
    kinds = (
        (F.contains(text, F.lit("@")), EMAIL, lambda x: F.lit(True)),
        (digit & text.rlike(r"[0-9]\.[0-9]"), IP, lambda x: x["v"].rlike(address)),
        (digit, CARD, lambda x: F.when(count(x).between(13, 19), _luhn(x["v"])).otherwise(False)),
        (F.contains(text, F.lit("+")) & digit, PHONE, lambda x: count(x).between(9, 15)),
    )
    return F.concat(*(F.when(guard, F.filter(occurrences(text, p, kind), valid)).otherwise(none) for kind, (guard, p, valid) in zip(KINDS, kinds, strict=True)))


def _key(rows: DataFrame) -> DataFrame:
    """Adds t, the text without null, and k, which tells texts apart."""
    return rows.withColumn("t", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("k", F.xxhash64("t"))


def _fits(rows: DataFrame) -> bool:
    return rows.limit(BROADCAST + 1).count() <= BROADCAST


def _maybe(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if _fits(rows) else rows


def _words(x: Column, start: str = "", end: str = "") -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(rf"{start}\p{{L}}{{{LEAST},}}+{end}"), F.lit(0))


def _contexts(rows: DataFrame) -> DataFrame:
    """(row, entity, context, term): the words around each entity, from (row, base, t) of documents with spans."""
    one = rows.select("row", "t", F.explode("base").alias("x"))
    # a character more than counts tells whether a word is whole
    before = F.when(F.col("x.s") <= AROUND, F.concat(F.lit(" "), F.substring(F.col("t"), F.lit(1), F.col("x.s")))).otherwise(F.substring(F.col("t"), F.col("x.s") - AROUND, F.lit(AROUND + 1)))
    after = F.substring(F.concat(F.col("t"), F.lit(" ")), F.col("x.e") + 1, F.lit(AROUND + 1))
    left, right = _words(before, r"(?<=\P{L})"), _words(after, end=r"(?=\P{L})")
    left = F.slice(left, F.greatest(F.lit(1), F.size(left) - NEAR + 1), NEAR)
    words = F.array_distinct(F.concat(left, F.slice(right, 1, NEAR)))
    entity = F.concat(F.col("x.kind"), F.lit(":"), F.lower(F.when(F.col("x.kind").isin("card", "phone"), F.regexp_replace("x.v", "[^0-9]", "")).otherwise(F.col("x.v"))))
    return one.select("row", entity.alias("entity"), F.xxhash64(words).alias("context"), F.explode(words).alias("term"))


def _surprise(meetings: Column, share: Column, own: Column) -> Column:
    """Bits by which chance falls short of ``meetings`` that are this share of a term's documents, for an entity in a share ``own`` of all."""
    rest = F.when(share < 1, (1 - share) * F.log2((1 - share) / F.greatest(1 - own, F.lit(1e-12)))).otherwise(0.0)
    return meetings / share * (share * F.log2(share / own) + rest)


def disclosing(docs: DataFrame, base: DataFrame, contexts: DataFrame, scratch: Scratch) -> DataFrame:
    """(term) of the corpus that disclose some entity. base: (row, entity) of all spans' contexts' documents, a row a document."""
    pairs = scratch.table(contexts.groupBy("term", "entity").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("row").alias("together")))
    total, tested = docs.count(), pairs.count()
    least = BITS + math.log2(max(tested, 1))
    own = base.groupBy("entity").agg((F.count("*") / total).alias("own"))
    pairs = pairs.withColumn("meetings", F.least("contexts", "together")).join(_maybe(own), "entity")
    # the fewer documents hold a term, the greater the surprise; they are no fewer than those that have it beside this entity, or beside any
    pairs = scratch.table(pairs.where(_surprise(F.col("meetings"), F.lit(1.0), F.col("own")) >= least))
    beside = contexts.groupBy("term").agg(F.count_distinct("row").alias("beside"))
    share = F.col("together") / F.col("beside")
    pairs = scratch.table(pairs.join(beside, "term").where((share >= SHARE) & (_surprise(F.col("meetings"), share, F.col("own")) >= least)))
    terms = scratch.table(pairs.select("term").distinct())
    if terms.isEmpty():
        return terms
    held = docs.select(F.explode(F.array_distinct(_words(F.coalesce(F.col("text").cast("string"), F.lit(""))))).alias("term"))
    often = held.join(_maybe(terms), "term").groupBy("term").agg(F.count("*").alias("held"))
    share = F.col("together") / F.col("held")
    bits = F.log2(share) - F.log2("own")
    return scratch.table(pairs.join(often, "term").where((share >= SHARE) & (bits >= BITS) & (_surprise(F.col("meetings"), share, F.col("own")) >= least)).select("term").distinct())


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, k, terms): spans of the terms in all documents that hold some."""
    chosen = _maybe(terms)
    rows = _key(docs.select("doc_id", "text"))
    holds = rows.select("doc_id", "k", F.explode(F.array_distinct(_words(F.col("t")))).alias("term")).join(chosen, "term").select(F.col("doc_id").alias("i"), F.col("k").alias("j")).distinct()
    texts = rows.join(_maybe(holds), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("k") == F.col("j")), "left_semi").dropDuplicates(["doc_id", "k"])
    words = texts.select("doc_id", "k", F.explode(occurrences(F.col("t"), rf"\p{{L}}{{{LEAST},}}+", "term")).alias("x"))
    found = words.withColumn("term", F.lower("x.v")).join(chosen, "term")
    return found.groupBy("doc_id", "k").agg(F.array_sort(F.collect_list(F.struct("x.s", "x.e"))).alias("terms"))


def find(docs: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, k, base) of all documents, a row a row, and (doc_id, k, terms) of those with disclosing terms (None if no term does)."""
    scratch = scratch or Scratch(docs.sparkSession, "pii")
    rows = scratch.table(_key(docs.select("doc_id", "text")).select("doc_id", "k", base_spans(F.col("t")).alias("base"), "t").withColumn("t", F.when(F.size("base") > 0, F.col("t"))).withColumn("row", F.monotonically_increasing_id()))
    contexts = scratch.table(_contexts(rows.where(F.size("base") > 0)))
    base = contexts.select("row", "entity").distinct()
    terms = disclosing(docs, base, contexts, scratch)
    spans = None if terms.isEmpty() else scratch.table(term_spans(docs, terms))
    return rows.select("doc_id", "k", "base"), spans


def _with_terms(rows: DataFrame, spans: DataFrame | None, key: str) -> DataFrame:
    """Adds _terms, by doc_id and the column ``key`` that tells texts apart."""
    none = F.array().cast("array<struct<s:int,e:int>>")
    if spans is None:
        return rows.withColumn("_terms", none)
    named = spans.select(F.col("doc_id").alias("_i"), F.col("k").alias("_j"), F.col("terms").alias("_found"))
    joined = rows.join(_maybe(named), F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col(key) == F.col("_j")), "left")
    return joined.withColumn("_terms", F.coalesce("_found", none)).drop("_i", "_j", "_found")


def sanitise(docs: DataFrame) -> DataFrame:
    """All documents with their columns; base spans and disclosing terms of text are replaced, n_chars follows where there is one."""
    _, spans = find(docs)
    rows = docs.withColumn("_t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = _with_terms(rows.withColumn("_key", F.xxhash64("_t")), spans, "_key")
    terms = F.transform("_terms", lambda x: F.struct(F.lit("term").alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lit("").alias("v")))
    rows = rows.withColumn("_spans", F.concat(base_spans(F.col("_t")), terms))
    out = rows.withColumn("text", F.when(F.col("text").isNotNull(), replaced(F.col("_t"), F.col("_spans"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    rows, spans = find(table(spark, sf_dir, "documents"))
    rows = _with_terms(rows, spans, "k")
    write = lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))
    base = F.transform("base", write)
    terms = F.transform("_terms", lambda x: F.concat_ws(":", F.lit("term"), x["s"].cast("string"), x["e"].cast("string")))
    number = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(kind) for kind in KINDS]
    return rows.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, terms), ",").alias("spans"), F.size("_terms").cast("long").alias("n_term"))


def _places(name: str, rows: str, pattern: str) -> str:
    """SQL of a table (row, v, s, e) of all matches in ``rows`` (row, t): what lies between them tells the places."""
    return f"""
{name}_0 AS (SELECT row, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM {rows}),
{name}_1 AS (SELECT row, unnest(m) AS v, unnest(g[1:len(m)]) AS g, unnest(range(len(m))) AS i FROM {name}_0 WHERE len(m) > 0),
{name} AS (SELECT row, v, (sum(length(g) + length(v)) OVER o - length(v))::BIGINT AS s, (sum(length(g) + length(v)) OVER o)::BIGINT AS e FROM {name}_1 WINDOW o AS (PARTITION BY row ORDER BY i))"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({_DIGITS}), i, 1)::INT ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][substr(reverse({_DIGITS}), i, 1)::INT + 1] END)) % 10 = 0"
_BITS = "k / share * (share * log2(share / own) + CASE WHEN share < 1 THEN (1 - share) * log2((1 - share) / greatest(1 - own, 1e-12::DOUBLE)) ELSE 0 END)"
#: The same counted plainly: base spans, words beside them, pairs of all of these, and where disclosing terms stand.
OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
{_places("em", "d", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").strip()},{_places("ip", "d", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")},{_places("ca", "d", "[0-9](?:[ -]?[0-9])+")},{_places("ph", "d", r"\+[0-9][ ().0-9-]+[0-9]")},
base AS (SELECT 1 AS o, 'email' AS kind, * FROM em
  UNION ALL SELECT 2, 'ip', * FROM ip WHERE len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR lpad(ltrim(x, '0'), 3, '0') > '255')) = 0
  UNION ALL SELECT 3, 'card', * FROM ca WHERE length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}
  UNION ALL SELECT 4, 'phone', * FROM ph WHERE length({_DIGITS}) BETWEEN 9 AND 15),
held_rows AS (SELECT row, t FROM d WHERE row IN (SELECT row FROM base)),{_places("wo", "held_rows", rf"\p{{L}}{{{LEAST},}}")},
ent AS (SELECT row, s, e, kind || ':' || CASE WHEN o > 2 THEN {_DIGITS} ELSE lower(v) END AS entity FROM base),
near AS (SELECT ent.row, ent.s, ent.e, entity, lower(wo.v) AS term, wo.s AS p FROM ent JOIN wo ON wo.row = ent.row AND wo.e <= ent.s AND wo.s >= ent.s - {AROUND} QUALIFY row_number() OVER (PARTITION BY ent.row, ent.s, ent.e, entity ORDER BY wo.s DESC) <= {NEAR}
  UNION ALL SELECT ent.row, ent.s, ent.e, entity, lower(wo.v), wo.s FROM ent JOIN wo ON wo.row = ent.row AND wo.s >= ent.e AND wo.e <= ent.e + {AROUND} QUALIFY row_number() OVER (PARTITION BY ent.row, ent.s, ent.e, entity ORDER BY wo.s) <= {NEAR}),
once AS (SELECT row, s, e, entity, term, min(p) AS p FROM near GROUP BY 1, 2, 3, 4, 5),
cx AS (SELECT *, string_agg(term, ' ' ORDER BY p) OVER (PARTITION BY row, s, e, entity ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS context FROM once),
pairs AS (SELECT term, entity, count(DISTINCT context) AS contexts, count(DISTINCT row) AS together FROM cx GROUP BY 1, 2),
own AS (SELECT entity, count(DISTINCT row)::DOUBLE / (SELECT count(*) FROM d) AS own FROM cx GROUP BY 1),
often AS (SELECT term, count(*) AS held FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(t), '\p{{L}}{{{LEAST},}}'))) AS term FROM d) WHERE term IN (SELECT term FROM pairs) GROUP BY 1),
rated AS (SELECT term, least(contexts, together) AS k, together::DOUBLE / held AS share, own FROM pairs JOIN own USING (entity) JOIN often USING (term)),
terms AS (SELECT DISTINCT term FROM rated WHERE share >= {SHARE} AND log2(share / own) >= {BITS} AND {_BITS} >= {BITS} + (SELECT log2(greatest(count(*), 1)) FROM pairs)),
said AS (SELECT row, t FROM d WHERE len(list_intersect(regexp_extract_all(lower(t), '\p{{L}}{{{LEAST},}}'), (SELECT coalesce(list(term), []) FROM terms))) > 0),{_places("te", "said", rf"\p{{L}}{{{LEAST},}}")},
every AS (SELECT row, o, kind, s, e FROM base UNION ALL SELECT row, 5, 'term', s, e FROM te WHERE lower(v) IN (SELECT term FROM terms)),
per AS (SELECT row, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) FILTER (o < 5) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) AS a, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in (*KINDS, "term"))} FROM every GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0)::BIGINT AS n_{kind}" for kind in (*KINDS, "term"))}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM d LEFT JOIN per USING (row)
"""
