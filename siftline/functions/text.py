"""Text as columns: languages, tokens, sentences, intents of queries, signs of facts, quality of chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions import words as w


def _of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: inside higher-order functions Spark does not share repeated expressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: All characters that (?U)\s is.
SPACE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column | str) -> Column:
    """Without white space at either end; the rest is not looked at, as a pattern would."""
    return F.trim(_of(c), F.lit(SPACE))


def has(c: Column | str, words: list[str]) -> Column:
    """Whether the lower-cased text holds any of the words as a substring."""
    return F.lower(_of(c)).rlike(w.any_of(words))


def _ascii(c: Column | str) -> Column:
    """Whether a text has a byte a character, told without a look at its letters."""
    return F.octet_length(_of(c)) == F.length(_of(c))


def language(c: Column | str) -> Column:
    """zh, ru, en or other, by shares of Chinese, Cyrillic and ASCII letters among these."""
    # whole runs of other characters fall at once, and each letter is counted once
    count = lambda keep: F.length(F.regexp_replace(_of(c), f"[^{keep}]+", "")).cast("double")

    def told(n: Column) -> Column:
        zh, ru, en = n["zh"], n["ru"], n["en"]
        total = zh + ru + en
        return F.when(F.coalesce(total, F.lit(0)) == 0, "other").when(zh / total > 0.3, "zh").when(ru / total > 0.1, "ru").when(en / total > 0.5, "en").otherwise("other")

    other = lambda keep: F.when(_ascii(c), F.lit(0.0)).otherwise(count(keep))
    return let(F.struct(other("一-鿿").alias("zh"), other("Ѐ-ӿ").alias("ru"), count("a-zA-Z").alias("en")), told)


def query_language(c: Column | str) -> Column:
    return F.when(~_ascii(c) & _of(c).rlike("[Ѐ-ӿ]"), "ru").otherwise("en")


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters and digits of more than two characters, without stop words."""
    stop = [x for x in w.STOP_WORDS_RU + w.STOP_WORDS_EN if len(x) > 2]
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(_of(c), F.lit(""))), F.lit(w.LONG_TOKEN), F.lit(0)), lambda x: ~x.isin(stop))


def sentences(c: Column | str) -> Column:
    return F.split(_of(c), r"(?U)(?<=[.!?])\s+")


def paragraphs(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(strip(c), r"\n{2,}"), strip), lambda x: x != "")


def pieces(c: Column | str) -> Column:
    """What white space separates."""
    return F.filter(F.split(_of(c), r"(?U)\s+"), lambda x: x != "")


def plain(c: Column | str) -> Column:
    return F.replace(_of(c), F.lit("**"), F.lit(""))


def is_news(c: Column | str) -> Column:
    return has(c, w.NEWS)


def breadth(c: Column | str) -> Column:
    """How many chunks the answer takes: 8, 30 or 12."""
    return F.when(has(c, w.BRIEF), 8).when(has(c, w.BROAD), 30).otherwise(12)


def weights(c: Column | str) -> Column:
    pair = lambda a, b: F.struct(F.lit(a).alias("bm25"), F.lit(b).alias("semantic"))
    return F.when(has(c, w.WEIGH_LEXICAL), pair(0.8, 0.2)).when(has(c, w.WEIGH_EVEN), pair(0.5, 0.5)).when(has(c, w.WEIGH_NEWS), pair(0.65, 0.35)).otherwise(pair(0.7, 0.3))


def profile(c: Column | str) -> Column:
    """(type, intent, expected_length, critical_attributes) of a query."""
    kind = F.when(has(c, w.PROFILE_BRIEF), 0).when(has(c, w.PROFILE_BROAD), 1).otherwise(2)
    which = F.lit(len(w.INTENTS))
    for k in range(len(w.INTENTS) - 1, -1, -1):
        which = F.when(has(c, w.INTENTS[k][0]), k).otherwise(which)
    pick = lambda at, values: F.get(F.array(*values), at)
    intents = [i[1:] for i in w.INTENTS] + [w.OTHER_INTENT]
    return F.struct(
        pick(kind, [F.lit(t[0]) for t in w.TYPES]).alias("type"),
        pick(which, [F.lit(i[0]) for i in intents]).alias("intent"),
        pick(kind, [F.lit(t[1]) for t in w.TYPES]).alias("expected_length"),
        pick(which, [F.array(*map(F.lit, i[1])) for i in intents]).alias("critical_attributes"),
    )


def has_facts(c: Column | str) -> Column:
    """Whether at least two signs of facts are there."""
    found = [_of(c).rlike("(?U)" + p) for p in w.FACTS] + [F.lower(_of(c)).rlike("(?U)" + p) for p in w.FACTS_LOWER]
    # all signs but one have a digit
    return F.when(_of(c).rlike(r"\p{Nd}"), sum((x.cast("int") for x in found[1:]), found[0].cast("int")) >= 2).when(_of(c).isNotNull(), False)


def is_factoid(c: Column | str) -> Column:
    return F.lower(_of(c)).rlike("(?U)" + "|".join(w.FACTOID))


def without_garbage(c: Column | str) -> Column:
    """Stripped lines, without empty ones, short ones that have no digit, and rather short ones of a garbage pattern."""
    keep = lambda x: (x != "") & ((F.length(x) >= 10) | x.rlike(r"(?U)\d")) & ~((F.length(x) < 50) & has(x, w.GARBAGE))
    return F.array_join(F.filter(F.transform(F.split(_of(c), "\n"), strip), keep), "\n")


def is_incomplete(c: Column | str) -> Column:
    """Short, starting in the middle if short, starting or ending with a mark that says so, or ending in a letter if short."""

    def test(s: Column) -> Column:
        n = F.length(s)
        return (n == 0) | ((n < 100) & s.rlike(r"^\p{Ll}")) | s.rlike(r"^[.,\-—–…]") | s.rlike("[-—]$") | ((n < 100) & s.rlike(r"\p{L}$"))

    return F.coalesce((F.length(_of(c)) < 50) | let(strip(c), test), F.lit(True))


def most_frequent(words: Column) -> Column:
    """How often the most frequent element of an array of strings stands there."""
    start = F.struct(F.lit("").alias("was"), F.lit(0).alias("run"), F.lit(0).alias("most"))  # sort_array needs no comparison function as array_sort does

    def step(acc: Column, x: Column) -> Column:
        run = F.when(x == acc["was"], acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("was"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    return F.aggregate(F.sort_array(words), start, step, lambda acc: acc["most"])


def is_low_quality(c: Column | str) -> Column:
    """Short, of overlong words, with two boilerplate phrases, of one word for a third, or without longer words."""

    def worded(words: Column) -> Column:
        n = F.size(words).cast("double")

        def often(own: Column) -> Column:
            # none stands more often than words stand more than once, and one
            most = F.size(own) - F.size(F.array_distinct(own)) + 1
            return (most > n * 0.3) & (most_frequent(own) > n * 0.3)

        long_ = F.filter(F.transform(words, F.lower), lambda x: F.length(x) > 3)
        return (n == 0) | (n < 0.08 * F.length(_of(c))) | (F.size(F.filter(words, lambda x: F.length(x) > 4)) < 0.2 * n) | let(long_, often)

    def phrased(low: Column) -> Column:
        found = [F.contains(low, F.lit(p)).cast("int") for p in w.BOILERPLATE]
        return sum(found[1:], found[0]) >= 2

    return F.coalesce((F.length(_of(c)) < 50) | let(F.lower(_of(c)), phrased) | let(pieces(c), worded), F.lit(True))


def is_price_list(c: Column | str) -> Column:
    """Whether over three tenths of a text's lines are numbers and currency signs."""
    return let(F.split(_of(c), "\n"), lambda lines: F.size(F.filter(lines, lambda x: strip(x).rlike("(?U)" + w.NUMERIC_LINE))) / F.size(lines) > 0.3)


def preview(c: Column | str, size: int = 500) -> Column:
    """What of a text its relevance is told by."""
    return _of(c).substr(1, size)


def is_content(c: Column | str, relevance: Column | None = None, sentence: int = 40, least: int = 5, threshold: float = 0.35) -> Column:
    """Whether a page's text is content: enough long sentences or, for a price list, enough relevance of its preview (none if unknown)."""
    long_ = F.filter(F.transform(F.split(_of(c), r"(?U)[.!?]\s+"), lambda x: F.length(strip(x))), lambda n: n > 20)
    prose = let(long_, lambda sizes: (F.size(sizes) >= least) & (F.aggregate(sizes, F.lit(0), lambda a, b: a + b) >= sentence * F.size(sizes)))
    listed = F.coalesce(relevance >= threshold, F.lit(False)) if relevance is not None else F.lit(False)
    return F.coalesce((F.length(_of(c)) >= 200) & F.when(is_price_list(c), listed).otherwise(prose), F.lit(False))
