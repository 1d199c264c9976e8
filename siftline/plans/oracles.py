"""DuckDB SQL for the queries of this package, for those that SQL can express."""

from __future__ import annotations

from siftline.functions import words as w
from siftline.plans import inputs
from siftline.operators import context


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(map(_text, words)) + "]"


def has(x: str, words: list[str]) -> str:
    return f"regexp_matches(lower({x}), {_text(w.any_of(words))})"


def tok(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '{w.TOKEN}'), lambda z: length(z) > 2 AND NOT list_contains({_list(w.STOP_WORDS_RU + w.STOP_WORDS_EN)}, z))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sent(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


def breadth(x: str) -> str:
    return f"CASE WHEN {has(x, w.BRIEF)} THEN 8 WHEN {has(x, w.BROAD)} THEN 30 ELSE 12 END"


def facts(x: str) -> str:
    found = [f"regexp_matches({x}, {_text(p)})::INT" for p in w.FACTS] + [f"regexp_matches(lower({x}), {_text(p)})::INT" for p in w.FACTS_LOWER]
    return f"({' + '.join(found)}) >= 2"


def factoid(x: str) -> str:
    return f"regexp_matches(lower({x}), {_text('|'.join(w.FACTOID))})"


def language(x: str) -> str:
    n = lambda keep: f"length(regexp_replace({x}, '[^{keep}]', '', 'g'))::DOUBLE"
    zh, ru, en = n("一-鿿"), n("Ѐ-ӿ"), n("a-zA-Z")
    total = f"({zh} + {ru} + {en})"
    return f"CASE WHEN coalesce({total}, 0) = 0 THEN 'other' WHEN {zh} / {total} > 0.3 THEN 'zh' WHEN {ru} / {total} > 0.1 THEN 'ru' WHEN {en} / {total} > 0.5 THEN 'en' ELSE 'other' END"


def weight(x: str, values: tuple[float, float, float, float]) -> str:
    a, b, c, d = values
    return f"CASE WHEN {has(x, w.WEIGH_LEXICAL)} THEN {a}::DOUBLE WHEN {has(x, w.WEIGH_EVEN)} THEN {b}::DOUBLE WHEN {has(x, w.WEIGH_NEWS)} THEN {c}::DOUBLE ELSE {d}::DOUBLE END"


def norm(x: str) -> str:
    return f"lower(regexp_replace(replace(replace(replace(split_part(split_part({x}, '?', 1), '#', 1), 'https://', ''), 'http://', ''), 'www.', ''), '/+$', ''))"


def key(x: str) -> str:
    return f"lower(regexp_replace(split_part(split_part({x}, '?', 1), '#', 1), '/+$', ''))"


def netloc(x: str) -> str:
    return f"regexp_extract({x}, '^[a-z]+://([^/?#]*)', 1)"


def incomplete(x: str) -> str:
    s = strip(x)
    return rf"({x} IS NULL OR length({x}) < 50 OR length({s}) = 0 OR (length({s}) < 100 AND regexp_matches({s}, '^\p{{Ll}}')) OR regexp_matches({s}, '^[.,\-—–…]') OR regexp_matches({s}, '[-—]$') OR (length({s}) < 100 AND regexp_matches({s}, '\p{{L}}$')))"


def low_quality(x: str) -> str:
    words = rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda z: z <> '')"
    phrases = " + ".join(f"contains(lower({x}), {_text(p)})::INT" for p in w.BOILERPLATE)
    return f"""coalesce((SELECT length({x}) < 50 OR n = 0 OR n < 0.08 * length({x}) OR ({phrases}) >= 2
        OR coalesce(list_max(map_values(list_histogram(list_filter(list_transform(ws, lambda z: lower(z)), lambda z: length(z) > 3)))), 0) > n * 0.3
        OR len(list_filter(ws, lambda z: length(z) > 4)) < 0.2 * n FROM (SELECT {words} AS ws, len({words})::DOUBLE AS n)), true)"""


def garbage(x: str) -> str:
    keep = rf"z <> '' AND (length(z) >= 10 OR regexp_matches(z, '\d')) AND NOT (length(z) < 50 AND {has('z', w.GARBAGE)})"
    return f"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda y: {strip('y')}), lambda z: {keep}), chr(10))"


def content(x: str) -> str:
    lines = f"string_split({x}, chr(10))"
    numeric = f"len(list_filter({lines}, lambda z: regexp_matches({strip('z')}, {_text(w.NUMERIC_LINE)})))"
    sizes = rf"list_filter(list_transform(regexp_split_to_array({x}, '[.!?]\s+'), lambda y: length({strip('y')})), lambda z: z > 20)"
    return f"coalesce(length({x}) >= 200 AND CASE WHEN {numeric} / greatest(len({lines}), 1) > 0.3 THEN false ELSE len({sizes}) >= 5 AND list_sum({sizes}) >= 40 * len({sizes}) END, false)"



def _cut(win: str, size: int) -> str:
    """Where a text too long is cut, given its first ``size`` and 50 characters."""
    at = [f"CASE WHEN instr(reverse({win}), reverse({d})) > 0 THEN length({win}) - instr(reverse({win}), reverse({d})) - length({d}) + 1 END" for d in map(_chars, w.DELIMITERS)]
    return "CASE " + " ".join(f"WHEN {x} > {0.3 * size} THEN {x} + {len(d)}" for x, d in zip(at, w.DELIMITERS, strict=True)) + f" ELSE {size} END"


def _chars(x: str) -> str:
    return "(" + " || ".join(f"chr({ord(c)})" for c in x) + ")"


def sized(size: int = 600, overlap: int = 100, rows: str = "documents") -> str:
    """Chunks by size of all documents, a paragraph or a cut at a step: (doc_id, chunk_idx, chunk)."""
    gap = "chr(10) || chr(10)"
    carry = lambda done, glue, rest: f"CASE WHEN length({done}) > {overlap} THEN right({done}, {overlap}) || {glue} || {rest} ELSE {rest} END"
    return rf"""
src AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array({strip('text')}, '\n{{2,}}'), lambda y: {strip('y')}), lambda z: z <> '') AS paras FROM {rows} WHERE text <> ''),
ck AS (SELECT doc_id, paras, 1::BIGINT AS i, '' AS o, NULL::VARCHAR AS got, 0::BIGINT AS step, false AS done FROM src
  UNION ALL SELECT doc_id, paras, CASE WHEN long_ THEN i ELSE i + 1 END,
    CASE WHEN long_ THEN {carry('head', "' '", 'rest')} WHEN p IS NULL THEN '' WHEN o = '' THEN p WHEN length(o) + length(p) + 2 <= {size} THEN o || {gap} || p ELSE {carry('o', gap, 'p')} END,
    CASE WHEN long_ THEN head WHEN p IS NULL OR (o <> '' AND length(o) + length(p) + 2 > {size}) THEN o END, step + 1, p IS NULL AND NOT long_
  FROM (SELECT *, {strip('substr(o, 1, c)')} AS head, {strip('substr(o, c + 1)')} AS rest
    FROM (SELECT *, CASE WHEN long_ THEN {_cut('win', size)} ELSE 0 END::BIGINT AS c FROM (SELECT *, length(o) > {1.5 * size} AS long_, paras[i] AS p, substr(o, 1, {size + 50}) AS win FROM ck WHERE NOT done)))),
sized AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1)::INT AS chunk_idx, {strip('got')} AS chunk FROM ck WHERE length({strip('got')}) > 40)"""


_BUCKET = "((instr('0123456789abcdef', substr(md5(word), 7, 1)) - 1) * 16 + instr('0123456789abcdef', substr(md5(word), 8, 1)) - 1) % 64"
#: Chunks where neighbouring sentences' word counts by hash differ; whole texts of under three sentences, chunks by size where that makes one.
MEANT = rf"""{sized()},
ss AS (SELECT doc_id, text, list_filter(list_transform({sent('text')}, lambda y: {strip('y')}), lambda z: z <> '') AS x FROM documents WHERE text <> ''),
sn AS (SELECT doc_id, unnest(x) AS s, unnest(range(1, len(x) + 1)) AS k FROM ss WHERE len(x) >= 3),
wd AS (SELECT doc_id, k, {_BUCKET} AS b, count(*)::DOUBLE AS n FROM (SELECT doc_id, k, unnest(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}_]+')) AS word FROM sn) GROUP BY 1, 2, 3),
ln AS (SELECT doc_id, k, sqrt(sum(n * n)) AS l FROM wd GROUP BY 1, 2),
dt AS (SELECT a.doc_id, b.k, sum(a.n * b.n) AS d FROM wd a JOIN wd b ON a.doc_id = b.doc_id AND a.b = b.b AND b.k = a.k + 1 GROUP BY 1, 2),
nr AS (SELECT sn.doc_id, sn.k, sn.s, coalesce(d, 0) / greatest(coalesce(p.l * q.l, 0), 1e-12::DOUBLE) AS near FROM sn LEFT JOIN dt USING (doc_id, k) LEFT JOIN ln p ON p.doc_id = sn.doc_id AND p.k = sn.k - 1 LEFT JOIN ln q ON q.doc_id = sn.doc_id AND q.k = sn.k),
lt AS (SELECT doc_id, quantile_cont(near, 0.3) AS least FROM nr WHERE k > 1 GROUP BY 1),
ap AS (SELECT nr.*, near < least AS apart FROM nr JOIN lt USING (doc_id)),
gr AS (SELECT doc_id, k, s, 0::BIGINT AS g, length(s)::BIGINT AS n FROM ap WHERE k = 1
  UNION ALL SELECT ap.doc_id, ap.k, ap.s, CASE WHEN apart OR n + length(ap.s) > 600 THEN g + 1 ELSE g END, CASE WHEN apart OR n + length(ap.s) > 600 THEN length(ap.s) ELSE n + length(ap.s) END FROM gr JOIN ap ON ap.doc_id = gr.doc_id AND ap.k = gr.k + 1),
one AS (SELECT doc_id FROM gr GROUP BY 1 HAVING max(g) = 0),
meant AS (SELECT doc_id, g::INT AS chunk_idx, string_agg(s, ' ' ORDER BY k) AS chunk FROM gr WHERE doc_id NOT IN (SELECT doc_id FROM one) GROUP BY 1, 2
  UNION ALL SELECT doc_id, 0, text FROM ss WHERE len(x) < 3 UNION ALL SELECT * FROM sized WHERE doc_id IN (SELECT doc_id FROM one))"""

_QUERY = f"({_list(inputs.QUERIES)})[((%s) %% {len(inputs.QUERIES)} + 1)::INT]"
ASKED = f"asked AS (SELECT DISTINCT page_id // {inputs.HITS} AS query_id, {_QUERY % f'page_id // {inputs.HITS}'} AS query, TIMESTAMP '{inputs.AS_OF}' AS as_of FROM pages)"
HITS = f"""
raw_hits AS (SELECT page_id // {inputs.HITS} AS query_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, page_id % {inputs.HITS} + 1 AS ord FROM pages),
hits AS (SELECT query_id, 'a' AS engine, ord AS rank, title, url, 'about ' || title AS snippet FROM raw_hits
  UNION ALL SELECT query_id, 'b', {inputs.HITS + 1} - ord, title || ' updated', replace(split_part(split_part(url, '?', 1), '#', 1), 'http://', 'https://www.') || '/?from=b', 'short' FROM raw_hits WHERE ord <> 4)"""


def merged(where: str = "true") -> str:
    return f"""
per AS (SELECT query_id, {norm('url')} AS norm, sum(1.0::DOUBLE / rank) * CASE WHEN count(DISTINCT engine) >= 2 THEN 1.3::DOUBLE ELSE 1 END AS raw, string_agg(DISTINCT engine, '+' ORDER BY engine) AS engines,
  min(engine || lpad(rank::VARCHAR, 9, '0')) AS seen, arg_min(url, engine || lpad(rank::VARCHAR, 9, '0')) AS url,
  arg_min(title, lpad((1000000 - length(coalesce(title, '')))::VARCHAR, 9, '0') || engine || lpad(rank::VARCHAR, 9, '0')) AS title,
  arg_min(snippet, lpad((1000000 - length(coalesce(snippet, '')))::VARCHAR, 9, '0') || engine || lpad(rank::VARCHAR, 9, '0')) AS snippet
  FROM hits WHERE {where} GROUP BY 1, 2),
merged AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, seen) - 1 AS source_idx FROM per QUALIFY source_idx < 20)"""


CHUNKS = f"""
chunks AS (SELECT doc_id, doc_id // {inputs.CHUNKS} AS query_id, {_QUERY % f'doc_id // {inputs.CHUNKS}'} AS query, ((doc_id % {inputs.CHUNKS}) // 4)::INT AS source_idx, (doc_id % 4)::INT AS chunk_idx, text,
  CASE WHEN doc_id % 5 <> 0 THEN TIMESTAMP '2024-01-01 06:00:00' + to_days((doc_id % 45)::INT) END AS pub_date, TIMESTAMP '{inputs.AS_OF}' AS as_of FROM documents),
named AS (SELECT *, 'https://www.site' || ((query_id * 5 + source_idx) % 3) || '.example.com/' || query_id || '/' || source_idx AS source_url,
  'Report ' || source_idx || CASE WHEN source_idx % 2 = 0 THEN ' on erin' ELSE ' on eren' END AS source_title, source_idx <> 3 AS fetched FROM chunks)"""
IDF = f"""{CHUNKS},
tk AS (SELECT query_id, unnest(list_distinct({tok('text')})) AS token FROM chunks UNION ALL SELECT query_id, unnest(list_distinct({tok('query')})) FROM (SELECT DISTINCT query_id, query FROM chunks)),
nq AS (SELECT query_id, count(*) + 1 AS n FROM chunks GROUP BY 1),
idf AS (SELECT query_id, token, count(*) AS df, ln((any_value(n) + 1) / (count(*) + 1)) + 1 AS idf FROM tk JOIN nq USING (query_id) GROUP BY 1, 2)"""
TFIDF = f"""
td AS (SELECT doc_id, query_id, unnest(t) AS token, len(t) AS size FROM (SELECT doc_id, query_id, {tok('text')} AS t FROM chunks)),
wd AS (SELECT doc_id, query_id, token, count(*) / any_value(size)::DOUBLE * any_value(idf) AS w FROM td JOIN idf USING (query_id, token) GROUP BY 1, 2, 3),
tq AS (SELECT query_id, unnest(t) AS token, len(t) AS size FROM (SELECT DISTINCT query_id, {tok('query')} AS t FROM chunks)),
wq AS (SELECT query_id, token, count(*) / any_value(size)::DOUBLE * any_value(idf) AS v FROM tq JOIN idf USING (query_id, token) GROUP BY 1, 2),
x AS (SELECT doc_id, sum(w * v) AS dot, sqrt(sum(w * w)) AS l FROM wd LEFT JOIN wq USING (query_id, token) GROUP BY 1),
y AS (SELECT query_id, sqrt(sum(v * v)) AS l FROM wq GROUP BY 1)"""
BM25 = f"""{CHUNKS},
ct AS (SELECT doc_id, query_id, {tok('text')} AS tokens, {tok('query')} AS q FROM chunks),
st AS (SELECT query_id, count(*) + 1 AS n, (sum(len(tokens)) + max(len(q)))::DOUBLE / (count(*) + 1) AS mean FROM ct GROUP BY 1),
qt AS (SELECT doc_id, query_id, tokens, unnest(q) AS t, unnest(range(len(q))) AS ord FROM ct),
tf AS (SELECT doc_id, query_id, ord, len(list_filter(tokens, lambda y: y = t)) AS f, len(tokens) AS size FROM qt),
df AS (SELECT query_id, ord, count(*) FILTER (f > 0) + 1 AS df FROM tf GROUP BY 1, 2),
rw AS (SELECT tf.doc_id, sum(CASE WHEN f > 0 THEN (ln((n + 1) / (df + 1)) + 1) * (f * 2.5::DOUBLE) / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean)) ELSE 0 END) AS raw FROM tf JOIN df USING (query_id, ord) JOIN st USING (query_id) GROUP BY 1),
bm AS (SELECT ct.doc_id, ct.query_id, ct.tokens, ct.q, CASE WHEN max(coalesce(raw, 0)) OVER (PARTITION BY ct.query_id) > 0 THEN coalesce(raw, 0) / max(coalesce(raw, 0)) OVER (PARTITION BY ct.query_id) ELSE 0::DOUBLE END AS bm25 FROM ct LEFT JOIN rw USING (doc_id))"""
SPANS = rf"""
sen AS (SELECT doc_id, text, list_distinct({tok('query')}) AS q, unnest({sent('text')}) AS s, unnest(range(len({sent('text')}))) AS i FROM chunks WHERE {factoid('query')}),
sc AS (SELECT doc_id, text, s, i, CASE WHEN len({tok('s')}) > 0 THEN len(list_intersect(q, list_distinct({tok('s')}))) / len(q) + CASE WHEN regexp_matches(s, '\d') THEN 0.3::DOUBLE ELSE 0 END ELSE 0 END AS score FROM sen WHERE len(q) > 0),
spans AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) = 1 AND score > 0.3)"""
def hybrid(semantic: str = "0::DOUBLE", extra: str = "") -> str:
    """Chunks with their hybrid scores; ``semantic`` may read what ``extra`` joins."""
    return f"""{BM25},{SPANS},
val AS (SELECT n.*, bm.tokens, bm.bm25, {semantic} AS semantic, ({weight('n.query', (0.8, 0.5, 0.65, 0.7))} * bm.bm25 + {weight('n.query', (0.2, 0.5, 0.35, 0.3))} * {semantic}) * CASE WHEN spans.doc_id IS NOT NULL THEN 1.5::DOUBLE ELSE 1 END * CASE WHEN chunk_idx < 3 THEN 1.1::DOUBLE ELSE 1 END
  * CASE WHEN len(list_filter(bm.q, lambda y: contains(lower(source_title), y))) > 0 THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN {facts('n.text')} THEN 1.15::DOUBLE ELSE 1 END
  * CASE WHEN {has('n.query', w.NEWS)} AND pub_date IS NOT NULL THEN CASE WHEN date_diff('second', pub_date, as_of) / 3600 < 24 THEN 1.3::DOUBLE WHEN date_diff('second', pub_date, as_of) / 3600 < 168 THEN 1.15::DOUBLE ELSE 1 END ELSE 1 END AS value
  FROM named n JOIN bm USING (doc_id) LEFT JOIN spans USING (doc_id) {extra}),
scored AS (SELECT *, round(value, 4) AS relevance, row_number() OVER (PARTITION BY query_id ORDER BY round(value, 4) DESC, source_idx, chunk_idx, md5(text)) AS pos FROM val)"""


HYBRID = hybrid()


def folded(top_k: str) -> str:
    """Near-duplicates, caps and marginal relevance, a ranked row or a pick at a time."""
    score = lambda x: f"(0.7::DOUBLE * {x}.rel - (1 - 0.7::DOUBLE) * {x}.lik)"
    return f"""{HYBRID},
rk AS (SELECT query_id, pos, doc_id, relevance AS rel, source_idx AS src, replace({netloc('source_url')}, 'www.', '') AS dom, len(tokens) AS n, list_distinct(tokens) AS d, {top_k} AS k FROM scored),
dd AS (SELECT DISTINCT query_id, 0::BIGINT AS pos, []::STRUCT(n BIGINT, d VARCHAR[])[] AS kept, false AS keep, 0::BIGINT AS doc_id FROM rk
  UNION ALL SELECT r.query_id, r.pos, CASE WHEN dup THEN kept ELSE list_append(kept, struct_pack(n := r.n::BIGINT, d := r.d)) END, NOT dup, r.doc_id
  FROM (SELECT dd.kept, rk.*, len(list_filter(dd.kept, lambda e: e.n > 0 AND rk.n > 0 AND len(list_intersect(e.d, rk.d)) > 0.85::DOUBLE * greatest(e.n, rk.n))) > 0 AS dup FROM dd JOIN rk ON rk.query_id = dd.query_id AND rk.pos = dd.pos + 1) r),
uniq AS (SELECT rk.*, row_number() OVER (PARTITION BY rk.query_id ORDER BY rk.pos) AS place FROM rk JOIN dd ON dd.query_id = rk.query_id AND dd.pos = rk.pos WHERE dd.keep),
cp AS (SELECT DISTINCT query_id, 0::BIGINT AS place, []::STRUCT(src INT, dom VARCHAR, rel DOUBLE)[] AS took, false AS keep FROM rk
  UNION ALL SELECT query_id, place, CASE WHEN keep THEN list_append(took, struct_pack(src := src, dom := dom, rel := rel)) ELSE took END, keep
  FROM (SELECT cp.took, u.*, len(cp.took) < 2 * u.k AND len(list_filter(cp.took, lambda e: e.src = u.src)) < CASE WHEN u.k >= 25 THEN 5 WHEN u.k >= 15 THEN 4 ELSE 3 END
    AND NOT (len(list_filter(cp.took, lambda e: e.dom = u.dom)) >= 3 AND u.rel < 0.9::DOUBLE * (list_sum(list_transform(cp.took, lambda e: e.rel)) / len(cp.took))) AS keep FROM cp JOIN uniq u ON u.query_id = cp.query_id AND u.place = cp.place + 1)),
capd AS (SELECT u.*, row_number() OVER (PARTITION BY u.query_id ORDER BY u.place) AS cpos, count(*) OVER (PARTITION BY u.query_id) AS cn FROM uniq u JOIN cp USING (query_id, place) WHERE cp.keep),
start AS (SELECT query_id, max(k) AS k, max(cn) AS cn, list(struct_pack(id := doc_id, rel := rel, d := d, lik := 0::DOUBLE) ORDER BY cpos) AS all_ FROM capd GROUP BY 1),
mm AS (SELECT query_id, 1 AS step, least((1.5 * k)::DECIMAL(9, 1)::DOUBLE // 1, cn) AS goal, all_[1] AS pick, all_[2:] AS rest FROM start
  UNION ALL SELECT query_id, step + 1, goal, best, list_filter(rest, lambda x: x.id <> best.id)
  FROM (SELECT query_id, step, goal, rest, CASE WHEN goal >= cn THEN rest[1] ELSE list_reduce(rest, lambda a, b: CASE WHEN {score('b')} > {score('a')} THEN b ELSE a END) END AS best
    FROM (SELECT mm.query_id, mm.step, mm.goal, start.cn, list_transform(mm.rest, lambda x: struct_pack(id := x.id, rel := x.rel, d := x.d, lik := greatest(x.lik, CASE WHEN len(x.d) > 0 AND len(mm.pick.d) > 0 THEN len(list_intersect(x.d, mm.pick.d)) / (len(x.d) + len(mm.pick.d) - len(list_intersect(x.d, mm.pick.d))) ELSE 0 END))) AS rest
      FROM mm JOIN start USING (query_id) WHERE mm.step < mm.goal AND len(mm.rest) > 0))),
mmr AS (SELECT query_id, step AS sel_pos, pick.id AS doc_id FROM mm)"""


ISLANDS = f"""{folded(breadth('query'))},
fin AS (SELECT s.*, mmr.sel_pos FROM mmr JOIN scored s USING (doc_id) WHERE mmr.sel_pos <= {breadth('s.query')}),
lg AS (SELECT *, CASE WHEN lag(source_idx) OVER o = source_idx AND abs(chunk_idx - lag(chunk_idx) OVER o) <= 2 THEN 0 ELSE 1 END AS fresh FROM fin WINDOW o AS (PARTITION BY query_id ORDER BY sel_pos)),
ig AS (SELECT *, (sum(fresh) OVER (PARTITION BY query_id ORDER BY sel_pos))::BIGINT AS island FROM lg),
isl AS (SELECT query_id, island, string_agg(text, chr(10) || chr(10) ORDER BY sel_pos) AS text, max(relevance) AS relevance, arg_min(doc_id, sel_pos) AS doc_id, min(sel_pos) AS sel_pos, arg_min(source_idx, sel_pos) AS source_idx,
  arg_min(source_url, sel_pos) AS source_url, arg_min(source_title, sel_pos) AS source_title, first(pub_date ORDER BY sel_pos) AS pub_date, any_value(query) AS query, any_value(as_of) AS as_of, arg_min(fetched, sel_pos) AS fetched FROM ig GROUP BY 1, 2)"""
_HOURS = "date_diff('second', pub_date, as_of) / 3600"


def points(mean: str) -> str:
    news, days = has("query", w.NEWS), f"({_HOURS} / 24)"
    number = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda z: z <> ''))"
    return f"""(CASE WHEN relevance > 0.7 THEN 3 WHEN relevance > 0.4 THEN 2 WHEN relevance > 0.2 THEN 1 ELSE 0 END + CASE WHEN {mean} > 0 AND relevance > {mean} * 1.3::DOUBLE THEN 1 ELSE 0 END
    + CASE WHEN pub_date IS NULL THEN 1 WHEN {_HOURS} < 24 THEN 3 WHEN {_HOURS} < 168 THEN 2 WHEN {_HOURS} < 720 THEN 1 ELSE 0 END - CASE WHEN pub_date IS NOT NULL AND {news} AND {days} > 30 THEN 2 WHEN pub_date IS NOT NULL AND {news} AND {days} > 7 THEN 1 ELSE 0 END
    + CASE WHEN {facts('text')} THEN 2 ELSE 0 END + CASE WHEN source_idx < 3 THEN 1 WHEN source_idx < 6 THEN 0.5 ELSE 0 END + CASE WHEN {number} > 100 THEN 1 WHEN {number} > 50 THEN 0.5 ELSE 0 END)::DOUBLE"""


_LABEL = "CASE WHEN points >= 7 THEN 'HIGH' WHEN points >= 4 THEN 'MEDIUM' ELSE 'LOW' END"


def context_of(rows: str) -> str:
    """Sources that survive, their blocks and lists, from rows with sel_pos."""
    return f"""
sv AS (SELECT *, avg(relevance) OVER b AS am, max(relevance) OVER b AS mx FROM {rows} WHERE fetched WINDOW b AS (PARTITION BY query_id, source_idx)),
sn AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY source_idx) AS source_no FROM sv WHERE am >= 0.3 OR mx >= 0.5),
so AS (SELECT query_id, source_no, any_value(query) AS query, any_value(as_of) AS as_of, arg_min(source_title, sel_pos) AS source_title, arg_min(source_url, sel_pos) AS source_url, string_agg(replace(text, '**', ''), chr(10) ORDER BY sel_pos) AS body, min(pub_date) AS oldest FROM sn GROUP BY 1, 2),
cx AS (SELECT query_id, string_agg('[' || source_no || '] ' || source_title || chr(10) || body || chr(10), chr(10) ORDER BY source_no) AS context, string_agg('  [' || source_no || '] ' || source_title || ' — ' || source_url, chr(10) ORDER BY source_no) AS source_list, count(*) AS n FROM so GROUP BY 1)"""


WARNED = f"""
old AS (SELECT *, floor(date_diff('second', oldest, as_of) / 86400)::BIGINT AS days FROM so WHERE {has('query', w.NEWS)}),
wl AS (SELECT query_id, count(*) FILTER (days > 30) AS n_old, count(*) AS n, string_agg('  [' || source_no || '] (' || strftime(oldest, '%b %Y') || ', ' || days || ' days old)', chr(10) ORDER BY source_no) FILTER (days > 30) AS lines,
  string_agg('[' || source_no || ']', ', ' ORDER BY source_no) FILTER (coalesce(days <= 30, true)) AS fresh FROM old GROUP BY 1),
warned AS (SELECT query_id, CASE WHEN n_old = 0 THEN '' WHEN n_old = n THEN {_text(context.ALL_OLD)} || lines || {_text(context.ALL_OLD_END)} ELSE {_text(context.SOME_OLD)} || lines || {_text(context.SOME_OLD_END)} || fresh || '.' || chr(10) END AS warning FROM wl)"""


def _pick(x: str, lists: list, values: list[str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(x, words)} THEN {_text(v)}" for words, v in zip(lists, values, strict=True)) + f" ELSE {_text(other)} END"


def profile(x: str) -> dict[str, str]:
    kinds = [w.PROFILE_BRIEF, w.PROFILE_BROAD]
    intents = [i[0] for i in w.INTENTS]
    return {
        "type": _pick(x, kinds, [k[0] for k in w.TYPES[:2]], w.TYPES[2][0]),
        "expected_length": _pick(x, kinds, [k[1] for k in w.TYPES[:2]], w.TYPES[2][1]),
        "intent": _pick(x, intents, [i[1] for i in w.INTENTS], w.OTHER_INTENT[0]),
        "attributes": _pick(x, intents, [", ".join(i[2]) for i in w.INTENTS], ", ".join(w.OTHER_INTENT[1])),
    }


def _plain(x: str) -> str:
    """A piece of text between tags, stripped, its references decoded (the tables' pages have these)."""
    for code, char in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, {_text(code)}, {_text(char)})"
    return strip(x)


#: Texts of the articles' headings and paragraphs, from pieces between tags: an element ends where as many ends as beginnings of its kind have come, or with the article. All pages of the tables have one, no dates and no other content elements.
ARTICLES = rf"""
art AS (SELECT page_id, url, html, regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) AS a FROM pages),
tg AS (SELECT page_id, unnest(tags) AS tag, unnest(range(1, len(tags) + 1)) AS i FROM (SELECT page_id, list_transform(regexp_extract_all(a, '<(/?[a-zA-Z0-9]+)[^>]*>', 1), lambda y: lower(y)) AS tags FROM art)),
pc AS (SELECT page_id, i, {_plain('x')} AS x FROM (SELECT page_id, unnest(p) AS x, unnest(range(1, len(p) + 1)) AS i FROM (SELECT page_id, string_split_regex(a, '<[^>]*>') AS p FROM art))),
kd AS (SELECT page_id, i, ltrim(tag, '/') AS kind, tag LIKE '/%' AS ends, sum(CASE WHEN tag LIKE '/%' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, ltrim(tag, '/') ORDER BY i) AS bal FROM tg WHERE ltrim(tag, '/') IN ({", ".join(map(_text, w.CONTENT_TAGS))})),
el AS (SELECT o.page_id, o.i, coalesce(min(e.i), 1000000000) AS till FROM kd o LEFT JOIN kd e ON e.page_id = o.page_id AND e.kind = o.kind AND e.ends AND e.i > o.i AND e.bal = o.bal - 1 WHERE NOT o.ends GROUP BY 1, 2),
et AS (SELECT el.page_id, el.i, string_agg(pc.x, ' ' ORDER BY pc.i) AS x FROM el JOIN pc ON pc.page_id = el.page_id AND pc.i > el.i AND pc.i <= el.till WHERE pc.x <> '' GROUP BY 1, 2),
pt AS (SELECT art.page_id, url, coalesce(string_agg(x, chr(10) || chr(10) ORDER BY i) FILTER (length(x) > 20), '') AS text, any_value({_plain("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) AS title FROM art LEFT JOIN et USING (page_id) GROUP BY 1, 2),
fetched_pages AS (SELECT url, substr(text, 1, 12000) AS text FROM pt WHERE length(text) > 50 AND {content('text')})"""
#: Chunks of the results' pages, in the place of documents as chunks: snippets stand for missing pages, a row a good chunk.
PAGE_CHUNKS = rf"""{HITS}, {merged('(' + language('title') + ") IN ('en', 'other')")},{ARTICLES},
ev AS (SELECT row_number() OVER () AS doc_id, m.*, f.text AS page_text FROM (SELECT * FROM merged WHERE source_idx < 10) m LEFT JOIN fetched_pages f USING (url)),
rd AS (SELECT doc_id, page_text AS text FROM ev WHERE page_text IS NOT NULL),{sized(rows="rd")},
gc AS (SELECT doc_id, chunk_idx AS place, {garbage('chunk')} AS text FROM sized),
gd AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1)::INT AS chunk_idx, text FROM gc WHERE length(text) >= 50 AND NOT {incomplete('text')} AND NOT {low_quality('text')}),
ac AS (SELECT * FROM gd UNION ALL SELECT doc_id, 0, snippet FROM ev WHERE page_text IS NULL AND snippet <> ''),
named AS (SELECT row_number() OVER () AS doc_id, query_id, query, source_idx::INT AS source_idx, chunk_idx, ac.text, NULL::TIMESTAMP AS pub_date, as_of, url AS source_url, title AS source_title,
  page_text IS NOT NULL OR max((page_text IS NOT NULL)::INT) OVER (PARTITION BY query_id) = 0 AS fetched FROM ac JOIN ev USING (doc_id) JOIN asked USING (query_id)),
chunks AS (SELECT doc_id, query_id, query, source_idx, chunk_idx, text, pub_date, as_of FROM named)"""


_P = profile("a.query")
PROMPT = f"""
sig AS (SELECT query_id, count(*) AS chunks, count(DISTINCT {netloc('source_url')}) AS domains, count(*) FILTER ({facts('text')}) AS facts, count(pub_date) AS dated FROM isl GROUP BY 1)
SELECT a.query_id, {_text(context.HEAD)} || strftime(a.as_of, '%Y-%m-%d %H:%M:%S') || ' (' || dayname(a.as_of) || ')' || coalesce(warning, '') || {_text(context.RULES)} || '- Context chunks: ' || chunks || chr(10) || '- Unique sources: ' || coalesce(cx.n, 0) || chr(10)
  || '- Unique domains: ' || domains || chr(10) || '- Chunks with factual data: ' || facts || chr(10) || '- Chunks with explicit dates: ' || dated || chr(10) || chr(10) || 'QUERY PROFILE:' || chr(10) || '- Type: ' || {_P['type']} || chr(10) || '- Intent: ' || {_P['intent']} || chr(10)
  || '- Expected answer shape: ' || {_P['expected_length']} || chr(10) || '- Critical attributes: ' || {_P['attributes']} || chr(10) || chr(10) || 'QUESTION: ' || a.query || chr(10) || chr(10) || 'SOURCES:' || chr(10) || coalesce(context, {_text(context.NO_SOURCES)}) || chr(10) || chr(10)
  || 'References:' || chr(10) || coalesce(source_list, '') || {_text(context.FOOT)} AS prompt
FROM (SELECT DISTINCT query_id, query, as_of FROM chunks) a JOIN sig USING (query_id) LEFT JOIN cx USING (query_id) LEFT JOIN warned USING (query_id)"""
_COS = "SELECT e.vec_id, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"
_PROFILE = profile("query")
_PUBLISHED = "CASE hour(ts) % 9 WHEN 2 THEN date_trunc('day', ts) WHEN 3 THEN date_trunc('minute', ts) WHEN 4 THEN date_trunc('hour', ts) ELSE date_trunc('second', ts) END"
_FIRST = "arg_min(title, rank) AS t1, arg_min(title, rank) FILTER (rank > 1) AS t2"
_TAGLESS = "regexp_replace(html, '<[^>]*>', ' ', 'g')"

_DOT = lambda a, b: f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"
_NEAR = f"coalesce({_DOT('v.embedding', 'u.embedding')} / (sqrt({_DOT('v.embedding', 'v.embedding')}) * sqrt({_DOT('u.embedding', 'u.embedding')})), 0)"
_VECTORS = "LEFT JOIN embeddings v ON v.vec_id = n.doc_id LEFT JOIN embeddings u ON u.vec_id = n.query_id"

ORACLES = {
    "hybrid_semantic": f"WITH {hybrid(_NEAR, _VECTORS)} SELECT doc_id, round(semantic, 4) AS semantic, relevance FROM scored",
    "lang_detect": f"SELECT doc_id, {language('text')} AS detected, CASE WHEN regexp_matches(text, '[Ѐ-ӿ]') THEN 'ru' ELSE 'en' END AS query_lang FROM documents",
    "url_normalize": f"SELECT page_id, {norm('url')} AS norm, {key('url')} AS engine_key FROM pages",
    "url_domain": f"SELECT page_id, replace({netloc('url')}, 'www.', '') AS domain, {netloc('url')} AS netloc FROM pages",
    "redirect_unwrap": "SELECT page_id, url AS a, url AS r, url AS b, url AS plain FROM pages",
    "publish_date": f"SELECT event_id, CASE WHEN hour(ts) % 9 < 6 THEN strftime({_PUBLISHED}, '%Y-%m-%d %H:%M:%S') END AS published FROM events",
    "result_hits": f"WITH {HITS}, f AS (SELECT query_id, length(t1) > length(t2) AS bare FROM (SELECT query_id, {_FIRST} FROM hits WHERE engine = 'a' GROUP BY 1)), r AS (SELECT query_id, engine, row_number() OVER (PARTITION BY query_id, engine ORDER BY rank) AS rank, trim(title) AS title, url, CASE WHEN engine = 'a' AND coalesce(bare, false) THEN '' WHEN engine = 'a' AND rank % 4 = 3 THEN substr(trim(snippet), 1, 300) ELSE trim(snippet) END AS snippet FROM hits JOIN f USING (query_id)) SELECT query_id, engine, rank::INT AS rank, title, url, snippet FROM r WHERE rank <= 15",
    "html_extract": f"WITH {ARTICLES} SELECT page_id, text, title, NULL::TIMESTAMP AS pub_date FROM pt",
    "page_fetch": f"WITH {ARTICLES} SELECT url, text, NULL::TIMESTAMP AS pub_date FROM pt WHERE length(text) > 50 AND {content('text')}",
    "search_and_read": f"WITH RECURSIVE {ASKED}, {ISLANDS.replace(CHUNKS, PAGE_CHUNKS)}, {context_of('isl')} SELECT q.query_id, coalesce(context, {_text(context.NO_SOURCES)}) AS context, coalesce(source_list, '') AS source_list FROM (SELECT DISTINCT query_id FROM isl) q LEFT JOIN cx USING (query_id)",
    "ask": f"WITH RECURSIVE {ASKED}, {ISLANDS.replace(CHUNKS, PAGE_CHUNKS)}, {context_of('isl')}, {WARNED}, {PROMPT}",
    "chunk_text": f"WITH RECURSIVE {sized()} SELECT * FROM sized",
    "chunk_filter": f"WITH RECURSIVE {sized()}, cl AS (SELECT doc_id, chunk_idx AS i, {garbage('chunk')} AS text FROM sized) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_idx, text FROM cl WHERE length(text) >= 50 AND NOT {incomplete('text')} AND NOT {low_quality('text')}",
    "semantic_chunks": f"WITH RECURSIVE {MEANT} SELECT * FROM meant",
    "tokenize_df": f"SELECT token, count(*) AS n FROM (SELECT unnest({tok('text')}) AS token FROM documents) GROUP BY 1",
    "sentence_split": rf"SELECT doc_id, len({sent('text')})::BIGINT AS sentences, length({sent('text')}[1])::BIGINT AS first_len, len(list_filter(list_transform(regexp_split_to_array({strip('text')}, '\n{{2,}}'), lambda y: {strip('y')}), lambda z: z <> ''))::BIGINT AS paragraphs FROM documents",
    "query_topk": f"SELECT conv_id, turn, ({breadth('text')})::INT AS top_k FROM conversations",
    "query_weights": f"SELECT conv_id, turn, {weight('text', (0.8, 0.5, 0.65, 0.7))} AS bm25_w, {weight('text', (0.2, 0.5, 0.35, 0.3))} AS semantic_w FROM conversations",
    "query_profile": f"WITH {ASKED} SELECT query_id, {', '.join(f'{v} AS {k}' for k, v in _PROFILE.items())} FROM asked",
    "news_flag": f"SELECT conv_id, turn, {has('text', w.NEWS)} AS news, {factoid('text')} AS factoid FROM conversations",
    "factual_flag": f"SELECT doc_id, {facts('text')} AS factual FROM documents",
    "garbage_lines": f"SELECT doc_id, length({garbage('text')})::BIGINT AS n, md5({garbage('text')}) AS digest FROM documents",
    "chunk_incomplete": f"SELECT doc_id, {incomplete('text')} AS incomplete FROM documents",
    "chunk_low_quality": f"SELECT doc_id, {low_quality('text')} AS low_quality FROM documents",
    "content_page": f"SELECT doc_id, {content('text')} AS content FROM documents",
    "hit_admission": f"WITH {HITS}, r AS (SELECT query_id, url, title, row_number() OVER (PARTITION BY query_id ORDER BY rank, url) AS rank FROM hits), f AS (SELECT * FROM r WHERE coalesce(title, '') <> '' AND starts_with(url, 'http') AND NOT regexp_matches({netloc('url')}, '(bing\\.com|microsoft\\.com)$') QUALIFY row_number() OVER (PARTITION BY query_id, {key('url')} ORDER BY rank) = 1) SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY rank))::INT AS rank, url FROM f",
    "merge_results": f"WITH {HITS}, {merged('(' + language('title') + ') IN (' + chr(39) + 'en' + chr(39) + ', ' + chr(39) + 'other' + chr(39) + ')')} SELECT query_id, source_idx, title, url, snippet, round(raw, 3) AS score, engines FROM merged",
    "search": f"WITH {HITS}, {merged('(' + language('title') + ') IN (' + chr(39) + 'en' + chr(39) + ', ' + chr(39) + 'other' + chr(39) + ')')} SELECT query_id, source_idx::INT AS source_idx, title, url, round(raw, 3) AS score FROM merged",
    "snippet_fallback": f"WITH {HITS}, {merged()}, px AS (SELECT url, {_TAGLESS} AS text FROM pages), pg AS (SELECT * FROM px WHERE {content('text')}), j AS (SELECT m.query_id, m.source_idx, m.snippet, pg.text AS page_text FROM merged m LEFT JOIN pg USING (url) WHERE m.source_idx < 10) SELECT query_id, source_idx, coalesce(page_text, snippet) AS text, page_text IS NOT NULL OR max((page_text IS NOT NULL)::INT) OVER (PARTITION BY query_id) = 0 AS fetched FROM j",
    "idf_stats": f"WITH {IDF} SELECT query_id, token, df, round(idf, 6) AS idf FROM idf",
    "tfidf_cosine": f"WITH {IDF}, {TFIDF} SELECT doc_id, round(CASE WHEN x.l * y.l > 0 THEN coalesce(x.dot, 0) / (x.l * y.l) ELSE 0 END, 6) AS similarity FROM chunks LEFT JOIN x USING (doc_id) LEFT JOIN y ON y.query_id = chunks.query_id",
    "json_rows": "SELECT to_json({'conv_id': conv_id, 'turn': turn, 'role': role, 'text': text})::VARCHAR AS value FROM conversations",
    "bm25_scores": f"WITH {BM25} SELECT doc_id, round(bm25, 6) AS bm25 FROM bm",
    "bm25_topk": f"WITH {BM25} SELECT query_id, doc_id, round(bm25, 6) AS bm25, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id) AS place FROM bm QUALIFY place <= 8",
    "answer_spans": f"WITH {CHUNKS}, {SPANS} SELECT doc_id, round(score, 6) AS score, md5(s) AS sentence, length({strip('substring(text, greatest(0, instr(text, s) - 101) + 1, least(length(text), instr(text, s) - 1 + length(s) + 100) - greatest(0, instr(text, s) - 101))')})::BIGINT AS span_len FROM spans",
    "hybrid_score": f"WITH {HYBRID} SELECT doc_id, relevance, round(bm25, 4) AS bm25, pos FROM scored",
    "semantic_prefilter": f"SELECT vec_id, round(similarity, 6) AS similarity FROM ({_COS}) WHERE similarity >= 0.30",
    "semantic_topk": f"SELECT vec_id, round(similarity, 6) AS similarity FROM ({_COS}) ORDER BY similarity DESC, vec_id LIMIT 10",
    "near_dedup": f"WITH RECURSIVE {folded(breadth('query'))} SELECT doc_id, place AS sel_pos FROM uniq",
    "source_caps": f"WITH RECURSIVE {folded(breadth('query'))} SELECT doc_id, cpos AS sel_pos FROM capd",
    "mmr_select": f"WITH RECURSIVE {folded('8')} SELECT doc_id, sel_pos::BIGINT AS sel_pos FROM mmr",
    "island_merge": f"WITH RECURSIVE {ISLANDS} SELECT query_id, island, md5(text) AS digest, relevance, doc_id FROM isl",
    "rerank": f"WITH RECURSIVE {ISLANDS}, am AS (SELECT *, avg(relevance) OVER (PARTITION BY query_id) AS mean FROM isl), p AS (SELECT *, {points('mean')} AS points FROM am) SELECT query_id, island, doc_id, relevance, {_LABEL} AS confidence FROM p",
    "context_build": f"WITH RECURSIVE {ISLANDS}, {context_of('isl')} SELECT q.query_id, coalesce(context, {_text(context.NO_SOURCES)}) AS context, coalesce(source_list, '') AS source_list FROM (SELECT DISTINCT query_id FROM isl) q LEFT JOIN cx USING (query_id)",
    "prompt_build": f"WITH RECURSIVE {ISLANDS}, {context_of('isl')}, {WARNED}, {PROMPT}",
    "confidence": f"WITH {HYBRID}, am AS (SELECT *, avg(relevance) OVER (PARTITION BY query_id) AS mean FROM scored), p AS (SELECT *, {points('mean')} AS points FROM am) SELECT doc_id, points, {_LABEL} AS confidence, CASE WHEN pub_date IS NOT NULL AND {has('query', w.NEWS)} THEN CASE WHEN {_HOURS} / 24 > 30 THEN 'outdated (' || trunc({_HOURS} / 24)::INT || ' days old)' WHEN {_HOURS} / 24 > 7 THEN 'dated (' || trunc({_HOURS} / 24)::INT || ' days old)' END END AS confidence_note FROM p",
    "source_relevance": f"WITH {HYBRID}, kept AS (SELECT *, pos AS sel_pos FROM scored), {context_of('kept')} SELECT query_id, source_idx::BIGINT AS source_idx, max(source_no) AS source_no, count(*) AS chunks FROM sn GROUP BY 1, 2",
    "ghost_sources": f"WITH {CHUNKS} SELECT DISTINCT query_id, source_idx::BIGINT AS source_idx, source_title, source_url FROM named WHERE NOT fetched",
    "source_list": f"WITH {HYBRID}, kept AS (SELECT *, pos AS sel_pos FROM scored), {context_of('kept')} SELECT q.query_id, coalesce(source_list, '') AS source_list, length(coalesce(context, {_text(context.NO_SOURCES)}))::BIGINT AS context_len, md5(coalesce(context, {_text(context.NO_SOURCES)})) AS context_digest FROM (SELECT DISTINCT query_id FROM chunks) q LEFT JOIN cx USING (query_id)",
    "freshness_warning": f"WITH {HYBRID}, kept AS (SELECT *, pos AS sel_pos FROM scored), {context_of('kept')}, {WARNED} SELECT q.query_id, coalesce(warning, '') AS warning FROM (SELECT DISTINCT query_id FROM chunks) q LEFT JOIN warned USING (query_id)",
    "prompt_file_name": rf"WITH {ASKED} SELECT query_id, 'prompt_' || substring(regexp_replace(trim(regexp_replace(query, '[^\p{{L}}\p{{N}}_\s-]', '', 'g')), '[-\s]+', '_', 'g'), 1, 50) || '_' || strftime(as_of, '%Y%m%d_%H%M%S') || '.txt' AS file_name FROM asked",
}
