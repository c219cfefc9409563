"""The registered queries in DuckDB SQL, written independently of the Spark plans."""

from __future__ import annotations

from ..functions.bibliography import ESCAPES, KEY_STOP_WORDS, PUBLISHERS
from ..functions.text import OMITTED
from ..operators.enrich import PAYWALLED
from ..operators.ranking import EXPANSION_STOP
from ..operators.sections import HEADINGS
from ..operators.tfidf import STOP_WORDS
from ..operators.topics import TOPIC_STOP
from .fixtures import QUERIES, TOPIC


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "(" + ", ".join(_q(w) for w in words) + ")"


_LINE = "split_part(text, chr(10), 1)"
_REST = f"substr(text, length({_LINE}) + 2)"
_collapse = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_hits = ", ".join("CASE WHEN " + " AND ".join(f"contains(low, ' {w} ')" for w in q.split()) + f" THEN {_q(q)} END" for q in QUERIES)
PAPERS = f"""
papers AS (
  SELECT doc_id AS pos, 'doc:' || doc_id AS paper_id, {_collapse(_LINE)} AS title, {_collapse(_REST)} AS abstract,
         CAST(2000 + doc_id % 25 AS BIGINT) AS year, (doc_id * 7919) % 500 AS citation_count, source, lang,
         'Author' || (doc_id % 7) || ' Name' || (doc_id % 11) AS author, list_filter([{_hits}], lambda x: x IS NOT NULL) AS mq
  FROM (SELECT *, ' ' || {_collapse("lower(text)")} || ' ' AS low FROM documents)
)"""
FLOW = """
flow AS (
  SELECT c_nationkey AS src, s_nationkey AS dst, sum(l_extendedprice * (1 - l_discount)) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY ALL
), e AS (
  SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst
  FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(w, 2) DESC, dst) AS rn FROM flow) WHERE rn <= 3
)"""


def _tokens(expr: str, stop) -> str:
    return f"list_filter(regexp_extract_all(lower({expr}), '[\\p{{L}}\\p{{M}}\\p{{Nd}}_]{{2,}}'), lambda w: w NOT IN {_list(stop)})"


def _tfidf(docs_sql: str, stop, ngrams: int, cap: int | None, extra: str = "", max_df: str = "", sublinear: bool = False) -> str:
    """CTEs w(doc, term, w) over docs(doc, text)."""
    pair = " UNION ALL SELECT doc, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS term FROM toks" if ngrams == 2 else ""
    tf = "1 + ln(tf)" if sublinear else "tf"
    return f"""
docs AS ({docs_sql}), toks AS (SELECT doc, {_tokens('text', stop)} AS ws FROM docs),
terms AS (SELECT doc, unnest(ws) AS term FROM toks{pair}),
tfs AS (SELECT doc, term, count(*) AS tf FROM terms GROUP BY ALL),
n AS (SELECT count(*) AS n FROM docs),
dfs AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tfs GROUP BY term {f"HAVING count(*) <= {max_df} * (SELECT n FROM n)" if max_df else ""} {f"ORDER BY total DESC, term LIMIT {cap}" if cap else ""}),
raw AS (SELECT doc, term, ({tf}) * (ln((1 + n.n) / (1.0 + df)) + 1) AS w FROM tfs JOIN dfs USING (term), n),
w AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM raw){extra}"""


_ASK = " ".join([TOPIC] * 3 + list(QUERIES))
RELEVANCE = f"""{PAPERS},
{_tfidf(f"SELECT CAST(pos AS VARCHAR) AS doc, title || ' ' || title || ' ' || abstract AS text FROM papers UNION ALL SELECT 'q', {_q(_ASK)}", STOP_WORDS, 2, 20000)},
rel AS (
  SELECT p.*, greatest(0.0, least(1.0, coalesce(d.dot, 0.0))) AS relevance
  FROM papers p LEFT JOIN (SELECT a.doc, sum(a.w * b.w) AS dot FROM w a JOIN w b ON a.term = b.term AND b.doc = 'q' WHERE a.doc <> 'q' GROUP BY a.doc) d ON d.doc = CAST(p.pos AS VARCHAR)
)"""

_lev = "CASE" + "".join(f" WHEN starts_with(lower(doi), {_q(p)}) THEN {_q(n)}" for p, n in PUBLISHERS) + " END"
_VENUE = f"CASE WHEN (trim(venue) = '' OR contains(lower(venue), 'arxiv') OR lower(trim(venue)) = 'preprint') AND {_lev} IS NOT NULL THEN {_lev} ELSE trim(venue) END"
WITH_DOI = f"""{PAPERS},
cited AS (
  SELECT *, CASE pos % 4 WHEN 0 THEN '10.1364/ao.' || pos WHEN 1 THEN '10.1109/' || pos END AS doi,
         CASE pos % 3 WHEN 0 THEN 'arXiv preprint' WHEN 1 THEN 'Proceedings of A & B_C' ELSE '' END AS venue
  FROM papers
), named AS (SELECT *, {_VENUE} AS v, {_lev} AS pub FROM cited),
kinds AS (SELECT *, CASE WHEN (contains(lower(v), 'arxiv') OR contains(lower(v), 'preprint')) AND pub IS NULL THEN 'misc' WHEN regexp_matches(lower(v), 'conference|proceedings|workshop|symposium') THEN 'inproceedings' ELSE 'article' END AS kind FROM named)"""


def _escaped(x: str) -> str:
    """Braces and carets are first set aside, so that no escape is escaped again."""
    aside = {"{": "chr(1)", "}": "chr(2)", "~": "chr(3)", "^": "chr(4)"}
    for ch, mark in aside.items():
        x = f"replace({x}, {_q(ch)}, {mark})"
    for ch, out in ESCAPES:
        if ch not in aside:
            x = f"replace({x}, {_q(ch)}, {_q(out)})"
    for ch, out in ESCAPES:
        if ch in aside:
            x = f"replace({x}, {aside[ch]}, {_q(out)})"
    return x


_MARKED = "SELECT conv_id, turn, text || ' [' || (turn + 1) || '] and [' || (conv_id % 120) || '] [' || (turn + 1) || '] end' AS body FROM conversations"
_DIMENSIONS = f"""{PAPERS}, m AS ({_MARKED}),
dims AS (
  SELECT 'faithfulness' AS dimension, CAST(round_even(round(avg(CASE WHEN quality = 0 THEN 0.0 ELSE 1.0 END), 3) * 100, 0) AS BIGINT) AS score, 0.25 AS weight, count(*) > 0 AS available FROM labels
  UNION ALL SELECT 'citation_coverage', CAST(round_even(100 * avg(CASE WHEN turn % 2 = 0 AND regexp_matches(body, '\\[\\d{{1,3}}\\]') THEN 1.0 ELSE 0.0 END), 0) AS BIGINT), 0.20, count(*) > 0 FROM m
  UNION ALL SELECT 'network_hub', 70, 0.15, true
  UNION ALL SELECT 'topic_balance', CAST(round_even(0.85 * round_even(100 * greatest(0, least(1, 1 - stddev_pop(c) / avg(c))), 0), 0) AS BIGINT), 0.20, count(*) > 0 FROM (SELECT lang, count(*) AS c FROM papers GROUP BY lang)
  UNION ALL SELECT 'recency', CAST(round_even(100 * avg(CASE WHEN year >= 2019 THEN 1.0 ELSE 0.0 END), 0) AS BIGINT), 0.10, count(*) > 0 FROM papers
  UNION ALL SELECT 'grounding', CAST(round_even(100 * avg(CASE WHEN quality = 1 THEN 1.0 WHEN toxic = 1 THEN 0.2 ELSE 0.6 END), 0) AS BIGINT), 0.10, count(*) > 0 FROM labels
)"""
_FP = "regexp_replace(lower(title), '[^a-z0-9]', '', 'g')"
_GROUPS = f"""{PAPERS}, titled AS (SELECT *, {_FP} AS fp FROM papers WHERE title <> ''),
grp AS (SELECT *, min(pos) OVER (PARTITION BY CASE WHEN length(fp) >= 12 THEN fp ELSE paper_id END) AS group_id FROM titled)"""
_MERGED = f"""{_GROUPS},
merged AS (
  SELECT group_id AS pos, arg_min(paper_id, pos) AS paper_id, arg_min(title, pos) AS title, arg_min(abstract, -length(abstract) * 1000000000 + pos) AS abstract,
         max(citation_count) AS citation_count, arg_min(year, pos) AS year, string_agg(DISTINCT source, '+' ORDER BY source) AS source
  FROM grp GROUP BY group_id
), qs AS (SELECT group_id, q, min(pos * 10 + i) AS place FROM (SELECT group_id, pos, unnest(mq) AS q, unnest(range(len(mq))) AS i FROM grp) GROUP BY ALL),
ql AS (SELECT group_id, string_agg(q, '|' ORDER BY place) AS queries, count(*) AS nq FROM qs GROUP BY group_id)"""
_PRF_TOKENS = f"list_filter(regexp_extract_all(lower(title || ' ' || title || ' ' || abstract), '[a-z][a-z0-9\\-]{{2,}}'), lambda w: w NOT IN {_list(sorted(EXPANSION_STOP))})"
_NUMBERED = "^\\s*(\\d{1,2}(?:\\.\\d+){0,3})[\\.\\)]?\\s+([\\p{L}\\p{M}\\p{Nd}_\\s:\\-–&/,()\\x{4e00}-\\x{9fff}\\x{ff00}-\\x{ffef}]{2,70})\\s*$"
_NAME = "trim(regexp_replace(lower(trim(regexp_replace(trim(line), '^\\d{1,2}(?:\\.\\d+){0,3}[\\.\\)]?\\s+', ''))), '[. ]+$', ''))"


def _ranks(edges: str) -> str:
    return f"""
nodes AS (SELECT CAST(n_nationkey AS BIGINT) AS node FROM nation), ee AS ({edges}),
od AS (SELECT node, count(src) AS o FROM nodes LEFT JOIN ee ON src = node GROUP BY node),
pr(i, node, r) AS (
  SELECT 0, node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) FROM nodes
  UNION ALL
  SELECT t.i, t.node, 0.15::DOUBLE / 25 + 0.85::DOUBLE * (coalesce(sum(g.got), 0) + any_value(t.loose) / 25)
  FROM (SELECT p.i + 1 AS i, n.node, sum(CASE WHEN od.o = 0 THEN p.r ELSE 0 END) AS loose FROM pr p JOIN od ON od.node = p.node CROSS JOIN nodes n WHERE p.i < 60 GROUP BY ALL) t
  LEFT JOIN (SELECT ee.dst, sum(p.r / od.o) AS got FROM pr p JOIN od ON od.node = p.node JOIN ee ON ee.src = p.node GROUP BY ee.dst) g ON g.dst = t.node
  GROUP BY t.i, t.node
), ranked AS (SELECT node, r FROM pr WHERE i = 60)"""


ORACLES: dict[str, str] = {
    "ident_normalize": r"""
WITH a AS (
  SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'https://doi.org/10.1000/ABC' || o_orderkey WHEN 1 THEN 'doi:10.1364/ao.' || o_orderkey || '. ' WHEN 2 THEN 'not a doi ' || o_orderkey ELSE ' HTTP://DOI.ORG/10.1109/' || o_orderkey END AS d,
         '2301.' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN 'v2' ELSE '' END AS v, o_orderpriority || ' Is All-You Need! ' || o_orderkey AS t FROM orders
), b AS (SELECT *, trim(regexp_replace(trim(regexp_replace(lower(trim(d)), '^(https://doi.org/|http://doi.org/|doi.org/|doi:)', '')), '\.+$', '')) AS x FROM a)
SELECT o_orderkey, CASE WHEN regexp_matches(x, '^10\.\d{1,9}/\S+$') THEN x END AS doi, regexp_replace(trim(v), 'v\d+$', '') AS arxiv_id, regexp_replace(lower(t), '[^a-z0-9]', '', 'g') AS fingerprint FROM b""",
    "text_clean_condense": f"""
SELECT doc_id, md5({_collapse('text')}) AS clean_md5,
       md5(CASE WHEN length(text) <= 9000 THEN text ELSE substr(text, 1, 6000) || {_q(OMITTED)} || right(text, 3000) END) AS condensed_md5,
       coalesce(nullif(substr(regexp_replace(regexp_replace({_LINE}, '[^0-9A-Za-z_\\x{{4e00}}-\\x{{9fff}}]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60), ''), 'review') AS slug,
       md5(trim(regexp_replace(regexp_replace(CASE WHEN cut > 0.4 * length(text) THEN substr(text, 1, cut) ELSE text END, '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g'))) AS fulltext_md5
FROM (SELECT *, CASE WHEN regexp_matches(text, '(?i)\\n\\s*(references|bibliography|参考文献)\\s*\\n') THEN length(regexp_extract(text, '(?is)^(.*?)\\n\\s*(references|bibliography|参考文献)\\s*\\n', 1)) ELSE 0 END AS cut FROM documents)""",
    "markup_strip": r"""
SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+([.,;:!?])', '\1', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages""",
    "inverted_index_rebuild": r"""SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS abstract FROM benchmark""",
    "semi_structured_parse": "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k, 'event:' || event_id AS paper_id FROM events",
    "query_compile": rf"""
WITH a AS (SELECT doc_id, trim({_LINE}) AS q FROM documents),
b AS (SELECT *, list_filter(regexp_split_to_array(replace(q, '"', ' '), '\s+'), lambda w: w <> '') AS ws FROM a)
SELECT doc_id, CASE WHEN regexp_matches(q, '^(ti|abs|au|cat|all):') THEN q WHEN len(ws) <= 1 THEN 'all:' || q
       ELSE array_to_string(list_transform(ws, lambda w: CASE WHEN contains(w, '-') THEN 'all:"' || w || '"' ELSE 'all:' || w END), ' AND ') END AS arxiv_query,
       rtrim(substr(trim(regexp_replace(regexp_replace(q, '[,:|()\[\]{{}}<>"''&+]', ' ', 'g'), '\s+', ' ', 'g')), 1, 110)) AS filter_value FROM b""",
    "source_fanout_union": r"""
WITH d AS (SELECT doc_id AS n, CAST(doc_id AS VARCHAR) AS k, 'On ' || md5(text) AS t, CAST(2000 + doc_id % 25 AS BIGINT) AS y, doc_id % 2 = 1 AS odd, doc_id % 97 = 0 AS broken, source AS src FROM documents),
e AS (SELECT * FROM d WHERE n % 6 <= 4)
SELECT n AS pos, CASE n % 6 WHEN 0 THEN 'openalex' WHEN 1 THEN 'semantic_scholar' WHEN 2 THEN 'crossref' WHEN 3 THEN 'arxiv' ELSE 'pubmed' END AS source,
  CASE WHEN broken THEN CASE n % 6 WHEN 0 THEN 'openalex:' WHEN 2 THEN 'crossref:' ELSE '' END
       ELSE CASE n % 6 WHEN 0 THEN CASE WHEN odd THEN 'doi:10.1/a' || k ELSE 'openalex:W' || k END WHEN 1 THEN CASE WHEN n % 4 = 0 THEN 'doi:10.1/b' || k WHEN odd THEN 'arxiv:2301.' || k ELSE 's2:' || k END
            WHEN 2 THEN 'doi:10.2/' || k WHEN 3 THEN 'arxiv:2301.' || k ELSE 'doi:10.3/' || k END END AS paper_id,
  CASE WHEN broken THEN '' ELSE t END AS title, CASE WHEN NOT broken THEN y END AS year,
  CASE WHEN broken THEN '' ELSE CASE n % 6 WHEN 0 THEN '' WHEN 1 THEN 'A venue' WHEN 2 THEN 'J' WHEN 3 THEN 'arXiv preprint' ELSE 'J' END END AS venue,
  CASE WHEN broken OR n % 6 >= 3 THEN 0 ELSE n % 500 END AS citation_count,
  CASE WHEN broken THEN '' ELSE CASE n % 6 WHEN 0 THEN 'first words of words' WHEN 1 THEN coalesce(src, '') WHEN 2 THEN 'things of ' || k || '.' WHEN 3 THEN 'an abstract' ELSE 'one two' END END AS abstract,
  CASE WHEN broken THEN NULL ELSE CASE n % 6 WHEN 0 THEN CASE WHEN odd THEN '10.1/a' || k END WHEN 1 THEN CASE WHEN n % 4 = 0 THEN '10.1/b' || k END WHEN 2 THEN '10.2/' || k WHEN 4 THEN '10.3/' || k END END AS doi,
  CASE WHEN broken THEN '' ELSE CASE n % 6 WHEN 0 THEN 'N ' || k WHEN 1 THEN '|Q ' || k WHEN 2 THEN 'G F' || k WHEN 3 THEN 'X ' || k ELSE 'Fo L' || k || '|Group|Y Z Last' END END AS authors,
  CASE WHEN broken THEN '' WHEN n % 6 = 1 AND odd THEN 'https://arxiv.org/pdf/2301.' || k WHEN n % 6 = 3 THEN 'https://arxiv.org/pdf/2301.' || k ELSE '' END AS pdf_url,
  CASE WHEN n % 6 = 0 AND NOT broken THEN 'W' || k ELSE '' END AS openalex_id, CASE WHEN n % 6 = 0 AND NOT broken THEN 'https://x.org/W' || (n + 6) ELSE '' END AS refs, 'q' AS queries
FROM e""",
    "source_predicates": """
SELECT doc_id AS pos, 'openalex:W' || doc_id AS paper_id, 'On ' || md5(text) AS title, 2000 + doc_id % 25 AS year, doc_id % 500 AS citation_count, 'https://x.org/W' || doc_id || '.pdf' AS pdf_url
FROM documents WHERE doc_id % 4 <> 3 AND doc_id % 3 = 0 AND doc_id % 11 <> 0 AND 2000 + doc_id % 25 >= 2010""",
    "dedup_groups": f"WITH {_GROUPS} SELECT pos, group_id FROM grp",
    "dedup_bridge": """
WITH RECURSIVE k AS (
  SELECT o_orderkey AS pos, 1 AS i, 'doi:' || o_custkey AS key FROM orders WHERE o_orderkey % 3 <> 0
  UNION ALL SELECT o_orderkey, 2, strftime(o_orderdate, '%Y%m%d') || o_orderpriority FROM orders
), h AS (SELECT key, min(pos) AS holder FROM k GROUP BY key),
p AS (SELECT pos, coalesce(arg_min(holder, i) FILTER (holder < pos), pos) AS parent FROM k JOIN h USING (key) GROUP BY pos),
walk(pos, top) AS (SELECT pos, parent FROM p UNION ALL SELECT w.pos, p.parent FROM walk w JOIN p ON p.pos = w.top WHERE p.parent <> p.pos)
SELECT pos, min(top) AS group_id FROM walk GROUP BY pos""",
    "dedup_merge": f"WITH {_MERGED} SELECT m.pos, paper_id, md5(abstract) AS abstract_md5, citation_count, year, source, coalesce(queries, '') AS queries FROM merged m LEFT JOIN ql ON ql.group_id = m.pos",
    "tfidf_relevance": f"WITH {RELEVANCE} SELECT pos, round(relevance, 5) AS relevance FROM rel",
    "relevance_gate": f"""WITH {RELEVANCE}, r AS (SELECT pos, round(relevance, 4) AS relevance FROM rel),
c AS (SELECT count(*) AS n, sum(CASE WHEN relevance >= 0.4 THEN 1 ELSE 0 END) AS above FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY relevance >= 0.4 DESC, CASE WHEN relevance >= 0.4 THEN pos END, relevance DESC, pos) AS rn FROM r)
SELECT pos, relevance FROM o, c WHERE rn <= CASE WHEN n > 20 THEN greatest(above, 20) ELSE above END""",
    "composite_rank": f"""WITH {RELEVANCE}, x AS (
  SELECT *, (pos % 10) / 10.0 AS hub, max(relevance) OVER () AS mr, max(citation_count) OVER () AS mc, min(year) OVER () AS y0, max(year) OVER () AS y1 FROM rel), y AS (SELECT *, max(hub) OVER () AS mh FROM x)
SELECT pos, round(0.55 * CASE WHEN mr > 0 THEN relevance / mr ELSE 0 END + 0.20 * ln(1 + citation_count) / CASE WHEN mc > 0 THEN ln(1 + mc) ELSE 1 END
  + 0.15 * (year - y0) / greatest(1, y1 - y0) + 0.10 * least(1.0, len(mq) / {len(QUERIES)}.0) + 0.10 * CASE WHEN mh > 0 THEN hub / mh ELSE 0 END, 4) AS score FROM y""",
    "pool_top": f"WITH {PAPERS} SELECT pos, CAST(citation_count AS DOUBLE) AS score FROM papers ORDER BY citation_count DESC, pos LIMIT 120",
    "prf_terms": f"""WITH {PAPERS}, t AS (SELECT *, {_PRF_TOKENS} AS ws FROM papers),
n AS (SELECT count(*) AS n FROM t), d AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(ws)) AS term FROM t) GROUP BY term),
i AS (SELECT term, ln((n.n + 1.0) / (df + 1.0)) + 1 AS idf FROM d, n), top AS (SELECT * FROM t ORDER BY citation_count DESC, pos LIMIT 12),
b AS (SELECT term, count(*) AS c, count(DISTINCT pos) AS docs FROM (SELECT pos, unnest(list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1])) AS term FROM top) GROUP BY term HAVING count(DISTINCT pos) >= 2),
u AS (SELECT term, count(*) AS c FROM (SELECT unnest(list_distinct(ws)) AS term FROM top) GROUP BY term)
SELECT b.term, 'bigram' AS kind, round(b.c * x.idf * y.idf, 5) AS score FROM b JOIN i x ON x.term = split_part(b.term, ' ', 1) JOIN i y ON y.term = split_part(b.term, ' ', 2)
UNION ALL SELECT u.term, 'unigram', round(u.c * i.idf, 5) FROM u JOIN i USING (term)""",
    "oa_target_select": f"""
WITH p AS (
  SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://' || ([{', '.join(_q(x) for x in PAYWALLED)}])[page_id % 5 + 1] || '/' || page_id WHEN 1 THEN url END AS pdf_url, CASE WHEN page_id % 2 = 0 THEN '10.1/' || page_id END AS doi FROM pages
), f AS (SELECT *, pdf_url IS NOT NULL AND NOT ({' OR '.join(f"contains(lower(pdf_url), {_q(x)})" for x in PAYWALLED)}) AS own, CASE WHEN doi IS NOT NULL AND page_id % 4 = 0 THEN 'https://oa.example/' || page_id END AS found FROM p)
SELECT page_id, own OR doi IS NOT NULL AS oa, CASE WHEN own THEN pdf_url ELSE found END AS text_url, CASE WHEN own THEN 'source-provided' WHEN found IS NOT NULL THEN 'unpaywall' END AS licence FROM f""",
    "fulltext_targets": "SELECT pos FROM (SELECT page_id AS pos, page_id % 6 = 0 AS has FROM pages ORDER BY (page_id % 3 = 0) DESC, page_id LIMIT 8) WHERE NOT has",
    "citation_enrich": f"""WITH {PAPERS}, k AS (SELECT *, substr({_FP}, 1, 60) AS fp FROM papers), l AS (SELECT fp, max(citation_count) AS c FROM k WHERE fp <> '' GROUP BY fp)
SELECT pos, CASE WHEN pos % 2 = 0 OR citation_count = 0 THEN coalesce(l.c, CASE WHEN pos % 2 = 0 THEN 0 ELSE citation_count END) ELSE citation_count END AS citation_count FROM k LEFT JOIN l ON l.fp = k.fp""",
    "year_histogram": "SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n FROM orders GROUP BY 1",
    "year_range": "SELECT min(year(o_orderdate)) || '–' || max(year(o_orderdate)) AS year_range FROM orders",
    "edges_build": f"WITH {FLOW} SELECT 'W' || src AS src, 'W' || dst AS dst FROM e",
    "pagerank_hub": f"WITH RECURSIVE {FLOW}, {_ranks('SELECT * FROM e')} SELECT node, round(r, 6) AS rank, round(r / max(r) OVER (), 4) AS hub_score FROM ranked",
    "pagerank_dangling": f"WITH RECURSIVE {FLOW}, {_ranks('SELECT * FROM e WHERE src % 3 <> 0')} SELECT node, round(r, 6) AS rank FROM ranked",
    "betweenness_bridge": f"""WITH RECURSIVE {FLOW}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
walk(s, v, path, d) AS (SELECT a, b, [a, b], 1 FROM u UNION ALL SELECT w.s, u.b, list_append(w.path, u.b), w.d + 1 FROM walk w JOIN u ON u.a = w.v WHERE NOT list_contains(w.path, u.b) AND w.d < 5),
dist AS (SELECT s, v, min(d) AS d FROM walk WHERE s <> v GROUP BY ALL), sp AS (SELECT w.* FROM walk w JOIN dist x ON x.s = w.s AND x.v = w.v AND x.d = w.d), np AS (SELECT s, v, count(*) AS n FROM sp GROUP BY ALL),
mid AS (SELECT s, v, unnest(path[2:len(path) - 1]) AS m FROM sp)
SELECT CAST(n_nationkey AS BIGINT) AS node, round(coalesce(sum(1.0 / np.n) / 2, 0), 4) AS between FROM nation LEFT JOIN mid ON m = n_nationkey LEFT JOIN np ON np.s = mid.s AND np.v = mid.v GROUP BY n_nationkey""",
    "coupling_pairs": "WITH r AS (SELECT DISTINCT l_orderkey AS p, l_partkey AS k FROM lineitem) SELECT a.p AS a, b.p AS b, count(*) AS shared FROM r a JOIN r b ON a.k = b.k AND a.p < b.p GROUP BY 1, 2 HAVING count(*) >= 2",
    "coupling_gaps": """WITH RECURSIVE r AS (SELECT DISTINCT l_orderkey AS p, l_partkey AS k FROM lineitem),
c AS (SELECT a.p AS a, b.p AS b FROM r a JOIN r b ON a.k = b.k AND a.p < b.p GROUP BY 1, 2 HAVING count(*) >= 2),
u AS (SELECT a, b FROM c UNION ALL SELECT b, a FROM c), reach(x, y) AS (SELECT a, a FROM u UNION SELECT reach.x, u.b FROM reach JOIN u ON u.a = reach.y),
comp AS (SELECT y AS node, min(x) AS component FROM reach GROUP BY y)
SELECT component, count(*) AS members, count(CASE WHEN o_orderpriority <> '1-URGENT' THEN 1 END) AS uncovered FROM comp JOIN orders ON o_orderkey = node GROUP BY component HAVING count(*) >= 2 AND count(CASE WHEN o_orderpriority <> '1-URGENT' THEN 1 END) >= 2""",
    "graph_export_stats": f"""WITH {FLOW}, d AS (SELECT dst, count(*) AS s FROM e GROUP BY dst ORDER BY s DESC, dst LIMIT 5)
SELECT (SELECT count(*) FROM nation) AS node_count, (SELECT count(*) FROM e) AS edge_count, (SELECT string_agg(CAST(dst AS VARCHAR), ',' ORDER BY s DESC, dst) FROM d) AS top_nodes""",
    "hub_dropped": f"WITH {PAPERS} SELECT pos, (pos % 10) / 10.0::DOUBLE AS hub_score FROM papers WHERE (pos % 10) / 10.0 >= 0.6 AND citation_count < 100 ORDER BY pos LIMIT 10",
    "store_upsert": "SELECT c_custkey AS key, round(CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 2 WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END, 2) AS balance FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0",
    "store_hydrate": """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name WHEN c_custkey % 5 <> 0 THEN 'stored ' || c_name ELSE '' END AS abstract,
  CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 5 <> 0 THEN 'stored ' || c_mktsegment END AS venue,
  CASE WHEN c_custkey % 5 <> 0 THEN c_custkey ELSE 0 END AS citation_count, CASE WHEN c_custkey % 5 <> 0 THEN 2001::BIGINT END AS year,
  CASE WHEN c_custkey % 5 <> 0 THEN c_name || '|' || c_mktsegment ELSE c_name END AS authors FROM customer""",
    "store_recall": f"""WITH dt AS (SELECT doc_id AS doc, unnest({_tokens('text', STOP_WORDS)}) AS term FROM documents), tfs AS (SELECT doc, term, count(*) AS tf FROM dt GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
qt AS (SELECT item_id AS q, unnest({_tokens('text', STOP_WORDS)}) AS term FROM benchmark), qf AS (SELECT q, term, count(*) AS qtf FROM qt GROUP BY ALL),
qi AS (SELECT q, qf.term, qtf, ln((2.0 + n) / (2.0 + coalesce(df, 0))) + 1 AS up FROM qf LEFT JOIN dfs USING (term), n),
qn AS (SELECT q, sqrt(sum(pow(qtf * up, 2))) AS qn FROM qi GROUP BY q),
base AS (SELECT doc, term, tf, ln((2.0 + n) / (1.0 + df)) + 1 AS idf FROM tfs JOIN dfs USING (term), n), plain AS (SELECT doc, sum(pow(tf * idf, 2)) AS p FROM base GROUP BY doc),
pair AS (SELECT q, doc, sum(tf * qtf * up * up) AS dot, sum(pow(tf * up, 2) - pow(tf * idf, 2)) AS shift FROM base JOIN qi USING (term) GROUP BY ALL),
sc AS (SELECT q, doc, dot / (qn * sqrt(p + shift)) AS score FROM pair JOIN plain USING (doc) JOIN qn USING (q)),
rk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rn FROM sc)
SELECT q AS query, count(*) AS n, round(max(score), 4) AS best, round(sum(score), 3) AS total FROM rk WHERE rn <= 10 AND score > 0 GROUP BY q""",
    "topic_silhouette": """
        WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        m AS (SELECT a.vec_id AS doc, a.label AS own, b.label AS other, avg(CASE WHEN a.vec_id <> b.vec_id THEN list_distance(a.v, b.v) END) AS d
              FROM e a, e b GROUP BY ALL),
        r AS (SELECT doc, max(CASE WHEN own = other THEN d END) AS a, min(CASE WHEN own <> other THEN d END) AS b FROM m GROUP BY doc)
        SELECT doc, round(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM r""",
    "topic_k": "SELECT CAST(label AS BIGINT) AS label, count(*) AS n, CAST(CASE WHEN count(*) <= 2 THEN 1 ELSE greatest(2, least(8, count(*) - 1, round_even(sqrt(count(*) / 2.0), 0))) END AS BIGINT) AS k FROM embeddings GROUP BY label",
    "topic_keywords": f"""WITH {_tfidf("SELECT doc_id AS doc, text FROM documents", (*STOP_WORDS, *TOPIC_STOP), 1, 8000, max_df="0.85", sublinear=True)},
z AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang), m AS (SELECT d.lang AS cluster, term, sum(w) / any_value(size) AS mean FROM w JOIN documents d ON d.doc_id = w.doc JOIN z ON z.lang = d.lang GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(mean, 9) DESC, term) AS rn FROM m WHERE mean > 0)
SELECT cluster, rn, term, round(mean, 5) AS mean FROM r WHERE rn <= 8""",
    "citation_numbering": f"""WITH {PAPERS}, old AS (SELECT paper_id, CAST(pos // 10 + 1 AS BIGINT) AS n FROM papers WHERE pos % 10 = 0)
SELECT * FROM old UNION ALL SELECT paper_id, (SELECT max(n) FROM old) + row_number() OVER (ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END, citation_count DESC, pos) AS n FROM papers WHERE pos % 10 <> 0""",
    "incremental_overlap": f"""WITH {PAPERS}, z AS (SELECT source, count(*) AS size FROM papers GROUP BY source), b AS (SELECT source, lang, count(*) AS c FROM papers WHERE pos % 2 = 0 GROUP BY ALL),
r AS (SELECT b.*, c / size AS ratio, row_number() OVER (PARTITION BY source ORDER BY c / size DESC, lang) AS rn FROM b JOIN z USING (source))
SELECT z.source AS cluster, lang AS prev, round(coalesce(ratio, 0), 6) AS ratio, coalesce(ratio, 0) >= 0.3 AND coalesce(lang <> 'de', false) AS kept FROM z LEFT JOIN r ON r.source = z.source AND rn = 1""",
    "section_parse": f"""
WITH a AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 5 = 3 THEN '2.' || ((i - 1) // 5 + 1) || ' Part' ELSE x END), chr(10)) AS text FROM documents),
c AS (SELECT *, CASE WHEN regexp_matches(text, '(?i)\\n\\s*(references|bibliography|参考文献)\\s*\\n') THEN length(regexp_extract(text, '(?is)^(.*?)\\n\\s*(references|bibliography|参考文献)\\s*\\n', 1)) ELSE 0 END AS cut FROM a),
s AS (SELECT doc_id, string_split(regexp_replace(CASE WHEN cut > 0.4 * length(text) THEN substr(text, 1, cut) ELSE text END, '\\n{{3,}}', chr(10), 'g'), chr(10)) AS ls FROM c),
l AS (SELECT doc_id, unnest(range(len(ls))) AS i, trim(regexp_replace(unnest(ls), '[ \\t]{{2,}}', ' ', 'g')) AS line FROM s),
h AS (SELECT *, CASE WHEN line = '' OR length(line) > 90 THEN NULL WHEN trim(regexp_extract(line, '{_NUMBERED}', 2)) <> '' THEN trim(regexp_extract(line, '{_NUMBERED}', 2)) WHEN {_NAME} IN {_list(HEADINGS)} THEN line END AS head FROM l),
o AS (SELECT *, sum(CASE WHEN head IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS ord FROM h),
g AS (SELECT doc_id, ord, max(head) AS heading, max(CASE WHEN head IS NOT NULL THEN CASE WHEN regexp_extract(line, '{_NUMBERED}', 1) <> '' THEN length(regexp_replace(regexp_extract(line, '{_NUMBERED}', 1), '[^.]', '', 'g')) + 1 ELSE 1 END END) AS level,
      string_agg(CASE WHEN head IS NULL AND line <> '' THEN line END, chr(10) ORDER BY i) AS body FROM o GROUP BY ALL)
SELECT doc_id, CAST(ord AS BIGINT) AS ord, coalesce(heading, 'Full Text') AS heading, CAST(coalesce(level, 0) AS BIGINT) AS level, length(body) AS chars FROM g WHERE coalesce(body, '') <> ''""",
    "table_detect": rf"""
WITH a AS (
  SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 4 = 1 THEN x || chr(10) || CASE doc_id % 3
    WHEN 0 THEN replace('Table 1: of runs~over two seeds~A  1  2~B  3  4', '~', chr(10)) WHEN 1 THEN replace('Fig. 2  of parts~~Results~| a | 1 |', '~', chr(10)) ELSE replace('tab. 3 alone~~~one more line~7 of 9 in 11 runs~x | y~Figure 4~', '~', chr(10)) END ELSE x END), chr(10)) AS text FROM documents
), c AS (SELECT *, CASE WHEN regexp_matches(text, '(?i)\n\s*(references|bibliography|参考文献)\s*\n') THEN length(regexp_extract(text, '(?is)^(.*?)\n\s*(references|bibliography|参考文献)\s*\n', 1)) ELSE 0 END AS cut FROM a),
ls AS (SELECT doc_id, string_split(CASE WHEN cut > 0.4 * length(text) THEN substr(text, 1, cut) ELSE text END, chr(10)) AS ls FROM c),
l0 AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS raw FROM ls),
l1 AS (SELECT *, trim(regexp_replace(raw, '[ \t]{{2,}}', ' ', 'g')) AS line FROM l0),
l2 AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)^(table|tab\.?)\s*\d+') THEN 't' WHEN regexp_matches(line, '(?i)^(figure|fig\.?)\s*\d+') THEN 'f' END AS kind,
  len(regexp_extract_all(raw, '\|')) AS bars, len(regexp_extract_all(raw, '[ \t]{{2,}}')) AS gaps, len(list_filter(regexp_split_to_array(trim(raw), '[ \t]{{2,}}'), lambda p: regexp_matches(p, '\d'))) AS nums,
  len(regexp_extract_all(raw, '\S+')) AS words, len(list_filter(regexp_extract_all(raw, '\S+'), lambda w: regexp_matches(w, '\d'))) AS numbers FROM l1),
l3 AS (SELECT *, kind IS NULL AND CASE WHEN bars > 0 THEN bars >= 2 ELSE (gaps >= 2 AND nums >= 2) OR (words >= 4 AND numbers >= 2) END AS is_row,
  line <> '' AND (kind IS NOT NULL OR (length(line) <= 90 AND (trim(regexp_extract(line, '{_NUMBERED}', 2)) <> '' OR {_NAME} IN {_list(HEADINGS)}))) AS stop FROM l2),
l4 AS (SELECT *, lead(is_row, 1, false) OVER o AS row_next, min(CASE WHEN line <> '' THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nb FROM l3 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
cap AS (
  SELECT x.doc_id, x.i, x.kind, CASE WHEN regexp_matches(x.raw, '[ \t]{{2,}}') THEN trim(x.raw) ELSE x.line END AS head, a.line AS l1, b.line AS l2, NOT coalesce(a.stop, true) AS one, NOT coalesce(a.stop, true) AND NOT a.row_next AND NOT coalesce(b.stop, true) AS two,
         a.i AS ai, a.row_next AS ar, b.i AS bi FROM l4 x LEFT JOIN l4 a ON a.doc_id = x.doc_id AND a.i = x.nb LEFT JOIN l4 b ON b.doc_id = x.doc_id AND b.i = a.nb WHERE x.kind IS NOT NULL
), ends AS (SELECT *, CASE WHEN two THEN bi + 1 WHEN one AND ar THEN ai + 1 WHEN one THEN coalesce(bi, 1000000000) ELSE coalesce(ai, 1000000000) END AS stop_at, length(head) + CASE WHEN one THEN 1 + length(l1) ELSE 0 END + CASE WHEN two THEN 1 + length(l2) ELSE 0 END AS chars FROM cap),
free AS (SELECT l.doc_id, l.i FROM l4 l WHERE is_row AND NOT EXISTS (SELECT 1 FROM ends e WHERE e.doc_id = l.doc_id AND e.i < l.i AND l.i < e.stop_at)),
runs AS (SELECT doc_id, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g, i FROM free), parts AS (SELECT doc_id, g, (row_number() OVER (PARTITION BY doc_id, g ORDER BY i) - 1) // 40 AS p, i FROM runs),
tabs AS (SELECT doc_id, g, p, min(i) AS i, count(*) AS n FROM parts GROUP BY ALL),
under AS (SELECT e.doc_id, coalesce(t.n, 0) AS n, chars FROM ends e LEFT JOIN tabs t ON t.doc_id = e.doc_id AND t.i = e.stop_at WHERE kind = 't')
SELECT d.doc_id, CAST((SELECT count(*) FROM tabs t WHERE t.doc_id = d.doc_id) + (SELECT count(*) FROM under u WHERE u.doc_id = d.doc_id) AS BIGINT) AS n_tables, CAST((SELECT count(*) FROM ends e WHERE e.doc_id = d.doc_id AND kind = 'f') AS BIGINT) AS n_figures,
  CAST(coalesce((SELECT sum(n) FROM tabs t WHERE t.doc_id = d.doc_id), 0) + coalesce((SELECT sum(n) FROM under u WHERE u.doc_id = d.doc_id), 0) AS BIGINT) AS n_rows,
  CAST(coalesce((SELECT sum(chars) FROM under u WHERE u.doc_id = d.doc_id), 0) AS BIGINT) AS table_chars, CAST(coalesce((SELECT sum(chars) FROM ends e WHERE e.doc_id = d.doc_id AND kind = 'f'), 0) AS BIGINT) AS figure_chars
FROM documents d""",
    "citation_extract": rf"WITH m AS ({_MARKED}) SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(body, '\[(\d{{1,3}})\]', 1), lambda n: CAST(n AS INTEGER)))), ',') AS cited FROM m",
    "citation_strip": rf"WITH m AS ({_MARKED}) SELECT conv_id, turn, md5(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(body, '\[0*([1-5])\]', chr(1) || '\1' || chr(2), 'g'), chr(3), ''), chr(4), ''), chr(5), ''), chr(6), ''), chr(7), ''), '\[\d{{1,3}}\]', '', 'g').replace(chr(1), '[').replace(chr(2), ']')) AS body_md5 FROM m",
    "claim_grounding": """WITH c AS (SELECT doc_id, 'doc:' || doc_id AS paper_id, doc_id + 1 AS n FROM labels WHERE doc_id % 2 = 0), x AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'high' WHEN toxic = 1 THEN 'low' ELSE 'medium' END AS confidence FROM labels),
f AS (SELECT x.doc_id, confidence, c.paper_id, 0 AS i FROM x JOIN c ON c.doc_id = x.doc_id UNION ALL SELECT x.doc_id, confidence, c.paper_id, 1 FROM x JOIN c ON c.n = x.doc_id)
SELECT doc_id AS claim_ix, confidence, paper_id, CAST(min(i) AS BIGINT) AS i FROM f GROUP BY ALL""",
    "faithfulness_score": "SELECT count(*) AS checked, count(CASE WHEN quality = 0 THEN 1 END) AS flagged, round(avg(CASE WHEN quality = 0 THEN 0.0 ELSE 1.0 END), 3) AS score FROM labels",
    "quality_scorecard": f"WITH {_DIMENSIONS} SELECT dimension, score, CAST(weight AS DOUBLE) AS weight, available FROM dims",
    "quality_overall": f"WITH {_DIMENSIONS}, o AS (SELECT CAST(round_even(sum(score * weight) / sum(weight), 0) AS BIGINT) AS overall FROM dims WHERE available) SELECT overall, CASE WHEN overall >= 85 THEN 'A' WHEN overall >= 70 THEN 'B' WHEN overall >= 55 THEN 'C' ELSE 'D' END AS grade FROM o",
    "bibtex_entries": f"""WITH {WITH_DOI}, words AS (SELECT *, list_filter(list_transform(regexp_extract_all(title, '[A-Za-z]+'), lambda w: lower(w)), lambda w: length(w) > 2 AND w NOT IN {_list(KEY_STOP_WORDS)}) AS ws FROM kinds),
based AS (SELECT *, 'name' || year || coalesce(ws[1], 'untitled') AS base FROM words), keyed AS (SELECT *, base || CASE WHEN row_number() OVER (PARTITION BY base ORDER BY pos) > 1 THEN chr(CAST(95 + row_number() OVER (PARTITION BY base ORDER BY pos) AS INTEGER)) ELSE '' END AS key FROM based)
SELECT pos, key, md5('@' || kind || '{{' || key || ',' || chr(10) || array_to_string(list_filter([
  CASE WHEN title <> '' THEN '  title = {{' || {_escaped('title')} || '}}' END, '  author = {{' || {_escaped('author')} || '}}', '  year = {{' || year || '}}',
  CASE WHEN kind = 'inproceedings' THEN '  booktitle = {{' || {_escaped('v')} || '}}' END, CASE WHEN kind = 'article' AND v <> '' THEN '  journal = {{' || {_escaped('v')} || '}}' END,
  CASE WHEN kind = 'misc' THEN '  howpublished = {{' || {_escaped("coalesce(nullif(v, ''), 'Preprint')")} || '}}' END, CASE WHEN doi IS NOT NULL THEN '  doi = {{' || doi || '}}' END], lambda x: x IS NOT NULL), ',' || chr(10)) || chr(10) || '}}') AS entry_md5 FROM keyed""".replace("{{", "{").replace("}}", "}"),
    "reference_list": f"""WITH {WITH_DOI} SELECT pos, array_to_string(list_filter(['**[' || (pos + 1) || ']** ' || author || ' (' || year || '). *' || coalesce(nullif(title, ''), '(untitled)') || '*.', CASE WHEN v <> '' THEN v || '.' END,
  CASE WHEN citation_count <> 0 THEN '被引 ' || citation_count || '.' END, CASE WHEN doi IS NOT NULL THEN 'DOI: [' || doi || '](https://doi.org/' || doi || ')' END], lambda x: x IS NOT NULL), ' ') AS line FROM kinds""",
    "evidence_block": f"""WITH {PAPERS}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY citation_count DESC, pos) - 1 AS i FROM papers)
SELECT source AS cluster, i, md5('[' || CASE WHEN pos % 2 = 0 THEN CAST(pos AS VARCHAR) ELSE 'None' END || '] ' || title || ' (' || year || ', 被引 ' || citation_count || ')' || chr(10) || '    结论: ' || CASE WHEN l.doc_id IS NOT NULL THEN 'quality ' || quality ELSE substr(abstract, 1, 180) END
  || CASE WHEN toxic = 1 THEN chr(10) || '    数据: toxic' ELSE '' END) AS line_md5 FROM r LEFT JOIN labels l ON l.doc_id = r.pos WHERE i < 15""",
    "papers_export": f"WITH {PAPERS} SELECT paper_id, length(title) AS title_chars, length(abstract) AS abstract_chars, pos % 2 = 0 AND length(abstract) > 0 AS has_fulltext, CAST(CASE WHEN pos % 2 = 0 THEN length(abstract) ELSE 0 END AS BIGINT) AS fulltext_chars, CASE WHEN pos % 3 = 0 THEN CAST(pos // 3 + 1 AS BIGINT) END AS citation_index FROM papers",
    "year_text": "SELECT string_agg(y || ':' || n, ', ' ORDER BY y) AS years FROM (SELECT 1990 + doc_id % 30 AS y, count(*) AS n FROM documents GROUP BY 1 ORDER BY 1 DESC LIMIT 12)",
    "quality_remarks": f"""WITH {_DIMENSIONS}, p AS (SELECT max(CASE WHEN dimension = 'faithfulness' THEN score END) AS f, max(CASE WHEN dimension = 'citation_coverage' THEN score END) AS c, max(CASE WHEN dimension = 'recency' THEN score END) AS r, max(CASE WHEN dimension = 'grounding' THEN score END) AS g FROM dims WHERE available),
z AS (SELECT (SELECT count(*) FROM labels WHERE quality = 0) AS flagged, (SELECT count(*) FROM m WHERE NOT (turn % 2 = 0 AND regexp_matches(body, '\\[\\d{{1,3}}\\]'))) AS bare, (SELECT 100 * (1 - stddev_pop(n) / avg(n)) FROM (SELECT count(*) AS n FROM papers GROUP BY lang)) AS balance),
a AS (
  SELECT 'weakness' AS kind, 0 AS i, '引用-论断一致性 ' || f || '%：' || flagged || ' 条论断疑似无充分支撑，建议补充引用或修订表述' AS text, f < 90 AS said FROM p, z
  UNION ALL SELECT 'highlight', 1, '引用-论断一致性高，自检闭环可信', f >= 95 FROM p
  UNION ALL SELECT 'weakness', 2, '引用覆盖 ' || c || '%：' || bare || ' 个小节缺少引用标注，建议补充支撑文献', c < 80 FROM p, z
  UNION ALL SELECT 'weakness', 3, '高枢纽论文被剔除：2 篇必引级工作（Hub one、Hub two 等）可能被遗漏，建议放宽闸门或手动纳入', true
  UNION ALL SELECT 'weakness', 4, '存在 2 个研究空白，建议针对性补检相关方向文献', true
  UNION ALL SELECT 'weakness', 5, '主题簇规模失衡，建议补充小规模方向文献或合并过细簇', balance < 60 FROM z
  UNION ALL SELECT 'weakness', 6, '时效偏弱：近 5 年文献仅占 ' || r || '%，建议补充最新进展', r < 50 FROM p
  UNION ALL SELECT 'weakness', 7, '部分论断证据强度弱（low 置信占比高），建议增强抽取或补充支撑证据', g < 70 FROM p
) SELECT kind, CAST(i AS BIGINT) AS i, text FROM a WHERE said""",
    "json_repair": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id AS id FROM events",
    "search_pool": f"""WITH {_MERGED}, {_tfidf(f"SELECT CAST(pos AS VARCHAR) AS doc, title || ' ' || title || ' ' || abstract AS text FROM merged UNION ALL SELECT 'q', {_q(_ASK)}", STOP_WORDS, 2, 20000)},
rel AS (SELECT p.*, coalesce(ql.nq, 0) AS nq, greatest(0.0, least(1.0, coalesce(d.dot, 0.0))) AS relevance FROM merged p LEFT JOIN ql ON ql.group_id = p.pos LEFT JOIN (SELECT a.doc, sum(a.w * b.w) AS dot FROM w a JOIN w b ON a.term = b.term AND b.doc = 'q' WHERE a.doc <> 'q' GROUP BY a.doc) d ON d.doc = CAST(p.pos AS VARCHAR)),
x AS (SELECT *, max(relevance) OVER () AS mr, max(citation_count) OVER () AS mc, min(year) OVER () AS y0, max(year) OVER () AS y1 FROM rel)
SELECT paper_id, title, year, citation_count, score FROM (SELECT *, round(0.55 * relevance / mr + 0.20 * ln(1 + citation_count) / ln(1 + mc) + 0.15 * (year - y0) / greatest(1, y1 - y0) + 0.10 * least(1.0, nq / {len(QUERIES)}.0), 4) AS score FROM x) ORDER BY score DESC, pos LIMIT 20""",
}
