"""The catalogue's queries in DuckDB's SQL."""

from __future__ import annotations


def _tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def _bm25(corpus: str, asked: str, k: int = 20) -> str:
    """CTEs bm25(qid, id, score, rank) of corpus (id, text) and asked (qid, query)."""
    return f"""
tk AS (SELECT id, {_tokens("text")} AS terms FROM ({corpus})),
st AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM tk),
dt AS (SELECT id, len(terms) AS dl, unnest(terms) AS term FROM tk),
tf AS (SELECT id, dl, term, count(*) AS f FROM dt GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5::double) - ln(df + 0.5::double) AS raw FROM dfs, st),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::double * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qf AS (SELECT qid, term, count(*) AS qf FROM (SELECT qid, unnest({_tokens("query")}) AS term FROM ({asked})) GROUP BY ALL),
sc AS (SELECT qid, id, round(sum(qf * idf * f * 2.5::double / (f + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))), 6) AS score
       FROM qf JOIN idf USING (term) JOIN tf USING (term), st GROUP BY qid, id),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::int AS rank FROM sc) WHERE rank <= {k} AND score > 0)"""


def _embedded(name: str, source: str) -> str:
    """CTE name(id, v): unit vectors of hashed tokens of source (id, text)."""
    return f"""
{name}_h AS (SELECT id, md5(term) AS h FROM (SELECT id, unnest({_tokens("text")}) AS term FROM ({source}))),
{name}_d AS (SELECT id, (('0x' || substr(h, 1, 8))::bigint % 64) AS dim, sum(CASE WHEN ('0x' || substr(h, 9, 1))::int < 8 THEN 1 ELSE -1 END)::double AS v FROM {name}_h GROUP BY ALL),
{name}_n AS (SELECT id, sqrt(sum(v * v)) AS norm FROM {name}_d GROUP BY id),
{name} AS (SELECT d.id, dim, CASE WHEN norm > 0 THEN v / norm ELSE 0 END AS v FROM {name}_d d JOIN {name}_n USING (id))"""


def _dense(corpus: str, asked: str, k: int = 20) -> str:
    """CTE dense(qid, id, score, rank)."""
    return f"""
{_embedded("dv", corpus)},
{_embedded("qv", asked)},
ds AS (SELECT q.id AS qid, d.id, round(coalesce(sum(qv.v * dv.v), 0), 6) AS score
       FROM (SELECT id FROM ({asked})) q CROSS JOIN (SELECT id FROM ({corpus})) d LEFT JOIN qv ON qv.id = q.id LEFT JOIN dv ON dv.id = d.id AND dv.dim = qv.dim GROUP BY ALL),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::int AS rank FROM ds) WHERE rank <= {k})"""


DOCS, ASKED, ASKED_TEXT = "SELECT doc_id AS id, text FROM documents", "SELECT item_id AS qid, text AS query FROM benchmark", "SELECT item_id AS id, text FROM benchmark"
CHUNKED = "SELECT doc_id AS id, source || '/doc' || doc_id || '.txt ' || text AS text FROM documents"
COVER = "len(list_intersect(list_distinct({q}), list_distinct({c})))::double / nullif(len(list_distinct({q})), 0)"

VARIANTS = f"""
qt AS (SELECT item_id AS qid, text AS question, {_tokens("text")} AS t FROM benchmark),
va AS (SELECT qid, unnest([0, 1, 2]) AS pos, unnest([question, array_to_string(t[1:ceil(len(t) / 2)::int], ' '), array_to_string(t[ceil(len(t) / 2)::int + 1:], ' ')]) AS query FROM qt),
vb AS (SELECT *, row_number() OVER (PARTITION BY qid, lower(query) ORDER BY pos) AS again FROM va WHERE pos = 0 OR trim(query) <> ''),
vr AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY pos) - 1 AS variant, query FROM vb WHERE again = 1)"""


def _hybrid(strategy: str, top_k: int, pool: int, rerank: bool) -> str:
    """CTE res(qid, id, rank, fused_score, rerank_score)."""
    variants = VARIANTS if strategy == "fusion" else "vr AS (SELECT item_id AS qid, 0 AS variant, text AS query FROM benchmark)"
    score = "coalesce(" + COVER.format(q=_tokens("b.text"), c=_tokens("d.text")) + ", 0)" if rerank else "NULL::double"
    return f"""
{variants},
{_bm25(CHUNKED, "SELECT qid * 100 + variant AS qid, query FROM vr")},
{_dense(CHUNKED, "SELECT qid * 100 + variant AS id, query AS text FROM vr")},
li AS (SELECT qid // 100 AS qid, 1 + qid % 100 AS list_no, rank, id FROM dense WHERE score > 0 UNION ALL SELECT qid // 100, 50 + qid % 100, rank, id FROM bm25),
fu AS (SELECT qid, id, round(sum(1.0::double / (60 + rank)), 9) AS fused_score FROM li GROUP BY ALL),
po AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused_score DESC, id) AS fr FROM fu) WHERE fr <= {pool}),
rr AS (SELECT p.*, {score} AS rerank_score FROM po p JOIN documents d ON d.doc_id = p.id JOIN benchmark b ON b.item_id = p.qid),
res AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rerank_score, 6) DESC NULLS LAST, fr)::int AS rank FROM rr) WHERE rank <= {top_k})"""


SHOWN = "qid, rank, id AS chunk_no, round(fused_score, 6) AS fused_score, round(rerank_score, 6) AS rerank_score"
PAGES = r"""pq AS (SELECT page_id AS qid, 'see ./src\' || coalesce(nullif(regexp_extract(url, '([0-9]+)(?:[?#].*)?$', 1), ''), 'x') || '.py, then ' || url || '/index.TSX and codingpy' AS question FROM pages),
pr AS (SELECT qid, unnest(range(0, len(r))) AS pos, unnest(r) AS ref FROM (SELECT qid, list_filter(list_transform(regexp_extract_all(question, '(?i)[\p{L}\p{N}_./\\-]*\.(?:py|js|jsx|ts|tsx|java|go|rs|cpp|cc|cxx|c|rb|cs|php|scala)\b'), lambda x: regexp_replace(replace(x, '\', '/'), '^[./]+', '')), lambda x: x <> '') AS r FROM pq))"""
JOBS = """jobs AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'signup' THEN 'cloning' WHEN 'view' THEN 'chunking' WHEN 'click' THEN 'embedding' WHEN 'purchase' THEN 'upserting' ELSE 'done' END AS phase,
  (props->>'$.k')::bigint AS current, event_id % 120 AS total FROM events)"""
EVALUATED = f"""
{_bm25(DOCS, ASKED)},
hit AS (SELECT qid, rank, text FROM bm25 JOIN documents ON doc_id = id WHERE rank <= 3),
ctx AS (SELECT qid, string_agg(text, chr(10) ORDER BY rank) AS seen, max(CASE WHEN rank = 1 THEN text END) AS answer FROM hit GROUP BY qid),
ev AS (SELECT item_id AS qid, {COVER.format(q=_tokens("answer"), c=_tokens("seen"))} AS faithfulness, {COVER.format(q=_tokens("text"), c=_tokens("answer"))} AS answer_relevancy,
  {COVER.format(q=_tokens("text"), c=_tokens("seen"))} AS context_recall FROM benchmark LEFT JOIN ctx ON ctx.qid = item_id)"""
VERSIONS = """ol AS (SELECT source || '/' || doc_id AS file_path, md5(text) AS digest FROM documents WHERE doc_id % 7 <> 0),
nw AS (SELECT source || '/' || doc_id AS file_path, md5(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS digest FROM documents WHERE doc_id % 11 <> 0),
ch AS (SELECT coalesce(ol.file_path, nw.file_path) AS file_path, CASE WHEN ol.file_path IS NULL THEN 'added' WHEN nw.file_path IS NULL THEN 'deleted' WHEN ol.digest <> nw.digest THEN 'changed' END AS change
  FROM ol FULL JOIN nw ON ol.file_path = nw.file_path)"""

ORACLES: dict[str, str] = {
    "tokenize_counts": f"SELECT doc_id, len(t)::bigint AS n_tokens, len(list_distinct(t))::bigint AS n_distinct FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)",
    "bm25_topk": f"WITH {_bm25(DOCS, ASKED)} SELECT qid, id AS doc_id, score, rank FROM bm25",
    "bm25_scan": f"WITH {_bm25(DOCS, ASKED)} SELECT qid, id AS doc_id, score, rank FROM bm25",
    "bm25_term_stats": f"""WITH dfs AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_tokens("text")})) AS term FROM documents) GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5::double) - ln(df + 0.5::double) AS raw FROM dfs, (SELECT count(*) AS n FROM documents)), m AS (SELECT avg(raw) AS mean FROM raw)
SELECT term, df::bigint AS df, round(CASE WHEN raw < 0 THEN 0.25::double * mean ELSE raw END, 6) AS idf FROM raw, m""",
    "dense_cosine_topk": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id)::int AS rank FROM (SELECT a.vec_id AS qid, b.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)) WHERE rank <= 20",
    "dense_label_agreement": "SELECT qid, round(avg(CASE WHEN label = own THEN 1.0::double ELSE 0 END), 6) AS agreement FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM (SELECT a.vec_id AS qid, a.label AS own, b.vec_id, b.label, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)) WHERE rank <= 20 AND qid <> vec_id GROUP BY qid",
    "hash_embed_topk": f"WITH {_dense(DOCS, ASKED_TEXT)} SELECT qid, id AS doc_id, score, rank FROM dense",
    "rrf_fusion": f"WITH {_bm25(DOCS, ASKED)}, {_dense(DOCS, ASKED_TEXT)}, li AS (SELECT qid, id, 1 AS l, rank FROM dense UNION ALL SELECT qid, id, 2, rank FROM bm25), fu AS (SELECT qid, id AS doc_id, round(sum(1.0::double / (60 + rank)), 9) AS fused_score, min((l, rank)) AS first FROM li GROUP BY ALL) SELECT qid, doc_id, fused_score, row_number() OVER (PARTITION BY qid ORDER BY fused_score DESC, first)::int AS fused_rank FROM fu",
    "hybrid_single": f"WITH {_hybrid('single', 5, 20, False)} SELECT {SHOWN} FROM res",
    "hybrid_retrieve": f"WITH {_hybrid('fusion', 5, 20, False)} SELECT {SHOWN} FROM res",
    "rerank_topk": f"WITH {_hybrid('single', 5, 20, True)} SELECT {SHOWN} FROM res",
    "corrective_retry": f"""WITH one AS (WITH {_hybrid('single', 5, 20, True)} SELECT * FROM res), two AS (WITH {_hybrid('single', 8, 40, True)} SELECT * FROM res),
pv AS (SELECT qid, string_agg(text, chr(10) ORDER BY rank) AS preview FROM one JOIN documents ON doc_id = id WHERE rank <= 4 GROUP BY qid),
no AS (SELECT item_id AS qid FROM benchmark LEFT JOIN pv ON pv.qid = item_id WHERE coalesce({COVER.format(q=_tokens('text'), c=_tokens('preview'))}, 0) < 0.5)
SELECT {SHOWN}, 0 AS attempt FROM one WHERE qid NOT IN (SELECT qid FROM no) UNION ALL SELECT {SHOWN}, 1 AS attempt FROM two WHERE qid IN (SELECT qid FROM no)""",
    "priority_merge": """WITH b AS (SELECT source, doc_id, 0 AS src, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 3
UNION ALL SELECT source, doc_id, 1, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents QUALIFY r <= 6),
o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY source, doc_id ORDER BY src, r) = 1)
SELECT source, doc_id, src, row_number() OVER (PARTITION BY source ORDER BY src, r)::int AS rank FROM o QUALIFY rank <= 5""",
    "expansion_dedupe": """WITH u AS (SELECT conv_id * 1000 + turn AS qid, text, array_to_string(string_split(text, ' ')[1:2], ' ') AS two FROM conversations WHERE role = 'user'),
e AS (SELECT qid, unnest([0, 1, 2, 3]) AS pos, unnest([text, regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), regexp_replace(two, '^\\s+|\\s+$', '', 'g'), regexp_replace(two, '^\\s+|\\s+$', '', 'g')]) AS query FROM u),
o AS (SELECT * FROM e WHERE pos = 0 OR query <> '' QUALIFY row_number() OVER (PARTITION BY qid, lower(query) ORDER BY pos) = 1)
SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY pos) - 1)::int AS variant, query FROM o""",
    "file_refs": f"WITH {PAGES} SELECT qid, pos::int AS pos, ref FROM pr",
    "path_match": f"WITH {PAGES} SELECT qid, doc_id AS chunk_no, file_path, row_number() OVER (PARTITION BY qid ORDER BY file_path, doc_id)::int AS rank FROM (SELECT DISTINCT qid, doc_id, file_path FROM pr, (SELECT doc_id, 'lib/src/' || doc_id || '.py' AS file_path FROM documents) WHERE file_path = ref OR ends_with(file_path, '/' || ref)) QUALIFY rank <= 20",
    "window_split_lines": r"""WITH l AS (SELECT doc_id, text, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM (SELECT *, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS p FROM documents)),
w AS (SELECT doc_id, p, ceil(greatest(len(p) - 9, 0) / 6)::int + 1 AS parts, unnest(range(0, ceil(greatest(len(p) - 9, 0) / 6)::int + 1)) AS i FROM l WHERE len(p) > 12)
SELECT 'doc' || doc_id AS file_path, 0 AS start_line, len(string_split(text, chr(10)))::int - 1 AS end_line, 'doc' || doc_id AS context_prefix, NULL::varchar AS name, md5(text) AS digest FROM l WHERE len(p) <= 12
UNION ALL SELECT 'doc' || doc_id, (6 * i)::int, (least(6 * i + 9, len(p)) - 1)::int, 'doc' || doc_id || ' > part ' || (i + 1) || '/' || parts, 'part ' || (i + 1) || '/' || parts, md5(array_to_string(p[6 * i + 1:6 * i + 9], chr(10))) FROM w""",
    "ext_language_scan": """WITH p AS (SELECT doc_id, ['src', 'build', 'lib/build.d', 'node_modules/x', 'a/b'][doc_id % 5 + 1] || '/f' || doc_id || ['.py', '.JS', '.md', '.tsx', '.c', '.rb', 'py', '.Scala'][doc_id % 8 + 1] AS file_path, n_chars * 200 AS length FROM documents)
SELECT doc_id, file_path, CASE doc_id % 8 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 3 THEN 'typescript' WHEN 4 THEN 'c' WHEN 5 THEN 'ruby' WHEN 7 THEN 'scala' END AS language FROM p WHERE doc_id % 8 NOT IN (2, 6) AND doc_id % 5 NOT IN (1, 3) AND length <= 500000""",
    "delta_changes": f"WITH {VERSIONS} SELECT * FROM ch WHERE change IS NOT NULL",
    "delta_merge": f"WITH {VERSIONS} SELECT file_path, digest, 0 AS generation FROM ol WHERE file_path NOT IN (SELECT file_path FROM ch WHERE change IS NOT NULL) UNION ALL SELECT file_path, digest, 1 FROM nw WHERE file_path IN (SELECT file_path FROM ch WHERE change IN ('added', 'changed'))",
    "distinct_files": "SELECT replace(source, '\\', '/') AS file_path, count(*)::bigint AS chunks FROM documents WHERE source <> '' GROUP BY 1",
    "history_last6": "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::int AS position FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6)",
    "progress_percent": f"WITH {JOBS}, b AS (SELECT *, CASE phase WHEN 'cloning' THEN 0 WHEN 'chunking' THEN 15 WHEN 'embedding' THEN 35 WHEN 'upserting' THEN 80 ELSE 100 END AS lo, CASE phase WHEN 'cloning' THEN 10 WHEN 'chunking' THEN 35 WHEN 'embedding' THEN 80 WHEN 'upserting' THEN 98 ELSE 100 END AS hi FROM jobs) SELECT event_id, phase, round_even((lo + (hi - lo) * CASE WHEN phase = 'done' OR total = 0 THEN 0::double ELSE least(greatest(current::double / total, 0), 1) END)::double, 0)::int AS percent FROM b",
    "progress_snapshot": f"WITH {JOBS} SELECT user_id, max(event_id) AS event_id, arg_max(phase, event_id) AS phase, arg_max(current, event_id) AS current FROM jobs GROUP BY user_id",
    "progress_throttle": "SELECT event_id, user_id, rn::bigint AS rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE rn % greatest(1, n // 50) = 0 OR rn = n",
    "webhook_join": "SELECT event_id, n_name AS repo_id FROM events JOIN nation ON n_nationkey = user_id % 40 WHERE (event_id % 2 = 0 AND event_id % 3 <> 0) OR (event_id % 2 = 1 AND event_id % 3 = 0)",
    "eval_scores": f"WITH {EVALUATED} SELECT round(avg(faithfulness), 6) AS faithfulness, round(avg(answer_relevancy), 6) AS answer_relevancy, round(avg(context_recall), 6) AS context_recall FROM ev",
    "eval_passed": f"WITH {EVALUATED}, z AS (SELECT qid, coalesce(faithfulness, 0) AS f, coalesce(answer_relevancy, 0) AS r, coalesce(context_recall, 0) AS c FROM ev), o AS (SELECT *, round((f + r + c) / 3, 6) AS overall FROM z) SELECT qid, overall, f > 0.75 AND r > 0.75 AND c > 0.75 AS passed, CASE WHEN overall >= 0.8 THEN 'green' WHEN overall >= 0.6 THEN 'amber' ELSE 'red' END AS band FROM o",
    "ablation_by_strategy": f"WITH {_bm25(DOCS, ASKED)}, {_dense(DOCS, ASKED_TEXT)}, b AS (SELECT 'sparse' AS strategy, qid, id FROM bm25 WHERE rank <= 5 UNION ALL SELECT 'dense', qid, id FROM dense WHERE rank <= 5), s AS (SELECT strategy, qid, string_agg(text, chr(10)) AS seen FROM b JOIN documents ON doc_id = id GROUP BY ALL), r AS (SELECT strategy, {COVER.format(q=_tokens('text'), c=_tokens('seen'))} AS v FROM s JOIN benchmark ON item_id = qid) SELECT strategy, round(avg(v), 6) AS mean, count(v) AS scored, count(*) AS n FROM r GROUP BY strategy",
    "sse_events": """WITH t AS (SELECT conv_id * 1000 + turn AS request_id, conv_id AS session_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM conversations WHERE role = 'assistant'),
e AS (SELECT request_id, list_concat([{'event': 'session_id', 'payload': to_json({'session_id': session_id})::varchar}], list_transform(l, lambda x: {'event': 'answer_chunk', 'payload': to_json({'text': x})::varchar}),
  [{'event': 'citations', 'payload': '{"citations":[]}'}, {'event': 'sources', 'payload': '{"sources":[]}'}, {'event': 'done', 'payload': '[DONE]'}]) AS m FROM t),
u AS (SELECT request_id, unnest(range(0, len(m)))::int AS seq, unnest(m) AS x FROM e)
SELECT request_id, seq, x.event AS event, x.payload AS payload FROM u""",
    "running_answer": "WITH t AS (SELECT conv_id * 1000 + turn AS request_id, text, unnest(range(0, greatest(length(text) - 1, 0) // 40 + 1)) AS i FROM conversations WHERE role = 'assistant') SELECT request_id, i::int AS seq, md5(substring(text, 1, ((i + 1) * 40)::int)) AS digest, (i * 40)::bigint AS length FROM t",
    "generator_messages": """WITH q AS (SELECT conv_id AS qid, arg_max(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY 1),
h AS (SELECT conv_id AS qid, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, role, text FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6)),
n AS (SELECT qid, count(*) AS n FROM h GROUP BY qid)
SELECT qid, 0::int AS position, 'system' AS role, md5('Answer from the context.') AS digest FROM q
UNION ALL SELECT qid, p::int, role, md5(text) FROM h JOIN q USING (qid)
UNION ALL SELECT qid, (n + 1)::int, 'user', md5('Context chunks from the repository:' || chr(10) || '-' || chr(10) || chr(10) || 'Question: ' || question) FROM q JOIN n USING (qid)""",
    "result_sources": f"WITH {_hybrid('single', 5, 20, True)} SELECT qid, (rank - 1)::int AS pos, source || '/doc' || doc_id || '.txt' AS file_path, 0::int AS start_line, (length(text) - length(replace(text, chr(10), '')))::int AS end_line, round(coalesce(rerank_score, fused_score), 6) AS relevance_score FROM res JOIN documents ON doc_id = id",
    "dashboard": f"""WITH {EVALUATED}, z AS (SELECT ev.qid, b.text AS question, length(coalesce(answer, '')) AS answer_length, coalesce(faithfulness, 0) AS f, coalesce(answer_relevancy, 0) AS r, coalesce(context_recall, 0) AS c FROM ev JOIN benchmark b ON b.item_id = ev.qid LEFT JOIN ctx ON ctx.qid = ev.qid),
o AS (SELECT *, (f + r + c) / 3 AS overall, f > 0.75 AND r > 0.75 AND c > 0.75 AS passed FROM z)
SELECT row_number() OVER (ORDER BY passed, answer_length DESC, question)::int AS place, qid, printf('%.1f%%', round(f * 100, 1)) AS faithfulness, printf('%.1f%%', round(r * 100, 1)) AS answer_relevancy, printf('%.1f%%', round(c * 100, 1)) AS context_recall,
  printf('%.1f%%', round(overall * 100, 1)) AS overall, passed, answer_length::bigint AS answer_length FROM o""",
    "file_count": "SELECT count(*) AS files, sum(chunks)::bigint AS chunks FROM (SELECT count(*) AS chunks FROM documents WHERE source <> '' GROUP BY replace(source, '\\', '/'))",
    "chunk_sources": """WITH d AS (SELECT doc_id AS n, 'f' || doc_id || '.py' AS f, doc_id % 120 + 1 AS k FROM documents WHERE text IS NOT NULL),
l AS (SELECT *, list_concat(['def last' || n || '():'], list_transform(range(0, k), lambda x: '    y = 1')) AS ls FROM d),
v AS (SELECT *, unnest(range(0, parts)) AS i FROM (SELECT *, ceil(greatest(k - 59, 0) / 45)::int + 1 AS parts FROM l WHERE k + 1 > 80))
SELECT f AS file_path, 'class' AS chunk_type, 'D' || n AS name, 0::int AS start_line, 5::int AS end_line, f || ' > D' || n AS context_prefix, md5('class D' || n || ':' || chr(10) || '    x = 1' || chr(10) || '    def first(self):' || chr(10) || '        a = 1' || chr(10) || '        return a' || chr(10) || '    def small(self): return 2') AS digest FROM d
UNION ALL SELECT f, 'function', 'first', 2, 4, f || ' > D' || n || ' > first', md5('def first(self):' || chr(10) || '        a = 1' || chr(10) || '        return a') FROM d
UNION ALL SELECT f, 'function', 'last' || n, 7, (7 + k)::int, f || ' > last' || n, md5(array_to_string(ls, chr(10))) FROM l WHERE k >= 2 AND k + 1 <= 80
UNION ALL SELECT f, 'function', 'last' || n || ' (part ' || (i + 1) || '/' || parts || ')', (7 + 45 * i)::int, (6 + least(45 * i + 60, k + 1))::int, f || ' > last' || n || ' > part ' || (i + 1) || '/' || parts, md5(array_to_string(ls[45 * i + 1:45 * i + 60], chr(10))) FROM v""",
    "unregistered": "SELECT o_custkey, count(*) AS orders FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0) GROUP BY o_custkey",
    "progress_replay": f"""WITH {JOBS}, e AS (SELECT user_id::varchar AS repo_id, phase, current AS percent, event_id AS ts FROM jobs WHERE phase <> 'done' OR event_id % 7 = 0),
s AS (SELECT *, max(CASE WHEN ts <= 3000 THEN ts END) OVER (PARTITION BY repo_id) AS last FROM e), n AS (SELECT * FROM s WHERE ts > 3000 OR (ts = last AND ts >= 1000)),
z AS (SELECT *, max((phase IN ('done', 'error'))::int) OVER (PARTITION BY repo_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM n)
SELECT repo_id, phase, percent, ts FROM z WHERE coalesce(ended, 0) = 0""",
    "answer_decode": "SELECT conv_id * 1000 + turn AS request_id, text AS answer FROM conversations WHERE role = 'assistant'",
    "context_prompt": f"WITH {_bm25(DOCS, ASKED)} SELECT qid, md5(string_agg('File: ' || source || '/doc' || doc_id || '.txt (line 0)' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS digest FROM bm25 JOIN documents ON doc_id = id WHERE rank <= 2 GROUP BY qid",
    "hosts": "SELECT regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, count(*)::bigint AS pages FROM pages GROUP BY 1",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= timestamp '1998-09-02' GROUP BY ALL",
    "events_by_hour": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
