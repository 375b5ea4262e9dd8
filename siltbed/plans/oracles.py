"""DuckDB SQL of the queries, built from fragments. Texts of the tables are Latin, so the normal form needs no compatibility step."""

from __future__ import annotations

from siltbed.plans.batch import MARKDOWN_FILE, PLANTED, RAW_ANSWER, STREAM_EVENT


def _norm(x):
    return rf"replace(lower(trim(regexp_replace({x}, '[\x09-\x0d\x1c-\x20]+', ' ', 'g'))), 'ß', 'ss')"


_ALIAS = "CASE {0} WHEN 'node' THEN 'nodejs' WHEN 'node.js' THEN 'nodejs' WHEN 'next' THEN 'nextjs' WHEN 'next.js' THEN 'nextjs' WHEN 'postgres' THEN 'postgresql' ELSE {0} END"
_EDGES = "؟?!.,،؛:«»()[]{}\"''"
_ENTITIES = "['django','docker','hnsw','ivfflat','kubernetes','laravel','mongodb','mssql','mysql','nextjs','nodejs','pgvector','php','postgis','postgresql','python','redis']"


def _first(x):
    """Distinct elements in order of first occurrence."""
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def _raw_terms(x):
    t = f"trim(t, '{_EDGES}')"
    return rf"list_filter(list_transform(regexp_extract_all({_norm(x)}, '[\p{{L}}\p{{N}}_\x{{0600}}-\x{{06ff}}.+#-]+'), lambda t: {_ALIAS.format(t)}), lambda t: length(t) > 1)"


def _grams(x):
    w = rf"list_distinct(regexp_extract_all({x}, '[\p{{L}}\p{{N}}]+'))"
    return f"list_distinct(flatten(list_transform({w}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


_TOKEN = r"""greatest(1, len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_\x{{0600}}-\x{{06ff}}]+|[^\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]')), (length({0}) + 3) // 4)"""

text_normalize = f"SELECT doc_id, {_norm('text')} AS normal FROM documents"
token_count = f"SELECT doc_id, CAST({_TOKEN.format('text')} AS BIGINT) AS tokens, CAST(length(text) AS BIGINT) AS chars FROM documents"
retrieval_terms = f"WITH t AS (SELECT item_id, {_raw_terms('text')} AS r FROM benchmark) SELECT item_id, array_to_string({_first('r')}, '|') AS terms FROM t"
search_query_text = f"""WITH t AS (SELECT item_id, {_norm('text')} AS n, {_raw_terms('text')} AS r FROM benchmark), u AS (SELECT item_id, n, {_first('r')} AS terms FROM t)
SELECT item_id, CASE WHEN len(terms) > 0 THEN array_to_string(terms, ' ') ELSE n END AS query, CASE WHEN len(terms) > 0 THEN array_to_string(terms, ' OR ') ELSE n END AS any_query FROM u"""
term_frequency = rf"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all({_norm('text')}, '[\p{{L}}\p{{N}}_\x{{0600}}-\x{{06ff}}]+')) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM w GROUP BY term"""
text_pieces = "WITH p AS (SELECT doc_id, text, unnest(range(0, length(text), 120)) AS pos FROM documents) SELECT doc_id, pos // 120 AS k, substring(text, pos + 1, 120) AS piece FROM p"

_ENV = r"""(\b([A-Z][A-Z0-9_]*(?:PASSWORD|PASS|TOKEN|SECRET|API_KEY))\s*=\s*["'']?)([^\s"'']+)(["'']?)"""
_BEARER = r"(?i)(\b(?:Authorization:\s*)?Bearer\s+)([A-Za-z0-9._~-]{12,})"
_DSN = r"(?i)(\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis)://[^\s:/@]+:)([^\s@/]+)(@)"
_DATA = r"(?i)data:(?:image|audio|video)/[a-z0-9.+-]+;base64,[a-z0-9+/=_-]{1000}[a-z0-9+/=_-]{24}"

_DATA_URL = r"(?i)(data:(?:image|audio|video)/[a-z0-9.+-]+;base64,)[a-z0-9+/=_-]{1000}[a-z0-9+/=_-]{24}[a-z0-9+/=_-]*"


def _redacted(source, key):
    return f"""r1 AS (SELECT *, regexp_replace(text, '{_ENV}', '\\1<YOUR_\\2>\\4', 'g') AS t1 FROM {source}),
r2 AS (SELECT *, regexp_replace(t1, '{_BEARER}', '\\1<YOUR_TOKEN>', 'g') AS t2 FROM r1),
r3 AS (SELECT *, regexp_replace(t2, '{_DSN}', '\\1<YOUR_PASSWORD>\\3', 'g') AS t3 FROM r2),
r AS (SELECT {key}, t3 AS safe, CAST(len(regexp_extract_all(text, '{_ENV}')) AS INTEGER) AS environment_value, CAST(len(regexp_extract_all(t1, '{_BEARER}')) AS INTEGER) AS bearer_token,
  CAST(len(regexp_extract_all(t2, '{_DSN}')) AS INTEGER) AS connection_password, CAST(len(regexp_extract_all(t3, '{_DATA}')) AS INTEGER) AS embedded_data_url FROM r3)"""


redact_inline = f"WITH {_redacted(f'(SELECT doc_id, text || {PLANTED} AS text FROM documents)', 'doc_id')} SELECT doc_id, md5(regexp_replace(safe, '{_DATA_URL}', '\\1<REDACTED_EMBEDDED_ASSET>', 'g')) AS safe_hash, environment_value, bearer_token, connection_password, embedded_data_url FROM r"
redaction_totals = f"WITH {_redacted(f'(SELECT lang, text || {PLANTED} AS text FROM documents)', 'lang')} SELECT lang, CAST(sum(environment_value) AS BIGINT) AS environment_value, CAST(sum(bearer_token) AS BIGINT) AS bearer_token, CAST(sum(connection_password) AS BIGINT) AS connection_password, CAST(sum(embedded_data_url) AS BIGINT) AS embedded_data_url FROM r GROUP BY lang"
embedding_input_text = "SELECT doc_id, sha256(concat_ws(chr(10), CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END, lang, text)) AS input_hash FROM documents"

doc_identity = "SELECT doc_id, substr(sha256(source || '/' || doc_id), 1, 24) AS stable_id, sha256(text) AS content_hash FROM documents"
duplicate_occurrence = "SELECT doc_id, lang, sha256(text) AS content_hash, row_number() OVER (PARTITION BY lang, sha256(text) ORDER BY doc_id) - 1 AS occurrence FROM documents"
manifest_hash = "WITH p AS (SELECT source || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, sha256(text) AS h FROM documents) SELECT sha256(string_agg(path || h, '' ORDER BY string_split(path, '/'))) AS manifest_hash, count(*) AS documents FROM p"
snapshot_report = "SELECT count(*) AS discovered, count(*) FILTER (length(text) >= 100) AS documents, count(*) FILTER (length(text) < 100) AS skipped, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents"
pending_embeddings = "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"
embedding_validation = "SELECT vec_id FROM embeddings WHERE len(CASE WHEN vec_id % 7 = 0 THEN embedding[1:63] ELSE embedding END) <> 64 OR len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0"
embedding_batches = "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch, (row_number() OVER (ORDER BY doc_id) - 1) % 16 AS place FROM documents"
version_activation = """WITH v AS (SELECT DISTINCT lang AS id, lang = (SELECT min(lang) FROM documents) AS first FROM documents),
c AS (SELECT lang, bool_or(vec_id IS NULL AND lang <> 'es') AS lacks FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1),
t AS (SELECT tried, coalesce((SELECT lacks FROM c WHERE lang = tried), false) AS refused FROM (VALUES ('en'), ('es')) x(tried))
SELECT id, CASE WHEN NOT refused AND id = tried THEN 'active' WHEN first AND refused THEN 'active' WHEN first THEN 'indexed' ELSE 'embedded' END AS status,
  CASE WHEN NOT refused AND id = tried THEN '2026-02-01' WHEN refused AND first THEN '2026-01-01' END AS activated_at, CASE WHEN refused THEN 'missing embeddings' END AS refused, tried FROM v, t"""
constraint_violations = """SELECT 'duplicate document' AS rule, count(*) AS violations FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'duplicate content', count(*) FROM (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'label without document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'bad status', count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F', 'P')
UNION ALL SELECT 'not positive', count(*) FROM documents WHERE length(text) <= 0"""
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)"
url_allowlist = f"SELECT page_id, lower({_HOST}) AS host, starts_with(url, 'https:') AND lower({_HOST}) = 'ththre.example.com' AS allowed FROM pages"
url_hosts = f"SELECT lower({_HOST}) AS host, count(*) AS pages, count(*) FILTER (starts_with(url, 'https:')) AS secure FROM pages GROUP BY 1"
_LEX = f"""q AS (SELECT item_id AS query_id, text, {_norm('text')} AS n, {_raw_terms('text')} AS r FROM benchmark),
qq AS (SELECT query_id, {_first('r')} AS terms, {_grams("CASE WHEN len(r) > 0 THEN array_to_string(" + _first('r') + ", ' ') ELSE n END")} AS grams FROM q),
c AS (SELECT doc_id AS chunk_id, {_norm('text')} AS n FROM documents),
p AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(n, '[\\p{{L}}\\p{{N}}_\\x{{0600}}-\\x{{06ff}}]+')) AS term FROM c) GROUP BY 1, 2),
h AS (SELECT query_id, chunk_id, sum(tf) AS hits FROM (SELECT query_id, unnest(terms) AS term FROM qq) JOIN p USING (term) GROUP BY 1, 2),
g AS (SELECT chunk_id, unnest({_grams('n')}) AS gram FROM c), s AS (SELECT chunk_id, count(*) AS size FROM g GROUP BY 1),
b AS (SELECT query_id, chunk_id, q_size, count(*) AS both_have FROM (SELECT query_id, len(grams) AS q_size, unnest(grams) AS gram FROM qq) JOIN g USING (gram) GROUP BY 1, 2, 3),
a AS (SELECT query_id, chunk_id, both_have / (q_size + size - both_have) AS similarity FROM b JOIN s USING (chunk_id)),
lex AS (SELECT coalesce(a.query_id, h.query_id) AS query_id, coalesce(a.chunk_id, h.chunk_id) AS chunk_id, CAST(coalesce(hits, 0) AS BIGINT) AS tf_hits, coalesce(similarity, 0) AS similarity
  FROM a FULL JOIN h ON a.query_id = h.query_id AND a.chunk_id = h.chunk_id WHERE coalesce(hits, 0) > 0 OR coalesce(similarity, 0) > 0.03),
lx AS (SELECT *, round(0.1 * tf_hits + 0.3 * similarity, 9) AS lexical_score FROM lex),
lr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, chunk_id) AS rank FROM lx QUALIFY rank <= 30)"""
trigram_similarity = f"WITH {_LEX} SELECT query_id, chunk_id, tf_hits, round(similarity, 9) AS similarity FROM lex"
lexical_topk = f"WITH {_LEX} SELECT query_id, rank, chunk_id, lexical_score FROM lr"
_VEC = """qv AS (SELECT item_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM benchmark JOIN embeddings ON vec_id = item_id),
cv AS (SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings JOIN documents ON doc_id = vec_id),
vs AS (SELECT query_id, chunk_id, round(list_cosine_similarity(qv.e, cv.e), 9) AS vector_score FROM qv CROSS JOIN cv),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, chunk_id) AS rank FROM vs QUALIFY rank <= 30)"""
vector_topk = f"WITH {_VEC} SELECT query_id, rank, chunk_id, vector_score FROM vr"
vector_label_agreement = f"""WITH {_VEC.replace('FROM embeddings JOIN documents ON doc_id = vec_id', 'FROM embeddings').replace('<= 30', '<= 10')}
SELECT query_id, round(avg(CASE WHEN x.label = y.label THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM vr JOIN embeddings x ON x.vec_id = chunk_id JOIN embeddings y ON y.vec_id = query_id GROUP BY 1"""
_RRF = """u AS (SELECT query_id, chunk_id, 0 AS list, rank FROM lr UNION ALL SELECT query_id, chunk_id, 1, rank FROM vr),
f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused_score, min(list * 1000000 + rank) AS seen FROM u GROUP BY 1, 2),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, seen) AS position FROM f)"""
rrf_fusion = f"WITH {_LEX}, {_VEC}, {_RRF} SELECT query_id, position, chunk_id, fused_score FROM fr"
_SHARE = "len(list_intersect(x.terms, {0})) / greatest(1, len(x.terms))"
_RERANK = f"""d AS (SELECT doc_id AS chunk_id, source, lang, {_raw_terms("array_to_string(string_split(text, ' ')[1:5], ' ')")} AS t, {_raw_terms('lang')} AS h, {_raw_terms('text')} AS c FROM documents WHERE doc_id IN (SELECT chunk_id FROM f)),
rr AS (SELECT fr.query_id, fr.chunk_id, source, lang, position, round(fused_score + 0.04 * len(list_intersect(list_intersect(x.terms, {_ENTITIES}), list_concat(list_concat(t, h), c))) / greatest(1, len(list_intersect(x.terms, {_ENTITIES})))
   + 0.012 * {_SHARE.format('t')} + 0.008 * {_SHARE.format('h')} + 0.004 * {_SHARE.format('c')}, 9) AS rerank_score FROM fr JOIN qq x USING (query_id) JOIN d ON d.chunk_id = fr.chunk_id),
rp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, position) AS place0 FROM rr),
rd AS (SELECT * FROM rp QUALIFY row_number() OVER (PARTITION BY query_id, source, lang ORDER BY place0) = 1),
hy AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place0) AS place FROM rd QUALIFY place <= 30)"""
_HYBRID = f"WITH {_LEX}, {_VEC}, {_RRF}, {_RERANK}"
hybrid_retrieve = f"{_HYBRID} SELECT query_id, place, chunk_id, rerank_score FROM hy"
evidence_budget = f"""WITH p AS (SELECT source AS query_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place, doc_id, {_TOKEN.format('text')} AS tokens FROM documents),
s AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY place) AS used FROM p WHERE place <= 6) SELECT query_id, place, doc_id, CAST(used AS BIGINT) AS used FROM s WHERE place = 1 OR used <= 2000"""
evidence_decision = f"""{_HYBRID}, ev AS (SELECT hy.*, {_TOKEN.format('text')} AS tokens, {_raw_terms("array_to_string(string_split(text, ' ')[1:5], ' ') || ' ' || hy.lang || ' ' || text")} AS terms FROM hy JOIN documents ON doc_id = chunk_id WHERE place <= 6),
es AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY place) AS used FROM ev), et AS (SELECT * FROM es WHERE place = 1 OR used <= 5000),
eg AS (SELECT query_id, flatten(list(terms)) AS terms, max(CASE WHEN place = 1 THEN rerank_score END) AS top FROM et GROUP BY 1),
em AS (SELECT qq.query_id, top, round(len(list_intersect(qq.terms, coalesce(eg.terms, []))) / greatest(1, len(qq.terms)), 9) AS query_coverage,
  len(list_intersect(qq.terms, {_ENTITIES})) - len(list_intersect(list_intersect(qq.terms, {_ENTITIES}), coalesce(eg.terms, []))) AS missing FROM qq LEFT JOIN eg USING (query_id)),
ej AS (SELECT *, CASE WHEN top IS NULL THEN 'no_results' WHEN top < 0.025 THEN 'low_relevance' WHEN missing > 0 THEN 'missing_entity_coverage' WHEN query_coverage < 0.35 THEN 'insufficient_query_coverage' ELSE 'sufficient' END AS reason FROM em)
SELECT query_id, reason, reason = 'sufficient' AS sufficient, query_coverage FROM ej"""

_N = _norm("text")
_SCOPE = f"""sc AS (SELECT *, {_N} AS n FROM conversations WHERE role = 'user'),
sk AS (SELECT *, contains(n, 'tion') OR len(list_filter(['deploy','postgresql','mysql','redis','dns','object storage','docker'], lambda m: contains(n, m))) > 0 AS known, contains(n, 'ther') AS outside,
  CASE WHEN contains(n, 'error') OR contains(n, 'eren') THEN 'troubleshoot' WHEN contains(n, 'deploy') OR contains(n, 'ingand') THEN 'deploy' WHEN contains(n, 'better') OR contains(n, 'anre') THEN 'compare' END AS word FROM sc),
si AS (SELECT *, known OR NOT outside AS in_scope, CASE WHEN NOT known AND outside THEN 'out_of_scope' ELSE coalesce(word, 'explain') END AS intent,
  CASE WHEN NOT known AND outside THEN 'explicit_other_topic' WHEN word IS NOT NULL THEN 'intent_keyword' WHEN known THEN 'domain_keyword' ELSE 'domain_unverified' END AS reason FROM sk)"""
scope_intent = f"WITH {_SCOPE} SELECT conv_id, turn, in_scope, intent, reason FROM si"
model_route = f"""WITH {_SCOPE}, l AS (SELECT conv_id, turn, intent IN ('troubleshoot', 'compare') OR turn % 4 > 2 OR length(text) > 600 OR conv_id % 11 = 0 AS large FROM si)
SELECT conv_id, turn, CASE WHEN large THEN 'large' ELSE 'small' END AS tier, CASE WHEN large THEN 'complex_grounded' ELSE 'simple_grounded' END AS reason, CAST(CASE WHEN large THEN 1200 ELSE 700 END AS BIGINT) AS max_output_tokens FROM l"""
_TURNS = "t AS (SELECT conv_id AS session, turn, role, text, CASE WHEN role = 'assistant' AND turn % 4 = 3 THEN 'clarification:low_relevance' WHEN role = 'assistant' THEN 'answered' END AS outcome FROM conversations)"
prev_assistant_turn = f"""WITH {_TURNS}, x AS (SELECT *, (SELECT max(turn) FROM t a WHERE a.session = t.session AND a.turn < t.turn AND a.role = 'assistant') AS before FROM t)
SELECT x.session, x.turn, p.turn AS previous_turn, md5(p.text) AS previous_hash FROM x LEFT JOIN t p ON p.session = x.session AND p.turn = x.before"""
_FOLLOW = f"""{_TURNS}, w AS (SELECT *, {_raw_terms('text')} AS r, replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss') AS plain FROM t),
z AS (SELECT *, {_first('r')} AS terms, list_intersect(r, ['the','and','of','de']) AS topics FROM w),
y AS (SELECT *, (SELECT count(*) FROM z b WHERE b.session = z.session AND b.turn < z.turn) AS before, (SELECT arg_max(outcome, turn) FROM z b WHERE b.session = z.session AND b.turn < z.turn AND role = 'assistant') AS last_outcome,
  row_number() OVER (PARTITION BY session ORDER BY turn) AS k FROM z),
v AS (SELECT *, (SELECT flatten(list(topics)) FROM y b WHERE b.session = y.session AND b.k < y.k AND b.k >= y.k - 12 AND role = 'user') AS recent FROM y),
fu AS (SELECT *, before > 0 AND (coalesce(starts_with(last_outcome, 'clarification:'), false) OR (NOT (len(topics) > 0 AND len(coalesce(recent, [])) > 0 AND len(list_intersect(topics, coalesce(recent, []))) = 0) AND (len(terms) <= 4 OR starts_with(plain, 'the ') OR starts_with(plain, 'is ')))) AS follow_up FROM v WHERE role = 'user')"""
follow_up_flag = f"WITH {_FOLLOW} SELECT session, turn, follow_up FROM fu"
retrieval_rewrite = f"""WITH {_FOLLOW}, rc AS (SELECT fu.session, fu.turn, fu.text, fu.terms, follow_up, (SELECT list(b.text ORDER BY b.turn DESC) FROM v b WHERE b.session = fu.session AND b.k < fu.k AND b.k >= fu.k - 12 AND b.role = 'user') AS recent,
  (SELECT arg_max(b.text, b.turn) FROM v b WHERE b.session = fu.session AND b.k < fu.k AND b.k >= fu.k - 12 AND b.role = 'user' AND len(b.terms) >= 5) AS substantive,
  (SELECT flatten(list(list_filter(b.terms, lambda e: list_contains(['the','and','of','de'], e)) ORDER BY b.turn DESC)) FROM v b WHERE b.session = fu.session AND b.k < fu.k AND b.k >= fu.k - 12 AND b.role = 'user') AS found FROM fu),
rx AS (SELECT *, list_filter(found, lambda e, i: list_position(found, e) = i AND NOT list_contains(terms, e)) AS extra FROM rc),
rq AS (SELECT session, turn, CASE WHEN follow_up AND len(coalesce(recent, [])) > 0 THEN left(concat_ws(' ', text, left(substantive, 500), nullif(array_to_string(extra[1:4], ' '), '')), 800) ELSE text END AS query FROM rx)
SELECT session, turn, md5(query) AS query_hash, CAST(length(query) AS BIGINT) AS n FROM rq"""
_FAIL = "(contains(replace(lower(text), 'ß', 'ss'), 'the ') OR contains(replace(lower(text), 'ß', 'ss'), 'de '))"
issue_failures = f"""WITH {_TURNS}, m AS (SELECT *, {_FAIL} AS failed FROM t), i AS (SELECT *, coalesce((SELECT arg_max(text, turn) FROM m b WHERE b.session = m.session AND b.turn < m.turn AND role = 'user' AND NOT failed), text) AS issue FROM m WHERE role = 'user' AND failed),
k AS (SELECT session, turn, substr(sha256(issue), 1, 20) AS issue_key FROM i), l AS (SELECT *, CASE WHEN lag(issue_key) OVER (PARTITION BY session ORDER BY turn) = issue_key THEN 0 ELSE 1 END AS fresh FROM k),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY turn) AS run FROM l) SELECT session, turn, issue_key, least(20, row_number() OVER (PARTITION BY session, run ORDER BY turn)) AS failure_count FROM s"""
history_compaction = f"""WITH {_TURNS}, p AS (SELECT *, count(*) OVER (PARTITION BY session) AS n, row_number() OVER (PARTITION BY session ORDER BY turn DESC) AS back FROM t), q AS (SELECT *, n > 4 AND back > 4 AS dropped FROM p)
SELECT session, md5(right(coalesce(string_agg(left(text, 500), chr(10) ORDER BY turn) FILTER (dropped AND role = 'user'), ''), 4000)) AS summary_hash, least(count(*) FILTER (NOT dropped), 12) AS kept FROM q GROUP BY session"""
context_fill = f"""WITH {_TURNS}, b AS (SELECT session, turn, '<TURN role=' || role || '>' || chr(10) || text || chr(10) || '</TURN>' AS block FROM t), u AS (SELECT *, sum(length(block)) OVER (PARTITION BY session ORDER BY turn DESC) AS used FROM b)
SELECT session, md5(string_agg(block, chr(10) ORDER BY turn)) AS context_hash, count(*) AS turns FROM u WHERE used <= 1500 GROUP BY session"""
latest_user_message = "SELECT conv_id AS session, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1"

rate_limit_two_level = """WITH m AS (SELECT event_id, user_id, ts, epoch_us(ts) // 1000000 AS s, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 60000000 ORDER BY ts, event_id) AS in_minute FROM events),
h AS (SELECT *, sum(CASE WHEN in_minute <= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, s // 3600 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS in_hour FROM m)
SELECT event_id, CASE WHEN in_minute > 1 THEN 'minute' WHEN in_hour > 2 THEN 'hour' ELSE 'ok' END AS verdict, CASE WHEN in_minute > 1 THEN 60 - s % 60 WHEN in_hour > 2 THEN 3600 - s % 3600 ELSE 0 END AS retry_after FROM h"""
rate_limit_minute = "SELECT user_id, epoch_us(ts) // 60000000 AS minute, count(*) AS calls FROM events GROUP BY 1, 2 HAVING count(*) > 1"
session_windows = """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 7200000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(epoch_us(ts)) AS started, max(epoch_us(ts)) AS ended, count(*) AS events FROM s GROUP BY user_id, k"""
idempotent_messages = "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1"
circuit_breaker_runs = """WITH r AS (SELECT user_id, event_type = 'error' AS failed, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
f AS (SELECT user_id, run, count(*) AS failures FROM r WHERE failed GROUP BY 1, 2) SELECT user_id, count(*) AS runs, max(failures) AS longest, count(*) FILTER (failures >= 3) AS opened FROM f GROUP BY 1"""
provider_failover_first_success = "SELECT event_id // 5 AS request, arg_min('p' || (event_id % 5), event_id % 5) FILTER (event_type <> 'error') AS target, count(*) AS attempts FROM events GROUP BY 1"
status_classes = """WITH s AS (SELECT [200, 401, 408, 429, 503, 404, 403][event_id % 7 + 1] AS status FROM events)
SELECT CASE WHEN status IN (401, 403) THEN 'authentication' WHEN status = 408 THEN 'timeout' WHEN status = 429 THEN 'rate_limited' WHEN status >= 500 THEN 'unavailable' WHEN status >= 400 THEN 'bad_request' ELSE 'ok' END AS class, count(*) AS calls FROM s GROUP BY 1"""
metrics_counters = "SELECT event_type, count(*) AS events, CAST(round(sum(CAST(value AS DECIMAL(18, 4))), 2) AS DOUBLE) AS total FROM events GROUP BY 1"
metrics_exposition = """WITH c AS (SELECT 'day="' || (dayofweek(ts) + 1) || '",type="' || event_type || '"' AS labels, count(*) AS n FROM events GROUP BY 1)
SELECT 'requests_total{' || labels || '} ' || n AS line, CAST(1 AS BIGINT) AS part, labels FROM c UNION ALL SELECT '# TYPE requests_total counter', 0, min(labels) FROM c"""
p95_by_index = "SELECT event_type, round(list_sort(list(value))[CAST(greatest(1, floor(count(*) * 0.95)) AS BIGINT)], 6) AS p95, count(*) AS n FROM events GROUP BY 1"
cost_estimate = f"""WITH t AS (SELECT conv_id, turn, length(text) > 300 AS large, {_TOKEN.format('text')} AS n FROM conversations)
SELECT conv_id, turn, round((n * CASE WHEN large THEN 2.5::DOUBLE ELSE 0.15::DOUBLE END + n * 2 * CASE WHEN large THEN 10.0::DOUBLE ELSE 0.6::DOUBLE END) / 1000000, 8) AS cost FROM t"""

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_FENCE = r", '(?i)^```(?:json)?\s*|\s*```$', '', 'g')"
answer_validate = rf"""WITH r AS (SELECT doc_id AS answer_id, {RAW_ANSWER} AS raw, [substr(md5(text), 1, 4), substr(md5(text), 5, 4)] AS allowed FROM documents),
f AS (SELECT *, {_STRIP.format("regexp_replace(" + _STRIP.format("raw") + _FENCE)} AS t FROM r),
j AS (SELECT *, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM f),
p AS (SELECT *, json_extract(j, '$.claims[*]') AS cl, json_extract_string(j, '$.answer_markdown') AS am, CASE WHEN json_type(j, '$.suggestions') = 'ARRAY' THEN json_extract(j, '$.suggestions[*]') ELSE [] END AS su FROM j),
q AS (SELECT *, coalesce(json_type(j) = 'OBJECT' AND json_type(j, '$.answer_markdown') = 'VARCHAR' AND length(am) BETWEEN 1 AND 20000 AND json_type(j, '$.claims') = 'ARRAY' AND len(cl) BETWEEN 1 AND 30
  AND len(list_filter(cl, lambda c: NOT coalesce(json_type(c, '$.text') = 'VARCHAR' AND length(json_extract_string(c, '$.text')) BETWEEN 1 AND 2000 AND json_type(c, '$.source_ids') = 'ARRAY' AND json_array_length(c, '$.source_ids') BETWEEN 1 AND 8, false))) = 0
  AND (json_type(j, '$.suggestions') IS NULL OR (json_type(j, '$.suggestions') = 'ARRAY' AND len(su) <= 3 AND len(list_filter(su, lambda x: json_type(x) <> 'VARCHAR')) = 0))
  AND json_type(j, '$.outcome') = 'VARCHAR' AND json_extract_string(j, '$.outcome') = 'answered', false) AS well,
  json_extract_string(j, '$.claims[*].source_ids[*]') AS cited FROM p),
v AS (SELECT *, CASE WHEN NOT well THEN 'invalid' WHEN len(list_filter(cited, lambda x: NOT list_contains(allowed, x))) > 0 THEN 'unknown_source' WHEN regexp_matches(am, '(?i)https?://\S') THEN 'url' WHEN contains(replace(am, 'ك', 'ک'), 'اطلاعات کافی') THEN 'abstained' ELSE 'valid' END AS verdict FROM q),
h AS (SELECT *, list_filter(list_transform(su, lambda x: {_STRIP.format("json_extract_string(x, '$')")}), lambda x: x <> '') AS hints FROM v)
SELECT answer_id, verdict, CASE WHEN verdict = 'valid' THEN array_to_string({_first("cited")}, ',') END AS source_ids, CASE WHEN verdict = 'valid' THEN array_to_string({_first("hints")}, ',') END AS suggestions FROM h"""
cache_keys = f"""SELECT conv_id, turn, 'response-cache:grounding-v2-adaptive-audience:' || sha256('{{"corpus_versions":["v1","v2"],"intent":"explain","locale":"en","policy":"grounding-v2-adaptive-audience","query":"' || {_norm("regexp_replace(text, '[" + '"' + "\\\\/]', ' ', 'g')")} || '"}}') AS cache_key FROM conversations WHERE role = 'user'"""
_EVENT = """'event: ' || event_type || chr(10) || 'data: {"id":' || event_id || CASE WHEN event_type = 'error' THEN ',"code":"failed"' ELSE '' END || ',"type":"' || event_type || '"}' || chr(10) || chr(10)"""
sse_encode = f"SELECT event_id, {_EVENT} AS event FROM events"
sse_parse = "SELECT event_id // 10 AS stream, row_number() OVER (PARTITION BY event_id // 10 ORDER BY event_id) - 1 AS place, event_id AS id, CASE WHEN event_type = 'error' THEN 'failed' END AS code, event_type AS type FROM events"
source_cards = r"SELECT doc_id, 'https://docs.example.com/' || source AS url, lang || ' > ' || source AS section, substring(trim(regexp_replace(text, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}]+', ' ', 'g')), 1, 280) AS snippet FROM documents WHERE doc_id % 4 <> 0"
prompt_tokens = "SELECT conv_id AS session, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens FROM conversations GROUP BY 1"
_EVAL = f"""{_HYBRID}, ex AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark b JOIN documents d2 ON b.text = d2.text), en AS (SELECT query_id, count(*) AS expected FROM ex GROUP BY 1),
ef AS (SELECT query_id, min(place) AS best, count(*) AS found FROM hy JOIN ex USING (query_id, chunk_id) GROUP BY 1),
er AS (SELECT en.query_id, coalesce(found, 0) AS found, coalesce(round(1.0::DOUBLE / best, 9), 0) AS rr FROM en LEFT JOIN ef USING (query_id)),
e AS (SELECT count(*) AS queries, round(avg(CASE WHEN found > 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS recall, round(avg(rr), 9) AS mrr FROM er)"""
eval_recall_mrr = f"{_EVAL} SELECT queries, recall, mrr FROM e"
eval_gate = f"{_EVAL} SELECT queries, recall >= 0.9 AND mrr >= 0.75 AS passed FROM e"
eval_label_accuracy = "SELECT lang, count(*) AS n, round(avg(CASE WHEN CAST(length(text) >= 200 AS INTEGER) = quality THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy FROM labels LEFT JOIN documents USING (doc_id) GROUP BY 1"
star_join_active = """SELECT n_name, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18, 4)) * (1 - CAST(l_discount AS DECIMAL(6, 4)))), 2) AS DOUBLE) AS revenue, count(*) AS lines
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE r_name = 'EUROPE' OR r_regionkey = 3 GROUP BY 1"""
exists_orders = "SELECT o_orderpriority, count(*) AS orders FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1"
missing_children_anti = "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 200000)"
topk_tiebreak = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_quantity DESC, l_orderkey, l_linenumber LIMIT 30"
case_status = "SELECT CASE WHEN o_orderstatus = 'F' THEN 'indexed' WHEN o_totalprice > 200000 THEN 'active' ELSE lower(o_orderstatus) END AS status, count(*) AS orders FROM orders GROUP BY 1"
stream_counters = "SELECT event_type, count(*) AS events FROM events GROUP BY 1"
stream_rate_limit = "SELECT user_id, epoch_us(ts) // 3600000000 * 3600000000 AS start, count(*) AS calls, greatest(count(*) - 1, 0) AS rejected FROM events GROUP BY 1, 2"
stream_sessions = """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 7200000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(epoch_us(ts)) AS started, max(epoch_us(ts)) + 7200000000 AS ended, count(*) AS events FROM s GROUP BY user_id, k"""
_ACTIVE = _LEX.replace("AS n FROM documents)", "AS n FROM documents WHERE doc_id % 3 = 1)")
active_version_topk = f"WITH {_ACTIVE} SELECT query_id, rank, chunk_id, lexical_score, d.source AS title, 'https://docs.example.com/' || chunk_id AS canonical_url FROM lr JOIN documents d ON d.doc_id = lr.chunk_id WHERE rank <= 10"
turn_outcomes = """WITH k AS (SELECT conv_id AS session, turn, (conv_id * 31 + turn * 7) % 101 AS k FROM conversations WHERE role = 'user'),
f AS (SELECT *, ['domain_unverified', 'domain_keyword'][k % 5 % 2 + 1] AS sr, ['no_results', 'low_relevance', 'contradictory_sources'][k % 6 % 3 + 1] AS er, ['hit', 'miss', 'bypass', 'invalid'][k % 7 % 4 + 1] AS cache,
  ['valid', 'invalid', 'abstained', 'failed', 'unknown_source'][k % 10 % 5 + 1] AS one, ['valid', 'failed', 'url'][k % 9 % 3 + 1] AS two, k % 8 < 3 AS fb, k % 3 = 0 AS poor FROM k),
o AS (SELECT session, turn, CASE WHEN k % 13 = 0 THEN ['out_of_scope', sr, NULL] WHEN k % 4 >= 2 THEN ['support', 'repeated_failure', NULL] WHEN k % 11 = 0 THEN ['support', 'support_continuation', NULL]
  WHEN poor AND k % 17 = 0 THEN ['support', er, NULL] WHEN poor AND sr = 'domain_unverified' AND k % 2 = 1 THEN ['out_of_scope', sr, NULL] WHEN poor AND k % 5 > 1 THEN ['clarification', er, NULL] WHEN poor THEN ['support', er, NULL]
  WHEN cache = 'hit' THEN ['answered', NULL, 'cache'] WHEN k * 100 > 9000 THEN ['support', 'token_budget_exceeded', NULL] WHEN one = 'valid' THEN ['answered', NULL, 'model']
  WHEN one = 'failed' OR (one NOT IN ('abstained') AND two = 'failed') THEN CASE WHEN fb THEN ['answered', NULL, 'extractive_fallback'] ELSE ['error', 'provider_failed', NULL] END
  WHEN one <> 'abstained' AND two = 'valid' THEN ['answered', NULL, 'repair'] WHEN fb THEN ['answered', NULL, 'extractive_fallback']
  WHEN k % 17 = 0 THEN ['support', 'model_abstained', NULL] WHEN k % 5 > 1 THEN ['clarification', 'model_abstained', NULL] ELSE ['support', 'model_abstained', NULL] END AS o FROM f)
SELECT session, turn, o[1] AS outcome, o[2] AS reason, o[3] AS source FROM o"""
_TU_WORD = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}_\x{{0600}}-\x{{06ff}}]+')"


def _turn_round(r):
    """One judgement of all turns, without the errors of the round before."""
    drop = f"(SELECT session, turn FROM tf{r - 1} WHERE o[1] = 'error')" if r else "(SELECT 0 AS session, 0 AS turn WHERE false)"
    state = "CASE WHEN c < 6 THEN c ELSE [5, 7, 9][(c - 6) % 3 + 1] // 2 END"
    shown = f"FROM tn{r} b WHERE b.session = a.session AND b.kept AND b.c < a.c AND b.c >= a.c - a.users"
    of = lambda c: f"CASE WHEN follow THEN coalesce(a1.{c}, a0.{c}) ELSE a0.{c} END"
    return f"""
tk{r} AS (SELECT td.*, x.session IS NULL AS kept FROM td LEFT JOIN {drop} x ON td.session = x.session AND td.turn = x.turn),
tm{r} AS (SELECT *, CAST(coalesce(sum(CAST(kept AS INTEGER)) OVER (PARTITION BY session ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c FROM tk{r}),
tn{r} AS MATERIALIZED (SELECT *, {state} AS users FROM tm{r}),
th{r} AS MATERIALIZED (SELECT a.*, (SELECT flatten(list(topics)) {shown}) AS recent, (SELECT arg_max(b.text, b.turn) {shown} AND len(b.terms) >= 5) AS substantive, (SELECT arg_max(b.text, b.turn) {shown} AND NOT b.failed) AS base,
  (SELECT flatten(list(list_filter(b.terms, lambda e: list_contains(['the','and','of','de'], e)) ORDER BY b.turn DESC)) {shown}) AS found FROM tn{r} a),
ti{r} AS (SELECT *, {_first('found')} AS extra FROM th{r}),
tp{r} AS MATERIALIZED (SELECT *, CASE WHEN c > 0 THEN left(concat_ws(' ', text, left(substantive, 500), nullif(array_to_string(list_filter(extra, lambda e: NOT list_contains(terms, e))[1:4], ' '), '')), 800) ELSE text END AS query,
  c > 0 AND NOT (len(topics) > 0 AND len(coalesce(recent, [])) > 0 AND len(list_intersect(topics, coalesce(recent, []))) = 0) AND (len(terms) <= 4 OR begun) AS continues,
  begun AND len(ents) = 0 AS goes_on, intent = 'troubleshoot' OR len(ents) = 0 AS can_help, CASE WHEN failed THEN substr(sha256(coalesce(base, text)), 1, 20) END AS issue_key FROM ti{r}),
tq{r} AS MATERIALIZED (SELECT DISTINCT query FROM (SELECT query FROM tp{r} UNION ALL SELECT text FROM tp{r})),
tr{r} AS MATERIALIZED (SELECT query, {_first(_raw_terms('query'))} AS terms FROM tq{r}),
ts{r} AS (SELECT query, item_id, sum(tf) AS hits FROM (SELECT query, unnest(terms) AS term FROM tr{r}) u JOIN tw USING (term) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query ORDER BY sum(tf) DESC, item_id) <= 6),
tt{r} AS MATERIALIZED (SELECT query, arg_min(item_id, (-hits, item_id)) AS top, flatten(list(terms)) AS seen, sum(greatest(1, len(text) // 4)) AS used FROM ts{r} JOIN tb USING (item_id) GROUP BY 1),
te{r} AS MATERIALIZED (SELECT tr{r}.query, coalesce(CAST(top AS VARCHAR), '-') AS top, top IS NULL AS none, coalesce(used, 0) + greatest(1, length(tr{r}.query) // 4) AS tokens,
  len(list_filter(list_intersect(terms, {_ENTITIES}), lambda e: NOT list_contains(coalesce(seen, []), e))) AS missing, round(len(list_intersect(terms, coalesce(seen, []))) / greatest(1, len(terms)), 9) AS coverage FROM tr{r} LEFT JOIN tt{r} USING (query)),
tv{r} AS (SELECT session, turn, 0 AS variant, text AS query FROM tp{r} UNION ALL SELECT session, turn, 1, query FROM tp{r} WHERE query <> text),
tx{r} AS MATERIALIZED (SELECT *, CASE WHEN none THEN 'no_results' WHEN missing > 0 THEN 'missing_entity_coverage' WHEN coverage < 0.35 THEN 'insufficient_query_coverage' ELSE 'sufficient' END AS reason, (session * 31 + turn * 7 + variant * 13) % 101 AS k FROM tv{r} JOIN te{r} USING (query)),
ty{r} AS MATERIALIZED (SELECT *, CASE k % 10 WHEN 5 THEN 'invalid' WHEN 8 THEN 'failed' WHEN 7 THEN 'abstained' WHEN 9 THEN 'url' WHEN 6 THEN 'unknown_source' ELSE CASE WHEN none THEN 'unknown_source' ELSE 'valid' END END AS one,
  CASE k % 9 + 2 WHEN 5 THEN 'invalid' WHEN 8 THEN 'failed' WHEN 7 THEN 'abstained' WHEN 9 THEN 'url' WHEN 6 THEN 'unknown_source' ELSE CASE WHEN none THEN 'unknown_source' ELSE 'valid' END END AS two, k % 8 < 3 AS fb FROM tx{r}),
tz{r} AS MATERIALIZED (SELECT p.session, p.turn, {_norm('p.text')} AS key, p.intent, ts, tokens <= 500 AND (one = 'valid' OR (one IN ('invalid', 'unknown_source', 'url') AND two = 'valid')) AS writes,
  row_number() OVER (PARTITION BY {_norm('p.text')}, p.intent ORDER BY ts, p.session, p.turn) AS i FROM tp{r} p JOIN ty{r} y ON p.session = y.session AND p.turn = y.turn AND variant = 0
  WHERE c = 0 AND NOT failed AND in_scope AND y.reason = 'sufficient'),
ca{r} AS (SELECT *, false AS hit, CASE WHEN writes THEN ts END AS since FROM tz{r} WHERE i = 1 UNION ALL
  SELECT z.*, coalesce(z.ts - ca.since < 14400, false), CASE WHEN z.writes AND NOT coalesce(z.ts - ca.since < 14400, false) THEN z.ts ELSE ca.since END FROM ca{r} ca JOIN tz{r} z ON z.key = ca.key AND z.intent = ca.intent AND z.i = ca.i + 1),
tj{r} AS MATERIALIZED (SELECT p.session, p.turn, p.in_scope, p.sr, p.c, p.continues, p.goes_on, p.can_help, p.issue_key, p.text, p.query, coalesce(hit, false) AS hit, row_number() OVER (PARTITION BY p.session ORDER BY p.turn) AS i FROM tp{r} p LEFT JOIN ca{r} ca ON p.session = ca.session AND p.turn = ca.turn),
tl{r} AS (SELECT session, 0 AS turn, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS prev, CAST(NULL AS VARCHAR) AS issue, 0 AS fails, ['', '', ''] AS o, false AS follow, 0 AS n, '' AS query FROM tj{r} WHERE i = 1 UNION ALL
  SELECT session, turn, i, CASE WHEN o[1] = 'error' THEN prev WHEN o[1] = 'clarification' THEN 'clarification:' || o[2] ELSE o[1] END, CASE WHEN reports THEN issue_key ELSE issue END, CASE WHEN reports THEN n ELSE fails END, o, follow, n, CASE WHEN follow THEN query ELSE text END FROM (
  SELECT *, CASE WHEN NOT in_scope THEN ['out_of_scope', sr, NULL] WHEN n >= 2 THEN ['support', 'repeated_failure', NULL] WHEN goes_on AND prev IS NOT DISTINCT FROM 'support' THEN ['support', 'support_continuation', NULL]
    WHEN reason <> 'sufficient' AND clarified THEN ['support', reason, NULL] WHEN reason <> 'sufficient' AND sr = 'domain_unverified' AND NOT follow THEN ['out_of_scope', sr, NULL]
    WHEN reason <> 'sufficient' THEN [CASE WHEN can_help THEN 'clarification' ELSE 'support' END, reason, NULL] WHEN hit THEN ['answered', NULL, 'cache'] WHEN tokens > 500 THEN ['support', 'token_budget_exceeded', NULL] WHEN one = 'valid' THEN ['answered', NULL, 'model']
    WHEN one = 'failed' OR (one <> 'abstained' AND two = 'failed') THEN CASE WHEN fb THEN ['answered', NULL, 'extractive_fallback'] ELSE ['error', 'provider_failed', NULL] END
    WHEN one <> 'abstained' AND two = 'valid' THEN ['answered', NULL, 'repair'] WHEN fb THEN ['answered', NULL, 'extractive_fallback']
    WHEN can_help AND NOT clarified THEN ['clarification', 'model_abstained', NULL] ELSE ['support', 'model_abstained', NULL] END AS o FROM (
  SELECT f.*, {of('reason')} AS reason, {of('tokens')} AS tokens, {of('one')} AS one, {of('two')} AS two, {of('fb')} AS fb FROM (
  SELECT j.*, l.prev, l.issue, l.fails, coalesce(starts_with(l.prev, 'clarification:'), false) AS clarified, j.c > 0 AND (coalesce(starts_with(l.prev, 'clarification:'), false) OR j.continues) AS follow, j.in_scope AND j.issue_key IS NOT NULL AS reports,
    CASE WHEN NOT (j.in_scope AND j.issue_key IS NOT NULL) THEN 0 WHEN l.issue IS NOT DISTINCT FROM j.issue_key THEN least(20, l.fails + 1) ELSE 1 END AS n FROM tl{r} l JOIN tj{r} j ON j.session = l.session AND j.i = l.i + 1) f
  JOIN ty{r} a0 ON a0.session = f.session AND a0.turn = f.turn AND a0.variant = 0 LEFT JOIN ty{r} a1 ON a1.session = f.session AND a1.turn = f.turn AND a1.variant = 1))),
tf{r} AS MATERIALIZED (SELECT * FROM tl{r} WHERE i > 0)"""


turn_pipeline = rf"""WITH RECURSIVE tc AS (SELECT conv_id AS session, turn, conv_id * 60 + turn * 10 AS ts, CASE WHEN conv_id % 3 = 0 AND turn < 2 THEN ['and the', 'that is for the', 'of this and of that'][conv_id % 7 % 3 + 1] ELSE text END AS text FROM conversations WHERE role = 'user'),
ta AS (SELECT *, {_norm('text')} AS n, replace(lower(text), 'ß', 'ss') AS low, {_raw_terms('text')} AS raw FROM tc),
tg AS (SELECT *, len(list_filter(['tion', 'and', 'de ', 'deploy', 'postgresql', 'mysql', 'redis', 'dns', 'object storage', 'docker'], lambda m: contains(n, m))) > 0 AS known, CASE WHEN contains(n, 'eren') THEN 'troubleshoot' WHEN contains(n, 'anre') THEN 'compare' END AS word, contains(n, 'er') AS outside, {_first('raw')} AS terms FROM ta),
td AS MATERIALIZED (SELECT session, turn, ts, text, terms, list_intersect(terms, ['the','and','of','de']) AS topics, list_intersect(terms, ['the','and','of','de']) AS ents, contains(low, 'ste') OR contains(low, 'les') AS failed,
  starts_with(n, 'the ') OR starts_with(n, 'is ') OR starts_with(n, 'of ') AS begun, known OR NOT outside AS in_scope, CASE WHEN NOT known AND outside THEN 'out_of_scope' ELSE coalesce(word, 'explain') END AS intent,
  CASE WHEN NOT known AND outside THEN 'explicit_other_topic' WHEN word IS NOT NULL THEN 'intent_keyword' WHEN known THEN 'domain_keyword' ELSE 'domain_unverified' END AS sr FROM tg),
tb AS MATERIALIZED (SELECT item_id, text, {_raw_terms('text')} AS terms FROM benchmark),
tw AS MATERIALIZED (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({_TU_WORD.format(_norm('text'))}) AS term FROM benchmark) GROUP BY 1, 2),
{",".join(_turn_round(r) for r in range(3))}
SELECT session, turn, o[1] AS outcome, o[2] AS reason, o[3] AS source, follow AS follow_up, CAST(n AS BIGINT) AS failure_count, md5(query) AS query_hash FROM tf2"""
request_checks = r"""WITH k AS (SELECT *, conv_id * 3 + turn AS k, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN k % 17 = 0 THEN 'protocol_version' WHEN k % 13 = 0 OR k % 19 = 0 THEN 'session_id' WHEN k % 11 = 0 THEN 'message_id' WHEN k % 23 = 0 OR t = '' THEN 'text'
  WHEN k % 7 = 0 THEN 'surface' WHEN k % 29 = 0 THEN 'locale' WHEN length(t) > 300 THEN 'input_too_long' END AS problem FROM k"""
_CASES = """h AS (SELECT item_id, list_sort(list_distinct(list('https://docs.example.com/' || doc_id))) AS urls FROM benchmark JOIN documents USING (text) GROUP BY 1),
c AS (SELECT b.item_id AS id, b.item_id % 5 <> 4 AS ok, CASE WHEN b.item_id % 5 <> 4 THEN coalesce(h.urls, []) ELSE [] END AS e FROM benchmark b LEFT JOIN h USING (item_id))"""
release_report = f"""WITH {_CASES},
a AS (SELECT *, CASE WHEN id % 13 = 5 THEN 'missing' WHEN NOT ok THEN 'out_of_scope' WHEN id % 7 = 3 THEN 'support' ELSE 'answered' END AS outcome,
  CASE WHEN id % 13 = 5 THEN [] WHEN id % 6 = 1 THEN list_concat(['https://other.example.com/'], e) WHEN id % 11 = 2 THEN e[2:] ELSE e END AS u FROM c),
r AS (SELECT *, CASE WHEN NOT ok THEN outcome = 'out_of_scope' AND len(u) = 0 WHEN len(e) > 0 THEN outcome = 'answered' AND len(list_filter(e, lambda x: NOT list_contains(u, x))) = 0 ELSE outcome IN ('clarification', 'support', 'answered') END AS passed,
  coalesce(round(1.0 / list_min(list_filter(list_transform(e, lambda x: list_position(u, x)), lambda k: k > 0)), 9), 0) AS rr FROM a),
t AS (SELECT count(*) AS cases, round(avg(CAST(passed AS DOUBLE)), 9) AS pass_rate, round(coalesce(avg(CAST(passed AS DOUBLE)) FILTER (len(e) > 0), 1), 9) AS source_recall, round(coalesce(avg(rr) FILTER (len(e) > 0), 1), 9) AS mrr FROM r)
SELECT *, pass_rate >= 0.9 AND source_recall >= 0.9 AND mrr >= 0.75 AS released FROM t"""
dataset_verification = f"""WITH {_CASES}, t AS (SELECT count(*) AS cases, round(avg(CAST((id % 9 <> 4) = ok AS DOUBLE)), 9) AS scope_accuracy,
  (SELECT count(*) FROM (SELECT unnest(e) AS url FROM c) WHERE CAST(replace(url, 'https://docs.example.com/', '') AS BIGINT) % 40 = 0) AS missing FROM c)
SELECT *, scope_accuracy >= 0.9 AND missing = 0 AS passed FROM t"""
cache_lookups = """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS kind FROM events),
w AS (SELECT *, max(CASE WHEN kind = 0 THEN us END) OVER (PARTITION BY user_id ORDER BY us, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM e)
SELECT event_id, CASE WHEN us - w < 86400000000 THEN 'hit' ELSE 'miss' END AS cache_status, CASE WHEN us - w < 86400000000 THEN w END AS written FROM w WHERE kind = 1"""
cited_sources = """WITH c AS (SELECT doc_id AS answer_id, 0 AS place, doc_id * 7 % 150 AS chunk_id FROM documents UNION ALL SELECT doc_id, 1, doc_id * 3 % 150 FROM documents WHERE doc_id * 7 % 150 <> doc_id * 3 % 150)
SELECT answer_id, CAST(place AS BIGINT) AS place, chunk_id, source FROM c JOIN documents d ON d.doc_id = c.chunk_id"""
usage_totals = """SELECT event_id // 3 AS request, CAST(sum(length(props)) AS BIGINT) AS input_tokens, CAST(sum(floor(value)) AS BIGINT) AS output_tokens, CAST(sum(CASE WHEN event_id % 2 = 0 THEN event_id % 10 ELSE 0 END) AS BIGINT) AS cached_tokens,
  arg_max(event_type, event_id % 3) FILTER (event_id % 4 > 0) AS provider FROM events GROUP BY 1"""
reply_order = "SELECT event_id // 16 AS batch, string_agg(event_type, ',' ORDER BY event_id * 5 % 16) AS values FROM events GROUP BY 1"


_OPENED = "CASE WHEN kind = 'text_delta' THEN true WHEN kind IN ('sources', 'support', 'message_end', 'error') THEN false END"
_JSON = "json_extract_string(j, '$.{0}')"
stream_parts = f"""WITH e AS (SELECT event_id // 12 AS stream, event_id % 12 AS place, {STREAM_EVENT} AS raw FROM events),
j AS (SELECT *, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS j FROM e),
k AS (SELECT *, coalesce({_JSON.format('type')}, 'broken') AS kind, coalesce({_JSON.format('text')}, '') AS text FROM j),
o AS (SELECT *, coalesce(last_value({_OPENED} IGNORE NULLS) OVER b, false) AS open, coalesce(bool_or(kind IN ('message_end', 'error', 'broken')) OVER b, false) AS over, 'text-' || coalesce(last_value({_JSON.format('response_id')} IGNORE NULLS) OVER u, '') AS tid,
  lead(place) OVER (PARTITION BY stream ORDER BY place) IS NULL AS last, kind IN ('message_end', 'error', 'broken') AS ends FROM k
  WINDOW b AS (PARTITION BY stream ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), u AS (PARTITION BY stream ORDER BY place)),
p AS (SELECT stream, place, list_filter([
  CASE WHEN kind = 'message_start' THEN ['start', {_JSON.format('response_id')}] END, CASE WHEN kind = 'status' AND text <> '' THEN ['data-status', text] END, CASE WHEN kind = 'text_delta' AND NOT open THEN ['text-start', tid] END, CASE WHEN kind = 'text_delta' AND text <> '' THEN ['text-delta', text] END,
  CASE WHEN open AND kind IN ('sources', 'support', 'message_end', 'error') THEN ['text-end', tid] END, CASE WHEN kind = 'sources' THEN ['source-url', {_JSON.format('sources[0].id')} || ' ' || {_JSON.format('sources[0].url')} || ' t'] END, CASE WHEN kind = 'sources' THEN ['data-sourceDetails', '1'] END,
  CASE WHEN kind = 'suggestions' THEN ['data-suggestions', array_to_string(json_extract_string(j, '$.suggestions[*]'), '|')] END, CASE WHEN kind = 'support' THEN ['data-support', coalesce({_JSON.format('reason_code')}, 'insufficient_evidence')] END,
  CASE WHEN kind = 'usage' AND json_exists(j, '$.usage') THEN ['data-usage', {_JSON.format('usage.model_tier')} || ' ' || {_JSON.format('usage.input_tokens')}] END,
  CASE WHEN kind = 'message_end' THEN ['finish', CASE WHEN {_JSON.format('finish_reason')} IN ('stop', 'length') THEN {_JSON.format('finish_reason')} ELSE 'other' END] END, CASE WHEN kind = 'error' THEN ['error', coalesce({_JSON.format('message')}, 'cut off')] END, CASE WHEN kind = 'broken' THEN ['error', 'not a stream'] END,
  CASE WHEN last AND NOT ends AND coalesce({_OPENED}, open) THEN ['text-end', tid] END, CASE WHEN last AND NOT ends THEN ['error', 'cut off'] END, CASE WHEN ends OR last THEN ['[DONE]', NULL] END], lambda x: x IS NOT NULL) AS parts FROM o WHERE NOT over)
SELECT stream, place, unnest(range(len(parts))) AS n, unnest(parts)[1] AS part, unnest(parts)[2] AS value FROM p"""


parse_documents = r"""WITH p AS (SELECT doc_id, doc_id % 11 AS k, source || '/' || doc_id || '.md' AS path, '# Document ' || doc_id || chr(10) || chr(10) || replace(text, '#', '') AS body FROM documents),
s AS (SELECT *, CASE k WHEN 1 THEN 'host not allowed' WHEN 2 THEN 'missing canonical link' WHEN 3 THEN 'missing canonical link' WHEN 4 THEN 'missing level-one title' WHEN 5 THEN 'empty document' END AS reason FROM p)
SELECT path, CASE WHEN reason IS NULL THEN 'ok' WHEN k = 4 THEN 'skipped' ELSE 'failed' END AS status, reason, CASE k WHEN 1 THEN 'https://other.example.com/' || doc_id WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 5 THEN NULL ELSE 'https://docs.example.com/' || doc_id END AS canonical_url,
  CASE WHEN k NOT IN (4, 5) THEN 'Document ' || doc_id END AS title, md5(CASE k WHEN 4 THEN '#' || regexp_replace(body, '\s+$', '') WHEN 5 THEN '' ELSE regexp_replace(body, '\s+$', '') END) AS content_hash FROM s"""
version_lifecycle = "SELECT 'https://docs.example.com/' || doc_id AS canonical_url, 'Document ' || doc_id AS title, CAST(0 AS BIGINT) AS first, CAST(0 AS BIGINT) AS lacking, true AS complete, count(*) OVER () AS documents FROM documents"
readiness = """WITH a AS (SELECT vec_id FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE source = (SELECT min(source) FROM documents)),
e AS (SELECT count(*) > 0 AND count(*) = count(vec_id) AS ready FROM a)
SELECT * FROM (VALUES ('table documents', true), ('table embeddings', false), ('table chunks', false), ('active version', true), ('all', false)) v("check", ready) UNION ALL SELECT 'embeddings', ready FROM e"""


document_contradictions = """WITH p AS (SELECT doc_id // 10 AS query_id, doc_id, lang FROM documents)
SELECT DISTINCT n.query_id, n.doc_id AS negative_document, y.doc_id AS positive_document, 1.0::DOUBLE AS share FROM p n JOIN p y ON n.query_id = y.query_id AND n.lang = y.lang AND n.doc_id % 2 = 0 AND y.doc_id % 2 = 1"""
contradiction_pairs = document_contradictions.replace("doc_id // 10", "doc_id // 4")
_SENTENCES = r"string_split(regexp_replace(regexp_replace(text, '([.!؟])\s+', '\1' || chr(10), 'g'), '\n+', chr(10), 'g'), chr(10))"
_ENT_IN = "list_filter(q, lambda x: list_contains({e}, x))"
extractive_quotes = rf"""WITH s AS (SELECT doc_id, lang || ' ' || source AS named, unnest({_SENTENCES}) AS raw, unnest(range(len({_SENTENCES}))) AS k FROM documents),
c AS (SELECT *, trim(ltrim(trim(regexp_replace(raw, '\s+', ' ', 'g')), '>-* ')) AS sentence FROM s),
f AS (SELECT * FROM c WHERE length(sentence) BETWEEN 1 AND 800 AND (contains({_norm('sentence')}, 'and ') OR contains({_norm('sentence')}, 'de '))),
t AS (SELECT *, list_concat({_raw_terms('named')}, {_raw_terms('sentence')}) AS terms FROM f),
b AS (SELECT item_id, {_raw_terms('text')} AS r FROM benchmark), u AS (SELECT item_id, {_first('r')} AS q FROM b),
m AS (SELECT item_id, doc_id, sentence, k, len(list_intersect(q, terms)) / greatest(1, len(q)) AS o, list_intersect(q, {_ENTITIES}) AS e, terms FROM t JOIN u ON item_id = doc_id % 40),
g AS (SELECT *, round(o + len(list_intersect(e, terms)) / greatest(1, len(e)), 9) AS score FROM m WHERE o >= 0.2 AND len(list_intersect(e, terms)) = len(e))
SELECT item_id AS query_id, CAST(doc_id AS VARCHAR) AS chunk_id, sentence, score FROM g QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id // 40, k) = 1"""
extractive_fallback = rf"""WITH s AS (SELECT doc_id, {_raw_terms('left(text, 300)')} AS r, unnest({_SENTENCES}) AS raw, unnest(range(len({_SENTENCES}))) AS k FROM documents),
c AS (SELECT *, trim(ltrim(trim(regexp_replace(raw, '\s+', ' ', 'g')), '>-* ')) AS sentence FROM s),
f AS (SELECT * FROM c WHERE length(sentence) BETWEEN 1 AND 800 AND (contains({_norm('sentence')}, 'the ') OR contains({_norm('sentence')}, 'der '))),
t AS (SELECT *, {_first('r')} AS q, {_raw_terms('sentence')} AS terms FROM f),
m AS (SELECT *, len(list_intersect(q, terms)) / greatest(1, len(q)) AS o, list_intersect(q, {_ENTITIES}) AS e FROM t),
g AS (SELECT *, round(o + len(list_intersect(e, terms)) / greatest(1, len(e)), 9) AS score FROM m WHERE o >= 0.3 AND len(list_intersect(e, terms)) = len(e))
SELECT doc_id AS query_id, CAST(doc_id AS VARCHAR) AS chunk_id, md5(sentence) AS sentence, score FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) = 1"""
parse_document_inline = rf"""WITH f AS (SELECT source || '/' || doc_id || '.md' AS path, {MARKDOWN_FILE} AS raw FROM documents),
l AS (SELECT path, raw, string_split_regex(raw, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS lines FROM f),
r AS (SELECT path, raw, nullif(regexp_extract(trim(lines[1]), '(?i)^Original link:\s*(https://\S+)\s*$', 1), '') AS url, lines[2:] AS rest FROM l),
t AS (SELECT *, list_filter(rest, lambda x: regexp_matches(x, '^#\s+.+?\s*$'))[1] AS first_title, list_position(list_transform(rest, lambda x: regexp_matches(trim(x), '(?i)^##\s+all links\s*$')), true) AS tail FROM r),
c AS (SELECT path, raw, url, regexp_extract(first_title, '^#\s+(.+?)\s*$', 1) AS title, regexp_replace(array_to_string(CASE WHEN tail > 0 THEN rest[:tail - 1] ELSE rest END, chr(10)), '^\s+|\s+$', '', 'g') AS content FROM t),
j AS (SELECT *, CASE WHEN coalesce(length(raw), 0) = 0 THEN 'empty document' WHEN url IS NULL THEN 'missing canonical link' WHEN regexp_extract(lower(url), '^https://([^/?#:]*)', 1) <> 'docs.example.com' THEN 'host not allowed'
  WHEN title IS NULL THEN 'missing level-one title' WHEN content = '' THEN 'no indexable content' END AS reason FROM c)
SELECT path, CASE WHEN reason IS NULL THEN 'ok' WHEN reason = 'missing level-one title' THEN 'skipped' ELSE 'failed' END AS status, reason, url AS canonical_url, title, content FROM j"""
parse_units_inline = r"""WITH b AS (SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(text, '[#`~]', '', 'g'), '\n(\s*\n)+'), lambda x: trim(regexp_replace(x, '\s', '', 'g')) <> '')) AS n FROM documents)
SELECT doc_id, 'text' AS kind, 'Title' AS heading, CAST(NULL AS VARCHAR) AS code_language, n AS units FROM b WHERE n > 0 UNION ALL SELECT doc_id, 'heading', 'Title', NULL, 1 FROM b UNION ALL SELECT doc_id, 'heading', 'Title > Code', NULL, 1 FROM b UNION ALL SELECT doc_id, 'code', 'Title > Code', 'py', 1 FROM b"""
provider_stream = "SELECT event_id // 10 AS stream, event_id % 10 AS place, event_type AS delta, event_id AS n FROM events WHERE event_id % 10 NOT IN (3, 5) AND event_id % 10 < 7"
after_support_flag = f"""WITH {_TURNS}, o AS (SELECT *, CASE WHEN role = 'assistant' AND (session + turn) % 3 = 0 THEN 'support' ELSE outcome END AS out2, {_N} AS n, {_raw_terms('text')} AS r FROM t)
SELECT session, turn, coalesce((SELECT arg_max(b.out2, b.turn) FROM o b WHERE b.session = o.session AND b.turn < o.turn AND b.role = 'assistant') = 'support', false) AND NOT list_contains(r, 'and') AND (starts_with(n, 'the ') OR starts_with(n, 'of ') OR starts_with(n, 'is ')) AS after_support FROM o WHERE role = 'user'"""
support_summaries = """WITH s AS (SELECT conv_id, turn, 'goal: ' || left('MY_TOKEN=<YOUR_MY_TOKEN> ' || text, 500) || CASE WHEN turn % 3 = 0 THEN '' ELSE chr(10) || 'seen: b، ' || conv_id END AS x FROM conversations WHERE role = 'user')
SELECT conv_id, turn, md5(x) AS summary_hash, length(x) AS n FROM s"""
prompts = """WITH p AS (SELECT item_id, '<SOURCE id=' || item_id || '>' || chr(10) || 'title' || chr(10) || text || chr(10) || '</SOURCE>' || chr(10) || '<SOURCE id=x>' || chr(10) || 'other' || chr(10) || 'more' || chr(10) || '</SOURCE>' || chr(10) || chr(10) || 'INTENT: explain' || chr(10) || chr(10)
  || 'CONTEXT:' || chr(10) || CASE WHEN item_id % 2 = 0 THEN text ELSE '(empty)' END || chr(10) || chr(10) || 'QUESTION:' || chr(10) || text AS x FROM benchmark) SELECT item_id, md5(x) AS prompt_hash, length(x) AS n FROM p"""
row_checks = "SELECT 'role' AS rule, count(*) FILTER (role NOT IN ('user', 'assistant')) AS violations FROM conversations UNION ALL SELECT 'url prefix', count(*) FILTER (NOT starts_with(url, 'https://')) FROM pages"
golden_set = f"WITH {_CASES} SELECT id, md5(b.text) AS query_hash, ok AS expected_in_scope, len(e) AS n_urls FROM c JOIN benchmark b ON b.item_id = id"


report_json = f"""SELECT '{{"cases":"' || cases || '","pass_rate":"' || pass_rate || '","source_recall":"' || source_recall || '","mrr":"' || mrr || '","released":"' || released || '","commit":"c0ffee"}}' AS report FROM ({release_report})"""


_NEXT_B = "coalesce(list_filter(range({a} + 1, n), lambda i: upto[i + 2] - upto[{a} + 1] > 150)[1], n)"
_NEXT_A = """greatest(a, least(b, greatest(least(list_filter(range(0, b + 1), lambda j: upto[b + 1] - upto[j + 1] <= 30)[1], b - 1), coalesce(list_filter(range(0, b + 1), lambda j: upto[b + 2] - upto[j + 1] <= 150)[1], b),
  coalesce(list_max(list_filter(code, lambda c: c < b)), -1) + 1)))"""
chunk_ranges = f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS x, unnest(range(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')))) AS i FROM documents),
s AS (SELECT doc_id, i, {_TOKEN.format('x')} AS size, contains(x, '#') AS code FROM l),
w AS (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM s),
d AS MATERIALIZED (SELECT doc_id, count(*) AS n, list_concat([0], list(CAST(upto AS BIGINT) ORDER BY i)) AS upto, coalesce(list(i) FILTER (code), []) AS code FROM w GROUP BY doc_id),
g AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS a, {_NEXT_B.format(a='0')} AS b FROM d UNION ALL
  SELECT doc_id, k + 1, a2, {_NEXT_B.format(a='a2')} FROM (SELECT g.doc_id, g.k, d.n, d.upto, {_NEXT_A} AS a2 FROM g JOIN d ON g.doc_id = d.doc_id WHERE g.b < d.n))
SELECT doc_id, k, a, CAST(b AS BIGINT) AS b FROM g"""


def _machine(rows, key, order, start, state, out, final):
    """A state machine as a recursion over each key's rows in order. start: first state by name; state and out: expressions over s (state) and r (row)."""
    names = list(start)
    return f"""WITH RECURSIVE rows AS ({rows}), r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS i FROM rows),
k AS (SELECT DISTINCT {key} FROM rows),
m AS (SELECT {key}, CAST(0 AS BIGINT) AS i, {", ".join(f"{v} AS {n}" for n, v in start.items())}, {", ".join(f"CAST(NULL AS {t}) AS {n}" for n, (t, _) in out.items())} FROM k UNION ALL
  SELECT {key}, i, {", ".join(state[n] for n in names)}, {", ".join(x for _, x in out.values())} FROM (SELECT r.*, {", ".join("s." + n for n in names)} FROM m s JOIN r USING ({key}) WHERE r.i = s.i + 1))
SELECT {final} FROM m JOIN r USING ({key}, i)"""


_AT = "epoch_us(ts) AS us"
_BLOCKED, _PROBE = "opened >= 0 AND us - opened < 21600000000", "opened >= 0 AND us - opened >= 21600000000"
_N_FAILED = f"(CASE WHEN {_PROBE} THEN 2 ELSE failures END + 1)"
circuit_states = stream_circuit = _machine(
    f"SELECT event_id, user_id, {_AT}, event_type IN ('error', 'view') AS failed FROM events", "user_id", "us, event_id", {"failures": "0", "opened": "CAST(-1 AS BIGINT)"},
    {"failures": f"CASE WHEN {_BLOCKED} THEN failures WHEN NOT failed THEN 0 ELSE {_N_FAILED} END", "opened": f"CASE WHEN {_BLOCKED} THEN opened WHEN failed AND {_N_FAILED} >= 3 THEN us ELSE -1 END"},
    {"circuit": ("VARCHAR", f"CASE WHEN {_BLOCKED} THEN 'open' WHEN {_PROBE} THEN 'half_open' ELSE 'closed' END")}, "event_id, user_id, circuit",
)
stream_two_level_limit = rate_limit_two_level
_KNOWN = "status <> '' AND us < until"
reservations = stream_reservations = _machine(
    f"SELECT event_id, user_id, epoch_us(ts) // 691200000000 AS message, {_AT}, CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'signup' THEN 'complete' WHEN 'error' THEN 'release' ELSE 'reserve' END AS command FROM events",
    "user_id, message", "us, event_id", {"status": "''", "until": "CAST(-1 AS BIGINT)"},
    {"status": f"CASE command WHEN 'reserve' THEN CASE WHEN {_KNOWN} THEN status ELSE 'in_progress' END WHEN 'complete' THEN CASE WHEN {_KNOWN} THEN 'complete' ELSE status END ELSE '' END",
     "until": f"CASE WHEN command = 'release' THEN -1 WHEN (command = 'reserve') = ({_KNOWN}) THEN until ELSE us + 172800000000 END"},
    {"result": ("VARCHAR", f"CASE command WHEN 'reserve' THEN CASE WHEN {_KNOWN} THEN 'duplicate_' || status ELSE 'acquired' END ELSE CASE WHEN {_KNOWN} THEN command || 'd' ELSE 'unknown' END END")}, "event_id, command, result",
)
_ALIVE = "turns >= 0 AND us < until"
session_states = stream_session_states = _machine(
    f"SELECT event_id, user_id, {_AT}, CASE event_type WHEN 'view' THEN 'load' WHEN 'click' THEN 'append' WHEN 'purchase' THEN 'append' WHEN 'error' THEN 'delete' ELSE 'create' END AS command FROM events",
    "user_id", "us, event_id", {"turns": "-1", "until": "CAST(-1 AS BIGINT)"},
    {"turns": f"CASE WHEN command = 'create' THEN 0 WHEN command = 'delete' OR NOT ({_ALIVE}) THEN -1 WHEN command = 'append' THEN turns + 1 ELSE turns END", "until": f"CASE WHEN command = 'create' OR (command <> 'delete' AND {_ALIVE}) THEN us + 43200000000 ELSE -1 END"},
    {"result": ("VARCHAR", f"CASE WHEN command = 'create' THEN 'created' WHEN NOT ({_ALIVE}) THEN CASE command WHEN 'append' THEN 'unavailable' ELSE 'missing' END WHEN command = 'delete' THEN 'deleted' WHEN command = 'load' THEN 'loaded' ELSE 'appended' END"),
     "n": ("BIGINT", f"CASE WHEN command = 'create' THEN 0 WHEN command = 'delete' OR NOT ({_ALIVE}) THEN NULL WHEN command = 'append' THEN turns + 1 ELSE turns END")}, "event_id, command, result, n AS turns",
)
_FRESH = "written >= 0 AND us - written < 86400000000"
answer_cache = stream_answer_cache = _machine(
    f"SELECT event_id, user_id, {_AT}, CASE WHEN event_type = 'click' THEN 'write' WHEN event_id % 5 % 4 = 0 AND event_type <> 'error' THEN 'lookup' ELSE 'bypass' END AS command, event_id % 11 <> 0 AS valid FROM events",
    "user_id", "us, event_id", {"written": "CAST(-1 AS BIGINT)"}, {"written": "CASE WHEN command = 'write' THEN us ELSE written END"},
    {"cache_status": ("VARCHAR", f"CASE WHEN command = 'write' THEN 'written' WHEN command = 'bypass' THEN 'bypass' WHEN NOT ({_FRESH}) THEN 'miss' WHEN valid THEN 'hit' ELSE 'invalid' END"),
     "w": ("BIGINT", f"CASE WHEN command = 'write' THEN us WHEN command = 'lookup' AND {_FRESH} THEN written END")}, "event_id, command, cache_status, w AS written",
)
_GROWN = "list_append(kept_turns, {'r': role, 't': text})"
_FULL = f"len({_GROWN}) > 4"
_SAID = f"list_transform(list_filter({_GROWN}[:-5], lambda x: x.r = 'user'), lambda x: '- ' || left(x.t, 120))"
_SUMMARY = f"CASE WHEN {_FULL} THEN right(array_to_string(list_filter(list_concat([summary], {_SAID}), lambda x: x <> ''), chr(10)), 300) ELSE summary END"
_KEPT = f"CASE WHEN {_FULL} THEN {_GROWN}[-4:] ELSE {_GROWN} END"
session_compaction = stream_compaction = _machine(
    "SELECT conv_id AS session, turn, role, text FROM conversations", "session", "turn", {"kept_turns": "CAST([] AS STRUCT(r VARCHAR, t VARCHAR)[])", "summary": "''"}, {"kept_turns": _KEPT, "summary": _SUMMARY},
    {"kept": ("BIGINT", f"len({_KEPT})"), "summary_hash": ("VARCHAR", f"md5({_SUMMARY})")}, "session, r.turn, kept, summary_hash",
)
