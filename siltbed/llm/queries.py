"""One query for each operator of this subpackage, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm.common import documents
from siltbed.llm.html_text import extract
from siltbed.llm.jaccard_join import link_documents
from siltbed.llm.lexical_search import search
from siltbed.llm.line_dedup import dedup_lines
from siltbed.llm.media_columns import media_columns
from siltbed.llm.packing import pack
from siltbed.llm.quality_classifier import classify
from siltbed.llm.quality_rules import score_documents
from siltbed.llm.secret_scan import corpus_words, ranked_words, scan_secrets
from siltbed.llm.source_mixing import mix
from siltbed.llm.substring_dedup import dedup_substrings
from siltbed.llm.url_filter import filter_urls, url_host
from siltbed.llm.whitening import whiten


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("th")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(documents(spark, sf_dir))


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n_shingles FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS both_have FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * both_have >= 75 * (x.n_shingles + y.n_shingles - both_have)),
r AS (SELECT u AS node, u AS seen FROM l UNION SELECT r.node, l.v FROM r JOIN l ON r.seen = l.u),
c AS (SELECT node, min(seen) AS least FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n_shingles, 0) AS BIGINT) AS n_shingles, coalesce(c.least, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.node
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir))
    return out.select("row.doc_id", "text", "n_lines", "n_removed")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
f AS (SELECT doc_id, parts, list_filter(range(1, len(parts) + 1), lambda i: regexp_matches(parts[i], '[^\x20\x09-\x0D]')) AS idx FROM d),
w AS (SELECT doc_id, unnest(range(1, len(idx) - 1)) AS s, idx, parts, 3 AS n FROM f WHERE len(idx) >= 3
      UNION ALL SELECT doc_id, s, idx, parts, 1 FROM (SELECT doc_id, unnest(range(1, len(idx) + 1)) AS s, idx, parts FROM f) WHERE len(regexp_extract_all(parts[idx[s]], '[^\x20\x09-\x0D]+')) >= 25),
k AS (SELECT doc_id, s, n, idx[s:s + n - 1] AS lines, list_transform(idx[s:s + n - 1], lambda i: parts[i]) AS run FROM w),
m AS (SELECT doc_id, lines, row_number() OVER (PARTITION BY n, run ORDER BY doc_id, s) > 1 AS later FROM k),
g AS (SELECT doc_id, list_distinct(flatten(list(lines))) AS gone FROM m WHERE later GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN g.gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(parts) + 1), lambda i: NOT list_contains(g.gone, i)), lambda i: parts[i]), chr(10)) END AS text,
  CAST(CASE WHEN text IS NULL THEN 0 ELSE len(parts) END AS BIGINT) AS n_lines, CAST(coalesce(len(g.gone), 0) AS BIGINT) AS n_removed FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scan_secrets(docs, ranked_words(tokenizer_path()), also=[corpus_words(docs)])


def block_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of pages, by rule: the tables hold no list of their own.

    A host's number comes from its MD5. Two thirds of the hosts are listed at some day of 2024, every
    second of these is unlisted after 60 days, every fifth listed again after 120.
    """
    hosts = pages.select(url_host(F.col("url")).alias("pattern")).where("pattern != ''").distinct()
    n = F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("int")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("n") % 200)
    event = lambda days, action: F.struct(F.date_add(day, days).alias("listed"), F.lit(action).alias("action"))
    events = F.array(event(0, "add"), F.when(F.col("n") % 2 == 0, event(60, "remove")), F.when(F.col("n") % 5 == 0, event(120, "add")))
    listed = hosts.withColumn("n", n).where("n % 3 != 0").withColumn("event", F.explode(F.array_compact(events)))
    return listed.select("pattern", F.element_at(F.array(F.lit("adult"), F.lit("malware")), F.col("n") % 3).alias("category"), "event.listed", "event.action")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int"))
    return filter_urls(pages.select("page_id", "url", fetched.alias("fetched")), block_list(pages))


OP7_SQL = r"""
WITH p AS (SELECT DISTINCT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched,
      regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) AS host,
      regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS path FROM pages),
h AS (SELECT DISTINCT host AS pattern, CAST('0x' || substr(md5(host), 1, 6) AS INTEGER) AS n FROM p WHERE host <> ''),
e AS (SELECT pattern, n, DATE '2024-01-01' + n % 200 AS since, 'add' AS action FROM h WHERE n % 3 <> 0
      UNION ALL SELECT pattern, n, DATE '2024-01-01' + n % 200 + 60, 'remove' FROM h WHERE n % 3 <> 0 AND n % 2 = 0
      UNION ALL SELECT pattern, n, DATE '2024-01-01' + n % 200 + 120, 'add' FROM h WHERE n % 3 <> 0 AND n % 5 = 0),
i AS (SELECT pattern, n, since, action, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until FROM e),
k AS (SELECT page_id, url, fetched, unnest(list_distinct(list_concat(
        CASE WHEN host = '' THEN [] ELSE list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda j: array_to_string(string_split(host, '.')[j:], '.')) END,
        CASE WHEN host <> '' AND path <> '' THEN [host || '/' || path] ELSE [] END))) AS pattern FROM p),
m AS (SELECT k.page_id, k.url, k.fetched, count(*) AS n_hits,
        array_to_string(list_sort(list_distinct(list(CASE i.n % 3 WHEN 1 THEN 'adult' ELSE 'malware' END))), ',') AS categories
      FROM k JOIN i ON k.pattern = i.pattern AND i.action = 'add' AND k.fetched >= i.since AND (i.until IS NULL OR k.fetched < i.until) GROUP BY 1, 2, 3)
SELECT p.page_id, p.url, p.fetched, m.n_hits IS NOT NULL AS blocked, coalesce(m.n_hits, 0) AS n_hits, coalesce(m.categories, '') AS categories
FROM p LEFT JOIN m ON p.page_id IS NOT DISTINCT FROM m.page_id AND p.url IS NOT DISTINCT FROM m.url
"""


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir))


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM w WHERE len(words) >= 13),
k AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS window_words FROM g),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY window_words) AS first_doc FROM k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM m WHERE first_doc < doc_id),
a AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id),
o AS (SELECT w.doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM w),
s AS (SELECT o.doc_id, string_agg(o.words[o.p], ' ' ORDER BY o.p) AS kept FROM o ANTI JOIN c ON o.doc_id = c.doc_id AND o.p = c.p GROUP BY o.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(a.gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM w LEFT JOIN a ON w.doc_id = a.doc_id LEFT JOIN s ON w.doc_id = s.doc_id
"""


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = media_columns(documents(spark, sf_dir))
    return media.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "depth", "digest", F.regexp_extract("shard", "[^/]+$", 0).alias("shard"), "offset", "length")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", F.array_join("shards", ",").alias("shards"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: The article of the tables' one template: what these pages hold of character references and elements.
OP11_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS inner_html FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(inner_html, '</?p>|</?h1>'), lambda x: trim(regexp_replace(regexp_replace(replace(regexp_replace(replace(x, '<br>', ' '), '</?b>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS terms FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
p AS (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM d),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM f, s GROUP BY term, n_docs),
c AS (SELECT f.r, f.doc_id, f.term, w.weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))) AS part FROM f JOIN w ON f.term = w.term, s),
t AS (SELECT q.item_id, c.r, c.doc_id, CAST(sum(part) AS BIGINT) AS score FROM q JOIN c ON q.term = c.term GROUP BY 1, 2, 3)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM t WHERE score > 0 QUALIFY rank <= 50
"""


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard_join": OP4_SQL, "op5_line_dedup": OP5_SQL, "op11_html_extraction": OP11_SQL, "op7_url_filter": OP7_SQL, "op8_substring_dedup": OP8_SQL, "op12_lexical_search": OP12_SQL}
