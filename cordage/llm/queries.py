"""The thin queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import attribution, binary, chat, collocations, decontaminate, embeddings, filter_audit, mixing, neardup, packing, pii, quality, secrets
from .shared import written

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    return hits.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = attribution.attribute_tokens(_table(spark, sf_dir, "documents"), tokenizer_path(), rule="first")
    return counted.selectExpr("doc_id", "section", "start", "end", "cast(n_tokens AS long) AS n_tokens", "n_crossing")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.token_file_digest(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_turns(_table(spark, sf_dir, "conversations"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_digest(pii.find_personal_data(_table(spark, sf_dir, "documents")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digest(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1, longest=2048)


def op9_near_duplicate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), least=0.98)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(filter_audit.measured_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")), "audited")
    return filter_audit.audit_filters(rows, filter_audit.document_filters(), marks=["good", "toxic"])


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), least=10, longest=3, top=2000, subsumed=50)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    ops = [op1_decontamination, op2_near_duplicates, op3_token_counts, op4_token_files, op5_tool_calls, op6_secrets, op7_personal_data, op8_packing, op9_near_duplicate_vectors, op10_quality, op11_mixing, op12_filter_audit, op13_collocations]
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iwin AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
         FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iwin),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT d.doc_id, d.i, d.n, b.item_id FROM dwin d JOIN iwin b ON d.n = b.n AND d.s = b.s),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s
          FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP2 = rf"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM dw WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM dw UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
root AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT dw.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, dw.doc_id = component_id AS kept
FROM dw LEFT JOIN n USING (doc_id) JOIN root ON root.x = dw.doc_id
"""

_OP5 = """
WITH t AS (SELECT cast(conv_id AS BIGINT) AS conv_id, cast(turn AS BIGINT) AS turn, role, text, '{"text":' || coalesce(cast(to_json(text) AS VARCHAR), 'null') || '}' AS args,
           coalesce(conv_id IS NOT NULL AND turn IS NOT NULL AND role IN ('user', 'assistant'), false) AS linkable FROM conversations),
c AS (SELECT conv_id, turn, min(args) AS args, count(*) AS n_calls FROM t WHERE linkable AND role = 'user' GROUP BY ALL),
chain AS (SELECT *, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM c),
placed AS (SELECT *, cast(row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS INTEGER) AS level FROM chain),
r AS (SELECT conv_id, turn - 1 AS turn, turn AS result_turn, CASE WHEN count(text) = count(*) THEN min(text) END AS content, count(*) AS n_results FROM t WHERE linkable AND role = 'assistant' GROUP BY conv_id, turn),
j AS (SELECT coalesce(p.conv_id, r.conv_id) AS conv_id, coalesce(p.turn, r.turn) AS id, p.turn, r.result_turn, p.level, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results, args, content,
      CASE WHEN p.turn IS NULL THEN 'orphan_result' WHEN r.result_turn IS NULL THEN 'no_result' ELSE 'linked' END AS status FROM placed p FULL JOIN r ON p.conv_id = r.conv_id AND p.turn = r.turn)
SELECT conv_id, cast(id AS VARCHAR) AS call_id, turn, result_turn, status, level, n_calls, n_results, coalesce(args NOT IN ('{"text":null}', '{"text":""}'), false) AS valid,
  '{' || CASE WHEN turn IS NULL THEN '' ELSE '"after":[' || CASE WHEN turn >= 2 THEN '"' || (turn - 2) || '"' ELSE '' END || '],"arguments":' || args || ',' END || CASE WHEN content IS NULL THEN '' ELSE '"content":' || to_json(content) || ',' END
  || '"id":"' || id || '",' || CASE WHEN turn IS NULL THEN '' ELSE '"name":"reply",' END || '"status":"' || status || '"}' AS message FROM j
UNION ALL SELECT conv_id, NULL, turn, NULL, 'message', 0, 0, 0, true,
  '{' || CASE WHEN text IS NULL THEN '' ELSE '"content":' || to_json(text) || ',' END || CASE WHEN role IS NULL THEN '' ELSE '"role":' || to_json(role) || ',' END || '"status":"message"}' FROM t WHERE NOT linkable
"""

_OP9 = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: cast(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v
       WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
root AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
deg AS (SELECT x, count(*) AS k FROM link GROUP BY x)
SELECT v.vec_id, coalesce(k, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN root ON root.x = v.vec_id LEFT JOIN deg ON deg.x = v.vec_id
"""


_OP12 = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        cast(len(w) < 50 AS INTEGER) + 2 * cast(100 * len(list_distinct(w)) < 65 * len(w) AS INTEGER) + 4 * cast(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS INTEGER)
        + 8 * cast(regexp_matches(text, '[#$%&*|]') AS INTEGER) + 16 * cast(coalesce(w.doc_id > first_id, false) AS INTEGER) AS fails
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM f GROUP BY part, fails),
letters AS (SELECT 'A' AS x, 1 AS b UNION ALL SELECT 'B', 2 UNION ALL SELECT 'C', 4 UNION ALL SELECT 'D', 8 UNION ALL SELECT 'E', 16),
o AS (SELECT '' AS s, 0 AS m UNION ALL SELECT s || x, m + b FROM o, letters WHERE m & b = 0),
orders AS (SELECT s FROM o WHERE length(s) = 5),
steps AS (SELECT s AS filter_order, k AS step, cast((SELECT sum(b) FROM letters WHERE instr(left(s, k - 1), x) > 0) AS INTEGER) AS m, b FROM orders, range(1, 6) t(k), letters WHERE x = s[k]),
r AS (SELECT part, filter_order, step, b, sum(CASE WHEN fails & (coalesce(m, 0) | b) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN fails & coalesce(m, 0) = 0 AND fails & b > 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails & coalesce(m, 0) > 0 AND fails & b > 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN fails = b THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails & coalesce(m, 0) = 0 AND fails & b > 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN fails & coalesce(m, 0) = 0 AND fails & b > 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, steps GROUP BY part, filter_order, step, b)
SELECT part, filter_order, cast(step AS INTEGER) AS step, cast(kept AS BIGINT) AS kept, cast(removed AS BIGINT) AS removed, cast(redundant AS BIGINT) AS redundant, cast(unique_fails AS BIGINT) AS unique_fails,
  cast(good_lost AS BIGINT) AS good_lost, cast(toxic_lost AS BIGINT) AS toxic_lost, cast(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley FROM r
"""

_OP13 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOW.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, cast(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, 1 AS s, w[i] AS phrase FROM i UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM i WHERE i + 1 <= len(w) UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM i WHERE i + 2 <= len(w)),
f AS MATERIALIZED (SELECT lang, s, phrase, count(*) AS f, string_split(phrase, ' ') AS g FROM g GROUP BY lang, s, phrase HAVING count(*) >= 10),
cut AS (SELECT lang, s, phrase, f AS a, 1 AS k, g[1] AS first, array_to_string(g[2:], ' ') AS rest FROM f WHERE s >= 2 UNION ALL SELECT lang, s, phrase, f, 2, g[1] || ' ' || g[2], g[3] FROM f WHERE s = 3),
sc AS (SELECT c.lang, c.s, c.phrase, c.a, k, x.f AS l, y.f AS r, cast(1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
       FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
most AS (SELECT lang, phrase, max(f) AS m FROM (SELECT lang, g[1] || ' ' || g[2] AS phrase, f FROM f WHERE s = 3 UNION ALL SELECT lang, g[2] || ' ' || g[3], f FROM f WHERE s = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN most ON most.lang = b.lang AND most.phrase = b.phrase AND b.s = 2 WHERE m IS NULL OR 100 * m < 50 * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n ON n.lang = kept.lang QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    known = {"op1_decontamination": _OP1, "op2_near_duplicates": _OP2, "op5_tool_calls": _OP5, "op9_near_duplicate_vectors": _OP9, "op12_filter_audit": _OP12, "op13_collocations": _OP13, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {k: v for k, v in known.items() if v is not None}
