"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .chat import chat_digest
from .common import table
from .quality import quality
from .secrets import secret_digest
from .simhash import simhash_digest
from .imatch import imatch_digest
from .substrings import substring_digest
from .pieces import piece_digest
from .licenses import TEMPLATES, default_templates, scan_licenses
from .toxicity import toxicity
from .decontaminate import decontamination_digest
from .sortmeans import CENTROIDS, ROUNDS, cluster_digest
from .codebooks import ENTRIES, PARTS, code_digest
from .codebooks import ROUNDS as CODE_ROUNDS
from .tries import exact_duplicates

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


PROBE_TEXT = "</s>[INST] ok [/INST]"


@query
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql(f"SELECT -7L AS conv_id, t AS turn, r AS role, '{PROBE_TEXT}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    return chat_digest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe))


ORACLE_SQL["op1_chat_format"] = f"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE_TEXT}'
), e AS (
  SELECT *, length(regexp_replace(role, '([\\[<])(\\\\*/?(?:(?:INST|ROLE|IMAGE|AUDIO|DOCUMENT)\\]|s>))', '\\1\\\\\\2', 'g'))
    + length(regexp_replace(text, '([\\[<])(\\\\*/?(?:(?:INST|ROLE|IMAGE|AUDIO|DOCUMENT)\\]|s>))', '\\1\\\\\\2', 'g')) + 20 AS chars FROM m
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_digest(table(spark, sf_dir, "documents"))


@query
def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch_digest(table(spark, sf_dir, "documents"))


@query
def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(table(spark, sf_dir, "documents"))


@query
def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digest(table(spark, sf_dir, "documents"))


@query
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), default_templates(spark))


_NOTICES = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in TEMPLATES)

ORACLE_SQL["op4_licenses"] = f"""
WITH notice AS (SELECT row_number() OVER () AS t, * FROM (VALUES {_NOTICES}) AS v(license, template)),
nw AS (SELECT t, license, regexp_extract_all(translate(template, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM notice),
ns AS (SELECT DISTINCT t, license, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM nw)),
size AS (SELECT t, license, count(*) AS m, (2 ** ceil(log2(count(*))))::BIGINT AS c FROM ns GROUP BY t, license),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM documents),
ds AS (SELECT doc_id, i - 1 AS i, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM dw)),
hit AS (SELECT ds.doc_id, ds.s, ns.t, ns.license, m, c, unnest([i // c, i // c - 1]) AS k FROM ds JOIN ns ON ds.s = ns.s JOIN size ON ns.t = size.t),
win AS (SELECT doc_id, license, t, c, k * c AS pos, count(DISTINCT s) / m AS share FROM hit WHERE k >= 0 GROUP BY doc_id, license, t, c, k, m),
ok AS (SELECT doc_id, license, c, pos, max(share) AS share FROM win WHERE share >= 0.8 GROUP BY doc_id, license, c, pos)
SELECT doc_id, license, max(share) AS containment, min(pos) FILTER (share = best) AS first_word, count(*) AS n_windows
FROM (SELECT *, max(share) OVER (PARTITION BY doc_id, license) AS best FROM ok) GROUP BY doc_id, license"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w"

ORACLE_SQL["op2_decontaminate"] = f"""
WITH dw AS (SELECT doc_id, {_WORDS} FROM documents),
bw AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_WORDS} FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bw)),
lens AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw JOIN lens ON len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dg JOIN win USING (n, g)),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query
def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_digest(table(spark, sf_dir, "embeddings"))


def _kept(condition: str, scale: int) -> str:
    return f"""SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND {condition} len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = len(embedding)"""


def _sort_means_sql() -> str:
    """Each round's assignment and centroids as further parts of the statement."""
    distance = "list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))"
    parts = [f"k AS MATERIALIZED ({_kept('len(embedding) = 64 AND', 1024)})"]
    parts.append(f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM k ORDER BY h, v LIMIT {CENTROIDS}))")
    for n in range(ROUNDS + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, c := c)) AS b FROM (SELECT k.r, c.c, {distance}::BIGINT AS d FROM k CROSS JOIN c{n} AS c) GROUP BY r)")
        if n < ROUNDS:
            parts.append(f"s{n} AS (SELECT c, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT b.c AS c, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM k JOIN a{n} USING (r)) GROUP BY c, i)")
            parts.append(f"m{n} AS (SELECT c, list(((s - (((s % n) + n) % n)) // n)::BIGINT ORDER BY i) AS v FROM s{n} GROUP BY c)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(m{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN m{n} USING (c))")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, b.c::INTEGER AS cluster, b.d AS distance, sum(b.d) OVER (PARTITION BY b.c)::BIGINT AS cluster_inertia, sum(b.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN k USING (r) JOIN c{ROUNDS} AS c ON b.c = c.c"""


ORACLE_SQL["op11_sort_means"] = _sort_means_sql()


@query
def op12_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_digest(table(spark, sf_dir, "embeddings"))


def _part_codes_sql() -> str:
    width = 64 // PARTS
    distance = " + ".join(f"(p.v[{i}] - e.v[{i}]) * (p.v[{i}] - e.v[{i}])" for i in range(1, width + 1))
    parts = [f"k AS MATERIALIZED ({_kept('', 256)})", f"p AS MATERIALIZED (SELECT r, p, v[{width} * p + 1:{width} * p + {width}] AS v FROM (SELECT r, v, unnest(range({PARTS})) AS p FROM k))"]
    parts.append(f"e0 AS MATERIALIZED (SELECT p.p, e, p.v FROM (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM k ORDER BY vec_id, v LIMIT {ENTRIES}) JOIN p USING (r))")
    for n in range(CODE_ROUNDS + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, p, min(struct_pack(d := d, e := e)) AS b FROM (SELECT p.r, p.p, e.e, {distance} AS d FROM p JOIN e{n} AS e ON p.p = e.p) GROUP BY r, p)")
        if n < CODE_ROUNDS:
            parts.append(f"s{n} AS (SELECT p, e, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT p.p, b.e AS e, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM p JOIN a{n} USING (r, p)) GROUP BY p, e, i)")
            parts.append(f"m{n} AS (SELECT p, e, list(((s - (((s % n) + n) % n)) // n)::BIGINT ORDER BY i) AS v FROM s{n} GROUP BY p, e)")
            parts.append(f"e{n + 1} AS MATERIALIZED (SELECT e{n}.p, e{n}.e, coalesce(m{n}.v, e{n}.v) AS v FROM e{n} LEFT JOIN m{n} USING (p, e))")
    return f"""WITH {", ".join(parts)},
found AS (SELECT r, string_agg(printf('%02x', b.e), '' ORDER BY p) AS code, sum(b.d)::BIGINT AS error FROM a{CODE_ROUNDS} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM e{CODE_ROUNDS}) AS codebooks_sha256
FROM found JOIN k USING (r)"""


ORACLE_SQL["op12_part_codes"] = _part_codes_sql()


@query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL["op13_exact_dedup"] = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents) WINDOW w AS (PARTITION BY t)"""
