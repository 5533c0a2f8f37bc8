"""Registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from corpusloom.llm import align, chat, exact_dedup, merkle, mixing, packing, phrases, pii, quality, simhash, suffix_dedup, toxicity, url_filter
from corpusloom.llm.common import held_out, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document. A null or empty text scores as one without evidence; equal texts score alike; each row stays. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.with_scores(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents. Null texts have no words, a null source is the last; ties and repeated rows as in mixing.mix(). An empty table gives no rows."""
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents. Null, empty and blank texts are equal; null ids come last; each row has its row. An empty table gives no rows."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts. Null texts are empty; equal ids are ordered by text; one row follows itself. An empty table gives no rows."""
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats that every document loses. Null texts are empty; equal ids come in the order of the table, null ids last. An empty table gives no rows."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document. Null and empty texts have none; each row is searched. An empty table gives no rows."""
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document. Null and empty texts have a score too; equal texts score alike; each row stays. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.with_scores(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences. Null and empty texts are the end id alone; each row is packed. An empty table gives no rows."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page. Null and malformed urls have empty parts and are allowed; each row is judged. An empty table gives no rows."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies of every document. Texts without words have fingerprint zero; null ids come last; each row has its row. An empty table gives no rows."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tokenizers' tokens of every document. Null and empty texts have none; each row counts as a document. An empty table gives no rows."""
    return align.align_report(table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language's phrases. Null texts are empty, a null language is `und`; repeated rows each count; ties go by phrase. An empty table gives no rows."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold the template's own control strings. Null texts and roles are empty; rows of one
    turn each count, in the order of the table's files; null conversations are one."""
    log = chat.log_of(table(spark, sf_dir, "conversations"))
    hostile = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("message"), F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("seq"),
        F.lit(chat.DELTA_KIND).alias("kind"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return chat.format_report(log.unionByName(hostile))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_mixing, op3_exact_dedup, op4_merkle, op5_suffix_dedup, op6_pii, op7_quality, op8_packing, op9_url_filter, op10_simhash, op11_alignment, op12_phrases, op13_chat)
}

_SPACE = r"[\x20\x09-\x0D]"


def _strings(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{x}'" for x in words)


ORACLE_SQL: dict[str, str] = {
    "op2_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
r AS (
  SELECT *, cap / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS total,
         coalesce(sum(cap) OVER f, 0) AS clamped, sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS open
  FROM w WINDOW f AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - clamped) / open AS level FROM r),
t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, ratio) FROM l WHERE level <= ratio) * weight, cap))::DOUBLE AS target FROM l),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS whole,
         floor(target + 0.5)::BIGINT - CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END * source_size AS rest FROM t),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d)
SELECT o.doc_id, o.size, g.source_size, g.target, (g.whole * o.size + greatest(0, least(o.size, g.rest - o.before)))::BIGINT AS taken
FROM o JOIN g ON o.source IS NOT DISTINCT FROM g.source""",
    "op3_exact_dedup": rf"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g') AS x FROM documents),
k AS (SELECT doc_id, x, first_value(doc_id) OVER (PARTITION BY x ORDER BY length(t) DESC, doc_id NULLS LAST) AS keep_id,
             count(*) OVER (PARTITION BY x) AS group_size FROM n)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM k""",
    "op4_merkle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS rn, count(*) OVER () AS n FROM documents),
x AS (SELECT a.rn, a.doc_id, a.t, b.t AS nx FROM d a JOIN d b ON b.rn = a.rn % a.n + 1),
l AS (
  SELECT rn, 1 AS kind, t FROM x UNION ALL
  SELECT rn, 2, substr(t, 1, length(t) - length(t) // 4) || substr(nx, 1, length(t) // 4) FROM x UNION ALL
  SELECT rn, 3, nx FROM x),
p AS (
  SELECT rn, kind, t, list_transform(string_split(t, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda q: {
    'h': sha256(q), 'n': length(q),
    'b': list_transform(list_concat(list_concat(regexp_extract_all(substr(q, 1, 8), '(?s).{1,2}'), regexp_extract_all(substr(q, 9, 24), '(?s).{1,8}')),
      regexp_extract_all(substr(q, 33), '(?s).{1,32}')), lambda b: substr(md5(b), 1, 6))})) AS ss
  FROM l),
s AS (SELECT rn, kind, t, ss, list_transform(ss, lambda s: sha256(array_to_string(list_transform(s, lambda q: q.h), ''))) AS hs FROM p),
f AS (
  SELECT rn, kind, t, substr(sha256(array_to_string(hs, '')), 1, 32) AS root,
    array_to_string(list_transform(range(1, 1 + len(ss)), lambda i: substr(hs[i], 1, 8) || '(' ||
      array_to_string(list_transform(ss[i], lambda q: substr(q.h, 1, 8) || '.' || q.n::VARCHAR || '.' || array_to_string(q.b, '')), ';') || ')'), '') AS body
  FROM s),
u1 AS (SELECT rn, kind, unnest(range(1, 1 + len(ss))) AS i, unnest(ss) AS ps FROM s),
u2 AS (SELECT rn, kind, i, unnest(range(1, 1 + len(ps))) AS j, unnest(ps) AS q FROM u1),
sizes AS (SELECT rn, kind, sum(q.n) AS n FROM u2 GROUP BY rn, kind),
pairs AS (SELECT a.rn, b.kind, a.q AS p, b.q AS q FROM u2 a JOIN u2 b ON a.rn = b.rn AND a.i = b.i AND a.j = b.j AND a.kind = 1 AND b.kind > 1),
blocks AS (SELECT rn, kind, p.n AS n, unnest(range(0, len(p.b))) AS k, unnest(p.b) AS x, q.b AS other FROM pairs WHERE p.h <> q.h),
spans AS (
  SELECT rn, kind, least(CASE WHEN k < 4 THEN 2 WHEN k < 7 THEN 8 ELSE 32 END, n - CASE WHEN k < 4 THEN 2 * k WHEN k < 7 THEN 8 + 8 * (k - 4) ELSE 32 * (k - 6) END) AS n
  FROM blocks WHERE x = other[k + 1]
  UNION ALL SELECT rn, kind, p.n FROM pairs WHERE p.h = q.h),
e AS (SELECT rn, kind, sum(n) AS n FROM spans GROUP BY rn, kind),
near AS (
  SELECT z.rn, z.kind, CASE WHEN fa.root = fz.root THEN 1.0::DOUBLE ELSE coalesce(e.n, 0)::DOUBLE / greatest(o.n, z.n, 1) END AS likeness
  FROM sizes z JOIN sizes o ON o.rn = z.rn AND o.kind = 1 AND z.kind > 1 JOIN f fa ON fa.rn = z.rn AND fa.kind = 1 JOIN f fz ON fz.rn = z.rn AND fz.kind = z.kind
  LEFT JOIN e ON e.rn = z.rn AND e.kind = z.kind)
SELECT x.doc_id, length(a.t)::BIGINT AS n_chars, sha256(e.t) AS edited_sha256, a.root || ':' || a.body AS fingerprint, e.root || ':' || e.body AS edited_fingerprint,
  ne.likeness AS near_edited, nn.likeness AS near_next
FROM x JOIN f a ON a.rn = x.rn AND a.kind = 1 JOIN f e ON e.rn = x.rn AND e.kind = 2
JOIN near ne ON ne.rn = x.rn AND ne.kind = 2 JOIN near nn ON nn.rn = x.rn AND nn.kind = 3""",
    "op5_suffix_dedup": """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS rn, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT rn, i, array_slice(b, i, i + 99) AS s FROM (SELECT rn, b, unnest(range(1, octet_length(b) - 98)) AS i FROM d WHERE octet_length(b) >= 100)),
r AS (SELECT rn, i, row_number() OVER (PARTITION BY s ORDER BY rn, i) AS k FROM w),
g AS (SELECT rn, i, CASE WHEN i - lag(i) OVER (PARTITION BY rn ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM r WHERE k > 1),
h AS (SELECT rn, i, sum(fresh) OVER (PARTITION BY rn ORDER BY i) AS run FROM g),
p AS (SELECT rn, run, min(i) AS a, max(i) + 99 AS z FROM h GROUP BY rn, run),
l AS (SELECT rn, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, sum(z - a + 1)::BIGINT AS n_removed, count(*) AS n_spans FROM p GROUP BY rn)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN n_spans IS NULL THEN sha256(b) ELSE sha256(unhex(array_to_string(list_transform(range(1, n_spans + 2), lambda k:
    CASE WHEN (CASE WHEN k = 1 THEN 1 ELSE z[k - 1] + 1 END) <= (CASE WHEN k > n_spans THEN octet_length(b) ELSE a[k] - 1 END)
      THEN hex(array_slice(b, CASE WHEN k = 1 THEN 1 ELSE z[k - 1] + 1 END, CASE WHEN k > n_spans THEN octet_length(b) ELSE a[k] - 1 END)) ELSE '' END), ''))) END AS kept_sha256
FROM d LEFT JOIN l USING (rn)""",
    "op9_url_filter": rf"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS (
  SELECT *,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p),
listed AS (
  SELECT a || '-' || b || '.' || z AS name FROM unnest([{_strings(url_filter.LISTED_FIRST)}]) x(a), unnest([{_strings(url_filter.LISTED_SECOND)}]) y(b),
    unnest([{_strings(url_filter.LISTED_UNDER)}]) w(z)),
bad AS (SELECT DISTINCT h.host FROM (SELECT DISTINCT host FROM p) h, listed WHERE h.host = name OR ends_with(h.host, '.' || name))
SELECT page_id, host, path, rule,
  CASE rule WHEN 'org/' THEN 'allow' WHEN 'com/fr/' THEN 'allow' WHEN 'example.org/es/' THEN 'block' WHEN 'example.org/en/1' THEN 'block'
    WHEN 'com/de/' THEN 'block'
    ELSE CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END END AS verdict
FROM f""",
    "op12_phrases": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
u AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (
  SELECT lang, k AS words, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM u, (VALUES (1), (2), (3), (4), (5)) v(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE words = 1 GROUP BY lang),
h AS (SELECT *, string_split(phrase, ' ') AS ws FROM g WHERE f >= 100),
c AS (SELECT *, unnest(range(1, words)) AS k FROM h WHERE words > 1),
s AS (
  SELECT c.lang, c.phrase, c.f AS a, c.k, l.f AS l, r.f AS r, n.n, 1000::HUGEINT * c.f * n.n // (l.f::HUGEINT * r.f) AS score
  FROM c JOIN h l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:c.k], ' ')
  JOIN h r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.k + 1:], ' ') JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (
  SELECT lang, array_to_string(ws[x:x + y - 1], ' ') AS phrase, max(f) AS held
  FROM (SELECT *, unnest(range(1, words + 1)) AS x FROM h WHERE words > 2), (VALUES (2), (3), (4)) v(y) WHERE y < words AND x + y - 1 <= words GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, b.n::BIGINT AS n, b.score::BIGINT AS score
FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.held IS NULL OR 100 * i.held < 100 * b.a
QUALIFY rank <= 2000""",
    "op13_chat": rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') AS safe,
    CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'tool' THEN 'Tool'
      ELSE 'role ' || replace(replace(replace(replace(role, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>'), ':', '\:') END AS name FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || name || ': ' || safe || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
}
