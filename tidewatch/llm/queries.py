"""Registered queries of this folder and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import (
    additive_quality,
    jaccard_join,
    kd_search,
    license_index,
    line_rules,
    lp_best_fit,
    sentencepieces,
    source_divergence,
    stock_packing,
    subvector_means,
    token_store,
    url_rules,
    weak_pii,
)
from tidewatch.llm.common import documents
from tidewatch.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# Host, path and verdict of the URL rules.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

_UPPER, _LOWER = url_rules.UPPER, url_rules.LOWER


@query(
    "op3_url_rules",
    f"""
WITH a AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), b AS (
  SELECT page_id, rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM a
), c AS (
  SELECT row_number() OVER () AS n, page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(substr(rest, length(raw) + 1), ''), '^[^?#]*') AS path
  FROM b
), rules(h, p, v) AS (
  VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}
), hits AS (
  SELECT n, h || p AS rule, v,
         row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, length(h) DESC, v DESC) AS place
  FROM c JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM c LEFT JOIN (SELECT * FROM hits WHERE place = 1) USING (n)""",
)
def op3_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, folder, "pages"), rules)


_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def line_rules_sql(limit: int = line_rules.LINE_LIMIT) -> str:
    """The line rules with another limit, for tests on small tables."""
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: length(translate(x, {_SPACES}, '')) > 0) AS raw,
         list_filter(list_transform(string_split(regexp_replace(translate(t,
             '{_UPPER}123456789' || chr(9) || chr(11) || chr(12) || chr(13), '{_LOWER}000000000' || '    '),
             ' +', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS norm
  FROM d
), g AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS n
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), r AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat FROM g, (VALUES (0), (1), (2)) s(k) WHERE n > 1 GROUP BY rid
), h AS (
  SELECT rid, host, md5(t) AS doc, list_transform(norm, lambda x: md5(x)) AS hs,
         list_transform(norm, lambda x: len(string_split(x, ' '))) AS ln
  FROM w
), lines AS (
  SELECT rid, host, doc, unnest(hs) AS x, unnest(ln) AS n FROM h
), frequent AS (
  SELECT host, x FROM lines GROUP BY host, x HAVING count(DISTINCT doc) > {limit}
), gone AS (
  SELECT rid, sum(n) AS words, count(*) AS n_lines FROM lines JOIN frequent USING (host, x) GROUP BY rid
), out AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(translate(t, {_SPACES}, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(raw) - len(list_distinct(raw)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_frequent_lines, CAST(coalesce(words, 0) AS BIGINT) AS n_removed_words
  FROM w LEFT JOIN r USING (rid) LEFT JOIN gone USING (rid)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND NOT (n_removed_words > 0 AND 100 * (n_words - n_removed_words) < {line_rules.MIN_LEFT_PERCENT} * n_words)
         AS kept
FROM out"""


@query("op9_line_rules", line_rules_sql())
def op9_line_rules(spark: SparkSession, folder: str) -> DataFrame:
    return line_rules.judge(documents(spark, folder), ["doc_id"])


@query(
    "op10_kd_search",
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
)
def op10_kd_search(spark: SparkSession, folder: str) -> DataFrame:
    return kd_search.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def tokenizer(name: str) -> str:
    """A file of the public tokenizers; the library only ever gets its path."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_stock_packing")
def op4_stock_packing(spark: SparkSession, folder: str) -> DataFrame:
    return stock_packing.pack(documents(spark, folder), tokenizer("byte_bpe_50k.json"))


@query("op6_sentencepieces")
def op6_sentencepieces(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepieces.round_trip(documents(spark, folder), tokenizer("piece_bpe_32k.model"))


@query("op7_token_store")
def op7_token_store(spark: SparkSession, folder: str) -> DataFrame:
    return token_store.round_trip(documents(spark, folder), tokenizer("word_bpe_49k.json"))


@query("op1_weak_pii")
def op1_weak_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return weak_pii.find(docs, weak_pii.fit(docs))


@query("op5_license_index")
def op5_license_index(spark: SparkSession, folder: str) -> DataFrame:
    return license_index.scan(documents(spark, folder))


@query("op8_additive_quality")
def op8_additive_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return additive_quality.score(docs, additive_quality.fit(docs, table(spark, folder, "labels")))


@query(
    "op2_jaccard_join",
    rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g
  FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (g)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.n + ny.n - i)
), r AS (
  SELECT doc_id AS x, doc_id AS c FROM d UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.x
)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(c) AS component_id
FROM d JOIN r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.join(documents(spark, folder))


def _means_sql(rounds: int = 10) -> str:
    """The rounds written out one after the other."""
    parts = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id,
         list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), e) - 1 AS c, e FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id), e) <= 8
)"""
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (
  SELECT v.n, min({{'d': list_sum(list_transform(list_zip(v.e, c{i}.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c}}) AS a
  FROM v CROSS JOIN c{i} GROUP BY v.n
)"""
        )
        if i < rounds:
            parts.append(
                f"""m{i} AS (
  SELECT a.c AS c, k, sum(e[k]) AS s, count(*) AS m FROM v JOIN a{i} USING (n), range(1, 65) r(k) GROUP BY ALL
), c{i + 1} AS MATERIALIZED (
  SELECT c, coalesce(f, e) AS e FROM c{i} LEFT JOIN
    (SELECT c, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY k) AS f FROM m{i} GROUP BY c) USING (c)
)"""
            )
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c{rounds}.e, ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (n) JOIN c{rounds} ON c = a.c"""


@query("op11_subvector_means", _means_sql())
def op11_subvector_means(spark: SparkSession, folder: str) -> DataFrame:
    return subvector_means.cluster(table(spark, folder, "embeddings"))


@query("op12_lp_best_fit")
def op12_lp_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    return lp_best_fit.pack(documents(spark, folder), tokenizer("word_bpe_49k.json"))


_SHARE = "1 + (1000000000 * CAST({0} + 2 AS HUGEINT)) // ({1} + 2 * terms)"


@query(
    "op13_source_divergence",
    rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), t AS (
  SELECT rid, lang, source, unnest(ts) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 10
), size AS (
  SELECT lang, sum(n) AS total, count(*) AS terms FROM kept GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL
), g AS (
  SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = s.lang AND c.source = s.source), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) s
), p AS (
  SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n, {_SHARE.format("coalesce(c.n, 0)", "g.total")} AS p,
         {_SHARE.format("kept.n", "size.total")} AS q
  FROM g JOIN kept USING (lang) JOIN size USING (lang) LEFT JOIN c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
), ranked AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM ranked
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM r WHERE part = 'pair' OR rank <= 10""",
)
def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence.audit(documents(spark, folder))
