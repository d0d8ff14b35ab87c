"""The registered queries of the operators, each over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorespark.llm import brown, decontamination, fingerprints, html, merkle, mixing, pii, sentences, simhash, suffixes, toxicity, urls, variants


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(_table(spark, sf_dir, "documents")).drop("kept")


def op5_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_table(spark, sf_dir, "documents"))


def op7_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.deduplicate(_table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("key")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(_table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_mixing, op3_urls, op4_suffixes, op5_brown,
        op6_simhash, op7_sentences, op8_fingerprints, op9_toxicity, op10_pii,
        op11_html, op12_variants, op13_merkle,
    )
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1_SQL = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[s:s + least(10, len(ws)) - 1], ' ') AS phrase
  FROM (SELECT item_id, ws, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) AS s FROM item WHERE len(ws) > 0)
), gram AS (
  SELECT doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS s FROM w, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)
), hit AS (
  SELECT doc_id, item_id, s, n FROM gram JOIN win USING (n, phrase)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
), slot AS (
  SELECT item_id, unnest(list_distinct(ws)) AS term FROM item WHERE len(ws) > 0
), place AS (
  SELECT doc_id, ws[p] AS term, CAST(floor((p - 1) / 20) AS BIGINT) AS block FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS p FROM w) WHERE ws[p] IN (SELECT term FROM slot)
), freq AS (
  SELECT term, count(*) AS f FROM place GROUP BY term
), ranked AS (
  SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(f, 0), term) AS r, least(3, count(*) OVER (PARTITION BY item_id)) AS needed FROM slot LEFT JOIN freq USING (term)
), beside AS (
  SELECT doc_id, item_id, r, needed, unnest([block - 1, block]) AS b FROM place JOIN ranked USING (term) WHERE r <= 3
), near AS (
  SELECT doc_id, count(*) AS n_near, string_agg(item_id, ',' ORDER BY item_id) AS near_ids
  FROM (SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, item_id, b FROM beside GROUP BY doc_id, item_id, b HAVING count(DISTINCT r) >= min(needed))) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, sha256(coalesce(near_ids, '')) AS near_sha256
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""

OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ticket FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
    2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s
), o AS (
  SELECT *, most / weight AS full_at FROM w
), l AS (
  SELECT *, (total - coalesce(sum(most) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o
), t AS (
  SELECT source, source_size,
    CASE WHEN level >= full_at THEN most ELSE weight * max(CASE WHEN level < full_at THEN level END) OVER () END AS target FROM l
), q AS (
  SELECT *, CAST(least(floor(target / greatest(source_size, 1) + 1e-9), 2) AS BIGINT) AS whole FROM t
), r AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, CAST(floor(q.target + 1e-6) AS BIGINT) - q.whole * q.source_size AS quota,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ticket, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS ahead
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, quota - ahead)) AS BIGINT) AS taken FROM r
"""

_CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY i) AS crc_of FROM (SELECT i, list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, i::BIGINT) AS c FROM range(256) r(i)))"""


def _crc(s: str) -> str:
    """SQL for the crc32 of a string's UTF-8 bytes, unsigned."""
    return f"xor(4294967295::BIGINT, list_reduce(list_transform(range(0, octet_length(encode({s}))), lambda k: CAST('0x' || substr(hex(encode({s})), 2 * k + 1, 2) AS BIGINT)), lambda c, b: xor(crc_of[xor(c, b) % 256 + 1], c >> 8), 4294967295::BIGINT))"


OP12_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE}, found AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{7,}}')), {_AZ}) AS run FROM documents
), each AS (
  SELECT doc_id, run, count(*) AS k FROM found GROUP BY doc_id, run
), hashed AS (
  SELECT run, k, {_crc("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM each, crc_table
), made AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, k FROM hashed
), words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), cuts AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS form, max(other_n) AS form_n FROM pairs GROUP BY word
), forms AS (
  SELECT word, n, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n, coalesce(n_near, 0) AS n_near FROM words LEFT JOIN best USING (word)
), steps AS (
  SELECT word, word AS root FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL
), roots AS (
  SELECT s.word, s.root FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NULL
)
SELECT word, n, form, form_n, root, n_near FROM forms JOIN roots USING (word)
"""


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


OP13_SQL = f"""
WITH RECURSIVE {_CRC_TABLE}, leaves AS (
  SELECT doc_id, lang, {_leaf('n_chars')} AS leaf, CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf('(n_chars + 1)')} ELSE {_leaf('n_chars')} END AS given FROM documents, crc_table
), laid AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), nodes AS (
  SELECT lang, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY lang) AS width FROM laid
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (max(width) + 1) // 2 FROM nodes WHERE width > 1 GROUP BY lang, level, pos // 2
), subroots AS (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place FROM nodes WHERE width = 1
), tops AS (
  SELECT 0 AS level, place AS pos, subroot AS digest, count(*) OVER () AS width FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (max(width) + 1) // 2 FROM tops WHERE width > 1 GROUP BY level, pos // 2
), way AS (
  SELECT l.doc_id, l.leaf, l.given, l.lang, l.pos AS leaf_pos, n.level AS step, (l.pos >> n.level) % 2 = 1 AS ahead, b.digest AS sibling
  FROM laid l JOIN (SELECT DISTINCT lang, level FROM nodes WHERE width > 1) n ON n.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN nodes b ON b.lang IS NOT DISTINCT FROM l.lang AND b.level = n.level AND b.pos = xor(l.pos >> n.level, 1)
  UNION ALL
  SELECT l.doc_id, l.leaf, l.given, l.lang, l.pos, 100 + n.level, (s.place >> n.level) % 2 = 1, b.digest
  FROM laid l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang, (SELECT DISTINCT level FROM tops WHERE width > 1) n
  LEFT JOIN tops b ON b.level = n.level AND b.pos = xor(s.place >> n.level, 1)
), paths AS (
  SELECT lang, leaf_pos, list({{'ahead': ahead, 'sibling': coalesce(sibling, '')}} ORDER BY step) AS path, coalesce(string_agg(sibling, '' ORDER BY step), '') AS others FROM way GROUP BY lang, leaf_pos
), done AS (
  SELECT l.doc_id, l.leaf, s.subroot, (SELECT digest FROM tops WHERE width = 1) AS root, sha256(coalesce(others, '')) AS proof_sha256,
    CASE WHEN path IS NULL THEN l.given ELSE list_reduce(list_transform(path, lambda p: p.ahead::INTEGER || p.sibling), lambda own, p: sha256(CASE WHEN p[1] = '1' THEN p[2:] || own ELSE own || p[2:] END), l.given) END AS folded_root
  FROM laid l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM l.lang AND p.leaf_pos = l.pos
)
SELECT *, folded_root = root AS verified FROM done
"""


OP11_SQL = r"""
WITH parts AS (
  SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS ps FROM pages
), plain AS (
  SELECT page_id, url, list_transform(ps, lambda p: regexp_replace(replace(replace(replace(regexp_replace(p, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;?', '&', 'g')) AS ps FROM parts
), joined AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(ps, lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: p <> ''), chr(10) || chr(10)) AS text FROM plain
)
SELECT page_id, url, text, CAST(len(text) AS BIGINT) AS n_chars FROM joined
"""

ORACLES: dict[str, str] = {
    "op1_decontamination": OP1_SQL, "op2_mixing": OP2_SQL, "op11_html": OP11_SQL, "op12_variants": OP12_SQL, "op13_merkle": OP13_SQL,
}
