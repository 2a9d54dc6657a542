"""One query per training-data operator, over the whole table it is meant for, with its oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insight.llm import byte_bpe, chat_trees, collocations, decontamination, divergence, fixity, license_scan, lm_scoring, quality_rules, repair, sharding, simhash, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Conversation -1 of op1 says this twice: control strings inside texts must survive.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op1_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one made of control strings, formatted and read back."""
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    said = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_trees.chat_digest(said.unionByName(extra))


OP1_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', s, 'user', s FROM (SELECT '<|im_end|><|im_start|>assistant ok' AS s)
  UNION ALL SELECT -1, 1, 'assistant', s, 'assistant', s FROM (SELECT '<|im_end|><|im_start|>assistant ok' AS s)),
loss AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learnt,
         length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n'))
         + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 24 AS chars FROM said)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
       CAST(sum(length(learnt)) AS BIGINT) AS loss_chars,
       sha256(string_agg(learnt, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM loss GROUP BY conv_id
"""


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt into 40 shards of the same mixture of sources."""
    return sharding.shard_digest(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and decision of every document by the learned decision list."""
    return quality_rules.quality_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged records that a Merkle audit finds in a replica of all pages' WARC files."""
    return fixity.fixity_audit(_table(spark, sf_dir, "pages"))


OP4_SQL = r"""
WITH rec AS (
  SELECT page_id, url, strlen('WARC/1.0..WARC-Type: resource..WARC-Record-ID: <urn:page:' || page_id || '>..WARC-Target-URI: ' || coalesce(url, '')
         || '..Content-Type: text/html..Content-Length: ' || strlen(coalesce(html, '')) || '........' || coalesce(html, '')) AS n_bytes,
         CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM pages),
filed AS (SELECT *, h % greatest(1, (SELECT CAST(ceil(sum(n_bytes) / 16777216.0) AS BIGINT) FROM rec)) AS file FROM rec),
placed AS (SELECT *, CAST(sum(n_bytes) OVER (PARTITION BY file ORDER BY page_id) AS BIGINT) - n_bytes AS "offset" FROM filed)
SELECT page_id, file, "offset", n_bytes, CASE WHEN page_id % 211 = 11 THEN 'missing' ELSE 'corrupt' END AS status
FROM placed WHERE page_id % 211 = 11 OR page_id % 101 = 7
UNION ALL
SELECT page_id, file, "offset" + 1, n_bytes, 'extra' FROM placed WHERE page_id % 307 = 19
"""


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every document."""
    return byte_bpe.token_digests(_table(spark, sf_dir, "documents"),
                                  public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents, with coverage and spans."""
    return license_scan.license_spans(_table(spark, sf_dir, "documents"), license_scan.notices(spark))


def op7_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum in the grammar-compressed token files."""
    return repair.token_file_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff trigram scores of every document by counts over all documents."""
    return lm_scoring.score_documents(_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
tok AS (SELECT doc_id, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc)),
uni AS (SELECT c, count(*) AS n FROM tok GROUP BY c),
bi AS (SELECT b, c, count(*) AS n FROM tok WHERE i > 1 GROUP BY b, c),
tri AS (SELECT a, b, c, count(*) AS n FROM tok WHERE i > 2 GROUP BY a, b, c),
back AS (SELECT CAST(round_even(ln(0.4) * 1000000, 0) AS BIGINT) AS m),
one AS (SELECT c, CAST(round_even(ln(n / (SELECT count(*) FROM tok)) * 1000000, 0) AS BIGINT) AS m FROM uni),
two AS (SELECT bi.b, bi.c, CASE WHEN bi.n >= 2 THEN CAST(round_even(ln(bi.n / uni.n) * 1000000, 0) AS BIGINT) ELSE back.m + one.m END AS m
        FROM bi JOIN uni ON uni.c = bi.b JOIN one ON one.c = bi.c, back),
three AS (SELECT tri.a, tri.b, tri.c, CASE WHEN tri.n >= 2 THEN CAST(round_even(ln(tri.n / ctx.n) * 1000000, 0) AS BIGINT) ELSE back.m + two.m END AS m
          FROM tri JOIN bi ctx ON ctx.b = tri.a AND ctx.c = tri.b JOIN two ON two.b = tri.b AND two.c = tri.c, back),
term AS (SELECT t.doc_id, CASE i WHEN 1 THEN one.m WHEN 2 THEN two.m ELSE three.m END AS m
         FROM tok t JOIN one ON one.c = t.c LEFT JOIN two ON two.b = t.b AND two.c = t.c LEFT JOIN three ON three.a = t.a AND three.b = t.b AND three.c = t.c),
per AS (SELECT doc_id, CAST(sum(m) AS BIGINT) AS log_micro FROM term GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(log_micro, 0) AS log_micro,
       CASE WHEN len(w) > 0 THEN log_micro / len(w) / 1000000.0::DOUBLE END AS mean_log_score
FROM doc d LEFT JOIN per p ON d.doc_id = p.doc_id
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document (3-word shingles, two bits)."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document (windows of ten words)."""
    return decontamination.decontamination_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS win, least(10, len(w)) AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
spot AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc),
found AS (
  SELECT s.doc_id, s.i, n.k, n.item_id
  FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
        FROM spot, (SELECT DISTINCT k FROM win) WHERE i + k - 1 <= len(w)) s JOIN win n ON s.win = n.win AND s.k = n.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY 1),
own AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN own o ON d.doc_id = o.doc_id
"""

def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by weak supervision."""
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two or three words of each language, by counts over all documents."""
    return collocations.collocations(_table(spark, sf_dir, "documents"), top=2000, least=10, share=50)


OP12_SQL = r"""
WITH piece AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
gram AS (
  SELECT lang, k, g, count(*) AS a FROM (
    SELECT lang, k, w[i:i + k - 1] AS g FROM (
      SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM piece, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k))
  GROUP BY lang, k, g),
size AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM gram WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, g, a FROM gram WHERE k > 1 AND a >= 10),
cut AS (
  SELECT c.lang, c.k, c.g, c.a, l.k AS j, l.a AS l, r.a AS r, (1000000::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a) AS score
  FROM cand c JOIN gram l ON l.lang = c.lang AND l.k < c.k AND l.g = c.g[1:l.k]
              JOIN gram r ON r.lang = c.lang AND r.k = c.k - l.k AND r.g = c.g[l.k + 1:c.k]),
scored AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) AS q FROM cut) WHERE q = 1),
longer AS (
  SELECT lang, g, max(a) AS a FROM (SELECT lang, g[1:2] AS g, a FROM cand WHERE k = 3 UNION ALL SELECT lang, g[2:3], a FROM cand WHERE k = 3)
  GROUP BY lang, g),
alive AS (
  SELECT s.*, array_to_string(s.g, ' ') AS phrase FROM scored s LEFT JOIN longer x ON s.k = 2 AND x.lang = s.lang AND x.g = s.g
  WHERE x.a IS NULL OR 100 * x.a < 50 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM alive)
SELECT r.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked r JOIN size z ON z.lang = r.lang WHERE rank <= 2000
"""

def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every pair of sources of a language, and each source's ten most typical terms."""
    return divergence.audit(_table(spark, sf_dir, "documents"), least_docs=10, top=10)


OP13_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
occ AS (SELECT lang, source, d, term, count(*) AS n FROM (SELECT lang, source, d, unnest(w) AS term FROM doc) GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM occ GROUP BY lang, term HAVING count(*) >= 10),
cell AS (SELECT lang, source, term, CAST(sum(o.n) AS BIGINT) AS n FROM occ o SEMI JOIN kept k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v, CAST(sum(n) AS HUGEINT) AS t FROM kept GROUP BY lang),
grp AS (SELECT g.lang, g.source, coalesce(t, 0)::HUGEINT AS t
        FROM (SELECT DISTINCT lang, source FROM doc) g LEFT JOIN (SELECT lang, source, sum(n) AS t FROM cell GROUP BY lang, source) c
          ON c.lang = g.lang AND c.source = g.source),
share AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.t + 2 * v.v) AS BIGINT) AS p,
         CAST(1 + 1000000000::HUGEINT * (k.n + 2) // (v.t + 2 * v.v) AS BIGINT) AS q
  FROM grp g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang
    LEFT JOIN cell c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
total AS (
  SELECT x.lang, x.source, y.source AS item, CAST(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS BIGINT) AS value
  FROM share x JOIN share y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(t.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN total t ON t.lang = a.lang AND t.source = a.source AND t.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM share WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
           FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

QUERIES = {
    "op1_chat_trees": op1_chat_trees,
    "op2_sharding": op2_sharding,
    "op3_quality_rules": op3_quality_rules,
    "op4_fixity": op4_fixity,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_license_scan": op6_license_scan,
    "op7_repair": op7_repair,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_simhash": op9_simhash,
    "op10_decontamination": op10_decontamination,
    "op11_toxicity": op11_toxicity,
    "op12_collocations": op12_collocations,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_trees": OP1_SQL,
    "op4_fixity": OP4_SQL,
    "op8_lm_scoring": OP8_SQL,
    "op10_decontamination": OP10_SQL,
    "op12_collocations": OP12_SQL,
    "op13_source_divergence": OP13_SQL,
}
