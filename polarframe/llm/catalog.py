"""Queries of the operators over the given tables, with the SQL they must agree with where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polarframe.llm import bpe, chosen, fim, flatfiles, jaccard, merkle, packing, passages, pii, quality, search, sharding, toxicity
from polarframe.llm.shared import table
from polarframe.operators.distribute import scratch_path
from polarframe.plans.registry import Query

LLM: dict[str, Query] = {}
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 50256


def query(name: str, sql: str | None = None):
    def register(plan):
        LLM[name] = Query(plan, sql)
        return plan

    return register


@query("op5_two_pass_shuffle")
def two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law of equal row counts, read back from the written shards."""
    shards = sharding.write_shards(table(spark, sf_dir, "documents"), scratch_path(spark, "shards"), 24)
    return shards.select(
        "doc_id", F.col("bytes").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


LINE_FIRST_SQL = """
WITH source AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
split AS (
  SELECT r, doc_id, text, string_split(text, chr(10)) AS all_lines,
         regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM source
),
numbered AS (
  SELECT r, unnest(all_lines) AS line, generate_subscripts(all_lines, 1) AS i FROM split
),
lines AS (
  SELECT r, line, i, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS w,
         row_number() OVER (PARTITION BY r, line ORDER BY i) AS seen
  FROM numbered WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
),
judged AS (
  SELECT r, seen, length(array_to_string(w, '')) AS chars,
    (len(w) < 8 AND NOT contains('.!?"''”’»。！？', right(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1)))
    OR (len(w) > 2 AND w[1] = w[2] AND w[2] = w[3])
    OR (length(line) - length(replace(line, '!!', ''))) / 2.0 * 3 >= len(w)
    OR len(regexp_extract_all(line, '[#*$%&|<>]')) > len(w) * 0.3
    OR regexp_matches(lower(line), 'javascript|cookie policy|privacy policy|terms of use|all rights reserved|lorem ipsum')
    OR seen > 1 AS fails
  FROM lines
),
by_text AS (
  SELECT r, sum(chars) AS total, coalesce(sum(chars) FILTER (NOT fails), 0) AS good,
         count(*) FILTER (seen > 1) AS dups FROM judged GROUP BY r
),
windows AS (
  SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM split WHERE len(words) >= 3)
),
twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows) WHERE n > 1
),
repeats AS (
  SELECT r, sum(step) AS n FROM (
    SELECT r, least(3, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 3)) AS step FROM twice
  ) GROUP BY r
),
counts AS (
  SELECT s.doc_id, len(words)::BIGINT AS n_words, coalesce(t.total, 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(t.dups, 0)::BIGINT AS n_dup_lines,
         coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(t.good, 0) AS good
  FROM split s LEFT JOIN by_text t USING (r) LEFT JOIN repeats p USING (r)
),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND good >= 0.5 * word_chars AS kept
FROM based
"""


@query("op9_line_first", LINE_FIRST_SQL)
def line_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first cleaning of every document; the cleaned texts stay in the operator's result."""
    return quality.clean_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op1_best_fit")
def best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, 1024, 2)


TOP_K_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256.0 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op2_va_file", TOP_K_SQL)
def va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector against all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return search.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


@query("op6_separator_scan")
def separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat files by a scan for the end id."""
    docs = table(spark, sf_dir, "documents")
    return flatfiles.count_tokens(docs, scratch_path(spark, "flat"), TOKENIZER, END_ID).select("doc_id", "n_tokens")


@query("op7_prefix_bpe")
def prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by prefixes and decoded again."""
    return bpe.digests(table(spark, sf_dir, "documents"), TOKENIZER)


@query("op3_candidate_boosting")
def candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans and those that boosted trees add."""
    found = pii.find(table(spark, sf_dir, "documents"), id_col="doc_id")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == pii.KINDS.index(kind))).cast("bigint")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in pii.KINDS], F.sha2(pii.spelled(F.col("base_spans")), 256).alias("base_sha256"),
        pii.spelled(F.col("spans")).alias("spans"),
    )


@query("op4_classifier_chain")
def classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probabilities of being junk and of being toxic, and the verdict."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("junk"), F.col("toxic").alias("toxicity"))
    chain = toxicity.fit_chain(docs, labels, ["junk", "toxicity"])
    return chain.score(docs).select("doc_id", "p_junk", "p_toxicity", "toxic")


NGRAM_SQL = """
WITH source AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
grams AS (
  SELECT DISTINCT doc_id, w[i:i + least(3, len(w)) - 1] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM source WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)
),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  WITH RECURSIVE r AS (SELECT doc_id, doc_id AS seen FROM source UNION SELECT r.doc_id, ways.b FROM r JOIN ways ON ways.a = r.seen)
  SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM reach LEFT JOIN sizes USING (doc_id)
"""


@query("op8_ngram_jaccard", NGRAM_SQL)
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of texts that link by three-word shingles at 90 percent."""
    return jaccard.classes(table(spark, sf_dir, "documents"), 3, 90)


@query("op10_compact_windows")
def compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages of at least 50 words that repeat one of an earlier document."""
    return passages.find(table(spark, sf_dir, "documents"))


@query("op11_chosen_path", NGRAM_SQL.replace("least(3, len(w))", "least(5, len(w))").replace("100 * o >= 90 *", "100 * o >= 85 *").replace(
    "SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id",
    "SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept",
))
def chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of texts that link by five-word shingles at 85 percent; the first of a class is kept."""
    return chosen.classes(table(spark, sf_dir, "documents"), 5, 85).withColumn("kept", F.col("doc_id") == F.col("component_id"))


MERKLE_SQL = """
WITH RECURSIVE crc AS (
  SELECT doc_id, list_reduce(
    list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT),
    lambda acc, c: list_reduce([0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(acc, c)),
    4294967295::BIGINT) AS x
  FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id
),
source_rows AS (
  SELECT d.*, CASE WHEN x IS NOT NULL AND (xor(x, 4294967295) % 2) = 0 THEN replace(text, chr(10), '') ELSE text END AS cut
  FROM documents d LEFT JOIN crc USING (doc_id)
),
field AS (
  SELECT doc_id, source,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail, coalesce(strlen(cut) || ':' || cut, '-') AS cut_tail
  FROM source_rows
),
leaves AS (
  SELECT doc_id, source, sha256(head || tail) AS leaf, sha256(head || cut_tail) AS changed FROM field
),
numbered AS (
  SELECT doc_id, leaf, changed, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
),
low AS (
  SELECT 0 AS level, tree, pos, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM numbered
  UNION ALL
  SELECT level + 1, tree, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), max((n + 2) // 3) FROM low WHERE n > 1 GROUP BY level, tree, pos // 3
),
high AS (
  SELECT 0 AS level, tree AS pos, node, count(*) OVER () AS n FROM low WHERE n = 1
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), max((n + 2) // 3) FROM high WHERE n > 1 GROUP BY level, pos // 3
),
nodes AS (SELECT 0 AS stage, level, tree, pos, node, n FROM low UNION ALL SELECT 1, level, 0, pos, node, n FROM high),
sides AS (
  SELECT stage, level, tree, pos AS place, n,
    string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS behind
  FROM nodes WINDOW w AS (PARTITION BY stage, level, tree, pos // 3 ORDER BY pos)
),
fold AS (
  SELECT doc_id, leaf, tree, pos, 0 AS stage, 0 AS level, pos AS place, changed AS node, '' AS proof FROM numbered
  UNION ALL
  SELECT f.doc_id, f.leaf, f.tree, f.pos, CASE WHEN m.n = 1 THEN f.stage + 1 ELSE f.stage END, CASE WHEN m.n = 1 THEN 0 ELSE f.level + 1 END,
         CASE WHEN m.n = 1 THEN f.tree ELSE f.place // 3 END,
         CASE WHEN m.n = 1 THEN f.node ELSE sha256(coalesce(m.before, '') || f.node || coalesce(m.behind, '')) END,
         f.proof || CASE WHEN m.n = 1 THEN '' ELSE coalesce(m.before, '') || coalesce(m.behind, '') END
  FROM fold f JOIN sides m ON m.stage = f.stage AND m.level = f.level AND m.place = f.place AND (m.tree = f.tree OR f.stage = 1)
)
SELECT f.doc_id, f.leaf, s.node AS subroot, r.node AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = r.node AS verified
FROM fold f JOIN (SELECT tree, node FROM low WHERE n = 1) s USING (tree) CROSS JOIN (SELECT node FROM high WHERE n = 1) r WHERE f.stage = 2
"""


@query("op12_path_copying", MERKLE_SQL)
def path_copying(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and version in the Merkle manifest, the version's root folded from the tampered leaf."""
    rows = merkle.manifest(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


FIM_SQL = """
WITH source AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units FROM documents
),
drawn AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM source
),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
         WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
),
parts AS (
  SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle, array_to_string(units[high + 1:], '') AS suffix
  FROM cut
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""


@query("op13_block_rotation", FIM_SQL)
def block_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document transformed for filling in its middle, and restored."""
    rows = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )
