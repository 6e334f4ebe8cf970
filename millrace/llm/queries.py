"""The registered queries of the numbered operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.ann import search
from millrace.llm.decontamination import contamination_report
from millrace.llm.exact_dedup import exact_groups
from millrace.llm.html_extraction import extract
from millrace.llm.merkle import manifest, newlines_deleted
from millrace.llm.ngram_join import ngram_components
from millrace.llm.packing import pack_documents
from millrace.llm.sentencepiece_codec import encode_documents
from millrace.llm.sharding import shard_documents
from millrace.llm.substring_dedup import remove_repeats
from millrace.llm.toxicity import score_documents
from millrace.llm.vector_codes import code_report
from millrace.llm.warc import archive_report


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op4_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op5_adaptive_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op6_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op8_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_report(table(spark, sf_dir, "pages"))


def op9_substring_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), newlines_deleted(F.col("doc_id"), F.col("text")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_report(table(spark, sf_dir, "embeddings"))


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_html_min_cut,
        op2_best_fit_packing,
        op3_hilbert_sharding,
        op4_inverted_multi_index,
        op5_adaptive_prefix_join,
        op6_sentencepiece_codec,
        op7_exact_dedup,
        op8_warc_capture_index,
        op9_substring_fm_index,
        op10_toxicity,
        op11_merkle_manifest,
        op12_vector_codes,
        op13_benchmark_decontamination,
    )
    return {f.__name__: f for f in found}


OP7_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id,
  max(doc_id) OVER g AS keep_id,
  count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept,
  text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) END) AS shingle
  FROM w
), n AS (
  SELECT doc_id, count(shingle) AS n_shingles FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b, shared = x.n_shingles AND shared = y.n_shingles AS same
  FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n_shingles + y.n_shingles - shared)
), classes AS (
  SELECT doc_id, least(doc_id, min(b) FILTER (same)) AS class FROM n LEFT JOIN links ON a = doc_id GROUP BY doc_id
), others AS (
  SELECT a AS doc_id, count(DISTINCT class) AS n_links FROM links JOIN classes ON doc_id = b WHERE NOT same GROUP BY a
), reach AS (
  SELECT doc_id AS start, doc_id AS reached FROM n
  UNION
  SELECT start, b FROM reach JOIN links ON a = reached
)
SELECT n.doc_id, n_shingles, coalesce(n_links, 0) AS n_links, min(reached) AS component_id
FROM n JOIN reach ON start = n.doc_id LEFT JOIN others ON others.doc_id = n.doc_id GROUP BY ALL
"""

OP8_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
best AS (SELECT payload_digest, max(page_id) AS page FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page <> page_id THEN page END AS refers_to
FROM p LEFT JOIN best USING (payload_digest)
"""

OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(words) - 48)) AS i, words FROM w WHERE len(words) >= 50
), hashed AS (
  SELECT doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) AS h FROM windows
), firsts AS (
  SELECT h, min(doc_id) AS first_doc FROM hashed GROUP BY h
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS places
  FROM hashed JOIN firsts USING (h) WHERE first_doc < doc_id GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN places IS NULL THEN words
    ELSE list_filter(words, lambda x, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)], lambda x: coalesce(strlen(x) || ':' || x, '-')) AS head,
    list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
        lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END)) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, source, sha256(array_to_string(head, '') || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, CAST(4294967295 AS BIGINT)) % 2 = 0
      THEN sha256(array_to_string(head, '') || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS tampered,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS place
  FROM d
), trees AS (
  SELECT source, 0 AS level, list(leaf ORDER BY place) AS nodes FROM leaves GROUP BY source
  UNION ALL
  SELECT source, level + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1 : i + 3], ''))) FROM trees WHERE len(nodes) > 1
), subroots AS (
  SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM trees WHERE len(nodes) = 1
), tops AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1 : i + 3], ''))) FROM tops WHERE len(nodes) > 1
), levels AS (
  SELECT source, list(nodes ORDER BY level) AS levels FROM trees WHERE len(nodes) > 1 GROUP BY source
), top_levels AS (
  SELECT list(nodes ORDER BY level) AS levels FROM tops WHERE len(nodes) > 1
), runs AS (
  SELECT doc_id, leaf, tampered, subroot, (SELECT nodes[1] FROM tops WHERE len(nodes) = 1) AS root,
    list_concat(
      list_transform(coalesce(l.levels, []), lambda nodes, k: {'run': nodes[v.place // CAST(3 ** k AS BIGINT) * 3 + 1 : v.place // CAST(3 ** k AS BIGINT) * 3 + 3], 'at': v.place // CAST(3 ** (k - 1) AS BIGINT) % 3 + 1}),
      list_transform(coalesce((SELECT levels FROM top_levels), []), lambda nodes, k: {'run': nodes[s.place // CAST(3 ** k AS BIGINT) * 3 + 1 : s.place // CAST(3 ** k AS BIGINT) * 3 + 3], 'at': s.place // CAST(3 ** (k - 1) AS BIGINT) % 3 + 1})
    ) AS steps
  FROM leaves v JOIN subroots s ON s.source IS NOT DISTINCT FROM v.source LEFT JOIN levels l ON l.source IS NOT DISTINCT FROM v.source
), folds AS (
  SELECT doc_id, 0 AS done, steps, coalesce(tampered, leaf) AS node, leaf, subroot, root FROM runs
  UNION ALL
  SELECT doc_id, done + 1, steps, sha256(array_to_string(list_transform(steps[done + 1].run, lambda x, i: CASE WHEN i = steps[done + 1].at THEN node ELSE x END), '')), leaf, subroot, root
  FROM folds WHERE done < len(steps)
)
SELECT doc_id, leaf, subroot, root,
  sha256(array_to_string(list_transform(steps, lambda s: array_to_string(list_filter(s.run, lambda x, i: i <> s.at), '')), '')) AS proof_sha256,
  node AS folded_root, node = root AS verified
FROM folds WHERE done = len(steps)
"""


def lloyd_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The rounds one after another: each has its codebook (part, entry, c) and the nearest entry of each part."""
    nearest = """
), near{r} AS MATERIALIZED (
  SELECT vec_id, p.part, v, min(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 1000 + entry) AS best
  FROM parts p JOIN book{r} b ON b.part = p.part GROUP BY ALL"""
    update = """
), book{n} AS MATERIALIZED (
  SELECT b.part, b.entry, CASE WHEN any_value(s.c) IS NULL THEN any_value(b.c) ELSE any_value(s.c) END AS c
  FROM book{r} b LEFT JOIN (
    SELECT part, entry, list(m ORDER BY j) AS c FROM (
      SELECT part, CAST(best % 1000 AS BIGINT) AS entry, j, (CAST(sum(v[j]) AS BIGINT) - ((CAST(sum(v[j]) AS BIGINT) % count(*)) + count(*)) % count(*)) // count(*) AS m
      FROM near{r}, (SELECT unnest(range(1, (SELECT any_value(len(v)) + 1 FROM parts))) AS j) GROUP BY ALL
    ) GROUP BY ALL
  ) s ON s.part = b.part AND s.entry = b.entry GROUP BY b.part, b.entry"""
    steps = "".join(nearest.format(r=r) + update.format(r=r, n=r + 1) for r in range(rounds)) + nearest.format(r=rounds)
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS ints
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, part, ints[part * (len(ints) // {parts}) + 1 : (part + 1) * (len(ints) // {parts})] AS v FROM kept, (SELECT unnest(range({parts})) AS part)
), book0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS c FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}){steps}
), coded AS (
  SELECT vec_id, string_agg(printf('%02x', CAST(best % 1000 AS BIGINT)), '' ORDER BY part) AS code, CAST(sum(best // 1000) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), strings AS (
  SELECT DISTINCT item, least(len(words), 10) AS n, unnest(list_transform(range(1, greatest(2, len(words) - 8)), lambda i: array_to_string(words[i : i + 9], ' '))) AS string FROM b WHERE len(words) > 0
), places AS (
  SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS place FROM d, (SELECT DISTINCT n FROM strings) WHERE len(words) >= n
), found AS (
  SELECT doc_id, place, p.n, item FROM (SELECT doc_id, place, n, array_to_string(words[place : place + n - 1], ' ') AS string FROM places) p JOIN strings s ON s.string = p.string AND s.n = p.n
), hit AS (
  SELECT doc_id, len(list_distinct(flatten(list(range(place, place + n))))) AS n_hit, list_sort(list_distinct(list(item))) AS items FROM found GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_adaptive_prefix_join": OP5_SQL,
        "op7_exact_dedup": OP7_SQL,
        "op8_warc_capture_index": OP8_SQL,
        "op9_substring_fm_index": OP9_SQL,
        "op11_merkle_manifest": OP11_SQL,
        "op12_vector_codes": lloyd_sql(),
        "op13_benchmark_decontamination": OP13_SQL,
    }
