"""The subpackage's queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from neartide.sources.tables import table


def op1_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from neartide.llm import pii

    return pii.find(table(spark, sf_dir, "documents"))


def op2_rlz_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from neartide.llm import rlz

    return rlz.parse(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_bin_completion_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from neartide.llm import packing

    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from neartide.llm import simhash

    return simhash.classes(table(spark, sf_dir, "documents"))


def op5_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from neartide.llm import decontaminate

    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from neartide.llm import licenses

    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_prefix_forest_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from neartide.llm import forest

    return forest.nearest(table(spark, sf_dir, "embeddings"))


def op8_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from neartide.llm import sharding

    return sharding.assign(table(spark, sf_dir, "documents"))


def op9_hashed_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from neartide.llm import maxent

    return maxent.score(table(spark, sf_dir, "documents"))


def op10_hierarchical_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from neartide.llm import quality

    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_skip_chain_pii": op1_skip_chain_pii,
    "op2_rlz_substring_dedup": op2_rlz_substring_dedup,
    "op3_bin_completion_packing": op3_bin_completion_packing,
    "op4_simhash_tiles": op4_simhash_tiles,
    "op5_positional_decontamination": op5_positional_decontamination,
    "op6_license_paragraphs": op6_license_paragraphs,
    "op7_prefix_forest_ann": op7_prefix_forest_ann,
    "op8_virtual_slot_sharding": op8_virtual_slot_sharding,
    "op9_hashed_maxent_lm": op9_hashed_maxent_lm,
    "op10_hierarchical_quality": op10_hierarchical_quality,
}

#: The other operators' results are models, placements or hashes that SQL has no function for; the tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_rlz_substring_dedup": r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS run FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS i FROM doc)),
least AS (SELECT run, min(doc_id) AS earliest FROM win GROUP BY run),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place FROM win JOIN least USING (run) WHERE earliest < doc_id),
word AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS place FROM doc),
mark AS (SELECT word.*, gone.place IS NOT NULL AS out FROM word LEFT JOIN gone USING (doc_id, place)),
kept AS (SELECT doc_id, count(*) AS n, count_if(out)::BIGINT AS removed, string_agg(w, ' ' ORDER BY place) FILTER (WHERE NOT out) AS text FROM mark GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM doc LEFT JOIN kept USING (doc_id)""",
    "op5_positional_decontamination": r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
asked AS (SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS run FROM (SELECT item_id, ws, least(10, len(ws)) AS size, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM item WHERE len(ws) > 0)),
win AS (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS run FROM (SELECT doc_id, ws, size, unnest(range(1, greatest(len(ws) - size + 2, 1))) AS i FROM doc CROSS JOIN (SELECT DISTINCT size FROM asked))),
met AS (SELECT doc_id, size, i, item_id FROM win JOIN asked USING (size, run)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM met) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM met) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op7_prefix_forest_ann": """
WITH vec AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM vec q JOIN vec c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored) WHERE rank <= 20""",
}
