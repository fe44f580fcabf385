"""The queries of the text problems, over the whole tables of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.llm import canonical, leaks, names, pii, tokens
from planloom.session import read


def p3_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of both tables with its canonical status, how it was found and the score."""
    names = read(spark, sf_dir, "status_reference")
    parts = []
    for table, column in (("external_input", "completion_status"), ("legacy_tasks", "status")):
        m = canonical.match_canonical(read(spark, sf_dir, table), column, names, "status_id", "status_name", ["row_id"], canonical.STATUS_ALIASES, canonical.STATUS_NOISE)
        parts.append(m.select(F.lit(table).alias("src"), "row_id", F.col("canonical_id").alias("status_id"), "how", "score"))
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_matched(spark, sf_dir).where(~F.col("how").isin("empty", "exact")).select("src", "row_id", "status_id")


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "external_input")
    both = df.select("project", F.explode(F.array("assigned_member", "task_leader")).alias("name"))
    return names.link_names(both)


def p6_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct name of a project with the number of the person or organisation it means."""
    return _entities(spark, sf_dir)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.variant_pairs(_entities(spark, sf_dir))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(read(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items")).where("n_words > 0").select("doc_id", "item_id")


def p8_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and item with a window at least similar, how many words are shared and the best similarity."""
    return leaks.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read(spark, sf_dir, "documents")).select("doc_id", "kind", "pii_text").distinct()


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with typed placeholders in place of personal information."""
    docs = read(spark, sf_dir, "documents")
    return pii.redact(docs, pii.find_pii(docs)).select("doc_id", "redacted")


QUERIES = {"p9_found": p9_found, "p9_redacted": p9_redacted, "p6_found": p6_found, "p6_entities": p6_entities, "p3_found": p3_found, "p3_matched": p3_matched, "p7_ids": p7_ids, "p8_found": p8_found, "p8_windows": p8_windows}
_FOLDED = "regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')"
_P8 = f"""WITH i AS (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM (SELECT item_id, {_FOLDED} AS w FROM eval_items) WHERE len(w) >= 12),
d AS (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM (SELECT doc_id, {_FOLDED} AS w FROM documents) WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, array_to_string(w[k : k + 11], ' ') AS t FROM d) JOIN (SELECT item_id, array_to_string(w[k : k + 11], ' ') AS t FROM i) USING (t)"""

ORACLES: dict[str, str] = {"p8_found": _P8}
