"""Operator 3: drop lines that many documents share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, SPACES, UPPER, ascii_lower, scratch, stored


def line_key(line: Column) -> Column:
    """A line without white space at its ends and with A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, text without the shared lines, the columns to keep, n_lines (before), n_dropped; one row for each row of docs.

    Keys of at least min_chars code points in at least min_docs documents lose all their lines except in the
    largest doc_id holding them. Null or empty text is one empty line. Rows that repeat a doc_id count as one
    document; rows without a doc_id never count and never keep a shared line. An empty table gives an empty one.
    Columns to keep that are named as one of the results must be packed (a struct) or renamed first. Only (hash,
    id, position) rows are exploded, once, written and shuffled. The shared lines are counted by partial aggregates
    and written, so that their join has an exchange on both sides: a line that a third of the documents hold is a
    skewed join key, which adaptive execution splits, and few shared lines are broadcast by their measured size.
    What each document drops is written too, and only that stays in the shared folder.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(F.lit(0), *keep).alias("rest")).withColumn("row", F.xxhash64("text"))
    key = F.col("key")
    lines = (
        rows.select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("doc_id", "row", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length(key) >= min_chars)
        .select("doc_id", "row", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))
    )
    with scratch(docs.sparkSession) as own:
        lines = own.stored(lines)
        shared = own.stored(lines.groupBy("h1", "h2").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).drop("n"))
        drops = stored(lines.join(shared, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy("doc_id", "row").agg(F.collect_set("pos").alias("drops")))
    whole = rows.select("doc_id", "row", "rest", F.split("text", "\n", -1).alias("lines")).alias("w")
    d = drops.alias("d")
    out = whole.join(d, F.col("w.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("w.row") == F.col("d.row")), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("drops", F.array().cast("array<int>")))
    return out.select(
        F.col("w.doc_id").alias("doc_id"),
        F.array_join(F.transform(kept, lambda p: F.get("lines", p)), "\n").alias("text"),
        *[F.col("w.rest")[c].alias(c) for c in keep],
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = f"""
WITH l AS (
  SELECT doc_id, i AS pos, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
), k AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') AS key FROM l
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), f AS (
  SELECT k.doc_id, pos, line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS dropped FROM k LEFT JOIN shared s ON s.key = k.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
