"""Operator 7: mix sources to target weights by repetition rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import indexed, stored

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """source, source_size, target: shares of all sizes by weight, never over cap times a source's size.

    Sources in code point order, null last, take the weights in turn. The excess over a cap is shared out anew
    by weight until no source is above. The loop keeps the sources in Spark: each round fetches one row of sums,
    and a round that caps no further source is the last.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = indexed(per, F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights)).cast("int"))
    ranked = stored(ranked.select("source", "source_size", weight.alias("w")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    full = F.col("source_size") * cap
    level, capped = 0.0, -1
    while True:
        over = F.col("w") * F.lit(level) >= full
        n, taken, free = ranked.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, full)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0))).first()
        if n == capped or not free:
            break
        level, capped = (total - taken) / free, n
    return ranked.select("source", "source_size", F.least(full, F.col("w") * F.lit(level)).alias("target"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def drawn(seed: str | int, key: str, fraction: str | float) -> str:
    """The Bernoulli copy, in SQL: 1 where the upper 53 bits of a hash of (seed, key), a number in [0, 1), are below the fraction."""
    return f"CAST(shiftrightunsigned(xxhash64({seed}, {key}), 11) / {float(1 << 53):.1f}D < {fraction} AS BIGINT)"


def source_plan(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seeds: int = 32) -> DataFrame:
    """source, source_size, target, base, fraction, seed for each source of sizes (doc_id, key, source, size).

    rate = target / source_size; base is its floor, and the fraction the probability of one more copy. A source takes
    the first of `seeds` seeds whose words come as near to its target as its largest document and 2 % of the target, or
    the nearest. Few draws miss that, and hardly any for the sake of one document, so a document's chance stays its
    fraction, whatever its size (tests measure it). All seeds are summed in one grouped sum, and reruns agree. A source
    without words has target 0 and no copies.
    """
    targets = stored(source_targets(sizes, weights, cap))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("base", F.floor(rate)).withColumn("fraction", rate - F.floor(rate))
    s, t = sizes.alias("s"), targets.alias("t")
    rows = s.join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.key", "s.source", "s.size", "source_size", "target", "base", "fraction")
    gain = [F.expr(f"sum({drawn(i, 'key', 'fraction')} * size) AS g{i}") for i in range(seeds)]
    limit = "(largest + target / 50)"
    off = ", ".join(f"named_struct('off', greatest(abs(base * source_size + g{i} - target) - {limit}, 0), 'seed', {i})" for i in range(seeds))
    best = rows.groupBy("source", "source_size", "target", "base", "fraction").agg(F.max("size").alias("largest"), *gain)
    return stored(best.select("source", "source_size", "target", "base", "fraction", F.expr(f"array_min(array({off})).seed AS seed")))


def draw_key(doc_id: Column, text: Column) -> Column:
    """What is hashed for a document's copy: its id, and its text where it has none, so that rows without an id are drawn apart."""
    return F.when(doc_id.isNotNull(), F.xxhash64(doc_id)).otherwise(F.xxhash64(text, F.lit("no id")))


def sizes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return stored(docs.select(F.col(id_col).alias("doc_id"), draw_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (with key and source) with source_size, target and copies, how often each comes; key goes.

    The plan has one row for each source. Spark broadcasts it where its file is small enough; else the join
    shuffles, and a hot source is a skewed key that adaptive execution splits.
    """
    r, p = rows.alias("r"), plan.alias("p")
    copies = F.col("p.base") + F.expr(drawn("p.seed", "r.key", "p.fraction"))
    return r.join(p, F.col("r.source").eqNullSafe(F.col("p.source"))).select(*[F.col(f"r.`{c}`") for c in rows.columns if c != "key"], F.col("p.source_size").alias("source_size"), F.col("p.target").alias("target"), copies.alias("copies"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seeds: int = 32) -> DataFrame:
    """doc_id, size, source, source_size, target, copies; one row for each row of docs.

    A document comes floor(rate) times plus one Bernoulli copy with probability equal to the fraction. Null text
    has size 0; a null source is a source, the last. Rows that repeat a doc_id fare alike; rows without one are drawn by
    their text. Nothing comes more than ceil(cap) times. An empty table gives an empty one; other columns are not read.
    """
    sizes = sizes_of(docs, id_col, text_col, source_col)
    return with_copies(sizes, source_plan(sizes, weights, cap, seeds))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """The rows of docs (doc_id, source, text and any more columns), each as often as the mix takes it."""
    rows = docs.select(draw_key(F.col("doc_id"), F.col("text")).alias("key"), "source", F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))
    taken = with_copies(rows, source_plan(sizes_of(docs), weights, cap)).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
