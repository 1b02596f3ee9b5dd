"""Operator 12: draw the documents that look most like a target text, by hashed n-gram features; long texts go in overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, indexed, scratch, stored, tuned

#: What stands between words: ASCII but digits and lower-case letters.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text from which a document is cut into chunks, and of a chunk.
CHUNK_BYTES = 1 << 17
_IS_BREAK = bytes(1 if b < 0x30 or 0x3A <= b < 0x41 or 0x5B <= b < 0x61 or 0x7B <= b < 0x80 else 0 for b in range(256))


def chunk_bounds(data: bytes, carry: int, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, int]]:
    """(first byte, byte after the words that start here, byte after the carry) of each chunk of a text in UTF-8.

    A chunk is cut where a word begins, the first after `size` bytes, so words stay whole; `carry` more words follow it.
    """
    breaks = data.translate(_IS_BREAK)

    def next_word(at: int) -> int:
        """Where the first word after the break at or after `at` begins."""
        gap = breaks.find(1, at)
        word = breaks.find(0, gap) if gap >= 0 else -1
        return word if word >= 0 else len(data)

    start = 0
    while start < len(data):
        end = next_word(start + size) if start + size < len(data) else len(data)
        last = end
        for _ in range(carry):
            last = next_word(last)
        yield start, end, last
        start = end


def _chunked(docs: DataFrame, carry: int, size: int) -> DataFrame:
    """doc_id, row, text, rest: the words that start in the chunk, and the carried ones. Short texts are one chunk where they lie; only chunks of long ones are dealt out."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(2)):
                data = text.as_py().encode()
                for n, (start, end, last) in enumerate(chunk_bounds(data, carry, size)):
                    yield pa.record_batch([*batch.select([0, 1]).slice(i, 1).columns, pa.array([n]), pa.array([data[start:end].decode()]), pa.array([data[end:last].decode()])], ["doc_id", "row", "chunk", "text", "rest"])

    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    short = numbered.where(F.octet_length("text") <= size).select("doc_id", "row", "text", F.lit("").alias("rest"))
    long = numbered.where(F.octet_length("text") > size).select("doc_id", (-1 - F.col("row")).alias("row"), "text")
    chunks = long.mapInArrow(cut, f"doc_id {kind}, row long, chunk long, text string, rest string").repartition("row", "chunk")
    return short.unionByName(chunks.drop("chunk"))


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lower-cased."""
    return F.filter(F.split(ascii_lower(text), BREAK), lambda w: w != "")


def _features(docs: DataFrame, n: int, buckets: int, size: int) -> DataFrame:
    """doc_id, row, single (whether the feature is one word), bucket; a row for each run of 1 to n words, and one with null bucket for a chunk without words."""
    chunks = _chunked(docs, n - 1, size).select("doc_id", "row", words_of(F.col("text")).alias("own"), words_of(F.col("rest")).alias("rest"))
    chunks = chunks.select("doc_id", "row", F.size("own").alias("n_own"), F.concat("own", "rest").alias("w"))

    def runs(k: int) -> Column:
        """The runs of k words that start among the own ones, hashed."""
        first = F.slice("w", F.lit(1), F.greatest(F.lit(0), F.least(F.col("n_own"), F.size("w") - (k - 1))))
        text = (lambda x, i: F.concat_ws(" ", x, *[F.get("w", i + j) for j in range(1, k)])) if k > 1 else (lambda x, i: x)
        return F.transform(first, lambda x, i: F.crc32(text(x, i).cast("binary")))

    each = chunks.select("doc_id", "row", "n_own", F.posexplode_outer(F.concat(*[runs(k) for k in range(1, n + 1)])).alias("pos", "crc"))
    return each.select("doc_id", "row", (F.col("pos") < F.col("n_own")).alias("single"), (F.col("crc") % buckets).cast("int").alias("bucket"))


def _gains(docs: DataFrame, target: DataFrame, n: int, buckets: int, size: int) -> DataFrame:
    """bucket, gain for each of the buckets: the floored thousandfold log ratio of its smoothed shares in the target and in the documents."""

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return _features(rows, n, buckets, size).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias(name))

    table = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counted(docs, "s"), "bucket", "left").join(counted(target, "t"), "bucket", "left")
    table = stored(table.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"]))
    total = table.agg(F.sum("s"), F.sum("t")).first()
    s, t = (F.lit(float(x) + buckets) for x in total)
    return table.select("bucket", F.floor(1000 * F.ln((F.col("t") + 1) * s / ((F.col("s") + 1) * t))).alias("gain"))


def importance_resampling(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, n: int = 2, buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank; one row for each row of docs.

    Features are the runs of 1 to n words (A-Z lower-cased), hashed to buckets. A bucket's gain is the log ratio of
    its share in the target's texts and in the documents; weight is the floored mean gain of a document's features
    (0 without any), and score adds Gumbel noise that a hash of (seed, doc_id) fixes, so the highest scores are a
    draw without replacement with chances by weight. Of the documents with at least least_words words, percent are
    drawn; rank numbers them from 1 by score, ties to the smaller doc_id. Others have rank null.

    A text of more than chunk_bytes is cut at word borders; a chunk owns the runs that start in it and carries n - 1
    more words, chunks are dealt out, and counts and gains are summed by document. Counts are partial sums of bounded
    size, and the table of gains has `buckets` rows, so it is broadcast. Ranks come of a range exchange. Null and
    empty texts have no words; a null doc_id is hashed as an empty text and the last among ties; rows that repeat a
    doc_id are documents of their own, with one noise. Without target texts all its buckets count 0. An empty table
    gives an empty one; other columns are not read.
    """
    spark = tuned(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    target = target.select(F.lit(0).alias("doc_id"), F.coalesce(F.col(target_col), F.lit("")).alias("text"))
    with scratch(spark) as own:
        gains = F.broadcast(own.stored(_gains(docs, target, n, buckets, chunk_bytes)))
        sums = _features(docs, n, buckets, chunk_bytes).join(gains, "bucket", "left").groupBy("doc_id", "row").agg(F.count_if("single").alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("gain"))
        weight = F.expr("(gain - pmod(gain, greatest(n_features, 1))) div greatest(n_features, 1)")
        noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
        scored = sums.select("doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + F.floor(-1000 * F.ln(-F.ln((noise + 0.5) / 4294967296.0))))
        scored = own.stored(scored)
        able = scored.where(F.col("n_words") >= least_words)
        drawn = able.count() * percent // 100
        ranked = indexed(able, F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"))
        ranked = ranked.select(*scored.columns, F.when(F.col("_rank") < drawn, F.col("_rank") + 1).alias("rank"))
        return stored(ranked.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return importance_resampling(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


#: x is the table of CRC32, by its rule.
OP12_SQL = r"""
WITH x AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS x
), w AS (
  SELECT part, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT 0 AS part, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)
), f AS (
  SELECT part, doc_id, f, count(*) AS n FROM (
    SELECT part, doc_id, unnest(ws) AS f FROM w
    UNION ALL SELECT part, doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w WHERE len(ws) > 1
  ) GROUP BY ALL
), b AS (
  SELECT f, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1), lambda c, y: xor(c >> 8, x[(xor(c, y) & 255) + 1]), 4294967295), 4294967295) % 10000 AS b
  FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)) d, x
), t AS (
  SELECT part, b, sum(n) AS n FROM f JOIN b ON b.f = f.f GROUP BY ALL
), s AS (
  SELECT coalesce(sum(n) FILTER (WHERE part = 0), 0)::DOUBLE + 10000 AS s, coalesce(sum(n) FILTER (WHERE part = 1), 0)::DOUBLE + 10000 AS t FROM t
), g AS (
  SELECT i AS b, floor(1000 * ln((coalesce(y.n, 0)::DOUBLE + 1) * s.s / ((coalesce(z.n, 0)::DOUBLE + 1) * s.t))) AS gain
  FROM range(10000) r(i) CROSS JOIN s LEFT JOIN t y ON y.part = 1 AND y.b = i LEFT JOIN t z ON z.part = 0 AND z.b = i
), d AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM f JOIN b ON b.f = f.f JOIN g ON g.b = b.b WHERE part = 0 GROUP BY doc_id
), a AS (
  SELECT w.doc_id, len(ws) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || w.doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN d ON d.doc_id = w.doc_id WHERE part = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY words >= 20) AS n FROM a
)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND r <= 25 * n // 100 THEN r END AS rank FROM r
"""
