"""Operator 6: document fingerprints by content-defined chunking."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import tuned
from tessera.llm.shingles import SLICE_BYTES, mixed

#: Chunks have LEAST to MOST bytes; before NORMAL a boundary needs 8 zero bits of the gear hash, after it 4.
LEAST, NORMAL, MOST = 24, 64, 512
_rng = np.random.Generator(np.random.PCG64(31337))
_GEAR = _rng.integers(0, 2**32, 256, dtype=np.uint32)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(MOST, 0x9E3779B97F4A7C15, np.uint64)]))
#: Rows of a bucket, quantiles asked for at once, bounds of buckets that are sent to all tasks (8 bytes each; beyond, buckets grow), and bytes of text chunked at once.
BUCKET_ROWS, QUANTILES, MOST_BOUNDS, SLICE = 4096, 1000, 1_000_000, 4_000_000


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: the sum of the table values of the last 32 bytes, shifted by their age."""
    h = _GEAR[data]
    for age in (1, 2, 4, 8, 16):
        h[age:] = h[age:] + (h[:-age] << np.uint32(age))
    return h


def _cuts(n: int, hard: list[int], easy: list[int]) -> list[int]:
    """Ends of the chunks of n bytes; hard, easy: the places after which a boundary may stand."""
    out, start = [], 0
    while n - start > LEAST:
        k = bisect_left(hard, start + LEAST)
        end = hard[k] if k < len(hard) and hard[k] <= start + NORMAL else 0
        if not end:
            k = bisect_left(easy, start + NORMAL)
            end = min(easy[k] if k < len(easy) else n, start + MOST, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """For each text its set of chunks: sorted distinct 64-bit values, 48 bits of digest above 16 bits of length."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        size, last = 0, at
        while last < len(texts) and (last == at or size + len(texts[last]) <= SLICE_BYTES):
            size += len(texts[last]) + 32
            last += 1
        # 32 zero bytes before each text; the hash's window then holds them, whatever text came before
        data = np.frombuffer(b"".join(bytes(32) + t for t in texts[at:last]), np.uint8)
        h = gear_hashes(data)
        easy = np.flatnonzero(h < (1 << 28))
        hard = easy[h[easy] < (1 << 24)] + 1
        easy = easy + 1
        starts = np.cumsum([0, *(len(t) + 32 for t in texts[at:last])])[:-1] + 32
        ends = starts + np.array([len(t) for t in texts[at:last]])
        bounds = [np.searchsorted(x, e, "right").tolist() for x in (hard, easy) for e in (starts, ends)]
        firsts, lengths, counts = [], [], []
        for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            cuts = _cuts(e - s, (hard[bounds[0][i] : bounds[1][i]] - s).tolist(), (easy[bounds[2][i] : bounds[3][i]] - s).tolist())
            counts.append(len(cuts))
            firsts += [s + c for c in [0, *cuts[:-1]]] if cuts else []
            lengths += [b - a for a, b in zip([0, *cuts[:-1]], cuts, strict=True)] if cuts else []
        if firsts:
            firsts, lengths = np.array(firsts), np.array(lengths)
            inner = np.concatenate([np.arange(n) for n in lengths]) if len(lengths) < 1000 else np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            values = _BYTE[data[np.repeat(firsts, lengths) + inner]] * _POWERS[inner]
            d = mixed(np.add.reduceat(values, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))
            value = (d & ~np.uint64(0xFFFF)) | lengths.astype(np.uint64)
        else:
            value = np.zeros(0, np.uint64)
        ends = np.cumsum(counts)
        out += [np.unique(value[e - n : e]) for n, e in zip(counts, ends.tolist(), strict=True)]
        at = last
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a's bytes in chunks that b has too; two empty fingerprints are alike."""
    if not len(a):
        return float(not len(b))
    low = np.uint64(0xFFFF)
    return float((np.intersect1d(a, b, assume_unique=True) & low).sum() / (a & low).sum())


def shown(f: np.ndarray) -> str:
    return f.astype(">u8").tobytes().hex()


def _bounds(keys: DataFrame, n: int) -> np.ndarray:
    """Keys, each the largest of its bucket, that cut all keys into buckets of about BUCKET_ROWS.

    Quantiles, and where these are too many quantiles of what lies between each two, part the keys; as they are
    approximate, the largest key of each part is then looked up.
    """
    buckets = max(1, min(n // BUCKET_ROWS, MOST_BOUNDS))
    if buckets == 1:
        return np.zeros(0, np.int64)

    def quantiles(k: int):
        return F.percentile_approx("key", [i / k for i in range(1, k)] or [0.0], 100 * max(k, QUANTILES))

    def parted(bounds: np.ndarray) -> DataFrame:
        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key = batch.column(0).to_numpy()
                yield pa.record_batch([pa.array(key), pa.array(np.searchsorted(bounds, key))], ["key", "part"])

        return keys.mapInArrow(placed, "key long, part long").groupBy("part")

    bounds = np.unique(np.array(keys.agg(quantiles(min(buckets, QUANTILES))).first()[0] or [], np.int64))
    if buckets > QUANTILES:
        found = parted(bounds).agg(quantiles(-(-buckets // QUANTILES)).alias("q")).select("q").collect()
        bounds = np.unique(np.concatenate([bounds, *(np.array(r["q"] or [], np.int64) for r in found)]))
    return np.sort(np.array([r["key"] for r in parted(bounds).agg(F.max("key").alias("key")).collect()], np.int64))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, ahead, null, key, mark, packed) so that the next document, descending, follows in the same bucket.

    The largest keys of the buckets bound them. A row of the largest key of a bucket is also
    sent, marked `ahead`, to the bucket before it, and the largest of all to the last one. Rows without a doc_id
    have keys below those of all others, spread by a hash of the text. Texts are compressed before this one shuffle.
    """
    none = -(2**63)
    key = F.coalesce("doc_id", F.lit(none) + F.shiftrightunsigned(F.xxhash64("text"), 8))
    docs = docs.select(F.col("doc_id").isNull().alias("null"), F.coalesce("text", F.lit("")).alias("text"), "doc_id").select("null", "text", key.alias("key"))
    n, top = docs.agg(F.count("*"), F.max("key")).first()
    bounds = _bounds(docs.select("key"), n)
    bounds = bounds[bounds != top] if top is not None else bounds

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1, write_content_size=True)
        for batch in batches:
            null, key = batch.column(0), batch.column(2).to_numpy()
            packed, mark = [], []
            for text in batch.column(1):
                raw = text.as_py().encode()
                packed.append(pack.compress(raw))
                mark.append(int.from_bytes(hashlib.blake2b(raw, digest_size=7).digest(), "big"))
            b = np.searchsorted(bounds, key)
            edge = np.flatnonzero(np.append(bounds, none)[np.minimum(b, len(bounds))] == key) if len(bounds) else np.zeros(0, np.int64)
            edge = edge[b[edge] < len(bounds)]
            first = np.flatnonzero(key == top)
            at = np.concatenate([np.arange(len(key)), edge, first])
            ahead = np.arange(len(at)) >= len(key)
            bucket = np.concatenate([b, b[edge] + 1, np.zeros(len(first), b.dtype)])
            yield pa.record_batch([pa.array(bucket), pa.array(ahead), null.take(pa.array(at)), pa.array(key[at]), pa.array(np.array(mark, np.int64)[at]), pa.array(packed, pa.binary()).take(pa.array(at))], ["bucket", "ahead", "null", "key", "mark", "packed"])

    return docs.mapInArrow(placed, "bucket long, ahead boolean, null boolean, key long, mark long, packed binary")


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; one row for each row of docs.

    The next document is the one of the next smaller doc_id (rows without a doc_id last, by a hash of the text;
    rows repeating a doc_id in a fixed order by text), after the last the first. Null text is empty; an empty text
    has the fingerprint '' and is like another empty one alone. An empty table gives an empty one; other columns
    are not read. Rows of one doc_id share a bucket: ids are meant to be few rows each.
    """
    tuned(docs.sparkSession)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()

        def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            """Results of all rows but the last, which still lacks its next."""
            pairs = [(i, i + 1) for i, (x, y) in enumerate(zip(rows, rows[1:], strict=False)) if not x[1] and x[0] == y[0]]
            prints = fingerprints([r[4] for r in rows])
            edited, chars = [], []
            for i, j in pairs:
                text, after = rows[i][4].decode(), rows[j][4].decode()
                half = len(text) // 2
                chars.append(len(text))
                edited.append((text[: len(text) - half] + after[:half]).encode())
            changed = fingerprints(edited)
            yield pa.record_batch(
                [
                    pa.array([None if rows[i][2] else rows[i][3] for i, _ in pairs], pa.int64()), pa.array(chars, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()),
                    pa.array([shown(prints[i]) for i, _ in pairs], pa.string()), pa.array([shown(f) for f in changed], pa.string()),
                    pa.array([likeness(prints[i], f) for (i, _), f in zip(pairs, changed, strict=True)], pa.float64()), pa.array([likeness(prints[i], prints[j]) for i, j in pairs], pa.float64()),
                ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        held: list[tuple] = []
        size = 0
        for batch in batches:
            for *row, packed in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3)), batch.column(5), strict=True):
                held.append((*row, unpack.decompress(packed.as_py())))
                size += len(held[-1][4])
                if size > SLICE:
                    yield from done(held)
                    held, size = held[-1:], len(held[-1][4])
        if held:
            yield from done(held)

    rows = with_next(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "ahead", F.desc("key"), "mark")
    return dealt.mapInArrow(compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(spark.read.parquet(f"{sf_dir}/documents.parquet"))
