"""Operator 5: near-duplicate vectors by spherical-cap filters of a structured random product code."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tessera.llm.common import Scratch, components, scratch, stored
from tessera.llm.shingles import digest

#: Filters that a vector exceeds on average among up to 100,000 vectors, how many more for each tenfold number, codes, members of a filter aimed at, and rows of a block.
CAPS, MORE_CAPS, TABLES, AIM, BLOCK = 16, 8, 4, 32, 2048


def caps(n: int) -> int:
    """Filters that each of n vectors exceeds on average. Filters get smaller caps as vectors get more, so their number grows with its logarithm to keep the recall."""
    return CAPS + max(0, round(MORE_CAPS * np.log10(max(n, 1) / 100_000)))


def code_size(n: int) -> int:
    """Code words of each half of a code, so that n vectors fill filters of about AIM: TABLES * size**2 filters."""
    return max(8, int(np.ceil(np.sqrt(n * caps(n) / AIM / TABLES))))


def cap_height(d: int, share: float) -> float:
    """The cosine that a random direction of d dimensions exceeds towards a fixed one with probability `share`, from the exact density (1 - t^2)^((d - 3) / 2)."""
    if d < 2 or share >= 0.5:
        return 0.0
    angle = np.linspace(0, np.pi / 2, 200_001)
    step = np.sin(angle) ** (d - 2)
    inside = np.concatenate([[0.0], np.cumsum((step[1:] + step[:-1]) / 2)])
    return float(np.cos(np.interp(share * 2 * inside[-1], inside, angle)))


@lru_cache(maxsize=8)
def codes(d: int, size: int, each: int = CAPS) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each code its two halves in rotated coordinates and the score that a random direction exceeds each / TABLES times."""
    out = []
    least = cap_height(d, each / TABLES / size**2)
    for table in range(TABLES):
        rng = np.random.Generator(np.random.PCG64([d, size, table]))
        turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
        halves = []
        for part in (turn[: d // 2], turn[d // 2 :]):
            words = rng.standard_normal((size, len(part)))
            words /= np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1e-12) * np.sqrt(2)
            halves.append(words @ part)
        out.append((halves[0], halves[1], least))
    return out


def unit(x: np.ndarray) -> np.ndarray | None:
    """x in double precision at length 1; None if it is empty, zero or not finite throughout."""
    x = x.astype(float)
    if not len(x) or not np.isfinite(x).all() or not (big := np.abs(x).max()) > 0:
        return None
    return x / (np.linalg.norm(x / big) * big)


def decoded(x: np.ndarray, size: int, each: int = CAPS) -> list[np.ndarray]:
    """The sorted filters of each unit vector: all that it exceeds, and its best of each code."""
    found: list[list[np.ndarray]] = [[] for _ in x]
    for table, (left, right, least) in enumerate(codes(x.shape[1], size, each)):
        a, b = x @ left.T, x @ right.T
        top_a, top_b = a.max(1), b.max(1)
        for i in range(len(x)):
            least_i = min(least, top_a[i] + top_b[i])
            p, q = np.flatnonzero(a[i] >= least_i - top_b[i]), np.flatnonzero(b[i] >= least_i - top_a[i])
            r, s = np.nonzero(a[i][p][:, None] + b[i][q][None, :] >= least_i)
            found[i].append((table * size + p[r]) * size + q[s])
    return [np.unique(np.concatenate(f)) for f in found]


def stacked(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one number of dimensions, none of them zero or not finite, at length 1 in double precision."""
    x = np.frombuffer(b"".join(raw), kind).astype(float).reshape(len(raw), -1)
    big = np.abs(x).max(1, keepdims=True)
    return x / (np.linalg.norm(x / big, axis=1, keepdims=True) * big)


def _filters(classes: DataFrame, size: int, each: int, kind: str) -> DataFrame:
    """rep, m, x and the filters, as numbers packed in `pack`."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("x").to_pylist()
            own = [np.zeros(0, np.int64)] * len(raw)
            for d in {len(v) for v in raw}:
                at = [i for i, v in enumerate(raw) if len(v) == d]
                x = stacked([raw[i] for i in at], kind)
                for lo in range(0, len(at), 1024):
                    for i, f in zip(at[lo : lo + 1024], decoded(x[lo : lo + 1024], size, each), strict=True):
                        own[i] = f
            narrow = np.int32 if TABLES * size**2 < 1 << 31 else np.int64
            yield pa.record_batch([batch.column("rep"), batch.column("m"), batch.column("x"), pa.array(own, pa.list_(pa.int64())), pa.array([f.astype(narrow).tobytes() for f in own], pa.binary())], ["rep", "m", "x", "filters", "packed"])

    return classes.select("rep", "m", "x").mapInArrow(made, "rep long, m long, x binary, filters array<long>, packed binary")


def _tile_links(rows: pa.Table, least: float, kind: str, narrow: type) -> Iterator[pa.RecordBatch]:
    """Links among the rows of one tile: sums of linked vectors for each row, and an edge to the first row of its connected part."""
    dims = np.array([len(v) for v in rows.column("x").to_pylist()])
    for d in np.unique(dims):
        own = rows.filter(pa.array(dims == d))
        if own.num_rows < 2:
            continue
        x = stacked(own.column("x").to_pylist(), kind)
        rep, m, block = (own.column(c).to_numpy() for c in ("rep", "m", "block"))
        this, p, q = own.column("filter")[0].as_py(), own.column("p")[0].as_py(), own.column("q")[0].as_py()
        packed = own.column("packed").to_pylist()
        width = np.array([len(f) for f in packed]) // np.dtype(narrow).itemsize
        filters = np.full((len(x), int(width.max())), -1, narrow)
        filters[np.arange(filters.shape[1]) < width[:, None]] = np.frombuffer(b"".join(packed), narrow)
        links, part = np.zeros(len(x), np.int64), np.arange(len(x))
        ii, jj = [], []
        for lo in range(0, len(x), 512):
            i, j = np.nonzero(x[lo : lo + 512] @ x[lo:].T >= least)
            i, j = i + lo, j + lo
            keep = (i < j) & ((block[i] != block[j]) if p != q else True)
            ii.append(i[keep])
            jj.append(j[keep])
        i, j = np.concatenate(ii), np.concatenate(jj)
        step = max(1, 8_000_000 // filters.shape[1] ** 2)
        for lo in range(0, len(i), step):
            a, b = i[lo : lo + step], j[lo : lo + step]
            fa, fb = filters[a], filters[b]
            shared = ((fa[:, :, None] == fb[:, None, :]) & (fa[:, :, None] >= 0)).any(2)
            first = fa[np.arange(len(a)), shared.argmax(1)] == this  # a pair counts in its first common filter alone
            np.add.at(links, a[first], m[b[first]])
            np.add.at(links, b[first], m[a[first]])
        while len(i):
            low = np.minimum(part[i], part[j])
            if (low == part[i]).all() and (low == part[j]).all():
                break
            np.minimum.at(part, i, low)
            np.minimum.at(part, j, low)
        used = np.unique(np.concatenate([i, j]))
        yield pa.record_batch([pa.array(rep[used]), pa.array(rep[part[used]]), pa.array(links[used])], ["a", "b", "links"])


def near_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id; one row for each row of vectors.

    Two vectors link at cosine >= least in double precision. Null and zero vectors and those with null or
    non-finite components link with nothing; vectors of different lengths don't link. Equal vectors are one
    class with a count of its distinct ids. Each class is list-decoded to the filters it exceeds, so two vectors
    at cosine 0.95 miss each other in all of some 16, and more among more vectors, with a small probability (tests
    measure it up to 10^9 vectors). Members of a
    filter are compared by blocks inside tasks, which return sums and one edge a row, never pairs: a filter with
    many members is cut into blocks, and each pair of blocks is a task's group of bounded size. Rows repeating a
    vec_id are one node, and equal rows count once; a row without a vec_id takes no part. An empty table gives an
    empty one. Single-precision vectors travel in single precision.
    """
    with scratch(vectors.sparkSession) as own:
        return _near(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("x")), least, own)


def _near(vectors: DataFrame, least: float, tables: Scratch) -> DataFrame:
    kind = "<f4" if vectors.schema["x"].dataType == ArrayType(FloatType(), vectors.schema["x"].dataType.containsNull) else "<f8"

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = [np.array([np.nan if c is None else c for c in v.as_py()], kind) if v.is_valid else np.zeros(0, kind) for v in batch.column(1)]
            of = [unit(x) for x in xs]
            yield pa.record_batch([batch.column(0), pa.array([None if u is None else digest(u.tobytes()) for u in of], pa.binary()), pa.array([None if u is None else x.tobytes() for x, u in zip(xs, of, strict=True)], pa.binary())], ["vec_id", "v", "x"])

    rows = tables.stored(vectors.mapInArrow(units, "vec_id long, v binary, x binary"))
    once = rows.where("v IS NOT NULL AND vec_id IS NOT NULL").groupBy("v", "vec_id").agg(F.first("x").alias("x"))
    classes = tables.stored(once.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("x").alias("x")))
    n = classes.count()
    size = code_size(n)
    with_filters = tables.stored(_filters(classes, size, caps(n), kind))
    narrow = np.int32 if TABLES * size**2 < 1 << 31 else np.int64
    each = with_filters.select("rep", "m", "x", "packed", F.explode("filters").alias("filter"))
    sizes = with_filters.select(F.explode("filters").alias("filter")).groupBy("filter").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    tile = F.struct(F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    tiled = each.join(tables.stored(sizes), "filter").withColumn("blocks", blocks).withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("tile", tile)
    tiled = tiled.select("filter", F.col("tile.p").alias("p"), F.col("tile.q").alias("q"), "block", "rep", "m", "x", "packed")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = [held.column(c).to_numpy() for c in ("filter", "p", "q")]
            starts = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])).tolist()
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if b - a > 1:
                    yield from _tile_links(held.slice(a, b - a), least, kind, narrow)
            held = held.slice(starts[-1])
        if held is not None and held.num_rows > 1:
            yield from _tile_links(held, least, kind, narrow)

    found = tables.stored(tiled.repartition("filter", "p", "q").sortWithinPartitions("filter", "p", "q").mapInArrow(linked, "a long, b long, links long"))
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    same = rows.join(classes.select("v", "rep"), "v").where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    comps = components(found.select("a", "b").unionByName(same))
    per = classes.select("v", "rep", "m").join(links, F.col("rep") == F.col("a"), "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    out = rows.select("vec_id", "v").join(per, "v", "left").join(comps, F.col("vec_id") == F.col("node"), "left")
    return stored(out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")))


def op5_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS n FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
), e AS MATERIALIZED (
  SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.x, b.x) >= 0.95 * a.n * b.n
), r AS (
  SELECT vec_id, vec_id AS c FROM v
  UNION SELECT e.j, r.c FROM r JOIN e ON e.i = r.vec_id
), c AS (
  SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id
)
SELECT c.vec_id, (SELECT count(*) FROM e WHERE e.i = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c
"""
