"""Exact top-k inner product search by block-at-a-time pruning.

Vectors are cut into shards of at most about ``SHARD_ROWS`` (by a hash of the id;
small tables into more and smaller ones, up to ``FEW_SHARDS``) and each shard, ordered by the nearest of a few centres, into blocks of
``BLOCK_ROWS``.  A block has a forward index (its vectors) and for each
dimension the largest and smallest component.  A query visits a shard's blocks
in falling order of their bound, the sum over dimensions of what the extreme
component can give, and stops when the bound falls below its k-th score so
far.  Queries travel in groups of up to ``GROUP_ROWS``; each group meets each shard
once, so that what is sent is rows and queries, each as often as the other side has
groups, in the narrowest integers that hold them.  Only the k best of a shard go on.
Blocks are skipped where like vectors lie together; where the components are
independent noise the bounds say little and most blocks are scored.  The centres come from at most ``SAMPLE`` vectors of
the shard and decide only the order, never the result.

Components are turned into floor(scale * x); the scores are exact integers.
Vectors that are null or hold null or non-finite components take no part; only
vectors of equal length meet.  Rows that repeat exactly count once; one id with
several vectors takes part with each.  Fewer than k candidates: all.  Empty
tables give an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import read, scratch

SHARD_ROWS, FEW_SHARDS, LEAST_SHARD, BLOCK_ROWS, GROUP_ROWS, SAMPLE, CENTRES = 65_536, 64, 4096, 64, 32_768, 2048, 128


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """Distinct (id, dim, q) of the vectors that take part."""
    sound = F.col(vector).isNotNull() & F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    q = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    return vectors.where(sound).select(F.col(key).cast("long").alias("id"), F.size(vector).alias("dim"), q.alias("q")).distinct()


def _order(matrix: np.ndarray) -> np.ndarray:
    """A row order that keeps like vectors together."""
    n = len(matrix)
    if n <= BLOCK_ROWS or not matrix.shape[1]:
        return np.arange(n)
    sample = matrix[:: max(1, n // SAMPLE)][:SAMPLE].astype(np.float32)
    centres = sample[:: max(1, len(sample) // min(CENTRES, max(2, n // (4 * BLOCK_ROWS))))].copy()
    for _ in range(6):
        near = np.argmin((centres**2).sum(1)[None] - 2 * sample @ centres.T, axis=1)
        for c in range(len(centres)):
            if (mine := near == c).any():
                centres[c] = sample[mine].mean(0)
    near = np.concatenate([np.argmin((centres**2).sum(1)[None] - 2 * matrix[a : a + 4096].astype(np.float32) @ centres.T, axis=1) for a in range(0, n, 4096)])
    return np.argsort(near, kind="stable")


def _bounds(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.arange(0, len(matrix), BLOCK_ROWS)
    return np.maximum.reduceat(matrix, starts, axis=0), np.minimum.reduceat(matrix, starts, axis=0)


def _packed(frame: pd.DataFrame, ordered: bool) -> tuple[bytes, str, bytes]:
    """Ids, and the matrix with the type of its integers."""
    frame = frame.sort_values("id", kind="stable")
    matrix = np.array(frame["q"].tolist(), np.int64).reshape(len(frame), -1)
    ids = frame["id"].to_numpy(np.int64)
    if ordered:
        order = _order(matrix)
        matrix, ids = matrix[order], ids[order]
    low, high = (int(matrix.min()), int(matrix.max())) if matrix.size else (0, 0)
    kind = next(t for t in ("int16", "int32", "int64") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return ids.tobytes(), kind, matrix.astype(kind).tobytes()


def _exact(queries: np.ndarray, matrix: np.ndarray) -> type:
    """float64 where every partial sum is an exact integer, else Python integers."""
    top = [int(abs(x).max()) if x.size else 0 for x in (queries, matrix)]
    return np.float64 if top[0] * top[1] * max(1, queries.shape[1]) < 1 << 53 else object


def search_shard(queries: np.ndarray, query_ids: np.ndarray, matrix: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each query: its row, the ids and scores of its k best in the shard (ties to smaller ids), and how many blocks were scored."""
    kind = _exact(queries, matrix)
    m, qs = matrix.astype(kind), queries.astype(kind)
    high, low = _bounds(m) if m.shape[1] else (np.zeros((-(-len(m) // BLOCK_ROWS), 0)),) * 2
    for row, q in enumerate(qs):
        bound = high @ np.maximum(q, 0) + low @ np.minimum(q, 0)
        order = np.argsort(-bound, kind="stable")
        best_s, best_i, at, step = np.empty(0, kind), np.empty(0, np.int64), 0, 4
        while at < len(order) and (len(best_s) < k or bound[order[at]] >= best_s[-1]):
            rows = (order[at : at + step, None] * BLOCK_ROWS + np.arange(BLOCK_ROWS)).ravel()
            rows = rows[rows < len(m)]
            rows = rows[ids[rows] != query_ids[row]]
            s, i = np.concatenate([best_s, m[rows] @ q]), np.concatenate([best_i, ids[rows]])
            if len(s) > 4 * k and kind is not object:
                keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                s, i = s[keep], i[keep]
            top = np.lexsort((i, -s))[:k]
            best_s, best_i, at, step = s[top], i[top], at + step, min(2 * step, 64)
        yield row, best_i, best_s, min(at, len(order))


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best vectors of another id.  Both frames as from ``quantised``."""
    vectors, queries = scratch(vectors, "vectors"), scratch(queries, "vector-queries")
    sizes, asked = ({r["dim"]: r["n"] for r in x.groupBy("dim").agg(F.count("*").alias("n")).collect()} for x in (vectors, queries))
    shards = {d: max(-(-n // SHARD_ROWS), min(-(-n // LEAST_SHARD), FEW_SHARDS)) for d, n in sizes.items()}
    groups = {d: -(-n // GROUP_ROWS) for d, n in asked.items()}
    told = lambda counts: F.create_map(*(F.lit(x) for kv in (counts or {0: 1}).items() for x in kv))

    def bundle(ordered: bool):
        def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            ids, kind, matrix = _packed(frame, ordered)
            return pd.DataFrame({"dim": [key[0]], "part": [key[1]], "ids": [ids], "kind": [kind], "matrix": [matrix]})

        return run

    def bundled(frame: DataFrame, counts: dict[int, int], ordered: bool) -> DataFrame:
        dealt = frame.withColumn("part", F.pmod(F.xxhash64("id", "q"), told(counts)[F.col("dim")]).cast("int"))
        return dealt.groupBy("dim", "part").applyInPandas(bundle(ordered), "dim int, part int, ids binary, kind string, matrix binary")

    index = scratch(bundled(vectors, shards, True), "vector-shards")
    asking = scratch(bundled(queries, groups, False), "query-groups").where(F.col("dim").isin(list(sizes)))
    asking = asking.select("dim", F.col("ids").alias("q_ids"), F.col("kind").alias("q_kind"), F.col("matrix").alias("q_matrix"), F.col("part").alias("group"))
    asking = asking.withColumn("part", F.explode(F.sequence(F.lit(0), told(shards)[F.col("dim")] - 1)))
    n = sum(shards.get(d, 0) * m for d, m in groups.items())
    tiles = asking.join(index, ["dim", "part"]).repartition(max(1, min(n, 100_000)), "dim", "part", "group")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for t in frame.itertuples():
                ids, q_ids = np.frombuffer(t.ids, np.int64), np.frombuffer(t.q_ids, np.int64)
                matrix, q = np.frombuffer(t.matrix, t.kind).reshape(len(ids), -1), np.frombuffer(t.q_matrix, t.q_kind).reshape(len(q_ids), -1)
                out = []
                for r, i, s, _ in search_shard(q, q_ids, matrix, ids, k):
                    out.append((q_ids[r], zlib.crc32(q[r].astype(np.int64).tobytes()), i, s))
                    if len(out) == 1024 or r == len(q) - 1:
                        counts = [len(x[2]) for x in out]
                        yield pd.DataFrame({
                            "query_id": np.repeat([x[0] for x in out], counts), "variant": np.repeat([x[1] for x in out], counts),
                            "vec_id": np.concatenate([x[2] for x in out]), "score": np.concatenate([[int(y) for y in x[3]] for x in out]),
                        }).astype("int64")
                        out = []

    hits = tiles.select("ids", "kind", "matrix", "q_ids", "q_kind", "q_matrix").mapInPandas(search, "query_id long, variant long, vec_id long, score long")
    best = Window.partitionBy("query_id", "variant").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(read(spark, sf_dir, "embeddings"))
    return exact_top_k(vectors, vectors.where(F.col("id") % 20 == 0))


ORACLE_SQL = """
WITH q AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM (SELECT * FROM q WHERE vec_id % 20 = 0) a JOIN q b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 20
"""
