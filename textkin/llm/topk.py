"""Exact top-k inner products by pivot-table elimination.

Vectors are integers: floor(256 * x) of every component. Every vector keeps its distances to ``PIVOTS`` vectors (a table made once).
For a query q and a candidate x the largest |d(q, p) - d(x, p)| over the pivots is a lower bound of d(q, x), and with it
``(|q|^2 + |x|^2 - bound^2) / 2`` an upper bound of q.x. Candidates of a block are evaluated in the order of that bound until the
k-th score found so far is larger than the next bound, so nothing that could be among the k is left out.
Before the first block a query knows its scores with the pivots, which are candidates too.

Candidates and queries are packed into blocks and every block of queries meets every block of candidates, in rows of bounded
size; each pair of blocks returns at most k rows per query. Vectors of different lengths never meet.

Nulls and edges: vectors that are null, empty, or hold null or non-finite components, and rows with a null id, take no part.
Candidates with the query's own id are left out, also where an id repeats; repeated candidate rows with an id and vector count
once. Fewer than k candidates give fewer rows. Ties go to the smaller id. Scores beyond a long integer stay at its ends. Other
columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textkin.session import cut

K = 5
SCALE = 256
PIVOTS = 32
#: Vectors of a block of candidates, and of queries.
BLOCK, QUERY_BLOCK = 2048, 512
#: Candidates with the largest bounds that are evaluated first; later steps are four times the one before.
STEP = 64

PACKED = "dim int, block long, ids binary, vectors binary, table binary"
SCORES = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame, id="vec_id", vector="embedding", scale=SCALE) -> DataFrame:
    """``(vec_id, v)`` with integer vectors; rows that can take no part are gone."""
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("v")).where("vec_id is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad).select("vec_id", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")).distinct()


def choose_pivots(vectors: DataFrame, n=PIVOTS) -> dict:
    """``{dimension: (ids, matrix)}``: of every dimension the ``n`` vectors with the smallest hashes of their id."""
    rank = F.row_number().over(W.partitionBy(F.size("v")).orderBy(F.xxhash64("vec_id"), "vec_id", "v"))
    rows = vectors.withColumn("r", rank).where(F.col("r") <= n).orderBy("r").collect()  # n per dimension
    dims = {}
    for r in rows:
        dims.setdefault(len(r["v"]), []).append((r["vec_id"], r["v"]))
    return {d: (np.array([i for i, _ in x], np.int64), np.array([v for _, v in x], np.float64)) for d, x in dims.items()}


def distances(x, pivots):
    """Euclidean distances of integer vectors to the pivots, in float64."""
    gaps = (x ** 2).sum(axis=1)[:, None] + (pivots ** 2).sum(axis=1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(gaps, 0))


def _pack(held, size):
    def run(batches):
        from pyspark import TaskContext

        waiting, number = {}, TaskContext.get().partitionId() << 32

        def packed(dim, rows):
            nonlocal number
            ids, v = np.array([i for i, _ in rows], np.int64), np.array([x for _, x in rows], np.int64)
            number += 1
            table = distances(v.astype(np.float64), held.value[dim][1])
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "block": pa.array([number], pa.int64()), "ids": [ids.tobytes()],
                                               "vectors": [v.tobytes()], "table": [table.tobytes()]})

        for batch in batches:
            for i, v in zip(batch["vec_id"].to_pylist(), batch["v"].to_pylist()):
                rows = waiting.setdefault(len(v), [])
                rows.append((i, v))
                if len(rows) == size:
                    yield packed(len(v), waiting.pop(len(v)))
        for dim, rows in waiting.items():
            yield packed(dim, rows)
    return run


class _Side:
    def __init__(self, ids, vectors, table, dim):
        self.ids = np.frombuffer(ids.as_buffer(), np.int64)
        self.v = np.frombuffer(vectors.as_buffer(), np.int64).reshape(-1, dim)
        self.table = np.frombuffer(table.as_buffer(), np.float64).reshape(len(self.ids), -1)
        self.square = (self.v.astype(np.float64) ** 2).sum(axis=1)


def exact_kind(a, b):
    """A type in which all inner products of the rows of two integer matrices are exact."""
    largest = np.prod([max(float(np.abs(x.astype(np.float64)).max(initial=0)), 1.0) for x in (a, b)]) * a.shape[1]
    return np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else object


def upper_bounds(q: _Side, c: _Side):
    """Upper bound of every inner product, from the largest difference of distances to a pivot."""
    gap, part = np.zeros((len(q.ids), len(c.ids))), np.empty((len(q.ids), len(c.ids)))
    for p in range(c.table.shape[1]):
        np.subtract.outer(q.table[:, p], c.table[:, p], out=part)
        np.maximum(gap, np.abs(part, out=part), out=gap)
    gap = np.maximum(gap * (1 - 1e-12) - 1e-5, 0)  # distances are rounded
    bound = (q.square[:, None] + c.square[None] - gap ** 2) / 2
    return bound + 1 + np.abs(bound) * 1e-12


def _floors(q, held, dim, k):
    """For each query the k-th best score among the pivots with other ids, which no better candidate falls below."""
    ids, pivots = held[dim]
    order = np.argsort(ids, kind="stable")
    ids, pivots = ids[order], pivots[order].astype(np.int64)
    first = np.concatenate([[True], ids[1:] != ids[:-1]])  # one vector per id
    ids, pivots = ids[first], pivots[first]
    kind = exact_kind(q.v, pivots)
    scores = (q.v.astype(kind) @ pivots.astype(kind).T).astype(np.float64)
    scores[q.ids[:, None] == ids[None]] = -np.inf
    return np.sort(scores, axis=1)[:, -k] if len(ids) >= k else np.full(len(q.ids), -np.inf)


def _longs(scores):
    """Scores as long integers; larger ones stay at the end of the range."""
    return (np.clip(scores, -(1 << 63), (1 << 63) - 1) if scores.dtype == object else scores).astype(np.int64)


def _best(ids, scores, k):
    """The ``k`` best of distinct ids; an id that repeats counts with its best score."""
    if len(scores) > 4 * k and len(np.unique(ids)) == len(ids):
        keep = scores >= np.partition(scores, -k)[-k]
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))
    order = order[np.sort(np.unique(ids[order], return_index=True)[1])[:k]]
    return ids[order], scores[order]


def _eliminate(held, k):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                dim = batch["dim"][row].as_py()
                q = _Side(batch["q_ids"][row], batch["q_vectors"][row], batch["q_table"][row], dim)
                c = _Side(batch["ids"][row], batch["vectors"][row], batch["table"][row], dim)
                kind = exact_kind(q.v, c.v)
                qv, cv = q.v.astype(kind), c.v.astype(kind)
                bounds, floors = upper_bounds(q, c), _floors(q, held.value, dim, k)
                found = []
                for i in range(len(q.ids)):
                    bound, least = bounds[i], floors[i]
                    left = np.flatnonzero((bound >= least) & (c.ids != q.ids[i]))
                    left = left[np.argsort(-bound[left])]
                    ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
                    at, step = 0, STEP
                    while at < len(left) and bound[left[at]] >= least:
                        part = left[at:at + step]
                        ids, scores = _best(np.append(ids, c.ids[part]), np.append(scores, _longs(cv[part] @ qv[i])), k)
                        if len(ids) == k:
                            least = max(least, float(scores[-1]))
                        at, step = at + step, 4 * step
                    found.append((np.full(len(ids), q.ids[i]), ids, scores))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[x] for f in found]).astype(np.int64)) for x in range(3)],
                                                     ["query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, queries: DataFrame, id="vec_id", vector="embedding", k=K, scale=SCALE, pivots=PIVOTS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of ``vectors`` with the largest inner products with each query."""
    spark = vectors.sparkSession
    known = cut(usable(vectors, id, vector, scale), "vectors")
    asked = usable(queries, id, vector, scale)
    held = spark.sparkContext.broadcast(choose_pivots(known, pivots))
    blocks = cut(known.mapInArrow(_pack(held, BLOCK), PACKED), "blocks")
    dims = [int(d) for d in held.value]
    packed = asked.where(F.size("v").isin(dims)) if dims else asked.where("false")
    packed = cut(packed.mapInArrow(_pack(held, QUERY_BLOCK), PACKED).toDF("dim", "q_block", "q_ids", "q_vectors", "q_table"), "queries")
    # Pairs of block numbers are made first; the packed vectors follow them, those of the many blocks of candidates last.
    pairs = blocks.select("dim", "block").join(packed.select("dim", "q_block"), "dim")
    met = pairs.join(packed.drop("dim"), "q_block").join(blocks.drop("dim"), "block")
    scores = met.mapInArrow(_eliminate(held, k), SCORES).distinct()
    best = scores.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
