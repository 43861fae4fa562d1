"""Nearest-neighbour joins over chunk vectors.

Exact by default: blocks of vectors around sampled pivots, of which a target meets those that bounds do not rule out
(``operators/exact.py``). With ``probes=p`` and a number of ``pivots`` only the cells of a target's p nearest pivots are
searched. In many dimensions the bounds exclude little, so very large collections are searched with ``banded=True``
(``operators/bands.py``), the default of all candidate plans.

Equal vectors are collapsed before the join (each keeps the ``n + 1`` smallest
ids, all a result of size n can use) and expanded after it, so a large group of
copies costs one comparison per neighbour instead of one per pair of copies.
Cells of any size are split into units of targets and corpus vectors, of which a task
keeps the best of each target while the unit's corpus goes by (``exact.unit_hits``).
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkin.functions.ids import shuffle_key
from textkin.operators import exact
from textkin.operators.bands import banded_hits, says_nothing
from textkin.operators.exact import MAX_CELLS, chord, exact_hits, stacked, unit_rows
from textkin.operators.ranks import top_per_group
from textkin.session import cut

BLOCK_ROWS = 2048
ROWS_PER_CELL = 2048
DIST_DIGITS = 7  # distances are rounded so that copies tie exactly


def _with_vid(df: DataFrame, keys, vec: str) -> DataFrame:
    """Chunk ids, vector, and a 128-bit key of the vector's contents."""
    return df.select(
        *keys, F.col(vec).cast("array<float>").alias("vec"),
    ).withColumn("vid", F.concat(
        F.hex(F.xxhash64("vec")), F.lit("-"), F.hex(F.xxhash64(F.lit("b"), F.col("vec")))))


def _assigner(pivots):
    @F.pandas_udf("struct<cell:int,d:double>")
    def assign(vecs: pd.Series) -> pd.DataFrame:
        m, ok = stacked(vecs)
        d = chord(m, pivots)
        cell = d.argmin(axis=1)
        return pd.DataFrame({"cell": np.where(ok, cell, -1).astype("int32"),
                             "d": d[np.arange(len(cell)), cell]})

    return assign


def _prober(pivots, probes):
    """The cells of the ``probes`` pivots nearest to a target."""
    k = min(probes, len(pivots))

    @F.pandas_udf("array<int>")
    def probe(vecs: pd.Series) -> pd.Series:
        m, ok = stacked(vecs)
        cells = np.argpartition(chord(m, pivots), k - 1, axis=1)[:, :k].tolist()
        return pd.Series([c if good else [] for c, good in zip(cells, ok)])

    return probe


def _pivot_matrix(raw: DataFrame, keys, n_pivots: int) -> np.ndarray:
    """A bounded sample of distinct vectors, on the driver; any direction where there are none."""
    rows = (
        raw.orderBy(shuffle_key(*[F.col(k) for k in keys], seed=7), *keys)
        .limit(2 * n_pivots).select("vid", "vec").collect()
    )
    distinct = {r["vid"]: r["vec"] for r in rows}
    m, ok = unit_rows(np.array(list(distinct.values()) or [[1.0]], dtype=np.float64))
    return m[ok][:n_pivots] if ok.any() else unit_rows(np.ones((1, m.shape[1])))[0]


def _lists(hits, assigned, keys, rep_cols, want):
    """``(vid, nn)``: the best ``want`` ids of every target, from hits between distinct vectors."""
    best = top_per_group(hits, ["tvid"], ["dist", *rep_cols], want, rank_col="k")
    # The k-th vector can fill at most the places k..want of a list.
    expanded = best.join(assigned.select(F.col("vid").alias("mvid"), "ids"), "mvid").select(
        "tvid", "dist", F.explode(F.slice("ids", F.lit(1), F.lit(want + 1) - F.col("k"))).alias("m")
    ).select("tvid", "dist", "m.*")
    m_keys = ["m_" + k for k in keys]
    final = top_per_group(expanded, ["tvid"], ["dist", *m_keys], want)
    return final.groupBy(F.col("tvid").alias("vid")).agg(
        F.sort_array(F.collect_list(F.struct("dist", *m_keys))).alias("nn"))


def knn_lists(targets: DataFrame, corpus: DataFrame, n: int, keys=("htid", "seq"), vec="vec",
              max_dist=None, probes=None, pivots=None, self_join=None, banded=False):
    """Neighbour lists per distinct target vector, and the target ids.

    Returns ``(lists, target_ids)``: ``lists`` is ``(vid, nn)`` with ``nn`` the
    ``n + 1`` best ``struct(dist, m_<key>...)`` in (dist, id) order.
    """
    keys = list(keys)
    want = n + 1
    self_join = targets is corpus if self_join is None else self_join
    # Read several times below, so the inputs' own plans run once.
    raw = cut(_with_vid(corpus, keys, vec), "corpus")
    t_raw = raw if self_join else cut(_with_vid(targets, keys, vec), "targets")
    if probes is not None and not pivots:
        raise ValueError("a search of the nearest cells needs the number of pivots")
    n_pivots = pivots or max(1, min(MAX_CELLS, raw.count() // ROWS_PER_CELL))
    rep_cols = [f"r{i}" for i in range(len(keys))]
    ids = F.sort_array(F.collect_list(F.struct(*[F.col(k).alias("m_" + k) for k in keys])))
    distinct = (
        top_per_group(raw, ["vid"], keys, want)
        .groupBy("vid").agg(F.first("vec").alias("vec"), ids.alias("ids"))
        .withColumns({r: F.col("ids")[0]["m_" + k] for r, k in zip(rep_cols, keys)})
    )
    if banded and max_dist is None:
        raise ValueError("a banded search needs max_dist")
    if banded and not says_nothing(max_dist):
        assigned = cut(distinct, "distinct")
        members = assigned.select("vid", "vec", *rep_cols, F.lit(True).alias("c"))
        if self_join:
            members = members.withColumn("t", F.lit(True))
        else:
            asked = t_raw.groupBy("vid").agg(F.first("vec").alias("t_vec"))
            members = members.join(asked, "vid", "full").select(
                "vid", F.coalesce("vec", "t_vec").alias("vec"), *rep_cols, F.coalesce("c", F.lit(False)).alias("c"),
                F.col("t_vec").isNotNull().alias("t"))
        size = raw.select(F.size("vec").alias("d")).first()
        hits = banded_hits(cut(members, "members"), want, max_dist, rep_cols, size["d"] if size else 1, DIST_DIGITS)
        return _lists(hits, assigned, keys, rep_cols, want), t_raw.select("vid", *[F.col(k).alias("t_" + k) for k in keys])
    ids_of = t_raw.select("vid", *[F.col(k).alias("t_" + k) for k in keys])
    pivot_rows = _pivot_matrix(raw, keys, n_pivots)
    if probes is None:
        asked = None if self_join else t_raw.groupBy("vid").agg(F.first("vec").alias("vec"))
        assigned, hits = exact_hits(distinct, asked, pivot_rows, want, max_dist, rep_cols, DIST_DIGITS)
        return _lists(hits, assigned, keys, rep_cols, want), ids_of
    assigned = cut(distinct.withColumn("a", _assigner(pivot_rows)(F.col("vec"))).select(
        "vid", "vec", "ids", *rep_cols, F.col("a.cell").alias("cell")).where("cell >= 0"), "cells")
    t_distinct = assigned if self_join else t_raw.groupBy("vid").agg(F.first("vec").alias("vec"))
    probed = cut(t_distinct.select("vid", "vec", _prober(pivot_rows, probes)(F.col("vec")).alias("cells")), "probes")
    counts, t_counts = (np.zeros(len(pivot_rows), dtype=np.int64) for _ in range(2))
    for rows, n in ((assigned, counts), (probed.select(F.explode("cells").alias("cell")), t_counts)):
        for r in rows.groupBy("cell").count().collect():  # one row per pivot
            n[r["cell"]] = r["count"]

    # A cell's targets and corpus are dealt by hash, and every pair of parts is a unit.
    spark = corpus.sparkSession
    c_parts = np.maximum(1, -(-counts // max(exact.BLOCK_ROWS, exact.CORPUS)))
    t_parts = np.maximum(1, -(-t_counts // exact.targets_per_unit(spark, int(t_counts.sum()))))
    first = np.concatenate([[0], np.cumsum(c_parts * t_parts)])
    slot = F.xxhash64("vid")

    def of(values):
        return F.element_at(F.lit(values.tolist()), F.col("cell") + 1)

    def unit(tp, cp):
        return (of(first[:-1]) + tp * of(c_parts) + cp).alias("unit")

    def all_of(parts):
        return F.explode(F.sequence(F.lit(0).cast("long"), of(parts) - 1))

    left = (
        probed.select("vid", "vec", F.explode("cells").alias("cell"))
        .withColumn("cp", all_of(c_parts))
        .select(unit(F.pmod(slot, of(t_parts)), F.col("cp")), "vid", "vec", F.lit(4.0).alias("bound"))
    )
    right = (
        assigned.select("vid", "vec", *rep_cols, "cell")
        .withColumn("tp", all_of(t_parts))
        .select(unit(F.col("tp"), F.pmod(slot, of(c_parts))), "vid", "vec", *rep_cols)
    )
    hits = exact.unit_hits(left, right, int(first[-1]), want, max_dist, rep_cols, DIST_DIGITS)
    return _lists(hits, assigned, keys, rep_cols, want), ids_of


def knn_join(targets: DataFrame, corpus: DataFrame, n: int, keys=("htid", "seq"), vec="vec",
             max_dist=None, probes=None, pivots=None, drop_self=True, banded=False) -> DataFrame:
    """``n`` nearest corpus chunks of every target chunk.

    Output: ``t_<key>..., m_<key>..., dist, rank`` with dist the angular distance
    sqrt(2 - 2 cos) and rank counted from 0 in (dist, id) order.
    """
    keys = list(keys)
    lists, ids = knn_lists(targets, corpus, n, keys, vec, max_dist, probes, pivots, banded=banded)
    nn = F.col("nn")
    if drop_self:
        def other(s):
            same = F.lit(True)
            for k in keys:
                same = same & (s["m_" + k] == F.col("t_" + k))
            return ~same
        nn = F.filter(nn, other)
    return (
        ids.join(lists, "vid")
        .select(*["t_" + k for k in keys], F.posexplode(F.slice(nn, 1, n)).alias("rank", "s"))
        .select(*["t_" + k for k in keys], *[F.col("s.m_" + k).alias("m_" + k) for k in keys],
                F.col("s.dist").alias("dist"), "rank")
    )


def chunk_neighbours(targets, corpus, n=30, max_dist=None, probes=None, drop_self=True, **kw) -> DataFrame:
    """kNN between chunks: ``target, target_seq, match, match_seq, dist, rank``."""
    out = knn_join(targets, corpus, n, max_dist=max_dist, probes=probes, drop_self=drop_self, **kw)
    return out.select(
        F.col("t_htid").alias("target"), F.col("t_seq").alias("target_seq"),
        F.col("m_htid").alias("match"), F.col("m_seq").alias("match_seq"), "dist", "rank")


def one_to_one(neighbours: DataFrame) -> DataFrame:
    """Per target volume, each matched chunk keeps its closest target chunk."""
    best = neighbours.groupBy("target", "match", "match_seq").agg(
        F.min(F.struct("dist", "target_seq", "rank")).alias("b"))
    return best.select("target", F.col("b.target_seq").alias("target_seq"), "match", "match_seq",
                       F.col("b.dist").alias("dist"), F.col("b.rank").alias("rank"))


def similarity(dist):
    """Cosine similarity of an angular distance."""
    return F.lit(1.0) - dist * dist / 2


def neighbour_votes(neighbours: DataFrame, minimum_matches=5, top=10) -> DataFrame:
    """Volumes collecting the most chunk hits of each target volume."""
    votes = neighbours.groupBy("target", "match").agg(F.count("*").alias("hits"))
    ranked = top_per_group(votes, ["target"], [F.desc("hits"), "match"], top)
    return ranked.where((F.col("hits") > minimum_matches) & (F.col("match") != F.col("target")))


def random_pairs(chunks: DataFrame, n=100, element: str = None, seed=1234) -> DataFrame:
    """Similarities of ``n`` random chunk pairs, optionally inside one value of a column.

    Two shuffled orders are matched position by position; the column value is
    itself drawn from the shuffled distinct values.
    """
    from textkin.functions.vectors import cosine
    from textkin.operators.ranks import sample_rows, shuffled_positions

    pool = chunks
    if element:
        value = sample_rows(chunks.select(element).distinct(), 1, [element], seed)
        pool = chunks.join(value, element, "left_semi")
    ids = ["htid", "seq"]
    cols = [*ids, "vec"]
    left = shuffled_positions(sample_rows(pool.select(*cols), n, ids, seed), [], ids, seed)
    right = shuffled_positions(sample_rows(pool.select(*cols), n, ids, seed + 1), [], ids, seed + 1)
    return left.select("pos", *[F.col(c).alias("l_" + c) for c in cols]).join(
        right.select("pos", *[F.col(c).alias("r_" + c) for c in cols]), "pos").select(
        F.col("l_htid").alias("target"), F.col("l_seq").alias("target_seq"),
        F.col("r_htid").alias("match"), F.col("r_seq").alias("match_seq"),
        cosine(F.col("l_vec"), F.col("r_vec")).alias("sim"), F.lit(element or "random").alias("relation"))
