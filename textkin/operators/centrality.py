"""PageRank inside clusters: small clusters whole in tasks, large ones in rounds over bucketed tables."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkin.session import bucketed, cut, drop_bucketed, shuffle_parts

#: Members and edges of clusters that one task works on; a cluster with more is worked on by all tasks in rounds.
LOCAL_ROWS = 200_000
#: A node of a large cluster with more edges is a hub, whose rank is sent to its edges wherever they are.
HUB_EDGES = 100_000
#: There are no more hubs than this: a hub also has more than this part of all edges.
MAX_HUBS = 10_000


def pagerank(members: DataFrame, edges: DataFrame, rounds=15, damping=0.85, step=5, tolerance=None, local_rows=LOCAL_ROWS, hub_edges=HUB_EDGES) -> DataFrame:
    """Weighted PageRank inside every cluster, all clusters together: ``(cluster, htid, rank)``.

    ``members`` is ``(cluster, htid)``, ``edges`` ``(cluster, target, candidate,
    w)`` and undirected. Ranks add up to 1 per cluster; volumes without edges
    spread their rank over the cluster, as does what flows to ids that are no members. With a ``tolerance`` the rounds go on until no rank changes by more in
    ``step`` of them; ranks change by the factor ``damping`` less each round, so they do.

    Clusters of up to ``local_rows`` members and edges are solved whole, many to a task. Repeated members count once; rows without
    cluster or id have no rank.
    """
    if rounds < 1 and tolerance is None:
        raise ValueError("at least one round")
    members = cut(members.select("cluster", "htid").where("cluster is not null and htid is not null"), "members")
    edges = cut(edges.select("cluster", "target", "candidate", F.col("w").cast("double").alias("w")).where("target <> candidate and w > 0"), "edges")
    rows = members.select("cluster").unionByName(edges.select("cluster"))
    sizes = cut(rows.groupBy("cluster").agg(F.count("*").alias("rows")), "sizes")
    small, large = sizes.agg(F.sum(F.when(F.col("rows") <= local_rows, F.col("rows"))), F.count_if(F.col("rows") > local_rows)).first()
    parts = []
    if small or not large:
        own = sizes.where(F.col("rows") <= local_rows).select("cluster") if large else None
        tasks = max(1, -(-(small or 0) // local_rows))

        def dealt(df):
            df = df.join(own, "cluster", "left_semi") if large else df
            return df.withColumn("task", F.pmod(F.xxhash64("cluster"), F.lit(tasks))).groupBy("task")

        kinds = {f.name: f.dataType.simpleString() for f in members.schema}
        parts.append(dealt(members).cogroup(dealt(edges)).applyInArrow(
            _whole_clusters(rounds, damping, step, tolerance), f"cluster {kinds['cluster']}, htid {kinds['htid']}, rank double"))
    if large:
        wide = sizes.where(F.col("rows") > local_rows).select("cluster")
        parts.append(_in_rounds(*[df.join(wide, "cluster", "left_semi") for df in (members, edges)], rounds, damping, step, tolerance, hub_edges))
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]


def _whole_clusters(rounds, damping, step, tolerance):
    def codes(*columns):
        """Numbers of the values of columns of one type, column by column."""
        whole = pa.chunked_array([c for column in columns for c in column.chunks], columns[0].type).combine_chunks()
        numbers = whole.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        return np.split(numbers, np.cumsum([len(c) for c in columns])[:-1])

    def run(members: pa.Table, edges: pa.Table) -> pa.Table:
        cluster, of_edge = codes(members["cluster"], edges["cluster"])
        node, target, candidate = codes(members["htid"], edges["target"], edges["candidate"])
        width = len(members) + 2 * len(edges) + 1
        keys, at = np.unique(cluster * width + node, return_index=True)
        group, size = np.unique(cluster[at], return_inverse=True)[1], len(keys)
        n = np.bincount(group)[group].astype(float) if size else np.empty(0)

        def place(ids):
            key = of_edge * width + ids
            i = np.minimum(np.searchsorted(keys, key), max(size - 1, 0))
            return np.where(keys[i] == key, i, -1) if size else np.full(len(key), -1)

        a, b, w = place(target), place(candidate), edges["w"].to_numpy()
        src, dst, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
        inside = src >= 0
        src, dst, w = src[inside], dst[inside], w[inside]
        out = np.bincount(src, w, size)
        share = w / out[src]
        arrives = dst >= 0
        src, dst, share = src[arrives], dst[arrives], share[arrives]
        rank = before = 1 / n
        done = 0
        while tolerance is not None or done < rounds:
            got = damping * np.bincount(dst, share * rank[src], size)
            rank = got + (1 - np.bincount(group, got)[group]) / n if size else got
            done += 1
            if tolerance is not None and done % step == 0:
                if np.abs(rank - before).max(initial=0) <= tolerance:
                    break
                before = rank
        at = pa.array(at)
        return pa.table({"cluster": members["cluster"].take(at), "htid": members["htid"].take(at), "rank": pa.array(rank)})

    return run


def _in_rounds(members, edges, rounds, damping, step, tolerance, hub_edges):
    """PageRank of large clusters, one shuffle a round.

    With A the damped flow along edges and u the equal ranks, round k gives x(k) = A x(k-1) + c(k) u, where c(k) brings the sum
    back to 1: the rank that sinks and damping spread. So x(k) is a sum of u, Au, AAu ... whose factors are numbers per cluster,
    found at the end from the sums of these vectors. A round only computes the next of them. Flows are bucketed by (cluster,
    source) and vectors by (cluster, node), so only the arriving flow is shuffled, after partial sums.
    """
    spark, buckets = members.sparkSession, shuffle_parts(members.sparkSession)
    both = edges.select("cluster", F.col("target").alias("src"), F.col("candidate").alias("dst"), "w").unionByName(
        edges.select("cluster", F.col("candidate").alias("src"), F.col("target").alias("dst"), "w"))
    out = cut(both.groupBy("cluster", "src").agg(F.sum("w").alias("out"), F.count("*").alias("links")), "out")
    least = max(hub_edges, (out.agg(F.sum("links")).first()[0] or 0) // MAX_HUBS)
    hubs = out.where(F.col("links") > least).select("cluster", "src")
    some_hubs = not hubs.isEmpty()
    shares = both.join(out.where(F.col("links") <= least), ["cluster", "src"]).select("cluster", "src", "dst", (F.col("w") / F.col("out")).alias("share"))
    flows = bucketed(shares, "flows", ["cluster", "src"], buckets)
    if some_hubs:  # at most MAX_HUBS rows, so these are broadcast
        of_hubs = cut(both.join(F.broadcast(out.where(F.col("links") > least)), ["cluster", "src"]).select(
            "cluster", "src", "dst", (F.col("w") / F.col("out")).alias("share")), "hub_flows")
    sizes = members.dropDuplicates(["cluster", "htid"]).groupBy("cluster").agg((1.0 / F.count("*")).alias("v"))
    first = members.dropDuplicates(["cluster", "htid"]).join(sizes, "cluster")
    state = bucketed(first.select("cluster", "htid", "v", F.array("v").alias("vectors")), "ranks", ["cluster", "htid"], buckets)
    try:
        done = 0
        while tolerance is not None or done < rounds:
            after = bucketed(_next(state, flows, damping, F.broadcast(hubs) if some_hubs else None, of_hubs if some_hubs else None),
                             "ranks", ["cluster", "htid"], buckets, dealt=True)
            drop_bucketed(state)
            state, done = after, done + 1
            if tolerance is not None and done % step == 0:
                change = _ranks(state, done, done - step).agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0]
                if change is None or change <= tolerance:
                    break
        return cut(_ranks(state, done).select("cluster", "htid", "rank"), "ranks")
    finally:
        drop_bucketed(flows)
        drop_bucketed(state)


def _next(state, flows, damping, hubs=None, of_hubs=None):
    """``state`` with its next vector."""
    own = state.select("cluster", F.col("htid").alias("src"), "v")
    sent = flows.join(own, ["cluster", "src"]).select("cluster", "dst", (F.col("share") * F.col("v")).alias("got"))
    if hubs is not None:
        ranks = F.broadcast(own.join(hubs, ["cluster", "src"]))
        sent = sent.unionByName(of_hubs.join(ranks, ["cluster", "src"]).select("cluster", "dst", (F.col("share") * F.col("v")).alias("got")))
    arriving = sent.groupBy("cluster", F.col("dst").alias("htid")).agg((F.sum("got") * damping).alias("got"))
    new = F.coalesce("got", F.lit(0.0))
    return state.join(arriving, ["cluster", "htid"], "left").select("cluster", "htid", new.alias("v"), F.concat("vectors", F.array(new)).alias("vectors"))


def _ranks(state, rounds, earlier=None):
    """Ranks after ``rounds`` rounds, and as ``old`` those after ``earlier``."""
    def add(a, b):
        return a + b

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), add)

    def factors(k):
        grow = lambda f, _: F.concat(F.array(1.0 - dot(f, F.slice("sums", 2, F.size(f)))), f)
        return F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.array(F.lit(1.0)), grow) if k else F.array(F.lit(1.0))

    sums = state.groupBy("cluster").agg(F.array(*[F.sum(F.get("vectors", j)) for j in range(rounds + 1)]).alias("sums"))
    told = sums.select("cluster", factors(rounds).alias("now"), factors(earlier or 0).alias("then"))
    return state.join(told, "cluster").select("cluster", "htid", dot("now", F.slice("vectors", 1, F.size("now"))).alias("rank"),
                                              dot("then", F.slice("vectors", 1, F.size("then"))).alias("old"))
