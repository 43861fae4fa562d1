"""Components, communities, cluster labels and cluster reports over edge tables.

Iterative jobs write every round to the shared folder, so a lost executor costs
one round and plans stay short. Labels are the smallest member id, which makes
results independent of partitioning and of row order.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import pyarrow as pa

from textkin.functions.labels import canonical
from textkin.operators import local_graph
from textkin.operators.ranks import global_positions
from textkin.schemas import LABELS
from textkin.session import cut, remove

MAX_ROUNDS = 50
#: Edges of components that one task works on; a component of more is worked on by all tasks in rounds.
LOCAL_EDGES = 100_000


def connected_components(edges: DataFrame, src="src", dst="dst", max_rounds=MAX_ROUNDS, forests=False) -> DataFrame:
    """``(id, label)`` for every id with an edge; label is the smallest id reached.

    Alternates large-star and small-star steps (Kiveris et al. 2014): neighbours
    are only ever reduced by a minimum per node, so a hub is aggregated map-side
    and re-joined as one row. ``forests``: tasks first replace their edges by links to the smallest node of each tree, which
    saves rounds.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v").distinct()
    if forests:
        kind = e.schema["u"].dataType.simpleString()
        e = e.mapInArrow(local_graph.forest, f"u {kind}, v {kind}").distinct()
    e = cut(e, "edges")
    nodes = cut(e.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "nodes")

    def large_star(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()

    def small_star(e):
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        pulled = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return pulled.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    def settled(e):
        """Every node has one link, to a node without any."""
        split = e.groupBy("u").agg(F.count("*").alias("links")).where("links > 1").select("u")
        deep = e.join(e.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        return split.unionByName(deep).isEmpty()

    done, turn = forests and settled(e), 0
    while not done:
        if turn == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        e = cut(small_star(large_star(e)), "star", replaces=[e])
        done, turn = settled(e), turn + 1
    return nodes.join(e.select(F.col("u").alias("id"), F.col("v").alias("label")), "id", "left").select(
        "id", F.coalesce("label", "id").alias("label"))


def _modularity(edges: DataFrame, comm: DataFrame, m2: float, resolution: float) -> float:
    inner = (
        edges.join(comm.toDF("src", "cs"), "src").join(comm.toDF("dst", "cd"), "dst")
        .where("cs = cd").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("x")).first()["x"]
    )
    deg = edges.groupBy("src").agg(F.sum("w").alias("k")).join(comm.toDF("src", "c"), "src")
    outer = deg.groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("x")).first()["x"]
    return inner / m2 - resolution * (outer or 0.0) / (m2 * m2)


def _move(edges, degrees, comm, m2, resolution, turn):
    """Best community of each node among its neighbours', for one hash half of the nodes."""
    tot = degrees.join(comm, "id").groupBy("c").agg(F.sum("k").alias("tot"), F.count("*").alias("size"))
    links = (
        edges.where("src <> dst").join(comm.toDF("dst", "c"), "dst")
        .groupBy(F.col("src").alias("id"), "c").agg(F.sum("w").alias("kin"))
    )
    own = comm.select("id", F.col("c").alias("own"))
    options = links.unionByName(comm.select("id", "c", F.lit(0.0).alias("kin"))).groupBy("id", "c").agg(
        F.sum("kin").alias("kin"))
    alone = tot.select(F.col("c").alias("own"), (F.col("size") == 1).alias("alone"))
    # Two single nodes join under the smaller id, so neighbours never swap places.
    scored = (
        options.join(own, "id").join(degrees, "id").join(tot, "c").join(alone, "own")
        .where(~(F.col("alone") & (F.col("size") == 1) & (F.col("c") > F.col("own"))))
        .withColumn("others", F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0))
        .withColumn("gain", F.round(F.col("kin") - resolution * F.col("k") * F.col("others") / m2, 12))
    )
    best = scored.groupBy("id").agg(
        F.min(F.struct((-F.col("gain")).alias("g"), "c")).alias("b"),
        F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"), F.first("own").alias("own"))
    mine = F.pmod(F.xxhash64("id"), F.lit(2)) == turn
    return best.select("id", F.when(mine & (-F.col("b.g") > F.col("stay")), F.col("b.c")).otherwise(
        F.col("own")).alias("c"))


def _rounds(level: DataFrame, m2: float, tolerance: float, resolution: float) -> DataFrame:
    """Communities of components too large for a task, in rounds over all tasks: ``(id, label)``.

    ``level`` holds both directions of every edge. Two hash halves of the nodes move in turn, which stops neighbours from
    swapping places; a round is kept only if modularity rises by ``tolerance``.
    Modularity is at most 1, so rounds and levels end by themselves.
    """
    nodes = level.select(F.col("src").alias("id")).distinct()
    labels = cut(nodes.select("id", F.col("id").alias("label")), "labels")
    while True:
        degrees = cut(level.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")), "degrees")
        comm = cut(degrees.select("id", F.col("id").alias("c")), "moves")
        start = q = _modularity(level, comm, m2, resolution)
        idle = i = 0
        while idle < 2:
            moved = cut(_move(level, degrees, comm, m2, resolution, i % 2), "moves")
            new_q = _modularity(level, moved, m2, resolution)
            if new_q >= q + tolerance:
                remove(level.sparkSession, comm.cut_path)
                comm, q, idle = moved, new_q, 0
            else:
                remove(level.sparkSession, moved.cut_path)
                idle += 1
            i += 1
        if q < start + tolerance:
            break
        labels = cut(labels.join(comm.toDF("label", "c"), "label").select("id", F.col("c").alias("label")), "labels", replaces=[labels])
        level = cut(
            level.join(comm.toDF("src", "cs"), "src").join(comm.toDF("dst", "cd"), "dst")
            .groupBy(F.col("cs").alias("src"), F.col("cd").alias("dst")).agg(F.sum("w").alias("w")), "graph", replaces=[level, degrees, comm])
    smallest = labels.groupBy("label").agg(F.min("id").alias("low"))
    return labels.join(smallest, "label").select("id", F.col("low").alias("label"))


def louvain(edges: DataFrame, src="src", dst="dst", weight=None, tolerance=0.001, resolution=1.0) -> DataFrame:
    """Communities by greedy modularity (Blondel et al. 2008), split where they are not connected: ``(id, label)``.

    Gains depend on the rest of the graph by its total weight alone, so components are worked on apart from each other: those of up
    to ``LOCAL_EDGES`` edges whole, many to a task, larger ones in rounds over all tasks. The label is the smallest member id.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    one = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"), w.alias("w")).where("a <> b")
    graph = cut(one.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("w").alias("w")), "graph")
    total, n = graph.agg(F.sum("w"), F.count("*")).first()
    kind = graph.schema["src"].dataType.simpleString()
    if not total:
        return graph.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.col("id").alias("label"))
    m2 = 2.0 * total

    def local(t: pa.Table) -> pa.Table:
        found = local_graph.communities(*[t[c].to_pylist() for c in ("src", "dst", "w")], m2, resolution)
        return pa.table({"id": pa.array(list(found), t.schema.field("src").type), "label": pa.array(list(found.values()), t.schema.field("src").type)})

    if n <= LOCAL_EDGES:  # one part, whatever its components
        return graph.withColumn("task", F.lit(0)).groupBy("task").applyInArrow(local, f"id {kind}, label {kind}")
    parts = connected_components(graph, forests=True).toDF("src", "part")
    placed = cut(graph.join(parts, "src"), "placed")
    sizes = cut(placed.groupBy("part").agg(F.count("*").alias("n")), "sizes")
    small, large = sizes.agg(F.sum(F.when(F.col("n") <= LOCAL_EDGES, F.col("n"))), F.count_if(F.col("n") > LOCAL_EDGES)).first()
    told = placed.join(sizes, "part")
    tasks = max(1, -(-(small or 0) // LOCAL_EDGES))
    own = told.where(F.col("n") <= LOCAL_EDGES).withColumn("task", F.pmod(F.xxhash64("part"), F.lit(tasks)))
    out = own.groupBy("task").applyInArrow(local, f"id {kind}, label {kind}")
    if large:
        big = told.where(F.col("n") > LOCAL_EDGES).select("src", "dst", "w")
        both = cut(big.unionByName(big.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")), "graph")
        out = out.unionByName(_rounds(both, m2, tolerance, resolution))
    return out


def communities(edges: DataFrame, method="louvain", **options) -> DataFrame:
    """Cluster label of every volume with a strong edge; ``components`` is the baseline."""
    if method == "components":
        return connected_components(edges, "target", "candidate", forests=True)
    return louvain(edges, "target", "candidate", **options)


def number_labels(labels: DataFrame) -> DataFrame:
    """Replace label ids by integers counted from 0."""
    numbers = global_positions(labels.select("label").distinct(), ["label"], "number")
    return labels.join(numbers, "label").select(F.col("number").alias("label"), "id")


def single_clusters(everyone: DataFrame, labelled: DataFrame, count_from=0) -> DataFrame:
    """Own labels for volumes without one, numbered from ``count_from``.

    ``everyone`` is a pair table; both of its ends are volumes.
    """
    ids = everyone.select(F.explode(F.array("target", "candidate")).alias("id")).distinct()
    free = ids.join(labelled.select("id"), "id", "left_anti")
    return global_positions(free, ["id"], "label").select((F.col("label") + count_from).alias("label"), "id")


def cluster_all(predictions: DataFrame, edges: DataFrame, id_col="man_id", method="louvain") -> DataFrame:
    """Label of every volume: communities first, then singletons; ``(id_col, htid)``."""
    grouped = number_labels(communities(edges, method))
    n = grouped.agg(F.coalesce(F.max("label") + 1, F.lit(0)).alias("n")).first()["n"]
    return grouped.unionByName(single_clusters(predictions, grouped, n)).select(
        F.col("label").alias(id_col), F.col("id").alias("htid"))


def merge_labels(old: DataFrame, new: DataFrame, label: str, last: str, history: str) -> DataFrame:
    """Compose labels: volumes of ``old`` take the label their ``last`` id got in ``new``.

    ``new`` is ``(label, htid)`` with htid holding ids of the last pass; the
    last ids stay as column ``history``.
    """
    n = new.select(F.col("htid").alias(last), F.col(label).alias("_new"))
    out = old.join(n, last).withColumnRenamed(last, history)
    return out.drop(label).withColumnRenamed("_new", label) if label in out.columns else out.withColumnRenamed("_new", label)


def relabel_pairs(predictions: DataFrame, clusters: DataFrame, id_col: str) -> DataFrame:
    """Both ends of every pair mapped to cluster ids."""
    c = clusters.select("htid", id_col)
    return (
        predictions.join(c.toDF("target", "_t"), "target").join(c.toDF("candidate", "_c"), "candidate")
        .drop("target", "candidate").withColumnRenamed("_t", "target").withColumnRenamed("_c", "candidate")
    )


def weighted_means(pairs: DataFrame) -> DataFrame:
    """Count-weighted mean probabilities per pair, and the summed count."""
    cols = [c for c in LABELS + ["relatedness"] if c in pairs.columns]
    n = F.sum("count")
    return pairs.groupBy("target", "candidate").agg(
        *[(F.sum(F.col(c) * F.col("count")) / n).alias(c) for c in cols], n.alias("count"))


def clustered_predictions(predictions: DataFrame, clusters: DataFrame, id_col: str) -> DataFrame:
    """Cluster-level predictions, every pair of clusters in one canonical row."""
    return weighted_means(canonical(relabel_pairs(predictions, clusters, id_col)).drop("flipped"))


def same_cluster_edges(predictions: DataFrame, clusters: DataFrame, id_col: str) -> DataFrame:
    """Pairs inside one cluster, for all clusters at once."""
    c = clusters.select("htid", id_col)
    return (
        predictions.join(c.toDF("target", "cluster"), "target").join(c.toDF("candidate", "_c"), "candidate")
        .where(F.col("cluster") == F.col("_c")).drop("_c")
    )


def cluster_stats(clusters: DataFrame, meta: DataFrame, id_col: str) -> DataFrame:
    """Volumes, government documents and serials per cluster, with proportions."""
    joined = clusters.select("htid", id_col).join(meta.select("htid", "us_gov_doc_flag", "bib_fmt"), "htid")
    counts = joined.groupBy(id_col).agg(
        F.count("*").alias("label_count"), F.count_if(F.col("us_gov_doc_flag") == 1).alias("gov_count"),
        F.count_if(F.col("bib_fmt") == "SE").alias("serial_count"))
    return counts.withColumns({
        "gov_prop": F.col("gov_count") / F.col("label_count"),
        "serial_prop": F.col("serial_count") / F.col("label_count")})


def ordinary_works(stats: DataFrame) -> DataFrame:
    """Works that are neither mostly government documents nor serials and hold several volumes."""
    return stats.where("gov_prop < 0.5 AND serial_prop < 0.5 AND label_count > 1")


def cluster_history(clusters: DataFrame, id_col: str, pass_cols) -> DataFrame:
    """Distinct ids of every pass inside each final cluster."""
    return clusters.groupBy(id_col).agg(*[F.count_distinct(c).alias("n_" + c) for c in pass_cols])


def internal_coherence(cluster_predictions: DataFrame, stats: DataFrame, id_col: str, min_size=2) -> DataFrame:
    """Self pairs of cluster-level predictions for clusters of a minimum size."""
    big = stats.where(F.col("label_count") >= min_size).select(F.col(id_col).alias("target"), "label_count")
    return cluster_predictions.where("target = candidate").join(big, "target")
