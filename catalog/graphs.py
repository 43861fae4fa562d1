"""Clusters, folding and best copies (G)."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import q6, q6s, r6, r6s, sql
from catalog.joins import CLEAN, CLUSTERS, STATS_BY_WORK, WORK_PAIRS, _work_predictions, clean, clusters, rel
from textkin.operators import centrality, graph, relations, representative
from textkin.plans import works


def strong(spark, sf, p=0.77):
    return relations.high_confidence(clean(spark, sf), ["p_swsm"], p).select("target", "candidate", "p_swsm")


def g1_components(spark, sf):
    return graph.connected_components(strong(spark, sf), "target", "candidate")


def g1_communities(spark, sf):
    return graph.louvain(strong(spark, sf), "target", "candidate", weight="p_swsm")


def g2_single_clusters(spark, sf):
    s = strong(spark, sf).select(F.explode(F.array("target", "candidate")).alias("id")).distinct()
    return graph.single_clusters(clean(spark, sf), s, 500)


def g3_cluster_all(spark, sf):
    """Every volume in exactly one cluster; members listed with the cluster's smallest id."""
    c = graph.cluster_all(clean(spark, sf), strong(spark, sf), "man_id", method="components")
    low = c.groupBy("man_id").agg(F.min("htid").alias("first"), F.count("*").alias("size"))
    return c.join(low, "man_id").select("htid", "first", "size")


def g4_fold_to_works(spark, sf):
    """Communities over all thresholds, on both levels."""
    ref, _, _ = works.volumes_to_works(clean(spark, sf))
    return ref.select("htid", "man_id", "work_id")


def g4_fold_by_components(spark, sf):
    ref, _, _ = works.volumes_to_works(clean(spark, sf), method="components")
    return ref.select("htid", "man_id", "work_id")


def _members(spark, sf):
    return clusters(spark, sf).select(F.col("work_id").alias("cluster"), "htid")


def _edges(spark, sf):
    e = graph.same_cluster_edges(clean(spark, sf), clusters(spark, sf), "work_id")
    return e.select("cluster", "target", "candidate", (F.col("p_swsm") + F.col("p_swde")).alias("w"))


def g5_pagerank(spark, sf):
    return centrality.pagerank(_members(spark, sf), _edges(spark, sf)).select("cluster", "htid", r6("rank"))


def _book_members(spark, sf):
    """Vector books in ten groups by number."""
    b = fx.chunk_vectors(spark, sf).select("htid").distinct()
    return b.select((F.substring_index("htid", ".", -1).cast("long") % 10).alias("cluster"), "htid")


def _distances(spark, sf):
    return representative.member_distances(_book_members(spark, sf), fx.chunk_vectors(spark, sf))


def g6_member_distances(spark, sf):
    return _distances(spark, sf).select("cluster", "htid", r6("cent_dist"), r6("med_dist"))


def g7_best_copies(spark, sf):
    d = _distances(spark, sf).withColumn("access", F.when(
        (F.substring_index("htid", ".", -1).cast("long") % 3 == 0) & (F.col("cluster") != 4), "allow").otherwise("deny"))
    return representative.best_copies(d, {"best_centroid": ("cent_dist", "min"), "best_median": ("med_dist", "min")})


def g7_best_by_network(spark, sf):
    r = centrality.pagerank(_members(spark, sf), _edges(spark, sf))
    return representative.best_copies(r.join(fx.meta(spark, sf).select("htid", "access"), "htid"), {"best_network": ("rank", "max")})


def g8_cluster_history(spark, sf):
    c = clusters(spark, sf).withColumn("man_id_pass0", F.concat_ws("/", "man_id", F.substring("htid", 1, 2)))
    return graph.cluster_history(c, "work_id", ["man_id_pass0", "man_id"])


def g9_coherence(spark, sf):
    st = graph.cluster_stats(clusters(spark, sf), fx.meta(spark, sf), "work_id")
    return graph.internal_coherence(_work_predictions(spark, sf), graph.ordinary_works(st), "work_id").select(
        "target", "label_count", *r6s("p_swsm", "p_swde"))


QUERIES = {f.__name__: f for f in (
    g1_components, g1_communities, g2_single_clusters, g3_cluster_all, g4_fold_to_works, g4_fold_by_components, g5_pagerank, g6_member_distances,
    g7_best_copies, g7_best_by_network, g8_cluster_history, g9_coherence)}

_STRONG = "SELECT target, candidate FROM clean WHERE p_swsm > 0.77"
_CC = """SELECT id, min(reach) AS label FROM walk GROUP BY id"""
WALK = """SELECT id, id AS reach FROM nodes UNION SELECT walk.id, n.b FROM walk JOIN nb n ON n.a = walk.reach"""
_NB = """SELECT target AS a, candidate AS b FROM strong UNION SELECT candidate, target FROM strong"""
_NODES = "SELECT DISTINCT a AS id FROM nb"


def cc_sql(body, *views, **extra):
    """A query over ``walk(id, reach)``, the reachability of the strong edges."""
    q = sql(body, *views, **extra, strong=_STRONG, nb=_NB, nodes=_NODES, walk=WALK, comp=_CC)
    # comp and walk come after the query's own views; recursion needs the keyword.
    return q if q.startswith("WITH RECURSIVE") else q.replace("WITH ", "WITH RECURSIVE ", 1)


def pagerank_sql(rounds=15):
    ctes = {
        "mem": "SELECT work_id AS cluster, htid, count(*) OVER (PARTITION BY work_id) AS n FROM clusters",
        "e": """SELECT a.work_id AS cluster, target AS s, candidate AS d, p_swsm + p_swde AS w FROM clean JOIN clusters a ON a.htid = target
          JOIN clusters b ON b.htid = candidate AND a.work_id = b.work_id""",
        "flow": """SELECT cluster, s, d, w / sum(w) OVER (PARTITION BY cluster, s) AS share FROM
          (SELECT cluster, s, d, w FROM e UNION ALL SELECT cluster, d, s, w FROM e) WHERE w > 0""",
        "r0": "SELECT cluster, htid, n, 1.0::DOUBLE / n AS r, htid NOT IN (SELECT s FROM flow) AS sink FROM mem",
    }
    for i in range(rounds):
        ctes[f"r{i + 1}"] = f"""SELECT x.cluster, x.htid, x.n, 0.15::DOUBLE / x.n + 0.85::DOUBLE * (coalesce(g.got, 0) + coalesce(l.loose, 0) / x.n) AS r, x.sink
          FROM r{i} x LEFT JOIN (SELECT f.cluster, d AS htid, sum(share * r) AS got FROM flow f JOIN r{i} y ON y.htid = s GROUP BY ALL) g ON g.htid = x.htid
          LEFT JOIN (SELECT cluster, sum(r) AS loose FROM r{i} WHERE sink GROUP BY cluster) l ON l.cluster = x.cluster"""
    return ctes


_PR = {"clusters": CLUSTERS, "clean": CLEAN, **pagerank_sql()}
_LONG = """SELECT htid, CAST(substr(htid, 3) AS BIGINT) % 10 AS cluster, pos, avg(x) AS x FROM (SELECT htid, unnest(vec)::DOUBLE AS x,
  generate_subscripts(vec, 1) AS pos FROM fx_chunk) GROUP BY ALL"""
_DIST = """SELECT m.cluster, htid, 1 - list_cosine_similarity(list(m.x ORDER BY pos), list(s ORDER BY pos)) AS cent_dist,
  1 - list_cosine_similarity(list(m.x ORDER BY pos), list(md ORDER BY pos)) AS med_dist FROM long m
  JOIN (SELECT cluster, pos, sum(x) AS s, quantile_cont(x, 0.5) AS md FROM long GROUP BY ALL) USING (cluster, pos) GROUP BY m.cluster, htid"""
_BEST = {"long": _LONG, "dist": _DIST, "acc": """SELECT *, CAST(substr(htid, 3) AS BIGINT) % 3 = 0 AND cluster <> 4 AS ok,
  round(cent_dist, 9) AS c, round(med_dist, 9) AS m FROM dist"""}

ORACLE = {
    "g1_components": cc_sql("SELECT id, label FROM comp", "fx_rel", clean=CLEAN),
    "g2_single_clusters": sql("""SELECT row_number() OVER (ORDER BY md5('1234|' || id), id) - 1 + 500 AS label, id FROM
        (SELECT target AS id FROM clean UNION SELECT candidate FROM clean) WHERE id NOT IN (SELECT target FROM strong UNION SELECT candidate FROM strong)""",
        "fx_rel", clean=CLEAN, strong=_STRONG),
    "g3_cluster_all": cc_sql("""SELECT htid, first, count(*) OVER (PARTITION BY first) AS size FROM (SELECT v.id AS htid, coalesce(label, v.id) AS first
        FROM (SELECT target AS id FROM clean UNION SELECT candidate FROM clean) v LEFT JOIN comp USING (id))""", "fx_rel", clean=CLEAN),
    "g5_pagerank": sql(f"SELECT cluster, htid, {q6('r', 'rank')} FROM r15", "fx_rel", "fx_meta", **_PR),
    "g6_member_distances": sql(f"SELECT cluster, htid, {q6('cent_dist')}, {q6('med_dist')} FROM dist", "fx_chunk", long=_LONG, dist=_DIST),
    "g7_best_copies": sql("""SELECT cluster, (min({'s': c, 'h': htid})).h AS best_centroid, (min({'s': c, 'h': htid}) FILTER (ok)).h AS best_centroid_pd,
        (min({'s': m, 'h': htid})).h AS best_median, (min({'s': m, 'h': htid}) FILTER (ok)).h AS best_median_pd FROM acc GROUP BY cluster""", "fx_chunk", **_BEST),
    "g7_best_by_network": sql("""SELECT cluster, (min({'s': -round(r, 9), 'h': r15.htid})).h AS best_network,
        (min({'s': -round(r, 9), 'h': r15.htid}) FILTER (access = 'allow')).h AS best_network_pd FROM r15 JOIN fx_meta USING (htid) GROUP BY cluster""", "fx_rel", "fx_meta", **_PR),
    "g8_cluster_history": sql("""SELECT work_id, count(DISTINCT man_id || '/' || substr(htid, 1, 2)) AS n_man_id_pass0, count(DISTINCT man_id) AS n_man_id
        FROM clusters GROUP BY work_id""", "fx_meta", clusters=CLUSTERS),
    "g9_coherence": sql(f"""SELECT target, label_count, {q6s('p_swsm', 'p_swde')} FROM wp JOIN st ON work_id = target
        WHERE target = candidate AND gov_prop < .5 AND serial_prop < .5 AND label_count > 1""", "fx_rel", "fx_meta",
        clusters=CLUSTERS, clean=CLEAN, wp=WORK_PAIRS, st=STATS_BY_WORK),
}
