"""Neighbour joins against brute force."""

import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textkin.operators import bands, exact, knn
from textkin.operators.candidates import doc_match_stats, volume_extents


def table(spark, vecs, per=5):
    rows = [(f"v{i // per:03d}", i % per + 1, [float(x) for x in v]) for i, v in enumerate(vecs)]
    return rows, spark.createDataFrame(rows, "htid string, seq int, vec array<float>").repartition(3).cache()


def brute(rows, n, max_dist=None, drop_self=True):
    m = np.array([np.float32(r[2]) for r in rows], dtype=np.float64)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    d = np.sqrt(np.maximum(0, 2 - 2 * u @ u.T)).round(7)
    out = set()
    for i, a in enumerate(rows):
        order = sorted(range(len(rows)), key=lambda j: (d[i, j], rows[j][0], rows[j][1]))
        order = [j for j in order if not (drop_self and j == i)]
        for k, j in enumerate(order[:n]):
            if max_dist is None or d[i, j] <= max_dist:
                out.add((a[0], a[1], rows[j][0], rows[j][1], k))
    return out


def got(df):
    return {(r["target"], r["target_seq"], r["match"], r["match_seq"], r["rank"]) for r in df.collect()}


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    vecs = np.vstack([c + rng.normal(size=(25, 12)) * 0.3 for c in centres])
    vecs = np.vstack([vecs, np.repeat(vecs[:1], 60, axis=0)])  # a third of all rows are one copy
    return table(spark, vecs)


@pytest.mark.parametrize("options", [{}, {"pivots": 9}, {"pivots": 9, "max_dist": 0.5}, {"max_dist": 0.5}])
def test_exact_matches_brute_force_with_a_hot_group_of_copies(clouds, options):
    rows, df = clouds
    want = brute(rows, 7, options.get("max_dist"))
    assert got(knn.chunk_neighbours(df, df, 7, **options)) == want


def test_blocks_do_not_change_the_result(clouds, monkeypatch):
    rows, df = clouds
    monkeypatch.setattr(knn, "BLOCK_ROWS", 16)
    monkeypatch.setattr(exact, "BLOCK_ROWS", 16)
    for options in ({"pivots": 4}, {"pivots": 1}, {"pivots": 40, "max_dist": 0.6}):
        assert got(knn.chunk_neighbours(df, df, 5, **options)) == brute(rows, 5, options.get("max_dist"))
    assert got(knn.chunk_neighbours(df, df, 5, pivots=4, probes=4)) == brute(rows, 5)
    some = df.where("htid < 'v003'")
    assert got(knn.chunk_neighbours(some, df, 5, pivots=4)) == {r for r in brute(rows, 5) if r[0] < "v003"}


def test_bounds_rule_out_most_blocks_of_clustered_data(spark, monkeypatch):
    monkeypatch.setattr(exact, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 40))
    vecs = np.vstack([c + rng.normal(size=(80, 40)) * 0.35 for c in centres])
    rows, df = table(spark, vecs)
    corpus = df.select(F.concat("htid", "seq").alias("vid"), "vec", "htid", "seq")
    u = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    found = exact.Blocks(corpus, u[::40])
    asked = found.corpus.select("vid", "vec", "block", "slot")
    d = np.sort(np.sqrt(np.maximum(0, 2 - 2 * u @ u.T)), axis=1)
    home = {(r.vid): (r.block, r.slot) for r in asked.collect()}
    bounds = spark.createDataFrame([(f"{r[0]}{r[1]}", float(d[i, 12])) for i, r in enumerate(rows)], "tvid string, bound double")
    pairs = exact.open_pairs(found, asked, bounds).collect()
    pieces = int(found.slots.sum())
    sent = {(tuple(p.home), (p.block, p.slot)) for p in pairs}
    assert pieces >= 24 and len(set(home.values())) == pieces
    assert len(sent) < 0.5 * pieces * (pieces - 1) and len(pairs) < 0.3 * len(rows) * pieces
    assert got(knn.chunk_neighbours(df, df, 12, pivots=24)) == brute(rows, 12)


def test_empty_and_unusable_corpora(spark):
    _, df = table(spark, [[0.0, 0.0], [float("nan"), 1.0]])
    for some in (df, df.where("false")):
        assert knn.chunk_neighbours(some, some, 3).collect() == []
    with pytest.raises(ValueError):
        knn.chunk_neighbours(df, df, 3, probes=2)


def test_self_is_kept_when_asked(clouds):
    rows, df = clouds
    assert got(knn.chunk_neighbours(df, df, 4, drop_self=False)) == brute(rows, 4, drop_self=False)


def test_targets_apart_from_corpus(clouds):
    rows, df = clouds
    some = df.where("htid < 'v003'")
    want = {r for r in brute(rows, 6) if r[0] < "v003"}
    assert got(knn.chunk_neighbours(some, df, 6, pivots=5)) == want


def test_probing_trades_recall_and_more_probes_find_more(clouds):
    rows, df = clouds
    want = {r[:4] for r in brute(rows, 5, drop_self=True)}
    found = [len(want & {r[:4] for r in got(knn.chunk_neighbours(df, df, 5, probes=p, pivots=9))}) for p in (1, 9)]
    assert found[0] <= found[1] == len(want)
    assert found[0] > 0.5 * len(want)


def test_unusable_vectors_are_left_out(spark):
    _, df = table(spark, [[1, 0], [0.9, 0.1], [0, 0], [float("nan"), 1]])
    for options in ({}, {"pivots": 2}):
        r = got(knn.chunk_neighbours(df, df, 3, **options))
        assert {x[1] for x in r} == {1, 2} and {x[3] for x in r} == {1, 2}


def test_one_target_chunk_per_matched_chunk(clouds):
    _, df = clouds
    one = knn.one_to_one(knn.chunk_neighbours(df, df, 8, drop_self=False))
    assert one.groupBy("target", "match", "match_seq").count().where("count > 1").isEmpty()


def test_min_count_is_lowered_to_the_target_length(spark):
    rows = [("a", 1, [1.0, 0.0]), ("b", 1, [1.0, 0.01]), ("b", 2, [0.0, 1.0]), ("c", 1, [0.01, 1.0]), ("c", 2, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "htid string, seq int, vec array<float>")
    nn = knn.chunk_neighbours(df, df, 5, max_dist=0.1, drop_self=False)
    s = {(r["target"], r["match"]) for r in doc_match_stats(nn, volume_extents(df), min_count=2).collect()}
    assert ("a", "b") in s and ("b", "a") not in s and ("b", "b") in s


@pytest.mark.parametrize("block", [1024, 8])
def test_banded_search_finds_what_shares_a_bucket(spark, monkeypatch, block):
    monkeypatch.setattr(bands, "BLOCK", block)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 64))
    vecs = np.vstack([b + rng.normal(size=(9, 64)) * 0.12 for b in base] + [np.repeat(base[:1], 40, axis=0), np.zeros((1, 64)), rng.normal(size=(60, 64))])
    rows, df = table(spark, vecs)
    found = got(knn.chunk_neighbours(df, df, 50, max_dist=0.3, banded=True))
    usable = [r for r in rows if any(r[2])]
    want = brute(usable, 50, 0.3)
    assert len(want) > 500 and {r[:4] for r in found} <= {r[:4] for r in want}
    assert len(found) >= 0.99 * len(want)
    some = df.where("htid < 'v004'")
    part = got(knn.chunk_neighbours(some, df, 50, max_dist=0.3, banded=True))
    assert {r[:4] for r in part} == {r[:4] for r in found if r[0] < "v004"}


def met_pairs(members, max_dist, dims):
    """Comparisons of the banded search, as a share of all pairs."""
    cells = bands.buckets(members, max_dist, dims).select(F.explode("cells").alias("key"))
    cells = cells.groupBy(F.shiftright("key", 1)).agg(F.sum(F.col("key") % 2).alias("own"), F.sum(1 - F.col("key") % 2).alias("guest"))
    n = members.count()
    return cells.agg(F.sum(F.col("own") * (F.col("own") - 1) / 2 + F.col("own") * F.col("guest"))).first()[0] / (n * (n - 1) / 2)


def members(df):
    return df.select(F.concat("htid", "seq").alias("vid"), F.lit(True).alias("t"), F.lit(True).alias("c"), "vec")


def test_banded_search_compares_few_pairs(spark):
    """Pairs that share a bucket, of all pairs of the flagship's chunks."""
    from catalog.neighbours import doc_chunks

    d = doc_chunks(spark, "/root/testdata/sf0.01", 500, 160)
    assert met_pairs(members(d), 0.25, 160) < 0.05


@pytest.mark.parametrize("spread", [0.3, 0.6])
def test_vectors_that_share_a_large_part(spark, spread):
    """As averaged word vectors: a common direction, and components of unequal size. Near pairs are spread over all lengths."""
    rng = np.random.default_rng(6)
    scale = np.linspace(0.5, 1.5, 64) / 8
    common = rng.normal(size=64)
    common /= np.linalg.norm(common)
    base = common + rng.normal(size=(500, 64)) * scale * spread
    near = base[:400] + rng.normal(size=(400, 64)) / 8 * rng.uniform(0.02, 0.25, size=(400, 1))
    rows, df = table(spark, np.vstack([base, near]))
    found = {r[:4] for r in got(knn.chunk_neighbours(df, df, 900, max_dist=0.25, banded=True))}
    want = {r[:4] for r in brute(rows, 900, 0.25)}
    assert found <= want and len(found) >= 0.95 * len(want) > 500
    assert bands.mean_direction(members(df), 64) @ common > bands.OFFSET
    share = met_pairs(members(df), 0.25, 64)
    assert share < (0.1 if spread == 0.6 else 1.0)


def test_vectors_at_every_length_from_the_mean(spark, monkeypatch):
    """Layers: owners meet guests from the layers above, and the rest near the mean is compared in full."""
    rng = np.random.default_rng(9)
    common = np.r_[np.ones(32) / 4, np.zeros(32)]
    way = rng.normal(size=(300, 64))
    way /= np.linalg.norm(way, axis=1, keepdims=True)
    base = common + way * rng.uniform(0.05, 1.5, size=(300, 1))
    rows, df = table(spark, np.vstack([base, base + rng.normal(size=base.shape) * 0.01]))
    found = {r[:4] for r in got(knn.chunk_neighbours(df, df, 600, max_dist=0.2, banded=True))}
    want = {r[:4] for r in brute(rows, 600, 0.2)}
    assert found <= want and len(found) >= 0.98 * len(want)


def test_distances_without_useful_bands_compare_all(spark):
    rng = np.random.default_rng(5)
    rows, df = table(spark, rng.normal(size=(150, 16)))
    assert bands.layers(1.25, False) == [(0.0, 0, 1)]
    assert got(knn.chunk_neighbours(df, df, 20, max_dist=1.25, banded=True)) == brute(rows, 20, 1.25)


def test_band_choices():
    for angle in (0.05, 0.25, 0.5, 0.8):
        width, n = bands.bands_for(angle)
        agree = (1 - angle / np.pi) ** width
        assert (1 - agree) ** n <= bands.MISSED and n <= bands.MAX_BANDS and n / 2 ** width <= bands.MET
    assert bands.bands_for(1.4) is None
    low = [r[0] for r in bands.layers(0.25, True)]
    assert low == sorted(low, reverse=True) and low[-1] == 0 and low[-2] > 0.25
    assert (bands.planes(8, 40)[:20] == bands.planes(8, 20)).all()


def test_only_the_best_of_each_target_leave_a_unit(clouds, monkeypatch):
    """Pieces of 16 rows: one list per target and run of the corpus, and one copy of a vector per run that meets it."""
    rows, df = clouds
    monkeypatch.setattr(exact, "BLOCK_ROWS", 16)
    corpus = knn._with_vid(df, ["htid", "seq"], "vec").groupBy("vid").agg(
        F.first("vec").alias("vec"), F.min(F.struct("htid", "seq")).alias("r")).select("vid", "vec", F.col("r.htid").alias("r0"), F.col("r.seq").alias("r1"))
    pivots = np.random.default_rng(1).normal(size=(4, 12))
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    distinct = corpus.count()
    _, hits = exact.exact_hits(corpus, None, pivots, 6, None, ["r0", "r1"], 7)
    assert hits.count() == 6 * distinct
    monkeypatch.setattr(exact, "CORPUS", 40)
    monkeypatch.setattr(exact, "TILE", 8)
    _, hits = exact.exact_hits(corpus, None, pivots, 6, None, ["r0", "r1"], 7)
    assert 6 * distinct < hits.count() <= 6 * distinct * -(-distinct // 24)
    for options in ({"pivots": 4}, {"pivots": 1, "max_dist": 0.6}, {"pivots": 4, "probes": 4}):
        assert got(knn.chunk_neighbours(df, df, 5, **options)) == brute(rows, 5, options.get("max_dist"))


def test_open_blocks_are_found_without_a_row_per_target_and_block(clouds):
    rows, df = clouds
    corpus = df.select(F.concat("htid", "seq").alias("vid"), "vec")
    u = np.array([r[2] for r in rows])
    found = exact.Blocks(corpus, u[::20] / np.linalg.norm(u[::20], axis=1, keepdims=True))
    asked = found.corpus.select("vec", F.lit(4.0).alias("bound"), F.lit(0).cast("long").alias("run")).coalesce(1)
    opened = asked.mapInArrow(exact._opened(found), "run long, place long").collect()
    assert sorted(r.place for r in opened) == list(range(len(found.blocks)))
    assert sorted(found.chain().tolist()) == list(range(len(found.blocks)))


def test_distances_without_bands_are_searched_exactly(clouds, monkeypatch):
    rows, df = clouds

    def none(*args):
        raise AssertionError("every pair by blocks, with a list from each")

    assert bands.says_nothing(1.25) and not bands.says_nothing(0.4)
    monkeypatch.setattr(knn, "banded_hits", none)
    assert got(knn.chunk_neighbours(df, df, 7, 1.25, banded=True)) == brute(rows, 7, 1.25)


def test_vectors_of_a_large_bucket_are_sent_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=64) + rng.normal(size=(2500, 64)) * 1e-6
    df = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(vecs)], "vid string, vec array<double>")
    df = df.withColumns({"t": F.lit(True), "c": F.lit(True)})

    def count(*_):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"tvid": [uuid.uuid4().hex], "mvid": ["sent"], "dist": [float(b.num_rows)]})
        return run

    monkeypatch.setattr(bands, "_compare", count)
    sent = bands.banded_hits(df, 5, 0.4, [], 64, 7).where("mvid = 'sent'").agg(F.sum("dist")).first()[0]
    assert sent == len(vecs)  # all near the mean, which is one bucket


def test_tiles_of_a_block_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(bands, "TILE", 64, raising=False)
    rng = np.random.default_rng(9)
    rows, df = table(spark, np.repeat(rng.normal(size=(6, 64)), 20, axis=0) + rng.normal(size=(120, 64)) * 0.02)
    found = got(knn.chunk_neighbours(df, df, 7, max_dist=0.4, banded=True))
    assert len(found) > 700 and found <= brute(rows, 7, 0.4)


def test_buckets_are_found_once_and_hold_numbers(spark):
    """Ids and vectors are not shuffled to find which buckets are shared, nor is a vector's bucket list made more than once."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(f"some-long-id-{i}", v.tolist()) for i, v in enumerate(rng.normal(size=(60, 64)))], "vid string, vec array<double>")
    hits = bands.banded_hits(df.withColumns({"t": F.lit(True), "c": F.lit(True)}), 5, 0.4, [], 64, 7)
    assert hits.where("tvid = mvid AND dist = 0").count() == 60
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "keys(" not in plan
    joined = [line for line in plan.splitlines() if "Generate explode(cells" in line or "Generate explode(" in line and "cells" in line]
    assert joined and not any("vid" in line or "vec" in line for line in joined)
