"""Operators against small independent versions and hand-made cases."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.functions import scalars, vectors
from loomtrace.operators import cluster as C
from loomtrace.operators import evaluate as E
from loomtrace.operators import rules as R
from loomtrace.operators import similarity as S
from loomtrace.operators import tracklets as T
from loomtrace.operators.graph import connected_components
from loomtrace.sources import tables

DET = "event_id long, clip_id string, track_id long, frame_num long, quality double, confidence double"


def frames(spark, numbers, clip="c", track=1):
    return spark.createDataFrame([(k, clip, track, n, None, None) for k, n in enumerate(numbers)], DET)


def test_repeated_frame_opens_an_island(spark):
    rows = T.frame_ranges(frames(spark, [1, 2, 2, 3])).orderBy("s", "e").collect()
    assert [(r.s, r.e, r.n) for r in rows] == [(1, 2, 2), (2, 3, 2)]


def test_islands_of_random_frames(spark):
    draw = random.Random(5)
    for _ in range(4):
        numbers = sorted(draw.choices(range(1, 25), k=draw.randint(1, 20)))
        want, last = [], None
        for n in numbers:
            if last is not None and n == last + 1:
                want[-1][1] = n
            else:
                want.append([n, n])
            last = n
        shuffled = numbers[:]
        draw.shuffle(shuffled)
        # Ties are ordered by event_id, which does not change the islands of equal frames.
        rows = T.frame_ranges(frames(spark, shuffled)).collect()
        assert sorted([r.s, r.e] for r in rows) == sorted(want)


def test_cooccurrence(spark):
    spec = [(1, 1, 10), (2, 8, 20), (3, 21, 30)]
    ranges = spark.createDataFrame([("2", t, 1, s, e, e - s + 1) for t, s, e in spec] + [("3", 4, 1, 8, 20, 13)], "clip_id string, track_id long, island long, s long, e long, n long")
    for width in (1, 4, 1000):
        assert [(r.clip_id, r.a, r.b) for r in T.overlap_join(ranges, width).collect()] == [("2", 1, 2)]


def test_quality_rules(spark):
    rows = spark.createDataFrame([(None, None), (0.0, 0.4), (0.0, 0.0), (0.7, 0.1), (None, 1.8)], "q double, c double")
    q, c = F.col("q"), F.col("c")
    got = rows.select(scalars.quality_or_zero(q, c), scalars.quality_if_truthy(q, c), scalars.quality_or_one(q, c)).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0, 1.0), (0.0, 0.4, 0.0), (0.0, 0.0, 0.0), (0.7, 0.7, 0.7), (1.8, 1.8, 1.0)]


def test_vectors(spark):
    r = spark.range(1).select(
        vectors.normalise(F.array(F.lit(3.0), F.lit(4.0))).alias("u"),
        vectors.normalise(F.array(F.lit(0.0), F.lit(0.0))).alias("z"),
        vectors.chi_squared(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(1.0), F.lit(0.0))).alias("x"),
        vectors.chi_squared(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.5), F.lit(0.5))).alias("y"),
    ).first()
    assert r.u == pytest.approx([0.6, 0.8]) and r.z == [0.0, 0.0] and r.x == r.y > 0


def unit(n, dims, seed):
    x = np.random.default_rng(seed).normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vec_frame(spark, x):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")


@pytest.mark.parametrize("block_rows", [7, 100])
def test_radius_join_and_nearest(spark, block_rows):
    x = unit(40, 6, 1)
    d = np.clip(1 - x @ x.T, 0, 2)
    got = {(r.i, r.j): r.d for r in S.radius_join(vec_frame(spark, x), 0.8, block_rows).collect()}
    want = {(i, j): d[i, j] for i in range(40) for j in range(i + 1, 40) if d[i, j] <= 0.8}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in got)
    near = S.nearest(vec_frame(spark, x), 5, block_rows).collect()
    for i in range(40):
        mine = [r.j for r in sorted((r for r in near if r.i == i), key=lambda r: r.rank)]
        assert mine == [i, *sorted(set(range(40)) - {i}, key=lambda j: (d[i, j], j))[:5]]


def test_rerank_orders_neighbours(spark):
    x = np.array([[1, 0, 0], [0.99, 0.01, 0], [0, 1, 0]], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = {(r.i, r.j): r.d for r in S.rerank(vec_frame(spark, x), 2, 1, 0.3).collect()}
    assert d[(0, 1)] < d.get((0, 2), 1.0) and all(v >= 0 for v in d.values())


def test_connected_components(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(200), draw.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)] + [(500, 500)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


NODE = "id long, clip string, ranges array<struct<s:long,e:long>>"


def greedy(nodes, edges, eps, constrained):
    """Global greedy merging, written out."""
    group = {i: {i} for i, _, _ in nodes}
    info = {i: (c, r) for i, c, r in nodes}
    for d, i, j in sorted((d, i, j) for i, j, d in edges if d <= eps):
        a, b = group[i], group[j]
        if a is b:
            continue
        clash = any(
            info[x][0] == info[y][0] and (not constrained or any(p[0] <= q[1] and q[0] <= p[1] for p in info[x][1] for q in info[y][1])) for x in a for y in b
        )
        if not clash:
            a |= b
            for x in b:
                group[x] = a
    kept = sorted({min(g): g for g in group.values() if len(g) > 1}.items())
    label = {x: k for k, (_, g) in enumerate(kept) for x in g}
    return {i: label.get(i, -1) for i in group}


@pytest.mark.parametrize("constrained", [True, False])
def test_greedy_clusters(spark, constrained):
    draw = random.Random(11)
    nodes = [(k, f"c{draw.randrange(4)}", [(s := draw.randrange(60), s + 10)]) for k in range(40)]
    edges = [(i, j, round(draw.random(), 3)) for i, j in itertools.combinations(range(40), 2) if draw.random() < 0.1]
    got = C.greedy_clusters(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, "i long, j long, d double"), 0.6, 2, constrained)
    assert {r.id: r.label for r in got.collect()} == greedy(nodes, edges, 0.6, constrained)


@pytest.mark.parametrize(("ranges", "constrained", "labels"), [([(1, 10), (11, 20)], True, [0, 0]), ([(1, 10), (8, 20)], True, [-1, -1]), ([(1, 10), (11, 20)], False, [-1, -1])])
def test_greedy_goldens(spark, ranges, constrained, labels):
    nodes = spark.createDataFrame([(k, "1", [r]) for k, r in enumerate(ranges)], NODE)
    got = C.greedy_clusters(nodes, spark.createDataFrame([(0, 1, 0.01)], "i long, j long, d double"), 0.1, 2, constrained)
    assert [r.label for r in got.orderBy("id").collect()] == labels


def test_singletons_see_earlier_moves(spark):
    # 2 joins cluster 0 first; 3 is in view together with 2 and must stay out.
    nodes = spark.createDataFrame([(0, "a", [(1, 2)]), (1, "b", [(1, 2)]), (2, "c", [(5, 9)]), (3, "c", [(7, 8)])], NODE)
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, -1), (3, -1)], "id long, label int")
    edges = spark.createDataFrame([(0, 2, 0.1), (1, 3, 0.05), (2, 3, 0.01)], "i long, j long, d double")
    got = C.merge_singletons(nodes, labels, edges, 0.2)
    assert [r.label for r in got.orderBy("id").collect()] == [0, 0, 0, -1]


def test_noise_reassignment(spark):
    nodes = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(4)], "id long, hist array<double>")
    labels = spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0), (2, -1, 0.0), (3, -1, 0.0)], "id long, label int, probability double")
    pairs = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.2), (1, 2, 0.2), (0, 3, 0.2), (1, 3, 0.2)], "i long, j long, d double")
    got = C.reassign_noise(nodes, labels, pairs, 0.3).orderBy("id").collect()
    # 3 has no finite distance to 2, which joined before it.
    assert [(r.label, r.probability) for r in got] == [(0, 1.0), (0, 1.0), (0, 0.5), (-1, 0.0)]


def test_density_labels():
    x = np.array([0.0, 0.1, 0.2, 5.0, 5.1, 5.2, 50.0])
    labels, strength = C.density_labels(np.abs(x[:, None] - x[None, :]), 2)
    assert labels[0] == labels[1] == labels[2] != labels[3] == labels[4] == labels[5] and -1 not in labels[:6]
    assert labels[6] == -1 and strength[6] == 0 and strength[:6].min() > 0
    assert C.density_labels(np.zeros((1, 1)))[0].tolist() == [-1]


def _partition(labels):
    return {frozenset(k for k, v in labels.items() if v == c) for c in set(labels.values()) - {-1}}


@pytest.mark.parametrize("centres", [(0.0,), (0.0, 10.0), (0.0, 10.0, 20.0, 30.0)])
def test_density_by_component_equals_whole(spark, centres):
    draw = np.random.default_rng(len(centres))
    x = np.concatenate([c + np.concatenate([draw.normal(0, 0.1, 6), draw.normal(1.5, 0.1, 5)]) for c in centres] + [[100.0]])
    d = np.abs(x[:, None] - x[None, :])
    d[d > 3] = np.inf
    pairs = [(int(i), int(j), float(d[i, j])) for i, j in np.argwhere(np.isfinite(d)) if i < j]
    for epsilon in (0.0, 0.3, 2.0):
        want, strength = C.density_labels(d, 2, 1, epsilon)
        got = C.density_clusters(spark.createDataFrame(pairs, "i long, j long, d double"), spark.range(len(x)), epsilon).collect()
        assert _partition({r.id: r.label for r in got}) == _partition(dict(enumerate(want.tolist())))
        assert [r.probability for r in sorted(got, key=lambda r: r.id)] == pytest.approx(strength.tolist())


def test_density_queries_use_the_whole_matrix(spark):
    from loomtrace.plans.registry import clustering as P
    from tests.conftest import SMALL

    rows = sorted(tables.embeddings(spark, SMALL).collect(), key=lambda r: r.vec_id)
    x = np.array([r.v for r in rows])
    d = np.clip(1 - x @ x.T, 0, 2)
    np.fill_diagonal(d, 0.0)
    labels, _ = C.density_labels(d, 2, 1, 0.6)
    got = {r.id: r.label for r in P.hdbscan_clusters(spark, SMALL).collect()}
    assert _partition(got) == _partition({r.vec_id: c for r, c in zip(rows, labels.tolist(), strict=True)})
    hist = {r.vec_id: np.array(r.hist) for r in P.histograms(spark, SMALL).collect()}
    place = {r.vec_id: k for k, r in enumerate(rows)}
    label, clusters = dict(got), {}
    for k, c in sorted(got.items()):
        if c != -1:
            clusters.setdefault(c, []).append(k)
    for k in sorted(k for k, c in got.items() if c == -1):
        means = [(np.mean([d[place[k], place[m]] for m in own]), c) for c, own in clusters.items()]
        if not means:
            continue
        mean, c = min(means)
        whole = np.mean([hist[m] for m in clusters[c]], axis=0)
        whole = whole / (np.linalg.norm(whole) or 1.0)
        if mean <= 0.74 and ((hist[k] - whole) ** 2 / np.maximum(hist[k] + whole, 1e-12)).sum() <= 0.5:
            label[k] = c
            clusters[c].append(k)
    assert {r.id: r.label for r in P.noise_reassign(spark, SMALL).collect()} == label


def test_far_pairs_make_clusters_too(spark, monkeypatch):
    from loomtrace.plans.registry import clustering as P

    x = np.zeros((6, 6))
    for k, far in enumerate((0.1, 0.2, 0.8)):  # three pairs at these distances, all else at 1
        x[2 * k, 2 * k], x[2 * k + 1, 2 * k], x[2 * k + 1, 2 * k + 1] = 1, 1 - far, math.sqrt(1 - (1 - far) ** 2)
    rows = spark.createDataFrame([(k, 0, v.tolist()) for k, v in enumerate(x)], "vec_id long, label int, v array<double>")
    monkeypatch.setattr(tables, "embeddings", lambda *_: rows)
    monkeypatch.setattr(P, "_nodes", lambda *_: rows.select(F.col("vec_id").alias("id")))
    assert _partition({r.id: r.label for r in P.hdbscan_clusters(spark, "").collect()}) == {frozenset({0, 1}), frozenset({2, 3}), frozenset({4, 5})}


def test_medoids():
    x = np.array([0.0, 0.1, 0.2, 9.0, 9.1, 9.2])
    assert sorted(C.medoids(np.abs(x[:, None] - x[None, :]), 2, 51).tolist()) == [1, 4]
    assert len(C.medoids(np.zeros((3, 3)), 3, 0)) == 3


def test_assignment_is_optimal():
    draw = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 3), (2, 5), (5, 3), (6, 6)):
        cost = draw.integers(0, 20, (n, m))
        got = E.assign(cost)
        wide = cost if n <= m else cost.T
        best = min(sum(wide[r, c] for r, c in enumerate(p)) for p in itertools.permutations(range(max(n, m)), min(n, m)))
        assert len(got) == min(n, m) and sum(cost[r, c] for r, c in got.items()) == best


def test_perfect_labels(spark):
    items = spark.createDataFrame([(k % 3, k % 3) for k in range(9)], "gt long, pred long")
    assert E.adjusted_rand(items).first()[0] == 1.0 and E.purity(items).first()[0] == 1.0 and E.v_measure(items).first().v_measure == 1.0
    assert E.adjusted_rand(items.limit(1)).first()[0] == 1.0


def test_interval_iou(spark):
    spans = spark.createDataFrame([("a", "gt", 0.0, 1.0), ("a", "pred", 0.0, 1.0), ("b", "gt", 0.0, 0.0), ("c", "gt", 0.0, 1.0)], "clip_id string, side string, a double, b double")
    assert {r.clip_id: r.iou for r in E.interval_iou(spans).collect()} == {"a": 1.0, "b": 0.0, "c": 0.0}


def test_rules_tell_booleans_from_integers(spark):
    docs = spark.createDataFrame([(1, '{"clip_id": "a", "frame_num": true, "track_id": 1}'), (2, '{"clip_id": "a", "frame_num": 0, "track_id": 1}'), (3, "not json"), (4, '{"clip_id": "a", "frame_num": 3, "track_id": 4}')], "id long, doc string")
    got = {(r.id, r.path, r.message) for r in R.violations(docs, R.detection_rules()).collect()}
    assert (1, "frame_num", "must be an integer") in got and (2, "frame_num", "must be at least 1") in got
    assert {x[0] for x in got} == {1, 2, 3}


def test_rules_reach_every_element(spark):
    def broken(doc, rules):
        return {(r.path, r.message) for r in R.violations(spark.createDataFrame([(1, doc)], "id long, doc string"), rules).collect()}

    entry = '{"clip_id": "a", "local_track_id": 1, "frame_ranges": %s}'
    assert broken(entry % "[[1, 2], [3, 4]]", R.appearance_rules()) == broken(entry % "[]", R.appearance_rules()) == set()
    assert broken(entry % "[[1, 2], [9, 4], [5, true], [6]]", R.appearance_rules()) == {
        ("frame_ranges[1]", "start must not pass end"),
        ("frame_ranges[2]", "must hold integers"),
        ("frame_ranges[3]", "must be a pair of start and end"),
    }
    assert broken('{"clip_id": "a", "local_track_id": 1}', R.appearance_rules()) == {("frame_ranges", "must hold integers")}
    segment = '{"timestamp_start": %s, "timestamp_end": 5, "involved_people_global": [%s]}'
    scene = '{"label": "crime", "crime_segments": [%s, %s, {}]}' % (segment % (1, '3, "local_7"'), segment % (6.5, "4, 5, null"))
    assert broken(scene, R.scene_rules()) == {
        ("involved_people_global[0][1]", "must hold integers"),
        ("crime_segments[1]", "start must not pass end"),
        ("involved_people_global[1][2]", "must hold integers"),
    }


def test_read_or_compute(spark, tmp_path):
    path, calls = f"file://{tmp_path}/cache", []

    def compute():
        calls.append(1)
        return spark.range(3)

    assert [tables.read_or_compute(spark, path, compute).count() for _ in range(2)] == [3, 3] and len(calls) == 1
    assert tables.cache_key("d", "video", 4, "osnet") != tables.cache_key("d", "video", 4, "clip")
    assert tables.config_hash({"a": 1, "b": 2}) == tables.config_hash({"b": 2, "a": 1}) and len(tables.config_hash({})) == 10


def test_detections_json_and_frames(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text('[{"clip_id": "1", "frame_num": 1, "track_id": 2, "embeddings": [1, 0], "confidence": 0.5}]')
    assert tables.read_detections_json(spark, f"file://{path}").first().embeddings == [1.0, 0.0]
    schema = "clip_id string, video_path string, frame_num int, detections array<struct<track_id:int,embeddings:array<float>,confidence:double,det_confidence:double,bounding_box:array<double>>>"
    rows = spark.createDataFrame([("1", "/v", 1, [(1, [1.0], 0.5, None, [0.1, 0.2, 0.2, 0.2]), (2, None, 0.5, 0.1, None)])], schema)
    r = tables.flatten_frames(rows).collect()
    assert len(r) == 1 and r[0].confidence == 0.5 and r[0].center_x == pytest.approx(0.2)


def test_components_in_rounds_and_in_one_task(spark):
    import random

    from loomtrace.operators.graph import connected_components

    draw = random.Random(5)
    pairs = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(1000, 1001 + k) for k in range(3000)] + [(5000 + k, 5001 + k) for k in range(60)] + [(7, 7), (9000, 9000)]
    home = {x: x for p in pairs for x in p}

    def root(x):
        while home[x] != x:
            x = home[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        home[b] = a
    want = {x: root(x) for x in home}
    edges = spark.createDataFrame([*pairs, (None, 3)], "src long, dst long")
    for most in (0, 1500, 500_000):
        assert {r.node: r.component for r in connected_components(edges, task_edges=most).collect()} == want
    assert connected_components(edges.limit(0)).count() == 0


def test_documents_round_trip(spark, tmp_path):
    from loomtrace.sources import documents

    rows = [(1, "a", 7, [[1, 3], [5, 5]], 0.5), (1, "b", 2, [[4, 9]], 1.0), (2, "a", 8, [[2, 2]], 0.25)]
    book = documents.catalogue_documents(spark.createDataFrame(rows, "global_id long, clip_id string, track_id long, ranges array<array<long>>, probability double"))
    documents.write_documents(book, f"file://{tmp_path}/catalogue")
    got = documents.read_catalogue(spark, f"file://{tmp_path}/catalogue").collect()
    assert sorted(map(tuple, got)) == sorted((g, c, t, r, p) for g, c, t, r, p in rows)
    scenes = spark.createDataFrame([("a", "crime", 0.5, "x"), ("b", "normal", 0.0, "y")], documents.SCENE_SCHEMA)
    documents.write_documents(scenes, f"file://{tmp_path}/scenes")
    assert sorted(documents.read_scenes(spark, f"file://{tmp_path}/scenes").collect()) == sorted(scenes.collect())


def test_cache_is_resolved(spark, tmp_path):
    import os

    from loomtrace.sources import documents

    with pytest.raises(Exception):  # noqa: B017
        documents.resolve_cache(spark, str(tmp_path))
    for k, name in enumerate(["a_all_detections_v1.json", "b_all_detections_v2.json", "c.json"]):
        (tmp_path / name).write_text("[]")
        os.utime(tmp_path / name, (1000 - k, 1000 - k))
    assert documents.resolve_cache(spark, str(tmp_path)).endswith("/a_all_detections_v1.json")
    for name in ("old_all_detections.json", "old2_all_detections.json"):
        (tmp_path / name).write_text("[]")
        os.utime(tmp_path / name, (10, 10))
    assert documents.resolve_cache(spark, str(tmp_path)).endswith("/old_all_detections.json")  # the later name on a tie
    assert documents.resolve_cache(spark, str(tmp_path), f"{tmp_path}/c.json").endswith("/c.json")


def test_review_inputs(spark, tmp_path):
    from loomtrace.sources import documents

    good = {
        "detections": '{"clip_id":"a","frame_num":1,"track_id":2}',
        "catalogue": '{"clip_id":"a","local_track_id":2,"frame_ranges":[[1,2],[4,4]],"cluster_probability":0.5}',
        "scenes": '{"label":"crime","crime_segments":[{"timestamp_start":1,"timestamp_end":2,"involved_people_global":[1]}]}',
    }
    paths = []
    for name, text in good.items():
        (tmp_path / f"{name}.json").write_text(text + "\n")
        paths.append(str(tmp_path / f"{name}.json"))
    assert {k: v.count() for k, v in documents.review_inputs(spark, *paths).items()} == dict.fromkeys(good, 1)
    (tmp_path / "catalogue.json").write_text(good["catalogue"].replace("[4,4]", "[9,3]") + "\n")
    with pytest.raises(ValueError, match="catalogue: frame_ranges"):
        documents.review_inputs(spark, *paths)


def test_stage_times(spark):
    from loomtrace.runtime import StageTimes

    times = StageTimes()
    with times.stage("plan"):
        df = spark.range(10)
    assert times.run("count", df).count() == 10
    rows = times.report(spark).collect()
    assert [r.stage for r in rows] == ["plan", "count"] and abs(sum(r.percent for r in rows) - 100) < 0.01


def test_frame_labels_and_sets(spark):
    from loomtrace.operators import frames

    gt = frames.frame_sets(spark.createDataFrame([(1, "a", 1, 4), (1, "a", 3, 5), (2, "a", 5, 6)], "person long, clip_id string, s long, e long"))
    pred = frames.frame_sets(spark.createDataFrame([(9, "a", 4, 5), (9, "b", 1, 1)], "person long, clip_id string, s long, e long"))
    assert {(r.gt, r.pred, r.common, r.either) for r in frames.frame_set_overlap(gt, pred).collect()} == {(1, 9, 2, 6), (2, 9, 1, 4)}
    labels = {(r.clip_id, r.frame_num): (r.gt, r.pred) for r in frames.frame_labels(gt, pred).collect()}
    assert labels == {("a", 1): (1, -1), ("a", 2): (1, -1), ("a", 3): (1, -1), ("a", 4): (1, 9), ("a", 5): (2, 9), ("a", 6): (2, -1), ("b", 1): (-1, 9)}


@pytest.mark.parametrize(("block_rows", "most"), [(512, 10**6), (16, 20), (7, 1)])
def test_pair_summary_equals_brute_force(spark, block_rows, most):
    from loomtrace.operators import similarity as S

    rng = np.random.default_rng(7)
    x = rng.normal(size=(90, 6))
    x[40:60] = x[40]  # many equal distances
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tags = rng.integers(0, 3, 90)
    frame = spark.createDataFrame([(k, x[k].tolist(), int(tags[k])) for k in range(90)], "id long, v array<double>, tag long")
    i, j = np.triu_indices(90, 1)
    d = np.clip(1 - (x @ x.T)[i, j], 0, 2)
    for positive, copies in ((False, 1), (True, 2)):
        found = S.pair_summary(frame, (0.0, 0.05, 0.5, 0.77, 1.0), (0.3, 1.0), positive, copies, block_rows, most)
        assert [g["alike"] for g in found] == [0, 1]
        for g in found:
            own = d[(tags[i] == tags[j]) == bool(g["alike"])]
            own = own[own > 1e-12] if positive else own
            if positive:  # rounding may leave equal vectors a hair apart: those are told from none here
                assert abs(g["n"] - len(own)) <= 190
                continue
            assert g["n"] == len(own) and g["low"] == pytest.approx(own.min(), abs=1e-12) and g["high"] == pytest.approx(own.max())
            assert g["within"] == [int((own <= 0.3).sum()), int((own <= 1.0).sum())] and g["broken"] == 0
            assert np.allclose(g["quantiles"], np.quantile(np.repeat(own, copies), (0.0, 0.05, 0.5, 0.77, 1.0)))
    least = {(r.i, r.j): r.d for r in S.linkage(frame.withColumnRenamed("tag", "grp"), "min", 6).collect()}
    full = np.clip(1 - x @ x.T, 0, 2)
    assert least == {(a, b): pytest.approx(full[np.ix_(tags == a, tags == b)].min()) for a in range(3) for b in range(a + 1, 3)}
    pairs = {(r.i, r.j) for r in S.radius_join(frame.select("id", "v"), 0.4, block_rows).collect()}
    assert pairs == {(a, b) for a, b, y in zip(i.tolist(), j.tolist(), d.tolist(), strict=True) if y <= 0.4}


def test_pca_equals_the_eigenvectors(spark):
    from loomtrace.plans import registry
    from loomtrace.sources import tables
    from tests.conftest import SMALL

    rows = tables.embeddings(spark, SMALL).orderBy("vec_id").collect()
    x = np.array([r.v for r in rows])
    _, axes = np.linalg.eigh(np.cov(x.T))
    axes = axes[:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), [0, 1]])
    got = {r.vec_id: (r.c0, r.c1) for r in registry.QUERIES["pca_2d"](spark, SMALL).collect()}
    assert len(got) == len(rows)
    assert np.allclose([got[r.vec_id] for r in rows], x @ axes, atol=2e-5)


def test_identity_assignment_is_optimal(spark):
    from collections import Counter

    from loomtrace.plans import registry
    from loomtrace.sources import tables
    from tests.conftest import SMALL

    cells = Counter((r.gt, r.pred) for r in tables.eval_items(spark, SMALL).collect())
    preds, best = sorted({p for _, p in cells}), {0: 0}
    for g in sorted({g for g, _ in cells}):  # most overlap for every set of taken predictions
        after = dict(best)
        for taken, value in best.items():
            for k, p in enumerate(preds):
                if not taken >> k & 1 and cells[g, p]:
                    after[taken | 1 << k] = max(after.get(taken | 1 << k, 0), value + cells[g, p])
        best = after
    rows = registry.QUERIES["identity_assignment"](spark, SMALL).collect()
    assert len({r.gt for r in rows}) == len({r.pred for r in rows}) == len(rows)
    assert all(r.n == cells[r.gt, r.pred] > 0 for r in rows) and sum(r.n for r in rows) == max(best.values())


def test_forest_of_blocks_is_that_of_all_pairs(spark):
    x = unit(60, 5, 8)
    x[40:46] = x[3]  # copies: their order among equal distances is by id
    d = np.clip(1 - x @ x.T, 0, 2)
    np.fill_diagonal(d, 0.0)
    got = S.forest(vec_frame(spark, x), block_rows=9)
    rows = got.collect()
    assert len(rows) == 59 and all(r.i < r.j and math.isclose(r.d, d[r.i, r.j], abs_tol=1e-12) for r in rows)
    assert sum(r.d for r in rows) == pytest.approx(sum(C.dense_forest(np.arange(60), np.arange(60), np.where(np.eye(60), np.inf, d))[2]))
    want, _ = C.density_labels(d, 2, 1, 0.1)
    assert _partition({r.id: r.label for r in C.density_clusters(got, spark.range(60), 0.1).collect()}) == _partition(dict(enumerate(want.tolist())))


def test_many_splits_cost_no_square():
    # Pairs that split off one after the other: lists of all points at every split would hold 25 million.
    gaps = (np.tile([1e-3, 1.0], 5000) * np.linspace(1, 2, 10000))[:9999]
    labels, _ = C.forest_labels(10000, np.arange(9999), np.arange(1, 10000), gaps)
    assert labels.max() == 4999 and (labels[::2] == labels[1::2]).all()


def test_noise_in_batches_equals_given_pairs(spark, monkeypatch):
    monkeypatch.setattr(C, "BATCH", 4)
    rng = np.random.default_rng(4)
    x = np.repeat(np.eye(3), 14, axis=0) + rng.normal(0, 0.3, (42, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vecs = vec_frame(spark, x)
    rows = [(k, int(k // 14) if k % 14 < 4 else -1, 0.25) for k in range(42)]
    labels = spark.createDataFrame(rows, "id long, label int, probability double")
    colours = spark.createDataFrame([(k, None if k % 5 == 0 else rng.dirichlet([0.6, 0.6, 0.6]).tolist()) for k in range(42)], "id long, hist array<double>")
    want = C.reassign_noise(colours, labels, S.radius_join(vecs, S.ALL), 0.4, 0.3).collect()
    got = C.reassign_near(vecs, S.cosine, labels, colours, 0.4, colour_limit=0.3).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want} and {r.label for r in got if r.id % 14 >= 4} == {-1, 0, 1, 2}
    none = labels.withColumn("label", F.lit(-1))
    assert {r.label for r in C.reassign_near(vecs, S.cosine, none, colours, 0.4).collect()} == {-1}


@pytest.mark.parametrize(("block", "size"), [(4, 64), (7, 1 << 20), (1000, 1 << 20)])
def test_partners_equal_overlap_pairs(spark, monkeypatch, block, size):
    monkeypatch.setattr(T, "FRAME_BYTES", size)
    draw = random.Random(21)
    rows = [(c, t, k, (s := draw.randrange(200)), s + draw.randrange(9), 1) for c in "ab" for t in draw.sample(range(500), 90) for k in range(draw.randint(1, 3))]
    ranges = spark.createDataFrame(rows, "clip_id string, track_id long, island long, s long, e long, n long")
    before, after = {}, {}
    for r in T.overlap_join(ranges).collect():
        after[r.clip_id, r.a] = after.get((r.clip_id, r.a), 0) + 1
        before[r.clip_id, r.b] = before.get((r.clip_id, r.b), 0) + 1
    got = {(r.clip_id, r.track_id): (r.before, r.after) for r in T.partners(ranges, block).collect()}
    assert got == {(c, t): (before.get((c, t), 0), after.get((c, t), 0)) for c, t, *_ in rows}


def test_digest_beyond_a_long(spark, monkeypatch):
    from loomtrace.plans import tracklets as P

    big = 10**12
    det = spark.createDataFrame([(k, "c", big + k, 1, None, None) for k in range(6)], DET)
    monkeypatch.setattr(tables, "detections", lambda *_: det)
    (row,) = P.cooccurrence_join(spark, "").collect()
    assert (row.n_pairs, row.digest) == (15, sum((big + a) * 1000003 + big + b for a, b in itertools.combinations(range(6), 2)))


@pytest.mark.parametrize("most", [0, 1 << 28])
@pytest.mark.parametrize("constrained", [True, False])
def test_presence_is_cooccurrence(monkeypatch, constrained, most):
    monkeypatch.setattr(C, "MASK_BYTES", most)
    draw = random.Random(17)
    items = [(f"c{draw.randrange(3)}", [(s := draw.randrange(900), s + draw.randrange(60)) for _ in range(draw.randint(1, 4))]) for _ in range(80)]
    flat = [(k, s, e) for k, (_, ranges) in enumerate(items) for s, e in ranges]
    seen = C.Presence(np.array([c for c, _ in items]), *(np.array(x) for x in zip(*flat, strict=True)), constrained)
    a, b = np.divmod(np.arange(6400), 80)
    want = [x[0] == y[0] and (not constrained or any(p[0] <= q[1] and q[0] <= p[1] for p in x[1] for q in y[1])) for x in items for y in items]
    assert seen.clash(a, b).tolist() == want
    seen.add(3, 4)
    assert seen.clash(np.full(80, 3), np.arange(80)).tolist() == [want[240 + k] or want[320 + k] for k in range(80)]


def test_steps_go_over_batches(spark, monkeypatch):
    monkeypatch.setattr(C, "STEP_ROWS", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    draw = random.Random(23)
    nodes = [(k, f"c{draw.randrange(6)}", [(s := draw.randrange(60), s + 6)]) for k in range(60)]
    edges = [(i, j, round(draw.random(), 2)) for i, j in itertools.combinations(range(60), 2) if draw.random() < 0.3]
    held, pairs = spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, "i long, j long, d double")
    try:
        labels = C.greedy_clusters(held, pairs, 0.2)
        found = {r.id: r.label for r in labels.collect()}
        merged = {r.id: r.label for r in C.merge_singletons(held, labels, pairs, 0.6).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == greedy(nodes, edges, 0.2, True)
    near = {}
    for i, j, d in edges:
        near[i, j] = near[j, i] = d
    meet = lambda x, y: nodes[x][1] == nodes[y][1] and nodes[x][2][0][0] <= nodes[y][2][0][1] and nodes[y][2][0][0] <= nodes[x][2][0][1]
    want = dict(found)
    for x in range(60):
        if found[x] == -1:
            best = sorted((min(near.get((x, m), 9.0) for m in want if want[m] == c), c) for c in set(want.values()) - {-1})
            want[x] = next((c for d, c in best if d <= 0.6 and not any(meet(x, m) for m in want if want[m] == c)), -1)
    assert merged == want and merged != found


def test_nearest_among_many_copies(spark):
    x = np.repeat(unit(3, 4, 2), 12, axis=0)
    got = S.nearest(vec_frame(spark, x), 3, 10).collect()
    first = {r.i: r.j for r in got if r["rank"] == 0}
    assert first == {k: k for k in range(36)}  # itself, though smaller ids lie as near
    assert all(r.i // 12 == r.j // 12 for r in got) and len(got) == 36 * 4


def test_triplets_broadcast_no_table_of_tracklets(spark):
    from loomtrace.plans.registry import clustering as P
    from tests.conftest import SMALL

    plan = P.triplet_mining(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") >= 6


def test_vectors_meet_detections_where_they_are_windowed(spark):
    from tests.conftest import SMALL

    plan = T.smooth(tables.detections(spark, SMALL, vectors=True), 4)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("BroadcastHashJoin")]
    assert "Window" in above and "Exchange hashpartitioning" not in above


def test_pairs_of_blocks_are_not_shuffled(spark):
    plan = S.radius_join(vec_frame(spark, unit(50, 4, 3)), 0.5, 10)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_blocks_are_packed_where_the_rows_are(spark):
    x = unit(200, 4, 5)
    packed = S.pack(vec_frame(spark, x).repartition(3), 30)
    blocks = packed.collect()
    assert len({b.block for b in blocks}) == len(blocks) and max(len(b.rows) for b in blocks) == 30
    assert sorted(r.id for b in blocks for r in b.rows) == sorted(r.id for r in vec_frame(spark, x).collect())
    assert all([r.id for r in b.rows] == sorted(r.id for r in b.rows) for b in blocks)
    owned = vec_frame(spark, x).withColumn("owner", F.floor(F.col("id") / 7)).repartition(5)
    homes = [{r.owner for r in b.rows} for b in S.pack(owned, 30, "owner").collect()]
    assert sum(map(len, homes)) == len(set.union(*homes)) and len(homes) > 3


def test_each_vector_leaves_the_search_once(spark):
    """Tasks that read one part and another are joined, so that one of them meets all blocks."""
    x = unit(240, 4, 6)
    found = S.nearest(vec_frame(spark, x).repartition(6), 4, 20)
    rows = found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(rows) == 240 * 5 and "Coalesce" in plan and "CartesianProduct" in plan
    s = x @ x.T
    np.fill_diagonal(s, np.inf)
    ids = sorted({r.i for r in rows})
    want = {(ids[i], ids[j]) for i in range(240) for j in sorted(range(240), key=lambda j: (-s[i, j], j))[:5]}  # noqa: B023
    assert {(r.i, r.j) for r in rows} == want


def test_pairs_without_an_open_end_are_left_out(spark):
    x = unit(60, 4, 8)
    vecs = vec_frame(spark, x)
    pairs = {(r.i, r.j) for r in S.radius_join(vecs, 0.6, 20).collect()}
    got = {(r.i, r.j) for r in S.radius_join(vecs.withColumn("open", F.col("id") % 9 == 0), 0.6, 20).collect()}
    assert got == {p for p in pairs if p[0] % 9 == 0 or p[1] % 9 == 0} and got != pairs


def test_edges_come_packed_to_the_step(spark, monkeypatch):
    """Rows in order of (d, id, j) over several ranges; the one task sorts packed rows, not edges."""
    from loomtrace.operators import cluster as C

    rng = np.random.default_rng(4)
    rows = [(int(i), int(j), float(d)) for i, j, d in zip(rng.integers(0, 50, 5000), rng.integers(0, 50, 5000), rng.random(5000).round(2), strict=True)]
    edges = spark.createDataFrame(rows, "id long, j long, d double")
    nodes = spark.createDataFrame([(k, "c", [(k, k)]) for k in range(50)], "id long, clip string, ranges array<struct<s:long,e:long>>")

    def step(ids, seen, label, batches):
        import pyarrow as pa

        for i, j, d in batches:
            yield pa.RecordBatch.from_pydict({"i": i, "j": j, "d": d})

    out = C._in_order(nodes, edges, ["d", "id", "j"], step, "i long, j long, d double")
    assert [(r.i, r.j, r.d) for r in out.collect()] == sorted(rows, key=lambda r: (r[2], r[0], r[1]))
    assert "edges" in out._jdf.queryExecution().executedPlan().toString()
