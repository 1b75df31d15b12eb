"""Whole runs on planted persons, the tracker, the colour histogram, plugged-in models and numbering."""

import colorsys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.operators import models, persons
from loomtrace.operators.order import numbered

DIMS = 8
SCHEMA = "event_id long, clip_id string, track_id long, frame_num long, confidence double, quality double, v array<double>, x1 long, y1 long, x2 long, y2 long"


def planted(spark):
    """Three persons; 0 and 1 are in view together in clip a, each person returns in clip b, track 9 is seen once."""
    rng = np.random.default_rng(5)
    rows = []

    def seen(clip, track, person, frames):
        for f in frames:
            v = np.eye(DIMS)[person] + rng.normal(0, 0.02, DIMS)
            rows.append((len(rows), clip, track, f, 0.9, 0.8, v.tolist(), 10 * track, 0, 10 * track + 8, 20))

    for person in range(3):
        seen("a", person, person, range(1 + 4 * person, 9 + 4 * person))
        seen("b", 5 + person, person, range(1, 8))
    seen("b", 9, 6, [40])
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("way", [lambda d: persons.graph_persons(d, DIMS, 0.2), lambda d: persons.density_persons(d, DIMS, 0.2, 0.25)])
def test_planted_persons(spark, way):
    got = {(r.clip_id, r.track_id): r for r in way(planted(spark)).collect()}
    assert set(got) == {("a", k) for k in range(3)} | {("b", k) for k in (5, 6, 7)}
    assert all(got["a", k].global_id == got["b", 5 + k].global_id for k in range(3))
    assert sorted({r.global_id for r in got.values()}) == [1, 2, 3] and all(r.in_cluster for r in got.values())


def test_tracks_follow_boxes(spark):
    rows = [(0, "c", 0, 1, 1.0, 1.0, None, 0, 0, 10, 10), (1, "c", 0, 1, 1.0, 1.0, None, 50, 50, 60, 60), (2, "c", 0, 2, 1.0, 1.0, None, 1, 1, 11, 11)]
    rows += [(3, "c", 0, 3, 1.0, 1.0, None, 50, 51, 60, 61), (4, "c", 0, 70, 1.0, 1.0, None, 50, 51, 60, 61), (5, "d", 0, 3, 1.0, 1.0, None, 0, 0, 10, 10)]
    got = {r.event_id: r.local_track for r in models.track_boxes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1, 4: 4, 5: 5}  # 4 comes after the track has died
    assert models.track_boxes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_torso_histogram_equals_pixel_by_pixel():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (40, 30, 3), dtype=np.uint8)
    image[18] = 77  # a grey line
    box = (2.4, 3.5, 25.2, 37.9)
    want = Counter()
    for y in range(3 + int(0.35 * 35), 3 + int(0.65 * 35)):
        for x in range(2, 26):
            h, s, v = colorsys.rgb_to_hsv(*(image[y, x] / 255.0))
            want[min(int(h * 8), 7), min(int(s * 255 / 64), 3), min(int(v * 255 / (256 / 3)), 2)] += 1
    got = models.torso_histogram(image, box).reshape(8, 4, 3)
    assert got.sum() == pytest.approx(1)
    assert {k: n / sum(want.values()) for k, n in want.items()} == pytest.approx({tuple(map(int, k)): got[tuple(k)] for k in np.argwhere(got > 0)})
    assert models.torso_histogram(image, (5, 5, 5, 9)).sum() == 0


def test_plugged_in_model(spark):
    models.register("doubler", lambda: lambda pdf: pdf.assign(y=pdf["x"] * 2)[["x", "y"]], "x long, y long")
    got = models.apply_model(spark.range(10).withColumnRenamed("id", "x"), "doubler").collect()
    assert len(got) == 10 and all(r.y == 2 * r.x for r in got)
    with pytest.raises(ValueError):
        models.apply_model(spark.range(1), "absent")


def test_numbers_are_consecutive_in_order(spark):
    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k").repartition(5)
    assert [(r.k, r.n) for r in numbered(rows, ["k"], "n").orderBy("k").collect()] == [(k, k + 1) for k in range(1000)]
    assert numbered(rows.where("k < 0"), ["k"], "n").count() == 0


def dense_rerank(x, k1=20, k2=6, weight=0.3):
    """k-reciprocal distances with whole matrices and plain sets."""
    n = len(x)
    k1, k2 = min(max(k1, 1), n - 1), min(max(k2, 1), n)
    s = x @ x.T
    np.fill_diagonal(s, 1.0)
    o = np.maximum(2 - 2 * s, 0)
    o = o / np.where(o.max(1, keepdims=True) > 0, o.max(1, keepdims=True), 1)
    rank = [sorted(range(n), key=lambda j: (j != i, -s[i, j], j)) for i in range(n)]  # noqa: B023
    mutual = lambda i, k: {j for j in rank[i][: k + 1] if i in rank[j][: k + 1]}
    full, half = [mutual(i, k1) for i in range(n)], [mutual(i, round(k1 / 2)) for i in range(n)]
    v = np.zeros((n, n))
    for i in range(n):
        own = set(full[i])
        for q in full[i]:
            if 3 * len(half[q] & full[i]) > 2 * len(half[q]):
                own |= half[q]
        own = sorted(own)
        v[i, own] = np.exp(-o[i, own]) / np.exp(-o[i, own]).sum()
    v = np.array([v[rank[i][:k2]].mean(0) for i in range(n)])
    both = np.array([[np.minimum(v[i], v[j]).sum() for j in range(n)] for i in range(n)])
    return np.maximum((1 - weight) * (1 - both / (2 - both)) + weight * (o + o.T) / 2, 0)


def drawn(n_persons, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n_persons, DIMS))
    rows, start = [], {}
    for track in range(4 * n_persons):
        person, clip = track % n_persons, "abc"[track % 3]
        start[track] = int(rng.integers(1, 60))
        for f in range(start[track], start[track] + int(rng.integers(3, 14))):
            v = base[person] + rng.normal(0, 0.35, DIMS)
            rows.append((len(rows), clip, track, f, float(rng.random()), None if rng.random() < 0.2 else float(rng.random()), v.tolist(), 0, 0, 8, 20))
    return rows


@pytest.mark.parametrize("rerank", [False, True])
def test_density_run_equals_dense_version(spark, rerank):
    from loomtrace.operators import cluster as C

    rows = drawn(5, 3)
    unit = lambda a: a / np.linalg.norm(a, axis=-1, keepdims=True)
    tracks, protos, owner = sorted({(r[1], r[2]) for r in rows}), [], []
    for k, (clip, track) in enumerate(tracks):
        own = sorted((r for r in rows if (r[1], r[2]) == (clip, track)), key=lambda r: (-(r[5] if r[5] is not None else r[4]), r[3], r[0]))[:20]
        v = unit(np.array([r[6] for r in own]))
        if len(v) >= 3:
            v = unit(np.array([v[max(0, x - 2) : x + 3].mean(0) for x in range(len(v))]))
        p = v.mean(0, keepdims=True) if len(v) < 6 else v[np.unique(C.medoids(np.clip(1 - v @ v.T, 0, 2), 3, 51))]
        protos += list(unit(p))
        owner += [k] * len(p)
    protos, owner = np.array(protos), np.array(owner)
    d = dense_rerank(protos) if rerank else np.clip(1 - protos @ protos.T, 0, 2)
    n = len(tracks)
    whole = np.array([[0.0 if a == b else d[np.ix_(owner == a, owner == b)].min() for b in range(n)] for a in range(n)])
    frames = [{r[3] for r in rows if (r[1], r[2]) == t} for t in tracks]
    for a in range(n):
        for b in range(n):
            if a != b and tracks[a][0] == tracks[b][0] and frames[a] & frames[b]:
                whole[a, b] = np.inf
    valid = whole[np.isfinite(whole) & (whole > 0)]
    epsilon, gate = max(np.percentile(valid, 5), 0.18), np.percentile(valid, 15)
    labels, _ = C.density_labels(whole, 2, 1, epsilon)
    for x in range(n):
        if labels[x] < 0:
            means = [(whole[x, labels == c].mean(), c) for c in sorted(set(labels.tolist()) - {-1})]
            if means and min(means)[0] <= gate:
                labels[x] = min(means)[1]
    got = {(r.clip_id, r.track_id): r for r in persons.density_persons(spark.createDataFrame(rows, SCHEMA), DIMS, rerank=rerank).collect()}
    assert set(got) == set(tracks)
    for a in range(n):
        assert got[tracks[a]].in_cluster == (labels[a] >= 0)
        for b in range(a):
            assert (got[tracks[a]].global_id == got[tracks[b]].global_id) == (labels[a] == labels[b] >= 0)


@pytest.mark.parametrize("linkage", ["representative", "min", "mean"])
def test_graph_run_by_linkage(spark, linkage):
    det = planted(spark).withColumn("timestamp_sec", F.col("frame_num") / 30.0)
    got = {(r.clip_id, r.track_id): r.global_id for r in persons.graph_persons(det, DIMS, 0.2, linkage=linkage, temporal=0.01).collect()}
    assert all(got["a", k] == got["b", 5 + k] for k in range(3)) and len(set(got.values())) == 3
    apart = persons.graph_persons(det, DIMS, 0.2, linkage=linkage, temporal=9.0).collect()
    assert len({r.global_id for r in apart}) > 3  # no place alike, no link


def test_exact_quantiles(spark):
    from loomtrace.operators.order import exact_quantiles

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.random(300), np.full(200, 0.25), [5.0]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "d double")
    for copies in (1, 2):
        for most in (10, 10**6):
            assert exact_quantiles(df, "d", (0.0, 0.1, 0.5, 1.0), copies, most) == pytest.approx(np.quantile(np.repeat(x, copies), (0.0, 0.1, 0.5, 1.0)))
    assert exact_quantiles(df.limit(0), "d", (0.5,)) is None


def test_boxes_in_chunks_and_rounds_equal_the_walk(monkeypatch):
    rng = np.random.default_rng(9)
    for size in (0, 3, 200):
        corner = rng.integers(0, 60, (size + 150, 2))
        boxes = np.hstack([corner, corner + rng.integers(5, 25, (size + 150, 2))]).astype(float)
        old, new = boxes[:size], boxes[size:]
        monkeypatch.setattr(models, "NEW_BOXES", 7)
        monkeypatch.setattr(models, "OLD_BOXES", 11)
        wide = np.clip(np.minimum(old[:, None, 2:], new[None, :, 2:]) - np.maximum(old[:, None, :2], new[None, :, :2]), 0, None).prod(-1)
        area = lambda b: (b[:, 2:] - b[:, :2]).prod(-1)
        iou = wide / (area(old)[:, None] + area(new)[None] - wide)
        t, b, share = models.overlaps(old, new, 0.3)
        assert sorted(zip(t.tolist(), b.tolist(), strict=True)) == [tuple(x) for x in np.argwhere(iou >= 0.3).tolist()]
        want, used = [], (set(), set())
        for _, x, y in sorted((-iou[x, y], x, y) for x, y in np.argwhere(iou >= 0.3).tolist()):
            if x not in used[0] and y not in used[1]:
                want.append((x, y))
                used[0].add(x)
                used[1].add(y)
        assert sorted(zip(*(v.tolist() for v in models.best_first(t, b, share)), strict=True)) == sorted(want)


def test_least_of_owners(spark):
    from loomtrace.operators import similarity as S

    x = np.random.default_rng(6).normal(size=(90, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = [[int(k // 3 % 4), 100 + k // 3] for k in range(90)]  # thirty owners of three; four kinds that must not meet
    rows = spark.createDataFrame([(k, v.tolist(), k // 3, codes[k]) for k, v in enumerate(x)], "id long, v array<double>, owner long, codes array<long>")
    d = np.clip(1 - x @ x.T, 0, 2).reshape(30, 3, 30, 3).min((1, 3))
    kind = np.arange(30) % 4
    d[kind[:, None] == kind[None, :]] = np.inf
    got = {(r.i, r.j): r.d for r in S.forest(rows, S.least_of_owners(S.cosine), "owner", 20).collect()}
    i, j, w = S.dense_forest(np.arange(30), np.arange(30), d.copy())
    assert got == pytest.approx(dict(zip(zip(i.tolist(), j.tolist(), strict=True), w.tolist(), strict=True)))
    valid = np.repeat(d[np.isfinite(d) & (np.arange(30)[:, None] < np.arange(30)[None, :])], 2)
    assert S.adaptive_limits(rows, 0.0, S.least_of_owners(S.cosine), "owner") == pytest.approx(tuple(np.quantile(valid, (0.05, 0.15))))


def test_reranked_distances_need_no_table(spark):
    from loomtrace.operators import similarity as S

    x = np.random.default_rng(12).normal(size=(50, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = dense_rerank(x, 8, 3)
    np.fill_diagonal(d, np.inf)
    items, distance = S.rerank_items(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>"), 8, 3)
    got = {(r.i, r.j): r.d for r in S.forest(items, distance, block_rows=13).collect()}
    i, j, w = S.dense_forest(np.arange(50), np.arange(50), d.copy())
    assert got == pytest.approx(dict(zip(zip(i.tolist(), j.tolist(), strict=True), w.tolist(), strict=True)))


def test_prototypes_are_packed_once(spark, monkeypatch):
    """Limits, tree and noise read the same blocks: no further copy of the prototypes is written."""
    from loomtrace.operators import similarity as S

    names, write = [], S.materialise
    monkeypatch.setattr(S, "materialise", lambda df, name, **o: names.append((name, "owner" in df.schema.simpleString())) or write(df, name, **o))
    monkeypatch.setattr(persons, "materialise", lambda df, name, **o: names.append((name, "owner" in df.columns)) or write(df, name, **o))
    rows = spark.createDataFrame(drawn(5, 3), SCHEMA)
    assert persons.density_persons(rows, DIMS, rerank=True).count() == 20
    assert [x for x in names if x[1]] == [("blocks", True)]


@pytest.mark.parametrize("gap", [None, 40.0])
def test_penalties_are_added_where_vectors_meet(spark, gap):
    from loomtrace.operators import similarity as S

    rng = np.random.default_rng(7)
    odd = lambda k, x: None if k % 5 == 0 else float(x)
    rows = [(k, (v / np.linalg.norm(v)).tolist(), odd(k, rng.random()), odd(k + 1, 9 * rng.random()), odd(k + 2, 90 * rng.random())) for k, v in enumerate(rng.normal(size=(80, 4)))]
    vecs = spark.createDataFrame(rows, "id long, v array<double>, ratio double, speed double, sec double")
    want = persons._penalised(vecs.drop("v"), S.radius_join(vecs.select("id", "v"), 0.6), 0.05, 0.02, gap).where("d <= 0.6")
    joined = S.penalised_join(vecs, 0.6, 0.05, 0.02, gap)
    got = {(r.i, r.j): r.d for r in joined.collect()}
    assert got == pytest.approx({(r.i, r.j): r.d for r in want.collect()}) and len(got) > 50
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_forest_is_worked_out_by_many_tasks_and_noise_out_of_reach_is_passed_over(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 6)) + 4 * np.eye(6)[rng.integers(0, 6, 90)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    items = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>").repartition(12)
    where = str(tmp_path)

    def distance(a, b):
        from pathlib import Path

        from pyspark import TaskContext

        Path(where, str(TaskContext.get().partitionId())).touch()
        return np.clip(1 - a["v"] @ b["v"].T, 0, 2)

    tree = persons.S.forest(items, distance, block_rows=9)
    assert len(list(tmp_path.iterdir())) > 1
    labels = spark.createDataFrame([(k, k % 4 if k % 3 == 0 else -1, 0.3) for k in range(90)], "id long, label int, probability double")
    colours = spark.createDataFrame([(k, None) for k in range(90)], "id long, hist array<double>")
    for gate in (0.02, 0.1, 0.7):
        whole, some = (sorted(map(tuple, persons.C.reassign_near(items, persons.S.cosine, labels, colours, gate, tree=t).collect())) for t in (None, tree))
        assert whole == some


def test_prototypes_smooth_by_rank_as_tracklets_do(spark):
    rng = np.random.default_rng(9)
    rows = [(f"c{t % 2}", t, r + 1, rng.normal(size=4).tolist()) for t in range(9) for r in range(t + 1)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(c, int(t), int(r), v) for c, t, r, v in rows], "clip_id string, track_id long, rank int, v array<double>").repartition(3)
    smoothed = persons.T.smooth(frame, 4, order=("rank",)).withColumn("v", F.col("smoothed"))
    got, want = ({(r.clip_id, r.track_id): r.prototypes for r in rows.collect()} for rows in (persons.C.prototypes(frame, width=5), persons.C.prototypes(smoothed)))
    assert got.keys() == want.keys() and len(got) == 9
    for key, own in want.items():
        assert np.allclose(got[key], own)


def test_neighbours_closer_than_single_precision_and_sparse_common_sets(spark):
    rng = np.random.default_rng(10)
    x = np.repeat(rng.normal(size=(4, 8)), 15, axis=0) + rng.normal(0, 1e-6, (60, 8))  # neighbours differ by about 1e-12
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    s = np.einsum("ik,jk->ij", x, x)
    for k in (3, 20):
        rows = persons.S.nearest(frame, k, block_rows=7).collect()
        assert len(rows) == 60 * (k + 1)
        for r in rows:
            order = np.sort(np.where(np.arange(60) == r.i, np.inf, s[r.i]))[::-1]
            assert r.low == pytest.approx(s[r.i].min(), abs=1e-15) and (r.rank == 0) == (r.i == r.j)
            assert r.rank == 0 or abs(s[r.i, r.j] - order[r.rank]) < 1e-15
    a = {"js": (np.array([2, 0, 1]), np.array([1, 5, 7])), "xs": (np.array([2, 0, 1]), np.array([0.2, 0.8, 1.0]))}
    b = {"js": (np.array([1, 2]), np.array([9, 1, 5])), "xs": (np.array([1, 2]), np.array([1.0, 0.5, 0.5]))}
    row, column, common = persons.S._common(a, b)
    assert (row.tolist(), column.tolist()) == ([0], [1]) and common == pytest.approx([0.7])  # no matrix of zeros
