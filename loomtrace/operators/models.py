"""Where models plug in: named loaders run once a task over Arrow batches, with declared schemas.

A loader is a function without arguments that returns ``f(pandas.DataFrame) -> pandas.DataFrame``; it is
called on the executor, so a model is loaded there and never shipped. Two model-free ones come along: the
torso colour histogram of a frame crop and a tracker by box overlap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.runtime import ship_package

LOADERS: dict[str, tuple[Callable, str]] = {}


def register(name: str, loader: Callable, schema: str) -> None:
    LOADERS[name] = (loader, schema)


def apply_model(rows: DataFrame, name: str) -> DataFrame:
    """The rows of ``rows`` through the model of that name; unknown names are refused on the driver."""
    if name not in LOADERS:
        raise ValueError(f"unknown model {name!r}; known: {sorted(LOADERS)}")
    loader, schema = LOADERS[name]
    ship_package(rows.sparkSession)

    def run(frames):
        model = loader()
        for pdf in frames:
            yield model(pdf)

    return rows.mapInPandas(run, schema)


#: Bins of hue, saturation and value, and the band of the box that shows the torso.
HIST_BINS = (8, 4, 3)
TORSO = (0.35, 0.65)


def torso_histogram(image, box):
    """Shares of the torso's pixels (image: height x width x RGB bytes) in HSV bins; zeros for an empty box."""
    import numpy as np

    bins = int(np.prod(HIST_BINS))
    height, width = image.shape[:2]
    x1, y1 = (int(np.clip(np.floor(v), 0, max(n - 1, 0))) for v, n in zip(box[:2], (width, height), strict=True))
    x2, y2 = (int(np.clip(np.ceil(v), 0, n)) for v, n in zip(box[2:4], (width, height), strict=True))
    if x2 <= x1 or y2 <= y1:
        return np.zeros(bins)
    top = y1 + int(TORSO[0] * (y2 - y1))
    end = max(y1 + int(TORSO[1] * (y2 - y1)), top + 1)
    pixels = image[top:end, x1:x2].reshape(-1, 3) / 255.0
    high, spread = pixels.max(1), np.ptp(pixels, axis=1)
    grey = spread <= 1e-12
    safe = np.where(grey, 1.0, spread)
    r, g, b = pixels.T
    sector = np.select([b == high, g == high], [(r - g) / safe + 4, (b - r) / safe + 2], (g - b) / safe % 6)
    hue = np.where(grey, 0.0, sector / 6 % 1.0)
    saturation = np.where(high > 1e-12, spread / np.where(high > 1e-12, high, 1.0), 0.0)
    place = [np.minimum((v * n).astype(int), n - 1) for v, n in ((hue, HIST_BINS[0]), (saturation * 255 / 256, HIST_BINS[1]), (high * 255 / 256, HIST_BINS[2]))]
    return np.bincount(np.ravel_multi_index(place, HIST_BINS), minlength=bins) / len(pixels)


#: Boxes and tracks that are compared at once.
NEW_BOXES, OLD_BOXES = 64, 1 << 15


def overlaps(old, boxes, least_iou: float):
    """(row of old, row of boxes, intersection over union) of pairs that reach least_iou; pairs apart in x are not formed."""
    import numpy as np

    area = lambda b: (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    order, by = np.argsort(boxes[:, 0], kind="stable"), np.argsort(old[:, 0], kind="stable")
    left, reach = old[by, 0], np.maximum.accumulate(old[by, 2])
    cut = least_iou > 0 and bool(np.isfinite(old).all() and np.isfinite(boxes).all())
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for at in range(0, len(order), NEW_BOXES):
        new = order[at : at + NEW_BOXES]
        low = int(np.searchsorted(reach, boxes[new, 0].min(), "left")) if cut else 0
        end = int(np.searchsorted(left, boxes[new, 2].max(), "right")) if cut else len(by)
        for start in range(low, end, OLD_BOXES):
            held = by[start : min(start + OLD_BOXES, end)]
            a, b = old[held], boxes[new]
            wide = np.clip(np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0]), 0, None)
            tall = np.clip(np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1]), 0, None)
            both = wide * tall
            iou = both / np.maximum(area(a)[:, None] + area(b)[None] - both, 1e-12)
            x, y = np.nonzero(iou >= least_iou)
            found.append((held[x], new[y], iou[x, y]))
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def best_first(t, b, iou):
    """The pairs (t, b) that are taken when the largest iou goes first (ties: t, then b) and each t and b is taken once.

    A round takes every pair that comes first for both its sides, so few rounds replace the walk over all pairs."""
    import numpy as np

    order = np.lexsort((b, t, -iou))
    t, b, taken = t[order], b[order], [(t[:0], b[:0])]
    while len(t):
        rank = np.arange(len(t))
        best = np.ones(len(t), bool)
        for side in (t, b):
            first = np.zeros(side.max() + 1, np.int64)
            first[side[::-1]] = rank[::-1]
            best &= first[side] == rank
        taken.append((t[best], b[best]))
        kept = ~(np.isin(t, t[best]) | np.isin(b, b[best]))
        t, b = t[kept], b[kept]
    return tuple(np.concatenate(x) for x in zip(*taken, strict=True))


def track_boxes(det: DataFrame, least_iou: float = 0.3, max_age: int = 60) -> DataFrame:
    """(event_id, local_track): each box continues the live track of its clip that it overlaps most, or opens one.

    Within a frame the best overlaps are matched first (ties: older track, smaller event_id); a track dies when
    it has missed ``max_age`` frames. A clip is one ordered step, cut where ``max_age`` frames hold no box."""
    from pyspark.sql import Window

    ship_package(det.sparkSession)
    frames = det.select("clip_id", "frame_num").distinct()
    w = Window.partitionBy("clip_id").orderBy("frame_num")
    gap = F.col("frame_num") - F.lag("frame_num").over(w) > max_age
    parts = frames.withColumn("opens", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("part", F.sum("opens").over(w)).drop("opens")
    rows = det.select("event_id", "clip_id", "frame_num", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]).join(parts, ["clip_id", "frame_num"])

    def run(pdf):
        import numpy as np
        import pandas as pd

        first, last, box = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 4))  # of live tracks, older ones first
        out = []
        for frame, now in pdf.sort_values(["frame_num", "event_id"]).groupby("frame_num", sort=True):
            alive = frame - last <= max_age
            first, last, box = first[alive], last[alive], box[alive]
            boxes, ids = now[["x1", "y1", "x2", "y2"]].to_numpy(), now["event_id"].to_numpy()
            t, b = best_first(*overlaps(box, boxes, least_iou))
            last[t], box[t] = frame, boxes[b]
            given = ids.copy()
            given[b] = first[t]
            new = np.ones(len(ids), bool)
            new[b] = False
            first, last, box = np.concatenate([first, ids[new]]), np.concatenate([last, np.full(new.sum(), frame)]), np.concatenate([box, boxes[new]])
            out.append(pd.DataFrame({"event_id": ids, "local_track": given}))
        return pd.concat(out)

    return rows.groupBy("clip_id", "part").applyInPandas(run, "event_id long, local_track long")
