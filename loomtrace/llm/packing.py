"""Best-fit packing of documents into token sequences by non-negative least squares over patterns.

Only the histogram of piece lengths (at most ``capacity`` rows) reaches the driver. A round enumerates patterns
of two to ``PIECES`` lengths: exact fills by drawn partners, some for every length, then those that price out,
that is, the pattern through each length of which the fit has most left over (found exactly by dynamic
programming over the fill, with a price on waste). Repeat counts are fitted to the histogram by non-negative least
squares, with one more equation that asks for as few sequences as the volume needs, and rounded: whole parts
first, then larger fractions, patterns of longer pieces before those of shorter ones. Rounds go on with what is
left while they place something; the rest goes best-fit, longest first, into the room that patterns leave and into
new sequences, in runs of equal bins. The plan is a table of rank intervals per length, whose size follows the
number of distinct lengths and not the number of documents. Ranks come from per-task counts, so no length,
however common, meets in one task.

Defined cases: a null text is an empty one (its end id alone); a text of more than ``capacity`` tokens is cut into
pieces; null or repeated doc_ids are rows like any others; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.llm.tokens import END_ID, encoder, releasing, slices
from loomtrace.runtime import materialise, ship_package

CAPACITY = 4096
PIECES = 5
DRAWS = 4  # partners drawn for each length and pattern size
PRICINGS = 6
ROUNDS = 8
STEPS = 500  # at most, of the projected gradient in one fit
SETTLED = 0.005  # a step that moves no repeat by more ends it
LEAST_REPEAT = 0.02  # fitted repeats below this are rounding noise
WASTE_PRICE = 5.0  # a sequence of waste, in mean gains of a length
SPARE = 4  # priced patterns leave at most a SPARE-th of a sequence to the rest

PIECE_SCHEMA = "shard int, doc_id long, piece int, start long, length long, ids_crc32 long, local_rank long"


def _piece_partitions(tokenizer: str, capacity: int, end_id: int):
    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        shard, coder, seen = TaskContext.get().partitionId(), encoder(tokenizer), defaultdict(int)
        for whole in batches:
            for batch in slices(whole, "text"):
                doc, piece, start, length, crc, rank = [], [], [], [], [], []
                values, ends = coder.encode(batch.column("text"), end_id)
                raw, head = memoryview(values.view(np.uint8)), 0
                for doc_id, end in zip(batch.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                    for k, at in enumerate(range(head, end, capacity)):
                        stop = min(at + capacity, end)
                        n = stop - at
                        doc.append(doc_id)
                        piece.append(k)
                        start.append(at - head)
                        length.append(n)
                        crc.append(zlib.crc32(raw[4 * at : 4 * stop]))
                        rank.append(seen[n])
                        seen[n] += 1
                    head = end
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(doc), pa.int32()), pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64())]
                    + [pa.array(x, pa.int64()) for x in (length, crc, rank)],
                    names=["shard", "doc_id", "piece", "start", "length", "ids_crc32", "local_rank"],
                )

    return run


def enumerate_patterns(lengths: list[int], counts, capacity: int = CAPACITY, pieces: int = PIECES, draws: int = DRAWS, seed: int = 0) -> list[tuple[int, ...]]:
    """Patterns (indices into the ascending ``lengths``, largest first) that fill a sequence exactly.

    Every length gets its complement, and ``draws`` patterns of each larger size: all but the last partner are
    drawn by how often they occur, the last is what exactly fits, if there is such a length."""
    import numpy as np

    n, size = len(lengths), np.array(lengths)
    place = np.full(capacity + 1, -1)
    place[size] = np.arange(n)
    mass = np.concatenate([[0.0], np.cumsum(counts)])
    draw, found = np.random.default_rng(seed), {}
    for k in range(2, pieces + 1):
        heads = np.repeat(np.arange(n), 1 if k == 2 else draws)
        chosen, total, real = [heads], size[heads], np.ones(len(heads), bool)
        for _ in range(k - 2):
            fits = np.searchsorted(size, capacity - total - size[0], "right")  # lengths that leave room for one more
            real &= fits > 0
            fits = np.maximum(fits, 1)
            own = np.minimum(np.searchsorted(mass, draw.random(len(heads)) * mass[fits], "right") - 1, fits - 1)
            chosen.append(own)
            total = total + size[own]
        last = place[np.clip(capacity - total, 0, capacity)]
        real &= (total < capacity) & (last >= 0)
        rows = np.sort(np.stack([*chosen, last], 1)[real], axis=1)[:, ::-1]
        found.update(dict.fromkeys(map(tuple, rows.tolist())))
    return list(found)


def price_patterns(lengths: list[int], gains, capacity: int, pieces: int, spare: int, waste: float) -> list[tuple[int, ...]]:
    """For each length the pattern through it of most gain, less ``waste`` for an empty sequence; only those that gain."""
    import numpy as np

    best, last = [np.full(capacity + 1, -np.inf)], [np.zeros(capacity + 1, np.int64)]
    best[0][0] = 0.0
    for _ in range(pieces - 1):
        gain, pick = np.full(capacity + 1, -np.inf), np.zeros(capacity + 1, np.int64)
        for i, n in enumerate(lengths):
            more = best[-1][: capacity + 1 - n] + gains[i]
            better = np.flatnonzero(more > gain[n:])
            gain[n:][better], pick[n:][better] = more[better], i
        best.append(gain)
        last.append(pick)
    loss = waste * np.arange(spare + 1)[::-1] / capacity
    found = []
    for i, n in enumerate(lengths):
        room = capacity - n
        low = max(0, room - spare)
        values = [table[low : room + 1] - loss[len(loss) - (room + 1 - low) :] for table in best]
        k = max(range(pieces), key=lambda k: values[k].max())
        fill = low + int(values[k].argmax())
        if not values[k].max() + gains[i] > 0:
            continue
        own = [i]
        for depth in range(k, 0, -1):
            own.append(int(last[depth][fill]))
            fill -= lengths[own[-1]]
        found.append(tuple(sorted(own, reverse=True)))
    return found


def fit_patterns(patterns: list[tuple[int, ...]], counts, weights, sequences: float, start, pieces: int = PIECES, steps: int = STEPS, settled: float = SETTLED):
    """(repeats, what each length has left over): the repeats >= 0 of least weighted squares.

    Equations: each length's pieces are used up (weight ``weights``), and repeats sum to ``sequences`` (weight
    0.1). Accelerated projected gradient, restarted where it would go uphill."""
    import numpy as np

    n = len(counts)
    table = np.full((len(patterns), pieces), n)
    for row, p in zip(table, patterns, strict=True):
        row[: len(p)] = p
    flat, scale, goal, few = table.ravel(), np.append(weights, 0.0), np.append(counts, 0.0), 0.1

    def used(x):
        return np.bincount(flat, np.repeat(x, pieces), n + 1)

    steep = np.ones(len(patterns))
    for _ in range(12):  # the largest eigenvalue bounds the step
        steep = (scale * used(steep))[table].sum(1) + few * steep.sum()
        bound = float(np.linalg.norm(steep))
        steep /= bound
    x = ahead = start
    speed = 1.0
    for _ in range(steps):
        slope = (scale * (goal - used(ahead)))[table].sum(1) + few * (sequences - ahead.sum())
        new = np.maximum(0.0, ahead + slope / (1.05 * bound))
        if ((ahead - new) * (new - x)).sum() > 0:
            ahead, speed = new, 1.0
        else:
            after = (1 + (1 + 4 * speed * speed) ** 0.5) / 2
            ahead, speed = new + (speed - 1) / after * (new - x), after
        moved, x = float(np.abs(new - x).max()), new
        if moved < settled:
            break
    return x, (goal - used(x))[:n]


def best_fit_runs(histogram: dict[int, int], capacity: int = CAPACITY, open_bins: list[tuple[tuple[int, ...], int]] | None = None) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram, into open bins and new ones; bins with equal contents are kept as one run."""
    runs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], count: int) -> None:
        if not runs[room]:
            insort(rooms, room)
        runs[room].append((pattern, count))

    for pattern, count in open_bins or []:
        put(capacity - sum(pattern), pattern, count)
    for n in sorted(histogram, reverse=True):
        left = histogram[n]
        while left:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                per = capacity // n
                if left >= per:
                    put(capacity - per * n, (n,) * per, left // per)
                if left % per:
                    put(capacity - (left % per) * n, (n,) * (left % per), 1)
                break
            room = rooms[at]
            pattern, count = runs[room].pop()
            if not runs[room]:
                rooms.pop(at)
            take = min(left, count)
            if count > take:
                put(room, pattern, count - take)
            put(room - n, (*pattern, n), take)
            left -= take
    return [run for room in sorted(runs) for run in runs[room]]


def _round(lengths: list[int], counts: list[int], capacity: int, pieces: int, pricings: int, seed: int) -> list[tuple[tuple[int, ...], int]]:
    """One round: (pattern of indices, repeats) that the counts allow, fitted and rounded."""
    import numpy as np

    goal = np.array(counts, float)
    weights = np.array(lengths) / capacity
    sequences = float((weights * goal).sum())
    held: dict[tuple[int, ...], None] = {}

    def add(patterns) -> int:
        before = len(held)
        held.update((p, None) for p in patterns if all(p.count(i) <= counts[i] for i in set(p)))
        return len(held) - before

    repeats, left = np.zeros(0), goal
    fresh = add(enumerate_patterns(lengths, goal, capacity, pieces, seed=seed))
    for k in range(pricings + 1):
        if fresh:
            repeats, left = fit_patterns(list(held), goal, weights, sequences, np.concatenate([repeats, np.zeros(fresh)]), pieces)
        gains = weights * left
        if k == pricings or not (gains > 0).any():
            break
        fresh = add(price_patterns(lengths, gains, capacity, pieces, capacity // SPARE, WASTE_PRICE * float(gains[gains > 0].mean())))
        if not fresh:
            break
    room, plan = list(counts), []

    def take(pattern, most: int) -> int:
        count = min(most, *(room[i] // pattern.count(i) for i in pattern))
        if count > 0:
            plan.append((pattern, count))
            for i in pattern:
                room[i] -= count
        return count

    parts = dict(zip(held, repeats.tolist(), strict=True))
    for pattern in sorted(parts, key=lambda p: (-p[0], p)):
        if parts[pattern] >= 1:
            parts[pattern] -= take(pattern, int(parts[pattern]))
    for pattern in sorted(parts, key=lambda p: (-p[0], -parts[p], p)):
        if parts[pattern] > LEAST_REPEAT:
            take(pattern, 1)
    return plan


def fitted_patterns(histogram: dict[int, int], capacity: int = CAPACITY, pieces: int = PIECES, rounds: int = ROUNDS) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """((pattern, repeats) pairs, the histogram of pieces that no pattern takes)."""
    left, plan = {n: c for n, c in histogram.items() if c > 0}, []
    if capacity in left:
        plan.append(((capacity,), left.pop(capacity)))
    for k in range(rounds):
        lengths = sorted(left)
        found = _round(lengths, [left[n] for n in lengths], capacity, pieces, PRICINGS if k == 0 else 1, k) if left else []
        for pattern, count in found:
            plan.append((tuple(lengths[i] for i in pattern), count))
            for i in pattern:
                left[lengths[i]] -= count
        left = {n: c for n, c in left.items() if c}
        if not found:
            break
    return plan, left


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) pairs that use up the histogram exactly: fitted patterns, and best fit for what they leave."""
    plan, left = fitted_patterns(histogram, capacity)
    return best_fit_runs(left, capacity, plan)


def slot_intervals(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first sequence_id, offset): ranks from there on go to successive sequences."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, count in plan:
        offset = 0
        for n in pattern:
            rows.append((n, used[n], sequence, offset))
            used[n] += count
            offset += n
        sequence += count
    return sorted(rows)


def _place(rows: list[tuple[int, int, int, int]]):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = np.array(rows, np.int64).reshape(-1, 4)
        order = (table[:, 0] << 40) | table[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            rank = batch.column("rank").to_numpy()
            key = (batch.column("length").to_numpy() << 40) | rank
            slot = table[np.searchsorted(order, key, side="right") - 1]
            out = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            out += [pa.array(slot[:, 2] + rank - slot[:, 1]), pa.array(slot[:, 3])]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialise(rows.mapInArrow(releasing(_piece_partitions(tokenizer, capacity, end_id)), PIECE_SCHEMA), "pieces")
    counts = materialise(pieces.groupBy("shard", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    intervals = slot_intervals(plan_sequences(histogram, capacity))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # The bases have a row per task and length, so they grow with the input: merged, not broadcast.
    ranked = pieces.join(bases.hint("merge"), ["shard", "length"]).withColumn("rank", F.col("base") + F.col("local_rank"))
    return ranked.mapInArrow(
        _place(intervals),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
