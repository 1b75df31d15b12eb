"""Removal of repeated passages with difference-cover suffix sorting.

A byte goes if a ``LENGTH``-byte string that covers it also starts in a document with a smaller doc_id.
Sorting the suffixes of a whole corpus would move every byte many times, so strings that can repeat
are found first, and equal strings are brought together before they are sorted:

1. Copies. Whole texts are folded by their SHA-256; of equal texts the least doc_id is worked on.
2. Anchors. Every LENGTH-byte string has an owner: its least-hashed ``GRAM``-gram, a choice that depends on
   its bytes alone, so equal strings have equal owners. Blocks of texts send their owners' hashes
   (6 bytes each, by hash range) to find those that occur in two or more texts.
3. Contexts. Strings with a shared owner are sent, as one stretch of bytes for each owner, to the task of
   the owner's hash. There the suffixes of the distinct stretches are sorted by the difference-cover
   algorithm (sort sampled triples, recurse on their names, merge the remaining suffixes), adjacent
   prefixes are compared, and every run of equal strings gets its least doc_id.
4. Blocks get the answers back and cut their texts.

An owner in more than ``HOT_TEXTS`` texts would crowd one task: its strings go one by one to the task of
their own 128-bit hash instead and are folded there, which gives the same answer.

Defined cases: a null text is empty; a null doc_id counts as larger than any other; rows that share a
doc_id do not shorten each other; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.operators.skew import join_heavy
from loomtrace.runtime import discard, materialise, ship_package

LENGTH = 50
GRAM = 20
BLOCK_BYTES = 4 << 20
PIECE_BYTES = 64 << 10
HOT_TEXTS = 20_000
SORT_SYMBOLS = 1 << 20
SLICES_PER_PARTITION = 4
BROADCAST_ROWS = 2_000_000
NO_ID = (1 << 63) - 1

_HASH_BITS = 48


# --- difference cover -------------------------------------------------------------------------------


def suffix_array(symbols):
    """Suffix array of positive integers under 2**21 (at most 2**21 - 4 of them), by difference cover modulo 3."""
    import numpy as np

    s = np.asarray(symbols, np.uint64)
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    pad = np.concatenate([s, np.zeros(4, np.uint64)])
    m = n + (n % 3 == 1)  # a closing sample so that the halves of the reduced string stay apart
    one, two = np.arange(1, m, 3), np.arange(2, m, 3)
    sample = np.concatenate([one, two])
    b21, b42 = np.uint64(21), np.uint64(42)
    triples = (pad[sample] << b42) | (pad[sample + 1] << b21) | pad[sample + 2]
    order = np.argsort(triples, kind="stable")
    ranked = triples[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    names = np.cumsum(fresh)
    if names[-1] < len(sample):
        reduced = np.empty(len(sample), np.uint64)
        reduced[order] = names.astype(np.uint64)
        order = suffix_array(reduced)
    sorted_sample = sample[order]
    rank = np.zeros(m + 4, np.uint64)
    rank[sorted_sample] = np.arange(1, len(sorted_sample) + 1, dtype=np.uint64)
    sorted_sample = sorted_sample[sorted_sample < n]
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort((pad[zero] << b21) | rank[zero + 1], kind="stable")]
    # A sampled suffix is compared with the unsampled through the first position both have a rank for.
    before = np.zeros(len(sorted_sample), np.int64)
    first = sorted_sample % 3 == 1
    a = sorted_sample[first]
    before[first] = np.searchsorted((pad[zero] << b21) | rank[zero + 1], (pad[a] << b21) | rank[a + 1])
    b = sorted_sample[~first]
    before[~first] = np.searchsorted((pad[zero] << b42) | (pad[zero + 1] << b21) | rank[zero + 2], (pad[b] << b42) | (pad[b + 1] << b21) | rank[b + 2])
    out = np.empty(n, np.int64)
    at = before + np.arange(len(sorted_sample))
    left = np.ones(n, bool)
    left[at] = False
    out[at] = sorted_sample
    out[left] = zero
    return out


def _words_at(data, at, length: int):
    """Rows of 64-bit words that spell data[at : at + length]; data is padded by 8 bytes."""
    import numpy as np

    view = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    offsets = [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else [])
    return np.stack([np.ascontiguousarray(view[at + o]).view(np.uint64)[:, 0] for o in offsets], axis=1)


def least_ids(contexts: list[bytes], ids, length: int = LENGTH):
    """For every length-byte string of the contexts, in order, the least id of a context that holds it."""
    import numpy as np

    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    data = np.frombuffer(b"\0".join(contexts) + b"\0" * 9, np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    symbols = data[: int(sizes.sum()) + len(contexts)].astype(np.uint64) + np.uint64(2)
    symbols[starts + sizes] = 1
    windows = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(contexts)), windows)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + starts[owner]
    index = np.full(len(symbols), -1, np.int64)
    index[place] = np.arange(len(place))
    order = index[suffix_array(symbols)]
    order = order[order >= 0]
    if not len(order):
        return np.zeros(0, np.int64)
    spelled = _words_at(data, place[order], length)
    fresh = np.ones(len(order), bool)
    fresh[1:] = (spelled[1:] != spelled[:-1]).any(1)
    heads = np.flatnonzero(fresh)
    least = np.minimum.reduceat(np.asarray(ids, np.int64)[owner[order]], heads)
    out = np.empty(len(order), np.int64)
    out[order] = least[np.cumsum(fresh) - 1]
    return out


# --- owners -----------------------------------------------------------------------------------------


def _gram_hashes(data, gram: int):
    """A mixed 64-bit hash of the gram that starts at each position."""
    import numpy as np

    with np.errstate(over="ignore"):
        power = np.uint64(0x100000001B3)
        level = data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        level ^= level >> np.uint64(29)
        out, done, size, n = None, 0, 1, len(data) - gram + 1
        # Doubling: level holds the hashes of 1, 2, 4... bytes; those in gram's binary form are put together.
        while size <= gram:
            if gram & size:
                part = level[done : done + n]
                out = part.copy() if out is None else out * power + part
                done += size
            if 2 * size <= gram:
                level = level[: len(level) - size] * power + level[size:]
                power = power * power
            size *= 2
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(28)
    return out


def owner_runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Maximal runs of string starts with one owner: (text index, first start, last start, owner hash), in text
    order; starts are positions within the text."""
    import numpy as np

    found, head, held = [], 0, 0
    for k, text in enumerate(texts):  # pieces of about PIECE_BYTES, so that the arrays stay in the processor's cache
        held += len(text)
        if held >= PIECE_BYTES or k + 1 == len(texts):
            found.append(_piece_runs(texts[head : k + 1], head, length, gram))
            head, held = k + 1, 0
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def _piece_runs(texts: list[bytes], head: int, length: int, gram: int):
    import numpy as np

    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    hashes = _gram_hashes(data, gram)
    # The least of each window of grams: hash above, position below, so ties go to the leftmost.
    low = hashes >> np.uint64(30)
    low <<= np.uint64(30)
    low |= np.arange(len(hashes), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    # Runs of equal owners; then the strings that would cross texts are cut off them.
    heads = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    owner = (low[heads] & np.uint64((1 << 30) - 1)).astype(np.int64)
    stops = np.append(heads[1:], len(low)) - 1
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    starts = np.concatenate([[0], ends[:-1]])
    # An owner lies in one text, but the run of strings around it can begin in the text before.
    text = np.searchsorted(ends, owner, side="right")
    first = np.maximum(heads, starts[text])
    last = np.minimum(stops, ends[text] - length)
    good = first <= last
    text, first, last = text[good], first[good], last[good]
    # A second mix: owners are least hashes, so their own upper bits are not evenly spread.
    name = hashes[owner[good]]
    name = (name ^ (name >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    name = (name ^ (name >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return text + head, first - starts[text], last - starts[text], name >> np.uint64(64 - _HASH_BITS)


# --- blocks -----------------------------------------------------------------------------------------


def _pack(*arrays) -> bytes:
    import zlib

    import numpy as np

    raw = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    return np.array([len(r) for r in raw], "<i8").tobytes() + zlib.compress(b"".join(raw), 1)


def _unpack(blob: bytes, *types):
    import zlib

    import numpy as np

    sizes = np.frombuffer(blob, "<i8", len(types)).tolist()
    raw, at, out = memoryview(zlib.decompress(memoryview(blob)[8 * len(types) :])), 0, []
    for size, kind in zip(sizes, types, strict=True):
        part = raw[at : at + size]
        out.append(bytes(part) if kind is bytes else np.frombuffer(part, kind))
        at += size
    return out


BLOCK_SCHEMA = "block long, data binary"


def _block_partitions(block_bytes: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        squeeze = zstandard.ZstdCompressor(level=1)
        base, count = TaskContext.get().partitionId() << 32, 0
        keys, texts, held = [], [], 0

        def row():
            head = np.array([len(texts), *keys, *map(len, texts)], "<i8").tobytes()
            data = squeeze.compress(head + b"".join(texts))
            return pa.RecordBatch.from_arrays([pa.array([base + count], pa.int64()), pa.array([data], pa.binary())], names=["block", "data"])

        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                keys.append(key)
                texts.append(text)
                held += len(text)
                if held >= block_bytes:
                    yield row()
                    count += 1
                    keys, texts, held = [], [], 0
        if texts:
            yield row()

    return run


def _open_block(data: bytes):
    """(keys, texts) of a block."""
    import numpy as np
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    keys = np.frombuffer(raw, "<i8", n, 8)
    sizes = np.frombuffer(raw, "<i8", n, 8 + 8 * n).tolist()
    at, texts = 8 + 16 * n, []
    for size in sizes:
        texts.append(raw[at : at + size])
        at += size
    return keys, texts


def _slice_cuts(hashes, slices: int):
    """Where each of the equal hash ranges begins in a sorted array."""
    import numpy as np

    bounds = np.array([(k << _HASH_BITS) // slices for k in range(1, slices)], np.uint64)
    return [0, *np.searchsorted(hashes, bounds).tolist(), len(hashes)]


SLICE_SCHEMA = "slice int, block long, blob binary"


def _rows(rows: list[tuple]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
        names=["slice", "block", "blob"],
    )


def _owner_blobs(slices: int, length: int, gram: int):
    """Each block's owner hashes, sorted, with the number of its texts that have them."""

    def run(batches):
        import numpy as np

        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                _, texts = _open_block(data)
                text, _, _, owner = owner_runs(texts, length, gram)
                # Once per text: runs are in text order, so sort by (hash, text) and drop repeats.
                order = np.lexsort((text, owner))
                owner, text = owner[order], text[order]
                once = np.ones(len(owner), bool)
                once[1:] = (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])
                hashes, n = np.unique(owner[once], return_counts=True)
                cuts, rows = _slice_cuts(hashes, slices), []
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if b > a:
                        six = hashes[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                        rows.append((k, block, _pack(six, np.minimum(n[a:b], 65535).astype("<u2"))))
                if rows:
                    yield _rows(rows)

    return run


def _by_slice(batches):
    """(slice, [(block, blob)]) of a partition that is sorted by slice."""
    current, held = None, []
    for batch in batches:
        for s, block, blob in zip(*(batch.column(c).to_pylist() for c in ("slice", "block", "blob")), strict=True):
            if s != current:
                if held:
                    yield current, held
                current, held = s, []
            held.append((block, blob))
    if held:
        yield current, held


def _shared_owners(hot_texts: int):
    """For each block, its hashes that occur in two or more texts, and which of them are hot."""

    def run(batches):
        import numpy as np

        for s, held in _by_slice(batches):
            parts = []
            for _, blob in held:
                six, n = _unpack(blob, np.uint8, "<u2")
                eight = np.zeros((len(n), 8), np.uint8)
                eight[:, :6] = six.reshape(-1, 6)
                parts.append((eight.view("<u8")[:, 0], n))
            hashes = np.concatenate([h for h, _ in parts])
            _, back = np.unique(hashes, return_inverse=True)
            total = np.bincount(back, weights=np.concatenate([n for _, n in parts]))[back]
            shared, hot, at, rows = total > 1, total > hot_texts, 0, []
            for (block, _), (own, _) in zip(held, parts, strict=True):
                part = slice(at, at + len(own))
                at += len(own)
                if shared[part].any():
                    rows.append((s, block, _pack(own[shared[part]], hot[part][shared[part]].astype(np.uint8))))
            if rows:
                yield _rows(rows)

    return run


def _gathered(parts: DataFrame) -> DataFrame:
    """One row per block with all blobs meant for it; no more than the block itself sent."""
    return parts.groupBy(F.col("block").alias("of")).agg(F.collect_list("blob").alias("blobs"))


def _shared_sets(blobs):
    """(shared hashes, hot flags), sorted by hash."""
    import numpy as np

    parts = [_unpack(b, "<u8", np.uint8) for b in blobs]
    hashes, hot = np.concatenate([h for h, _ in parts]), np.concatenate([x for _, x in parts]).astype(bool)
    order = np.argsort(hashes)
    return hashes[order], hot[order]


def _members(values, sorted_set):
    """Position of each value in the sorted set, or -1."""
    import numpy as np

    at = np.searchsorted(sorted_set, values)
    at[at == len(sorted_set)] = 0
    return np.where(sorted_set[at] == values, at, -1) if len(sorted_set) else np.full(len(values), -1)


def _context_blobs(slices: int, length: int, gram: int):
    """Each block's distinct contexts by owner: (owner, context hash, least and greatest key, size, bytes).

    Strings with a hot owner are contexts of one string each, dealt by their own hash."""

    def run(batches):
        import numpy as np
        import xxhash

        for batch in batches:
            for block, data, blobs in zip(*(batch.column(c).to_pylist() for c in ("block", "data", "blobs")), strict=True):
                keys, texts = _open_block(data)
                found: dict[bytes, list] = {}
                for owner, body, _, t in _contexts(texts, *_shared_sets(blobs), length, gram):
                    key = int(keys[t])
                    if (own := found.get(body)) is None:
                        found[body] = [owner, key, key]
                    else:
                        own[1], own[2] = min(own[1], key), max(own[2], key)
                items = sorted((v[0], xxhash.xxh64_intdigest(body), body, v[1], v[2]) for body, v in found.items())
                hashes = np.array([x[0] for x in items], np.uint64)
                cuts, rows = _slice_cuts(hashes, slices), []
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if b > a:
                        part = items[a:b]
                        blob = _pack(
                            hashes[a:b],
                            np.array([x[1] for x in part], "<u8"),
                            np.array([x[3] for x in part], "<i8"),
                            np.array([x[4] for x in part], "<i8"),
                            np.array([len(x[2]) for x in part], "<u2"),
                            b"".join(x[2] for x in part),
                        )
                        rows.append((k, block, blob))
                if rows:
                    yield _rows(rows)

    return run


def _contexts(texts, shared, hot, length: int, gram: int):
    """(hash to deal by, body, first start within the text, text index) of every run with a shared owner."""
    import numpy as np
    import xxhash

    text, first, last, owner = owner_runs(texts, length, gram)
    at = _members(owner, shared)
    chosen = np.flatnonzero(at >= 0)
    columns = (text[chosen], first[chosen], last[chosen], owner[chosen], hot[at[chosen]])
    for t, a, b, h, is_hot in zip(*(c.tolist() for c in columns), strict=True):
        if is_hot:
            for s in range(a, b + 1):
                body = texts[t][s : s + length]
                yield xxhash.xxh64_intdigest(body, 1) >> (64 - _HASH_BITS), body, s, t
        else:
            yield h, texts[t][a : b + length], a, t


def _answer_blobs(length: int, symbols: int):
    """For each block, its contexts' least ids, where any text of the block has a greater one.

    An owner with one distinct context needs no sorting: all its strings have the context's least id."""

    def run(batches):
        import numpy as np

        for s, held in _by_slice(batches):
            parts, bodies = [[] for _ in range(5)], []
            for k, (_, blob) in enumerate(held):
                *numbers, size, body = _unpack(blob, "<u8", "<u8", "<i8", "<i8", "<u2", bytes)
                for column, values in zip(parts, (*numbers, np.full(len(size), k)), strict=True):
                    column.append(values)
                ends = np.cumsum(size.astype(np.int64)).tolist()
                bodies += [body[x:y] for x, y in zip([0, *ends], ends, strict=False)]
            owner, name, low, high, home = map(np.concatenate, parts)
            order = np.lexsort((name, owner))
            owner, name, low, high, home = owner[order], name[order], low[order], high[order], home[order]
            # Distinct contexts (by owner and name) and their least ids; then owners with two or more of them.
            new = np.ones(len(order), bool)
            new[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])
            heads = np.flatnonzero(new)
            which = np.cumsum(new) - 1
            least = np.minimum.reduceat(low, heads)
            group = np.ones(len(heads), bool)
            group[1:] = owner[heads][1:] != owner[heads][:-1]
            group = np.cumsum(group) - 1
            mixed = np.bincount(group)[group] > 1
            plain = ~mixed[which] & (least[which] < high)
            varied: dict[int, object] = {}
            chosen, size, last = [], 0, -1

            def solve():
                values = least_ids([bodies[order[heads[d]]] for d in chosen], least[chosen], length)  # noqa: B023
                ends = np.cumsum([len(bodies[order[heads[d]]]) - length + 1 for d in chosen]).tolist()  # noqa: B023
                varied.update(zip(chosen, (values[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))  # noqa: B023

            for d, g in zip(np.flatnonzero(mixed).tolist(), group[mixed].tolist(), strict=True):
                if size >= symbols and g != last:
                    solve()
                    chosen, size = [], 0
                chosen.append(d)
                size += len(bodies[order[heads[d]]]) + 1
                last = g
            if chosen:
                solve()
            answers: list[list] = [[] for _ in held]
            rows = np.flatnonzero(mixed[which])
            for r, d, k, most in zip(name[rows].tolist(), which[rows].tolist(), home[rows].tolist(), high[rows].tolist(), strict=True):
                if int(varied[d].min()) < most:
                    answers[k].append((r, varied[d]))
            out = []
            for k, (block, _) in enumerate(held):
                same = plain & (home == k)
                if same.any() or answers[k]:
                    values = np.concatenate([v for _, v in answers[k]]) if answers[k] else np.zeros(0, np.int64)
                    names, sizes = np.array([n for n, _ in answers[k]], "<u8"), np.array([len(v) for _, v in answers[k]], "<u2")
                    out.append((s, block, _pack(name[same], least[which[same]], names, sizes, values.astype("<i8"))))
            if out:
                yield _rows(out)

    return run


CUT_SCHEMA = "key long, sha string, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut_blocks(length: int, gram: int, keep_text: bool):
    """The cut texts of a block; texts that lose nothing are left out."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for data, shared, blobs in zip(*(batch.column(c).to_pylist() for c in ("data", "shared", "blobs")), strict=True):
                keys, texts = _open_block(data)
                answers: dict[int, object] = {}
                for blob in blobs:
                    same, least, names, sizes, values = _unpack(blob, "<u8", "<i8", "<u8", "<u2", "<i8")
                    answers.update(zip(same.tolist(), least.tolist(), strict=True))
                    ends = np.cumsum(sizes.astype(np.int64)).tolist()
                    answers.update(zip(names.tolist(), (values[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
                ids = keys.tolist()
                spans: dict[int, list] = {}
                for _, body, start, t in _contexts(texts, *_shared_sets(shared), length, gram):
                    if (own := answers.get(xxhash.xxh64_intdigest(body))) is None:
                        continue
                    if isinstance(own, int):
                        if own < ids[t]:
                            spans.setdefault(t, []).append((start, start + len(body)))
                    else:
                        for k in np.flatnonzero(own < ids[t]).tolist():
                            spans.setdefault(t, []).append((start + k, start + k + length))
                out = [[] for _ in range(6)]
                for t, own in spans.items():
                    kept, at, removed, n = [], 0, 0, 0
                    for a, b in sorted(own):
                        if a > at or not n:
                            n += 1
                            kept.append(texts[t][at:a])
                            removed += b - a
                            at = b
                        elif b > at:
                            removed += b - at
                            at = b
                    kept = b"".join(kept) + texts[t][at:]
                    row = ids[t], hashlib.sha256(texts[t]).hexdigest(), removed, n, hashlib.sha256(kept).hexdigest(), kept if keep_text else None
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["key", "sha", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


# --- the operator -----------------------------------------------------------------------------------


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    block_bytes: int = BLOCK_BYTES,
    hot_texts: int = HOT_TEXTS,
    symbols: int = SORT_SYMBOLS,
    broadcast_rows: int = BROADCAST_ROWS,
    keep_text: bool = False,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the bytes kept, on request) of every row."""
    spark = docs.sparkSession
    ship_package(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = SLICES_PER_PARTITION * parts
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    meta = materialise(rows.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "texts")
    least = meta.groupBy("sha").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count("*").alias("n"))
    copies = materialise(least.where("least < most").drop("most"), "copies")
    copied = copies.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    losers = join_heavy(meta, copies, ["sha"], copied).where("key > least").select(F.col("key").alias("loser"), F.col("sha").alias("loser_sha")).distinct()
    losers = materialise(losers, "losers")
    few = losers.count() <= broadcast_rows  # counted, so what is broadcast is bounded; beyond it the texts are shuffled
    pair = (F.col("key") == F.col("loser")) & (F.sha2("text", 256) == F.col("loser_sha"))
    chosen = rows.where(F.octet_length("text") >= length).join(F.broadcast(losers) if few else losers, pair, "left_anti")
    blocks = materialise(chosen.select("key", "text").mapInArrow(_block_partitions(block_bytes), BLOCK_SCHEMA), "blocks", compression="none")

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "slice").sortWithinPartitions("slice")

    owners = dealt(blocks.mapInArrow(_owner_blobs(slices, length, gram), SLICE_SCHEMA))
    shared = materialise(owners.mapInArrow(_shared_owners(hot_texts), SLICE_SCHEMA), "shared-owners")
    wanted = blocks.join(_gathered(shared), F.col("block") == F.col("of")).select("block", "data", "blobs")
    contexts = dealt(wanted.mapInArrow(_context_blobs(slices, length, gram), SLICE_SCHEMA))
    answers = materialise(contexts.mapInArrow(_answer_blobs(length, symbols), SLICE_SCHEMA), "answers")
    ready = blocks.join(_gathered(answers), F.col("block") == F.col("of")).drop("of")
    ready = ready.join(_gathered(shared).withColumnRenamed("blobs", "shared"), F.col("block") == F.col("of")).select("data", "shared", "blobs")
    cut = materialise(ready.mapInArrow(_cut_blocks(length, gram, keep_text), CUT_SCHEMA).dropDuplicates(["key", "sha"]), "cut")
    discard(blocks, shared, answers)
    whole = F.col("loser").isNotNull() & (F.col("n_bytes") >= length)
    nothing = hashlib.sha256(b"").hexdigest()
    named = cut.select(F.col("key").alias("cut_key"), F.col("sha").alias("cut_sha"), "n_removed", "n_spans", "kept_sha256", "kept")
    out = (
        meta.join(F.broadcast(losers) if few else losers, (F.col("key") == F.col("loser")) & (F.col("sha") == F.col("loser_sha")), "left")
        .join(named, (F.col("key") == F.col("cut_key")) & (F.col("sha") == F.col("cut_sha")), "left")
        .select(
            "doc_id",
            "n_bytes",
            F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0))).alias("n_spans"),
            F.when(whole, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
            *([F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if keep_text else []),
        )
    )
    return out
