"""Benchmark decontamination over canonical templates.

Numbers, units and names become typed placeholders (runs of name words become one), other words are
lower-cased and stripped of punctuation. A name is a word with a capital that does not open a sentence, unless
most words of the sentence have one: headings and texts in capitals hold words. Windows of ``WINDOW`` template
tokens of the benchmark are hash-joined with those of every document; a hit counts within the maximal stretches
of its alignment whose slots are consistent, that is, one benchmark value always stands for one document value.
A contradictory slot parts two stretches and takes nothing from either.

Windows of ``WINDOW`` words, without regard to case and outer punctuation, are joined too. They find verbatim
copies where template tokens say little (a window with fewer than ``LITERALS`` tokens that are no placeholders
is no template window) and where case makes other names on the two sides. A pair is reported when both kinds of
hits together cover ``SPAN`` tokens of the item, or all of a shorter one.

The benchmark side of the hash join is broadcast in blocks of at most ``BLOCK_CHARS`` characters: one
block for common benchmarks, and one more pass over the documents for each further block.

Items of up to ``SPAN`` tokens are also searched whole, word by word: what stands before a copy decides whether
its first word reads as a name, and may join it to one.

Defined cases: null texts have no windows; a very long text is one row of its task and is searched whole; items
under ``LEAST`` tokens have no template and are found verbatim only, and those under ``LEAST_WORDS`` words are too
short to tell and match nothing; an empty benchmark or table gives no rows, and drops none; rows with a null
doc_id can match; repeated rows match one by one; extra columns are not read by ``find_leaks`` and are kept by
``drop_contaminated``.
"""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.tokens import CACHE_CHUNK_BYTES, byte_column, releasing, slices, task_cache, trim
from loomtrace.runtime import ship_package

WINDOW = 8
SPAN = 10
LEAST = 5
LITERALS = 5
LEAST_WORDS = 3
CAPITALS = 4  # words with a capital that a sentence in capitals has at least
BLOCK_CHARS = 8_000_000

#: Words that stand for a unit of measure or money.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg lb lbs oz ounce ounces gram grams kilogram kilograms "
    "ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days "
    "week weeks month months year years mph kph kmh dollar dollars cent cents euro euros pound pounds usd eur percent degree "
    "degrees celsius fahrenheit meter meters metre metres kilometer kilometers centimeter centimeters".split()
)

LITERAL, NUMBER, UNIT, QUANTITY, NAME = range(5)
_NUMBER = re.compile(r"[$€£+-]?[0-9][0-9.,:/]*(?:st|nd|rd|th|%)?")
_QUANTITY = re.compile(r"[$€£+-]?[0-9][0-9.,]*([a-zA-Z]+)")
_STRIP = " \t.,;:!?\"'()[]{}<>*#&%|~`“”‘’«»…-"
_FLAGS = 0x1F  # low bits of a cached value: 1 capital, 2 ends a sentence, 4 * kind
_cache: dict[bytes, int] = task_cache()


def _digest(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) & ~_FLAGS


def _chunk(chunk: bytes) -> int:
    """Hash and flags of one white-space delimited chunk."""
    text = chunk.decode("utf-8", "replace")
    core = text.strip(_STRIP) or text
    tail = text.rstrip("\"')]}*#&%|”’» ")
    flags = 2 if tail[-1:] in (".", "!", "?", ":") else 0
    if core[0].isdigit() or (len(core) > 1 and core[0] in "$€£+-" and core[1].isdigit()):
        if _NUMBER.fullmatch(core):
            return _digest(core.lower()) | flags | 4 * NUMBER
        if (m := _QUANTITY.fullmatch(core)) and m[1].lower() in UNITS:
            return _digest(core.lower()) | flags | 4 * QUANTITY
    lower = core.lower()
    if lower in UNITS:
        return _digest(lower) | flags | 4 * UNIT
    return _digest(lower) | flags | (1 if core[0].isupper() else 0)


def templates(texts: list[bytes | None]):
    """Template tokens of all texts: (hash, kind, owner, first word, last word + 1); then the words, their hashes and owners."""
    import numpy as np

    own = [t.split() if t else [] for t in texts]
    trim(_cache)
    fresh = set().union(*own).difference(_cache)
    for c in fresh:
        _cache[c] = _chunk(c)
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    n = int(sizes.sum())
    packed = np.fromiter((v for w in own for v in map(_cache.__getitem__, w)), np.uint64, n)
    for c in fresh:
        if len(c) > CACHE_CHUNK_BYTES:
            del _cache[c]
    flags = (packed & np.uint64(_FLAGS)).astype(np.uint8)
    owner = np.repeat(np.arange(len(own)), sizes)
    opens = np.ones(n, bool)
    opens[1:] = ((flags[:-1] & 2) > 0) | (owner[1:] != owner[:-1])
    kind = flags >> 2
    capital, sentence = (flags & 1) > 0, np.cumsum(opens) - 1
    many = np.bincount(sentence, capital, minlength=1)
    shouted = (many >= CAPITALS) & (2 * many > np.bincount(sentence, (kind == LITERAL), minlength=1))
    kind[capital & ~opens & (kind == LITERAL) & ~shouted[sentence]] = NAME
    joined = np.zeros(n, bool)
    joined[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME) & ~opens[1:]
    heads = np.flatnonzero(~joined)
    digests = packed & ~np.uint64(_FLAGS)
    kind = kind[heads]
    marks = np.array([0, *map(_digest, ("<number>", "<unit>", "<quantity>", "<name>"))], np.uint64)
    hashes = np.where(kind == LITERAL, digests[heads], marks[kind])
    ends = np.append(heads[1:], n)
    return hashes, kind, owner[heads], heads, ends, [w for x in own for w in x], digests, owner


def _mixed(hashes, at, size: int):
    """Hashes of the windows that start at ``at``, a slice's length or positions."""
    import numpy as np

    out = np.zeros(at if isinstance(at, int) else len(at), np.uint64)
    for k in range(size):
        out = out * np.uint64(0x100000001B3) + (hashes[k : k + at] if isinstance(at, int) else hashes[at + k])
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out


def window_hashes(hashes, kind, owner, size: int, literals: int):
    """(starts, hashes) of the windows within one text with enough literals."""
    import numpy as np

    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    plain = np.concatenate([[0], np.cumsum(kind == LITERAL)])
    valid = np.flatnonzero((owner[:n] == owner[size - 1 :]) & (plain[size : size + n] - plain[:n] >= literals))
    return valid, _mixed(hashes, n, size)[valid]


class _Places:
    """Places of the benchmark by window hash."""

    def __init__(self, table: dict[int, list]):
        import numpy as np

        self.keys = np.array(sorted(table), np.uint64)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.places = [table[k] for k in self.keys.tolist()]

    def find(self, starts, found):
        """(start, places) of the windows that are held."""
        import numpy as np

        if not self.places:
            return
        near = np.flatnonzero(self.bits[(found & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.searchsorted(self.keys, found[near])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == found[near]
        for t, k in zip(starts[near[hit]].tolist(), at[hit].tolist(), strict=True):
            yield t, self.places[k]


def _core(words: list[bytes]) -> str:
    return " ".join(w.decode("utf-8", "replace").strip(_STRIP).lower() for w in words)


def _stretches(anchors: list[tuple[int, int]], breaks: list[int]) -> list[tuple[int, int]]:
    """The stretches between breaks that hold an anchor."""
    from bisect import bisect_right

    found = {k: None for k in (bisect_right(breaks, a) for a, _ in anchors)}
    return [(breaks[k - 1] + 1, breaks[k]) for k in found]


def _consistent(parts: list[tuple[int, int]], anchors: list[tuple[int, int]], filled: dict[int, tuple]) -> tuple[set[int], int]:
    """Places in maximal consistent stretches that hold an anchor, and the number of anchors in them."""
    own: set[int] = set()
    held: set[tuple[int, int]] = set()

    def close(a, b):
        if found := [x for x in anchors if a <= x[0] and x[1] <= b]:
            own.update(range(a, b))
            held.update(found)

    for start, stop in parts:
        last: dict[tuple, tuple[str, int]] = {}
        for p in sorted(x for x in filled if start <= x < stop):
            key, new = filled[p]
            value, at = last.get(key, (new, -1))
            if value != new and at >= start:
                close(start, p)
                start = at + 1
            last[key] = (new, p)
        close(start, stop)
    return own, len(held)


class BenchmarkIndex:
    """Template windows of a block of benchmark items, by window size."""

    def __init__(self, items: list[tuple], window: int = WINDOW, span: int = SPAN):
        import numpy as np

        self.ids = [i for i, _ in items]
        hashes, kind, owner, heads, ends, words, digests, word_owner = templates([None if t is None else t.encode() for _, t in items])
        self.sizes = np.bincount(owner, minlength=len(items)) if len(items) else np.zeros(0, np.int64)
        starts = np.cumsum(self.sizes) - self.sizes
        self.needed = np.minimum(span, self.sizes)
        self.values = [
            [None if kind[t] == LITERAL else _core(words[heads[t] : ends[t]]) for t in range(s, s + n)]
            for s, n in zip(starts.tolist(), self.sizes.tolist(), strict=True)
        ]
        self.hashes = np.split(hashes, starts[1:])
        bounds = np.searchsorted(word_owner, np.arange(len(items) + 1)).tolist()
        tokens = np.searchsorted(heads, np.arange(len(words)), "right") - 1  # of every word
        self.tokens = [tokens[a:b] - s for a, b, s in zip(bounds[:-1], bounds[1:], starts.tolist(), strict=True)]
        open_: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        spoken: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        short: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        self.digests: dict[int, object] = {}
        for item, (s, n) in enumerate(zip(starts.tolist(), self.sizes.tolist(), strict=True)):
            own = digests[bounds[item] : bounds[item + 1]]
            if n >= LEAST:
                size = min(window, n)
                part = slice(s, s + n)
                for place, key in zip(*(x.tolist() for x in window_hashes(hashes[part], kind[part], owner[part], size, min(LITERALS, size - 1))), strict=True):
                    open_[size][key].append((item, place))
                for place, key in enumerate(_mixed(own, len(own) - size + 1, size).tolist()):
                    spoken[size][key].append((item, place))
            if n <= span and len(own) >= LEAST_WORDS:
                self.digests[item] = own
                size = min(window, len(own))
                short[size][int(_mixed(own, 1, size)[0])].append(item)
        self.open = [(size, _Places(t)) for size, t in sorted(open_.items())]
        self.spoken = [(size, _Places(t)) for size, t in sorted(spoken.items())]
        self.short = [(size, _Places(t)) for size, t in sorted(short.items())]

    def hits(self, texts: list[bytes | None]) -> list[tuple]:
        """(text index, item index, n_windows, covered tokens, slots) of every reported pair."""
        import numpy as np

        hashes, kind, owner, heads, ends, words, digests, word_owner = templates(texts)
        runs: dict[tuple[int, int, int], list[tuple[int, int]]] = defaultdict(list)
        for size, table in self.open:
            for t, places in table.find(*window_hashes(hashes, kind, owner, size, min(LITERALS, size - 1))):
                for item, place in places:
                    runs[(int(owner[t]), item, t - place)].append((place, place + size))
        covered: dict[tuple[int, int], set[int]] = defaultdict(set)
        windows: dict[tuple[int, int], int] = defaultdict(int)
        slots: dict[tuple[int, int], set[int]] = defaultdict(set)
        first = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist() if runs else []
        for (doc, item, shift), anchors in runs.items():
            values = self.values[item]
            low, high = max(0, first[doc] - shift), min(len(values), first[doc + 1] - shift)
            unlike = np.flatnonzero(hashes[shift + low : shift + high] != self.hashes[item][low:high]) + low
            parts = _stretches(sorted(set(anchors)), [low - 1, *unlike.tolist(), high])
            filled = {p: ((int(kind[shift + p]), values[p]), _core(words[heads[shift + p] : ends[shift + p]])) for a, b in parts for p in range(a, b) if values[p] is not None}
            own, held = _consistent(parts, sorted(set(anchors)), filled)
            covered[(doc, item)] |= own
            windows[(doc, item)] += held
            slots[(doc, item)] |= own & filled.keys()
        mixed: dict[int, object] = {}

        def at_words(table, size):
            n = max(0, len(digests) - size + 1)
            if size not in mixed:
                mixed[size] = _mixed(digests, n, size)
            return table.find(np.arange(n), mixed[size])

        alike: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
        for size, table in self.spoken:
            for t, places in at_words(table, size):
                if word_owner[t] == word_owner[t + size - 1]:
                    for item, place in places:
                        alike[(int(word_owner[t]), item)].add((place, place + size))
        for (doc, item), parts in alike.items():
            own = {int(p) for a, b in parts for p in self.tokens[item][a:b]}
            windows[(doc, item)] = max(windows[(doc, item)], len(parts))
            covered[(doc, item)] |= own
            slots[(doc, item)] |= {p for p in own if self.values[item][p] is not None}
        for size, table in self.short:
            for t, items in at_words(table, size):
                for item in items:
                    own, doc = self.digests[item], int(word_owner[t])
                    if np.array_equal(digests[t : t + len(own)], own) and word_owner[t + len(own) - 1] == doc:
                        windows[(doc, item)] = max(1, windows[(doc, item)])
                        covered[(doc, item)] = set(range(int(self.sizes[item])))
                        slots[(doc, item)] = {p for p, v in enumerate(self.values[item]) if v is not None}
        return [
            (doc, item, windows[doc, item], len(own), len(slots[doc, item]))
            for (doc, item), own in sorted(covered.items())
            if len(own) >= self.needed[item]
        ]


LEAK_SCHEMA = "doc_id long, item_id long, n_windows long, covered long, item_tokens long, n_slots long"


def _indexes(benchmark: DataFrame, block_chars: int):
    """Broadcast indexes over blocks of the benchmark, each of a bounded number of characters."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // (block_chars // 2)) if total > block_chars else 1)
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield spark.sparkContext.broadcast(BenchmarkIndex([(r.item_id, r.text) for r in part.collect()]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, ...) for every document that holds a passage of an item, verbatim or re-parameterised."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def scan(index):
        def run(batches):
            import pyarrow as pa

            held = index.value
            for whole in batches:
                for batch in slices(whole, "text"):
                    found = held.hits(byte_column(batch.column("text")))
                    ids = batch.column("doc_id").to_pylist()
                    cols = [
                        [ids[d] for d, *_ in found],
                        [held.ids[i] for _, i, *_ in found],
                        *([x[k] for x in found] for k in (2, 3)),
                        [int(held.sizes[x[1]]) for x in found],
                        [x[4] for x in found],
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "n_windows", "covered", "item_tokens", "n_slots"])

        return run

    out = None
    for index in _indexes(benchmark, block_chars):
        part = rows.mapInArrow(releasing(scan(index)), LEAK_SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows without a reported passage, with all their columns."""
    ship_package(docs.sparkSession)

    def scan(index):
        def run(batches):
            import numpy as np
            import pyarrow as pa

            held = index.value
            for whole in batches:
                for batch in slices(whole, "text"):
                    clean = np.ones(batch.num_rows, bool)
                    clean[[d for d, *_ in held.hits(byte_column(batch.column("text")))]] = False
                    yield batch.filter(pa.array(clean))

        return run

    for index in _indexes(benchmark, block_chars):
        docs = docs.mapInArrow(releasing(scan(index)), docs.schema)
    return docs
