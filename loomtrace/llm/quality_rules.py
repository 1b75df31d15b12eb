"""Quality rules by distribution divergence.

Three passes over the texts, none of which moves them. A word that has ``WORD_SHARE`` of a language's words
has that share of some stretch of them, wherever stretches are cut: the first pass names the words that do,
and gathers the histograms of character classes; the second counts the named words over all documents. Those
with the share of all the language's words are its common words (so at most 1 / WORD_SHARE). The references of
languages with at least ``LANG_SHARE`` of all words are broadcast (at most 1 / LANG_SHARE); every other
language's reference is sent to its documents by a shuffle of those documents only. The third pass compares
each document with its language's reference by the Jensen-Shannon distance (base 2, so 0..1).

Length guards: below ``MIN_WORDS`` words the base rules decide alone, and both thresholds widen with
1 / n_words, as short histograms diverge by chance. A language of fewer than ``REFERENCE_WORDS`` words has
too few to tell its common words: its documents are judged by the base rules alone.

Defined cases: a null text has no words and fails the base rules; a document of null language is held
against the nearest broadcast reference; a very long text is counted like any other;
an empty table gives no rows; repeated rows and doc_ids are judged one by one; extra columns are not
read by ``judge_documents`` and are kept by ``keep_documents``.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.tokens import byte_column, releasing, slices, word_table
from loomtrace.runtime import discard, materialise, ship_package

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WORD_SHARE = 0.002
LANG_SHARE = 0.001
REFERENCE_WORDS = 2_500
CHAR_LIMIT = (0.03, 3.5)  # a distance may reach the root of a + b / n_words
WORD_LIMIT = (0.06, 5.0)

CLASSES = ("lower", "upper", "digit", "space", "punctuation", "symbol", "other")
SYMBOLS = b"#*$%&|<>"
STRETCH_WORDS = 100_000
HELD_ROWS = 400_000
NAMED_BYTES = 8 << 20

_tables = None


def _byte_classes():
    """Byte -> class index; continuation bytes of UTF-8 go to a class past the last, which is cut off."""
    global _tables
    if _tables is None:
        import numpy as np

        table = np.full(256, 5, np.uint8)
        table[ord("a") : ord("z") + 1] = 0
        table[ord("A") : ord("Z") + 1] = 1
        table[ord("0") : ord("9") + 1] = 2
        table[[0x20, 9, 10, 11, 12, 13]] = 3
        table[list(b".,;:!?'\"()-")] = 4
        table[0x80:0xC0] = 7
        table[0xC0:] = 6
        symbol = np.zeros(256, bool)
        symbol[list(SYMBOLS)] = True
        _tables = table, symbol
    return _tables


def char_histogram(counts):
    """Class counts from the counts of bytes."""
    import numpy as np

    return np.bincount(_byte_classes()[0], weights=counts, minlength=8)[:7]


def repeat_words(words: list[bytes], window: int = 3) -> int:
    """Words inside word windows that are found twice or more."""
    import numpy as np

    grams = list(zip(*(words[k:] for k in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    seen = Counter(grams)
    hit = np.fromiter((seen[g] > 1 for g in grams), bool, len(grams))
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def base_features(text: bytes):
    """(words, byte counts, [n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words])."""
    import numpy as np

    words = text.split()
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = int(counts.sum() - counts[0x80:0xC0].sum())
    spaces = int(counts[[0x20, 9, 10, 11, 12, 13]].sum())
    return words, counts, [len(words), points - spaces, int(counts[_byte_classes()[1]].sum()), duplicate_lines(text), repeat_words(words)]


def divergence(p, q) -> float:
    """Jensen-Shannon divergence of two count vectors, base 2."""
    import numpy as np

    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0.0) + np.where(q > 0, q * np.log2(q / m), 0.0)
    return float(parts.sum() / 2)


def distance(p, q) -> float:
    """Jensen-Shannon distance: the root of the divergence, 0..1."""
    return max(0.0, divergence(p, q)) ** 0.5


HISTOGRAM_SCHEMA = "lang string, kind int, key string, n long"


def _rows(rows: list[tuple]):
    import pyarrow as pa

    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["lang", "kind", "key", "n"])


def _by_language(batch):
    """(lang, its texts, their distinct words, how often each stands there) of the rows with a language and a text."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    held = batch.filter(pc.and_(pc.is_valid(batch.column("lang")), pc.fill_null(pc.greater(pc.binary_length(batch.column("text")), 0), False)))
    codes = held.column("lang").dictionary_encode()
    place = codes.indices.to_numpy(zero_copy_only=False)
    for code, lang in enumerate(codes.dictionary.to_pylist()):
        texts = held.column("text").take(pa.array(np.flatnonzero(place == code)))
        words, distinct, _ = word_table(texts)
        yield lang, texts, distinct, np.bincount(words, minlength=len(distinct)).astype(np.int64)


def _name_words(word_share: float):
    """(lang, kind, key, n): kind 0 a character class, 1 a word with the share of a stretch (n is 0), 2 the number of words."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        held: dict[str, list] = {}
        size: dict[str, int] = {}
        chars: dict[str, object] = {}
        named: dict[str, set] = {}

        def close(lang):
            words = pa.concat_tables(held.pop(lang)).group_by("key").aggregate([("n", "sum")])
            often = pc.greater_equal(words.column("n_sum"), word_share * size.pop(lang) * (1 - 1e-9))
            named.setdefault(lang, set()).update(words.filter(often).column("key").to_pylist())

        def found():
            for lang in list(held):
                close(lang)
            rows = [(lang, 0, CLASSES[k], int(n)) for lang, h in chars.items() for k, n in enumerate(h[:-1]) if n]
            rows += [(lang, 2, "", int(h[-1])) for lang, h in chars.items()]
            rows += [(lang, 1, w, 0) for lang, words in named.items() for w in words]
            chars.clear()
            named.clear()
            return _rows(rows)

        for whole in batches:
            for batch in slices(whole, "text"):
                for lang, texts, distinct, counts in _by_language(batch):
                    h = chars.setdefault(lang, np.zeros(len(CLASSES) + 1, np.int64))
                    h[:-1] += char_histogram(np.bincount(np.concatenate([np.frombuffer(t, np.uint8) for t in byte_column(texts)]), minlength=256)).astype(np.int64)
                    h[-1] += counts.sum()
                    if len(distinct):
                        held.setdefault(lang, []).append(pa.table({"key": distinct.cast(pa.large_string()), "n": counts}))
                        size[lang] = size.get(lang, 0) + int(counts.sum())
                        if size[lang] >= STRETCH_WORDS:
                            close(lang)
                if sum(len(x) for own in held.values() for x in own) + sum(map(len, named.values())) > HELD_ROWS or len(chars) > 10_000:
                    yield found()
        yield found()

    return run


def _count_words(named: dict[str, list[str]] | None):
    """(lang, 1, word, n) of the named words, or of every word."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        wanted = {} if named is None else {lang: pa.array(words, pa.string()) for lang, words in named.items()}
        sums: dict[tuple[str, str], int] = {}
        for whole in batches:
            for batch in slices(whole, "text"):
                for lang, _, distinct, counts in _by_language(batch):
                    if named is not None:
                        if lang not in wanted:
                            continue
                        at = pc.is_in(distinct, value_set=wanted[lang].cast(distinct.type))
                        distinct, counts = distinct.filter(at), counts[at.to_numpy(zero_copy_only=False)]
                    for w, n in zip(distinct.to_pylist(), counts.tolist(), strict=True):
                        sums[lang, w] = sums.get((lang, w), 0) + n
                if len(sums) > HELD_ROWS:
                    yield _rows([(lang, 1, w, n) for (lang, w), n in sums.items()])
                    sums.clear()
        yield _rows([(lang, 1, w, n) for (lang, w), n in sums.items()])

    return run


def _reference(rows):
    """(class counts, {common word: index}, word counts with the rest last) from (kind, key, n)."""
    import numpy as np

    h, index, counts = np.zeros(len(CLASSES)), {}, []
    for kind, key, n in sorted(rows):
        if kind == 0:
            h[CLASSES.index(key)] = n
        elif kind == 1:
            index[key.encode()] = len(counts)
            counts.append(float(n))
        else:
            counts.append(float(n - sum(counts)))
    return h, index, np.array(counts)


def _histograms(rows: DataFrame, word_share: float, named_bytes: int) -> DataFrame:
    """(lang, kind, key, n) over all rows: kind 0 a character class, 1 a word that may be common, 2 the number of words."""
    first = materialise(rows.mapInArrow(releasing(_name_words(word_share)), HISTOGRAM_SCHEMA), "named-words")
    words = materialise(first.where("kind = 1").select("lang", "key").distinct(), "distinct-named-words")
    size = words.agg(F.sum(F.octet_length("key") + F.octet_length("lang") + 16)).first()[0] or 0
    named: dict[str, list[str]] | None = None  # counted to be few, they go to every task; beyond, all words are counted by a shuffle
    if size <= named_bytes:
        named = {}
        for r in words.collect():
            named.setdefault(r.lang, []).append(r.key)
    counted = rows.mapInArrow(releasing(_count_words(named)), HISTOGRAM_SCHEMA)
    whole = first.where("kind <> 1").unionByName(counted).groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    return materialise(whole, "histograms")


def _gathered(docs: DataFrame, word_share: float, lang_share: float, others: bool, named_bytes: int = NAMED_BYTES) -> tuple[dict, DataFrame | None]:
    """References of the languages with ``lang_share`` of all words, and (lang, reference) of the others, if any."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sums = _histograms(rows, word_share, named_bytes)
    totals = sums.where("kind = 2").select("lang", F.col("n").alias("total"))
    least = max(1.0, lang_share * (totals.agg(F.sum("total")).first()[0] or 0))
    large = totals.where(F.col("total") >= least)  # at most 1 / lang_share rows
    common = (F.col("kind") != 1) | (F.col("n") >= word_share * F.col("total"))
    kept = sums.join(F.broadcast(large), "lang").where(common).collect()
    rest = totals.where((F.col("total") < least) & (F.col("total") >= REFERENCE_WORDS))
    small = None
    if others and not rest.isEmpty():
        small = sums.join(rest, "lang").where(common).groupBy("lang").agg(F.to_json(F.collect_list(F.struct("kind", "key", "n"))).alias("reference"))
        small = materialise(small, "references")
    discard(sums)
    found: dict = {}
    for r in kept:
        found.setdefault(r.lang, []).append((r.kind, r.key, r.n))
    return {lang: _reference(x) for lang, x in sorted(found.items())}, small


def language_references(docs: DataFrame, word_share: float = WORD_SHARE, lang_share: float = LANG_SHARE) -> dict:
    """lang -> (class counts, {common word: index}, word counts with the rest last), over all documents."""
    return _gathered(docs, word_share, lang_share, False)[0]


def _verdict(words: list[bytes], counts, lang: str | None, references: dict) -> tuple[float, float]:
    """The character and word distance from the language's reference; for a null language from the nearest."""
    import numpy as np

    best = None
    for h, index, shares in references.values() if lang is None else [references[lang]] if lang in references else []:
        if shares.sum() < REFERENCE_WORDS:
            continue
        rest = len(index)
        own = np.bincount([index.get(w, rest) for w in words], minlength=rest + 1).astype(float)
        pair = distance(char_histogram(counts), h), distance(own, shares)
        best = pair if best is None or sum(pair) < sum(best) else best
    return best or (0.0, 0.0)


def judge_text(text: bytes | None, lang: str | None, references: dict) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance)."""
    words, counts, base = base_features(text or b"")
    n = base[0]
    failed = n < MIN_WORDS or 100 * base[4] > MAX_REPEAT_PERCENT * n
    char, word = _verdict(words, counts, lang, references) if n >= MIN_WORDS else (0.0, 0.0)
    fits = n < MIN_WORDS or (char**2 <= CHAR_LIMIT[0] + CHAR_LIMIT[1] / n and word**2 <= WORD_LIMIT[0] + WORD_LIMIT[1] / n)
    return (*base, failed, not failed and fits, char, word)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")
JUDGED_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def _judged(batch, references: dict) -> list[tuple]:
    return [judge_text(t, g, references) for g, t in zip(batch.column("lang").to_pylist(), byte_column(batch.column("text")), strict=True)]


def _judged_rows(docs: DataFrame, lang_share: float, emit, schema) -> DataFrame:
    """``emit(batch, verdicts)`` over all rows, each judged by its own language's reference."""
    references, small = _gathered(docs, WORD_SHARE, lang_share, True)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                yield emit(batch, _judged(batch, references))

    if small is None:
        return docs.mapInArrow(releasing(run), schema)

    def run_small(batches):
        import pyarrow as pa

        own: dict = {}
        for batch in batches:
            langs, held = batch.column("lang").to_pylist(), batch.column("reference").to_pylist()
            rows = pa.RecordBatch.from_struct_array(batch.column("row"))
            texts = byte_column(rows.column("text"))
            places, verdicts = [], []
            for k, (lang, reference) in enumerate(zip(langs, held, strict=True)):
                if reference is not None:  # it comes before its language's documents
                    own = {lang: _reference([(x["kind"], x["key"], x["n"]) for x in json.loads(reference)])}
                else:
                    places.append(k)
                    verdicts.append(judge_text(texts[k], lang, own))
            if places:
                yield emit(rows.take(pa.array(places)), verdicts)

    here = F.col("lang").isNull() | F.col("lang").cast("string").isin(list(references))
    far = docs.where(~here).select(F.col("lang").cast("string").alias("lang"), F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.lit(None).cast("string").alias("reference"))
    refs = small.select("lang", F.lit(None).cast(far.schema["row"].dataType).alias("row"), "reference")
    dealt = far.unionByName(refs).repartition("lang").sortWithinPartitions("lang", F.col("reference").isNull())
    return docs.where(here).mapInArrow(releasing(run), schema).unionByName(dealt.mapInArrow(run_small, schema))


def judge_documents(docs: DataFrame, lang_share: float = LANG_SHARE) -> DataFrame:
    """The base figures, the distances and the verdict of every document."""

    def emit(batch, verdicts):
        import pyarrow as pa

        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
        arrays = [pa.array([r[k] for r in verdicts], t) for k, t in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *COLUMNS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return _judged_rows(rows, lang_share, emit, JUDGED_SCHEMA)


def keep_documents(docs: DataFrame, lang_share: float = LANG_SHARE) -> DataFrame:
    """The rows that pass, with all their columns."""

    def emit(batch, verdicts):
        import pyarrow as pa

        return batch.filter(pa.array([r[6] for r in verdicts], pa.bool_()))

    return _judged_rows(docs, lang_share, emit, docs.schema)
