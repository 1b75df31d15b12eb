"""Language-model scoring by cross-entropy difference.

Two interpolated bigram models, a target model over the documents labelled good and a background
model over all documents, share one vocabulary: every word of the corpus. Words and word pairs are
counted exactly under 63-bit keys, so the models grow with the corpus and nothing of them is held
whole anywhere. The background is matched to the target: its counts are scaled to the target's number
of words before smoothing.

Score of a document: the mean over its words of the target's loss less the background's, in nats;
lower is nearer to the target. A document is scored without its own share in the counts (always in
the background's, and in the target's where it is labelled good), so no text is judged by itself.

Three passes; texts move only as the word indices of the third:

1. Each task turns its documents into chunks of about ``CHUNK_BYTES`` of text, one row a chunk, with the
   words as indices into the chunk's own vocabulary. The chunks are stored in the shared folder.
2. Each chunk asks for its distinct words and pairs, once each however frequent, cut by key range into
   ``2 ** bits`` buckets. The owner of a bucket adds the counts and answers each request in its own order,
   with the counts of the other chunks alone, so the answers carry no keys and are mostly zero.
3. A chunk meets its answers, adds its own counts, takes off each document's, and scores.

Buckets grow with the number of words and have ``BUCKET_KEYS`` requested keys at most on average; a
frequent word weighs no more there than a rare one.

Defined cases: a null or wordless text has n_tokens 0 and null losses; without labelled documents the
target is the background and every score 0; a null doc_id is scored and never labelled; of repeated
labels any good one counts; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.tokens import slices, split_bytes, word_table
from loomtrace.runtime import materialise, ship_package

SEED = 7
CHUNK_BYTES = 4_000_000
LEAST_BITS = 8
BUCKET_KEYS = 4_000_000
BROADCAST_ROWS = 2_000_000
PAIR_WEIGHT = 0.7
ADDED = 0.5

CHUNK_SCHEMA = "chunk long, n_words long, n_good long, ids array<long>, good array<boolean>, sizes array<long>, vocabulary binary, words binary"
BUCKET_SCHEMA = "bucket long, chunk long, keys binary, counts binary, n_distinct long"


def squeeze(array) -> bytes:
    """Unsigned integers as compressed byte planes."""
    import numpy as np
    import zstandard

    planes = np.ascontiguousarray(array, "<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(raw: bytes):
    import numpy as np
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def index_words(column):
    """(hashes of the distinct words, commonest first; index of every word; number of words of each text)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    # A copy with offsets from zero: the kernel that folds case goes wrong on slices.
    whole = pc.fill_null(column.cast(pa.large_string()), "").take(pa.array(range(len(column)), pa.int64()))
    index, distinct, ends = word_table(pc.ascii_lower(whole))
    words = split_bytes(distinct.cast(pa.large_string()))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    order = np.argsort(-np.bincount(index, minlength=len(words)), kind="stable")
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    return hashes[order], place[index], np.diff(ends, prepend=0)


def _chunks(batches):
    """Rows of CHUNK_SCHEMA, one for each chunk of this task's documents."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    n = TaskContext.get().partitionId() << 32
    for whole in batches:
        for batch in slices(whole, "text", CHUNK_BYTES):
            hashes, words, sizes = index_words(batch.column("text"))
            good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
            row = [n, int(sizes.sum()), int(sizes[good].sum()), batch.column("doc_id").to_pylist(), good.tolist(), sizes.tolist(), squeeze(hashes), squeeze(words.astype(np.uint64))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(row, [pa.int64()] * 3 + [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary()], strict=True)],
                names=["chunk", "n_words", "n_good", "ids", "good", "sizes", "vocabulary", "words"],
            )
            n += 1


def key_words(hashes, words, sizes):
    """(sorted keys of a chunk, key of every word, key of every pair, whether a word opens its text).

    Words have odd keys and pairs even ones. The pair of a text's first word is no pair and has key 0."""
    import numpy as np

    first = np.zeros(len(words), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    later = np.flatnonzero(~first)
    seen, which = np.unique((words[later - 1] << 32) | words[later], return_inverse=True)
    mixed = hashes[seen >> 32] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[seen & 0xFFFFFFFF] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    keys, place = np.unique(np.concatenate([hashes | np.uint64(1), mixed & ~np.uint64(1)]), return_inverse=True)
    pair = np.zeros(len(words), np.int64)
    pair[later] = place[len(hashes) :][which]
    return keys, place[: len(hashes)][words], pair, first


def count_keys(n: int, word, pair, first, chosen):
    """int64 (2, n): how often each key occurs in the chunk, and in its good documents."""
    import numpy as np

    return np.array([np.bincount(np.concatenate([word[m], pair[m & ~first]]), minlength=n) for m in (np.ones(len(word), bool), chosen)])


def cuts(keys, bits: int):
    """Where each bucket's keys begin, and the end."""
    import numpy as np

    return np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(keys))


def _unpack(row: dict):
    import numpy as np

    sizes, good = np.array(row["sizes"], np.int64), np.array(row["good"], bool)
    keys, word, pair, first = key_words(unsqueeze(row["vocabulary"]), unsqueeze(row["words"]).astype(np.int64), sizes)
    return sizes, good, keys, word, pair, first, count_keys(len(keys), word, pair, first, np.repeat(good, sizes))


def _rows(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _bucket_batch(rows: list[tuple]):
    import pyarrow as pa

    columns = list(zip(*rows, strict=True))
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["bucket", "chunk", "keys", "counts", "n_distinct"])


def _ask(bits: int):
    """Each chunk's distinct keys and counts, by bucket."""

    def run(batches):
        import numpy as np

        for row in _rows(batches):
            *_, keys, _word, _pair, _first, counts = _unpack(row)
            at = cuts(keys, bits).tolist()
            rows = [
                (b, row["chunk"], squeeze(np.diff(keys[s:e], prepend=np.uint64(0))), squeeze(counts[:, s:e].reshape(-1)), 0)
                for b, (s, e) in enumerate(zip(at[:-1], at[1:], strict=True))
                if e > s
            ]
            if rows:
                yield _bucket_batch(rows)

    return run


def _answer(batches):
    """To each request of a bucket the counts of all others; the bucket's first answer tells its distinct words.

    The partition is sorted by bucket."""
    import numpy as np

    def added(bucket, chunks, keys, counts):
        sizes = [len(k) for k in keys]
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros((2, len(distinct)), np.int64)
        ends = np.cumsum(sizes).tolist()
        places = [which[e - n : e] for e, n in zip(ends, sizes, strict=True)]
        for at, own in zip(places, counts, strict=True):
            total[:, at] += own  # a request holds a key once
        n = int((distinct & np.uint64(1)).sum())
        for k, (chunk, at, own) in enumerate(zip(chunks, places, counts, strict=True)):
            yield (bucket, chunk, None, squeeze((total[:, at] - own).reshape(-1)), 0 if k else n)

    held: list = [None, [], [], []]
    for batch in batches:
        out = []
        for bucket, chunk, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "keys", "counts")), strict=True):
            if bucket != held[0]:
                if held[1]:
                    out.extend(added(*held))
                held = [bucket, [], [], []]
            held[1].append(chunk)
            held[2].append(np.cumsum(unsqueeze(keys), dtype=np.uint64))
            held[3].append(unsqueeze(counts).astype(np.int64).reshape(2, -1))
        if out:
            yield _bucket_batch(out)
    if held[1]:
        yield _bucket_batch(list(added(*held)))


def own_counts(slot, owner, size: int):
    """How often each word's key occurs in its own text."""
    import numpy as np

    _, back, n = np.unique(owner * size + slot, return_inverse=True, return_counts=True)
    return n[back]


def token_losses(counts, totals, scales, distinct: int, word, pair, first, sizes, share):
    """float64 (2, words): -log p of each word under the background and the target, without the text itself.

    ``share`` (2, texts) is 1 where a model has counted the text and 0 elsewhere."""
    import numpy as np

    owner = np.repeat(np.arange(len(sizes)), sizes)
    context = np.roll(word, 1)
    own_word, own_pair = own_counts(word, owner, counts.shape[1]), own_counts(np.where(first, counts.shape[1], pair), owner, counts.shape[1] + 1)
    own_context = np.roll(own_word, 1)
    out = []
    for table, total, scale, counted in zip(counts, totals, scales, share, strict=True):
        # The text's own share comes off whole counts, so that nothing is left where there is nothing else.
        own = counted[owner]
        left = scale * (total - own * sizes[owner])
        single = (scale * (table[word] - own * own_word) + ADDED) / (left + ADDED * distinct)
        base = np.where(first, 0.0, table[context] - own * own_context)
        seen = base > 0
        joint = np.where(seen, (table[pair] - own * own_pair) / np.where(seen, base, 1.0), 0.0)
        weight = np.where(seen, PAIR_WEIGHT, 0.0)
        out.append(-np.log(weight * joint + (1 - weight) * single))
    return np.array(out).reshape(2, -1)


def _score(bits: int, totals: tuple[int, int], distinct: int):
    """Scores of every chunk of a partition in which the chunk's row is followed by its answers."""
    labelled = totals[1] > 0
    scales = (totals[1] / totals[0], 1.0) if labelled and totals[0] else (1.0, 1.0)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def scored(row, others, missing):
            sizes, good, keys, word, pair, first, counts = row
            if missing:
                raise ValueError(f"{missing} buckets of a chunk have no answer")
            counts = counts + others
            if not labelled:
                counts[1] = counts[0]
            share = np.array([np.ones(len(sizes)), good.astype(float) if labelled else np.ones(len(sizes))])
            losses = token_losses(counts, totals if labelled else totals[:1] * 2, scales, distinct, word, pair, first, sizes, share)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            empty = sizes == 0
            return sizes, empty, [np.bincount(owner, weights=x, minlength=len(sizes)) / np.where(empty, 1, sizes) for x in losses]

        def batch_of(ids, result):
            sizes, empty, (background, target) = result
            losses = [pa.array(x, pa.float64(), mask=empty) for x in (target, background, target - background)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), *losses], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

        row = ids = at = others = None
        missing = 0
        for r in _rows(batches):
            if r["bucket"] < 0:
                if row is not None:
                    yield batch_of(ids, scored(row, others, missing))
                row, ids = _unpack(r), r["ids"]
                at = cuts(row[2], bits)
                others, missing = np.zeros((2, len(row[2])), np.int64), int((np.diff(at) > 0).sum())
            else:
                s, e = at[r["bucket"]], at[r["bucket"] + 1]
                others[:, s:e] = unsqueeze(r["counts"]).astype(np.int64).reshape(2, -1)
                missing -= 1
        if row is not None:
            yield batch_of(ids, scored(row, others, missing))

    return run


def tag_good(docs: DataFrame, labels: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, text, good: whether any label of the document says quality 1.

    The ids of good documents are broadcast while they are at most ``broadcast_rows`` (counted first);
    beyond that the texts are shuffled to them."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    small = good.count() <= broadcast_rows
    good = good.withColumn("good", F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(F.broadcast(good) if small else good, "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(False)))


def score_documents(docs: DataFrame, labels: DataFrame, bucket_keys: int = BUCKET_KEYS, least_bits: int = LEAST_BITS) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score (target minus background loss per token)."""
    ship_package(docs.sparkSession)
    chunks = materialise(tag_good(docs, labels).mapInArrow(_chunks, CHUNK_SCHEMA), "lm-chunks", compression="none", **{"parquet.block.size.row.check.min": "1"})
    sums = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_good"), F.lit(0))).first()
    # At most two keys a word: itself and its pair.
    bits = max(least_bits, (2 * sums[0] // bucket_keys).bit_length())
    asked = chunks.select("chunk", "good", "sizes", "vocabulary", "words").mapInArrow(_ask(bits), BUCKET_SCHEMA)
    answers = materialise(asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answer, BUCKET_SCHEMA), "lm-answers", compression="none")
    distinct = answers.agg(F.coalesce(F.sum("n_distinct"), F.lit(0))).first()[0]
    columns = ["chunk", "bucket", "ids", "good", "sizes", "vocabulary", "words", "counts"]
    met = chunks.withColumn("bucket", F.lit(-1).cast("long")).unionByName(answers.select("chunk", "bucket", "counts"), allowMissingColumns=True).select(*columns)
    ordered = met.repartition("chunk").sortWithinPartitions("chunk", "bucket")
    return ordered.mapInArrow(_score(bits, (sums[0], sums[1]), distinct), "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
