"""SimHash near-duplicate groups, exact within the radius.

Fingerprints are 64 majority bits over the XXH64 of 4-word shingles. Equal fingerprints are folded
first; the distinct ones are spread over one table per structured bit mask. With b blocks of bits and
radius r, each table keeps b - r whole blocks as its key: r differing bits touch at most r blocks, so
some table's key agrees for every pair within the radius. The number of blocks follows the number of
fingerprints, which changes the work and never the result. A bucket that is larger than a task should
hold is cut into blocks and each pair of blocks becomes a bucket of its own, so nothing is dropped;
a bucket gives a spanning forest of its links instead of all pairs. Groups are then the connected
components of the links.

Defined cases: a text without words, or null, has fingerprint zero and links like any other; fewer
than four words are one shingle; rows with a null doc_id get a fingerprint and take their group from
others, and a group of such rows alone has a null component; repeated doc_ids are rows like any
others; a very long text is hashed shingle by shingle like any other; an empty table gives no rows; extra
columns are not read by ``simhash_groups`` and are kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.tokens import byte_column, releasing, slices
from loomtrace.operators.graph import connected_components
from loomtrace.operators.skew import join_heavy
from loomtrace.runtime import discard, materialise, ship_package

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
BUCKET_ROWS = 2048
TARGET_OCCUPANCY = 4
BROADCAST_ROWS = 200_000


def fingerprint(words: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of a word list."""
    import numpy as np
    import xxhash

    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, len(stops))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * counts > len(hashes)).tolist())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprint_partitions(shingle: int, seed: int):
    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, "text"):
                prints = [_signed(fingerprint(t.lower().split() if t else [], shingle, seed)) for t in byte_column(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(prints, pa.int64())], names=["doc_id", "digest", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, digest (a hash of the text) and fp (the fingerprint as a signed long) of every document."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("digest"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(releasing(_fingerprint_partitions(shingle, seed)), "doc_id long, digest long, fp long")


def block_masks(blocks: int, radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """One mask for each choice of blocks - radius blocks."""
    cuts = [round(k * bits / blocks) for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [sum(parts[k] for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def choose_blocks(n: int, radius: int = RADIUS, bits: int = BITS, occupancy: int = TARGET_OCCUPANCY) -> int:
    """The fewest blocks whose keys are long enough for n random fingerprints to fill few to a bucket."""
    for blocks in range(radius + 1, 2 * radius + 3):
        if n <= occupancy << (bits * (blocks - radius) // blocks):
            return blocks
    return 2 * radius + 2


def _links(radius: int):
    def forest(fps):
        """Tree edges (positions) of the graph of pairs within the radius."""
        import numpy as np

        n = len(fps)
        if n <= 64:
            near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
            if int(near.sum()) == n:
                return
        left = np.arange(1, n)
        queue = [0]
        while queue or len(left):
            if not queue:
                queue.append(int(left[0]))
                left = left[1:]
                continue
            i = queue.pop()
            if len(left):
                hit = np.bitwise_count(fps[left] ^ fps[i]) <= radius
                if hit.any():
                    for j in left[hit].tolist():
                        yield i, j
                        queue.append(j)
                    left = left[~hit]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held_key, held = None, []

        def flush(out):
            if len(held) > 1 or held and len(held[0]) > 1:
                fps = np.unique(np.concatenate(held)).view(np.uint64)
                signed = fps.view(np.int64)
                for i, j in forest(fps):
                    out.append((int(signed[i]), int(signed[j])))

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in ("mask", "key", "cut")]
            fps = batch.column("fp").to_numpy()
            change = np.zeros(len(fps), bool)
            change[0] = True
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            cuts = [*np.flatnonzero(change).tolist(), len(fps)]
            out: list[tuple[int, int]] = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(int(c[a]) for c in cols)
                if key != held_key:
                    flush(out)
                    held_key, held = key, []
                held.append(fps[a:b])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["src", "dst"])
        out = []
        flush(out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["src", "dst"])

    return run


def radius_links(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(src, dst): a set of links between the distinct fingerprints ``fp`` with the same components as
    all pairs at ``radius`` or fewer differing bits."""
    ship_package(prints.sparkSession)
    blocks = blocks or choose_blocks(prints.count(), radius)
    masks = block_masks(blocks, radius)
    signed = F.array(*[F.lit(_signed(m)) for m in masks])
    table = prints.select("fp", F.posexplode(signed).alias("mask", "bits")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("bits")).alias("key"))
    sizes = table.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    hot = materialise(sizes.where(F.col("n") > bucket_rows), "hot-buckets")
    cuts = F.ceil(F.col("n") / (bucket_rows // 2)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    common = table.join(hot, ["mask", "key"], "left_anti").withColumn("cut", F.lit(-1).cast("long"))
    split = (
        table.join(hot.withColumn("cuts", cuts), ["mask", "key"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .withColumn("cut", F.least("own", "other").cast("long") * F.col("cuts") + F.greatest("own", "other"))
    )
    columns = ["mask", "key", "cut", "fp"]
    dealt = common.select(columns).unionByName(split.select(columns)) if not hot.isEmpty() else common.select(columns)
    dealt = dealt.repartition("mask", "key", "cut").sortWithinPartitions("mask", "key", "cut")
    return dealt.mapInArrow(_links(radius), "src long, dst long").distinct()


def _grouped(prints: DataFrame, radius: int) -> tuple[DataFrame, int]:
    """(fp, component, component_id, n: its rows in ``prints``) of every distinct fingerprint; all rows of prints."""
    least = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n")), "distinct-fingerprints")
    links = materialise(radius_links(least.select("fp"), radius), "links")
    groups = connected_components(links).withColumnRenamed("node", "fp")
    named = materialise(least.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "named-fingerprints")
    rep = materialise(named.groupBy("component").agg(F.min("doc").alias("component_id"), F.count("*").alias("members")), "groups")
    sums = named.agg(F.count("*").alias("n"), F.sum("n").alias("rows")).first()
    out = join_heavy(named.drop("doc"), rep, ["component"], sums["n"], "members")
    out = materialise(out, "fingerprint-groups")
    discard(least, links, named, rep)
    return out, sums["rows"] or 0


def simhash_groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id of the group) per document."""
    prints = materialise(fingerprints(docs, shingle, seed).drop("digest"), "fingerprints")
    ids, total = _grouped(prints, radius)
    return join_heavy(prints, ids.drop("component"), ["fp"], total).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row of each group, of its least doc_id; columns as they came.

    A row is known by its doc_id and a hash of its text, so texts of different groups under one doc_id are
    judged apart. Of several texts of a group under its least doc_id the one of least hash stays, and of rows
    with the same text one; rows with a null doc_id have no identity to compare and stay. The rows to drop are
    broadcast if they are counted to be ``broadcast_rows`` at most, and met by a shuffle beyond."""
    rows = docs.where("doc_id is not null")
    prints = materialise(fingerprints(rows), "fingerprints")
    ids, total = _grouped(prints, radius)
    texts = prints.groupBy("doc_id", "digest", "fp").agg(F.count("*").alias("copies"))
    texts = materialise(join_heavy(texts, ids, ["fp"], total), "near-duplicate-texts")
    lead = texts.where("doc_id = component_id").groupBy("component").agg(F.min("digest").alias("lead"))
    lead = materialise(lead, "leading-texts")
    first = (F.col("doc_id") == F.col("component_id")) & (F.col("digest") == F.col("lead"))
    judged = texts.join(lead, "component").where(~first | (F.col("copies") > 1))
    judged = materialise(judged.select(F.col("doc_id").alias("lost_id"), F.col("digest").alias("lost_digest"), first.alias("leads")), "lost")
    discard(prints, ids, texts, lead)
    few = judged.count() <= broadcast_rows
    held = F.broadcast(judged) if few else judged
    same = (docs["doc_id"] == held["lost_id"]) & (F.xxhash64(docs["text"].cast("string")) == held["lost_digest"])
    kept = docs.join(held, same, "left_anti")
    repeated = judged.where("leads")
    if repeated.isEmpty():
        return kept
    again = docs.join(F.broadcast(repeated) if few else repeated, same, "left_semi")
    whole = F.struct(*[again[c] for c in docs.columns])
    one = again.groupBy(again["doc_id"], F.xxhash64(again["text"].cast("string")).alias("_digest")).agg(F.min_by(whole, F.xxhash64(*[again[c] for c in docs.columns])).alias("_row"))
    return kept.unionByName(one.select("_row.*"))
