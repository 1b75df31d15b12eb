"""Quality classifier with hierarchical empirical Bayes over sites.

1. Document evidence: two logistic heads (quality, toxicity) over hashed word presence and a few shape
   figures, fitted on a sample of at most ``TRAIN_ROWS`` labelled documents (a documented bound; the
   sample is the labelled ids of least hash, so it does not depend on partitioning).
2. Sites: documents are summed by path within host, paths by host, hosts over all; every document
   counts. The strength of each prior comes from the moments of the level below it (beta-binomial), so
   sparse paths shrink to their host and sparse hosts to the global rate.
3. A document's posterior is its own evidence plus the log odds of its path's posterior rate, without
   its own share, over the global rate.

Only sums cross the network: a host with a third of all rows is a handful of partial sums.

Defined cases: a null text has no words; a null host or path is a site of its own; without labels of
both classes a head has no evidence and its posterior is the favourable prior; repeated labels of a
document count by their maximum; repeated rows are rows like any others; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.quality_rules import char_histogram
from loomtrace.llm.tokens import CACHE_CHUNK_BYTES, byte_column, releasing, slices, task_cache, trim
from loomtrace.operators.skew import join_heavy
from loomtrace.runtime import materialise, ship_package

TRAIN_ROWS = 6000
BUCKETS = 1 << 18
FEATURES = 600
MIN_SUPPORT = 4
MIN_Z = 4.0
RIDGE = 2e-3
STEPS = 300
EVIDENCE_LIMIT = 12.0
SEED = 11

SHAPE = ("symbols", "capitals", "digits", "other", "stutter", "variety", "length", "word_length")
_PUNCTUATION = b".,;:!?\"'()[]{}*#$%&|<>-_=+/\\"
_cache: dict[bytes, int] = task_cache()


def featurise(texts: list[bytes | None]):
    """(buckets of all words, owner of each, shape figures per text)."""
    import numpy as np
    import xxhash

    words = [t.lower().split() if t else [] for t in texts]
    trim(_cache)
    digest = xxhash.xxh32_intdigest
    fresh = set().union(*words).difference(_cache)
    for w in fresh:
        _cache[w] = digest(w.strip(_PUNCTUATION) or w, SEED) % BUCKETS
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    buckets = np.fromiter((b for own in words for b in map(_cache.__getitem__, own)), np.int64, int(sizes.sum()))
    for w in fresh:
        if len(w) > CACHE_CHUNK_BYTES:
            del _cache[w]
    owner = np.repeat(np.arange(len(words)), sizes)
    shape = np.zeros((len(texts), len(SHAPE)))
    same = np.zeros(len(buckets), bool)
    same[1:] = (buckets[1:] == buckets[:-1]) & (owner[1:] == owner[:-1])
    stutter = np.bincount(owner, weights=same, minlength=len(texts))
    for k, (t, n) in enumerate(zip(texts, sizes.tolist(), strict=True)):
        if n:
            h = char_histogram(np.bincount(np.frombuffer(t, np.uint8), minlength=256))
            total = h.sum()
            letters = max(1.0, h[0] + h[1] + h[6])
            shape[k] = h[5] / total, h[1] / letters, h[2] / total, h[6] / letters, stutter[k] / n, len(set(words[k])) / n, np.log1p(n), (total - h[3]) / n
    return buckets, owner, shape


class Head:
    """A logistic model over some buckets and the standardised shape figures."""

    def __init__(self, buckets, weights, mean, scale, shape_weights, bias):
        self.buckets, self.weights, self.mean, self.scale, self.shape_weights, self.bias = buckets, weights, mean, scale, shape_weights, bias

    @classmethod
    def fit(cls, doc_buckets: list, shape, target) -> Head | None:
        import numpy as np

        target = np.asarray(target, float)
        n, pos = len(target), float(target.sum())
        if n < 2 or pos == 0 or pos == n:
            return None
        lengths = np.fromiter(map(len, doc_buckets), np.int64, n)
        flat = np.concatenate(doc_buckets).astype(np.int64) if lengths.sum() else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(n), lengths)
        seen = np.bincount(flat, minlength=BUCKETS).astype(float)
        good = np.bincount(flat, weights=target[owner], minlength=BUCKETS)
        rate = seen / n
        # Score test of each bucket's presence against the target; buckets with little support stay out.
        with np.errstate(divide="ignore", invalid="ignore"):
            z = (good - seen * pos / n) / np.sqrt(seen * (1 - rate) * (pos / n) * (1 - pos / n))
        z = np.where((seen >= MIN_SUPPORT) & (rate < 1), np.abs(np.nan_to_num(z)), 0.0)
        order = np.lexsort((np.arange(BUCKETS), -z))[:FEATURES]
        chosen = np.sort(order[z[order] >= MIN_Z])
        column = np.full(BUCKETS, -1)
        column[chosen] = np.arange(len(chosen))
        x = np.zeros((n, len(chosen) + shape.shape[1] + 1))
        hit = column[flat] >= 0
        x[owner[hit], column[flat[hit]]] = 1.0
        mean, scale = shape.mean(0), shape.std(0)
        scale = np.where(scale > 1e-9, scale, 1.0)
        x[:, len(chosen) : -1] = np.clip((shape - mean) / scale, -6, 6)
        x[:, -1] = 1.0
        w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
        for step in range(1, STEPS + 1):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (p - target) / n + RIDGE * np.append(w[:-1], 0.0)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(chosen, w[: len(chosen)], mean, scale, w[len(chosen) : -1], w[-1])

    def logits(self, buckets, owner, shape):
        import numpy as np

        weight = np.zeros(BUCKETS)
        weight[self.buckets] = self.weights
        hit = np.flatnonzero(weight[buckets] != 0)
        pairs = np.unique(owner[hit] * BUCKETS + buckets[hit])
        out = np.bincount(pairs // BUCKETS, weights=weight[pairs % BUCKETS], minlength=len(shape))
        out = out + np.clip((shape - self.mean) / self.scale, -6, 6) @ self.shape_weights + self.bias
        return np.clip(out, -EVIDENCE_LIMIT, EVIDENCE_LIMIT)


def _training_partitions(batches):
    import numpy as np
    import pyarrow as pa

    for whole in batches:
        for batch in slices(whole, "text"):
            buckets, owner, shape = featurise(byte_column(batch.column("text")))
            pairs = np.unique(owner * BUCKETS + buckets)
            cuts = np.searchsorted(pairs, np.arange(batch.num_rows + 1) * BUCKETS)
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array((pairs % BUCKETS).astype(np.int32)))
            figures = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(SHAPE)), pa.array(shape.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), batch.column("toxic"), lists, figures], names=["doc_id", "quality", "toxic", "buckets", "shape"]
            )


def train_heads(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[Head | None, Head | None]:
    """The quality and toxicity heads, from at most ``rows`` labelled documents."""
    import numpy as np

    ship_package(docs.sparkSession)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = texts.join(F.broadcast(sample), "doc_id").mapInArrow(
        _training_partitions, "doc_id long, quality int, toxic int, buckets array<int>, shape array<double>"
    )
    # Rows that repeat a sampled doc_id would unbound the sample: the first few in a fixed order stay.
    table = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "buckets", "shape").limit(rows).toArrow()
    if not table.num_rows:
        return None, None
    lists = [np.array(x, np.int64) for x in table.column("buckets").to_pylist()]
    shape = np.array(table.column("shape").to_pylist(), float)
    heads = []
    for name in ("quality", "toxic"):
        target = table.column(name).to_pylist()
        kept = [k for k, t in enumerate(target) if t is not None]
        heads.append(Head.fit([lists[k] for k in kept], shape[kept], [1 if target[k] > 0 else 0 for k in kept]) if kept else None)
    return tuple(heads)


def _evidence(heads):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, "text"):
                features = featurise(byte_column(batch.column("text")))
                out = [np.full(batch.num_rows, default) if head is None else head.logits(*features) for head, default in zip(heads, (EVIDENCE_LIMIT, -EVIDENCE_LIMIT), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "host", "path")] + [pa.array(x) for x in out], names=["doc_id", "host", "path", "q", "t"])

    return run


def _strength(rows: DataFrame, total: str, count: str, prior) -> float:
    """Prior strength (pseudo-documents) of a level by the method of moments, from one aggregate row."""
    rate = F.col(total) / F.col(count)
    deviation = F.pow(rate - prior, 2)
    noise = prior * (1 - prior) / F.col(count)
    r = rows.where(F.col(count) > 1).agg(F.avg(deviation).alias("d"), F.avg(noise).alias("e"), F.avg(prior * (1 - prior)).alias("b"), F.count("*").alias("n")).first()
    if not r.n or r.n < 2:
        return 100.0
    between = max((r.d or 0.0) - (r.e or 0.0), 1e-6)
    return min(max((r.b or 0.0) / between - 1, 2.0), 10_000.0)


def site_of(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: the host in lower case without ``www.``, and the first part of its path; null where it has none."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    return F.nullif(host, F.lit("")), F.nullif(F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), r"^/+([^/]+)", 1), F.lit(""))


def classify_documents(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", rows: int = TRAIN_ROWS, url: str | None = None) -> DataFrame:
    """doc_id, evidence and posteriors of both heads, site rates, and kept.

    Sites are the columns ``host`` and ``path``, or what ``site_of`` finds in the column ``url``."""
    heads = train_heads(docs, labels, rows)
    site = site_of(F.col(url).cast("string")) if url else (F.col(host).cast("string"), F.col(path).cast("string"))
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), site[0].alias("host"), site[1].alias("path"), F.col("text").cast("string").alias("text"))
    scored = materialise(table.mapInArrow(releasing(_evidence(heads)), "doc_id long, host string, path string, q double, t double"), "evidence")
    for k in ("q", "t"):
        scored = scored.withColumn(f"p{k}", 1 / (1 + F.exp(-F.col(k))))
    paths = materialise(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("pq").alias("sq"), F.sum("pt").alias("st")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("sq").alias("hsq"), F.sum("st").alias("hst"))
    whole = hosts.agg(F.sum("hn").alias("n"), F.sum("hsq").alias("q"), F.sum("hst").alias("t")).first()
    n = whole.n or 1
    sites = paths.withColumnRenamed("host", "h").join(hosts, F.col("h").eqNullSafe(F.col("host"))).drop("h")
    sites = materialise(sites, "sites")
    # A struct compares its nulls as equal; a site with a large part of all documents is broadcast to them.
    site_key = F.struct("host", "path").alias("site")
    named = sites.select(site_key, "n", "sq", "st", "hn", "hsq", "hst", F.col("n").alias("members"))
    final = join_heavy(scored.select("*", site_key).drop("host", "path"), named, ["site"], n, "members")
    for k, total in (("q", whole.q or 0.0), ("t", whole.t or 0.0)):
        base = min(max(total / n, 1e-4), 1 - 1e-4)
        host_strength = _strength(hosts, f"hs{k}", "hn", F.lit(base))
        host_rate = (F.col(f"hs{k}") + host_strength * base) / (F.col("hn") + host_strength)
        path_strength = _strength(sites, f"s{k}", "n", host_rate)
        own = F.col(f"p{k}")
        rest_host = (F.col(f"hs{k}") - own + host_strength * base) / (F.col("hn") - 1 + host_strength)
        rest_path = (F.col(f"s{k}") - own + path_strength * rest_host) / (F.col("n") - 1 + path_strength)
        rate = F.least(F.greatest(rest_path, F.lit(1e-4)), F.lit(1 - 1e-4))
        odds = F.col(k) + F.log(rate / (1 - rate)) - F.log(F.lit(base / (1 - base)))
        final = final.withColumn(f"host_{k}", host_rate).withColumn(f"path_{k}", rate).withColumn(f"post_{k}", 1 / (1 + F.exp(-odds)))
    return final.select(
        "doc_id",
        F.col("pq").alias("quality_evidence"),
        F.col("pt").alias("toxic_evidence"),
        F.col("host_q").alias("host_quality"),
        F.col("path_q").alias("path_quality"),
        F.col("host_t").alias("host_toxic"),
        F.col("path_t").alias("path_toxic"),
        F.col("post_q").alias("quality_posterior"),
        F.col("post_t").alias("toxic_posterior"),
        ((F.col("post_q") >= 0.5) & (F.col("post_t") < 0.5)).alias("kept"),
    )
