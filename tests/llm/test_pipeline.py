"""The corpus pipeline against its steps written out, and the registered queries."""

import corpus_pipeline
from loomtrace.llm import decontamination, pii, quality_rules
from loomtrace.llm.queries import ORACLE_SQL, QUERIES
from loomtrace.llm.tokens import default_tokenizer
from tests.conftest import SMALL
from tests.llm.helpers import no_docs, odd_docs
from tests.llm.test_near_copies import slow_fingerprint, slow_groups
from tests.llm.test_tokens_packing import check_packing


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline") == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES) and len(corpus_pipeline.STAGES) == 5


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    references = quality_rules.language_references(docs)
    rows = [r for r in rows if quality_rules.judge_text(r.text.encode(), r.lang, references)[6]]
    group = slow_groups([slow_fingerprint(r.text) for r in rows])
    rows = [r for k, r in enumerate(rows) if min(group[k]) == k]
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    index = decontamination.BenchmarkIndex([(r.item_id, r.text) for r in bench])
    dirty = {d for d, *_ in index.hits([r.text.encode() for r in rows])}
    kept = {r.doc_id: pii.redact_text(r.text) for k, r in enumerate(rows) if k not in dirty}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in got} == set(kept) and dirty
    used, least = check_packing(got, kept, 4096)
    assert used <= least + 2 and default_tokenizer()


def test_stages_keep_columns(spark):
    docs = odd_docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == odd_docs(spark).columns
    docs.collect()
    empty = no_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
    assert empty.count() == 0
