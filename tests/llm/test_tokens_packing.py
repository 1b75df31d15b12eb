"""Token store and packing: exact round trips, file layout, packing invariants."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomtrace.llm import packing, token_store
from loomtrace.llm.tokens import default_tokenizer, encoder
from tests.conftest import MEDIUM, SMALL
from tests.llm.helpers import docs_of, no_docs, odd_docs

PATH = default_tokenizer()
LIBRARY = Tokenizer.from_file(PATH)


def reference_ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library():
    draw = random.Random(1)
    letters = [*"abcXYZ ,.,. ..\n\t'’éÉ×÷ßİΣ3½#|<>-\x0b\x0c\x1c\x85\xa0", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "漢", "́", "»", "…", "क्"]
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    own = encoder(PATH)
    assert own.ids([t.encode() for t in texts]) == want
    assert own.ids([t.encode() for t in texts]) == want  # from the cache


def test_store_round_trip(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    start, want = 0, {}
    for r in docs.orderBy("doc_id").collect():
        ids = reference_ids(r.text)
        want[r.doc_id] = (start, len(ids), crc(ids))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.token_store_round_trip(docs, PATH).collect()}
    assert got == want


def test_store_layout_and_selective_reads(spark, tmp_path):
    import pyarrow.parquet as pq

    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    path = f"file://{tmp_path}/store"
    token_store.write_token_store(docs, path, PATH, row_group_bytes=64 << 10, page_bytes=16 << 10)
    files = sorted((tmp_path / "store").glob("*.parquet"))
    last, groups = -1, 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
            assert "RLE_DICTIONARY" in columns["tokens.list.element"].encodings
            assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index
            assert columns["doc_id"].statistics.min > last
            last = columns["doc_id"].statistics.max
    assert groups > len(files)
    some = token_store.read_token_store(spark, path, ["doc_id", "n_tokens"], 10, 19)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "tokens" not in plan.split("ReadSchema")[1].replace("n_tokens", "")
    assert sorted(r.doc_id for r in some.collect()) == list(range(10, 20))


def test_store_odd_and_empty(spark):
    rows = token_store.token_store_round_trip(odd_docs(spark), PATH).collect()
    assert len(rows) == odd_docs(spark).count()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows[:2]] == [None, None] and [r.doc_id for r in rows[2:]] == sorted(r.doc_id for r in rows[2:])
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert token_store.token_store_round_trip(no_docs(spark), PATH).count() == 0


def check_packing(rows, docs, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc_id, text in docs.items():
        ids, own = reference_ids(text), sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [(r.start, r.length, r.ids_crc32) for r in own] == [(a, len(ids[a : a + capacity]), crc(ids[a : a + capacity])) for a in range(0, len(ids), capacity)]
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence), -(-sum(r.length for r in rows) // capacity)


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing(spark, capacity):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = packing.pack_documents(docs, PATH, capacity).collect()
    used, least = check_packing(rows, {r.doc_id: r.text for r in docs.collect()}, capacity)
    assert used <= 1.02 * least + 1


def test_packing_many_copies(spark):
    rows = packing.pack_documents(docs_of(spark, ["a b c"] * 5000 + ["d e"] * 3), PATH, 8).collect()
    used, least = check_packing(rows, {k: "a b c" if k < 5000 else "d e" for k in range(5003)}, 8)
    assert used == least


def test_packing_odd_and_empty(spark):
    rows = packing.pack_documents(odd_docs(spark), PATH).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert sum(r.length for r in rows) == sum(len(reference_ids(r.text)) for r in odd_docs(spark).collect())
    assert packing.pack_documents(no_docs(spark), PATH).count() == 0


def test_plan_uses_up_the_histogram():
    draw = random.Random(4)
    for _ in range(5):
        histogram = {draw.randint(1, 100): draw.randint(1, 500) for _ in range(30)}
        left, used = dict(histogram), 0
        for pattern, count in packing.plan_sequences(histogram, 100):
            assert sum(pattern) <= 100 and count > 0
            used += count
            for n in pattern:
                left[n] -= count
        assert not any(left.values())
        # Volume and the number of pieces over half a sequence bound any packing from below.
        least = max(-(-sum(n * c for n, c in histogram.items()) // 100), sum(c for n, c in histogram.items() if n > 50))
        assert used <= 11 / 9 * least + 1


def best_fit_alone(histogram, capacity):
    """Sequences of best-fit decreasing, one piece at a time."""
    rooms = []
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        at = min((r for r in rooms if r >= n), default=None)
        if at is None:
            rooms.append(capacity - n)
        else:
            rooms.remove(at)
            rooms.append(at - n)
    return len(rooms)


def test_most_pieces_come_from_fitted_patterns(spark):
    rows = packing.pack_documents(spark.read.parquet(f"{MEDIUM}/documents.parquet"), PATH).collect()
    histogram = defaultdict(int)
    for r in rows:
        histogram[r.length] += 1
    plan, left = packing.fitted_patterns(dict(histogram))
    assert sum(left.values()) < 0.3 * len(rows)
    assert all(2 <= len(p) <= packing.PIECES or p == (4096,) for p, _ in plan) and sum(len(p) * c for p, c in plan) + sum(left.values()) == len(rows)
    assert sum(c for _, c in packing.plan_sequences(dict(histogram))) == -(-sum(n * c for n, c in histogram.items()) // 4096)


def test_the_fit_beats_best_fit():
    histogram = {48: 100, 32: 100, 21: 90, 11: 100, 20: 100}  # 48+32+20 and 48+21+20+11 fill; best fit pairs the 48s first
    used = sum(c for _, c in packing.plan_sequences(histogram, 100))
    assert used <= best_fit_alone(histogram, 100)
    draw, fitted, plain = random.Random(4), 0, 0
    for _ in range(8):
        histogram = {draw.randint(1, 100): draw.randint(1, 200) for _ in range(30)}
        fitted += sum(c for _, c in packing.plan_sequences(histogram, 100))
        plain += best_fit_alone(histogram, 100)
    assert fitted < plain


def test_the_fit_is_of_least_squares():
    lengths, counts = [30, 40, 60, 70], np.array([20.0, 15.0, 15.0, 12.0])
    patterns = packing.enumerate_patterns(lengths, counts, 100)
    assert set(patterns) >= {(3, 0), (2, 1)} and all(sum(lengths[i] for i in p) == 100 for p in patterns)
    weights = np.array(lengths) / 100
    x, left = packing.fit_patterns(patterns, counts, weights, float((weights * counts).sum()), np.zeros(len(patterns)), steps=3000, settled=0.0)
    used = np.zeros((4, len(patterns)))
    for j, p in enumerate(patterns):
        for i in p:
            used[i, j] += 1
    assert np.allclose(left, counts - used @ x) and (x >= 0).all()
    slope = used.T @ (weights * left) + 0.1 * ((weights * counts).sum() - x.sum())  # optimal: none to gain, none to lose
    assert (slope < 1e-6).all() and np.allclose(slope * x, 0, atol=1e-5)


def test_pricing_finds_the_best_pattern():
    from itertools import combinations_with_replacement

    draw, lengths = random.Random(3), [5, 9, 14, 22, 30]
    gains = np.array([draw.uniform(-1, 3) for _ in lengths])
    found = packing.price_patterns(lengths, gains, 50, 4, 12, 2.0)
    value = lambda p: sum(gains[i] for i in p) - 2.0 * (50 - sum(lengths[i] for i in p)) / 50
    for i in range(len(lengths)):
        every = [p for k in range(4) for p in ((i, *q) for q in combinations_with_replacement(range(5), k)) if 38 <= sum(lengths[x] for x in p) <= 50]
        top = max(map(value, every), default=-1)
        if top > 1e-9:
            assert any(i in p and abs(value(p) - top) < 1e-9 for p in found)
