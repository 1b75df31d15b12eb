"""SimHash groups and repeated passages against brute force."""

import hashlib
import random

import pytest
import xxhash

from loomtrace.llm import simhash, suffix_dedup
from tests.conftest import SMALL
from tests.llm.helpers import docs_of, no_docs, odd_docs


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints, radius=4):
    """Index -> all indices reachable over links."""
    group = {k: {k} for k in range(len(prints))}
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and group[i] is not group[j]:
                group[i] |= group[j]
                for k in group[j]:
                    group[k] = group[i]
    return group


def test_groups_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    prints = [slow_fingerprint(r.text) for r in rows]
    group = slow_groups(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs).collect()}
    assert got == {r.doc_id: (f"{prints[k]:016x}", min(rows[x].doc_id for x in group[k])) for k, r in enumerate(rows)}


@pytest.mark.parametrize(("blocks", "bucket_rows"), [(5, 2048), (6, 2048), (7, 4), (8, 2048), (5, 4)])
def test_links_keep_every_component(spark, blocks, bucket_rows):
    draw = random.Random(blocks)
    prints = [draw.getrandbits(64) for _ in range(60)]
    for p in prints[:20]:  # chains of near ones, at and beyond the radius
        for _ in range(6):
            for bit in draw.sample(range(64), draw.choice([1, 3, 4, 5])):
                p ^= 1 << bit
            prints.append(p)
    prints = sorted(set(prints))
    frame = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    links = [(r.src % (1 << 64), r.dst % (1 << 64)) for r in simhash.radius_links(frame, 4, blocks, bucket_rows).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    index = {p: k for k, p in enumerate(prints)}
    group, want = {k: {k} for k in index.values()}, slow_groups(prints)
    for a, b in links:
        a, b = group[index[a]], group[index[b]]
        if a is not b:
            a |= b
            for k in b:
                group[k] = a
    assert all(group[k] == want[k] for k in group)


def test_masks_cover_every_pattern_of_differences():
    from itertools import combinations

    for blocks in range(5, 9):
        masks = simhash.block_masks(blocks)
        width = 64 / blocks
        for hit in combinations(range(blocks), 4):
            difference = sum(1 << int((b + 0.5) * width) for b in hit)
            assert any(difference & m == 0 for m in masks)
    assert simhash.choose_blocks(0) == 5 <= simhash.choose_blocks(10**6) < simhash.choose_blocks(10**10) <= 10


def test_simhash_odd_and_empty(spark):
    got = simhash.simhash_groups(odd_docs(spark)).collect()
    assert len(got) == odd_docs(spark).count()
    assert {r.fingerprint for r in got if r.doc_id in (1, 2, 3)} == {"0" * 16} and {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert simhash.simhash_groups(no_docs(spark)).count() == 0
    kept = simhash.drop_near_duplicates(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and 1 in ids and 2 not in ids and ids.count(5) >= 2


def slow_cut(rows, length=50):
    seen = {}
    for d, t in rows:
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            seen[w] = min(seen.get(w, d), d)
    out = []
    for d, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] < d:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


LARGEST = suffix_dedup.NO_ID


def cut(df, **settings):
    return sorted((LARGEST if r[0] is None else r[0], *r[1:]) for r in map(tuple, suffix_dedup.remove_repeats(df, **settings).collect()))


def bytes_of(df):
    return [(LARGEST if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in df.collect()]


@pytest.mark.parametrize("settings", [{}, {"hot_texts": 1}, {"block_bytes": 20_000, "symbols": 3000, "broadcast_rows": 0}, {"block_bytes": 5000, "hot_texts": 2}])
def test_repeats_equal_brute_force(spark, settings):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert cut(docs, **settings) == slow_cut(bytes_of(docs))


def test_repeats_in_periodic_and_tiny_alphabets(spark):
    draw = random.Random(9)
    texts = ["ab" * 100, "ba" * 60, "a" * 49, "a" * 50, "a" * 300, "a" * 50 + "b" * 50, "é" * 40, "x" + "é" * 40]
    texts += ["".join(draw.choice("ab") for _ in range(400)) for _ in range(5)]
    base = "".join(draw.choice("abcdef ") for _ in range(900))
    for _ in range(12):
        a = draw.randrange(700)
        texts.append(base[a : a + draw.randrange(40, 200)] + "".join(draw.choice("xyz") for _ in range(9)) + base[: draw.randrange(120)])
    draw.shuffle(texts)
    docs = docs_of(spark, texts)
    assert cut(docs) == slow_cut(bytes_of(docs))


def test_repeats_odd_and_empty(spark):
    assert cut(odd_docs(spark)) == slow_cut(bytes_of(odd_docs(spark)))
    assert suffix_dedup.remove_repeats(no_docs(spark)).count() == 0


def test_kept_bytes(spark):
    rows = suffix_dedup.remove_repeats(docs_of(spark, ["p" * 20 + "q" * 60, "r" * 10 + "q" * 60 + "s"]), keep_text=True).orderBy("doc_id").collect()
    assert bytes(rows[1].kept) == b"r" * 10 + b"s" and rows[1].n_spans == 1


def test_suffix_array():
    draw = random.Random(2)
    for n in (0, 1, 2, 3, 4, 5, 6, 7, 31, 100, 301):
        for letters in (1, 2, 60):
            s = [draw.randint(1, letters) for _ in range(n)]
            assert suffix_dedup.suffix_array(s).tolist() == sorted(range(n), key=lambda k: s[k:])


def test_near_duplicates_are_dropped_by_row(spark):
    a, b, z = "the cat sat on the mat and saw the dog run over a hill " * 3, "quite another text that is like none of the rest here " * 3, "a third text stands here and no one else has it at all " * 3
    rows = [(1, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1), (9, a, "en", "s", 1), (7, z, "en", "s", 1), (7, z, "en", "s", 1), (8, z, "en", "s", 1), (None, z, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for few in (200_000, 0):
        kept = sorted(((r.doc_id, r.text) for r in simhash.drop_near_duplicates(docs, broadcast_rows=few).collect()), key=str)
        assert kept == sorted([(1, a), (5, b), (7, z), (None, z)], key=str)
