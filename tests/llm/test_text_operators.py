"""Scoring, quality rules, classifier, personal data, chat rotation and decontamination."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.llm import chat_rotation, decontamination, lm_scoring, pii, quality_bayes, quality_rules
from tests.conftest import MEDIUM, SMALL, same_rows
from tests.llm.helpers import docs_of, labels_of, no_docs, odd_docs

# --- language-model scoring ---------------------------------------------------------------------------


def slow_scores(docs, good):
    """Leave-one-out interpolated bigram losses over whole words, with plain dictionaries."""
    words = {d: (t or "").encode().lower().split() for d, t in docs.items()}
    sides = [set(docs), set(good) & set(docs) or set(docs)]
    totals = [sum(len(words[d]) for d in s) for s in sides]
    scales = [totals[1] / totals[0], 1.0]
    uni = [Counter(w for d in s for w in words[d]) for s in sides]
    bi = [Counter(p for d in s for p in zip(words[d], words[d][1:], strict=False)) for s in sides]
    out = {}
    for d in docs:
        losses = []
        for k in (0, 1):
            own = d in sides[k]
            less_w, less_p = (Counter(words[d]), Counter(zip(words[d], words[d][1:], strict=False))) if own else (Counter(), Counter())
            total = scales[k] * (totals[k] - (len(words[d]) if own else 0))
            loss = 0.0
            for x, w in enumerate(words[d]):
                single = (scales[k] * (uni[k][w] - less_w[w]) + 0.5) / (total + 0.5 * len(uni[0]))
                before = words[d][x - 1] if x else None
                context = uni[k][before] - less_w[before] if x else 0
                if context > 0:
                    single = 0.7 * (bi[k][before, w] - less_p[before, w]) / context + 0.3 * single
                loss -= math.log(single)
            losses.append(loss / len(words[d]) if words[d] else None)
        out[d] = (len(words[d]), losses[1], losses[0])
    return out


def test_scores_equal_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    want = slow_scores({r.doc_id: r.text for r in docs.collect()}, [r.doc_id for r in labels.collect() if r.quality == 1])
    got = lm_scoring.score_documents(docs, labels).collect()
    assert len(got) == len(want)
    for r in got:
        n, target, background = want[r.doc_id]
        assert r.n_tokens == n and r.target_loss == pytest.approx(target, rel=1e-9) and r.background_loss == pytest.approx(background, rel=1e-9)
        assert r.score == pytest.approx(r.target_loss - r.background_loss)


def test_scores_alike_in_any_chunks_and_buckets(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    want = {r.doc_id: r for r in lm_scoring.score_documents(docs, labels).collect()}
    got = lm_scoring.score_documents(docs.repartition(7), labels, bucket_keys=5_000, least_bits=1).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.n_tokens == want[r.doc_id].n_tokens and r.score == pytest.approx(want[r.doc_id].score, rel=1e-9, abs=1e-12)


def test_scores_by_shuffled_labels(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    tagged = {r.doc_id: r.good for r in lm_scoring.tag_good(docs, labels).collect()}
    assert tagged == {r.doc_id: r.good for r in lm_scoring.tag_good(docs, labels, 0).collect()} and any(tagged.values())


def test_scores_odd_and_empty(spark):
    labels = labels_of(spark, [(5, 1, 0), (5, 0, 0), (None, 1, 1), (77, 1, 0), (6, None, None)])
    got = lm_scoring.score_documents(odd_docs(spark), labels).collect()
    assert len(got) == odd_docs(spark).count() and all(r.score is None for r in got if r.n_tokens == 0)
    assert all(math.isfinite(r.score) for r in got if r.n_tokens)
    assert {r.score for r in lm_scoring.score_documents(odd_docs(spark), labels_of(spark, [])).collect()} <= {0.0, None}
    assert lm_scoring.score_documents(no_docs(spark), labels).count() == 0


# --- quality rules ------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    inside = {k + x for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for x in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(inside), n < 50 or 100 * len(inside) > 50 * n


def test_base_rules_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judge_documents(docs).collect()}
    assert got == {r.doc_id: slow_base(r.text) for r in docs.collect()}


def test_rules_agree_with_labels(spark):
    docs, labels = spark.read.parquet(f"{MEDIUM}/documents.parquet"), spark.read.parquet(f"{MEDIUM}/labels.parquet")
    rows = quality_rules.judge_documents(docs).join(labels, "doc_id").collect()
    long = [r for r in rows if r.n_words >= 100]
    assert sum(r.kept == bool(r.quality) for r in long) >= 0.98 * len(long)
    assert not any(r.kept for r in rows if r.base_failed)


def test_references_cover_all_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    references = quality_rules.language_references(docs)
    words, chars = defaultdict(Counter), defaultdict(int)
    for r in docs.collect():
        words[r.lang].update(WORD.findall(r.text))
        chars[r.lang] += len(r.text)
    assert set(references) == set(words)
    for lang, (h, index, counts) in references.items():
        total = sum(words[lang].values())
        assert h.sum() == chars[lang] and counts.sum() == total
        assert {w.decode(): counts[k] for w, k in index.items()} == {w: n for w, n in words[lang].items() if n >= 0.002 * total and len(w.encode()) <= 12}


def test_small_languages_keep_their_reference(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {tuple(r) for r in quality_rules.judge_documents(docs).collect()}
    for share in (0.12, 0.9):  # one and all languages below the share
        assert {tuple(r) for r in quality_rules.judge_documents(docs, share).collect()} == want
        kept = quality_rules.keep_documents(docs, share)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in want if r[7]}


def test_tiny_languages_are_not_held_against_others(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    references = quality_rules.language_references(docs)
    text = next(r.text for r in docs.collect() if r.lang == "de" and quality_rules.judge_text(r.text.encode(), "de", references)[6]).encode()
    del references["de"]
    assert quality_rules.judge_text(text, "de", references)[6]


def test_divergence_bounds():
    p, q = np.array([1.0, 0, 3]), np.array([0.0, 5, 0])
    assert quality_rules.divergence(p, 7 * p) == pytest.approx(0) and quality_rules.divergence(p, q) == pytest.approx(1)


def test_rules_odd_and_empty(spark):
    rows = quality_rules.judge_documents(odd_docs(spark)).collect()
    assert len(rows) == odd_docs(spark).count() and all(r.base_failed and not r.kept for r in rows if r.n_words < 50)
    kept = quality_rules.keep_documents(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns and kept.count() == sum(r.kept for r in rows)
    assert quality_rules.judge_documents(no_docs(spark)).count() == 0 and quality_rules.keep_documents(no_docs(spark)).count() == 0


# --- classifier ---------------------------------------------------------------------------------------


def test_classifier_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{MEDIUM}/documents.parquet"), spark.read.parquet(f"{MEDIUM}/labels.parquet")
    train, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    rows = quality_bayes.classify_documents(docs, train).join(held, "doc_id").collect()
    assert sum((r.quality_posterior >= 0.5) == (r.quality == 1) for r in rows) >= 0.95 * len(rows)
    assert sum(r.kept for r in rows if r.quality == 1 and not r.toxic) >= 0.95 * sum(1 for r in rows if r.quality == 1 and not r.toxic)


def test_toxic_documents_are_caught(spark):
    draw = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(draw.choices(words, k=120)) + (" scum" if k % 8 == 0 else "") for k in range(400)]
    labels = labels_of(spark, [(k, 1, int(k % 8 == 0)) for k in range(200)])
    rows = {r.doc_id: r for r in quality_bayes.classify_documents(docs_of(spark, texts), labels).collect()}
    assert all(rows[k].kept == (k % 8 != 0) for k in range(200, 400))


def test_sparse_sites_shrink(spark):
    draw = random.Random(4)
    good, bad = [f"g{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    rows, labels = [], []
    for k in range(600):
        site = ("good", "x") if k < 280 else ("bad", "x") if k < 560 else ("good", f"p{k}")
        poor = site[0] == "bad"
        rows.append((k, " ".join(draw.choices(bad if poor else good, k=40)), site[1], site[0], 1))
        if k % 2:
            labels.append((k, int(not poor), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in quality_bayes.classify_documents(docs, labels_of(spark, labels)).collect()}
    assert got[0].host_quality > 0.8 > 0.2 > got[300].host_quality
    # A path seen once says nothing of its own beside itself: its rate comes from its host.
    assert abs(got[570].path_quality - got[570].host_quality) < 0.1


def test_classifier_odd_and_empty(spark):
    rows = quality_bayes.classify_documents(odd_docs(spark), labels_of(spark, [(5, 1, 0), (6, 0, 1), (5, None, None), (None, 1, 1)])).collect()
    assert len(rows) == odd_docs(spark).count() and all(0 <= r.quality_posterior <= 1 for r in rows)
    assert all(r.kept for r in quality_bayes.classify_documents(odd_docs(spark), labels_of(spark, [])).collect())
    assert quality_bayes.classify_documents(no_docs(spark), labels_of(spark, [])).count() == 0


# --- personal data ------------------------------------------------------------------------------------


def slow_spans(text):
    def luhn(d):
        v = [int(c) for c in d][::-1]
        return (sum(v[::2]) + sum(x * 2 - 9 * (x > 4) for x in v[1::2])) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def check_pii(rows, docs):
    for r in rows:
        want = slow_spans(docs[r.doc_id] or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, k, _ in want) for x in range(4))
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_pii_equals_brute_force(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    check_pii(pii.find_pii(docs).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_pii_on_random_text():
    draw = random.Random(8)
    parts = [*"0123456789@.+-() aZ_%é漢", "a@b.co", "1.2.3.4", "255.0.0.1", "+49 30 ", "4111 1111 1111 1111", "@@", "..", "http://", "ftp://u:p@h.org/x", "token=", "iban: DE89 3704 0044 0532 0130 00", "４"]
    for _ in range(20_000):
        text = "".join(draw.choices(parts, k=draw.randint(0, 25)))
        assert [s for s in pii.find_spans(text) if s[1] < 4] == slow_spans(text), text


@pytest.mark.parametrize(
    ("text", "kind"),
    [("see ftp://bob:pw@host.example/x now", "address"), ("mailto:bob@x.org", "address"), ("IBAN: DE89 3704 0044 0532 0130 00", "account"), ('token = "24be64439e3e49cf46b2d7c90f3602a3"', "account"), ("account number: 12345678", "account")],
)
def test_added_spans(text, kind):
    assert kind in {pii.KINDS[k] for _, k, _ in pii.find_spans(text)}


@pytest.mark.parametrize("text", ["a token of thanks", "the account is open", "see http://example.com/a", "iban: DE00 3704 0044 0532 0130 00", "version 1.2.3 of 2020", "passwords: see below"])
def test_clean_text_has_no_spans(text):
    assert pii.find_spans(text) == []


def test_redaction(spark):
    docs = docs_of(spark, ["mail a@b.co or +49 30 1234567", "nothing here", None])
    rows = pii.redact_pii(docs.withColumn("spans", F.lit(1))).orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["mail <email> or <phone>", "nothing here", None] and rows[0].n_chars == len(rows[0].text) and rows[0].spans == 1


def test_pii_odd_and_empty(spark):
    rows = pii.find_pii(odd_docs(spark)).collect()
    assert len(rows) == odd_docs(spark).count() and all(r.spans == "" for r in rows)
    assert pii.redact_pii(odd_docs(spark)).columns == odd_docs(spark).columns
    assert pii.find_pii(no_docs(spark)).count() == 0


# --- chat rotation ------------------------------------------------------------------------------------

CHAT = "conv_id long, turn long, role string, text string"


def test_rotation_matches_sql(spark, duck):
    same_rows(chat_rotation.rotate_perspectives(spark.read.parquet(f"{SMALL}/conversations.parquet")), duck, chat_rotation.ORACLE_SQL)


def rendered(rows):
    out = defaultdict(str)
    for r in sorted(rows, key=lambda r: (str(r.conv_id), r.perspective, r.position)):
        key = (r.conv_id, r.perspective)
        assert (r.start, r.end) == (len(out[key]), len(out[key]) + len(r.segment))
        out[key] += r.segment
    return out


@pytest.mark.parametrize("stretch", [1, 3, 256])
def test_rotation_of_three_speakers(spark, stretch):
    turns = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 3, "cy", None), (1, 4, "ann", "bye")]
    rows = chat_rotation.rotate_perspectives(spark.createDataFrame(turns, CHAT), stretch).collect()
    texts = rendered(rows)
    assert set(texts) == {(1, "ann"), (1, "bob"), (1, "cy")}
    assert texts[1, "bob"] == (
        "<|im_start|>system\nrules<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
        "<|im_start|>user name=cy\n<|im_end|>\n<|im_start|>user name=ann\nbye<|im_end|>\n"
    )
    learned = {texts[1, r.perspective][r.train_start : r.train_end] for r in rows if r.train_start is not None}
    assert learned == {"hi<|im_end|>", "bye<|im_end|>", "yo<|im_end|>", "<|im_end|>"}


def test_rotation_odd_and_empty(spark):
    turns = [(None, 1, "a", "x"), (None, None, None, None), (2, 1, "a", "t"), (2, 1, "a", "t"), (2, 1, "b", ""), (3, 0, "system", "only"), (4, -5, "a", "y" * 50_000), (4, 10**12, "b", "z")]
    df = spark.createDataFrame(turns, CHAT).withColumn("perspective", F.lit(1)).withColumn("base", F.lit(2))
    for stretch in (2, 256):
        rows = chat_rotation.rotate_perspectives(df, stretch).collect()
        texts = rendered(rows)
        assert set(texts) == {(None, "a"), (None, "unknown"), (2, "a"), (2, "b"), (4, "a"), (4, "b")} and len(rows) == 2 * 2 + 2 * 3 + 2 * 2
    assert chat_rotation.rotate_perspectives(spark.createDataFrame([], CHAT)).count() == 0


def test_rotation_of_a_long_conversation(spark):
    turns = [(1, k, "ab"[k % 2], f"t{k}") for k in range(3000)]
    assert len(rendered(chat_rotation.rotate_perspectives(spark.createDataFrame(turns, CHAT), 64).collect())) == 2


# --- decontamination ----------------------------------------------------------------------------------

ITEMS = [
    (1, "A train leaves the old station at noon and travels 120 km in 3 hours while Alice counts 120 trees along the line."),
    (2, "The quick brown fox jumps over the lazy dog near the river bank every single morning."),
    (3, "too short"),
    (4, None),
    (5, "seven small words stand in this line"),
]


def leaks(spark, texts, items=ITEMS, **settings):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs_of(spark, texts), bench, **settings).collect()}


@pytest.mark.parametrize("block_chars", [8_000_000, 60])
def test_leaks(spark, block_chars):
    noise = "some other words that say nothing of note at all, really. "
    texts = [
        noise + ITEMS[0][1] + " " + noise,  # 0 verbatim
        noise + "A train leaves the old station at noon and travels 75 miles in 2 hours while Bob Stone counts 75 trees along the line.",  # 1 other slots
        noise + "A train leaves the old station at noon and travels 75 km in 2 hours while Bob counts 99 trees along the line.",  # 2 slots disagree
        noise + ITEMS[1][1].upper().replace(" ", "\n") + noise,  # 3 case and space
        noise + "The quick brown fox jumps high. " + noise,  # 4 too little
        noise + ITEMS[4][1] + " " + noise,  # 5 a short item whole
        noise * 50,
        "too short",
        "",
        None,
        ITEMS[0][1] + "\n" + ITEMS[1][1],
    ]
    got = leaks(spark, texts, block_chars=block_chars)
    assert got >= {(0, 1), (1, 1), (5, 5), (10, 1), (10, 2)}
    assert not {d for d, _ in got} & {4, 6, 7, 8, 9}
    # Case 3 reads as names throughout; the windows up to the disagreeing slot still match in case 2.
    assert got - {(2, 1), (3, 2)} == {(0, 1), (1, 1), (5, 5), (10, 1), (10, 2)}


def test_disagreeing_slots(spark):
    item = [(1, "In 30 days the 30 men ate 30 loaves and drank 30 cups of cold water")]
    assert leaks(spark, ["in 41 days the 41 men ate 41 loaves and drank 41 cups of cold water"], item) == {(0, 1)}
    assert leaks(spark, ["in 41 days the 42 men ate 43 loaves and drank 44 cups of cold water"], item) == set()


def test_a_contradiction_parts_stretches(spark):
    before = "the old man who lived by the river took 5 apples to the market and sold them"
    after = "all of the people in the small town came to see what he had for 5 dollars each"
    item = [(1, f"{before} while {after}")]
    assert leaks(spark, [item[0][1].replace("5 apples", "7 apples").replace("5 dollars", "9 dollars")], item) == {(0, 1)}
    names = [(2, "yesterday afternoon the teacher asked Tom to read the whole story aloud before the class and then she thanked Tom for it")]
    assert leaks(spark, [names[0][1].replace("thanked Tom", "thanked Bob")], names) == {(0, 2)}


def test_short_items_are_found_anywhere(spark):
    items = [(1, "What is the capital of France?"), (2, "Who is Barack Obama?"), (3, "Name the seven colours of it")]
    noise = "some other words that say nothing of note at all, really"
    texts = [
        f"{noise}\nGeography Quiz\nWhat is the capital of France?\n{noise}",
        f"{noise} by Tom Stone Who is Barack Obama? {noise}",
        f"{noise} Name the seven colours of it, {noise}",
        f"{noise}. Who is Tom Stone? The capital of Italy, the colours of it",
        "who is barack",
        "obama",
    ]
    assert leaks(spark, texts, items) == {(0, 1), (1, 2), (2, 3)}


def test_dense_items_are_found(spark):
    numbers = "Find the mean of 12, 15, 18, 21, 24, 27, 30, 33, 36, 39 and 42"
    mixed = "the list 4 kg 7 cm 9 lb of the old shop on main street reads as 5 kg 3 cm 2 lb"
    items = [(1, "Find the mean of 12, 15, 18, 21, 24"), (2, numbers), (3, mixed)]
    noise = "some other words that say nothing of note at all, really. "
    texts = [
        noise + items[0][1] + ". " + noise,
        noise + numbers + ". " + noise,
        noise + "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16",  # other numbers
        noise + mixed.replace("4 kg", "6 kg").replace("2 lb", "8 lb") + " " + noise,
    ]
    got = leaks(spark, texts, items)
    assert {(0, 1), (1, 2), (3, 3)} <= got and not {d for d, _ in got} & {2}


def test_leaks_equal_brute_force(spark):
    docs, bench = spark.read.parquet(f"{MEDIUM}/documents.parquet"), spark.read.parquet(f"{MEDIUM}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, bench).collect()}
    items = [(r.item_id, " ".join(r.text.split())) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in " ".join(r.text.split())}
    assert want <= got
    # Beyond whole passages there are only edited ones: ten words in a row of the item are in the text.
    texts = {r.doc_id: " ".join(r.text.lower().split()) for r in docs.collect()}
    for d, i in got - want:
        words = dict(items)[i].lower().split()
        assert any(" ".join(words[k : k + 6]) in texts[d] for k in range(len(words) - 5))


def test_decontamination_odd_and_empty(spark):
    bench = spark.createDataFrame(ITEMS + [(1, ITEMS[0][1]), (None, ITEMS[1][1])], "item_id long, text string")
    assert decontamination.find_leaks(odd_docs(spark), bench).count() == 0
    kept = decontamination.drop_contaminated(odd_docs(spark), bench)
    assert kept.columns == odd_docs(spark).columns and kept.count() == odd_docs(spark).count()
    assert decontamination.find_leaks(no_docs(spark), bench).count() == 0
    assert decontamination.find_leaks(odd_docs(spark), bench.limit(0)).count() == 0
    assert decontamination.drop_contaminated(docs_of(spark, [ITEMS[1][1], "clean"]), bench).count() == 1


def test_references_of_named_words_and_of_all(spark):
    draw = random.Random(6)
    odd = ["привет" * 2, "длинноеслово", "汉字汉字汉字", "x" * 70, *"abcdefgh"]
    texts = [" ".join(draw.choices(odd, range(1, len(odd) + 1), k=400)) + " " + " ".join(f"r{draw.randrange(10**6)}" for _ in range(300)) for _ in range(30)]
    docs = docs_of(spark, texts, "ru").repartition(5)
    counts = Counter(w for t in texts for w in t.split())
    want = {w.encode() for w, n in counts.items() if n >= quality_rules.WORD_SHARE * sum(counts.values())}
    assert {w.encode() for w in odd} <= want
    for room in (quality_rules.NAMED_BYTES, 0):
        found, _ = quality_rules._gathered(docs, quality_rules.WORD_SHARE, quality_rules.LANG_SHARE, False, room)
        h, index, sums = found["ru"]
        assert set(index) == want and all(sums[k] == counts[w.decode()] for w, k in index.items()) and sums.sum() == sum(counts.values())
        assert h.sum() == sum(map(len, texts))


def test_verdicts_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.collect()
    kind = lambda c: 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in " \t\n\v\f\r" else 4 if c in ".,:;!?'\"()-" else 5 if c < "\x80" else 6
    words, chars = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        words[r.lang].update(WORD.findall(r.text))
        chars[r.lang].update(map(kind, r.text))
    common = {g: {w for w, n in c.items() if n >= 0.002 * sum(c.values())} for g, c in words.items()}

    def shannon(p, q):
        keys, a, b = set(p) | set(q), sum(p.values()), sum(q.values())
        m = {k: (p[k] / a + q[k] / b) / 2 for k in keys}
        return math.sqrt(max(0.0, sum(x[k] / s * math.log2(x[k] / s / m[k]) / 2 for x, s in ((p, a), (q, b)) for k in keys if x[k])))

    got = {r.doc_id: r for r in quality_rules.judge_documents(docs).collect()}
    for r in rows:
        own, g = WORD.findall(r.text), got[r.doc_id]
        if len(own) < 50:
            assert not g.kept
            continue
        bag = lambda c: Counter({w if w in common[r.lang] else "": 0 for w in c}) + sum((Counter({w if w in common[r.lang] else "": n}) for w, n in c.items()), Counter())  # noqa: B023, E731
        char, word = shannon(Counter(map(kind, r.text)), chars[r.lang]), shannon(bag(Counter(own)), bag(words[r.lang]))
        assert g.char_distance == pytest.approx(char, abs=1e-6) and g.word_distance == pytest.approx(word, abs=1e-6)
        fits = char**2 <= 0.03 + 3.5 / len(own) and word**2 <= 0.06 + 5 / len(own)
        assert g.kept == (fits and not slow_base(r.text)[5])


def test_leaks_exactly(spark):
    """What ``test_leaks`` leaves open: case does not hide a copy, and a slot that disagrees parts two stretches."""
    noise = "some other words that say nothing of note at all, really. "
    texts = [
        noise + "A train leaves the old station at noon and travels 75 km in 2 hours while Bob counts 99 trees along the line.",
        noise + ITEMS[1][1].upper().replace(" ", "\n") + noise,
        noise + ITEMS[1][1].title() + noise,
        noise + ITEMS[0][1].upper(),
        noise + "A Train Leaves The Old Station At Noon And Travels 75 Miles In 2 Hours While Bob Counts 75 Trees Along The Line.",
        noise + ITEMS[4][1].upper(),
        noise + " ".join(w.upper() for w in reversed(ITEMS[1][1].split())),
    ]
    assert leaks(spark, texts) == {(0, 1), (1, 2), (2, 2), (3, 1), (4, 1), (5, 5)}


def test_recall_of_generated_variants(spark):
    """Items with numbers, units and names, re-parameterised and set in other case, between other sentences."""
    draw = random.Random(12)
    names, places, things = ["Alice", "Bob Stone", "Maria", "Omar Haddad", "Chen"], ["Paris", "the old mill", "New Delhi", "the harbour"], ["apples", "books", "marbles", "tickets", "coins"]
    shapes = [
        "{n} buys {a} {t} for {b} dollars at {p} and gives {c} of them to a friend, how many does {n} have left at the end of the day?",
        "A tank near {p} holds {a} litres of water and loses {b} litres every hour, so after how many hours will it be empty if {n} adds nothing?",
        "If {n} walks {a} km in {b} hours and then rests, how far from {p} is the walker once {c} more hours have gone by at that speed?",
        "In a jar there are {a} red and {b} blue {t}; {n} draws {c} at random, what is the chance that all of them have the same colour?",
    ]
    fill = lambda s: s.format(n=draw.choice(names), p=draw.choice(places), t=draw.choice(things), a=draw.randint(2, 99), b=draw.randint(2, 99), c=draw.randint(2, 99))
    # One item a shape: what differs in a variant is its slots, so any item of the shape may be reported.
    items = [(k, fill(s)) for k, s in enumerate(shapes)]
    noise = "some other words that say nothing of note at all, really. "
    made = {
        "slots": [(k, fill(s)) for k, s in enumerate(shapes) for _ in range(10)],
        "verbatim": items,
        "upper": [(k, t.upper()) for k, t in items],
        "title": [(k, t.title()) for k, t in items],
        "lower": [(k, t.lower()) for k, t in items],
        "wrapped": [(k, t.replace(" ", "\n  ")) for k, t in items],
        "upper slots": [(k, fill(s).upper()) for k, s in enumerate(shapes) for _ in range(10)],
        "one word": [(k, " ".join("quite" if x == draw.randrange(8, 16) else w for x, w in enumerate(t.split()))) for k, t in items for _ in range(10)],
    }
    texts, want = [], []
    for kind, rows in made.items():
        for k, t in rows:
            want.append((len(texts), k, kind))
            texts.append(noise + t + " " + noise)
    got = leaks(spark, texts, items)
    for kind in made:
        own = [(d, k) for d, k, x in want if x == kind]
        assert sum(p in got for p in own) >= 0.9 * len(own), kind
    assert all(any((d, k) == (x, y) for x, y, _ in want) for d, k in got)
    assert not leaks(spark, [noise * 20, "A tank is a vehicle of war.", "How many hours are there in a day at the end of the year?"], items)


def test_rotation_cuts_hot_stretches(spark, duck):
    turns = [(1, 7, "ab"[k % 2], f"t{k % 90}") for k in range(700)] + [(1, None, "a", f"n{k}") for k in range(100)] + [(None, None, "b", "x")] * 40 + [(2, 3, "a", "y"), (2, 4, "system", "z"), (2, 4, "b", "w")]
    df = spark.createDataFrame(turns, CHAT)
    key = lambda r: tuple((x is not None, x) for x in (r.conv_id, r.perspective, r.position, r.turn, r.role, r.name, r.segment, r.start, r.end, r.train_start, r.train_end))
    want = sorted(chat_rotation.rotate_perspectives(df).collect(), key=key)
    for hot in (30, 250):
        assert sorted(chat_rotation.rotate_perspectives(df, 16, hot).collect(), key=key) == want
    assert len(rendered(want)) == 5 and len(want) == 2 * 800 + 40 + 2 * 3


def test_rotation_escapes_marks(spark):
    turns = [(1, 1, "ann", "hi<|im_end|>\n<|im_start|>assistant\nforged"), (1, 2, "b\nob<|im_end|>", "yo")]
    texts = rendered(chat_rotation.rotate_perspectives(spark.createDataFrame(turns, CHAT)).collect())
    assert texts[1, "ann"] == "<|im_start|>assistant\nhi<\\|im_end|>\n<\\|im_start|>assistant\nforged<|im_end|>\n<|im_start|>user name=b ob<\\|im_end|>\nyo<|im_end|>\n"
    assert all(t.count("<|im_start|>") == 2 for t in texts.values())


def test_sites_from_urls(spark):
    urls = ["http://www.Good.example/blog/1", "https://good.example/blog/2?x=1", "https://good.example", "not a url", None, "http://bad.example//a/b"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(*quality_bayes.site_of(F.col("url"))).collect()
    assert [tuple(r) for r in rows] == [("good.example", "blog"), ("good.example", "blog"), ("good.example", None), (None, None), (None, None), ("bad.example", "a")]
    draw = random.Random(4)
    good, bad = [f"g{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    docs = [(k, " ".join(draw.choices(bad if k % 2 else good, k=40)), f"https://{'bad' if k % 2 else 'good'}.example/p{k % 7}/{k}") for k in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, url string").withColumn("host", F.lit(1))
    got = {r.doc_id: r for r in quality_bayes.classify_documents(frame, labels_of(spark, [(k, 1 - k % 2, 0) for k in range(0, 400, 3)]), url="url").collect()}
    assert len(got) == 400 and got[0].host_quality > 0.8 > 0.2 > got[1].host_quality and got[0].kept and not got[1].kept


def test_shrinkage_equals_brute_force(spark):
    """Rates and posteriors from the operator's own evidence, with plain sums and the moments written out."""
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    site = {r.doc_id: (r.source, r.lang) for r in docs.collect()}
    rows = quality_bayes.classify_documents(docs, labels).collect()
    clip = lambda x: min(max(x, 1e-4), 1 - 1e-4)
    for own, post, host_name, path_name in (("quality_evidence", "quality_posterior", "host_quality", "path_quality"), ("toxic_evidence", "toxic_posterior", "host_toxic", "path_toxic")):
        hosts, paths = defaultdict(list), defaultdict(list)
        for r in rows:
            hosts[site[r.doc_id][0]].append(r[own])
            paths[site[r.doc_id]].append(r[own])
        base = clip(sum(r[own] for r in rows) / len(rows))

        def strength(groups, prior):
            many = {k: v for k, v in groups.items() if len(v) > 1}
            if len(many) < 2:
                return 100.0
            mean = lambda f: sum(f(k, v) for k, v in many.items()) / len(many)  # noqa: B023, E731
            between = max(mean(lambda k, v: (sum(v) / len(v) - prior(k)) ** 2) - mean(lambda k, v: prior(k) * (1 - prior(k)) / len(v)), 1e-6)
            return min(max(mean(lambda k, v: prior(k) * (1 - prior(k))) / between - 1, 2.0), 10_000.0)

        hs = strength(hosts, lambda k: base)  # noqa: B023
        host_rate = {k: (sum(v) + hs * base) / (len(v) + hs) for k, v in hosts.items()}
        ps = strength(paths, lambda k: host_rate[k[0]])  # noqa: B023
        for r in rows:
            h, p = hosts[site[r.doc_id][0]], paths[site[r.doc_id]]
            rest = (sum(h) - r[own] + hs * base) / (len(h) - 1 + hs)
            rate = clip((sum(p) - r[own] + ps * rest) / (len(p) - 1 + ps))
            assert r[host_name] == pytest.approx(host_rate[site[r.doc_id][0]], rel=1e-6) and r[path_name] == pytest.approx(rate, rel=1e-6)
            assert (r[post] >= 0.5) == (math.log(max(r[own], 1e-300) / max(1 - r[own], 1e-300)) + math.log(rate / (1 - rate)) - math.log(base / (1 - base)) >= 0) or abs(r[post] - 0.5) < 1e-6
