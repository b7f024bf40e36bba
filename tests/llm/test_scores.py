"""Scores and proximity matches against reckonings one by one."""

import collections
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import xxhash

from quelora.llm import decontaminate, langid, pieces, quality


def forward(word, prob, number, longest):
    """Sum over all segmentations, from the left."""
    sums = [1.0] + [0.0] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - longest), end):
            if word[start:end] in number:
                sums[end] += sums[start] * prob[number[word[start:end]]]
        if word[end - 1] not in number:
            sums[end] += sums[end - 1] * math.exp(langid.UNKNOWN)
    return sums[-1]


def test_language_scores_are_posteriors():
    path = pieces.model_path()
    vocab = pieces.vocabulary(path)
    number = {t: k for k, t in enumerate(sorted(vocab.ids))}
    prob = np.random.default_rng(2).random((len(number), 3)) * 1e-4
    prior = np.array([0.5, 0.3, 0.2])
    texts = ["the house", "der Hund läuft", "漢字 x", "nation " * 5, None, "", "12 34 !", "a" * (langid.LONG_WORD + 40)]
    langs, scores = langid.Scorer(langid.Model(["a", "b", "c"], prior, prob, path)).predict(texts)
    for text, lang, score in zip(texts, langs, scores, strict=True):
        if not text or not any(c.isalpha() for c in text):
            assert (lang, score) == (langid.UND, 0.0)
            continue
        words = [w[k : k + langid.LONG_WORD] for w in text.split() for k in range(0, len(w), langid.LONG_WORD)]
        logs = []
        for k in range(3):
            total = math.log(prior[k])
            for w in words:  # long words underflow as one product
                parts = [" " + w] if len(w) < 100 else None
                total += sum(math.log(forward(p, prob[:, k], number, vocab.longest)) for p in parts) if parts else _long_forward(" " + w, prob[:, k], number, vocab.longest)
            logs.append(total)
        top = int(np.argmax(logs))
        assert lang == "abc"[top]
        assert math.isclose(score, 1 / sum(math.exp(x - logs[top]) for x in logs), rel_tol=1e-6)


def _long_forward(word, prob, number, longest):
    sums = [0.0] + [-math.inf] * len(word)
    for end in range(1, len(word) + 1):
        terms = [sums[s] + math.log(prob[number[word[s:end]]]) for s in range(max(0, end - longest), end) if word[s:end] in number]
        if word[end - 1] not in number:
            terms.append(sums[end - 1] + langid.UNKNOWN)
        top = max(terms)
        sums[end] = top + math.log(sum(math.exp(t - top) for t in terms))
    return sums[-1]


def buckets(text):
    """Buckets of unigrams and bigrams, with whole numbers."""
    wide = (1 << 64) - 1
    ones = [xxhash.xxh64_intdigest(w.lower(), 7) for w in (text or "").encode().split()]
    twos = [((a * 0x9E3779B97F4A7C15) & wide) ^ ((b + 0x165667B19E3779F9) & wide) for a, b in itertools.pairwise(ones)]
    return [((x * 0xC2B2AE3D27D4EB4F) & wide) >> 48 for x in ones + twos]


def test_quality_scores_and_verdicts(spark):
    rng = random.Random(4)
    good, bad = ([f"{p}{k}" for k in range(30)] for p in "gb")
    texts = [" ".join(rng.choices(good if k % 2 else bad, k=rng.randrange(15, 60))) for k in range(120)] + [None, "", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, int(k % 10 == 1)) for k in range(100)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    half = {r["doc_id"]: r["h"] for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id), 2) h").collect()}
    raw = collections.Counter(b for t in texts for b in buckets(t))
    target = collections.Counter(b for k, t in enumerate(texts) if k < 100 and k % 2 and k % 10 != 1 and half[k] == 0 for b in buckets(t))
    smooth = lambda c, b: math.log((c[b] + 1) / (sum(c.values()) + quality.BUCKETS))
    kept = []
    for r in quality.quality(docs, model).collect():
        found = buckets(texts[r["id"]])
        score = sum(smooth(target, b) - smooth(raw, b) for b in found) / len(found) if found else 0.0
        assert math.isclose(r["score"], score, rel_tol=1e-4, abs_tol=1e-5)
        assert r["kept"] == (not r["base_failed"] and r["score"] >= model.threshold)
        kept.append((r["id"] % 2, r["kept"], r["base_failed"]))
    assert all(k == bool(odd) for odd, k, failed in kept if not failed)


def reckoned_threshold(good, bad):
    """The best cut by trying all."""
    scores = sorted({*good, *bad})
    gains = [sum(x < s for x in bad) * len(good) - sum(x < s for x in good) * len(bad) for s in scores]
    k = gains.index(max(gains))
    return (scores[k - 1] + scores[k]) / 2 if k else scores[0] - 1


def test_quality_threshold_takes_all_labels(spark):
    """More labelled documents than the bound there was: the cut is that of all of them, none left out."""
    rng = np.random.default_rng(6)
    n = 44_000
    words = np.array([f"w{k}" for k in range(40)])
    picks = np.where(np.arange(n)[:, None] % 2, rng.triangular(0, 26, 40, (n, 20)), rng.triangular(0, 14, 40, (n, 20))).astype(int)
    table = pa.table({"doc_id": np.arange(n), "text": [" ".join(words[p]) for p in picks]})
    docs = spark.createDataFrame(table).repartition(4)
    labels = spark.createDataFrame(pa.table({"doc_id": np.arange(n), "quality": np.arange(n) % 2, "toxic": np.zeros(n, dtype=np.int64)}))
    model = quality.fit(docs, labels)
    scored = quality.quality(docs, model).selectExpr("id % 2 = 1 trusted", "pmod(xxhash64(id), 2) half", "score").toArrow().to_pandas()
    good = scored[scored.trusted & (scored.half == 1)].score.to_numpy()
    bad = scored[~scored.trusted].score.to_numpy()
    assert len(good) > 10_000 and len(bad) == n / 2
    cuts = np.unique(np.concatenate((good, bad)))
    gains = np.searchsorted(np.sort(bad), cuts) * len(good) - np.searchsorted(np.sort(good), cuts) * len(bad)
    k = int(np.argmax(gains))
    assert k and model.threshold == (cuts[k - 1] + cuts[k]) / 2


def test_quality_threshold_by_ranges(spark):
    """Ranges and batches of any cut give the cut of the whole, equal scores and equal gains among them."""
    rng = random.Random(9)
    for size, values in ((2, 2), (9, 4), (40, 12), (300, 1_000), (400, 30)):
        rows = [(k < 2 and k == 0 or k > 1 and rng.random() < 0.5, rng.randrange(values) / 8 - 1) for k in range(size)]
        good, bad = ([x for t, x in rows if t is kind] for kind in (True, False))
        expected = reckoned_threshold(good, bad)
        assert quality.best_threshold(np.array(good), np.array(bad)) == expected
        assert quality.threshold_of(spark.createDataFrame(rows, "trusted boolean, score double").repartition(3)) == expected
        scores = sorted({*good, *bad})
        parts = [(np.array([x]), np.array([good.count(x)]), np.array([bad.count(x)])) for x in scores]
        for wide in (1, 3, len(parts)):
            ranges = [quality.best_cut(iter(parts[k : k + wide]), len(good), len(bad)) for k in range(0, len(parts), wide)]
            rng.shuffle(ranges)
            assert quality.cut_of(ranges, len(good), len(bad)) == expected
    assert quality.threshold_of(spark.createDataFrame([(True, 1.0)], "trusted boolean, score double")) == quality.FALLBACK
    assert quality.threshold_of(spark.createDataFrame([], "trusted boolean, score double")) == quality.FALLBACK


def test_proximity_hits(spark):
    """A document is hit if some run of its words, as long as the window and the slop, holds all words of the window."""
    rng = random.Random(5)
    docs = [" ".join(rng.choices("abcdefg", k=rng.randrange(1, 25))) for _ in range(60)] + [None, ""]
    items = [" ".join(rng.choices("abcdefg", k=rng.randrange(1, 6))) for _ in range(8)]
    index = decontaminate.build_index(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))
    tests = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for slop in (0, 2):
        found = {r["id"]: r["items"] for r in decontaminate.search(index, tests, window=4, slop=slop).collect()}
        for k, text in enumerate(docs):
            words, expected = (text or "").split(), set()
            for i, item in enumerate(items):
                w = item.split()
                size = min(4, len(w))
                for a in range(len(w) - size + 1):
                    need = collections.Counter(w[a : a + size])
                    if any(not need - collections.Counter(words[s : s + size + slop]) for s in range(len(words))):
                        expected.add(str(i))
            assert found[k] == sorted(expected)
