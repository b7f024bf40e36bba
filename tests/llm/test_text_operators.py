"""The operators on texts against brute force, on small tables with nulls, ties, repeated rows and odd texts."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quelora.llm import decontaminate, encode, langid, lines, lm, pieces, quality, simhash

LONG = "lorem ipsum dolor sit amet " * 3000
TEXTS = [None, "", "   \n\t", "a", "one two three four five six seven eight nine ten eleven", "one two three four five six seven eight nine ten eleven", LONG, "çé ñ 漢字 😀", "x\x00y ▁z"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, score double, bucket string"


def table(spark, texts, lang="en"):
    rows = [(k if k != 3 else None, t, None if k == 1 else lang, None, None, "clash", 1.0, "b") for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1]], SCHEMA)


def words(text, pattern=r"[^\x20\x09-\x0D]+", lower=True):
    text = text or ""
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


# --- decontamination ------------------------------------------------------------------------------------------------


def brute_hits(doc, items, n=10):
    w = words(doc, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    hit, found = set(), set()
    for item, text in items:
        v = words(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        size = min(n, len(v))
        wins = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if size else set()
        for k in range(len(w) - size + 1 if size else 0):
            if tuple(w[k : k + size]) in wins:
                hit |= set(range(k, k + size))
                found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("pass_words", [500_000, 15])
def test_decontamination(spark, monkeypatch, pass_words):
    monkeypatch.setattr(decontaminate, "PASS_WORDS", pass_words)
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 600)
    rng = random.Random(3)
    vocabulary = ["a", "B", "c", "d,", "é"]
    docs = TEXTS + [" ".join(rng.choices(vocabulary, k=rng.randrange(60))) for _ in range(60)]
    items = [(k if k else None, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 6, 14])))) for k in range(9)] + [(2, None), (100, TEXTS[4]), (100, TEXTS[4])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    keyed = table(spark, docs).selectExpr("*", "row_number() over (order by doc_id, text) as place").drop("doc_id").withColumnRenamed("place", "doc_id")
    given = {r["doc_id"]: r["text"] for r in keyed.collect()}
    found = decontaminate.decontaminate(keyed, bench).collect()
    assert len(found) == len(docs) + 1
    for r in found:
        n, hit, ids = brute_hits(given[r["id"]], items)
        assert (r["n_words"], r["n_hit"], sorted(r["items"])) == (n, hit, ids)
        assert sum(s["stop"] - s["start"] for s in r["spans"]) >= hit if pass_words == 15 else sum(s["stop"] - s["start"] for s in r["spans"]) == hit


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "the cat x sat on mat"), (2, "mat on sat cat the"), (3, "the cat far away from all that we have sat on a mat"), (4, "the cat sat on mat mat")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "the cat sat on mat")], "item_id long, text string")
    index = decontaminate.build_index(docs)
    near = {r["id"]: r["n_hit"] for r in decontaminate.search(index, bench, slop=1).collect()}
    assert near == {1: 6, 2: 5, 3: 0, 4: 5}
    assert {r["id"]: r["n_hit"] for r in decontaminate.search(index, bench).collect()} == {1: 0, 2: 0, 3: 0, 4: 5}


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(none, bench).count() == 0
    found = decontaminate.decontaminate(table(spark, TEXTS), bench).collect()
    assert len(found) == len(TEXTS) + 1 and all(r["n_hit"] == 0 for r in found)


# --- SimHash --------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = words(text)
    runs = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(pairs):
    """Least id reachable from each row, by all pairs."""
    root = list(range(len(pairs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, j in itertools.combinations(range(len(pairs)), 2):
        if bin(pairs[i][1] ^ pairs[j][1]).count("1") <= 2:
            root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(pairs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(pairs))]


def test_simhash_of_texts(spark):
    docs = table(spark, TEXTS)
    pairs = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
    expected = sorted((str(i), format(f, "016x"), str(c)) for (i, f), c in zip(pairs, brute_components(pairs), strict=True))
    assert sorted((str(r["id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.near_duplicates(docs).collect()) == expected


@pytest.mark.parametrize("bucket", [2048, 64])
def test_simhash_links(spark, monkeypatch, bucket):
    """Clusters of distinct fingerprints; one is hot enough that buckets of 64 are cut again and again."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(5)
    fps = []
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(25):
            fps.append(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))))
        chain = centre
        for _ in range(5):
            chain ^= sum(1 << b for b in rng.sample(range(64), 2))
            fps.append(chain)
    fps += [rng.getrandbits(64) for _ in range(60)]
    hot = rng.getrandbits(64)
    fps += [hot ^ sum(1 << b for b in rng.sample(range(24), rng.choice([0, 1, 2, 3, 8]))) for _ in range(250)]
    pairs = [(k, f) for k, f in enumerate(dict.fromkeys(fps))]
    df = spark.createDataFrame([(k, f - (f >> 63 << 64)) for k, f in pairs], "id long, fp long")
    parts = {r["fp"]: r["component_id"] for r in simhash.components(df).collect()}
    assert [parts[f - (f >> 63 << 64)] for _, f in pairs] == brute_components(pairs)


def test_simhash_keeps_one_of_each(spark):
    docs = table(spark, TEXTS)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    assert len(texts) == len({tuple(words(t)) for t in TEXTS}) == len({tuple(words(t)) for t in texts})
    assert simhash.one_of_each(docs.limit(0)).count() == 0


# --- language -------------------------------------------------------------------------------------------------------


def brute_forward(word, prob, number, longest):
    if not word:
        return 1.0
    total = sum(prob[number[word[:k]]] * brute_forward(word[k:], prob, number, longest) for k in range(1, min(len(word), longest) + 1) if word[:k] in number)
    return total + (math.exp(langid.UNKNOWN) * brute_forward(word[1:], prob, number, longest) if word[0] not in number else 0.0)


def test_forward_sums_all_segmentations():
    path = pieces.model_path()
    at, vocab = langid.pieces(path), pieces.vocabulary(path)
    number = {t: k for k, t in enumerate(sorted(vocab.ids))}
    prob = np.vstack((np.random.default_rng(1).random((at.size, 2)) * 1e-4, np.zeros((1, 2))))
    tests = [" a", " the", " Tion", " 🙂x", " hello", " zzzq", " üßen"]
    lens, found = at.matches(tests)
    logs = at.forward(lens, found, prob)
    for k, w in enumerate(tests):
        for lang in (0, 1):
            assert math.isclose(logs[k, lang], math.log(brute_forward(w, prob[:, lang], number, vocab.longest)), rel_tol=1e-9)
    counts = np.array([[2.0, 1.0]] * len(tests))
    expected = langid.expected_counts(tests_without_mark := [t[1:] for t in tests], counts, at, prob)
    assert len(tests_without_mark) == len(tests)
    for piece in ("he", " t", "zz"):  # the derivative of the log-likelihood is the expected count
        more = prob.copy()
        more[number[piece]] *= 1 + 1e-5
        slope = (counts * (at.forward(lens, found, more) - logs)).sum(axis=0) / 1e-5
        assert np.allclose(expected[number[piece]], slope, rtol=1e-3, atol=1e-6)


def test_long_words_do_not_vanish():
    at = langid.pieces(pieces.model_path())
    prob = np.vstack((at.prior[:, None], [[0.0]]))
    lens, found = at.matches([" " + "xq漢" * 400])
    assert np.isfinite(at.forward(lens, found, prob)).all()


def test_language_prediction(spark):
    rng = random.Random(1)
    make = {"en": ["the", "house", "with", "over", "thing"], "de": ["der", "haus", "und", "mit", "über"], "fr": ["le", "maison", "avec", "où", "çà"]}
    rows = [(k, " ".join(rng.choices(make[lang], k=30)), lang) for k, lang in enumerate(["en", "de", "fr"] * 40)]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "123 !?", "fr"), (1003, "unlabelled house over", None), (None, "die maus und das haus", None), (1004, "word" * 20_000, None)]
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    from pyspark.sql import functions as F

    model = langid.fit(docs, langid.fold() != 1)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs.drop("lang"), model).collect()}
    assert all(found[k] == ("und", 0.0) for k in (1000, 1001, 1002))
    assert all(found[k][0] == lang and 0.5 < found[k][1] <= 1 for k, _, lang in rows[:120])
    assert found[1003][0] == "en" and found[None][0] == "de" and found[1004][0] in make
    nothing = langid.fit(docs, F.lit(False))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


# --- quality --------------------------------------------------------------------------------------------------------


def brute_base(text):
    w = words(text, lower=False)
    runs = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    marked = [0] * len(w)
    for k in range(len(w) - 7):
        if runs[tuple(w[k : k + 8])] > 1:
            marked[k : k + 8] = [1] * 8
    seen, dup = set(), 0
    for x in (text or "").split("\n"):
        if words(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, sum(marked)


def test_quality_base(spark):
    rng = random.Random(2)
    docs = TEXTS[:6] + ["a b\na b\n\n#c|d\na b", LONG[:400], *(" ".join(rng.choices("ab", k=rng.randrange(60))) + "\n" + rng.choice(["", "x y", "é$"]) for _ in range(40))]
    df = table(spark, docs).selectExpr("*", "row_number() over (order by doc_id, text) as place").drop("doc_id").withColumnRenamed("place", "doc_id")
    given = {r["doc_id"]: r["text"] for r in df.collect()}
    model = quality.Model(quality.log_ratio(np.zeros(quality.BUCKETS), np.ones(quality.BUCKETS)))
    for r in quality.quality(df, model).collect():
        base = brute_base(given[r["id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        assert r["base_failed"] == failed and r["kept"] == (not failed)


def test_quality_tells_good_from_bad(spark):
    rng = random.Random(7)
    good, bad = [f"w{k}" for k in range(50)], [f"v{k}" for k in range(50)]
    rows = [(k, " ".join(rng.choices(bad if k % 3 == 0 else good, k=60))) for k in range(300)] + [(500, None), (501, "w1"), (500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(300)] + [(None, 1, 0), (7, 1, None), (8, None, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    kept = {r["id"]: r["kept"] for r in quality.quality(docs, model).collect()}
    assert all(kept[k] == (k % 3 != 0) for k in range(300)) and not kept[500] and not kept[501]
    empty = quality.fit(docs, labels.limit(0))
    assert empty.threshold == quality.FALLBACK and not empty.ratio.any()


def test_threshold():
    assert quality.best_threshold(np.array([3.0, 4.0]), np.array([0.0, 1.0])) == 2.0
    assert quality.best_threshold(np.array([]), np.array([1.0])) == quality.FALLBACK


# --- lines ----------------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, text, n, alphabet="abc"):
    t = list(text)
    for _ in range(n):
        k = rng.randrange(len(t) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            t.insert(k, rng.choice(alphabet))
        elif k < len(t):
            t[k : k + 1] = [rng.choice(alphabet)] if kind == 1 else []
    return "".join(t)


def test_edit_distance_and_segments():
    rng = random.Random(9)
    for _ in range(8000):
        a = "".join(rng.choices("ab", k=rng.randrange(16)))
        b = edited(rng, a, rng.randrange(5))
        for k in (1, 2, 3):
            assert lines.within(a, b, k) == (distance(a, b) <= k)
        if min(len(a), len(b)) > 2 and distance(a, b) <= 2:
            longer, shorter = sorted((a, b), key=len, reverse=True)
            assert {s[0] for s in lines.signatures(longer, 0, 2)} & {s[0] for s in lines.signatures(shorter, 0, 2) if s[1]}


def test_short_variants_link_exactly_what_is_near():
    rng = random.Random(4)
    for _ in range(6000):
        a = "".join(rng.choices("abc", k=rng.randrange(8)))
        b = edited(rng, a, rng.randrange(5)) if rng.random() < 0.8 else "".join(rng.choices("abc", k=rng.randrange(8)))
        for edits in (1, 2):
            x, y = dict(lines.neighbours(a, edits)), dict(lines.neighbours(b, edits))
            assert any(x[k] or y[k] for k in set(x) & set(y)) == (distance(a, b) <= edits)


@pytest.mark.parametrize("bucket", [1024, 2])
def test_lines(spark, monkeypatch, bucket):
    monkeypatch.setattr(lines, "BUCKET", bucket)
    rng = random.Random(8)
    bases = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(9)) for _ in range(5)]
    pool = [edited(rng, b, rng.randrange(3), "xyz") for b in bases for _ in range(6)] + bases + ["as a.", "as b.", "one two three", "}", "a line of twenty-five ch.", "a line of twenty five ch.", "a lane of twenty five ch.", "\x00 \x00 \x00", ""]
    rows = [(k, "\n".join(rng.choices(pool, k=rng.randrange(1, 8)))) for k in range(25)] + [(90, None), (91, ""), (None, bases[0]), (4, "as a.\nas a.")]
    rows.append(rows[0])
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, drop string, a int").withColumn("__doc", F.lit("d"))
    # brute force: classes of lines by reachability, then the first of each in document order
    order = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    all_lines = sorted({x for _, t in order for x in t.split("\n") if x.strip()})
    root = {x: x for x in all_lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(all_lines, 2):
        if distance(a, b) <= min(2, min(len(a), len(b)) // 20):
            root[find(a)] = find(b)
    taken, expected = set(), {}
    keys = {r["doc_id"]: r["h"] for r in docs.selectExpr("doc_id", "xxhash64(doc_id, text) h").collect()}
    hashes = {(i, t): h for (i, t), h in zip(rows, [r["h"] for r in docs.selectExpr("xxhash64(doc_id, text) h").collect()], strict=True)}
    assert keys
    for i, t in sorted(order, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r])):
        drops = []
        for k, x in enumerate(t.split("\n") if t else []):
            if x.strip():
                if find(x) in taken:
                    drops.append(k)
                taken.add(find(x))
        expected[i, t] = drops
    report = lines.line_report(docs).collect()
    left = sorted((str(r["id"]), r["n_lines"], r["dropped"]) for r in report)
    right = sorted((str(i), len(t.split("\n")) if t else 0, expected.get((i, t), [])) for i, t in rows)
    assert left == right
    stay = {(str(r["id"]), c["no"], c["class_id"]) for r in report for c in r["classes"] if c["no"] not in r["dropped"]}
    for r in report:  # what is deleted names the line of its class that stays
        of = {c["no"]: c["class_id"] for c in r["classes"]}
        assert {(str(k["id"]), k["no"], of[n]) for n, k in zip(r["dropped"], r["kept"], strict=True)} <= stay
    clean = lines.dedup_lines(docs)
    assert clean.columns == docs.columns and {(r["drop"], r["a"], r["__doc"]) for r in clean.collect()} == {("a", 1, "d")}
    texts = sorted((str(r["doc_id"]), str(r["text"])) for r in clean.collect())
    assert texts == sorted((str(i), str("\n".join(x for k, x in enumerate(t.split("\n")) if k not in expected[i, t]) if t is not None else None)) for i, t in rows)


def test_no_lines(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lines.line_report(none).count() == 0 and lines.dedup_lines(none).count() == 0


# --- encoding -------------------------------------------------------------------------------------------------------


def test_viterbi_is_the_best_segmentation():
    vocab = pieces.vocabulary(pieces.model_path())
    words_ = [" the", " then", " thenx", " a", " nation", " zzq", "\nab", " é漢", " ▁x"]

    def best(word):
        if not word:
            return 0.0
        found = [vocab.logp[vocab.ids[word[:k]]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in vocab.ids]
        if word[0] not in vocab.ids:
            found.append(sum(vocab.logp[vocab.byte_ids[b]] for b in word[0].encode()) + best(word[1:]))
        return max(found)

    for word, ids in encode.viterbi(words_, vocab).items():
        assert math.isclose(sum(vocab.logp[i] for i in ids), best(word), rel_tol=1e-12)
    for text in ("a  b", "  a", "a\n   b ", "x     y", "\n\n  "):  # whole texts: runs of spaces are pieces
        marked = " " + text
        assert "".join(encode.parts(text)) == marked
        found = [i for p in encode.parts(text) for i in encode.viterbi([p], vocab)[p]]
        assert math.isclose(sum(vocab.logp[i] for i in found), best(marked), rel_tol=1e-12)


def test_encoding_round_trip(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    docs = table(spark, [*TEXTS, "Hello  world\nfoo ▁x ", "\n\n", " lead", "a\x00\nb c"])
    back = encode.round_trip(docs)
    assert back.where("NOT round_trip").count() == 0
    coded = encode.encode(docs)
    for r in coded.collect():
        if r["text"] is None:
            assert r["piece_ids"] is None and r["n_pieces"] is None
        else:
            assert library.decode(r["piece_ids"]) == r["text"] and r["n_pieces"] == len(r["piece_ids"])
            assert r["ids_crc32"] == zlib.crc32(np.array(r["piece_ids"], "<u4").tobytes())
    assert encode.encode(docs.limit(0)).count() == 0


# --- language model -------------------------------------------------------------------------------------------------


@pytest.fixture
def small_lm(monkeypatch):
    for name, value in {"FREQUENT": 4, "ENDINGS": 8, "ROUNDS": 6, "BLOCKS": 3}.items():
        monkeypatch.setattr(lm, name, value)


@pytest.mark.parametrize("top", [250_000, 5])
def test_lm_scores(spark, monkeypatch, small_lm, top):
    """All columns against sums over the tokens, one by one, from the counts and the model's parameters."""
    monkeypatch.setattr(lm, "TOP", top)
    rng = random.Random(6)
    texts = [None, "", *(" ".join(rng.choices(["a", "B", "c", "d", "e", "rare%d" % rng.randrange(40)], k=rng.randrange(30))) for _ in range(80))]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, "null id", 1)], "doc_id long, text string, score int")
    rows = {r["id"]: r for r in lm.score(docs, lm.fold() != 1).collect()}
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 1
    given = {k: words(t) + [None] for k, t in enumerate(texts)} | {None: ["null", "id", None]}
    counts = collections.Counter(w for k, ws in given.items() if not held(k) for w in ws)
    n, v = sum(counts.values()), len(counts)
    model = lm.fit(docs.where(lm.fold() != 1).select("text"))[2]
    frequent = sorted((w for w in counts if w), key=lambda w: (-counts[w], w))[:4]
    kind = lambda w: 0 if w is None else 1 + frequent.index(w) if w in frequent else 5 + zlib.crc32(w.encode()[-3:]) % 8
    mass = [sum(c + 0.5 for w, c in counts.items() if kind(w) == k) + 0.5 for k in range(13)]

    def brute(ws):
        total, before = 0.0, 0
        for w in ws:
            k = kind(w)
            logits = [float(model.q[before].astype(float) @ model.r[j].astype(float) + model.b[j]) for j in range(13)]
            total += (logits[k] - math.log(sum(map(math.exp, logits)))) / math.log(10)
            total += math.log10((counts[w] + 0.5) / mass[k]) if k > 4 else 0.0
            before = k
        return total

    assert np.abs(model.r).max() > 0.01  # it has learned
    for k, ws in given.items():
        r = rows[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(k), len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert math.isclose(r["score"], brute(ws), rel_tol=1e-5)


def test_lm_is_normalised(monkeypatch):
    """The classes of each context sum to one, and so do the words of an ending class with one unseen word."""
    monkeypatch.setattr(lm, "FREQUENT", 2)
    monkeypatch.setattr(lm, "ENDINGS", 2)
    counts = {b"a": 50, b"b": 30, b"c": 5, b"d": 2, b"e": 1, lm.END: 9}
    ends: dict = {}
    for w, c in counts.items():
        if w != lm.END:
            n, v = ends.get(k := lm.ending(w, 2, 2) - 3, (0, 0))
            ends[k] = (n + c, v + 1)
    table_ = lm.Table(list(counts), list(counts.values()), sum(counts.values()), len(counts), ends)
    assert table_.class_of[:2].tolist() == [1, 2] and table_.class_of[5] == 0
    assert math.isclose(table_.mass.sum(), sum(counts.values()) + 0.5 * len(counts) + 0.5 * 2)
    rng = np.random.default_rng(1)
    model = lm.Model(*(rng.standard_normal(s).astype(np.float32) for s in ((5, 3), (5, 3), (5,)))).normalise()
    for v in range(5):
        assert math.isclose(np.exp(model.logs(np.full(5, v), np.arange(5))).sum(), 1.0, rel_tol=1e-5)
    for k in (3, 4):
        inside = [c + 0.5 for w, c in list(counts.items())[2:5] if lm.ending(w, 2, 2) == k]
        assert math.isclose(sum(inside) + 0.5, table_.mass[k])


def test_lm_gradient():
    """The gradient is the derivative of the objective, noise words summed one by one."""
    rng = np.random.default_rng(3)
    model = lm.Model(rng.standard_normal((5, 2)), rng.standard_normal((5, 2)), rng.standard_normal(5))
    noise, counts = np.log(rng.random(5)), rng.integers(0, 4, (3, 5))
    contexts = np.array([0, 2, 4])

    def objective():
        total = 0.0
        for row, v in enumerate(contexts):
            for w in range(5):
                x = model.q[v] @ model.r[w] + model.b[w] - noise[w]
                total -= counts[row, w] * math.log1p(math.exp(-x)) + counts[row].sum() * math.exp(noise[w]) * math.log1p(math.exp(x))
        return total

    q, r, b = lm.nce_gradient(model, noise, contexts, counts)
    for array, at, slope in ((model.q, (2, 1), q[1, 1]), (model.r, (3, 0), r[3, 0]), (model.b, (1,), b[1])):
        before = objective()
        array[at] += 1e-6
        assert math.isclose((objective() - before) / 1e-6, slope, rel_tol=1e-3)
        array[at] -= 1e-6


def test_lm_learns_what_follows_what(spark, small_lm):
    """And beats the base on held-out texts by the same scores, however the rows are dealt out."""
    rng = random.Random(1)
    follow = {"a": "b", "b": "c", "c": "a"}
    texts = []
    for k in range(300):
        w = [rng.choice("abc")]
        for _ in range(120):
            w.append(follow[w[-1]] if rng.random() < 0.95 else rng.choice("abc"))
        texts.append((k, " ".join(w)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = [{r["id"]: r for r in lm.score(docs.repartition(n, "doc_id"), lm.fold() != 1).collect()} for n in (1, 8, 32)]
    rows = [r for r in found[0].values() if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in rows) / sum(r["n_tokens"] for r in rows)
    assert gain > 0.1
    for other in found[1:]:
        assert all(math.isclose(r["score"], other[k]["score"], rel_tol=1e-9) for k, r in found[0].items())


def test_lm_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(none, lm.fold() != 1).count() == 0


def test_digest_of_no_items_is_that_of_the_empty_string():
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
