"""Near copies of the pipeline against brute force."""

import itertools
import random

from quelora.llm import common, neardup, pipeline


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    x, y = shingles(a), shingles(b)
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def first_of_each(rows):
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, j in itertools.combinations(range(len(rows)), 2):
        if similar(rows[i][1], rows[j][1]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return sorted(rows[k][0] for k in range(len(rows)) if find(k) == k)


def test_sketches_never_exceed_the_sets():
    rng = random.Random(4)
    for n, m, common in [(0, 0, 0), (0, 3, 0), (5, 70, 4), (90, 100, 85), (200, 700, 150), (1000, 900, 900)]:
        x, y, both = ({rng.getrandbits(64) for _ in range(k)} for k in (n - common, m - common, common))
        a, b = (neardup.np.array(sorted(s | both), dtype=neardup.np.uint64) for s in (x, y))
        far = neardup.sketch_distance(neardup.sketch(a), neardup.sketch(b))
        short = int.from_bytes((neardup.short_sketch(a) ^ neardup.short_sketch(b)).tobytes()).bit_count()
        assert short <= len(x ^ y) and short % 2 == len(x ^ y) % 2
        assert far <= len(x ^ y) and far % 2 == len(x ^ y) % 2
        assert neardup.sketch_distance(neardup.sketch(a), neardup.sketch(a)) == 0


def test_filter_holds_its_keys(spark):
    keys = [0, 1, -1, common.FILTER_BITS - 1, common.FILTER_BITS, -(2**63), 2**63 - 1]
    raw = common.key_filter(spark.createDataFrame([(k,) for k in keys], "a long"), "a")
    bits = neardup.np.unpackbits(neardup.np.frombuffer(raw, neardup.np.uint8), bitorder="little")
    assert set(neardup.np.flatnonzero(bits).tolist()) == {k % common.FILTER_BITS for k in keys}
    assert common.in_filter(raw, neardup.np.array([*keys, 5])).tolist() == [True] * len(keys) + [False]


def test_near_copies(spark, monkeypatch):
    """Copies with a few edited words, a chain, a passage that many unlike texts share, short and wordless texts."""
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts, passage = [None, "", "a", "A", "a b", "one two three four five", "one two three four five six"], fresh(60)
    for _ in range(8):
        base = fresh(120)
        texts.append(" ".join(base))
        for edits in range(1, 6):
            copy = list(base)
            for k in rng.sample(range(120), edits):
                copy[k] = fresh(1)[0]
            texts.append(" ".join(copy))
    chain = fresh(200)
    for _ in range(10):
        chain = chain[12:] + fresh(12)
        texts.append(" ".join(chain))
    texts += [" ".join(fresh(30) + passage) for _ in range(20)] + [" ".join(fresh(13) + passage) for _ in range(20)]
    rows = list(enumerate(texts))
    expected = first_of_each(rows)
    assert len(expected) < len(rows) - 20
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in [*rows, rows[-1]]], "doc_id long, text string, row string, a string, n_chars long")
    for sample in (5_000, 30):
        monkeypatch.setattr(neardup, "SAMPLE", sample)
        kept = pipeline.near_duplicate_stage(spark, docs, "")
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == expected
    assert pipeline.near_duplicate_stage(spark, docs.limit(0), "").count() == 0
