"""Token files, shards, pages and the pipeline against brute force."""

import itertools
import random
import zlib

import numpy as np
import pytest

from quelora.llm import html, pipeline, reshard, tokens
from quelora.llm.common import scratch


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 24, 31, 32])
def test_packing(bits):
    for n in (0, 1, 7, 65_536, 65_537, 70_001):
        ids = np.random.default_rng(n).integers(0, 2**bits, n, dtype=np.uint64).astype("<u4")
        raw = tokens.pack(ids, bits)
        assert len(raw) == (n * bits + 7) // 8 and (tokens.unpack(raw, bits, n) == ids).all()
    assert tokens.min_bits(49_408) == 16 and tokens.min_bits(2) == 1 and tokens.min_bits(65_537) == 17


def test_token_file(tmp_path):
    rng = np.random.default_rng(4)
    docs = [(k if k else None, rng.integers(0, 1000, n).astype("<u4")) for k, n in enumerate([3, 0, 70_000, 1, 140_000, 5])]
    with open(tmp_path / "f", "wb") as f:
        writer = tokens.TokenWriter(f, 10)
        for d in docs:
            writer.add(*d)
        writer.close()
    with open(tmp_path / "f", "rb") as f:
        file = tokens.TokenFile(f)
        assert [d for d, _ in file.docs()] == [d for d, _ in docs]
        assert all((a == b).all() for (_, a), (_, b) in zip(file.docs(), docs, strict=True))
        assert (file.doc(4) == docs[4][1]).all() and len(file.doc(1)) == 0
        flat = np.concatenate([x for _, x in docs])
        assert (file.tokens(69_000, 71_500) == flat[69_000:71_500]).all()


ODD = [
    None, "", "It's  <|endoftext|>x<|startoftext|> ÀÉ é̀ é ΣΑΣ ﬁ ½²Ⅷ İI\t\ttab\x0b x y", "́ a ́", "😀👍🏽 x", " ", "12 345", "'S'LL don't", "a\r\nb",
    "ª º µ ß ÿ Þ ð ...!!! a--b x| |y $$$ _a_ é- x̂, ª.", "naïve, STRAẞE straße! ^ ~ `x` \\", "word " * 30_000, "x" * 5000,
]


def test_tokens(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "FILE_ROWS", 8)
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("aZéßΣ'’s ll.,!|<>_-1²½\n\t́̂ªº漢字😀\x00x") for _ in range(40)) for _ in range(60)]
    rows = [(None if k == 5 else 1000 - k, t, "clash") for k, t in enumerate(texts)] + [(7, "twice", "c"), (7, "twice", "c")]
    files = tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string, shard string"), scratch(spark, "t"), path)
    assert files.count() > 3
    library = Tokenizer.from_file(path)
    expected, start = [], 0
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    found = [(r["id"], r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in tokens.read_tokens(files).collect()]
    assert sorted(found, key=lambda r: r[1]) == expected
    none = tokens.write_tokens(spark.createDataFrame([], "doc_id long, text string"), scratch(spark, "t"), path)
    assert tokens.read_tokens(none).count() == 0


# --- shards ---------------------------------------------------------------------------------------------------------


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(3)
    tried = 0
    for _ in range(200):
        new, blocks = rng.randrange(1, 4), []
        for old in range(rng.randrange(1, 4)):
            for c in range(rng.randrange(1, 3)):
                n = rng.randrange(1, 3)
                blocks.append((old, c, n, n * rng.randrange(1, 9)))
        total = sum(b[2] for b in blocks)
        if new**total > 3**8:
            continue
        tried += 1
        rows = [(o, s // n) for o, _, n, s in blocks for _ in range(n)]
        least, larger = reshard.capacities(total, new)
        sizes = sorted([least] * (new - larger) + [least + 1] * larger)
        best = min(sum(z for (o, z), j in zip(rows, to, strict=True) if o != j) for to in itertools.product(range(new), repeat=total) if sorted(to.count(j) for j in range(new)) == sizes)
        plan = reshard.solve(blocks, new, total)
        assert sum(plan[o, c][1] * (s // n) for o, c, n, s in blocks) == best
        slots = sorted((t, base + k) for _, a, b, t, base in reshard.transfers(blocks, new) for k in range(b - a))
        assert slots == [(t, k) for t in range(new) for k in range(plan[-1, t][0])]
    assert tried > 30 and reshard.transfers([], 3) == []


def gapless(rows, shards):
    slots = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(shards)}
    assert all(v == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


@pytest.mark.parametrize("block", [200_000, 3])
def test_reshard(spark, monkeypatch, block):
    from pyspark.sql import functions as F

    monkeypatch.setattr(reshard, "BLOCK_ROWS", block)
    monkeypatch.setattr(reshard, "TASK_BYTES", 500)
    rng = random.Random(2)
    rows = [(k if k != 4 else None, None if k == 3 else f"{k}" + "é" * rng.randrange(40), "s", 5, "h") for k in range(203)] + [(9, "x" * 4000, "s", 5, "h")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, size int, home string")
    old = F.coalesce(F.when(F.col("doc_id") != 8, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(5))), F.lit(0))  # one null
    placed = reshard.place(docs, old, reshard.plan(docs, old, 7, shards=5), shards=5)
    found = reshard.rewrite(placed, scratch(spark, "s")).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in found) == sorted((str(r[0]), str(r[1])) for r in rows)
    assert all(r["size"] == len((r["text"] or "").encode()) + 16 for r in found)
    gapless(found, 7)
    assert len({r["shard"] for r in found if r["doc_id"] == 9 and r["text"][0] == "x"}) == 1
    single = [r for r in found if not (r["text"] or "").startswith("x")]
    leaving = [r for r in single if r["old_shard"] != r["shard"]]
    for s in range(5):  # what leaves a shard is of no larger size class than what stays
        go = [r["size"] for r in leaving if r["old_shard"] == s]
        stay = [r["size"] for r in single if r["old_shard"] == s == r["shard"]]
        assert not go or not stay or max(go) <= min(stay) * 1.13 + 1
    assert set(reshard.affected(placed)) <= set(range(7))
    only = reshard.rewrite(placed, scratch(spark, "s"), only=[2])
    assert {r["shard"] for r in only.collect()} == {2}
    assert reshard.reshard(docs.limit(0), F.lit(0), scratch(spark, "s")).count() == 0


def test_reshard_keeps_copies_together(spark):
    """Groups of two to thirty rows over shards of 100; and one group of a third of all rows, larger than a shard."""
    from pyspark.sql import functions as F

    rng, texts = random.Random(4), []
    for k in range(60):
        texts += [f"copy {k} " + "y" * rng.randrange(300)] * rng.choice([2, 3, 5, 30])
    texts += [f"own {k} " + "z" * rng.randrange(300) for k in range(1000 - len(texts))]
    old = F.pmod(F.xxhash64("doc_id"), F.lit(8))  # copies are scattered before
    for more, split in (([], 0), (["hot"] * 500, 1)):
        rows = list(enumerate(texts + more))
        found = reshard.reshard(spark.createDataFrame(rows, "doc_id long, text string"), old, scratch(spark, "s"), 10, shards=8).collect()
        gapless(found, 10)
        assert sorted((r["doc_id"], r["text"]) for r in found) == rows
        shards = {}
        for r in found:
            shards.setdefault(r["text"], set()).add(r["shard"])
        assert sum(len(s) > 1 for s in shards.values()) == split


def test_reshard_leaves_other_shards_in_place(spark, tmp_path):
    """Shard 0 gives half of its rows to a new one; the rest isn't written."""
    from pyspark.sql import functions as F

    rows = [(k, f"text {k}", k % 4) for k in range(40)] + [(100 + k, f"more {k}", 4) for k in range(10)]
    rows = [(i, t, 0 if s == 4 else s) for i, t, s in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, now int")
    folder = str(tmp_path / "out")
    found = reshard.reshard(docs, F.col("now"), folder, 5, shards=4).collect()
    gapless(found, 5)
    assert sorted((r["doc_id"], r["text"]) for r in found) == sorted((i, t) for i, t, _ in rows)
    assert sorted(p.name for p in (tmp_path / "out").glob("shard=*")) == ["shard=0", "shard=4"]
    assert all(r["shard"] == r["now"] for r in found if r["now"])


# --- pages ----------------------------------------------------------------------------------------------------------


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("cells", [40_000_000, 3])
def test_alignment(cells):
    rng = random.Random(2)
    for _ in range(1500):
        a, b = rng.choices("abcd", k=rng.randrange(12)), rng.choices("abcd", k=rng.randrange(12))
        common = [x for x, keep in zip(a, html.shared(a, b, cells), strict=True) if keep]
        rest = iter(b)
        assert len(common) == longest(a, b) and all(x in rest for x in common)


def test_lines_of_a_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <nav><ul><li>Menu</li></ul></nav><!-- ad --><div class="ad">Buy</div><header>Top</header>
    <article><h1>Head &amp; more</h1><p><b>One  &lt;two&gt;
    three<br><p>Four</p><aside>side</aside><form>f</form><div class="comments">bad</div><p class="ad">advert<p>Five &copy &#233;</article>
    <footer>&copy; end</footer>"""
    assert [t for t, place in html.lines(page) if place == html.CONTENT] == ["Head & more", "One <two> three", "Four", "Five © é"]
    assert html.lines(None) == [] and html.lines("plain &amp; text") == [("plain & text", html.OTHER)]
    assert html.lines("<p>unclosed <nav>x") == [("unclosed", html.OTHER), ("x", html.FURNITURE)]
    assert [t for t, place in html.lines(page) if place == html.FURNITURE] == ["Menu", "Buy", "Top", "side", "f", "bad", "advert", "© end"]
    assert html.lines("<article><p>a</p>" + "<div>" * 3000 + "deep") == [("a", html.CONTENT), ("deep", html.CONTENT)]


def test_content_that_looks_like_furniture():
    content = lambda page: [t for t, place in html.lines(f"<article>{page}</article>") if place == html.CONTENT]
    assert content("<p>Euler <math><mi>e</mi></math> end</p>") == ["Euler e end"]
    assert content("<object>one</object><canvas>two</canvas><audio>three</audio>") == ["onetwothree"]
    assert content('<div class="related-work">a</div><p class="share price">b</p><p id="commentary">c</p>') == ["a", "b", "c"]
    assert content('<div class="share-bar">a</div><p class="ad">b</p><div id="comment-list-2">c</div>d') == ["d"]
    assert content("<p>a</p><svg><text>logo</text><p>b</p>") == ["a", "b"]


@pytest.mark.parametrize("rows", [7, 10_000])
def test_differencing_of_generated_sites(spark, monkeypatch, rows):
    """Sites whose frames have no names: what every page of a site has is template, inside the content too, but for
    passages that some pages quote. The texts are known by construction, and don't depend on the ranges."""
    monkeypatch.setattr(html, "RANGE_ROWS", rows)
    rng, pages, expected = random.Random(6), [], {}
    line = lambda *seed: " ".join(random.Random(str(seed)).choices(["alpha", "beta", "gamma", "delta", "rho", "tau"], k=9)) + f" {seed}"
    for site in range(4):
        quotes = [line("quote", site, k) for k in range(3)]
        for k in range(14):
            number = len(pages)
            own = [line("own", number, j) for j in range(rng.randrange(2, 7))]
            for quote in rng.sample(quotes, rng.randrange(3)):
                own.insert(rng.randrange(1, len(own)), quote)
            beside = [line("beside", number)] if site % 2 else []
            body = "".join(f"<p>{x}</p>" for x in [f"staff of {site}", *own, f"read on at {site}"])
            page = f"<body><div>{site} top</div>{''.join(f'<div>{x}</div>' for x in beside)}<article>{body}</article><nav>menu {rng.randrange(3)}</nav><div>{site} end</div>"
            pages.append((number, f"https://s{site}.org/{'news' if k % 2 else 'blog'}/{k:02d}", page))
            expected[number] = "\n".join([*beside, *own])
    found = html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["id"]: r["text"] for r in found} == expected
    assert sum(r["n_lines_deleted"] >= 4 for r in found) == len(pages)  # differencing changes every page


def test_extraction(spark, monkeypatch):
    monkeypatch.setattr(html, "RANGE_ROWS", 10)
    frame = "<body><div>Site name</div><p>{}</p><p>{}</p><div>Read on</div></body>"
    rows = [(k, f"http://h{k % 2}.org/a/{k:03d}", frame.format(f"text {k}", f"more {k}"), 1) for k in range(60)]
    rows += [(100, "http://alone.org/x", "<p>only</p>", 1), (101, None, "<p>no url</p>", 1), (102, "http://h0.org/a/null", None, 1), (103, "http://h0.org/a/empty", "", 1)]
    rows += [(104, "http://c.org/1", frame.format("copy", "copy 2"), 1), (105, "http://c.org/2", frame.format("copy", "copy 2"), 1), rows[0]]
    rows += [(106, "http://q.org/1", "<article><p>quote</p><p>own</p></article>", 1), (107, "http://q.org/2", "<article><p>quote</p><p>mine</p></article>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = html.extract(pages).collect()
    text = {r["id"]: r["text"] for r in found}
    assert len(found) == len(rows)
    assert all(text[k] == f"text {k}\nmore {k}" for k in range(60))
    assert text[100] == "only" and text[101] == "no url" and text[102] == "" and text[103] == ""
    assert text[104] == text[105] == "Site name\ncopy\ncopy 2\nRead on"  # a copy is no template
    assert text[106] == "quote\nown"  # declared content stays
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert html.extract(pages.limit(0)).count() == 0


# --- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    rng = random.Random(3)
    make = {"en": "the house with over thing where which", "de": "der haus und mit über wenn nicht"}
    vocabulary = {k: v.split() + [x + y for x in v.split() for y in v.split()] for k, v in make.items()}
    sentence = lambda lang, n=12: " ".join(rng.choices(vocabulary[lang], k=n))
    item = sentence("en", 20)
    rows = [(k, "\n".join(sentence(lang) for _ in range(6)), lang) for k, lang in enumerate(["en", "de"] * 20)]
    rows += [(200, rows[0][1], "en"), (201, sentence("en") + "\n" + item + " more", "en"), (202, None, "en"), (203, "12 34", None), (204, rows[1][1] + "\n" + sentence("de"), "de")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t) if t else None) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    step, sizes = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns
        sizes.append(sorted(r["doc_id"] for r in step.collect()))
    assert sizes[0] == sorted({r[0] for r in rows} - {202, 203})
    assert sizes[1] == sorted(set(sizes[0]) - {200})  # its lines stand in document 0
    assert 201 in sizes[2] and 201 not in sizes[3] and set(range(40)) <= set(sizes[3])
    final = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in final) == sizes[3] and all(r["round_trip"] for r in final)
    kept = {r["doc_id"]: r["text"] for r in step.collect()}
    assert kept[0] == rows[0][1] and len(kept[204].split("\n")) == 1


def test_pipeline_stages_with_any_columns_and_no_rows(spark, tmp_path):
    """Names that the stages use themselves are carried, repeated rows too, and empty tables pass."""
    names = ["row", "a", "b", "drop", "__doc", "tag", "node", "part", "score", "lang_pred", "shard"]
    text = "the house with over thing where which house thing with over the where"
    rows = [(k, f"{text} number {k % 3}\n{text} {k}", "en", "s", 0, *(f"{n}{k}" for n in names)) for k in (1, 2, 3, 3, 4)] + [(9, None, None, "s", None, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    spark.createDataFrame([(1, "no such words at all in here today")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns
        assert all(r[n] in (f"{n}{r['doc_id']}", n) for r in kept.collect() for n in names)
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.columns == docs.columns and none.count() == 0
    assert pipeline.STAGES[-1][1](spark, docs.limit(0), "").count() == 0
    assert sorted(r["doc_id"] for r in pipeline.decontamination_stage(spark, docs, str(tmp_path)).collect()) == [1, 2, 3, 3, 4, 9]
