"""Operators that SQL cannot express, against slow versions written from their definitions."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_operators import DOCS, docs_of, edits, read, slow_matches, texts_of
from test_pipeline import slow_near

from quillgraph.llm import components, decontamination, gif, html_template, langid, media, mixing, passages, pipeline_stages, queries, simhash_dedup, toxicity, urls


# 1: near copies of the pipeline's stage


@pytest.mark.parametrize(("few", "block"), [(32, 512), (0, 3), (1, 2)])
def test_near_copies_in_pairs_and_blocks(spark, monkeypatch, few, block):
    monkeypatch.setattr(simhash_dedup, "FEW", few)
    monkeypatch.setattr(simhash_dedup, "BLOCK_TEXTS", block)
    monkeypatch.setattr(components, "IN_ONE_TASK", 0 if few == 0 else 1 << 14)
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    texts = [None, "", "x", "one two"]
    for size in (12, 60, 150):
        base = [word() for _ in range(size)]
        for changes in (0, 1, 1, 2, 3, 5, 8, 8, 12):
            copy = list(base)
            for at in rng.choice(size, min(changes, size), replace=False):
                copy[at] = word()
            texts.append(" ".join(copy))
    kept = simhash_dedup.keep_one_per_group(docs_of(spark, texts)).collect()
    assert {r["doc_id"] for r in kept} == slow_near(dict(enumerate(texts))) and len(kept) == len({r["doc_id"] for r in kept})


def changed_words(sizes, changes):
    """Texts of random words, and copies of each with so many words replaced."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    texts = []
    for size in sizes:
        base = [word() for _ in range(size)]
        for n in changes:
            copy = list(base)
            for at in rng.choice(size, n, replace=False):
                copy[at] = word()
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("few", [32, 0])
def test_near_copies_come_from_the_trees(spark, monkeypatch, few):
    monkeypatch.setattr(simhash_dedup, "FEW", few)
    texts = changed_words((60, 150), (0, 1, 1, 1))
    kept = lambda: {r["doc_id"] for r in simhash_dedup.keep_one_per_group(docs_of(spark, texts)).collect()}
    assert kept() == slow_near(dict(enumerate(texts))) == {0, 4}
    monkeypatch.setattr(simhash_dedup, "NEAR_RADIUS", -1)
    assert kept() == set(range(len(texts)))


@pytest.mark.parametrize("few", [32, 1000])
def test_near_copies_in_many_trees(spark, monkeypatch, few):
    for name, value in (("FEW", few), ("STAR_TEXTS", 3), ("TREE_TEXTS", 4), ("TREES_AT_ONCE", 5)):
        monkeypatch.setattr(simhash_dedup, name, value)
    texts = changed_words((12, 80, 200), (0, 1, 1, 2, 3, 4, 4, 5, 6, 8, 9, 10))
    assert {r["doc_id"] for r in simhash_dedup.keep_one_per_group(docs_of(spark, texts)).collect()} == slow_near(dict(enumerate(texts)))


@pytest.mark.parametrize("radius", [-1, 0, 2, 10, 31, 64])
def test_near_pairs(radius):
    rng = np.random.default_rng(5)
    fp = rng.choice(np.r_[rng.integers(-(1 << 63), 1 << 63, 12), -1, -2, 0, 1, 3], 90)
    tree, size, asks = np.sort(rng.integers(0, 4, 90)), rng.integers(0, 6, 90), rng.random(90) < 0.6
    q, n = simhash_dedup.near_pairs(tree, fp, size, asks, radius)
    bits = lambda i, j: ((int(fp[i]) ^ int(fp[j])) & (1 << 64) - 1).bit_count()
    fits = lambda i, j: min(size[i], size[j]) >= 0.8 * max(size[i], size[j])
    want = [(i, j) for i in range(90) if asks[i] for j in range(i) if tree[i] == tree[j] and bits(i, j) <= radius and fits(i, j)]
    assert sorted(zip(q.tolist(), n.tolist(), strict=True)) == want


def test_least_row_of_a_repeated_id_stays(spark):
    rows = [(1, "b b b", "en", "s", 5), (1, "a a a", "en", "s", 5), (1, "a a a", "en", "s", 5), (2, "c", "en", None, 1), (None, "c", "en", "s", 1), (None, "c", "en", "s", 1)]
    kept = sorted(map(tuple, simhash_dedup.keep_one_per_group(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert kept == sorted([(1, "a a a", "en", "s", 5), (2, "c", "en", None, 1), rows[4], rows[5]], key=str)


def test_block_links():
    rng = np.random.default_rng(1)
    sets = [np.flatnonzero(rng.random(20) < rate).astype(np.uint64) for rate in rng.choice([0.1, 0.9], 60)]
    a, b = simhash_dedup.block_links(sets[:25], sets[25:])
    want = {(i, j) for i, x in enumerate(sets[:25]) for j, y in enumerate(sets[25:]) if len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y))}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and want


# 2: URLs


def test_all_suffixes_have_rates(spark):
    rows = [(i, f"http://h{i % 7}.s{i % 331}/p", int(i % 331 < 160)) for i in range(6620)]
    df = urls.with_host_and_path(spark.createDataFrame(rows, "page_id long, url string, label int"))
    model = urls.train(df.where("page_id < 5000"))
    assert model.suffixes.count() == 331
    held = urls.with_block_score(df.where("page_id >= 5000"), model)
    assert held.where((F.col("block_score") >= 0.5).cast("int") != F.col("label")).count() == 0


# 3: languages


def slow_bundle(text):
    slots = [0]
    for c in text or "":
        slot = ord(c.lower()[0]) + 1 if c.isalpha() else 0
        if slot or slots[-1]:
            slots.append(slot)
    if slots[-1]:
        slots.append(0)
    out = np.zeros(langid.DIM)
    for grams, n in Counter(zip(slots, slots[1:], slots[2:], strict=False)).items():
        if grams[1]:
            a, b, c = (np.roll(langid._signs(s).astype(int), 2 - k) for k, s in enumerate(grams))
            out += n * a * b * c
    return out, any(slots)


def test_language_query(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").collect()
    vecs = {r["doc_id"]: slow_bundle(r["text"]) for r in rows}
    protos = {}
    for r in rows:
        if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            protos[r["lang"]] = protos.get(r["lang"], 0) + vecs[r["doc_id"]][0]
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_language"](spark, sf_dir).collect()}
    for k, (v, has) in vecs.items():
        cosines = {n: float(v @ p) / np.linalg.norm(v) / np.linalg.norm(p) for n, p in protos.items()} if has else {}
        assert got[k]["lang_pred"] == (max(sorted(cosines), key=cosines.get) if has else "und")
        assert abs(got[k]["score"] - (max(0, *cosines.values()) if has else 0)) < 1e-4


def test_bundles_of_many_letters_and_long_texts(monkeypatch):
    rng = np.random.default_rng(2)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 900))), "ab" * 700, "", "aЀb \U00010400x"]
    whole, _ = langid.bundle(texts)
    assert all(np.array_equal(v, slow_bundle(t)[0]) for v, t in zip(whole, texts, strict=True))
    monkeypatch.setattr(langid, "CHUNK", 64)
    assert np.array_equal(langid.bundle(texts)[0], whole)


# 4: mixing


def test_mixing_rates(spark, sf_dir):
    rows = queries.QUERIES["op4_mixing"](spark, sf_dir).collect()
    names = [f"p_{n}" for n in ("clean", "junk", "toxic")]
    p, n = np.array([[r[c] for c in names] for r in rows]), np.array([r["n_tokens"] for r in rows], float)
    texts = texts_of(spark, sf_dir)
    assert all(r["n_tokens"] == len(re.findall(rb"[^\x20\x09-\x0D]+", (texts[r["doc_id"]] or "").encode())) for r in rows)
    wanted, own = np.array([pipeline_stages.TARGETS[c[2:]] for c in names]), None
    gram = (p.T * n) @ p / n.sum()
    own = np.maximum(gram.diagonal(), 1e-12)
    eta = 1 / np.linalg.eigvalsh(gram / np.sqrt(np.outer(own, own))).max()
    r = y = np.ones(len(p))
    best, idle, size, k = np.inf, 0, np.inf, 0
    while size >= mixing.CLOSE and idle < mixing.PATIENCE:
        gap = (p.T * n) @ y / n.sum() - wanted
        size = np.abs(gap).sum()
        best, idle = (size, 0) if size < 0.99 * best else (best, idle + 1)
        new = np.maximum(0, y - eta * p @ (gap / own))
        y, r, k = new + k / (k + 3) * (new - r), new, k + 1
    assert np.allclose([x["rate"] for x in rows], r, atol=1e-4)
    assert np.abs((p.T * n) @ r / n.sum() - wanted).sum() < 0.02


def test_targets_that_cannot_be_met(spark):
    rows = spark.createDataFrame([(1, 10, [1.0, 0.0]), (2, 30, [1.0, 0.0])], "doc_id long, n_tokens long, posteriors array<double>")
    model = mixing.Domains(["a", "b"], np.zeros((mixing.BUCKETS, 2)), np.zeros(2))
    assert np.allclose(mixing.fit_rates(rows, model, {"a": 0.5, "b": 0.5})[1], [0.5, 0.0], atol=1e-3)


# 5: templates


def slow_template(pages):
    """Keys that stand once on every page and keep their order, greedily from the first page; slots with classes that repeat."""
    keys = [[t.key for t in p] for p in pages]
    block = {t.key for p in pages for t in p if t.name in html_template.BLOCKS}
    once = [k for k in keys[0] if k in block and all(own.count(k) == 1 for own in keys)]
    order, last = [], [-1] * len(keys)
    for k in once:
        at = [own.index(k) for own in keys]
        if all(x > y for x, y in zip(at, last, strict=True)):
            order.append(k)
            last = at
    where = {}
    for own in keys:
        slot = ""
        for k in own:
            slot = k if k in order else slot
            where.setdefault(k, set()).add(slot)
    tags = {t.key for p in pages for t in p if t.name}
    nested = {}
    for k in sorted(tags & set(keys[0])):
        counts = [own.count(k) for own in keys]
        if all(counts) and set(counts) != {1} and len(where[k]) == 1:
            nested.setdefault(next(iter(where[k])), set()).add(k)
    return order, nested


def test_deduction(spark, sf_dir):
    by_host = {}
    for r in read(spark, "/root/testdata/sf0.01", "pages").select("url", "html").collect():
        by_host.setdefault(r["url"].split("/")[2], set()).add(r["html"])
    groups = [sorted(v)[:8] for v in by_host.values() if len(v) > 2][:12]
    menu = lambda i: "".join(f"<li><a href=/{k}>{k}</a></li>" for k in range(i + 2))
    groups.append([f"<body><ul>{menu(i)}</ul><div id=x><p>Text {i}</p></div><div class=y><p>More</p></div></body>" for i in range(4)])
    for group in groups:
        parsed = [list(html_template.tokens(p)) for p in group]
        t = html_template.deduce(parsed)
        order, nested = slow_template(parsed)
        assert t.order == order and {k: set(v) for k, v in t.nested.items()} == nested


def test_one_story_on_three_hosts_stays(spark):
    story = "<html><body><div class=content><p>One story that three hosts carry word for word.</p></div><div class=foot>{}</div></body></html>"
    rows = [(i, f"http://h{i}.org/a", story.format(i)) for i in range(3)] + [(9, None, story.format("x"))]
    got = {r["page_id"]: r["text"] for r in html_template.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict.fromkeys((0, 1, 2, 9), "One story that three hosts carry word for word.")


def test_notices_go_and_copies_stay():
    page = "<body><article><h1>{0}</h1><p>Body of page {0}, of some length.</p><p>{1}</p></article></body>"
    assert html_template.extract_group([page.format(i, "Subscribe!") for i in range(4)]) == [f"{i}\nBody of page {i}, of some length." for i in range(4)]
    shared = "A paragraph that all copies share and that is the greater part of each of them."
    assert all(t.endswith(shared) for t in html_template.extract_group([page.format(i, shared) for i in range(4)]))


def test_html_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(html_template, "GROUP", 5)
    pages = read(spark, "/root/testdata/sf0.01", "pages").withColumn("html", F.replace(F.replace("html", F.lit("<article>"), F.lit("<div class=story>")), F.lit("</article>"), F.lit("</div>"))).withColumn("host", F.lit("mine"))
    out = [sorted(map(tuple, html_template.extract_main_text(pages.repartition(n)).collect())) for n in (1, 40)]
    assert out[0] == out[1] and sum(len(r[2]) for r in out[0]) > 10_000
    assert html_template.extract_main_text(pages.where("false")).count() == 0
    long = spark.createDataFrame([(1, "http://a/", "<article>" + "<p>word</p>" * 50_000 + "</article>")] * 2, "page_id long, url string, html string")
    assert [len(r["text"]) for r in html_template.extract_main_text(long).collect()] == [249_999] * 2


# 6: GIF


def test_malformed_gifs_are_null(spark):
    whole = media.to_gif(b"ab" * 960)
    control = b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0, 0x21, 0xF9, 1, 0, 0, 0x3B])
    at = whole.index(b"\x2c") + 10
    bad = [b"", b"GIF", b"GIF89a", control, whole[:at] + b"\xc8" + whole[at + 1 :], whole[:-40], whole[:-1], b"GIF89a" + b"\xff" * 4 + b"\0\0\0\x3b", whole[:4] + b"8" + whole[5:]]
    rows = media.decode_gifs(spark.createDataFrame([(i, x) for i, x in enumerate([*bad, whole, whole])], "i int, g binary").withColumn("frames", F.lit("mine")), "g").collect()
    assert {r["i"]: r["frames"] is None for r in rows} == {i: i < len(bad) for i in range(len(bad) + 2)}
    with pytest.raises(ValueError, match="samples"):
        gif.decode(whole[:at] + b"\x08\x04" + whole[at + 2 : at + 6] + b"\0\x3b")
    assert media.text_media(docs_of(spark, ["a"]).where("false")).count() == 0


def test_features_of_texts(spark, sf_dir):
    """Frames of 256 rows, 40 ms each, pixels by the high bits of the palette's three colours."""
    own = texts_of(spark, sf_dir)
    for r in queries.QUERIES["op6_gif"](spark, sf_dir).collect():
        raw = (own[r["doc_id"]] or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        n, bins = -(-len(payload) // (192 * 256)), Counter()
        for byte, count in Counter(payload).items():
            red, green, blue = (byte >> 5) * 255 // 7, (byte >> 2 & 7) * 255 // 7, (byte & 3) * 85
            bins[(red >> 7) * 4 + (green >> 7) * 2 + (blue >> 7)] += count
        if n == 1:
            assert r["feature"] == f"1|40|{','.join(str(bins[i]) for i in range(8))}"
        assert r["feature"].startswith(f"{n}|{40 * n}|")


# 7: passages


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(150, 420), st.lists(st.integers(0, 400), max_size=3)), min_size=1, max_size=7), st.sampled_from([b"a", b"ab", b"abc\x00\xff"]))
def test_refinement(parts, letters):
    rng = np.random.default_rng(len(parts))
    bases = [rng.choice(list(letters), 460).astype(np.uint8).tobytes() for _ in range(4)]
    texts = []
    for base, size, changes in parts:
        text = bytearray(bases[base][460 - size :] if size % 2 else bases[base][:size])
        for at in changes:
            text[at % size] = letters[at % len(letters)]
        texts.append(bytes(text))
    size = np.array([len(t) for t in texts])
    begin = np.cumsum(size) - size
    starts = np.concatenate([b + np.arange(max(0, n - 199)) for b, n in zip(begin, size, strict=True)])
    got = passages.refine(np.frombuffer(b"".join(texts), np.uint8), starts, np.repeat(np.arange(len(texts)), size))
    counts = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    assert got.tolist() == [counts[t[i : i + 200]] > 1 for t in texts for i in range(len(t) - 199)]


# 8: decontamination


def test_recall_of_windows():
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    found = wanted = 0
    for _ in range(600):
        n = int(rng.integers(13, 100))
        item = [word() for _ in range(n)]
        copy = list(item)
        for at in rng.choice(n, int(rng.integers(1, 4)), replace=False):
            copy[at] = word()
        text = " ".join([word() for _ in range(20)] + copy + [word() for _ in range(20)])
        want = slow_matches(text, [(1, " ".join(item))])
        got = decontamination.Index([(1, " ".join(item))]).search(text)
        wanted += len(want)
        found += bool(want) and bool(got) and round(got[0][1], 9) == round(want[1][0], 9)
    print(f"recall of windows: {found} of {wanted}")
    assert found == wanted > 150


def test_joined_items_give_the_same(spark, monkeypatch, sf_dir):
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    short = spark.createDataFrame([(900, "a"), (901, "the of"), (902, None), (903, ""), (904, "x y z q")], "item_id long, text string")
    some = docs.union(docs.where("doc_id < 3"))
    both = items.select("item_id", "text").union(short)
    whole = sorted(map(tuple, decontamination.contaminated(some, both).collect()))
    monkeypatch.setattr(decontamination, "CHARS_AT_ONCE", 100)
    assert sorted(map(tuple, decontamination.contaminated(some, both).collect())) == whole and len(whole) > 20
    long = docs_of(spark, ["w " * 60_000 + " ".join(map(str, range(40)))])
    assert decontamination.contaminated(long, spark.createDataFrame([(1, " ".join(map(str, range(40))))], "item_id long, text string")).count() == 1


# 9: toxicity


def slow_evidence(lexicon, text):
    text = (text or "").lower()
    tokens = toxicity.TOKENS.findall(text)
    entries = [(w, True) for w in lexicon.words] + [(s, False) for s in lexicon.stems]

    def far(word):
        if word in lexicon.words or any(word.startswith(s) for s in lexicon.stems):
            return 0
        if word in lexicon.exempt or len(word) < toxicity.FUZZY - 1:
            return None
        for e, whole in entries:
            if len(e) >= toxicity.FUZZY and abs(len(e) - len(word)) <= (1 if whole else 99) and min(edits(word[:n], e) for n in ([len(word)] if whole else range(len(word) + 1))) == 1:
                return 1
        return None

    distance = {w: far(w) for w in set(toxicity.WORD.findall(text))}
    abuse = quoted = 0.0
    for at, token in enumerate(tokens):
        if distance.get(token) is not None and token not in toxicity.QUOTES:
            before = sum(t in toxicity.QUOTES for t in tokens[:at])
            inside = before % 2 and any(t in toxicity.QUOTES for t in tokens[at + 1 : at + 21])
            if inside or any(t in toxicity.REPORTING for t in tokens[max(0, at - 5) : at + 6]):
                quoted += 0.5 ** distance[token]
            else:
                abuse += 0.5 ** distance[token]
    return abuse, quoted


def test_toxicity_query(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    lexicon, w = toxicity.train(toxicity.labelled_sample(docs, labels, "toxic"))
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_toxicity"](spark, sf_dir).collect()}
    for k, text in texts_of(spark, sf_dir).items():
        if len(text or "") < 4000:
            a, q = slow_evidence(lexicon, text)
            score = 1 / (1 + np.exp(-np.clip(w[0] + max(w[1], 0) * np.log2(1 + a) + w[2] * np.log2(1 + q), -30, 30)))
            assert abs(got[k]["score"] - score) < 1e-9 and got[k]["predicted"] == (score >= 0.7)


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(5, 1, 1)] * 500 + [(6, 1, 0), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(5, "vile words here"), (5, "vile words here"), (6, "kind words"), (None, "x"), (8, "long " * 50_000)], "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("abuse", "score", "label", "id")})
    sample = toxicity.labelled_sample(docs, labels, "toxic")
    assert sample.count() <= 2
    rows = toxicity.scores(docs, *toxicity.train(sample)).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.scores(docs.where("false"), *toxicity.train(sample)).count() == 0
