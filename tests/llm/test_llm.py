"""Every operator against brute force, and on nulls, empty and clashing inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import decontam, html_extract, language_id, license_scan, lm_scoring, mixing, ngram_join, suffix_dedup, token_counts, vector_search
from quillmark.llm import kernels as K
from quillmark.llm.graph import components, merged

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=3, n=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(150)]
    base = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 120))) for _ in range(n)]
    out = list(base)
    for t in base[: n // 2]:
        w = t.split()
        for _ in range(r.randint(0, 6)):
            if w:
                w[r.randrange(len(w))] = r.choice(vocab)
        out.append(" ".join(w))
    out += base[:6] + [None, "", "  ", "x", "one two", "ab" * 400, base[2] + "\n" + base[3], "a\tb\vc d"]
    return [(i * 3, t, ["en", "fr", None][i % 3], ["s1", "s2", "t1", None][i % 4], len(t or "")) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def clash(docs):
    """Columns with names that operators use inside or give back."""
    for c in ("token", "n", "sig", "data", "score", "n_tokens", "lang_pred", "component_id", "epoch", "domain", "w", "item_id", "kept", "spans"):
        docs = docs.withColumn(c, F.lit("clash"))
    return docs


def brute_repeats(rows, window):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            w = b[s : s + window]
            if w in seen:
                gone[s : s + window] = b"\1" * window
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("window", [100, 40])
def test_suffix_dedup(docs, rows, window):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_windows(docs, window=window).collect()}
    assert got == brute_repeats([r[:2] for r in rows], window)


def test_suffix_dedup_long_texts_and_whole_characters(spark, monkeypatch):
    monkeypatch.setattr(K, "SLICE", 512)
    r = random.Random(1)
    a = "".join(r.choice("abcé") for _ in range(3000))
    rows = [(1, a), (2, a[500:2500] + "x" + a[:900]), (3, "z" * 1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = suffix_dedup.dedup_windows(df).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got} == brute_repeats(rows, 100)
    for x in suffix_dedup.dedup_windows(df, whole_chars=True).collect():
        bytes(x.kept).decode()


def brute_join(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_ngram_join(docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(docs).collect()}
    assert got == brute_join([r[:2] for r in rows])


def test_ngram_join_counts_all_links(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "COLUMNS", 16)
    r = random.Random(5)
    texts = []
    for k, copies in enumerate((1, 2, 3, 12, 20)):
        w = [f"w{k}x{i}" for i in range(60)]
        for _ in range(copies):  # near copies, of which not all are linked with each other
            own = list(w)
            for i in r.sample(range(60), r.randint(0, 2)):
                own[i] = r.choice("xyz")
            texts.append(" ".join(own))
    texts += [texts[3], texts[-1], "", None, "a b"]
    words = [tuple((t or "").split()) for t in texts]
    sets = [frozenset(w[j : j + 5] for j in range(len(w) - 4)) if len(w) > 4 else frozenset([w] if w else []) for w in words]
    linked = {(a, b) for a in set(sets) for b in set(sets) if a and b and a != b and 100 * len(a & b) >= 75 * len(a | b)}
    want = {i: sum((s, t) in linked for t in set(sets)) for i, s in enumerate(sets)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = ngram_join.jaccard_join(df).collect()
    assert {x.doc_id: x.n_links for x in found} == want and max(want.values()) > 5
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in found} == brute_join(list(enumerate(texts)))
    alone = ngram_join.jaccard_join(df, count_links=False)
    assert "n_links" not in alone.columns and {x.doc_id: x.component_id for x in alone.collect()} == {x.doc_id: x.component_id for x in found}


def test_ngram_join_of_hot_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL", 4)
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    r = random.Random(9)
    line = "one very common line here"
    texts = [f"{line} " + " ".join(r.choice("abcdefgh") for _ in range(r.choice([0, 1, 1, 2, 3]))) for _ in range(90)]
    texts += [" ".join([*t.split()[:-1], "z"]) for t in texts[:30]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_join(df).collect()}
    assert got == brute_join(list(enumerate(texts)))


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(5, 5), (None, 3)], "a long, b long")
    assert {tuple(r) for r in components(e).collect()} == {(i, 0) for i in range(41)}


def test_components_grow_by_more_links(spark):
    rng = np.random.default_rng(5)
    links = [tuple(int(x) for x in rng.integers(0, 120, 2)) for _ in range(80)]
    links = [x for x in links if x[0] != x[1]]
    own = lambda some: spark.createDataFrame([*some, (None, 3)], "a long, b long")
    labels = components(own(links[:30]))
    for k in (30, 50):
        labels = merged(labels, own(links[k : k + 30]))
    assert {tuple(r) for r in labels.collect()} == {tuple(r) for r in components(own(links)).collect()}
    assert {tuple(r) for r in merged(labels, own(links[:9])).collect()} == {tuple(r) for r in labels.collect()}


def test_token_counts(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    odd = ["It's we'll <|endoftext|> x", "İ Σ ß", "日本語 12", "''s !!'t", "é é", "½ ² ٣", "<|STARTOFTEXT|>", "a_b __ ªº ·", "\x00\x1c", "Hello, WORLD!! 123 'S"]
    odd += [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}" for c in range(0x250)]
    whole = token_counts.whole_tokens(path)
    assert token_counts.count_texts(odd, path, whole) == [len(e.ids) for e in t.encode_batch(odd, add_special_tokens=False)]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, keep=["doc_id"]).collect()}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x, *_ in rows}


def test_license_scan(spark):
    texts = [None, "", "one", "CC-BY-NC cc by nc 4.0 licensed under the GNU General Public License version 3", "é under the MIT license. under the mit License", "under the under the mit license", "Apache License, Version 2.0 x apache license version 2", "all rights reserved"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.license_scan(df).collect()}
    for i, x in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        at = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None)
        assert r.base_labels == ",".join(sorted({label for _, label in at})) and 0 <= r.score <= 1
    assert got[3].labels == "cc-by-nc,cc-by-nc-4.0,gpl-3" and got[7].labels == "proprietary"
    assert len(license_scan.signatures()) > 200


def samples(tree):
    """Texts that a pattern matches: each branch and each optional part once."""
    out = [""]
    for op, arg in tree:
        kind = str(op)
        if kind == "LITERAL":
            new = [chr(arg)]
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            one = samples(arg[2])
            new = [x * arg[0] for x in one[: 1 if not arg[0] else None]] + ([one[-1]] if arg[1] > arg[0] == 0 else [])
        elif kind == "BRANCH":
            new = [x for b in arg[1] for x in samples(b)]
        elif kind == "SUBPATTERN":
            new = samples(arg[3])
        else:
            assert kind == "IN"
            new = ["word"] if str(arg[0][0]) in ("CATEGORY", "NEGATE") else [chr(a) for _, a in arg]
        out = [x + y for x in out[:6] for y in new] if len(out) * len(new) <= 600 else [x + new[k % len(new)] for k, x in enumerate(out)]
    return out


def test_each_license_rule(spark):
    from re import _parser

    texts = []
    for label, rx, gate, priority in license_scan.signatures():
        for t in samples(_parser.parse(rx)):
            t = f" {t} "
            assert re.search(f" (?:{rx})(?= )", t) and f" {gate}" in t and any(r in t for r in license_scan.ROOTS), (label, rx, t)
        texts += [(t.strip(), label, priority), ("word " + " ".join(x + "q" for x in t.split()) + " word", None, priority)]
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(texts)], "doc_id long, text string")
    got = collections.defaultdict(set)
    for r in license_scan.scan(df).collect():
        got[r.doc_id].add((r.label, r.priority, r.kept))
    for k, (text, label, priority) in enumerate(texts):
        found = {(a, p) for a, p, _ in got[k]}
        assert (label, priority) in found if label else not found, (text, label, found)
        assert not label or any(kept for _, _, kept in got[k])


def test_license_wordings(spark):
    want = {
        "Permission is hereby granted, free of charge, to any person": "mit", "Redistribution and use in source and binary forms, with": "bsd", "GNU GPL v2": "gpl-2", "licensed under the LGPL 2.1": "lgpl-2.1",
        "SPDX-License-Identifier: Apache-2.0": "apache-2", "the BSD 3-Clause license": "bsd-3-clause", "GPL-3.0-only": "gpl-3", "LGPLv2.1": "lgpl-2.1", "MPL 2.0": "mpl-2", "nothing of the kind": "", "CC BY-NC-SA 4.0": "cc-by-nc,cc-by-nc-sa-4.0",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.": "gpl-3",
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(want)] + [(0, list(want)[0]), (None, "MPL 2.0")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.labels) for r in license_scan.license_scan(df).collect()), key=str)
    assert got == sorted([(k, x) for k, x in enumerate(want.values())] + [(0, "mit"), (None, "mpl-2")], key=str)


def test_license_scan_of_a_long_text(spark):
    text = "Licensed under the MIT License. " * 40_000
    r = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.labels) == (200_000, 40_000, 1, 199_996, "mit")


def test_license_suppression(spark):
    rows = [(1, "in", 3, 2, 5), (1, "out", 3, 1, 6), (1, "best", 1, 3, 4), (1, "twin", 3, 1, 6), (1, "alone", 6, 8, 9), (2, "in", 3, 2, 5)]
    df = spark.createDataFrame(rows, "doc_id long, label string, priority int, first long, last long")
    kept = {(r.doc_id, r.label) for r in license_scan.suppress(df).where("kept").collect()}
    want = set()
    for a in rows:
        inside = any(a[0] == b[0] and b[3] <= a[3] and b[4] >= a[4] and (b[2] < a[2] or b[2] == a[2] and b[4] - b[3] > a[4] - a[3]) for b in rows)
        if not inside:
            want.add(a[:2])
    assert kept == want


def test_html():
    page = '<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav>m</nav><div class="ad">buy</div><article><h1>Hi &amp; you</h1><p><b>One<br>two<p>three&nbsp;x<ul><li>a<li>b</ul><script>var t="</p>";</script><section class="comments"><p>bad</p></section></article><footer>f</footer></body></html>'
    assert html_extract.main_text(page) == "Hi & you One two three x a b"
    for x, y in (("", ""), (None, ""), ("plain", "plain"), ("<p>a<p>b", "a b"), ("<!-- x", ""), ("<script>x", ""), ('<p title="a>b">c</p>', "c"), ("</p>", ""), ("a<b>b</b>c", "abc")):
        assert html_extract.main_text(x) == y


def test_html_template(spark):
    def page(i):
        return f"<body><div><p>Welcome to our site, read all of it and enjoy</p></div><div><h2>Story {i}</h2><p>{'words of story number %d and more, ' % i * 6}</p></div><div><p>Always the same closing line of the site here</p></div></body>"

    rows = [(i, "http://h.com/x", page(i)) for i in range(8)] + [(99, None, None), (98, "http://one.com", "<p>only</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert all(got[i].startswith(f"Story {i} words of story") and "Welcome" not in got[i] and "closing" not in got[i] for i in range(8))
    assert got[99] == "" and got[98] == "only"


def test_html_template_of_rare_layouts(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "CANDIDATES", 2)
    monkeypatch.setattr(html_extract, "EXEMPLARS", 1)

    def page(kind, i):
        story = f"<h2>Story {kind} {i}</h2><p>{'words of story %s and number %d, ' % (kind, i) * 6}</p>"
        return f"<body>{''.join(f'<div class={kind}{c}>' for c in 'uvwxyz')}{story}<section><p>The closing line of layout {kind} here</p></section></body>"

    rows = [(100 * k + i, "http://h.com/x", page(kind, i)) for k, kind in enumerate("abcdef") for i in range(9 - k)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert len(got) == len(rows) and all(t.startswith("Story") and "closing" not in t for t in got.values()), got


def test_html_template_inside_a_marked_article(spark):
    def page(i):
        return f"<body><article><p>Read our other stories at the end of this page</p><h1>Story {i}</h1><p>{'words of story number %d and more, ' % i * 6}</p><p>The same closing line of the site</p></article></body>"

    df = spark.createDataFrame([(i, "http://h.com/x", page(i)) for i in range(8)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert all(got[i].startswith(f"Story {i} words") and "closing" not in got[i] and "Read our" not in got[i] for i in range(8))


def test_html_template_of_layouts_and_pairs(spark):
    def page(host, i, kind):
        story = f"<h2>Story {i}</h2><p>{'words of story number %d and more, ' % i * 6}</p>"
        a = f"<body><div><p>Notice on all pages of {host}</p></div><div>{story}</div></body>"
        b = f"<body><section><p>Another notice of the minor layout</p>{story}</section></body>"
        return (i, f"http://{host}/{i}", (a, b, "", "no tags")[kind])

    rows = [page("big", i, 0 if i % 10 > 1 else i % 10 + 1 if i % 20 < 10 else 1) for i in range(100)] + [page("big", 900, 3)]
    rows += [page("two", 1000 + i, 0) for i in range(2)] + [page("copies", 2000, 0)] * 3
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    for i, _, text in rows:
        assert got[i] == ("" if not text else text if i == 900 else got[i])
        assert not text or i == 900 or f"Story {i} words" in got[i] and (i == 2000 or "otice" not in got[i])


def random_shape(r, depth=3):
    keys, kids = [], []

    def grow(key, left):
        at = len(keys)
        keys.append(key)
        kids.append([])
        for _ in range(r.randint(0, 3) if left else 0):
            kids[at].append(grow(r.choice("abc"), left - 1))
        return at

    grow("root", depth)
    return html_extract.Shape(keys, kids)


def test_tree_matching_against_brute_force():
    def brute(a, b, i, j):
        if a.keys[i] != b.keys[j]:
            return 0
        xs, ys = a.kids[i], b.kids[j]

        def rest(x, y):  # every way to pair children in order
            if x == len(xs) or y == len(ys):
                return 0
            return max([rest(x + 1, y)] + [brute(a, b, xs[x], ys[k]) + rest(x + 1, k + 1) for k in range(y, len(ys))])

        return 1 + rest(0, 0)

    r = random.Random(8)
    for _ in range(150):
        a, b = random_shape(r), random_shape(r)
        n, found = html_extract.align(a, b)
        assert n == brute(a, b, 0, 0) == len(found)
        assert all(a.keys[i] == b.keys[j] for i, j in found.items()) and len(set(found.values())) == n
        up = [{c: i for i, own in enumerate(t.kids) for c in own} for t in (a, b)]
        assert all(found[up[0][i]] == up[1][j] for i, j in found.items() if i)
        assert html_extract.align(a, a)[0] == len(a.keys)
        back = html_extract.Shape.read(a.written())
        assert (back.keys, back.kids) == (a.keys, a.kids)


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<a " * 1_700_000, "<div>x" * 50_000, "<b><h2>" * 30_000 + "<li>" * 30_000, "<a \"x'" * 200_000 + ">", "<header>" * 50_000 + "x", "</p>" * 100_000, "<" * 1_000_000])
def test_html_of_any_depth(page):
    html_extract.main_text(page, html_extract.Template([html_extract.Shape(["root"], [[]])], {(0, 0, 0)}))


def test_html_hidden_and_class_words():
    assert html_extract.main_text("<div hidden>secret words</div><p>x y z</p>") == "x y z"
    assert html_extract.main_text('<article><p class="alert">stays</p><p class="ad">goes</p><div class="notice">goes</div><div class="side">stays</div></article>') == "stays stays"


def test_html_template_changes_real_pages(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    line = "<p>Read our other stories below, updated every day</p></article>"
    with_line = pages.withColumn("html", F.replace("html", F.lit("</article>"), F.lit(line)))
    plain = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    got = {r.page_id: r.text for r in html_extract.extract(with_line).collect()}
    hosts = collections.Counter(r.h for r in pages.select(html_extract.host_of("url").alias("h")).collect())
    many = {r.page_id for r in pages.select("page_id", html_extract.host_of("url").alias("h")).collect() if hosts[r.h] > 1}
    assert len(many) > 10 and sum("updated every day" not in got[i] for i in many) >= 0.9 * len(many)
    assert all(got[i] in (plain[i], plain[i] + " Read our other stories below, updated every day") for i in plain)
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", -1)
    assert {r.page_id: r.text for r in html_extract.extract(with_line).collect()} == got
    none = spark.createDataFrame([(1, None, "<p>a b</p>"), (1, None, "<p>a b</p>"), (2, None, None)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract(none).collect()) == [(1, "a b", 3), (1, "a b", 3), (2, "", 0)]
    assert html_extract.extract(none.limit(0)).count() == 0


def test_lm_score(docs, rows):
    got = {r.doc_id: r for r in lm_scoring.score(docs, K.crc_mod("doc_id", 7) == 2).collect()}
    c, ends = collections.Counter(), 0
    for i, t, *_ in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update((t or "").encode().lower().split())
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        want = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        r = got[i]
        assert abs(want - r.base_score) < 1e-6 and r.n_tokens == len(w) + 1 and r.n_known == sum(c[x] > 0 for x in w) + 1 and r.train_tokens == n
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2) and math.isfinite(r.score)


def test_lattice_is_the_sum_over_segmentations():
    pieces = {"▁": -1.0, "a": -2.0, "b": -2.5, "ab": -1.2, "▁a": -0.7, "ba": -3.0}
    lattice = lm_scoring.Lattice(pieces, [-9.0] * 256)

    def total(s):
        return 1.0 if not s else sum(math.exp(p) * total(s[len(w) :]) for w, p in pieces.items() if s.startswith(w))

    for w in ("abab", "aab", "b", "bba"):
        assert abs(lattice.word(w) - math.log10(total("▁" + w))) < 1e-9
    assert lattice.word("é") == pytest.approx((-1.0 - 18.0) / math.log(10))


def test_expected_pieces_over_all_segmentations():
    pieces = {"▁": -1.0, "a": -2.0, "b": -2.5, "ab": -1.2, "▁a": -0.7, "ba": -3.0}
    lattice = lm_scoring.Lattice(pieces, [-9.0] * 256)

    def ways(s):
        return [[]] if not s else [[w, *rest] for w in pieces if s.startswith(w) for rest in ways(s[len(w) :])]

    for word in ("abab", "aab", "b", "bba"):
        total = [0.0] * (len(pieces) + 256)
        lattice.expect(word, 3, total)
        weights = [(math.exp(sum(pieces[x] for x in w)), w) for w in ways("▁" + word)]
        z = sum(p for p, _ in weights)
        want = [3 * sum(p * w.count(x) for p, w in weights) / z for x in pieces]
        assert total[: len(pieces)] == pytest.approx(want) and not any(total[len(pieces) :])
    total = [0.0] * (len(pieces) + 256)
    lattice.expect("é" * 200, 1, total)
    assert sum(total[len(pieces) :]) == pytest.approx(400) and sum(total[: len(pieces)]) < 20


def test_language_id(spark):
    r = random.Random(2)
    pools = {"aa": "abcde", "zz": "vwxyz", "mm": "klmno"}
    rows = [(i, "".join(r.choice(pools[k] + " ") for _ in range(200)), k) for i in range(90) for k in [list(pools)[i % 3]]]
    rows += [(900, None, "aa"), (901, "123 !!", "aa"), (902, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, train=K.crc_mod("doc_id", 5) != 0)
    got = {x.doc_id: x for x in language_id.identify(df.withColumn("score", F.lit("clash")), model).collect()}
    assert all(got[i].lang_pred == k and 0 <= got[i].score <= 1 for i, _, k in rows[:90])
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert language_id.identify(df, language_id.fit(df.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_decontamination(spark):
    r = random.Random(4)
    vocab = [f"w{k}" for k in range(3000)]
    words = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(k, words(30)) for k in range(6)] + [(6, ["tiny", "item", "here"]), (7, []), (8, words(9))]
    near = list(items[1][1])
    near[7], near[19] = "changed", "again"
    docs = [(1, words(50) + items[0][1] + words(20)), (2, words(9) + near + words(5)), (3, words(200)), (4, items[2][1][:6] + words(40)), (5, ["so", "Tiny", "item,", "here", "ok"]), (6, words(4) + items[8][1])]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs] + [(7, None), (8, "")], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(50, None)], "item_id long, text string")
    for limit in (1 << 20, 0):
        got = {(x.doc_id, x.item_id) for x in decontam.contaminated(d, b, broadcast_bytes=limit).collect()}
        assert got == {(1, 0), (2, 1), (5, 6), (6, 8)}
    assert decontam.contaminated(d, b.limit(0)).count() == 0


def test_decontamination_finds_all_substitutions(spark):
    r = random.Random(6)
    items, docs, want = [], [], {}
    for n in [*range(8, 60), 200]:
        for kind in range(4):
            k = len(items)
            item = [f"v{k}x{j}" for j in range(n)]
            most = n - (n * 3 + 3) // 4
            at = range(kind, n, 4) if kind < 3 else r.sample(range(n), most)
            at = list(at)[:most]
            items.append((k, " ".join(item)))
            new = ["other" if j in at else w for j, w in enumerate(item)]
            docs.append((k, " ".join([f"a{r.randrange(10**9)}" for _ in range(9)] + new + ["z"] * r.randrange(9))))
            places = [9 + j for j in range(n) if j not in at]
            want[k] = (len(places), places[0], places[-1])
    for n, at in ((15, (3, 7, 11, 14)), (8, (1, 3, 5)), (7, (3,))):
        k = len(items)
        items.append((k, " ".join(f"v{k}x{j}" for j in range(n))))
        docs.append((k, " ".join("other" if j in at else f"v{k}x{j}" for j in range(n))))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 20, 0):
        got = {x.doc_id: (x.item_id, x.n_match, x.first_word, x.last_word) for x in decontam.contaminated(d, b, broadcast_bytes=limit).collect()}
        assert got == {k: (k, *x) for k, x in want.items()}


def test_decontamination_overlap_is_the_best_window():
    r = np.random.default_rng(3)
    for _ in range(300):
        same = r.random(int(r.integers(1, 50))) < 0.7
        item = np.arange(len(same))
        n, first, last = decontam.overlap(np.where(same, item, -1), item, 0, 0.75)
        assert n == max(int(same[i:j].sum()) if same[i:j].sum() >= 0.75 * (j - i) else 0 for j in range(len(same) + 1) for i in range(j + 1))
        assert n == 0 or (same[first] and same[last] and same[first : last + 1].sum() == n >= 0.75 * (last + 1 - first))


def test_waterfill_and_allocation():
    assert mixing.waterfill(10, [(1, 2), (1, 100), (2, 100)]) == pytest.approx([2, 8 / 3, 16 / 3])
    leaves = {("a", "en", "a1"): 10, ("a", "fr", "a1"): 100, ("b", "en", "b1"): 1000}
    got = mixing.allocate(leaves, 200, lambda p: 1.0, 1)
    assert got == pytest.approx({("a", "en", "a1"): 10, ("a", "fr", "a1"): 90, ("b", "en", "b1"): 100})
    got = mixing.allocate(leaves, 400, lambda p: 1.0, 1)  # a is short, and b takes what is left
    assert got == pytest.approx({("a", "en", "a1"): 10, ("a", "fr", "a1"): 100, ("b", "en", "b1"): 290})


def test_mixing(docs, rows):
    got = mixing.mix(docs, share=0.4).collect()
    tokens = {i: len((t or "").encode().split()) for i, t, *_ in rows}
    assert all(r.n_tokens == tokens[r.doc_id] > 0 for r in got)
    leaves, taken = collections.Counter(), collections.Counter()
    largest = collections.Counter()
    for i, _, lang, source, _ in rows:
        k = (re.sub("[0-9]$", "", source or ""), lang or "", source or "")
        leaves[k] += tokens[i]
        largest[k] = max(largest[k], tokens[i])
    for r in got:
        taken[r.domain, r.lang, r.source] += r.n_tokens
    want = mixing.allocate({k: n for k, n in leaves.items() if n}, 0.4 * sum(tokens.values()), lambda p: 1.0, 2)
    for k, w in want.items():
        assert w - 1e-6 <= taken[k] < w + largest[k] + 1e-6
    assert sorted(mixing.mix(docs.repartition(3), share=0.4).collect()) == sorted(got)


def levelled(budget, nodes):
    """Shares by a common level of budget for each unit of weight, found by bisection."""
    top = max([c / w for w, c in nodes if w > 0] + [0.0])
    if budget >= sum(c for w, c in nodes if w > 0):
        return [c if w > 0 else 0.0 for w, c in nodes]
    lo, hi = 0.0, top
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(c, mid * w) for w, c in nodes) < budget else (lo, mid)
    return [min(c, lo * w) for w, c in nodes]


def test_waterfill_is_a_common_level():
    r = random.Random(1)
    for _ in range(300):
        nodes = [(r.choice([0, 1, 2, 0.5]), r.choice([0, 3, 10, 100.5])) for _ in range(r.randint(0, 8))]
        budget = r.uniform(0, 150)
        assert mixing.waterfill(budget, nodes) == pytest.approx(levelled(budget, nodes), abs=1e-6)


def test_mixing_against_brute_force(docs, rows, monkeypatch):
    got = {(r.doc_id, r.epoch) for r in mixing.mix(docs, share=0.7).collect()}
    tokens = {i: len((t or "").encode().split()) for i, t, *_ in rows}
    leaf = {i: (re.sub("[0-9]$", "", source or ""), lang or "", source or "") for i, _, lang, source, _ in rows}
    cap = collections.Counter()
    for i, n in tokens.items():
        cap[leaf[i]] += n
    cap = {k: 2 * n for k, n in cap.items() if n}

    def down(at, share):
        if len(at) == 3:
            return {at: share}
        below = sorted({k[: len(at) + 1] for k in cap if k[: len(at)] == at})
        out = {}
        for p, x in zip(below, levelled(share, [(1, sum(c for k, c in cap.items() if k[: len(p)] == p)) for p in below]), strict=True):
            out |= down(p, x)
        return out

    budgets = down((), 0.7 * sum(tokens.values()))
    hashes = {e: {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(17), F.lit(e)).alias("h")).collect()} for e in (0, 1)}
    want = set()
    for k, budget in budgets.items():
        own = [i for i in tokens if leaf[i] == k and tokens[i]]
        for e in (0, 1):
            left = min(cap[k] / 2, budget - e * cap[k] / 2)
            for i in sorted(own, key=lambda i: (hashes[e][i] % 2**64, i)):
                if left > 1e-6:
                    want.add((i, e))
                    left -= tokens[i]
    assert got == want
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", -1)
    assert {(r.doc_id, r.epoch) for r in mixing.mix(docs, share=0.7).collect()} == got


def test_vector_search(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[200:300] = x[7]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(5000, None, 0), (5001, [0.0] * 16, 0), (5002, [float("nan")] * 16, 0), (5003, [1.0, None] + [0.0] * 14, 0), (5050, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("leaf", F.lit(1))
    got = collections.defaultdict(list)
    for r in vector_search.search(df, df.where("vec_id % 50 = 0")).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    y, hit = x.astype(np.float64), 0
    for q in range(0, 1500, 50):
        s = vector_search.cosine(y[q], y)
        s[q] = -9
        best = np.lexsort((np.arange(1500), -s))[:5]
        own = sorted(got[q])
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and all(abs(sc - s[v]) < 1e-12 for _, v, sc in own)
        hit += len({v for _, v, _ in own} & set(best.tolist()))
    assert set(got) == set(range(0, 1500, 50)) and hit / 150 >= 0.9
    assert vector_search.search(df.limit(0), df.limit(0)).count() == 0


def test_vector_search_in_many_cells(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(1, 8)) + 0.01 * rng.normal(size=(700, 8)), rng.normal(size=(300, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(50, x[50].tolist())], "vec_id long, embedding array<double>")
    want = sorted(vector_search.search(df, df.where("vec_id % 10 = 0"), recall=1.0).collect())
    monkeypatch.setattr(vector_search, "CELL_BYTES", 0)
    grid = vector_search.Grid(np.array([700.0, 1.0, 100.0, 200.0]), np.array([300.0, 1.0, 1.0, 1.0]), 256)
    assert grid.first.tolist() == [0, 6, 6, 7] and grid.cells == 8
    assert sorted(vector_search.search(df, df.where("vec_id % 10 = 0"), recall=1.0).collect()) == want
    near = vector_search.cosine(x[10], x)
    near[10] = -9
    assert [r.vec_id for r in want if r.query_id == 10] == np.lexsort((np.arange(1000), -near))[:5].tolist()


def test_vector_search_with_many_copies(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 16)).astype(np.float32)
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    asked = [q for q in range(0, 6000, 50) if q % 3]
    got = collections.defaultdict(set)
    for r in vector_search.search(df, df.where("vec_id % 50 = 0 and vec_id % 3 <> 0")).collect():
        got[r.query_id].add(r.vec_id)
    y, hit = x.astype(np.float64), 0
    for q in asked:
        s = vector_search.cosine(y[q], y)
        s[q] = -9
        hit += len(got[q] & set(np.lexsort((np.arange(6000), -s))[:5].tolist()))
    assert hit / (5 * len(asked)) >= 0.9


def test_empty_and_clashing_columns(spark, none, clash, rows):
    ids = {r[0] for r in rows}
    for d, want in ((none, set()), (clash, ids)):
        assert {r.doc_id for r in suffix_dedup.dedup_windows(d).collect()} == want
        assert {r.doc_id for r in ngram_join.jaccard_join(d).collect()} == want
        assert {r.doc_id for r in token_counts.token_counts(d, keep=["doc_id"]).collect()} == want
        assert {r.doc_id for r in license_scan.license_scan(d).collect()} == want
        assert {r.doc_id for r in lm_scoring.score(d, K.crc_mod("doc_id", 7) == 2).collect()} == want
        assert {r.doc_id for r in mixing.mix(d).collect()} <= want


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline as P

    docs.drop("cache").write.parquet(str(tmp_path / "documents.parquet"))
    item = [r.text for r in docs.where("doc_id = 30").collect()][0]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = P.run(spark, str(tmp_path))
    assert {"doc_id", "text", "epoch"} <= set(got.columns) and got.count() > 0
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    near = brute_join([(r.doc_id, r.text) for r in d.collect()])
    kept = {r.doc_id for r in P.drop_near_duplicates(spark, d, "").collect()}
    assert kept == {i for i, (_, c) in near.items() if c == i}
    assert P.drop_contaminated(spark, d, str(tmp_path)).where("doc_id = 30").count() == 0
    assert all(f(spark, d, str(tmp_path)).columns == d.columns for _, f in P.STAGES[:-1])


def test_repeated_rows(spark):
    import corpus_pipeline as P

    long = " ".join(f"word{k}" for k in range(60))
    rows = [(1, long, "en", "s1", len(long))] * 2 + [(2, "a short text", "en", "s1", 12)] * 2 + [(3, "another one", "en", "s1", 11)]
    d = spark.createDataFrame(rows, DOCS)
    got = sorted((r.doc_id, r.n_bytes - r.n_removed) for r in suffix_dedup.dedup_windows(d).collect())
    assert got == [(1, 0), (1, len(long)), (2, 12), (2, 12), (3, 11)]
    assert sorted((r.doc_id, r.text) for r in P.drop_repeated_passages(spark, d, "").collect()) == [(1, long), (2, "a short text"), (2, "a short text"), (3, "another one")]
    mixed = [(r.doc_id, r.epoch) for r in P.mix_sources(spark, d, "").collect()]
    assert max(collections.Counter(mixed).values()) <= 2 and {r.n_tokens for r in P.mix_sources(spark, d, "").collect()} <= {60, 3, 2}
    joined = sorted((r.doc_id, r.component_id) for r in ngram_join.jaccard_join(d).collect())
    assert joined == [(1, 1), (1, 1), (2, 2), (2, 2), (3, 3)]
    held = F.col("doc_id") == 3
    one = {r.doc_id: r for r in lm_scoring.score(d, held).collect()}
    assert sorted(r.doc_id for r in lm_scoring.score(d, held).collect()) == [1, 1, 2, 2, 3]
    assert one[2].n_tokens == 4 and one[2].n_known == 4 and one[1].n_known == 61
