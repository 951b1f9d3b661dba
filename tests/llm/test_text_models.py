"""Language, quality, licences, decontamination, page text and the pipeline."""

import html
import os
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from offerloom.llm import decontam, htmltext, langid, licences, quality
from offerloom.llm.features import NAMES, features
from offerloom.llm.words import NAME, NUMBER, UNIT, words

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def in_fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_language_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()}
    rows = langid.op1(spark, SF2).collect()
    assert {r.doc_id for r in rows} == set(truth) and all(r.held_out == in_fold(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_language_edge_cases(spark):
    train = spark.createDataFrame([(i, "the quick brown fox jumps over the lazy dog " * 3 if i % 2 else "der schnelle braune fuchs springt auf den faulen hund " * 3, "en" if i % 2 else "de") for i in range(60)], "doc_id long, text string, lang string")
    filters = langid.train(train)
    rows = [(1, None), (2, ""), (3, "12 !"), (4, "the brown dog"), (5, "der braune hund"), (6, "中文文本" * 40), (7, "the lazy dog " * 3000), (None, "the fox")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, score string, row int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, filters).collect()}
    assert {i: got[i][0] for i in (1, 2, 3, 4, 5, 7, None)} == {1: "und", 2: "und", 3: "und", 4: "en", 5: "de", 7: "en", None: "en"}
    assert got[6][0] in ("en", "de") and got[1][1] == 0
    kept = langid.drop_unknown(docs, filters)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([4, 5, 7, None], key=str)
    nothing = langid.train(train.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), filters).count() == 0


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(5)
    text = lambda vocabulary, n: " ".join(rng.choice(vocabulary, n))
    tongues = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(4, 9))) for _ in range(30)] for _ in range(140)]
    ids = [i for i in range(3000) if not in_fold(i)]
    rows = [(ids.pop(), text(v, 120), f"l{k:03}") for k, v in enumerate(tongues) for _ in range(1 if k % 70 == 69 else 2 if k % 70 == 68 else 6)]
    filters = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), slot_bits=16)
    assert filters.languages == [f"l{k:03}" for k in range(140)]
    new = [(k, text(v, 60)) for k, v in enumerate(tongues)]
    docs = spark.createDataFrame(new, "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(docs, filters).collect()} == {k: f"l{k:03}" for k in range(140)}
    assert langid.drop_unknown(docs, filters).count() == 140


def test_false_positives_are_corrected():
    full = langid.Filters(["a", "b"], np.full(1 << 10, 1, np.uint8))  # every slot of a is set: it says nothing
    counts, _, _ = full.scores(["some text of letters"])
    assert counts[0, 1] == 0 and counts[0, 0] <= 20
    half = np.zeros(1 << 10, np.uint8)
    half[::2] = 1
    counts, totals, _ = langid.Filters(["a", "b"], half).scores(["quite some random letters here " * 30])
    assert counts[0, 0] < 0.2 * totals[0]  # a quarter of the look-ups hit by chance


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF2}/labels.parquet").collect()}
    rows = quality.op9(spark, SF2).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    good = [r.score for r in held if labels[r.doc_id]]
    bad = [r.score for r in held if not labels[r.doc_id]]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 2, "a"), (2, "", 3, "b"), (3, "plain text " * 20000, 4, "c"), (None, "x", 5, "d")], "doc_id long, text string, score int, predicted string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5}
    assert quality.drop_poor(docs, model).count() == 4
    assert features([None, "", " \n", "A"]).shape == (4, len(NAMES)) and not np.isnan(features([None, "", "!!!", "ÉTÉ x"])).any()
    assert quality.score(docs.limit(0), model).count() == 0


def test_pairs_are_learned():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert model.pairs[0][:2] == (0, 1) and np.mean((model.score(x) > 0.5) == y) > 0.95


def test_words_and_kinds():
    text = "Hello Bob has 12kg of 3.5 m.\nThen Ann: Zoe 1,000 Été"
    w = words([text, "", "x"])
    assert [text[a:b] for a, b, d in zip(w.start, w.end, w.doc) if d == 0] == ["Hello", "Bob", "has", "12", "kg", "of", "3.5", "m", "Then", "Ann", "Zoe", "1,000", "Été"]
    assert w.kind.tolist() == [0, NAME, 0, NUMBER, UNIT, 0, NUMBER, UNIT, 0, NAME, 0, NUMBER, NAME, 0]


def test_licences_match_a_full_alignment():
    index = licences.Index(licences.LICENCES)
    mit = dict(licences.LICENCES)["MIT"]
    noisy = re.sub("merge, publish", "merge and publish", mit).upper().replace("WITHOUT LIMITATION", "")
    texts = ["before " + noisy + " after", "Released under the MIT License. " * 3, "nothing here", "", mit[: len(mit) // 2]]
    got = {(d, n) for d, n, *_ in index.matches(texts)}
    want = set()
    for d, t in enumerate(texts):
        own = words([t]).value
        for k, name in enumerate(index.names):
            template = index.values[k]
            if len(own) and licences.align(template, own, 0, len(own) + len(template))[0] >= licences.COVERAGE * len(template):
                want.add((d, name))
    assert got == want == {(0, "MIT"), (1, "MIT-notice")}
    spans = [m for m in index.matches(texts) if m[0] == 1]
    assert [texts[1][a:b] for _, _, a, b, _, _ in spans] == ["Released under the MIT License"] * 3


def test_licences_with_words_put_in_and_cut_out():
    index = licences.Index(licences.LICENCES)
    texts, want = dict(licences.LICENCES), {}
    rng = random.Random(5)
    filler = "amber birch cedar delta ember frost grove heron iris jade".split()
    docs = []
    for name in ("MIT", "BSD-2-Clause", "Apache-2.0", "GPL-3.0-or-later"):
        plain = texts[name].split()
        for put, cut, parts in ((12, 0, 1), (30, 0, 1), (0, 12, 1), (10, 5, 2), (20, 0, 3)):
            own = list(plain)
            for k in range(parts):  # one change in each of the equal parts, from the last one
                at = len(own) * (parts - k) // (parts + 1)
                own[at : at + cut] = [rng.choice(filler) + str(rng.randrange(99)) for _ in range(put)]
            docs.append("some words before " + " ".join(own) + " and some after")
            want[len(docs) - 1] = name
    docs.append(" ".join(texts["MIT"].split()[:40]))  # a part alone is no copy
    docs.append(" ".join(texts["MIT"].split()[40:] + texts["MIT"].split()[:40]))  # nor are parts in another order
    got = index.matches(docs)
    for d, text in enumerate(docs):
        own = words([text]).value
        for k, name in enumerate(index.names):
            template = index.values[k]
            wide = np.full(len(template), len(own) + len(template))
            matched, first, last = licences.align_chain(template, own, -wide, wide)  # every place may meet every word
            full = matched >= licences.COVERAGE * len(template)
            assert full == any((d, name) == m[:2] for m in got), (d, name, matched)
    for d, name in want.items():
        (_, _, a, b, matched, size), *more = [m for m in got if m[:2] == (d, name)]
        assert not more and docs[d][a:b].lower().startswith(texts[name].split()[0].lower()) and matched >= 0.8 * size
        assert docs[d][b:].strip(" .") == "and some after"


def test_licence_chains_in_a_long_text_of_broken_copies():
    index = licences.Index(licences.LICENCES)
    own = dict(licences.LICENCES)["MIT"].split()
    broken = " ".join(own[:40] + ["x"] * 12 + own[40:])
    found = [m for m in index.matches([f"{broken} . " * 400]) if m[1] == "MIT"]
    assert len(found) == 400 and len({m[2] for m in found}) == 400 and all(m[4] == m[5] for m in found)


def test_licence_query(spark):
    lines = [t for n, t in licences.LICENCES if n.endswith("notice")]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()}
    got = {(r.doc_id, docs[r.doc_id][r.start : r.end]) for r in licences.op2(spark, SF2).collect() if r.coverage == 1}
    assert got == {(i, line.rstrip(".")) for i, t in docs.items() for line in lines if line in t}
    odd = spark.createDataFrame([(None, lines[0], 1), (1, None, 2), (2, "", 3), (3, lines[0], 4), (3, lines[0], 4)], "doc_id long, text string, start int")
    assert sorted((r.doc_id for r in licences.licence_spans(odd).collect()), key=str) == [3, 3, None]
    assert licences.licence_spans(odd, [("a", "one two three four"), ("b", "five six seven eight")]).count() == 0
    with pytest.raises(ValueError):
        licences.licence_spans(odd, [("a", "too short")])


ITEM = "A farmer in the village sells 12 apples to Bob and 30 pears to Ann , then buys 12 plums from her neighbour near the old mill"


def test_slots_must_be_consistent(spark):
    bench = spark.createDataFrame([(1, ITEM, "x"), (1, ITEM, "x"), (2, "one two three four five", "x"), (3, "too short", "x"), (4, None, "x"), (5, "", "x")], "item_id long, text string, h string")
    other = ITEM.replace("12", "7").replace("30", "99").replace("Bob", "Tom").replace("Ann", "Eve")
    broken = ITEM.replace("12 apples", "7 apples")  # 12 stands for two different numbers
    rows = [(1, "start of it. " + ITEM + " and on"), (2, "x " + other + " y"), (3, broken), (4, "nothing of it " * 50), (5, None), (6, ""), (None, ITEM), (7, "so one two three four five it is"), (8, ITEM), (8, ITEM), (9, "pad " * 30000 + ITEM), (10, ITEM[:40])]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, row int, size int")
    found = decontam.contaminated(docs, bench)
    assert sorted(((r.doc_id, r.item_id) for r in found.collect()), key=str) == sorted([(1, 1), (2, 1), (None, 1), (7, 2), (8, 1), (8, 1), (9, 1)], key=str)
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 10]
    assert decontam.contaminated(docs.limit(0), bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


STORY = "Tom has 3 red apples.\nAnn gives him 5 more of them.\nTom eats 2 of these apples. How many apples are left over for Ann now?"


def test_copies_of_every_form_are_found(spark):
    items = [(1, "What is 12 * 15 + 3?"), (2, "Convert 5 km , 7 km , 9 km and 11 km to miles"), (3, STORY), (4, "3 1 4 1 5 9 2 6 5 3 5 8 9 7 9")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    renamed = STORY.replace("Tom", "Max").replace("Ann", "Eve").replace("3", "8")
    merged = STORY.replace("5", "4").replace("3", "4").replace("2", "4")  # three numbers of the item have one value
    rows = [(1, "so: " + items[0][1]), (2, "x " + items[1][1] + " y"), (3, renamed), (4, STORY.lower()), (5, "He said that " + STORY.replace("\n", " ").replace(".", " ;")), (6, merged), (7, STORY.lower().replace("3", "8")), (8, items[3][1])]
    rows += [(20, "What is 12 * 15 + 4?"), (21, "3 1 4 1 5 9 2 7 5 3 5 8 9 7 9"), (22, STORY.replace("Tom", "Max", 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    assert {x for x in found if x[0] < 20} == {(1, 1), (2, 2), (3, 3), (4, 3), (5, 3), (6, 3), (7, 3), (8, 4)}
    assert not found & {(20, 1), (21, 4)}


def test_decontamination_query_finds_verbatim_items(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF2}/benchmark.parquet").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    assert want and {(r.doc_id, r.item_id) for r in decontam.op10(spark, SF2).collect()} == want


def test_page_query(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = htmltext.op6(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_page_text_edge_cases():
    text = """<html><body><header class=site><a>Logo</a></header><nav>x</nav><main><article><header><h1>T&eacute;st &amp; co</h1></header><p>One<b>two</b> three<p>Four<ul><li>a<li>b
    <ul><li>c</ul><li>d</ul><div class="share-buttons">S</div><pre>x  y</pre><section class="comments"><p>hi</p></section><div id="cookie-notice">C</div><form>f<p>g</p></form>tail</article>
    <aside>z</aside></main><div class="related"><article>no</article></div><footer>f</footer>"""
    assert htmltext.Page(text).main_text(set()) == "Tést & co\n\nOnetwo three\n\nFour\n\na\n\nb\n\nc\n\nd\n\nx y\n\ntail"
    for odd in (None, "", "<", "<p", "<" * 5000, "<p>" * 2000, "</p></div>", "<script>x", "<!-- x"):
        htmltext.Page(odd, True).main_text(set())


def test_style_tree_cuts_what_a_site_repeats(spark):
    pages = [(i, f"http://s.example/{i}", f"<body><div class=top><span>Our site</span><a>Home</a></div><div class=body><p>Story {i} tells of {i * 7} things.</p></div><div class=end>All rights</div></body>") for i in range(8)]
    pages += [(100, None, "<p>alone</p>"), (None, "not a url", None), (101, "http://t.example/", "<div class=top>Only page</div>")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, host int")
    got = {r.page_id: r.text for r in htmltext.main_text(df).collect()}
    assert {r.page_id: r.text for r in htmltext.main_text(df, broadcast_paths=0).collect()} == got
    assert {i: got[i] for i in range(8)} == {i: f"Story {i} tells of {i * 7} things." for i in range(8)}
    assert (got[100], got[None], got[101]) == ("alone", "", "Only page")
    assert htmltext.main_text(df.limit(0)).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    kept, columns = docs, docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = corpus_pipeline.written(stage(spark, kept, SF2))
        assert kept.columns == columns, name
        counts.append(kept.count())
    assert counts[0] >= counts[1] > counts[2] > counts[3] > counts[4] > 0
    items = [r.text for r in spark.read.parquet(f"{SF2}/benchmark.parquet").collect()]
    final = {r.doc_id: r.text for r in kept.collect()}
    assert not any(i in t for t in final.values() for i in items)
    assert len(set(final.values())) == len(final)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF2}/labels.parquet").collect()}
    assert not any(labels.get(i) == 0 for i in final)
    pieces = corpus_pipeline.run(spark, SF2)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(final)


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.createDataFrame([(1, "some words of text here", None, "a", 1, 9), (None, None, "en", None, None, None), (1, "some words of text here", "en", "a", 1, 9), (2, "", None, None, 0, 1)], "doc_id long, text string, lang string, source string, n_chars long, score int")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, rows, str(tmp_path))
            assert out.columns == docs.columns, name
            out.collect()


def _texts(spark, pages):
    rows = [(i, f"http://{host}/{i}", html) for i, (host, html) in enumerate(pages)]
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [got[i] for i in range(len(rows))]


def test_style_tree_decides_inside_and_outside_articles(spark):
    body = lambda i: f"Story {i} tells of {i * 7} things and more. " * 5
    notice = "<div class='readers'><p>Support us.</p></div>"
    # A notice with a container of its own goes; a paragraph and headings that all articles share stay.
    noticed = [("a.x", f"<div class=top>Site</div><article><h2>Introduction</h2><p>{body(i)}</p>{notice}<p>All rights are shared.</p></article>") for i in range(8)]
    # A card in an article element is not the text of a page whose body is long.
    cards = [("b.x", f"<div class=top>Site</div><article><p>Card {i}</p></article><div class=text><p>{body(i)}</p></div><div class=end>About us</div>") for i in range(8)]
    # Copies of one page are alike everywhere, so nothing is told apart by how it varies.
    copies = [("c.x", f"<div class=text><p>{body(1)}</p></div>") for _ in range(8)]
    # Names made of headings are no names of menus.
    named = [("d.x", f"<article><h2 id='search-algorithms'>Search {i}</h2><section id='legal-history'><p class=teaser>Lead {i}</p></section><div id='related-work'>{body(i)}</div><div id=comments>Reader {i}</div><div class='social-share'>Share {i}</div></article>") for i in range(8)]
    got = _texts(spark, noticed + cards + copies + named)
    text = lambda i: body(i).strip()
    assert got[:8] == [f"Introduction\n\n{text(i)}\n\nAll rights are shared." for i in range(8)]
    assert got[8:16] == [f"Card {i}\n\n{text(i)}" for i in range(8)]
    assert got[16:24] == [text(1)] * 8
    assert got[24:] == [f"Search {i}\n\nLead {i}\n\n{text(i)}" for i in range(8)]


def test_importance_against_brute_force(spark):
    import math
    from collections import Counter, defaultdict

    html = [f"<div class=top>{'Menu' if i % 4 else f'Sale {i}'}</div><div class=text><p>Body {i}</p>{'<ul><li>x</li></ul>' if i % 3 == 0 else ''}</div>" for i in range(12)]
    pages = spark.createDataFrame([("h", h) for h in html], "host string, html string")
    seen = defaultdict(lambda: (Counter(), Counter()))
    for h in html:
        for path, root, shown, content in set(htmltext.Page(h, True).branches):
            seen[path, root][0][shown] += 1
            seen[path, root][1][content] += 1

    def entropy(counts):
        m = sum(counts.values())
        return sum(-n / m * math.log(n / m) for n in counts.values()) / math.log(m) if m > 1 else 1.0

    got = {(r.path, r.root): (r.pages, r.importance) for r in htmltext.style_tree(pages).collect()}
    assert set(got) == set(seen)
    for key, (shown, content) in seen.items():
        assert got[key][0] == sum(content.values())
        assert got[key][1] == pytest.approx(0.7 * entropy(content) + 0.3 * entropy(shown))
