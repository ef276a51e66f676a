"""Toxicity, language mixture, HTML text and token counts."""

import math
import os
import random
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from helpers import documents  # noqa: E402

from drawpool.llm import html_text, language_mixture, queries, token_counts, toxicity  # noqa: E402
from drawpool.llm.textgrid import ALNUM, NONSPACE, blocks  # noqa: E402

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "x" * 50_000), (5, "das ist ein haus " * 4000), (6, "12345 !!"), (7, "日本"), (7, "日本"), (None, "the house")]


# ---- toxicity

def _network(seed=0):
    rng = np.random.default_rng(seed)
    net = toxicity.Network(np.arange(10, dtype=np.uint64), rng.standard_normal(11), np.zeros(0, np.uint64), np.zeros(1), seed)
    for v in net.p.values():
        v += rng.standard_normal(v.shape).astype(v.dtype) * 0.2
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    return net


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    net = _network()
    x = rng.standard_normal((6, toxicity.WORD_DIM + toxicity.CHAR_DIM + 2))
    words = np.array([[0, 1, 2, 3], [4, 0, 5, -1], [2, -1, -1, -1]])

    def loss():
        return float((net.forward(x, words) ** 2).sum())
    logit, kept = net.forward(x, words, keep=True)
    g, d_x = net.gradients(x, words, 2 * logit, kept)
    g["x"] = d_x
    for name, grad in g.items():
        v = x if name == "x" else net.p[name]
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in v.shape)
            old, eps = v[at], 1e-3
            v[at] = old + eps
            up = loss()
            v[at] = old - eps
            down = loss()
            v[at] = old
            assert grad[at] == pytest.approx((up - down) / (2 * eps), rel=2e-2, abs=2e-3), name


def test_windows_overlap_and_cover_every_word():
    for n in (0, 1, 15, 16, 17, 24, 25, 100, 1001):
        doc, start = toxicity.window_starts(np.array([n]))
        seen = np.zeros(n + 40, int)
        for s in start:
            seen[s:s + toxicity.WINDOW] += 1
        assert (seen[:n] >= 1).all() and (seen[:n] <= 2).all() and (start < max(n, 1)).all()


def _toxic_texts(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioutnsr") for _ in range(rng.randrange(2, 7)))
    texts, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(3, 120))]
        bad = i % 5 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["mug", "blockh"]) + rng.choice(["wump", "ead", "ish", "eads", "y"])
        texts.append(" ".join(w))
        labels.append(int(bad))
    return texts, np.array(labels)


def test_held_out_toxic_texts_are_found():
    texts, labels = _toxic_texts(900, 1)
    net = toxicity.train(texts, labels, labels.mean())
    texts, labels = _toxic_texts(400, 2)
    score = np.concatenate([net.score(net.documents(g)) for _, _, g in blocks(pa.array(texts), ALNUM, True)])
    assert ((score >= 0.3) == labels).mean() > 0.97
    long = " ".join(texts[1:200:5] * 3)  # clean but long, then with one word at its end
    [(_, _, g)] = blocks(pa.array([long + " mugwump"]), ALNUM, True)
    assert net.score(net.documents(g))[0] >= 0.3


def test_toxicity_odd_rows(spark):
    texts, labels = _toxic_texts(150, 3)
    net = toxicity.train(texts, labels, labels.mean())
    out = toxicity.toxicity(documents(spark, ODD), net).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert len({r.score for r in out if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.toxicity(documents(spark, []), net).count() == 0


def test_without_two_classes_the_share_is_the_score(spark):
    docs = documents(spark, ODD)
    for rows, want in (([], 0.0), ([(1, 0, 0), (2, 0, None), (None, 0, 1)], 0.0), ([(4, 0, 1), (4, 0, 0)], 1.0)):
        net = toxicity.learn(docs, spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int"))
        assert net == want and {r.score for r in toxicity.toxicity(docs, net).collect()} == {want}


def test_toxicity_query(spark):
    rows = queries.QUERIES["op4_toxicity"](spark, SF).collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    assert len(rows) == 1000 and all(r.held_out == held[r.doc_id] for r in rows)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [r for r in rows if labels.get(r.doc_id) == 0]
    toxic = [r for r in rows if labels.get(r.doc_id) == 1]
    assert sum(r.predicted for r in clean) < 0.1 * len(clean) and sum(r.predicted for r in toxic) > 0.5 * len(toxic)


# ---- languages

def test_held_out_languages(spark):
    rows = queries.QUERIES["op8_language_mixture"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) > 0.98 * len(held)


def test_language_odd_rows(spark):
    train = spark.createDataFrame([("das ist ein haus und der hund", "de"), ("this is the house and the dog", "en"), ("nothing", None), (None, "fr")], "text string, lang string")
    langs, model = language_mixture.learn(train)
    assert langs == ["de", "en"]
    out = language_mixture.language_mixture(documents(spark, ODD), langs, model).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert len(out) == len(ODD) and got[None][0] == "en" and got[5][0] == "de"
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3, 6)) and got[7][0] in langs and all(0 <= s <= 1 for _, s in got.values())
    langs, model = language_mixture.learn(train.limit(0))
    assert {r.lang_pred for r in language_mixture.language_mixture(documents(spark, ODD), langs, model).collect()} == {"und"}
    assert language_mixture.language_mixture(documents(spark, []), ["de"], model).count() == 0


def test_mixture_of_two_languages(spark):
    rng = random.Random(1)
    words = {"xx": ["aba", "bab", "abba", "baa"], "yy": ["kik", "iki", "kiki", "ikk"], "zz": ["odo", "dod", "oddo", "doo"]}
    text = lambda *ls: " ".join(rng.choice(words[rng.choice(ls)]) for _ in range(300))
    langs, model = language_mixture.learn(spark.createDataFrame([(text(x), x) for x in words], "text string, lang string"))
    out = {r.doc_id: r for r in language_mixture.language_mixture(documents(spark, [(1, text("xx")), (2, text("xx", "zz")), (3, text("yy", "yy", "yy", "zz"))]), langs, model).collect()}
    assert out[1].languages == ["xx"] and out[1].score == pytest.approx(1)
    assert out[2].languages == ["xx", "zz"] and abs(out[2].shares[0] - 0.5) < 0.1
    assert out[3].lang_pred == "yy" and abs(out[3].score - 0.75) < 0.1


# ---- html

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body class="nav-open">
<div id="cookie-notice"><p>We use cookies on this site to do many things that you may like or not, so please accept them.</p></div>
<header><h1>Site</h1><nav><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul></nav></header>
<div class="sidebar"><h3>Related</h3><p>Some teaser text that is long enough to look like a paragraph of its own, really.</p></div>
<div class="content"><header><h1>Title &amp; more</h1></header><p>First <b>bo</b>ld with <a href="a>b">link</a> and<br>a  break.<p>Short.
<div class="ad-slot">Buy the best thing in the whole world that was ever made by anybody anywhere</div>
<blockquote>quoted 1 < 2 &lt;tag&gt; &#233;</blockquote><aside>aside text</aside><style>p{}</style><!-- <p>gone</p> --><form><label>Name</label></form>
<ul><li>An item of a list that says a few things about the matter</li><li>and another one</li></ul></div>
<section id="comments"><article class="comment"><p>I disagree with all of this because it is long and bad, and more words.</p></article></section><footer>&copy; 2020</footer>"""


def test_main_text_of_a_mixed_page():
    tree = html_text.train_tree(html_text.LABELLED)
    assert html_text.main_text(PAGE, tree).split("\n\n") == ["Title & more", "First bold with link and a break.", "Short.", "quoted 1 < 2 <tag> é",
                                                            "An item of a list that says a few things about the matter", "and another one"]


def test_pages_give_their_articles(spark):
    out = {r.page_id: r for r in queries.QUERIES["op3_html_text"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(out) == len(pages)
    from html import unescape
    for p in pages:
        body = re.search(r"<article>(.*)</article>", p.html, re.S)[1].replace("<br>", " ")
        blocks_ = [" ".join(unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", body))]
        want = "\n\n".join(b for b in blocks_ if b)
        assert out[p.page_id].text == want and out[p.page_id].n_chars == len(want) and out[p.page_id].url == p.url


def test_html_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<"), (4, "u", "<p title=\"open>" + "word " * 30), (4, "u", "<article>" + "<p>a b" * 5000), (5, "u", "<script>" + "x" * 9999)]
    pages = spark.createDataFrame([(*r, "e", 1) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    out = html_text.extract(pages).collect()
    assert len(out) == 6 and all(r.n_chars == len(r.text) for r in out)
    assert [r.text for r in out if r.page_id in (1, 2, None, 5)] == [""] * 4
    assert max(r.n_chars for r in out) == 5000 * 5 - 2
    assert html_text.extract(pages.limit(0)).count() == 0


# ---- token counts

def _pieces(path):
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {}
    for i in range(m.get_piece_size()):
        if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)):
            out.setdefault(m.id_to_piece(i), token_counts.zipf(len(out)))
    return out


def _tokens(text, pieces):
    total = 0
    for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        s = "▁" + w
        best = [(0, 0)] + [None] * len(s)
        for e in range(1, len(s) + 1):
            c = [(best[b][0] + pieces[s[b:e]], best[b][1] - 1) for b in range(max(0, e - 48), e) if best[b] and s[b:e] in pieces]
            if s[e - 1] not in pieces and best[e - 1]:
                n = len(s[e - 1].encode())
                c.append((best[e - 1][0] + n * token_counts.zipf(token_counts.FALLBACK_RANK), best[e - 1][1] - n))
            best[e] = max(c)
        total -= best[-1][1]
    return total


def test_token_counts_against_brute_force(spark):
    path = queries.tokenizer_path(queries.VOCABULARY)
    pieces, rng = _pieces(path), random.Random(6)
    texts = ["".join(rng.choice("abcdeéñßthing日本🙂.,#▁1  \n") for _ in range(rng.randrange(0, 150))) for _ in range(150)]
    texts += ["x" * 500, "日" * 130 + "a", "a\0b \0", "internationalisation of the world", "é" * 65 + " " + "é" * 64]
    texts += ["https://example.org/" + "".join(rng.choice(["path", "index", "日本", "/", "q=", "é"]) for _ in range(n)) for n in (20, 60, 400)] * 2
    docs = list(enumerate(texts)) + [(901, None), (902, ""), (None, "no id"), (3, texts[3])]
    out = token_counts.token_counts(documents(spark, docs), path).collect()
    assert sorted(str((r.doc_id, r.n_tokens)) for r in out) == sorted(str((d, _tokens(t, pieces))) for d, t in docs)
    assert token_counts.token_counts(documents(spark, []), path).count() == 0


def test_long_runs_do_not_depend_on_the_chunk():
    vocab, rng = token_counts.Vocabulary.load(queries.tokenizer_path(queries.VOCABULARY)), random.Random(8)
    runs = ["".join(rng.choice(["the", "ing", "é", "日", "x", "🙂", "nation"]) for _ in range(rng.randrange(1, 300))).encode() for _ in range(30)]
    data, bounds = np.frombuffer(b"".join(runs), np.uint8), np.cumsum([0] + [len(r) for r in runs])
    want = token_counts.long_counts(data, bounds, vocab).tolist()
    assert all(token_counts.long_counts(data, bounds, vocab, chunk).tolist() == want for chunk in (1, 7, 64, 1000))
    assert want == [int(token_counts.long_counts(np.frombuffer(r, np.uint8), np.array([0, len(r)]), vocab)[0]) for r in runs]


def test_shared_prefixes_are_scored_once():
    vocab = token_counts.Vocabulary([b"a", b"b", b"ab", b"abc", b"\xe2\x96\x81"])
    [(_, _, grid)] = blocks(pa.array(["ab abc abab b"]), NONSPACE, False)
    assert token_counts.count_tokens(grid, vocab)[1][0] == sum(1 + n for n in (1, 1, 2, 1))
    assert math.isclose(token_counts.zipf(0) / token_counts.UNIT, -math.log(2.7) - 2, rel_tol=1e-5)
