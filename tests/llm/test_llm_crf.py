import itertools
import zlib

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from windowmatch.llm import html_crf, lang_crf
from windowmatch.llm.shared import fold, table

SF = "/root/testdata/sf0.01"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 1, 5, 2])
    emission, transition, start = rng.normal(size=(11, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    marginal, expected, log_z = lang_crf.forward_backward(emission, lengths, transition, start)
    at, z_sum, steps = 0, 0.0, np.zeros((3, 3))
    for n in lengths:
        part = emission[at : at + n]
        total, mine, moves = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            weight = start[path[0]] + sum(part[i, y] for i, y in enumerate(path))
            weight = np.exp(weight + sum(transition[a, b] for a, b in zip(path, path[1:])))
            total += weight
            for i, y in enumerate(path):
                mine[i, y] += weight
            for a, b in zip(path, path[1:]):
                moves[a, b] += weight
        assert np.allclose(marginal[at : at + n], mine / total)
        steps += moves / total
        z_sum += np.log(total)
        at += n
    assert np.allclose(expected, steps) and np.isclose(log_z, z_sum)


@pytest.fixture(scope="module")
def model(spark):
    docs = table(spark, SF, "documents")
    return lang_crf.train(docs.where(fold(docs["doc_id"]) != 0))


def test_language_of_held_out_documents(spark, model):
    rows = table(spark, SF, "documents").select("doc_id", "text", "lang").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    found = lang_crf.predict(model, [r["text"] for r in held])
    assert sum(f[0] == r["lang"] for f, r in zip(found, held)) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for _, s in found)


def test_switching_text_is_labelled_word_by_word(model):
    english, german = "of the and that with this is for", "der die und nicht mit sich von das"
    emission, _ = model.emissions(lang_crf.words_of(f"{english} {german}"))
    marginal, _, _ = lang_crf.forward_backward(emission, np.array([16]), model.transition, model.start)
    names = [model.labels[i] for i in marginal.argmax(1)]
    assert names == ["en"] * 8 + ["de"] * 8
    assert (np.diag(model.transition) > model.transition.mean(1)).all()


def test_language_of_defined_cases(spark, model):
    got = lang_crf.identify(cases.documents(spark), model).collect()
    assert len(got) == len(cases.TEXTS)
    und = sorted((r["doc_id"] for r in got if r["lang_pred"] == "und"), key=repr)
    assert und == sorted([3, 4, None, 5, 6], key=repr)
    kept = lang_crf.keep_identified(cases.documents(spark), model)
    assert kept.columns == cases.SCHEMA.names and kept.count() == len(cases.TEXTS) - 5
    assert lang_crf.identify(cases.empty(spark), model).count() == 0


def test_language_without_labels(spark):
    nothing = lang_crf.train(cases.empty(spark))
    assert {r["lang_pred"] for r in lang_crf.identify(cases.documents(spark), nothing).collect()} == {"und"}
    one = lang_crf.fit([("the cat", "en")])
    assert lang_crf.predict(one, ["a dog", "1"]) == [("en", 1.0), ("und", 0.0)]


def test_texts_of_several_languages_are_kept(spark):
    words = {lang: [f"{lang}{a}{b}" for a in "aeiou" for b in "lmnr"] for lang in ("qu", "zo", "wy", "xi")}
    learned = [(" ".join(ws[i:] + ws[:i]), lang) for lang, ws in words.items() for i in range(20)]
    crf = lang_crf.fit(learned)
    mixed = " ".join(w for ws in words.values() for w in ws)
    assert lang_crf.predict(crf, [mixed])[0][1] < 0.35
    docs = cases.documents(spark, [(1, mixed, None), (2, "12 !", None)])
    assert [r["doc_id"] for r in lang_crf.keep_identified(docs, crf).collect()] == [1]


def test_texts_are_kept_if_nothing_was_learned(spark):
    docs = cases.documents(spark)
    kept = lang_crf.keep_identified(docs, lang_crf.train(docs.withColumn("lang", F.lit(None).cast("string"))))
    assert kept.columns == docs.columns and kept.count() == len(cases.TEXTS) - 5


@pytest.fixture(scope="module")
def pages(spark):
    return table(spark, SF, "pages")


@pytest.fixture(scope="module")
def field(pages):
    return html_crf.train(pages)


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(2)
    for _ in range(20):
        blocks = [html_crf.Part(f"t{i}", (f"f{i}",), "p", 0) for i in range(6)]
        crf = html_crf.Crf({f"f{i}": float(rng.normal()) for i in range(6)}, rng.normal(size=(2, 2)), rng.normal(size=2))
        scores = crf.scores(blocks)

        def value(path, scores=scores, crf=crf):
            return crf.start[path[0]] + sum(s for s, y in zip(scores, path) if y) + sum(
                crf.transition[a, b] for a, b in zip(path, path[1:])
            )

        best = max(itertools.product((0, 1), repeat=6), key=value)
        assert crf.label(blocks) == [bool(y) for y in best]


def test_main_text_of_given_pages(spark, pages, field):
    import html
    import re

    got = {r["page_id"]: r for r in html_crf.extract(pages, field, "html", "page_id", "url").collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
        want = "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_labels_of_unseen_layouts(pages, field):
    texts = [b.text for r in pages.limit(50).collect() for b in html_crf.parts(r["html"]) if len(b.text) > 40]
    right = total = 0
    for blocks, labels in html_crf.layouts(texts, 200, seed=77):
        right += sum(a == b for a, b in zip(field.label(blocks), labels))
        total += len(labels)
    assert right >= 0.95 * total


def test_pages_of_defined_cases(spark, field):
    page = (
        '<div><script>var a="<p>no</p>"</script><nav><a href=/>Home</a> <a href=/b>More</a></nav><main><h1>T&amp;x</h1>'
        "<p>Body text &#8212; long enough, really.<br>Next\n\n line<p>And <b>another</b>&nbsp;one, with commas, too.</main>"
        '<div class="comments"><article class="comment"><p>I like this a lot, thanks for the text.</p></article></div>'
    )
    rows = [(1, page), (2, None), (3, ""), (3, ""), (4, "<" * 2000), (5, "<p" * 3000), (6, "<p>" + "word " * 50_000)]
    frame = spark.createDataFrame([(i, None, h, "x") for i, h in rows], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_crf.extract(frame, field, "html", "page_id", "url").collect()]
    assert len(got) == len(rows)
    assert dict((i, t) for i, t, _ in got)[1] == (
        "T&x\nBody text — long enough, really. Next line\nAnd another one, with commas, too."
    )
    assert all(t == "" and n == 0 for i, t, n in got if i in (2, 3))
    assert html_crf.extract(frame.where("false"), field, "html").count() == 0
    assert html_crf.main_text(html_crf.fit(html_crf.layouts([])), "<article><h1>A title</h1><p>Some text here.</p></article>")


def test_unclosed_markup_takes_one_pass():
    import time

    odd = ["<b><i>x", "<div>x", "<a ", "<a \"'>", "<! ", "<script ", "<b><p>x</p>", "</q <", "<li><b>", '<a href=">', "<svg><p>", "<a x='<"]
    for text in odd:
        start = time.perf_counter()
        html_crf.parts(text * 8000)
        html_crf.parts(text * 8000 + ">")
        assert time.perf_counter() - start < 2, text


def test_markup_inside_of_attributes():
    def texts(page):
        return [b.text for b in html_crf.parts(page)]

    assert texts('<p title="<b>no</b> > no">a</p><p>b') == ["a", "b"]
    assert texts("<p title='a<\"'>a</p><a \"'>b</a> c < d") == ["a", "b c < d"]
    assert texts('<p title="no end>a</p><p>b</p>') == ["a", "b"]


def test_hidden_elements_end_where_they_end():
    def texts(page):
        return [b.text for b in html_crf.parts(page)]

    assert texts('<p>a <svg width="1"/> b</p><p>c</p>') == ["a b", "c"]
    assert texts("<div>a<svg><path></div><p>b</p>") == ["a", "b"]
    assert texts("<div>a<noscript>x</div><p>b</p>") == ["a", "b"]
    assert texts("<p>a<template><p>x<template>y</template>z</p></template> b</p>") == ["a b"]
    assert texts("<p>a<svg><svg><text>x</text></svg><text>y</text></svg> b</p>") == ["a b"]
    assert texts("<svg><title>x</title><p>b</p>") == ["b"]
