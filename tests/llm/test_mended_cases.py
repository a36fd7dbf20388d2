"""Cases that once gave wrong, lost or slow results: ids beside nulls, page layouts, hostile pages, seams, clashing columns."""

import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronolith.llm import ctw, extract, langid, minhash, packing, secret_scan

LARGE = [2**53 + 1, 2**53 + 3, None, 7, None, 2**62 + 1]
BODY = [
    "The harbour was built in the last century, and its walls, sheds and cranes are still in use by the fishing boats of the town.",
    "Every morning the crews bring in their catch, sort it on the quay, and sell most of it before the first train leaves for the city.",
    "In winter, when storms close the entrance, the boats stay moored, and the market hall opens for concerts, plays and dances.",
]
ARTICLE = "".join(f"<p>{b}</p>" for b in BODY)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"word{k} other text {'secret = ' if k % 2 else ''}AKIAABCDEFGHIJKLMNO{k}", "s", "x") for k, i in enumerate(LARGE)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, Source2 string").coalesce(1)


def ids(df, column="doc_id"):
    return sorted((r[0] for r in df.select(column).distinct().collect()), key=str)


def test_ids_above_doubles_beside_nulls(spark, docs):
    want = sorted(set(LARGE), key=str)
    assert ids(packing.pieces_of(docs)) == want
    packed = packing.packed(packing.pieces_of(docs))
    assert ids(packed) == want and dict(packed.dtypes)["doc_id"] == "bigint" and dict(packed.dtypes)["piece"] == "int"
    scored = ctw.scored(docs, F.col("doc_id") == 7)
    assert ids(scored) == want and scored.count() == len(LARGE)
    assert ids(secret_scan.candidates(docs, F.col("doc_id")), "key") == want


LAYOUTS = {
    "wrapper with sidebar": f'<body><div id=page class="has-sidebar"><article>{ARTICLE}</article><div class="sidebar"><p>Other news of the day, in short</p></div></div>',
    "no sidebar": f'<div class="layout-no-sidebar"><article>{ARTICLE}</article></div>',
    "open menu": f'<div class="nav-open wrapper"><nav><a href=/>Home</a></nav><article>{ARTICLE}</article></div>',
    "post with comments": f'<div class="post-with-comments">{ARTICLE}<div class="comments"><p>I was there once, it was cold, and I liked it a lot, really.</p></div></div>',
    "ad free": f'<div class="ad-free"><div>{ARTICLE}</div></div>',
    "one form": f'<form method=post><input name=state><div class="content">{ARTICLE}</div><button>Send</button></form>',
    "form in a page": f'<div><div id="main">{ARTICLE}</div><form><p>Write to us, we answer soon, always</p></form></div>',
    "related work": f'<article>{ARTICLE.replace("</p><p>", "</p><div class=related-work><p>", 1).replace("</p><p>", "</p></div><p>", 1)}</article>',
    "related links": f'<article>{ARTICLE}<div class="related-posts"><a href=1>An older story of the port</a> <a href=2>Another one</a></div></article>',
    "custom element": f'<app-root class="nav-open"><div>{ARTICLE}</div></app-root>',
    "hidden part": f'<article>{ARTICLE}<p hidden>Not to be seen, never, by anyone at all here</p></article>',
    "long comments": f'<div class="story">{ARTICLE}</div><div id="comments">' + "<p>I do not agree, as the harbour is older, and the hall, too, is older than you say, my dear.</p>" * 12 + "</div>",
    "inner advert": f'<article>{ARTICLE.replace("</p><p>", "</p><div class=advert>Buy boats, cheap boats, best boats in the whole town today</div><p>", 1)}</article>',
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts_keep_the_article(name):
    assert extract.main_text(LAYOUTS[name]).split("\n\n") == BODY


def test_controls_and_marks_within_sentences():
    page = "<article><p>Press <button>Start</button> and choose a <label>name</label>, then wait <span class=ad>Buy!</span> for the lamp to turn green, please.</p></article>"
    assert extract.main_text(page) == "Press Start and choose a name, then wait for the lamp to turn green, please."
    equal = "".join(f"<section><div><p>{b}</p></div></section>" for b in (BODY[0], BODY[0]))
    assert extract.main_text(equal) == extract.main_text(equal) != ""
    assert extract.main_text("<<<>>> a < b, c > d & e") == "<<<>>> a < b, c > d & e"
    assert extract.main_text(None) == extract.main_text("") == extract.main_text("<!-- only -->") == ""


HOSTILE = {
    "unclosed tags": "<a " * 350_000, "brackets": "<" * 1_000_000, "odd quotes": '<b "> "' * 150_000, "deep inline": "<b>x" * 200_000, "deep blocks": "<div>x, y" * 100_000,
    "deep items": "<blockquote>x<li>" * 60_000, "stray ends": "<b>" * 150_000 + "</table></td></i>" * 30_000, "items below": "<ul><li><div>" + "<b>" * 100_000 + "<li></li>" * 60_000,
    "comments": "<!--" * 250_000, "tables": "<table><tr><td>" * 60_000, "attributes": "<div " + "class=" * 160_000 + ">x",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    start = time.process_time()
    extract.main_text(HOSTILE[name])
    assert time.process_time() - start < 6


def test_repeated_rows_and_clashing_columns_of_pages(spark):
    pages = spark.createDataFrame([(1, f"<article>{ARTICLE}</article>", "t"), (1, f"<article>{ARTICLE}</article>", "t"), (None, None, None)], "page_id int, html string, text string")
    got = pages.withColumn("found", extract.extracted(F.col("html"))).collect()
    assert [r.found for r in got] == ["\n\n".join(BODY)] * 2 + [""] and got[0].text == "t"


def test_trigrams_at_seams():
    for text in ("abc" * 800_000, "ab  c1" * 400_000, "é" * (langid._CHUNK + 1), "a" * langid._CHUNK, " " * (langid._CHUNK * 2) + "x"):
        codes, counts = langid.letter_grams(text)
        spaced = " " + "".join(c if c.isalpha() else " " for c in text) + " "
        while "  " in spaced:
            spaced = spaced.replace("  ", " ")
        assert counts.sum() == max(0, len(spaced) - 2)
        assert len(codes) == len({spaced[i:i + 3] for i in range(len(spaced) - 2)})


def test_stages_keep_clashing_columns(spark, tmp_path):
    rows = [(2**53 + 1, "A first text of some words.", "en", "a", 27, "l", "m"), (None, "Another text, with other words.", "en", "b", 31, "l", "m"), (3, None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, Language string, mix string")
    docs = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == frame.columns
        # the mix takes whole documents up to its targets, here not all
        assert set(ids(docs)) == {2**53 + 1, None} if name != "mixture" else set(ids(docs)) <= {2**53 + 1, None}
    assert ids(corpus_pipeline.STAGES[-1][1](spark, docs, "")) == ids(docs)


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0


def test_more_than_a_thousand_slices(spark):
    ids = spark.range(1200).select((F.col("id") * 7).alias("id"))
    slices = [r.slice for r in ids.withColumn("slice", minhash._slices(ids, 1)).orderBy("id").collect()]
    assert slices == sorted(slices) and len(set(slices)) > 1000
