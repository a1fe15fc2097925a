"""Text repeated over a host whose pages are dealt into several groups."""

from locusflow.llm import extract

from . import data

NOTICE = "this very notice stands on only a few pages of the whole big host"
SCHEMA = "page_id bigint, url string, html string"


def texts(spark, rows):
    got = extract.main_text(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    return {r["page_id"]: (r["text"], r["n_boilerplate"]) for r in got}


def test_a_run_is_counted_over_the_whole_host(spark, monkeypatch):
    """The verdict on a notice on 3 pages, plain or inside an article, doesn't depend on the number of groups."""
    own = [f"page {i} says {data.prose(i, 12)}" for i in range(60)]
    rows = [(i, f"http://h/{i}", f"<p>{t}</p>") for i, t in enumerate(own)]
    for i in (7, 23, 41):
        rows[i] = (i, f"http://h/{i}", f"<div>{NOTICE}</div><p>{own[i]}</p>")
    shared = "a passage that two articles of the host have and one plain page has as well"
    rows[11], rows[12] = ((i, f"http://h/{i}", f"<article><p>{shared}</p><p>{own[i]}</p></article>") for i in (11, 12))
    rows[13] = (13, "http://h/13", f"<p>{shared}</p><p>{own[13]}</p>")
    twice = "this line stands on two pages of the host alone and must stay there"
    for i in (50, 51):
        rows[i] = (i, f"http://h/{i}", f"<div>{twice}</div><p>{own[i]}</p>")
    one = texts(spark, rows)
    assert [one[i] for i in (7, 23, 41, 13)] == [(own[i], 1) for i in (7, 23, 41, 13)]
    assert one[11] == (f"{shared}\n{own[11]}", 0) and one[50] == (f"{twice}\n{own[50]}", 0)
    monkeypatch.setattr(extract, "GROUP", 4)
    assert texts(spark, rows) == one


def test_equal_pages_count_once(spark, monkeypatch):
    """Copies of a plain page keep their text, in one group and over several."""
    text = data.prose(77, 40)
    rows = [(i, f"http://h/{i}", f"<p>{text}</p>") for i in range(12)]
    want = {i: (text, 0) for i in range(12)}
    assert texts(spark, rows) == want
    monkeypatch.setattr(extract, "GROUP", 3)
    assert texts(spark, rows) == want


def test_class_names_that_only_hold_a_furniture_word():
    """A name drops text only if it says furniture and nothing else."""
    page = "<article><div class='share-price'>a</div><p class='ad-hoc'>b</p><section id='search-results'>c</section><div class='ad'>d</div><div class='x ad-box'>e</div><div class='comment-list'>f</div><div role='search'>g</div><p>h</p></article>"
    assert [t for k, t in extract.blocks(page) if k == extract.ARTICLE] == ["a", "b", "c", "h"]
    assert [(k, t) for k, t in extract.blocks("<div class='promo-code-guide'>a</div><div id=cookie_banner>b</div>")] == [(extract.PLAIN, "a"), (extract.FURNITURE, "b")]
