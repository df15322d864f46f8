from quarry.operators import webpages as w


def page(k, main):
    menu = "".join(f'<a href="/{x}">{x} page</a> | ' for x in ("home", "about", "news"))
    tail = "<p>Copyright of the example company, all hosts, all pages, always the same.</p>"
    return (k, f"https://www.Example.org:80/{k}", f'<html lang="EN"><head><title>Page &amp; {k}</title><meta content="About {k}" name="description"><link rel="canonical" href="https://example.org/c{k}"></head><body><div>{menu}</div>{main}{tail}</body></html>')


def test_pages(spark):
    story = "<h2>Short head</h2><p>A long paragraph with a <a href='x'>link</a> in it that says what the page {0} is about, at some length.</p><p>Yes, {0}.</p><p>Another paragraph of page {0} that goes on long enough to count.</p>"
    rows = [page(k, story.format(k)) for k in range(5)] + [(9, None, None), (10, "no url", ""), (11, "https://other.org/x", "<p>Only a <b>bare</b> page of one sentence that is long enough to be kept.<script>no()</script>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    said = {r["page_id"]: r for r in w.metadata(pages).collect()}
    assert tuple(said[1])[1:] == ("example.org", "Page & 1", "en", "About 1", "https://example.org/c1")
    assert tuple(said[9])[1:] == (None,) * 5 == tuple(said[10])[1:] and said[11]["host"] == "other.org"
    text = {r["page_id"]: r for r in w.main_text(pages).collect()}
    assert len(text) == 8 and text[9]["text"] == text[10]["text"] == ""
    for k in range(5):
        lines = text[k]["text"].split("\n")
        assert lines[-3:] == [f"A long paragraph with a link in it that says what the page {k} is about, at some length.", f"Yes, {k}.", f"Another paragraph of page {k} that goes on long enough to count."]
        assert "Copyright" not in text[k]["text"] and "home page" not in text[k]["text"] and text[k]["left_out"] >= 2
    assert text[11]["text"] == "Only a bare page of one sentence that is long enough to be kept."
    why = {(r["text"].split(" ")[0], r["boilerplate"]) for r in w.judged(w.blocks(pages)).where("page_id = 2").collect()}
    assert {("home", "repeated on the host"), ("Copyright", "repeated on the host"), ("Yes,", None)} <= why
    alone = w.judged(w.blocks(pages.where("page_id = 2"))).where("text LIKE 'home page%'").first()
    assert alone["boilerplate"] == "links"
    assert w.main_text(pages.limit(0)).count() == 0
