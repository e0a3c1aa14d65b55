"""Texts of a page that stand where most pages of the host have the same."""

from tidepanel.llm import wrapper


def test_only_the_constant_text_of_a_slot_is_template(spark):
    page = "<div class=x><p>Welcome to our site</p></div><div class=s><p>{1}</p></div><div class=y><h2>Title {0}</h2><pre>Story {0}</pre></div>"
    own = {4: "A real summary", 9: "Another one"}
    df = spark.createDataFrame([(i, f"https://h.example/{i}", page.format(i, own.get(i, "No summary"))) for i in range(16)], "page_id long, url string, html string")
    for r in wrapper.main_text(df).collect():
        i = r["row"]["page_id"]
        assert r["text"] == "\n\n".join(([own[i]] if i in own else []) + [f"Title {i}", f"Story {i}"])


def test_a_page_among_copies_of_another_keeps_its_text(spark):
    page = "<div class=x><p>Welcome</p></div><div class=y><h2>{0}</h2><pre>{1}</pre></div><div class=z><pre>{2}</pre></div>"
    rows = [(i, f"https://h.example/{i}", page.format("Old", "Old story", "Old end")) for i in range(20)] + [(20, "https://h.example/20", page.format("New", "New story", "New end"))]
    got = {r["row"]["page_id"]: r["text"] for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[20] == "New\n\nNew story\n\nNew end"


def test_part_of_a_class_name_does_not_drop_the_article(spark):
    """Everyday names of blog software; whole names and small parts are still left out."""
    names = ["post no-sidebar", "layout-with-sidebar", "entry comments-open", "share-class research", "post-related-news", "notice-board story", "ad-free reading"]
    body = "<nav>Home</nav><div class='{}'><h2>Title</h2><p>A story of some length about a river and a hill</p></div><div class='site-footer'>Made by us</div><div class=ad>Buy</div>"
    rows = [(i, f"https://h{i}.example/", body.format(name)) for i, name in enumerate(names)]
    rows.append((90, "https://f.example/", "<form><h2>Title</h2><p>A page in a form</p></form>"))
    rows.append((91, "https://g.example/", "<article><p>Short</p></article><div class='comments'><p>" + "A long comment of a reader. " * 40 + "</p></div>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["row"]["page_id"]: r["text"] for r in wrapper.main_text(df).collect()}
    assert all(got[i] == "Title\n\nA story of some length about a river and a hill" for i in range(len(names)))
    assert got[90] == "Title\n\nA page in a form" and got[91] == "Short"
