"""Paths of more than three segments."""

from kinegrain.llm import url_filter


def test_urls_that_differ_below_the_third_segment(spark):
    rules = [("h", "/shop/eu/items/spam/1", "block")]
    urls = [f"http://h/shop/eu/items/{kind}/{i}" for kind in ("spam", "news") for i in range(100)]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    out = url_filter.judge_urls(pages, rules).collect()
    got = {(("spam" if "/spam/" in r.path else "news"), r.rule is None, r.verdict, r.template) for r in out}
    spam, news = "/shop/eu/items/spam/#", "/shop/eu/items/news/#"
    assert len(out) == 200 and got == {("spam", False, "block", spam), ("spam", True, "block", spam), ("news", True, "allow", news)}


def test_very_long_paths_cost_no_rounds(spark, monkeypatch):
    """Two urls of 500 segments, and of 500 slashes, are two branches: nothing can merge, so no level is a round."""
    rounds = []
    real = url_filter._merged_level
    monkeypatch.setattr(url_filter, "_merged_level", lambda tree, k: rounds.append(k) or real(tree, k))
    deep = "http://h/" + "/".join(f"s{k}x" for k in range(500))
    urls = [deep, deep + "y", "http://g" + "/" * 500, *(f"http://f/{c}/a{c}/same" for c in "abc")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, [("h", "/", "block")]).collect()}
    assert rounds == [0, 1]
    assert got[0].template == "/" + "/".join(["s#x"] * 500) and got[1].template == got[0].template + "y" and got[2].template == "/" * 500
    assert [got[i].verdict for i in range(6)] == ["block", "block", "allow", "allow", "allow", "allow"] and got[4].template == "/*/*/same"
