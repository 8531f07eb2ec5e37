"""The path-template tree against a walk over one host's paths."""

import random
import re
from collections import defaultdict

from kinegrain.llm import url_filter

RULES = [("h", "/a/", "block"), ("h", "/b/x/", "block"), ("h", "/b/y/", "allow"), ("g", "/news", "allow"), ("few", "/bad/", "block")]


def judged_by_walk(paths):
    """verdict of each (path, label) of one host by walking down from the root, one node after the other."""
    rows = [(re.sub(r"[0-9]+", "#", re.sub(r"^/", "", p.replace("", ""))).split("/"), lab) for p, lab in paths]

    def share(group, k):
        n = len(group)
        return n, sum(len(t) == k + 1 for t, _ in group), sum(lab is not None for _, lab in group), sum(lab == "block" for _, lab in group)

    def smoothed(group, k, above):
        known = [lab for _, lab in group if lab]
        if not known:
            return above
        return known.count("block"), len(known), len(group) - len(known), above

    out = {}

    def walk(group, k, above):
        got = smoothed(group, k, above)
        here = {}
        for rest in (0.0, url_filter.UNLABELLED):
            if isinstance(got, tuple):
                b, n, u, p = got
                here[rest] = (b + url_filter.STRENGTH * p) / (n + rest * u + url_filter.STRENGTH)
            else:
                here[rest] = got
        for t, _ in group:
            if len(t) == k:
                out[tuple(t)] = here[0.0]
        kids = defaultdict(list)
        for t, lab in group:
            if len(t) > k:
                kids[t[k]].append((t, lab))
        total = share([x for g in kids.values() for x in g], k)
        like = []
        for s, g in kids.items():
            one = share(g, k)
            fits = True
            for x, y in zip(one[1:], total[1:]):
                p = y / total[0]
                fits &= (x / one[0] - p) ** 2 <= url_filter.DEVIATION * p * (1 - p) * (1 / one[0] - 1 / total[0])
            if fits:
                like.append(s)
        merged = defaultdict(list)
        for s, g in kids.items():
            merged["*" if s in like and len(like) >= url_filter.MANY else s] += g
        for g in merged.values():
            walk(g, k + 1, here[url_filter.UNLABELLED])

    walk(rows, 0, url_filter.PRIOR)
    return [lab or ("block" if out[tuple(t)] >= url_filter.REJECT else "allow") for t, lab in rows]


def verdicts(spark, urls):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {r.page_id: r for r in url_filter.judge_urls(pages, RULES).collect()}


def test_tree_against_a_walk(spark):
    rng = random.Random(6)
    kinds = ["a", "b", "c", "user", "x", "y", "z1", "z2", "q", "w"]
    urls = []
    for host in ("h", "few", "other"):
        for _ in range(160):
            urls.append(f"http://{host}/" + "/".join(rng.choice(kinds) + str(rng.randint(0, 3)) * rng.randint(0, 1) for _ in range(rng.randint(0, 6))))
        urls += [f"http://{host}/bad/{i}/x" for i in range(40)] + [f"http://{host}/bad", f"http://{host}//bad//"]
    got = verdicts(spark, urls)
    seen = set()
    for host in ("h", "few", "other"):
        mine = [k for k, u in enumerate(urls) if u.startswith(f"http://{host}/")]
        rows = [(got[k].path, got[k].verdict if got[k].rule else None) for k in mine]
        want = judged_by_walk(rows)
        assert [got[k].verdict for k in mine] == want
        seen |= {(lab is None, v) for (_, lab), v in zip(rows, want)}
    assert seen >= {(True, "block"), (True, "allow"), (False, "block")}


def test_what_the_method_decides(spark):
    # nearly all of a section is blocked by a rule; what the rule's prefix misses is blocked by the method
    urls = [f"http://h/a/{i}" for i in range(50)] + ["http://h/a", "http://h/b/z"] + [f"http://h/c/{i}" for i in range(400)] + ["http://other/c/1"]
    urls += [f"http://few/bad/{i}" for i in range(30)] + ["http://few/new/1"]
    got = verdicts(spark, urls)
    by = {r.path if r.host == "h" else f"{r.host}{r.path}": r for r in got.values()}
    assert by["/a/1"].verdict == "block" and by["/a/1"].rule == "h/a/"
    assert (by["/a"].rule, by["/c/7"].rule, by["few/new/1"].rule) == (None, None, None)
    assert (by["/c/7"].verdict, by["other/c/1"].verdict, by["few/new/1"].verdict) == ("allow", "allow", "block")


def test_deep_and_clashing(spark):
    deep = "http://h/" + "/".join(f"s{k}x" for k in range(12))
    pages = spark.createDataFrame([(1, deep, "a", "b"), (2, deep + "y", "a", "b"), (2, deep + "y", "a", "b"), (3, None, "a", "b")], "page_id long, url string, row string, t string")
    out = url_filter.judge_urls(pages, RULES)
    assert out.count() == 4 and out.columns[:4] == ["page_id", "url", "row", "t"]
    assert {r.template for r in out.collect() if r.page_id == 1} == {"/" + "/".join("s#x" for _ in range(12))}
