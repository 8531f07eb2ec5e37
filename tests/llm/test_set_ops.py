"""Jaccard join, decontamination, HTML, URLs, chat and the pipeline on small fixtures."""

import json
import random
import re

import pytest

from kinegrain.llm import chat_format, decontaminate, html_extract, jaccard_join, url_filter
from test_text_ops import SCHEMA, odd_docs, prose

AZ = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(rows, size, num, den):
    """component of each doc_id by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(AZ))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    comp = {i: i for i in sets}
    ids = sorted(sets)
    for _ in range(len(ids)):
        old = dict(comp)
        for a in ids:
            for b in ids:
                x, y = sets[a], sets[b]
                if x and y and den * len(x & y) >= num * len(x | y):
                    comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == old:
            break
    return {i: (len(sets[i]), comp[i]) for i in ids}


def families(seed, groups, members, words, edits):
    rng = random.Random(seed)
    rows, n = [], 100
    common = prose(rng, 30)
    for _ in range(groups):
        base = prose(rng, rng.randint(*words)).split()
        for _ in range(members):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
            rows.append((n, " ".join(w) + (" " + common if n % 3 == 0 else "")))
            n += 1
    return rows


@pytest.mark.parametrize("size,num,den,words,block", [(3, 90, 100, (20, 90), 256), (5, 80, 100, (3, 60), 256), (3, 90, 100, (60, 90), 8)])
def test_jaccard_components(spark, monkeypatch, size, num, den, words, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = families(size + block, 12, 14, words, 4)
    docs = odd_docs(spark, [(i, t.upper() if i % 5 == 0 else t, None, None, 0, None, 0) for i, t in rows])
    got = {}
    for r in jaccard_join.jaccard_components(docs, size=size, num=num, den=den).collect():
        if r.doc_id is None:
            assert r.component_id is None
        else:
            got[r.doc_id] = (r.n_shingles, r.component_id)
    assert got == by_hand([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None], size, num, den)


def test_jaccard_edges(spark):
    docs = odd_docs(spark)
    assert jaccard_join.jaccard_components(docs).count() == docs.count()
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0
    one = jaccard_join.one_of_each(docs)
    assert one.columns == docs.columns and sorted(str(r.doc_id) for r in one.collect()) == ["1", "2", "3", "4", "5", "6", "None"]


def test_decontamination(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randint(20, 50))) for i in range(12)]
    bench = spark.createDataFrame([*items, (50, None), (51, "too short"), (52, items[0][1])], "item_id long, text string")
    rows = []
    for i, t in items:
        w = t.split()
        rows.append((100 + i, f"{prose(rng, 30)} {t.upper()} {prose(rng, 25)}", None, None, 0, None, 0))
        w[len(w) // 2] = "changed"
        rows.append((200 + i, f"{prose(rng, 9)}\n{' '.join(w)} {prose(rng, 5)}", None, None, 0, None, 0))
        rows.append((300 + i, f"{prose(rng, 60)} {' '.join(t.split()[:8])} {prose(rng, 60)}", None, None, 0, None, 0))
    docs = odd_docs(spark, rows)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs, bench).collect()}

    def shingles(t):
        w = WORD.findall((t or "").translate(AZ))
        return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]

    own = {i: set(shingles(t)) for i, t in [*items, (52, items[0][1])]}
    df = {}
    for s in own.values():
        for x in s:
            df[x] = df.get(x, 0) + 1
    weight = lambda s: sum(1 / df.get(x, 1) for x in s)
    want = {}
    for r in docs.collect():
        sh = shingles(r.text)
        for i, s in own.items():
            n = len(shingles(dict([*items, (52, items[0][1])])[i]))
            best = max((weight(s & set(sh[k : k + n])) / weight(s | set(sh[k : k + n])) for k in range(max(1, len(sh) - n + 1)) if sh), default=0)
            if best >= 0.8 and r.doc_id is not None:
                want[r.doc_id, i] = best
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k].similarity == pytest.approx(v) and got[k].distance <= 23
    left = decontaminate.drop_leaks(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0 and decontaminate.find_leaks(docs.limit(0), bench).count() == 0


def test_multi_index_reaches_the_radius():
    masks = set(decontaminate._near_masks())
    rng = random.Random(6)
    for _ in range(2000):
        flips = sum(1 << b for b in rng.sample(range(64), 23))
        assert any((flips >> 8 * k) & 255 in masks for k in range(8))


PAGE = (
    '<html><head><title>t</title><style>p{{}}</style></head><body><header class="site-header">Menu</header><nav><a href="/">Home</a></nav>'
    '<div id="cookie-notice">We use cookies</div><main><article><h1>Title {0}</h1><p>One &amp; <b>t</b>wo<br>three {0}<p>Last &lt;{0}&gt;</article>'
    '<section class="comments"><p>I disagree {0}</p></section></main><aside>side</aside><form>Subscribe</form><script>var x="</p>";</script><footer>&copy; {0}</footer></body></html>'
)


def test_html(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", PAGE.format(i), "x", 1) for i in range(8)]
    plain = "<div class=menu><a href=/>a link list</a></div><div class=post><p>Plain page text that is long enough.</p></div>"
    rows += [(20, None, None, None, 1), (21, "nonsense", "", None, 1), (22, "http://p/", plain, None, 1), (23, "http://h0.example/q", "<p>cut off <a hre", None, 1), (24, "http://z/", "no tags at all", None, 1)]
    pages = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string, text string, n_chars int")
    out = html_extract.extract_main_text(pages)
    got = {r.page_id: r for r in out.collect()}
    assert out.count() == len(rows) + 1
    for i in range(8):
        assert got[i].text == f"Title {i} One & two three {i} Last <{i}>" and got[i].n_chars == len(got[i].text)
    assert (got[20].text, got[21].text) == ("", "") and got[22].text == "Plain page text that is long enough."
    assert got[23].text == "cut off" and got[24].text == "no tags at all"
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


def test_html_probes(spark):
    """One common title, attributes that only look like class or id, hidden parts, telling words inside an article, and long pages."""
    page = (
        "<body><div class=menu><a href=/>Home</a> <a href=/x>More</a></div><article><h1>Common title</h1><p class='meta'>Seen by {0} people</p>"
        "<div data-id='menu'><p>Kept {0}</p></div><div hidden aria-hidden='true'><p>hidden</p></div><div class='search-results'><p>Found {0}</p></div>"
        "<div class='comments'><p>first!</p></div></article><div class=footer>fine print</div></body>"
    )
    rows = [(i, f"http://h/{i}", page.format(i)) for i in range(5)]
    blocks = "".join(f"<p>word {k}</p>" for k in range(20_000))
    rows += [(9, "http://long/1", f"<article>{blocks}</article>"), (10, "http://long/2", "<article>" + "<div>" * 150 + "deep" + "</div>" * 150 + "</article>")]
    pages = spark.createDataFrame([(*r, "a", 1, "b") for r in rows], "page_id long, url string, html string, row string, host int, slots string")
    got = {r.page_id: r for r in html_extract.extract_main_text(pages).collect()}
    for i in range(5):
        assert got[i].text == f"Common title Seen by {i} people Kept {i} Found {i}"
        assert (got[i].row, got[i].host, got[i].slots) == ("a", 1, "b")
    assert got[9].text == " ".join(f"word {k}" for k in range(20_000)) and got[10].text == "deep"


def test_text_is_chosen_by_the_wrappers_slots(spark):
    """Parts of one name at different places are told apart by the wrapper: only the part between the lists differs from page to page."""
    page = "<section><p>Same opening words</p></section><ul><li>a</li></ul><section><p>Own text {0}</p><p>and more {0}</p></section><ol><li>b</li></ol><section><p>Same closing words</p></section>"
    pages = spark.createDataFrame([(i, f"http://h/{i}", page.format(i)) for i in range(6)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract_main_text(pages).collect()} == {i: f"Own text {i} and more {i}" for i in range(6)}


def _texts(kids):
    for k in kids:
        if isinstance(k, tuple):
            yield k[0]
        else:
            yield from _texts(k.kids)


def test_slots_against_generated_pages():
    """Pages that a wrapper generates, with each text's slot known, are matched to the same slots."""
    rng = random.Random(12)

    def generate(items):
        kids = []
        for label, least, most, body in items:
            for _ in range(rng.randint(least, 3 if most == 2 else 1)):
                if label == "()":
                    kids += generate(body)
                elif label == "#":
                    kids.append((f"{body.number} {rng.random()}", 0))
                else:
                    node = html_extract.Node(label, label)
                    node.kids = generate(body)
                    kids.append(node)
        return kids

    body = [["#", 0, 1], ["p", 1, 2, [["#", 0, 1]]], ["()", 0, 2, [["dt", 1, 1, [["#", 1, 1]]], ["dd", 0, 1, [["#", 1, 2]]]]], ["ul", 0, 1, [["li", 1, 2, [["#", 1, 1], ["ol", 0, 1, [["#", 1, 1]]]]]]]]
    items = html_extract.numbered(body)
    for _ in range(300):
        kids = generate(items)
        got = list(html_extract.matched(items, kids))
        assert [t for _, _, t, _ in got] == list(_texts(kids))
        assert all(n == int(t.split()[0]) for n, _, t, _ in got)


def test_wrapper_generates_its_pages():
    pages = [
        "<div><h1>a</h1><p>x</p></div>", "<div><h1>a</h1><p>x</p><p>y</p><p>z</p></div>", "<div><p>only</p><img><ul><li>1<li>2</ul></div>",
        "<div><h1>a</h1><dl><dt>k<dd>v<dt>k<dd>v</dl></div>",
    ]
    trees = [html_extract.parse(p) for p in pages]
    wrapper = html_extract.skeleton(trees[0])
    for t in trees[1:]:
        wrapper = html_extract.align(wrapper, html_extract.skeleton(t))
    assert all(html_extract.matches(wrapper, t.kids) for t in trees)
    assert "(<p>#TEXT</>)*" in html_extract.expression(wrapper) and "|" not in html_extract.expression(wrapper)
    assert not html_extract.matches(wrapper, html_extract.parse("<table></table>").kids)


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def test_url_filter(spark):
    urls = ["http://A.Example.NET/en/1?x=/", "https://b.net/x", "http://example.com/de/", "http://x.org/fr/2#y", "http://badexample.com/de/1", "no scheme", None, "http://h.org", "http://example.com/en/1", "http://Ä.net/"]
    urls += [f"http://s.example.com/de/{i}" for i in range(30)] + [f"http://s.example.com/en/{i}" for i in range(30)] + urls[:1]
    pages = spark.createDataFrame([(i, u, "clash", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    out = url_filter.judge_urls(pages, RULES)
    got = {r.page_id: r for r in out.collect()}
    assert out.count() == len(urls)
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(AZ), m[2]) if m else ("", "")
        fits = [(len(h) + len(p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[i].host, got[i].path) == (host, path)
        assert got[i].rule == (max(fits)[1] if fits else None)
        if fits:
            assert got[i].verdict == max(fits)[2]
    assert got[8].verdict == "allow" and {got[i].verdict for i in range(40, 70)} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), RULES).count() == 0


def test_chat(spark):
    call = lambda *calls: json.dumps({"content": "x", "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", call(("b", "g", {"q": "$a", "n": "no"}), ("a", "f", {"z": 1, "a": [1, 2]}))),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "ra"})), (1, 0, "tool", json.dumps({"tool_call_id": "b", "content": "rb"})),
        (1, 3, "tool", json.dumps({"tool_call_id": "zz", "content": "?"})), (1, 4, "assistant", None), (2, 0, None, 'q"\n'),
        (3, 0, "assistant", call(("p", "f", {"z": "$q"}), ("q", "f", {"z": "$p"}), ("p", "?", {}))), (4, 0, "user", "twice"), (4, 0, "user", "twice"),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    tools = spark.createDataFrame([("f", ["z"], {"z": "integer", "a": "array"}), ("g", ["q", "m"], {"q": "string", "n": "integer", "m": "string"})], "name string, required array<string>, types map<string,string>")
    out = chat_format.link_tool_calls(messages, tools).collect()
    assert len(out) == len(rows)
    first = [r for r in out if r.conv_id == 1]
    order = [r.turn for r in sorted(first, key=lambda r: (r.order_turn, r.order_level, r.turn))]
    assert order == [0, 1, 0, 2, 3, 4]
    asked = json.loads(next(r.message for r in first if r.n_calls))["tool_calls"]
    assert [(x["id"], x["level"], x["result"], x["errors"]) for x in asked] == [("a", 0, "ra", []), ("b", 1, "rb", ["missing:m", "type:n"])]
    for r in out:
        assert r.message == json.dumps(json.loads(r.message), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    cycle = json.loads(next(r.message for r in out if r.conv_id == 3))["tool_calls"]
    assert all("cycle" in x["errors"] for x in cycle) and sum("duplicate_id" in x["errors"] for x in cycle) == 1
    assert chat_format.link_tool_calls(messages.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import os

    import corpus_pipeline

    rng = random.Random(8)
    items = [(i, prose(rng, 40)) for i in range(3)]
    base = [(i, prose(rng, 120), "en", f"s{i % 3}", 0) for i in range(60)]
    docs = base + [(100, base[0][1], "en", "s0", 0), (101, base[1][1] + " more", "en", "s1", 0), (102, f"{prose(rng, 60)} {items[1][1]} {prose(rng, 60)}", "en", "s2", 0), (103, "short", "en", "s1", 0), (104, None, None, None, None)]
    sf = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(os.path.join(sf, "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(os.path.join(sf, "benchmark.parquet"))
    kept = spark.read.parquet(os.path.join(sf, "documents.parquet"))
    want = [{*range(60), 100, 101, 102}, {*range(60), 102}, set(range(60))]
    for (name, stage), ids in zip(corpus_pipeline.STAGES, want):
        kept = corpus_pipeline.stored(stage(spark, kept, sf), name)
        assert {r.doc_id for r in kept.collect()} == ids, name
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} <= set(range(60)) and len(out) > 60
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
