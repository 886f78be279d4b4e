import json
import os
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest
from llm_fixtures import SMALL

from shelfcast.llm import html_tree as h
from shelfcast.llm import html_wrapper as w
from shelfcast.llm.common import table

SF = SMALL.replace("0.001", "0.01")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
SCHEMA = "page_id long, url string, html string, host string"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<div class="cookie-notice">We use cookies</div><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li>More</ul></nav><!-- <p>no</p> -->
<div class="ad">Buy {0}</div><article><header><h1>Title &amp; {0}</h1></header><p><b>First {0}.<br><p>Second&nbsp;<i>one {0}</i>&#33;
 and   more <span class="share-links">Tweet</span></p><p>Share this story</p><form><p>Mail</p></form><ul><li>a{0}<li>b{0}</ul>
<aside>Related</aside><div id="comments"><p>Nice</p></div></article><div class="sidebar">Side</div><footer>&copy; us</footer>"""


def pages(spark):
    rows = [(i, f"https://Ex.com:80/{i}?q=a/b", PAGE.format(i), "clash") for i in range(12)]
    rows += [(100, "https://one.org/x", PAGE.format("z"), "c"), (101, None, None, "c"), (102, "nowhere", "", "c"), (103, "http://two.org/", "<main><p>a < b &lt;tag&gt;<p>c</main><p>out", "c"), (104, "http://two.org/a", "plain & simple", "c")]
    rows += [(200 + i, "http://copy.net/", "<article><p>the very same article on every page</p></article>", "c") for i in range(20)]
    return spark.createDataFrame(rows, SCHEMA)


def texts(df, **how):
    return {r["page_id"]: r["text"] for r in w.extract(df, w.Wrapper(**how)).collect()}


def test_extract(spark):
    out = {r["page_id"]: r for r in w.extract(pages(spark)).collect()}
    assert len(out) == 37
    for i in range(12):  # a host of many pages: what all hold is template
        assert out[i]["text"] == f"Title & {i}\n\nFirst {i}.\n\nSecond one {i}! and more\n\na{i}\n\nb{i}"
    assert "Share this story" in out[100]["text"]  # one page alone has no template
    assert (out[101]["text"], out[101]["n_chars"], out[101]["url"]) == ("", 0, None) and out[102]["text"] == ""
    assert out[103]["text"] == "a < b <tag>\n\nc" and out[104]["text"] == "plain & simple"
    assert out[210]["text"] == "the very same article on every page"
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())
    assert w.extract(pages(spark).limit(0)).count() == 0
    want = {i: r["text"] for i, r in out.items()}
    assert texts(pages(spark), broadcast_bytes=0, held=1) == want
    assert texts(pages(spark).repartition(7, "html")) == want  # the layout of pages doesn't matter


class Reader(HTMLParser):
    """Blocks by the standard library, for pages whose elements are all closed."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.root = ["#root", None, []]
        self.at, self.raw = self.root, 0
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.raw += tag in h.RAW
        if tag == "br":
            self.at[2].append(" ")
        if tag not in h.INLINE and tag not in h.NO_NODE and not self.raw:
            if self.at[0] == "p":
                self.at = self.at[1]
            words = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
            self.at[2].append([".".join([tag, *sorted(set(h.PART.findall(words.lower())))]), self.at, []])
            self.at = self.at[2][-1]

    def handle_endtag(self, tag):
        self.raw -= tag in h.RAW
        node = self.at
        while node and node[0].split(".")[0] != tag:
            node = node[1]
        if node and tag not in h.INLINE:
            self.at = node[1]

    def handle_data(self, data):
        if not self.raw:
            self.at[2].append(data)


def plain_blocks(node, path=()):
    """(path of names, text) in page order."""
    out, held = [], []
    for kid in [*node[2], None]:
        if isinstance(kid, str):
            held.append(kid)
            continue
        if text := " ".join("".join(held).split()):
            out.append((path, text))
        held = []
        if kid is not None:
            out += plain_blocks(kid, (*path, kid[0]))
    return out


def plain_extract(rows, how):
    """For pages of one layout, where paths of names are the slots: host -> texts, main part by mass, constants by share."""
    groups = defaultdict(list)
    sizes = Counter(host for _, host, _ in rows)
    for i, host, source in rows:
        groups[host if sizes[host] >= how.min_pages else ""].append((i, plain_blocks(Reader(source).root)))
    out = {}
    for found in groups.values():
        slots = defaultdict(Counter)
        for _, blocks in found:
            for path, text in set(blocks):
                slots[path][text] += 1
        held = {p: sum(any(q == p for q, _ in blocks) for _, blocks in found) for p in slots}
        mass = Counter()
        for p, c in slots.items():
            for k in range(len(p) + 1):
                mass[p[:k]] += sum(map(len, c)) * ("nav" not in p)  # menus are links
        top = ()
        while kids := {p[: len(top) + 1] for p in slots if p[: len(top)] == top and len(p) > len(top)}:
            best = max(kids, key=lambda p: mass[p])
            if 2 * mass[best] < mass[top] or best[-1].split(".")[0] not in h.SECTIONS or any(p[-1] in ("p", "h1") for p in kids):
                break
            top = best
        often = {(p, t) for p, c in slots.items() for t, n in c.items() if held[p] >= how.min_pages and n >= how.min_share * held[p]}
        own = Counter()
        for _, blocks in found:
            once = set(blocks)
            if 2 * sum(len(t) for p, t in once & often if "nav" not in p) <= sum(len(t) for p, t in once if "nav" not in p):
                own.update(once & often)
        fixed = {x for x in often if own[x] >= 2 and own[x] >= how.own_share * slots[x[0]][x[1]]}
        for i, blocks in found:
            out[i] = "\n\n".join(t for p, t in blocks if p[: len(top)] == top and (p, t) not in fixed)
    return out


@needs_tables
def test_the_template_decides(spark):
    """With lists of names and article elements out of account the template still finds every article; without it no page's text is right."""
    found = table(spark, SF, "pages")
    source = {r["page_id"]: r["html"] for r in found.collect()}
    want = {i: "\n\n".join(t for _, t, _ in h.parse(s[s.index("<article>") + 9 : s.rindex("</article>")], False).texts) for i, s in source.items()}
    assert texts(found, lists=False) == want == texts(found)
    assert not any(w.content(h.parse(s, False), None, False) == want[i] for i, s in source.items())


@needs_tables
def test_against_plain(spark):
    given = table(spark, SF, "pages").selectExpr("page_id", "url", "html", "parse_url(url, 'HOST') as host").collect()
    notice = "<p>This notice stands on all pages.</p></article>"
    rows = [(r["page_id"], r["host"].lower(), r["html"].replace("</article>", notice) if r["page_id"] % 5 else r["html"]) for r in given]
    how = w.Wrapper(lists=False)
    df = spark.createDataFrame([(i, f"http://{host}/", s, "c") for i, host, s in rows], SCHEMA)
    got = texts(df, lists=False)
    assert got == plain_extract(rows, how)
    large = {host for host, n in Counter(x for _, x, _ in rows).items() if n >= 12}
    assert large and not any("This notice" in got[i] for i, host, _ in rows if host in large)


def test_short_articles_lose_a_long_notice(spark):
    notice = "A long notice that stands on all pages of this host and is longer than some of its articles. " * 3
    rows = [(i, "http://n.org/", f"<div class=x><h1>Own {i}</h1><p>{notice}</p><p>{('own words ' + str(i) + ' ') * (1 if i % 3 else 60)}</p></div>", "c") for i in range(30)]
    got = texts(spark.createDataFrame(rows, SCHEMA))
    assert not any("notice" in t for t in got.values()) and all(f"own words {i}" in t for i, t in got.items())


def test_near_copies_keep_their_text(spark):
    rows = [(i, "http://near.org/", "<nav><a>m</a></nav><article>" + "".join(f"<p>Paragraph {j} of the copied article{' changed ' + str(i) if j == i % 9 else ''}.</p>" for j in range(9)) + "</article>", "c") for i in range(40)]
    got = texts(spark.createDataFrame(rows, SCHEMA))
    assert all(t.count("\n\n") == 8 for t in got.values())


def test_slot_of_a_thousand_constants(spark):
    menu = "".join(f"<li>Item {i}</li>" for i in range(1000))
    rows = [(i, "http://menu.org/", f"<ul>{menu}</ul>" + "".join(f"<p>Own text {i} {j} {'word ' * 40}</p>" for j in range(60)), "c") for i in range(12)]
    for how in ({}, {"lists": False}):
        assert all(t.count("\n\n") == 59 and "Item" not in t for t in texts(spark.createDataFrame(rows, SCHEMA), **how).values())


def test_constant_among_many_paragraphs(spark):
    rows = [(i, "http://long.org/", "<article>" + "".join(f"<p>own {i} {j} words</p>" + ("<p>Notice on all pages</p>" if j == i % 30 else "") for j in range(30)) + "</article>", "c") for i in range(40)]
    for how in ({}, {"broadcast_bytes": 0, "held": 1}):
        assert texts(spark.createDataFrame(rows, SCHEMA), **how) == {i: "\n\n".join(f"own {i} {j} words" for j in range(30)) for i in range(40)}


def test_other_layouts_on_a_host_show_their_own_part(spark):
    rows = [(i, "http://two.net/", f"<div class=top>Site</div><div class=story><h1>T {i}</h1><p>story {i} {'x ' * 30}</p></div>", "c") for i in range(20)]
    rows += [(100 + i, "http://two.net/", f"<div class=head><p>Site</p></div><div class=body><p>other {i} {'y ' * 60}</p><p>end {i}</p></div>", "c") for i in range(3)]
    got = texts(spark.createDataFrame(rows, SCHEMA))
    assert all(got[i].startswith(f"T {i}\n\nstory {i}") for i in range(20)) and all("other" in got[100 + i] and got[100 + i].endswith(f"end {i}") for i in range(3))


def of_names(x, parents=None, keys=None, up=-1):
    """A tree from nested (name, kids)."""
    parents, keys = parents if parents is not None else [], keys if keys is not None else []
    parents.append(up)
    keys.append(x[0])
    me = len(keys) - 1
    for kid in x[1]:
        of_names(kid, parents, keys, me)
    return h.tree(parents, keys)


def best_match(a, b):
    """Simple tree matching by its definition."""
    if a[0] != b[0]:
        return 0
    best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1], 1):
        for j, y in enumerate(b[1], 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + best_match(x, y))
    return 1 + best[-1][-1]


def test_simple_tree_matching():
    import random

    rng = random.Random(4)

    def grown(depth):
        return [(name, grown(depth - 1) if depth else []) for name in rng.sample("abcdefg", rng.randrange(0, 6))]

    for _ in range(300):
        a, b = ("#root", grown(3)), ("#root", grown(3))
        left, right = of_names(a), of_names(b)
        partner, n = h.align(left, right)
        assert n == best_match(a, b) == sum(p >= 0 for p in partner)
        for i in range(1, len(partner)):
            if partner[i] >= 0:
                assert left.keys[i] == right.keys[partner[i]] and partner[left.parents[i]] == right.parents[partner[i]]


def test_depth_and_length_are_no_limit(spark):
    deep = "<div>" * 10_000 + "deep text" + "</div>" * 10_000
    wide = "".join(f"<h2>t{i}</h2><p>para {i}</p>" for i in range(5000))
    other = "".join(f"<section class=c{i % 700}><p>x{i}</p><ul><li>{i}</ul></section>" for i in range(5000))
    rows = [(i, "http://deep.org/", x, "c") for i, x in enumerate([deep, deep + "<p>more</p>", wide, wide[::-1], other, other + "<section class=c9>"])]
    began = time.time()
    got = texts(spark.createDataFrame(rows, SCHEMA))
    assert "deep text" in got[0] and got[2].count("\n\n") == 9999
    trees = [h.fold(h.parse(x))[0] for _, _, x, _ in rows]
    for a in trees:
        for b in trees:
            h.align(a, b)
    assert time.time() - began < 120


def test_markup_as_the_standard_reads_it():
    read = lambda s: [t for _, t, _ in h.parse(s).texts]
    assert read("<article><p class=don't>Hello world</p><p>it's fine</p><p>end</p></article>") == ["Hello world", "it's fine", "end"]
    assert read('<p>a</p><p title="a>Hello') == ["a"]  # a value that never closes runs to the end
    assert read("<p a='x>y' b=\"<p>\" c>one</p><p/>two") == ["one", "two"]
    assert read("a<!-->b<!--->c<!-- > --!>d<!x>e</ y>f<?z>g</>h") == ["abcdefgh"]
    assert read("1 < 2 && 3 > 2 &lt;p&gt;") == ["1 < 2 && 3 > 2 <p>"]
    page = "{}<article><p>Main</p></article>"
    for raw in ("<script>for(i=0;i<n;i++){f(i)}</script>", '<script>var s="<!--";</script>', "<STYLE>a<b{}</style >", "<title>a <b</title>", "<svg><style>x<y</style><path/></svg>", "<script>'</scripts>'<x</script\n>", "<template><script>a<b</script><template>x</template>y</template>"):
        assert read(page.format(raw)) == ["Main"], raw
    assert read("<p>before<script>if(a<b)</p>never closed") == ["before"]
    t, _ = h.fold(h.parse("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><dl><dt>x<dd>y<dt>z</dl>"))
    assert json.loads(t.dump())[1] == ["#root", "ul", "li", "ul", "li", "dl", "dt", "dd"]
