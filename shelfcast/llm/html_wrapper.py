"""Main text of web pages by wrapper induction: DOM trees of a host's pages are aligned, what stays constant is template.

1. Group. Pages of a host with min_pages pages or more form a group; those of smaller hosts are pooled by layout, the
   containers in the top two levels of the host's most frequent tree.
2. Template. Its tree is the most frequent folded tree of the group, so it doesn't depend on the order of pages.
3. Align. Every page is aligned with it by simple tree matching; a text belongs to the slot of the nearest node matched.
4. Decide. What varies is measured by the characters of each slot's different texts outside links. The main part is the
   container in which they gather (html_tree.region). Texts that stand in one slot on min_share of its pages are
   constant; they are template, and go, if enough of the pages that hold them are mostly made of other texts.
   Texts that stand only on pages that are mostly constant are copies of one article, and stay.
5. Extract the texts of the main part that aren't template, without those that lists of names call boilerplate inside it.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import html_tree as h
from shelfcast.llm.common import cut, drop, ship

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
SKELETONS = "host string, code long, skeleton string, layout long, n long"
BLOCKS = "grp string, node array<int>, code array<long>, plain array<int>, chars array<int>"


@dataclass(frozen=True)
class Wrapper:
    """min_pages: pages from which a host is a group of its own and a slot can have constant texts. min_share: of a slot's pages, to make a text constant.
    own_share: of the pages that hold a constant text, those that are mostly made of other texts, to make it template.
    lists: whether names of elements, classes and roles count as evidence: boilerplate has no weight and goes inside the main part; article and main weigh double, and one with half of the weight is the main part.
    held: counts that a task holds at once. salts: parts that a host's pages are dealt to where templates are joined. broadcast_bytes: templates are broadcast up to this size, else joined."""

    min_pages: int = 8
    min_share: float = 0.6
    own_share: float = 0.25
    lists: bool = True
    held: int = 20_000
    salts: int = 16
    broadcast_bytes: int = 32 << 20


@dataclass(slots=True)
class Template:
    """A group's tree, which of its nodes are the main part, whether links decide inside it, the slots of links, and the template texts (slot, code)."""

    name: str
    tree: h.Tree
    top: int
    inside: list[bool]
    links: frozenset[int]
    fixed: frozenset[tuple[int, int]]


def signed(code: int) -> int:
    return code - (1 << 64) if code >> 63 else code


def code_of(text: str) -> int:
    import xxhash

    return signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))


def layout(t: h.Tree) -> int:
    """The containers of the top two levels."""
    tops = [k for k in t.kids[0] if t.tags[k] in h.SECTIONS]
    return code_of(json.dumps([[t.keys[k].partition("~")[0], *(t.keys[x].partition("~")[0] for x in t.kids[k] if t.tags[x] in h.SECTIONS)] for k in tops]))


def weights(page: h.Page, lists: bool) -> list[int]:
    """What a character of a node's text counts as evidence of the main part: 1, and with lists 0 in boilerplate and 2 in article or main."""
    out = [1] * len(page.tags)
    if lists:
        for i in range(1, len(out)):
            up = out[page.parents[i]]
            out[i] = 0 if page.marked[i] or not up else 2 if page.tags[i] in ("article", "main") else up
    return out


def blocks(page: h.Page, at: list[int], lists: bool) -> dict[tuple[int, int], tuple[int, int]]:
    """A page's different texts by slot and code, with their weighed characters outside links and their characters; code 0 for the slot itself."""
    weigh, out = weights(page, lists), {}
    for node, text, plain in page.texts:
        out[at[node], 0] = (0, 0)
        out[at[node], code_of(text) or 1] = (plain * weigh[node], len(text))
    return out


def content(page: h.Page, template: Template | None, lists: bool = True) -> str:
    """The texts of the page's main part that aren't template, in page order.

    A page on which the template's main part is missing, or whose template has none below its root, shows its main
    part by its own texts that aren't template. Without a template the whole page is its main part.
    """
    folded, of = h.fold(page)
    partner, _ = h.align(folded, template.tree) if template else ([], 0)
    at = h.slots(page, of, folded, partner) if template else of
    known = [(node, text, plain) for node, text, plain in page.texts if not template or (at[node] not in template.links and (at[node], code_of(text) or 1) not in template.fixed)]
    if not template:
        inside, main = [True] * len(of), [j == 0 for j in of]
    elif template.top and template.top in partner:
        inside, main = [template.inside[s] for s in at], [partner[j] == template.top for j in of]
    else:
        mass, weigh = [0] * len(folded.keys), weights(page, lists)
        for node, _, plain in known:
            mass[of[node]] += plain * weigh[node]
        top = h.region(folded, mass, [x > 0 for x in mass], lists)
        within = h.below(folded, top)
        inside, main = [within[j] for j in of], [j == top for j in of]
    skip = [False] * len(of)
    if lists:  # what stands above the main part says nothing about it
        for i in range(1, len(skip)):
            skip[i] = not main[i] and (page.marked[i] or skip[page.parents[i]])
    return "\n\n".join(text for node, text, _ in known if inside[node] and not skip[node])


def skeletons(pages: DataFrame, how: Wrapper) -> DataFrame:
    """host, code, skeleton, layout, n: the folded trees of each host's pages and how many have them. pages needs host and html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}

        def out() -> pa.RecordBatch:
            rows = [(host, code, *x) for (host, code), x in held.items()]
            held.clear()
            return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["host", "code", "skeleton", "layout", "n"])

        for batch in batches:
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                folded, _ = h.fold(h.parse(source.as_py(), how.lists))
                made = folded.dump()
                key = host, code_of(made)
                if key in held:
                    held[key][2] += 1
                else:
                    held[key] = [made, layout(folded), 1]
                if len(held) > how.held:
                    yield out()
        if held:
            yield out()

    found = pages.select("host", "html").mapInArrow(run, SKELETONS)
    return found.groupBy("host", "code").agg(F.min("skeleton").alias("skeleton"), F.min("layout").alias("layout"), F.sum("n").alias("n"))


def grouped(found: DataFrame, how: Wrapper) -> tuple[DataFrame, DataFrame]:
    """host and grp; grp and skeleton, the most frequent one of its pages, of equally frequent ones that of the greatest code."""
    hosts = found.groupBy("host").agg(F.sum("n").alias("pages"), F.max(F.struct("n", "code", "layout"))["layout"].alias("layout"))
    grp = F.when(F.col("pages") >= how.min_pages, F.concat(F.lit("host "), "host")).otherwise(F.concat(F.lit("layout "), F.col("layout").cast("string")))
    hosts = hosts.select("host", grp.alias("grp"))
    trees = found.join(hosts, "host").groupBy("grp", "code").agg(F.min("skeleton").alias("skeleton"), F.sum("n").alias("n"))
    best = trees.groupBy("grp").agg(F.max(F.struct("n", "code", "skeleton"))["skeleton"].alias("skeleton"))
    return hosts, best


@functools.lru_cache(maxsize=256)
def load(name: str, made: str) -> Template:
    x = json.loads(made)
    t = h.load(x["skeleton"])
    top = x.get("top") or 0
    fixed = frozenset((f["node"], f["code"]) for f in x.get("fixed") or [])
    return Template(name, t, top, h.below(t, top), frozenset(x.get("links") or []), fixed)


def with_templates(rows: DataFrame, templates: DataFrame, how: Wrapper) -> tuple[DataFrame, Callable[[pa.RecordBatch], Callable[[int], Template]]]:
    """rows with what it takes to find each row's template in a task, and how: templates (host, grp, template) are sent to the workers once if they are small, else joined by host and a part of its pages."""
    key = F.greatest(F.octet_length("host") + F.octet_length("grp") + F.octet_length("template"), F.lit(0))
    size = templates.agg(F.sum(key.cast("long"))).first()[0] or 0
    if size <= how.broadcast_bytes:
        table = {r["host"]: (r["grp"], r["template"]) for r in templates.collect()}
        sent = rows.sparkSession.sparkContext.broadcast(table)

        def by_host(batch: pa.RecordBatch) -> Callable[[int], Template]:
            hosts, known = batch.column("host").to_pylist(), sent.value
            return lambda i: load(*known[hosts[i]])

        return rows, by_host
    salt = F.pmod(F.xxhash64("html"), F.lit(how.salts))
    parts = templates.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(how.salts - 1).cast("long"))))
    joined = rows.withColumn("salt", salt).join(parts, ["host", "salt"]).drop("salt")

    def by_row(batch: pa.RecordBatch) -> Callable[[int], Template]:
        grp, made = batch.column("grp"), batch.column("template")
        return lambda i: load(grp[i].as_py(), made[i].as_py())

    return joined, by_row


def aligned(pages: DataFrame, templates: DataFrame, how: Wrapper) -> DataFrame:
    """The texts of each page as BLOCKS, without the texts themselves."""
    rows, finder = with_templates(pages.select("host", "html"), templates, how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            find, out = finder(batch), []
            for i, source in enumerate(batch.column("html")):
                page, template = h.parse(source.as_py(), how.lists), find(i)
                folded, of = h.fold(page)
                partner, _ = h.align(folded, template.tree)
                found = blocks(page, h.slots(page, of, folded, partner), how.lists)
                out.append((template.name, [k[0] for k in found], [k[1] for k in found], [v[0] for v in found.values()], [v[1] for v in found.values()]))
            kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["grp", "node", "code", "plain", "chars"])

    return rows.mapInArrow(run, BLOCKS)


def main_parts(best: DataFrame, texts: DataFrame, how: Wrapper) -> DataFrame:
    """grp, skeleton, top, links: the main part of each group by the different texts of its slots, each counted once."""
    real = F.col("code") != 0
    stats = texts.groupBy("grp", "node").agg(
        F.sum("plain").alias("mass"), F.sum("chars").alias("chars"), F.count_if(real & (F.col("plain") > 0)).alias("kinds"), F.max(F.when(~real, F.col("n"))).alias("pages")
    )
    # A row for each node of the group's tree that has texts: no more than one page's nodes.
    by = stats.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("node", "mass", "chars", "kinds", "pages"))).alias("stats"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops, links = [], []
            for skeleton, found in zip(batch.column("skeleton").to_pylist(), batch.column("stats").to_pylist(), strict=True):
                t = h.load(skeleton)
                mass, varies = [0] * len(t.keys), [False] * len(t.keys)
                for x in found or []:
                    mass[x["node"]], varies[x["node"]] = x["mass"], 2 * x["kinds"] >= x["pages"] and x["kinds"] > 0
                tops.append(top := h.region(t, mass, varies, how.lists))
                # Where no container holds the main part, slots of links in lists are menus.
                flat = top == 0
                links.append([x["node"] for x in found or [] if flat and t.tags[x["node"]] in ("li", "ul", "ol") and x["chars"] and not x["mass"]])
            yield pa.record_batch([batch.column("grp"), batch.column("skeleton"), pa.array(tops, pa.int32()), pa.array(links, pa.list_(pa.int32()))], names=["grp", "skeleton", "top", "links"])

    return best.join(by, "grp", "left").select("grp", "skeleton", "stats").mapInArrow(run, "grp string, skeleton string, top int, links array<int>")


def constants(pages: DataFrame, texts: DataFrame, how: Wrapper) -> DataFrame:
    """grp, node, code: the constant texts that are template. pages is BLOCKS, texts its counts."""
    slots = texts.where((F.col("code") == 0) & (F.col("n") >= how.min_pages)).select("grp", "node", F.col("n").alias("pages"))
    often = texts.where((F.col("code") != 0) & (F.col("n") >= how.min_share * how.min_pages)).join(slots, ["grp", "node"]).where(F.col("n") >= how.min_share * F.col("pages"))
    often = cut(often.select("grp", "node", "code", F.col("n").alias("held")), "constants")
    by = often.groupBy("grp").agg(F.collect_list(F.struct("node", "code")).alias("often"))
    # A group's constants are few: each stands on min_share of its slot's pages. They meet the parts of its pages.
    salt = F.pmod(F.xxhash64("code"), F.lit(how.salts))
    parts = by.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(how.salts - 1).cast("long"))))
    met = pages.withColumn("salt", salt).join(parts, ["grp", "salt"]).withColumn("texts", F.arrays_zip("node", "code", "plain"))
    is_often = lambda x: F.array_contains("often", F.struct(x["node"].alias("node"), x["code"].alias("code")))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x["plain"])
    met = met.withColumn("fixed", F.filter("texts", is_often))
    own = met.where(2 * total(F.col("fixed")) <= total(F.col("texts"))).select("grp", F.explode("fixed").alias("x")).groupBy("grp", F.col("x.node").alias("node"), F.col("x.code").alias("code")).agg(F.count(F.lit(1)).alias("own"))
    return often.join(own, ["grp", "node", "code"]).where((F.col("own") >= 2) & (F.col("own") >= how.own_share * F.col("held"))).select("grp", "node", "code")


def induce(rows: DataFrame, how: Wrapper) -> DataFrame:
    """host, grp, template (JSON) of all hosts in rows (host, html)."""
    seen = [cut(skeletons(rows, how), "skeletons")]
    hosts, best = grouped(seen[0], how)
    hosts, best = cut(hosts, "hosts"), cut(best, "trees")
    first = cut(hosts.join(best.select("grp", F.to_json(F.struct("skeleton")).alias("template")), "grp").select("host", "grp", "template"), "templates")
    found = cut(aligned(rows, first, how), "blocks")
    each = found.select("grp", F.explode(F.arrays_zip("node", "code", "plain", "chars")).alias("x")).select("grp", "x.*")
    texts = cut(each.groupBy("grp", "node", "code").agg(F.count(F.lit(1)).alias("n"), F.max("plain").alias("plain"), F.max("chars").alias("chars")), "texts")
    fixed = constants(found, texts, how).groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("node", "code"))).alias("fixed"))
    made = main_parts(best, texts, how).join(fixed, "grp", "left").select("grp", F.to_json(F.struct("skeleton", "top", "links", "fixed")).alias("template"))
    out = cut(hosts.join(made, "grp").select("host", "grp", "template"), "templates")
    drop(*seen, hosts, best, first, found, texts)
    return out


def _host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def extract(pages: DataFrame, how: Wrapper = Wrapper()) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages.

    pages needs page_id, url and html; other columns are ignored. A null html is empty and has an empty text; a null
    or relative url has the host ''. Repeated rows each get their row, an empty table gives none. Broken markup is
    read as HTML's tokenizer does, as far as it goes, at any depth; a text of any length is one text. Texts are
    counted exactly, however many share a slot, so the result doesn't depend on how pages are partitioned. A host
    with fewer than how.min_pages pages shares its template with small hosts of its layout; a group that stays
    smaller has no constant texts, but a main part.
    """
    ship(pages.sparkSession)
    url = F.col("url").cast("string")
    rows = pages.select("page_id", url.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), _host(url).alias("host"))
    templates = induce(rows.select("host", "html"), how)
    joined, finder = with_templates(rows, templates, how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            find = finder(batch)
            texts = [content(h.parse(source.as_py(), how.lists), find(i), how.lists) for i, source in enumerate(batch.column("html"))]
            columns: list[Any] = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.record_batch(columns, names=["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
