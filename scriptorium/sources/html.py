"""Saved pages as a source: result cards, profiles, export links.

Pages are read whole and parsed where they are read, in Arrow batches, with the
standard library's parser; everything behind the page's structure (numbers,
bylines, URLs) is done by column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.urls import absolute

#: Fixed values of the markup: elements without an end; elements whose begin ends an open one of a kind, but not beyond its container.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
ENDS = {**{b: ("p", ("div", "td", "body", "li", "button")) for b in BLOCKS}, "li": ("li", ("ul", "ol")), "tr": ("tr", ("table", "tbody", "thead")), "td": ("td", ("tr", "table")), "th": ("td", ("tr", "table")), "option": ("option", ("select",))}


class Node:
    __slots__ = ("attrs", "kids", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []

    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                todo += reversed(n.kids)
        return "".join(out)

    def walk(self) -> Iterator[Node]:
        """The nodes below, in order of the page; a stack, so that no page is too deep."""
        todo = [k for k in reversed(self.kids) if isinstance(k, Node)]
        while todo:
            n = todo.pop()
            yield n
            todo += [k for k in reversed(n.kids) if isinstance(k, Node)]

    def find(self, tag: str | None = None, classes: str = "", ident: str | None = None, href: bool = False) -> Iterator[Node]:
        need = set(classes.split())
        for n in self.walk():
            if (tag is None or n.tag == tag) and need <= n.classes() and (ident is None or n.attrs.get("id") == ident) and (not href or "href" in n.attrs):
                yield n

    def first(self, *args, **kw) -> Node | None:
        return next(self.find(*args, **kw), None)

    def inside(self, classes: str) -> bool:
        need, n = set(classes.split()), self.parent
        while n is not None:
            if need <= n.classes():
                return True
            n = n.parent
        return False


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            kind, within = ENDS[tag]
            n = self.at
            while n is not None and n.tag != kind and n.tag not in within:
                n = n.parent
            if n is not None and n.tag == kind and n.parent is not None:
                self.at = n.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.kids.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def parse_html(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def _href(n: Node | None) -> str | None:
    return None if n is None else n.attrs.get("href")


#: The links of a card's footer by what their address has and lacks.
FOOTER = (("cited", "cites=", "cluster="), ("versions", "cluster=", ""), ("related", "related:", ""))


#: Texts of a card, of a row of a profile and of its head by the tag, class and id that mark them.
CARD_TEXTS = {"byline": ("div", "gs_a", None), "snippet": ("div", "gs_rs", None)}
ROW_TEXTS = {"year": ("span", "gsc_a_h", None), "cites": ("a", "gsc_a_ac", None)}
HEAD_TEXTS = {"name": (None, "", "gsc_prf_in"), "organization": ("a", "gsc_prf_ila", None)}


def _texts(root: Node, marks: dict[str, tuple[str | None, str, str | None]]) -> dict[str, str | None]:
    """The text of the first element with each mark, null where there is none."""
    found = {name: root.first(*mark) for name, mark in marks.items()}
    return {name: None if n is None else n.text() for name, n in found.items()}


def _cards(root: Node) -> list[dict]:
    out = []
    for k, card in enumerate(root.find("div", "gs_r gs_or gs_scl")):
        heading = card.first("h3", "gs_rt")
        if heading is None:
            continue
        links = list(card.find("a", href=True))
        foot = {kind: a for a in links if a.inside("gs_fl") for kind, has, lacks in FOOTER if has in a.attrs["href"] and not (lacks and lacks in a.attrs["href"])}
        side = next((a for a in links if a.inside("gs_or_ggsm") or a.inside("gs_ggsd")), None)
        badge = None if side is None else side.first("span", "gs_ctg2")
        anchor = heading.first("a", href=True)
        said = {name: text or "" for name, text in _texts(card, CARD_TEXTS).items()}
        linked = {f"{kind}_href": _href(foot.get(kind)) for kind, _, _ in FOOTER} | {f"{kind}_text": foot[kind].text() if kind in foot else None for kind in ("cited", "versions")}
        own = {"index": k, "cluster_id": card.attrs.get("data-cid"), "title": (anchor or heading).text(), "link": _href(anchor), "resource_link": _href(side), "resource_type": None if badge is None else badge.text().strip().strip("[]")}
        out.append(own | said | linked)
    return out


CARD = "struct<index:int,cluster_id:string,title:string,link:string,resource_link:string,resource_type:string,byline:string,snippet:string,cited_text:string,cited_href:string,versions_text:string,versions_href:string,related_href:string>"
ROW = "struct<index:int,title:string,href:string,authors:string,venue:string,year:string,cites:string,cites_href:string>"
HEADER = "struct<name:string,affiliation:string,organization:string,homepage:string,verified_email:string,interests:array<string>,stats:array<array<string>>>"


def _rows(root: Node) -> list[dict]:
    out = []
    for k, row in enumerate(root.find("tr", "gsc_a_tr")):
        title, gray = row.first("a", "gsc_a_at"), [n.text() for n in row.find("div", "gs_gray")]
        if title is not None:
            said = _texts(row, ROW_TEXTS)
            out.append({"index": k, "title": title.text(), "href": title.attrs.get("href", ""), "authors": (gray + [None])[0], "venue": (gray + [None, None])[1], "year": said["year"] or "", "cites": said["cites"], "cites_href": _href(row.first("a", "gsc_a_ac"))})
    return out


def _header(root: Node, own_host: str) -> dict:
    lines = [n for n in root.find("div", "gsc_prf_il") if not n.attrs.get("id")]  # the first is the affiliation, the organisation a link in it
    said = _texts(root, {"name": HEAD_TEXTS["name"]}) | (_texts(lines[0], {"organization": HEAD_TEXTS["organization"]}) if lines else {"organization": None})
    contact, tags, table = (root.first(ident=i) for i in ("gsc_prf_ivh", "gsc_prf_int", "gsc_rsb_st"))
    away = [h for a in (contact.find("a", href=True) if contact else ()) if (h := a.attrs["href"]).startswith(("http://", "https://")) and own_host not in h]
    bare = " ".join("".join(k for k in contact.kids if isinstance(k, str)).split()).strip(" -–") if contact else ""
    filled = [tr for tr in (table.find("tr") if table else ()) if tr.first("td") is not None]
    return {
        "name": said["name"] or "", "affiliation": lines[0].text() if lines else None, "organization": said["organization"], "homepage": (away + [None])[0], "verified_email": bare or None,
        "interests": [a.text() for a in tags.find("a")] if tags else [], "stats": [[td.text() for td in tr.find("td", "gsc_rsb_std")][:2] for tr in filled],
    }


def _mapped(pages: DataFrame, page_id: str, html: str, kind: str, parse) -> DataFrame:
    src = pages.select(F.col(page_id).alias("page"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    page_type = src.schema["page"].dataType.simpleString()
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL(f"page {page_type}, got {kind}")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [parse(parse_html(h)) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, arrow.field(1).type)], schema=arrow)

    return src.mapInArrow(run, schema)


def result_cards(pages: DataFrame, host: Column, page_id: str = "page_id", html: str = "html", start: str | None = None) -> DataFrame:
    """``page`` and the record fields of every card of saved result pages (``citation_only`` where a
    card has no link); ``start`` names a column with the page's offset."""
    found = _mapped(pages, page_id, html, f"array<{CARD}>", _cards)
    if start:
        found = found.join(pages.select(F.col(page_id).alias("page"), F.col(start).alias("start")), "page")
    else:
        found = found.withColumn("start", F.lit(0))
    rows = found.select("page", "start", F.inline("got"))
    b = tx.split_byline(tx.collapse(F.col("byline")))
    return rows.select(
        "page", "cluster_id", (F.col("start") + F.col("index") + 1).cast("long").alias("position"), tx.strip_tag(tx.collapse(F.col("title"))).alias("title"), absolute(F.col("link"), host).alias("link"),
        absolute(F.col("resource_link"), host).alias("resource_link"), "resource_type", tx.collapse(F.col("byline")).alias("byline"), b["authors"].alias("authors"), b["venue"].alias("venue"),
        b["year"].alias("year"), tx.collapse(F.col("snippet")).alias("snippet"), tx.first_int(F.col("cited_text")).alias("cited_by_count"), absolute(F.col("cited_href"), host).alias("cited_by_url"),
        tx.first_int(F.col("versions_text")).alias("versions_count"), absolute(F.col("versions_href"), host).alias("versions_url"), absolute(F.col("related_href"), host).alias("related_url"),
        F.col("link").isNull().alias("citation_only"), F.col("start").cast("long").alias("page_start"),
    )


def page_facts(pages: DataFrame, page_id: str = "page_id", html: str = "html", start: str | None = None) -> DataFrame:
    """``page``, ``total_estimate`` (greatest number of the banners), ``has_next``."""
    at = F.col(start) if start else F.lit(0)
    banners = F.regexp_extract_all(F.col(html), F.lit(r"""(?s)<div[^>]*class=["'][^"']*gs_ab_mdw[^"']*["'][^>]*>(.*?)</div>"""), F.lit(1))
    numbers = tx.all_ints(tx.collapse(F.regexp_replace(F.array_join(banners, " ; "), "<[^>]+>", "")))
    starts = F.transform(F.regexp_extract_all(F.col(html), F.lit(r"""<a[^>]+href=["'][^"']*[?&](?:amp;)?start=(\d+)"""), F.lit(1)), lambda x: x.try_cast("bigint"))
    return pages.select(F.col(page_id).alias("page"), F.array_max(numbers).alias("total_estimate"), F.coalesce(F.exists(starts, lambda x: x > at), F.lit(False)).alias("has_next"))


def profile_headers(pages: DataFrame, own_host: str, page_id: str = "user_id", html: str = "html") -> DataFrame:
    """Profile fields of saved profile pages."""
    h = F.col("got")
    stat = lambda r, c: tx.first_int(F.get(F.get(h["stats"], F.lit(r)), F.lit(c)))
    tidy = lambda c: tx.filled(tx.collapse(c))
    found = _mapped(pages, page_id, html, HEADER, lambda root: _header(root, own_host))
    return found.select(
        F.col("page").alias("user_id"), tx.collapse(h["name"]).alias("name"), tidy(h["affiliation"]).alias("affiliation"), tidy(h["organization"]).alias("organization"), h["homepage"].alias("homepage"),
        h["verified_email"].alias("verified_email"), F.transform(h["interests"], tx.collapse).alias("interests"), stat(0, 0).alias("cited_by_total"), stat(0, 1).alias("cited_by_recent"),
        stat(1, 0).alias("h_index"), stat(1, 1).alias("h_index_recent"), stat(2, 0).alias("i10_index"), stat(2, 1).alias("i10_index_recent"),
    )


def profile_rows(pages: DataFrame, host: Column, page_id: str = "user_id", html: str = "html") -> DataFrame:
    """Publication rows of saved profile pages as records."""
    rows = _mapped(pages, page_id, html, f"array<{ROW}>", _rows).select("page", F.inline("got"))
    authors, venue = tx.collapse(F.col("authors")), tx.strip_year(tx.collapse(F.col("venue")))
    count = F.when(F.col("cites").isNotNull(), F.coalesce(tx.first_int(F.col("cites")), F.lit(0)))
    return rows.select(
        F.col("page").alias("user_id"), (F.col("index") + 1).cast("long").alias("position"), tx.collapse(F.col("title")).alias("title"), absolute(F.col("href"), host).alias("link"),
        F.concat_ws(" - ", tx.filled(authors), venue).alias("byline"), authors.alias("authors"), venue.alias("venue"), tx.first_int(F.col("year")).alias("year"), count.cast("long").alias("cited_by_count"),
        absolute(F.col("cites_href"), host).alias("cited_by_url"), F.concat(F.lit("author:"), F.col("page")).alias("query"), tx.filled(F.regexp_extract("href", "citation_for_view=(.*)$", 1)).alias("citation_id"),
    )


def has_more(html: Column) -> Column:
    """Whether a profile page offers more rows."""
    button = F.regexp_extract(html, r"""(<button[^>]*id=["']gsc_bpf_more["'][^>]*>)""", 1)
    return (button != "") & ~button.rlike(r"\sdisabled(\s|=|>|/)")


def bibtex_link(html: Column) -> Column:
    """First href of a popup that exports an entry."""
    hrefs = F.regexp_extract_all(html, F.lit(r"""<a\b[^>]*\bhref=["']([^"']*)["']"""), F.lit(1))
    hit = F.get(F.filter(hrefs, lambda h: h.contains("scholar.bib") | h.contains("scisf=4")), F.lit(0))
    return F.replace(hit, F.lit("&amp;"), F.lit("&"))


def register_page_functions(spark: SparkSession) -> None:
    """``page_cards(html)`` for SQL: one row for each card of a saved result page, its texts as they stand."""
    fields = [x.split(":", 1) for x in CARD[7:-1].split(",")]

    @F.udtf(returnType=", ".join(f"{n} {k}" for n, k in fields))
    class PageCards:
        def eval(self, html: str):
            for card in _cards(parse_html(html or "")):
                yield tuple(card[n] for n, _ in fields)

    spark.udtf.register("page_cards", PageCards)
