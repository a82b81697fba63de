"""Links and fields of saved web pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.ids import link_url, page_file_name
from quillgraph.functions.text import CHALLENGE_CRAWLER, is_challenge

#: Fixed value: a link element with its address and content.
LINK = r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
INFO = "struct<title:string,summary:string,basic_info:map<string,string>,catalog:array<string>,content:array<string>,references:array<struct<title:string,url:string,source:string,date:string>>>"


@dataclass(frozen=True)
class Fields:
    """Classes that mark a page's fields; each value is a set of class names that an element has all of.

    ``decoded`` are the character references that become characters, written in full
    (``&amp;``), all others staying as they are; where empty, all that HTML knows do,
    also those without a semicolon.
    """

    title: str = "lemmaTitle_iuBlp J-lemma-title"
    summary: str = "lemmaSummary_dhg1F J-summary"
    info: str = "basicInfo_tLQSv J-basic-info"
    name: str = "basicInfoItem_iG0fH itemName_RXMP4"
    value: str = "basicInfoItem_iG0fH itemValue_oIfsW"
    catalog: str = "catalogList_dUefQ"
    entry: str = "catalogText_rCNjq"
    paragraph: str = "para_WzwJ3"
    reference: str = "referenceItem_Z9PAD J-ref-item"
    reference_link: str = "refLink_Pcdfd"
    main: str = "mainContent_MGLNI"
    inner_links: tuple[str, ...] = ("innerLink_KLXyc", "lemma_inlink")
    link_prefix: str = "/item/"
    base: str = "https://baike.baidu.com"
    decoded: tuple[str, ...] = ()


def links(pages: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, pos, href, text for every link with an address and a text, in page order."""
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(LINK), F.lit(2)).alias("inner"))
    rows = pages.select(*keep, F.posexplode(found).alias("pos", "a"))
    text = F.trim(F.regexp_replace("a.inner", r"(?s)<[^>]*>", ""))
    return rows.select(*keep, "pos", F.col("a.href").alias("href"), text.alias("text")).where("href <> '' and text <> ''")


def link_edges(pages: DataFrame, base: Column) -> DataFrame:
    """``(url, pos, href, text, dst)`` with absolute addresses and no query strings."""
    rows = links(pages.withColumn("__base", base), ["url", "__base"])
    absolute = F.when(F.startswith("href", F.lit("/")), F.concat("__base", F.split_part("href", F.lit("?"), F.lit(1)))).otherwise(F.split_part("href", F.lit("?"), F.lit(1)))
    return rows.withColumn("dst", absolute).drop("__base")


def without_challenges(pages: DataFrame, phrases: tuple[str, ...] = CHALLENGE_CRAWLER) -> DataFrame:
    return pages.where(~F.coalesce(is_challenge(F.col("html"), phrases), F.lit(False)))


def cached_pages(urls: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved pages of ``urls`` by file name; ``saved`` has file_name and html. Others have a null html."""
    return urls.withColumn("file_name", page_file_name(F.col("url"))).join(saved, "file_name", "left")


def first_available(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pages of two sources by url, the first one's html where it has any."""
    a, b = first.select("url", F.col("html").alias("a")), second.select("url", F.col("html").alias("b"))
    return a.join(b, "url", "full").select("url", F.coalesce("a", "b").alias("html"))


class _Element:
    def __init__(self, tag: str, attrs: dict[str, str], parent: _Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.classes = set(attrs.get("class", "").split())
        self.children: list[_Element | str] = []

    def inner(self) -> str:
        return "".join(c if isinstance(c, str) else c.inner() for c in self.children)

    def text(self) -> str:
        return self.inner().strip()

    def all(self) -> Iterator[_Element]:
        for c in self.children:
            if isinstance(c, _Element):
                yield c
                yield from c.all()

    def having(self, classes: str, tag: str | None = None) -> list[_Element]:
        need = set(classes.split())
        return [e for e in self.all() if need <= e.classes and tag in (None, e.tag)]


class _Tree(HTMLParser):
    EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())

    def __init__(self, page: str, decoded: tuple[str, ...] = ()):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Element("", {}, None)
        self.held = "&"
        if decoded:  # other ampersands pass the parser as a character that the page has not
            self.held = next(c for c in map(chr, range(0xF0000, 0x110000)) if c not in page)
            page = re.sub(f"&(?!{'|'.join(re.escape(d[1:]) for d in decoded)})", self.held, page)
        self.feed(page)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        new = _Element(tag, {k: (v or "").replace(self.held, "&") for k, v in attrs}, self.at)
        self.at.children.append(new)
        if tag not in self.EMPTY:
            self.at = new

    def handle_endtag(self, tag: str) -> None:
        e = self.at
        while e.parent and e.tag != tag:
            e = e.parent
        if e.parent:
            self.at = e.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data.replace(self.held, "&"))


def select(page: str | None, tag: str | None = None, classes: str = "") -> list[str]:
    """Texts of the elements with a tag and classes; none for broken pages."""
    return [e.text() for e in _Tree(page or "").root.having(classes, tag)]


_STEP = re.compile(r"(>?)\s*([\w-]+|\*)?((?:[.#][\w-]+|\[[^\]]+\])*)\s*")
_MARK = re.compile(r"([.#])([\w-]+)|\[\s*([\w:-]+)\s*(?:=\s*[\"']?([^\"'\]]*)[\"']?)?\s*\]")


def select_css(page: str | None, selector: str) -> list[str]:
    """Texts of the elements of a CSS selector, in page order, each once.

    Tags, classes, ids, attributes with or without value, descendants, children and
    lists by comma. Selectors of other kinds give none.
    """
    root, found = _Tree(page or "").root, []
    for part in selector.split(","):
        at, hits, part = 0, [root], part.strip()
        while at < len(part):
            step = _STEP.match(part, at)
            if step.end() == at or not (step[2] or step[3]):
                hits = []
                break
            at, marks = step.end(), _MARK.findall(step[3])

            def fits(e: _Element, tag: str | None = step[2], marks: list = marks) -> bool:
                own = lambda kind, name, key, value: name in e.classes if kind == "." else e.attrs.get("id") == name if kind == "#" else key in e.attrs and value in ("", e.attrs[key])
                return tag in (None, "", "*", e.tag) and all(own(*m) for m in marks)

            below = lambda e, child=step[1]: [c for c in e.children if isinstance(c, _Element)] if child else e.all()
            hits = list({id(e): e for h in hits for e in below(h) if fits(e)}.values())
        found += hits if part else []
    order = {id(e): n for n, e in enumerate(root.all())}
    return [e.text() for e in sorted({id(e): e for e in found}.values(), key=lambda e: order[id(e)])]


def select_xpath(page: str | None, path: str) -> list[str]:
    """Texts, or attribute values for a last step ``/@name``, of a path over elements.

    What Python's ElementTree understands: tags, ``//``, positions, and predicates on
    attributes and texts. Paths of other kinds, and broken ones, give none.
    """
    last = re.search(r"/@([\w-]+)$", path)

    def built(e: _Element) -> ElementTree.Element:
        out = ElementTree.Element(e.tag or "page", e.attrs)
        before = None
        for c in e.children:
            if isinstance(c, _Element):
                before = built(c)
                out.append(before)
            elif before is None:
                out.text = (out.text or "") + c
            else:
                before.tail = (before.tail or "") + c
        return out

    try:
        steps = path[: last.start()] if last else path
        hits = built(_Tree(page or "").root).findall("." + steps if steps.startswith("/") else steps)
    except (SyntaxError, KeyError, TypeError, RecursionError):
        return []
    return [e.attrib[last[1]] for e in hits if last[1] in e.attrib] if last else ["".join(e.itertext()).strip() for e in hits]


def page_fields(page: str | None, f: Fields = Fields()) -> dict | None:
    """Title, summary, key/value table, catalogue, paragraphs and references of a page."""
    if page is None:
        return None
    root = _Tree(page, f.decoded).root
    one = lambda found: found[0].text() if found else ""
    info = root.having(f.info)
    pairs = zip(info[0].having(f.name, "dt"), info[0].having(f.value, "dd"), strict=False) if info else ()
    catalog = []
    for item in (li for c in root.having(f.catalog) for li in c.all() if li.tag == "li"):
        if entry := [a for e in item.having(f.entry) for a in e.all() if a.tag == "a"]:
            catalog.append(("" if "level1" in item.classes else "    ") + entry[0].text())
    references = []
    for item in root.having(f.reference):
        if link := item.having(f.reference_link):
            href = link[0].attrs.get("href", "")
            spans = [e.text() for e in item.all() if e.tag == "span"] + ["", ""]
            references.append({"title": link[0].text(), "url": f.base + href if href and not href.startswith("http") else href, "source": spans[0], "date": spans[1]})
    return {"title": one(root.having(f.title, "h1")), "summary": one(root.having(f.summary, "div")), "basic_info": {k.text(): v.text() for k, v in pairs}, "catalog": catalog, "content": [t for e in root.having(f.paragraph) if (t := e.text())], "references": references}


def inner_links(page: str | None, f: Fields = Fields()) -> list[dict]:
    """Links inside the main content to pages of the same site, absolute and without query strings."""
    main = _Tree(page or "", f.decoded).root.having(f.main, "div")
    found = (a for a in main[0].all() if a.tag == "a" and a.classes & set(f.inner_links)) if main else ()
    return [{"text": a.text(), "url": f.base + h.split("?")[0]} for a in found if (h := a.attrs.get("href", "")).startswith(f.link_prefix)]


def with_fields(pages: DataFrame, fields: Fields = Fields(), html_col: str = "html") -> DataFrame:
    """Adds ``info`` and ``links``; broken pages have empty fields."""

    @F.pandas_udf(f"struct<info:{INFO},links:array<struct<text:string,url:string>>>")
    def read(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"info": [page_fields(h, fields) for h in html], "links": [inner_links(h, fields) for h in html]})

    return pages.withColumn("__read", read(F.col(html_col))).select(*pages.columns, "__read.info", "__read.links")


def flat_info(pages: DataFrame) -> DataFrame:
    """One level of ``info`` as columns; maps and arrays as JSON."""
    plain = ("title", "summary")
    return pages.select(*[c for c in pages.columns if c != "info"], *[F.col(f"info.{n}").alias(f"info_{n}") if n in plain else F.to_json(f"info.{n}").alias(f"info_{n}") for n in ("title", "summary", "basic_info", "catalog", "content", "references")])


__all__ = ["Fields", "cached_pages", "first_available", "flat_info", "inner_links", "link_edges", "link_url", "links", "page_fields", "select", "select_css", "select_xpath", "with_fields", "without_challenges"]
