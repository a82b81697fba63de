"""HTML extraction by equivalence classes of tokens over the pages of a host.

Tokens are tags (with class and id, told apart by the containers around them)
and whole text nodes. Tokens with equal occurrence vectors over the distinct
pages of a group form a class. The class that stands once in every page, in one
order, is the page template; a class that stands several times inside one of its
gaps is nested there (menus, lists). The gaps that its block tags open are the
slots, and slots decide on every page: main are the slots that article or main
elements fill, or, in groups without these, the slots inside the smallest template
container that holds the slot with the most text that is not links; slots of
links that repeat there (nested classes) are not. Blocks of the main slots that
stand on all pages of the group are template too (notices, adverts), where they
are the lesser part of every page's main text; pages that are copies of each
other share the greater part and lose nothing. Elements such as nav, aside or form
are never main text. Names of classes mean nothing.

A group is of one host, and of at least FEW distinct pages before text that all
share can be template: a page alone keeps all text of its main slots.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.scratch import Scratch

GROUP = 32  # pages deduced together, about; hosts with more are dealt to groups by a hash
FEW = 3  # distinct pages that vouch for a template of their own

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.DOTALL)
NAMING = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
#: Kinds of elements.
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html head body nav header footer aside article main section div ul ol dl table form figure dialog menu select button svg details".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption thead tbody tfoot blockquote pre address hgroup figcaption fieldset legend option summary hr".split())
OUTSIDE = frozenset("head nav footer aside form menu select button svg dialog iframe".split())
MAIN = frozenset("article main".split())


@dataclass
class Token:
    key: str  # names the token for occurrence vectors
    kind: str  # open, close, void, text
    name: str = ""
    text: str = ""
    path: tuple[str, ...] = ()
    outside: bool = False  # inside an element that is never main text
    main: bool = False  # inside article or main
    element: str = ""  # an opening tag as it stands in paths


def tokens(page: str) -> Iterator[Token]:
    """Tags and text nodes in order; comments and raw elements have no text."""
    stack: list[tuple[str, str, bool, bool]] = []  # element, named element, outside, main
    at, size = 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        closing, name, attributes = m.group(1), m.group(2), m.group(3)
        outside, main = (stack[-1][2], stack[-1][3]) if stack else (False, False)
        path = tuple(s[1] for s in stack)
        if not name:
            if m.group().startswith(("<!", "<?")):
                continue
            yield Token("/".join(path) + " " + m.group().strip(), "text", "", m.group(), path, outside, main)
            continue
        name = name.lower()
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    break
            yield Token("/".join(s[1] for s in stack) + " </" + name, "close", name, "", tuple(s[1] for s in stack), outside, main)
            continue
        marks = " ".join(v.group(2) or v.group(3) or v.group(4) or "" for v in NAMING.finditer(attributes))
        named = f"{name}.{marks}" if marks else name
        hidden = name in OUTSIDE or (name == "header" and not main)
        yield Token("/".join(path) + " <" + named, "void" if name in VOID else "open", name, "", path, outside, main, named)
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}\\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
        elif name in CONTAINERS and not attributes.endswith("/"):
            stack.append((name, named, outside or hidden, main or name in MAIN))


@dataclass
class Template:
    order: list[str] = field(default_factory=list)  # the class that stands once on every page
    nested: dict[str, list[str]] = field(default_factory=dict)  # classes that repeat inside a slot
    fixed: set[str] = field(default_factory=set)  # blocks of the main slots that stand on all pages
    main: set[str] = field(default_factory=set)  # slots, named by the template token before them
    article: set[str] = field(default_factory=set)  # main slots of which only article or main elements count


def _chain(orders: list[list[str]]) -> list[str]:
    """The tokens of the first order that stand in the same order everywhere."""
    places = [{k: i for i, k in enumerate(o)} for o in orders]
    out: list[str] = []
    last = [-1] * len(orders)
    for key in orders[0]:
        now = [p[key] for p in places]
        if all(a > b for a, b in zip(now, last, strict=True)):
            out.append(key)
            last = now
    return out


def deduce(pages: list[list[Token]]) -> Template:
    """The template of distinct pages, each given as its tokens. Of equally long slots the first counts."""
    t = Template()
    vectors: dict[str, list[int]] = defaultdict(lambda: [0] * len(pages))
    for i, page in enumerate(pages):
        for token in page:
            vectors[token.key][i] += 1
    classes: dict[tuple[int, ...], set[str]] = defaultdict(set)
    for key, vector in vectors.items():
        if all(vector):
            classes[tuple(vector)].add(key)
    once = classes.pop((1,) * len(pages), set())
    names = {token.key: token.name for page in pages for token in page}
    t.order = _chain([[token.key for token in page if token.key in once and names[token.key] in BLOCKS] for page in pages])
    mine = set(t.order)
    slots: dict[str, Counter] = defaultdict(Counter)
    where: dict[str, set[str]] = defaultdict(set)
    holder: dict[str, tuple[str, ...]] = {"": ()}
    for page in pages:
        slot, link = "", 0
        for token in page:
            if token.key in mine:
                slot = token.key
                inner = token.kind == "open" and token.name in CONTAINERS
                holder[slot] = (*token.path, token.element) if inner else token.path
            where[token.key].add(slot)
            if token.name == "a":
                link = token.kind == "open"
            if token.kind == "text" and not token.outside:
                n = len(token.text.strip())
                slots[slot].update({"text": n, "links": n * link, "main": n * token.main})
    for keys in classes.values():
        for k in sorted(k for k in keys if names[k] and len(where[k]) == 1):
            t.nested.setdefault(next(iter(where[k])), []).append(k)
    prose = {s: c["text"] - 2 * c["links"] for s, c in slots.items()}
    t.article = {s for s, c in slots.items() if c["main"]}
    largest = max(slots, key=lambda s: prose[s], default="")
    inside = holder[largest]
    menus = {s for s, keys in t.nested.items() if prose.get(s, 0) <= 0 and any(k.rpartition(" <")[2].split(".")[0] == "a" for k in keys)}
    t.main = t.article or {s for s in slots if holder[s][: len(inside)] == inside} - menus
    if len(pages) >= FEW:
        texts = [[text for _, text in _blocks(page, t)] for page in pages]
        common = set.intersection(*map(set, texts))
        if all(2 * sum(len(x) for x in own if x in common) < sum(map(len, own)) for own in texts):
            t.fixed = common
    return t


def _blocks(page: list[Token], template: Template) -> Iterator[tuple[str, str]]:
    """(slot, text with single spaces) of each block with text in the main slots."""
    mine = set(template.order)
    part: list[str] = []
    slot = ""
    for token in page:
        if token.kind != "text":
            if token.name in BLOCKS:
                if block := " ".join("".join(part).split()):
                    yield slot, block
                part.clear()
            elif token.name == "br":
                part.append(" ")
        elif not token.outside and slot in template.main and (token.main or slot not in template.article):
            part.append(html.unescape(token.text))
        if token.key in mine:
            slot = token.key
    if block := " ".join("".join(part).split()):
        yield slot, block


def main_text(page: list[Token], template: Template) -> str:
    """The blocks of the main slots that are not template, each with single spaces, one on a line."""
    return "\n".join(text for _, text in _blocks(page, template) if text not in template.fixed)


def extract_group(pages: list[str | None]) -> list[str]:
    """Main texts of pages deduced together; equal pages count once in the vectors.

    Pages with an article or main element and those without are two layouts.
    """
    parsed = {p: list(tokens(p or "")) for p in dict.fromkeys(pages)}
    layouts: dict[bool, list[list[Token]]] = defaultdict(list)
    for t in parsed.values():
        if t:
            layouts[any(token.main for token in t)].append(t)
    templates = {article: deduce(own) for article, own in layouts.items()}
    done = {p: main_text(t, templates[any(token.main for token in t)]) if t else "" for p, t in parsed.items()}
    return [done[p] for p in pages]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host and group; each group is deduced by itself."""
    held: list[dict] = []
    kind = None

    def done(rows: list[dict]) -> pa.RecordBatch:
        texts = extract_group([r["html"] for r in rows])
        return pa.RecordBatch.from_arrays([pa.array([r["id"] for r in rows], kind), pa.array([r["url"] for r in rows], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    for batch in batches:
        kind = batch.column(0).type
        for at in range(0, batch.num_rows, 256):
            for row in batch.slice(at, 256).to_pylist():
                if held and (row["host"], row["part"]) != (held[-1]["host"], held[-1]["part"]):
                    yield done(held)
                    held = []
                held.append(row)
    if held:
        yield done(held)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row for each input row.

    A host of more than GROUP pages is dealt to groups by a hash of the row, so a
    host with very many pages spreads over many tasks, and the groups, and so the
    texts, do not depend on how the rows are partitioned. Pages without a host are
    one host's. Null and empty pages have the text "". Repeated rows give repeated
    rows; extra columns are left out.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    after = F.when(F.instr(url_col, "://") > 0, F.expr(f"substr(`{url_col}`, instr(`{url_col}`, '://') + 3)"))
    host = F.coalesce(F.lower(F.regexp_extract(after, r"^([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    # Written, the table has a size that Spark knows: hosts are broadcast only below its threshold, else joined.
    large = Scratch(pages.sparkSession, "hosts").keep(rows.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > GROUP), "large")
    groups = F.ceil(F.coalesce("n", F.lit(1)) / GROUP)
    grouped = rows.join(large, "host", "left").withColumn("part", F.pmod(F.xxhash64(F.lit(31), "id", "url", "html"), groups)).drop("n")
    dealt = grouped.repartition("host", "part").sortWithinPartitions("host", "part", "id", "url", "html")
    out = dealt.select("id", "url", "html", "host", "part").mapInArrow(_extract, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col)


#: For pages whose main text is one article element, as the test tables' are.
ARTICLE_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS inner_html FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(inner_html, '</?(?:p|h1)[^>]*>'), lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(x, '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM t
"""
