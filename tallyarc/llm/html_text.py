"""Main text of web pages by removal of site templates.

The text is the whole page without its template. Every element is a subtree of blocks;
subtrees are hashed and counted per host, and those that recur on many different pages
of the host are deleted, as are elements that say what they are (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments).

An article tag selects nothing, it only protects: within an article recurring containers
go, but no paragraph, heading, list or table, and neither an article nor what holds one
goes as a whole: a passage that many articles share is still theirs. Inline elements
amid loose text are words of it and stay. Pages with the same text outside labelled
elements count once, so a copied page doesn't become a template.

Defined cases: a null or empty page gives an empty text; a page without host counts with
the other pages without one; unclosed and stray tags are closed by what follows; a null
page_id or url stays null; repeated rows are each returned and count once; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyarc.llm.common import exact, stored

#: Elements without content, elements that are never text, elements that aren't the article, elements that part blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas select".split())
ASIDE = frozenset("nav footer aside form button dialog menu head".split())
BLOCKS = frozenset(("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
                    "legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul").split())
#: Words of class, id and role that name what isn't the article.
LABELS = frozenset(("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus footer "
                    "header masthead menu menubar nav navbar navigation newsletter notice notices notification popup modal promo related replies responses "
                    "share sharing sidebar skip social sponsor sponsored subscribe toolbar widget complementary search").split())
#: Elements of an article that may be template: all other elements in it are its text.
CONTAINERS = frozenset("div section header figure details".split())
#: An element closes an open one of the same group (a paragraph also ends where another block starts).
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I | re.S)
NAME = re.compile(r"[a-z]+")


class Element:
    __slots__ = ("children", "drop", "name", "article")

    def __init__(self, name: str, drop: bool = False, article: bool = False):
        self.name, self.drop, self.article = name, drop, article
        self.children: list = []


def labelled(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element says that it isn't part of the article. A header inside an article is its own heading."""
    if name in ASIDE or (name == "header" and not inside):
        return True
    if not attributes:
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return True
        if key in ("class", "id", "role") and any(w in LABELS for token in value.split() for w in NAME.findall(token)) and name not in ("html", "body", "main"):
            return not (inside and name == "header")
    return False


def parse(html: str) -> Element:
    """The tree of a page: elements, and texts with their character references decoded."""
    root = Element("#root")
    stack, at, n = [root], 0, len(html)
    while at < n:
        found = TOKEN.search(html, at)
        start = found.start() if found else n
        if start > at:
            stack[-1].children.append(entities.unescape(html[at:start]))
        if not found:
            break
        at = found.end()
        if found[1] is not None:
            stack[-1].children.append(found[1])
        if not found[3]:
            continue
        name = found[3].lower()
        if found[2]:
            if name == "p" and not any(e.name == "p" for e in stack):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
                if stack[k].name == "article" and name not in ("body", "html", "main"):
                    break  # a stray end doesn't close the article
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            if not found[4].rstrip().endswith("/") or name in ("script", "style", "title", "textarea"):
                at = end.end() if end else n if name in ("script", "style", "title", "textarea") else at
            continue
        if name in BLOCKS and name != "br":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    del stack[k:]
                    break
                if stack[k].name in BLOCKS:
                    break
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in CLOSES.get(name, ()):
                del stack[k:]
                break
            if stack[k].name in ("ul", "ol", "dl", "table", "select", "article", "div", "section"):
                break
        inside = any(e.article for e in stack)
        drop = labelled(name, found[4], inside)
        child = Element(name, drop, not drop and name == "article")
        stack[-1].children.append(child)
        if name not in VOID and not found[4].rstrip().endswith("/"):
            stack.append(child)
    return root


def subtree_keys(root: Element) -> dict[int, int]:
    """Key of ``root`` and every element below it: a hash of its name and of what it holds. Labelled elements aren't entered and have none."""
    order, todo = [], [root]
    while todo:
        here = todo.pop()
        order.append(here)
        todo += [c for c in here.children if isinstance(c, Element) and not c.drop]
    keys: dict[int, int] = {}
    for here in reversed(order):
        inner = "".join(f"<{keys.get(id(c))}>" if isinstance(c, Element) else " ".join(c.split()) for c in here.children)
        keys[id(here)] = xxhash.xxh64_intdigest(f"{here.name}|{inner}".encode("utf-8", "surrogatepass")) - 2**63
    return keys


def template_keys(root: Element) -> dict[int, int]:
    """Key of every element that may be template: outside articles blocks, and inline elements without loose text around them; inside, containers."""
    order, todo = [], [(root, False, False)]
    while todo:
        here, prose, inside = todo.pop()
        order.append((here, prose, inside))
        loose = any(isinstance(c, str) and c.strip() for c in here.children) or (prose and here.name not in BLOCKS)
        todo += [(c, loose, inside or here.article) for c in here.children if isinstance(c, Element) and not c.drop]
    holds, full = set(), set()
    for here, _, _ in reversed(order):
        for c in here.children:
            if isinstance(c, str):
                if c.strip():
                    full.add(id(here))
            elif not c.drop:
                if c.article or id(c) in holds:
                    holds.add(id(here))
                if id(c) in full:
                    full.add(id(here))
    keys = subtree_keys(root)
    out: dict[int, int] = {}
    for here, prose, inside in order:
        if inside:
            may = here.name in CONTAINERS
        else:
            may = not here.article and id(here) not in holds and here.name not in ("#root", "html", "body") and (here.name in BLOCKS or not prose)
        if may and id(here) in full:
            out[id(here)] = keys[id(here)]
    return out


def blocks(root: Element, recurring: frozenset[int]) -> list[str]:
    """Texts of the blocks in page order, without labelled elements and recurring subtrees."""
    keys = template_keys(root) if recurring else {}
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    todo: list = [root]
    while todo:
        here = todo.pop()
        if here is None:
            close()
        elif isinstance(here, str):
            run.append(here)
        elif here is root or not (here.drop or keys.get(id(here)) in recurring):
            if here.name in BLOCKS:
                close()
                todo.append(None)
            todo += reversed(here.children)
    close()
    return out


def host_of(url: str | None) -> str | None:
    found = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return found[1].lower() if found else None


def candidates(html: str | None) -> tuple[int, list[int]]:
    """Key of the page's text outside labelled elements, and keys of the elements that may be template."""
    root = parse(html or "")
    whole = "\0".join(blocks(root, frozenset()))
    return xxhash.xxh64_intdigest(whole.encode("utf-8", "surrogatepass")) - 2**63, sorted(set(template_keys(root).values()))


def main_text(html: str | None, recurring: frozenset[int]) -> str:
    return "\n".join(blocks(parse(html), recurring)) if html else ""


def templates(pages: DataFrame, least_pages: int = 5) -> DataFrame:
    """host_key, html_key and subtrees: per host and page source, keys of its subtrees that lie on at least ``least_pages`` different pages of the host.

    The count is the same for hosts of any size. Recurring keys meet the (page, subtree)
    rows in a join, so a list holds one page's own subtrees, never a host's.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for url, page, html_key in zip(frame["url"], frame["html"], frame["html_key"], strict=True):
                whole, keys = candidates(page)
                host = xxhash.xxh64_intdigest(host_of(url) or "") - 2**63
                rows += [(host, whole, html_key, key) for key in keys]
            yield pd.DataFrame(rows, columns=["host_key", "page_key", "html_key", "subtree"])

    seen = stored(pages.mapInPandas(run, "host_key long, page_key long, html_key binary, subtree long"))
    counts = seen.select("host_key", "subtree", "page_key").distinct().groupBy("host_key", "subtree").agg(F.count("*").alias("n"))
    many = stored(counts.where(F.col("n") >= least_pages).select("host_key", "subtree"))
    return seen.select("host_key", "html_key", "subtree").join(many, ["host_key", "subtree"]).groupBy("host_key", "html_key").agg(F.collect_set("subtree").alias("subtrees"))


def extract(pages: DataFrame, least_pages: int = 5) -> DataFrame:
    """page_id, url, text of every page. Spark broadcasts the recurring keys if their stored files are small."""
    narrow = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("html_key", F.unhex(F.md5("html")))
    found = stored(templates(narrow.select("url", "html", "html_key"), least_pages))

    @F.udf("long")
    def host_key(url):
        return xxhash.xxh64_intdigest(host_of(url) or "") - 2**63

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(page, frozenset() if keys is None else frozenset(map(int, keys))) for page, keys in zip(frame["html"], frame["subtrees"], strict=True)]
            yield frame[["page_id", "url"]].assign(text=texts)

    with_keys = narrow.withColumn("host_key", host_key("url")).join(found, ["host_key", "html_key"], "left").select("page_id", "url", "html", "subtrees")
    safe, back = exact(with_keys)
    id_type = safe.schema["page_id"].dataType.simpleString()
    return safe.mapInPandas(run, f"page_id {id_type}, url string, text string").select(back[0], "url", "text")
