"""Main text of web pages with a site style tree.

The pages of a host are merged into one tree: a node is a path of elements (tag, classes and id,
digits aside).  Over the pages that contain a node, Spark counts the variants of its inner structure
(presentation) and of its text (content); the entropy of either, relative to its maximum, is its
importance.  A branch that looks and reads the same on page after page has importance near zero and
is removed from the pages of the host, except from a page of whose text it holds most: pages of equal
text count as one page, and a text that many pages share is still a text.  Elements whose tag or role
states that they are no article text (menus, forms, ...) have importance zero from the start, because
such a part may well change from page to page and no entropy shows it.  A class or id that states so
(adverts, comments, ...) is a prior only: layout wrappers bear such names too, so the branch stays if
it holds most of the page's text, NAMED_ODDS times that of the unnamed text around it, and its
importance is not low.  Forms, dialogs, hidden elements and branches named header may wrap a whole page as well:
they stay if they hold WRAPPED_ODDS times the text around them.  Plain prose elements inside
an article are never removed for being alike: copies of an article are still articles.

If a page has article or main elements that keep any text, only their text counts, unless a branch
beside them holds most of the kept text: then they are teasers, and all kept text counts.

Defined cases: null or empty html has no text; a page without tags is one block; pages without url
form one host of their own; unclosed elements, stray end tags and cut-off pages are read as far as
they go; repeated pages are one page of the tree and a row each of the result; an empty table gives an empty result; other columns are
not read.
"""
from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, saved, table

PRIOR_PAGES = 1       # pages of full importance that every node is given, so few pages prove little
LEAST_IMPORTANCE = 0.2
CONTENT_WEIGHT = 0.9  # of content importance; the rest is presentation
NAMED_ODDS = 4        # a branch named like boilerplate must hold so many times the unnamed text around it
WRAPPED_ODDS = 20     # and one that is rarely more than a part of a page, such as a form, so many times
MASK = (1 << 63) - 1

# Names below are fixed values.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript template iframe xmp noframes".split())
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: an opening element ends an open one of the second set, looked for up to one of the third
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
PROSE = set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th section div figure figcaption details summary center hgroup address".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
NO_TEXT = set("nav footer aside button select option optgroup datalist object applet embed svg canvas audio video menu search map frameset progress meter input".split())
NO_TEXT_ROLES = set("navigation banner contentinfo complementary search alert alertdialog menu menubar toolbar".split())
NO_TEXT_NAMES = set("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promos banner cookie cookies consent gdpr notice notices
alert popup modal overlay menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside widget widgets masthead topbar footer foot copyright
comment comments disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe subscription
signup login search pagination pager toolbar skip skiplink""".split())
WRAPPERS = {"form", "dialog"}  # elements and roles
HEAD_NAMES = {"header"}
NOT_REALLY = {"has", "no", "with", "without", "hide", "hides"}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>""", re.S)
DIGITS = re.compile(r"\d+").sub
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class _Element:
    """What the parser has to know about an opening tag below a given path."""

    __slots__ = ("tag", "path", "sign", "drop", "named", "soft", "main", "plain", "head")


class Parser:
    """Reads pages into blocks; remembers elements seen before."""

    def __init__(self):
        self.memo: dict = {}

    def _element(self, above: _Element | None, tag: str, attributes: str) -> _Element:
        key = (*((above.path, above.drop, above.named, above.soft, above.main, above.head) if above else ()), tag, attributes)
        found = self.memo.get(key)
        if found is not None:
            return found
        names, role, hidden, unread = [], "", False, False
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                names += value.split()
            elif name == "role":
                role = value.lower()
            elif name == "aria-hidden":
                unread = value.lower() == "true"
            elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                hidden = True
        e = _Element()
        signs = sorted({re.sub(r"\d+", "#", n.lower()) for n in names})
        e.tag, e.sign = tag, " ".join([tag, *signs])
        e.path = xxhash.xxh64_intdigest(f"{above.path if above else 0}|{e.sign}") & MASK
        parts = set()
        for n in names:
            words = [w.lower() for w in NAME_PART.findall(n)]
            parts.update(w for i, w in enumerate(words) if not i or words[i - 1] not in NOT_REALLY)
        whole = tag in ("html", "body", "article", "main")
        begins = tag in ("article", "main") or role in ("main", "article")
        e.main = (above.main if above else False) or begins
        headed = not whole and bool(parts & HEAD_NAMES)
        e.head = (above.head if above and not begins else False) or tag == "header" or headed
        named = bool(parts & NO_TEXT_NAMES) and (not whole or tag == "article" and bool(parts & {"comment", "comments", "reply"}))
        e.drop = (above.drop if above else False) or unread or tag in NO_TEXT or role in NO_TEXT_ROLES or tag == "header" and not e.main
        wraps = hidden or tag in WRAPPERS or role in WRAPPERS or headed and not e.main
        e.soft = (above.soft if above else ()) + ((e.path,) if wraps else ())
        # branches named like boilerplate, the outermost first
        e.named = (above.named if above else ()) + ((e.path,) if named else ())
        # plain prose below an article or main element
        e.plain = e.main and (tag in ("article", "main") or (above.plain if above else False) and tag in PROSE and not names)
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[key] = e
        return e

    def blocks(self, page: str) -> tuple[list[tuple[str, bool, tuple]], dict[int, list[str]]]:
        """(text, whether it may be article text, names aside, elements around it) of every block; children by path."""
        stack: list[_Element] = [self._element(None, "#page", "")]
        out, pieces, children = [], [], {}
        at = 0

        def flush():
            if pieces:
                text = " ".join(entities.unescape("".join(pieces)).split())
                pieces.clear()
                top = stack[-1]
                if text:  # of a header within an article only headings are text
                    headed = top.head and top.main
                    out.append((text, not top.drop and (not headed or any(e.tag in HEADINGS for e in stack)), tuple(stack)))

        size = len(page)
        while at < size:
            m = TOKEN.search(page, at)
            if m is None:
                pieces.append(page[at:])
                break
            if m.start() > at:
                pieces.append(page[at:m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                continue
            tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
            if closing:
                if tag in INLINE and stack[-1].tag != tag:
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        flush()
                        del stack[k:]
                        break
                else:
                    if tag not in INLINE:
                        flush()
                continue
            if tag in RAW:
                end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at) if tag not in _ENDS_OF else _ENDS_OF[tag].search(page, at)
                close = page.find(">", end.end()) if end else -1
                at = size if close < 0 else close + 1
                if tag in ("textarea", "iframe", "title"):
                    flush()
                continue
            if tag in INLINE:
                if attributes and tag not in VOID:
                    e = self._element(stack[-1], tag, attributes)
                    if e.drop and not stack[-1].drop or len(e.named + e.soft) > len(stack[-1].named + stack[-1].soft):  # an inline advert, a share link
                        flush()
                        stack.append(e)
                continue
            if tag == "br":
                pieces.append(" ")
                continue
            flush()
            if tag in VOID:
                continue
            if tag in ENDS_P and stack[-1].tag == "p":
                stack.pop()
            elif tag in ENDS:
                over, fence = ENDS[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in over:
                        del stack[k:]
                        break
                    if stack[k].tag in fence:
                        break
            above = stack[-1]
            e = self._element(above, tag, attributes)
            inner = children.setdefault(above.path, [])
            if not inner or inner[-1] != e.sign:
                inner.append(e.sign)
            if not attributes.endswith("/") or tag in ("p", "div"):
                stack.append(e)
        flush()
        return _unwrapped(out), children

    def facts(self, page: str) -> list[tuple[int, bool, int, int]]:
        """(path, whether entropy decides on it, structure hash, content hash) of the nodes of a page."""
        return self.signed_facts(page)[1]

    def signed_facts(self, page: str) -> tuple[int, list[tuple[int, bool, int, int]]]:
        """Hash of all unnamed candidate text (if there is none, of all candidate text), digits aside, and the facts."""
        blocks, children = self.blocks(page)
        whole, unnamed = xxhash.xxh64(), any(good and not stack[-1].named for _, good, stack in blocks)
        texts: dict[int, xxhash.xxh64] = {}
        free: dict[int, bool] = {}
        for text, good, stack in blocks:
            seen = DIGITS("#", text)
            if good and not (unnamed and stack[-1].named):
                whole.update(seen + "\n")
            for e in stack[1:]:
                if e.path not in texts:
                    texts[e.path] = xxhash.xxh64()
                    free[e.path] = not (e.plain or e.drop or e.tag in ("html", "body"))
                texts[e.path].update(seen)
        return whole.intdigest() & MASK, [(path, free[path], xxhash.xxh64_intdigest("|".join(children.get(path, []))) & MASK, h.intdigest() & MASK)
                                          for path, h in texts.items()]

    def text(self, page: str, low: frozenset) -> str:
        """The page's main text, without those of the branches ``low`` that hold less than most of it."""
        blocks = [(text, stack) for text, good, stack in self.blocks(page)[0] if good]
        good = _unnamed(blocks, low)
        blocks = [(text, stack) for text, stack in blocks if good.issuperset(stack[-1].named)]
        if low:
            most = _most(blocks, low)
            # the outermost branch decides
            blocks = [(text, stack) for text, stack in blocks
                      if next((e.path in most for e in stack if e.path in low), True)]
        kept = [(text, stack[-1].main) for text, stack in blocks]
        if any(main for _, main in kept) and not _beside(blocks):
            kept = [(text, main) for text, main in kept if main]
        return "\n\n".join(text for text, _ in kept)


_ENDS_OF = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in RAW}


def _unwrapped(blocks: list[tuple[str, bool, tuple]]) -> list[tuple[str, bool, tuple]]:
    """The blocks; those in forms, dialogs, hidden or header branches are no article text unless the branch wraps the page."""
    if not any(good and stack[-1].soft for _, good, stack in blocks):
        return blocks
    held = Counter()
    unnamed = any(good and not stack[-1].named for _, good, stack in blocks)
    for text, good, stack in blocks:
        if good and not (unnamed and stack[-1].named):
            held[stack[-1].soft] += len(text)
    chains = {stack[-1].soft[:k] for _, good, stack in blocks if good for k in range(1, len(stack[-1].soft) + 1)}
    wrapping = set()
    for chain in chains:
        inside = sum(n for soft, n in held.items() if soft[:len(chain)] == chain)
        around = sum(held[chain[:k]] for k in range(len(chain)))
        if inside and inside >= WRAPPED_ODDS * around:
            wrapping.add(chain)
    return [(text, good and all(stack[-1].soft[:k] in wrapping for k in range(1, len(stack[-1].soft) + 1)), stack)
            for text, good, stack in blocks]


def _most(blocks: list[tuple[str, tuple]], paths: frozenset) -> set[int]:
    """Those of the paths that hold more than half of the blocks' text."""
    held = Counter()
    for text, stack in blocks:
        for path in {e.path for e in stack if e.path in paths}:
            held[path] += len(text)
    total = sum(len(text) for text, _ in blocks)
    return {path for path, n in held.items() if 2 * n > total}


def _unnamed(blocks: list[tuple[str, tuple]], low: frozenset) -> set[int]:
    """Branches named like boilerplate that hold the page's text all the same."""
    paths = frozenset(path for _, stack in blocks for path in stack[-1].named)
    if not paths:
        return set()
    found = set()
    for path in _most(blocks, paths):
        if path in low:
            continue
        chain = next(e.named for _, stack in blocks for e in stack if e.path == path)
        inside = sum(len(text) for text, stack in blocks if any(e.path == path for e in stack))
        # as good by name as the place where the branch stands
        around = sum(len(text) for text, stack in blocks
                     if stack[-1].named == chain[:len(stack[-1].named)] and len(stack[-1].named) < len(chain))
        if inside >= NAMED_ODDS * around:
            found.add(path)
    return found


def _beside(blocks: list[tuple[str, tuple]]) -> bool:
    """Whether one branch without article or main elements holds most of the text."""
    around = {e.path for _, stack in blocks if stack[-1].main for e in stack}
    paths = frozenset(e.path for _, stack in blocks if not stack[-1].main for e in stack) - around
    return bool(paths and _most(blocks, paths))


def _text(value) -> str:
    return value.as_py() if value.is_valid else ""


def importances(pages: DataFrame) -> DataFrame:
    """(host, path, free, pages, copies, importance) of the nodes of every host's tree.

    ``pages`` has host and html.  ``free`` nodes are those that entropy decides on.  Variants are
    counted first, so a host with a third of all pages is a few counts per task.  Pages of equal text
    are one page (``copies`` counts all): mirrors, print versions and repeated rows say nothing about a site's template.
    """
    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        for batch in batches:
            rows = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole, found = parser.signed_facts(_text(page))
                rows += [(host, whole, *fact) for fact in found]
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 ["host", "whole", "path", "free", "structure", "content"])

    facts_of_all = pages.select("host", "html").mapInArrow(facts, "host string, whole long, path long, free boolean, structure long, content long")
    seen = (facts_of_all.groupBy("host", "whole", "path", "free")
            .agg(F.min("structure").alias("structure"), F.min("content").alias("content"), F.count("*").alias("copies")))
    variants = seen.select("host", "path", "free", "copies", F.posexplode(F.array("structure", "content")).alias("kind", "variant"))
    node = ["host", "path", "free", "kind"]
    counts = variants.groupBy(*node, "variant").agg(F.count("*").alias("c"), F.sum("copies").alias("copies"))
    sums = counts.groupBy(*node).agg(F.sum("c").alias("pages"), F.sum("copies").alias("copies"), F.sum(F.col("c") * F.log("c")).alias("clogc"))
    entropy = F.when(F.col("pages") > 1, 1 - F.col("clogc") / (F.col("pages") * F.log("pages"))).otherwise(1.0)
    weight = F.when(F.col("kind") == 1, CONTENT_WEIGHT).otherwise(1 - CONTENT_WEIGHT)
    return (sums.groupBy("host", "path", "free")
            .agg(F.max("pages").alias("pages"), F.max("copies").alias("copies"), F.sum(weight * entropy).alias("importance")))


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                          F.col(html_col).cast("string").alias("html"), host.alias("host"))
    tree = importances(source)
    smoothed = (F.col("pages") * F.col("importance") + PRIOR_PAGES) / (F.col("pages") + PRIOR_PAGES)
    low = (tree.filter(F.col("free") & (smoothed < LEAST_IMPORTANCE))
           .groupBy("host").agg(F.collect_list("path").alias("low"), F.max("copies").alias("n")))
    found = lookup(source, "host", saved(low, "low-branches"), "low", "n", source.count(), ["page_id", "url"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, sets = Parser(), {}
        for batch in batches:
            texts = []
            for page, low in zip(batch.column(2), batch.column(3), strict=True):
                paths = tuple(low.as_py() or ()) if low.is_valid else ()
                if len(sets) > 1000:
                    sets.clear()
                texts.append(parser.text(_text(page), sets.setdefault(paths, frozenset(paths))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return found.select("page_id", "url", "html", "low").mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op7_site_style_tree(spark, sf_dir):
    return extracted(table(spark, sf_dir, "pages"))
