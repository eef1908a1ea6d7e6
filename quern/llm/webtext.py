"""Main text of web pages, with the site's own template taken away.

Every element's subtree (its tag, text and the subtrees in it) is hashed. For each
host, Spark counts in how many pages with different content a subtree recurs; those
that recur in a large share of the host's pages are its template and are deleted.
What a page marks as something other than its article goes as well: menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments. An element is marked by its tag, by its
role, or by a class or id that is made of such names and nothing else: ``ad-box`` and
``comment-list``, but not ``legal-analysis``. What is left is told apart by the amount of text: where a main element holds
most of it, only that counts; where article elements hold at least half of what counts, text outside them goes, and so do articles with less than a fifth
of the text of the longest (teasers, answers); else the articles go. Inside an article or main element headers stay, and what holds a line of text (a paragraph, heading, cell, item of a list,
quotation) is never taken for template by itself, so a sentence or cell that many articles share stays;
a box as a whole may be.

Character references are decoded, white space inside a block becomes one space, and
blocks are joined in page order by one space. Null html is empty and gives an empty
text. Broken markup is read as far as it goes, in time that grows with the length of the page. Pages without a host share one (the empty
host). Repeated rows count once for a template and each give a row; an empty table gives none. A subtree that stands several
times in a page counts once. Extra columns are ignored, whatever their names, and very long pages are read whole.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textpack as tp
from quern.llm.store import materialise

#: Template hashes that are sent to every executor at most (eight bytes each, and a host); with more, each host's are
#: joined to its pages. Both give the same texts.
MAX_BROADCAST = 400_000
#: Parts that the pages of a host are dealt into for that join.
SALTS = 16
#: The host of an address, in lower case; empty if there is none. Only Spark reads it.
HOST = r"^\s*[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "svg", "template")}

# Elements by what they mean in HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_DROP = frozenset("nav footer aside form script style noscript template iframe object svg canvas button select textarea dialog menu audio video head title embed applet map fieldset noembed noframes xmp".split())
_KEEP_IN_ARTICLE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr caption blockquote pre figcaption".split())
_SHUTS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("table ul ol dl div article section main aside nav header footer form body html blockquote td th".split())
# Words of which classes and ids of other things than the article are made, what may stand beside them, and those that an article has itself.
_OTHER = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription sidebar sidebars widget widgets related "
    "recommended recommendations share sharing social comment comments commentlist disqus reply replies respond breadcrumb breadcrumbs menu menus nav navbar navigation topbar footer masthead toolbar pagination pager skip login signin signup search tags tagcloud copyright disclaimer".split()
)
_BESIDE = frozenset("box block bar list item items area wrap wrapper container inner outer row col column top bottom left right main site page global primary secondary content section link links post posts article articles story stories button buttons icon icons form us form field text title head header body unit slot id".split())
_HEADERS = frozenset("header siteheader pageheader".split())
_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar note status".split())
#: Roles of remarks, which are part of an article that they stand in.
_REMARKS = frozenset("note status".split())
_NEVER_BY_NAME = frozenset("html body main".split())
#: An article with less than this part of the longest one's text is none of the page's own.
_TEASER = 5


def _names_other(value: str, inside: bool) -> bool:
    """Whether a class or id names something other than the article: one of its names is made of such words alone."""
    for name in value.split():
        words = [w.lower() for w in _PARTS.findall(name)]
        if words and all(w in _OTHER or w in _BESIDE or w in _HEADERS for w in words) and any(w in _OTHER or (w in _HEADERS and not inside) for w in words):
            return True
    return False


class _Open:
    __slots__ = ("article", "drop", "held", "inside", "main", "parts", "start", "tag")

    def __init__(self, tag, start, held, drop, article, main):
        self.tag, self.start, self.held, self.drop, self.article, self.main = tag, start, held, drop, article, main
        self.inside = main or article > 0
        self.parts: list[str] = []


def _dropped(tag: str, attrs: str, inside: bool) -> bool:
    if tag in _DROP or (tag == "header" and not inside):
        return True
    if not attrs or tag in _NEVER_BY_NAME:
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            if _names_other(value, inside) and not (inside and tag in _KEEP_IN_ARTICLE):
                return True
        elif (name == "role" and value.lower() in _ROLES and not (inside and value.lower() in _REMARKS)) or name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True
    return False


def _own(blocks: list[tuple[str, int, bool]]) -> list[str]:
    """Of blocks with the number of their article (0: none) and whether main holds them, those that are the page's own text."""
    size: Counter[int] = Counter()
    everything, in_main = sum(len(t) for t, _, _ in blocks), sum(len(t) for t, _, m in blocks if m)
    if 2 * in_main > everything:
        blocks = [b for b in blocks if b[2]]
    for t, article, _ in blocks:
        size[article] += len(t)
    outside = size.pop(0, 0)
    if not size or sum(size.values()) < outside:
        return [t for t, article, _ in blocks if not article]
    longest = max(size.values())
    return [t for t, article, _ in blocks if article and size[article] * _TEASER >= longest]


def read(page: str, template: frozenset[int] | set[int] = frozenset()) -> tuple[list[str], list[int]]:
    """Text blocks of a page without what is dropped or in ``template``, and the hashes of the subtrees that may be template."""
    blocks: list[tuple[str, int, bool]] = []
    line: list[str] = []
    found: list[int] = []
    stack = [_Open("", 0, 0, False, 0, False)]
    opened: Counter[str] = Counter()  # open elements by tag
    dead = 0  # open elements that are dropped
    articles = 0

    def flush() -> None:
        if line:
            text = " ".join(html.unescape("".join(line)).split())
            line.clear()
            if text:
                blocks.append((text, stack[-1].article, stack[-1].main))

    def close() -> None:
        nonlocal dead
        e = stack[-1]
        if e.tag in _BLOCK:
            flush()
        stack.pop()
        opened[e.tag] -= 1
        dead -= e.drop
        up = stack[-1].parts
        if not e.parts:
            return
        h = xxhash.xxh64_intdigest(e.tag + "\x00" + "\x01".join(e.parts)) - 2**63
        up.append(str(h))
        protected = e.inside and e.tag in _KEEP_IN_ARTICLE or e.tag in ("article", "main", "body", "html", "")
        if not protected and e.tag not in ("b", "i", "em", "strong", "a", "span", "code"):
            found.append(h)
            if h in template:
                e.drop = True  # it is closed and no longer counted
        if e.drop:
            del blocks[e.start :]
            del line[e.held :]

    def text(raw: str) -> None:
        if raw:
            line.append(raw)
            if not raw.isspace():
                stack[-1].parts.append(raw)

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if opened[tag]:
                while stack[-1].tag != tag:
                    close()
                close()
            elif tag == "p":
                flush()
            continue
        if tag in _BLOCK:
            flush()
            if tag != "br" and opened["p"]:  # a block ends an open paragraph
                while stack[-1].tag != "p":
                    close()
                close()
            shuts = _SHUTS.get(tag)
            if shuts and any(opened[t] for t in shuts):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in shuts:
                        while len(stack) > k:
                            close()
                    elif stack[k].tag in _SCOPE and not (tag == "tr" and stack[k].tag in ("td", "th")):
                        break
                    if k >= len(stack):
                        continue
        attrs = m[3] or m[6] or ""
        if tag in _VOID or attrs.endswith("/") and tag not in _BLOCK:
            continue
        if tag in _RAW_END:
            end = _RAW_END[tag].search(page, at)
            at = page.find(">", end.start()) + 1 or n if end else n
            continue
        inside = stack[-1].inside
        drop = _dropped(tag, attrs, inside)
        article, main = stack[-1].article, stack[-1].main
        if not dead and not drop:
            main |= tag == "main" or 'role="main"' in attrs
            if tag == "article" and not article:
                articles += 1
                article = articles
        stack.append(_Open(tag, len(blocks), len(line), drop, article, main))
        opened[tag] += 1
        dead += drop
    while len(stack) > 1:
        close()
    flush()
    return _own(blocks), found


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page: its host, a hash of its text, and the hashes of its subtrees."""
    for batch in batches:
        content, hashes = [], []
        for page in batch["html"].to_pylist():
            blocks, found = read(page or "")
            content.append(xxhash.xxh64_intdigest("\n".join(blocks)) - 2**63)
            hashes.append(sorted(set(found)))
        yield pa.RecordBatch.from_arrays([batch["host"], pa.array(content, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], ["host", "content", "subtrees"])


def _texts(by_host):
    """Extracts with the templates of all hosts at hand, or with those that a page brings along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [frozenset(x or ()) for x in batch["template"].to_pylist()] if by_host is None else [by_host.value.get(h, frozenset()) for h in batch["host"].to_pylist()]
            out = [" ".join(read(page or "", template)[0]) for page, template in zip(batch["html"].to_pylist(), own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def templates(pages: DataFrame, share: float = 0.2, least: int = 4) -> DataFrame:
    """(host, subtree) of what recurs in at least ``share`` of a host's distinct pages, and in ``least`` of them."""
    subtrees = pages.select("host", "html").mapInArrow(tp.task(_subtrees), "host string, content bigint, subtrees array<bigint>").groupBy("host", "content").agg(F.min("subtrees").alias("subtrees"))
    each = subtrees.select("host", F.explode(F.concat("subtrees", F.array(F.lit(None).cast("bigint")))).alias("subtree"))
    counts = each.groupBy("host", "subtree").agg(F.count("*").alias("n")).where((F.col("n") >= least) | F.col("subtree").isNull())
    # The null subtree stands for the page itself, so its count is the number of pages.
    total = counts.where("subtree is null").select("host", F.col("n").alias("pages"))
    return counts.where("subtree is not null").join(total, "host").where(F.col("n") >= share * F.col("pages")).select("host", "subtree")


def extract(pages: DataFrame, share: float = 0.2, least: int = 4, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Per page: page_id, url, text and n_chars."""
    host = F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit(""))
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host)
    schema = "page_id bigint, url string, text string, n_chars bigint"
    found = materialise(templates(pages, share, least))
    rows = found.limit(max_broadcast + 1).collect()
    if len(rows) <= max_broadcast:
        by_host: dict[str, set[int]] = {}
        for r in rows:
            by_host.setdefault(r.host, set()).add(r.subtree)
        return pages.mapInArrow(tp.task(_texts(pages.sparkSession.sparkContext.broadcast(by_host))), schema)
    # Too many to send: each host's few hashes are joined to its pages, and a large host is dealt into parts.
    lists = found.groupBy("host").agg(F.collect_list("subtree").alias("template")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALTS)).cast("int"))
    return salted.join(lists, ["host", "salt"], "left").mapInArrow(tp.task(_texts(None)), schema)
