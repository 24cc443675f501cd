"""Main text of web pages by what repeats across the pages of their hosts.

Each page is read once into elements and text blocks. Blocks of menus, forms,
adverts, comments and the like do not count, the rest is content. The content outside the
deepest container with most of it goes to Spark by generalised path (tags and classes without
digits); a path is furniture of the host if at least half of its texts stand on several
different pages. The pages are read again with the furniture of their hosts: the deepest
container with all of the other content is the article, or the outermost <article> or <main>
with all of it; all blocks in it follow in page order.
"""

from __future__ import annotations

import html
import re
from collections.abc import Collection, Iterator
from hashlib import blake2b
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.llm.common import texts
from assetloom.session import cut

#: The share of a page's content from which the content outside a container is asked about; none is dropped by it.
MOST = 0.8
#: Different pages of a host that hold a text, digits aside, which counts as repeated.
PAGES = 3

# Names of HTML elements, and the class words by which sites mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("head script style noscript template textarea select button iframe object svg math canvas title option datalist audio video".split())
RAW = frozenset("script style textarea title noscript iframe template svg math".split())
ASIDE = frozenset("nav footer aside form menu dialog".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th tr tbody thead tfoot caption figcaption summary address ul ol dl table figure".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored sponsors promo promos promotion "
    "nav navbar navigation menu menus breadcrumb breadcrumbs crumbs pager pagination toolbar tabs "
    "footer foot header masthead topbar banner sidebar aside rail widget widgets "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall "
    "share sharing social related recommended recommendations teaser teasers trending "
    "comment comments commentlist disqus replies reply respond discussion feedback search skip hidden".split()
)
KEPT = frozenset("article articles entry post story content main body text has no with without".split())
REMARKS = frozenset("comment comments commentlist disqus replies reply respond discussion feedback related recommended recommendations teaser teasers ad ads advert".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)"


class Page:
    """Elements in page order with parent, depth, path and whether they may be the article's container; text blocks."""

    def __init__(self, source: str):
        self.parent, self.depth, self.path, self.container, self.named = [-1], [0], [0], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters outside links
        self._read(source)

    def _read(self, source: str) -> None:
        stack = [("", 0, False, True)]  # tag, element, whether its text is left out, whether an article may begin in it
        parts: list[str] = []
        linked = outside = 0
        in_link = False
        at = 0

        def flush() -> None:
            nonlocal linked, outside
            if parts:
                _, element, out, _ = stack[-1]
                text = " ".join(html.unescape("".join(parts)).split())
                parts.clear()
                if text and not out:
                    self.blocks.append((element, text, outside if outside >= linked else 0))
            linked = outside = 0

        def close(keep: int) -> None:
            nonlocal in_link
            flush()
            del stack[keep:]
            in_link = False

        while True:
            found = _TAG.search(source, at)
            text = source[at : found.start() if found else len(source)]
            if text:
                parts.append(text)
                if in_link:
                    linked += len(text)
                else:
                    outside += len(text)
            if found is None:
                break
            at = found.end()
            if found[2] is None:
                continue
            tag = found[2].lower()
            if found[1]:
                if tag == "a":
                    in_link = False
                elif tag in INLINE:
                    pass
                elif tag in ("br", "p") and not any(s[0] == tag for s in stack):
                    parts.append(" ")
                else:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == tag:
                            close(i)
                            break
                    else:
                        parts.append(" ")
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                parts.append(" " if tag in ("textarea", "iframe") else "")
                continue
            if tag in VOID:
                parts.append(" " if tag in ("br", "hr") else "")
                continue
            if tag in INLINE:
                if tag == "a":
                    in_link = not found[3].endswith("/")
                continue
            flush()
            for i in range(len(stack) - 1, 0, -1):  # what the new element closes
                open_tag = stack[i][0]
                if open_tag == "p" or open_tag in CLOSED_BY.get(tag, ()):
                    close(i)
                    if open_tag != "p":
                        break
                elif open_tag in SCOPE.get(tag, ()) or open_tag not in TEXT:
                    break
            _, above, out, free = stack[-1]
            named = {n.lower(): a or b or c for n, a, b, c in _ATTRIBUTE.findall(found[3])} if found[3] else {}
            mine, free = left_out(tag, named, free)
            if tag in ("main", "article") and free and not mine:
                out = False
            classes = ".".join(sorted(_DIGITS.sub("", named.get("class") or "").lower().split()))
            element = len(self.parent)
            self.parent.append(above)
            self.depth.append(self.depth[above] + 1)
            self.path.append(crc32(f"{self.path[above]}/{tag}.{classes}".encode("utf-8", "replace")) | (len(tag) + len(classes) & 0x7F) << 32)
            self.container.append(tag not in TEXT and not (out or mine))
            self.named.append(tag in ("main", "article"))
            stack.append((tag, element, out or mine, free))
        flush()

    def content(self, furniture: Collection[int]) -> list[int]:
        """Characters of content in each element, without blocks whose path is furniture."""
        content = [0] * len(self.parent)
        for element, _, n in self.blocks:
            if self.path[element] not in furniture:
                content[element] += n
        for i in range(len(content) - 1, 0, -1):
            content[self.parent[i]] += content[i]
        return content

    def tightest(self, content: list[int], share: float) -> int:
        """The deepest container that holds this share of the content, or the outermost <article> or <main>; the page itself if there is none."""
        best = 0
        for i, n in enumerate(content):
            if n and n >= share * content[0] and self.container[i] and self.depth[i] > self.depth[best]:
                best = i
                if self.named[i]:
                    break
        return best

    def inside(self, top: int) -> list[bool]:
        inside = [False] * len(self.parent)
        inside[top] = True
        for i in range(top + 1, len(inside)):
            inside[i] = inside[self.parent[i]]
        return inside

    def outside(self) -> list[tuple[int, int]]:
        """Path and hash, digits aside, of each content block outside the tightest container."""
        inside = self.inside(self.tightest(self.content(()), MOST))
        return [(self.path[element], _hash(_DIGITS.sub("", text))) for element, text, n in self.blocks if n and not inside[element]]

    def text(self, furniture: Collection[int] | None) -> str:
        """The blocks of the tightest container of all that is not furniture; of all content if all is furniture."""
        content = self.content(furniture or ())
        inside = self.inside(self.tightest(content if content[0] else self.content(()), 1))
        return " ".join(text for element, text, _ in self.blocks if inside[element])


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def left_out(tag: str, attributes: dict[str, str], free: bool) -> tuple[bool, bool]:
    """Whether an element's text is none of the article's, and whether an article may still begin in it."""
    if tag in SKIPPED or tag in ASIDE:
        return True, False
    if tag in ("html", "body"):
        return False, free
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in ROLES:
        return True, free and attributes.get("role", "").lower() in ("banner", "alert")
    words = set(_WORD.findall(f"{attributes.get('class') or ''} {attributes.get('id') or ''}".lower()))
    if words & REMARKS:
        return True, False
    if tag == "main" or words & KEPT:
        return False, free
    if tag == "header" or (words & WORDS and tag != "article"):
        return True, free
    return False, free


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of every row's whole html.

    Character references are decoded, white space becomes one space, blocks follow in
    page order with one space between. Null or empty html, and pages that are all menus
    and the like, give the empty text. Hosts come from ``url``; rows with none count as one
    host. Repeated rows give a row each; other columns are left out. An empty table gives no rows.
    """
    rows = pages.select("page_id", "url", "html", F.coalesce(F.lower(F.regexp_extract("url", _HOST, 1)), F.lit("")).alias("host"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[str, int, int, int]] = []
            for host, source in zip(batch.column("host").to_pylist(), texts(batch.column("html"))):
                page = Page(source)
                blocks = page.outside()
                if blocks:
                    whole = _hash("\n".join(text for _, text, _ in page.blocks))
                    found += [(host, path, text, whole) for path, text in blocks]
            columns = zip(*found) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] + [pa.int64()] * 3)], ["host", "path", "block", "page"])

    # pages with the same blocks are one page, so copies of an article do not make furniture of it
    asked = rows.select("host", "html").mapInArrow(ask, "host string, path long, block long, page long").distinct()
    pages_of = asked.groupBy("host", "path", "block").agg(F.count("*").alias("n"))
    repeated = F.sum(F.when(F.col("n") >= PAGES, F.col("n")).otherwise(0))
    paths = pages_of.groupBy("host", "path").agg(F.sum("n").alias("n"), repeated.alias("repeated")).where("2 * repeated >= n")
    furniture = cut(paths.groupBy("host").agg(F.collect_list("path").alias("furniture")), "furniture")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Page(source).text(frozenset(paths or ())) for source, paths in zip(texts(batch.column("html")), batch.column("furniture").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string())], ["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return rows.join(furniture, "host", "left").select("page_id", "url", "html", "furniture").mapInArrow(
        read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string"
    )
