"""Main text of web pages by tag-path ratios.

Every block of text belongs to a root-to-leaf path of tags. Per page, each path gets its text's length and punctuation over
the number of its nodes; both are smoothed with neighbouring blocks in page order, fused by their product, and paths at or
above a threshold (a share of the page's deviation) are content, in an article or main element or not.
Paths through elements that are never article text (nav, header, footer, aside, forms, scripts, styles, adverts, notices,
comments: by tag, role, or a whole word of class or id) are furniture. Paths below the threshold are recovered where they belong to content:
headings before a content block, and blocks between content blocks, within the element that holds that content.

Blocks end at block tags; character references are decoded, white space inside a block (br included) becomes one space, blocks
are joined by one line end. Null and empty pages give an empty text. Repeated rows are treated alike; columns named as results
are replaced; an empty table gives an empty result. Pages of any length are read whole in one forward scan, in time linear in
their length, broken markup or not: quotes left open end with the tag, a tag without an end is dropped. Map-only.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, types as T

from .common import slices, table

# Fixed values of HTML.
_RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
_INLINE = frozenset((
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "output", "q", "rb", "rp", "rt", "ruby", "s", "samp", "small", "span",
    "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img", "math", "semantics", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "msub", "msup", "msubsup", "munder", "mover",
    "munderover", "mtable", "mtr", "mtd",
))
_FURNITURE = frozenset(("nav", "footer", "aside", "form", "button", "dialog", "menu", "head", "noscript", "template", "svg", "object", "canvas", "select", "audio", "video", "annotation"))
_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"))
#: A start tag that ends an open p, and what an open element of a kind is not sought beyond.
_ENDS_P = frozenset(("address", "article", "aside", "blockquote", "dialog", "details", "div", "dl", "dd", "dt", "fieldset", "figure", "figcaption", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"))
_ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset(("ul", "ol", "menu", "dl", "table", "thead", "tbody", "tfoot", "select", "article", "section", "div", "blockquote", "main", "body"))
#: Class and id words of page furniture, and words that may stand beside them in a name such as site-nav or comment-list.
_NAMES = frozenset((
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "promo", "promos", "promotion", "sponsor", "sponsors", "sponsored", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs",
    "sidebar", "sidenav", "aside", "footer", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related",
    "recommended", "recommendations", "widget", "widgets", "comment", "comments", "commentlist", "replies", "reply", "disqus", "masthead", "topbar", "toolbar", "pagination", "pager", "copyright", "legal", "disclaimer",
))
_BESIDE = frozenset((
    "site", "page", "main", "global", "top", "bottom", "left", "right", "primary", "secondary", "box", "bar", "block", "container", "wrapper", "wrap", "area", "section", "list", "links", "link", "item", "items", "form", "button", "buttons",
    "message", "panel", "slot", "unit", "posts", "articles", "stories", "content", "user", "reader", "readers", "media", "icons", "text", "inner", "outer", "header", "policy", "overlay", "thread", "the", "skip", "to",
))
_TAG = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTR = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_PARTS = re.compile(r"[-_]+")
_PUNCT = re.compile(r"[.,;:!?…]")
_SPACE = re.compile(r"\s+")


def _is_named(names: str) -> bool:
    """Whether a word of a class or id names furniture, whole or in all its parts."""
    for word in names.lower().split():
        if word in _NAMES:
            return True
        parts = [p for p in _PARTS.split(word) if p]
        if len(parts) > 1 and any(p in _NAMES for p in parts) and all(p in _NAMES or p in _BESIDE for p in parts):
            return True
    return False


def _is_furniture(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    if tag in _FURNITURE or tag == "header" and not in_article:
        return True
    if tag in ("body", "html", "article", "main") or not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in _ROLES:
        return True
    if "style" in attrs and re.search(r"display\s*:\s*none", attrs["style"].lower()):
        return True
    return _is_named(attrs.get("class", "")) or _is_named(attrs.get("id", ""))


class _Tags:
    """Start and end tags of a page, read forward once: no search looks twice at a stretch without what it seeks."""

    def __init__(self, page: str):
        self.page, self.n = page, len(page)
        self.gone: set[str] = set()  # what does not come any more

    def find(self, what: str, at: int) -> int:
        """The place of what from at on, or -1."""
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def attributes(self, at: int) -> tuple[dict[str, str], int]:
        """Attributes (the first of each name) from at on, and the place after the tag, -1 if it isn't closed."""
        page, out = self.page, {}
        while True:
            at = _GAP.match(page, at).end()
            if at >= self.n:
                return out, -1
            if page[at] == ">":
                return out, at + 1
            name = _ATTR.match(page, at)
            at, value = name.end(), ""
            equals = _EQUALS.match(page, at)
            if equals:
                at = equals.end()
                quote = page[at : at + 1]
                end = self.find(quote, at + 1) if quote and quote in "\"'" else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    bare = _BARE.match(page, at)
                    value, at = bare[0], bare.end()
            out.setdefault(name[0].lower(), value)

    def raw_end(self, tag: str, at: int) -> int:
        """The place after the end tag of an element whose content is no markup."""
        key = f"</{tag}"
        if key not in self.gone:
            m = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(self.page, at)
            if m:
                return m.end()
            self.gone.add(key)
        return self.n


class _Paths:
    """Tag paths as a tree; two elements of one path share its number."""

    def __init__(self):
        self.known: dict[tuple[int, str], int] = {}
        self.parent, self.tag = [-1], [""]

    def under(self, parent: int, tag: str) -> int:
        found = self.known.get((parent, tag))
        if found is None:
            found = self.known[parent, tag] = len(self.parent)
            self.parent.append(parent)
            self.tag.append(tag)
        return found

    def intervals(self) -> tuple[list[int], list[int]]:
        """For each path the first and last number, in depth-first order, of those below it and itself."""
        children: list[list[int]] = [[] for _ in self.parent]
        for k, p in enumerate(self.parent[1:], 1):
            children[p].append(k)
        first, last, stack, n = [0] * len(children), [0] * len(children), [(0, False)], 0
        while stack:
            k, done = stack.pop()
            if done:
                last[k] = n - 1
                continue
            first[k], n = n, n + 1
            stack.append((k, True))
            stack += [(c, False) for c in children[k]]
        return first, last


def blocks_of(page: str) -> tuple[list[tuple[int, str, bool]], _Paths]:
    """(path, text, furniture) of the blocks with text, in page order, and the paths."""
    tags, paths = _Tags(page), _Paths()
    out: list[tuple[int, str, bool]] = []
    stack: list[tuple[str, bool, bool, int, bool]] = [("", False, False, 0, False)]  # tag, furniture so far, in article so far, path, in inline furniture
    open_tags: dict[str, int] = {}
    parts: list[str] = []
    owner = [(0, False)]  # path and furniture of the parts

    def say(text: str) -> None:
        if text and not stack[-1][4]:
            if not parts:
                owner[0] = stack[-1][3], stack[-1][1]
            parts.append(text)

    def flush() -> None:
        """Ends a block; inline furniture within it doesn't."""
        if parts and not stack[-1][4]:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((owner[0][0], text, owner[0][1]))

    def pop() -> str:
        tag = stack.pop()[0]
        open_tags[tag] -= 1
        return tag

    def pop_through(wanted: tuple, stops: frozenset) -> None:
        """Ends the innermost open element of wanted, unless one of stops stands in between."""
        if any(open_tags.get(t) for t in wanted):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in wanted:
                    while len(stack) > k:
                        pop()
                    return
                if stack[k][0] in stops:
                    return

    at, n = 0, len(page)
    while at < n:
        lt = tags.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        say(page[at:lt])
        if page.startswith("<!--", lt):
            end = tags.find("-->", lt + 4)
            at = end + 3 if end >= 0 else n
            continue
        if page.startswith("<![CDATA[", lt):
            end = tags.find("]]>", lt)
            at = end + 3 if end >= 0 else n
            continue
        if page.startswith(("<!", "<?"), lt):
            end = tags.find(">", lt)
            at = end + 1 if end >= 0 else n
            continue
        close = page.startswith("</", lt)
        name = _TAG.match(page, lt + 1 + close)
        if not name:
            say("<")
            at = lt + 1
            continue
        tag = name[0].lower()
        attrs, end = tags.attributes(name.end())
        if end < 0:
            break  # a tag without an end is no text
        at = end
        if close:
            if tag in _INLINE and not open_tags.get(tag):
                continue
            if tag not in _INLINE:
                flush()
            if open_tags.get(tag):
                while pop() != tag:
                    pass
            if tag not in _INLINE:
                flush()
            continue
        _, furniture, article, path, inline = stack[-1]
        if tag in _INLINE and tag not in _VOID:
            if furniture or _is_furniture(tag, attrs, article):  # only furniture needs its end
                stack.append((tag, True, article, path, inline or not furniture))
                open_tags[tag] = open_tags.get(tag, 0) + 1
            continue
        if tag in _VOID:
            if tag in _INLINE:
                say(" " if tag == "br" else "")
            else:
                flush()
            continue
        flush()
        if tag in _RAW:
            at = tags.raw_end(tag, at)
            continue
        if tag in _ENDS_P:
            pop_through(("p",), _SCOPE)
        if tag in _ENDS_SAME:
            pop_through(_ENDS_SAME[tag], _SCOPE)
        flush()
        if page[end - 2] != "/" or tag not in ("svg", "path", "g"):
            _, furniture, article, path, inline = stack[-1]
            stack.append((tag, furniture or _is_furniture(tag, attrs, article), article or tag in ("article", "main"), paths.under(path, tag), inline))
            open_tags[tag] = open_tags.get(tag, 0) + 1
    while stack[-1][4]:
        pop()
    flush()
    return out, paths


def main_text(page: str | None, share: float = 0.5) -> str:
    blocks, tree = blocks_of(page or "")
    if not blocks:
        return ""
    paths: dict[int, list[int]] = {}
    for i, (path, _, _) in enumerate(blocks):
        paths.setdefault(path, []).append(i)
    length, marks = np.zeros(len(blocks)), np.zeros(len(blocks))
    for own in paths.values():
        length[own] = sum(len(blocks[i][1]) for i in own) / len(own)
        marks[own] = sum(len(_PUNCT.findall(blocks[i][1])) for i in own) / len(own)
    smooth = lambda x: np.convolve(np.pad(x, 1, "edge"), (0.25, 0.5, 0.25), "valid")
    fused = np.sqrt(smooth(length) * (smooth(marks) + 0.01))
    of_path = {p: float(np.mean(fused[own])) for p, own in paths.items()}
    bound = share * float(np.std(fused)) if len(blocks) > 1 else 0.0
    kept = [(p, t, of_path[p] >= bound) for p, t, f in blocks if not f]
    return "\n".join(t for (_, t, _), use in zip(kept, _recovered([(p, c) for p, _, c in kept], tree), strict=True) if use)


def _recovered(blocks: list[tuple[int, bool]], tree: _Paths) -> list[bool]:
    """Which of the blocks (path, content by ratio) are content, or belong to it by their place."""
    use = [c for _, c in blocks]
    first, last = tree.intervals()
    within = lambda p, holder: holder is not None and first[holder] <= first[p] <= last[holder]
    holder = lambda p: max(0, tree.parent[p])
    heading = lambda p: tree.tag[p] in ("h1", "h2", "h3", "h4", "h5", "h6")
    after: list[int | None] = [None] * len(blocks)  # elements that hold the nearest content before and after
    for i in range(len(blocks) - 2, -1, -1):
        after[i] = holder(blocks[i + 1][0]) if blocks[i + 1][1] else after[i + 1]
    before = None
    heads = False  # only headings up to the next content
    for i in range(len(blocks) - 1, -1, -1):
        path, content = blocks[i]
        heads = content or heads and heading(path)
        use[i] = use[i] or heads and within(path, after[i])
    for i, (path, content) in enumerate(blocks):
        if content:
            before = holder(path)
        elif within(path, before) and within(path, after[i]):
            use[i] = True
    return use


def extract_text(pages: DataFrame, source: str = "html", share: float = 0.5) -> DataFrame:
    """pages without their html, with text and n_chars (its code points)."""
    names = [c for c in pages.columns if c not in ("text", "n_chars", source)]
    schema = T.StructType([*(pages.schema[c] for c in names), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def extract(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                texts = [main_text(h, share) for h in part.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return pages.select(*names, source).mapInArrow(extract, schema)


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op6_html_extract": op6_html_extract}
SQL: dict[str, str] = {}
