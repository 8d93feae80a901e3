"""HTML in Python: a small tree, a subset of CSS selectors, Markdown, links, and pages as records.

One pass over a page's markup gives all that is asked of it. The tree knows void elements, elements that end
where the next begins (p, li, td and their like) and raw text (script, style); the selectors know tags, #id,
.class, [attribute], [attribute='value'], [attribute*='value'], their compounds, descendants and lists.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import rules
from webloom.functions.lazy import row_column
from webloom.functions.url import Name, _c, normalised, resolved

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SILENT = frozenset("script style noscript template head title svg iframe".split())
#: An element that begins ends these, if one is open inside the same holder.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
HOLDERS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """Elements below, in the order of the document."""
        todo = [x for x in reversed(self.children) if isinstance(x, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [x for x in reversed(node.children) if isinstance(x, Node)]

    def text(self) -> str:
        out, todo = [], list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, Node):
                todo += reversed(x.children)
            else:
                out.append(x)
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag: str, attrs: list):
        if tag in ("html", "body") and any(n.tag == tag for n in self._open()):
            return
        self._close_for(tag)
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str):
        for node in self._open():
            if node.tag == tag:
                self.at = node.parent
                return
            if tag not in BLOCKS and node.tag in BLOCKS and tag not in ("body", "html", "a", "b"):
                return  # an inline end does not close the block around it

    def handle_data(self, data: str):
        self.at.children.append(data)

    def _open(self) -> Iterator[Node]:
        node = self.at
        while node.parent is not None:
            yield node
            node = node.parent

    def _close_for(self, tag: str):
        if tag in BLOCKS:
            for node in self._open():
                if node.tag == "p":
                    self.at = node.parent
                    return
                if node.tag in ("table", "button", "td", "th"):
                    break
        for node in self._open():
            if node.tag in HOLDERS.get(tag, ()):
                return
            if node.tag in ENDS.get(tag, ()):
                self.at = node.parent
                if tag != "tr" or node.tag == "tr":
                    return


def parse(markup: str) -> Node:
    builder = _Builder()
    builder.feed(markup)
    builder.close()
    return builder.root


_SIMPLE = re.compile(r"""(?P<tag>\*|[a-zA-Z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[*^$~]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<raw>[\w-]+))\s*)?\]""")


class BadSelector(ValueError):
    """Not a selector of the subset."""


def selector(text: str) -> list[list[list[tuple]]]:
    """Alternatives, each a chain of compounds from the outermost in."""
    out = []
    for choice in text.split(","):
        chain = []
        for word in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", choice.strip()):
            tests, at = [], 0
            while at < len(word):
                m = _SIMPLE.match(word, at)
                if not m or (m["tag"] and at):
                    raise BadSelector(text)
                value = next((m[k] for k in ("dq", "sq", "raw") if m[k] is not None), None)
                tests.append((m["tag"] and m["tag"].lower(), m["id"], m["cls"], m["attr"], m["op"], value))
                at = m.end()
            chain.append(tests)
        if not chain:
            raise BadSelector(text)
        out.append(chain)
    return out


def _fits(node: Node, tests: list[tuple]) -> bool:
    for tag, id_, cls, attr, op, value in tests:
        own = node.attrs.get(attr) if attr else None
        if (
            (tag and tag != "*" and node.tag != tag)
            or (id_ and node.attrs.get("id") != id_)
            or (cls and cls not in node.attrs.get("class", "").split())
            or (attr and (own is None or not (op is None or {"=": own == value, "*=": value in own, "^=": own.startswith(value or "\0"), "$=": own.endswith(value or "\0"), "~=": value in own.split()}[op])))
        ):
            return False
    return True


def select(root: Node, chosen: str | list) -> Iterator[Node]:
    """Elements that the selector fits, in the order of the document."""
    choices = selector(chosen) if isinstance(chosen, str) else chosen
    for node in root.walk():
        for chain in choices:
            if not _fits(node, chain[-1]):
                continue
            above, left = node.parent, len(chain) - 2
            while left >= 0 and above is not None:
                left -= _fits(above, chain[left])
                above = above.parent
            if left < 0:
                yield node
                break


def first(root: Node, chosen: str | list) -> Node | None:
    return next(select(root, chosen), None)


def squeeze(text: str) -> str:
    return " ".join(text.split())


def word_count(text: str) -> int:
    return len(text.split())


def clean_title(title: str) -> str:
    for separator in (" | ", " - ", " :: ", " — "):
        title = title.split(separator)[0]
    return title.strip()


def clean_markdown(markdown: str) -> str:
    lines = [x for x in (x.strip() for x in re.split("\r?\n", markdown)) if x not in ("-", "*", "+")]
    return re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip()


def markdown(node: Node | None) -> str:
    """A CommonMark subset: headings, paragraphs, lists, quotes, code, links, images, emphasis, rules, tables as rows."""
    return "" if node is None else re.sub("\n{3,}", "\n\n", _block(node, 0)).strip()


def _inline(node: Node | str) -> str:
    if isinstance(node, str):
        return re.sub(r"\s+", " ", node)
    if node.tag in SILENT:
        return ""
    if node.tag == "br":
        return "  \n"
    if node.tag == "img":
        return f"![{node.attrs.get('alt', '')}]({node.attrs['src']})" if node.attrs.get("src") else ""
    inner = "".join(map(_inline, node.children))
    bare = inner.strip()
    if not bare:
        return inner
    around = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "del": "~~", "s": "~~"}.get(node.tag)
    if around:
        return inner[: len(inner) - len(inner.lstrip())] + around + bare + around + inner[len(inner.rstrip()) :]
    if node.tag == "a" and node.attrs.get("href"):
        return f"[{bare}]({node.attrs['href']})"
    return inner


def _block(node: Node, depth: int) -> str:
    out, line = [], []

    def flush():
        text = "".join(line).strip(" ")
        if text.strip():
            out.append(text.strip())
        line.clear()

    for x in node.children:
        if isinstance(x, str) or x.tag not in BLOCKS | {"li", "tr", "body", "html", "tbody", "thead", "dt", "dd", "td", "th"} and not any(c.tag in BLOCKS for c in x.walk()):
            line.append(_inline(x))
            continue
        if x.tag in SILENT:
            continue
        flush()
        if x.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            text = squeeze("".join(map(_inline, x.children)))
            out += [f"{'#' * int(x.tag[1])} {text}"] if text else []
        elif x.tag == "hr":
            out.append("* * *")
        elif x.tag == "pre":
            out.append("```\n" + x.text().strip("\n") + "\n```")
        elif x.tag == "blockquote":
            inner = _block(x, depth)
            out += ["\n".join(f"> {y}".rstrip() for y in inner.split("\n"))] if inner else []
        elif x.tag in ("ul", "ol"):
            items = [c for c in x.children if isinstance(c, Node) and c.tag == "li"]
            rows = [(f"{i + 1}. " if x.tag == "ol" else "* ") + _block(c, depth + 1).replace("\n\n", "\n").replace("\n", "\n    ") for i, c in enumerate(items)]
            out += ["\n".join(rows)] if rows else []
        elif x.tag == "tr":
            out.append("| " + " | ".join(squeeze(c.text()) for c in x.children if isinstance(c, Node)) + " |")
        else:
            inner = _block(x, depth)
            out += [inner] if inner else []
    flush()
    return ("\n" if node.tag in ("table", "tbody", "thead") else "\n\n").join(out)


def _density(node: Node) -> float:
    """Words in paragraphs below, less those in links, for the choice of an article."""
    words = linked = 0
    for x in node.walk():
        if x.tag in ("p", "pre", "td", "blockquote"):
            words += word_count("".join(c for c in x.children if isinstance(c, str))) + sum(word_count(c.text()) for c in x.children if isinstance(c, Node) and c.tag not in BLOCKS)
        if x.tag == "a":
            linked += word_count(x.text())
    return words - 1.5 * linked


def readable(root: Node) -> Node | None:
    """The element whose paragraphs hold most words by its depth, if they are enough; an approximation of reader views."""
    best, best_score = None, 0.0
    for node in root.walk():
        if node.tag in ("article", "main", "section", "div", "td", "body"):
            name = (node.attrs.get("class", "") + " " + node.attrs.get("id", "")).lower()
            score = _density(node) * (1.25 if node.tag in ("article", "main") else 0.9 if node.tag == "body" else 1.0) * (0.3 if re.search(r"\b(ad|nav|footer|sidebar|comment|menu)", name) else 1.0)
            if score > best_score:
                best, best_score = node, score
    return best if best is not None and word_count(best.text()) >= rules.READABLE_WORDS else None


_CONTENT = [selector(x) for x in rules.CONTENT_SELECTORS]
_CHALLENGE = [selector(x) for x in rules.CHALLENGE_SELECTORS]
_BODY, _TITLE, _H1, _LINK = (selector(x) for x in ("body", "title", "h1", "a[href]"))


def content_of(root: Node, chosen: str | None) -> str:
    """Markdown of a page's content: of the chosen element, else of the readable article, else of the first usual place with
    ten words, else of the body."""
    body = first(root, _BODY) or root
    if chosen is not None:
        return clean_markdown(markdown(first(root, chosen) or body))
    article = readable(root)
    if article is None:
        article = next((x for x in (first(root, s) for s in _CONTENT) if x is not None), body)
        if word_count(clean_markdown(markdown(article))) < rules.PREVIEW_WORDS:
            article = body
    return clean_markdown(markdown(article))


def title_of(root: Node) -> str:
    for chosen in (_TITLE, _H1):
        node = first(root, chosen)
        if node is not None and node.text().strip():
            return clean_title(node.text().strip())
    return "Untitled"


def protected(root: Node) -> bool:
    title = first(root, _TITLE)
    low = title.text().lower() if title is not None else ""
    return any(first(root, x) is not None for x in _CHALLENGE) or any(x in low for x in rules.SUSPICIOUS_TITLES)


def links_of(root: Node, url: str, most: int = rules.MAX_LINKS) -> list[dict[str, str]]:
    """A page's links with text, the first of each target; a target counts as seen though its text was too short."""
    out, seen = [], set()
    for a in select(root, _LINK):
        href = a.attrs["href"]
        if href.startswith(("#", "javascript:", "mailto:", "tel:")):
            continue
        target = resolved(url, href)
        if target is None or target in seen:
            continue
        seen.add(target)
        text = squeeze(a.text())
        if len(text.encode()) > 2:
            out.append({"text": text, "url": target})
    return out[:most]


def origin_of(url: str) -> str | None:
    good = normalised(url)
    m = re.match(r"(https?)://(?:[^/?#@]*@)?([^/?#]+)", good or "")
    return m and f"{m[1]}://{m[2]}"


def site_links(root: Node, url: str, most: int) -> list[str]:
    """Targets on the page's own origin, each once, up to ``most``."""
    own, out = origin_of(url), {}
    for a in select(root, _LINK):
        href = a.attrs["href"].strip()
        if href == "" or href.startswith(("#", "javascript:", "mailto:", ":")):
            continue
        target = resolved(url, href)
        if target is not None and own is not None and origin_of(target) == own:
            out[target] = True
            if len(out) >= most:
                break
    return list(out)


PAGE = "struct<title:string,content:string,word_count:long,links:array<struct<text:string,url:string>>,error_kind:string,error:string>"


def page_of(markup: str | None, url: str | None, chosen: str | None = None) -> dict:
    """A page as a record: title, content, word_count, links (null under 50 words), or an error's kind and message."""
    none = dict.fromkeys(("title", "content", "word_count", "links", "error_kind", "error"))
    if markup is None or url is None:
        return none | {"error_kind": "fetch", "error": "no body"}
    root = parse(markup)
    if protected(root):
        return none | {"error_kind": "bot"}
    try:
        content = content_of(root, chosen)
    except BadSelector:
        return none | {"error_kind": "arguments", "error": f"Invalid CSS selector: {chosen}"}
    n = word_count(content)
    return none | {"title": title_of(root), "content": content, "word_count": n, "links": links_of(root, url) if n >= rules.LINKED_WORDS else None}


_page = row_column(PAGE)(page_of)


def page(markup: Name, url: Name, chosen: Name | None = None) -> Column:
    """The page as a struct (see ``page_of``); the markup is parsed once for all of it."""
    return _page(_c(markup), _c(url), F.lit(None).cast("string") if chosen is None else _c(chosen))


@row_column("array<string>")
def _site_links(markup: str | None, url: str | None, most: int) -> list[str]:
    return [] if markup is None or url is None else site_links(parse(markup), url, most)


@row_column("array<struct<text:string,url:string>>")
def _page_links(markup: str | None, url: str | None) -> list[dict[str, str]]:
    return [] if markup is None or url is None else links_of(parse(markup), url)


def page_links(markup: Name, url: Name) -> Column:
    """A page's links, however many words it has."""
    return _page_links(_c(markup), _c(url))


def same_origin_links(markup: Name, url: Name, most: Name) -> Column:
    return _site_links(_c(markup), _c(url), _c(most))


@row_column("string")
def _markdown(markup: str | None) -> str | None:
    return None if markup is None else clean_markdown(markdown(parse(markup)))


def to_markdown(markup: Name) -> Column:
    return _markdown(_c(markup))


@row_column("array<struct<tag:string,text:string,href:string>>")
def _select_all(markup: str | None, chosen: str | None) -> list[dict] | None:
    try:
        return None if markup is None or chosen is None else [{"tag": x.tag, "text": squeeze(x.text()), "href": x.attrs.get("href")} for x in select(parse(markup), chosen)]
    except BadSelector:
        return None


def select_all(markup: Name, chosen: Name) -> Column:
    """Elements that a selector fits, as tag, text and href; null for a selector outside the subset."""
    return _select_all(_c(markup), _c(chosen))


def pdf_text(body: bytes | None) -> str | None:
    """Text shown by the Tj and TJ operators of a PDF's streams, plain or deflated; simple encodings only."""
    if body is None or not body.startswith(b"%PDF"):
        return None
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", body, re.S):
        data = m[1]
        try:
            data = zlib.decompress(data)
        except zlib.error:
            pass
        for block in re.findall(rb"BT(.*?)ET", data, re.S):
            shown = [b"".join(re.findall(rb"\(((?:\\.|[^\\)])*)\)", x[0] or x[1])) for x in re.findall(rb"(\((?:\\.|[^\\)])*\))\s*Tj|\[((?:[^\]])*)\]\s*TJ", block)]
            out.append(b" ".join(shown).replace(b"\\(", b"(").replace(b"\\)", b")").replace(b"\\\\", b"\\").decode("latin-1"))
    return "\n".join(out)


_pdf = row_column("string")(pdf_text)


def pdf(body: Name) -> Column:
    return _pdf(_c(body))
