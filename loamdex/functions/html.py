"""One HTML page to title, Markdown, sections and links. Plain Python: it runs inside one Arrow function per batch.

The tree builder stands on the standard library's tokenizer and adds what browsers do to the pages met in
practice: implied ends of paragraphs, items and cells, void and raw-text elements, and formatting elements that
stay open across blocks. Markdown and sections are two walks over one tree, so text that looks like Markdown or
HTML in the page (``Vec<T>``) stays in the sections.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

from loamdex.functions.urls import resolve

# The element names of the HTML standard by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html isindex li main menu nav noframes noscript ol output p pre section summary table tbody td tfoot th thead tr ul".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Fixed values, which decide what is extracted: elements whose text is never content, and classes that mark furniture.
SUPPRESSED = frozenset("script iframe style nav navbar header footer aside button rustdoc-search rustdoc-toolbar".split())
FURNITURE = frozenset("advertisement ads sidebar menu navigation anchor".split())
_CLOSES_P = BLOCKS - frozenset("html body".split())
_SPACE = re.compile(r"[ \t\r\n\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def elements(self):
        """Itself and all elements below, in document order."""
        stack: list[Node] = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self, skip: frozenset[str] = frozenset()) -> str:
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in skip:
                stack.extend(reversed(x.children))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", {}, None)
        self.active: list[Node] = []  # open formatting, outermost first

    def _open(self, tag: str) -> Node | None:
        node: Node | None = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        return node

    def _close(self, tag: str, within: frozenset[str] = frozenset()) -> None:
        node: Node | None = self.at
        while node is not None and node.tag != tag:
            if node.tag in within:
                return
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def _reopen(self) -> None:
        """Formatting that a block's end closed goes on in the next one."""
        open_now = set()
        node: Node | None = self.at
        while node is not None:
            open_now.add(id(node))
            node = node.parent
        for k, f in enumerate(self.active):
            if id(f) not in open_now:
                self.active[k] = again = Node(f.tag, f.attrs, self.at)
                self.at.children.append(again)
                self.at = again

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = {k: v or "" for k, v in attrs}
        if tag in ("html", "body", "head") and tag != "head":
            if tag == "body" and self._open("body") is None and self._open("head") is not None:
                self._close("head")
            if tag == "html" or self._open("body") is not None:
                return
        if tag in _CLOSES_P and self._open("p") is not None:
            self._close("p", frozenset(("button", "table")))
        if tag == "li":
            self._close("li", frozenset(("ul", "ol")))
        elif tag in ("dt", "dd"):
            self._close("dt", frozenset(("dl",)))
            self._close("dd", frozenset(("dl",)))
        elif tag in ("td", "th", "tr"):
            for t in ("td", "th") if tag != "tr" else ("td", "th", "tr"):
                self._close(t, frozenset(("table",)))
        elif tag in HEADINGS and self.at.tag in HEADINGS:
            self._close(self.at.tag)
        elif tag == "a" and any(f.tag == "a" for f in self.active):
            self.handle_endtag("a")
        if tag not in BLOCKS and tag not in ("head", "title", "script", "style"):
            self._reopen()
        node = Node(tag, given, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            if tag in FORMATTING:
                self.active.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in FORMATTING:
            for k in range(len(self.active) - 1, -1, -1):
                if self.active[k].tag == tag:
                    del self.active[k]
                    break
            else:
                return
            self._close(tag, frozenset(("td", "th", "table")))
        elif tag == "p" and self._open("p") is None:
            self.at.children.append(Node("p", {}, self.at))
        elif tag in HEADINGS:
            for h in HEADINGS:
                if self._open(h) is not None:
                    self._close(h)
                    break
        elif tag not in VOID:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if not data:
            return
        if data.strip() and self.at.tag not in ("script", "style", "title", "head"):
            self._reopen()
        kids = self.at.children
        if kids and isinstance(kids[-1], str):
            kids[-1] += data
        else:
            kids.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def main_content(root: Node) -> Node:
    """The first main element, article or container of that name, else the body, else all."""
    body = None
    for n in root.elements():
        if n.tag in ("main", "article") or {"content", "main-content"} & set(n.classes) or n.attrs.get("id") in ("content", "main"):
            return n
        body = body or (n if n.tag == "body" else None)
    return body or root


def without_furniture(node: Node) -> Node:
    """A copy without suppressed elements and those of furniture classes."""
    copy = Node(node.tag, node.attrs, None)
    for c in node.children:
        if isinstance(c, str):
            copy.children.append(c)
        elif c.tag not in SUPPRESSED and not FURNITURE & set(c.classes) and not (c.tag == "a" and {"src", "rightside"} <= set(c.classes)):
            kid = without_furniture(c)
            kid.parent = copy
            copy.children.append(kid)
    return copy


def collapse(root: Node) -> Node:
    """Runs of white space as one blank, none at the edges of blocks; text of pre stays as it is."""
    last: list[tuple[list, int]] = []  # where the text before ends, while it may be trimmed
    blank = True

    def walk(node: Node) -> None:
        nonlocal blank
        if node.tag == "pre":
            trim()
            last.clear()
            blank = True
            return
        edge = node.tag in BLOCKS or node.tag == "br"
        if edge:
            trim()
            blank = True
        for k, c in enumerate(node.children):
            if isinstance(c, str):
                text = _SPACE.sub(" ", c)
                if blank and text.startswith(" "):
                    text = text[1:]
                node.children[k] = text
                if text:
                    blank = text.endswith(" ")
                    last[:] = [(node.children, k)]
            else:
                walk(c)
        if edge:
            trim()
            blank = True
        elif node.tag in VOID:
            blank = False

    def trim() -> None:
        for kids, k in last:
            kids[k] = kids[k].removesuffix(" ")
        last.clear()

    walk(root)
    trim()
    return root


#: Patterns after which text would be read as Markdown, in the order in which they are escaped.
ESCAPES = [(re.compile(p), r) for p, r in ((r"\\", r"\\\\"), (r"\*", r"\\*"), (r"^-", r"\\-"), (r"^\+ ", r"\\+ "), (r"^(=+)", r"\\\1"), (r"^(#{1,6}) ", r"\\\1 "), (r"`", r"\\`"), (r"^~~~", r"\\~~~"), (r"\[", r"\\["), (r"\]", r"\\]"), (r"^>", r"\\>"), (r"_", r"\\_"), (r"^(\d+)\. ", r"\1\\. "))]


def escaped(text: str) -> str:
    for pattern, by in ESCAPES:
        text = pattern.sub(by, text)
    return text


def _joined(a: str, b: str) -> str:
    """Two fragments with as many line breaks between them as either wants, at most two."""
    left, right = a.rstrip("\n"), b.lstrip("\n")
    n = min(2, max(len(a) - len(left), len(b) - len(right)))
    return left + "\n" * n + right


def _fence(text: str) -> str:
    """A fence longer than any run of backticks in the text."""
    return "`" * max(3, 1 + max(map(len, re.findall(r"^`{3,}", text, re.M)), default=0))


def _code_span(text: str) -> str:
    text = text.replace("\r", "").replace("\n", " ")
    if not text:
        return ""
    runs, ticks = set(re.findall("`+", text)), "`"
    while ticks in runs:
        ticks += "`"
    pad = " " if text.startswith("`") or text.endswith("`") or (text.startswith(" ") and text.endswith(" ") and text.strip()) else ""
    return ticks + pad + text + pad + ticks


def code_of(pre: Node) -> tuple[str, str]:
    """Text and language of a pre element."""
    first = next((c for c in pre.children if isinstance(c, Node)), None)
    named = re.search(r"language-(\S+)", (first.attrs.get("class", "") if first else "") + " " + pre.attrs.get("class", ""))
    return pre.text().removesuffix("\n"), named.group(1) if named else ""


def markdown(node: Node, rules: dict[str, Callable[[str, Node], str]] | None = None) -> str:
    """Markdown of the content of a collapsed tree. ``rules`` see what the built-in rule of their tag gave, and replace it."""
    return _content(node, rules or {}, False).strip()


def _content(node: Node, rules: dict, in_code: bool) -> str:
    out = ""
    for c in node.children:
        out = _joined(out, (c if in_code else escaped(c)) if isinstance(c, str) else _element(c, rules, in_code))
    return out


def _element(n: Node, rules: dict, in_code: bool) -> str:
    tag = n.tag
    inner = _content(n, rules, in_code or tag in ("code", "pre"))
    lead = trail = ""
    if tag not in BLOCKS and tag not in VOID and tag not in ("code", "pre"):
        bare = inner.strip(" ")
        if bare != inner:
            lead, trail = (" " if inner.startswith(" ") else ""), (" " if inner.endswith(" ") and bare else "")
            inner = bare
    out = _rule(n, tag, inner)
    if tag in rules:
        out = rules[tag](out, n)
    return lead + out + trail


def _rule(n: Node, tag: str, inner: str) -> str:
    if tag == "br":
        return "  \n"
    if tag == "hr":
        return "\n\n* * *\n\n"
    if tag in HEADINGS:
        return f"\n\n{'#' * int(tag[1])} {inner.strip()}\n\n" if inner.strip() else ""
    if tag == "pre":
        text, language = code_of(n)
        fence = _fence(text)
        return f"\n\n{fence}{language}\n{text}\n{fence}\n\n"
    if tag == "blockquote":
        return "\n\n" + re.sub("^", "> ", inner.strip("\n"), flags=re.M) + "\n\n"
    if tag in ("ul", "ol"):
        parent = n.parent
        kids = [c for c in parent.children if isinstance(c, Node)] if parent is not None else []
        return "\n" + inner if parent is not None and parent.tag == "li" and kids and kids[-1] is n else f"\n\n{inner}\n\n"
    if tag == "li":
        siblings = [c for c in n.parent.children if isinstance(c, Node) and c.tag == "li"] if n.parent is not None else [n]
        at = next((k for k, c in enumerate(siblings) if c is n), 0)
        mark = "-   "
        if n.parent is not None and n.parent.tag == "ol":
            start = n.parent.attrs.get("start", "1")
            mark = f"{(int(start) if start.lstrip('-').isdigit() else 1) + at}.  "
        body = inner.strip("\n").replace("\n", "\n    ")
        return mark + body + ("\n" if at + 1 < len(siblings) else "")
    if tag in ("em", "i"):
        return f"_{inner}_" if inner.strip() else ""
    if tag in ("strong", "b"):
        return f"**{inner}**" if inner.strip() else ""
    if tag == "code":
        return inner if n.parent is not None and n.parent.tag == "pre" else _code_span(n.text())
    if tag == "a":
        href, title = n.attrs.get("href", ""), _attribute(n.attrs.get("title", ""))
        if not href:
            return inner
        address = href.replace("(", "\\(").replace(")", "\\)")
        return f"[{inner}]({address}" + (' "' + title.replace('"', '\\"') + '"' if title else "") + ")"
    if tag == "img":
        src, title = n.attrs.get("src", ""), _attribute(n.attrs.get("title", ""))
        return f"![{_attribute(n.attrs.get('alt', ''))}]({src}" + (f' "{title}"' if title else "") + ")" if src else ""
    return f"\n\n{inner}\n\n" if tag in BLOCKS and inner.strip() else inner


def _attribute(value: str) -> str:
    """Line breaks with the blanks after them as one; the pattern is a fixed value."""
    return re.sub(r"(\n+\s*)+", "\n", value)


class _Sections:
    """Sections of a collapsed tree: the text under each path of headings."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, str]] = []
        self.found: list[dict] = []
        self.buffer, self.code = "", False

    def flush(self) -> None:
        if self.buffer.strip():
            self.found.append({"heading_path": " > ".join(t for _, t in self.stack) or "Content", "content": self.buffer.strip(), "heading_level": self.stack[-1][0] if self.stack else None, "has_code_blocks": self.code})
            self.code = False
        self.buffer = ""

    def newline(self) -> None:
        if self.buffer and not self.buffer.endswith("\n"):
            self.buffer += "\n"

    def walk(self, node: Node) -> None:
        for c in node.children:
            if isinstance(c, str):
                self.buffer += c
                continue
            tag = c.tag
            if tag in HEADINGS:
                title = _SPACE.sub(" ", c.text(SUPPRESSED)).strip()
                self.flush()
                if title:
                    level = int(tag[1])
                    self.stack = [s for s in self.stack if s[0] < level] + [(level, title)]
            elif tag == "pre":
                self.newline()
                self.buffer += f"```\n{code_of(c)[0]}\n```\n"
                self.code = True
            elif tag == "code":
                self.buffer += f"`{c.text()}`" if c.text() else ""
                self.code = True
            elif tag == "br":
                self.buffer += "\n"
            elif tag == "li":
                self.newline()
                self.buffer += "• "
                self.walk(c)
                self.newline()
            elif tag == "p":
                if self.buffer and not self.buffer.endswith(("\n\n", "• ")):
                    self.newline()
                self.walk(c)
                self.newline()
            elif tag in BLOCKS:
                self.newline()
                self.walk(c)
                self.newline()
            else:
                self.walk(c)


def sections(root: Node, fallback: str) -> list[dict]:
    """heading_path, content, heading_level, has_code_blocks; one section of the whole text where there are none."""
    s = _Sections()
    s.walk(root)
    s.flush()
    if not s.found and fallback.strip():
        s.found.append({"heading_path": "Main Content", "content": fallback, "heading_level": None, "has_code_blocks": "```" in fallback})
    return s.found


def title_of(root: Node, content: Node) -> str:
    """The title element, else the first h1, else the first heading of the content."""
    for n in root.elements():
        if n.tag == "title":
            text = " ".join(x for x in (c.strip() for c in n.children if isinstance(c, str)) if x)
            if text:
                return text
            break
    heads = [(h.tag, _SPACE.sub(" ", h.text(SUPPRESSED)).strip()) for h in content.elements() if h.tag in HEADINGS]
    return next((t for tag, t in heads if tag == "h1" and t), None) or next((t for _, t in heads if t), "Untitled Page")


def links_of(root: Node, base: str | None) -> list[str]:
    """Absolute addresses of the page's anchors, sorted, each once; without mail, scripts and places of the page itself."""
    out = set()
    for n in root.elements():
        href = n.attrs.get("href") if n.tag == "a" else None
        if href is None or href.startswith(("mailto:", "javascript:", "#", "\\#")):
            continue
        url = resolve(base, href)
        if url:
            head, mark, tail = url.partition("?") if "?" in url else url.partition("#")
            out.add(re.sub(r"/index\.[a-zA-Z0-9]+$", "/", head) + mark + tail)
    return sorted(out)


def is_dynamic(html: str) -> str | None:
    """What suggests that a page is built by scripts, or null."""
    probes = (("react", r"data-react|__REACT|react-root|_reactRoot"), ("vue", r"data-v-|__VUE|v-app|vue-app"), ("angular", r"ng-app|ng-version|\[ng-"), ("app script", r"<script[^>]+src=[\"'][^\"']*app[^\"']*\.js"), ("main script", r"<script[^>]+src=[\"'][^\"']*main[^\"']*\.js"), ("bundle", r"<script[^>]+src=[\"'][^\"']*bundle[^\"']*\.js"))
    for name, pattern in probes:
        if re.search(pattern, html, re.I):
            return name
    scripts = len(re.findall(r"<script\b", html, re.I))
    return "little text" if scripts > 3 and len(parse(html).text(frozenset(("script", "style"))).strip()) < 500 else None


def extract(html: str | None, url: str | None = None, rules: dict[str, Callable[[str, Node], str]] | None = None) -> dict | None:
    """title, raw_text, sections and links of a page; null for null."""
    if html is None:
        return None
    root = parse(html)
    whole = main_content(root)
    content = collapse(without_furniture(whole))
    text = markdown(content, rules)
    return {"title": title_of(root, content), "raw_text": text, "sections": sections(content, text), "links": links_of(root, url), "dynamic": is_dynamic(html)}
