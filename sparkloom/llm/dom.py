"""A small HTML reader: blocks of text with the path of elements around them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import cached_property

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*(?:>|\Z)|</?\Z|[^<]+|<", re.DOTALL)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)(.*?)>?\Z", re.DOTALL)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
SPACE = re.compile(r"\s+")
NUMBER = re.compile(r"\d+")
HIDDEN = re.compile(r"\shidden(\s|/?$)", re.IGNORECASE)

MAIN = frozenset(("article", "main"))
#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template noembed noframes annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Everything inside these belongs to the block around them: a formula or a picture's text is no block of its own.
EMBEDDED = frozenset(("math", "svg"))
#: Elements whose end a new one of these implies: what is open, by what begins.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


@dataclass
class Node:
    """An element, or a block of text (tag '#')."""

    tag: str
    mark: str = ""
    text: str = ""
    children: list[Node] = field(default_factory=list)
    #: Whether an article or main element is inside, and whether the element is marked as hidden.
    holds_main: bool = False
    hidden: bool = False

    @cached_property
    def digest(self) -> int:
        """A hash of the labels and texts of the whole tree below, children first and without recursion."""
        done: dict[int, int] = {}
        todo = [(self, False)]
        while todo:
            n, ready = todo.pop()
            if ready or not n.children:
                done[id(n)] = n.__dict__["digest"] = hash((n.label, n.text, *(done[id(c)] for c in n.children)))
            else:
                todo.append((n, True))
                todo += [(c, False) for c in n.children]
        return done[id(self)]

    @property
    def label(self) -> str:
        """What alignment and paths go by: the element and its marks, of which numbers differ from page to page."""
        return f"{self.tag}.{NUMBER.sub('#', self.mark)}" if self.mark else self.tag


def parse(source: str) -> Node:
    """The tree of block elements. Text of inline elements joins the block around them; white space becomes one space."""
    root = Node("html")
    stack, pending = [root], []
    opened: dict[str, int] = {}
    low = source.lower()
    at, end = 0, len(source)
    embedded = ""

    def flush() -> None:
        if pending:
            text = SPACE.sub(" ", html.unescape("".join(pending))).strip()
            pending.clear()
            if text:
                stack[-1].children.append(Node("#", "", text))

    def close(tags: tuple[str, ...], stop: tuple[str, ...]) -> None:
        if not any(opened.get(t) for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                flush()
                for n in stack[i:]:
                    opened[n.tag] -= 1
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    while at < end:
        m = TOKEN.match(source, at)
        token = m[0]
        at = m.end()
        if token[0] != "<" or len(token) == 1:
            pending.append(token)
            continue
        if token[1] in "!?" or token == "</":
            continue
        t = TAG.match(token)
        closing, tag, rest = t[1], t[2].lower(), t[3]
        if tag in EMBEDDED:
            embedded = "" if closing or rest.endswith("/") else tag
            continue
        if tag in INLINE or (embedded and tag not in RAW):
            if tag == "br" or tag == "img" or tag == "wbr":
                pending.append(" ")
            continue
        if tag in RAW and embedded and not closing:
            stop = low.find(f"</{tag}", at)
            at = end if stop < 0 else (low.find(">", stop) + 1 or end)
            continue
        if closing:
            flush()
            close((tag,), ())
            continue
        flush()
        if tag == "xmp":  # text as it stands, markup included
            stop = low.find("</xmp", at)
            pending.append(html.escape(source[at : end if stop < 0 else stop], quote=False))
            flush()
            at = end if stop < 0 else (low.find(">", stop) + 1 or end)
            continue
        mark, hidden = "", False
        if rest:
            found = {}
            for k, v in ATTRIBUTE.findall(rest):
                found.setdefault(k.lower(), v.strip("\"'").lower())
            hidden = "hidden" in found or bool(HIDDEN.search(rest))
            mark = " ".join(found[k] for k in ("id", "class", "role") if k in found)
        if tag in CLOSES_P:
            close(("p",), ("table", "td", "button", "html"))
        if tag in ITEMS:
            close(ITEMS[tag], ("ul", "ol", "dl", "table", "select", "menu", "html"))
        node = Node(tag, mark, hidden=hidden)
        if tag in RAW:
            stop = low.find(f"</{tag}", at)
            at = end if stop < 0 else (low.find(">", stop) + 1 or end)
            continue
        stack[-1].children.append(node)
        if tag in MAIN:
            for n in stack:
                n.holds_main = True
        if tag not in VOID:
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    flush()
    return root
