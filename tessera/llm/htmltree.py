"""A forgiving HTML reader: block elements become tree nodes, runs of inline text between their borders become leaves.

Scripts, styles, comments, titles, text areas and frames are skipped; what other elements hold is read, formulas, drawings' labels and
fall-back texts too; end tags that may be left out are implied; end tags that
close nothing are ignored; a page that breaks off is closed at its end. Character references are decoded in texts, and white
space inside a leaf becomes one space. The reader keeps one position and never looks at a character more than a few times.
"""

from __future__ import annotations

import html
import re

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is not markup, or never shown.
RAW = frozenset("script style title textarea iframe noframes noembed xmp".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BREAKS = frozenset(("hr",))
SPACES = frozenset(("br", "wbr", "img", "input"))
#: An opening tag closes the nearest open one of these, unless a border stands between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("thead", "tbody"), "thead": ("tbody",)}
BORDERS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "tfoot": ("table",), "thead": ("table",)}
NO_P_INSIDE = BLOCKS - {"button", "label", "legend", "option", "select", "summary", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>""")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


class Node:
    __slots__ = ("tag", "marks", "parent", "kids", "text", "linked", "label")

    def __init__(self, tag, marks, parent, label=None):
        self.tag, self.marks, self.parent, self.label = tag, marks, parent, label
        self.kids, self.text, self.linked = [], None, 0


def _attributes(raw: str) -> tuple[str, str | None]:
    if not raw or "=" not in raw:
        return "", None
    marks, label = [], None
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        if name.lower() == "data-y":
            label = a or b or c
        else:
            marks.append(a or b or c)
    return " ".join(marks), label


def read(page: str | None) -> Node:
    """The root of the page's tree; leaves have their text, and linked, the characters of it inside links."""
    root = top = Node("#root", "", None)
    page = page or ""
    pieces: list[str] = []
    linked, depth = 0, 0

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                leaf = Node("#text", "", top)
                leaf.text, leaf.linked = text, min(linked, len(text))
                top.kids.append(leaf)
        linked = 0

    def say(raw):
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if depth:
            linked += len(text)

    def close(tags, borders=()):
        nonlocal top
        n = top
        while n.parent is not None:
            if n.tag in tags:
                flush()
                top = n.parent
                return
            if n.tag in borders:
                return
            n = n.parent

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _NAME.match(page, lt + 1)
        if not m:
            say("<")
            at = lt + 1
            continue
        tag = m[1].lower()
        rest = _REST.match(page, m.end())
        if rest:
            end, attributes = rest.end(), page[m.end() : rest.end() - 1]
        else:
            end = page.find(">", m.end()) + 1
            if not end:
                break
            attributes = page[m.end() : end - 1]
        at = end
        if page[lt + 1] == "/":
            if tag in BLOCKS:
                close(HEADINGS if tag in HEADINGS else (tag,), ("table",) if tag in ("p", "div", "li") else ())
            elif tag == "a" and depth:
                depth -= 1
            continue
        if tag in RAW:
            if not attributes.endswith("/") or tag in ("script", "style", "title", "textarea"):
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                if tag == "xmp":  # shown as it stands
                    pieces.append(page[at : stop.start() if stop else n])
                at = stop.end() if stop else n
            continue
        if tag in BLOCKS:
            if tag in NO_P_INSIDE:
                close(("p",), ("table", "td", "th", "button", "article", "section", "div", "body"))
            if tag in CLOSES:
                close(CLOSES[tag], BORDERS[tag])
            flush()
            depth = 0
            marks, label = _attributes(attributes)
            node = Node(tag, marks, top, label)
            top.kids.append(node)
            top = node
        elif tag in BREAKS:
            flush()
        elif tag in SPACES:
            pieces.append(" ")
        elif tag == "a":
            depth = 1
    flush()
    return root
