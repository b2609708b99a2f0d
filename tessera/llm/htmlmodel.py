"""A tree-structured graphical model over page trees, and labelled pages to train it.

Every node with text below it has a state: boilerplate (0), content (1), or mixed (2, both below it); leaves are never mixed. The
joint probability is, for every edge, P(child's state | parent's state, kind of parent and child), times, for every node,
P(features | state), the features being independent given the state: tag, words of class, id and role, number of children,
for lists whether they hold links, and for leaves length, share of links and closing punctuation. Sum-product messages go up and down the tree and give every leaf's exact marginal.
All tables are smoothed counts over labelled pages, which are made here from templates by a seeded generator.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

from . import htmltree

STATES = 3
LISTS = ("ul", "ol", "table")
_SPLIT = re.compile(r"[^a-z0-9]+")

#: Words that pages use in class, id and role for each part of a page.
PARTS = {
    "content": "article content main post entry story body text prose markdown blog news page paper copy articlebody postbody single".split(),
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav subnav toolbar tabs pagination pager links sitemap dropdown hamburger".split(),
    "header": "header masthead banner topbar brand logo hero head site title tagline".split(),
    "footer": "footer foot copyright legal bottom colophon contentinfo imprint credits".split(),
    "sidebar": "sidebar side aside widget related recommended popular trending rail toc tags complementary more teaser recirc".split(),
    "notice": "notice cookie cookies consent gdpr alert warning popup modal overlay newsletter subscribe paywall message disclaimer toast privacy dialog".split(),
    "ad": "ad ads advert adverts advertisement advertising promo sponsor sponsored promotion dfp adsense outbrain taboola commercial".split(),
    "form": "form search login signin signup register contact input poll survey feedback".split(),
    "comments": "comment comments discussion replies reply respond disqus reader thread responses feedback usercomments commentlist".split(),
    "share": "share social sharing follow buttons twitter facebook likes".split(),
}
TAGS = {"nav": ("nav", "div", "ul", "menu"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div", "section"), "notice": ("div", "section", "p", "dialog"), "ad": ("div", "aside", "section", "p"), "form": ("form",), "comments": ("section", "div"), "share": ("div", "section", "nav")}
NEUTRAL = "container wrapper row col inner outer block box clearfix js left right lg md item list section module panel".split()


def _sentence(rng, most=22):
    words = ["".join(rng.choice("aeiounrtslédchmü") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, most))]
    return " ".join(words).capitalize() + rng.choice(("." , ".", ".", ".", "!", "?"))


def _title(rng, most):
    return _sentence(rng, most).strip("." if rng.random() < 0.8 else "")


def _text(rng, most=6):
    return " ".join(_sentence(rng) for _ in range(rng.randint(1, most)))


def _mark(rng, part, tag, chance=0.85):
    semantic = tag in ("nav", "header", "footer", "aside", "form", "article", "main")
    if rng.random() > (0.5 if semantic else chance):
        return ""
    words = [rng.choice(PARTS[part])]
    if rng.random() < 0.3:
        words.append(rng.choice(NEUTRAL))
        rng.shuffle(words)
    return f' {rng.choice(("class", "class", "id"))}="{rng.choice("- _").join(words)}"'


def _links(rng):
    items = [f'<li><a href="#">{" ".join(_sentence(rng, 3).strip(".!?").split())}</a></li>' for _ in range(rng.randint(2, 9))]
    return "<ul>" + "".join(items) + "</ul>" if rng.random() < 0.7 else " ".join(re.sub(r"</?li>", "", i) for i in items)


def _boilerplate(rng, part):
    tag = rng.choice(TAGS[part])
    if part in ("nav", "share"):
        inner = _links(rng)
    elif part == "sidebar":
        inner = f"<h3>{_sentence(rng, 4)}</h3>" * (rng.random() < 0.6) + (_links(rng) if rng.random() < 0.6 else f"<p>{_text(rng, 3)}</p>")
    elif part == "header":
        inner = rng.choice(("<h1>{}</h1>", "<p>{}</p>", "<div>{}</div>", "{}", '<a href="/">{}</a>')).format(_sentence(rng, 6).strip("."))
        inner += _links(rng) if rng.random() < 0.4 else ""
    elif part == "footer":
        inner = rng.choice(("", "&copy; ", "<p>&copy; ")) + _text(rng, 2) + (_links(rng) if rng.random() < 0.4 else "")
    elif part == "form":
        inner = f'<label>{_sentence(rng, 4)}</label><input name="q"><button>{_sentence(rng, 2)}</button>' if rng.random() < 0.7 else f"<p>{_text(rng, 2)}</p><button>x</button>"
    elif part == "comments":
        inner = (f"<h3>{_sentence(rng, 3)}</h3>" if rng.random() < 0.5 else "") + "".join(f'<{c}{_mark(rng, part, c, 0.7)}><p>{_text(rng, 4)}</p></{c}>' for c in [rng.choice(("div", "div", "div", "li", "li", "article"))] for _ in range(rng.randint(1, 5)))
    else:
        inner = _text(rng, 3) if tag == "p" or rng.random() < 0.6 else f"<p>{_text(rng, 3)}</p>"
    return f'<{tag}{_mark(rng, part, tag, 1.0 if tag in ("div", "section", "p", "ul", "ol") else 0.6)} data-y="b">{inner}</{tag}>'


def _article(rng):
    parts = []
    if rng.random() < 0.85:
        title = f"<h1>{_title(rng, 14)}</h1>"
        parts.append(f"<header>{title}</header>" if rng.random() < 0.1 else title)
    for _ in range(rng.randint(1, 9)):
        kind = rng.random()
        if kind < 0.72:
            body = _text(rng, rng.choice((1, 1, 3, 6, 12)))
            if rng.random() < 0.2:
                body = body.rstrip(".!?")
            if rng.random() < 0.15:
                body = body.replace(" ", ' <a href="#">link text</a> ', 1)
            parts.append(rng.choice(("<p>{}</p>",) * 5 + ("<div>{}</div>",)).format(body))
        elif kind < 0.82:
            parts.append(f"<h2>{_title(rng, 6)}</h2>")
        elif kind < 0.9:
            parts.append("<ul>" + "".join(f"<li>{_title(rng, 12)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
        elif kind < 0.94:
            parts.append(f"<blockquote><p>{_text(rng, 3)}</p></blockquote>")
        elif kind < 0.97:
            parts.append("<table>" + "".join(f"<tr><td>{_title(rng, 3)}</td><td>{_title(rng, 3)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
        else:
            parts.append(f"<figure><figcaption>{_sentence(rng)}</figcaption></figure>")
        if rng.random() < 0.08:
            parts.append(_boilerplate(rng, rng.choice(("ad", "notice", "sidebar", "share", "form"))))
    if rng.random() < 0.15:
        parts.append(_boilerplate(rng, rng.choice(("comments", "share", "sidebar"))))
    tag = rng.choice(("article",) * 4 + ("main", "div", "div", "section"))
    mark = _mark(rng, "content", tag, 0.95)
    whole = f'<{tag}{mark} data-y="c">{"".join(parts)}</{tag}>'
    for _ in range(rng.choice((0, 0, 1, 2))):
        tag = rng.choice(("div", "div", "main", "section"))
        beside = "".join(_boilerplate(rng, rng.choice(("sidebar", "ad", "comments", "share", "nav"))) for _ in range(rng.choice((0, 0, 1, 2))))
        whole = f'<{tag}{_mark(rng, "content", tag, 0.2)}>{whole}{beside}</{tag}>'
    return whole


def labelled_page(rng: random.Random) -> str:
    """A page whose data-y attributes (b, c) label the parts of its text."""
    before = [_boilerplate(rng, p) for p in ("notice", "header", "nav", "form", "ad", "sidebar") if rng.random() < 0.45]
    after = [_boilerplate(rng, p) for p in ("share", "comments", "sidebar", "ad", "nav", "form", "notice", "footer") if rng.random() < 0.4]
    rng.shuffle(before)
    return f'<html><body>{"".join(before)}{_article(rng)}{"".join(after)}</body></html>'


def marks_of(node) -> tuple[str, ...]:
    return tuple(dict.fromkeys(w for w in _SPLIT.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", node.marks).lower()) if w and not w.isdigit())) if node.marks else ()


def leaf_features(leaf) -> tuple:
    n = len(leaf.text)
    share = leaf.linked / n
    return ("len", min(6, int(math.log2(1 + n / 12)))), ("links", 0 if share < 0.05 else 1 if share < 0.5 else 2), ("end", leaf.text[-1] in ".!?…\"'”’»:;)")


class Flat:
    """The nodes of a tree that have text below them, parents first, and the shape of each: children, and whether a list is of links."""

    def __init__(self, root):
        self.nodes, self.parents, self.shapes = [], [], []
        alive: dict[int, bool] = {}
        stack, order = [root], []
        while stack:
            n = stack.pop()
            order.append(n)
            stack.extend(n.kids)
        for n in reversed(order):
            alive[id(n)] = n.text is not None or any(alive[id(k)] for k in n.kids)
        stack = [(root, -1)] if alive[id(root)] else []
        while stack:
            n, parent = stack.pop()
            i = len(self.nodes)
            self.nodes.append(n)
            self.parents.append(parent)
            stack.extend((k, i) for k in reversed(n.kids) if alive[id(k)])
        size, linked, kids = ([0] * len(self.nodes) for _ in range(3))
        for i in range(len(self.nodes) - 1, -1, -1):
            n, p = self.nodes[i], self.parents[i]
            if n.text is not None:
                size[i], linked[i] = len(n.text), n.linked
            if p >= 0:
                size[p] += size[i]
                linked[p] += linked[i]
                kids[p] += 1
        for k, x, y in zip(kids, size, linked):
            self.shapes.append((("kids", 1 if k < 2 else 2 if k < 4 else 3), ("linked", y > x / 2) if self.nodes[len(self.shapes)].tag in LISTS else ("no list", True)))


def kind(parent, child) -> int:
    """Which table an edge uses: of page, article-like and other parents; of leaves and elements."""
    group = 0 if parent.tag in ("#root", "html", "body") else 1 if parent.tag in ("article", "main") else 2
    return 2 * group + (child.text is not None)


class TreeModel:
    def __init__(self, pages: int = 1500, seed: int = 3):
        rng = random.Random(seed)
        self.edge = [[[0.5] * STATES for _ in range(STATES)] for _ in range(6)]
        tags, marks, leaf, shapes, states = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), [Counter(), Counter()]
        for _ in range(pages):
            flat = Flat(htmltree.read(labelled_page(rng)))
            truth = self.truth(flat)
            for n, p, y, shape in zip(flat.nodes, flat.parents, truth, flat.shapes):
                is_leaf = n.text is not None
                states[is_leaf][y] += 1
                if p >= 0:
                    self.edge[kind(flat.nodes[p], n)][truth[p]][y] += 1
                if is_leaf:
                    leaf[y].update(leaf_features(n))
                else:
                    tags[y][n.tag] += 1
                    shapes[y].update(shape)
                    marks[y].update(marks_of(n))
        for k, table in enumerate(self.edge):
            for i, row in enumerate(table):
                if k % 2:
                    row[2] = 0.0
                table[i] = [x / sum(row) for x in row]
        every_tag = {t for c in tags.values() for t in c} | {"?"}
        self.tag = {t: [(tags[y][t] + 0.3) / (states[0][y] + 0.3 * len(every_tag)) for y in range(STATES)] for t in every_tag}
        self.mark = {w: [(marks[y][w] + 0.3) / (states[0][y] + 0.6) for y in range(STATES)] for w in {w for c in marks.values() for w in c} if sum(marks[y][w] for y in range(STATES)) >= 3}
        self.leaf = {f: [(leaf[y][f] + 1) / (states[1][y] + 4) for y in range(2)] + [0.0] for f in {f for c in leaf.values() for f in c}}
        self.shape = {f: [(shapes[y][f] + 1) / (states[0][y] + 4) for y in range(STATES)] for f in {f for c in shapes.values() for f in c}}
        self.seen: dict[tuple, list[float]] = {}

    @staticmethod
    def truth(flat) -> list[int]:
        """States of labelled trees: leaves by the nearest labelled ancestor, others by what is below them."""
        truth, label = [None] * len(flat.nodes), []
        for n, p in zip(flat.nodes, flat.parents):
            label.append(n.label or (label[p] if p >= 0 else "b"))
        for i in range(len(flat.nodes) - 1, -1, -1):
            if flat.nodes[i].text is not None:
                truth[i] = int(label[i] == "c")
            p = flat.parents[i]
            if p >= 0:
                truth[p] = truth[i] if truth[p] is None or truth[p] == truth[i] else 2
        return truth

    def potential(self, n, shape) -> list[float]:
        if n.text is not None:
            key = leaf_features(n)
            factors = [self.leaf[f] for f in key if f in self.leaf] if key not in self.seen else ()
        else:
            key = (n.tag, n.marks, shape)
            factors = [self.tag.get(n.tag, self.tag["?"]), *(self.shape[f] for f in shape if f in self.shape), *(self.mark[w] for w in marks_of(n) if w in self.mark)] if key not in self.seen else ()
        if (found := self.seen.get(key)) is None:
            found = [math.prod(f[y] for f in factors) for y in range(STATES)]
            if n.text is not None:
                found[2] = 0.0
            top = max(found)
            found = [x / top for x in found]
            if len(self.seen) > 50_000:  # a memo of fixed size
                self.seen.clear()
            self.seen[key] = found
        return found

    def marginals(self, flat) -> list[float]:
        """Probability of content for every node, by messages up and down the tree."""
        nodes, parents = flat.nodes, flat.parents
        own = [list(self.potential(n, shape)) for n, shape in zip(nodes, flat.shapes)]
        up = [None] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            e, (a, b, c) = self.edge[kind(nodes[parents[i]], nodes[i])], own[i]
            m = [r[0] * a + r[1] * b + r[2] * c for r in e]
            s = m[0] + m[1] + m[2]
            up[i] = m = [x / s for x in m]
            belief = own[parents[i]]
            belief = [belief[0] * m[0], belief[1] * m[1], belief[2] * m[2]]
            s = belief[0] + belief[1] + belief[2]
            own[parents[i]] = [x / s for x in belief]
        for i in range(1, len(nodes)):
            e, parent, m = self.edge[kind(nodes[parents[i]], nodes[i])], own[parents[i]], up[i]
            a, b, c = (parent[y] / m[y] if m[y] else 0.0 for y in range(3))
            mine = own[i]
            mine = [mine[y] * (a * e[0][y] + b * e[1][y] + c * e[2][y]) for y in range(3)]
            s = mine[0] + mine[1] + mine[2]
            own[i] = [x / s for x in mine]
        return [x[1] / (x[0] + x[1] + x[2]) for x in own]

    def blocks(self, page: str | None) -> list[tuple[str, float]]:
        """(text, probability of content) of the page's leaves in order."""
        flat = Flat(htmltree.read(page))
        if not flat.nodes:
            return []
        return [(n.text, p) for n, p in zip(flat.nodes, self.marginals(flat)) if n.text is not None]
