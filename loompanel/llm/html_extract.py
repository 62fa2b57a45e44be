"""Main text of web pages by a tree-structured graphical model.

*Tree.*  A page is parsed leniently (implied end tags, unclosed elements, raw script and style); its
block elements and the text blocks inside them are the nodes.  Inline elements belong to their block.
Parsing takes time in proportion to the page's length, whatever is left open in it.

*Model.*  Every node is content or not.  A node potential for an element's features (hints in class, id
and role, share of link text, length, sentences, a copyright sign, a heading before parts that are no paragraphs) and a potential between parent and child,
by the child's kind of tag and whether it stands inside the page's article, outside of it, or in a page that
names none, are estimated by counting over labelled pages.  Names that also occur in articles ("tags",
"head") are weak hints, a kind of their own.  Wrappers that say nothing and hold one part pass the state on, however deep they are nested.
Sum-product messages go up the tree and down again; a text block is kept if its marginal probability of
content is at least one half.

*Text.*  Character references are decoded, white space in a block becomes one space, blocks are trimmed
and joined in page order by a blank line.  Nothing else is dropped or cut.

Pages are handled row by row, whole, without a shuffle; the model is a small table of fixed size.

Nulls count as empty pages (empty text); null ids and urls are carried through.  Repeated rows each get
a row; other input columns are not read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import unescape
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: What stands in these is no text of the page; the first four run to the end of the page if they are not closed.
TO_THE_END = set("script style title textarea".split())
DROPPED = TO_THE_END | set("noscript template svg iframe canvas select audio video button".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var object picture math semantics annotation mi mn mo ms mtext mrow msup msub mfrac msqrt mroot mover munder mtable mtr mtd".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Tags whose start tag closes an open one of the same group, and the elements beyond which it closes none.
GROUPS = {"p": 0, "li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4, "thead": 5, "tbody": 5, "tfoot": 5}
CLOSES = {"li": (1,), "dt": (2,), "dd": (2,), "td": (4,), "th": (4,), "tr": (3, 4), "thead": (3, 4, 5), "tbody": (3, 4, 5), "tfoot": (3, 4, 5)}
SCOPES = set("table ul ol dl div section article main body aside header footer nav form td th".split())
LISTS = set("table ul ol dl menu".split())
NOWHERE = (-1,) * 6
#: Tags by kind; other block tags are kind 0.
KINDS = [set(), {"article", "main"}, {"section", "div"}, {"p", "blockquote", "pre", "figure", "figcaption", "dd"}, set("h1 h2 h3 h4 h5 h6 hgroup".split()), set("ul ol dl menu".split()), {"li", "dt"}, {"nav"}, {"header"}, {"footer", "address"}, {"aside"}, set("form fieldset".split()), set("table tbody thead tfoot tr".split()), {"td", "th"}, {"html", "body"}, {"#text"}]
#: Kinds of parts that hold no article: nav, footer, aside.
OFFSIDE = {7, 9, 10}
KIND = {t: i for i, tags in enumerate(KINDS) for t in tags}
#: Words that authors of pages use in names of classes, by what they say about the part.
AGAINST = re.compile(r"(?<![a-z])(?:ads?|adsby\w*|advert\w*|banner\w*|promo\w*|sponsor\w*|nav\w*|menu\w*|side-?bar\w*|rail|footer\w*|header|masthead|comments?\w*|disqus\w*|repl(?:y|ies)|respon(?:d|ses?)|discussions?|reactions?|feedback|threads?|cookies?\w*|consent|gdpr|notice\w*|alert|disclaimer|pop-?up|modal|overlay|newsletter|subscri\w*|sign-?up|log-?in|shar(?:e|ing)\w*|social\w*|relat\w*|recommend\w*|bread-?crumbs?|pag(?:er|ination)|search\w*|widgets?|copyright|toolbar|tagcloud|skip|complementary|contentinfo|navigation|dialog)(?![a-z])")
WEAK = re.compile(r"(?<![a-z])(?:head(?!-?line)|foot\w*|form|legal|tags?)(?![a-z])")
RIGHTS = re.compile(r"(?:©|\(c\)|copyright)\s*(?:©|\(c\))?\s*\d{4}", re.IGNORECASE)
IN_FAVOUR = re.compile(r"(?<![a-z])(?:article\w*|content|post|entry|main|story|body|text|prose)(?![a-z])")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
OPENING = re.compile(r"=\s*+([\"'])|>")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|data-main)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
#: Values of the features of an element: its hint; links by length; kind by length and sentences; rights; its make-up.
FEATURES = (5, 30, 18 * len(KINDS), 2, 6)
#: Kinds that lists of messages are made of: article, div, list, list item.
ITEMS = {1, 2, 5, 6}
#: Where a node stands: in a page without a part that is named an article, outside of it, inside.
NONE_NAMED, OUTSIDE, INSIDE = range(3)


@dataclass
class Tree:
    """Nodes in page order (parents first): parent, kind, hint, whether they stand inside an article or a
    part whose name speaks in favour; text blocks by node."""

    parent: list[int]
    kind: list[int]
    hint: list[int]
    mark: list[bool]
    inside: list[bool]
    blocks: dict[int, tuple[str, int]]  # text, and its characters in links


def _hint(attributes: str) -> tuple[int, bool]:
    found = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(attributes)}
    said = " ".join(found.get(k, "") for k in ("class", "id", "role"))
    said = re.sub(r"([a-z])([A-Z])", r"\1-\2", said).lower()
    hint = (1 if AGAINST.search(said) else 0) + (2 if IN_FAVOUR.search(said) else 0)
    return hint or (4 if WEAK.search(said) else 0), found.get("data-main") == "1"


class Tags:
    """The tags of a page, in one pass: (start, end, whether an end tag, name, attributes).  Comments and
    declarations have the name "".  A quote that never closes, or behind which no tag ends, stands as it is;
    a tag that never ends is text."""

    def __init__(self, html: str) -> None:
        self.html, self.last, self.plain = html, html.rfind(">"), False
        self.unclosed: set[str] = set()

    def end(self, at: int) -> int:
        """Where the tag ends whose name ends at ``at``; a ``>`` is known to follow."""
        if not self.plain:
            i = at
            while m := OPENING.search(self.html, i):
                quote = m.group(1)
                if quote is None:
                    return m.start()
                close = -1 if quote in self.unclosed else self.html.find(quote, m.end())
                if close < 0:
                    self.unclosed.add(quote)
                i = m.end() if close < 0 else close + 1
            self.plain = True
        return self.html.find(">", at)

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        html = self.html
        while 0 <= (i := html.find("<", at)) < self.last:
            if html.startswith("<!--", i):
                end = html.find("-->", i + 4)
                return i, end + 3 if end >= 0 else len(html), False, "", ""
            closing = html.startswith("</", i)
            name = NAME.match(html, i + 1 + closing)
            if name:
                end = self.end(name.end())
                return i, end + 1, closing, name.group().lower(), html[name.end() : end]
            if closing or html[i + 1] in "!?":
                return i, html.find(">", i) + 1, False, "", ""
            at = i + 1
        if i >= 0 and (i := html.find("<!--", i)) >= 0:  # a comment without an end
            return i, len(html), False, "", ""
        return None


class Builder:
    """Makes the tree: a stack of open blocks, each with its open inline elements.  Every step costs time
    in proportion to what it opens and closes, so a page costs time in proportion to its length."""

    def __init__(self) -> None:
        self.tree = Tree([-1], [KIND["html"]], [0], [False], [False], {})
        self.open: list[tuple[str, int, tuple[int, ...], list[str], dict[str, int]]] = [("html", 0, NOWHERE, [], {})]
        self.count: dict[str, int] = {}  # open blocks by tag
        self.pieces: list[str] = []
        self.linked: list[str] = []
        self.links = 0

    def node(self, kind: int, hint: int = 0, mark: bool = False, favour: bool = False) -> int:
        tree, parent = self.tree, self.open[-1][1]
        tree.parent.append(parent)
        tree.kind.append(kind)
        tree.hint.append(hint)
        tree.mark.append(mark)
        tree.inside.append(tree.inside[parent] or tree.kind[parent] == 1 or tree.hint[parent] == 2)
        return len(tree.parent) - 1

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.tree.blocks[self.node(KIND["#text"])] = text, min(len(text), len("".join(self.linked)))
            self.pieces, self.linked = [], []

    def add(self, raw: str) -> None:
        if raw:
            text = unescape(raw) if "&" in raw else raw
            self.pieces.append(text)
            if self.links:
                self.linked.append(text)

    def close(self, depth: int) -> None:
        """Close the open blocks from this place of the stack on."""
        if len(self.open) > depth:
            self.flush()
        while len(self.open) > depth:
            tag, _, _, inline, _ = self.open.pop()
            self.count[tag] -= 1
            self.links -= inline.count("a")

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.pieces.append(" ")
        elif tag in INLINE:
            inline, count = self.open[-1][3:]
            inline.append(tag)
            count[tag] = count.get(tag, 0) + 1
            self.links += tag == "a"
        elif tag == "body":
            self.flush()
            self.close(1)
            self.open[0][3].clear()
            self.open[0][4].clear()
            self.links = 0
        elif tag in ("html", "head"):
            self.flush()
        elif tag == "hr" or tag not in VOID:
            near = self.open[-1][2]
            if tag in CLOSES_P and near[0] > 0:
                self.close(near[0])
            if tag in CLOSES and (at := [near[g] for g in CLOSES[tag] if near[g] > 0]):
                self.close(min(at))
            self.flush()
            if tag == "hr":
                return
            near = self.open[-1][2]
            hint, mark = _hint(attributes) if attributes else (0, False)
            node = self.node(KIND.get(tag, 0), hint, mark)
            if tag in GROUPS or tag in SCOPES or tag in LISTS:
                own = list(NOWHERE if tag in LISTS else near)
                if tag in SCOPES:
                    own[0] = -1
                if tag in GROUPS:
                    own[GROUPS[tag]] = len(self.open)
                near = tuple(own)
            self.open.append((tag, node, near, [], {}))
            self.count[tag] = self.count.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag in INLINE:
            inline, count = self.open[-1][3:]
            while count.get(tag):
                last = inline.pop()
                count[last] -= 1
                self.links -= last == "a"
                if last == tag:
                    break
        elif self.count.get(tag):
            depth = len(self.open) - 1
            while self.open[depth][0] != tag:
                depth -= 1
            self.close(depth)
        elif tag == "p":
            self.flush()


def parse(html: str) -> Tree:
    build, tags = Builder(), Tags(html)
    at = 0
    never: set[str] = set()  # dropped elements without an end tag from here on
    while found := tags.next(at):
        start, end, closing, tag, attributes = found
        build.add(html[at:start])
        at = end
        if closing:
            build.end(tag)
        elif tag in DROPPED:
            if tag in never or attributes.endswith("/") and tag not in TO_THE_END:
                continue
            stop = re.compile(rf"</{tag}[\s/>]", re.IGNORECASE).search(html, at)
            if stop:
                at = max(html.find(">", stop.end() - 1) + 1, stop.end())
            elif tag in TO_THE_END:
                at = len(html)
            else:
                never.add(tag)
        elif tag:
            build.start(tag, attributes)
    build.add(html[at:])
    build.flush()
    return build.tree


def observed(tree: Tree) -> list[tuple[int, tuple[int, ...]] | None]:
    """The discrete features of every element, and whether it holds text itself; a text block, and a plain
    wrapper around one other element, have none of their own."""
    n = len(tree.parent)
    chars, linked, ends, parts, rights = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for i, (text, in_links) in tree.blocks.items():
        chars[i], linked[i] = len(text), in_links
        rights[i] = len(text) < 200 and RIGHTS.search(text) is not None
        ends[i] = text.count(". ") + text.count(", ") + text.endswith((".", "!", "?", "…"))
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        ends[p] += ends[i]
        parts[p] += chars[i] > 0
        rights[p] += rights[i]
    direct = [0] * n
    for i in tree.blocks:
        direct[tree.parent[i]] = 1
    headed, items, texts = [-1] * n, [0] * n, [0] * n  # the first part is a heading; parts like messages, paragraphs
    for i in range(1, n):
        p = tree.parent[i]
        if chars[i]:
            headed[p] = int(tree.kind[i] == 4) if headed[p] < 0 else headed[p]
            items[p] += tree.kind[i] in ITEMS
            texts[p] += tree.kind[i] == 3
    out: list[tuple[int, tuple[int, ...]] | None] = []
    for i in range(n):
        if i in tree.blocks or tree.kind[i] in (0, 2) and not tree.hint[i] and parts[i] == 1 and not direct[i]:
            out.append(None)
            continue
        share = linked[i] / chars[i] if chars[i] else 0
        density = 0 if not chars[i] else 1 if share == 0 else 2 if share < 0.25 else 3 if share < 0.6 else 4
        c = chars[i]
        size = 0 if not c else 1 if c < 20 else 2 if c < 60 else 3 if c < 200 else 4 if c < 1000 else 5
        out.append((direct[i], (tree.hint[i], 6 * density + size, 18 * tree.kind[i] + 3 * size + min(ends[i], 2), int(rights[i] > 0 and c < 400), 3 * (headed[i] == 1) + (0 if texts[i] else 1 + (items[i] > 1)))))
    return out


#: A plain wrapper around one part is what the part around it is.
STRAIGHT = [[0.999, 0.001], [0.001, 0.999]]


def cases(tree: Tree) -> list[int]:
    """Which pair potential each node has with its parent: by its kind, where it stands, and whether its name
    speaks against it, strongly or weakly.

    An article of the page is a part that is named so, by its tag or class, stands in no part that speaks
    against it, and holds a quarter of the text that the largest such part holds; the largest one has to hold
    a third of the page's text (comments are often tagged as articles, too)."""
    n = len(tree.parent)
    chars, against, named = [0] * n, [False] * n, []
    for i, (text, _) in tree.blocks.items():
        chars[i] = len(text)
    for i in range(n - 1, 0, -1):
        chars[tree.parent[i]] += chars[i]
    for i in range(1, n):
        against[i] = against[tree.parent[i]] or tree.hint[i] == 1 or tree.kind[i] in OFFSIDE
        if not against[i] and (tree.kind[i] == 1 or tree.hint[i] == 2):
            named.append(i)
    largest = max((chars[i] for i in named), default=0)
    whole = {i for i in named if 4 * chars[i] >= largest} if 3 * largest >= chars[0] and largest else set()
    inside = [False] * n
    for i in range(1, n):
        inside[i] = inside[tree.parent[i]] or tree.parent[i] in whole
    places = ((INSIDE if x else OUTSIDE) if whole else NONE_NAMED for x in inside)
    said = {1: 1, 4: 2}
    return [9 * k + 3 * p + said.get(h, 0) for k, p, h in zip(tree.kind, places, tree.hint)]


@dataclass
class TreeModel:
    """root: shares of the states at the root.  pair[case][parent][child]: potential between states.
    node[holds text itself][feature][state][value]: node potentials."""

    root: list[float]
    pair: list[list[list[float]]]
    node: list[list[list[list[float]]]]

    def marginals(self, tree: Tree) -> list[float]:
        """Probability of content of every node."""
        n = len(tree.parent)
        case = cases(tree)
        up0, up1 = [0.5] * n, [0.5] * n
        pairs = []
        for i, seen in enumerate(observed(tree)):
            pairs.append(self.pair[case[i]] if seen or i in tree.blocks else STRAIGHT)
            if seen:
                for (no, yes), v in zip(self.node[seen[0]], seen[1]):
                    up0[i] *= no[v]
                    up1[i] *= yes[v]
        to0, to1 = [1.0] * n, [1.0] * n  # message to the parent
        for i in range(n - 1, 0, -1):
            s = up0[i] + up1[i]
            u, v = up0[i] / s, up1[i] / s
            up0[i], up1[i] = u, v
            (p00, p01), (p10, p11) = pairs[i]
            to0[i], to1[i] = p00 * u + p01 * v, p10 * u + p11 * v
            p = tree.parent[i]
            x, y = up0[p] * to0[i], up1[p] * to1[i]
            up0[p], up1[p] = x / (x + y), y / (x + y)
        down0, down1 = [self.root[0]] * n, [self.root[1]] * n
        result = [0.0] * n
        for i in range(n):
            if i:
                p = tree.parent[i]
                (p00, p01), (p10, p11) = pairs[i]
                # all that the parent knows but from this child
                x, y = up0[p] * down0[p] / to0[i], up1[p] * down1[p] / to1[i]
                d0, d1 = x * p00 + y * p10, x * p01 + y * p11
                down0[i], down1[i] = d0 / (d0 + d1), d1 / (d0 + d1)
            x, y = up0[i] * down0[i], up1[i] * down1[i]
            result[i] = y / (x + y)
        return result

    def extract(self, html: str) -> str:
        tree = parse(html)
        if not tree.blocks:
            return ""
        content = self.marginals(tree)
        return "\n\n".join(text for i, (text, _) in sorted(tree.blocks.items()) if content[i] >= 0.5)


def states_of(tree: Tree) -> list[int]:
    """Labels of the nodes of a marked page: content is what is marked, has a marked node inside, or is
    the text of a marked node."""
    state = [int(m) for m in tree.mark]
    for i in range(len(state) - 1, 0, -1):
        if i in tree.blocks:
            state[i] = int(tree.mark[tree.parent[i]])
        if state[i]:
            state[tree.parent[i]] = 1
    return state


def count_tree_model(trees: list[Tree], powers: tuple[float, float]) -> TreeModel:
    """Shares by counting.  ``powers`` soften the potentials of what the text looks like, of elements around
    others and of those that hold text: siblings look alike, and each counts as evidence of its own."""
    pair = [[[1.0, 0.02], [1.0, 1.0]] for _ in range(9 * len(KINDS))]  # content hardly stands in what is none
    node = [[[[0.5] * size for _ in range(2)] for size in FEATURES] for _ in range(2)]
    root = [0.5, 1.0]
    for tree in trees:
        state = states_of(tree)
        root[state[0]] += 1
        case = cases(tree)
        for i, values in enumerate(observed(tree)):
            if i and (values or i in tree.blocks):
                pair[case[i]][state[tree.parent[i]]][state[i]] += 1
            if values:
                for table, v in zip(node[values[0]], values[1]):
                    table[state[i]][v] += 1
    pair = [[[x / sum(row) for x in row] for row in table] for table in pair]
    node = [[[[(x / sum(row)) ** (power if f in (1, 2) else 1.0) for x in row] for row in table] for f, table in enumerate(tables)] for power, tables in zip(powers, node)]
    return TreeModel([x / sum(root) for x in root], pair, node)


def fit_tree_model(pages: Iterable[str], powers: tuple[float, ...] = (0.05, 0.15, 0.35, 1.0)) -> TreeModel:
    """From pages whose content elements carry ``data-main="1"``; a third of the pages chooses the powers."""
    trees = [parse(html) for html in pages]
    train, tune = [t for i, t in enumerate(trees) if i % 3], trees[::3]

    def wrong(pair: tuple[float, float]) -> int:
        model = count_tree_model(train or trees, pair)
        return sum((g[i] >= 0.5) != bool(s[i]) for t in tune for g, s in [(model.marginals(t), states_of(t))] for i in t.blocks)

    return count_tree_model(trees, min(product(powers, powers), key=wrong))


def labelled_pages(n: int = 900, seed: int = 7) -> list[str]:
    """Pages of many layouts with their content marked, drawn from rules: where the article stands, how
    deep, and which menus, headers, notices, adverts, forms, comments, sidebars and footers stand around it."""
    r = random.Random(seed)
    syllables = ["la", "ne", "ti", "or", "en", "sch", "al", "qu", "io", "er", "ta", "mo", "vi", "do"]
    m = ' data-main="1"'

    def words(low: int, high: int) -> str:
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def prose(low: int = 1, high: int = 6) -> str:
        return " ".join(words(3, 18).capitalize() + r.choice([".", ".", ".", "!", "?"]) for _ in range(r.randint(low, high)))

    def links(count: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{i}">{words(1, 4)}</a></{tag}>' for i in range(count))

    def named(kind: str, names: str, inner: str) -> str:
        return f'<{kind} {r.choice(["class", "class", "id"])}="{r.choice(names.split())}">{inner}</{kind}>'

    def wrapped(inner: str, most: int) -> str:
        """In up to ``most`` elements that say nothing."""
        for _ in range(r.randint(0, most)):
            inner = r.choice(["<div>{}</div>", "<div>{}</div>", "<section>{}</section>", '<div class="row">{}</div>', '<div class="c-12">{}</div>']).format(inner)
        return inner

    def paragraph() -> str:
        text = prose(1, r.choice([1, 2, 6, 10]))
        if r.random() < 0.3:
            text += f' <a href="#">{words(1, 3)}</a> {prose(1, 1)}'
        if r.random() < 0.2:
            text = f"<{(t := r.choice(['em', 'strong', 'span', 'i']))}>{prose(1, 2)}</{t}> {text}"
        return r.choice([f"<p{m}>{text}</p>"] * 5 + [f"<p{m}>{text}", f"<div{m}>{text}</div>"])

    def article() -> str:
        title = f"<h1{m}>{words(3, 10).capitalize()}</h1>"
        if r.random() < 0.15:
            title = f'<div class="{r.choice(["head-line", "headline", "title", "head"])}">{title}</div>'
        if r.random() < 0.25:
            title = f"<header>{title}{r.choice(['', f'<p{m}>{prose(1, 1)}</p>'])}</header>"
        parts = [title]
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            kind = r.random()
            if kind < 0.66:
                parts.append(wrapped(paragraph(), r.choice([0, 0, 0, 2])))
            elif kind < 0.74:
                parts.append(f"<h2{m}>{words(1, 6)}</h2>")
            elif kind < 0.82:
                parts.append("<ul>" + "".join(f"<li{m}>{prose(1, 1)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.87:
                parts.append(r.choice([f"<blockquote{m}>{prose(1, 3)}</blockquote>", f"<blockquote><p{m}>{prose(1, 3)}</p></blockquote>", f"<pre{m}>{prose(1, 3)}</pre>"]))
            elif kind < 0.91:
                parts.append(f"<table><tr><td{m}>{words(1, 4)}</td><td{m}>{words(1, 4)}</td></tr></table>")
            elif kind < 0.95:
                parts.append(f"<figure><figcaption{m}>{words(3, 9)}</figcaption></figure>")
            else:
                parts.append(wrapped("".join(paragraph() for _ in range(r.randint(2, 4))), 3))
            if r.random() < 0.05:
                parts.append(named("div", "tags head-box legal form foot-note", "".join(paragraph() for _ in range(r.randint(1, 2)))))
            if r.random() < 0.06:
                parts.append(named("div", "ad advert promo-box sponsored advertisement ad-slot", prose(1, 2)))
            if r.random() < 0.04:
                parts.append(f'<aside class="related"><ul>{links(3)}</ul></aside>')
        if r.random() < 0.1:
            parts.append(f"<footer>{links(r.randint(2, 4), 'span')}</footer>")
        body = wrapped("".join(parts), r.choice([0, 0, 1, 4]))
        if r.random() < 0.06:  # a list of links with what they lead to
            items = "".join(f'<li{m}><a href="/{i}">{words(6, 16).capitalize()}</a>{r.choice(["", " " + prose(1, 1)])}</li>' for i in range(r.randint(3, 9)))
            body = f"{title}<ul>{items}</ul>"
        if r.random() < 0.08:  # a text without paragraphs
            body = f"<div{m}>{prose(1, 4)}<br><br>{prose(1, 4)}<br>{prose(1, 3)}</div>"
        return r.choice(["<article>{}</article>", "<main><article>{}</article></main>", '<div id="content">{}</div>', '<div class="post"><div class="entry-content">{}</div></div>', '<article class="post-body"><section>{}</section></article>', '<main role="main">{}</main>', '<div class="wrap"><div class="story">{}</div></div>', "<div>{}</div>", "<div>{}</div>", "{}"]).format(body)

    def comments() -> str:
        kind = r.choice(["li", "div", "article"])
        inner = "".join(f"<{kind}>{r.choice(['', f'<b>{words(1, 2)}</b>'])}<p>{prose(1, 4)}</p></{kind}>" for _ in range(r.randint(1, 6)))
        inner = f"<h3>{words(1, 2)}</h3>" + (f"<ol>{inner}</ol>" if kind == "li" else inner)
        if r.random() < 0.3:  # a name that says nothing
            return r.choice(['<div class="user-posts">{}</div>', '<section class="c-list">{}</section>', "<section>{}</section>", '<div id="visitors">{}</div>']).format(inner)
        return named(r.choice(["section", "div"]), "comments comment-list responses discussion thread replies reader-reactions", inner)

    def before() -> list[str]:
        return [
            f"<nav><ul>{links(r.randint(3, 9))}</ul></nav>",
            named("div", "menu navbar top-nav navigation", links(r.randint(3, 8), "span")),
            f"<header>{wrapped(f'<h1>{words(1, 3)}</h1><p>{words(3, 8)}</p>', 1)}</header>",
            named("div", "header masthead site-header", f'<a href="/">{words(1, 2)}</a> {words(2, 5)}'),
            named("div", "ad ads advert banner sponsor", wrapped(f"<p>{prose(1, 2)}</p>", 2)),
            named("div", "cookie-notice notice consent alert", f"<p>{prose(1, 2)}</p><button>{words(1, 1)}</button>"),
            f'<form action="/s"><label>{words(1, 2)}</label><input name="q"><button>{words(1, 1)}</button></form>',
            f'<ul class="breadcrumb">{links(3)}</ul>',
            wrapped(f"<ul>{links(r.randint(3, 7))}</ul>", 2),
        ]

    def after() -> list[str]:
        return [
            f"<footer>{wrapped(f'<p>{prose(1, 2)}</p>', 1)}</footer>",
            f"<footer>{words(1, 2)} {r.choice(['|', '-', '/'])} {prose(1, 3)}</footer>",
            f'<div id="footer" class="footer">{words(3, 9)} {links(3, "span")}</div>',
            f"<aside><h3>{words(1, 3)}</h3><ul>{links(r.randint(3, 6))}</ul></aside>",
            named("div", "sidebar side-bar right-rail", f"<p>{prose(1, 3)}</p>{links(4, 'p')}"),
            comments(),
            comments(),
            named("div", "related share social newsletter subscribe", f"<p>{words(2, 9)}</p><ul>{links(4)}</ul>"),
            f'<form class="newsletter"><p>{prose(1, 1)}</p><input type="email"></form>',
            named("div", "ad advert promo sponsored", prose(1, 2)),
            f"<{(k := r.choice(['div', 'p', 'footer', 'address']))}>{r.choice(['©', 'Copyright', 'Copyright ©', '(c)'])} {r.randint(1998, 2026)} {words(1, 3).title()}{r.choice(['', '.', ' Inc.', '. All rights reserved.'])}</{k}>",
        ]

    def bare(inner: str) -> str:
        """Without names, and with no other element than div for parts of the page."""
        inner = re.sub(r' (?:class|id|role)="[^"]*"', "", inner)
        return re.sub(r"(</?)(?:article|main|section|header|footer|nav|aside)(?=[ >])", r"\1div", inner)

    pages = []
    for i in range(n):
        first = [b for b in before() if r.random() < 0.4]
        last = [b for b in after() if r.random() < 0.35]
        r.shuffle(first)
        r.shuffle(last)
        inner = "".join([*first, article(), *last])
        if r.random() < 0.07:
            inner = bare(inner)
        if r.random() < 0.1:  # the whole page in one form
            inner = f'<form {r.choice(["", "id=aspnetForm ", "name=main "])}method="post" action="./">{inner}</form>'
        if r.random() < 0.3:
            inner = f'<div id="{r.choice(["page", "wrapper", "container"])}">{inner}</div>'
        pages.append(f"<!DOCTYPE html><html><head><title>{words(2, 7)}</title><style>p{{}}</style></head><body><script>if (a < b) document.write('<p>');</script><!-- {i} -->{inner}</body></html>")
    return pages


def extract_text(pages: DataFrame, model: TreeModel | None = None, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """id, the carried columns, text (empty if there is none), n_chars (its code points)."""
    model = model or fit_tree_model(labelled_pages())
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kept = [id_col, *carry]
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept) + ", text string, n_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = shared.value.extract
        for batch in batches:
            texts = [extract(h.as_py() or "") for h in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*kept, "text", "n_chars"])

    return pages.select(*kept, F.col(html_col)).mapInArrow(run, schema)
