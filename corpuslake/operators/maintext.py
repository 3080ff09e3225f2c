"""Main text of a page by text and link density over its tree.

The text of a page is dealt to blocks: every piece belongs to the nearest block element around it. A block's net text is its
characters less LINK times those within links; a link list is a loss. Sums go up the tree, and on the way down the set of
subtrees is chosen that has the most net text after a price for each subtree: a subtree is taken whole where that beats the best choice
inside it. Articles cost nothing, so several on a page are all kept; navigation and what is named as such never counts.

Favouring recall (the default) the price is small, so that loose paragraphs beside an article are kept;
favouring precision it is large, and only the main stretches stay. A page without any gain gives all its blocks.
"""

from __future__ import annotations

import re

from corpuslake.functions.dom import Element

#: What a character within a link costs, and the prices of a subtree.
LINK, RECALL, PRECISION = 2.0, 25.0, 150.0
#: A block with a greater share of its characters in links goes, even inside a chosen subtree.
LINKED = 0.67

#: Elements that are never text, block elements, elements that cost nothing, words of class, id or role that mark what is beside the text.
NOISE = frozenset("head title script style noscript template nav footer aside header form iframe svg button select".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr table ul ol dl div section article main body figure figcaption address".split())
FREE = frozenset("article main".split())
BESIDE = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comments cookie cookies footer menu nav navbar navigation newsletter pagination popup promo related share sharing sidebar social sponsored toolbar widget".split())


def squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def is_noise(e: Element) -> bool:
    """Whether an element is never main text: by its tag, or by a whole word of its class, id or role. Articles and bodies are."""
    if e.tag in NOISE or "hidden" in e.attrs:
        return True
    if e.tag in FREE or e.tag in ("body", "html", ""):
        return False
    return any(w in BESIDE for key in ("class", "id", "role") if key in e.attrs for w in re.split(r"[\s_-]+", e.attrs[key].lower()))


class _Node:
    """A block element: its blocks of text and block elements below, in order, and the sums over all of them."""

    __slots__ = ("best", "free", "net", "parent", "parts", "whole")

    def __init__(self, parent: _Node | None, free: bool):
        self.parent, self.free, self.parts = parent, free, []
        self.net = self.best = 0.0
        self.whole = False


class _Text:
    """A block of text: pieces in a row, and the characters of those within links."""

    __slots__ = ("linked", "pieces")

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.linked = 0

    def text(self) -> str:
        return squeezed("".join(self.pieces))


def _tree(page: Element) -> tuple[_Node, list[_Node]]:
    """(the root, all nodes with parents first)."""
    root = _Node(None, False)
    nodes = [root]
    stack: list[tuple[Element | str, _Node, bool]] = [(page, root, False)]
    while stack:
        x, node, linked = stack.pop()
        if isinstance(x, str):
            if not node.parts or not isinstance(node.parts[-1], _Text):
                node.parts.append(_Text())
            node.parts[-1].pieces.append(x)
            if linked:
                node.parts[-1].linked += len(squeezed(x))
        elif x.tag == "br":
            stack.append(("\n", node, linked))
        elif not is_noise(x):
            if x.tag in BLOCKS:
                below = _Node(node, x.tag in FREE)
                node.parts.append(below)
                nodes.append(below)
                node = below
            linked = linked or (x.tag == "a" and "href" in x.attrs)
            stack.extend((c, node, linked) for c in reversed(x.children))
    return root, nodes


def gains(nodes: list[_Node], price: float) -> float:
    """Marks the nodes that are taken whole; the net text of the best choice on the whole page."""
    for node in reversed(nodes):  # sums up
        inside = node.net = 0.0
        for x in node.parts:
            if isinstance(x, _Text):
                net = len(x.text()) - LINK * x.linked
                node.net += net
                inside += max(net - price, 0.0)
            else:
                node.net += x.net
                inside += x.best
        alone = node.net - (0.0 if node.free else price)
        node.whole = alone > 0 and alone >= inside
        node.best = alone if node.whole else inside
    return nodes[0].best


def main_text(page: Element, price: float = RECALL) -> str:
    """The chosen blocks in document order, a blank line between them."""
    root, nodes = _tree(page)
    gain = gains(nodes, price)
    chosen: list[str] = []
    stack: list[tuple[_Node | _Text, bool]] = [(root, gain <= 0)]
    while stack:  # choices down
        x, taken = stack.pop()
        if isinstance(x, _Text):
            said = x.text()
            if said and ((taken and x.linked <= LINKED * len(said)) or (not taken and len(said) - LINK * x.linked > price)):
                chosen.append(said)
        else:
            taken = taken or x.whole
            stack.extend((c, taken) for c in reversed(x.parts))
    if not chosen and gain <= 0:  # nothing but links
        chosen = [t for n in nodes for t in (x.text() for x in n.parts if isinstance(x, _Text)) if t]
    return "\n\n".join(chosen)
