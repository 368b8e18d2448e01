"""Main text of web pages by composite text density.

Every block element of a page has a density: its characters per tag, weighted by a logarithm that
falls as links take up more of its characters and tags, compared with the whole body. The sum of its
children's densities is highest for the element that holds the paragraphs. From there the choice goes
up towards the body, not beyond an ``article`` or ``main``, as long as the parent has another child at
least as dense as the thinnest element on the path to the body: that child is part of the text too.
The whole subtree is taken, so short paragraphs and headings stay.

Before that, what never belongs to an article is left out by its element or role: menus, headers,
footers, sidebars, scripts, styles. A class or id that is the name of such a part (adverts, notices, reader comments), alone
or with words for its place and shape, takes the element out unless it holds all text; a form, or a name with such a word
among others, unless it holds half of the text and no ``article`` or ``main`` is beside it. Names of states
(``has-sidebar``, ``no-comments``) tell nothing. Headings in the header of an article stay. Articles beside each other are
one text.

Unclosed and wrongly nested tags are read as browsers do where it matters for blocks: a block closes
an open paragraph, a list item the one before. Null and empty pages, and pages without text, give the
empty text. Texts of any length are taken whole in one pass. A null id or address stays null, repeated
rows are rows of their own, other columns (whatever their names) are left out, and an empty table
gives no rows.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import table
from .common import map_text, text_of

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template iframe object svg title textarea xmp noembed noframes".split())
APART = frozenset("nav footer aside button select menu dialog head".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary alert alertdialog dialog menu menubar".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header menu nav navbar navigation "
    "newsletter notice promo promotion related replies share sharing sidebar social sponsor sponsored subscribe".split()
)
#: a name with one of these tells what the page shows or hides elsewhere, not what the element is
STATES = frozenset("no not has have is with without show shows hide hides enabled disabled enable disable open opened closed on off active inactive visible collapsed expanded sticky allow allowed ready loaded".split())
#: what stands behind, or before, a mark in the name of the marked element itself
BEHIND = frozenset("area bar block body bottom box btn button buttons column container content footer form group header holder inner item items left link links list main outer panel right row section slot text thread title top unit widget wrap wrapper".split())
BEFORE = frozenset("bottom global left main mobile page primary right secondary site top user reader".split())
WHOLE = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
IN_HEAD = frozenset("title meta link base style script noscript template".split())
#: an element that closes an open one of the same set, up to the nearest of the second set
AGAIN = {name: (frozenset(group.split()), frozenset(within.split())) for group, within in (("li", "ul ol"), ("dt dd", "dl"), ("td th", "tr table"), ("tr", "table"), ("option", "select")) for name in group.split()}
PARAGRAPH = frozenset(("p",)), frozenset(("table", "td", "th", "button"))

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[\"'>]")
COMMENT_END = re.compile(r"--!?>")
TOLD = re.compile(r"class|id|role|hidden", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*("[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'>][^\s>]*))?""")
PARTS = re.compile(r"[^a-z0-9]+")
SIZE = re.compile(r"[0-9x]+")

#: how an element is told from the article: always, unless it holds all text, unless it holds most of it
PLAIN, ALWAYS, MARKED, MAYBE = range(4)


def mark_of(names: str) -> int:
    """What a class or id tells: MARKED where a name is a mark, alone or with words for its place or
    shape, MAYBE where it has a mark among other words, PLAIN for names of states and all others."""
    found = PLAIN
    for token in names.lower().split():
        parts = [p for p in PARTS.split(token) if p]
        if MARKS.isdisjoint(parts) or not STATES.isdisjoint(parts):
            continue
        first = next(k for k, p in enumerate(parts) if p in MARKS)
        own = all(p in BEFORE for p in parts[:first]) and all(p in MARKS or p in BEHIND or SIZE.fullmatch(p) for p in parts[first:])
        if own:
            return MARKED
        found = MAYBE
    return found


def told(name: str, attributes: str) -> int:
    """How an element is told from the article by its name, role, class and id."""
    if name in APART:
        return ALWAYS
    found = MAYBE if name == "form" else PLAIN
    if not attributes or name in WHOLE or name in ("html", "body") or not TOLD.search(attributes):
        return found
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "role" and value.strip().lower() in ROLES:
            return ALWAYS
        if key == "role" and value.strip().lower() in ("form", "search"):
            found = found or MAYBE
        elif key in ("class", "id") and (mark := mark_of(value)):
            found = MARKED if MARKED in (mark, found) else MAYBE
    return found


class Tags:
    """Tags of a page in order. A quoted value may hold ``>``; where quotes do not close, a tag ends at
    the first ``>``. Whatever the page holds, the work is in proportion to its length: the next ``>`` and
    the first stop behind a name are kept until passed, and a quote from which no end was found is
    remembered, as every walk that opens it goes on alike."""

    def __init__(self, page: str):
        self.page, self.size = page, len(page)
        self.after = self.stop = -1
        self.lost: set[int] = set()

    def next_end(self, at: int) -> int:
        if self.after < at:
            found = self.page.find(">", at)
            self.after = found if found >= 0 else self.size
        return self.after

    def closing(self, at: int) -> int:
        """Place of the first ``>`` outside quotes, -1 if there is none."""
        page, opened = self.page, []
        if self.stop < at:
            found = STOP.search(page, at)
            self.stop = found.start() if found else self.size
        at = self.stop
        while at < self.size and at not in self.lost:
            if page[at] == ">":
                return at
            opened.append(at)
            quote = page.find(page[at], at + 1)
            if quote < 0:
                break
            found = STOP.search(page, quote + 1)
            at = found.start() if found else self.size
        self.lost.update(opened)
        return -1

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """``(start, end, closes, name, attributes)`` of the next tag; comments have no name."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            if page.startswith("!--", at):
                if page.startswith((">", "->"), start + 4):
                    return start, page.index(">", start + 4) + 1, False, "", ""
                found = COMMENT_END.search(page, start + 4)
                return start, found.end() if found else self.size, False, "", ""
            mark = page[at : at + 1]
            if not (mark.isascii() and mark.isalpha() or mark in ("!", "?", "/")) or not mark:
                continue
            end = self.next_end(at)
            if end == self.size:
                return None  # no tag ends any more
            closes = mark == "/"
            name = NAME.match(page, at + closes)
            if not name:
                return start, end + 1, False, "", ""
            close = self.closing(name.end())
            end = close if close >= 0 else self.next_end(name.end())
            return start, end + 1, closes, name[0].lower(), page[name.end() : end]
        return None

    def end_of_raw(self, name: str, at: int) -> int:
        """End of the closing tag of a raw element, or of the page."""
        found = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(self.page, at)
        return min(self.next_end(found.end()) + 1, self.size) if found else self.size


class Tree:
    """Elements of blocks, and those told from the article, in page order: parent, own counts, and the
    pieces of text between them."""

    def __init__(self):
        self.parent, self.name, self.told = [-1], ["#page"], [PLAIN]
        self.chars, self.tags, self.link_chars, self.links = [0], [0], [0], [0]
        self.pieces: list[tuple[int, str]] = []  # block, text: in page order

    def open(self, parent: int, name: str, told: int) -> int:
        for column, value in ((self.parent, parent), (self.name, name), (self.told, told), (self.chars, 0), (self.tags, 0), (self.link_chars, 0), (self.links, 0)):
            column.append(value)
        return len(self.parent) - 1


def read(page: str) -> Tree:
    tree, tags = Tree(), Tags(page)
    stack: list[tuple[str, int, bool]] = [("#page", 0, False)]  # element, block it belongs to, left out
    opened: dict[str, list[int]] = {}  # depths of the open elements of a name
    at = 0

    def say(text: str) -> None:
        _, block, out = stack[-1]
        if not out and text:
            text = html.unescape(text)
            size = len(" ".join(text.split()))
            tree.pieces.append((block, text))
            tree.chars[block] += size
            if opened.get("a"):
                tree.link_chars[block] += size

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop()[0]].pop()

    def deepest(names) -> int:
        return max((opened[x][-1] for x in names if opened.get(x)), default=0)

    def depth_of(names, until) -> int:
        depth = deepest(names)
        return depth if depth > deepest(until) else 0

    while found := tags.next(at):
        start, end, closes, name, attributes = found
        say(page[at:start])
        at = end
        if not name:
            continue
        if closes:
            if opened.get(name):
                close_to(opened[name][-1])
            elif name in ("br", "p"):
                tree.pieces.append((stack[-1][1], " ")) if not stack[-1][2] else None
            continue
        if name not in IN_HEAD and opened.get("head"):
            close_to(opened["head"][-1])
        if name not in INLINE and opened.get("p") and (k := depth_of(*PARAGRAPH)):
            close_to(k)
        if name in AGAIN and (k := depth_of(*AGAIN[name])):
            close_to(k)
        _, block, out = stack[-1]
        mark = told(name, attributes)
        if name == "header":
            mark = ALWAYS
        if out and name in HEADINGS and opened.get("header"):  # an article's own heading stays
            whole = deepest(WHOLE)
            out = not (deepest(APART) < whole < opened["header"][0] and not stack[whole][2])
        out = out or mark == ALWAYS
        if name in RAW and not attributes.rstrip().endswith("/"):
            tree.tags[block] += not out
            at = tags.end_of_raw(name, at)
            continue
        if name in VOID:
            if not out:
                tree.tags[block] += 1
                tree.links[block] += name == "a"
                tree.pieces.append((block, " "))
            continue
        if not out and (name not in INLINE or mark):
            block = tree.open(block, name, mark)
        elif not out:
            tree.tags[block] += 1
            tree.links[block] += name == "a"
        opened.setdefault(name, []).append(len(stack))
        stack.append((name, block, out))
    say(page[at:])
    return tree


def left_out(tree: Tree) -> list[bool]:
    """Blocks that go with all they hold: marked ones unless they hold all text, and those whose name or
    form only may tell them apart unless they hold half of it and no article or main is beside them."""
    n = len(tree.parent)

    def below(own: list[int], out: list[bool]) -> list[int]:
        sums = own.copy()
        for i in range(n - 1, 0, -1):  # children come after their parents
            if not out[i]:
                sums[tree.parent[i]] += sums[i]
        return sums

    out = [False] * n
    if not any(tree.told):
        return out
    every = below(tree.chars, out)
    out = [tree.told[i] == MARKED and every[i] < every[0] for i in range(n)]
    for i in range(1, n):
        out[i] |= out[tree.parent[i]]
    some = below(tree.chars, out)
    whole = [int(tree.name[i] in WHOLE and not out[i] and some[i] > 0) for i in range(n)]
    inside, above = below(whole, [False] * n), [0] * n
    for i in range(1, n):
        above[i] = above[tree.parent[i]] + whole[tree.parent[i]]
        if tree.told[i] == MAYBE and (2 * some[i] < some[0] or inside[0] > inside[i] + above[i]):
            out[i] = True
        out[i] |= out[tree.parent[i]]
    return out


def density(chars: int, tags: int, link_chars: int, links: int, body_share: float) -> float:
    """Characters per tag, weighted by how far from links they are."""
    if not chars:
        return 0.0
    tags, link_chars, links = max(tags, 1), max(link_chars, 1), max(links, 1)
    base = math.log(chars * link_chars / max(chars - link_chars, 1) + body_share * chars + math.e)
    return chars / tags * max(0.0, math.log(max(chars * tags / (link_chars * links), 1e-9))) / math.log(base)


def main_blocks(tree: Tree, out: list[bool]) -> list[int]:
    """The block that holds the text, or the articles beside each other that do."""
    n = len(tree.parent)
    zero = [0] * n
    chars, tags, link_chars, links = ([0 if o else x for o, x in zip(out, column)] for column in (tree.chars, tree.tags, tree.link_chars, tree.links))
    for i in range(n - 1, 0, -1):  # children come after their parents
        if out[i]:
            continue
        p = tree.parent[i]
        chars[p] += chars[i]
        tags[p] += tags[i] + 1
        link_chars[p] += link_chars[i]
        links[p] += links[i] + (tree.name[i] == "a")
    share = link_chars[0] / max(chars[0], 1)
    dense = [density(chars[i], tags[i], link_chars[i], links[i], share) for i in range(n)]
    sums = [0.0] * n
    for i in range(1, n):
        sums[tree.parent[i]] += dense[i]
    best = max(range(n), key=lambda i: (sums[i], -i))
    path, i = [], best
    while i >= 0:
        path.append(i)
        i = tree.parent[i]

    def beside(i: int) -> list[int]:
        if tree.name[i] != "article":
            return [i]
        return [k for k in range(n) if tree.name[k] == "article" and tree.parent[k] == tree.parent[i] and not out[k]]

    below = zero
    below[best] = 1
    held = 0  # characters of the outermost articles below
    outermost = []
    for i in range(best + 1, n):  # articles with most of what was found are the text without its surroundings
        below[i] = below[tree.parent[i]]
        if below[i] == 1 and tree.name[i] in WHOLE and not out[i]:
            below[i] = 2
            outermost.append(i)
            held += chars[i]
    if 2 * held > chars[best]:
        return outermost
    for i in path:  # the innermost article holds the text
        if tree.name[i] in WHOLE:
            return beside(i)
    threshold = min(dense[i] for i in path)
    children: dict[int, list[int]] = {}
    for i in range(1, n):
        children.setdefault(tree.parent[i], []).append(i)
    at = best
    for branch, up in zip(path, path[1:]):
        if any(dense[x] >= threshold and dense[x] > 0 for x in children[up] if x != branch):
            at = up
    return [at]


def main_text(page: str | None) -> str:
    """The main text: blocks in page order, joined by an empty line."""
    if not page:
        return ""
    tree = read(page)
    n, out = len(tree.parent), left_out(tree)
    inside, shown = [False] * n, list(range(n))
    for i in main_blocks(tree, out):
        inside[i] = True
    for i in range(1, n):
        inside[i] = (inside[i] or inside[tree.parent[i]]) and not out[i]
        if tree.name[i] in INLINE:
            shown[i] = shown[tree.parent[i]]
    blocks: list[list[str]] = []
    last = -1
    for block, text in tree.pieces:
        if out[block]:
            continue
        if not inside[block]:
            last = -1
            continue
        if shown[block] != last:
            blocks.append([])
        blocks[-1].append(text)
        last = shown[block]
    return "\n\n".join(t for t in (" ".join("".join(b).split()) for b in blocks) if t)


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(p) for p in text_of(batch.column("html"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return map_text(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"), run, "page_id long, url string, text string, n_chars long")


def op3_page_text(spark, sf):
    return main_texts(table(spark, sf, "pages"))


QUERIES = {"op3_page_text": op3_page_text}
ORACLES = {}
