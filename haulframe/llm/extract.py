"""Main text of a page by minimum-cut labelling of its blocks.

A page is cut into text blocks at block tags.  A linear classifier over the place of a
block in the page (containers, class and id words) and its text (length, links,
sentences) gives a cost for calling it content or boilerplate: the capacities of its
edges to the two terminals.  Blocks that follow each other, the more the more ancestors
they share, and next siblings are joined by smoothness edges.  The minimum cut of that
graph, found by maximum flow, separates content from the rest.  Blocks whose own cost
outweighs all their edges are settled beforehand, which leaves the cut the same and the
flow small.

A class, id or role that announces boilerplate costs the blocks below the more, the shorter
or the more linked they are: long sentences outweigh one such name, and within an article it
takes back what the article gives.  It is not held against an article or main (but against
an article in an article: a comment), nor against a container of the main text: one that
holds a main, an article in no other and without such a name, or most of the page's text
while no such article or main stands elsewhere.  A form is boilerplate but for the same
containers, whatever its text.  Links weigh less within an article or main, where a list of
them may belong to the text.

A null or empty page has an empty text.  A page of any length is parsed whole; an unclosed
script, style, textarea, title or comment reaches to its end, of any other element without
text of the page (``PLAIN``, ``NESTED``) that is not closed the tag alone is left out.  A
block that weighs nothing either way is boilerplate.  Repeated rows each get their row, an
empty table gives an empty table.
Further columns are kept, but for those that bear the name of an output column.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Elements whose content is never text of the page.  The first reach to their
# end tag or the end of the page; the next hold no tags; the last may hold their like.
WHOLE = "script|style|textarea|title"
PLAIN = "noscript|iframe"
NESTED = "template|svg|object|math|canvas|audio|video"
# Elements whose end tag also ends what was left open inside.
ENDING = "article|main|body"
# Elements inside a line of text; all others begin and end a block.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr img br picture source "
    "input".split())
# Elements without an end tag.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Elements that hold no main text wherever they stand.
BOILER_TAGS = set(
    "nav footer aside button select menu dialog head option fieldset legend datalist "
    "output progress meter".split())
CONTENT_TAGS = {"article", "main"}
# Elements that hold no main text unless they hold that of the page.
WRAPPING_TAGS = {"form"}
# Words in a class, id or role that announce boilerplate or content.
BOILER_WORDS = set(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored promo promos "
    "promotion banner cookie cookies consent gdpr notice notices notification alert newsletter "
    "subscribe subscription signup signin login register sidebar aside widget widgets related "
    "recommended recommendations share sharing social menu nav navbar navigation breadcrumb "
    "breadcrumbs pagination pager paging footer comment comments reply replies respond disqus "
    "copyright popup modal overlay toolbar tags tagcloud masthead outbrain taboola search "
    "complementary contentinfo skip toc rating ratings feedback disclaimer legal form "
    "reader readers discussion teaser teasers".split())
CONTENT_WORDS = set(
    "article content post entry story text body main maincontent articlebody postcontent "
    "entrycontent storybody".split())

_E = r"(?=[\s/>])"  # after the name of a tag
_REST = r"((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)"  # a quote opens a value after = only
_PLAIN = (rf"<(?P<plain>{PLAIN}){_E}[^>]*>(?:[^<]++|<(?!/?(?P=plain){_E}|/(?:{ENDING}){_E}))*+"
          rf"</(?P=plain){_E}[^>]*>")
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<whole>{WHOLE}){_E}[^>]*>.*?(?:</(?P=whole){_E}[^>]*>|\Z)"
    rf"|{_PLAIN}|(?P<nested></?(?:{NESTED}|{PLAIN}){_E}{_REST}>)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)"
    r"(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<text>[^<]+)|<",
    re.S | re.I)
_NEST = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<whole>{WHOLE}){_E}[^>]*(?<!/)>.*?</(?P=whole){_E}[^>]*>"
    rf"|{_PLAIN}|<(?P<end>/?)(?P<tag>{NESTED}|{ENDING}){_E}{_REST}>", re.S | re.I)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:\s|["'])(?:hidden(?=[\s=/]|$)|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
# names that tell what a page has or is filed under, not what the element is
_JOINED = re.compile(r"(?:(?<![^\W_])(?i:has|with|without|no|category|tag)[-_]|"
                     r"(?<![^\W_])(?:has|with|without|no|category|tag)(?=[A-Z])).*")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STOP = re.compile(r"[.!?…。](?:[\"'”’)]*)(?:\s|$)")

#: Costs: positive for content, negative for boilerplate.
IN_CONTENT, IN_BOILER, WORD_CONTENT, WORD_BOILER = 4.0, -8.0, 1.0, -8.0
#: Taken off the cost of a word for each of a block's words outside links, if it has a sentence.
PER_NAMED_WORD = 0.16
#: Share of the page's text that makes a container that of the main text, and inside content.
MOST, MOST_INSIDE = 0.5, 0.75
PAGE_HEADER, LINKS, PER_WORD, MOST_WORDS = -6.0, -5.0, 0.05, 40
#: Links within an article or main: a list of links there may belong to it.
LINKS_INSIDE = -2.5
SENTENCE, HEADING, LIST_ITEM, START = 0.6, 0.3, -0.3, -0.6
#: Smoothness of blocks that follow each other (times the ancestors shared) and of siblings.
NEXT, SIBLING = 1.0, 0.4


@dataclass
class Block:
    """A run of text with its place in the page."""

    text: str
    tag: str
    path: tuple[int, ...]
    place: float
    linked: int
    inside: bool = False
    marked: tuple[int, ...] = ()
    named: int = 0

    def cost(self) -> float:
        """Evidence for content (positive) or boilerplate (negative)."""
        words = self.text.count(" ") + 1
        out = START + self.place + PER_WORD * min(words, MOST_WORDS)
        out += (LINKS_INSIDE if self.inside and not self.named else LINKS) * self.linked / max(
            len(self.text), 1)
        sentence = _STOP.search(self.text) is not None
        if sentence:
            out += SENTENCE
        if self.named:
            out += WORD_BOILER * self.named
            if sentence:
                plain = 1 - min(self.linked / max(len(self.text), 1), 1)
                out += PER_NAMED_WORD * min(words, MOST_WORDS) * plain
        if len(self.tag) == 2 and self.tag[0] == "h" and self.tag[1].isdigit():
            out += HEADING
        elif self.tag in ("li", "td", "th", "dt", "dd"):
            out += LIST_ITEM
        return out


def _names(attributes: str) -> set[str]:
    """Words of the class, id and role."""
    return {p.lower() for a in _ATTRIBUTE.findall(attributes) for name in "".join(a).split()
            for p in _PART.findall(_JOINED.sub("", name))}


def _place(tag: str, attributes: str, above: float, in_content: bool) -> tuple[float, bool]:
    """Evidence of the containers down to this one, and whether content was opened."""
    own = above
    if tag in BOILER_TAGS or (attributes and _HIDDEN.search(attributes)):
        own += IN_BOILER
    elif tag == "header" and not in_content:
        own += PAGE_HEADER
    elif tag in CONTENT_TAGS and not in_content:
        own += IN_CONTENT
        in_content = True
    return own, in_content


@dataclass
class Named:
    """An element whose names announce boilerplate, or that is a form."""

    inside: bool
    content_word: bool
    wraps: bool = False
    holds_content: bool = False


def weigh_names(blocks: list[Block], named: dict[int, Named], contents: int) -> None:
    """Count the names against the blocks, but those of containers of the main text.

    ``contents`` is the number of articles and mains without such a name.
    """
    # text of elements that are boilerplate by their tag is not of the page here
    plain = [max(len(b.text) - b.linked, 0) if b.place > PAGE_HEADER / 2 else 0 for b in blocks]
    total, held = sum(plain), dict.fromkeys(named, 0)
    for block, size in zip(blocks, plain):
        for i in block.marked:
            held[i] += size
    spared = {i for i, x in named.items() if x.holds_content or (
        held[i] > MOST_INSIDE * total if x.inside else not contents and held[i] > MOST * total)}
    for block in blocks:
        against = [named[i] for i in block.marked if i not in spared]
        block.named = sum(not x.wraps for x in against)
        block.place += IN_BOILER * (len(against) - block.named)
        block.place += WORD_CONTENT * sum(
            named[i].content_word for i in block.marked if i in spared)
        if block.named and block.inside:
            block.place -= IN_CONTENT


def closed_elements(page: str) -> dict[int, int]:
    """Start and end in the page of each closed element of ``NESTED``."""
    ends: dict[int, int] = {}
    opened: list[tuple[str, int]] = []
    count: dict[str, int] = {}
    for token in _NEST.finditer(page):
        if not token["tag"]:
            continue
        tag = token["tag"].lower()
        if not token["end"]:
            if tag in ("svg", "math") and token[0].endswith("/>"):
                ends[token.start()] = token.end()  # empty
            else:
                opened.append((tag, token.start()))
                count[tag] = count.get(tag, 0) + 1
        elif count.get(tag):
            while True:
                name, start = opened.pop()
                count[name] -= 1
                if name == tag:
                    break
            ends[start] = token.end()
    return ends


def page_blocks(page: str) -> list[Block]:
    """Text blocks of a page in order; white space inside is one space."""
    blocks: list[Block] = []
    named: dict[int, Named] = {}
    # open elements: tag, number, evidence, whether inside content
    stack: list[tuple[str, int, float, bool]] = [("", 0, 0.0, False)]
    pieces: list[str] = []
    number, linked, links, contents = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                own = [s for s in stack if s[0] not in INLINE]
                blocks.append(Block(text, own[-1][0], tuple(s[1] for s in own),
                                    stack[-1][2], linked, stack[-1][3],
                                    tuple(s[1] for s in stack if s[1] in named)))
            pieces.clear()
        linked = 0

    def close(at: int) -> None:
        nonlocal links
        links -= sum(s[0] == "a" for s in stack[at:])
        del stack[at:]

    closed: dict[int, int] | None = None
    at = 0
    while at < len(page):
        token = _TOKEN.match(page, at)
        at = token.end()
        if token["nested"]:
            if closed is None:
                closed = closed_elements(page)
            at = closed.get(token.start(), at)
            continue
        end, tag, attributes, text = token.group("end", "tag", "attributes", "text")
        if text is not None or (tag is None and token[0] == "<"):
            piece = text or "<"
            if "&" in piece:
                piece = html.unescape(piece)
            pieces.append(piece)
            if links:
                linked += len(piece.strip())
            continue
        if tag is None:  # a comment, a declaration or a raw element
            continue
        tag = tag.lower()
        inline = tag in INLINE
        if tag == "br":
            pieces.append(" ")
            continue
        if not inline:
            flush()
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if inline and stack[i][0] not in INLINE:
                    break  # an inline end tag does not close a block
            continue
        if tag in VOID:
            continue
        if not inline:
            # a paragraph ends where another block begins; an item where the next begins
            for i in range(len(stack) - 1, 0, -1):
                open_tag = stack[i][0]
                if open_tag == "p" or (open_tag == tag and tag in ("li", "dt", "dd", "option")):
                    close(i)
                    break
                if open_tag not in INLINE:
                    break
        number += 1
        place, content = _place(tag, attributes, stack[-1][2], stack[-1][3])
        boiler, within = False, tag == "article" and any(s[0] == tag for s in stack)
        if attributes and tag not in ("html", "body"):
            words = _names(attributes)
            boiler, content_word = bool(words & BOILER_WORDS), bool(words & CONTENT_WORDS)
            if boiler and (tag not in CONTENT_TAGS or within) and tag not in WRAPPING_TAGS:
                named[number] = Named(stack[-1][3], content_word)
            elif content_word:
                place += WORD_CONTENT
        if tag in WRAPPING_TAGS:
            named[number] = Named(stack[-1][3], False, wraps=True)
        # one inside boilerplate or an article does not show where the main text is
        if tag == "main" or (tag == "article" and not boiler and not within):
            if place > PAGE_HEADER / 2:
                contents += 1
                for s in stack:
                    if s[1] in named:
                        named[s[1]].holds_content = True
        if attributes.endswith("/") and not inline:
            continue
        stack.append((tag, number, place, content))
        links += tag == "a"
    flush()
    if named:
        weigh_names(blocks, named, contents)
    return blocks


def smoothness(blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Weights between blocks: neighbours in page order and next siblings."""
    edges: dict[tuple[int, int], float] = {}
    last_child: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i:
            a, b = blocks[i - 1].path, block.path
            shared = 0
            for x, y in zip(a, b):
                if x != y:
                    break
                shared += 1
            edges[i - 1, i] = NEXT * shared / max(len(a), len(b))
        parent = block.path[-2] if len(block.path) > 1 else 0
        before = last_child.get(parent)
        if before is not None:
            edges[before, i] = edges.get((before, i), 0.0) + SIBLING
        last_child[parent] = i
    return edges


def minimum_cut(cost: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes fall on the content side of the minimum cut (the smallest such side)."""
    n = len(cost)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), weight in edges.items():
        near[i][j] = near[i].get(j, 0.0) + weight
        near[j][i] = near[j].get(i, 0.0) + weight
    cost, label = list(cost), [None] * n
    # a node whose cost outweighs its free edges keeps its sign in every minimum cut
    free = [sum(x.values()) for x in near]
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(cost[i]) > free[i]:
            label[i] = cost[i] > 0
            for j, weight in near[i].items():
                if label[j] is None:
                    cost[j] += weight if label[i] else -weight
                    free[j] -= weight
                    queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, _flow_side(rest, cost, near, label)):
            label[i] = side
    return label


def _flow_side(rest, cost, near, label) -> list[bool]:
    """The source side of a maximum flow over the nodes that are not settled."""
    index = {i: k for k, i in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    room: list[dict[int, float]] = [{} for _ in range(len(rest) + 2)]

    def edge(a: int, b: int, forth: float, back: float) -> None:
        room[a][b] = room[a].get(b, 0.0) + forth
        room[b][a] = room[b].get(a, 0.0) + back

    for i in rest:
        if cost[i] > 0:
            edge(source, index[i], cost[i], 0.0)
        elif cost[i] < 0:
            edge(index[i], sink, -cost[i], 0.0)
        for j, weight in near[i].items():
            if i < j and label[j] is None:
                edge(index[i], index[j], weight, weight)
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for b, left in room[a].items():
                if left > 1e-12 and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if sink not in level:
            return [k in level for k in range(len(rest))]
        following = [iter(list(x)) for x in room]
        path = [source]
        while path:
            a = path[-1]
            if a == sink:
                pushed = min(room[x][y] for x, y in zip(path, path[1:]))
                cut = None
                for k, (x, y) in enumerate(zip(path, path[1:])):
                    room[x][y] -= pushed
                    room[y][x] += pushed
                    if cut is None and room[x][y] <= 1e-12:
                        cut = k
                del path[cut + 1:]
                following[path[-1]] = iter(list(room[path[-1]]))
                continue
            for b in following[a]:
                if room[a][b] > 1e-12 and level.get(b) == level[a] + 1:
                    path.append(b)
                    break
            else:
                level.pop(a)
                path.pop()


def main_text(page: str) -> str:
    """The content blocks of a page, an empty line between them."""
    blocks = page_blocks(page)
    side = minimum_cut([b.cost() for b in blocks], smoothness(blocks))
    return "\n\n".join(b.text for b, content in zip(blocks, side) if content)


def extract(pages: DataFrame, page: str = "html", text: str = "text") -> DataFrame:
    """All rows and columns but the page, with its main text and the text's code points."""
    added = [T.StructField(text, T.StringType()), T.StructField("n_chars", T.LongType())]
    names = {f.name.lower() for f in added} | {page.lower()}
    kept = [f for f in pages.schema.fields if f.name.lower() not in names]
    source = pages.select(*[f"`{f.name}`" for f in kept], F.col(page).alias("__page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column("__page")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=[*(f.name for f in kept), text, "n_chars"])

    return source.mapInArrow(run, T.StructType(kept + added))


def page_report(pages: DataFrame) -> DataFrame:
    """Main text of every page."""
    return extract(pages.select("page_id", "url", "html"))
