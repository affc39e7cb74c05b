"""Main text of web pages by a tree-structured graphical model.

The DOM's block elements form a tree. Each node has a hidden state (set aside, frame, or content). Edge
potentials over (parent's state, state, child's tag) connect parent and child. A node's own potentials are those of
its text and its plain leaves' texts (length, share of links, sentence ends) and of its marks: every class,
id and role name, and the words of compound names. Exact marginals come from sum-product messages, leaves to root and
back; the blocks of nodes whose content marginal is at least one half are the text.

All potentials are pseudo-counts (what is known before any page is seen) plus counts over labelled pages, a
Spark group-by. None is a rule: a name such as side-by-side on a node full of prose is outweighed by the
prose, and a name that no list has (say, one that a site gives its asides) is learned.

Labelled pages: those with an ``article`` or ``main`` element label themselves - a node is content
if it is inside, and neither it nor a node between is a menu, header, footer, sidebar, notice,
advert, form or comment by its tag or by a whole name of its class or id. At most ``sample`` pages (by a
hash of page_id; a bounded sample as documented) are counted, and together they weigh as much as
``STRENGTH`` pages, so that one site's habits don't drown what is known. Every page is scored whole.

Pages without an article or main element have potentials of their own for their root, html and body, so their text can be content there: all of it where no tag and
no name marks any part of the page (a plain text, say), else as their texts and the rest of the tree tell.

Defined results: null or empty html gives an empty text with 0 characters; malformed or cut html
is read as far as it goes (an unfinished tag at the end is dropped); a marginal of exactly one half
counts as content; repeated rows give repeated results; an empty table gives an empty result (the
pseudo-counts alone are the model); extra columns pass. A page is held whole by the task that reads
it, with some 300 bytes for each of its elements, however long it is.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import short_batches

SAMPLE = 2000
STRENGTH = 50

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template noembed noframes xmp".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: What a start tag closes if open (up to the named container).
SIBLINGS = {"body": ({"head"}, {"html"}), "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ROOTS = frozenset({"article", "main"})
TOPS = frozenset({"#root", "html", "body"})
ASIDE_TAGS = frozenset("nav header footer aside form button select dialog menu head object svg canvas audio video".split())
#: Names of class, id or role that often mark what isn't part of an article, and what is (pseudo-counts; labels of training pages).
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs header masthead footer foot "
    "cookie cookies consent notice notices notification alert popup modal overlay newsletter subscribe subscription signup login form search share sharing social related recommended "
    "comment comments commentlist respond reply replies discussion disqus widget toolbar pagination pager skip legal copyright".split()
)
ARTICLE_WORDS = frozenset("article content post entry story main body text".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[/!?a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")
DIGITS = re.compile(r"[0-9]+")
SENTENCE_END = re.compile(r"[.!?…。](?:\s|$)")


class Node:
    __slots__ = ("tag", "parent", "names", "shut", "root", "lone", "chars", "linked", "ends", "blocks")

    def __init__(self, tag: str, parent: int, names: tuple[str, ...], above: Node | None):
        self.tag, self.parent, self.names = tag, parent, names
        #: for labels only: it or a node above is set aside by its tag or a whole name
        self.shut = tag in ASIDE_TAGS or not ASIDE_WORDS.isdisjoint(names) or (above is not None and above.shut)
        #: for labels only: an article or main element that isn't inside such a part
        self.root = tag in ROOTS and not self.shut
        #: of the root, html and body: "" on pages with an article or main element, "open" on other pages, "bare" where nothing marks any part
        self.lone = ""
        self.chars = self.linked = self.ends = self.blocks = 0


def names_in(attributes: str) -> tuple[str, ...]:
    """Distinct names of class, id and role in order; names such as has-sidebar or no-menu only qualify the node."""
    names = " ".join(x[0] or x[1] or x[2] for x in ATTRIBUTE.findall(attributes)).lower().split()
    return tuple(dict.fromkeys(DIGITS.sub("0", n) for n in names if not n.startswith(("has-", "with-", "no-", "without-"))))


def parse_page(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes in document order (parents first), and the blocks (node, text) in page order."""
    nodes = [Node("#root", -1, (), None)]
    stack, pieces, blocks, links = [0], [], [], 0
    raw_until: str | None = None

    def end_block() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                blocks.append((stack[-1], text))
                nodes[stack[-1]].chars += len(text)
                nodes[stack[-1]].ends += len(SENTENCE_END.findall(text))
                nodes[stack[-1]].blocks += 1

    def close(wanted: frozenset | set, within: frozenset | set) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[k]].tag
            if tag in wanted:
                end_block()
                del stack[k:]
                return
            if tag in within:
                return

    at = 0
    while at < len(page):
        if raw_until:
            m = re.compile(rf"</{raw_until}\s*>", re.I).search(page, at)
            at, raw_until = (m.end() if m else len(page)), None
            continue
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if len(piece) == 1 or not (piece[0] == "<" and (piece[1] in "!?/" or piece[1].isalpha())):
                text = _html.unescape(piece) if "&" in piece else piece
                pieces.append(text)
                if links:
                    nodes[stack[-1]].linked += len(text.strip())
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
            elif tag == "a":
                links = 0 if m[1] else 1
            continue
        if m[1]:
            if tag == "p" and not any(nodes[k].tag == "p" for k in stack):
                end_block()
            else:
                close({tag}, frozenset())
            links = 0
            continue
        if tag in RAW:
            end_block()
            raw_until = None if m[3].endswith("/") and tag not in ("script", "style", "title") else tag
            continue
        end_block()
        links = 0
        if tag in CLOSES_P:
            close({"p"}, {"td", "th", "button", "object"})
        if tag in SIBLINGS:
            close(*SIBLINGS[tag])
        if tag in VOID:
            continue
        nodes.append(Node(tag, stack[-1], names_in(m[3]) if "=" in m[3] and tag not in ("html", "body") else (), nodes[stack[-1]]))
        stack.append(len(nodes) - 1)
    end_block()
    gather_texts(nodes)
    if not any(n.tag in ROOTS for n in nodes):
        kind = "open" if any(n.names or n.tag in ASIDE_TAGS and n.tag != "head" for n in nodes) else "bare"
        for n in nodes:
            if n.tag in TOPS:
                n.lone = kind
    return nodes, blocks


def gather_texts(nodes: list[Node]) -> None:
    """A plain leaf's text counts as its parent's: many leaves are one piece of evidence, not many."""
    inner = {n.parent for n in nodes}
    for i, n in enumerate(nodes[1:], 1):
        if i not in inner and not n.names and n.tag not in ASIDE_TAGS and n.tag not in ROOTS:
            above = nodes[n.parent]
            above.chars, above.linked, above.ends, above.blocks = above.chars + n.chars, above.linked + n.linked, above.ends + n.ends, above.blocks + n.blocks
            n.chars = n.linked = n.ends = n.blocks = 0


#: Hidden states: set aside (and what is inside), neutral frame around both, content.
ASIDE, FRAME, CONTENT = STATES = (0, 1, 2)


def labels_of(nodes: list[Node]) -> list[int] | None:
    """States of the nodes of a page that has an article or main element, else None."""
    if not any(n.root for n in nodes):
        return None
    state = [FRAME] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        if n.shut:
            state[i] = ASIDE
        elif state[n.parent] == CONTENT or n.root:
            state[i] = CONTENT
    return state


def evidence_of(n: Node) -> str:
    """What an edge's potential depends on: the child's tag, apart for plain and named elements of no fixed meaning."""
    return n.tag + "*" if n.names and n.tag not in ASIDE_TAGS and n.tag not in ROOTS else n.tag + n.lone


def marks_of(n: Node) -> list[str]:
    """Marks of a node: its names, and the distinct words of its compound names."""
    out = [f"name={x}" for x in n.names]
    if any(not x.isalpha() for x in n.names):
        out += sorted({f"word={w}" for x in n.names if not x.isalpha() for w in WORD.findall(x)})
    return out


def features_of(n: Node) -> list[str]:
    """Observed features of a node's text, one of each kind."""
    if not n.blocks:
        return []
    ends = 0 if not n.ends else 1 if n.ends * 400 < n.chars else 2
    return [f"length={min(4, int(math.log10(n.chars + 1) * 2))}", f"links={min(3, int(4 * n.linked / max(1, n.chars)))}", f"ends={ends}"]


#: Pseudo-counts (set aside, frame, content): what is known before any page is seen (fixed values).
PRIOR = {
    "links=0": (20.0, 5.0, 25.0), "links=1": (6.0, 5.0, 6.0), "links=2": (8.0, 5.0, 4.0), "links=3": (30.0, 5.0, 5.0),
    "length=0": (5.0, 5.0, 3.0), "length=1": (5.0, 5.0, 3.0), "length=2": (5.0, 5.0, 4.0), "length=3": (5.0, 1.0, 6.0), "length=4": (3.0, 0.1, 12.0),
    "ends=0": (20.0, 10.0, 12.0), "ends=1": (5.0, 1.0, 8.0), "ends=2": (10.0, 1.0, 20.0),
}
KINDS = ("length", "links", "ends")
#: Pseudo-counts of a node's state by a mark that a list has: as a whole name and as a word of a compound name.
MARK_PRIOR = {
    "name": {"aside": (60.0, 0.2, 0.2), "article": (0.5, 20.0, 40.0)},
    "word": {"aside": (50.0, 1.0, 1.0), "article": (1.0, 4.0, 4.0)},
}
#: The counter of the labelled pages themselves.
PAGES = "pages"
NEUTRAL = (1.0, 1.0, 1.0)
#: Pseudo-counts of a node's state by its tag ("" stands for every other tag) and its parent's state ("*": any named one).
EDGE_PRIOR = {
    "": {ASIDE: (40.0, 0.02, 0.02), FRAME: (0.5, 6.0, 2.0), CONTENT: (0.4, 0.02, 40.0)},
    "article": {ASIDE: (20.0, 0.1, 0.1), FRAME: (0.1, 1.0, 20.0), CONTENT: (0.2, 0.02, 20.0)},
}
EDGE_PRIOR |= {tag: {ASIDE: (40.0, 0.02, 0.02), FRAME: (40.0, 0.1, 0.02), CONTENT: (40.0, 0.02, 0.1)} for tag in ASIDE_TAGS}
EDGE_PRIOR |= {tag: EDGE_PRIOR[""] | {FRAME: (0.05, 20.0, 0.5)} for tag in ("html", "body")}
EDGE_PRIOR |= {tag + kind: EDGE_PRIOR[""] | {FRAME: (0.05, 20.0, 4.0)} for tag in ("html", "body") for kind in ("open", "bare")}
#: Pseudo-counts of the root's state by the kind of its page (see ``Node.lone``).
ROOT_PRIOR = {"": (0.0, 1.0, 0.0), "open": (0.0, 15.0, 1.0), "bare": (0.0, 0.2, 20.0)}
EDGE_PRIOR |= {"main": EDGE_PRIOR["article"], "*": {ASIDE: (40.0, 0.02, 0.02), FRAME: (0.8, 6.0, 3.0), CONTENT: (8.0, 0.02, 40.0)}}
#: The features of one text depend on each other, so that their sum counts less.
TEXT_WEIGHT = 0.75


def log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


class TreeModel:
    """Log-potentials from counts {(feature, mark or 'edge:<parent state>:<tag>', state): n} over ``pages`` pages."""

    def __init__(self, counts: dict[tuple[str, int], float], pages: int = 0):
        weight = min(1.0, STRENGTH / pages) if pages else 1.0
        counts = {k: n * weight for k, n in counts.items()}
        self.node: dict[str, tuple[float, ...]] = {}
        for kind in KINDS:
            names = [x for x in PRIOR if x.startswith(f"{kind}=")]
            total = [sum(PRIOR[x][s] + counts.get((x, s), 0) for x in names) for s in STATES]
            for x in names:
                self.node[x] = tuple(math.log((PRIOR[x][s] + counts.get((x, s), 0)) / total[s]) for s in STATES)
        self.mark: dict[str, tuple[float, ...]] = {}
        listed = {f"{kind}={w}": MARK_PRIOR[kind][which] for kind in MARK_PRIOR for which, words in (("article", ARTICLE_WORDS), ("aside", ASIDE_WORDS)) for w in words}
        for mark in listed.keys() | {x for x, _ in counts if x.startswith(("name=", "word="))}:
            n = [listed.get(mark, NEUTRAL)[s] + counts.get((mark, s), 0) for s in STATES]
            self.mark[mark] = tuple(math.log(x / sum(n)) for x in n)
        self.edge: dict[tuple[int, str], tuple[float, ...]] = {}
        for p in STATES:
            for tag in {x.split(":", 2)[2] for x, _ in counts if x.startswith("edge:")} | set(EDGE_PRIOR):
                prior = EDGE_PRIOR.get(tag, EDGE_PRIOR["*" if tag.endswith("*") else ""])[p]
                n = [prior[s] + counts.get((f"edge:{p}:{tag}", s), 0) for s in STATES]
                self.edge[p, tag] = tuple(math.log(x / sum(n)) for x in n)

    def edge_of(self, p: int, n: Node) -> tuple[float, ...]:
        tag = evidence_of(n)
        return self.edge.get((p, tag)) or self.edge[p, "*" if tag.endswith("*") else ""]

    def own(self, n: Node) -> list[float]:
        """Log-potential of a node's own text and marks for every state."""
        text = [self.node[f] for f in features_of(n)]
        marks = [m for m in map(self.mark.get, marks_of(n)) if m] if n.names else ()
        return [TEXT_WEIGHT * sum(f[s] for f in text) + sum(m[s] for m in marks) for s in STATES]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Exact P(content) of every node: messages upward, then downward. The root of a page with an article is frame."""
        n = len(nodes)
        up = [self.own(x) for x in nodes]
        message: list[list[float]] = [[0.0, 0.0, 0.0]] * n
        for i in range(n - 1, 0, -1):
            x, mine = nodes[i], up[i]
            sent = [log_sum([e[s] + mine[s] for s in STATES]) for e in (self.edge_of(p, x) for p in STATES)]
            message[i] = sent
            above = up[x.parent]
            for p in STATES:
                above[p] += sent[p]
        root = [w * math.exp(u - max(up[0])) for w, u in zip(ROOT_PRIOR[nodes[0].lone], up[0])]
        total = sum(root)
        belief = [[w / total for w in root]] if total else [[0.0, 0.0, 1.0]]
        for i in range(1, n):
            x, q = nodes[i], [0.0, 0.0, 0.0]
            for p in STATES:
                weight = belief[x.parent][p]
                if weight > 0:
                    e = self.edge_of(p, x)
                    for s in STATES:
                        q[s] += weight * math.exp(e[s] + up[i][s] - message[i][p])
            belief.append(q)
        return [b[CONTENT] for b in belief]

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        nodes, blocks = parse_page(page)
        content = self.marginals(nodes)
        return "\n".join(text for k, text in blocks if content[k] >= 0.5)


def page_counts(page: str | None) -> Counter:
    """Feature and edge counts of a page that labels itself."""
    out: Counter = Counter()
    nodes = parse_page(page)[0] if page else []
    states = labels_of(nodes) if nodes else None
    if states:
        for x, s in list(zip(nodes, states))[1:]:
            if not evidence_of(x).endswith("*"):  # what a named element is, its names tell
                out[f"edge:{states[x.parent]}:{evidence_of(x)}", s] += 1
            out.update((f, s) for f in features_of(x))
            out.update((m, s) for m in marks_of(x))
        out[PAGES, FRAME] += 1
    return out


def train(pages: DataFrame, sample: int = SAMPLE, key: str = "page_id", html: str = "html") -> TreeModel:
    """Count potentials over a bounded sample of labelled pages, as a Spark aggregation."""
    chosen = pages.select(F.col(key).alias("k")).where("k is not null").distinct().orderBy(F.xxhash64("k"), "k").limit(sample)
    some = pages.select(F.col(key).alias("k"), F.col(html).alias("h")).join(F.broadcast(chosen), "k", "left_semi").select("h")

    def count(batches):
        for batch in batches:
            total: Counter = Counter()
            for page in batch.column(0).to_pylist():
                total.update(page_counts(page))
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int32()), pa.array(list(total.values()), pa.int64())], names=["feature", "state", "n"])

    rows = some.mapInArrow(count, "feature string, state int, n long").groupBy("feature", "state").agg(F.sum("n").alias("n")).collect()
    counts = {(r["feature"], r["state"]): r["n"] for r in rows}
    return TreeModel(counts, counts.pop((PAGES, FRAME), 0))


def extract_text(pages: DataFrame, model: TreeModel | None = None, key: str = "page_id", html: str = "html", name: str = "main_text") -> DataFrame:
    """``pages`` with the column ``name``: the main text of the whole html."""
    pages = short_batches(pages)
    model = model or train(pages, key=key, html=html)

    @F.arrow_udf("string")
    def text_of(htmls: pa.Array) -> pa.Array:
        return pa.array([model.extract(x) for x in htmls.to_pylist()], pa.string())

    return pages.withColumn(name, text_of(F.col(html)))
