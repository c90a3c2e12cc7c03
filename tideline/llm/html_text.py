"""Main text of web pages by a tree-structured graphical model over DOM blocks.

Every block element is a binary variable (content or not) with a potential from its tag, class words, links and length; parent and
child are tied by a pair potential. Sum-product messages go up and down the tree and give each block's content marginal.
"""

from __future__ import annotations

import html
import itertools
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm.common import slices

#: fixed values: element names of HTML
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = set("head script style title template noscript iframe svg math object select option button textarea datalist canvas audio video map".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: what an opening tag ends: the element, and where the search for it stops
SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_LABEL = re.compile(r'data-y="?(\d)')
_PARTS = re.compile(r"[a-z]+")


@dataclass
class Block:
    """A block element: its parent's number, its tag and name words, its text and how much of that is links."""

    parent: int
    tag: str
    names: tuple[str, ...]
    label: int | None = None
    chars: int = 0
    linked: int = 0


def parse(page: str) -> tuple[list[Block], list[tuple[int, str]]]:
    """Blocks in page order (parents first), and text runs (block, text) in page order with references decoded."""
    nodes = [Block(-1, "#root", ())]
    runs: list[tuple[int, list[str]]] = []
    stack: list[tuple[str, int, bool]] = [("#root", 0, False)]  # element, its block, unseen
    links, at, n = 0, 0, len(page)

    def say(piece: str) -> None:
        _, block, unseen = stack[-1]
        if unseen or not piece:
            return
        piece = html.unescape(piece) if "&" in piece else piece
        if runs and runs[-1][0] == block and runs[-1][1] is not None:
            runs[-1][1].append(piece)
        elif piece.strip():
            runs.append((block, [piece]))
        size = len(piece.strip())
        nodes[block].chars += size
        if links:
            nodes[block].linked += size

    def end_run() -> None:
        if runs and runs[-1][0] != -1:
            runs.append((-1, []))

    def pop_to(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            name, block, _ = stack.pop()
            links -= name == "a"
            if name not in INLINE:
                end_run()

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, rest = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if closing:
            for d in range(len(stack) - 1, 0, -1):
                if stack[d][0] == name:
                    pop_to(d)
                    break
                if name in INLINE and stack[d][0] not in INLINE:
                    break
            continue
        if name in CLOSES_P:
            for d in range(len(stack) - 1, 0, -1):
                if stack[d][0] == "p":
                    pop_to(d)
                    break
                if stack[d][0] not in INLINE:
                    break
        if name in SAME:
            ends, stops = SAME[name]
            for d in range(len(stack) - 1, 0, -1):
                if stack[d][0] in ends:
                    pop_to(d)
                    if name != "tr":
                        break
                elif stack[d][0] in stops:
                    break
        if name in INLINE:
            if name == "br":
                say(" ")
            elif name not in VOID:
                stack.append((name, stack[-1][1], stack[-1][2]))
                links += name == "a"
            continue
        end_run()
        if name in VOID:
            continue
        unseen = stack[-1][2] or name in UNSEEN
        block = stack[-1][1]
        if not unseen:
            words = _PARTS.findall(" ".join(_NAMES.findall(rest)).lower()) if "=" in rest else ()
            label = _LABEL.search(rest) if "data-y" in rest else None
            nodes.append(Block(block, name, tuple(words), int(label[1]) if label else None))
            block = len(nodes) - 1
        if not rest.endswith("/") or name not in UNSEEN:
            stack.append((name, block, unseen))
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            pop_to(len(stack) - 1)
    return nodes, [(b, " ".join("".join(t).split())) for b, t in runs if b >= 0]


def features(node: Block) -> list[str]:
    """Names of a block's features."""
    out = ["tag " + node.tag, *("name " + w for w in set(node.names))]
    if node.chars:
        if node.chars >= 100:
            out.append("long")
        out.append(f"links {min(2, node.linked * 3 // node.chars)}")
    return out


#: elements that mostly share the fate of what holds them, unless they have a name
_PLAIN = set("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd td th tr tbody thead tfoot table caption blockquote pre figure figcaption div section center hgroup details summary".split())


def kind(node: Block) -> int:
    """0 for plain blocks, 1 for those with a name or an element of their own meaning."""
    return int(bool(node.names) or node.tag not in _PLAIN)


@dataclass
class Model:
    """Weights of features for content, and log potentials pair[kind of child][parent state][child state]."""

    weights: dict[str, float]
    pair: list[list[list[float]]]

    def marginals(self, nodes: list[Block]) -> tuple[list[float], list[float]]:
        """P(content) of every block, and of every block and its parent together; exact on a tree: one pass up, one down."""
        w, n = self.weights, len(nodes)
        tables = [tuple(math.exp(x) for row in table for x in row) for table in self.pair]
        ties = [tables[kind(x)] for x in nodes]
        below = [sum([w.get(f, 0.0) for f in features(x)]) for x in nodes]  # log odds of a block and all under it
        below[0] = -30.0  # the page itself is not content
        up = [0.0] * n
        for i in range(n - 1, 0, -1):
            b = math.exp(max(-30.0, min(30.0, below[i])))
            e00, e01, e10, e11 = ties[i]
            up[i] = math.log((e11 * b + e10) / (e01 * b + e00))
            below[nodes[i].parent] += up[i]
        odds, both = [0.0] * n, [0.0] * n
        odds[0] = below[0]
        for i in range(1, n):
            e00, e01, e10, e11 = ties[i]
            rest = odds[nodes[i].parent] - up[i]  # the parent without this child
            r = math.exp(max(-30.0, min(30.0, rest)))
            odds[i] = below[i] + math.log((e11 * r + e01) / (e10 * r + e00))
            b = math.exp(max(-30.0, min(30.0, below[i])))
            both[i] = e11 * r * b / (e11 * r * b + e10 * r + e01 * b + e00)
        return [1 / (1 + math.exp(-max(-500.0, min(500.0, x)))) for x in odds], both

    def text(self, page: str | None) -> str:
        """Content blocks of a page in page order, joined by one space."""
        if not page:
            return ""
        nodes, runs = parse(page)
        p, _ = self.marginals(nodes)
        return " ".join([t for b, t in runs if t and p[b] >= 0.5])


def train(pages: list[str], rounds: int = 300, rate: float = 0.4, decay: float = 0.0001) -> Model:
    """Gradient ascent (Adagrad) on the likelihood of labelled pages; a block without data-y has its parent's label, the page 0."""
    model = Model({}, [[[0.0, 0.0], [0.0, 0.0]] for _ in (0, 1)])
    parsed = []
    for page in pages:
        nodes, _ = parse(page)
        nodes[0].label = 0
        for x in nodes[1:]:
            x.label = nodes[x.parent].label if x.label is None else x.label
        parsed.append((nodes, [features(x) for x in nodes]))
    squares: dict = {}

    def up_by(key, gradient: float) -> float:
        squares[key] = squares.get(key, 1e-6) + gradient * gradient
        return rate * gradient / math.sqrt(squares[key])

    for _ in range(rounds):
        step, pair = {}, [[[0.0, 0.0], [0.0, 0.0]] for _ in (0, 1)]
        for nodes, feats in parsed:
            p, both = model.marginals(nodes)
            for i in range(1, len(nodes)):
                for f in feats[i]:
                    step[f] = step.get(f, 0.0) + nodes[i].label - p[i]
                up, tie = p[nodes[i].parent], pair[kind(nodes[i])]
                expected = ((1 - up - p[i] + both[i], p[i] - both[i]), (up - both[i], both[i]))
                for a in (0, 1):
                    for b in (0, 1):
                        tie[a][b] += (nodes[nodes[i].parent].label == a and nodes[i].label == b) - expected[a][b]
        for f, g in step.items():
            w = model.weights.get(f, 0.0)
            model.weights[f] = w + up_by(f, g - decay * len(parsed) * w)
        for k, a, b in itertools.product((0, 1), repeat=3):
            w = model.pair[k][a][b]
            model.pair[k][a][b] = w + up_by((k, a, b), pair[k][a][b] - decay * len(parsed) * w)
    return model


#: labelled material: what surrounds the main text, and what holds it
_AROUND = ["nav", "header", "footer", "aside", "form", "menu"]
_AROUND_NAMES = """nav navbar menu topmenu breadcrumb breadcrumbs header masthead banner footer foot copyright sidebar side rail widget ad ads advert
advertisement sponsor sponsored promo cookie consent notice alert popup modal newsletter subscribe signup login search form share social related recommended
comment comments reply respond disqus pagination pager tags toolbar skip legal disclaimer""".split()
_HOLDERS = ["<article data-y=1>{}</article>", "<main data-y=1>{}</main>", '<div class="content" data-y=1>{}</div>', '<div id="article-body" data-y=1>{}</div>', '<div class="post entry" data-y=1>{}</div>', '<section class="story text" data-y=1>{}</section>', '<div id="main" data-y=1>{}</div>', "<main><article data-y=1>{}</article></main>", '<div class="wrapper container page" ><article data-y=1>{}</article></div>']


def labelled_pages(n: int = 300, seed: int = 11) -> list[str]:
    """Pages put together from labelled parts (data-y) in many layouts."""
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high)))

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/">{words(1, 3)}</a></li>' for _ in range(k)) + "</ul>"

    def outside() -> str:
        tag, name = rng.choice([*_AROUND, "div", "div", "div", "section", "ul"]), rng.choice(_AROUND_NAMES)
        named = f' {rng.choice(["class", "id"])}="{name}"' if tag in ("div", "section", "ul") or rng.random() < 0.4 else ""
        inner = rng.choice([lambda: links(rng.randint(2, 7)), lambda: words(3, 12), lambda: f"<p>{words(4, 40)}</p>", lambda: f"<h3>{words(1, 3)}</h3><p>{words(8, 60)}</p>", lambda: f"<div><p>{words(5, 30)}</p></div>" * 2, lambda: f"&copy; {words(2, 9)}"])()
        return f"<{tag}{named} data-y=0>{inner}</{tag}>"

    def inside() -> str:
        kinds = [lambda: f"<p>{words(2, 12)}</p>", lambda: f"<p>{words(20, 120)}</p>", lambda: f'<p>{words(10, 60)} <a href="/">{words(1, 4)}</a> {words(2, 30)}</p>', lambda: f"<h2>{words(1, 7)}</h2>", lambda: f"<blockquote><p>{words(8, 40)}</p></blockquote>", lambda: f"<ul><li>{words(3, 20)}</li><li>{words(1, 20)}</li></ul>", lambda: f"<pre>{words(5, 30)}</pre>", lambda: f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 6)}</td></tr></table>", lambda: f"<figure><figcaption>{words(3, 12)}</figcaption></figure>", lambda: f"<div><p>{words(10, 60)}</p></div>", lambda: f"<section><h3>{words(1, 5)}</h3><p>{words(10, 60)}</p></section>", lambda: f"<ol><li>{words(2, 12)}</li></ol>"]
        return rng.choice(kinds)()

    out = []
    for _ in range(n):
        body = [f"<h1>{words(2, 9)}</h1>"] if rng.random() < 0.6 else []
        body += [inside() for _ in range(rng.choice([1, 1, 2, 2, 3, 4, 6, 9]))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            body.insert(rng.randint(0, len(body)), outside())
        bare = rng.random() < 0.2  # no holder: the blocks lie beside what surrounds them
        held = "".join(body) if bare else rng.choice(_HOLDERS).format("".join(body))
        around = [outside() for _ in range(rng.randint(0, 4))], [outside() for _ in range(rng.randint(0, 4))]
        out.append(f"<html><head><title>x</title></head><body{' data-y=1' * bare}>{''.join(around[0])}{held}{''.join(around[1])}</body></html>")
    return out


def extract_text(pages: DataFrame, model: Model | None = None, html_col: str = "html") -> DataFrame:
    """pages with `text`, the main text (empty if none), and n_chars, its code points; columns of these names are replaced.

    The whole html is read; null and empty pages have an empty text. References are decoded, white space in a block becomes one space,
    blocks are joined in page order by one space, none is dropped for its length. The model is trained once from labelled pages
    and sent to the tasks; pages need no shuffle. Every row and all other columns stay.
    """
    send = pages.sparkSession.sparkContext.broadcast(model or train(labelled_pages()))  # a few hundred numbers
    pages = pages.drop("text", "n_chars")
    names, at = pages.columns, pages.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [send.value.text(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInArrow(run, f"{fields}, text string, n_chars long")
