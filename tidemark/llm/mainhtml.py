"""Main text of web pages, by a tree-structured graphical model over the DOM.

Each block element and each block of text is a binary node (content or not). Node potentials come
from tags, class, id and role words, text length and link share; edge potentials join parent and
child. Both are estimated from labelled pages. Sum-product message passing up and down the tree gives
each block's marginal; blocks of at least one half are kept, in page order.

The labelled pages are made here (`labelled_pages`): articles in many layouts whose content elements
carry the attribute data-content. Other labelled pages can be given to `fit`.
"""

from __future__ import annotations

import html as _html
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text of the page.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
HIDDEN = frozenset("select option button svg head datalist".split())
#: An opening tag of the key ends an open element of the value, up to the nearest of its bounds.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
# every repetition is possessive, so that a truncated tag or an unclosed quote is read once
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


class Page:
    """Nodes in page order: parent, features, and text (None for elements)."""

    def __init__(self, source: str):
        self.parent, self.features, self.text, self.marked = [-1], [("page", "page")], [None], [False]
        # open elements: name, node (an inline element has its block's), and where the nearest block is
        stack = [("", 0, 0)]
        opened: list[dict[str, int]] = [{}]  # open inline elements by name, for each open block
        blocks: dict[str, int] = {}  # open blocks by name
        buffer: list[str] = []
        linked = 0  # characters within links
        links = hidden = 0
        at = 0

        def flush():
            nonlocal linked
            if buffer:
                words = " ".join("".join(buffer).split())
                if words:
                    share = min(linked / len(words), 1.0)
                    self._add(stack[-1][1], ("text", f"{block()}>text", f"len{min(len(words).bit_length(), 10)}", f"link{round(share * 3)}", f"end{words[-1] in '.!?:…'}"), words)
                buffer.clear()
            linked = 0

        def block():
            return stack[stack[-1][2]][0]

        def push(name: str, node: int):
            if name in BLOCK:
                stack.append((name, node, len(stack)))
                blocks[name] = blocks.get(name, 0) + 1
                opened.append({})
            else:
                stack.append((name, node, stack[-1][2]))
                opened[-1][name] = opened[-1].get(name, 0) + 1

        def pop(to: int):
            nonlocal links, hidden
            if stack[-1][2] >= to:
                flush()
            while len(stack) > to:
                name, _, _ = stack.pop()
                links -= name == "a"
                hidden -= name in HIDDEN
                if name in BLOCK:
                    blocks[name] -= 1
                    opened.pop()
                else:
                    opened[-1][name] -= 1

        while True:
            m = _TOKEN.search(source, at)
            run = source[at : m.start() if m else len(source)]
            if run and not hidden:
                run = _html.unescape(run) if "&" in run else run
                buffer.append(run)
                if links:
                    linked += len(run.strip())
            if not m:
                break
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:
                # an inline element ends within its block only
                if (blocks if name in BLOCK else opened[-1]).get(name):
                    k = stack[-1][2] if name in BLOCK else len(stack) - 1
                    while stack[k][0] != name:
                        k = stack[k - 1][2] if name in BLOCK else k - 1
                    pop(k)
                continue
            if name in RAW:
                close = re.compile(f"</{re.escape(name)}\\b[^>]*+(?:>|\\Z)", re.I).search(source, at)
                at = close.end() if close else len(source)
                continue
            if name in VOID:
                buffer.append(" ")
                if name == "hr":
                    flush()
                continue
            attrs = (m[3] if m[2] else m[6]) or ""
            if name in BLOCK:
                if name in ENDS:
                    ends, bounds = ENDS[name]
                    k, low = stack[-1][2], 0
                    while k > 0 and stack[k][0] not in bounds:
                        if stack[k][0] in ends:
                            low = k
                        k = stack[k - 1][2]
                    if low:
                        pop(low)
                elif block() == "p":
                    pop(stack[-1][2])
                flush()
                push(name, self._add(stack[-1][1], *self._element(name, block(), attrs)))
            elif name not in ("svg", "math") or not attrs.rstrip().endswith("/"):
                links += name == "a"
                hidden += name in HIDDEN
                push(name, stack[-1][1])
        flush()

    def _add(self, parent: int, features: tuple, text: str | None = None, marked: bool = False) -> int:
        self.parent.append(parent)
        self.features.append(features)
        self.text.append(text)
        self.marked.append(marked)
        return len(self.parent) - 1

    _seen: dict[tuple, tuple] = {}

    def _element(self, name: str, within: str, attrs: str) -> tuple:
        key = (name, within, attrs)
        got = self._seen.get(key)
        if got is None:
            found = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)] if attrs else []
            words = {w.lower() for _, v in found for w in _WORDS.findall(v)}
            got = ((name, f"{within}>{name}", *sorted(f"word:{w}" for w in words)), None, "data-content" in attrs)
            if len(self._seen) < 50_000:
                self._seen[key] = got
        return got


def labelled_pages(n: int = 400, seed: int = 11) -> list[str]:
    """Pages in many layouts. Elements with data-content hold content, other text is none."""
    r = random.Random(seed)
    chrome_words = {
        "nav": "nav menu navbar navigation breadcrumb breadcrumbs pagination toc links",
        "header": "header masthead topbar top site banner logo title",
        "footer": "footer bottom copyright legal colophon",
        "side": "sidebar side aside widget related recommended rail trending popular tags",
        "ad": "ad ads advert advertisement advertising sponsor sponsored promo promotion banner",
        "notice": "cookie cookies consent notice notices gdpr alert popup modal overlay subscribe newsletter privacy paywall",
        "comments": "comment comments discussion replies reply respond disqus reader responses",
        "form": "form search login signup contact newsletter subscribe",
        "share": "share social sharing buttons follow",
    }
    body_words = "article content post entry story main text body".split()
    vocabulary = [("".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4)))) for _ in range(400)]
    say = lambda lo, hi: " ".join(r.choice(vocabulary) for _ in range(r.randint(lo, hi))).capitalize()
    link = lambda: f'<a href="/{r.choice(vocabulary)}">{say(1, 3)}</a>'
    items = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(3, 9))) + "</ul>"

    def named(kind, *tags):
        w = r.sample(chrome_words[kind].split(), r.randint(1, 2))
        attr = r.choice(["class", "class", "id"])
        t = r.choice(tags)
        return t, (f' {attr}="{r.choice("- _")[0].join(w) if len(w) > 1 else w[0]}"' if t == "div" or r.random() < 0.6 else "")

    def wrap(kind, tags, inner):
        t, a = named(kind, *tags)
        return f"<{t}{a}>{inner}</{t}>"

    def chrome(kind):
        prose = lambda: r.choice(["", "p", "p", "div"])
        text = lambda lo, hi: (lambda t: f"<{t}>{say(lo, hi)}.</{t}>" if t else f"{say(lo, hi)}.")(prose())
        if kind == "nav":
            return wrap(kind, ["nav", "nav", "div"], r.choice([items(), " ".join(link() for _ in range(5))]))
        if kind == "header":
            return wrap(kind, ["header", "header", "div"], r.choice([f"<h1>{say(1, 3)}</h1>", f"<p>{say(1, 6)}</p>", say(1, 4)]) + r.choice(["", items()]))
        if kind == "footer":
            return wrap(kind, ["footer", "footer", "div"], r.choice([f"&copy; {say(1, 12)}.", text(3, 25), items()]))
        if kind == "side":
            return wrap(kind, ["aside", "aside", "div"], r.choice([f"<h3>{say(1, 3)}</h3>", ""]) + r.choice([items(), text(5, 40), text(20, 90)]))
        if kind == "ad":
            return wrap(kind, ["div", "div", "aside"], text(3, 40))
        if kind == "notice":
            return wrap(kind, ["div", "div", "section", "dialog"], text(6, 50) + r.choice(["", "<button>OK</button>"]))
        if kind == "comments":
            one = lambda: wrap("comments", ["div", "li", "article"], f"<p>{say(5, 60)}.</p>")
            return wrap(kind, ["section", "div", "div"], r.choice(["", f"<h2>{say(1, 2)}</h2>"]) + "".join(one() for _ in range(r.randint(1, 5))))
        if kind == "form":
            return f"<form{r.choice(['', ' class=\"search\"', ' id=\"contact\"'])}>" + r.choice(["<label>", "<p>"]) + say(2, 20) + '<input type="text"></form>'
        return wrap(kind, ["div", "ul"], " ".join(link() for _ in range(4)))

    def content():
        # some sites set paragraphs as div elements, under names of their own
        par, own = r.choice(["p"] * 4 + ["div"]), r.choice(["", f' class="{r.choice(vocabulary)}"'])
        out = [f"<h1 data-content>{say(2, 9)}</h1>"] if r.random() < 0.8 else []
        if out and par == "div":
            out = [f"<div{own} data-content>{out[0]}</div>"]
        if r.random() < 0.15:
            out = [f"<header data-content>{''.join(out)}<p>{say(3, 12)}</p></header>"]
        for _ in range(r.randint(1, 14)):
            k = r.random()
            end = r.choice([".", ".", ".", "!", "?", "", ","])
            if k < 0.78:
                words = say(1, r.choice([4, 20, 120])) + (f" {link()} {say(1, 6)}" if r.random() < 0.1 else "")
                if par == "div":
                    out.append(f"<div{own} data-content>{words}{end}</div>")
                else:
                    out.append(r.choice([f"<p data-content>{words}{end}</p>", f"<p data-content><b>{words}{end}<br>"] if r.random() < 0.3 else [f"<p data-content>{words}{end}</p>"]))
            elif k < 0.84:
                out.append(f"<h{r.choice('234')} data-content>{say(1, 6)}</h{2}>".replace("</h2>", ""))
                out[-1] += f"</{out[-1][1:3]}>"
            elif k < 0.9:
                out.append("<ul data-content>" + "".join(f"<li>{say(2, 14)}{end}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif k < 0.94:
                out.append(f"<blockquote data-content><p>{say(8, 40)}{end}</p></blockquote>")
            elif k < 0.97:
                out.append("<table data-content>" + "".join(f"<tr><td>{say(1, 3)}</td><td>{say(1, 3)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                out.append(f"<pre data-content>{say(4, 20)}</pre>")
        if r.random() < 0.25:
            out.insert(r.randint(0, len(out)), chrome(r.choice(["ad", "share", "side", "notice"])))
        if r.random() < 0.1:
            out.append(chrome("comments"))
        inner = "".join(out)
        how = r.random()
        if how < 0.6:
            a = r.choice(["", "", f' class="{r.choice(body_words)}"'])
            return f"<article{a} data-content>{inner}</article>"
        if how < 0.8:
            return f"<main data-content>{inner}</main>"
        return f'<div {r.choice(["class", "id"])}="{r.choice(body_words + vocabulary[:8])}" data-content>{inner}</div>'

    pages = []
    for _ in range(n):
        kinds = list(chrome_words)
        before = [chrome(k) for k in ["nav", "header", "ad", "notice", "form"] if r.random() < 0.45]
        after = [chrome(k) for k in ["side", "comments", "footer", "ad", "share", "notice", "form"] if r.random() < 0.45]
        r.shuffle(before)
        r.shuffle(after)
        inner = "".join(before) + content() + "".join(after)
        if r.random() < 0.2:
            inner = f'<div class="{r.choice(["wrapper", "container", "page", *vocabulary[8:12]])}">{inner}</div>'
        assert kinds
        pages.append(f"<html><head><title>{say(2, 8)}</title></head><body>{inner}</body></html>")
    return pages


def _labels(page: Page) -> list[bool]:
    """A text block is content if the nearest marked or named ancestor is; an element, if most of its text is."""
    n = len(page.parent)
    own = [False] * n
    for k in range(1, n):
        p = page.parent[k]
        chrome = any(f.startswith("word:") for f in page.features[k]) or page.features[k][0] in ("nav", "footer", "aside", "form", "header", "dialog")
        own[k] = page.marked[k] or (own[p] and (page.text[k] is not None or not chrome))
    good, all_ = [0] * n, [0] * n
    for k in range(n - 1, -1, -1):
        if page.text[k] is not None:
            all_[k] = len(page.text[k])
            good[k] = all_[k] * own[k]
        if k:
            good[page.parent[k]] += good[k]
            all_[page.parent[k]] += all_[k]
    return [2 * g > a for g, a in zip(good, all_)]


def fit(pages: list[str]) -> dict:
    """Potentials from labelled pages: for each kind of child (its tag, and its tag within its parent's)
    the chance of either label given the parent's, and log odds of all other features."""
    count: dict[str, list[int]] = {}
    edge: dict[str, list[list[int]]] = {}
    total = [1, 1]
    for source in pages:
        page = Page(source)
        y = _labels(page)
        for k in range(1, len(y)):
            total[y[k]] += 1
            for kind in ("*", *page.features[k][:2]):
                edge.setdefault(kind, [[0, 0], [0, 0]])[y[page.parent[k]]][y[k]] += 1
            for f in page.features[k][2:]:
                count.setdefault(f, [0, 0])[y[k]] += 1
    weight = {f: math.log((c[1] + 0.3) / (total[1] + 1)) - math.log((c[0] + 0.3) / (total[0] + 1)) for f, c in count.items()}

    def smooth(n, towards, strength):
        return [[(n[i][j] + strength * towards[i][j]) / (sum(n[i]) + strength) for j in (0, 1)] for i in (0, 1)]

    out = {"*": smooth(edge.get("*", [[0, 0], [0, 0]]), [[0.5, 0.5], [0.5, 0.5]], 2)}
    for kind, n in sorted(edge.items(), key=lambda x: ">" in x[0]):  # tags first, then tags within tags
        if kind != "*":
            out[kind] = smooth(n, out.get(kind.split(">")[-1], out["*"]), 4)
    return {"weight": weight, "edge": out}


def marginals(page: Page, model: dict) -> list[float]:
    """Log odds of each node's marginal, by sum-product up and then down the tree."""
    edges, weight = model["edge"], model["weight"]
    n = len(page.parent)
    exp, log, parent = math.exp, math.log, page.parent
    own, odds, to_parent = [None] * n, [0.0] * n, [0.0] * n
    for k in range(1, n):
        f = page.features[k]
        own[k] = edges.get(f[1]) or edges.get(f[0]) or edges["*"]
        odds[k] = sum(weight.get(x, 0.0) for x in f[2:])
    for k in range(n - 1, 0, -1):
        (e00, e01), (e10, e11) = own[k]
        x = exp(max(-30.0, min(30.0, odds[k])))
        to_parent[k] = log((e11 * x + e10) / (e01 * x + e00))
        odds[parent[k]] += to_parent[k]
    for k in range(1, n):
        (e00, e01), (e10, e11) = own[k]
        x = exp(max(-30.0, min(30.0, odds[parent[k]] - to_parent[k])))
        odds[k] += log((e11 * x + e01) / (e10 * x + e00))
    return odds


def main_text(source: str | None, model: dict) -> str:
    """The kept blocks, joined by an empty line; empty for null or empty html."""
    if not source:
        return ""
    page = Page(source)
    odds = marginals(page, model)
    return "\n\n".join(t for t, o in zip(page.text, odds) if t is not None and o >= 0)


def extract_main_text(pages: DataFrame, model: dict | None = None, id_col: str = "page_id") -> DataFrame:
    """(page_id, url, text, n_chars) for each row, repeated rows and null ids included. Without a model
    it is fitted on `labelled_pages`; its size is bounded by their vocabulary.

    Null and empty html give an empty text, n_chars 0; other columns play no part. A page is read once
    whatever its length, nesting or truncation: a tag cut short by the end of the page ends there, an
    element never closed ends with the page. Text of a page is held in one task, as its row is."""
    shared = pages.sparkSession.sparkContext.broadcast(model or fit(labelled_pages()))
    rows = pages.select(F.col(id_col).alias("_id"), F.col("url").alias("_url"), F.col("html").alias("_html"))
    schema = StructType([StructField(id_col, rows.schema["_id"].dataType), StructField("url", rows.schema["_url"].dataType), StructField("text", StringType()), StructField("n_chars", LongType())])

    def extract(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                text = [main_text(x, shared.value) for x in b.column(2).slice(lo, 128).to_pylist()]
                cols = [b.column(0).slice(lo, 128), b.column(1).slice(lo, 128), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "url", "text", "n_chars"])

    return rows.mapInArrow(extract, schema)
