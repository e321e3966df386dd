"""Main text of web pages by a recurrent block labeller.

A lenient tokenizer turns HTML into leaf blocks: runs of text between block-level tags, each with the path of open tags
(with their classes and ids). It moves forward only and looks up what is open by name, so that its time grows with the page
whatever is left unclosed: paths share their beginnings, and after the first quote that never closes quotes in tags are
read as plain characters. Every block becomes a vector of all its hashed path parts, all its hashed words (damped by their number) and a few measures (length,
share of linked text, place on the page, punctuation). A bidirectional LSTM in numpy reads the whole page's sequence and
gives each block the probability that it belongs to the article; blocks of at least 0.5 are joined in page order.

The network is trained on the driver, once a process, and sent to the executors, on pages that a seeded generator writes with known labels: many layouts,
semantic and neutral tags, telling and meaningless class names, unclosed tags, notices, adverts, forms, comments.

Defined cases: null, empty or text-free html gives an empty text; markup that is never closed is read to the end; scripts,
styles and the page head hold no text; pages of any length are read whole; repeated rows give repeated results; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import html as html_lib
import math
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "page_id long, url string, text string, n_chars long"
#: HTML vocabulary.
RAW = frozenset("script style noscript template svg math iframe object head title textarea select option button canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split()
)
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table article section main aside nav body div td th form".split())
MARK = re.compile(r"<(?=[a-zA-Z!?]|/[a-zA-Z])")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"""[>"']""")
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")

PATHS, WORDS, MEASURES = 96, 48, 10
DIM = PATHS + WORDS + MEASURES
HIDDEN = 24


@dataclass(slots=True)
class Open:
    """An open block-level element; `mask` has the path features of it and of all that it stands in."""

    tag: str
    names: str
    around: Open | None
    links: int  # links open around it
    mask: int = 0

    def __post_init__(self) -> None:
        self.mask = _mask(self.tag, self.names) | (self.around.mask if self.around else 0)


@dataclass(slots=True)
class Block:
    text: str
    inside: Open | None  # the innermost open block-level element
    linked: int  # characters inside links

    @property
    def path(self) -> list[tuple[str, str]]:
        """(tag, classes and ids), outermost first."""
        out, at = [], self.inside
        while at:
            out.append((at.tag, at.names))
            at = at.around
        return out[::-1]


class _Stack:
    """Open block-level elements, with the places of each name."""

    def __init__(self) -> None:
        self.open: list[Open] = []
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def top(self) -> Open | None:
        return self.open[-1] if self.open else None

    def last(self, *tags: str) -> int:
        """The place of the innermost element of these names, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def push(self, tag: str, names: str, links: int) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in SCOPE:
            self.scopes.append(len(self.open))
        self.open.append(Open(tag, names, self.top(), links))

    def cut(self, place: int) -> int:
        """Closes all from a place on; the number of links open around that element."""
        links = self.open[place].links
        while len(self.open) > place:
            x = self.open.pop()
            self.places[x.tag].pop()
            if x.tag in SCOPE:
                self.scopes.pop()
        return links


class _Page:
    """Finds ends of tags and of raw elements, each in time linear in the page over all calls."""

    def __init__(self, doc: str):
        self.doc, self.last_end, self.quotes = doc, doc.rfind(">"), True
        self.found: dict[str, tuple[int, int, int]] = {}

    def tag_end(self, at: int) -> int:
        """The `>` that ends the tag whose attributes begin at `at`; quoted ones don't count while quotes close."""
        doc = self.doc
        if self.quotes:
            k = at
            while m := STOP.search(doc, k):
                if m[0] == ">":
                    return m.start()
                k = doc.find(m[0], m.end()) + 1
                if not k:
                    break
            self.quotes = False
        return doc.find(">", at)

    def next(self, pattern: str, at: int) -> tuple[int, int]:
        """Start and end of the first match from `at` on; the page's end if there is none."""
        since, start, end = self.found.get(pattern, (len(self.doc) + 1, 0, 0))
        if not since <= at <= start:
            m = re.compile(pattern, re.I).search(self.doc, at)
            start, end = m.span() if m else (len(self.doc), len(self.doc))
            self.found[pattern] = (at, start, end)
        return start, end


def blocks_of(doc: str) -> list[Block]:
    """Leaf blocks in page order."""
    out: list[Block] = []
    stack, page = _Stack(), _Page(doc)
    text: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if text:
            t = " ".join(html_lib.unescape("".join(text)).split())
            if t:
                out.append(Block(t, stack.top(), linked))
            text.clear()
        linked = 0

    def cut(place: int) -> None:
        nonlocal links
        flush()
        links = stack.cut(place)

    def say(start: int, end: int) -> None:
        nonlocal linked
        if end > start:
            text.append(doc[start:end])
            linked += (end - start) * bool(links)

    at, n = 0, len(doc)
    while at < n:
        m = MARK.search(doc, at)
        if not m:
            say(at, n)
            break
        lt = m.start()
        if doc.startswith("<!--", lt):
            say(at, lt)
            end = doc.find("-->", lt + 4)
            at = end + 3 if end >= 0 else n
            continue
        if lt > page.last_end:  # what never ends is no tag
            say(at, n)
            break
        if doc[lt + 1] in "!?":
            say(at, lt)
            at = doc.find(">", lt) + 1
            continue
        found = NAME.match(doc, lt)
        name, closing = found[1].lower(), doc[lt + 1] == "/"
        end = page.tag_end(found.end())
        say(at, lt)
        attrs = doc[found.end() : end]
        at = end + 1
        if name == "br":
            text.append(" ")
            continue
        top = stack.top()
        if closing:
            if name in INLINE:
                if name == "a" and links > (top.links if top else 0):
                    links -= 1
                continue
            flush()
            if (place := stack.last(name)) >= 0:
                cut(place)
            continue
        if name in RAW:
            flush()
            if not attrs.endswith("/"):
                end = page.next(rf"</{re.escape(name)}\s*(?:>|\Z)", at)[1]
                if name == "head":  # a head without its closing tag ends at the body
                    end = min(end, page.next(r"<body\b", at)[0])
                at = end
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in INLINE:
            links += name == "a"
            continue
        flush()
        if name in CLOSES_P and top and top.tag == "p":
            cut(len(stack.open) - 1)
        if name in SAME and (place := stack.last(*SAME[name])) >= (stack.scopes[-1] if stack.scopes else 0):
            cut(place)
        if not attrs.endswith("/"):
            names = " ".join(v for a in ATTR.findall(attrs) for v in a[1:] if v) if "=" in attrs else ""
            stack.push(name, names, links)
    flush()
    return out


@functools.lru_cache(1 << 16)
def _slot(kind: str, key: str, size: int) -> int:
    return zlib.crc32(f"{kind}{key}".encode()) % size


@functools.lru_cache(1 << 14)
def _mask(tag: str, names: str) -> int:
    keys = {"t " + tag, *("c " + part for x in (names, names.lower()) for part in SPLIT.split(x) if len(part) > 1)}
    return functools.reduce(int.__or__, (1 << _slot("p", k, PATHS) for k in keys))


@functools.lru_cache(1 << 14)
def _path_slots(mask: int, top: str, above: str) -> tuple[int, ...]:
    """Places of a path's features: of all its parts, and of the two innermost tags by their depth."""
    for depth, tag in enumerate((top, above)):
        if tag:
            mask |= 1 << _slot("p", f"{depth} {tag}", PATHS)
    return tuple(k for k in range(PATHS) if mask >> k & 1)


def features(blocks: list[Block]) -> np.ndarray:
    """A row a block."""
    x = np.zeros((len(blocks), DIM), dtype=np.float32)
    n = len(blocks)
    for i, b in enumerate(blocks):
        top = b.inside.tag if b.inside else ""
        if b.inside:
            x[i, list(_path_slots(b.inside.mask, top, b.inside.around.tag if b.inside.around else ""))] = 1
        words = b.text.lower().split()
        slots = np.bincount([_slot("w", w.strip(".,:;!?()|·©"), WORDS) for w in words], minlength=WORDS)
        v = slots / max(4.0, len(words) / 10)  # of long blocks each word weighs less, but none weighs nothing
        x[i, PATHS : PATHS + WORDS] = np.minimum(v, 1 + np.log(np.maximum(v, 1)))
        size = len(b.text)
        m = x[i, PATHS + WORDS :]
        m[0] = math.log1p(size) / 5
        m[1] = min(1.0, b.linked / max(size, 1))
        m[2] = i / max(n - 1, 1)
        m[3] = math.log1p(len(words)) / 4
        m[4] = float(b.text[-1] in ".!?…:\"'”»")
        m[5] = min(1.0, 5 * sum(map(b.text.count, ".,;")) / max(len(words), 1))
        m[6] = float("©" in b.text or "copyright" in b.text.lower())
        m[7] = float(top in ("h1", "h2", "h3"))
        m[8] = float(top in ("p", "blockquote", "pre"))
        m[9] = float(top in ("li", "td", "dt"))
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    """Two LSTMs over a batch of sequences [time, sequence, feature], and a logistic output."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        g = lambda *s: r.normal(0, 1 / math.sqrt(s[0]), s).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"x{d}": g(DIM, 4 * HIDDEN), f"h{d}": g(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1
        self.p |= {"o": g(2 * HIDDEN, 1), "c": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        steps, n, _ = x.shape
        pre = x @ self.p[f"x{d}"] + self.p[f"b{d}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, tape = np.zeros((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ self.p[f"h{d}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in (0, 1, 2))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = (f * c + i * g) * m  # padding stands at the end, so the backward pass starts from zero at the last block
            tc = np.tanh(c2)
            h2 = o * tc * m
            if keep:
                tape.append((t, i, f, o, g, c, tc, h, m))
            h, c = h2, c2
            out[t] = h
        return out, tape

    def predict(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d, False)[0] for d in "fb"], axis=2)
        return _sigmoid((both @ self.p["o"])[:, :, 0] + self.p["c"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        err = ((_sigmoid((both @ self.p["o"])[:, :, 0] + self.p["c"]) - y) * mask / mask.sum())[:, :, None]
        g = {"o": (both * err).sum(axis=(0, 1))[:, None], "c": err.sum(axis=(0, 1))}
        back = err @ self.p["o"].T
        for k, d in enumerate("fb"):
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh, dc = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
            dwh = np.zeros_like(self.p[f"h{d}"])
            for t, i, f, o, gg, c, tc, h, m in reversed(runs[d][1]):
                dh = (dh + back[t][:, k * HIDDEN : (k + 1) * HIDDEN]) * m
                dc = (dc + dh * o * (1 - tc * tc)) * m
                dz = np.concatenate([dc * gg * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                dz_all[t] = dz
                dwh += h.T @ dz
                dh, dc = dz @ self.p[f"h{d}"].T, dc * f
            g |= {f"x{d}": np.tensordot(x, dz_all, axes=((0, 1), (0, 1))), f"h{d}": dwh, f"b{d}": dz_all.sum(axis=(0, 1))}
        return g


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), DIM), np.float32), np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


class PageWriter:
    """Writes training pages: a list of (html, label of each block)."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.parts = ["".join(self.r.choice("bcdfghjklmnprstvzèñüß") + self.r.choice("aeiouéö") for _ in range(self.r.randint(1, 2))) for _ in range(300)]

    def word(self) -> str:
        return "".join(self.r.choice(self.parts) for _ in range(self.r.randint(1, 3)))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def prose(self, a: int, b: int) -> str:
        s = [self.words(4, 18).capitalize() + self.r.choice(".....!?") for _ in range(self.r.randint(a, b))]
        return " ".join(s)

    def tag(self, good: tuple[str, ...], names: tuple[str, ...]) -> tuple[str, str]:
        """An opening and a closing tag; names tell the role, or mean nothing."""
        t = self.r.choice(good) if self.r.random() < 0.65 else "div"
        u = self.r.random()
        name = self.r.choice(names) if u < 0.6 or (t == "div" and u < 0.8) else self.word() if u < 0.8 else ""
        attr = f' {self.r.choice(["class", "id", "class"])}="{name}"' if name else ""
        return f"<{t}{attr}>", f"</{t}>"

    def links(self, a: int, b: int) -> tuple[str, list[int]]:
        items = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(a, b))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" if self.r.random() < 0.9 else f"<li>{x}" for x in items) + "</ul>", [0] * len(items)
        return "<p>" + " | ".join(items) + "</p>", [0]

    def side(self) -> tuple[str, list[int]]:
        """One part of a page that is not the article."""
        r = self.r
        kind = r.randrange(8)
        if kind == 0:
            o, c = self.tag(("nav", "header", "nav"), ("menu", "nav", "navbar", "navigation", "breadcrumb", "topbar"))
            t, y = self.links(3, 9)
        elif kind == 1:
            o, c = self.tag(("aside",), ("sidebar", "related", "widget", "side", "recommended"))
            t, y = self.links(2, 6)
            if r.random() < 0.6:
                t, y = f"<h3>{self.words(1, 3)}</h3>" + t, [0, *y]
            if r.random() < 0.4:
                t, y = t + f"<p>{self.prose(1, 2)}</p>", [*y, 0]
        elif kind == 2:
            o, c = self.tag(("div", "aside", "section"), ("ad", "ads", "advert", "promo", "sponsored", "banner", "advertisement"))
            t, y = self.prose(1, 2), [0]
            if r.random() < 0.3:
                t = f'<a href="#">{t}</a>'
        elif kind == 3:
            o, c = self.tag(("div", "section"), ("cookie", "notice", "consent", "alert", "newsletter", "subscribe", "popup"))
            t, y = f"<p>{self.prose(1, 2)}</p>", [0]
        elif kind == 4:
            o, c = self.tag(("form",), ("search", "login", "contact", "signup"))
            t, y = f"<label>{self.words(1, 3)}</label> <input name=q> <button>{self.word()}</button>", [0]
        elif kind == 5:
            o, c = self.tag(("section", "div"), ("comments", "comment list", "responses", "discussion", "reader comments"))
            k = r.randint(1, 4)
            t = f"<h3>{self.words(1, 2)}</h3>" + "".join(f'<div class="{r.choice(["comment", "reply", "comment body"])}"><p>{self.prose(1, 3)}</p></div>' for _ in range(k))
            y = [0] * (k + 1)
        elif kind == 6:
            o, c = self.tag(("div", "ul"), ("share", "social", "tags", "meta", "byline"))
            t, y = self.links(2, 5)
        else:
            o, c = self.tag(("header",), ("header", "masthead", "site header", "logo", "brand"))
            t, y = f"<p>{self.words(1, 5)}</p>", [0]
        return o + t + c, y

    def footer(self) -> tuple[str, list[int]]:
        o, c = self.tag(("footer", "footer"), ("footer", "bottom", "copyright", "site footer", "colophon"))
        t, y = f"{self.r.choice(['&copy; ', '', '(c) ', 'Copyright '])}{self.word()}.example &middot; {self.prose(1, 2)}", [0]
        if self.r.random() < 0.4:
            more, z = self.links(2, 5)
            t, y = f"<p>{t}</p>" + more, [0, *z]
        return o + t + c, y

    def article(self) -> tuple[str, list[int]]:
        r = self.r
        o, c = self.tag(("article", "article", "main", "section"), ("content", "article", "post", "entry content", "story", "main", "article body"))
        t, y = "", []
        if r.random() < 0.8:
            t, y = f"<h1>{self.words(3, 9)}</h1>", [1]
        for _ in range(1 if r.random() < 0.15 else r.randint(1, 9)):
            u = r.random()
            if u < 0.74:
                s = self.prose(1, r.choice((1, 3, 9)))
                s = f"<b>{s}<br>" if u < 0.1 else s
                s = s.replace(" ", f' <a href="#">{self.word()}</a> ', 1) if r.random() < 0.15 else s
                t, y = t + r.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>")).format(s), [*y, 1]
            elif u < 0.84:
                t, y = t + f"<h2>{self.words(2, 6)}</h2>", [*y, 1]
            elif u < 0.92:
                k = r.randint(2, 5)
                t, y = t + "<ul>" + "".join(f"<li>{self.prose(1, 1)}</li>" for _ in range(k)) + "</ul>", [*y, *[1] * k]
            elif u < 0.95:
                t, y = t + f"<blockquote>{self.prose(1, 2)}</blockquote>", [*y, 1]
            elif u < 0.98:  # tables that were flattened to bars, and words said over and over
                s = " | ".join(self.words(1, 1).capitalize() + r.choice(("", "", ".", ",")) for _ in range(r.randint(3, 30))) if r.random() < 0.7 else " ".join([self.word()] * r.randint(5, 200))
                t, y = t + f"<p>{s}</p>", [*y, 1]
            else:
                s, z = self.side()
                t, y = t + s, [*y, *z]
        return o + t + c, y

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        parts = [self.side() for _ in range(r.randint(0, 3))] + [self.article()] + [self.side() for _ in range(r.randint(0, 3))]
        if r.random() < 0.8:
            parts.append(self.footer())
        body = "".join(p[0] for p in parts)
        labels = [y for p in parts for y in p[1]]
        if r.random() < 0.3:
            o, c = self.tag(("div",), ("wrapper", "container", "page", "row"))
            body = o + body + c
        return f"<!DOCTYPE html><html><head><title>x</title><script>var a='<p>no</p>';</script></head><body>{body}</body></html>", labels


@functools.lru_cache(1)
def trained(pages: int = 900, epochs: int = 8, batch: int = 30, rate: float = 0.01, seed: int = 5) -> BiLstm:
    """The network, trained on generated pages; the same in every process."""
    writer, data = PageWriter(seed), []
    for _ in range(pages):
        doc, y = writer.page()
        x = features(blocks_of(doc))
        if len(x) == len(y) and y:
            data.append((x, np.array(y, dtype=np.float32)))
    net, r = BiLstm(), random.Random(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        r.shuffle(data)
        data.sort(key=lambda d: len(d[0]) // 8)
        cuts = [data[k : k + batch] for k in range(0, len(data), batch)]
        r.shuffle(cuts)
        for cut in cuts:
            x, mask = _padded([d[0] for d in cut])
            if epoch % 2:  # names of unseen sites: some path slots go dark
                x[:, :, :PATHS] *= np.array([r.random() > 0.1 for _ in range(PATHS)], dtype=np.float32)
            y = np.zeros(mask.shape, np.float32)
            for k, d in enumerate(cut):
                y[: len(d[1]), k] = d[1]
            step += 1
            for name, grad in net.gradients(x, mask, y).items():
                grad = np.clip(grad, -1, 1)
                m[name] = 0.9 * m[name] + 0.1 * grad
                v[name] = 0.99 * v[name] + 0.01 * grad * grad
                net.p[name] = (net.p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def label_pages(pages: list[list[Block]], net: BiLstm, batch: int = 64, cells: int = 40_000) -> list[np.ndarray]:
    """Probability of each block of each page; pages of like length go through the network together, long ones by themselves."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        ks = order[at : at + batch]
        while len(ks) > 1 and len(ks) * len(pages[ks[-1]]) > cells:
            ks = ks[: (len(ks) + 1) // 2]
        at += len(ks)
        p = net.predict(*_padded([features(pages[k]) for k in ks]))
        for j, k in enumerate(ks):
            out[k] = p[: len(pages[k]), j]
    return out


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    net = trained()
    shared = pages.sparkSession.sparkContext.broadcast(net.p)  # a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = BiLstm()
        net.p = shared.value
        for b in batches:
            docs, texts = b.column(2).to_pylist(), []
            for at in range(0, len(docs), 512):
                cut = [blocks_of(d) for d in docs[at : at + 512]]
                texts += ["\n\n".join(x.text for x, p in zip(bs, ps, strict=True) if p >= threshold) for bs, ps in zip(cut, label_pages(cut, net), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    src = pages.select(
        pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html")
    )
    return src.mapInArrow(run, OUT)
