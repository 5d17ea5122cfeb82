"""Main-text extraction with a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags. Each block becomes a vector of its
hashed tag path (tags, classes and ids of the open elements), its hashed words and a few figures such as its
share of link text. A bidirectional LSTM in numpy reads the blocks of the whole page in order and gives each
the probability that it belongs to the article; those above one half are the main text.

The labeller is trained on pages that ``training_pages`` makes up: articles in many kinds of containers among
menus, headers, footers, sidebars, notices, adverts, forms and reader comments. Training is deterministic and
takes a few seconds on the driver; the model has a fixed size and is broadcast.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import int64, slices, small_batches

#: Elements that don't end a block, elements without end tags, elements whose content isn't text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas".split())
#: Opening one of these ends an open element of the same group.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCK_IN_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
NAME = re.compile(r"[a-z]+")

PATH_DIM, WORD_DIM, MORE = 192, 24, 7
DIM = PATH_DIM + WORD_DIM + MORE


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    link_chars: int
    tags: set[str] = field(default_factory=set)


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in order: white space made single, character references decoded."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    inside: set[str] = set()
    links = depth_a = 0

    def flush() -> None:
        nonlocal links, inside
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(tuple(p for _, p in stack), text, min(links, len(text)), inside))
            parts.clear()
        links, inside = 0, set()

    def add(raw: str) -> None:
        nonlocal links
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            if depth_a:
                links += len(text.strip())

    at, size = 0, len(page)
    while at < size:
        m = MARKUP.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else size
            continue
        if tag in INLINE:
            if tag == "a":
                depth_a = 0 if closing else 1
            if tag == "br":
                parts.append(" ")
            elif not closing:
                inside.add(tag)
            continue
        flush()
        depth_a = 0
        if tag in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        drop = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCK_IN_P else set())
        if stack and stack[-1][0] in drop:
            stack.pop()
            if tag == "tr" and stack and stack[-1][0] == "tr":
                stack.pop()
        if not attributes.endswith("/"):
            names = " ".join(n for a in ATTRIBUTE.finditer(attributes) for n in NAME.findall((a[2] or a[3] or a[4] or "").lower()))
            stack.append((tag, f"{tag} {names}".strip()))
    flush()
    return out


@lru_cache(maxsize=50_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Signed hash counts of the path's tags and names; the innermost element counts on its own as well."""
    x = np.zeros(PATH_DIM, np.float32)
    for depth, element in enumerate(reversed(path)):
        for k, name in enumerate(element.split()):
            kind = "t" if k == 0 else "n"
            for word in (f"{kind}:{name}", f"last{kind}:{name}") if depth == 0 else (f"{kind}:{name}",):
                h = zlib.crc32(word.encode())
                x[h % PATH_DIM] += 1.0 if h >> 16 & 1 else -1.0
    x.flags.writeable = False
    return np.clip(x, -2, 2)


def page_vectors(blocks: list[Block]) -> np.ndarray:
    """One row for each block."""
    x = np.zeros((len(blocks), DIM), np.float32)
    data = [b.text.encode() for b in blocks]
    buf = wh.LOWER[np.frombuffer(b"\n".join(data) + b"\n", np.uint8)]
    starts, ends = wh.spans(buf)
    of = np.searchsorted(np.cumsum([len(d) + 1 for d in data]), starts, side="right")
    hashes = (wh.span_hashes(buf, starts, ends) % np.uint64(WORD_DIM)).astype(np.int64)
    words = np.bincount(of * WORD_DIM + hashes, minlength=len(blocks) * WORD_DIM).reshape(len(blocks), WORD_DIM)
    count = words.sum(axis=1, keepdims=True)
    x[:, PATH_DIM : PATH_DIM + WORD_DIM] = words / np.maximum(count, 1)
    for i, b in enumerate(blocks):
        x[i, :PATH_DIM] = _path_vector(b.path)
        n = len(b.text)
        x[i, PATH_DIM + WORD_DIM :] = (np.log1p(n) / 6, b.link_chars / n, np.log1p(count[i, 0]) / 5, b.text[-1] in ".!?:;", i / len(blocks), len(b.path) / 8, "©" in b.text)
    return x


class BiLSTM:
    """A bidirectional LSTM with a logistic output for every step, in numpy."""

    def __init__(self, dim: int, hidden: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        make = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.hidden = hidden
        self.p = {"out": make(2 * hidden, 1), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": make(dim, 4 * hidden), f"u{d}": make(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"c{d}"][hidden : 2 * hidden] = 1.0

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        n, t, _ = x.shape
        k = self.hidden
        gates = (x.reshape(n * t, -1) @ self.p[f"w{d}"] + self.p[f"c{d}"]).reshape(n, t, -1)
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        out, kept = np.zeros((n, t, k), np.float32), []
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            z = gates[:, s] + h @ self.p[f"u{d}"]
            i, f, o = (1 / (1 + np.exp(-z[:, a * k : (a + 1) * k])) for a in range(3))
            g = np.tanh(z[:, 3 * k :])
            m = mask[:, s, None]
            new = (f * c + i * g) * m  # padding resets the state, so that reading may start on it
            tanh = np.tanh(new)
            if keep:
                kept.append((s, h, c, i, f, o, g, tanh, m))
            h, c = o * tanh * m, new
            out[:, s] = h
        return out, kept

    def forward(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d, False)[0] for d in "fb"], axis=2)
        return 1 / (1 + np.exp(-np.clip(both @ self.p["out"] + self.p["bias"], -30, 30)))[:, :, 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss over the blocks and its gradients by back-propagation through time."""
        k = self.hidden
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        p = 1 / (1 + np.exp(-np.clip(both @ self.p["out"] + self.p["bias"], -30, 30)))[:, :, 0]
        total = mask.sum()
        loss = -(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / total
        error = (mask * (p - y) / total)[:, :, None].astype(np.float32)
        grads = {"out": np.einsum("ntk,nto->ko", both, error), "bias": error.sum(axis=(0, 1))}
        for j, d in enumerate("fb"):
            back = error @ self.p["out"][j * k : (j + 1) * k].T
            dz = np.zeros((*x.shape[:2], 4 * k), np.float32)
            du = np.zeros_like(self.p[f"u{d}"])
            dh, dc = np.zeros((len(x), k), np.float32), np.zeros((len(x), k), np.float32)
            for s, h, c, i, f, o, g, tanh, m in reversed(runs[d][1]):
                dh = (dh + back[:, s]) * m
                dc = (dc + dh * o * (1 - tanh * tanh)) * m
                z = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                dz[:, s] = z
                du += h.T @ z
                dh, dc = z @ self.p[f"u{d}"].T, dc * f
            flat = dz.reshape(-1, 4 * k)
            grads |= {f"w{d}": x.reshape(-1, x.shape[2]).T @ flat, f"u{d}": du, f"c{d}": flat.sum(axis=0)}
        return float(loss), grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    most = max(len(p) for p in pages)
    x, mask = np.zeros((len(pages), most, DIM), np.float32), np.zeros((len(pages), most), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, 1
    return x, mask


# -- made-up pages for training

#: Names that sites give to the parts of a page.
MAIN_NAMES = "content|main|post|entry|article|article-body|post-content|story|text|entry-content|body|page-content|blog-post|main-content".split("|")
PLAIN_NAMES = "wrapper|container|page|row|col|layout|inner|site|grid|outer|wrap|section|block|box".split("|")
NOISE_NAMES = {
    "menu": "nav|menu|navbar|navigation|top-menu|breadcrumb|breadcrumbs|toc-menu|tabs|site-nav|pagination|pager".split("|"),
    "header": "header|site-header|masthead|topbar|top|branding|logo|page-header|banner-top".split("|"),
    "footer": "footer|site-footer|bottom|copyright|legal|colophon|foot|imprint|credits".split("|"),
    "side": "sidebar|side|widget|related|popular|recommended|aside|tags|share|social|author-box|trending|more-links|archive".split("|"),
    "notice": "cookie|cookies|cookie-banner|consent|notice|gdpr|popup|modal|newsletter|subscribe|alert|overlay|toast|disclaimer".split("|"),
    "advert": "ad|ads|advert|advertisement|sponsor|sponsored|promo|banner|adsbox|ad-slot|promotion|commercial".split("|"),
    "comments": "comments|comment|comment-list|respond|discussion|replies|reader-comments|disqus|reviews|comment-body".split("|"),
}
CUES = {
    "menu": "Home About Contact Products Blog Login Search Archive".split(),
    "header": "Welcome Sign in Search Menu".split(),
    "footer": "© Copyright All rights reserved Privacy Terms Imprint".split(),
    "side": "Related Popular Share Tags More Latest".split(),
    "notice": "We use cookies Accept Subscribe newsletter consent".split(),
    "advert": "Sponsored Advertisement Buy now offer".split(),
    "comments": "Reply says wrote comment ago Anonymous".split(),
}


class _Pages:
    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        self.words = ["".join(self.rng.choice(list("abdefghilmnorstuwéüñ"), int(self.rng.integers(1, 9)))) for _ in range(3000)]

    def pick(self, values):
        return values[int(self.rng.integers(len(values)))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def prose(self, least: int, most: int) -> str:
        n = int(np.exp(self.rng.uniform(np.log(least), np.log(most))))
        words = [self.pick(self.words) for _ in range(n)]
        for i in range(n):
            if i == 0 or words[i - 1][-1:] in ".!?":
                words[i] = words[i].capitalize()
            if self.chance(0.12):
                words[i] += self.pick([",", ".", ".", "?", "***", "!!"])
        return " ".join(words) + (self.pick([".", "."]) if self.chance(0.8) else "")

    def named(self, names: list[str]) -> str:
        name = self.pick(names)
        if self.chance(0.3):
            name += f" {self.pick(PLAIN_NAMES)}"
        return f' {self.pick(["class", "class", "id"])}="{name}"'

    def text(self, label: int, tag: str, words: str) -> list[tuple[str, int | None]]:
        inner = words
        if self.chance(0.15):
            inner = f"<b>{words[: len(words) // 2]}</b>{words[len(words) // 2 :]}"
        end = "" if tag in ("p", "li") and self.chance(0.15) else f"</{tag}>"
        return [(f"<{tag}>", None), (inner, label), (end, None)]

    def noise(self, kind: str, deep: bool) -> list[tuple[str, int | None]]:
        """A part of a page that isn't the article."""
        own = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside"}.get(kind)
        if kind == "form":
            out = [("<form>", None)]
            for _ in range(int(self.rng.integers(1, 4))):
                out += self.text(0, self.pick(["label", "p", "div", "button", "legend"]), self.prose(1, 8))
            return [*out, ("</form>", None)]
        tag = own if own and self.chance(0.5) else self.pick(["div", "div", "section", "ul" if kind == "menu" else "div", "aside" if kind in ("side", "advert") else "div", "ol" if kind == "comments" else "div"])
        attributes = "" if tag == own and self.chance(0.7) else self.named(NOISE_NAMES[kind])
        out = [(f"<{tag}{attributes}>", None)]
        cue = lambda: (self.pick(CUES[kind]) + " " if self.chance(0.3) else "")
        if kind == "menu":
            if tag != "ul":
                out.append(("<ul>", None))
            for _ in range(int(self.rng.integers(2, 9))):
                out += [("<li>", None), (f'<a href="/x">{cue()}{self.prose(1, 3)}</a>', 0), ("</li>", None)]
            if tag != "ul":
                out.append(("</ul>", None))
        elif kind == "comments":
            for _ in range(int(self.rng.integers(1, 6))):
                if self.chance(0.5):
                    out += self.text(0, self.pick(["h3", "h4", "div"]), cue() + self.prose(1, 4))
                out += self.text(0, "li" if tag == "ol" else self.pick(["p", "p", "div", "article" if self.chance(0.3) else "p"]), cue() + self.prose(3, 80))
        else:
            for _ in range(int(self.rng.integers(1, 4))):
                if self.chance(0.3):
                    out += self.text(0, self.pick(["h1", "h2"]) if kind == "header" else self.pick(["h2", "h3", "h4"]), cue() + self.prose(1, 6))
                if self.chance(0.25):
                    out += [(f'<a href="/y">{cue()}{self.prose(1, 8)}</a>', 0)]
                elif self.chance(0.4):
                    out += [(cue() + self.prose(2, 30), 0)]
                else:
                    out += self.text(0, self.pick(["p", "li", "div", "p"]), cue() + self.prose(2, 40))
        return [*out, (f"</{tag}>", None)]

    def unnamed(self) -> str:
        """No name, a plain one, or one that says nothing."""
        return self.pick(["", "", "", "", self.named(PLAIN_NAMES), self.named(MAIN_NAMES), f' class="{self.pick(self.words)}"', f' id="{self.pick(self.words)}{int(self.rng.integers(99))}"'])

    def body(self) -> list[tuple[str, int | None]]:
        """An article as older and plainer pages have it: text between line breaks, or divs within divs."""
        lines = [self.prose(1, 120) for _ in range(int(np.exp(self.rng.uniform(0, np.log(12)))))]
        out = self.text(1, self.pick(["h1", "h1", "h2"]), self.prose(2, 14)) if self.chance(0.4) else []
        if self.chance(0.5):  # one block, in which line breaks are spaces
            return [*out, (self.pick(["<br>", "<br><br>", "<br/>\n"]).join(lines), 1)]
        tag = self.pick(["div", "div", "div", "p", "section"])
        return [*out, *(x for line in lines for x in [(f"<{tag}{self.unnamed() if tag == 'div' else ''}>", None), (line, 1), (f"</{tag}>", None)])]

    def plain_page(self) -> list[tuple[str, int | None]]:
        """Pages without a container that says what it is: bare text, unnamed divs, tables of columns, articles alone."""
        kind = self.pick(["text", "alone", "divs", "divs", "divs", "divs", "divs", "table"])
        if kind == "text":
            return [("\n".join(self.prose(3, 150) for _ in range(int(self.rng.integers(1, 4)))), 1)]
        noise = lambda kinds, p: [x for k in kinds if self.chance(p) for x in self.noise(k, False)]
        start, end = [("<html><head>", None), *self.text(0, "title", self.prose(2, 12)), ("</head><body>", None)], [("</body></html>", None)]
        if kind == "alone":
            tag = self.pick(["", "div", "article", "main"])
            return (start if self.chance(0.5) else []) + ([(f"<{tag}{self.unnamed() if tag == 'div' else ''}>", None), *self.body(), (f"</{tag}>", None)] if tag else self.body())
        before, after = noise(("header", "menu", "notice", "advert"), 0.5), noise(("side", "comments", "form", "footer"), 0.4)
        if kind == "table":
            links = [x for _ in range(int(self.rng.integers(1, 6))) for x in [(f'<a href="/x">{self.prose(1, 3)}</a>', 0), ("<br>", None)]][:-1]
            cells = [[("<td>", None), *([(" ".join(t for t, _ in links), 0)] if self.chance(0.5) else self.noise("menu", False)), ("</td>", None)], [(f"<td{self.unnamed()}>", None), *self.body(), ("</td>", None)]]
            return [*start, *noise(("header",), 0.4), ("<table><tr>", None), *(x for c in (cells if self.chance(0.7) else cells[::-1]) for x in c), ("</tr></table>", None), *noise(("footer",), 0.5), *end]
        deep = [self.unnamed() for _ in range(int(self.rng.integers(1, 4)))]
        return [*start, *before, *((f"<div{w}>", None) for w in deep), *self.body(), *(("</div>", None) for _ in deep), *after, *end]

    def page(self) -> tuple[list[Block], np.ndarray]:
        return self.cut(self.plain_page() if self.chance(0.25) else self.usual_page())

    def usual_page(self) -> list[tuple[str, int | None]]:
        parts: list[tuple[str, int | None]] = [("<html><head>", None), *self.text(0, "title", self.prose(2, 12)), ("<style>p{margin:0}</style></head><body>", None)]
        wraps = [self.named(PLAIN_NAMES) for _ in range(int(self.rng.integers(0, 3)))]
        parts += [(f"<div{w}>", None) for w in wraps]
        for kind in ("notice", "header", "menu", "advert", "side", "form"):
            if self.chance({"menu": 0.8, "header": 0.6}.get(kind, 0.35)):
                parts += self.noise(kind, False)
        tag = self.pick(["article", "article", "article", "main", "main", "div", "div", "section", "body"])
        nested = tag == "main" and self.chance(0.4)
        attributes = self.named(MAIN_NAMES) if tag in ("div", "section") or self.chance(0.2) else ""
        if tag != "body":
            parts.append((f"<{tag}{attributes}>", None))
        if nested:
            parts.append(("<article>", None))
        if self.chance(0.8):
            head = tag == "article" and self.chance(0.25)
            parts += [("<header>", None)] * head + self.text(1, "h1", self.prose(2, 14)) + [("</header>", None)] * head
        for _ in range(int(np.exp(self.rng.uniform(0, np.log(20))))):
            r = self.rng.random()
            if r < 0.72:
                parts += self.text(1, "p", self.prose(1, 120))
            elif r < 0.8:
                parts += self.text(1, self.pick(["h2", "h3"]), self.prose(1, 8))
            elif r < 0.88:
                kind = self.pick(["ul", "ol"])
                parts += [(f"<{kind}>", None)] + [x for _ in range(int(self.rng.integers(1, 5))) for x in self.text(1, "li", self.prose(1, 25))] + [(f"</{kind}>", None)]
            elif r < 0.92:
                parts += [(f"<{w}>", None) for w in ("blockquote",)] + self.text(1, "p", self.prose(3, 50)) + [("</blockquote>", None)]
            elif r < 0.94:
                parts += self.text(1, "pre", self.prose(3, 30))
            elif r < 0.96:
                parts += [("<table><tr>", None), *self.text(1, "td", self.prose(1, 6)), *self.text(1, "td", self.prose(1, 6)), ("</tr></table>", None)]
            elif r < 0.97:
                parts += [("<figure>", None), *self.text(1, "figcaption", self.prose(2, 15)), ("</figure>", None)]
            else:
                parts += self.noise(self.pick(["advert", "side", "notice", "form"]), True)
        if nested:
            parts.append(("</article>", None))
        if nested and self.chance(0.3):
            parts += self.noise("comments", True)
        if tag != "body":
            parts.append((f"</{tag}>", None))
        for kind in ("comments", "side", "advert", "form", "menu", "notice", "footer"):
            if self.chance({"footer": 0.8}.get(kind, 0.3)):
                parts += self.noise(kind, False)
        return [*parts, *[("</div>", None)] * len(wraps), ("</body></html>", None)]

    def cut(self, parts: list[tuple[str, int | None]]) -> tuple[list[Block], np.ndarray]:
        """Blocks and labels; a label rides along in a mark that is taken off again."""
        page = "".join(p if label is None else f"\x01{label}{p}" for p, label in parts)
        blocks, labels = [], []
        for b in blocks_of(page):
            marks = re.findall("\x01([01])", b.text)
            b.text = re.sub("\x01[01]", "", b.text).strip()
            if b.text and marks:
                b.link_chars = min(b.link_chars, len(b.text))
                blocks.append(b)
                labels.append(int(marks[0]))
        return blocks, np.array(labels, np.float32)


def training_pages(n: int, seed: int) -> list[tuple[list[Block], np.ndarray]]:
    made = _Pages(seed)
    return [p for p in (made.page() for _ in range(n)) if p[0]]


@lru_cache(maxsize=2)
def trained(pages: int = 1100, hidden: int = 16, epochs: int = 28, seed: int = 7) -> BiLSTM:
    """The labeller, trained by Adam on made-up pages; the same for the same arguments."""
    made = sorted(training_pages(pages, seed), key=lambda p: len(p[0]))
    batches = []
    for i in range(0, len(made), 64):
        x, mask = padded([page_vectors(b) for b, _ in made[i : i + 64]])
        y = np.zeros(mask.shape, np.float32)
        for k, (_, labels) in enumerate(made[i : i + 64]):
            y[k, : len(labels)] = labels
        batches.append((x, mask, y))
    model, rng = BiLSTM(DIM, hidden, seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(w) for k, w in model.p.items()}
    step = 0
    for epoch in range(epochs):
        rate = 0.012 * (1 - epoch / epochs) + 0.0005
        for i in rng.permutation(len(batches)):
            _, grads = model.gradients(*batches[i])
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                model.p[k] = (model.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


#: Where no block passes, a run of blocks is the article if their odds against this share multiply to more than one.
LEAST_SHARE = 0.05


def _chosen(p: np.ndarray) -> np.ndarray:
    """The blocks of the article: those of one half or more; if there are none, the run of the greatest odds, if any."""
    if (p >= 0.5).any():
        return p >= 0.5
    q = np.clip(p, 1e-6, 1 - 1e-6)
    gain = np.log(q / (1 - q)) - np.log(LEAST_SHARE / (1 - LEAST_SHARE))
    total = np.concatenate([[0.0], np.cumsum(gain)])
    low = np.minimum.accumulate(total)
    end = int((total - low).argmax())
    begin = int(total[: end + 1].argmin())
    at = np.arange(len(p))
    return (at >= begin) & (at < end) & (total[end] > low[end])


def main_texts(pages: list[str], model: BiLSTM) -> list[str]:
    """The main text of each page; empty where no block belongs to the article."""
    cut = [blocks_of(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, b in enumerate(cut) if b), key=lambda i: len(cut[i]))
    for a, b in slices((len(cut[i]) for i in order), 4096):  # pages of like length share a batch
        some = order[a:b]
        x, mask = padded([page_vectors(cut[i]) for i in some])
        for i, p in zip(some, model.forward(x, mask)):
            out[i] = "\n".join(block.text for block, own in zip(cut[i], _chosen(p[: len(cut[i])])) if own)
    return out


def extract(pages: DataFrame, model: BiLSTM | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    A null or empty html, or one without article blocks, gives an empty text (where no block reaches one half, the likeliest
    run of blocks is taken, if there is one); pages of any length are read whole,
    and repeated rows give repeated rows. Other columns are left out. An empty table gives no rows.
    """
    spark = pages.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page = [p or "" for p in batch.column("html").to_pylist()]
            texts = [t for a, b in slices(map(len, page), 1 << 21) for t in main_texts(page[a:b], shared.value)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), int64([len(t) for t in texts])], ["page_id", "url", "text", "n_chars"])

    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return base.mapInArrow(run, "page_id long, url string, text string, n_chars long")
