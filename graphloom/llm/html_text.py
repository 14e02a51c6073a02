"""Operator 9: main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks (text between block-level tags). Each block is a vector: hashed tag-path tokens (tags,
classes, ids and roles of all ancestors), hashed words, length and share of link text. A bidirectional LSTM, written
and trained in numpy, reads all blocks of a page in both directions and marks each as main text or not. It is trained
on pages made here, whose parts are known, also where no name or tag tells them (a third of these pages has made-up
names only, a quarter no element around the article), and on windows of WINDOW blocks of a bounded sample of the input
(SAMPLE_PAGES), labelled by what their tags and names say, with a share of the path tokens left out at random.

Defined results: a null page counts as empty; without main text, text is '' and n_chars 0. Scripts, styles, comments
and markup never give blocks, nor does what lies in svg, noscript or template. These end at '/>', at their end tag or
with their parent, svg also before an HTML element that cannot lie in it; one that has no end tag and only the page as
its parent hides nothing. A br parts blocks. Pages are read one by one, so repeated rows get equal results; extra
columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs, segment_hashes, utf8

#: Pages of the input that training may see, and the blocks that it takes of each; pages made here, of either kind.
SAMPLE_PAGES, WINDOW, MADE_PAGES = 200, 400, 350
BINS, PATH, WORDS, DENSE, HIDDEN = 4096, 12, 6, 3, 12
INPUT = PATH + WORDS + DENSE
EPOCHS, BATCH, RATE = 6, 32, 0.02
#: Blocks that are read side by side.
CELLS = 1 << 15

# HTML's void elements, elements that do not part text, raw-text elements, and self-closing groups.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("table ul ol dl div section article aside nav header footer main form body select td th svg noscript template foreignobject desc".split())
# Hidden elements; those that end an svg by starting in it, and the parts of an svg that may hold them.
UNSEEN = frozenset("svg noscript template".split())
ENDS_SVG = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HTML_IN_SVG, WHOLE = frozenset("foreignobject desc title".split()), frozenset("html head body".split())

#: Tags and names that tell what a part of a page is, for training labels only.
ASIDE_TAGS = "nav header footer aside form menu button select dialog head title label".split()
ASIDE_NAMES = (
    "ad ads advert advertisement adsense sponsor sponsored promo banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent notice alert popup modal "
    "newsletter subscribe signup login form search share social related recommended comments comment reply respond discussion widget toolbar pagination copyright legal disclaimer tags meta"
).split()
MAIN_TAGS = "article main".split()
MAIN_NAMES = "content main article post entry story body text entry-content post-content article-body main-content".split()

_RAW = r"<(script|style|iframe|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)"
_REST = r"|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|</?[a-zA-Z!?][^>]*(?:>|\Z)|[^<]+|<"
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|" + _RAW + _REST, re.S | re.I)
#: Tokens inside an svg, where CDATA is text and no element is raw text; the first group never matches.
_SVG_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|((?!))" + _REST, re.S | re.I)
_HIDDEN_END = re.compile(r"</(svg|noscript|template)\b", re.I)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # tags, and names with a leading dot, from the root
    linked: int  # code points inside links


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks of a page in page order; blocks without text are left out."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    path: tuple[str, ...] = ()
    linked = links = hidden = 0
    grounds: list[int] = []  # places on the stack where svg begins, or HTML inside it
    ends_at: dict[str, int] | None = None  # last end tag of the hidden elements

    def flush() -> None:
        nonlocal held, linked
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            if text:
                found.append(Block(text, path, linked))
        held, linked = [], 0

    def pop(n: int) -> None:
        nonlocal links, hidden
        for tag, _ in stack[n:]:
            links -= tag == "a"
            hidden -= tag in UNSEEN
        while grounds and grounds[-1] >= n:
            grounds.pop()
        del stack[n:]

    at = 0
    while at < len(page):
        svg = bool(grounds) and stack[grounds[-1]][0] == "svg"
        m = (_SVG_TOKEN if svg else _TOKEN).match(page, at)
        at = m.end()
        tag = m[3]
        if tag is None:
            t = m[0]
            if t[0] != "<" or t == "<":
                if hidden:
                    continue
                if not held and not t.isspace():
                    path = tuple(x for _, own in stack for x in own)
                held.append(t)
                linked += len(t) if links else 0
            elif m[1] and m[1].lower() not in ("script", "style"):
                flush()
            continue
        tag = tag.lower()
        if m[2]:
            if tag not in INLINE:
                flush()
            within = hidden
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == tag:
                    pop(n)
                    break
                if tag in INLINE and stack[n][0] not in INLINE and not within:
                    break
                within -= stack[n][0] in UNSEEN
            continue
        if svg and tag in ENDS_SVG:
            while grounds and stack[grounds[-1]][0] == "svg":
                pop(grounds[-1])
        if tag not in INLINE:
            flush()
            ends = CLOSES.get(tag, ()) if tag not in ENDS_P or tag == "p" else ("p",)
            for n in range(len(stack) - 1, -1, -1) if ends else ():
                if stack[n][0] in ends:
                    pop(n)
                    break
                if stack[n][0] in SCOPE:
                    break
        if tag not in VOID and not m[4].endswith("/"):
            if tag in UNSEEN:
                if tag == "noscript" and hidden and any(x == tag for x, _ in stack):
                    continue
                if all(x in WHOLE for x, _ in stack[-1:]):
                    if ends_at is None:
                        ends_at = {e[1].lower(): e.start() for e in _HIDDEN_END.finditer(page)}
                    if ends_at.get(tag, -1) < at:
                        continue
            names = [x for a in _NAMED.findall(m[4]) for x in re.split(r"[\s_]+", "".join(a).lower()) if x]
            stack.append((tag, (tag, *("." + x for x in names))))
            links += tag == "a"
            hidden += tag in UNSEEN
            if tag == "svg" or grounds and tag in HTML_IN_SVG:
                grounds.append(len(stack) - 1)
    flush()
    return found


def told(path: tuple[str, ...]) -> int:
    """Training label of a path: 1 if it lies in a main part and in no other one."""
    main = False
    for x in path:
        if x[0] == ".":
            names = {x[1:], *re.split("[-:]", x[1:])}
            if names & _ASIDE_NAMES and x[1:] not in _MAIN_NAMES:
                return 0
            main |= x[1:] in _MAIN_NAMES
        elif x in _ASIDE_TAGS:
            return 0
        else:
            main |= x in MAIN_TAGS
    return int(main)


_ASIDE_TAGS, _ASIDE_NAMES, _MAIN_NAMES = frozenset(ASIDE_TAGS), frozenset(ASIDE_NAMES), frozenset(MAIN_NAMES)


def made_pages(n: int, rng: np.random.Generator) -> list[str]:
    """Pages with main parts and other parts of many forms, in invented words."""
    syllables = [a + b for a in "b c d f g l m n p r s t v".split() for b in "a e i o u an er on".split()]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    line = lambda lo, hi: " ".join(word() for _ in range(rng.integers(lo, hi)))
    attr = lambda name: f'{rng.choice(["class", "class", "id"])}="{name}"'

    def aside() -> str:
        inner = [
            lambda: "<ul>" + "".join(f'<li><a href="/{word()}">{line(1, 4)}</a></li>' for _ in range(rng.integers(2, 9))) + "</ul>",
            lambda: line(3, 30),
            lambda: "".join(f"<p>{line(3, 25)}</p>" for _ in range(rng.integers(1, 5))),
            lambda: f"<h3>{line(1, 4)}</h3><p>{line(3, 20)}</p>",
            lambda: f'<label>{line(1, 3)}</label><input name="q"><button>{word()}</button>',
            lambda: "".join(f'<div class="{rng.choice(["comment", "comment-body", "reply"])}"><p>{line(4, 30)}</p></div>' for _ in range(rng.integers(1, 5))),
        ][rng.integers(6)]()
        if rng.random() < 0.5:
            tag = rng.choice(ASIDE_TAGS[:7])
            return f"<{tag}>{inner}</{tag}>"
        tag, name = rng.choice(["div", "div", "section", "ul", "p", "table"]), rng.choice(ASIDE_NAMES)
        name += rng.choice(["", "", "-" + word(), "-box", "-list", "-wrap"])
        return f"<{tag} {attr(name)}>{inner}</{tag}>"

    def main() -> str:
        parts = [f"<h1>{line(2, 9)}</h1>"] * (rng.random() < 0.8)
        for _ in range(rng.integers(1, 9)):
            k = rng.integers(8)
            parts.append(f"<h2>{line(1, 6)}</h2>" if k == 0 else "<ul>" + f"<li>{line(2, 12)}</li>" * rng.integers(1, 5) + "</ul>" if k == 1 else f"<p><b>{line(1, 9)}<br><p>{line(3, 60)}</p>" if k == 2 else f"<blockquote>{line(3, 20)}</blockquote>" if k == 3 else f'<p>{line(2, 9)} <a href="/">{line(1, 4)}</a> {line(1, 60)}</p>')
            if rng.random() < 0.15:
                parts.append(aside())
        return "".join(parts)

    def whole() -> str:
        inner = main()
        k = rng.integers(4)
        own = f"<article>{inner}</article>" if k < 2 else f"<main>{inner}</main>" if k == 2 else f"<div {attr(rng.choice(MAIN_NAMES))}>{inner}</div>"
        for _ in range(rng.integers(0, 3)):
            tag = rng.choice(["div", "section", "main"])
            own = f"<{tag} {attr(word())}>{aside() * (rng.random() < 0.3)}{own}{aside() * (rng.random() < 0.3)}</{tag}>"
        before, after = ("".join(aside() for _ in range(rng.integers(0, 4))) for _ in range(2))
        return f"<html><head><title>{line(1, 9)}</title></head><body>{before}{own}{after}" + "</body></html>" * (rng.random() < 0.8)

    return [whole() for _ in range(n)]


#: Starts every piece of main text of a marked page; a private-use character.
MARK = "\ue000"
#: Words that parts beside the main text often have.
NOTES = (
    "We use cookies to improve this site|Accept all cookies|Subscribe to our newsletter|Sign in|Log in or register|Share this page|Advertisement|Sponsored content|Copyright 2020 all rights reserved|"
    "Privacy policy|Terms of use|Read more|Related articles|Leave a reply|Comments|Follow us|Search|Back to top|Contact us"
).split("|")


def marked_pages(n: int, rng: np.random.Generator, anonymous: float = 0.35) -> list[str]:
    """Pages whose main text is marked. A share is anonymous: no tag or name says what a part is."""
    syllables = [a + b for a in "b c d f g l m n p r s t v".split() for b in "a e i o u an er on".split()]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    line = lambda lo, hi: " ".join(word() for _ in range(rng.integers(lo, hi)))
    pick = lambda of: of[rng.integers(len(of))]

    def page() -> str:
        blind = rng.random() < anonymous

        def part(names: list[str], inner: str, tags: list[str]) -> str:
            """An element that one of the names describes, by tag or by class, id or role; by neither on a blind page."""
            if not blind and tags and rng.random() < 0.4:
                return f"<{(t := pick(tags))}>{inner}</{t}>"
            name = word() if blind else pick(names) + pick(["", "", "", "-" + word(), "-box", "-list"])
            name = pick(["", word() + "-", word() + " "]) + name if rng.random() < 0.3 else name
            tag = pick(["div", "div", "section", "ul" if "<li" in inner else "div"])
            return f'<{tag} {pick(["class", "class", "id"])}="{name}">{inner}</{tag}>'

        links = lambda lo, hi: "<ul>" + "".join(f'<li><a href="/{word()}">{line(1, 4)}</a></li>' for _ in range(rng.integers(lo, hi))) + "</ul>"
        flat = lambda: " | ".join(f'<a href="/">{line(1, 3)}</a>' for _ in range(rng.integers(2, 7)))
        noted = lambda: pick(NOTES) + (" " + line(1, 9) if rng.random() < 0.5 else "")
        prose = lambda lo, hi: "".join(f"<p>{line(lo, hi)}</p>" for _ in range(rng.integers(1, 4)))

        def comments() -> str:
            one = lambda: pick([f"<p>{line(2, 30)}</p>", f"<b>{line(1, 3)}</b> <p>{line(2, 30)}</p>", f"<cite>{line(1, 3)}</cite><p>{line(4, 40)}</p><a href='#'>{word()}</a>", line(2, 30)])
            tag = pick(["div", "li", "p", "article"])
            rows = "".join(f'<{tag} class="{pick(["comment", "comment-body", "reply", "comment " + word()])}">{one()}</{tag}>' if rng.random() < 0.5 else f"<div>{one()}</div>" for _ in range(rng.integers(1, 6)))
            return part(["comments", "comments", "comment", "replies", "respond", "discussion", "comment-list"], f"<h3>{noted()}</h3>" * (rng.random() < 0.4) + rows, [])

        beside = [
            lambda: part(["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs"], pick([links(2, 9), flat()]), ["nav", "header", "menu"]),
            lambda: part(["header", "masthead", "banner", "toolbar"], f"<a href='/'>{line(1, 3)}</a>" + flat() * (rng.random() < 0.5), ["header"]),
            lambda: part(["footer", "copyright", "legal", "disclaimer"], pick([noted(), "&copy; 20" + line(1, 5), flat(), links(2, 6), f"<p>{noted()}</p>"]), ["footer"]),
            lambda: part(["cookie", "cookies", "cookie-notice", "consent", "notice", "alert", "popup", "modal"], f"<p>{noted()}</p>" * (rng.random() < 0.6) or noted(), ["dialog"]) + "",
            lambda: part(["newsletter", "subscribe", "signup", "login", "search", "form"], f"<label>{noted()}</label><input><button>{word()}</button>", ["form"]),
            lambda: part(["ad", "ads", "advert", "advertisement", "adsense", "sponsor", "sponsored", "promo", "banner"], pick([noted(), f"<a href='/'>{line(2, 9)}</a>", line(2, 9) if not blind else noted()]), []),
            lambda: part(["sidebar", "related", "recommended", "widget", "social", "share", "tags", "pagination"], f"<h3>{noted()}</h3>" * (rng.random() < 0.6) + pick([links(1, 7), flat()] + [prose(2, 25)] * (not blind)), ["aside"]),
        ]
        if not blind:
            beside.append(comments)
        within = [beside[3], beside[5], beside[6]] + [comments, comments] * (not blind)

        def main() -> str:
            head = [f"<{(t := pick(['h1', 'h1', 'h2']))}>{MARK}{line(1, 9)}</{t}>"] * (rng.random() < 0.8)
            parts = []
            long = 60 if rng.random() < 0.8 else 12
            for _ in range(rng.integers(1, 9)):
                k = rng.integers(9)
                own = f"<p>{MARK}{line(1 if rng.random() < 0.2 else 6, long + 1)}</p>"
                if k == 0:
                    own = f"<h2>{MARK}{line(1, 6)}</h2>" + own
                elif k == 1:
                    own += "<ul>" + "".join(f"<li>{MARK}{line(2, 14)}</li>" for _ in range(rng.integers(1, 6))) + "</ul>"
                elif k == 2:
                    own = f"<p>{MARK}{line(1, 30)}<br>{MARK}{line(1, 30)}<p>{MARK}{line(3, long + 1)}"
                elif k == 3:
                    own += f"<blockquote>{MARK}{line(3, 20)}</blockquote>"
                elif k == 4:
                    own = f'<p>{MARK}{line(4, 20)} <a href="/">{line(1, 4)}</a> {line(2, long + 1)} <em>{line(1, 3)}</em></p>'
                elif k == 5:
                    own = f"<div>{MARK}{line(5, long + 1)}</div>"
                elif k == 6 and rng.random() < 0.3:
                    own += "<table>" + "".join(f"<tr><td>{MARK}{line(1, 4)}</td><td>{MARK}{line(1, 4)}</td></tr>" for _ in range(rng.integers(1, 4))) + "</table>"
                parts.append(own)
                if rng.random() < 0.12:
                    parts.append(pick(within)())
            if rng.random() < 0.3 and not blind:
                parts.append(comments())
            return "".join([*head, *parts])

        own, k = main(), rng.random()
        if k < 0.25:
            pass  # nothing but the body
        elif k < 0.45 or blind:
            own = f"<div class='{word()}'>{own}</div>"
        else:
            own = pick([f"<article>{own}</article>", f"<main>{own}</main>", f'<div {pick(["class", "id"])}="{pick(MAIN_NAMES)}">{own}</div>', f"<main><article>{own}</article></main>"])
        for _ in range(rng.integers(0, 3)):
            own = f'<div class="{pick([word(), "wrap", "container", "page", "row", "col"])}">{own}</div>'
        before, after = ("".join(pick(beside)() for _ in range(rng.integers(0, 4))) for _ in range(2))
        return f"<html><head><title>{line(1, 9)}</title></head><body>{before}{own}{after}" + "</body></html>" * (rng.random() < 0.8)

    return [page() for _ in range(n)]


def unmarked(page: str) -> tuple[list[Block], np.ndarray]:
    """Blocks of a marked page, without the marks, and which are main text."""
    own = blocks_of(page)
    return [Block(b.text.replace(MARK, ""), b.path, b.linked) for b in own], np.array([MARK in b.text for b in own], np.float32)


_bins: dict[str, int] = {}


def path_bin(token: str) -> int:
    """A bin for a path token, by a hash that does not change between processes."""
    got = _bins.get(token)
    if got is None:
        if len(_bins) > 1 << 16:
            _bins.clear()
        raw = np.frombuffer(token.encode(), np.uint8)
        got = _bins[token] = int(segment_hashes(raw, np.array([0]), np.array([len(raw)]))[0] % np.uint64(BINS))
    return got


@dataclass
class Features:
    """Blocks of pages, one after another: bins of path tokens and of words with their first places, and dense values."""

    path: np.ndarray
    path_at: np.ndarray
    word: np.ndarray
    word_n: np.ndarray
    dense: np.ndarray


def features(blocks: list[Block]) -> Features:
    paths = []
    for b in blocks:
        own = {x for t in b.path for x in ((t, *("." + y for y in re.split("[-:]", t[1:]))) if t[0] == "." and ("-" in t or ":" in t) else (t,))}
        paths.append([path_bin(x) for x in own] + [path_bin("@" + (b.path[-1] if b.path else ""))])
    sizes = np.array([len(p) for p in paths])
    data, offsets = utf8(pa.array([b.text for b in blocks], pa.large_string()))
    starts, ends = runs(data > 32, offsets)
    words = (segment_hashes(data, starts, ends) % np.uint64(BINS)).astype(np.int64)
    owner = np.searchsorted(offsets, starts, "right") - 1
    n = np.bincount(owner, minlength=len(blocks))
    chars = np.array([len(b.text) for b in blocks])
    linked = np.array([b.linked for b in blocks])
    dense = np.stack([np.log1p(chars) / 5, np.minimum(linked / np.maximum(chars, 1), 1), np.log1p(n) / 4], axis=1).astype(np.float32)
    return Features(np.concatenate([np.array(p) for p in paths]), np.cumsum(sizes) - sizes, words, n, dense)


def _mean(table: np.ndarray, bins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean table row of each block's bins; zero without any."""
    out = np.zeros((len(counts), table.shape[1]), np.float32)
    some = np.flatnonzero(counts)
    if len(some):
        at = (np.cumsum(counts) - counts)[some]
        out[some] = np.add.reduceat(table[bins], at, axis=0) / counts[some][:, None]
    return out


def _counts(f: Features) -> np.ndarray:
    return np.diff(np.r_[f.path_at, len(f.path)])


class Labeller:
    """The network: two embedding tables, an LSTM for each direction, one output."""

    def __init__(self, rng: np.random.Generator):
        n = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
        self.w = {"path": n(BINS, PATH), "word": 0.1 * n(BINS, WORDS), "out": n(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.w |= {f"{d}x": n(INPUT, 4 * HIDDEN), f"{d}h": n(HIDDEN, 4 * HIDDEN), f"{d}c": np.zeros(4 * HIDDEN, np.float32)}

    def inputs(self, f: Features) -> np.ndarray:
        n = _counts(f)
        return np.concatenate([_mean(self.w["path"], f.path, n) * np.sqrt(n, dtype=np.float32)[:, None], _mean(self.w["word"], f.word, f.word_n), f.dense], axis=1)

    def run(self, x: np.ndarray, real: np.ndarray, d: str, keep: dict | None = None) -> np.ndarray:
        """States (T, B, H) for inputs (T, B, INPUT); outside `real` the state is zero."""
        steps, lanes, _ = x.shape
        a = x @ self.w[f"{d}x"] + self.w[f"{d}c"]
        h, c = np.zeros((2, lanes, HIDDEN), np.float32)
        out = np.empty((steps, lanes, HIDDEN), np.float32)
        kept = []
        for t in range(steps):
            v = a[t] + h @ self.w[f"{d}h"]
            i, o, g = 0.5 + 0.5 * np.tanh(0.5 * v[:, :HIDDEN]), 0.5 + 0.5 * np.tanh(0.5 * v[:, HIDDEN : 2 * HIDDEN]), np.tanh(v[:, 2 * HIDDEN : 3 * HIDDEN])
            f = 0.5 + 0.5 * np.tanh(0.5 * (v[:, 3 * HIDDEN :] + 1))
            before, prior = c, h
            on = real[t][:, None]
            c = (f * c + i * g) * on
            th = np.tanh(c)
            h = o * th * on
            out[t] = h
            if keep is not None:
                kept.append((i, o, g, f, before, prior, th, on))
        if keep is not None:
            keep["steps"] = kept
        return out

    def back(self, x: np.ndarray, d: str, keep: dict, dout: np.ndarray, grads: dict) -> np.ndarray:
        """Backpropagation through time; returns the loss by input."""
        steps, lanes, _ = x.shape
        da = np.empty((steps, lanes, 4 * HIDDEN), np.float32)
        dh, dc = np.zeros((2, lanes, HIDDEN), np.float32)
        wh = self.w[f"{d}h"]
        gh = np.zeros_like(wh)
        for t in range(steps - 1, -1, -1):
            i, o, g, f, before, prior, th, on = keep["steps"][t]
            dh = (dh + dout[t]) * on
            dc = (dc + dh * o * (1 - th * th)) * on
            da[t] = np.concatenate([dc * g * i * (1 - i), dh * th * o * (1 - o), dc * i * (1 - g * g), dc * before * f * (1 - f)], axis=1)
            gh += prior.T @ da[t]
            dh, dc = da[t] @ wh.T, dc * f
        grads[f"{d}h"], grads[f"{d}c"] = gh, da.sum(axis=(0, 1))
        grads[f"{d}x"] = x.reshape(-1, INPUT).T @ da.reshape(-1, 4 * HIDDEN)
        return da @ self.w[f"{d}x"].T

    def marks(self, f: Features, pages: np.ndarray) -> np.ndarray:
        """Whether each block is main text; pages has the number of blocks of every page."""
        out = np.zeros(len(f.dense), bool)
        if not len(out):
            return out
        x, first = self.inputs(f), np.cumsum(pages) - pages
        order = np.argsort(pages, kind="stable")
        i = np.searchsorted(pages[order], 1)
        while i < len(order):
            j = i + 1
            while j < len(order) and pages[order[j]] * (j + 1 - i) <= CELLS:
                j += 1
            at, real = placed(first[order[i:j]], pages[order[i:j]])
            xs = x[at] * real[:, :, None]
            both = np.concatenate([self.run(xs, real, "f"), self.run(xs[::-1], real[::-1], "b")[::-1]], axis=2)
            out[at[real]] = (both @ self.w["out"] + self.w["bias"] > 0)[real]
            i = j
        return out


def placed(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block numbers (T, B) of pages side by side, and which are real."""
    t = np.arange(n.max())[:, None]
    return first + np.minimum(t, n - 1), t < n


def train(pages: list[list[Block]], seed: int = 3) -> Labeller:
    """Fit on pages made here and on those given, as blocks, that have main text by their tags and names."""
    rng = np.random.default_rng(seed)
    seen = [x for p in marked_pages(3 * MADE_PAGES, rng) if len((x := unmarked(p))[0])]
    for own in [*(blocks_of(p) for p in made_pages(MADE_PAGES, rng)), *pages]:
        labels = [told(b.path) for b in own]
        if 0 < sum(labels):
            seen.append((own, np.array(labels, np.float32)))
    m = Labeller(rng)
    first, second = ({k: np.zeros_like(v) for k, v in m.w.items()} for _ in range(2))
    made = [(features(own), y) for own, y in seen]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(made))
        for i in range(0, len(order), BATCH):
            part = [made[k] for k in order[i : i + BATCH]]
            sizes = np.array([len(y) for _, y in part])
            f = Features(np.concatenate([p.path for p, _ in part]), np.zeros(0), np.concatenate([p.word for p, _ in part]), np.concatenate([p.word_n for p, _ in part]), np.concatenate([p.dense for p, _ in part]))
            counts = np.concatenate([_counts(p) for p, _ in part])
            stays = rng.random(len(f.path)) > 0.1
            counts = np.add.reduceat(stays, np.cumsum(counts) - counts).astype(np.int64)
            f.path = f.path[stays]
            f.path_at = np.cumsum(counts) - counts
            x, y = m.inputs(f), np.concatenate([y for _, y in part])
            x[:, PATH : PATH + WORDS] *= rng.random(len(x))[:, None] < 0.5  # words alone shall not decide
            at, real = placed(np.cumsum(sizes) - sizes, sizes)
            xs = x[at] * real[:, :, None]
            kf, kb, g = {}, {}, {}
            hf, hb = m.run(xs, real, "f", kf), m.run(xs[::-1], real[::-1], "b", kb)
            both = np.concatenate([hf, hb[::-1]], axis=2)
            p = 1 / (1 + np.exp(-np.clip(both @ m.w["out"] + m.w["bias"], -30, 30)))
            dv = ((p - y[at]) * real / real.sum()).astype(np.float32)
            g["out"], g["bias"] = np.einsum("tbh,tb->h", both, dv), np.array([dv.sum()], np.float32)
            dboth = dv[:, :, None] * m.w["out"]
            dx = m.back(xs, "f", kf, dboth[:, :, :HIDDEN], g) + m.back(xs[::-1], "b", kb, dboth[::-1, :, HIDDEN:], g)[::-1]
            d = np.zeros_like(x)
            d[at[real]] = dx[real]
            g["path"], g["word"] = np.zeros_like(m.w["path"]), np.zeros_like(m.w["word"])
            np.add.at(g["path"], f.path, np.repeat(d[:, :PATH] / np.sqrt(np.maximum(counts, 1))[:, None], counts, axis=0))
            np.add.at(g["word"], f.word, np.repeat(d[:, PATH : PATH + WORDS] / np.maximum(f.word_n, 1)[:, None], f.word_n, axis=0))
            step += 1
            rate = RATE * 0.7**epoch
            for k, w in m.w.items():  # Adam
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.01 * (g[k] ** 2 - second[k])
                w -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return m


PAGES_AT_ONCE = 256


def extract(pages: list[str | None], m: Labeller) -> list[str]:
    """Main text of each page."""
    out = []
    for i in range(0, len(pages), PAGES_AT_ONCE):
        own = [blocks_of(p or "") for p in pages[i : i + PAGES_AT_ONCE]]
        every = [b for p in own for b in p]
        main = m.marks(features(every), np.array([len(p) for p in own])).tolist() if every else []
        at = 0
        for p in own:
            out.append("\n".join(b.text for b, keep in zip(p, main[at : at + len(p)], strict=True) if keep))
            at += len(p)
    return out


def _extracted(m: Labeller):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, PAGES_AT_ONCE):
                part = b.slice(i, PAGES_AT_ONCE)
                text = extract(part.column(2).to_pylist(), m)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def _windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A window of WINDOW blocks of each page, from a place that its url decides, for training."""
    for b in batches:
        rows = [[], [], []]
        for url, page in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            own = blocks_of(page or "")
            at = zlib.crc32((url or "").encode()) % max(1, len(own) - WINDOW + 1)
            own = own[at : at + WINDOW]
            for x, y in zip(rows, ([b.text for b in own], ["\n".join(b.path) for b in own], [b.linked for b in own]), strict=True):
                x.append(y)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows[0], pa.list_(pa.string())), pa.array(rows[1], pa.list_(pa.string())), pa.array(rows[2], pa.list_(pa.int32()))], names=["page_id", "text", "path", "linked"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    n = pages.count()
    share = F.pmod(F.xxhash64("page_id", F.lit("html")), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE_PAGES / max(n, 1)))
    got = pages.filter(share).mapInArrow(_windowed, "page_id long, text array<string>, path array<string>, linked array<int>").limit(4 * SAMPLE_PAGES).collect()
    seen = sorted(got, key=lambda r: (r.page_id is None, r.page_id or 0, r.text))
    model = train([[Block(t, tuple(p.split("\n")) if p else (), n) for t, p, n in zip(r.text, r.path, r.linked, strict=True)] for r in seen])
    return pages.mapInArrow(_extracted(model), "page_id long, url string, text string, n_chars long")
