"""HTML extraction: a recurrent labeller of text blocks.

A page is cut into blocks, the stretches of text between block-level tags, in page
order. Scripts, styles, comments and other hidden content are never text; character
references are decoded and white space inside a block becomes one space. A
bidirectional LSTM in numpy reads for each block a vector of its tag path (hashed
tags and class, id and role words of all open elements), a vector of its hashed
words, and a few counts; with the context of the whole page it gives each block the
probability of being main text. Blocks at ``KEEP_AT`` or more are joined by newlines.

The labeller is trained here, on pages made by a seeded generator of page layouts
(``make_page``) with known labels, so that it needs no labelled table; training
takes place once per query on the driver and its weights (a few hundred KB) are
broadcast. Extraction is one pass over the pages without a shuffle.

Defined results: null and empty html gives an empty text; unclosed and stray tags
are tolerated; text outside any tag is a block; a page without main text gives an
empty text; a ``<`` that no tag follows is text; pages of any length are read whole, in
time that grows with their length; repeated rows give repeated rows; an empty table
gives none.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

PATH_WIDTH = 64
WORD_WIDTH = 32
COUNTS = 8
HIDDEN = 24
KEEP_AT = 0.5
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mfrac mi mn mo mover mroot mrow msqrt mstyle msub msubsup msup mtext munder munderover semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content that is never shown as text, dropped whole.
HIDDEN_TAGS = frozenset("script style noscript template textarea select svg iframe head title option canvas audio video".split())
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe")}
#: A tag without a ``<`` in it, as most are; no two matches from different ``<`` overlap.
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']|\"[^<\"]*+\"|'[^<']*+')*+)>")
NAME_START = re.compile(r"/?[a-zA-Z]")
NAME_END = re.compile(r"[\s/>]")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++)))?|"[^"]*"|'[^']*'""")
NAMING = frozenset("class id role itemprop".split())
NOT_SHOWN = re.compile(r"display\s*+:\s*+none", re.I)
LONG_NUMBER = re.compile(r"&#([0-9]{1000,});?")
#: An open element that the tag in the key ends.
CLOSES = {t: frozenset(c.split()) for t, c in {"p": "p", "li": "li p", "dt": "dt dd p", "dd": "dt dd p", "tr": "tr td th p", "td": "td th p", "th": "td th p"}.items()} | {
    t: frozenset(["p"])
    for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split()
}


class Path:
    """A place in a page's tree: the elements open there, each by its tag and naming words, as a chain that shares its beginnings."""

    __slots__ = ("depth", "key", "parent", "sum")

    def __init__(self, parent: Path | None = None, key: tuple[str, ...] = ()):
        self.parent, self.key, self.depth = parent, key, parent.depth + 1 if parent else 0
        self.sum = parent.sum + _key_vector(key) if parent else np.zeros(PATH_WIDTH, dtype=np.float32)


class Block:
    __slots__ = ("links", "path", "text")

    def __init__(self, path: Path, text: str, links: int):
        self.path, self.text, self.links = path, text, links


class Scanner:
    """The tags of a page from left to right, in time that grows with its length.

    A ``<`` that no ``>`` outside quotes ends is text. What a failed look ahead has
    learned is kept: where a name ends, the next stop, and the quotes after which no
    ``>`` comes, so that no stretch is read again for each ``<`` before it.
    """

    def __init__(self, page: str):
        self.page, self.last, self.last_data = page, page.rfind(">"), page.rfind("]]>")
        self.known = {NAME_END: (0, -1), STOP: (0, -1)}
        self.dead: set[int] = set()

    def next(self, pattern: re.Pattern, at: int) -> int:
        """Where the pattern is found from ``at`` on; the page's length if nowhere."""
        low, high = self.known[pattern]
        if not low <= at <= high:
            found = pattern.search(self.page, at)
            low, high = at, found.start() if found else len(self.page)
            self.known[pattern] = (low, high)
        return high

    def tag_end(self, at: int) -> int:
        """Where the ``>`` stands that ends a tag whose attributes start at ``at``; -1 if none does."""
        page, seen = self.page, []
        while True:
            stop = self.next(STOP, at)
            if stop < len(page) and page[stop] == ">":
                return stop
            seen.append(stop)
            close = -1 if stop >= len(page) or stop in self.dead else page.find(page[stop], stop + 1)
            if close < 0:
                self.dead.update(seen)
                return -1
            at = close + 1

    def tags(self) -> Iterator[tuple[int, int, str | None, str, str]]:
        """Start, end, slash, name and attributes of each; the slash is None for comments, declarations and the like."""
        page, at, size = self.page, 0, len(self.page)
        while (at := page.find("<", at)) >= 0:
            found = PLAIN_TAG.match(page, at)
            if found:
                end = yield at, found.end(), *found.groups()
            elif page.startswith("<!--", at):
                close = page.find("-->", at + 4)
                end = yield at, close + 3 if close >= 0 else size, None, "", ""
            elif at > self.last:
                # Only a comment can follow without a ">".
                at = page.find("<!--", at)
                if at < 0:
                    return
                continue
            elif page.startswith(("<!", "<?"), at):
                data = at < self.last_data and page.startswith("<![CDATA[", at)
                end = yield at, page.index("]]>", at) + 3 if data else page.index(">", at) + 1, None, "", ""
            elif (start := NAME_START.match(page, at + 1)) and (close := self.tag_end(name := self.next(NAME_END, start.end()))) >= 0:
                slash = page[at + 1] == "/"
                end = yield at, close + 1, "/" if slash else "", page[at + 1 + slash : name], page[name:close]
            else:
                end = at + 1
            at = end

    def raw_end(self, tag: str, at: int) -> int:
        """Where the end tag stands of an element whose content is no markup."""
        found = RAW_END[tag].search(self.page, at)
        return found.start() if found else len(self.page)


def decoded(text: str) -> str:
    """``text`` with its character references decoded; numbers of any length."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = LONG_NUMBER.sub(lambda m: "&#" + (m[1].lstrip("0")[:8] or "0") + ";", text)
    return html.unescape(text)


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page: path, text, characters inside links. Time grows with the page's length, however broken its markup."""
    page = page or ""
    out: list[Block] = []
    # Open elements: tag, path, whether the element hides its content, and the place of the innermost element up to here that is not inline.
    stack: list[tuple[str, Path, bool, int]] = []
    open_tags: Counter = Counter()
    parts: list[str] = []
    root = path = Path()
    hidden = links = in_link = 0

    def flush():
        nonlocal links
        if parts:
            text = " ".join(decoded("".join(parts)).split())
            if text:
                out.append(Block(path, text, links))
            parts.clear()
        links = 0

    def pop():
        nonlocal hidden, in_link, path
        tag, _, gone, _ = stack.pop()
        hidden -= gone
        in_link -= tag == "a"
        open_tags[tag] -= 1
        path = stack[-1][1] if stack else root

    def say(upto: int):
        nonlocal links
        if upto > at and not hidden:
            piece = page[at:upto]
            parts.append(piece)
            if in_link:
                links += len(piece.strip())

    scanner, at = Scanner(page), 0
    tags = scanner.tags()
    found = next(tags, None)
    while found:
        start, end, slash, tag, rest = found
        say(start)
        at = end
        tag = tag.lower()
        if slash is None:
            pass
        elif tag == "br":
            if not hidden:
                parts.append(" ")
        else:
            if tag not in INLINE:
                flush()
            if slash:
                if open_tags[tag]:
                    while stack[-1][0] != tag:
                        pop()
                    pop()
            else:
                ends = CLOSES.get(tag)
                while ends and stack and (i := stack[-1][3]) >= 0 and stack[i][0] in ends:
                    while len(stack) > i:
                        pop()
                if tag not in VOID and not rest.endswith("/"):
                    key, gone = (tag,), tag in HIDDEN_TAGS
                    if rest:
                        for name, *values in ATTRIBUTE.findall(rest):
                            value, name = "".join(values).lower(), name.lower()
                            if name in NAMING:
                                key += tuple(w for w in re.split(r"[^a-z]+", value) if w)
                            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and NOT_SHOWN.search(value)):
                                gone = True
                    if not gone:
                        path = Path(path, key)
                    base = len(stack) if tag not in INLINE else stack[-1][3] if stack else -1
                    stack.append((tag, path, gone, base))
                    open_tags[tag] += 1
                    hidden += gone
                    in_link += tag == "a"
                    if tag in RAW_END:
                        at = end = scanner.raw_end(tag, at)
        try:
            found = tags.send(end)
        except StopIteration:
            break
    say(len(page))
    flush()
    return out


@lru_cache(maxsize=200_000)
def _slot(word: str, width: int) -> tuple[int, float]:
    h = crc32(word.encode())
    return h % width, 1.0 if h >> 31 else -1.0


def _word_slot(word: str) -> tuple[int, float]:
    return (_slot if len(word) < 40 else _slot.__wrapped__)(word, WORD_WIDTH)  # long words are not worth a place in the cache


@lru_cache(maxsize=50_000)
def _key_vector(key: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH_WIDTH, dtype=np.float32)
    for i, word in enumerate(key):
        for name in ((word,) if i else (f"<{word}", f"<tag:{word}")):
            j, sign = _slot(name, PATH_WIDTH)
            v[j] += sign
    return v


@lru_cache(maxsize=50_000)
def _last_vector(key: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH_WIDTH, dtype=np.float32)
    for word in key:
        j, sign = _slot(f"last:{word}", PATH_WIDTH)
        v[j] += sign
    return v


def features(page: list[Block]) -> np.ndarray:
    """(blocks, width) float32."""
    out = np.zeros((len(page), PATH_WIDTH + WORD_WIDTH + COUNTS), dtype=np.float32)
    whole = max(1, sum(len(b.text) for b in page))
    before = 0
    for row, b in zip(out, page, strict=True):
        row[:PATH_WIDTH] = b.path.sum + _last_vector(b.path.key)
        words = b.text.lower().split()
        scale = 1 / (1 + len(words)) ** 0.5
        for w in words:
            j, sign = _word_slot(w.strip(".,:;!?()[]\"'"))
            row[PATH_WIDTH + j] += sign * scale
        n = len(b.text)
        row[PATH_WIDTH + WORD_WIDTH :] = (
            np.log1p(n) / 4 - 1, np.log1p(len(words)) / 3 - 1, min(1.0, b.links / n), sum(map(b.text.count, ".!?")) / (1 + len(words)),
            sum(map(b.text.count, "0123456789")) / n, b.path.depth / 8, before / whole, n / whole,
        )
        before += n
    return out


# --- the network ----------------------------------------------------------------


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    rng, width = np.random.default_rng(seed), PATH_WIDTH + WORD_WIDTH + COUNTS
    w = {}
    for d in "fb":
        w[f"x{d}"] = (rng.standard_normal((width, 4 * HIDDEN)) / width**0.5).astype(np.float32)
        w[f"h{d}"] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) / HIDDEN**0.5).astype(np.float32)
        w[f"c{d}"] = np.zeros(4 * HIDDEN, dtype=np.float32)
        w[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1.0
    w["out"] = (rng.standard_normal((2 * HIDDEN, 1)) / HIDDEN**0.5).astype(np.float32)
    w["skip"] = np.zeros((width, 1), dtype=np.float32)
    w["bias"] = np.zeros(1, dtype=np.float32)
    return w


def _lstm(w: dict, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
    """Hidden states (time, batch, HIDDEN) of one direction; masked steps carry the state on."""
    pre = x @ w[f"x{d}"] + w[f"c{d}"]
    steps, n = x.shape[:2]
    h = c = np.zeros((n, HIDDEN), dtype=np.float32)
    out, kept = np.zeros((steps, n, HIDDEN), dtype=np.float32), []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = pre[t] + h @ w[f"h{d}"]
        i, f, o = (_sigmoid(z[:, j * HIDDEN : (j + 1) * HIDDEN]) for j in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        c2 = f * c + i * g
        tc = np.tanh(c2)
        if keep:
            kept.append((t, i, f, o, g, c, tc, h, m))
        h, c = m * o * tc + (1 - m) * h, m * c2 + (1 - m) * c
        out[t] = h
    return out, kept


def forward(w: dict, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Main-text probability (time, batch)."""
    hf, kf = _lstm(w, "f", x, mask, keep)
    hb, kb = _lstm(w, "b", x, mask, keep)
    h = np.concatenate([hf, hb], axis=2)
    return _sigmoid((h @ w["out"])[..., 0] + (x @ w["skip"])[..., 0] + w["bias"]), (h, kf, kb)


def backward(w: dict, x: np.ndarray, mask: np.ndarray, p: np.ndarray, y: np.ndarray, state) -> dict[str, np.ndarray]:
    h, kf, kb = state
    dz = ((p - y) * mask / max(1.0, mask.sum()))[..., None].astype(np.float32)
    flat = lambda t: t.reshape(-1, t.shape[-1])
    g = {"out": flat(h).T @ flat(dz), "skip": flat(x).T @ flat(dz), "bias": dz.sum(axis=(0, 1))}
    dh_all = dz @ w["out"].T
    for d, kept, part in (("f", kf, slice(0, HIDDEN)), ("b", kb, slice(HIDDEN, 2 * HIDDEN))):
        dpre = np.zeros((*x.shape[:2], 4 * HIDDEN), dtype=np.float32)
        dh = dc = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
        gh = np.zeros_like(w[f"h{d}"])
        for t, i, f, o, gg, c, tc, before, m in reversed(kept):
            dh = dh + dh_all[t][:, part]
            dm = m * dh
            do = dm * tc * o * (1 - o)
            dcell = m * dc + dm * o * (1 - tc * tc)
            z = np.concatenate([dcell * gg * i * (1 - i), dcell * c * f * (1 - f), do, dcell * i * (1 - gg * gg)], axis=1)
            dpre[t] = z
            gh += before.T @ z
            dh = (1 - m) * dh + z @ w[f"h{d}"].T
            dc = (1 - m) * dc + dcell * f
        g[f"h{d}"], g[f"x{d}"], g[f"c{d}"] = gh, flat(x).T @ flat(dpre), dpre.sum(axis=(0, 1))
    return g


def batch(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), pages[0].shape[1]), dtype=np.float32)
    mask = np.zeros((steps, len(pages)), dtype=np.float32)
    for i, p in enumerate(pages):
        x[: len(p), i], mask[: len(p), i] = p, 1
    return x, mask


# --- training pages ---------------------------------------------------------------

NOTES = (
    "cookie cookies accept privacy policy consent settings sign in log register subscribe newsletter email password search menu home about contact "
    "login share tweet follow us copyright all rights reserved terms advertisement sponsored promoted related read more popular trending latest next "
    "previous comments reply says posted by leave a comment tags category archives skip to content download app close notice warning updated join "
    "anmelden datenschutz impressum suche startseite werbung kommentare antworten mehr lesen connexion rechercher accueil publicité commentaires "
    "répondre lire la suite inicio buscar publicidad comentarios responder leer más suscribirse aviso"
).split()
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ment que ción sch lich heit eau tion ing é ü ß ñ".split()
MAIN_NAMES = "content article post main entry story body text article-body post-content entry-content main-content page-content hentry prose".split()
OTHER = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs top-menu site-nav links",
    "header": "header site-header masthead banner top topbar branding",
    "footer": "footer site-footer bottom copyright credits legal colophon",
    "aside": "sidebar aside widget related recommended popular side-column rail trending more-stories",
    "notice": "cookie cookie-banner notice consent alert gdpr popup modal newsletter overlay message",
    "ad": "ad ads advert advertisement sponsor sponsored promo banner-ad adsbox",
    "form": "form search search-form login subscribe signup contact-form",
    "comments": "comments comment comment-list discussion replies responses disqus comment-body reader-comments",
    "share": "share social social-links toolbar meta byline tags post-meta",
}


def _sentence(rng: random.Random, lo: int, hi: int) -> str:
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(lo, hi))]
    return " ".join(words).capitalize() + rng.choice([".", ".", ".", "", "!", "?"])


def _prose(rng: random.Random) -> str:
    text = " ".join(_sentence(rng, 1, 22) for _ in range(rng.choice([1, 1, 2, 3, 5, 8])))
    kind = rng.random()
    if kind < 0.06:
        return re.sub(r"(?<= )(\S+)", lambda m: m[0] + rng.choice(["###", "$$$", "&amp;&amp;", "%%%"]), text)
    if kind < 0.12:
        return text.replace(" ", " | ")
    if kind < 0.15:
        return text.upper().replace(" ", "!! ")
    if kind < 0.17:
        return text + f" {rng.randint(1, 10**9)} {rng.random():.4f}"
    return text


def _short(rng: random.Random) -> str:
    if rng.random() < 0.4:
        return _sentence(rng, 1, 12)
    return " ".join(rng.choice(NOTES) for _ in range(rng.randint(1, 7)))


def make_page(rng: random.Random) -> tuple[str, list[int]]:
    """A page in a random layout, and for each of its blocks whether it is main text."""
    out: list[str] = []
    marks: list[int] = []

    def attributes(names: str | list[str]) -> str:
        if rng.random() < 0.12:
            return ""
        names = names.split() if isinstance(names, str) else names
        kind = rng.choice(["class", "class", "class", "id"])
        picked = rng.sample(names, 1) + (["x" + str(rng.randint(0, 9))] if rng.random() < 0.3 else [])
        return f' {kind}="{" ".join(picked)}"'

    def say(text: str, main: int) -> str:
        marks.append(main)
        return text

    def other(kind: str) -> None:
        real = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        bare = rng.random() < 0.55 and real != "div"
        tag = real if bare else rng.choice(["div", "div", "section"])
        out.append(f"<{tag}{attributes(OTHER[kind]) if tag in ('div', 'section') or rng.random() < 0.4 else ''}>")
        if kind in ("nav", "share") or kind in ("aside", "footer", "header") and rng.random() < 0.5:
            if kind == "aside":
                out.append(f"<h{rng.randint(2, 4)}>{say(_short(rng), 0)}</h3>")
            items = [f'<a href="/{i}">{_sentence(rng, 1, 3) if rng.random() < 0.5 else rng.choice(NOTES)}</a>' for i in range(rng.randint(2, 8))]
            if rng.random() < 0.7:
                out.append("<ul>" + "".join(f"<li>{say(i, 0)}</li>" for i in items) + "</ul>")
            else:
                out.append(say(" | ".join(items), 0))
        elif kind == "comments":
            out.append(f"<h3>{say(_short(rng), 0)}</h3>")
            for _ in range(rng.randint(1, 5)):
                head = say(_short(rng), 0) if rng.random() < 0.6 else ""
                out.append(f"<div{attributes('comment comment-body reply')}>" + (f"<div>{head}</div>" if head else ""))
                out.append(f"<p>{say(_prose(rng), 0)}</p></div>")
        elif kind == "form":
            out.append(f"<label>{say(_short(rng), 0)}</label><div></div><input type='text' name='q'><button>{say(rng.choice(NOTES), 0)}</button>")
        else:
            for _ in range(rng.randint(1, 3)):
                text = _short(rng) if rng.random() < 0.6 else _prose(rng)
                if kind == "footer" and rng.random() < 0.6:
                    text = "&copy; " + text
                out.append(f"<p>{say(text, 0)}</p>" if rng.random() < 0.5 else f"<div>{say(text, 0)}</div>")
        out.append(f"</{tag}>")

    def article() -> None:
        wrap = rng.choice(["article", "article", "main", "div", "div", "section", "td"])
        named = attributes(MAIN_NAMES) if wrap not in ("article", "main") or rng.random() < 0.4 else ""
        depth = rng.randint(0, 2)
        out.append("<div>" * depth + f"<{wrap}{named}>")
        if rng.random() < 0.85:
            out.append(f"<h1>{say(_sentence(rng, 2, 12), 1)}</h1>")
        if rng.random() < 0.2:
            out.append(f"<div{attributes(OTHER['share'])}>{say(_short(rng), 0)}</div>")
        loose = rng.random() < 0.3
        for k in range(rng.randint(1, 16)):
            kind = rng.random()
            if loose and rng.random() < 0.4:
                out.append(f"<p><b>{say(_prose(rng), 1)}<br>")
            elif kind < 0.8:
                text = _prose(rng)
                if rng.random() < 0.2:
                    text = f'{text} <a href="#">{_sentence(rng, 1, 3)}</a> <em>{_sentence(rng, 1, 4)}</em>'
                out.append(f"<p>{say(text, 1)}" + ("</p>" if rng.random() < 0.85 else ""))
            elif kind < 0.86:
                out.append(f"<h2>{say(_sentence(rng, 1, 6), 1)}</h2>")
            elif kind < 0.91:
                out.append("<ul>" + "".join(f"<li>{say(_sentence(rng, 1, 14), 1)}</li>" for _ in range(rng.randint(1, 6))) + "</ul>")
            elif kind < 0.94:
                out.append(f"<blockquote>{say(_prose(rng), 1)}</blockquote>")
            elif kind < 0.97:
                out.append(f"<pre>{say(_prose(rng), 1)}</pre>")
            else:
                other(rng.choice(["ad", "share", "aside", "form", "notice"]))
        out.append(f"</{wrap}>" + "</div>" * depth)

    out.append(f"<!DOCTYPE html><html><head><title>{_sentence(rng, 2, 6)}</title><style>p{{margin:0}}</style></head><body>")
    kinds = ["nav", "header", "notice", "ad", "form", "share", "aside"]
    for kind in rng.sample(kinds, rng.randint(0, 4)):
        other(kind)
    if rng.random() < 0.95:
        article()
    for kind in rng.sample(["comments", "aside", "footer", "ad", "share", "nav", "notice", "form"], rng.randint(0, 4)):
        other(kind)
    if rng.random() < 0.6:
        other("footer")
    out.append("</body></html>")
    return "".join(out), marks


def train(pages: int = 2000, passes: int = 5, seed: int = 11, size: int = 32, rate: float = 0.006) -> dict[str, np.ndarray]:
    """The labeller's weights; the same for the same arguments."""
    rng, data = random.Random(seed), []
    while len(data) < pages:
        page, marks = make_page(rng)
        found = blocks(page)
        if found and len(found) == len(marks):  # a layout whose pieces merge has no label for each block
            data.append((features(found), np.array(marks, dtype=np.float32)))
    w = initial()
    m, s = ({n: np.zeros_like(a) for n, a in w.items()} for _ in range(2))
    t = 0
    for _ in range(passes):
        order = sorted(range(len(data)), key=lambda i: (len(data[i][1]) + rng.random() * 8))
        groups = [order[i : i + size] for i in range(0, len(order), size)]
        rng.shuffle(groups)
        for group in groups:
            x, mask = batch([data[i][0] for i in group])
            y = batch([data[i][1][:, None] for i in group])[0][..., 0]
            p, state = forward(w, x, mask, keep=True)
            g = backward(w, x, mask, p, y, state)
            t += 1
            for n in w:
                m[n] += 0.1 * (g[n] - m[n])
                s[n] += 0.01 * (g[n] ** 2 - s[n])
                w[n] -= rate * (m[n] / (1 - 0.9**t)) / (np.sqrt(s[n] / (1 - 0.99**t)) + 1e-6) + 1e-5 * w[n]
    return w


def label(w: dict, pages: list[list[Block]]) -> list[np.ndarray]:
    """Main-text probability of every block of every page; pages of like length run together."""
    out = [np.zeros(0)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        longest = len(pages[order[min(at + 63, len(order) - 1)]])
        group = order[at : at + max(1, min(64, 40_000 // longest))]
        x, mask = batch([features(pages[i]) for i in group])
        p, _ = forward(w, x, mask)
        for j, i in enumerate(group):
            out[i] = p[: len(pages[i]), j]
        at += len(group)
    return out


def extract_text(df: DataFrame, weights: dict | None = None, html_col: str = "html", keep_at: float = KEEP_AT) -> DataFrame:
    """``df`` without its html column, with text and n_chars (clashing names are replaced)."""
    columns = [c for c in df.columns if c not in (html_col, "text", "n_chars")]
    shared = df.sparkSession.sparkContext.broadcast(weights or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                pages = [blocks(t) for t in part.column(part.num_columns - 1).to_pylist()]
                texts = [
                    "\n".join(k.text for k, p in zip(page, probability, strict=True) if p >= keep_at)
                    for page, probability in zip(pages, label(shared.value, pages), strict=True)
                ]
                more = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *more], names=[*columns, "text", "n_chars"])

    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)
    return df.select(*columns, html_col).mapInArrow(run, f"{schema}text string, n_chars long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
