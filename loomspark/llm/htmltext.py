"""Main text of web pages: a recurrent block labeller.

A page is cut into leaf blocks, the runs of text between block-level tags. Each block is read as
learned vectors of its tag path (tags with their class, id and role words) and of its
hashed words, with a few counts. A bidirectional LSTM in numpy runs over all blocks of the
page, so a block is judged with the whole document around it. The network is fitted on
generated pages of many layouts whose blocks carry labels.
"""

from __future__ import annotations

import html as htmllib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import bound_batches

#: Elements that start or end a block (fixed values of the markup language).
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol optgroup option p pre section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
RAW = frozenset("script style noscript template iframe svg math object textarea canvas audio video noframes".split())
#: An opening tag closes these open siblings.
CLOSES = {t: ("p",) for t in BLOCKS - {"option", "optgroup", "link", "meta", "title"}} | {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
#: A closing search stops at these.
FENCES = frozenset("ul ol dl table article section div nav aside main body".split())
#: A quote opens a value right after the equals sign only; one that is never closed is a plain character.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=(?:\s*+(?:"[^"]*+"|'[^']*+'))?+)*+)>""", re.S)
ATTRS = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop|aria-label)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++)""", re.I)
NAME = re.compile(r"[a-z]+")
PATH_ROWS, WORD_ROWS, PATH_DIM, WORD_DIM, COUNTS, HIDDEN = 1024, 2048, 16, 8, 6, 16
#: Scale of sums along a path, and what is left of an element's words one element further in.
SCALE, FADE = 0.4, 0.5
#: Generated pages the network is fitted on, and passes over them.
PAGES, PASSES = 2000, 8
#: Blocks (with padding) of one batch of pages.
BATCH = 20_000


class Cut:
    """A page cut into leaf blocks, and the tree of its elements.

    Element 0 is the page. parent, level and words (tag, class, id and role words) are of
    elements in page order; of blocks: element, text, and the share of the text in links.
    """

    def __init__(self):
        self.parent, self.level, self.words = [0], [0], [()]
        self.element: list[int] = []
        self.text: list[str] = []
        self.links: list[float] = []

    def path(self, block: int) -> tuple[str, ...]:
        """All words of the elements around a block, outermost first."""
        out, at = [], self.element[block]
        while at:
            out.append(self.words[at])
            at = self.parent[at]
        return tuple(w for words in reversed(out) for w in words)


def blocks(page: str) -> Cut:
    """The leaf blocks of a page that have text; linear in its length."""
    out = Cut()
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    held: list[str] = []
    linked = 0
    at_element = -1

    def flush() -> None:
        nonlocal held, linked, at_element
        if held:
            text = " ".join(htmllib.unescape("".join(held)).split())
            if text:
                out.element.append(max(at_element, 0))
                out.text.append(text)
                out.links.append(min(1.0, linked / max(1, len(text))))
        held, linked, at_element = [], 0, -1

    def add(piece: str) -> None:
        nonlocal at_element, linked
        if not piece:
            return
        if at_element < 0 and not piece.isspace():
            at_element = stack[-1][1] if stack else 0
        held.append(piece)
        if opened["a"]:
            linked += len(piece.strip())

    def close(place: int) -> None:
        for t, _ in stack[place:]:
            opened[t] -= 1
        del stack[place:]

    at, end = 0, len(page)
    last = page.rfind(">")
    while at < end:
        m = TAG.search(page, at) if at <= last else None
        if not m:  # nothing closes any more; only a comment can still hide the rest
            rest = page.find("<!--", at)
            add(page[at : rest if rest >= 0 else end])
            break
        add(page[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            if m.group().startswith("<![CDATA["):
                add(m.group()[9:].removesuffix("]]>"))
            continue
        tag = m.group(2).lower()
        if m.group(1):
            if tag in BLOCKS:
                flush()
            if opened[tag]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        close(i)
                        break
                    if stack[i][0] in FENCES and tag not in BLOCKS:
                        break
            continue
        if tag in RAW:
            if not m.group(3).rstrip().endswith("/"):
                shut = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = shut.end() if shut else end
            add(" ")
            continue
        if tag in BLOCKS:
            flush()
            shuts = CLOSES.get(tag, ())
            if any(opened[t] for t in shuts):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in shuts:
                        close(i)
                        break
                    if stack[i][0] in FENCES:
                        break
        if tag in VOID:
            if tag == "br":
                add(" ")
            continue
        words = [tag]
        for name, value in ATTRS.findall(m.group(3)) if m.group(3) else ():
            words += [f"{name[0].lower()}:{w}" if name[0] in "rR" else f".{w}" for w in NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())]
        above = stack[-1][1] if stack else 0
        out.parent.append(above)
        out.level.append(out.level[above] + 1)
        out.words.append(tuple(words))
        stack.append((tag, len(out.parent) - 1))
        opened[tag] += 1
    flush()
    return out


@lru_cache(maxsize=200_000)
def _row(token: str, rows: int) -> int:
    return 1 + zlib.crc32(token.encode("utf-8", "surrogatepass")) % (rows - 1)


@dataclass
class Encoded:
    """A page as numbers: its element tree with rows of path words, and its blocks with rows of words and counts."""

    parent: np.ndarray
    level: np.ndarray
    path: np.ndarray  # rows of the path table, element after element
    path_n: np.ndarray  # how many of them each element has
    element: np.ndarray
    word: np.ndarray
    word_n: np.ndarray
    counts: np.ndarray

    def __len__(self) -> int:
        return len(self.element)


def encoded(page: Cut) -> Encoded:
    """All path words of all elements and all words of all blocks."""
    n = len(page.text)
    counts, words = np.zeros((n, COUNTS), np.float32), [t.lower().split() for t in page.text]
    for i, (text, links) in enumerate(zip(page.text, page.links, strict=True)):
        counts[i] = (np.log1p(len(text)) / 8, links, min(1.0, len(words[i]) / 64), text.count(".") / (1 + len(text) / 50), i / n, float(text[-1] in ".!?:\"'"))
    ints = lambda xs: np.fromiter(xs, np.int32)
    return Encoded(
        np.array(page.parent, np.int32), np.array(page.level, np.int32), ints(_row(w, PATH_ROWS) for ws in page.words for w in ws), ints(map(len, page.words)),
        np.array(page.element, np.int32), ints(_row(w, WORD_ROWS) for ws in words for w in ws), ints(map(len, words)), counts,
    )


@dataclass
class Batch:
    """Several pages as one forest: elements of all pages, and blocks laid out as (page, place) with a mask."""

    parent: np.ndarray
    levels: list[np.ndarray]  # elements by level, the pages' roots left out
    path: np.ndarray
    path_n: np.ndarray
    element: np.ndarray  # of each block
    word: np.ndarray
    word_n: np.ndarray
    counts: np.ndarray
    page: np.ndarray
    place: np.ndarray
    mask: np.ndarray


def batched(pages: list[Encoded]) -> Batch:
    first = np.cumsum([0] + [len(p.parent) for p in pages])
    level = np.concatenate([p.level for p in pages])
    order = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[order], np.arange(1, level.max() + 2)) if len(level) else [0]
    sizes = [len(p) for p in pages]
    page = np.repeat(np.arange(len(pages)), sizes)
    place = np.concatenate([np.arange(n) for n in sizes])
    mask = np.zeros((len(pages), max(sizes)), np.float32)
    mask[page, place] = 1
    join = lambda name: np.concatenate([getattr(p, name) for p in pages])
    return Batch(
        np.concatenate([p.parent + f for p, f in zip(pages, first, strict=False)]), [order[s:e] for s, e in zip(cuts, cuts[1:], strict=False)], join("path"), join("path_n"),
        np.concatenate([p.element + f for p, f in zip(pages, first, strict=False)]), join("word"), join("word_n"), join("counts"), page, place, mask,
    )


def summed(table: np.ndarray, rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sum of the table rows of each owner; owner i has the next n[i] rows."""
    out = np.zeros((len(n), table.shape[1]), np.float32)
    have = np.flatnonzero(n)
    if len(have):
        out[have] = np.add.reduceat(table[rows], np.concatenate([[0], np.cumsum(n[have])[:-1]]), axis=0)
    return out


class Labeller:
    """Embedding sums, a bidirectional LSTM, and one logit for each block; words never seen in fitting stay near zero."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        inputs = 2 * PATH_DIM + WORD_DIM + COUNTS
        self.p = {"path": r.normal(0, 0.01, (PATH_ROWS, PATH_DIM)), "near": r.normal(0, 0.01, (PATH_ROWS, PATH_DIM)), "word": r.normal(0, 0.01, (WORD_ROWS, WORD_DIM)), "out": r.normal(0, 0.2, 2 * HIDDEN), "skip": r.normal(0, 0.1, inputs), "bias": np.zeros(1)}
        for d in ("fwd", "bwd"):
            self.p[d] = r.normal(0, 0.25, (inputs + HIDDEN + 1, 4 * HIDDEN))
            self.p[d][-1, HIDDEN : 2 * HIDDEN] = 1  # forget gates start open
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _inputs(self, b: Batch) -> np.ndarray:
        """Inputs of every block; sums along paths go level by level, one plain, one that fades with the distance."""
        path, near = summed(self.p["path"], b.path, b.path_n), summed(self.p["near"], b.path, b.path_n)
        for at in b.levels:
            path[at] += path[b.parent[at]]
            near[at] += FADE * near[b.parent[at]]
        word = summed(self.p["word"], b.word, b.word_n) / np.maximum(b.word_n, 1)[:, None]
        return np.concatenate([path[b.element] * SCALE, near[b.element] * SCALE, word, b.counts], 1).astype(np.float32)

    def _lstm(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        n, t, _ = x.shape
        w = self.p[d]
        h = c = np.zeros((n, HIDDEN), np.float32)
        pre = x @ w[: x.shape[2]] + w[-1]
        rec, out, kept = w[x.shape[2] : -1], np.zeros((n, t, HIDDEN), np.float32), []
        for i in range(t) if d == "fwd" else range(t - 1, -1, -1):
            z = pre[:, i] + h @ rec
            gate = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, i, None]
            c2 = gate[:, HIDDEN : 2 * HIDDEN] * c + gate[:, :HIDDEN] * g
            th = np.tanh(c2)
            h2 = gate[:, 2 * HIDDEN : 3 * HIDDEN] * th
            if keep:
                kept.append((i, h, c, gate, g, th, m))
            h, c = h2 * m + h * (1 - m), c2 * m + c * (1 - m)
            out[:, i] = h
        return out, kept

    def _lstm_back(self, x: np.ndarray, kept: list, gout: np.ndarray, d: str) -> tuple[np.ndarray, np.ndarray]:
        w = self.p[d]
        rec = w[x.shape[2] : -1]
        gw, gx = np.zeros_like(w), np.zeros_like(x)
        gh = gc = np.zeros((len(x), HIDDEN), np.float32)
        for i, h, c, gate, g, th, m in reversed(kept):
            gi, gf, go = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
            a = gh + gout[:, i]
            ah, ac = a * m, gc * m
            ac = ac + ah * go * (1 - th**2)
            dz = np.concatenate([ac * g * gi * (1 - gi), ac * c * gf * (1 - gf), ah * th * go * (1 - go), ac * gi * (1 - g**2)], 1)
            gw[: x.shape[2]] += x[:, i].T @ dz
            gw[x.shape[2] : -1] += h.T @ dz
            gw[-1] += dz.sum(0)
            gx[:, i] = dz @ w[: x.shape[2]].T
            gh = dz @ rec.T + a * (1 - m)
            gc = ac * gf + gc * (1 - m)
        return gw, gx

    def logits(self, b: Batch, keep: bool = False):
        flat = self._inputs(b)
        x = np.zeros((*b.mask.shape, flat.shape[1]), np.float32)
        x[b.page, b.place] = flat
        f, kf = self._lstm(x, b.mask, "fwd", keep)
        w, kb = self._lstm(x, b.mask, "bwd", keep)
        h = np.concatenate([f, w], -1)
        z = h @ self.p["out"] + x @ self.p["skip"] + self.p["bias"][0]
        return (z, x, h, kf, kb) if keep else z

    def fit(self, pages: list[Encoded], labels: list[np.ndarray], passes: int = PASSES, batch: int = 50, rate: float = 5e-3) -> Labeller:
        r = np.random.default_rng(1)
        m, v, t = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        for turn in range(passes):
            order = r.permutation(len(pages))
            for s in range(0, len(order), batch):
                pick = order[s : s + batch]
                b = batched([pages[i] for i in pick])
                y = np.zeros(b.mask.shape, np.float32)
                y[b.page, b.place] = np.concatenate([labels[i] for i in pick])
                z, x, h, kf, kb = self.logits(b, True)
                gz = (1 / (1 + np.exp(-z)) - y) * b.mask / b.mask.sum()
                gh = gz[..., None] * self.p["out"]
                gf, gxf = self._lstm_back(x, kf, gh[..., :HIDDEN], "fwd")
                gb, gxb = self._lstm_back(x, kb, gh[..., HIDDEN:], "bwd")
                gx = (gxf + gxb + gz[..., None] * self.p["skip"])[b.page, b.place]
                along = np.zeros((len(b.parent), 2 * PATH_DIM), np.float32)
                np.add.at(along, b.element, gx[:, : 2 * PATH_DIM] * SCALE)
                fade = np.repeat(np.array([1, FADE], np.float32), PATH_DIM)
                for at in reversed(b.levels):
                    np.add.at(along, b.parent[at], along[at] * fade)
                gp = scattered(b.path, along[np.repeat(np.arange(len(b.path_n)), b.path_n)], PATH_ROWS)
                gwd = scattered(b.word, np.repeat(gx[:, 2 * PATH_DIM : 2 * PATH_DIM + WORD_DIM] / np.maximum(b.word_n, 1)[:, None], b.word_n, 0), WORD_ROWS)
                g = {"path": gp[:, :PATH_DIM], "near": gp[:, PATH_DIM:], "word": gwd, "fwd": gf, "bwd": gb, "out": (h * gz[..., None]).sum((0, 1)), "skip": (x * gz[..., None]).sum((0, 1)), "bias": np.array([gz.sum()])}
                t += 1
                step = rate * (1 - turn / passes) + 2e-4
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] = (self.p[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
        return self

    def label(self, pages: list[Encoded]) -> list[np.ndarray]:
        """Whether each block is main text, page by page."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            n = max(1, BATCH // len(pages[order[-1]]))
            pick, order = order[-n:], order[:-n]
            z = self.logits(batched([pages[i] for i in pick]))
            for j, i in enumerate(pick):
                out[i] = z[j, : len(pages[i])] > 0
        return out


def scattered(rows: np.ndarray, grads: np.ndarray, n: int) -> np.ndarray:
    """Sum of the gradients over the table rows that were read."""
    return np.stack([np.bincount(rows, grads[:, d], n) for d in range(grads.shape[1])], 1)


#: Words in names of elements, by what they hold (fixed values for generated pages).
NAMES = {
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs links pagination toc tabs".split(),
    "header": "header masthead site top branding logo banner".split(),
    "footer": "footer foot bottom copyright legal colophon".split(),
    "side": "sidebar side aside widget related recommended trending popular more rail".split(),
    "notice": "cookie consent notice alert gdpr privacy popup modal overlay message warning".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adslot".split(),
    "form": "form newsletter subscribe signup login search contact".split(),
    "comments": "comments comment discussion replies reply respond thread disqus".split(),
    "share": "share social sharing follow tags meta byline".split(),
}
#: Class words that say how an element looks, not what it holds; wrappers carry them.
LOOKS = "container mx auto px py row col grid gap flex items center wrap inner block md lg sm text gray white bg w full h rounded shadow border clearfix justify between".split()
BODY_NAMES = "article content post entry main story body text page single".split()


def made_page(r: np.random.Generator) -> tuple[str, list[str]]:
    """A generated page and the texts of its main blocks, in order."""

    def pick(xs):
        return xs[int(r.integers(0, len(xs)))]

    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve la que les und der das ung ción ado el los ñ é ü".split()

    def word() -> str:
        return "".join(pick(syllables) for _ in range(int(r.integers(1, 5))))

    def prose(a: int, b: int) -> str:
        words = [word() for _ in range(int(r.integers(a, b)))]
        junk = pick(["", "", "", "***", "%%%", "&amp;&amp;&amp;"])
        for i in range(len(words)):
            if r.random() < 0.08:
                words[i] += pick([",", ".", "!", "?"])
            words[i] += junk if junk and r.random() < 0.9 else ""
        return " ".join(words).capitalize() + pick([".", ".", ".", ""])

    def nested(inner: str) -> str:
        """Wrappers around a part of the page, often several, with classes of looks only."""
        while r.random() < 0.4:
            looks = " ".join(f"{pick(LOOKS)}-{r.integers(0, 9)}" if r.random() < 0.6 else pick(LOOKS) for _ in range(int(r.integers(1, 7))))
            inner = f'<div class="{looks}">{inner}</div>' if r.random() < 0.8 else f"<div>{inner}</div>"
        return inner

    def attrs(kind: str) -> str:
        if r.random() < 0.15:
            return ""
        names = " ".join({pick(NAMES[kind]) + pick(["", "", "-box", "_wrap", "-container", "1"]) for _ in range(int(r.integers(1, 3)))})
        return pick([f' class="{names}"', f' id="{names.split()[0]}"', f" class='{names} x{r.integers(0, 99)}'", f' class="{names}" id="{names.split()[0]}{r.integers(0, 9)}"'])

    def junk(kind: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind, pick(["div", "section"]))
        named = attrs(kind)
        if not named:
            if tag in ("div", "section"):
                named = f' class="{pick(NAMES[kind])}"'
        elif r.random() < 0.35:
            tag = pick(["div", "section", tag])
        if kind in ("nav", "share") or (kind in ("side", "footer", "header") and r.random() < 0.4):
            inner = "<ul>" + "".join(f'<li><a href="/{word()}">{pick([word(), prose(1, 5)])}</a></li>' for _ in range(int(r.integers(2, 9)))) + "</ul>"
            if r.random() < 0.3:
                inner = " ".join(f'<a href="/{word()}">{word()}</a>' for _ in range(int(r.integers(2, 9))))
        elif kind == "form":
            inner = f"<label>{prose(1, 5)}</label><input name=q>" + pick(["", f"<p>{prose(3, 20)}</p>", f"<select><option>{word()}<option>{word()}</select>"]) + f"<button>{word()}</button>"
        elif kind == "comments":
            inner = pick(["", f"<h3>{prose(1, 4)}</h3>"]) + "".join(pick(["<div class=\"comment\"><b>{a}</b><p>{b}</p></div>", "<li><p>{b}</p></li>", "<article class=\"comment\"><p>{b}</p></article>", "<p>{b}</p>"]).format(a=word(), b=prose(3, 60)) for _ in range(int(r.integers(1, 6))))
        elif kind == "footer":
            inner = pick(["&copy; {a} &middot; {b}", "<p>&copy; {a}</p><p>{b}</p>", "{b}"]).format(a=word(), b=prose(1, 25))
        else:
            text = prose(2, 45)
            inner = pick([text, f"<p>{text}</p>", f"<h4>{prose(1, 4)}</h4><p>{text}</p>", f'<p>{text} <a href="/x">{word()}</a></p>', f"<span>{text}</span>"])
        return nested(f"<{tag}{named}>{nested(inner)}</{tag}>")

    main: list[str] = []

    def para(tag: str) -> str:
        text = prose(1, 90) if r.random() < 0.8 else prose(1, 6)
        main.append(" ".join(htmllib.unescape(text).split()))
        style = r.random()
        if style < 0.15:
            cut = text.find(" ")
            return f"<{tag}><b>{text[: cut + 1]}</b>{text[cut + 1 :]}</{tag}>"
        if style < 0.25:
            return f'<{tag}><a href="/{word()}">{text}</a></{tag}>' if len(text) < 60 else f"<{tag}><i>{text}</i></{tag}>"
        return f"<{tag}><b>{text}<br>" if tag == "p" and style < 0.35 else f"<{tag}>{text}</{tag}>"

    around = list(NAMES)
    body = [junk(k) for k in ("nav", "header", "nav", "ad", "notice", "form") if r.random() < 0.5]
    inner = [para("h1")] if r.random() < 0.85 else []
    if r.random() < 0.2:
        inner.append(junk("share"))
    for _ in range(int(r.integers(1, 14))):
        inner.append(para(pick(["p"] * 10 + ["h2", "h3", "blockquote", "li", "pre"])))
        if r.random() < 0.25:
            inner.append(junk(pick(["ad", "ad", "side", "form", "notice", "share"])))
    if r.random() < 0.3:
        inner.append(junk("comments"))
    shape = r.random()
    text = nested("".join(inner))
    if shape < 0.55:
        text = f"<article{pick(['', '', ' class=' + chr(34) + pick(BODY_NAMES) + chr(34)])}>{text}</article>"
    elif shape < 0.8:
        text = f'<div {pick(["class", "id"])}="{pick(BODY_NAMES)}{pick(["", "-body", "_text", " clearfix"])}">{text}</div>'
    elif shape < 0.9:
        text = f"<main>{text}</main>"
    else:
        text = f'<main><section class="{pick(BODY_NAMES)}">{text}</section></main>'
    tail = [junk(k) for k in ("comments", "side", "share", "ad", "form", "footer", "notice", "footer") if r.random() < 0.45]
    if r.random() < 0.2:
        body.append(junk(pick(around)))
    title = main[0] if main and r.random() < 0.7 else prose(1, 8)
    head = f"<title>{htmllib.escape(title)}</title>" + "".join(pick(['<meta charset="utf-8">', f"<style>.{word()}{{margin:{r.integers(0, 9)}px}}</style>", f"<script>var {word()}='<p>{word()}</p>';</script>", f'<link rel="stylesheet" href="/{word()}.css">', ""]) for _ in range(int(r.integers(0, 4))))
    shell = pick(["<!DOCTYPE html>", ""]) + f'<html lang="{pick(["en", "fr", "de", "es"])}"><head>{head}</head><body{pick(["", "", " class=" + chr(34) + "page single" + chr(34)])}>'
    text = nested(text)
    wrap = pick(["", "", '<div id="wrap">'])
    return shell + wrap + "".join(body) + f"<!-- {pick(['ad', 'menu', 'x'])} -->" + text + "".join(tail) + pick(["", "</div>" if wrap else ""]) + pick(["</body></html>", ""]), main


@lru_cache(maxsize=1)
def model() -> Labeller:
    r = np.random.default_rng(17)
    pages, labels = [], []
    while len(pages) < PAGES:
        html, main = made_page(r)
        cut = blocks(html)
        y, at = np.zeros(len(cut.text), np.float32), 0
        for i, text in enumerate(cut.text):
            if at < len(main) and text == main[at] and "title" not in cut.words[cut.element[i]]:
                y[i], at = 1, at + 1
        if at == len(main) and len(cut.text):
            pages.append(encoded(cut))
            labels.append(y)
    return Labeller().fit(pages, labels)


def extract(pages: list[str | None], labeller: Labeller | None = None) -> list[str]:
    """Main text of each page; blocks joined by a line feed."""
    cut = [blocks(p or "") for p in pages]
    keep = (labeller or model()).label([encoded(c) for c in cut])
    return ["\n".join(text for text, k in zip(c.text, ks.tolist(), strict=True) if k) for c, ks in zip(cut, keep, strict=True)]


def extract_pages(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep columns, text and n_chars (code points) of every page; a narrow transformation.

    Null or empty html gives an empty text. Whole pages are read; nothing of a kept block is
    dropped or capped. Pages without any main block give an empty text.
    """
    bound_batches(pages.sparkSession)
    kept = pages.select(*keep, pages[html].alias("__html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    sent = pages.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            source = list(pdf.pop("__html"))
            texts = [t for at in range(0, len(source), 250) for t in extract(source[at : at + 250], sent.value)]
            pdf["text"], pdf["n_chars"] = texts, np.array([len(t) for t in texts], np.int64)
            yield pdf

    return kept.mapInPandas(run, f"{fields}, text string, n_chars long")
