"""Secret scan: fixed patterns, widened by a character convolutional network.

Base spans come from three fixed patterns and always stay. A looser proposal pattern
finds every other token that could be a credential; a small convolutional network in numpy
reads the token with the characters around it and scores it. The network is fitted on
labelled findings: generated credentials and harmless look-alikes in generated contexts.
Its scores are calibrated by isotonic steps on held-out findings. A candidate is marked where
its probability reaches the threshold: EVEN, or less where EVEN would not keep RECALL of
the held-out credentials.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: Kinds in the order that breaks ties between spans that start together.
KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Candidates of the network: long tokens of credential letters, and values after a key-like name.
PROPOSE = re.compile(r"[A-Za-z0-9+/_~-]{20,}={0,2}")
NAMED = re.compile(r"""(?:pass|pwd|auth|cred|bearer|private|access|secret|token|api_?key)[a-z_]{0,12}["']?\x20{0,2}[:=]\x20{0,2}["']?([A-Za-z0-9+/_.~!@#$%^&*=-]{8,})""", re.A | re.I)
BEFORE, INSIDE, AFTER = 16, 40, 8
WIDTH = BEFORE + INSIDE + AFTER
#: Findings the network is fitted on, and of these the share held out for calibration.
FINDINGS, HELD_OUT = 6000, 3
#: Share of held-out credentials that the threshold must keep, and the probability from which it need not go higher.
RECALL, EVEN = 0.97, 0.5
CLASSES = 40


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order.

    A token run that is too short cannot hide a longer one, so hex and access can ask for
    their length at once; assign must consume short values first, as written.
    """
    out = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out.sort()
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Proposed spans that are not wholly base spans; disjoint, leftmost first, overlapping ones joined."""
    found = []
    for m in PROPOSE.finditer(text):
        token = m.group()
        if any(c.isdigit() for c in token) and any(c.isalpha() for c in token):
            found.append(m.span())
    if ":" in text or "=" in text:
        found += [m.span(1) for m in NAMED.finditer(text)]
    joined: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if joined and s < joined[-1][1]:
            joined[-1] = (joined[-1][0], max(e, joined[-1][1]))
        else:
            joined.append((s, e))
    starts, ends = union(base)
    return [(s, e) for s, e in joined if not ((at := bisect_right(starts, s) - 1) >= 0 and e <= ends[at])]


def union(base: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what spans in order of their starts cover together."""
    starts: list[int] = []
    ends: list[int] = []
    for s, _, e in base:
        if ends and s <= ends[-1]:
            ends[-1] = max(e, ends[-1])
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def pieces(s: int, e: int) -> list[tuple[int, int]]:
    """The whole span in parts of at most INSIDE letters, each overlapping the next by half or more."""
    if e - s <= INSIDE:
        return [(s, e)]
    return [(at, at + INSIDE) for at in [*range(s, e - INSIDE, INSIDE // 2), e - INSIDE]]


def letter_classes() -> np.ndarray:
    """Code point -> class for ASCII: letters by case and third of the alphabet, digits, each mark; 0 pads, 1 is the rest."""
    to = np.ones(128, np.int8)
    for c in range(26):
        to[ord("a") + c] = 2 + c // 3
        to[ord("A") + c] = 11 + c // 7
    to[ord("0") : ord("9") + 1] = 15
    to[ord("a") : ord("g")] = 16
    for i, c in enumerate(" \n\"'=:/+-_.@!,;(){}<>#"):
        to[ord(c)] = 17 + i
    return to


CLASS_OF = letter_classes()


def windows(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Class codes of each span with its surroundings; a span over INSIDE letters keeps both ends."""
    out = np.zeros((len(spans), WIDTH), np.int8)
    for row, (s, e) in zip(out, spans, strict=True):
        token = text[s:e] if e - s <= INSIDE else text[s : s + INSIDE // 2] + text[e - INSIDE // 2 : e]
        for at, piece in ((BEFORE - min(BEFORE, s), text[max(0, s - BEFORE) : s]), (BEFORE, token), (BEFORE + INSIDE, text[e : e + AFTER])):
            codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
            row[at : at + len(codes)] = np.where(codes < 128, CLASS_OF[np.minimum(codes, 127)], 1)
    return out


class CharCnn:
    """Embedding, one convolution of five letters, rectifier, largest and mean value over places, one logit."""

    def __init__(self, seed: int = 7, dim: int = 8, filters: int = 24, span: int = 5):
        r = np.random.default_rng(seed)
        self.span = span
        self.p = {
            "e": r.normal(0, 0.5, (CLASSES, dim)), "k": r.normal(0, (2 / (span * dim)) ** 0.5, (span * dim, filters)), "c": np.zeros(filters),
            "w": r.normal(0, 0.1, 2 * filters), "b": np.zeros(1),
        }

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        e = self.p["e"][x]
        n, t, d = e.shape
        slides = np.lib.stride_tricks.sliding_window_view(e, self.span, axis=1).transpose(0, 1, 3, 2).reshape(n, t - self.span + 1, -1)
        h = np.maximum(slides @ self.p["k"] + self.p["c"], 0)
        top = h.argmax(1)
        feats = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(1)], 1)
        return feats @ self.p["w"] + self.p["b"][0], (x, slides, h, top, feats)

    def backward(self, grad: np.ndarray, kept: tuple) -> dict[str, np.ndarray]:
        x, slides, h, top, feats = kept
        f = h.shape[2]
        gf = grad[:, None] * self.p["w"]
        gh = np.repeat(gf[:, None, f:] / h.shape[1], h.shape[1], 1)
        np.put_along_axis(gh, top[:, None], np.take_along_axis(gh, top[:, None], 1) + gf[:, None, :f], 1)
        gh *= h > 0
        gs = (gh @ self.p["k"].T).reshape(*gh.shape[:2], self.span, -1)
        ge = np.zeros_like(self.p["e"])
        for i in range(self.span):
            np.add.at(ge, x[:, i : i + gh.shape[1]], gs[:, :, i])
        return {"e": ge, "k": slides.reshape(-1, slides.shape[2]).T @ gh.reshape(-1, f), "c": gh.sum((0, 1)), "w": grad @ feats, "b": grad.sum(keepdims=True)}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 4e-3, seed: int = 3) -> CharCnn:
        r, m, v, t = np.random.default_rng(seed), {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(x), batch):
                i = order[at : at + batch]
                z, kept = self.forward(x[i])
                g = self.backward((1 / (1 + np.exp(-z)) - y[i]) / len(i), kept)
                t += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 1024])[0] for i in range(0, len(x), 1024)]) if len(x) else np.zeros(0)


def findings(n: int = FINDINGS, seed: int = 11) -> Iterator[tuple[str, int, int, int]]:
    """Labelled findings: (text, start, end, 1 if a credential)."""
    r = np.random.default_rng(seed)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed = lower + lower.upper() + digits

    def pick(letters: str, k: int) -> str:
        return "".join(letters[i] for i in r.integers(0, len(letters), k))

    def word() -> str:
        return "".join(pick("bcdfglmnprst", 1) + pick("aeiou", 1) for _ in range(r.integers(1, 5)))

    def prose(k: int) -> str:
        return " ".join(word() for _ in range(k))

    names = ["pwd", "pass", "auth", "auth_token", "access_key", "private_key", "client_secret", "credential", "passphrase", "Authorization"]
    for _ in range(n):
        kind, bad = int(r.integers(0, 6)), int(r.integers(0, 2))
        head, tail = prose(int(r.integers(1, 4))), prose(int(r.integers(1, 4)))
        lead = " "
        if bad:
            if kind == 0:
                token = pick(["ghp_", "gho_", "sk_live_", "xoxb-", "glpat-", "sk-"][r.integers(0, 6)], 0) + ["ghp_", "gho_", "sk_live_", "xoxb-", "glpat-", "sk-"][r.integers(0, 6)] + pick(mixed, int(r.integers(20, 40)))
            elif kind == 1:
                token = "eyJ" + pick(mixed + "_-", int(r.integers(20, 60)))
            elif kind in (2, 3):
                token, lead = pick(mixed + "+/_-" * (kind - 2), int(r.integers(8, 44))), f" {names[r.integers(0, len(names))]}{['=', ': ', ' = ', '=' + chr(34), ': ' + chr(39)][r.integers(0, 5)]}"
            elif kind == 4:
                token, lead = pick(mixed, int(r.integers(20, 60))), [" Bearer ", " Basic ", " key "][r.integers(0, 3)]
            else:
                token = pick(mixed + "+/", int(r.integers(28, 64))) + "=" * int(r.integers(0, 3))
        elif kind == 0:
            token = "-".join(word() for _ in range(int(r.integers(4, 8)))) + "-" + pick(digits, int(r.integers(1, 5)))
        elif kind == 1:
            token, lead = "/".join(word() for _ in range(int(r.integers(3, 7)))) + "/" + pick(digits, int(r.integers(1, 6))), [" http://", " https://www.", " /"][r.integers(0, 3)]
        elif kind == 2:
            token, lead = word() + word() + word(), f" {names[r.integers(0, len(names))]}{['=', ': '][r.integers(0, 2)]}"
        elif kind == 3:
            token = "_".join(word() for _ in range(int(r.integers(3, 7)))) + pick(digits, int(r.integers(1, 4)))
        elif kind == 4:
            token = word() + word() + word() + word() + pick(digits, int(r.integers(1, 5))) + word()
        else:
            token = f"{r.integers(1900, 2100)}-{r.integers(10, 13)}-{r.integers(10, 29)}" + ["T", "_"][r.integers(0, 2)] + pick(digits, 6) + "-" + word()
        start = len(head) + len(lead)
        yield f"{head}{lead}{token} {tail}", start, start + len(token), bad


def calibrated(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic calibration by pooling adjacent violators: (score edges, probabilities)."""
    order = np.argsort(scores, kind="stable")
    pools: list[list[float]] = []
    for s, y in zip(scores[order], labels[order], strict=True):
        pools.append([s, float(y), 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1][1] += last[1]
            pools[-1][2] += last[2]
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


def probability(z: np.ndarray, edges: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """The calibration step of each score; scores below all steps have none."""
    at = np.searchsorted(edges, z, side="right") - 1
    return np.where(at < 0, 0.0, probs[np.maximum(at, 0)])


@lru_cache(maxsize=1)
def model() -> tuple[CharCnn, float, np.ndarray, np.ndarray]:
    """The fitted network, its threshold as a probability, and its calibration steps."""
    made = list(findings())
    x = np.concatenate([windows(t, [(s, e)]) for t, s, e, _ in made])
    y = np.array([b for *_, b in made], float)
    out = np.arange(len(x)) % HELD_OUT == 0
    net = CharCnn().fit(x[~out], y[~out])
    z = net.scores(x[out])
    edges, probs = calibrated(z, y[out])
    found = np.sort(probability(z[y[out] == 1], edges, probs))
    return net, float(min(EVEN, found[int((1 - RECALL) * len(found))])), edges, probs


def scan(texts: list[str], fitted: tuple | None = None) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, added spans) of each text, as (start, kind, end)."""
    net, threshold, edges, probs = fitted or model()
    base = [base_spans(t) for t in texts]
    proposed = [candidates(t, b) for t, b in zip(texts, base, strict=True)]
    read = [[[(s, e)] + (pieces(s, e) if e - s > INSIDE else []) for s, e in p] for p in proposed]  # both ends at once, then all parts
    x = [windows(t, [span for parts in r for span in parts]) for t, r in zip(texts, read, strict=True) if r]
    p_of = probability(net.scores(np.concatenate(x)), edges, probs) if x else np.zeros(0)
    out, at = [], 0
    for b, p, r in zip(base, proposed, read, strict=True):
        added = []
        for (s, e), parts in zip(p, r, strict=True):
            if p_of[at : at + len(parts)].max() >= threshold:
                added.append((s, 3, e))
            at += len(parts)
        out.append((b, added))
    return out


def value_of(text: str, span: tuple[int, int, int]) -> tuple[int, int]:
    """What the network reads of a base span: the value of an assignment, else the whole span."""
    s, kind, e = span
    return ASSIGN.match(text, s, e).span(2) if kind == 0 else (s, e)


def probabilities(texts: list[str], spans: list[list[tuple[int, int, int]]], fitted: tuple | None = None) -> list[list[float]]:
    """The network's calibrated probability of every span, base ones included, in the order of listed()."""
    net, _, edges, probs = fitted or model()
    read = [[(value_of(t, x) if x[1] == 0 else (x[0], x[2])) for x in sorted(own)] for t, own in zip(texts, spans, strict=True)]
    parts = [[pieces(s, e) if e - s > INSIDE else [(s, e)] for s, e in r] for r in read]
    whole = [[[span, *p] for span, p in zip(r, own, strict=True)] for r, own in zip(read, parts, strict=True)]
    x = [windows(t, [span for p in w for span in p]) for t, w in zip(texts, whole, strict=True) if w]
    p_of, at, out = probability(net.scores(np.concatenate(x)), edges, probs) if x else np.zeros(0), 0, []
    for w in whole:
        ends = at + np.cumsum([len(p) for p in w]).astype(int)
        out.append([float(p_of[b:e].max()) for b, e in zip([at, *ends[:-1]], ends, strict=True)] if w else [])
        at = int(ends[-1]) if w else at
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (joined where they overlap) replaced by a mark."""
    out, at = [], 0
    for s, _, e in sorted(spans):
        if e > at:
            if s >= at:
                out += [text[at:s], "[secret]"]
            at = e
    return "".join([*out, text[at:]])


def scan_documents(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), redact: bool = False) -> DataFrame:
    """Spans of every whole text; a narrow transformation, no shuffle.

    probabilities has what the network gives to each of spans, in their order: base spans stay whatever it says.
    A null text counts as empty: no spans. With redact, the text comes back with each span
    replaced (null stays null), beside the kept columns.
    """
    bound_batches(docs.sparkSession)
    kept = docs.select(*keep, docs[text].alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    fitted = docs.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = list(pdf.pop("__text"))
            found = scan(["" if t is None else t for t in texts], fitted.value)
            for k, name in enumerate(KINDS):
                pdf[f"n_{name}"] = np.array([sum(s[1] == k for s in b + a) for b, a in found], np.int64)
            pdf["base_sha256"] = [hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in found]
            pdf["spans"] = [listed(b + a) for b, a in found]
            scored = probabilities(["" if t is None else t for t in texts], [b + a for b, a in found], fitted.value)
            pdf["probabilities"] = [",".join(f"{p:.3f}" for p in own) for own in scored]
            if redact:
                pdf["redacted"] = [None if t is None else redacted(t, b + a) for t, (b, a) in zip(texts, found, strict=True)]
            yield pdf

    return kept.mapInPandas(run, f"{fields}, n_assign long, n_access long, n_hex long, n_cnn long, base_sha256 string, spans string, probabilities string" + ", redacted string" * redact)


def redacted_column(text: Column) -> Column:
    """A text with its secrets replaced, as a column; null stays null."""
    fitted = model()

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        values = ["" if t is None else t for t in texts]
        return pd.Series([None if t is None else redacted(t, b + a) for t, (b, a) in zip(texts, scan(values, fitted), strict=True)], dtype=object)

    return redact(text)
