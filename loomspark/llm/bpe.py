"""BPE encoding and decoding by speculation and verification.

Every distinct word is first cut by greedy longest match. A table walk, vectorised over
all proposed neighbours at once, tells whether each adjacent pair of tokens could stand
side by side in a true merge result; a word whose pairs all pass is done, and only the
others are merged rank by rank. A split whose adjacent pairs are all stable is the one that
exact merging yields, so the answers are equal, not similar.

The vocabulary file (a word-end BPE in the JSON of the tokenizers library) is a parameter.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from .common import bound_batches

#: Distinct words whose tokens a worker remembers before it starts afresh.
CACHE_WORDS = 800_000
#: Texts that are encoded together.
TEXTS = 1000
#: White space as the vocabulary's normaliser sees it (fixed values).
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


#: What Unicode 16 added to the letters and numbers of Unicode 15.1, as ranges (fixed values of the standard).
LATER_LETTERS = (
    "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b-1138b 1138e-1138e 11390-113b5 "
    "113b7-113b7 113d1-113d1 113d3-113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff-18cff 1e5d0-1e5ed 1e5f0-1e5f0"
)
LATER_NUMBERS = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"
#: Capitals newer than Unicode 15.1, first-last:lower case of the first (fixed values of the standard).
LATER_CAPITALS = "1c89-1c89:1c8a a7cb-a7cb:264 a7cc-a7cc:a7cd a7ce-a7ce:a7cf a7d2-a7d2:a7d3 a7d4-a7d4:a7d5 a7da-a7da:a7db a7dc-a7dc:19b 10d50-10d65:10d70 16ea0-16eb8:16ebb"


def category(letter: str, later: str) -> set[int]:
    """The code points whose general category in Unicode 16 starts with letter: Python's tables of Unicode 15.1 and what came later."""
    extra = [[int(x, 16) for x in r.split("-")] for r in later.split()]
    return {c for c in range(0x110000) if unicodedata.category(chr(c))[0] == letter} | {c for a, b in extra for c in range(a, b + 1)}


def ranges(points: set[int]) -> str:
    """The inside of a character class."""
    out: list[list[int]] = []
    for c in sorted(points):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def later_lower() -> dict[int, int]:
    out = {}
    for r in LATER_CAPITALS.split():
        (a, b), to = (int(x, 16) for x in r.split(":")[0].split("-")), int(r.split(":")[1], 16)
        out |= {c: to + c - a for c in range(a, b + 1)}
    return out


@lru_cache(maxsize=1)
def pieces() -> tuple[str, str, str]:
    """Patterns of the pieces that are encoded on their own (the alternatives are fixed values of this vocabulary).

    The first has the classes of Unicode 16 written out, which is right for any text and slow; the second
    takes them from the regular expression module, which may know another version; the third finds the code
    points on which the two differ, and the capitals that Python does not know.
    """
    letters, numbers = category("L", LATER_LETTERS), category("N", LATER_NUMBERS)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    differ = (letters ^ set(map(ord, regex.findall(r"\p{L}", every)))) | (numbers ^ set(map(ord, regex.findall(r"\p{N}", every)))) | set(later_lower())
    whole = lambda a, b: rf"'s|'t|'re|'ve|'m|'ll|'d|[{a}]+|[{b}]|(?:(?!{SPACE})[^{a}{b}])+"
    return whole(ranges(letters), ranges(numbers)), whole(r"\p{L}", r"\p{N}"), f"[{ranges(differ)}]"


def byte_letters() -> list[str]:
    """The printable stand-in of each byte value: itself if visible, else the next free letter from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A word-end BPE vocabulary and its encoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.ids | self.special).items()}
        self.longest = max(map(len, self.ids))
        self.reach: dict[str, int] = {}
        for t in self.ids:
            self.reach[t[:2]] = max(self.reach.get(t[:2], 1), len(t))
        size = max(self.names) + 1
        self.size = size
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([self.ids[a] for a, _ in merges], np.int64)
        right = np.array([self.ids[b] for _, b in merges], np.int64)
        made = np.array([self.ids[a + b] for a, b in merges], np.int64)
        self.rank = {p: r for r, p in enumerate(zip(left.tolist(), right.tolist(), strict=True))}
        self.made, self.never = made.tolist(), len(made)
        # order of a token: its merge's rank, unmerged letters first
        self.order = np.full(size, -1, np.int64)
        self.order[made] = np.arange(len(made))
        self.first, self.last = np.arange(size), np.arange(size)
        self.first[made], self.last[made] = left, right
        keys = left * size + right
        by = np.argsort(keys)
        self.pair_keys, self.pair_rank = keys[by], by
        self.letters = byte_letters()
        self.table = str.maketrans({chr(b): c for b, c in enumerate(self.letters)})
        self.marks = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        exact, usual, differ = pieces()
        self.space, self.exact, self.usual, self.differ = regex.compile(SPACE + "+"), regex.compile(exact), regex.compile(usual), regex.compile(differ)
        # no text without these bytes holds code points from U+1000 on; the versions agree below
        self.far = re.compile(b"[\xe1-\xf4]") if not regex.search(differ, "".join(map(chr, range(0x1000)))) else re.compile(b"")
        self.later = later_lower()
        self.known: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}

    # -- text to words -----------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        """Normalised pieces of a text without special tokens."""
        text = unicodedata.normalize("NFC", text)
        text = text.lower() if "Σ" not in text else "".join(map(str.lower, text))
        if not text.isascii() and self.far.search(text.encode("utf-8", "surrogatepass")) and self.differ.search(text):
            return self.exact.findall(text.translate(self.later))
        return self.usual.findall(text)

    def spelled(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.table)

    # -- speculate -----------------------------------------------------------------------

    def greedy(self, letters: str) -> list[int]:
        ids, reach, out, at, end = self.ids, self.reach, [], 0, len(letters)
        while at < end:
            if end - at <= self.longest and (whole := ids.get(letters[at:] + self.suffix)) is not None:
                out.append(whole)
                break
            for stop in range(min(end - 1, at + reach.get(letters[at : at + 2], 1)), at, -1):
                if (got := ids.get(letters[at:stop])) is not None:
                    out.append(got)
                    at = stop
                    break
            else:
                raise ValueError(f"no token for {letters[at]!r}")
        return out

    # -- verify --------------------------------------------------------------------------

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b, side by side, would stay apart while each one forms.

        Walks back through the merges that formed the two, latest merge first. At each step
        the two parts that touch must not have a merge that would have come before the step
        that closed them up.
        """
        a, b = a.copy(), b.copy()
        ok = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_rank[at], np.iinfo(np.int64).max)
            bad = rank < limit[live]
            ok[live[bad]] = False
            rx, ry = self.order[x], self.order[y]
            ends = (rx < 0) & (ry < 0)
            undo_left = rx > ry  # the later merge is undone first
            # joining at equal rank runs left to right: the right part's own merge comes after
            limit[live] = np.where(undo_left, rx, ry + 1)
            a[live] = np.where(undo_left, self.last[x], x)
            b[live] = np.where(undo_left, y, self.first[y])
            live = live[~(bad | ends)]
        return ok

    # -- exact ---------------------------------------------------------------------------

    def merged(self, letters: str) -> list[int]:
        ids, rank, made, never = self.ids, self.rank, self.made, self.never
        parts = [ids[c] for c in letters[:-1]]
        parts.append(ids[letters[-1] + self.suffix])
        ranks = [rank.get(p, never) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (r := min(ranks)) < never:
            i = ranks.index(r)
            parts[i] = new = made[r]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank.get((parts[i - 1], new), never)
            if i < len(ranks):
                ranks[i] = rank.get((new, parts[i + 1]), never)
        return parts

    def merged_long(self, letters: str) -> list[int]:
        """Like merged(), with a heap: a word of n letters takes n log n steps."""
        from heapq import heappop, heappush

        part = [self.ids[c] for c in letters[:-1]] + [self.ids[letters[-1] + self.suffix]]
        n = len(part)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if j >= 0 and (r := self.rank.get((part[i], part[j]))) is not None:
                heappush(heap, (r, i, part[i], part[j]))

        for i in range(n):
            push(i)
        while heap:
            r, i, x, y = heappop(heap)
            j = after[i]
            if part[i] != x or j < 0 or part[j] != y:
                continue
            part[i], part[j] = self.made[r], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [p for p in part if p >= 0]

    def learn(self, words: Iterable[str]) -> None:
        """Put the tokens of new words into the cache."""
        words = list(words)
        spelled = [self.spelled(w) for w in words]
        guess = [self.greedy(s) for s in spelled]
        counts = np.array([len(g) for g in guess], np.int64)
        flat = np.fromiter((t for g in guess for t in g), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(words)), counts)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        fine = np.ones(len(words), bool)
        if len(inner):
            pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
            passed = self.stable(pairs // self.size, pairs % self.size)[back]
            fine[owner[inner[~passed]]] = False
        for i in np.flatnonzero(~fine):
            guess[i] = (self.merged if len(spelled[i]) < 64 else self.merged_long)(spelled[i])
        raw = np.fromiter((t for g in guess for t in g), "<u4").tobytes()
        at, names = 0, self.names
        for w, g in zip(words, guess, strict=True):
            end = at + 4 * len(g)
            self.known[w], self.shown[w] = raw[at:end], " ".join([names[t] for t in g])
            at = end

    # -- whole texts ---------------------------------------------------------------------

    def segments(self, text: str) -> list[list[str] | str]:
        """Word lists, and special tokens as plain strings."""
        if self.marks is None or not any(s in text for s in self.special):
            return [self.words(text)]
        return [p if i % 2 else self.words(p) for i, p in enumerate(self.marks.split(text))]

    def encode_many(self, texts: list[str], remember: int = CACHE_WORDS) -> Iterator[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, decoded text) of each text; the cache holds remember words, or those of these texts."""
        cut = [self.segments(t) for t in texts]
        every = set().union(*[p for parts in cut for p in parts if not isinstance(p, str)])
        new = [w for w in every if w not in self.known]
        if len(self.known) + len(new) > remember:
            self.known.clear()
            self.shown.clear()
            new = list(every)
        self.learn(new)
        # the words of these texts alone: small tables that stay in the processor's cache
        known, shown = {w: self.known[w] for w in every}.__getitem__, {w: self.shown[w] for w in every}.__getitem__
        for parts in cut:
            ids, out = [], []
            for p in parts:
                if isinstance(p, str):
                    ids.append(np.array([self.special[p]], "<u4").tobytes())
                    out.append(p)
                elif p:
                    ids.append(b"".join(map(known, p)))
                    out.append(" ".join(map(shown, p)))
            yield b"".join(ids), " ".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.encode_many([text]))[0], "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Token strings joined by one space: this vocabulary names no decoder."""
        return " ".join(self.names[i] for i in ids if i in self.names)


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False, remember: int = CACHE_WORDS) -> DataFrame:
    """Encode and decode every whole text; a narrow transformation, no shuffle.

    A null text counts as empty: no tokens, the digest of nothing. Columns other than
    keep and text are not read. with_ids adds the ids (array<int>) and the decoded text.
    remember: words whose tokens a worker keeps; fewer take less memory and more time.
    """
    bound_batches(docs.sparkSession)
    kept = docs.select(*keep, docs[text].alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    extra = ", ids array<int>, decoded string" if with_ids else ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for pdf in batches:
            texts = ["" if t is None else t for t in pdf.pop("__text")]
            n, ids_sha, text_sha, ids, decoded = [], [], [], [], []
            for at in range(0, len(texts), TEXTS):
                for raw, out in bpe.encode_many(texts[at : at + TEXTS], remember):
                    n.append(len(raw) // 4)
                    ids_sha.append(hashlib.sha256(raw).hexdigest())
                    text_sha.append(hashlib.sha256(out.encode()).hexdigest())
                    if with_ids:
                        ids.append(np.frombuffer(raw, "<u4").astype(np.int32))
                        decoded.append(out)
            pdf["n_tokens"], pdf["ids_sha256"], pdf["decoded_sha256"] = np.array(n, np.int64), ids_sha, text_sha
            if with_ids:
                pdf["ids"], pdf["decoded"] = ids, decoded
            yield pdf

    return kept.mapInPandas(run, f"{fields}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
