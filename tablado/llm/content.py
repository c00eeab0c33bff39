"""Main content of listing pages apart from page furniture.

A page is a tree: the page, its blocks (a heading with what it heads, a menu, a paragraph) and their lines.
Every line has a likelihood from a logistic model of its words, shape, place and nearness to the page's own
title; parent-child potentials tie lines to their block and blocks to their page.  Messages summed upward
and then downward give the probability of each line to be content.  The titles' parts are a tree as well.

All parameters are trained on labelled pages put together from hand-labelled furniture and a bounded sample
of clean descriptions (at most ``SAMPLE_ROWS`` rows); whole pages are then scored, in one pass over the
pages without a shuffle.

Defined results
    * NULL and empty descriptions have no lines; blank lines are never furniture.
    * Repeated rows get the same lines.  Damaged or re-cased text is repaired before scoring.
    * The model is a few thousand weights, at most ``FEATURES`` (2 MB), and is sent with the function, as are
      the names of all sites (one row of the source catalog each).
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablado.llm import labelled_pages as lab
from tablado.llm.encoding import repair, unaccented

SAMPLE_ROWS = 2_000
TRAINING_PAGES = 1_500
FEATURES = 60_000
_WORD = re.compile(r"[^\W\d_]+|\d+")
_MAY_HAVE_SIGNS = re.compile(r"[-|/>·•»]\s")
_DIGIT = re.compile(r"\d")
_SIGNS = re.compile(r"\s[-|/>·•»]\s|\s{2,}")
_TIME = re.compile(r"^\W*\d{1,2}[:.]\d{2}\b")
_LIST = re.compile(r"^[\s•*·▪►–—-]+")
_NAMES = re.compile(r"\b[A-ZÁÉÍÓÚÑ][^\W\d_]+ [A-ZÁÉÍÓÚÑ][^\W\d_]+")
_TITLE_PARTS = re.compile(r"\s+(?:»|::|\||-|–|—|·|>|›|@|•)\s+")


class _Odd(Exception):
    """A piece of text with a sign that is a digit only by some measures."""


class _Pieces(dict):
    """The folded words of a piece of text without blanks, numbers as "0"; most pieces recur, so they are kept."""

    def __missing__(self, piece: str) -> tuple[str, ...]:
        found = _WORD.findall(unaccented(piece))
        digits = [w.isdigit() for w in found]
        if any(d and not _DIGIT.match(w) for w, d in zip(found, digits, strict=True)):
            raise _Odd
        if len(self) > 200_000:
            self.clear()
        words = self[piece] = tuple("0" if d else w for w, d in zip(found, digits, strict=True))
        return words


_words_of = _Pieces().__getitem__


def _words(text: str) -> list[str]:
    try:
        return list(chain.from_iterable(map(_words_of, text.split())))  # no word reaches over a blank
    except _Odd:
        return _words_at_once(text)


def _words_at_once(text: str) -> list[str]:
    folded = unaccented(text)
    words = _WORD.findall(folded)
    return ["0" if w.isdigit() else w for w in words] if _DIGIT.search(folded) else words


class _Line:
    """What a line shows by itself; the same for every page it stands on."""

    __slots__ = ("blank", "ends", "heads", "joined", "n", "short", "strange", "sum", "title_words")

    def __init__(self, raw: str, vocabulary: set[str], scorer: _Scorer | None = None) -> None:
        text = raw.strip()
        words = _words(text)
        self.n = n = len(words)
        self.blank = not words and not text
        self.ends = n > 3 and text.endswith((".", "…", "!", "?", "]"))
        self.heads = n <= 4 and text.endswith(":")
        self.short = len(text) < 110
        self.joined = " ".join(words) if n <= 16 else ""
        self.title_words = {w for w in words if len(w) > 3} if n <= 16 else set()
        self.strange = self.title_words - vocabulary
        self.sum = scorer.line(text, words) if scorer else 0.0


class _Known(dict):
    """Weights by word, with that of unknown words for the rest."""

    def __init__(self, weights: dict[str, float], other: float) -> None:
        super().__init__(weights)
        self.other = other

    def __missing__(self, word: str) -> float:
        return self.other


class _Scorer:
    """The score of ``line_features`` under given weights, without making the features."""

    def __init__(self, weights: dict[str, float], vocabulary: set[str]) -> None:
        get = weights.get
        self.vocabulary, self.get = vocabulary, get
        self.one, self.first, self.last = (_Known({w: get(k + w, 0.0) for w in vocabulary}, get(k + "?", 0.0)).__getitem__ for k in ("w:", "first:", "last:"))
        self.two = _Known({tuple(k[2:].split(" ")): v for k, v in weights.items() if k.startswith("b:")}, 0.0).__getitem__

    def line(self, text: str, words: list[str]) -> float:
        get, n = self.get, len(words)
        z = get("bias", 0.0)
        if n:
            some = sum(map(self.one, words))
            if n <= 24:
                some += sum(map(self.two, zip(words, words[1:])))
            z += some / math.sqrt(n) + self.first(words[0]) + self.last(words[-1])
            if n <= 4:
                z += 2.0 * get("all:" + " ".join(words), 0.0)
        z += get(_size(n), 0.0)
        if text.endswith(".") and n > 3:
            z += get("dot", 0.0)
        if text.endswith(("…", "...", "[…]")):
            z += get("cut", 0.0)
        if text.endswith(":"):
            z += get("colon", 0.0)
        if _TIME.match(text):
            z += get("time", 0.0)
        if (_MAY_HAVE_SIGNS.search(text) or "  " in text or not text.isprintable()) and (signs := len(_SIGNS.findall(text))) >= 2:
            z += min(2.0, signs / 2) * get("signs", 0.0)
        if text and text[0] in "«»©•":
            z += get("sign:" + text[0], 0.0)
        if n <= 14:
            vocabulary = self.vocabulary
            z += get("unknown:" + str(min(3, sum([w not in vocabulary for w in words]))), 0.0)
        return z


def _size(n: int) -> str:
    return "size:" + ("0" if n == 0 else "1" if n == 1 else "2" if n <= 3 else "3" if n <= 7 else "4" if n <= 14 else "5")


def line_features(text: str, words: list[str], vocabulary: set[str]) -> dict[str, float]:
    n = len(words)
    f: dict[str, float] = {"bias": 1.0}
    if n:
        scale = 1 / math.sqrt(n)
        for w in words:
            k = "w:" + (w if w in vocabulary else "?")
            f[k] = f.get(k, 0.0) + scale
        # Long lines are told by their words; pairs count in short ones.
        for a, b in zip(words, words[1:]) if n <= 24 else ():
            if a in vocabulary and b in vocabulary:
                k = f"b:{a} {b}"
                f[k] = f.get(k, 0.0) + scale
        f["first:" + (words[0] if words[0] in vocabulary else "?")] = 1.0
        f["last:" + (words[-1] if words[-1] in vocabulary else "?")] = 1.0
        if n <= 4:
            f["all:" + " ".join(words)] = 2.0
    f[_size(n)] = 1.0
    if text.endswith(".") and n > 3:
        f["dot"] = 1.0
    if text.endswith(("…", "...", "[…]")):
        f["cut"] = 1.0
    if text.endswith(":"):
        f["colon"] = 1.0
    if _TIME.match(text):
        f["time"] = 1.0
    if (signs := len(_SIGNS.findall(text))) >= 2:
        f["signs"] = min(2.0, signs / 2)
    first = text[:1]
    if first and first in "«»©•":
        f["sign:" + first] = 1.0
    unknown = sum(w not in vocabulary for w in words)
    f["unknown:" + str(min(unknown, 3))] = 1.0 if n <= 14 else 0.0
    return f


def title_pieces(title: str) -> list[tuple[str, str]]:
    """The parts of a title with the signs before and after each."""
    signs = [m.group().strip() for m in _TITLE_PARTS.finditer(title)]
    parts = [p.strip() for p in _TITLE_PARTS.split(title)]
    return [(p, ([""] + signs)[i] + "_" + (signs + [""])[i]) for i, p in enumerate(parts) if p]


def title_features(part: str, signs: str, vocabulary: set[str]) -> dict[str, float]:
    words = _words(part)
    f = {"t" + k: v for k, v in line_features(part, words, vocabulary).items()}
    before, after = signs.split("_")
    for k in ("tbefore:" + before, "tafter:" + after):
        f[k] = 1.0
    if before == "»" or after == "»":
        f["tcrumb:" + ("menu" if len(words) <= 2 else "long")] = 2.0
        f["tcrumb:" + ("end" if not after else "inside")] = 2.0
    return f


def _score(f: dict[str, float], weights: dict[str, float]) -> float:
    return sum(v * weights.get(k, 0.0) for k, v in f.items())


def page_features(line: _Line, title: set[str], at: int, last: int) -> dict[str, float]:
    """What a line shows by its place on a page."""
    f = {}
    if line.title_words:
        share = len(line.title_words & title) / len(line.title_words)
        f["own:" + ("2" if share >= 0.6 else "1" if share >= 0.3 else "0")] = 1.0
    if line.strange:
        f["name:own" if line.strange & title else "name:other"] = 1.0
    f[_at(at, last)] = 1.0
    return f


def _at(at: int, last: int) -> str:
    return "at:first" if at == 0 else "at:last" if at == last else "at:second" if at == 1 else "at:end" if at >= last - 2 else "at:mid"


def blocks_of(lines: list[_Line], heads: set[str]) -> list[list[int]]:
    """The blocks of a page: a heading or menu with the short lines after it, else every line by itself."""
    out: list[list[int]] = []
    is_open = menu = False
    for i, x in enumerate(lines):
        if x.blank:
            is_open = menu = False
            continue
        if x.heads or x.joined in heads:
            out.append([i])
            is_open, menu = True, False
        elif is_open and x.short and not x.ends:
            out[-1].append(i)
        elif menu and x.n <= 2:
            out[-1].append(i)
        else:
            out.append([i])
            is_open, menu = False, x.n <= 2
    return out


class Model:
    """Weights, potentials and the sum-product pass."""

    def __init__(self, weights: dict[str, float], vocabulary: set[str], line_given_block: list[list[float]], block_given_page: list[list[float]], page: list[float], sites: set[str]) -> None:
        self.weights, self.vocabulary, self.sites = weights, vocabulary, sites
        self.line_given_block, self.block_given_page, self.page = line_given_block, block_given_page, page
        self.heads = {" ".join(_words(h)) for h in lab.TEASER_HEADS}
        self.placed = {k: weights.get(k, 0.0) for k in ("at:first", "at:last", "at:second", "at:end", "at:mid", "own:2", "own:1", "own:0", "name:own", "name:other")}
        self.memo: dict[str, _Line] = {}
        self.named: dict[str, bool] = {}
        self.cleaned: dict[str | None, str] = {}
        self.scorer: _Scorer | None = None

    def __getstate__(self) -> dict:
        """What is sent to the executors: no memos and nothing that is made from the weights."""
        return self.__dict__ | {"memo": {}, "named": {}, "cleaned": {}, "scorer": None}

    def line(self, raw: str) -> _Line:
        if (x := self.memo.get(raw)) is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            if self.scorer is None:
                self.scorer = _Scorer(self.weights, self.vocabulary)
            x = self.memo[raw] = _Line(raw, self.vocabulary, self.scorer)
        return x

    def odds(self, lines: list[_Line], title: set[str]) -> list[float]:
        last = max((i for i, x in enumerate(lines) if not x.blank), default=0)
        own, other = self.placed["name:own"], self.placed["name:other"]
        out = []
        for i, x in enumerate(lines):
            # The same as the score of ``page_features``.
            z = x.sum + self.placed[_at(i, last)]
            if x.title_words:
                share = len(x.title_words & title) / len(x.title_words)
                z += self.placed["own:2" if share >= 0.6 else "own:1" if share >= 0.3 else "own:0"]
            if x.strange:
                z += other if x.strange.isdisjoint(title) else own
            out.append(z)
        return out

    def content(self, description: str, title: str) -> list[float]:
        """The probability of each line to be furniture; blank lines have 0."""
        lines = [self.line(r) for r in description.split("\n")]
        logits = self.odds(lines, {w for w in _words(title) if len(w) > 3})
        blocks = blocks_of(lines, self.heads)
        like = [(1 - y, y) for y in (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) for z in logits)]
        # Upward: lines to blocks, blocks to the page.
        (a0, a1), (b0, b1) = self.line_given_block
        (p0, p1), (q0, q1) = self.block_given_page
        up_line = [(a0 * x + a1 * y, b0 * x + b1 * y) for x, y in like]
        up_block, up_page = [], []
        belief = [math.log(self.page[0]), math.log(self.page[1])]
        for block in blocks:
            m0, m1 = 1.0, 1.0
            for i in block:
                m0, m1 = m0 * up_line[i][0], m1 * up_line[i][1]
                top = max(m0, m1) or 1.0
                m0, m1 = m0 / top, m1 / top
            up_block.append((m0, m1))
            u = (math.log(max(p0 * m0 + p1 * m1, 1e-300)), math.log(max(q0 * m0 + q1 * m1, 1e-300)))
            up_page.append(u)
            belief[0] += u[0]
            belief[1] += u[1]
        # Downward: the page without a block's own message, then the block without a line's own.
        out = [0.0] * len(lines)
        for block, (m0, m1), u in zip(blocks, up_block, up_page, strict=True):
            odds = math.exp(max(-700.0, min(700.0, (belief[1] - u[1]) - (belief[0] - u[0]))))
            down0, down1 = (p0 + odds * q0) * m0, (p1 + odds * q1) * m1
            for i in block:
                o0, o1 = down0 / max(up_line[i][0], 1e-12), down1 / max(up_line[i][1], 1e-12)
                s0, s1 = like[i][0] * (o0 * a0 + o1 * b0), like[i][1] * (o0 * a1 + o1 * b1)
                out[i] = s1 / (s0 + s1) if s0 + s1 else 0.5
        return out

    def furniture_lines(self, description: str | None, title: str | None) -> list[int]:
        """Numbers from 1 of the lines that are page furniture."""
        if not description or not description.strip():
            return []
        return [i + 1 for i, p in enumerate(self.content(repair(description)[1], self.clean_title(title))) if p > 0.5]

    def is_site(self, joined: str) -> bool:
        """Whether a part of a title, as folded words, is a site's name, two typing errors set aside."""
        if (hit := self.named.get(joined)) is None:
            if len(self.named) > 100_000:
                self.named.clear()
            hit = joined in self.sites or (len(joined) > 6 and any(abs(len(s) - len(joined)) <= 2 and _may_be(s, joined) and _close(s, joined) for s in self.sites))
            self.named[joined] = hit
        return hit

    def title_parts(self, title: str | None) -> list[tuple[str, bool]]:
        """The parts of a title between its signs, and whether each belongs to the site."""
        if not title:
            return []
        text = repair(title)[1].strip()
        if not _TITLE_PARTS.search(text):
            return [(text, False)]
        parts = title_pieces(text)
        return [(p, len(parts) > 1 and (self.is_site(" ".join(_words(p))) or _score(title_features(p, signs, self.vocabulary), self.weights) > 0)) for p, signs in parts]

    def title_is_dressed(self, title: str | None) -> bool:
        return any(site for _, site in self.title_parts(title))

    def clean_title(self, title: str | None) -> str:
        if (hit := self.cleaned.get(title)) is None:
            if len(self.cleaned) > 20_000:  # a batch's titles are asked for twice
                self.cleaned.clear()
            hit = self.cleaned[title] = self._clean_title(title)
        return hit

    def _clean_title(self, title: str | None) -> str:
        parts = self.title_parts(title)
        kept = [p for p, site in parts if not site]
        if len(kept) == len(parts) or not kept:
            return parts[0][0] if len(parts) == 1 else repair(title or "")[1].strip()
        return " - ".join(kept)

    def main_text(self, description: str | None, title: str | None) -> str:
        """The main lines of the repaired text joined by one blank, list signs aside."""
        if not description or not description.strip():
            return ""
        text = repair(description)[1]
        lines = [_LIST.sub("", r).strip() for r, p in zip(text.split("\n"), self.content(text, self.clean_title(title)), strict=True) if p <= 0.5]
        return " ".join(x for x in lines if x)


def _may_be(a: str, b: str) -> bool:
    """Two edits leave one of three pieces of ``a`` whole."""
    k = len(a) // 3
    return a[:k] in b or a[k : 2 * k] in b or a[2 * k :] in b


def _close(a: str, b: str) -> bool:
    """Whether two names are within two edits, swaps counted as two."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1] <= 2


def _fill(text: str, rng: random.Random, titles: list[str], sites: list[str]) -> str:
    out = text.replace("{site}", rng.choice(sites)).replace("{plan}", rng.choice(titles))
    if "{name}" in out:
        names = _NAMES.findall(rng.choice(titles))
        out = out.replace("{name}", names[0] if names else "Ana Ruiz")
    words = [w for w in rng.choice(titles).lower().split() if len(w) > 4 and w.isalpha()] or ["cuadernos"]
    out = re.sub(r"\{word\}", lambda _: rng.choice(words), out)
    return re.sub(r"\{n\}", lambda _: str(rng.randint(1, 30000 if rng.random() < 0.3 else 59)), out)


def training_page(rng: random.Random, title: str, text: str, titles: list[str], sites: list[str]) -> list[tuple[str, int]]:
    """A labelled page: its lines with 1 for furniture."""
    sentences = re.split(r"(?<=\.)\s+", text)
    main: list[tuple[str, int]] = []
    while sentences:
        n = rng.randint(1, 4)
        main.append((" ".join(sentences[:n]), 0))
        sentences = sentences[n:]
    for _ in range(rng.randint(0, 2)):
        main.insert(rng.randint(0, len(main)), (_fill(rng.choice(lab.MAIN), rng, titles, sites), 0))
    if rng.random() < 0.3:
        at = rng.randint(0, len(main))
        main[at:at] = [(rng.choice(lab.PROGRAMME_HEADS), 0)] + [(_fill(rng.choice(lab.PROGRAMME), rng, titles, sites), 0) for _ in range(rng.randint(1, 4))]
    if rng.random() < 0.25:
        names = _NAMES.findall(title)
        main.insert(0, (title if rng.random() < 0.6 or not names else rng.choice(titles).split(",")[0].split(":")[0] + " " + names[0], 0))
    if rng.random() < 0.2 and len(main) > 1:  # lines run together
        at = rng.randint(0, len(main) - 2)
        main[at : at + 2] = [(main[at][0] + " " + main[at + 1][0], 0)]
    if rng.random() < 0.15:  # a list's signs
        main = [("• " + x, y) for x, y in main]
    if rng.random() < 0.25:  # cut off by a feed
        main = main[: rng.randint(1, len(main))]
        main[-1] = (main[-1][0][: rng.randint(5, 160)] + rng.choice(["…", " […]", "..."]), 0)
    if rng.random() < 0.3:
        return main
    page: list[tuple[str, int]] = []
    if rng.random() < 0.6:
        words = rng.sample(lab.MENU_WORDS, rng.randint(3, 10))
        page += [(w, 1) for w in words] if rng.random() < 0.35 else [(rng.choice(lab.MENU_SIGNS).join(words), 1)]
    if rng.random() < 0.6:
        page.insert(rng.randint(0, 1) * len(page), (f"{rng.choice(lab.COOKIE_STARTS)} {rng.choice(lab.COOKIE_PURPOSES)} {rng.choice(lab.COOKIE_BUTTONS)}", 1))
    between: list[list[tuple[str, int]]] = [[(_fill(rng.choice(lab.FURNITURE), rng, titles, sites), 1)] for _ in range(rng.randint(1, 5))]
    if rng.random() < 0.4:
        between.append([(rng.choice(lab.TEASER_HEADS), 1)] + [(rng.choice(titles), 1) for _ in range(rng.randint(2, 5))])
    body: list[list[tuple[str, int]]] = [[m] for m in main]
    for b in between:
        body.insert(len(body) if rng.random() < 0.6 else rng.randint(0, len(body)), b)
    return page + [x for b in body for x in b]


def train(examples: list[tuple[str, str]], sites: Iterable[str], seed: int = 7) -> Model:
    """A model from (title, clean description) examples and names of sites."""
    rng = random.Random(seed)
    sites = sorted({s for s in sites if s}) or ["La Revista"]
    examples = [(t, x) for t, x in examples if t and x] or [("Concierto de ejemplo", "Una tarde de música en la plaza. La entrada es libre.")]
    titles = [t for t, _ in examples]
    pages = []
    for _ in range(TRAINING_PAGES):
        title, text = rng.choice(examples)
        page = training_page(rng, title, text, titles, sites)
        case = rng.random()
        change = str.lower if case < 0.06 else str.upper if case < 0.1 else str
        pages.append((title, [(change(x), y) for x, y in page]))
    seen = Counter(w for t, x in examples for w in {*_words(t), *_words(x)})
    # Words of fewer examples are left to the unknown ones, so that names don't become evidence.
    vocabulary = {w for w, n in seen.most_common(FEATURES // 4) if n >= max(4, len(examples) // 500)}
    vocabulary |= {w for t in [*lab.FURNITURE, *lab.MAIN, *lab.PROGRAMME, *lab.MENU_WORDS, *lab.TEASER_HEADS, *lab.TITLE_FURNITURE] for w in _words(t) if w not in ("site", "plan", "name", "n", "word")}
    vocabulary |= {w for s in sites for w in _words(s)}
    rows: list[tuple[dict[str, float], int]] = []
    heads = {" ".join(_words(h)) for h in lab.TEASER_HEADS}
    line_block = [[2.0, 0.2], [0.2, 2.0]]
    block_page = [[8.0, 0.1], [1.0, 1.0]]
    page_kind = [1.0, 1.0]
    for title, page in pages:
        lines = [_Line(x, vocabulary) for x, _ in page]
        own = {w for w in _words(title) if len(w) > 3}
        for i, ((x, y), line) in enumerate(zip(page, lines, strict=True)):
            rows.append((line_features(x.strip(), _words(x.strip()), vocabulary) | page_features(line, own, i, len(page) - 1), y))
        kind = int(any(y for _, y in page))
        page_kind[kind] += 1
        for block in blocks_of(lines, heads):
            b = int(sum(page[i][1] for i in block) * 2 > len(block))
            block_page[kind][b] += 1
            for i in block:
                line_block[b][page[i][1]] += 1 if len(block) > 1 else 0
    for t, _ in examples:  # parts of dressed titles
        if rng.random() < 0.4 and (turned := re.split(r": |\. |, ", t, maxsplit=1))[1:]:
            t = f"{turned[1]} – {turned[0]}"
        if rng.random() < 0.3:
            t = f"{rng.choice(lab.CATEGORIES)}: {t}" if rng.random() < 0.7 else f"{t} – {rng.choice(lab.CATEGORIES)}"
        if rng.random() < 0.4:
            t += rng.choice([" - ", " | ", " @ ", " en "]) + f"{rng.choice(lab.PLACES)} {(_NAMES.findall(t) or ['Mayor'])[0].split()[-1]}"
        own = len(title_pieces(t))
        dress = rng.random()
        if dress < 0.3:
            pieces = title_pieces(f"Inicio » {rng.choice(lab.MENU_WORDS)} » {t}")
            site = range(len(pieces) - own)
        elif dress < 0.6:
            sign = rng.choice([" - ", " | ", " · "])
            pieces = title_pieces(t + "".join(sign + x for x in rng.sample(lab.TITLE_FURNITURE, rng.randint(1, 2))))
            site = range(own, len(pieces))
        else:
            pieces, site = title_pieces(t), range(0)
        change = rng.choice([str, str, str, str.lower, str.upper])
        rows += [(title_features(change(p), signs, vocabulary), int(i in site)) for i, (p, signs) in enumerate(pieces)]
    weights: dict[str, float] = {}
    for epoch in range(4):
        rng.shuffle(rows)
        rate = 0.3 / (1 + epoch)
        for f, y in rows:
            error = y - 1 / (1 + math.exp(-max(-30.0, min(30.0, _score(f, weights)))))
            if abs(error) > 0.01:
                for k, v in f.items():
                    w = weights.get(k, 0.0)
                    weights[k] = w + rate * (error * v - 0.0002 * w)
    weights = dict(sorted(weights.items(), key=lambda kv: -abs(kv[1]))[:FEATURES])
    share = lambda rows: [[x / sum(r) for x in r] for r in rows]
    return Model(weights, vocabulary, share(line_block), share(block_page), share([page_kind])[0], {" ".join(_words(s)) for s in sites})


def fit(clean: DataFrame, title: str, description: str, sites: DataFrame, name: str) -> Model:
    """A model from at most ``SAMPLE_ROWS`` clean rows, chosen by a hash of their text, and the sites' names."""
    rows = clean.select(F.col(title).alias("t"), F.col(description).alias("x")).where("trim(t) <> '' and length(x) > 100")
    # Only what passes the hash reaches the driver, some 1.5 samples, however many partitions there are.
    share = min(1.0, 1.5 * SAMPLE_ROWS / max(rows.count(), 1))
    by = F.pmod(F.xxhash64("x", "t"), F.lit(1 << 40))
    chosen = rows.select("t", "x", by.alias("h")).where(F.col("h") <= int(share * (1 << 40)))
    sample = sorted(chosen.collect(), key=lambda r: (r.h, r.x, r.t))[:SAMPLE_ROWS]
    return train([(r.t, r.x) for r in sample], [r.n for r in sites.select(F.col(name).alias("n")).where("n <> ''").distinct().collect()])


def page_furniture(df: DataFrame, key: str, title: str, description: str, model: Model) -> DataFrame:
    """(key, line_no) of each piece of page furniture; line 0 is the title."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, numbers = [], []
            for k, t, x in zip(b["k"], b["t"], b["x"], strict=True):
                found = ([0] if model.title_is_dressed(t) else []) + model.furniture_lines(x, t)
                keys += [k] * len(found)
                numbers += found
            yield pd.DataFrame({key: pd.Series(keys, dtype=b["k"].dtype), "line_no": pd.Series(numbers, dtype="int32")})

    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{title}`").alias("t"), F.col(f"`{description}`").alias("x"))
    return rows.mapInPandas(run, f"`{key}` {rows.schema['k'].dataType.simpleString()}, line_no int")


def main_content(df: DataFrame, key: str, title: str, description: str, model: Model) -> DataFrame:
    """(key, title, text): the plan's own title and the main text of its page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b["k"], "title": [model.clean_title(t) for t in b["t"]], "text": [model.main_text(x, t) for t, x in zip(b["t"], b["x"], strict=True)]})

    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{title}`").alias("t"), F.col(f"`{description}`").alias("x"))
    return rows.mapInPandas(run, f"`{key}` {rows.schema['k'].dataType.simpleString()}, title string, text string")
