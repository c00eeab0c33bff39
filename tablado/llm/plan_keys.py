"""What tells whether two listing rows name the same plan: the page's address and the title's parts."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations, permutations

import numpy as np
import xxhash

from tablado.llm.canonical import Dictionary, deletes, edits_allowed, kind_of
from tablado.llm.content import Model
from tablado.llm.encoding import fold, repair

# Query parameters that only track where a visitor came from, and endings of other renderings.
TRACKING = re.compile(r"^(?:utm_\w*|fbclid|gclid|dclid|msclkid|mc_[ce]id|ref|source|src|campaign|origen|igshid|_ga|yclid)$", re.I)
RENDERINGS = re.compile(r"/(?:amp|print|imprimir|movil|mobile|index\.(?:html?|php))$", re.I)
RENDERING_PARAMETERS = re.compile(r"^(?:amp|print|output|outputtype|view|format)$", re.I)
HOST_PREFIX = re.compile(r"^(?:www\d?|m|mobile|movil|amp)\.(?=[^.]+\.)")
# Small words of Spanish and English titles.
STOP = set("a al and con de del e el en entre la las lo los of o por su sus the u un una unos unas y &".split())
# Words that number a part of a series, with one name for each kind.
SERIES = {
    "vol": "vol", "volumen": "vol", "volume": "vol", "tomo": "vol", "edicion": "edicion", "ed": "edicion", "edition": "edicion", "sesion": "sesion",
    "session": "sesion", "pase": "sesion", "jornada": "dia", "dia": "dia", "day": "dia", "parte": "parte", "part": "parte", "capitulo": "capitulo", "episodio": "capitulo", "no": "no", "num": "no", "numero": "no",
}
#: Marks a common word of a rewording in a signature.
REWORDED = "~"
_ROMAN = re.compile(r"^(?=[ivxl])(?:xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
_TOKEN = re.compile(r"[^\W_�]*�[^\W_]*(?:�[^\W_]*)*|[^\W_]+")
_SPLIT = re.compile(r"\s+[-–—|·@•]\s+|\s*[:;]\s+|\s*@\s*")


def page_key(url: str | None) -> str:
    """The page an address means: host without prefix, path and query without tracking and renderings; '' for none."""
    if not url or not (u := url.strip()):
        return ""
    u = re.sub(r"^[a-z][a-z0-9+.-]*://|^//", "", u, flags=re.I).split("#", 1)[0]
    rest, _, query = u.partition("?")
    host, slash, path = rest.partition("/")
    host = HOST_PREFIX.sub("", host.lower().split("@")[-1].removesuffix(":80").removesuffix(":443"))
    path = re.sub(r"/{2,}", "/", "/" + path).rstrip("/")
    while RENDERINGS.search(path):
        path = RENDERINGS.sub("", path).rstrip("/")
    kept = sorted({p for p in query.split("&") if p and not TRACKING.match(p.split("=", 1)[0]) and not RENDERING_PARAMETERS.match(p.split("=", 1)[0])})
    return host + path + ("?" + "&".join(kept) if kept else "")


def _number(token: str) -> int | None:
    t = re.sub(r"(?<=\d)(?:a|o|ª|º|st|nd|rd|th)$", "", token)
    if t.isdigit():
        return int(t)
    if t and _ROMAN.match(t):
        values = {"i": 1, "v": 5, "x": 10, "l": 50}
        return sum(values[a] if values[a] >= values.get(b, 0) else -values[a] for a, b in zip(t, t[1:] + " "))
    return None


def edits(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance, a lost character standing for any; ``most`` + 1 if beyond ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    if "�" not in a and "�" not in b:
        # What both begin and end with costs nothing; most pairs are settled by what is left.
        i, n = 0, min(len(a), len(b))
        while i < n and a[i] == b[i]:
            i += 1
        j = 0
        while j < n - i and a[-1 - j] == b[-1 - j]:
            j += 1
        a, b = a[i : len(a) - j], b[i : len(b) - j]
        if not a or not b:
            return min(len(a) + len(b), most + 1)
        if len(a) == len(b) == 1:
            return 1
        if most == 1:
            return 1 if len(a) == len(b) == 2 and a == b[::-1] else 2
        # Each letter that only one of them has takes an edit.
        if len(set(a).difference(b)) > most or len(set(b).difference(a)) > most:
            return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y and x != "�" and y != "�"))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


#: The most pairs of a token and a common word that are looked at at once.
_AT_ONCE = 1 << 20


def _codes(words: list[str], n: int) -> np.ndarray:
    return np.array(words, dtype=f"U{n}").view(np.uint32).reshape(len(words), n)


def _letters(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The letters of the first and of the last 1, 2, .. ``n`` characters of words of ``n``, as bits.

    The letters have a bit each, all other characters six together; one edit changes at most two bits.
    """
    codes = _codes(words, n)
    bits = np.uint32(1) << np.where((codes >= 97) & (codes <= 122), codes - np.uint32(97), 26 + codes % 6).astype(np.uint32)
    return np.bitwise_or.accumulate(bits, axis=1), np.bitwise_or.accumulate(bits[:, ::-1], axis=1)


def _within_two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ``edits`` of each pair is 2 at most; rows are the characters of words without lost ones.

    All words of ``a`` are of one length and so are those of ``b``, which differ by two at most.
    """
    n, m = a.shape[1], b.shape[1]
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    before, last = {}, {j: np.full(a.shape[1], j, dtype=np.uint8) for j in range(min(2, m) + 1)}
    for i in range(1, n + 1):
        row = {0: np.full(a.shape[1], i, dtype=np.uint8)} if i <= 2 else {}
        for j in range(max(1, i - 2), min(m, i + 2) + 1):
            best = last[j - 1] + (a[i - 1] != b[j - 1])
            for beside in (row.get(j - 1), last.get(j)):
                if beside is not None:
                    best = np.minimum(best, beside + 1)
            if j - 2 in before and i > 1:
                swapped = (a[i - 1] == b[j - 2]) & (a[i - 2] == b[j - 1])
                best = np.minimum(best, before[j - 2] + np.where(swapped, 1, 9).astype(np.uint8))
            row[j] = best
        before, last = last, row
    return last[m] <= 2


class _Near:
    """Tells which tokens are within two edits of one of some words; letters settle most, many at once.

    Of words of 2h + 1 letters or more, one edit changes the first h or the last h letters, not both.
    """

    def __init__(self, words: set[str]) -> None:
        by: dict[int, list[str]] = {}
        for w in sorted(words - {""}):
            by.setdefault(len(w), []).append(w)
        self.lost = any("�" in w for w in words)
        self.words = {n: (ws, *_letters(ws, n)) for n, ws in by.items()}

    def apart(self, tokens: set[str]) -> list[str]:
        """Those of the tokens that are more than two edits from every word, lost characters set aside."""
        by: dict[int, list[str]] = {}
        for t in tokens if not self.lost else ():
            if t and "�" not in t:
                by.setdefault(len(t), []).append(t)
        out = []
        for n, ts in by.items():
            own, first, last = _codes(ts, n), *_letters(ts, n)
            near = np.zeros(len(ts), dtype=bool)
            for m in range(n - 2, n + 3):
                if m not in self.words:
                    continue
                words, wfirst, wlast = self.words[m]
                codes = _codes(words, m)
                h, step = (min(n, m) - 1) // 2, max(1, _AT_ONCE // len(words))
                for a in range(0, len(ts), step):
                    parts = lambda x, y, a=a, step=step: np.bitwise_count(x[a : a + step, None] ^ y[None, :])
                    close = parts(first[:, -1], wfirst[:, -1]) <= 4
                    if h:
                        close &= parts(first[:, h - 1], wfirst[:, h - 1]) + parts(last[:, h - 1], wlast[:, h - 1]) <= 4
                    i, j = close.nonzero()
                    near[a + i[_within_two(own[a + i], codes[j])]] = True
            out += [t for t, x in zip(ts, near.tolist(), strict=True) if not x]
        return out


@dataclass
class Titles:
    """Takes titles apart.  ``vocabulary``: words that many titles share; the rest are proper names.

    ``phrases``: those of them that no accepted plan's title has; they tell a rewording ("X llega a la sala").
    """

    vocabulary: set[str]
    phrases: set[str]
    categories: set[str]
    venues: Dictionary
    model: Model
    near: dict[str, str] = field(default_factory=dict)
    memo: dict[str, str] = field(default_factory=dict)
    far: dict[str, set[str]] = field(default_factory=dict)
    far_memo: dict[str, tuple[str, ...]] = field(default_factory=dict)
    part_memo: dict[str, bool] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.vocabulary = self.vocabulary | set(SERIES)
        for w in sorted(self.vocabulary):
            if len(w) >= 5:
                for d in deletes(w, 1):
                    if len(d) >= 4:
                        self.near.setdefault(d, w)
                for d in deletes(w, 2):
                    self.far.setdefault(d, set()).add(w)
        self.near_any = _Near(self.vocabulary)
        self.venue_kinds = {kind_of(f) for f in self.venues.folded.values()} - {""}
        self.venue_longest = max((len(f) for f in self.venues.folded.values()), default=0) + 2

    def word(self, token: str) -> str:
        """The common word that a token is or, with one typing error, was meant to be."""
        if token in self.vocabulary or len(token) < 4:
            return token
        if (hit := self.memo.get(token)) is None:
            hit = token
            for i in range(-1, len(token)):
                d = token if i < 0 else token[:i] + token[i + 1 :]
                w = self.near.get(d)
                if w and (i < 0 or edits(token, w, 1) <= 1):
                    hit = w
                    break
            if "�" in token and hit == token:
                pattern = re.compile(re.escape(token).replace("�", ".") + "$")
                hit = min((w for w in self.vocabulary if len(w) == len(token) and pattern.match(w)), default=token)
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[token] = hit
        return hit

    def look_at(self, tokens: set[str]) -> None:
        """Remembers which tokens no common word is within two typing errors of, so that none is tried."""
        new = {t for t in tokens if t not in self.far_memo and t not in self.vocabulary}
        for memo in (self.memo, self.far_memo):
            if len(memo) + len(new) > 200_000:
                memo.clear()
        for t in self.near_any.apart(new):
            self.memo[t], self.far_memo[t] = t, ()

    def damaged(self, token: str) -> tuple[str, ...]:
        """The common words that a proper name may be with two typing errors."""
        if (hit := self.far_memo.get(token)) is None:
            n = len(token)
            one = [token[:i] + token[i + 1 :] for i in range(n)]
            tried = {token, *one, *(d[:j] + d[j + 1 :] for i, d in enumerate(one) for j in range(i, n - 1))}
            words = {w for d in tried if d in self.far for w in self.far[d]}
            hit = tuple(sorted(w for w in words if edits(w, token, 2) <= 2))
            if len(self.far_memo) > 200_000:
                self.far_memo.clear()
            self.far_memo[token] = hit
        return hit

    def other_readings(self, title: tuple[str, str, list[str]]) -> list[tuple[str, str, list[str]]]:
        """The title with a proper name taken for the common word that it may be with two typing errors."""
        common, series, names = title
        out = []
        for i, t in enumerate(names):
            for w in self.damaged(t) if len(names) > 1 else ():
                words = {*common.split(), REWORDED + w if w in self.phrases else w}
                out.append((" ".join(sorted(words)), series, names[:i] + names[i + 1 :]))
        return out

    def is_aside(self, part: str) -> bool:
        """Whether a part of a title is a category or a venue; remembered, as few parts are."""
        if (hit := self.part_memo.get(part)) is None:
            if len(self.part_memo) > 200_000:
                self.part_memo.clear()
            hit = self.part_memo[part] = self.is_category(part) or self.is_venue(part)
        return hit

    def is_category(self, text: str) -> bool:
        return text in self.categories or (3 < len(text) < 24 and any(abs(len(c) - len(text)) <= 1 and edits(text, c, 1) <= 1 for c in self.categories))

    def is_venue(self, text: str) -> bool:
        return len(text) <= self.venue_longest and kind_of(text) in self.venue_kinds and self.venues.match(text) != -1

    def parse(self, title: str | None) -> tuple[str, str, list[str]] | None:
        """(common words, place in a series, proper names) or None for a title that names nothing."""
        return self._parsed(self._tokens(title))

    def parse_all(self, titles: Iterable[str | None]) -> list[tuple[str, str, list[str]] | None]:
        """``parse`` of each title, with the words of all looked at together."""
        found = [self._tokens(t) for t in titles]
        self.look_at({w for tokens in found for w in tokens})
        return [self._parsed(tokens) for tokens in found]

    def _tokens(self, title: str | None) -> list[str]:
        if not title or not title.strip():
            return []
        text = self.model.clean_title(title)
        if "&" in text:
            text = repair(html.unescape(text))[1]
        tokens: list[str] = []
        for p in _SPLIT.split(fold(text)):
            found = _TOKEN.findall(p)
            if not found or self.is_aside(" ".join(found)):
                continue
            head, _, tail = p.rpartition(" en ")
            if head and self.is_venue(" ".join(_TOKEN.findall(tail))):
                found = _TOKEN.findall(head)
            tokens += found
        return tokens

    def _parsed(self, tokens: list[str]) -> tuple[str, str, list[str]] | None:
        tokens = [t if t in self.vocabulary else self.word(t) for t in tokens]
        series, rest, i = set(), [], 0
        while i < len(tokens):
            a, b = tokens[i], tokens[i + 1] if i + 1 < len(tokens) else ""
            if a in SERIES and (n := _number(b)) is not None:
                series.add(f"{SERIES[a]}{n}")
                i += 2
            elif b in SERIES and SERIES[b] != "no" and (n := _number(a)) is not None:
                series.add(f"{SERIES[b]}{n}")
                i += 2
            else:
                rest.append(a)
                i += 1
        rest = [t for t in rest if t not in STOP and (len(t) > 2 or t.isdigit())]
        if not rest:
            return None
        common = sorted({REWORDED + t if t in self.phrases else t for t in rest if t in self.vocabulary})
        # Unknown words of three letters are small words with a typing error.
        names = [t for t in dict.fromkeys(rest) if t not in self.vocabulary and (len(t) > 3 or t.isdigit())]
        if not common and not names:
            return None
        return " ".join(common), " ".join(sorted(series)), names


def _half_left(a: str, b: str) -> bool:
    """One error leaves the first or the last half of a word whole."""
    k = (min(len(a), len(b)) - 1) // 2
    return a[:k] == b[:k] or a[-k:] == b[-k:] or "�" in a or "�" in b


def _piece_left(a: str, b: str) -> bool:
    """Two errors leave one of three pieces of ``a`` whole."""
    k = len(a) // 3
    return "�" in a or "�" in b or a[:k] in b or a[k : 2 * k] in b or a[2 * k :] in b


def may_be_same(a: tuple[str, str, list[str]], b: tuple[str, str, list[str]]) -> bool:
    """A quick necessary condition of ``same_title`` for titles with two proper names each.

    Two names with one error each keep their first or their last letter; more errors in both are too many.
    """
    if a[1] != b[1]:
        return False
    x, y = a[2], b[2]
    if len(x) != 2 or len(y) != 2:
        return True
    p, q = x
    r, s = y
    if p == r or q == s or p == s or q == r or "�" in p or "�" in q or "�" in r or "�" in s:
        return True
    return ((p[0] == r[0] or p[-1] == r[-1]) and (q[0] == s[0] or q[-1] == s[-1])) or ((p[0] == s[0] or p[-1] == s[-1]) and (q[0] == r[0] or q[-1] == r[-1]))


def same_title(a: tuple[str, str, list[str]], b: tuple[str, str, list[str]]) -> bool:
    """Whether two titles taken apart name the same event.

    The place in a series must be the same.  With the same proper names (two or more), common words may differ
    by typing errors and lost short words, or altogether if one title is a rewording.  With the same common
    words but for one, proper names may differ by a few typing errors.
    """
    if a[1] != b[1]:
        return False
    ca, cb = set(a[0].split()), set(b[0].split())
    na, nb = list(a[2]), list(b[2])
    only_a, only_b = ca - cb, cb - ca
    if len(na) >= 2 and sorted(na) == sorted(nb):
        if any(x.startswith(REWORDED) for x in only_a | only_b):
            return True
        for x in sorted(only_a):
            if m := next((y for y in sorted(only_b) if edits(x, y, 2) <= 2), None):
                only_a.discard(x)
                only_b.discard(m)
        return all(len(x) <= 4 for x in only_a | only_b) and len(only_a | only_b) <= 1
    if len(only_a) > 1 or len(only_b) > 1:
        return False
    if not na or not nb:
        return na == nb and not only_a and not only_b
    # A common word with two typing errors may have been taken for a name.
    for x in list(only_a):
        if m := len(x) > 4 and next((t for t in nb if t not in na and edits(x, t, 2) <= 2), None):
            nb.remove(m)
            only_a.discard(x)
    for x in list(only_b):
        if m := len(x) > 4 and next((t for t in na if t not in nb and edits(x, t, 2) <= 2), None):
            na.remove(m)
            only_b.discard(x)
    if only_a or only_b or len(na) != len(nb) or not na:
        return False
    left = [t for t in na if t not in nb]
    free = [t for t in nb if t not in na]
    total = 0
    for x in left:
        best = (9, "")
        for y in free:
            # One error in a short name, two in a long one.
            most = min(edits_allowed(min(len(x), len(y))), 1 if len(x) < 9 else 2)
            if most and (_half_left(x, y) if most == 1 else _piece_left(x, y)) and (e := edits(x, y, most)) <= most and e < best[0]:
                best = (e, y)
        total += best[0]
        if total > 2:
            return False
        free.remove(best[1])
    return True


def signature(parsed: tuple[str, str, list[str]]) -> str:
    return "|".join((parsed[0], parsed[1], " ".join(parsed[2])))


def parsed(sig: str) -> tuple[str, str, list[str]]:
    a, b, c = sig.split("|")
    return a, b, c.split()


def sort_keys(sig: str) -> list[str]:
    """The keys of the passes: common words then names, the same from the names' end, and either name first."""
    common, series, names = parsed(sig)
    joined = " ".join(names)
    head = f"{common}|{series}|"
    return [head + joined, head + joined[::-1], f"{joined}|{head}", f"{' '.join(names[::-1])}|{head}"]


def of_sort_key(number: int, key: str) -> str:
    """The signature of which ``key`` is the sort key of a pass."""
    a, b, c = key.split("|")[:3]
    if number == 0:
        return key
    if number == 1:
        return f"{a}|{b}|{c[::-1]}"
    return f"{b}|{c}|{a if number == 2 else ' '.join(a.split()[::-1])}"


#: What the titles under a block key share: all proper names; or all common words and like names.
PERFORMER, LIKE = range(2)
_MASK = (1 << 64) - 1
_ODD = 0x9E3779B97F4A7C15


@lru_cache(200_000)
def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text)


@lru_cache(200_000)
def _ends(name: str) -> tuple[int, ...]:
    """A name with one error has at least one of these too: its first or its last letters."""
    n = len(name)
    if n < 4:
        return (_hash("=" + name),)
    sizes = (3,) if n > 7 else (3, 2) if n == 7 else (2,) if n == 6 else (2, 1) if n == 5 else (1,)
    return tuple({_hash(x) for k in sizes for x in (f"<{name[:k]}", f">{name[-k:]}")})


def _pieces(name: str) -> tuple[int, ...]:
    """A name with two errors, which only long ones may have, has at least one of these too."""
    return tuple({_hash(f"#{name[i : i + 3]}") for i in range(len(name) - 2)}) if len(name) >= 8 else ()


def _name_keys(names: list[str]) -> set[int]:
    """Names that are the same but for two errors have at least one of these too; a sum stands for a set."""
    if len(names) == 1:
        return {*_ends(names[0]), *_pieces(names[0])}
    if len(names) == 2:
        p, q = names
        out = {x + y for x in _ends(p) for y in _ends(q)}
        if len(q) >= 8:  # two errors in one leave the other whole
            out.add(_hash("=" + p))
        if len(p) >= 8:
            out.add(_hash("=" + q))
        return out
    if len(names) == 3:  # at least one is whole
        return {_hash("=" + p) + x for p, q in permutations(names, 2) for x in _ends(q)}
    return {_hash("=" + p) + _hash("=" + q) for p, q in combinations(names, 2)}  # at least two are whole


def block_keys(title: tuple[str, str, list[str]]) -> Iterator[tuple[int, int]]:
    """(kind, 64-bit key): titles for which ``same_title`` holds share a key, one of them perhaps under
    another reading (see ``Titles.other_readings``).

    Not covered are names in both halves of which characters are lost.
    """
    common, series, names = title
    if not names:
        return
    if len(names) > 1:
        yield PERFORMER, _hash(f"P|{series}|{' '.join(sorted(names))}")
    base = _hash(f"L|{series}|{len(names)}|{common}")
    for k in _name_keys(names):
        yield LIKE, (base + k * _ODD) & _MASK


def near_sets(sets: list[frozenset[str]]) -> Iterator[tuple[int, int]]:
    """(i, j), i > j: all pairs of sets that may be the same but for typing errors and one short word."""
    if len(sets) <= 12:
        yield from ((i, j) for i in range(len(sets)) for j in range(i))
        return
    holders: dict[str, list[int]] = {}
    for i, s in enumerate(sets):
        for w in s:
            holders.setdefault(w, []).append(i)
    by_delete: dict[str, list[str]] = {}
    for w in holders:
        for d in deletes(w, 2) | ({""} if len(w) <= 2 else set()):
            by_delete.setdefault(d, []).append(w)
    near = {w: [v for v in {v for d in [*deletes(w, 2), ""] for v in by_delete.get(d, ())} if edits(w, v, 2) <= 2] for w in holders}
    held = {w: sum(len(holders[v]) for v in near[w]) for w in holders}
    for i, s in enumerate(sets):
        # At most one word, a short one, has no counterpart.
        pivots = sorted(s, key=lambda w: (held[w], w))
        found = {j for w in (pivots[:1] if pivots and len(pivots[0]) > 4 else pivots[:2]) for v in near[w] for j in holders[v]}
        if len(s) <= 1 and all(len(w) <= 4 for w in s):
            found |= {j for j, t in enumerate(sets) if len(t) <= 1 and all(len(w) <= 4 for w in t)}
        yield from ((i, j) for j in found if j < i)
