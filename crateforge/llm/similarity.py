"""Comparing names of releases: normal form, longest common subsequence, editions and volumes. Shared by p1 and p2."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from crateforge.llm.textform import loosely

# Latin spelling of Cyrillic letters, and letters without a decomposition.
_CYRILLIC = dict(zip("абвгдезийклмнопрстуфхыэ", "abvgdezijklmnoprstufhye", strict=True)) | {"ё": "jo", "ж": "j", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ь": "", "ю": "ju", "я": "ja", "і": "i", "ї": "ji", "є": "e", "ґ": "g", "ј": "j"}
_PLAIN = {"ł": "l", "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "ŋ": "n", "ħ": "h"}
_FOLD = str.maketrans(_CYRILLIC | _PLAIN | {"y": "j"})
# Words that make another edition of a release, words before the number of a volume, Roman numerals.
_EDITION_WORDS = ("live", "demos", "demo", "deluxe", "remastered", "remaster", "instrumentals", "instrumental", "expanded", "acoustic", "anniversary", "bonus", "unplugged", "mono", "stereo", "ep", "single", "remixes", "remix", "karaoke", "acapella", "reissue")
_VOLUME = frozenset("vol volume part pt no nr teil chapter cd disc disk book number tome bd band".split())
_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12}
_NUMBER = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6}
_CREDIT = re.compile(r"\s+(?:feat\.?|featuring|ft\.?|presents|pres\.|vs\.?)\s+.*$", re.I)
_VARIOUS = frozenset(("va", "various", "various artists", "various artist", "v a", "vv aa", "diverse", "compilation"))


@lru_cache(20_000)
def fold(s: str) -> str:
    """Lower case without accents, in Latin letters; look-alikes repaired."""
    s = loosely(s).casefold().replace("й", "j").replace("ё", "jo")
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).translate(_FOLD)


EDITIONS = frozenset(fold(w) for w in _EDITION_WORDS)
#: Scores below this decide nothing; between it and a match lies a wide gap.
ENOUGH = 0.72
_TOKENS = re.compile(r"[^\W_]+")


@lru_cache(20_000)
def tokens(s: str) -> tuple[str, ...]:
    """Words of the folded text; an apostrophe is no border."""
    return tuple(_TOKENS.findall(re.sub(r"(?<=\w)['’`´](?=\w)", "", fold(s))))


@lru_cache(20_000)
def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        if u := v & where.get(ch, 0):
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths."""
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


_BRACKET = re.compile(r"[(\[{]([^()\[\]{}]*)[)\]}]")


@lru_cache(20_000)
def _edition(w: str) -> str | None:
    """The edition word meant by a shortened or misspelled one."""
    if w in EDITIONS:
        return w
    for e in sorted(EDITIONS):
        if len(e) > 3 and len(w) > 2 and w[0] == e[0] and (re.sub("[aeiou]", "", e) == w or ratio(w, e) >= 0.8):
            return e
    return None


@lru_cache(20_000)
def title_parts(s: str) -> tuple[tuple[str, ...], frozenset[str], int | None]:
    """(words of the bare title, edition words, number of the volume)."""
    t = list(tokens(s))
    edition = set()
    number = None
    for inner in _BRACKET.findall(s):
        words = tokens(inner)
        for w in words:
            if w not in EDITIONS and w in t and (e := _edition(w)) and "sessions" not in words:
                t[t.index(w)] = e
    for i in range(len(t) - 1, 0, -1):
        w = t[i]
        if w in EDITIONS and not (w == "live" and i < len(t) - 1 and t[i + 1] in ("at", "in", "from")):
            edition.add({"demo": "demos", "remaster": "remastered", "instrumental": "instrumentals", "remix": "remixes"}.get(w, w))
            t.pop(i)
    t = [w for i, w in enumerate(t) if not (edition and i and w in ("edition", "version", "ed", "bonus"))]
    for i in range(len(t) - 1, 0, -1):
        w = t[i]
        value = int(w) if w.isdigit() and len(w) < 4 else _ROMAN.get(w) or _NUMBER.get(w)
        if value is not None and t[i - 1] in _VOLUME and i > 1:
            number = value
            del t[i - 1 : i + 1]
            break
        if m := re.fullmatch(r"(?:vol|volume|part|pt|no)(\d{1,2})", w):
            number = int(m[1])
            del t[i]
            break
        if i == len(t) - 1 and value is not None and (w.isdigit() or w in _ROMAN and len(t) > 2 or w in ("ii", "iii", "iv")):
            number = value
            del t[i]
            break
    return tuple(t), frozenset(edition), number


@lru_cache(20_000)
def artist_words(s: str) -> tuple[str, ...]:
    """Words of the artist's name, without the guests credited after it and without a leading or trailing article."""
    t = tokens(_CREDIT.sub("", s))
    if len(t) > 1 and t[0] == "the":
        t = t[1:]
    if len(t) > 1 and t[-1] == "the":
        t = t[:-1]
    joined = " ".join(t)
    return ("various", "artists") if joined in _VARIOUS else t


def aligned(a: tuple[str, ...], b: tuple[str, ...], light: frozenset[str]) -> float:
    """Mean of the best word-by-word subsequence ratios, words of everyday titles weighing little, in both directions."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    total = weight = 0.0
    for x, y in ((a, b), (b, a)):
        free = list(y)
        for w in sorted(x, key=lambda k: (k in light, -len(k))):
            k = (0.15 if w in light else 1.0) * (1 if len(w) < 3 else 2)
            best, at = 0.0, None
            for i, z in enumerate(free):
                r = _near(w, z)
                if r > best:
                    best, at = r, i
            if at is not None and best > 0.5:
                free.pop(at)
                total += k * best
            weight += k
    return total / weight


@lru_cache(50_000)
def _near(w: str, z: str) -> float:
    if w == z:
        return 1.0
    n, m = len(w), len(z)
    short, long = (w, z) if n < m else (z, w)
    if len(short) > 2 and long.startswith(short):
        return max(0.9, ratio(w, z))
    c = lcs(w, z)
    if len(short) > 1 and c == len(short) and short[0] == long[0] and not set("aeiou") & set(short[1:]):
        return 0.92
    return 2 * c / (n + m)


def initials(words: tuple[str, ...]) -> str:
    return "".join(w[0] for w in words)


def artist_score(a: str, b: str, light: frozenset[str]) -> float:
    """How surely two credits name one artist: 0 to 1."""
    x, y = artist_words(a), artist_words(b)
    if x == y:
        return 1.0
    if not x or not y:
        return 0.0
    jx, jy = "".join(x), "".join(y)
    if jx == jy:
        return 1.0
    for p, q, full in ((jx, y, b), (jy, x, a)):
        if 2 <= len(p) <= 5 and len(q) > 1 and p in (initials(q), initials(tokens(full))):
            return 0.9
    best = max(ratio(jx, jy), aligned(x, y, light))
    if len(x) == len(y) and len(x) > 1 and all(p == q or (len(p) == 1 or len(q) == 1) and p[0] == q[0] for p, q in zip(x, y, strict=True)) and x[-1] == y[-1]:
        best = max(best, 0.9)
    if len(x) == len(y) == 2:
        # a short form of a given name beside the same family name, in either order
        for p, q in ((x, y), (x[::-1], y)):
            if p[1] not in light or q[1] == p[1]:
                near = _near(p[1], q[1])
                if near >= 0.8 and len(p[1]) > 4:
                    best = max(best, 0.84 * min(1.0, near + 0.1))
    small, big = (set(x), set(y)) if len(x) < len(y) else (set(y), set(x))
    if small <= big and sum(len(w) for w in small - light) > 4:
        best = max(best, 0.86)
    return best


def title_score(a: str, b: str, light: frozenset[str]) -> float:
    """How surely two titles name one album of the same volume and edition: 0 to 1."""
    (x, ex, nx), (y, ey, ny) = title_parts(a), title_parts(b)
    if ex != ey or nx != ny:
        return 0.0
    jx, jy = "".join(x), "".join(y)
    if jx == jy:
        return 1.0
    if not jx or not jy:
        return 0.0
    n, m = len(jx), len(jy)
    if 2 * min(n, m) < ENOUGH * (n + m) or (whole := ratio(jx, jy)) + 0.06 < ENOUGH:
        return 0.0
    return max(min(whole + 0.06, 0.5 * whole + 0.5 * aligned(x, y, light)), aligned(x, y, light) if sorted(x) == sorted(y) else 0.0)


def release_score(artist: str, title: str, artist2: str, title2: str, light: frozenset[str]) -> float:
    """How surely (artist, title) and (artist2, title2) are one release; the two fields of the first may have changed places."""
    t = title_score(title, title2, light)
    if t >= ENOUGH and (a := artist_score(artist, artist2, light)) >= ENOUGH:
        return 0.5 * (min(a, t) + 0.5 * (a + t))
    t = title_score(artist, title2, light)
    if t >= ENOUGH and (a := artist_score(title, artist2, light)) >= ENOUGH:
        return 0.99 * 0.5 * (min(a, t) + 0.5 * (a + t))
    return 0.0


def joined(s: str | None) -> str:
    """The words of the bare title in one, as ``title_score`` compares them."""
    return "".join(title_parts(s)[0]) if s else ""


#: Letters of a title that fit one machine word; longer ones are left to the exact comparison.
_WORD_BITS, _LETTERS = 64, 128


def _numbers(s: str):
    import numpy as np

    return (np.frombuffer(s.encode("utf-32-le"), np.uint32) % _LETTERS).astype(np.uint8)


def may_match(left: list[str], right: list[str], x, y):
    """Which pairs ``left[x], right[y]`` of joined titles can reach ``ENOUGH`` in ``title_score``; never false for one that does.

    The bounds of ``title_score`` itself for a whole column: lengths, then the
    longest common subsequence, bit-parallel over all pairs at once.
    """
    import numpy as np

    n, m = (np.array([len(s) for s in side] or [0], np.int64) for side in (left, right))
    n, m = n[x], m[y]
    fits = 2 * np.minimum(n, m) >= ENOUGH * (n + m)
    # both empty, or too long for a word: left to the exact comparison
    out = (n == m) & (n == 0)
    out |= fits & (n > _WORD_BITS)
    at = np.flatnonzero(fits & (n > 0) & (n <= _WORD_BITS))
    if not len(at):
        return out
    # letters of one number count as equal, which only raises the bound
    wide = int(m[at].max())
    masks, codes = np.zeros((len(left), _LETTERS), np.uint64), np.zeros((len(right), wide), np.uint8)
    for i, s in enumerate(left):
        if 0 < len(s) <= _WORD_BITS:
            np.bitwise_or.at(masks[i], _numbers(s), np.uint64(1) << np.arange(len(s), dtype=np.uint64))
    for i, s in enumerate(right):
        codes[i, : min(len(s), wide)] = _numbers(s[:wide])
    at = at[np.argsort(-m[at], kind="stable")]
    a, b, steps = x[at], y[at], m[at]
    v = np.full(len(at), ~np.uint64(0))
    for k in range(int(steps[0])):
        live = int(np.searchsorted(-steps, -k, "left"))
        u = v[:live] & masks[a[:live], codes[b[:live], k]]
        v[:live] = (v[:live] + u) | (v[:live] - u)
    own = n[at].astype(np.uint64)
    full = np.where(own >= _WORD_BITS, ~np.uint64(0), (np.uint64(1) << np.minimum(own, np.uint64(_WORD_BITS - 1))) - np.uint64(1))
    common = n[at] - np.bitwise_count(v & full).astype(np.int64)
    out[at] = 2 * common / (n[at] + m[at]) + 0.06 >= ENOUGH - 1e-9
    return out
