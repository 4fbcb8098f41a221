"""p9: statistics of each document, and which documents are not prose.

Method: gradient-boosted trees on the statistics of the documents, trained with
weak labels (rules that are sure of prose or of structural junk and silent on
the rest), their probabilities calibrated on a hand-checked holdout.

Statistics and scores are computed for every whole text; the trees are fitted on
at most ``TRAIN_ROWS`` documents chosen by hash, whatever the size of the corpus.
Defined results: null, empty and blank texts have statistics of zero and are no
cases; repeated rows get equal answers.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS = 6000
#: The table of common words is a fixed, small one; more rows than this are refused.
MOST_COMMON_WORDS = 5000

NAMES = (
    "n_words", "mean_word_len", "symbol_ratio", "digit_ratio", "upper_ratio", "stop_share", "stop_adjacent", "line_words", "line_chars_cv", "end_punct",
    "bullet_lines", "field_lines", "short_lines", "poor_lines", "repeat_lines", "shape_mode", "separators", "zip_ratio", "distinct_words", "top_word",
    "long_words", "sentence_words", "prose_share", "odd_lines", "gram_repeat", "lead_mode", "dash_lines",
)

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_LINES = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_QUOTE = re.compile(r"^\s*(?:>+\s?|[QA]:\s)+")
_BULLET = re.compile(r"^\s*(?:[-*•·◦▪►+–—#|]\s*|\[.?\]\s*|\(?\d{1,3}[.):]\s*|\d{1,4}\s+(?=\S)|[A-F]\d{1,2}\b[.:]?\s*|\w{1,2}[.)]\s+)")
_KEY = re.compile(r"^\s*[\"']?[\w .\-/]{1,40}[\"']?\s*(?::\s|:$)")
_FIELD = re.compile(r"^\s*[\"']?[\w .\-/]{1,40}[\"']?\s*(?:=|\t)|::|\t|\|.*\||^\s*[{}\[\]<]|[{}<>]|^\s*\d{4}-\d\d-\d\d|(?:[^,;\s]*[,;]){3,}[^,;\s]*$")
_TIME = re.compile(r"\b\d{1,2}:\d\d\b")
_DASH = re.compile(r"\s[-–—/~]\s|\\|\w/\w+/")
_LETTER, _DIGIT, _UPPER, _SYMBOL = re.compile(r"[^\W\d_]"), re.compile(r"\d"), re.compile(r"[A-ZÀ-ÖØ-ÞА-ЯЁ]"), re.compile(r"[^\w\s]|_")
_ROUGH = re.compile(r"[^\w\s.,;:!?'’\"“”«»()\-–—…¿¡]|[\d_]")
_STOPS, _CLOSING = frozenset(".!?…"), "\"'’”»)]"
_SENT = re.compile(r"[.!?…]+[\"'’”»)\]]*\s+|\n\s*\n")
_SHAPE = ((re.compile(r"\d+"), "0"), (re.compile(r"[^\W\d_]+(?:[ '’][^\W\d_]+)*"), "a"))


def _ended(line: str) -> bool:
    """Whether a line ends a sentence, closing signs after the stop aside."""
    return line.rstrip().rstrip(_CLOSING)[-1:] in _STOPS


@lru_cache(100_000)
def _kind(ch: str) -> tuple[bool, bool, bool, bool]:
    """Whether a character is a letter, a digit, a capital, a sign."""
    return bool(_LETTER.match(ch)), bool(_DIGIT.match(ch)), bool(_UPPER.match(ch)), bool(_SYMBOL.match(ch))


def statistics(text: str | None, common: frozenset[str]) -> list[float]:
    """The statistics of one text in the order of ``NAMES``."""
    if text is None or not text.strip():
        return [0.0] * len(NAMES)
    lines = [_QUOTE.sub("", x) for x in _LINES.split(text)]
    full = [x for x in lines if x.strip()]
    n = len(text)
    low = list(map(str.lower, _WORD.findall(text)))
    nw = max(1, len(low))
    stop = list(map(common.__contains__, low))
    counts = Counter(low)
    solid = max(1, sum(map(len, text.split())))
    letters = digits = upper = symbols = 0
    single = Counter(text)
    for ch, k in single.items():
        kind = _kind(ch)
        letters += k * kind[0]
        digits += k * kind[1]
        upper += k * kind[2]
        symbols += k * kind[3]
    seen = Counter(x.strip().lower() for x in full)
    shapes: Counter[str] = Counter()
    leads: Counter[str] = Counter()
    chars = bullet = field = short = poor = repeat = odd = prose = dashed = 0
    lens = []
    for x in full:
        s = x.strip()
        k = len(s)
        chars += k
        lens.append(k)
        words = _WORD.findall(s)
        hits = sum(map(common.__contains__, map(str.lower, words)))
        shape = s
        for pat, to in _SHAPE:
            shape = pat.sub(to, shape)
        shapes[shape[:12]] += k
        leads[s[: max(1, min(8, k // 3))].lower()] += k
        again = seen[s.lower()] > 1 and len(full) > 2
        fluent = len(words) > 9 and hits >= 0.3 * len(words) and not again and s.count("|") < 2 and "::" not in s and "\t" not in s and s.count("<") < 3
        b, t = bool(_BULLET.match(s)), bool(_TIME.search(s))
        f = not fluent and (bool(_FIELD.search(s)) or len(words) < 9 and bool(_KEY.match(s)))
        brief = len(words) < 5 and not (_ended(s) and hits)
        few = hits < 0.14 * len(words) or not words
        rough = len(_ROUGH.findall(s)) > 0.2 * k
        dash = len(words) < 16 and hits < 0.3 * len(words) and bool(_DASH.search(s))
        bullet += k * b
        field += k * (f or t)
        short += k * brief
        poor += k * few
        repeat += k * again
        odd += k * rough
        dashed += k * dash
        if not (b and len(words) < 12 or f and not (_ended(s) and hits >= 4) or t or brief or few or again or rough or dash):
            prose += k
    sentences = [c for c in (len(_WORD.findall(x)) for x in _SENT.split("\n".join(lines))) if c]
    grams = Counter(zip(low, low[1:], low[2:], strict=False))
    ng = max(1, sum(grams.values()))
    mean = sum(lens) / max(1, len(lens))
    data = text.encode("utf-8", "replace")
    return [
        math.log1p(len(low)), sum(map(len, low)) / nw, symbols / solid, digits / solid,
        upper / max(1, letters), sum(stop) / nw, sum(a != b for a, b in zip(stop, stop[1:], strict=False)) / nw,
        nw / max(1, len(full)), math.sqrt(sum((x - mean) ** 2 for x in lens) / max(1, len(lens))) / max(1.0, mean), sum(_ended(x) for x in full) / max(1, len(full)),
        bullet / chars, field / chars, short / chars, poor / chars, repeat / chars, max(shapes.values()) / chars, sum(single[c] for c in "|\t;={}<>_/\\") / n,
        min(1.5, len(zlib.compress(data, 6)) / len(data)), len(counts) / nw, max(counts.values(), default=0) / nw,
        sum(len(w) > 18 for w in low) / nw, min(60.0, sum(sentences) / max(1, len(sentences))), prose / chars, odd / chars, sum(v - 1 for v in grams.values()) / ng, max(leads.values()) / chars, dashed / chars,
    ]


def common_set(common_words: DataFrame) -> frozenset[str]:
    """The frequent words of all languages; a table of fixed size."""
    rows = common_words.select(F.lower("word").alias("w")).where("w is not null").distinct().limit(MOST_COMMON_WORDS + 1).collect()
    if len(rows) > MOST_COMMON_WORDS:
        raise ValueError("the table of common words is not the small one this operator is made for")
    return frozenset(r.w for r in rows)


SCHEMA = "doc_id bigint, blank boolean, " + ", ".join(f"{n} double" for n in NAMES)


def document_statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id, blank and the statistics of every document."""
    common = common_set(common_words)

    def measure(batches):
        import pyarrow as pa

        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            rows = [statistics(t, common) for t in texts]
            cols = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(NAMES))]
            yield pa.RecordBatch.from_arrays([ids, pa.array([t is None or not t.strip() for t in texts], pa.bool_()), *cols], ["doc_id", "blank", *NAMES])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(measure, SCHEMA)


def weak_label(v: dict[str, float]) -> int | None:
    """1 where a rule is sure of junk, 0 where one is sure of prose, None where none is."""
    if v["n_words"] <= 0 or v["stop_share"] < 0.08 or v["odd_lines"] > 0.7 or v["poor_lines"] > 0.8 or v["repeat_lines"] > 0.7 or v["prose_share"] < 0.2 or v["dash_lines"] > 0.7 or v["gram_repeat"] > 0.85 and v["n_words"] > 3.2:
        return 1
    if v["prose_share"] > 0.7 and v["stop_share"] > 0.22 and v["gram_repeat"] < 0.75:
        return 0
    if v["prose_share"] > 0.9 and v["stop_share"] > 0.12 and v["end_punct"] > 0.6 and v["line_words"] > 12 and v["gram_repeat"] < 0.3:
        return 0
    if v["field_lines"] + v["bullet_lines"] > 1.2:
        return 1
    return None


class Trees:
    """Gradient-boosted regression trees on binned features for the logistic loss."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 4.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.a, self.b = 1.0, 0.0

    def fit(self, x, y):
        import numpy as np

        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], 1)
        p0 = min(0.999, max(0.001, float(y.mean()) if len(y) else 0.5))
        self.base = math.log(p0 / (1 - p0))
        score = np.full(len(y), self.base)
        self.trees = []
        for _ in range(self.rounds if len(y) else 0):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            tree: list = []
            score += self.rate * self._grow(binned, g, h, np.arange(len(y)), self.depth, tree, np.zeros(len(y)))
            self.trees.append(tree)
        return self

    def _grow(self, binned, g, h, rows, depth, tree, out):
        """Appends nodes (feature, bin, left, right) or (value,) to ``tree``; fills ``out`` with leaf values."""
        import numpy as np

        at = len(tree)
        tree.append(None)
        best = (1e-6, None, None)
        gs, hs = g[rows].sum(), h[rows].sum()
        if depth:
            for j in range(binned.shape[1]):
                col = binned[rows, j]
                size = len(self.cuts[j]) + 1
                gl, hl = np.cumsum(np.bincount(col, g[rows], size))[:-1], np.cumsum(np.bincount(col, h[rows], size))[:-1]
                if not len(gl):
                    continue
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(hl < self.least / 4) | (hs - hl < self.least / 4)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
        if best[1] is None:
            value = float(gs / (hs + 1))
            tree[at] = (value,)
            out[rows] = value
            return out
        _, j, k = best
        left = binned[rows, j] <= k
        a = len(tree)
        self._grow(binned, g, h, rows[left], depth - 1, tree, out)
        b = len(tree)
        self._grow(binned, g, h, rows[~left], depth - 1, tree, out)
        tree[at] = (j, float(self.cuts[j][k]), a, b)
        return out

    def raw(self, x):
        import numpy as np

        total = np.full(len(x), self.base)
        for tree in self.trees:
            where = np.zeros(len(x), int)
            value = np.zeros(len(x))
            for at, node in enumerate(tree):
                here = where == at
                if len(node) == 1:
                    value[here] = node[0]
                else:
                    j, cut, a, b = node
                    where[here] = np.where(x[here, j] < cut, a, b)
            total += self.rate * value
        return total

    def calibrate(self, x, y, steps: int = 300):
        """Platt scaling on the holdout: p = s(a * raw + b), with a weak pull to the uncalibrated trees."""
        import numpy as np

        r = self.raw(x)
        a, b = 1.0, 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(a * r + b)))
            e = p - y
            a -= 0.02 * (float((e * r).mean()) + 0.02 * (a - 1))
            b -= 0.05 * (float(e.mean()) + 0.01 * b)
        self.a, self.b = max(0.1, a), b
        return self

    def probability(self, x):
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(self.a * self.raw(x) + self.b, -50, 50)))


def fitted(stats: DataFrame, common: frozenset[str]) -> Trees:
    """Trees fitted on the weak labels of a bounded sample and calibrated on the hand-checked holdout.

    A few written texts of both kinds train at every size, so that no corpus is
    without one. The holdout never trains: documents of the sample that are in it
    are left out.
    """
    import numpy as np

    from crateforge.llm.prose_holdout import HOLDOUT, TEST, WRITTEN

    held = [(statistics(t, common), lab) for t, lab in HOLDOUT]
    aside = {tuple(v) for v, _ in held} | {tuple(statistics(t, common)) for t, _ in TEST}
    x, y = [statistics(t, common) for t, _ in WRITTEN], [lab for _, lab in WRITTEN]
    for r in stats.where(~F.col("blank")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS).select(*NAMES).collect():
        label = weak_label(r.asDict())
        if label is not None and tuple(r) not in aside:
            x.append(list(r))
            y.append(label)
    trees = Trees().fit(np.array(x), np.array(y, float))
    return trees.calibrate(np.array([v for v, _ in held]), np.array([lab for _, lab in held], float))


def calibration_error(p, y, parts: int = 10) -> float:
    """Mean distance of probability and share of junk over parts of equal width, weighed by their documents."""
    import numpy as np

    p, y = np.asarray(p), np.asarray(y, float)
    part = np.minimum((p * parts).astype(int), parts - 1)
    return float(sum(abs((p[part == k] - y[part == k]).sum()) for k in range(parts)) / max(1, len(p)))


def judged(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id, probability of junk and is_prose of every document; blank ones have null for both."""
    from crateforge.functions.session import written

    stats = written(document_statistics(documents, common_words), "stats")
    trees = fitted(stats, common_set(common_words))

    def score(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            x = np.stack([b.column(i + 2).to_numpy(zero_copy_only=False) for i in range(len(NAMES))], 1)
            p = trees.probability(x) if len(x) else np.zeros(0)
            blank = b.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if k else float(v) for k, v in zip(blank, p, strict=True)], pa.float64()), pa.array([None if k else bool(v < 0.5) for k, v in zip(blank, p, strict=True)], pa.bool_())], ["doc_id", "p_junk", "is_prose"])

    return stats.mapInArrow(score, "doc_id bigint, p_junk double, is_prose boolean")
