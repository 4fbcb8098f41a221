"""p6: one consistent form for text that only looks the same.

Method: script-aware repair. The dominant script of each token is determined;
letters of another script are replaced by their doubles only in tokens that mix
scripts (or that stand alone among tokens of the other script), and only when
the resulting word exists in the vocabulary of the corpus.

Defined results: null stays null and is consistent; empty text is consistent;
texts of any length are treated whole; repeated rows give repeated answers.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of Cyrillic, Greek and Armenian that are drawn like a Latin letter.
DOUBLES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Һ": "h",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v", "ү": "y", "г": "r", "к": "k", "т": "t", "в": "b", "н": "h", "м": "m", "п": "n",
    "Ё": "Ë", "ё": "ë", "Ї": "Ï", "ї": "ï", "Ӓ": "Ä", "ӓ": "ä", "Ӧ": "Ö", "ӧ": "ö",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "α": "a", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c", "ϳ": "j", "β": "ß", "ό": "ó", "ά": "á", "έ": "é", "ί": "í",
    "Օ": "O", "Տ": "S", "Ս": "U", "Լ": "L", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "յ": "j", "ք": "p",
}
# Compatibility characters that are letters or signs in their own right.
KEPT_TAGS = ("<super>", "<sub>", "<fraction>")
KEPT_CHARS = frozenset("…‥·´¨¯¸™℠℗№℃℉‼⁇⁈⁉")
# Hyphens drawn like the plain one; dashes and quotation marks are typography and stay.
HYPHENS = frozenset("\u2010\u2011")
LINE_CHARS = frozenset("\t\n\r\x0b\x0c")
JOINERS = frozenset("\u200c\u200d")

_LATIN = {"Cyrillic": {}, "Greek": {}, "Armenian": {}}


def script_of(ch: str) -> str:
    """Script of a letter as far as look-alikes need it: Latin, Cyrillic, Greek, Armenian or other."""
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o < 0x1F00 or 0x2C60 <= o < 0x2C80 or 0xA720 <= o < 0xA800 or 0x250 <= o < 0x2B0:
        return "Latin"
    if 0x400 <= o < 0x530 or 0x1C80 <= o < 0x1C90 or 0x2DE0 <= o < 0x2E00 or 0xA640 <= o < 0xA6A0:
        return "Cyrillic"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "Greek"
    if 0x530 <= o < 0x590:
        return "Armenian"
    return "other"


for _k, _v in DOUBLES.items():
    _LATIN[script_of(_k)].setdefault(_v, _k)


def _double(ch: str, target: str) -> str | None:
    """The letter of ``target`` script drawn like ``ch``."""
    own = script_of(ch)
    if own == target:
        return ch
    latin = ch if own == "Latin" else DOUBLES.get(ch)
    if latin is None or target == "Latin":
        return latin
    return _LATIN.get(target, {}).get(latin)


def _plain_char(ch: str) -> str:
    """The consistent form of one character, all but scripts and composition."""
    o = ord(ch)
    if 0x20 <= o < 0x7F or ch in LINE_CHARS or ch in KEPT_CHARS:
        return ch
    if ch in HYPHENS:
        return "-"
    cat = unicodedata.category(ch)
    if cat == "Zs":
        return " "
    if cat in ("Zl", "Zp"):
        return "\n"
    if cat in ("Cf", "Cc") or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D):
        return ""
    d = unicodedata.decomposition(ch)
    if d and not d.startswith(KEPT_TAGS):
        n = unicodedata.normalize("NFKC", ch)
        if d.startswith("<") or len(n) == 1 or cat[0] == "L":
            return n
    return ch


def _joins(s: str, i: int) -> bool:
    """A joiner is part of the writing of Arabic, Indic scripts and emoji, and invisible dirt elsewhere."""
    return any(0x600 <= ord(c) < 0xE00 or 0x1F000 <= ord(c) or 0x2600 <= ord(c) < 0x2800 for c in (s[max(0, i - 1) : i] + s[i + 1 : i + 2]))


def plain(s: str) -> str:
    """Forms, spaces, accents and invisible characters brought to one form; scripts are left alone."""
    if s.isascii() and not any(ord(c) < 32 and c not in LINE_CHARS or ord(c) == 127 for c in s):
        return s
    out = []
    for i, ch in enumerate(s):
        out.append(ch if ch in JOINERS and _joins(s, i) else _plain_char(ch))
    return unicodedata.normalize("NFC", "".join(out))


_TOKEN = re.compile(r"[^\W\d_]+(?:[\u0300-\u036f]+[^\W\d_]*)*")


def proposals(s: str) -> list[tuple[int, str, str]]:
    """(position, token, proposed token) for tokens with letters of another script's look; ``s`` is in plain form."""
    if s.isascii():
        return []
    tokens = []
    for m in _TOKEN.finditer(s):
        counts: dict[str, int] = {}
        firm: dict[str, int] = {}
        for ch in m[0]:
            k = script_of(ch)
            if k != "other":
                counts[k] = counts.get(k, 0) + 1
                if not (DOUBLES.get(ch) if k != "Latin" else any(ch in x for x in _LATIN.values())):
                    firm[k] = firm.get(k, 0) + 1
        tokens.append((m.start(), m[0], counts, firm))
    out = []
    for n, (at, tok, counts, firm) in enumerate(tokens):
        if not counts:
            continue
        if len(counts) > 1:
            order = sorted(counts, key=lambda k: (-firm.get(k, 0), -counts[k], k != "Latin"))
        else:
            own = next(iter(counts))
            if own == "Latin" or firm.get(own):
                continue
            others = [c for j, (_, _, c, _) in enumerate(tokens) if j != n for c in c]
            if own in others or "Latin" not in others:
                continue
            order = ["Latin"]
        for target in order:
            new = [_double(ch, target) if script_of(ch) != "other" else ch for ch in tok]
            if None not in new and "".join(new) != tok:
                out.append((at, tok, "".join(new)))
                break
    return out


def repaired(s: str, accepted: dict[str, str]) -> str:
    """Plain text with the accepted token substitutions applied."""
    for at, tok, new in reversed(proposals(s)):
        if accepted.get(tok) == new:
            s = s[:at] + new + s[at + len(tok) :]
    return s


def loosely(s: str) -> str:
    """Consistent form with every proposed substitution taken; for comparing, not for keeping."""
    s = plain(s)
    for at, tok, new in reversed(proposals(s)):
        s = s[:at] + new + s[at + len(tok) :]
    return s


def words(text: Column) -> Column:
    """Distinct lower-case words of a text, in the JVM."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}]+)"), F.lit(1)))


def _scan(batches):
    import pyarrow as pa

    for b in batches:
        t = pa.Table.from_batches([b])
        forms, props = [], []
        for s in t.column("text").to_pylist():
            p = plain(s)
            forms.append(p)
            props.append([{"token": a, "proposal": n} for _, a, n in proposals(p)])
        yield from t.append_column("form", pa.array(forms, pa.string())).append_column("props", pa.array(props, pa.list_(pa.struct([("token", pa.string()), ("proposal", pa.string())])))).to_batches()


def _apply(batches):
    import pyarrow as pa

    for b in batches:
        t = pa.Table.from_batches([b])
        out = []
        for form, acc in zip(t.column("form").to_pylist(), t.column("accepted").to_pylist(), strict=True):
            out.append(repaired(form, {x["token"]: x["proposal"] for x in acc}) if acc else form)
        yield from t.select(["tbl", "row_key", "field", "text"]).append_column("form", pa.array(out, pa.string())).to_batches()


ODD = r"[^\x20-\x7E\t\n\r\x0B\x0C]"


def consistent(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Every text in one consistent form.

    ``texts``: tbl, row_key, field, text. ``vocabulary``: text column ``text`` of
    the corpus whose words may result from a substitution. Returns tbl, row_key,
    field, text, form and changed. Null text gives null form and changed false.

    Texts of printable ASCII never leave the JVM. Proposals are joined with the
    vocabulary by word, so neither is held in one place; only the distinct
    proposed words that exist there travel back.
    """
    texts = texts.select("tbl", "row_key", "field", F.col("text").cast("string").alias("text"))
    odd = texts.where(F.col("text").rlike(ODD))
    easy = texts.where(F.col("text").isNull() | ~F.col("text").rlike(ODD))
    scanned = odd.mapInArrow(_scan, "tbl string, row_key string, field string, text string, form string, props array<struct<token string, proposal string>>")
    asked = scanned.where(F.size("props") > 0).select(F.explode("props").alias("p")).select("p.token", "p.proposal").distinct()
    vocab = vocabulary.select(F.explode(words(F.col("text"))).alias("word")).distinct()
    known = asked.join(vocab, F.lower(F.col("proposal")) == F.col("word"), "left_semi")
    mixed = scanned.where(F.size("props") > 0)
    found = mixed.select("tbl", "row_key", "field", F.explode("props").alias("p")).select("tbl", "row_key", "field", "p.token", "p.proposal").join(known, ["token", "proposal"]).groupBy("tbl", "row_key", "field").agg(F.collect_set(F.struct("token", "proposal")).alias("accepted"))
    applied = mixed.drop("props").join(found, ["tbl", "row_key", "field"], "left").mapInArrow(_apply, "tbl string, row_key string, field string, text string, form string")
    rest = scanned.where(F.size("props") == 0).select("tbl", "row_key", "field", "text", "form")
    out = easy.withColumn("form", F.col("text")).unionByName(rest).unionByName(applied)
    return out.withColumn("changed", F.coalesce(F.col("text") != F.col("form"), F.lit(False)))
