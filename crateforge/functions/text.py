"""Scalar functions on text as column expressions; each has its DuckDB counterpart beside it (``sql_...``).

Everything stays in the JVM but for normal forms of Unicode, which Spark lacks:
these are functions on whole Arrow columns, with null in place of ASCII text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space in the Unicode sense, for engines whose \s is ASCII.
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WORD = r"[^\p{L}\p{N}\p{M}]"

# Words that make a bracket a note on the format, and numbers that go with them.
FORMAT_WORDS = ("flac", "mp3", "wav", "aac", "alac", "ogg", "opus", "m4a", "m4b", "web", "cd", "sacd", "vinyl", "lp", "lossless", "hd", "hires", "kbps", "kbit")
_NUM = r"\d{1,4}(?:bit|k|khz|hz|kbps|kbit)?"
_SEP = r"[\s,/&+_.\-]"
_ANY = rf"(?:{'|'.join(FORMAT_WORDS)}|{_NUM})"
FORMAT_BRACKET = rf"(?i)[\[(]{_SEP}*(?:{_NUM}{_SEP}+)*(?:{'|'.join(FORMAT_WORDS)})(?:{_SEP}+{_ANY})*{_SEP}*[\])]"
# What parts the credits of a name, the shape of an id.
CREDIT = rf"(?i){WS}+(?:&|feat\.?|featuring|vs\.?|presents){WS}+"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
# Words of a folder name that say nothing about the release.
STOPWORDS = ("the", "a", "an", "and", "of", "&", "flac", "mp3", "wav", "aac", "ogg", "opus", "alac", "ape", "wv", "web", "cd", "lp", "ep", "single", "vinyl", "remaster", "remastered", "lossless", "hires", "hi", "res", "kbps", "khz", "bit", "deluxe", "expanded", "edition", "limited", "anniversary", "music", "share", "shared", "albums", "discography")
# Signs between the words of a query or folder name.
TOKEN_SPLIT = r"[\s\-_\.\(\)\[\]\{\}/\\,&'\"]+"


def _each_once(s: pa.Array, f) -> pa.Array:
    """A function applied to the distinct values of a column."""
    coded = s.dictionary_encode()
    return pa.array([f(x) for x in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


@F.arrow_udf(StringType())
def _nfc(s: pa.Array) -> pa.Array:
    import unicodedata

    return _each_once(s, lambda x: unicodedata.normalize("NFC", x))


@F.arrow_udf(StringType())
def _unaccented(s: pa.Array) -> pa.Array:
    import unicodedata

    return _each_once(s, lambda x: "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch)))


def _beyond_ascii(c: Column, f) -> Column:
    plain = F.coalesce(c.rlike(r"^[\x00-\x7F]*$"), F.lit(True))
    return F.when(plain, c).otherwise(f(F.when(~plain, c)))


def nfc(c: Column) -> Column:
    """Canonical composition."""
    return _beyond_ascii(c, _nfc)


def unaccented(c: Column) -> Column:
    """Compatibility decomposition without combining marks."""
    return _beyond_ascii(c, _unaccented)


def folded(c: Column) -> Column:
    """Case folding: lower case with sharp s and ligatures spelled out."""
    out = F.lower(c)
    for a, b in (("ß", "ss"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ς", "σ")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def sql_folded(x: str) -> str:
    return f"replace(replace(replace(replace(lower({x}), 'ß', 'ss'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ς', 'σ')"


def squeeze_space(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"{WS}+", " "), "^ | $", "")


def sql_squeeze(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), '^ | $', '', 'g')"


def _prepass(c: Column) -> Column:
    return F.translate(nfc(F.coalesce(c, F.lit(""))), "–—―−‘’“”", "----''\"\"")


def _sql_prepass(x: str) -> str:
    return f"""translate(nfc_normalize(coalesce({x}, '')), '–—―−‘’“”', '----''''""')"""


#: Passes of the SQL text, which cannot repeat until nothing changes; the plan makes as many as a name has brackets.
NESTED = 6


def strip_format_brackets(c: Column) -> Column:
    """Drops brackets that hold only notes on the format, the inner ones first, until no such bracket is left."""
    return F.reduce(F.sequence(F.lit(1), F.greatest(F.lit(1), F.regexp_count(c, F.lit(r"[\[(]")))), c, lambda x, _: F.regexp_replace(x, FORMAT_BRACKET, ""))


def sql_strip_format_brackets(x: str) -> str:
    for _ in range(NESTED):
        x = f"regexp_replace({x}, '{FORMAT_BRACKET}', '', 'g')"
    return x


# Signs at the edges of a key, a year at its end, a catalogue code.
_EDGE = r"^[ \-_.]+|[ \-_.]+$"
_YEAR = rf"{WS}*[\[(](?:19|20)\d\d[\])]{WS}*$"
_CODE = r"(?i)(^|[^A-Za-z0-9_])APMU\d+($|[^A-Za-z0-9_])"


def normalize_album(c: Column) -> Column:
    """Title key: format notes, a trailing year and case are dropped; editions and volumes stay."""
    s = F.regexp_replace(_prepass(c), _CODE, "$1$2")
    s = strip_format_brackets(F.regexp_replace(s, r"\{[^}]*\}", ""))
    s = squeeze_space(F.regexp_replace(s, _YEAR, ""))
    return F.regexp_replace(folded(s), _EDGE, "")


def sql_normalize_album(x: str) -> str:
    s = f"regexp_replace(regexp_replace({_sql_prepass(x)}, '{_CODE}', '\\1\\2', 'g'), '\\{{[^}}]*\\}}', '', 'g')"
    s = sql_squeeze(f"regexp_replace({sql_strip_format_brackets(s)}, '{_YEAR}', '', 'g')")
    return f"regexp_replace({sql_folded(s)}, '{_EDGE}', '', 'g')"


def normalize_artist(c: Column) -> Column:
    """Artist key: the first credit only."""
    s = folded(squeeze_space(_prepass(c)))
    return F.regexp_replace(F.split(s, CREDIT, 2)[0], _EDGE, "")


def sql_normalize_artist(x: str) -> str:
    return f"regexp_replace(string_split_regex({sql_folded(sql_squeeze(_sql_prepass(x)))}, '{CREDIT}')[1], '{_EDGE}', '', 'g')"


# Notes in a track title that are no part of it.
_TRACK_NOISE = r"\(feat[^)]*\)|(^|[^a-z0-9_])feat\.?([^a-z0-9_].*)?$|\(live[^)]*\)|\([^)]*remaster[^)]*\)"


def normalize_track(c: Column) -> Column:
    """Track key: guests, live and remaster notes dropped, letters a to z and digits kept."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), _TRACK_NOISE, ""), "[^a-z0-9]+", "")


def sql_normalize_track(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '{_TRACK_NOISE}', '', 'g'), '[^a-z0-9]+', '', 'g')"


# Credits that name no artist.
_VA = r"^(?:various(?:\s*artists?)?|v\.?\s?a\.?|compilation)$"


def is_va(c: Column) -> Column:
    """Whether a credit names no artist but a compilation."""
    n = normalize_artist(c)
    return (n == "") | n.rlike(_VA)


def sql_is_va(x: str) -> str:
    n = sql_normalize_artist(x)
    return f"({n} = '' OR regexp_matches({n}, '{_VA}'))"


def valid_id(c: Column) -> Column:
    return F.coalesce(F.lower(squeeze_space(c)).rlike(UUID), F.lit(False))


def sql_valid_id(x: str) -> str:
    return f"coalesce(regexp_matches(lower({sql_squeeze(x)}), '{UUID}'), false)"


def content_hash(artist: Column, album: Column) -> Column:
    """Key of a release without id: a hash of the normalised credit and title."""
    who = F.when(is_va(artist), F.lit("\u0001VA")).otherwise(normalize_artist(artist))
    return F.concat(F.lit("ch:"), F.substring(F.sha2(F.concat(who, F.lit("\u001f"), normalize_album(album)), 256), 1, 16))


def sql_content_hash(artist: str, album: str) -> str:
    return f"'ch:' || substr(sha256((CASE WHEN {sql_is_va(artist)} THEN chr(1) || 'VA' ELSE {sql_normalize_artist(artist)} END) || chr(31) || {sql_normalize_album(album)}), 1, 16)"


def query_key(c: Column) -> Column:
    """Key of a cached query: lower case, white space collapsed."""
    return squeeze_space(F.lower(c))


def sql_query_key(x: str) -> str:
    return sql_squeeze(f"lower({x})")


def wish_key(c: Column) -> Column:
    """Lower case without accents, signs as one space."""
    return F.trim(F.regexp_replace(F.lower(unaccented(F.coalesce(c, F.lit("")))), NOT_WORD + "+", " "))


def search_tokens(c: Column) -> Column:
    """Distinct words of a query or a folder name that can help to match."""
    words = F.split(F.lower(c), TOKEN_SPLIT)
    return F.array_distinct(F.filter(words, lambda t: (t != "") & ~t.isin(*STOPWORDS) & ~t.rlike(r"^\d+$")))


def sql_search_tokens(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    pattern = TOKEN_SPLIT.replace("'", "''")
    return f"list_distinct(list_filter(string_split_regex(lower({x}), '{pattern}'), lambda t: t <> '' AND t NOT IN ({stop}) AND NOT regexp_full_match(t, '[0-9]+')))"


def base_name(c: Column) -> Column:
    """Last component of a path with either slash."""
    return F.regexp_extract(F.regexp_replace(c, r"[/\\]+$", ""), r"([^/\\]*)$", 1)


def sql_base_name(x: str) -> str:
    return f"regexp_extract(regexp_replace({x}, '[/\\\\]+$', ''), '([^/\\\\]*)$', 1)"


def parent_name(c: Column) -> Column:
    """Path without its last component."""
    return F.regexp_replace(F.regexp_replace(c, r"[/\\]+$", ""), r"[/\\]*[^/\\]*$", "")


def sql_parent_name(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '[/\\\\]+$', ''), '[/\\\\]*[^/\\\\]*$', '')"


def extension(c: Column) -> Column:
    """Lower-case extension without dot; none for a dot file."""
    return F.lower(F.regexp_extract(c, r"[^/\\.][^/\\]*\.([^./\\]+)$", 1))


def sql_extension(x: str) -> str:
    return f"lower(regexp_extract({x}, '[^/\\\\.][^/\\\\]*\\.([^./\\\\]+)$', 1))"
