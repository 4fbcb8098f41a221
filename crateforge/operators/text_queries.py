"""Queries of the scalar functions over the names, titles and folders of the library."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from crateforge.functions import text as T
from crateforge.functions.session import table

QUERIES, SQL = {}, {}


def add(name, spark_fn, sql):
    QUERIES[name] = spark_fn
    if sql:
        SQL[name] = sql


def _over(tbl, keys, **cols):
    """A query of expressions over one table, as Spark callable; ``cols`` are functions of no argument that give a column."""
    return lambda spark, d: table(spark, d, tbl).select(*[F.col(k) for k in keys], *[f().alias(n) for n, f in cols.items()])


def _sql(tbl, keys, **cols):
    return f"SELECT {', '.join([*keys, *[f'{x} AS {n}' for n, x in cols.items()]])} FROM {tbl}"


def pair(name, tbl, keys, spark_cols, sql_cols):
    add(name, _over(tbl, keys, **spark_cols), _sql(tbl, keys, **sql_cols))


c = F.col
pair("mb_key", "mb_canonical_cache", ["queried_at"], {"k": lambda: T.query_key(c("canonical_artist"))}, {"k": T.sql_query_key("canonical_artist")})
pair("normalize_album", "albums", ["id"], {"k": lambda: T.normalize_album(c("album"))}, {"k": T.sql_normalize_album("album")})
pair("normalize_artist", "albums", ["id"], {"k": lambda: T.normalize_artist(c("albumartist"))}, {"k": T.sql_normalize_artist("albumartist")})
pair("strip_format_brackets", "held_folders", ["folder_name"], {"bare": lambda: T.strip_format_brackets(c("folder_name"))}, {"bare": T.sql_strip_format_brackets("folder_name")})
pair("normalize_track", "items", ["id"], {"k": lambda: T.normalize_track(c("title"))}, {"k": T.sql_normalize_track("title")})
pair("is_va", "albums", ["id"], {"va": lambda: T.is_va(c("albumartist"))}, {"va": T.sql_is_va("albumartist")})
pair("valid_mbid", "albums", ["id"], {"ok": lambda: T.valid_id(c("mb_albumid"))}, {"ok": T.sql_valid_id("mb_albumid")})
pair("content_hash", "albums", ["id"], {"k": lambda: T.content_hash(c("albumartist"), c("album"))}, {"k": T.sql_content_hash("albumartist", "album")})
#: Characters of other forms and what they stand for: single ones by the rule of the normal form, of the longer ones those that names hold.
_FORMS = [chr(k) for block in ((0xA0, 0x2100), (0xFF01, 0xFFE0), (0x1D400, 0x1D800)) for k in range(*block)]
_COMPAT = {ch: k for ch in _FORMS if (k := unicodedata.normalize("NFKD", ch)) != unicodedata.normalize("NFD", ch) and len(k) == 1} | {ch: unicodedata.normalize("NFKD", ch) for ch in "½¼¾ﬁﬂ…№™"}


def sql_wish_key(x: str) -> str:
    """The key in SQL; compatibility characters of names are spelled out, as the engine has no such normal form."""
    one = "".join(k for k, v in _COMPAT.items() if len(v) == 1)
    y = f"translate(nfc_normalize(coalesce({x}, '')), '{one.replace(chr(39), chr(39) * 2)}', '{''.join(_COMPAT[k] for k in one).replace(chr(39), chr(39) * 2)}')"
    for k, v in _COMPAT.items():
        if len(v) > 1:
            y = f"replace({y}, '{k}', '{v}')"
    return f"trim(regexp_replace(lower(strip_accents({y})), '{T.NOT_WORD}+', ' ', 'g'), ' ')"


pair("wish_normalize", "mb_canonical_cache", ["canonical_mbid"], {"k": lambda: T.wish_key(c("canonical_title"))}, {"k": sql_wish_key("canonical_title")})
pair("search_tokens", "albums", ["id"], {"n": lambda: F.size(T.search_tokens(c("album"))), "words": lambda: F.concat_ws(" ", F.sort_array(T.search_tokens(c("album"))))}, {"n": f"CAST(coalesce(len({T.sql_search_tokens('album')}), -1) AS INT)", "words": f"coalesce(array_to_string(list_sort({T.sql_search_tokens('album')}), ' '), '')"})
pair("path_parts", "folder_results", ["folder_id"], {"name": lambda: T.base_name(c("directory")), "up": lambda: T.parent_name(c("directory")), "ext": lambda: F.array_join(F.sort_array(F.array_distinct(F.transform("files", lambda f: T.extension(f["filename"])))), ",")}, {"name": T.sql_base_name("directory"), "up": T.sql_parent_name("directory"), "ext": f"array_to_string(list_sort(list_distinct(list_transform(files, lambda f: {T.sql_extension('f.filename')}))), ',')"})

_CUT = r" [^ ]*$"
_long = lambda q: F.when(F.length(q) > 60, F.regexp_replace(F.substring(q, 1, 60), _CUT, "")).otherwise(q)
pair("build_query", "slskd_ledger", ["id"], {"q": lambda: _long(F.trim(F.concat_ws(" ", c("artist"), c("album"))))}, {"q": f"CASE WHEN length(trim(concat_ws(' ', artist, album))) > 60 THEN regexp_replace(substr(trim(concat_ws(' ', artist, album)), 1, 60), '{_CUT}', '') ELSE trim(concat_ws(' ', artist, album)) END"})


def _wildcard():
    words = F.split(F.trim(c("artist")), r"\s+")
    best = F.array_max(F.transform(words, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("p"), w.alias("w"))))
    starred = F.concat(F.lit("*"), F.substr(best["w"], F.lit(2)))
    swapped = F.array_join(F.transform(words, lambda w, i: F.when((i == -best["p"]) & (best["n"] >= 4), starred).otherwise(w)), " ")
    return F.concat_ws(" ", swapped, c("album"))


_W = r"string_split_regex(trim(artist), '\s+')"
_BEST = f"list_sort(list_transform(range(1, len({_W}) + 1), lambda i: struct_pack(n := -length({_W}[i]), i := i)))[1]"
pair("wildcard_query", "slskd_ledger", ["id"], {"q": _wildcard}, {"q": f"concat_ws(' ', array_to_string(list_transform(range(1, len({_W}) + 1), lambda k: CASE WHEN k = ({_BEST}).i AND ({_BEST}).n <= -4 THEN '*' || substr({_W}[k], 2) ELSE {_W}[k] END), ' '), album)"})
_Q = r"[\x27,&\"()\[\]{}/\\]+"
pair("sanitize_query", "albums", ["id"], {"q": lambda: T.squeeze_space(F.regexp_replace("album", _Q, " "))}, {"q": T.sql_squeeze(f"regexp_replace(album, '{_Q}', ' ', 'g')")})

# Words that make the end of a folder name, or a bracket in it, a note on the copy.
HEAD_WORDS = ("WEB", "FLAC", "MP3", "320", "Lossless", "Hi[- ]?Res", "24[- ]?bit", "CD", "SACD", "Vinyl", "Remaster(?:ed)?", "Expanded", "Bonus", "Limited", "Deluxe")
_HEAD = rf"(?i)\s*[\[(](?:{'|'.join(HEAD_WORDS)})[^\])]*[\])]$"
_HEAD2 = rf"(?i)\s*[-–]\s*(?:{'|'.join(HEAD_WORDS)})\S*$"


def _header(folder):
    clean = F.trim(F.regexp_replace(F.trim(F.regexp_replace(folder, _HEAD2, "")), _HEAD, ""))
    at = F.instr(clean, " - ")
    left = F.trim(F.substr(clean, F.lit(1), at - 1))
    ok = (at > 0) & ~left.rlike(r"^\d{4}$")
    return F.when(ok, left).otherwise(F.lit("")), F.when(ok, F.trim(F.substr(clean, at + 3))).otherwise(clean)


_CLEAN = f"trim(regexp_replace(trim(regexp_replace(folder_name, '{_HEAD2}', '', 'g')), '{_HEAD}', '', 'g'))"
_OK = f"(strpos({_CLEAN}, ' - ') > 0 AND NOT regexp_full_match(trim(substr({_CLEAN}, 1, strpos({_CLEAN}, ' - ') - 1)), '[0-9]{{4}}'))"
pair("split_header", "held_folders", ["folder_name"], {"artist": lambda: _header(c("folder_name"))[0], "album": lambda: _header(c("folder_name"))[1]}, {"artist": f"CASE WHEN {_OK} THEN trim(substr({_CLEAN}, 1, strpos({_CLEAN}, ' - ') - 1)) ELSE '' END", "album": f"CASE WHEN {_OK} THEN trim(substr({_CLEAN}, strpos({_CLEAN}, ' - ') + 3)) ELSE {_CLEAN} END"})

# Words of a bracket that is no part of a query, and those of names that were asked for again.
NOISE_WORDS = ("FLAC", "MP3", "WAV", "WEB", "CD", "Hi[- ]?Res", "24[- ]?bit", r"\d{2,3}kHz", "Lossless", "Remaster(?:ed)?", "Deluxe", "Expanded", "Limited")
REQUEUED_WORDS = (*NOISE_WORDS, r"APMU\d+", r"\d{4}-\d{2}", "WEB-FLAC")
_NOISE = rf"(?i)\s*[\[(](?:{'|'.join(NOISE_WORDS)})[^\])]*[\])]"
_NOISE_Q = rf"(?i)\s*[\[(](?:{'|'.join(REQUEUED_WORDS)})[^\])]*[\])]"
_STEPS = {"fill": [_NOISE, r"^\d{4}[-\s,]+", r"\s*\{[^}]*\}"], "requeue": [r"\.requeued-\d{8}-\d{4,6}", _NOISE_Q, r"\s*[\[(]\d{4}[\])]", r"^\d{4}[-\s,]+", r"\s*\{[^}]*\}"]}


def clean_folder(col, kind):
    """Folder name without notes on format and year; two variants that differ on purpose."""
    for p in _STEPS[kind]:
        col = F.regexp_replace(col, p, "")
    return F.regexp_replace(T.squeeze_space(col), T._EDGE, "")


def sql_clean_folder(x, kind):
    for p in _STEPS[kind]:
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    return f"regexp_replace({T.sql_squeeze(x)}, '{T._EDGE}', '', 'g')"


pair("clean_folder", "fill_attempts", ["folder_name"], {"fill": lambda: clean_folder(c("folder_name"), "fill"), "requeue": lambda: clean_folder(c("folder_name"), "requeue")}, {"fill": sql_clean_folder("folder_name", "fill"), "requeue": sql_clean_folder("folder_name", "requeue")})

# What stands before a dash and is no artist.
_PSEUDO = r"(?i)^(?:\d{4}|\d{1,2}[-–]\d{1,2}|(?:disc|disk|cd|vol(?:ume)?)\s*\.?\s*\d+)$"


def _parse_folder():
    n = clean_folder(c("folder_name"), "requeue")
    at = F.instr(n, " - ")
    left = F.trim(F.substr(n, F.lit(1), at - 1))
    ok = (at > 0) & ~left.rlike(_PSEUDO)
    return F.when(ok, left).otherwise(F.lit("")), F.when(ok, F.trim(F.regexp_replace(F.trim(F.substr(n, at + 3)), r"^\d{4}[-\s,]+", ""))).otherwise(n)


_N = sql_clean_folder("folder_name", "requeue")
add(
    "parse_folder",
    _over("held_folders", ["folder_name"], artist=lambda: _parse_folder()[0], album=lambda: _parse_folder()[1]),
    f"""WITH x AS (SELECT folder_name, {_N} AS n FROM held_folders), y AS (SELECT *, strpos(n, ' - ') AS p, trim(substr(n, 1, greatest(strpos(n, ' - ') - 1, 0))) AS l FROM x)
 SELECT folder_name, CASE WHEN p > 0 AND NOT regexp_matches(l, '{_PSEUDO}') THEN l ELSE '' END AS artist,
 CASE WHEN p > 0 AND NOT regexp_matches(l, '{_PSEUDO}') THEN trim(regexp_replace(trim(substr(n, p + 3)), '^[0-9]{{4}}[-\\s,]+', '')) ELSE n END AS album FROM y""",
)


def _files(spark, d):
    return table(spark, d, "folder_results").select("folder_id", F.posexplode("files").alias("pos", "f"))


_FILES = "(SELECT folder_id, CAST(generate_subscripts(files, 1) - 1 AS INT) AS pos, unnest(files) AS f FROM folder_results)"
_STEM = r"^\s*(\d{1,3})[\s._-]"
add(
    "track_num",
    lambda spark, d: _files(spark, d).select("folder_id", "pos", F.coalesce(F.expr("try_cast(nullif(regexp_extract(regexp_replace(" + r"regexp_extract(f.filename, '([^/\\\\]*)$', 1), '\\.[^.]+$', '')" + r", '^\\s*(\\d{1,3})[\\s._-]', 1), '') as int)"), F.lit(0)).alias("n")),
    f"SELECT folder_id, pos, coalesce(TRY_CAST(nullif(regexp_extract(regexp_replace(regexp_extract(f.filename, '([^/\\\\]*)$', 1), '\\.[^.]+$', ''), '{_STEM}', 1), '') AS INT), 0) AS n FROM {_FILES}",
)


def _vinyl(col):
    stem = F.regexp_replace(T.base_name(col), r"\.[^.]+$", "")
    plain, side = F.regexp_extract(stem, r"^\s*(\d{1,2})[\s._-]+.+$", 1), F.regexp_extract(stem, r"^\s*[A-Za-z]\s*(\d{1,2})[\s._-]+.+$", 1)
    return F.when(plain != "", plain.cast("int")).when(side != "", side.cast("int")).otherwise(F.lit(0))


_ST = f"regexp_replace({T.sql_base_name('f.filename')}, '\\.[^.]+$', '')"
add(
    "vinyl_track",
    lambda spark, d: _files(spark, d).select("folder_id", "pos", _vinyl(c("f")["filename"]).alias("n")),
    f"SELECT folder_id, pos, coalesce(TRY_CAST(nullif(regexp_extract({_ST}, '^\\s*([0-9]{{1,2}})[\\s._-]+.+$', 1), '') AS INT), TRY_CAST(nullif(regexp_extract({_ST}, '^\\s*[A-Za-z]\\s*([0-9]{{1,2}})[\\s._-]+.+$', 1), '') AS INT), 0) AS n FROM {_FILES}",
)
pair("tag_ints", "album_attributes", ["entity_id", "key"], {"n": lambda: F.expr(r"try_cast(nullif(regexp_extract(value, '^\\s*(\\d+)', 1), '') as int)"), "year": lambda: F.expr(r"try_cast(nullif(regexp_extract(value, '((?:19|20)\\d\\d)', 1), '') as int)")}, {"n": r"TRY_CAST(nullif(regexp_extract(value, '^\s*([0-9]+)', 1), '') AS INT)", "year": r"TRY_CAST(nullif(regexp_extract(value, '((?:19|20)[0-9][0-9])', 1), '') AS INT)"})


def canon(col):
    """Title for comparing tracks: one trailing bracket dropped, signs as spaces."""
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(col, F.lit("")))), r"\s*\([^)]*\)$", "")
    s = F.regexp_replace(F.replace(F.trim(s), F.lit("&"), F.lit(" and ")), "[-_:;,.!/]+", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def sql_canon(x):
    s = f"regexp_replace(lower(trim(coalesce({x}, ''))), '\\s*\\([^)]*\\)$', '')"
    s = f"regexp_replace(replace(trim({s}), '&', ' and '), '[-_:;,.!/]+', ' ', 'g')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


def canon_title(title, artist):
    t, a = canon(title), canon(artist)
    t = F.when((a != "") & t.startswith(F.concat(a, F.lit(" "))), F.trim(F.substr(t, F.length(a) + 1))).otherwise(t)
    return F.trim(F.regexp_replace(t, r"^\d{1,2}\s+", ""))


def sql_canon_title(title, artist):
    t, a = sql_canon(title), sql_canon(artist)
    return f"trim(regexp_replace(CASE WHEN {a} <> '' AND starts_with({t}, {a} || ' ') THEN trim(substr({t}, length({a}) + 1)) ELSE {t} END, '^[0-9]{{1,2}}\\s+', ''))"


pair("canon_title", "items", ["id"], {"k": lambda: canon_title(c("title"), c("artist"))}, {"k": sql_canon_title("title", "artist")})
_dir = lambda x: F.lower(F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("/")), "/+$", ""))
_SDIR = "lower(regexp_replace(replace(remote_dir, '\\', '/'), '/+$', ''))"
pair("dir_keys", "slskd_ledger", ["id"], {"whole": lambda: _dir(c("remote_dir")), "base": lambda: F.regexp_extract(_dir(c("remote_dir")), "([^/]*)$", 1)}, {"whole": _SDIR, "base": f"regexp_extract({_SDIR}, '([^/]*)$', 1)"})
# Titles that say nothing.
_GEN = r"(?i)^(?:\d{1,3}|(?:disc|cd|vol(?:ume)?)\s*\d{1,3})$"
pair("generic_query", "slskd_ledger", ["id"], {"by_identity": lambda: (F.length(F.trim(F.coalesce("artist", F.lit("")))) < 2) | (F.length(F.trim(F.coalesce("album", F.lit("")))) < 2), "by_pattern": lambda: F.coalesce(F.trim(c("album")).rlike(_GEN), F.lit(False))}, {"by_identity": "(length(trim(coalesce(artist, ''))) < 2 OR length(trim(coalesce(album, ''))) < 2)", "by_pattern": f"coalesce(regexp_matches(trim(album), '{_GEN}'), false)"})
# Rank of a format.
RANK = {"flac": 6, "alac": 6, "wav": 6, "aiff": 6, "m4a": 4, "aac": 4, "opus": 4, "ogg": 3, "mp3": 2, "wma": 1}


def quality_score():
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.lower(F.coalesce("format", F.lit("")))), F.lit(0))
    z = lambda n: F.coalesce(c(n), F.lit(0))
    return rank * 10000 + F.floor(z("bitrate") / 1000).cast("int") * 10 + F.floor(z("samplerate") / 10).cast("int") + z("bitdepth") * 100


_RANK = "CASE lower(coalesce(format, '')) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RANK.items()) + " ELSE 0 END"
SQL_QUALITY = f"CAST({_RANK} * 10000 + coalesce(bitrate, 0) // 1000 * 10 + coalesce(samplerate, 0) // 10 + coalesce(bitdepth, 0) * 100 AS INT)"
pair("quality_score", "items", ["id"], {"score": quality_score}, {"score": SQL_QUALITY})
pair("abs_path", "folder_results", ["folder_id"], {"p": lambda: F.when(c("directory").startswith("/"), c("directory")).otherwise(F.concat(F.lit("/library/"), c("directory")))}, {"p": "CASE WHEN starts_with(directory, '/') THEN directory ELSE '/library/' || directory END"})
NOW = 1_767_225_600.0
pair("time_ago", "fill_attempts", ["folder_name"], {"ago": lambda: F.when(c("last_queued") <= 0, "never").when((F.lit(NOW) - c("last_queued")) < 3600, F.concat(F.floor((F.lit(NOW) - c("last_queued")) / 60).cast("string"), F.lit("m"))).when((F.lit(NOW) - c("last_queued")) < 86400, F.concat(F.floor((F.lit(NOW) - c("last_queued")) / 3600).cast("string"), F.lit("h"))).otherwise(F.concat(F.floor((F.lit(NOW) - c("last_queued")) / 86400).cast("string"), F.lit("d")))}, {"ago": f"CASE WHEN last_queued <= 0 THEN 'never' WHEN {NOW} - last_queued < 3600 THEN CAST(floor(({NOW} - last_queued) / 60) AS BIGINT) || 'm' WHEN {NOW} - last_queued < 86400 THEN CAST(floor(({NOW} - last_queued) / 3600) AS BIGINT) || 'h' ELSE CAST(floor(({NOW} - last_queued) / 86400) AS BIGINT) || 'd' END"})
_BAD = "[^a-zA-Z0-9._-]"


def _safe(spark, d):
    from pyspark.sql.window import Window

    n = table(spark, d, "held_folders").select("folder_name", F.substring(F.regexp_replace("folder_name", _BAD, "_"), 1, 80).alias("safe"))
    k = F.row_number().over(Window.partitionBy("safe").orderBy("folder_name"))
    return n.withColumn("k", k).select("folder_name", F.when(F.col("k") == 1, F.col("safe")).otherwise(F.concat_ws("-", "safe", F.col("k").cast("string"))).alias("safe"))


add("safe_name", _safe, f"WITH n AS (SELECT folder_name, substr(regexp_replace(folder_name, '{_BAD}', '_', 'g'), 1, 80) AS safe FROM held_folders), k AS (SELECT *, row_number() OVER (PARTITION BY safe ORDER BY folder_name) AS k FROM n) SELECT folder_name, CASE WHEN k = 1 THEN safe ELSE safe || '-' || k END AS safe FROM k")
pair("parse_request", "held_folders", ["folder_name"], {"artist": lambda: F.when(F.instr("folder_name", " - ") > 0, F.trim(F.split("folder_name", " - ", 2)[0])), "album": lambda: F.when(F.instr("folder_name", " - ") > 0, F.trim(F.split("folder_name", " - ", 2)[1])), "error": lambda: F.when(F.trim("folder_name") == "", "empty").when(F.instr("folder_name", " - ") == 0, "no separator")}, {"artist": "CASE WHEN strpos(folder_name, ' - ') > 0 THEN trim(substr(folder_name, 1, strpos(folder_name, ' - ') - 1)) END", "album": "CASE WHEN strpos(folder_name, ' - ') > 0 THEN trim(substr(folder_name, strpos(folder_name, ' - ') + 3)) END", "error": "CASE WHEN trim(folder_name) = '' THEN 'empty' WHEN strpos(folder_name, ' - ') = 0 THEN 'no separator' END"})


def missing_tracks(reason):
    """Track numbers of ``missing=[..]`` in a reason; parts that are no whole number do not count; none where there is no such list."""
    inner = F.regexp_extract(F.coalesce(reason, F.lit("")), r"missing=\[([^\]]+)\]", 1)
    parts = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.transform(F.filter(parts, lambda x: x.rlike(r"^\d+$")), lambda x: x.cast("int"))


def present_count(reason, place):
    """First or second number of ``present=a/b`` in a reason, 0 where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(reason, F.lit("")), r"present=(\d+)/(\d+)", place), F.lit("")).cast("int"), F.lit(0))
