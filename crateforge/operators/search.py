"""Search results of peers: scores of files and folders, ranking, choice of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crateforge.functions import text as T
from crateforge.functions.session import table
from crateforge.operators.text_queries import sql_wish_key

QUERIES, SQL = {}, {}
c = F.col

# Base scores of formats for music, the floors, and the bonuses for depth and rate.
FORMATS = {"flac": 500, "wav": 450, "aiff": 450, "aif": 450, "ape": 420, "wv": 420, "alac": 420, "opus": 300, "mp3": 200}
LOSSY = ("mp3", "m4a", "m4b", "aac")
SPEED_FLOOR, KBPS_FLOOR, LOSSLESS_SCORE = 500_000, 310, 400
# The second profile, for spoken albums: slow peers and low bitrates are usual, containers of its kind count.
SPOKEN_FORMATS = FORMATS | {"m4a": 200, "m4b": 200, "aac": 200}
SPOKEN_KBPS_FLOOR = 24
RATES = ((44100, 0), (48000, 10), (88200, 20), (96000, 25), (192000, 25))


def q(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


def _r(s, d):
    return table(s, d, "folder_results")


def files(results: DataFrame) -> DataFrame:
    """folder_id, pos and the fields of each file."""
    return results.select("folder_id", F.posexplode("files").alias("pos", "f")).select("folder_id", "pos", c("f.filename").alias("filename"), c("f.size").alias("size"), c("f.length").alias("length"), c("f.bitDepth").alias("depth"), c("f.sampleRate").alias("rate"), T.extension(c("f.filename")).alias("ext"))


_FILES = f"(SELECT folder_id, pos, f.filename AS filename, f.size AS size, f.length AS length, f.bitDepth AS depth, f.sampleRate AS rate, {T.sql_extension('f.filename')} AS ext FROM (SELECT folder_id, CAST(generate_subscripts(files, 1) - 1 AS INT) AS pos, unnest(files) AS f FROM folder_results))"


def file_score(formats: dict[str, int] | None = None, kbps_floor: int = KBPS_FLOOR) -> Column:
    """Score of a file under a profile: base of its format, a bitrate floor for lossy ones, bonuses for the others; -1 where it is out."""
    base = F.element_at(F.create_map(*[F.lit(x) for kv in (formats or FORMATS).items() for x in kv]), c("ext"))
    length = F.coalesce("length", F.lit(0))
    kbps = F.when(length > 0, c("size") * 8 / F.nullif(length, F.lit(0)) / 1000)
    depth = F.when(c("depth").isin(24, 32), 30).otherwise(0)
    near = F.array_min(F.array(*[F.struct(F.abs(F.coalesce(F.nullif("rate", F.lit(0)), F.lit(44100)) - r).alias("d"), F.lit(i).alias("i"), F.lit(b).alias("b")) for i, (r, b) in enumerate(RATES)]))["b"]
    return F.when(base.isNull(), -1).when(c("ext").isin(*LOSSY) & (length <= 0), F.when(c("ext") == "mp3", -1).otherwise(base)).when(c("ext").isin(*LOSSY) & (kbps < kbps_floor), -1).when(base >= 400, base + depth + near).otherwise(base)


_base_of = lambda formats: "CASE ext " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in formats.items()) + " END"
_BASE = _base_of(FORMATS)
_NEAR = "list_sort([" + ", ".join(f"struct_pack(d := abs(coalesce(nullif(rate, 0), 44100) - {r}), i := {i}, b := {b})" for i, (r, b) in enumerate(RATES)) + "])[1].b"
_LOSSY = "ext IN ('mp3', 'm4a', 'm4b', 'aac')"


def _sql_file_score(base: str, floor: int) -> str:
    return f"""(CASE WHEN {base} IS NULL THEN -1 WHEN {_LOSSY} AND coalesce(length, 0) <= 0 THEN CASE WHEN ext = 'mp3' THEN -1 ELSE {base} END WHEN {_LOSSY} AND size * 8 / nullif(length, 0) / 1000 < {floor} THEN -1
 WHEN {base} >= 400 THEN {base} + CASE WHEN depth IN (24, 32) THEN 30 ELSE 0 END + {_NEAR} ELSE {base} END)"""


_FS = _sql_file_score(_BASE, KBPS_FLOOR)
q("file_score", lambda s, d: files(_r(s, d)).select("folder_id", "pos", "ext", file_score().alias("score")), f"SELECT folder_id, pos, ext, {_FS} AS score FROM {_FILES}")
q("file_score_spoken", lambda s, d: files(_r(s, d)).select("folder_id", "pos", "ext", file_score(SPOKEN_FORMATS, SPOKEN_KBPS_FLOOR).alias("score")), f"SELECT folder_id, pos, ext, {_sql_file_score(_base_of(SPOKEN_FORMATS), SPOKEN_KBPS_FLOOR)} AS score FROM {_FILES}")


def _overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


# Marks of a compilation in a folder name, and the words of a wish that ask for one.
_VA = r"(?i)(?:^|[\s\-_(\[])(?:v\.?a\.?|various\s*artists?|compilation)(?:[\s\-_)\]]|$)"
_VA_WORDS = ("various", "artists", "va", "compilation")
#: Wishes that every folder is scored for: the artist and the album of a wish as search words.
WISH = ("the lemfirtem fires", "songs from kolmer")


def name_bonus(directory: Column, artist: str, album: str) -> Column:
    """Bonus of a folder's name for the words of a wish, less what it names besides: unrequested artists and compilations."""
    name = T.base_name(directory)
    own, a, t = T.search_tokens(name), T.search_tokens(F.lit(artist)), T.search_tokens(F.lit(album))
    hits = _overlap(t, own)
    plus = hits * 50 + F.when(hits == F.size(t), 30).otherwise(0) + _overlap(a, own) * 15
    segments = F.slice(F.split(name, T.CREDIT), 2, 1000)
    alien = F.size(F.filter(segments, lambda g: (F.size(T.search_tokens(g)) > 0) & (F.size(F.array_intersect(T.search_tokens(g), F.concat(a, t))) == 0)))
    # no penalty where the wish itself asks for a compilation, or names no artist
    asked = (F.size(a) == 0) | (_overlap(a, F.array(*[F.lit(w) for w in _VA_WORDS])) > 0)
    return plus - 60 * alien - F.when(~asked & name.rlike(_VA), 80).otherwise(0)


_NAME = T.sql_base_name("directory")
_TOK = T.sql_search_tokens
_A, _T2 = _TOK(f"'{WISH[0]}'"), _TOK(f"'{WISH[1]}'")
_HIT = lambda x, y: f"len(list_intersect({x}, {y}))"
_SEG = f"string_split_regex({_NAME}, '{T.CREDIT}')[2:]"
_BONUS = f"""({_HIT(_T2, _TOK(_NAME))} * 50 + CASE WHEN {_HIT(_T2, _TOK(_NAME))} = len({_T2}) THEN 30 ELSE 0 END + {_HIT(_A, _TOK(_NAME))} * 15
 - 60 * len(list_filter({_SEG}, lambda g: len({_TOK("g")}) > 0 AND len(list_intersect({_TOK("g")}, list_concat({_A}, {_T2}))) = 0)) - CASE WHEN len({_A}) > 0 AND NOT list_has_any({_A}, {list(_VA_WORDS)}) AND regexp_matches({_NAME}, '{_VA}') THEN 80 ELSE 0 END)"""
q("name_bonus", lambda s, d: _r(s, d).select("folder_id", name_bonus(c("directory"), *WISH).alias("bonus")), f"SELECT folder_id, CAST({_BONUS} AS INT) AS bonus FROM folder_results")


def folder_scores(results: DataFrame, artist: str, album: str) -> DataFrame:
    """Score of each folder: its weakest valid file, speed, number of files and name; -1 where the peer is slow or no file is valid."""
    s = file_score()
    worst = files(results).groupBy("folder_id").agg(F.min(F.when(s >= 0, s)).alias("worst"), F.count(F.lit(1)).alias("n"))
    j = results.select("folder_id", "username", "directory", "upload_speed", "file_count").join(worst, "folder_id", "left")
    speed = F.least(F.floor(c("upload_speed") * 5 / SPEED_FLOOR), F.lit(50))
    total = c("worst") + speed + F.least(c("n") * 2, F.lit(40)) + name_bonus(c("directory"), artist, album)
    ok = (c("upload_speed") >= SPEED_FLOOR) & c("worst").isNotNull()
    return j.select("folder_id", "username", "directory", "file_count", F.when(ok, total).otherwise(F.lit(-1)).cast("bigint").alias("total"))


_TOTAL = f"""(SELECT r.folder_id, r.username, r.directory, r.file_count, CAST(CASE WHEN upload_speed >= {SPEED_FLOOR} AND worst IS NOT NULL THEN worst + least(floor(upload_speed * 5 / {SPEED_FLOOR}), 50) + least(n * 2, 40) + {_BONUS} ELSE -1 END AS BIGINT) AS total
 FROM folder_results r LEFT JOIN (SELECT folder_id, min(CASE WHEN {_FS} >= 0 THEN {_FS} END) AS worst, count(*) AS n FROM {_FILES} GROUP BY folder_id) w ON w.folder_id = r.folder_id)"""
_scores = lambda s, d: folder_scores(_r(s, d), *WISH)
q("folder_score", lambda s, d: _scores(s, d).select("folder_id", "total"), f"SELECT folder_id, total FROM {_TOTAL} AS t")
q("rank_folders", lambda s, d: _scores(s, d).where("total >= 0").select("folder_id", "total").orderBy(F.desc("total"), "folder_id"), f"SELECT folder_id, total FROM {_TOTAL} AS t WHERE total >= 0")


def best_by(scores: DataFrame, key: str) -> DataFrame:
    """Best folder of each key, the earlier on a tie; none below zero. One aggregation."""
    return scores.where("total >= 0").groupBy(key).agg(F.max(F.struct("total", (-c("folder_id")).alias("i"))).alias("m")).select(key, (-c("m.i")).alias("folder_id"), c("m.total").alias("total"))


q("best_folder", lambda s, d: best_by(_scores(s, d), "username"), f"SELECT username, folder_id, total FROM (SELECT *, row_number() OVER (PARTITION BY username ORDER BY total DESC, folder_id) AS k FROM {_TOTAL} AS t WHERE total >= 0) WHERE k = 1")
q("peer_fallback", lambda s, d: best_by(_scores(s, d), "username").orderBy(F.desc("total"), "folder_id").limit(5), f"SELECT username, folder_id, total FROM (SELECT *, row_number() OVER (PARTITION BY username ORDER BY total DESC, folder_id) AS k FROM {_TOTAL} AS t WHERE total >= 0) WHERE k = 1 ORDER BY total DESC, folder_id LIMIT 5")


def watchdog_scores(results: DataFrame, kbps_floor: int = KBPS_FLOOR) -> DataFrame:
    """The stall watchdog's own score: mean of the accepted files, cut to an integer, and a bonus for whole megabytes a second.

    Lossy files below the bitrate floor do not count; without length or size they do. No accepted file: 0.
    """
    base = F.element_at(F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv]), c("ext"))
    kbps = F.when((c("length") != 0) & (c("size") != 0), c("size") * 8 / (c("length") * 1000))
    taken = F.when(~F.coalesce((base < LOSSLESS_SCORE) & (kbps < kbps_floor), F.lit(False)), base)
    mean = files(results).groupBy("folder_id").agg(F.floor(F.sum(taken) / F.count(taken)).alias("mean"))
    bonus = F.least(F.floor(c("upload_speed") / 1_000_000) * 5, F.lit(50))
    return results.select("folder_id", "upload_speed").join(mean, "folder_id", "left").select("folder_id", F.coalesce(c("mean") + bonus, F.lit(0)).cast("bigint").alias("total"))


_TAKEN = f"CASE WHEN NOT coalesce({_BASE} < {LOSSLESS_SCORE} AND CASE WHEN length <> 0 AND size <> 0 THEN size * 8 / (length * 1000) END < {KBPS_FLOOR}, false) THEN {_BASE} END"
q("watchdog_score", lambda s, d: watchdog_scores(_r(s, d)), f"SELECT r.folder_id, CAST(coalesce(m.mean + least(floor(upload_speed / 1000000) * 5, 50), 0) AS BIGINT) AS total FROM folder_results r LEFT JOIN (SELECT folder_id, floor(sum({_TAKEN}) / count({_TAKEN})) AS mean FROM {_FILES} GROUP BY folder_id) m USING (folder_id)")


def expanded(results: DataFrame) -> DataFrame:
    """Files of one format per folder against its whole listing under the same peer and directory; never fewer than the hits."""
    listing = results.select("username", "directory", F.explode("files").alias("f")).select("username", "directory", T.extension(c("f.filename")).alias("ext"), c("f.filename").alias("filename")).distinct()
    full = listing.groupBy("username", "directory", "ext").agg(F.count(F.lit(1)).alias("n"))
    hit = results.select("folder_id", "username", "directory", c("fmt").alias("ext"), F.size("files").alias("hits"))
    return hit.join(full, ["username", "directory", "ext"], "left").select("folder_id", F.greatest(F.coalesce("n", F.lit(0)), c("hits")).cast("bigint").alias("n_files"))


q("expand_folder", lambda s, d: expanded(_r(s, d)), f"WITH l AS (SELECT DISTINCT username, directory, {T.sql_extension('f.filename')} AS ext, f.filename FROM (SELECT username, directory, unnest(files) AS f FROM folder_results)), n AS (SELECT username, directory, ext, count(*) AS n FROM l GROUP BY ALL) SELECT r.folder_id, greatest(coalesce(n, 0), len(files)) AS n_files FROM folder_results r LEFT JOIN n ON n.username = r.username AND n.directory = r.directory AND n.ext = r.fmt")


def assigned(results: DataFrame, top: int = 5) -> DataFrame:
    """Source of each missing track: the first of the best ``top`` folders of an album that has it.

    The greedy walk over folders equals the first row of each track by rank of
    folder and place of the file.
    """
    w = Window.partitionBy("album").orderBy(F.desc("score"), "folder_id")
    ranked = results.select("folder_id", "score", T.wish_key(T.base_name(c("directory"))).alias("album")).where("score >= 0").withColumn("rank", F.row_number().over(w)).where(c("rank") <= top)
    f = files(results).select("folder_id", "pos", F.expr("try_cast(nullif(regexp_extract(regexp_extract(filename, '([^/\\\\\\\\]*)$', 1), '^\\\\s*(\\\\d{1,3})[\\\\s._-]', 1), '') as int)").alias("track")).where("track > 0")
    return ranked.join(f, "folder_id").groupBy("album", "track").agg(F.min(F.struct("rank", "pos", "folder_id")).alias("m")).select("album", "track", c("m.folder_id").alias("folder_id"), c("m.pos").alias("pos"))


def coverage(results: DataFrame) -> DataFrame:
    """Number of tracks a folder lists, and whether they are 1 to k: the whole folder serves as fallback otherwise."""
    f = files(results).select("folder_id", F.expr("try_cast(nullif(regexp_extract(regexp_extract(filename, '([^/\\\\\\\\]*)$', 1), '^\\\\s*(\\\\d{1,3})[\\\\s._-]', 1), '') as int)").alias("track"))
    return f.groupBy("folder_id").agg(F.count_distinct("track").alias("tracks"), F.max("track").alias("hi")).select("folder_id", "tracks", F.coalesce(c("tracks") == c("hi"), F.lit(False)).alias("whole"))


_TRK = "TRY_CAST(nullif(regexp_extract(regexp_extract(filename, '([^/\\\\]*)$', 1), '^\\s*([0-9]{1,3})[\\s._-]', 1), '') AS INT)"
q("assign_sources", lambda s, d: assigned(_r(s, d)), f"""WITH r AS (SELECT folder_id, album, row_number() OVER (PARTITION BY album ORDER BY score DESC, folder_id) AS rank FROM (SELECT folder_id, score, {sql_wish_key(_NAME)} AS album FROM folder_results WHERE score >= 0)),
 f AS (SELECT r.album, r.rank, r.folder_id, t.pos, t.track FROM r JOIN (SELECT folder_id, pos, {_TRK} AS track FROM {_FILES}) t ON t.folder_id = r.folder_id WHERE rank <= 5 AND track > 0)
 SELECT album, track, folder_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY album, track ORDER BY rank, pos, folder_id) AS k FROM f) WHERE k = 1""")
q("fallback_assign", lambda s, d: coverage(_r(s, d)), f"SELECT folder_id, count(DISTINCT {_TRK}) AS tracks, coalesce(count(DISTINCT {_TRK}) = max({_TRK}), false) AS whole FROM {_FILES} GROUP BY folder_id")


def audiobook_signals(items: DataFrame) -> DataFrame:
    """Signals of a spoken album in one aggregation: mp3 only and low bitrate, titles that count parts."""
    part = F.lower("title").rlike(r"(?:^|[^a-z])(?:chapter|part|kapitel|chapitre)\s*\d+")
    return items.groupBy("album_id").agg(
        F.coalesce(F.bool_and(F.lower("format") == "mp3"), F.lit(False)).alias("mp3_only"),
        F.coalesce(F.bool_and(F.when(c("bitrate") > 0, c("bitrate") < 128000)), F.lit(False)).alias("low_bitrate"),
        (F.count_if(part) >= F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 2))).alias("parts"),
    )


q("audiobook_signals", lambda s, d: audiobook_signals(table(s, d, "items")), r"SELECT album_id, coalesce(bool_and(lower(format) = 'mp3'), false) AS mp3_only, coalesce(bool_and(CASE WHEN bitrate > 0 THEN bitrate < 128000 END), false) AS low_bitrate, count(*) FILTER (regexp_matches(lower(title), '(?:^|[^a-z])(?:chapter|part|kapitel|chapitre)\s*[0-9]+')) >= greatest(1, count(*) // 2) AS parts FROM items GROUP BY album_id")
q("folder_guess", lambda s, d: _r(s, d).select("folder_id", F.trim(F.regexp_replace(F.regexp_replace(T.base_name(c("directory")), r"[\[({][^\])}]*[\])}]", ""), r"^\d{4}\s*-\s*", "")).alias("album"), T.base_name(T.parent_name(c("directory"))).alias("artist")), f"SELECT folder_id, trim(regexp_replace(regexp_replace({_NAME}, '[\\[({{][^\\])}}]*[\\])}}]', '', 'g'), '^[0-9]{{4}}\\s*-\\s*', '')) AS album, {T.sql_base_name(T.sql_parent_name('directory'))} AS artist FROM folder_results")


def existing_tracks(albums: DataFrame, items: DataFrame, wishes: DataFrame) -> DataFrame:
    """Tracks in the library for each wish, by normalised credit and title."""
    have = albums.select("id", T.content_hash(c("albumartist"), c("album")).alias("k")).join(items.groupBy(c("album_id").alias("id")).agg(F.count_distinct("track").alias("n")), "id").groupBy("k").agg(F.max("n").alias("n"))
    w = wishes.select(c("id").alias("wish"), T.content_hash(c("artist"), c("album")).alias("k"))
    return w.join(have, "k", "left").select("wish", F.coalesce("n", F.lit(0)).alias("n")).distinct()


q("existing_tracks", lambda s, d: existing_tracks(table(s, d, "albums"), table(s, d, "items"), table(s, d, "slskd_ledger")), f"WITH h AS (SELECT {T.sql_content_hash('albumartist', 'album')} AS k, max((SELECT count(DISTINCT track) FROM items i WHERE i.album_id = a.id)) AS n FROM albums a WHERE id IN (SELECT album_id FROM items) GROUP BY 1) SELECT DISTINCT id AS wish, coalesce(n, 0) AS n FROM slskd_ledger l LEFT JOIN h ON h.k = {T.sql_content_hash('l.artist', 'l.album')}")
q("candidate_choice", lambda s, d: table(s, d, "items").select("album_id", "artist", "album").groupBy("album_id").agg(F.min("artist").alias("ta"), F.min("album").alias("tt")).join(table(s, d, "albums").select(c("id").alias("album_id"), "albumartist", c("album").alias("parsed")), "album_id").select("album_id", F.when(F.trim("tt") != "", c("ta")).otherwise(c("albumartist")).alias("artist"), F.when(F.trim("tt") != "", c("tt")).otherwise(c("parsed")).alias("album")), "WITH t AS (SELECT album_id, min(artist) AS ta, min(album) AS tt FROM items GROUP BY album_id) SELECT album_id, CASE WHEN trim(tt) <> '' THEN ta ELSE albumartist END AS artist, CASE WHEN trim(tt) <> '' THEN tt ELSE a.album END AS album FROM t JOIN albums a ON a.id = t.album_id")
q("retry_query", lambda s, d: table(s, d, "mb_canonical_cache").where("canonical_artist is not null").select("artist_key", "album_key", F.lower(F.concat_ws(" ", "canonical_artist", "canonical_title")).alias("retry")).where(c("retry") != F.concat_ws(" ", "artist_key", "album_key")), "SELECT artist_key, album_key, lower(concat_ws(' ', canonical_artist, canonical_title)) AS retry FROM mb_canonical_cache WHERE canonical_artist IS NOT NULL AND lower(concat_ws(' ', canonical_artist, canonical_title)) <> concat_ws(' ', artist_key, album_key)")
q("author_title", lambda s, d: table(s, d, "items").where(F.trim("artist") != "").groupBy("album_id", "artist").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("f")).groupBy("album_id").agg(F.max(F.struct("n", (-c("f")).alias("f"), "artist"))["artist"].alias("author")).join(table(s, d, "albums").select(c("id").alias("album_id"), F.regexp_replace(F.coalesce("album", F.lit("")), r"^(?i:vol(?:ume)?)\.?\s*\d+\s*-\s*(?:\d{4}\s*-\s*)?", "").alias("title")), "album_id", "right").select("album_id", F.coalesce("author", F.lit("Unknown Author")).alias("author"), "title"), r"WITH v AS (SELECT album_id, artist, count(*) AS n, min(id) AS f FROM items WHERE trim(artist) <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY album_id ORDER BY n DESC, f) AS k FROM v) SELECT a.id AS album_id, coalesce(r.artist, 'Unknown Author') AS author, regexp_replace(coalesce(a.album, ''), '^(?i:vol(?:ume)?)\.?\s*[0-9]+\s*-\s*(?:[0-9]{4}\s*-\s*)?', '') AS title FROM albums a LEFT JOIN r ON r.album_id = a.id AND k = 1")


_BARE = r"[\[({][^\])}]*[\])}]"


def recover_status(ledger: DataFrame, results: DataFrame, existing: DataFrame) -> DataFrame:
    """What a recovery run does with each wish of the ledger, by the first of its rules that holds.

    A wish with an outcome keeps it; then nothing found, nothing good enough, all
    tracks there already, else queued. ``existing``: wish, n. The folders of a wish
    are those whose name, without brackets and year, has the title's key.
    """
    wish = ledger.groupBy(T.wish_key(c("artist")).alias("a"), T.wish_key(c("album")).alias("t")).agg(F.max(F.struct("id", "state")).alias("m")).select("a", "t", c("m.id").alias("wish"), c("m.state").alias("prior"))
    bare = F.regexp_replace(F.regexp_replace(T.base_name(c("directory")), _BARE, ""), r"^\d{4}\s*-\s*", "")
    scored = folder_scores(results, *WISH).select(T.wish_key(bare).alias("t"), "total", "file_count", "folder_id")
    best = F.max(F.when(c("total") >= 0, F.struct("total", (-c("folder_id")).alias("f"), "file_count")))
    found = scored.where("t <> ''").groupBy("t").agg(F.count(F.lit(1)).alias("n"), best["file_count"].alias("files"), F.max("total").alias("top"))
    j = wish.join(found, "t", "left").join(existing, "wish", "left")
    have = F.coalesce(existing["n"], F.lit(0))
    status = F.when(~c("prior").isin("failed", "queued"), c("prior")).when(c("top").isNull(), "not_found").when(c("top") < 0, "no_quality").when((have > 0) & (have >= c("files")), "skipped").otherwise("queued")
    return j.select("wish", status.alias("status"))


q("recover_status", lambda s, d: recover_status(table(s, d, "slskd_ledger"), _r(s, d), existing_tracks(table(s, d, "albums"), table(s, d, "items"), table(s, d, "slskd_ledger"))), f"""WITH e AS ({SQL["existing_tracks"]}), w AS (SELECT id AS wish, t, state AS prior FROM (SELECT *, row_number() OVER (PARTITION BY a, t ORDER BY id DESC, state DESC) AS k FROM (SELECT id, state, {sql_wish_key("artist")} AS a, {sql_wish_key("album")} AS t FROM slskd_ledger)) WHERE k = 1),
 s AS (SELECT {sql_wish_key("regexp_replace(regexp_replace(" + _NAME + ", '[\\[({][^\\])}]*[\\])}]', '', 'g'), '^[0-9]{4}\\s*-\\s*', '')")} AS t, total, file_count, folder_id FROM {_TOTAL} AS x),
 g AS (SELECT t, file_count AS files, total AS top FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY total DESC, folder_id) AS k FROM s) WHERE k = 1)
 SELECT w.wish, CASE WHEN prior NOT IN ('failed', 'queued') THEN prior WHEN top IS NULL THEN 'not_found' WHEN top < 0 THEN 'no_quality' WHEN coalesce(e.n, 0) > 0 AND e.n >= files THEN 'skipped' ELSE 'queued' END AS status FROM w LEFT JOIN g ON g.t = w.t AND w.t <> '' LEFT JOIN e ON e.wish = w.wish""")
