"""Keyed state: the ledger of requests, the outbox, caches and folders held back; reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crateforge.functions import text as T
from crateforge.functions.session import table
from crateforge.operators.text_queries import sql_wish_key

QUERIES, SQL = {}, {}
c = F.col
NOW = 1_767_225_600.0
LIVE = ("queued", "downloading")
_SLIVE = "('queued', 'downloading')"
DAY = 86400.0


def q(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


def _l(s, d):
    return table(s, d, "slskd_ledger")


def once(ledger: DataFrame) -> DataFrame:
    """Rows delivered twice, whole, count once: one aggregation by id."""
    return ledger.groupBy("id").agg(*[F.min(n).alias(n) for n in ledger.columns if n != "id"])


_ONCE = "(SELECT DISTINCT * FROM slskd_ledger)"


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """Last row of each key by ``order``, then id; no sort, one aggregation."""
    return df.groupBy(key).agg(F.max(F.struct(order, "id", "state")).alias("m")).select(key, c("m.id").alias("id"), c("m.state").alias("state"))


q("ledger_last_live", lambda s, d: latest(_l(s, d).where(c("state").isin(*LIVE)), "identity_key", "queued_at"), f"SELECT identity_key, id, state FROM (SELECT *, row_number() OVER (PARTITION BY identity_key ORDER BY queued_at DESC, id DESC) AS k FROM {_ONCE} WHERE state IN {_SLIVE}) WHERE k = 1")
q("ledger_last_terminal", lambda s, d: latest(_l(s, d).where(~c("state").isin(*LIVE) & c("terminal_at").isNotNull()), "identity_key", "terminal_at"), f"SELECT identity_key, id, state FROM (SELECT *, row_number() OVER (PARTITION BY identity_key ORDER BY terminal_at DESC, id DESC) AS k FROM {_ONCE} WHERE state NOT IN {_SLIVE} AND terminal_at IS NOT NULL) WHERE k = 1")
q("ledger_counts", lambda s, d: once(_l(s, d)).groupBy("state").agg(F.count(F.lit(1)).alias("n")), f"SELECT state, count(*) AS n FROM {_ONCE} GROUP BY state")
q("ledger_recent", lambda s, d: once(_l(s, d)).orderBy(F.desc("id")).limit(20).select("id", "identity_key", "state"), f"SELECT id, identity_key, state FROM {_ONCE} ORDER BY id DESC LIMIT 20")
q("ledger_live", lambda s, d: once(_l(s, d)).where(c("state").isin(*LIVE)).select("id", "identity_key", "state").orderBy("id"), f"SELECT id, identity_key, state FROM {_ONCE} WHERE state IN {_SLIVE}")
q("ledger_stuck", lambda s, d: once(_l(s, d)).where(c("state").isin(*LIVE) & ((F.lit(NOW) - c("updated_at")) / 3600 >= 24)).select("id", F.floor((F.lit(NOW) - c("updated_at")) / 3600).alias("hours")), f"SELECT id, CAST(floor(({NOW} - updated_at) / 3600) AS BIGINT) AS hours FROM {_ONCE} WHERE state IN {_SLIVE} AND ({NOW} - updated_at) / 3600 >= 24")


def set_state(ledger: DataFrame, changes: DataFrame, now: float) -> DataFrame:
    """New states by id; only a terminal one stamps ``terminal_at``."""
    j = ledger.join(changes.select("id", c("state").alias("to")), "id", "left")
    ended = c("to").isNotNull() & ~c("to").isin(*LIVE)
    return j.withColumn("terminal_at", F.when(ended, F.lit(now)).otherwise(c("terminal_at"))).withColumn("updated_at", F.when(c("to").isNotNull(), F.lit(now)).otherwise(c("updated_at"))).withColumn("state", F.coalesce("to", "state")).drop("to")


q("ledger_set_state", lambda s, d: set_state(once(_l(s, d)), once(_l(s, d)).where(c("state").isin(*LIVE)).select("id", F.when(c("state") == "downloading", "completed").otherwise("downloading").alias("state")), NOW).select("id", "state", "terminal_at", "updated_at"), f"SELECT id, CASE state WHEN 'downloading' THEN 'completed' WHEN 'queued' THEN 'downloading' ELSE state END AS state, CASE WHEN state = 'downloading' THEN {NOW} ELSE terminal_at END AS terminal_at, CASE WHEN state IN ('queued', 'downloading') THEN {NOW} ELSE updated_at END AS updated_at FROM {_ONCE}")


def claims(ledger: DataFrame) -> DataFrame:
    """The first claim of each identity that has no live row yet: at most one live row of an identity results."""
    live = ledger.where(c("state").isin(*LIVE)).select("identity_key")
    asked = ledger.where(~c("state").isin(*LIVE))
    return asked.join(live, "identity_key", "left_anti").groupBy("identity_key").agg(F.min(F.struct("queued_at", "id"))["id"].alias("id"))


q("claim_inflight", lambda s, d: claims(once(_l(s, d))), f"SELECT identity_key, id FROM (SELECT *, row_number() OVER (PARTITION BY identity_key ORDER BY queued_at, id) AS k FROM {_ONCE} WHERE state NOT IN {_SLIVE} AND identity_key NOT IN (SELECT identity_key FROM slskd_ledger WHERE state IN {_SLIVE} AND identity_key IS NOT NULL)) WHERE k = 1")


# States of a file as the peers' service writes them, and the marks of those that wait or run.
FILE_STATES = ("Completed, Succeeded", "InProgress", "Queued, Remotely", "Completed, Errored", "Completed, Succeeded", "Initializing")
ACTIVE = ("InProgress", "Initializing", "Requested")


def flat_transfers(results: DataFrame) -> DataFrame:
    """username, directory, state of every file as the peers' service lists it; no list of a peer is gathered.

    The state of a file follows from its size, so that every state occurs.
    """
    states = F.array(*[F.lit(x) for x in FILE_STATES])
    size = F.coalesce(c("f.size"), F.lit(0))
    return results.select("username", "directory", F.explode("files").alias("f")).select("username", "directory", F.get(states, (size % len(FILE_STATES)).cast("int")).alias("state"))


_FLAT = f"(SELECT username, directory, CASE coalesce(f.size, 0) % {len(FILE_STATES)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(FILE_STATES)) + " END AS state FROM (SELECT username, directory, unnest(files) AS f FROM folder_results))"


def _any_of(x: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(x, F.lit(m))
    return out


def _live_state(x: Column) -> Column:
    return ~F.contains(x, F.lit("Completed")) & _any_of(x, ("Queued", *ACTIVE))


_sany = lambda marks: "(" + " OR ".join(f"contains(state, '{m}')" for m in marks) + ")"
_SLV = f"(NOT contains(state, 'Completed') AND {_sany(('Queued', *ACTIVE))})"
_r = lambda s, d: table(s, d, "folder_results")
q("pending_count", lambda s, d: flat_transfers(_r(s, d)).groupBy("username").agg(F.sum(_live_state(c("state")).cast("int")).alias("n")).where("n > 0"), f"SELECT username, count(*) AS n FROM {_FLAT} WHERE {_SLV} GROUP BY username")
_key = lambda x: F.lower(F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("/")), "/+$", ""))
_skey = lambda x: f"lower(regexp_replace(replace({x}, '\\', '/'), '/+$', ''))"


def busy(results: DataFrame, ledger: DataFrame, available: bool = True) -> DataFrame:
    """Directories in use by live transfers or live ledger rows; null stands for all where the source is unknown, as unknown is not empty."""
    if not available:
        return results.sparkSession.createDataFrame([(None,)], "dir string")
    t = flat_transfers(results).where(_live_state(c("state"))).select(_key(c("directory")).alias("dir"))
    return t.union(ledger.where(c("state").isin(*LIVE) & (c("remote_dir") != "")).select(_key(c("remote_dir")))).distinct()


q("busy_dirs", lambda s, d: busy(_r(s, d), _l(s, d)), f"SELECT {_skey('directory')} AS dir FROM {_FLAT} WHERE {_SLV} UNION SELECT {_skey('remote_dir')} FROM slskd_ledger WHERE state IN {_SLIVE} AND remote_dir <> ''")


def polled(ledger: DataFrame, results: DataFrame, now: float) -> DataFrame:
    """State transition of each live row from the transfers of its user and directory.

    One equi-join on user and directory key, one aggregation, one ladder: a row
    without transfers expires after 48 hours and else stays.
    """
    t = flat_transfers(results).select(c("username").alias("u"), _key(c("directory")).alias("k"), "state")
    live = _live_state(c("state"))
    g = t.groupBy("u", "k").agg(F.bool_or(live).alias("any_live"), F.bool_or(_any_of(c("state"), ACTIVE)).alias("any_active"), F.bool_and(live).alias("all_live"), F.bool_and(F.contains("state", F.lit("Succeeded"))).alias("all_ok"))
    rows = ledger.where(c("state").isin(*LIVE)).select("id", "state", "username", _key(c("remote_dir")).alias("k"), ((F.lit(now) - c("queued_at")) / 3600).alias("age"))
    j = rows.join(g, (c("username") == c("u")) & (rows["k"] == g["k"]) & (rows["k"] != ""), "left")
    to = (
        F.when(c("any_live").isNull(), F.when(c("age") >= 48, "expired")).when(c("any_active"), F.when(c("state") == "queued", "downloading"))
        .when(c("any_live"), F.when((c("state") == "queued") & (c("age") >= 48) & c("all_live"), "expired")).when(c("all_ok"), "completed").otherwise("failed")
    )
    return j.select("id", "state", to.alias("to"))


q("ledger_poll", lambda s, d: polled(once(_l(s, d)), _r(s, d), NOW), f"""WITH t AS (SELECT username AS u, {_skey("directory")} AS k, {_SLV} AS live, state FROM {_FLAT}), g AS (SELECT u, k, bool_or(live) AS al, bool_or({_sany(ACTIVE)}) AS aa, bool_and(live) AS ll, bool_and(contains(state, 'Succeeded')) AS ok FROM t GROUP BY u, k)
 SELECT l.id, state, CASE WHEN al IS NULL THEN CASE WHEN ({NOW} - queued_at) / 3600 >= 48 THEN 'expired' END WHEN aa THEN CASE WHEN state = 'queued' THEN 'downloading' END WHEN al THEN CASE WHEN state = 'queued' AND ({NOW} - queued_at) / 3600 >= 48 AND ll THEN 'expired' END WHEN ok THEN 'completed' ELSE 'failed' END AS "to"
 FROM {_ONCE} l LEFT JOIN g ON g.u = l.username AND g.k = {_skey("remote_dir")} AND g.k <> '' WHERE state IN {_SLIVE}""")
_NOTES = r"[\[({][^\])}]*[\])}]|(^|[^0-9])(?:19|20)[0-9]{2}($|[^0-9])"


def active_folders(folders: DataFrame, results: DataFrame) -> DataFrame:
    """Held folders that a live transfer is filling: names equal but for brackets, years and signs."""
    key = lambda x: T.wish_key(F.regexp_replace(x, _NOTES, " "))
    live = flat_transfers(results).where(_live_state(c("state"))).select("directory").distinct().select(key(T.base_name(c("directory"))).alias("k")).where("k <> ''")
    return folders.select("folder_name", key(c("folder_name")).alias("k")).join(live, "k", "left_semi").select("folder_name")


q("active_folders", lambda s, d: active_folders(table(s, d, "held_folders"), _r(s, d)), f"""WITH live AS (SELECT DISTINCT {sql_wish_key("regexp_replace(" + T.sql_base_name("directory") + f", '{_NOTES}', ' ', 'g')")} AS k FROM (SELECT DISTINCT directory FROM {_FLAT} WHERE {_SLV}))
 SELECT folder_name FROM held_folders WHERE {sql_wish_key(f"regexp_replace(folder_name, '{_NOTES}', ' ', 'g')")} IN (SELECT k FROM live WHERE k <> '')""")

# ---- state tables -----------------------------------------------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows by key, the new one in place of the old; columns of ``keep`` stay as first written.

    One aggregation over the union: of several new rows the last in
    ``updated_at`` counts.
    """
    names = [n for n in old.columns if n != key]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last, first = F.max(F.struct("_new", "updated_at", F.struct(*names).alias("r"))), F.min(F.struct("_new", "updated_at", F.struct(*names).alias("r")))
    g = both.groupBy(key).agg(last["r"].alias("l"), first["r"].alias("f"))
    return g.select(key, *[c(f"f.{n}" if n in keep else f"l.{n}").alias(n) for n in names])


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows, and the new ones whose key is not there."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti").select(*old.columns))


def pruned(state: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """State of the keys that still exist."""
    return state.join(keep.select(key), key, "left_semi")


_h = lambda s, d: table(s, d, "held_folders")
_f = lambda s, d: table(s, d, "fill_attempts")
_new = lambda s, d: _f(s, d).select("folder_name", F.lit(NOW).alias("first_seen"), F.lit("fill").alias("reason"), c("queued_files").alias("files_present"), "updated_at")
q("upsert_held", lambda s, d: upsert(_h(s, d), _new(s, d), "folder_name", ("first_seen",)), f"SELECT coalesce(f.folder_name, h.folder_name) AS folder_name, coalesce(h.first_seen, {NOW}) AS first_seen, CASE WHEN f.folder_name IS NOT NULL THEN 'fill' ELSE h.reason END AS reason, CASE WHEN f.folder_name IS NOT NULL THEN f.queued_files ELSE h.files_present END AS files_present, CASE WHEN f.folder_name IS NOT NULL THEN f.updated_at ELSE h.updated_at END AS updated_at FROM held_folders h FULL JOIN fill_attempts f USING (folder_name)")
q("insert_ignore", lambda s, d: insert_absent(_h(s, d), _new(s, d), "folder_name").select("folder_name", "reason"), "SELECT folder_name, reason FROM held_folders UNION ALL SELECT folder_name, 'fill' FROM fill_attempts WHERE folder_name NOT IN (SELECT folder_name FROM held_folders)")
q("prune_state", lambda s, d: pruned(_f(s, d), _h(s, d), "folder_name").select("folder_name"), "SELECT folder_name FROM fill_attempts WHERE folder_name IN (SELECT folder_name FROM held_folders)")
q("delete_by_key", lambda s, d: _h(s, d).join(_f(s, d).select("folder_name"), "folder_name", "left_anti").select("folder_name"), "SELECT folder_name FROM held_folders WHERE folder_name NOT IN (SELECT folder_name FROM fill_attempts)")
q("retention", lambda s, d: once(_l(s, d)).where(c("state").isin(*LIVE) | c("terminal_at").isNull() | (c("terminal_at") >= NOW - 200 * DAY)).select("id"), f"SELECT id FROM {_ONCE} WHERE state IN {_SLIVE} OR terminal_at IS NULL OR terminal_at >= {NOW} - 200 * 86400.0")
q("state_read_json", lambda s, d: _f(s, d).select("folder_name", F.explode(F.from_json("queued_tracks", "array<int>")).alias("track")), "SELECT folder_name, unnest(CAST(queued_tracks AS INT[])) AS track FROM fill_attempts")
q("held_report", lambda s, d: _h(s, d).select("folder_name", F.floor((F.lit(NOW) - c("first_seen")) / 3600).alias("hours")).orderBy(F.desc("hours"), "folder_name"), f"SELECT folder_name, CAST(floor(({NOW} - first_seen) / 3600) AS BIGINT) AS hours FROM held_folders")
q("parks_report", lambda s, d: _h(s, d).join(_f(s, d).select("folder_name", c("source_fmt").alias("plan")), "folder_name", "left").select("folder_name", F.coalesce("plan", F.lit("")).alias("plan"), "files_present", F.row_number().over(Window.partitionBy(F.coalesce("reason", F.lit(""))).orderBy("first_seen", "folder_name")).alias("place")), "SELECT h.folder_name, coalesce(f.source_fmt, '') AS plan, files_present, row_number() OVER (PARTITION BY coalesce(reason, '') ORDER BY first_seen, h.folder_name) AS place FROM held_folders h LEFT JOIN fill_attempts f USING (folder_name)")


def cache_lookup(asked: DataFrame, cache: DataFrame, now: float, days: int) -> DataFrame:
    """miss, stale, negative or hit of each asked pair of keys."""
    j = asked.join(cache.select("artist_key", "album_key", "canonical_mbid", "queried_at"), ["artist_key", "album_key"], "left")
    return j.withColumn("outcome", F.when(c("queried_at").isNull(), "miss").when(c("queried_at") < now - days * DAY, "stale").when(c("canonical_mbid").isNull(), "negative").otherwise("hit"))


_asked = lambda s, d: once(_l(s, d)).select("id", T.query_key(c("artist")).alias("artist_key"), T.query_key(c("album")).alias("album_key"))
q("cache_lookup", lambda s, d: cache_lookup(_asked(s, d), table(s, d, "mb_canonical_cache"), NOW, 300).select("id", "outcome", "canonical_mbid"), f"SELECT l.id, CASE WHEN m.queried_at IS NULL THEN 'miss' WHEN m.queried_at < {NOW} - 300 * 86400.0 THEN 'stale' WHEN canonical_mbid IS NULL THEN 'negative' ELSE 'hit' END AS outcome, canonical_mbid FROM {_ONCE} l LEFT JOIN mb_canonical_cache m ON m.artist_key = {T.sql_query_key('l.artist')} AND m.album_key = {T.sql_query_key('l.album')}")


def best_release(cache: DataFrame, least: int) -> DataFrame:
    """Best answer of each artist key with a score of ``least`` or more; the earlier on a tie."""
    good = cache.where((c("canonical_score") >= least) & (c("canonical_artist") != "") & (c("canonical_title") != ""))
    return good.groupBy("artist_key").agg(F.max(F.struct("canonical_score", (-c("queried_at")).alias("q"), "album_key", "canonical_mbid")).alias("m")).select("artist_key", c("m.canonical_mbid").alias("mbid"), c("m.canonical_score").alias("score"))


q("canonical_release", lambda s, d: best_release(table(s, d, "mb_canonical_cache"), 80), "SELECT artist_key, canonical_mbid AS mbid, canonical_score AS score FROM (SELECT *, row_number() OVER (PARTITION BY artist_key ORDER BY canonical_score DESC, queried_at, album_key DESC, canonical_mbid DESC) AS k FROM mb_canonical_cache WHERE canonical_score >= 80 AND canonical_artist <> '' AND canonical_title <> '') WHERE k = 1")
_c = lambda s, d: table(s, d, "mb_canonical_cache")
q("mb_track_mode", lambda s, d: _c(s, d).where("canonical_score >= 80").select(c("canonical_mbid").alias("mbid")).distinct().join(table(s, d, "albums").select("id", F.lower(F.trim("mb_albumid")).alias("mbid")), "mbid").join(table(s, d, "items").groupBy(c("album_id").alias("id")).agg(F.count(F.lit(1)).alias("n")), "id").groupBy("mbid", "n").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("f")).groupBy("mbid").agg(F.max(F.struct("k", (-c("f")).alias("f"), "n"))["n"].alias("tracks")), "WITH t AS (SELECT lower(trim(mb_albumid)) AS mbid, a.id, (SELECT count(*) FROM items i WHERE i.album_id = a.id) AS n FROM albums a), v AS (SELECT mbid, n, count(*) AS k, min(id) AS f FROM t WHERE n > 0 AND mbid IN (SELECT canonical_mbid FROM mb_canonical_cache WHERE canonical_score >= 80) GROUP BY ALL) SELECT mbid, n AS tracks FROM (SELECT *, row_number() OVER (PARTITION BY mbid ORDER BY k DESC, f) AS r FROM v) WHERE r = 1")
q("wishlist_pending", lambda s, d: once(_l(s, d)).where(c("terminal_at").isNull()).select("id", "artist", "album").orderBy("queued_at", "id"), f"SELECT id, artist, album FROM {_ONCE} WHERE terminal_at IS NULL")
q("wishlist_add", lambda s, d: once(_l(s, d)).where("terminal_at is not null").join(once(_l(s, d)).where("terminal_at is null").select(F.lower("artist").alias("a"), F.lower("album").alias("b")), (F.lower("artist") == c("a")) & (F.lower("album") == c("b")), "left_anti").groupBy(F.lower("artist").alias("a"), F.lower("album").alias("b")).agg(F.min("id").alias("id")), f"SELECT lower(artist) AS a, lower(album) AS b, min(id) AS id FROM {_ONCE} l WHERE terminal_at IS NOT NULL AND NOT EXISTS (SELECT 1 FROM slskd_ledger p WHERE p.terminal_at IS NULL AND lower(p.artist) = lower(l.artist) AND lower(p.album) = lower(l.album)) GROUP BY ALL")
q("wishlist_update", lambda s, d: upsert(_f(s, d).select("folder_name", "last_queued", "updated_at"), _f(s, d).where("queued_files > 2").select("folder_name", F.lit(NOW).alias("last_queued"), F.lit(NOW).alias("updated_at")), "folder_name"), f"SELECT folder_name, CASE WHEN queued_files > 2 THEN {NOW} ELSE last_queued END AS last_queued, CASE WHEN queued_files > 2 THEN {NOW} ELSE updated_at END AS updated_at FROM fill_attempts")

# ---- outbox over the event stream -------------------------------------------------------------------------------


def outbox(events: DataFrame) -> DataFrame:
    """Events as notifications; those of one type are delivered."""
    return events.select(c("event_id").alias("id"), c("event_type").alias("event"), c("props").alias("payload"), F.unix_micros(F.to_timestamp("ts")).alias("created_us"), (c("event_type") == "signup").alias("delivered"), c("user_id").alias("folder"))


def batched(box: DataFrame, least: int) -> DataFrame:
    """Undelivered notifications: one batch for an event of a folder with ``least`` or more, the others single."""
    open_ = box.where(~c("delivered")).select("id", "event", "folder")
    n = open_.groupBy("event", "folder").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    few = n.where(c("n") < least).select(c("event").alias("e"), c("folder").alias("f"))
    single = open_.join(few, c("event").eqNullSafe(c("e")) & c("folder").eqNullSafe(c("f")), "left_semi")
    return single.select("event", "folder", F.lit(1).cast("bigint").alias("n"), c("id").alias("first_id")).unionByName(n.where(c("n") >= least))


_e = lambda s, d: table(s, d, "events")
q("notify_batches", lambda s, d: batched(outbox(_e(s, d)), 3), "WITH o AS (SELECT event_type AS event, user_id AS folder, event_id AS id FROM events WHERE event_type <> 'signup'), g AS (SELECT event, folder, count(*) AS n, min(id) AS first_id FROM o GROUP BY ALL) SELECT event, folder, n, first_id FROM g WHERE n >= 3 UNION ALL SELECT o.event, o.folder, 1, id FROM o JOIN g ON o.event = g.event AND o.folder = g.folder WHERE g.n < 3")
q("mark_delivered", lambda s, d: outbox(_e(s, d)).select("id", (c("delivered") | (c("created_us") < 1704672000000000)).alias("delivered")), "SELECT event_id AS id, (event_type = 'signup' OR ts < TIMESTAMP '2024-01-08 00:00:00') AS delivered FROM events")
q("digest_events_by_type", lambda s, d: _e(s, d).where(c("ts") >= F.lit("2024-01-24 00:00:00").cast("timestamp_ntz")).groupBy(c("event_type").alias("event")).agg(F.count(F.lit(1)).alias("n")), "SELECT event_type AS event, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY event_type")
q("render_message", lambda s, d: _e(s, d).select("event_id", F.substring(F.when(c("event_type") == "error", F.concat(F.lit("failed: "), F.coalesce("props", F.lit("")))).when(c("event_type") == "purchase", F.concat_ws(" ", F.lit("bought by"), c("user_id").cast("string"))).otherwise(F.concat_ws(": ", "event_type", "props")), 1, 3900).alias("text")), "SELECT event_id, substr(CASE WHEN event_type = 'error' THEN 'failed: ' || coalesce(props, '') WHEN event_type = 'purchase' THEN 'bought by ' || user_id ELSE concat_ws(': ', event_type, props) END, 1, 3900) AS text FROM events")


def dead_letters(events: DataFrame, limit: int) -> DataFrame:
    """Failures of a user since the last success, and whether they reach the limit."""
    last = events.where(c("event_type") == "purchase").groupBy("user_id").agg(F.max("ts").alias("ok"))
    n = events.where(c("event_type") == "error").join(last, "user_id", "left").where(c("ok").isNull() | (c("ts") > c("ok"))).groupBy("user_id").agg(F.count(F.lit(1)).alias("fruitless"))
    return n.select("user_id", "fruitless", (c("fruitless") >= limit).alias("retired"))


q("dead_letter", lambda s, d: dead_letters(_e(s, d), 6), "WITH k AS (SELECT user_id, max(ts) AS ok FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT e.user_id, count(*) AS fruitless, count(*) >= 6 AS retired FROM events e LEFT JOIN k USING (user_id) WHERE event_type = 'error' AND (ok IS NULL OR ts > ok) GROUP BY 1")
q("progress_stats", lambda s, d: table(s, d, "albums").join(once(_l(s, d)).groupBy(F.lower("artist").alias("a"), F.lower("album").alias("b")).agg(F.max_by("state", "id").alias("state")), (F.lower("albumartist") == c("a")) & (F.lower("album") == c("b")), "left").groupBy(F.coalesce("state", F.lit("pending")).alias("status")).agg(F.count(F.lit(1)).alias("n")), f"WITH l AS (SELECT lower(artist) AS a, lower(album) AS b, arg_max(state, id) AS state FROM {_ONCE} WHERE state IS NOT NULL GROUP BY ALL) SELECT coalesce(state, 'pending') AS status, count(*) AS n FROM albums LEFT JOIN l ON lower(albumartist) = a AND lower(album) = b GROUP BY 1")

# ---- reports ----------------------------------------------------------------------------------------------------
_MARK = 1_740_000_000.0


def new_albums(items: DataFrame, mark: float, limit: int = 30) -> DataFrame:
    """The latest groups of credit and title with their new tracks: a top-k report."""
    g = items.where(c("added") > mark).groupBy("artist", "album").agg(F.count(F.lit(1)).alias("n"), F.max("added").alias("latest"))
    return g.orderBy(F.desc("latest"), "artist", "album").limit(limit)


q("digest_new_albums", lambda s, d: new_albums(table(s, d, "items"), _MARK).select("artist", "album", "n"), f"SELECT artist, album, n FROM (SELECT artist, album, count(*) AS n, max(added) AS latest FROM items WHERE added > {_MARK} GROUP BY ALL ORDER BY latest DESC, artist NULLS FIRST, album NULLS FIRST LIMIT 30)")
q("digest_new_tracks", lambda s, d: new_albums(table(s, d, "items"), _MARK).agg(F.sum("n").alias("tracks")), f"SELECT CAST(sum(n) AS BIGINT) AS tracks FROM (SELECT count(*) AS n, max(added) AS latest, artist, album FROM items WHERE added > {_MARK} GROUP BY artist, album ORDER BY latest DESC, artist NULLS FIRST, album NULLS FIRST LIMIT 30)")
q("digest_topk", lambda s, d: _h(s, d).withColumn("k", F.row_number().over(Window.partitionBy(F.coalesce("reason", F.lit(""))).orderBy(F.desc("files_present"), "folder_name"))).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy(F.coalesce("reason", F.lit(""))))).where("k <= 5").select(F.coalesce("reason", F.lit("")).alias("reason"), "folder_name", "k", F.greatest(c("of") - 5, F.lit(0)).alias("more")), "SELECT coalesce(reason, '') AS reason, folder_name, k, greatest(n - 5, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(reason, '') ORDER BY files_present DESC, folder_name) AS k, count(*) OVER (PARTITION BY coalesce(reason, '')) AS n FROM held_folders) WHERE k <= 5")


def level(x: Column, warn: float, fail: float) -> Column:
    return F.when(x > fail, "FAIL").when(x > warn, "WARN").otherwise("OK")


q("health_levels", lambda s, d: _h(s, d).agg(F.sum(((F.lit(NOW) - c("updated_at")) > 72 * 3600).cast("int")).alias("old"), F.count(F.lit(1)).alias("n")).select("n", "old", level(c("n"), 20, 30).alias("count_level"), level(c("old"), 24, 72).alias("age_level")), f"SELECT count(*) AS n, count(*) FILTER ({NOW} - updated_at > 259200) AS old, CASE WHEN count(*) > 30 THEN 'FAIL' WHEN count(*) > 20 THEN 'WARN' ELSE 'OK' END AS count_level, CASE WHEN count(*) FILTER ({NOW} - updated_at > 259200) > 72 THEN 'FAIL' WHEN count(*) FILTER ({NOW} - updated_at > 259200) > 24 THEN 'WARN' ELSE 'OK' END AS age_level FROM held_folders")
q("settled_folders", lambda s, d: table(s, d, "items").groupBy("album_id").agg(F.max("added").alias("newest")).where(c("newest") <= _MARK).select("album_id"), f"SELECT album_id FROM items GROUP BY album_id HAVING max(added) <= {_MARK}")
q("empty_dirs", lambda s, d: _r(s, d).where((F.size("files") == 0) & ~T.base_name(c("directory")).rlike(r"^[_.]")).select(_key(c("directory")).alias("dir")).distinct().join(busy(_r(s, d), _l(s, d)), "dir", "left_anti"), f"SELECT DISTINCT {_skey('directory')} AS dir FROM folder_results WHERE len(files) = 0 AND NOT regexp_matches({T.sql_base_name('directory')}, '^[_.]') AND {_skey('directory')} NOT IN (SELECT dir FROM ({SQL['busy_dirs']}) AS b)")
q("candidate_dirs", lambda s, d: _h(s, d).where(~c("folder_name").rlike(r"^[_.]")).join(_f(s, d).select(F.lower("folder_name").alias("skip")), F.lower("folder_name") == c("skip"), "left_anti").select("folder_name").orderBy("folder_name"), "SELECT folder_name FROM held_folders WHERE NOT regexp_matches(folder_name, '^[_.]') AND lower(folder_name) NOT IN (SELECT lower(folder_name) FROM fill_attempts)")
q("folder_stats", lambda s, d: table(s, d, "items").groupBy("album_id").agg(F.max("added").alias("newest"), F.count_if(F.lower("format").isin("flac", "mp3", "m4a", "ogg")).alias("audio")), "SELECT album_id, max(added) AS newest, count(*) FILTER (lower(format) IN ('flac', 'mp3', 'm4a', 'ogg')) AS audio FROM items GROUP BY album_id")
q("log_error_count", lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", F.slice(F.split("text", "\n"), F.greatest(F.lit(1), F.size(F.split("text", "\n")) - 199), F.lit(200)).alias("tail")).select("doc_id", F.size(F.filter("tail", lambda x: x.rlike("ERROR|Traceback"))).alias("n")).where("n > 0"), "SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10))[greatest(1, len(string_split(text, chr(10))) - 199):], lambda x: regexp_matches(x, 'ERROR|Traceback'))) AS INT) AS n FROM documents WHERE text IS NOT NULL AND len(list_filter(string_split(text, chr(10))[greatest(1, len(string_split(text, chr(10))) - 199):], lambda x: regexp_matches(x, 'ERROR|Traceback'))) > 0")


def carried(documents: DataFrame) -> DataFrame:
    """Each list line with the heading line above it: the heading is carried forward within a text."""
    lines = documents.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(~c("line").rlike(r"^\s*[*-] ") & (F.trim("line") != ""), F.trim("line"))
    return lines.withColumn("head", F.last(head, ignorenulls=True).over(w)).where(c("line").rlike(r"^\s*[*-] ")).select("doc_id", "pos", "head")


q("header_carry_forward", lambda s, d: carried(table(s, d, "documents")), r"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
 h AS (SELECT *, last_value(CASE WHEN NOT regexp_matches(line, '^\s*[*-] ') AND trim(line, ' ') <> '' THEN trim(line, ' ') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head FROM l) SELECT doc_id, CAST(pos AS INT) AS pos, head FROM h WHERE regexp_matches(line, '^\s*[*-] ')""")
q("dedup_keep_first", lambda s, d: once(_l(s, d)).groupBy(F.lower("artist").alias("a"), F.lower("album").alias("b")).agg(F.min("id").alias("id")), f"SELECT lower(artist) AS a, lower(album) AS b, min(id) AS id FROM {_ONCE} GROUP BY ALL")
q("needs_match", lambda s, d: table(s, d, "documents").where(c("album_id").isNull() & (F.length(F.trim(F.coalesce("text", F.lit("")))) < 80)).select("doc_id"), "SELECT doc_id FROM documents WHERE album_id IS NULL AND length(trim(coalesce(text, ''))) < 80")
q("match_counters", lambda s, d: cache_lookup(_asked(s, d), _c(s, d), NOW, 300).groupBy("outcome").agg(F.count(F.lit(1)).alias("n")), f"SELECT outcome, count(*) AS n FROM ({SQL['cache_lookup']}) AS x GROUP BY outcome")
q("poll_backoff", lambda s, d: once(_l(s, d)).select("id", F.least(F.lit(60.0), F.pow(F.lit(2.0), c("attempt"))).alias("wait_s")), f"SELECT id, least(60.0, pow(2.0, attempt)) AS wait_s FROM {_ONCE}")
q("crash_albums", lambda s, d: table(s, d, "albums").select("id").join(table(s, d, "items").where("bitrate is null or bitrate = 0").select(c("album_id").alias("id")), "id", "left_anti"), "SELECT id FROM albums WHERE id NOT IN (SELECT album_id FROM items WHERE (bitrate IS NULL OR bitrate = 0) AND album_id IS NOT NULL)")
