"""State that runs keep between each other: attributes, journal, progress, staged deletions, snapshots; and what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crateforge.functions import text as T
from crateforge.functions.session import table
from crateforge.operators import library
from crateforge.operators.ledger import _ONCE, once

QUERIES, SQL = {}, {}
c = F.col


def q(name, fn, sql):
    QUERIES[name], SQL[name] = fn, sql


def attributes_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """entity_id, key, value: one row for each entity and key, the new value in place of the old; one aggregation."""
    both = old.select("entity_id", "key", F.lit(0).alias("n"), "value").unionByName(new.select("entity_id", "key", F.lit(1).alias("n"), "value"))
    return both.groupBy("entity_id", "key").agg(F.max(F.struct("n", "value"))["value"].alias("value"))


def _identity_attributes(albums: DataFrame) -> DataFrame:
    """Attributes derived anew from the rows as they are: their content key, and their shelf by it."""
    k = T.content_hash(c("albumartist"), c("album"))
    return albums.select(c("id").alias("entity_id"), F.explode(F.create_map(F.lit("identity_key"), k, F.lit("shelf"), F.substring(k, 4, 2))).alias("key", "value"))


_KEY = T.sql_content_hash("albumartist", "album")
q("attributes_upsert", lambda s, d: attributes_upsert(table(s, d, "album_attributes"), _identity_attributes(table(s, d, "albums"))), f"""WITH n AS (SELECT id AS entity_id, 'identity_key' AS key, {_KEY} AS value FROM albums UNION ALL SELECT id, 'shelf', substr({_KEY}, 4, 2) FROM albums),
 o AS (SELECT entity_id, key, max(value) AS value FROM album_attributes GROUP BY ALL) SELECT coalesce(n.entity_id, o.entity_id) AS entity_id, coalesce(n.key, o.key) AS key, CASE WHEN n.entity_id IS NOT NULL THEN n.value ELSE o.value END AS value FROM n FULL JOIN o ON o.entity_id = n.entity_id AND o.key = n.key""")


def journal_open(journal: DataFrame) -> DataFrame:
    """op, since of the operations that a crash left between PENDING and DONE; ``journal``: op, state, at."""
    g = journal.groupBy("op").agg(F.max(F.when(c("state") == "PENDING", c("at"))).alias("since"), F.max(F.when(c("state") == "DONE", c("at"))).alias("done"))
    return g.where(c("since").isNotNull() & (c("done").isNull() | (c("done") < c("since")))).select("op", "since")


def _journal(ledger: DataFrame) -> DataFrame:
    began = ledger.select(c("identity_key").alias("op"), F.lit("PENDING").alias("state"), c("queued_at").alias("at"))
    return began.unionByName(ledger.where("terminal_at is not null").select(c("identity_key").alias("op"), F.lit("DONE").alias("state"), c("terminal_at").alias("at")))


q("journal_open", lambda s, d: journal_open(_journal(once(table(s, d, "slskd_ledger")))), f"SELECT identity_key AS op, max(queued_at) AS since FROM {_ONCE} GROUP BY identity_key HAVING max(queued_at) IS NOT NULL AND (max(terminal_at) IS NULL OR max(terminal_at) < max(queued_at))")


def remaining(work: DataFrame, progress: DataFrame) -> DataFrame:
    """Work that a resumed run still has to do: nothing recorded for its key, or only an error or a wait; ``progress``: key, status."""
    done = progress.where(~c("status").isin("error", "pending")).select("key")
    return work.join(done, "key", "left_anti")


_pkey = lambda a, b: F.concat(F.lower(a), F.lit("|||"), F.lower(b))
_status = lambda: F.when(c("state") == "failed", "error").when(c("state") == "queued", "pending").otherwise(c("state"))
q("progress_resume", lambda s, d: remaining(table(s, d, "albums").select("id", _pkey(c("albumartist"), c("album")).alias("key")), table(s, d, "slskd_ledger").select(_pkey(c("artist"), c("album")).alias("key"), _status().alias("status"))).select("id"), "SELECT id FROM albums a WHERE NOT EXISTS (SELECT 1 FROM slskd_ledger l WHERE lower(l.artist) || '|||' || lower(l.album) = lower(a.albumartist) || '|||' || lower(a.album) AND l.state NOT IN ('failed', 'queued'))")


def staged_deletions(items: DataFrame, confirmed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items to delete now, items that wait): staged ``items`` by ``incoming`` are deleted only once their import is ``confirmed``."""
    return items.join(confirmed.select("incoming"), "incoming", "left_semi"), items.join(confirmed.select("incoming"), "incoming", "left_anti")


def newest(snapshots: DataFrame, key: str, order: str, tie: str, n: int) -> DataFrame:
    """The newest ``n`` snapshots of each kind; what is not here may be deleted."""
    return snapshots.withColumn("place", F.row_number().over(Window.partitionBy(F.coalesce(key, F.lit(""))).orderBy(F.desc(order), tie))).where(c("place") <= n)


q("keep_newest", lambda s, d: newest(table(s, d, "fill_attempts"), "source_user", "updated_at", "folder_name", 3).select("folder_name", "place"), "SELECT folder_name, place FROM (SELECT folder_name, row_number() OVER (PARTITION BY coalesce(source_user, '') ORDER BY updated_at DESC, folder_name) AS place FROM fill_attempts) WHERE place <= 3")
q("expired_files", lambda s, d: table(s, d, "items").where(c("added") < 1_720_000_000).groupBy("album_id").agg(F.count(F.lit(1)).alias("files"), F.max("added").alias("newest")), "SELECT album_id, count(*) AS files, max(added) AS newest FROM items WHERE added < 1720000000 GROUP BY album_id")


def missing_report(known: DataFrame, albums: DataFrame) -> DataFrame:
    """Releases that the metadata source knows and the library has under no spelling of equal normal form, once each."""
    have = albums.select(T.content_hash(c("albumartist"), c("album")).alias("k"))
    want = known.where("canonical_mbid is not null").select("canonical_mbid", T.content_hash(c("canonical_artist"), c("canonical_title")).alias("k")).distinct()
    return want.join(have, "k", "left_anti").select("canonical_mbid", "k")


q("missing_report", lambda s, d: missing_report(table(s, d, "mb_canonical_cache"), table(s, d, "albums")), f"SELECT DISTINCT canonical_mbid, {T.sql_content_hash('canonical_artist', 'canonical_title')} AS k FROM mb_canonical_cache WHERE canonical_mbid IS NOT NULL AND {T.sql_content_hash('canonical_artist', 'canonical_title')} NOT IN (SELECT {_KEY} FROM albums)")
q("total_files", lambda s, d: table(s, d, "folder_results").agg(F.sum("file_count").alias("files"), F.sum(F.size("files")).alias("listed")), "SELECT CAST(sum(file_count) AS BIGINT) AS files, CAST(sum(len(files)) AS BIGINT) AS listed FROM folder_results")
q("data_version", lambda s, d: table(s, d, "items").agg(F.count(F.lit(1)).alias("rows"), F.max("id").alias("last_id"), F.max("added").alias("last_added")), "SELECT count(*) AS rows, max(id) AS last_id, max(added) AS last_added FROM items")
q("album_items", lambda s, d: table(s, d, "items").where(c("album_id").isNotNull()).select("album_id", "id", F.hex("path").alias("path"), F.coalesce("disc", F.lit(0)).alias("disc"), F.coalesce("track", F.lit(0)).alias("track")), "SELECT album_id, id, hex(path) AS path, coalesce(disc, 0) AS disc, coalesce(track, 0) AS track FROM items WHERE album_id IS NOT NULL")


def graveyard_actions(plan: DataFrame, items: DataFrame) -> DataFrame:
    """Files of the rows that a duplicate plan drops, as rows of what is to be done; nothing is moved here."""
    drop = plan.where(c("verdict") == "DROP").select(c("id").alias("album_id"))
    return items.join(drop, "album_id", "left_semi").select("id", F.lit("move").alias("action"), F.hex("path").alias("path"))


q("graveyard_actions", lambda s, d: graveyard_actions(library.duplicate_plan(table(s, d, "albums"), table(s, d, "items")), table(s, d, "items")), "SELECT id, 'move' AS action, hex(path) AS path FROM items WHERE album_id IN (SELECT id FROM (" + library.SQL["dup_plan_verify"] + ") AS p WHERE verdict = 'DROP')")


def collected_folders(directories: DataFrame, descend: str, skip: str) -> DataFrame:
    """The folders one level below a root, of ``descend`` those one level deeper, of ``skip`` none; column ``directory``, either slash."""
    parts = F.filter(F.split(c("directory"), r"[/\\]+"), lambda x: x != "")
    at = F.when(parts[0] == descend, 2).otherwise(1)
    return directories.select(parts.alias("p"), at.alias("at")).where((F.size("p") >= c("at")) & (c("p")[0] != skip)).select(F.array_join(F.slice("p", F.lit(1), c("at")), "/").alias("folder")).distinct()


q("collect_folders", lambda s, d: collected_folders(table(s, d, "folder_results"), "downloads", "Backup"), r"WITH x AS (SELECT list_filter(string_split_regex(directory, '[/\\]+'), lambda x: x <> '') AS p FROM folder_results), y AS (SELECT p, CASE WHEN p[1] = 'downloads' THEN 2 ELSE 1 END AS n FROM x) SELECT DISTINCT array_to_string(p[1:n], '/') AS folder FROM y WHERE len(p) >= n AND p[1] <> 'Backup'")
