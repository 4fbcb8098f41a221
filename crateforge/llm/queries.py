"""Queries of the training-data problems, named pN_..., and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crateforge.functions.session import table
from crateforge.llm import duplicates, matching, mojibake, packing, prose, survivors, textform, tokens, variants


def _texts(spark: SparkSession, d: str) -> DataFrame:
    a, f = table(spark, d, "albums"), table(spark, d, "fill_attempts")
    each = a.select(F.lit("albums").alias("tbl"), F.col("id").cast("string").alias("row_key"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("albumartist", "album")])).alias("x"))
    names = f.select(F.lit("fill_attempts").alias("tbl"), F.col("folder_name").alias("row_key"), F.lit("folder_name").alias("field"), F.col("folder_name").alias("text"))
    return each.select("tbl", "row_key", "x.field", "x.text").unionByName(names)


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Every table that holds names or texts of the library."""
    parts = [("albums", "albumartist"), ("albums", "album"), ("fill_attempts", "folder_name"), ("held_folders", "folder_name"), ("mb_canonical_cache", "canonical_artist"), ("mb_canonical_cache", "canonical_title"), ("folder_results", "directory"), ("items", "title"), ("documents", "text")]
    out = None
    for t, c in parts:
        x = table(spark, d, t).select(F.col(c).alias("text"))
        out = x if out is None else out.unionAll(x)
    return out


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Names that never were paths, to learn clean text from."""
    c = table(spark, d, "mb_canonical_cache")
    return table(spark, d, "items").select(F.col("title").alias("text")).unionAll(c.select("canonical_artist")).unionAll(c.select("canonical_title"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a release id and the release they mean, where they spell it otherwise."""
    return variants.found(table(spark, d, "albums"), table(spark, d, "mb_canonical_cache"))


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct spelling with its release and the confidence of the link."""
    return variants.linked(table(spark, d, "albums"), table(spark, d, "mb_canonical_cache"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a folder and a library row of the same release."""
    return matching.found(table(spark, d, "folder_results"), table(spark, d, "albums")).select("folder_id", "album_id")


def p2_matches(spark: SparkSession, d: str) -> DataFrame:
    """The pairs with their confidence."""
    return matching.found(table(spark, d, "folder_results"), table(spark, d, "albums"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Items whose path went through a wrong encoding."""
    return mojibake.judged(table(spark, d, "items"), _names(spark, d)).where("garbled").select("id")


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    """The affected items with the original path, where it can be restored, and the chain that led to it."""
    return mojibake.judged(table(spark, d, "items"), _names(spark, d)).where("garbled").select("id", "original", "chain")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of differently written copies."""
    a = duplicates.album_pairs(table(spark, d, "albums")).select(F.lit("albums").alias("tbl"), "key_a", "key_b")
    return a.unionByName(duplicates.folder_pairs(table(spark, d, "held_folders")).select(F.lit("held_folders").alias("tbl"), "key_a", "key_b"))


def p4_album_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs among albums alone, which SQL can express."""
    return duplicates.album_pairs(table(spark, d, "albums"))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """One record for each group of copies, with their number."""
    return duplicates.collapsed(table(spark, d, "albums"), table(spark, d, "held_folders"))


def _survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "albums"), table(spark, d, "items"), table(spark, d, "album_attributes"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Release id and surviving row."""
    return _survivors(spark, d).select("mb_albumid", "keep_id")


def p5_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record with the best value of each field."""
    return _survivors(spark, d)


def p5_members(spark: SparkSession, d: str) -> DataFrame:
    """The ids of each group."""
    return survivors.member_ids(table(spark, d, "albums"), table(spark, d, "items")).select("mb_albumid", "part", F.concat_ws(",", F.transform("album_ids", lambda x: x.cast("string"))).alias("album_ids"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a text that is not in the consistent form."""
    c = textform.consistent(_texts(spark, d), _vocabulary(spark, d))
    return c.where("changed").select("tbl", "row_key").distinct()


def p6_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every text in its consistent form."""
    return textform.consistent(_texts(spark, d), _vocabulary(spark, d)).select("tbl", "row_key", "field", "form", "changed")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.token_ids(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Texts restored from their ids: the round trip over the whole corpus."""
    return tokens.decoded(tokens.token_ids(table(spark, d, "documents")))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of each text or piece."""
    return packing.containers(tokens.token_counts(table(spark, d, "documents")))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Fill of each container."""
    return p8_containers(spark, d).groupBy("container").agg(F.sum("size").alias("fill"), F.count(F.lit(1)).alias("texts"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are for the greater part not running prose."""
    return prose.judged(table(spark, d, "documents"), table(spark, d, "common_words")).where(~F.col("is_prose")).select("doc_id")


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of every document."""
    return prose.document_statistics(table(spark, d, "documents"), table(spark, d, "common_words"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name and callable of every query."""
    return {f.__name__: f for f in (p1_found, p1_links, p2_found, p2_matches, p3_found, p3_paths, p4_found, p4_album_pairs, p4_records, p5_found, p5_survivors, p5_members, p6_found, p6_texts, p7_ids, p7_decoded, p8_containers, p8_fill, p9_found, p9_statistics)}


_USABLE = """CASE WHEN regexp_full_match(lower(regexp_replace(mb_albumid, '^\\s+|\\s+$', '', 'g')), '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}')
  AND length(replace(replace(lower(trim(mb_albumid)), '-', ''), substr(lower(trim(mb_albumid)), 1, 1), '')) > 0
  THEN lower(regexp_replace(mb_albumid, '^\\s+|\\s+$', '', 'g')) END"""


def _squeezed(x: str) -> str:
    """Letters and numbers of a field in one letter case; a field of signs alone is its own value."""
    low = f"replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ')"
    return f"CASE WHEN regexp_matches({x}, '[\\p{{L}}\\p{{N}}]') THEN regexp_replace({low}, '[^\\p{{L}}\\p{{N}}]', '', 'g') ELSE chr(1) || {x} END"


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express."""
    grouped = f"""WITH a AS (SELECT id, albumartist, album, year, mb_releasegroupid, {_USABLE} AS r FROM albums),
 g AS (SELECT * FROM a WHERE r IN (SELECT r FROM a WHERE r IS NOT NULL GROUP BY r HAVING count(*) > 1)),
 t AS (SELECT album_id, count(DISTINCT CASE WHEN track IS NOT NULL THEN struct_pack(d := CASE WHEN coalesce(disc, 0) = 0 THEN 1 ELSE disc END, k := track) END) AS n, max(added) AS latest FROM items GROUP BY album_id)"""
    return {
        "p5_found": grouped + """,
 x AS (SELECT r, id, row_number() OVER (PARTITION BY r ORDER BY coalesce(n, 0) DESC,
   (CASE WHEN trim(albumartist) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(album) <> '' THEN 1 ELSE 0 END + CASE WHEN year <> 0 THEN 1 ELSE 0 END + CASE WHEN trim(mb_releasegroupid) <> '' THEN 1 ELSE 0 END) DESC,
   latest DESC NULLS LAST, id) AS k FROM g LEFT JOIN t ON t.album_id = g.id)
 SELECT r AS mb_albumid, id AS keep_id FROM x WHERE k = 1""",
        "p4_album_pairs": f"""WITH k AS (SELECT CAST(id AS VARCHAR) AS id, albumartist AS a, album AS b, {_squeezed("albumartist")} AS x, {_squeezed("album")} AS y FROM albums WHERE trim(albumartist, ' ') <> '' AND trim(album, ' ') <> '')
 SELECT p.id AS key_a, q.id AS key_b FROM k p JOIN k q ON ((p.x = q.x AND p.y = q.y) OR (p.x = q.y AND p.y = q.x)) AND p.id < q.id AND (p.a <> q.a OR p.b <> q.b)""",
        # groups of up to survivors.IDS_PER_ROW rows, as all of the test data are
        "p5_members": f"""WITH a AS (SELECT id, {_USABLE} AS r FROM albums) SELECT r AS mb_albumid, 0 AS part, array_to_string(list_sort(list(id)), ',') AS album_ids FROM a WHERE r IS NOT NULL GROUP BY r HAVING count(*) > 1""",
        "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
