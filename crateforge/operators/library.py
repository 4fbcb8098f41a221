"""The library itself: scans, quality of copies, completeness, duplicates of slots, agreement with what is on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crateforge.functions import text as T
from crateforge.functions.session import table
from crateforge.operators.text_queries import RANK, SQL_QUALITY, canon, canon_title, missing_tracks, present_count, quality_score, sql_canon, sql_canon_title

QUERIES, SQL = {}, {}
c = F.col
# Formats without loss.
LOSSLESS = ("flac", "alac", "wav", "aiff", "ape", "wv")


def _lossless() -> Column:
    return F.lower("format").isin(*LOSSLESS)


_SLL = "lower(format) IN (" + ", ".join(f"'{x}'" for x in LOSSLESS) + ")"


def q(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


def _a(s, d):
    return table(s, d, "albums")


def _i(s, d):
    return table(s, d, "items")


def scan_library(albums: DataFrame, items: DataFrame) -> DataFrame:
    """Every album with the number of its items, discs and titled tracks; albums without items stay."""
    n = items.groupBy("album_id").agg(F.count(F.lit(1)).alias("n_items"), F.count_distinct(F.coalesce("disc", F.lit(0))).alias("n_discs"), F.sum((F.trim("title") != "").cast("int")).alias("n_titled"))
    zero = lambda k: F.coalesce(k, F.lit(0)).cast("bigint").alias(k)
    return albums.join(n, c("id") == c("album_id"), "left").select("id", "albumartist", "album", zero("n_items"), zero("n_discs"), zero("n_titled"))


q("scan_library", lambda s, d: scan_library(_a(s, d), _i(s, d)), "SELECT a.id, a.albumartist, a.album, count(i.id) AS n_items, count(DISTINCT CASE WHEN i.id IS NOT NULL THEN coalesce(disc, 0) END) AS n_discs, CAST(coalesce(sum(CASE WHEN trim(title) <> '' THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_titled FROM albums a LEFT JOIN items i ON i.album_id = a.id GROUP BY a.id, a.albumartist, a.album")
q("lookup_album", lambda s, d: _a(s, d).join(table(s, d, "documents").select(c("album_id").alias("id")).where("id is not null").distinct(), "id", "left_semi"), "SELECT * FROM albums WHERE id IN (SELECT album_id FROM documents)")


def albums_since(albums: DataFrame, items: DataFrame, mark: int) -> DataFrame:
    """Distinct credit and title of albums with items above the watermark; the filter reaches the scan."""
    new = items.where(c("id") > mark).select("album_id").distinct()
    return albums.join(new, c("id") == c("album_id"), "left_semi").select("albumartist", "album").distinct()


q("albums_since", lambda s, d: albums_since(_a(s, d), _i(s, d), 5000), "SELECT DISTINCT albumartist, album FROM albums a JOIN (SELECT album_id FROM items WHERE id > 5000) i ON i.album_id = a.id")
q("path_prefix_distinct", lambda s, d: _i(s, d).where(F.startswith(F.hex("path"), F.lit("2F7372762F"))).select("album_id").distinct(), "SELECT DISTINCT album_id FROM items WHERE starts_with(hex(path), '2F7372762F')")
q("like_filter", lambda s, d: _i(s, d).join(_a(s, d).select(c("id").alias("aid"), "albumartist"), c("album_id") == c("aid"), "left").where((F.contains(F.lower("albumartist"), F.lit("fires")) | F.contains(F.lower("artist"), F.lit("fires"))) & F.contains(F.lower("album"), F.lit("songs"))).select("id"), "SELECT i.id FROM items i LEFT JOIN albums a ON a.id = i.album_id WHERE (contains(lower(a.albumartist), 'fires') OR contains(lower(i.artist), 'fires')) AND contains(lower(i.album), 'songs')")
q("library_candidates", lambda s, d: _i(s, d).join(_a(s, d).select(c("id").alias("aid"), "albumartist"), c("album_id") == c("aid"), "left").select("id", F.coalesce("albumartist", "artist").alias("credit"), "album").where(F.contains(F.lower("credit"), F.lower(F.substring(F.lit("The Lemfirtem"), 1, 40)))).distinct(), "SELECT DISTINCT i.id, coalesce(a.albumartist, i.artist) AS credit, i.album FROM items i LEFT JOIN albums a ON a.id = i.album_id WHERE contains(lower(coalesce(a.albumartist, i.artist)), 'the lemfirtem')")


# Endings of file names that promise a format without loss.
LOSSLESS_ENDINGS = ("flac", "alac", "wav", "aiff", "ape", "wv", "tak", "tta")
#: Hex of a path that ends like one of them, in either letter case.
_HEX_END = "2E(?:" + "|".join("".join(f"(?:{ord(ch.upper()):02X}|{ord(ch):02X})" for ch in e) for e in LOSSLESS_ENDINGS) + ")$"


def _probe_facts(items: DataFrame) -> DataFrame:
    """Items with what a probe of the file tells: lossless, ok (a format, and a rate where it is lossless), mislabeled."""
    lossless = F.coalesce(_lossless(), F.lit(False))
    no_rate = F.coalesce("samplerate", F.lit(0)) == 0
    ends = F.coalesce(F.hex("path").rlike(_HEX_END), F.lit(False))
    return items.withColumn("_lossless", lossless).withColumn("_ok", (F.coalesce("format", F.lit("")) != "") & ~(lossless & no_rate)).withColumn("_mislabel", (ends & ~lossless) | (lossless & no_rate))


_PROBE = f"(SELECT *, coalesce({_SLL}, false) AS _lossless, (coalesce(format, '') <> '' AND NOT (coalesce({_SLL}, false) AND coalesce(samplerate, 0) = 0)) AS _ok, ((coalesce(regexp_matches(hex(path), '{_HEX_END}'), false) AND NOT coalesce({_SLL}, false)) OR (coalesce({_SLL}, false) AND coalesce(samplerate, 0) = 0)) AS _mislabel FROM items)"


def quality_of(facts: DataFrame, *keys: str) -> DataFrame:
    """Quality of each group of probed files in one aggregation: all lossless, least depth, rate and bitrate of the valid ones (0 means unknown), failed probes, mislabeled files."""
    known = lambda n: F.min(F.when(c("_ok") & (c(n) > 0), c(n)))
    return facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_files"), F.bool_and("_lossless").alias("lossless_all"), known("bitdepth").alias("min_bitdepth"), known("samplerate").alias("min_samplerate"), known("bitrate").alias("min_bitrate"), F.bool_or(~c("_ok")).alias("any_probe_fail"), F.bool_or("_mislabel").alias("any_mislabel"))


_SQUAL = "count(*) AS n_files, bool_and(_lossless) AS lossless_all, min(CASE WHEN _ok AND bitdepth > 0 THEN bitdepth END) AS min_bitdepth, min(CASE WHEN _ok AND samplerate > 0 THEN samplerate END) AS min_samplerate, min(CASE WHEN _ok AND bitrate > 0 THEN bitrate END) AS min_bitrate, bool_or(NOT _ok) AS any_probe_fail, bool_or(_mislabel) AS any_mislabel"


def album_quality(items: DataFrame) -> DataFrame:
    """Quality of each album and its formats."""
    facts = _probe_facts(items)
    names = facts.where("format <> ''").groupBy("album_id").agg(F.count_distinct(F.lower("format")).alias("n_codecs"), F.array_join(F.sort_array(F.collect_set(F.lower("format"))), ",").alias("codecs"))
    one = quality_of(facts, "album_id")
    j = one.join(names.withColumnRenamed("album_id", "a"), c("album_id").eqNullSafe(c("a")), "left").drop("a")
    return j.withColumn("n_codecs", F.coalesce("n_codecs", F.lit(0))).withColumn("codecs", F.coalesce("codecs", F.lit("")))


_QUAL = f"SELECT album_id, {_SQUAL}, count(DISTINCT lower(format)) FILTER (format <> '') AS n_codecs, coalesce(array_to_string(list_sort(list_distinct(list(lower(format)) FILTER (format <> ''))), ','), '') AS codecs FROM {_PROBE} GROUP BY album_id"
q("album_quality", lambda s, d: album_quality(_i(s, d)), _QUAL)


def slot_best(items: DataFrame) -> DataFrame:
    """Best copy of each disc and track whose copies agree on the title, and how many lost to it."""
    t = items.where(c("track").isNotNull()).withColumn("slot_disc", F.greatest(F.coalesce("disc", F.lit(1)), F.lit(1)))
    keys = ["album_id", "slot_disc", "track"]
    better = F.struct(F.coalesce(_lossless(), F.lit(False)).cast("int").alias("a"), F.coalesce("bitdepth", F.lit(0)).alias("b"), F.coalesce("samplerate", F.lit(0)).alias("c"), F.coalesce("bitrate", F.lit(0)).alias("d"), (-c("id")).alias("e"))
    g = t.groupBy(*keys).agg(F.count_distinct(F.coalesce(T.normalize_track(c("title")), F.lit(""))).alias("titles"), F.count(F.lit(1)).alias("copies"), F.max(better)["e"].alias("e"))
    return g.where("titles = 1").select(*keys, (-c("e")).alias("best_id"), (c("copies") - 1).alias("losers"))


q("slot_best", lambda s, d: slot_best(_i(s, d)), f"""WITH t AS (SELECT *, greatest(coalesce(disc, 1), 1) AS slot_disc FROM items WHERE track IS NOT NULL),
 g AS (SELECT album_id, slot_disc, track, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT {T.sql_normalize_track("title")}) = 1),
 r AS (SELECT *, row_number() OVER (PARTITION BY album_id, slot_disc, track ORDER BY CASE WHEN {_SLL} THEN 0 ELSE 1 END, coalesce(bitdepth, 0) DESC, coalesce(samplerate, 0) DESC, coalesce(bitrate, 0) DESC, id) AS k FROM t)
 SELECT r.album_id, r.slot_disc, r.track, r.id AS best_id, g.n - 1 AS losers FROM r JOIN g ON g.album_id IS NOT DISTINCT FROM r.album_id AND g.slot_disc = r.slot_disc AND g.track = r.track WHERE k = 1""")


def fragments(items: DataFrame) -> DataFrame:
    """Albums that are a piece of a whole: one file, or tracks that are not 1 to k."""
    t = items.groupBy("album_id").agg(F.count(F.lit(1)).alias("n"), F.min("track").alias("lo"), F.max("track").alias("hi"), F.count_distinct("track").alias("k"))
    whole = (c("lo") == 1) & (c("hi") == c("k"))
    return t.select("album_id", ((c("n") == 1) | F.coalesce(~whole, F.lit(False))).alias("fragment"))


q("fragment_flag", lambda s, d: fragments(_i(s, d)), "SELECT album_id, (count(*) = 1 OR coalesce(NOT (min(track) = 1 AND max(track) = count(DISTINCT track)), false)) AS fragment FROM items GROUP BY album_id")


def gaps(items: DataFrame) -> DataFrame:
    """Missing track numbers of single-disc albums with three tracks or more, as an array difference."""
    t = items.where(c("track") > 0).groupBy("album_id").agg(F.collect_set("track").alias("have"), F.max("track").alias("hi"), F.count_distinct(F.greatest(F.coalesce("disc", F.lit(1)), F.lit(1))).alias("discs"))
    t = t.where((F.size("have") >= 3) & (c("discs") == 1))
    lacking = F.sort_array(F.array_except(F.sequence(F.lit(1), c("hi")), "have"))
    return t.select("album_id", c("hi").alias("expected"), F.size("have").alias("present"), F.array_join(lacking.cast("array<string>"), ",").alias("missing"))


q("album_gaps", lambda s, d: gaps(_i(s, d)), "WITH t AS (SELECT album_id, list_distinct(list(track)) AS have, max(track) AS hi FROM items WHERE track > 0 GROUP BY album_id HAVING count(DISTINCT track) >= 3 AND count(DISTINCT greatest(coalesce(disc, 1), 1)) = 1) SELECT album_id, hi AS expected, CAST(len(have) AS INT) AS present, coalesce(array_to_string(list_filter(range(1, hi + 1), lambda k: NOT list_contains(have, k)), ','), '') AS missing FROM t")


def gap_reasons(items: DataFrame) -> DataFrame:
    """The line that reports the gaps of an album, as the pipeline writes it."""
    return gaps(items).select("album_id", F.concat(F.lit("gap-heuristic present="), "present", F.lit("/"), "expected", F.lit(" missing=["), F.replace("missing", F.lit(","), F.lit(", ")), F.lit("]")).alias("reason"))


q("parse_reason", lambda s, d: gap_reasons(_i(s, d)).unionByName(table(s, d, "held_folders").select(F.lit(None).cast("bigint").alias("album_id"), "reason")).select("album_id", F.array_join(missing_tracks(c("reason")).cast("array<string>"), ",").alias("missing"), present_count(c("reason"), 1).alias("present"), present_count(c("reason"), 2).alias("of")), "WITH r AS (SELECT album_id, 'gap-heuristic present=' || present || '/' || expected || ' missing=[' || replace(missing, ',', ', ') || ']' AS reason FROM (" + SQL["album_gaps"] + r""") AS g UNION ALL SELECT NULL, reason FROM held_folders)
 SELECT album_id, coalesce(array_to_string(list_transform(list_filter(list_transform(string_split(regexp_extract(coalesce(reason, ''), 'missing=\[([^\]]+)\]', 1), ','), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: regexp_full_match(x, '[0-9]+')), lambda x: CAST(CAST(x AS INT) AS VARCHAR)), ','), '') AS missing,
  CAST(coalesce(nullif(regexp_extract(coalesce(reason, ''), 'present=([0-9]+)/([0-9]+)', 1), ''), '0') AS INT) AS present, CAST(coalesce(nullif(regexp_extract(coalesce(reason, ''), 'present=([0-9]+)/([0-9]+)', 2), ''), '0') AS INT) AS of FROM r""")


def _tracks(items: DataFrame) -> DataFrame:
    slot = F.struct(F.greatest(F.coalesce("disc", F.lit(1)), F.lit(1)).alias("d"), c("track").alias("t"))
    return items.where(c("track").isNotNull()).groupBy("album_id").agg(F.collect_set(slot).alias("slots"))


def relation(a: Column, b: Column) -> Column:
    """How two track sets relate."""
    ab, ba = F.size(F.array_except(a, b)) == 0, F.size(F.array_except(b, a)) == 0
    return F.when(ab & ba, "equal").when(ab, "subset").when(ba, "superset").when(F.arrays_overlap(a, b), "divergent").otherwise("disjoint")


def family_keys(albums: DataFrame) -> DataFrame:
    """id, key: each row under its release group, if well formed, and under its normalised content."""
    group = F.when(T.valid_id(c("mb_releasegroupid")), F.concat(F.lit("rg:"), F.lower(T.squeeze_space(c("mb_releasegroupid")))))
    return albums.select("id", F.explode(F.array_compact(F.array(group, T.content_hash(c("albumartist"), c("album"))))).alias("key"))


_FKEYS = f"(SELECT id, CASE WHEN {T.sql_valid_id('mb_releasegroupid')} THEN 'rg:' || lower({T.sql_squeeze('mb_releasegroupid')}) END AS key FROM albums WHERE {T.sql_valid_id('mb_releasegroupid')} UNION ALL SELECT id, {T.sql_content_hash('albumartist', 'album')} FROM albums)"


def candidates_and_library(albums: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without a usable release id are judged; those with one are the library they are judged against."""
    own = T.valid_id(c("mb_albumid"))
    return albums.where(~own), albums.where(own)


def _slots(items: DataFrame) -> DataFrame:
    return items.where(c("track").isNotNull()).select(c("album_id").alias("id"), F.greatest(F.coalesce("disc", F.lit(1)), F.lit(1)).alias("d"), c("track").alias("t"))


def trackset_relations(albums: DataFrame, items: DataFrame) -> DataFrame:
    """How the tracks of each candidate relate to those of all library rows of its family together.

    Library tracks are gathered by family key once and counted by candidate and
    track, so no pair of rows is ever formed: a family of any size costs its
    candidates times its distinct tracks.
    """
    cand, lib = candidates_and_library(albums)
    keys = family_keys(cand)
    slots = _slots(items)
    of_key = family_keys(lib).join(slots, "id").select("key", "d", "t").distinct()
    theirs = keys.join(of_key, "key").select("id", "d", "t").distinct()
    has = keys.join(family_keys(lib).select("key").distinct(), "key", "left_semi").select("id").distinct()
    own = slots.join(has, "id", "left_semi").distinct()
    each = own.withColumn("o", F.lit(1)).withColumn("l", F.lit(0)).unionByName(theirs.withColumn("o", F.lit(0)).withColumn("l", F.lit(1))).groupBy("id", "d", "t").agg(F.max("o").alias("o"), F.max("l").alias("l"))
    n = each.groupBy("id").agg(F.sum("o").alias("own"), F.sum("l").alias("lib"), F.sum(c("o") * c("l")).alias("shared"))
    zero = lambda k: F.coalesce(k, F.lit(0)).cast("bigint").alias(k)
    n = has.join(n, "id", "left").select("id", zero("own"), zero("lib"), zero("shared"))
    o, k, m = c("own"), c("lib"), c("shared")
    relation = F.when((m == o) & (m == k), "equal").when(m == k, "superset").when((m == o) & (o > 0), "subset").when(m > 0, "divergent").otherwise("disjoint")
    return n.withColumn("relation", relation)


_CL = f"own AS (SELECT id, {T.sql_valid_id('mb_albumid')} AS m FROM albums), fk AS (SELECT f.id, key, m FROM {_FKEYS} f JOIN own ON own.id = f.id)"
q("trackset_relation", lambda s, d: trackset_relations(_a(s, d), _i(s, d)), f"""WITH {_CL}, t AS (SELECT DISTINCT album_id AS id, greatest(coalesce(disc, 1), 1) AS d, track AS t FROM items WHERE track IS NOT NULL),
 has AS (SELECT DISTINCT id FROM fk WHERE NOT m AND key IN (SELECT key FROM fk WHERE m)), theirs AS (SELECT DISTINCT c.id, t.d, t.t FROM fk c JOIN fk l ON l.key = c.key AND l.m JOIN t ON t.id = l.id WHERE NOT c.m),
 n AS (SELECT id, (SELECT count(*) FROM t WHERE t.id = has.id) AS own, (SELECT count(*) FROM theirs x WHERE x.id = has.id) AS lib, (SELECT count(*) FROM t JOIN theirs x ON x.id = t.id AND x.d = t.d AND x.t = t.t WHERE t.id = has.id) AS shared FROM has)
 SELECT id, own, lib, shared, CASE WHEN shared = own AND shared = lib THEN 'equal' WHEN shared = lib THEN 'superset' WHEN shared = own AND own > 0 THEN 'subset' WHEN shared > 0 THEN 'divergent' ELSE 'disjoint' END AS relation FROM n""")
_QCOLS = ("lossless_all", "min_bitdepth", "min_samplerate", "min_bitrate", "any_probe_fail", "any_mislabel")


def quality_verdicts(albums: DataFrame, items: DataFrame) -> DataFrame:
    """Whether a candidate is better than the library rows of its family, by the ladder of faults, completeness, losslessness, resolution and bitrate.

    A fault of the candidate decides nothing, a fragment or a subset is worse, a
    faulty library gives way; ties favour what is there. Candidates without files
    have no verdict.
    """
    cand, lib = candidates_and_library(albums)
    facts = _probe_facts(items).withColumnRenamed("id", "item").withColumnRenamed("album_id", "id")
    of_key = quality_of(facts.join(family_keys(lib), "id"), "key")
    low = [F.min(n).alias("l_" + n) for n in ("min_bitdepth", "min_samplerate", "min_bitrate")]
    theirs = family_keys(cand).join(of_key, "key").groupBy("id").agg(F.bool_and("lossless_all").alias("l_lossless_all"), F.bool_or("any_probe_fail").alias("l_any_probe_fail"), F.bool_or("any_mislabel").alias("l_any_mislabel"), *low)
    own = quality_of(facts, "id")
    r = trackset_relations(albums, items).join(own, "id").join(fragments(items).withColumnRenamed("album_id", "id"), "id").join(theirs, "id", "left")
    z = lambda n: F.coalesce(c(n), F.lit(0))
    rel = c("relation")
    bad, worn = c("any_probe_fail") | c("any_mislabel"), F.coalesce(c("l_any_probe_fail") | c("l_any_mislabel"), F.lit(False))
    a, b = c("lossless_all"), F.coalesce("l_lossless_all", F.lit(False))
    less = (z("min_bitdepth") < z("l_min_bitdepth")) | (z("min_samplerate") < z("l_min_samplerate"))
    more = (z("min_bitdepth") > z("l_min_bitdepth")) | (z("min_samplerate") > z("l_min_samplerate"))
    gain = z("min_bitrate") - z("l_min_bitrate")
    verdict = (
        F.when(bad, "AMBIGUOUS").when(c("fragment") & (c("lib") > 1), "WORSE").when(rel == "subset", "WORSE").when(rel.isin("divergent", "disjoint"), "AMBIGUOUS").when(worn, "BETTER")
        .when(a & ~b, "BETTER").when(b & ~a, "WORSE").when(a & b & less, "WORSE").when(a & b & more, "BETTER").when(~a & ~b & (gain > 32000) & (c("own") >= c("lib")), "BETTER").when(~a & ~b & (gain < -32000), "WORSE")
        .when(rel == "superset", "BETTER").otherwise("EQUAL")
    )
    return r.select("id", verdict.alias("verdict"))


q("quality_verdict", lambda s, d: quality_verdicts(_a(s, d), _i(s, d)), "WITH rel AS (" + SQL["trackset_relation"] + f"), {_CL}, p AS {_PROBE}, a AS (SELECT album_id AS id, {_SQUAL} FROM p GROUP BY album_id), lp AS (SELECT DISTINCT c.id AS cand, p.* FROM fk c JOIN fk l ON l.key = c.key AND l.m JOIN p ON p.album_id = l.id WHERE NOT c.m), b AS (SELECT cand AS id, {_SQUAL} FROM lp GROUP BY cand), f AS (" + SQL["fragment_flag"] + """),
 x AS (SELECT rel.id, rel.relation, rel.own, rel.lib, fragment, a.any_probe_fail OR a.any_mislabel AS bad, coalesce(b.any_probe_fail OR b.any_mislabel, false) AS worn, a.lossless_all AS al, coalesce(b.lossless_all, false) AS bl,
  coalesce(a.min_bitdepth, 0) AS abd, coalesce(b.min_bitdepth, 0) AS bbd, coalesce(a.min_samplerate, 0) AS asr, coalesce(b.min_samplerate, 0) AS bsr, coalesce(a.min_bitrate, 0) AS abr, coalesce(b.min_bitrate, 0) AS bbr
  FROM rel JOIN a ON a.id = rel.id JOIN f ON f.album_id = rel.id LEFT JOIN b ON b.id = rel.id)
 SELECT id, CASE WHEN bad THEN 'AMBIGUOUS' WHEN fragment AND lib > 1 THEN 'WORSE' WHEN relation = 'subset' THEN 'WORSE' WHEN relation IN ('divergent', 'disjoint') THEN 'AMBIGUOUS' WHEN worn THEN 'BETTER' WHEN al AND NOT bl THEN 'BETTER' WHEN bl AND NOT al THEN 'WORSE'
 WHEN al AND bl AND (abd < bbd OR asr < bsr) THEN 'WORSE' WHEN al AND bl AND (abd > bbd OR asr > bsr) THEN 'BETTER' WHEN NOT al AND NOT bl AND abr - bbr > 32000 AND own >= lib THEN 'BETTER' WHEN NOT al AND NOT bl AND bbr - abr > 32000 THEN 'WORSE' WHEN relation = 'superset' THEN 'BETTER' ELSE 'EQUAL' END AS verdict FROM x""")


def reconcile_plan(albums: DataFrame, items: DataFrame) -> DataFrame:
    """One plan row for each candidate: its content key, whether it lost to another candidate of that key, the size of its library family, its verdict and its tracks."""
    cand, lib = candidates_and_library(albums)
    won = self_dedup(cand, items).select("id", "key", "winner")
    theirs = family_keys(lib).groupBy("key").agg(F.count_distinct("id").alias("n"))
    size = family_keys(cand).join(theirs, "key").groupBy("id").agg(F.max("n").alias("family"))
    n = trackset_relations(albums, items).select("id", c("own").alias("cand_tracks"), c("lib").alias("lib_tracks"), "relation")
    j = won.join(size, "id", "left").join(n, "id", "left").join(quality_verdicts(albums, items), "id", "left")
    return j.select("id", "key", (~c("winner")).alias("duplicate"), F.coalesce("family", F.lit(0)).alias("family"), "cand_tracks", "lib_tracks", "relation", "verdict")


def self_dedup(albums: DataFrame, items: DataFrame) -> DataFrame:
    """Winner of each normalised credit and title: no fragment, lossless, depth, rate, number of tracks, first row."""
    n = albums.select("id", T.content_hash(c("albumartist"), c("album")).alias("key"))
    f = n.join(fragments(items).withColumnRenamed("album_id", "id"), "id").join(album_quality(items).withColumnRenamed("album_id", "id"), "id")
    w = Window.partitionBy("key").orderBy("fragment", F.desc("lossless_all"), F.desc(F.coalesce("min_bitdepth", F.lit(0))), F.desc(F.coalesce("min_samplerate", F.lit(0))), F.desc("n_files"), "id")
    return f.withColumn("r", F.row_number().over(w)).select("id", "key", (c("r") == 1).alias("winner"))


q("self_dedup_winner", lambda s, d: self_dedup(_a(s, d), _i(s, d)), f"WITH n AS (SELECT id, {T.sql_content_hash('albumartist', 'album')} AS key FROM albums), f AS ({SQL['fragment_flag']}), k AS ({_QUAL}) SELECT n.id, key, row_number() OVER (PARTITION BY key ORDER BY fragment, lossless_all DESC, coalesce(min_bitdepth, 0) DESC, coalesce(min_samplerate, 0) DESC, n_files DESC, n.id) = 1 AS winner FROM n JOIN f ON f.album_id = n.id JOIN k ON k.album_id = n.id")


q("reconcile_plan", lambda s, d: reconcile_plan(_a(s, d), _i(s, d)), "WITH rel AS (" + SQL["trackset_relation"] + "), vd AS (" + SQL["quality_verdict"] + f"""), {_CL}, f AS ({SQL["fragment_flag"]}), k AS ({_QUAL}),
 w AS (SELECT a.id, {T.sql_content_hash("albumartist", "album")} AS key, row_number() OVER (PARTITION BY {T.sql_content_hash("albumartist", "album")} ORDER BY fragment, lossless_all DESC, coalesce(min_bitdepth, 0) DESC, coalesce(min_samplerate, 0) DESC, n_files DESC, a.id) > 1 AS duplicate FROM albums a JOIN own ON own.id = a.id AND NOT m JOIN f ON f.album_id = a.id JOIN k ON k.album_id = a.id),
 s AS (SELECT c.id, max(n) AS family FROM fk c JOIN (SELECT key, count(DISTINCT id) AS n FROM fk WHERE m GROUP BY key) l ON l.key = c.key WHERE NOT c.m GROUP BY c.id)
 SELECT w.id, w.key, w.duplicate, coalesce(s.family, 0) AS family, rel.own AS cand_tracks, rel.lib AS lib_tracks, rel.relation, vd.verdict FROM w LEFT JOIN s ON s.id = w.id LEFT JOIN rel ON rel.id = w.id LEFT JOIN vd ON vd.id = w.id""")


def families(albums: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of one content: the one with most items stays, the others are listed."""
    n = items.groupBy(c("album_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    f = albums.select("id", T.content_hash(c("albumartist"), c("album")).alias("key")).join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = F.struct((-c("n")).alias("n"), c("id"))
    return f.groupBy("key").agg(F.min(best)["id"].alias("keep_id"), F.count(F.lit(1)).alias("size")).where("size > 1")


q("dedup_families", lambda s, d: families(_a(s, d), _i(s, d)), f"WITH f AS (SELECT a.id, {T.sql_content_hash('albumartist', 'album')} AS key, (SELECT count(*) FROM items i WHERE i.album_id = a.id) AS n FROM albums a), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, id) AS k, count(*) OVER (PARTITION BY key) AS size FROM f) SELECT key, id AS keep_id, size FROM r WHERE k = 1 AND size > 1")


def duplicate_plan(albums: DataFrame, items: DataFrame) -> DataFrame:
    """For each row beside the kept one of its family: whether its tracks and files allow to drop it, or why not."""
    key = albums.select("id", T.content_hash(c("albumartist"), c("album")).alias("key"))
    fam = families(albums, items)
    t = _tracks(items).withColumnRenamed("album_id", "id")
    p = items.groupBy(c("album_id").alias("id")).agg(F.collect_set("path").alias("paths"))
    both = t.join(p, "id", "full")
    drop = key.join(fam.select("key", "keep_id"), "key").where(c("id") != c("keep_id")).join(both, "id", "left")
    keep = both.select(c("id").alias("keep_id"), c("slots").alias("ks"), c("paths").alias("kp"))
    none = F.array().cast(t.schema["slots"].dataType)
    j = drop.join(keep, "keep_id", "left")
    inside = F.size(F.array_except(F.coalesce("slots", none), F.coalesce("ks", none))) == 0
    apart = ~F.coalesce(F.arrays_overlap("paths", "kp"), F.lit(False))
    return j.select("id", "keep_id", F.when(inside & apart, "DROP").when(~inside & ~apart, "tracks beyond; files shared").when(~inside, "tracks beyond").otherwise("files shared").alias("verdict"))


q("dup_plan_verify", lambda s, d: duplicate_plan(_a(s, d), _i(s, d)), f"""WITH fam AS ({SQL["dedup_families"]}), k AS (SELECT id, {T.sql_content_hash("albumartist", "album")} AS key FROM albums), d AS (SELECT k.id, keep_id FROM k JOIN fam USING (key) WHERE k.id <> keep_id),
 t AS (SELECT DISTINCT album_id, greatest(coalesce(disc, 1), 1) AS dd, track FROM items WHERE track IS NOT NULL),
 x AS (SELECT d.*, NOT EXISTS (SELECT 1 FROM t WHERE t.album_id = d.id AND NOT EXISTS (SELECT 1 FROM t u WHERE u.album_id = d.keep_id AND u.dd = t.dd AND u.track = t.track)) AS ins,
  NOT EXISTS (SELECT 1 FROM items i JOIN items j ON i.path = j.path WHERE i.album_id = d.id AND j.album_id = d.keep_id) AS apart FROM d)
 SELECT id, keep_id, CASE WHEN ins AND apart THEN 'DROP' WHEN NOT ins AND NOT apart THEN 'tracks beyond; files shared' WHEN NOT ins THEN 'tracks beyond' ELSE 'files shared' END AS verdict FROM x""")


def prune_plan(items: DataFrame, present: Column) -> DataFrame:
    """Albums whose files are gone, whole or in part; intact ones are left out."""
    g = items.groupBy("album_id").agg(F.count(F.lit(1)).alias("total"), F.sum((~present).cast("int")).alias("gone")).where("gone > 0")
    return g.select("album_id", "total", "gone", F.when(c("gone") == c("total"), "PRUNE_ALBUM").otherwise("PRUNE_ITEMS").alias("route"))


q("prune_plan", lambda s, d: prune_plan(_i(s, d), F.col("path").isNotNull()), "SELECT album_id, count(*) AS total, count(*) FILTER (path IS NULL) AS gone, CASE WHEN count(*) = count(*) FILTER (path IS NULL) THEN 'PRUNE_ALBUM' ELSE 'PRUNE_ITEMS' END AS route FROM items GROUP BY album_id HAVING count(*) FILTER (path IS NULL) > 0")
q("mass_missing_guard", lambda s, d: _i(s, d).agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("path").isNull().cast("int")).alias("gone")).select("total", "gone", ((c("total") > 0) & (c("gone") / F.nullif(c("total"), F.lit(0)) > 0.3)).alias("stop")), "SELECT count(*) AS total, count(*) FILTER (path IS NULL) AS gone, (count(*) > 0 AND count(*) FILTER (path IS NULL) / nullif(count(*), 0) > 0.3) AS stop FROM items")
def orphans_after(albums: DataFrame, items: DataFrame, gone: Column) -> DataFrame:
    """Albums that no item is left of once the items that are ``gone`` are deleted; those without any item too."""
    return albums.join(items.where(~gone).select(c("album_id").alias("id")), "id", "left_anti").select("id")


q("orphan_albums", lambda s, d: orphans_after(_a(s, d), _i(s, d), F.coalesce(c("bitrate"), F.lit(0)) < 300000), "SELECT id FROM albums WHERE id NOT IN (SELECT album_id FROM items WHERE album_id IS NOT NULL AND coalesce(bitrate, 0) >= 300000)")
q("new_ids_except", lambda s, d: _i(s, d).where("added >= 1700000000 and id > 4000").select("album_id").distinct().subtract(_i(s, d).where("id <= 4000").select("album_id")), "SELECT DISTINCT album_id FROM items WHERE added >= 1700000000 AND id > 4000 EXCEPT SELECT album_id FROM items WHERE id <= 4000")


def modal(df: DataFrame, key: str, value: Column, order: str) -> DataFrame:
    """Commonest value of each key, the first seen on a tie; blanks do not count."""
    v = df.where(F.trim(value) != "").groupBy(key, value.alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return v.groupBy(key).agg(F.max(F.struct("n", (-c("first")).alias("f"), "v")).alias("m")).select(key, c("m.v").alias("value"), c("m.n").alias("n"))


q("modal_first_seen", lambda s, d: modal(_i(s, d), "album_id", c("artist"), "id"), "WITH v AS (SELECT album_id, artist AS v, count(*) AS n, min(id) AS f FROM items WHERE trim(artist) <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY album_id ORDER BY n DESC, f) AS k FROM v) SELECT album_id, v AS value, n FROM r WHERE k = 1")


def modal_id(albums: DataFrame) -> DataFrame:
    """Commonest release id of a credit and title, only if on half of its rows or more and well formed."""
    k = albums.select(T.content_hash(c("albumartist"), c("album")).alias("key"), "id", F.lower(T.squeeze_space(c("mb_albumid"))).alias("m"))
    n = k.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    return modal(k, "key", c("m"), "id").join(n, "key").where((c("n") >= F.floor((c("rows") + 1) / 2)) & c("value").rlike(T.UUID)).select("key", c("value").alias("mbid"))


q("modal_mbid", lambda s, d: modal_id(_a(s, d)), f"WITH k AS (SELECT {T.sql_content_hash('albumartist', 'album')} AS key, id, lower({T.sql_squeeze('mb_albumid')}) AS m FROM albums), v AS (SELECT key, m, count(*) AS n, min(id) AS f FROM k WHERE trim(m) <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, f) AS p FROM v), c AS (SELECT key, count(*) AS rows FROM k GROUP BY key) SELECT r.key, r.m AS mbid FROM r JOIN c USING (key) WHERE p = 1 AND n >= (rows + 1) // 2 AND regexp_matches(m, '{T.UUID}')")


def tag_coalesce(attrs: DataFrame) -> DataFrame:
    """First filled of several tags of an entity."""
    m = attrs.where(F.trim("value") != "").groupBy("entity_id").pivot("key", ["mood", "shelf", "data_source"]).agg(F.min("value"))
    return m.select("entity_id", F.coalesce("mood", "shelf", "data_source").alias("tag"))


q("tag_coalesce", lambda s, d: tag_coalesce(table(s, d, "album_attributes")), "SELECT entity_id, coalesce(min(value) FILTER (key = 'mood'), min(value) FILTER (key = 'shelf'), min(value) FILTER (key = 'data_source')) AS tag FROM album_attributes WHERE trim(value) <> '' GROUP BY entity_id")
q("probe_derive", lambda s, d: _i(s, d).select("id", (c("format").isNotNull() & (F.coalesce("bitrate", F.lit(0)) > 0)).alias("ok"), F.coalesce(_lossless(), F.lit(False)).alias("lossless"), (F.coalesce(_lossless(), F.lit(False)) & (F.coalesce("bitrate", F.lit(0)) < 400000) & (F.coalesce("bitrate", F.lit(0)) > 0)).alias("mislabeled")), f"SELECT id, (format IS NOT NULL AND coalesce(bitrate, 0) > 0) AS ok, coalesce({_SLL}, false) AS lossless, (coalesce({_SLL}, false) AND coalesce(bitrate, 0) < 400000 AND coalesce(bitrate, 0) > 0) AS mislabeled FROM items")


def match_cascade(incoming: DataFrame, library: DataFrame) -> DataFrame:
    """Library item of each incoming one among the items of its credit: by disc, track and title; else by album and track, where either has no disc or both agree; else by title.

    The library is reduced to its best item of each key before each join, so no
    key multiplies rows; the best level wins.
    """
    def prep(x: DataFrame, p: str) -> DataFrame:
        rank = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in RANK.items() for v in kv]), F.lower("format")), F.lit(0)) * 1000000 + F.coalesce("bitrate", F.lit(0))
        return x.select(c("id").alias(p + "id"), canon(c("artist")).alias(p + "w"), F.coalesce("disc", F.lit(0)).alias(p + "d"), F.coalesce("track", F.lit(0)).alias(p + "t"), canon_title(c("title"), c("artist")).alias(p + "k"), canon(c("album")).alias(p + "a"), rank.alias(p + "s"))

    i, lib = prep(incoming, "i"), prep(library, "l")

    def level(n: int, keys: str, *more: str) -> DataFrame:
        held = lib.groupBy(*["l" + k for k in keys], *more).agg(F.max(F.struct("ls", (-c("lid")).alias("n"))).alias("b"))
        j = i.join(held, [c("i" + k) == c("l" + k) for k in keys])
        return j.select("iid", "it", "ik", "id", *more, F.lit(n).alias("level"), c("b.ls").alias("s"), (-c("b.n")).alias("lid"))

    two = level(2, "wat", "ld").where((c("it") > 0) & ((c("id") == 0) | (c("ld") == 0) | (c("id") == c("ld")))).drop("ld")
    every = level(1, "wdtk").unionByName(two).unionByName(level(3, "wk").where("ik <> ''"))
    best = every.groupBy("iid").agg(F.min(F.struct("level", (-c("s")).alias("s"), "lid")).alias("m"))
    return best.select(c("iid").alias("incoming_id"), c("m.lid").alias("library_id"), c("m.level").alias("level"))


def _halves(s, d):
    """Items of rows without a release id, as incoming ones, and of rows with one."""
    own = _a(s, d).select(c("id").alias("album_id"), T.valid_id(c("mb_albumid")).alias("own"))
    pick = lambda k: _i(s, d).join(own.where(c("own") == k), "album_id", "left_semi")
    return pick(False), pick(True)


_P = lambda p: f"id AS {p}id, {sql_canon('artist')} AS {p}w, coalesce(disc, 0) AS {p}d, coalesce(track, 0) AS {p}t, {sql_canon_title('title', 'artist')} AS {p}k, {sql_canon('album')} AS {p}a, CASE lower(format) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RANK.items()) + f" ELSE 0 END * 1000000 + coalesce(bitrate, 0) AS {p}s"
q("track_match_cascade", lambda s, d: match_cascade(*_halves(s, d)), f"""WITH own AS (SELECT id, {T.sql_valid_id("mb_albumid")} AS m FROM albums), i AS (SELECT {_P("i")} FROM items WHERE album_id IN (SELECT id FROM own WHERE NOT m)), l AS (SELECT {_P("l")} FROM items WHERE album_id IN (SELECT id FROM own WHERE m)),
 u AS (SELECT iid, 1 AS lv, ls, lid FROM i JOIN l ON iw = lw AND id = ld AND it = lt AND ik = lk UNION ALL SELECT iid, 2, ls, lid FROM i JOIN l ON iw = lw AND ia = la AND it = lt WHERE it > 0 AND (id = 0 OR ld = 0 OR id = ld) UNION ALL SELECT iid, 3, ls, lid FROM i JOIN l ON iw = lw AND ik = lk WHERE ik <> ''),
 r AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY lv, ls DESC, lid) AS k FROM u) SELECT iid AS incoming_id, lid AS library_id, lv AS level FROM r WHERE k = 1""")


def prefilter_counters(albums: DataFrame, items: DataFrame) -> DataFrame:
    """What the quality filter before an import does with the files of each candidate: new, better or no better than the library's.

    Better files replace the item they match, others are dropped from the
    import; an incomplete candidate is set aside whole. Counted by candidate.
    """
    cand, lib = candidates_and_library(albums)
    key = lambda x: x.select(c("id").alias("album_id"))
    mine, theirs = items.join(key(cand), "album_id", "left_semi"), items.join(key(lib), "album_id", "left_semi")
    met = match_cascade(mine, theirs)
    score = quality_score().alias("q")
    j = mine.select("album_id", c("id").alias("incoming_id"), score).join(met, "incoming_id", "left").join(theirs.select(c("id").alias("library_id"), quality_score().alias("lq")), "library_id", "left")
    flag = lambda x, n: F.count_if(x).alias(n)
    n = j.groupBy("album_id").agg(F.count(F.lit(1)).alias("files"), flag(c("lq").isNull(), "fresh"), flag(c("q") > c("lq"), "better"), flag(c("q") <= c("lq"), "dropped"))
    gone = gaps(items).where("missing <> '' and expected >= 6 and present / expected < 0.9").select("album_id", F.lit(True).alias("g"))
    out = F.when(c("g"), "set aside").when((c("fresh") > 0) | (c("better") > 0), "import").otherwise("drop")
    return n.join(gone, "album_id", "left").select("album_id", "files", "fresh", "better", "dropped", out.alias("outcome"))


q("quality_prefilter", lambda s, d: prefilter_counters(_a(s, d), _i(s, d)), "WITH met AS (" + SQL["track_match_cascade"] + f"""), qs AS (SELECT id, album_id, {SQL_QUALITY} AS q FROM items), own2 AS (SELECT id, {T.sql_valid_id("mb_albumid")} AS m FROM albums),
 j AS (SELECT i.album_id, i.q, l.q AS lq FROM qs i JOIN own2 ON own2.id = i.album_id AND NOT own2.m LEFT JOIN met ON met.incoming_id = i.id LEFT JOIN qs l ON l.id = met.library_id),
 n AS (SELECT album_id, count(*) AS files, count(*) FILTER (lq IS NULL) AS fresh, count(*) FILTER (q > lq) AS better, count(*) FILTER (q <= lq) AS dropped FROM j GROUP BY album_id), g AS (SELECT album_id FROM ({SQL["album_gaps"]}) AS x WHERE missing <> '' AND expected >= 6 AND present / expected < 0.9)
 SELECT album_id, files, fresh, better, dropped, CASE WHEN album_id IN (SELECT album_id FROM g) THEN 'set aside' WHEN fresh > 0 OR better > 0 THEN 'import' ELSE 'drop' END AS outcome FROM n""")


def route_counts(albums: DataFrame, items: DataFrame) -> DataFrame:
    """Histogram over a closed list of routes, zero where a route has no row."""
    spark = albums.sparkSession
    routes = spark.createDataFrame([(r,) for r in ("BETTER", "EQUAL", "WORSE", "AMBIGUOUS", "PARK")], "route string")
    n = quality_verdicts(albums, items).groupBy(c("verdict").alias("route")).agg(F.count(F.lit(1)).alias("n"))
    return routes.join(n, "route", "left").select("route", F.coalesce("n", F.lit(0)).alias("n"))


q("route_summary", lambda s, d: route_counts(_a(s, d), _i(s, d)), "WITH vd AS (" + SQL["quality_verdict"] + ") SELECT route, (SELECT count(*) FROM vd WHERE verdict = route) AS n FROM (VALUES ('BETTER'), ('EQUAL'), ('WORSE'), ('AMBIGUOUS'), ('PARK')) AS t(route)")


def import_summary(plan: DataFrame, albums: DataFrame) -> DataFrame:
    """Landed and parked candidates of a plan with the names to report: what won and is new or better lands, what is ambiguous is parked."""
    landed = ~c("duplicate") & ((c("family") == 0) | (c("verdict") == "BETTER"))
    kind = F.when(landed, F.when(c("family") == 0, "new").otherwise("upgrade")).when(~c("duplicate") & (c("verdict") == "AMBIGUOUS"), "parked")
    return plan.withColumn("kind", kind).where("kind is not null").join(albums.select("id", "albumartist", "album"), "id").select("id", "kind", F.trim(F.coalesce("albumartist", F.lit(""))).alias("artist"), F.trim(F.coalesce("album", F.lit(""))).alias("album"))


q("import_summary", lambda s, d: import_summary(reconcile_plan(_a(s, d), _i(s, d)), _a(s, d)), "WITH pl AS (" + SQL["reconcile_plan"] + """), k AS (SELECT id, CASE WHEN NOT duplicate AND (family = 0 OR verdict = 'BETTER') THEN CASE WHEN family = 0 THEN 'new' ELSE 'upgrade' END WHEN NOT duplicate AND verdict = 'AMBIGUOUS' THEN 'parked' END AS kind FROM pl)
 SELECT k.id, k.kind, trim(coalesce(albumartist, ''), ' ') AS artist, trim(coalesce(album, ''), ' ') AS album FROM k JOIN albums a ON a.id = k.id WHERE kind IS NOT NULL""")


def ancestors(items: DataFrame) -> DataFrame:
    """Every directory above a file, as bytes in hex, with the number of files beneath it; paths need not be text."""
    code = F.hex("path")
    # a slash at a byte border: only there does the hex of the path before it have even length
    cuts = F.filter(F.sequence(F.lit(1), F.length(code), F.lit(2)), lambda k: F.substr(code, k, F.lit(2)) == "2F")
    each = items.where(F.length("path") > 0).select(F.explode(F.transform(cuts, lambda k: F.substr(code, F.lit(1), k - 1))).alias("dir"))
    return each.where("dir <> ''").groupBy("dir").agg(F.count(F.lit(1)).alias("files"))


q("ancestor_dirs", lambda s, d: ancestors(_i(s, d)), "WITH p AS (SELECT hex(path) AS h FROM items WHERE octet_length(path) > 0), e AS (SELECT substr(h, 1, k - 1) AS dir FROM (SELECT h, unnest(list_filter(range(1, length(h), 2), lambda k: substr(h, k, 2) = '2F')) AS k FROM p)) SELECT dir, count(*) AS files FROM e WHERE dir <> '' GROUP BY dir")
