"""p5: the surviving record of each group of rows that carry one release id.

Method: iterative truth discovery. The reliability of each source and the
support of each field value are estimated in turn (support: summed weight of the
sources that claim the value; reliability: share of a source's claims that agree
with the best supported value) until the reliabilities stand still; then the
highest-supported value of each field is kept. The base row of a group follows
the fixed preference: most distinct tracks, most filled fields, latest item,
smallest id.

Defined results: null, empty and 0 are no claims; a field without claims is
null; equal support goes to the more recent claim, then to the smaller value; a
row without items has no tracks and no date; repeated attribute rows count once.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateforge.functions.session import dropped, written

UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
FIELDS = ("albumartist", "album", "year", "mb_releasegroupid")
MAX_ROUNDS, STILL = 20, 1e-3
#: Weights are broadcast to the claims up to so many sources (one short row each); beyond that they meet in an ordinary join.
MOST_SOURCES = 100_000
#: Ids in one row of the membership table; a group of any size is spread over as many rows as it needs.
IDS_PER_ROW = 1000


def usable_id(c: Column) -> Column:
    """The release id in lower case without padding, null where it is no UUID or a placeholder (one digit repeated)."""
    t = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(t.rlike(UUID) & ~t.rlike(r"^([0-9a-f])\1{7}-\1{4}-\1{4}-\1{4}-\1{12}$"), t)


def _filled(name: str) -> Column:
    c = F.col(name)
    return c.isNotNull() & (c != 0) if name == "year" else c.isNotNull() & (F.trim(c) != "")


def item_facts(items: DataFrame) -> DataFrame:
    """album_id, n_tracks (distinct disc and track; null or 0 disc is 1), latest added."""
    disc = F.when(F.coalesce(F.col("disc"), F.lit(0)) == 0, 1).otherwise(F.col("disc"))
    tracks = items.where(F.col("track").isNotNull()).select("album_id", disc.alias("disc"), "track").distinct().groupBy("album_id").agg(F.count(F.lit(1)).alias("n_tracks"))
    dates = items.groupBy("album_id").agg(F.max("added").alias("latest"))
    return dates.join(tracks, "album_id", "left")


def grouped_rows(albums: DataFrame, items: DataFrame) -> DataFrame:
    """Rows with a usable release id carried by two or more rows, with the facts of their items."""
    rows = albums.select("id", *FIELDS, usable_id(F.col("mb_albumid")).alias("release")).where(F.col("release").isNotNull())
    many = rows.groupBy("release").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("release")
    return rows.join(many, "release", "left_semi").join(item_facts(items), F.col("id") == F.col("album_id"), "left").drop("album_id")


def base_rows(rows: DataFrame) -> DataFrame:
    """release, keep_id: one aggregation with partial results, no group is gathered."""
    n = sum(_filled(f).cast("int") for f in FIELDS)
    rank = F.struct(F.coalesce("n_tracks", F.lit(0)).alias("t"), n.alias("n"), F.coalesce("latest", F.lit(float("-inf"))).alias("d"), (-F.col("id")).alias("i"))
    return rows.groupBy("release").agg((-F.max(rank)["i"]).alias("keep_id"), F.count(F.lit(1)).alias("n_rows"))


def claims_of(rows: DataFrame, attributes: DataFrame) -> DataFrame:
    """release, field, value, source, n, recent: the claims, counted."""
    source = attributes.where((F.col("key") == "data_source") & (F.trim("value") != "")).groupBy(F.col("entity_id").alias("id")).agg(F.min("value").alias("source"))
    said = rows.join(source, "id", "left").withColumn("source", F.coalesce("source", F.lit("(none)")))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.when(_filled(f), F.trim(F.col(f).cast("string"))).alias("value")) for f in FIELDS]))
    flat = said.select("release", "source", "latest", each.alias("c")).select("release", "source", "latest", "c.field", "c.value").where(F.col("value").isNotNull())
    return flat.groupBy("release", "field", "value", "source").agg(F.count(F.lit(1)).alias("n"), F.max("latest").alias("recent"))


def discovered(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(release, field, value, support) of the winners, (source, weight) after convergence."""
    claims = written(claims, "claims")
    weights = written(claims.select("source").distinct().withColumn("weight", F.lit(0.8)), "weights")
    # rows without a source share one: joined by source they would all meet in one task
    small = weights.count() <= MOST_SOURCES
    for _ in range(MAX_ROUNDS):
        best = _winners(claims, weights, small)
        judged = claims.join(best.select("release", "field", F.col("value").alias("best")), ["release", "field"])
        right = F.sum(F.when(F.col("value") == F.col("best"), F.col("n")).otherwise(0))
        new = written(judged.groupBy("source").agg(((right + 4.0) / (F.sum("n") + 5.0)).alias("weight")), "weights")
        moved = new.alias("a").join(weights.alias("b"), "source").agg(F.max(F.abs(F.col("a.weight") - F.col("b.weight")))).first()[0]
        dropped(weights)
        weights = new
        if moved is None or moved < STILL:
            break
    else:
        warnings.warn(f"the weights of sources still moved by {moved:.4f} after {MAX_ROUNDS} rounds", stacklevel=2)
    return _winners(claims, weights, small), weights


def _winners(claims: DataFrame, weights: DataFrame, small: bool) -> DataFrame:
    scored = claims.join(F.broadcast(weights) if small else weights, "source").groupBy("release", "field", "value").agg(F.sum(F.col("weight") * F.col("n")).alias("support"), F.max("recent").alias("recent"))
    least = F.struct((-F.round("support", 9)).alias("s"), (-F.coalesce("recent", F.lit(float("-inf")))).alias("r"), F.col("value").alias("v"))
    return scored.groupBy("release", "field").agg(F.min(least).alias("m")).select("release", "field", F.col("m.v").alias("value"), (-F.col("m.s")).alias("support"))


def survivors(albums: DataFrame, items: DataFrame, attributes: DataFrame) -> DataFrame:
    """mb_albumid, keep_id, n_rows and the discovered albumartist, album, year, mb_releasegroupid of each group."""
    rows = written(grouped_rows(albums, items), "grouped")
    best, _ = discovered(claims_of(rows, attributes))
    wide = best.groupBy("release").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS])
    out = base_rows(rows).join(wide, "release", "left")
    return out.select(F.col("release").alias("mb_albumid"), "keep_id", "n_rows", "albumartist", "album", F.col("year").cast("int").alias("year"), "mb_releasegroupid")


def member_ids(albums: DataFrame, items: DataFrame) -> DataFrame:
    """mb_albumid, part, album_ids: the ids of each group, at most ``IDS_PER_ROW`` on average in one row."""
    rows = grouped_rows(albums, items).select("release", "id")
    sizes = rows.groupBy("release").agg(F.count(F.lit(1)).alias("k"))
    parts = F.ceil(F.col("k") / IDS_PER_ROW)
    spread = rows.join(sizes, "release").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    return spread.groupBy(F.col("release").alias("mb_albumid"), "part").agg(F.sort_array(F.collect_list("id")).alias("album_ids"))
