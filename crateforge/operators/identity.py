"""Which rows of the library are one release: tiered keys, convergence, disc splitting, candidates and wishes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateforge.functions import text as T
from crateforge.functions.session import table, written
from crateforge.operators.text_queries import sql_wish_key

QUERIES, SQL = {}, {}
c = F.col


def base_identity(albums: DataFrame) -> DataFrame:
    """id, key, tier, body: release group, else release id, else content hash, else review.

    Rows whose title has no letters go to review; ``body`` is the content hash
    of every row with a title and carries the convergence.
    """
    low = lambda n: F.lower(T.squeeze_space(c(n)))
    title = T.normalize_album(c("album"))
    body = F.when(title != "", T.content_hash(c("albumartist"), c("album")))
    group, release = T.valid_id(c("mb_releasegroupid")), T.valid_id(c("mb_albumid"))
    key = F.when(group, F.concat(F.lit("mbrg:"), low("mb_releasegroupid"))).when(release, F.concat(F.lit("mbid:"), low("mb_albumid"))).when(title == "", F.concat(F.lit("review:"), c("id").cast("string"))).otherwise(body)
    tier = F.when(group | release, 1).when(title == "", 3).otherwise(2)
    return albums.select("id", "albumartist", "album", "year", "mb_albumid", key.alias("key"), tier.alias("tier"), body.alias("body"))


def converged(base: DataFrame) -> DataFrame:
    """Rows without id take the key of the first row with an id that has their content: one aggregation and one join on the hash."""
    first = base.where((c("tier") == 1) & c("body").isNotNull()).groupBy("body").agg(F.min_by("key", "id").alias("known"))
    out = base.join(first, "body", "left")
    take = (c("tier") == 2) & c("known").isNotNull()
    return out.withColumn("key", F.when(take, c("known")).otherwise(c("key"))).withColumn("moved", take).drop("known")


def with_discs(keyed: DataFrame, items: DataFrame) -> DataFrame:
    """Discs of one set that are rows of their own get keys of their own.

    Among the rows that still carry a content key, those with exactly one disc
    above the first are split if there are two or more and their discs differ.
    """
    discs = items.select(c("album_id").alias("id"), F.coalesce("disc", F.lit(0)).alias("disc")).groupBy("id").agg(F.min("disc").alias("lo"), F.max("disc").alias("hi"))
    alone = keyed.where((c("tier") == 2) & ~c("moved")).join(discs.where("lo = hi and lo > 1"), "id").select("id", "key", c("lo").alias("d"))
    split = alone.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("d").alias("k")).where("n > 1 and n = k").select("key")
    marks = alone.join(split, "key", "left_semi").select("id", "d")
    return keyed.join(marks, "id", "left").withColumn("key", F.when(c("d").isNotNull(), F.concat(c("key"), F.lit("#disc="), c("d").cast("string"))).otherwise(c("key"))).drop("d")


def identity_index(albums: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each release: members, representative, tier and the commonest year."""
    rows = with_discs(converged(base_identity(albums)), items)
    lead = F.struct(F.when(T.valid_id(c("mb_albumid")), 0).otherwise(1), c("id"))
    years = rows.where(c("year").isNotNull() & (c("year") != 0)).groupBy("key", "year").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.min(F.struct((-c("n")).alias("n"), "year"))["year"].alias("year"))
    out = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n_albums"), F.min("id").alias("first_id"), F.min_by("albumartist", lead).alias("albumartist"), F.min_by("album", lead).alias("album"), F.min("tier").cast("int").alias("tier"))
    return out.join(years, "key", "left")


def _albums(spark, d):
    return table(spark, d, "albums")


def _items(spark, d):
    return table(spark, d, "items")


_BASE = f"""WITH n AS (SELECT *, {T.sql_normalize_album("album")} AS t, {T.sql_valid_id("mb_releasegroupid")} AS g, {T.sql_valid_id("mb_albumid")} AS m FROM albums),
 b AS (SELECT id, albumartist, album, year, m, CASE WHEN t <> '' THEN {T.sql_content_hash("albumartist", "album")} END AS body, CASE WHEN g OR m THEN 1 WHEN t = '' THEN 3 ELSE 2 END AS tier,
  CASE WHEN g THEN 'mbrg:' || lower({T.sql_squeeze("mb_releasegroupid")}) WHEN m THEN 'mbid:' || lower({T.sql_squeeze("mb_albumid")}) WHEN t = '' THEN 'review:' || id ELSE {T.sql_content_hash("albumartist", "album")} END AS key FROM n)"""
_CONV = (
    _BASE
    + """, f AS (SELECT body, arg_min(key, id) AS known FROM b WHERE tier = 1 AND body IS NOT NULL GROUP BY body),
 v AS (SELECT b.*, (tier = 2 AND known IS NOT NULL) AS moved, CASE WHEN tier = 2 AND known IS NOT NULL THEN known ELSE key END AS k2 FROM b LEFT JOIN f USING (body))"""
)
_DISC = (
    _CONV
    + """, ds AS (SELECT album_id AS id, min(coalesce(disc, 0)) AS lo, max(coalesce(disc, 0)) AS hi FROM items GROUP BY album_id),
 al AS (SELECT v.id, v.k2, lo AS d FROM v JOIN ds USING (id) WHERE tier = 2 AND NOT moved AND lo = hi AND lo > 1),
 sp AS (SELECT k2 FROM al GROUP BY k2 HAVING count(*) > 1 AND count(*) = count(DISTINCT d)),
 k AS (SELECT v.*, CASE WHEN al.d IS NOT NULL AND sp.k2 IS NOT NULL THEN v.k2 || '#disc=' || al.d ELSE v.k2 END AS k3 FROM v LEFT JOIN al ON al.id = v.id LEFT JOIN sp ON sp.k2 = v.k2)"""
)
QUERIES["identity_base"] = lambda s, d: base_identity(_albums(s, d)).select("id", "key", "tier")
SQL["identity_base"] = _BASE + " SELECT id, key, tier FROM b"
QUERIES["identity_convergence"] = lambda s, d: converged(base_identity(_albums(s, d))).select("id", "key", "moved")
SQL["identity_convergence"] = _CONV + " SELECT id, k2 AS key, moved FROM v"
QUERIES["identity_disc_suffix"] = lambda s, d: with_discs(converged(base_identity(_albums(s, d))), _items(s, d)).select("id", "key")
SQL["identity_disc_suffix"] = _DISC + " SELECT id, k3 AS key FROM k"
QUERIES["identity_index"] = lambda s, d: identity_index(_albums(s, d), _items(s, d))
SQL["identity_index"] = (
    _DISC
    + """, y AS (SELECT k3, year, row_number() OVER (PARTITION BY k3 ORDER BY count(*) DESC, year) AS r FROM k WHERE year <> 0 GROUP BY k3, year),
 l AS (SELECT *, row_number() OVER (PARTITION BY k3 ORDER BY CASE WHEN m THEN 0 ELSE 1 END, id) AS r FROM k)
 SELECT k.k3 AS key, count(*) AS n_albums, min(k.id) AS first_id, any_value(l.albumartist) AS albumartist, any_value(l.album) AS album, min(k.tier) AS tier, any_value(y.year) AS year
 FROM k JOIN l ON l.k3 = k.k3 AND l.r = 1 LEFT JOIN y ON y.k3 = k.k3 AND y.r = 1 GROUP BY k.k3"""
)
QUERIES["key_tier"] = lambda s, d: base_identity(_albums(s, d)).select("id", F.when(c("key").startswith("mbrg:") | c("key").startswith("mbid:"), 1).when(c("key").startswith("review:"), 3).otherwise(2).alias("tier"))
SQL["key_tier"] = _BASE + " SELECT id, CASE WHEN key LIKE 'mbrg:%' OR key LIKE 'mbid:%' THEN 1 WHEN key LIKE 'review:%' THEN 3 ELSE 2 END AS tier FROM b"

# rows without a release id stand for incoming candidates, those with one for the library

def _split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    own = T.valid_id(c("mb_albumid"))
    return df.where(~own), df.where(own)


def candidate_family(albums: DataFrame) -> DataFrame:
    """cand_id, lib_id: equal key or equal content. The OR is two hash joins and a distinct."""
    cand, lib = _split(converged(base_identity(albums)))
    pick = lambda on: cand.alias("a").join(lib.alias("b"), c(f"a.{on}") == c(f"b.{on}")).select(c("a.id").alias("cand_id"), c("b.id").alias("lib_id"))
    return pick("key").unionAll(pick("body")).distinct()


QUERIES["candidate_family"] = lambda s, d: candidate_family(_albums(s, d))
SQL["candidate_family"] = _CONV + f" SELECT DISTINCT a.id AS cand_id, b.id AS lib_id FROM v a JOIN v b ON (a.k2 = b.k2 OR a.body = b.body) WHERE NOT a.m AND b.m"


def owned(albums: DataFrame) -> DataFrame:
    """Candidates that the library already holds under the converged key."""
    cand, lib = _split(converged(base_identity(albums)))
    return cand.join(lib.select("key"), "key", "left_semi").select("id", "key")


QUERIES["owned_semi"] = lambda s, d: owned(_albums(s, d))
SQL["owned_semi"] = _CONV + f" SELECT id, k2 AS key FROM v WHERE NOT m AND k2 IN (SELECT k2 FROM v WHERE m)"


def _subset(x: Column, y: Column) -> Column:
    return F.size(F.array_except(x, y)) == 0


#: Letters of a piece by which a title is looked up in longer ones; a shorter title is its own piece.
PIECE = 6


def _pieces(x: Column, n: Column) -> Column:
    """Distinct substrings of length ``n``."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: F.substr(x, i, n)))


def _rarest(asked: DataFrame, held: DataFrame) -> DataFrame:
    """id, k: of the keys of each id that all must be held by what it meets, the one that the fewest rows of ``held`` have; none where one has no row.

    Both sides: id, k. ``asked`` has all keys of an id, so a missing one shows in the counts.
    """
    count = held.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(count.hint("merge"), "k", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "k")).alias("b")).where("b.n > 0").select("id", "b.k")


def _title_words(x: Column) -> Column:
    return F.array_distinct(F.split(x, "[^\\p{L}\\p{N}]+"))


def near_pairs(cand: DataFrame, lib: DataFrame) -> DataFrame:
    """cid, lid of the titles that may be near: id, a (artist key), t (title) on both sides.

    A title within another has all its pieces there, and a subset all its words:
    it is looked up by the rarest of them among the other side's titles of the
    artist, in both directions. Every piece and word is a key of its own, so no
    pair is lost and no artist is a block.
    """
    size = F.least(F.length("t"), F.lit(PIECE))

    def pieces_of(df: DataFrame) -> DataFrame:
        return df.select("id", "a", F.explode(_pieces(c("t"), size)).alias("p")).select("id", F.xxhash64("a", "p").alias("k"))

    def pieces_for(df: DataFrame, other: DataFrame) -> DataFrame:
        """Pieces of the lengths that titles of the other side have."""
        wanted = other.select("a", size.alias("n")).groupBy("a").agg(F.collect_set("n").alias("ns"))
        each = F.array_distinct(F.flatten(F.transform(F.filter("ns", lambda k: k <= F.length("t")), lambda k: _pieces(c("t"), k))))
        return df.join(wanted, "a").select("id", "a", F.explode(each).alias("p")).select("id", F.xxhash64("a", "p").alias("k"))

    words = lambda df: df.select("id", "a", F.explode(_title_words(c("t"))).alias("w")).select("id", F.xxhash64("a", "w").alias("k"))

    def met(asked: DataFrame, held: DataFrame, i: str, j: str) -> DataFrame:
        held = written(held, "held")
        return _rarest(asked, held).withColumnRenamed("id", i).join(held.withColumnRenamed("id", j).hint("merge"), "k").select("cid", "lid")

    return met(pieces_of(cand), pieces_for(lib, cand), "cid", "lid").unionByName(met(pieces_of(lib), pieces_for(cand, lib), "lid", "cid")).unionByName(met(words(cand), words(lib), "cid", "lid")).unionByName(met(words(lib), words(cand), "lid", "cid")).distinct()


def near_duplicates(albums: DataFrame) -> DataFrame:
    """cand_id, lib_id: same artist key, one title within the other or a word subset of half its size; the first by id.

    Titles of one artist are not compared all with all, see ``near_pairs``; equal
    ones collapse first.
    """
    # written before they are filtered: else the keys are made once for the filter and once more for the rows
    n = written(albums.select("id", T.valid_id(c("mb_albumid")).alias("own"), T.normalize_artist(c("albumartist")).alias("a"), T.normalize_album(c("album")).alias("t")), "titles").where("a <> '' and t <> ''")
    cand = written(n.where(~c("own")).groupBy("a", "t").agg(F.count(F.lit(1)).alias("n")).select("a", "t", F.xxhash64(F.lit(1), "a", "t").alias("id")), "candidates")
    lib = written(n.where("own").groupBy("a", "t").agg(F.min("id").alias("lib_id")).select("a", "t", "lib_id", F.xxhash64(F.lit(2), "a", "t").alias("id")), "library")
    pairs = near_pairs(cand, lib)
    both = pairs.join(cand.select(c("id").alias("cid"), "a", c("t").alias("t1")).hint("merge"), "cid").join(lib.select(c("id").alias("lid"), c("a").alias("a2"), c("t").alias("t2"), "lib_id").hint("merge"), "lid").where("a = a2 and t1 <> t2")
    w1, w2 = _title_words(c("t1")), _title_words(c("t2"))
    small, big = F.least(F.size(w1), F.size(w2)), F.greatest(F.size(w1), F.size(w2))
    near = (F.instr("t1", c("t2")) > 0) | (F.instr("t2", c("t1")) > 0) | ((_subset(w1, w2) | _subset(w2, w1)) & (small >= 0.5 * big))
    first = both.where(near).groupBy("a", "t1").agg(F.min("lib_id").alias("lib_id"))
    return n.where(~c("own")).join(first.withColumnRenamed("t1", "t").hint("merge"), ["a", "t"]).select(c("id").alias("cand_id"), "lib_id")


QUERIES["near_dup"] = lambda s, d: near_duplicates(_albums(s, d))
_WL = lambda x: f"list_distinct(string_split_regex({x}, '[^\\p{{L}}\\p{{N}}]+'))"
_NOT_IN = lambda x, y: f"len(list_filter({_WL(x)}, lambda w: NOT list_contains({_WL(y)}, w))) = 0"
SQL["near_dup"] = f"""WITH n AS (SELECT id, {T.sql_valid_id("mb_albumid")} AS own, {T.sql_normalize_artist("albumartist")} AS a, {T.sql_normalize_album("album")} AS t FROM albums), m AS (SELECT * FROM n WHERE a <> '' AND t <> '')
 SELECT x.id AS cand_id, min(y.id) AS lib_id FROM m x JOIN m y ON x.a = y.a AND x.t <> y.t WHERE NOT x.own AND y.own AND (contains(x.t, y.t) OR contains(y.t, x.t) OR (({_NOT_IN("x.t", "y.t")} OR {_NOT_IN("y.t", "x.t")})
 AND least(len({_WL("x.t")}), len({_WL("y.t")})) >= 0.5 * greatest(len({_WL("x.t")}), len({_WL("y.t")})))) GROUP BY x.id"""


def slot_collisions(items: DataFrame) -> DataFrame:
    """Albums with a disc and track that hold different titles."""
    t = items.where(c("track").isNotNull()).select("album_id", F.coalesce("disc", F.lit(0)).alias("disc"), "track", T.normalize_track(c("title")).alias("t")).where("t <> ''")
    return t.groupBy("album_id", "disc", "track").agg(F.count_distinct("t").alias("n")).where("n > 1").groupBy("album_id").agg(F.count(F.lit(1)).alias("slots"))


def merged_items(albums: DataFrame, items: DataFrame) -> DataFrame:
    """Items under the first album row of their release group, or of their normalised content: what a merge of such rows would hold."""
    group = F.when(T.valid_id(c("mb_releasegroupid")), F.lower(T.squeeze_space(c("mb_releasegroupid"))))
    k = albums.select("id", F.coalesce(group, T.content_hash(c("albumartist"), c("album"))).alias("key"))
    first = k.groupBy("key").agg(F.min("id").alias("first"))
    to = k.join(first, "key").select(c("id").alias("album_id"), "first")
    return items.select("album_id", "disc", "track", "title").join(to, "album_id").select(c("first").alias("album_id"), "disc", "track", "title")


QUERIES["slot_collision"] = lambda s, d: slot_collisions(merged_items(_albums(s, d), _items(s, d)))
SQL["slot_collision"] = f"WITH k AS (SELECT id, min(id) OVER (PARTITION BY CASE WHEN {T.sql_valid_id('mb_releasegroupid')} THEN lower({T.sql_squeeze('mb_releasegroupid')}) ELSE {T.sql_content_hash('albumartist', 'album')} END) AS first FROM albums), t AS (SELECT first AS album_id, coalesce(disc, 0) AS disc, track, {T.sql_normalize_track('title')} AS t FROM items JOIN k ON k.id = items.album_id WHERE track IS NOT NULL), x AS (SELECT album_id FROM t WHERE t <> '' GROUP BY album_id, disc, track HAVING count(DISTINCT t) > 1) SELECT album_id, count(*) AS slots FROM x GROUP BY album_id"


#: Letters of a title that make it an answer as the beginning of another.
HEAD = 6


def title_pairs(wished: DataFrame, held: DataFrame) -> DataFrame:
    """wt, lt of the titles that may answer each other; both sides: t, distinct.

    Nothing meets by a block of equal beginnings: the shorter title is looked up
    whole among all beginnings of the longer ones, and a subset of words by its
    rarest word, in both directions. Both follow from the title rule, so no pair
    is lost.
    """
    words = lambda df: df.select("t", F.explode(F.array_distinct(_long_words(c("t")))).alias("k"))
    several = lambda df: words(df.where(F.size(_long_words(c("t"))) > 1))
    whole = F.xxhash64("t").alias("k")
    heads = F.transform(F.sequence(F.lit(HEAD), F.length("t")), lambda n: F.xxhash64(F.substr("t", F.lit(1), n)))
    begun = lambda df: df.select("t", F.explode(F.when(F.length("t") >= HEAD, heads).otherwise(F.array(F.xxhash64("t")))).alias("k"))
    pair = lambda x, y, i, j: x.withColumnRenamed("t", i).join(y.withColumnRenamed("t", j).hint("merge"), "k").select("wt", "lt")

    def by_word(asked: DataFrame, among: DataFrame, i: str, j: str) -> DataFrame:
        among = words(among)
        return pair(_rarest(several(asked).withColumnRenamed("t", "id"), among).withColumnRenamed("id", "t"), among, i, j)

    return pair(wished.select("t", whole), begun(held), "wt", "lt").unionByName(pair(held.select("t", whole), begun(wished), "lt", "wt")).unionByName(by_word(wished, held, "wt", "lt")).unionByName(by_word(held, wished, "lt", "wt")).distinct()


def _long_words(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda k: F.length(k) > 1)


def fulfilled(wishes: DataFrame, library: DataFrame) -> DataFrame:
    """id of the wishes that a library row answers: fuzzy artist and fuzzy title.

    Distinct titles meet first, see ``title_pairs``; their artists are compared
    only where the titles answer each other.
    """
    norm = lambda df, *i: df.select(*i, T.wish_key(c("artist")).alias("a"), T.wish_key(c("album")).alias("t"))
    # written before they are filtered: else the keys are made once for the filter and once more for the rows
    named = "a <> '' and t <> ''"
    w = written(norm(wishes, "id"), "wishes").where(named)
    lib = written(norm(library).distinct(), "library").where(named)
    va = ("various", "various artists", "va")
    words = lambda x: F.array_distinct(_long_words(x))
    wa, la = words(c("a")), words(c("a2"))
    artist = c("a").isin(*va) | c("a2").isin(*va) | ((F.size(wa) > 0) & (F.size(la) > 0) & (_subset(wa, la) | _subset(la, wa)))
    tw, tl = _long_words(c("t")), _long_words(c("t2"))
    prefix = (F.least(F.length("t"), F.length("t2")) >= HEAD) & F.when(F.length("t") <= F.length("t2"), c("t2").startswith(c("t"))).otherwise(c("t").startswith(c("t2")))
    subset = F.when(F.size(tw) <= F.size(tl), (F.size(tw) >= 2) & _subset(tw, tl)).otherwise((F.size(tl) >= 2) & _subset(tl, tw))
    pairs = title_pairs(written(w.select("t").distinct(), "wished"), written(lib.select("t").distinct(), "held"))
    near = pairs.withColumnsRenamed({"wt": "t", "lt": "t2"}).where((c("t") == c("t2")) | prefix | subset)
    met = near.join(w.select("a", "t").distinct().hint("merge"), "t").join(lib.withColumnsRenamed({"a": "a2", "t": "t2"}).hint("merge"), "t2").where(artist)
    return w.join(met.select("a", "t").distinct().hint("merge"), ["a", "t"], "left_semi").select("id").distinct()


QUERIES["wishlist_fulfilled"] = lambda s, d: fulfilled(table(s, d, "slskd_ledger"), _albums(s, d).select(c("albumartist").alias("artist"), "album"))
_W2 = lambda x: f"list_filter(string_split({x}, ' '), lambda k: length(k) > 1)"
_SUB = lambda x, y: f"list_has_all({y}, {x})"
SQL["wishlist_fulfilled"] = f"""WITH w AS (SELECT id, {sql_wish_key("artist")} AS a, {sql_wish_key("album")} AS t FROM slskd_ledger), l AS (SELECT DISTINCT {sql_wish_key("albumartist")} AS a, {sql_wish_key("album")} AS t FROM albums),
 u AS (SELECT DISTINCT a, t, {_W2("a")} AS aw, {_W2("t")} AS tw FROM w WHERE a <> '' AND t <> ''), v AS (SELECT a, t, {_W2("a")} AS aw, {_W2("t")} AS tw FROM l WHERE a <> '' AND t <> ''),
 m AS (SELECT DISTINCT u.a, u.t FROM u JOIN v ON (u.a IN ('various', 'various artists', 'va') OR v.a IN ('various', 'various artists', 'va') OR (len(u.aw) > 0 AND len(v.aw) > 0 AND ({_SUB("u.aw", "v.aw")} OR {_SUB("v.aw", "u.aw")})))
  AND (u.t = v.t OR (least(length(u.t), length(v.t)) >= 6 AND CASE WHEN length(u.t) <= length(v.t) THEN starts_with(v.t, u.t) ELSE starts_with(u.t, v.t) END)
   OR CASE WHEN len(u.tw) <= len(v.tw) THEN len(u.tw) >= 2 AND {_SUB("u.tw", "v.tw")} ELSE len(v.tw) >= 2 AND {_SUB("v.tw", "u.tw")} END))
 SELECT DISTINCT w.id FROM w JOIN m ON m.a = w.a AND m.t = w.t"""
