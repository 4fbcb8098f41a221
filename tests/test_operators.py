import json
import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from crateforge.functions import text as T
from crateforge.operators import identity, ledger, search
from crateforge.sources import tables
from crateforge.streaming import claims


def _one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (T.normalize_album, "Old River [WEB FLAC 16 44] (1999)", "old river"), (T.normalize_album, "Old River (Deluxe Edition)", "old river (deluxe edition)"), (T.normalize_album, "[FLAC]", ""), (T.normalize_album, None, ""),
        (T.normalize_album, "Straße – é", "strasse - é"), (T.strip_format_brackets, "A [Disc 1] [[FLAC] WEB]", "A [Disc 1] "), (T.normalize_artist, "Ann Lee feat. Bo", "ann lee"), (T.normalize_artist, "Salt&Pepper", "salt&pepper"),
        (T.normalize_track, "Song (Live) feat. X", "song"), (T.is_va, "V. A.", True), (T.is_va, "Vast", False), (T.is_va, None, True), (T.wish_key, "Déjà, Vu_2", "deja vu 2"), (T.extension, "a\\b.c\\d.FLAC", "flac"), (T.extension, ".hidden", ""),
        (T.base_name, "a/b\\c/", "c"), (T.parent_name, "a\\b\\c.mp3", "a\\b"),
    ],
)
def test_text(spark, f, value, want):
    assert _one(spark, value, f) == want


ALBUM = "id bigint, albumartist string, album string, year int, mb_albumid string, mb_releasegroupid string"
U = "026c5232-ef4b-4a11-a04e-5919074daf83"


def test_identity_rules(spark):
    a = spark.createDataFrame([(1, "Ann", "River", 1, U, None), (2, "ann", "River [FLAC]", 2, "", None), (3, "Bo", "Set", 1, None, None), (4, "Bo", "Set", 1, None, None), (5, "Bo", "Set", 1, None, None), (6, "x", "[FLAC]", 1, None, None)], ALBUM)
    i = spark.createDataFrame([(k, d) for k, d in ((3, 1), (4, 2), (5, 3), (1, 1))], "album_id bigint, disc int")
    keys = {r.id: r.key for r in identity.with_discs(identity.converged(identity.base_identity(a)), i).collect()}
    assert keys[1] == keys[2] == f"mbid:{U}"
    assert keys[4] == keys[3] + "#disc=2" and keys[5] == keys[3] + "#disc=3" and keys[6] == "review:6"


def _near(x, y):
    w1, w2 = ({*re.split(r"[^\w]+|_+", z)} for z in (x, y))
    return x in y or y in x or (w1 <= w2 or w2 <= w1) and min(len(w1), len(w2)) >= 0.5 * max(len(w1), len(w2))


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["river", "old", "stone", "is", "a", "lightning", "(live)", "riverside", "x-y"])
    rows = [(i, rng.choice(["ann", "bo"]), " ".join(word() for _ in range(rng.randint(1, 5))), 1, rng.choice([U, None]), None) for i in range(150)]
    rows += [rows[0], (900, "ann", None, 1, U, None), (901, None, "river", 1, None, None)]
    lib = [r for r in rows if r[4] and r[2]]
    want = {r[0]: min(near) for r in rows if not r[4] and r[1] and (near := [y[0] for y in lib if y[1] == r[1] and y[2] != r[2] and _near(r[2], y[2])])}
    got = identity.near_duplicates(spark.createDataFrame(rows, ALBUM)).collect()
    assert {r.cand_id: r.lib_id for r in got} == want and len(want) > 30


def test_titles_of_one_artist_do_not_meet_all(spark):
    name = lambda i: "songs from " + "".join("bdfgklmnpr"[int(k)] + "aeiou"[int(k) % 5] for k in f"{i * 7919 % 100000:05d}")
    side = lambda at: spark.createDataFrame([(i, "ann", name(i)) for i in range(at, at + 400)] + [(at + 400, "ann", "songs from")], "id bigint, a string, t string")
    # 160,801 pairs of which 801 are near
    assert 801 <= identity.near_pairs(side(0), side(1000)).count() < 8000


def _answers(wish, lib):
    def matches(a, b):
        x, y = a[0].split(), b[0].split()
        artist = a[0] in ("va", "various") or b[0] in ("va", "various") or (set(x) <= set(y) or set(y) <= set(x))
        s, t = sorted((a[1], b[1]), key=len) if len(a[1]) != len(b[1]) else (a[1], b[1])
        p, q = [w for w in a[1].split() if len(w) > 1], [w for w in b[1].split() if len(w) > 1]
        p, q = (p, q) if len(p) <= len(q) else (q, p)
        return artist and (a[1] == b[1] or len(s) >= 6 and t.startswith(s) or len(p) >= 2 and all(w in q for w in p))

    return {i for i, *w in wish if any(matches(w, b) for b in lib)}


def test_fuzzy_wishes_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["river", "old", "stone", "sea", "light", "dark", "of", "bells", "xy"])
    name = lambda n: " ".join(word() for _ in range(rng.randint(1, n)))
    wish, lib = [(i, name(2), name(4)) for i in range(120)], [(rng.choice([name(2), "various"]), name(4)) for _ in range(60)]
    got = identity.fulfilled(spark.createDataFrame(wish, "id bigint, artist string, album string"), spark.createDataFrame(lib, "artist string, album string"))
    assert {r.id for r in got.collect()} == _answers(wish, lib)


def test_titles_of_one_beginning_do_not_meet_all(spark):
    name = lambda i: "songs from " + "".join("bdfgklmnpr"[int(k)] + "aeiou"[int(k) % 5] for k in f"{i * 7919 % 100000:05d}")
    side = lambda at: spark.createDataFrame([(name(i),) for i in range(at, at + 400)] + [("songs from",), ("songs",)], "t string")
    pairs = identity.title_pairs(side(0), side(300))
    # of 161,604 pairs
    assert pairs.count() < 3000 and pairs.where("wt = lt").count() == 102 and pairs.where("wt = 'songs from'").count() == 401


def test_sources_are_assigned_as_a_greedy_walk_would(spark):
    rng = random.Random(2)
    rows = []
    for i in range(8):
        names = [f"x\\y\\{t:02d} song.flac" for t in rng.sample(range(1, 12), 5)]
        rows.append((i, f"p\\album one ({i})" if i % 2 else "p\\album two", rng.randint(-5, 100), [(n, 1, 1, 16, 44100) for n in names]))
    schema = "folder_id bigint, directory string, score int, files array<struct<filename string, size bigint, length bigint, bitDepth int, sampleRate int>>"
    got = {(r.album, r.track): r.folder_id for r in search.assigned(spark.createDataFrame(rows, schema)).collect()}
    want = {}
    for album in {T_key(r[1]) for r in rows}:
        own = sorted((r for r in rows if T_key(r[1]) == album and r[2] >= 0), key=lambda r: (-r[2], r[0]))[:5]
        for r in own:
            for f in r[3]:
                want.setdefault((album, int(f[0].split("\\")[-1][:2])), r[0])
    assert got == want


def T_key(directory):
    return " ".join("".join(ch if ch.isalnum() else " " for ch in directory.split("\\")[-1].lower()).split())


def test_upsert_keeps_first_seen(spark):
    s = "folder_name string, first_seen double, reason string, files_present int, updated_at double"
    old, new = spark.createDataFrame([("a", 1.0, "x", 1, 1.0), ("b", 1.0, "x", 1, 1.0)], s), spark.createDataFrame([("a", 9.0, "y", 2, 2.0), ("a", 9.0, "z", 3, 3.0), ("c", 9.0, "y", 2, 2.0)], s)
    got = {r.folder_name: (r.first_seen, r.reason) for r in ledger.upsert(old, new, "folder_name", ("first_seen",)).collect()}
    assert got == {"a": (1.0, "z"), "b": (1.0, "x"), "c": (9.0, "y")}


def test_unknown_is_not_empty(spark):
    r = spark.createDataFrame([], "username string, directory string, files array<struct<filename string, size bigint>>")
    led = spark.createDataFrame([], "state string, remote_dir string")
    assert ledger.busy(r, led).count() == 0
    assert [x.dir for x in ledger.busy(r, led, available=False).collect()] == [None]


def test_sqlite_and_json_sources(spark, tmp_path):
    p = tmp_path / "x.db"
    con = sqlite3.connect(p)
    con.execute("CREATE TABLE items (id INTEGER PRIMARY KEY, path BLOB, title TEXT)")
    con.executemany("INSERT INTO items VALUES (?, ?, ?)", [(i, b"\xff\x00" + bytes([i]), None if i % 2 else "t") for i in range(1, 30)])
    con.commit()
    con.close()
    spark.dataSource.register(tables.SQLiteSource)
    rows = spark.read.format("sqlite").schema("id bigint, path binary, title string").option("path", str(p)).option("table", "items").load().collect()
    assert sorted(r.id for r in rows) == list(range(1, 30)) and bytes(rows[0].path)[:2] == b"\xff\x00"
    j = tmp_path / "r.jsonl"
    j.write_text(json.dumps({"username": "u", "uploadSpeed": 5, "files": [{"filename": "a\\b\\1.mp3", "size": 3}, {"filename": "a\\c\\1.mp3"}]}) + "\nnot json\n")
    assert {r.directory for r in tables.folders_of(tables.search_responses(spark, str(j))).collect()} == {"a\\b", "a\\c"}
    t = tmp_path / "l.md"
    t.write_text("**Ann** (2 albums)\n  - River\n  - river\n**Bo** (1 albums)\n  - Sea\n")
    assert sorted((r.artist, r.album) for r in tables.lost_list(spark, str(t)).collect()) == [("Ann", "River"), ("Bo", "Sea")]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("k1", 1, "claim", 1.0), ("k1", 2, "claim", 2.0), ("k2", 3, "claim", 1.0), ("k1", 4, "release", 3.0), ("k1", 5, "claim", 4.0)]
    s = "identity_key string, id bigint, action string, queued_at double"
    spark.createDataFrame(rows, s).coalesce(1).write.parquet(str(src))
    out = claims.admitted(spark.readStream.schema(s).parquet(str(src)))
    q = out.writeStream.format("memory").queryName("claims").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.id for r in spark.table("claims").where("admitted").collect()} == {1, 3, 5}
    box, done = tmp_path / "box", str(tmp_path / "done")
    spark.createDataFrame([(i, "e", "p") for i in (1, 2, 3, 3)], "id bigint, event string, payload string").write.parquet(str(box))
    spark.createDataFrame([(2,)], "id bigint").write.parquet(done)
    stream = spark.readStream.schema("id bigint, event string, payload string").parquet(str(box))
    claims.deliver(stream, lambda rows: [r["id"] for r in rows if r["id"] != 3], done, str(tmp_path / "c2")).awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(done).collect()) == [1, 2]
    # at most once: marked before it is sent, so what failed is not sent again
    once = str(tmp_path / "once")
    spark.createDataFrame([(2,)], "id bigint").write.parquet(once)
    for k in ("c3", "c4"):
        stream = spark.readStream.schema("id bigint, event string, payload string").parquet(str(box))
        claims.deliver(stream, lambda rows: [], once, str(tmp_path / k), at_most_once=True).awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(once).collect()) == [1, 2, 3]
