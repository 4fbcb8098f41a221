import json

import pytest
from pyspark.sql import functions as F

from crateforge.functions import text as T
from crateforge.functions.session import dropped, shared_dir, written
from crateforge.operators import ledger, library, search, state, text_queries
from crateforge.sources import tables

ITEM = "id bigint, album_id bigint, disc int, track int, title string, path binary, format string, bitrate int, samplerate int, bitdepth int, artist string, album string, added double"
ALBUM = "id bigint, albumartist string, album string, mb_albumid string, mb_releasegroupid string"
U = "026c5232-ef4b-4a11-a04e-5919074daf83"


def _item(i, album, track, disc=0, fmt="FLAC", path=b"a/b.flac", bitrate=900000, rate=44100, depth=16, title="t", artist="Ann", name="River"):
    return (i, album, disc, track, title, path, fmt, bitrate, rate, depth, artist, name, float(i))


def test_attributes_journal_progress_and_staging(spark):
    old = spark.createDataFrame([(1, "k", "a"), (1, "k", "a"), (2, "k", None)], "entity_id bigint, key string, value string")
    new = spark.createDataFrame([(1, "k", "b"), (3, "k", "c")], old.schema)
    assert {(r.entity_id, r.value) for r in state.attributes_upsert(old, new).collect()} == {(1, "b"), (2, None), (3, "c")}
    j = spark.createDataFrame([("a", "PENDING", 1.0), ("a", "DONE", 2.0), ("b", "PENDING", 1.0), ("c", "DONE", 1.0), ("c", "PENDING", 3.0)], "op string, state string, at double")
    assert {(r.op, r.since) for r in state.journal_open(j).collect()} == {("b", 1.0), ("c", 3.0)}
    w = spark.createDataFrame([("x",), ("y",), ("z",)], "key string")
    p = spark.createDataFrame([("x", "queued"), ("y", "error")], "key string, status string")
    assert sorted(r.key for r in state.remaining(w, p).collect()) == ["y", "z"]
    now, wait = state.staged_deletions(spark.createDataFrame([(1, "f"), (2, "g")], "id bigint, incoming string"), spark.createDataFrame([("f",)], "incoming string"))
    assert [r.id for r in now.collect()] == [1] and [r.id for r in wait.collect()] == [2]


def test_verdict_ladder(spark):
    albums = [(1, "Ann", "River", U, None)]
    items = [_item(1, 1, 1), _item(2, 1, 2)]
    cases = {10: ("WORSE", [(1, {})]), 11: ("EQUAL", [(1, {}), (2, {})]), 12: ("BETTER", [(1, {}), (2, {}), (3, {})]), 13: ("AMBIGUOUS", [(1, {"rate": 0}), (2, {})]), 14: ("BETTER", [(1, {"depth": 24}), (2, {"depth": 24})]),
             15: ("WORSE", [(1, {"fmt": "MP3", "path": b"a.mp3"}), (2, {"fmt": "MP3", "path": b"a.mp3"})]), 16: ("AMBIGUOUS", [(1, {"fmt": "MP3", "path": b"x.FLAC"}), (2, {"fmt": "MP3", "path": b"a.mp3"})]), 17: ("AMBIGUOUS", [(1, {}), (2, {"disc": 2}), (3, {"disc": 2})])}
    n = 100
    for k, (_, tracks) in cases.items():
        albums.append((k, "ANN", "River [FLAC]", None, None))
        for t, more in tracks:
            n += 1
            items.append(_item(n, k, t, **more))
    a, i = spark.createDataFrame(albums, ALBUM), spark.createDataFrame(items, ITEM)
    got = {r.id: r.verdict for r in library.quality_verdicts(a, i).collect()}
    assert got == {k: v for k, (v, _) in cases.items()}
    assert library.quality_verdicts(a.limit(0), i).count() == 0
    # a faulty library gives way to a sound candidate of the same tracks
    worn = spark.createDataFrame([_item(1, 1, 1, rate=0), _item(2, 1, 2), _item(3, 11, 1), _item(4, 11, 2)], ITEM)
    assert {r.id: r.verdict for r in library.quality_verdicts(a, worn).collect()} == {11: "BETTER"}


def test_cascade_keeps_discs_apart(spark):
    lib = spark.createDataFrame([_item(1, 1, 1, disc=2, title="01 Ann Sea"), _item(2, 1, 2, title="Stone"), _item(3, 1, 9, title="Ann Light")], ITEM)
    new = spark.createDataFrame([_item(11, 2, 1, disc=1, title="Other"), _item(12, 2, 1, disc=0, title="Other"), _item(13, 2, 7, title="Light", name="Else"), _item(14, 2, 2, disc=3, title="x"), _item(15, 2, 1, disc=2, title="Sea"), _item(16, 2, 9, artist="Bo", title="Light")], ITEM)
    got = {r.incoming_id: (r.library_id, r.level) for r in library.match_cascade(new, lib).collect()}
    assert got == {12: (1, 2), 13: (3, 3), 14: (2, 2), 15: (1, 1)} or got == {12: (1, 2), 13: (3, 3), 14: (2, 2), 15: (1, 2)}


def test_states_of_transfers(spark):
    s = spark.createDataFrame([("Initializing",), ("Completed, Succeeded",), ("Queued, Remotely",), ("Requested",), ("InProgress",), (None,)], "state string")
    live = {r.state: r.x for r in s.select("state", F.coalesce(ledger._live_state(F.col("state")), F.lit(False)).alias("x")).collect()}
    assert live == {"Initializing": True, "Completed, Succeeded": False, "Queued, Remotely": True, "Requested": True, "InProgress": True, None: False}


def test_watchdog_score_and_profiles(spark):
    schema = "folder_id bigint, upload_speed bigint, files array<struct<filename string, size bigint, length bigint, bitDepth int, sampleRate int>>"
    rows = [(1, 2_900_000, [("a/1.flac", 1, 1, 16, 44100), ("a/2.mp3", 1_000_000, 100, None, None)]), (2, 50_000_000, [("a/2.mp3", 4_000_000, 100, None, None)]), (3, 9_000_000, [("a/2.mp3", 100, 100, None, None)]), (4, 1, [("a/2.mp3", 0, 0, None, None), ("a/x.jpg", 1, 1, None, None)])]
    got = {r.folder_id: r.total for r in search.watchdog_scores(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: 510, 2: 250, 3: 0, 4: 200}
    spoken = spark.createDataFrame([(1, 1, [("a/1.m4b", 400_000, 100, None, None)])], schema)
    score = lambda *a: search.files(spoken).select(search.file_score(*a).alias("x")).first().x
    assert score() == -1 and score(search.SPOKEN_FORMATS, search.SPOKEN_KBPS_FLOOR) == 200


@pytest.mark.parametrize(("text", "want"), [("present=4/9 missing=[1, 2,x, 07]", ([1, 2, 7], 4, 9)), ("missing=[]", ([], 0, 0)), (None, ([], 0, 0)), ("present=a/b", ([], 0, 0))])
def test_parse_reason(spark, text, want):
    r = spark.createDataFrame([(text,)], "x string").select(text_queries.missing_tracks(F.col("x")).alias("m"), text_queries.present_count(F.col("x"), 1).alias("a"), text_queries.present_count(F.col("x"), 2).alias("b")).first()
    assert (r.m, r.a, r.b) == want


def test_nested_format_brackets(spark):
    r = spark.createDataFrame([("A [[[FLAC] WEB] CD]",), ("A",), (None,)], "x string").select(T.strip_format_brackets(F.col("x")).alias("y")).collect()
    assert [x.y for x in r] == ["A ", "A", None]


def test_plans_pages_and_updates(spark, tmp_path):
    plan = spark.createDataFrame([("PARK", "few", ("in/A b", 3, "x", "y")), ("NEW", None, ("in/C/", 3, "x", "y")), (None, None, ("", 1, "x", "y"))], "route string, route_reason string, candidate struct<path: string, n_audio_files: bigint, scanned_albumartist: string, scanned_album: string>")
    tables.write_plan(plan, str(tmp_path / "plan"))
    (tmp_path / "plan" / "broken.json").write_text("{not json\n[]\n")
    assert {(r.folder, r.reason) for r in tables.read_plan(spark, str(tmp_path / "plan")).collect()} == {("A b", "PARK: few"), ("C", "NEW")}
    pages = tmp_path / "pages"
    pages.mkdir()
    for k, body in enumerate(('{"results": [{"id": 1}, {"id": "ü"}]}', "oops", '{"results": []}', '{"results": [{"id": 3}]}')):
        (pages / f"page-{k}.json").write_text(body)
    spark.dataSource.register(tables.PagedSource)
    got = spark.read.format("pages").option("path", str(pages)).load().collect()
    assert {(r.page, r.place, json.loads(r["item"])["id"]) for r in got} == {(0, 0, 1), (0, 1, "ü"), (3, 0, 3)}
    empty = tmp_path / "none"
    empty.mkdir()
    assert spark.read.format("pages").option("path", str(empty)).load().count() == 0
    f = tmp_path / "updates.jsonl"
    f.write_text("".join(json.dumps({"update_id": k, "message": {"text": f"m{k}"}}) + "\n" for k in (5, 3, 4, 4)) + "bad\n")
    spark.dataSource.register(tables.UpdateSource)

    def run():
        s = spark.readStream.format("updates").option("path", str(f)).load()
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        q.awaitTermination(120)

    run()
    with open(f, "a") as h:
        h.write(json.dumps({"update_id": 6, "message": None}) + "\n")
    run()
    assert sorted(r.update_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [3, 4, 5, 6]


def test_scratch_tables_are_shared_and_dropped(spark, monkeypatch):
    t = written(spark.range(3), "x")
    assert t.count() == 3
    dropped(t)
    with pytest.raises(Exception, match="(?i)not exist|does not"):
        spark.read.parquet(t._crateforge_path).count()

    class Cluster:
        class conf:
            @staticmethod
            def get(k, default=None):
                return "spark://somewhere:7077" if k == "spark.master" else default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)
