from crateforge.llm import survivors as s

U = "026c5232-ef4b-4a11-a04e-5919074daf83"


def _tables(spark):
    albums = [
        (1, "Ann", "River", 1999, f" {U.upper()} ", None), (2, "Ann", "River", 0, U, "rg"), (3, "An", "River", 1999, U, ""),
        (4, "Solo", "One", 1, "126c5232-ef4b-4a11-a04e-5919074daf83", None), (5, "x", "y", 1, "00000000-0000-0000-0000-000000000000", None), (6, "x", "y", 1, "00000000-0000-0000-0000-000000000000", None), (7, None, None, None, None, None),
    ]
    items = [(1, 1, 0, 1, 5.0), (2, 1, 1, 1, 6.0), (3, 2, None, 1, 9.0), (4, 2, 1, None, 9.5), (5, 3, 1, 2, 1.0)]
    attrs = [(1, "data_source", "good"), (1, "data_source", "good"), (3, "data_source", "bad"), (3, "mood", "x")]
    return (
        spark.createDataFrame(albums, "id bigint, albumartist string, album string, year int, mb_albumid string, mb_releasegroupid string"),
        spark.createDataFrame(items, "id bigint, album_id bigint, disc int, track int, added double"),
        spark.createDataFrame(attrs, "entity_id bigint, key string, value string"),
    )


def test_survivor(spark):
    rows = s.survivors(*_tables(spark)).collect()
    assert len(rows) == 1
    r = rows[0]
    # each row has one track; 2 and 1 have three filled fields; 2 has the later item
    assert (r.mb_albumid, r.keep_id, r.n_rows, r.albumartist, r.year, r.mb_releasegroupid) == (U, 2, 3, "Ann", 1999, "rg")
    a, i, t = _tables(spark)
    assert [list(x.album_ids) for x in s.member_ids(a, i).collect()] == [[1, 2, 3]]


def test_empty(spark):
    a, i, t = _tables(spark)
    assert s.survivors(a.limit(0), i.limit(0), t.limit(0)).count() == 0
    assert s.survivors(a, i.limit(0), t.limit(0)).first().keep_id in (1, 2, 3)
