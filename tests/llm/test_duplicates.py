from crateforge.llm import duplicates as d

ALBUM = "id bigint, albumartist string, album string, year int, extra string"


def _brute(rows):
    out = set()
    for i, a, b, *_ in rows:
        for j, c, e, *_ in rows:
            if str(i) >= str(j) or not all(x and x.strip() for x in (a, b, c, e)) or (a, b) == (c, e):
                continue
            x, y = (d.squeezed(a), d.squeezed(b)), (d.squeezed(c), d.squeezed(e))
            if x == y or x == y[::-1]:
                out.add((str(i), str(j)))
    return out


def test_album_pairs_match_brute_force(spark):
    rows = [
        (1, "The Band", "First", 1990, "x"), (2, "THE  BAND", "first!", None, "x"), (3, "First", "The Band", 0, "x"), (4, "The Band", "First", 1, "x"),
        (5, "The Band", "Second", 1, "x"), (6, None, "First", 1, "x"), (7, "", "First", 1, "x"), (8, "Größe", "Über", 1, "x"), (9, "GRÖSSE", "über", 1, "x"),
        (10, "Été", "Noir", 1, "x"), (11, "Ete", "Noir", 1, "x"), (12, "a" * 20000, "b", 1, "x"), (13, "A" * 20000, "B", 1, "x"), (14, "Same", "same", 1, "x"), (15, "same", "Same", 1, "x"),
    ]
    got = {(r.key_a, r.key_b) for r in d.album_pairs(spark.createDataFrame(rows, ALBUM)).collect()}
    assert got == _brute(rows)
    assert ("1", "2") in got and ("1", "3") in got and ("2", "4") in got and ("1", "4") not in got and ("14", "15") in got


def test_folder_pairs(spark):
    names = [
        "Ann Lee - Old River (1999) [FLAC]", "1999 | ann lee | FLAC | old river", "AnnLeeOldRiver1999FLAC", "Ann Lee - Old River (1999)",
        "Ann Lee - Old River (1991) [FLAC]", "Ann Lee - Old River (1919) [FLAC]", "Old River, Ann Lee, 1999, flac", None, "", "???",
    ]
    df = spark.createDataFrame([(n, 1.0) for n in names], "folder_name string, first_seen double")
    got = {(r.key_a, r.key_b) for r in d.folder_pairs(df).collect()}
    same = [names[0], names[1], names[2], names[6]]
    assert got == {(a, b) for a in same for b in same if a < b}


def test_collapsed_counts_copies_and_empty_tables(spark):
    a = spark.createDataFrame([(1, "A", "B", 1, ""), (2, "a", "b", 1, ""), (3, "A", "B", 1, ""), (4, "C", "D", 1, "")], ALBUM)
    f = spark.createDataFrame([], "folder_name string")
    rows = {r.record: (r.copies, r.writings) for r in d.collapsed(a, f).collect()}
    assert rows == {"A - B": (3, 2), "C - D": (1, 1)}
    assert d.album_pairs(a.limit(0)).count() == 0 and d.folder_pairs(f).count() == 0


def test_made_of_keeps_parts_whole():
    assert d.made_of(["ab", "cd", "1999"], "cd1999ab")
    assert not d.made_of(["ab", "cd"], "abdc")


def test_made_of_reorders_long_lists():
    parts = [f"w{chr(97 + i)}" for i in range(13)]
    assert d.made_of(parts, "".join(reversed(parts)))
    assert not d.made_of(parts, "".join(parts[:-1]) + "zz")
    assert d.made_of(["a", "aa"] * 20, "a" * 60)


def test_classes_follow_chains_of_any_length(spark):
    links = spark.createDataFrame([(f"k{i}", f"k{i + 1}") for i in range(1, 9)] + [("z1", "z2")], "kx string, ky string")
    got = {r.k: r.cls for r in d.closed(links).collect()}
    assert got == {f"k{i}": "k1" for i in range(1, 10)} | {"z1": "z1", "z2": "z1"}
    assert d.closed(links.limit(0)).count() == 0


def test_verification_of_albums_does_not_sort(spark):
    a = spark.createDataFrame([(1, "A", "B", 1, "")], ALBUM)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = d.album_classes(a)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "SortAggregate" not in plan
