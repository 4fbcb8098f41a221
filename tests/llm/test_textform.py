from crateforge.llm import textform as t


def test_plain_forms():
    assert t.plain("Ｋｏｌ") == "Kol" and t.plain("e\u0301") == "\u00e9" and t.plain("a\u00a0b\u2009c") == "a b c"
    assert t.plain("a\u200bb\u00ad\ufeff") == "ab" and t.plain("ﬁx") == "fix" and t.plain("a‑b") == "a-b"
    for kept in ("3½", "x²", "ª", "°", "’", "–", "“a”", "夜の", "Ночь", "a\tb\nc", "", "x̂"):
        assert t.plain(kept) == kept


def test_scripts_only_in_mixed_tokens():
    assert t.loosely("Mоntаrem") == "Montarem"
    assert t.loosely("Игoрь") == "Игорь"
    assert t.loosely("夜のMonta") == "夜のMonta"
    assert t.loosely("Ансамбль Kolmer") == "Ансамбль Kolmer"
    assert t.loosely("The Pt. І") == "The Pt. I"


def test_consistent_needs_vocabulary(spark):
    rows = [("albums", "1", "album", "Mоntаrem"), ("albums", "2", "album", "Zеlkar"), ("albums", "3", "album", None), ("albums", "4", "album", ""), ("albums", "4", "album", ""), ("albums", "5", "album", "e\u0301" * 5000)]
    texts = spark.createDataFrame(rows, "tbl string, row_key string, field string, text string")
    vocab = spark.createDataFrame([("a montarem b",), (None,)], "text string")
    got = {(r.row_key, r.form, r.changed) for r in t.consistent(texts, vocab).collect()}
    assert got == {("1", "Montarem", True), ("2", "Zеlkar", False), ("3", None, False), ("4", "", False), ("5", "é" * 5000, True)}
    assert t.consistent(texts, vocab).count() == len(rows)
    assert t.consistent(texts.limit(0), vocab.limit(0)).count() == 0
