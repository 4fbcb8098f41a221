"""p4: duplicates hidden by letter case, whitespace, punctuation or field order.

Method: each normalised (field name, value) pair is hashed, the hashes of a
record are combined by a commutative multiset hash (two lanes of sums), records
are grouped by that fingerprint, and equality of the fields is verified inside a
fingerprint by hashing them, without sorting anything.

Album fields may change places, so both carry one field name. The borders of the
parts of a folder name are often gone, so its hashed values are its single
characters, which no reordering of parts changes; the verification then asks
whether one name is made of the parts of the other, each kept whole.

Exact copies collapse before any comparison: only distinct writings meet inside
a fingerprint. Defined results: rows with a null or empty field are records of
their own and take no part; ties and repeated rows count as copies.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateforge.functions.session import dropped, written

SEEDS = (11, 1_000_003)


def squeezed(s: str | None) -> str:
    """Letters and numbers only, case folded."""
    return "" if s is None else "".join(ch for ch in s.casefold() if unicodedata.category(ch)[0] in "LN")


def _squeeze(batches):
    import pyarrow as pa

    for b in batches:
        t = pa.Table.from_batches([b])
        for name in [x for x in t.column_names if x.startswith("raw_")]:
            t = t.append_column("key_" + name[4:], pa.array([squeezed(x) for x in t.column(name).to_pylist()], pa.string()))
        yield from t.to_batches()


_ASCII = r"^[\x00-\x7F]*$"


def with_keys(df: DataFrame, **raw: str) -> DataFrame:
    """Adds ``key_<n>``: the squeezed value of each raw column; Python sees only rows with non-ASCII text."""
    df = df.select("*", *[F.col(c).cast("string").alias(f"raw_{n}") for n, c in raw.items()])
    easy = F.lit(True)
    for n in raw:
        easy = easy & F.coalesce(F.col(f"raw_{n}").rlike(_ASCII), F.lit(True))
    ascii_rows = df.where(easy).select("*", *[F.lower(F.regexp_replace(F.coalesce(f"raw_{n}", F.lit("")), "[^A-Za-z0-9]", "")).alias(f"key_{n}") for n in raw])
    schema = df.schema
    for n in raw:
        schema = schema.add(f"key_{n}", "string")
    return ascii_rows.unionByName(df.where(~easy).mapInArrow(_squeeze, schema))


def multiset_hash(pairs: list[tuple[str, Column]]) -> Column:
    """Commutative fingerprint of (field name, value) pairs.

    Each lane adds 56-bit hashes, so that up to 128 pairs cannot overflow.
    """
    lanes = []
    for seed in SEEDS:
        total = F.lit(0).cast("bigint")
        for name, value in pairs:
            total = total + F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(name), value), 8)
        lanes.append(total)
    return F.struct(lanes[0].alias("a"), lanes[1].alias("b"))


def char_multiset_hash(name: str, text: Column) -> Column:
    """Commutative fingerprint of (field name, character) pairs of a text of any length."""
    chars = F.split(text, "")

    def lane(seed: int) -> Column:
        hashed = lambda c: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(name), c), 8)
        return F.aggregate(chars, F.lit(0).cast("bigint"), lambda acc, c: (acc + hashed(c)) % F.lit(1 << 61))

    lanes = [lane(seed) for seed in SEEDS]
    return F.struct(lanes[0].alias("a"), lanes[1].alias("b"))


def album_writings(albums: DataFrame) -> DataFrame:
    """id, raw_a, raw_b, key_a, key_b, fp of every row with both fields filled."""
    rows = albums.select(F.col("id"), F.col("albumartist").alias("a0"), F.col("album").alias("b0"))
    keyed = with_keys(rows, a="a0", b="b0").drop("a0", "b0")
    filled = keyed.where((F.trim("raw_a") != "") & (F.trim("raw_b") != ""))
    # a field of signs alone ("???") has no letters to compare: it is its own value
    own = lambda n: F.when(F.col(f"key_{n}") == "", F.concat(F.lit("\u0001"), F.col(f"raw_{n}"))).otherwise(F.col(f"key_{n}"))
    filled = filled.withColumn("key_a", own("a")).withColumn("key_b", own("b"))
    return filled.withColumn("fp", multiset_hash([("name", F.col("key_a")), ("name", F.col("key_b"))]))


def album_classes(albums: DataFrame) -> DataFrame:
    """id, raw_a, raw_b, fp, side: rows of one class have equal (fp, side).

    Fields are verified by hashing, without sorting: rows of a fingerprint are
    grouped by their two fields in fixed order. Where one fingerprint (112 bits)
    holds different fields, their classes are told apart by the fields.
    """
    w = written(album_writings(albums).withColumn("lo", F.least("key_a", "key_b")).withColumn("hi", F.greatest("key_a", "key_b")).drop("key_a", "key_b"), "writings")
    clash = w.groupBy("fp", "lo", "hi").agg(F.count(F.lit(1)).alias("n")).groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp", F.lit(True).alias("clash"))
    side = F.when(F.col("clash"), F.concat_ws("\u0001", "lo", "hi")).otherwise(F.lit(""))
    return w.join(clash, "fp", "left").select("id", "raw_a", "raw_b", "fp", side.alias("side"))


def album_pairs(albums: DataFrame) -> DataFrame:
    """All pairs of differently written copies among albums: key_a < key_b as strings by code point.

    Exact copies are collapsed to a writing first; writings of a class meet each
    other, then each side is expanded to its ids.
    """
    c = written(album_classes(albums), "classes")
    writing = F.xxhash64("raw_a", "raw_b")
    c = c.withColumn("w", writing)
    distinct = c.select("fp", "side", "raw_a", "raw_b", "w").distinct()
    x, y = distinct.alias("x"), distinct.alias("y")
    met = x.join(y, (F.col("x.fp") == F.col("y.fp")) & (F.col("x.side") == F.col("y.side")) & ((F.col("x.raw_a") < F.col("y.raw_a")) | ((F.col("x.raw_a") == F.col("y.raw_a")) & (F.col("x.raw_b") < F.col("y.raw_b")))))
    met = met.select(F.col("x.raw_a").alias("ra"), F.col("x.raw_b").alias("rb"), F.col("y.raw_a").alias("sa"), F.col("y.raw_b").alias("sb"))
    ids = c.select(F.col("id").cast("string").alias("k"), "raw_a", "raw_b")
    left = met.join(ids.select(F.col("k").alias("k1"), F.col("raw_a").alias("ra"), F.col("raw_b").alias("rb")), ["ra", "rb"])
    both = left.join(ids.select(F.col("k").alias("k2"), F.col("raw_a").alias("sa"), F.col("raw_b").alias("sb")), ["sa", "sb"])
    return both.select(F.least("k1", "k2").alias("key_a"), F.greatest("k1", "k2").alias("key_b"))


_SEPARATOR = re.compile(r"\s*[|_+]+\s*|\s+[-–—‐‑]+(?=\s)|[-–—]{2,}|[,;]\s|[\[\](){}\n\t]|\s[-–—]|[-–—]\s")
_YEAR = re.compile(r"(?<![^\W_])((?:19|20)\d\d)(?![^\W_])")
# How a format tag is written at the end of a folder name.
_TAG = re.compile(r"(?<![^\W_])((?:web[\W_]*)?(?:flac|mp3|m4a|ogg|vinyl|cd|web|v0|v2|alac|aac|opus)(?:[\W_]*\d{2,3}(?:[\W_]*\d{2})?)?|16[\W_]?44|24[\W_]?(?:96|48|192)|320)(?![^\W_])", re.I)


def atoms(name: str) -> list[str]:
    """The parts of a folder name as far as separators, years and format tags show them, squeezed."""
    out = []
    for piece in _SEPARATOR.split(name):
        for i, bit in enumerate(_YEAR.split(piece)):
            if i % 2:
                out.append(squeezed(bit))
                continue
            out += [squeezed(x) for x in _TAG.split(bit)]
    return [x for x in out if x]


def made_of(parts: list[str], whole: str) -> bool:
    """``whole`` is ``parts`` in some order, each part once and unbroken."""
    if sum(map(len, parts)) != len(whole):
        return False
    kinds = sorted(set(parts))
    start = (0, tuple(parts.count(k) for k in kinds))
    seen, todo = {start}, [start]
    while todo:
        at, left = todo.pop()
        if at == len(whole):
            return True
        for i, p in enumerate(kinds):
            if left[i] and whole.startswith(p, at):
                after = (at + len(p), left[:i] + (left[i] - 1,) + left[i + 1 :])
                if after not in seen:
                    seen.add(after)
                    todo.append(after)
    return False


def same_record(x: str, y: str) -> bool:
    """One folder name consists of the parts of the other."""
    sx, sy = squeezed(x), squeezed(y)
    return sx == sy or made_of(atoms(x), sy) or made_of(atoms(y), sx)


def _verify(batches):
    import pyarrow as pa

    for b in batches:
        t = pa.Table.from_batches([b])
        ok = [same_record(x, y) for x, y in zip(t.column("rx").to_pylist(), t.column("ry").to_pylist(), strict=True)]
        yield from t.filter(pa.array(ok)).to_batches()


def folder_classes(folders: DataFrame) -> DataFrame:
    """fp, key, cls: the class of each distinct squeezed folder name.

    Names with one squeezed form are one writing and never multiply. A form is
    stood for by its most articulate name (most separators), whose parts the
    others must be made of. Only the orders of the parts of a record make forms
    of one fingerprint, so their number does not grow with the copies. The class
    is the smallest form reached over verified links, followed until nothing
    changes, as names without separators can only meet through others.
    """
    named = with_keys(folders.select("folder_name"), n="folder_name").drop("raw_n").where(F.col("key_n") != "")
    seps = F.length(F.regexp_replace("folder_name", r"[\p{L}\p{N}\s]", ""))
    forms = named.groupBy("key_n").agg(F.max_by("folder_name", F.struct(seps, "folder_name")).alias("said"))
    forms = written(forms.withColumn("fp", char_multiset_hash("char", F.col("key_n"))), "forms")
    x = forms.select("fp", F.col("key_n").alias("kx"), F.col("said").alias("rx"))
    y = forms.select("fp", F.col("key_n").alias("ky"), F.col("said").alias("ry"))
    met = x.join(y, "fp").where(F.col("kx") < F.col("ky"))
    sure = written(met.mapInArrow(_verify, met.schema).select("kx", "ky"), "links")
    return forms.select("fp", F.col("key_n").alias("key")).join(closed(sure).withColumnRenamed("k", "key"), "key", "left").withColumn("cls", F.coalesce("cls", "key"))


def closed(links: DataFrame) -> DataFrame:
    """k, cls: the smallest key that each key of ``links`` (kx, ky) is connected with."""
    both = links.unionByName(links.select(F.col("ky").alias("kx"), F.col("kx").alias("ky")))
    last = written(both.groupBy(F.col("kx").alias("k")).agg(F.least("k", F.min("ky")).alias("cls")), "labels")
    while True:
        cls = last.select("k", "cls")
        # the label of a neighbour, and the label of the own label
        near = both.join(cls.select(F.col("k").alias("ky"), "cls"), "ky").select(F.col("kx").alias("k"), F.col("cls").alias("to"))
        far = cls.join(cls.select(F.col("k").alias("cls"), F.col("cls").alias("to")), "cls").select("k", "to")
        best = near.unionByName(far).groupBy("k").agg(F.min("to").alias("to"))
        now = written(cls.join(best, "k", "left").select("k", F.least("cls", "to").alias("cls"), (F.col("to") < F.col("cls")).alias("moved")), "labels")
        dropped(last)
        if not now.where("moved").limit(1).count():
            return now.select("k", "cls")
        last = now


def folder_pairs(folders: DataFrame) -> DataFrame:
    """All pairs of differently written copies among held folders, key_a < key_b by code point."""
    named = with_keys(folders.select("folder_name").distinct(), n="folder_name").drop("raw_n").where(F.col("key_n") != "")
    member = written(named.join(folder_classes(folders).select(F.col("key").alias("key_n"), "cls"), "key_n").select("cls", "folder_name"), "members")
    x, y = member.alias("x"), member.alias("y")
    met = x.join(y, (F.col("x.cls") == F.col("y.cls")) & (F.col("x.folder_name") < F.col("y.folder_name")))
    return met.select(F.col("x.folder_name").alias("key_a"), F.col("y.folder_name").alias("key_b"))


def collapsed(albums: DataFrame, folders: DataFrame) -> DataFrame:
    """One record for each class with the number of its copies: tbl, record, copies, writings."""
    a = album_classes(albums).groupBy("fp", "side").agg(F.min(F.struct("id", "raw_a", "raw_b")).alias("m"), F.count(F.lit(1)).alias("copies"), F.count_distinct("raw_a", "raw_b").alias("writings"))
    a = a.select(F.lit("albums").alias("tbl"), F.concat_ws(" - ", "m.raw_a", "m.raw_b").alias("record"), "copies", "writings")
    named = with_keys(folders.select("folder_name"), n="folder_name").drop("raw_n")
    f = named.join(folder_classes(folders).select(F.col("key").alias("key_n"), "cls"), "key_n").groupBy("cls").agg(F.min("folder_name").alias("record"), F.count(F.lit(1)).alias("copies"), F.count_distinct("folder_name").alias("writings"))
    return a.unionByName(f.select(F.lit("held_folders").alias("tbl"), "record", "copies", "writings"))
