"""Sources beyond parquet: SQLite files, search responses kept as JSON, lists in text files, media folders.

Names of tables and columns come from the caller's code, never from data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SQLiteSource(DataSource):
    """``spark.read.format("sqlite").schema(...).option("path", ...).option("table", ...).load()``; bytes stay bytes.

    Split by rowid ranges (option ``partitions``), so that a large table is read
    by many tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SQLiteReader(self.options, schema)


class _SQLiteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.n = int(options.get("partitions", "4"))

    def _connect(self):
        import sqlite3

        con = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        con.text_factory = lambda b: b.decode("utf-8", "replace")
        return con

    def partitions(self):
        con = self._connect()
        low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        con.close()
        if low is None:
            return [_Range(0, -1)]
        step = max(1, -(-(high - low + 1) // self.n))
        return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition):
        con = self._connect()
        names = ", ".join(f'"{n}"' for n in self.schema.fieldNames())
        yield from con.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (partition.low, partition.high))
        con.close()


RESPONSE = "username string, uploadSpeed bigint, files array<struct<filename string, size bigint, length bigint, bitDepth int, sampleRate int>>"


def search_responses(spark: SparkSession, path: str) -> DataFrame:
    """Search responses saved as JSON lines; malformed lines give null fields, not a failure."""
    return spark.read.schema(RESPONSE).option("mode", "PERMISSIVE").json(path)


def folders_of(responses: DataFrame) -> DataFrame:
    """One row for each peer and directory with its files, as the scoring operators expect."""
    from crateforge.functions.text import parent_name

    one = responses.select("username", F.col("uploadSpeed").alias("upload_speed"), F.explode("files").alias("f"))
    g = one.groupBy("username", "upload_speed", parent_name(F.col("f.filename")).alias("directory")).agg(F.sort_array(F.collect_list("f")).alias("files"))
    return g.withColumn("file_count", F.size("files")).withColumn("folder_id", F.xxhash64("username", "directory"))


def lost_list(spark: SparkSession, path: str) -> DataFrame:
    """artist, album of a list with headings ``**Artist** (N albums)`` and entries ``  - entry`` beneath.

    A file is one row, so that the heading of an entry is found within its file
    without ordering lines over the cluster.
    """
    lines = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    from pyspark.sql.window import Window

    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.nullif(F.regexp_extract("line", r"^\*\*(.+?)\*\*", 1), F.lit(""))
    got = lines.withColumn("artist", F.last(head, ignorenulls=True).over(w)).withColumn("album", F.nullif(F.regexp_extract("line", r"^\s+- (.+)$", 1), F.lit("")))
    return got.where("album is not null").groupBy(F.lower("artist").alias("a"), F.lower("album").alias("b")).agg(F.min(F.struct("file", "pos", "artist", "album")).alias("m")).select("m.artist", "m.album")


def media_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and time of the audio files under a folder; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    return df.where(F.lower("path").rlike(r"/[^/.][^/]*\.(?:flac|mp3|m4a|m4b|ogg|opus|wav|aiff?|aac|alac|wma|ape|wv)$"))


PLAN = "route string, route_reason string, candidate struct<path: string, n_audio_files: bigint, scanned_albumartist: string, scanned_album: string>, _bad string"


def write_plan(plan: DataFrame, path: str) -> None:
    """A plan as JSON lines in one folder for each route, so that a reader of one route opens no other."""
    plan.withColumn("r", F.coalesce("route", F.lit("NONE"))).write.partitionBy("r").mode("error").json(path)


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """folder, route, reason of each plan line; lines that are no plan, or name no path, are left out, never an error."""
    lines = spark.read.schema(PLAN).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", True).json(path)
    reason = F.regexp_replace(F.concat(F.coalesce("route", F.lit("")), F.lit(": "), F.coalesce("route_reason", F.lit(""))), "^[: ]+|[: ]+$", "")
    return lines.where(F.col("_bad").isNull() & (F.col("candidate.path") != "")).select(F.regexp_extract("candidate.path", "([^/]*)/*$", 1).alias("folder"), "route", reason.alias("reason"))


class _Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PagedSource(DataSource):
    """``spark.read.format("pages").option("path", folder).load()``: answers of a paged listing, saved as one JSON file a page.

    Each page is one partition; rows are the texts of its results with the number
    of the page. A page without results, or that is no JSON, has no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "page int, place int, item string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PageReader(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        import glob
        import os

        return [_Page(p) for p in sorted(glob.glob(os.path.join(self.path, "page-*.json")))]

    def read(self, partition):
        import json
        import re

        number = re.search(r"page-(\d+)\.json$", partition.path) if partition and partition.path else None
        if number is None:
            return
        try:
            with open(partition.path, encoding="utf-8") as f:
                results = json.load(f).get("results") or []
        except (ValueError, AttributeError):
            results = []
        for k, item in enumerate(results):
            yield int(number[1]), k, json.dumps(item, ensure_ascii=False)


class UpdateSource(DataSource):
    """``spark.readStream.format("updates").option("path", file).load()``: a long-polled stream of updates, kept as JSON lines.

    The offset is the id after the last update, as the service counts; Spark keeps
    it in the checkpoint, so that no update is lost or taken twice.
    """

    @classmethod
    def name(cls) -> str:
        return "updates"

    def schema(self) -> str:
        return "update_id bigint, text string"

    def simpleStreamReader(self, schema: StructType):
        return _UpdateReader(self.options)


class _UpdateReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("most", "100"))

    def initialOffset(self):
        return {"next": 0}

    def _after(self, start: int, end: int | None = None):
        import json

        rows = []
        with open(self.path, encoding="utf-8") as f:
            for line in f:
                try:
                    u = json.loads(line)
                    row = (int(u["update_id"]), str((u.get("message") or {}).get("text") or ""))
                except (ValueError, KeyError, TypeError, AttributeError):
                    continue
                if row[0] >= start and (end is None or row[0] < end):
                    rows.append(row)
        return sorted(set(rows))

    def read(self, start):
        rows = self._after(start["next"])[: self.most]
        return iter(rows), {"next": rows[-1][0] + 1 if rows else start["next"]}

    def readBetweenOffsets(self, start, end):
        return iter(self._after(start["next"], end["next"]))
