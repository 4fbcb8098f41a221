"""p7: token ids of every text by a public byte-level BPE vocabulary.

Method: distinct-word table. Texts are split into words in the JVM by the
tokenizer's own pattern, each distinct word is encoded once, and the ids are
joined back by position; decoding joins each id with its piece of bytes.

The most frequent words (at most ``HOT_WORDS`` of at most ``HOT_CHARS``
characters, so a few MB whatever the corpus) are broadcast and looked up inside
the row, whole columns at a time: no word that many rows share is ever shuffled,
and a document stays one row. Only the places of all other words are exploded and
meet the table in a shuffled join.

Defined results: null and empty text give an empty list; a text that looks like
a special token is plain text; a repeated row (same doc_id and text) counts
once; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateforge.functions.session import written

TOKENIZER_DIR = os.environ.get("CRATEFORGE_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_50k.tiktoken"
HOT_WORDS, HOT_CHARS = 20_000, 48
#: The published splitting pattern of the vocabulary; (?U) gives \s its Unicode meaning in Java.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranks(directory: str | None = None) -> dict[bytes, int]:
    """Pieces and their ids as published; a fixed table of about 50,000 entries."""
    with open(os.path.join(directory or TOKENIZER_DIR, RANKS), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_LOADED: dict[int, object] = {}


def _core(table):
    """The encoder, built once in each Python worker."""
    if "core" not in _LOADED:
        import tiktoken

        _LOADED["core"] = tiktoken.Encoding("plain", pat_str=r"[\s\S]+", mergeable_ranks=table.value, special_tokens={})._core_bpe
    return _LOADED["core"]


def splits(text: Column) -> Column:
    """Words of a text in order, in the JVM; joined they give the text again."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def encoded_words(words: DataFrame, directory: str | None = None) -> DataFrame:
    """word, n, ids of each distinct word of column ``word``."""
    table = words.sparkSession.sparkContext.broadcast(ranks(directory))

    def encode(batches):
        import pyarrow as pa

        core = _core(table)
        for b in batches:
            t = pa.Table.from_batches([b])
            ids = [core.encode_single_piece(w.encode()) for w in t.column("word").to_pylist()]
            yield from t.append_column("ids", pa.array(ids, pa.list_(pa.int32()))).to_batches()

    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).mapInArrow(encode, "word string, n bigint, ids array<int>")


def _texts(documents: DataFrame) -> DataFrame:
    """doc_id, h, text of every non-empty text; of rows with equal doc_id and text one."""
    docs = documents.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text") != "").select("doc_id", F.xxhash64("text").alias("h"), "text")
    twice = docs.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    # texts are shuffled for this only where a row is repeated at all
    return docs.dropDuplicates(["doc_id", "h"]) if twice else docs


def _looked_up(documents: DataFrame, directory: str | None, with_ids: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, number of ids and, if asked for, the ids with -1 for each other word, the other words in order; word, ids of these)."""
    docs = _texts(documents)
    words = docs.select("doc_id", "h", splits(F.col("text")).alias("words"))
    table = written(encoded_words(words.select(F.explode("words").alias("word")), directory), "words")
    short = table.where(F.length("word") <= HOT_CHARS)
    least = short.select("n").orderBy(F.desc("n")).limit(HOT_WORDS + 1).agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    bar = least["n"] if least["k"] > HOT_WORDS else 0
    is_hot = (F.length("word") <= HOT_CHARS) & (F.col("n") > F.lit(bar))
    hot = [(r.word, r.ids) for r in table.where(is_hot).select("word", "ids").sort("word").collect()]
    shared = documents.sparkSession.sparkContext.broadcast(([w for w, _ in hot], [ids for _, ids in hot] + [[-1]]))

    def look(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known, ids = pa.array(shared.value[0], pa.string()), pa.array(shared.value[1], pa.list_(pa.int32()))
        size = np.array([len(x) for x in shared.value[1]])
        for b in batches:
            lists = b.column(2)
            edge = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten()
            at = pc.index_in(flat, value_set=known)
            rare = at.is_null()
            at = pc.fill_null(at, len(known))
            upto = lambda x, edge=edge: np.concatenate([[0], np.cumsum(x)])[edge].astype(np.int32)
            miss = np.asarray(rare.to_numpy(zero_copy_only=False), bool)
            begin = upto(size[at.to_numpy(zero_copy_only=False)])
            cols = [b.column(0), b.column(1), pa.array(np.diff(begin), pa.int32())]
            cols.append(pa.ListArray.from_arrays(pa.array(begin), ids.take(at).flatten()) if with_ids else pa.nulls(len(b), pa.list_(pa.int32())))
            cols.append(pa.ListArray.from_arrays(pa.array(upto(miss)), flat.filter(rare)))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "n", "ids", "lacking"])

    seen = written(words.mapInArrow(look, "doc_id bigint, h bigint, n int, ids array<int>, lacking array<string>"), "seen")
    return seen, table.where(~is_hot).select("word", "ids")


def _filled(batches):
    """Puts the ids of the other words in their places, whole columns at a time: the k-th gap of a document is for its word at place k."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        ids, got = b.column(1), b.column(2)
        flat, edge = ids.flatten().to_numpy(), ids.offsets.to_numpy() - ids.offsets[0].as_py()
        words = got.flatten()
        order = np.lexsort((words.field("pos").to_numpy(), np.repeat(np.arange(len(b)), np.diff(got.offsets.to_numpy()))))
        pieces = words.field("ids").take(pa.array(order))
        values, length = pieces.flatten().to_numpy(), pieces.value_lengths().to_numpy()
        gap = flat == -1
        size = np.ones(len(flat), np.int64)
        size[gap] = length
        start = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(start[-1], np.int32)
        out[start[:-1][~gap]] = flat[~gap]
        out[np.arange(len(values)) + np.repeat(start[:-1][gap] - np.concatenate([[0], np.cumsum(length)])[:-1], length)] = values
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(start[edge].astype(np.int32)), pa.array(out))], ["doc_id", "ids"])


def token_ids(documents: DataFrame, directory: str | None = None) -> DataFrame:
    """doc_id, ids of every document."""
    seen, rest = _looked_up(documents, directory, True)
    open_ = seen.where(F.size("lacking") > 0)
    asked = open_.select("doc_id", "h", F.posexplode("lacking").alias("pos", "word"))
    got = asked.join(rest, "word").groupBy("doc_id", "h").agg(F.collect_list(F.struct("pos", "ids")).alias("got"))
    filled = open_.select("doc_id", "h", "ids").join(got, ["doc_id", "h"]).select("doc_id", "ids", "got").mapInArrow(_filled, "doc_id bigint, ids array<int>")
    empty = documents.where(F.col("text").isNull() | (F.col("text") == "")).select("doc_id", F.array().cast("array<int>").alias("ids")).distinct()
    return seen.where(F.size("lacking") == 0).select("doc_id", "ids").unionByName(filled).unionByName(empty)


def token_counts(documents: DataFrame, directory: str | None = None) -> DataFrame:
    """doc_id, h (hash of the text), n_tokens of every non-empty text; one row for a repeated row."""
    seen, rest = _looked_up(documents, directory, False)
    asked = seen.select("doc_id", "h", F.explode("lacking").alias("word"))
    more = asked.join(rest.select("word", (F.size("ids") - 1).alias("more")), "word").groupBy("doc_id", "h").agg(F.sum("more").alias("more"))
    total = seen.select("doc_id", "h", "n").join(more, ["doc_id", "h"], "left")
    return total.select("doc_id", "h", (F.col("n") + F.coalesce("more", F.lit(0))).cast("bigint").alias("n_tokens"))


def decoded(ids: DataFrame, directory: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids: every id is joined with its piece; the table of pieces is fixed in size."""
    spark = ids.sparkSession
    pieces = spark.createDataFrame([(i, bytearray(b)) for b, i in ranks(directory).items()], "id int, piece binary")
    one = ids.select("doc_id", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(pieces), "id")
    text = one.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    text = text.select("doc_id", F.decode(F.unhex(F.concat_ws("", F.transform("p", lambda x: F.hex(x["piece"])))), "UTF-8").alias("text"))
    empty = ids.where(F.size("ids") == 0).select("doc_id", F.lit("").alias("text"))
    return text.unionByName(empty)
