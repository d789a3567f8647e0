"""Helpers that several corpus operators share: tables, folders all executors see, hashing of words."""

from __future__ import annotations

import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Documents and bytes handed to Python at a time; texts may be long.
ARROW_ROWS, ARROW_BYTES = 512, 32 << 20
ASCII_WHITE = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches of Parquet readers and of Arrow, and so the memory of executors and Python workers, for columns of long texts. The session keeps these settings."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. A local session without one, as in tests, gets a temporary one; a cluster without one is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="runlake-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, what: str, within: str | None = None) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, and readable after an executor is lost."""
    path = f"{within or shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """The written tables of one run, in a folder of their own that goes when its result is written."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"

    def written(self, df: DataFrame, what: str) -> DataFrame:
        return written(df, what, self.folder)

    def result(self, df: DataFrame, what: str) -> DataFrame:
        """`df`, written outside the folder; the folder is deleted."""
        out = written(df, what)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return out


def with_places(docs: DataFrame) -> DataFrame:
    """(doc_id, text, place): what stands for a row among all others, its doc_id as a rule.

    Rows that repeat a doc_id with the same text are one. Of an id with different texts the first, by digest,
    has the id as its place; the others come after all other documents.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    again = written(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return docs.withColumn("place", F.col("doc_id"))
    digest = F.md5(F.coalesce("text", F.lit("")))
    texts = docs.join(sized(again), "doc_id", "left_semi").select("doc_id", digest.alias("digest")).distinct()
    more = texts.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("digest"))).where("nth > 1")
    top = docs.agg(F.max("doc_id").alias("top")).first().top
    more = written(more.select("doc_id", "digest", (F.monotonically_increasing_id() + (top + 1)).alias("other")), "places")
    out = docs.withColumn("digest", digest).join(sized(more), ["doc_id", "digest"], "left")
    return out.select("doc_id", "text", F.coalesce("other", "doc_id").alias("place"))


def n_buckets(docs: DataFrame, bytes_each: int = 64 << 20) -> int:
    """Buckets of a packed exchange of `docs.text`: one for each `bytes_each` of text, but some for each shuffle partition, so that none is large."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    return max(8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bytes_each))


def bucketed(sent: DataFrame, buckets: int):
    """`sent`, grouped by its column `bucket`; where there are so many buckets that they follow the bytes of text, partitions do too, two buckets each."""
    least = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = least if buckets <= 8 * least else -(-buckets // 2)
    return sent.repartition(partitions, "bucket").groupBy("bucket")


def needed_only(df: DataFrame, ids: DataFrame, key: str, limit: int = 2_000_000) -> DataFrame:
    """Rows of `df` whose key is in `ids`: broadcast if a count shows at most `limit` ids (16 MB), else shuffled."""
    n = ids.count()
    return df.join(F.broadcast(ids) if n <= limit else ids.hint("merge"), key, "left_semi")


def sized(df: DataFrame, limit: int = 250_000) -> DataFrame:
    """`df`, a small or written table of a few numbers a row, marked for broadcasting if a count shows at most `limit` rows (10 MB); else as it is. A join of two large sides is left to Spark, which splits skewed keys."""
    return F.broadcast(df) if df.count() <= limit else df


def crc_bucket(column: str, mod: int):
    """crc32(column as text) mod `mod`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


def py_crc_bucket(value, mod: int) -> int:
    return zlib.crc32(str(value).encode()) % mod


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """An invertible scrambling of 64-bit numbers, another for each seed."""
    x = x ^ np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_FACTOR = np.uint64(0xA0761D6478BD642F)


_OF_BYTE = np.random.default_rng(31).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of an array of large strings: sums of a number for each byte times a power for its place."""
    n, raw = len(words), words.buffers()[2]
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
    raw = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw else np.empty(0, np.uint8)
    start, length = ends[:-1] - ends[0], np.diff(ends)
    out = np.zeros(n, np.uint64)
    if len(raw):
        powers = np.cumprod(np.full(int(length.max()), _FACTOR), dtype=np.uint64)
        each = _OF_BYTE[raw] * powers[np.arange(len(raw)) - np.repeat(start, length)]
        some = length > 0
        out[some] = np.add.reduceat(each, start[some])
    return mix(out + length.astype(np.uint64), 21)


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Of each text the hashes of its distinct word shingles, ascending. A-Z count as a-z; fewer words than `width` make one shingle.

    Words are parted by ASCII white space. The distinct words of the array are hashed once each.
    """
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string()).fill_null("")))
    coded = words.flatten().dictionary_encode()
    of_word = word_hashes(coded.dictionary)
    empty = pc.index(coded.dictionary, "").as_py()  # what is before leading white space and after trailing
    codes, starts = coded.indices.to_numpy(), words.offsets.to_numpy()
    if empty >= 0:
        real = codes != empty
        starts, codes = np.append(0, np.cumsum(real))[starts - starts[0]], codes[real]
    else:
        starts = starts - starts[0]
    h = of_word[codes]
    sizes = np.diff(starts)
    # of every place the shingle that starts there; those that run into the next text are cut off below
    n = max(0, len(h) - width + 1)
    rolled = h[:n] + np.uint64(width)
    for i in range(1, width):
        rolled = rolled * _FACTOR + h[i : n + i]
    rolled = mix(rolled, 99)
    out = []
    for start, size in zip(starts[:-1].tolist(), sizes.tolist(), strict=True):
        if size >= width:
            own = np.sort(rolled[start : start + size - width + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif size:
            total = h[start : start + 1] + np.uint64(size)
            for i in range(1, size):
                total = total * _FACTOR + h[start + i : start + i + 1]
            out.append(mix(total, 99))
        else:
            out.append(np.empty(0, np.uint64))
    return out
