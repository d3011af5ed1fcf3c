"""Tables that an operator writes between jobs, kept where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A key is hot when it holds more than one row in so many; then there are fewer hot keys than this, at any size of table.
HOT_SHARE = 1000
#: Characters of text in a shuffle partition.
PART_CHARS = 1 << 25
#: Short rows in a shuffle partition.
PART_ROWS = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where the session names none, a temporary one, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sedge-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Parquet tables of one operator run under the shared folder.

    keep() writes a frame and reads it back: lineage ends there, a lost executor costs no recomputation
    beyond the table, and later joins see true sizes. drop() deletes tables that are no longer read, answer() keeps
    an operator's result and deletes all the rest.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.live: list[DataFrame] = []

    def keep(self, frame: DataFrame, label: str, sweep: bool = False) -> DataFrame:
        """sweep: let go of the shuffle files behind the table, which Spark frees when the driver collects garbage."""
        self.n += 1
        path = f"{self.root}/{self.n}-{label}"
        frame.write.parquet(path)
        kept = self.spark.read.schema(frame.schema).parquet(path)
        kept._sedge_path, kept._sedge_table = path, None
        self.live.append(kept)
        if sweep:
            self.spark._jvm.System.gc()
        return kept

    def keep_joined(self, frame: DataFrame, key: str, wanted: DataFrame, wanted_key: str, make: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
        """Rows of a frame whose key is wanted, made into a table in buckets by wanted_key, which make() must keep equal to key.

        The join deals rows by the hash that buckets go by, so each task writes one bucket and its rows move once;
        later joins on the key move the other side only.
        """
        self.n += 1
        name, path = f"sedge_{uuid.uuid4().hex}", f"{self.root}/{self.n}-{label}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        some = wanted.select(F.col(wanted_key).alias("_wanted")).repartition(buckets, "_wanted").hint("merge")
        dealt = frame.repartition(buckets, key)
        made = make(dealt.join(some, dealt[key] == some["_wanted"], "left_semi"))
        made.write.bucketBy(buckets, wanted_key).sortBy(wanted_key).option("path", path).saveAsTable(name)
        self.spark._jvm.System.gc()
        kept = self.spark.table(name)
        kept._sedge_path, kept._sedge_table = path, name
        self.live.append(kept)
        return kept

    def buckets(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def keep_bucketed(self, frame: DataFrame, key: str, label: str, buckets: int | None = None) -> DataFrame:
        """A table in buckets by a key: what is summed by the key, or by more, stays where it is read.

        The frame comes dealt by the key over as many partitions (buckets() where none are named), so that each task writes one bucket.
        """
        self.n += 1
        name, path = f"sedge_{uuid.uuid4().hex}", f"{self.root}/{self.n}-{label}"
        buckets = buckets or self.buckets()
        frame.write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
        kept = self.spark.table(name)
        kept._sedge_path, kept._sedge_table = path, name
        self.live.append(kept)
        return kept

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        for frame in frames:
            if frame._sedge_table:
                self.spark.sql(f"DROP TABLE IF EXISTS {frame._sedge_table}")
            path = jvm.org.apache.hadoop.fs.Path(frame._sedge_path)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        gone = {f._sedge_path for f in frames}
        self.live = [f for f in self.live if f._sedge_path not in gone]

    def answer(self, frame: DataFrame) -> DataFrame:
        """An operator's result as a table; every other table of the run goes, and the shuffle files behind them."""
        kept = self.keep(frame, "answer", sweep=True)
        self.drop(*(f for f in self.live if f is not kept))
        return kept


def spread(frame: DataFrame) -> DataFrame:
    """A scan of fewer splits than the cluster has cores, dealt over all of them before dear work on its rows; a larger one as it is."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def dealt(frame: DataFrame, turns: int = 4) -> DataFrame:
    """Short rows before dear work on each, dealt over all cores some times: a small file is one row group, whatever splits it has."""
    return frame.repartition(max(turns * frame.sparkSession.sparkContext.defaultParallelism, frame.rdd.getNumPartitions()))


def dealt_by(frame: DataFrame, key: str, rows: int = PART_ROWS, turns: int = 4) -> DataFrame:
    """Short rows dealt by a key over all cores some times, and over more partitions where they would hold more than so many rows each."""
    return frame.repartition(max(turns * frame.sparkSession.sparkContext.defaultParallelism, -(-frame.count() // rows)), key)


def parts_for(frame: DataFrame, text_col: str = "text", most: int = PART_CHARS) -> int:
    """Shuffle partitions that hold a bounded length of text each, the session's at least: a task's memory does not follow the table's size."""
    chars = frame.agg(F.sum(F.length(text_col))).first()[0] or 0
    return max(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // most))


def join_hot(left: DataFrame, right: DataFrame, key: str, hot: Column, how: str = "inner") -> DataFrame:
    """Inner join (or left_semi) with a side that has each key once and knows its hot ones.

    There are fewer than HOT_SHARE hot keys, whatever the size of the tables: they are broadcast, so their many rows
    on the left stay where they lie. The others are shuffled by key.
    """
    few = right.where(hot)
    some = left.join(F.broadcast(few), key, how)
    rest = left.join(F.broadcast(few.select(key)), key, "left_anti").join(right.where(~hot).hint("merge"), key, how)
    return some.unionByName(rest)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what Arrow hands to a Python worker at once: long texts make default batches of 10,000 rows too large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
