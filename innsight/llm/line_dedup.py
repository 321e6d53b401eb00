"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

A run is a Parquet table of (line hash, number of documents), sorted by hash.
Documents arrive in batches. A batch's hashes are merge-anti-joined with the
settled run (keys already known to be frequent), and what is left is added as
a run of its own on level 0. When a level holds ``fanout`` runs they are
compacted into one run of the next level: counts of equal hashes add up, and
keys that reach ``min_docs`` move to the settled run. After the last batch all
levels are compacted, so every key's count covers all documents, and the
settled keys' lines are taken out of every document, early batches included.

The runs stay in their folder, with a manifest that is written after every batch.
``dedup_lines(later, runs=folder)`` opens them again: the later documents' keys are
added to what earlier ones left, and lose the lines that are frequent over all
documents seen so far.

Defined results
* Null or empty text is one empty line. Keys shorter than ``min_chars`` stay.
* A row is a document: repeated rows count as several documents.
* The key is 128 bits of hash; the line itself is never shuffled.
* An empty table gives an empty result. Input columns stay, except those that
  have the name of a result column.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.llm.columns import ascii_lower, other_columns, quoted
from innsight.session import scratch_path

STRIP = " \t\n\x0b\x0c\r"
RUN = "h1 long, h2 long, n long"
MANIFEST = "seq int, level int, path string"      # level -1: settled
RESULTS = ["n_lines", "n_dropped", "kept_text"]


def line_keys(text: Column) -> Column:
    """Array of line keys of a text: stripped, A-Z lower-cased."""
    return F.transform(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n", -1),
                       lambda x: F.btrim(x, F.lit(STRIP)))


def _hashes(key: str) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), F.col(key)).alias("h2")]


class LineRuns:
    """The levelled runs, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2, path: str | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.path = path or scratch_path(spark, "line-runs")
        self.levels: list[list[str]] = [[]]
        self.settled: list[str] = []
        self._n = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, min_docs: int, fanout: int = 2) -> "LineRuns":
        """The runs of a folder as the last finished batch left them; files of a batch that broke off are ignored."""
        runs = cls(spark, min_docs, fanout, path)
        every = spark.read.schema(MANIFEST).parquet(f"{path}/manifest-*")
        rows = every.filter(F.col("seq") == every.agg(F.max("seq")).first()[0]).collect()   # a few paths
        runs._n = rows[0]["seq"]
        for r in sorted(rows, key=lambda r: int(r["path"].split("-")[-2]) if r["path"] else 0):
            if r["level"] == -1:
                runs.settled.append(r["path"])
            elif r["path"]:
                while len(runs.levels) <= r["level"]:
                    runs.levels.append([])
                runs.levels[r["level"]].append(r["path"])
        return runs

    def _record(self) -> None:
        self._n += 1
        rows = [(self._n, -1, p) for p in self.settled] + [
            (self._n, i, p) for i, level in enumerate(self.levels) for p in level]
        self.spark.createDataFrame(rows or [(self._n, 0, None)], MANIFEST).coalesce(1).write.parquet(
            f"{self.path}/manifest-{self._n}-{uuid.uuid4().hex[:8]}")

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], RUN)
        return self.spark.read.schema(RUN).parquet(*paths)

    def _write(self, df: DataFrame, kind: str) -> str:
        self._n += 1
        path = f"{self.path}/{kind}-{self._n}-{uuid.uuid4().hex[:8]}"
        df.sortWithinPartitions("h1", "h2").write.parquet(path)
        return path

    def add(self, batch: DataFrame) -> None:
        """batch: one row per (h1, h2) with its number of documents."""
        if self.settled:
            batch = batch.join(self._read(self.settled).select("h1", "h2").hint("merge"),
                               ["h1", "h2"], "left_anti")
        self.levels[0].append(self._write(batch.select("h1", "h2", "n"), "run"))
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                self._compact(level)
        self._record()

    def _compact(self, level: int) -> None:
        merged = self._read(self.levels[level]).groupBy("h1", "h2").agg(F.sum("n").alias("n"))
        self.settled.append(self._write(merged.filter(F.col("n") >= self.min_docs), "settled"))
        self.levels[level] = []
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(
            self._write(merged.filter(F.col("n") < self.min_docs), "run"))

    def finish(self) -> DataFrame:
        """Keys found in at least ``min_docs`` documents; n is the count when the key settled.

        All levels are compacted for the answer; the runs stay as they are, for further batches."""
        open_runs = [p for level in self.levels for p in level]
        if not open_runs:
            return self._read(self.settled)
        merged = self._read(open_runs).groupBy("h1", "h2").agg(F.sum("n").alias("n"))
        last = self._write(merged.filter(F.col("n") >= self.min_docs), "answer")
        return self._read([*self.settled, last])


def _exists(spark: SparkSession, pattern: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path))


def frequent_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1,
                   batches: int = 4, fanout: int = 2, runs: str | None = None) -> tuple[DataFrame, int]:
    """Keys to drop, and the number of (document, key) pairs of these documents."""
    spark = docs.sparkSession
    runs = LineRuns(spark, min_docs, fanout) if runs is None else (
        LineRuns.open(spark, runs, min_docs, fanout) if _exists(spark, f"{runs}/manifest-*")
        else LineRuns(spark, min_docs, fanout, runs))
    keys = docs.select(
        F.pmod(F.xxhash64(F.col(text)), F.lit(batches)).cast("int").alias("batch"),
        F.explode(F.filter(F.array_distinct(line_keys(F.col(text))),
                           lambda k: F.length(k) >= min_chars)).alias("key"))
    # one pass over the texts; each batch then reads only its own small folder
    path = scratch_path(spark, "line-batches")
    (keys.select("batch", *_hashes("key")).groupBy("batch", "h1", "h2").agg(F.count("*").alias("n"))
     .write.partitionBy("batch").parquet(path))
    hashed = spark.read.schema(RUN + ", batch int").parquet(path)
    for b in range(batches):
        runs.add(hashed.filter(F.col("batch") == b))
    total = hashed.agg(F.sum("n")).first()[0] or 0
    return runs.finish(), total


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10,
                min_chars: int = 1, batches: int = 4, fanout: int = 2,
                heavy_keys: int = 4000, runs: str | None = None) -> DataFrame:
    """Documents with n_lines, n_dropped and kept_text.

    ``runs`` names the folder of the runs, to add these documents to earlier ones
    (a new folder starts empty); without it a fresh folder is used.

    Keys that hold over 1/heavy_keys of all pairs are at most ``heavy_keys``
    in number at any input size; they are broadcast, so that a hot line is
    never sent to one task. The other keys are shuffled, and a row that the
    broadcast has settled gets a key of its own there.
    """
    drop, total = frequent_lines(docs, text, min_docs, min_chars, batches, fanout, runs)
    drop = drop.select("h1", "h2", "n")
    heavy = drop.filter(F.col("n") * heavy_keys >= max(total, 1)).select(
        "h1", "h2", F.lit(True).alias("heavy"))
    light = drop.filter(F.col("n") * heavy_keys < max(total, 1)).select(
        "h1", "h2", F.lit(False).alias("settled"), F.lit(True).alias("light"))

    key = [F.col(doc_id).alias("__id"), F.xxhash64(F.col(text)).alias("__tid")]
    places = docs.select(*key, F.posexplode(line_keys(F.col(text))).alias("at", "key")).filter(
        F.length("key") >= min_chars).select("__id", "__tid", F.col("at").cast("long").alias("at"),
                                             *_hashes("key"))
    places = places.join(F.broadcast(heavy), ["h1", "h2"], "left").select(
        "__id", "__tid", "at", F.col("heavy").isNotNull().alias("settled"),
        F.when(F.col("heavy"), F.xxhash64("__tid", "at")).otherwise(F.col("h1")).alias("h1"), "h2")
    gone = (places.join(light, ["h1", "h2", "settled"], "left")
            .filter(F.col("settled") | F.col("light").isNotNull())
            .groupBy("__id", "__tid").agg(F.collect_set("at").alias("__gone")))

    rest = other_columns(docs, RESULTS)
    left = docs.select(*[quoted(c) for c in rest], *key)
    out = left.join(gone, left["__id"].eqNullSafe(gone["__id"])
                    & (left["__tid"] == gone["__tid"]), "left").select(
        *[left["`" + c.replace("`", "``") + "`"] for c in rest],
        F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias("__lines"), "__gone")
    kept = F.when(F.col("__gone").isNull(), F.array_join("__lines", "\n")).otherwise(
        F.array_join(F.transform(F.array_except(
            F.sequence(F.lit(0).cast("long"), F.size("__lines").cast("long") - 1), "__gone"),
            lambda i: F.get("__lines", i.cast("int"))), "\n"))
    return out.select(*[quoted(c) for c in rest], F.size("__lines").cast("long").alias("n_lines"),
                      F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"),
                      kept.alias("kept_text"))
