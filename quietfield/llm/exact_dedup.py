"""Exact deduplication by a stateful stream over content digests.

A streaming aggregation keeps, for every digest ever seen and without expiry, the smallest stable
identifier, its content locator and the number of rows. The state lives in RocksDB on the executors'
disks and is snapshotted to the shared folder, so its size is bounded by disk, not memory, and a
restarted query or a lost executor goes on from the last committed batch. A row whose digest was seen
before is a hit: its full normalised text is compared with the text found through the stored locator,
and rows that differ in spite of equal digests are grouped again by their whole texts.

Only DataFrame operations run on the executors.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, at_places, cut, placeable, scratch_path, with_groups, with_places, without_places

#: A run's digests reach the stream in about so many micro-batches, so later ones meet state that earlier ones left.
BATCHES = 3
#: RocksDB state with one memory bound for all stores of an executor.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space reserved ahead
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"{SPACE}+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def register(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Run the stateful query over a stream of (digest, id, _file, _row) until its source is used up.

    Each batch's changed entries go to out/batch=N; a batch that is repeated after a failure replaces its
    own folder. Started again with the same checkpoint, the query knows all digests of earlier runs and counts batches on."""
    seen = rows.groupBy("digest").agg(F.min(F.struct("id", "_file", "_row")).alias("keeper"), F.count("*").alias("group_size"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with _settings(rows.sparkSession, STATE_CONF):
        query = seen.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()


LIGHT = "id long, digest string, _file string, _row long"
ENTRY = "digest string, keeper struct<id: bigint, _file: string, _row: bigint>, group_size bigint"


def _names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder of any file system that Spark knows; nothing where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [e.getPath().getName() for e in system.listStatus(at)] if system.exists(at) else []


def _batches(spark: SparkSession, base: str) -> list[int]:
    return [int(n.removeprefix("batch=")) for n in _names(spark, f"{base}/entries") if n.startswith("batch=")]


def _first_batch(spark: SparkSession, base: str, run: str) -> int:
    """The first micro-batch that may hold digests of the run, noted when the run is first started."""
    if "_SUCCESS" not in _names(spark, f"{base}/runs/{run}"):
        spark.createDataFrame([(max(_batches(spark, base), default=-1) + 1,)], "first int").write.mode("overwrite").parquet(f"{base}/runs/{run}")
    return spark.read.schema("first int").parquet(f"{base}/runs/{run}").first()[0]


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, state: str | None = None, earlier: DataFrame | None = None, batches: int = BATCHES, run: str | None = None) -> DataFrame:
    """Per row of docs: (id, keep_id, group_size, kept, digest, _file, _row).

    Equal means equal after white space is normalised; of equal texts the row with the smallest id stays
    (null ids last, repeated ids by place). Null text counts as empty, texts are compared whole, repeated rows count as rows.
    A table without rows gives none.

    state: a shared folder in which digests, the stream's checkpoint and its entries stay for later runs; a run then also knows
    the texts of runs before it. `earlier` holds the documents of those runs, where they lay then, for their texts: a folder with
    earlier runs is refused without it, and so is a hit whose text it does not hold. `run` names the run: started again after a
    failure under its name, with the same docs, it goes on and counts no row twice. A run reads its own digests and what its own
    micro-batches changed, not those of runs before it. Digests and locators alone go through the stream; the texts of hits are fetched by place."""
    spark = docs.sparkSession
    docs, base, run = placeable(docs), state or scratch_path(spark, "dedup"), run or uuid.uuid4().hex
    if not re.fullmatch(r"[A-Za-z0-9][\w.-]*", run):
        raise ValueError(f"a run's name holds letters, digits, '.', '_' and '-' only: {run!r}")
    if state and earlier is None and set(_names(spark, f"{base}/light")) - {run}:
        raise ValueError(f"{state} knows texts of earlier runs; their documents must be given as `earlier`")
    last = F.lit((1 << 63) - 1)
    text = lambda d: with_places(d, normalised(d[text_col]).alias("t"))
    rows = with_places(docs, F.coalesce(docs[id_col].cast("long"), last).alias("id"), digest(normalised(docs[text_col])).alias("digest"))
    first_batch, own_light = _first_batch(spark, base, run), f"{base}/light/{run}"
    if "_SUCCESS" not in _names(spark, own_light):  # the stream starts after a whole table only, so none of its files has been counted
        rows.select("id", "digest", "_file", "_row").write.mode("overwrite").parquet(own_light)
    light = spark.read.schema(LIGHT).parquet(own_light)
    files = len(light.inputFiles())

    if files:
        stream = spark.readStream.schema(LIGHT).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(f"{base}/light/*")
        register(stream, f"{base}/entries", f"{base}/state")
    changed = [f"{base}/entries/batch={k}" for k in _batches(spark, base) if k >= first_batch]
    entries = spark.read.schema(ENTRY).parquet(*changed) if changed else spark.createDataFrame([], ENTRY)
    registry = entries.groupBy("digest").agg(F.min("keeper").alias("keeper"), F.max("group_size").alias("group_size"))

    looked = cut(with_groups(light, registry, "digest", ["id", "_file", "_row"]))
    hits = looked.where("group_size > 1")
    # the text behind each locator that has hits, next to the full text of every hit
    first = F.struct("id", "_file", "_row") == F.col("keeper")
    own = cut(at_places(text(docs), cut(hits.select("id", "_file", "_row", "digest", first.alias("first")))))
    stored = own.where("first").select("digest", F.col("t").alias("kept_text"))
    if earlier is not None:
        older = hits.select("digest", F.col("keeper._file").alias("_file"), F.col("keeper._row").alias("_row")).distinct()
        stored = stored.unionByName(at_places(text(placeable(earlier)), cut(older)).select("digest", F.col("t").alias("kept_text"))).dropDuplicates(["digest"])
    checked = with_groups(own.where("not first"), stored, "digest", ["id", "_file", "_row"])
    differs = cut(checked.where(~F.col("t").eqNullSafe(F.col("kept_text"))).select("id", "_file", "_row", "digest", "t", F.col("kept_text").isNull().alias("lost")))
    lost = differs.where("lost").count()
    if lost:
        raise ValueError(f"`earlier` does not hold the texts that {lost} rows must be compared with")
    if not differs.isEmpty():  # one digest, several texts: the whole texts decide
        each = differs.groupBy("digest", "t").agg(F.min(F.struct("id", "_file", "_row")).alias("own_keeper"), F.count("*").alias("own_size"))
        split = differs.join(each.hint("merge"), ["digest", "t"]).select("id", "_file", "_row", "own_keeper", "own_size")
        fewer = split.join(looked.select("id", "_file", "_row", "digest").hint("merge"), ["id", "_file", "_row"]).groupBy("digest").agg(F.count("*").alias("gone"))
        looked = looked.join(split.hint("merge"), ["id", "_file", "_row"], "left").join(fewer.hint("merge"), "digest", "left").select(
            "id", "_file", "_row", "digest",
            F.coalesce("own_keeper", "keeper").alias("keeper"),
            F.coalesce("own_size", F.col("group_size") - F.coalesce("gone", F.lit(0))).alias("group_size"),
        )
    null = lambda c: F.when(c == last, None).otherwise(c)
    return looked.select(
        null(F.col("id")).alias(id_col), null(F.col("keeper.id")).alias("keep_id"), "group_size",
        (F.struct("id", "_file", "_row") == F.col("keeper")).alias("kept"), "digest", "_file", "_row",
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_duplicates keeps, with all their columns, whatever their names."""
    docs = placeable(docs)
    return without_places(docs, cut(exact_duplicates(docs, id_col, text_col).where("not kept").select("_file", "_row")))


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: the doc_id that stays of its equal texts, their number, the verdict and the digest."""
    out = exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""
