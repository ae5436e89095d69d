"""Exact deduplication by a stateful stream, built-in functions only.

Method: each row arrives as (digest, stable identifier, content locator). A Structured Streaming aggregation keyed by
digest keeps, in RocksDB on disk and without expiry, the largest identifier, its locator and the number of arrivals.
On a hit (a digest with more than one arrival) the whole normalised text is compared with the retained content, fetched
by its locator; rows that differ in spite of an equal digest are grouped again by their full texts.

Scale: arrivals are thin rows; the aggregation combines before it shuffles, so a key with a third of all rows is no hot
spot. Only texts of hits are shuffled for the comparison: a bitmap of fixed size over the hits' locators (BITMAP_WORDS
rows, broadcast) drops other rows before the shuffle; where it saturates it merely passes more rows. The comparison is
salted by SALT_ROWS rows per key.

Defined cases: null text is empty text; a null doc_id loses to any other; of rows with equal doc_id and text the one
with the largest locator (file, row) is kept and every row is returned; an empty table gives no rows; very long texts
are only hashed and compared; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_az, near_bitmap, prepare, scratch, stash, whole, without_keys

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of one group that are compared with the retained text under one key.
SALT_ROWS = 1024
#: Bytes of arrivals per micro-batch.
BATCH_BYTES = 16 << 30


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def from_files(docs: DataFrame) -> bool:
    """Whether each row is one row of a Parquet file, by the plan: a scan under nothing but projections and filters."""
    node = docs._jdf.queryExecution().analyzed()
    name = lambda x: x.getClass().getSimpleName()
    while name(node) in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return name(node) == "LogicalRelation" and name(node.relation()) == "HadoopFsRelation" and name(node.relation().fileFormat()) == "ParquetFileFormat"


def place(docs: DataFrame) -> Column:
    """File and row number of each row of docs, which come from files."""
    file = docs.metadataColumn("_metadata")
    return F.struct(file.getField("file_path").alias("file"), file.getField("row_index").alias("row"))


def located(docs: DataFrame) -> DataFrame:
    """(doc_id, text, at): at locates a row's content as file and row number. Rows that don't come from files are written first."""
    if not from_files(docs):
        docs = stash(docs.select("doc_id", "text"), "dedup-content")
    return docs.select("doc_id", "text", place(docs).alias("at"))


def stream_state(arrivals: DataFrame, path: str, batch_bytes: int) -> DataFrame:
    """Run the stateful stream over the written arrivals to its end; its keyed state: digest, last (doc_id, at), n."""
    spark, checkpoint = arrivals.sparkSession, scratch(arrivals.sparkSession, "dedup-state")
    keep = F.max(F.struct(F.col("doc_id").alias("id"), "at")).alias("last")
    stream = spark.readStream.schema(arrivals.schema).option("maxBytesPerTrigger", batch_bytes).parquet(path)
    keyed = stream.groupBy("digest").agg(keep, F.count(F.lit(1)).alias("n"))
    own = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores would each reserve megabytes
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
        "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
        "spark.sql.streaming.stateStore.maintenanceInterval": "10s",  # stores of a finished stream are unloaded by it
    }
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        query = keyed.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not query.lastProgress:
        return None
    state = spark.read.format("statestore").load(checkpoint)
    # the values of the state are the aggregation's buffers, in the order of the aggregates
    first, second = state.schema["value"].dataType.names
    return state.select(F.col("key.digest").alias("digest"), F.col("value")[first].alias("last"), F.col("value")[second].alias("n"))


def dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, at (its file and row).

    digest: the key of the state; a weak one costs comparisons, never a wrong group.
    """
    spark = prepare(docs.sparkSession)
    content = located(docs).withColumn("text", lower_az(F.col("text")))
    path = scratch(spark, "dedup-arrivals")
    content.select("doc_id", "at", sha256(F.col("text")).alias("text_sha256"), digest(F.col("text")).alias("digest")).write.option("compression", "zstd").parquet(path)
    schema = spark.read.parquet(path).schema
    arrivals = spark.read.schema(schema).parquet(path)
    state = stream_state(arrivals, path, batch_bytes)
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "at"]
    if state is None:  # no arrivals
        return arrivals.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "at")
    known = stash(arrivals.join(state, "digest"), "dedup-known")
    single = known.where("n = 1").select("doc_id", F.col("last.id").alias("keep_id"), F.col("n").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "at")

    # hits: compare all bytes with the retained content
    hits = known.where("n > 1")
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    thin = hits.select("at", F.col("doc_id").alias("id"), "digest", "text_sha256", "last", "n", F.pmod(F.xxhash64("at"), salts).cast("int").alias("salt"))
    texts = near_bitmap(content.select("at", "text"), hits.select("at"), "at").join(thin, "at")
    kept_text = texts.where("at = last.at").select("digest", F.col("text").alias("kept_text"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    checked = texts.join(kept_text, ["digest", "salt"]).select("at", "id", "digest", "text_sha256", "last", "n", (F.col("text") == F.col("kept_text")).alias("same"), F.when(F.col("text") != F.col("kept_text"), F.col("text")).alias("other"))
    checked = stash(checked, "dedup-checked")
    # a digest shared by different texts: what equals the retained text stays its group, the others group by full text
    if checked.where("not same").isEmpty():
        return single.select(out).unionByName(checked.select(F.col("id").alias("doc_id"), F.col("last.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("at") == F.col("last.at")).alias("kept"), "text_sha256", "at"))
    split = checked.where("not same").groupBy("digest").agg(F.count(F.lit(1)).alias("away"))
    with_kept = checked.where("same").join(split, "digest", "left").select(F.col("id").alias("doc_id"), F.col("last.id").alias("keep_id"), (F.col("n") - F.coalesce("away", F.lit(0))).alias("group_size"), (F.col("at") == F.col("last.at")).alias("kept"), "text_sha256", "at")
    others = checked.where("not same")
    again = others.groupBy("digest", "other").agg(F.max(F.struct("id", "at")).alias("now"), F.count(F.lit(1)).alias("m"))
    regrouped = others.join(again, ["digest", "other"]).select(F.col("id").alias("doc_id"), F.col("now.id").alias("keep_id"), F.col("m").alias("group_size"), (F.col("at") == F.col("now.at")).alias("kept"), "text_sha256", "at")
    return single.select(out).unionByName(with_kept.select(out)).unionByName(regrouped.select(out))


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their columns: those that aren't kept go by an anti join on file and row."""
    if not from_files(docs):
        docs = stash(docs, "dedup-docs")
    gone = stash(dedup(docs).where("not kept").select(F.col("at").alias("place")), "dedup-gone")
    return without_keys(docs.select(whole(docs).alias("whole"), place(docs).alias("place")), gone, "place").select("whole.*")
