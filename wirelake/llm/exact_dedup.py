"""Exact deduplication by a streaming query whose keyed state lives on disk.

Two texts are equal when they are identical after every character of ``[\\x20\\x09-\\x0D]`` is
deleted. A streaming aggregation keyed by the SHA-256 of the normalised text keeps, in RocksDB
state that never expires, the number of rows and of the best row so far its stable identifier and
its content locator (file and place in the file). Rows that hit an existing key are then held
against their group's full normalised bytes; digests under which two texts meet are split again by
the text itself. Every step is a DataFrame operation.

Cases: a null text counts as empty, so null and blank texts form one group. Ties in length go to
the smallest id; a null id loses ties. Rows that repeat an id are rows of their own, of which one
stays. An empty table gives an empty result. Columns of the input other than id and text may have
any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import fresh, materialize, scratch, small_side, with_row_uid

BLANKS = " \t\n\u000b\f\r"
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def best() -> Column:
    """The row of a group that stays: most code points, then smallest id; a null id loses."""
    return F.max(F.struct("n_cp", (-F.col("id")).alias("neg_id"), "uid", "locator")).alias("best")


def keyed_state(rows: DataFrame, max_bytes_per_trigger: int = 64 << 30) -> DataFrame:
    """Run the stateful stream over a written table of (digest, n_cp, id, uid, locator).

    The state is read back from the disk it is kept on: one row per digest.
    """
    spark = rows.sparkSession
    checkpoint, path = scratch(spark, "state"), rows.inputFiles()
    folder = path[0].rsplit("/", 1)[0] if path else None
    if folder is None:
        return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), best())
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        stream = (
            spark.readStream.schema(rows.schema).option("maxBytesPerTrigger", str(max_bytes_per_trigger)).parquet(folder)
            .groupBy("digest")
            .agg(
                F.count(F.lit(1)).alias("group_size"),
                best(),
            )
        )
        query = (
            stream.writeStream.format("noop").outputMode("update")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
        names = state.schema["value"].dataType.names
        return state.select(
            F.col("key.digest").alias("digest"),
            F.col("value").getField(names[0]).alias("group_size"),
            F.col("value").getField(names[1]).alias("best"),
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", check_bytes: bool = True) -> DataFrame:
    """One row per input row: id, uid, digest, keep_id, group_size, kept, locator of the row that stays."""
    docs = _rows(docs, id_col, text_col)
    rows = materialize(
        docs.select(
            "id", "uid", "locator",
            F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("digest"),
            F.char_length(F.coalesce("text", F.lit(""))).alias("n_cp"),
        ),
        "digests",
    )
    state = keyed_state(rows)
    found = rows.select("id", "uid", "digest", "n_cp", "locator").join(
        state.select(
            "digest", "group_size",
            (-F.col("best.neg_id")).alias("keep_id"), F.col("best.uid").alias("keep_uid"), F.col("best.locator").alias("keep_locator"),
        ),
        "digest",
    ).withColumn("kept", F.col("uid") == F.col("keep_uid"))
    if not check_bytes:
        return found
    found = materialize(found, "groups")
    hits = small_side(found.where("group_size > 1").select("id", "uid", "digest"))
    texts = docs.select("id", "uid", normalised(F.col("text")).alias("norm"))
    met = (
        texts.join(hits, (texts["uid"] == hits["uid"]) & texts["id"].eqNullSafe(hits["id"]))
        .select(hits["digest"], "norm").groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
        .where("low <> high").select("digest")
    )
    met = materialize(met, "collided")
    return found if met.isEmpty() else _split_again(found, texts, met)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text, uid and locator; the locator is the file and the row's place in it."""
    uid, locator = fresh(docs, "__uid"), fresh(docs, "__locator")
    marked = with_row_uid(docs, uid, locator)
    return marked.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(uid).alias("uid"), F.col(locator).alias("locator"))


def _split_again(found: DataFrame, texts: DataFrame, met: DataFrame) -> DataFrame:
    """Groups whose digest stands for more than one text, grouped by the text itself."""
    odd = found.join(met, "digest", "left_semi")
    full = odd.join(texts.select("id", "uid", "norm"), (odd["uid"] == texts["uid"]) & odd["id"].eqNullSafe(texts["id"])).select(odd["*"], "norm")
    by_text = full.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"), best())
    again = full.join(by_text, ["digest", "norm"]).select(
        "digest", "id", "uid", "n_cp", "locator", F.col("n").alias("group_size"), (-F.col("best.neg_id")).alias("keep_id"),
        F.col("best.uid").alias("keep_uid"), F.col("best.locator").alias("keep_locator"), (F.col("uid") == F.col("best.uid")).alias("kept"),
    )
    return found.join(met, "digest", "left_anti").unionByName(again)


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    uid = fresh(docs, "__uid")
    marked = with_row_uid(docs, uid)
    own, row = fresh(marked, "__id"), fresh(marked, "__row")
    gone = small_side(exact_dedup(docs, id_col, text_col).where(~F.col("kept")).select(F.col("id").alias(own), F.col("uid").alias(row)))
    return marked.join(gone, (F.col(uid) == F.col(row)) & F.col(id_col).cast("long").eqNullSafe(F.col(own)), "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    found = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
), w AS (
  SELECT doc_id, sha256(n) AS text_sha256,
    first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY n) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
