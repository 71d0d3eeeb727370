"""Exact deduplication with streaming state (operator 5; DataFrame and SQL functions only).

Method: a stream of (digest, id, place) keeps one record for each digest in RocksDB
state, without expiry: the smallest (id, place) seen and how many rows had it. The
state is read back as a table. On every hit, that is every row whose digest another row
had first, the full bytes are compared with those at the retained place; digests
that turn out to stand for different texts are grouped anew by the texts themselves.

A state serves any number of tables, one after another. Beside it lie the arrivals (digest, id
and place of every row so far); texts are not stored again but reread at their places, so the
files of earlier tables must still be there, with the text column of the same name. A
collision is told by the bytes of all rows of its digest, whichever table they came with.

Texts are equal when identical after each run of blanks became one space; null counts
as empty. The row with the smallest id stays, null ids last, then the first stored, so
repeated rows keep exactly one. An empty table gives no rows. Extra columns stay
untouched and may have any name. Texts are compared whole, however long. A table that
arrives twice counts twice.

Scale: the log and the state hold no text. Rows of one digest are folded before the
shuffle into the state, so a text that a third of all rows share costs one record a
task. Joins by digest are plain equi-joins with one row a digest on one side; adaptive
execution splits the other side of a hot digest.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagfield.llm.common import exists, fresh, located, settle
from lagfield.session import scratch

# State on disk, with a bound on the native memory of one executor; a task closes its part of the
# state when it has committed, so what an executor holds does not grow with the number of parts.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
}


def normal(text: Column) -> Column:
    """Null as empty; each run of blanks as one space (a lone space is left where it is)."""
    runs = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), runs, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def absorb(spark: SparkSession, log: str, schema, state: str, digest: str = "digest") -> DataFrame:
    """Stream what is new in the folder ``log`` into the state at ``state``; return the whole state.

    Rows are (digest, record) in, (digest, first, copies) out, ``first`` being the least
    record. The state never expires, and a later call reads only files added since. ``log``
    may be a pattern of folders.
    """
    before = {k: spark.conf.get(k, None) for k in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        arrivals = spark.readStream.schema(schema).parquet(log)
        kept = arrivals.groupBy(digest).agg(F.min("record"), F.count("*"))
        query = (
            kept.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        if not exists(spark, f"{state}/state/0"):  # nothing has ever arrived
            return spark.createDataFrame(
                [], f"digest string, first {schema['record'].dataType.simpleString()}, copies long"
            )
        return (
            spark.read.format("statestore")
            .load(state)
            .select(F.col(f"key.{digest}").alias("digest"), F.col("value.min").alias("first"), F.col("value.count").alias("copies"))
        )
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _record(id_col: str, file: str, row: str) -> Column:
    return F.struct(
        F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(file).alias("file"), F.col(row).alias("row")
    )


def _reread(spark: SparkSession, places: DataFrame, text_col: str) -> DataFrame:
    """(digest, record, body) of the rows of ``places`` (digest, record), read where they were stored."""
    files = [unquote(r.file) for r in places.select("record.file").distinct().collect()]  # names of files only
    own = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    stored = spark.read.parquet(*files).select(normal(F.col(text_col)).alias("body"), own.alias("at"))
    found = stored.join(places, (F.col("at.file") == F.col("record.file")) & (F.col("at.row") == F.col("record.row")))
    return found.select("digest", "record", "body")


def find_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, state: str | None = None
) -> tuple[DataFrame, DataFrame, str, str]:
    """(rows, placed, file, row): what became of each row of ``docs``.

    ``rows`` has digest, record (none, id, file, row), first (the record that stays) and
    copies; ``placed`` is ``docs`` with the columns ``file`` and ``row`` to join it by. ``state``
    is a folder that outlives the call (None: a new one); first and copies are then over all
    tables it has seen, and a row of an earlier table may be the one that stays.
    """
    spark = docs.sparkSession
    kept, state = state is not None, state or scratch(spark, "state")
    file, row = fresh(docs, "at_file"), fresh(docs, "at_row")
    placed = located(docs, file, row)
    texts = placed.select(_record(id_col, file, row).alias("record"), normal(F.col(text_col)).alias("body"))
    arrivals = texts.select(digest(F.col("body")).alias("digest"), "record")
    arrivals.write.parquet(own := f"{state}/arrivals/{uuid.uuid4().hex}")
    log = spark.read.schema(arrivals.schema).parquet(own)
    records = settle(absorb(spark, f"{state}/arrivals/*", log.schema, f"{state}/stream"), "records")
    marked = log.join(records, "digest")

    # Full bytes on hits: every member of a shared digest against the one that stays.
    members = texts.withColumn("digest", digest(F.col("body"))).join(records.where("copies > 1"), "digest")
    # Stated as ranges: an equality would become a join key of one use of the texts, and the
    # two uses would no longer share one shuffle.
    same_place = (
        (F.col("record.row") >= F.col("first.row"))
        & (F.col("record.row") <= F.col("first.row"))
        & (F.col("record.file") >= F.col("first.file"))
        & (F.col("record.file") <= F.col("first.file"))
    )
    stay = members.where(same_place).select("digest", F.col("body").alias("kept_body"))
    if kept:
        # Rows of earlier tables that stay.
        hit = records.where("copies > 1").join(log.select("digest").distinct(), "digest", "left_semi")
        here = log.select(F.col("record").alias("first"))
        earlier = settle(hit.join(here, "first", "left_anti").select("digest", F.col("first").alias("record")), "earlier")
        if not earlier.isEmpty():
            stay = stay.union(_reread(spark, earlier, text_col).select("digest", "body"))
    wrong = settle(
        members.where(~same_place).join(stay, "digest").where("body <> kept_body").select("digest").distinct(),
        "collisions",
    )
    if kept and not wrong.isEmpty():
        # A digest once found to be shared stays so: what its other texts are is known from all arrivals.
        wrong.write.mode("append").parquet(f"{state}/collisions")
    shared = wrong
    if kept and exists(spark, f"{state}/collisions"):
        shared = spark.read.schema(wrong.schema).parquet(f"{state}/collisions").distinct()
    if shared.isEmpty():
        return marked, placed, file, row
    by_text = texts.withColumn("digest", digest(F.col("body"))).join(shared, "digest", "left_semi")
    all_texts = by_text
    if kept:
        everything = spark.read.schema(log.schema).parquet(f"{state}/arrivals/*")
        places = settle(everything.join(shared, "digest", "left_semi"), "shared")
        if places.isEmpty():
            return marked, placed, file, row
        all_texts = _reread(spark, places, text_col)
    least = all_texts.groupBy("digest", "body").agg(F.min("record").alias("first"), F.count("*").alias("copies"))
    regrouped = by_text.join(least, ["digest", "body"]).select("digest", "record", "first", "copies")
    return marked.join(shared, "digest", "left_anti").unionByName(regrouped), placed, file, row


def stays() -> Column:
    """Whether a row of ``find_copies`` is the one of its group that stays."""
    return (F.col("record.file") == F.col("first.file")) & (F.col("record.row") == F.col("first.row"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """The rows of ``docs`` without later copies; every column as it was."""
    rows, placed, file, row = find_copies(docs, id_col, text_col, digest)
    kept = rows.where(stays()).select(F.col("record.file").alias("f"), F.col("record.row").alias("r"))
    return placed.join(kept, (placed[file] == kept.f) & (placed[row] == kept.r), "left_semi").select(*docs.columns)
