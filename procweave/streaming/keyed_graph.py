"""Incremental code graph by keyed state: a stream of procedure versions in, changes of nodes and edges out.

Per procedure the state holds the newest version seen: its time and its edges (as
many as its text names). A micro-batch's versions of a procedure are joined with
it and only the difference leaves the operator: edges added and removed, the node
itself when it appears or goes. The state is a table beside the checkpoint, to which a batch adds the versions it
accepted, in a folder of its own that a repeated batch overwrites; a batch reads only the folders of those before it. A version older than the state's changes nothing, so
files may come late or out of order; the same version again changes nothing, so a
replayed file is harmless. An empty text deletes the procedure; its time is kept, so
that an older version coming later does not bring it back. Equal times are decided by
the content, the same way in every run.

Changes are written as one partition per micro-batch and stream, which a repeated batch
overwrites: the log is exactly-once. :func:`current` folds the log to the graph of now.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from procweave.functions import extract as X
from procweave.operators.analysis import with_identity
from procweave.session import exists

EDGES = "array<struct<edge_type:string,dst:string>>"
_VERSION = f"struct<micros:bigint,gone:boolean,text:string,edges:{EDGES}>"
STATE = f"id string, v {_VERSION}, had {_VERSION}, now boolean"

#: Every so many batches the versions held are written whole, so that a batch reads the last whole and few after it.
WHOLE = 20


def file_versions(spark: SparkSession, path: str, extension: str = "prc") -> DataFrame:
    """Streaming ``(name, source_code, modified_at)``: a row per new file, empty files (deletions) included."""
    raw = (spark.readStream.format("text").option("wholetext", "true")
           .option("pathGlobFilter", f"*.{extension}").option("recursiveFileLookup", "true").load(path))
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return raw.select(F.upper(stem).alias("name"), X.strip_ws("value").alias("source_code"), F.col("_metadata.file_modification_time").alias("modified_at"))


def _facts(versions: DataFrame) -> DataFrame:
    """(id, v): the newest version of each procedure in a batch, with its edges in order."""
    code = F.col("source_code")
    none = F.array().cast(EDGES)

    def named(kind: str, column: str):
        return F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda c: F.struct(F.lit(kind).alias("edge_type"), c.alias("dst")))

    facts = with_identity(versions).select(
        "id", F.unix_micros("modified_at").alias("micros"), F.coalesce(code == "", F.lit(False)).alias("gone"),
        X.called_procedures(code, "static").alias("calls"), X.called_tables(code, "static").alias("tables"))
    edges = F.when(F.col("gone"), none).otherwise(F.array_sort(F.array_distinct(F.concat(named("accesses", "tables"), named("calls", "calls")))))
    facts = facts.select("id", "micros", "gone", edges.alias("edges"))
    # equal times: a deletion first, then the greater text of edges
    text = F.to_json(F.transform("edges", lambda e: F.array(e["edge_type"], e["dst"])))
    return facts.groupBy("id").agg(F.max(F.struct("micros", "gone", text.alias("text"), "edges")).alias("v"))


def _accepted(batch: DataFrame, held: DataFrame, whole: bool) -> DataFrame:
    """(id, v, had, now): versions newer than the one held, with the one held; if ``whole`` the others held too."""
    old = held.groupBy("id").agg(F.max("v").alias("had"))
    both = _facts(batch).withColumnRenamed("id", "_id").join(old, F.col("_id").eqNullSafe(F.col("id")), "full" if whole else "left")
    newer = F.col("v").isNotNull() & (F.col("had").isNull() | (F.col("v") > F.col("had")))
    return (both.select(F.when(F.col("v").isNotNull(), F.col("_id")).otherwise(F.col("id")).alias("id"),
                        F.when(newer, F.col("v")).otherwise(F.col("had")).alias("v"), "had", newer.alias("now"))
            .where(F.lit(whole) | F.col("now")))


def changes(accepted: DataFrame) -> DataFrame:
    """Changes ``(id, dst, edge_type, change, modified_at)`` that newly accepted versions make.

    ``edge_type`` is ``calls``, ``accesses`` or ``node`` (the procedure itself, with ``dst`` its id).
    """
    none = F.array().cast(EDGES)
    before, after = F.coalesce("had.edges", none), F.col("v.edges")
    gone = F.coalesce("had.gone", F.lit(True))

    def marked(edges, change: str):
        return F.transform(edges, lambda e: F.struct(e["dst"].alias("dst"), e["edge_type"].alias("edge_type"), F.lit(change).alias("change")))

    node = F.when(gone != F.col("v.gone"), F.array(F.struct(
        F.col("id").alias("dst"), F.lit("node").alias("edge_type"), F.when(F.col("v.gone"), "removed").otherwise("added").alias("change"))))
    rows = F.concat(marked(F.array_except(before, after), "removed"), marked(F.array_except(after, before), "added"),
                    F.coalesce(node, F.array().cast("array<struct<dst:string,edge_type:string,change:string>>")))
    return (accepted.where("now").select("id", F.explode(rows).alias("c"), F.timestamp_micros("v.micros").alias("modified_at"))
            .select("id", "c.dst", "c.edge_type", "c.change", "modified_at"))


def start(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write the changes of ``stream`` (:func:`file_versions`) as a log under ``out``."""
    kept = f"{checkpoint}/versions"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "manual"
        first = max(number - 1, 0) // WHOLE * WHOLE
        held = [f"{kept}/batch_id={n}" for n in range(first, number) if exists(spark, f"{kept}/batch_id={n}")]
        known = spark.read.schema(STATE).parquet(*held) if held else spark.createDataFrame([], STATE)
        path = f"{kept}/batch_id={number}"
        _accepted(batch, known, number > 0 and number % WHOLE == 0).write.mode("overwrite").parquet(path)
        (changes(spark.read.schema(STATE).parquet(path)).withColumns({"run": F.lit(run), "batch_id": F.lit(number).cast("bigint")})
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "batch_id").parquet(out))

    query = stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if available_now else query.trigger(processingTime="30 seconds")).start()


def current(log: DataFrame) -> DataFrame:
    """``(id, dst, edge_type)`` that the log's changes leave: the last change of each, if it was an addition."""
    last = log.groupBy("id", "dst", "edge_type").agg(F.max(F.struct("modified_at", "batch_id", "change")).alias("v"))
    return last.where("v.change = 'added'").select("id", "dst", "edge_type")
