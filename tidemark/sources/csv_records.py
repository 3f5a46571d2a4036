"""CSV with line breaks inside quotes, read in parallel; types found in the data.

A reader which must not cut a file inside a quoted text has to read it in one task.  Here every
file is read as lines, cut wherever the engine cuts it.  Whether a piece of a file begins inside
quotes follows from the parity of all quotes before it: one small row per piece (quotes, lines
with an odd number of them), added up in order.  A second pass over the lines then puts the
records together inside its piece; only what hangs over the ends of pieces is exchanged.

Doubled quotes stand for one, so they never change the parity.  Blank lines are no records; a
carriage return before a line break belongs to the break.  Both passes read the same files, which
must not change in between.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.staging import stage

#: Pieces of files whose parities (some 50 bytes each) are sent to all tasks.
MOST_PIECES = 2_000_000

_OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
_PART = "whole boolean, file string, begun bigint, at bigint, head boolean, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")]
    return read.select(*place, F.col("value").alias("line"), quotes.alias("quotes"))


def pieces(lines: DataFrame) -> DataFrame:
    """A row per piece of a file: does it begin ``inside`` quotes, and in which piece that record ``begun``."""
    found = stage(
        lines.groupBy("file", "at").agg(F.sum("quotes").alias("quotes"), F.sum(F.col("quotes") % 2).alias("odd")), "csv-pieces"
    )
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    ends_inside = (F.col("quotes") + F.col("inside").cast("int")) % 2 == 1
    # A record is left open by a piece which did not begin in it, or in which an earlier one ended.
    opens = F.when(ends_inside & (~F.col("inside") | (F.col("odd") > 0)), F.col("at"))
    return placed.withColumn("opens", opens).select("file", "at", "inside", F.last("opens", ignorenulls=True).over(before).alias("begun"))


def read_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """``head, record``: the text of each record of all files of ``path``, line breaks and quotes as they are.

    ``head``: the first record of a file, if files have a header.
    """
    lines = _lines(spark, path)
    listed = pieces(lines).limit(MOST_PIECES + 1).collect()  # a row a piece
    if len(listed) > MOST_PIECES:
        raise ValueError(f"more than {MOST_PIECES} pieces of files; raise spark.sql.files.maxPartitionBytes")
    starts = spark.sparkContext.broadcast({(r.file, r.at): (r.inside, r.begun) for r in listed})

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, inside, begun, head = None, [], False, None, False

        def rest() -> list[tuple]:
            # A piece ends: what is held goes on in the next one.
            file, at = current
            return [(False, file, at if begun is None else begun, at, head, "\n".join(held))] if held else []

        for batch in batches:
            made = []
            files, at, texts = (batch.column(c).to_pylist() for c in ("file", "at", "line"))
            odd = np.asarray(batch.column("quotes").to_numpy(zero_copy_only=False)) % 2 == 1
            for file, start, text, flips in zip(files, at, texts, odd.tolist()):
                if current != (file, start):
                    if current:
                        made += rest()
                    current, held = (file, start), []
                    inside, begun = starts.value[current]
                    begun = begun if inside else None
                    head = header and start == 0
                held.append(text)
                inside ^= flips
                if inside:
                    continue
                record = "\n".join(held)
                if begun is not None:
                    made.append((False, file, begun, start, False, record))
                elif record.removesuffix("\r"):
                    made.append((True, file, start, start, head, record.removesuffix("\r")))
                    head = False
                held, begun = [], None
            if made:
                yield _batch(made)
        if current and (made := rest()):
            yield _batch(made)

    # Written once, so that the lines are put together a single time for both kinds.
    parts = stage(lines.mapInArrow(assemble, _PART), "csv-records", ["whole"])
    cut = parts.where(~F.col("whole")).groupBy("file", "begun")
    joined = cut.agg(F.max("head").alias("head"), F.sort_array(F.collect_list(F.struct("at", "record"))).alias("cut"))
    over = joined.select("head", F.regexp_replace(F.array_join("cut.record", "\n"), "\r$", "").alias("record"))
    return parts.where("whole").select("head", "record").unionByName(over)


def _columns(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def inferred(rows: DataFrame) -> T.StructType:
    """Types in which every value of a column of strings can be read: bigint, double, boolean, else string.

    All rows are looked at, in one aggregation.  A column without values is a string.
    """
    wanted = {"bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
    fits = [
        F.expr(f"count(`{c}`) > 0 and count(`{c}`) = count(try_cast(`{c}` as {kind}))").alias(f"{i}_{kind}")
        for i, c in enumerate(rows.columns)
        for kind in wanted
    ]
    row = rows.agg(*fits).first()
    types = [next((t for kind, t in wanted.items() if row[f"{i}_{kind}"]), T.StringType()) for i in range(len(rows.columns))]
    return T.StructType([T.StructField(c, t) for c, t in zip(rows.columns, types)])


def read_csv_in_parallel(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header in every file; quoted texts may hold line breaks, wherever files are cut.

    Without ``schema`` names come from a header and types from all rows.  Fields which cannot be
    read as their type are null, as with the engine's own reader.
    """
    records = read_records(spark, path)
    rows = records.where(~F.col("head")).select("record")

    def parsed(as_types: T.StructType) -> DataFrame:
        ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in as_types)
        return rows.select(F.from_csv("record", ddl, _OPTIONS).alias("r")).select("r.*")

    if schema is None:
        head = records.where("head").select("record").first()
        names = next(csv.reader(io.StringIO(head.record))) if head else []
        schema = inferred(parsed(_columns(names))) if names else T.StructType([])
    return parsed(schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    names = ["whole", "file", "begun", "at", "head", "record"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
