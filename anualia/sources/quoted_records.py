"""Records of separated text files whose quoted cells may hold line breaks.

Files are read in splits, line by line. Whether a line begins inside a quoted cell
depends on all lines before it, so every split is scanned twice. The first scan
gives, for each split, the state at its end for both states at its start; put in a
row over the splits of a file these give the state at every start. The second scan
joins lines to records. A record that goes on in the next split leaves a piece in
each, and the pieces, at most two for each split, are put together by file. No
task holds more than a record of its own and no file is read whole.

A cell is quoted if it begins with a quote; a doubled quote inside is a quote; a
quote elsewhere is a character. Lines end with a line feed, and a carriage return
before it belongs to the end of a record.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anualia.functions.template import with_computed
from anualia.scratch import materialize
from anualia.sources.listing import join_splits, split_row

# Splits that begin inside a cell and may be broadcast.
BROADCAST_SPLITS = 100_000


def _closed(sep: str) -> str:
    return rf'(^|{sep})"(?:[^"]|"")*+"'


def bare_line(line: str, sep: str) -> str:
    """SQL text: the line without its complete quoted cells."""
    return f"CASE WHEN contains({line}, '\"') THEN regexp_replace({line}, r'{_closed(sep)}', '$1') ELSE {line} END"


def left_open(bare: str, sep: str) -> str:
    """SQL text: does a bare line end inside a quoted cell?"""
    return f"(contains({bare}, '\"') AND {bare} RLIKE r'(?:^|{sep})\"')"


def cell_count(bare: str, sep: str) -> str:
    """SQL text: number of cells of a bare record."""
    return f"(length({bare}) - length(replace({bare}, '{sep}', '')) + 1)"


def text_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines as they stand, without a byte order mark: value, file_path, file_block_start, row."""
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(list(paths)).select(
        F.expr("IF(startswith(value, '﻿'), substring(value, 2), value)").alias("value"),
        "_metadata.file_path", "_metadata.file_block_start", split_row().alias("row"),
    )
    return join_splits(lines)


def _with_states(lines: DataFrame, sep: str) -> DataFrame:
    """Add ``opens`` and ``stays``: the state after the line if it begins outside or inside a cell."""
    outside = with_computed(lines, "_out", F.expr(bare_line("value", sep)))
    inside = with_computed(outside, "_in", F.expr(bare_line("concat('\"', value)", sep)))
    return inside.select(
        "file_path", "file_block_start", "row", F.col("value").cast("binary").alias("value"),
        F.expr(left_open("_out", sep)).alias("opens"), F.expr(left_open("_in", sep)).alias("stays"),
    )


def _after(opens: np.ndarray, stays: np.ndarray, start: bool) -> np.ndarray:
    """State after each line. A line sets the state, keeps it, or turns it over."""
    fixed, turns = opens == stays, opens & ~stays
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(opens)), -1))
    turned = turns.cumsum()
    base = np.where(last >= 0, opens[last], start)
    before = np.where(last >= 0, turned[last], 0)
    return base ^ ((turned - before) % 2 == 1)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The batch in parts of one split each, with file and start of the split."""
    path, start = batch.column(0), batch.column(1).to_numpy()
    known = path.dictionary_encode()
    code = known.indices.to_numpy()
    cuts = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (start[1:] != start[:-1])))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows]):
        yield known.dictionary[int(code[a])].as_py(), int(start[a]), batch.slice(a, b - a)


def _flags(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False)


def split_states(lines: DataFrame) -> DataFrame:
    """Per split: file_path, file_block_start, and whether it starts and ends inside a cell."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file_path", "file_block_start", "from_outside", "from_inside"]
        now, ends = None, (False, True)

        def split() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, [*now, *ends]))], schema=schema)

        schema = pa.schema([(names[0], pa.string()), (names[1], pa.int64()), (names[2], pa.bool_()), (names[3], pa.bool_())])
        for path, start, part in (r for batch in batches if batch.num_rows for r in _runs(batch)):
            if (path, start) != now:
                if now:
                    yield split()
                now, ends = (path, start), (False, True)
            opens, stays = _flags(part, 2), _flags(part, 3)
            ends = tuple(bool(_after(opens, stays, state)[-1]) for state in ends)
        if now:
            yield split()

    per_split = lines.select("file_path", "file_block_start", "opens", "stays").mapInArrow(
        scanned, "file_path string, file_block_start long, from_outside boolean, from_inside boolean"
    )
    # The same three kinds as for lines: a split sets the state, keeps it, or turns it over.
    order = W.partitionBy("file_path").orderBy("file_block_start")
    fixed = F.col("from_outside") == F.col("from_inside")
    marked = per_split.select(
        "*", fixed.alias("_fixed"),
        F.sum(F.when(F.col("from_outside") & ~F.col("from_inside"), 1).otherwise(0)).over(order).alias("_turned"),
    )
    last = F.last(F.when(F.col("_fixed"), F.struct("from_outside", "_turned")), ignorenulls=True).over(order)
    ended = marked.select("*", last.alias("_last")).select(
        "file_path", "file_block_start",
        (F.coalesce(F.col("_last.from_outside"), F.lit(False)).cast("int")
         + F.col("_turned") - F.coalesce(F.col("_last._turned"), F.lit(0))).alias("_sum"),
    )
    inside = F.col("_sum") % 2 == 1
    return ended.select(
        "file_path", "file_block_start", F.coalesce(F.lag(inside).over(order), F.lit(False)).alias("starts_inside"), inside.alias("ends_inside")
    )


_PIECE = "file_path string, file_block_start long, row long, kind int, is_first boolean, record binary"
_WHOLE, _HEAD, _TAIL = 0, 1, 2


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records of each split, the end of one begun before it, and the begin of one that goes on after it."""
    now, state, begun, held, first_row, headed = None, False, False, [], 0, False

    def rows(path: str, start: int, row: list[int], kind: list[int], first: list[bool], record: pa.Array) -> pa.RecordBatch:
        n = len(row)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([path] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array(row, pa.int64()),
                pa.array(kind, pa.int32()), pa.array(first, pa.bool_()), record.cast(pa.binary()),
            ],
            names=["file_path", "file_block_start", "row", "kind", "is_first", "record"],
        )

    def rest() -> Iterator[pa.RecordBatch]:
        """What is left of a split when the next one begins."""
        if held:
            kind = _HEAD if begun else _TAIL
            yield rows(*now, [first_row], [kind], [False], pa.array([b"\n".join(held)], pa.binary()))

    for path, start, part in (r for batch in batches if batch.num_rows for r in _runs(batch)):
        if (path, start) != now:
            yield from rest()
            now, held, headed = (path, start), [], start > 0
            state = begun = bool(part.column(6)[0].as_py())
        row, value = part.column(2).to_numpy(), part.column(3)
        after = _after(_flags(part, 4), _flags(part, 5), state)
        state = bool(after[-1])
        stops = np.flatnonzero(~after) + 1
        if not held:
            first_row = int(row[0])
        if not len(stops):
            held.extend(value.to_pylist())
            continue
        starts = np.append(0, stops[:-1])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, stops), pa.int32()), value.slice(0, int(stops[-1])))
        record = pc.binary_join(lists, b"\n")
        if held:
            joined = b"\n".join([*held, record[0].as_py()])
            record = pa.concat_arrays([pa.array([joined], pa.binary()), record.slice(1).cast(pa.binary())])
        rownos = [first_row, *row[starts[1:]].tolist()]
        kinds = [_HEAD if begun else _WHOLE, *[_WHOLE] * (len(stops) - 1)]
        firsts = [False] * len(stops)
        if not headed:  # the first record that is not blank
            full = next((k for k, r in enumerate(record) if r.as_py().strip()), None)
            headed = full is not None
            if headed:
                firsts[full] = True
        yield rows(path, start, rownos, kinds, firsts, record)
        begun = False
        held = value.slice(int(stops[-1])).to_pylist()
        if held:
            first_row = int(row[stops[-1]])
    yield from rest()


def quoted_records(spark: SparkSession, paths: Sequence[str], sep: str) -> tuple[DataFrame, DataFrame]:
    """All records (file_path, file_block_start, row, is_first, record as bytes), and files whose last cell never ends."""
    lines = _with_states(text_lines(spark, paths), sep)
    states = materialize(split_states(lines), "splits")
    unended = states.groupBy("file_path").agg(F.max_by("ends_inside", "file_block_start").alias("open")).where("open").select("file_path")
    inside = states.where("starts_inside").select("file_path", "file_block_start", "starts_inside")
    few = inside.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS
    marked = lines.join(F.broadcast(inside) if few else inside, ["file_path", "file_block_start"], "left").select(
        "file_path", "file_block_start", "row", "value", "opens", "stays", F.coalesce("starts_inside", F.lit(False)).alias("starts_inside")
    )
    if not few:
        marked = marked.repartition("file_path", "file_block_start").sortWithinPartitions("file_path", "file_block_start", "row")
    pieces = join_splits(materialize(marked.mapInArrow(_pieces, _PIECE), "records"))
    whole = pieces.where(F.col("kind") == _WHOLE).drop("kind")
    # A piece that begins a record opens a group; the pieces after it in the file belong to it.
    order = W.partitionBy("file_path").orderBy("file_block_start", "kind")
    group = F.sum(F.when(F.col("kind") == _TAIL, 1).otherwise(0)).over(order)
    parts = pieces.where(F.col("kind") != _WHOLE).withColumn("group", group)
    each = F.sort_array(F.collect_list(F.struct("file_block_start", "kind", F.hex("record").alias("piece"), "row")))
    stitched = parts.groupBy("file_path", "group").agg(each.alias("each")).select(
        "file_path", F.col("each")[0]["file_block_start"].alias("file_block_start"), F.col("each")[0]["row"].alias("row"),
        F.lit(False).alias("is_first"), F.unhex(F.array_join(F.transform("each", lambda p: p["piece"]), "0A")).alias("record"),
    )
    return whole.unionByName(stitched), unended


def record_text(encoding: str) -> Column:
    """The record as text, without the carriage return before its end."""
    return F.regexp_replace(F.decode("record", encoding), "\r$", "")
