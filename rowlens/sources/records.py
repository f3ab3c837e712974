"""Records of CSV files whose values may hold line breaks, read by byte ranges.

A line break belongs to a value if an odd number of quotes stands before it in its file. So quotes are
counted per byte range first, and their parity is passed on from range to range in the order of the
file. After that each range knows whether it begins inside a value, and every task puts its lines together
on its own. Only the few records that lie across a border travel, as pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowlens.session import stage_table

_PIECES = "file long, block long, place int, heads boolean, opens boolean, record binary"


@dataclass
class Borders:
    """Where the byte ranges of the files begin, and the quotes before them.

    ``starts`` has for each file (by hash) its ranges in order and whether each begins inside a value: nine
    bytes for each range of a file, some megabytes for 100 TB.
    """

    broken: bool = False
    lone_returns: bool = False
    starts: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @property
    def crossed(self) -> bool:
        """Whether any value lies across a border."""
        return any(inside.any() for _, inside in self.starts.values())

    def begins_inside(self, file: int, block: int) -> bool:
        starts, inside = self.starts.get(file, ((), ()))
        at = int(np.searchsorted(starts, block)) if len(starts) else 0
        if at >= len(starts) or starts[at] != block:
            raise RuntimeError(
                "a file was cut into other byte ranges than when its quotes were counted; "
                "set spark.sql.files.minPartitionNum to a fixed number"
            )
        return bool(inside[at])


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block): the lines of a file or folder and the byte range each was read with."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def find_borders(lines: DataFrame) -> Borders:
    """Count quotes per byte range in one scan and pass their parity on.

    Only one row for each byte range is shuffled and sent to the driver. Lone carriage returns are noted, since they
    may end lines too.
    """
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    ranges = lines.groupBy("file", "block").agg(
        (F.sum(quotes) % 2).alias("odd"), F.max(quotes % 2).alias("broken"),
        F.max(F.rtrim(F.col("value"), F.lit("\r")).contains("\r").cast("int")).alias("lone"),
    )
    before = F.sum("odd").over(
        Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    found = ranges.select(
        "file", "block", (F.coalesce(before, F.lit(0)) % 2).cast("boolean").alias("inside"), "broken", "lone"
    ).orderBy("file", "block").toArrow()
    if not found.num_rows:
        return Borders()
    file, block, inside = (np.asarray(found[name]) for name in ("file", "block", "inside"))
    edges = np.flatnonzero(np.diff(file, prepend=file[0] - 1))
    starts = {
        int(file[a]): (block[a:b], inside[a:b]) for a, b in zip(edges, np.append(edges[1:], len(file)))
    }
    return Borders(
        bool(pc.max(found["broken"]).as_py()), bool(pc.max(found["lone"]).as_py()), starts
    )


class _Assembler:
    """Puts the lines of one byte range after the other together."""

    def __init__(self, borders: Borders):
        self.borders = borders
        self.now: tuple[int, int] | None = None
        self.odd = 0
        # Lines of the record that is open, whether it began before this range, and the header's turn.
        self.open: list[bytes] = []
        self.continues = False
        self.heads = False
        self.pieces: list[tuple] = []

    def begin(self, file: int, block: int) -> None:
        self.end()
        self.now = file, block
        self.odd = int(self.borders.begins_inside(file, block))
        self.continues = bool(self.odd)
        self.heads = block == 0

    def end(self) -> None:
        """The range is over: what is open goes on in the next one."""
        if self.now is not None and (self.open or self.continues):
            self._piece(opens=not self.continues)
        self.open, self.continues = [], False

    def _piece(self, opens: bool) -> None:
        place = 1 if opens else 0
        self.pieces.append((*self.now, place, self.heads and opens, opens, b"\n".join(self.open)))
        self.open, self.continues = [], False

    def lines(self, values: pa.Array) -> pa.Array:
        """Records that begin and end in this range; the header is left out."""
        counts = pc.count_substring(values, pattern=b'"').to_numpy(zero_copy_only=False).astype(np.int64)
        after = (self.odd + np.cumsum(counts)) & 1
        before = np.concatenate([[self.odd], after[:-1]])
        self.odd = int(after[-1])
        firsts = np.flatnonzero(before == 0)
        first = int(firsts[0]) if len(firsts) else len(values)
        done: list[bytes] = []
        if first:
            self.open += values.slice(0, first).to_pylist()
            if first < len(values) or not self.odd:
                if self.continues:
                    self._piece(opens=False)
                else:
                    done.append(b"\n".join(self.open))
                    self.open = []
        last = int(firsts[-1]) if len(firsts) and self.odd else len(values)
        if last < len(values):
            self.open = values.slice(last).to_pylist()
        edges = np.append(firsts[firsts < last], last)
        whole = pa.array(done, pa.binary())
        if len(edges) > 1:
            grouped = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)
            whole = pa.concat_arrays([whole, pc.binary_join(grouped, pa.scalar(b"\n", values.type)).cast(pa.binary())])
        while self.heads and len(whole):
            # The header is the first record that is not blank.
            self.heads = not whole[0].as_py().strip()
            whole = whole.slice(1)
        return whole


def _assembled(lines: DataFrame, borders: Borders, pieces: bool) -> DataFrame:
    """The records within single ranges, or else the pieces of the others."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Assembler(borders)

        def of_pieces() -> Iterator[pa.RecordBatch]:
            if pieces and state.pieces:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*state.pieces), kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["file", "block", "place", "heads", "opens", "record"])
            state.pieces.clear()

        for batch in batches:
            values = batch.column(0)
            file, block = (np.asarray(batch.column(k)) for k in (1, 2))
            new = np.concatenate([[True], (file[1:] != file[:-1]) | (block[1:] != block[:-1])])
            edges = np.append(np.flatnonzero(new), len(values)).tolist()
            for a, b in zip(edges, edges[1:]):
                if (file[a], block[a]) != state.now:
                    state.begin(int(file[a]), int(block[a]))
                whole = state.lines(values.slice(a, b - a))
                if not pieces and len(whole):
                    yield pa.RecordBatch.from_arrays([whole], ["record"])
            yield from of_pieces()
        state.end()
        yield from of_pieces()

    raw = lines.select(F.col("value").cast("binary"), "file", "block")
    return raw.mapInArrow(work, _PIECES if pieces else "record binary")


def _stitched(pieces: DataFrame) -> DataFrame:
    """Whole records from pieces: one begins a record, those after it in the file go on with it."""
    staged = stage_table(pieces, "csv_pieces")
    order = Window.partitionBy("file").orderBy("block", "place")
    numbered = staged.withColumn("number", F.sum(F.col("opens").cast("int")).over(order))
    parts = F.sort_array(F.collect_list(F.struct("block", "place", "record")))
    whole = numbered.groupBy("file", "number").agg(parts.alias("parts"), F.max("heads").alias("heads"))
    lines = F.transform("parts", lambda p: p["record"])
    joined = F.aggregate(F.slice(lines, 2, F.size(lines)), F.get(lines, 0), lambda a, b: F.concat(a, F.lit(b"\n"), b))
    return whole.where(~F.col("heads")).select(joined.alias("record"))


def csv_records(lines: DataFrame, borders: Borders) -> DataFrame:
    """``record``: the bytes of each record of the files, headers left out, as ``find_borders`` found them."""
    records = _assembled(lines, borders, pieces=False)
    if borders.crossed:
        records = records.unionAll(_stitched(_assembled(lines, borders, pieces=True)))
    return records


def record_text(record: Column, encoding: str) -> Column:
    """A record as text, without the carriage return at its end; bytes that are not UTF-8 are replaced."""
    text = F.make_valid_utf8(record.cast("string")) if encoding == "UTF-8" else F.decode(record, encoding)
    return F.rtrim(text, F.lit("\r"))
