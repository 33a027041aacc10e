"""Bounded-space online packing of token sequences into training windows.

Each task keeps a fixed number of open windows. A document's full windows are closed at once; its
remainder goes to the open window it fits best. When none has room, a new window is opened; if all
places are taken, the fullest is emitted first. What is still open when a task ends (at most
`open_windows` windows a task) is merged, best fit in descending size, across groups of tasks; the
`open_windows` emptiest windows of each group go on to a group of groups, until one group is left.

Memory is bounded by `open_windows` windows plus one document; a lost task is computed again from
its input rows and gives the same windows, and the windows are checkpointed before leftovers are
merged, so that both readers see one packing.
"""

from __future__ import annotations

import array
import bisect
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, cut, in_parts, ship
from .wordbpe import LibraryWords, Memo, default_vocabulary

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, window long, offset long, leftover boolean, fill int, ids binary"
GROUP = 8
#: Rows, and bytes of their ids, that a task holds before it hands them on.
MOST_ROWS, MOST_BYTES = 20_000, 4 << 20


class OpenWindows:
    """At most `most` windows that have room; sizes are token counts."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.next = size, most, 0
        self.free: list[tuple[int, int]] = []  # (room, window), ascending
        self.rows: dict[int, list] = {}

    def place(self, n: int):
        """(window, offset, windows closed by this) for n < size ids."""
        closed = []
        at = bisect.bisect_left(self.free, (n, -1))
        if at < len(self.free):
            room, w = self.free.pop(at)
        else:
            if len(self.free) >= self.most:
                closed.append(self.free.pop(0)[1])
            room, w = self.size, self.next
            self.next += 1
            self.rows[w] = []
        if room == n:
            closed.append(w)
        else:
            bisect.insort(self.free, (room - n, w))
        return w, self.size - room, closed


def pack_documents(docs: DataFrame, *, vocabulary: str | None = None, size: int = 2048, open_windows: int = 32, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in windows of `size` ids: one row per piece.

    docs: doc_id, text. Columns: doc_id, start (ids of its document before it), length, ids_crc32 (of the
    piece's ids as little-endian unsigned 32-bit numbers), doc_tokens (the document's ids with end_id),
    sequence_id, offset (in its sequence, gapless from 0), ids (those bytes if with_ids, else null).
    Each id of each document lies in exactly one piece; no window exceeds `size`.

    Null and empty texts are documents of the single end_id. A document longer than `size` fills whole
    windows and leaves one remainder. Repeated rows and ids are packed as often as they occur; a null
    doc_id stays null. An empty table gives no rows; other columns are not read.
    """
    vocabulary = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    ship(spark)

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        library = LibraryWords(vocabulary)
        memo = Memo(lambda w: array.array("I", library.ids(w)).tobytes())
        get, words, end = memo.__getitem__, library.splitter.words, array.array("I", [end_id]).tobytes()
        open_ = OpenWindows(size, open_windows)
        out: list[tuple] = []
        held = 0

        def close(w, leftover):
            nonlocal held
            rows = open_.rows.pop(w)
            held += sum(len(r[5] or b"") for r in rows)
            fill = rows[-1][6] + rows[-1][2]
            out.extend((*r[:5], task, w, r[6], leftover, fill, r[5]) for r in rows)

        def flush():
            nonlocal held
            held = 0
            cols = list(zip(*out)) or [()] * 11
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in PIECES.split(", ")])

        for batch in in_parts(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = b"".join(map(get, words(text or ""))) + end
                n = len(ids) // 4
                for start in range(0, n, size):
                    part = ids[4 * start : 4 * (start + size)]
                    length = len(part) // 4
                    row = (doc_id, start, length, zlib.crc32(part), n, part if with_ids else None)
                    if length == size:
                        w, offset, closed = open_.next, 0, [open_.next]
                        open_.next += 1
                        open_.rows[w] = []
                    else:
                        w, offset, closed = open_.place(length)
                    open_.rows[w].append((*row, offset))
                    for x in closed:
                        close(x, False)
                    if len(out) > MOST_ROWS or held > MOST_BYTES:
                        yield flush()
        for w in sorted(open_.rows):
            close(w, True)
        yield flush()

    pieces = cut(columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES))
    own = F.shiftleft(F.col("task").cast("long"), 32) + F.col("window")
    merged = merge_rounds(pieces.where("leftover and offset = 0").select(own.alias("own"), F.col("fill").cast("long")), size, open_windows)
    moved = pieces.where("leftover").withColumn("own", own).join(merged, "own")
    final = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    return (
        pieces.where("not leftover").withColumn("sequence_id", own).select(final)
        .unionByName(moved.withColumn("offset", F.col("offset") + F.col("base")).select(final))
    )


MERGED = "own long, sequence_id long, base long, total long, goes_on boolean"


def merge_rounds(windows: DataFrame, size: int, open_windows: int) -> DataFrame:
    """own, sequence_id, base for all leftover windows (own: task and window; fill): where each ends up, and at which offset."""
    reach, out, placed = GROUP, windows, None
    while True:
        part = F.floor(F.shiftright("own", 32) / reach).alias("part")
        out = cut(out.select("own", "fill", part).groupBy("part").applyInArrow(lambda t: merge_leftovers(t, size, open_windows), MERGED))
        if placed is None:
            placed = out.select("own", "sequence_id", "base")
        else:
            step = out.select(F.col("own").alias("sequence_id"), F.col("sequence_id").alias("to"), F.col("base").alias("more"))
            placed = placed.join(step, "sequence_id", "left").select(
                "own", F.coalesce("to", "sequence_id").alias("sequence_id"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base")
            )
        last = out.agg(F.max(F.shiftright("own", 32))).first()[0]
        if last is None or last < reach:
            return placed
        reach *= GROUP
        out = out.where("goes_on").select("own", F.col("total").alias("fill"))


def merge_leftovers(table: pa.Table, size: int, open_windows: int) -> pa.Table:
    """Best fit in descending size over at most GROUP times open_windows rows; the emptiest open_windows go on."""
    rows = sorted(zip(table.column("fill").to_pylist(), table.column("own").to_pylist()), key=lambda r: (-r[0], r[1]))
    free: list[tuple[int, int]] = []
    out = []
    for fill, own in rows:
        at = bisect.bisect_left(free, (fill, -1))
        room, seq = free.pop(at) if at < len(free) else (size, own)
        out.append((own, seq, size - room))
        if room > fill:
            bisect.insort(free, (room - fill, seq))
    room = {seq: r for r, seq in free}
    on = {seq for _, seq in free[-open_windows:]}
    cols = list(zip(*((own, seq, base, size - room.get(seq, 0), own == seq and seq in on) for own, seq, base in out))) or [()] * 5
    return pa.table({n: pa.array(c, t) for n, c, t in zip((x.split()[0] for x in MERGED.split(", ")), cols, (pa.int64(),) * 4 + (pa.bool_(),))})


def op3(spark, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 ids; see pack_documents."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
