"""Best-fit packing by bulk-synchronous rounds.

Documents become token pieces of at most the capacity. In each round all unplaced pieces and all gaps (open sequences)
are put in one order by size. A sweep over that order pairs every piece with the tightest gap that no larger piece
takes: with +1 for a gap and -1 for a piece, a piece's gap is the row before it on its level of the running sum.
Where more pieces than gaps compete, rank in the order decides. Paired gaps shrink, and the next round begins. When the
pieces left hold more than the gaps can, or nothing fitted, the largest of them open new sequences.

The running sum needs no global window: rows of one (size, kind, salt) are interchangeable, so their counts, at most
2 * capacity * SALTS numbers, give each cell's base, and a rank inside the cell does the rest. Nothing else
reaches the driver. State between rounds is a written table in the shared folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shared_path
from .tokens import encoder

#: Ways in which the rows of one size and kind are split.
SALTS = 16
#: Rows of a round that one task takes: few pieces are few tasks, whatever the session's partitions.
ROUND_ROWS = 50_000
#: Pieces up to this many tokens are first strung together, so that rounds stay few.
TINY = 32

PLACES = "item_id long, sequence_id long, offset long"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(tokenizer: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer, "<u4")
        for b in batches:
            out: list[tuple] = []
            for doc, run in zip(b.column("doc_id").to_pylist(), e.encode_batch(b.column("text")), strict=True):
                ids = memoryview(run + end)
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                out += [(doc, k, s, t - s, zlib.crc32(ids[4 * s : 4 * t])) for k, (s, t) in enumerate(zip(cuts, cuts[1:], strict=False))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], list(names))

    return cut


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of every document: all but the first hold exactly `capacity` tokens. Null text is empty: one end id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_pieces(tokenizer, capacity, end_id), PIECES)


def _tasks(df: DataFrame, rows: int) -> DataFrame:
    """The same partitions in tasks of about ROUND_ROWS rows, one for each core at least."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROUND_ROWS)))


def _bases(rows: DataFrame, most: int) -> tuple[DataFrame, int, int, int, dict]:
    """Where each cell of rows, `most` at most, begins in the order by size (descending, gaps first), and totals.

    Gives cells (size, kind, salt, base_sum, base_rank), pieces left, their volume, the gaps' volume, pieces by size.
    """
    counts = sorted(((-r["size"], r["kind"], r["salt"], r["n"]) for r in _tasks(rows.groupBy("size", "kind", "salt").agg(F.count("*").alias("n")), most).collect()))
    cells, run, rank, by_size, gap_volume = [], 0, 0, {}, 0
    for minus, kind, salt, n in counts:
        cells.append((-minus, kind, salt, run, rank))
        if kind == 0:
            run += n
            gap_volume -= minus * n
        else:
            run -= n
            rank += n
            by_size[-minus] = by_size.get(-minus, 0) + n
    frame = rows.sparkSession.createDataFrame(cells, "size int, kind int, salt int, base_sum long, base_rank long")
    return frame, rank, sum(k * v for k, v in by_size.items()), gap_volume, by_size


def best_fit(items: DataFrame, capacity: int) -> DataFrame:
    """Place items (item_id long, unique; size int, 1 to capacity) into sequences: item_id, sequence_id, offset."""
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    rows = items.select(F.col("item_id").alias("id"), F.col("size").cast("int").alias("size"), F.lit(1).alias("kind"))
    rows = rows.withColumn("salt", salt)
    path, stuck, most = shared_path(items.sparkSession, "packing-placed"), False, items.count()  # pieces become gaps or go, so that rows never grow
    while True:
        cells, left, volume, room, by_size = _bases(rows, most)
        if not left:
            break
        opening = max(sum(n for s, n in by_size.items() if 2 * s > capacity), -(-(volume - room) // capacity) if volume > room else 0, -(-volume // capacity) if stuck else 0)
        least = min(by_size)
        in_cell = Window.partitionBy("size", "kind", "salt").orderBy("id")
        ordered = rows.join(F.broadcast(cells), ["size", "kind", "salt"]).withColumn("k", F.row_number().over(in_cell))
        sign = F.when(F.col("kind") == 0, F.col("k")).otherwise(-F.col("k"))
        ordered = _tasks(ordered, most).select(
            "id", "size", "kind", "salt",
            (F.col("base_sum") + sign + F.col("kind")).alias("level"),
            F.struct((-F.col("size")).alias("s"), "kind", "salt", "k").alias("at"),
            ((F.col("kind") == 1) & (F.col("base_rank") + F.col("k") <= opening)).alias("opens"),
        )
        on_level = Window.partitionBy("level").orderBy("at")
        before, after = F.lag(F.struct("id", "size", "kind")).over(on_level), F.lead(F.struct("id", "size", "kind")).over(on_level)
        swept = materialize(_tasks(ordered.select("id", "size", "kind", "salt", "opens", before.alias("gap"), after.alias("taker")), most), "packing-round")
        fits = (F.col("kind") == 1) & (F.coalesce(F.col("gap.kind"), F.lit(1)) == 0)
        taken = (F.col("kind") == 0) & (F.coalesce(F.col("taker.kind"), F.lit(0)) == 1)
        opens = F.col("opens") & ~fits
        here = F.when(fits, capacity - F.col("gap.size")).otherwise(0).cast("long").alias("offset")
        swept.where(fits | opens).select(F.col("id").alias("item_id"), F.when(fits, F.col("gap.id")).otherwise(F.col("id")).alias("sequence_id"), here).write.mode("append").parquet(path)
        kept = swept.select(
            "id", "salt",
            F.when(opens, capacity - F.col("size")).when(taken, F.col("size") - F.col("taker.size")).otherwise(F.col("size")).cast("int").alias("size"),
            F.when(opens, 0).otherwise(F.col("kind")).cast("int").alias("kind"),
            fits.alias("gone"),
        )
        rows = kept.where(~F.col("gone") & ((F.col("kind") == 1) | (F.col("size") >= least))).drop("gone")
        stuck = not opening and swept.where(fits).limit(1).count() == 0
    none = items.sparkSession.createDataFrame([], PLACES)
    none.write.mode("append").parquet(path)
    return items.sparkSession.read.schema(PLACES).parquet(path)


def _bundled(pieces: DataFrame, tiny: int) -> tuple[DataFrame, DataFrame]:
    """String pieces of up to `tiny` tokens together by size; gives (members, items)."""
    whole = F.floor(F.lit(2 * tiny) / F.col("length"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("piece_id"))
    small = pieces.where(F.col("length") <= tiny).withColumn("salt", F.pmod(F.xxhash64("piece_id"), F.lit(SALTS))).withColumn("k", rank - 1)
    small = small.withColumn("slot", F.floor(F.col("k") / whole))
    first = F.min("piece_id").over(Window.partitionBy("length", "salt", "slot"))
    members = small.select("piece_id", "length", first.alias("item_id"), (F.pmod(F.col("k"), whole) * F.col("length")).alias("inner"))
    large = pieces.where(F.col("length") > tiny).select("piece_id", "length", F.col("piece_id").alias("item_id"), F.lit(0).cast("long").alias("inner"))
    return members.unionByName(large), small


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null doc_ids and repeated rows are packed like
    others, a piece for each row; an empty table gives no rows; other columns are ignored.
    """
    pieces = materialize(token_pieces(docs, tokenizer, capacity, end_id).withColumn("piece_id", F.monotonically_increasing_id()), "packing-pieces")
    tiny = max(1, min(TINY, capacity // 4))
    members, _ = _bundled(pieces.where(F.col("length") < capacity), tiny)
    members = materialize(members, "packing-members")
    items = materialize(members.groupBy("item_id").agg(F.sum("length").alias("size")), "packing-items")  # counted, then dealt
    at = members.join(best_fit(items, capacity), "item_id").select("piece_id", "sequence_id", (F.col("offset") + F.col("inner")).alias("offset"))
    full = pieces.where(F.col("length") == capacity).select("piece_id", F.col("piece_id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.join(at.unionByName(full), "piece_id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
