"""Sessions in packs of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.operators.replay import message_chars, placed, visible
from lodestat.sources.shared import cut_lineage

PACK_ROWS, PACK_CHARS = 200, 300_000
#: Messages of a piece of a session, which one task looks at together.
WIDTH = 4096


def _by_piece(work: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """`work` on all rows of each piece, (session_id, piece) of rows in their order; a piece may lie in several batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def done() -> Iterator[pa.RecordBatch]:
            if held and (made := work(pa.Table.from_batches(held).combine_chunks().to_batches()[0])) is not None:
                yield made

        for batch in batches:
            keys, begin = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), 0
            for i in range(len(keys) + 1):
                if i == len(keys) or keys[i] != (key if i == begin else keys[i - 1]):
                    if i > begin:
                        held.append(batch.slice(begin, i - begin))
                    if i < len(keys):
                        yield from done()
                        held, key, begin = [], keys[i], i
        yield from done()

    return run


def _next_starts(chars: np.ndarray, rows: int, most: int) -> np.ndarray:
    """Where the pack that begins at each message ends: as many messages as fit, one at least."""
    upto, at = np.concatenate([[0], np.cumsum(chars)]), np.arange(len(chars))
    fits = np.searchsorted(upto, upto[:-1] + most, side="right") - 1
    return np.minimum(np.minimum(at + rows, np.maximum(at + 1, fits)), len(chars))


def _exits(rows: int, most: int, width: int):
    """Of a piece and the first messages of the next one: for each place where a pack may begin first, where one begins first in the next piece, and how many begin here."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        piece, n = batch.column(1)[0].as_py(), batch.num_rows
        if n <= width:  # the session's last piece
            return None
        follows = _next_starts(batch.column(3).to_numpy(), rows, most).tolist()
        leaves, packs = [0] * width, [1] * width
        for i in range(width - 1, -1, -1):
            j = follows[i]
            leaves[i], packs[i] = (j - width, 1) if j >= width else (leaves[j], packs[j] + 1)
        entries = np.arange(min(rows, width) if piece else 1)
        session = batch.column(0).take(pa.array(np.zeros(len(entries), np.int64)))
        piece_ = np.full(len(entries), piece, np.int64)
        return pa.RecordBatch.from_arrays([session, *(pa.array(x, pa.int64()) for x in (piece_, entries, piece_ + 1, np.array(leaves)[entries], np.array(packs)[entries]))], names=["session_id", "piece", "entry", "to", "leaves", "packs"])

    return work


def _numbers(rows: int, most: int):
    """The pack of each message of a piece, from where the first pack of the piece begins and its number."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, first = batch.column(4)[0].as_py(), batch.column(5)[0].as_py()
        follows, starts = _next_starts(batch.column(3).to_numpy(), rows, most).tolist(), []
        while at < batch.num_rows:
            starts.append(at)
            at = follows[at]
        begun = np.zeros(batch.num_rows, np.int64)
        begun[starts] = 1
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(6), pa.array((np.cumsum(begun) + first - 1).astype(np.int32))], names=["session_id", "id", "pack"])

    return work


def _with(left: DataFrame, right: DataFrame, how: str = "inner", **columns: str) -> DataFrame:
    """`left` joined with `right`, whose columns get a 2, by session and the equal columns; sessions without an id are one session."""
    other = right.select(*(F.col(c).alias(f"{c}2") for c in right.columns))
    return left.join(other, [F.col("session_id").eqNullSafe(F.col("session_id2")), *(F.col(x) == F.col(f"{y}2") for x, y in columns.items())], how)


def _entries(exits: DataFrame, pieces: int) -> DataFrame:
    """(session_id, piece, entry, first): where the first pack of each piece begins, and its number.

    Where a session's pieces lead is composed with itself, so that a round doubles the pieces that are reached.
    """
    reached = exits.where("piece = 0").select("session_id", "piece", "entry", F.lit(0).cast("long").alias("first"))
    span = 1
    while span < pieces:
        more = _with(reached, exits, piece="piece", entry="entry").select("session_id", F.col("to2").alias("piece"), F.col("leaves2").alias("entry"), (F.col("first") + F.col("packs2")).alias("first"))
        reached = cut_lineage(reached.unionAll(more))
        span *= 2
        if span < pieces:
            exits = cut_lineage(_with(exits, exits, to="piece", leaves="entry").select("session_id", "piece", "entry", F.col("to2").alias("to"), F.col("leaves2").alias("leaves"), (F.col("packs") + F.col("packs2")).alias("packs")))
    return reached


def pack_messages(messages: DataFrame, rows: int = PACK_ROWS, chars: int = PACK_CHARS, width: int = WIDTH) -> DataFrame:
    """A session's visible messages in greedy packs of at most `rows` messages and `chars` characters, one message at least.

    A session is cut into pieces of `width` messages. Where its packs begin in a piece depends on where the last one of
    the piece before ends, one of `rows` places: each piece tells for all of them where it leads, and doubling finds
    which of them hold. Tasks hold one piece; a session in one piece needs no rounds.
    """
    if rows > width:
        raise ValueError("a piece must hold the longest pack")
    sized = visible(messages).select("session_id", "seq", "time_created", F.col("id").alias("message_id"), message_chars(F.col("data"), F.col("type")).alias("chars"))
    place = F.col("place").cast("long")
    own = cut_lineage(placed(sized).select("session_id", F.floor(place / width).alias("piece"), (place % width).alias("at"), "chars", F.col("message_id").alias("id")))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    pieces = own.where("at = 0").agg(F.max("piece")).first()[0] or 0
    if pieces == 0:
        found = own.withColumns({"entry": F.lit(0).cast("long"), "first": F.lit(0).cast("long")})
    else:
        long = own.where("piece = 1 and at = 0").select("session_id")
        ahead = own.where((F.col("piece") > 0) & (F.col("at") < rows)).withColumns({"piece": F.col("piece") - 1, "at": F.col("at") + width})
        looked = own.unionByName(ahead).select("session_id", "piece", "at", "chars")
        looked = _with(looked, long, "left_semi").repartition("session_id", "piece").sortWithinPartitions("session_id", "piece", "at")
        exits = cut_lineage(looked.mapInArrow(_by_piece(_exits(rows, chars, width)), f"session_id {kinds['session_id']}, piece long, entry long, to long, leaves long, packs long"))
        entries = _entries(exits, pieces + 1)
        found = _with(own, entries, "left", piece="piece").withColumns({c: F.coalesce(f"{c}2", F.lit(0).cast("long")) for c in ("entry", "first")})
    in_order = found.repartition("session_id", "piece").sortWithinPartitions("session_id", "piece", "at").select("session_id", "piece", "at", "chars", "entry", "first", "id")
    return in_order.mapInArrow(_by_piece(_numbers(rows, chars)), f"session_id {kinds['session_id']}, id {kinds['id']}, pack int")
