"""Ranked lexical search of a set of items over all documents, by an automaton of the items' terms.

The terms of the items make an Aho-Corasick automaton, each term between two blanks. A text, A-Z lower-cased and
with a blank for each byte that belongs to no term, is run through it once, and what it puts out are the term
frequencies; the terms lead to their items. No document is indexed and no posting is kept: one scan gives the
number of documents and terms and each term's document frequency, a second one the scores. Tasks keep the best
`top` documents of each item and only those are shuffled.

A term is a longest run of digits, ASCII letters and characters beyond ASCII. With N documents that have a term, L
terms in all, n terms in the document, df documents with a term and tf occurrences of it in the document, its
weight is floor(1000 ln((2 N + 2) / (2 df + 1))), a document's m is 100 - 90 + (90 n N) div L, and a document's
score for an item is the sum over the item's terms of weight * ((1000000000 tf) div (1000 tf + 8 m)), in integers.

Items go in blocks of at most `block` terms, which bounds what is broadcast and what the driver and a worker hold;
each block scans the documents by itself.

Defined cases: a null or empty text, or one without a term, is no document and is found by no item; an item without
terms gives no rows; rows of items with the same id, or with none, are one item with the terms of all; repeated
documents are ranked each; equal scores go by id, without an id last; fewer than `top` documents with a score above
0 are all told; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestat.llm.common import ALNUM, LOWER, ascii_lower, bounded_batches, pieces, text_bytes

TOP = 10
#: Terms of all items of a block; some 1 KB each in the automaton.
BLOCK_TERMS = 100_000
#: Bytes of texts, and scores of documents for items, that a task looks at together.
CHUNK, SCORES = 4 << 20, 1 << 22
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: A byte of a text as the automaton sees it.
_SEEN = np.where(ALNUM, LOWER, 32).astype(np.uint8)


class Block:
    """The terms of some items: their automaton, and the items of each."""

    def __init__(self, items: list[tuple[object, list[str]]], kind: pa.DataType):
        self.ids = pa.array([i for i, _ in items], kind)
        self.terms = sorted({t for _, terms in items for t in terms})
        number = {t: n for n, t in enumerate(self.terms)}
        pairs = np.array(sorted((number[t], n) for n, (_, terms) in enumerate(items) for t in terms), np.int64).reshape(-1, 2)
        self.items, self.first = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.terms) + 1))
        self.automaton = ahocorasick.Automaton()
        for n, term in enumerate(self.terms):
            self.automaton.add_word(f" {term.encode().decode('latin-1')} ", n)  # a character for each byte
        self.automaton.make_automaton()

    def frequencies(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(n of each row, then row, term and tf of what occurs, by row and term)."""
        seen = np.full(len(raw) + len(at), 32, np.uint8)  # a blank before each row, and one at the end
        begin = at + np.arange(len(at))
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        seen[np.arange(len(raw)) + row + 1] = _SEEN[raw]
        starts = np.flatnonzero((seen[1:] != 32) & (seen[:-1] == 32))
        n = np.diff(np.searchsorted(starts, begin))
        found = np.fromiter(self.automaton.iter(seen.tobytes().decode("latin-1")), [("end", np.int64), ("term", np.int64)])
        # a match ends at the blank after its term, which may be the next row's
        key = (np.searchsorted(begin, found["end"], side="left") - 1) * len(self.terms) + found["term"]
        key, tf = np.unique(key, return_counts=True)
        return n, key // len(self.terms), key % len(self.terms), tf


def blocks(items: DataFrame, item_col: str = "item_id", text_col: str = "text", most: int = BLOCK_TERMS) -> Iterator[Block]:
    """Blocks of items with at most `most` terms in all, or one item with more; the driver holds one at a time."""
    terms = F.array_distinct(F.regexp_extract_all(ascii_lower(F.col(text_col).cast("string")), F.lit(TERM), F.lit(0)))
    rows = items.select(F.col(item_col).alias("i"), F.explode(terms).alias("t")).distinct().groupBy("i").agg(F.collect_list("t").alias("t"))
    kind, held, size = to_arrow_type(rows.schema["i"].dataType), [], 0
    for row in rows.toLocalIterator():
        if held and size + len(row.t) > most:
            yield Block(held, kind)
            held, size = [], 0
        held.append((row.i, row.t))
        size += len(row.t)
    if held:
        yield Block(held, kind)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        raw, at = text_bytes(batch.column(1))
        for a, b in pieces(at, CHUNK):
            yield batch.column(0).slice(a, b - a), raw[at[a] : at[b]], at[a : b + 1] - at[a]


def statistics(docs: DataFrame, sent) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of each term of a broadcast block. docs: (id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        df, totals = np.zeros(len(block.terms), np.int64), [0, 0]
        for _, raw, at in _parts(batches):
            n, _, term, _ = block.frequencies(raw, at)
            df += np.bincount(term, minlength=len(df))
            totals[0] += int((n > 0).sum())
            totals[1] += int(n.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], some])), pa.array(np.concatenate([totals, df[some]]).astype(np.int64))], names=["term", "n"])

    # A row for each term of the block at most, and two.
    sums = {r.term: r.n for r in docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    found = np.zeros(len(sent.value.terms), np.int64)
    for term, n in sums.items():
        if term >= 0:
            found[term] = n
    return sums.get(-2, 0), sums.get(-1, 0), found


def _best(rows: pa.Table, top: int) -> pa.Table:
    """The best rows of each item, in order."""
    rows = rows.take(pc.sort_indices(rows, [("item", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_end"))
    item = rows.column("item").to_numpy()
    first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.zeros(0, np.int64)
    place = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
    return rows.filter(pa.array(place < top))


def _scored(sent, weights: np.ndarray, docs: int, terms: int, top: int, id_kind: pa.DataType):
    """Tasks' best documents of each item: (item_id, id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        fan, n_items = np.diff(block.first), len(block.ids)
        best = pa.table({"item": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "id": pa.array([], id_kind)})
        least = np.ones(n_items, np.int64)  # scores that can still be among the best
        for ids, raw, at in _parts(batches):
            n, row, term, tf = block.frequencies(raw, at)
            m = np.array([10 + 90 * x * docs // terms for x in n.tolist()], np.int64)
            part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
            step = max(1, SCORES // n_items)
            for low in range(0, len(n), step):
                high = min(low + step, len(n))
                a, b = np.searchsorted(row, [low, high])
                times = fan[term[a:b]]
                where = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - block.first[term[a:b]], times)
                key, value = np.repeat(row[a:b] - low, times) * n_items + block.items[where], np.repeat(part[a:b], times)
                # sums in doubles, exact since both halves are small
                add = lambda x: np.bincount(key, weights=x, minlength=(high - low) * n_items).astype(np.int64)  # noqa: B023, E731
                score = ((add(value >> 20) << 20) + add(value & ((1 << 20) - 1))).reshape(high - low, n_items)
                doc, item = np.nonzero(score >= least)
                if not len(doc):
                    continue
                new = pa.table({"item": pa.array(item), "score": pa.array(score[doc, item]), "id": ids.take(pa.array(doc + low))})
                best = _best(pa.concat_tables([best, new]), top)
                item = best.column("item").to_numpy()
                full = np.flatnonzero(np.bincount(item, minlength=n_items) == top)
                last = np.searchsorted(item, full, side="right") - 1
                least[full] = best.column("score").to_numpy()[last]
        if len(best):
            yield pa.RecordBatch.from_arrays([block.ids.take(best.column("item").combine_chunks()), best.column("id").combine_chunks(), best.column("score").combine_chunks()], names=["item_id", "id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_col, rank, id_col, score: each item's `top` documents with a score above 0, the highest first.

    Statistics are gathered at once; scores when the result is read.
    """
    spark = docs.sparkSession
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type, item_type = rows.schema["id"].dataType, items.schema[item_col].dataType
    schema = f"item_id {item_type.simpleString()}, id {id_type.simpleString()}, score long"
    out = None
    for block in blocks(items, item_col, item_text_col, block_terms):
        sent = spark.sparkContext.broadcast(block)
        n_docs, n_terms, df = statistics(rows, sent)
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        found = rows.mapInArrow(_scored(sent, weights, n_docs, max(n_terms, 1), top, to_arrow_type(id_type)), schema)
        out = found if out is None else out.unionAll(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("id"))))
    return ranked.where(F.col("rank") <= top).select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")
