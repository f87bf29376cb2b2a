"""Benchmark decontamination with suffix arrays of training shards.

Each task turns a shard of the corpus (some MB of whole documents) into word numbers, sorts the suffixes
that could hold a match into a suffix array, and binary-searches every suffix of the benchmark in it. Only
the benchmark travels: in blocks, each a file that an executor fetches once and its workers map into memory,
so that a worker's memory doesn't grow with the benchmark. All blocks are searched in one pass; documents are
never shuffled, and the words of a document are hashed once for all blocks.

A training suffix is sorted only if the words that follow are benchmark words for at least as long as the
shortest window, since no other suffix can hold one. This leaves out no match.

Defined cases: a null or empty text has no words and is clean; a null `item_id` counts as the empty
string; items of one text are all reported; repeated documents are judged row by row; extra columns of
either table are ignored, or passed on by `decontaminate`; without a benchmark all documents are clean.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm.common import ALNUM, LOWER, Shipped, WordHasher, bounded_batches, pieces, text_bytes

#: Bytes of one shard.
SHARD_BYTES = 1_000_000
#: Bytes of benchmark text in one block.
BLOCK_BYTES = 16_000_000
#: Hits that are looked at together, about.
HITS = 200_000

#: What is told of a match.
_MATCH = ("item_id", "item_word", "doc_word", "n_words")
_FOUND = ("long", "array<struct<begin:long,stop:long>>", "array<string>", "array<struct<item_id:string,item_word:long,doc_word:long,n_words:long>>")


def _searched(text: np.ndarray, text_at: np.ndarray, suffixes: np.ndarray, tests: np.ndarray, test_at: np.ndarray, length: np.ndarray, after: bool) -> np.ndarray:
    """For each test suffix cut to `length` words, how many suffixes of the array sort before it (after: or start with it)."""
    low, high = np.zeros(len(test_at), np.int64), np.full(len(test_at), len(suffixes), np.int64)
    while (active := low < high).any():
        middle = (low + high) // 2
        place = suffixes[np.minimum(middle, len(suffixes) - 1)]
        order = np.zeros(len(test_at), np.int8)  # of the text's suffix against the test's
        undecided, depth = np.flatnonzero(active), 0
        while len(undecided):
            undecided = undecided[depth < length[undecided]]
            mine, other = text[text_at[place[undecided]] + depth], tests[test_at[undecided] + depth]
            order[undecided] = np.sign(mine.astype(np.int64) - other)
            undecided, depth = undecided[mine == other], depth + 1
        right = active & ((order < 0) | ((order == 0) & after))
        low, high = np.where(right, middle + 1, low), np.where(active & ~right, middle, high)
    return low


#: Numbers words alike for all blocks and documents.
HASHER = WordHasher(ALNUM, LOWER)


class SuffixSearch:
    """One benchmark block, ready to be searched in suffix arrays of training shards.

    Its arrays are read by name from `arrays`: a dict, or a file that is mapped into memory.
    """

    def __init__(self, items: Iterable[tuple[str, str]], window: int):
        ids, texts = [], []
        for item, text in items:
            ids.append(item.encode())
            texts.append(text.encode())
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), _offsets(texts)
        begin, end, counts = HASHER.spans(data, offsets)
        vocabulary, where, numbers = np.unique(HASHER.hashes(data, begin, end), return_index=True, return_inverse=True)
        maybe = np.zeros(1 << 20, bool)
        maybe[(vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        # tests: the items' word numbers, each item followed by a 0
        first = np.concatenate([[0], np.cumsum(counts + 1)]).astype(np.int64)
        tests = np.zeros(int(first[-1]) + 1, np.int64)
        owner = np.repeat(np.arange(len(counts)), counts)
        tests[np.arange(len(begin)) + owner] = numbers + 1
        starts, lengths, owners = [], [], []
        for item, n in enumerate(counts.tolist()):
            if n:
                k = max(1, n - window + 1)
                starts.append(first[item] + np.arange(k))
                lengths.append(np.full(k, min(n, window)))
                owners.append(np.full(k, item))
        none = [np.zeros(0, np.int64)]
        at, length, owner = (np.concatenate(x or none).astype(np.int64) for x in (starts, lengths, owners))
        self.least = int(length.min()) if len(length) else 0
        self.deepest = int(counts.max()) if len(counts) else 0
        self.arrays = {
            "ids": np.frombuffer(b"".join(ids), np.uint8), "id_at": _offsets(ids), "vocabulary": vocabulary, "maybe": maybe,
            "text": LOWER[data], "word_begin": begin[where], "word_end": end[where],
            "tests": tests, "item_start": first[:-1], "at": at, "length": length, "owner": owner,
        }

    def shipped(self, spark: SparkSession) -> SuffixSearch:
        """The same, with its arrays in a file for the executors."""
        self.arrays = Shipped(spark, self.arrays)
        return self

    def __getattr__(self, name: str) -> np.ndarray:
        if name.startswith("_") or name == "arrays":
            raise AttributeError(name)
        return self.arrays[name]

    def id_of(self, item: int) -> str:
        at = self.id_at
        return self.ids[at[item] : at[item + 1]].tobytes().decode()

    def word(self, number: int) -> bytes:
        """The bytes of a word by its number, from 1."""
        return self.text[self.word_begin[number - 1] : self.word_end[number - 1]].tobytes()

    def _numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers from 1, and 0 for words that the block doesn't have."""
        out = np.zeros(len(hashes), np.int64)
        likely = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(likely):
            place = np.minimum(np.searchsorted(self.vocabulary, hashes[likely]), len(self.vocabulary) - 1)
            known = self.vocabulary[place] == hashes[likely]
            out[likely[known]] = place[known] + 1
        return out

    def _suffix_array(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The order of the suffixes that start at `at`, by doubling the sorted prefix until nothing ties or no item is longer."""
        rank, width, most = text.astype(np.int64), 1, int(text.max(initial=0))
        while width < max(self.deepest, 1):
            further = np.zeros(len(rank), np.int64)
            further[: max(0, len(rank) - width)] = rank[width:]
            kinds, rank = np.unique(rank * (most + 1) + further, return_inverse=True)
            width, most = width * 2, len(kinds)
            if len(kinds) == len(text):
                break
        return np.argsort(rank[at], kind="stable")

    def shard(self, words: Words) -> tuple[np.ndarray, list, np.ndarray]:
        """Which words of the shard are in a match, (row, item id) pairs, and the longest verbatim matches.

        Of a match: row, number of the item, first word in the item and in the document, number of words.
        """
        begin, counts = words.begin, words.counts
        matches, hit_words = [np.zeros((5, 0), np.int64)], np.zeros(len(begin), bool)
        if not self.least or not len(begin):
            return hit_words, [], matches[0]
        numbers = self._numbers(words.hashes)
        first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        inside = numbers > 0
        before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        full = counts > 0
        before[first[:-1][full]] = False
        after[first[1:][full] - 1] = False
        run_from, run_to = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        keep = run_to - run_from >= self.least
        run_from, size = run_from[keep], (run_to - run_from)[keep]
        if not len(size):
            return hit_words, [], matches[0]
        run = np.repeat(np.arange(len(size)), size)
        where = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + run_from[run]  # word index in the shard
        spot = np.arange(len(where)) + run
        text = np.zeros(len(where) + len(size) + self.deepest + 1, np.int64)
        text[spot] = numbers[where]
        left = np.repeat(np.cumsum(size), size) - np.arange(len(where))
        can = left >= self.least
        at, where = spot[can], where[can]
        suffixes = self._suffix_array(text, at)
        tests, test_at, length, owner, item_start = self.tests, self.at, self.length, self.owner, self.item_start
        low = _searched(text, at, suffixes, tests, test_at, length, False)
        n = _searched(text, at, suffixes, tests, test_at, length, True) - low
        first_hit = np.cumsum(n) - n
        checked, wrong = np.zeros(len(numbers), bool), np.zeros(len(numbers), bool)
        mark, pairs = np.zeros(len(numbers) + 1, np.int64), [np.zeros(0, np.int64)]
        # Words that repeat give a hit for each pair of places: hits are expanded so many at a time.
        for chosen in np.split(np.arange(len(n)), np.flatnonzero(np.diff(first_hit // HITS)) + 1):
            size = n[chosen]
            test = np.repeat(chosen, size)
            hit = suffixes[np.arange(len(test)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[chosen], size)]
            place, word, start = at[hit], where[hit], test_at[test]
            longest = length[test].copy()
            # of a longer match only its first hit goes on
            leads = (start == item_start[owner[test]]) | (tests[start - 1] != text[place - 1]) | (place == 0)
            growing = np.flatnonzero(leads)
            while len(growing):
                mine, other = text[place[growing] + longest[growing]], tests[start[growing] + longest[growing]]
                growing = growing[(mine == other) & (mine > 0)]
                longest[growing] += 1
            # Hashes stand for words: each word of a match is compared itself, once.
            touched = np.zeros(len(numbers) + 1, np.int64)
            np.add.at(touched, word, 1)
            np.add.at(touched, word + longest, -1)
            for w in np.flatnonzero((np.cumsum(touched)[:-1] > 0) & ~checked).tolist():
                checked[w], wrong[w] = True, words.word(w) != self.word(numbers[w])
            bad = np.concatenate([[0], np.cumsum(wrong)])
            row = np.searchsorted(first, word, side="right") - 1
            # All hits lie in longest matches. One in which a hash stood for two words is taken window by window.
            sound, windows = leads & (bad[word + longest] == bad[word]), np.zeros(len(test), bool)
            if (leads & ~sound).any():
                windows = bad[word + length[test]] == bad[word]
            for told, n_words in ((sound, longest), (windows, length[test])):
                np.add.at(mark, word[told], 1)
                np.add.at(mark, (word + n_words)[told], -1)
                pairs.append(np.unique(row[told] * len(item_start) + owner[test[told]]))
            item = owner[test[sound]]
            matches.append(np.stack([row[sound], item, start[sound] - item_start[item], word[sound] - first[row[sound]], longest[sound]]))
        found = [(r, self.id_of(item)) for r, item in zip(*(x.tolist() for x in np.divmod(np.unique(np.concatenate(pairs)), max(len(item_start), 1))), strict=True)]
        return np.cumsum(mark)[:-1] > 0, found, np.concatenate(matches, axis=1)

    def match_lists(self, matches: np.ndarray) -> pa.StructArray:
        """Matches as structs with the ids of their items."""
        ids = pa.Array.from_buffers(pa.large_utf8(), len(self.id_at) - 1, [None, pa.py_buffer(np.ascontiguousarray(self.id_at)), pa.py_buffer(np.ascontiguousarray(self.ids))])
        return pa.StructArray.from_arrays([ids.take(pa.array(matches[1])).cast(pa.utf8()), *(pa.array(x) for x in matches[2:])], list(_MATCH))


class Words:
    """The words of a shard: where they begin and end, their hashes, and how many each row has."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.begin, self.end, self.counts = HASHER.spans(data, offsets)
        self.hashes, self._text = HASHER.hashes(data, self.begin, self.end), LOWER[data]

    def word(self, number: int) -> bytes:
        return self._text[self.begin[number] : self.end[number]].tobytes()

    def spans(self, hit: np.ndarray) -> list[list[tuple[int, int]]]:
        """Stretches of hit words of each row."""
        out: list[list[tuple[int, int]]] = [[] for _ in self.counts]
        first = np.concatenate([[0], np.cumsum(self.counts)])
        edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
        for b, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            while b < e:  # a stretch of hits may run over the end of a row
                r = int(np.searchsorted(first, b, side="right")) - 1
                stop = min(e, int(first[r + 1]))
                out[r].append((b - int(first[r]), stop - int(first[r])))
                b = stop
        return out


def _offsets(texts: list[bytes]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> list[SuffixSearch]:
    """The benchmark as blocks of at most BLOCK_BYTES, or of one item where that is longer; the driver holds one at a time."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null and t != ''")
    block, size, out = [], 0, []
    for row in rows.toLocalIterator():
        more = len(row.t.encode())
        if block and size + more > BLOCK_BYTES:
            out.append(SuffixSearch(block, window).shipped(benchmark.sparkSession))
            block, size = [], 0
        block.append((row.i, row.t))
        size += more
    return [*out, SuffixSearch(block, window).shipped(benchmark.sparkSession)]


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """What of the benchmark each document holds, word for word.

    A window is `window` consecutive words of an item, or a shorter item as a whole. Per row of `docs`: the
    columns `keep`, n_words, spans (word ranges of the matches, merged), items (ids of their items, sorted) and
    matches (longest verbatim matches: item, where in it, where in the document, how many words).
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    rows = bounded_batches(docs).select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)), F.col(text_col).cast("string").alias("text"))
    keys = [f"__k{i}" for i in range(len(keep))]
    blocks = _blocks(benchmark, item_col, item_text_col, window)
    span = pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for first, last in pieces(offsets, SHARD_BYTES):
                at = offsets[first : last + 1]
                words = Words(data[at[0] : at[-1]], at - at[0])
                hit, items, rows_of, found = np.zeros(len(words.begin), bool), [set() for _ in words.counts], [], []
                for block in blocks:
                    new, pairs, longest = block.shard(words)
                    hit |= new
                    for r, item in pairs:
                        items[r].add(item)
                    rows_of.append(longest[0])
                    found.append(block.match_lists(longest))
                row = np.concatenate(rows_of)
                order = np.argsort(row, kind="stable")
                cuts = np.searchsorted(row[order], np.arange(last - first + 1)).astype(np.int32)
                part = batch.slice(first, last - first)
                columns = [
                    *(part.column(c) for c in keys), pa.array(words.counts.astype(np.int64)),
                    pa.array([[{"begin": b, "stop": e} for b, e in x] for x in words.spans(hit)], span), pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.concat_arrays(found).take(pa.array(order))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, *named])

    named = ("n_words", "spans", "items", "matches")
    schema = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys), *(f"{n} {k}" for n, k in zip(named, _FOUND, strict=True))])
    return rows.mapInArrow(run, schema).select(*(F.col(k).alias(c) for k, c in zip(keys, keep, strict=True)), *named)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that hold no window of the benchmark, all columns as they were; no shuffle."""
    blocks = _blocks(benchmark, "item_id", "text", window)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(text_col))
            keep = np.ones(batch.num_rows, bool)
            for first, last in pieces(offsets, SHARD_BYTES):
                at = offsets[first : last + 1]
                words = Words(data[at[0] : at[-1]], at - at[0])
                for block in blocks:
                    for r, _ in block.shard(words)[1]:
                        keep[first + r] = False
            yield batch.filter(pa.array(keep))

    return bounded_batches(docs).mapInArrow(clean, docs.schema)
