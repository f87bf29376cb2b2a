"""Phrase collocations by dynamic itemset counting.

The texts lie in shards that are scanned one after the other, in cycles. All words are counted from the start; a
longer phrase is counted from the stop after which both its subphrases (without its last and without its first
word) have reached the threshold, until it has seen each shard once. Lengths are therefore counted together, and
the scans end when no phrase is left that has not completed its cycle.

Counts lie in a log, a row for each phrase and shard, bucketed by phrase, so that a stop looks up who has reached
the threshold without a shuffle. A phrase's count in a shard is whole or not there, hence a sum over the shards
seen is never too high, and a phrase that completed its cycle has its exact count.

Scanning tasks know the phrases that reached the threshold by a Bloom filter of fixed size. What it lets through
wrongly is counted in vain and changes nothing. Phrases are told apart by their text, never by a hash.

Then, for each candidate (two words and more, at the threshold): the score of a cut is
floor(2000000 a / (l + r)), of which the lowest counts; candidates that a longer one explains go; each language's
first `top` stay.

Defined cases: a null text counts as empty; a null language is `und`; ids don't matter and repeated rows count each;
extra columns are ignored; an empty table, or one in which no phrase reaches the threshold, gives no rows; equal
cuts go to the shorter first part, equal scores by count, then by the phrase's UTF-8 bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestat.llm.common import LOWER, WordHasher, bounded_batches, byte_table, pieces, text_bytes
from lodestat.sources.shared import cut_lineage, remove_folder, shared_folder

#: Words of the longest phrase; occurrences that a candidate has at least; rows of a language that are told.
LONGEST, LEAST, TOP = 4, 30, 2000
#: Parts of the texts between which new phrases may become active.
SHARDS = 2
#: A longer candidate with this many hundredths of a candidate's occurrences explains it.
EXPLAINED = 80
#: Bits of each of the two filters (16 MB): a power of two. Some ten for each phrase that reaches the threshold keep what is
#: counted in vain at a few hundredths; with fewer, counts stay right.
BITS = 1 << 27
#: Bytes of texts that a task looks at together.
CHUNK = 4 << 20
#: Bytes of a chunk that are hashed at once (some 40 bytes of arrays for each), and counts in a batch that a task gives out.
HASHED, TOLD = 1 << 18, 1 << 15

_BREAK = byte_table((0x0A, 0x0D), *((ord(c), ord(c)) for c in ".,;:!?"))
_WORD = ~(_BREAK | byte_table((0x09, 0x09), (0x20, 0x20)))
_IN_PHRASE = ~byte_table((0x20, 0x20))
_SPREAD, _NEXT = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _strings(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Consecutive strings in `raw`."""
    return pa.Array.from_buffers(pa.large_utf8(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)])


def _hashed(hasher: WordHasher, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """`hasher.hashes` by slices of about HASHED bytes, which end with a word: memory depends on the longest word, not on the chunk."""
    out, first = np.empty(len(begin), np.uint64), 0
    while first < len(begin):
        a = int(begin[first])
        last = max(first + 1, int(np.searchsorted(end, a + HASHED, side="right")))
        out[first:last] = hasher.hashes(raw[a : int(end[last - 1])], begin[first:last] - a, end[first:last] - a)
        first = last
    return out


def _key(chain: np.ndarray, lang: np.ndarray, k: int) -> np.ndarray:
    """The filter's key of a phrase of k words from the chained hashes of its words and that of its language."""
    with np.errstate(over="ignore"):
        mixed = (chain ^ (lang * _SPREAD)) + np.uint64(k) * _NEXT
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x9FB21C651E98DF25)
        return mixed ^ (mixed >> np.uint64(29))


def _chained(chain: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return chain * _NEXT + word


class Hashes:
    """Hashes of words and languages."""

    def __init__(self) -> None:
        self._of_phrase = WordHasher(_IN_PHRASE, LOWER)
        self._of_lang = WordHasher(np.ones(256, bool), np.arange(256))

    def words(self, words: pa.Array) -> np.ndarray:
        raw, at = text_bytes(words)
        return _hashed(self._of_phrase, raw, at[:-1], at[1:])

    def langs(self, langs: pa.Array) -> np.ndarray:
        raw, at = text_bytes(langs)
        return self._of_lang.hashes(raw, at[:-1], at[1:])

    def phrases(self, langs: pa.Array, phrases: pa.Array) -> np.ndarray:
        raw, at = text_bytes(phrases)
        begin, end, lengths = self._of_phrase.spans(raw, at)
        hashed, first, lang = _hashed(self._of_phrase, raw, begin, end), np.cumsum(lengths) - lengths, self.langs(langs)
        out = np.zeros(len(lengths), np.uint64)
        for k in range(1, int(lengths.max(initial=0)) + 1):
            of = np.flatnonzero(lengths == k)
            chain = hashed[first[of]]
            for j in range(1, k):
                chain = _chained(chain, hashed[first[of] + j])
            out[of] = _key(chain, lang[of], k)
        return out


class Filter:
    """A Bloom filter of phrases; its size is fixed, whatever is in it."""

    def __init__(self, bits: int):
        self.words, self.mask, self.lengths = np.zeros(bits // 64, np.int64), np.uint64(bits - 1), set()

    @staticmethod
    def places(keys: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        return keys & mask, (keys >> np.uint64(32)) & mask

    def has(self, keys: np.ndarray) -> np.ndarray:
        bits = self.words.view(np.uint8)
        set_ = lambda place: (bits[(place >> np.uint64(3)).view(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        first, second = self.places(keys, self.mask)
        found = set_(first)
        some = np.flatnonzero(found)
        found[some] = set_(second[some])
        return found

    def join(self, other: Filter) -> None:
        self.words |= other.words
        self.lengths |= other.lengths

    @classmethod
    def of(cls, rows: DataFrame, bits: int) -> Filter:
        """The filter of the (lang, k, phrase) in `rows`; only its words, bits / 64 at most, come to the driver."""
        made, hashes = cls(bits), Hashes()
        mask = made.mask

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = np.concatenate(cls.places(hashes.phrases(batch.column(0), batch.column(2)), mask))
                bit = np.left_shift(np.uint64(1), found & np.uint64(63)).view(np.int64)
                k = batch.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array((found >> np.uint64(6)).astype(np.int64)), pa.array(bit), pa.array(np.concatenate([k, k]))], names=["word", "bits", "k"])

        table = rows.select("lang", "k", "phrase").mapInArrow(place, "word long, bits long, k int").groupBy("word").agg(F.bit_or("bits").alias("bits"), F.bit_or(F.expr("shiftleft(1L, k)")).alias("lengths")).toArrow()
        if len(table):
            made.words[table.column("word").to_numpy()] = table.column("bits").to_numpy()
            lengths = int(np.bitwise_or.reduce(table.column("lengths").to_numpy()))
            made.lengths = {k for k in range(64) if lengths >> k & 1}
        return made


def _numbered(keys: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the number of each key among them."""
    if below <= 4 * len(keys) + 1024:
        there = np.zeros(below, bool)
        there[keys] = True
        return np.flatnonzero(there), (np.cumsum(there) - 1)[keys]
    return np.unique(keys, return_inverse=True)


def _in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(languages, bytes, offsets) of about CHUNK bytes; a longer text is cut where a piece ends, since no phrase goes on there."""

    def cut(langs: pa.Array, raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        for a, b in pieces(at, CHUNK):
            part, inner = raw[at[a] : at[b]], at[a : b + 1] - at[a]
            if len(part) <= CHUNK or b - a > 1:
                yield langs.slice(a, b - a), part, inner
                continue
            ends, begin = np.flatnonzero(_BREAK[part]), 0
            while begin < len(part):
                k = int(np.searchsorted(ends, begin + CHUNK))
                stop = int(ends[k]) + 1 if k < len(ends) else len(part)
                yield langs.slice(a, 1), part[begin:stop], np.array([0, stop - begin])
                begin = stop

    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        raw, at = text_bytes(batch.column(1))
        held.append((batch.column(0), raw, at))
        size += len(raw)
        if size >= CHUNK:
            joined, held, size = _joined(held), [], 0
            yield from cut(*joined)
    if held:
        yield from cut(*_joined(held))


def _joined(held: list) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    before = np.cumsum([0, *(len(raw) for _, raw, _ in held)])
    at = np.concatenate([np.zeros(1, np.int64), *(at[1:] + b for (_, _, at), b in zip(held, before[:-1], strict=True))])
    return pa.concat_arrays([x for x, _, _ in held]), np.concatenate([raw for _, raw, _ in held]), at


def _scan(reached, counted_words: bool, deepest: int):
    """Counts of the active phrases in batches of (lang, text): (lang, k, phrase, n), by chunks.

    reached: a broadcast (filter of all that reached the threshold, filter of what did so in the last cycle), or None.
    """
    splitter, hashes = WordHasher(_WORD, LOWER), Hashes()

    def active(word: np.ndarray, lang: np.ndarray, linked: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Lengths, and the places where an active phrase of that length begins; from hashes of each place's word and language."""
        all_, fresh = reached.value
        # of each place: the chained hash of the k words that begins there, and whether they are in one piece
        chain, whole = word, np.ones(len(word), bool)
        for k in range(2, min(deepest, len(word)) + 1):
            n = len(word) - k + 1
            both = whole[:n] & linked[k - 2 : k - 2 + n]
            if k - 1 in fresh.lengths:
                keys, new = _key(chain, lang[: n + 1], k - 1), np.zeros(n + 1, bool)
                some = np.flatnonzero(whole)
                new[some[fresh.has(keys[some])]] = True
                there = np.flatnonzero(both & (new[:-1] | new[1:]))
                there = there[all_.has(keys[there])]
                yield k, there[all_.has(keys[there + 1])]
            chain, whole = _chained(chain[:n], word[k - 1 :]), both

    def linked(raw: np.ndarray, begin: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Of each word but the last: whether the next one is in the same piece."""
        piece = np.searchsorted(np.flatnonzero(_BREAK[raw]), begin)
        return (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])

    def of_words(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, used: np.ndarray) -> pa.Array:
        """The words with the numbers in `used`, folded, as a dictionary."""
        if len(used) == len(begin):
            kept = raw[_WORD[raw]]
        else:
            inside = np.zeros(len(raw) + 1, np.int8)
            inside[begin[used]] += 1
            inside[end[used]] -= 1  # no word ends where another begins, but for rows
            kept = raw[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
        return _strings(LOWER[kept], np.concatenate([[0], np.cumsum((end - begin)[used])])).dictionary_encode()

    def count(langs: pa.Array, raw: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        begin, end, per_row = splitter.spans(raw, at)
        if not len(begin):
            return
        of_lang = langs.dictionary_encode()
        row = np.repeat(np.arange(len(per_row), dtype=np.int32), per_row)
        lang = of_lang.indices.to_numpy()[row]
        found = []
        if reached is not None:
            found = list(active(_hashed(splitter, raw, begin, end), hashes.langs(of_lang.dictionary)[lang], linked(raw, begin, row)))
        # numbers of the words that are in any phrase to count, by language: a word of one is another than that of the next
        used = np.full(len(begin), counted_words)
        for k, places in found:
            for j in range(k):
                used[places + j] = True
        used = np.flatnonzero(used)
        if not len(used):
            return
        words = of_words(raw, begin, end, used)
        n_words = len(words.dictionary)
        known, of_used = _numbered(lang[used].astype(np.int64) * n_words + words.indices.to_numpy(), len(of_lang.dictionary) * n_words)
        number = np.zeros(len(begin), np.int64)
        number[used] = of_used

        def rows(first: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
            """first: the numbers of the words of each phrase."""
            for at in range(0, len(n), TOLD):
                some, times = [x[at : at + TOLD] for x in first], n[at : at + TOLD]
                text = [words.dictionary.take(pa.array(known[x] % n_words)) for x in some]
                phrase = text[0] if len(some) == 1 else pc.binary_join_element_wise(*text, pa.scalar(" ", pa.large_utf8()))
                its = of_lang.dictionary.take(pa.array(known[some[0]] // n_words))
                yield pa.RecordBatch.from_arrays([its.cast(pa.utf8()), pa.array(np.full(len(times), len(some), np.int32)), phrase.cast(pa.utf8()), pa.array(times.astype(np.int64))], names=["lang", "k", "phrase", "n"])

        if counted_words:
            yield from rows([np.arange(len(known))], np.bincount(of_used))
        for k, places in found:
            if len(places):
                key = number[places]
                for j in range(1, k):
                    if j > 1:  # numbers of the distinct ones, so that the product stays small
                        key = np.unique(key, return_inverse=True)[1]
                    key = key * len(known) + number[places + j]
                _, at_first, times = np.unique(key, return_index=True, return_counts=True)
                yield from rows([number[places[at_first] + j] for j in range(k)], times)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _in_chunks(batches):
            yield from count(*chunk)

    return run


class PhraseCounts:
    """Counts of all phrases of up to `longest` words that occur `least` times and more in their language.

    counts: (lang, k, phrase, n) of those phrases; totals: (lang, n), words of each language. Both read files in the
    shared folder, which `drop` removes.
    """

    def __init__(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, shards: int = SHARDS, bits: int = BITS):
        self.spark, self.least, self.shards, self.longest = docs.sparkSession, least, shards, longest
        self.folder = f"{shared_folder(self.spark)}/phrases-{uuid.uuid4().hex}"
        self.log = f"phrase_log_{uuid.uuid4().hex}"
        text, lang = F.col(text_col).cast("string"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
        # shards by rows, whatever their ids and texts; written once, so that each row is in one
        dealt = docs.select(lang.alias("lang"), F.coalesce(text, F.lit("")).alias("text"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"))
        dealt.write.partitionBy("shard").parquet(f"{self.folder}/texts")
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.spark.sql(f"create table {self.log} (lang string, k int, phrase string, n long, shard int, step int) using parquet clustered by (lang, phrase) sorted by (k) into {self.buckets} buckets location '{self.folder}/log'")
        self._cycle(bits)

    def _shard(self, number: int) -> DataFrame:
        rows = self.spark.read.schema("lang string, text string, shard int").parquet(f"{self.folder}/texts")
        return bounded_batches(rows.where(F.col("shard") == number)).select("lang", "text")

    def _reached(self, step: int, longest: int) -> DataFrame:
        """(lang, k, phrase) that reach the threshold with this step, of those that it counted."""
        live = F.col("k").between(max(1, step // self.shards + 1), longest)  # shorter ones have all completed their cycles
        live = live & (F.col("step") > step - self.shards)  # those it counted became active later than that
        now, before, last = F.sum("n"), F.sum(F.when(F.col("step") < step, F.col("n"))), F.max("step")
        sums = self.spark.table(self.log).where(live).groupBy("lang", "k", "phrase").agg(now.alias("now"), before.alias("before"), last.alias("last"))
        # What was counted in vain may be there twice for a shard; a phrase that is taken for frequent here is so in no result.
        return sums.where((F.col("last") == step) & (F.col("now") >= self.least) & (F.coalesce("before", F.lit(0)) < self.least)).select("lang", "k", "phrase")

    def _cycle(self, bits: int) -> None:
        all_, reached = Filter(bits), []  # reached: of the last steps, as many as there are shards
        self.steps = 0
        for step in range(self.longest * self.shards):
            reached = reached[-self.shards :]  # what these activate has not yet seen each shard
            fresh = Filter(bits)
            for x in reached:
                fresh.join(x)
            if step >= self.shards and not fresh.lengths:
                break
            sent = self.spark.sparkContext.broadcast((all_, fresh)) if fresh.lengths else None
            shard = step % self.shards
            counted = self._shard(shard).mapInArrow(_scan(sent, step < self.shards, min(self.longest, max(fresh.lengths, default=0) + 1)), "lang string, k int, phrase string, n long")
            # shuffled by what the log is bucketed by, so that a bucket's rows are in one task
            self._append(counted.groupBy("lang", "phrase").agg(F.max("k").alias("k"), F.sum("n").alias("n")).select("lang", "k", "phrase", "n", F.lit(shard).alias("shard"), F.lit(step).alias("step")))
            if sent is not None:
                sent.destroy()
            reached.append(Filter.of(self._reached(step, self.longest - 1), bits))
            all_.join(reached[-1])
            self.steps = step + 1

    def _append(self, rows: DataFrame) -> None:
        writer = rows.write.format("parquet").mode("append").bucketBy(self.buckets, "lang", "phrase").sortBy("k")
        writer.option("path", f"{self.folder}/log").saveAsTable(self.log)

    @property
    def counts(self) -> DataFrame:
        shards = [F.coalesce(F.max(F.when(F.col("shard") == s, F.col("n"))), F.lit(0)) for s in range(self.shards)]
        return self.spark.table(self.log).groupBy("lang", "k", "phrase").agg(sum(shards, F.lit(0).cast("long")).alias("n")).where(F.col("n") >= self.least)

    @property
    def totals(self) -> DataFrame:
        return self.spark.table(self.log).where("k = 1").groupBy("lang").agg(F.sum("n").alias("n"))

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.log}")
        remove_folder(self.spark, self.folder)


def _joined_words(words: Column, begin: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, begin, n), " ")


def _exact(column: Column) -> Column:
    return column.cast("decimal(38,0)")


def collocations(counts: DataFrame, totals: DataFrame, top: int = TOP, explained: int = EXPLAINED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best candidates, from exact counts of phrases and their parts."""
    words, parts = F.split("phrase", " "), counts.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    found = counts.where("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"))
    # what a longer candidate explains, with the most frequent of the longer ones
    inner = found.where("k > 2").select("lang", "a", "k", words.alias("w"), F.explode(F.expr("sequence(2, k - 1)")).alias("m"))
    inner = inner.select("lang", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1), lambda i: _joined_words(F.col("w"), i, F.col("m")))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = found.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_exact(F.col("longer")) * 100 < _exact(F.col("a")) * explained))
    cuts = left.select("lang", "phrase", "a", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"), "k", words.alias("w"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _joined_words(F.col("w"), F.lit(1), F.col("cut")).alias("first"), _joined_words(F.col("w"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    cuts = cuts.join(parts.withColumnsRenamed({"part": "first", "f": "l"}), ["lang", "first"]).join(parts.withColumnsRenamed({"part": "rest", "f": "r"}), ["lang", "rest"])
    score = F.expr("cast(a as decimal(38, 0)) * 2000000 div (cast(l as decimal(38, 0)) + r)")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"))
    ranked = lowest.select("lang", "phrase", "a", "c.l", "c.r", "c.score").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    best = ranked.where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP, explained: int = EXPLAINED, shards: int = SHARDS) -> DataFrame:
    """The collocations of `docs`; written before they are returned, and the counts with their texts removed."""
    counted = PhraseCounts(docs, text_col, lang_col, longest, least, shards)
    try:
        return cut_lineage(collocations(cut_lineage(counted.counts), counted.totals, top, explained))
    finally:
        counted.drop()
