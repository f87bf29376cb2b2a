"""Language identification as inference in a multilingual mixture.

Fit: byte trigrams of the letters are counted per language over a sample of labelled texts, of about
`per_language` different texts per language chosen by a hash of the text, and smoothed into a likelihood per
language. Inference, per document: expectation-maximisation estimates which share of its trigrams each
language made. Languages enter the set in the order of those shares as long as the likelihood, less a
penalty for each language and the logarithm of the number of trigrams, grows. Documents are never shuffled.

Defined cases: a null text, or one without a letter, has no languages, prediction `und` and score 0; rows
whose label is null aren't learned from; with nothing to learn from, all predictions are `und`; repeated
rows are judged alike; equal shares go by the language's name; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm.common import LOWER, Shipped, bounded_batches, byte_table, crc32_of, stable_key, text_bytes

#: Number of trigram hashes.
BUCKETS = 1 << 15
#: Documents of each language to learn from, about.
PER_LANGUAGE = 1500
#: Languages that are learned; each takes 128 KB of counts and 256 KB of likelihoods of the driver.
MOST_LANGUAGES = 1000
#: Languages whose likelihoods are looked at together; a model of more goes block by block, so that a worker's memory
#: doesn't grow with it.
BLOCK = 256
#: Log-likelihood per language and logarithm of the trigram count.
PENALTY = 3.0
ROUNDS = 12

_LETTER = byte_table((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def trigrams(raw: np.ndarray) -> np.ndarray:
    """Hashes of the byte trigrams of a text's letters, other runs counting as one space."""
    if not len(raw):
        return np.zeros(0, np.int64)
    letter = _LETTER[raw]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first byte after a letter stays, as a space
    kept = np.where(letter, LOWER[raw], 32)[keep].astype(np.uint32)
    padded = np.concatenate([np.array([32], np.uint32), kept, np.array([32], np.uint32)])
    mixed = (padded[:-2] << 16) | (padded[1:-1] << 8) | padded[2:]
    return ((mixed * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


class MixtureModel:
    """Likelihoods of trigrams by language, in blocks of languages: (trigram x language) each, in a dict or a file mapped into memory."""

    def __init__(self, languages: list[str], counts: np.ndarray, penalty: float = PENALTY):
        self.languages, self.penalty, self.width = languages, penalty, BLOCK
        self.blocks: dict[str, np.ndarray] | Shipped = {}
        self.sizes = []
        for at in range(0, len(counts), self.width):
            smooth = counts[at : at + self.width].astype(float) + 0.05
            self.blocks[str(len(self.sizes))] = np.ascontiguousarray((smooth / smooth.sum(axis=1, keepdims=True)).T)
            self.sizes.append(len(smooth))

    def shipped(self, spark: SparkSession) -> MixtureModel:
        """The same, with its likelihoods in a file for the executors."""
        sent = MixtureModel(self.languages, np.zeros((0, BUCKETS)), self.penalty)
        sent.width, sent.sizes, sent.blocks = self.width, self.sizes, Shipped(spark, self.blocks) if isinstance(self.blocks, dict) else self.blocks
        return sent

    def _columns(self, used: np.ndarray, which: np.ndarray | None = None) -> list[np.ndarray]:
        """The rows `used` of the likelihoods: block by block, or of the languages `which` together."""
        if which is None:
            return [self.blocks[str(i)][used] for i in range(len(self.sizes))] if len(self.sizes) == 1 else _Lazy(self.blocks, used, len(self.sizes))
        return [np.stack([self.blocks[str(i // self.width)][used, i % self.width] for i in which], axis=1)]

    @staticmethod
    def _em(parts, counts: np.ndarray) -> tuple[np.ndarray, float]:
        """Shares of the columns of the parts, and the log-likelihood."""
        widths = [p.shape[1] for p in parts]
        cut = np.cumsum(widths)[:-1]
        shares, total = np.full(sum(widths), 1 / sum(widths)), counts.sum()
        mixed = lambda: sum(p @ s for p, s in zip(parts, np.split(shares, cut), strict=True))
        for _ in range(ROUNDS):
            ratio = counts / mixed()
            new = shares * np.concatenate([ratio @ p for p in parts]) / total
            moved = np.abs(new - shares).max()
            shares = new
            if moved < 1e-3:
                break
        return shares, float(counts @ np.log(mixed()))

    def infer(self, raw: np.ndarray) -> list[tuple[str, float]]:
        """Languages of a text and their shares, largest first."""
        hashed = trigrams(raw)
        if not len(hashed) or not self.languages:
            return []
        counts = np.bincount(hashed, minlength=BUCKETS)
        used = np.flatnonzero(counts)
        counts, parts = counts[used].astype(float), self._columns(used)
        alone = np.concatenate([counts @ np.log(p) for p in parts])
        price = self.penalty * np.log(len(hashed) + 1.0)
        first = int(np.argmax(alone))
        if len(self.languages) == 1:
            return [(self.languages[0], 1.0)]
        shares, best = self._em(parts, counts)
        if best - alone[first] <= price:  # the mixture of all languages is likelier than that of any set
            return [(self.languages[first], 1.0)]
        order = np.argsort(-shares, kind="stable")
        chosen, its, value = order[:1], np.ones(1), float(alone[order[0]]) - price
        if alone[first] > alone[order[0]]:
            chosen, value = np.array([first]), float(alone[first]) - price
        for k in range(2, len(order) + 1):
            part, likelihood = self._em(self._columns(used, order[:k]), counts)
            if likelihood - k * price <= value:
                break
            chosen, its, value = order[:k], part, likelihood - k * price
        found = sorted(zip(its.tolist(), chosen.tolist(), strict=True), key=lambda x: (-x[0], x[1]))
        return [(self.languages[i], float(s)) for s, i in found]


class _Lazy:
    """Rows of the blocks of a model, read each time they are passed over."""

    def __init__(self, blocks, used: np.ndarray, n: int):
        self.blocks, self.used, self.n = blocks, used, n

    def __len__(self) -> int:
        return self.n

    def __iter__(self) -> Iterator[np.ndarray]:
        return (self.blocks[str(i)][self.used] for i in range(self.n))


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", per_language: int = PER_LANGUAGE, penalty: float = PENALTY, most_languages: int = MOST_LANGUAGES) -> MixtureModel:
    """A model from rows with a label.

    Of a language with more different texts than `per_language`, that many are expected to be read, chosen by a hash
    of the text; equal texts of a language are read once, ids don't matter. Of more than `most_languages` labels the
    most frequent ones are learned.
    """
    key = stable_key(F.col(text_col))
    rows = bounded_batches(labelled).where(F.col(label_col).isNotNull()).select(F.col(label_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t"), key.alias("k"))
    sizes = rows.groupBy("l").agg(F.count("*").alias("n"), F.approx_count_distinct("k", 0.02).alias("texts")).orderBy(F.desc("n"), "l").limit(most_languages)
    sizes = {r.l: r.texts for r in sizes.collect()}  # what the model is made of
    languages = sorted(sizes)
    if not languages:
        return MixtureModel([], np.zeros((0, BUCKETS)), penalty)
    least = rows.sparkSession.createDataFrame([(x, int(min(1.0, per_language / max(sizes[x], 1)) * 2**60)) for x in languages], "l string, cut long")
    sample = rows.join(F.broadcast(least), "l").where(F.col("k") <= F.col("cut")).groupBy("l", "k").agg(F.first("t").alias("t")).select("l", "t")  # least has a row for each language
    number = {l: i for i, l in enumerate(languages)}  # noqa: E741

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            raw, at = text_bytes(batch.column(1))
            for i, name in enumerate(batch.column(0).to_pylist()):
                grown = total.setdefault(number[name], np.zeros(BUCKETS, np.int64))
                grown += np.bincount(trigrams(raw[at[i] : at[i + 1]]), minlength=BUCKETS)
        for which, grown in total.items():
            used = np.flatnonzero(grown)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), which, np.int32)), pa.array(used), pa.array(grown[used])], names=["l", "b", "n"])

    counts = np.zeros((len(languages), BUCKETS), np.int32)
    for row in sample.mapInArrow(count, "l int, b long, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).groupBy("l").agg(F.collect_list(F.struct("b", "n")).alias("x")).toLocalIterator():
        counts[row.l, [x.b for x in row.x]] = [x.n for x in row.x]  # at most BUCKETS cells
    return MixtureModel(languages, counts, penalty)


def _has_letter(column: Column) -> Column:
    return F.coalesce(column.rlike(r"\p{L}"), F.lit(False))


def _inference(model, n_extra: int):
    """Adds lang_pred, score and mixture to batches whose last columns are text and whether it has a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch.column("__text"))
            letters = batch.column("__letter").to_pylist()
            found = [model.infer(raw[a:b]) if ok else [] for a, b, ok in zip(at[:-1].tolist(), at[1:].tolist(), letters, strict=True)]
            item = pa.struct([("lang", pa.string()), ("share", pa.float64())])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(n_extra)),
                    pa.array([x[0][0] if x else "und" for x in found], pa.string()),
                    pa.array([min(x[0][1], 1.0) if x else 0.0 for x in found], pa.float64()),
                    pa.array([[{"lang": k, "share": v} for k, v in x] for x in found], pa.list_(item)),
                ],
                names=[*batch.schema.names[:n_extra], "lang_pred", "score", "mixture"],
            )

    return run


def identify(docs: DataFrame, model: MixtureModel, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Per row of `docs`: the columns `keep`, lang_pred, score (that language's share) and mixture (all its languages)."""
    shared = model.shipped(docs.sparkSession)
    rows = bounded_batches(docs).select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)), F.col(text_col).cast("string").alias("__text"), _has_letter(F.col(text_col).cast("string")).alias("__letter"))
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[: len(keep)]) + "lang_pred string, score double, mixture array<struct<lang:string,share:double>>"
    out = rows.mapInArrow(_inference(shared, len(keep)), schema)
    return out.select(*(F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score", "mixture")


def held_out(id_col: str = "doc_id") -> Column:
    """The quarter of ids that no model learns from."""
    return crc32_of(F.col(id_col)) % 4 == 2


def keep_known(docs: DataFrame, model: MixtureModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, as they were, in which one language makes up at least `least` of the text; all of them where the model has learnt none."""
    if not model.languages:
        return docs
    shared, letter = model.shipped(docs.sparkSession), "__letter"
    while letter in (c.lower() for c in docs.columns):
        letter += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch.column(text_col))
            letters = batch.column(letter).to_pylist()
            keep = []
            for a, b, ok in zip(at[:-1].tolist(), at[1:].tolist(), letters, strict=True):
                found = shared.infer(raw[a:b]) if ok else []
                keep.append(bool(found) and found[0][1] >= least)
            yield batch.filter(pa.array(keep, pa.bool_())).drop_columns([letter])

    return bounded_batches(docs).withColumn(letter, _has_letter(F.col(text_col))).mapInArrow(run, docs.schema)
