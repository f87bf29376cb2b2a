"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE_WORDS` words. Each passage is described by shares of byte
classes, word shapes and hashed words; a learned encoder maps that to a vector h. Gated attention gives each
passage a weight, softmax(w . (tanh(V h) * sigmoid(U h))), and the weighted sum of the vectors is scored by a
logistic unit. Only the document has a label; encoder, attention and unit are learned together.

The fit reads a sample of at most `sample` labelled documents (those of the least hash of the id), and every
passage of each; scoring reads every passage of every document, in one Arrow pass. The sample's passages lie in a
file on the driver, from which each step of the fit reads the documents it needs.

Defined cases: a null, empty or wordless text is one passage of zeros; null labels are ignored; of several
labels for one id the mean counts, from 0.5 on as 1; without labels every score is 0.5; of rows that repeat an
id the fit reads the one with the least hash of its text; repeated rows are scored alike; extra columns are
ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import LOWER, WordHasher, bounded_batches, byte_table, crc32_of, pieces, stable_key, text_bytes

PASSAGE_WORDS = 64
#: Labelled documents to learn from, at most.
SAMPLE = 3000
#: Passages whose gradients are computed at once, about; a longer document is taken by itself.
STEP_PASSAGES = 20_000
#: Bytes of documents that are described at once.
PIECE_BYTES = 2_000_000
_HASHED = 24
_WIDTH, _GATES = 20, 10

#: Classes of bytes: letters by case, digits, blanks, line ends, other bytes of non-ASCII text, and each ASCII sign.
_CLASS = np.full(256, 5, np.int64)
for _i, _range in enumerate(((0x61, 0x7A), (0x41, 0x5A), (0x30, 0x39), (0x20, 0x20), (0x0A, 0x0A))):
    _CLASS[byte_table(_range)] = _i
_SIGNS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
_CLASS[_SIGNS] = 6 + np.arange(len(_SIGNS))
_CLASSES = 6 + len(_SIGNS)
FEATURES = _CLASSES + 6 + _HASHED


class Passages:
    """Describes the passages of many texts at once."""

    def __init__(self):
        self.hasher = WordHasher(~byte_table((0x09, 0x0D), (0x20, 0x20)), LOWER)

    def describe(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features (passages x FEATURES), and how many passages each row has: one at least."""
        begin, end, words = self.hasher.spans(data, offsets)
        hashes = self.hasher.hashes(data, begin, end)
        bags = np.maximum(1, -(-words // PASSAGE_WORDS))
        first_word, first_bag = np.cumsum(words) - words, np.cumsum(bags) - bags
        total = int(bags.sum())
        row = np.repeat(np.arange(len(words)), words)
        passage = first_bag[row] + (np.arange(len(begin)) - first_word[row]) // PASSAGE_WORDS
        x = np.zeros((total, FEATURES), np.float32)
        if not len(begin):
            return x, bags
        n = np.bincount(passage, minlength=total).astype(float)
        some = np.maximum(n, 1)
        starts = np.flatnonzero(np.diff(passage, prepend=-1))  # first word of each passage that has words
        size = np.diff(np.append(begin[starts], len(data)))
        of_byte = np.repeat(passage[starts], size)
        kinds = np.bincount(of_byte * _CLASSES + _CLASS[data[begin[starts[0]] :]], minlength=total * _CLASSES).reshape(total, _CLASSES)
        x[:, :_CLASSES] = np.sqrt(kinds / np.maximum(kinds.sum(axis=1, keepdims=True), 1))
        length = (end - begin).astype(float)
        mean = np.bincount(passage, length, total) / some
        x[:, _CLASSES] = np.log1p(mean)
        x[:, _CLASSES + 1] = np.log1p(np.bincount(passage, length**2, total) / some - mean**2 + 1e-9)
        same = np.zeros(len(begin))
        same[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
        x[:, _CLASSES + 2] = np.bincount(passage, same, total) / some
        key = (passage.astype(np.uint64) << np.uint64(40)) ^ (hashes >> np.uint64(24))
        key.sort()
        fresh = np.diff(key, prepend=key[0] ^ np.uint64(1)) != 0
        x[:, _CLASSES + 3] = np.bincount((key >> np.uint64(40)).astype(np.int64)[fresh], minlength=total)[:total] / some
        x[:, _CLASSES + 4] = np.bincount(passage, (length == 1), total) / some
        x[:, _CLASSES + 5] = np.log1p(n)
        hashed = np.bincount(passage * _HASHED + (hashes % np.uint64(_HASHED)).astype(np.int64), minlength=total * _HASHED)
        x[:, _CLASSES + 6 :] = np.sqrt(hashed.reshape(total, _HASHED) / some[:, None])
        return x, bags


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class AttentionModel:
    """Encoder, gated attention and logistic unit, fitted by Adam on bags of passages."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float64)
        self.weights = {"E": draw(FEATURES, _WIDTH), "e": np.zeros(_WIDTH), "V": draw(_WIDTH, _GATES), "U": draw(_WIDTH, _GATES), "w": draw(_GATES), "c": draw(_WIDTH), "b": np.zeros(1)}
        self.mean, self.scale, self.fitted = np.zeros(FEATURES), np.ones(FEATURES), False

    def _forward(self, x: np.ndarray, start: np.ndarray, bag: np.ndarray) -> dict:
        k = self.weights
        h = np.tanh(x @ k["E"] + k["e"])
        t, s = np.tanh(h @ k["V"]), _sigmoid(h @ k["U"])
        raw = (t * s) @ k["w"]
        grown = np.exp(raw - np.maximum.reduceat(raw, start)[bag])
        a = grown / np.add.reduceat(grown, start)[bag]
        z = np.add.reduceat(a[:, None] * h, start, axis=0)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "p": _sigmoid(z @ k["c"] + k["b"])}

    def scores(self, x: np.ndarray, bags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A score of each bag, and the attention of each passage."""
        if not len(bags):
            return np.zeros(0), np.zeros(0)
        start = np.cumsum(bags) - bags
        bag = np.repeat(np.arange(len(bags)), bags)
        if not self.fitted:
            return np.full(len(bags), 0.5), 1 / bags[bag]
        out = self._forward((x - self.mean) / self.scale, start, bag)
        return out["p"], out["a"]

    def fit(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 100, rate: float = 0.01, decay: float = 1e-4, seed: int = 7, first: np.ndarray | None = None) -> AttentionModel:
        """x may be a file; the rows of a bag follow each other from `first` on, else bags lie end to end."""
        if not len(bags):
            return self
        first = np.cumsum(bags) - bags if first is None else first

        def parts(chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            for a, b in pieces(np.append(0, np.cumsum(bags[chosen])), STEP_PASSAGES):
                some = chosen[a:b]
                size = bags[some]
                start = np.cumsum(size) - size
                bag = np.repeat(np.arange(len(size)), size)
                yield x[np.arange(size.sum()) - start[bag] + first[some][bag]].astype(float), start, bag, some

        every, rows = np.arange(len(bags)), bags.sum()
        self.mean = sum(part.sum(axis=0) for part, *_ in parts(every)) / rows
        self.scale = np.sqrt(sum(((part - self.mean) ** 2).sum(axis=0) for part, *_ in parts(every)) / rows) + 1e-3
        self.fitted, rng, step = True, np.random.default_rng(seed), 0
        m, v = ({n: np.zeros_like(p) for n, p in self.weights.items()} for _ in range(2))
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                chosen, step = order[at : at + batch], step + 1
                grads = {n: np.zeros_like(p) for n, p in self.weights.items()}
                for part, start, bag, some in parts(chosen):
                    for n, g in self._gradients((part - self.mean) / self.scale, start, bag, y[some]).items():
                        grads[n] += g * (len(some) / len(chosen))
                for n, g in grads.items():
                    g = g + decay * self.weights[n]
                    m[n], v[n] = 0.9 * m[n] + 0.1 * g, 0.999 * v[n] + 0.001 * g * g
                    self.weights[n] -= rate * (1 - epoch / epochs) * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, x: np.ndarray, start: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict:
        k, f = self.weights, self._forward(x, start, bag)
        d = (f["p"] - y) / len(y)
        dz = d[:, None] * k["c"]
        da = (dz[bag] * f["h"]).sum(axis=1)
        draw = f["a"] * (da - np.add.reduceat(f["a"] * da, start)[bag])
        gate = draw[:, None] * k["w"]
        dt, ds = gate * f["s"] * (1 - f["t"] ** 2), gate * f["t"] * f["s"] * (1 - f["s"])
        dh = f["a"][:, None] * dz[bag] + dt @ k["V"].T + ds @ k["U"].T
        de = dh * (1 - f["h"] ** 2)
        return {"E": x.T @ de, "e": de.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ draw, "c": f["z"].T @ d, "b": np.array([d.sum()])}


def held_out(id_col: str = "doc_id") -> Column:
    """The fifth of ids that no model learns from."""
    return crc32_of(F.col(id_col)) % 5 == 0


def sampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(i, y, x): id as text, label, and features of every passage, of at most `sample` labelled documents."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    known = known.orderBy(stable_key(F.col("i")), "i").limit(sample)
    texts = bounded_batches(docs).select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(known), "i").select("i", "y", "t")  # `known` has at most `sample` rows

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows that repeat an id, only those with a lesser hash than any before them in the task are passed on."""
        passages, least = Passages(), {}
        for batch in batches:
            data, at = text_bytes(batch.column(2))
            out = []
            for i, y, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                h = xxhash.xxh64_intdigest(data[a:b].tobytes()) >> 1
                if h < least.get(i, 1 << 63):
                    least[i] = h
                    out.append((str(i), y, h, passages.describe(data[a:b], np.array([0, b - a]))[0].astype("<f4").tobytes()))
            i, y, h, x = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.string()), pa.array(y, pa.float64()), pa.array(h, pa.int64()), pa.array(x, pa.binary())], names=["i", "y", "h", "x"])

    found = texts.mapInArrow(describe, "i string, y double, h long, x binary")
    return found.groupBy("i").agg(F.first("y").alias("y"), F.min_by("x", "h").alias("x"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> AttentionModel:
    """A model from the labelled documents; at most `sample` of them are read, each whole."""
    with tempfile.TemporaryFile() as file:
        found, rows = [], 0
        for r in sampled(docs, labels, id_col, text_col, label_col, sample).toLocalIterator():
            n = len(r.x) // (4 * FEATURES)
            found.append((r.i, float(r.y >= 0.5), rows, n))
            file.write(r.x)
            rows += n
        file.flush()
        x = np.memmap(file, "<f4", "r", shape=(rows, FEATURES)) if rows else np.zeros((0, FEATURES), np.float32)
        _, y, first, bags = zip(*sorted(found), strict=True) if found else ((), (), (), ())
        return AttentionModel().fit(x, np.array(bags, np.int64), np.array(y, float), first=np.array(first, np.int64))


def score(docs: DataFrame, model: AttentionModel, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Per row of `docs`: the columns `keep`, score, n_passages, and top_passage (number of the passage with most attention)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages()
        for batch in batches:
            data, offsets = text_bytes(batch.column("__text"))
            for first, last in pieces(offsets, PIECE_BYTES):
                at = offsets[first : last + 1]
                x, bags = passages.describe(data[at[0] : at[-1]], at - at[0])
                value, attention = shared.value.scores(x, bags)
                start = np.cumsum(bags) - bags
                most = np.maximum.reduceat(attention, start)
                is_top = np.where(attention == np.repeat(most, bags), np.arange(len(attention)), len(attention))
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(value), pa.array(bags.astype(np.int64)), pa.array((np.minimum.reduceat(is_top, start) - start).astype(np.int64))], names=[*batch.schema.names[: len(keep)], "score", "n_passages", "top_passage"])

    rows = bounded_batches(docs).select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)), F.col(text_col).cast("string").alias("__text"))
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[: len(keep)]) + "score double, n_passages long, top_passage long"
    return rows.mapInArrow(run, schema).select(*(F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)), "score", "n_passages", "top_passage")
