"""SimHash near-duplicates by the generalised pigeonhole principle.

1. One Arrow pass turns each text into a 64-bit fingerprint; the (id, fingerprint) table is written once.
2. Over all fingerprints, Spark sums how often each bit is set and each pair of bits is set together. From
   these, correlated bits are grouped into partitions, and dynamic programming gives each partition its own
   radius (radii sum to `distance` - partitions + 1) where the estimated rows probed plus candidates are least.
3. Each distinct fingerprint is emitted under its projection on every partition, and under the projections
   within the partition's radius; rows with the same key meet, sorted, and are verified on all 64 bits.
   A bucket gives a spanning forest of its verified links, never all pairs.
4. A bucket beyond `BUCKET` fingerprints goes an exact way that grows with its size only: each of its
   fingerprints is emitted with all 64-bit values within half the distance, and two fingerprints share such a
   value just when they are within `distance`.
5. Links become components by large-star/small-star rounds over checkpointed tables.

Fingerprints are linked, not documents, so copies of any number add no links.

Defined cases: a null, empty or wordless text has fingerprint zero and is linked like any other; equal
fingerprints are linked; a null id takes part, and is a component's smallest id only if no other is there;
repeated rows each get their row; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import bounded_batches, text_bytes
from lodestat.sources.shared import cut_lineage, shared_folder

#: Fingerprints of one bucket that are compared within a task; larger buckets go the way of step 4.
BUCKET = 4096
#: Up to this size all pairs of a bucket are compared at once, over many buckets together.
SMALL = 24
#: What a probed row costs against a compared pair, for the choice of partitions.
PROBE_COST = 8.0
#: Row numbers that `keep_representatives` broadcasts at most, some 50 bytes each in memory.
BROADCAST_IDS = 500_000
_BITS = 64
#: The bits of each byte value, and where the counts of each of a hash's bytes begin.
_SET_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_OF = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of the word shingles of a text, repeats included; a bit is set if over half the hashes set it."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    digest, form = xxhash.xxh64_digest, b" ".join([b"%b"] * shingle)
    hashes = np.frombuffer(b"".join([digest(form % run, 42) for run in zip(*(words[i:] for i in range(shingle)))]), ">u8").astype("<u8")  # noqa: B905
    places = hashes.view(np.uint8).reshape(-1, 8) + _BYTE_OF
    total = (np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _SET_BITS).ravel()
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id_col, fingerprint as signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            raw = data.tobytes()
            out = np.array([fingerprint(raw[a:b], shingle) for a, b in itertools.pairwise(at.tolist())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=[id_col, "fingerprint"])

    rows = bounded_batches(docs).select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, fingerprint long")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how often bits i and j are set together (64 x 64), over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, both = 0, np.zeros((_BITS, _BITS))
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(values), 65536):
                bits = np.unpackbits(values[at : at + 65536].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
                rows += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_BITS * _BITS + 1)), pa.array(np.append(both.ravel(), rows).astype(np.int64))], names=["cell", "n"])

    sums = {r.cell: r.n for r in fps.select("fingerprint").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    both = np.array([sums.get(i, 0) for i in range(_BITS * _BITS)], float).reshape(_BITS, _BITS)
    return int(sums.get(_BITS * _BITS, 0)), both


def partitions_of(rows: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of near-equal size; a group takes in turn the bit most correlated with its bits."""
    p = np.diag(both) / max(rows, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs((both / max(rows, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    free, groups = set(range(_BITS)), []
    for g in range(parts):
        size = len(free) // (parts - g)
        group = [max(free, key=lambda b: (related[b, list(free)].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (related[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def _within(rows: int, both: np.ndarray, group: list[int], most: int) -> np.ndarray:
    """Estimated share of pairs whose projections on a group differ in at most 0, 1, ... `most` bits.

    Whether a bit differs between two fingerprints depends on whether the bit before it in the group does, as
    the counts of both bits together tell; a chain of such steps over the group's bits, the most related next.
    """
    n = max(rows, 1)
    p, joint = np.diag(both) / n, both / n
    differs = 2 * p * (1 - p)

    def together(i: int, j: int) -> float:
        """The share of pairs that differ in both bits."""
        p11, p10, p01 = joint[i, j], p[i] - joint[i, j], p[j] - joint[i, j]
        return max(0.0, 2 * (max(1 - p11 - p10 - p01, 0.0) * p11 + p10 * p01))

    left, chain = list(group[1:]), [group[0]]
    while left:
        at = chain[-1]
        chain.append(max(left, key=lambda b: (together(at, b) - differs[at] * differs[b], -b)))
        left.remove(chain[-1])
    # spread[d, k]: the chain so far differs in k bits, d tells whether in the last one
    spread = np.zeros((2, most + 1))
    spread[0, 0] = 1 - differs[chain[0]]
    if most:
        spread[1, 1] = differs[chain[0]]
    for i, j in itertools.pairwise(chain):
        after = np.zeros_like(spread)
        for was in range(2):
            base = differs[i] if was else 1 - differs[i]
            shared = together(i, j) if was else max(differs[j] - together(i, j), 0.0)
            rate = min(shared / base, 1.0) if base > 0 else 0.0
            after[0] += spread[was] * (1 - rate)
            after[1, 1:] += spread[was, :-1] * rate
        spread = after
    return np.cumsum(spread.sum(axis=0))


def _probes(bits: int, radius: int) -> float:
    """Rows emitted for a fingerprint, on average: half of the changed projections of each number of changes."""
    return 0.0 if radius < 0 else 1.0 + sum(float(np.prod([(bits - i) / (i + 1) for i in range(k)])) / 2 for k in range(1, radius + 1))


def plan(rows: int, both: np.ndarray, distance: int) -> tuple[list[list[int]], list[int]]:
    """Partitions and their radii of least estimated cost, by dynamic programming for each number of partitions."""
    best: tuple[float, list[list[int]], list[int]] | None = None
    for parts in range(1, distance + 2):
        groups, budget = partitions_of(rows, both, parts), distance - parts + 1
        if budget > 3:
            continue  # every fingerprint would be emitted tens of thousands of times
        # reach[s]: least cost with radii of the groups so far summing to s; a radius of -1 leaves a group out
        reach: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            share, new = _within(rows, both, group, max(budget + parts, 0)), {}
            for total, (cost, radii) in reach.items():
                for radius in range(-1, min(3, budget + parts - 1) + 1):
                    here = 0.0 if radius < 0 else PROBE_COST * rows * _probes(len(group), radius) + rows * rows / 2 * share[min(radius, len(share) - 1)]
                    key = total + radius
                    if key not in new or cost + here < new[key][0]:
                        new[key] = (cost + here, [*radii, radius])
            reach = new
        if budget in reach and (best is None or reach[budget][0] < best[0]):
            best = (reach[budget][0], groups, reach[budget][1])
    if best is None:
        raise ValueError("distance is too large for 64 bits")
    return best[1], best[2]


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _emit(groups: list[list[int]], radii: list[int]):
    """Keys of each fingerprint: partition number in the upper bits mixed with the projection, own or changed.

    Of two projections that differ, the one with a 0 in the lowest differing bit is the one that probes.
    """
    layout = []
    for number, (group, radius) in enumerate(zip(groups, radii, strict=True)):
        if radius >= 0:
            mask = np.uint64(sum(1 << b for b in group))
            changes = [(np.uint64(sum(1 << b for b in chosen)), np.uint64(1 << min(chosen))) for k in range(1, radius + 1) for chosen in itertools.combinations(group, k)]
            layout.append((number, mask, changes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(whole), 4096):
                fp = whole[at : at + 4096]
                for number, mask, changes in layout:
                    own = fp & mask
                    # Half a fingerprint's bits may be masked out: the partition's number is kept beside the key.
                    found = [(own, fp)]
                    for change, low in changes:
                        zero = (fp & low) == 0
                        found.append(((own ^ change)[zero], fp[zero]))
                    keys, values = np.concatenate([k for k, _ in found]), np.concatenate([v for _, v in found])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), number, np.int32)), pa.array(keys.view(np.int64)), pa.array(values.view(np.int64))], names=["part", "key", "fp"])

    return run


def _forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within a bucket: no more links than fingerprints."""
    left, one, two = np.unique(fps), [], []
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            node = stack.pop()
            near = _popcount(left ^ node) <= distance
            if near.any():
                got = left[near]
                one.append(np.full(len(got), node))
                two.append(got)
                stack.extend(got)
                left = left[~near]
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(one or none), np.concatenate(two or none)


def _verify(masks: dict[int, int], distance: int, bucket: int):
    """From rows sorted by (part, key): links (kind 0), and the fingerprints of buckets beyond the limit (kind 1)."""
    lookup = np.zeros(max(masks) + 1, np.uint64)
    for number, mask in masks.items():
        lookup[number] = mask

    def links(part: np.ndarray, key: np.ndarray, fp: np.ndarray, start: np.ndarray, size: np.ndarray):
        """Of whole buckets."""
        one, two = [], []
        small = size <= SMALL
        rank = np.arange(len(key)) - np.repeat(start, size)
        row_size = np.repeat(np.where(small, size, 0), size)
        own = (fp & lookup[part]) == key
        for step in range(1, int(size[small].max(initial=1))):
            i = np.flatnonzero(rank + step < row_size)
            i = i[own[i] | own[i + step]]
            i = i[_popcount(fp[i] ^ fp[i + step]) <= distance]
            one.append(fp[i])
            two.append(fp[i + step])
        for s, n in zip(start[~small].tolist(), size[~small].tolist(), strict=True):
            a, b = _forest(fp[s : s + n], distance)
            one.append(a)
            two.append(b)
        none = [np.zeros(0, np.uint64)]
        return np.concatenate(one or none), np.concatenate(two or none)

    def out(kind: int, one: np.ndarray, two: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(one), kind, np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["kind", "one", "two"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, fp = np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        large: tuple | None = None  # the bucket that is being passed on row by row
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                part, key, fp = (np.concatenate(x) for x in ((part, new[0].astype(np.int32)), (key, new[1].astype(np.int64).view(np.uint64)), (fp, new[2].astype(np.int64).view(np.uint64))))
            if not len(key):
                continue
            cut = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            if large is not None:
                stop = int(cut[0]) if len(cut) else len(key)
                if (int(part[0]), int(key[0])) == large:
                    yield out(1, fp[:stop], fp[:stop])
                    part, key, fp, cut = part[stop:], key[stop:], fp[stop:], cut[1:] - stop
                if len(key):
                    large = None
                else:
                    continue
            start = np.concatenate([[0], cut]).astype(np.int64)
            size = np.diff(np.append(start, len(key)))
            if batch is not None:  # the last bucket may go on
                whole = int(start[-1])
                if size[-1] > bucket:
                    large = (int(part[-1]), int(key[-1]))
                    yield out(1, fp[whole:], fp[whole:])
                    rest = len(key)
                else:
                    rest = whole
                start, size = start[:-1], size[:-1]
            else:
                whole = rest = len(key)
            if len(start):
                over = size > bucket
                for s, n in zip(start[over].tolist(), size[over].tolist(), strict=True):
                    yield out(1, fp[s : s + n], fp[s : s + n])
                pick = np.repeat(~over, size)
                fine = size[~over]
                one, two = links(part[:whole][pick], key[:whole][pick], fp[:whole][pick], np.cumsum(fine) - fine, fine)
                for at in range(0, len(one), 50_000):
                    yield out(0, one[at : at + 50_000], two[at : at + 50_000])
            part, key, fp = part[rest:], key[rest:], fp[rest:]

    return run


def _ball(distance: int):
    """Each fingerprint with every value within half the distance, nearer half rounded up on one side."""
    inner, outer = distance // 2, distance - distance // 2
    flips = [np.uint64(sum(1 << b for b in chosen)) for k in range(outer + 1) for chosen in itertools.combinations(range(_BITS), k)]
    few = sum(1 for f in flips if int(f).bit_count() <= inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp in batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64):
                hubs = np.array(flips, np.uint64) ^ fp
                yield pa.RecordBatch.from_arrays([pa.array(hubs.view(np.int64)), pa.array(np.full(len(hubs), fp, np.uint64).view(np.int64)), pa.array(np.arange(len(hubs)) < few)], names=["hub", "fp", "inner"])

    return run


def links(distinct: DataFrame, distance: int, bucket: int = BUCKET) -> DataFrame:
    """(one, two): links between distinct fingerprints whose components are those of all pairs within `distance`."""
    rows, both = bit_counts(distinct)
    groups, radii = plan(rows, both, distance)
    masks = {i: sum(1 << b for b in g) for i, g in enumerate(groups)}
    emitted = distinct.select("fingerprint").mapInArrow(_emit(groups, radii), "part int, key long, fp long")
    met = emitted.repartition("part", "key").sortWithinPartitions("part", "key")
    found = cut_lineage(met.mapInArrow(_verify(masks, distance, bucket), "kind int, one long, two long"))
    near = found.where("kind = 0").select("one", "two")
    if found.where("kind = 1").isEmpty():
        return near
    hubs = found.where("kind = 1").select("one").distinct().mapInArrow(_ball(distance), "hub long, fp long, inner boolean")
    # Where the distance is odd, a hub links a fingerprint of its inner ball to those of its outer ball only.
    low = hubs.groupBy("hub").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("two"), F.count("*").alias("n")).where("n > 1 and two is not null")
    return near.unionByName(hubs.join(low, "hub").where("fp != two").select(F.col("fp").alias("one"), "two"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links: root is the smallest node that can be reached.

    Large-star and small-star rounds; each keeps at most as many links as before and is checkpointed.
    A star around a node with very many links is a window's partition, so links are grouped by aggregation:
    the smallest neighbour is found by a partial aggregate and joined back.
    """
    now = cut_lineage(edges.where("one != two").select(F.greatest("one", "two").alias("u"), F.least("one", "two").alias("v")).distinct())
    before = None
    while True:
        # large star: every neighbour above a node is linked to the least neighbour of the node or itself
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every lower neighbour of a node, and the node, is linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        size = after.count()
        # Sets of links of one size are the same where none of them is missing in the other.
        if size == before and after.join(now, ["u", "v"], "left_anti").isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, now = size, after


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """Per row of `docs`: id_col, fingerprint (signed long) and component_id, the smallest id that links lead to."""
    ids = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"))
    fps = cut_lineage(fingerprints(ids, "__id", "__t", shingle))
    distinct = cut_lineage(fps.groupBy("fingerprint").agg(F.min("__id").alias("first_id")))
    roots = components(links(distinct, distance, bucket))
    classes = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select("fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root"))
    classes = cut_lineage(classes)
    # Tables of their own, so that Spark can split a component of very many fingerprints, and a fingerprint of very
    # many rows, in the joins.
    least = cut_lineage(classes.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = cut_lineage(classes.join(least, "root").select("fingerprint", "component_id"))
    return fps.join(named, "fingerprint").select(F.col("__id").alias(id_col), "fingerprint", "component_id")


def keep_representatives(docs: DataFrame, distance: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, as they were, less all but one of each component: the row with the smallest id stays.

    Rows are told apart by a number of their own, never by id: ids may be null or repeat, within a component
    and over several. Of rows that repeat the id that stays, the one with the least hash of its text does, then
    the one with the least number. Rows without an id stay where the component has no id, one of them.
    """
    number = "__row"
    while number in (c.lower() for c in docs.columns):
        number += "_"
    # Written once, so that a row has the same number whenever the table is read.
    path = f"{shared_folder(docs.sparkSession)}/rows-{uuid.uuid4().hex}"
    docs.withColumn(number, F.monotonically_increasing_id()).write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    # Nulls come first: a row with an id comes before one without.
    key = F.struct(F.when(F.col(id_col).isNull(), 1).alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"), F.col(number).alias("row"))
    found = near_duplicates(rows.select(key.alias("__key"), F.col(text_col).alias("__of")), distance, shingle, "__key", "__of")
    # The rows that go are the few: they are named, and the others stay where they are.
    gone = cut_lineage(found.where("__key.row != component_id.row").select(F.col("__key.row").alias(number)))
    # Numbers of up to BROADCAST_IDS rows are sent to the documents; with more, the documents are shuffled by them.
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(gone) if few else gone, number, "left_anti").drop(number)
