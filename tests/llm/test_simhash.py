"""SimHash near-duplicates against a brute-force version."""

from __future__ import annotations

import itertools
import random
import re

import pytest
import xxhash
from pyspark.sql import types as T

from lodestat.llm import simhash

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("component_id", T.StringType())])


def plain_fingerprint(text: str | None) -> int:
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(rows: list[tuple], distance: int = 4) -> list[tuple]:
    fps = [plain_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= distance:
            root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], fps[i], least.get(find(i))) for i, r in enumerate(rows)), key=repr)


def found(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted(((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in simhash.near_duplicates(df, **how).collect()), key=repr)


def corpus(seed: int, base: int, copies: int) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]
    rows = []
    for _ in range(base):
        text = [rng.choice(words) for _ in range(rng.randrange(1, 200))]
        for _ in range(rng.randrange(1, copies)):
            changed = list(text)
            for _ in range(rng.randrange(3)):
                changed[rng.randrange(len(changed))] = rng.choice(words)
            rows.append(" \n".join(changed))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_same_as_brute_force_with_odd_rows(spark):
    rows = [*corpus(1, 40, 8), (900, None), (901, ""), (902, " \n"), (903, "one"), (903, "one"), (904, "ONE"), (None, "one two three four"), (905, "x " * 40_000)]
    assert found(spark, rows) == plain(rows)


def test_large_buckets_go_the_exact_way(spark):
    rows = corpus(2, 6, 40)
    assert found(spark, rows, bucket=3) == plain(rows)


@pytest.mark.parametrize("distance", [1, 3, 6])
def test_other_distances(spark, distance):
    rows = corpus(3, 12, 10)
    assert found(spark, rows, distance=distance) == plain(rows, distance)
    if distance < 6:
        assert found(spark, rows, distance=distance, bucket=2) == plain(rows, distance)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_radii_sum_as_the_pigeonhole_principle_asks():
    import numpy as np

    both = np.full((64, 64), 250.0) + np.diag(np.full(64, 250.0))
    for rows in (1000, 10**7, 10**10):
        groups, radii = simhash.plan(rows, both * rows / 1000, 4)
        assert sorted(b for g in groups for b in g) == list(range(64))
        assert sum(radii) == 4 - len(groups) + 1


def test_estimates_follow_the_counts_of_pairs_of_bits():
    import numpy as np

    rng = np.random.default_rng(5)
    bits = np.zeros((600, 64), np.int64)
    bits[:, 0] = rng.random(600) < 0.5
    for b in range(1, 6):  # each is mostly what the one before it is
        bits[:, b] = np.where(rng.random(600) < 0.9, bits[:, b - 1], 1 - bits[:, b - 1])
    both = (bits.T @ bits).astype(float)
    differing = (bits[:, None, :6] != bits[None, :, :6]).sum(axis=2)
    want = [float((differing <= k).mean()) for k in range(4)]
    assert simhash._within(600, both, list(range(6)), 3) == pytest.approx(want, abs=0.03)
    assert simhash._within(600, both, [7], 0) == pytest.approx([1.0])
