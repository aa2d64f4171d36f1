import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlume.functions import hashes, probes
from seqlume.operators import dedup, reads

#: Published values of the second half of MurmurHash3 x64 128 with seed 0.
KNOWN = {"hello": 0x5B1E906A48AE1D19, "The quick brown fox jumps over the lazy dog": 0x7A433CA9C49A9347, "": 0}


def test_murmur3(spark):
    df = spark.createDataFrame([(k,) for k in KNOWN] + [(None,)], "s string").coalesce(1)
    got = [r[0] & (1 << 64) - 1 for r in df.select(hashes.murmur3_64("s", F.lit(0).cast("long"))).collect()]
    assert got == [*KNOWN.values(), 0]


def test_wang_and_back():
    x = np.concatenate([np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64), np.array([0, 1, 2**64 - 1], np.uint64)])
    assert (hashes.unwang(hashes.wang(x)) == x).all() and len(set(hashes.wang(x).tolist())) == len(set(x.tolist()))


def test_parity_subsample(spark):
    counts = spark.range(5_000).select(F.col("id").cast("string").alias("bases"), F.lit(1).alias("length_class"), F.lit(1).alias("n"))
    kept, bits = dedup.subsampled(counts, 300, parity=True)
    assert kept.count() <= 300 and bits in (4, 5)


def lanes(text):
    rates = [10 ** (-(ord(c) - 33) / 10) for c in text]
    sums, at = [0.0] * 4, 0
    while at < len(rates) - 4:
        for i in range(4):
            sums[i] += rates[at + i]
        at += 4
    total = sums[0] + sums[1] + sums[2] + sums[3]
    for rate in rates[at:]:
        total += rate
    return math.floor(-10 * math.log10(total / len(rates)))


def test_lane_order(spark):
    rng = np.random.default_rng(2)
    texts = ["?" * n for n in (1, 4, 5, 8, 9, 33, 100, 150, 151)] + ["5" * 150] + ["".join(map(chr, rng.integers(33, 127, n))) for n in range(1, 60)]
    df = spark.createDataFrame([(t,) for t in texts] + [("",), (None,)], "q string").coalesce(1)
    got = [r[0] for r in df.select(reads.lane_phred("q")).collect()]
    assert got == [lanes(t) for t in texts] + [None, None]
    assert got[6] == 29 and got[9] == 19  # one below the score of every base


def test_probes():
    assert probes.by_chance(12, 0) == 4**-12 and probes.detection(12, 0.0, 0) == 1
    assert probes.false_positives(12, 3 * 10**9, 0) == pytest.approx(1) and probes.detection(16, 0.1, 1) == pytest.approx(0.9**16 + 16 * 0.1 * 0.9**15)
    with pytest.raises(ValueError):
        probes.detection(12, 0.1, -1)
