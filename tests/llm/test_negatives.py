import math
import random

import pytest

from binsparrow.llm import negatives


def brute(rows, every, positives, negatives_, low, scale):
    """Every anchor against every row, in whole numbers."""
    v = []
    for place, (i, x, label) in enumerate(rows):
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v.append((place, i, label, [math.floor(scale * c) for c in x]))
    order = lambda t: (-t[0], t[1] is None, t[1] or 0, t[2])
    out = []
    for place, i, label, q in v:
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(q, o[3], strict=False)), o[1], o[0], o[2]) for o in v if o[0] != place]
        for ps, p, *_ in sorted((t for t in scored if t[3] == label), key=order)[:positives]:
            fit = sorted((t for t in scored if t[3] != label and low * ps <= 100 * t[0] <= 100 * ps), key=order)[:negatives_]
            out += [(i, p, r + 1, n, ps, s) for r, (s, n, *_) in enumerate(fit)]
    return out


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, x, label, "c") for i, x, label in rows], "vec_id long, embedding array<double>, label int, row string")
    return [tuple(r) for r in negatives.hard_negatives(df, **more).collect()]


def by_text(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("bits", [2, 13])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, bits):
    """Uneven lengths, so that buckets are left out; ties; null and repeated ids; rows that take no part; shorter vectors."""
    monkeypatch.setattr(negatives, "BUCKET_BITS", bits)
    monkeypatch.setattr(negatives, "GROWTH", 2)
    monkeypatch.setattr(negatives, "ANCHORS", 8)
    rng = random.Random(bits)
    rows = []
    for i in range(260):
        size = math.exp(rng.gauss(0, 1.2))
        rows.append((i, [size * (abs(rng.gauss(0, 1)) if i % 3 else rng.gauss(0, 1)) for _ in range(6)], i % 4))
    rows += [(300 + i, [1.0, 1.0, 0.0, 0.0, 0.0, 0.0], i % 2) for i in range(40)]
    rows += [(40, rows[40][1], 0), (None, rows[20][1], 1), (None, rows[20][1], 0), (500, [0.0] * 6, 1), (501, [3.0, 1.0], 2), (502, [], 2)]
    rows += [(600, None, 1), (620, [1.0] * 6, None), (640, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (660, [float("nan")] * 6, 1), (680, [float("inf")] + [1.0] * 5, 1)]
    asked = []
    tile = negatives._dealt
    monkeypatch.setattr(negatives, "_dealt", lambda numbers, tops, lo, hi: asked.append((lo, hi)) or tile(numbers, tops, lo, hi))
    got = mined(spark, rows, every=20, low=80, scale=16)
    assert by_text(got) == by_text(brute(rows, 20, 5, 5, 80, 16)) and len(got) > 100
    if bits == 2:
        assert len(asked) > 8  # two searches of several waves


def test_buckets_are_left_out(spark, monkeypatch):
    """A few long rows decide the search; no tile holds short ones."""
    monkeypatch.setattr(negatives, "BUCKET_BITS", 4)
    met = []
    run = negatives.materialize
    monkeypatch.setattr(negatives, "materialize", lambda df, name: met.append((name, out := run(df, name))) or out)
    rng = random.Random(1)
    vector = lambda size: [size * (1 + rng.random() / 9) for _ in range(4)]
    rows = [(i, vector(100 if i < 40 else 1), i % 2) for i in range(900)]
    got = mined(spark, rows, every=100, low=80)
    assert by_text(got) == by_text(brute(rows, 100, 5, 5, 80, 256))
    asked = [out.select("bucket").distinct().count() for name, out in met if name.endswith("asked")]
    assert asked[0] == 1 and sum(asked[1:3]) <= 2 and max(asked) <= 3


def test_large_numbers_and_empty_tables(spark):
    """Scores beyond double precision are whole; vectors whose scores exceed 64 bits take no part."""
    rows = [(0, [3_000_000.25, 1_000_001.0], 0), (1, [2_999_999.5, 77.0], 0), (2, [2_999_999.0, 5.0], 1), (3, [2_500_000.0, 13.0], 1), (4, [1e18, 1.0], 1)]
    assert by_text(mined(spark, rows, every=4)) == by_text(brute(rows[:4], 4, 5, 5, 80, 256)) != []
    assert mined(spark, []) == [] and mined(spark, rows[1:4]) == []
    assert [negatives._lower(n, 80) for n in (0, 1, 5, 99, 100, 101)] == [0, 1, 4, 80, 80, 81]
