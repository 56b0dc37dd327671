import random
from itertools import combinations

import pytest

from binsparrow.operators import ensemble


@pytest.mark.parametrize(("p_b", "part"), [(0.5, 2048), (0.3, 5), (1.0, 5), (0.0, 2048)])
def test_comembership_equals_all_pairs(spark, monkeypatch, p_b, part):
    """Hot labels, equal contigs, contigs without a label in some runs, repeated rows; labels split into parts."""
    monkeypatch.setattr(ensemble, "LABEL_PART", part)
    rng = random.Random(int(10 * p_b) + part)
    rows = []
    for c in range(70):
        home = c % 3
        for b in range(1, 11):
            if rng.random() < 0.9:
                rows.append((c, b, 0 if c < 25 and b != 4 else home + 3 * rng.choice([0, 0, 0, 1, 2])))
    sets = {}
    for c, b, x in rows:
        sets.setdefault(c, set()).add((b, x))
    want = {}
    for a, c in combinations(sorted(sets), 2):
        n = len(sets[a] & sets[c])
        if n and n >= 10 * p_b:
            want[a, c] = n
    got = ensemble.comembership(spark.createDataFrame(rows + rows[:9], "contig_id long, b int, label long"), 10, p_b).collect()
    assert {(r.src, r.dst): r.shared for r in got} == want and len(got) == len(want) and all(abs(r.w - r.shared / 10) < 1e-12 for r in got)


@pytest.mark.parametrize("p_b", [0.5, 0.9])
def test_classes_are_those_of_all_pairs(spark, p_b):
    """pairs grow with the square of the contigs; classes and numbers of links come without them."""
    rng = random.Random(7)
    rows = [(c, b, rng.choice([c % 4, 0, 1, 2, 3])) for c in range(60) for b in range(1, 8) if rng.random() < 0.8] + [(80 + i, b, 9) for i in range(3) for b in range(1, 8)] + [(99, 1, 0)]
    df = spark.createDataFrame(rows + rows[:5], "contig_id long, b int, label long")
    pairs = ensemble.comembership(df, 7, p_b).collect()
    links, least = {c: 0 for c, _, _ in rows}, {c: c for c, _, _ in rows}
    for _ in least:
        for r in pairs:
            least[r.src] = least[r.dst] = min(least[r.src], least[r.dst])
    for r in pairs:
        links[r.src] += 1
        links[r.dst] += 1
    got = ensemble.comembership_classes(df, 7, p_b).collect()
    assert len(got) == len(links) and {r.contig_id: (r.component, r.links) for r in got} == {c: (least[c], links[c]) for c in links}
