import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from binsparrow.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    found = [(i, Counter(terms(t))) for i, t in docs]
    n = [sum(c.values()) for _, c in found]
    count, total = sum(x > 0 for x in n), sum(n)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for (i, c), size in zip(found, n, strict=True):
            score = 0
            for t in terms(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * (25 + (75 * size * count) // total)))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def corpus(seed, n=500):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeñéXYZ019", k=rng.randint(1, 4))) for _ in range(300)]
    share = [1 / (i + 1) for i in range(300)]
    text = lambda k: "".join(w + rng.choice([" ", ", ", "\n", "-", "_"]) for w in rng.choices(words, share, k=k))
    docs = [(i, text(rng.choice([1, 5, 40, 200]))) for i in rng.sample(range(-900, 900), n)]
    same = text(30)
    docs += [(2000 + i, same) for i in range(60)] + [(docs[0][0], docs[1][1]), (None, same), (None, docs[2][1]), (5000, None), (5001, ""), (5002, " .,"), (5003, text(20_000))]
    items = [(i, text(rng.choice([1, 3, 20]))) for i in range(25)] + [(0, same), (None, docs[3][1]), (77, None), (78, "zzzzz"), (79, docs[4][1] * 5)]
    return docs, items


@pytest.mark.parametrize(("shard", "count", "block"), [(8 << 20, 1 << 14, 500_000), (3000, 1 << 14, 500_000), (8 << 20, 7, 60)])
def test_ranked_equals_brute_force(spark, monkeypatch, shard, count, block):
    """Whatever the shards and blocks of queries; ties, copies, repeated and null ids, empty texts, clashing columns."""
    monkeypatch.setattr(lexical, "SHARD_BYTES", shard)
    monkeypatch.setattr(lexical, "SHARD_DOCS", count)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    docs, items = corpus(shard + count)
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, score long").repartition(3)
    q = spark.createDataFrame([(i, t, 5, 1) for i, t in items], "item_id long, text string, doc_id long, rank long")
    got = sorted((tuple(r) for r in lexical.ranked(d, q, 10).collect()), key=str)
    assert got == brute(docs, items, 10) and len(got) > 200
    if block == 500_000 and shard > 1 << 20:
        assert lexical.ranked(d.where("doc_id = 0 AND doc_id = 1"), q, 10).count() == lexical.ranked(d, q.where("item_id = -1"), 10).count() == 0
        few = {r.item_id for r in lexical.ranked(d, q, 3).collect()}
        assert few == {i for i, t in items if any(x in {y for _, u in docs for y in terms(u)} for x in terms(t))}


def test_trees_are_sorted_both_ways():
    """At every node a list's postings stand by impact, and those of the left child have the lesser doc_ids."""
    docs, _ = corpus(5, 200)
    made = lexical.shard_of(pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs])}), 200, 5000)
    shard = lexical.Shard(*(made[c] for c in ("n_postings", "levels", "impacts", "bits")))
    ends = np.cumsum(made["dfs"])
    for term in (0, 3, 50):
        nodes = lexical._grouped(shard, np.zeros(1, int), np.array([ends[term] - made["dfs"][term]]), ends[[term]], np.ones(1, np.int64), np.zeros(1, int), np.zeros(1, int), np.zeros(1, int))
        for _ in range(shard.levels):
            for level, lo, hi in zip(nodes.level, nodes.lo, nodes.hi, strict=True):
                run = shard.impacts[level, lo:hi]
                assert (np.diff(run) <= 0).all()
            nodes = lexical._opened(shard, nodes)
        text = {i: Counter(terms(t)) for i, t in docs}
        word = made["terms"][term].as_py()
        got = [made["docs"][int(p)].as_py() for p in np.sort(nodes.prefix)]
        assert len(got) == made["dfs"][term] and all(word in text[i] or i is None or i == docs[0][0] for i in got)


def test_weak_subtrees_stay_closed():
    """A rare term decides: of a thousand documents' nodes few are opened."""
    docs = [(i, "common " * (1 + i % 3) + ("rare" if i in (77, 500) else f"w{i}")) for i in range(4000)]
    made = lexical.shard_of(pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in docs]), "text": pa.array([t for _, t in docs])}), 4000, 12000)
    shard = lexical.Shard(*(made[c] for c in ("n_postings", "levels", "impacts", "bits")))
    names, ends = made["terms"].to_pylist(), np.cumsum(made["dfs"])
    at = np.array([names.index("common"), names.index("rare")])
    best = lexical.Best(1, 2)
    opened = lexical.search_shard(shard, made["docs"], np.zeros(2, np.int64), ends[at] - made["dfs"][at], ends[at], np.array([5, 9000]), best)
    assert sorted(best.doc.tolist()) == [77, 500] and opened < 200
