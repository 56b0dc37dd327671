import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from binsparrow.llm import curves, decontam, importance, langid, neardup, packing, sharding, substring, token_files, warc

tokenizers = pytest.importorskip("tokenizers")
import public_tokenizers  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, words string"


def documents(spark, texts, langs=None):
    """Documents with extra columns whose names clash with those that operators use."""
    rows = [(i, t, (langs or {}).get(i), "s", len(t or ""), "x", "y") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def word_texts(seed=1, n=40, vocabulary=30):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefg", k=rng.randint(2, 5))) for _ in range(vocabulary)]
    base = [" ".join(rng.choices(words, k=rng.randint(60, 140))) for _ in range(8)]
    out = []
    for i in range(n):
        t = base[i % 8].split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 9])):
            t[rng.randrange(len(t))] = rng.choice(words).upper()
        out.append((i, " ".join(t)))
    return out + [(100, None), (101, ""), (102, " \n"), (103, "one two"), (104, "One  TWO"), (105, "z"), (None, base[0]), (106, "long " * 3000), (107, " x y " * 70)]


def test_chosen_path_equals_brute_force(spark):
    texts = word_texts()
    got = {r.doc_id: r for r in neardup.near_duplicates(documents(spark, texts), 3, 85).collect()}
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = set(zip(w, w[1:], w[2:], strict=False)) if len(w) >= 3 else {tuple(w)} if w else set()
    ids = sorted((i for i, _ in texts), key=lambda i: 1 << 60 if i is None else i)
    comp = {i: i for i in ids}
    order = {i: k for k, i in enumerate(ids)}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                x, y = sets[a], sets[b]
                if x and y and 100 * len(x & y) >= 85 * len(x | y) and order[comp[a]] < order[comp[b]]:
                    comp[b] = comp[a]
                    changed = True
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), comp[i], comp[i] == i) for i in ids}
    assert neardup.near_duplicates(documents(spark, texts).where("doc_id < 0"), 3, 85).count() == 0


def brute_components(texts, k, percent):
    """Least id reachable over all pairs of sets, by brute force."""
    ids, sets = [], []
    for i, t in texts:
        w = t.lower().split()
        ids.append(i)
        sets.append(frozenset(zip(*(w[j:] for j in range(k)), strict=False)))
    which = {x: n for n, x in enumerate({y for s in sets for y in s})}
    m = np.zeros((len(sets), len(which)), np.float32)
    for r, s in enumerate(sets):
        m[r, [which[x] for x in s]] = 1
    both, n = m @ m.T, m.sum(1)
    link = 100 * both >= percent * (n[:, None] + n[None] - both)
    label = np.array(ids)
    while True:
        new = np.where(link, label[None], np.iinfo(np.int64).max).min(1)
        if (new == label).all():
            return dict(zip(ids, label.tolist(), strict=True))
        label = new


@pytest.mark.parametrize("percent", [80, 85])
def test_chosen_path_branches_and_large_nodes(spark, monkeypatch, percent):
    """Thousands of documents that share passages, and one large group of near copies: nodes branch over several levels,
    the dense ones meet their pivots and then in blocks."""
    rng = random.Random(percent)
    words = ["".join(rng.choices("abcdefghijk", k=5)) for _ in range(4000)]
    noise = lambda n: rng.choices(words, k=n)
    passages = [noise(25) for _ in range(6)]
    texts = []

    def vary(base, edits):
        t = list(base)
        for _ in range(edits):
            t[rng.randrange(len(t))] = rng.choice(words)
        return t

    for i in range(2200):
        texts.append((i, noise(rng.randint(20, 60)) + passages[i % 6] + noise(rng.randint(0, 30))))
    bases = [noise(110) for _ in range(60)]
    texts += [(5000 + i, vary(bases[i % 60], rng.randint(0, 8))) for i in range(500)]
    hot = noise(130)
    texts += [(9000 + i, vary(hot, rng.randint(0, 9))) for i in range(600)]
    texts = [(i, " ".join(t)) for i, t in texts]
    monkeypatch.setattr(neardup, "SMALL", 60)
    monkeypatch.setattr(neardup, "BLOCK_RIGHT", 64)
    monkeypatch.setattr(neardup, "BLOCK_LEFT", 32)
    levels, branch = [], neardup._across
    monkeypatch.setattr(neardup, "_across", lambda m: levels.append(m.count()) or branch(m))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(spark, texts), 3, percent).collect()}
    want = brute_components(texts, 3, percent)
    wrong = [i for i in want if got[i] != want[i]]
    assert len(wrong) <= 2 and levels[0] > 500


def test_near_duplicates_of_repeated_ids(spark):
    """Texts under one doc_id or none are told apart: links of each count, and rows go one by one."""
    rng = random.Random(5)
    a, b, c, d = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(80)) for x in "abcd")
    near = lambda t: t + " more"
    docs = documents(spark, [(None, a), (None, b), (None, c), (None, None), (1, near(a)), (2, near(b)), (7, c), (7, d), (7, d), (8, near(d))])
    got = Counter((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs, 3, 85).collect())
    assert got == Counter([(None, 1, False), (None, 2, False), (None, 7, False), (None, None, True), (1, 1, True), (2, 2, True), (7, 7, True), (7, 7, True), (7, 7, False), (8, 7, False)])
    left = Counter((r.doc_id, r.text) for r in neardup.without_copies(docs, 3, 85).collect())
    assert left == Counter([(None, None), (1, near(a)), (2, near(b)), (7, c), (7, d)])


def test_block_anchors_equal_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(2000)]
    shared = [[rng.choice(words) for _ in range(n)] for n in (49, 50, 51, 130)]
    texts = [(None, " ".join(shared[3])), (900, None), (901, ""), (902, "a b")]
    for i in range(30):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += [rng.choice(words) for _ in range(rng.randint(0, 60))] + rng.choice(shared)
        texts.append((i, rng.choice([" ", "\n", " \t"]).join(parts)))
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in substring.repeated_passages(docs).collect()}
    key = lambda i: 1 << 60 if i is None else i
    first = {}
    for i, t in sorted(texts, key=lambda x: key(x[0])):
        w = (t or "").split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), key(i))
    for i, t in texts:
        w = (t or "").split()
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < key(i):
                gone[k : k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
        assert sum(s.stop - s.start for s in r.spans) == sum(gone)
    # rows that repeat a doc_id are judged each by its own text; very long texts
    long = [f"q{i}" for i in range(120_000)]
    twins = documents(spark, [(1, " ".join(shared[3])), (5, " ".join(["x"] * 3 + shared[3])), (5, "y " * 200), (5, " ".join(shared[3][:60])), (7, " ".join(long)), (8, " ".join(["a"] + long[5:] + ["b"]))])
    assert Counter((r.doc_id, r.n_words, r.n_removed) for r in substring.repeated_passages(twins).collect()) == Counter([(1, 130, 0), (5, 133, 130), (5, 200, 0), (5, 60, 60), (7, 120_000, 0), (8, 119_997, 119_995)])
    cut = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    assert all(len(cut[i].text.split()) == got[i].n_words - got[i].n_removed for i in cut) and None not in cut
    assert substring.repeated_passages(docs.where("doc_id < 0")).count() == 0
    with pytest.raises(ValueError):
        substring.repeated_passages(docs, 49)


def test_language_models(spark):
    rng = random.Random(8)
    stock = {"aa": ["kalo", "mire", "tuna", "pelo"], "bb": ["schtro", "gwyn", "zrk", "thwump"]}
    texts, langs = [], {}
    for i in range(300):
        x = "aa" if i % 3 else "bb"
        texts.append((i, " ".join(rng.choices(stock[x], k=rng.randint(3, 60))) + ("." if i % 2 else "")))
        langs[i] = x
    odd = [(900, None), (901, ""), (902, "12 34"), (903, "кириллица другая речь " * 20), (904, "KALO mire TUNA pelo " * 5)]
    docs = documents(spark, texts + odd, langs)
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(got[i].lang_pred == langs[i] and 0 <= got[i].score <= 1 and not got[i].rejected for i in langs)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and all(got[i].rejected for i in (900, 901, 902, 903)) and got[904].lang_pred == "aa"
    windows = np.array([[0, 0, 0, 0, c] for c in range(32, 5000)], np.uint64)
    assert np.all(np.exp(model.log_probability(windows)).sum(0) < 1.3)
    assert langid.fit(docs.where("doc_id < 0")) is None and langid.predict(docs, None).where("rejected").count() == len(texts + odd)


def test_language_of_empty_texts(spark):
    """Null, empty and letterless texts first, last and alone in a batch are `und`, and leave their neighbours alone."""
    rng = random.Random(3)
    stock = {"aa": "kalomiretuna", "bb": "schtrgwynzk"}
    rows = [(i, "".join(rng.choices(stock[x] + " ", k=90)), x) for i in range(200) for x in ["ab"[i % 2] * 2]]
    model = langid.fit(documents(spark, [r[:2] for r in rows], {i: x for i, _, x in rows}))
    word = rows[0][1]
    alone = langid.cross_entropies(model, [word])
    for odd in (None, "", "7 8", " \n"):
        for texts in ([odd], [odd, word], [word, odd], [odd, odd, word, odd, word, odd]):
            n, ce = langid.cross_entropies(model, texts)
            assert [x > 0 for x in n] == [t is word for t in texts]
            assert all(abs(ce[k] - alone[1][0]).max() < 1e-9 and n[k] == alone[0][0] for k, t in enumerate(texts) if t is word)
    same = documents(spark, [(1, word), (1, word), (None, word), (2, None), (3, word + " " + "kalo mire " * 30_000)])
    got = [tuple(r) for r in langid.predict(same.select("doc_id", "text").coalesce(1), model).select("doc_id", "lang_pred", "rejected").collect()]
    assert Counter(got) == Counter([(1, "aa", False), (1, "aa", False), (None, "aa", False), (2, "und", True), (3, "aa", False)])


def test_language_rejection_rate(spark):
    """Texts of known languages stay at every length; another alphabet and random letters go."""
    rng = random.Random(21)
    words = {x: ["".join(rng.choices(a, k=rng.randint(2, 9))) for _ in range(150)] for x, a in (("aa", "aeioklmnprst"), ("bb", "bdfgjoruvwyz"))}
    make = lambda i, x: (i, " ".join(rng.choices(words[x], k=rng.choice([1, 2, 4, 9, 30, 200]))), x)
    train = [make(i, ["aa", "bb"][i % 2]) for i in range(3000)]
    model = langid.fit(documents(spark, [r[:2] for r in train], {i: x for i, _, x in train}))
    fresh = [make(i, ["aa", "bb"][i % 2]) for i in range(10_000, 13_000)]
    odd = [(20_000 + i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=300)), None) for i in range(50)]
    got = {r.doc_id: r.rejected for r in langid.predict(documents(spark, [r[:2] for r in fresh + odd]), model).collect()}
    assert sum(got[r[0]] for r in fresh) <= 3 and all(got[r[0]] for r in odd)


def test_language_models_keep_every_ngram(spark):
    """More distinct 5-grams than any limit of old, most of them seen once: cross-entropies equal Kneser-Ney by brute force."""
    rng = random.Random(12)
    texts = {i: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12_000)) for i in range(24)}
    docs = documents(spark, list(texts.items()), dict.fromkeys(texts, "aa"))
    aside = {r.doc_id for r in docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(langid.CALIBRATION_PART)) == 0).collect()}
    level = Counter(w[i : i + 5] for d, x in texts.items() if d not in aside for w in ["\0" * 4 + x] for i in range(len(x)))
    assert len(level) > 200_000
    seen = {}
    for order in range(5, 0, -1):
        once, twice = (sum(n == m for n in level.values()) for m in (1, 2))
        total, kinds = Counter(), Counter()
        for g, n in level.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        seen[order] = level, total, kinds, min(0.95, once / (once + 2 * twice)) if once else 0.5
        level = Counter(g[1:] for g in level)

    def probability(gram):
        p = 1 / 4096
        for order in range(1, 6):
            level, total, kinds, d = seen[order]
            g = gram[5 - order :]
            if total[g[:-1]]:
                p = (max(level[g] - d, 0) + d * kinds[g[:-1]] * p) / total[g[:-1]]
        return p

    got = {r.doc_id: r.cross_entropy for r in langid.predict(docs, langid.fit(docs)).collect()}
    for d in [min(aside), min(texts.keys() - aside)]:
        w = "\0" * 4 + texts[d]
        want = -sum(math.log(probability(w[i : i + 5])) for i in range(len(texts[d]))) / len(texts[d])
        assert abs(got[d] - want) < 1e-4


def test_importance(spark, monkeypatch):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choices(["good", "fine", "well", "the"] if i % 2 else ["bad", "spam", "junk", "the"], k=30))) for i in range(200)] + [(900, None), (901, "")]
    docs, target = documents(spark, texts), spark.createDataFrame([(i,) for i in range(1, 60, 2)] + [(None,)], "doc_id long")
    rows = importance.importance_resample(docs, target, 0.4).collect()
    chosen = {r.doc_id for r in rows if r.selected}
    assert len(rows) == 202 and len(chosen) == round(0.4 * 202) and sum(i % 2 for i in chosen) > 75
    # by brute force: add-one models of words and pairs, summed log ratios, Gumbel noise, the greatest
    known, counts, bags = set(range(1, 60, 2)), [Counter(), Counter()], {}
    for i, t in texts:
        w = (t or "").lower().split()
        bags[i] = Counter(w + list(zip(w, w[1:], strict=False)))
        counts[1] += bags[i]
        if i in known:
            counts[0] += bags[i]
    total = [sum(c.values()) + importance.BUCKETS for c in counts]
    ratio = {x: math.log((counts[0][x] + 1) / total[0]) - math.log((counts[1][x] + 1) / total[1]) for x in counts[1]}
    for r in rows:
        assert abs(r.log_weight - sum(n * ratio[x] for x, n in bags[r.doc_id].items())) < 1e-6
        assert r.n_features == sum(bags[r.doc_id].values())
        h = xxhash.xxh64_intdigest(struct.pack("<i", 17), xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), 42)) >> 11
        noise = -math.log(-math.log((h + 0.5) / (1 << 53)))
        assert abs(r.gumbel_key - (noise + (r.log_weight if r.n_features else -1e9))) < 1e-6
    assert chosen == {r.doc_id for r in sorted(rows, key=lambda r: (-r.gumbel_key, r.doc_id))[: len(chosen)]}
    assert importance.importance_resample(docs.where("doc_id < 0"), target).count() == 0
    same = importance.importance_resample(documents(spark, [(1, "a b")] * 5 + [(2, "zz " * 50_000), (None, None)]), target, 0.5).collect()
    assert len(same) == 7 and sum(r.selected for r in same) == 4  # round half to even
    keys = spark.range(5000).selectExpr("id", "CAST(id % 7 AS double) AS key")
    monkeypatch.setattr(importance, "RANKED", 100)
    top = importance.top_share(keys, "key", ["id"], 1500).where("selected").collect()
    assert {r.id for r in top} == {i for _, i in sorted((-(i % 7), i) for i in range(5000))[:1500]}
    # no more than RANKED rows are ranked, whether most rows are wordless, have one id or none, or keys next to each other
    sizes = []
    ranked = importance._narrowed
    monkeypatch.setattr(importance, "_narrowed", lambda *a: sizes.append((out := ranked(*a))[2]) or out)
    near = [math.nextafter(1e9, 2e9), 1e9]
    for key, ident in ((lambda i: -1e9 + (i % 3000) / 1e7, lambda i: i), (lambda i: 5.0, lambda i: None if i % 3 else 7), (lambda i: near[i % 2], lambda i: i % 5), (lambda i: float(i % 2), lambda i: 2)):
        rows = [(i, key(i), ident(i)) for i in range(3000)]
        df = spark.createDataFrame(rows, "row long, key double, doc_id long")
        sizes.clear()
        got = {r.row for r in importance.top_share(df, "key", ["doc_id", "row"], 1234).where("selected").collect()}
        assert got == {i for i, *_ in sorted(rows, key=lambda r: (-r[1], r[2] is not None, r[2] or 0, r[0]))[:1234]} and sizes[-1] <= 100


def test_curves_recall_and_edges(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 16))
    x[200:700] = x[200]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2020, [float("nan")] + [1.0] * 15), (2040, [1.0] * 15 + [None]), (2061, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = {}
    for r in curves.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        score = np.full(2062, -np.inf)
        score[:1500], score[2061] = x @ x[q], x[q][:3].sum()  # a shorter vector ends in zeros
        want = [i for i in np.lexsort((np.arange(2062), -score.round(9))) if i != q][:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(s - score[v]) < 1e-9 for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(want))
    assert hits / 20 / len(got) >= 0.9
    assert curves.nearest(df.where("vec_id < 0")).count() == 0
    assert curves.nearest(df.where("vec_id < 5")).count() == 4
    assert len(np.unique(curves.hilbert_keys(np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3), 3))) == 512


@pytest.mark.parametrize("n", [150, 900, 5000])
def test_curves_recall_at_sizes(spark, n):
    """Vectors without any structure: recall of at least 0.9 at every size, from windows of about one table a query."""
    x = np.random.default_rng(n).standard_normal((n, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in curves.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    score = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(score, -np.inf)
    hits = sum(len(found & set(np.argsort(-score[q])[:20].tolist())) for q, found in got.items())
    assert len(got) == -(-n // 20) and hits >= 0.9 * 20 * len(got)


@pytest.mark.parametrize("kind", ["offset", "lengths", "clusters", "uniform", "repeats"])
def test_curves_recall_on_structure(spark, kind):
    """An offset in every component, uneven lengths, clusters, positive components, many equal vectors under many ids or one."""
    rng, n = np.random.default_rng(len(kind)), 2500
    x = rng.standard_normal((n, 32))
    if kind == "offset":
        x += 8
    elif kind == "lengths":
        x *= np.exp(rng.standard_normal((n, 1)))
    elif kind == "clusters":
        x = 3 * rng.standard_normal((30, 32))[rng.integers(0, 30, n)] + x / 2
    elif kind == "uniform":
        x = rng.random((n, 32))
    else:
        x[: n // 3] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist())] * 30, "vec_id long, embedding array<double>")
    got = {}
    for r in curves.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    score = (x @ x.T).round(9)
    np.fill_diagonal(score, -np.inf)
    hits = 0
    for q, found in got.items():
        assert sorted(k for k, _ in found) == list(range(1, 21)) and len({v for _, v in found}) == 20
        hits += len({v for _, v in found} & set(np.lexsort((np.arange(n), -score[q]))[:20].tolist()))
    assert len(got) == n // 20 and hits >= 0.9 * 20 * len(got)


def test_packing(spark):
    rng = random.Random(6)
    texts = [(i, "tok " * rng.choice([1, 2, 5, 9, 30, 31, 33, 70, 200])) for i in range(120)] + [(900, None), (901, ""), (None, "a"), (5, "a"), (5, "a"), (77777, "x <|endoftext|> y")]
    rows = packing.pack_documents(documents(spark, texts), BPE, capacity=64).collect()
    sequences, lengths = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    encode = tokenizers.Tokenizer.from_file(BPE).encode
    once = Counter(i for i, _ in texts)
    for i, t in texts:  # pieces by the library: only the first may be short, and each has its own ids
        ids = np.array([*encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        cuts = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        if once[i] == 1:
            assert mine == [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    want = sorted(len(encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)
    gaps, n = [], 0
    for length in sorted((r.length for r in rows), reverse=True):
        fit = min((g for g in gaps if g >= length), default=None)
        if fit is None:
            n, fit = n + 1, 64
        else:
            gaps.remove(fit)
        gaps.append(fit - length)
    assert sum(want) == sum(r.length for r in rows) and len(sequences) <= n * 1.05 + 1
    assert packing.pack_documents(documents(spark, texts).where("doc_id < 0"), BPE).count() == 0


def test_token_files(spark):
    texts = [(7, "a b\nc"), (3, None), (5, "  x  y "), (-2, "it's <|endoftext|> end"), (None, ""), (4, "word, " * 4000)]
    t = tokenizers.Tokenizer.from_file(BPE)
    got = token_files.round_trip(documents(spark, texts), BPE).collect()
    start = 0
    for r, (i, text) in zip(sorted(got, key=lambda r: r.start), sorted(texts, key=lambda x: -1 << 60 if x[0] is None else x[0]), strict=True):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.round_trip(documents(spark, texts).where("doc_id < -5"), BPE).count() == 0


def test_sharding(spark):
    texts = [(i, "x" * (i % 7)) for i in range(3000)] + [(None, None), (5, "xxxxx"), (5, None), (9999, "é")]
    rows = sharding.shard_documents(documents(spark, texts), sharding.even_tree(8)).collect()
    assert len(rows) == len(texts) and {r.shard for r in rows} == set(range(8))
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 8) for r in rows) and 200 < sum(r.grown_shard == 8 for r in rows) < 480
    assert next((r.size, r.text_crc32) for r in rows if r.doc_id == 9999) == (3, zlib.crc32("é".encode()))
    assert next((r.size, r.text_crc32) for r in rows if r.doc_id is None) == (1, 0)
    assert sharding.even_tree(10) == sharding.grown_tree(sharding.grown_tree(sharding.even_tree(8)))
    assert sharding.shard_documents(documents(spark, []), sharding.even_tree(8)).count() == 0

    def descend(node, key):  # by brute force: the least weighted draw of each level
        weight = lambda x: sum(map(weight, x.values())) if isinstance(x, dict) else x

        def draw(name):
            h = xxhash.xxh64_intdigest(str(name).encode(), xxhash.xxh64_intdigest(struct.pack("<q", key), 42)) >> 11
            return -math.log((h + 0.5) / (1 << 53)) / weight(node[name])

        name = next(iter(node)) if len(node) == 1 else min(node, key=draw)
        return descend(node[name], key) if isinstance(node[name], dict) else name

    for r in rows[:400]:
        if r.doc_id is not None:
            assert (r.shard, r.grown_shard) == (descend(sharding.even_tree(8), r.doc_id), descend(sharding.even_tree(9), r.doc_id))
    tree = sharding.even_tree(8)
    heavy = {k: {r: {s: w * (3 if s == 0 else 1) for s, w in shards.items()} for r, shards in racks.items()} for k, racks in tree.items()}
    moved = [r for r in sharding.shard_documents(documents(spark, texts), tree, heavy).collect() if r.shard != r.grown_shard]
    assert moved and all(r.grown_shard in range(4) for r in moved)  # only into the region that weighs more


def test_spaced_seeds(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(500)]
    item = [rng.choice(words) for _ in range(30)]
    swapped = [w if k % 7 else "other" for k, w in enumerate(item)]
    noise = lambda n: [rng.choice(words) for _ in range(n)]
    texts = [(1, " ".join(noise(50) + item + noise(9))), (2, ", ".join(noise(5) + swapped).upper()), (3, " ".join(noise(200))), (4, " ".join(item[:14])), (5, " ".join(item[5:20])), (6, None), (7, ""), (None, " ".join(item)), (8, " ".join([w for x in item for w in (x, "gap")])), (1, "x")]
    bench = spark.createDataFrame([(0, " ".join(item)), (1, "too short"), (2, None), (3, " ".join(item))], "item_id long, text string")
    docs = documents(spark, texts)
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(d, i) for d in (1, 2, 5, None) for i in (0, 3)}
    with monkeypatch.context() as m:  # many seeds: joined by hash in one pass
        m.setattr(decontam, "BLOCK_SEEDS", 5)
        assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench.unionByName(bench.selectExpr("item_id", "concat('zero ', text) AS text"))).collect()} == got
    assert {r.doc_id for r in decontam.decontaminate(docs, bench).collect()} == {3, 4, 6, 7, 8}
    assert decontam.decontaminate(docs, bench.where("item_id < 0")).count() == len(texts) and decontam.contaminated(docs.where("doc_id < 0"), bench).count() == 0
    short = spark.createDataFrame([(7, "one two, Three four five"), (None, "one two three four five"), (8, "one two three four")], "item_id long, text string")
    few = documents(spark, [(1, "zero One two three FOUR five six"), (2, "one two three four"), (3, None), (4, "one two three four five")])
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(few, short).collect()} == {(d, i) for d in (1, 4) for i in (7, None)}
    clash = few.withColumn("_bad", F.lit(1)).withColumn("words", F.lit(2))
    assert {(r.doc_id, r._bad, r.words) for r in decontam.decontaminate(clash, short).collect()} == {(2, 1, 2), (3, 1, 2)}
    report = {(r.doc_id, r.contaminated, r.n_items, r.first_item) for r in decontam.contamination_report(docs, bench).collect()}
    assert (1, True, 2, 0) in report and (3, False, 0, None) in report


def test_revisits(spark):
    h = lambda **x: {k.replace("_", "-"): v for k, v in x.items()}
    rows = [
        (1, "http://www.A.com/x/", 10, 200, "e1", None, "d1", h(etag="e1", date="1", content_type="t")),
        (2, "https://a.com/x?utm_source=q#f", 20, 304, 'W/e1', None, None, h(date="2", content_type="no", vary="v")),
        (3, "http://a.com/x", 15, 200, "e2", None, "d2", h(etag="e2")),
        (4, "http://a.com/x", 5, 304, "e1", None, None, None),
        (5, "http://a.com/x.html", 30, 304, "e2", None, None, h(date="5")),
        (6, None, 30, 304, "e2", None, None, None),
        (7, "http://a.com/x", 31, 404, None, None, None, None),
        (8, "http://a.com/x", 32, 304, None, None, "d2", None),
    ]
    df = spark.createDataFrame(rows, warc.CAPTURE)
    got = {r.record_id: r for r in warc.resolve_revisits(df).collect()}
    assert {k: (r.outcome, r.resolved_id) for k, r in got.items()} == {1: ("full", 1), 2: ("mismatch", None), 3: ("full", 3), 4: ("orphan", None), 5: ("revisit", 3), 6: ("orphan", None), 7: ("other", None), 8: ("revisit", 3)}
    assert got[5].merged_headers == {"etag": "e2", "date": "5"}
    assert warc.resolve_revisits(df.where("record_id < 0")).count() == 0
    clash = df.selectExpr("*", "'mine' AS canonical", "7L AS row", "'x' AS is_full", "1 AS stretch")
    again = {r.record_id: r for r in warc.resolve_revisits(clash).collect()}
    assert all((r.outcome, r.resolved_id, r.canonical) == (got[k].outcome, got[k].resolved_id, got[k].canonical) and (r.row, r.is_full, r.stretch) == (7, "x", 1) for k, r in again.items())
    lost = spark.createDataFrame([(1, None, 5, 200, None, None, None, None), (2, "http://a/", None, 200, "e", None, None, None), (3, "http://a/", None, 304, "e", None, None, None)], warc.CAPTURE)
    assert {r.record_id: (r.outcome, r.resolved_id) for r in warc.resolve_revisits(lost).collect()} == {1: ("full", 1), 2: ("full", 2), 3: ("revisit", 2)}
    many = spark.range(40_000).selectExpr("id AS record_id", "'http://hot.com/' AS url", "id AS at", "IF(id % 9 = 0, 200, 304) AS status", "CAST(NULL AS string) AS etag", "CAST(NULL AS string) AS last_modified", "'d' AS digest", "CAST(NULL AS map<string,string>) AS headers")
    assert warc.resolve_revisits(many).where("resolved_id <> record_id - record_id % 9").count() == 0


def brute_models(texts, floor=1 / 4096):
    """Kneser-Ney cross-entropy of a text under 5-gram counts of `texts`, by brute force."""
    level, seen = Counter(w[i : i + 5] for x in texts for w in ["\0" * 4 + x] for i in range(len(x))), {}
    for order in range(5, 0, -1):
        once, twice = (sum(n == m for n in level.values()) for m in (1, 2))
        total, kinds = Counter(), Counter()
        for g, n in level.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        seen[order] = level, total, kinds, min(0.95, once / (once + 2 * twice)) if once else 0.5
        level = Counter(g[1:] for g in level)

    def entropy(text):
        logs = 0.0
        for i in range(len(text)):
            gram, p = ("\0" * 4 + text)[i : i + 5], floor
            for order in range(1, 6):
                level, total, kinds, d = seen[order]
                g = gram[5 - order :]
                if total[g[:-1]]:
                    p = (max(level[g] - d, 0) + d * kinds[g[:-1]] * p) / total[g[:-1]]
            logs -= math.log(p)
        return logs / len(text)

    return entropy


def test_every_row_is_counted_and_measured(spark, monkeypatch):
    """The model holds the counts of all rows, and the limit comes from all rows, each measured by the other half's counts."""
    rng = random.Random(31)
    texts = {i: (" ".join("".join(rng.choices("abcde" if i % 3 else "uvwxy", k=rng.randint(2, 6))) for _ in range(rng.randint(4, 40)))) for i in range(90)}
    langs = {i: "aa" if i % 3 else "bb" for i in texts}
    docs = documents(spark, list(texts.items()), langs)
    kept, materialize = {}, langid.materialize
    monkeypatch.setattr(langid, "materialize", lambda df, name: kept.update({name: materialize(df, name)}) or kept[name])
    model = langid.fit_whole(docs)
    monkeypatch.undo()
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    whole = {x: brute_models([t for i, t in texts.items() if langs[i] == x]) for x in ("aa", "bb")}
    assert all(got[i].lang_pred == langs[i] and abs(got[i].cross_entropy - whole[langs[i]](t)) < 1e-4 for i, t in texts.items())
    half = {r.doc_id: r.h for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("h")).collect()}
    others = {(h, x): brute_models([t for i, t in texts.items() if langs[i] == x and half[i] != h]) for h in (0, 1) for x in ("aa", "bb")}
    want = sorted((len(t), others[half[i], langs[i]](t)) for i, t in texts.items())
    measured = sorted((r.n, r.ce) for r in kept["langid-measured"].collect())
    assert [n for n, _ in measured] == [n for n, _ in want] and sum(c for _, c in measured) == pytest.approx(sum(c for _, c in want), abs=1e-3)
    # the limit as worked out from the rows at once
    j, n, ce = (np.array(x) for x in zip(*((r.j, r.n, r.ce) for r in kept["langid-measured"].collect()), strict=True))
    low = lambda x: np.sort(x)[(len(x) - 1) // 2]
    means = np.array([low(ce[(j == k) & (n >= low(n[j == k]))]) for k in (0, 1)])
    assert model.means == pytest.approx(means)
    weight = 1 / (1 / n + 1 / low(n))
    (between, single), *_ = np.linalg.lstsq(np.stack([weight, weight / n], 1), weight * (ce - means[j]) ** 2, rcond=None)
    between, single = ((90 * max(x, 0) + 30 * p) / 120 for x, p in zip((between, single), langid.PRIOR, strict=False))
    z = np.sort((ce - means[j]) / np.sqrt(between + single / n))[-5:]
    assert model.spread == pytest.approx((between**0.5, single**0.5, max(z[0], 0) + (5 * (z - z[0]).mean() + 15) / 35 * math.log(5 / 90 / 1e-6)), rel=1e-6)


def test_rejection_rate_of_the_whole_fit(spark):
    """As of `fit`: texts of known languages stay at every length, others go; a language of one row, and no rows, are no obstacle."""
    rng = random.Random(22)
    words = {x: ["".join(rng.choices(a, k=rng.randint(2, 9))) for _ in range(150)] for x, a in (("aa", "aeioklmnprst"), ("bb", "bdfgjoruvwyz"))}
    make = lambda i, x: (i, " ".join(rng.choices(words[x], k=rng.choice([1, 2, 4, 9, 30, 200]))), x)
    train = [make(i, ["aa", "bb"][i % 2]) for i in range(2000)] + [(5000, "один текст", "cc")]
    model = langid.fit_whole(documents(spark, [r[:2] for r in train], {i: x for i, _, x in train}))
    assert model.langs == ["aa", "bb", "cc"]
    fresh = [make(i, ["aa", "bb"][i % 2]) for i in range(10_000, 12_000)]
    odd = [(20_000 + i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=300)), None) for i in range(50)]
    got = {r.doc_id: r.rejected for r in langid.predict(documents(spark, [r[:2] for r in fresh + odd]), model).collect()}
    assert sum(got[r[0]] for r in fresh) <= 3 and all(got[r[0]] for r in odd)
    assert langid.fit_whole(documents(spark, [(1, None)], {1: "aa"})) is None
