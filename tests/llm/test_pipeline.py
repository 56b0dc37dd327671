import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    stock = {"aa": ["kalo", "mire", "tuna", "pelo", "vona", "sile", "domu", "reka"], "bb": ["schtro", "gwyn", "zrk", "thwump", "grml", "brumf", "tschk", "pfrz"]}
    text = lambda x, n: " ".join(rng.choice(stock[x]) + rng.choice(stock[x]) for _ in range(n))
    texts = [(i, text("aa" if i % 2 else "bb", 120), "aa" if i % 2 else "bb") for i in range(80)]
    passage, item = text("aa", 70), text("bb", 30)
    texts += [(200, texts[3][1], "aa"), (201, texts[3][1].replace(" ", "\n", 1), "aa"), (202, "123 456", None), (203, None, None)]
    texts += [(300, f"{text('aa', 60)} {passage}", "aa"), (301, f"{text('aa', 60)} {passage}", "aa"), (302, f"{text('bb', 60)} {item}", "bb")]
    spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in rows}
    assert kept == {i for i, _, _ in texts} - {200, 201, 202, 203, 302}
    tokens = {i: sum(r.length for r in rows if r.doc_id == i) for i in kept}
    assert tokens[301] < 0.6 * tokens[300]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontaminate", "pack"]
