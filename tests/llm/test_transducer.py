import random

import numpy as np
import pyarrow as pa
import pytest

from binsparrow.llm import transducer

tokenizers = pytest.importorskip("tokenizers")
import public_tokenizers  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", "e", " ", "  ", "\n", "'", "'s", "'re", "'r", "'l", "ll", "ve", "1", "23", ".", ",", "!", "é", "ñ", "中", "文", " ", "　", "\t", "the", " ing", "ion", "😀", "<|endoftext|>", "<|", "A", "\r\n", "'T", "ſ", "½", "́", "\x1c", "\x85", "​"]


def texts(seed=1):
    rng = random.Random(seed)
    out = ["".join(rng.choices(PIECES, k=rng.randint(0, 60))) for _ in range(1500)]
    out += ["".join(chr(rng.choice([rng.randint(32, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(rng.randint(0, 300))) for _ in range(150)]
    out += ["".join(rng.choices("abcdefghij", k=5000)), "a" * 9000, " " * 3000 + "x", "x" + "\n" * 700 + " y", "é" * 2000, "the " * 4000, "", "<|endoftext|>" * 40]
    return out


def by_library(rows):
    library = tokenizers.Tokenizer.from_file(BPE)
    return [len(e.ids) for e in library.encode_batch([t or "" for t in rows], add_special_tokens=False)]


@pytest.mark.parametrize(("chunk", "part", "states"), [(256, 4 << 20, 120_000), (7, 4 << 20, 120_000), (16, 1000, 300)])
def test_counts_equal_the_library(monkeypatch, chunk, part, states):
    """Whatever the cuts, and however often states are forgotten."""
    monkeypatch.setattr(transducer, "CHUNK", chunk)
    monkeypatch.setattr(transducer, "SLICE_BYTES", part)
    monkeypatch.setattr(transducer, "STATES", states)
    rows = texts(chunk)
    machine = transducer.Machine(BPE)
    assert machine.counts(pa.array(rows)).tolist() == by_library(rows)
    assert machine.counts(pa.array([None, "a", None], pa.string())).tolist() == [0, 1, 0]
    assert machine.counts(pa.array([], pa.string())).tolist() == []


def test_followers_equal_the_library():
    """Two tokens follow each other just where the library encodes their string so."""
    machine = transducer.Machine(BPE)
    names, rng = sorted(machine.bpe.place), random.Random(4)
    short = [n for n in names if len(n) <= 3]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(2000)] + [(rng.choice(short), rng.choice(short)) for _ in range(6000)] + [(x, x) for x in rng.sample(short, 500)]
    for a, b in pairs:
        row = np.unpackbits(np.frombuffer(machine.bpe.row(machine.bpe.place[a]), np.uint8))
        want = [t.value for t in machine.tokenizer.model.tokenize(a + b)] == [a, b]
        if machine.bpe.usable[machine.bpe.place[a]]:
            assert row[machine.bpe.place[b]] == want, (a, b)


def test_state_maps_compose():
    """Composed maps of chunks give what one walk over all bytes gives, from any carried state."""
    machine = transducer.Machine(BPE)
    data = "don't stop, thinking  about\n\n it's 12ñandú".encode() * 50
    for state in (0, 1):
        end, total = machine.keys[state] if state < len(machine.keys) else machine.keys[0], 0
        carried = machine.number[end]
        for b in data:
            end, more = machine.step(end, b)
            total += more
        at = np.arange(0, len(data), 64)
        count, exits = machine.run_chunks(np.frombuffer(data, np.uint8), at, np.minimum(64, len(data) - at), np.array([carried], np.int32), np.array([0]))
        assert count.tolist() == [total] and machine.keys[exits[0]] == end


def test_token_counts(spark):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns, an empty table, the limit."""
    rows = [(1, "a b", 5, 7), (1, "a b", 5, 7), (None, "x", 0, 0), (2, None, 1, 1), (3, "", 1, 1), (4, "word " * 1024, 1, 1), (5, "z" * 300_000, 1, 1), (6, "word" + " word" * 1023, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, n_bytes long")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in transducer.token_counts(df, BPE).collect()))
    want = sorted((i is None, i or 0, len(t or ""), n, n > 1024) for (i, t, *_), n in zip(rows, by_library([r[1] for r in rows]), strict=True))
    assert got == want and [w[-1] for w in want].count(True) == 2
    assert transducer.token_counts(df.where("doc_id < 0"), BPE).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert transducer.token_counts(df.where("doc_id < 0"), BPE).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level BPE"):
        transducer.Machine(public_tokenizers.path("word_bpe_49k.json"))
