import gzip
import io
import random

import pytest

from binsparrow.sources import readers, records


def layout(rng, n, wide=9):
    """Records over several lines with marks inside qualities, and their text."""
    rows, text = [], ""
    for i in range(n):
        size = rng.randint(1, wide)
        seq = "".join(rng.choice("ACGTN") for _ in range(size))
        end = rng.choice(["\n", "\r\n"])
        if rng.random() < 0.2:
            qual = None
        else:
            qual = "".join(rng.choice("@@+>IJ") for _ in range(size))
        comment = rng.choice(["", "x y", "@z"])
        cut = lambda s: end.join(s[k : k + 4] for k in range(0, len(s), 4)) + end  # noqa: E731, B023
        text += ("@" if qual else ">") + f"r{i}" + (rng.choice(" \t") + comment if comment else "") + end + cut(seq)
        if qual:
            text += "+" + rng.choice(["", f"r{i}"]) + end + cut(qual)
        if rng.random() < 0.1:
            text += end
        rows.append((f"r{i}", comment, seq, qual))
    return rows, text


def test_serial_parser():
    for seed in range(30):
        rows, text = layout(random.Random(seed), 60)
        got = [r[1:] for r in records.parse(records.Lines(io.BytesIO(text.encode()), 0))]
        assert got == rows


def test_every_cut_gives_the_serial_rows(spark, tmp_path):
    """Ranges from a few bytes to whole files; qualities that look like headers make guesses fail, and the rows stay right."""
    for seed, n in ((1, 40), (2, 60)):
        rows, text = layout(random.Random(seed), n)
        (tmp_path / f"{seed}.fq").write_bytes(text.encode())
        for size in (7, 50, 333, 1 << 20) if seed == 1 else (41,):
            found = records.read_records(spark, str(tmp_path / f"{seed}.fq"), size).orderBy("read_id").collect()
            assert [tuple(r)[1:] for r in found] == rows and len({r.read_id for r in found}) == n


def test_wrong_guesses_are_read_again(spark, tmp_path, monkeypatch):
    """A quality of many lines that is itself a valid file of records: ranges inside it guess wrong."""
    inner = "@a\nAC\n+\nII\n" * 60
    body = inner.replace("\n", "")
    lines = inner.split("\n")[:-1]
    text = "@whole\n" + "\n".join("C" * len(x) for x in lines) + "\n+\n" + inner + "@last x\nGG\n+\nII\n"
    (tmp_path / "a.fq").write_text(text)
    asked = []
    survey = records._surveyed
    monkeypatch.setattr(records, "_surveyed", lambda ranges, starts: asked.append(starts) or survey(ranges, starts))
    got = [tuple(r)[1:] for r in records.read_records(spark, str(tmp_path / "a.fq"), 200).orderBy("read_id").collect()]
    assert got == [("whole", "", "C" * len(body), body), ("last", "x", "GG", "II")]
    assert asked[0] is None and all(len(a) == 1 for a in asked[1:])


def test_folders_compression_and_faults(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows, text = layout(random.Random(4), 50)
    (tmp_path / "in/a.fq").write_bytes(text.encode())
    (tmp_path / "in/b.fq.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "in/c.fq").write_text("")
    assert [tuple(r)[1:] for r in readers.read_fastq(spark, str(tmp_path / "in")).orderBy("read_id").collect()] == rows + rows
    long = "A" * 3_000_000
    (tmp_path / "long.fa").write_text(f">one\n{long}\n>two z\nAC\n\nGT\n")
    assert [(r.name, len(r.seq)) for r in records.read_records(spark, f"file://{tmp_path}/long.fa", 1 << 20).orderBy("read_id").collect()] == [("one", 3_000_000), ("two", 4)]
    for k, broken in enumerate(("@r1\nACGT\n+\n@II", "@r1\nACGT\n+\n", "@r1\nACGT\n+\nIIIII\n", "@r1\nACGT\n+\nIII\n@r2\nA\n+\nI\n")):
        (tmp_path / f"broken{k}.fq").write_text(broken)
        with pytest.raises(ValueError, match="truncated quality"):
            records.read_records(spark, str(tmp_path / f"broken{k}.fq"))
    with pytest.raises(FileNotFoundError):
        records.read_records(spark, str(tmp_path / "absent"))
