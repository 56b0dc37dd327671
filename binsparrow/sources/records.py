"""FASTA and FASTQ records of any layout: sequences and qualities over several lines, qualities that begin with a record mark, records of any length.

A file is cut into byte ranges, and a range has the records that begin in it. Where its first record begins cannot always be told from the range alone, as a quality
line may look like a header. So every range guesses: the first line from which a few records can be read. It reads to its end and says where the
next record begins. On the driver (two numbers a range) these ends are held against the guesses; a range that guessed wrong, which takes contrived data, is read again
from the right place. Then all ranges are read in parallel from where they truly begin: the rows are those of one serial reader.

Paths are those that pyarrow opens; compressed files are one range.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a range.
RANGE_BYTES = 64 << 20
#: Records that must be readable from a guessed beginning, and their bytes.
PROOF, PROOF_BYTES = 8, 1 << 20
SCHEMA = "read_id long, name string, comment string, seq string, qual string"


class Record(NamedTuple):
    at: int
    name: str
    comment: str
    seq: str
    qual: str | None


class Broken(ValueError):
    """A record whose quality has another length than its sequence."""


class Lines:
    """Lines of a stream with their places; one can be put back."""

    def __init__(self, stream, at: int):
        self.stream, self.at, self.held = stream, at, None

    def next(self) -> tuple[int, bytes]:
        """(place, line without its end); past the end the line is None."""
        if self.held is not None:
            out, self.held = self.held, None
            return out
        at, line = self.at, self.stream.readline()
        self.at += len(line)
        return at, line.rstrip(b"\n").removesuffix(b"\r") if line else None

    def back(self, at: int, line: bytes) -> None:
        self.held = at, line


def parse(lines: Lines) -> Iterator[Record]:
    """Records from here on: a header line with a mark, sequence lines up to a line that begins with a mark or '+', after a '+' line quality lines until
    they are as long as the sequence. What stands between a quality and the next mark is skipped."""
    while True:
        at, line = lines.next()
        while line is not None and line[:1] not in (b">", b"@"):
            at, line = lines.next()
        if line is None:
            return
        name, _, comment = line[1:].decode(errors="replace").replace("\t", " ", 1).partition(" ")
        seq: list[bytes] = []
        place, line = lines.next()
        while line is not None and line[:1] not in (b">", b"@", b"+"):
            seq.append(line)
            place, line = lines.next()
        whole = b"".join(seq)
        if line is None or line[:1] != b"+":
            if line is not None:
                lines.back(place, line)
            yield Record(at, name, comment.strip(), whole.decode(errors="replace"), None)
            continue
        qual = b""
        while True:
            place, line = lines.next()
            if line is None:
                break
            qual += line
            if len(qual) >= len(whole):
                break
        if len(qual) != len(whole):
            raise Broken(f"truncated quality of {name} at byte {at}")
        yield Record(at, name, comment.strip(), whole.decode(errors="replace"), qual.decode(errors="replace"))


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _opened(path: str, at: int):
    system, where = _located(path)
    if where.endswith((".gz", ".bz2", ".zst")):
        return io.BufferedReader(system.open_input_stream(where, compression="detect"), 1 << 20)
    file = system.open_input_file(where)
    file.seek(at)
    return io.BufferedReader(file, 1 << 20)


def _guess(path: str, lo: int, hi: int) -> int:
    """The first line from lo on from which PROOF records, or those of PROOF_BYTES, can be read one right behind the other; hi if there is none."""
    with _opened(path, lo - 1) as stream:
        at = lo - 1 + len(stream.readline())
        while at < hi:
            line = stream.readline()
            if not line:
                return hi
            if line[:1] in b">@" and _plausible(path, at):
                return at
            at += len(line)
    return hi


def _plausible(path: str, at: int) -> bool:
    with _opened(path, at) as stream:
        lines, end = Lines(stream, at), at
        try:
            for k, r in enumerate(parse(lines)):
                if r.at != end or not r.name or k == PROOF or r.at - at > PROOF_BYTES:
                    return r.at == end and bool(r.name)
                end = lines.held[0] if lines.held else lines.at
        except Broken:
            return False
    return True


def _walk(path: str, at: int, hi: int) -> Iterator[Record]:
    """Records that begin in at..hi."""
    with _opened(path, at) as stream:
        for r in parse(Lines(stream, at)):
            if r.at >= hi:
                return
            yield r


def _end(path: str, at: int, hi: int) -> tuple[int, str | None]:
    """Where reading on from `at` leaves the range: the place behind its last record; and what is broken in it."""
    with _opened(path, at) as stream:
        lines, end = Lines(stream, at), at
        try:
            for r in parse(lines):
                if r.at >= hi:
                    break
                end = lines.held[0] if lines.held else lines.at
        except Broken as e:
            return end, str(e)
    return max(end, hi), None


def _surveyed(ranges: list[tuple[str, int, int]], starts: dict[int, int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k in b.column("id").to_pylist():
                path, lo, hi = ranges[k]
                start = starts[k] if starts else 0 if lo == 0 else _guess(path, lo, hi)
                rows.append((k, start, *(_end(path, start, hi) if start < hi else (hi, None))))
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("k", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("fault", pa.string())))})

    return run


def _read(ranges: list[tuple[str, int, int]], starts: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), *[pa.string()] * 4)
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["read_id", "name", "comment", "seq", "qual"])

        for b in batches:
            for k in b.column("id").to_pylist():
                rows, size = [], 0
                for n, r in enumerate(_walk(ranges[k][0], starts[k], ranges[k][2]) if starts[k] < ranges[k][2] else ()):
                    rows.append((k << 33 | n, *r[1:]))
                    size += len(r.seq)
                    if len(rows) == 10_000 or size > 16 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return run


def byte_ranges(path: str, size: int) -> list[tuple[str, int, int]]:
    """(file, from, to) of a file, or of all files of a folder."""
    system, where = _located(path)
    info = system.get_file_info(where)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(where, recursive=True)) if f.is_file and not f.base_name.startswith((".", "_"))]
    prefix = path[: len(path) - len(where)] if path.endswith(where) else ""
    out = []
    for f in sorted(files, key=lambda f: f.path):
        whole = f.path.endswith((".gz", ".bz2", ".zst"))
        step = (1 << 62) if whole else size
        out += [(prefix + f.path, at, min(at + step, 1 << 62 if whole else f.size)) for at in range(0, max(f.size, 1) if not whole else 1, step)]
    return out


def read_records(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """reads(read_id, name, comment, seq, qual) of a FASTA or FASTQ file or folder, in file order by read_id; qual is null for FASTA records.

    A record whose quality has another length than its sequence raises ValueError. Empty files have no records.
    """
    ranges = byte_ranges(path, range_bytes)
    if not ranges:
        return spark.createDataFrame([], SCHEMA)
    ids = lambda which: spark.createDataFrame([(k,) for k in which], "id long").repartition(len(which), F.col("id"))
    survey = lambda which, starts: {r["k"]: r for r in ids(which).mapInArrow(_surveyed(ranges, starts), "k long, start long, end long, fault string").collect()}
    found = survey(list(range(len(ranges))), None)
    starts, at, file = [], 0, None
    for k, (name, lo, hi) in enumerate(ranges):
        at, file = (0 if name != file else at), name
        start = max(at, lo)
        starts.append(start)
        if start >= hi:
            continue
        seen = found[k]
        if seen["start"] != start:
            seen = survey([k], {k: start})[k]
        if seen["fault"]:
            raise ValueError(seen["fault"])
        at = seen["end"]
    return ids(list(range(len(ranges)))).mapInArrow(_read(ranges, starts), SCHEMA)
