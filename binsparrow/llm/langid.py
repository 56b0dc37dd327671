"""Language identification by interpolated Kneser-Ney character models, one for each language.

Counts of character N-grams are gathered over all labelled training rows: partial counts in the tasks, summed in Spark. Every
N-gram stays. Discounts, continuation counts (distinct N-grams), context totals and log-probabilities are joins and aggregations
over the counts table. The model is one run of hashes for each order's N-grams and contexts, sorted, with a row of
log-probabilities (N-grams) or back-off weights (contexts) for each language. Tasks write it to the shared folder in ranges of
hashes, and workers map the files into memory: neither the driver nor a worker holds the model.
A text gets the language of lowest cross-entropy per character; it is rejected if that cross-entropy lies beyond the tail of
what rows of a known language show to a model that they had no part in. `fit_whole` counts all rows, and measures all: they are dealt
into two halves, and every row is measured by a model of the other half. The three models are built as one, with three columns a
language. `fit` holds a tenth of the rows out of its one model, for the limit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_file, materialize, mix, only_cache, put_file, shared_path

ORDER = 5
#: Probability of a character below order 1.
FLOOR = 1.0 / 4096
#: `fit` leaves one in so many training rows, by hash of doc_id, out of the counts; these set the rejection limit.
CALIBRATION_PART = 10
#: Parts into which `fit_whole` deals the training rows by hash of doc_id.
HALVES = 2
#: Of the percentiles of all measured rows: exact up to so many rows, and off by a row in so many beyond.
ACCURACY = 100_000
#: Share of a language's own texts that may be rejected, and the share of calibration rows that the tail is fitted to.
REJECT_RATE, TAIL = 1e-6, 0.05
#: What is held of the spread before any row is seen (variance between rows, variance of one character, mean excess of the
#: tail), and how many rows that weighs.
PRIOR, PRIOR_ROWS = (0.03**2, 2.5**2, 0.5), 30
#: Steepness of the score in nats of total log-likelihood between the two best languages, per character.
SHARPNESS = 12.0
SLICE_CHARS = 1_000_000
#: Numbers of the model in one file.
FILE_VALUES = 16_000_000
_PAD = 0


def _letter_table() -> np.ndarray:
    """Code point -> lower-cased letter, or a space for everything else."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_TABLE: list[np.ndarray] = []


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts, each behind ORDER - 1 pads, runs of non-letters as one space; and where each text's own codes begin and end."""
    if not _TABLE:
        _TABLE.append(_letter_table())
    pad = "\x00" * (ORDER - 1)
    raw = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(sizes + ORDER - 1) - sizes
    codes = _TABLE[0][raw]
    codes[(begin[:, None] - np.arange(ORDER - 1, 0, -1)).ravel()] = _PAD
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    place = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], place[begin], place[begin + sizes]


def _hash(codes: np.ndarray) -> np.ndarray:
    """Hash of the ORDER codes that end at each position from ORDER - 1 on."""
    n = len(codes) - ORDER + 1
    h = np.full(max(n, 0), ORDER, np.uint64)
    for k in range(ORDER):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    return mix(h)


def _slices(texts: list[str | None]) -> Iterator[list[str]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE_CHARS or i + 1 == len(texts):
            yield [x or "" for x in texts[at : i + 1]]
            at, size = i + 1, 0


@dataclass
class _Grams:
    """Distinct windows of some texts: the windows, their hashes, and which of them each position has, text after text."""

    windows: np.ndarray
    hashes: np.ndarray
    which: np.ndarray
    #: own positions of each text, and spaces among them
    sizes: np.ndarray
    spaces: np.ndarray


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the distinct hashes each one is, and these."""
    found = pa.array(hashes).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.to_numpy()


def _grams(texts: list[str]) -> _Grams:
    only_cache("langid", _MAPPED.clear)
    codes, first, stop = letters(texts)
    sizes = stop - first
    at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum()) - (ORDER - 1)
    which, hashes = _distinct(_hash(codes)[at])
    where = np.empty(len(hashes), np.int64)
    where[which[::-1]] = at[::-1]
    blanks = np.concatenate([[0], np.cumsum(codes == 32)])
    windows = np.lib.stride_tricks.sliding_window_view(codes, ORDER)[where] if len(where) else np.zeros((0, ORDER), np.uint32)
    return _Grams(windows, hashes.astype(np.uint64), which, sizes, blanks[stop] - blanks[first])


def _binary(rows: np.ndarray) -> pa.Array:
    """The bytes of each row of a matrix."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)]).cast(pa.binary())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial N-gram counts of each language, merged within a batch."""
    for b in batches:
        langs = b.column("lang").dictionary_encode()
        index = langs.indices.to_numpy()
        for j, lang in enumerate(langs.dictionary.to_pylist()):
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for part in _slices(b.column("text").take(pa.array(np.flatnonzero(index == j))).to_pylist()):
                g = _grams(part)
                found.append((g.hashes, g.windows, np.bincount(g.which, minlength=len(g.hashes))))
            hashes, windows, n = (np.concatenate(x) for x in zip(*found, strict=True))
            which, kinds = _distinct(hashes)
            where = np.empty(len(kinds), np.int64)
            where[which[::-1]] = np.arange(len(which))[::-1]
            if len(kinds):
                n = np.bincount(which, n, len(kinds)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), _binary(windows[where].astype("<u4")), pa.array(n)], ["lang", "gram", "n"])


@dataclass
class Range:
    """A stretch of a part's sorted hashes: the least of them, the file, and its rows there."""

    low: int
    file: str
    rows: int
    lo: int
    hi: int


@dataclass
class Model:
    langs: list[str]
    #: N-grams of order 1..ORDER (log-probabilities), then contexts of order 1..ORDER (log back-off weights)
    parts: list[list[Range]]
    #: mean cross-entropy of each language's own rows
    means: np.ndarray | None = None
    #: spread between rows, spread of a single character, and how many of them a text may lie above the mean
    spread: tuple[float, float, float] = (0.0, 0.0, math.inf)

    def find(self, part: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes a part has, and a row of values for each (zeros, if there is none)."""
        wanted = wanted.view(np.int64)
        order = np.argsort(wanted)
        wanted = wanted[order]
        seen, values = np.zeros(len(order), bool), np.zeros((len(order), len(self.langs)), np.float32)
        ranges = self.parts[part]
        cuts = np.searchsorted(wanted, np.array([r.low for r in ranges[1:]], np.int64)).tolist()
        for r, lo, hi in zip(ranges, [0, *cuts], [*cuts, len(wanted)], strict=bool(ranges)):
            if hi > lo:
                keys, rows = _mapped(r.file, r.rows, len(self.langs))
                k = np.minimum(np.searchsorted(keys[r.lo : r.hi], wanted[lo:hi]), r.hi - r.lo - 1) + r.lo
                ok = keys[k] == wanted[lo:hi]
                seen[order[lo:hi]], values[order[lo:hi]] = ok, np.where(ok[:, None], rows[k], np.float32(0))
        return seen, values

    def log_probability(self, windows: np.ndarray) -> np.ndarray:
        """Of the last code of each window of ORDER codes, for each language, by back-off from order 1 up."""
        logs = np.full((len(windows), len(self.langs)), math.log(FLOOR))
        for order in range(1, ORDER + 1):
            logs += self.find(ORDER + order - 1, _window_hash(windows[:, ORDER - order : -1]))[1]
            gram, values = self.find(order - 1, _window_hash(windows[:, ORDER - order :]))
            logs = np.where(gram[:, None], values, logs)
        return logs

    def limits(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The cross-entropy above which a text of n codes is not of language `best`."""
        if self.means is None:
            return np.full(len(n), np.inf)
        between, single, most = self.spread
        return self.means[best] + most * np.sqrt(between**2 + single**2 / np.maximum(n, 1))


#: Mapped files of the models that this process has used, by name.
_MAPPED: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _mapped(file: str, rows: int, langs: int) -> tuple[np.ndarray, np.ndarray]:
    """A file's hashes and its values, a row each."""
    if file not in _MAPPED:
        data = map_file(file, "u1")
        _MAPPED[file] = data[: 8 * rows].view("<i8"), data[8 * rows :].view("<f4").reshape(rows, langs)
    return _MAPPED[file]


def _window_hash(windows: np.ndarray) -> np.ndarray:
    h = np.full(len(windows), windows.shape[1], np.uint64)
    for k in range(windows.shape[1]):
        h = h * np.uint64(0x9E3779B97F4A7C15) + windows[:, k]
    return mix(h)


def _matrix(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def _dense(column: pa.Array, field: str, langs: int, other: float) -> np.ndarray:
    """A list of (j, field) in each row as a row of a matrix."""
    out = np.full((len(column), langs), other)
    entries = column.flatten()
    rows = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())
    out[rows, entries.field("j").to_numpy()] = entries.field(field).to_numpy()
    return out


def _back_offs(column: pa.Array, discounts: np.ndarray) -> np.ndarray:
    """Back-off weights of contexts; 1 in a language without the context."""
    weights = discounts * _dense(column, "kinds", len(discounts), 0.0) / _dense(column, "total", len(discounts), 1.0)
    return np.where(weights > 0, weights, 1.0)


def _weigh(discounts: np.ndarray):
    """Contexts of all orders: hash and log back-off weights, 0 in a language without the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            orders = b.column("level").to_numpy()
            for order in np.unique(orders).tolist():
                part = b.filter(pa.array(orders == order))
                keys = _window_hash(_matrix(part.column("context"), "<u4", order - 1)).view(np.int64)
                logs = np.log(_back_offs(part.column("context_of"), discounts[order]))
                yield pa.RecordBatch.from_pydict({"part": pa.array([ORDER + order - 1] * len(keys), pa.int32()), "key": pa.array(keys), "value": _binary(logs.astype("<f4"))})

    return run


def _interpolate(order: int, discounts: np.ndarray):
    """N-grams of an order: discounted share and back-off weight times the probability one order below, in every language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = _dense(b.column("context_of"), "total", len(discounts), 1.0)
            weights = _back_offs(b.column("context_of"), discounts)
            n = _dense(b.column("gram_of"), "n", len(discounts), 0.0)
            lower = _matrix(b.column("lower"), "<f4", len(discounts)) if order > 1 else np.full(n.shape, math.log(FLOOR))
            logs = np.log(np.maximum(n - discounts, 0) / total + weights * np.exp(lower.astype(float)))
            keys = _window_hash(_matrix(b.column("gram"), "<u4", order)).view(np.int64)
            yield pa.RecordBatch.from_pydict({"gram": b.column("gram"), "key": pa.array(keys), "value": _binary(logs.astype("<f4"))})

    return run


def _store(path: str):
    """Rows sorted by (part, key) into one file of a task: all hashes, then all values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, keys, values = [], [], []
        for b in batches:
            parts.append(b.column("part").to_numpy())
            keys.append(b.column("key").to_numpy())
            values += [b"".join(b.column("value").to_pylist())]
        if not sum(map(len, keys)):
            return
        part, key = np.concatenate(parts), np.concatenate(keys)
        file = f"{path}/{TaskContext.get().taskAttemptId()}.model"
        put_file(file, lambda out: [out.write(x) for x in (key.astype("<i8").tobytes(), *values)])
        lo = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1])
        yield pa.RecordBatch.from_pydict({"part": pa.array(part[lo], pa.int32()), "low": pa.array(key[lo], pa.int64()), "file": pa.array([file] * len(lo)), "n": pa.array([len(key)] * len(lo), pa.int64()), "lo": pa.array(lo, pa.int64()), "hi": pa.array(np.append(lo[1:], len(key)), pa.int64())})

    return run


def build(counts: DataFrame, langs: list[str]) -> DataFrame:
    """Rows (part, key, value) of a model, value holding a float for each of langs. counts: lang, gram (ORDER codes of four bytes), n; each pair of lang and gram once."""
    place = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1
    levels = {ORDER: counts.select(place.cast("int").alias("j"), "gram", "n")}
    for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct predecessors
        lower = levels[order + 1].groupBy("j", F.substring("gram", 5, 4 * order).alias("gram")).agg(F.count("*").alias("n"))
        levels[order] = materialize(lower, "langid-level")
    every = None
    for order, level in levels.items():
        rows = level.select(F.lit(order).alias("level"), "j", F.substring("gram", 1, 4 * (order - 1)).alias("context"), "n")
        every = rows if every is None else every.unionByName(rows)
    discounts = np.full((ORDER + 1, len(langs)), 0.5)
    for r in every.groupBy("level", "j").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect():
        if r.once:
            discounts[r.level, r.j] = min(0.95, r.once / (r.once + 2 * r.twice))
    contexts = every.groupBy("level", "context", "j").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    contexts = materialize(contexts.groupBy("level", "context").agg(F.collect_list(F.struct("j", "total", "kinds")).alias("context_of")), "langid-contexts")
    rows, below = contexts.mapInArrow(_weigh(discounts), "part int, key long, value binary"), None
    for order in range(1, ORDER + 1):
        grams = levels[order].groupBy("gram").agg(F.collect_list(F.struct("j", "n")).alias("gram_of")).withColumn("context", F.substring("gram", 1, 4 * (order - 1)))
        found = grams.join(contexts.where(F.col("level") == order).drop("level"), "context")
        if below is not None:
            found = found.withColumn("suffix", F.substring("gram", 5, 4 * (order - 1))).join(below.select(F.col("gram").alias("suffix"), F.col("value").alias("lower")), "suffix")
        found = found.select("gram", "gram_of", "context_of", *([] if below is None else ["lower"]))
        below = materialize(found.mapInArrow(_interpolate(order, discounts[order]), "gram binary, key long, value binary"), "langid-grams")
        rows = rows.unionByName(below.select(F.lit(order - 1).alias("part"), "key", "value"))
    return materialize(rows, "langid-rows")


def _files(rows: DataFrame, langs: list[str]) -> Model:
    """Rows (part, key, value) in files of the shared folder, a range of hashes each."""
    path = shared_path(rows.sparkSession, "langid-model")
    ranges = rows.repartitionByRange(max(1, rows.count() * len(langs) // FILE_VALUES), "part", "key").sortWithinPartitions("part", "key")
    made = ranges.mapInArrow(_store(path), "part int, low long, file string, n long, lo long, hi long").collect()
    parts: list[list[Range]] = [[] for _ in range(2 * ORDER)]
    for r in sorted(made, key=lambda r: r.low):
        parts[r.part].append(Range(r.low, r.file, r.n, r.lo, r.hi))
    return Model(langs, parts)


def cross_entropies(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For each text its number of codes (0 without a letter) and, per language, its cross-entropy in nats a code."""
    n_all, ce_all = [], []
    for part in _slices(texts):
        g = _grams(part)
        seen, logs = model.find(ORDER - 1, g.hashes)
        new = np.flatnonzero(~seen)
        if len(new):
            logs[new] = model.log_probability(g.windows[new])
        sums, some = np.zeros((len(part), len(model.langs))), np.flatnonzero(g.sizes)
        if len(some):
            sums[some] = np.add.reduceat(logs[g.which], (np.cumsum(g.sizes) - g.sizes)[some], axis=0, dtype=np.float64)
        n = np.where(g.sizes > g.spaces, g.sizes, 0)
        n_all.append(n)
        ce_all.append(-sums / np.maximum(n, 1)[:, None])
    return np.concatenate(n_all or [np.zeros(0, int)]), np.concatenate(ce_all or [np.zeros((0, len(model.langs)))])


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ce = cross_entropies(model, b.column("text").to_pylist())
            best = ce.argmin(1) if len(ce) else np.zeros(0, int)
            own = ce[np.arange(len(ce)), best]
            gap = np.exp(-SHARPNESS * np.minimum(ce - own[:, None], 50.0)).sum(1) if len(ce) else own
            lang = np.where(n > 0, np.array(model.langs, object)[best], "und")
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(lang, pa.string()), pa.array(np.where(n > 0, 1 / gap, 0.0)), pa.array(np.where(n > 0, own, 0.0)), pa.array((n == 0) | (own > model.limits(best, n)))],
                [*b.schema.names, "lang_pred", "score", "cross_entropy", "rejected"],
            )

    return run


def _labelled(train: DataFrame) -> DataFrame:
    return train.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def _counted(rows: DataFrame) -> tuple[DataFrame, set[str]]:
    """Counts (lang, gram, n) of rows (lang, text), and their langs."""
    counts = rows.select("lang", "text").mapInArrow(_count, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "langid-counts")
    return counts, {r.lang for r in counts.select("lang").distinct().collect()}


def fit(train: DataFrame) -> Model | None:
    """A model of nine tenths of the rows (doc_id, text, lang) with a text and a lang, its limit set by the last tenth; None if there are none."""
    rows = _labelled(train)
    aside = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION_PART)) == 0
    counts, langs = _counted(rows.where(~aside))
    if not langs:
        return None
    model = _files(build(counts, sorted(langs)), sorted(langs))
    _calibrate(model, model, rows.where(aside), {x: x for x in langs})
    return model


def fit_whole(train: DataFrame) -> Model | None:
    """A model of all rows (doc_id, text, lang) with a text and a lang, its limit set by all of them; None if there are none."""
    rows = _labelled(train)
    rows = rows.select("text", F.concat(F.pmod(F.xxhash64("doc_id"), F.lit(HALVES)).cast("string"), "lang").alias("lang"))  # the half is its first character
    halves, known = _counted(rows)
    langs = sorted({x[1:] for x in known})
    if not langs:
        return None
    whole = halves.groupBy(F.concat(F.lit("*"), F.substring("lang", 2, 1 << 30)).alias("lang"), "gram").agg(F.sum("n").alias("n"))
    columns = [h + x for h in ("*", *map(str, range(HALVES))) for x in langs]
    built = build(whole.unionByName(halves), columns)
    of = lambda lo, names: _files(built.select("part", "key", F.substring("value", 4 * lo + 1, 4 * len(names)).alias("value")), names)
    model = of(0, langs)
    other = {f"{h}{x}": f"{1 - h}{x}" for h in range(HALVES) for x in langs}
    _calibrate(model, of(len(langs), columns[len(langs) :]), rows, {x: y for x, y in other.items() if {x, y} <= known})
    return model


def _calibrate(model: Model, measure: Model, rows: DataFrame, columns: dict[str, str]) -> None:
    """Set the means of the languages and the spread around them from all rows (lang, text) that `measure` has a column for that does not count them.

    columns: of each lang of the rows; `measure` has the model's langs once, or once a half. A text's squared distance from its language's mean is fitted by a constant and a share of 1 / length. In units of that spread,
    the largest TAIL of all distances is taken as an exponential tail; the limit leaves REJECT_RATE of a language's own texts.
    """
    column = {x: measure.langs.index(y) for x, y in columns.items()}

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ce = cross_entropies(measure, b.column("text").to_pylist())
            k = np.array([column[x] for x in b.column("lang").to_pylist()], int)
            yield pa.RecordBatch.from_pydict({"j": pa.array((k % len(model.langs)).astype(np.int32)), "n": pa.array(n.astype(np.int64)), "ce": pa.array(ce[np.arange(len(k)), k])})

    found = materialize(rows.where(F.col("lang").isin(list(column))).select("lang", "text").mapInArrow(own, "j int, n long, ce double").where("n > 0"), "langid-measured")
    median = lambda c: F.percentile_approx(c, 0.5, ACCURACY)
    of = lambda values: F.array(*[F.lit(float(v)) for v in values])[F.col("j")]
    every = found.agg(F.count("*").alias("rows"), median("n").alias("n"), median("ce").alias("ce")).first()
    if not every.rows:
        return
    sizes = dict(found.groupBy("j").agg(median("n")).collect())
    long = found.where(F.col("n") >= of([sizes.get(j, 0) for j in range(len(model.langs))]))
    means = np.full(len(model.langs), every.ce)
    for j, ce in long.groupBy("j").agg(median("ce")).collect():
        means[j] = ce
    away, n = F.col("ce") - of(means), F.col("n")
    weight = 1 / (1 / n + 1 / F.lit(float(every.n)))  # short texts scatter more
    square = weight * weight
    s = found.agg(*[F.sum(x) for x in (square, square / n, square / n / n, square * away * away, square * away * away / n)]).first()
    (between, single), *_ = np.linalg.lstsq(np.array([[s[0], s[1]], [s[1], s[2]]]), np.array([s[3], s[4]]), rcond=None)
    blend = lambda x, k, rows: (rows * max(float(x), 0.0) + PRIOR_ROWS * PRIOR[k]) / (rows + PRIOR_ROWS)
    between, single = blend(between, 0, every.rows), blend(single, 1, every.rows)
    z = away / F.sqrt(F.lit(between) + F.lit(single) / n)
    largest = min(every.rows, max(2, math.ceil(TAIL * every.rows)))
    first = found.agg(F.percentile_approx(z, (every.rows - largest + 0.5) / every.rows, ACCURACY)).first()[0]
    tail = found.where(z >= first).agg(F.count("*").alias("rows"), F.avg(z - first).alias("excess")).first()
    beyond = blend(tail.excess, 2, tail.rows)
    model.means, model.spread = means, (math.sqrt(between), math.sqrt(single), max(float(first), 0.0) + beyond * math.log(max(TAIL, tail.rows / every.rows) / REJECT_RATE))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of docs with a `text` column, and lang_pred, score (0 to 1), cross_entropy, rejected.

    Null texts and texts without a letter are `und`, score 0, rejected. Without a model every row is. Columns of these
    names in docs are replaced. Repeated rows and nulls elsewhere pass through; equal cross-entropies go to the first
    language by name.
    """
    new = "lang_pred string, score double, cross_entropy double, rejected boolean"
    docs = docs.drop("lang_pred", "score", "cross_entropy", "rejected")
    if model is None:
        return docs.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cross_entropy"), F.lit(True).alias("rejected"))
    return docs.mapInArrow(_predict(model), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", " + new)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
