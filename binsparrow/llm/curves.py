"""Approximate nearest neighbours by shifted space-filling curves.

The largest inner product becomes the least distance by one component more: rows get sqrt(M^2 - |v|^2) with M the greatest length, so that all are of length M; queries are
brought to length M and get 0. Each curve projects these, less their mean, to DIMS directions, drawn the more often the more the rows spread along them; cuts each axis into cells
of equal counts; shifts them; and orders by Hilbert key. The order is cut into BLOCKS ranges of equal count; a query meets the rows of the range of its own key and REACH ranges
to either side, is scored there on the original vectors, and keeps its best. The bests of all curves are merged, scored again in one fixed order of
summation, and ranked. Mean, directions and cells are fitted on FIT rows of least hash; every row is indexed.

The windows are shares of the table, not constants: for vectors without any structure, as good as uniform on the sphere,
a fixed number of key neighbours finds nothing, and only a share of the table per curve keeps the recall. Many curves of narrow windows
find more than few of wide ones: all windows of a query together are CURVES * (2 * REACH + 1) / BLOCKS of the table, 1.09, and the rows they hold, each counted once, are
less, the more structure the vectors have (0.65 without any, 0.43 to 0.54 with an offset, uneven lengths or positive components, in 4000 rows).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CURVES, DIMS, BITS = 20, 6, 7
BLOCKS, REACH = 128, 3
#: Rows that the index is fitted on; cells of an axis; how much more often directions of wide spread are drawn.
FIT, CELLS, PULL = 20_000, 256, 0.75
#: Best rows of a tile beyond k that are scored again.
SPARE = 4
#: Sides of one comparison: rows and queries.
TILE_ROWS, TILE_QUERIES = 8192, 4096
#: Ways in which equal vectors are split before their least ids are found.
SALTS = 64


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer cells (rows) with `bits` bits an axis, by Skilling's transform."""
    x = [c.astype(np.int64) for c in cells.T]
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        q, low = 1 << bit, (1 << bit) - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0]) ^ swap
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] & (1 << bit), (1 << bit) - 1, 0)
    key = np.zeros(len(cells), np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ turn) >> bit & 1)
    return key


def _vectors(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1).astype(float) if len(column) else np.zeros((0, 1))


class Fit:
    """Mean, directions, cells and shifts of the curves, from some rows and the greatest length of all."""

    def __init__(self, some: np.ndarray, longest: float, seed: int, curves: int):
        rng = np.random.default_rng(seed)
        self.longest = longest
        x = self.rows(some)
        self.mean = x.mean(0)
        spread, axes = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
        dims = min(DIMS, x.shape[1])
        pull = axes * np.maximum(spread, spread.max() * 1e-9 + 1e-300) ** PULL
        self.frames = [np.linalg.qr(pull @ rng.standard_normal((x.shape[1], dims)))[0] for _ in range(curves)]
        steps = np.linspace(0, 1, CELLS + 1)
        self.cells = [np.quantile((x - self.mean) @ f, steps, axis=0) for f in self.frames]
        self.shifts = rng.uniform(0, 1, (curves, dims))

    def rows(self, x: np.ndarray) -> np.ndarray:
        """On the sphere of the greatest length, by one component more."""
        return np.concatenate([x, np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))[:, None]], 1)

    def queries(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x * (self.longest / np.linalg.norm(x, axis=1))[:, None], np.zeros((len(x), 1))], 1)

    def keys(self, x: np.ndarray) -> list[np.ndarray]:
        """Of each curve the Hilbert positions of rows or queries."""
        top, steps, out = (1 << BITS) - 1, np.linspace(0, 1, CELLS + 1), []
        for frame, cells, shift in zip(self.frames, self.cells, self.shifts, strict=True):
            p = (x - self.mean) @ frame
            unit = (np.stack([np.interp(p[:, i], cells[:, i], steps) for i in range(p.shape[1])], 1) + shift) / 2
            out.append(hilbert_keys(np.clip(unit * (top + 1), 0, top).astype(np.int64), BITS))
        return out


def _keys(fit: Fit, queries: bool):
    """Adds each curve's key: the Hilbert position above a hash that splits equal positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b.column("vec"))
            if len(x):
                tie = b.column("tie").to_numpy()
                keys = [k << 16 | tie for k in fit.keys(fit.queries(x) if queries else fit.rows(x))]
                yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("vec"), pa.array(list(np.stack(keys, 1)), pa.list_(pa.int64()))], ["rep", "vec", "keys"])

    return run


def _tiles(k: int):
    """Rows sorted by (tile, side): a tile's queries come first, then its rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, queries, names, best = None, [], [], None

        def close() -> Iterator[pa.RecordBatch]:
            if best is not None:
                q = np.repeat(np.concatenate(names), best[0].shape[1])
                ok = best[1].ravel() > -np.inf
                yield pa.RecordBatch.from_pydict({"query": pa.array(q[ok]), "rep": pa.array(best[0].ravel()[ok]), "score": pa.array(best[1].ravel()[ok])})

        for b in batches:
            if not b.num_rows:
                continue
            tiles, sides, reps = (b.column(c).to_numpy() for c in ("tile", "side", "rep"))
            x = _vectors(b.column("vec"))
            cuts = np.flatnonzero(np.diff(tiles) | np.diff(sides)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(tiles)], strict=True):
                if tiles[lo] != tile:
                    yield from close()
                    tile, queries, names, best = tiles[lo], [], [], None
                if sides[lo] == 0:
                    queries.append(x[lo:hi])
                    names.append(reps[lo:hi])
                elif queries:
                    q = np.concatenate(queries)
                    queries, names = [q], [np.concatenate(names)]
                    for at in range(lo, hi, 2048):
                        end = min(at + 2048, hi)
                        score = q @ x[at:end].T
                        ids = np.broadcast_to(reps[at:end], score.shape)
                        if best is not None:
                            ids, score = np.concatenate([best[0], ids], 1), np.concatenate([best[1], score], 1)
                        if score.shape[1] > k:
                            keep = np.argpartition(-score, k - 1, 1)[:, :k]
                            ids, score = np.take_along_axis(ids, keep, 1), np.take_along_axis(score, keep, 1)
                        best = (ids, score)
        yield from close()

    return run


def _least_ids(rows: DataFrame, k: int) -> DataFrame:
    """The k least ids of each distinct vector, found in salted parts first; `rep` is the least."""
    part = Window.partitionBy("vec", F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy("id")
    few = rows.withColumn("r", F.row_number().over(part)).where(F.col("r") <= k)
    whole = Window.partitionBy("vec")
    return few.withColumn("r", F.row_number().over(whole.orderBy("id"))).where(F.col("r") <= k).withColumn("rep", F.min("id").over(whole)).select("id", "vec", "rep")


def nearest(table: DataFrame, k: int = 20, every: int = 20, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product found for every row whose vec_id `every` divides.

    `table` has vec_id and embedding; other columns are ignored. Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do null ids; shorter vectors count as if zeros followed. A row is no candidate of its own query;
    equal vectors are searched once and expanded by id. Ties go to the smaller vec_id; of rows that repeat a
    vec_id and a vector one counts. An empty table gives no rows.
    """
    vec = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("id"), vec.alias("vec"))
    finite = ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("vec", lambda v: v != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where(finite).distinct()
    shape = rows.agg(F.max(F.size("vec")).alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)).alias("square")).first()
    if shape["n"] is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0.0), shape["n"] - F.size("vec")))).distinct()
    some = materialize(_least_ids(rows, k + 1), "curves-ids")
    total = some.where("id = rep").count()
    blocks = max(1, min(BLOCKS, total // k))
    curves = min(CURVES, blocks // (2 * REACH + 1) + 6) if blocks > REACH + 1 else 1  # all windows together: a table and, below BLOCKS, 42 / blocks more
    tie = F.pmod(F.xxhash64("rep"), F.lit(1 << 16))
    distinct = some.where("id = rep").select("rep", "vec", tie.alias("tie"))
    some_rows = distinct.orderBy(F.xxhash64("rep", F.lit(seed)), "rep").select("vec").limit(FIT).toArrow()
    fit = Fit(_vectors(some_rows.column("vec")), shape["square"] ** 0.5, seed, curves)
    named = "rep long, vec array<double>, keys array<long>"
    keyed = materialize(distinct.mapInArrow(_keys(fit, False), named), "curves-keys")
    # a query for each distinct vector that some query has
    asked = rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "vec").join(distinct.select("rep", "vec"), "vec").select("query_id", F.col("rep").alias("query"))
    queries = materialize(distinct.join(asked.select(F.col("query").alias("rep")).distinct(), "rep").mapInArrow(_keys(fit, True), named), "curves-queries")
    bounds = keyed.select(*[F.col("keys")[c].alias(f"c{c}") for c in range(curves)]).approxQuantile([f"c{c}" for c in range(curves)], [i / blocks for i in range(1, blocks)], 0.1 / blocks) if blocks > 1 else [[]] * curves
    limits = F.array(*[F.array(*[F.lit(int(x)) for x in b]).cast("array<long>") for b in bounds])
    placed = lambda df: df.select("rep", "vec", F.posexplode("keys").alias("curve", "key")).withColumn("block", F.size(F.filter(limits[F.col("curve")], lambda b: b <= F.col("key"))))
    row_parts, query_parts = -(-total // (blocks * TILE_ROWS)), -(-queries.count() * (2 * REACH + 1) // (blocks * TILE_QUERIES))
    part = lambda n: F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(n))
    right = placed(keyed).withColumn("r", part(row_parts)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1)))).withColumn("side", F.lit(1))
    near = placed(queries).withColumn("block", F.explode(F.sequence(F.greatest(F.lit(0), F.col("block") - REACH), F.least(F.lit(blocks - 1), F.col("block") + REACH))))
    left = near.withColumn("q", part(query_parts)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(row_parts - 1)))).withColumn("side", F.lit(0))
    given = table.schema["embedding"].dataType.elementType.simpleString()
    form = F.col("vec").cast("array<float>" if given == "float" else "array<double>")  # floats lose nothing as floats
    tile = lambda df: df.select(F.xxhash64(*[F.col(c).cast("long") for c in ("curve", "block", "r", "q")]).alias("tile"), "side", "rep", form.alias("vec"))
    met = tile(left).unionByName(tile(right)).repartition("tile").sortWithinPartitions("tile", "side").mapInArrow(_tiles(k + 1 + SPARE), "query long, rep long, score double")
    best = met.groupBy("query", "rep").agg(F.max("score").alias("score"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))).where(F.col("r") <= k + 1 + SPARE)
    pair = best.select("query", "rep").join(queries.select(F.col("rep").alias("query"), F.col("vec").alias("a")), "query").join(distinct.select("rep", F.col("vec").alias("b")), "rep")
    exact = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda a, v: a + v)
    out = asked.join(pair.select("query", "rep", exact.alias("score")), "query").join(some.select("id", "rep"), "rep").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
