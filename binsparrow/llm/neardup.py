"""Near-duplicate join on word shingles: chosen-path set similarity join.

Every document becomes a set of shingle hashes and a signature of T minwise tokens. Documents with equal sets collapse to one
representative. A tree sends each representative of a node to FANOUT children, picked by the node from the T tokens: two
documents of similarity s miss each other in a tree with probability q = (1 - s (1 - q))^FANOUT, so the number of independent trees
follows from the target recall. Nodes of more than SMALL members branch again, unless most members are like a few
pivots of the node.

A small node is compared exhaustively in one task: signatures propose groups of members that may be linked, and each distinct group is
compared on the full sets, whose texts travel once for each group; of a group's links only those that join two
components are kept. A large node that does not branch is first compared with its pivots; members that this leaves outside the node's main
component then meet all members, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, materialize, mix, rolling
from .components import components

#: Minwise tokens of a signature; a byte of each travels with the nodes.
T = 128
FANOUT = 3
RECALL = 0.9999
#: Members up to which a node is compared without branching, and levels at most.
SMALL, DEPTH = 2048, 6
#: Standard deviations of the signature's estimate below the threshold at which a pair still may be linked.
SLACK = 4.2
#: Members of a large node that all others are compared with, about.
PIVOTS = 16
#: Rows on the sides of a block comparison.
BLOCK_LEFT, BLOCK_RIGHT = 256, 1024
#: Ids of documents, or of nodes, that may be broadcast (some 100 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Rows whose signatures are compared at once; whole units only.
CHUNK_ROWS = 16_384
NO_ID = (1 << 63) - 1
#: What a set is known by.
KEY = ["k1", "k2", "n"]

_RNG = np.random.default_rng(20240607)
_MUL = _RNG.integers(0, 1 << 32, T, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, T, dtype=np.uint32)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; the whole sequence as one if it has fewer words; else none."""
    for w in hashed_words(texts, lower=True):
        whole = rolling(w.hashes, k)
        for i in range(w.lo, w.hi):
            s = w.of(i)
            n = s.stop - s.start
            if n >= k:
                yield np.unique(whole[s.start : s.stop - k + 1])
            elif n:
                yield mix(rolling(w.hashes[s], n) + np.uint64(n))
            else:
                yield np.zeros(0, np.uint64)


def _signature(values: np.ndarray) -> np.ndarray:
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(T, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(out, (x[at : at + 4096, None] * _MUL + _ADD).min(0), out)
    return out.astype(np.uint16)


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column("text"), k)
            ids = b.column("id").to_pylist()
            for at in range(0, len(ids), 2000):
                n, k1, k2, sigs = [], [], [], []
                for _ in ids[at : at + 2000]:
                    s = next(sets)
                    x, y = _sums(s)
                    n.append(len(s))
                    k1.append(x)
                    k2.append(y)
                    sigs.append(_signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids[at : at + 2000], pa.int64()), "n": pa.array(n, pa.int64()), "k1": pa.array(k1, pa.int64()), "k2": pa.array(k2, pa.int64()), "sig": pa.array(sigs, pa.binary())})

    return run


def _sums(s: np.ndarray) -> tuple[int | None, int | None]:
    """Two sums over a set's hashes, which with its size tell sets apart."""
    if not len(s):
        return None, None
    return int(s.sum(dtype=np.uint64).view(np.int64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))


def _keyed(k: int):
    """All columns and the key of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, k1, k2 = [], [], []
            for s in shingle_sets(b.column("text"), k):
                x, y = _sums(s)
                n.append(len(s))
                k1.append(x)
                k2.append(y)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int64())], [*b.schema.names, *KEY])

    return run


def _with_key(docs: DataFrame, k: int) -> DataFrame:
    return docs.mapInArrow(_keyed(k), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", k1 long, k2 long, n long")


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


NODES = "node long, id long, n long, brief binary"


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Children of each (node, id): FANOUT of the signature's tokens, those the node ranks first."""
    for whole in batches:
        for at in range(0, whole.num_rows, 4000):
            b = whole.slice(at, 4000)
            sig = _matrix(b.column("sig"), "<u2")
            node = b.column("node").to_numpy().view(np.uint64)
            order = mix(node[:, None] + np.arange(1, T + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
            pick = np.argpartition(order, FANOUT, axis=1)[:, :FANOUT]
            token = np.take_along_axis(sig, pick, 1).astype(np.uint64) | pick.astype(np.uint64) << np.uint64(16)
            child = mix(mix(node)[:, None] ^ mix(token + np.uint64(1)))
            brief = pa.array([r.tobytes() for r in (sig & 0xFF).astype(np.uint8)], pa.binary())
            rows = pa.array(np.repeat(np.arange(len(node)), FANOUT))
            yield pa.RecordBatch.from_arrays([pa.array(child.ravel().view(np.int64)), *(c.take(rows) for c in (b.column("id"), b.column("n"), brief))], ["node", "id", "n", "brief"])


def _units(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], rows: int) -> Iterator[pa.Table]:
    """Rows sorted by unit, again in stretches of about so many rows that hold whole units."""
    held, size = [], 0
    for b in batches:
        held.append(b.select(columns))
        size += b.num_rows
        if size >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            unit = table.column("unit").to_numpy()
            cut = int(np.searchsorted(unit, unit[-1]))
            if cut:
                yield table.slice(0, cut)
            held, size = table.slice(cut).to_batches(), len(unit) - cut
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


UNITS = "node long, unit long, side int, id long, comp long"


def _propose(floor: int, percent: int):
    """Groups of each unit's members that may be linked, by signature and set size.

    Members of side 0 are compared with those of side 1, or with each other if there are none. Pairs of one component do not count.
    """

    def process(t: pa.Table) -> pa.RecordBatch:
        node, unit, side, ids, comp, n = (t.column(c).to_numpy() for c in ("node", "unit", "side", "id", "comp", "n"))
        brief = _matrix(t.column("brief"), "u1")
        first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        sizes = np.diff(np.append(first, len(unit)))
        lefts = np.add.reduceat(side == 0, first)
        label = np.arange(len(unit))

        def alike(i, j):
            ok = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            ok[ok] = np.count_nonzero(brief[j[ok]] == (brief[i[ok]] if isinstance(i, np.ndarray) else brief[i]), axis=1) >= floor
            return j[ok]

        def join(i: int, hits: np.ndarray, lo: int, hi: int) -> None:
            other = np.unique(label[hits])
            if len(other) > 1 or len(other) and other[0] != label[i]:
                here = label[lo:hi]
                here[np.isin(here, other)] = label[i]

        few = sizes <= 9  # all pairs of all few-membered units at once
        which = np.repeat(np.arange(len(first)), sizes)
        for k in range(1, 9):
            i = np.flatnonzero((unit[k:] == unit[:-k]) & few[which[:-k]] & ((side[k:] != side[:-k]) | (lefts == sizes)[which[:-k]]))
            for j in alike(i, i + k).tolist():
                join(j - k, np.array([j]), first[which[j]], first[which[j]] + sizes[which[j]])
        for u in np.flatnonzero(~few).tolist():
            lo, mid, hi = first[u], first[u] + lefts[u], first[u] + sizes[u]
            for i in range(lo, mid):
                others = np.arange(mid if mid < hi else i + 1, hi)
                join(i, alike(np.int64(i), others), lo, hi)
        order = np.argsort(label, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(label[order]) != 0, [True]])) if len(order) else np.zeros(1, int)
        key, chosen = [], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi - lo > 1:
                members = order[lo:hi]
                members = members[np.lexsort((ids[members], side[members]))]
                key += [xxhash.xxh3_64_intdigest(np.stack([ids[members], side[members]]).tobytes()) - (1 << 63)] * len(members)
                chosen.append(members)
        chosen = np.concatenate(chosen) if chosen else np.zeros(0, int)
        return pa.RecordBatch.from_arrays([pa.array(node[chosen]), pa.array(key, pa.int64()), *(pa.array(x[chosen]) for x in (side, ids, comp))], ["node", "unit", "side", "id", "comp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _units(batches, ("node", "unit", "side", "id", "comp", "n", "brief"), CHUNK_ROWS):
            yield process(t)

    return run


def _proposed(units: DataFrame, floor: int, percent: int) -> DataFrame:
    return units.repartition("unit").sortWithinPartitions("unit", "side").mapInArrow(_propose(floor, percent), UNITS)


def _forest(sets: list[np.ndarray], lefts: int, comp: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links on full sets that join components: of the first `lefts` with the others, or of all if there are no others."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    codes, start = np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(n) - n
    mark, label, links = np.zeros(codes.max() + 1, bool), comp.copy(), []
    for i in range(lefts if lefts < len(sets) else len(sets) - 1):
        lo = lefts if lefts < len(sets) else i + 1
        if not ((label[lo:] != label[i]) & (100 * np.minimum(n[lo:], n[i]) >= percent * np.maximum(n[lo:], n[i]))).any():
            continue
        mine = codes[start[i] : start[i] + n[i]]
        mark[mine] = True
        both = np.add.reduceat(mark[codes[start[lo] :]], start[lo:] - start[lo], dtype=np.int64)
        mark[mine] = False
        for j in (np.flatnonzero(100 * both >= percent * (n[lo:] + n[i] - both)) + lo).tolist():
            if label[j] != label[i]:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, sets, ids, comps, lefts = None, [], [], [], 0

        def close() -> pa.RecordBatch:
            links = _forest(sets, lefts, np.array(comps), percent) if len(sets) > 1 else []
            pairs = [sorted((ids[i], ids[j])) for i, j in links]
            return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("unit", "side", "id", "comp")), shingle_sets(b.column("text"), k), strict=True)
            for u, side, i, comp, s in rows:
                if u != unit:
                    if len(sets) > 1:
                        yield close()
                    unit, sets, ids, comps, lefts = u, [], [], [], 0
                sets.append(s)
                ids.append(i)
                comps.append(comp)
                lefts += side == 0
        yield close()

    return run


def _confirmed(groups: DataFrame, texts: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) within groups that hold on the full shingle sets. Only texts in some group are moved.

    Texts are found by doc_id and then by their sets, as texts of one doc_id may differ.
    """
    groups = materialize(groups.select("unit", "side", "id", "comp").dropDuplicates(["unit", "side", "id"]), "neardup-groups")
    wanted = materialize(reps.join(groups.select("id").distinct(), "id", "left_semi").select("doc", *KEY, "id"), "neardup-wanted")
    few = F.broadcast if wanted.count() <= BROADCAST_IDS else lambda df: df
    named = _with_key(texts.join(few(wanted.select("doc").distinct()), "doc", "left_semi"), k)
    texts = named.join(few(wanted), ["doc", *KEY]).groupBy("id").agg(F.first("text").alias("text"))
    rows = groups.join(texts, "id").repartition("unit").sortWithinPartitions("unit", "side")
    return materialize(rows.mapInArrow(_confirm(k, percent), "a long, b long"), "neardup-links")


def _trees(percent: int) -> int:
    """Independent trees that together find a pair at the threshold with probability RECALL, however deep they branch."""
    missed = 0.0
    for _ in range(DEPTH):
        missed = (1 - percent / 100 * (1 - missed)) ** FANOUT
    return max(1, math.ceil(math.log(1 - RECALL) / math.log(max(1e-12, missed))))


def _stars(held: DataFrame) -> DataFrame:
    """Units of large nodes: the node's pivots on one side, a block of its members on the other."""
    draw = F.shiftrightunsigned(F.xxhash64("node", "id", F.lit("pivot")), 11).cast("double") / float(1 << 53)
    blocks = F.ceil(F.col("m") / BLOCK_RIGHT)
    members = held.withColumn("block", F.pmod(F.xxhash64("id"), blocks)).withColumn("side", F.lit(1))
    pivots = held.where(draw < PIVOTS / F.col("m")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).withColumn("side", F.lit(0))
    return pivots.unionByName(members).select("node", F.xxhash64("node", "block").alias("unit"), "side", "id", F.col("id").alias("comp"), "n", "brief")


def _across(members: DataFrame) -> DataFrame:
    """Units of large nodes: blocks of members outside the node's main component on one side, blocks of all on the other."""
    each = members.groupBy("node", "comp").agg(F.count("*").alias("m"))
    main = each.groupBy("node").agg(F.sum("m").alias("m"), F.max(F.struct("m", "comp")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    main = main.select("node", F.col("top.comp").alias("main"), F.ceil((F.col("m") - F.col("top.m")) / BLOCK_LEFT).alias("lefts"), F.ceil(F.col("m") / BLOCK_RIGHT).alias("rights"))
    rows, here, zero = members.join(main, "node"), F.xxhash64("id"), F.lit(0).cast("long")
    left = rows.where("comp <> main").withColumn("l", F.pmod(here, F.col("lefts"))).withColumn("r", F.explode(F.sequence(zero, F.col("rights") - 1)))
    right = rows.withColumn("r", F.pmod(here, F.col("rights"))).withColumn("l", F.explode(F.sequence(zero, F.col("lefts") - 1)))
    rows = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    return rows.select("node", F.xxhash64("node", "l", "r").alias("unit"), "side", "id", "comp", "n", "brief")


def _linked(reps: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) of representatives (id, n, sig and what their texts are known by) that have a link."""
    floor = max(1, math.floor(T * (percent / 100 - SLACK * math.sqrt(percent / 100 * (1 - percent / 100) / T))))
    rows = reps.select("id", "n", "sig", F.explode(F.array(*[F.lit(7919 * (i + 1)).cast("long") for i in range(_trees(percent))])).alias("node"))
    groups, dense = [], []
    for depth in range(1, DEPTH + 1):
        level = rows.mapInArrow(_branch, NODES)
        large = materialize(level.groupBy("node").agg(F.count("*").alias("m")).where(F.col("m") > SMALL), "neardup-large")
        some = large.count()
        few = F.broadcast if some <= BROADCAST_IDS else lambda df: df
        small = level.join(few(large), "node", "left_anti") if some else level
        small = small.select("node", F.col("node").alias("unit"), F.lit(0).alias("side"), "id", F.col("id").alias("comp"), "n", "brief")
        groups.append(_proposed(small, floor, percent))
        if not some:
            break
        held = materialize(level.join(few(large), "node"), "neardup-held")
        near = materialize(_proposed(_stars(held), floor, percent), "neardup-near")
        groups.append(near)
        alike = near.where("side = 1").groupBy("node").agg(F.countDistinct("id").alias("alike")).join(large, "node")
        stop = large.select("node") if depth == DEPTH else alike.where("2 * alike >= m").select("node")
        stop = materialize(stop, "neardup-dense")
        dense.append(held.join(few(stop), "node", "left_semi"))
        rows = materialize(held.join(few(stop), "node", "left_anti").select("node", "id", "n").join(reps.select("id", "sig"), "id"), "neardup-rows")
    every = groups[0]
    for g in groups[1:]:
        every = every.unionByName(g)
    links = _confirmed(every, texts, reps, k, percent)
    whole = components(links)
    if not dense:
        return whole
    members = dense[0]
    for d in dense[1:]:
        members = members.unionByName(d)
    members = members.drop("m").join(whole.withColumnRenamed("node", "id"), "id", "left").select("node", "id", "n", "brief", F.coalesce("component", "id").alias("comp"))
    members = materialize(members, "neardup-members")
    return components(links.unionByName(_confirmed(_proposed(_across(members), floor, percent), texts, reps, k, percent)))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Words are cut at ASCII white space, A-Z lower-cased. Two documents are linked when 100 * |A & B| >= percent * |A | B| on
    their sets of distinct k-word shingles (all words as one, if fewer). Null or wordless texts have no set and are linked with nothing.
    component_id is the least doc_id reachable. A null doc_id counts as larger than all others; rows that repeat
    a doc_id are one document each with that name, and one row of a component is kept. Other columns are ignored; an empty table gives no rows.
    """
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return _decided(docs, k, percent).select(known("doc").alias("doc_id"), F.col("n").alias("n_shingles"), known("component").alias("component_id"), "kept")


def without_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near_duplicates keeps. Rows that share a doc_id are told apart by their sets."""
    rows = materialize(_decided(docs, k, percent).select("doc", *KEY, "kept").where("NOT kept OR n > 0"), "neardup-decided")
    names = rows.groupBy("doc").agg(F.count_if(~F.col("kept")).alias("gone"), F.count_if("kept").alias("stay")).where("gone > 0")
    names = materialize(names, "neardup-names")
    few = lambda df: F.broadcast(df) if names.count() <= BROADCAST_IDS else df
    gone = few(names.select("doc"))
    held = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"))
    out = held.join(gone, "doc", "left_anti")
    # rows of a name that has dropped rows: those without a set stay, and of each kept set one row
    some = _with_key(held.join(gone, "doc", "left_semi"), k)
    stay = rows.where("kept").join(names.select("doc"), "doc", "left_semi").select("doc", *KEY)
    first = some.where("n > 0").join(stay, ["doc", *KEY], "left_semi").groupBy("doc", *KEY).agg(F.min_by("row", "text").alias("row"))
    return out.select("row").unionByName(some.where("n = 0").select("row")).unionByName(first.select("row")).select("row.*")


def _decided(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc (NO_ID for null), k1, k2, n, component (its least doc) and kept for every row."""
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.col("text").cast("string").alias("text"))
    sketch = materialize(base.withColumnRenamed("doc", "id").mapInArrow(_sketch(k), "id long, n long, k1 long, k2 long, sig binary"), "neardup-sketch")
    sketch = sketch.withColumnRenamed("id", "doc")
    full = sketch.where("n > 0")
    reps = full.groupBy(*KEY).agg(F.min("doc").alias("doc"), F.first("sig").alias("sig"))
    # an id of its own for every set, whatever doc_ids repeat
    reps = materialize(reps.withColumn("id", F.monotonically_increasing_id()), "neardup-reps")
    whole = _linked(reps, base, k, percent)
    named = reps.select(*KEY, "doc", "id").join(whole.withColumnRenamed("node", "id"), "id", "left").select(*KEY, "doc", F.coalesce("component", "id").alias("set"))
    least = named.groupBy("set").agg(F.min(F.struct("doc", *KEY)).alias("least"))
    named = named.drop("doc").join(least, "set").select(*KEY, F.col("least.doc").alias("component"), (F.struct(*KEY) == F.struct(*[F.col(f"least.{c}") for c in KEY])).alias("main"))
    # rows equal in doc and set are counted and dealt out again, the first as the one that may stay
    out = full.groupBy("doc", *KEY).agg(F.count("*").alias("copies")).join(named, KEY)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    out = out.select("doc", *KEY, "component", (F.col("main") & (F.col("doc") == F.col("component")) & (F.col("copy") == 1)).alias("kept"))
    return out.unionByName(sketch.where("n = 0").select("doc", *KEY, F.col("doc").alias("component"), F.lit(True).alias("kept")))
