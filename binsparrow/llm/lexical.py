"""Ranked lexical search with dual-sorted wavelet trees.

Documents are cut into shards. A shard holds, for every term, its postings by falling impact (the part of the score that term frequency and length make; ties
by doc_id), all lists in one sequence of documents, and over that sequence a wavelet tree: at each level one bit of the document's place in doc_id order,
the sequence then parted stably by the bit (the matrix layout). So the lists are sorted both ways at once: from the root a list reads by impact, and down the
tree it is cut into ranges of doc_ids, in each of which the first posting still has the greatest impact.

A query is a set of intervals, one a term. The bound of a tree node is the sum of the term weights times the impacts of the first postings of the intervals
inside it; at a leaf it is the document's score. Nodes are opened best first, the best few of every query at a time and more from wave to wave; what is below the
running k-th score of the query is never opened. Results are exact. A task carries its k-th scores from shard to shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Text bytes and documents of a shard; a longer text is a shard of its own.
SHARD_BYTES, SHARD_DOCS = 4 << 20, 1 << 13
#: Terms of queries that are searched in one pass over the index.
BLOCK_TERMS = 500_000
#: Nodes of a query that are opened in one of the first waves, before a tree's depth is reached; later this many times more from wave to wave.
OPENED = 4
#: The scale of impacts and weights, and the share of the length in the norm.
IMPACT_SCALE, TF_SCALE, NORM_SCALE, LENGTH_SHARE, WEIGHT_SCALE = 1_000_000_000, 1000, 8, 75, 1000

_TERM = np.zeros(256, np.uint8)
_TERM[48:58], _TERM[97:123], _TERM[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
_TERM[65:91] = np.arange(97, 123)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of a column in order (null: none), and how many each text has: runs of letters, digits and characters beyond ASCII, A-Z lower-cased."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = _TERM[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    cuts = offsets - offsets[0]
    solid = data != 0
    head = solid.copy()
    head[1:] &= ~solid[:-1]
    inner = cuts[:-1][cuts[:-1] < len(data)]
    head[inner] = solid[inner]
    starts = np.flatnonzero(head)
    letters = data[solid]
    place = np.append(np.cumsum(solid)[starts] - 1, len(letters)).astype(np.int64)
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(place), pa.py_buffer(letters))
    return terms, np.diff(np.searchsorted(starts, cuts))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for b in batches:
        for part in _parts(b):
            n = terms_of(part.column("text"))[1]
            docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
    yield pa.RecordBatch.from_pydict({"docs": pa.array([docs]), "terms": pa.array([terms])})


def _parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about SHARD_BYTES of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy().astype(np.int64))
    at = 0
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SHARD_BYTES, "right")))
        end = min(end, at + SHARD_DOCS)
        yield b.slice(at, end - at)
        at = end


def impact(tf, n, docs: int, terms: int):
    """The part of a score that a document's length n and a term's count tf in it make."""
    norm = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * docs) // terms
    return (IMPACT_SCALE * tf) // (TF_SCALE * tf + NORM_SCALE * norm)


def shard_of(part: pa.RecordBatch, docs: int, terms: int) -> dict | None:
    """The index of a part (doc_id, text) of the documents, None if it has no terms."""
    found, n = terms_of(part.column("text"))
    if not len(found):
        return None
    ids = part.column("doc_id")
    order = pc.sort_indices(ids, null_placement="at_end").to_numpy()  # documents by doc_id
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    count = len(order)
    words = found.dictionary_encode()
    doc = np.repeat(place, n)
    key, tf = np.unique(words.indices.to_numpy().astype(np.int64) * count + doc, return_counts=True)
    term, doc = key // count, key % count
    strength = impact(tf.astype(np.int64), n.astype(np.int64)[order][doc], docs, terms)
    sort = np.argsort(term << 31 | (1 << 31) - 1 - strength, kind="stable")  # within a list by impact, then doc_id
    levels, at, bits = max(1, int(count - 1).bit_length()), doc[sort].astype(np.int32), []
    for level in range(levels):
        bit = at >> (levels - 1 - level) & 1 == 1
        bits.append(np.packbits(bit))
        at = np.concatenate([at[~bit], at[bit]])
    return {
        "n_postings": len(sort),
        "levels": levels,
        "docs": ids.take(pa.array(order)),
        "terms": words.dictionary,
        "dfs": np.bincount(term, minlength=len(words.dictionary)),
        "impacts": strength[sort].astype("<i4").tobytes(),
        "bits": b"".join(b.tobytes() for b in bits),
    }


INDEX = "n_postings long, levels int, docs array<long>, terms array<string>, dfs array<long>, impacts binary, bits binary"


def _indexed(docs: int, terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, rows = [], 0, 0

        def close() -> Iterator[pa.RecordBatch]:
            made = shard_of(pa.Table.from_batches(held).combine_chunks().to_batches()[0], docs, terms) if rows else None
            if made:
                kinds = {"n_postings": pa.int64(), "levels": pa.int32(), "docs": pa.list_(pa.int64()), "terms": pa.list_(pa.string()), "dfs": pa.list_(pa.int64()), "impacts": pa.binary(), "bits": pa.binary()}
                lists = {c: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, pa.int64()) if c != "terms" else v.cast(pa.string())) for c, v in made.items() if c in ("docs", "terms", "dfs")}
                yield pa.RecordBatch.from_arrays([lists[c] if c in lists else pa.array([made[c]], kinds[c]) for c in kinds], list(kinds))

        for b in batches:
            for part in _parts(b):
                more = part.column("text").nbytes
                if rows and (size + more > SHARD_BYTES or rows + part.num_rows > SHARD_DOCS):
                    yield from close()
                    held, size, rows = [], 0, 0
                held, size, rows = [*held, part], size + more, rows + part.num_rows
        yield from close()

    return run


def build_index(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """(index, N, L) of docs(doc_id, text): a row for each shard, written to the shared folder; N documents have a term, L is all their terms.

    Two narrow passes over the texts; no shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sums = rows.select("text").mapInArrow(_counted, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    n, total = sums[0] or 0, sums[1] or 0
    return materialize(rows.mapInArrow(_indexed(n, total), INDEX), "lexical-index"), n, total


class Shard:
    """A shard in memory: ranks of every level's bits, and the impacts as each level has them."""

    def __init__(self, n: int, levels: int, impacts: bytes, bits: bytes):
        self.n, self.levels = n, levels
        wide = -(-n // 8)
        self.ranks, self.zeros = np.zeros((levels, n + 1), np.int32), np.zeros(levels, np.int64)
        self.impacts = np.empty((levels + 1, n), np.int32)
        self.impacts[0] = np.frombuffer(impacts, "<i4")
        for level in range(levels):
            bit = np.unpackbits(np.frombuffer(bits, np.uint8, wide, level * wide), count=n)
            np.cumsum(bit, out=self.ranks[level, 1:])
            ones = bit == 1
            self.zeros[level] = zeros = n - int(self.ranks[level, n])
            self.impacts[level + 1, :zeros], self.impacts[level + 1, zeros:] = self.impacts[level][~ones], self.impacts[level][ones]


class Nodes:
    """Tree nodes of queries: query, level, the documents' common leading bits, bound; and the non-empty intervals of each, one a term, in a row."""

    def __init__(self, query, level, prefix, bound, size, lo, hi, weight):
        self.query, self.level, self.prefix, self.bound, self.size, self.lo, self.hi, self.weight = query, level, prefix, bound, size, lo, hi, weight

    def take(self, which: np.ndarray) -> Nodes:
        first, size = np.cumsum(self.size) - self.size, self.size[which]
        inner = np.repeat(first[which] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return Nodes(self.query[which], self.level[which], self.prefix[which], self.bound[which], size, self.lo[inner], self.hi[inner], self.weight[inner])

    @staticmethod
    def joined(a: Nodes, b: Nodes) -> Nodes:
        return Nodes(*(np.concatenate([getattr(a, c), getattr(b, c)]) for c in ("query", "level", "prefix", "bound", "size", "lo", "hi", "weight")))


def _grouped(shard: Shard, owner: np.ndarray, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray, query: np.ndarray, level: np.ndarray, prefix: np.ndarray) -> Nodes:
    """Nodes of intervals, each with the number of its node: query, level and prefix are by that number."""
    order = np.argsort(owner, kind="stable")
    owner, lo, hi, weight = owner[order], lo[order], hi[order], weight[order]
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[: len(owner)])
    who = owner[first]
    best = weight * shard.impacts[level[owner], lo]
    bound = np.add.reduceat(best, first) if len(first) else np.zeros(0, np.int64)
    return Nodes(query[who], level[who], prefix[who], bound, np.diff(np.append(first, len(owner))), lo, hi, weight)


def _opened(shard: Shard, nodes: Nodes) -> Nodes:
    """The children that hold a posting."""
    owner = np.repeat(np.arange(len(nodes.query)), nodes.size)
    level = nodes.level[owner]
    a, b = shard.ranks[level, nodes.lo].astype(np.int64), shard.ranks[level, nodes.hi].astype(np.int64)
    z = shard.zeros[level]
    lo, hi = np.concatenate([nodes.lo - a, z + a]), np.concatenate([nodes.hi - b, z + b])
    child, weight = np.concatenate([2 * owner, 2 * owner + 1]), np.concatenate([nodes.weight, nodes.weight])
    live = hi > lo
    twice = lambda x: np.repeat(x, 2)
    return _grouped(shard, child[live], lo[live], hi[live], weight[live], twice(nodes.query), twice(nodes.level + 1), twice(nodes.prefix) * 2 + np.tile([0, 1], len(nodes.query)))


class Best:
    """The k best (score, then doc_id, null last) of every query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.ones(queries, np.int64)  # what a node must reach
        self.query, self.score, self.doc, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        q, s, d, x = (np.concatenate(p) for p in ((self.query, query), (self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((d, x, -s, q))
        q, s, d, x = q[order], s[order], d[order], x[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        full = place == self.k - 1
        self.least[q[full]] = s[full]
        self.query, self.score, self.doc, self.null = q[keep], s[keep], d[keep], x[keep]


def search_shard(shard: Shard, docs: pa.Array, query: np.ndarray, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray, best: Best) -> int:
    """Adds the shard's documents to the best of each query; rows (query, lo, hi, weight) are the queries' lists. The number of nodes opened."""
    ids, null = pc.fill_null(docs, 0).to_numpy(), docs.is_null().to_numpy(zero_copy_only=False)
    queries = len(best.least)
    nodes = _grouped(shard, query, lo, hi, weight, np.arange(queries), np.zeros(queries, np.int64), np.zeros(queries, np.int64))
    wave, few, opened = 0, OPENED, 0
    while True:
        nodes = nodes.take(np.flatnonzero(nodes.bound >= best.least[nodes.query]))
        if not len(nodes.query):
            return opened
        order = np.lexsort((-nodes.bound, nodes.query))
        q = nodes.query[order]
        now = np.arange(len(q)) - np.searchsorted(q, q) < few
        children = _opened(shard, nodes.take(order[now]))
        opened += int(now.sum())
        nodes = nodes.take(order[~now])
        leaf = children.level == shard.levels
        if leaf.any():
            at = children.prefix[leaf]
            best.add(children.query[leaf], children.bound[leaf], ids[at], null[at])
        nodes = Nodes.joined(nodes, children.take(np.flatnonzero(~leaf)))
        wave += 1
        if wave > shard.levels:
            few *= OPENED


def _searched(items: np.ndarray, terms: pa.Array, query: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int):
    """Rows (query, term, weight) by number: of `items` and `terms`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(items), k)
        for b in batches:
            for i in range(b.num_rows):
                here = pc.index_in(terms, value_set=b.column("terms")[i].values).to_numpy(zero_copy_only=False)
                place = here[term]
                live = ~np.isnan(place.astype(float))
                if not live.any():
                    continue
                shard = Shard(*(b.column(c)[i].as_py() for c in ("n_postings", "levels", "impacts", "bits")))
                ends = np.cumsum(b.column("dfs")[i].values.to_numpy())
                at = place[live].astype(np.int64)
                search_shard(shard, b.column("docs")[i].values, query[live], np.append(0, ends)[at], ends[at], weight[live], best)
        yield pa.RecordBatch.from_pydict({"item": pa.array(items[best.query]), "doc_id": pa.array(best.doc, mask=best.null), "score": pa.array(best.score)})

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in _parts(b):
            found, n = terms_of(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(np.repeat(np.arange(len(n)), n))), found.cast(pa.string())], ["item", "term"])


def search(index: DataFrame, docs: int, terms: int, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of a built index for each row of items(item_id, text), as `ranked` has them."""
    spark = index.sparkSession
    named = materialize(items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").cast("string").alias("text")), "lexical-items")
    asked = named.select("item", "text").mapInArrow(_item_terms, "item long, term string").groupBy("item", "term").agg(F.count("*").alias("times"))
    asked = materialize(asked, "lexical-terms")
    lists = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("e")).select(F.col("e.terms").alias("term"), F.col("e.dfs").alias("df"))
    dfs = lists.join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(WEIGHT_SCALE * F.log((2.0 * docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    rows = materialize(asked.join(dfs, "term").select("item", "term", (weight * F.col("times")).alias("weight")).where("weight > 0"), "lexical-weights")
    blocks = max(1, -(-rows.count() // BLOCK_TERMS))
    found = []
    for block in range(blocks):
        some = rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow()
        if some.num_rows:
            item, query = np.unique(some.column("item").to_numpy(), return_inverse=True)
            words = some.column("term").combine_chunks().dictionary_encode()
            if isinstance(words, pa.ChunkedArray):
                words = words.combine_chunks()
            made = index.mapInArrow(_searched(item, words.dictionary, query, words.indices.to_numpy().astype(np.int64), some.column("weight").to_numpy(), k), "item long, doc_id long, score long")
            found.append(made if blocks == 1 else materialize(made, "lexical-found"))
    if not found:
        return spark.createDataFrame([], named.select("item_id").schema).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: for each item its k highest-scoring documents with a score above 0, ties to the smaller doc_id (null last).

    docs(doc_id, text), items(item_id, text); other columns are ignored. Null texts have no terms. Rows that repeat a doc_id are documents of their own, and
    rows that repeat an item_id, or have none, items of their own. Empty tables give no rows.
    """
    index, n, total = build_index(docs)
    return search(index, n, total, items, k)


def oracle_sql() -> str:
    """op12's contract over `documents` and `benchmark`."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cut = rf"unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
    return f"""WITH t AS (SELECT doc_id, {cut} FROM documents), i AS (SELECT item_id, {cut} FROM benchmark),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1), g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
m AS (SELECT doc_id, 25 + (75 * n * docs) // terms AS m FROM n, g),
p AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM i JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10"""
