"""The older engine: neighbour fishing around medoids, majority votes, pairs, merging, bootstraps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import clustering
from .medoids import cluster_runs, queue


#: Bases of a cluster that is kept.
SEED_SIZE = 10_000


def mates(pairs: DataFrame, times: float = 10) -> DataFrame:
    """(idx, mate): of each contig's mates (itself apart) the two of highest coverage, if they pass `times` the third's where there are more than two."""
    w = Window.partitionBy("idx").orderBy(F.desc("coverage"), "mate")
    ranked = pairs.where("idx <> mate").withColumn("r", F.row_number().over(w)).where("r <= 3")
    third = F.max(F.when(F.col("r") == 3, F.struct("coverage")))  # three rows a contig meet where they lie
    best = ranked.groupBy("idx").agg(F.collect_list(F.when(F.col("r") <= 2, F.struct("mate", "coverage"))).alias("two"), third.alias("third")).select("idx", F.inline("two"), "third")
    return best.where(F.col("third").isNull() | F.col("third.coverage").isNull() | (F.col("coverage") > times * F.col("third.coverage"))).select("idx", "mate")


def reciprocal(found: DataFrame) -> DataFrame:
    """(idx, mate) with idx < mate where each is the other's mate. One pass over found: a pair is there from both sides."""
    both = found.where("idx <> mate").groupBy(F.least("idx", "mate").alias("lo"), F.greatest("idx", "mate").alias("hi")).agg(F.bool_or(F.col("idx") < F.col("mate")).alias("up"), F.bool_or(F.col("idx") > F.col("mate")).alias("down"))
    return both.where("up AND down").select(F.col("lo").alias("idx"), F.col("hi").alias("mate"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end; what makes the edges runs once."""
    return edges.select(F.inline(F.array(F.struct("src", "dst", "w"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))))


def fish(edges: DataFrame, medoids: DataFrame, p1: float, p2: float) -> DataFrame:
    """(medoid, contig_id) within one hop of weight p1, or a second of weight p2, of each medoid(medoid)."""
    e = both_ways(edges)
    one = medoids.join(e, F.col("medoid") == F.col("src")).where(F.col("w") >= p1).select("medoid", F.col("dst").alias("contig_id"))
    two = one.join(e, F.col("contig_id") == F.col("src")).where(F.col("w") >= p2).select("medoid", F.col("dst").alias("contig_id"))
    return one.unionByName(two).where("medoid <> contig_id").distinct()


def majority(edges: DataFrame, membership: DataFrame, contigs: DataFrame, min_prob: float, min_binned: float) -> DataFrame:
    """(contig_id, label, votes, binned, friends): one pass of majority votes over unbinned contigs.

    A contig joins a label if more than min_binned of its friends (weight >= min_prob) are binned and more than half of
    those, by whole division, carry it.
    """
    near = both_ways(edges).where(F.col("w") >= min_prob).join(membership.select(F.col("contig_id").alias("src")), "src", "left_anti")
    met = near.join(membership.select(F.col("contig_id").alias("dst"), "label"), "dst", "left")
    total = met.groupBy("src").agg(F.count("*").alias("friends"), F.count("label").alias("binned"))
    votes = met.where("label IS NOT NULL").groupBy("src", "label").agg(F.count("*").alias("votes"))
    won = votes.join(total, "src").where((F.col("binned") > F.col("friends") * min_binned) & (F.col("votes") > F.floor(F.col("binned") / 2)))
    return won.select(F.col("src").alias("contig_id"), "label", "votes", "binned", "friends")


def vote_until_still(edges: DataFrame, membership: DataFrame, contigs: DataFrame, min_prob: float, min_binned: float) -> DataFrame:
    """Votes repeated, all contigs of a round at once, until none joins."""
    membership = membership.transform(written)
    while True:
        new = majority(edges, membership, contigs, min_prob, min_binned).select("contig_id", "label").transform(written)
        if not new.limit(1).count():
            return membership
        membership = membership.unionByName(new).transform(written)


def join_adjacent(edges: DataFrame, membership: DataFrame, p3: float) -> DataFrame:
    """Leftovers beside a bin member (weight >= p3) join the least such label."""
    near = both_ways(edges).where(F.col("w") >= p3).join(membership.select(F.col("contig_id").alias("src"), "label"), "src")
    new = near.groupBy(F.col("dst").alias("contig_id")).agg(F.min("label").alias("label")).join(membership, "contig_id", "left_anti")
    return membership.unionByName(new)


def follow_pairs(membership: DataFrame, pairs: DataFrame) -> DataFrame:
    """Reciprocal mates of members join their bins until none does. Rounds are joined by shuffles: nothing of them goes through the driver."""
    linked = pairs.unionByName(pairs.select(F.col("mate").alias("idx"), F.col("idx").alias("mate"))).transform(written)
    membership = membership.transform(written)
    while True:
        new = linked.join(membership.select(F.col("contig_id").alias("idx"), "label").hint("merge"), "idx").groupBy(F.col("mate").alias("contig_id")).agg(F.min("label").alias("label"))
        new = new.join(membership.hint("merge"), "contig_id", "left_anti").transform(written)
        if not new.limit(1).count():
            return membership
        membership = membership.unionByName(new).transform(written)


#: Contigs with one label in one run that meet in one task.
LABEL_PART = 2048


def comembership(boot: DataFrame, bootstraps: int, p_b: float) -> DataFrame:
    """(src, dst, shared, w): contigs that share a label in at least p_b of the runs. boot(contig_id, b, label), unassigned rows absent.

    A threshold join with a prefix filter: a contig's labels are put in order, rare ones first, and two contigs that share t of them share one among the
    first size - t + 1 of either. Contigs with equal labels are one until the end, and a pair is found at its first shared label only. A label of very many
    contigs is split into parts that meet two by two.
    """
    least = max(1, math.ceil(bootstraps * p_b - 1e-9))
    boot = boot.select("contig_id", F.col("b").cast("long").alias("b"), F.col("label").cast("long").alias("label")).distinct()
    often = boot.groupBy("b", "label").agg(F.count("*").alias("n"))
    labels = boot.join(often, ["b", "label"]).groupBy("contig_id").agg(F.array_sort(F.collect_list(F.struct("n", "b", "label"))).alias("labels")).where(F.size("labels") >= least)
    labels = labels.transform(written)
    rows = labels.join(labels.groupBy("labels").agg(F.min("contig_id").alias("rep")), "labels").transform(written)
    kinds = rows.where("contig_id = rep").select("rep", "labels")
    head = kinds.withColumn("at", F.explode(F.slice("labels", F.lit(1), F.size("labels") - least + 1)))
    parts = F.ceil(F.col("at.n") / LABEL_PART)  # of a label; equal contigs were counted apart, so parts are small rather than large
    head = head.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    tile = lambda own, other: F.struct("at.b", "at.label", own.alias("x"), other.alias("y"))
    x = head.withColumn("o", F.explode(F.filter(every, lambda v: v >= F.col("part")))).select(tile(F.col("part"), F.col("o")).alias("tile"), F.col("rep").alias("a"), F.col("labels").alias("p"), "at", F.col("part").alias("of_a"))
    y = head.withColumn("o", F.explode(F.filter(every, lambda v: v <= F.col("part")))).select(tile(F.col("o"), F.col("part")).alias("tile"), F.col("rep").alias("c"), F.col("labels").alias("q"), F.col("part").alias("of_c"))
    met = x.join(y, "tile").where((F.col("of_a") < F.col("of_c")) | (F.col("a") < F.col("c"))).withColumn("both", F.array_intersect("p", "q"))
    pairs = met.where((F.size("both") >= least) & (F.col("both")[0] == F.col("at"))).select("a", "c", F.size("both").cast("long").alias("shared"))
    named = lambda rep, name: rows.select(F.col("rep").alias(rep), F.col("contig_id").alias(name))
    apart = pairs.join(named("a", "i"), "a").join(named("c", "j"), "c").select(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst"), "shared")
    alike = rows.select("rep", F.col("contig_id").alias("src"), F.size("labels").cast("long").alias("shared")).join(named("rep", "dst"), "rep").where("src < dst").select("src", "dst", "shared")
    return apart.unionByName(alike).select("src", "dst", "shared", (F.col("shared") / bootstraps).alias("w"))


def comembership_classes(boot: DataFrame, bootstraps: int, p_b: float) -> DataFrame:
    """(contig_id, component, links): comembership() as one row a contig of boot, in work that grows with the contigs: how many others share a label with it in at
    least p_b of the runs, and the least contig that such links reach.

    Contigs are linked if they hold one set of t labels together. Those that hold a set are counted by a grouping; of a contig with the sets S, the sum over j >= t of
    (-1)^(j-t) * C(j-1, t-1) * (holders of its sets of j labels) counts everyone who shares t or more once. Contigs with equal labels are one until the end. A
    contig with m labels has C(m, t) + ... + C(m, m) sets: 64 for four of seven; this is for few runs.
    """
    least = max(1, math.ceil(bootstraps * p_b - 1e-9))
    boot = boot.where("contig_id IS NOT NULL AND b IS NOT NULL AND label IS NOT NULL")
    held = boot.groupBy("contig_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "b", "label"))).alias("labels")).transform(written)
    kinds = held.where(F.size("labels") >= least).groupBy("labels").agg(F.min("contig_id").alias("rep"), F.count("*").alias("n"))
    masks = F.expr(f"filter(sequence(0L, shiftleft(1L, size(labels)) - 1), m -> bit_count(m) >= {least})")
    sets = kinds.withColumn("mask", F.explode(masks)).select("rep", "n", F.bit_count("mask").alias("j"), F.array_join(F.filter("labels", lambda x, i: F.getbit(F.col("mask"), i) == 1), ",").alias("held")).transform(written)
    holders = sets.groupBy("held").agg(F.sum("n").alias("holders"), F.min("rep").alias("first"))
    met = sets.join(holders, "held").transform(written)
    sign = F.element_at(F.array(*[F.lit((-1) ** (j - least) * math.comb(j - 1, least - 1)) for j in range(least, 63)]), F.col("j") - least + 1)
    links = met.groupBy("rep").agg((F.sum(sign * F.col("holders")) - 1).alias("links"))
    component = clustering.graph_components(met.where(F.col("j") == least).where("first <> rep").select(F.col("first").alias("src"), F.col("rep").alias("dst")).distinct())
    named = kinds.select("rep", "labels").join(links, "rep").join(component.withColumnRenamed("contig_id", "rep"), "rep", "left").select("labels", F.coalesce("component", "rep").alias("component"), "links")
    return held.join(named, "labels", "left").select("contig_id", F.coalesce("component", "contig_id").alias("component"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def bin_overlap(membership: DataFrame, min_shared: float = 0.5) -> DataFrame:
    """(a, b, common, share): bins whose intersection is at least min_shared of the smaller one."""
    size = membership.groupBy("label").agg(F.count("*").alias("n"))
    x, y = membership.select("contig_id", F.col("label").alias("a")), membership.select("contig_id", F.col("label").alias("b"))
    common = x.join(y, "contig_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    out = common.join(size.select(F.col("label").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("label").alias("b"), F.col("n").alias("nb")), "b")
    return out.withColumn("share", F.col("common") / F.least("na", "nb")).where(F.col("share") >= min_shared).select("a", "b", "common", "share")


def medoids(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(label, contig_id): of each bin the member of greatest weight sum to the others, then of least id."""
    named = membership.select(F.col("contig_id").alias("dst"), F.col("label").alias("other"))
    near = both_ways(edges).join(named, "dst").select(F.col("src").alias("contig_id"), F.col("other").alias("label"), "w").groupBy("contig_id", "label").agg(F.round(F.sum("w"), 9).alias("w"))
    rows = membership.join(near, ["contig_id", "label"], "left").select("label", F.struct(F.coalesce("w", F.lit(0.0)).alias("w"), (-F.col("contig_id")).alias("minus")).alias("m"))
    return rows.groupBy("label").agg(F.max("m").alias("m")).select("label", (-F.col("m.minus")).alias("contig_id"))


def pair_probability(pairs: DataFrame, edges: DataFrame, fallback: DataFrame) -> DataFrame:
    """(src, dst, p) of pairs(src, dst): 1 for a contig and itself, else the edge's weight w, else 1 - d of the fallback (src, dst, d); src < dst in both, each pair once.

    Pairs, edges and the fallback go through one grouping.
    """
    lo, hi = F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")
    none = F.lit(None).cast("double")
    one = lambda way: way.cast("int").cast("long")
    rows = pairs.where("src <> dst").select(lo, hi, none.alias("w"), none.alias("d"), one(F.col("src") < F.col("dst")).alias("up"), one(F.col("src") > F.col("dst")).alias("down"))
    for df, w, d in ((edges, F.col("w"), none), (fallback, none, F.col("d"))):
        rows = rows.unionByName(df.select(lo, hi, w.cast("double").alias("w"), d.cast("double").alias("d"), F.lit(0).cast("long").alias("up"), F.lit(0).cast("long").alias("down")))
    known = rows.groupBy("lo", "hi").agg(F.max("w").alias("w"), F.max("d").alias("d"), F.sum("up").alias("up"), F.sum("down").alias("down"))
    times = lambda src, dst, n: F.array_repeat(F.struct(F.col(src).alias("src"), F.col(dst).alias("dst")), F.col(n).cast("int"))
    found = known.select(F.coalesce("w", 1 - F.col("d")).alias("p"), F.explode(F.concat(times("lo", "hi", "up"), times("hi", "lo", "down"))).alias("e")).select("e.src", "e.dst", "p")
    same = pairs.where("src = dst").select("src", "dst", F.lit(1.0).alias("p"))
    return found.unionByName(same)


def runs_binned(boot: DataFrame) -> DataFrame:
    """(contig_id, runs): in how many bootstraps a contig is binned."""
    return boot.groupBy("contig_id").agg(F.countDistinct("b").alias("runs"))


def dissolve(membership: DataFrame, contigs: DataFrame, turn: int, min_cls_size: int, seed_size: int = SEED_SIZE) -> DataFrame:
    """Members of bins that reach min(seed_size * 2**turn, min_cls_size) bases; the others are leftovers again."""
    return clustering.large_bins(membership, contigs, min(seed_size * 2**turn, min_cls_size))


def escalate(edges: DataFrame, membership: DataFrame, contigs: DataFrame, min_prob: float, min_binned: float, min_cls_size: int, run: Column | None = None) -> DataFrame:
    """Votes, then bins below a floor that doubles each turn are dissolved, until no bin is. run: of a label, if several runs share the table; each ends by itself."""
    run = F.lit(0) if run is None else run
    done, turn = membership.select("contig_id", "label").where("false"), 1
    while True:
        voted = vote_until_still(edges, membership, contigs, min_prob, min_binned)
        kept = dissolve(voted, contigs, turn, min_cls_size).withColumn("r", run).transform(written)
        lost = voted.select("label").distinct().join(kept.select("label").distinct(), "label", "left_anti").select(run.alias("r")).distinct().transform(written)
        done = done.unionByName(kept.join(lost, "r", "left_anti").select("contig_id", "label"))
        if not lost.limit(1).count():
            return done
        membership, turn = kept.join(lost, "r", "left_semi").select("contig_id", "label"), turn + 1


def greedy_merge(membership: DataFrame, min_shared: float = 0.5) -> DataFrame:
    """membership(contig_id, label), contigs in several bins, with bins merged that share at least min_shared of the smaller one's members.

    Smallest first (by members, then label): a bin joins the first larger one that it shares enough with; after a merge the smallest is
    looked at again. Bins that share members, however indirectly, are one group; every group makes its next merge in the same round.
    """
    membership = membership.select("contig_id", "label").distinct().transform(written)
    while True:
        x, y = membership.select("contig_id", F.col("label").alias("src")), membership.select("contig_id", F.col("label").alias("dst"))
        common = x.join(y, "contig_id").where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("common"))
        size = membership.groupBy("label").agg(F.count("*").alias("n"))
        common = common.join(size.select(F.col("label").alias("src"), F.col("n").alias("a")), "src").join(size.select(F.col("label").alias("dst"), F.col("n").alias("b")), "dst")
        fit = common.where(F.struct("a", "src") < F.struct(F.col("b").alias("a"), F.col("dst").alias("src"))).where(F.col("common") / F.col("a") >= min_shared).transform(written)
        if not fit.limit(1).count():
            return membership
        group = clustering.graph_components(common.select("src", "dst")).withColumnRenamed("contig_id", "src")
        pick = fit.join(group, "src").groupBy("component").agg(F.min(F.struct("a", "src", "b", "dst")).alias("m")).select(F.col("m.src").alias("label"), F.col("m.dst").alias("to"))
        membership = membership.join(F.broadcast(pick) if pick.count() <= 100_000 else pick, "label", "left").select("contig_id", F.coalesce("to", "label").alias("label")).distinct().transform(written)


def first_come(membership: DataFrame, contigs: DataFrame, min_cls_size: int) -> DataFrame:
    """A contig in several bins stays in the largest; what bins keep must still reach min_cls_size."""
    totals = clustering.bin_totals(membership, contigs)
    w = Window.partitionBy("contig_id").orderBy(F.desc("bases"), "label")
    kept = membership.join(totals.select("label", "bases"), "label").withColumn("r", F.row_number().over(w)).where("r = 1").select("contig_id", "label")
    return clustering.large_bins(kept, contigs, min_cls_size)


def bootstrap(edges: DataFrame, contigs: DataFrame, runs: int, p1: float, p2: float, seed: int = 42, seed_size: int = SEED_SIZE, depth: DataFrame | None = None) -> DataFrame:
    """boot(contig_id, b, label): medoid clusterings under `runs` queues, labelled by their least contig.

    Queues are random; with depth(contig_id, mean) that of run 1 begins with the deepest contigs. Clusters of more than two members and at least seed_size bases are kept.
    """
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    first = None if depth is None else depth.groupBy(F.col("contig_id").alias("node")).agg(F.sum("mean").alias("depth"))
    owners = cluster_runs(edges, queue(nodes, runs, seed, first).transform(written), p1, p2).transform(written)
    sums = owners.join(contigs.select(F.col("contig_id").alias("node"), "size"), "node").groupBy("b", "start", "turn").agg(F.count("*").alias("n"), F.sum("size").alias("bases"), F.min("node").alias("label"))
    kept = sums.where((F.col("n") > 2) & (F.col("bases") >= seed_size)).select("b", "start", "turn", "label")
    return owners.join(kept, ["b", "start", "turn"]).select(F.col("node").alias("contig_id"), "b", "label")
