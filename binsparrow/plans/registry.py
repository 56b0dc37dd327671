"""Queries of the binning operators over the driver's tables, with their SQL.

Stand-ins: a document is a contig (letters collapsed to bases), a part's line items are its depths in three samples (return
flags), parts of one order are mates and neighbours, a part's least supplier is its bin.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BinningConfig
from ..functions import composition, statistics
from ..operators import admission, clustering, depths, ensemble, scoring, similarity
from ..session import written
from ..sources import readers, sinks
from . import binning

QUERIES: dict = {}
ORACLE: dict = {}

LETTERS = ascii_lowercase + ascii_uppercase
BASES = "".join("ACGT"[i % 4] for i in range(26)) * 2


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("contig_id"), F.concat_ws(" ", "source", "lang").alias("name"), F.translate("text", LETTERS, BASES).alias("seq"), F.col("n_chars").alias("size"))


def large_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = readers.classify(contigs(spark, sf_dir)).where("size_class = 'large'")
    return composition.profiles(large).join(large.select("contig_id", "log_size"), "contig_id").select("contig_id", "log_size", "tnf").transform(written)  # read several times


def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("contig_id"), F.col("l_returnflag").alias("sample_id"))
    return items.agg(F.avg("l_quantity").alias("mean"), F.coalesce(F.var_samp("l_quantity"), F.lit(0.0)).alias("var"))


#: Line items of one task where they meet: tasks stay as small on large tables, whatever the session's partitions.
ITEMS = 150_000


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges(src, dst, w): parts of one order, weighted by what was ordered of both."""
    rows = table(spark, sf_dir, "lineitem")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ITEMS))
    item = rows.select("l_orderkey", "l_partkey", "l_quantity").repartition(parts, "l_orderkey").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    a, b = item.select("l_orderkey", F.col("l_partkey").alias("src"), F.col("q").alias("qa")), item.select("l_orderkey", F.col("l_partkey").alias("dst"), F.col("q").alias("qb"))
    met = a.join(b, "l_orderkey").where("src < dst").select("src", "dst", "qa", "qb").repartition(parts, "src").groupBy("src", "dst").agg(F.sum(F.col("qa") + F.col("qb")).alias("q"))
    return met.select("src", "dst", F.least(F.lit(0.99), F.col("q") / 110).alias("w"))


def mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.both_ways(neighbours(spark, sf_dir)).select(F.col("src").alias("idx"), F.col("dst").alias("mate"), F.col("w").alias("coverage"))


def supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """membership(contig_id, label): parts with more than 20 line items returned are unbinned."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("contig_id"))
    rows = items.agg((F.min("l_suppkey") % 20).alias("label"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count("*").alias("n"))
    return rows.where(F.col("r") * 3 < F.col("n")).select("contig_id", "label")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("contig_id")).agg(F.sum("l_quantity").cast("long").alias("size"))


CONTIGS = f"contigs AS (SELECT doc_id AS contig_id, concat_ws(' ', source, lang) AS name, translate(text, '{LETTERS}', '{BASES}') AS seq, n_chars AS size FROM documents)"
KMERS = """raw AS (SELECT contig_id, unnest(regexp_extract_all(substr(seq, p), '(?s).{4}')) AS k FROM contigs, range(1, 5) r(p)),
counts AS (SELECT contig_id, least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS kmer, count(*) AS cnt FROM raw WHERE regexp_full_match(k, '[ACGT]{4}') GROUP BY ALL)"""
VALUES = "vals AS (SELECT contig_id, kmer, cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY contig_id)) AS value FROM counts)"
DEPTH = "depth AS (SELECT l_partkey AS contig_id, l_returnflag AS sample_id, avg(l_quantity) AS mean, coalesce(var_samp(l_quantity), 0) AS var FROM lineitem GROUP BY ALL)"
EDGES = """item AS (SELECT l_orderkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
edges AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, least(0.99, sum(a.q + b.q) / 110) AS w FROM item a JOIN item b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL),
ways AS (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges)"""
MEMBERS = "members AS (SELECT l_partkey AS contig_id, min(l_suppkey) % 20 AS label FROM lineitem GROUP BY 1 HAVING 3 * count(*) FILTER (l_returnflag = 'R') < count(*))"
PARTS = "parts AS (SELECT l_partkey AS contig_id, sum(l_quantity)::BIGINT AS size FROM lineitem GROUP BY 1)"
ENDS = "ends AS (SELECT e.src, e.dst, e.w, a.sample_id, a.mean AS m1, a.var AS v1, b.mean AS m2, b.var AS v2 FROM edges e JOIN depth a ON a.contig_id = e.src JOIN depth b ON b.contig_id = e.dst AND a.sample_id = b.sample_id)"


def _overlap_sql() -> str:
    phi = statistics.normal_cdf_sql
    return f"""o1 AS (SELECT *, greatest(m1, 1e-6) AS a, greatest(m2, 1e-6) AS b, greatest(v1, 1) AS va, greatest(v2, 1) AS vb FROM ends),
    o2 AS MATERIALIZED (SELECT *, vb - va AS d, sqrt(greatest(0, va * vb * ((a - b) * (a - b) + (vb - va) * ln(vb / va)))) AS root, abs(vb - va) < 1e-4 AS near FROM o1),
    o3 AS MATERIALIZED (SELECT *, CASE WHEN near THEN (a + b) / 2 ELSE (a * vb - b * va - root) / d END AS k1, CASE WHEN near THEN (a + b) / 2 ELSE (a * vb - b * va + root) / d END AS k2 FROM o2),
    o4 AS MATERIALIZED (SELECT *, (k1 - a) / sqrt(va) AS x1, (k1 - b) / sqrt(vb) AS x2, (k2 - a) / sqrt(va) AS x3, (k2 - b) / sqrt(vb) AS x4 FROM o3),
    o5 AS MATERIALIZED (SELECT *, {phi('x1')} AS p1, {phi('x2')} AS p2, {phi('x3')} AS p3, {phi('x4')} AS p4 FROM o4),
    dist AS (SELECT src, dst, w, sample_id, m1, m2, CASE WHEN m1 > 1 OR m2 > 1 THEN least(greatest(CASE WHEN a = b THEN 0 WHEN near THEN abs(p1 - p2) ELSE abs(p3 - p1 + p2 - p4) END, 1e-6), 1 - 1e-6) END AS dd FROM o5)"""


OVERLAP = _overlap_sql()


def _pre_prob_sql(d: str, l1: str, l2: str) -> str:
    x, y = f"least({l1}, {l2})", f"greatest({l1}, {l2})"

    def poly(terms, coefficients):
        return "(" + " + ".join(" * ".join([f"({c!r}::DOUBLE)"] + [x] * i + [y] * j) for (i, j), c in zip(terms, coefficients, strict=True)) + ")"

    one, two = (f"(-({poly(tb, b)} + {d} * {poly(tc, c)}))" for tb, b, tc, c in composition.STAGES)
    return f"CASE WHEN {one} <= {composition.LOGIT_9} THEN least({two}, {composition.LOGIT_9}) ELSE {one} END"


PAIRS = f"""wide AS (SELECT contig_id, log10(least(any_value(size), 500000)) AS lg, list(coalesce(value, 0) ORDER BY k.kmer) AS tnf
  FROM (SELECT contig_id, size FROM contigs WHERE size >= 2500) CROSS JOIN (SELECT DISTINCT kmer FROM counts) k LEFT JOIN vals USING (contig_id, kmer) GROUP BY contig_id),
far AS (SELECT a.contig_id AS src, b.contig_id AS dst, a.lg AS l1, b.lg AS l2, list_distance(a.tnf, b.tnf) AS d FROM wide a JOIN wide b ON a.contig_id <> b.contig_id),
scored AS (SELECT src, dst, {_pre_prob_sql('d', 'l1', 'l2')} AS p FROM far)"""
TNF = f"WITH {CONTIGS}, {KMERS}, {VALUES}, {PAIRS}"


@query(f"WITH {CONTIGS} SELECT contig_id, size, round(log10(least(size, 500000)), 9) AS log_size, CASE WHEN size >= 2500 THEN 'large' WHEN size >= 1000 THEN 'small' ELSE 'tooShort' END AS size_class, regexp_extract(name, '^[^ \\t]*', 0) AS name FROM contigs")
def contig_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.classify(contigs(spark, sf_dir))
    return rows.select("contig_id", "size", F.round("log_size", 9).alias("log_size"), "size_class", readers.trim_name(F.col("name")).alias("name"))


@query(f"WITH {CONTIGS}, {KMERS} SELECT contig_id, kmer, cnt FROM counts")
def tetramer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composition.tetramers(contigs(spark, sf_dir))


@query(f"WITH {CONTIGS}, {KMERS}, {VALUES} SELECT contig_id, kmer, round(value, 9) AS value FROM vals")
def tnf_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composition.tetramer_values(contigs(spark, sf_dir)).select("contig_id", "kmer", F.round("value", 9).alias("value"))


@query(f"WITH {CONTIGS}, {KMERS} SELECT contig_id, kmer, cnt, rank FROM (SELECT *, row_number() OVER (PARTITION BY contig_id ORDER BY cnt DESC, kmer) AS rank FROM counts) WHERE rank <= 5")
def top_tetramers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("contig_id").orderBy(F.desc("cnt"), "kmer")
    return composition.tetramers(contigs(spark, sf_dir)).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5")


@query(f"WITH {CONTIGS} SELECT contig_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS revcomp_md5 FROM contigs")
def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contigs(spark, sf_dir).select("contig_id", F.md5(composition.revcomp(F.col("seq"))).alias("revcomp_md5"))


@query(f"{TNF} SELECT src, dst, round(1 - 1 / (1 + exp(p)), 6) AS s_tnf FROM scored WHERE src < dst AND p > ln(0.75 / 0.25)")
def tnf_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similarity.scored_pairs(large_profiles(spark, sf_dir), 0.75).where("src < dst")
    return pairs.select("src", "dst", F.round(composition.logistic(F.col("pre_prob")), 6).alias("s_tnf"))


@query(f"{TNF}, top AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY p DESC, dst) AS r FROM scored WHERE p > ln(0.7 / 0.3)) SELECT src, dst, round(1 - 1 / (1 + exp(p)), 6) AS s_tnf FROM top WHERE r <= 20 AND src < dst")
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.knn_graph(large_profiles(spark, sf_dir), 0.7, 20).select("src", "dst", F.round("s_tnf", 6).alias("s_tnf"))


@query(f"{TNF}, best AS (SELECT src, greatest(0.5, max(1 - 1 / (1 + exp(p)))) AS b FROM scored GROUP BY src), grid AS (SELECT unnest([0.7, 0.8, 0.9, 0.95, 0.99]::DOUBLE[]) AS cutoff) SELECT cutoff, round(count(*) FILTER (b >= cutoff) / count(*), 6) AS covered FROM best, grid GROUP BY cutoff")
def cutoff_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = similarity.best_similarity(large_profiles(spark, sf_dir), 0.69)  # below the least cutoff
    return similarity.coverage(best, [0.7, 0.8, 0.9, 0.95, 0.99]).select("cutoff", F.round("covered", 6).alias("covered"))


@query(f"""{TNF}, drawn AS (SELECT attempt, contig_id FROM wide, range(3) t(attempt) QUALIFY row_number() OVER (PARTITION BY attempt ORDER BY md5(concat_ws(':', 42, attempt, contig_id)), contig_id) <= 60),
best AS (SELECT a.attempt, a.contig_id, greatest(0.5, max(1 - 1 / (1 + exp(p)))) AS b FROM drawn a JOIN scored ON src = a.contig_id JOIN drawn z ON z.attempt = a.attempt AND z.contig_id = dst GROUP BY ALL), grid AS (SELECT unnest([0.7, 0.9, 0.99]::DOUBLE[]) AS cutoff)
SELECT attempt::INTEGER AS attempt, cutoff, round(count(*) FILTER (b >= cutoff) / count(*), 6) AS covered FROM best, grid GROUP BY ALL""")
def sampled_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage inside three samples, as the cutoff search draws them."""
    profiles = large_profiles(spark, sf_dir)
    runs = [similarity.sampled_coverage(profiles, 60, a, [0.7, 0.9, 0.99]).select(F.lit(a).alias("attempt"), "cutoff", F.round("covered", 6).alias("covered")) for a in range(3)]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


@query("SELECT event_id, user_id, before FROM (SELECT event_id, user_id, lag(user_id) OVER (ORDER BY event_id) AS before FROM events WHERE user_id IS NOT NULL) WHERE user_id < before")
def order_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand for lines of a file, read in splits of 1000: where a user comes after a later one."""
    place = F.shiftleft(F.floor(F.col("event_id") / 1000), 33) + F.col("event_id") % 1000
    rows = readers.order_breaks(table(spark, sf_dir, "events").withColumn("row", place), "user_id")
    return rows.select((F.shiftright("row", 33) * 1000 + F.col("row") % F.lit(1 << 33)).alias("event_id"), F.col("key").alias("user_id"), "before")


@query(f"WITH {DEPTH} SELECT contig_id, round(coalesce(sum(mean) FILTER (mean >= 20), 0), 6) AS total, CASE WHEN NOT bool_and(mean BETWEEN 0 AND 1e7 AND var BETWEEN 0 AND 1e14) THEN 'invalid' WHEN coalesce(bool_or(mean > 0 AND var / mean > 12), false) THEN 'highVariance' WHEN coalesce(sum(mean) FILTER (mean >= 20), 0) < 50 THEN 'lowDepth' ELSE 'ok' END AS verdict FROM depth GROUP BY contig_id")
def depth_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depths.judged(depth(spark, sf_dir), 20, 50, 12).select("contig_id", F.round("total", 6).alias("total"), "verdict")


@query(f"WITH {DEPTH}, {EDGES}, {ENDS}, {OVERLAP} SELECT src, dst, round(avg(1 - dd), 6) AS s_abd, count(dd) AS nnz FROM dist GROUP BY src, dst HAVING count(dd) > 0")
def abundance_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depths.overlap(neighbours(spark, sf_dir), depth(spark, sf_dir)).select("src", "dst", F.round("s_abd", 6).alias("s_abd"), "nnz")


@query(f"WITH {DEPTH}, {EDGES}, {ENDS}, {OVERLAP} SELECT src, dst, round(exp(avg(ln(dd))), 6) AS d_abd, count(dd) AS nnz FROM dist GROUP BY src, dst HAVING count(dd) > 0")
def geometric_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depths.geometric_distance(neighbours(spark, sf_dir), depth(spark, sf_dir)).select("src", "dst", F.round("d_abd", 6).alias("d_abd"), "nnz")


def _pooled_sql() -> str:
    tail = lambda m: f"list_sum(list_transform(range(0, 400), lambda n: exp((k + 1 + n) * ln({m}) - {m} - lgamma(k + 2 + n))))"
    return f"""low AS (SELECT src, dst, coalesce(sum(ln(dd)) FILTER (m1 > 25 OR m2 > 25), 0) AS logs, count(*) FILTER (m1 > 25 OR m2 > 25) AS n,
    coalesce(sum(m1) FILTER (m1 <= 25 AND m2 <= 25), 0) AS l1, coalesce(sum(m2) FILTER (m1 <= 25 AND m2 <= 25), 0) AS l2 FROM dist GROUP BY src, dst),
pool AS (SELECT *, CASE WHEN greatest(l1, l2) > 25 THEN 1 ELSE 0 END AS extra, CASE WHEN abs(l1 - l2) > 1e-3 THEN (l1 - l2) / (ln(l1) - ln(l2)) END AS k FROM low),
joined AS (SELECT *, CASE WHEN extra = 1 AND k IS NOT NULL THEN ln(greatest(abs({tail("l1")} - {tail("l2")}), 1e-12)) ELSE 0 END AS more FROM pool)"""


@query(f"WITH {DEPTH}, {EDGES}, {ENDS}, {OVERLAP}, {_pooled_sql()} SELECT src, dst, round(exp((logs + more) / (n + extra)), 6) AS d_abd, n + extra AS nnz FROM joined WHERE n + extra > 0")
def pooled_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = depths.geometric_distance(neighbours(spark, sf_dir), depth(spark, sf_dir), 25, True)
    return rows.select("src", "dst", F.round("d_abd", 6).alias("d_abd"), "nnz")


@query(f"WITH {DEPTH}, {EDGES}, {ENDS}, {OVERLAP}, g AS (SELECT src, dst, any_value(1 - w) AS t, exp(avg(ln(dd))) AS a, count(dd) AS n FROM dist GROUP BY src, dst HAVING count(dd) > 0) SELECT src, dst, round(CASE WHEN t > 0.05 THEN greatest(t, 0.9 * a) ELSE a * least(ln(n + 1) / ln(101), 0.9) + t * (1 - least(ln(n + 1) / ln(101), 0.9)) END, 6) AS d FROM g")
def combined_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = depths.geometric_distance(neighbours(spark, sf_dir), depth(spark, sf_dir))
    return rows.select("src", "dst", F.round(statistics.combined_distance(1 - F.col("w"), F.col("d_abd"), F.col("nnz")), 6).alias("d"))


@query(f"WITH {DEPTH}, {EDGES}, {ENDS} SELECT src, dst, round(CASE WHEN count(*) < 3 THEN 0 ELSE corr(m1, m2) END, 5) AS cor FROM ends GROUP BY src, dst")
def edge_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = depths.correlation(neighbours(spark, sf_dir), depth(spark, sf_dir), 3)
    return rows.select("src", "dst", F.coalesce(F.round("cor", 5), F.lit(float("nan"))).alias("cor"))  # as the SQL has it without variance


RANKED = "ranked AS (SELECT contig_id, sample_id, (rank() OVER (PARTITION BY contig_id ORDER BY mean) + count(*) OVER (PARTITION BY contig_id ORDER BY mean RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2 AS mean FROM depth)"


@query(f"WITH {DEPTH}, {EDGES}, {RANKED} SELECT e.src, e.dst, round(corr(a.mean, b.mean), 5) AS cor FROM edges e JOIN ranked a ON a.contig_id = e.src JOIN ranked b ON b.contig_id = e.dst AND a.sample_id = b.sample_id GROUP BY e.src, e.dst HAVING count(*) = 3 AND var_pop(a.mean) > 0 AND var_pop(b.mean) > 0")
def edge_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = depths.ranked(depth(spark, sf_dir))
    met = depths.with_depths(neighbours(spark, sf_dir).select("src", "dst"), ranks).groupBy("src", "dst").agg(depths.pearson("m1", "m2").alias("cor"), F.count("*").alias("n"), F.var_pop("m1").alias("x"), F.var_pop("m2").alias("y"))
    return met.where("n = 3 AND x > 0 AND y > 0").select("src", "dst", F.round("cor", 5).alias("cor"))


@query(f"WITH {DEPTH} SELECT contig_id, sample_id, rank() OVER w AS rank_min, count(*) OVER (PARTITION BY contig_id ORDER BY mean RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank_max, row_number() OVER (PARTITION BY contig_id ORDER BY mean, sample_id) AS rank_first FROM depth WINDOW w AS (PARTITION BY contig_id ORDER BY mean)")
def row_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.with_ranks(depth(spark, sf_dir), "mean", ["contig_id"], ["sample_id"]).select("contig_id", "sample_id", "rank_min", "rank_max", "rank_first")


@query("SELECT l_quantity AS value, count(*) AS n, min(r) AS rank_min, min(r) + count(*) - 1 AS rank_max FROM (SELECT l_quantity, rank() OVER (ORDER BY l_quantity) AS r FROM lineitem) GROUP BY l_quantity")
def value_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.value_ranks(table(spark, sf_dir, "lineitem"), "l_quantity")


@query("WITH t AS (SELECT event_id, value AS x, value * value AS y FROM events WHERE value IS NOT NULL), s AS (SELECT y, row_number() OVER (ORDER BY y) AS r FROM t), o AS (SELECT event_id, rank() OVER (ORDER BY x) AS r FROM t) SELECT event_id, round(y, 6) AS mapped FROM o JOIN s USING (r)")
def quantile_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", F.col("value").alias("x"), (F.col("value") * F.col("value")).alias("y"))
    return statistics.quantile_map(rows, "x", "y").select("event_id", F.round("mapped", 6).alias("mapped"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.95), 4) AS q95 FROM lineitem GROUP BY l_returnflag")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    found = statistics.percentiles(items, "l_returnflag", "l_extendedprice", [0.25, 0.5, 0.95])
    q = lambda p: F.round(F.max(F.when(F.col("at") == p, F.col("q"))), 4)
    rows = found.groupBy("l_returnflag").agg(q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.95).alias("q95"))
    empty = items.groupBy("l_returnflag").agg(F.count("l_extendedprice").alias("n")).where("n = 0").select("l_returnflag", *[F.lit(None).cast("double").alias(c) for c in ("q25", "q50", "q95")])
    return rows.unionByName(empty)


@query(f"WITH {EDGES}, {MEMBERS}, sums AS (SELECT src AS node, label, count(*) AS n, sum(-ln(1 - w)) AS x FROM ways JOIN members ON contig_id = dst GROUP BY ALL) SELECT node, label, n, round(1 - exp(-x) * list_sum(list_transform(range(0, n), lambda k: exp(k * ln(x) - lgamma(k + 1)))), 6) AS score FROM sums")
def fisher_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = neighbours(spark, sf_dir).withColumnRenamed("w", "s")
    return scoring.fisher(edges, supplied(spark, sf_dir)).select("node", "label", "n", F.round("score", 6).alias("score"))


PAIRED = f"WITH {EDGES}, rk AS (SELECT src AS idx, dst AS mate, w, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM ways), th AS (SELECT idx, w AS third FROM rk WHERE r = 3), found AS (SELECT idx, mate FROM rk LEFT JOIN th USING (idx) WHERE r <= 2 AND (third IS NULL OR w > 1.01 * third))"


@query(f"{PAIRED} SELECT a.idx, a.mate FROM found a JOIN found b ON a.idx = b.mate AND a.mate = b.idx WHERE a.idx < a.mate")
def reciprocal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.reciprocal(ensemble.mates(mates(spark, sf_dir), 1.01))


@query(f"WITH {EDGES}, {MEMBERS}, near AS (SELECT src, label FROM ways LEFT JOIN members m ON m.contig_id = dst WHERE w >= 0.5 AND src NOT IN (SELECT contig_id FROM members)), t AS (SELECT src, count(*) AS friends, count(label) AS binned FROM near GROUP BY src), v AS (SELECT src, label, count(*) AS votes FROM near WHERE label IS NOT NULL GROUP BY ALL) SELECT src AS contig_id, label, votes, binned, friends FROM v JOIN t USING (src) WHERE binned > friends * 0.4 AND votes > binned // 2")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.majority(neighbours(spark, sf_dir), supplied(spark, sf_dir), parts(spark, sf_dir), 0.5, 0.4)


@query(f"WITH {EDGES}, {MEMBERS} SELECT contig_id, label FROM members UNION ALL SELECT dst, min(label) FROM ways JOIN members ON contig_id = src WHERE w >= 0.9 AND dst NOT IN (SELECT contig_id FROM members) GROUP BY dst")
def join_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.join_adjacent(neighbours(spark, sf_dir), supplied(spark, sf_dir), 0.9)


@query(f"WITH {EDGES}, {MEMBERS}, med AS (SELECT label, min(contig_id) AS medoid FROM members GROUP BY label), one AS (SELECT medoid, dst AS c FROM med JOIN ways ON src = medoid WHERE w >= 0.6) SELECT DISTINCT medoid, c AS contig_id FROM (SELECT * FROM one UNION ALL SELECT medoid, dst FROM one JOIN ways ON src = c WHERE w >= 0.9) WHERE medoid <> c")
def fish_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    medoids = supplied(spark, sf_dir).groupBy("label").agg(F.min("contig_id").alias("medoid")).select("medoid")
    return ensemble.fish(neighbours(spark, sf_dir), medoids, 0.6, 0.9)


BOOT = "boot AS (SELECT l_partkey AS contig_id, l_linenumber AS b, min(l_suppkey) % 10 AS label FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH RECURSIVE {BOOT}, pairs AS (SELECT x.contig_id AS src, y.contig_id AS dst FROM boot x JOIN boot y ON x.b = y.b AND x.label = y.label AND x.contig_id <> y.contig_id GROUP BY ALL HAVING count(*) >= 7 * 0.5),
reach AS (SELECT DISTINCT contig_id, contig_id AS other FROM boot UNION SELECT contig_id, dst FROM reach JOIN pairs ON src = other)
SELECT contig_id, component, coalesce(links, 0) AS links FROM (SELECT contig_id, min(other) AS component FROM reach GROUP BY 1) LEFT JOIN (SELECT src AS contig_id, count(*) AS links FROM pairs GROUP BY 1) USING (contig_id)""")
def comembership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers stand for runs, a part's least supplier under one for its label. One row a part: its class and its number of links, as pairs grow with the square of the parts."""
    boot = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("contig_id"), F.col("l_linenumber").alias("b")).agg((F.min("l_suppkey") % 10).alias("label"))
    return ensemble.comembership_classes(boot, 7, 0.5)


SOLD = "sold AS (SELECT DISTINCT l_partkey AS contig_id, l_suppkey % 25 AS label FROM lineitem)"


def sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("contig_id"), (F.col("l_suppkey") % 25).alias("label")).distinct()


@query()
def follow_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal mates of supplied parts join their bins until none does."""
    return ensemble.follow_pairs(supplied(spark, sf_dir), ensemble.reciprocal(ensemble.mates(mates(spark, sf_dir), 1.01)))


@query(f"WITH {SOLD}, n AS (SELECT label, count(*) AS n FROM sold GROUP BY 1), c AS (SELECT x.label AS a, y.label AS b, count(*) AS common FROM sold x JOIN sold y ON x.contig_id = y.contig_id AND x.label < y.label GROUP BY ALL) SELECT a, b, common, round(common / least(p.n, q.n), 6) AS share FROM c JOIN n p ON p.label = a JOIN n q ON q.label = b WHERE common / least(p.n, q.n) >= 0.3")
def bin_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.bin_overlap(sold(spark, sf_dir), 0.3).withColumn("share", F.round("share", 6))


@query(f"WITH {SOLD}, {PARTS}, t AS (SELECT label, sum(size) AS bases FROM sold JOIN parts USING (contig_id) GROUP BY 1), k AS (SELECT contig_id, label, size FROM sold JOIN t USING (label) JOIN parts USING (contig_id) QUALIFY row_number() OVER (PARTITION BY contig_id ORDER BY bases DESC, label) = 1) SELECT contig_id, label FROM k QUALIFY sum(size) OVER (PARTITION BY label) >= 5000")
def first_come(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.first_come(sold(spark, sf_dir), parts(spark, sf_dir), 5000)


@query(f"WITH {MEMBERS}, {PARTS} SELECT label, sum(size)::BIGINT AS bases, count(*) AS members, row_number() OVER (ORDER BY sum(size) DESC, label) AS bin_id FROM members JOIN parts USING (contig_id) GROUP BY label")
def bin_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.bin_totals(supplied(spark, sf_dir), parts(spark, sf_dir)).withColumn("bin_id", F.col("bin_id").cast("long"))


@query(f"WITH {MEMBERS}, {PARTS}, k AS (SELECT contig_id, size, CASE WHEN size >= 800 THEN 'large' ELSE 'small' END AS size_class FROM parts) SELECT size_class, count(*) AS contigs, count(m.contig_id) AS binned, sum(size)::BIGINT AS bases, coalesce(sum(size) FILTER (m.contig_id IS NOT NULL), 0)::BIGINT AS binned_bases, round(100 * coalesce(sum(size) FILTER (m.contig_id IS NOT NULL), 0) / sum(size), 6) AS percent FROM k LEFT JOIN members m USING (contig_id) GROUP BY size_class")
def binned_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir).withColumn("size_class", F.when(F.col("size") >= 800, "large").otherwise("small"))
    return clustering.binned_share(supplied(spark, sf_dir), rows).withColumn("percent", F.round("percent", 6))


@query(f"WITH {MEMBERS}, {PARTS} SELECT contig_id, label FROM members JOIN parts USING (contig_id) QUALIFY sum(size) OVER (PARTITION BY label) >= 20000")
def large_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.large_bins(supplied(spark, sf_dir), parts(spark, sf_dir), 20000)


@query(f"WITH {MEMBERS}, {PARTS} SELECT contig_id, size FROM parts WHERE contig_id NOT IN (SELECT contig_id FROM members)")
def unbinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).join(supplied(spark, sf_dir), "contig_id", "left_anti")


@query(f"WITH {MEMBERS}, {PARTS} SELECT contig_id, label FROM members UNION ALL SELECT contig_id, contig_id FROM parts WHERE size >= 900 AND contig_id NOT IN (SELECT contig_id FROM members)")
def rescue_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.rescue_singletons(supplied(spark, sf_dir), parts(spark, sf_dir), 900)


@query(f"WITH {PARTS} SELECT contig_id, round(least(0.99, (92 + 3.5 * (log10(size * 100) - 3)) / 100), 9) AS cutoff FROM parts")
def correlation_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("contig_id", F.round(statistics.correlation_cutoff(F.col("size") * 100, 92), 9).alias("cutoff"))


@query(f"WITH {CONTIGS} SELECT contig_id, md5(CASE WHEN seq = '' THEN '' ELSE regexp_replace(regexp_replace(s, '(.{{60}})', '\\1\n', 'g'), '\n$', '') || '\n' END) AS wrapped_md5 FROM (SELECT contig_id, seq, regexp_replace(seq, '[\\r\\n]', '', 'g') AS s FROM contigs)")
def fasta_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contigs(spark, sf_dir).select("contig_id", F.md5(sinks.wrap(F.regexp_replace("seq", r"[\r\n]", ""))).alias("wrapped_md5"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type")
def timing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))


@query("""WITH a AS (SELECT l_suppkey % 10 AS f, md5(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey)) AS h FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag <> 'A') GROUP BY 1),
b AS (SELECT l_suppkey % 10 AS f, md5(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey)) AS h FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag <> 'N' OR l_suppkey % 2 = 0) GROUP BY 1)
SELECT count(*) AS files, count(*) FILTER (a.h = b.h) AS equal, round(100 * count(*) FILTER (a.h = b.h) / count(*), 6) AS percent FROM a FULL JOIN b USING (f)""")
def bin_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of equal bins of two runs, by the md5 of their sorted members."""
    item = table(spark, sf_dir, "lineitem")

    def digests(rows: DataFrame, name: str) -> DataFrame:
        by = rows.select("l_suppkey", "l_partkey").distinct().groupBy((F.col("l_suppkey") % 10).alias("f"))
        return by.agg(F.md5(F.array_join(F.array_sort(F.collect_list("l_partkey")), ",")).alias(name))

    both = digests(item.where("l_returnflag <> 'A'"), "a").join(digests(item.where("l_returnflag <> 'N' OR l_suppkey % 2 = 0"), "b"), "f", "full")
    return both.agg(F.count("*").alias("files"), F.count_if(F.col("a") == F.col("b")).alias("equal")).withColumn("percent", F.round(100 * F.col("equal") / F.col("files"), 6))


def _depth_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth(spark, sf_dir).withColumn("contig_id", F.col("contig_id").cast("long"))


@query(f"""WITH {DEPTH}, {EDGES}, {ENDS}, {OVERLAP}, ab AS (SELECT src, dst, any_value(w) AS tnf, avg(1 - dd) AS abd, count(dd) AS nnz FROM dist GROUP BY src, dst HAVING count(dd) > 0),
cr AS (SELECT src, dst, round(coalesce(CASE WHEN isnan(c) THEN NULL ELSE c END, -1), 9) AS cor FROM (SELECT src, dst, corr(m1, m2) AS c FROM ends GROUP BY src, dst)),
sorted AS (SELECT abd AS y, row_number() OVER (ORDER BY abd) AS r FROM ab),
placed AS (SELECT ab.*, rank() OVER (ORDER BY tnf) AS rt, count(*) OVER (ORDER BY cor RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rc FROM ab JOIN cr USING (src, dst))
SELECT src, dst, round(sqrt(abd ** (1 - 1 / (1 + nnz)) * t.y ** (1 / (1 + nnz)) * c.y), 6) AS s FROM placed JOIN sorted t ON t.r = rt JOIN sorted c ON c.r = rc""")
def rescored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = neighbours(spark, sf_dir).select("src", "dst", F.col("w").alias("s_tnf"))
    return scoring.rescored(edges, depth(spark, sf_dir), 3).select("src", "dst", F.round("s", 6).alias("s"))


@query()
def label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.cluster(neighbours(spark, sf_dir).select("src", "dst", F.col("w").alias("s")), 95, 60)


DENSE = "dense AS (SELECT contig_id, sample_id, coalesce(mean, 0) AS mean FROM (SELECT DISTINCT contig_id FROM depth) CROSS JOIN (SELECT DISTINCT sample_id FROM depth) LEFT JOIN depth USING (contig_id, sample_id))"
SPEARMAN = f"{DENSE}, {RANKED.replace('FROM depth', 'FROM dense')}"


@query(f"""WITH {DEPTH}, {MEMBERS}, {PARTS}, {SPEARMAN},
big AS (SELECT label, contig_id, row_number() OVER (PARTITION BY label ORDER BY contig_id) AS place FROM members QUALIFY count(*) OVER (PARTITION BY label) >= 10),
lefts AS (SELECT contig_id FROM parts WHERE contig_id NOT IN (SELECT contig_id FROM members)),
ok AS (SELECT contig_id FROM ranked GROUP BY 1 HAVING var_pop(mean) > 0),
own AS (SELECT label, avg(c) AS own FROM (SELECT a.label, a.contig_id, b.contig_id, corr(x.mean, y.mean) AS c FROM big a JOIN big b ON a.label = b.label AND a.contig_id < b.contig_id JOIN ranked x ON x.contig_id = a.contig_id JOIN ranked y ON y.contig_id = b.contig_id AND y.sample_id = x.sample_id
  WHERE a.contig_id IN (SELECT * FROM ok) AND b.contig_id IN (SELECT * FROM ok) GROUP BY ALL) GROUP BY label),
tries AS (SELECT l.contig_id, b.label, b.place, corr(x.mean, y.mean) AS c FROM lefts l JOIN big b ON true JOIN ranked x ON x.contig_id = l.contig_id JOIN ranked y ON y.contig_id = b.contig_id AND y.sample_id = x.sample_id
  WHERE l.contig_id IN (SELECT * FROM ok) AND b.contig_id IN (SELECT * FROM ok) GROUP BY l.contig_id, b.label, b.contig_id, b.place),
fit AS (SELECT contig_id, label FROM (SELECT contig_id, label, avg(c) FILTER (place <= 10) AS first, avg(c) AS every FROM tries GROUP BY ALL) JOIN own USING (label) WHERE first >= own - 1e-9 AND every >= own - 1e-9 QUALIFY count(*) OVER (PARTITION BY contig_id) = 1)
SELECT contig_id, label FROM fit WHERE (SELECT coalesce(sum(size), 0) FROM fit JOIN parts USING (contig_id)) < 0.5 * (SELECT sum(size) FROM parts)""")
def recruit_by_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, bins = parts(spark, sf_dir), supplied(spark, sf_dir)
    return clustering.recruit(rows.join(bins, "contig_id", "left_anti"), bins, rows, depth(spark, sf_dir), 0.5)


@query()
def bootstrap_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.bootstrap(neighbours(spark, sf_dir).transform(written), parts(spark, sf_dir), 20, 0.9, 0.9, seed_size=1000, depth=depth(spark, sf_dir))


@query()
def binning_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.bin_contigs(contigs(spark, sf_dir), _depth_of_documents(spark, sf_dir), BinningConfig(min_cls_size=20_000))


@query()
def binning_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.bin_ensemble(contigs(spark, sf_dir), _depth_of_documents(spark, sf_dir), mates(spark, sf_dir), BinningConfig(min_cls_size=20_000, min_samples=3))


@query("SELECT regexp_extract(concat_ws(' ', source, lang), '^[^ \t]*', 0) AS name, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.duplicate_names(contigs(spark, sf_dir).withColumn("name", readers.trim_name(F.col("name"))))


@query(f"WITH {DEPTH} SELECT contig_id, round(sum(mean), 6) AS total FROM depth GROUP BY contig_id HAVING sum(mean) >= 75")
def total_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depths.deep_enough(depth(spark, sf_dir), 75).select("contig_id", F.round("total", 6).alias("total"))


@query(f"WITH {DEPTH} SELECT contig_id, sample_id, round(mean, 6) AS mean, round(var, 6) AS var FROM depth")
def strict_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depths.strict(depth(spark, sf_dir)).select("contig_id", "sample_id", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


def _partial_sql(num: int, way: str) -> str:
    return f"""SELECT l_orderkey, l_linenumber, place, CASE WHEN place <= {num} THEN rank() OVER w ELSE 0 END AS rank_min, CASE WHEN place <= {num} THEN count(*) OVER (PARTITION BY l_orderkey, place <= {num} ORDER BY l_tax {way} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE 0 END AS rank_max
    FROM (SELECT l_orderkey, l_linenumber, l_tax, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_tax {way}, l_linenumber) AS place FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey, place <= {num} ORDER BY l_tax {way})"""


def _partial(spark: SparkSession, sf_dir: str, num: int, descending: bool) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax")
    return statistics.partial_ranks(rows, "l_tax", ["l_orderkey"], ["l_linenumber"], num, descending).select("l_orderkey", "l_linenumber", "place", F.col("rank_min").cast("long").alias("rank_min"), F.col("rank_max").cast("long").alias("rank_max"))


@query(_partial_sql(3, "ASC"))
def partial_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _partial(spark, sf_dir, 3, False)


@query(_partial_sql(1000, "DESC"))
def descending_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _partial(spark, sf_dir, 1000, True)


@query(f"WITH {EDGES}, p AS (SELECT src, dst FROM ways UNION SELECT src, src FROM ways) SELECT p.src, p.dst, round(CASE WHEN p.src = p.dst THEN 1 ELSE coalesce(e.w, 1 - f.d) END, 6) AS p FROM p LEFT JOIN (SELECT * FROM edges WHERE w >= 0.6) e ON e.src = least(p.src, p.dst) AND e.dst = greatest(p.src, p.dst) LEFT JOIN (SELECT src, dst, 1 - w / 2 AS d FROM edges) f ON f.src = least(p.src, p.dst) AND f.dst = greatest(p.src, p.dst)")
def pair_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = neighbours(spark, sf_dir).transform(written)  # asked for four times
    ways = ensemble.both_ways(e).select("src", "dst")
    pairs = ways.unionByName(ways.select("src", F.col("src").alias("dst")).distinct())
    out = ensemble.pair_probability(pairs, e.where("w >= 0.6"), e.select("src", "dst", (1 - F.col("w") / 2).alias("d")))
    return out.select("src", "dst", F.round("p", 6).alias("p"))


@query("SELECT l_suppkey AS contig_id, count(DISTINCT l_partkey % 7) AS runs FROM lineitem GROUP BY 1")
def runs_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.runs_binned(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("contig_id"), (F.col("l_partkey") % 7).alias("b")))


@query(f"WITH {MEMBERS}, {PARTS} SELECT contig_id, label FROM members JOIN parts USING (contig_id) QUALIFY sum(size) OVER (PARTITION BY label) >= least(10000 * 4, 60000)")
def dissolved_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.dissolve(supplied(spark, sf_dir), parts(spark, sf_dir), 2, 60_000)


MEDOIDS = "sums AS (SELECT m.contig_id, m.label, coalesce(round(sum(w) FILTER (o.label = m.label), 9), 0) AS w FROM members m LEFT JOIN ways ON src = m.contig_id LEFT JOIN members o ON o.contig_id = dst GROUP BY ALL), medoids AS (SELECT label, contig_id FROM sums QUALIFY row_number() OVER (PARTITION BY label ORDER BY w DESC, contig_id) = 1)"


@query(f"WITH {EDGES}, {MEMBERS}, {MEDOIDS} SELECT label, contig_id FROM medoids")
def bin_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.medoids(neighbours(spark, sf_dir), supplied(spark, sf_dir))


@query(f"""WITH {DEPTH}, {EDGES}, {MEMBERS}, {PARTS}, {MEDOIDS}, {DENSE}, ok AS (SELECT contig_id FROM dense GROUP BY 1 HAVING var_pop(mean) > 1e-12),
met AS (SELECT l.contig_id, m.label, round(corr(x.mean, y.mean), 9) AS cor FROM parts l JOIN medoids m ON true JOIN dense x ON x.contig_id = l.contig_id JOIN dense y ON y.contig_id = m.contig_id AND y.sample_id = x.sample_id
  WHERE l.contig_id NOT IN (SELECT contig_id FROM members) AND l.contig_id IN (SELECT * FROM ok) AND m.contig_id IN (SELECT * FROM ok) GROUP BY ALL),
best AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY contig_id ORDER BY cor DESC, label) = 1)
SELECT contig_id, label, round(cor, 6) AS cor FROM best JOIN parts USING (contig_id) WHERE size * 100 >= 1000 AND cor > 0 AND cor >= 0.92 AND cor >= least(0.99, (92 + 3.5 * (log10(size * 100) - 3)) / 100)""")
def recruit_by_medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, bins = parts(spark, sf_dir).withColumn("size", F.col("size") * 100), supplied(spark, sf_dir)
    found = clustering.recruit_by_medoid(rows.join(bins, "contig_id", "left_anti"), ensemble.medoids(neighbours(spark, sf_dir), bins), rows, depth(spark, sf_dir), 92, 1000)
    return found.withColumn("cor", F.round("cor", 6))


@query()
def weighted_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.weighted_propagation(neighbours(spark, sf_dir).select("src", "dst", F.col("w").alias("s")))


@query()
def greedy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.greedy_merge(sold(spark, sf_dir).select("contig_id", (F.col("label") % 8).alias("label")), 0.5)
