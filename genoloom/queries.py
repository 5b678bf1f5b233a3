"""Queries over the driver's tables, one for each operator, and their SQL.

The tables hold no genomes, so each query puts an operator to rows of the same shape: suppliers stand for
samples, parts for families, users' events for genes along a contig, and DNA is made of MD5 digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from genoloom.functions import sequences as q
from genoloom.operators import annotate, families, genes, gfftools, hits, paralogs, report, similarity

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Presence of families in samples

_BRANDS = "SELECT concat(p_brand, p_type) AS family, l_suppkey AS sample FROM lineitem JOIN part ON l_partkey = p_partkey"


def _members(spark, sf, by_part: bool = False) -> DataFrame:
    li = _t(spark, sf, "lineitem").select("l_partkey", F.col("l_suppkey").cast("string").alias("sample_id"))
    if by_part:
        return li.withColumn("family", F.col("l_partkey").cast("string"))
    part = _t(spark, sf, "part").select("p_partkey", F.concat("p_brand", "p_type").alias("family"))
    return li.join(part, li["l_partkey"] == part["p_partkey"]).select("family", "sample_id")


def _summary_sql(members: str) -> str:
    return f"""
WITH m AS ({members}), n AS (SELECT count(*)::DOUBLE AS n FROM supplier),
s AS (SELECT family, count(DISTINCT sample) / (SELECT n FROM n) AS share FROM m GROUP BY family),
c AS (SELECT CASE WHEN share >= 0.99 THEN 'core' WHEN share >= 0.95 THEN 'soft_core' WHEN share >= 0.15 THEN 'shell' ELSE 'cloud' END AS class FROM s),
k AS (SELECT unnest(['core', 'soft_core', 'shell', 'cloud']) AS class)
SELECT k.class, count(c.class)::BIGINT AS n FROM k LEFT JOIN c ON k.class = c.class GROUP BY k.class
UNION ALL SELECT 'total', count(*)::BIGINT FROM c"""


@query(_summary_sql(_BRANDS))
def summary_core_shell(spark, sf):
    """Core, soft-core, shell and cloud families."""
    return report.summary(report.family_stats(_members(spark, sf)), _t(spark, sf, "supplier").count())


@query(_summary_sql("SELECT l_partkey AS family, l_suppkey AS sample FROM lineitem"))
def summary_by_part(spark, sf):
    return report.summary(report.family_stats(_members(spark, sf, True)), _t(spark, sf, "supplier").count())


@query("SELECT l_partkey::VARCHAR AS family, l_suppkey::VARCHAR AS sample_id, count(*)::BIGINT AS n, string_agg(l_orderkey, ' ' ORDER BY l_orderkey) AS genes FROM lineitem GROUP BY ALL")
def presence_absence_long(spark, sf):
    t = _t(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("family"), F.col("l_suppkey").cast("string").alias("sample_id"), F.col("l_orderkey").alias("ord"), F.col("l_orderkey").cast("string").alias("gene_id"))
    return report.presence(t).select("family", "sample_id", "n", F.array_join("gene_ids", " ").alias("genes"))


@query("SELECT p_brand AS family, " + ", ".join(f"count(*) FILTER (WHERE s_nationkey = {n})::BIGINT AS n{n}" for n in range(25)) + " FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY p_brand")
def rtab_pivot(spark, sf):
    """The count matrix, a column a sample."""
    li, part, s = _t(spark, sf, "lineitem"), _t(spark, sf, "part"), _t(spark, sf, "supplier")
    by_supplier = li.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("c"))
    t = by_supplier.join(part, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    long = t.groupBy(F.col("p_brand").alias("family"), F.concat(F.lit("n"), "s_nationkey").alias("sample_id")).agg(F.sum("c").alias("n"))
    return report.pivoted(long, [f"n{n}" for n in range(25)])


@query(f"SELECT family, count(DISTINCT sample)::BIGINT AS n_isolates, count(*)::BIGINT AS n_sequences, count(*)::DOUBLE / count(DISTINCT sample) AS avg_per_isolate FROM ({_BRANDS}) GROUP BY family")
def family_stats(spark, sf):
    return report.family_stats(_members(spark, sf))


@query("WITH m AS (SELECT p_partkey // 4 AS family, p_partkey % 4 AS sample FROM part WHERE p_size % 9 > 0 UNION ALL SELECT p_partkey // 4, p_partkey % 4 FROM part WHERE p_size % 11 = 1) SELECT family FROM m GROUP BY family HAVING count(DISTINCT sample) = 4 AND count(*) = 4")
def single_copy_core(spark, sf):
    """Families with one gene of each of four samples; some lack a sample, some have a second gene of one."""
    p = _t(spark, sf, "part").select(F.floor(F.col("p_partkey") / 4).alias("family"), (F.col("p_partkey") % 4).alias("sample_id"), "p_size")
    return report.single_copy_core(p.filter("p_size % 9 > 0").unionByName(p.filter("p_size % 11 = 1")), 4)


@query("SELECT l_partkey AS family, count(*)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING count(*) >= greatest(2, floor((SELECT count(*) FROM supplier) * 0.3))")
def large_families(spark, sf):
    t = _t(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("family")).agg(F.collect_list("l_orderkey").alias("gene_ids"))
    return report.large_families(t, _t(spark, sf, "supplier").count(), 0.3).select("family", F.size("gene_ids").cast("long").alias("n"))


# Descriptions of families: orders are genes of their customers' families

def _annotated(spark, sf):
    o = _t(spark, sf, "orders")
    gene = F.concat(F.lit("s-c-"), "o_orderkey")
    membership = o.select(F.col("o_custkey").alias("cluster_idx"), F.col("o_orderkey").alias("member_ord"), gene.alias("gene_id"))
    name = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.substring("o_orderpriority", 3, 4), F.lit("_"), F.substring("o_orderstatus", 1, 1)))
    annotation = o.select(F.col("o_orderkey").alias("ann_ord"), gene.alias("gene_id"), F.floor("o_totalprice").cast("int").alias("length"), name.alias("gene_name"), F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderpriority")).alias("gene_product"))
    return annotate.described(membership, annotation)


_GENES = "SELECT o_custkey AS family, o_orderkey AS k, floor(o_totalprice)::INT AS len, CASE WHEN o_orderstatus = 'P' THEN '' ELSE substr(o_orderpriority, 3, 4) || '_' || substr(o_orderstatus, 1, 1) END AS name, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END AS product FROM orders"
_MODE = f"g AS ({_GENES}), c AS (SELECT family, name, count(*) AS n, min(k) AS first FROM g WHERE name <> '' GROUP BY ALL), m AS (SELECT family, arg_max(name, (n, -first)) AS name FROM c GROUP BY family)"


@query(f"WITH {_MODE} SELECT f.family, coalesce(m.name, 'groups_' || f.family) AS base FROM (SELECT DISTINCT family FROM g) f LEFT JOIN m ON f.family = m.family")
def name_mode(spark, sf):
    return _annotated(spark, sf).select(F.col("cluster_idx").alias("family"), "base")


@query(f"SELECT family, 's-c-' || arg_max(k, (len, -k)) AS representative, min(len) AS min_length, max(len) AS max_length, avg(len) AS mean_length, count(*)::BIGINT AS size FROM ({_GENES}) GROUP BY family")
def representative(spark, sf):
    return _annotated(spark, sf).select(F.col("cluster_idx").alias("family"), "representative", "min_length", "max_length", "mean_length", "size")


@query(f"SELECT family, coalesce(string_agg(DISTINCT product, ', ' ORDER BY product) FILTER (WHERE product <> ''), 'unknown') AS product FROM ({_GENES}) GROUP BY family")
def products_joined(spark, sf):
    return _annotated(spark, sf).select(F.col("cluster_idx").alias("family"), "product")


@query(f"WITH {_MODE}, b AS (SELECT f.family, coalesce(m.name, 'groups_' || f.family) AS base FROM (SELECT DISTINCT family FROM g) f LEFT JOIN m ON f.family = m.family), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY family) AS k FROM b), s AS (SELECT *, sum((k > 1)::INT) OVER (ORDER BY family) AS n FROM r) SELECT family, CASE WHEN k > 1 THEN base || '_' || lpad(n::VARCHAR, 5, '0') ELSE base END AS name FROM s")
def family_naming(spark, sf):
    return annotate.named(_annotated(spark, sf)).select(F.col("cluster_idx").alias("family"), "name")


@query(f"SELECT family, arg_max('s-c-' || k, (len, -k)) AS rep FROM ({_GENES}) GROUP BY family")
def raw_representatives(spark, sf):
    o = _t(spark, sf, "orders")
    g = F.concat(F.lit("s-c-"), "o_orderkey")
    return report.representatives(o.select(F.col("o_custkey").alias("cluster_idx"), g.alias("gene_id")), o.select(g.alias("gene_id"), F.col("o_orderkey").alias("ann_ord"), F.floor("o_totalprice").cast("int").alias("length"))).select(F.col("cluster_idx").alias("family"), "rep")


# Genes: GFF lines made of parts, places made of events

def _features(spark, sf) -> DataFrame:
    p = _t(spark, sf, "part")
    attrs = F.concat(F.lit("note=x;ID="), F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("S1-"), "p_partkey")).otherwise(F.col("p_partkey").cast("string")), F.lit(";gene="), "p_name", F.lit(";product="), "p_type", F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit(";product="), "p_brand")).otherwise(F.lit("")))
    return p.select(
        F.lit("S1").alias("sample_id"), F.col("p_partkey").alias("line_no"), F.concat(F.lit("c-"), (F.floor(F.col("p_partkey") / 4) % 3).cast("string")).alias("seqid"), F.when(F.col("p_partkey") % 11 == 0, "gene").otherwise("CDS").alias("type"),
        (F.col("p_partkey") * 10).cast("int").alias("start"), (F.col("p_partkey") * 10 + F.col("p_size") * 9 + F.col("p_partkey") % 3).cast("int").alias("end"), F.when(F.col("p_size") % 2 == 0, "-").otherwise("+").alias("strand"),
        F.when(F.col("p_partkey") % 13 == 0, F.lit("note=x")).otherwise(attrs).alias("attrs"),
    )


_FEATURES = """f AS (SELECT p_partkey AS line_no, 'c_' || ((p_partkey // 4) % 3) AS seq_id, p_size * 9 + p_partkey % 3 + 1 AS length, CASE WHEN p_size % 2 = 0 THEN '-' ELSE '+' END AS strand, p_partkey % 11 <> 0 AS cds, p_partkey % 13 <> 0 AS has_id,
 'S1-c_' || ((p_partkey // 4) % 3) || '-' || p_partkey AS gene_id, regexp_replace(p_name, '\\W', '_', 'g') AS gene_name, CASE WHEN p_partkey % 7 = 0 THEN p_brand ELSE p_type END AS gene_product, p_partkey * 10 - 1 AS start0, p_partkey * 10 + p_size * 9 + p_partkey % 3 AS "end" FROM part),
c AS (SELECT * FROM f WHERE cds AND length >= 120 AND length % 3 = 0),
r AS (SELECT *, sum(ch) OVER (ORDER BY line_no) AS run FROM (SELECT *, CASE WHEN seq_id = lag(seq_id) OVER (ORDER BY line_no) THEN 0 ELSE 1 END AS ch FROM c)),
g AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY line_no) - 1 AS gene_index, row_number() OVER (PARTITION BY seq_id ORDER BY line_no) - 1 AS pos FROM r WHERE has_id)"""


@query(f"WITH {_FEATURES} SELECT line_no::BIGINT AS line_no, gene_id, seq_id, start0::INT AS start0, \"end\"::INT AS \"end\", length::INT AS length, strand, gene_name, gene_product, gene_index::INT AS gene_index, pos::INT AS pos FROM g")
def gff_genes(spark, sf):
    """Coding features with ids, attributes, run index and place."""
    return genes.genes(_features(spark, sf)).drop("sample_id")


@query(f"WITH {_FEATURES} SELECT line_no::BIGINT AS line_no, length::INT AS length, seq_id FROM c")
def gff_filters(spark, sf):
    return genes.coding(_features(spark, sf)).select("line_no", "length", "seq_id")


@query("SELECT event_id, sum(ch) OVER (PARTITION BY user_id ORDER BY ts)::BIGINT AS run FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) THEN 0 ELSE 1 END AS ch FROM events)")
def run_index(spark, sf):
    t = _t(spark, sf, "events").select("event_id", F.col("user_id").alias("sample_id"), F.col("ts").alias("line_no"), F.col("event_type").alias("seq_id"))
    return genes.with_runs(t).select("event_id", "run")


@query("SELECT event_id, sum(ch) OVER (PARTITION BY user_id ORDER BY ts)::BIGINT AS locus FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER w AND (value > 50) = (lag(value) OVER w > 50) THEN 0 ELSE 1 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))")
def locus_counter(spark, sf):
    t = _t(spark, sf, "events").select("event_id", F.col("user_id").alias("sample_id"), F.col("ts").alias("line_no"), F.col("event_type").alias("seqid"), (F.col("value") > 50).alias("start"), F.lit(0).alias("end"))
    return gfftools.locus(t).select("event_id", "locus")


@query("WITH n AS (SELECT event_id, event_type = 'click' AS cds, 'ID=' || user_id || '_' || lpad((sum((event_type = 'click')::INT) OVER (PARTITION BY user_id ORDER BY ts))::VARCHAR, 5, '0') AS id FROM events) SELECT event_id, CASE event_id % 3 WHEN 0 THEN CASE WHEN cds THEN id ELSE 'ID=' || event_id END || ';a=1' WHEN 1 THEN 'a=1;' || CASE WHEN cds THEN id ELSE 'ID=' || event_id END || ';b=2' ELSE 'a=1' || CASE WHEN cds THEN ';' || id ELSE '' END END AS attrs FROM n")
def gff_renumber(spark, sf):
    """Ids first, later, or missing."""
    own = F.concat(F.lit("ID="), F.col("event_id").cast("string"))
    attrs = F.when(F.col("event_id") % 3 == 0, F.concat(own, F.lit(";a=1"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("a=1;"), own, F.lit(";b=2"))).otherwise("a=1")
    t = _t(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("sample_id"), F.col("ts").alias("line_no"), F.when(F.col("event_type") == "click", "CDS").otherwise("x").alias("type"), attrs.alias("attrs"))
    return gfftools.renumbered(t).select("event_id", "attrs")


@query("SELECT event_id, concat_ws(',', list_reduce(list_prepend('', list(event_id::VARCHAR) OVER a), lambda x, y: x || ' ' || y), list_reduce(list_prepend('', list(event_id::VARCHAR) OVER b), lambda x, y: x || ' ' || y)) AS around FROM events WINDOW a AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)")
def neighbourhood5(spark, sf):
    """Up to five genes before and five after on a contig."""
    t = _t(spark, sf, "events").select(F.lit("s").alias("sample_id"), F.col("user_id").alias("seq_id"), F.col("ts").alias("pos"), F.col("event_id").cast("string").alias("gene_id"), "ts")
    n = genes.neighbours(t)
    w = Window.partitionBy("seq_id").orderBy("pos")
    n = n.withColumn("k", F.least(F.row_number().over(w) - 1, F.lit(5)))
    side = lambda a: F.concat(F.when(F.size(a) > 0, F.lit(" ")).otherwise(F.lit("")), F.array_join(a, " "))
    before, after = F.slice("neighbours", F.lit(1), F.col("k")), F.slice("neighbours", F.col("k") + 1, F.lit(5))
    return n.select(F.col("gene_id").cast("long").alias("event_id"), F.concat(side(before), F.lit(","), side(after)).alias("around"))


# Paralogs: orders of a priority are a family, customers are samples

_FAMILY = "SELECT o_custkey % 50 AS c, o_orderpriority AS p, o_orderkey AS k, o_custkey % 7 AS s FROM orders"


def _paralog_members(spark, sf):
    o = _t(spark, sf, "orders")
    return o.select((F.col("o_custkey") % 50).alias("cluster_idx"), F.col("o_orderkey").alias("member_ord"), F.concat((F.col("o_custkey") % 7).cast("string"), F.lit("-c-"), "o_orderkey").alias("gene_id"))


@query(f"WITH f AS ({_FAMILY}), n AS (SELECT c, s, count(*) AS n, min(k) AS first FROM f GROUP BY ALL), b AS (SELECT c, arg_min(s, (n, first)) AS s FROM n WHERE n > 1 GROUP BY c) SELECT f.c AS cluster_idx, (row_number() OVER (PARTITION BY f.c ORDER BY k) - 1)::INT AS paralog, f.s || '-c-' || k AS gene_id FROM f JOIN b ON f.c = b.c AND f.s = b.s")
def paralog_pick(spark, sf):
    return paralogs.paralogs(_paralog_members(spark, sf))


_SPLIT = """
WITH g AS (SELECT event_id AS k, (event_id % 40)::BIGINT AS c, user_id % 9 AS s, user_id % 9 || '-u-' || event_id AS gene, user_id, ts FROM events),
m AS (SELECT c, s, count(*) AS n, min(k) AS first FROM g GROUP BY ALL), b AS (SELECT c, arg_min(s, (n, first)) AS s FROM m WHERE n > 1 GROUP BY c),
p AS (SELECT g.c, row_number() OVER (PARTITION BY g.c ORDER BY k) - 1 AS p, gene FROM g JOIN b ON g.c = b.c AND g.s = b.s),
o AS (SELECT gene, c, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS pos FROM g),
nb AS (SELECT a.gene, a.c, z.c AS nc FROM o a JOIN o z ON a.user_id = z.user_id AND z.pos <> a.pos AND z.pos BETWEEN a.pos - 5 AND a.pos + 5),
seen AS (SELECT DISTINCT p.c, p.p, nb.nc FROM p JOIN nb ON p.gene = nb.gene),
oth AS (SELECT nb.* FROM nb WHERE gene NOT IN (SELECT gene FROM p)),
sc AS (SELECT oth.c, oth.gene, seen.p, count(*) AS n FROM oth JOIN seen ON oth.c = seen.c AND oth.nc = seen.nc GROUP BY ALL),
best AS (SELECT c, gene, arg_max(p, (n, -p)) AS p FROM sc GROUP BY ALL),
goes AS (SELECT c, gene, p FROM p UNION ALL SELECT c, gene, p FROM best)
SELECT g.c AS cluster_idx, coalesce(goes.p, 2147483647)::INT AS "group", g.gene AS gene_id FROM g LEFT JOIN goes ON g.gene = goes.gene WHERE g.c IN (SELECT c FROM p)
UNION ALL SELECT c, 0, gene FROM g WHERE c NOT IN (SELECT c FROM p)"""


@query(_SPLIT)
def paralog_split_round(spark, sf):
    """One round of splitting: paralogs, and others by the families around them."""
    e = _t(spark, sf, "events").withColumn("gene_id", F.concat((F.col("user_id") % 9).cast("string"), F.lit("-u-"), "event_id"))
    members = e.select((F.col("event_id") % 40).alias("cluster_idx"), F.col("event_id").alias("member_ord"), "gene_id")
    places = e.select(F.lit("s").alias("sample_id"), F.col("user_id").alias("seq_id"), F.col("ts").alias("pos"), "gene_id")
    return paralogs.split_round(members, paralogs.first_neighbours(places))[0].select("cluster_idx", "group", "gene_id")


# Sequence functions, on DNA made of digests

_DNA = "translate(md5('a' || o_orderkey) || md5('b' || o_orderkey), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _dna(spark, sf):
    o = _t(spark, sf, "orders")
    nt = F.translate(F.concat(F.md5(F.concat(F.lit("a"), "o_orderkey")), F.md5(F.concat(F.lit("b"), "o_orderkey"))), "0123456789abcdef", "ACGTACGTACGTACGT")
    return o.select("o_orderkey", nt.alias("nt"))


@query(f"SELECT o_orderkey, reverse(translate(substr({_DNA}, 4, 40), 'ACGT', 'TGCA')) AS rc FROM orders")
def revcomp(spark, sf):
    return _dna(spark, sf).select("o_orderkey", q.stranded(q.slice_bases(F.col("nt"), F.lit(3), F.lit(43)), F.lit("-")).alias("rc"))


_AA = f"(SELECT o_orderkey, nt, list_transform(range(0, 21), lambda i: substr('{q.code(11)}', (16 * (strpos('TCAG', substr(nt, 3 * i + 1, 1)) - 1) + 4 * (strpos('TCAG', substr(nt, 3 * i + 2, 1)) - 1) + strpos('TCAG', substr(nt, 3 * i + 3, 1)))::BIGINT, 1)) AS aa FROM (SELECT o_orderkey, {_DNA} AS nt FROM orders))"


@query(f"SELECT o_orderkey, replace(list_reduce(aa, lambda x, y: x || y), '*', '') AS aa FROM {_AA}")
def translate_cds(spark, sf):
    return _dna(spark, sf).select("o_orderkey", q.translate_cds(F.col("nt"), 11).alias("aa"))


# Alignments of a dozen columns with gaps where a digest has its first digits
_ALIGNED = "translate(substr(md5('g' || o_orderkey), 1, 12), '0123456789abcdef', '----MKLMKLMKLMKL')"
_CODONS = f"(SELECT o_orderkey, o_custkey, list_reduce(list_prepend('', list_transform(range(1, 13), lambda i: CASE WHEN substr(p, i, 1) = '-' THEN '---' ELSE substr(nt, (3 * length(replace(substr(p, 1, i - 1), '-', '')) + 1)::BIGINT, 3) END)), lambda x, y: x || y) AS codons FROM (SELECT o_orderkey, o_custkey, {_ALIGNED} AS p, {_DNA} AS nt FROM orders))"


def _aligned():
    return F.translate(F.substring(F.md5(F.concat(F.lit("g"), "o_orderkey")), 1, 12), "0123456789abcdef", "----MKLMKLMKLMKL")


@query(f"SELECT o_orderkey, codons FROM {_CODONS}")
def back_translate(spark, sf):
    return _dna(spark, sf).select("o_orderkey", q.back_translate(_aligned(), F.col("nt")).alias("codons"))


def _codons(spark, sf):
    from genoloom.operators import msa

    nt = _dna(spark, sf).withColumn("gene_id", F.concat((F.col("o_orderkey") % 4).cast("string"), F.lit("-c-"), "o_orderkey"))
    proteins = nt.select(F.concat(F.lit("f"), F.floor(F.col("o_orderkey") / 4).cast("string")).alias("family"), "gene_id", _aligned().alias("aligned"))
    return msa.codon_alignments(proteins, nt)


@query(f"SELECT 'f' || (o_orderkey // 4) AS family, (o_orderkey % 4) || '-c-' || o_orderkey AS gene_id, codons AS aligned FROM {_CODONS}")
def codon_alignment(spark, sf):
    """Protein alignments of families in codons."""
    return _codons(spark, sf)


@query(f"WITH c AS (SELECT o_orderkey // 4 AS f, o_orderkey % 4 AS s, codons FROM {_CODONS}), k AS (SELECT f FROM c GROUP BY f HAVING count(*) = 4 AND count(DISTINCT s) = 4) SELECT x.s AS sample_ord, x.s::VARCHAR AS sample_id, coalesce(string_agg(codons, '' ORDER BY c.f), '') AS aligned FROM (SELECT unnest(range(0, 4)) AS s) x LEFT JOIN (SELECT * FROM c WHERE f IN (SELECT f FROM k)) c ON x.s = c.s GROUP BY x.s")
def core_alignment(spark, sf):
    """Alignments of the single-copy core, one after the other for each sample."""
    from genoloom.operators import msa

    t = _codons(spark, sf).withColumn("family_ord", F.substring("family", 2, 20).cast("long"))
    samples = spark.range(4).select(F.col("id").alias("sample_ord"), F.col("id").cast("string").alias("sample_id"))
    return msa.core_alignment(t.drop("family_ord"), t.select("family", "family_ord").distinct(), samples)


@query("SELECT o_orderkey, 'S' || o_custkey AS sample_id, 'c' || (o_orderkey % 9) AS seq_id FROM orders")
def sequence_ids(spark, sf):
    ids = q.seq_ids(F.concat(F.lit("S"), "o_custkey", F.lit("-c"), (F.col("o_orderkey") % 9).cast("string"), F.lit("-tag-"), "o_orderkey"))
    return _t(spark, sf, "orders").select("o_orderkey", ids.alias("i")).select("o_orderkey", "i.*")


@query("SELECT p_partkey, regexp_replace(p_name, '\\W', '_', 'g') AS name, 'S1-c_1-' || CASE WHEN p_partkey % 3 = 2 THEN 'x-' ELSE '' END || p_partkey AS gene_id FROM part")
def gene_names_and_ids(spark, sf):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("S1-c_1-"), "p_partkey")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("S1-"), "p_partkey")).otherwise(F.concat(F.lit("x-"), "p_partkey"))
    return _t(spark, sf, "part").select("p_partkey", q.clean_name(F.col("p_name")).alias("name"), q.canonical_gene_id(raw, F.lit("S1"), q.no_dash(F.lit("c-1"))).alias("gene_id"))


# Hits, clusters, families

_HITS = "SELECT l_orderkey::VARCHAR AS qseqid, l_partkey || '_' || l_linenumber AS sseqid, 50 + l_quantity AS pident, (l_suppkey % 90 + 10)::INT AS length, (l_partkey % 80 + 60)::INT AS qlen, (l_orderkey % 80 + 60)::INT AS slen, l_extendedprice AS bitscore, l_discount AS evalue, l_linenumber AS qstart, l_suppkey::INT AS sstart FROM lineitem"


def _hits(spark, sf):
    return _t(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("qseqid"), F.concat("l_partkey", F.lit("_"), "l_linenumber").alias("sseqid"), (50 + F.col("l_quantity")).alias("pident"), (F.col("l_suppkey") % 90 + 10).cast("int").alias("length"),
        (F.col("l_partkey") % 80 + 60).cast("int").alias("qlen"), (F.col("l_orderkey") % 80 + 60).cast("int").alias("slen"), F.col("l_extendedprice").alias("bitscore"), F.col("l_discount").alias("evalue"), F.col("l_linenumber").alias("qstart"), F.col("l_suppkey").cast("int").alias("sstart"),
    )


@query(f"SELECT qseqid, sseqid, pident, length, qlen, slen FROM ({_HITS}) WHERE pident / 100.0::DOUBLE > 0.7::DOUBLE AND least(qlen, slen)::DOUBLE / greatest(qlen, slen) > 0.7::DOUBLE AND length / least(qlen, slen)::DOUBLE > 0.2::DOUBLE AND length / greatest(qlen, slen)::DOUBLE > 0.3::DOUBLE")
def hit_filter(spark, sf):
    return hits.filtered(_hits(spark, sf), 0.7, 0.7, 0.2, 0.3).select("qseqid", "sseqid", "pident", "length", "qlen", "slen")


@query(f"SELECT qseqid, sseqid, bitscore FROM ({_HITS}) QUALIFY row_number() OVER (PARTITION BY qseqid ORDER BY bitscore DESC, evalue, sseqid, qstart, sstart) <= 2")
def topk_hits(spark, sf):
    """The best targets of each query; the limit is the operator."""
    return hits.best_targets(_hits(spark, sf), 2).select("qseqid", "sseqid", "bitscore")


def _dedup(spark, sf):
    """Orders of a customer and date are copies; the first is the representative."""
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderkey", F.concat("o_orderpriority", (F.col("o_custkey") % 97).cast("string")).alias("k"))
    reps = o.groupBy("k").agg(F.min("o_orderkey").alias("rep"), F.count("*").alias("n"))
    t = o.join(reps, "k")
    members = t.filter("o_orderkey <> rep").select(F.col("rep").cast("string").alias("rep_id"), F.col("id").alias("member_id"), F.col("o_orderkey").alias("member_ord"))
    alone = t.filter("n = 1").select(F.col("rep").cast("string").alias("rep_id"), F.lit(None).cast("string").alias("member_id"), F.lit(None).cast("long").alias("member_ord"))
    return members.unionByName(alone)


_DEDUP = "d AS (SELECT o_orderkey AS k, min(o_orderkey) OVER (PARTITION BY o_orderpriority, o_custkey % 97) AS rep FROM orders), m AS (SELECT DISTINCT rep, rep % 100 AS mcl FROM d WHERE rep % 3 > 0)"


@query(f"WITH {_DEDUP}, h AS (SELECT mcl AS a, rep, row_number() OVER (PARTITION BY mcl ORDER BY rep) AS o FROM m UNION ALL SELECT DISTINCT NULL, rep, 1 FROM d WHERE rep % 3 = 0), i AS (SELECT *, dense_rank() OVER (ORDER BY a IS NULL, a, CASE WHEN a IS NULL THEN rep::VARCHAR END) - 1 AS c FROM h) SELECT c::BIGINT AS cluster_idx, (row_number() OVER (PARTITION BY c ORDER BY o, d.k <> d.rep, d.k) - 1)::BIGINT AS member_ord, d.k::VARCHAR AS gene_id FROM i JOIN d ON i.rep = d.rep")
def reinflate(spark, sf):
    """Clusters of representatives with all their members, and families of those that no cluster has."""
    d = _dedup(spark, sf)
    rep = d.select(F.col("rep_id").cast("long").alias("r")).distinct().filter("r % 3 > 0")
    mcl = rep.select((F.col("r") % 100).alias("mcl_ord"), F.col("r").cast("string").alias("gene_id"), F.col("r").alias("ord"))
    return families.reinflated(mcl, d)


@query("WITH p AS (SELECT p_brand, p_partkey AS k, min(p_partkey) OVER (PARTITION BY p_brand, p_size % 9) AS rep, count(*) OVER (PARTITION BY p_brand, p_size % 9) AS n, row_number() OVER (PARTITION BY p_brand, p_size % 9 ORDER BY p_partkey) AS ord FROM part) SELECT 'g' || rep AS rep_id, CASE WHEN n > 1 THEN 'g' || k END AS member_id, CASE WHEN n > 1 THEN ord::INT END AS member_ord FROM p WHERE n = 1 OR k <> rep")
def foreign_clusters(spark, sf):
    """Another tool's clusters, written a file a task, and read."""
    from genoloom.sources import tables

    at = _folder(spark, "clstr")
    p = _t(spark, sf, "part").groupBy("p_brand", (F.col("p_size") % 9).alias("k")).agg(F.array_sort(F.collect_list("p_partkey")).alias("ids"))
    lines = F.transform("ids", lambda x, i: F.concat(i.cast("string"), F.lit("\t90aa, >g"), x.cast("string"), F.when(i == 0, "... *").otherwise("... at 99.00%")))
    p.select(F.concat(F.lit(">Cluster 0\n"), F.array_join(lines, "\n")).alias("value")).write.text(at)
    return tables.clusters_clstr(spark, at)


@query("SELECT 's' || s_nationkey AS sample_id, 'c' || s_suppkey % 4 AS seq_id, (row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 4 ORDER BY s_suppkey) - 1)::INT AS pos, 'g' || s_suppkey AS gene_id FROM supplier")
def saved_positions(spark, sf):
    """Genes along contigs, exported and read back."""
    from genoloom.sources import export, tables

    at, s = _folder(spark, "positions"), _t(spark, sf, "supplier")
    t = s.select(F.concat(F.lit("s"), "s_nationkey").alias("sample_id"), F.concat(F.lit("c"), F.col("s_suppkey") % 4).alias("seq_id"), F.col("s_suppkey").alias("pos"), F.concat(F.lit("g"), "s_suppkey").alias("gene_id"))
    export.write_lines(export.position_lines(t), f"{at}/gene_position.csv")
    return tables.positions_csv(spark, f"{at}/gene_position.csv")


@query("SELECT 'g' || s_suppkey AS gene_id, 's' || s_nationkey AS sample_id, 'c' AS seq_id, (s_suppkey * 3)::INT AS length, coalesce(s_name, '') AS gene_name, 'p, ' || s_nationkey AS gene_product, (s_suppkey % 9)::INT AS gene_index, '+' AS strand FROM supplier")
def saved_annotation(spark, sf):
    """Annotation of genes, exported in tab-separated lines and read back; products keep their commas."""
    from genoloom.sources import export, tables

    at, s = _folder(spark, "annotation"), _t(spark, sf, "supplier")
    t = s.select(F.col("s_suppkey").alias("ann_ord"), F.concat(F.lit("g"), "s_suppkey").alias("gene_id"), F.concat(F.lit("s"), "s_nationkey").alias("sample_id"), F.lit("c").alias("seq_id"), (F.col("s_suppkey") * 3).alias("length"), F.col("s_name").alias("gene_name"), F.concat(F.lit("p, "), "s_nationkey").alias("gene_product"), (F.col("s_suppkey") % 9).alias("gene_index"), F.lit("+").alias("strand"))
    export.write_lines(export.annotation_lines(t, "\t", False), f"{at}/gene_annotation.tsv")
    return tables.annotation_tsv(spark, f"{at}/gene_annotation.tsv")


@query("WITH s AS (SELECT s_suppkey AS k, 's' || s_nationkey AS sample, 's' || s_nationkey || '-c-' || s_suppkey AS gene, 5 - s_suppkey % 6 AS f FROM supplier), n AS (SELECT f, row_number() OVER (ORDER BY f) AS no FROM (SELECT DISTINCT f FROM s)) SELECT sample AS sample_id, k AS line_no, CASE WHEN k % 4 = 0 THEN 'ID=other' || k ELSE 'ID=' || gene || ';pangenome_id=' || no END AS attrs FROM s JOIN n USING (f)")
def tagged_by_matrix(spark, sf):
    """A presence/absence matrix, written and read back, tags the features of its genes."""
    from genoloom.sources import export, tables

    at, s = _folder(spark, "matrix"), _t(spark, sf, "supplier")
    sample = F.concat(F.lit("s"), "s_nationkey")
    s = s.select("s_suppkey", sample.alias("sample_id"), F.concat(sample, F.lit("-c-"), "s_suppkey").alias("gene"), (5 - F.col("s_suppkey") % 6).alias("f"))
    families_ = s.groupBy("f").agg(F.sort_array(F.collect_list("gene")).alias("gene_ids"), F.count("*").alias("size"))
    figures = [F.lit(x).alias(c) for c, x in (("product", 'a "quoted", product'), ("representative", ""), ("min_length", 1), ("max_length", 1), ("mean_length", 1.0))]
    families_ = families_.select(F.col("f").alias("family_ord"), F.concat(F.lit("n"), "f").alias("name"), "gene_ids", *figures, "size")
    names = [r[0] for r in s.select("sample_id").distinct().orderBy("sample_id").collect()]  # the list of samples
    export.write_spreadsheet(families_, names, f"{at}/gene_presence_absence.csv")
    other = F.col("s_suppkey") % 4 == 0
    features = s.select("sample_id", F.col("s_suppkey").alias("line_no"), F.lit("CDS").alias("type"), F.concat(F.lit("ID="), F.when(other, F.concat(F.lit("other"), "s_suppkey")).otherwise(F.col("gene"))).alias("attrs"))
    return gfftools.tagged(features, tables.matrix_csv(spark, f"{at}/gene_presence_absence.csv")).select("sample_id", "line_no", "attrs")


_REINFLATED_ADD = """
WITH d AS (SELECT o_orderkey AS k, min(o_orderkey) OVER (PARTITION BY o_orderpriority, o_custkey % 97) AS rep, o_orderpriority AS p, o_custkey % 97 AS g FROM orders),
u AS (SELECT DISTINCT g, rep FROM d WHERE p LIKE '1%'),
nw AS (SELECT c_custkey AS k, min(c_custkey) OVER (PARTITION BY c_custkey // 7) AS rep FROM customer WHERE c_custkey % 5 <> 0),
heads AS (SELECT DISTINCT 0 AS part, rep % 100 AS a, '' AS b, rep AS o, rep::VARCHAR AS gene FROM d WHERE rep % 3 > 0
  UNION ALL SELECT DISTINCT 0, rep % 100, '', 1000000000 + rep, 'n' || rep FROM nw WHERE rep % 2 = 0
  UNION ALL SELECT DISTINCT 1, 0, rep::VARCHAR, 0, rep::VARCHAR FROM d WHERE rep % 3 = 0
  UNION ALL SELECT DISTINCT 2, 0, 'n' || rep, 0, 'n' || rep FROM nw WHERE rep % 2 = 1),
i AS (SELECT *, dense_rank() OVER (ORDER BY part, a, b) - 1 AS c FROM heads),
m AS (SELECT rep::VARCHAR AS rep, k::VARCHAR AS gene, 0 AS rank, k AS ord FROM d WHERE k <> rep
  UNION ALL SELECT u.rep::VARCHAR, 'm' || c_custkey, 1, c_custkey FROM customer JOIN u ON c_custkey % 97 = u.g WHERE c_custkey % 5 = 0
  UNION ALL SELECT 'n' || rep, 'n' || k, 2, k FROM nw WHERE k <> rep),
e AS (SELECT c, o, -1 AS rank, 0 AS ord, gene FROM i UNION ALL SELECT i.c, i.o, m.rank, m.ord, m.gene FROM i JOIN m ON i.gene = m.rep)
SELECT c::BIGINT AS cluster_idx, (row_number() OVER (PARTITION BY c ORDER BY o, rank, ord, gene) - 1)::BIGINT AS member_ord, gene AS gene_id FROM e
"""


@query(_REINFLATED_ADD)
def reinflate_add(spark, sf):
    """The same after an addition: saved clusters, genes matched to their representatives, and new clusters."""
    d, c, o = _dedup(spark, sf), _t(spark, sf, "customer"), _t(spark, sf, "orders")
    urgent = o.filter("o_orderpriority LIKE '1%'").groupBy((F.col("o_custkey") % 97).alias("g")).agg(F.min("o_orderkey").cast("string").alias("rep_id"))
    matched = c.filter("c_custkey % 5 = 0").withColumn("g", F.col("c_custkey") % 97).join(urgent, "g").select("rep_id", F.concat(F.lit("m"), "c_custkey").alias("member_id"), F.col("c_custkey").alias("member_ord"))
    own = c.filter("c_custkey % 5 <> 0").withColumn("g", F.floor(F.col("c_custkey") / 7))
    rep = own.groupBy("g").agg(F.min("c_custkey").alias("r"), F.count("*").alias("n"))
    name = lambda x: F.concat(F.lit("n"), x)
    fresh = own.join(rep, "g").filter("c_custkey <> r OR n = 1").select(name("r").alias("rep_id"), F.when(F.col("n") > 1, name("c_custkey")).alias("member_id"), F.when(F.col("n") > 1, F.col("c_custkey")).alias("member_ord"))
    old = d.select(F.col("rep_id").cast("long").alias("r")).distinct().filter("r % 3 > 0")
    mcl = old.select((F.col("r") % 100).alias("mcl_ord"), F.col("r").cast("string").alias("gene_id"), F.col("r").alias("ord"))
    mcl = mcl.unionByName(rep.filter("r % 2 = 0").select((F.col("r") % 100).alias("mcl_ord"), name("r").alias("gene_id"), (F.col("r") + 1_000_000_000).alias("ord")))
    return families.reinflated_add(mcl, d, matched, fresh)


def _two_sets(spark, sf):
    p = _t(spark, sf, "part")
    a = p.select(F.concat("p_brand", "p_type").alias("cluster"), F.col("p_partkey").cast("string").alias("gene_id"))
    b = p.select(F.when(F.col("p_size") % 10 == 0, "moved").otherwise(F.concat("p_brand", "p_type")).alias("cluster"), F.col("p_partkey").cast("string").alias("gene_id"))
    return a, b


_SETS = "a AS (SELECT p_brand || p_type AS c, p_partkey AS g FROM part), b AS (SELECT CASE WHEN p_size % 10 = 0 THEN 'moved' ELSE p_brand || p_type END AS c, p_partkey AS g FROM part)"


@query(f"WITH {_SETS}, x AS (SELECT c, list(g ORDER BY g) AS s FROM a GROUP BY c), y AS (SELECT DISTINCT list(g ORDER BY g) AS s FROM b GROUP BY c) SELECT count(y.s)::BIGINT AS same, (count(*) - count(y.s))::BIGINT AS diff, count(*)::BIGINT AS total FROM x LEFT JOIN y ON x.s = y.s")
def cluster_equality(spark, sf):
    return families.equal_families(*_two_sets(spark, sf))


@query(f"WITH {_SETS}, n AS (SELECT a.c, b.c AS d, count(*) AS n FROM a JOIN b ON a.g = b.g GROUP BY ALL), z AS (SELECT c, count(*) AS size FROM a GROUP BY c) SELECT z.c AS cluster, z.size::BIGINT AS size, z.size = max(n.n) AS same FROM z JOIN n ON z.c = n.c GROUP BY z.c, z.size")
def cluster_subset(spark, sf):
    return families.kept_families(*_two_sets(spark, sf))


@query("SELECT substr(md5('a' || o_orderkey), i, 3) AS kmer, count(DISTINCT o_orderkey)::BIGINT AS n FROM orders, (SELECT unnest(range(1, 31)) AS i) GROUP BY 1")
def kmer_index(spark, sf):
    """Words of sequences, and how many sequences have each."""
    t = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("gene_id"), F.md5(F.concat(F.lit("a"), "o_orderkey")).alias("aa"))
    return similarity.kmers(t, 3).groupBy("kmer").agg(F.count("*").alias("n"))


@query("WITH i AS (SELECT o_orderkey AS k, 'S' || (o_custkey % 9) || '-c_' || (o_orderkey % 5) || '-' || row_number() OVER (PARTITION BY o_custkey % 9 ORDER BY o_orderkey) || '-' AS p FROM orders) SELECT 2 * k AS line_no, 'ID=' || p || 'g' || k AS attrs FROM i UNION ALL SELECT 2 * k + 1, 'ID=' || p || 'k' || k || ';Parent=' || p || 'g' || k || ';y=2' FROM i")
def gff_normalise(spark, sf):
    """A gene and its coding part at each locus of nine samples."""
    k = F.col("o_orderkey")
    o = _t(spark, sf, "orders").select(F.concat(F.lit("S"), (F.col("o_custkey") % 9).cast("string")).alias("sample_id"), F.concat(F.lit("c-"), (k % 5).cast("string")).alias("seqid"), k.alias("start"), (k + 9).alias("end"), F.explode(F.array(
        F.struct((2 * k).alias("line_no"), F.concat(F.lit("ID=g"), k, F.lit(";x=1")).alias("attrs")), F.struct((2 * k + 1).alias("line_no"), F.concat(F.lit("ID=k"), k, F.lit(";Parent=g"), k, F.lit(";y=2")).alias("attrs")))).alias("x"))
    return gfftools.normalised(o.select("sample_id", "seqid", "start", "end", "x.*")).select("line_no", "attrs")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'ID=' || o_orderkey || ';pangenome_id=' || (o_orderkey % 10) ELSE 'ID=' || o_orderkey END AS attrs FROM orders")
def gff_tag(spark, sf):
    o = _t(spark, sf, "orders")
    t = o.select("o_orderkey", F.lit("s").alias("sample_id"), F.when(F.col("o_orderstatus") == "O", "CDS").otherwise("x").alias("type"), F.concat(F.lit("ID="), "o_orderkey").alias("attrs"))
    c = o.filter("o_orderkey % 2 = 0").select(F.lit("s").alias("sample_id"), F.col("o_orderkey").cast("string").alias("gene_id"), (F.col("o_orderkey") % 10).alias("cluster_no"))
    return gfftools.tagged(t, c).select("o_orderkey", "attrs")


@query("SELECT year, quarter, month, count(*)::BIGINT AS n FROM (SELECT year(o_orderdate)::INT AS year, quarter(o_orderdate)::INT AS quarter, month(o_orderdate)::INT AS month FROM orders WHERE NOT (o_totalprice < 50000 AND o_orderstatus = 'F')) GROUP BY ROLLUP (year, quarter, month) HAVING year IS NOT NULL")
def catalog_rollup(spark, sf):
    """Releases by year, quarter and month, of dates as catalogues write them."""
    t = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("RefSeq FTP"), (F.col("o_totalprice") / 10000).alias("Size(Mb)"), F.when(F.col("o_orderstatus") == "F", "Complete").otherwise("Scaffold").alias("Level"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("Release Date"))
    return gfftools.releases(gfftools.catalogue(t))


@query("SELECT (row_number() OVER (ORDER BY k) - 1)::BIGINT AS sample_ord, sample_id, 'f' || k AS gff_file FROM (SELECT c_nationkey || '_' || (c_custkey % 10) AS sample_id, min(c_custkey) AS k FROM customer GROUP BY 1)")
def sample_list(spark, sf):
    """The first row of each sample id, numbered."""
    from genoloom.sources import genomes

    t = _t(spark, sf, "customer")
    t = t.select(q.no_dash(F.concat("c_nationkey", F.lit("-"), (F.col("c_custkey") % 10).cast("string"))).alias("sample_id"), F.col("c_custkey").alias("line_no"), F.concat(F.lit("f"), "c_custkey").alias("gff_file"), F.lit(None).cast("string").alias("assembly"))
    return genomes.numbered_samples(t).select("sample_ord", "sample_id", "gff_file")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def sequences_included(spark, sf):
    """Sequences of a set of ids."""
    ids = _t(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("gene_id"))
    return genes.only(_t(spark, sf, "orders").withColumnRenamed("o_custkey", "gene_id"), ids).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def sequences_excluded(spark, sf):
    ids = _t(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("gene_id"))
    return genes.without(_t(spark, sf, "orders").withColumnRenamed("o_custkey", "gene_id"), ids).select("o_orderkey")


@query(f"SELECT qseqid, count(*)::BIGINT AS n, sum(bitscore) AS bits FROM (SELECT * FROM ({_HITS}) UNION ALL SELECT * FROM ({_HITS}) WHERE evalue > 0.05) GROUP BY 1")
def hits_united(spark, sf):
    """Saved and new hits together."""
    h = _hits(spark, sf)
    return hits.combined(h, h.filter("evalue > 0.05")).groupBy("qseqid").agg(F.count("*").alias("n"), F.sum("bitscore").alias("bits"))


@query("WITH a AS (SELECT DISTINCT p_brand AS f, p_size AS g FROM part), b AS (SELECT DISTINCT p_brand AS f, CASE WHEN p_brand LIKE '%1' THEN p_size + 1 ELSE p_size END AS g FROM part), x AS (SELECT f, list(g ORDER BY g) AS s FROM a GROUP BY f), y AS (SELECT f, list(g ORDER BY g) AS s FROM b GROUP BY f) SELECT x.f AS family FROM x JOIN y ON x.f = y.f AND x.s = y.s")
def alignments_that_hold(spark, sf):
    """Families whose genes are as they were."""
    from genoloom.operators import msa

    p = _t(spark, sf, "part")
    size = F.when(F.col("p_brand").like("%1"), F.col("p_size") + 1).otherwise(F.col("p_size"))
    return msa.unchanged(p.select(F.col("p_brand").alias("family"), F.col("p_size").alias("gene_id")), p.select(F.col("p_brand").alias("family"), size.alias("gene_id")))


@query("SELECT s_nationkey AS sample_no, 'c' || s_nationkey % 3 AS seq_id, string_agg('g' || s_suppkey || '@' || CASE WHEN s_acctbal < 0 THEN '-1' ELSE '1' END, ';' ORDER BY s_suppkey) AS genes FROM supplier GROUP BY ALL")
def numeric_positions(spark, sf):
    """Genes along contigs, with their strands, as numbers for other tools."""
    s = _t(spark, sf, "supplier")
    gene, sample = F.concat(F.lit("g"), "s_suppkey"), F.col("s_nationkey").cast("string")
    annotation = s.select(gene.alias("gene_id"), sample.alias("sample_id"), F.col("s_suppkey").alias("ann_ord"), F.when(F.col("s_acctbal") < 0, "-").otherwise("+").alias("strand"))
    places = s.select(sample.alias("sample_id"), F.concat(F.lit("c"), (F.col("s_nationkey") % 3).cast("string")).alias("seq_id"), F.col("s_suppkey").alias("pos"), gene.alias("gene_id"))
    own = s.select(sample.alias("name"), gene.alias("g")).groupBy("name").agg(F.collect_list("g").alias("gene_ids"))
    samples = s.select(sample.alias("sample_id"), F.col("s_nationkey").alias("sample_ord")).distinct()
    return gfftools.numeric_export(annotation, places, own, samples)[2]


def _numeric(spark, sf, which: int):
    """Suppliers are genes, their nations samples and families."""
    s = _t(spark, sf, "supplier")
    gene, sample = F.concat(F.lit("g"), "s_suppkey"), F.col("s_nationkey").cast("string")
    annotation = s.select(gene.alias("gene_id"), sample.alias("sample_id"), F.col("s_suppkey").alias("ann_ord"), F.when(F.col("s_acctbal") < 0, "-").otherwise("+").alias("strand"))
    places = s.select(sample.alias("sample_id"), F.lit("c").alias("seq_id"), F.col("s_suppkey").alias("pos"), gene.alias("gene_id"))
    own = s.select(F.concat(F.lit("f"), F.col("s_suppkey") % 6).alias("name"), gene.alias("g")).groupBy("name").agg(F.collect_list("g").alias("gene_ids"))
    samples = s.select(sample.alias("sample_id"), F.col("s_nationkey").alias("sample_ord")).distinct()
    return gfftools.numeric_export(annotation, places, own, samples)[which]


@query("SELECT DISTINCT s_nationkey::VARCHAR AS sample_id, s_nationkey AS sample_no FROM supplier")
def numeric_samples(spark, sf):
    """Samples and their numbers, for other tools."""
    return _numeric(spark, sf, 0)


@query("SELECT 'g' || s_suppkey || '@' || CASE WHEN s_acctbal < 0 THEN '-1' ELSE '1' END AS gene, s_nationkey AS sample_no, (dense_rank() OVER (ORDER BY 'f' || s_suppkey % 6) - 1)::BIGINT AS cluster_no, s_suppkey AS ann_ord FROM supplier")
def numeric_genes(spark, sf):
    """Genes with the numbers of their samples and families."""
    return _numeric(spark, sf, 1)


@query("SELECT p_brand AS file, bool_and(CASE WHEN p_size % 3 = 0 THEN regexp_matches(translate(p_name, ' abcdefghijklmnopqrstuvwxyz', 'AAAACCCGGGTTTNNNAAACCCGGGTT'), '^[CAGTNSYKcagtnsyk]+$') AND (p_size < 48 OR p_brand NOT LIKE '%1') ELSE p_size < 47 OR p_brand NOT LIKE '%2' END) AS valid FROM part GROUP BY p_brand")
def gff_valid(spark, sf):
    """Whether all lines of a file are features of eight cells at least, or sequences of nucleotides."""
    p = _t(spark, sf, "part")
    bases = F.translate("p_name", " abcdefghijklmnopqrstuvwxyz", "AAAACCCGGGTTTNNNAAACCCGGGTT")
    in_fasta = F.col("p_size") % 3 == 0
    ends = lambda x: F.col("p_brand").endswith(x)
    cells = F.when((F.col("p_size") < 47) | ~ends("2"), "a\tb\tc\td\te\tf\tg\th").otherwise("a\tb\tc\td\te\tf\tg")
    line = F.when(in_fasta, F.concat(bases, F.when((F.col("p_size") < 48) | ~ends("1"), "").otherwise("!"))).otherwise(cells)
    return gfftools.valid(p.select(F.col("p_brand").alias("file"), in_fasta.alias("in_fasta"), line.alias("line")))


@query("SELECT o_orderkey, round_even(o_custkey / 8.0::DOUBLE, 2)::DOUBLE AS rounded FROM orders")
def rounded_figures(spark, sf):
    """Figures for exports, halves to even."""
    return _t(spark, sf, "orders").select("o_orderkey", q.rounded(F.col("o_custkey") / 8.0).alias("rounded"))


# Heavy operators, checked by tests on small genomes; here they run over proteins made of digests

def _proteins(spark, sf):
    """A protein a part: digits that eight parts share, with the part's own residues at a few places, so that families exist."""
    p = _t(spark, sf, "part")
    base = F.translate(F.concat(*[F.md5(F.concat(F.floor(F.col("p_partkey") / 8).cast("string"), F.lit(f"-{i}"))) for i in range(4)]), "0123456789abcdef", "ARNDCQEGHILKMFPS")
    own = F.translate(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 2), "0123456789abcdef", "ARNDCQEGHILKMFPS")
    return p.select(F.col("p_partkey").alias("seq_ord"), F.concat(F.lit("s-c-"), "p_partkey").alias("gene_id"), F.concat(F.substring(base, 1, 40), own, F.substring(base, 43, 60)).alias("aa"))


# eight parts' proteins differ at two of 102 places at most, so they are alike, and the first is the longest's first
_GROUPS = "g AS (SELECT p_partkey AS k, min(p_partkey) OVER (PARTITION BY p_partkey // 8) AS rep, count(*) OVER (PARTITION BY p_partkey // 8) AS n FROM part)"


@query(f"WITH {_GROUPS} SELECT 's-c-' || rep AS rep_id, CASE WHEN n > 1 THEN 's-c-' || k END AS member_id, CASE WHEN n > 1 THEN k END AS member_ord FROM g WHERE n = 1 OR k <> rep")
def dedup_98(spark, sf):
    """Near-identical proteins: representatives and members."""
    return similarity.near_identical(_proteins(spark, sf))


def _uneven_proteins(spark, sf):
    """The same with a residue more in each third part of eight, and one less in each fifth."""
    p, k, aa = _proteins(spark, sf), F.col("seq_ord") % 8, F.col("aa")
    return p.withColumn("aa", F.when(k == 3, F.concat(F.substring(aa, 1, 60), F.lit("W"), F.substring(aa, 61, 60))).when(k == 5, F.concat(F.substring(aa, 1, 20), F.substring(aa, 22, 100))).otherwise(aa))


# the longest of eight comes first, and has them all
_UNEVEN = "l AS (SELECT p_partkey AS k, p_partkey // 8 AS f, CASE p_partkey % 8 WHEN 3 THEN 0 WHEN 5 THEN 2 ELSE 1 END AS o FROM part), g AS (SELECT k, first_value(k) OVER (PARTITION BY f ORDER BY o, k) AS rep, count(*) OVER (PARTITION BY f) AS n FROM l)"


@query(f"WITH {_UNEVEN} SELECT 's-c-' || rep AS rep_id, CASE WHEN n > 1 THEN 's-c-' || k END AS member_id, CASE WHEN n > 1 THEN k END AS member_ord FROM g WHERE n = 1 OR k <> rep")
def dedup_98_uneven(spark, sf):
    """Near-identical proteins of different lengths."""
    return similarity.near_identical(_uneven_proteins(spark, sf))


@query("SELECT 's-c-' || (p_partkey // 8 * 8) AS rep_id, 's-c-' || p_partkey AS member_id, p_partkey AS member_ord FROM part WHERE p_partkey % 8 <> 0")
def matched_98_uneven(spark, sf):
    """New proteins, some longer or shorter by a residue, to their saved representatives."""
    p = _uneven_proteins(spark, sf)
    return similarity.matched_to(p.filter("seq_ord % 8 <> 0"), p.filter("seq_ord % 8 = 0"))[0]


@query(f"WITH {_GROUPS} SELECT 's-c-' || rep AS rep_id, 's-c-' || k AS member_id, k AS member_ord FROM g WHERE rep % 8 = 0 AND k % 8 <> 0")
def matched_98(spark, sf):
    """New proteins to their saved representatives."""
    p = _proteins(spark, sf)
    return similarity.matched_to(p.filter("seq_ord % 8 <> 0"), p.filter("seq_ord % 8 = 0"))[0]


@query()
def search_proteins(spark, sf):
    """Hits of representatives against each other."""
    from genoloom.storage import checkpoint

    seqs = _proteins(spark, sf)
    d = similarity.near_identical(seqs)
    reps = checkpoint(seqs.join(d.select(F.col("rep_id").alias("gene_id")).distinct(), "gene_id", "left_semi").select("gene_id", "aa"))
    return similarity.search(reps, reps)


_LINKED = "WITH g AS (SELECT c_custkey AS k, min('n' || c_custkey) OVER (PARTITION BY c_custkey // 6) AS root, count(*) OVER (PARTITION BY c_custkey // 6) AS n FROM customer) SELECT (dense_rank() OVER (ORDER BY -n, root) - 1)::BIGINT AS mcl_ord, 'n' || k AS gene_id, (row_number() OVER (PARTITION BY root ORDER BY 'n' || k) - 1)::INT AS ord FROM g"


def _linked(spark, sf):
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.floor(F.col("c_custkey") / 6).alias("g")).hint("merge")  # its file says little of how many rows it has
    name = lambda x: F.concat(F.lit("n"), x.cast("string"))
    inside = c.join(c.withColumnRenamed("k", "l"), "g").filter("k <= l").select(name(F.col("k")).alias("a"), name(F.col("l")).alias("b"), F.lit(1.0).alias("w"), "k")
    weak = c.join(c.select(F.col("k").alias("l")), F.col("l") == F.col("k") - 1).filter("floor(k / 6) <> floor(l / 6)")
    return inside.unionByName(weak.select(name(F.col("k")).alias("a"), name(F.col("l")).alias("b"), F.lit(0.01).alias("w"), "k"))


@query(_LINKED)
def markov_clusters(spark, sf):
    """Six customers in a row are all linked, and weakly to the next six, so that the flow has to cut one long chain."""
    from genoloom.operators import graphs

    return graphs.markov_clusters(_linked(spark, sf).drop("k"))


@query(_LINKED)
def clusters_after_addition(spark, sf):
    """The same, where the links of one customer of eleven come after the others were clustered."""
    from genoloom.operators import graphs

    e = _linked(spark, sf)
    old, new = e.filter("k % 11 > 0").drop("k"), e.filter("k % 11 = 0").drop("k")
    return graphs.ordered(graphs.reflowed(graphs.flowed(old), old, new))


_PROTEIN = "translate(concat(" + ", ".join(f"md5((p_partkey // 8) || '-{i}')" for i in range(4)) + "), '0123456789abcdef', 'ARNDCQEGHILKMFPS')"


@query(f"SELECT (p_partkey // 8)::VARCHAR AS family, 's-c-' || p_partkey AS gene_id, substr(b, 1, 40) || translate(substr(md5(p_partkey::VARCHAR), 1, 2), '0123456789abcdef', 'ARNDCQEGHILKMFPS') || substr(b, 43, 60) AS aligned FROM (SELECT p_partkey, {_PROTEIN} AS b FROM part)")
def family_msa(spark, sf):
    """Alignments of the families of proteins, which need no gaps as they differ by single residues."""
    from genoloom.operators import msa

    p = _proteins(spark, sf)
    return msa.family_alignments(p.select(F.floor(F.col("seq_ord") / 8).cast("string").alias("family"), "gene_id", F.col("aa").alias("seq")))


_GAPPED = f"""
WITH b AS (SELECT p_partkey AS k, p_partkey // 8 AS f, substr(b, 1, 40) || translate(substr(md5(p_partkey::VARCHAR), 1, 2), '0123456789abcdef', 'ARNDCQEGHILKMFPS') || substr(b, 43, 60) AS aa FROM (SELECT p_partkey, {_PROTEIN} AS b FROM part)),
o AS (SELECT f, bool_or(k % 8 = 3) AS longer, bool_or(k % 8 <> 5) AS whole FROM b GROUP BY f)
SELECT b.f::VARCHAR AS family, 's-c-' || k AS gene_id, substr(aa, 1, 20) || CASE WHEN k % 8 <> 5 THEN 'WTW' WHEN whole THEN '---' ELSE '' END || substr(aa, 24, 37) ||
  CASE WHEN k % 8 = 3 THEN 'YVY' WHEN longer THEN '---' ELSE '' END || substr(aa, 61, 42) AS aligned
FROM b JOIN o ON b.f = o.f
"""


@query(_GAPPED)
def family_msa_gaps(spark, sf):
    """The same with three residues more in one protein of eight, and three less in another."""
    from genoloom.operators import msa

    p, k = _proteins(spark, sf), F.col("seq_ord") % 8
    part = lambda i, n: F.substring("aa", i, n)
    seq = F.concat(part(1, 20), F.when(k == 5, "").otherwise("WTW"), part(24, 37), F.when(k == 3, "YVY").otherwise(""), part(61, 42))
    return msa.family_alignments(p.select(F.floor(F.col("seq_ord") / 8).cast("string").alias("family"), "gene_id", seq.alias("seq")))


# Files written from tables and read back

def _folder(spark, name: str) -> str:
    import uuid

    from genoloom.storage import shared_root

    return f"{shared_root(spark)}/genoloom/{name}-{uuid.uuid4().hex}"


@query("SELECT event_type AS seqid, event_id % 7 AS kind, count(*) AS n, sum(user_id + 1)::BIGINT AS starts, sum(user_id + 121)::BIGINT AS ends, min('ID=e' || event_id) AS first FROM events WHERE event_id % 7 < 3 GROUP BY ALL")
def gff_files(spark, sf):
    """Features written as GFF files, a folder a sample, and read with the types that are asked for."""
    from genoloom.sources.genome_files import register

    at, e = _folder(spark, "gff"), _t(spark, sf, "events")
    cells = [F.col("event_type"), F.lit("x"), F.concat(F.lit("t"), F.col("event_id") % 7), F.col("user_id") + 1, F.col("user_id") + 121, F.lit("."), F.lit("+"), F.lit("0"), F.concat(F.lit("ID=e"), "event_id")]
    line = F.concat_ws("\t", *(c.cast("string") for c in cells))
    tail = F.when(F.col("event_id") % 50 == 0, F.lit("\n# a comment\n")).otherwise("")
    e.select(F.concat(line, tail).alias("value"), (F.col("event_id") % 3).alias("sample")).write.partitionBy("sample").text(at)
    register(spark)
    t = spark.read.format("gff").option("pattern", r"\.txt$").load(at).filter(F.col("type").isin("t0", "t1", "t2"))
    return t.groupBy("seqid", F.substring("type", 2, 1).cast("long").alias("kind")).agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.min("attrs").alias("first"))


@query("SELECT 'd' || doc_id AS name, length(text)::BIGINT AS n, md5(text) AS sum FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS text FROM documents) WHERE text IS NOT NULL")
def fasta_files(spark, sf):
    """Sequences written as FASTA, in lines of 60, compressed, and read back as records."""
    from genoloom.sources.genome_files import register

    at, d = _folder(spark, "fasta"), _t(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "[^A-Za-z]", "").alias("text")).filter("text IS NOT NULL")
    lines = F.regexp_replace("text", "(.{60})", "$1\n")
    d.select(F.concat(F.lit(">d"), "doc_id", F.lit(" a document\n"), lines).alias("value")).write.option("compression", "gzip").text(at)
    register(spark)
    t = spark.read.format("fasta").option("pattern", r"\.txt\.gz$").load(at)
    return t.select("name", F.length("seq").cast("long").alias("n"), F.md5("seq").alias("sum"))


@query("WITH d AS (SELECT o_orderkey AS k, min(o_orderkey) OVER (PARTITION BY o_orderpriority, o_custkey % 97) AS rep, count(*) OVER (PARTITION BY o_orderpriority, o_custkey % 97) AS n FROM orders), g AS (SELECT c_custkey AS k, (SELECT min(o_orderkey) FROM orders) AS rep FROM customer), l AS (SELECT rep, max(k) AS last FROM d WHERE k <> rep GROUP BY rep) SELECT rep::VARCHAR AS rep_id, CASE WHEN n > 1 THEN k::VARCHAR END AS member_id, CASE WHEN n > 1 THEN k END AS member_ord FROM d WHERE (n = 1 OR k <> rep) AND NOT (n = 1 AND rep IN (SELECT rep FROM g)) UNION ALL SELECT g.rep::VARCHAR, 'new' || g.k, coalesce(l.last, -1) + 1 + g.k FROM g LEFT JOIN l ON g.rep = l.rep UNION ALL SELECT 'fresh', NULL, NULL")
def merged_clusters(spark, sf):
    """Saved clusters with new genes matched to one of them, and a new cluster."""
    d, c = _dedup(spark, sf), _t(spark, sf, "customer")
    first = _t(spark, sf, "orders").agg(F.min("o_orderkey").cast("string")).first()[0]
    matched = c.select(F.lit(first).alias("rep_id"), F.concat(F.lit("new"), "c_custkey").alias("member_id"), F.col("c_custkey").alias("member_ord"))
    fresh = spark.createDataFrame([("fresh", None, None)], "rep_id string, member_id string, member_ord long")
    return families.merged_clusters(d, matched, fresh)
