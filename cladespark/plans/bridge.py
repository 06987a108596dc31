"""Genomic and catalog tables derived from the supplied test tables.

The supplied tables hold no genomic data, so every query runs over tables derived from all
their rows with integer arithmetic. The derivations are SQL that means the same in any
engine; ``views`` gives them as text and the functions below as DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark import refdata
from cladespark.functions.tables import broadcast_if_small, dealt, values, with_panel
from cladespark.operators.intervals import markers_to_targets, overlaps

HOST_CONTIG, HOST_LENGTH = "chr21", 46_709_983
N_PROFILES = len({row[0] for row in refdata.profile_rows()})
MIX = "l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 1299709"

SAMPLE = "concat('S', lpad(cast(l_suppkey as string), 5, '0'))"

SAMPLES = f"SELECT {SAMPLE.replace('l_suppkey', 's_suppkey')} AS sample_id FROM supplier"

# Aligned reads: one per line item. One line number in seven lands on a host contig. The
# genome range narrows with the sample, so its tail markers run out of coverage.
READS = f"""
SELECT sample_id, l_suppkey, l_orderkey, l_partkey, chrom, r_start AS start, r_start + r_size AS "end", mapq
FROM (
  SELECT {SAMPLE} AS sample_id, l_suppkey, l_orderkey, l_partkey,
         CASE WHEN l_linenumber = 7 THEN '{HOST_CONTIG}' ELSE '{refdata.CONTIG}' END AS chrom,
         CASE WHEN l_linenumber = 7 THEN ({MIX}) % {HOST_LENGTH - 1001}
              ELSE ({MIX}) % (28903 - (l_suppkey % 5) * 2000) END AS r_start,
         700 + 6 * cast(l_quantity as bigint) AS r_size,
         (l_partkey * 31 + l_orderkey * 17) % 61 AS mapq
  FROM lineitem
) t
"""

# The base a read shows at a marker: the allele of its sample's true clade, with errors.
BASE = """CASE WHEN (l_orderkey * 3 + l_partkey * 5 + pos) % 23 = 0
  THEN substr('ACGT', cast(1 + pos % 4 as int), 1) ELSE alt END"""
BASE_QUALITY = "10 + (l_orderkey * 13 + l_partkey * 7 + pos) % 31"

VARIANTS = f"""
SELECT {SAMPLE} AS sample_id, '{refdata.CONTIG}' AS chrom, 1 + ({MIX}) % 29000 AS pos,
       substr('ACGTTGCAACGT', cast(1 + l_partkey % 8 as int), cast(1 + l_orderkey % 4 as int)) AS ref,
       CASE WHEN l_linenumber = 3 THEN 'A,T'
            ELSE substr('TGCATTAGCCAT', cast(1 + l_orderkey % 7 as int), cast(1 + l_partkey % 5 as int)) END AS alt,
       CASE WHEN l_linenumber = 5 THEN NULL ELSE l_quantity END AS qual
FROM lineitem
"""

PART_MARKERS = f"""
SELECT '{refdata.CONTIG}' AS chrom, 1 + p_partkey * 13 AS pos,
       substr('ACGT', cast(1 + p_partkey % 4 as int), 1) AS ref
FROM part
"""

REGIONS = f"""
SELECT '{refdata.CONTIG}' AS chrom, n_nationkey * cast(1150 as bigint) + n_regionkey * 37 AS start,
       n_nationkey * cast(1150 as bigint) + n_regionkey * 37 + 200 + n_regionkey * 700 AS "end"
FROM nation
UNION ALL
SELECT '{HOST_CONTIG}' AS chrom, r_regionkey * cast(9000000 as bigint) AS start,
       r_regionkey * cast(9000000 as bigint) + 3000000 AS "end"
FROM region
"""

# A wide target panel along the host contig, one target per part.
PART_TARGETS = f"""
SELECT '{HOST_CONTIG}' AS chrom, (p_partkey * 229133) % {HOST_LENGTH - 9001} AS start,
       (p_partkey * 229133) % {HOST_LENGTH - 9001} + 100 + 100 * p_size AS "end"
FROM part
"""

# Named targets on both contigs: some without a base, some intervals under two names.
NAMED_TARGETS = f"""
SELECT CASE WHEN s_suppkey % 3 = 0 THEN '{HOST_CONTIG}' ELSE '{refdata.CONTIG}' END AS chrom,
       s_suppkey % 40 * cast(700 as bigint) AS start,
       s_suppkey % 40 * cast(700 as bigint) + s_suppkey % 5 * cast(150 as bigint) AS "end",
       concat('target ', cast(s_suppkey as string)) AS name
FROM supplier
"""

# Another panel: a marker per nation, two in three on the virus.
NATION_MARKERS = f"""
SELECT CASE WHEN n_nationkey % 3 = 0 THEN '{HOST_CONTIG}' ELSE '{refdata.CONTIG}' END AS chrom,
       cast(500 + n_nationkey * 1000 as bigint) AS pos, substr('ACGT', cast(1 + n_nationkey % 4 as int), 1) AS ref
FROM nation
"""
NATION_SITES = tuple((HOST_CONTIG if n % 3 == 0 else refdata.CONTIG, 500 + n * 1000) for n in range(25))

# A dense panel of up to 400 markers on both contigs, from the numbers of the parts.
DENSE_MARKERS = f"""
SELECT DISTINCT CASE WHEN p_partkey % 5 = 0 THEN '{HOST_CONTIG}' ELSE '{refdata.CONTIG}' END AS chrom,
       cast(40 + p_partkey % 400 * 71 as bigint) AS pos, 'A' AS ref
FROM part
"""
DENSE_SITES = tuple((HOST_CONTIG if n % 5 == 0 else refdata.CONTIG, 40 + n * 71) for n in range(400))

# Listings of what two steps have put out, one row per finished sample.
STEP_OUTPUTS = f"""
SELECT DISTINCT {SAMPLE} AS sample_id, 'coverage' AS step FROM lineitem WHERE l_quantity >= 2
UNION ALL
SELECT DISTINCT {SAMPLE} AS sample_id, 'mutations' AS step FROM lineitem
WHERE l_quantity >= 49 AND l_linenumber = 1 AND l_returnflag = 'N'
"""

PATTERNS = """
SELECT concat('^P', cast(n_nationkey as string), '[0-9]$') AS pattern FROM nation
UNION ALL
SELECT concat(cast(r_regionkey as string), '7$') AS pattern FROM region
"""

# A pattern per part: one order number exactly, all that begin or end with some digits, some that hold them anywhere.
MANY_PATTERNS = """
SELECT CASE p_partkey % 4 WHEN 0 THEN concat('^P', cast(p_partkey as string), '$') WHEN 1 THEN concat('^P', cast(p_partkey as string), '[0-3]$')
         WHEN 2 THEN concat('P', cast(p_partkey as string), '(5|7)') ELSE concat('9', cast(p_partkey as string), '[0-9]?8$') END AS pattern
FROM part
"""

# Allele of isolate c_custkey at marker (pos, ref); NULL and N stand for unreadable bases.
ALLELE = """CASE WHEN c_mktsegment = 'MACHINERY' AND pos = 28883 AND c_custkey % 3 = 0 THEN NULL
  WHEN (c_custkey * 11 + pos) % 89 = 0 THEN 'N'
  WHEN (c_custkey * 7 + pos) % 5 = 0 THEN substr('ACGT', cast(1 + (c_custkey + pos) % 4 as int), 1)
  ELSE ref END"""

ISOLATE_CLADES = """
SELECT c_name AS seqname, c_mktsegment AS clade, concat('G', cast(c_nationkey as string)) AS gisaid_clade,
       concat('O', cast(c_custkey % 8 as string)) AS old_nextstrain_clade
FROM customer
"""

READ_FILES = """
SELECT concat('./input_files/P', cast(o_orderkey as string), '_R1.fastq.gz') AS path FROM orders
UNION ALL
SELECT concat('./input_files/P', cast(l_orderkey as string), '_R2.fastq.gz') AS path
FROM (SELECT DISTINCT l_orderkey FROM lineitem) d
UNION ALL
SELECT concat('./input_files/', c_name, '.bam') AS path FROM customer
"""

FILE_ID = """md5(concat(cast(l_orderkey as string), '|', cast(l_partkey as string), '|',
  cast(l_suppkey as string), '|', cast(l_linenumber as string)))"""

FILES = f"""
SELECT {FILE_ID} AS file_id,
       max(concat('reads ', l_returnflag, '#', cast(l_partkey as string), ' (', l_linestatus, ').fastq.gz')) AS name,
       max(1024 * cast(l_quantity as bigint)) AS size
FROM lineitem GROUP BY {FILE_ID}
"""

LISTING = f"""
SELECT {FILE_ID} AS file_id, max(1 + 1024 * cast(l_quantity as bigint)) AS size
FROM lineitem WHERE l_linestatus = 'O' GROUP BY {FILE_ID}
"""

PROJECTS = """
SELECT concat('P', cast(o_orderkey as string)) AS project_id,
       concat(o_orderpriority, ' ', cast(o_orderkey as string)) AS name, o_orderdate AS created
FROM orders
"""

PROJECT_FILES = f"""
SELECT DISTINCT concat('P', cast(l_orderkey as string)) AS project_id, {FILE_ID} AS file_id FROM lineitem
"""

ACCOUNTS = """
SELECT concat('A', cast(c_custkey as string)) AS account_id,
       concat(lower(c_mktsegment), cast(c_custkey as string), '@example.org') AS email
FROM customer
"""

ACCOUNT_PROJECTS = """
SELECT concat('A', cast(o_custkey as string)) AS account_id, concat('P', cast(o_orderkey as string)) AS project_id
FROM orders
"""

REMOVED_PROJECTS = f"{ACCOUNT_PROJECTS} WHERE o_orderstatus = 'F'"

RUN_ID = "concat('R', cast(user_id as string), '-', cast(day(ts) % 3 as string))"

RUN_LOG = f"""
SELECT {RUN_ID} AS run_id, ts, event_id,
       CASE event_type WHEN 'signup' THEN 'initiating' WHEN 'view' THEN 'initiated' WHEN 'click' THEN 'running'
         WHEN 'purchase' THEN CASE WHEN value >= 20 THEN 'succeeded' ELSE 'retracted' END
         ELSE CASE WHEN value >= 20 THEN 'failed' ELSE 'stopped' END END AS status,
       CASE WHEN event_type = 'error' AND value >= 20 THEN concat('exit code of #', cast(event_id as string)) END AS message
FROM events
"""

# Facts of runs in transactions: bulk loads put every third event in one, some transactions are not listed or have no instant.
TX = "cast(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 + (event_id - event_id % 7) / 7 END as bigint)"
FACTS = f"""
SELECT run_id AS entity, 'status' AS attribute, status AS value, {TX} AS tx FROM ({RUN_LOG}) s
UNION ALL
SELECT run_id AS entity, 'message' AS attribute, message AS value, {TX} AS tx FROM ({RUN_LOG}) m
WHERE message IS NOT NULL
"""
TRANSACTIONS = f"""
SELECT {TX} AS tx, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS instant FROM events
WHERE event_id % 49 >= 7
"""

# Another table of transitions: by status, the states it takes effect from.
OTHER_TRANSITIONS = {
    "initiated": ("initiating", "retracted", "failed"), "running": ("initiated", "stopped"), "stopped": ("running",),
    "succeeded": ("running",), "failed": ("running", "initiated"), "retracted": ("initiated", "failed"),
}

RUN_FILES = f"""
SELECT DISTINCT run_id, file_id FROM (
  SELECT concat('R', cast(l_suppkey as string), '-', cast(l_linenumber % 3 as string)) AS run_id, {FILE_ID} AS file_id
  FROM lineitem) f
"""

SOME_ACCOUNT = "A42"
PROFILE_SYSTEMS = ("first", "second", "third")

# Lines as they stand in the files at the edges, next to the path of their file; ~ stands for a tab.
VARIANT_LINES = f"""
SELECT concat('/data/run+1/', sample_id, CASE WHEN pos % 2 = 0 THEN '+b' ELSE '' END, '.vcf') AS path,
       CASE WHEN pos % 17 = 0 THEN concat('#comment ', cast(pos as string))
            ELSE replace(concat(chrom, '~', cast(pos as string), '~.~', ref, '~', alt, '~',
              CASE WHEN qual IS NULL THEN '.' ELSE cast(cast(qual as bigint) as string) END, '~PASS~DP=1~GT~1'), '~', chr(9))
       END AS value
FROM ({VARIANTS}) v
"""

COVERAGE_LINES = f"""
SELECT concat('/data/', sample_id, '_coverage.bed') AS path,
       replace(concat(chrom, '~', cast(start as string), '~', cast(start + 1 as string), '~', cast(mapq as string),
         '~1~1~0.5'), '~', chr(9)) AS value
FROM ({READS}) r
"""

MUTATION_LINES = f"""
SELECT concat('/data/', sample_id, '_mutations.csv') AS path,
       CASE WHEN pos % 13 = 0 THEN 'pos,ref,alt,qual,pos_c,ref_c,alt_c'
            ELSE concat(cast(pos as string), ',', ref, ',', chr(34), alt, chr(34), ',,', cast(pos as string), ',', ref, ',',
                        chr(34), alt, chr(34)) END AS value
FROM ({VARIANTS}) v
"""

MARKER_LINES = f"""
SELECT '/data/markers.csv' AS path, 'chr,pos,ref' AS value FROM region
UNION ALL
SELECT '/data/markers.csv' AS path, concat(chrom, ',', cast(pos as string), ',', ref) AS value FROM ({PART_MARKERS}) m
"""

STATE_LINES = f"""
SELECT concat('/data/', sample_id, '_markers.csv') AS path,
       concat(cast(pos as string), ',', cast(8 + pos % 9 as string), ',', ref, ',',
              CASE WHEN qual IS NULL THEN '?,yes,' ELSE concat(ref, ',,') END, ref) AS value
FROM ({VARIANTS}) v
"""

SHEET_LINES = """
SELECT '/data/sheet.txt' AS path,
       replace('Position~A~T~C~G~N~X~Y~AA changes~markers for', '~', chr(9)) AS value FROM region
UNION ALL
SELECT '/data/sheet.txt' AS path,
       replace(concat(cast(p_partkey as string), '~1~2~3~4~5~', substr('ACGT', cast(1 + p_partkey % 4 as int), 1), '~',
               substr('TTGA', cast(1 + p_partkey % 4 as int), 1), '~leader, one~X'), '~', chr(9)) AS value
FROM part
"""

ACCOUNT_RUNS = f"SELECT DISTINCT concat('A', cast(user_id as string)) AS account_id, {RUN_ID} AS run_id FROM events"

REGION = (10_000, 11_500)
AS_OF = "2024-01-15 12:00:00"
BLACKLIST = ("77", "^P1.*5$")


def from_tables(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a derivation over the Parquet tables of a folder."""
    names = ("lineitem", "orders", "customer", "part", "supplier", "nation", "region", "events")
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names if f"FROM {n}" in sql}
    text = sql.replace('"', "`")
    for name in tables:
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(text, **tables)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_tables(spark, sf_dir, READS)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cohort list: a sample per supplier."""
    return from_tables(spark, sf_dir, SAMPLES)


def customer_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile per customer: its alleles at the markers, an unreadable one as N."""
    return isolate_alleles(spark, sf_dir).select(
        "chrom", F.lit("customers").alias("id"), F.col("seqname").alias("clade"), "pos",
        F.coalesce("allele", F.lit("N")).alias("alt"),
    )


def contigs(spark: SparkSession) -> DataFrame:
    rows = [(refdata.CONTIG, refdata.GENOME_LENGTH), (HOST_CONTIG, HOST_LENGTH)]
    return values(spark, "chrom string, length long", rows)


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base calls of all reads at the markers they cover."""
    covering = overlaps(reads(spark, sf_dir), markers_to_targets(refdata.markers(spark)))
    truth = broadcast_if_small(refdata.numbered_profiles(spark).select("pidx", "pos", "alt"))
    return (
        covering.withColumn("pos", F.col("t_end"))
        .withColumn("pidx", F.col("l_suppkey") % N_PROFILES)
        .join(truth, ["pidx", "pos"])
        .select(
            "sample_id", "chrom", "pos", "mapq",
            F.expr(BASE).alias("base"), F.expr(BASE_QUALITY).alias("bq"),
        )
    )


def isolate_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_name", "c_custkey", "c_mktsegment")
    customers = dealt(customers, len(refdata.MARKERS), "c_name", "c_custkey")
    return with_panel(customers, refdata.markers(spark)).select(
        F.col("c_name").alias("seqname"), "c_custkey", "chrom", "pos", "ref", F.expr(ALLELE).alias("allele")
    )


def isolates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide isolates, one ``pos_<p>`` column per marker."""
    def allele(pos: int, ref: str):
        return F.expr(ALLELE.replace("pos", str(pos)).replace("ELSE ref", f"ELSE '{ref}'")).alias(f"pos_{pos}")

    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return customers.select(F.col("c_name").alias("seqname"), *[allele(p, r) for p, r in refdata.MARKERS])


def isolate_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public isolates as cohort members next to the sequenced samples."""
    return isolate_alleles(spark, sf_dir).select(
        F.col("seqname").alias("sample_id"), "chrom", "pos",
        (8 + F.col("c_custkey") % 100).alias("n_covering_frags"),
        "ref", F.col("allele").alias("alt"),
        F.when(F.col("allele") != F.col("ref"), F.lit("yes")).alias("is_mutated"),
        F.col("ref").alias("original_ref"),
    )


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return documents.select(F.col("doc_id").alias("seqname"), F.col("text").alias("seq"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_tables(spark, sf_dir, RUN_LOG)
