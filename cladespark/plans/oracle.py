"""The same queries in plain SQL over the supplied tables, for comparison in another engine.

Written for checking: brute force joins and per-position logic instead of bins and tiles.
"""

from __future__ import annotations

from cladespark import refdata
from cladespark.operators.likelihood import THETA, prior_cost
from cladespark.plans import bridge


def _values(rows) -> str:
    def literal(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)


MARKERS = _values([(refdata.CONTIG, p, r) for p, r in refdata.MARKERS])
PROFILES = _values(refdata.profile_rows())
SYSTEMS = _values(refdata.NAMING_SYSTEMS)
COLOURS = _values([(s, c, v) for s, by_clade in refdata.CLADE_COLOURS.items() for c, v in by_clade.items()])
N = bridge.N_PROFILES

LAST = """SELECT run_id, status, last_message AS message, created FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) AS k,
      min(ts) OVER (PARTITION BY run_id) AS created,
      last_value(message IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_message
    FROM {log}) t WHERE k = 1"""

def _allowed(status: str, state: str) -> str:
    """Whether a change to ``status`` takes effect from ``state`` under the other table of transitions."""
    cases = " ".join(f"WHEN '{t}' THEN coalesce({state} IN ({', '.join(map(repr, s))}), false)" for t, s in bridge.OTHER_TRANSITIONS.items())
    return f"CASE {status} {cases} ELSE true END"


CTES = {
    "markers": f"SELECT chrom, pos::BIGINT AS pos, ref FROM (VALUES {MARKERS}) t(chrom, pos, ref)",
    "profiles": f"""SELECT pidx::BIGINT AS pidx, id, clade, pos::BIGINT AS pos, alt
        FROM (VALUES {PROFILES}) t(pidx, id, clade, pos, alt)""",
    "systems": f"SELECT * FROM (VALUES {SYSTEMS}) t(naming_system, id, link)",
    "colours": f"SELECT * FROM (VALUES {COLOURS}) t(id, clade, color)",
    "contigs": f"""SELECT chrom, length::BIGINT AS length FROM (VALUES ('{refdata.CONTIG}', {refdata.GENOME_LENGTH}),
        ('{bridge.HOST_CONTIG}', {bridge.HOST_LENGTH})) t(chrom, length)""",
    "reads": bridge.READS,
    "samples": bridge.SAMPLES,
    "bases": f"""SELECT sample_id, chrom, pos, mapq, {bridge.BASE} AS base, {bridge.BASE_QUALITY} AS bq
        FROM reads JOIN profiles ON l_suppkey % {N} = pidx
        WHERE chrom = '{refdata.CONTIG}' AND start < pos AND "end" >= pos""",
    "pileup": """SELECT sample_id, chrom, pos, base, count(*)::BIGINT AS n FROM bases
        WHERE mapq >= 10 AND bq >= 15 GROUP BY ALL""",
    "ranked": """SELECT *, sum(n) OVER s AS depth, row_number() OVER (s ORDER BY n DESC, base) AS k
        FROM pileup WINDOW s AS (PARTITION BY sample_id, chrom, pos)""",
    "calls": """SELECT sample_id, chrom, pos, ref, base AS alt, depth::BIGINT AS depth, n AS alt_count
        FROM ranked JOIN markers USING (chrom, pos)
        WHERE k = 1 AND depth >= 10 AND n >= 5 AND base <> ref""",
    "costs": """SELECT sample_id, chrom, pos, count(*)::BIGINT AS depth, """ + ", ".join(
        f"sum(CASE WHEN base = '{g}' THEN same ELSE other END)::BIGINT AS cost_{g}" for g in "ACGT") + ", " + ", ".join(
        f"count(*) FILTER (WHERE base = '{g}')::BIGINT AS n_{g}" for g in "ACGT") + """
        FROM (SELECT *, round(-10000 * log10(1 - pow(10.0::DOUBLE, -bq / 10.0::DOUBLE)))::BIGINT AS same,
                     round(-10000 * log10(pow(10.0::DOUBLE, -bq / 10.0::DOUBLE) / 3))::BIGINT AS other
              FROM bases WHERE mapq >= 10 AND bq >= 15 AND base IN ('A', 'C', 'G', 'T')) b GROUP BY ALL""",
    # One row per (site, genotype); the least cost wins, the first base among equals.
    "likely": f"""SELECT sample_id, chrom, pos, ref, base AS alt, n AS alt_count, depth,
        round(10 * (behind_ref + log10(total)), 3) AS qual,
        round(CASE WHEN (total - 1) / total > 0 THEN least(-10 * log10((total - 1) / total), 999.0::DOUBLE) ELSE 999.0::DOUBLE END, 3)
          AS genotype_quality
        FROM (SELECT *, row_number() OVER (s ORDER BY cost, base) AS k, sum(pow(10.0::DOUBLE, -behind)) OVER (s ORDER BY base
                ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total, max(CASE WHEN base = ref THEN behind END) OVER s AS behind_ref
              FROM (SELECT *, (cost - min(cost) OVER (PARTITION BY sample_id, chrom, pos))::DOUBLE / 10000 AS behind
                    FROM (SELECT sample_id, chrom, pos, depth, ref, base, n, cost + CASE WHEN base = ref THEN {prior_cost(1 - THETA)}
                            ELSE {prior_cost(THETA / 3)} END AS cost
                          FROM ({" UNION ALL ".join(f"SELECT sample_id, chrom, pos, depth, '{g}' AS base, cost_{g} AS cost, n_{g} AS n FROM costs" for g in "ACGT")}) g
                          JOIN markers USING (chrom, pos)) c) d
              WINDOW s AS (PARTITION BY sample_id, chrom, pos)) e
        WHERE k = 1 AND base <> ref AND depth >= 10 AND n >= 5""",
    "coverage": """SELECT s.sample_id, m.chrom, m.pos, count(r.start)::BIGINT AS n_covering_frags
        FROM samples s CROSS JOIN markers m LEFT JOIN reads r
          ON r.sample_id = s.sample_id AND r.chrom = m.chrom AND r.start < m.pos AND r."end" >= m.pos
        GROUP BY ALL""",
    "states": """SELECT sample_id, chrom, pos, n_covering_frags, m.ref,
        CASE WHEN n_covering_frags < 8 THEN '?' WHEN c.alt IS NULL THEN m.ref ELSE c.alt END AS alt,
        CASE WHEN c.alt IS NOT NULL THEN 'yes' END AS is_mutated, m.ref AS original_ref
        FROM coverage LEFT JOIN (SELECT sample_id, chrom, pos, alt FROM calls) c USING (sample_id, chrom, pos)
        LEFT JOIN markers m USING (chrom, pos)""",
    "filtered": f"SELECT * FROM ({bridge.VARIANTS}) v WHERE qual > 10",
    "filtered_split": "SELECT * REPLACE (unnest(string_split(alt, ',')) AS alt) FROM filtered",
    "isolate_long": f"""SELECT c_name AS seqname, c_custkey, chrom, pos, ref, {bridge.ALLELE} AS allele
        FROM customer CROSS JOIN markers""",
    "isolate_states": """SELECT seqname AS sample_id, chrom, pos, 8 + c_custkey % 100 AS n_covering_frags, ref,
        allele AS alt, CASE WHEN allele <> ref THEN 'yes' END AS is_mutated, ref AS original_ref FROM isolate_long""",
    "isolate_clades": bridge.ISOLATE_CLADES,
    "panel": """SELECT seqname, clade, gisaid_clade, old_nextstrain_clade, pos, allele
        FROM isolate_long JOIN isolate_clades USING (seqname)""",
    "panel_counts": "SELECT clade, pos, allele, count(*)::BIGINT AS n FROM panel GROUP BY ALL",
    "panel_text": """SELECT clade, pos, CASE WHEN count(allele) = count(*)
        THEN string_agg(allele || '=' || n, ' ' ORDER BY n DESC, allele) END AS alleles
        FROM panel_counts GROUP BY ALL""",
    "log": bridge.RUN_LOG,
    "numbered": "SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS k FROM log",
    # A plain fold over each run's events, one event per step.
    "folded": """SELECT run_id, event_id, ts, status, message, k, CAST(NULL AS VARCHAR) AS previous,
        status NOT IN ('running', 'retracted') AS applied,
        CASE WHEN status NOT IN ('running', 'retracted') THEN status END AS state
    FROM numbered WHERE k = 1
    UNION ALL
    SELECT n.run_id, n.event_id, n.ts, n.status, n.message, n.k, f.status AS previous,
        n.status NOT IN ('running', 'retracted') OR coalesce(f.state = 'initiated', false) AS applied,
        CASE WHEN n.status NOT IN ('running', 'retracted') OR coalesce(f.state = 'initiated', false)
             THEN n.status ELSE f.state END AS state
    FROM numbered n JOIN folded f ON n.run_id = f.run_id AND n.k = f.k + 1""",
    "folded_any": f"""SELECT run_id, event_id, ts, status, k, CAST(NULL AS VARCHAR) AS previous,
        {_allowed("status", "CAST(NULL AS VARCHAR)")} AS applied, CASE WHEN {_allowed("status", "CAST(NULL AS VARCHAR)")} THEN status END AS state
    FROM numbered WHERE k = 1
    UNION ALL
    SELECT n.run_id, n.event_id, n.ts, n.status, n.k, f.status AS previous, {_allowed("n.status", "f.state")} AS applied,
        CASE WHEN {_allowed("n.status", "f.state")} THEN n.status ELSE f.state END AS state
    FROM numbered n JOIN folded_any f ON n.run_id = f.run_id AND n.k = f.k + 1""",
    "facts": f"""SELECT f.*, t.instant FROM ({bridge.FACTS}) f
        LEFT JOIN (SELECT tx, min(instant) AS instant FROM ({bridge.TRANSACTIONS}) x GROUP BY tx) t USING (tx)""",
    "current": """SELECT entity, min(instant) AS created,
        arg_max(value, (coalesce(instant, TIMESTAMP '0001-01-01'), tx, value)) FILTER (WHERE attribute = 'status') AS status,
        arg_max(value, (coalesce(instant, TIMESTAMP '0001-01-01'), tx, value)) FILTER (WHERE attribute = 'message') AS message
        FROM facts GROUP BY entity""",
    "committed": "SELECT run_id, ts, event_id, status, message FROM folded WHERE applied",
    "last": LAST.format(log="committed"),
    "files": bridge.FILES,
    "listing": bridge.LISTING,
    "projects": bridge.PROJECTS,
    "project_files": bridge.PROJECT_FILES,
    "accounts": bridge.ACCOUNTS,
    "account_projects": bridge.ACCOUNT_PROJECTS,
    "account_runs": bridge.ACCOUNT_RUNS,
    "read_files": bridge.READ_FILES,
}

# Naming each step lets a query pull in just what it reads.
NEEDS = {
    "bases": ["reads", "profiles"],
    "pileup": ["bases"],
    "costs": ["bases"],
    "likely": ["costs", "markers"],
    "ranked": ["pileup"],
    "calls": ["ranked", "markers"],
    "coverage": ["samples", "reads", "markers"],
    "states": ["coverage", "calls", "markers"],
    "filtered_split": ["filtered"],
    "isolate_long": ["markers"],
    "isolate_states": ["isolate_long"],
    "panel": ["isolate_long", "isolate_clades"],
    "panel_counts": ["panel"],
    "panel_text": ["panel_counts"],
    "numbered": ["log"],
    "folded": ["numbered"],
    "folded_any": ["numbered"],
    "current": ["facts"],
    "committed": ["folded"],
    "last": ["committed"],
}


def _scores(states: str) -> str:
    # The left side is the profile, so a missing state gives a NULL cost.
    return f"""SELECT sample_id, id, clade,
        CASE WHEN count(cost) = count(*) THEN sum(cost) END AS manhattan
        FROM (SELECT s.sample_id, p.id, p.clade, CASE WHEN x.alt = '?' THEN 0.5e0
                WHEN x.alt <> p.alt THEN 1e0 WHEN x.alt = p.alt THEN 0e0 END AS cost
              FROM (SELECT DISTINCT sample_id FROM {states}) s CROSS JOIN profiles p
              LEFT JOIN {states} x ON x.sample_id = s.sample_id AND x.pos = p.pos) t
        GROUP BY sample_id, id, clade"""


CTES["scores"] = _scores("states")
CTES["isolate_scores"] = _scores("isolate_states")
CTES["best"] = """SELECT sample_id, id, clade, manhattan FROM (
    SELECT *, rank() OVER g AS k, count(*) OVER (PARTITION BY sample_id, id)
      - count(manhattan) OVER (PARTITION BY sample_id, id) AS nulls
    FROM scores WINDOW g AS (PARTITION BY sample_id, id ORDER BY manhattan)) t WHERE k = 1 AND nulls = 0"""
CTES["isolate_best"] = CTES["best"].replace("FROM scores", "FROM isolate_scores")
CTES["call_text"] = "SELECT sample_id, id, string_agg(clade, '/' ORDER BY clade) AS call FROM best GROUP BY ALL"
CTES["score_labels"] = """SELECT sample_id, s.id, clade, manhattan, naming_system,
    CASE WHEN manhattan = floor(manhattan) THEN manhattan::BIGINT::VARCHAR ELSE manhattan::VARCHAR END AS score
    FROM scores s LEFT JOIN systems USING (id)"""
NEEDS["scores"] = ["states", "profiles"]
NEEDS["isolate_scores"] = ["isolate_states", "profiles"]
NEEDS["best"] = ["scores"]
NEEDS["isolate_best"] = ["isolate_scores"]
NEEDS["call_text"] = ["best"]
NEEDS["score_labels"] = ["scores", "systems"]


def _with(steps: list[str], body: str) -> str:
    ordered: list[str] = []

    def add(step: str) -> None:
        for need in NEEDS.get(step, []):
            add(need)
        if step not in ordered:
            ordered.append(step)

    for step in steps:
        add(step)
    return f"WITH {'RECURSIVE ' if {'folded', 'folded_any'} & set(ordered) else ''}" + ",\n".join(
        f"{s} AS ({CTES[s]})" for s in ordered
    ) + f"\n{body}"


def _wide(key: str, table: str, column: str, value: str, labels: dict) -> str:
    cells = ", ".join(
        f"max(CASE WHEN {column} = {l if isinstance(l, int) else repr(l)} THEN {value} END) AS \"{name}\""
        for l, name in labels.items()
    )
    return f"SELECT {key}, {cells} FROM {table} GROUP BY {key}"


def _pairs(interval: str) -> str:
    return f"""{interval} t JOIN reads r ON r.chrom = t.chrom AND r.start < t."end" AND t.start < r."end" """


BY_POS = {p: str(p) for p in refdata.POSITIONS}
SYSTEM_LABELS = {label: label for label in refdata.SYSTEM_LABELS_BY_ID.values()}
SCORE_COLUMNS = {
    f"{s}:{c}": f"{s}:{c}" for s in sorted(refdata.CLADE_SUBSTITUTIONS) for c in sorted(refdata.CLADE_SUBSTITUTIONS[s])
}
COLOUR_OF_BASE = "CASE alt " + " ".join(
    f"WHEN '{b}' THEN '{c}'" for b, c in refdata.NUCLEOTIDE_COLOURS.items()
) + f" ELSE '{refdata.PLAIN_COLOUR}' END"

TARGET_COVERAGE = f"""
, regions AS ({bridge.REGIONS}),
clipped AS (SELECT r.sample_id, t.chrom, t.start, t."end", greatest(t.start, r.start) AS lo,
    least(t."end", r."end") AS hi FROM {_pairs("regions")}),
gaps AS (SELECT *, greatest(hi - greatest(lo, coalesce(max(hi) OVER (PARTITION BY sample_id, chrom, start, "end"
    ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo)), 0) AS added FROM clipped),
summed AS (SELECT sample_id, chrom, start, "end", count(*) AS n, sum(added) AS covered FROM gaps GROUP BY ALL)
SELECT s.sample_id, t.chrom, t.start, t."end", coalesce(n, 0)::BIGINT AS n_covering_frags,
    coalesce(covered, 0)::BIGINT AS n_covered_bases, t."end" - t.start AS size,
    coalesce(covered, 0)::DOUBLE / (t."end" - t.start) AS frac_covered
FROM samples s CROSS JOIN regions t LEFT JOIN summed x
    ON x.sample_id = s.sample_id AND x.chrom = t.chrom AND x.start = t.start AND x."end" = t."end"
"""

# Every named line on its own; a target without a base has no reads.
NAMED_TARGET_COVERAGE = f"""
, lines AS ({bridge.NAMED_TARGETS}),
regions AS (SELECT DISTINCT chrom, start, "end" FROM lines),
clipped AS (SELECT r.sample_id, t.chrom, t.start, t."end", greatest(t.start, r.start) AS lo,
    least(t."end", r."end") AS hi FROM {_pairs("regions")} AND t.start < t."end"),
gaps AS (SELECT *, greatest(hi - greatest(lo, coalesce(max(hi) OVER (PARTITION BY sample_id, chrom, start, "end"
    ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo)), 0) AS added FROM clipped),
summed AS (SELECT sample_id, chrom, start, "end", count(*) AS n, sum(added) AS covered FROM gaps GROUP BY ALL)
SELECT s.sample_id, t.chrom, t.start, t."end", t.name, coalesce(n, 0)::BIGINT AS n_covering_frags,
    coalesce(covered, 0)::BIGINT AS n_covered_bases, t."end" - t.start AS size,
    coalesce(covered, 0)::DOUBLE / nullif(t."end" - t.start, 0) AS frac_covered
FROM samples s CROSS JOIN lines t LEFT JOIN summed x
    ON x.sample_id = s.sample_id AND x.chrom = t.chrom AND x.start = t.start AND x."end" = t."end"
"""

DEPTH_RUNS = """
, steps AS (
    SELECT sample_id, chrom, start AS p, 1 AS d FROM reads UNION ALL
    SELECT sample_id, chrom, "end" AS p, -1 AS d FROM reads UNION ALL
    SELECT sample_id, chrom, 0 AS p, 0 AS d FROM samples CROSS JOIN contigs UNION ALL
    SELECT sample_id, chrom, length AS p, 0 AS d FROM samples CROSS JOIN contigs),
summed AS (SELECT sample_id, chrom, p, sum(d) AS d FROM steps GROUP BY ALL),
swept AS (SELECT *, sum(d) OVER w AS depth, lead(p) OVER w AS nxt FROM summed
    WINDOW w AS (PARTITION BY sample_id, chrom ORDER BY p)),
marked AS (SELECT *, CASE WHEN depth = lag(depth) OVER (PARTITION BY sample_id, chrom ORDER BY p)
    THEN 0 ELSE 1 END AS opens FROM swept WHERE nxt IS NOT NULL),
islands AS (SELECT *, sum(opens) OVER (PARTITION BY sample_id, chrom ORDER BY p) AS island FROM marked),
runs AS (SELECT sample_id, chrom, min(p)::BIGINT AS start, max(nxt)::BIGINT AS "end", min(depth)::BIGINT AS depth
    FROM islands GROUP BY sample_id, chrom, island)
SELECT * FROM runs
"""


def _decomposed(table: str) -> str:
    return f"""SELECT sample_id, chrom, pos, ref, alt, qual, pos + i - 1 AS pos_c,
    CASE WHEN length(ref) = 1 THEN ref ELSE substr(ref, i, 1) END AS ref_c,
    CASE WHEN length(ref) = 1 THEN alt ELSE substr(alt, i, 1) END AS alt_c
    FROM (SELECT *, unnest(range(1, 1 + CASE WHEN length(ref) = 1 THEN 1
      ELSE least(length(ref), length(alt)) END)) AS i FROM {table}) t"""


VARIANT_STATES = f"""
, mutations AS (SELECT sample_id, chrom, pos_c AS pos, alt_c AS alt FROM ({_decomposed("filtered")}) d)
SELECT sample_id, chrom, pos, n_covering_frags, m.ref,
    CASE WHEN n_covering_frags < 8 THEN '?' WHEN c.alt IS NULL THEN m.ref ELSE c.alt END AS alt,
    CASE WHEN c.alt IS NOT NULL THEN 'yes' END AS is_mutated, m.ref AS original_ref
FROM coverage LEFT JOIN mutations c USING (sample_id, chrom, pos) LEFT JOIN markers m USING (chrom, pos)
"""

TRANSITIONS = "SELECT run_id, event_id, ts, status, previous, applied FROM folded"
STOPS = """SELECT f.run_id, f.event_id, f.ts, f.status FROM folded f JOIN folded b ON b.run_id = f.run_id AND b.k = f.k - 1
    WHERE b.state = 'stopped' AND f.status IN ('succeeded', 'failed')"""

PAIR = r"([^/]*)_R([12])\.fastq\.gz$"
READ_PAIRS = f"""
SELECT sample_id, max(CASE WHEN mate = '1' THEN path END) AS r1, max(CASE WHEN mate = '2' THEN path END) AS r2
FROM (SELECT path, regexp_extract(path, '{PAIR}', 1) AS sample_id, regexp_extract(path, '{PAIR}', 2) AS mate
      FROM read_files WHERE regexp_matches(path, '{PAIR}')) t
GROUP BY sample_id HAVING count(*) = 2 AND count(DISTINCT mate) = 2
"""

LAST_STATUS = "SELECT run_id, status, message FROM last"
ACTIONS = """SELECT run_id, status, CASE WHEN status = 'initiated' THEN 'retract' WHEN status = 'running' THEN 'stop'
    WHEN status IN ('retracted', 'initiation-failed', 'succeeded', 'failed', 'stopped') THEN 'remove' END AS action
    FROM last"""
PENDING = "SELECT run_id, created FROM last WHERE status = 'initiated' ORDER BY created, run_id"

SQL = {
    "marker_targets": f'SELECT chrom, pos - 1 AS start, pos AS "end" FROM ({bridge.PART_MARKERS}) m',
    "reads_sorted": _with(["reads"], """SELECT sample_id, chrom, start, "end", mapq, sample_id AS read_group
        FROM reads"""),
    "reads_in_region": _with(["reads"], f"""SELECT sample_id, chrom, start, "end", mapq, sample_id AS read_group FROM reads
        WHERE chrom = '{refdata.CONTIG}' AND start < {bridge.REGION[1]} AND "end" > {bridge.REGION[0]}"""),
    "target_coverage": _with(["samples", "reads"], TARGET_COVERAGE),
    "named_target_coverage": _with(["samples", "reads"], NAMED_TARGET_COVERAGE),
    "coverage_by_position": _with(["coverage"], "SELECT * FROM coverage"),
    "wide_panel_fragments": _with(["reads", "samples"], f""", targets AS (SELECT DISTINCT * FROM ({bridge.PART_TARGETS}) p),
        hits AS (SELECT r.sample_id, t.chrom, t.start, t."end", count(*)::BIGINT AS n
          FROM {_pairs("targets")} GROUP BY r.sample_id, t.chrom, t.start, t."end")
        SELECT s.sample_id, t.chrom, t.start, t."end", coalesce(n, 0) AS n_covering_frags
        FROM samples s CROSS JOIN targets t LEFT JOIN hits h
          ON h.sample_id = s.sample_id AND h.chrom = t.chrom AND h.start = t.start AND h."end" = t."end" """),
    "marker_coverage": _with(["coverage"], "SELECT * FROM coverage"),
    "depth_runs": _with(["samples", "reads", "contigs"], DEPTH_RUNS),
    "uncovered_intervals": _with(["samples", "reads", "contigs"], DEPTH_RUNS.rstrip()
                                 + " WHERE depth < 1 AND chrom LIKE 'MN908947%'"),
    "variants_filtered": _with(["filtered"], "SELECT * FROM filtered"),
    "variants_decomposed": _with(["filtered"], _decomposed("filtered")),
    "variants_decomposed_multiallelic": _with(["filtered_split"], _decomposed("filtered_split")),
    "variant_marker_states": _with(["coverage", "filtered"], VARIANT_STATES),
    "pileup_counts": _with(["pileup"], "SELECT * FROM pileup"),
    "haploid_calls": _with(["calls"], "SELECT * FROM calls"),
    "haploid_calls_legacy": _with(["bases", "markers"], """SELECT sample_id, chrom, pos, ref, base AS alt,
        depth::BIGINT AS depth, n::BIGINT AS alt_count FROM (
          SELECT *, sum(n) OVER s AS depth, row_number() OVER (s ORDER BY n DESC, base) AS k
          FROM (SELECT sample_id, chrom, pos, base, count(*) AS n FROM bases GROUP BY ALL) c
          WINDOW s AS (PARTITION BY sample_id, chrom, pos)) t
        JOIN markers USING (chrom, pos) WHERE k = 1 AND base <> ref"""),
    "genotype_costs": _with(["costs"], "SELECT * FROM costs"),
    "haploid_likelihoods": _with(["likely"], "SELECT * FROM likely"),
    "likely_marker_states": _with(["coverage", "likely"], """SELECT sample_id, chrom, pos, n_covering_frags, m.ref,
        CASE WHEN n_covering_frags < 8 THEN '?' WHEN c.alt IS NULL THEN m.ref ELSE c.alt END AS alt,
        CASE WHEN c.alt IS NOT NULL THEN 'yes' END AS is_mutated, m.ref AS original_ref
        FROM coverage LEFT JOIN (SELECT sample_id, chrom, pos, alt FROM likely WHERE qual > 10) c USING (sample_id, chrom, pos)
        LEFT JOIN markers m USING (chrom, pos)"""),
    "marker_states": _with(["states"], "SELECT * FROM states"),
    "complete_samples": f"""WITH outputs AS ({bridge.STEP_OUTPUTS}) SELECT sample_id FROM outputs WHERE step = 'coverage'
        AND sample_id IN (SELECT sample_id FROM outputs WHERE step = 'mutations')""",
    "profiles_long": _with(["isolate_long"], """SELECT 'isolates' AS id, seqname AS clade, pos, allele AS alt
        FROM isolate_long"""),
    "profiles_by_system": _with(["isolate_long"], """SELECT CASE CAST(right(seqname, 3) AS INT) % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'second'
          ELSE 'third' END AS id, seqname AS clade, chrom, pos, allele AS alt FROM isolate_long"""),
    "clade_scores": _with(["scores"], "SELECT * FROM scores"),
    "customer_scores": _with(["states", "isolate_long"], """SELECT s.sample_id, 'customers' AS id, p.seqname AS clade,
        CASE WHEN count(x.alt) = count(*) THEN sum(CASE WHEN x.alt = '?' THEN 0.5e0 WHEN x.alt <> p.alt THEN 1e0
          ELSE 0e0 END) END AS manhattan
        FROM (SELECT DISTINCT sample_id FROM states) s CROSS JOIN (SELECT seqname, pos, coalesce(allele, 'N') AS alt
          FROM isolate_long) p
        LEFT JOIN states x ON x.sample_id = s.sample_id AND x.pos = p.pos
        GROUP BY s.sample_id, p.seqname"""),
    "isolate_scores": _with(["isolate_scores"], "SELECT * FROM isolate_scores"),
    "best_clades": _with(["isolate_best"], "SELECT * FROM isolate_best"),
    "clade_calls": _with(["call_text"], "SELECT * FROM call_text"),
    "clade_calls_cutoff": _with(["isolate_scores"], """SELECT sample_id, id, min(manhattan) AS min_score,
        CASE WHEN min(manhattan) >= 4 THEN '-' ELSE string_agg(clade || '(' || CASE WHEN manhattan = floor(manhattan)
          THEN manhattan::BIGINT::VARCHAR ELSE manhattan::VARCHAR END || ')', ' or ' ORDER BY clade) END AS call
        FROM (SELECT *, rank() OVER (PARTITION BY sample_id, id ORDER BY manhattan) AS k FROM isolate_scores
              WHERE manhattan IS NOT NULL) t
        WHERE k = 1 GROUP BY sample_id, id"""),
    "cohort_states": _with(["states", "isolate_states"], "SELECT * FROM states UNION ALL SELECT * FROM isolate_states"),
    "cohort_scores": _with(["scores", "isolate_scores"],
                           "SELECT * FROM scores UNION ALL SELECT * FROM isolate_scores"),
    "marker_profiles": _with(["states"], _wide("sample_id", "states", "pos", "alt", BY_POS)),
    "marker_coverages": _with(["states"], _wide("sample_id", "states", "pos", "n_covering_frags", BY_POS)),
    "clade_calls_wide": _with(["call_text", "systems"], _wide(
        "sample_id", "(SELECT * FROM call_text JOIN systems USING (id)) t", "naming_system", "call", SYSTEM_LABELS)),
    "score_matrix": _with(["scores"], _wide(
        "sample_id", "scores", "concat(id, ':', clade)", "manhattan", SCORE_COLUMNS)),
    "part_marker_profiles": _with(["reads", "samples", "filtered"], f""", panel_markers AS ({bridge.NATION_MARKERS}),
        found AS (SELECT s.sample_id, m.chrom, m.pos, m.ref, count(r.start) AS n FROM samples s CROSS JOIN panel_markers m
          LEFT JOIN reads r ON r.sample_id = s.sample_id AND r.chrom = m.chrom AND r.start < m.pos AND r."end" >= m.pos
          GROUP BY ALL),
        changed AS (SELECT DISTINCT sample_id, chrom, pos_c AS pos, alt_c AS alt FROM ({_decomposed("filtered")}) d
          WHERE alt_c = 'A'),
        panel_states AS (SELECT sample_id, chrom || ':' || pos AS marker,
          CASE WHEN n < 8 THEN '?' WHEN c.alt IS NULL THEN ref ELSE c.alt END AS alt
          FROM found LEFT JOIN changed c USING (sample_id, chrom, pos))
        """ + _wide("sample_id", "panel_states", "marker", "alt", {f"{c}:{p}": f"{c}:{p}" for c, p in bridge.NATION_SITES})),
    "wide_marker_coverages": _with(["reads", "samples"], f""", dense_markers AS ({bridge.DENSE_MARKERS}),
        dense_coverage AS (SELECT s.sample_id, m.chrom || ':' || m.pos AS site, count(r.start)::BIGINT AS n_covering_frags
          FROM samples s CROSS JOIN dense_markers m
          LEFT JOIN reads r ON r.sample_id = s.sample_id AND r.chrom = m.chrom AND r.start < m.pos AND r."end" >= m.pos
          GROUP BY ALL)
        """ + _wide("sample_id", "dense_coverage", "site", "n_covering_frags", {f"{c}:{p}": f"{c}:{p}" for c, p in bridge.DENSE_SITES})),
    "score_cells": _with(["score_labels", "colours"], f"""SELECT sample_id, id, clade,
        CASE WHEN is_best IS NOT NULL THEN score END AS score, is_best,
        color AS clade_color, CASE WHEN is_best THEN '{refdata.BEST_SCORE_COLOUR}' END AS cell_color
        FROM (SELECT *, CASE WHEN count(*) OVER g = count(manhattan) OVER g
                THEN manhattan = min(manhattan) OVER g END AS is_best
              FROM score_labels WINDOW g AS (PARTITION BY sample_id, id)) s
        LEFT JOIN colours USING (id, clade)"""),
    "column_groups": _with(["score_labels"], """, m AS (SELECT *, CASE WHEN naming_system = lag(naming_system)
          OVER w THEN 0 ELSE 1 END AS opens, row_number() OVER w AS k FROM score_labels
          WINDOW w AS (PARTITION BY sample_id ORDER BY id, manhattan, clade)),
        g AS (SELECT *, sum(opens) OVER (PARTITION BY sample_id ORDER BY k) AS run FROM m)
        SELECT sample_id, run::BIGINT AS run, naming_system, count(*)::BIGINT AS length, max(k)::BIGINT AS "end"
        FROM g GROUP BY sample_id, run, naming_system"""),
    "profile_cells": _with(["states"], f"SELECT sample_id, chrom, pos, alt, {COLOUR_OF_BASE} AS color FROM states"),
    "coverage_cells": _with(["states"], f"""SELECT sample_id, chrom, pos, n_covering_frags, n_covering_frags < 10 AS is_low,
        CASE WHEN n_covering_frags < 10 THEN '{refdata.LOW_COVERAGE_COLOUR}' ELSE '{refdata.PLAIN_COLOUR}' END AS color
        FROM states"""),
    "isolate_alleles": _with(["markers"], """SELECT doc_id AS seqname, chrom, pos, ref,
        nullif(substr(text, pos, 1), '') AS allele FROM documents CROSS JOIN markers"""),
    "isolates_wide": _with(["isolate_long"], _wide(
        "seqname", "isolate_long", "pos", "allele", {p: f"pos_{p}" for p in refdata.POSITIONS})),
    "panel_alleles": _with(["panel"], "SELECT * FROM panel"),
    "panel_allele_counts": _with(["panel_counts"], "SELECT * FROM panel_counts"),
    "panel_allele_summary": _with(["panel_text"], "SELECT * FROM panel_text"),
    "panel_by_system": _with(["panel"], " UNION ALL ".join(
        f"SELECT '{c}' AS system, {c} AS clade, pos, allele, count(*)::BIGINT AS n FROM panel GROUP BY {c}, pos, allele"
        for c in ("clade", "gisaid_clade", "old_nextstrain_clade"))),
    "panel_matrix": _with(["panel_text"], _wide("clade", "panel_text", "pos", "alleles", BY_POS)),
    "base_composition": _with(["panel"], "SELECT pos, " + ", ".join(
        f"sum(CASE WHEN allele = '{b}' THEN 1 ELSE 0 END)::BIGINT AS \"{b}\"" for b in "ATCGN"
    ) + " FROM panel GROUP BY pos"),
    "read_pairs": _with(["read_files"], READ_PAIRS),
    "read_pairs_allowed": _with(["read_files"], f"SELECT * FROM ({READ_PAIRS}) p WHERE " + " AND ".join(
        f"NOT regexp_matches(sample_id, '{p}')" for p in bridge.BLACKLIST)),
    "read_pairs_not_listed": _with(["read_files"], f"""SELECT * FROM ({READ_PAIRS}) p WHERE NOT EXISTS (
        SELECT 1 FROM ({bridge.PATTERNS}) b WHERE regexp_matches(p.sample_id, b.pattern))"""),
    "read_pairs_off_long_list": _with(["read_files"], f"""SELECT * FROM ({READ_PAIRS}) p WHERE NOT EXISTS (
        SELECT 1 FROM ({bridge.MANY_PATTERNS}) b WHERE regexp_matches(p.sample_id, b.pattern))"""),
    "file_manifest": _with(["files"], r"""SELECT file_id, regexp_replace(name, '[^a-zA-Z0-9_.\-]', '_', 'g') AS name,
        substr(file_id, 1, 2) || '/' || substr(file_id, 3) AS path FROM files"""),
    "file_sizes": _with(["files", "listing"], """SELECT f.file_id, f.name, l.size FROM files f
        LEFT JOIN listing l USING (file_id)"""),
    "project_files": _with(["projects", "project_files", "files"], """SELECT project_id, p.name AS project_name,
        file_id, f.name AS file_name, f.size FROM projects p JOIN project_files USING (project_id)
        JOIN files f USING (file_id)"""),
    "account_tree": _with(["accounts", "projects", "account_projects", "account_runs", "last"], """
        , children AS (
          SELECT account_id, 'project' AS kind, project_id AS child_id, name, CAST(NULL AS VARCHAR) AS status
          FROM account_projects JOIN projects USING (project_id) UNION ALL
          SELECT account_id, 'run' AS kind, a.run_id AS child_id, 'run-project (' || l.run_id || ')' AS name, status
          FROM account_runs a LEFT JOIN last l ON l.run_id = a.run_id)
        SELECT account_id, email, kind, child_id, name, status FROM accounts LEFT JOIN children USING (account_id)"""),
    "run_files": _with(["last", "files"], rf""", links AS ({bridge.RUN_FILES})
        SELECT run_id, file_id, regexp_replace(name, '[^a-zA-Z0-9_.\-]', '_', 'g') AS file_name,
        substr(file_id, 1, 2) || '/' || substr(file_id, 3) AS path, size
        FROM last JOIN links USING (run_id) JOIN files USING (file_id)"""),
    "account_by_id": _with(["accounts"], f"SELECT * FROM accounts WHERE account_id = '{bridge.SOME_ACCOUNT}'"),
    "account_counts": _with(["accounts", "account_projects", "account_runs"], """SELECT account_id,
        (SELECT count(*) FROM account_projects p WHERE p.account_id = a.account_id)::BIGINT AS n_projects,
        (SELECT count(*) FROM account_runs r WHERE r.account_id = a.account_id)::BIGINT AS n_runs FROM accounts a"""),
    "active_links": _with(["account_projects"], f"""SELECT * FROM account_projects WHERE (account_id, project_id)
        NOT IN (SELECT (account_id, project_id) FROM ({bridge.REMOVED_PROJECTS}) r)"""),
    "earliest_projects": _with(["projects"], """SELECT project_id, name, created FROM (
        SELECT *, dense_rank() OVER (ORDER BY created) AS k FROM projects) t WHERE k <= 5"""),
    "run_status": _with(["last"], "SELECT run_id, status, message FROM last"),
    "run_status_asof": _with(["committed"], f""", before AS (SELECT * FROM committed WHERE ts <= TIMESTAMP '{bridge.AS_OF}')
        SELECT run_id, status, message FROM ({LAST.format(log="before")}) l"""),
    "run_actions": _with(["last"], ACTIONS),
    "pending_runs": _with(["last"], PENDING),
    "pending_from_store": _with(["last"], PENDING),
    "next_run": _with(["last"], PENDING + " LIMIT 1"),
    "run_transitions": _with(["folded"], TRANSITIONS),
    "run_transitions_any": _with(["folded_any"], "SELECT run_id, event_id, ts, status, previous, applied FROM folded_any"),
    "facts_with_commit_time": _with(["facts"], "SELECT * FROM facts"),
    "current_facts": _with(["current"], "SELECT * FROM current"),
    "pending_by_commit_time": _with(["current"], """SELECT entity, created FROM current WHERE status = 'initiated'
        ORDER BY created NULLS LAST, entity"""),
    "overwritten_stops": _with(["folded"], STOPS),
    "stream_scores": _with(["scores"], "SELECT * FROM scores"),
    "stream_run_status": _with(["last"], LAST_STATUS),
    "stream_gathered_scores": _with(["scores"], "SELECT * FROM scores"),
    "stream_judged_status": _with(["last"], LAST_STATUS),
    "parsed_variants": f"""SELECT chrom, pos, '.' AS id, ref, alt, qual, 'PASS' AS filter, 'DP=1' AS info, 'GT' AS format,
        '1' AS genotype, sample_id || CASE WHEN pos % 2 = 0 THEN '+b' ELSE '' END AS sample_id
        FROM ({bridge.VARIANTS}) v WHERE pos % 17 <> 0""",
    "parsed_target_coverage": f"""SELECT chrom, start, start + 1 AS "end", mapq AS n_covering_frags, 1 AS n_covered_bases,
        1 AS size, 0.5e0 AS frac_covered, sample_id FROM ({bridge.READS}) r""",
    "parsed_mutations": f"""SELECT pos, ref, alt, NULL::DOUBLE AS qual, pos AS pos_c, ref AS ref_c, alt AS alt_c, sample_id,
        chrom FROM ({bridge.VARIANTS}) v WHERE pos % 13 <> 0""",
    "parsed_markers": bridge.PART_MARKERS,
    "parsed_marker_states": f"""SELECT pos, 8 + pos % 9 AS n_covering_frags, ref, CASE WHEN qual IS NULL THEN '?' ELSE ref END AS alt,
        CASE WHEN qual IS NULL THEN 'yes' END AS is_mutated, ref AS original_ref, sample_id FROM ({bridge.VARIANTS}) v""",
    "parsed_profile_sheet": " UNION ALL ".join(f"""SELECT 'legacy' AS id, '{clade}' AS clade, p_partkey AS pos,
        substr('{alleles}', cast(1 + p_partkey % 4 as int), 1) AS alt FROM part""" for clade, alleles in (("X", "ACGT"), ("Y", "TTGA"))),
    "exported_marker_states": _with(["states"], "SELECT * FROM states"),
}
