"""Panel design goldens."""

import random
import time

import pytest

from cladespark.functions import tables
from cladespark.operators import panel
from tests.conftest import rows_of


def test_alleles_from_sequences(table):
    sequences = table("seqname string, seq string", [("a", "ACGT"), ("b", "AC")])
    markers = table("chrom string, pos long, ref string", [("c", 1, "A"), ("c", 4, "T")])
    assert rows_of(panel.isolate_alleles(sequences, markers), "seqname", "pos", "allele") == [
        ("a", 1, "A"), ("a", 4, "T"), ("b", 1, "A"), ("b", 4, None)]


def test_wide_long_and_counts(table):
    alleles = table("seqname string, pos long, allele string",
                    [(f"i{i}", 241, a) for i, a in enumerate("TTC")] + [(f"i{i}", 1059, a) for i, a in enumerate("ACN")])
    wide = panel.isolates_wide(alleles, [241, 1059])
    assert wide.columns == ["seqname", "pos_241", "pos_1059"]
    clades = table("seqname string, gisaid_clade string, clade string, old_nextstrain_clade string",
                   [("i0", "G", "20A", "A2"), ("i1", "G", "20A", "A2"), ("i2", "G", "20A", "B")])
    long = panel.panel_alleles(wide, clades)
    assert long.count() == 6
    counts = panel.allele_counts(long)
    summary = panel.allele_summary(counts)
    assert rows_of(summary) == [("20A", 1059, "A=1 C=1 N=1"), ("20A", 241, "T=2 C=1")]
    matrix = panel.panel_matrix(summary, [1059, 241])
    assert matrix.columns == ["clade", "241", "1059"]
    assert ("old_nextstrain_clade", "A2", 241, "T", 2) in rows_of(panel.allele_counts_by_system(long))
    assert rows_of(panel.base_composition(long)) == [(1059, 1, 0, 1, 0, 1), (241, 0, 2, 1, 0, 0)]


def test_null_allele_makes_the_summary_null(table):
    counts = table("clade string, pos long, allele string, n long", [("x", 1, "A", 3), ("x", 1, None, 1), ("x", 2, "A", 1)])
    assert rows_of(panel.allele_summary(counts)) == [("x", 1, None), ("x", 2, "A=1")]


def test_isolate_without_clade_is_dropped(table):
    isolates = table("seqname string, pos_1 string", [("a", "A"), ("b", "C")])
    clades = table("seqname string, clade string", [("a", "x")])
    assert rows_of(panel.panel_alleles(isolates, clades)) == [("a", "x", 1, "A")]


def test_panels_of_several_contigs(table):
    """One position on two contigs is two columns, all the way to the matrix and back."""
    sites = [("c2", 5), ("c1", 5), ("c1", 40)]
    alleles = table("seqname string, chrom string, pos long, allele string",
                    [(f"i{i}", c, p, "ACGT"[(i + p + (c == "c2")) % 4]) for i in range(3) for c, p in sites])
    wide = panel.isolates_wide(alleles, sites)
    assert wide.columns == ["seqname", "pos_c1:5", "pos_c1:40", "pos_c2:5"]
    clades = table("seqname string, clade string", [(f"i{i}", "x") for i in range(3)])
    long = panel.panel_alleles(wide, clades)
    assert rows_of(long, "seqname", "chrom", "pos", "allele") == rows_of(alleles)
    matrix = panel.panel_matrix(panel.allele_summary(panel.allele_counts(long)), sites)
    assert matrix.columns == ["clade", "c1:5", "c1:40", "c2:5"]
    assert rows_of(matrix) == [("x", "C=1 G=1 T=1", "A=1 C=1 G=1", "A=1 G=1 T=1")]
    assert panel.base_composition(long).count() == 3
    with pytest.raises(Exception, match="no column is listed for _marker=c1:40"):
        panel.isolates_wide(alleles, sites[:2]).collect()


COLUMNS = [("c1", 7 * i) for i in range(2500)] + [("c2", 7 * i) for i in range(2500)]


def test_five_thousand_columns(table):
    """Cells of some sites of each sample, in any order; a NULL cell and an absent one are both NULL."""
    rng = random.Random(8)
    cells = {(f"s{i}", *site): rng.choice([None, i, 100 + i]) for i in range(6) for site in rng.sample(COLUMNS, rng.choice([1, 30, 5000]))}
    df = table("sample_id string, chrom string, pos long, n long", rng.sample([(*k, v) for k, v in cells.items()], len(cells)))
    began = time.monotonic()
    out = tables.spread_sites(df, ["sample_id"], "n", COLUMNS)
    assert out.columns == ["sample_id", *(f"{c}:{p}" for c, p in sorted(COLUMNS))]
    rows = out.collect()
    assert time.monotonic() - began < 60
    assert len(rows) == 6 and all(list(r)[1:] == [cells.get((r[0], *site)) for site in sorted(COLUMNS)] for r in rows)


@pytest.mark.parametrize("n", [5, 300])
def test_strays_and_duplicates_raise_at_any_width(table, n):
    labels = {f"k{i}": f"name `{i}`" for i in range(n)}
    schema = "id string, k string, v double"
    good = [("a", "k1", 1.0), ("a", "k3", None), ("b", f"k{n - 1}", 2.0)]
    out = tables.spread(table(schema, good), ["id"], "k", "v", labels)
    assert out.columns[1] == "name `0`" and {r[0]: r[2] for r in out.collect()} == {"a": 1.0, "b": None}
    for bad, message in ((("a", "k1", 5.0), "more than one row for k=k1"), (("c", "other", 1.0), "no column is listed for k=other"),
                         (("c", None, 1.0), "no column is listed for k=NULL")):
        with pytest.raises(Exception, match=message):
            tables.spread(table(schema, [*good, bad]), ["id"], "k", "v", labels).collect()
    folded = tables.spread(table(schema, [*good, ("a", "k1", 5.0)]), ["id"], "k", "v", labels, reject_duplicates=False)
    assert {r[0]: r[2] for r in folded.collect()} == {"a": 5.0, "b": None}
    assert tables.spread(table(schema, []), ["id"], "k", "v", labels).count() == 0
