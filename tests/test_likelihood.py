"""Genotype likelihoods against sums of logarithms."""

import math
import random

import pytest

from cladespark.operators import likelihood, variants
from tests.conftest import rows_of

BASES = "sample_id string, chrom string, pos long, base string, bq int, mapq int"


def expected(rows, reference, theta=0.001, min_depth=10, min_alt=5):
    """Posterior of every genotype from plain probabilities."""
    sites = {}
    for sample, chrom, pos, base, bq, mapq in rows:
        if mapq >= 10 and bq is not None and bq >= 15 and base in "ACGT":
            sites.setdefault((sample, chrom, pos), []).append((base, bq))
    out = {}
    for (sample, chrom, pos), reads in sites.items():
        ref = reference.get((chrom, pos))
        if ref is None:
            continue
        logs = {}
        for g in "ACGT":
            logs[g] = math.log10(1 - theta if g == ref else theta / 3)
            for base, bq in reads:
                e = 10 ** (-bq / 10)
                logs[g] += math.log10(1 - e if base == g else e / 3)
        best = max("ACGT", key=lambda g: (round(logs[g], 9), -ord(g)))
        total = sum(10 ** (v - logs[best]) for v in logs.values())
        n = sum(b == best for b, _ in reads)
        if best != ref and len(reads) >= min_depth and n >= min_alt:
            out[sample, chrom, pos] = (ref, best, 10 * (logs[best] - logs[ref] + math.log10(total)) if ref in "ACGT" else None, len(reads), n)
    return out


def test_calls_against_probabilities(table):
    rng = random.Random(2)
    reference = {("c", p): rng.choice("ACGT") for p in range(120)} | {("c", 120): "N"}
    rows = []
    for p in range(122):
        truth = rng.choice("ACGT")
        for _ in range(rng.choice([4, 30, 60])):
            rows.append(("s", "c", p, truth if rng.random() < rng.choice([0.5, 0.9]) else rng.choice("ACGTN"), rng.choice([None, 10, 15, 20, 41]), rng.choice([5, 30, 60])))
    out = likelihood.call_by_likelihood(
        likelihood.genotype_costs(table(BASES, rows)), table("chrom string, pos long, ref string", [(*k, v) for k, v in reference.items()])
    ).collect()
    want = expected(rows, reference)
    assert {(r.sample_id, r.chrom, r.pos) for r in out} == set(want) and len(out) > 10
    for r in out:
        ref, alt, qual, depth, n = want[r.sample_id, r.chrom, r.pos]
        assert (r.ref, r.alt, r.depth, r.alt_count) == (ref, alt, depth, n)
        # Each read's cost is rounded to a thousandth of a phred.
        assert r.qual == qual if qual is None else r.qual == pytest.approx(qual, abs=0.001 * depth + 0.002)
        assert 0 <= r.genotype_quality <= likelihood.HIGHEST


def test_costs_do_not_depend_on_order(table):
    rng = random.Random(3)
    rows = [("s", "c", p % 3, rng.choice("ACGT"), rng.randrange(0, 60), 60) for p in range(300)]
    first = rows_of(likelihood.genotype_costs(table(BASES, rows), min_base_quality=0))
    rng.shuffle(rows)
    assert rows_of(likelihood.genotype_costs(table(BASES, rows).repartition(7), min_base_quality=0)) == first


def test_equal_genotypes_go_to_the_first_base(table):
    rows = [("s", "c", 1, base, 30, 60) for base in "GT" * 20] + [("s", "c", 2, base, 30, 60) for base in "GA" * 20]
    reference = table("chrom string, pos long, ref string", [("c", 1, "A"), ("c", 2, "G")])
    called = likelihood.call_by_likelihood(likelihood.genotype_costs(table(BASES, rows)), reference)
    # At the second site the reference is as likely by its reads and likelier by its prior.
    assert rows_of(called, "pos", "ref", "alt", "alt_count") == [(1, "A", "G", 20)]
    assert called.first()["genotype_quality"] == pytest.approx(-10 * math.log10(0.5), abs=0.01)


def test_quality_feeds_the_filter_of_variants(table):
    rows = [("s", "c", 1, "T", 40, 60)] * 30 + [("s", "c", 2, "T", 15, 60)] * 5 + [("s", "c", 2, "C", 15, 60)] * 5
    reference = table("chrom string, pos long, ref string", [("c", 1, "C"), ("c", 2, "A")])
    called = likelihood.call_by_likelihood(likelihood.genotype_costs(table(BASES, rows)), reference, theta=0.1)
    assert rows_of(variants.normalise_variants(called, 90.0), "pos", "alt") == [(1, "T")]
    deep = table(BASES, [("s", "c", 1, "T", 60, 60)] * 20_000)
    sure = likelihood.call_by_likelihood(likelihood.genotype_costs(deep), reference).first()
    assert sure["genotype_quality"] == likelihood.HIGHEST and math.isfinite(sure["qual"]) and sure["qual"] > 1e6
