"""Many patterns against many names: the same names as by testing all pairs, and few pairs tested."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cladespark.operators import patterns
from tests.conftest import rows_of

REQUIRED = {
    "abc": "abc", "^abc$": "\x02abc\x03", "ab+c": "ab", "abc?d": "ab", "abc*": "ab", "a.bcd": "bcd", "[a-z]xyz": "xyz", "xy[^0]": "xy", r"ab\.cde": "cde",
    r"\d\dab": "ab", "ab{2}cd": "cd", "a|b": None, "(ab)c": "c", "P12(5|7)x": "P12", "ab(?:c|d)*xyz": "xyz", "a(b(c|d)e)fgh|x": None, "(a|b": None, "q(w(e)r)?tyu": "tyu", "ab(?=c)": None, r"ab\(c|d": None, "(?i)abc": None, "": None, ".*": None, "[a-c&&[b]]x": None, r"\Qa.b\E": None, r"\x41bc": None,
    "[]ab]cd": "cd", "a^b": "b", "a$b": "b", "^": "\x02", "$": "\x03", "ab+?cde": "cde", "x{1,3}?yz": "yz", "a[[b]]c": None, r"ab\$": "ab", "é日x": "é日x", "ab\\": None,
    r"\p{L}abc": None, "abcd++e": "abcd",
}


def test_required_text(table):
    found = table("pattern string", [(p,) for p in REQUIRED]).select("pattern", patterns.required_text(F.col("pattern"))).collect()
    assert {r[0]: r[1] for r in found} == REQUIRED


def matching(names, listed):
    return sorted({n for n in names for p in listed if p is not None and n is not None and re.search(p, n)})


@pytest.mark.parametrize("few", [0, 200])
@pytest.mark.parametrize("seed", range(4))
def test_random_patterns(table, monkeypatch, seed, few):
    monkeypatch.setattr(patterns, "FEW_PATTERNS", few)
    rng = random.Random(seed)
    names = ["".join(rng.choices("abP1.-", k=rng.randint(0, 9))) for _ in range(300)] + [None, "", "a\n", "ab1\n", "P1"]
    pieces = ["a", "b", "P", "1", "ab", "P1", r"\.", ".", "[ab]", "[^1]", r"\d", "a?", "b+", "1*", "(a|b)", "(?:P|b1)?", "((a)|1)+", "-{1,2}", "a{0}"]
    listed = ["".join(rng.choices(["", "^"]) + rng.choices(pieces, k=rng.randint(1, 5)) + rng.choices(["", "$"])) for _ in range(60)] + [None]
    out = patterns.matching_names(table("id string", [(n,) for n in names]), table("pattern string", [(p,) for p in listed]), "id")
    # Python's $ stands before a line feed at the end, as here.
    assert [r[0] for r in rows_of(out.distinct())] == sorted(matching(names, listed), key=repr)


def test_edge_tables(table):
    names, none = table("id string", [("a",), (None,)]), table("pattern string", [])
    assert rows_of(patterns.matching_names(names, none, "id")) == []
    assert rows_of(patterns.matching_names(names, table("pattern string", [("",)]), "id")) == [("a",)]
    assert rows_of(patterns.matching_names(names.limit(0), table("pattern string", [("a",)]), "id")) == []


def test_ten_thousand_patterns_are_not_tested_on_every_name(spark):
    names = spark.range(20_000).selectExpr("concat('P', lpad(id * 7919 % 1000000, 6, '0')) AS id")
    listed = spark.range(10_000).selectExpr("concat('^P', lpad(id * 104729 % 1000000, 6, '0'), '$') AS pattern")
    out = patterns.matching_names(names, listed, "id")
    held = {r[0] for r in names.collect()}
    assert {r[0] for r in out.collect()} == {r[0][1:-1] for r in listed.collect()} & held
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    rows = []

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind == "BroadcastHashJoinExec" and "pattern" in node.output().toString():
            rows.append(node.metrics().apply("numOutputRows").value())
        if kind.endswith("QueryStageExec"):
            walk(node.plan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(out._jdf.queryExecution().executedPlan())
    assert rows and max(rows) < 20_000 * 10_000 / 50


@pytest.mark.parametrize("most", [0, 500_000])
def test_patterns_that_share_three_characters_have_keys_of_their_own(spark, monkeypatch, most):
    """A thousand texts of three digits are not enough to tell 20,000 patterns apart."""
    monkeypatch.setattr(patterns, "BROADCAST_ROWS", most)
    names = spark.range(20_000).selectExpr("concat('P', lpad(id * 7919 % 1000000, 6, '0')) AS id")
    listed = spark.range(20_000).selectExpr("concat('^P', lpad(id * 104729 % 1000000, 6, '0'), '$') AS pattern")
    marked = listed.selectExpr("pattern", "translate(pattern, '^$', '\x02\x03') AS required")
    keys = marked.select("pattern", F.explode(patterns._grams(F.col("required"))).alias("gram"))
    assert [r[0] for r in keys.select(F.length("gram")).distinct().collect()] == [8]
    grams = patterns._name_grams(names, "id", [8])
    assert grams.join(keys, "gram").count() < 20 * 20_000
    held = {r[0] for r in names.collect()}
    assert {r[0] for r in patterns.matching_names(names, listed, "id").collect()} == {r[0][1:-1] for r in listed.collect()} & held
