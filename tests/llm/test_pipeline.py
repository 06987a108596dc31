"""The pipeline's stages one by one: each is judged on what it was given."""

import hashlib

import corpus_pipeline
from cladespark.llm import packing, quality_rules
from cladespark.llm.common import stored
from tests.conftest import rows_of
from tests.llm import test_lines, test_mixing, test_ngram_join

SF_DIR = "/root/testdata/sf0.001"


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    given, results = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, given, SF_DIR), "test-stage")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        results.append(out)
        given = out
    good, lines, single, mixed = results

    kept = quality_rules.score(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet")).where("kept")
    assert rows_of(good, "doc_id") == rows_of(kept, "doc_id") and 0 < good.count() < docs.count()
    assert rows_of(good) == rows_of(docs.join(good.select("doc_id"), "doc_id").select(docs.columns))

    want = {r[0]: r[3] for r in test_lines.expected(pairs(good))}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in pairs(lines)} == want
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    groups = {i: g for i, _, g in test_ngram_join.expected(pairs(lines))}
    assert sorted(i for i, _ in pairs(single)) == sorted({g for g in groups.values()})
    assert set(rows_of(single)) <= set(rows_of(lines))

    source = {r["doc_id"]: (r["source"], r["text"]) for r in single.collect()}
    taken = {}
    for i, text in pairs(mixed):
        taken[i] = taken.get(i, 0) + len(text.split())
    found = [{"doc_id": i, "size": test_mixing.words(t), "source_size": None, "target": None, "taken": taken.get(i, 0)} for i, (_, t) in source.items()]
    sizes = {}
    for i, (s, t) in source.items():
        sizes[s] = sizes.get(s, 0) + test_mixing.words(t)
    targets = test_mixing.targets(sizes)
    for s, target in targets.items():
        assert abs(sum(r["taken"] for r in found if source[r["doc_id"]][0] == s) - target) <= 40 + 0.01 * target
    assert all(r["taken"] <= 3 * r["size"] for r in found)

    packed = corpus_pipeline.STAGES[-1][1](spark, mixed, SF_DIR).collect()
    assert sum(r["length"] for r in packed) == sum(r["doc_tokens"] for r in packed if r["start"] == 0)
    assert {r["doc_id"] for r in packed} == {i for i, _ in pairs(mixed)}
    filled = {}
    for r in packed:
        filled[r["sequence_id"]] = filled.get(r["sequence_id"], 0) + r["length"]
    assert sum(n < 1024 for n in filled.values()) <= 1 and max(filled.values()) <= 1024


def test_one_of_each_group_where_ids_repeat_or_are_null(spark, documents, prose):
    a, b, c, d = (prose(k, 200) for k in range(4))
    groups = [
        [(5, a), (5, a + " more"), (5, a + " and more"), (9, a)],  # one id, several texts
        [(None, b), (None, b + " more")],
        [(None, c), (7, c + " more")],
        [(5, d)],  # the id of another group
        [(20, "")], [(21, None)], [(None, "")],
    ]
    rows = [r for g in groups for r in g] + [(5, a)]
    docs = documents(rows)
    out = corpus_pipeline.one_of_each_group(spark, docs, SF_DIR)
    assert out.columns == docs.columns
    staying = pairs(out)
    assert len(staying) == len(groups) and all(sum(r in g for r in staying) == 1 for g in groups)
    assert [next(i for i, t in staying if (i, t) in g) for g in groups] == [5, None, 7, 5, 20, 21, None]


def test_stages_on_awkward_tables(spark, documents, awkward):
    """Null ids and texts, very long texts, repeated rows, columns with clashing names; and a table without rows."""
    for rows in (awkward, []):
        given = documents(rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stored(stage(spark, given, SF_DIR), "awkward-stage")
            assert out.columns == given.columns, name
            assert all(r["digest"] == "x" and r["first"] == "x" for r in out.collect())
            if name == "line dedup":
                assert out.count() == len(rows)
            elif name != "mixing":
                assert out.count() <= len(rows)
            # Each stage is given all rows, not what little the one before it leaves here.
        packed = corpus_pipeline.STAGES[-1][1](spark, given, SF_DIR)
        assert sum(r["start"] == 0 for r in packed.collect()) == len(rows)


def test_run_is_all_stages(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.columns == [c.split()[0] for c in packing.PACKED.split(", ")] and out.count() > 0
