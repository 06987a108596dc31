"""Archive writer and digest index: round trips, ties, copies, empty tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cladespark.llm import exact_dedup, warc
from cladespark.session import shared_folder
from tests.conftest import rows_of

PAGES = "page_id long, url string, html string"


def archived(spark, rows, **parameters):
    index = warc.write_warc(spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit(1)), shared_folder(spark, "archives"), **parameters)
    return index, {r["page_id"]: r for r in warc.read_warc(index).collect()}


def test_payloads_come_back_and_copies_are_revisits(spark):
    big, small = "<p>é</p>" * 200, "<p>same</p>"
    rows = [(1, "http://a/1", big), (5, None, big), (3, "http://a/ b\r\nX: y", big), (4, "u", small), (6, "u", small), (7, "", None), (8, "u", "x" * 1000)]
    index, found = archived(spark, rows)
    assert index.count() == len(rows) and set(found) == {1, 3, 4, 5, 6, 7, 8}
    for page_id, _, html in rows:
        data = (html or "").encode()
        r = found[page_id]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        if page_id in (1, 3):
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", 5, None)
        else:
            assert (r["record_type"], r["refers_to"], bytes(r["payload"])) == ("response", None, data)


def test_dictionary_leads_and_each_record_is_a_frame(spark):
    rows = [(i, f"http://host/{i}", f"<html><body>page number {i} of a site with much in common</body></html>" * 20) for i in range(400)]
    index, _ = archived(spark, rows, dictionary_bytes=4096)
    r = index.where("page_id = 123").first()
    fields, block = warc.read_record(r["file"], r["offset"], r["length"])
    assert fields["WARC-Record-ID"] == "<urn:page:123>" and block.endswith(rows[123][2].encode())
    store, place = warc.filesystem(r["file"])
    with store.open_input_file(place) as file:
        head = file.read(8)
    assert int.from_bytes(head[:4], "little") == warc.DICTIONARY_FRAME


def test_files_roll_and_a_damaged_one_is_noticed(spark):
    index, found = archived(spark, [(i, "u", str(i) * 3000) for i in range(20)], file_bytes=10_000)
    assert index.select("file").distinct().count() > 3 and len(found) == 20
    with pytest.raises(ValueError):
        next(warc.parse(__import__("io").BytesIO(b"not a record\r\n")))


def test_no_pages_and_null_ids(spark):
    index, found = archived(spark, [])
    assert index.count() == 0 and found == {}
    _, found = archived(spark, [(None, "u", "y" * 2000), (2, "u", "y" * 2000)])
    assert found[None]["refers_to"] == 2 and found[2]["record_type"] == "response"


def dedup(spark, docs, **parameters):
    return exact_dedup.exact_dedup(docs, exact_dedup.DigestIndex(spark, shared_folder(spark, "index")), **parameters)


def test_awkward_texts(spark, documents, awkward):
    found = dedup(spark, documents(awkward), batches=3).collect()
    assert len(found) == len(awkward)
    groups = {}
    for i, text in awkward:
        groups.setdefault(hashlib.sha256((text or "").encode()).hexdigest(), []).append(i)
    for r in found:
        ids = groups[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert r["doc_id"] in ids and r["group_size"] == len(ids)
        assert r["keep_id"] == max(known, default=None) and r["kept"] == (r["doc_id"] == r["keep_id"])


@pytest.mark.parametrize("batches", [1, 2, 3, 7])
def test_ids_at_the_ends_of_a_long(spark, documents, batches):
    low, high = -(1 << 63), (1 << 63) - 1
    for ids in ([low, low + 1, 0, high], [low, low + 2], [high, high - 1], [low]):
        rows = [(i, text) for i in ids for text in ("a", f"own {i}")]
        found = dedup(spark, documents(rows), batches=batches)
        assert rows_of(found, "doc_id", "keep_id", "kept") == sorted(
            ((i, max(ids) if text == "a" else i, i == max(ids) or text != "a") for i, text in rows), key=repr
        )


def test_the_query_leaves_no_table_behind(spark):
    before = {t.name for t in spark.catalog.listTables()}
    assert exact_dedup.op2_exact_dedup(spark, "/root/testdata/sf0.001").count() == 200
    assert {t.name for t in spark.catalog.listTables()} == before


def test_a_third_of_all_rows_in_one_group(spark, documents):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i}") for i in range(9000)]
    found = dedup(spark, documents(rows))
    assert found.where("kept").count() == 6001
    assert rows_of(found.where("text_sha256 = sha2('hot', 256)").select("keep_id", "group_size").distinct()) == [(8997, 3000)]


def test_index_outlives_its_session_object(spark, documents):
    place = shared_folder(spark, "index")
    exact_dedup.DigestIndex(spark, place, buckets=4).add(documents([(1, "a"), (2, "b")]))
    again = exact_dedup.DigestIndex(spark, place, buckets=4)
    assert rows_of(again.new(documents([(3, "b"), (4, "c"), (5, "c")])), "keep_id") == [(5,)]
    again.add(documents([(3, "b"), (4, "c")]))
    assert rows_of(again.table(), "keep_id") == [(1,), (2,), (4,)]
    assert rows_of(again.compact(shared_folder(spark, "index")).table()) == rows_of(again.table())


def test_new_texts_meet_the_index_without_moving_it(spark, documents):
    index = exact_dedup.DigestIndex(spark, shared_folder(spark, "index"), buckets=8)
    index.add(documents([(i, f"t{i}") for i in range(50)]))
    plan = index.new(documents([(1, "t1")]))._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("SortMergeJoin") :].split("FileScan parquet")[-1]
    assert "Bucketed: true" in side or "SelectedBucketsCount" in side
    assert plan.count("Exchange hashpartitioning") <= 2  # of the new side alone: to count, and into the buckets


def test_empty_table(spark, documents):
    assert dedup(spark, documents([])).count() == 0
