"""Line dedup against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from cladespark.llm import line_dedup
from tests.conftest import rows_of

BLANK = " \t\n\x0b\x0c\r"


def expected(rows):
    keys = {}
    parsed = []
    for at, (i, text) in enumerate(rows):
        lines = [(x, x.strip(BLANK).encode().lower()) for x in (text or "").split("\n")]
        parsed.append((i, lines))
        for _, key in lines:
            if len(key.decode()) >= 20:
                keys.setdefault(key, {})[at] = i
    out = []
    for i, lines in parsed:
        kept = []
        for line, key in lines:
            holders = list(keys.get(key, {}).values())
            keep = max((x for x in holders if x is not None), default=None)
            if len(holders) < 3 or i == keep:
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(docs):
    out = line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs), digest=True)
    return rows_of(out, "rest.doc_id", "n_lines", "n_dropped", "text")


def test_awkward_texts(documents, awkward):
    shared = "  Shared LINE of more than twenty characters\t"
    rows = awkward + [(20 + i, f"own {i}\n{shared}\n{shared.upper()}\n") for i in range(4)]
    assert found(documents(rows)) == expected(rows)


def test_rows_that_repeat_an_id_are_documents_of_their_own(documents):
    """One id with several texts, a whole row three times, rows without an id: the operator, brute force and the SQL agree."""
    line = "a line that is long enough to be looked at"
    rows = [(1, f"{line}\none"), (1, f"{line}\ntwo"), (1, f"{line}\nthree"), (2, line)] + [(5, "another line of more than twenty\nx")] * 3
    rows += [(None, "the line that only rows without an id have")] * 4 + [(9, f"own\n{line}\n{line}")]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    by_sql = sorted(connection.execute(line_dedup.SQL).fetchall(), key=repr)
    assert found(documents(rows)) == expected(rows) == by_sql


@pytest.mark.parametrize("seed", [1, 2])
def test_random_documents(documents, seed):
    rng = random.Random(seed)
    pool = [f"Line number {i} with enough characters" for i in range(40)] + ["short", "", "é" * 19, "É" * 20]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 12)))) for i in range(120)]
    assert found(documents(rows)) == expected(rows)


def test_a_line_that_a_third_of_all_documents_hold(documents):
    rows = [(i, ("the line that very many documents have\n" if i % 3 == 0 else "") + f"a line that only document {i} has") for i in range(5000)]
    assert found(documents(rows)) == expected(rows)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_streaming_does_not_depend_on_batches(size):
    rng = random.Random(size)
    rows = sorted(((rng.randint(0, 30), 0, -rng.randint(0, 20)) for _ in range(200)))
    rows = [(h, 0, -d, at, 0, 9, [at]) for at, (h, _, d) in enumerate(rows)]
    table = pa.table({c: pa.array(v) for c, v in zip(("h1", "h2", "doc_id", "k1", "k2", "n_lines", "at"), zip(*rows))})
    out = [r["k1"] for b in line_dedup._drops(3)(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
    want = []
    for h in {r[0] for r in rows}:
        group = [r for r in rows if r[0] == h]
        want += [r[3] for r in group if len(group) >= 3 and r[2] != group[0][2]]
    assert sorted(out) == sorted(want)


def test_bitmaps_are_small_and_say_which_lines_stay(documents):
    rows = [(i, "\n".join(["a line that all the documents share"] * 500 + [f"own line of the document {i} stays"])) for i in range(4)]
    docs = documents(rows)
    maps = line_dedup.line_bitmaps(docs).collect()
    assert len(maps) == 3 and all(len(m["keep"]) < 40 and m["n_dropped"] == 500 for m in maps)
    assert np.flatnonzero(line_dedup.keep_of(maps[0]["keep"], 501)).tolist() == [500]


def test_empty_table(documents):
    assert found(documents([])) == []
