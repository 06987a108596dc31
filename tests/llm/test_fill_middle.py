"""Fill-in-middle against a plain reading of its rules, and the rotations taken back."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cladespark.llm import fill_middle
from tests.conftest import rows_of

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.DOTALL)


def expected(doc_id, text, seed=1):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def found(docs, **options):
    out = fill_middle.original_texts(fill_middle.fill_in_middle(docs, **options))
    return rows_of(out, "rest.doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "text")


def test_awkward_texts(documents, awkward):
    rows = awkward + [(30, "has <P> in it"), (31, "<S>"), (32, "<M"), (33, "<" * 50), (34, "日本語 text " * 30), (35, "😀é" * 20)]
    rows += [(100 + i, f"a few words, no. {i}") for i in range(60)]
    assert found(documents(rows)) == sorted((expected(*r) for r in rows), key=repr)
    assert {r[2] for r in found(documents(rows))} == {"plain", "psm", "spm"}


def test_random_texts_and_another_seed(documents):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("abC é<>PSM\n1日", k=rng.randint(0, 200)))) for i in range(300)]
    assert found(documents(rows), seed=9) == sorted((expected(*r, seed=9) for r in rows), key=repr)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64])
def test_scans_and_swaps_of_any_size(monkeypatch, size):
    monkeypatch.setattr(fill_middle, "SCAN_BYTES", size)
    monkeypatch.setattr(fill_middle, "SWAP_BYTES", size)
    rng = random.Random(size)
    for _ in range(60):
        text = "".join(rng.choices("abé, 日", k=rng.randint(1, 90)))
        draws = (rng.randrange(1 << 32), rng.randrange(1 << 32), 0, rng.randrange(100))
        n, form, prefix, middle, output = fill_middle.transformed(text.encode(), draws)
        units = UNIT.findall(text)
        a, b = sorted(d % (n + 1) for d in draws[:2])
        assert (n, prefix, middle) == (len(units), len("".join(units[:a])), len("".join(units[a:b])))
        buffer = bytearray(output)
        fill_middle.restore(buffer, form)
        assert buffer.decode() == text


def test_rotation_exchanges_blocks_in_place():
    for n in range(9):
        for start in range(n + 1):
            for middle in range(start, n + 1):
                for end in range(middle, n + 1):
                    buffer = bytearray(range(n))
                    fill_middle.rotate(buffer, start, middle, end)
                    whole = list(range(n))
                    assert list(buffer) == whole[:start] + whole[middle:end] + whole[start:middle] + whole[end:]


def test_a_very_long_text(documents):
    text = "word, " * 700_000
    rows = [(i, text) for i in range(3)]
    assert found(documents(rows)) == sorted((expected(*r) for r in rows), key=repr)


def test_other_columns_stay(documents):
    out = fill_middle.fill_in_middle(documents([(1, "some text")]).withColumns({"n": F.lit("n"), "form": F.lit("f"), "h1": F.lit("h"), "output": F.lit("o")}))
    row = out.first()
    assert (row["rest"]["n"], row["rest"]["h1"], row["rest"]["output"], row["rest"]["k1"]) == ("n", "h", "o", "x")


def test_empty_table(documents):
    assert found(documents([])) == []
