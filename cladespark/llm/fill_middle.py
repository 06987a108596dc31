"""Fill-in-middle: a text's blocks exchanged in place around its cuts, and exchanged back without a copy of the text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cladespark.llm.common import blocks, table, text_or_empty

# The sentinels, and the first share in a hundred that stays plain or becomes spm.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20

SEED = 1
SCAN_BYTES = 1 << 20
SWAP_BYTES = 1 << 16
BLOCK_BYTES = 4 << 20
DRAWS = ("h1", "h2", "h3", "h4")
IS_LETTER = np.zeros(256, bool)
IS_LETTER[ord("A") : ord("Z") + 1] = IS_LETTER[ord("a") : ord("z") + 1] = True


def _scans(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Where each stretch of a text begins, and which of its bytes begin a token."""
    before = False
    for at in range(0, len(data), SCAN_BYTES):
        part = data[at : at + SCAN_BYTES]
        letter = IS_LETTER[part]
        yield at, ((part & 0xC0) != 0x80) & ~(letter & np.r_[before, letter[:-1]])
        before = letter[-1]


def count_tokens(data: np.ndarray) -> int:
    """Runs of ASCII letters, and every other code point by itself."""
    return sum(int(np.count_nonzero(begins)) for _, begins in _scans(data))


def token_offsets(data: np.ndarray, numbers: tuple[int, ...]) -> list[int]:
    """The bytes at which tokens begin, by their numbers in order; a number past the last token gives the end."""
    found, seen = [], 0
    for at, begins in _scans(data):
        here = int(np.count_nonzero(begins))
        if len(found) < len(numbers) and numbers[len(found)] < seen + here:
            starts = np.flatnonzero(begins)
            while len(found) < len(numbers) and numbers[len(found)] < seen + here:
                found.append(at + int(starts[numbers[len(found)] - seen]))
        seen += here
    return found + [len(data)] * (len(numbers) - len(found))


def _chars(data: np.ndarray) -> int:
    return sum(int(np.count_nonzero((data[at : at + SCAN_BYTES] & 0xC0) != 0x80)) for at in range(0, len(data), SCAN_BYTES))


def _reverse(view: np.ndarray, start: int, end: int) -> None:
    """Reverse [start, end) by swapping stretches from both ends; no more than a stretch is ever copied."""
    while end - start > 1:
        size = min(SWAP_BYTES, (end - start) // 2)
        head = view[start : start + size].copy()
        view[start : start + size] = view[end - size : end][::-1]
        view[end - size : end] = head[::-1]
        start, end = start + size, end - size


def rotate(buffer: bytearray, start: int, middle: int, end: int) -> None:
    """Exchange the blocks [start, middle) and [middle, end): each is reversed, then both as one."""
    view = np.frombuffer(buffer, np.uint8)
    _reverse(view, start, middle)
    _reverse(view, middle, end)
    _reverse(view, start, end)


def arrange(buffer: bytearray, first: int, second: int, form: str) -> None:
    """Insert the sentinels at the cuts and bring the blocks into the order of ``psm`` or ``spm``, in place."""
    buffer[second:second] = SUFFIX
    buffer[first:first] = MIDDLE
    buffer[0:0] = PREFIX
    middle = first + len(PREFIX)
    suffix = second + len(PREFIX) + len(MIDDLE)
    rotate(buffer, middle if form == "psm" else 0, suffix, len(buffer))


def restore(buffer: bytearray, form: str) -> None:
    """Undo ``arrange``: rotate the blocks back and take the sentinels out, in place."""
    if form == "plain":
        return
    if form == "psm":
        start, middle = buffer.find(SUFFIX), buffer.find(MIDDLE)
    else:
        start, middle = 0, buffer.find(PREFIX)
    rotate(buffer, start, middle, len(buffer))
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.find(sentinel)
        del buffer[at : at + len(sentinel)]


def transformed(text: bytes, draws: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, bytes]:
    """(tokens, form, code points of the prefix, of the middle, output) of one text and its four drawn numbers."""
    data = np.frombuffer(text, np.uint8)
    n = count_tokens(data)
    if not text or draws[2] % 100 >= PLAIN_FROM or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    form = "spm" if draws[3] % 100 < SPM_BELOW else "psm"
    first, second = token_offsets(data, tuple(sorted(d % (n + 1) for d in draws[:2])))
    buffer = bytearray(text)
    arrange(buffer, first, second, form)
    return n, form, _chars(data[:first]), _chars(data[first:second]), bytes(buffer)


def _transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, limit=BLOCK_BYTES):
        draws = zip(*[batch.column(c).to_pylist() for c in DRAWS], strict=True)
        texts = batch.column("text").cast(pa.binary())
        rows = [transformed(text.as_py(), numbers) for text, numbers in zip(texts, draws, strict=True)]
        n, form, prefix, middle, output = list(zip(*rows, strict=True)) or [()] * 5
        arrays = [
            batch.column("rest"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
            pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["rest", "n", "form", "prefix_chars", "middle_chars", "output"])


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "output", BLOCK_BYTES):
        texts = []
        for output, form in zip(batch.column("output").cast(pa.binary()), batch.column("form").to_pylist(), strict=True):
            buffer = bytearray(output.as_py())
            restore(buffer, form)
            texts.append(bytes(buffer))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*batch.schema.names, "text"])


def _draws(seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(c) for i, c in enumerate(DRAWS)]


def fill_in_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(rest, n, form, prefix_chars, middle_chars, output) of every row; ``rest`` is a struct of all columns but the text.

    A text is cut into tokens, runs of ASCII letters and single other code points. Two numbers drawn from the
    document's id cut it in three; a third decides whether it stays plain and a fourth the order of the
    others: ``psm`` is prefix, suffix, middle and ``spm`` suffix, prefix, middle, each after its sentinel. An empty or null text
    and one that holds a sentinel stay plain, without lengths. Rows with equal ids draw equal numbers, and a row without an
    id those of an empty one. A text of any length is scanned in stretches and changed in one buffer. No rows give no rows.
    Rows are independent: nothing is shuffled.
    """
    rest = F.struct(*[c for c in docs.columns if c != "text"]).alias("rest")
    rows = docs.select(rest, *_draws(seed), text_or_empty().alias("text"))
    longs = [StructField(c, LongType()) for c in ("n", "prefix_chars", "middle_chars")]
    strings = [StructField(c, StringType()) for c in ("form", "output")]
    return rows.mapInArrow(_transform, StructType([rows.schema["rest"], longs[0], strings[0], *longs[1:], strings[1]]))


def original_texts(filled: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with the text that each output was made of, from the output and its form alone."""
    return filled.mapInArrow(_restore, StructType([*filled.schema.fields, StructField("text", StringType())]))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = original_texts(fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{name}_sha256") for c, name in (("output", "output"), ("text", "restored"))]
    return filled.select(F.col("rest.doc_id").cast("long").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", *digests)


SQL = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
draws AS (
  SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM units),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
              THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM draws),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s
  FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
