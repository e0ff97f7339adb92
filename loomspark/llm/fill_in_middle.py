"""Fill-in-the-middle examples, cut by a boundary set.

A text's code points are its units. Where they begin is a compressed set of byte positions (``boundaries``), so
both cuts are found by selecting in it, and the text is cut as bytes, without decoding it. All draws come from a
hash of the document's id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm import textarrays as ta
from loomspark.llm.boundaries import code_points
from loomspark.llm.tables import id_and_text

#: Markers of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Percentages of documents that are transformed, and of those that take the suffix first.
RATE, SUFFIX_FIRST = 90, 20

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, first_cut long, second_cut long, output string"


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four 32-bit numbers from the sha256 of the seed and the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def cut(text: bytes, doc_id: int | None, seed: int, marks: tuple[bytes, bytes, bytes], rate: int, suffix_first: int) -> tuple:
    """``(n, form, prefix_chars, middle_chars, first_cut, second_cut, output)`` of one text; cuts are byte positions."""
    starts = code_points(np.frombuffer(text, dtype=np.uint8))
    n = len(starts)
    one, two, share, order = draws(seed, doc_id)
    if not text or share % 100 >= rate or any(mark in text for mark in marks):
        return n, "plain", None, None, None, None, text
    first, second = sorted((one % (n + 1), two % (n + 1)))
    a, b = (starts.select(k) if k < n else len(text) for k in (first, second))
    prefix, suffix, middle = marks
    if order % 100 < suffix_first:
        form, output = "spm", b"".join((suffix, text[b:], prefix, text[:a], middle, text[a:b]))
    else:
        form, output = "psm", b"".join((prefix, text[:a], suffix, text[b:], middle, text[a:b]))
    return n, form, first, second - first, a, b, output


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """One row a document: ``(doc_id, n, form, prefix_chars, middle_chars, first_cut, second_cut, output)``.

    ``docs`` has ``doc_id`` and ``text``; other columns are left alone. ``n`` counts code points, and two of the
    n + 1 places between them are drawn by a hash of ``seed`` and doc_id. ``rate`` percent of the documents get form
    psm (prefix, suffix, middle) or, ``suffix_first`` percent of these, spm (suffix, prefix, middle), each part
    behind its mark. The others are plain, and so are texts that hold a mark, so that ``restored`` gives every text
    back exactly; they have null cuts.

    A null text counts as empty, and an empty text is plain with empty output. Prefix, middle or suffix may be
    empty. Repeated rows give repeated rows of the same result; rows without a doc_id all draw what the empty id
    draws. An empty table gives none. Marks must differ, and none may overlap itself or another.
    """
    if any(a[i:] == b[: len(a) - i] for a in marks for b in marks for i in range(a == b, len(a))) or not all(marks):
        raise ValueError("marks must not be empty or overlap")
    coded = tuple(m.encode() for m in marks)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in (c.split() for c in SCHEMA.split(", "))])
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, to, data, offsets in ta.text_chunks(batch.column(1)):
                content = data.tobytes()
                rows = [cut(content[offsets[i] : offsets[i + 1]], ids[at + i], seed, coded, rate, suffix_first) for i in range(to - at)]
                columns = [ids[at:to], *zip(*rows, strict=True)]
                arrays = [pa.array(c, pa.int64()) if f.type == pa.int64() else pa.array(c, pa.binary() if isinstance(c[0], bytes) else pa.string()).cast(f.type) for c, f in zip(columns, schema, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return id_and_text(docs).mapInArrow(scan, SCHEMA)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that a row of ``fill_in_middle`` was made from: each mark stands once in an output that isn't plain."""
    either = reduce(lambda a, b: f"{a}|{b}", (re.escape(m) for m in marks))
    part = lambda i: F.get(F.split(output, either, -1), F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
