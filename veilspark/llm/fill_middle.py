"""Fill-in-the-middle transformation of whole texts, and its inverse.

A text is cut at two random units into prefix, middle and suffix, and these are joined
by sentinels in one of two orders.  Cuts are bytes of the UTF-8 text inside and code
points outside; an index of exceptions turns one into the other: only characters of
several bytes are recorded, with their positions and the bytes in excess before them.
``searchsorted`` finds how many exceptions lie before a cut, so all else is arithmetic,
and a slice of ASCII texts has an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Words, flat, slices

#: The sentinels, and the parts of a hundred that are transformed and that have the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TRANSFORMED, SUFFIX_FIRST = 50, 80


class Exceptions:
    """Characters of several bytes in a flat buffer: where they begin, in bytes and in code points, and the excess bytes up to and with each."""

    def __init__(self, data: np.ndarray):
        lead = np.flatnonzero(data >= 0xC0)
        width = 1 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)  # bytes besides the first
        self.excess = np.append(0, np.cumsum(width, dtype=np.int64))
        self.byte = lead
        self.point = lead - self.excess[:-1]

    def to_points(self, byte: np.ndarray) -> np.ndarray:
        """The code points before each byte that begins a character, over the whole buffer."""
        return byte - self.excess[np.searchsorted(self.byte, byte)]

    def to_bytes(self, point: np.ndarray) -> np.ndarray:
        """The bytes before each code point, over the whole buffer."""
        return point + self.excess[np.searchsorted(self.point, point)]


def numbers(seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a seed and doc_id; those of a null id are of the seed alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def cuts(data: np.ndarray, off: np.ndarray, index: Exceptions, h1: np.ndarray, h2: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of every text, and the bytes of the buffer where prefix and middle end."""
    if unit == "char":
        base = index.to_points(off)
        n = np.diff(base)
        low, high = np.sort([h1 % (n + 1), h2 % (n + 1)], axis=0)
        return n, index.to_bytes(base[:-1] + low), index.to_bytes(base[:-1] + high)
    words = Words(data, off, SPACE)
    tail = np.zeros(len(off) - 1, bool)  # white space after the last word is a unit too
    full = np.flatnonzero(off[:-1] < off[1:])
    tail[full] = SPACE[data[off[full + 1] - 1]]
    n = words.count + tail
    ends = np.append(words.end, 0)

    def place(k: np.ndarray) -> np.ndarray:
        return np.where(k == 0, off[:-1], np.where(k > words.count, off[1:], ends[words.at[:-1] + np.maximum(k, 1) - 1]))

    low, high = np.sort([h1 % (n + 1), h2 % (n + 1)], axis=0)
    return n, place(low), place(high)


def transform(docs: DataFrame, seed: int = 42, unit: str = "token", transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every whole text.

    ``unit`` is ``token`` (a word with the white space before it; white space at the end
    is one more) or ``char`` (a code point).  ``transformed`` of a hundred texts get the
    form ``spm`` or ``psm``, and ``suffix_first`` of a hundred of these ``spm``; empty
    texts and those that hold a sentinel stay ``plain``, with null counts.  A null text
    is an empty one.  The draw depends on seed and doc_id only: repeated rows repeat
    their result, and rows without an id share one draw.  Other columns are ignored.
    """
    if unit not in ("token", "char"):
        raise ValueError(f"unit must be token or char, not {unit}")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                column = pc.fill_null(part.column("text"), "")
                data, off = flat(column)
                h1, h2, h3, h4 = (part.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4))
                index = Exceptions(data)
                n, low, high = cuts(data, off, index, h1, h2, unit)
                plain = (np.diff(off) == 0) | (h3 % 100 >= transformed)
                for s in (PREFIX, SUFFIX, MIDDLE):
                    plain |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
                spm = h4 % 100 < suffix_first
                begin, first, second = index.to_points(off[:-1]), index.to_points(low), index.to_points(high)
                raw, output = data.tobytes(), []
                p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
                for a, b, c, d, as_is, turned in zip(off[:-1].tolist(), low.tolist(), high.tolist(), off[1:].tolist(), plain.tolist(), spm.tolist(), strict=True):
                    output.append(raw[a:d] if as_is else b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c]) if turned else (p, raw[a:b], s, raw[c:d], m, raw[b:c])))
                form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(first - begin, pa.int64(), mask=plain), pa.array(second - first, pa.int64(), mask=plain), pa.array(output, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *numbers(seed)).mapInArrow(apply, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored() -> Column:
    """The text that ``output`` and ``form`` were made of; the text has no sentinel, so each is found where it was put."""
    part = F.split("output", f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    whole = F.when(F.col("form") == "spm", F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))).otherwise(F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2))))
    return F.when(F.col("form") == "plain", F.col("output")).otherwise(whole)


def digest(docs: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    return transform(docs, seed).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored().cast("binary"), 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b, CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4 FROM d),
p AS (SELECT doc_id, n, t, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 50 THEN 'plain' WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form,
 array_to_string(u[1:least(a, b)], '') AS f, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM x)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(f) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || f || '<M>' || m ELSE '<P>' || f || '<S>' || s || '<M>' || m END) AS output_sha256,
 sha256(CASE form WHEN 'plain' THEN t ELSE f || m || s END) AS restored_sha256 FROM p
"""
