"""Fill-in-the-middle: texts are cut at two units and their parts put in another order, marked by three sentinels.

A unit is a run of unaccented letters or any other single code point. While the units are counted a sparse index is
kept: at every STRIDE-th unit its byte and its code point. A cut finds its checkpoint by binary search and scans on from
there, STRIDE units at most, so no list of all units is held.

Where to cut and what form to take comes from four 32-bit numbers, the first four groups of eight digits of the hex
SHA-256 of `seed:id`: so rows agree whatever the number of tasks, and each epoch may have its seed. Forms: `psm` is
prefix, suffix, middle, each behind its sentinel; `spm` is suffix, prefix, middle; `plain` is the text as it is, if it is
empty, holds a sentinel itself, or by the share of texts that stay.

Defined cases: a null text is an empty one; a null id is an empty one in the hash, so all such rows take the same
numbers; two equal cuts give an empty middle; repeated rows give equal rows; an empty table gives no rows; columns named
like an output column are replaced.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import map_arrow, without

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units between two checkpoints.
STRIDE = 256
#: Bytes that are counted at once.
WINDOW = 1 << 20
UNIT = re.compile(rb"[A-Za-z]+|[\x00-\x7f]|[\xc2-\xf4][\x80-\xbf]+")


class Checkpoints:
    """The sparse index of a text in UTF-8: its number of units (`n`) and of code points, and where its units begin."""

    def __init__(self, body: bytes, stride: int = STRIDE):
        import numpy as np

        self.body, self.stride, self.n, self.chars = body, stride, 0, 0
        self.bytes: list[int] = []
        self.points: list[int] = []
        before = False  # whether the byte before the window is a letter
        for begin in range(0, len(body), WINDOW):
            part = np.frombuffer(body, np.uint8, min(WINDOW, len(body) - begin), begin)
            letter = ((part | 32) - np.uint8(97)) < 26
            point = (part & 0xC0) != 0x80
            opens = point.copy()
            opens[1:] &= ~(letter[1:] & letter[:-1])
            opens[0] &= not (before and letter[0])
            units = np.flatnonzero(opens)
            marks = units[-self.n % stride :: stride]
            self.bytes += (marks + begin).tolist()
            self.points += (np.cumsum(point)[marks] - 1 + self.chars).tolist() if len(marks) else []
            self.n += len(units)
            self.chars += int(np.count_nonzero(point))
            before = bool(letter[-1])
        self.units = range(0, self.n, stride)

    def locate(self, unit: int) -> tuple[int, int]:
        """The byte and the code point at which a unit begins; the text's ends for the unit after the last."""
        if unit >= self.n:
            return len(self.body), self.chars
        k = bisect_right(self.units, unit) - 1
        byte, point = self.bytes[k], self.points[k]
        for _ in range(unit - self.units[k]):
            end = UNIT.match(self.body, byte).end()
            point += 1 if self.body[byte] > 0x7F else end - byte
            byte = end
        return byte, point


def numbers(seed: int, doc: int | None) -> tuple[int, int, int, int]:
    """The four numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def rearrange(text: str | None, doc: int | None, seed: int = 1, share: int = 90, suffix_first: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, and the output of a text."""
    text = text or ""
    h1, h2, h3, h4 = numbers(seed, doc)
    index = Checkpoints(text.encode())
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= share:
        return index.n, "plain", None, None, text
    one, two = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    (_, low), (_, high) = cuts = index.locate(one), index.locate(two)
    body = index.body
    prefix, middle, suffix = (p.decode() for p in (body[: cuts[0][0]], body[cuts[0][0] : cuts[1][0]], body[cuts[1][0] :]))
    form = "spm" if h4 % 100 < suffix_first else "psm"
    parts = SUFFIX + suffix + PREFIX + prefix if form == "spm" else PREFIX + prefix + SUFFIX + suffix
    return index.n, form, low, high - low, parts + MIDDLE + middle


def transform(df: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = 1, share: int = 90, suffix_first: int = 20) -> DataFrame:
    """`df` with n_units, form, prefix_chars, middle_chars and output: `share` percent of the texts are rearranged, of
    these `suffix_first` percent with the suffix first. No shuffle."""
    df = without(df, "n_units", "form", "prefix_chars", "middle_chars", "output")
    names = df.columns
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(batch.column(names.index(text)).to_pylist(), batch.column(names.index(id_col)).to_pylist(), strict=True)
        found = list(zip(*(rearrange(t, d, seed, share, suffix_first) for t, d in rows), strict=True)) or [()] * len(types)
        made = [pa.array(c, t) for c, t in zip(found, types, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, "n_units", "form", "prefix_chars", "middle_chars", "output"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return map_arrow(df, each, f"{schema}, n_units bigint, form string, prefix_chars bigint, middle_chars bigint, output string", text)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of, from the output and its form alone: a text that is cut holds no sentinel, so
    the first one of each kind is the one that was put there."""
    out = F.col(output)
    first, second = F.when(F.col(form) == "psm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX)), F.when(F.col(form) == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    mid, end = F.position(second, out), F.position(F.lit(MIDDLE), out)
    one = F.substring(out, F.length(first) + 1, mid - F.length(first) - 1)
    two = F.substring(out, mid + F.length(second), end - mid - F.length(second))
    last = F.substring(out, end + len(MIDDLE), F.length(out))
    return F.when(F.col(form) == "plain", out).when(F.col(form) == "psm", F.concat(one, last, two)).otherwise(F.concat(two, last, one))
