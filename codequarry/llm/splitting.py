"""Oversized texts in pieces below a limit, cut at natural boundaries, with an overlap.

A text is a row of tokens with prefix sums of their sizes. For each kind of boundary, from
blank lines down to single blanks, the boundary offsets are sorted; a binary search finds
the last one under the limit. Where none is near enough the cut is hard. The next piece
starts one overlap before the cut, again at a boundary if there is one.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 4000, 200
#: A boundary is near enough if the piece fills this share of the limit.
FILL = 0.5

TOKEN = re.compile(r"\w+|\r\n|\s|[^\w\s]")
#: From the strongest to the weakest; a boundary is the end of a match.
BOUNDARIES = [
    re.compile(r"\n(?:[ \t]*\r?\n)+|\n[Ee][Nn][Dd][;.][ \t]*\r?\n"),
    re.compile(r"\n|\r(?!\n)"),
    re.compile(r"[.!?]\s+|[;}]\s*"),
    re.compile(r"\s+|[,)\]]"),
]
BREAK = BOUNDARIES[1]


class Sizes:
    """Prefix sums of token sizes; ``unit`` is 'chars' or 'words' (white space has no size then)."""

    def __init__(self, text: str, unit: str):
        self.chars = unit == "chars"
        self.ends, self.sums = [0], [0]
        for m in TOKEN.finditer(text):
            self.ends.append(m.end())
            self.sums.append(self.sums[-1] + (m.end() - m.start() if self.chars else int(not m.group().isspace())))

    def upto(self, at: int, outward: bool = True) -> int:
        """Size of the text before an offset; a token that is cut counts by its characters, as a word wholly or (inwards) not at all."""
        i = bisect_left(self.ends, at)
        if i == len(self.ends):
            return self.sums[-1]
        if self.chars:
            return self.sums[i] - (self.ends[i] - at)
        return self.sums[i] if outward or self.ends[i] == at else self.sums[i - 1]

    def farthest(self, start: int, limit: int) -> int:
        """The last offset at which text from ``start`` stays within the limit; inside a token only in characters."""
        most = self.upto(start, False) + limit
        j = bisect_right(self.sums, most) - 1
        return self.ends[j] + (most - self.sums[j] if self.chars and j + 1 < len(self.ends) else 0)

    def back(self, end: int, overlap: int) -> int:
        """The first offset from which text up to ``end`` stays within the overlap."""
        least = self.upto(end) - overlap
        if least <= 0:
            return 0
        j = bisect_left(self.sums, least)
        return self.ends[j] - (self.sums[j] - least if self.chars else 0)


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP, unit: str = "chars") -> list[tuple[int, int]]:
    """(start, end) of each piece; one piece if the text is within the limit.

    ``limit`` and ``overlap`` are in characters or words. Prefix sums tell how far a piece may
    go and how far the next one steps back; a binary search finds the last boundary in reach.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    sizes = Sizes(text, unit)
    found: dict[int, list[int]] = {}

    def level(n: int) -> list[int]:
        if n not in found:
            found[n] = [m.end() for m in BOUNDARIES[n].finditer(text)]
        return found[n]

    def last(lo: int, hi: int) -> int:
        for ends in map(level, range(len(BOUNDARIES))):
            k = bisect_right(ends, hi) - 1
            if k >= 0 and ends[k] > lo:
                return ends[k]
        return 0

    out, start, done = [], 0, 0
    while True:
        far = sizes.farthest(start, limit)
        if far >= len(text):
            out.append((start, len(text)))
            return out
        end = last(max(start + int((far - start) * FILL), done), far)  # each piece goes beyond the one before
        if not end:
            end = far - 1 if text[far - 1 : far + 1] == "\r\n" and far - 1 > max(start, done) else far
        out.append((start, end))
        done = end
        nxt = end
        if overlap:
            nxt = back = max(start + 1, sizes.back(end, overlap))
            for ends in map(level, range(1, len(BOUNDARIES))):  # the first line, statement or word that lies wholly in the overlap
                k = bisect_left(ends, back)
                if k < len(ends) and ends[k] < end:
                    nxt = ends[k]
                    break
            if text[nxt - 1 : nxt + 1] == "\r\n":
                nxt += 1
        start = nxt if nxt < end else end


def line_of(breaks: list[int], at: int) -> int:
    """How many line breaks end at or before an offset."""
    return bisect_right(breaks, at)


def split_oversized(symbols: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, unit: str = "chars") -> DataFrame:
    """(id, piece, n_pieces, content, start_line, end_line, overlap, range_fits) of rows longer than ``limit``, in characters or words.

    ``overlap`` is how many characters a piece shares with the one before (0 for the first);
    in the unit of the limit it is at most the parameter. Lines count from the row's ``start_line``; where it is missing,
    from ``end_line`` backwards, and where both are, from 1. ``range_fits`` tells whether the
    row's range holds exactly the lines of its content. CR, LF and CRLF end lines. NULL and
    shorter contents give no rows; repeated rows give repeated pieces.
    """
    # a text has at most as many words as characters
    rows = symbols.where(F.length("content") > limit).select("id", "content", F.col("start_line").cast("int"), F.col("end_line").cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "piece", "n_pieces", "content", "start_line", "end_line", "overlap", "range_fits"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
        for b in batches:
            out = [[] for _ in names]
            for i, text, first, last in zip(*(b.column(c).to_pylist() for c in ("id", "content", "start_line", "end_line"))):
                breaks = [m.end() for m in BREAK.finditer(text)]
                total = len(breaks) + (not breaks or breaks[-1] < len(text))
                base = first if first is not None else max(1, last - total + 1) if last is not None else 1
                cuts = pieces(text, limit, overlap, unit)
                if len(cuts) == 1:
                    continue
                for k, (lo, hi) in enumerate(cuts):
                    row = (i, k, len(cuts), text[lo:hi], base + line_of(breaks, lo), base + line_of(breaks, max(lo, hi - 1)), cuts[k - 1][1] - lo if k else 0, first is not None and last is not None and last - first + 1 == total)
                    for x, v in zip(out, row):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names)

    return rows.mapInArrow(run, "id long, piece int, n_pieces int, content string, start_line int, end_line int, overlap int, range_fits boolean")
