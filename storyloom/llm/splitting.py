"""Cutting oversized texts into overlapping pieces at natural boundaries (problem 5)."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Natural boundaries are white space but for no-break spaces, and these marks.
MARKS = "。！？、，；：…"
_WHITE = "\t\n\x0b\x0c\r \x85  -  -    　"
_BOUNDARY = re.compile(f"[{_WHITE}{MARKS}]")
#: Boundaries by strength: each pattern's end is a place to cut; the last entry takes any natural boundary.
_STRENGTHS = (
    re.compile(r"\n\s*\n\s*"),
    re.compile(r"\n"),
    re.compile(f"(?:[.!?…。！？।؟]+[\"'”’»)\\]」』]*)(?=[{_WHITE}])[{_WHITE}]*|[。！？…।]+[”’」』）]*"),
    re.compile(f"[,;:،؛](?=[{_WHITE}])[{_WHITE}]*|[、，；：][”’」』）]*"),
)
#: Where no natural boundary serves, a cut between these is better than one inside a word.
_JOINT = re.compile(r"(?<=[-–—/|_])")
_STICKY = re.compile(r"[̀-ͯ҃-֑҇-ֽً-ٟऺ-्ัิ-ฺ็-๎‍︀-️\U0001f3fb-\U0001f3ff]")


def _natural(text: str) -> list[list[int]]:
    """Places to cut, by strength. A cut lies behind its boundary; the weakest also allow one before it."""
    found = [[m.end() for m in p.finditer(text)] for p in _STRENGTHS]
    behind = [m.end() for m in _BOUNDARY.finditer(text)]
    return [*found, behind, sorted({p for e in behind for p in (e - 1, e)})]


def _near(cuts: list[int], a: int, b: int, middle: float) -> int | None:
    """The cut between ``a`` and ``b``, which lie around ``middle``, nearest to it; the lower of two as near."""
    i = bisect_left(cuts, middle)
    return min((c for c in cuts[max(0, i - 1) : i + 1] if a < c < b), key=lambda c: (abs(c - middle), c), default=None)


def bisect_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, bool]]:
    """(start, end, forced) of consecutive pieces of ``text``, without overlaps.

    A stretch longer than ``limit - overlap`` is cut at the strongest boundary near its midpoint — within its middle
    half, or else the nearest natural boundary of all — and both halves are treated alike. A stretch that holds no
    natural boundary stays whole while it is within ``limit`` (its overlap is then narrower); only beyond that is it
    cut where no boundary is, until overlaps fit too. Closing quotes stay with the mark before them. The piece behind a cut
    inside a run of more than ``limit`` characters without a natural boundary is marked as forced, whatever it was cut at.
    """
    if len(text) <= limit:
        return [(0, len(text), False)] if text else []
    room = max(1, limit - overlap)
    cuts = _natural(text)
    behind, either = cuts[-2], cuts[-1]
    todo: list[tuple[int, int, bool]] = [(0, len(text), False)]
    pieces: list[tuple[int, int, bool]] = []
    torn: set[int] = set()

    def inside_run(c: int) -> bool:
        i = bisect_left(either, c)
        if i < len(either) and either[i] == c:
            return False
        i = bisect_right(behind, c)
        return (behind[i] - 1 if i < len(behind) else len(text)) - (behind[i - 1] if i else 0) > limit

    while todo:
        a, b, forced = todo.pop()
        if b - a <= room:
            pieces.append((a, b, forced))
            continue
        middle, quarter = (a + b) / 2, (b - a) / 4
        cut = next((c for level in cuts[:-1] if (c := _near(level, int(a + quarter), int(b - quarter) + 1, middle)) is not None), None)
        if cut is None:
            cut = _near(behind, a, b, middle)
        if cut is None and b - a <= limit and not torn & {a, b}:
            pieces.append((a, b, forced))
            continue
        if cut is None:
            cut = _near(either, a, b, middle)
        if cut is None:
            joints = [m.start() for m in _JOINT.finditer(text, a + 1, b)]
            cut = _near(joints, int(a + quarter), int(b - quarter) + 1, middle)
            if cut is None:
                cut = int(middle)
                while cut + 1 < b and (_STICKY.match(text, cut) or text[cut - 1] == "\u200d"):
                    cut += 1
                if cut + 1 >= b:
                    cut = int(middle)
            torn.add(cut)
        todo.append((cut, b, inside_run(cut)))
        todo.append((a, cut, forced))
    return pieces


def with_overlap(pieces: list[tuple[int, int, bool]], limit: int, overlap: int) -> list[tuple[int, int, bool]]:
    """The pieces, each but the first begun ``overlap`` characters earlier, or as many as ``limit`` and the piece before leave room for."""
    result = []
    for k, (a, b, forced) in enumerate(pieces):
        back = min(overlap, limit - (b - a), a - pieces[k - 1][0]) if k else 0
        result.append((a - max(0, back), b, forced))
    return result


def split_oversized(chunks: DataFrame, profiles: DataFrame, key: str = "row_id") -> DataFrame:
    """Pieces of the rows of ``chunks`` longer than their profile's ``max_chars``.

    Columns: ``key``, piece (from 1), char_start, char_end (in the chunk's text, overlap included), text_start,
    text_end (in the document: the row's ``text_start`` plus the piece's place; null where the row has none),
    overlap (characters shared with the piece before), forced (no natural boundary at its own beginning), text.

    Rows with a null text, a null, unknown or limitless profile, or within the limit have no pieces. Repeated rows are
    cut each for itself. Leaving overlaps out, the pieces of a row join to exactly its text.
    ``profiles`` has one row for each profile and is expected to be small; Spark broadcasts it if its measured size
    is below the broadcast threshold and joins by shuffle otherwise. Other columns are left out. Empty tables give
    an empty result.
    """
    p = profiles.select(F.col("profile").alias("_profile"), F.col("max_chars").alias("_limit"), F.greatest(F.coalesce("overlap_chars", F.lit(0)), F.lit(0)).alias("_overlap")).where("_limit > 0 and _profile is not null").dropDuplicates(["_profile"])
    c = chunks.select(F.col(key).alias("_key"), F.col("profile").alias("_p"), F.col("text").alias("_text"), F.col("text_start").alias("_at"))
    over = c.join(p, F.col("_p") == F.col("_profile")).where(F.char_length("_text") > F.col("_limit")).select("_key", "_text", "_at", "_limit", "_overlap")
    added = "piece int, char_start int, char_end int, text_start int, text_end int, overlap int, forced boolean, text string"
    schema = StructType(chunks.select(F.col(key)).schema.fields + StructType.fromDDL(added).fields)
    target = pa.schema([pa.field(n, t) for n, t in zip(schema.names[1:], (pa.int32(),) * 6 + (pa.bool_(), pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            parent: list[int] = []
            for i, (text, at, limit, overlap) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(1, 5)))):
                overlap = min(overlap, limit - 1)
                own = bisect_text(text, limit, overlap)
                for k, ((a, b, forced), (core, _, _)) in enumerate(zip(with_overlap(own, limit, overlap), own), 1):
                    rows.append((k, a, b, None if at is None else at + a, None if at is None else at + b, core - a, forced, text[a:b]))
                    parent.append(i)
            keys = batch.column(0).take(pa.array(parent, pa.int64()))
            columns = list(zip(*rows)) or [[] for _ in target]
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(x, f.type) for x, f in zip(columns, target))], names=schema.names)

    return over.mapInArrow(run, schema)


def cut_inside_runs(pieces: DataFrame, key: str = "row_id") -> DataFrame:
    """``key`` of each row of which a piece had to begin where no natural boundary is."""
    return pieces.where("forced").select(key).distinct()
