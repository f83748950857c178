"""Blocks of lines that aren't prose: tables, rosters and specifications, found and put into words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import STRING, array, struct
from ..functions.text import block_key, strip

_RULE = re.compile(r"\|[\s\-|:]+\|")
# Headings that make a table a league table, and where its columns come from.
_LEAGUE = ("team", "pts", "points", "played", "won", "drawn", "lost", "goal")
_COLUMNS = {"position": ("pos", "position"), "team": ("team", "club", "name"), "points": ("pts", "points"), "games": ("played", "mp", "p"), "wins": ("won", "w"), "draws": ("drawn", "d"), "losses": ("lost", "l")}


def _nth(n: int) -> str:
    return f"{n}" + ("th" if 10 <= n % 100 <= 20 else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th"))


def _league(head: list[str], rows: list[list[str]]) -> Iterator[str]:
    names = [h.lower() for h in head]
    at = {k: next((i for i, h in enumerate(names) if h in keys), None) for k, keys in _COLUMNS.items()}
    for n, row in enumerate(rows, 1):
        cell = {k: row[i] if i is not None and i < len(row) else "" for k, i in at.items()}
        place = int(cell["position"]) if cell["position"].isdigit() else n
        parts = [f"{_nth(place)}: {cell['team'] or 'Unknown'}"]
        parts += [f"{cell[k]} {k}" for k in ("points", "games", "wins", "draws", "losses") if cell[k] and not (k == "draws" and cell[k] == "0")]
        yield ", ".join(parts) + "."


def tables_to_prose(text: str) -> str:
    """Runs of lines that begin with a bar, of a heading and at least one row, as sentences; other lines stay.

    Empty cells fall out before columns are matched, so later ones move up. Rows of a plain table whose width isn't the heading's are left out.
    """
    out: list[str] = []
    for barred, run in groupby(text.split("\n"), lambda line: line.strip().startswith("|")):
        lines = list(run)
        rows = [[c for c in map(str.strip, line.strip().split("|")) if c] for line in lines if not _RULE.fullmatch(line.strip())] if barred else []
        if len(rows) < 2 or lines[0].strip() == "|":
            out += lines
            continue
        head, *data = [r for r in rows if r] or [[]]
        if not data:
            out += [line.strip() for line in lines if not _RULE.fullmatch(line.strip())]
        elif any(k in " ".join(head).lower() for k in _LEAGUE):
            out.append("\n\n".join(_league(head, data)))
        else:
            out.append("\n\n".join(", ".join(f"{h}: {v}" for h, v in zip(head, r)) + "." for r in data if len(r) == len(head)))
    return "\n".join(out)


# Roster codes.
_ROLES = {"GK": "goalkeeper", "SW": "sweeper", "WB": "wing back", "DM": "defensive midfielder", "AM": "attacking midfielder", "D": "defender", "M": "midfielder", "F": "forward", "S": "striker", "W": "winger"}
_SIDES = {"L": "left", "R": "right", "C": "centre"}
_COUNTRIES = {
    "SVK": "Slovakia", "NOR": "Norway", "IRE": "Ireland", "NIR": "Northern Ireland", "ENG": "England", "ROM": "Romania", "WAL": "Wales", "GHA": "Ghana", "SCO": "Scotland", "ALG": "Algeria", "JAM": "Jamaica", "SWE": "Sweden",
    "COL": "Colombia", "ESP": "Spain", "KOR": "South Korea", "GER": "Germany", "GIB": "Gibraltar", "FRA": "France", "NED": "Netherlands", "POR": "Portugal", "BRA": "Brazil", "ARG": "Argentina", "ITA": "Italy", "USA": "United States",
}
_ROLE = re.compile(r"([LRC]*)(" + "|".join(sorted(_ROLES, key=len, reverse=True)) + r")([LRC]*)")
_ROSTER = re.compile(r"No\.\s+Name\s+Pos\s+Age\b.*\[CA PA\]", re.I)
_LOAN = re.compile(r"Name\s+Pos\s+Age\s+Wage\s+\[CA PA\].*Loan\s+Tier", re.I)
_ABILITY = re.compile(r"\[\s*(-?\d+)\s+(-?\d+)\s*\]")
_RECORD = re.compile(r"\s*P(\d+)\s*-\s*W(\d+)\s*-\s*D(\d+)\s*-\s*L(\d+)\s*-\s*Goals For\s+(\d+)\s*-\s*Goals Against\s+(\d+)\s*-\s*Goal Difference\s+(minus \d+|\d+)\s*-\s*Points\s+(\d+)\*?\s*", re.I)


def _codes(token: str) -> list[tuple[str, str]] | None:
    """(role or '', sides) of each comma part of a position token; None if it isn't one."""
    found = []
    for part in filter(None, token.split(",")):
        if part == "Omni":
            found.append(("utility player", ""))
        elif m := _ROLE.fullmatch(part):
            found.append((_ROLES[m[2]], m[1] + m[3]))
        elif re.fullmatch("[LRC]+", part):
            found.append(("", part))
        else:
            return None
    return found or None


def _positions(codes: list[tuple[str, str]]) -> str:
    roles: list[list[str]] = []
    for role, sides in codes:
        if role:
            roles.append([role, sides])
        elif roles:
            roles[-1][1] += sides
    spoken = []
    for role, sides in roles:
        words = [w for s, w in _SIDES.items() if s in sides]
        spoken.append(" ".join([role, *([" and ".join(filter(None, [", ".join(words[:-1]), words[-1]]))] if words else [])]))
    return ", ".join(spoken)


def roster_row(line: str, loan: bool = False) -> str | None:
    """One roster line as a sentence; None if it neither has an ability bracket nor begins with a number and holds an age."""
    numbered = re.match(r"(\d+)\.\s+", line)
    ability = _ABILITY.search(line)
    front = line[numbered.end() if numbered else 0 : ability.start() if ability else len(line)].split()
    age_at = next((i for i, t in enumerate(front) if t.isdigit()), None)
    if not ability and not (numbered and age_at is not None):
        return None
    named, rest = (front, []) if age_at is None else (front[:age_at], front[age_at + 1 :])
    codes: list[tuple[str, str]] = []
    while named and (c := _codes(named[-1])):
        codes, named = c + codes, named[:-1]
    name = " ".join(named).replace("*", "")
    wage = next((t for t in rest if re.fullmatch(r"-?\d+", t)), None)
    code = next((t for t in rest if re.fullmatch("[A-Z]{2,3}", t)), None)
    parts = [f"Number {numbered[1]}, {name}" if numbered else name, _positions(codes), f"age {front[age_at]}" if age_at is not None else "", _COUNTRIES.get(code or "", ""), f"wage £{wage}" if wage else ""]
    said = ", ".join(filter(None, parts)) + "."
    behind = line[ability.end() :].split() if ability else []
    if ability:
        best = int(ability[2])
        said += f" PA {best if best >= 0 else f'minus {-best}'}, CA {ability[1]}"
        if behind and re.fullmatch(r"-?\d+", behind[0]):
            change = int(behind.pop(0))
            said += f", up {change}" if change > 0 else f", down {-change}" if change else ", no change"
        said += "."
    if loan and len(behind) > 1:
        said += f" On loan at {' '.join(behind[:-1])}, loan tier {behind[-1]}."
    return said


def rosters_to_prose(text: str) -> str:
    """Rosters below their headings and league records as sentences; a heading without rows and all other lines stay."""
    lines, out, i = text.split("\n"), [], 0
    while i < len(lines):
        if m := _RECORD.fullmatch(lines[i]):
            out.append("Played {}, won {}, drawn {}, lost {}. Goals for {}, goals against {}, goal difference {}, {} points.".format(*m.groups()))
            i += 1
            continue
        loan = bool(_LOAN.search(lines[i]))
        if not loan and not _ROSTER.search(lines[i]):
            out.append(lines[i])
            i += 1
            continue
        rows, j = [], i + 1
        while j < len(lines):
            if lines[j].strip():
                if (said := roster_row(lines[j].strip(), loan)) is None:
                    break
                rows.append((j, said))
            j += 1
        out += ["\n\n".join(s for _, s in rows)] if rows else [lines[i]]
        i = rows[-1][0] + 1 if rows else i + 1
    return "\n".join(out)


#: A value yet to be filled in, other values, and what ends prose.
PLACEHOLDER = r"(?i)^x{1,4}(?:[.\-]x{1,4})*$"
SAMPLE = r"(?i)^(?:\d{1,3}%?|good|poor|fair|average|excellent|superb)$|^[LRC]$"
_PROSE_END = r"[.!?:;,]$"


def is_spec_line(line: Column) -> Column:
    """A short line without closing punctuation that holds a placeholder."""
    bare = strip(line)
    return (bare != "") & (F.char_length(bare) <= 90) & ~bare.rlike(_PROSE_END) & F.exists(F.split(bare, r"(?U)\s+"), lambda t: t.rlike(PLACEHOLDER))


def spec_fields(line: Column) -> Column:
    """(label, value) pairs of a specification line: labels run until a value; a last label has a null value."""
    kind = "array<struct<label:string,value:string>>"
    start = F.struct(F.array().cast(kind).alias("fields"), F.lit("").alias("label"))
    is_value = lambda t: t.rlike(PLACEHOLDER) | t.rlike(SAMPLE)

    def step(acc: Column, t: Column) -> Column:
        ends = is_value(t) & (acc["label"] != "")
        field = F.struct(acc["label"].alias("label"), t.alias("value"))
        longer = F.when(acc["label"] == "", t).otherwise(F.concat_ws(" ", acc["label"], t))
        return F.struct(F.when(ends, F.concat(acc["fields"], F.array(field))).otherwise(acc["fields"]).alias("fields"), F.when(ends, F.lit("")).otherwise(longer).alias("label"))

    def finish(acc: Column) -> Column:
        return F.when(acc["label"] == "", acc["fields"]).otherwise(F.concat(acc["fields"], F.array(F.struct(acc["label"].alias("label"), F.lit(None).cast("string").alias("value")))))

    return F.aggregate(F.filter(F.split(F.translate(line, "()", "  "), r"(?U)\s+"), lambda t: t != ""), start, step, finish)


def spec_blocks(df: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """(``key``, first_line, last_line, lines, block_key): stretches of at least ``least`` lines from a specification line on.

    A stretch ends before prose — a long line or one with closing punctuation — or a divider; blank lines and short lines
    belong to it, blank ones at its end don't. Stretches are found as islands by windows over each text's own lines.
    """
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line")).withColumn("_b", strip(F.col("line")))
    ends = (F.col("_b") != "") & (~F.col("_b").rlike(r"[\p{L}\p{N}]") | (F.char_length("_b") > 90) | F.col("_b").rlike(_PROSE_END))
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    islands = lines.withColumn("_island", F.sum(ends.cast("int")).over(w)).where((F.col("_b") != "") & ~ends)
    from_spec = Window.partitionBy(key, "_island").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = islands.withColumn("_on", F.max(is_spec_line(F.col("line"))).over(from_spec)).where("_on")
    runs = kept.groupBy(key, "_island").agg(F.min("n").alias("first_line"), F.max("n").alias("last_line"), F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("lines"))
    return runs.where(F.size("lines") >= least).select(key, "first_line", "last_line", "lines", block_key(F.col("lines")).alias("block_key"))


@F.pandas_udf(STRING)
def _blocks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: rosters_to_prose(tables_to_prose(t)), na_action="ignore")


def blocks_to_prose(text: Column) -> Column:
    """Tables, then rosters, as prose. Texts without a bar or a bracket aren't sent to Python."""
    return F.coalesce(_blocks(F.when(text.rlike(r"(?im)^\s*\||\[CA PA\]|Goal Difference"), text)), text)


@F.pandas_udf(struct(text=STRING, missing=array(STRING)))
def _removed(texts: pd.Series, removals: pd.Series) -> pd.DataFrame:
    rows = []
    for text, records in zip(texts, removals):
        missing, changed = [], False
        for r in [] if text is None or records is None else records:
            part = r["text"] or ""
            at = text.rfind(part) if r["kind"] == "trailing" else text.find(part)
            if part and at < 0:
                missing.append(part)
            elif part:
                text, changed = text[:at] + text[at + len(part) :], True
        rows.append((text.strip() + "\n" if changed else text, missing))
    return pd.DataFrame(rows, columns=["text", "missing"])


def apply_removals(text: Column, removals: Column) -> Column:
    """(text, missing): recorded stretches (kind, text) taken out in order — trailing ones from the end — and those not found."""
    return _removed(text, removals)
