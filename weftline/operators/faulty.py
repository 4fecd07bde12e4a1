"""Separating lines that are no valid record from those that load, by least-cost repair."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the line formats.
FIELDS = {
    "S": ["rec", "name", "seq"],
    "L": ["rec", "from_seg", "from_orient", "to_seg", "to_orient", "overlap"],
    "PAF": ["qname", "qlen", "qstart", "qend", "strand", "tname", "tlen", "tstart", "tend", "nmatch", "alnlen", "mapq"],
}
NAME = re.compile(r"(?![*=])[!-~]+")
SEQ = re.compile(r"\*|[ACGTNacgtn]+")
ORIENT = re.compile(r"[+-]")
OVERLAP = re.compile(r"\*|(?:[0-9]+[MIDNSHP=X])+")
DIGITS = re.compile(r"[0-9]{1,18}")
TAG = re.compile(r"[A-Za-z][A-Za-z0-9]:[AifZJHB]:.+", re.DOTALL)
PATTERNS = {
    "name": NAME, "from_seg": NAME, "to_seg": NAME, "qname": NAME, "tname": NAME, "seq": SEQ,
    "from_orient": ORIENT, "to_orient": ORIENT, "strand": ORIENT, "overlap": OVERLAP,
}

PARSED = "reason string, bad_field string, edits array<string>, cost int, fields array<string>, tags array<string>"
#: Edits that mend the quoting outweigh delimiter edits, those outweigh replaced values.
QUOTE, DELIMITER, VALUE = 1_000_000, 1_000, 1
#: The same for sums of any length.
Q, D = 1 << 80, 1 << 40

START, BARE, OPEN, CLOSED = range(4)
#: Of a long run of bases only so many at both ends matter: any field has taken in all they can tell by then.
RUN, MARGIN = re.compile("[ACGTNacgtn]{400,}"), 128
BAD = -1


def _digit(c: str) -> bool:
    return c in "0123456789"


# What a column's value looks like so far: of a state and a character the next state, and the states of a value that fits.
def _name(v: int, c: str) -> int:
    return 1 if "!" <= c <= "~" and (v or c not in "*=") else BAD


def _seq(v: int, c: str) -> int:
    return 1 if v == 0 and c == "*" else 2 if v != 1 and c in "ACGTNacgtn" else BAD


def _orient(v: int, c: str) -> int:
    return 1 if v == 0 and c in "+-" else BAD


def _overlap(v: int, c: str) -> int:
    return 1 if v == 0 and c == "*" else 2 if v != 1 and _digit(c) else 3 if v == 2 and c in "MIDNSHP=X" else BAD


def _digits(v: int, c: str) -> int:
    return v + 1 if v < 18 and _digit(c) else BAD


def _tag(v: int, c: str) -> int:
    if v >= 5:
        return 6
    letter = c.isascii() and c.isalpha()
    good = (letter, letter or _digit(c), c == ":", c in "AifZJHB", c == ":")[v]
    return v + 1 if good else BAD


def _any(v: int, c: str) -> int:
    return 0


def _columns(rec: str) -> list[tuple]:
    """A reader and the fitting states of each column of a record type, and then of a tag; an unknown type has one column of anything."""
    if rec not in FIELDS:
        return [(_any, {0}), (_any, {0})]
    readers = {NAME: (_name, {1}), SEQ: (_seq, {1, 2}), ORIENT: (_orient, {1}), OVERLAP: (_overlap, {1, 3})}
    literal = lambda v, c: 1 if v == 0 and c == rec else BAD
    number = (_digits, set(range(1, 19)))
    out = [(literal, {1}) if n == "rec" else readers[PATTERNS[n]] if n in PATTERNS else number for n in FIELDS[rec]]
    return [*out, (_tag, {6})]


def sound_fields(line: str) -> list[str] | None:
    """The fields of a line, or nothing if its quoting is unsound."""
    if '"' not in line:
        return line.split("\t")
    fields, at, end = [], 0, len(line)
    while True:
        if line[at : at + 1] == '"':
            close = line.find('"', at + 1)
            while close >= 0 and line[close + 1 : close + 2] == '"':
                close = line.find('"', close + 2)
            if close < 0 or line[close + 1 : close + 2] not in ("", "\t"):
                return None
            fields.append(line[at + 1 : close].replace('""', '"'))
            at = close + 1
        else:
            stop = line.find("\t", at)
            stop = end if stop < 0 else stop
            fields.append(line[at:stop])
            if '"' in fields[-1]:
                return None
            at = stop
        if at >= end:
            return fields
        at += 1


def _positions(line: str) -> list[int]:
    at, out = 0, []
    for run in RUN.finditer(line):
        out.extend(range(at, run.start() + MARGIN))
        at = run.end() - MARGIN
    return [*out, *range(at, len(line))]


def _break_cost(state: int, c: str) -> int | None:
    """What a delimiter put before ``c`` costs: within quotes it is none, and where it changes what a quote means it mends the quoting."""
    if state == OPEN:
        return None
    return Q if (state == CLOSED and c not in ("", "\t")) or (state == BARE and c == '"') else D


def _quote_edits_ahead(line: str, places: list[int]) -> list[list[int]]:
    """Of each place and state, the fewest edits that the quoting needs from there to the end of the line."""
    far = 1 << 60
    here = [0, 0, 1, 0]
    ahead = [here]
    for at in reversed(places):
        c, there, here = line[at], here, [far] * 4
        if c == '"':
            here = [min(there[OPEN], there[START] + 1), there[BARE] + 1, min(there[CLOSED], there[OPEN] + 1), min(there[OPEN], there[CLOSED] + 1)]
        elif c == "\t":
            here = [there[START], min(there[START], there[BARE]), there[OPEN], min(there[START], there[CLOSED])]
        else:
            here = [there[BARE], there[BARE], there[OPEN], far]
        for _ in range(3):  # edits before the character, one leading to another
            for state, to, cost in ((START, OPEN, 1), (OPEN, CLOSED, 1), (CLOSED, OPEN, 1), (BARE, START, int(c == '"')), (CLOSED, START, int(c != "\t"))):
                here[state] = min(here[state], here[to] + cost)
        ahead.append(here)
    return ahead[::-1]


def repair(line: str, rec: str) -> tuple[str, list[str], int]:
    """The cheapest edits that make a line a record: the repaired line, the edits, and what those but replaced values cost.

    One dynamic program over characters; a state is how far the quoting is
    (START of a field, BARE, OPEN quote, CLOSED), the column, and what its value
    looks like. Quotes and delimiters are put in or taken out, a value that
    doesn't fit its column is replaced when the column ends, and so is a
    further field that is no tag, at the price of a delimiter. States that need
    more quote edits than the line does are dropped, as are those over a limit
    of delimiter edits, which grows until the line can be repaired under it.
    """
    columns, places = _columns(rec), _positions(line)
    wanted, ahead = len(columns) - 1, _quote_edits_ahead(line, places)
    least, tabs = ahead[0][START], [0] * (len(places) + 1)
    for k in range(len(places) - 1, -1, -1):
        tabs[k] = tabs[k + 1] + (line[places[k]] == "\t")

    def ended(column: int, value: int) -> int:
        return 0 if value in columns[column][1] else VALUE if column < wanted else D

    limit = 1
    while True:
        best: dict[tuple, tuple] = {(START, 0, 0): (0, None)}
        for k in range(len(places) + 1):
            at = places[k] if k < len(places) else len(line)
            c = line[at : at + 1]

            def put(to: dict, key: tuple, cost: int, trail: tuple | None, place: int = k) -> bool:
                state, column, _ = key
                if (cost >> 80) + ahead[place][state] > least or (cost % Q >> 40) + max(0, wanted - 1 - column - tabs[place]) > limit:
                    return False
                if key in to and to[key][0] <= cost:
                    return False
                to[key] = (cost, trail)
                return True

            todo = list(best)
            while todo:  # what may be put in before the character
                state, column, value = key = todo.pop()
                cost, trail = best[key]
                options = []
                if state == START:
                    options.append(((OPEN, column, value), cost + Q, ("insert quote", at, trail)))
                elif state == OPEN:
                    options.append(((CLOSED, column, value), cost + Q, ("insert quote", at, trail)))
                elif state == CLOSED:
                    options.append(((OPEN, column, columns[column][0](value, '"') if value != BAD else BAD), cost + Q, ("insert quote", at, trail)))
                if (price := _break_cost(state, c)) is not None:
                    options.append(((START, min(column + 1, wanted), 0), cost + price + ended(column, value), ("insert delimiter", at, trail)))
                todo += [to for to, total, path in options if put(best, to, total, path)]
            if not c:
                break
            new: dict[tuple, tuple] = {}
            for (state, column, value), (cost, trail) in best.items():
                if c == '"':
                    if state in (START, OPEN):
                        put(new, (OPEN if state == START else CLOSED, column, value), cost, trail, k + 1)
                    elif state == CLOSED:
                        put(new, (OPEN, column, columns[column][0](value, c) if value != BAD else BAD), cost, trail, k + 1)
                    put(new, (state, column, value), cost + Q, ("delete quote", at, trail), k + 1)
                elif c == "\t" and state != OPEN:
                    put(new, (START, min(column + 1, wanted), 0), cost + ended(column, value), trail, k + 1)
                    put(new, (state, column, value), cost + D, ("delete delimiter", at, trail), k + 1)
                elif state != CLOSED:
                    put(new, (OPEN if state == OPEN else BARE, column, columns[column][0](value, c) if value != BAD else BAD), cost, trail, k + 1)
            best = new
        whole = [(cost + ended(column, value), trail) for (state, column, value), (cost, trail) in best.items() if state != OPEN and column >= wanted - 1]
        cost, trail = min(whole, key=lambda x: x[0], default=(Q << 60, None))
        if (cost % Q) >> 40 <= limit and cost < Q << 60:
            break
        limit *= 2
    made = []
    while trail:
        what, at, trail = trail
        made.append((what, at))
    pieces, done = [], 0
    for what, at in reversed(made):
        pieces.append(line[done:at])
        done = at
        if what.startswith("insert"):
            pieces.append('"' if what.endswith("quote") else "\t")
        else:
            done += 1
    edits = [f"{what} at {at}" for what, at in reversed(made)]
    return "".join(pieces) + line[done:], edits, QUOTE * (cost >> 80) + DELIMITER * ((cost % Q) >> 40)


def fits(rec: str, name: str, value: str) -> bool:
    """Whether a value by itself may stand in the column."""
    if name == "rec":
        return value == rec
    return bool(PATTERNS.get(name, DIGITS).fullmatch(value))


def bad_values(rec: str, fields: list[str]) -> Iterator[str]:
    """Names of the fields whose value no record of this type may have, from the left."""
    names = FIELDS[rec]
    number: dict[str, int] = {}
    for name, value in zip(names, fields, strict=False):
        if not fits(rec, name, value):
            yield name
        elif name != "rec" and name not in PATTERNS:
            number[name] = int(value)
            low, high = {"qend": ("qstart", "qlen"), "tend": ("tstart", "tlen"), "alnlen": ("nmatch", None)}.get(name, (None, None))
            if (
                low in number and (number[low] > number[name] if name == "alnlen" else number[low] >= number[name])
                or high in number and number[name] > number[high]
                or name == "mapq" and number[name] > 255
            ):
                yield name


def parse_line(rec: str | None, raw: str | None) -> dict | None:
    """The cheapest parse of one line, or nothing for a line to skip.

    Cost 0 is a valid record; otherwise the dearest kind of edit is the reason.
    A line of sound quoting and right count costs only its replaced values, as
    a record has fewer columns than a delimiter costs; other lines are
    repaired. Values are judged in the repaired line, by themselves while the
    repair is sought and by one another in the end.
    """
    line = raw or ""
    if line.endswith("\r"):
        line = line[:-1]
    if not line or line[0] == "#":
        return None
    fields = sound_fields(line)
    known = rec in FIELDS
    wanted = len(FIELDS[rec]) if known else 0
    counted = fields is not None and len(fields) >= wanted and (not known or all(map(TAG.fullmatch, fields[wanted:])))
    edits, cost, extra = [], 0, []
    if not counted:
        mended, edits, cost = repair(line, rec if known else "")
        reason = "quoting" if fields is None else "column_count"
        fields = sound_fields(mended)
        extra = [x for x in fields[wanted:] if not TAG.fullmatch(x)] if known else []
    values = list(bad_values(rec, fields)) if known else ["rec"]
    if counted:
        reason = "bad_value" if values else None
    edits = edits + [f"replace {x}" for x in values] + ["replace further field"] * len(extra)
    bad = values[0] if reason == "bad_value" else ""
    return {"reason": reason, "bad_field": bad, "edits": edits, "cost": min(cost + VALUE * len(values), 2**31 - 1), "fields": fields[:wanted] if known else fields, "tags": fields[wanted:] if known else []}


def parse_lines(lines: DataFrame, rec: str = "rec", raw: str = "raw") -> DataFrame:
    """``lines`` with a struct ``parsed`` (null for empty, null and comment lines).

    ``parsed.reason`` is null for valid records, else ``quoting``,
    ``column_count`` or ``bad_value`` with ``bad_field`` (empty for the other
    two); ``edits`` and ``cost`` are the cheapest repair, ``fields`` and ``tags``
    the values of the repaired line. A null or unknown record type is a bad value of ``rec``.
    Only the two columns go through Python, in Arrow batches and once; nothing is
    shuffled. Other columns are kept; one called ``parsed`` is replaced.
    """

    @F.pandas_udf(PARSED)
    def parse(rec: pd.Series, raw: pd.Series) -> pd.DataFrame:
        empty = {"reason": None, "bad_field": None, "edits": None, "cost": None, "fields": None, "tags": None}
        rows = [parse_line(r, x) or empty for r, x in zip(rec, raw, strict=True)]
        return pd.DataFrame(rows, columns=list(empty), dtype=object)

    # Called nondeterministic, as the optimizer would evaluate it again for each filter on what it gives.
    parsed = lines.withColumn("parsed", parse.asNondeterministic()(F.col(rec), F.col(raw)))
    return parsed.withColumn("parsed", F.when(F.col("parsed.cost").isNotNull(), F.col("parsed")))


def faulty_lines(parsed: DataFrame, line_id: str = "line_id") -> DataFrame:
    """The lines that don't load, with their reason."""
    return parsed.where("parsed.reason is not null").select(F.col(line_id), "parsed.reason", "parsed.bad_field")


def loaded(parsed: DataFrame, rec: str, line_id: str = "line_id") -> DataFrame:
    """The valid records of one type with a typed column per field and their tags."""
    names = FIELDS[rec]
    text = set(PATTERNS) | {"rec"}
    good = parsed.where((F.col("rec") == rec) & F.col("parsed").isNotNull() & F.col("parsed.reason").isNull())
    columns = [F.col("parsed.fields")[i].cast("string" if n in text else "long").alias(n) for i, n in enumerate(names)]
    return good.select(F.col(line_id), *columns, F.col("parsed.tags").alias("tags"))
