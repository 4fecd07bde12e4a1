import re

from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.operators.faulty import DELIMITER, FIELDS, QUOTE, TAG, VALUE, faulty_lines, fits, loaded, parse_line, parse_lines, repair, sound_fields

SOUND = re.compile(r'(?:(?:"(?:[^"]|"")*"|[^"\t]+|)\t)+', re.DOTALL)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='"\ta', max_size=14))
def test_quote_edits_only_where_needed(line):
    fields, (_, edits, cost) = sound_fields(line), repair(line, "")
    assert (fields is not None) == (cost < QUOTE) == bool(SOUND.fullmatch(line + "\t"))
    if fields is not None:
        cut = [x[1] for x in re.finditer(r'("(?:[^"]|"")*"|[^"\t]*)\t', line + "\t", re.DOTALL)]
        assert not edits and fields == [x[1:-1].replace('""', '"') if x.startswith('"') else x for x in cut]


def scanned(text):
    """Where quoting stands behind a text: at the start of a field, in a bare or quoted one, behind a quote that may close."""
    state = "start"
    for c in text:
        if c == '"':
            state = {"start": "open", "open": "closed", "closed": "open"}.get(state, "broken")
        elif c == "\t":
            state = {"open": "open", "broken": "broken"}.get(state, "start")
        else:
            state = {"start": "bare", "bare": "bare", "open": "open"}.get(state, "broken")
    return state


def edited(line, at, before, cost, left):
    """All texts within ``left`` edits of a line, with what the edits cost."""
    c = line[at : at + 1]
    if left:
        yield from edited(line, at, before + '"', cost + QUOTE, left - 1)
        state = scanned(before)
        if state in ("start", "bare", "closed"):
            mends = (state == "closed" and c not in ("", "\t")) or (state == "bare" and c == '"')
            yield from edited(line, at, before + "\t", cost + (QUOTE if mends else DELIMITER), left - 1)
        if c == '"' or (c == "\t" and scanned(before) != "open"):
            yield from edited(line, at + 1, before, cost + (QUOTE if c == '"' else DELIMITER), left - 1)
    if c:
        yield from edited(line, at + 1, before + c, cost, left)
    else:
        yield before, cost


def misfits(rec, fields):
    wanted = len(FIELDS[rec])
    return sum(VALUE * (not fits(rec, n, x)) for n, x in zip(FIELDS[rec], fields, strict=False)) + sum(DELIMITER * (not TAG.fullmatch(x)) for x in fields[wanted:])


@settings(max_examples=150, deadline=None)
@given(st.sampled_from("SL"), st.text(alphabet='"\tSa+', max_size=9))
def test_no_cheaper_repair_exists(rec, line):
    fields = sound_fields(line)
    if fields is not None and len(fields) >= len(FIELDS[rec]) and all(map(TAG.fullmatch, fields[len(FIELDS[rec]) :])):
        return
    mended, edits, cost = repair(line, rec)
    # ``cost`` has the price of further fields that are no tags in it already.
    total = cost + misfits(rec, sound_fields(mended)[: len(FIELDS[rec])])
    found = [cost + misfits(rec, sound_fields(text)) for text, cost in edited(line, 0, "", 0, 3) if sound_fields(text) is not None and len(sound_fields(text)) >= len(FIELDS[rec])]
    assert not found or total <= min(found)
    assert len(edits) > 3 or total >= min(found)


def reason(rec, raw):
    found = parse_line(rec, raw)
    return found and (found["reason"], found["bad_field"])


def test_reasons_in_order():
    paf = "q\t100\t1\t50\t+\tt\t200\t5\t60\t40\t50\t60"
    assert reason("PAF", paf) == (None, "")
    assert reason("PAF", paf + "\r") == (None, "")
    assert reason("PAF", paf + "\ttp:A:P") == (None, "")
    assert reason("PAF", paf + "\ttp:A:") == ("column_count", "")
    assert reason("PAF", paf.replace("\t60\t40", "\t40")) == ("column_count", "")
    assert reason("PAF", paf.replace("\t50\t+", "\t1\t+")) == ("bad_value", "qend")
    assert reason("PAF", paf.replace("\t40\t50", "\t51\t50")) == ("bad_value", "alnlen")
    assert reason("PAF", paf[:-2] + "256") == ("bad_value", "mapq")
    assert reason("PAF", paf.replace("100", "1" * 19)) == ("bad_value", "qlen")
    assert reason("S", "S\tx\tACGT") == (None, "")
    assert reason("S", 'S\t"x"\tACGT') == (None, "")
    assert reason("S", 'S\tx"\tACGT') == ("quoting", "")
    assert reason("S", 'S\t"x\tACGT') == ("quoting", "")
    assert reason("S", 'S\t"x"y\tACGT') == ("quoting", "")
    assert reason("S", 'S\t"a\tb"\tACGT') == ("bad_value", "name")
    assert reason("S", "S\tx") == ("column_count", "")
    assert reason("S", "L\t=x\tACGT") == ("bad_value", "rec")
    assert reason("S", "S\tx\tACGU") == ("bad_value", "seq")
    assert reason("L", "L\ta\t+\tb\t?\t*") == ("bad_value", "to_orient")
    assert reason("L", "L\ta\t+\tb\t-\t5") == ("bad_value", "overlap")
    for skipped in ("", "\r", "# x", None):
        assert parse_line("S", skipped) is None
    assert reason(None, "S\tx\tACGT") == ("bad_value", "rec")


def test_edits_say_what_and_where():
    repaired = lambda rec, line: (lambda p: (p["edits"], p["cost"], p["fields"]))(parse_line(rec, line))
    assert repaired("L", 'L\ta\t+\tb\t-\t"5M\t') == (["insert quote at 14", "replace overlap"], 1_000_001, ["L", "a", "+", "b", "-", "5M\t"])
    assert repaired("L", "L\ta+\tb\t-\t5M") == (["insert delimiter at 3"], 1_000, ["L", "a", "+", "b", "-", "5M"])
    assert repaired("S", 'S\ta\t"ACGT') == (["delete quote at 4"], 1_000_000, ["S", "a", "ACGT"])
    assert repaired("S", "S\ta\tACGT\tfoo")[1] == 1_000
    paf = "q\t100\t1\t50\t+\tt\t200\t5\t60\t40\t50\t60".split("\t")
    assert repaired("PAF", "\t".join(paf[:4] + paf[5:]))[1] == 1_001
    long = "S\t\"a\t" + "ACGT" * 200_000
    assert repaired("S", long) == (["delete quote at 2"], 1_000_000, ["S", "a", "ACGT" * 200_000])


def test_over_a_table(spark):
    rows = [(1, "S", "S\tx\tACGT", "a"), (2, "S", 'S\t"x', "b"), (3, "L", "L\ta\t+\tb\t-\t5M\tNM:i:1", None), (4, "S", None, None), (5, None, "y", None), (None, "S", "S", None), (7, "S", "S\tx\t" + "A" * 300_000, None)]
    lines = spark.createDataFrame(rows, "line_id long, rec string, raw string, parsed string")
    parsed = parse_lines(lines)
    assert sorted(map(tuple, faulty_lines(parsed).collect()), key=str) == sorted([(2, "quoting", ""), (5, "bad_value", "rec"), (None, "column_count", "")], key=str)
    assert [tuple(r) for r in loaded(parsed, "L").collect()] == [(3, "L", "a", "+", "b", "-", "5M", ["NM:i:1"])]
    assert sorted(r.line_id for r in loaded(parsed, "S").collect()) == [1, 7]
    assert faulty_lines(parse_lines(lines.limit(0))).count() == 0
