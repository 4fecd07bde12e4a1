import base64
import quopri
import random

from weftline.llm.messages import message_sentences
from weftline.llm.subjects import area_shares, subject_areas, trusted_labels

BODY = "Dear all,\n\nThe café is über full. Nobody paid\nthe bill. See below.\n\nOn 3 May 2014 04:42, X Y wrote:\n> Hi X,\n>\n> On Monday we met. It\n> rained.\n\nBest,\nX Y\nlegal desk\n--\nA list footer.\n"
SAID = ["The café is über full.", "Nobody paid the bill.", "See below.", "On Monday we met.", "It rained."]


def test_encodings():
    head = "From: a@b.example\nSubject: x\nContent-Type: text/plain; charset=utf-8\n"
    assert message_sentences(head + "\n" + BODY) == SAID
    assert message_sentences(BODY) == SAID
    assert message_sentences(head + "Content-Transfer-Encoding: quoted-printable\n\n" + quopri.encodestring(BODY.encode()).decode()) == SAID
    packed = base64.encodebytes(BODY.encode()).decode()
    assert message_sentences(head + "Content-Transfer-Encoding: base64\n\n" + packed) == SAID
    assert message_sentences(head + "\n" + BODY.encode().decode("cp1252")) == SAID
    for nothing in (None, "", " \n\t", head):
        assert message_sentences(nothing) == [] or nothing == head


def test_parts_and_html_copies():
    html = "<html><body><p>Dear all,</p><p>The caf&eacute; is &uuml;ber full. Nobody paid the bill. See below.</p><p>On 3 May 2014 04:42, X Y wrote:</p><p>&gt; Hi X,</p><p>&gt;</p><p>&gt; On Monday we met. It</p><p>&gt; rained.</p></body></html>"
    junk = base64.encodebytes(random.Random(1).randbytes(400)).decode()
    text = (
        'From: a\nMIME-Version: 1.0\nContent-Type: multipart/mixed;\n boundary="=_bnd_12"\n\n--=_bnd_1\nContent-Type: text/plain; charset="utf-8"\n\n' + BODY
        + "--=_bnd_12\nContent-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n" + html
        + '\n--=_bnd_12\nContent-Type: text/csv; name="x"\nContent-Transfer-Encoding: base64\nContent-Disposition: attachment\n\n' + junk + "--=_bnd_12--\n"
    )
    assert message_sentences(text) == SAID
    lines = "<html><body><p>Nobody paid the bill that came on Monday, not even</p><p>the café. See below.</p></body></html>"
    assert message_sentences("Content-Type: text/html\n\n" + lines) == ["Nobody paid the bill that came on Monday, not even the café.", "See below."]
    only = text.replace("text/plain", "image/png", 1)
    assert message_sentences(only) == SAID


SYLLABLES = ("bal", "cor", "den", "fim", "gul", "har", "jot")
AREAS = {"law": [a + b + "ex" for a in SYLLABLES for b in SYLLABLES], "cooking": [a + b + "ola" for a in SYLLABLES for b in SYLLABLES]}


def corpus():
    rng = random.Random(7)
    say = lambda w: rng.choice(["We saw the {} and the {} today.", "Where is the {} with that {}?", "A {} is no {}."]).format(*rng.sample(w, 2))
    rows, truth = [], set()
    for i in range(400):
        parts = ["That ship has sailed.", "Too much balbalola spoils it."] if i % 3 else ["No hurry."]
        area = rng.choice([None, "law", "cooking"])
        n = rng.choice([1, 4, 6]) if area else 0
        parts += [say(AREAS[area]) for _ in range(n)]
        rows.append((i, "From: x\n\nHello,\n\n" + " ".join(parts), "en", i, "x", "y"))
        if n >= 3:
            truth.add((i, area))
    labels = [(i, next((a for d, a in truth if d == i), "none"), "ann1") for i in range(60)] + [(0, "law", "ann2"), (0, "law", "ann3")]
    return rows, labels, truth


def test_areas_spread_from_seeds(spark):
    rows, labels, truth = corpus()
    rows += [(900, None, "en", 1, "", ""), (901, "", None, 1, "", ""), (902, "word " * 100_000, "en", 1, "", "")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, row int, area string, terms string")
    named = spark.createDataFrame([("law",), ("cooking",)], "area_code string")
    seeds = spark.createDataFrame(labels, "doc_id long, area_code string, annotator string")
    found = {tuple(r) for r in subject_areas(documents, seeds, named).collect()}
    held = {x for x in truth if x[0] >= 60}
    right = {x for x in found if x[0] >= 60}
    assert len(right & held) >= 0.9 * len(held) and len(right - held) <= 0.1 * len(right)
    shares = {r.area_code: r.n_documents for r in area_shares(documents, spark.createDataFrame(list(found), "doc_id long, area_code string"), named).collect()}
    assert shares["law"] == len({d for d, a in found if a == "law"}) and shares["none"] == len(rows) - len({d for d, _ in found})
    assert subject_areas(documents.limit(0), seeds, named).count() == 0
    assert subject_areas(documents, seeds.limit(0), named).count() == 0


def test_majority_of_annotators(spark):
    labels = [(1, "law", "a"), (1, "none", "b"), (1, "law", "c"), (2, "law", "a"), (2, "none", "b"), (3, "none", "a"), (None, "law", "a")]
    got = trusted_labels(spark.createDataFrame(labels, "doc_id long, area_code string, annotator string")).collect()
    assert {r.doc_id: r.trusted for r in got} == {1: ["law"], 2: [], 3: []}
