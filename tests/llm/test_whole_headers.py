from weftline.llm.messages import message_sentences

SAID = ["Nobody paid the bill.", "See below."]
BODY = "Nobody paid the bill.\nSee below."


def test_bodies_without_an_empty_line_before_them():
    head = "From: a@b.example\nReceived: from x\n\tby y; 1 May\nX-Odd: 1\nSubject: x\n"
    for gap in ("", "\n"):
        assert message_sentences(head + gap + BODY) == SAID
        assert message_sentences(head + gap + "Dear all,\n\n" + BODY + "\n\nIt rained.") == [*SAID, "It rained."]
    assert message_sentences(head + "Note: the café is full.\n" + BODY) == ["Note: the café is full.", *SAID]
    assert message_sentences("From a@b Mon May 1\n" + head + BODY) == SAID


def test_text_that_only_looks_like_headers():
    assert message_sentences("Note: nobody paid the bill.\n\nSee below.") == ["Note: nobody paid the bill.", "See below."]
    assert message_sentences("From Monday on nobody paid the bill.\n\nSee below.") == ["From Monday on nobody paid the bill.", "See below."]


def test_delimiters_right_behind_the_headers():
    text = 'From: a\nContent-Type: multipart/mixed; boundary="=_bnd_12"\n--=_bnd_12\nContent-Type: text/plain\nContent-Transfer-Encoding: quoted-printable\n\nNobody paid the bill.=\n See below.\n--=_bnd_12--\n'
    assert message_sentences(text) == SAID


def test_tags_far_into_a_part():
    assert message_sentences("From: a\n\n" + "<!-- " + "x" * 3000 + " -->\n<p>Nobody paid the bill.</p><p>See below.</p>") == SAID
