"""Sentences that a mail message says or quotes, without its machinery."""

from __future__ import annotations

import binascii
import quopri
import re
from collections import Counter
from html import unescape

_FIELD_NAME = re.compile(r"([A-Za-z][A-Za-z0-9-]*):")
#: Fields that tell headers from text that begins with a word and a colon, and those that only mail has.
_MAIL_FIELDS = frozenset("from to cc bcc subject date sender reply-to message-id in-reply-to references return-path received mime-version delivered-to precedence organization status lines user-agent newsgroups".split())
_MAIL_PREFIXES = ("x-", "content-", "list-", "resent-", "dkim-", "arc-", "received-", "authentication-")
_FIELD = re.compile(r"([A-Za-z][A-Za-z-]*):[ \t]*((?:.*)(?:\n[ \t]+.*)*)")
_DELIMITER = re.compile(r"^--(?=\S*[_=0-9A-Za-z])[^\s-][^\s]{5,}$", re.MULTILINE)
_PART_HEAD = re.compile(r"\s*(?:Content-[A-Za-z-]+:.*\n(?:[ \t]+.*\n)*)+", re.IGNORECASE)
_QUOTED = re.compile(r"^(?:[ \t]*(?:[>|:]|[A-Z]{1,3}>)[ \t]?)+", re.MULTILINE)
_NEWLINE = re.compile(r"<br\s*/?>", re.IGNORECASE)
_BREAK = re.compile(r"</?(?:p|div|li|tr|blockquote|h[1-6]|td)\b[^>]*>", re.IGNORECASE)
_TAG = re.compile(r"<[^>]*>")
_BASE64_LINE = re.compile(r"^[A-Za-z0-9+/=]{40,}$", re.MULTILINE)
_BASE64_BODY = re.compile(r"\s*(?:[A-Za-z0-9+/]{20,}\s+)*[A-Za-z0-9+/]+={0,2}\s*")
_SOFT = re.compile(r"=(?:[0-9A-F]{2}|\r?\n)")
_WRONG = re.compile("[Â-Å][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]")
_LINE_END = re.compile(r"\r\n?")
_STOP = re.compile(r"(?<=[.!?])[\"')\]]*\s+(?=\S)")
_SPACE = re.compile(r"\s+")
_RULE = re.compile(r"[-*_=#~]{2,}|-- ?")
_INTRODUCTION = re.compile(r".*\d{1,2}:\d\d\b.*:|-+ ?[A-Z][\w ]*-+|(?:Sent|From|To|Cc|Date|Subject): .*")
_ENDED = re.compile(r".*[.!?][\"')\]]*", re.DOTALL)
#: Lines of greetings and signatures are no longer than this, and no sentence ends there.
SHORT = 45
_LETTERS = re.compile(r"[^\W\d_]{2,}")


def _repair(pair: re.Match) -> str:
    try:
        return pair.group().encode("cp1252").decode("utf-8")
    except UnicodeError:
        try:
            return pair.group().encode("latin-1").decode("utf-8")
        except UnicodeError:
            return pair.group()


def _fields(head: str) -> dict[str, str]:
    return {m.group(1).lower(): m.group(2) for m in _FIELD.finditer(head)}


def _is_mail_field(name: str) -> bool:
    return name.lower() in _MAIL_FIELDS or name.lower().startswith(_MAIL_PREFIXES)


def _parted(text: str) -> tuple[str, str]:
    """Headers and body. Headers end at the first line that is neither a field nor goes on with one; the empty line there may be missing.

    Without a mail field there are no headers; without an empty line, what comes after the last mail field is body.
    """
    lines = text.split("\n")
    at = known = 1 if lines[0].startswith("From ") else 0
    mail = False
    found = False
    while at < len(lines) and lines[at].strip():
        field = _FIELD_NAME.match(lines[at])
        if field:
            mail = _is_mail_field(field.group(1))
            found = found or mail
        elif at == 0 or lines[at][0] not in " \t":
            break
        at += 1
        if mail:
            known = at
    if not found:
        return "", text
    empty = at == len(lines) or not lines[at].strip()
    if not empty:
        at = known
    return "\n".join(lines[:at]), "\n".join(lines[at + empty :])


def _decoded(body: str, fields: dict[str, str]) -> str:
    """The text of a part, out of its transfer encoding."""
    encoding = fields.get("content-transfer-encoding", "").strip().lower()
    data: bytes | None = None
    if encoding == "base64" or (not encoding and len(body) > 60 and _BASE64_BODY.fullmatch(body)):
        packed = re.sub(r"[^A-Za-z0-9+/]", "", body)
        try:
            data = binascii.a2b_base64(packed[: len(packed) // 4 * 4] + (packed[len(packed) // 4 * 4 :] + "==")[:4] * (len(packed) % 4 > 1))
        except binascii.Error:
            return ""
    elif encoding == "quoted-printable" or (not encoding and len(_SOFT.findall(body)) > 2):
        data = quopri.decodestring(body.encode("utf-8", "replace"))
    if data is None:
        return body
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace") if data.count(b"\xc3") < 2 else data.decode("utf-8", "replace")


def _plain(html: str) -> str:
    """The text of an HTML body; lines that are paragraphs of their own stay together where they are quoted or a sentence goes on."""
    out: list[str] = []
    before = ""
    for line in unescape(_TAG.sub("", _BREAK.sub("\n\n", _NEWLINE.sub("\n", html)))).split("\n\n"):
        if line := line.strip("\n"):
            goes_on = len(before) > SHORT and not _ENDED.fullmatch(before)
            out.append(("\n" if goes_on or _QUOTED.match(line) else "\n\n") + line)
            before = line.rpartition("\n")[2].rstrip()
    return "".join(out)


def _blocks(text: str) -> list[list[str]]:
    """Paragraphs as lists of lines, without signs of quotation, quotation headers, and whatever follows a rule."""
    blocks: list[list[str]] = [[]]
    ruled = False
    for line in _QUOTED.sub("", text).split("\n"):
        line = line.strip()
        if not line or _INTRODUCTION.fullmatch(line):
            blocks.append([])
            ruled = False
        elif _RULE.fullmatch(line):
            blocks.append([])
            ruled = True
        elif not ruled:
            blocks[-1].append(line)
    return [b for b in blocks if b]


def _sentences(text: str) -> list[str]:
    """Sentences of a body. Paragraphs of short lines that end no sentence are greetings and signatures and count for nothing."""
    found = []
    for lines in _blocks(text):
        if not _ENDED.fullmatch(lines[-1]) and max(map(len, lines)) <= SHORT:
            continue
        for sentence in _STOP.split(" ".join(lines)):
            sentence = _SPACE.sub(" ", sentence).strip()
            if sentence:
                found.append(sentence)
    return found


def message_sentences(text: str | None) -> list[str]:
    """Every sentence of the bodies of a message, quoted ones included.

    Headers, attachments, greetings, signatures, quotation headers and what
    follows a rule up to the next empty line are left out; base64, quoted-printable and
    wrongly decoded characters are undone; an HTML copy of what a plain part says
    counts once (of each sentence, the larger of the two counts). Null, empty
    and blank texts have none. Damaged multiparts are cut at whatever looks
    like a delimiter, and packed lines without a head are dropped.
    """
    if not text or text.isspace():
        return []
    text = _LINE_END.sub("\n", text)
    head, body = _parted(text)
    fields = _fields(head)
    kind = fields.get("content-type", "").lower()
    bodies: dict[str, list[str]] = {"plain": [], "html": []}

    def take(part: str, of: dict[str, str]) -> None:
        what = of.get("content-type", "").lower()
        if "attachment" in of.get("content-disposition", "").lower() or (what and not what.startswith(("text/plain", "text/html", "multipart"))):
            return
        found = _decoded(part, of)
        if what.startswith("text/html") or "<html" in found.lower() or "<p>" in found:
            bodies["html"].append(_plain(found))
        else:
            bodies["plain"].append(_BASE64_LINE.sub("", found))

    if kind.startswith("multipart") or "\nContent-Type:" in body or body.startswith("Content-Type:"):
        for part in _DELIMITER.split(body):
            if not part or part.isspace():
                continue
            head = _PART_HEAD.match(part)
            if head:
                take(part[head.end() :], _fields(head.group()))
            else:
                take(part, {})
    else:
        take(body, fields)
    plain, html = ([s for b in bodies[k] for s in _sentences(_WRONG.sub(_repair, b))] for k in ("plain", "html"))
    if plain and html:
        seen = Counter(sentence_words(s) for s in plain)
        for s in html:
            key = sentence_words(s)
            if seen[key] > 0:
                seen[key] -= 1
            else:
                plain.append(s)
        return plain
    return plain or html


def sentence_words(sentence: str) -> str:
    """Its words in lower case, without digits, signs and single letters."""
    return " ".join(_LETTERS.findall(sentence.lower()))
