"""Entries of bibliographic exports: small parsers of one file's text each.

An entry is a list of (tag, value) in file order; a tag may repeat.  The tagged formats differ in how one
line is read only: each has a reader that tells what a line is, and ``_entries`` puts lines together.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from string import ascii_uppercase, digits

Entry = list[tuple[str, str]]

#: What a line is: a field of an entry, more of the field before it, the end of an entry, or nothing.
FIELD, MORE, END, NOTHING = "field", "more", "end", "nothing"


def decode(content: bytes, fallback: str | None = None) -> str:
    """UTF-8 without a byte-order mark; if that fails, ``fallback`` or replacement characters."""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode(fallback) if fallback else content.decode("utf-8-sig", "replace")


def _entries(lines: Iterable[str], read: Callable[[str], tuple[str, str, str]], repeats: bool) -> list[Entry]:
    """The entries of tagged lines.  ``read`` gives what a line is, its tag and its value; ``repeats``: a line that
    goes on with a value may say that value once more."""
    entries: list[Entry] = [[]]
    for line in lines:
        what, tag, value = read(line)
        entry = entries[-1]
        if what == FIELD:
            entry.append((tag, value))
        elif what == END:
            entries.append([])
        elif what == MORE and entry:
            tag, held = entry.pop()
            entry.append((tag, held if repeats and held == value else " ".join(x for x in (held, value) if x)))
    return [e for e in entries if e]


def _ris_tag(text: str) -> tuple[str, str] | None:
    """Two capitals or digits, a hyphen, a value."""
    tag, rest = text[:2], text[2:].lstrip()
    if len(tag) == 2 and set(tag) <= {*ascii_uppercase, *digits} and rest[:1] == "-":
        return tag, rest[1:].strip()
    return None


def _ris_line(line: str) -> tuple[str, str, str]:
    text = line.strip()
    found = _ris_tag(text)
    if found is None:
        return MORE if text else NOTHING, "", text
    tag, value = found
    inner = _ris_tag(value)  # some exports write the tag once more in front of the value
    if inner is not None and inner[0] == tag:
        value = inner[1]
    return END if tag == "ER" else FIELD, tag, value


def _medline_line(line: str) -> tuple[str, str, str]:
    text = line.strip()
    tag, hyphen, value = line[:4].rstrip(), line[4:5], line[5:].strip()
    if not text:
        return END, "", ""
    return (FIELD, tag, value) if hyphen == "-" and tag.isalnum() else (MORE, "", text)


def ris(text: str) -> list[Entry]:
    """RIS entries; ER ends one, a last one without ER counts.  A line without a tag goes on with the
    value before it, unless it repeats that; a tag repeated inside its own value is dropped."""
    return _entries(text.splitlines(), _ris_line, repeats=True)


def medline(text: str) -> list[Entry]:
    """MEDLINE entries, parted by blank lines; a tag in four columns and a hyphen begin a field."""
    return _entries(text.splitlines(), _medline_line, repeats=False)


#: What the first field of an entry looks like in either format, and the lines that are looked at.
MEDLINE_MARK, RIS_MARK, LOOKED_AT = "PMID-", "TY  -", 60


def is_medline(text: str) -> bool:
    """Whether a tagged text file is MEDLINE: of both marks, that which begins a line first tells."""
    marked = (line for line in text.splitlines()[:LOOKED_AT] if line.startswith((MEDLINE_MARK, RIS_MARK)))
    return next(marked, RIS_MARK).startswith(MEDLINE_MARK)


def medline_doi(entry: Entry) -> str:
    """The identifier (first word) marked as a DOI: the first in a LID field, else the first in an AID field."""
    marked = [(tag, value.split()[0]) for tag, value in entry if "[doi]" in value.lower()]
    found = dict(reversed(marked))
    return found.get("LID") or found.get("AID") or ""


_BAD_FIELD = re.compile(r"^\s*[\w-]+\s*:.*$", re.MULTILINE)


def _braced(text: str, at: int) -> tuple[str, int] | None:
    """What stands between the brace at ``at`` and its partner, and the place after it."""
    depth = 0
    for i in range(at, len(text)):
        if text[i] == "{" and text[i - 1 : i] != "\\":
            depth += 1
        elif text[i] == "}" and text[i - 1 : i] != "\\":
            depth -= 1
            if not depth:
                return text[at + 1 : i], i + 1
    return None


def _fields(body: str) -> Entry | None:
    """Fields of an entry's body; None if one is not of the form name = value."""
    out: Entry = []
    at = 0
    while True:
        while at < len(body) and (body[at].isspace() or body[at] == ","):
            at += 1
        if at >= len(body):
            return out
        match = re.compile(r"([\w-]+)\s*=\s*").match(body, at)
        if not match:
            return None
        name, at = match.group(1).lower(), match.end()
        if body[at : at + 1] == "{":
            found = _braced(body, at)
            if found is None:
                return None
            value, at = found
        elif body[at : at + 1] == '"':
            end, depth = at + 1, 0
            while end < len(body) and (body[end] != '"' or depth):
                depth += (body[end] == "{") - (body[end] == "}")
                end += 1
            value, at = body[at + 1 : end], end + 1
        else:
            end = body.find(",", at)
            end = len(body) if end < 0 else end
            value, at = body[at:end].strip(), end
        out.append((name, " ".join(value.replace("{", "").replace("}", "").split())))


def _is_start(line: str) -> bool:
    """Whether a line begins an entry: @, a word, a brace."""
    word, brace, _ = line.strip().partition("{")
    return bool(brace) and word[:1] == "@" and word[1:].rstrip().replace("_", "a").isalnum()


def _bibtex(text: str) -> list[Entry]:
    out = []
    for match in re.finditer(r"@(\w+)\s*{", text):
        if match.group(1).lower() in ("comment", "string", "preamble"):
            continue
        found = _braced(text, match.end() - 1)
        if found is None:
            continue
        key, _, body = found[0].partition(",")
        fields = _fields(body)
        if fields is not None:
            out.append([("ID", key.strip()), *fields])
    return out


def bibtex(text: str) -> list[Entry]:
    """BibTeX entries.  If some cannot be read, lines of the form ``field: value`` are blanked and the
    file is read again; that reading counts only if it gives more entries."""
    entries = _bibtex(text)
    if len(entries) < sum(_is_start(line) for line in text.splitlines()):
        again = _bibtex(_BAD_FIELD.sub("", text))
        entries = again if len(again) > len(entries) else entries
    return entries
