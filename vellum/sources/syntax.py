"""Tokens of documents, and the entries of the dictionaries that they make up."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from vellum.functions.content import decode_literal, literal_end

SPACE = b"\0\t\n\f\r "
#: White space and comments, then a token; a string in parentheses is a whole one unless others stand within it.
_TOKEN = re.compile(
    rb"[\0\t\n\f\r ]*+(?:%[^\r\n]*+[\0\t\n\f\r ]*+)*+"
    rb"([^\0\t\n\f\r ()<>\[\]{}/%]+|/[^\0\t\n\f\r ()<>\[\]{}/%]*|\((?:[^()\\]++|\\.)*+\)|<<|>>|<[0-9A-Fa-f\0\t\n\f\r ]*>|.)", re.S,
)
#: What ends an object's dictionary or value.
_LAST = re.compile(rb"[\0\t\n\f\r ()<>\[\]{}/%](?:endobj|stream)(?=[\0\t\n\f\r ()<>\[\]{}/%])")
#: Values that are as long at most are kept, so many of them: documents of one origin have most dictionaries in common.
KEPT_BYTES, KEPT = 1_000, 2_048
_REF = re.compile(r"(\d{1,10})\s+(\d{1,5})\s+R")
#: Dictionaries within dictionaries whose entries are listed by path; deeper ones are there as the raw value of the one above.
LEVELS = 16


def tokens(data: bytes, at: int = 0, ends: Callable[[int], int] | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(token, start, end) without white space and comments; a string in parentheses is one token. They end where a string is not closed.

    ends: what says where a string of these data ends.
    """
    match = _TOKEN.match
    while m := match(data, at):
        token = m[1]
        start, at = m.span(1)
        if token == b"(":
            at = literal_end(data, start) if ends is None else ends(start)
            if at < 0:
                return
            token = data[start:at]
        yield token, start, at


def string_bytes(token: bytes) -> bytes | None:
    """What a string token says; None if it is no string. Of an odd number of hex digits the last counts as if 0 followed."""
    if token[:1] == b"(":
        return decode_literal(token[1:-1])
    if token[:1] == b"<" and token[:2] != b"<<":
        digits = token[1:-1].translate(None, SPACE).decode()
        return bytes.fromhex(digits + "0" * (len(digits) % 2))
    return None


def string_text(token: bytes) -> str | None:
    """A string token as text: UTF-16 with its mark, else UTF-8."""
    raw = string_bytes(token)
    if raw is None:
        return None
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("utf-8", "replace")


def value(data: bytes, at: int, ends: Callable[[int], int] | None = None) -> tuple[dict[str, str], int, int, bytes]:
    """The entries of the value at `at`, where it ends, and the word after it with its end: endobj, stream, obj (of the next one) or nothing; a `)` that closes nothing ends it too.

    Entries are raw text by path: `Type`, `Resources/Font/F1`, `DecodeParms/[1]/Columns`. A string has its text at the
    path and `=` too, an array its length at the path and `/#`. A key that comes again counts as it comes last.
    """
    entries: dict[str, str] = {}
    levels: list[list] = []  # path, key, where its value begins, whether there is one, items (-1: a dictionary)
    last = at

    def close(level: list, end: int) -> None:
        if level[1] is not None and len(levels) <= LEVELS:
            raw = data[level[2] : end].strip(SPACE)
            path = level[0] + level[1]
            entries[path] = raw.decode("latin-1")
            if raw[:1] in b"(<" and (text := string_text(raw)) is not None:
                entries[path + "="] = text

    for token, start, end in tokens(data, at, ends):
        top = levels[-1] if levels else None
        if token in (b"endobj", b"stream", b"obj"):
            for level in reversed(levels):
                close(level, start)
            return entries, start, end, token if not levels else token + b"!"
        if token == b")":
            return entries, last, end, b")!"
        if token in (b"<<", b"["):
            path = "" if top is None else f"{top[0]}{top[1]}/" if top[4] < 0 else f"{top[0]}[{top[4]}]/"
            if top is not None:
                top[3] = True
                top[4] += top[4] >= 0
            levels.append([path, None, end, False, -1 if token == b"<<" else 0])
        elif token in (b">>", b"]"):
            if top is not None and (top[4] < 0) == (token == b">>"):
                if top[4] < 0:
                    close(top, start)
                elif len(levels) <= LEVELS:
                    entries[top[0] + "#"] = str(top[4])
                levels.pop()
        elif top is not None and top[4] >= 0:
            top[4] += -1 if token == b"R" else 1
        elif top is not None and token[:1] == b"/" and (top[1] is None or top[3]):
            close(top, start)
            top[1:4] = token[1:].decode("latin-1"), end, False
        elif top is not None:
            top[3] = True
        last = end
    return entries, last, len(data), b""


@lru_cache(maxsize=KEPT)
def kept_value(piece: bytes) -> tuple[dict[str, str], int, int, bytes]:
    """value() of a piece of a file; its entries are not to be changed."""
    return value(piece, 0)


def object_value(data: bytes, at: int, ends: Callable[[int], int] | None = None) -> tuple[dict[str, str], int, int, bytes]:
    """value() of an object whose text may have been read before: the same bytes up to the same word have the same entries."""
    m = _LAST.search(data, at, at + KEPT_BYTES)
    if m is not None:
        entries, last, end, word = kept_value(data[at : m.end()])
        if end == m.end() - at and word:
            return dict(entries), at + last, at + end, word
    return value(data, at, ends)


def items(raw: str | None) -> list[tuple[str, str]]:
    """(kind, value) of what an array's raw value holds, at any depth: text, name, ref (the object's number), open, close or word."""
    if not raw:
        return []
    return list(_kept_items(raw)) if len(raw) <= KEPT_BYTES else _items(raw)


@lru_cache(maxsize=KEPT)
def _kept_items(raw: str) -> tuple[tuple[str, str], ...]:
    return tuple(_items(raw))


def _items(raw: str) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for token, _, _ in tokens(raw.encode("latin-1")):
        if (text := string_text(token)) is not None:
            out.append(("text", text))
        elif token == b"R" and len(out) > 1:
            out[-2:] = [("ref", out[-2][1])]
        elif token in (b"[", b"<<"):
            out.append(("open", token.decode()))
        elif token in (b"]", b">>"):
            out.append(("close", token.decode()))
        else:
            out.append(("name", token[1:].decode("latin-1")) if token[:1] == b"/" else ("word", token.decode("latin-1")))
    return out


def reference(raw: str | None) -> tuple[int, int] | None:
    m = _REF.fullmatch(raw) if raw and raw[-1] == "R" else None
    return (int(m[1]), int(m[2])) if m else None


def rebuilt(entries: dict[str, str], changes: dict[str, str | None]) -> str:
    """A dictionary's text from its entries, with changes: None takes a key away."""
    own = {k: v for k, v in entries.items() if "/" not in k and not k.endswith(("=", "#", "!")) and "!" not in k} | changes
    return "<< " + " ".join(f"/{k} {v}" for k, v in own.items() if v is not None) + " >>"


def literal_of(data: bytes) -> bytes:
    """A string in parentheses, escaped so that only a decoder gives it back."""
    for plain, escaped in ((b"\\", b"\\\\"), (b"(", b"\\("), (b")", b"\\)"), (b"\n", b"\\n"), (b"\r", b"\\r"), (b"\t", b"\\t"), (b"-", b"\\055")):
        data = data.replace(plain, escaped)
    return b"(" + data + b")"


def renumbered(raw: str, moved: dict[int, int | None], by: int) -> str:
    """A raw value whose references are moved: as `moved` says (None: to null), the others by so many."""
    data = raw.encode("latin-1")
    if b"R" not in data:
        return raw
    out, at = [], 0
    before: list[tuple[bytes, int, int]] = []
    for token, start, end in tokens(data):
        if token == b"R" and len(before) == 2 and before[0][0].isdigit() and before[1][0].isdigit():
            num = int(before[0][0])
            new = moved.get(num, num + by)
            out += [data[at : before[0][1]], b"null" if new is None else b"%d 0 R" % new]
            at, before = end, []
        else:
            before = [*before[-1:], (token, start, end)]
    return b"".join([*out, data[at:]]).decode("latin-1")
