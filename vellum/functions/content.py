"""Strings and text-show operators in content streams: a tokenizer of one pass that keeps the text state."""

from __future__ import annotations

import re
from collections.abc import Iterator

_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_ESCAPE = re.compile(rb"\\(\r\n|[0-7]{1,3}|.)|\r\n|\r", re.S)
_TOKEN = re.compile(rb"[^\s/<>\[\](){}%]+|\((?:[^()\\]++|\\.)*+\)|%[^\r\n]*|/[^\s/<>\[\](){}%]*|<<|>>|<[0-9A-Fa-f\s]*>|[\[\](]", re.S)
_NEST = re.compile(rb"\\.|[()]", re.S)
#: A text of one string in the plainest form; it leaves no state behind.
_PLAIN = re.compile(
    rb"BT\s+/([^\s/<>\[\](){}%]*)\s+([-+]?(?:\d+\.?\d*|\.\d+))\s+Tf\s+([-+]?(?:\d+\.?\d*|\.\d+))\s+([-+]?(?:\d+\.?\d*|\.\d+))\s+Td\s*"
    rb"(\((?:[^()\\]++|\\.)*+\))\s*Tj\s+ET(?:\s+|$)", re.S,
)
_NUMBER = re.compile(rb"[-+]?(?:\d+\.?\d*|\.\d+)")


def decode_literal(body: bytes) -> bytes:
    """What stands between the parentheses, without its escapes; a line end counts as a line feed, an escaped one as nothing."""

    if b"\\" not in body and b"\r" not in body:
        return body

    def plain(m: re.Match) -> bytes:
        if m[1] is None:
            return b"\n"
        x = m[1]
        if x[:1] in b"01234567":
            return bytes([int(x, 8) & 255])
        return b"" if x in (b"\r\n", b"\n", b"\r") else _ESCAPES.get(x, x)

    return _ESCAPE.sub(plain, body)


def literal_end(data: bytes, at: int) -> int:
    """Where the string that opens at `at` ends; -1 if it does not."""
    depth = 0
    for m in _NEST.finditer(data, at):
        depth += (m[0] == b"(") - (m[0] == b")")
        if depth == 0:
            return m.end()
    return -1


class Strings:
    """literal_end() of one file, again and again: when strings have been read twice the file's length, all parentheses are matched at once."""

    def __init__(self, data: bytes):
        self.data, self.left, self.ends = data, 2 * len(data), None

    def __call__(self, at: int) -> int:
        if self.ends is None:
            end = literal_end(self.data, at)
            self.left -= (end if end >= 0 else len(self.data)) - at
            if self.left < 0:
                self._match()
            return end
        return self.ends[at] if at in self.ends else literal_end(self.data, at)  # one that stands behind a backslash

    def _match(self) -> None:
        self.ends, opened = {}, []
        for m in _NEST.finditer(self.data):
            if m[0] == b"(":
                opened.append(m.start())
            elif m[0] == b")" and opened:
                self.ends[opened.pop()] = m.end()
        self.ends |= dict.fromkeys(opened, -1)


class State:
    """Font, size, place and spacing of text; it lives between BT and ET alone."""

    def __init__(self):
        self.inside = False
        self.reset(False)

    def reset(self, inside: bool) -> None:
        self.inside, self.font, self.size, self.x, self.y, self.leading = inside, None, None, 0.0, 0.0, 0.0
        self.char_space, self.word_space, self.scale, self.rise, self.mode = 0.0, 0.0, 100.0, 0.0, 0

    def next_line(self) -> None:
        self.y -= self.leading

    def apply(self, operator: bytes, names: list[bytes], numbers: list[float]) -> None:
        if operator in (b"BT", b"ET"):
            self.reset(operator == b"BT")
        if not self.inside:
            return
        last = numbers[-1] if numbers else None
        if operator == b"Tf" and names and last is not None:
            self.font, self.size = names[-1][1:].decode("latin-1"), last
        elif operator in (b"Td", b"TD") and len(numbers) > 1:
            self.x, self.y = self.x + numbers[-2], self.y + last
            if operator == b"TD":
                self.leading = -last
        elif operator == b"Tm" and len(numbers) > 5:
            self.x, self.y = numbers[-2], last
        elif operator == b"T*":
            self.next_line()
        elif last is not None and operator in _SETTERS:
            setattr(self, _SETTERS[operator], int(last) if operator == b"Tr" else last)


_SETTERS = {b"TL": "leading", b"Tc": "char_space", b"Tw": "word_space", b"Tz": "scale", b"Ts": "rise", b"Tr": "mode"}


def _strings_of(operand: list) -> tuple[bytes, bool]:
    """An operand's bytes, and whether a string of it is in hex."""
    return b"".join(s[0] for s in operand), any(s[1] == "hex" for s in operand)


def text_shows(data: bytes) -> Iterator[tuple[str, bytes, str, int, int, State]]:
    """(operator, bytes, encoding, start and end of the operand, state) of each text-show, in order; `Do` with the name as bytes.

    Tj and TJ follow their operand at once, `"` two numbers and it. A hex string of an odd number of digits, and an array
    with anything but strings and numbers, are passed over.
    """
    at, state = 0, State()
    while m := _PLAIN.match(data, at):
        state.reset(True)
        state.font, state.size, state.x, state.y = m[1].decode("latin-1"), float(m[2]), 0.0 + float(m[3]), 0.0 + float(m[4])
        yield "Tj", decode_literal(m[5][1:-1]), "literal", *m.span(5), state
        at = m.end()
    state.reset(False)
    if at == len(data):
        return
    numbers: list[float] = []
    names: list[bytes] = []
    operand: tuple | None = None  # bytes, encoding, start, end, numbers before it
    opened, held, bad, depth = None, [], False, 0
    while m := _TOKEN.search(data, at):
        token, at = m[0], m.end()
        string = None
        if token[:1] == b"(":
            end = at if at - m.start() > 1 else literal_end(data, m.start())
            if end < 0:
                return
            string = (decode_literal(data[m.start() + 1 : end - 1]), "literal", m.start(), end)
            at = end
        elif token[:1] == b"<" and token != b"<<":
            digits = re.sub(rb"\s+", b"", token[1:-1])
            bad = bad or len(digits) % 2 == 1
            string = (b"" if len(digits) % 2 else bytes.fromhex(digits.decode()), "hex", m.start(), at)
        if string:
            if depth:
                continue
            if opened is not None:
                held.append(string)
            else:
                operand, numbers = (*string, len(numbers)), []
        elif token == b"<<":
            depth += 1
            bad = bad or opened is not None
        elif token == b">>":
            depth = max(0, depth - 1)
        elif depth or token[:1] == b"%":
            continue
        elif token == b"[":
            opened, held, bad = m.start(), [], False
        elif token == b"]":
            if opened is not None:
                whole, in_hex = _strings_of(held)
                kind = "tj-array-mixed" if in_hex and any(s[1] == "literal" for s in held) else "tj-array-hex" if in_hex else "tj-array"
                operand, numbers = (whole, kind, opened, at, len(numbers)), []
            opened = None
        elif token[:1] == b"/":
            names.append(token)
            bad = bad or opened is not None
        elif _NUMBER.fullmatch(token):
            if opened is None:
                numbers.append(float(token))
        else:
            if token in (b"Tj", b"TJ", b"'", b'"'):
                if token == b'"' and operand and operand[4] >= 2:
                    state.word_space, state.char_space = before[-2:]
                if token in (b"'", b'"'):
                    state.next_line()
                if operand and not bad and not numbers and (token != b'"' or operand[4] >= 2):
                    yield token.decode(), *operand[:4], state
            elif token == b"Do" and names:
                yield "Do", names[-1][1:], "name", m.start(), at, state
            else:
                state.apply(token, names, numbers)
            numbers, names, operand, opened, bad = [], [], None, None, False
        if not string and token != b"]":
            before = list(numbers)
