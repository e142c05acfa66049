"""What the codes of text-shows mean: character maps, encodings of simple fonts, and the way back."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from vellum.functions.content import decode_literal, literal_end

_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|<[0-9A-Fa-f\s]*>|[\[\](]|[^\s<>\[\](){}/%]+|/[^\s<>\[\](){}/%]*")
#: Codes are one to four bytes long.
LONGEST = 4


def _tokens(data: bytes):
    """Strings as bytes in a pair with True, all else with False."""
    at = 0
    while m := _TOKEN.search(data, at):
        token, at = m[0], m.end()
        if token == b"(":
            end = literal_end(data, m.start())
            if end < 0:
                continue
            yield decode_literal(data[m.start() + 1 : end - 1]), True
            at = end
        elif token[:1] == b"<" and token != b"<<":
            digits = re.sub(rb"\s+", b"", token[1:-1])
            if len(digits) % 2 == 0:
                yield bytes.fromhex(digits.decode()), True
        elif token[:1] != b"%":
            yield token, False


def _utf16(data: bytes) -> str:
    return data.decode("utf-16-be", "replace") if len(data) > 1 else data.decode("latin-1")


def _moved(data: bytes, by: int) -> bytes:
    """The last 16 bits of a target, counted on."""
    if len(data) < 2:
        return bytes([(data[0] + by) & 255])
    return data[:-2] + ((int.from_bytes(data[-2:], "big") + by) & 0xFFFF).to_bytes(2, "big")


@lru_cache(maxsize=16)
def cmap(data: bytes) -> dict[str, str]:
    """Code in hex digits -> text, of the bfchar and bfrange sections; as many entries count as the number before says.

    The last few are kept, since the fonts of a document, and often those of its neighbours, have the same map: not to be changed.
    """
    found: dict[str, str] = {}
    tokens = list(_tokens(data))
    i = 0
    while i < len(tokens):
        token, is_string = tokens[i]
        i += 1
        if is_string or token not in (b"beginbfchar", b"beginbfrange") or i < 2 or not tokens[i - 2][0].isdigit():
            continue
        for _ in range(int(tokens[i - 2][0])):
            size = 2 if token == b"beginbfchar" else 3
            part = tokens[i : i + size]
            if len(part) < size:
                break
            i += size
            good = [s and len(t) > 0 for t, s in part]
            if size == 2:
                if all(good):
                    found[part[0][0].hex().upper()] = _utf16(part[1][0])
                continue
            first, last = (int.from_bytes(p[0], "big") for p in part[:2])
            width = len(part[0][0]) * 2
            if part[2][0] == b"[" and not part[2][1]:
                code = first
                while i < len(tokens) and tokens[i] != (b"]", False):
                    if tokens[i][1] and code <= last and all(good[:2]):
                        found[f"{code:0{width}X}"] = _utf16(tokens[i][0])
                        code += 1
                    i += 1
                i += 1
            elif all(good):
                for code in range(first, min(last, first + 0xFFFF) + 1):
                    found[f"{code:0{width}X}"] = _utf16(_moved(part[2][0], code - first))
    return found


def by_cmap(codes: bytes, known: dict[str, str]) -> str | None:
    """The text of codes, at each place by the longest code that the map has; None where it has none."""
    out, i, digits = [], 0, codes.hex().upper()
    while i < len(digits):
        for n in range(min(2 * LONGEST, len(digits) - i), 0, -2):
            if (text := known.get(digits[i : i + n])) is not None:
                out.append(text)
                i += n
                break
        else:
            return None
    return "".join(out) if digits else None


def to_codes(text: str, known: dict[str, str]) -> bytes | None:
    """The codes of a text: its longest pieces first; of equal pieces the one with the smallest code. None if a piece has none."""
    back: dict[str, str] = {}
    for code in sorted(known):
        if known[code]:
            back.setdefault(known[code], code)
    pieces = sorted(back, key=lambda p: (-len(p.encode()), p))
    out, i = [], 0
    while i < len(text):
        piece = next((p for p in pieces if text.startswith(p, i)), None)
        if piece is None:
            return None
        out.append(back[piece])
        i += len(piece)
    return bytes.fromhex("".join(out))


#: Glyph names of signs, and the signs.
SIGNS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",",
    "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<",
    "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}",
    "asciitilde": "~", "exclamdown": "¡", "cent": "¢", "sterling": "£", "fraction": "⁄", "yen": "¥", "florin": "ƒ", "section": "§", "currency": "¤", "quotedblleft": "“", "guillemotleft": "«", "guilsinglleft": "‹",
    "guilsinglright": "›", "fi": "ﬁ", "fl": "ﬂ", "endash": "–", "dagger": "†", "daggerdbl": "‡", "periodcentered": "·", "paragraph": "¶", "bullet": "•", "quotesinglbase": "‚", "quotedblbase": "„", "quotedblright": "”",
    "guillemotright": "»", "ellipsis": "…", "perthousand": "‰", "questiondown": "¿", "acute": "´", "circumflex": "ˆ", "tilde": "˜", "macron": "¯", "breve": "˘", "dotaccent": "˙", "dieresis": "¨", "ring": "˚", "cedilla": "¸",
    "hungarumlaut": "˝", "ogonek": "˛", "caron": "ˇ", "emdash": "—", "AE": "Æ", "ordfeminine": "ª", "Lslash": "Ł", "Oslash": "Ø", "OE": "Œ", "ordmasculine": "º", "ae": "æ", "dotlessi": "ı", "lslash": "ł", "oslash": "ø",
    "oe": "œ", "germandbls": "ß", "quoteleft": "‘", "quoteright": "’", "copyright": "©", "registered": "®", "trademark": "™", "degree": "°", "mu": "µ", "plusminus": "±", "multiply": "×", "divide": "÷", "logicalnot": "¬",
    "onehalf": "½", "onequarter": "¼", "threequarters": "¾", "onesuperior": "¹", "twosuperior": "²", "threesuperior": "³", "brokenbar": "¦", "Eth": "Ð", "eth": "ð", "Thorn": "Þ", "thorn": "þ", "Euro": "€", "minus": "−",
}
#: Marks that a letter's glyph name may end in.
MARKS = {"acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "ring": "̊", "caron": "̌", "cedilla": "̧"}
#: Codes of the standard encoding from 161 on.
STANDARD = {
    161: "exclamdown", 162: "cent", 163: "sterling", 164: "fraction", 165: "yen", 166: "florin", 167: "section", 168: "currency", 169: "quotesingle", 170: "quotedblleft", 171: "guillemotleft", 172: "guilsinglleft",
    173: "guilsinglright", 174: "fi", 175: "fl", 177: "endash", 178: "dagger", 179: "daggerdbl", 180: "periodcentered", 182: "paragraph", 183: "bullet", 184: "quotesinglbase", 185: "quotedblbase", 186: "quotedblright",
    187: "guillemotright", 188: "ellipsis", 189: "perthousand", 191: "questiondown", 193: "grave", 194: "acute", 195: "circumflex", 196: "tilde", 197: "macron", 198: "breve", 199: "dotaccent", 200: "dieresis", 202: "ring",
    203: "cedilla", 205: "hungarumlaut", 206: "ogonek", 207: "caron", 208: "emdash", 225: "AE", 227: "ordfeminine", 232: "Lslash", 233: "Oslash", 234: "OE", 235: "ordmasculine", 241: "ae", 245: "dotlessi", 248: "lslash",
    249: "oslash", 250: "oe", 251: "germandbls",
}
#: Fonts that have the standard encoding if they say nothing: three families in four styles.
STANDARD_FONTS = {f"{family}{style}" for family, styles in (("Courier", ("", "-Bold", "-Oblique", "-BoldOblique")), ("Helvetica", ("", "-Bold", "-Oblique", "-BoldOblique")), ("Times", ("-Roman", "-Bold", "-Italic", "-BoldItalic"))) for style in styles}


def glyph(name: str) -> str:
    """The character of a glyph's name; empty if it isn't known."""
    if len(name) == 1:
        return name
    if m := re.fullmatch(r"uni([0-9A-F]{4})|u([0-9A-F]{4,6})", name):
        code = int(m[1] or m[2], 16)
        return chr(code) if code < 0x110000 else ""
    if name in SIGNS:
        return SIGNS[name]
    composed = unicodedata.normalize("NFC", name[:1] + MARKS.get(name[1:], "  "))
    return composed if len(composed) == 1 else ""


def base_encoding(name: str) -> list[str] | None:
    """Characters by code: empty where the encoding has none; None for an unknown one."""
    if name == "StandardEncoding":
        plain = [chr(c) if 32 <= c < 127 else "" for c in range(256)]
        plain[39], plain[96] = "’", "‘"
        return [glyph(STANDARD[c]) if c in STANDARD else plain[c] for c in range(256)]
    codec = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}.get(name)
    if codec is None:
        return None
    return ["" if c < 32 or c == 127 else bytes([c]).decode(codec, "ignore") for c in range(256)]


def encoding(font: dict[str, str], differences: list[tuple[str, str]]) -> list[str] | None:
    """Characters by code of a simple font, from its entries and what /Differences lists; None if it says nothing."""
    raw = font.get("Encoding", "")
    if raw.startswith("/"):
        return base_encoding(raw[1:])
    if not raw:
        known = font.get("Subtype") == "/Type1" and re.sub(r"^[A-Z]{6}\+", "", font.get("BaseFont", "/")[1:]) in STANDARD_FONTS
        return base_encoding("StandardEncoding") if known else None
    out = base_encoding(font.get("Encoding/BaseEncoding", "/StandardEncoding")[1:])
    code = -1
    for kind, value in differences if out else ():
        if kind == "word" and value.isdigit():
            code = int(value) if int(value) < 256 else -1
        elif kind == "name" and 0 <= code < 256:
            out[code] = glyph(value)
            code += 1
    return out


def one_text(codes: bytes, kind: str, known: dict[str, str] | None, table) -> tuple[str | None, str]:
    """(text, encoding) of a text-show's codes; no text if what its font says does not fit.

    A character map counts for hex strings alone, an encoding for all; an array with plain strings under a map is passed over.
    """
    name = "tj-array" if kind.startswith("tj-array") else kind
    in_hex = kind in ("hex", "tj-array-hex", "tj-array-mixed")
    if known and kind in ("tj-array", "tj-array-mixed"):
        return None, name
    if known and in_hex and (text := by_cmap(codes, known)) is not None:
        return text, f"{name}-cmap"
    if table is not None:
        return "".join(table[b] or "�" for b in codes), f"{name}-font-encoding"
    if in_hex and kind != "hex" and any(b > 127 for b in codes):
        return None, name
    return codes.decode("utf-8", "replace"), name


def widths(font: dict[str, str], below: dict[str, str], words: list[tuple[str, str]]) -> tuple[dict[int, int], int | None, int] | None:
    """Width by code, that of other codes, and bytes of a code: of a simple font, or of one of characters by number; None if the font says nothing.

    words: what the font's /Widths or the descendant's /W holds.
    """
    if font.get("Subtype") == "/Type0":
        if font.get("Encoding") not in ("/Identity-H", "/Identity-V") or not below:
            return None
        found, numbers, inside = {}, [], None
        for kind, value in words[1:-1]:
            if kind == "open":
                inside = numbers.pop() if numbers else 0
            elif kind == "close":
                inside, numbers = None, []
            elif inside is not None:
                found[inside] = int(float(value))
                inside += 1
            else:
                numbers.append(int(float(value)))
                if len(numbers) == 3:
                    found |= {c: numbers[2] for c in range(numbers[0], min(numbers[1], numbers[0] + 0xFFFF) + 1)}
                    numbers = []
        default = below.get("DW", "1000")
        return found, int(default) if default.isdigit() else None, 2
    first, rows = font.get("FirstChar", ""), [v for kind, v in words if kind == "word"]
    if not first.isdigit() or not rows or not all(re.fullmatch(r"\d+", v) for v in rows):
        return None
    default = font.get("MissingWidth", font.get("FontDescriptor/MissingWidth", ""))
    return {int(first) + i: int(v) for i, v in enumerate(rows)}, int(default) if default.isdigit() else None, 1


def width(codes: bytes, known: tuple[dict[int, int], int | None, int]) -> int | None:
    table, default, size = known
    if len(codes) % size:
        return None
    each = [table.get(int.from_bytes(codes[i : i + size], "big"), default) for i in range(0, len(codes), size)]
    return None if None in each else sum(each)


def proof(old: bytes, new: bytes, known: tuple[dict[int, int], int | None, int] | None) -> str:
    """How wide new codes are against the old ones."""
    if known is None:
        return "unknown"
    a, b = width(old, known), width(new, known)
    if a is None or b is None:
        return "width_unproven"
    return "width_proven" if a == b else "width_narrower" if b < a else "reflow_required"


def operand(kind: str, text: str, known: dict[str, str] | None, table) -> tuple[bytes | None, bytes | None, str | None]:
    """(operand, codes, reason against it) of a text in the encoding that a text-show has."""
    from vellum.sources.syntax import literal_of

    if kind.endswith("-cmap"):
        codes, reason = to_codes(text, known or {}), "cmap_unrepresentable"
    elif kind.endswith("-font-encoding"):
        back: dict[str, int] = {}
        for i, c in enumerate(table or ()):
            if len(c) == 1:
                back.setdefault(c, i)
        codes, reason = bytes(back[c] for c in text) if all(c in back for c in text) else None, "font_encoding_unrepresentable"
    else:
        in_hex = kind == "hex"
        codes, reason = text.encode() if not in_hex or text.isascii() else None, "unsupported_encoding"
    if codes is None:
        return None, None, reason
    hexed = kind.startswith("hex") or kind.endswith("-cmap")
    token = b"<" + codes.hex().upper().encode() + b">" if hexed else literal_of(codes)
    return b"[" + token + b"]" if kind.startswith("tj-array") else token, codes, None
