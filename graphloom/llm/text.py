"""Plain words of a text, whatever its layout, markup, escapes and encoding."""

from __future__ import annotations

import html
import re
import unicodedata

TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
# A name in brackets is markup if it has a value, closes, is closed somewhere, or stands alone by rule.
_BRACKET = re.compile(r"\[(/?)([A-Za-z]+\d?)(=[^\[\]\s]*)?\]")
_ALONE = frozenset({"br", "hr"})
_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*\)")
# Escapes of an escape's own sign, however often: one is left, so that few rounds undo them all.
_AGAIN = ((re.compile(r"&(?:amp;)+"), "&"), (re.compile(r"%(?:25)+(?=[0-9A-Fa-f]{2})"), "%"), (re.compile(r"=(?:3D)+(?=[0-9A-F]{2})"), "="), (re.compile(r"\\+(?=[\"'/nrtbfux])"), r"\\"))
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,31});")
_UNICODE = re.compile(r"(?:\\u[0-9a-fA-F]{4})+")
_BYTE = re.compile(r"(?:\\x[0-9a-fA-F]{2})+")
_CONTROL = re.compile(r"\\[nrtbf]")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_PRINTABLE = re.compile(r"(?:=[0-9A-F]{2})+")
# A run that UTF-8 read as a one-byte encoding leaves behind.
_MOJIBAKE = re.compile("[\xc2-\xf4](?:[\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]){1,3}")
_BROKEN = re.compile(r"(?<=\w)[-‐‑\xad][ \t\r]*\n[>\s|]*(?=\w)")


def _bytes_or(text: str, pairs: list[str]) -> str:
    try:
        return bytes(int(p, 16) for p in pairs).decode("utf-8")
    except UnicodeDecodeError:
        return text


def _one_byte(run: str) -> str:
    out = bytearray()
    for c in run:
        if ord(c) < 256:
            out.append(ord(c))
        else:
            out += c.encode("cp1252", "ignore")
    try:
        return out.decode("utf-8")
    except UnicodeDecodeError:
        return run


def unescape(text: str) -> str:
    """Undo entities, backslash, percent and quoted-printable escapes and misread UTF-8, until
    nothing is left to undo. Every step shortens the text."""
    while True:
        before = text
        for (sign, one), mark in zip(_AGAIN, "&%=\\"):
            if mark in text:
                text = sign.sub(one, text)
        if "&" in text and _ENTITY.search(text):
            text = html.unescape(text)
        if "\\" in text:
            text = _UNICODE.sub(lambda m: m[0].encode().decode("unicode_escape").encode("utf-16", "surrogatepass").decode("utf-16", "replace"), text)
            text = _BYTE.sub(lambda m: _bytes_or(m[0], re.findall(r"[0-9a-fA-F]{2}", m[0])), text)
            text = _CONTROL.sub("\n", text).replace('\\"', '"').replace("\\'", "'").replace("\\/", "/")
        if "%" in text:
            text = _PERCENT.sub(lambda m: _bytes_or(m[0], m[0].split("%")[1:]), text)
        if "=" in text and _PRINTABLE.search(text):
            text = _PRINTABLE.sub(lambda m: _bytes_or(m[0], m[0].split("=")[1:]), text.replace("=\r\n", "").replace("=\n", ""))
        if _MOJIBAKE.search(text):
            text = _MOJIBAKE.sub(lambda m: _one_byte(m[0]), text)
        if text == before:
            return text


_NON_ASCII = re.compile(r"[^\x00-\x7f]+")
# What is neither letter, digit nor white space.
_SIGNS = re.compile(r"[^\w\s]+|_+")


class _Dropped(dict):
    """Code points of marks and invisible characters to None, all others to themselves."""

    def __missing__(self, code: int) -> int | None:
        char = chr(code)
        self[code] = None if unicodedata.category(char).startswith(("M", "Cf")) and not char.isspace() else code
        return self[code]


_DROPPED = _Dropped()


def fold(text: str) -> str:
    """text without case, accents, width variants and invisible characters; broken words joined."""
    text = _BROKEN.sub("", text)
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).casefold())
    return _NON_ASCII.sub(lambda m: m[0].translate(_DROPPED), text)


def without_markup(text: str) -> str:
    """text with blanks in place of tags; of a link its words stay."""
    if "](" in text:
        text = _LINK.sub(r" \1 ", text)
    if "<" in text:
        text = TAG.sub(" ", text)
    if "[" in text:
        closed = {m[2].lower() for m in _BRACKET.finditer(text) if m[1]}
        if closed or "=" in text or "br]" in text.lower() or "hr]" in text.lower():
            text = _BRACKET.sub(lambda m: " " if m[1] or m[3] or m[2].lower() in closed or m[2].lower() in _ALONE else m[0], text)
    return text


def words(text: str | None, vocabulary: frozenset[str] | set[str] = frozenset()) -> list[str]:
    """The words of a text in order: runs set apart by white space or markup, their letters and
    digits in folded form. Two parts of a word that a line break sets apart are joined if the whole
    is in the vocabulary and the parts are not. NULL and blank texts have none."""
    if not text:
        return []
    plain = _SIGNS.sub("", fold(without_markup(unescape(text))))
    if not vocabulary:
        return plain.split()
    out: list[str] = []
    for line in plain.split("\n"):
        tokens = line.split()
        if tokens and out and vocabulary and joins(out[-1], tokens[0], vocabulary):
            tokens[0] = out.pop() + tokens[0]
        out += tokens
    return out


def joins(left: str, right: str, vocabulary: frozenset[str] | set[str]) -> bool:
    return left + right in vocabulary and not (left in vocabulary and right in vocabulary)
