"""Byte-level word splitting shared by the operators; ASCII letters are lower-cased, all else is left as it is."""

from __future__ import annotations

#: Separators become a blank, A-Z become a-z, digits, a-z and every byte from 0x80 stay.
ALNUM_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text after lower-casing A-Z."""
    return utf8(text).translate(ALNUM_TABLE).split()


def blank_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text after lower-casing A-Z (bytes.lower and bytes.split know ASCII only)."""
    return utf8(text).lower().split()
