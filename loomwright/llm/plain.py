"""Plain form of texts for passage search: what layout, escapes, markup and look-alikes can't change."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np

# fixed values: letters of other scripts that look like Latin ones
_LOOKALIKE = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ᴏ": "o",
}
_TABLE = str.maketrans(_LOOKALIKE)
_U = re.compile(r"\\+u([0-9a-fA-F]{4})")
_ESC = re.compile(r"\\+[nrt]")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,80}>|<!--.{0,200}?-->")
_PAGE = re.compile(r"[\[(]\s*(?:p|pp|page|第)\s*\.?\s*\d{1,4}\s*页?\s*[\])]", re.I)
TOKEN = re.compile(r"[a-z]+|\d|[^\W_a-z\d]")


def plain(text: str) -> str:
    """Unescaped, without tags and page marks, compatibility-folded, lower case, look-alikes in Latin."""
    if "\\" in text:
        text = _ESC.sub(" ", _U.sub(lambda m: chr(int(m[1], 16)), text))
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    if "[" in text or "(" in text:
        text = _PAGE.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)) if any("À" <= c <= "ɏ" or "̀" <= c <= "ͯ" for c in text) else text
        text = text.lower().translate(_TABLE)
        return text.replace("​", "").replace("‌", "").replace("‍", "").replace("⁠", "").replace("﻿", "").replace("­", "")
    return text.lower()


def tokens(text: str) -> list[str]:
    """Latin words, single digits and single letters of other scripts."""
    return TOKEN.findall(plain(text))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
