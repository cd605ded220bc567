"""Patterns with \\p{L} and \\p{N}, run by the faster standard engine where a text allows it."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import regex

BASIC = 0x10000


@lru_cache(1)
def _classes() -> dict[str, str]:
    """Inner parts of character classes for letters and numbers of the basic plane."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(BASIC)] + [""]
    parts: dict[str, list[str]] = {"L": [], "N": []}
    start = 0
    for c in range(1, BASIC + 1):
        if kinds[c] != kinds[start]:
            if kinds[start] in parts:
                parts[kinds[start]].append(rf"\u{start:04x}-\u{c - 1:04x}")
            start = c
    return {kind: "".join(ranges) for kind, ranges in parts.items()}


class Pattern:
    """One pattern, compiled twice: for texts of the basic plane only, and for all others.

    Inside and outside of classes, \\p{L} and \\p{N} become plain ranges for the standard engine;
    \\s must stand for Unicode white space, which both engines are given as ranges.
    """

    SPACE = r"\x09-\x0D\x20\x85\xA0  -     　"

    def __init__(self, pattern: str):
        spelled = self._spell(pattern.replace(r"\S", rf"[^{self.SPACE}]"), r"\s", self.SPACE)
        self.full = regex.compile(spelled)
        for kind, ranges in _classes().items():
            spelled = self._spell(spelled, rf"\p{{{kind}}}", ranges)
        self.basic = re.compile(spelled)

    @staticmethod
    def _spell(pattern: str, name: str, ranges: str) -> str:
        """Put ranges in the place of name, with brackets where it stands outside of a class."""
        out, inside, i = [], False, 0
        while i < len(pattern):
            if pattern.startswith(name, i):
                out.append(ranges if inside else f"[{ranges}]")
                i += len(name)
                continue
            step = 2 if pattern[i] == "\\" else 1
            if step == 1 and pattern[i] in "[]":
                inside = pattern[i] == "["
            out.append(pattern[i:i + step])
            i += step
        return "".join(out)

    def engine(self, text: str):
        """The compiled form for this text."""
        return self.basic if text.isascii() or max(text) < "\U00010000" else self.full
