"""Cutting texts into units that byte-level BPE encodes independently of each other.

Every match of the pre-token pattern begins anew at a space that a character other than
white space follows: the space can only join what follows it, and nothing before it can
reach across it. Texts are cut there, so the ids of a text are those of its units in
order, and a unit that occurs many times has to be encoded only once.
"""

from __future__ import annotations

import regex

_ODD = regex.compile(r" (?:\s|\Z)")
_CUT = regex.compile(r" (?=\S)")


def units(text: str) -> list[str]:
    if not text:
        return []
    if _ODD.search(text) is None:
        first, *rest = text.split(" ")
        rest = [" " + x for x in rest]
        return [first, *rest] if first else rest
    cuts = [0, *(m.start() for m in _CUT.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
