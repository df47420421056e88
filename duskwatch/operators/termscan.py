"""One-pass search of a line for thousands of literal terms.

All literals are folded into a single regular expression shaped like a prefix
tree, wrapped in a look-ahead so that ``regexp_extract_all`` reports, for every
position of the line, the longest term that starts there. Shorter terms starting
at the same position are prefixes of it and are known beforehand. The cost per
line therefore follows the length of the line, not the number of terms.
"""

from __future__ import annotations

import re
from re import _parser as regex_parser

# siblings tried one after the other, and characters that a guard looks at
_FANOUT, _GUARDED = 2, 4
# what gives a piece of a pattern a meaning beyond its characters
_ESCAPED = re.compile(r"\\([^\w\s])")
_SPECIAL = re.compile(r"[\\^$.|?*+()\[\]{}]")


def fold_term(term: str) -> str | None:
    """Folded form of an ASCII term; None for terms that need a real regex match."""
    return term.lower() if term.isascii() else None


def tree_pattern(terms: list[str]) -> str:
    """Look-ahead pattern whose group 1 is the longest of ``terms`` at a position."""
    tree: dict = {}
    for term in terms:
        node = tree
        for char in term:
            node = node.setdefault(char, {})
        node[""] = {}
    return f"(?s)(?=({_branches(tree)}))"


def _branches(node: dict) -> str:
    text = ""
    while True:
        chars = sorted(c for c in node if c)
        if not chars:
            return text
        if len(chars) == 1 and "" not in node:
            text += _quote(chars[0])
            node = node[chars[0]]
            continue
        options = "|".join(_choices(node, chars))
        return f"{text}(?:{options}){'?' if '' in node else ''}"


def _choices(node: dict, chars: list[str]) -> list[str]:
    # siblings are halved behind guards on the next characters, so that a position
    # where no term starts is given up after a few classes instead of all siblings
    if len(chars) <= _FANOUT:
        return [_quote(c) + _branches(node[c]) for c in chars]
    middle = len(chars) // 2
    return [f"{_guard(node, g)}(?:{'|'.join(_choices(node, g))})" for g in (chars[:middle], chars[middle:])]


def _guard(node: dict, chars: list[str]) -> str:
    """Look-ahead for the characters with which the terms below ``chars`` go on, as far as all of them do."""
    classes = [chars]
    below = [node[c] for c in chars]
    while len(classes) < _GUARDED and not any("" in n for n in below):
        classes.append(sorted({c for n in below for c in n}))
        below = [n[c] for n in below for c in n]
    return "(?=" + "".join(f"[{''.join(map(_quote, c))}]" for c in classes) + ")"


def _quote(char: str) -> str:
    return char if char.isalnum() else f"\\x{ord(char):02x}"


def required_factors(pattern: str) -> list[str] | None:
    """Folded literals of which any match of ``pattern`` must contain one.

    None when no such literals can be told.
    """
    try:
        return _factors(regex_parser.parse(pattern, re.IGNORECASE))
    except (re.error, RecursionError):
        return None


def _factors(items) -> list[str] | None:
    best: list[str] | None = None
    run = ""

    def consider(candidates: list[str] | None) -> None:
        nonlocal best
        if candidates and (best is None or min(map(len, candidates)) > min(map(len, best))):
            best = candidates

    for op, arg in items:
        if op is regex_parser.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        consider([run] if run else None)
        run = ""
        if op is regex_parser.BRANCH:
            parts = [_factors(branch) for branch in arg[1]]
            consider(sum(parts, []) if all(parts) else None)
        elif op is regex_parser.SUBPATTERN and not arg[1] and not arg[2]:
            consider(_factors(arg[3]))
        elif op in (regex_parser.MAX_REPEAT, regex_parser.MIN_REPEAT) and arg[0] >= 1:
            consider(_factors(arg[2]))
    consider([run] if run else None)
    return best


def search_pattern(pattern: str) -> str:
    """A Java pattern that finds something exactly where ``pattern`` would.

    Terms made of literals with ``.*`` between them, the usual kind, are written
    so that each line of text is read once: every literal is taken at its first
    place after the one before, and nothing is tried again.
    """
    options = [[_literal(piece) for piece in option.split(".*") if piece] for option in pattern.split("|")]
    if all(options) and all(None not in option for option in options):
        chains = ("".join(f"(?>.*?{''.join(map(_quote, piece))})" for piece in option) for option in options)
        return "(?iudm)^(?:" + "|".join(chains) + ")"
    return "(?iudU)" + pattern


def _literal(piece: str) -> str | None:
    """The characters a piece of a pattern stands for; None when it is more than that."""
    plain = _ESCAPED.sub("", piece)
    return None if _SPECIAL.search(plain) else _ESCAPED.sub(r"\1", piece)
