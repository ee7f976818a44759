"""Pattern search as Spark column expressions.

Patterns are the user's or the built-in ones, written for a Unicode-aware,
case-insensitive search where "." stops only at a line feed.  In Spark that is
the flag set below; every pattern goes through here so that none misses it.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = "(?iuUd)"

# Characters that get a backslash when a keyword becomes a pattern.
ESCAPED_CHARS = r"([()\[\]{}?*+\-|^$\\.&~# \t\n\r\x0b\x0c])"


def escape(keyword: Column) -> Column:
    """Keyword text -> pattern text that matches it literally."""
    return F.regexp_replace(keyword, ESCAPED_CHARS, r"\\$1")


def word_pattern(keyword: Column) -> Column:
    """Keyword -> pattern that finds it between word boundaries."""
    return F.concat(F.lit(r"\b"), escape(keyword), F.lit(r"\b"))


def matches_any(text: Column, patterns: list[str]) -> Column:
    """True when any pattern is found in `text`."""
    return text.rlike(alternation(patterns))


def alternation(patterns: list[str]) -> str:
    r"""One pattern that matches where any of `patterns` does.

    Nearly every branch starts at a word boundary with a letter.  Those branches
    are merged behind one boundary and one test of the first letter, and share
    their common beginnings: \bcat\b|\b(cow|dog)s\b becomes
    \b(?=[cd])(?:c(?:at\b|ows\b)|dogs\b).  A long list of patterns then costs
    about as much as a short one.
    """
    found = dict.fromkeys(b for p in patterns for b in _split(p))
    bounded = [e for b in found if b.startswith(r"\b") for e in _without_leading_group(b[2:])]
    parts = [b for b in found if not b.startswith(r"\b")]
    if bounded:
        letters = sorted({b[0] for b in bounded if _starts_plain(b)})
        only_letters = all(_starts_plain(b) for b in bounded)
        first = f"(?=[{''.join(letters)}])" if only_letters else ""
        parts.insert(0, rf"\b{first}(?:{_share_beginnings(bounded)})")
    return f"{FLAGS}(?:{'|'.join(parts)})"


def branches(pattern: str) -> list[str]:
    r"""Patterns without a top-level choice, one of which matches wherever `pattern` does: \b(a|b)c gives \bac, \bbc."""
    found = []
    for branch in _split(pattern):
        if branch.startswith(r"\b"):
            found += [r"\b" + rest for rest in _without_leading_group(branch[2:])]
        else:
            found.append(branch)
    return list(dict.fromkeys(found))


def _split(pattern: str) -> list[str]:
    """Pieces between the "|" outside every group and character class."""
    pieces, level, in_class, i = [""], 0, False, 0
    while i < len(pattern):
        c = pattern[i]
        taken = pattern[i : i + 2] if c == "\\" else c
        if not in_class:
            level += (c == "(") - (c == ")")
        in_class = (c == "[" or in_class) and c != "]"
        if c == "|" and level == 0 and not in_class:
            pieces.append("")
        else:
            pieces[-1] += taken
        i += len(taken)
    return pieces


def _without_leading_group(branch: str) -> list[str]:
    """(a|b)rest -> a rest, b rest; with "?" after the group also rest alone."""
    if not branch.startswith("(") or branch.startswith("(?"):
        return [branch]
    end = next(i for i in range(len(branch)) if branch[i] == ")" and _balanced(branch[: i + 1]))
    inner, rest = branch[1:end], branch[end + 1 :]
    if rest[:1] in ("*", "+", "{"):
        return [branch]
    optional = rest.startswith("?")
    rest = rest[1:] if optional else rest
    choices = [choice + rest for choice in _split(inner)] + ([rest] if optional else [])
    return [e for choice in choices for e in _without_leading_group(choice)]


def _balanced(piece: str) -> bool:
    return piece.count("(") - piece.count(r"\(") == piece.count(")") - piece.count(r"\)")


def _starts_plain(branch: str) -> bool:
    return branch[:1].isalnum() and branch[1:2] not in ("?", "*", "+", "{")


def _share_beginnings(branches: list[str]) -> str:
    groups: dict[str, list[str]] = {}
    others = []
    for branch in dict.fromkeys(branches):
        if _starts_plain(branch):
            first = branch[0].lower() if branch[0].isascii() else branch[0]
            groups.setdefault(first, []).append(branch[1:])
        else:
            others.append(branch)
    merged = [c + (r[0] if len(r) == 1 else f"(?:{_share_beginnings(r)})") for c, r in groups.items()]
    return "|".join(merged + others)
