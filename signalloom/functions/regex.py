"""Regex dialect helpers shared by all text operators."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \b is Unicode aware: it sees a boundary inside "caf|é" differently from
# ASCII engines.  This spells out the ASCII boundary.
_EDGE = (
    r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
)


def ascii_regex(pattern: str) -> str:
    """Rewrite ``\\b`` to an ASCII word boundary for the JVM regex engine."""
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == "\\" and i + 1 < len(pattern):
            out.append(_EDGE if pattern[i + 1] == "b" else pattern[i : i + 2])
            i += 2
        else:
            out.append(pattern[i])
            i += 1
    return "".join(out)


def led(starts: str, pattern: str) -> str:
    """``pattern`` tried only where ``starts`` fits: no other place can begin a match, and most are passed over at once."""
    flags = "(?i)" if pattern.startswith("(?i)") else ""
    return f"{flags}(?={starts})(?:{pattern.removeprefix(flags)})"


# ---------------------------------------------------------------- dispatch by first letters
class _Unread(ValueError):
    """Syntax whose ways to begin are not known here: the pattern stays as it is."""


_QUANTIFIER = re.compile(r"(?:[*+?]|\{\d+(?:,\d*)?\})[?+]?")
_LOOKS = ("(?=", "(?!", "(?<=", "(?<!")
#: Ways that a pattern is written out in at most.
_MOST_WAYS = 1500


def _class_end(pattern: str, i: int) -> int:
    """The place behind the class that begins at ``i``."""
    j = i + 2 if pattern[i + 1] == "^" else i + 1
    begin = j
    while pattern[j] != "]" or j == begin:
        if pattern[j] in "[]" or pattern[j:j + 2] == "&&" or (pattern[j] == "\\" and pattern[j + 1].isalnum() and pattern[j + 1] not in "dsw"):
            raise _Unread(pattern)
        j += 2 if pattern[j] == "\\" else 1
    return j + 1


def _atom_end(pattern: str, i: int) -> int:
    """The place behind the atom that begins at ``i``."""
    c = pattern[i]
    if c == "\\":
        if pattern[i + 1].isalnum() and pattern[i + 1] not in "bBdsw":
            raise _Unread(pattern)
        return i + 2
    if c == "[":
        return _class_end(pattern, i)
    if c in "*+?{":
        raise _Unread(pattern)
    if c != "(":
        return i + 1
    j, depth = i + 1, 1
    while depth:
        if pattern[j] in "\\[":
            j = _atom_end(pattern, j)
            continue
        depth += {"(": 1, ")": -1}.get(pattern[j], 0)
        j += 1
    return j


def _alternatives(pattern: str) -> list[list[tuple[str, str]]]:
    """The alternatives of a pattern, each as atoms with their quantifiers."""
    out, i = [[]], 0
    while i < len(pattern):
        if pattern[i] == "|":
            out.append([])
            i += 1
            continue
        end = _atom_end(pattern, i)
        many = _QUANTIFIER.match(pattern, end)
        out[-1].append((pattern[i:end], many.group() if many else ""))
        i = many.end() if many else end
    return out


def _inner(atom: str) -> str | None:
    """What a plain group holds."""
    if not atom.startswith("("):
        return None
    if atom.startswith("(?:"):
        return atom[3:-1]
    if atom.startswith("(?"):
        if not atom.startswith(_LOOKS):
            raise _Unread(atom)
        return None
    return atom[1:-1]


def _ways(pattern: str) -> list[list[tuple[str, str]]]:
    """A pattern without plain groups: every way through them as an alternative."""
    out = []
    for atoms in _alternatives(pattern):
        ways = [[]]
        for atom, many in atoms:
            inner = None if many else _inner(atom)
            more = [[(atom, many)]] if inner is None else _ways(inner)
            if len(ways) * len(more) > _MOST_WAYS:
                raise _Unread(pattern)
            ways = [a + b for a in ways for b in more]
        out += ways
    if len(out) > _MOST_WAYS:
        raise _Unread(pattern)
    return out


def _first_signs(way: list[tuple[str, str]]) -> set[str]:
    """Members of a class that holds whatever a match of this way begins with."""
    out = set()
    for atom, many in way:
        if atom in (r"\b", r"\B", "^", "$") or atom.startswith(_LOOKS):
            if many:
                raise _Unread(atom)
            continue
        inner = _inner(atom)
        if inner is not None:
            out |= set().union(*map(_first_signs, _ways(inner)))
        elif atom in (".", r"\w") or atom.startswith("[^"):
            raise _Unread(atom)
        elif atom.startswith("["):
            out.add(atom[1:-1])
        else:
            out.add(atom if len(atom) == 2 else re.sub(r"([\[\]^&-])", r"\\\1", atom))
        if not many.startswith(("?", "*", "{0")):
            return out
    raise _Unread("may be empty")


@lru_cache(maxsize=4096)
def begun(pattern: str) -> str:
    """``pattern``, with all its groups, tried only at signs that it can begin with; as it is where these are not known."""
    try:
        signs = set().union(*map(_first_signs, _ways(pattern)))
    except (_Unread, IndexError):
        return pattern
    return f"(?=[{''.join(sorted(signs))}])(?:{pattern})"


def _folded(way: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return [(atom.lower() if len(atom) == 1 and atom.isascii() else atom, many) for atom, many in way]


def _branches(ways: list[list[tuple[str, str]]]) -> str:
    """Ways as a pattern that tells them apart sign by sign.  Where one ends, longer ones add nothing to a test."""
    if not all(ways):
        return ""
    tails: dict[tuple[str, str], list] = {}
    for first, *rest in ways:
        tails.setdefault(first, []).append(rest)
    out = [atom + many + _branches(rest) for (atom, many), rest in tails.items()]
    return out[0] if len(out) == 1 else f"(?:{'|'.join(out)})"


@lru_cache(maxsize=4096)
def dispatched(pattern: str) -> str | None:
    """A pattern without groups that is found in the same texts, case aside, in a fraction of the time; null where it is not known.

    Alternatives are told apart by their first letters in place of being tried one by one, and nothing is tried at signs that
    begin none of them.
    """
    try:
        ways = [_folded(w) for w in _ways(pattern)]
        signs = set().union(*map(_first_signs, ways))
    except (_Unread, IndexError):
        return None
    return f"(?=[{''.join(sorted(signs))}]){_branches(ways)}"


def quick(pattern: str) -> str:
    """What a test without regard to case uses in place of ``pattern``."""
    return dispatched(pattern) or pattern


def quote(text: str) -> str:
    """Escape a literal so that Java and RE2 both read it verbatim."""
    return "".join("\\" + c if c in r".*+?^${}()|[]\/-" and c not in "/-" else c for c in text)


def words(alternatives: list[str]) -> str:
    """``\\b(a|b|c)\\b`` over regex fragments."""
    return r"\b(?:" + "|".join(alternatives) + r")\b"


def one_of(literals: list[str]) -> str:
    """Any of some plain words, by their first letter: what fails tries a few letters in place of all words."""
    tails: dict[str, list[str]] = {}
    for x in literals:
        tails.setdefault(x[0], []).append(x[1:])
    return "(?:" + "|".join(quote(a) + "(?:" + "|".join(map(quote, rest)) + ")" for a, rest in tails.items()) + ")"


def phrases(literals: list[str]) -> str:
    """``\\b(a|b|c)\\b`` over literal phrases."""
    return words([quote(x) for x in literals])


def plain_words(text: Column) -> Column:
    """Text whose non-ASCII letters and digits became symbols.

    On such text the JVM's own ``\\b`` is an ASCII boundary, which tests about twice
    as fast as the spelled-out one.  Pure ASCII text is returned untouched.
    """
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(
        F.regexp_replace(text, r"[\p{L}\p{N}\p{M}&&[^A-Za-z0-9]]", "¤")
    )


def matches(col: Column, pattern: str) -> Column:
    """Case-insensitive test with a literal pattern; null text does not match."""
    return plain_words(F.coalesce(col, F.lit(""))).rlike("(?i)" + quick(pattern))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: equal parts of branches and lambdas are not shared."""
    return F.get(F.transform(F.array(value), use), 0)


def edged(text: Column, use, *patterns: str) -> Column:
    """``use(*patterns)`` with ``\\b`` in the ASCII sense; in ASCII text the JVM's own one is that, and much faster."""
    spelled = [ascii_regex(p) for p in patterns]
    if spelled == list(patterns):
        return use(*patterns)
    return F.when(F.length(text) == F.octet_length(text), use(*patterns)).otherwise(use(*spelled))


def extract(col: Column, pattern: str, group: int = 0, ignore_case: bool = True) -> Column:
    """First match of ``pattern`` or null."""
    flag = "(?i)" if ignore_case else ""
    found = edged(col, lambda p: F.regexp_extract(col, flag + p, group), begun(pattern))
    return let(found, lambda v: F.when(v != "", v))


def replace(col: Column, pattern: str, by: str, ignore_case: bool = True) -> Column:
    flag = "(?i)" if ignore_case else ""
    return F.regexp_replace(col, flag + ascii_regex(pattern), by)
