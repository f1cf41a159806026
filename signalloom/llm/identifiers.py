"""Personal identifiers in texts, plain and disguised, with places in the text as it is.

Disguises are undone by transducers that rewrite a text and keep, for every sign they write, the stretch of the source that it stands
for.  The same detectors then run on the plain and on the rewritten text, and spans found there are mapped back.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_columns

KINDS = ("email", "ip", "card", "phone")

# ---- fixed values -------------------------------------------------------------------------------

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J",
    "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "ս": "u", "օ": "o", "ց": "g",
}
#: Signs that look like or stand for the ASCII signs which identifiers are made of.
SIGNS = {
    "․": ".", "。": ".", "｡": ".", "·": ".", "•": ".", "‧": ".", "∙": ".", "⋅": ".", "۔": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-",
    "―": "-", "−": "-", "⁃": "-", "﹣": "-", "－": "-", "᛫": ".", "٠": "0", "ǀ": "l",
}
#: Signs without a width.
UNSEEN = "­​‌‍⁠⁡⁢⁣﻿͏᠎"
#: Words for digits in English, French, German and Spanish.
DIGIT_WORDS = {
    "zero": 0, "oh": 0, "nought": 0, "naught": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "zéro": 0, "un": 1, "une": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "fuenf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
TIMES = {"double": 2, "triple": 3}
AT_WORDS = ("at", "arobase", "arroba", "klammeraffe")
DOT_WORDS = ("dot", "point", "punkt", "punto")
#: Ends of domains that a bare "at" or "dot" may lead to.
DOMAIN_ENDS = (
    "com", "org", "net", "edu", "gov", "mil", "info", "biz", "int", "io", "co", "app", "dev", "xyz", "online", "site", "example", "uk", "de", "fr",
    "es", "eu", "ca", "ch", "nl", "be", "at", "pl", "se", "dk", "pt", "br", "mx", "ru", "cn", "jp", "kr", "au", "nz",
)

# ---- detectors ----------------------------------------------------------------------------------

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+)?")
_IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_CARD_LONG = re.compile(r"[0-9](?:[\x20-]?[0-9]){15}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = str.maketrans("", "", " -().+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # A run of local-part signs that no domain follows matches from none of its places, so each run is looked at once.
    if "@" in text:
        yield from (m.span() for m in _EMAIL.finditer(text) if m[1])


def _ips(text: str) -> Iterator[tuple[int, int]]:
    if re.search(r"[0-9]\.[0-9]", text):
        for m in _IP.finditer(text):
            if m[1] and all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    if _CARD_LONG.search(text):
        for m in _CARD.finditer(text):
            digits = m[0].translate(_NO_DIGIT) if m.end() - m.start() < 64 else ""
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield m.span()


DETECTORS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}

# ---- transducers --------------------------------------------------------------------------------

#: Kinds of rewritten signs: untouched, a sign for a sign, a disguise in brackets or the like, a bare word for "@", a bare word for ".".
SAME, SIGN, MARKED, BARE_AT, BARE_DOT = range(5)


class Rewritten:
    """A text with, for each of its signs, the source stretch it stands for and how it came about (None: the text itself)."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None, kind: np.ndarray | None = None):
        self.text, self.start, self.end, self.kind = text, start, end, kind
        low = text.lower()
        #: The text in lower case, sign by sign.
        self.low = low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)

    def put(self, edits: list[tuple[int, int, str, int, list[tuple[int, int]] | None]]) -> Rewritten:
        """Replace stretches (start, end, new, kind, stretches behind the new signs or None for the whole), which are in order."""
        if not edits:
            return self
        if self.start is None:
            at = np.arange(len(self.text) + 1, dtype=np.int64)
            start, end, kind = at[:-1], at[1:], np.zeros(len(self.text), np.int8)
        else:
            start, end, kind = self.start, self.end, self.kind
        texts, starts, ends, kinds, at = [], [], [], [], 0
        for a, b, new, how, behind in edits:
            texts += [self.text[at:a], new]
            starts.append(start[at:a])
            ends.append(end[at:a])
            kinds.append(kind[at:a])
            if new:
                behind = behind or [(a, b)] * len(new)
                starts.append(np.array([start[x] for x, _ in behind], np.int64))
                ends.append(np.array([end[y - 1] for _, y in behind], np.int64))
                kinds.append(np.full(len(new), how, np.int8))
            at = b
        texts.append(self.text[at:])
        return Rewritten("".join(texts), *(np.concatenate([*x, y[at:]]) for x, y in ((starts, start), (ends, end), (kinds, kind))))


@lru_cache(maxsize=1 << 16)
def _plain_sign(c: str) -> str | None:
    """The ASCII sign that a sign stands for; empty if it has no width, None if it stands for itself."""
    if c in UNSEEN or unicodedata.category(c) == "Cf":
        return ""
    if c in LOOKALIKES or c in SIGNS:
        return LOOKALIKES.get(c) or SIGNS[c]
    if unicodedata.category(c) == "Zs":
        return " "
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.digit(c))
    wide = unicodedata.normalize("NFKC", c)
    return wide if len(wide) == 1 and wide.isascii() and wide.isprintable() else None


def signs(r: Rewritten) -> Rewritten:
    """Homoglyphs, wide and styled forms, digits of other scripts and odd spaces as ASCII; signs without a width go."""
    if r.text.isascii():
        return r
    plain = {c: p for c in set(r.text) if not c.isascii() and (p := _plain_sign(c)) is not None}
    if not plain:
        return r
    found = re.finditer("[" + re.escape("".join(plain)) + "]", r.text)
    return r.put([(m.start(), m.end(), plain[m[0]], SIGN, None) for m in found])


def _words(words) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


# Patterns look at the text in lower case.
_END = rf"(?:{_words(DOMAIN_ENDS)})(?![a-z0-9@_-]|\.[a-z0-9])"
_MARKED = re.compile(rf"[\[({{<]\s{{0,3}}(?:(?P<at>@|{_words(AT_WORDS)})|\.|{_words(DOT_WORDS)})\s{{0,3}}[\])}}>]\s{{0,3}}")
_CODED = re.compile(r"(?P<at>&#0*64;|&#x0*40;|&commat;|%40)|&#0*46;|&#x0*2e;|&period;")
_GAP = r"(?:[\x20\t_-]{1,3}|\n)"
_BARE_DOT = re.compile(rf"(?<=[a-z0-9]){_GAP}(?:{_words(DOT_WORDS)}){_GAP}(?=[a-z0-9])")
_GLUED = {w: re.compile(rf"(?<=[a-z0-9]){w}(?=[a-z0-9])") for w in ("AT", "DOT")}
_SPACED = re.compile(rf"(?<=[a-z0-9])\x20?@\x20?(?=([a-z0-9-]++(?:\x20?\.\x20?[a-z0-9-]++)*?\x20?\.\x20?{_END}(?!\x20\.\x20)))")
_SPACED_DOT = re.compile(r"(?<=[a-z0-9])(?:\x20\.\x20?|\.\x20)(?=[a-z0-9])")
_DOMAIN = rf"[a-z0-9-]++(?:\.[a-z0-9-]++)*?\.{_END}"
_ANY_END = re.compile(rf"\.{_END}")
_BARE_AT = re.compile(rf"(?<=[a-z0-9]){_GAP}(?:{_words(AT_WORDS)}){_GAP}(?={_DOMAIN})")
_BEHIND_AT = re.compile(_DOMAIN)


def marked(r: Rewritten) -> Rewritten:
    """Forms such as ``[at]``, ``(dot)``, ``{.}``, ``&#64;`` and ``%40``, with the space around brackets."""
    edits = []
    for m in _MARKED.finditer(r.low):
        before = r.low[max(0, m.start() - 3):m.start()]
        start = m.start() - (len(before) - len(before.rstrip()))
        edits.append((max(start, edits[-1][1] if edits else 0), m.end(), "@" if m["at"] else ".", MARKED, None))
    r = r.put(edits)
    if "&" in r.text or "%40" in r.text:
        r = r.put([(m.start(), m.end(), "@" if m["at"] else ".", MARKED, None) for m in _CODED.finditer(r.low)])
    return r


def bare_dots(r: Rewritten) -> Rewritten:
    """The word "dot" between letters or digits, or in capitals between small letters."""
    if "DOT" in r.text:
        r = r.put([(m.start(), m.end(), ".", BARE_DOT, None) for m in _GLUED["DOT"].finditer(r.text)])
    if any(w in r.low for w in DOT_WORDS):
        r = r.put([(m.start(), m.end(), ".", BARE_DOT, None) for m in _BARE_DOT.finditer(r.low)])
    return r


def spaced(r: Rewritten) -> Rewritten:
    """``name @ host . com``: spaces around the signs of an address go if it ends as domains do."""
    edits, after = [], 0
    for m in _SPACED.finditer(r.low) if "@" in r.text else ():
        if m.start() < after:
            continue
        if m[0] != "@":
            edits.append((m.start(), m.end(), "@", BARE_DOT, None))
        edits += [(d.start(), d.end(), ".", BARE_DOT, None) for d in _SPACED_DOT.finditer(r.low, m.start(1), m.end(1))]
        after = m.end(1)
    return r.put(edits)


def bare_ats(r: Rewritten) -> Rewritten:
    """The word "at" before what ends as domains do (dots are signs by now)."""
    if not _ANY_END.search(r.low):
        return r
    if "AT" in r.text:
        r = r.put([(m.start(), m.end(), "@", BARE_AT, None) for m in _GLUED["AT"].finditer(r.text) if _BEHIND_AT.match(r.low, m.end())])
    return r.put([(m.start(), m.end(), "@", BARE_AT, None) for m in _BARE_AT.finditer(r.low)])


_DIGIT = rf"(?:(?:{_words(TIMES)})[\x20-])?(?:{_words(DIGIT_WORDS)})"
_RUN = re.compile(rf"(?<![^\W_]){_DIGIT}(?:(?:[\x20\t\n-]{{1,2}}|,\x20?){_DIGIT})*+(?![^\W_])")
_ONE = re.compile(rf"(?:({_words(TIMES)})[\x20-])?({_words(DIGIT_WORDS)})(?![^\W_])")
_BOTH_SIDES = re.compile(r"[0-9+().-].? .?[0-9+().-]")


def spelled(r: Rewritten) -> Rewritten:
    """Words for digits: runs of them are joined; a single one counts right behind or before a sign, or between digits and signs."""
    edits = []
    for m in _RUN.finditer(r.low):
        digits, behind = [], []
        for d in _ONE.finditer(r.low, m.start(), m.end()):
            n = TIMES[d[1]] if d[1] else 1
            digits.append(str(DIGIT_WORDS[d[2]]) * n)
            behind += [d.span()] * n
        left, right = r.low[max(0, m.start() - 2):m.start()], r.low[m.end():m.end() + 2]
        if len(behind) > 1 or left[-1:] in tuple("0123456789+(.-") or right[:1] in tuple("0123456789.-") or _BOTH_SIDES.search(f"{left} {right}"):
            edits.append((*m.span(), "".join(digits), MARKED, behind))
    return r.put(edits)


_PLUS = re.compile(r"(?<![^\W_])plus[\x20-]{1,2}(?=\(?[0-9])")
_BAR = re.compile(r"(?<=[0-9])\x20-\x20(?=[0-9])")
_DIGITS = re.compile("[0-9]+")
_LETTER = {"O": "0", "o": "0", "I": "1", "l": "1", "|": "1"}


def numbers(r: Rewritten) -> Rewritten:
    """The word "plus" before a number, and spaces around a hyphen between digits."""
    if "plus" in r.low:
        r = r.put([(m.start(), m.end(), "+", MARKED, None) for m in _PLUS.finditer(r.low)])
    if " - " in r.text:
        r = r.put([(m.start(), m.end(), "-", SIGN, None) for m in _BAR.finditer(r.text)])
    return r


def letters(r: Rewritten) -> Rewritten:
    """Letters that stand for 0 or 1 right before or behind digits, with no other letter beside them."""
    edits, t = [], r.text
    letter = lambda i: 0 <= i < len(t) and t[i].isascii() and t[i].isalpha()
    for m in _DIGITS.finditer(t):
        for at, beyond in ((m.start() - 1, m.start() - 2), (m.end(), m.end() + 1)):
            if 0 <= at < len(t) and t[at] in _LETTER and not letter(beyond) and (not edits or edits[-1][0] < at):
                edits.append((at, at + 1, _LETTER[t[at]], SIGN, None))
    return r.put(edits)


TRANSDUCERS = (signs, marked, bare_dots, spaced, bare_ats, spelled, numbers, letters)


def rewritten(text: str) -> Rewritten:
    """The text without disguises; the text itself if there are none."""
    r = Rewritten(text)
    for step in TRANSDUCERS:
        r = step(r)
    return r


# ---- spans --------------------------------------------------------------------------------------

_ENDS = frozenset(DOMAIN_ENDS)
#: Words that no address behind a bare "at" begins with.
NOT_HOSTS = frozenset(["the", "a", "an", "this", "that", "my", "our", "your", "his", "her", "its", "their"])


def _credible(kind: str, value: str, how: np.ndarray) -> bool:
    """Bare words make an address only if it ends as domains do, and with a plain domain only if its name looks like an account."""
    if kind != "email":
        return True
    name, _, domain = value.partition("@")
    last = domain.rsplit(".", 1)[1]
    if not last.isalpha() or len(last) < 2:
        return False
    bare_at, bare_dot = (how == BARE_AT).any(), (how == BARE_DOT).any()
    if (bare_at or bare_dot) and last.lower() not in _ENDS or bare_at and domain.split(".")[0].lower() in NOT_HOSTS:
        return False
    return not bare_at or bare_dot or bool((how[len(name) + 1:] == MARKED).any()) or bool(re.search(r"[0-9._%+-]", name.strip("._%+-")))


def find(text: str) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end, base, identifier) by kind and start: all plain matches, and disguised ones that no plain match covers."""
    plain = {k: list(f(text)) for k, f in DETECTORS.items()}
    r, out = rewritten(text), []
    for kind in KINDS:
        spans = [(kind, a, b, True, text[a:b]) for a, b in plain[kind]]
        for a, b in DETECTORS[kind](r.text) if r.start is not None else ():
            start, end, how = int(r.start[a]), int(r.end[b - 1]), r.kind[a:b]
            # An address may have a plain end; a number that is plain is whole.
            known = any((x <= start and end <= y) if kind == "email" else (x < end and start < y) for x, y in plain[kind])
            if not known and (end - start != b - a or how.any()) and _credible(kind, r.text[a:b], how):
                spans.append((kind, start, end, False, r.text[a:b]))
        out += sorted(spans, key=lambda s: (s[1], s[2]))
    return out


SPANS = "array<struct<kind:string,start:long,end:long,base:boolean,identifier:string>>"


def identifiers(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``spans``: (kind, start, end, base, identifier) in code points, end exclusive, by kind and start.

    Kinds are email, ip, card and phone.  ``base`` marks matches of the text as it stands, leftmost and apart from each other; the
    others are disguised: look-alike, wide, styled or unseen signs, spelled digits, "at" and "dot" in brackets or as words.  Those
    have at least one rewritten sign, and are not inside a base address or touch a base number of their kind; ``identifier`` is the text without its disguise.

    Whole texts are searched, each in its row: no shuffle.  A very long text is one row of one task, whose map takes 17 bytes a sign
    while it is rewritten.  A null or empty text has no spans.  A column called ``spans`` is replaced; ties and repeated rows get
    equal spans; an empty table stays empty.
    """
    columns = kept_columns(docs, ["spans"])
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField("spans", T.DataType.fromDDL(SPANS))])
    at = columns.index(text)
    fields = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("identifier", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "base", "identifier"), s)) for s in find(t.as_py())] if t.is_valid else [] for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(fields))], names=[*columns, "spans"])

    return docs.select(*columns).mapInArrow(run, schema)


def digest(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each identifier in ``text`` replaced by its kind in brackets; of overlapping spans the first, longest one names the gap.

    A null text stays null; everything else is as in `identifiers`.
    """
    found = identifiers(docs, text)
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("to"), s["kind"].alias("kind"))))
    c = F.col(text)

    def step(done, s):
        new = s["start"] >= done["at"]
        between = c.substr(done["at"].cast("int") + 1, (s["start"] - done["at"]).cast("int"))
        return F.struct(
            F.when(new, F.concat(done["out"], between, F.lit("["), s["kind"], F.lit("]"))).otherwise(done["out"]).alias("out"),
            F.greatest(done["at"], -s["to"]).alias("at"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    gone = F.aggregate(order, start, step, lambda d: F.concat(d["out"], c.substr(d["at"].cast("int") + 1, F.length(c))))
    return found.withColumn(text, F.when(c.isNull(), c).otherwise(gone)).drop("spans")
