"""Row-preserving text expressions.

All functions map Columns to Columns with built-in expressions, so that they stay
in generated code next to the scan and never start a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .regex import ascii_regex, edged, extract, led, let, matches, replace, words
from .numeric import round_half_up

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*://)([^/?#\s]+)([^?#]*)(\?[^#]*)?"


# ---------------------------------------------------------------- urls
def canonical_url(url: Column, prefixes=None, keys=None) -> Column:
    """Drop fragment, tracking parameters, a leading ``www.`` and the trailing slash.

    Parameter order is kept.  Text that is not an absolute url is returned as is.
    """
    prefixes = fv.TRACKING_PREFIXES if prefixes is None else prefixes
    keys = fv.TRACKING_KEYS if keys is None else keys
    tracked = (
        r"(?i)(?<=[?&])(?:(?:" + "|".join(prefixes) + r")[^&=]*|(?:" + "|".join(keys) + r"))(?:=[^&]*)?(?:&|$)"
    )
    scheme = F.lower(F.regexp_extract(url, _URL, 1))
    host = F.lower(F.regexp_extract(url, _URL, 2))
    host = F.regexp_replace(host, r"^((?:[^@]*@)?)www\.", "$1")
    host = F.when(scheme == "http://", F.regexp_replace(host, r":80$", "")).when(
        scheme == "https://", F.regexp_replace(host, r":443$", "")
    ).otherwise(host)
    query = F.regexp_replace(F.regexp_extract(url, _URL, 4), tracked, "")
    query = F.regexp_replace(query, r"[?&]$", "")
    whole = F.concat(scheme, host, F.regexp_extract(url, _URL, 3), query)
    return F.when(url.rlike(_URL), F.regexp_replace(whole, r"/$", "")).otherwise(url)


def url_key(url: Column) -> Column:
    """sha1 of the canonical url: the natural key of an item."""
    return F.sha1(canonical_url(url))


def domain_of(url: Column) -> Column:
    """Lower-case host without ``www.``; the scheme is optional; null without a dot."""
    full = F.when(url.rlike(r"(?i)^https?:"), url).otherwise(F.concat(F.lit("https://"), url))
    host = F.lower(F.regexp_extract(full, r"(?i)^https?:/*(?:[^/?#@\s]*@)?([^/?#:\s@]+)(?::\d*)?(?:[/?#]|$)", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host.contains("."), host)


# ---------------------------------------------------------------- markup
def _decode_numeric(s: Column) -> Column:
    def piece(x: Column) -> Column:
        dec = F.regexp_extract(x, r"^(\d{1,7});", 1)
        hexa = F.regexp_extract(x, r"^[xX]([0-9a-fA-F]{1,6});", 1)
        code = F.when(dec != "", F.hex(dec.cast("bigint"))).when(hexa != "", hexa)
        char = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
        return F.coalesce(F.concat(char, F.regexp_replace(x, r"^[^;]*;", "")), F.concat(F.lit("&#"), x))

    parts = F.split(s, "&#")
    decoded = F.concat(
        parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), piece), "")
    )
    return F.when(s.contains("&#"), decoded).otherwise(s)


def decode_entities(s: Column) -> Column:
    """Decode named and numeric entities once (``&amp;`` last, so nothing is decoded twice)."""
    def decoded(s: Column) -> Column:
        for name, char in fv.NAMED_ENTITIES.items():
            s = F.regexp_replace(s, f"(?i)&{name};", char)
        for code, char in fv.NUMERIC_ENTITIES.items():
            s = F.replace(s, F.lit(f"&#{code};"), F.lit(char))
        return F.regexp_replace(let(s, _decode_numeric), "(?i)&amp;", "&")

    # A text without the sign has nothing to decode.
    return let(s, lambda s: F.when(s.contains("&"), decoded(s)).otherwise(s))


def collapse_space(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"[\s\x{A0}]+", " "))


def strip_markup(html: Column) -> Column:
    """Plain text of a markup fragment: no scripts, styles or tags, entities decoded."""
    s = F.regexp_replace(html, r"(?is)<script.*?</script>", " ")
    s = F.regexp_replace(s, r"(?is)<style.*?</style>", " ")
    s = F.regexp_replace(s, r"<[^>]+>", " ")
    return collapse_space(decode_entities(s))


def clip_text(s: Column, n: int) -> Column:
    """At most ``n`` characters; longer text ends in an ellipsis."""
    return F.when(
        F.length(s) > n, F.concat(F.regexp_replace(F.substring(s, 1, n - 1), r"\s+$", ""), F.lit("…"))
    ).otherwise(s)


# ---------------------------------------------------------------- names and tokens
def norm_name(name: Column, suffixes=None) -> Column:
    """Comparison key of a company or person name."""
    suffixes = fv.NAME_SUFFIXES if suffixes is None else suffixes
    lower = F.lower(name)

    def key(tld: str, own: str, suffix: str) -> Column:
        s = F.regexp_replace(F.regexp_replace(lower, tld, ""), own, "")
        return F.regexp_replace(F.regexp_replace(s, suffix, " "), r"[^a-z0-9]+", "")

    return edged(lower, key, r"\.(?:" + "|".join(fv.NAME_TLDS) + r")\b", r"['’]s\b", words(suffixes))


def _tokenize(s: Column, junk: str, min_len: int, stopwords: list[str]) -> Column:
    clean = F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), junk, " ")
    parts = F.split(clean, " +")
    return F.filter(parts, lambda w: (F.length(w) >= min_len) & ~w.isin(*stopwords))


def token_list(s: Column, stopwords=None) -> Column:
    """Item tokens with duplicates kept (the minimum-length test counts them)."""
    return _tokenize(s, r"[^a-z0-9₹$ ]+", 2, fv.ITEM_STOPWORDS if stopwords is None else stopwords)


def token_set(s: Column, stopwords=None) -> Column:
    return F.array_sort(F.array_distinct(token_list(s, stopwords)))


def title_tokens(s: Column, stopwords=None) -> Column:
    """Story tokens: longer words, another stop list, distinct."""
    tok = _tokenize(s, r"[^a-z0-9]+", 3, fv.STORY_STOPWORDS if stopwords is None else stopwords)
    return F.array_sort(F.array_distinct(tok))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two distinct arrays; 0 when either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        shared / (F.size(a) + F.size(b) - shared)
    )


def overlap_coefficient(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        shared / F.least(F.size(a), F.size(b))
    )


def strip_own_name(text: Column, name: Column, ignore_case: bool = False) -> Column:
    """Blank an entity's own name so that it does not count as a keyword."""
    if not ignore_case:
        return F.replace(text, name, F.lit(" "))
    escaped = F.regexp_replace(name, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    return F.regexp_replace(text, F.concat(F.lit("(?i)"), escaped), F.lit(" "))


# ---------------------------------------------------------------- money
#: How amounts with a sign begin, after the signs that are quickest to tell.
_MONEY_STARTS = r"[U$₹IRuir])(?=US\$|USD|\$|₹|INR|Rs"
_SCALE = [("^(mn|million|m)$", 1e6), ("^(bn|billion|b)$", 1e9), ("^cr", 1e7), ("^lakh", 1e5), ("^(k|thousand)$", 1e3)]


def parse_money(text: Column, inr_per_usd: float = fv.INR_PER_USD) -> Column:
    """First money amount as millions of dollars, two decimals, or null when implausible."""
    a = "(?i)" + led(_MONEY_STARTS, ascii_regex(fv.MONEY_WITH_SYMBOL))
    b = "(?i)" + led("[0-9]", ascii_regex(fv.MONEY_BY_UNIT))

    def parts(s: Column) -> Column:
        """struct(number, unit, rupees) of the first amount with a sign, or else of the first one with a unit."""
        with_symbol = lambda symbol: F.struct(
            F.regexp_extract(s, a, 2).alias("number"), F.lower(F.regexp_extract(s, a, 3)).alias("unit"), symbol.rlike("(?i)₹|INR|Rs").alias("rupees"))
        by_unit = lambda number: F.when(number != "", let(F.lower(F.regexp_extract(s, b, 2)), lambda unit: F.struct(
            number.alias("number"), unit.alias("unit"), F.concat(unit, F.regexp_extract(s, b, 3)).rlike("(?i)cr|lakh|rupee|inr").alias("rupees"))))
        return let(F.regexp_extract(s, a, 1), lambda symbol: F.when(symbol != "", with_symbol(symbol)).otherwise(let(F.regexp_extract(s, b, 1), by_unit)))

    def amount(p: Column) -> Column:
        scale = F.lit(1.0)
        for pattern, factor in reversed(_SCALE):
            scale = F.when(p["unit"].rlike(pattern), F.lit(factor)).otherwise(scale)
        native = F.nullif(p["number"], F.lit("")).cast("double") * scale
        return F.when(p["rupees"], native / F.lit(float(inr_per_usd))).otherwise(native) / F.lit(1e6)

    def rounded(usd_m: Column) -> Column:
        valid = (usd_m > fv.MONEY_MIN_USD_M) & (usd_m < fv.MONEY_MAX_USD_M)
        return F.when(valid, round_half_up(usd_m * 100.0) / 100.0)

    plain = F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit(""))
    return let(let(let(plain, parts), amount), rounded)


def raise_amount(text: Column) -> Column:
    """First money mention that does not sit next to a valuation or revenue word."""
    before = "(?<!(?:" + "|".join(fv.MONEY_NOT_AFTER) + r")\s{0,4}(?:a\s{1,4})?)"
    after = "".join(
        rf"(?![\s\S]{{0,{fv.MONEY_WINDOW_AFTER - len(w)}}}{w})" for w in fv.MONEY_NOT_BEFORE
    )
    # A boundary group may not sit inside a look-behind together with \b, so spell it.
    before = before.replace(r"\bat", r"(?<![A-Za-z0-9_])at")
    pattern = "(?i)" + led(_MONEY_STARTS, before + "(?>" + ascii_regex(fv.MONEY_MENTION) + ")" + after)
    return F.nullif(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 0)), F.lit(""))


def format_money(usd_m: Column) -> Column:
    """Display form: billions, millions or thousands."""
    return (
        F.when(usd_m >= 1000, F.concat(F.lit("$"), F.format_string("%.1f", usd_m / 1000), F.lit("B")))
        .when(usd_m >= 10, F.concat(F.lit("$"), F.format_string("%.0f", usd_m), F.lit("M")))
        .when(usd_m >= 1, F.concat(F.lit("$"), F.format_string("%.1f", usd_m), F.lit("M")))
        .when(usd_m.isNotNull(), F.concat(F.lit("$"), round_half_up(usd_m * 1000).cast("string"), F.lit("K")))
    )


# ---------------------------------------------------------------- stages
def norm_stage(text: Column) -> Column:
    """Canonical funding-stage label of the first stage word in the text."""
    def canonical(v: Column) -> Column:
        label = None
        for k, name in fv.STAGE_LABELS.items():
            label = F.when(v == k, name) if label is None else label.when(v == k, name)
        last = F.upper(F.substring(v, -1, 1))
        return (
            label.when(v.startswith("pre-series "), F.concat(F.lit("Pre-Series "), last))
            .when(v.startswith("series "), F.concat(F.lit("Series "), last))
        )

    return let(F.lower(extract(text, fv.STAGE_PATTERN, 1)), canonical)


def is_late_stage(stage: Column) -> Column:
    return matches(stage, fv.LATE_STAGE_PATTERN)


def evidence_sentence(text: Column, pattern: str, limit: int = 220) -> Column:
    """The sentence around the first match of ``pattern``, clipped.

    A match can only begin where a sentence does; saying so spares a search from every character on.
    """
    around = extract(text, r"(?<![^.])[^.]*(?:" + pattern + r")[^.]*\.?", 0)
    return let(F.trim(around), lambda x: clip_text(x, limit))
