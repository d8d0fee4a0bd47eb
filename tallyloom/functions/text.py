"""Text expressions: Column -> Column, inside whole-stage codegen unless said otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: All 29 Unicode white-space code points, which Java's \s alone does not cover.
SPACE = r"(?U)[\s\x1c-\x1f]+"
TERMINAL = list(".!?\"')")


def normalize_whitespace(c: Column) -> Column:
    """Every run of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def review_id(platform: Column, date: Column, rating: Column, text: Column) -> Column:
    """16 hexadecimal digits that depend on all four fields."""
    return F.substring(F.sha2(F.concat_ws("|", platform, date.cast("string"), rating.cast("string"), text), 256), 1, 16)


def key_hash(*parts: Column, length: int = 20) -> Column:
    """A cache key: the first digits of a hash of all parts, with a separator that no part holds."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, length)


_STRPTIME = {"%d": "d", "%m": "M", "%Y": "yyyy", "%y": "yy", "%B": "MMMM", "%b": "MMM", "%H": "H", "%M": "m", "%S": "s", "%j": "DDD", "%A": "EEEE", "%a": "EEE", "%p": "a", "%I": "h"}


def java_pattern(fmt: str) -> str:
    """A strptime format as a Java date pattern; text between directives is quoted."""
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%":
            if fmt[i : i + 2] not in _STRPTIME:
                raise ValueError(f"date directive {fmt[i : i + 2]!r} isn't supported")
            out.append(_STRPTIME[fmt[i : i + 2]])
            i += 2
        else:
            out.append(f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i])
            i += 1
    return "".join(out)


def parse_date(c: Column, formats: Sequence[str]) -> Column:
    """The first format that fits, in order; null if none does. Formats are strptime's."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(java_pattern(f))).cast("date") for f in formats])


def is_truncated(c: Column, cap: int = 500, tolerance: int = 5) -> Column:
    return F.char_length(c) >= cap - tolerance


def no_terminal_punct(c: Column) -> Column:
    return (F.char_length(c) > 0) & ~F.right(c, F.lit(1)).isin(TERMINAL)


def has_non_latin(c: Column) -> Column:
    """An alphabetic character outside the Latin script, by script property (see has_non_latin_exact)."""
    return c.rlike(r"[^\P{L}\p{IsLatin}]")


@F.pandas_udf(T.BooleanType())
def has_non_latin_exact(s: pd.Series) -> pd.Series:
    """An alphabetic character whose Unicode name does not begin with LATIN; unnamed characters don't count."""

    def odd(text: str | None) -> bool | None:
        if text is None or text.isascii():
            return None if text is None else False
        return any(ch.isalpha() and (name := unicodedata.name(ch, "")) != "" and not name.startswith("LATIN") for ch in set(text))

    return s.map(odd)


def rating_bucket(c: Column) -> Column:
    return F.when(c <= 2, "negative").when(c == 3, "neutral").when(c > 3, "positive")


def word_count(c: Column) -> Column:
    t = normalize_whitespace(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def probe(c: Column, pattern: str) -> Column:
    """A case-insensitive search, with Unicode case folding."""
    return F.coalesce(c.rlike("(?iu)" + pattern), F.lit(False))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def nfkc_each(s: pd.Series) -> pd.Series:
    return s.map(lambda a: None if a is None else [t if t is None else unicodedata.normalize("NFKC", t) for t in a])


# Typographic characters and what they fold to.
_FOLD_FROM = "‘’“”–—"
_FOLD_TO = "''\"\"--"


def fold_for_match(c: Column, exact: bool = False) -> Column:
    """Typographic quotes and dashes, white space and case folded; exact adds NFKC, which needs a Python worker."""
    return F.lower(normalize_whitespace(F.translate(nfkc(c) if exact else c, _FOLD_FROM, _FOLD_TO)))


def grounding(text: Column, spans: Column, exact: bool = False) -> Column:
    """The share of spans that are not empty and stand in the text; 1 if there are no spans."""
    hay = fold_for_match(F.coalesce(text, F.lit("")), exact)
    raw = nfkc_each(spans) if exact else spans
    # both go in as a lambda's variable: folded once, and Python workers can't be called inside one
    both = F.array(F.struct(hay.alias("hay"), F.transform(raw, lambda s: fold_for_match(F.coalesce(s, F.lit("")))).alias("spans")))
    found = F.transform(both, lambda b: F.size(F.filter(b.spans, lambda s: (s != "") & F.contains(b.hay, s))))[0]
    return F.when(F.size(spans) > 0, found / F.size(spans)).otherwise(1.0)


def strip_code_fences(c: Column) -> Column:
    """The text inside ``` fences, if the whole reply stands in them."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def outermost_json(c: Column) -> Column:
    """A reply's JSON: without fences; else from the first brace to the last, else from the first bracket to the last."""
    t = strip_code_fences(c)
    obj, arr = F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.regexp_extract(t, r"(?s)(\[.*\])", 1)
    return F.when(t.rlike(r"^[\[{]"), t).when(obj != "", obj).when(arr != "", arr)


def split_packed(c: Column, sep: str = "|||") -> Column:
    """A packed list as an array without empty parts. (Arrays are kept as arrays here; this reads foreign files.)"""
    return F.filter(F.transform(F.split(c, F.lit(r"\Q" + sep + r"\E")), F.trim), lambda x: x != "")


def citation(review_id_: Column, platform: Column, month: Column, rating: Column) -> Column:
    return F.concat(F.lit("["), review_id_, F.lit("] "), F.concat_ws(", ", platform, month, F.concat(rating.cast("string"), F.lit("*"))))


def cut(c: Column, most: int = 220) -> Column:
    """The text, cut at `most` characters with an ellipsis."""
    return F.when(F.char_length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c)


def first_percent(text: Column, default: float = 0.10) -> Column:
    """The first `N%` of a rule as a share."""
    n = F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*%", 1)
    return F.when(n != "", n.try_cast("double") / 100).otherwise(default)


def format_rate(rate: Column, low: Column, high: Column) -> Column:
    pct = lambda c: F.format_string("%.1f", c * 100)
    return F.when(rate.isNull(), "—").otherwise(F.concat(pct(rate), F.lit("% ("), pct(low), F.lit("–"), pct(high), F.lit(")")))


def format_percent(rate: Column) -> Column:
    return F.when(rate.isNull(), "—").otherwise(F.concat(F.format_string("%.1f", rate * 100), F.lit("%")))


def format_optional(value: Column, digits: int = 3) -> Column:
    return F.when(value.isNull(), "—").otherwise(F.format_string(f"%.{digits}f", value))


def significance_label(significant: Column) -> Column:
    """the verdict of a test in words; a missing verdict establishes nothing."""
    return F.when(F.coalesce(significant, F.lit(False)), "established").otherwise("not established")


def scoring_mode(scored: Column) -> Column:
    """F30, an aggregate: `rice` if any row is scored with its effort, `ric` if none is, `none` without rows."""
    return F.when(F.count("*") == 0, "none").when(F.coalesce(F.bool_or(scored), F.lit(False)), "rice").otherwise("ric")
