"""Column -> Column text helpers (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from postkit import constants as K

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def posting_id(url: ColumnOrName, length: int = K.ID_LENGTH) -> Column:
    """First ``length`` hex characters of md5(url)."""
    if not 1 <= length <= 32:
        raise ValueError("id length must be within 1..32")
    return F.substring(F.md5(_c(url)), 1, length)


def strip_query(url: ColumnOrName) -> Column:
    """Everything before the first '?'."""
    return F.split_part(_c(url), F.lit("?"), F.lit(1))


def absolutise(href: ColumnOrName, base: str) -> Column:
    """Keep absolute links, prefix relative ones with ``base``."""
    h = _c(href)
    return F.when(h.startswith("http"), h).otherwise(F.concat(F.lit(base), h))


def page_url(base: ColumnOrName, page_no: ColumnOrName) -> Column:
    """Page 1 is the bare URL, later pages get ``?page=n``."""
    b, p = _c(base), _c(page_no)
    return F.when(p == 1, b).otherwise(F.concat(b, F.lit("?page="), p.cast("string")))


def default_if_missing(c: ColumnOrName, default) -> Column:
    """X6 (``.get(k, d)``): null -> default; an empty string stays empty."""
    return F.coalesce(_c(c), F.lit(default))


def default_if_falsy(c: ColumnOrName, default) -> Column:
    """X6 (``x or d``): null or empty string -> default."""
    return F.coalesce(F.nullif(_c(c), F.lit("")), F.lit(default))


def strip_ws(c: ColumnOrName) -> Column:
    """X11: strip all Unicode whitespace at both ends (``trim`` strips only spaces)."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def truncate_chars(c: ColumnOrName, n: int = K.DESCRIPTION_MAX_CHARS) -> Column:
    """First ``n`` characters (code points)."""
    return F.substring(_c(c), 1, n)


def ellipsis(c: ColumnOrName, n: int) -> Column:
    """First ``n`` characters plus an ellipsis when longer."""
    x = _c(c)
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit(K.ELLIPSIS))).otherwise(x)


def date_prefix(c: ColumnOrName) -> Column:
    """``s[:10]`` of an ISO timestamp string."""
    return F.substring(_c(c), 1, 10)


def first_line(c: ColumnOrName) -> Column:
    return F.split_part(_c(c), F.lit("\n"), F.lit(1))


def contains_any(c: ColumnOrName, needles: Iterable[str], lower: bool = True) -> Column:
    """Substring match against a short literal list (an OR chain, codegen'd).

    Null input gives false (a null title is not relevant).
    """
    needles = list(needles)
    x = F.lower(_c(c)) if lower else _c(c)
    if not needles:
        return F.lit(False)
    hit = reduce(lambda a, b: a | b, [x.contains(n) for n in needles])
    return F.coalesce(hit, F.lit(False))


def is_relevant(title: ColumnOrName, keywords: Iterable[str] = K.RELEVANT_TITLE_KEYWORDS,
                whole_word: bool = False) -> Column:
    """lower-cased title contains any keyword as a substring (``bi`` hits ``mobile``).

    ``whole_word=True`` is an opt-in stricter variant (word boundaries).
    """
    keywords = [k.lower() for k in keywords]
    if not whole_word:
        return contains_any(title, keywords)
    import re
    pat = r"(?U)\b(" + "|".join(re.escape(k) for k in keywords) + r")\b"
    return F.coalesce(F.lower(_c(title)).rlike(pat), F.lit(False))


def search_match(columns: Iterable[ColumnOrName], query: str, literal: bool = False) -> Column:
    """lower-cased regex (or literal) search over several columns; null -> no match.

    The pattern is lower-cased before use, exactly like the dashboard (so ``\\S`` becomes ``\\s``).
    An invalid pattern is rejected on the driver before any job runs.
    """
    q = query.lower()
    if not literal:
        import re
        re.compile(q)
    preds = []
    for c in columns:
        x = F.lower(_c(c))
        preds.append(F.coalesce(x.contains(q) if literal else x.rlike(q), F.lit(False)))
    return reduce(lambda a, b: a | b, preds)


def remote_rule(location: ColumnOrName, source: ColumnOrName) -> Column:
    """Location mentions 'remote' or the source is remotive."""
    return F.coalesce(F.lower(_c(location)).contains("remote"), F.lit(False)) | F.coalesce(
        _c(source) == "remotive", F.lit(False))
