"""Text column functions."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill import rules

# The characters a full strip removes.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
NON_WORD = r"[^\p{L}\p{N}_]+"
CDN_URL = "(?:" + "|".join(p.replace(".", r"\.") for p in rules.CDN_PREFIXES.values()) + r")\S+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str, extra: str | None = None) -> Column:
    """Trim Unicode whitespace, or the characters of ``extra`` when given."""
    return F.btrim(col(c), F.lit(WHITESPACE if extra is None else extra))


def rstrip(c: Column | str, chars: str = WHITESPACE) -> Column:
    return F.rtrim(col(c), F.lit(chars))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words], F.lit(False))


def starts_with_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(c, F.lit(w)) for w in words], F.lit(False))


def fold_title(c: Column | str) -> Column:
    """Lower case without any non-word character: the exact-duplicate key of a title."""
    return F.regexp_replace(F.lower(col(c)), NON_WORD, "")


def _folded() -> tuple[str, str]:
    """Lower-case Latin letters with marks and their plain letters, by their Unicode decomposition."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        if chr(code).islower() and len(parts) > 1 and all(unicodedata.combining(p) for p in parts[1:]):
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, PLAIN = _folded()
SEPARATORS = r"[^\p{L}\p{N}]+"


def search_words(c: Column | str) -> Column:
    """Words as the search index cuts them: lower case, marks folded, anything but letters and digits separates."""
    folded = F.translate(F.lower(col(c)), MARKED, PLAIN)
    return F.array_remove(F.split(F.regexp_replace(folded, SEPARATORS, " "), " "), "")


def query_words(query: str) -> list[str]:
    """The words of a search query, cut as ``search_words`` cuts a text."""
    folded = query.lower().translate(str.maketrans(MARKED, PLAIN))
    return re.findall(r"[^\W_]+", folded)


def title_tokens(c: Column | str) -> Column:
    """Distinct lower-case words of at least two characters."""
    words = F.split(F.regexp_replace(F.lower(col(c)), NON_WORD, " "), " ")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2))


def preview(c: Column | str, n: int) -> Column:
    return F.translate(F.substring(col(c), 1, n), "\n", " ")


def excerpt(c: Column | str, n: int = 140) -> Column:
    """First line without emphasis marks, cut at ``n`` characters with an ellipsis."""
    clean = F.replace(F.regexp_replace(col(c), r"^\*+\s*", ""), F.lit("**"), F.lit(""))
    line = F.substring_index(clean, "\n", 1)
    return F.when(F.length(line) > n, F.concat(strip(F.substring(line, 1, n)), F.lit("…"))).otherwise(line)


def paragraphs(c: Column | str) -> Column:
    """Non-empty trimmed lines without emphasis marks."""
    lines = F.split(F.replace(col(c), F.lit("**"), F.lit("")), "\n")
    return F.filter(F.transform(lines, lambda x: strip(x)), lambda x: x != "")


def strip_html(c: Column | str) -> Column:
    return strip(F.regexp_replace(col(c), "<[^>]+>", ""))


def strip_chat_noise(c: Column | str) -> Column:
    """Remove exporter markers and CDN links."""
    out = col(c)
    for marker in rules.CHAT_MARKERS:
        out = F.replace(out, F.lit(marker), F.lit(""))
    return F.regexp_replace(out, CDN_URL, "")


def script_share(c: Column, script: str, floor_length: Column) -> Column:
    """Characters of ``script`` (a character class body) per character of ``floor_length``."""
    return F.length(F.regexp_replace(c, f"[^{script}]", "")) / F.greatest(floor_length, F.lit(1))


def keep_script_lines(
    c: Column | str,
    script: str = rules.HANGUL_JAMO,
    min_len: int = 20,
    ratio: float = 0.15,
    bullets: str = r"\*\-",
    drop_phrases: tuple[str, ...] | list[str] = tuple(rules.META_PHRASES),
    drop_prefixes: tuple[str, ...] | list[str] = tuple(rules.META_PREFIXES),
    fallback: bool = True,
) -> Column:
    """Keep lines written mostly in one script, without bullets and meta-comments."""
    text = col(c)
    lines = F.split(text, "\n")

    def wanted(line: Column) -> Column:
        size = F.length(strip(line))
        return (size > min_len) & (script_share(line, script, size) > ratio)

    cleaned = F.transform(
        F.filter(lines, wanted),
        lambda x: strip(F.regexp_replace(x, rf"^\s*[{bullets}]\s*", "")),
    )
    if drop_phrases:
        cleaned = F.filter(cleaned, lambda x: ~contains_any(F.lower(x), list(drop_phrases)))
    if drop_prefixes:
        cleaned = F.filter(cleaned, lambda x: ~starts_with_any(x, list(drop_prefixes)))
    joined = F.array_join(cleaned, "\n")
    return F.when(F.size(cleaned) > 0, joined).otherwise(text if fallback else F.lit(""))


def channel_slug(channel_line: Column | str, fallback: Column | str) -> Column:
    """File-name-safe leaf of a channel path."""
    line = col(channel_line)
    slash = F.instr(line, "/")
    leaf = strip(F.when(slash > 0, F.substr(line, slash + 1)).otherwise(line))
    leaf = strip(F.regexp_replace(leaf, "^[^0-9A-Za-z가-힣]+", ""))
    leaf = F.regexp_replace(leaf, r"\s+", "_")
    leaf = F.regexp_replace(leaf, r'[\\/:*?"<>|]+', "_")
    default = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.coalesce(blank_to_null(leaf), default)


def token_estimate(c: Column | str) -> Column:
    """Rough token count at 3.5 characters per token."""
    return F.floor(F.length(col(c)) / F.lit(3.5)).cast("bigint")


def safe_int(c: Column | str) -> Column:
    return F.coalesce(col(c).try_cast("int"), F.lit(0))
