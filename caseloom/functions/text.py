"""Text expressions. All of them stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom.functions.constants import CREATED_AT_FORMAT
from caseloom.functions.vectors import let

WORD = r"[\p{L}\p{N}_]"
_EDGE = rf"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"
_SPACE = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WHITESPACE = rf"[{_SPACE}]+"
_BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    r"""Give ``\b``, ``\w``, ``\s`` and ``.`` their Unicode meaning in a Java pattern."""
    body = (
        pattern.replace(r"\b", _EDGE)
        .replace(r"\w", WORD)
        .replace(r"\d", r"\p{Nd}")
        .replace(r"\s", rf"[{_SPACE}]")
        .replace(r"\S", rf"[^{_SPACE}]")
    )
    return ("(?iud)" if ignore_case else "(?d)") + body


def required_start(pattern: str) -> str:
    r"""Letters that any match of the pattern contains: those after a leading ``\b``."""
    found = re.match(r"\\b([A-Za-z0-9 ]+)([?*{|]?)", pattern)
    if not found or "|" in re.sub(r"\([^()]*\)", "", pattern):
        return ""
    letters, repeat = found.groups()
    return letters[:-1] if repeat else letters


def whole_word(pattern: str, ignore_case: bool = False) -> str:
    r"""``java_pattern``, in a faster form for a few words with an optional ending between two ``\b``.

    The words are looked for first, and only where they stand the neighbours are tested. Words begin and
    end in a word character, so an edge is where the neighbour is none.
    """
    words = r"[A-Za-z0-9]+(?: [A-Za-z0-9]+)*"
    ending = r"(?:[A-Za-z0-9]\?|\([A-Za-z0-9]+(?:\|[A-Za-z0-9]+)*\)\??)?"
    found = re.fullmatch(rf"\\b({words})({ending})\\b", pattern)
    if not found:
        return java_pattern(pattern, ignore_case)
    start, rest = found.groups()
    return ("(?iud)" if ignore_case else "(?d)") + f"{start}(?<!{WORD}{start}){rest}(?!{WORD})"


def fold_case(text: Column) -> Column:
    """Lower case, with the letters that only case-insensitive matching equates.

    The dotted capital I goes first, since it has two characters in lower case.
    """
    return F.translate(F.lower(F.translate(text, "\u0130", "i")), "\u017f\u0131", "si")


def _match_sql(text: str, pattern: str, ignore_case: bool, folded: str | None) -> str:
    letters = required_start(pattern)
    test = f'rlike({text}, r"{whole_word(pattern, ignore_case)}")'
    if not letters:
        return test
    if ignore_case:
        within = folded or f"translate(lower(translate({text}, '\u0130', 'i')), '\u017f\u0131', 'si')"
        return f'(contains({within}, "{letters.lower()}") AND {test})'
    return f'(contains({text}, "{letters}") AND {test})'


def matches_any(text: str, patterns: Iterable[str], ignore_case: bool = False) -> Column:
    """Whether any pattern matches the text, given as a column name or SQL expression.

    Each ``rlike`` stands behind a plain substring test, which rules out nearly all texts for
    far less. Long rule lists are put together as SQL text, since that is built at once.
    """
    return F.expr(" OR ".join(_match_sql(text, p, ignore_case, None) for p in patterns))


def matching_sql(text: str, patterns: list[str], ignore_case: bool = False, folded: str | None = None) -> str:
    """How many patterns match at least once, as SQL text. ``folded`` names a column with ``fold_case(text)``."""
    return " + ".join(f"CAST({_match_sql(text, p, ignore_case, folded)} AS INT)" for p in patterns)


def count_matching(text: str, patterns: list[str], ignore_case: bool = False, folded: str | None = None) -> Column:
    return F.expr(matching_sql(text, patterns, ignore_case, folded))


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(_BLANKS))


def clean_text(text: Column) -> Column:
    """Drop control characters, squeeze white space and trim; null becomes ''."""
    no_control = F.regexp_replace(
        F.coalesce(text, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""
    )
    return F.trim(F.regexp_replace(no_control, WHITESPACE, " "))


def split_words(text: Column) -> Column:
    """White-space separated words without empty ones."""
    return F.filter(F.split(text, WHITESPACE), lambda w: w != "")


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}{{2,}}"), F.lit(0))


def with_bigrams(tokens: Column) -> Column:
    """The tokens followed by the pairs of neighbours, joined by one blank.

    ``tokens`` may be an expression: it is evaluated once, not at each place where it is used.
    """

    def pairs(words: Column) -> Column:
        n = F.greatest(F.size(words) - 1, F.lit(0))
        blank = lambda a, b: F.concat(a, F.lit(" "), b)
        return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), blank)

    return let(tokens, lambda words: F.concat(words, pairs(words)))


def term_frequencies(terms: Column) -> Column:
    """Array of ``(term, tf)``, one entry per distinct term of the array.

    Counted inside the row: the terms are sorted and the lengths of the runs of equal terms
    are taken, so neither a shuffle nor an aggregation of single terms is needed.
    """

    def runs(s: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(s) - 1)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(
            starts,
            lambda at: F.transform(
                at,
                lambda start, k: F.struct(
                    F.get(s, start).alias("term"),
                    (F.coalesce(F.get(at, k + 1), F.size(s)) - start).cast("bigint").alias("tf"),
                ),
            ),
        )

    none = F.array().cast("array<struct<term: string, tf: bigint>>")
    return let(F.sort_array(terms), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(none))


def strip_links_and_handles(text: Column) -> Column:
    no_links = F.when(F.contains(text, F.lit("http")), F.regexp_replace(text, java_pattern(r"https?://\S+"), "")).otherwise(text)
    no_handles = F.regexp_replace(no_links, java_pattern(r"@\w+"), "")
    return strip(F.when(F.contains(text, F.lit("@")), no_handles).otherwise(no_links))


def parse_created_at(created_at: Column) -> Column:
    """Timestamp of a text such as ``Tue Oct 31 22:10:47 +0000 2017``; null if unreadable.

    The weekday is checked by form only and cut away, since Spark's parser has no pattern
    letter for it.
    """
    shaped = F.when(created_at.rlike(r"^[A-Z][a-z]{2} "), F.substr(created_at, F.lit(5)))
    return F.try_to_timestamp(shaped, F.lit(CREATED_AT_FORMAT))
