"""Format-preserving pseudonyms for personal data, as Spark expressions.

Validated values are permuted by a keyed Feistel network within their own format: a card number
becomes another number that passes the Luhn test, a date another date, an address another address.
The same key maps equal values to equal pseudonyms in every document and different ones to
different ones, so they stay linked without being readable. Cards, account numbers and phone
numbers are permuted without their separators, which are laid back afterwards, so the ways to write
one number stay linked too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import let

ROUNDS = 8
KINDS = ["email", "phone", "ip", "date", "ssn", "iban", "secret", "card"]
MONTHS = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
# Day, month by name and year, or month first.
NAMED_DATE = rf"(?:\d{{1,2}}(?:st|nd|rd|th)?\.? {MONTHS}\.?,? \d{{4}}|{MONTHS}\.? \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}})"
# Area code and exchange start with 2 to 9.
AMERICAN_PHONE = r"(?:1[ .-])?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}"
TRUNK_PHONE = r"(?:\(0[1-9]\d{1,3}\) ?|0[1-9]\d{1,3}[ /-])\d{3,8}(?:[ -]\d{2,6}){0,3}"
HEX_GROUPS = "[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})"
IPV6 = f"(?:{HEX_GROUPS}{{7}}|{HEX_GROUPS}{{0,5}}::(?:{HEX_GROUPS}{{0,5}})?)"
TOKEN_PREFIX = "(?:AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[spr]k_live_|[spr]k_test_|sk-)"
PATTERN = "|".join([
    r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    r"(?<![\d+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
    r"(?<![\d+])\+\d{1,3}[ -]?(?:\(\d{1,4}\)[ -]?)?\d{2,8}(?:[ -]\d{2,8}){0,3}(?!\d)",
    rf"(?<![A-Za-z0-9_-]){TOKEN_PREFIX}[A-Za-z0-9_-]{{16,}}",
    rf"(?<![A-Za-z0-9:.]){IPV6}(?![A-Za-z0-9:]|\.\d)",
    rf"(?<![A-Za-z0-9]){NAMED_DATE}(?![A-Za-z0-9])",
    rf"(?<![A-Za-z0-9+])(?<!\d[ .-]){AMERICAN_PHONE}(?!\d|[.-]\d)",
    r"(?<![A-Za-z0-9])(?<!\d[.])(?:"
    + "|".join([
        r"\d{1,3}(?:\.\d{1,3}){3}(?![A-Za-z0-9]|\.\d)",
        r"\d{4}-\d{2}-\d{2}(?![A-Za-z0-9]|-\d)",
        r"\d{4}([./])\d{1,2}\1\d{1,2}(?![A-Za-z0-9]|[./]\d)",
        r"\d{1,2}([./-])\d{1,2}\2\d{4}(?![A-Za-z0-9]|[./-]\d)",
        r"(?<![./-])(?:\d{1,2}/\d{1,2}/|\d{2}\.\d{2}\.|\d{2}-\d{2}-)\d{2}(?![A-Za-z0-9]|[./-]\d)",
        r"\d{3}-\d{2}-\d{4}(?![A-Za-z0-9]|-\d)",
        r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        r"[0-9A-Fa-f]{32,}(?![A-Za-z0-9])",
        r"(?:\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![A-Za-z0-9])",
    ])
    + ")",
    rf"(?<![A-Za-z0-9+])(?<!\d[ .-]){TRUNK_PHONE}(?!\d)",
])
# 400 years of the Gregorian calendar, in days, and two factors of that number.
FIRST_DAY, DAYS, DATE_FACTORS = "1800-01-01", 146_097, (189, 773)
# The same for two-digit years, which are taken as 2000 to 2099.
SHORT_FIRST_DAY, SHORT_DAYS, SHORT_FACTORS = "2000-01-01", 36_525, (75, 487)


def keyed(key: str, *parts: Column) -> Column:
    """A non-negative number of 60 bits from the key and ``parts``."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def permuted_pair(key: str, kind: str, left: Column, right: Column, factors: tuple[int, int]) -> Column:
    """A permutation of the pairs below ``factors``: the rounds add to either side in turn."""
    a, b = factors

    def turn(pair: Column, r: Column) -> Column:
        return F.when(
            r % 2 == 1,
            F.struct(F.pmod(pair["l"] + keyed(key, F.lit(kind), r, pair["r"]) % a, F.lit(a)).alias("l"), pair["r"].alias("r")),
        ).otherwise(
            F.struct(pair["l"].alias("l"), F.pmod(pair["r"] + keyed(key, F.lit(kind), r, pair["l"]) % b, F.lit(b)).alias("r"))
        )

    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def permuted_text(key: str, kind: str, text: Column, letters: int = 26) -> Column:
    """A permutation of the texts of one format: digits stay digits, letters letters of their case.

    Letters are those of ASCII and Latin-1. Other characters stay. The characters at even and at odd places are the two sides. With
    ``letters`` = 6 the letters A to F stay within those.
    """
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def spell(own: Column) -> Column:
        bases = F.transform(
            own,
            lambda c: F.when(c.rlike("^[0-9]$"), F.lit(48)).when(c.rlike("^[A-Z]$"), F.lit(65))
            .when(c.rlike("^[a-z]$"), F.lit(97)).when(c.rlike("^[à-ö]$"), F.lit(0xE0)).when(c.rlike("^[À-Ö]$"), F.lit(0xC0))
            .when(c.rlike("^[ø-þ]$"), F.lit(0xF8)).when(c.rlike("^[Ø-Þ]$"), F.lit(0xD8)).otherwise(F.lit(0)),
        )
        return let(bases, lambda base: shuffled(own, base))

    def size(base: Column) -> Column:
        return (
            F.when(base == 0, F.lit(1)).when(base == 48, F.lit(10)).when(base.isin(0xE0, 0xC0), F.lit(23))
            .when(base.isin(0xF8, 0xD8), F.lit(7)).otherwise(F.lit(letters))
        )

    def shuffled(own: Column, base: Column) -> Column:
        start = F.zip_with(own, base, lambda c, b: F.when(b == 0, F.lit(0)).otherwise(F.ascii(c) - b).cast("bigint"))

        def turn(values: Column, r: Column) -> Column:
            fixed = F.filter(values, lambda v, i: i % 2 != r % 2)
            digest = F.sha2(
                F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), F.array_join(F.transform(fixed, lambda v: v.cast("string")), ",")),
                256,
            )
            return let(
                digest,
                lambda d: F.transform(
                    values,
                    lambda v, i: F.when(
                        i % 2 == r % 2,
                        F.pmod(v + F.pmod(F.xxhash64(d, i), size(F.get(base, i)).cast("bigint")), size(F.get(base, i)).cast("bigint")),
                    ).otherwise(v),
                ),
            )

        mixed = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)
        return let(
            mixed,
            lambda values: F.array_join(
                F.transform(
                    own, lambda c, i: F.when(F.get(base, i) == 0, c).otherwise(F.char((F.get(values, i) + F.get(base, i)).cast("bigint")))
                ),
                "",
            ),
        )

    return let(chars, spell)


def laid_out(m: Column, value: Column) -> Column:
    """``value`` at the places of the letters and digits of ``m``, whose other characters stay."""
    chars = F.filter(F.split(m, ""), lambda c: c != "")

    def place(own: Column) -> Column:
        def char(c: Column, i: Column) -> Column:
            number = F.length(F.regexp_replace(F.substr(m, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))
            return F.when(c.rlike("^[0-9A-Za-z]$"), F.substr(own, number, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(chars, char), "")

    return let(value, place)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """The Luhn sum; ``doubled_last`` if the last digit counts double (a number without its check digit)."""

    def weight(c: Column, i: Column) -> Column:
        twice = c.cast("int") * F.when(i % 2 == (0 if doubled_last else 1), F.lit(2)).otherwise(F.lit(1))
        return F.when(twice > 9, twice - 9).otherwise(twice)

    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(F.transform(chars, weight), F.lit(0), lambda total, x: total + x)


def mod97(text: Column) -> Column:
    """The remainder by 97 of letters and digits, where A is 10 and Z is 35."""

    def step(total: Column, c: Column) -> Column:
        value = F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return ((F.when(value < 10, total * 10).otherwise(total * 100) + value) % 97).cast("int")

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def date_of(m: Column) -> Column:
    """The date of a match, null if there is no such day. Day before month where both are possible."""
    parts = F.split(m, "[./-]")
    year, first, second = F.get(parts, F.lit(2)), F.lpad(F.get(parts, F.lit(0)), 2, "0"), F.lpad(F.get(parts, F.lit(1)), 2, "0")
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    name = F.lower(F.substring(F.regexp_extract(m, MONTHS, 0), 1, 3))
    month = F.lpad(((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), name) + 2) / 3).cast("int").cast("string"), 2, "0")
    day = F.lpad(F.regexp_extract(m, "(?<!\\d)(\\d{1,2})(?!\\d)", 1), 2, "0")

    def parsed(*ymd: Column) -> Column:
        return F.try_to_timestamp(F.concat_ws("-", *ymd), F.lit("yyyy-MM-dd")).cast("date")

    return (
        F.when(m.rlike("[A-Z]"), parsed(F.regexp_extract(m, "\\d{4}", 0), month, day))
        .when(m.rlike("^\\d{4}"), parsed(F.get(parts, F.lit(0)), second, F.lpad(F.get(parts, F.lit(2)), 2, "0")))
        .otherwise(F.coalesce(parsed(year, second, first), parsed(year, first, second)))
    )


def short_year(m: Column) -> Column:
    return m.rlike("^\\d{1,2}[./-]\\d{1,2}[./-]\\d{2}$")


def day_number(m: Column) -> Column:
    days = F.datediff(date_of(m), F.when(short_year(m), F.lit(SHORT_FIRST_DAY)).otherwise(F.lit(FIRST_DAY)).cast("date"))
    return F.when((days >= 0) & (days < DAYS), days)


def octets(m: Column) -> Callable[[int], Column]:
    return lambda k: F.get(F.split(m, "\\."), F.lit(k)).cast("int")


def kind_of(m: Column) -> Column:
    """The kind of a match, null if it is not valid."""
    part, octet = F.split(m, "-"), octets(m)
    ssn = ~F.get(part, F.lit(0)).isin("000", "666") & (F.get(part, F.lit(0)) < "900") & (F.get(part, F.lit(1)) != "00") & (
        F.get(part, F.lit(2)) != "0000"
    )
    packed = F.regexp_replace(m, " ", "")
    valid_ip = (octet(0) <= 255) & (octet(1) <= 255) & (octet(2) <= 255) & (octet(3) <= 255)
    return (
        F.when(m.contains("@"), "email")
        .when(m.startswith("+"), F.when(F.length(digits_of(m)).between(7, 15), "phone"))
        .when(m.rlike(f"^{TOKEN_PREFIX}"), F.when(m.rlike("[0-9]"), "secret"))
        .when(m.contains(":"), F.when(m.rlike("[0-9]") & (F.length(m) >= 6), "ip"))
        .when(m.rlike(f"^{NAMED_DATE}$"), F.when(day_number(m).isNotNull(), "date"))
        .when(m.rlike(f"^{AMERICAN_PHONE}$"), "phone")
        .when(m.rlike("^\\d{1,3}(\\.\\d{1,3}){3}$"), F.when(valid_ip, "ip"))
        .when(m.rlike("^(\\d{4}[./-]\\d{1,2}[./-]\\d{1,2}|\\d{1,2}[./-]\\d{1,2}[./-](\\d{4}|\\d{2}))$"), F.when(day_number(m).isNotNull(), "date"))
        .when(m.rlike("^\\d{3}-\\d{2}-\\d{4}$"), F.when(ssn, "ssn"))
        .when(
            m.rlike("^[A-Z]{2}\\d{2}"),
            F.when(mod97(F.concat(F.substr(packed, F.lit(5)), F.substring(packed, 1, 4))) == 1, "iban"),
        )
        .when(m.rlike("^[0-9A-Fa-f]{32,}$"), "secret")
        .when(m.rlike(f"^{TRUNK_PHONE}$"), F.when(F.length(digits_of(m)).between(9, 12), "phone"))
        .when(m.rlike("^[0-9 -]+$"), F.when(luhn_sum(digits_of(m), False) % 10 == 0, "card"))
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """What stands for the valid match ``m``."""
    octet = octets(m)

    def email() -> Column:
        at = F.instr(m, "@")
        return F.concat(permuted_text(key, "email", F.substr(m, F.lit(1), at - 1)), F.substr(m, at))

    def ip() -> Column:
        pair = permuted_pair(key, "ip", octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), (65_536, 65_536))
        return let(
            pair,
            lambda p: F.concat_ws(".", F.floor(p["l"] / 256).cast("string"), (p["l"] % 256).cast("string"), F.floor(p["r"] / 256).cast("string"), (p["r"] % 256).cast("string")),
        )

    def date() -> Column:
        def moved_by(kind: str, first_day: str, factors: tuple[int, int]) -> Column:
            a, b = factors
            pair = permuted_pair(key, kind, F.floor(day_number(m) / b), day_number(m) % b, (a, b))
            return let(pair, lambda p: F.date_add(F.lit(first_day).cast("date"), (p["l"] * b + p["r"]).cast("int")))

        moved = F.when(short_year(m), moved_by("short date", SHORT_FIRST_DAY, SHORT_FACTORS)).otherwise(
            moved_by("date", FIRST_DAY, DATE_FACTORS)
        )
        return let(moved, spelled)

    def spelled(moved: Column) -> Column:
        first, second, year = F.date_format(moved, "dd"), F.date_format(moved, "MM"), F.date_format(moved, "yyyy")
        parts = F.split(m, "[./-]")
        own_year = F.get(parts, F.lit(2))
        day_first = F.try_to_timestamp(
            F.concat_ws(
                "-", F.when(F.length(own_year) == 2, F.concat(F.lit("20"), own_year)).otherwise(own_year),
                F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.lpad(F.get(parts, F.lit(0)), 2, "0"),
            ),
            F.lit("yyyy-MM-dd"),
        ).isNotNull()
        mark = F.regexp_extract(m, "[./-]", 0)
        year_last = F.when(short_year(m), F.substring(year, 3, 2)).otherwise(year)
        full = m.rlike("(January|February|March|April|June|July|August|September|October|November|December)")
        month = F.when(full, F.date_format(moved, "MMMM")).otherwise(F.date_format(moved, "MMM"))
        return (
            F.when(m.rlike("^[A-Z]"), F.concat(month, F.lit(" "), F.date_format(moved, "d"), F.when(m.contains(","), ", ").otherwise(" "), year))
            .when(m.rlike("[A-Z]"), F.concat_ws(" ", F.date_format(moved, "d"), month, year))
            .when(m.rlike("^\\d{4}"), F.concat(year, mark, second, mark, first))
            .when(day_first, F.concat(first, mark, second, mark, year_last))
            .otherwise(F.concat(second, mark, first, mark, year_last))
        )

    def ssn() -> Column:
        part = F.split(m, "-")
        area = F.get(part, F.lit(0)).cast("int")
        rest = (F.get(part, F.lit(1)).cast("int") - 1) * 9999 + F.get(part, F.lit(2)).cast("int") - 1
        pair = permuted_pair(key, "ssn", F.when(area > 666, area - 2).otherwise(area - 1), rest, (898, 99 * 9999))
        return let(
            pair,
            lambda p: F.concat_ws(
                "-",
                F.lpad(F.when(p["l"] >= 665, p["l"] + 2).otherwise(p["l"] + 1).cast("string"), 3, "0"),
                F.lpad((F.floor(p["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((p["r"] % 9999 + 1).cast("string"), 4, "0"),
            ),
        )

    def iban() -> Column:
        # Country and account keep their format; the two check digits follow from them.
        body = permuted_text(key, "iban", F.substr(F.regexp_replace(m, " ", ""), F.lit(5)))
        return laid_out(m, let(
            body,
            lambda own: F.concat(
                F.substring(m, 1, 2),
                F.lpad((98 - mod97(F.concat(own, F.substring(m, 1, 2), F.lit("00")))).cast("string"), 2, "0"),
                own,
            ),
        ))

    def card() -> Column:
        bare = digits_of(m)
        body = permuted_text(key, "card", F.substr(bare, F.lit(1), F.length(bare) - 1))
        return laid_out(m, let(body, lambda own: F.concat(own, F.pmod(-luhn_sum(own, True), F.lit(10)).cast("string"))))

    def phone() -> Column:
        # A North American number keeps its area and the next digit, with and without country code;
        # one that starts with 0 keeps it and a digit; so the number keeps its form.
        bare = digits_of(m)
        american = m.rlike(f"^{AMERICAN_PHONE}$") | (m.startswith("+") & bare.rlike("^1[2-9]\\d{2}[2-9]\\d{6}$"))
        kept = F.when(american, F.length(bare) - 6).when(m.startswith("+"), F.lit(0)).otherwise(F.lit(2))
        return laid_out(m, F.concat(F.substr(bare, F.lit(1), kept), permuted_text(key, "phone", F.substr(bare, kept + 1))))

    def behind(kind: str, prefix: str, letters: int = 26) -> Column:
        """What ``prefix`` matches stays, the rest is permuted."""
        start = F.regexp_extract(m, prefix, 0)
        return let(start, lambda p: F.concat(p, permuted_text(key, kind, F.substr(m, F.length(p) + 1), letters)))

    return (
        F.when(kind == "email", email())
        .when(kind == "phone", phone())
        .when((kind == "ip") & m.contains(":"), permuted_text(key, "ip", m, 6))
        .when(kind == "ip", ip())
        .when(kind == "date", date())
        .when(kind == "ssn", ssn())
        .when(kind == "iban", iban())
        .when((kind == "secret") & m.rlike(f"^{TOKEN_PREFIX}"), behind("secret", f"^{TOKEN_PREFIX}"))
        .when(kind == "secret", permuted_text(key, "secret", m, 6))
        .when(kind == "card", card())
        .otherwise(m)
    )


def of_kind(kinds: Column, kind: str) -> Column:
    return F.filter(kinds, lambda k: k == kind)


def pseudonymise(docs: DataFrame, keep: list[str], key: str, text: str = "text") -> DataFrame:
    """``keep``, the whole text with pseudonyms as ``text``, and ``n_<kind>`` values replaced.

    A null text stays null with counts 0; an empty one stays empty. Values that fail their test
    (Luhn sum, calendar, octets, check digits) stay as they are, and so does the domain of a mail
    address. Rows repeat as in the input; an empty table gives an empty result; texts of any length
    are read whole. Columns not in ``keep`` are left out, whatever their names; ``keep`` must not hold
    ``text`` or a name of the counts.
    """
    body = F.col("_body")

    def replaced(matches: Column) -> Column:
        kinds = F.transform(matches, kind_of)

        def joined(own: Column) -> Column:
            new = F.zip_with(matches, own, lambda m, kind: pseudonym(m, kind, key))
            pieces = F.split(body, PATTERN, -1)
            whole = F.array_join(F.zip_with(pieces, new, lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")
            counts = [F.size(of_kind(own, kind)).cast("bigint").alias(f"n_{kind}") for kind in KINDS]
            return F.struct(whole.alias("text"), *counts)

        return let(kinds, joined)

    none = F.struct(body.alias("text"), *[F.lit(0).cast("bigint").alias(f"n_{kind}") for kind in KINDS])
    # Every kind has a digit or an @, which is quick to look for.
    found = F.when(body.rlike("[0-9@]"), let(F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0)), lambda m: F.when(F.size(m) > 0, replaced(m)).otherwise(none)))
    return (
        docs.select(*keep, F.col(text).alias("_body"))
        .select(*keep, F.coalesce(found, none).alias("_new"))
        .select(*keep, "_new.*")
    )
