"""Pseudonyms of personal numbers and dates that keep their format.

Candidates are found by pattern and validated: payment cards and IBANs by their check digits,
dates by the calendar; mail addresses, IPv4 addresses of four numbers up to 255, and phone and
social security numbers need no more than their form.  Only ten digits without +1 or brackets
are no phone number if the area or the exchange begins with 0 or 1, and area 000 is no social
security number.  What may be assigned and what may not be keep apart.  What is valid is read as
a list of digits, each with its own base, and goes through a keyed Feistel network: in turn
the even and the odd places are shifted, modulo their bases, by a keyed hash of the others.
So every value has one pseudonym with the same key, in every document and however it is
punctuated, no two values share one, and the pseudonym is valid where the value was; check
digits are computed anew.  `reveal` goes back; only of dates with slashes and the day first,
which can look like others with the month first afterwards, and of cards in groups of four
beside more such groups, which can look like a card together with them, it can't.

Numbers beside a card or an IBAN are no part of it: unbroken cards, those of 4, 6 and 5 or 4
digits, and IBANs of their country's length are candidates by themselves; in other rows of
groups, of 100 digits at most, cards of four groups of four are searched at each group, and if
there is none, all of the row, or all but its outer groups, may be one.

All of it are Spark expressions, of one row each; nothing is shuffled.

Cases: null and empty texts, and texts without a candidate, stay as they are; candidates that
are not valid stay; every row gives one row, whatever its other columns; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days of 400 years of the calendar, which are 189 * 773, and from 1800-01-01 to 1970-01-01.
CYCLE, DATE_BASES, EPOCH = 146_097, (189, 773), 62_091

#: Characters of the IBANs of each country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _ibans() -> str:
    """The IBANs of known length, unbroken or in groups of four."""
    out = []
    for length, lands in IBAN_LENGTHS.items():
        groups, rest = divmod(length - 4, 4)
        last = f" ?[A-Z0-9]{{{rest}}}" if rest else ""
        out.append(f"(?:{lands.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}{last}")
    return rf"(?:{'|'.join(out)})\b"


# The formats, in the order in which they are tried.
PATTERNS = {
    "mail": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": rf"\b(?:{_ibans()}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)\b",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
_CARD = r"(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9A-Za-z])"
_OTHERS = "|".join(p for name, p in PATTERNS.items() if name != "iban")
PATTERNS["card"] = rf"(?<![0-9A-Za-z])(?:{_CARD}|[0-9](?:(?:[ -](?!{_CARD}|{_OTHERS}))?[0-9]){{12,99}}(?![0-9A-Za-z]))"
#: What tells the kind of a match, which has lost what stood around it.
WHOLE = PATTERNS | {"card": "[0-9](?:[ -]?[0-9]){12,99}"}
ANY = "|".join(PATTERNS.values())


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def _characters(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _numbers(digits: Column) -> Column:
    return F.transform(_characters(digits), lambda c: c.cast("int"))


def _joined(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda x: x.cast("string")), "")


def feistel(values: Column, bases: Column, key: str, kind: str, back: bool = False) -> Column:
    """A keyed permutation of lists of numbers, each from 0 below its base."""

    def shifted(state: Column, turn: Column) -> Column:
        half = turn % 2
        others = F.array_join(F.transform(F.filter(state, lambda _, i: i % 2 != half), lambda x: x.cast("string")), ",")

        def shift(said: Column, x: Column, i: Column) -> Column:
            shake = F.sha2(F.concat(said, i.cast("string")), 256)
            by = F.conv(F.substring(shake, 1, 12), 16, 10).cast("long")
            return F.when(i % 2 == half, F.pmod(x - by if back else x + by, F.get(bases, i)).cast("int")).otherwise(x)

        said = F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), others, F.lit(""))
        return _let(said, lambda s: F.transform(state, lambda x, i: shift(s, x, i)))

    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(turns, values, shifted)


def _all(base: int, like: Column) -> Column:
    return F.transform(like, lambda _: F.lit(base))


def _luhn(digits: Column) -> Column:
    """The check sum of all digits, a list; the last one counts once."""

    def weighed(d: Column, from_end: Column) -> Column:
        twice = F.when(from_end % 2 == 1, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.reverse(digits), weighed), F.lit(0), lambda a, b: a + b) % 10


def _mod97(text: Column) -> Column:
    """Of capital letters and digits, with letters read as 10 to 35."""
    number = lambda c: F.when(c.between("0", "9"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(
        _characters(text), F.lit(0).cast("long"), lambda a, c: F.pmod(a * F.when(c.between("0", "9"), 10).otherwise(100) + number(c), F.lit(97))
    )


def _refill(pattern: str, match: Column, new: Column) -> Column:
    """`match` with the characters of a class replaced, one by one, by those of `new`."""
    return _let(new, lambda known: _filled(pattern, match, known))


def _filled(pattern: str, match: Column, new: Column) -> Column:
    size = lambda i: F.length(F.regexp_replace(F.substring(match, F.lit(1), i), f"[^{pattern}]", ""))
    parts = F.transform(
        F.sequence(F.lit(1), F.length(match)),
        lambda i: F.when(F.substring(match, i, F.lit(1)).rlike(f"[{pattern}]"), F.substring(new, size(i), F.lit(1))).otherwise(
            F.substring(match, i, F.lit(1))
        ),
    )
    return F.array_join(parts, "")


def _by_class(text: Column, key: str, kind: str, back: bool) -> Column:
    """Digits stay digits, and letters letters of their case."""
    first = lambda c: F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65).otherwise(F.ascii(c))
    base = lambda c: F.when(c.between("0", "9"), 10).when(c.rlike("[A-Za-z]"), 26).otherwise(1)
    letters = _characters(text)
    moved = feistel(F.transform(letters, lambda c: F.ascii(c) - first(c)), F.transform(letters, base), key, kind, back)
    return F.array_join(F.zip_with(moved, letters, lambda x, c: F.chr(x + first(c))), "")


def _mail(match: Column, key: str, back: bool) -> Column:
    name = F.substring_index(match, "@", 1)
    return F.concat(_by_class(name, key, "mail", back), F.substring(match, F.length(name) + 1, F.length(match)))


def _iban(match: Column, key: str, back: bool) -> Column:
    plain = F.regexp_replace(match, " ", "")
    rest = lambda s: F.substring(s, F.lit(5), F.length(s))
    valid = (_mod97(F.concat(rest(plain), F.substring(plain, 1, 4))) == 1) & F.length(plain).between(15, 34)
    check = lambda new: F.lpad((98 - _mod97(F.concat(new, F.substring(plain, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    whole = _let(_by_class(rest(plain), key, "iban", back), lambda new: F.concat(F.substring(plain, 1, 2), check(new), new))
    return F.when(valid, _refill("A-Z0-9", match, whole))


def _ipv4(match: Column, key: str, back: bool) -> Column:
    parts = F.transform(F.split(match, r"\."), lambda p: p.cast("int"))
    plain = ~match.rlike(r"(^|\.)0[0-9]")
    valid = plain & F.forall(parts, lambda p: p <= 255)
    # addresses of hosts stay some, and the 33 blocks 0 and 224 to 255 stay among themselves
    host = F.get(parts, 0).between(1, 223)
    rank = lambda p: F.when(host, p - 1).when(p > 0, p - 223).otherwise(0)
    shown = lambda p: F.when(host, p + 1).when(p > 0, p + 223).otherwise(0)
    bases = F.array(F.when(host, 223).otherwise(33), *[F.lit(256)] * 3)
    moved = feistel(F.transform(parts, lambda p, i: F.when(i == 0, rank(p)).otherwise(p)), bases, key, "ipv4", back)
    return F.when(valid, F.array_join(F.transform(moved, lambda p, i: F.when(i == 0, shown(p)).otherwise(p).cast("string")), "."))


def _date(match: Column, key: str, back: bool) -> Column:
    form = F.when(match.contains("-"), "yyyy-MM-dd").when(match.contains("."), "dd.MM.yyyy").when(
        F.substring(match, 1, 2).cast("int") <= 12, "MM/dd/yyyy"
    ).otherwise("dd/MM/yyyy")
    number = lambda at, size: F.substring(match, at, F.lit(size)).try_cast("int")
    iso, month_first = form == "yyyy-MM-dd", form == "MM/dd/yyyy"
    year = F.when(iso, number(F.lit(1), 4)).otherwise(number(F.lit(7), 4))
    month = F.when(iso, number(F.lit(6), 2)).when(month_first, number(F.lit(1), 2)).otherwise(number(F.lit(4), 2))
    day = F.when(iso, number(F.lit(9), 2)).when(month_first, number(F.lit(4), 2)).otherwise(number(F.lit(1), 2))
    date = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")).try_cast("date")
    since = F.unix_date(date) + EPOCH
    within = F.pmod(since, F.lit(CYCLE))
    a, b = DATE_BASES
    moved = feistel(F.array((within % a).cast("int"), F.floor(within / a).cast("int")), F.array(F.lit(a), F.lit(b)), key, "date", back)
    new = _let(moved, lambda m: F.date_from_unix_date((since - within + F.get(m, 0) + a * F.get(m, 1) - EPOCH).cast("int")))
    text = _let(new, lambda d: F.when(iso, F.date_format(d, "yyyy-MM-dd")).when(form == "dd.MM.yyyy", F.date_format(d, "dd.MM.yyyy")).when(
        month_first, F.date_format(d, "MM/dd/yyyy")
    ).otherwise(F.date_format(d, "dd/MM/yyyy")))
    return F.when(date.isNotNull() & year.between(1000, 2999), text)


def _phone(match: Column, key: str, back: bool) -> Column:
    plain = _digits(match)
    country = F.substring(plain, F.lit(1), F.length(plain) - 10)
    national = F.substring(plain, F.length(plain) - 9, F.lit(10))
    digits = _numbers(national)
    valid = match.rlike(r"^(?:\+|\()") | national.rlike("^[2-9]..[2-9]")
    # where an assigned number has 2 to 9, those stay among themselves, and 0 and 1 too
    least = F.transform(digits, lambda d, i: F.when(i.isin(0, 3) & (d > 1), 2).otherwise(0))
    bases = F.transform(digits, lambda d, i: F.when(~i.isin(0, 3), 10).when(d > 1, 8).otherwise(2))
    moved = feistel(F.zip_with(digits, least, lambda d, m: d - m), bases, key, "phone", back)
    new = _joined(F.zip_with(moved, least, lambda d, m: d + m))
    return F.when(valid, _refill("0-9", match, F.concat(country, new)))


def _ssn(match: Column, key: str, back: bool) -> Column:
    area, group, serial = [F.get(F.split(match, "-"), i).cast("int") for i in range(3)]
    # areas 666 and 900 to 999, group 00 and serial 0000 stay among themselves
    other = (area == 666) | (area > 899)
    rank = F.when(area == 666, 0).when(area > 899, area - 899).when(area > 666, area - 2).otherwise(area - 1)
    moved = feistel(
        F.array(rank, F.greatest(group - 1, F.lit(0)), F.greatest(serial - 1, F.lit(0))),
        F.array(F.when(other, 101).otherwise(898), F.when(group > 0, 99).otherwise(1), F.when(serial > 0, 9999).otherwise(1)), key, "ssn", back,
    )

    def shown(m: Column) -> Column:
        new = F.get(m, 0)
        area = F.when(other, F.when(new == 0, 666).otherwise(new + 899)).when(new >= 665, new + 2).otherwise(new + 1)
        parts = [(area, 3), (F.when(group > 0, F.get(m, 1) + 1).otherwise(0), 2), (F.when(serial > 0, F.get(m, 2) + 1).otherwise(0), 4)]
        return F.concat_ws("-", *[F.lpad(p.cast("string"), n, "0") for p, n in parts])

    return F.when(area > 0, _let(moved, shown))


def _card(match: Column, key: str, back: bool) -> Column:
    """The row of groups with pseudonyms for its cards, and how many these are."""

    def renewed(digits: Column) -> Column:
        inner = F.slice(digits, F.lit(2), F.size(digits) - 2)
        # the first digit names the kind of card and stays
        moved = F.concat(F.slice(digits, 1, 1), feistel(inner, _all(10, inner), key, "card", back))
        return _let(moved, with_check)

    def with_check(moved: Column) -> Column:
        check = F.pmod(10 - _luhn(F.concat(moved, F.array(F.lit(0)))), F.lit(10))
        return F.concat(_joined(moved), check.cast("string"))

    def span(first: Column, size: Column) -> Column:
        return F.struct(first.cast("int").alias("first"), size.cast("int").alias("size"))

    def written(groups: Column, s: Column) -> Column:
        return F.array_join(F.slice(groups, s["first"] + 1, s["size"]), "")

    def valid(groups: Column, s: Column) -> Column:
        return _let(written(groups, s), lambda d: F.length(d).between(13, 19) & (_luhn(_numbers(d)) == 0))

    def of_fours(groups: Column) -> Column:
        """Four groups of four, from the left, none of which is in two cards."""
        at = F.filter(F.sequence(F.lit(0), F.size(groups) - 1), lambda i: F.forall(F.slice(groups, i + 1, F.lit(4)), lambda g: F.length(g) == 4))
        spans = F.filter(F.transform(at, lambda i: span(i, F.lit(4))), lambda s: (s["first"] + 4 <= F.size(groups)) & valid(groups, s))
        none = F.array().cast("array<struct<first:int,size:int>>")
        return F.aggregate(spans, none, lambda out, s: F.when(F.exists(out, lambda o: o["first"] + 4 > s["first"]), out).otherwise(F.concat(out, F.array(s))))

    def outer(groups: Column) -> Column:
        """All groups, or without one before or up to two behind of at most four digits."""
        tries = F.array(*[span(F.lit(a), F.size(groups) - a - b) for a in (0, 1) for b in (0, 1, 2)])
        short = lambda s: F.forall(
            F.transform(groups, lambda g, i: (F.length(g) <= 4) | ((i >= s["first"]) & (i < s["first"] + s["size"]))), lambda x: x
        )
        return F.slice(F.filter(tries, lambda s: F.when((s["size"] > 0) & short(s), valid(groups, s)).otherwise(False)), 1, 1)

    def cards(groups: Column) -> Column:
        return _let(of_fours(groups), lambda found: F.when(F.size(found) > 0, found).otherwise(outer(groups)))

    def shown(groups: Column, spans: Column) -> Column:
        def piece(g: Column, i: Column) -> Column:
            begun = F.get(F.filter(spans, lambda s: s["first"] == i), 0)
            inside = F.exists(spans, lambda s: (s["first"] < i) & (i < s["first"] + s["size"]))
            return F.when(begun.isNotNull(), _let(_numbers(written(groups, begun)), renewed)).when(inside, "").otherwise(g)

        new = F.array_join(F.transform(groups, piece), "")
        return F.when(F.size(spans) > 0, F.struct(_refill("0-9", match, new).alias("text"), F.size(spans).alias("n")))

    return _let(F.split(match, "[ -]"), lambda groups: _let(cards(groups), lambda spans: shown(groups, spans)))


KINDS: dict[str, Callable[[Column, str, bool], Column]] = {
    "mail": _mail, "iban": _iban, "ipv4": _ipv4, "date": _date, "phone": _phone, "ssn": _ssn, "card": _card,
}


def _replacement(match: Column, key: str, back: bool) -> Column:
    """The pseudonym of a candidate and how many values it replaces; null if it is not valid."""
    out = None
    for name, kind in KINDS.items():
        whole = match.rlike(f"^(?:{WHOLE[name]})$")
        new = kind(match, key, back)
        if name != "card":
            new = _let(new, lambda n: F.when(n.isNotNull(), F.struct(n.alias("text"), F.lit(1).alias("n"))))
        out = F.when(whole, new) if out is None else out.when(whole, new)
    return out


def _replaced(docs: DataFrame, key: str, back: bool) -> DataFrame:
    """`docs`, which has text, with the columns `new_text` and `n_replaced`."""
    # a text without a digit or @ has no candidate, and is not searched further
    may = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    found = docs.withColumn("matches", F.when(may, F.regexp_extract_all("text", F.lit(ANY), 0)))
    found = found.withColumn("new", F.when(F.size("matches") > 0, F.transform("matches", lambda m: _replacement(m, key, back))))
    shown = F.zip_with("matches", "new", lambda m, n: F.coalesce(n["text"], m))
    pieces = F.zip_with(F.split("text", ANY, -1), shown, lambda part, m: F.concat(part, F.coalesce(m, F.lit(""))))
    count = F.aggregate("new", F.lit(0), lambda total, n: total + F.coalesce(n["n"], F.lit(0)))
    return found.select(
        *docs.columns,
        F.when(F.size("matches") > 0, F.array_join(pieces, "")).otherwise(F.col("text")).alias("new_text"),
        F.when(F.size("matches") > 0, count).otherwise(0).alias("n_replaced"),
    )


def pseudonyms(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text, n_replaced: the texts with pseudonyms, and how many values they replace."""
    out = _replaced(docs.select("doc_id", "text"), key, back=False)
    return out.select("doc_id", F.col("new_text").alias("text"), "n_replaced")


def reveal(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text: `pseudonyms` undone."""
    out = _replaced(docs.select("doc_id", "text"), key, back=True)
    return out.select("doc_id", F.col("new_text").alias("text"))


def with_pseudonyms(docs: DataFrame, key: str) -> DataFrame:
    """The rows of `docs` with pseudonyms in their text, and all other columns as they are."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index('text')}"
    out = _replaced(plain.withColumn("text", F.col(text)), key, back=False)
    return out.select(*[F.col("new_text" if n == text else n).alias(names[i]) for i, n in enumerate(plain.columns)])
