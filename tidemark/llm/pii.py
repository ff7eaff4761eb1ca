"""Format-preserving pseudonyms: personal numbers, dates and addresses are permuted by a keyed Feistel network.

Every candidate is validated first (check digits, calendar, numbering plan, octets); what fails stays as it is. A
valid value is split into two halves, and in each of 8 rounds one half is shifted, character by character within
its own class (digits, lower case, upper case), by an HMAC-SHA-256 of the other half. That permutes the values of a
format: different values get different pseudonyms, equal ones the same in every document, and only the key's holder
can invert it. Where a valid value can turn into an invalid one, the permutation is applied again until the result
is valid (cycle walking), and check digits are computed anew. At most WALK steps are made; formats are such that more are
needed with a chance below 1e-27 a value, and a value that needs them stays as it is.

Dates keep their way of writing: order of day and month, sign between them, and zeros before one digit. Each way is a format of
its own, permuted among the days that are written in it and read back the same (with the day first beside /, only days over
12 are), so that no two dates share a pseudonym. Dates before 1900 or after 2099 stay.

Each shape of value is searched for on its own, strictest first, in what earlier shapes left; every place where it
starts is tried, and only valid values take their place. So a value is found whatever other numbers stand beside it.
A card of unusual groups with one or two digits is found only where its run of numbers starts with it.

All of it is column expressions in one pass over the rows, without a shuffle; texts without a digit or @ are not
searched.

Defined results: null texts stay null, empty ones empty. Texts of any length are searched whole. Of values that overlap
the strictest kind is taken, then the leftmost. Repeated rows get equal results. An empty table gives no rows. Other columns
are kept whatever their names are, but for the counts n_<kind>, to which columns of that name give way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import aside, back
from tidemark.llm.stats import once

ROUNDS = 8
WALK = 256
#: Days since 1899-12-31 that dates are permuted among, up to 2099-12-31.
DAYS = 73_049
DAY_SIDE = 271

EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9.-]{0,250}[A-Za-z0-9])?\.[A-Za-z]{2,24}"
IBAN = r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"
#: Characters of an IBAN by country, for those written in groups of four, whose end nothing else shows.
_IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK|FI|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA",
    23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HU|LB|NI|PL|SV",
    29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
GROUPED_IBAN = "(?:" + "|".join(f"(?:{c})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in _IBAN_SIZES.items()) + ")"
IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
ISO = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
SLASH = r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"
DOTTED = r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}"
#: Cards as they are printed: one group, or the groups of 16, 19, 15 and 14 digits.
CARD = r"(?<!\+)(?:[0-9]{13,19}|[0-9]{4}(?:[ -]?[0-9]{4}){3}(?:[ -][0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})"
#: Cards in other groups of three digits or more, and in any groups.
GROUPED = r"[0-9]{3,}(?:[ -][0-9]{3,}){1,5}"
LOOSE = r"[0-9](?:[ -]?[0-9]){12,18}"
PHONE = r"(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-]?)[0-9]{3}[ .-]?[0-9]{4}"
#: Numbers with + and a country code. Where the country gives their length, nothing after one is taken.
_TRUNK = r"(?:[ .-]?\(0\))?[ .-]?"
_SAME_SIZE = {8: "45|47", 9: "31|33|34|41|48|61|351|420", 10: "7|44|90|91"}
SIZED_WORLD = r"\+(?:" + "|".join(rf"(?:{c}){_TRUNK}[0-9](?:[ .-]?[0-9]){{{n - 1}}}" for n, c in _SAME_SIZE.items()) + ")"
PLAIN_WORLD = r"\+[2-9][0-9]{7,14}"
WORLD = rf"\+[2-9][0-9]{_TRUNK}[0-9](?:[ .-]?[0-9]){{5,12}}"
_COUNTRY = "^(?:7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
KINDS = ("email", "iban", "ip", "ssn", "date", "card", "phone")
_BEFORE, _EDGE = r"(?<![A-Za-z0-9]|[0-9][.-])", r"(?![A-Za-z0-9]|[.-][0-9])"
_AROUND = {"email": (r"(?<![A-Za-z0-9._%+-])", r"(?![A-Za-z0-9])"), "date": (_BEFORE, rf"(?:{_EDGE}|(?=T[0-9]{{2}}:?[0-9]{{2}}))")}
#: Digits of a card, in the order in which they are tried at a place that may hold several.
_CARD_DIGITS = (16, 15, 14, 19, 18, 17, 13)
#: (kind, pattern, digits to try at a place if not all of the match), in the order in which they are searched for.
SHAPES: tuple[tuple[str, str, tuple[int, ...]], ...] = (
    ("email", EMAIL, ()),
    ("iban", f"(?:{IBAN}|{GROUPED_IBAN})", ()),
    ("ip", IP, ()),
    ("ssn", SSN, ()),
    ("date", f"(?:{ISO}|{SLASH}|{DOTTED})", ()),
    ("card", CARD, _CARD_DIGITS),
    ("phone", f"(?:{SIZED_WORLD}|{PLAIN_WORLD}|{WORLD}|{PHONE})", ()),
    ("card", GROUPED, _CARD_DIGITS),
    ("card", LOOSE, (19, 18, 17, 16, 15, 14, 13)),
)


def hmac(key: str, message: Column) -> Column:
    """HMAC-SHA-256 of a string, in hex."""
    own = key.encode()
    own = (hashlib.sha256(own).digest() if len(own) > 64 else own).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in own)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def _prf(key: str, number: Column, other: Column, i: Column) -> Column:
    """16 keyed bits for character i of the half that this round changes."""
    digest = hmac(key, F.concat_ws("|", number.cast("string"), F.floor(i / 16).cast("string"), other))
    return F.conv(F.substring(digest, (F.pmod(i, F.lit(16)) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def _shift(half: Column, number: Column, other: Column, key: str) -> Column:
    def one(c: Column, i: Column) -> Column:
        a, f = F.ascii(c), _prf(key, number, other, i)

        def turn(first: int, size: int) -> Column:
            return F.char(F.lit(first) + F.pmod(a - first + f, F.lit(size)))

        return F.when(c.rlike("^[0-9]$"), turn(48, 10)).when(c.rlike("^[a-z]$"), turn(97, 26)).when(c.rlike("^[A-Z]$"), turn(65, 26)).otherwise(c)

    return F.array_join(F.transform(F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, "")), one), "")


def feistel(value: Column, key: str) -> Column:
    """The pseudonym of a string of one byte characters: each stays in its class, others stay as they are."""
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"))

    def step(s: Column, k: Column) -> Column:
        even = k % 2 == 0
        return F.struct(F.when(even, _shift(s["l"], k, s["r"], key)).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(_shift(s["r"], k, s["l"], key)).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))


def feistel_number(value: Column, side: int, key: str, tag: str) -> Column:
    """A permutation of the numbers from 0 to side * side - 1."""
    start = F.struct(F.floor(value / side).cast("long").alias("l"), F.pmod(value, F.lit(side)).cast("long").alias("r"))

    def f(number: Column, other: Column) -> Column:
        return F.conv(F.substring(hmac(key, F.concat_ws("|", F.lit(tag), number.cast("string"), other.cast("string"))), 1, 12), 16, 10).cast("long")

    def step(s: Column, k: Column) -> Column:
        even = k % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["l"] + f(k, s["r"]), F.lit(side))).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + f(k, s["l"]), F.lit(side))).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * side + s["r"])


def walk(value: Column, permute: Callable[[Column], Column], valid: Callable[[Column], Column]) -> Column:
    """permute, again while the result isn't valid; a permutation of the valid values. The value itself if WALK steps
    reach none, see the module's text."""
    start = F.struct(permute(value).alias("x"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), start, lambda s, _: F.struct(F.when(valid(s["x"]), s["x"]).otherwise(permute(s["x"])).alias("x")), lambda s: F.when(valid(s["x"]), s["x"]).otherwise(value)
    )


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def refill(shape: Column, own: Column) -> Column:
    """shape with its digits replaced, one by one, by the digits of own."""
    at = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct((s["i"] + digit.cast("int")).alias("i"), F.concat(s["out"], F.when(digit, F.substring(own, s["i"] + 1, F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(shape, ""), at, step, lambda s: s["out"])


def luhn_digit(payload: Column) -> Column:
    """The check digit that follows a payload of digits."""
    n = F.length(payload)
    doubled = F.transform(F.split(payload, ""), lambda c, i: F.when((n - i) % 2 == 1, F.lit(2) * c.cast("int")).otherwise(c.cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda s, x: s + F.floor(x / 10).cast("int") + x % 10)
    return F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string")


def mod97(text: Column) -> Column:
    """A string of digits and capitals, A as 10 and so on, modulo 97."""
    return F.aggregate(
        F.split(text, ""), F.lit(0), lambda s, c: F.when(c.rlike("^[0-9]$"), (s * 10 + (F.ascii(c) - 48)) % 97).otherwise((s * 100 + (F.ascii(c) - 55)) % 97).cast("int")
    )


def _tail(value: Column, start: int) -> Column:
    return F.substring(value, F.lit(start), F.length(value))


def _local_part(m: Column, key: str) -> Column:
    return F.concat(feistel(F.substring_index(m, "@", 1), key), F.lit("@"), F.substring_index(m, "@", -1))


def _iban(m: Column, key: str) -> Column:
    def of(own: Column) -> Column:
        country = F.substring(m, 1, 2)
        check = 98 - mod97(F.concat(own, country, F.lit("00")))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), own)

    plain = once(feistel(_tail(_joined(m), 5), key), of)
    return F.when(m.contains(" "), F.regexp_replace(plain, "(.{4})(?!$)", "$1 ")).otherwise(plain)


def _joined(m: Column) -> Column:
    return F.regexp_replace(m, " ", "")


def _ip(m: Column, key: str) -> Column:
    value = F.aggregate(F.split(m, r"\."), F.lit(0).cast("long"), lambda s, x: s * 256 + x.cast("long"))
    return once(feistel_number(value, 65_536, key, "ip"), lambda v: F.concat_ws(".", *[F.pmod(F.shiftright(v, k), F.lit(256)).cast("string") for k in (24, 16, 8, 0)]))


#: In the order in which they are tried; those with / and . also take days and months of one digit.
_DATES = ("yyyy-MM-dd", "M/d/yyyy", "d/M/yyyy", "d.M.yyyy", "M.d.yyyy")


def _parsed(m: Column) -> Column:
    return F.coalesce(*[F.try_to_date(m, p) for p in _DATES])


def _day(m: Column) -> Column:
    return F.datediff(_parsed(m), F.lit("1900-01-01").cast("date")).cast("long")


def _date(m: Column, key: str) -> Column:
    def to_day(d: Column) -> Column:
        return F.date_add(F.lit("1900-01-01").cast("date"), d.cast("int"))

    def way(pattern: str) -> Column:
        if len(pattern) == 10:
            return once(walk(_day(m), lambda x: feistel_number(x, DAY_SIDE, key, "date"), lambda x: x < DAYS), lambda d: F.date_format(to_day(d), pattern))
        second_choice = pattern in ("d/M/yyyy", "M.d.yyyy")  # read so only where the other reading is no date
        first, second = (F.regexp_extract(m, "^([0-9]+)[/.]([0-9]+)", k) for k in (1, 2))
        short, zero = [F.length(x) == 1 for x in (first, second)], [x.startswith("0") for x in (first, second)]
        parts = ["d", "M"] if pattern[0] == "d" else ["M", "d"]
        sign = pattern[1]

        def valid(x: Column) -> Column:
            day, month = F.dayofmonth(to_day(x)), F.month(to_day(x))
            a, b = (day, month) if parts[0] == "d" else (month, day)
            one = short[0] | short[1]
            # without one digit alone: all dates; with zeros beside one digit: both parts below 10; else one of them at least
            written = ~one | F.when(zero[0] | zero[1], (a < 10) & (b < 10)).otherwise((a < 10) | (b < 10))
            return (x < DAYS) & written & ((day > 12) if second_choice else F.lit(True))

        def write(d: Column) -> Column:
            def part(k: int) -> Column:
                plain = F.date_format(to_day(d), parts[k])
                return F.when(~(short[0] | short[1]) | zero[k], F.lpad(plain, 2, "0")).otherwise(plain)

            return F.concat(part(0), F.lit(sign), part(1), F.lit(sign), F.date_format(to_day(d), "yyyy"))

        return once(walk(_day(m), lambda x: feistel_number(x, DAY_SIDE, key, f"date{pattern}"), valid), write)

    return F.coalesce(*[F.when(F.try_to_date(m, p).isNotNull(), way(p)) for p in _DATES])


def _ssn_ok(d: Column) -> Column:
    return d.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")


def _phone_ok(d: Column) -> Column:
    return d.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")


def _number(m: Column, key: str, ok: Callable[[Column], Column]) -> Column:
    """The last digits (9 or 10) permuted among those that pass ok, or among those that don't, as they do
    themselves; digits before them (a country code) are kept."""
    d = digits(m)
    n = F.when(F.length(d) > 10, 1).otherwise(0)
    own = F.substring(d, n + 1, F.length(d))
    return refill(m, F.concat(F.substring(d, F.lit(1), n), walk(own, lambda x: feistel(x, key), lambda x: ok(x) == ok(own))))


def _phone(m: Column, key: str) -> Column:
    """Of numbers with a country code other than 1 the code and a trunk (0) are kept, else as _number."""

    def zero_led(d: Column, n: Column) -> Column:
        return F.substring(d, n, F.lit(1)) == "0"

    def world(d: Column) -> Column:
        n = F.length(F.regexp_extract(d, _COUNTRY, 0)) + m.contains("(0)").cast("int")
        n = n + F.substring(d, n + 1, F.lit(1)).eqNullSafe("0").cast("int")  # a leading zero stays
        own = F.substring(d, n + 1, F.length(d))
        return refill(m, F.concat(F.substring(d, F.lit(1), n), F.when(zero_led(d, n), feistel(own, key)).otherwise(walk(own, lambda x: feistel(x, key), lambda x: ~x.startswith("0")))))

    return F.when(m.rlike(r"^\+[2-9]"), once(digits(m), world)).otherwise(_number(m, key, _phone_ok))


def _card(m: Column, key: str) -> Column:
    payload = F.substring(digits(m), F.lit(1), F.length(digits(m)) - 1)
    return once(feistel(payload, key), lambda p: refill(m, F.concat(p, luhn_digit(p))))


#: What a match must pass, and its pseudonym, by kind.
VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "iban": lambda m: mod97(F.concat(_tail(_joined(m), 5), F.substring(m, 1, 4))) == 1,
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda x: x.cast("int") < 256),
    "ssn": lambda m: _ssn_ok(digits(m)),
    "date": lambda m: F.coalesce(_day(m).between(0, DAYS - 1), F.lit(False)),
    "card": lambda m: F.substring(digits(m), -1, 1) == luhn_digit(F.substring(digits(m), F.lit(1), F.length(digits(m)) - 1)),
    # a number that is written as a telephone number needn't follow the numbering plan
    "phone": lambda m: _phone_ok(F.substring(digits(m), -10, 10)) | m.rlike(r"^\+|\("),
}
PSEUDONYM: dict[str, Callable[[Column, str], Column]] = {
    "email": _local_part,
    "iban": _iban,
    "ip": _ip,
    "ssn": lambda m, key: _number(m, key, _ssn_ok),
    "date": _date,
    "card": _card,
    "phone": _phone,
}


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    out = m
    for k in KINDS:
        out = F.when(kind == k, PSEUDONYM[k](m, key)).otherwise(out)
    return out


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda x: x == kind


def _around(kind: str) -> tuple[str, str]:
    return _AROUND.get(kind, (_BEFORE, _EDGE))


#: Where a shape is; most texts have none.
ANY = "|".join(f"{_around(kind)[0]}{pattern}{_around(kind)[1]}" for kind, pattern, _ in SHAPES)
_SEGMENTS = "array<struct<t:string,k:string>>"


def _valid_start(m: Column, kind: str, sizes: tuple[int, ...]) -> Column:
    """m if it is valid; with sizes, the first valid one of the values of so many digits that m starts with. Else null."""
    if not sizes:
        return F.when(VALID[kind](m), m)

    def of(n: int) -> Column:
        start = F.regexp_extract(m, rf"^[0-9](?:[ -]?[0-9]){{{n - 1}}}{_EDGE}", 0)
        return once(start, lambda v: F.when((v != "") & VALID[kind](v), v))

    return F.coalesce(*[of(n) for n in sizes])


def _open(t: Column) -> Column:
    return F.struct(t.alias("t"), F.lit(None).cast("string").alias("k"))


def _search(segment: Column, kind: str, pattern: str, sizes: tuple[int, ...]) -> Column:
    """An open segment cut into valid values of the shape and what lies between them.

    Every place where the shape starts is tried, also inside of a match that isn't valid; of valid values that
    overlap, the leftmost is taken. Where each leftmost match is a valid value as it is, they are just that.
    """
    before, after = _around(kind)
    shape = f"{before}{pattern}{after}"
    matches = F.regexp_extract_all(segment["t"], F.lit(shape), F.lit(0))

    def as_matched(m: Column) -> Column:
        return F.flatten(F.zip_with(F.split(segment["t"], shape, -1), m, lambda p, v: F.when(v.isNull(), F.array(_open(p))).otherwise(F.array(_open(p), F.struct(v.alias("t"), F.lit(kind).alias("k"))))))

    def cut(m: Column) -> Column:
        return F.when(F.forall(m, lambda v: v.eqNullSafe(_valid_start(v, kind, sizes))), as_matched(m)).otherwise(_everywhere(segment, kind, pattern, sizes))

    return F.when(segment["k"].isNull() & segment["t"].rlike(shape), once(matches, cut)).otherwise(F.array(segment))


def _everywhere(segment: Column, kind: str, pattern: str, sizes: tuple[int, ...]) -> Column:
    """The cut of _search with every place tried one by one."""
    before, after = _around(kind)
    # the text is cut at these places, so the lengths of pieces tell how much of a value lies in the next ones
    starts = F.regexp_extract_all(segment["t"], F.lit(f"{before}(?=({pattern}){after})"), F.lit(1))
    values = F.transform(starts, lambda m: _valid_start(m, kind, sizes))
    pieces = F.split(segment["t"], f"{before}(?={pattern}{after})", -1)

    def settle(v: Column) -> Column:
        # a cut at the very start leaves no empty piece before it
        led = once(pieces, lambda p: F.when(F.size(p) == F.size(v), p).otherwise(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))))
        lead = once(pieces, lambda p: F.when(F.size(p) == F.size(v), F.lit("")).otherwise(F.get(p, F.lit(0))))
        zero = F.struct(lead.alias("open"), F.lit(0).alias("skip"), F.array().cast(_SEGMENTS).alias("out"))

        def step(s: Column, x: Column) -> Column:
            taken = (s["skip"] == 0) & x["v"].isNotNull()
            skip = F.when(taken, F.length(x["v"])).otherwise(s["skip"])
            rest = F.substring(x["p"], skip + 1, F.length(x["p"]))
            found = F.array(_open(s["open"]), F.struct(x["v"].alias("t"), F.lit(kind).alias("k")))
            return F.struct(
                F.when(taken, rest).otherwise(F.concat(s["open"], rest)).alias("open"),
                F.greatest(skip - F.length(x["p"]), F.lit(0)).alias("skip"),
                F.when(taken, F.concat(s["out"], found)).otherwise(s["out"]).alias("out"),
            )

        last = F.aggregate(F.zip_with(led, v, lambda p, m: F.struct(p.alias("p"), m.alias("v"))), zero, step, lambda s: F.concat(s["out"], F.array(_open(s["open"]))))
        return F.when(F.exists(v, lambda x: x.isNotNull()), last).otherwise(F.array(segment))

    return once(values, settle)


def _searcher(kind: str, pattern: str, sizes: tuple[int, ...]) -> Callable[[Column], Column]:
    return lambda s: _search(s, kind, pattern, sizes)


def segments(text: Column) -> Column:
    """The text as an array of (t, k): values of kind k, and what lies between them with a null k."""
    out = F.array(_open(text))
    for kind, pattern, sizes in SHAPES:
        out = F.flatten(F.transform(out, _searcher(kind, pattern, sizes)))
    return out


def pseudonymise(docs: DataFrame, key: str = "tidemark") -> DataFrame:
    """docs with its text rewritten, and n_<kind> for each kind: how many values were replaced."""
    t = F.col("text")
    own = aside(docs, "text").withColumn("_found", F.when(t.rlike(r"[0-9@]") & t.rlike(ANY), segments(t)))
    pieces = F.transform(F.col("_found"), lambda s: F.when(s["k"].isNull(), s["t"]).otherwise(pseudonym(s["t"], s["k"], key)))
    counts = {f"n_{k}": F.coalesce(F.size(F.filter(F.col("_found.k"), _is(k))), F.lit(0)).cast("long") for k in KINDS}
    found = own.withColumns({"text": F.when(F.col("_found").isNull(), t).otherwise(F.array_join(pieces, "")), **counts})
    return back(found, docs, ("text",), counts)
