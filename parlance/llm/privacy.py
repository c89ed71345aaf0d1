"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Card numbers, phone numbers, IPv4 addresses, dates, account numbers, e-mail names and secrets are found by pattern,
validated, and replaced by a keyed permutation of their own format, so that equal values stay equal in all documents.
The permutation is an alternating Feistel network over two digit groups; its round function is SHA-256 under a key.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6

#: Lengths of the countries' account numbers (IBAN).
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """Account numbers at their country's length, and those of other countries or lengths as far as they go, but not into one at its country's length."""
    rest = lambda n: f"(?: ?[A-Z0-9]{{4}}){{{n // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    known = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}{rest(n - 4)}" for n, c in _IBAN_LENGTHS.items())
    known = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{known})(?![A-Za-z0-9])"
    return rf"{known}|(?<![A-Za-z0-9])[A-Z]{{2}}[0-9]{{2}}(?:(?! {known}) ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9])"


#: The pattern of each kind, in the order in which a place is tried. Boundaries keep longer runs whole, and let
#: no pattern start inside a run that it has already read, so that the scan is linear in the length of a word.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}",
    "iban": _iban_pattern(),
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?!(?![Tt][0-9])[0-9A-Za-z/-]|[.][0-9])",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:[.][0-9]{1,3}){3}(?![0-9]|[.][0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:[+]1(?:[ .()-]{0,2}[0-9]){10}|[+][2-9](?:[ .()-]{0,2}[0-9]){6,14}|[(][0-9]{3}[)][ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every found value holds; texts without any of it are not searched further.
_HINT = "@|[+][0-9]|[0-9]{4}|[0-9][./-][0-9]|[A-Z]{2}[0-9]{2}|[0-9A-Fa-f]{32}"
#: Country calling codes of one and two digits; all others have three.
_CALLING = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
#: The permuted calendar begins here, and ends on 2099-12-31.
_FIRST_DAY = "1900-01-01"
_MONTHS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def feistel(value: Column, low: Column | int, high: Column | int, key: str, tweak: Column) -> Column:
    """A permutation of 0 .. low * high - 1: the two digits of value to the mixed base are added to in turn, modulo their own base."""
    low_c = low if isinstance(low, Column) else F.lit(low).cast("long")
    high_c = high if isinstance(high, Column) else F.lit(high).cast("long")
    start = F.struct(F.floor(value / low_c).cast("long").alias("a"), F.pmod(value, low_c).cast("long").alias("b"))

    def step(s: Column, r: Column) -> Column:
        odd = F.pmod(r, F.lit(2)) == 1
        digest = lambda half: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, r.cast("string"), half.cast("string")), 256), 1, 15), 16, 10).cast("long")
        a, b = s.getField("a"), s.getField("b")
        return F.struct(
            F.when(odd, F.pmod(a + F.pmod(digest(b), high_c), high_c)).otherwise(a).cast("long").alias("a"),
            F.when(odd, b).otherwise(F.pmod(b + F.pmod(digest(a), low_c), low_c)).cast("long").alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s.getField("a") * low_c + s.getField("b"))


def permute_digits(digits: Column, key: str, tweak: Column) -> Column:
    """A string of 1 to 36 digits to another of the same length: the two halves are the Feistel network's digits."""
    n = F.length(digits)
    right = F.floor(n / 2).cast("int")
    left = n - right
    power = lambda e: F.element_at(F.array(*[F.lit(10**i).cast("long") for i in range(19)]), e + 1)
    start = F.struct(F.substr(digits, F.lit(1), left).cast("long").alias("a"), F.coalesce(F.substr(digits, left + 1, right).cast("long"), F.lit(0).cast("long")).alias("b"))

    def step(s: Column, r: Column) -> Column:
        odd = F.pmod(r, F.lit(2)) == 1
        half = F.when(odd, s.getField("b")).otherwise(s.getField("a"))
        modulus = power(F.when(odd, left).otherwise(right))
        f = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, n.cast("string"), r.cast("string"), half.cast("string")), 256), 1, 15), 16, 10).cast("long")
        moved = F.pmod(F.when(odd, s.getField("a")).otherwise(s.getField("b")) + F.pmod(f, modulus), modulus)
        return F.struct(F.when(odd, moved).otherwise(s.getField("a")).cast("long").alias("a"), F.when(odd, s.getField("b")).otherwise(moved).cast("long").alias("b"))

    def text(s: Column) -> Column:
        return F.concat(F.lpad(s.getField("a").cast("string"), left, "0"), F.when(right > 0, F.lpad(s.getField("b").cast("string"), right, "0")).otherwise(F.lit("")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, text)


def fill(shape: Column, characters: Column, kind: str = "[0-9]") -> Column:
    """shape with its characters of the kind replaced, in order, by those of `characters`; everything else stays."""
    chars = F.split(shape, "")
    return F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(
            c.rlike(f"^{kind}$"), F.struct(F.concat(s.getField("out"), F.substr(characters, s.getField("at"), F.lit(1))).alias("out"), (s.getField("at") + 1).alias("at"))
        ).otherwise(F.struct(F.concat(s.getField("out"), c).alias("out"), s.getField("at").alias("at"))),
        lambda s: s.getField("out"),
    )


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string; a valid number's is a multiple of 10."""
    return F.aggregate(
        F.split(F.reverse(digits), ""),
        F.struct(F.lit(0).alias("s"), F.lit(False).alias("d")),
        lambda s, c: F.struct(
            (s.getField("s") + F.when(s.getField("d"), F.expr("0") + F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))).otherwise(c.cast("int"))).alias("s"), (~s.getField("d")).alias("d")
        ),
        lambda s: s.getField("s"),
    )


def bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def permute_card(value: Column, key: str) -> Column:
    """All digits but the last are permuted, and the check digit is computed anew; a number that fails the Luhn test stays."""
    check = lambda b: F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")

    def moved(digits: Column) -> Column:
        new = permute_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), key, F.lit("card"))
        return F.when(F.pmod(luhn_sum(digits), F.lit(10)) == 0, fill(value, bound(new, lambda b: F.concat(b, check(b))))).otherwise(value)

    return bound(F.regexp_replace(value, "[^0-9]", ""), moved)


#: Social security numbers: areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999.
_AREAS, _GROUPS, _SERIALS = 898, 99, 9999


def permute_ssn(value: Column, key: str) -> Column:
    """A permutation of the numbers that can be issued; all others stay."""
    area, group, serial = (F.element_at(F.split(value, "-"), i).cast("long") for i in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = ((area - F.when(area > 666, 2).otherwise(1)) * _GROUPS + group - 1) * _SERIALS + serial - 1

    def show(x: Column) -> Column:
        over = F.floor(x / _SERIALS).cast("long")
        new = F.floor(over / _GROUPS).cast("long")
        digits = lambda v, n: F.lpad(v.cast("string"), n, "0")
        return F.concat_ws("-", digits(new + F.when(new >= 665, 2).otherwise(1), 3), digits(over % _GROUPS + 1, 2), digits(x % _SERIALS + 1, 4))

    return F.when(valid, bound(feistel(place, _SERIALS, _AREAS * _GROUPS, key, F.lit("ssn")), show)).otherwise(value)


def permute_ip(value: Column, key: str) -> Column:
    """A permutation of the addresses whose parts have the same lengths; a part over 255, or a leading zero, makes no address, and stays."""
    parts = F.split(value, "[.]")
    valid = ~F.exists(parts, lambda p: (p.cast("int") > 255) | ((F.length(p) > 1) & p.startswith("0")))
    by_length = lambda p, *v: F.when(F.length(p) == 1, F.lit(v[0])).when(F.length(p) == 2, F.lit(v[1])).otherwise(F.lit(v[2])).cast("long")
    count, least = ([by_length(F.element_at(parts, i), *v) for i in range(1, 5)] for v in ((10, 90, 156), (0, 10, 100)))
    digit = [F.element_at(parts, i + 1).cast("long") - least[i] for i in range(4)]
    low, high = count[2] * count[3], count[0] * count[1]
    out = feistel((digit[0] * count[1] + digit[1]) * low + digit[2] * count[3] + digit[3], low, high, key, F.concat_ws(".", F.lit("ip"), *[c.cast("string") for c in count]))
    over = lambda x, c: F.floor(x / c).cast("long")
    quad = lambda x: F.concat_ws(".", *[(d + m).cast("string") for d, m in zip((over(over(x, low), count[1]), over(x, low) % count[1], over(x % low, count[3]), x % low % count[3]), least, strict=True)])
    return F.when(valid, F.element_at(F.transform(F.array(out), quad), 1)).otherwise(value)


def _calendar(months: int, first: int, last: int, low: int, high: int) -> tuple[int, int, int, int, int, list[int]]:
    """Of the days first .. last of the first months of 1900 .. 2099: how many a year has, not counting 29 February; how many
    there are; the bases of their network, whose product is at least that; first; and each month's first place in a year."""
    sizes = [min(last, m) - first + 1 for m in _MONTHS[:months]]
    return sum(sizes), 200 * sum(sizes) + 49 * (last > 28), low, high, first, [0, *accumulate(sizes)][:-1]


#: The days that a layout can show. With parts of two digits: all. With one digit for the month, the day, or both: those
#: that need no more. In the less usual order of day and month: those of a day over 12, with two digits or one for the month.
_CALENDARS = [
    _calendar(12, 1, 31, 229, 319), _calendar(9, 1, 31, 211, 259), _calendar(12, 1, 9, 144, 150), _calendar(9, 1, 9, 120, 135), _calendar(12, 13, 31, 177, 250), _calendar(9, 13, 31, 50, 661),
]


def permute_date(value: Column, key: str) -> Column:
    """A permutation of the days from 1900 to 2099 that the value's own layout can show; what is no such day stays.

    With slashes the month comes first, with points the day; where that is no day, the other order is read, and kept."""
    parts = F.split(value, "[./-]")
    one, two, three = (F.element_at(parts, i) for i in (1, 2, 3))
    iso, slash = value.rlike("^[0-9]{4}-"), value.rlike("/")
    year = F.when(iso, one).otherwise(three)
    left, right = F.when(iso, two).otherwise(one), F.when(iso, three).otherwise(two)
    date = lambda m, d: F.try_to_timestamp(F.concat_ws("-", year, m, d), F.lit("yyyy-M-d")).cast("date")
    month_day, day_month = date(left, right), date(right, left)
    month_first = iso | F.when(slash, month_day.isNotNull()).otherwise(day_month.isNull())
    usual = iso | (slash == month_first)
    month, day = F.when(month_first, left).otherwise(right), F.when(month_first, right).otherwise(left)
    found = F.when(month_first, month_day).otherwise(day_month)
    shape = F.when(usual, 7 - 2 * F.length(day) - F.length(month)).otherwise(7 - F.length(month))

    def moved(s: Column) -> Column:
        calendar = lambda i: F.element_at(F.array(*[F.lit(c[i]).cast("long") for c in _CALENDARS]), s)
        size, days, low, high, first = (calendar(i) for i in range(5))
        starts = F.element_at(F.array(*[F.array(*[F.lit(x).cast("long") for x in c[5]]) for c in _CALENDARS]), s)
        y, m, d = (x.cast("long") for x in (year, month, day))
        leap = (m == 2) & (d == 29)
        place = F.when(s == 1, F.datediff(found, F.lit(_FIRST_DAY).cast("date")).cast("long")).when(leap, 200 * size + F.floor((y - 1904) / 4)).otherwise((y - 1900) * size + F.element_at(starts, m.cast("int")) + d - first).cast("long")
        step = lambda x: feistel(x, low, high, key, F.when(s == 1, F.lit("date")).otherwise(F.concat(F.lit("date"), s.cast("string"))))
        now = F.array(step(place))
        for _ in range(max(c[2] * c[3] - c[1] for c in _CALENDARS)):  # a place that no day has leads on to one that a day has
            now = F.transform(now, lambda x: F.when(x >= days, step(x)).otherwise(x))

        def show(x: Column) -> Column:
            rest = F.pmod(x, size)
            at = F.size(F.filter(starts, lambda b: b <= rest))
            plain = F.date_add(F.lit(_FIRST_DAY).cast("date"), x.cast("int"))
            end = x >= 200 * size
            new_y = F.when(s == 1, F.year(plain)).when(end, 1904 + 4 * (x - 200 * size)).otherwise(1900 + F.floor(x / size))
            new_m = F.when(s == 1, F.month(plain)).when(end, F.lit(2)).otherwise(at)
            new_d = F.when(s == 1, F.dayofmonth(plain)).when(end, F.lit(29)).otherwise(rest - F.element_at(starts, at) + first)
            y, m, d = new_y.cast("string"), F.lpad(new_m.cast("string"), F.length(month), "0"), F.lpad(new_d.cast("string"), F.length(day), "0")
            a, b = F.when(month_first, m).otherwise(d), F.when(month_first, d).otherwise(m)
            between = [F.regexp_extract(value, p, 1) for p in ("^[0-9]+(.)", "(.)[0-9]+$")]
            return F.when(iso, F.concat(y, between[0], m, between[1], d)).otherwise(F.concat(a, between[0], b, between[1], y))

        return F.element_at(F.transform(now, show), 1)

    return F.when(found.isNotNull() & year.between("1900", "2099"), F.element_at(F.transform(F.array(shape), moved), 1)).otherwise(value)


def permute_word(value: Column, key: str, kind: str, alphabets: list[str]) -> Column:
    """Characters are shifted inside their own alphabet by a keyed stream; those of no alphabet stay.

    A Feistel network over words: in turn, each half is shifted by a stream that depends on the key and the other half."""
    n = F.length(value)
    cut = F.ceil(n / 2).cast("int")

    def shift(part: Column, by: Column, r: int) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.lit(str(r)), n.cast("string"), by), 512)
        def moved(c: Column, i: Column) -> Column:
            by_i = F.conv(F.substr(digest, F.pmod(i * 4, F.lit(124)) + 1, F.lit(4)), 16, 10).cast("int")
            out = c
            for alphabet in alphabets:
                at = F.instr(F.lit(alphabet), c)
                out = F.when((c != "") & (at > 0), F.substr(F.lit(alphabet), F.pmod(at - 1 + by_i, F.lit(len(alphabet))) + 1, F.lit(1))).otherwise(out)
            return out

        return F.array_join(F.transform(F.split(part, ""), moved), "")

    state = F.struct(F.substr(value, F.lit(1), cut).alias("a"), F.substr(value, cut + 1, n).alias("b"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(4)),
        state,
        lambda s, r: F.when(F.pmod(r, F.lit(2)) == 1, F.struct(shift(s.getField("a"), F.concat_ws("|", r.cast("string"), s.getField("b")), 0).alias("a"), s.getField("b").alias("b"))).otherwise(
            F.struct(s.getField("a").alias("a"), shift(s.getField("b"), F.concat_ws("|", r.cast("string"), s.getField("a")), 1).alias("b"))
        ),
        lambda s: F.concat(s.getField("a"), s.getField("b")),
    )


#: Alphabets of the word permutations.
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_HEX, _HEX_UPPER = "0123456789abcdef", "0123456789ABCDEF"


def iban_rest(value: Column) -> Column:
    """The account number, moved behind by country and check digits as the standard says, modulo 97; 1 if it is valid."""
    flat = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substr(flat, F.lit(5), F.length(flat)), F.substring(flat, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda s, c: F.when(c.rlike("^[0-9]$"), F.pmod(s * 10 + c.cast("int"), F.lit(97))).when(c == "", s).otherwise(F.pmod(s * 100 + F.ascii(c) - 55, F.lit(97))))


def permute_iban(value: Column, key: str) -> Column:
    """Digits and letters after the check digits are permuted, and the check digits computed anew, whatever the spacing; an invalid one stays."""

    def moved(flat: Column) -> Column:
        country = F.substring(flat, 1, 2)
        finish = lambda b: F.concat(country, F.lpad((F.lit(98) - iban_rest(F.concat(country, F.lit("00"), b))).cast("string"), 2, "0"), b)
        return fill(value, bound(permute_word(F.substr(flat, F.lit(5), F.length(flat)), key, "iban", [_DIGITS, _UPPER]), finish), "[0-9A-Z]")

    return F.when(iban_rest(value) == 1, bound(F.regexp_replace(value, " ", ""), moved)).otherwise(value)


def permute_email(value: Column, key: str) -> Column:
    """Letters and digits of the name are permuted, as in lower case, and get the case of the places where they stand; the domain stays."""
    at = F.instr(value, "@")
    name = F.substr(value, F.lit(1), at - 1)
    new = permute_word(F.lower(name), key, "email", [_LOWER, _DIGITS])
    cased = F.zip_with(F.split(name, ""), F.split(new, ""), lambda old, c: F.when(old.rlike("^[A-Z]$"), F.upper(c)).otherwise(c))
    return F.concat(F.array_join(cased, ""), F.substr(value, at, F.length(value)))


def permute_phone(value: Column, key: str) -> Column:
    """The national number is permuted under its country's code, whatever the spacing; without a code it is one of code 1."""

    def moved(digits: Column) -> Column:
        code = F.when(value.startswith("+"), F.regexp_extract(digits, f"^(?:{_CALLING}|[0-9]{{3}})", 0)).otherwise("")
        national = F.substr(digits, F.length(code) + 1, F.length(digits))
        new = permute_digits(national, key, F.concat(F.lit("phone"), F.when(code == "", "1").otherwise(code)))
        return fill(value, F.concat(code, new))

    return bound(F.regexp_replace(value, "[^0-9]", ""), moved)


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one found value, by its kind."""
    kind = lambda k: value.rlike(f"^(?:{PATTERNS[k]})$")
    secret = lambda alphabet: permute_word(value, key, "secret", [alphabet])
    return (
        F.when(kind("email"), permute_email(value, key))
        .when(kind("secret"), F.when(value.rlike("[A-F]"), secret(_HEX_UPPER)).when(value.rlike("[a-f]"), secret(_HEX)).otherwise(secret(_DIGITS)))
        .when(kind("date"), permute_date(value, key))
        .when(kind("ip"), permute_ip(value, key))
        .when(kind("ssn"), permute_ssn(value, key))
        .when(kind("card"), permute_card(value, key))
        .when(kind("phone"), permute_phone(value, key))
        .when(kind("iban"), permute_iban(value, key))
        .otherwise(value)
    )


def pseudonymise(docs: DataFrame, *, key: str, text_col: str = "text") -> DataFrame:
    """docs with every found value in the text replaced by its pseudonym; nothing else changes, and lengths stay.

    Only found values run through the ciphers: a text is split at them, and put together again. Of overlapping patterns
    the one that starts first is taken, and among those the first in PATTERNS. Equal values give equal pseudonyms in all
    documents under one key, and so do a card's, an account's and a phone's spaced and unspaced forms, and a name in any
    case; without the key a value cannot be recovered by undoing the network. Cards stay valid by the Luhn test; an IBAN keeps
    its country and stays valid; an address's domain stays.

    Defined cases: a null text stays null and an empty one empty; strings of the right shape that are no value stay as they
    are: cards that fail the Luhn test, social security numbers that are never issued, addresses with a part over 255, days
    outside 1900 to 2099 in either order, invalid IBANs; an international phone number has 7 to 15 digits; an IBAN ends at its
    country's length, whatever follows; very long texts and words are read whole, in time linear in their length; repeated
    rows come out alike; an empty table gives an empty result; all other columns are untouched.
    """
    text = F.col(text_col)

    def replaced(found: Column) -> Column:
        new = F.transform(found, lambda v: pseudonym(v, key))
        joined = F.array_join(F.flatten(F.zip_with(F.split(text, _ANY, -1), new, lambda p, v: F.array(p, F.coalesce(v, F.lit(""))))), "")
        return F.when(F.size(found) == 0, text).otherwise(joined)

    return docs.withColumn(text_col, F.when(text.rlike(_HINT), bound(F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)), replaced)).otherwise(text))
