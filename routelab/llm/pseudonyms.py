"""Format-preserving Feistel pseudonyms for validated numbers and dates, in DataFrame functions only.

One pattern finds candidates; each is permuted among the values of its format that pass the same check, so that what was valid stays
valid and what can't exist stays impossible:

- payment cards: 13 to 19 digits, whole or in the usual groups of 4-4-4-4 and 4-6-5, right Luhn digit. The digits before the last are
  permuted and the Luhn digit is made anew; separators stay. Digits of a wrong Luhn digit are no card and stay as they are.
- phone numbers (ten digits, optional +1): permuted among the numbers whose area and exchange begin with 2 to 9, others among the
  others; punctuation stays.
- social security numbers: permuted among the numbers that can be issued (area 001 to 899 but 666, group and serial not zero), those
  of an impossible area and those of a zero group or serial among their like.
- IPv4 addresses: the 32 bits are permuted.
- dates from 1900 to 2099, as yyyy-MM-dd or dd/MM/yyyy, that exist in the calendar: day numbers permuted, with cycle walking. Others
  stay as they are.
- e-mail addresses, which have no finite format: the local part, of any length, becomes letters keyed by the whole address; the domain
  stays.
- secrets of 32 or more hexadecimal digits after token, key, secret or password: keyed digits of the same length.

The permutations depend on the key and the kind of value only: equal values stay equal in all documents, and different numbers
and dates of one format stay different. Whoever knows the key can undo them: it has no default. Defined cases: null and empty texts
stay; repeated rows get the same text; every other column passes through, whatever its name; the count column replaces one of its
name. Texts of any length are read whole; every pattern takes linear time. An empty table stays
empty. The key is a literal of the plan: whoever may read plans or event logs can read it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
SECRET = r"(?<=(?i:token|key|secret|password)[ ]{0,2}[=:][ ]{0,2}[\"']{0,1})[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])"
ADDRESS = rf"(?<![0-9A-Za-z.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9A-Za-z]|\.[0-9])"
PHONE = r"(?<![0-9A-Za-z+(])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|-[0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
DATE = r"(?<![0-9A-Za-z/-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2})(?![0-9A-Za-z]|[/-][0-9])"
CARD = r"(?<![0-9A-Za-z.+-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z]|[.-][0-9])"
PATTERN = "|".join([EMAIL, SECRET, ADDRESS, PHONE, SSN, DATE, CARD])

ROUNDS = 10
FIRST_DAY, DAYS = "1900-01-01", 73049  # up to 2099-12-31
DAY_SIDES = (271, 270)  # the smallest near-square rectangle above DAYS
POWERS = [10**k for k in range(11)]


def _round_number(key: str, kind: str, at: Column, half: Column) -> Column:
    """60 keyed bits of a round."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), at, half).cast("binary"), 256), 1, 15), 16, 10).cast("bigint")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, kind: str) -> Column:
    """Permute the pair (a, b) of 0..size_a-1 and 0..size_b-1; a struct of fields a and b."""

    def step(s: Column, at: Column) -> Column:
        size = F.when(at % 2 == 0, size_a).otherwise(size_b)
        return F.struct(s["b"].alias("a"), ((s["a"] + _round_number(key, kind, at, s["b"])) % size).alias("b"))

    zero = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), zero, step)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """Permute the digit strings of one length, 2 to 20 digits."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    power = lambda k: F.element_at(F.array(*[F.lit(p).cast("bigint") for p in POWERS]), k + 1)
    out = feistel(F.substring(digits, F.lit(1), u).cast("bigint"), F.substring(digits, u + 1, n).cast("bigint"), power(u), power(n - u), key, kind)
    return F.concat(F.lpad(out["a"].cast("string"), u, "0"), F.lpad(out["b"].cast("string"), n - u, "0"))


def luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Luhn's sum; ``doubled_last`` for digits that still lack their check digit."""
    places = F.reverse(F.split(digits, ""))
    odd = 0 if doubled_last else 1

    def weigh(c: Column, k: Column) -> Column:
        d = c.cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(k % 2 == odd, twice).otherwise(d)

    return F.aggregate(F.transform(places, weigh), F.lit(0), lambda s, x: s + x)


def filled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, in order."""
    place = lambda k: F.length(digits_of(F.substring(form, F.lit(1), k)))
    char = lambda k: F.substring(form, k, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), lambda k: F.when(char(k).rlike("[0-9]"), F.substring(digits, place(k), F.lit(1))).otherwise(char(k))), "")


def card(value: Column, key: str) -> Column:
    digits = digits_of(value)
    body = permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = ((10 - luhn_sum(body, True) % 10) % 10).cast("string")
    return F.when(luhn_sum(digits, False) % 10 == 0, filled(value, F.concat(body, check))).otherwise(value)


def _digits(value: Column, width: int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def phone(value: Column, key: str) -> Column:
    """Ten digits: 800 areas and 800 exchanges can exist; of the other 360,000 beginnings 200,000 have a low area."""
    prefix = F.regexp_extract(value, r"^(\+1[ .-]?)?", 0)
    form = F.substring(value, F.length(prefix) + 1, F.length(value))
    digits = digits_of(form)
    area, exchange, line = (F.substring(digits, at, n).cast("int") for at, n in ((1, 3), (4, 3), (7, 4)))
    lines = F.lit(10_000)
    real = feistel((area - 200) * 800 + exchange - 200, line, F.lit(640_000), lines, key, "phone")
    low = feistel(F.when(area < 200, area * 1000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange), line, F.lit(360_000), lines, key, "phone-low")
    start = lambda a, e: F.concat(_digits(a, 3), _digits(e, 3))
    real_start = start(F.floor(real["a"] / 800) + 200, real["a"] % 800 + 200)
    rest = low["a"] - 200_000
    low_start = F.when(rest < 0, _digits(low["a"], 6)).otherwise(start(F.floor(rest / 200) + 200, rest % 200))
    valid = (area >= 200) & (exchange >= 200)
    return F.concat(prefix, filled(form, F.when(valid, F.concat(real_start, _digits(real["b"], 4))).otherwise(F.concat(low_start, _digits(low["b"], 4)))))


def ssn(value: Column, key: str) -> Column:
    """898 areas are issued, 102 never; of a million rests 99 groups of 9,999 serials are, 10,099 have a zero group or serial."""
    digits = digits_of(value)
    area, group, serial = (F.substring(digits, at, n).cast("int") for at, n in ((1, 3), (4, 2), (6, 4)))
    issued = (area > 0) & (area < 900) & (area != 666)
    place = area - F.when(area > 666, 2).otherwise(1)
    area_at = lambda p: _digits(p + F.when(p >= 665, 2).otherwise(1), 3)
    real = feistel(place, (group - 1) * 9_999 + serial - 1, F.lit(898), F.lit(989_901), key, "ssn")
    shown = F.concat(area_at(real["a"]), _digits(F.floor(real["b"] / 9_999) + 1, 2), _digits(real["b"] % 9_999 + 1, 4))
    zero = feistel(place, F.when(group == 0, serial).otherwise(9_999 + group), F.lit(898), F.lit(10_099), key, "ssn-zero")
    shown_zero = F.concat(area_at(zero["a"]), F.when(zero["b"] < 10_000, F.concat(F.lit("00"), _digits(zero["b"], 4))).otherwise(F.concat(_digits(zero["b"] - 9_999, 2), F.lit("0000"))))
    strange = F.when(area == 0, 0).when(area == 666, 1).otherwise(area - 898)
    never = feistel(strange, group * 10_000 + serial, F.lit(102), F.lit(1_000_000), key, "ssn-area")
    shown_never = F.concat(F.when(never["a"] == 0, "000").when(never["a"] == 1, "666").otherwise(_digits(never["a"] + 898, 3)), _digits(never["b"], 6))
    return filled(value, F.when(~issued, shown_never).when((group == 0) | (serial == 0), shown_zero).otherwise(shown))


def address(value: Column, key: str) -> Column:
    o = [F.split_part(value, F.lit("."), F.lit(k)).cast("int") for k in (1, 2, 3, 4)]
    side = F.lit(65536).cast("bigint")
    out = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], side, side, key, "address")
    return F.concat_ws(".", *[x.cast("string") for half in (out["a"], out["b"]) for x in (F.floor(half / 256), half % 256)])


def date(value: Column, key: str) -> Column:
    """Walks the cycle until the rectangle's point is a day again; at most as many steps as it has other points, plus one."""
    iso = value.rlike("^[0-9]{4}-")
    day = F.datediff(F.when(iso, F.try_to_timestamp(value, F.lit("yyyy-MM-dd"))).otherwise(F.try_to_timestamp(value, F.lit("dd/MM/yyyy"))).cast("date"), F.to_date(F.lit(FIRST_DAY)))
    rows, columns = DAY_SIDES
    spare = rows * columns - DAYS

    def walk(d: Column, _: Column) -> Column:
        out = feistel(F.floor(d["day"] / columns), d["day"] % columns, F.lit(rows), F.lit(columns), key, "date")
        moved = F.struct((out["a"] * columns + out["b"]).alias("day"), F.lit(True).alias("moved"))
        return F.when(d["moved"] & (d["day"] < DAYS), d).otherwise(moved)

    new = F.aggregate(F.sequence(F.lit(0), F.lit(spare)), F.struct(day.cast("bigint").alias("day"), F.lit(False).alias("moved")), walk)["day"]
    shown = F.date_add(F.to_date(F.lit(FIRST_DAY)), new.cast("int"))
    return F.when(day.isNull(), value).when(iso, F.date_format(shown, "yyyy-MM-dd")).otherwise(F.date_format(shown, "dd/MM/yyyy"))


def _keyed(value: Column, key: str, kind: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.lower(value)).cast("binary"), 256)


def email(value: Column, key: str) -> Column:
    local = F.substring_index(value, "@", 1)
    letters = F.translate(_keyed(value, key, "email"), "0123456789abcdef", "ghjkmnpqrstuvwxy")
    return F.concat(F.substring(letters, F.lit(1), F.greatest(F.lit(12), F.length(local))), F.lit("@"), F.substring_index(value, "@", -1))


def secret(value: Column, key: str) -> Column:
    block = lambda k: F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), k.cast("string"), F.lower(value)).cast("binary"), 256)
    digits = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(value) / 64).cast("int")), block), "")
    return F.substring(digits, F.lit(1), F.length(value))


def pseudonym(value: Column, key: str) -> Column:
    """The replacement of one candidate that PATTERN found."""
    whole = lambda pattern: value.rlike(f"^(?:{pattern})$")
    return (
        F.when(F.instr(value, "@") > 0, email(value, key))
        .when(value.rlike("^[0-9A-Fa-f]{32,}$"), secret(value, key))
        .when(whole(ADDRESS), address(value, key))
        .when(whole(DATE), date(value, key))
        .when(whole(SSN), ssn(value, key))
        .when(whole(PHONE), phone(value, key))
        .otherwise(card(value, key))
    )


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def pseudonymise(df: DataFrame, key: str, text: str = "text", count: str = "n_pseudonyms") -> DataFrame:
    """Replace ``text``; ``count`` is the number of values that changed.

    Only rows with a candidate are cut up: between candidates the text's pieces stay as they are.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))
    old, new = (fresh_name(df, name) for name in ("found", "new"))
    marked = df.withColumn(old, F.when(F.col(text).rlike("[0-9@]|(?i:token|key|secret|password)"), found))
    marked = marked.withColumn(new, F.when(F.size(old) > 0, F.transform(old, lambda v: pseudonym(v, key))))
    parts = F.split(F.col(text), PATTERN, -1)
    joined = F.array_join(F.flatten(F.zip_with(parts, new, lambda p, v: F.array(p, F.coalesce(v, F.lit(""))))), "")
    changed = F.aggregate(F.zip_with(old, new, lambda was, v: F.when(was != v, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    out = {c: F.col(c) for c in df.columns if c not in (text, count)}
    columns = [F.when(F.col(new).isNotNull(), joined).otherwise(F.col(text)).alias(c) if c == text else out[c] for c in df.columns if c != count]
    return marked.select(*columns, F.coalesce(changed, F.lit(0)).alias(count))
