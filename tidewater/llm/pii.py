"""Format-preserving pseudonyms for personal data.

Numbers and dates are found by pattern, validated (Luhn digit, IBAN check digits, octet ranges, calendar, number
plans) and replaced by the output of a keyed Feistel network over their own format: a valid card number becomes
another valid card number, a date another date. The permutation depends on nothing but key and value, so
equal values stay linked across documents and different values of one format stay different. E-mail names and
secrets are permuted character by character within their character classes, over their whole length; what
follows a secret's mark is a secret, whatever else it looks like.

Everything is a DataFrame expression: one scan, no shuffle, no Python on executors.
"""

from __future__ import annotations

from calendar import monthrange

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import fresh

ROUNDS = 10

#: What each kind looks like. Order matters: the first that matches wins.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?<=(?i:password|passwd|secret|token|api_key)(?:=|: | = ?| = ?\"|=\"))(?:[A-Za-z0-9_+/-]|\.(?=[A-Za-z0-9_+/-])){8,}+",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w/-]|\.\d)",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])|(?<![\w.,:/+-]|\d )\d{3} \d{2} \d{4}(?![\w-]| \d|[.,]\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?!\w|[.-]\d)|(?<![\w.,:/+=#-]|\d )[2-9]\d{2}[2-9]\d{6}(?!\w|[.,:/-]\w| \d)",
    "card": r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?!\w|[.-]\d)",
}
#: Group 1 takes part in a match where a secret was found.
PATTERN = "|".join(f"({x})" if kind == "secret" else x for kind, x in KINDS.items())

#: A text without any of these has nothing to find, and without the latter no secret.
MARKS = r"AKIA|(?i:password|passwd|secret|token|api_key)"
HINT = r"[0-9@]|" + MARKS

#: 1900-01-01 to 2099-12-31 are 17 * 4297 days; 7 * 7 of them are leap days.
FIRST_DAY, DAY_PARTS = "1900-01-01", (17, 4297)

#: Days of a common year that are read month first only, as they are spelled.
LATE_DAYS = [f"{m:02}/{d:02}" for m in range(1, 13) for d in range(13, monthrange(1900 + 1, m)[1] + 1)]


def let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _number(key: str, salt: str, i: Column, other: Column) -> Column:
    """48-bit keyed round function of a number."""
    said = F.concat(F.lit(f"{key}|{salt}|"), i.cast("string"), F.lit("|"), other.cast("string"))
    return F.conv(F.substring(F.sha2(said, 256), 1, 12), 16, 10).cast("bigint")


def feistel_pair(a: Column, b: Column, size_a: int, size_b: int, key: str, salt: str) -> Column:
    """Keyed permutation of pairs (a, b) with 0 <= a < size_a, 0 <= b < size_b; a struct of both."""
    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        left = F.when(even, (s["a"] + _number(key, salt, i, s["b"])) % size_a).otherwise(s["a"])
        right = F.when(even, s["b"]).otherwise((s["b"] + _number(key, salt, i, s["a"])) % size_b)
        return F.struct(left.alias("a"), right.alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _shift(text: Column, stream: Column) -> Column:
    """Move each digit, capital and small letter within its class by a byte of the stream (hex)."""

    def moved(c: Column, i: Column, hexes: Column) -> Column:
        code = F.ascii(c)
        k = F.conv(F.substring(hexes, 1 + 2 * (i % 64), F.lit(2)), 16, 10).cast("int")
        around = lambda low, n: F.char(low + (code - low + k) % n)
        return (
            F.when((code >= 48) & (code <= 57), around(48, 10)).when((code >= 97) & (code <= 122), around(97, 26))
            .when((code >= 65) & (code <= 90), around(65, 26)).otherwise(c)
        )

    both = F.struct(F.split(text, "").alias("x"), stream.alias("h"))
    chars = let(both, lambda v: F.transform(v["x"], lambda c, i: moved(c, i, v["h"])))
    return F.when(F.length(text) > 0, F.array_join(chars, "")).otherwise(text)


def feistel_text(text: Column, key: str, salt: str) -> Column:
    """Keyed permutation of strings of one pattern of digits, capitals and small letters."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, F.length(text)).alias("b"))
    stream = lambda i, other: F.sha2(F.concat(F.lit(f"{key}|{salt}|"), i.cast("string"), F.lit("|"), other), 512)

    def turn(s: Column, i: Column) -> Column:
        left = F.struct(_shift(s["a"], stream(i, s["b"])).alias("a"), s["b"].alias("b"))
        right = F.struct(s["a"].alias("a"), _shift(s["b"], stream(i, s["a"])).alias("b"))
        return F.when(i % 2 == 0, left).otherwise(right)

    return let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn), lambda end: F.concat(end["a"], end["b"]))


def luhn_sum(digits: Column, doubled_first: bool) -> Column:
    """Luhn sum from the right; every second digit is doubled, from the first or from the second on."""

    def part(back: Column, i: Column) -> Column:
        d = F.substring(back, i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == (0 if doubled_first else 1), twice).otherwise(d)

    parts = let(F.reverse(digits), lambda back: F.transform(F.sequence(F.lit(0), F.length(back) - 1), lambda i: part(back, i)))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x)


def _refill(shape: Column, filling: Column, slots: str) -> Column:
    """Put the characters of ``filling`` in the slots (a character class) of ``shape``, in order."""

    tagged = F.transform(F.split(shape, ""), lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    slot = lambda x: x["c"].rlike(f"[{slots}]")

    def filled(v: Column) -> Column:
        new = F.transform(F.filter(v["s"], slot), lambda x, k: F.struct(x["i"].alias("i"), F.get(v["f"], k).alias("c")))
        return F.transform(F.sort_array(F.concat(new, F.filter(v["s"], lambda x: ~slot(x)))), lambda x: x["c"])

    chars = let(F.struct(tagged.alias("s"), F.split(filling, "").alias("f")), filled)
    return F.when(F.length(shape) > 0, F.array_join(chars, "")).otherwise(shape)


def _card(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    body = F.substring(digits, F.lit(2), F.length(digits) - 2)
    front = F.concat(F.substring(digits, 1, 1), feistel_text(body, key, "card"))
    full = let(front, lambda f: F.concat(f, ((10 - luhn_sum(f, True) % 10) % 10).cast("string")))
    return F.when(luhn_sum(digits, False) % 10 == 0, _refill(m, full, "0-9")).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    def new(o: Column) -> Column:
        octet = lambda k: F.get(o, F.lit(k))
        return feistel_pair(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), 65536, 65536, key, "ip")

    def show(q: Column) -> Column:
        return F.concat_ws(".", *[x.cast("bigint").cast("string") for x in (F.floor(q["a"] / 256), q["a"] % 256, F.floor(q["b"] / 256), q["b"] % 256)])

    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    return F.when(F.forall(octets, lambda x: x <= 255), let(let(octets, new), show)).otherwise(m)


def _date(m: Column, key: str) -> Column:
    """ISO dates, and day-first dates with slashes or dots: one permutation of the calendar. Slashed spellings that are a
    date month first only are permuted among themselves, so that no two spellings meet."""
    out = _late_date(m, key)
    shapes = {"dd.MM.yyyy": r"^\d\d\.", "dd/MM/yyyy": r"^\d\d/", "yyyy-MM-dd": r"^\d{4}-"}
    for pattern, shape in shapes.items():
        day = F.datediff(F.try_to_date(m, pattern), F.lit(FIRST_DAY).cast("date"))
        ok = m.rlike(shape) & (day >= 0) & (day < DAY_PARTS[0] * DAY_PARTS[1])
        p = feistel_pair(F.floor(day / DAY_PARTS[1]), day % DAY_PARTS[1], *DAY_PARTS, key, "date")
        new = let(p, lambda q: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (q["a"] * DAY_PARTS[1] + q["b"]).cast("int")), pattern))  # noqa: B023
        out = F.when(ok, new).otherwise(out)
    return out


def _late_date(m: Column, key: str) -> Column:
    """Month-first dates whose day is no month: common ones by (year, day), leap days among leap days."""
    days = F.array(*[F.lit(d) for d in LATE_DAYS])
    year, spelled = F.try_element_at(F.split(m, "/"), F.lit(3)).try_cast("int"), F.substring(m, 1, 5)
    ok = m.rlike(r"^\d\d/\d\d/\d{4}$") & year.between(1900, 2099) & F.try_to_date(m, "MM/dd/yyyy").isNotNull()
    common = feistel_pair(year - 1900, F.array_position(days, spelled) - 1, 200, len(LATE_DAYS), key, "late")
    made = let(common, lambda q: F.concat(F.get(days, q["b"].cast("int")), F.lit("/"), (q["a"] + 1900).cast("string")))
    leap = feistel_pair(F.floor((year - 1904) / 28), F.floor((year - 1904) / 4) % 7, 7, 7, key, "leap")
    leaped = let(leap, lambda q: F.concat(F.lit("02/29/"), (1904 + 28 * q["a"] + 4 * q["b"]).cast("string")))
    return F.when(ok & (spelled == "02/29"), leaped).when(ok & F.array_contains(days, spelled), made).otherwise(m)


def _iban_rest(text: Column) -> Column:
    """The number that letters (A is 10) and digits spell, modulo 97."""
    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban(m: Column, key: str) -> Column:
    """Country and shape stay, the account is permuted, and the check digits follow."""
    def new(v: Column) -> Column:
        account, country = F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 2)
        check = F.substring(v, 3, 2).cast("int")
        ok = (_iban_rest(F.concat(account, F.substring(v, 1, 4))) == 1) & check.between(2, 98)
        made = let(feistel_text(account, key, "iban"), lambda x: F.concat(country, F.lpad((98 - _iban_rest(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0"), x))
        return F.when(ok, _refill(m, made, "A-Z0-9")).otherwise(m)

    return let(F.regexp_replace(m, " ", ""), new)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.get(F.split(m, "[- ]"), F.lit(k)).try_cast("int") for k in range(3))
    ok = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    p = feistel_pair(index * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")

    def show(q: Column) -> Column:
        a = F.floor(q["a"] / 99)
        area_of = F.when(a >= 665, a + 2).otherwise(a + 1)
        return F.concat(F.lpad(area_of.cast("string"), 3, "0"), F.lpad((q["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((q["b"] + 1).cast("string"), 4, "0"))

    return F.when(ok, let(let(p, show), lambda x: _refill(m, x, "0-9"))).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    """Country code stays. Ten-digit national numbers keep area and exchange codes from 2 to 9 hundred."""
    code = F.when(m.startswith("+1") & F.length(F.regexp_replace(m, "[^0-9]", "")).isin(11), F.lit("+1")).otherwise(F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])|^\+\d\d", 0))
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    digits = F.regexp_replace(rest, "[^0-9]", "")
    n = F.concat(F.substring(digits, 1, 1), F.substring(digits, 4, 1)).cast("int")
    in_plan = (F.length(digits) == 10) & (code.isin("", "+1")) & digits.rlike("^[2-9]..[2-9]")
    line = F.concat(F.substring(digits, 2, 2), F.substring(digits, 5, 6)).cast("bigint")
    codes = (F.floor(n / 10) - 2) * 8 + n % 10 - 2
    p = feistel_pair(codes, line, 64, 10**8, key, "phone")

    def show(q: Column) -> Column:
        eight = F.lpad(q["b"].cast("string"), 8, "0")
        return F.concat((F.floor(q["a"] / 8) + 2).cast("string"), F.substring(eight, 1, 2), (q["a"] % 8 + 2).cast("string"), F.substring(eight, 3, 6))

    planned = let(p, show)
    new = F.when(in_plan, planned).otherwise(feistel_text(digits, key, "phone"))
    return F.concat(code, _refill(rest, new, "0-9"))


def _email(m: Column, key: str) -> Column:
    name = F.substring_index(m, "@", 1)
    slots = F.regexp_replace(name, "[^A-Za-z0-9]", "")
    return F.concat(_refill(name, feistel_text(slots, key, "email"), "A-Za-z0-9"), F.substring(m, F.length(name) + 1, F.length(m)))


def _secret(m: Column, key: str) -> Column:
    head = F.when(m.rlike("^AKIA"), F.lit("AKIA")).otherwise(F.lit(""))
    rest = F.substring(m, F.length(head) + 1, F.length(m))
    slots = F.regexp_replace(rest, "[^A-Za-z0-9]", "")
    return F.concat(head, _refill(rest, feistel_text(slots, key, "secret"), "A-Za-z0-9"))


def pseudonym(m: Column, secret: Column, key: str) -> Column:
    """Pseudonym of one matched value, or the value itself where it is not valid. ``secret``: it was found as one."""
    whole = lambda kind: m.rlike(f"^(?:{KINDS[kind]})$")
    return (
        F.when(secret, _secret(m, key)).when(m.contains("@"), _email(m, key)).when(whole("iban"), _iban(m, key)).when(whole("date"), _date(m, key))
        .when(whole("ip"), _ip(m, key)).when(whole("ssn"), _ssn(m, key)).when(whole("phone"), _phone(m, key)).otherwise(_card(m, key))
    )


def pseudonymise(df: DataFrame, *, key: str, text: str = "text", found: str = "n_found", replaced: str = "n_replaced") -> DataFrame:
    """Replace personal data in ``text``; append how many values were found and how many replaced.

    Whoever holds ``key`` can tell which pseudonym belongs to a value: it is the caller's to keep.
    Invalid look-alikes (a card number with a wrong check digit, 2023-02-31) stay as they are, but not where they
    are secrets. Null texts stay null with counts 0, empty ones empty; texts without a digit, an at sign or a secret's
    mark pass unread; very long texts are one row like any other. Rows are kept one to one, repeated ones alike;
    columns named like the counts are replaced, all others stay, whatever their names. Slashed dates are read day
    first, month first only where that is no date. An empty table gives an empty result.
    """
    old, new, gaps = (fresh(df, n) for n in ("pii_old", "pii_new", "pii_gaps"))
    hit = F.coalesce(F.col(text).rlike(HINT), F.lit(False))
    none = F.array().cast("array<struct<m:string,s:boolean>>")
    values = F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))
    told = F.when(F.col(text).rlike(MARKS), F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(1)))
    matches = let(F.struct(values.alias("v"), told.alias("t")), lambda b: F.transform(b["v"], lambda m, k: F.struct(m.alias("m"), F.coalesce(F.get(b["t"], k) != "", F.lit(False)).alias("s"))))
    out = df.withColumn(old, F.when(hit, matches).otherwise(none))
    some = F.size(F.col(old)) > 0
    out = out.withColumns({
        new: F.when(some, F.transform(F.col(old), lambda x: pseudonym(x["m"], x["s"], key))).otherwise(F.array().cast("array<string>")),
        gaps: F.when(some, F.split(F.col(text), PATTERN, -1)).otherwise(F.array().cast("array<string>")),
    })
    n, g = F.col(new), F.col(gaps)
    pieces = F.transform(g, lambda x, k: F.concat(x, F.coalesce(F.get(n, k), F.lit(""))))
    changed = F.zip_with(F.col(old), n, lambda a, b: (a["m"] != b).cast("int"))
    out = out.withColumns({
        text: F.when(some, F.array_join(pieces, "")).otherwise(F.col(text)),
        found: F.size(F.col(old)).cast("bigint"),
        replaced: F.aggregate(changed, F.lit(0).cast("bigint"), lambda a, x: a + x),
    })
    return out.drop(old, new, gaps)
