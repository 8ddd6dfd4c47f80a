"""Format-preserving pseudonyms for personal data; DataFrame functions only.

Every recognised value is permuted within its format by a keyed Feistel network, so equal
values get equal pseudonyms in all documents, different ones different pseudonyms, and a
number or date that passed its check passes it again.  A string is cut into two halves of
characters; a round shifts every letter and digit of one half within its class (a-z, A-Z,
0-9; a-f in hexadecimal values) by the keyed hash of the other half.  Dates and addresses
are permuted as pairs of whole numbers in the same manner.  Cards, phones and social
security numbers are permuted as bare digits, whose separators are put back, and dates as days, so that all spellings of
one value get one pseudonym.

value            check                                  permuted
payment card     13-19 digits, also grouped, Luhn       all but the last digit, which is set anew
social security  area, group and serial in use          all digits, again until valid
date             calendar date, 1900-01-01 and the      the day's number; a time after it stays
                 72,999 days after; year first, month
                 first with slashes, day first with dots
IPv4 address     four numbers up to 255                 as a 32-bit number
phone            separated groups of 3, 3 and 4         all but a country code
email            local part, labels, top level          all but the top level
secret           after token, password, secret, api     the value; AKIA stays
                 key, up to a blank, quote, bracket
                 or a sentence's end; access key ids
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8  # even, so that the halves end where they began
DAYS = (250, 292)  # the number of days is their product
FIRST_DAY = "1900-01-01"

# A name has labels of at most 63 letters and at most 126 of them before the last; the bounds
# also keep Java's recursive matching of repeated groups shallow.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,}",
    "secret": r"(?<![A-Za-z0-9])(?i:token|password|passwd|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}"
              r"[\"']?[A-Za-z0-9_/+.=~!@#$%^&*-]{7,}[A-Za-z0-9_/+=-][\"']?|(?<![A-Za-z0-9])(?i:AKIA)[0-9A-Za-z]{16}(?![A-Za-z0-9])",
    "date": r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}(?:(?=[Tt]\d{2})|(?![\w/-]))|\d{1,2}/\d{1,2}/\d{4}(?![\w/-])"
            r"|\d{4}/\d{1,2}/\d{1,2}(?![\w/-])|\d{1,2}\.\d{1,2}\.\d{4}(?![\w/-]|\.\d))",
    "ssn": r"(?<![\w-])(?:\d{3}-\d{2}-\d{4}|(?<!\d )\d{3} \d{2} \d{4}(?! \d))(?![\w-])",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)",
    "card": r"(?<!\w)(?:\d{13,19}|6\d{3}(?:[ .-]\d{4}){3}[ .-]\d{3}|\d{4}(?:[ .-]\d{4}){3}|\d{4}[ .-]\d{6}[ .-]\d{4,5}"
            r"|\d{4}(?:[ .-]\d{3}){3}|\d{4}[ .-]\d{4}[ .-]\d{5}|\d{6}[ .-]\d{13})(?!\w)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
HINT = r"[0-9@]|(?i:AKIA|token|passw|secret|api)"  # no value lacks all of these


def joined(chars: Column) -> Column:
    return F.array_join(chars, "")


def chars_of(text: Column) -> Column:
    """The characters of a string, none for an empty one."""
    return F.when(F.length(text) > 0, F.transform(
        F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))
    ).otherwise(F.array().cast("array<string>"))


def number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def shifted(char: Column, by: Column, letters: int) -> Column:
    """A character moved within its class."""
    code = F.ascii(char)

    def within(first: str, size: int) -> Column:
        return F.chr(F.lit(ord(first)) + F.pmod(code - F.lit(ord(first)) + by, F.lit(size)))

    return (F.when(code.between(48, 57), within("0", 10))
            .when(code.between(97, 96 + letters), within("a", letters))
            .when(code.between(65, 64 + letters), within("A", letters))
            .otherwise(char))


def permuted(text: Column, key: str, tweak: str, letters: int = 26) -> Column:
    """The Feistel permutation of a string among the strings of its shape."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("a"),
                     F.substring(text, half + 1, F.length(text)).alias("b"))

    def turn(halves: Column, turn_no: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), turn_no.cast("string"), halves["b"]), 512)
        moved = F.transform(chars_of(halves["a"]), lambda c, i: shifted(
            c, number(F.substring(digest, F.pmod(i, F.lit(32)) * 4 + 1, F.lit(4))), letters))
        return F.struct(halves["b"].alias("a"), joined(moved).alias("b"))

    turns = F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(turns, start, turn, lambda s: F.concat(s["a"], s["b"]))


def permuted_pair(high: Column, low: Column, sizes: tuple[int, int], key: str, tweak: str) -> Column:
    """The Feistel permutation of two whole numbers below ``sizes``, as a struct (a, b)."""
    def turn(pair: Column, turn_no: Column) -> Column:
        def by(other: Column) -> Column:
            return number(F.substring(F.sha2(F.concat_ws(
                "|", F.lit(key), F.lit(tweak), turn_no.cast("string"), other.cast("string")), 256), 1, 12))

        odd = turn_no % 2 == 1
        return F.struct(
            F.when(odd, F.pmod(pair["a"] + by(pair["b"]), F.lit(sizes[0]))).otherwise(pair["a"]).alias("a"),
            F.when(odd, pair["b"]).otherwise(F.pmod(pair["b"] + by(pair["a"]), F.lit(sizes[1]))).alias("b"))

    start = F.struct(high.cast("long").alias("a"), low.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum of a string of digits; those at reversed positions of parity ``doubled`` count twice."""
    reversed_digits = F.transform(chars_of(F.reverse(digits)), lambda c, i: F.when(
        i % 2 == doubled, F.element_at(F.array(*(F.lit(2 * d - 9 * (d > 4)) for d in range(10))),
                                       c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(reversed_digits, F.lit(0), lambda a, v: a + v)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def spread(digits: Column, form: Column) -> Column:
    """``form`` with its digits replaced by ``digits`` in order."""
    def put(state: Column, char: Column) -> Column:
        is_digit = char.between("0", "9")
        return F.struct(
            F.concat(state["done"], F.when(is_digit, F.substring(state["rest"], 1, 1)).otherwise(char)).alias("done"),
            F.when(is_digit, F.substring(state["rest"], 2, 32)).otherwise(state["rest"]).alias("rest"))

    start = F.struct(F.lit("").alias("done"), digits.alias("rest"))  # computed once
    return F.aggregate(chars_of(form), start, put, lambda s: s["done"])


def card(value: Column, key: str) -> Column:
    def passes(v: Column) -> Column:
        return luhn_sum(digits_of(v), 1) % 10 == 0

    def new(v: Column) -> Column:
        digits = digits_of(v)
        body = permuted(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
        whole = F.transform(F.array(body), lambda b: F.concat(
            b, F.pmod(-luhn_sum(b, 0), F.lit(10)).cast("string")))[0]
        return spread(whole, v)

    # Three digits behind 16 can be the end of a card of 19 or a number of their own.
    card_of_16 = F.regexp_extract(value, r"^(\d{4}(?:[ .-]\d{4}){3})[ .-]\d{3}$", 1)
    return (F.when(passes(value), new(value))
            .when((card_of_16 != "") & passes(card_of_16), F.concat(
                new(card_of_16), F.substring(value, F.length(card_of_16) + 1, F.length(value))))
            .otherwise(value))


def phone(value: Column, key: str) -> Column:
    """All but a country code: the last ten digits."""
    head = F.regexp_extract(value, r"^\+\d{1,3}(?=[ .-]?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}$)", 0)
    rest = F.substring(value, F.length(head) + 1, F.length(value))
    return F.concat(head, spread(permuted(digits_of(rest), key, "phone"), rest))


def ssn(value: Column, key: str) -> Column:
    def valid(v: Column) -> Column:
        return ~v.rlike(r"^(?:000|666|9|\d{3}00)|0000$")

    digits = digits_of(value)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(24)), permuted(digits, key, "ssn"),
                         lambda v, _: F.when(valid(v), v).otherwise(permuted(v, key, "ssn")))
    return F.when(valid(digits), spread(walked, value)).otherwise(value)


def date(value: Column, key: str) -> Column:
    def moved(form: str) -> Column:
        day = F.datediff(F.try_to_timestamp(value, F.lit(form)), F.lit(FIRST_DAY).cast("date"))
        pair = permuted_pair(F.floor(day / DAYS[1]), day % DAYS[1], DAYS, key, "date")
        new = F.date_add(F.lit(FIRST_DAY).cast("date"), (pair["a"] * DAYS[1] + pair["b"]).cast("int"))
        return F.when(day.between(0, DAYS[0] * DAYS[1] - 1), F.date_format(new, form)).otherwise(value)

    forms = {r"^\d{4}-": "yyyy-MM-dd", r"^\d{2}/\d{2}/": "MM/dd/yyyy", r"^\d{4}/\d{2}/\d{2}$": "yyyy/MM/dd",
             r"^\d{4}/": "yyyy/M/d", r"^\d{2}\.\d{2}\.": "dd.MM.yyyy", r"^\d{1,2}\.": "d.M.yyyy"}
    out = F
    for shape, form in forms.items():
        out = out.when(value.rlike(shape), moved(form))
    return out.otherwise(moved("M/d/yyyy"))


def ip(value: Column, key: str) -> Column:
    part = F.transform(F.split(value, r"\."), lambda v: v.cast("long"))
    pair = permuted_pair(part[0] * 256 + part[1], part[2] * 256 + part[3], (65536, 65536), key, "ip")
    new = F.concat_ws(".", *((f(pair[h])).cast("string") for h in "ab" for f in (
        lambda c: F.floor(c / 256), lambda c: c % 256)))
    return F.when(F.forall(part, lambda v: v < 256), new).otherwise(value)


def email(value: Column, key: str) -> Column:
    tail = F.regexp_extract(value, r"\.[A-Za-z]+$", 0)
    return F.concat(permuted(F.substring(value, F.lit(1), F.length(value) - F.length(tail)), key, "email"), tail)


def secret(value: Column, key: str) -> Column:
    """Name, quotes and AKIA stay; the bare secret is permuted, so it has one pseudonym however
    it is introduced."""
    head = F.regexp_extract(value, r"^(?:[^=:]*[=:]\s*[\"']?)?(?:(?i:AKIA)(?=[0-9A-Za-z]{16}[\"']?$))?", 0)
    tail = F.regexp_extract(value, r"[\"']?$", 0)
    bare = F.substring(value, F.length(head) + 1, F.length(value) - F.length(head) - F.length(tail))
    is_hex = bare.rlike("^[0-9a-fA-F]+$")
    new = F.when(is_hex, permuted(bare, key, "secret", 6)).otherwise(permuted(bare, key, "secret"))
    return F.concat(head, new, tail)


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of a recognised value, itself if its check fails."""
    def is_a(kind: str) -> Column:
        return value.rlike(f"^(?:{PATTERNS[kind]})$")

    return (F.when(is_a("email"), email(value, key))
            .when(is_a("secret"), secret(value, key))
            .when(is_a("date"), date(value, key))
            .when(is_a("ssn"), ssn(value, key))
            .when(is_a("ip"), ip(value, key))
            .when(is_a("phone"), phone(value, key))
            .otherwise(card(value, key)))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the personal data of ``text_col`` replaced; ``count_col``, if named,
    gets the number of values replaced.

    All other columns and rows stay as they are.  A null text stays null (count 0), an
    empty one empty.  Numbers that fail their check, and dates outside the range, stay.
    No shuffle and no Python; the work of a text is linear in its length.
    """
    values, new = "_values", "_new"
    while {values, new} & {c.lower() for c in [*docs.columns, count_col or ""]}:
        values, new = values + "_", new + "_"
    text = F.col(text_col)
    none = F.array().cast("array<string>")
    found = docs.withColumn(values, F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
                            .otherwise(none))
    found = found.withColumn(new, F.transform(values, lambda v: pseudonym(v, key)))
    if count_col:
        changed = F.filter(F.zip_with(values, new, lambda a, b: a != b), lambda c: c)
        found = found.withColumn(count_col, F.greatest(F.size(changed), F.lit(0)))
    between = F.split(text, ANY, -1)
    rebuilt = F.concat(between[0], joined(F.zip_with(
        new, F.slice(between, F.lit(2), F.size(new)), lambda n, b: F.concat(n, b))))
    out = found.withColumn(text_col, F.when(F.size(values) > 0, rebuilt).otherwise(text))
    return out.drop(values, new)
