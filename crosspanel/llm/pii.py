"""Personal data: format-preserving pseudonyms, in DataFrame functions only.

Mail addresses, card numbers that pass their checksum, telephone numbers, IPv4 addresses, social
security numbers, calendar dates and credentials are found in whole texts. The characters of each
are permuted within their alphabet by a keyed Feistel network, so that a value keeps its format
(a card its checksum, a date its validity) and equal values get equal pseudonyms in all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = "0123456789"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + DIGITS
MIXED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + LETTERS + DIGITS
ROUNDS = 8

MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
ACCESS_KEY = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
#: A value after the name of a credential.
SECRET = r"(?<=[=:\"' ])(?<=(?i:password|passwd|token|secret|api_key|apikey)[\"']?\s?[=:]\s?[\"']?)[A-Za-z0-9_/+-]{8,}+"
ISO_DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
DAY_DATE = r"(?<![0-9./])[0-9]{2}([./])[0-9]{2}\1[0-9]{4}(?![0-9]|[./][0-9])"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\3[0-9]{5})(?![0-9])"
#: The country calling codes of ITU E.164, those of one, two and three digits.
CALLING = (
    r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
    r"|2[1-689][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[7-9][0-9]|8[03578][0-9]|96[0-8]|97[0-79]|99[2-68])"
)
#: Numbers with a calling code, and North American ones (area and exchange from 200 on) in three groups
#: set apart by parentheses, hyphens or dots. Digits grouped in another way are no telephone numbers.
INTERNATIONAL = rf"(?<![A-Za-z0-9+])\+{CALLING}(?:[ .-]?(?:\([0-9]{{1,4}}\)|[0-9]{{1,4}})){{2,6}}+(?![0-9])"
NATIONAL = r"(?<![A-Za-z0-9(.-])(?:\([2-9][0-9]{2}\) ?[2-9][0-9]{2}-|[2-9][0-9]{2}([.-])[2-9][0-9]{2}\4)[0-9]{4}(?![0-9]|[.-][0-9])"
ANY = "|".join([MAIL, ACCESS_KEY, SECRET, ISO_DATE, DAY_DATE, IPV4, SSN, CARD, NATIONAL, INTERNATIONAL])

#: A text with neither of these holds none of the above.
HINT = r"[@0-9]|(?i:password|passwd|token|secret|api_?key)"


def feistel(value: Column, alphabet: str, key: str, tweak: Column | None = None) -> Column:
    """Permute strings over ``alphabet`` of equal length; for each ``tweak`` in another way. Other
    characters must not occur. Strings of one character are shifted by the key."""
    secret = F.lit(key + "|") if tweak is None else F.concat(F.lit(key + "|"), tweak, F.lit("|"))
    half = (F.length(value) / 2).cast("int")
    letters = F.lit(alphabet)

    def one(state: Column, i: Column) -> Column:
        code = F.sha2(F.concat(secret, i.cast("string"), F.lit("|"), F.length(state["a"]).cast("string"), F.lit("|"), state["b"]), 512)
        shifted = F.transform(
            F.split(state["a"], ""),
            lambda c, at: F.substring(letters, (F.pmod(F.instr(letters, c) - 1 + F.conv(F.substring(code, F.pmod(at, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int"), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1)),
        )
        return F.struct(state["b"].alias("a"), F.when(F.length(state["a"]) == 0, F.lit("")).otherwise(F.array_join(shifted, "")).alias("b"))

    start = F.struct(F.substring(value, F.lit(1), half).alias("a"), F.substring(value, half + 1, F.length(value)).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one, lambda s: F.concat(s["a"], s["b"]))


def only(value: Column, alphabet_class: str) -> Column:
    return F.regexp_replace(value, f"[^{alphabet_class}]", "")


def refill(shape: Column, alphabet_class: str, filling: Column) -> Column:
    """``shape`` with its characters of the class replaced, in turn, by those of ``filling``."""

    def step(state: Column, c: Column) -> Column:
        takes = c.rlike(f"^[{alphabet_class}]$")
        return F.struct(F.concat(state["out"], F.when(takes, F.substring(state["left"], F.lit(1), F.lit(1))).otherwise(c)).alias("out"), F.when(takes, F.substring(state["left"], F.lit(2), F.length(state["left"]))).otherwise(state["left"]).alias("left"))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), filling.alias("left")), step, lambda s: s["out"])


def _mail(m: Column, key: str) -> Column:
    """Letters of the local part are permuted among letters, whose case stays, and its digits among
    digits, in a way that depends on the letters. The domain stays."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    letters = F.lower(only(local, "A-Za-z"))
    digits = feistel(only(local, "0-9"), DIGITS, key + "mail digits", letters)
    lower = refill(refill(F.lower(local), "a-z", feistel(letters, LETTERS, key + "mail")), "0-9", digits)
    cased = F.zip_with(F.split(local, ""), F.split(lower, ""), lambda old, new: F.when(old.rlike("^[A-Z]$"), F.upper(new)).otherwise(new))
    return F.concat(F.array_join(cased, ""), F.lit("@"), domain)


def luhn_digit(payload: Column) -> Column:
    """The check digit that makes a card number of ``payload`` valid."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(payload, i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((F.length(payload) - i) % 2 == 0, doubled).otherwise(d)

    return F.pmod(10 - F.aggregate(F.sequence(F.lit(1), F.length(payload)), F.lit(0), add) % 10, F.lit(10)).cast("string")


def _card(m: Column, key: str) -> Column:
    digits = only(m, "0-9")
    payload = F.substring(digits, F.lit(1), F.length(digits) - 1)
    new = feistel(payload, DIGITS, key + "card")
    filled = F.aggregate(F.array(new), F.lit(""), lambda _, p: F.concat(p, luhn_digit(p)))  # new is computed once
    return F.when(luhn_digit(payload) == F.substring(digits, F.length(digits), F.lit(1)), refill(m, "0-9", filled)).otherwise(m)


def permuted(numbers: Column, sizes: Column, key: str) -> Column:
    """Permute tuples of whole numbers from 0 to below their ``sizes``: in turn each is shifted, modulo
    its size, by a keyed digest of the others."""

    def step(state: Column, i: Column) -> Column:
        at = F.pmod(i, F.size(state))
        others = F.array_join(F.transform(state, lambda x, j: F.when(j == at, F.lit("")).otherwise(x.cast("string"))), ",")
        code = F.conv(F.substring(F.sha2(F.concat(F.lit(key + "|"), i.cast("string"), F.lit("|"), others), 256), 1, 12), 16, 10).cast("bigint")
        return F.transform(state, lambda x, j: F.when(j == at, F.pmod(x + code, F.element_at(sizes, j + 1))).otherwise(x))

    return F.aggregate(F.sequence(F.lit(0), 3 * F.size(sizes) - 1), numbers.cast("array<bigint>"), step)


def _phone(m: Column, key: str) -> Column:
    """The calling code stays. Ten digits of North America keep what area and exchange they may have:
    those from 200 on stay so."""
    digits = only(m, "0-9")
    code = F.regexp_extract(m, rf"^\+({CALLING})", 1)
    national = F.substring(digits, F.length(code) + 1, F.length(digits))
    groups = F.array(*[F.substring(national, a, n).cast("bigint") for a, n in ((1, 3), (4, 3), (7, 4))])
    least = F.transform(groups, lambda g, i: F.when((i < 2) & (g >= 200), 200).otherwise(0).cast("bigint"))
    sizes = F.transform(least, lambda low, i: F.when(i == 2, 10_000).when(low == 200, 800).otherwise(200).cast("bigint"))
    moved = F.zip_with(permuted(F.zip_with(groups, least, lambda g, low: g - low), sizes, key + "phone"), least, lambda g, low: (g + low).cast("string"))
    american = F.array_join(F.transform(moved, lambda g, i: F.lpad(g, F.when(i == 2, 4).otherwise(3), F.lit("0"))), "")
    new = F.when(code.isin("", "1"), american).otherwise(feistel(national, DIGITS, key + "phone", code))
    return refill(m, "0-9", F.concat(code, new))


def is_phone(m: Column, digits: Column) -> Column:
    """A match of the telephone patterns that has as many ``digits`` as its calling code wants."""
    return m.rlike(r"^[+(2-9]") & F.when(m.startswith("+1"), digits == 11).when(m.startswith("+"), (digits >= 8) & (digits <= 15)).otherwise(digits == 10)


def _date(m: Column, pattern: Column, key: str) -> Column:
    """Days are permuted within their 100,000 days (counted from 1900-01-01)."""
    day = F.datediff(F.try_to_timestamp(m, pattern).cast("date"), F.lit("1900-01-01").cast("date"))
    block = F.floor(day / 100_000) * 100_000
    new = feistel(F.lpad((day - block).cast("string"), 5, "0"), DIGITS, key + "date").cast("int")
    made = F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), (block + new).cast("int")), "yyyy-MM-dd")
    iso = F.when((block >= -600_000) & (block < 2_900_000), made)
    year, month, of_month = F.substring(iso, 1, 4), F.substring(iso, 6, 2), F.substring(iso, 9, 2)
    mark = F.substring(m, 3, 1)
    return F.coalesce(F.when(m.rlike("^[0-9]{4}-"), iso).when(pattern.startswith("dd"), F.concat(of_month, mark, month, mark, year)).otherwise(F.concat(month, mark, of_month, mark, year)), m)


def _dates(m: Column, key: str) -> Column:
    mark = F.substring(m, 3, 1)
    day_first, month_first = F.concat(F.lit("dd"), mark, F.lit("MM"), mark, F.lit("yyyy")), F.concat(F.lit("MM"), mark, F.lit("dd"), mark, F.lit("yyyy"))
    pattern = F.when(m.rlike("^[0-9]{4}-"), F.lit("yyyy-MM-dd")).when(F.try_to_timestamp(m, day_first).isNotNull(), day_first).otherwise(month_first)
    return _date(m, pattern, key)


def _ipv4(m: Column, key: str) -> Column:
    """Addresses are permuted as eight hex digits; numbers over 255 are no address."""
    parts = F.split(m, r"\.")
    code = F.array_join(F.transform(parts, lambda p: F.lpad(F.conv(p, 10, 16), 2, "0")), "")
    new = F.upper(feistel(F.lower(code), "0123456789abcdef", key + "ipv4"))
    dotted = F.aggregate(F.array(new), F.lit(""), lambda _, h: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10)), "."))
    return F.when(F.forall(parts, lambda p: p.cast("int") <= 255), dotted).otherwise(m)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match of :data:`ANY`; itself if it turns out to be no valid value."""
    n = F.length(only(m, "0-9"))
    return (
        F.when(m.contains("@"), _mail(m, key))
        .when(m.rlike("^(AKIA|ASIA)[A-Z0-9]{16}$"), F.concat(F.substring(m, 1, 4), feistel(F.substring(m, 5, 16), UPPER, key + "access")))
        .when(m.rlike("^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./])[0-9]{2}\\2[0-9]{4})$"), _dates(m, key))
        .when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), _ipv4(m, key))
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), refill(m, "0-9", feistel(only(m, "0-9"), DIGITS, key + "ssn")))
        .when(m.rlike(r"^[0-9](?:[ -]?[0-9]){12,18}$"), _card(m, key))
        .when(m.rlike(r"^[+0-9(][0-9 ().-]+$") & is_phone(m, n), _phone(m, key))
        .when(m.rlike("[A-Za-z_/]") & ~m.rlike("^[+(]"), refill(m, "A-Za-z0-9", feistel(only(m, "A-Za-z0-9"), MIXED, key + "secret")))
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text", counted: str | None = "n_pseudonyms") -> DataFrame:
    """``docs`` with pseudonyms under a secret ``key`` in its text column, and a last column
    ``counted`` (spans replaced), if it is to have one.

    Null texts stay null with 0; empty texts and texts without personal data stay as they are;
    repeated rows stay repeated; every other column is kept, whatever its name, but one named as
    ``counted``, which is replaced. An empty table gives an empty table. Texts are read whole. An empty
    key is an error.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    found = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    empty = F.array().cast("array<string>")
    # the row is one column beside the work, so that no name of its columns can clash
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != counted]).alias("row"), F.col(f"`{text}`").alias("text"))
    out = out.withColumn("spans", F.when(F.col("text").rlike(HINT), found).otherwise(empty))
    out = out.withColumn("spans", F.transform("spans", lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new"))))
    # texts without a match are passed on; the others are cut at the matches and joined again
    parts = F.zip_with(F.split("text", ANY, -1), "spans", lambda a, b: F.concat(a, F.coalesce(b["new"], F.lit(""))))
    changed = F.size(F.filter("spans", lambda x: x["old"] != x["new"]))
    new = F.when(F.size("spans") > 0, F.array_join(parts, "")).otherwise(F.col("text"))
    columns = [new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns if c != counted]
    return out.select(*columns, *([F.coalesce(changed, F.lit(0)).cast("bigint").alias(counted)] if counted else []))
