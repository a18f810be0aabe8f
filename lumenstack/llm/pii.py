"""Format-preserving pseudonyms for personal data, in Spark expressions only.

A match is validated (check digits, octets, calendar) and then permuted by a keyed Feistel network within its own format:
the string is cut in halves, and each character is moved inside its alphabet by a keystream hashed from the other half.
The map is a bijection for a key, so equal values stay equal in every document and can be turned back with the key.

    email     local part and domain but for the last label; case is kept
    ipv4      32 bits as two 16-bit halves
    ipv6      the hexadecimal digits of its groups; colons stay
    card      13 to 19 digits that pass the Luhn check, with any separators; the new check digit is right
    phone     digits after the country code, with any separators; ten digits as (ddd) ddd-dddd, ddd-ddd-dddd or ddd.ddd.dddd
    iban      country kept, account permuted, check digits right
    ssn       as 9 digits, walked until the area, group and serial are valid
    date      days from 1900 to 2099 as a number, walked until within the range; yyyy-mm-dd, yyyy/mm/dd, mm/dd/yyyy (dd/mm/yyyy
              where only that is a day), dd.mm.yyyy, and with English months as March 3, 1985 and 3 March 1985
    secret    hexadecimal strings of 32 or more digits, and quoted values of token, secret, password and key
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import let, table

ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
HEX = ("0123456789abcdef", "0123456789ABCDEF")

#: Repeated groups are bounded and runs of characters possessive in all patterns: a matcher takes the former by recursion.  A
#: host has at most 127 labels.
EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@(?:[A-Za-z0-9\-]++\.){1,126}[A-Za-z]{2,}+"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\d|\.\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IPV6 = r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=(?:[0-9A-Fa-f]{0,4}:){3}|[0-9A-Fa-f]{4}::)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Za-z:]|\.\d)"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
YEAR, MONTH, DAY = r"(?:19|20)\d{2}", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
#: Forms of a date: what it looks like, how it is read and written, and which days of the month it has to itself.  The first
#: that reads a match is used, and its pseudonym is a date that the same form reads.
DATE_FORMS = [
    (rf"{YEAR}-{MONTH}-{DAY}", "yyyy-MM-dd", (1, 31)), (rf"{YEAR}/{MONTH}/{DAY}", "yyyy/MM/dd", (1, 31)), (rf"{MONTH}/{DAY}/{YEAR}", "MM/dd/yyyy", (1, 31)), (rf"{DAY}/{MONTH}/{YEAR}", "dd/MM/yyyy", (13, 31)),
    (rf"{DAY}\.{MONTH}\.{YEAR}", "dd.MM.yyyy", (1, 31)), (rf"(?:{MONTHS}) (?:[1-9]|[12]\d|3[01]), {YEAR}", "MMMM d, yyyy", (1, 31)), (rf"(?:{MONTHS}) 0[1-9], {YEAR}", "MMMM dd, yyyy", (1, 9)),
    (rf"(?:[1-9]|[12]\d|3[01]) (?:{MONTHS}) {YEAR}", "d MMMM yyyy", (1, 31)), (rf"0[1-9] (?:{MONTHS}) {YEAR}", "dd MMMM yyyy", (1, 9)),
]
DATE = rf"(?<![\p{{L}}\d\-/.])(?:{'|'.join(p for p, _, _ in DATE_FORMS)})(?![\d\-/]|\.\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
NATIONAL = r"(?<![\d\-+(.])(?:\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?!\d|[\-.]\d)"
PHONE = rf"\+\d{{1,3}}[ .\-]?\(?\d{{2,4}}\)?(?:[ .\-]?\d{{2,4}}){{2,3}}(?!\d)|{NATIONAL}"
#: Four groups of four first, so that an expiry date or code after them is not taken for more of the number.
CARD = r"(?<![\d.])(?:(?:\d{4} ){3}\d{4}|(?:\d{4}-){3}\d{4}|\d(?:[ \-]?\d){12,18})(?!\d)"
HEXKEY = r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,}+(?![A-Za-z0-9])"
NAME = r"(?i:token|secret|password|passwd|api_?key|key) ?[=:] ?[\"']"
NAMED = rf"(?<![\p{{L}}\p{{N}}_]){NAME}[^\s\"']{{8,}}(?=[\"'])"
#: In this order at one place; a match that fails its validation is left as it is.
KINDS = {"email": EMAIL, "secret": f"{NAMED}|{HEXKEY}", "ipv4": IPV4, "ipv6": IPV6, "date": DATE, "ssn": SSN, "iban": IBAN, "phone": PHONE, "card": CARD}
ANY = "|".join(KINDS.values())
#: No match lacks all of these, so that a text without them is passed on after one quick look: all kinds but secrets and IPv6
#: have a digit or @, IPv6 has two colons or a digit group between colons, named secrets end their name so, and a hexadecimal
#: key without digits is 32 letters.
HINT = r"[0-9@]|(?i:token|secret|passw(?:or)?d|key) ?[=:]|[A-Fa-f]{32}|:[A-Fa-f]{0,4}:"


def _shift(x: Column, key: str, tweak: Column, other: Column, sign: int, alphabets: tuple[str, ...]) -> Column:
    """Each character of `x` moved within its alphabet by a keystream of `other`; characters of no alphabet stay.

    `other` is hashed once; a block of the keystream, hashed from that digest and its number, moves 16 characters.
    """

    def move(block: Column, c: Column, i: Column) -> Column:
        step = F.conv(F.substring(block, i * 4 + 1, F.lit(4)), 16, 10).cast("int")
        out = None
        for a in alphabets:
            at = F.instr(F.lit(a), c)
            to = F.substring(F.lit(a), F.pmod(at - 1 + sign * step, F.lit(len(a))) + 1, F.lit(1))
            out = F.when(at > 0, to) if out is None else out.when(at > 0, to)
        return out.otherwise(c)

    def moved(seed: Column) -> Column:
        parts = F.filter(F.split(x, "(?<=\\G(?s:.{16}))", -1), lambda p: p != "")
        return F.array_join(F.transform(parts, lambda p, k: let(F.sha2(F.concat_ws("|", seed, k.cast("string")), 256), lambda b: F.array_join(F.transform(F.split(p, "", -1), lambda c, i: move(b, c, i)), ""))), "")

    return F.when(F.length(x) > 0, let(F.sha2(F.concat_ws("|", F.lit(key), tweak, other), 256), moved)).otherwise(x)


def feistel(x: Column, key: str, kind: str, rounds: int = 4, inverse: bool = False, alphabets: tuple[str, ...] = ALPHABETS) -> Column:
    """The permutation of strings of one format; each of `rounds` changes the left half by the right, then the right by the left."""
    sign = -1 if inverse else 1
    half = lambda v: F.floor(F.length(v) / 2).cast("int")

    def step(acc: Column, r: Column) -> Column:
        tag = lambda side: F.concat(F.lit(f"{kind}{side}"), r.cast("string"))
        if inverse:
            return let(_shift(acc["b"], key, tag("b"), acc["a"], sign, alphabets), lambda b: F.struct(_shift(acc["a"], key, tag("a"), b, sign, alphabets).alias("a"), b.alias("b")))
        return let(_shift(acc["a"], key, tag("a"), acc["b"], sign, alphabets), lambda a: F.struct(a.alias("a"), _shift(acc["b"], key, tag("b"), a, sign, alphabets).alias("b")))

    order = F.sequence(F.lit(rounds), F.lit(1), F.lit(-1)) if inverse else F.sequence(F.lit(1), F.lit(rounds))
    return let(x, lambda v: F.aggregate(order, F.struct(F.substring(v, F.lit(1), half(v)).alias("a"), F.substring(v, half(v) + 1, F.length(v)).alias("b")), step, lambda s: F.concat(s["a"], s["b"])))


def _number_feistel(n: Column, key: str, kind: str, bits: int, inverse: bool = False, rounds: int = 6) -> Column:
    """The same for numbers of 2 * bits bits."""
    mask = F.lit((1 << bits) - 1)
    f = lambda side, r, v: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(f"{key}|{kind}{side}"), r.cast("string"), v.cast("string")), 256), 1, 12), 16, 10).cast("long").bitwiseAND(mask)

    def step(acc: Column, r: Column) -> Column:
        if inverse:
            return let(acc["b"].bitwiseXOR(f("b", r, acc["a"])), lambda b: F.struct(acc["a"].bitwiseXOR(f("a", r, b)).alias("a"), b.alias("b")))
        return let(acc["a"].bitwiseXOR(f("a", r, acc["b"])), lambda a: F.struct(a.alias("a"), acc["b"].bitwiseXOR(f("b", r, a)).alias("b")))

    order = F.sequence(F.lit(rounds), F.lit(1), F.lit(-1)) if inverse else F.sequence(F.lit(1), F.lit(rounds))
    return F.aggregate(order, F.struct(F.shiftright(n, bits).alias("a"), n.bitwiseAND(mask).alias("b")), step, lambda s: F.shiftleft(s["a"], bits) + s["b"])


def _walk(first: Column, again, good, most: int) -> Column:
    """`first`, then `again` of it, until `good`: cycle walking, `most` steps at most.

    The walk ends with the value itself if no step is good, which needs `most` bad steps in a row.
    """
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), first, lambda v, _: F.when(good(v), v).otherwise(again(v)))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def relay(form: Column, chars: Column, kind: str) -> Column:
    """`form` with its characters of the class `kind` replaced, in order, by `chars`."""
    put = lambda a, c: F.when(c.rlike(kind), F.struct(F.concat(a["o"], F.substring(chars, a["k"], F.lit(1))).alias("o"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["o"], c).alias("o"), a["k"].alias("k")))
    return F.aggregate(F.split(form, "", -1), F.struct(F.lit("").alias("o"), F.lit(1).alias("k")), put, lambda a: a["o"])


def luhn_sum(d: Column) -> Column:
    """The Luhn sum of a digit string whose last digit counts once."""
    value = lambda c, i: let(c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v))
    return F.aggregate(F.transform(F.split(F.reverse(d), "", -1), value), F.lit(0), lambda a, v: a + v)


def mod97(x: Column) -> Column:
    """The remainder by 97 of a string of digits and capitals, a capital counting 10 to 35."""
    step = lambda a, v: F.when(v < 10, a * 10 + v).otherwise(a * 100 + v) % 97
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(F.split(x, "", -1), value), F.lit(0), step)


def _read_date(m: Column, pattern: str, form: str, days: tuple[int, int]) -> Column:
    day = F.try_to_date(m, form)
    return F.when(m.rlike(f"^(?:{pattern})$") & F.dayofmonth(day).between(*days), day)


def kind_of(m: Column) -> Column:
    """The kind of a match that passes its validation; null if it fails."""
    d = digits(m)
    out = F.when(m.rlike(rf"^(?:{NAME}|{HEXKEY}$)"), "secret").when(m.contains("@"), "email").when(m.rlike(rf"^(?:{IPV4})$"), "ipv4")
    out = out.when(m.rlike(rf"^(?:{IPV6})$"), "ipv6")
    out = out.when(m.rlike(rf"^(?:{DATE})$"), F.when(F.coalesce(*[_read_date(m, *f) for f in DATE_FORMS]).isNotNull(), "date"))
    out = out.when(m.rlike(rf"^(?:{SSN})$"), F.when(~m.rlike(r"^(?:000|666|9)|-00-|-0000$"), "ssn"))
    out = out.when(m.rlike(rf"^(?:{NATIONAL})$"), F.when(d.rlike(r"^[2-9]..[2-9]"), "phone"))
    out = out.when(m.startswith("+"), F.when((F.length(d) >= 8) & (F.length(d) <= 15), "phone"))
    out = out.when(m.rlike(rf"^(?:{CARD})$"), F.when(luhn_sum(d) % 10 == 0, "card"))
    out = out.when(m.rlike(rf"^(?:{IBAN})$"), let(F.replace(m, F.lit(" "), F.lit("")), lambda v: F.when(mod97(F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))) == 1, "iban")))
    return out.otherwise("secret")


def pseudonym(m: Column, kind: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of a match of that kind, or the way back; a null kind leaves the match."""
    fe = lambda x, k, **kw: feistel(x, key, k, inverse=inverse, **kw)
    email = let(F.regexp_extract(m, r"^(.*)(\.[A-Za-z]+)$", 1), lambda h: F.concat(fe(h, "email"), F.regexp_extract(m, r"(\.[A-Za-z]+)$", 1)))
    octet = F.split(m, r"\.")
    number = sum((octet[i].cast("long") * (1 << (24 - 8 * i)) for i in range(1, 4)), octet[0].cast("long") * (1 << 24))
    ip = let(_number_feistel(number, key, "ipv4", 16, inverse), lambda n: F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]))
    # The first digit of a card says who issued it and is kept.
    card = let(digits(m), lambda d: let(F.concat(F.substring(d, 1, 1), fe(F.substring(d, F.lit(2), F.length(d) - 2), "card")), lambda p: relay(m, F.concat(p, F.pmod(-luhn_sum(F.concat(p, F.lit("0"))), F.lit(10)).cast("string")), r"\d")))
    code = F.regexp_extract(m, r"^\+(\d{1,3}?)(?=[ .\-(])|^\+(\d)", 0)
    abroad = F.concat(code, let(F.substring(m, F.length(code) + 1, F.length(m)), lambda rest: relay(rest, fe(digits(rest), "phone"), r"\d")))
    # A national number keeps its first digit; its exchange does not begin with 0 or 1.
    local = let(digits(m), lambda d: let(_walk(fe(F.substring(d, F.lit(2), F.length(d)), "phone"), lambda v: fe(v, "phone"), lambda v: v.rlike(r"^..[2-9]"), 60), lambda v: relay(m, F.concat(F.substring(d, 1, 1), v), r"\d")))
    phone = F.when(m.startswith("+"), abroad).otherwise(local)
    ssn_ok = lambda v: ~v.rlike(r"^(?:000|666|9)|^...00|0000$")
    ssn = let(_walk(fe(digits(m), "ssn"), lambda v: fe(v, "ssn"), ssn_ok, 40), lambda v: relay(m, v, r"\d"))
    first, days = F.to_date(F.lit("1900-01-01")), 73049
    step = lambda n: _number_feistel(n, key, "date", 9, inverse)
    at = lambda n: F.date_add(first, n.cast("int"))
    moved = lambda d, held: at(_walk(step(F.datediff(d, first).cast("long")), step, lambda n: (n < days) & F.dayofmonth(at(F.least(n, F.lit(days - 1)))).between(*held), 400))
    put = lambda form, held: lambda d: F.when(d.isNotNull(), F.date_format(moved(d, held), form))
    date = F.coalesce(*[let(_read_date(m, *f), put(*f[1:])) for f in DATE_FORMS])
    hexes = F.regexp_replace(m, ":", "")
    ipv6 = let(hexes, lambda h: relay(m, fe(h, "ipv6", alphabets=("0123456789abcdef", "ABCDEF")), "[0-9A-Fa-f]"))
    flat = F.replace(m, F.lit(" "), F.lit(""))
    bban = lambda v: fe(F.substring(v, F.lit(5), F.length(v)), "iban")
    iban = let(flat, lambda v: let(bban(v), lambda b: relay(m, F.concat(F.substring(v, 1, 2), F.lpad((98 - mod97(F.concat(b, F.substring(v, 1, 2), F.lit("00")))).cast("string"), 2, "0"), b), "[A-Z0-9]")))
    hidden = lambda v: F.when(v.rlike("^[0-9a-f]+$"), fe(v, "secret", alphabets=HEX[:1])).when(v.rlike("^[0-9A-F]+$"), fe(v, "secret", alphabets=HEX[1:])).otherwise(fe(v, "secret"))
    secret = let(F.regexp_extract(m, f"^{NAME}", 0), lambda n: F.concat(n, hidden(F.substring(m, F.length(n) + 1, F.length(m)))))
    out = F.when(kind == "email", email)
    for name, value in (("ipv4", ip), ("ipv6", ipv6), ("card", card), ("phone", phone), ("ssn", ssn), ("date", date), ("iban", iban), ("secret", secret)):
        out = out.when(kind == name, value)
    return out.otherwise(m)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", inverse: bool = False, found: str | None = "pii") -> DataFrame:
    """`docs` with each valid match of its text replaced, and `found` (kind and number of matches changed), if a name is given for it.

    Null texts stay null and empty ones empty, without matches.  Rows are independent: repeated rows change alike, and
    further columns pass through, but for one of that name, which is replaced.  There is no default key.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    t = F.col(text)
    names = list(KINDS)

    def changed(v: Column) -> Column:
        found = F.transform(F.regexp_extract_all(v, F.lit(f"({ANY})"), 1), lambda m: F.struct(m.alias("m"), kind_of(m).alias("k")))
        new = lambda x: F.transform(x, lambda p: F.struct(pseudonym(p["m"], p["k"], key, inverse).alias("n"), p["k"].alias("k")))
        join = lambda x: F.struct(
            F.array_join(F.zip_with(F.split(v, ANY, -1), x, lambda gap, p: F.concat(gap, F.coalesce(p["n"], F.lit("")))), "").alias("text"),
            F.filter(F.transform(F.array(*[F.lit(k) for k in names]), lambda k: F.struct(k.alias("kind"), F.size(F.filter(x, lambda p: p["k"] == k)).alias("n"))), lambda s: s["n"] > 0).alias("pii"),
        )
        return let(new(found), join)

    none = F.struct(t.alias("text"), F.array().cast("array<struct<kind:string,n:int>>").alias("pii"))
    out = docs.select(F.struct(*docs.columns).alias("row"), F.when(t.rlike(HINT), changed(t)).otherwise(none).alias("new"))
    keep = [F.col("new.text").alias(c) if c == text else F.col(f"row.{c}") for c in docs.columns if c != found]
    return out.select(*keep, *[F.col("new.pii").alias(name) for name in [found] if name])


#: The setting of the session that names the queries' key.
KEY_SETTING = "spark.lumenstack.pii.key"


def session_key(spark: SparkSession) -> str:
    """The key that the session's settings name, or else a fresh one for this run, which links its documents and is then lost."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(16)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text with pseudonyms, and what was replaced."""
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
    return out.withColumn("n_replaced", F.aggregate("pii", F.lit(0), lambda a, x: a + x["n"]))
