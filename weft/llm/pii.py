"""Format-preserving pseudonyms: validated numbers and dates are permuted by a keyed Feistel network within their format.

All of it is DataFrame functions. Equal values have equal pseudonyms in all documents, and different values of a kind have
different ones. Mail addresses and secrets, which have no number to permute, get keyed digests of their own shape.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import pick, spare

# Patterns of the kinds, in the order in which they are tried at a place. Java syntax.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "access_key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?i:password|passwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}[\"']?[^\s\"']{8,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9A-Za-z.\-/])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-Za-z]|[.\-/][0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9A-Za-z])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A place where a kind may begin, with what lies ahead as groups: the first kind that matches, and a card. Places overlap, as a match may turn
#: out invalid or too long. Secrets never do and are consumed, so that no long text of them is read from each; not where a mail address may hold the name.
PLACE = f"(?=({ANY}))(?=({PATTERNS['card']})?)(?:(?<!@[A-Za-z0-9.\\-]{{1,253}}[.\\-]){PATTERNS['secret']})?"

#: Lengths of IBANs by country.
IBAN_LENGTHS = {
    x[:2]: int(x[2:]) for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 "
        "HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 "
        "RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
#: Places of a text that are gone through at a time, so that what's made of them isn't copied for each of the others.
LOT = 128

#: Rounds of two half-steps each.
ROUNDS = 5
#: First day and number of days, a * b, of the ranges within which dates are permuted: 1900 to 2099, and the 400 years on either side.
DATE_RANGES = [("1900-01-01", 17, 4297), ("1500-01-01", 189, 773), ("2100-01-01", 189, 773)]


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(value: Column, a: Column, b: Column, key: str, tag: str) -> Column:
    """A permutation of 0 to a * b - 1, by turns adding a keyed function of one half to the other, modulo a or b."""
    f = lambda r, half, x: _number(F.sha2(F.concat_ws("|", F.lit(f"{key}|{tag}|{half}"), r.cast("string"), x.cast("string"), a.cast("string"), b.cast("string")), 256))
    start = F.struct(F.call_function("div", value, b).cast("long").alias("l"), F.pmod(value, b).cast("long").alias("r"))

    def step(x: Column, r: Column) -> Column:
        left = F.pmod(x["l"] + f(r, 0, x["r"]), a)
        y = F.struct(left.cast("long").alias("l"), x["r"].alias("r"))
        return F.transform(F.array(y), lambda z: F.struct(z["l"].alias("l"), F.pmod(z["r"] + f(r, 1, z["l"]), b).cast("long").alias("r")))[0]

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda x: x["l"] * b + x["r"])


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refill(m: Column, digits: Column) -> Column:
    """m with its digits replaced in turn."""
    return F.aggregate(
        F.split(m, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("k")),
        lambda acc, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(acc["s"], F.substr(digits, acc["k"], F.lit(1))).alias("s"), (acc["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["k"].alias("k"))),
        lambda acc: acc["s"],
    )


def _luhn_sum(digits: Column, shift: int) -> Column:
    """The Luhn sum of digits; shift 0 if the last one is the check digit, 1 if that's still to come."""
    return F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, k: _let(F.when((k + shift) % 2 == 1, c.cast("int") * 2).otherwise(c.cast("int")), lambda d: F.when(d > 9, d - 9).otherwise(d))),
        F.lit(0), lambda acc, d: acc + F.coalesce(d, F.lit(0)),
    )


def _half(k: Column) -> tuple[Column, Column]:
    """10 ** k as a product of two powers of 10."""
    low = F.call_function("div", k, F.lit(2))
    return F.pow(F.lit(10.0), low).cast("long"), F.pow(F.lit(10.0), k - low).cast("long")


def _ends(m: Column, before: str) -> Column:
    """m and what it would be if it ended at an earlier border of its groups, longest first."""
    return _let(F.split(m, f"(?={before})", -1), lambda x: F.transform(F.sequence(F.size(x), F.lit(1)), lambda k: F.array_join(F.slice(x, 1, k), "")))


def _card_end(m: Column) -> Column:
    """The longest of 13 to 19 digits that pass the Luhn check and end where m or a group of it does; null if there's none."""
    return F.get(F.filter(_ends(m, "[ \\-]"), lambda x: _let(_digits(x), lambda d: (F.length(d) >= 13) & (_luhn_sum(d, 0) % 10 == 0))), F.lit(0))


def _card(m: Column, key: str) -> Column:
    """The first digit stays, the last is the new check digit; 13 to 19 digits that fail the Luhn check aren't cards."""

    def of(d: Column) -> Column:
        n = F.length(d)
        inner = n - 2
        a, b = _half(inner)
        new = F.lpad(feistel(F.substr(d, F.lit(2), inner).cast("long"), a, b, key, "card").cast("string"), inner, F.lit("0"))
        body = F.concat(F.substring(d, 1, 1), new)
        return F.when(_luhn_sum(d, 0) % 10 == 0, _let(body, lambda x: _refill(m, F.concat(x, F.pmod(-_luhn_sum(x, 1), F.lit(10)).cast("string")))))

    return _let(_digits(m), of)


def _phone(m: Column, key: str) -> Column:
    """The ten last digits, area and exchange 200 to 999, are permuted; others, of countries with other plans, in all ten digits."""

    def of(d: Column) -> Column:
        n = F.length(d)
        area, exchange, line = (F.substr(d, n - F.lit(k), F.lit(w)).cast("long") for k, w in ((9, 3), (6, 3), (3, 4)))
        domestic = (area >= 200) & (exchange >= 200)
        code = (area - 200) * 8_000_000 + (exchange - 200) * 10_000 + line
        inside = _let(feistel(code, F.lit(80_000), F.lit(80_000), key, "phone"), lambda x: F.concat((F.call_function("div", x, F.lit(8_000_000)) + 200).cast("string"), (F.call_function("div", F.pmod(x, F.lit(8_000_000)), F.lit(10_000)) + 200).cast("string"), F.lpad(F.pmod(x, F.lit(10_000)).cast("string"), 4, "0")))
        other = F.lpad(feistel(F.substr(d, n - F.lit(9), F.lit(10)).cast("long"), F.lit(100_000), F.lit(100_000), key, "number").cast("string"), 10, "0")
        return _refill(m, F.concat(F.substr(d, F.lit(1), n - 10), F.when(domestic, inside).otherwise(other)))

    return _let(_digits(m), of)


def _ip(m: Column, key: str) -> Column:
    """Four numbers of 0 to 255 without leading zeros, permuted as one of 32 bits."""

    def of(p: Column) -> Column:
        number = reduce(lambda acc, k: acc * 256 + p[k].cast("long"), range(1, 4), p[0].cast("long"))
        valid = F.forall(p, lambda x: (x.cast("int") <= 255) & (x == x.cast("int").cast("string")))
        return F.when(valid, _let(feistel(number, F.lit(65_536), F.lit(65_536), key, "ip"), lambda x: F.concat_ws(".", *[F.pmod(F.shiftright(x, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])))

    return _let(F.split(m, r"\."), of)


def _ssn(m: Column, key: str) -> Column:
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""

    def of(d: Column) -> Column:
        area, group, serial = F.substring(d, 1, 3).cast("long"), F.substring(d, 4, 2).cast("long"), F.substring(d, 6, 4).cast("long")
        valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
        place = area - F.when(area > 666, 2).otherwise(1)
        new = feistel((place * 99 + group - 1) * 9999 + serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")

        def back(x: Column) -> Column:
            g = F.call_function("div", x, F.lit(9999))
            return _let(F.call_function("div", g, F.lit(99)), lambda a: F.concat(F.lpad((a + F.when(a >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((F.pmod(g, F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(x, F.lit(9999)) + 1).cast("string"), 4, "0")))

        return F.when(valid, _refill(m, _let(new, back)))

    return _let(_digits(m), of)


def _date(m: Column, key: str) -> Column:
    """A real date of 1500 to 2499 becomes another of the same range of years. dd/mm/yyyy is tried before mm/dd/yyyy."""

    def of(form: str):
        return lambda day: F.date_format(moved(day), form)

    def moved(day: Column) -> Column:
        out = F.lit(None).cast("date")
        for first, a, b in DATE_RANGES:
            start = F.to_date(F.lit(first))
            offset = F.datediff(day, start)
            out = F.when((offset >= 0) & (offset < a * b), F.date_add(start, feistel(offset.cast("long"), F.lit(a), F.lit(b), key, f"date{first}").cast("int"))).otherwise(out)
        return out

    tries = [(r"^[0-9]{4}-", "yyyy-MM-dd"), (r"^[0-9]{2}\.", "dd.MM.yyyy"), (r"^[0-9]{2}/", "dd/MM/yyyy"), (r"^[0-9]{2}/", "MM/dd/yyyy")]
    return F.coalesce(*[F.when(m.rlike(p), _let(F.try_to_timestamp(m, F.lit(form)).cast("date"), of(form))) for p, form in tries])


def _mod97(s: Column) -> Column:
    return F.aggregate(F.split(s, ""), F.lit(0), lambda acc, c: F.when(c.rlike("^[0-9]$"), (acc * 10 + c.cast("int")) % 97).when(c.rlike("^[A-Z]$"), (acc * 100 + F.ascii(c) - 55) % 97).otherwise(acc))


def _iban_valid(s: Column) -> Column:
    rest = F.substr(s, F.lit(5), F.length(s) - 4)
    return (F.length(s) >= 15) & (F.length(_digits(rest)) > 0) & (_mod97(F.concat(rest, F.substring(s, 1, 4))) == 1)


def _iban_end(m: Column) -> Column:
    """The valid one of its country's length, or m, or for other countries the longest valid one, that ends where m or a group of it does; else null."""
    size = F.try_element_at(F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair]), F.substring(m, 1, 2))
    plain = lambda x: F.replace(x, F.lit(" "), F.lit(""))

    def of(ends: Column, size: Column) -> Column:
        first = F.filter(ends, lambda x: F.coalesce(F.length(plain(x)) == size, F.lit(False)))
        others = F.when(size.isNull(), ends).otherwise(F.slice(ends, 1, 1))
        return F.get(F.filter(F.concat(first, others), lambda x: _iban_valid(plain(x))), F.lit(0))

    return _let(F.struct(_ends(m, " ").alias("ends"), size.alias("size")), lambda x: of(x["ends"], x["size"]))


def _iban(m: Column, key: str) -> Column:
    """Valid by its remainder of 97: the digits after the country's letters and the check digits are permuted, group by group
    of 14 at most, and new check digits set; letters stay."""
    def of(s: Column) -> Column:
        country, rest = F.substring(s, 1, 2), F.substr(s, F.lit(5), F.length(s) - 4)

        def build(d: Column) -> Column:
            n = F.length(d)
            pieces = F.transform(F.sequence(F.lit(0), F.call_function("div", F.greatest(n - 1, F.lit(0)), F.lit(14)).cast("int")), lambda k: F.substr(d, k * 14 + 1, F.lit(14)))
            new = F.array_join(F.transform(pieces, lambda x, k: F.lpad(feistel(F.coalesce(F.try_to_number(x, F.lit("9" * 14)).cast("long"), F.lit(0).cast("long")), *_half(F.length(x)), key, "iban").cast("string"), F.length(x), F.lit("0"))), "")
            body = _refill(rest, new)
            return _let(body, lambda r: F.concat(country, F.lpad((98 - _mod97(F.concat(r, country, F.lit("00")))).cast("string"), 2, "0"), r))

        plain = _let(_digits(rest), build)
        # Blanks go back to where they stood.
        spaced = lambda new: F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("k")), lambda acc, c: F.when(c == " ", F.struct(F.concat(acc["s"], c).alias("s"), acc["k"].alias("k"))).otherwise(F.struct(F.concat(acc["s"], F.substr(new, acc["k"], F.lit(1))).alias("s"), (acc["k"] + 1).alias("k"))), lambda acc: acc["s"])
        return F.when(_iban_valid(s), _let(plain, spaced))

    return _let(F.replace(m, F.lit(" "), F.lit("")), of)


def _email(m: Column, key: str) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(m)), 256)
    return F.concat(F.lit("u"), F.substring(digest, 1, 16), F.lit("@"), F.substring(digest, 17, 8), F.lit(".invalid"))


def _access_key(m: Column, key: str) -> Column:
    return F.concat(F.lit("AKIA"), F.substring(F.upper(F.sha2(F.concat(F.lit(f"{key}|access|"), m), 256)), 1, 16))


def _secret(m: Column, key: str) -> Column:
    name = F.regexp_extract(m, r"^((?i:password|passwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}[\"']?)", 1)
    value = F.substr(m, F.length(name) + 1, F.length(m))
    digest = F.sha2(F.concat(F.lit(f"{key}|secret|"), value), 256)
    return F.concat(name, F.substr(F.repeat(digest, F.ceil(F.length(value) / 64).cast("int")), F.lit(1), F.length(value)))


_MAKERS = {"email": _email, "access_key": _access_key, "secret": _secret, "iban": _iban, "date": _date, "ip": _ip, "phone": _phone, "ssn": _ssn, "card": _card}


def pseudonym(m: Column, card: Column, key: str) -> Column:
    """(old, new) of the match m or its valid beginning, by the first kind that it fits and that finds it valid, or of the card that begins at the
    same place, empty if there's none; null if nothing is valid."""
    whole = {"iban": _iban_end, "card": _card_end}
    pair = lambda old, make: _let(old, lambda x: F.when(x.isNotNull(), _let(make(x, key), lambda new: F.when(new.isNotNull(), F.struct(x.alias("old"), new.alias("new"))))))
    first = [F.when(m.rlike(rf"^(?:{PATTERNS[kind]})$"), pair(whole.get(kind, lambda x: x)(m), make)) for kind, make in _MAKERS.items() if kind != "card"]
    return F.coalesce(*first, F.when(card != "", pair(_card_end(card), _card)))


def _rewrite(lead: Column, parts: Column) -> Column:
    """(text, n) of lead and parts(own, width, taken, new), in turn: a part that no earlier match reaches into, with taken > 0, begins with a match of
    that length, which may end in a later part. n counts matches that aren't their own pseudonyms."""
    start = lambda skip: F.struct(skip.alias("skip"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        free = (acc["skip"] == 0) & (x["taken"] > 0)
        gone = F.when(free, x["taken"]).otherwise(acc["skip"])
        piece = F.concat(F.when(free, x["new"]).otherwise(F.lit("")), F.substr(x["own"], gone + 1, x["width"]))
        return F.struct(F.greatest(gone - x["width"], F.lit(0)).alias("skip"), (acc["n"] + F.when(free & x["other"], 1).otherwise(0)).alias("n"), F.concat(acc["out"], F.array(piece)).alias("out"))

    def lot(acc: Column, xs: Column) -> Column:
        done = F.aggregate(xs, start(acc["skip"]), step)
        return _let(done, lambda d: F.struct(d["skip"].alias("skip"), (acc["n"] + d["n"]).alias("n"), F.concat(acc["out"], F.array(F.array_join(d["out"], ""))).alias("out")))

    lots = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(parts) - 1, F.lit(LOT)).cast("int")), lambda k: F.slice(parts, k * LOT + 1, LOT))
    return F.aggregate(lots, start(F.lit(0)), lot, lambda acc: F.struct(F.concat(lead, F.array_join(acc["out"], "")).alias("text"), acc["n"].cast("long").alias("n")))


def pseudonymise(docs: DataFrame, key: str, counts: bool = False) -> DataFrame:
    """docs, all columns and rows, with pseudonyms in ``text``; with ``counts``, n_found (matches replaced) as well.

    A null text stays null, with n_found 0; an empty one stays empty. What looks like a number but isn't valid stays: digits that fail
    their check, octets above 255, days that don't exist. Cards and IBANs may end at a border of groups before the longest match does, and what an
    invalid match covers is searched for others. Names of other columns may clash with none but n_found with ``counts``.
    Rows are worked on by themselves: no shuffle, whatever their number, and repeated rows get equal results.
    """
    pick(docs, "text")
    text = F.col("text")
    # Most texts have none of what each of the kinds has: a digit, an @, AKIA or a secret's name.
    some = text.rlike("[0-9@]|AKIA|(?i:password|passwd|secret|token|api_?key)")
    # A line end goes first, as a split leaves out an empty piece before a place at the beginning.
    padded = F.concat(F.lit("\n"), text)
    found, card, read = (F.regexp_extract_all(padded, F.lit(PLACE), F.lit(k)) for k in (1, 2, 0))

    def rewritten(x: Column) -> Column:
        def part(m: Column, k: Column) -> Column:
            own = F.concat(F.get(x["read"], k), F.get(x["gaps"], k + 1))
            return _let(
                F.struct(own.alias("own"), pseudonym(m, F.get(x["card"], k), key).alias("p")),
                lambda y: F.struct(y["own"].alias("own"), F.length(y["own"]).alias("width"), F.coalesce(F.length(y["p"]["old"]), F.lit(0)).alias("taken"), y["p"]["new"].alias("new"), F.coalesce(y["p"]["old"] != y["p"]["new"], F.lit(False)).alias("other")),
            )

        lead = F.get(x["gaps"], F.lit(0))
        return _let(F.transform(x["found"], part), lambda parts: _rewrite(F.substr(lead, F.lit(2), F.length(lead)), parts))

    places = F.struct(found.alias("found"), card.alias("card"), read.alias("read"), F.split(padded, PLACE, -1).alias("gaps"))
    both = F.when(some & F.regexp_like(text, F.lit(ANY)), _let(places, rewritten))
    [name] = spare(docs, "both")
    out = docs.withColumn(name, both).withColumn("text", F.coalesce(F.col(f"{name}.text"), text))
    if counts:
        out = out.withColumn("n_found", F.coalesce(F.col(f"{name}.n"), F.lit(0)).cast("long"))
    return out.drop(name)
