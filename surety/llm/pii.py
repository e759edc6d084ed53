"""Format-preserving pseudonyms for personal data by keyed Feistel networks, in DataFrame operations only.

Validated values keep their format and are permuted inside it, so equal values stay equal across documents and
different ones stay different: payment cards (Luhn; the first digit stays and the check digit is set anew), phone
numbers (10 digits; without +1 only those whose area code can exist, 200 to 999, which stay in that range),
social-security numbers (areas 001 to 899 without 666, groups from 01, serials from 0001), IPv4 addresses (32 bits) and
calendar dates (1900-01-01 to 2099-12-31). E-mail addresses, having no numeric format, become keyed hashes of the whole
address. The key is the caller's secret: whoever has it can invert the permutations.

Defined results: a null text stays null with counts 0; texts without such values are unchanged, character by
character; digit runs without a valid card, impossible dates, social-security numbers and area codes are unchanged; an
empty table gives no rows. A card is one or more whole groups of digits of a run, 13 to 19 digits
joined by single blanks or hyphens, found from the left in what the fixed formats leave; repeated rows are treated
alike; other columns pass through, but one named n_pii is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surety.llm.common import ROW, packed

ROUNDS = 8
#: Fixed formats, in order of preference at one place; runs of digits that may hold cards.
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "phone": r"(?:\+1[ .-]?|(?<![0-9A-Za-z(+.-])1[ .-])(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9A-Za-z(+.-])\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
    "ip": r"(?<![0-9A-Za-z.-])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z-])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9A-Za-z-])",
    "ssn": r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])",
}
ANY = "|".join(f"(?:{p})" for p in FORMATS.values())
RUN = r"(?<![0-9A-Za-z.-])[0-9][0-9 -]{11,}[0-9](?![0-9A-Za-z-])"
#: One card's digits and separators, and the longest such text.
CARD = r"^[0-9](?:[ -]?[0-9]){12,18}$"
LONGEST = 37
#: The accepted dates are LONG * SHORT days from EPOCH; the areas, and groups and serials, of social-security numbers.
EPOCH, SHORT, LONG = "1900-01-01", 17, 4297
AREAS, GROUPS, SERIALS = 898, 99, 9999


def _rounds(low: Column, high: Column, low_size: Column, high_size: Column, key: str, kind: str, index=None) -> Column:
    """Feistel rounds over (a, b) with a < low_size, b < high_size; sizes change places with the halves."""
    start = F.struct(low.cast("bigint").alias("a"), high.cast("bigint").alias("b"), low_size.cast("bigint").alias("m"), high_size.cast("bigint").alias("n"))

    def step(s, i):
        word = F.concat_ws(":", F.lit(key), F.lit(kind), i, s["n"], s["b"])
        mixed = F.conv(F.substring(F.sha2(word, 256), 1, 14), 16, 10).cast("bigint")
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + mixed, s["m"]).alias("b"), s["n"].alias("m"), s["m"].alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A keyed permutation of digit strings of each length of 2 to 18."""
    u = F.floor(F.length(digits) / 2).cast("int")
    v = F.length(digits) - u
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("bigint")
    out = _rounds(F.substring(digits, F.lit(1), u), F.substring(digits, u + 1, v), power(u), power(v), key, kind)
    return F.concat(F.lpad(out["a"].cast("string"), u, "0"), F.lpad(out["b"].cast("string"), v, "0"))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits, the last one counting once."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    twice = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when((n - i) % 2 == 1, twice(value(i))).otherwise(value(i)))


def _refill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced in order; other characters stay."""
    chars = F.regexp_extract_all(shape, F.lit("(?s)."), F.lit(0))
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(s, c):
        digit = c.rlike("[0-9]")
        return F.struct((s["at"] + digit.cast("int")).alias("at"), F.concat(s["out"], F.when(digit, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(chars, start, step, lambda s: s["out"])


def _once(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _card(value: Column, key: str) -> Column:
    """Every step's result is bound before it is used by digit."""
    moved = lambda d: F.concat(F.substring(d, 1, 1), permute_digits(F.substring(d, F.lit(2), F.length(d) - 2), key, "card"))
    check = lambda body: _once(F.concat(body, F.lit("0")), lambda b: F.concat(body, F.pmod(-luhn_sum(b), F.lit(10)).cast("string")))
    digits = _once(_once(F.regexp_replace(value, "[^0-9]", ""), moved), check)
    return _once(digits, lambda d: _refill(value, d))


def _run(value: Column, key: str) -> Column:
    """(n, new): how many cards a run of digit groups holds, and the run with their pseudonyms."""

    def replaced(tokens):
        n = F.size(tokens)
        # by single elements, as a slice would copy all tokens of the run each time
        part = lambda i, j: F.when(j >= i, F.array_join(F.transform(F.sequence(i, F.greatest(i, j)), lambda k: F.get(tokens, k - 1)), "")).otherwise("")
        luhn = lambda v: _once(F.regexp_replace(v, "[^0-9]", ""), lambda d: luhn_sum(d) % 10 == 0)
        none = F.lit(None).cast("int")

        def longer(s, i, k):
            """The text from token i on with token k, and k if that ends a card; a text too long for one stays."""
            word = F.get(tokens, k - 1)
            apart = (k - i) % 2 == 1
            text = F.when(apart & (F.length(word) > 1), F.repeat(F.lit(" "), LONGEST + 1)).otherwise(F.concat(s["text"], word))
            return _once(text, lambda t: F.struct(F.when(~apart & t.rlike(CARD) & luhn(t), k).alias("j"), t.alias("text")))

        def last(i):
            """The first token that ends a card which begins with token i: groups are added until one is found."""
            start = F.struct(none.alias("j"), F.lit("").alias("text"))
            step = lambda s, k: F.when(s["j"].isNotNull() | (F.length(s["text"]) > LONGEST), s).otherwise(longer(s, i, k))
            return F.aggregate(F.sequence(i, F.least(i + LONGEST - 1, n)), start, step, lambda s: s["j"])

        found = F.filter(F.transform(F.sequence(F.lit(1), n, F.lit(2)), lambda i: F.struct(i.alias("i"), last(i).alias("j"))), lambda x: x["j"].isNotNull())
        empty = F.array().cast("array<struct<i:int,j:int,after:int>>")

        def pick(s, x):
            more = F.concat(s["picks"], F.array(F.struct(x["i"].alias("i"), x["j"].alias("j"), s["next"].alias("after"))))
            return F.when(x["i"] >= s["next"], F.struct((x["j"] + 1).alias("next"), more.alias("picks"))).otherwise(s)

        def joined(s):
            made = F.transform(s["picks"], lambda x: F.concat(part(x["after"], x["i"] - 1), _once(part(x["i"], x["j"]), lambda v: _card(v, key))))
            return F.struct(F.size(s["picks"]).alias("n"), F.concat(F.array_join(made, ""), part(s["next"], n)).alias("new"))

        return F.aggregate(found, F.struct(F.lit(1).alias("next"), empty.alias("picks")), pick, joined)

    return _once(F.regexp_extract_all(value, F.lit("[0-9]+|[^0-9]+"), F.lit(0)), replaced)


def _cards(gap: Column, key: str) -> Column:
    """(n, new): the cards in a text without fixed formats, and the text with their pseudonyms."""

    def joined(runs):
        text = F.array_join(F.zip_with(F.split(gap, RUN, -1), runs, lambda rest, r: F.concat(rest, F.coalesce(r["new"], F.lit("")))), "")
        return F.struct(F.aggregate(runs, F.lit(0), lambda s, r: s + r["n"]).alias("n"), text.alias("new"))

    runs = F.transform(F.regexp_extract_all(gap, F.lit(RUN), F.lit(0)), lambda v: _run(v, key))
    return F.when(gap.rlike(RUN), _once(runs, joined)).otherwise(F.struct(F.lit(0).alias("n"), gap.alias("new")))


def _ip(value: Column, key: str) -> Column:
    part = lambda i: F.element_at(F.split(value, r"\."), i).cast("bigint")
    side = F.lit(65536)
    out = _rounds(part(1) * 256 + part(2), part(3) * 256 + part(4), side, side, key, "ip")
    byte = lambda half: [F.floor(half / 256).cast("string"), (half % 256).cast("string")]
    return F.concat_ws(".", *byte(out["a"]), *byte(out["b"]))


def _date(value: Column, key: str) -> Column:
    day = F.datediff(F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).cast("date"), F.lit(EPOCH).cast("date"))
    out = _rounds(F.floor(day / LONG), day % LONG, F.lit(SHORT), F.lit(LONG), key, "date")
    moved = F.date_add(F.lit(EPOCH).cast("date"), (out["a"] * LONG + out["b"]).cast("int"))
    return F.when(day.isNotNull(), F.date_format(moved, "yyyy-MM-dd")).otherwise(value)


def _ssn(value: Column, key: str) -> Column:
    """Areas are numbered without 000 and 666, so every pseudonym is one that can exist."""
    part = lambda at, n: F.substring(value, at, n).cast("bigint")
    area = part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)
    out = _rounds(area, (part(5, 2) - 1) * SERIALS + part(8, 4) - 1, F.lit(AREAS), F.lit(GROUPS * SERIALS), key, "ssn")
    text = lambda n, size: F.lpad(n.cast("bigint").cast("string"), size, "0")
    shown = lambda o: F.concat_ws("-", text(o["a"] + F.when(o["a"] >= 665, 2).otherwise(1), 3), text(F.floor(o["b"] / SERIALS) + 1, 2), text(o["b"] % SERIALS + 1, 4))
    return _once(out, shown)


def _phone(value: Column, key: str) -> Column:
    """Area codes from 200 and those below, which only +1 announces, keep to themselves."""
    found = F.regexp_replace(value, "[^0-9]", "")
    ten, prefix = F.substring(found, -10, 10), F.substring(found, F.lit(1), F.length(found) - 10)
    area, rest = F.substring(ten, 1, 3).cast("bigint"), F.substring(ten, 4, 7).cast("bigint")
    real = area >= 200
    low, size = F.when(real, 200).otherwise(0), F.when(real, 800).otherwise(200)
    out = _rounds(area - low, rest, size, F.lit(10**7), key, "phone")
    digits = lambda o: F.concat(prefix, F.lpad((o["a"] + low).cast("string"), 3, "0"), F.lpad(o["b"].cast("string"), 7, "0"))
    return _once(_once(out, digits), lambda d: _refill(value, d))


def _email(value: Column, key: str) -> Column:
    word = F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), F.lower(value)), 256)
    return F.concat(F.lit("u"), F.substring(word, 1, 16), F.lit("@"), F.lit("m"), F.substring(word, 17, 8), F.lit(".invalid"))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one value found by ANY."""
    whole = lambda kind: value.rlike(f"^(?:{FORMATS[kind].replace('(?<!', '(?<!')})$")
    return (
        F.when(F.contains(value, F.lit("@")), _email(value, key))
        .when(value.rlike(r"^(?:\+1|1[ .-]|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$)"), _phone(value, key))
        .when(whole("ip"), _ip(value, key))
        .when(whole("date"), _date(value, key))
        .otherwise(_ssn(value, key))
    )


def pseudonymise(df: DataFrame, key: str, text="text", counts=True) -> DataFrame:
    """df with pseudonyms in its text; counts adds ``n_pii`` (values changed). key: the secret of the permutations."""
    body = F.col(ROW)[text]
    hit = F.coalesce(body.rlike("[0-9@]") & (body.rlike(ANY) | body.rlike(RUN)), F.lit(False))
    rows = packed(df).withColumn("hit", hit)
    rows = rows.withColumn("old", F.when(F.col("hit"), F.regexp_extract_all(body, F.lit(ANY), F.lit(0))))
    rows = rows.withColumn("new", F.transform("old", lambda v: pseudonym(v, key)))
    # cards are looked for in the gaps between the fixed formats
    rows = rows.withColumn("gaps", F.when(F.col("hit"), F.transform(F.split(body, ANY, -1), lambda gap: _cards(gap, key))))
    pieces = F.zip_with("gaps", "new", lambda gap, new: F.concat(gap["new"], F.coalesce(new, F.lit(""))))
    changed = F.size(F.filter(F.zip_with("old", "new", lambda a, b: a != b), lambda x: x)) + F.aggregate("gaps", F.lit(0), lambda s, g: s + g["n"])
    made = {text: F.when(F.col("hit"), F.array_join(pieces, "")).otherwise(body)}
    if counts:
        made["n_pii"] = F.when(F.col("hit"), changed).otherwise(0).cast("bigint")
    names = [*df.columns, *(c for c in made if c not in df.columns)]
    return rows.select(*[made.get(c, F.col(ROW)[c]).alias(c) for c in names])
