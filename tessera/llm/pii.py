"""Personal data in whole texts: patterns propose, checksums confirm, nearby words adjust the score.

Only Spark SQL functions. Spans count code points, ends are exclusive. Matches are leftmost and
do not overlap within a kind; kinds may overlap each other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns in Java's syntax. Possessive quantifiers and "at the start of a run, or where the last match
# ended" change no match: they keep the work linear and the stack flat on very long runs.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# How long the account numbers of the IBAN registry's countries are.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ XK LT LU MN", 21: "HR LV LI CH", 22: "BH BG CR GE DE IE ME RS GB VA",
    23: "GI IL IQ TL AE SO OM", 24: "AD CZ MD PK RO SA SK ES SE TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = "(?:" + "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")"
SECRET = r"(?:(?<![0-9a-f])|\G)[0-9a-f]{32,}+"
TEL = r"\(?[0-9]{3}\)?[\x20-][0-9]{3}-[0-9]{4}"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, 1).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether an account number's check digits leave 1 modulo 97 (letters count from A = 10)."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        n = F.ascii(c)
        return F.when(n >= 65, (rest * 100 + n - 55) % 97).otherwise((rest * 10 + n - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


@dataclass(frozen=True)
class Kind:
    """How spans of one kind are proposed, confirmed and scored; a base kind stays whatever its score."""

    name: str
    pattern: str
    hint: str  # only texts with this pattern are searched
    score: float
    valid: object = None
    context: str = ""
    gain: float = 0.2
    base: bool = True


KINDS = [
    Kind("email", EMAIL, "@", 0.8, None, "mail|contact|write|kontakt|correo|courriel"),
    Kind("ip", IP, r"[0-9]\.[0-9]", 0.6, lambda m: F.regexp_like(m, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$")), "ip|host|server|address|login"),
    Kind("card", CARD, r"[0-9](?:[\x20-]?[0-9]){12}", 0.7, lambda m: between(F.length(digits_of(m)), 13, 19) & luhn(digits_of(m)), "card|visa|credit|karte|carte|tarjeta"),
    Kind("phone", PHONE, r"\+[0-9]", 0.7, lambda m: between(F.length(digits_of(m)), 9, 15), "tel|phone|call|fax|mobil"),
    Kind("iban", IBAN, r"[A-Z]{2}[0-9]{2}", 0.7, mod97, "iban|account|konto|compte|cuenta", base=False),
    Kind("secret", SECRET, "[0-9a-f]{32}", 0.4, None, "token|secret|key|passw|bearer", base=False),
    Kind("tel", TEL, "[0-9]{3}-[0-9]{4}", 0.4, None, "tel|phone|call|fax|mobil", base=False),
]
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def find(text: Column, kind: Kind, least: float, near: int) -> Column:
    """Spans of one kind in text, in order; `near` code points before and after a span are searched for its context words."""
    gaps = F.zip_with(F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,m:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["m"])
        one = F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("m"))
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out")))

    found = F.aggregate(gaps, start, step, lambda acc: acc["out"])
    if kind.valid:
        found = F.filter(found, lambda x: kind.valid(x["m"]))

    def scored(x: Column) -> Column:
        before = F.substring(text, F.greatest(x["start"] - near, F.lit(0)) + 1, F.least(x["start"], F.lit(near)))
        around = F.lower(F.concat(before, F.lit("\n"), F.substring(text, x["end"] + 1, F.lit(near))))
        score = F.lit(kind.score) + F.when(F.regexp_like(around, F.lit(kind.context)), F.lit(kind.gain)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score.alias("score"))

    out = F.transform(found, scored)
    if not kind.base:
        out = F.filter(out, lambda x: x["score"] >= least)
    return F.when(F.regexp_like(text, F.lit(kind.hint)), out).otherwise(F.array()).cast(SPANS)


def find_pii(docs: DataFrame, least: float = 0.6, near: int = 40) -> DataFrame:
    """docs with one array of spans (kind, start, end, score) for each kind: pii_email, pii_ip, ...

    Null and empty texts have no spans. Spans of the base kinds (email, ip, card, phone) stay
    whatever their score; those of iban, secret and tel are kept from `least` on. Every column of
    docs stays; columns named like those added are replaced. Rows are independent, so repeats and
    clashing ids do no harm.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({f"pii_{k.name}": find(text, k, least, near) for k in KINDS})


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def summarize(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of their spans, and all spans as text."""
    base, every = ([F.col(f"pii_{k.name}") for k in KINDS if k.base or more] for more in (False, True))
    counts = [F.size(f"pii_{k.name}").cast("long").alias(f"n_{k.name}") for k in KINDS if k.base]
    return found.select("doc_id", *counts, F.sha2(joined(F.concat(*base)), 256).alias("base_sha256"), joined(F.concat(*every)).alias("spans"))


def mask(found: DataFrame) -> DataFrame:
    """The text of find_pii's result with every span, or run of overlapping spans, replaced by [kind]; spans are dropped."""
    text = F.col("text")
    spans = F.array_sort(F.transform(F.concat(*(F.col(f"pii_{k.name}") for k in KINDS)), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), x["kind"].alias("kind"))))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.concat(F.lit("["), x["kind"], F.lit("]")))
        return F.struct(F.greatest(acc["at"], -x["end"]).alias("at"), F.when(x["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return found.withColumn("text", F.when(F.size(spans) > 0, whole).otherwise(text)).drop(*(f"pii_{k.name}" for k in KINDS))
