"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

DataFrame functions only. Kinds email, ip, card and phone are the base and are always reported; kinds iban
(mod 97), short_card (13 to 15 digits, Luhn) and local_phone (no country code) are reported when their score
is at least THRESHOLD, which takes a checksum, words such as "card" or "phone" before them, or both.

A null text counts as empty and has no spans. Rows are scanned each by itself, also if they repeat an id; an empty
table gives an empty result. find_personal_data replaces columns of the input that are named like its kinds; redact
keeps all columns as they are but for the text and its length. Very long texts are scanned whole, in time that grows
with their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, spare, text_of
from .spans import joined, masked, near, spans

KINDS = ("email", "ip", "card", "phone", "iban", "short_card", "local_phone")
BASE_KINDS = KINDS[:4]
THRESHOLD = 0.6

# Possessive where what follows can't begin with what is repeated: the same matches, without backtracking.
# A run is entered only at its start or where the last match ended, so long runs are not tried from each place.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Lengths of account numbers by country, so that a word after one is not taken with it; other countries may have any.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH DE GB GE IE ME RS",
    23: "AE IL", 24: "AD CZ ES MD PK RO SA SE SK TN", 25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ CY DO HU LB PL", 29: "BR QA", 30: "KW MU", 31: "MT",
}


def _iban() -> str:
    def places(n: int) -> str:
        return rf"[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")

    known = [rf"(?:{countries.replace(' ', '|')}){places(n)}" for n, countries in IBAN_LENGTHS.items()]
    other = rf"(?!{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?"
    return rf"(?<![A-Za-z0-9])(?:{'|'.join([*known, other])})(?![A-Za-z0-9])"


IBAN = _iban()
LOCAL_PHONE = r"(?<![0-9A-Za-z+.-])\(?0?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z-])"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

CARD_WORDS = r"\b(card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte)\b"
PHONE_WORDS = r"\b(phone|tel|call|mobile|fax|telefon|téléphone|teléfono)\b"
IBAN_WORDS = r"\b(iban|bank|account|konto|cuenta|compte)\b"
MAIL_WORDS = r"\b(mail|email|e-mail|contact|write|correo|courriel)\b"
IP_WORDS = r"\b(ip|host|server|address|addr|login)\b"


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(hit: Column) -> Column:
    """Whether the digits of hit pass Luhn's check."""
    from_right = F.split(F.reverse(digits(hit)), "")

    def value(d: Column, i: Column) -> Column:
        n = d.cast("int")
        twice = F.when(n > 4, 2 * n - 9).otherwise(2 * n)
        return F.when(i % 2 == 1, twice).otherwise(n)

    places = F.transform(F.filter(from_right, lambda d: d != ""), value)
    return F.aggregate(places, F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(hit: Column) -> Column:
    """Whether an account number passes the check of ISO 13616: its first four places moved to its end."""
    bare = F.regexp_replace(hit, "\x20", "")
    turned = F.split(F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4)), "")
    rest = F.aggregate(
        F.filter(turned, lambda c: c != ""), F.lit(0),
        lambda a, c: (F.when(c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55)) % 97,
    )
    return F.char_length(bare).between(15, 34) & (rest == 1)


def personal_spans(text: Column) -> dict[str, Column]:
    """The spans of each kind, by start."""
    size = lambda low, high: lambda hit: F.char_length(digits(hit)).between(low, high)
    raised = lambda words, plain, more: lambda before: F.when(near(before, words), plain + more).otherwise(F.lit(plain))
    any_digit = text.rlike("[0-9]")
    found = {
        "email": spans(text, "email", EMAIL, text.contains("@"), lambda hit: F.lit(True), raised(MAIL_WORDS, 0.9, 0.1)),
        "ip": spans(text, "ip", IP, any_digit, lambda hit: hit.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), raised(IP_WORDS, 0.7, 0.3)),
        "card": spans(text, "card", CARD, any_digit, lambda hit: size(16, 19)(hit) & luhn(hit), raised(CARD_WORDS, 0.8, 0.2)),
        "phone": spans(text, "phone", PHONE, text.contains("+"), size(8, 15), raised(PHONE_WORDS, 0.7, 0.3)),
        "iban": spans(text, "iban", IBAN, any_digit, mod97, raised(IBAN_WORDS, 0.8, 0.2)),
        "short_card": spans(text, "short_card", CARD, any_digit, lambda hit: size(13, 15)(hit) & luhn(hit), raised(CARD_WORDS, 0.4, 0.4)),
        "local_phone": spans(text, "local_phone", LOCAL_PHONE, any_digit, size(8, 12), raised(PHONE_WORDS, 0.3, 0.5)),
    }
    return {k: v if k in BASE_KINDS else F.filter(v, lambda s: s["score"] >= THRESHOLD) for k, v in found.items()}


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with an array of spans (kind, start, end, score) for each kind."""
    held = docs.select(*[c for c in docs.columns if c not in KINDS])
    return held.select(*held.columns, *[v.alias(k) for k, v in personal_spans(text_of(text)).items()])


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with <KIND> in place of personal data, in the columns they had; the column n_chars follows."""
    found = spare("_all", docs.columns)
    held = docs.withColumn(found, F.concat(*personal_spans(text_of(text)).values()))
    clean = held.withColumn(text, F.when(F.col(text).isNull(), F.col(text)).otherwise(masked(text_of(text), F.col(found))))
    if n_chars in docs.columns:
        clean = clean.withColumn(n_chars, F.when(F.size(found) > 0, F.char_length(text).cast(docs.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    return clean.select(*docs.columns)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(F.concat(*BASE_KINDS)).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat(*KINDS)).alias("spans"),
    )
