"""Scalar normalisers as column expressions.  A missing value is NULL, blank, ``nan`` in any case, or ``<NA>``."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

OCTETS = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}"
HEX = "[0-9A-Fa-f]{1,4}"


def _ipv6() -> str:
    """Eight groups, or seven at most around one ``::``; an IPv4 address may stand for the last two; a zone may follow."""

    def up_to(n: int, tail: str) -> str:
        return f"({HEX}:){{0,{n}}}{tail}"

    forms = [f"({HEX}:){{7}}{HEX}", f"({HEX}:){{6}}{OCTETS}"]
    for left in range(8):
        begin = f"({HEX}:){{{left - 1}}}{HEX}::" if left else "::"
        forms.append(begin + (f"({up_to(6 - left, HEX)})?" if left < 7 else ""))
        if left < 6:
            forms.append(begin + up_to(5 - left, OCTETS))
    return f"^({'|'.join(forms)})(%[^%]+)?$"


IPV4, IPV6 = f"^{OCTETS}$", _ipv6()
#: What ``strip`` takes away.
WHITE = " \t\n\v\f\r"


def strip(c: Column) -> Column:
    """Without white space at either end (all white space, not only blanks)."""
    return F.btrim(c.cast("string"), F.lit(WHITE))


def missing(c: Column) -> Column:
    s = strip(c)
    return F.coalesce(F.lower(s).isin("", "nan") | (s == "<NA>"), F.lit(True))


def present(c: Column, value: Column) -> Column:
    return F.when(~missing(c), value)


def phone(c: Column) -> Column:
    """Digits only; missing or without digits: NULL."""
    return F.nullif(F.when(missing(c), F.lit("")).otherwise(F.regexp_replace(c, r"(?U)\D", "")), F.lit(""))


def compact(c: Column) -> Column:
    """Subscriber and device numbers: all white space removed."""
    return present(c, F.regexp_replace(c, r"\s+", ""))


def trimmed(c: Column) -> Column:
    return present(c, strip(c))


def timestamp(date: Column, time: Column) -> Column:
    """``yyyy-M-d H:m:s`` from two texts, NULL where that can't be read."""
    read = F.try_to_timestamp(F.concat_ws(" ", strip(date), strip(time)), F.lit("yyyy-M-d H:m:s"))
    return F.when(~missing(date) & ~missing(time), read.cast("timestamp_ntz"))


def timestamp_fault(date: Column, time: Column, read: Column) -> Column:
    joined = F.concat_ws(" ", strip(date), strip(time))
    return (
        F.when(missing(date), F.lit("Missing date for timestamp"))
        .when(missing(time), F.lit("Missing time for timestamp"))
        .when(read.isNull(), F.concat(F.lit("Failed to parse datetime: "), joined))
    )


def ip_valid(c: Column) -> Column:
    s = strip(c)
    return s.rlike(IPV4) | s.rlike(IPV6)


def integer(c: Column) -> Column:
    """An integer literal, or NULL: ``12.5`` is none."""
    s = strip(c)
    return F.when(s.rlike(r"^[+-]?\d{1,18}$"), s.cast("bigint"))


def decimal_amount(c: Column) -> Column:
    """Decimal literals, with exponents and single underscores between digits; commas are no part of a number here."""
    s = F.regexp_replace(strip(c), r"(?<=\d)_(?=\d)", "")
    return F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("decimal(38,6)"))


#: Currency marks before an amount.
CURRENCY = r"(?i)^\s*(rs\.?|inr|₹|\$)\s*"


def amount(c: Column) -> Column:
    """Amounts of statements: currency marks, thousands, ``(x)``, a minus on either side, DR and CR; else NULL."""
    s = F.upper(strip(c))
    s = F.regexp_replace(F.regexp_replace(s, CURRENCY, ""), r"(?i)\s*(RS\.?|INR|₹|\$)\s*", "")
    debit = s.rlike(r"^(DR\b\.?|.*\bDR\.?$)") | s.rlike(r"\dDR\.?$")
    s = strip(F.regexp_replace(s, r"^(DR|CR)\b\.?|(DR|CR)\.?$", ""))
    inner = F.regexp_replace(F.regexp_replace(s, r"^\((.*)\)$", "-$1"), r"^([^-].*)-$", "-$1")
    plain = F.regexp_replace(inner, r"[,\s]", "")
    # Of several points the last one is the decimal point.
    plain = F.when(F.length(plain) - F.length(F.replace(plain, F.lit("."), F.lit(""))) > 1, F.regexp_replace(plain, r"\.(?=.*\.)", "")).otherwise(plain)
    value = F.when(plain.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), plain.cast("double"))
    return F.when(~missing(c), F.when(debit, -value).otherwise(value))


def statement_date(c: Column) -> Column:
    """Day-first dates as ``yyyy-MM-dd``, bad ones NULL."""
    s = strip(c)
    formats = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M-d", "d MMM yyyy", "d-MMM-yyyy", "d/M/yy", "d-M-yy")
    return F.date_format(F.coalesce(*(F.try_to_timestamp(s, F.lit(f)) for f in formats)), "yyyy-MM-dd")


#: Transaction modes in narrations, in the order of the test, with the name each is given.
MODES = [("IMPS", "IMPS"), ("NEFT", "NEFT"), ("RTGS", "RTGS"), ("UPI", "UPI"), ("POS", "POS"), ("EDC", "EDC"), ("ATM", "ATM"), ("CASH", "CASH"), ("CHQ", "CHEQUE"), ("CHEQUE", "CHEQUE"), ("DR", "DEBIT_CARD"), ("CASHBACK", "CASHBACK"), ("INITIAL", "INITIAL_FUNDING"), ("OPENING", "OPENING_BALANCE"), ("CLOSING", "CLOSING_BALANCE")]


#: What follows the mode of an IMPS payment, and words that mark a bank or what is no payee.
IMPS_KINDS = ["P2A", "P2P", "P2M"]
BANK_WORDS = ["BANK", "IDFC", "HDFC", "SBI", "ICICI", "AXIS", "PNB"]
NO_PAYEE = ["BANK", "X0"]


def narration(c: Column) -> Column:
    """``struct(mode, reference, beneficiary, bank)`` of a narration of parts between slashes; empty parts don't count.

    The mode is the first known word in the first part; without one the narration itself is the mode.  IMPS narrations give
    their kind, reference, payee and bank by place; POS and EDC ones a reference in the last part.  NULL stays NULL."""
    parts = F.filter(F.transform(F.split(strip(c), "/"), strip), lambda x: x != "")

    def part(i: int) -> Column:
        return F.get(parts, F.lit(i))

    def holds(text: Column, words: list[str]) -> Column:
        return text.rlike("(?i)" + "|".join(words))

    def digits(text: Column) -> Column:
        return F.when(text.rlike(r"^\d+$"), text)

    word = F.lit(None).cast("string")
    for key, name in reversed(MODES):
        word = F.when(F.upper(part(0)).contains(key), F.lit(name)).otherwise(word)
    imps, n = word == "IMPS", F.size(parts)
    mode = F.when(imps & part(1).isin(IMPS_KINDS), F.concat(F.lit("IMPS_"), part(1))).otherwise(F.coalesce(word, strip(c)))
    plain = imps & ~F.coalesce(part(1).isin(IMPS_KINDS), F.lit(False))  # a kind makes it another mode, without the rest
    reference = F.when(plain & (n >= 3), digits(part(2))).when(word.isin("POS", "EDC") & (n >= 2), digits(F.element_at(parts, -1)))
    bank = F.when(plain & (n >= 4), F.get(F.filter(F.slice(parts, 4, F.greatest(n, F.lit(4))), lambda x: holds(x, BANK_WORDS)), F.lit(0)))
    beneficiary = F.when(plain & (n >= 4) & ~holds(part(3), NO_PAYEE), part(3))
    return F.when(c.isNotNull(), F.struct(mode.alias("mode"), reference.alias("reference"), beneficiary.alias("beneficiary"), bank.alias("bank")))


#: What a summary row of a statement says anywhere in its narration, and what it says as the whole of it.
SUMMARY = [r"OPENING\s+BALANCE", r"CLOSING\s+BALANCE", r"TRANSACTION\s+TOTAL", r"BROUGHT\s+FORWARD", r"CARRIED\s+FORWARD"]
SUMMARY_WHOLE = ["TOTAL", r"GRAND\s+TOTAL", r"SUB\s*TOTAL", r"STATEMENT\s+SUMMARY"]


def is_summary(c: Column) -> Column:
    """A marked text on one line counts anywhere; plain totals only as the whole text."""
    says = strip(c).rlike(f"(?i)^.*({'|'.join(SUMMARY)})|^\\s*({'|'.join(SUMMARY_WHOLE)})\\s*$")
    return F.coalesce(says, F.lit(False))


def text(c: Column) -> Column:
    """Compatibility forms taken apart (NFKD), runs of white space one blank, none at the ends; NULL stays NULL."""

    def plain(values: pd.Series) -> pd.Series:
        return values.map(lambda x: re.sub(r"\s+", " ", unicodedata.normalize("NFKD", x)).strip(), na_action="ignore")

    return F.pandas_udf(plain, "string")(c.cast("string"))


def micros(c: Column) -> Column:
    """Epoch microseconds of a naive timestamp (the session runs in UTC)."""
    return F.unix_micros(c.cast("timestamp"))


def odd_hour(ts: Column) -> Column:
    return F.when((F.hour(ts) < 6) | (F.hour(ts) >= 22), 1).otherwise(0)


def weekend(ts: Column) -> Column:
    return F.when(F.weekday(ts) >= 5, 1).otherwise(0)


def changed(now: Column, usual: Column) -> Column:
    """1 where two values differ; a NULL differs from everything."""
    return F.when(F.coalesce(now == usual, F.lit(False)), 0).otherwise(1)
