"""Masking of personal data and secrets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "***REDACTED***"
# Patterns of personal data. The order of the rules is part of the result.
EMAIL = r"(?i)([A-Z0-9._%+-])[A-Z0-9._%+-]{0,63}(@[A-Z0-9.-]+\.[A-Z]{2,})"
PHONE = r"(?<!\d)(1[3-9]\d)\d{4}(\d{4})(?!\d)"
ID_CARD = r"\b(\d{6})\d{8}(\d{3}[\dXx])\b"
BANK_CARD = r"\b(\d{4})\d{7,11}(\d{4})\b"
IPV4 = r"\b(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\b"
SECRET = r"(?i)((?:password|passwd|pwd|token|secret|api[-_]?key)\s*[:=])\s*[^,\s;}]+"
SECRET_WORD = r"(?i)passw(?:or)?d|pwd|token|secret|api[-_]?key"
LONG_DIGITS = r"\b\d{15,19}\b|\b\d{17}[\dXx]\b"
SENSITIVE_KEYS = ("password", "passwd", "pwd", "token", "secret", "apikey", "api_key", "authorization", "cookie", "connectionstring")


def mask_text(x: Column) -> Column:
    """E-mails, phones, identity and bank cards, secrets and long digit runs masked, one rule after the other.

    A cheap test goes before each costly pattern: a text without its mark is not searched.
    """
    y = F.when(F.contains(x, F.lit("@")), F.regexp_replace(x, EMAIL, "$1***$2")).otherwise(x)
    digits = x.rlike(r"\d{11}")  # the shortest run that any of the number rules needs
    numbers = y
    for rule, shown in ((PHONE, "$1****$2"), (ID_CARD, "$1********$2"), (BANK_CARD, "$1********$2")):
        numbers = F.regexp_replace(numbers, rule, shown)
    y = F.when(digits, numbers).otherwise(y)
    y = F.when(x.rlike(SECRET_WORD), F.regexp_replace(y, SECRET, "$1" + MASK.replace("$", r"\$"))).otherwise(y)
    return F.when(digits, F.regexp_replace(y, LONG_DIGITS, MASK)).otherwise(y)


def mask(x: Column, kind: str) -> Column:
    """A value masked as email, phone, id_card, bank_card, ip, name, address, token or secret; empty and null stay."""
    n = F.length(x)
    rules = {
        "email": F.when(F.instr(x, "@") > 1, F.concat(F.substring(x, 1, 1), F.lit("***"), F.regexp_extract(x, "(@.*)$", 1))).otherwise(MASK),
        "phone": F.regexp_replace(x, PHONE, "$1****$2"),
        "id_card": F.regexp_replace(x, ID_CARD, "$1********$2"),
        "bank_card": F.regexp_replace(x, BANK_CARD, "$1********$2"),
        "ip": F.regexp_replace(x, IPV4, "$1.$2.$3.*"),
        "name": F.when(n <= 1, F.lit("*")).otherwise(F.concat(F.substring(x, 1, 1), F.repeat(F.lit("*"), F.greatest(F.lit(1), n - 1)))),
        "address": F.when(n <= 6, F.lit("******")).otherwise(F.concat(F.substring(x, 1, 3), F.lit("******"), F.right(x, F.lit(3)))),
    }
    return F.when(x.isNull() | (x == ""), x).otherwise(rules.get(kind, F.lit(MASK)))
