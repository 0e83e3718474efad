"""Detection rules, labels and the protection policy as data."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: A word boundary by ASCII letters, digits and underscore, whatever the engine's own \b takes for a word.
BOUNDARY = r"(?:(?=[A-Za-z0-9_])(?<![A-Za-z0-9_])|(?![A-Za-z0-9_])(?<=[A-Za-z0-9_]))"
#: A class of word characters alone: before or behind it a boundary has one side to look at.
WORD_CLASS = r"\[(?:[A-Za-z0-9]-[A-Za-z0-9]|[A-Za-z0-9_])+\]"


@dataclass(frozen=True)
class Rule:
    name: str
    category: str
    pattern: str  # \b is the ASCII boundary
    confidence: float
    check: str = ""  # verhoeff, card, upi, not_bh, digit
    context: str = ""  # fires only where the unit's context is this category
    hint: str = ""  # what every match has in it, as a pattern that is quickly found to be absent

    @property
    def spark_pattern(self) -> str:
        """The pattern with boundaries spelt out: the class that must follow is looked at first, so that most places are left at once.

        What runs up to an @ that it can't hold itself gives nothing back.
        """
        group = r"" if "|" in self.pattern or re.search(r"\)(?:[?*]|\{0)", self.pattern) else r"(?:\(\?:)?"
        begun = re.sub(rf"\\b(?={group}({WORD_CLASS})(?![?*]|\{{0))", r"(?=\1)(?<![A-Za-z0-9_])", self.pattern)
        ended = re.sub(rf"({WORD_CLASS}(?:\{{[1-9][0-9]*(?:,[0-9]+)?\}})?)\\b", r"\1(?![A-Za-z0-9_])", begun)
        return re.sub(r"(\[[^\]@]+\](?:\+|\{[0-9]+,[0-9]+\}))@", r"\1+@", ended.replace(r"\b", BOUNDARY))


# Patterns and confidences of the rules.
RULES = (
    Rule("aadhaar", "AADHAAR", r"\b[2-9][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}\b", 0.95, "verhoeff", hint=r"[2-9][0-9]{3}[ -]?[0-9]{4}"),
    Rule("aadhaar_masked", "AADHAAR", r"\b[Xx*]{4}[ -]?[Xx*]{4}[ -]?[0-9]{4}\b", 0.6, hint=r"[Xx*]{4}"),
    Rule("pan", "PAN", r"\b[A-Z]{3}[PCHFATBLJG][A-Z][0-9]{4}[A-Z]\b", 0.9, hint=r"[A-Z][0-9]{4}[A-Z]"),
    Rule("card", "CARD_NUMBER", r"\b(?:[0-9][ -]?){12,18}[0-9]\b", 0.92, "card", hint=r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"),
    Rule("email", "EMAIL", r"[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)+", 0.95, hint=r"@"),
    Rule("upi", "UPI_ID", r"\b[a-zA-Z0-9._-]{2,256}@[a-zA-Z][a-zA-Z0-9]{1,64}\b", 0.55, "upi", hint=r"@"),
    Rule("phone", "PHONE", r"(?:\+91[ -]?|0)?\b[6-9][0-9]{4}[ -]?[0-9]{5}\b", 0.75, hint=r"[6-9][0-9]{4}[ -]?[0-9]{5}"),
    Rule("ifsc", "IFSC", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", 0.9, hint=r"[A-Z]0[A-Z0-9]{6}"),
    Rule("vehicle_bh", "VEHICLE_REG", r"\b[0-9]{2}[ -]?BH[ -]?[0-9]{4}[ -]?[A-Z]{1,2}\b", 0.85, hint=r"BH"),
    Rule("vehicle", "VEHICLE_REG", r"\b[A-Z]{2}[ -]?[0-9]{1,2}[ -]?[A-Z]{1,3}[ -]?[0-9]{4}\b", 0.7, "not_bh", hint=r"[A-Z][ -]?[0-9]{4}"),
    # Own definition: provider prefixes and web tokens.
    Rule("secret", "SECRET", r"\b(?:ghp_[A-Za-z0-9]{36}|AKIA[A-Z0-9]{16}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)\b", 0.95, hint=r"ghp_|AKIA|eyJ"),
)
CONTEXT_RULES = (
    Rule("bank_account", "BANK_ACCOUNT", r"\b[0-9]{9,18}\b", 0.6, context="BANK_ACCOUNT"),
    Rule("otp", "OTP", r"\b[0-9]{4,8}\b", 0.6, context="OTP"),
    Rule("pin_code", "PIN_CODE", r"\b[0-9]{6}\b", 0.65, context="PIN_CODE"),
    Rule("order_id", "ORDER_ID", r"\b[A-Za-z0-9][A-Za-z0-9-]{4,24}\b", 0.5, "digit", "ORDER_ID"),
    Rule("financial_value", "FINANCIAL_VALUE", r"(?:₹|Rs\.?|INR)[ ]?[0-9,]+(?:\.[0-9]{1,2})?", 0.75, context="FINANCIAL_VALUE"),
    Rule("date", "DATE", r"\b(?:[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}|[0-9]{1,2} +(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* +[0-9]{2,4})\b", 0.7, context="DATE"),
    Rule("voter_id", "VOTER_ID", r"\b[A-Za-z]{3}[0-9]{7}\b", 0.8, "digit", "VOTER_ID"),
    Rule("passport", "PASSPORT", r"\b[A-Za-z0-9]{6,12}\b", 0.8, "digit", "PASSPORT"),
    Rule("driving_licence", "DRIVING_LICENCE", r"\b[A-Za-z0-9][A-Za-z0-9 /-]{4,23}\b", 0.8, "digit", "DRIVING_LICENCE"),
    Rule("uan", "UAN", r"\b(?:[0-9][ -]?){11}[0-9]\b", 0.8, "digit", "UAN"),
    Rule("abha", "ABHA", r"\b(?:[0-9][ -]?){13}[0-9]\b", 0.8, "digit", "ABHA"),
    Rule("tracking_id", "TRACKING_ID", r"\b[A-Za-z0-9][A-Za-z0-9-]{2,29}\b", 0.8, "digit", "TRACKING_ID"),
)
SHAPES = (
    Rule("currency", "FINANCIAL_VALUE", r"(?:₹|Rs\.?|INR)[ ]?[0-9,]+(?:\.[0-9]{1,2})?", 0.5, hint=r"₹|Rs|INR"),
    Rule("digits_12", "UAN", r"\b[0-9]{12}\b", 0.3, hint=r"[0-9]{12}"),
    Rule("digits_9_18", "BANK_ACCOUNT", r"\b[0-9]{9,18}\b", 0.3, hint=r"[0-9]{9}"),
    Rule("voter", "VOTER_ID", r"\b[A-Z]{3}[0-9]{7}\b", 0.5, hint=r"[A-Z][0-9]{7}"),
    Rule("pin", "PIN_CODE", r"\b[1-9][0-9]{5}\b", 0.3, hint=r"[1-9][0-9]{5}"),
    Rule("date", "DATE", r"\b[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4}\b", 0.5, hint=r"[0-9][/-][0-9]"),
    Rule("bearer", "SECRET", r"Bearer [A-Za-z0-9._-]{16,}", 0.9, hint=r"Bearer "),
    Rule("opaque", "SECRET", r"\b[A-Za-z0-9_-]{32,}\b", 0.3, "letter_digit", hint=r"[A-Za-z0-9_-]{32}"),
)
UPI_HANDLES = ("okaxis", "okhdfcbank", "oksbi", "okicici", "okbizaxis", "ybl", "paytm", "apl", "ibl", "axl", "axisbank", "jio", "rzp", "freecharge", "idfcbank", "kotak", "upi")
CARD_PREFIX = r"^(4|5[1-5]|2(22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)|3[47]|60|65|81|82|508|353|356|6011|64[4-9]|3(0[0-5]|[68]))"

# The tables of the Verhoeff check (dihedral group, permutation), row by row.
VERHOEFF_D = "0123456789" "1234067895" "2340178956" "3401289567" "4012395678" "5987604321" "6598710432" "7659821043" "8765932104" "9876543210"
VERHOEFF_P = "0123456789" "1576283094" "5803796142" "8916043527" "9453126870" "4286573901" "2793806415" "7046913258"

# Policy classes with their risk rank, categories and actions (needed, not needed, then, else).
POLICY = (
    ("never_automated", 0, True, ("OTP", "CVV", "UPI_PIN", "SECRET"), "USER_ENTERS", "FILL", None, None),
    ("credential", 1, True, ("PASSWORD",), "USER_PROVIDED_ORIGIN_BOUND", "FILL", None, None),
    ("high", 2, True, ("AADHAAR", "PAN", "CARD_NUMBER", "BANK_ACCOUNT", "UPI_ID", "VOTER_ID", "PASSPORT", "DRIVING_LICENCE", "ABHA", "UAN"), "TOKEN_WITH_APPROVAL", "FILL", None, None),
    ("biometric", 3, True, ("FACE", "PHOTO"), "BLUR", "BLUR", None, None),
    ("documents", 4, True, ("ID_DOCUMENT", "CARD_IMAGE", "SIGNATURE", "QR", "UNSCANNED_MEDIA"), "FILL_REGION", "FILL_REGION", None, None),
    ("medium", 5, False, ("NAME", "PHONE", "EMAIL", "ADDRESS", "DOB", "HEALTH", "VEHICLE_REG", "FINANCIAL_VALUE", "PRIVATE_GENERIC"), "TOKEN", "FILL", None, None),
    ("quasi", 6, False, ("CITY", "PIN_CODE", "EMPLOYER", "DATE", "ORDER_ID", "IFSC", "TRACKING_ID"), "TOKEN_IF_IDENTITY_PRESENT", "TOKEN_IF_IDENTITY_PRESENT", "TOKEN", "ALLOW"),
)
IDENTITY = ("NAME", "EMAIL", "PHONE", "AADHAAR", "PAN", "CARD_NUMBER", "BANK_ACCOUNT", "UPI_ID", "DOB", "ADDRESS", "FACE", "VOTER_ID", "PASSPORT", "DRIVING_LICENCE", "ABHA", "UAN")
ACTIONS = ("ALLOW", "TOKEN", "TOKEN_WITH_APPROVAL", "FILL", "FILL_REGION", "BLUR", "USER_ENTERS", "USER_PROVIDED_ORIGIN_BOUND", "TOKEN_IF_IDENTITY_PRESENT")

# Phrases of field labels by category.
LABELS = (
    ("NAME", ("name", "full name", "father's name", "account holder", "accountholder", "cardholder", "card holder", "beneficiary", "नाम", "पिता का नाम", "खाताधारक")),
    ("EMAIL", ("email", "e-mail", "email address", "ई-मेल", "ईमेल")),
    ("PHONE", ("mobile", "phone", "phone number", "contact number", "मोबाइल", "फ़ोन", "फोन")),
    ("DOB", ("date of birth", "dob", "birth date", "जन्म तिथि")),
    ("ADDRESS", ("address", "street address", "पता")),
    ("CITY", ("city", "town", "शहर")),
    ("PIN_CODE", ("pin code", "pincode", "postal pin", "postal code", "zip code", "पिन कोड")),
    ("AADHAAR", ("aadhaar", "aadhar", "आधार")),
    ("PAN", ("pan", "pan number", "permanent account number")),
    ("CARD_NUMBER", ("card number", "credit card", "debit card", "कार्ड नंबर")),
    ("BANK_ACCOUNT", ("account number", "bank account", "खाता संख्या")),
    ("IFSC", ("ifsc", "ifsc code")),
    ("UPI_ID", ("upi id", "upi", "vpa")),
    ("FINANCIAL_VALUE", ("balance", "शेष राशि", "salary", "amount due")),
    ("EMPLOYER", ("employer", "company name", "नियोक्ता")),
    ("OTP", ("otp", "one time password", "one-time password", "verification code")),
    ("CVV", ("cvv", "cvc", "card verification value", "security code")),
    ("UPI_PIN", ("upi pin", "mpin", "m-pin")),
    ("VOTER_ID", ("voter id", "epic", "मतदाता पहचान पत्र")),
    ("PASSPORT", ("passport", "पासपोर्ट")),
    ("DRIVING_LICENCE", ("driving licence", "driving license", "ड्राइविंग लाइसेंस")),
    ("ABHA", ("abha", "ayushman bharat health account", "आभा", "आयुष्मान भारत स्वास्थ्य खाता")),
    ("UAN", ("uan", "universal account number", "यूनिवर्सल खाता संख्या", "यू ए एन")),
    ("TRACKING_ID", ("tracking id", "tracking number", "awb", "consignment", "खेप संख्या")),
    ("PRIVATE_GENERIC", ("gift message", "personal note", "निजी संदेश")),
    ("PASSWORD", ("password", "पासवर्ड")),
    ("HEALTH", ("blood group", "diagnosis", "medical condition", "health condition")),
    ("VEHICLE_REG", ("vehicle number", "registration number", "vehicle reg")),
    ("ORDER_ID", ("order id", "order number", "order no")),
    ("SECRET", ("api key", "secret key", "access token", "auth token", "token", "secret", "pin", "atm pin", "card pin", "security pin", "digit pin", "पिन")),
)
GENERIC_HEADS = ("name", "number", "code", "id", "address", "details", "no")
OVERRIDES = (("company name", "EMPLOYER"), ("pin code", "PIN_CODE"), ("security code", "CVV"))


def policy_rows() -> list[tuple]:
    return [(c, name, rank, locked, c in IDENTITY, need, other, then, els) for name, rank, locked, cats, need, other, then, els in POLICY for c in cats]


def load_policy(spark: SparkSession) -> DataFrame:
    """(category, class, risk_rank, locked, is_identity, needed, not_needed, cond_then, cond_else); some 40 rows."""
    bad = [r for r in policy_rows() if r[5] not in ACTIONS or r[6] not in ACTIONS or ("TOKEN_IF_IDENTITY_PRESENT" in (r[5], r[6])) != (r[7] is not None and r[8] is not None)]
    if bad:
        raise ValueError(f"policy rows with unknown or incomplete actions: {bad}")
    return spark.createDataFrame(policy_rows(), "category string, class string, risk_rank int, locked boolean, is_identity boolean, needed string, not_needed string, cond_then string, cond_else string")


def plain(phrase: str) -> str:
    """A phrase as labels are compared: lower case, marks as spaces, single spaces."""
    return " ".join("".join(" " if c in ".,;:!?'\"()[]{}/\\_-" else c for c in phrase.lower()).split())


def label_rows() -> list[tuple]:
    rows = [(c, plain(p), len(plain(p)), plain(p) in GENERIC_HEADS, True, i) for i, (p, c) in enumerate(OVERRIDES)]
    flat = [(c, p) for c, phrases in LABELS for p in phrases]
    return rows + [(c, plain(p), len(plain(p)), plain(p) in GENERIC_HEADS, False, len(rows) + i) for i, (c, p) in enumerate(flat)]


def load_labels(spark: SparkSession) -> DataFrame:
    """(category, phrase, phrase_len, is_generic, is_override, ord); some 110 rows."""
    return spark.createDataFrame(label_rows(), "category string, phrase string, phrase_len int, is_generic boolean, is_override boolean, ord int")


#: Words of the longest phrase.
MOST_WORDS = max(len(phrase.split()) for _, phrase, *_ in label_rows())
