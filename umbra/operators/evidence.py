"""Label-independent evidence: signals for and against a candidate, and their score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Words of containers and shapes of values that aren't personal; what autocomplete tokens say.
CONTAINERS = (
    "catalogue", "catalog", "reference number", "reference numbers", "references", "order id", "order number", "invoice", "invoices", "receipt number", "sku", "batch", "lot number", "product", "products",
    "item", "items", "quantity", "qty", "stock", "inventory", "docket", "shipment", "consignment", "tracking", "specification", "specifications", "part number", "model number",
)
SHAPES = (
    r"(?i)^[A-Z]{2,5}-[0-9]{2,6}(?:-[0-9]{1,6})?$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(?::[0-9]{2})?", r"^v?[0-9]+\.[0-9]+\.[0-9]+(?:[-+][A-Za-z0-9_.]+)?$",
    r"(?i)^#(?:[0-9a-f]{3}|[0-9a-f]{6}|[0-9a-f]{8})$", r"^[0-9]{1,3}(?:\.[0-9]+)?%$", r"(?i)^[0-9]+ ?[x×] ?[0-9]+(?: ?[x×] ?[0-9]+)?$", r"(?i)^[0-9]+(?:\.[0-9]+)? ?(?:[kmgt]i?b|bytes?)$",
)
USERNAME = r"^[a-z][a-z0-9_.]{2,15}$"
STRENGTH = {"self_describing": 5, "structured": 3, "weak": 1}
AUTOCOMPLETE = {
    "given-name": "NAME", "family-name": "NAME", "additional-name": "NAME", "name": "NAME", "email": "EMAIL", "tel": "PHONE", "tel-national": "PHONE", "tel-local": "PHONE", "street-address": "ADDRESS",
    "address-line1": "ADDRESS", "address-line2": "ADDRESS", "address-line3": "ADDRESS", "postal-code": "PIN_CODE", "bday": "DOB", "bday-day": "DOB", "bday-month": "DOB", "bday-year": "DOB",
    "cc-number": "CARD_NUMBER", "cc-csc": "CVV", "one-time-code": "OTP", "organization": "EMPLOYER", "address-level2": "CITY",
}
# The categories that the type of an input speaks for.
INPUT_TYPES = {
    "email": ("EMAIL",), "tel": ("PHONE",), "date": ("DOB", "DATE"), "month": ("DOB", "DATE"), "number": ("BANK_ACCOUNT", "PIN_CODE", "OTP", "FINANCIAL_VALUE", "UAN"),
    "password": ("PASSWORD", "SECRET", "OTP", "CVV", "UPI_PIN"),
}
DETECTED, UNCERTAIN, REPEATED = 5, 3, 3


def map_autocomplete(attribute: Column) -> Column:
    """The category of the first known token of an autocomplete attribute."""
    known = F.create_map(*[F.lit(x) for kv in AUTOCOMPLETE.items() for x in kv])
    found = F.filter(F.transform(F.split(F.lower(attribute), r"\s+"), lambda t: known[t]), lambda c: c.isNotNull())
    return F.get(found, F.lit(0))


def negative_signals(container: Column, value: Column, n_targets: Column, category: Column, checksum: Column, in_search: Column | None = None) -> Column:
    """array<struct<name, points>> of what speaks against a candidate."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(container, F.lit(""))), "[^a-z]+", " "), F.lit(" "))
    in_container = F.exists(F.array(*map(F.lit, CONTAINERS)), lambda t: F.contains(padded, F.concat(F.lit(" "), t, F.lit(" "))))
    harmless = F.lit(False)
    for shape in SHAPES:
        harmless = harmless | F.trim(value).rlike(shape)
    checks = (("checksum_fail", -4, checksum == "fail"), ("non_pii_container", -3, in_container), ("non_pii_shape", -3, harmless), ("repeated", -2, n_targets >= REPEATED), ("in_search_scope", -2, F.lit(False) if in_search is None else in_search), ("username", -2, (category == "SECRET") & F.trim(value).rlike(USERNAME)))
    return F.array_compact(F.array(*[F.when(F.coalesce(on, F.lit(False)), F.struct(F.lit(n).alias("name"), F.lit(p).alias("points"))) for n, p, on in checks]))


def score_evidence(candidates: DataFrame) -> DataFrame:
    """candidates with score, verdict, claimed and score_confidence.

    candidates: category, value, strength, checksum, bound, autocomplete, container, n_targets; and where they are known,
    input_type, length_agrees, container_category, identity_seen, in_search. The claimed category is that of the bound label,
    else of the autocomplete attribute, else of the shape.
    """
    known = lambda c, kind: F.col(c) if c in candidates.columns else F.lit(None).cast(kind)
    claimed = F.coalesce("bound", "autocomplete", "category")
    points = F.element_at(F.create_map(*[F.lit(x) for kv in STRENGTH.items() for x in kv]), F.col("strength"))
    plus = F.when(F.col("checksum") == "pass", 5).otherwise(0) + points + F.when(F.col("bound").isNotNull(), 3).otherwise(0) + F.when(F.col("autocomplete") == claimed, 3).otherwise(0)
    types = F.create_map(*[x for k, v in INPUT_TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    agrees = F.array_contains(F.element_at(types, F.lower(known("input_type", "string"))), claimed)
    for on, points in ((agrees, 2), (known("length_agrees", "boolean"), 2), (known("container_category", "string") == claimed, 2), (known("identity_seen", "boolean"), 1)):
        plus = plus + F.when(F.coalesce(on, F.lit(False)), points).otherwise(0)
    minus = F.aggregate(negative_signals(F.col("container"), F.col("value"), F.col("n_targets"), F.col("category"), F.col("checksum"), known("in_search", "boolean")), F.lit(0), lambda a, s: a + s.points)
    scored = candidates.withColumns({"claimed": claimed, "score": plus + minus})
    s = F.col("score")
    confidence = F.when(s <= 0, 0.0).when(s >= DETECTED, F.least(F.lit(0.95), 0.75 + 0.05 * (s - DETECTED))).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(0.55), 0.15 * s)))
    return scored.withColumns({"verdict": F.when(s >= DETECTED, "DETECTED").when(s >= UNCERTAIN, "UNCERTAIN").otherwise("NOT_DETECTED"), "score_confidence": F.round(confidence, 6)})
