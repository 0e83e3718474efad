"""Privacy analytics on Spark: find, pseudonymise, redact and audit personal data in tables."""
