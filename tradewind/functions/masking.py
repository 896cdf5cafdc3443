"""Masking of personal data as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A column holds personal data when its lower-cased name
# contains one of these.  Matching is by substring, so for instance
# "last_passwd_gen" and "other_notes" are masked too.
PERSONAL_DATA = [
    "email",
    "passwd",
    "password",
    "secure_key",
    "reset_password_token",
    "firstname",
    "lastname",
    "phone",
    "phone_mobile",
    "address1",
    "address2",
    "other",
    "dni",
    "vat_number",
]

# Context keys that never reach a log.
LOG_PRIVATE_KEYS = ["email", "phone", "firstname", "lastname", "address", "postcode", "password"]

SECRET = "***MASKED***"


def mask_email(email: Column) -> Column:
    """Keep two characters and the domain, replace the rest by a short hash.

    Text without exactly one ``@`` becomes a hash at a made-up domain.
    """
    parts = F.split(email, "@")
    local = parts.getItem(0)
    return F.when(
        F.size(parts) == 2,
        F.concat(
            F.substring(local, 1, 2),
            F.lit("***"),
            F.substring(F.sha2(local, 256), 1, 8),
            F.lit("@"),
            F.get(parts, F.lit(1)),
        ),
    ).when(email.isNotNull(), F.concat(mask_hash(email), F.lit("@anonymized.local")))


def mask_phone(phone: Column) -> Column:
    """Keep the first two and last two of the digits and plus signs."""
    digits = F.regexp_replace(phone, "[^0-9+]", "")
    length = F.length(digits)
    return F.when(length <= 4, F.lit("****")).otherwise(
        F.concat(
            F.substring(digits, 1, 2),
            F.repeat(F.lit("*"), length - 4),
            F.substring(digits, -2, 2),
        )
    )


def mask_secret(value: Column) -> Column:
    return F.when(value.isNotNull(), F.lit(SECRET))


def mask_hash(value: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 hash."""
    return F.substring(F.sha2(value, 256), 1, 16)


def mask_for(name: str):
    """The mask for a column name, or ``None`` when it holds no personal data."""
    lowered = name.lower()
    if not any(word in lowered for word in PERSONAL_DATA):
        return None
    if "email" in lowered:
        return mask_email
    if "phone" in lowered:
        return mask_phone
    if any(word in lowered for word in ("passwd", "password", "secure_key", "token")):
        return mask_secret
    return mask_hash


def anonymize(df: DataFrame) -> DataFrame:
    """Mask every column that holds personal data; the others are untouched.

    Masked columns become text.  NULL, ``''`` and ``'0'`` pass through.
    """
    masked = {}
    for f in df.schema.fields:
        mask = mask_for(f.name)
        if mask is not None and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            text = F.col(f"`{f.name}`").cast("string")
            masked[f.name] = F.when(text.isin("", "0"), text).otherwise(mask(text))
    return df.withColumns(masked) if masked else df


def log_redact(context: Column) -> Column:
    """Drop private keys (any case) from a JSON object; NULL when none is left.

    Values keep their JSON type.  Text that is not a JSON object becomes NULL,
    so nothing unread can reach a log.
    """
    entries = F.from_json(context, "map<string,variant>")
    kept = F.map_filter(entries, lambda key, _: ~F.lower(key).isin(LOG_PRIVATE_KEYS))
    return F.when(F.size(kept) > 0, F.to_json(kept))
