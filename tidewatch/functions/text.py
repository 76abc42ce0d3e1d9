"""Small text functions: entropy, checksums, shapes, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID4 = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-4[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a byte; 0 for an empty text, null for null.

    Each distinct pair of hex digits is counted once against the rest, so the cost is the length
    times the distinct bytes.
    """
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    n = F.size(pairs).cast("double")
    part = F.transform(F.array_sort(F.array_distinct(pairs)), lambda d: F.size(F.filter(pairs, lambda x: x == d)) / n)
    return F.when(F.length(text) == 0, F.lit(0.0)).when(text.isNotNull(), F.aggregate(part, F.lit(0.0), lambda a, p: a - p * F.log2(p)))


def is_hex(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]+$")


def is_base64(text: Column) -> Column:
    return text.rlike("^[A-Za-z0-9+/_-]+={0,2}$")


def is_uuid4(text: Column) -> Column:
    return text.rlike(UUID4)


def high_entropy_blob(text: Column) -> Column:
    """Hex of 16 characters or more and 3 bits, or base64 of 24 or more and 4 bits."""
    h = entropy(text)
    return (is_hex(text) & (F.length(text) >= 16) & (h >= 3.0)) | (is_base64(text) & (F.length(text) >= 24) & (h >= 4.0))


def high_entropy_token(text: Column, dictionary: tuple[str, ...] = (), min_length: int = 20, min_bits: float = 4.0) -> Column:
    """Neither a dictionary word nor a version-4 UUID; a blob, or long and of high entropy."""
    known = F.lower(text).isin(*dictionary) if dictionary else F.lit(False)
    return ~known & ~is_uuid4(text) & (high_entropy_blob(text) | ((F.octet_length(text) >= min_length) & (entropy(text) >= min_bits)))


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid Luhn checksum."""
    chars = F.split(F.reverse(digits), "")
    doubled = F.transform(F.filter(chars, lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.when(digits.rlike("^[0-9]+$"), F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0).otherwise(F.lit(False))


def is_card(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & luhn(digits)


def length_class(text: Column) -> Column:
    n = F.octet_length(text)
    return F.when(n <= 20, "s").when(n <= 40, "m").when(n <= 80, "l").otherwise("xl")


def salted_checksum(value: Column, salt: str) -> Column:
    """The first 32 bits of a salted hash, as hex."""
    return F.substring(F.sha2(F.concat(value, F.lit(salt)).cast("binary"), 256), 1, 8)


def short_id(text: Column) -> Column:
    return F.when(F.length(text) <= 10, text).otherwise(F.concat(F.left(text, F.lit(6)), F.lit("…"), F.right(text, F.lit(4))))


def ulid_millis(ulid: Column) -> Column:
    """Milliseconds in the first ten characters of a ULID; null if they are none."""
    base32 = F.translate(F.upper(F.substring(ulid, 1, 10)), CROCKFORD, "0123456789ABCDEFGHIJKLMNOPQRSTUV")
    return F.when(F.upper(ulid).rlike(f"^[0-7][{CROCKFORD}]{{25}}$"), F.conv(base32, 32, 10).cast("long"))


def argv_of(raw: Column) -> Column:
    """NUL-separated arguments, without the empty one at the end."""
    return F.split(F.regexp_replace(raw, "\\x00$", ""), "\\x00")


def same_counts(a: Column, b: Column) -> Column:
    """Equality of two count maps; zero entries and null maps count for nothing."""
    def canon(m: Column) -> Column:
        return F.array_sort(F.map_entries(F.map_filter(F.coalesce(m, F.create_map().cast("map<string,bigint>")), lambda k, v: v != 0)))

    return canon(a) == canon(b)
