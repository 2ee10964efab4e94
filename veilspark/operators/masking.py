"""Masking techniques as column expressions, and the masking of whole tables.

Every technique is a pure function of value, scope and key: no shuffle, equal values of
one scope stay equal in every table.  Null stays null.  ``Masker(key, hidden=True)``
computes digests in an Arrow UDF so that the key stays out of plans; the plain form
runs JVM-side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import hmac_hex, hmac_hex_hidden, number
from .policy import Rule, resolve

REDACTED, BAD_DATE = "***REDACTED***", "INVALID-DATE-REDACTED"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
FIRST_NAMES = ["Ada", "Bela", "Cleo", "Dara", "Emil", "Faye", "Gino", "Hana", "Ivo", "Jana", "Kito", "Lena", "Milo", "Nora", "Otis", "Pia"]
LAST_NAMES = ["Abel", "Brandt", "Castel", "Dorn", "Eklund", "Faber", "Grau", "Holm", "Ilves", "Jansen", "Krall", "Lind", "Moreau", "Nagy", "Olsen", "Pichler"]
STREETS = ["Alder", "Birch", "Cedar", "Dogwood", "Elm", "Fir", "Gum", "Hazel"]
SUFFIXES = ["St", "Ave", "Rd", "Ln"]
CITIES = ["Ashford", "Bramley", "Colton", "Dunmore", "Easton", "Farley", "Glenrock", "Hartwell"]
DOMAINS = ["example.com", "example.net", "example.org"]


def entry(names: list[str], digest: Column, start: int) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (number(digest, start, 8) % len(names) + 1).cast("int"))


def padded(digest: Column, start: int, digits: int) -> Column:
    return F.lpad((number(digest, start, 12) % 10**digits).cast("string"), digits, "0")


def redact(c: Column, keep_length: bool = False, mark: str = "*") -> Column:
    if keep_length:
        return F.when(c.isNotNull(), F.regexp_replace(c.cast("string"), "(?s).", mark))
    return F.when(c.isNotNull(), F.lit(REDACTED))


def nullify(c: Column, kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def hash_unkeyed(c: Column, scope: str) -> Column:
    return F.concat(F.lit("HASH-"), F.substring(F.sha2(F.concat(F.lit(f"{scope}:"), c.cast("string")), 256), 1, 16))


def pseudonym(digest: Column, n: int = 32) -> Column:
    return F.substring(digest, 1, n)


def token(digest: Column, n: int = 12) -> Column:
    if not 1 <= n <= 64:
        raise ValueError("a token has 1 to 64 digits")
    return F.concat(F.lit("TKN-"), F.upper(F.substring(digest, 1, n)))


def shift_date(c: Column, digest: Column, most: int = 365) -> Column:
    """ISO dates moved by up to ``most`` days either way, as text; anything else becomes the marker."""
    text = F.substring(c.cast("string"), 1, 10)
    date = F.when(text.rlike(ISO_DATE), F.try_to_date(text, "yyyy-MM-dd"))
    moved = F.date_add(date, (number(digest, 1, 8) % (2 * most + 1) - most).cast("int")).cast("string")
    return F.when(c.isNotNull(), F.coalesce(moved, F.lit(BAD_DATE)))


def ssn(d: Column) -> Column:
    return F.concat_ws("-", padded(d, 1, 3), padded(d, 13, 2), padded(d, 25, 4))


def first_name(d: Column) -> Column:
    return entry(FIRST_NAMES, d, 1)


def last_name(d: Column) -> Column:
    return entry(LAST_NAMES, d, 9)


def full_name(d: Column) -> Column:
    return F.concat(first_name(d), F.lit(" "), last_name(d))


def email(d: Column) -> Column:
    return F.concat(F.lower(first_name(d)), padded(d, 17, 4), F.lit("@"), entry(DOMAINS, d, 33))


def phone(d: Column) -> Column:
    return F.concat(F.lit("("), padded(d, 1, 3), F.lit(") "), padded(d, 13, 3), F.lit("-"), padded(d, 25, 4))


def street(d: Column) -> Column:
    return F.concat((number(d, 17, 8) % 9899 + 100).cast("string"), F.lit(" "), entry(STREETS, d, 1), F.lit(" "), entry(SUFFIXES, d, 9))


def city(d: Column) -> Column:
    return entry(CITIES, d, 1)


def zip_code(d: Column) -> Column:
    return padded(d, 1, 5)


def identifier(d: Column) -> Column:
    return F.concat(F.lit("SYN-MASKED-"), F.upper(F.substring(d, 1, 8)))


def numeric(c: Column, d: Column, whole: bool = False) -> Column:
    """A share of max(2|v|, 100) to two places; whole numbers stay whole; text that is no number counts as 0."""
    value = F.coalesce(c.try_cast("double"), F.lit(0.0))
    share = (number(d, 1, 13) % 1_000_000) / 1_000_000
    out = F.floor(share * F.greatest(F.abs(value) * 2, F.lit(100.0)) * 100 + 0.5) / 100
    return F.when(c.isNotNull(), out.cast("long") if whole else out)


def same_shape(c: Column, d: Column) -> Column:
    """Digits to digits, letters to letters of their case, the rest kept: one digest byte for each place."""
    text = c.cast("string")

    def one(i: Column, h: Column) -> Column:
        ch = F.substr(text, i, F.lit(1))
        n = F.conv(F.substr(h, F.pmod(i - 1, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int") + F.floor((i - 1) / 32).cast("int") * 7
        letter = lambda low, size: F.char(F.pmod(n, F.lit(size)) + low)
        return F.when(ch.between("0", "9"), letter(48, 10)).when(ch.between("A", "Z"), letter(65, 26)).when(ch.between("a", "z"), letter(97, 26)).otherwise(ch)

    # the digest is bound once a cell; inside the lambda of the places it would be computed again for each of them
    made = F.transform(F.array(d), lambda h: F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: one(i, h)), ""))
    return F.when(F.length(text) > 0, F.element_at(made, 1)).otherwise(text)


SYNTHESIZERS = {"ssn": ssn, "email": email, "phone": phone, "first_name": first_name, "last_name": last_name, "full_name": full_name, "street_address": street, "city": city, "zip_code": zip_code, "identifier": identifier}


@dataclass(frozen=True)
class Masker:
    """Applies rules with one key."""

    key: bytes
    hidden: bool = True

    def digest(self, c: Column, scope: str) -> Column:
        return (hmac_hex_hidden if self.hidden else hmac_hex)(c, scope, self.key)

    def column(self, c: Column, rule: Rule, whole: bool = False) -> Column:
        d = self.digest(c, rule.scope)
        match rule.technique:
            case "passthrough":
                return c
            case "nullification":
                return nullify(c)
            case "redaction":
                return redact(c)
            case "hashing":
                return hash_unkeyed(c, rule.scope)
            case "hmac_pseudonymization":
                return pseudonym(d)
            case "tokenization":
                return token(d)
            case "date_shift":
                return shift_date(c, d)
        if rule.field_type == "numeric":
            return numeric(c, d, whole)
        default = full_name if rule.technique == "name_replacement" else street if rule.technique == "address_replacement" else None
        make = SYNTHESIZERS.get(rule.field_type, default)
        return F.when(c.isNotNull(), make(d)) if make else same_shape(c, d)

    def columns(self, df: DataFrame, scopes: dict[str, str]) -> DataFrame:
        """Pseudonyms of the named columns; names that the frame lacks are skipped."""
        return df.withColumns({c: pseudonym(self.digest(F.col(c), s)) for c, s in scopes.items() if c in df.columns})

    def rules(self, df: DataFrame, tiers: dict[str, str]) -> dict[str, Rule]:
        return {c: resolve(tiers.get(c), c) for c in df.columns}

    def table(self, df: DataFrame, tiers: dict[str, str]) -> DataFrame:
        """One projection that masks every column by its tier's rule."""
        whole = {c for c, t in df.dtypes if t in ("int", "bigint", "smallint", "tinyint")}
        return df.select(*(self.column(F.col(c), r, c in whole).alias(c) for c, r in self.rules(df, tiers).items()))

    def estate(self, frames: dict[str, DataFrame], tiers: dict[str, dict[str, str]]) -> dict[str, DataFrame]:
        return {name: self.table(df, tiers.get(name, {})) for name, df in frames.items()}


def quarantine(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n: values that could not be shifted, without the values."""
    sums = df.agg(*(F.count_if(F.col(c) == BAD_DATE).alias(c) for c in columns))
    return sums.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*columns))).alias("column", "n"))
