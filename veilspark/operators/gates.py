"""Quality gates and validation of masked tables: each gate is one row of gate, passed, detail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import hmac_hex

#: Bytes of raw values above which the substring check finds its candidates by shared grams, not by broadcast.
#: Below it every text is searched for every value, so that many values would make the search quadratic.
LEAK_BYTES = 16 << 10
#: Characters of the pieces from which grams are taken.
PIECE = 256
#: Texts of one gram above which they are dealt out.
HOT_GRAM = 20_000


def gate(df: DataFrame, name: str, passed: Column, detail: Column) -> DataFrame:
    """One row from a frame of one row."""
    return df.select(F.lit(name).alias("gate"), passed.alias("passed"), detail.cast("string").alias("detail"))


def certify(gates: DataFrame) -> DataFrame:
    """certified if there is a gate and all pass, else failed."""
    sums = gates.agg(F.count("*").alias("n_gates"), F.count_if("passed").alias("n_passed"))
    return sums.withColumn("status", F.when((F.col("n_gates") > 0) & (F.col("n_gates") == F.col("n_passed")), "certified").otherwise("failed"))


def inconsistent(links: DataFrame) -> DataFrame:
    """(scope, original) that has more than one masked value."""
    return links.groupBy("scope", "original").agg(F.countDistinct("masked").alias("n")).where("n > 1")


def collisions(links: DataFrame) -> DataFrame:
    """(scope, masked) that stands for more than one original."""
    return links.groupBy("scope", "masked").agg(F.countDistinct("original").alias("n")).where("n > 1")


def grams(text: str, size: int) -> Column:
    """All substrings of so many characters, repeats included; those of a long text by pieces that overlap."""
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - size) / PIECE).cast("int")), lambda k: F.col(text).substr(k * PIECE + 1, F.lit(PIECE + size - 1)))
    each = lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - size + 1), lambda i: p.substr(i, F.lit(size)))
    return F.when(F.length(text) >= size, F.flatten(F.transform(pieces, each)))


def text_cells(frames: dict[str, DataFrame], without: tuple[str, ...] = ()) -> DataFrame:
    """entity, column_name, text: the distinct cells of all text columns of all tables."""
    parts = []
    for name, df in frames.items():
        texts = [c for c, t in df.dtypes if t == "string" and c not in without]
        if texts:
            cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("text")) for c in texts))
            parts.append(df.select(F.lit(name).alias("entity"), F.inline(cells)).where("text IS NOT NULL").distinct())
    return reduce(DataFrame.unionByName, parts)


def gram_pairs(whole: DataFrame, values: DataFrame, n: int) -> DataFrame:
    """__of, raw_value: texts that have the gram by which a value of at least n characters is looked for.

    An index counts every gram in the texts and in the values.  A value with a gram that
    no text has is in no text; each other one is looked for by the gram that the fewest
    texts have.  Texts of a gram above HOT_GRAM are dealt out over parts, and the values
    of such a gram go to each part.  Grams are known by 64 bits; two that share them make
    a pair too many, and the search itself decides.  All sides grow with the tables, so
    none is broadcast.
    """
    hashed = lambda text: F.array_distinct(F.transform(grams(text, n), lambda g: F.xxhash64(g)))
    held = whole.select("__of", F.explode(hashed("__text")).alias("__gram"))
    own = values.withColumn("__grams", hashed("raw_value")).select("raw_value", F.size("__grams").alias("__size"), F.explode("__grams").alias("__gram"))
    index = held.groupBy("__gram").agg(F.count("*").alias("__texts")).join(own.groupBy("__gram").agg(F.count("*").alias("__values")).hint("merge"), "__gram")
    best = own.join(index.hint("merge"), "__gram").groupBy("raw_value").agg(F.count("*").alias("__found"), F.max("__size").alias("__size"), F.min(F.struct("__texts", "__values", "__gram")).alias("__best"))
    keyed = best.where("__found = __size").select("raw_value", F.col("__best.__gram").alias("__gram"), F.ceil(F.col("__best.__texts") / HOT_GRAM).cast("int").alias("__parts"))
    needed = keyed.select("__gram", "__parts").distinct()
    texts = held.join(needed.hint("merge"), "__gram").select("__of", "__gram", F.pmod(F.xxhash64("__of"), F.col("__parts")).cast("int").alias("__part"))
    asked = keyed.select("raw_value", "__gram", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"))
    return texts.join(asked.hint("merge"), ["__gram", "__part"]).select("__of", "raw_value")


def leaks(texts: DataFrame, text: str, raw: DataFrame, value: str, shortest: int = 4) -> DataFrame:
    """Rows of ``texts`` whose text contains a raw value of at least ``shortest`` characters, the empty one aside.

    The values are broadcast for the search only while their measured size is within
    LEAK_BYTES; beyond it values and texts meet by an index of grams and are then
    searched.  Both ways find the same rows.
    """
    shortest = max(1, shortest)
    values = raw.select(F.col(value).cast("string").alias("raw_value")).where(F.length("raw_value") >= shortest).distinct()
    ranges = [(shortest, 2 * shortest), (2 * shortest, 4 * shortest), (4 * shortest, None)]
    within = lambda n, above: (F.length("raw_value") >= n) & (F.lit(True) if above is None else F.length("raw_value") < above)
    size, *filled = values.agg(F.sum(F.octet_length("raw_value")), *(F.count_if(within(*r)) for r in ranges)).first()  # four numbers
    if (size or 0) <= LEAK_BYTES:
        return texts.join(F.broadcast(values), F.col(text).contains(F.col("raw_value")), "left_semi")
    whole = texts.select(F.col(text).alias("__text")).where("__text IS NOT NULL").distinct().withColumn("__of", F.xxhash64("__text"))
    # texts are cut into grams only for lengths that values have
    met = reduce(DataFrame.unionByName, [gram_pairs(whole, values.where(within(*r)), r[0]) for r, n in zip(ranges, filled, strict=True) if n]).distinct()
    found = whole.join(met.hint("merge"), "__of").where(F.col("__text").contains(F.col("raw_value"))).select("__text").distinct()
    return texts.join(found.hint("merge"), F.col(text) == F.col("__text"), "left_semi")


def policy_coverage(resolved: DataFrame) -> DataFrame:
    """No column without a tier, and no protected one that passes through; the detail counts the values of such columns."""
    exposed = F.col("tier").isNull() | ((F.col("tier") != "non_sensitive") & (F.col("technique") == "passthrough"))
    sums = resolved.where(exposed).agg(F.count("*").alias("n"), F.coalesce(F.sum("n_values"), F.lit(0)).alias("values"))
    return gate(sums, "phi_pii_policy_coverage", F.col("n") == 0, F.col("values"))


def mean_ratio(both: DataFrame, largest: float = 10.0, least: int = 5) -> DataFrame:
    """Means before and after within a factor of each other; few values pass."""
    a, b = F.abs("source_mean"), F.abs("masked_mean")
    few = F.least("source_n", "masked_n") < least
    ratio = F.greatest(a, b) / F.greatest(F.least(a, b), F.lit(1e-12))
    ok = few | ((F.col("masked_nonzero") > 0) & (ratio <= largest))
    return gate(both, "distribution_shape", ok, F.when(few, F.lit("few values")).otherwise(F.lit("compared")))


def fingerprint(df: DataFrame, key: bytes) -> DataFrame:
    """n_rows and a keyed digest of the table that does not depend on row order."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in df.columns))
    number = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    sums = df.select(number.alias("h")).agg(F.count("*").alias("n_rows"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).alias("s"))
    return sums.select("n_rows", hmac_hex(F.concat_ws(":", F.col("n_rows").cast("string"), F.col("x").cast("string"), F.col("s").cast("string")), "fingerprint", key).alias("digest"))
