"""A whole estate of linked tables from one seed.

Every value is a hash of seed, tag and the row's numbers, so any task makes any row
again.  Children know their parents by number: a parent is drawn by a hash modulo the
number of parents, and its id is written from that number, so foreign keys resolve
without a join.  Where ids count through all children of all members, the counts of
ranges of members give each range its first number.  Edge cases hit exactly
max(1, round(n * rate)) of n rows: an affine permutation of the numbers, other for each
case, puts the chosen ones first, and no row needs to know another.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .masking import CITIES, FIRST_NAMES, LAST_NAMES, STREETS, SUFFIXES

#: Members whose children are counted together.
RANGE = 10_000


@dataclass(frozen=True)
class Scale:
    """Rows of the independent tables, and children of one parent at most."""

    members: int
    plans: int
    providers: int
    pharmacies: int
    diagnoses: int
    procedures: int
    addresses: int = 2
    coverages: int = 2
    claims: int = 4
    lines: int = 3
    encounters: int = 3
    labs: int = 3
    prescriptions: int = 3


# The named scales.
SCALES = {
    "tiny": Scale(25, 6, 10, 5, 30, 30),
    "developer": Scale(250, 12, 60, 25, 80, 80, 2, 2, 6, 4, 4, 4, 4),
    "qa": Scale(2_500, 18, 400, 150, 150, 150, 2, 3, 8, 5, 5, 4, 5),
    "performance": Scale(20_000, 25, 1_500, 600, 200, 200, 2, 3, 10, 5, 6, 4, 6),
}


@dataclass(frozen=True)
class Rates:
    """Shares of rows that an edge case hits; at least one row is hit."""

    null: float = 0.06
    duplicate_person: float = 0.02
    duplicate_row: float = 0.015
    orphan: float = 0.02
    malformed: float = 0.03
    late: float = 0.04
    missing_child: float = 0.05


# What malformed cells hold, and the ids that no parent has.
BAD_PHONES, BAD_ZIPS = ["555-CALL-ME", "(000) 000-0000", "N/A"], ["ABCDE", "1234", "00000-XXXX"]
BAD_DATES, BAD_RESULTS = ["TBD", "UNKNOWN", ""], ["PENDING", ">999", "see note"]
NO_PROVIDER_OF_CLAIM, NO_PROVIDER_OF_ENCOUNTER, NO_DIAGNOSIS = "SYN-PRV-99999", "SYN-PRV-99998", "SYN-Z99.9-UNMAPPED"
PHANTOM_CLAIM = 9_000_000
OFFSETS = {"address": 900_000, "claim": 800_000, "prescription": 700_000, "partner": 600_000}
PLAN_TYPES, METALS, MARKETS = ["HMO", "PPO", "EPO", "POS"], ["Bronze", "Silver", "Gold", None], ["Commercial", "Medicare", "Medicaid"]
SPECIALTIES = ["Family", "Cardiology", "Pediatrics", "Surgery", "Behavioral Health"]
STATES = ["AZ", "CO", "GA", "IL", "ME", "NY", "OR", "TX"]
DRUGS = [("SYN-NDC-10001", "Amoxil"), ("SYN-NDC-10002", "Zestor"), ("SYN-NDC-10003", "Lipanol"), ("SYN-NDC-10004", "Metfora")]
TESTS = [("SYN-LAB-A1C", "A1C", "%", "4-6"), ("SYN-LAB-LDL", "LDL", "mg/dL", "<130"), ("SYN-LAB-TSH", "TSH", "mIU/L", "0.4-4")]


def hits(n: int, rate: float) -> int:
    """How many of n rows an edge case hits."""
    return min(n, max(1, round(n * rate))) if n > 0 else 0


def permutation(n: int, seed: int, case: str) -> tuple[int, int]:
    """(a, b) such that (a * i + b) mod n passes through all of 0..n-1."""
    digest = hashlib.sha256(f"{seed}:{case}".encode()).digest()
    a, b = int.from_bytes(digest[:8]) % max(1, n), int.from_bytes(digest[8:16]) % max(1, n)
    a = max(1, a)
    while math.gcd(a, n) != 1:
        a = a % n + 1
    return a, b


def padded(number: Column, digits: int, prefix: str) -> Column:
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, digits, "0") if digits else text)


def wide(number: Column, digits: int, prefix: str) -> Column:
    """At least ``digits`` digits, more where the number has them."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) < digits, F.lpad(text, digits, "0")).otherwise(text))


class LinkedEstate:
    """All tables of an estate, lazily; ``frames`` by entity, ``planted`` for what was planted."""

    def __init__(self, spark: SparkSession, scale: Scale, seed: int, rates: Rates = Rates(), today: str = "2025-09-30"):
        self.spark, self.scale, self.seed, self.rates, self.today = spark, scale, seed, rates, F.lit(today).cast("date")
        self.people = scale.members + hits(scale.members, rates.duplicate_person)

    # draws

    def draw(self, tag: str, *keys: str | Column) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{self.seed}:{tag}"), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys))), 1, 8), 16, 10).cast("long")

    def pick(self, names: list, tag: str, *keys: str) -> Column:
        return F.element_at(F.array(*map(F.lit, names)), (self.draw(tag, *keys) % len(names) + 1).cast("int"))

    def money(self, tag: str, low: int, high: int, *keys: str) -> Column:
        return (low * 100 + self.draw(tag, *keys) % ((high - low) * 100)) / 100

    def date(self, tag: str, days: int, *keys: str) -> Column:
        return F.date_sub(self.today, (self.draw(tag, *keys) % days).cast("int"))

    def hit(self, case: str, n: int, rate: float, i: str = "i") -> Column:
        """Whether row ``i`` of 0..n-1 is among the exactly ``hits(n, rate)`` chosen ones."""
        a, b = permutation(n, self.seed, case)
        kind = "long" if n < 1 << 31 else "decimal(38,0)"
        return (F.lit(a).cast(kind) * F.col(i).cast(kind) + F.lit(b)) % n < hits(n, rate)

    def person(self, i: Column) -> Column:
        return wide(i + 1, 6, "SYN-MBR-")

    def numbered(self, fan: Column, first: int = 1) -> DataFrame:
        """i of every person, j from 0 of its children, and their number through all persons."""
        people = self.spark.range(self.people).select(F.col("id").alias("i")).withColumn("fan", fan).withColumn("range", F.floor(F.col("i") / RANGE))
        sums = people.groupBy("range").agg(F.sum("fan").alias("own"))
        before = sums.select("range", F.coalesce(F.sum("own").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each 10,000 persons
        inside = F.sum("fan").over(Window.partitionBy("range").orderBy("i")) - F.col("fan")
        out = people.withColumn("inside", inside).join(before, "range").where("fan > 0")
        out = out.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fan") - 1)))
        return out.select("i", "j", (F.col("before") + F.col("inside") + F.col("j") + first).alias("number"))

    def fan(self, tag: str, most: int, least: Column | int = 0) -> Column:
        """Children of person i, from ``least`` to ``most``."""
        low = F.lit(least).cast("long") if isinstance(least, int) else least.cast("long")
        return low + self.draw(tag, "i") % (F.greatest(low, F.lit(most)) - low + 1)

    # independent tables

    @cached_property
    def plan(self) -> DataFrame:
        i = self.spark.range(self.scale.plans).select(F.col("id").alias("i"))
        return i.select(wide(F.col("i") + 1, 4, "SYN-PLN-").alias("plan_id"), F.concat(F.lit("Plan "), self.pick(CITIES, "plan-name", "i"), F.lit(" "), self.pick(PLAN_TYPES, "plan-type", "i")).alias("plan_name"), self.pick(PLAN_TYPES, "plan-type", "i").alias("plan_type"), self.pick(METALS, "metal", "i").alias("metal_tier"), self.pick(MARKETS, "market", "i").alias("market_segment"))

    @cached_property
    def provider(self) -> DataFrame:
        i = self.spark.range(self.scale.providers).select(F.col("id").alias("i"))
        group = F.col("i") % 4 == 3
        person = F.concat(self.pick(FIRST_NAMES, "provider-first", "i"), F.lit(" "), self.pick(LAST_NAMES, "provider-last", "i"), F.lit(", MD"))
        return i.select(wide(F.col("i") + 1, 5, "SYN-PRV-").alias("provider_id"), padded(self.draw("npi", "i") % 10**9, 9, "9").alias("npi"), F.when(group, F.concat(self.pick(LAST_NAMES, "provider-last", "i"), F.lit(" Care Group"))).otherwise(person).alias("provider_name"), F.when(group, "Organization").otherwise("Individual").alias("provider_type"), self.pick(SPECIALTIES, "specialty", "i").alias("specialty"), self.pick(CITIES, "provider-city", "i").alias("city"), self.pick(STATES, "provider-state", "i").alias("state"), F.lit(True).alias("is_active"))

    @cached_property
    def pharmacy(self) -> DataFrame:
        i = self.spark.range(self.scale.pharmacies).select(F.col("id").alias("i"))
        return i.select(wide(F.col("i") + 1, 5, "SYN-PHM-").alias("pharmacy_id"), F.concat(self.pick(CITIES, "pharmacy-city", "i"), F.lit(" Pharmacy "), (F.col("i") + 1).cast("string")).alias("pharmacy_name"), self.pick(["Corner Rx", "Plaza Rx", None], "chain", "i").alias("chain_name"), self.pick(CITIES, "pharmacy-city", "i").alias("city"), self.pick(STATES, "pharmacy-state", "i").alias("state"), padded(self.draw("pharmacy-zip", "i") % 10**5, 5, "").alias("zip_code"), padded(self.draw("pharmacy-npi", "i") % 10**9, 9, "8").alias("npi"))

    def diagnosis_code(self, i: Column) -> Column:
        """Two digits and a letter turn together, so that 2,600 codes differ; beyond them the number follows."""
        letter = F.char(F.lit(65) + (F.floor(i / 100) % 26).cast("int"))
        return F.concat(F.lit("SYN-"), letter, F.lpad((i % 100).cast("string"), 2, "0"), F.lit("."), F.floor(i / 2600).cast("string"))

    @cached_property
    def diagnosis(self) -> DataFrame:
        i = self.spark.range(self.scale.diagnoses).select(F.col("id").alias("i"))
        return i.select(self.diagnosis_code(F.col("i")).alias("diagnosis_code"), F.concat(F.lit("Condition "), (F.col("i") + 1).cast("string")).alias("description"), F.lit("SYN-ICD-10").alias("code_system"))

    @cached_property
    def procedure(self) -> DataFrame:
        i = self.spark.range(self.scale.procedures).select(F.col("id").alias("i"))
        return i.select(wide(F.col("i") + 99_000, 5, "SYN-").alias("procedure_code"), F.concat(F.lit("Service "), (F.col("i") + 1).cast("string")).alias("description"), F.lit("SYN-CPT").alias("code_system"))

    # people

    @cached_property
    def member(self) -> DataFrame:
        """Members, and after them the same persons again under new ids."""
        n, r = self.scale.members, self.rates
        one = self.spark.range(n).select(F.col("id").alias("i"))
        rows = one.withColumn("own", F.col("i")).unionByName(self.twins())
        ssn = F.concat_ws("-", padded(self.draw("ssn", "i") % 1000, 3, ""), padded(self.draw("ssn-2", "i") % 100, 2, ""), padded(self.draw("ssn-3", "i") % 10_000, 4, ""))
        return rows.select(self.person(F.col("own")).alias("member_id"), self.pick(FIRST_NAMES, "first", "i").alias("first_name"), self.pick(LAST_NAMES, "last", "i").alias("last_name"), F.when(~self.hit("null", n, r.null), self.date("birth", 34_000, "i").cast("string")).alias("date_of_birth"), self.pick(["F", "M", "U"], "gender", "i").alias("gender"), ssn.alias("ssn"), wide(F.col("own") + 1, 6, "SYN-MRN-").alias("medical_record_number"), self.date("effective", 1825, "i").cast("string").alias("effective_date"), F.lit(None).cast("string").alias("term_date"), F.lit(True).alias("is_active"), F.lit(1).cast("long").alias("row_version"), F.lit("enrollment-full").alias("extract_batch_id"))

    def twins(self) -> DataFrame:
        """i of each duplicated person and its own number after the last member: the place in the permutation."""
        n = self.scale.members
        a, b = permutation(n, self.seed, "twin")
        back = pow(a, -1, n) if n > 1 else 0
        k = F.col("id").cast("decimal(38,0)")
        at = ((k - b + n) % n * F.lit(back).cast("decimal(20,0)")) % n
        return self.spark.range(hits(n, self.rates.duplicate_person)).select(at.cast("long").alias("i"), (F.col("id") + n).alias("own"))

    @cached_property
    def member_demographics(self) -> DataFrame:
        n, r = self.scale.members, self.rates
        rows = self.spark.range(n).select(F.col("id").alias("i")).where(~self.hit("no-demographics", n, r.missing_child))
        phone = F.concat(F.lit("("), padded(200 + self.draw("phone", "i") % 800, 3, ""), F.lit(") "), padded(self.draw("phone-2", "i") % 1000, 3, ""), F.lit("-"), padded(self.draw("phone-3", "i") % 10_000, 4, ""))
        email = F.concat(F.lower(self.pick(FIRST_NAMES, "first", "i")), (F.col("i") + 1).cast("string"), F.lit("@example.org"))
        return rows.select(self.person(F.col("i")).alias("member_id"), F.when(~self.hit("null", n, r.null), self.pick(FIRST_NAMES, "middle", "i")).alias("middle_name"), self.pick(["Group A", "Group B", "Declined", None], "race", "i").alias("race"), self.pick(["Yes", "No", None], "ethnicity", "i").alias("ethnicity"), self.pick(["en", "es", "vi", None], "language", "i").alias("preferred_language"), self.pick(["single", "married", None], "marital", "i").alias("marital_status"), email.alias("email"), F.when(self.hit("malformed", n, r.malformed), self.pick(BAD_PHONES, "bad-phone", "i")).otherwise(phone).alias("phone"))

    @cached_property
    def address(self) -> DataFrame:
        n, r = self.scale.members, self.rates
        rows = self.spark.range(n).select(F.col("id").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), self.fan("addresses", self.scale.addresses, 1) - 1)))
        home = F.col("j") == 0
        owner = F.when(home & self.hit("orphan-address", n, r.orphan), wide(F.col("i") + 1 + n + OFFSETS["address"], 6, "SYN-MBR-")).otherwise(self.person(F.col("i")))
        street = F.concat((self.draw("house", "i", "j") % 9899 + 100).cast("string"), F.lit(" "), self.pick(STREETS, "street", "i", "j"), F.lit(" "), self.pick(SUFFIXES, "suffix", "i", "j"))
        zip_code = F.when(home & self.hit("malformed", n, r.malformed), self.pick(BAD_ZIPS, "bad-zip", "i")).otherwise(padded(self.draw("zip", "i", "j") % 10**5, 5, ""))
        return rows.select(F.concat(wide(F.col("i") + 1, 6, "SYN-ADR-"), F.lit("-"), F.col("j").cast("string")).alias("address_id"), owner.alias("member_id"), F.when(home, "home").otherwise("mailing").alias("address_type"), F.when(home | ~self.hit("null", n, r.null), street).alias("line1"), F.when(self.draw("unit", "i", "j") % 5 == 0, F.concat(F.lit("Unit "), (self.draw("unit-2", "i", "j") % 99 + 1).cast("string"))).alias("line2"), self.pick(CITIES, "city", "i", "j").alias("city"), self.pick(STATES, "state", "i", "j").alias("state"), zip_code.alias("zip_code"), F.lit("US").alias("country"), self.date("effective", 1825, "i").cast("string").alias("effective_date"))

    @cached_property
    def coverage(self) -> DataFrame:
        """Every coverage has a member and a plan, as its source enforces; some members have none."""
        none = self.hit("no-coverage", self.people, self.rates.missing_child)
        rows = self.numbered(F.when(none, F.lit(0).cast("long")).otherwise(self.fan("coverages", self.scale.coverages, 1)))
        start = self.date("coverage", 1095, "number")
        return rows.select(wide(F.col("number"), 6, "SYN-COV-").alias("coverage_id"), self.person(F.col("i")).alias("member_id"), wide(self.draw("plan", "number") % self.scale.plans + 1, 4, "SYN-PLN-").alias("plan_id"), padded(self.draw("group", "number") % 9000 + 1000, 4, "SYN-GRP-").alias("group_number"), start.cast("string").alias("effective_date"), F.when(self.draw("ends", "number") % 10 >= 6, F.date_add(start, 365).cast("string")).alias("term_date"), F.lit("active").alias("coverage_status"), F.lit(1).cast("long").alias("row_version"))

    # claims

    def claim_cases(self) -> dict[str, Column]:
        n, r = self.people, self.rates
        return {"orphan_member": self.hit("claim-member", n, r.orphan), "orphan_provider": self.hit("claim-provider", n, r.orphan), "malformed": self.hit("claim-malformed", n, r.malformed), "late": self.hit("claim-late", n, r.late), "no_lines": self.hit("claim-no-lines", n, r.missing_child), "twice": self.hit("claim-twice", n, r.duplicate_row), "orphan_code": self.hit("claim-code", n, r.orphan) & ~self.hit("claim-no-lines", n, r.missing_child)}

    @cached_property
    def claim_numbers(self) -> DataFrame:
        """i, j, number of every claim, the cases that hit it, and its amounts; hit members have a claim at least."""
        cases = self.claim_cases()
        needed = reduce(Column.__or__, cases.values())
        rows = self.numbered(self.fan("claims", self.scale.claims, F.when(needed, 1).otherwise(0))).withColumns(cases)
        status = self.pick(["paid", "denied", "pending", "reversed"], "claim-status", "number")
        rows = rows.withColumns({"status": status, "billed": self.money("billed", 50, 15_000, "number")})
        rows = rows.withColumn("allowed", F.when(F.col("status") != "denied", F.round(F.col("billed") * (40 + self.draw("allowed", "number") % 56) / 100, 2)))
        return rows.withColumn("paid", F.round(F.col("allowed") * (50 + self.draw("paid", "number") % 51) / 100, 2))

    @cached_property
    def claim(self) -> DataFrame:
        rows = self.claim_numbers.withColumn("copy", F.explode(F.when(F.col("twice"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        rows = rows.withColumn("service", self.date("service", 730, "number"))
        rows = rows.withColumn("submitted", F.date_add("service", (self.draw("submitted", "number") % 30 + 1).cast("int")))
        owner = F.when(F.col("orphan_member"), wide(F.col("i") + self.people + OFFSETS["claim"], 6, "SYN-MBR-")).otherwise(self.person(F.col("i")))
        provider = F.when(F.col("orphan_provider"), NO_PROVIDER_OF_CLAIM).otherwise(wide(self.draw("claim-by", "number") % self.scale.providers + 1, 5, "SYN-PRV-"))
        paid = F.when(F.col("malformed"), -F.abs(F.coalesce("paid", "billed"))).otherwise(F.col("paid"))
        extracted = F.when(F.col("late"), F.date_sub(self.today, (self.draw("seen-late", "number") % 5 + 1).cast("int"))).otherwise(F.date_add("submitted", (self.draw("seen", "number") % 3 + 1).cast("int")))
        adjudicated = F.when(F.col("status").isin("paid", "denied"), F.date_add("submitted", (self.draw("adjudicated", "number") % 10 + 1).cast("int")).cast("string"))
        return rows.select(wide(F.col("number"), 7, "SYN-CLM-").alias("claim_id"), owner.alias("member_id"), F.lit(None).cast("string").alias("coverage_id"), provider.alias("provider_id"), self.pick(["professional", "institutional", "pharmacy"], "claim-type", "number").alias("claim_type"), "status", F.col("service").cast("string").alias("service_date"), F.col("submitted").cast("string").alias("submitted_date"), adjudicated.alias("adjudicated_date"), F.col("billed").alias("billed_amount"), F.col("allowed").alias("allowed_amount"), paid.alias("paid_amount"), extracted.cast("string").alias("source_extracted_at"), F.when(F.year("service") <= 2024, "claims-2024Q4").otherwise("claims-2025Q1").alias("extract_batch_id"))

    @cached_property
    def n_claims(self) -> int:
        """Rows of the claim table, repeated ones too: one number."""
        return self.claim.count()

    @cached_property
    def claim_line(self) -> DataFrame:
        """Lines of claims, and lines whose claim was never written."""
        rows = self.claim_numbers.where("NOT no_lines").withColumn("lines", self.draw("lines", "number") % self.scale.lines + 1)
        rows = rows.withColumn("line", F.explode(F.sequence(F.lit(1).cast("long"), F.col("lines"))))
        code = F.when(F.col("orphan_code") & (F.col("line") == 1), NO_DIAGNOSIS).otherwise(self.diagnosis_code(self.draw("diagnosis", "number", "line") % self.scale.diagnoses))
        charge = F.round(F.col("billed") / F.col("lines"), 2)
        shape = lambda id_, claim, code, charge, allowed, paid, units: [id_.alias("claim_line_id"), claim.alias("claim_id"), F.col("line").alias("line_number"), code.alias("diagnosis_code"), wide(self.draw("procedure", "number", "line") % self.scale.procedures + 99_000, 5, "SYN-").alias("procedure_code"), units.alias("units"), charge.alias("charge_amount"), allowed.alias("allowed_amount"), paid.alias("paid_amount"), F.lit(None).cast("string").alias("revenue_code")]
        line_id = lambda prefix: F.concat(wide(F.col("number"), 7, prefix), F.lit("-"), F.col("line").cast("string"))
        real = rows.select(*shape(line_id("SYN-CLN-"), wide(F.col("number"), 7, "SYN-CLM-"), code, charge, F.when(F.col("allowed").isNotNull(), F.round(charge * 0.8, 2)), F.when(F.col("paid").isNotNull() | F.col("malformed"), F.round(charge * 0.7, 2)), self.draw("units", "number", "line") % 3 + 1))
        lost = self.spark.range(max(1, int(self.n_claims * self.rates.orphan))).select((F.col("id") + PHANTOM_CLAIM).alias("number"), F.lit(1).cast("long").alias("line"))
        none = F.lit(None).cast("double")
        phantom = lost.select(*shape(line_id("SYN-CLN-"), wide(F.col("number"), 7, "SYN-CLM-"), self.diagnosis_code(self.draw("diagnosis", "number", "line") % self.scale.diagnoses), self.money("phantom", 20, 500, "number"), none, none, F.lit(1).cast("long")))
        return real.unionByName(phantom)

    # other events of members

    @cached_property
    def prescription(self) -> DataFrame:
        n, r = self.people, self.rates
        cases = {"orphan": self.hit("rx-member", n, r.orphan), "malformed": self.hit("rx-malformed", n, r.malformed), "null_": self.hit("rx-null", n, r.null)}
        rows = self.numbered(self.fan("prescriptions", self.scale.prescriptions, F.when(reduce(Column.__or__, cases.values()), 1).otherwise(0))).withColumns(cases)
        owner = F.when(F.col("orphan"), wide(F.col("i") + n + OFFSETS["prescription"], 6, "SYN-MBR-")).otherwise(self.person(F.col("i")))
        quantity = self.money("quantity", 10, 90, "number")
        drug = F.element_at(F.array(*(F.struct(F.lit(a).alias("code"), F.lit(b).alias("name")) for a, b in DRUGS)), (self.draw("drug", "number") % len(DRUGS) + 1).cast("int"))
        return rows.select(wide(F.col("number"), 7, "SYN-RX-").alias("prescription_id"), owner.alias("member_id"), wide(self.draw("rx-at", "number") % self.scale.pharmacies + 1, 5, "SYN-PHM-").alias("pharmacy_id"), F.when(~F.col("null_"), wide(self.draw("rx-by", "number") % self.scale.providers + 1, 5, "SYN-PRV-")).alias("prescriber_provider_id"), drug["code"].alias("ndc_code"), drug["name"].alias("drug_name"), (30 * (self.draw("days", "number") % 3 + 1)).alias("days_supply"), F.when(F.col("malformed"), -quantity).otherwise(quantity).alias("quantity"), self.date("fill", 365, "number").cast("string").alias("fill_date"), (self.draw("refill", "number") % 6).alias("refill_number"), self.pick(["filled", "reversed", "rejected"], "rx-status", "number").alias("status"))

    @cached_property
    def encounter_numbers(self) -> DataFrame:
        n, r = self.people, self.rates
        cases = {"orphan": self.hit("encounter-provider", n, r.orphan), "malformed": self.hit("encounter-malformed", n, r.malformed), "late": self.hit("encounter-late", n, r.late)}
        rows = self.numbered(self.fan("encounters", self.scale.encounters, F.when(reduce(Column.__or__, cases.values()), 1).otherwise(0))).withColumns(cases)
        return rows.withColumns({"kind": self.pick(["outpatient", "inpatient", "emergency", "telehealth"], "encounter-type", "number"), "admit": self.date("admit", 730, "number")})

    @cached_property
    def encounter(self) -> DataFrame:
        stay = F.date_add("admit", F.when(F.col("kind") == "inpatient", self.draw("stay", "number") % 6).otherwise(0).cast("int")).cast("string")
        discharge = F.when(F.col("malformed") & (F.col("kind") != "inpatient"), self.pick(BAD_DATES, "bad-date", "number")).when(~F.col("kind").isin("outpatient", "telehealth"), stay)
        provider = F.when(F.col("orphan"), NO_PROVIDER_OF_ENCOUNTER).otherwise(wide(self.draw("encounter-by", "number") % self.scale.providers + 1, 5, "SYN-PRV-"))
        extracted = F.when(F.col("late"), F.date_sub(self.today, (self.draw("encounter-late", "number") % 3 + 1).cast("int"))).otherwise(F.date_add("admit", (self.draw("encounter-seen", "number") % 4 + 1).cast("int")))
        return self.encounter_numbers.select(wide(F.col("number"), 7, "SYN-ENC-").alias("encounter_id"), self.person(F.col("i")).alias("member_id"), provider.alias("provider_id"), F.col("kind").alias("encounter_type"), F.col("admit").cast("string").alias("admit_date"), discharge.alias("discharge_date"), F.concat(self.pick(CITIES, "facility", "number"), F.lit(" Medical Center")).alias("facility_name"), self.pick(["completed", "in_progress", "cancelled"], "encounter-status", "number").alias("status"), extracted.cast("string").alias("source_extracted_at"))

    def lab(self, rows: DataFrame, id_: Column, encounter: Column, member: Column, collected: Column, value: Column, source: str, version: Column, *keys: str) -> DataFrame:
        test = F.element_at(F.array(*(F.struct(*(F.lit(x).alias(k) for k, x in zip(("code", "name", "unit", "range"), t, strict=True))) for t in TESTS)), (self.draw("test", *keys) % len(TESTS) + 1).cast("int"))
        return rows.select(id_.alias("lab_result_id"), encounter.alias("encounter_id"), member.alias("member_id"), test["code"].alias("test_code"), test["name"].alias("test_name"), value.alias("result_value"), test["unit"].alias("result_unit"), test["range"].alias("reference_range"), self.pick(["Normal", "High", "Low", None], "flag", *keys).alias("abnormal_flag"), collected.cast("string").alias("collected_date"), F.date_add(collected, 1).cast("string").alias("resulted_date"), F.lit(source).alias("source"), version.alias("schema_version"))

    @cached_property
    def lab_ehr(self) -> DataFrame:
        rows = self.encounter_numbers.withColumn("k", F.explode(F.expr(f"filter(sequence(0L, {self.scale.labs}L), x -> x > 0)"))).where(F.col("k") <= self.draw("labs", "number") % (self.scale.labs + 1))
        value = (self.money("result", 50, 200, "number", "k")).cast("string")
        bad = F.col("malformed") & (self.draw("bad-result", "number", "k") % 10 < 3)
        id_ = F.concat(wide(F.col("number"), 7, "SYN-LAB-"), F.lit("-"), F.col("k").cast("string"))
        return self.lab(rows, id_, wide(F.col("number"), 7, "SYN-ENC-"), self.person(F.col("i")), F.col("admit"), F.when(bad, self.pick(BAD_RESULTS, "bad-value", "number", "k")).otherwise(value), "ehr_primary", F.lit("v2"), "number", "k")

    @cached_property
    def lab_partner(self) -> DataFrame:
        """A tenth of the members' number: every fifth of a member that is not enrolled, every third in the old shape."""
        rows = self.spark.range(max(1, self.people // 10)).select(F.col("id").alias("p"))
        member = F.when(F.col("p") % 5 == 0, wide(F.col("p") + self.people + OFFSETS["partner"], 6, "SYN-MBR-")).otherwise(self.person(self.draw("partner", "p") % self.people))
        return self.lab(rows, wide(F.col("p") + 1, 7, "SYN-LAB-P"), F.lit(None).cast("string"), member, self.date("partner-date", 730, "p"), self.money("partner-result", 50, 200, "p").cast("string"), "partner_reference_lab", F.when(F.col("p") % 3 == 0, "v1").otherwise("v2"), "p")

    @cached_property
    def lab_result(self) -> DataFrame:
        return self.lab_ehr.unionByName(self.lab_partner)

    def frames(self) -> dict[str, DataFrame]:
        return {e: getattr(self, e) for e in ENTITIES}

    def planted(self) -> DataFrame:
        """entity, edge_case, n: the rows that hold each planted case, counted in the tables themselves."""
        tallies = [
            ("member", self.member, {"null_birth_date": F.count_if(F.col("date_of_birth").isNull()), "duplicate_person": F.count("ssn") - F.countDistinct("ssn", "first_name", "last_name", "effective_date")}),
            ("member_demographics", self.member_demographics, {"malformed_phone": F.count_if(F.col("phone").isin(BAD_PHONES)), "without": F.lit(self.scale.members) - F.count("*")}),
            ("address", self.address, {"orphan_member": F.count_if(F.regexp_extract("member_id", r"(\d+)$", 1).cast("long") > self.people), "malformed_zip": F.count_if(F.col("zip_code").isin(BAD_ZIPS))}),
            ("coverage", self.coverage, {"members_without": F.lit(self.people) - F.countDistinct("member_id")}),
            ("claim", self.claim_numbers, {f"members_{c}": F.countDistinct(F.when(F.col(c), F.col("i"))) for c in ("orphan_member", "orphan_provider", "malformed", "late", "no_lines", "twice")}),
            ("claim_line", self.claim_line, {"phantom_claim": F.count_if(F.regexp_extract("claim_id", r"(\d+)$", 1).cast("long") >= PHANTOM_CLAIM)}),
            ("prescription", self.prescription, {"members_orphan": F.countDistinct(F.when(F.regexp_extract("member_id", r"(\d+)$", 1).cast("long") >= self.people + OFFSETS["prescription"], F.col("member_id"))), "members_null_prescriber": F.countDistinct(F.when(F.col("prescriber_provider_id").isNull(), F.col("member_id")))}),
            ("encounter", self.encounter_numbers, {f"members_{c}": F.countDistinct(F.when(F.col(c), F.col("i"))) for c in ("orphan", "malformed", "late")}),
            ("lab_result", self.lab_partner, {"not_enrolled": F.count_if(F.regexp_extract("member_id", r"(\d+)$", 1).cast("long") > self.people), "old_shape": F.count_if(F.col("schema_version") == "v1")}),
        ]
        parts = []
        for name, df, cases in tallies:
            sums = df.agg(*(c.cast("long").alias(k) for k, c in cases.items()))
            parts.append(sums.select(F.lit(name).alias("entity"), F.inline(F.array(*(F.struct(F.lit(k).alias("edge_case"), F.col(k).alias("n")) for k in cases)))))
        return reduce(DataFrame.unionByName, parts)


ENTITIES = ["plan", "provider", "pharmacy", "diagnosis", "procedure", "member", "member_demographics", "address", "coverage", "claim", "claim_line", "prescription", "encounter", "lab_result"]
#: child, foreign key, parent, primary key of every link.
LINKS = [
    ("member_demographics", "member_id", "member", "member_id"), ("address", "member_id", "member", "member_id"), ("coverage", "member_id", "member", "member_id"), ("coverage", "plan_id", "plan", "plan_id"),
    ("claim", "member_id", "member", "member_id"), ("claim", "provider_id", "provider", "provider_id"), ("claim_line", "claim_id", "claim", "claim_id"), ("claim_line", "diagnosis_code", "diagnosis", "diagnosis_code"), ("claim_line", "procedure_code", "procedure", "procedure_code"),
    ("prescription", "member_id", "member", "member_id"), ("prescription", "pharmacy_id", "pharmacy", "pharmacy_id"), ("prescription", "prescriber_provider_id", "provider", "provider_id"),
    ("encounter", "member_id", "member", "member_id"), ("encounter", "provider_id", "provider", "provider_id"), ("lab_result", "encounter_id", "encounter", "encounter_id"), ("lab_result", "member_id", "member", "member_id"),
]


def unresolved(frames: dict[str, DataFrame]) -> DataFrame:
    """child, key, n_rows, n_unresolved of every link: rows whose parent the parent's table lacks; nulls refer to nothing."""
    parts = []
    for child, fk, parent, pk in LINKS:
        refs = frames[child].select(F.col(fk).alias("id")).where("id IS NOT NULL")
        known = frames[parent].select(F.col(pk).alias("id")).distinct().withColumn("found", F.lit(1))
        parts.append(refs.join(known, "id", "left").agg(F.count("*").alias("n_rows"), (F.count("*") - F.count("found")).alias("n_unresolved")).select(F.lit(child).alias("child"), F.lit(fk).alias("key"), "n_rows", "n_unresolved"))
    return reduce(DataFrame.unionByName, parts)
