"""The linked estate at the size of the given tables; SQL states rows and laws on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import linked_estate as L
from ..operators.masking import CITIES, FIRST_NAMES, LAST_NAMES
from .base import SEED, query, table


def made(spark, sf_dir) -> L.LinkedEstate:
    """A member for each customer, a plan for each nation, and so on."""
    size = {t: table(spark, sf_dir, t).count() for t in ("customer", "nation", "supplier", "part")}
    return L.LinkedEstate(spark, L.Scale(size["customer"], size["nation"], size["supplier"], size["supplier"], size["part"], size["part"]), SEED)


def draw(tag: str, i: str = "i") -> str:
    return f"CAST('0x' || substr(md5('{SEED}:{tag}:' || CAST({i} AS VARCHAR)), 1, 8) AS BIGINT)"


def one_of(entries: list, tag: str) -> str:
    return f"[{', '.join('NULL' if x is None else repr(x) for x in entries)}][{draw(tag)} % {len(entries)} + 1]"


def counted(of: str) -> str:
    return f"(SELECT unnest(range(count(*))) AS i FROM {of})"


def number(digits: int, prefix: str, value: str = "i + 1") -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"'{prefix}' || CASE WHEN length({text}) < {digits} THEN lpad({text}, {digits}, '0') ELSE {text} END"


def zeros(digits: int, prefix: str, value: str) -> str:
    return f"'{prefix}' || lpad(CAST({value} AS VARCHAR), {digits}, '0')"


@query("estate_plans", f"SELECT {number(4, 'SYN-PLN-')} AS plan_id, 'Plan ' || {one_of(CITIES, 'plan-name')} || ' ' || {one_of(L.PLAN_TYPES, 'plan-type')} AS plan_name, {one_of(L.PLAN_TYPES, 'plan-type')} AS plan_type, {one_of(L.METALS, 'metal')} AS metal_tier, {one_of(L.MARKETS, 'market')} AS market_segment FROM {counted('nation')}")
def estate_plans(spark, sf_dir):
    return made(spark, sf_dir).plan


@query("estate_providers", f"SELECT {number(5, 'SYN-PRV-')} AS provider_id, {zeros(9, '9', draw('npi') + ' % 1000000000')} AS npi, CASE WHEN i % 4 = 3 THEN {one_of(LAST_NAMES, 'provider-last')} || ' Care Group' ELSE {one_of(FIRST_NAMES, 'provider-first')} || ' ' || {one_of(LAST_NAMES, 'provider-last')} || ', MD' END AS provider_name, CASE WHEN i % 4 = 3 THEN 'Organization' ELSE 'Individual' END AS provider_type, {one_of(L.SPECIALTIES, 'specialty')} AS specialty, {one_of(CITIES, 'provider-city')} AS city, {one_of(L.STATES, 'provider-state')} AS state, true AS is_active FROM {counted('supplier')}")
def estate_providers(spark, sf_dir):
    return made(spark, sf_dir).provider


@query("estate_pharmacies", f"SELECT {number(5, 'SYN-PHM-')} AS pharmacy_id, {one_of(CITIES, 'pharmacy-city')} || ' Pharmacy ' || CAST(i + 1 AS VARCHAR) AS pharmacy_name, {one_of(['Corner Rx', 'Plaza Rx', None], 'chain')} AS chain_name, {one_of(CITIES, 'pharmacy-city')} AS city, {one_of(L.STATES, 'pharmacy-state')} AS state, {zeros(5, '', draw('pharmacy-zip') + ' % 100000')} AS zip_code, {zeros(9, '8', draw('pharmacy-npi') + ' % 1000000000')} AS npi FROM {counted('supplier')}")
def estate_pharmacies(spark, sf_dir):
    return made(spark, sf_dir).pharmacy


@query("estate_diagnoses", f"SELECT 'SYN-' || chr(CAST(65 + i // 100 % 26 AS INT)) || lpad(CAST(i % 100 AS VARCHAR), 2, '0') || '.' || CAST(i // 2600 AS VARCHAR) AS diagnosis_code, 'Condition ' || CAST(i + 1 AS VARCHAR) AS description, 'SYN-ICD-10' AS code_system FROM {counted('part')}")
def estate_diagnoses(spark, sf_dir):
    return made(spark, sf_dir).diagnosis


@query("estate_procedures", f"SELECT 'SYN-' || CAST(99000 + i AS VARCHAR) AS procedure_code, 'Service ' || CAST(i + 1 AS VARCHAR) AS description, 'SYN-CPT' AS code_system FROM {counted('part')}")
def estate_procedures(spark, sf_dir):
    return made(spark, sf_dir).procedure


# Laws of the tables that hang on members: sizes, exact shares of edge cases, keys and links


def facts(entity: str, df: DataFrame, found: dict[str, Column]) -> DataFrame:
    """entity, law, n: one row a law from one pass."""
    sums = df.agg(*(c.cast("long").alias(k) for k, c in found.items()))
    return sums.select(F.lit(entity).alias("entity"), F.inline(F.array(*(F.struct(F.lit(k).alias("law"), F.col(k).alias("n")) for k in found))))


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def lost(frames: dict[str, DataFrame], child: str) -> DataFrame:
    """The unresolved rows of every link of one child."""
    found = L.unresolved(frames)
    return found.where(F.col("child") == child).select(F.col("child").alias("entity"), F.concat(F.lit("unresolved_"), "key").alias("law"), F.col("n_unresolved").alias("n"))


def planted(e: L.LinkedEstate, entity: str) -> DataFrame:
    return e.planted().where(F.col("entity") == entity).select("entity", F.col("edge_case").alias("law"), "n")


def tail(c: str) -> Column:
    return F.regexp_extract(c, r"(\d+)$", 1).cast("long")


def share(n: str, rate: float) -> str:
    return f"greatest(1, CAST(round_even({n} * {rate}, 0) AS BIGINT))"


SIZE = f"size AS (SELECT m, m + {share('m', 0.02)} AS p FROM (SELECT count(*) AS m FROM customer))"


def laws_sql(rows: list[tuple[str, str, str]]) -> str:
    return f"WITH {SIZE} " + " UNION ALL ".join(f"SELECT '{e}' AS entity, '{law}' AS law, CAST({n} AS BIGINT) AS n FROM size" for e, law, n in rows)


@query("estate_members", laws_sql([
    ("member", "rows", "p"), ("member", "keys", "p"), ("member", "record_numbers", "p"), ("member", "duplicate_person", share("m", 0.02)),
    ("member_demographics", "rows", f"m - {share('m', 0.05)}"), ("member_demographics", "unresolved_member_id", "0"),
    ("address", "rows", f"(SELECT sum(1 + {draw('addresses')} % 2) FROM {counted('customer')})"), ("address", "keys", f"(SELECT sum(1 + {draw('addresses')} % 2) FROM {counted('customer')})"), ("address", "homes", "m"), ("address", "malformed_zip", share("m", 0.03)), ("address", "unresolved_member_id", share("m", 0.02)),
]))
def estate_members(spark, sf_dir):
    e = made(spark, sf_dir)
    f = e.frames()
    return union([
        facts("member", f["member"], {"rows": F.count("*"), "keys": F.countDistinct("member_id"), "record_numbers": F.countDistinct("medical_record_number"), "duplicate_person": F.count_if(tail("member_id") > e.scale.members)}),
        facts("member_demographics", f["member_demographics"], {"rows": F.count("*")}), lost(f, "member_demographics"),
        facts("address", f["address"], {"rows": F.count("*"), "keys": F.countDistinct("address_id"), "homes": F.count_if(F.col("address_type") == "home"), "malformed_zip": F.count_if(F.col("zip_code").isin(L.BAD_ZIPS))}), lost(f, "address"),
    ])


@query("coverage_laws", laws_sql([("coverage", "members_with", f"p - {share('p', 0.05)}"), ("coverage", "beyond_two", "0"), ("coverage", "gaps", "0"), ("coverage", "unresolved_member_id", "0"), ("coverage", "unresolved_plan_id", "0")]))
def coverage_laws(spark, sf_dir):
    e = made(spark, sf_dir)
    each = e.coverage.groupBy("member_id").agg(F.count("*").alias("k"), F.max(tail("coverage_id")).alias("last"))
    return union([facts("coverage", each, {"members_with": F.count("*"), "beyond_two": F.count_if(F.col("k") > 2), "gaps": F.max("last") - F.sum("k")}), lost(e.frames(), "coverage")])


@query("claim_laws", laws_sql([
    *(("claim", f"members_{c}", share("p", r)) for c, r in (("orphan_member", 0.02), ("orphan_provider", 0.02), ("malformed", 0.03), ("late", 0.04), ("no_lines", 0.05), ("twice", 0.015))),
    ("claim", "gaps", "0"), ("claim", "paid_above_billed", "0"), ("claim_line", "phantom_claims_beyond_two_percent", "0"), ("claim_line", "phantom_claims_unresolved", "0"), ("claim_line", "uneven_lines", "0"), ("claim_line", "unresolved_procedure_code", "0"),
]))
def claim_laws(spark, sf_dir):
    e = made(spark, sf_dir)
    f = e.frames()
    phantom = F.count_if(tail("claim_id") >= L.PHANTOM_CLAIM)
    links = lost(f, "claim_line")
    lines = f["claim_line"].groupBy("claim_id").agg(F.count("*").alias("k"), F.max("line_number").alias("last"))
    beyond = facts("claim_line", f["claim_line"], {"phantom_claims_beyond_two_percent": phantom - F.lit(max(1, int(e.n_claims * 0.02)))})
    apart = links.where("law = 'unresolved_claim_id'").join(F.broadcast(f["claim_line"].agg(phantom.alias("made")))).select("entity", F.lit("phantom_claims_unresolved").alias("law"), (F.col("n") - F.col("made")).alias("n"))
    return union([
        planted(e, "claim"), facts("claim", e.claim, {"gaps": F.max(tail("claim_id")) - F.countDistinct("claim_id"), "paid_above_billed": F.count_if(F.col("paid_amount") > F.col("billed_amount"))}),
        beyond, apart, facts("claim_line", lines, {"uneven_lines": F.count_if(F.col("k") != F.col("last"))}), links.where("law = 'unresolved_procedure_code'"),
    ])


@query("estate_prescriptions", laws_sql([("prescription", "members_orphan", share("p", 0.02)), ("prescription", "members_null_prescriber", share("p", 0.06)), ("prescription", "gaps", "0"), ("prescription", "unresolved_pharmacy_id", "0"), ("prescription", "unresolved_prescriber_provider_id", "0")]))
def estate_prescriptions(spark, sf_dir):
    e = made(spark, sf_dir)
    return union([planted(e, "prescription"), facts("prescription", e.prescription, {"gaps": F.max(tail("prescription_id")) - F.count("*")}), lost(e.frames(), "prescription").where("law <> 'unresolved_member_id'")])


@query("estate_encounters_and_labs", laws_sql([("encounter", f"members_{c}", share("p", r)) for c, r in (("orphan", 0.02), ("malformed", 0.03), ("late", 0.04))] + [("encounter", "gaps", "0"), ("encounter", "unresolved_member_id", "0"), ("encounter", "provider_ids_that_no_one_has", "1"), ("lab_result", "repeated_keys", "0"), ("lab_result", "unresolved_encounter_id", "0")]))
def estate_encounters_and_labs(spark, sf_dir):
    e = made(spark, sf_dir)
    f = e.frames()
    strangers = f["encounter"].select("provider_id").distinct().join(f["provider"], "provider_id", "left_anti")
    return union([
        planted(e, "encounter"), facts("encounter", e.encounter, {"gaps": F.max(tail("encounter_id")) - F.count("*")}), lost(f, "encounter").where("law = 'unresolved_member_id'"), facts("encounter", strangers, {"provider_ids_that_no_one_has": F.count("*")}),
        facts("lab_result", e.lab_ehr, {"repeated_keys": F.count("*") - F.countDistinct("lab_result_id")}), lost(f, "lab_result").where("law = 'unresolved_encounter_id'"),
    ])


@query("partner_lab_laws", laws_sql([("lab_result", "rows", "greatest(1, p // 10)"), ("lab_result", "old_shape", "(greatest(1, p // 10) + 2) // 3"), ("lab_result", "not_enrolled", "(greatest(1, p // 10) + 4) // 5"), ("lab_result", "unresolved_member_id", "(greatest(1, p // 10) + 4) // 5")]))
def partner_lab_laws(spark, sf_dir):
    e = made(spark, sf_dir)
    return union([facts("lab_result", e.lab_partner, {"rows": F.count("*")}), planted(e, "lab_result"), lost(e.frames() | {"lab_result": e.lab_partner}, "lab_result").where("law = 'unresolved_member_id'")])


# The rows themselves: SQL numbers the children of all members and draws every cell again.

_PEOPLE = "people AS (SELECT m, p, unnest(range(p)) AS i FROM size)"
_TODAY = "DATE '2025-09-30'"


def hit_sql(case: str, rate: float) -> str:
    """Whether person ``i`` is among the chosen ones: the affine permutation of the case, its factor the next one coprime to p."""
    eight = lambda start: f"CAST(CAST('0x' || substr(sha256('{SEED}:{case}'), {start}, 16) AS UBIGINT) % CAST(p AS UBIGINT) AS HUGEINT)"
    factor = f"list_filter(list_transform(range(0, 1000), lambda x: (greatest(1, {eight(1)}) - 1 + x) % p + 1), lambda y: gcd(y, CAST(p AS HUGEINT)) = 1)[1]"
    return f"(((SELECT {factor} FROM size) * i + (SELECT {eight(17)} FROM size)) % p < least(p, {share('p', rate)}))"


def keyed(tag: str, *keys: str) -> str:
    return draw(tag, " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in keys))


def pick_sql(entries: list, tag: str, *keys: str) -> str:
    return f"[{', '.join('NULL' if x is None else repr(x) for x in entries)}][{keyed(tag, *keys)} % {len(entries)} + 1]"


def money_sql(tag: str, low: int, high: int, *keys: str) -> str:
    return f"(({low * 100} + {keyed(tag, *keys)} % {(high - low) * 100}) / 100)"


def date_sql(tag: str, days: int, *keys: str) -> str:
    return f"CAST({_TODAY} - CAST({keyed(tag, *keys)} % {days} AS INT) AS DATE)"


def cents(e: str) -> str:
    """Two places, half away from zero, of the number as it is written."""
    return f"CAST(round(CAST(CAST(({e}) AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DOUBLE)"


def text(date: str) -> str:
    return f"CAST(CAST({date} AS DATE) AS VARCHAR)"


def children(name: str, fan: str, columns: str = "") -> str:
    """i, j and the number through all people of every child, by one running sum."""
    return f"{name} AS (SELECT *, before + j + 1 AS number FROM (SELECT *, unnest(range(fan)) AS j FROM (SELECT *, sum(fan) OVER (ORDER BY i) - fan AS before FROM (SELECT *, CAST({fan} AS BIGINT) AS fan FROM (SELECT *{columns} FROM people)))))"


def sized(table: str) -> str:
    return f"(SELECT count(*) FROM {table})"


_MEMBER = number(6, "SYN-MBR-", "i + 1")
_START = date_sql("coverage", 1095, "number")


@query("estate_coverages", f"WITH {SIZE}, {_PEOPLE}, {children('rows', f'CASE WHEN none THEN 0 ELSE 1 + {keyed('coverages', 'i')} % 2 END', f', {hit_sql('no-coverage', 0.05)} AS none')} SELECT {number(6, 'SYN-COV-', 'number')} AS coverage_id, {_MEMBER} AS member_id, {number(4, 'SYN-PLN-', f'{keyed('plan', 'number')} % {sized('nation')} + 1')} AS plan_id, 'SYN-GRP-' || CAST({keyed('group', 'number')} % 9000 + 1000 AS VARCHAR) AS group_number, {text(_START)} AS effective_date, CASE WHEN {keyed('ends', 'number')} % 10 >= 6 THEN {text(f'{_START} + 365')} END AS term_date, 'active' AS coverage_status, CAST(1 AS BIGINT) AS row_version FROM rows")
def estate_coverages(spark, sf_dir):
    """Every coverage, all cells."""
    return made(spark, sf_dir).coverage


_CASES = {"orphan_member": ("claim-member", 0.02), "orphan_provider": ("claim-provider", 0.02), "malformed": ("claim-malformed", 0.03), "late": ("claim-late", 0.04), "no_lines": ("claim-no-lines", 0.05), "twice": ("claim-twice", 0.015), "code_hit": ("claim-code", 0.02)}
_HITS = "".join(f", {hit_sql(c, r)} AS {k}" for k, (c, r) in _CASES.items())
_ANY = "CASE WHEN orphan_member OR orphan_provider OR malformed OR late OR no_lines OR twice OR code_hit THEN 1 ELSE 0 END"
_PRICED = f"""{children('numbered', f'{_ANY} + {keyed('claims', 'i')} % (greatest({_ANY}, 4) - {_ANY} + 1)', _HITS)},
billed AS (SELECT *, {pick_sql(['paid', 'denied', 'pending', 'reversed'], 'claim-status', 'number')} AS status, {money_sql('billed', 50, 15_000, 'number')} AS billed FROM numbered),
allowed AS (SELECT *, CASE WHEN status <> 'denied' THEN {cents(f'billed * (40 + {keyed('allowed', 'number')} % 56) / 100')} END AS allowed FROM billed),
priced AS MATERIALIZED (SELECT *, {cents(f'allowed * (50 + {keyed('paid', 'number')} % 51) / 100')} AS paid, {date_sql('service', 730, 'number')} AS service FROM allowed),
submitted AS (SELECT *, CAST(service + CAST({keyed('submitted', 'number')} % 30 + 1 AS INT) AS DATE) AS submitted FROM priced)"""
_DIAGNOSIS = f"{keyed('diagnosis', 'number', 'line')} % {sized('part')}"
_CODE = f"'SYN-' || chr(CAST(65 + {_DIAGNOSIS} // 100 % 26 AS INT)) || lpad(CAST({_DIAGNOSIS} % 100 AS VARCHAR), 2, '0') || '.' || CAST({_DIAGNOSIS} // 2600 AS VARCHAR)"
_LINE_ID = f"{number(7, 'SYN-CLN-', 'number')} || '-' || CAST(line AS VARCHAR)"
_CLAIM_ID = number(7, "SYN-CLM-", "number")
_SERVICE = number(5, "SYN-", f"{keyed('procedure', 'number', 'line')} % {sized('part')} + 99000")
_CLAIM_ROWS = f"""SELECT 'claim' AS entity, {_CLAIM_ID} AS claim_id, CASE WHEN orphan_member THEN {number(6, 'SYN-MBR-', f'i + p + {L.OFFSETS["claim"]}')} ELSE {_MEMBER} END AS member_id, CAST(NULL AS VARCHAR) AS coverage_id, CASE WHEN orphan_provider THEN '{L.NO_PROVIDER_OF_CLAIM}' ELSE {number(5, 'SYN-PRV-', f'{keyed("claim-by", "number")} % {sized("supplier")} + 1')} END AS provider_id,
{pick_sql(['professional', 'institutional', 'pharmacy'], 'claim-type', 'number')} AS claim_type, status, {text('service')} AS service_date, {text('submitted')} AS submitted_date, CASE WHEN status IN ('paid', 'denied') THEN {text(f'submitted + CAST({keyed("adjudicated", "number")} % 10 + 1 AS INT)')} END AS adjudicated_date,
billed AS billed_amount, allowed AS allowed_amount, CASE WHEN malformed THEN -abs(coalesce(paid, billed)) ELSE paid END AS paid_amount, CASE WHEN late THEN {text(f'{_TODAY} - CAST({keyed("seen-late", "number")} % 5 + 1 AS INT)')} ELSE {text(f'submitted + CAST({keyed("seen", "number")} % 3 + 1 AS INT)')} END AS source_extracted_at, CASE WHEN year(service) <= 2024 THEN 'claims-2024Q4' ELSE 'claims-2025Q1' END AS extract_batch_id,
CAST(NULL AS VARCHAR) AS claim_line_id, CAST(NULL AS BIGINT) AS line_number, CAST(NULL AS VARCHAR) AS diagnosis_code, CAST(NULL AS VARCHAR) AS procedure_code, CAST(NULL AS BIGINT) AS units, CAST(NULL AS DOUBLE) AS charge_amount, CAST(NULL AS VARCHAR) AS revenue_code
FROM (SELECT *, unnest(range(CASE WHEN twice THEN 2 ELSE 1 END)) FROM submitted)"""
_LINES = f"lines AS (SELECT *, {cents('billed / n')} AS charge FROM (SELECT *, unnest(range(1, n + 1)) AS line FROM (SELECT *, {keyed('lines', 'number')} % 3 + 1 AS n FROM priced WHERE NOT no_lines)))"
_PHANTOMS = f"phantoms AS (SELECT {L.PHANTOM_CLAIM} + unnest(range(greatest(1, CAST(floor((SELECT sum(CASE WHEN twice THEN 2 ELSE 1 END) FROM priced) * 0.02) AS BIGINT)))) AS number, 1 AS line)"


def line_sql(code: str, units: str, charge: str, allowed: str, paid: str, of: str) -> str:
    given = {"claim_id": _CLAIM_ID, "allowed_amount": allowed, "paid_amount": paid, "claim_line_id": _LINE_ID, "line_number": "line", "diagnosis_code": code, "procedure_code": _SERVICE, "units": units, "charge_amount": charge}
    columns = ["claim_id", "member_id", "coverage_id", "provider_id", "claim_type", "status", "service_date", "submitted_date", "adjudicated_date", "billed_amount", "allowed_amount", "paid_amount", "source_extracted_at", "extract_batch_id", "claim_line_id", "line_number", "diagnosis_code", "procedure_code", "units", "charge_amount", "revenue_code"]
    return f"SELECT 'claim_line', {', '.join(given.get(c, 'NULL') for c in columns)} FROM {of}"


_REAL = line_sql(f"CASE WHEN code_hit AND NOT no_lines AND line = 1 THEN '{L.NO_DIAGNOSIS}' ELSE {_CODE} END", f"{keyed('units', 'number', 'line')} % 3 + 1", "charge", f"CASE WHEN allowed IS NOT NULL THEN {cents('charge * 0.8')} END", f"CASE WHEN paid IS NOT NULL OR malformed THEN {cents('charge * 0.7')} END", "lines")
_LOST = line_sql(_CODE, "1", money_sql("phantom", 20, 500, "number"), "NULL", "NULL", "phantoms")


@query("estate_claims_and_lines", f"WITH {SIZE}, {_PEOPLE}, {_PRICED}, {_LINES}, {_PHANTOMS} {_CLAIM_ROWS} UNION ALL {_REAL} UNION ALL {_LOST}")
def estate_claims_and_lines(spark, sf_dir):
    """Every claim and every line of claims, all cells of both tables."""
    e = made(spark, sf_dir)
    name = lambda df, n: df.select(F.lit(n).alias("entity"), "*")
    return name(e.claim, "claim").unionByName(name(e.claim_line, "claim_line"), allowMissingColumns=True)


_PARTNER_DATE = date_sql("partner-date", 730, "k")
_TEST = lambda at: f"[{', '.join(repr(t[at]) for t in L.TESTS)}][{keyed('test', 'k')} % {len(L.TESTS)} + 1]"


@query("estate_partner_lab_feed", f"WITH {SIZE} SELECT {number(7, 'SYN-LAB-P', 'k + 1')} AS lab_result_id, CAST(NULL AS VARCHAR) AS encounter_id, CASE WHEN k % 5 = 0 THEN {number(6, 'SYN-MBR-', f'k + p + {L.OFFSETS["partner"]}')} ELSE {number(6, 'SYN-MBR-', f'{keyed("partner", "k")} % p + 1')} END AS member_id, {_TEST(0)} AS test_code, {_TEST(1)} AS test_name, CAST({money_sql('partner-result', 50, 200, 'k')} AS VARCHAR) AS result_value, {_TEST(2)} AS result_unit, {_TEST(3)} AS reference_range, {pick_sql(['Normal', 'High', 'Low', None], 'flag', 'k')} AS abnormal_flag, {text(_PARTNER_DATE)} AS collected_date, {text(f'{_PARTNER_DATE} + 1')} AS resulted_date, 'partner_reference_lab' AS source, CASE WHEN k % 3 = 0 THEN 'v1' ELSE 'v2' END AS schema_version FROM (SELECT p, unnest(range(greatest(1, p // 10))) AS k FROM size)")
def estate_partner_lab_feed(spark, sf_dir):
    """Every row of the partner's feed, all cells."""
    return made(spark, sf_dir).lab_partner
