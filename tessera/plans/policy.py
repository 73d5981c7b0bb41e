"""Policy packs and their evaluation as Column expressions over an entity summary."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RISK = {"low": 1, "medium": 2, "high": 3, "critical": 4}


@dataclass(frozen=True)
class Trigger:
    any_of: tuple[str, ...] = ()
    all_of: tuple[str, ...] = ()
    combinations: tuple[tuple[str, ...], ...] = ()
    exclude_if_only: tuple[str, ...] = ()
    min_confidence: float = 0.5
    min_count: int = 1


@dataclass(frozen=True)
class Pack:
    name: str
    framework: str
    risk: str
    trigger: Trigger = Trigger()
    special: Trigger | None = None
    handling: tuple[str, ...] = ()
    min_days: int | None = None
    max_days: int | None = None
    review_days: int | None = None
    rights: tuple[str, ...] = ()
    regions: tuple[str, ...] = ()
    priority: int = 50
    tags: tuple[str, ...] = field(default=())
    allowed: tuple[str, ...] = ()
    prohibited: tuple[str, ...] = ()


# --- fixed values: the built-in packs ----------------------------------------------------------------
HIPAA_COMBINATIONS = (
    ("person_name", "date_of_birth", "medical_facility"),
    ("person_name", "diagnosis"),
    ("person_name", "treatment"),
    ("person_name", "medical_provider"),
    ("ssn", "medical_provider"),
    ("ssn", "diagnosis"),
    ("email", "diagnosis"),
    ("phone", "diagnosis"),
    ("address", "diagnosis"),
)
PACKS = (
    Pack("HIPAA PHI", "hipaa", "critical", Trigger(tuple("medical_record_number mrn health_insurance_id health_plan_beneficiary diagnosis_code icd_code prescription medication npi dea_number".split()), combinations=HIPAA_COMBINATIONS, min_confidence=0.7),
         handling=("encryption_required", "encryption_at_rest", "encryption_in_transit", "audit_access", "access_logging"), min_days=2190, review_days=365, regions=("US",), priority=100),
    Pack("PII General", "pii", "high", Trigger(tuple("ssn social_security_number drivers_license passport national_id itin tax_id ein uk_nino ca_sin de_id".split()), combinations=(("person_name", "date_of_birth"), ("person_name", "address"), ("person_name", "phone"), ("person_name", "email", "date_of_birth")), min_confidence=0.6),
         handling=("encryption_required", "encryption_at_rest", "audit_access"), review_days=365, priority=80),
    Pack("PCI-DSS", "pci_dss", "critical", Trigger(tuple("credit_card credit_card_number pan card_cvv cvv card_expiry cardholder_name bank_routing bank_account iban".split()), combinations=(("credit_card_number", "card_expiry"), ("credit_card_number", "cvv"), ("bank_account", "routing_number"), ("iban", "bic")), min_confidence=0.8),
         handling=("encryption_required", "encryption_at_rest", "encryption_in_transit", "tokenization_required", "masking_required", "audit_access", "access_logging"), max_days=365, review_days=90, priority=100),
    Pack("GDPR Personal Data", "gdpr", "high", Trigger(tuple("person_name email email_address phone phone_number ip_address device_id cookie_id location location_data gps_coordinates national_id passport uk_nino de_id".split()), min_confidence=0.6),
         Trigger(tuple("racial_ethnic_origin political_opinion religious_belief trade_union_membership genetic_data biometric_data health_data diagnosis medical_condition sex_life sexual_orientation".split()), min_confidence=0.7),
         handling=("encryption_required", "encryption_in_transit", "audit_access", "access_logging"), review_days=365, rights=("access", "rectification", "erasure", "portability", "restriction", "objection"), regions=("EU", "EEA", "UK"), priority=90),
    Pack("CCPA/CPRA", "ccpa", "high", Trigger(tuple("ssn drivers_license passport financial_account credit_card biometric_data".split()), combinations=(("person_name", "email"), ("person_name", "phone"), ("person_name", "address"), ("person_name", "ip_address"), ("email", "purchase_history"), ("device_id", "browsing_history")), min_confidence=0.6),
         Trigger(tuple("ssn drivers_license passport financial_account precise_geolocation racial_ethnic_origin religious_belief union_membership genetic_data biometric_data health_data sex_life sexual_orientation".split())),
         handling=("encryption_required", "audit_access"), review_days=365, rights=("access", "erasure", "portability", "objection"), regions=("US-CA",), priority=85),
    Pack("GLBA", "glba", "high", Trigger(tuple("ssn tax_id bank_account bank_routing credit_card financial_account".split()), combinations=(("person_name", "account_number"), ("person_name", "financial_account"), ("ssn", "account_balance"), ("person_name", "credit_score"), ("person_name", "loan_amount")), min_confidence=0.7),
         handling=("encryption_required", "encryption_at_rest", "encryption_in_transit", "audit_access"), min_days=2555, regions=("US",), priority=85),
    Pack("FERPA", "ferpa", "high", Trigger(tuple("student_id education_record transcript grade gpa".split()), combinations=(("person_name", "student_id"), ("person_name", "grade"), ("person_name", "school", "date_of_birth"), ("person_name", "disciplinary_record")), min_confidence=0.7),
         handling=("encryption_required", "audit_access"), min_days=1825, rights=("access", "rectification"), regions=("US",), priority=80),
    Pack("Credentials & Secrets", "custom", "critical", Trigger(tuple("aws_key aws_secret api_key password private_key ssh_key github_token azure_connection_string database_password jwt_secret encryption_key client_secret".split()), min_confidence=0.8),
         handling=("encryption_required", "encryption_at_rest", "audit_access", "access_logging"), max_days=90, priority=100),
    Pack("SOC2 Trust Services", "soc2", "high", Trigger(tuple("ssn social_security_number credit_card bank_account iban api_key password private_key aws_key aws_secret client_secret database_password encryption_key".split()), combinations=(("person_name", "bank_account"), ("person_name", "credit_card"), ("email", "ssn")), min_confidence=0.7),
         handling=("encryption_required", "encryption_at_rest", "encryption_in_transit", "audit_access", "access_logging"), min_days=365, review_days=90, regions=("US",), priority=60),
)
# --- end of fixed values ---------------------------------------------------------------------------


def from_dict(spec: dict) -> Pack:
    """A pack from its loaded form (YAML, JSON or a dict)."""
    trigger = lambda d: Trigger(tuple(d.get("any_of", ())), tuple(d.get("all_of", ())), tuple(map(tuple, d.get("combinations", ()))), tuple(d.get("exclude_if_only", ())), float(d.get("min_confidence", 0.5)), int(d.get("min_count", 1)))
    keep, hold = spec.get("retention", {}), spec.get("handling", {})
    return Pack(
        spec["name"], spec.get("category", "custom"), spec.get("risk_level", "medium"), trigger(spec.get("triggers", {})), trigger(spec["special_category_triggers"]) if spec.get("special_category_triggers") else None,
        tuple(k for k, v in hold.items() if v is True), keep.get("min_days"), keep.get("max_days"), keep.get("review_frequency_days"), tuple(k for k, v in spec.get("data_subject_rights", {}).items() if v), tuple(spec.get("jurisdictions", ())), int(spec.get("priority", 50)), tuple(spec.get("tags", ())),
        tuple(hold.get("geographic_restrictions") or ()), tuple(hold.get("prohibited_regions") or ()))


def load_yaml(text: str) -> list[Pack]:
    import yaml

    loaded = yaml.safe_load(text)
    return [from_dict(x) for x in (loaded.get("policies", [loaded]) if isinstance(loaded, dict) else loaded)]


def in_order(packs=PACKS) -> list[Pack]:
    """By priority, highest first; equal ones as given."""
    return sorted(packs, key=lambda p: -p.priority)


def context(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ctx: map of lower-case type to (count, max confidence), from entity_type and confidence rows."""
    per = entities.groupBy(key, F.lower("entity_type").alias("t")).agg(F.count("*").alias("n"), F.max("confidence").alias("c"))
    return per.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("t", F.struct("n", "c")))).alias("ctx"))  # one entry per type


def _strings(xs) -> Column:
    return F.array(*map(F.lit, xs)) if xs else F.expr("cast(array() as array<string>)")


def matches(ctx: Column, t: Trigger) -> Column:
    """Whether a trigger fires on a context."""
    types = F.map_keys(ctx)
    sure = lambda x: ctx[x]["c"] >= t.min_confidence
    out = F.lit(False)
    if t.any_of:
        hit = F.array_intersect(types, _strings(t.any_of))
        # all that matched must be sure and frequent enough
        out = out | ((F.size(hit) > 0) & F.forall(hit, lambda x: sure(x) & (ctx[x]["n"] >= t.min_count)))
    for need in ((t.all_of,) if t.all_of else ()) + t.combinations:
        out = out | ((F.size(F.array_except(_strings(need), types)) == 0) & F.forall(_strings(need), sure))
    if t.exclude_if_only:
        out = out & ~((F.size(types) > 0) & (F.size(F.array_except(types, _strings(t.exclude_if_only))) == 0))
    return F.coalesce(out, F.lit(False))


def violated(ctx: Column, p: Pack) -> Column:
    """Whether a pack applies. Special categories are asked only where main triggers exist and none fired; they ignore thresholds."""
    main = matches(ctx, p.trigger)
    if p.special is None or not (p.trigger.any_of or p.trigger.all_of or p.trigger.combinations):
        return main
    types = F.map_keys(ctx)
    special = F.arrays_overlap(types, _strings(p.special.any_of)) if p.special.any_of else F.lit(False)
    for need in ((p.special.all_of,) if p.special.all_of else ()) + p.special.combinations:
        special = special | (F.size(F.array_except(_strings(need), types)) == 0)
    return main | F.coalesce(special, F.lit(False))


def evaluate(contexts: DataFrame, packs=PACKS) -> DataFrame:
    """contexts with `applied`: the packs that apply, by priority. One projection, no join."""
    one = [F.when(violated(F.col("ctx"), p), F.struct(F.lit(p.name).alias("policy"), F.lit(p.framework).alias("framework"), F.lit(p.risk).alias("risk"), F.lit(p.priority).alias("priority"))) for p in in_order(packs)]
    return contexts.withColumn("applied", F.filter(F.array(*one), lambda x: x.isNotNull()))


def merged(evaluated: DataFrame, packs=PACKS) -> DataFrame:
    """The most restrictive of the applied packs' requirements, and the summary flags."""
    names = F.transform("applied", lambda x: x["policy"])
    has = lambda p: F.array_contains(names, p.name)
    some = lambda ps: F.coalesce(F.reduce(F.array(*[has(p) for p in ps]), F.lit(False), lambda a, b: a | b), F.lit(False)) if ps else F.lit(False)

    def least(f, pick):
        values = [F.when(has(p), F.lit(f(p))) for p in packs if f(p) is not None]
        return (F.array_min if pick == "min" else F.array_max)(F.array(*values)) if values else F.lit(None).cast("int")

    level = F.array_max(F.transform("applied", lambda x: F.create_map(*[F.lit(v) for kv in RISK.items() for v in kv])[x["risk"]]))
    flags = sorted({h for p in packs for h in p.handling})
    rights = sorted({r for p in packs for r in p.rights})
    regions = F.array_sort(F.array_distinct(F.flatten(F.filter(F.array(*[F.when(has(p), _strings(p.regions)) for p in packs]), lambda x: x.isNotNull()))))
    listed = lambda f: F.filter(F.array(*[F.when(has(p), _strings(f(p))) for p in in_order(packs) if f(p)] or [F.lit(None).cast("array<string>")]), lambda x: x.isNotNull())
    # regions that are allowed: what all lists share, by priority; a list that follows an empty intersection starts anew
    allowed = F.aggregate(listed(lambda p: p.allowed), _strings(()), lambda a, x: F.when(F.size(a) == 0, x).otherwise(F.array_intersect(a, x)), lambda a: F.array_sort(a))
    prohibited = F.array_sort(F.array_distinct(F.flatten(listed(lambda p: p.prohibited))))
    cols = [F.element_at(F.array(*map(F.lit, RISK)), level).alias("risk_level"), regions.alias("regions"), allowed.alias("allowed_regions"), prohibited.alias("prohibited_regions"), least(lambda p: p.min_days, "max").alias("min_days"), least(lambda p: p.max_days, "min").alias("max_days"), least(lambda p: p.review_days, "min").alias("review_days")]
    cols += [some([p for p in packs if h in p.handling]).alias(h) for h in flags] + [some([p for p in packs if r in p.rights]).alias(f"right_{r}") for r in rights]
    framework = lambda f: F.exists("applied", lambda x: x["framework"] == f)
    cols += [framework("hipaa").alias("has_phi"), framework("pii").alias("has_pii"), framework("pci_dss").alias("has_pci"), framework("gdpr").alias("has_gdpr")]
    return evaluated.select("*", *cols)
