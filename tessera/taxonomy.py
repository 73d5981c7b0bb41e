"""Entity types, their aliases, weights, categories, tiers and rules."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: these must be as they are for right results -------------------------------------
ALIASES = {
    "US_SSN": "SSN", "SOCIAL_SECURITY": "SSN", "SOCIALSECURITYNUMBER": "SSN",
    "PER": "NAME", "PERSON": "NAME", "PATIENT": "NAME_PATIENT", "DOCTOR": "NAME_PROVIDER", "PHYSICIAN": "NAME_PROVIDER", "HCW": "NAME_PROVIDER",
    "DOB": "DATE_DOB", "BIRTHDAY": "DATE_DOB", "DATEOFBIRTH": "DATE_DOB", "DATE_OF_BIRTH": "DATE_DOB", "BIRTH_DATE": "DATE_DOB", "BIRTHDATE": "DATE_DOB",
    "CC": "CREDIT_CARD", "CREDITCARD": "CREDIT_CARD", "CREDITCARDNUMBER": "CREDIT_CARD", "CREDIT_CARD_NUMBER": "CREDIT_CARD",
    "TELEPHONE": "PHONE", "TEL": "PHONE", "MOBILE": "PHONE", "CELL": "PHONE", "PHONENUMBER": "PHONE", "PHONE_NUMBER": "PHONE", "US_PHONE_NUMBER": "PHONE",
    "EMAILADDRESS": "EMAIL", "EMAIL_ADDRESS": "EMAIL",
    "STREET_ADDRESS": "ADDRESS", "STREET": "ADDRESS",
    "IP": "IP_ADDRESS", "IPADDRESS": "IP_ADDRESS", "IPV4": "IP_ADDRESS", "IPV6": "IP_ADDRESS",
    "MEDICAL_RECORD": "MRN", "MEDICALRECORD": "MRN",
    "LICENSE": "DRIVER_LICENSE", "US_DRIVER_LICENSE": "DRIVER_LICENSE", "DRIVERSLICENSE": "DRIVER_LICENSE",
    "US_PASSPORT": "PASSPORT", "PASSPORT_NUMBER": "PASSPORT",
    "ZIPCODE": "ZIP", "ZIP_CODE": "ZIP", "POSTCODE": "ZIP", "LOCATION_ZIP": "ZIP",
}
WEIGHTS = {
    **dict.fromkeys("SSN PASSPORT CREDIT_CARD PASSWORD API_KEY PRIVATE_KEY AWS_ACCESS_KEY AWS_SECRET_KEY DATABASE_URL GITHUB_TOKEN GITLAB_TOKEN SLACK_TOKEN STRIPE_KEY CRYPTO_SEED_PHRASE".split(), 10),
    **dict.fromkeys("MRN DIAGNOSIS HEALTH_PLAN_ID JWT".split(), 9),
    **dict.fromkeys("DRIVER_LICENSE NPI DEA TAX_ID MILITARY_ID".split(), 8),
    **dict.fromkeys("BITCOIN_ADDRESS ETHEREUM_ADDRESS IBAN SWIFT_BIC".split(), 7),
    **dict.fromkeys("PHONE EMAIL SENDGRID_KEY TWILIO_KEY".split(), 6),
    **dict.fromkeys("NAME ADDRESS IP_ADDRESS MAC_ADDRESS VIN CUSIP ISIN LEI DATE_DOB".split(), 5),
    **dict.fromkeys("AGE CLASSIFICATION_LEVEL DOD_CONTRACT GSA_CONTRACT CAGE_CODE UEI".split(), 4),
    **dict.fromkeys("DATE ZIP".split(), 3),
    **dict.fromkeys("CITY STATE COUNTRY TRACKING_NUMBER".split(), 2),
    **dict.fromkeys("FACILITY ORGANIZATION".split(), 1),
}
DEFAULT_WEIGHT = 5
CATEGORIES = {
    **dict.fromkeys("SSN PASSPORT DRIVER_LICENSE MILITARY_ID TAX_ID MRN STATE_ID".split(), "direct_identifier"),
    **dict.fromkeys("DIAGNOSIS MEDICATION HEALTH_PLAN_ID NPI DEA LAB_TEST PROCEDURE".split(), "health_info"),
    **dict.fromkeys("CREDIT_CARD IBAN SWIFT_BIC ACCOUNT_NUMBER CUSIP ISIN BITCOIN_ADDRESS ETHEREUM_ADDRESS CRYPTO_SEED_PHRASE".split(), "financial"),
    **dict.fromkeys("EMAIL PHONE ADDRESS ZIP FAX".split(), "contact"),
    **dict.fromkeys("PASSWORD API_KEY PRIVATE_KEY JWT AWS_ACCESS_KEY AWS_SECRET_KEY GITHUB_TOKEN GITLAB_TOKEN SLACK_TOKEN STRIPE_KEY DATABASE_URL".split(), "credential"),
    **dict.fromkeys("NAME DATE_DOB AGE DATE".split(), "quasi_identifier"),
    **dict.fromkeys("CLASSIFICATION_LEVEL CLASSIFICATION_MARKING SCI_MARKING DISSEMINATION_CONTROL".split(), "classification_marking"),
}
CO_OCCURRENCE = (
    ("hipaa_phi", 2.0, ("direct_identifier", "health_info")),
    ("identity_theft", 1.8, ("direct_identifier", "financial")),
    ("credential_exposure", 1.5, ("credential",)),
    ("phi_without_id", 1.5, ("quasi_identifier", "health_info")),
    ("phi_with_contact", 1.4, ("contact", "health_info")),
    ("full_identity", 2.2, ("direct_identifier", "quasi_identifier", "financial")),
    ("classified_data", 2.5, ("classification_marking",)),
)
WEIGHT_SCALE, CONFIDENCE = 4.0, 0.85
TIERS = (("CRITICAL", 80), ("HIGH", 55), ("MEDIUM", 31), ("LOW", 11))
SIMPLE_TIERS = (("CRITICAL", 80), ("HIGH", 60), ("MEDIUM", 40), ("LOW", 10))
EXPOSURES = {"PRIVATE": 1.0, "INTERNAL": 1.2, "ORG_WIDE": 1.8, "PUBLIC": 2.5}
SIMPLE_EXPOSURES = {"PRIVATE": 1.0, "INTERNAL": 1.2, "ORG_WIDE": 1.5, "PUBLIC": 2.0}
TIER_ORDER = {"MINIMAL": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
CLINICAL_CONTEXT = ("LAB_TEST", "DIAGNOSIS", "MEDICATION", "DRUG", "PROCEDURE", "PAYER", "PHYSICAL_DESC")
TIER_BANDS = {1: (0.0, 0.5), 2: (0.5, 0.75), 3: (0.75, 0.9), 4: (0.9, 1.0)}
THRESHOLD = 0.70
# --- end of fixed values ---------------------------------------------------------------------------


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def normalized(entity_type: Column) -> Column:
    """Canonical upper-case name of an entity type."""
    upper = F.upper(entity_type)
    return F.coalesce(literal_map(ALIASES)[upper], upper)


def normalize(entity_type: str) -> str:
    upper = entity_type.upper()
    return ALIASES.get(upper, upper)


def tier_ordinal(tier: Column) -> Column:
    return literal_map(TIER_ORDER)[tier]
