"""Pattern families: what is looked for in a text, written from the public formats of each identifier."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from re import _constants as C
from re import _parser
from typing import NamedTuple

from tessera.functions import validators as V

CHECKSUM, STRUCTURED, PATTERN, ML = 4, 3, 2, 1


class Pattern(NamedTuple):
    kind: str
    confidence: float
    regex: re.Pattern
    check: Callable[[str], float] | None = None


class Family(NamedTuple):
    name: str
    tier: int
    patterns: tuple[Pattern, ...]


class Needs(NamedTuple):
    """What every text with a match holds: one of the literals (folded; none: nothing is known), and a run of so many digits."""

    literals: frozenset[str]
    digits: int


_DIGITS = {(C.CATEGORY, C.CATEGORY_DIGIT), (C.RANGE, (48, 57))}


def folded(text: str) -> str:
    """text in one case, as matching without regard to case sees it."""
    return text.lower().replace("\u0131", "i").replace("\u017f", "s")


def _needs(parts: Iterable) -> Needs:
    """Needs of a parsed sequence: the literals whose shortest is longest, of all its parts; and its longest run of digits."""
    found: list[frozenset[str]] = []
    run, digits, most = "", 0, 0

    def end_run() -> None:
        nonlocal run
        if run:
            found.append(frozenset([folded(run)]))
        run = ""

    for op, arg in parts:
        if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue  # takes no characters
        if op is C.LITERAL:
            run += chr(arg)
            digits = digits + 1 if chr(arg).isdigit() else 0
            most = max(most, digits)
            continue
        end_run()
        if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, top, body = arg
            if len(body) == 1 and body[0][0] is C.IN and set(body[0][1]) <= _DIGITS:
                most = max(most, digits + least)
                digits = digits + least if top == least else least
                continue
            inner = _needs(body) if least else Needs(frozenset(), 0)
        elif op is C.IN:
            inner = Needs(frozenset(), 0)
            if set(arg) <= _DIGITS:
                digits += 1
                most = max(most, digits)
                continue
        elif op is C.SUBPATTERN:
            inner = _needs(arg[3])
        elif op is C.ATOMIC_GROUP:
            inner = _needs(arg)
        elif op is C.BRANCH:
            each = [_needs(b) for b in arg[1]]
            inner = Needs(frozenset().union(*(n.literals for n in each)) if all(n.literals for n in each) else frozenset(), min(n.digits for n in each))
        else:
            inner = Needs(frozenset(), 0)
        digits = 0
        most = max(most, inner.digits)
        if inner.literals:
            found.append(inner.literals)
    end_run()
    return Needs(max(found, key=lambda x: (min(map(len, x)), -len(x)), default=frozenset()), most)


@lru_cache(maxsize=None)
def needs(regex: re.Pattern) -> Needs:
    return _needs(_parser.parse(regex.pattern, regex.flags))


class Seen:
    """What a text holds, found out once for all patterns: a pattern runs only over texts that can have a match."""

    def __init__(self, text: str):
        self.low, self.known = folded(text), {}
        self.digits = max(map(len, re.findall(r"\d+", text)), default=0)

    def may_match(self, regex: re.Pattern) -> bool:
        literals, digits = needs(regex)
        if digits > self.digits:
            return False
        if not literals:
            return True
        for x in literals:
            if x not in self.known:
                self.known[x] = x in self.low
            if self.known[x]:
                return True
        return False


def p(kind: str, confidence: float, regex: str, check=None, flags: int = 0) -> Pattern:
    return Pattern(kind, confidence, re.compile(regex, flags), check)


def labelled(kind: str, labels: str, value: str, confidence: float = 0.9, check=None) -> Pattern:
    """A value behind one of its labels: `label: value`, `label # value`, `label no. value`."""
    names = "|".join(re.escape(x).replace(r"\ ", r"[ _-]?") for x in labels.split(","))
    return p(kind, confidence, rf"\b(?:{names})(?:\s*(?:number|no\.?|id|#))?\s*[:#=]?\s*({value})(?![\w-])", check, re.I)


def listed(rows: str, confidence: float) -> tuple[Pattern, ...]:
    """Rows of `KIND | labels | value`."""
    return tuple(labelled(k.strip(), n.strip(), v.strip(), confidence) for k, n, v in (r.split(" | ") for r in rows.strip().splitlines()))


_D = r"(?<![\w-])"
_E = r"(?![\w-])"

CHECKSUMS = Family("checksum", CHECKSUM, (
    p("SSN", 0.99, r"(?<![A-Za-z0-9-])(\d{3}\s*-\s*\d{2}\s*-\s*\d{4}|\d{3}\s\d{2}\s\d{4})(?![A-Za-z0-9])", V.ssn),
    labelled("SSN", "ssn,social security", r"\d{9}", 0.99, V.ssn),
    p("CREDIT_CARD", 0.99, r"\b(\d{4}(?:[-\s._]?\d{4}){3}|\d{4}[-\s._]?\d{6}[-\s._]?\d{5}|\d{13,19})\b", V.credit_card),
    p("NPI", 0.99, r"\b([12]\d{9})\b", V.npi),
    p("DEA", 0.99, r"\b([A-Za-z]{2}\d{7})\b", V.dea),
    p("IBAN", 0.99, r"\b([A-Za-z]{2}\d{2}[A-Za-z0-9]{11,30})\b", V.iban),
    p("VIN", 0.99, r"\b([A-HJ-NPR-Za-hj-npr-z0-9]{17})\b", V.vin),
    p("CUSIP", 0.99, r"\b([A-Z0-9]{8}[0-9])\b", V.cusip),
    p("ISIN", 0.99, r"\b([A-Z]{2}[A-Z0-9]{9}[0-9])\b", V.isin),
    p("TRACKING_NUMBER", 0.99, r"\b(1[Zz][A-Za-z0-9]{16})\b", V.ups),
    p("TRACKING_NUMBER", 0.99, r"\b(\d{12}|96\d{13}|\d{20}|92\d{20})\b", V.fedex),
    p("TRACKING_NUMBER", 0.99, r"\b(\d{20}|\d{22}|[A-Z]{2}\d{9}[A-Z]{2})\b", V.usps),
))

FINANCIAL = Family("financial", CHECKSUM, (
    labelled("CUSIP", "cusip", r"[A-Z0-9]{9}", 0.96, V.cusip),
    labelled("ISIN", "isin", r"[A-Z]{2}[A-Z0-9]{10}", 0.96, V.isin),
    labelled("SEDOL", "sedol", r"[A-Z0-9]{7}", 0.96, V.sedol),
    labelled("SWIFT_BIC", "swift,bic,swift code", r"[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?", 0.96, V.swift),
    labelled("LEI", "lei", r"[A-Z0-9]{20}", 0.96, V.lei),
    labelled("FIGI", "figi", r"BBG[A-Z0-9]{9}", 0.96),
    p("FIGI", 0.95, r"\b(BBG[A-Z0-9]{9})\b"),
    p("LEI", 0.80, r"\b([A-Z0-9]{18}\d{2})\b", V.lei),
    p("BITCOIN_ADDRESS", 0.95, rf"\b([13][{V.BASE58}]{{25,34}})\b", V.bitcoin),
    p("BITCOIN_ADDRESS", 0.97, r"\b(bc1[qp][02-9ac-hj-np-z]{38,60})\b", V.bech32, re.I),
    p("ETHEREUM_ADDRESS", 0.97, r"\b(0x[0-9a-fA-F]{40})\b", V.ethereum),
    p("CARDANO_ADDRESS", 0.95, r"\b(addr1[02-9ac-hj-np-z]{50,110})\b", None, re.I),
    p("LITECOIN_ADDRESS", 0.95, r"\b(ltc1[02-9ac-hj-np-z]{38,60})\b", None, re.I),
    p("DOGECOIN_ADDRESS", 0.80, rf"\b(D[5-9A-HJ-NP-U][{V.BASE58}]{{32}})\b"),
    p("XRP_ADDRESS", 0.80, rf"\b(r[{V.BASE58}]{{24,34}})\b"),
    p("CRYPTO_SEED_PHRASE", 0.95, r"\b(?:seed|mnemonic|recovery|backup)\s+(?:phrase|words?)\s*:?\s+((?:[a-z]{3,8} ){11}(?:(?:[a-z]{3,8} ){12})?[a-z]{3,8})\b", V.seed_phrase, re.I),
))

# --- fixed values: words of the public marking manuals -----------------------------------------------
#: Levels of a banner line, and their forms in portions.
LEVELS = ("TOP SECRET", "SECRET", "CONFIDENTIAL")
PORTIONS = ("TS", "S", "C")
#: Markings of matter that has no level.
NO_LEVEL = ("UNCLASSIFIED", "CONTROLLED UNCLASSIFIED INFORMATION", "SENSITIVE BUT UNCLASSIFIED", "OFFICIAL USE ONLY", "LIMITED OFFICIAL USE")
#: Control systems and the disciplines of intelligence.
CONTROL_SYSTEMS = ("HCS", "SI", "TK")
DISCIPLINES = ("COMINT", "SIGINT", "HUMINT", "IMINT", "GEOINT", "MASINT")
SPECIAL_ACCESS = ("SPECIAL ACCESS PROGRAM", "SPECIAL ACCESS REQUIRED")
#: Dissemination controls; REL TO is followed by the trigraphs of countries.
CONTROLS = ("NOFORN", "ORCON", "IMCON", "PROPIN", "FOUO", "FVEY")
# --- end of fixed values ---------------------------------------------------------------------------


def _any(words: tuple[str, ...]) -> str:
    """One of these words, whatever blanks part them; the longest first, as they stand in each other."""
    return "(?:" + "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in sorted(words, key=len, reverse=True)) + ")"


_COUNTRIES = r"[A-Z]{3,4}(?:\s*,\s*[A-Z]{3,4})*"
GOVERNMENT = Family("government", PATTERN, (
    # a banner or portion: the level, then controls behind double slashes
    p("CLASSIFICATION_MARKING", 0.98, rf"(?<!\w)({_any(LEVELS + PORTIONS)}//[A-Z][A-Z/ ]*[A-Z])(?!\w)"),
    p("CLASSIFICATION_LEVEL", 0.98, rf"\b({_any(LEVELS[:1] + NO_LEVEL)})\b", None, re.I),
    # the other levels are common words: their surroundings decide (see SECRET_CONTEXT)
    p("CLASSIFICATION_LEVEL", 0.85, rf"\b({_any(LEVELS[1:])})\b", None, re.I),
    p("SCI_MARKING", 0.98, rf"(//{_any(CONTROL_SYSTEMS + DISCIPLINES)})\b"),
    p("SCI_MARKING", 0.98, rf"\b({_any(SPECIAL_ACCESS)})\b", None, re.I),
    p("DISSEMINATION_CONTROL", 0.98, rf"\b({_any(CONTROLS)}|REL\s+TO\s+{_COUNTRIES})\b"),
    labelled("CAGE_CODE", "cage,cage code", r"[A-Z0-9]{5}", 0.98),
    labelled("DUNS_NUMBER", "duns,d-u-n-s", r"\d{9}|\d{2}-\d{3}-\d{4}", 0.98),
    labelled("UEI", "uei,unique entity", r"[A-Z0-9]{12}", 0.98),
    p("DOD_CONTRACT", 0.98, r"\b([A-Z]{1,6}\d{4,5}-\d{2}-[CDGM]-\d{4})\b"),
    p("GSA_CONTRACT", 0.98, r"\b(GS-\d{2}[A-Z]?-?\d{3,4}[A-Z]?|47[A-Z]{2}[A-Z0-9]{2}\d{2}[A-Z]\d{4})\b"),
    p("CLEARANCE_LEVEL", 0.97, r"\b(TS/SCI|(?:TOP\s+SECRET|SECRET|Q|L)\s+CLEARANCE|YANKEE\s+WHITE)\b", None, re.I),
    p("ITAR_MARKING", 0.97, r"\b(ITAR\s+(?:CONTROLLED|RESTRICTED|DATA)|USML\s+CATEGORY\s+[IVX]+|22\s*CFR\s*1[2-9]\d)\b", None, re.I),
    p("EAR_MARKING", 0.96, r"\b(EAR\s*99|ECCN[:\s]+\d[A-E]\d{3}|15\s*CFR\s*7[3-9]\d|EXPORT\s+(?:CONTROLLED|RESTRICTED))\b", None, re.I),
))
#: What makes "secret" a marking when it stands within 50 characters.
SECRET_CONTEXT = ("//", "classified", "clearance", "noforn", "sci", "fouo", "dissem", "caveat", "portion", "marking")

#: Words before nine bare digits that say it is no social security number.
NO_SSN_BEFORE = (
    "page", "pg", "room", "rm", "order", "ref", "reference", "invoice", "confirmation", "tracking", "case", "ticket", "claim", "check",
    "acct", "record", "file", "document", "doc", "no", "num", "#", "code", "pin", "serial", "model", "part", "item", "sku", "upc", "isbn",
    "version", "ver", "batch", "lot", "catalog", "product", "unit", "id", "make", "type", "series",
)
NO_SSN_WINDOW, NO_SSN_SURE = 30, 0.75
# --- end of fixed values ---------------------------------------------------------------------------

_NAME = r"[A-Z][a-z]+(?:[ '-][A-Z][a-z]*\.?){1,3}"
_DATE = r"\d{1,2}[/.-]\d{1,2}[/.-]\d{4}|\d{4}-\d{2}-\d{2}"
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"


def _is_date(s: str) -> float:
    d = [int(x) for x in re.split(r"[/.-]", s)]
    if len(d) < 3:
        return V.SURE
    return V.calendar(*d) if d[0] > 999 else max(V.calendar(d[2], d[0], d[1]), V.calendar(d[2], d[1], d[0]))


PATTERNS = Family("pattern", PATTERN, (
    p("SSN", 0.70, r"\b((?!000|666|9)[0-9]{9})\b"),
    p("EMAIL", 0.95, r"(?<![\w.%+-])([A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"),
    p("PHONE", 0.90, r"(?<![\w+])(\+?1?[ .-]?\(?[2-9]\d{2}\)?[ .-]\d{3}[ .-]\d{4})(?!\w)", V.phone),
    p("PHONE", 0.85, r"(?<![\w+])(\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5})(?!\w)", V.phone),
    labelled("FAX", "fax", r"\+?[\d(][\d() .-]{8,16}\d", 0.92, V.phone), labelled("PAGER", "pager,beeper", r"\+?[\d(][\d() .-]{5,16}\d", 0.9), labelled("PHONE_EXT", "ext,extension", r"\d{2,6}", 0.85),
    p("IP_ADDRESS", 0.90, r"(?<![\d.])(\d{1,3}(?:\.\d{1,3}){3})(?![\d.]*\d)", V.ip),
    p("IP_ADDRESS", 0.90, r"(?<![:\w])((?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4})(?![:\w])"),
    p("MAC_ADDRESS", 0.95, r"\b([0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5})\b"),
    p("URL", 0.90, r"\b(https?://[^\s<>\"']+)"),
    labelled("DATE_DOB", "dob,date of birth,born,birth date", _DATE, 0.95, _is_date),
    p("DATE", 0.85, rf"(?<![\w/.-])({_DATE})(?![\w/.-])", _is_date), p("DATE", 0.85, rf"\b({_MONTH}\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}\s+{_MONTH}\s+\d{{4}})\b"),
    p("TIME", 0.80, r"\b((?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?(?:\s?[AaPp][Mm])?)\b"), p("DATETIME", 0.90, r"\b(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:\d{2})?)"),
    p("NAME", 0.85, rf"\b(?:Mr|Mrs|Ms|Miss)\.?\s+({_NAME}|[A-Z][a-z]+)"), p("NAME_PROVIDER", 0.90, rf"\b(?:Dr|Doctor|Prof)\.?\s+({_NAME}|[A-Z][a-z]+)"), p("NAME_PROVIDER", 0.88, rf"\b({_NAME}),?\s+(?:MD|DO|RN|NP|PA-C|DDS|PharmD)\b"),
    p("NAME_PATIENT", 0.92, rf"\b[Pp]atient(?:\s+[Nn]ame)?\s*:\s*({_NAME})"), p("NAME_RELATIVE", 0.85, rf"\b(?:mother|father|wife|husband|son|daughter|brother|sister|spouse)\s*[,:]?\s+({_NAME})"), p("NAME", 0.88, rf"\b[Nn]ame\s*:\s*({_NAME})"),
    p("ADDRESS", 0.88, r"\b(\d{1,6}\s+(?:[NSEW]\.?\s+)?(?:[A-Z][a-z]+\s+){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Place|Pl)\b\.?(?:,?\s+(?:Apt|Suite|Unit|#)\s*\w+)?)"), p("ADDRESS", 0.85, r"\b(P\.?\s?O\.?\s+Box\s+\d+)\b", None, re.I),
    labelled("ZIP", "zip,zip code,postal code", r"\d{5}(?:-\d{4})?|[A-Z]\d[A-Z] ?\d[A-Z]\d|[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}", 0.9), p("ZIP", 0.85, r"\b[A-Z]{2}\s+(\d{5}(?:-\d{4})?)\b"),
    p("FACILITY", 0.82, r"\b((?:[A-Z][a-z]+\s+){1,4}(?:Hospital|Clinic|Medical\s+Center|Health\s+System|Pharmacy|Infirmary))\b"),
    p("GPS_COORDINATES", 0.92, r"(?<![\d.])(-?(?:[1-8]?\d|90)\.\d{4,},\s*-?(?:1[0-7]\d|\d{1,2}|180)\.\d{4,})(?!\d)"),
    p("BLOOD_TYPE", 0.85, r"\b(?:[Bb]lood\s+(?:type|group))\s*:?\s*((?:AB|A|B|O)\s?[+-])"), p("HEIGHT", 0.82, r"\b(\d'\s?\d{1,2}\"|\d{2,3}\s?cm)(?!\w)"), p("WEIGHT", 0.82, r"\b(\d{2,3}(?:\.\d)?\s?(?:kg|lbs?|pounds))\b"), labelled("BMI", "bmi", r"\d{2}(?:\.\d{1,2})?", 0.88),
    p("CREDIT_CARD_PARTIAL", 0.85, r"(?:ending\s+in|last\s+four)\s*:?\s*(\d{4})\b", None, re.I), labelled("SSN_PARTIAL", "last 4 ssn,ssn last 4", r"\d{4}", 0.85), p("NHS_NUMBER", 0.88, r"\bNHS\s*(?:number|no\.?)?\s*:?\s*(\d{3}[ -]?\d{3}[ -]?\d{4})\b", None, re.I),
    p("CURP", 0.92, r"\b([A-Z]{4}\d{6}[HM][A-Z]{5}[A-Z0-9]\d)\b"), p("AADHAAR", 0.82, r"\b[Aa]adhaar\s*:?\s*(\d{4}[ -]?\d{4}[ -]?\d{4})\b"),
    p("LICENSE_PLATE", 0.85, r"\b(?:[Ll]icense\s+[Pp]late|[Pp]late)\s*:?\s*([A-Z0-9]{2,4}[ -]?[A-Z0-9]{2,4})\b"), p("NDC", 0.88, r"\bNDC\s*:?\s*(\d{4,5}-\d{3,4}-\d{1,2})\b"),
    *listed(r"""
MRN | mrn,medical record | [A-Z]{0,3}\d{5,10}
ENCOUNTER_ID | encounter,visit | [A-Z]{0,3}\d{5,12}
ACCESSION_ID | accession | [A-Z0-9-]{6,15}
NPI | npi | [12]\d{9}
DEA | dea | [A-Z]{2}\d{7}
MEMBER_ID | member,member id,subscriber | [A-Z]{0,4}\d{6,12}
HEALTH_PLAN_ID | policy,health plan,insurance id,group | [A-Z]{0,4}\d{6,12}
MEDICARE_ID | medicare,mbi | [1-9][A-Z][A-Z0-9]\d-?[A-Z][A-Z0-9]\d-?[A-Z]{2}\d{2}
PHARMACY_ID | bin,ncpdp,pcn | \d{6,7}
ROOM | room | \d{1,4}[A-Z]?
BED_NUMBER | bed | \d{1,3}[A-Z]?
IMEI | imei | \d{15}
DEVICE_ID | device,serial,udi | [A-Z0-9-]{6,20}
BIOMETRIC_ID | fingerprint,retina,biometric | [A-Z0-9-]{6,24}
IMAGE_ID | image,photo,dicom | [A-Z0-9.-]{5,40}
USERNAME | username,user name,login | [A-Za-z0-9._-]{3,32}
PASSWORD | password,passwd,pwd,passphrase | \S{6,64}
DRIVER_LICENSE | driver license,drivers license,driver's license,dl | [A-Z]{0,2}\d{5,13}
STATE_ID | state id | [A-Z]{0,2}\d{6,12}
UNIQUE_ID | unique id,record id,study id | [A-Z0-9-]{5,20}
PASSPORT | passport | [A-Z]{0,2}\d{6,9}
MEDICAL_LICENSE | medical license | [A-Z]{0,3}\d{5,9}
MILITARY_ID | edipi,dod id,military id | \d{10}
RX_NUMBER | rx,prescription | \d{6,10}
ACCOUNT_NUMBER | account,acct | \d{6,17}
CERTIFICATE_NUMBER | certificate | [A-Z0-9-]{5,20}
CLAIM_NUMBER | claim | [A-Z0-9-]{5,20}
AUTH_NUMBER | authorization,auth | [A-Z0-9-]{5,15}
SIN | sin | \d{3}[ -]\d{3}[ -]\d{3}
TFN | tfn | \d{3} ?\d{3} ?\d{3}
SVNR | svnr | \d{4} ?\d{6}
TAX_ID | ein,tax id,tin,itin | \d{2}-?\d{7}
""", 0.90),
    labelled("ABA_ROUTING", "aba,routing", r"\d{9}", 0.95, V.aba), labelled("VIN", "vin", r"[A-HJ-NPR-Z0-9]{17}", 0.95, V.vin),
    labelled("AGE", "age,aged", r"\d{1,3}", 0.88, V.age),
))

ADDITIONAL = Family("additional", PATTERN, (
    p("EMPLOYER", 0.85, r"\b(?:employed\s+(?:by|at)|works?\s+(?:for|at)|employer\s*:)\s+((?:[A-Z][\w&.-]+\s?){1,5})"),
    p("AGE", 0.90, r"\b(\d{1,3})(?:\s*-?\s*)(?:years?|yrs?)(?:\s*-?\s*old|\s+of\s+age)\b", V.age, re.I), p("AGE", 0.88, r"\b(\d{1,3})\s?(?:y/?o|yo)\b", V.age, re.I),
    *listed(r"""
HEALTH_PLAN_ID | plan id,payer id,coverage | [A-Z]{1,4}\d{5,12}
MEMBER_ID | beneficiary,cardholder | [A-Z]{0,4}\d{6,12}
BANK_ROUTING | bank routing,rtn | \d{9}
EMPLOYEE_ID | employee,emp,badge,staff | [A-Z]{0,3}\d{3,10}
""", 0.88),
))

SECRETS = Family("secrets", CHECKSUM, (
    p("AWS_ACCESS_KEY", 0.99, r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b"), p("AWS_SECRET_KEY", 0.95, r"(?i:aws_?secret[\w]*)\s*[:=]\s*['\"]?([A-Za-z0-9/+=]{40})\b"),
    p("GITHUB_TOKEN", 0.99, r"\b(gh[pousr]_[A-Za-z0-9]{36,})\b"), p("GITLAB_TOKEN", 0.99, r"\b(glpat-[\w-]{20,})"), p("SLACK_TOKEN", 0.99, r"\b(xox[abprs]-[0-9A-Za-z-]{10,})"), p("SLACK_WEBHOOK", 0.99, r"(https://hooks\.slack\.com/services/[\w/]{20,})"),
    p("STRIPE_KEY", 0.99, r"\b([sr]k_(?:live|test)_[0-9A-Za-z]{16,})\b"), p("GOOGLE_API_KEY", 0.99, r"\b(AIza[0-9A-Za-z_-]{35})"), p("SENDGRID_KEY", 0.99, r"\b(SG\.[\w-]{22}\.[\w-]{43})"), p("TWILIO_KEY", 0.95, r"\b(SK[0-9a-f]{32})\b"), p("TWILIO_ACCOUNT_SID", 0.95, r"\b(AC[0-9a-f]{32})\b"),
    p("NPM_TOKEN", 0.99, r"\b(npm_[A-Za-z0-9]{36})\b"), p("PYPI_TOKEN", 0.99, r"\b(pypi-[\w-]{50,})"), p("SHOPIFY_TOKEN", 0.99, r"\b(shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32})\b"), p("SQUARE_TOKEN", 0.95, r"\b(sq0[a-z]{3}-[\w-]{22,43})"),
    p("PRIVATE_KEY", 0.99, r"(-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----)"), p("JWT", 0.98, r"\b(eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,})"), p("DATABASE_URL", 0.97, r"\b((?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s:@/]+:[^\s@]+@[^\s]+)"),
    p("BEARER_TOKEN", 0.92, r"\b[Bb]earer\s+([\w.~+/-]{20,}=*)"), p("BASIC_AUTH", 0.92, r"\b[Bb]asic\s+([A-Za-z0-9+/]{16,}={0,2})(?!\w)"), p("API_KEY", 0.92, r"(?i:api[_-]?key|token|secret)\s*[:=]\s*['\"]([\w-]{16,})['\"]"), p("AZURE_STORAGE_KEY", 0.97, r"AccountKey=([A-Za-z0-9+/]{86}==)"),
))

FAMILIES = {f.name: f for f in (CHECKSUMS, PATTERNS, ADDITIONAL, FINANCIAL, GOVERNMENT, SECRETS)}
PRESETS = {"full": tuple(FAMILIES), "patterns_only": ("pattern", "additional"), "quick": ("checksum", "secrets")}
