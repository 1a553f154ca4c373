"""Redaction of secrets and personal data: 25 rules in a fixed order, as one fold of JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE, jvm

_ROAD = "(?:" + "|".join(sorted("street st avenue ave road rd boulevard blvd drive dr lane ln way circle cir".split(), key=lambda w: (-len(w), w))) + ")"
_OCTET = r"(?:[01]?\d{1,2}|2[0-4]\d|25[0-5])"
_HEX4 = "[a-fA-F0-9]{1,4}"
_G = r"[\s-]?"

#: Rules up to the postal codes: (name, pattern, replacement).
FIRST = [
    ("openai_key", "sk-[0-9A-Za-z]{48,}", "[REDACTED_OPENAI_KEY]"),
    ("anthropic_key", "sk-ant-[-0-9A-Za-z]+", "[REDACTED_ANTHROPIC_KEY]"),
    ("aws_key", "AKIA[A-Z0-9]{16}", "[REDACTED_AWS_KEY]"),
    ("bearer", r"(?i)Bearer(?:[\s]+token|):?[\s]+[-_.0-9a-z]{20,}", "Bearer [REDACTED_TOKEN]"),
    ("url_credential", r"(https?://)[^@\s:]+(?::[^@\s]+)?@", "$1[REDACTED_URL_CREDENTIAL]@"),
    ("pem", r"-----BEGIN\s+[\sA-Z]+PRIVATE\s+KEY-----[\d\D]*?-----END\s+[\sA-Z]+PRIVATE\s+KEY-----", "[REDACTED_PEM_KEY]"),
    ("email", r"[-+._0-9A-Za-z]+@[-.0-9A-Za-z]+\.[A-Za-z]{2,}", "[REDACTED_EMAIL]"),
    ("card", rf"\b(?:4\d{{3}}{_G}\d{{4}}{_G}\d{{4}}{_G}\d{{1,4}}|5[1-5]\d\d{_G}\d{{4}}{_G}\d{{4}}{_G}\d{{4}}|3[47]\d\d{_G}\d{{6}}{_G}\d{{5}}|3[068]\d{_G}\d{{4}}{_G}\d{{4}}{_G}\d{{4}})\b", "[REDACTED_CREDIT_CARD]"),
    ("passport", r"(?i)(\b(?:pasaporte|passport)[:\s]*)[0-9A-Z]{6,9}\b", "$1[REDACTED_PASSPORT]"),
    ("license", r"(?i)(\b(?:licencia\s*de\s*conducir|driver\s*license|D\.L\.|DL)[:\s]*)[0-9A-Z]{8,16}\b", "$1[REDACTED_DRIVER_LICENSE]"),
    ("spanish_dni", r"(?i)\b[0-9]{8}[A-Z]\b", "[REDACTED_SPANISH_DNI]"),
    ("spanish_nie", r"(?i)\b[X-Z][0-9]{7}[A-Z]\b", "[REDACTED_SPANISH_NIE]"),
    ("mexican_curp", r"(?i)\b[A-Z]{4}[0-9]{6}[MH][A-Z]{5}[A-Z0-9]{2}\b", "[REDACTED_MEXICAN_CURP]"),
    ("brazilian_cpf", r"\b(?:\d{3}\.?){2}\d{3}-?\d\d\b", "[REDACTED_BRAZILIAN_CPF]"),
    ("uk_nino", r"(?i)\b[A-Z]{2}(?:\s?\d\d){3}\s?[A-Z]\b", "[REDACTED_UK_NINO]"),
    ("chilean_run", r"(?i)(\bRU[NT][:\s]*)(?:\d{7,8}-[K0-9]|\d{8}[K0-9])\b", "$1[REDACTED_CHILEAN_RUN]"),
    ("argentine_dni", r"(?i)(\bDNI[:\s]*)\d{8}\b", "$1[REDACTED_ARGENTINE_DNI]"),
    ("zip", r"\b[0-9]{5}(?:-[0-9]{4})?\b", "[REDACTED_ZIP_CODE]"),
    ("uk_postcode", r"(?i)\b[A-Z][A-Z]?\d\d?[A-Z]?\s?[0-9][A-Z][A-Z]\b", "[REDACTED_POSTCODE]"),
    ("ca_postcode", r"(?i)\b[A-Z][0-9][A-Z]\s?[0-9][A-Z][0-9]\b", "[REDACTED_POSTAL_CODE]"),
]
#: Rules after the street addresses and before the names, and after the names.
BIRTH = [("birth_date", r"(?i)(\b(?:fecha\s+de\s+nacimiento|born|date\s+of\s+birth|DOB)[:\s]*)\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b", "$1[REDACTED_BIRTH_DATE]")]
LAST = [
    ("ssn", r"\b(?!9\d\d|666|000)\d{3}[.\s-]?(?!00)\d\d[.\s-]?(?!0{4})\d{4}\b", "[REDACTED_SSN]"),
    ("phone", r"(?:\+?1[.\s-]?)?\(?\d{3}\)?[.\s-]?\d{3}[.\s-]?\d{4}\b", "[REDACTED_PHONE]"),
    ("ipv4", rf"\b(?!255\.255\.255\.255|0\.0\.0\.0|127\.0\.0\.1)(?:{_OCTET}\.){{3}}{_OCTET}\b", "[REDACTED_IPV4]"),
    ("ipv6", rf"\b(?!::)(?:{_HEX4}:){{7}}{_HEX4}\b|\b(?:{_HEX4}:){{1,7}}::\b|\b::(?:{_HEX4}:){{1,7}}{_HEX4}\b", "[REDACTED_IPV6]"),
    ("mac", r"\b(?:[a-fA-F\d]{2}[:-]){5}[a-fA-F\d]{2}\b", "[REDACTED_MAC_ADDRESS]"),
]

_STREET = rf"(?i)\b(?:direcci[oó]n|address|street|avenue|calle|ave)[:\s]*(?:\d+\s+[\sA-Za-z]+{_ROAD})?\b"
_STREET_IN = rf"(?i)\d+\s+[\sA-Za-z]+{_ROAD}"
_GREETING = r"(?i)\b(?:Good\s+(?:evening|afternoon|morning)|Greetings|Hello|Dear|Hey|Hi)\s+([a-z]{2,}(?:\s+[a-z]{2,}){0,2})\b"
_NOT_NAMES = r"(?i)\b(?:all|everyone|folks|guys|people|team|there)\b"


def wide(pattern: str) -> str:
    r"""JVM form of a rule: ASCII boundaries, and \s as ECMAScript has it, inside classes and out."""
    out, inside, i = [], False, 0
    pattern = jvm(pattern)
    while i < len(pattern):
        if pattern.startswith(r"\s", i):
            out.append(SPACE[1:-1] if inside else SPACE)
            i += 2
            continue
        if pattern[i] == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        inside = pattern[i] == "[" or inside and pattern[i] != "]"
        out.append(pattern[i])
        i += 1
    return "".join(out)


def apply_rules(text: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Rules one after the other."""
    for _, pattern, replacement in rules:
        text = F.regexp_replace(text, wide(pattern), replacement)
    return text


def _each_match(text: Column, pattern: str, change) -> Column:
    """Text with each match replaced by change(match, its first group or '')."""
    p = wide(pattern)
    pieces = F.split(text, p, -1)
    whole = F.regexp_extract_all(text, F.lit(p), 0)
    group = F.regexp_extract_all(text, F.lit(p), F.lit(int("([" in pattern)))
    fixed = F.zip_with(whole, group, change)
    glued = F.zip_with(pieces, fixed, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    return F.when(text.rlike(p), F.array_join(glued, "")).otherwise(text)


def redact_streets(text: Column) -> Column:
    """Street addresses after a word that announces one."""
    return _each_match(text, _STREET, lambda m, _: F.regexp_replace(m, wide(_STREET_IN), "[REDACTED_ADDRESS]"))


def redact_names(text: Column) -> Column:
    """Up to three words after a greeting, unless one of them addresses a group."""
    def put(m: Column, name: Column) -> Column:
        at = F.instr(m, name)
        new = F.concat(F.substring(m, F.lit(1), at - 1), F.lit("[REDACTED_NAME]"), F.substring(m, at + F.length(name), F.length(m)))
        return F.when((F.length(name) >= 2) & ~name.rlike(wide(_NOT_NAMES)), new).otherwise(m)

    return _each_match(text, _GREETING, put)


def sanitize(text: Column) -> Column:
    """All rules as one expression, for texts within arrays; a blank text stays as it is."""
    out = apply_rules(text, FIRST)
    out = redact_streets(out)
    out = apply_rules(out, BIRTH)
    out = redact_names(out)
    out = apply_rules(out, LAST)
    return F.when(F.regexp_replace(text, f"{SPACE}+", "") == "", text).otherwise(out)


#: What a text must contain for a rule to match, tested before the rule is tried; any digit for the rules not named.
_NEEDS = {
    "openai_key": "sk-", "anthropic_key": "sk-ant-", "aws_key": "AKIA", "bearer": "(?i)bearer", "url_credential": "://", "pem": "-----BEGIN", "email": "@", "passport": "(?i)pas[sa]p", "license": r"(?i)licen|D\.?L",
    "chilean_run": "(?i)RU[NT]", "argentine_dni": "(?i)DNI", "birth_date": "(?i)born|dob|birth|nacimiento", "ipv6": ":", "mac": "[:-]",
}


def _step(df: DataFrame, out: str, new: Column, needs: str) -> DataFrame:
    cur = F.col(out)
    plain = not set(needs) & set("[(|?\\")
    return df.withColumn(out, F.when(cur.contains(needs) if plain else cur.rlike(needs), new).otherwise(cur))


def rules_applied(df: DataFrame, out: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """df with rules applied to column out, one projection per rule, which tries it only on texts that have what it needs."""
    for name, pattern, replacement in rules:
        df = _step(df, out, F.regexp_replace(F.col(out), wide(pattern), replacement), _NEEDS.get(name, "[0-9]"))
    return df


def sanitized(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with all rules applied to a column; one projection per rule, which reads the one before several times without computing it again."""
    df = rules_applied(df.withColumn(out, F.col(column)), out, FIRST)
    df = rules_applied(_step(df, out, redact_streets(F.col(out)), "[0-9]"), out, BIRTH)
    return rules_applied(_step(df, out, redact_names(F.col(out)), wide(_GREETING)), out, LAST)


def count_redactions(text: Column) -> Column:
    """Redaction marks in a text, those that were there before included."""
    return F.regexp_count(text, F.lit(r"\[REDACTED_[^\]]+\]"))
