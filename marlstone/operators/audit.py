"""Line-level privacy audit: up to seven findings for each line, without a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import SPACE, ascii_lower, lines, once, trim

RANK = {"Low": 1, "Medium": 2, "High": 3}
# What the rules look for.
DATABASES = r"(postgres|postgresql|mysql|mongodb|redis)://"
SECRET_NAMES = "api_key|apikey|access_key|secret_key|auth_token|access_token|github_token|openai_key"
PLACEHOLDERS = "test-key|test_key|example|dummy|placeholder|change-me|changeme|your-|your_"
TOKEN_PARAMETERS = r"\?token=|&token=|\?access_token="
OVERRIDES = "ignore previous instructions|disregard previous instructions|override developer instructions|system message:|忽略之前的指令|忽略以上指令|无视之前的指令|覆盖开发者指令|系统消息："
PHONE_WORDS = "phone|mobile|tel|电话|手机|联系方式"
EDGES = r"""[,;:"'()\[\]{}]"""


def assigned_value(line: Column) -> Column:
    """What follows the first =, or else the first ': ', without its blanks and quotes; null for neither."""
    after = F.when(line.contains("="), F.regexp_extract(line, r"(?s)\A[^=]*=(.*)\z", 1)).when(line.contains(": "), F.regexp_extract(line, r"(?s)\A.*?: (.*)\z", 1))
    return F.regexp_replace(F.regexp_replace(trim(after), r'\A"+|"+\z', ""), r"\A'+|'+\z", "")


def has_email(line: Column) -> Column:
    def is_email(word: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(word, rf"\A{EDGES}+|{EDGES}+\z", ""), r"(?s)\A.*=", "")
        return ~bare.contains("/") & bare.rlike(r"(?s)\A[^@]+@[^.].*\.")

    return line.contains("@") & F.exists(F.split(line, f"{SPACE}+"), is_email)


def _any(line: Column, words: str) -> Column:
    return reduce(Column.__or__, (line.contains(word) for word in words.split("|")))


def has_phone(line: Column, low: Column | None = None) -> Column:
    digits = F.length(F.regexp_replace(line, "[^0-9]+", ""))
    mobile = line.rlike("1[3-9][0-9]{9}") & line.rlike("(^|[^0-9])1[3-9][0-9]{9}([^0-9]|$)")
    return line.rlike("[0-9]") & (mobile | ((line.contains("+") | _any(ascii_lower(line) if low is None else low, PHONE_WORDS)) & digits.between(7, 15)))


def line_findings(line: Column) -> Column:
    """Array of (kind, severity, evidence) for one line, in the order of the rules."""
    return once(line, lambda held: once(search_case(held), lambda low: _line_findings(held, low)))


def search_case(line: Column) -> Column:
    """A line in which ASCII words are found in any case: in lower case, if no other letter becomes an ASCII one by that."""
    return F.when(line.contains("\u212a") | line.contains("\u0130"), ascii_lower(line)).otherwise(F.lower(line))


def _line_findings(line: Column, low: Column) -> Column:
    """Each rule asks first for a word that all it looks for have, by bytes; only then for its pattern."""
    value = assigned_value(ascii_lower(line))
    secret = _any(low, "_key|apikey|_token") & low.rlike(SECRET_NAMES) & (F.octet_length(value) >= 8)
    held = value.rlike(PLACEHOLDERS)
    rules = [
        (low.contains("://") & low.rlike(DATABASES), "Database URL", F.lit("High"), F.lit("database connection string")),
        (low.contains("private key") & low.contains("begin "), "Private key", F.lit("High"), F.lit("private key block marker")),
        (secret, "API key", F.when(held, "Low").otherwise("High"), F.when(held, "placeholder credential assignment").otherwise("sensitive key assignment")),
        (low.contains("token=") & low.rlike(TOKEN_PARAMETERS) & (F.octet_length(line) >= 16), "URL token", F.lit("Medium"), F.lit("token-like URL parameter")),
        (_any(low, OVERRIDES), "Instruction override", F.lit("Medium"), F.lit("instruction override pattern")),
        (has_email(line), "Email address", F.lit("Low"), F.lit("email address")),
        (has_phone(line, low), "Phone number", F.lit("Medium"), F.lit("phone number")),
    ]
    found = [F.when(rule, F.struct(F.lit(kind).alias("kind"), severity.alias("severity"), evidence.alias("evidence"))) for rule, kind, severity, evidence in rules]
    return F.filter(F.array(*found), lambda f: f.isNotNull())


def at_least(severity: Column, threshold: str) -> Column:
    rank = F.when(severity == "High", 3).when(severity == "Medium", 2).otherwise(1)
    return rank >= RANK[threshold]


def audit(docs: DataFrame) -> DataFrame:
    """(path, line, kind, severity, evidence) for every finding in docs(path, text)."""
    numbered = docs.select("path", F.posexplode(lines(F.col("text"))).alias("at", "content"))
    found = numbered.select("path", (F.col("at") + 1).cast("long").alias("line"), F.explode(line_findings(F.col("content"))).alias("f"))
    return found.select("path", "line", "f.kind", "f.severity", "f.evidence")


def ordered(findings: DataFrame) -> DataFrame:
    """By path (part by part), line and kind."""
    return findings.orderBy(F.split("path", "/"), "line", "kind")


def counts(findings: DataFrame, column: str) -> DataFrame:
    return findings.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
