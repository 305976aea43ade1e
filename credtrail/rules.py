"""The rules of a scan: patterns, keyword groups, ignore lists and settings.

A ``Rules`` object lives on the driver and is turned into Column expressions
by ``credtrail.functions``; it never travels with the data.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credtrail.functions.text import java_regex


@dataclass(frozen=True)
class ExtractionPattern:
    """A regex whose group 1 is the key and whose ``value_group`` is the value.

    ``needs`` is a literal that every matching line holds. It is optional and
    only saves time: lines without it skip the regex.
    """

    name: str
    regex: str
    value_group: int = 2
    needs: str | None = None


@dataclass(frozen=True)
class KeywordGroup:
    name: str
    keywords: tuple[str, ...]


# The four extraction patterns, tried in this order.
PATTERNS = (
    ExtractionPattern("key_equals_value", r"^\s*([a-zA-Z_][\w.$/-]*)\s*=\s*(.+)$", 2, "="),
    ExtractionPattern(
        "yaml_colon", r"""^\s*([a-zA-Z_][\w._-]*)\s*:\s+['"]?([^'"\n=]+)['"]?\s*$""", 2, ":"
    ),
    ExtractionPattern("json_quoted", r'"([a-zA-Z_][\w._]*)"\s*:\s*"([^"]+)"', 2, ":"),
    ExtractionPattern(
        "export_env", r"""^\s*export\s+([A-Z_][A-Z0-9_]*)\s*=\s*['"]?([^'"\n]+)['"]?""", 2, "="
    ),
)

# An unanchored assignment, for prose and chat logs.
INLINE_ASSIGNMENT = ExtractionPattern(
    "inline_assignment", r'([A-Za-z_][\w.-]*)\s*=\s*"([^"]+)"', 2, "="
)

# Keyword groups. client_secret is in two groups and counts twice.
KEYWORD_GROUPS = (
    KeywordGroup("password", ("password", "passwd", "pwd", "pass", "mot_de_passe")),
    KeywordGroup("secret", ("secret", "client_secret", "app_secret", "api_secret")),
    KeywordGroup("api_key", ("api_key", "apikey", "api-key")),
    KeywordGroup("token", ("token", "access_token", "auth_token", "bearer")),
    KeywordGroup("credentials", ("credential", "credentials", "auth")),
    KeywordGroup("private_key", ("private_key", "privatekey", "private-key", "rsa_private")),
    KeywordGroup(
        "connection_string",
        ("connection_string", "connectionstring", "conn_str", "database_url", "db_url"),
    ),
    KeywordGroup("oauth", ("oauth", "client_id", "client_secret", "refresh_token")),
    KeywordGroup("aws", ("aws_access_key", "aws_secret", "aws_key")),
    KeywordGroup("encryption", ("encryption_key", "encrypt_key", "aes_key", "cipher")),
)

# A value holding one of these is not a secret.
IGNORED_VALUES = (
    "<empty>", "<none>", "<null>", "null", "nil", "undefined", "none", "N/A",
    "${", "{{", "%s", "<value>", "<your_", "[your_",
    "PLACEHOLDER", "your_", "YOUR_", "example", "EXAMPLE", "sample",
    "xxx", "XXX", "***", "----", "____",
    "REMOVED", "REDACTED", "HIDDEN", "MASKED",
    "changeme", "CHANGEME", "change_me", "TODO", "FIXME",
    "default", "DEFAULT",
)

# Files that are not scanned.
IGNORED_FILES = (
    "*.md", "*.txt", "*.rst", "*.lock",
    "*.go", "*.js", "*.ts", "*.jsx", "*.tsx", "*.py", "*.java", "*.rb", "*.php",
    "*.c", "*.cpp", "*.h", "*.cs", "*.swift", "*.kt", "*.rs", "*.scala",
    "*.json", "*.jsonl",
    "node_modules/**", "vendor/**", ".git/**",
    "*.min.js", "*.min.css",
)

# Extensions of binary files.
EXCLUDED_EXTENSIONS = (
    ".jar", ".war", ".zip", ".tar", ".gz", ".rar",
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx",
    ".exe", ".dll", ".so", ".dylib",
    ".class", ".pyc", ".o", ".a",
)


@dataclass(frozen=True)
class Rules:
    patterns: tuple[ExtractionPattern, ...] = PATTERNS
    groups: tuple[KeywordGroup, ...] = KEYWORD_GROUPS
    ignored_values: tuple[str, ...] = IGNORED_VALUES
    ignored_files: tuple[str, ...] = IGNORED_FILES
    excluded_extensions: tuple[str, ...] = EXCLUDED_EXTENSIONS
    min_length: int = 3
    max_length: int = 500
    case_sensitive: bool = False
    # Count value lengths in UTF-8 bytes instead of characters.
    length_in_bytes: bool = False
    # Try the next pattern when a pattern yields an ignored value.
    fallthrough: bool = field(default=False)

    @property
    def keywords(self) -> list[tuple[int, str, str]]:
        """``(kw_idx, group, keyword)`` in rule order, repeats kept."""
        pairs = [(g.name, kw) for g in self.groups for kw in g.keywords]
        return [(i, group, kw) for i, (group, kw) in enumerate(pairs)]

    def with_patterns(self, *patterns: ExtractionPattern) -> Rules:
        return replace(self, patterns=tuple(patterns))

    def with_keywords(self, *keywords: str, group: str = "custom") -> Rules:
        return replace(self, groups=(KeywordGroup(group, tuple(keywords)),))


def default_rules() -> Rules:
    return Rules()


# A second rule set. It scans source files too and treats more
# words as placeholders.
ALTERNATIVE_GROUPS = (
    KeywordGroup("password", ("password", "passwd", "pwd")),
    KeywordGroup("secret", ("secret", "client_secret", "client.secret", "app_secret")),
    KeywordGroup("api_key", ("api_key", "apikey", "api.key", "api-key")),
    KeywordGroup(
        "token", ("token", "access_token", "auth_token", "bearer_token", "refresh_token")
    ),
    KeywordGroup("private_key", ("private_key", "privatekey", "private.key")),
    KeywordGroup("credentials", ("credentials", "credential")),
    KeywordGroup("connection_string", ("connection_string", "connectionstring", "conn_str")),
    KeywordGroup(
        "database",
        ("db_password", "db_pass", "database_password", "mysql_pwd", "postgres_password"),
    ),
    KeywordGroup("encryption", ("encryption_key", "encrypt_key", "aes_key", "signing_key")),
    KeywordGroup("oauth", ("oauth_secret", "oauth_token", "client_id")),
)
ALTERNATIVE_IGNORED_VALUES = (
    "<empty>", "null", "undefined", "none", "N/A", "${", "{{", "CHANGE_ME", "YOUR_",
    "xxx", "***", "PLACEHOLDER", "TODO", "FIXME", "example", "test", "dummy", "fake",
    "sample",
)
ALTERNATIVE_IGNORED_FILES = (
    "*.md", "*.txt", "*.lock", "package-lock.json", "yarn.lock", "*.min.js", "*.min.css",
    "node_modules/**", "vendor/**", ".git/**",
)
ALTERNATIVE_EXTENSIONS = (
    ".jar", ".war", ".ear", ".zip", ".tar", ".gz", ".7z", ".rar", ".bin", ".exe", ".dll",
    ".so", ".dylib", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".pdf", ".doc",
    ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".mp3", ".mp4", ".avi", ".mov", ".ttf",
    ".woff", ".woff2", ".eot",
)


def alternative_rules() -> Rules:
    return Rules(
        groups=ALTERNATIVE_GROUPS,
        ignored_values=ALTERNATIVE_IGNORED_VALUES,
        ignored_files=ALTERNATIVE_IGNORED_FILES,
        excluded_extensions=ALTERNATIVE_EXTENSIONS,
    )


# The rule file as a Spark schema.
RULES_SCHEMA = """
  extractionPatterns ARRAY<STRUCT<name: STRING, pattern: STRING, valueGroup: INT>>,
  keywords ARRAY<STRUCT<name: STRING, patterns: ARRAY<STRING>>>,
  ignoredValues ARRAY<STRING>,
  ignoredFiles ARRAY<STRING>,
  excludeBinaryExtensions ARRAY<STRING>,
  settings STRUCT<minSecretLength: INT, maxSecretLength: INT, caseSensitive: BOOLEAN>
"""


def load_rules(spark: SparkSession, path: str, base: Rules | None = None) -> Rules:
    """Read a JSON rule file over ``base``.

    A list in the file replaces the list of ``base``, a missing list keeps it;
    settings merge one by one; patterns that do not compile are left out.
    """
    rules = base or default_rules()
    reader = spark.read.schema(RULES_SCHEMA).option("multiLine", True).option("mode", "FAILFAST")
    read = reader.json(path).select(F.to_json(F.struct("*"))).limit(2).collect()
    if len(read) != 1:
        raise ValueError(f"{path} must hold one rule file")
    found = json.loads(read[0][0])

    changes: dict = {}
    if "extractionPatterns" in found:
        given = [
            ExtractionPattern(p["name"], p["pattern"], p.get("valueGroup", 2))
            for p in found["extractionPatterns"]
        ]
        changes["patterns"] = tuple(p for p in given if _compiles(spark, p.regex))
    if "keywords" in found:
        changes["groups"] = tuple(
            KeywordGroup(g["name"], tuple(g.get("patterns", ()))) for g in found["keywords"]
        )
    for key, name in (
        ("ignoredValues", "ignored_values"),
        ("ignoredFiles", "ignored_files"),
        ("excludeBinaryExtensions", "excluded_extensions"),
    ):
        if key in found:
            changes[name] = tuple(found[key])
    settings = found.get("settings", {})
    for key, name in (
        ("minSecretLength", "min_length"),
        ("maxSecretLength", "max_length"),
        ("caseSensitive", "case_sensitive"),
    ):
        if key in settings:
            changes[name] = settings[key]
    return replace(rules, **changes)


def _compiles(spark: SparkSession, regex: str) -> bool:
    probe = spark.range(1).select(F.lit("").rlike(java_regex(regex)))
    try:
        probe.collect()
    except PySparkException:
        return False
    return True


def keyword_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """The keyword list as a table ``(kw_idx, group, keyword)``."""
    return spark.createDataFrame(rules.keywords, "kw_idx INT, `group` STRING, keyword STRING")


def pattern_table(spark: SparkSession, rules: Rules) -> DataFrame:
    rows = [(i, p.name, p.regex, p.value_group) for i, p in enumerate(rules.patterns)]
    return spark.createDataFrame(rows, "pat_idx INT, name STRING, regex STRING, value_group INT")


def ignore_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """All ignore lists in one table ``(list, entry)``."""
    rows = [("value", v) for v in rules.ignored_values]
    rows += [("file", v) for v in rules.ignored_files]
    rows += [("extension", v) for v in rules.excluded_extensions]
    return spark.createDataFrame(rows, "list STRING, entry STRING")
