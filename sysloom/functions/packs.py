"""Rule packs: the detection knowledge, held as data.

A pack is a tuple of named tuples.  Operators turn a pack into column
expressions (no join is needed to test an event against it) and look the
attributes of a fired rule up in ``pack_table`` after de-duplication.
Users pass their own packs; ``rules_from_table`` reads one from a table.
"""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# A pack becomes part of the query plan, so its size is checked.
MAX_PACK_ROWS = 2_000

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
RISK_LEVELS = ("SAFE", "SUSPICIOUS", "MALICIOUS")
CATEGORIES = (
    "credential_theft", "data_exfiltration", "reverse_shell", "recon",
    "persistence", "network", "anti_forensics", "suspicious_activity",
)

# --- fixed values: MITRE ATT&CK technique names ---------------------------
MITRE_NAMES = {
    "T1003.008": "OS Credential Dumping: /etc/shadow",
    "T1027": "Obfuscated Files or Information",
    "T1033": "System Owner/User Discovery",
    "T1053.003": "Scheduled Task/Job: Cron",
    "T1059": "Command and Scripting Interpreter",
    "T1059.004": "Command and Scripting Interpreter: Unix Shell",
    "T1059.006": "Command and Scripting Interpreter: Python",
    "T1070.004": "Indicator Removal: File Deletion",
    "T1071.001": "Application Layer Protocol: Web Protocols",
    "T1082": "System Information Discovery",
    "T1087.001": "Account Discovery: Local Account",
    "T1098.004": "Account Manipulation: SSH Authorized Keys",
    "T1105": "Ingress Tool Transfer",
    "T1106": "Native API",
    "T1195.002": "Supply Chain Compromise: Compromise Software Supply Chain",
    "T1204.002": "User Execution: Malicious File",
    "T1222.002": "Linux File and Directory Permissions Modification",
    "T1552.001": "Unsecured Credentials: Credentials in Files",
    "T1552.003": "Unsecured Credentials: Bash History",
    "T1552.004": "Unsecured Credentials: Private Keys",
    "T1565.001": "Data Manipulation: Stored Data Manipulation",
}


class EventRule(NamedTuple):
    """A runtime rule.  ``exempt_*`` switch the rule off for some processes."""

    pattern: str
    points: int
    severity: str
    category: str
    mitre_id: str
    description: str
    exempt_names: tuple[str, ...] = ()
    exempt_prefixes: tuple[str, ...] = ()


class CodeRule(NamedTuple):
    """A source rule: ``regex`` searched per line.  ``needle`` is a literal that
    every match contains; it lets the scan skip the regex on most texts."""

    regex: str
    severity: str
    category: str
    mitre_id: str
    description: str
    needle: str = ""


# --- fixed values: runtime file rules, in evaluation order ----------------
FILE_RULES = (
    EventRule("/etc/shadow", 30, "CRITICAL", "credential_theft", "T1003.008", "Opened the password hash file"),
    EventRule("/.ssh/id_rsa", 25, "CRITICAL", "credential_theft", "T1552.004", "Opened an RSA private key"),
    EventRule("/.ssh/id_ed25519", 25, "CRITICAL", "credential_theft", "T1552.004", "Opened an Ed25519 private key"),
    EventRule("/.ssh/authorized_keys", 20, "HIGH", "credential_theft", "T1098.004", "Opened the list of trusted SSH keys"),
    EventRule("/proc/self/environ", 15, "HIGH", "recon", "T1082", "Opened its own environment block"),
    EventRule("/.bash_history", 15, "HIGH", "credential_theft", "T1552.003", "Opened a shell history"),
    EventRule("/.npmrc", 10, "MEDIUM", "credential_theft", "T1552.001", "Opened an npm configuration with possible tokens",
              ("npm", "node", "libuv-worker"), ("npm install",)),
    EventRule("/.gitconfig", 10, "MEDIUM", "credential_theft", "T1552.001", "Opened a git configuration"),
    EventRule("/etc/crontab", 25, "HIGH", "persistence", "T1053.003", "Opened the system crontab"),
    EventRule("/etc/passwd", 5, "LOW", "recon", "T1087.001", "Opened the account list"),
)

# --- fixed values: runtime exec rules, in evaluation order ----------------
EXEC_RULES = (
    EventRule("curl", 20, "HIGH", "data_exfiltration", "T1105", "Ran curl"),
    EventRule("wget", 20, "HIGH", "data_exfiltration", "T1105", "Ran wget"),
    EventRule("whoami", 10, "MEDIUM", "recon", "T1033", "Asked for the user name"),
    EventRule("id", 10, "MEDIUM", "recon", "T1033", "Asked for user and group ids"),
    EventRule("uname", 5, "LOW", "recon", "T1082", "Asked for the system version"),
    EventRule("chmod", 10, "MEDIUM", "persistence", "T1222.002", "Changed file permissions"),
    EventRule("chown", 10, "MEDIUM", "persistence", "T1222.002", "Changed file ownership"),
    EventRule("nc", 25, "CRITICAL", "reverse_shell", "T1059.004", "Ran nc, a usual reverse shell tool"),
    EventRule("ncat", 25, "CRITICAL", "reverse_shell", "T1059.004", "Ran ncat, a usual reverse shell tool"),
    EventRule("socat", 25, "CRITICAL", "reverse_shell", "T1059.004", "Ran socat, a usual reverse shell tool"),
    EventRule("python", 15, "MEDIUM", "suspicious_activity", "T1059.006", "Started a Python interpreter"),
    EventRule("perl", 15, "MEDIUM", "suspicious_activity", "T1059", "Started a Perl interpreter"),
    EventRule("ruby", 15, "MEDIUM", "suspicious_activity", "T1059", "Started a Ruby interpreter"),
)

# --- fixed values: source rules, in evaluation order ----------------------
CODE_RULES = (
    CodeRule(r"\beval\s*\(", "HIGH", "suspicious_activity", "T1027", "Calls eval", "eval"),
    CodeRule(r"""Buffer\.from\s*\([^)]*,\s*["'](?:base64|hex)["']""", "HIGH", "suspicious_activity", "T1027",
             "Decodes base64 or hex data at run time", "Buffer.from"),
    CodeRule(r"\\x[0-9a-fA-F]{2}(?:\\x[0-9a-fA-F]{2}){10,}", "MEDIUM", "suspicious_activity", "T1027",
             "Holds a long run of hex escapes", "\\x"),
    CodeRule(r"atob\s*\(", "MEDIUM", "suspicious_activity", "T1027", "Calls atob", "atob"),
    CodeRule(r"Function\s*\(", "HIGH", "suspicious_activity", "T1059", "Builds a function from text", "Function"),
    CodeRule(r"child_process", "MEDIUM", "suspicious_activity", "T1059.004", "Uses the child_process module", "child_process"),
    CodeRule(r"execSync\s*\(", "HIGH", "suspicious_activity", "T1059.004", "Runs a command and waits for it", "execSync"),
    CodeRule(r"exec\s*\(", "MEDIUM", "suspicious_activity", "T1059.004", "Runs a command", "exec"),
    CodeRule(r"spawn\s*\(", "MEDIUM", "suspicious_activity", "T1059.004", "Spawns a process", "spawn"),
    CodeRule(r"""https?://[^\s"']+(?:evil|attacker|malware|c2|exfil)""", "CRITICAL", "data_exfiltration", "T1071.001",
             "Holds a URL with a suspicious word", "http"),
    CodeRule(r"https?://\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "HIGH", "network", "T1071.001",
             "Holds a URL with a bare IPv4 host", "http"),
    CodeRule(r"/etc/shadow", "CRITICAL", "credential_theft", "T1003.008", "Names the password hash file", "/etc/shadow"),
    CodeRule(r"\.ssh/id_rsa", "CRITICAL", "credential_theft", "T1552.004", "Names an SSH private key", ".ssh/id_rsa"),
    CodeRule(r"/etc/crontab", "HIGH", "persistence", "T1053.003", "Names the system crontab", "/etc/crontab"),
    CodeRule(r"\.npmrc", "MEDIUM", "credential_theft", "T1552.001", "Names an npm configuration", ".npmrc"),
    CodeRule(r"writeFileSync|appendFileSync", "MEDIUM", "persistence", "T1565.001", "Writes files synchronously", "FileSync"),
)

# --- fixed values: name and path lists ------------------------------------
LIFECYCLE_HOOKS = ("preinstall", "postinstall", "preuninstall", "postuninstall", "install")
SCANNABLE_SUFFIXES = (".js", ".mjs", ".cjs", ".ts", ".sh", ".py", ".rb")
EXPECTED_PROCESSES = ("sh", "npm", "node", "mkdir", "cp", "sleep", "true", "DT_INIT")
SAFE_PREFIXES = (
    "/usr/local/lib/node_modules/", "/usr/local/bin/", "/app/node_modules/",
    "/app/package", "/root/.npm/", "/tmp/npm-", "/proc/self/maps",
)
DIGEST_SAFE_PREFIXES = (
    "/usr/local/lib/node_modules/", "/usr/local/bin/", "/app/node_modules/",
    "/app/package", "/root/.npm/", "/tmp/npm-",
)
SENSITIVE_PATHS = (
    ".ssh/", "/etc/shadow", "/etc/passwd", "/etc/crontab", "/proc/self/environ", "/proc/self/maps",
    "/.aws/", "/.gnupg/", "/.npmrc", "/.bash_history", "/etc/hosts",
)
POPULAR_PACKAGES = (
    "angular", "async", "axios", "bcrypt", "bluebird", "body-parser", "chalk", "cheerio", "commander",
    "cors", "crypto-js", "debug", "dotenv", "electron", "eslint", "express", "form-data", "glob", "jest",
    "jsonwebtoken", "lodash", "minimist", "mocha", "moment", "mongoose", "next", "node-fetch", "nodemon",
    "nuxt", "passport", "pm2", "prettier", "puppeteer", "react", "request", "sequelize", "sharp",
    "socket.io", "svelte", "typescript", "underscore", "uuid", "vue", "webpack", "yargs",
)
MARKER_FILE = "/tmp/DT_INIT"
EVENT_TYPES = {1: "EXECVE", 2: "OPENAT", 3: "CONNECT", 4: "WRITE", 5: "UNLINK"}

# --- fixed values: scoring ------------------------------------------------
UNLINK_POINTS = 15
CONNECTION_POINTS = 20
EXPECTED_EXECS = 6
BURST_SLACK = 5
BURST_MAX_POINTS = 20
MALICIOUS_FROM = 60
SUSPICIOUS_FROM = 25
REVIEW_FROM, REVIEW_TO = 11, 59
RECOMMENDATIONS = {
    "MALICIOUS": "BLOCK: do not install, several strong threat indicators fired",
    "SUSPICIOUS": "REVIEW: have a person look at this package before it is installed",
    "SAFE": "ALLOW: the behavior is what an npm install normally shows",
}


def checked(pack):
    """Return ``pack`` after checking that it is small enough to live in a plan."""
    if len(pack) > MAX_PACK_ROWS:
        raise ValueError(f"rule pack of {len(pack)} rows exceeds {MAX_PACK_ROWS}")
    return pack


def first_per_pattern(pack):
    """The pack with the first of several rules on one pattern, which is the one that counts."""
    return tuple({r.pattern: r for r in reversed(pack)}[p] for p in dict.fromkeys(r.pattern for r in pack))


def pack_table(spark: SparkSession, pack, kind: str) -> DataFrame:
    """Pack as a table (kind, ordinal, pattern, points, ...), for attribute lookup.

    Built from Arrow it is a local relation of known size, so Spark broadcasts
    it by its own statistics.
    """
    pack = checked(pack)
    pattern = [r.pattern if isinstance(r, EventRule) else r.regex for r in pack]
    return spark.createDataFrame(pa.table({
        "kind": pa.array([kind] * len(pack), pa.string()),
        "ordinal": pa.array(range(1, len(pack) + 1), pa.int32()),
        "pattern": pa.array(pattern, pa.string()),
        "points": pa.array([getattr(r, "points", 0) for r in pack], pa.int32()),
        "severity": pa.array([r.severity for r in pack], pa.string()),
        "category": pa.array([r.category for r in pack], pa.string()),
        "rule_text": pa.array([r.description for r in pack], pa.string()),
        "mitre_id": pa.array([r.mitre_id for r in pack], pa.string()),
        "mitre_name": pa.array([MITRE_NAMES.get(r.mitre_id, "") for r in pack], pa.string()),
    }))


def rules_from_table(table: DataFrame, rule_type=EventRule):
    """Read a user's pack from a table whose columns are the rule's fields.

    A pack is configuration: at most ``MAX_PACK_ROWS`` rows are accepted, a
    larger table is refused rather than cut.
    """
    names = [f for f in rule_type._fields if f in table.columns]
    rows = table.select(*names).limit(MAX_PACK_ROWS + 1).collect()
    fix = lambda v: tuple(v) if isinstance(v, list) else v
    return checked(tuple(rule_type(**{n: fix(r[n]) for n in names}) for r in rows))
