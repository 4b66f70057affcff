"""The rule tables: one row per detector."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import constant_table


@dataclass(frozen=True)
class LineRule:
    """A regex rule over one line; ``needles`` are literals of which a match holds at least one."""

    rule_id: str
    lang: str
    severity: str
    cwe: str
    pattern: str
    needles: tuple[str, ...]
    message: str
    remediation: str
    fixable: bool = False


# Rule ids, severities, CWEs and patterns.
LINE_RULES = [
    LineRule("JS001", "js", "HIGH", "CWE-79", r"\.innerHTML\s*[+]?=\s*", (".innerHTML",),
             "Markup is written through innerHTML, a cross-site scripting sink.",
             "Write text with textContent or sanitise the markup first."),
    LineRule("JS002", "js", "HIGH", "CWE-79", r"document\.write\s*\(", ("document.write",),
             "document.write puts unescaped markup into the page.",
             "Create DOM nodes instead, or escape the value."),
    LineRule("JS003", "js", "CRITICAL", "CWE-95", r"(?<![.\w])eval\s*\(", ("eval",),
             "eval runs any string as code.",
             "Parse data with JSON.parse and drop eval."),
    LineRule("JS004", "js", "HIGH", "CWE-95", r"new\s+Function\s*\(", ("Function",),
             "The Function constructor compiles a string into code.",
             "Write the function out instead of building it from text."),
    LineRule("JS005", "js", "HIGH", "CWE-78", r"child_process\.(?:exec|execSync)\s*\(", ("child_process.exec",),
             "child_process.exec hands its argument to a shell.",
             "Use spawn or execFile with a list of arguments."),
    LineRule("JS006", "js", "MEDIUM", "CWE-79", r"\bdangerouslySetInnerHTML\b", ("dangerouslySetInnerHTML",),
             "dangerouslySetInnerHTML bypasses React's escaping.",
             "Sanitise the markup before rendering it."),
    LineRule("JS007", "js", "MEDIUM", "CWE-95", r"\bset(?:Timeout|Interval)\s*\(\s*['\"]", ("setTimeout", "setInterval"),
             "A timer with a string argument evaluates that string.",
             "Hand the timer a function."),
    LineRule("GO001", "go", "HIGH", "CWE-78", r'exec\.Command\(\s*"(?:sh|bash|zsh|cmd|powershell)"', ("exec.Command(",),
             "A shell is started through exec.Command.",
             "Start the program itself with separate arguments."),
    LineRule("GO002", "go", "HIGH", "CWE-89", r"\.(?:Query|QueryRow|QueryContext|Exec|ExecContext)\([^)]*(?:fmt\.Sprintf|\+)",
             (".Query", ".Exec"),
             "A SQL statement is assembled from strings.",
             "Pass the values as query parameters."),
    LineRule("GO003", "go", "MEDIUM", "CWE-327", r"\b(?:md5|sha1)\.New\(\)", (".New()",),
             "MD5 and SHA-1 are too weak for security uses.",
             "Use SHA-256, or a password hash for passwords."),
    LineRule("GO004", "go", "HIGH", "CWE-295", r"InsecureSkipVerify\s*:\s*true", ("InsecureSkipVerify",),
             "TLS certificates are not verified.",
             "Set InsecureSkipVerify to false and trust the right authority.", True),
    LineRule("JAVA001", "java", "HIGH", "CWE-78", r"Runtime\.getRuntime\(\)\.exec\(", ("Runtime.getRuntime().exec(",),
             "A command line is run through Runtime.exec.",
             "Use ProcessBuilder with a fixed list of arguments."),
    LineRule("JAVA002", "java", "HIGH", "CWE-89", r"\.(?:executeQuery|executeUpdate|execute)\([^)]*\+", (".execute",),
             "A SQL statement is concatenated.",
             "Use a PreparedStatement with placeholders."),
    LineRule("JAVA003", "java", "MEDIUM", "CWE-327", r'MessageDigest\.getInstance\(\s*"(?:MD5|SHA-1|SHA1)"',
             ("MessageDigest.getInstance(",),
             "MD5 and SHA-1 are too weak for security uses.",
             "Ask for SHA-256, or use a password hash."),
    LineRule("JAVA004", "java", "HIGH", "CWE-502", r"new\s+ObjectInputStream\(|\.readObject\(\)",
             ("ObjectInputStream(", ".readObject()"),
             "Native deserialisation of untrusted data can run code.",
             "Read a plain format such as JSON against an allow-list."),
]

# Our own choice of patterns, severities and CWE; the fixed part is the meaning of the ids.
SECRET_RULES = [
    LineRule("SEC001", "secret", "CRITICAL", "CWE-798", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", ("PRIVATE KEY-----",),
             "A private key is stored in the file.", "Move the key to a secret store and replace it."),
    LineRule("SEC002", "secret", "CRITICAL", "CWE-798", r"\bAKIA[0-9A-Z]{16}\b", ("AKIA",),
             "An AWS access key id is stored in the file.", "Revoke the key and read it from the environment."),
    LineRule("SEC003", "secret", "CRITICAL", "CWE-798", r"\bsk-[A-Za-z0-9]{20,}", ("sk-",),
             "An API token is stored in the file.", "Revoke the token and read it from the environment."),
    LineRule("SEC004", "secret", "CRITICAL", "CWE-798", r"\bgh[pousr]_[A-Za-z0-9]{36,}",
             ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
             "A GitHub token is stored in the file.", "Revoke the token and read it from the environment."),
    LineRule("SEC005", "secret", "CRITICAL", "CWE-798", r"\bxox[baprs]-[A-Za-z0-9-]{10,}",
             ("xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-"),
             "A Slack token is stored in the file.", "Revoke the token and read it from the environment."),
    LineRule("SEC007", "secret", "HIGH", "CWE-798", r"AIza[0-9A-Za-z_\-]{35}", ("AIza",),
             "A Google API key is stored in the file.", "Restrict or replace the key and read it from the environment."),
    LineRule("SEC008", "secret", "HIGH", "CWE-798", r"eyJ[\w-]{10,}\.eyJ[\w-]{10,}\.[\w-]{10,}", ("eyJ",),
             "A signed web token is stored in the file.", "Revoke the token and issue it at run time."),
]

GENERIC_SECRET = LineRule(
    "SEC006", "secret", "HIGH", "CWE-798", "", (),
    "A credential with a random-looking value is assigned in the file.",
    "Read the value from the environment.", True)

# Names that mark a credential, and the shape of an assigned value.
SECRET_NAMES = r"password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential"
SECRET_VALUE = r"""(['"])([^'"\n]{6,})"""
SECRET_NEEDLES = ("passw", "pwd", "secret", "token", "key", "auth", "credential")

# Our own choice: below this many bits per character a value is no secret, nor are these words.
MIN_ENTROPY = 3.0
PLACEHOLDER = r"(?i)change_?me|example|placeholder|your[_-]|dummy|<[^>]*>|x{6,}|\*{4,}|\$\{"


@dataclass(frozen=True)
class FactRule:
    """A rule over facts of Python syntax trees; the condition lives beside the facts."""

    rule_id: str
    severity: str
    cwe: str | None
    message: str
    remediation: str
    fixable: bool = False


# Rule ids, severities, CWEs and which of them can be fixed.
PYTHON_RULES = [
    FactRule("PY000", "LOW", None, "The file could not be read or parsed.", ""),
    FactRule("PY001", "CRITICAL", "CWE-95", "eval runs any string as code.",
             "Read literals with ast.literal_eval, or parse the input."),
    FactRule("PY002", "CRITICAL", "CWE-95", "exec runs any string as code.", "Call the functions you need by name."),
    FactRule("PY003", "HIGH", "CWE-78", "os.system hands its argument to a shell.",
             "Use subprocess.run with a list of arguments."),
    FactRule("PY004", "HIGH", "CWE-78", "A subprocess is started through a shell.",
             "Pass a list of arguments without shell=True."),
    FactRule("PY005", "HIGH", "CWE-502", "Unpickling untrusted data can run code.", "Read a plain format such as JSON."),
    FactRule("PY006", "HIGH", "CWE-20", "yaml.load without a safe loader can build any object.",
             "Use yaml.safe_load.", True),
    FactRule("PY007", "MEDIUM", "CWE-327", "MD5 and SHA-1 are too weak for security uses.",
             "Use SHA-256, or a password hash for passwords."),
    FactRule("PY008", "HIGH", "CWE-89", "A SQL statement is assembled from strings.",
             "Pass the values as query parameters."),
    FactRule("PY009", "HIGH", "CWE-295", "TLS certificates are not verified.",
             "Drop verify=False or name a certificate bundle.", True),
    FactRule("PY010", "HIGH", "CWE-489", "A web server is started in debug mode.", "Start it with debug=False.", True),
    FactRule("PY011", "MEDIUM", "CWE-22", "extractall may write outside its target directory.",
             "Check every member's path before extracting."),
    FactRule("PY012", "MEDIUM", "CWE-377", "tempfile.mktemp leaves a race before the file is opened.",
             "Use mkstemp or NamedTemporaryFile."),
    FactRule("PY013", "HIGH", "CWE-79", "Templates are rendered without escaping.", "Switch autoescape on.", True),
    FactRule("PY014", "MEDIUM", "CWE-668", "The service listens on every network interface.",
             "Listen on 127.0.0.1 unless outside access is wanted."),
    FactRule("DJ001", "CRITICAL", "CWE-798", "SECRET_KEY is written into the settings.", "Read it from the environment."),
    FactRule("DJ002", "HIGH", "CWE-20", "ALLOWED_HOSTS accepts every host name.", "List the trusted host names."),
    FactRule("DJ003", "HIGH", "CWE-489", "DEBUG is on in the settings.", "Set DEBUG to False outside development."),
]


def rule_table(spark: SparkSession) -> DataFrame:
    """Every line and syntax rule as rows; its size is fixed by the lists above."""
    rows = [
        (r.rule_id, "secret" if r.rule_id.startswith("SEC") else "sast", r.severity, r.cwe, r.message, r.remediation, r.fixable, i)
        for i, r in enumerate([*LINE_RULES, *SECRET_RULES, GENERIC_SECRET, *PYTHON_RULES])
    ]
    columns = dict.fromkeys(["rule_id", "category", "severity", "cwe", "message", "remediation"], "string")
    return constant_table(spark, columns | {"fixable": "boolean", "rule_order": "int"}, rows)
