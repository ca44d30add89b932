"""Scanning lines for secrets and risky calls, and the score that findings give.  lines: (path, line_number, line)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (name, pattern, severity, extension or none, whether the value must look like a secret).
SECRETS = [
    ("AWS Access Key", r"AKIA[0-9A-Z]{16}", "critical", None, False),
    ("Service API Token", r"(?:gh[pousr]_[A-Za-z0-9]{20,255}|sk-(?:proj-)?[A-Za-z0-9_\-]{20,255}|AIza[0-9A-Za-z\-_]{35})", "critical", None, False),
    ("Private Key", r"-----BEGIN\s+(RSA|EC|DSA|OPENSSH)\s+PRIVATE\s+KEY-----", "critical", None, False),
    ("Connection String Password", r"""(?i)(?:password|pwd)["']?\s*[:=]\s*["']?([^;"'\s]{3,})""", "high", None, True),
    ("Credentialed URL", r"""(?i)https?://[^/\s:@"']+:([^@\s/"']{3,})@[^/\s"']+""", "high", None, False),
    ("Generic API Key", r"""(?i)["']?(?:api[_\-]?key|apikey|secret[_\-]?key)["']?\s*[:=]\s*["']([A-Za-z0-9_:/+\-=]{20,})["']""", "medium", None, True),
    ("Config Secret", r"""(?i)["']?(?:client[_\-]?secret|access[_\-]?token|refresh[_\-]?token|auth[_\-]?token|secret[_\-]?access[_\-]?key)["']?\s*[:=]\s*["']([^"']{10,})["']""", "high", None, True),
    ("JWT/Signing Secret", r"""(?i)["']?(?:jwt[_\-]?secret|signing[_\-]?key)["']?\s*[:=]\s*["']([^"']{10,})["']""", "high", None, True),
    ("Hardcoded Password Assignment", r"""(?i)(?:password|passwd)["']?\s*[:=]\s*"([^"]{3,})\"""", "high", ".cs", True),
]
# What marks a value as no secret.
PLACEHOLDER = r"(?i)(?:changeme|todo|placeholder|xxx|your[_\-]?key|replace[_\-]?me|dummy|fake)"
FALSE_POSITIVES = [
    r"""(?:password|passwd|pwd|pass)\s*=\s*["']\s*["']""", r"""(?:string|String)\s+(?:password|passwd|pass|pwd)\s*=\s*["']""", r"(?:password|passwd|pwd)\s*=\s*(?:\w+\.\w+|(?:this|model|request|options|config|settings|dto|entity|user|input|args|param|context|result|response|data|value|item|record|form|command|query)\.\w+)", r"""(?:string|var|object)\s+(?:password|passwd|pass)\s*=\s*[^\s"']""",
    r"(?:string|String)\s+(?:password|passwd|pass|pwd)\s*[,)]", r"(?:string|void|bool|Task|int)\s+\w+\s*\([^)]*(?:password|passwd|pass|pwd)\s*=", r"""(?:GetValue|GetSection|GetConnectionString)\s*\(\s*["'](?:password|pwd)""", r"""\[\s*["'](?:password|pwd)["']\s*\]""",
    r"(?:IsNullOrEmpty|IsNullOrWhiteSpace)\s*\(\s*(?:password|passwd|pwd)", r"(?:password|passwd|pwd)\s*(?:==|!=)\s*null", r"(?:public|private|protected|internal)\s+string\??\s+(?:Password|Passwd|Pwd)\s*\{", r"(?:password|passwd|pwd)\s*=\s*(?:null|default|string\.Empty|String\.Empty)",
    r"\[(?:Password|DataType\s*\(\s*DataType\.Password)", r"(?:Hash|Validate|Verify|Check|Reset|Change|Encode|Decode|Encrypt|Decrypt)Password",
]
# Risky calls in a line of C#, and what shows in a whole file.
RISKY_LINES = [
    ("Potential SQL injection", r'(?:ExecuteAsync|QueryAsync|QueryFirstAsync|QuerySingleAsync|FromSqlRaw|SqlCommand)(?:<[^>]+>)?\s*\(\s*\$"', "high"),
    ("Unsafe deserialization", r"(?:BinaryFormatter|JavaScriptSerializer|TypeNameHandling\s*\.\s*(?:All|Auto|Objects|Arrays))", "high"),
]
CORS = r"(?s)(?:AllowAnyOrigin\s*\(|SetIsOriginAllowed\s*\(\s*[^)]*=>\s*true)"
CREDENTIALS = r"AllowCredentials\s*\("
TLS = (
    r"(?s)(?:(?:ServerCertificateCustomValidationCallback|RemoteCertificateValidationCallback)\s*=\s*(?:HttpClientHandler\.)?DangerousAcceptAnyServerCertificateValidator"
    r"|(?:ServerCertificateCustomValidationCallback|RemoteCertificateValidationCallback)\s*=\s*(?:\([^)]*\)|\w+)\s*=>\s*true"
    r"|(?:ServerCertificateCustomValidationCallback|RemoteCertificateValidationCallback)[\s\S]{0,160}return\s+true\s*;)"
)
HTTP = r"""(?i)["']http://(?!localhost(?=[:/"'])|127\.0\.0\.1(?=[:/"'])|0\.0\.0\.0(?=[:/"'])|host\.docker\.internal(?=[:/"'])|\[::1\])[^"'\s]+["']"""
CONTROLLER = r"(?m)^[^\n]*class [^\n]*(?:Controller|: ControllerBase)|^[^\n]*(?:Controller|: ControllerBase)[^\n]*class "
# Path words of code that is not production, weights of severities, caps of categories.
NON_PRODUCTION = ["test", "tests", "spec", "specs", "__tests__", "fixture", "fixtures", "sample", "samples", "example", "examples", "mock", "mocks", "stub", "stubs", "demo", "demos", "benchmark", "benchmarks"]
WEIGHTS = {"critical": 2.5, "high": 1.5, "medium": 0.7, "low": 0.3}
CAPS = {"secret": 6.5, "attack_surface": 4.0, "vulnerable_package": 4.5}


def entropy(c: Column) -> Column:
    """Shannon entropy in bits over the ASCII characters."""
    chars = F.filter(F.split(c, ""), lambda x: (x != "") & (F.ascii(x) < 128))
    n = F.size(chars)
    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, x: s - (F.size(F.filter(chars, lambda y: y == x)) / n) * F.log2(F.size(F.filter(chars, lambda y: y == x)) / n))
    return F.when(n > 0, bits).otherwise(0.0)


def looks_secret(c: Column) -> Column:
    digit, upper, lower = c.rlike(r"\d"), c.rlike(r"\p{Lu}"), c.rlike(r"\p{Ll}")
    special = c.rlike(r"[!@#$%^&*()+={}\[\]|\\:;<>?,~]")
    uppers = F.length(F.regexp_replace(c, r"[^\p{Lu}]", ""))
    camel = (uppers >= 2) & (uppers < F.length(c)) & c.rlike(r"^\p{L}+$")
    return F.coalesce((F.length(c) >= 3) & F.when(special & (F.length(c) >= 6), True).when(digit & upper & lower & (entropy(c) > 2.5), True).when(~digit & ~special & camel, False).otherwise(entropy(c) > 4.0), F.lit(False))


def non_production(path: Column) -> Column:
    """Whether a segment of the path, or a part of one, marks tests, samples and the like."""
    parts = F.split(F.lower(path), r"[/\\._\- ]+")
    whole = F.split(F.lower(path), r"[/\\]+")
    marks = F.array(*map(F.lit, NON_PRODUCTION))
    return F.coalesce(F.arrays_overlap(parts, marks) | F.arrays_overlap(whole, marks), F.lit(False))


def sensitive_config(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, r"[/\\]"), -1))
    return (name.startswith("appsettings") & name.endswith(".json")) | name.startswith(".env") | name.isin("web.config", "app.config", "environment.config", "launchsettings.json", "secrets.json") | (name.startswith("docker-compose") & name.rlike(r"\.ya?ml$"))


def _of(rows: DataFrame) -> list[str]:
    """What a finding keeps of its file: the path, and its project and id where the rows have them."""
    return [c for c in ("file_id", "project", "path") if c in rows.columns]


def scan_secrets(lines: DataFrame) -> DataFrame:
    """([file_id, project,] path, line_number, title, severity) of every finding; all patterns in one pass over the lines."""
    line = F.col("line")
    live = lines.where(~non_production(F.col("path")) & (F.trim(line) != "") & ~F.ltrim(line).startswith("//"))
    clean = ~line.rlike(PLACEHOLDER) & ~line.rlike("(?i)(?:" + "|".join(FALSE_POSITIVES) + ")")
    hits = []
    for name, pattern, severity, ext, check in SECRETS:
        ok = line.rlike(pattern)
        if ext:
            ok = ok & F.lower("path").endswith(ext)
        if check:
            ok = ok & (sensitive_config(F.col("path")) | looks_secret(F.regexp_extract(line, pattern, 1)))
        hits.append(F.when(ok, F.struct(F.lit(f"{name} detected").alias("title"), F.lit(severity).alias("severity"))))
    return live.where(clean).select(*_of(lines), "line_number", F.explode(F.array_compact(F.array(*hits))).alias("h")).select(*_of(lines), "line_number", "h.title", "h.severity")


def scan_surface(lines: DataFrame) -> DataFrame:
    """([file_id, project,] path, line_number, title, severity) of risky calls in lines of C#."""
    hits = F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(t).alias("title"), F.lit(s).alias("severity"))) for t, p, s in RISKY_LINES])
    code = lines.where(F.lower("path").endswith(".cs") & ~non_production(F.col("path")))
    return code.select(*_of(lines), "line_number", F.explode(F.array_compact(hits)).alias("h")).select(*_of(lines), "line_number", "h.title", "h.severity")


def scan_files(files: DataFrame) -> DataFrame:
    """([file_id, project,] path, line_number, title, severity) of what shows only in a whole file: at most one finding of a kind, where it begins.

    files: ([file_id, project,] path, content).  Open CORS weighs more where credentials are allowed; a TLS callback may return true some lines on; a
    controller needs [Authorize or [AllowAnonymous.  All but endpoints are looked for in C# only."""
    text, cs = F.col("content"), F.lower("path").endswith(".cs")
    hit = lambda ok, pattern, title, severity: F.when(ok & text.rlike(pattern), F.struct(F.regexp_instr(text, F.lit(pattern)).alias("at"), title.alias("title"), severity.alias("severity")))
    lit, wide = F.lit, text.rlike(CREDENTIALS)
    bare = (text.contains("[ApiController]") | text.contains("[Route(")) & ~text.contains("[Authorize") & ~text.contains("[AllowAnonymous")
    hits = [
        hit(cs, CORS, F.when(wide, "CORS allows any origin with credentials").otherwise("Permissive CORS policy"), F.when(wide, "high").otherwise("medium")), hit(cs, TLS, lit("TLS certificate validation bypass"), lit("high")),
        hit(lit(True), HTTP, lit("Non-local HTTP endpoint"), lit("medium")), hit(cs & bare, CONTROLLER, lit("Controller without authorization"), lit("medium")),
    ]
    found = files.where(text.isNotNull() & ~non_production(F.col("path"))).select(*_of(files), "content", F.explode(F.array_compact(F.array(*hits))).alias("h"))
    before = F.substring(text, F.lit(1), F.col("h.at") - 1)
    return found.select(*_of(files), (F.length(before) - F.length(F.replace(before, lit("\n"), lit(""))) + 1).alias("line_number"), "h.title", "h.severity")


def attack_surface(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Risky calls by line, and the findings of whole files; repeated rows of a file give each finding once."""
    return scan_surface(lines).unionByName(scan_files(files)).distinct()


def weight(severity: Column) -> Column:
    out = F.lit(Decimal("0.5"))
    for name, w in WEIGHTS.items():
        out = F.when(severity == name, F.lit(Decimal(str(w)))).otherwise(out)
    return out.cast("decimal(12,2)")


def score(findings: DataFrame, key: str = "project") -> DataFrame:
    """(key, score): 10 less the capped penalties of the categories; within a scope the worst counts full, the rest 0.6.

    findings: (key, category, scope, severity)."""
    w = weight(F.col("severity"))  # decimals: the sums are exact in any order
    scopes = findings.groupBy(key, "category", "scope").agg((F.max(w) + F.lit(Decimal("0.6")) * (F.sum(w) - F.max(w))).cast("decimal(20,4)").alias("p"))
    cap = F.lit(Decimal("1000000000"))
    for name, c in CAPS.items():
        cap = F.when(F.col("category") == name, F.lit(Decimal(str(c)))).otherwise(cap)
    per = scopes.groupBy(key, "category").agg(F.sum("p").cast("decimal(20,4)").alias("p")).withColumn("p", F.least("p", cap.cast("decimal(20,4)")))
    total = F.greatest(F.lit(1).cast("decimal(20,4)"), F.lit(10).cast("decimal(20,4)") - F.sum("p").cast("decimal(20,4)"))
    return per.groupBy(key).agg(F.bround(total, 1).cast("double").alias("score"))
