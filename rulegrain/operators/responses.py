"""Passive checks of HTTP responses (url, status, headers, cookies)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import has_digit
from ..functions.web import cookie_flags, cookie_name, header, url_scheme
from ..schema import as_findings, ordinal

# Rule ids, severities and CWEs.
RESPONSE_RULES = {
    "DAST001": ("MEDIUM", "CWE-319", "No Strict-Transport-Security header.", "Send Strict-Transport-Security."),
    "DAST002": ("MEDIUM", "CWE-1021", "No Content-Security-Policy header.", "Send a Content-Security-Policy."),
    "DAST003": ("LOW", "CWE-16", "Content sniffing is not switched off.", "Send X-Content-Type-Options: nosniff."),
    "DAST004": ("MEDIUM", "CWE-1021", "The page can be framed by any site.", "Send X-Frame-Options or frame-ancestors."),
    "DAST005": ("LOW", "CWE-200", "A header names a software version.", "Drop the version from the header."),
    "DAST006": ("MEDIUM", "CWE-614", "A cookie lacks the Secure flag.", "Set Secure on the cookie."),
    "DAST007": ("MEDIUM", "CWE-1004", "A cookie lacks the HttpOnly flag.", "Set HttpOnly on the cookie."),
    "DAST008": ("HIGH", "CWE-319", "The site is served without encryption.", "Serve the site over HTTPS."),
}

# Headers that may name a software version.
VERSION_HEADERS = ["server", "x-powered-by", "x-aspnet-version"]


def response_log(responses: DataFrame) -> DataFrame:
    """Responses with the headers the checks read, looked up once whatever their case."""
    h = F.col("headers")
    return responses.select(
        "url",
        "status",
        url_scheme(F.col("url")).eqNullSafe(F.lit("https")).alias("is_https"),
        header(h, "strict-transport-security").alias("hsts"),
        header(h, "content-security-policy").alias("csp"),
        header(h, "x-content-type-options").alias("sniffing"),
        header(h, "x-frame-options").alias("framing"),
        F.array(*[F.struct(F.lit(n).alias("name"), header(h, n).alias("value")) for n in VERSION_HEADERS]).alias("versions"),
        F.coalesce(F.col("cookies"), F.array().cast("array<string>")).alias("cookies"),
    )


def _hit(rule: str, detail: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule_id"), detail.alias("detail"))


def _when(rule: str, condition: Column) -> Column:
    return F.when(condition, _hit(rule, F.lit("")))


def scan_responses(responses: DataFrame) -> DataFrame:
    """Findings DAST001-DAST008, one pass and no shuffle."""
    https = F.col("is_https")
    framed = F.col("framing").isNull() & ~F.contains(F.lower(F.coalesce("csp", F.lit(""))), F.lit("frame-ancestors"))
    page = F.array_compact(
        F.array(
            _when("DAST008", ~https),
            _when("DAST001", https & F.col("hsts").isNull()),
            _when("DAST002", F.col("csp").isNull()),
            _when("DAST003", F.lower(F.coalesce("sniffing", F.lit(""))) != "nosniff"),
            _when("DAST004", framed),
        )
    )
    disclosed = F.filter("versions", lambda v: F.coalesce(has_digit(v["value"]), F.lit(False)))
    versions = F.transform(disclosed, lambda v: _hit("DAST005", v["name"]))

    def cookie_hits(cookie: Column) -> Column:
        flags = cookie_flags(cookie)
        return F.array_compact(
            F.array(
                F.when(https & ~F.array_contains(flags, "secure"), _hit("DAST006", cookie_name(cookie))),
                F.when(~F.array_contains(flags, "httponly"), _hit("DAST007", cookie_name(cookie))),
            )
        )

    hits = F.concat(page, versions, F.flatten(F.transform("cookies", cookie_hits)))
    rows = response_log(responses).select("url", F.posexplode(hits).alias("position", "hit"))
    rule = F.col("hit.rule_id")

    def constant(i: int) -> Column:
        out = F.when(F.lit(False), "")
        for name, values in RESPONSE_RULES.items():
            out = out.when(rule == name, values[i])
        return out

    detail = F.when(F.col("hit.detail") != "", F.concat(F.lit(" ("), F.col("hit.detail"), F.lit(")"))).otherwise("")
    return as_findings(
        rows.select(
            rule.alias("rule_id"),
            constant(0).alias("severity"),
            F.concat(constant(2), detail).alias("message"),
            F.col("url").alias("file_path"),
            constant(1).alias("cwe"),
            F.lit("dast").alias("category"),
            constant(3).alias("remediation"),
            ordinal("code", F.col("position")).alias("ordinal"),
        )
    )
