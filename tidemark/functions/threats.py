"""Threat classification of request paths: ordered rules as data, first match wins."""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import let, percent_decode

# Rule patterns and their types, in the order in which they are tried.
RULES: list[tuple[str, list[str]]] = [
    ("XSS", [
        r"<script",
        r"javascript:",
        r"\b(onclick|onload|onerror|onmouseover|onmouseout|onfocus|onblur|onchange|onsubmit"
        r"|onkeydown|onkeyup|onkeypress|ondblclick|onmousedown|onmouseup|oncontextmenu|ondrag"
        r"|ondrop|onpaste)\s*=",
        r"<\s*\w+[^>]*\s+on\w+\s*=",
        r"<\s*(img|iframe|object|embed|svg|math|video|audio|source|body|input|form|button|a)\b",
    ]),
    ("PATH_TRAVERSAL", [
        r"\.\./", r"\.\.\\\\", r"/etc/passwd", r"/etc/shadow", r"\\\\windows\\\\",
    ]),
    ("CMD_INJECTION", [
        r"cmd\.exe", r"powershell", r"/bin/sh", r"/bin/bash", r"\|\s*\w+", r";\s*\w+",
    ]),
    ("SQL_INJECTION", [
        r"'\s*(or|and)\s+.*=", r"union\s+select", r"drop\s+table",
    ]),
    ("VULN_SCAN", [
        r"\.env", r"wp-admin", r"phpMyAdmin", r"\.git/", r"\.htaccess",
    ]),
    ("PHP_PROBE", [
        r"XDEBUG_SESSION", r"phpinfo", r"\.php", r"eval\s*\(", r"base64_decode",
    ]),
    ("CMS_PROBE", [
        r"wp-content", r"wp-includes", r"wp-login", r"xmlrpc\.php", r"rest_route=", r"/wp/v2/",
        r"/wp-json/",
    ]),
    ("CONFIG_PROBE", [
        r"\.bak", r"\.backup", r"database\.", r"\.sql",
    ]),
    ("RCE_EXPLOIT", [
        r"invokefunction", r"call_user_func", r"think\\\\app", r"system\s*\(", r"exec\s*\(",
        r"shell_exec", r"passthru", r"proc_open", r"popen\s*\(",
    ]),
    ("SHELL_PROBE", [
        r"\bprintenv\b", r"\bwhoami\b", r"\bid\b", r"\buname\b", r"\bcat\s+/", r"\bwget\s+",
        r"\bcurl\s+",
    ]),
    ("SSRF_PROBE", [
        r"\bdns=", r"&type=A\b", r"dnsmeasure", r"\.oast\.", r"interact\.sh", r"pingback\.",
    ]),
]


# Non-ASCII letters that equal an ASCII one when case is ignored.
_FOLDED = ("\u017f\u212a\u0131\u0130", "skii")
_NO_LITERAL = re.compile(r"\([^)]*\)|\[[^\]]*\][*+?]?|\\[bsw][*+?]?|\.[*+?]")


def alternation(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def required_literal(pattern: str) -> str:
    """A text that every match of a rule contains, in lower case: with punctuation if possible, as
    words are common in paths, and as long as possible."""
    parts = _NO_LITERAL.sub("\0", pattern).split("\0")
    texts = [re.sub(r"\\(.)", r"\1", p).lower() for p in parts]
    return max(texts, key=lambda t: (bool(re.search(r"[^a-z0-9_]", t)), len(t)))


def _may_match(folded: Column, patterns: list[str]) -> Column:
    return reduce(operator.or_, [folded.contains(t) for t in sorted({required_literal(p) for p in patterns})])


def _first_hit(decoded: Column, folded: Column) -> Column:
    return F.coalesce(*[
        F.when(_may_match(folded, patterns) & decoded.rlike("(?idU)" + alternation(patterns)), F.lit(kind))
        for kind, patterns in RULES])


def threat_type(path: Column) -> Column:
    """Type of the first rule that hits the decoded path; null if none does.

    Rules of one type are adjacent, so one alternation per type keeps the order. A type's regex only
    runs where a text that one of its rules cannot do without is found: for most paths that is plain
    substring search. Decoding happens once, however often a filter on the type is moved.
    """
    return let(percent_decode(path), lambda d: let(
        F.lower(F.translate(d, *_FOLDED)), lambda folded: _first_hit(d, folded)))
