"""Scalar expressions: first-match chains, versions, names, labels."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataq.functions import dims


def first_match(test: Callable[[str], Column], pairs: Iterable[tuple[str, object]], otherwise: Column | None = None) -> Column:
    """The value of the first pair whose pattern passes the test; a flat CASE, so
    it stays in generated code."""
    chain = None
    for pattern, value in pairs:
        chain = F.when(test(pattern), F.lit(value)) if chain is None else chain.when(test(pattern), F.lit(value))
    return chain if otherwise is None else chain.otherwise(otherwise)


def mapped(col: Column, table: Mapping[str, str], otherwise: Column | None = None) -> Column:
    return first_match(lambda k: col == k, table.items(), col if otherwise is None else otherwise)


def before(col: Column, mark: str) -> Column:
    return F.substring_index(col, mark, 1)


def go_version(v: Column) -> Column:
    """Without a replacement after =>."""
    return F.trim(before(F.trim(v), "=>"))


def npm_version(v: Column) -> Column:
    """Range marks off the front, each once and in this order; the first
    alternative of a range. What follows a mark isn't trimmed again."""
    bare = F.regexp_replace(F.trim(v), r"^\^?~?(>=)?>?(<=)?<?=?", "")
    first = F.when(bare.contains(" - "), F.trim(before(bare, " - "))).otherwise(bare)
    return F.when(first.contains(" || "), F.trim(before(first, " || "))).otherwise(first)


REQUIREMENT = r"^([a-zA-Z0-9_-]+)(?:\[[^\]]*\])?(.*)$"


def requirement_line(line: Column) -> tuple[Column, Column]:
    """Name and version of a requirements line, both null where it holds none."""
    bare = F.trim(before(before(F.trim(line), "#"), ";"))
    keep = (bare != "") & ~F.trim(line).rlike(r"^[#-]")
    name = F.when(keep & bare.rlike(REQUIREMENT), F.regexp_extract(bare, REQUIREMENT, 1))
    spec = F.trim(F.regexp_extract(bare, REQUIREMENT, 2))
    return name, F.when(name.isNotNull(), F.trim(F.regexp_replace(spec, r"^(==|>=|<=|~=|!=|>|<)", "")))


def package_alias(path: Column) -> Column:
    """Last path segment; the one before it when the last is a major version."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    return F.when(last.rlike("^v[0-9]+$") & (F.size(parts) > 1), F.try_element_at(parts, F.lit(-2))).otherwise(last)


def call_package(site: Column) -> Column:
    """Up to the last dot; the empty text without one."""
    return F.regexp_extract(site, r"^(.*)\.[^.]*$", 1)


def short_function(name: Column) -> Column:
    return F.substring_index(name, "/", -1)


def relative_path(path: Column, root: Column) -> Column:
    return F.when(path == root, F.lit(".")).when(path.startswith(F.concat(root, F.lit("/"))), F.concat(F.lit("./"), F.substring(path, F.char_length(root) + 2, F.char_length(path)))).otherwise(path)


def algorithm_key(alg: Column) -> Column:
    return F.lower(F.regexp_replace(alg, "_", "-"))


def remediation_key(alg: Column) -> Column:
    """Remediation entry of an algorithm: the exact name, else the first pattern
    its upper-case form contains, else 'default'."""
    keys = dict.fromkeys(k for _, k in dims.REMEDIATION_PATTERNS)
    upper = F.upper(F.trim(alg))
    return F.when(alg.isin(*keys), alg).otherwise(first_match(lambda p: upper.contains(p), dims.REMEDIATION_PATTERNS, F.lit("default")))


def import_match(path: Column, ecosystem: Column) -> Column:
    """The first import pattern that equals the path or begins it up to a slash."""
    chain = None
    for eco in dims.IMPORT_PATTERNS:
        one = first_match(lambda p: (path == p) | path.startswith(p + "/"), [(p, p) for p, _ in dims.IMPORT_PATTERNS.get(eco, ())])
        chain = F.when(ecosystem == eco, one) if chain is None else chain.when(ecosystem == eco, one)
    return chain


def risk_rank(risk: Column) -> Column:
    return first_match(lambda r: risk == r, dims.RISK_ORDER.items(), F.lit(0))


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("CRITICAL", "HIGH"), "error").when(severity == "MEDIUM", "warning").otherwise("note")


def inferred_severity(risk: Column) -> Column:
    return F.when(risk == "VULNERABLE", "HIGH").when(risk == "PARTIAL", "MEDIUM").otherwise("INFO")


def risk_label(risk: Column) -> Column:
    return F.when(risk.isin("VULNERABLE", "PARTIAL", "SAFE"), risk).otherwise("UNKNOWN")


# fixed values: labels
TIMELINE = {"immediate": "Immediate", "short-term": "Short-term (1-2 years)", "medium-term": "Medium-term (2-5 years)", "none": "No action needed"}
TIMELINE_SHORT = {"immediate": "NOW", "short-term": "1-2yr", "medium-term": "2-5yr", "none": "-"}
EFFORT_SHORT = {"low": "low", "medium": "med", "high": "high", "none": "-"}


def package_label(name: Column, version: Column) -> Column:
    return F.when(F.coalesce(version, F.lit("")) != "", F.concat(name, F.lit("@"), version)).otherwise(name)


_SHORT = [k for k in dims.CRYPTO_KEYWORDS if len(k) < 4]
_LONG = [k for k in dims.CRYPTO_KEYWORDS if len(k) >= 4]
#: keywords of four letters anywhere, shorter ones as words of their own or beside a hyphen
CRYPTO_REGEX = "|".join([*_LONG, *(f"(^|[^a-zA-Z0-9]){k}([^a-zA-Z0-9]|$)|-{k}|{k}-" for k in _SHORT)])


def crypto_related(name: Column, description: Column, keywords: Column) -> Column:
    is_so = lambda c: F.coalesce(F.lower(c).rlike(CRYPTO_REGEX), F.lit(False))
    return is_so(name) | is_so(description) | F.coalesce(F.exists(keywords, is_so), F.lit(False))


def split_keywords(text: Column) -> Column:
    return F.filter(F.split(text, "[,; ]"), lambda x: x != "")
