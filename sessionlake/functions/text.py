"""Scalar text functions as column expressions."""

from __future__ import annotations

import functools
import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as in ECMAScript: fixed values; neither Java's class nor its Unicode variant is the same.
SPACE = r"[\t\n\x0B\f\r\x20\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

#: Our own rules for secrets: (pattern, replacement, literals of which a match holds one, in lower case). Labels stay, values
#: and whole keys go.
SCRUB_RULES = (
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED]", ("private key-----",)),
    (r"\b(sk|pk|rk)-[A-Za-z0-9_-]{16,}", "[REDACTED]", ("sk-", "pk-", "rk-")),
    (r"\bgh[pousr]_[A-Za-z0-9]{20,}", "[REDACTED]", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    (r"\bxox[abprs]-[A-Za-z0-9-]{10,}", "[REDACTED]", ("xox",)),
    (r"\bAKIA[A-Z0-9]{16}\b", "[REDACTED]", ("akia",)),
    (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "[REDACTED]", ("eyj",)),
    (r"(?i)\b(bearer )[A-Za-z0-9._~+/=-]{12,}", "$1[REDACTED]", ("bearer ",)),
    (r"(?i)\b((?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s*[:=]\s*[\"']?)[^\s\"',;]+", "$1[REDACTED]", ("password", "passwd", "pwd", "secret", "token", "api")),
)


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column) -> Column:
    """Trimmed, with single blanks for runs of white space."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def content_hash(text: Column) -> Column:
    """A decision's identity: SHA-256 of the collapsed lower-case text."""
    return F.sha2(F.lower(collapse(text)), 256)


def normalize_repo(repo: Column) -> Column:
    """A repository's identity: trimmed lower case, path included; null if blank."""
    return F.nullif(F.lower(js_trim(repo)), F.lit(""))


def repo_leaf(repo: Column) -> Column:
    """The key of the majority vote: the last segment, whichever slash parts it, in lower case."""
    plain = F.regexp_replace(js_trim(repo), r"[/\\]+$", "")
    return F.lower(F.element_at(F.split(plain, r"[/\\]"), -1))


def repo_display(repo: Column) -> Column:
    """The last segment that is not empty; empty if there is none."""
    return F.coalesce(F.try_element_at(F.filter(F.split(repo, "/"), lambda s: s != ""), F.lit(-1)), F.lit(""))


def enforce_repo_prefix(name: Column, repo: Column) -> Column:
    """``display: tail`` for a cluster of a repository, whatever prefix the name has; names of others stay as they are."""
    identity = normalize_repo(repo)
    display = repo_display(identity)
    trimmed = js_trim(name)
    tail = F.when(F.instr(trimmed, ":") > 0, js_trim(F.regexp_replace(trimmed, "(?s)^[^:]*:", ""))).otherwise(trimmed)
    bare = F.coalesce(normalize_repo(tail), F.lit(""))
    return F.when(identity.isNull(), name).when((bare == "") | (bare == identity) | (bare == display), display).otherwise(F.concat(display, F.lit(": "), tail))


def scrub(text: Column, rules: tuple[tuple[str, str, tuple[str, ...]], ...] = SCRUB_RULES) -> Column:
    """The text without secrets. The rules are applied, one after the other, only where one of their literals is found, which is far cheaper.

    A text is named but a few times in the expression, however many rules there are, so that it compiles.
    """
    clean = functools.reduce(lambda t, rule: F.regexp_replace(t, rule[0], rule[1]), rules, text)
    # Lower case is made once for all literals.
    may = F.exists(F.array(F.lower(text)), lambda lower: functools.reduce(Column.__or__, (F.contains(lower, F.lit(x)) for rule in rules for x in rule[2])))
    return F.when(may, clean).otherwise(text)


def round4(x: Column) -> Column:
    """Four places, halves upwards."""
    return F.floor(x * 10_000 + 0.5) / 10_000


def first_statement(*fields: Column) -> Column:
    """The first field that is not blank."""
    return F.coalesce(*(F.nullif(js_trim(f), F.lit("")) for f in fields))


def clamp_limit(value: object, default: int = 20, most: int = 50) -> int:
    """A result limit: anything but a positive finite number means the default; fractions are cut, so one half is none."""
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value) or value <= 0:
        return default
    return min(most, math.floor(value))


def tool_limit(value: object) -> int | None:
    """A tool's limit argument is left out or a whole number from 1 to 50; unlike ``clamp_limit``, nothing else is mended."""
    if value is None:
        return None
    if isinstance(value, bool) or not isinstance(value, int | float) or value != value or value not in range(1, 51):
        raise ValueError(f"not a limit: {value!r}")
    return int(value)


#: A note's sections: (field, title), as rendered, in order; the first three are inline, the others lists.
INLINE = (("topic", "Topic"), ("summary", "One-line summary"), ("context", "Context"))
SECTIONS = (
    ("key_details", "Key Details"),
    ("decisions", "Decisions & Reasoning"),
    ("derived_conclusions", "Findings & Analysis"),
    ("code_implementation", "Code & Implementation"),
    ("preferences_corrections", "Preferences & Corrections"),
    ("open_threads", "Open Threads"),
)


def render_note(note: Column) -> Column:
    """A note's text: its sections that are not empty, parted by blank lines. Tags are not rendered."""
    inline = [F.when(F.coalesce(note[f], F.lit("")) != "", F.concat(F.lit(f"**{title}**: "), note[f])) for f, title in INLINE]
    lists = [
        F.when(F.size(F.coalesce(note[f], F.array().cast("array<string>"))) > 0, F.concat(F.lit(f"**{title}**:\n"), F.array_join(F.transform(note[f], lambda i: F.concat(F.lit("- "), i)), "\n")))
        for f, title in SECTIONS
    ]
    return F.concat_ws("\n\n", *inline, *lists)


NOTE_FIELDS = "topic string, summary string, context string, key_details array<string>, decisions array<string>, derived_conclusions array<string>, code_implementation array<string>, preferences_corrections array<string>, open_threads array<string>, tags array<string>"


def parse_note(text: Column) -> Column:
    """A distilled note of its JSON; null if that is no JSON object. Only strings count as strings, blank items of lists go."""
    parsed = F.try_parse_json(text)

    def typed(value: Column) -> Column:
        return F.when(F.schema_of_variant(value) == "STRING", F.variant_get(value, "$", "string"))

    fields = []
    for name in ("topic", "summary", "context"):
        fields.append(F.coalesce(js_trim(typed(F.try_variant_get(parsed, f"$.{name}", "variant"))), F.lit("")).alias(name))
    for name in [f for f, _ in SECTIONS] + ["tags"]:
        items = F.coalesce(F.try_variant_get(parsed, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
        fields.append(F.filter(F.transform(items, lambda v: js_trim(typed(v))), lambda s: s.isNotNull() & (s != "")).alias(name))
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), F.struct(*fields))


def merge_notes(notes: Column) -> Column:
    """One note of an array of notes: the first topic and context that are not blank, summaries joined, lists united in order."""

    def first(name: str) -> Column:
        return F.coalesce(F.try_element_at(F.filter(F.transform(notes, lambda n: js_trim(n[name])), lambda s: s != ""), F.lit(1)), F.lit(""))

    def union(name: str) -> Column:
        return F.array_distinct(F.filter(F.transform(F.flatten(F.transform(notes, lambda n: n[name])), js_trim), lambda s: s != ""))

    summaries = F.array_join(F.filter(F.transform(notes, lambda n: js_trim(n["summary"])), lambda s: s != ""), "; ")
    lists = [union(f).alias(f) for f in [f for f, _ in SECTIONS] + ["tags"]]
    return F.struct(first("topic").alias("topic"), summaries.alias("summary"), first("context").alias("context"), *lists)


def safe_excerpt(text: Column, secrets: list[str], most: int = 512) -> Column:
    """An error message fit to be stored: known secrets, also as JSON writes them, authorisation lines and bearer tokens go first."""
    for secret in filter(None, secrets):
        for form in dict.fromkeys((secret, json.dumps(secret, ensure_ascii=False)[1:-1])):
            text = F.replace(text, F.lit(form), F.lit("[REDACTED]"))
    text = F.regexp_replace(text, r"(?im)^((?:proxy-)?authorization|x-api-key)[ \t]*:[^\r\n]*", "$1: [REDACTED]")
    text = F.regexp_replace(text, r"(?i)\bbearer[ \t]+[^ \t\r\n]+", "Bearer [REDACTED]")
    return F.substring(F.regexp_replace(text, r"[\r\n]+", " "), 1, most)
