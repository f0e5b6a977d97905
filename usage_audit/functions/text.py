"""Column functions over names, log fields and texts. Everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as V

Col = Column | str


def _c(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def empty_to_null(c: Col) -> Column:
    return F.nullif(F.trim(_c(c)), F.lit(""))


def mapped(c: Col, values: dict[str, str], otherwise: Column | None = None) -> Column:
    """`values` at c, else `otherwise` (null if not given)."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    found = F.try_element_at(table, _c(c))
    return found if otherwise is None else F.coalesce(found, otherwise)


def is_sweepable(alias: Col) -> Column:
    """May a bare alias be matched in prose or markup? Marked or id-shaped ones may; short and common words may not."""
    a = _c(alias)
    looks = F.length(a).isin(15, 18) & a.rlike("^[A-Za-z0-9]+$") & a.rlike("[0-9]")
    sweepable = F.when(a.rlike(r"[_.$/]"), True).when(looks, True).when(a.isin(*sorted(set(V.COMMON_WORDS))), False)
    return F.coalesce(sweepable.otherwise(F.length(a) >= V.SHORTEST_BARE_WORD), F.lit(False))


def bare_name(name: Col) -> Column:
    """The name without its custom suffix, in any case."""
    return F.regexp_replace(_c(name), r"(?i)(__c|__mdt|__e|__b|__x)$", "")


def id15(sf_id: Col) -> Column:
    """The 15-character form of an 18-character id; null for anything else."""
    return F.when(F.length(_c(sf_id)) == 18, F.substring(_c(sf_id), 1, 15))


def looks_like_id(c: Col) -> Column:
    return _c(c).rlike("^[A-Za-z0-9]{15}([A-Za-z0-9]{3})?$") & _c(c).rlike("[0-9]")


def camel_to_kebab(name: Col) -> Column:
    first = F.regexp_replace(_c(name), r"(.)([A-Z][a-z]+)", "$1-$2")
    return F.lower(F.regexp_replace(first, r"([a-z0-9])([A-Z])", "$1-$2"))


def is_custom_object(name: Col) -> Column:
    n = F.trim(F.coalesce(_c(name), F.lit("")))
    return n.rlike("__[cC]$") & ~F.lower(n).isin(*V.STANDARD_ENTITIES)


def parse_entry_point(entry: Col) -> Column:
    """struct(kind, name, detail) of a log's entry point: a class (with method), a trigger (with events), or skip."""
    raw = F.trim(F.coalesce(_c(entry), F.lit("")))
    low = F.lower(raw)

    def out(kind: str, name: Column, detail: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), detail.alias("detail"))

    nothing = out("skip", F.lit(""), F.lit(""))
    on = F.trim(F.element_at(F.split(raw, " on ", 2), 1))
    event = F.trim(F.element_at(F.split(low, " trigger event "), -1))
    plain = F.regexp_replace(raw, r"[()]+$", "")
    left, right = F.trim(F.regexp_extract(plain, r"^(.*)\.([^.]*)$", 1)), F.trim(F.regexp_extract(plain, r"^(.*)\.([^.]*)$", 2))
    dotted = (left != "") & (right != "") & ~left.contains(" ") & ~right.contains(" ")
    noise = (raw == "") | low.isin(*V.SKIPPED_ENTRY_POINTS) | low.startswith("vf-") | low.startswith("/apex/")
    return (
        F.when(noise, nothing)
        .when(low.contains(" trigger event ") & low.contains(" on "), F.when(on != "", out("trigger", on, event)).otherwise(nothing))
        .when(dotted, out("class", left, right))
        .when(~raw.contains(" ") & ~raw.contains("/"), out("class", raw, F.lit("")))
        .otherwise(nothing)
    )


def _query_text(query: Col) -> Column:
    plain = F.coalesce(F.try_url_decode(F.regexp_replace(_c(query), r"\+", "%2B")), _c(query), F.lit(""))
    return F.regexp_replace(F.trim(plain), '^"+|"+$', "")


def soql_objects(query: Col) -> Column:
    """Lower-cased custom objects after FROM, in order, repeats kept."""
    found = F.regexp_extract_all(_query_text(query), F.lit(r"(?i)\bFROM\s+([A-Za-z][A-Za-z0-9_]*)\b"), 1)
    return F.transform(F.filter(found, lambda o: F.lower(o).endswith("__c")), F.lower)


def soql_fields(query: Col) -> Column:
    """Lower-cased names that end in __c, objects after FROM included."""
    return F.transform(F.regexp_extract_all(_query_text(query), F.lit(r"\b([A-Za-z][A-Za-z0-9_]*__[cC])\b"), 1), F.lower)


def ui_component_names(raw: Col) -> Column:
    """Names after c:, c/, aura: or markup://, the first spelling of each."""
    found = F.regexp_extract_all(F.coalesce(_c(raw), F.lit("")), F.lit(r"(?i)(?:^|[;,\s])(?:c:|c/|aura:|markup://c:|markup://aura:)([A-Za-z][A-Za-z0-9_]*)"), 1)
    return F.aggregate(found, F.array().cast("array<string>"), lambda got, x: F.when(F.exists(got, lambda y: F.lower(y) == F.lower(x)), got).otherwise(F.concat(got, F.array(x))))


def rest_path_token(uri: Col) -> Column:
    """The first segment of a custom REST path in lower case; empty for platform paths and for anything else."""
    plain = F.trim(F.coalesce(F.try_url_decode(F.regexp_replace(_c(uri), r"\+", "%2B")), _c(uri), F.lit("")))
    parts = F.filter(F.split(plain, "/"), lambda p: (p != "") & ~p.startswith("{"))
    first = F.coalesce(F.get(parts, 0), F.lit(""))
    return F.when(F.lower(plain).contains("/services/") | ~first.rlike("^[A-Za-z][A-Za-z0-9_]*$"), F.lit("")).otherwise(F.lower(first))


def rest_path_keys(class_name: Col) -> Column:
    """The paths under which a class may serve: its name, and its name without a service suffix."""
    low = F.lower(_c(class_name))
    short = F.regexp_replace(low, "(restservice|restresource|resource|controller|service)$", "")
    return F.array_distinct(F.filter(F.array(low, short), lambda x: x != ""))


def redact(text: Col) -> Column:
    """Credential-shaped values of eight characters or more as key=[REDACTED], wherever the key's name ends with such a word."""
    return F.regexp_replace(_c(text), V.SECRETS, "$1=[REDACTED]")


def parse_timestamp(c: Col) -> Column:
    """A timestamp with +0000, Z or no zone; null where it can't be read."""
    s = F.trim(_c(c))
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss.SSSZ", "yyyy-MM-dd'T'HH:mm:ssZ", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")])


def recently_changed(created: Col, modified: Col, now: Column, days: Column) -> Column:
    """Is the newer of both after now less `days` (30 where days isn't from 1 to 3650)?"""
    span = F.when(days.between(1, 3650), days).otherwise(30)
    newest = F.greatest(_c(created), _c(modified))
    return F.coalesce(newest > now - F.make_dt_interval(span.cast("int")), F.lit(False))


def population_pct(filled: Col, total: Col) -> Column:
    return F.round(F.when(_c(total) > 0, 100.0 * _c(filled) / _c(total)).otherwise(0.0), 2)


def clamp_confidence(c: Col) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), _c(c).cast("double")))


def confidence_band(c: Col) -> Column:
    return F.when(_c(c).isNull(), "Unknown").when(_c(c) >= 80, "High").when(_c(c) >= 60, "Medium").otherwise("Low")


def unused_flavor(label: Col, reason: Col) -> Column:
    """Why something is unused: layout_only, unreachable, no_evidence or generic; null for other labels."""
    r = F.coalesce(_c(reason), F.lit(""))
    return F.when(_c(label) != V.UNUSED, None).when(r.startswith("LAYOUT_ONLY"), "layout_only").when(r.startswith("UNREACHABLE"), "unreachable").when(r.startswith("NO_EVIDENCE"), "no_evidence").when(_c(label) == V.UNUSED, "generic")


# --- fixed values: reason -> what to ask a reviewer, the first code that occurs in a reason ---------------------
QUESTIONS = {
    "DYNAMIC_APEX": "Does code that makes names at run time reach it?",
    "UNCALLED_ENTRY_POINT": "Does anything outside the system call it?",
    "TEST_ONLY": "Is the code that this test covers still needed, or can both go?",
    "BLOCKED_BY_DEPENDENT": "Can what still refers to it go together with it?",
    "WEAK_SIGNAL": "Will what only mentions it, or is inactive, be used again?",
    "INSUFFICIENT_EVIDENCE": "Which missing checks can be run again?",
    "RECENTLY_CHANGED": "Is someone still building on it?",
    "LLM_FLAGGED": "Is the concern that a model raised about it founded?",
}


def review_question(reasons: Col) -> Column:
    """The first question whose reason code occurs in the array of reasons."""
    asked = F.lit("Who owns it, and is it still needed?")
    for code, question in reversed(QUESTIONS.items()):
        asked = F.when(F.contains(F.concat_ws(" ", _c(reasons)), F.lit(code)), question).otherwise(asked)
    return asked


def weak_note(sources: Col) -> Column:
    """What weak sources mean, in words."""
    n = F.size(F.coalesce(_c(sources), F.array().cast("array<string>")))
    only = F.forall(_c(sources), lambda s: s.isin(*V.PRESENCE_ONLY))
    return F.when(n == 0, "weak references of unknown origin").when(only, F.concat(F.lit("only presence: "), F.concat_ws(", ", F.array_sort(_c(sources))))).otherwise(F.concat(F.lit("weak references from "), F.concat_ws(", ", F.array_sort(_c(sources)))))


# --- fixed values: code -> display label -------------------------------------------------------------------------------
LABELS = {V.STATIC: "Static references", V.POPULATION: "Stored data", V.DEPENDENCY: "Recorded dependencies", V.RUNTIME: "Runtime activity", V.TEMPORAL: "Recent change", V.TAINT: "Dynamic code", V.REACHABILITY: "Reachability", V.CONFIG: "Configuration data", V.REHEARSAL: "Removal rehearsal", V.HIT: "Evidence of use", V.MISS: "Nothing found", V.UNCLEAR: "Unclear", V.NOT_APPLICABLE: "Not applicable"}


def label_for(code: Col) -> Column:
    return mapped(code, LABELS, _c(code))


def source_fingerprint(body: Col) -> Column:
    """struct(sha256, lines) of a body."""
    b = F.coalesce(_c(body), F.lit(""))
    return F.struct(F.sha2(b, 256).alias("sha256"), (F.length(b) - F.length(F.replace(b, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("lines"))


def dynamic_markers(code: Col) -> Column:
    """The markers of dynamic access that occur in the code."""
    low = F.lower(F.coalesce(_c(code), F.lit("")))
    return F.filter(F.array(*map(F.lit, V.DYNAMIC_MARKERS)), lambda m: F.contains(low, m))


def split_markup(text: Col) -> Column:
    """struct(code, comments): markup without its comments and with CDATA unwrapped; the comments, joined."""
    t = F.coalesce(_c(text), F.lit(""))
    comment = r"(?s)<!--.*?-->"
    code = F.regexp_replace(F.regexp_replace(t, comment, " "), r"(?s)<!\[CDATA\[(.*?)\]\]>", " $1 ")
    return F.struct(code.alias("code"), F.concat_ws(" ", F.regexp_extract_all(t, F.lit(comment), 0)).alias("comments"))


def tokens(text: Col) -> Column:
    """Lower-cased identifiers, repeats kept, and the joined forms of report columns."""
    t = F.coalesce(_c(text), F.lit(""))
    joined = F.when(F.contains(t, F.lit("$")), F.regexp_extract_all(t, F.lit(V.REPORT_COLUMN), 0)).otherwise(F.array().cast("array<string>"))
    return F.transform(F.concat(F.regexp_extract_all(t, F.lit(V.TOKEN), 0), joined), F.lower)


def _literal(value: Column, origin: str, precedence: int) -> Column:
    return F.struct(F.lower(value).alias("literal"), F.lit(origin).alias("origin"), F.lit(precedence).alias("precedence"))


def harvest_literals(literals: Col, code: Col) -> Column:
    """array<struct(literal, origin, precedence)>: literals, names inside query-shaped ones, merge fields and their parts."""
    own = F.filter(F.transform(_c(literals), lambda v: F.trim(v)), lambda v: F.length(v) >= 2)
    inside = F.flatten(F.transform(F.filter(own, lambda v: v.rlike(r"(?is)\bselect\b.*\bfrom\b")), lambda v: F.regexp_extract_all(v, F.lit(V.TOKEN), 0)))
    merges = F.transform(F.regexp_extract_all(F.coalesce(_c(code), F.lit("")), F.lit(V.MERGE_FIELD), 1), lambda m: F.trim(m))
    parts = F.filter(F.flatten(F.transform(merges, lambda m: F.split(m, r"[.\s(),]+"))), lambda p: F.length(p) > 1)
    both = F.transform(F.concat(own, inside), lambda v: _literal(v, "string_literal", 2))
    return F.concat(both, F.transform(F.concat(merges, parts), lambda v: _literal(v, "merge_field", 3)))


def _prefixed(prefix: str, origin: str):
    return lambda name: _literal(F.concat(F.lit(prefix), name), origin, 1)


# --- fixed values: forms in which UI bundles are named: origin, pattern with one group, prefixes that also are said -----
UI_FORMS = (
    ("lwc_import", r"(?i)from\s+['\"]c/([A-Za-z]\w*)['\"]", ("", "c/")),
    ("lwc_ns_import", r"(?i)from\s+['\"]c/(\w+/[A-Za-z]\w*)['\"]", ("",)),
    ("lwc_ns_import", r"(?i)from\s+['\"]c/\w+/([A-Za-z]\w*)['\"]", ("", "c/")),
    ("aura_tag", r"<(?:c|\w+):([A-Za-z]\w*)\b", ("", "c:")),
    ("aura_dependency", r"(?i)resource\s*=\s*['\"](?:markup://)?(?:c|\w+):([A-Za-z]\w*)['\"]", ("", "c:")),
    ("flexipage_component", r"(?i)<componentName>\s*((?:\w+[:/])?[A-Za-z]\w*)\s*</componentName>", ("",)),
    ("flexipage_component", r"(?i)<componentName>\s*\w+[:/]([A-Za-z]\w*)\s*</componentName>", ("",)),
    ("lwc_element", r"<(c-[a-z][a-z0-9]*(?:-[a-z0-9]+)*)\b", ("",)),
    ("tab_lwc", r"(?i)<lwcComponent>\s*([A-Za-z]\w*)\s*</lwcComponent>", ("", "c/")),
    ("tab_aura", r"(?i)<auraComponent>\s*((?:\w+[:/])?[A-Za-z]\w*)\s*</auraComponent>", ("",)),
    ("tab_aura", r"(?i)<auraComponent>\s*\w+:([A-Za-z]\w*)\s*</auraComponent>", ("",)),
)


def ui_reference_literals(code: Col) -> Column:
    """array<struct(literal, origin, precedence)> of the forms in which UI bundles are imported, placed or nested."""
    found = []
    for origin, pattern, prefixes in UI_FORMS:
        names = F.regexp_extract_all(F.coalesce(_c(code), F.lit("")), F.lit(pattern), 1)
        found += [F.transform(names, _prefixed(p, origin)) for p in prefixes]
    return F.concat(*found)
