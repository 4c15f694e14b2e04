"""Column expressions: scores, names and identities.  All run in the JVM.

A component that could not be measured is null and is left out of a score, never counted as zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def saturating(value: Column, target: float) -> Column:
    """1 - exp(-max(value, 0) / target); 0 for a target that isn't positive."""
    return F.lit(0.0) if target <= 0 else 1 - F.exp(-F.greatest(value.cast("double"), F.lit(0.0)) / target)


def rarity(hosts: Column) -> Column:
    """1 for one host, falling with the square root of their number."""
    return 1 / F.sqrt(F.greatest(hosts, F.lit(1)).cast("double"))


def weighted_mean(parts: dict[str, tuple[Column, float]]) -> Column:
    """Weighted geometric mean over the components that aren't null, each at least 0.01; 0 if there is none."""
    # greatest() skips nulls, so a null component is set apart first
    logs = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), w * F.log(F.greatest(c, F.lit(0.01)))).otherwise(F.lit(0.0)) for c, w in parts.values()])
    weights = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in parts.values()])
    return F.when(weights > 0, clip01(F.exp(logs / weights))).otherwise(F.lit(0.0))


def surprisal(p: Column, cap_bits: float = 6.0) -> Column:
    """A probability's surprisal in bits over the cap, at most 1; 1 for a probability of 0."""
    return F.when(p <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), -F.log2(F.least(p, F.lit(1.0))) / cap_bits))


def entropy_bits(text: Column) -> Column:
    """Shannon entropy in bits of a text's UTF-8 bytes; 0 for an empty one."""
    data = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))

    def over(values: Column) -> Column:
        n = F.size(values).cast("double")
        terms = F.transform(F.array_distinct(values), lambda x: F.size(F.filter(values, lambda y: y == x)) / n)
        return F.aggregate(terms, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))

    return F.get(F.transform(F.array(data), over), F.lit(0))


# Second-level suffixes under which names are registered.
MULTIPART_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk",
    "com.au", "net.au", "org.au", "edu.au", "gov.au",
    "co.nz", "co.za", "co.jp", "ne.jp", "or.jp",
    "com.br", "com.cn", "com.mx", "com.tr", "co.in",
)


def labels_of(name: Column) -> Column:
    """A name's labels in lower case, without empty ones."""
    return F.filter(F.split(F.lower(F.btrim(name, F.lit("."))), "[.]"), lambda x: x != "")


def registered_domain(name: Column) -> Column:
    """The zone that a name was registered under: its last two labels, or three under a multi-part suffix."""

    def zone(labels: Column) -> Column:
        n = F.size(labels)
        tail = lambda k: F.array_join(F.slice(labels, F.greatest(n - (k - 1), F.lit(1)), F.lit(k)), ".")
        return F.when((n > 2) & tail(2).isin(*MULTIPART_SUFFIXES), tail(3)).otherwise(tail(2))

    return F.get(F.transform(F.array(labels_of(name)), zone), F.lit(0))


def subdomain(name: Column, zone: Column) -> Column:
    """What stands left of the zone, without dots."""
    plain = F.lower(F.btrim(name, F.lit(".")))
    left = F.when((F.length(zone) > 0) & F.endswith(plain, zone), F.substring(plain, F.lit(1), F.length(plain) - F.length(zone))).otherwise(plain)
    return F.replace(left, F.lit("."), F.lit(""))


def label_and_suffix(registered: Column) -> tuple[Column, Column]:
    """A registered domain's own label and the suffix it stands under; nulls without both."""
    parts = F.split(registered, "[.]", 2)
    whole = F.size(parts) == 2
    return F.when(whole, F.get(parts, F.lit(0))), F.when(whole, F.get(parts, F.lit(1)))


def consonant_run(label: Column) -> Column:
    runs = F.transform(F.regexp_extract_all(label, F.lit("([b-df-hj-np-tv-z]+)"), F.lit(1)), F.length)
    return F.coalesce(F.array_max(runs), F.lit(0))


def digit_ratio(label: Column) -> Column:
    return F.when(F.length(label) > 0, F.length(F.regexp_replace(label, "[^0-9]", "")) / F.length(label)).otherwise(F.lit(0.0))


def image_name(path: Column) -> Column:
    """Lower-case base name of an executable path with either separator; null if there is none."""
    plain = F.rtrim(F.replace(path, F.lit("/"), F.lit("\\")), F.lit("\\"))
    return F.nullif(F.lower(F.trim(F.regexp_extract(plain, r"([^\\]+)$", 1))), F.lit(""))


# Directories any user can write to, and those of the system's own binaries.
WRITABLE = ("\\users\\", "\\appdata\\", "\\programdata\\", "\\temp\\", "\\tmp\\", "\\$recycle.bin\\", "\\public\\", "\\perflogs\\", "\\downloads\\")
SYSTEM = ("\\windows\\system32\\", "\\windows\\syswow64\\")


def path_anomaly(path: Column) -> Column:
    """How unusual a binary's directory is, in four bands; null without a path."""
    plain = F.lower(F.replace(path, F.lit("/"), F.lit("\\")))
    has = lambda parts: reduce(lambda a, b: a | b, [F.contains(plain, F.lit(x)) for x in parts])
    return F.when(path.isNull() | (path == ""), F.lit(None).cast("double")).when(has(WRITABLE), 1.0).when(has(SYSTEM), 0.15).when(has(("\\windows\\",)), 0.30).otherwise(0.55)


# Weights of alert categories by the first fragment found, negations before what they deny.
CATEGORY_WEIGHTS = (
    ("not suspicious", 0.10), ("not-suspicious", 0.10), ("unknown traffic", 0.25),
    ("network trojan", 1.00), ("trojan-activity", 1.00), ("command and control", 1.00), ("malware", 1.00), ("crypto", 0.85),
    ("shellcode", 0.95), ("executable code was detected", 0.95), ("exploit", 0.95), ("administrator privilege gain", 0.90),
    ("attempted-admin", 0.90), ("successful-admin", 0.95), ("user privilege gain", 0.80), ("attempted-user", 0.80),
    ("web application attack", 0.85), ("web-application-attack", 0.85), ("sql injection", 0.85),
    ("credential", 0.90), ("sensitive data", 0.75),
    ("denial of service", 0.60), ("attempted-dos", 0.60), ("potentially bad traffic", 0.55), ("bad-unknown", 0.55),
    ("suspicious", 0.55), ("network scan", 0.50), ("network-scan", 0.50), ("scan", 0.50),
    ("privacy violation", 0.35), ("policy", 0.30), ("misc attack", 0.50), ("misc activity", 0.25), ("misc-activity", 0.25), ("protocol", 0.25),
)
# The weight of any other category, and of stated severities.
UNMATCHED_CATEGORY = 0.40
SEVERITY_SCORES = {1: 1.0, 2: 0.6, 3: 0.3}
DEFAULT_SEVERITY_SCORE = 0.4


def category_weight(category: Column) -> Column:
    plain = F.lower(category)
    return F.coalesce(*[F.when(F.contains(plain, F.lit(k)), F.lit(v)) for k, v in CATEGORY_WEIGHTS], F.lit(UNMATCHED_CATEGORY))


def severity_score(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == k, F.lit(v)) for k, v in SEVERITY_SCORES.items()], F.lit(DEFAULT_SEVERITY_SCORE))


def count_values(x: Column) -> Column:
    """Distinct values in a group, null being one of them."""
    return F.count_distinct(x) + F.max(F.when(x.isNull(), 1).otherwise(0))


def content_id(prefix: str, fields: dict[str, Column]) -> Column:
    """A stable id of what a row says: a digest of canonical JSON with sorted keys and explicit nulls."""
    ordered = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256), 1, 16))


def entity_id(kind: Column, value: Column) -> Column:
    return content_id("ent", {"type": kind, "value": F.lower(F.trim(value))})


def epoch(column: str) -> Column:
    """Seconds since 1970 of a timestamp without a zone, as a double."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ)) / 1e6D")


def day_of(ts: Column) -> Column:
    """The UTC day of seconds since 1970, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(ts / 86400).cast("int"))
