"""Scalar functions on keys, values, paths and arguments, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A key that contains one of these looks sensitive; fixed values.
SENSITIVE_TOKENS = ("password", "passwd", "pwd", "secret", "token", "credential", "private-key")
#: Keys and import schemes that refer to a remote configuration service; fixed values.
REMOTE_KEY_PREFIXES = (
    "spring.cloud.config.", "spring.cloud.nacos.config.", "spring.cloud.consul.config.",
    "spring.cloud.zookeeper.config.", "spring.cloud.etcd.config.", "apollo.",
)
REMOTE_IMPORT_SCHEMES = ("configserver:", "nacos:", "consul:", "zookeeper:", "etcd:", "apollo:")
#: The shorter list that a diff goes by.
REMOTE_DIFF_PREFIXES = ("spring.cloud.config.", "spring.cloud.nacos.config.")
MASK = "******"

_ISO_DURATION = r"(?i)[-+]?P(?:[-+]?\d+D)?(?:T(?=.*\d)(?:[-+]?\d+H)?(?:[-+]?\d+M)?(?:[-+]?\d+(?:[.,]\d{0,9})?S)?)?"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_key(key: Column | str) -> Column:
    """Kebab case: a dash before an upper-case letter that begins a word, underscores as dashes, lower case."""
    k = F.regexp_replace(_col(key), r"(?<=[^._\-\p{Lu}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", "-")
    return F.lower(F.regexp_replace(F.translate(k, "_", "-"), "-+", "-"))


def _is(x: Column, pattern: str) -> Column:
    return x.rlike(f"^(?:{pattern})$")


def infer_type(value: Column | str, placeholders: bool = True) -> Column:
    """The type tag of a trimmed text; a null is UNKNOWN.  Placeholders count only in resource files."""
    v = F.trim(_col(value))
    duration = _is(v, r"\d+(?:ns|us|ms|s|m|h|d)") | ((F.length(v) > 1) & _is(v, _ISO_DURATION) & v.rlike(r"\d"))
    out = F.when(_col(value).isNull(), "UNKNOWN").when(F.lower(v).isin("true", "false"), "BOOLEAN").when(_is(v, r"-?\d+"), "INTEGER").when(duration, "DURATION")
    if placeholders:
        out = out.when(v.startswith("${") & v.endswith("}"), "PLACEHOLDER")
    return out.otherwise("STRING")


def infer_type_lite(value: Column | str) -> Column:
    """The type tag of untrimmed text of deployment files: boolean, integer or string."""
    v = _col(value)
    return F.when(v.isNull(), "UNKNOWN").when(F.lower(v).isin("true", "false"), "BOOLEAN").when(_is(v, r"-?\d+"), "INTEGER").otherwise("STRING")


def infer_type_declared(value: Column | str, declared: Column | str) -> Column:
    """The type tag of a metadata default: by the declared Java type, else by the value itself."""
    d = F.substring_index(_col(declared), ".", -1)
    return (F.when(d == "Boolean", "BOOLEAN").when(d == "Duration", "DURATION").when(d.isin("Integer", "Long"), "INTEGER")
            .otherwise(infer_type_lite(value)))


def is_sensitive(key: Column | str) -> Column:
    k = F.lower(_col(key))
    return F.coalesce(k.rlike("|".join(SENSITIVE_TOKENS)) & (F.trim(k) != ""), F.lit(False))


def _starts(key: Column, prefixes: tuple[str, ...]) -> Column:
    out = key.startswith(prefixes[0])
    for p in prefixes[1:]:
        out = out | key.startswith(p)
    return out


def is_remote(normalized_key: Column | str, value: Column | str, details_type: Column | str) -> Column:
    """Whether a fact of an inventory refers to a remote configuration service."""
    k, v = F.lower(_col(normalized_key)), F.lower(_col(value))
    scheme = v.rlike("|".join(REMOTE_IMPORT_SCHEMES))
    return F.coalesce(_col(details_type) == "config-center", F.lit(False)) | _starts(k, REMOTE_KEY_PREFIXES) | ((k == "spring.config.import") & F.coalesce(scheme, F.lit(False)))


def is_remote_in_diff(normalized_key: Column | str, details_type: Column | str) -> Column:
    """The rule of a diff: fewer prefixes, and every import whatever its value."""
    k = F.lower(_col(normalized_key))
    return F.coalesce(_col(details_type) == "config-center", F.lit(False)) | _starts(k, REMOTE_DIFF_PREFIXES) | (k == "spring.config.import")


def group_of(key: Column | str) -> Column:
    k = _col(key)
    return F.when(F.instr(k, ".") > 1, F.substring_index(k, ".", 1)).otherwise("default")


def to_underscore(key: Column | str) -> Column:
    k = _col(key)
    return F.when(F.trim(F.coalesce(k, F.lit(""))) == "", "config").otherwise(F.lower(F.translate(k, "-.", "__")))


def type_hint(key: Column | str) -> Column:
    k = F.lower(_col(key))
    return F.when(k.contains("redis"), "redis").when(k.startswith("db.") | k.contains("datasource") | k.contains("jdbc"), "mysql").otherwise("")


def value_or(value: Column | str, default: Column | str) -> Column:
    return F.coalesce(_col(value), _col(default), F.lit(""))


def display_value(value: Column | str, default: Column | str) -> Column:
    v, d = _col(value), _col(default)
    return F.when(F.length(v) > 0, v).when(F.length(d) > 0, F.concat(d, F.lit(" (default)"))).otherwise("-")


def normalize_path(path: Column | str) -> Column:
    return F.lower(F.translate(F.coalesce(_col(path), F.lit("")), "\\", "/"))


def file_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def directory_of(path: Column | str) -> Column:
    p = _col(path)
    return F.when(F.instr(p, "/") > 0, F.regexp_extract(p, r"^(?s)(.*)/[^/]*$", 1)).otherwise("(root)")


def html_escape(text: Column | str) -> Column:
    t = _col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def unquote(text: Column | str) -> Column:
    """A text without the pair of equal quotes around it."""
    t = _col(text)
    return F.when((F.length(t) >= 2) & (F.left(t, F.lit(1)) == F.right(t, F.lit(1))) & F.left(t, F.lit(1)).isin('"', "'"), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)


def strip_inline_comment(text: Column | str) -> Column:
    """A value without a trailing `` #`` comment, unless it is quoted."""
    t = _col(text)
    return F.when(t.startswith('"') | t.startswith("'"), t).otherwise(F.rtrim(F.regexp_replace(t, r"(?s)\s#.*$", "")))


def argument_key(token: Column | str) -> Column:
    """The key of ``--key=value`` or ``-Dkey=value``; null for other tokens."""
    return F.nullif(F.regexp_extract(_col(token), r"^(?:--|-D)([^=]+)=(?s)(.*)$", 1), F.lit(""))


def argument_value(token: Column | str) -> Column:
    return F.when(argument_key(token).isNotNull(), F.regexp_extract(_col(token), r"^(?:--|-D)([^=]+)=(?s)(.*)$", 2))


def simple_name(type_name: Column | str) -> Column:
    return F.substring_index(_col(type_name), ".", -1)


def profile_of_path(path: Column | str) -> Column:
    """The profile that a file name carries: what follows ``.env.``, ``application-`` or ``bootstrap-``."""
    n = file_name(path)
    named = F.regexp_extract(n, r"^(?:application|bootstrap)-([^.]+)\.", 1)
    return F.when(n.startswith(".env."), F.nullif(F.substring(n, F.lit(6), F.length(n)), F.lit(""))).otherwise(F.nullif(named, F.lit("")))


def role_of_key(key: Column | str) -> Column:
    k = F.lower(F.translate(_col(key), "_", "."))
    return F.when(k.startswith("spring.profiles") | k.startswith("spring.config."), "METADATA").otherwise("DEFINE")


def priority(path: Column | str, profile: Column | str, source_kind: Column | str) -> Column:
    """How strongly a source binds: environment files, then profile files, base files, bootstrap files, code, the rest."""
    n = F.lower(file_name(F.coalesce(_col(path), F.lit(""))))
    named = F.coalesce(F.trim(_col(profile)) != "", F.lit(False))
    return (F.when(n.startswith(".env"), 90)
            .when(named & (n.startswith("application-") | n.startswith("bootstrap-")), 80)
            .when(n.rlike(r"^application\.(yml|yaml|properties)"), 70)
            .when(n.startswith("bootstrap."), 50)
            .when(F.coalesce(_col(source_kind) == "JAVA", F.lit(False)), 30)
            .otherwise(10))
