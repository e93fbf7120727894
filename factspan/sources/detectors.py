"""Detectors: plans from files and leaves to entries, and from entries to findings.

An entry is one flat row (``ENTRY``): what was met, where, and by whom.  Detectors only say which scalars are entries;
types, placeholders, JVM options and embedded JSON are worked out for all entries alike.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys as K
from ..functions.placeholders import nested_placeholders
from ..schema import DETAILS, FINDINGS
from ..shared import shuffled, written
from .leaves import leaves, yaml_leaves
from .tree import contents

ENTRY = ("scan_id", "path", "scope", "line", "detector_id", "detector_rank", "role", "key", "raw", "default_raw", "profile", "confidence", "source_kind", "value_kind", "details_type", "extra", "namespace", "group", "data_id", "symbol")

#: Order in which the detectors' findings stand where all else is equal; fixed values.
RANKS = {n: i for i, n in enumerate(("spring-config-file", "spring-configuration-metadata", "logback-spring-xml", "hocon-config-file", "dockerfile-env", "docker-compose-env", "kubernetes-env", "java-source-config", "codegraph-config-usage"))}

_CONFIG_NAME = r"^(application|bootstrap)(-[^.]+)?\.(yml|yaml|properties)$"
# Keys whose values hold JVM options or documents, files of logging and of compose, and details that are no Spring's; fixed values.
_JVM_KEYS = ("JAVA_TOOL_OPTIONS", "JDK_JAVA_OPTIONS")
_JSON_KEYS = ("SPRING_APPLICATION_JSON", "spring.application.json")
_LOGGING = ("logback-spring.xml", "logback.xml", "log4j2-spring.xml", "log4j2.xml")
_COMPOSE = ("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml")
_JAVA_DETAILS = ("web-init-param", "web-xml-param", "servlet-init-parameter", "jndi-lookup", "generic-config-getter", "preferences", "resource-bundle")
_TOKENS = r"""((?:[^\s"']|"[^"]*"|'[^']*')+)"""


def entries(frame: DataFrame, detector: str, role: Column | str = "DEFINE", **given: Column | str | None) -> DataFrame:
    """``frame`` in the layout of ``ENTRY``; columns it lacks are null, but for those given."""
    columns = {"detector_id": F.lit(detector), "detector_rank": F.lit(RANKS[detector]), "role": F.lit(role) if isinstance(role, str) else role, "confidence": F.lit("HIGH"),
               "value_kind": F.lit("LITE"), "details_type": F.lit("external"), "source_kind": F.lit("YAML")}
    columns |= {k: (F.lit(v) if v is None or isinstance(v, str) else v) for k, v in given.items()}
    kinds = {"line": "int", "detector_rank": "int"}
    return frame.select(*[(columns[c] if c in columns else F.col(c) if c in frame.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in ENTRY])


def _union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def dotted(segs: str = "segs") -> Column:
    return F.regexp_replace(F.array_join(segs, "."), r"\.\[", "[")


def lines(files: DataFrame, number: str = "line") -> DataFrame:
    return files.select("scan_id", "path", "name", "scope", F.posexplode(F.split("content", r"\R")).alias(number, "text")).withColumn(number, F.col(number) + 1)


# ---- application files -------------------------------------------------------------------------------------------

def environment_files(files: DataFrame) -> DataFrame:
    """Assignments of ``.env`` files."""
    t = lines(files.where("file_type = 'ENV'")).withColumn("t", F.regexp_replace(F.trim("text"), r"^export\s+", ""))
    t = t.where(~F.col("t").startswith("#") & (F.instr("t", "=") > 1)).select(
        "*", F.trim(F.substring_index("t", "=", 1)).alias("key"), K.unquote(K.strip_inline_comment(F.trim(F.expr("substr(t, instr(t, '=') + 1)")))).alias("raw"), K.profile_of_path("path").alias("profile"))
    return entries(t, "spring-config-file", K.role_of_key("key"), source_kind="PROPERTIES", value_kind="FULL", details_type="unknown")


def application_files(scalars: DataFrame, file_rules: DataFrame | None = None) -> DataFrame:
    """Scalars of application and bootstrap files, and of files that a rule names; each document has one profile."""
    own = scalars.where(F.col("name").rlike(_CONFIG_NAME)).withColumn("rule_scope", F.lit(None).cast("string"))
    if file_rules is not None:
        from ..operators.rules import first_glob

        matched = first_glob(scalars.select("scan_id", "path").distinct(), file_rules.withColumn("scope", F.coalesce("scope", F.lit("RUNTIME")))).select("scan_id", "path", "rule_scope")
        extra = scalars.where(~F.col("name").rlike(_CONFIG_NAME)).join(matched, ["scan_id", "path"])
        own = own.unionByName(extra.select(*own.columns))
    flat = own.withColumn("key", dotted()).where("error is null and value is not null and key <> ''")
    flat = flat.withColumn("profile", F.coalesce("profile", K.profile_of_path("path")))
    kind = F.when(F.col("name").endswith(".properties"), "PROPERTIES").otherwise("YAML")
    return entries(flat.withColumn("raw", F.col("value")).withColumn("scope", F.coalesce("rule_scope", "scope")), "spring-config-file", K.role_of_key("key"), source_kind=kind, value_kind="FULL", details_type="unknown")


def imports(found: DataFrame, files: DataFrame, scalars: DataFrame | None = None) -> DataFrame:
    """Files that entries of ``spring.config.*`` import, read as application files, until no file is new; ``scalars``
    are those of the files where these have been read already.

    A file is read once per scan, which also ends cycles.  Directories import their application files;
    ``configtree:`` directories give one entry for each file in them; files without content are read where they lie.
    """
    def targets(e: DataFrame) -> DataFrame:
        k = F.regexp_replace(F.lower(F.translate("key", "_-", "..")), r"\[\d+]$", "")
        t = e.where(k.isin("spring.config.import", "spring.config.location", "spring.config.additional.location")).select("scan_id", "path", "profile", F.explode(F.split("raw", ",")).alias("t"))
        t = t.withColumn("t", F.regexp_replace(F.trim("t"), "^optional:", ""))
        tree = F.col("t").startswith("configtree:")
        rest = F.regexp_replace("t", "^(configtree:|classpath:/?|file:)", "")
        here = F.when(F.col("t").startswith("classpath:"), F.concat(F.lit("src/main/resources/"), rest)).otherwise(F.regexp_replace(rest, r"^\./", ""))
        beside = F.concat(F.regexp_replace("path", "[^/]*$", ""), F.regexp_replace(rest, r"^\./", ""))
        return t.select("scan_id", tree.alias("tree"), F.explode(F.array_distinct(F.array(here, beside))).alias("target")).distinct()

    scalars = leaves(files) if scalars is None else scalars
    seen, frontier, parts = written(found.select("scan_id", "path").distinct(), "imports-seen"), found, []
    trees = None
    named = files.withColumnRenamed("path", "file")
    parent = F.regexp_replace("file", "[^/]*$", "")
    held = named.withColumn("folder", F.when(parent == "", "/").otherwise(parent))
    folder = F.concat(F.regexp_replace("target", "/+$", ""), F.lit("/"))
    readable = F.col("file_type").isin("YAML", "PROPERTIES")
    text = F.coalesce("content", contents(F.col("location"))) if "location" in files.columns else F.col("content")
    while True:
        t = written(targets(frontier), "imports-targets")
        if t.isEmpty():  # the files need not meet anything
            break
        plain, tree = t.where("not tree"), t.where("tree").withColumn("folder", folder)
        one = plain.withColumnRenamed("target", "file").join(shuffled(named.where(readable)), ["scan_id", "file"]).select("scan_id", F.col("file").alias("path"))
        many = plain.withColumn("folder", folder).join(shuffled(held.where(readable & F.col("name").rlike(_CONFIG_NAME))), ["scan_id", "folder"]).select("scan_id", F.col("file").alias("path"))
        fresh = written(one.unionByName(many).distinct().join(shuffled(seen), ["scan_id", "path"], "left_anti"), "imports-fresh")
        own = tree.select("scan_id", "folder").distinct().join(shuffled(held), ["scan_id", "folder"])
        own = own.select("scan_id", F.col("file").alias("path"), "scope", F.lit(1).alias("line"), F.col("name").alias("key"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("raw"))
        tree = entries(own.where("raw is not null"), "spring-config-file", source_kind="PROPERTIES", value_kind="FULL", details_type="unknown")
        trees = tree if trees is None else trees.unionByName(tree)
        if fresh.isEmpty():
            break
        own = scalars.join(shuffled(fresh), ["scan_id", "path"], "left_semi")
        frontier = written(application_files(own.withColumn("name", F.regexp_replace(F.lower("name"), r"^.*\.", "application."))), "imports-read")
        parts.append(frontier)
        seen = written(seen.unionByName(fresh), "imports-seen")
    return _union(*parts, found.where(F.lit(False)) if trees is None else trees.distinct())


def _metadata(files: DataFrame) -> DataFrame:
    """Metadata files with their document ``v``: null where it does not parse."""
    f = files.where(F.col("name").isin("spring-configuration-metadata.json", "additional-spring-configuration-metadata.json"))
    return f.withColumn("v", F.try_parse_json("content"))


def metadata_files(files: DataFrame) -> DataFrame:
    """Properties declared in metadata files, with defaults typed by their JSON type and by the type declared."""
    f = _metadata(files)
    listed = F.when(F.schema_of_variant("v").startswith("OBJECT<") & F.schema_of_variant(F.variant_get("v", "$.properties", "variant")).startswith("ARRAY<"), F.variant_get("v", "$.properties", "array<variant>"))
    p = f.select("scan_id", "path", "scope", F.explode(listed).alias("p")).where(F.schema_of_variant("p").startswith("OBJECT<"))
    part = lambda n: F.try_variant_get("p", f"$.{n}", "variant")
    text = lambda n: F.when(~F.schema_of_variant(part(n)).rlike("^(OBJECT|ARRAY|VOID)"), F.try_variant_get("p", f"$.{n}", "string"))
    p = p.select("scan_id", "path", "scope", text("name").alias("key"), part("defaultValue").alias("d"), F.coalesce(text("type"), F.lit("")).alias("declared"), F.to_json("p").alias("extra")).where("trim(key) <> ''")
    node = F.schema_of_variant("d")
    default = F.when(node.rlike("^(OBJECT|ARRAY)"), "").when(node != "VOID", F.try_variant_get("d", "$", "string"))  # containers have no text
    kind = (F.when((node == "BOOLEAN") | F.col("declared").isin("java.lang.Boolean", "boolean"), "BOOLEAN").when(F.col("declared") == "java.time.Duration", "DURATION")
            .when((node == "BIGINT") | node.rlike(r"^DECIMAL\(\d+,0\)$") | F.col("declared").isin("java.lang.Integer", "int", "java.lang.Long", "long"), "INTEGER").otherwise("STRING"))
    e = p.withColumns({"default_raw": default, "value_kind": F.concat(F.lit("IS:"), kind)})
    return entries(e, "spring-configuration-metadata", "READ", source_kind="JSON", value_kind=F.col("value_kind"), details_type="unknown")


# ---- other resource files ----------------------------------------------------------------------------------------

#: White space as Java strips it; fixed values.
_STRIPPED = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x1680, *range(0x2000, 0x2007), *range(0x2008, 0x200B), 0x2028, 0x2029, 0x205F, 0x3000)))


def outside_blocks(text: str | None) -> list[dict]:
    """Lines of a HOCON file that lie in no block.  A block is opened by a line that ends in an opening brace, and only by
    such; while it is open every brace of a line counts, quoted or not."""
    out, depth = [], 0
    for number, line in enumerate(re.split(r"\r\n|\r|\n", text or ""), 1):
        line = line.strip(_STRIPPED)
        if depth > 0 or line.endswith("{"):
            depth += line.count("{") - line.count("}")
        elif line and not line.startswith(("#", "//")):
            out.append({"line": number, "t": line})
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("t", T.StringType())])))
def _outside_blocks(text: pd.Series) -> pd.Series:
    return text.map(outside_blocks)


def hocon_files(files: DataFrame) -> DataFrame:
    """Pairs of one line of application.conf and reference.conf outside any block: a key without spaces, ``=`` or ``:``,
    and a value, which may hold braces."""
    t = files.where(F.col("name").isin("application.conf", "reference.conf")).select("scan_id", "path", "scope", F.inline(_outside_blocks("content")))
    at = F.array_min(F.filter(F.array(F.instr("t", "="), F.instr("t", ":")), lambda x: x > 0))
    strip = lambda x: F.regexp_replace(x, f"^[{_STRIPPED}]+|[{_STRIPPED}]+$", "")
    bare = lambda x: F.when((F.length(x) >= 2) & x.startswith('"') & x.endswith('"'), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x)
    t = t.withColumn("at", at).where("at > 1").withColumns({"k": strip(F.expr("substr(t, 1, at - 1)")), "v": strip(F.expr("substr(t, at + 1)"))})
    t = t.where((F.col("k") != "") & ~F.col("k").contains(" ") & (F.col("v") != "")).withColumns({"key": bare(F.col("k")), "raw": bare(F.col("v"))})
    return entries(t.withColumn("extra", F.col("key")), "hocon-config-file", source_kind="UNKNOWN", confidence="MEDIUM", details_type="unknown")


def runtime_xml(scalars: DataFrame) -> DataFrame:
    """Spring properties of logging files and parameters of web.xml."""
    x = scalars.where(F.col("name").isin(*_LOGGING, "web.xml") & F.col("error").isNull()).withColumns({
        "last": F.element_at("segs", -1), "owner": F.array_join(F.slice("segs", 1, F.greatest(F.size("segs") - 1, F.lit(1))), "/"), "tag": F.regexp_replace(F.element_at("segs", F.greatest(F.size("segs") - 1, F.lit(1))), r"\[\d+]$", "")})
    x = x.withColumn("outer", F.regexp_replace("owner", "/[^/]*$", ""))
    per = lambda f, by, **c: f.groupBy("scan_id", "path", "scope", by).agg(*[F.max(F.when(cond, F.nullif(F.trim("value"), F.lit("")))).alias(n) for n, cond in c.items()])
    logging = per(x.where("name <> 'web.xml' and tag = 'springProperty'"), "owner", key=F.col("last") == "@source", default_raw=F.col("last") == "@defaultValue").where("key is not null")
    params = x.where("name = 'web.xml' and last = '#' and tag in ('param-name', 'param-value')").where(F.col("outer").rlike(r"(^|/)(context-param|init-param)\[\d+]$"))
    web = per(params, "outer", key=F.col("tag") == "param-name", raw=F.col("tag") == "param-value").where("key is not null")
    return _union(entries(logging.withColumn("extra", F.lit("logback-spring-property")), "logback-spring-xml", "READ", source_kind="XML"),
                  entries(web.withColumn("extra", F.lit("web-xml-param")), "logback-spring-xml", source_kind="XML"))


def xml_placeholders(files: DataFrame) -> DataFrame:
    """Placeholders of the raw text of logging files, of web.xml and of any XML under main resources: of attributes, texts,
    comments and tails alike, and of files that do not parse.  Those in the default of another are read too."""
    x = files.where((F.col("file_type") == "XML") & F.col("content").contains("${") & (F.col("name").isin(*_LOGGING, "web.xml") | F.col("path").rlike("(^|/)main/resources/")))
    held = x.select("scan_id", "path", "scope", F.inline(nested_placeholders("content", keys=False)))
    held = held.select("scan_id", "path", "scope", "key", F.col("default_value").alias("default_raw"), F.expr("substr(raw, 3, length(raw) - 3)").alias("extra"))
    return entries(held, "logback-spring-xml", "READ", source_kind="XML", details_type="spring-placeholder")


# ---- deployment files --------------------------------------------------------------------------------------------

def tokens(text: Column) -> Column:
    """Words of a command line; quotes hold spaces together and go."""
    return F.transform(F.regexp_extract_all(text, F.lit(_TOKENS), 1), lambda x: F.regexp_replace(x, "[\"']", ""))


def _arguments(frame: DataFrame, words: Column) -> DataFrame:
    """Rows of ``--key=value`` and ``-Dkey=value`` among words."""
    t = frame.withColumn("t", F.explode(words))
    return t.select(*frame.columns, K.argument_key("t").alias("key"), K.argument_value("t").alias("raw")).where("key is not null")


def dockerfiles(files: DataFrame) -> DataFrame:
    joined = files.where("file_type = 'DOCKERFILE' and name like 'Dockerfile%'").withColumn("content", F.regexp_replace("content", r"\\[ \t]*\R", "\u0001"))
    # Every line with its number; a line that was joined to others above takes the numbers of all.
    joins = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\u0001"), F.lit("")))
    empty = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<line:int,text:string>>").alias("out"))
    numbered = F.aggregate(F.split("content", r"\R"), empty, lambda a, s: F.struct(
        (a["next"] + 1 + joins(s)).alias("next"), F.when(s.rlike("^[ \u0001]*(ENV|CMD|ENTRYPOINT)[ \u0001]"), F.concat(a["out"], F.array(F.struct(a["next"].alias("line"), s.alias("text"))))).otherwise(a["out"]).alias("out")), lambda a: a["out"])
    t = joined.select("scan_id", "path", "scope", F.inline(numbered)).withColumn("t", F.trim(F.translate("text", "\u0001", " "))).select("scan_id", "path", "scope", "line", "t")
    env = t.where("t like 'ENV %'").withColumn("words", tokens(F.expr("substr(t, 5)")))
    first = F.get("words", F.lit(0))
    pairs = env.where(first.contains("=")).select("scan_id", "path", "scope", "line", F.explode("words").alias("t")).where("instr(t, '=') > 1").select(
        "scan_id", "path", "scope", "line", F.substring_index("t", "=", 1).alias("key"), F.expr("substr(t, instr(t, '=') + 1)").alias("raw"))
    spaced = env.where(~first.contains("=") & (F.size("words") > 1)).select("scan_id", "path", "scope", "line", first.alias("key"), F.get("words", F.lit(1)).alias("raw"))
    command = t.where("t like 'CMD %' or t like 'ENTRYPOINT %'")
    started = _arguments(command.select("scan_id", "path", "scope", "line", "t"), tokens(F.translate(F.expr("substr(t, instr(t, ' ') + 1)"), "[],", "   "))).select("scan_id", "path", "scope", "line", "key", "raw")
    found = with_jvm_options(_union(pairs, spaced), "env").unionByName(started.withColumn("extra", F.lit("command")))
    return entries(found, "dockerfile-env", confidence="MEDIUM", source_kind="UNKNOWN")


def with_jvm_options(pairs: DataFrame, kind: str) -> DataFrame:
    """``pairs(..., key, raw)`` of the details ``kind``, and the properties that JVM options among them set."""
    jvm = pairs.where(F.col("key").isin(*_JVM_KEYS, "JAVA_OPTS") | F.col("key").endswith("_JAVA_OPTS"))
    own = [c for c in pairs.columns if c not in ("key", "raw")]
    set_ = _arguments(jvm.select(*own, F.col("raw").alias("opts")), tokens(F.col("opts"))).select(*pairs.columns)
    return pairs.withColumn("extra", F.lit(kind)).unionByName(set_.withColumn("extra", F.lit(f"{kind}-jvm-arg")))


def compose_files(scalars: DataFrame) -> DataFrame:
    x = scalars.where(F.col("name").isin(*_COMPOSE) & (F.get("segs", F.lit(0)) == "services"))
    part, item = F.get("segs", F.lit(2)), F.get("segs", F.lit(3))
    env = x.where((part == "environment") & (F.size("segs") == 4))
    mapped = env.where(~item.startswith("[")).select("scan_id", "path", "scope", item.alias("key"), F.col("value").alias("raw"))
    listed = env.where(item.startswith("[") & (F.instr("value", "=") > 1)).select("scan_id", "path", "scope", F.substring_index("value", "=", 1).alias("key"), F.expr("substr(value, instr(value, '=') + 1)").alias("raw"))
    command = x.where(part.isin("command", "entrypoint"))
    words = F.when(F.size("segs") == 3, tokens(F.col("value"))).otherwise(F.array("value"))
    started = _arguments(command.select("scan_id", "path", "scope", "segs", "value", part.alias("extra")), words).select("scan_id", "path", "scope", "key", "raw", "extra")
    return entries(with_jvm_options(_union(mapped, listed).where("raw is not null"), "environment").unionByName(started), "docker-compose-env", confidence="MEDIUM")


def kubernetes_files(scalars: DataFrame) -> DataFrame:
    """Facts of Kubernetes documents, as filters and joins of their scalars."""
    from ..operators.rules import env_from

    x = scalars.where(F.col("name").rlike(r"\.ya?ml$") & F.col("error").isNull())
    doc = ["scan_id", "path", "doc"]
    at = lambda *s: F.array_join("segs", "\u0001") == "\u0001".join(s)
    heads = x.where(at("kind") | at("apiVersion") | at("metadata", "name")).groupBy(*doc).agg(F.max(F.when(at("kind"), F.col("value"))).alias("kind"), F.max(F.when(at("apiVersion"), F.col("value"))).alias("api"), F.max(F.when(at("metadata", "name"), F.col("value"))).alias("owner"))
    x = x.withColumns({
        "top": F.get("segs", F.lit(0)), "last": F.element_at("segs", -1), "where": F.array_join(F.slice("segs", 1, F.greatest(F.size("segs") - 1, F.lit(1))), "\u0001")})
    base = ["scan_id", "path", "scope"]
    two = F.size("segs") == 2
    # What any plan below reads meets the heads once, and is written: each of them would shuffle its own part again.
    x = x.where(F.col("top").isin("data", "stringData") & two | F.col("where").rlike("(^|\u0001)(containers|initContainers|volumes)\u0001"))
    x = written(x.join(shuffled(heads.where("kind is not null and api is not null")), doc).select(*base, "doc", "seq", "segs", "value", "kind", "owner", "top", "last", "where"), "kubernetes-scalars")
    data = x.where((F.col("kind") == "ConfigMap") & (F.col("top") == "data") & two & F.col("value").isNotNull())
    maps = data.select(*base, F.col("last").alias("key"), F.col("value").alias("raw"), F.lit("config-map-data").alias("extra"))
    plain = x.where((F.col("kind") == "Secret") & (F.col("top") == "stringData") & two & F.col("value").isNotNull()).select(*base, F.col("last").alias("key"), F.col("value").alias("raw"), F.lit("secret-string-data").alias("extra"))
    hidden = x.where((F.col("kind") == "Secret") & (F.col("top") == "data") & two & (F.trim("owner") != "")).select(*base, F.concat(F.lit("kubernetes.secret.data."), "owner", F.lit("."), "last").alias("key"), F.col("last").alias("raw"), F.lit("secret-data-key").alias("extra"))

    inside = F.col("where").rlike("(^|\u0001)(containers|initContainers)\u0001\\[\\d+]\u0001")
    boxed = x.where(inside)
    item = F.regexp_extract("where", "^(.*\u0001(?:env|envFrom)\u0001\\[\\d+])(?:\u0001|$)", 1)
    rel = F.array_join(F.expr("slice(segs, size(split(item, '\u0001')) + 1, size(segs))"), ".")
    env = boxed.withColumn("item", item).where("item <> ''").withColumn("rel", rel)
    pick = lambda n: F.max(F.when(F.col("rel") == n, F.col("value")))
    rows = written(env.groupBy(*base, "doc", "item").agg(
        pick("name").alias("key"), pick("value").alias("value"), pick("valueFrom.configMapKeyRef.name").alias("cm"), pick("valueFrom.configMapKeyRef.key").alias("cmk"), pick("valueFrom.secretKeyRef.name").alias("sc"),
        pick("valueFrom.secretKeyRef.key").alias("sck"), pick("configMapRef.name").alias("cmr"), pick("secretRef.name").alias("scr"), pick("prefix").alias("prefix")), "kubernetes-items")
    named = rows.where("trim(key) <> ''")
    direct = named.where("value is not null").select(*base, "key", F.col("value").alias("raw"), F.lit("env").alias("extra"))
    reference = named.where("value is null and (cm is not null or sc is not null)").select(
        *base, "key", F.concat_ws(":", F.coalesce("cm", "sc"), F.coalesce("cmk", "sck")).alias("raw"), F.when(F.col("cm").isNotNull(), "config-map-key-ref").otherwise("secret-key-ref").alias("extra"))
    whole = _union(*[rows.where(f"trim({c}) <> ''").select(*base, F.concat(F.lit(f"kubernetes.env-from.{n}."), c).alias("key"), F.col(c).alias("raw"), F.lit(f"env-from-{n}-ref").alias("extra")) for c, n in (("cmr", "config-map"), ("scr", "secret"))])
    order = F.struct("path", "doc", "seq")
    joined = env_from(rows.where("trim(cmr) <> ''").select(F.concat_ws("\u0001", "scan_id", "cmr").alias("name"), "prefix", F.struct(*base).alias("path")),
                      data.where("trim(owner) <> ''").select(F.concat_ws("\u0001", "scan_id", "owner").alias("name"), F.col("last").alias("key"), "value", order.alias("ordinal")))
    copied = joined.select("path.*", "key", F.col("value").alias("raw"), F.lit("env-from-config-map-data").alias("extra"))

    started = boxed.where(F.col("where").rlike("\u0001(command|args)$")).select(*base, F.col("value").alias("t"), F.when(F.col("where").endswith("args"), "container-arg").otherwise("container-command").alias("extra"))
    started = _arguments(started, F.array("t")).select(*base, "key", "raw", "extra")
    volume = x.where(F.col("where").rlike("(^|\u0001)volumes\u0001\\[\\d+]\u0001(configMap|secret)(\u0001items\u0001\\[\\d+])?$"))
    volume = volume.withColumns({"item": F.regexp_extract("where", "^(.*volumes\u0001\\[\\d+])", 1), "form": F.when(F.col("where").contains("\u0001configMap"), "config-map").otherwise("secret"), "deep": F.col("where").contains("\u0001items\u0001")})
    vols = volume.where("not deep").groupBy(*base, "doc", "item", "form").agg(F.coalesce(F.max(F.when(F.col("last") == "name", F.col("value"))), F.max(F.when(F.col("last") == "secretName", F.col("value")))).alias("name")).where("trim(name) <> ''")
    vol = vols.select(*base, F.concat(F.lit("kubernetes.volume."), "form", F.lit("."), "name").alias("key"), F.col("name").alias("raw"), F.concat("form", F.lit("-volume")).alias("extra"))
    keys = volume.where("deep and last = 'key' and trim(value) <> ''").select(*base, "doc", "item", "form", "value").join(shuffled(vols), [*base, "doc", "item", "form"]).select(
        *base, F.concat(F.lit("kubernetes.volume."), "form", F.lit("."), "name", F.lit("."), "value").alias("key"), F.col("value").alias("raw"), F.concat("form", F.lit("-volume-item")).alias("extra"))
    high = entries(_union(maps, plain, direct), "kubernetes-env")
    medium = entries(_union(reference, copied, started), "kubernetes-env", confidence="MEDIUM")
    meta = entries(_union(hidden, whole, vol, keys), "kubernetes-env", "METADATA", confidence="MEDIUM", value_kind="STRING")
    return _union(high, medium, meta)


# ---- from entries to findings ------------------------------------------------------------------------------------

def _json_pairs(values):
    """Flattened pairs of embedded documents; what does not parse has none."""
    from .leaves import dotted as path

    def of(text):
        try:
            return [{"key": path(s), "raw": v} for _, s, v in yaml_leaves(text or "") if v is not None and s]
        except Exception:
            return []

    return values.map(of)


def expanded(found: DataFrame) -> DataFrame:
    """Entries that the values of other entries hold: JVM options, embedded JSON, and placeholders.  The entries are written
    first, since three plans read them."""
    found = written(found, "entries")

    pairs = F.pandas_udf(_json_pairs, T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("raw", T.StringType())])))
    spring = found.where("detector_id = 'spring-config-file'")
    keep = [c for c in ENTRY if c not in ("key", "raw")]
    jvm = spring.where(F.col("key").isin(*_JVM_KEYS)).withColumn("t", F.explode(F.split(F.trim("raw"), r"\s+"))).where("t like '-D%'")
    jvm = jvm.select(*keep, K.argument_key("t").alias("key"), K.argument_value("t").alias("raw")).where("key is not null")
    json = found.where(F.col("key").isin(*_JSON_KEYS) & F.col("raw").isNotNull()).select(*keep, F.inline(pairs("raw"))).withColumn("role", K.role_of_key("key"))
    more = _union(jvm.select(*ENTRY), json.select(*ENTRY))
    everything = found.unionByName(more)
    held = everything.where(F.col("detector_id").isin("spring-config-file") & F.col("raw").contains("${")).select(
        *[c for c in ENTRY if c not in ("key", "raw", "default_raw", "role", "details_type", "extra")], F.inline(nested_placeholders("raw")))
    reads = held.select("*", F.col("default_value").alias("default_raw"), F.lit("READ").alias("role"), F.lit("spring-placeholder").alias("details_type"), F.col("raw").alias("extra")).withColumn("raw", F.lit(None).cast("string"))
    return everything.unionByName(reads.select(*ENTRY))


def findings(found: DataFrame) -> DataFrame:
    """Entries as findings, with types; without ordinal."""
    kind = F.col("value_kind")

    def typed(c: str) -> Column:
        t = (F.when(kind == "FULL", K.infer_type(c)).when(kind == "JAVA", K.infer_type(c, placeholders=False)).when(kind == "STRING", F.lit("STRING"))
             .when(kind.startswith("IS:"), F.expr("substr(value_kind, 4)")).otherwise(K.infer_type_lite(c)))
        return F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("raw"), F.col(c).alias("normalized"), t.alias("type")))

    none = F.lit(None).cast("string")
    of = F.col("detector_id")
    space = F.coalesce("namespace", F.when(F.col("details_type") == "external", F.when(of == "dockerfile-env", "docker").when(of == "docker-compose-env", "docker-compose").when(of == "kubernetes-env", "kubernetes")
                                           .when(F.col("extra").isin(*_JAVA_DETAILS), "java").otherwise("spring")))
    details = F.struct(*[x.cast("string").alias(n) for n, x in {
        "type": F.col("details_type"), "default_value": F.col("default_raw"), "raw_expression": F.when(F.col("details_type") == "spring-placeholder", F.col("extra")), "prefix": F.when(F.col("details_type") == "spring-configuration-properties", F.col("key")),
        "bound_type": F.when(F.col("details_type") == "spring-configuration-properties", F.col("extra")), "inferred_from_fields": none, "from_constant": none, "namespace": space, "group": F.col("group"), "data_id": F.col("data_id"),
        "external_type": F.when(F.col("details_type") == "external", F.col("extra")), "payload": none, "reason": F.when(F.col("details_type") == "unknown", F.col("detector_id")),
        "raw_text": F.when(F.col("details_type") == "unknown", F.coalesce("extra", F.concat("key", F.lit("="), "raw"))), "known_prefix": none, "known_suffix": none}.items()]).cast(DETAILS)
    out = found.select(
        "scan_id", F.lit(None).cast("bigint").alias("ordinal"), F.lit("CONFIG").alias("kind"), "key", none.alias("normalized_key"), "role", typed("raw").alias("value"), typed("default_raw").alias("default_value"),
        none.alias("expression"), none.alias("reason"), none.alias("root_sink"), F.struct("profile", none.alias("region"), none.alias("namespace")).alias("environment"),
        F.struct("path", "line", "symbol", "source_kind", "scope").alias("source"), "confidence", "detector_id", details.alias("details"), F.struct("detector_rank", "role", "raw", "default_raw").alias("emit_seq"))
    assert [c for c in out.columns if c != "emit_seq"] == [x.split(" ")[0] for x in FINDINGS.split(", ")]
    return out


def resource_entries(files: DataFrame, file_rules: DataFrame | None = None, scalars: DataFrame | None = None) -> DataFrame:
    """Entries of all detectors but that of Java sources; ``scalars`` are those of the files where these have been read."""
    scalars = leaves(files) if scalars is None else scalars
    spring = written(_union(environment_files(files), application_files(scalars, file_rules)), "spring-entries")
    spring = spring.unionByName(imports(spring, files, scalars))
    return expanded(_union(spring, metadata_files(files), runtime_xml(scalars), xml_placeholders(files), hocon_files(files), dockerfiles(files), compose_files(scalars), kubernetes_files(scalars)))


def parse_diagnostics(scalars: DataFrame, invocations: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """One row per file that did not parse, of those that gave ``scalars`` or Java ``invocations``, and of ``files`` one
    per metadata document that does not parse and per file that could not be read or decoded."""
    parts = [f.where("error is not null").select("scan_id", "path", "error", F.lit(n).alias("n")) for f, n in ((scalars, "leaves"), (invocations, "java-source-config")) if f is not None]
    if files is not None:
        parts.append(_metadata(files).where("v is null and content is not null").select("scan_id", "path", F.lit("no JSON").alias("error"), F.lit("spring-configuration-metadata").alias("n")))
        if "error" in files.columns:
            parts.append(files.where("error is not null").select("scan_id", "path", "error", F.lit("files").alias("n")))
    return _union(*parts).select("scan_id", F.lit("ERROR").alias("severity"), F.lit("detect").alias("phase"), F.concat_ws(": ", "path", "error").alias("message"), F.col("n").alias("component_id"))
