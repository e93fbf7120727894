"""Queries of the readers: files made of the driver's rows, one or more per event, and the rows that must come of them.

A file's text is written with the fields of its event between ``«»``: ``t`` its type, ``k`` a number of its own, ``u``
its user.  The same notation gives the expected values, so that SQL makes them of the tables without any reader.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import diff as D
from ..operators import export
from ..operators.findings import placed
from ..shared import written
from ..sources import detectors as R
from ..sources import java as J
from ..sources.leaves import leaves
from . import queries as Q

_EVENTS = "select event_id, event_type as t, json_extract_string(props, '$.k') as k, cast(user_id as varchar) as u from events"


def _expression(text: str) -> str:
    """A text with fields as an expression that Spark and DuckDB read alike."""
    def literal(s: str) -> str:
        parts = re.split(r"([\n\\$])", s)
        return " || ".join(f"chr({ord(p)})" if p in ("\n", "\\", "$") else "'" + p.replace("'", "''") + "'" for p in parts if p) or "''"

    parts = re.split(r"«(\w)»", text)
    return " || ".join(p if i % 2 else literal(p) for i, p in enumerate(parts) if i % 2 or p) or "''"


#: Events whose files one task parses, and how many such tasks there are at most; a task reads its files in batches.
_DEALT, _TASKS = 2_500, 2_000


def _shares(events: DataFrame) -> int:
    return min(max(1, -(-events.count() // _DEALT)), _TASKS)


def _dealt(spark, d) -> DataFrame:
    """The events, dealt to tasks by number: the table may be one file of few row groups, and the files made of an event are
    hundreds of times its size."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", "event_type", "user_id", "props").repartition(_shares(e), "event_id")


def _files(spark, d, *given: tuple[str, str, str]) -> DataFrame:
    """A scan per event, with the files ``(path, type, text)``."""
    e = _dealt(spark, d).select("event_id", F.col("event_type").alias("t"), F.get_json_object("props", "$.k").alias("k"), F.col("user_id").cast("string").alias("u"))
    made = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(p.rsplit("/", 1)[-1]).alias("name"), F.lit(kind).alias("file_type"), F.lit("MAIN").alias("scope"), F.expr(_expression(text)).alias("content")) for p, kind, text in given])
    return e.select(F.col("event_id").cast("string").alias("scan_id"), F.inline(made))


def _scalars(files: DataFrame) -> DataFrame:
    """The scalars of the files, parsed once for all plans over them."""
    return written(leaves(files), "query-scalars")


_COLUMNS = ("path", "line", "role", "key", "raw", "default_raw", "profile")


def _found(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("scan_id").cast("long").alias("event_id"), *_COLUMNS).withColumn("line", F.coalesce("line", F.lit(0)))


def _expected(*rows: tuple) -> str:
    """SQL of the rows ``_COLUMNS`` for every event; values may hold fields, and no line is line 0."""
    cell = lambda v: "null" if v is None else str(v) if isinstance(v, int) else _expression(v)
    kinds = {"line": "int"}
    selects = ["select event_id, " + ", ".join(f"cast({cell(v or 0 if c == 'line' else v)} as {kinds.get(c, 'varchar')}) as {c}" for c, v in zip(_COLUMNS, row)) + " from e" for row in rows]
    return f"with e as ({_EVENTS}) " + " union all ".join(selects)


def _reader(name: str, files: list[tuple[str, str, str]], read, *rows: tuple) -> None:
    Q._query(name, _expected(*rows))(lambda spark, d: _found(read(_files(spark, d, *files))))


_ENV = ".env.prod"
_reader("q50_env_file", [(_ENV, "ENV", "# head\nexport K_«t»='v «k»'\nNUM=«k» # note\nEMPTY=\nplain\n=bad\nQ=\"a # b\"\nSPRING_PROFILES_ACTIVE=x\n")], R.environment_files,
        (_ENV, 2, "DEFINE", "K_«t»", "v «k»", None, "prod"), (_ENV, 3, "DEFINE", "NUM", "«k»", None, "prod"), (_ENV, 4, "DEFINE", "EMPTY", "", None, "prod"), (_ENV, 7, "DEFINE", "Q", "a # b", None, "prod"),
        (_ENV, 8, "METADATA", "SPRING_PROFILES_ACTIVE", "x", None, "prod"))

_YML = "src/main/resources/application.yml"
_reader("q51_yaml_file", [(_YML, "YAML", "server:\n  port: «k»\n  name: \"«t»\"\nlist: [a, «k»]\ngone: ~\n---\nspring.config.activate.on-profile: p«u»\nflag: TRUE\n")], lambda f: R.application_files(_scalars(f)),
        (_YML, 2, "DEFINE", "server.port", "«k»", None, None), (_YML, 3, "DEFINE", "server.name", "«t»", None, None), (_YML, 4, "DEFINE", "list[0]", "a", None, None), (_YML, 4, "DEFINE", "list[1]", "«k»", None, None),
        (_YML, 7, "METADATA", "spring.config.activate.on-profile", "p«u»", None, "p«u»"), (_YML, 8, "DEFINE", "flag", "true", None, "p«u»"))

_PROPS = "application-x.properties"
_reader("q52_properties_file", [(_PROPS, "PROPERTIES", "a.«t» = «k»\n! note\nb : x\\\n   y\nc\\ d=\\u0041\na.«t»=last\n")], lambda f: R.application_files(_scalars(f)),
        (_PROPS, 6, "DEFINE", "a.«t»", "last", None, "x"), (_PROPS, None, "DEFINE", "b", "xy", None, "x"), (_PROPS, None, "DEFINE", "c d", "A", None, "x"))

_reader("q53_entries_in_values", [(".env", "ENV", "JAVA_TOOL_OPTIONS=-Da.«t»=«k» -Xmx1g\nSPRING_APPLICATION_JSON={x: {y: «k»}}\nURL=${HOST:-${H.«t»:h«k»}}/p\n")], lambda f: R.expanded(R.environment_files(f)),
        (".env", 1, "DEFINE", "JAVA_TOOL_OPTIONS", "-Da.«t»=«k» -Xmx1g", None, None), (".env", 1, "DEFINE", "a.«t»", "«k»", None, None), (".env", 2, "DEFINE", "SPRING_APPLICATION_JSON", "{x: {y: «k»}}", None, None),
        (".env", 2, "DEFINE", "x.y", "«k»", None, None), (".env", 3, "DEFINE", "URL", "${HOST:-${H.«t»:h«k»}}/p", None, None), (".env", 3, "READ", "HOST", None, "${H.«t»:h«k»}", None), (".env", 3, "READ", "H.«t»", None, "h«k»", None))

_XML = "src/main/resources/logback-spring.xml"
_reader("q55_runtime_xml", [(_XML, "XML", '<configuration><springProperty name="n" source="log.«t»" defaultValue="«k»"/><springProperty name="m" source="b" defaultValue=" "/><x y="${p.«t»:z}"/></configuration>'),
                            ("web.xml", "XML", "<web-app><context-param><param-name>cp</param-name><param-value>«u»</param-value></context-param></web-app>")], lambda f: R.runtime_xml(_scalars(f)).unionByName(R.xml_placeholders(f)),
        (_XML, None, "READ", "log.«t»", None, "«k»", None), (_XML, None, "READ", "b", None, None, None), (_XML, None, "READ", "p.«t»", None, "z", None), ("web.xml", None, "DEFINE", "cp", "«u»", None, None))

_reader("q56_hocon_file", [("application.conf", "HOCON", "a = 1\nblk {\n  c = «k»\n}\nd.«t»: \"x y\"\n# no\ne f = 1\n")], R.hocon_files,
        ("application.conf", 1, "DEFINE", "a", "1", None, None), ("application.conf", 5, "DEFINE", "d.«t»", "x y", None, None))

_reader("q57_dockerfile", [("Dockerfile", "DOCKERFILE", "FROM x\nENV A=«k» B=\"two words\" \\\n  C=3\nENV K «t»\nENV JAVA_OPTS=\"-Dd.«t»=7\"\n# no\nENTRYPOINT [\"java\", \"-Dz.«t»=1\", \"--server.port=«k»\"]\n")], R.dockerfiles,
        *[("Dockerfile", line, "DEFINE", key, raw, None, None) for line, key, raw in ((2, "A", "«k»"), (2, "B", "two words"), (2, "C", "3"), (4, "K", "«t»"), (5, "JAVA_OPTS", "-Dd.«t»=7"), (5, "d.«t»", "7"), (7, "z.«t»", "1"), (7, "server.port", "«k»"))])

_COMPOSE = "docker-compose.yml"
_reader("q58_compose_file", [(_COMPOSE, "YAML", "services:\n  web:\n    environment:\n      A: \"«k»\"\n      B: true\n    command: [\"--x.y=«t»\"]\n  db:\n    environment:\n      - P=«u»\n")], lambda f: R.compose_files(_scalars(f)),
        *[(_COMPOSE, None, "DEFINE", key, raw, None, None) for key, raw in (("A", "«k»"), ("B", "true"), ("x.y", "«t»"), ("P", "«u»"))])

_KUBE = "k8s/d.yaml"
_reader("q59_kubernetes_file", [(_KUBE, "YAML", (
    "apiVersion: v1\nkind: ConfigMap\nmetadata: {name: cm«u»}\ndata: {m.«t»: f«k»}\n---\napiVersion: v1\nkind: Secret\nmetadata: {name: sec}\ndata: {pw: aGk=}\nstringData: {tok: t«k»}\n---\n"
    "apiVersion: apps/v1\nkind: Deployment\nmetadata: {name: d}\nspec:\n  template:\n    spec:\n      containers:\n      - name: c\n        env: [{name: E1, value: \"5\"}]\n"
    "        envFrom: [{prefix: P_, configMapRef: {name: cm«u»}}]\n        args: [\"--k.l=«k»\"]\n"))], lambda f: R.kubernetes_files(_scalars(f)),
        *[(_KUBE, None, role, key, raw, None, None) for role, key, raw in (
            ("DEFINE", "m.«t»", "f«k»"), ("DEFINE", "tok", "t«k»"), ("METADATA", "kubernetes.secret.data.sec.pw", "pw"), ("DEFINE", "E1", "5"), ("METADATA", "kubernetes.env-from.config-map.cm«u»", "cm«u»"),
            ("DEFINE", "P_m.«t»", "f«k»"), ("DEFINE", "k.l", "«k»"))])

_CHAIN = [("application.properties", "PROPERTIES", "spring.config.import=f1.properties\n"), ("f1.properties", "PROPERTIES", "spring.config.import=optional:file:f2.properties\nk1=«k»\n"),
          ("f2.properties", "PROPERTIES", "k2=«t»\nspring.config.import=application.properties,configtree:tree/\n"), ("tree/user.name", "OTHER", "«u»\n")]


def _imported(files: DataFrame) -> DataFrame:
    scalars = _scalars(files)
    return R.imports(R.application_files(scalars), files, scalars)


_reader("q60_imports", _CHAIN, _imported,
        ("f1.properties", 1, "METADATA", "spring.config.import", "optional:file:f2.properties", None, None), ("f1.properties", 2, "DEFINE", "k1", "«k»", None, None), ("f2.properties", 1, "DEFINE", "k2", "«t»", None, None),
        ("f2.properties", 2, "METADATA", "spring.config.import", "application.properties,configtree:tree/", None, None), ("tree/user.name", 1, "DEFINE", "user.name", "«u»", None, None))

_JAVA = [("A.java", "JAVA", (
    'class A {\n  static final String K = "my." + "key";\n  @Value("${v.«t»:dd}") String s;\n  @ConditionalOnProperty(prefix = "feat", name = {"a", "b"}, havingValue = "«k»") void f(String n) {\n'
    '    System.getProperty(K, "«k»"); System.getenv(LATE);\n    System.getProperty("a.«t»." + n); System.setProperties(p);\n    SpringApplication.run(A.class, args);\n'
    '    new MapPropertySource("m", Map.ofEntries(Map.entry("mk", "«t»"), Map.entry(K, 5)));\n    System.setProperty("set.«t»", "v");\n  }\n  static final String LATE = "late.«u»";\n}\n'))]


def _java(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries and uncertain accesses, over files that are parsed once, as a scan does."""
    return J.java_entries(files, rows=written(J.invocation_rows(files), "query-invocations"), scalars=_scalars(files))


_reader("q61_java_file", _JAVA, lambda f: _java(f)[0],
        *[("A.java", line, role, key, raw, default, None) for line, role, key, raw, default in (
            (3, "READ", "v.«t»", None, "dd"), (4, "CONDITION", "feat.a", None, "«k»"), (4, "CONDITION", "feat.b", None, "«k»"), (5, "READ", "my.key", None, "«k»"), (5, "READ", "late.«u»", None, None),
            (8, "DEFINE", "mk", "«t»", None), (8, "DEFINE", "my.key", "5", None), (9, "DEFINE", "set.«t»", "v", None))])


@Q._query("q62_java_uncertain", f"""
with e as ({_EVENTS})
select event_id, 6 as line, {_expression('"a.«t»." + n')} as expression, 'STRING_CONCAT' as reason, 'System.getProperty' as root_sink from e
union all select event_id, 6, 'p', 'MAP_DRIVEN_KEY', 'System.setProperties' from e union all select event_id, 7, 'args', 'COMMAND_LINE_ARGS', 'SpringApplication.run' from e""")
def java_uncertain(spark, d):
    return _java(_files(spark, d, *_JAVA))[1].select(F.col("scan_id").cast("long").alias("event_id"), "line", "expression", "reason", "root_sink")


_META = '{"properties":[{"name":"m.«t»","type":"java.lang.Integer","defaultValue":«k»},{"name":"f.«u»","type":"java.lang.Boolean","defaultValue":true},{"name":"d","type":"java.time.Duration","defaultValue":"PT1S"},{"name":"s","defaultValue":"v"},{"type":"x"}]}'


@Q._query("q54_metadata_file", f"""
with e as ({_EVENTS})
select event_id, {_expression('m.«t»')} as key, k as default_raw, 'INTEGER' as type from e union all select event_id, 'f.' || u, 'true', 'BOOLEAN' from e
union all select event_id, 'd', 'PT1S', 'DURATION' from e union all select event_id, 's', 'v', 'STRING' from e""")
def metadata_file(spark, d):
    found = R.findings(R.metadata_files(_files(spark, d, ("additional-spring-configuration-metadata.json", "JSON", _META))))
    return found.select(F.col("scan_id").cast("long").alias("event_id"), "key", F.col("default_value.raw").alias("default_raw"), F.col("default_value.type").alias("type"))


# ---- order -------------------------------------------------------------------------------------------------------

@Q._query("q63_diff_order", "with facts select key, field, old_value, new_value, row_number() over (order by key, field, old_value nulls first, new_value nulls first, new_source nulls first) as place from changed")
def diff_order(spark, d):
    c = Q._diff(spark, d).changed
    return placed(c, "key", "field", "old_value", "new_value", "new_source").select("key", "field", "old_value", "new_value", "place")


@Q._query("q64_export_order", "select config_key, row_number() over (order by config_key) as place from (" + Q.SQL["q26_export_entries"] + ")")
def export_order(spark, d):
    return placed(export.entries(Q._items(spark, d)), "config_key").select("config_key", "place")


@Q._query("q65_removed_order", "with facts select normalized_key as config_key, row_number() over (order by normalized_key) as place from (select distinct normalized_key from removed)")
def removed_order(spark, d):
    return placed(export.removed_list(Q._diff(spark, d).removed), "config_key").select("config_key", "place")


# ---- functions and charts ----------------------------------------------------------------------------------------

@Q._query("q66_names_and_hints", f"""
with e as ({_EVENTS}), x as (select event_id, case event_id % 5 when 0 then 'cache.redis.' || t when 1 then 'db.' || t when 2 then 'spring.dataSource.' || t when 3 then 'x.JDBC.' || t else t end as key, t, k from e)
select event_id, case when contains(lower(key), 'redis') then 'redis' when starts_with(lower(key), 'db.') or contains(lower(key), 'datasource') or contains(lower(key), 'jdbc') then 'mysql' else '' end as hint,
  t as simple, k as bare, 'a ''b' as kept from x""")
def names_and_hints(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("event_type").alias("t"), F.get_json_object("props", "$.k").alias("k"))
    key = F.expr("case event_id % 5 when 0 then 'cache.redis.' || t when 1 then 'db.' || t when 2 then 'spring.dataSource.' || t when 3 then 'x.JDBC.' || t else t end")
    return e.select("event_id", K.type_hint(key).alias("hint"), K.simple_name(F.concat(F.lit("a.b."), "t")).alias("simple"), K.unquote(F.concat(F.lit('"'), "k", F.lit('"'))).alias("bare"), K.unquote(F.lit("a 'b")).alias("kept"))


@Q._query("q67_chart_shares", """
with facts, c as (select 'confidence' as dim, confidence as value, count(*) as n from items group by 2 union all select 'role', role, count(*) from items group by 2 union all select 'source_kind', source_kind, count(*) from items group by 2)
select dim, value, n, round(100 * n / sum(n) over (partition by dim), 9) as percent, round(100 * sum(n) over (partition by dim order by n desc, value rows unbounded preceding) / sum(n) over (partition by dim), 9) as cumulative from c""")
def chart_shares(spark, d):
    from ..operators import report

    s = report.shares(report.count_by_dims(Q._items(spark, d)))
    return s.select("dim", "value", "n", F.round("percent", 9).alias("percent"), F.round("cumulative", 9).alias("cumulative"))


@Q._query("q68_scope_precedence", """
with e as (select event_id, event_type, case event_id % 5 when 0 then 'exact' when 1 then 'own' when 2 then 'pat-' || event_type when 3 then 'other' else null end as profile from events)
select event_id, case profile when 'exact' then 'S_EXACT' when 'own' then 'S_OWN' when 'other' then 'S_DEFAULT' else case when profile is null then 'S_DEFAULT' else 'S_PATTERN' end end as scope from e""")
def scope_precedence(spark, d):
    from ..schema import SCOPE_RULES

    e = spark.read.parquet(f"{d}/events.parquet")
    p = e.select("event_id", F.when(F.col("event_id") % 5 == 0, "exact").when(F.col("event_id") % 5 == 1, "own").when(F.col("event_id") % 5 == 2, F.concat(F.lit("pat-"), "event_type")).when(F.col("event_id") % 5 == 3, "other").alias("profile"))
    table = spark.createDataFrame([("exact", None, False, "S_EXACT", 0), (None, "pat-.*", False, "S_PATTERN", 1), (None, "p.*", False, "S_LATER", 2), (None, None, True, "S_DEFAULT", 3), ("own", None, False, "S_RULE", 4)], SCOPE_RULES)
    return export.scoped(p, "profile", table, spark.createDataFrame([("own", "S_OWN")], "profile string, scope string")).select("event_id", F.col("resolved_scope").alias("scope"))
