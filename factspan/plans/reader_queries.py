"""More queries of the readers: files that differ from event to event in form, not only in their fields, and rows that SQL
derives from their text; and the Java readers that ``source_queries`` leaves out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..schema import ANNOTATION_RULES, METHOD_RULES
from ..shared import written
from ..sources import detectors as R
from ..sources import java as J
from . import facts as X
from . import queries as Q
from .source_queries import _COLUMNS, _EVENTS, _dealt, _expected, _expression, _files, _found, _java, _reader, _shares

# ---- texts of many forms -----------------------------------------------------------------------------------------

#: Lines of a HOCON file; which one stands where follows from the event's number.
_HOCON = ["a«i» = «k»", "b«i» {", "}", "c«i» = ${«t»}", "d«i» : {x«k»}", "# no«i» = 1", 'e«i» = "q «t»"', "}}", "f g«i» = 1", '"h«i»" : u=«u»', "l«i» =", "m«i» {n = 1}"]
_LINES = 9


def _line(i: int) -> str:
    """Line ``i`` of an event's file as an expression that Spark and DuckDB read alike."""
    return f"case (event_id * {i + 5} + event_id % 7 + {i}) % {len(_HOCON)} " + " ".join(f"when {n} then {_expression(text.replace('«i»', str(i)))}" for n, text in enumerate(_HOCON)) + " end"


def _events(spark, d):
    return _dealt(spark, d).select("event_id", F.col("event_type").alias("t"), F.get_json_object("props", "$.k").alias("k"), F.col("user_id").cast("string").alias("u"))


def _texts(spark, d, path: str, kind: str, content: str):
    """A scan per event with one file; ``path`` and ``content`` are expressions."""
    return _events(spark, d).select(F.col("event_id").cast("string").alias("scan_id"), F.expr(path).alias("path"), F.lit(kind).alias("file_type"), F.lit("MAIN").alias("scope"), F.expr(content).alias("content")).withColumn(
        "name", F.substring_index("path", "/", -1)).select("scan_id", "path", "name", "file_type", "scope", "content")


@Q._query("q69_hocon_blocks", f"""
with recursive e as ({_EVENTS}), l as ({" union all ".join(f"select event_id, {i} as line, {_line(i)} as s from e" for i in range(1, _LINES + 1))}),
w as (select *, length(s) - length(replace(s, '{{', '')) - length(s) + length(replace(s, '}}', '')) as more from l),
d as (select event_id, 0 as line, 0 as depth from e
  union all select w.event_id, w.line, case when depth > 0 or suffix(s, '{{') then depth + more else depth end from d join w on w.event_id = d.event_id and w.line = d.line + 1),
o as (select w.event_id, w.line, s, least(nullif(instr(s, '='), 0), nullif(instr(s, ':'), 0)) as c from w join d on d.event_id = w.event_id and d.line = w.line - 1 where depth <= 0 and not suffix(s, '{{') and not starts_with(s, '#')),
p as (select event_id, line, trim(s[1:c - 1]) as k, trim(s[c + 1:]) as v from o where c > 1)
select event_id, line::int as line, case when starts_with(k, '"') then k[2:-2] else k end as key, case when starts_with(v, '"') then v[2:-2] else v end as raw from p where k <> '' and not contains(k, ' ') and v <> ''""")
def hocon_blocks(spark, d):
    content = "concat_ws(chr(10), " + ", ".join(_line(i) for i in range(1, _LINES + 1)) + ")"
    return R.hocon_files(_texts(spark, d, "'conf/application.conf'", "HOCON", content)).select(F.col("scan_id").cast("long").alias("event_id"), "line", "key", "raw")


_XML_PATH = "case event_id % 5 when 0 then 'w/web.xml' when 1 then 'x/log4j2.xml' when 2 then 'm/src/main/resources/p.xml' when 3 then 'other/p.xml' else 'domain/resources/p.xml' end"
_XML_TEXT = " || ".join([
    _expression("<a>"), "case when event_id % 2 = 0 then " + _expression("<!-- ${c.«t»:«k»} -->") + " else '' end", "case when event_id % 3 = 0 then " + _expression("<b x='${attr«k»}'/>${tail:-«t»}") + " else " + _expression("<b>${text}</b>") + " end",
    "case when event_id % 7 = 0 then " + _expression("${}${ :x}") + " else " + _expression("</a>") + " end"])


@Q._query("q70_xml_raw_text", f"""
with e as ({_EVENTS}), f as (select event_id, {_XML_PATH} as path, {_XML_TEXT} as s from e),
b as (select event_id, unnest(regexp_extract_all(s, '\\$\\{{([^}}]*)\\}}', 1)) as b from f where path not in ('other/p.xml', 'domain/resources/p.xml')),
s as (select event_id, b, instr(b, ':') as c from b)
select event_id, trim(case when c > 0 then b[1:c - 1] else b end) as key, case when c > 0 then regexp_replace(b[c + 1:], '^-', '') end as default_raw from s where trim(case when c > 0 then b[1:c - 1] else b end) <> ''""")
def xml_raw_text(spark, d):
    return R.xml_placeholders(_texts(spark, d, _XML_PATH, "XML", _XML_TEXT)).select(F.col("scan_id").cast("long").alias("event_id"), "key", "default_raw")


_META_NAME = "additional-spring-configuration-metadata.json"
_META_TYPE = "case event_id % 6 when 0 then 'java.lang.String' when 1 then 'com.acme.Duration' when 2 then 'java.time.Duration' when 3 then 'boolean' when 4 then 'java.lang.Long' else 'x' end"
_META_VALUE = "case event_id % 5 when 0 then '\"' || k || '\"' when 1 then k when 2 then 'true' when 3 then 'null' else '[1]' end"


@Q._query("q71_metadata_node_types", f"""
with e as ({_EVENTS}), f as (select event_id, {_META_TYPE} as d, {_META_VALUE} as v, k, t from e where event_id % 11 <> 0)
select event_id, 'm.' || t as key, case event_id % 5 when 3 then null when 4 then '' when 2 then 'true' else k end as default_raw,
  case when event_id % 5 = 3 then null when v = 'true' or d = 'boolean' then 'BOOLEAN' when d = 'java.time.Duration' then 'DURATION' when event_id % 5 = 1 or d = 'java.lang.Long' then 'INTEGER' else 'STRING' end as type,
  case when event_id % 11 = 0 then 1 else 0 end::bigint as broken from f
union all select event_id, null, null, null, 1 from e where event_id % 11 = 0""")
def metadata_node_types(spark, d):
    content = "case when event_id % 11 = 0 then '{\"properties\": [' else '{\"properties\": [{\"name\": \"m.' || t || '\", \"type\": \"' || " + _META_TYPE + " || '\", \"defaultValue\": ' || " + _META_VALUE + " || '}]}' end"
    files = _texts(spark, d, f"'a/{_META_NAME}'", "JSON", content)
    good = R.findings(R.metadata_files(files)).select("scan_id", "key", F.col("default_value.raw").alias("default_raw"), F.col("default_value.type").alias("type"), F.lit(0).cast("long").alias("broken"))
    none = F.lit(None).cast("string")
    bad = R.parse_diagnostics(R.leaves(files), None, files).select("scan_id", none.alias("key"), none.alias("default_raw"), none.alias("type"), F.lit(1).cast("long").alias("broken"))
    return good.unionByName(bad).withColumn("event_id", F.col("scan_id").cast("long")).drop("scan_id")


# ---- Java --------------------------------------------------------------------------------------------------------

_CLASSES = [("N.java", "JAVA", (
    'package p;\nclass P { static final String K = "p.«t»";\n  static class In { static final String K = "in.«k»"; void f() { System.getenv(K); System.getenv(P.K); } }\n  void g() { System.getenv(K); System.getenv(In.K); }\n}\n'
    'class Q { static final String K = "q.«u»";\n  void h() { System.getenv(K); System.getenv(P.K); System.getenv(X.K); }\n}\n'))]


@Q._query("q72_java_scopes", f"with e as ({_EVENTS}) " + " union all ".join(
    f"select event_id, {line}::int as line, {_expression(key) if key else 'null::varchar'} as key, '{symbol}' as symbol, {repr(text) if text else 'null::varchar'} as expression from e" for line, key, symbol, text in (
        (3, "in.«k»", "In", None), (3, "p.«t»", "In", None), (4, "p.«t»", "P", None), (4, "in.«k»", "P", None), (7, "q.«u»", "Q", None), (7, "p.«t»", "Q", None), (7, None, "Q", "X.K"))))
def java_scopes(spark, d):
    found, uncertain = _java(_files(spark, d, *_CLASSES))
    none = F.lit(None).cast("string")
    out = found.select("scan_id", "line", "key", "symbol", none.alias("expression")).unionByName(uncertain.select("scan_id", "line", none.alias("key"), "symbol", "expression"))
    return out.withColumn("event_id", F.col("scan_id").cast("long")).drop("scan_id")


_NAMES = [("one/M.java", "JAVA", 'package one; @Value("${one.«t»}") public @interface M {}'), ("two/M.java", "JAVA", 'package two; @Value("${two.«k»}") public @interface M {}'), ("A.java", "JAVA", "package a; import one.M;\nclass A { @M String s; }"),
          ("B.java", "JAVA", "package b; import two.*;\nclass B { @M String s;\n @one.M String t; }"), ("C.java", "JAVA", "package c;\nclass C { @M String s; }")]


@Q._query("q73_annotation_names", f"with e as ({_EVENTS}) " + " union all ".join(
    f"select event_id, '{path}' as path, {line}::int as line, {_expression(key)} as key from e" for path, line, key in (("A.java", 2, "one.«t»"), ("B.java", 2, "two.«k»"), ("B.java", 3, "one.«t»"))))
def annotation_names(spark, d):
    rows = written(J.invocation_rows(_files(spark, d, *_NAMES)), "query-invocations")
    return J.meta_annotation_entries(rows).select(F.col("scan_id").cast("long").alias("event_id"), "path", "line", "key")


_reader("q74_java_annotations", [("S.java", "JAVA", (
    '@ConfigurationProperties(prefix = "bind.«t»")\n@Profile({"p«k»", "x"})\nclass S {\n  @Value("#{environment[\'spel.«t»\']}") String a;\n  @ConditionalOnExpression("${cond.«k»:true}") void c() {}\n'
    '  @WebInitParam(name = "wip.«u»", value = "«k»") int w;\n  @NacosPropertySource(dataId = "d«t»", groupId = "g") int n;\n}\n'))], lambda f: _java(f)[0],
        *[("S.java", line, role, key, raw, default, profile) for line, role, key, raw, default, profile in (
            (1, "READ", "bind.«t»", None, None, None), (2, "METADATA", "spring.profiles", "p«k»", None, "p«k»"), (2, "METADATA", "spring.profiles", "x", None, "x"), (4, "READ", "spel.«t»", None, None, None),
            (5, "CONDITION", "cond.«k»", None, "true", None), (6, "DEFINE", "wip.«u»", "«k»", None, None), (7, "METADATA", "nacos.config.d«t»", None, None, None))])

_reader("q75_java_calls", [("T.java", "JAVA", (
    'class T { void f() {\n  config.getString("gen.«t»", "d«k»");\n  prefs.getInt("pref.«k»", 5);\n  bundle.getString("res.«t»");\n  Binder.get(env).bind("bnd.«u»", X.class);\n  env.resolvePlaceholders("${ph.«t»:«k»}");\n'
    '  ConfigService.getAppConfig().getProperty("ap.«t»", "a«k»");\n  ConfigService.getConfig("id«u»", "grp", 5);\n  servlet.getInitParameter("sip.«t»");\n  ctx.lookup("java:comp/env/«k»");\n'
    '  new SpringApplicationBuilder(T.class).properties("dp.«t»=«k»").profiles("prof«u»");\n  app.setDefaultProperties(Map.of("dm.«t»", "m«k»"));\n  SpringApplication.run(T.class, "--arg.«t»=«k»");\n  System.getProperties().remove("rm.«t»");\n} }\n'))], lambda f: _java(f)[0],
        *[("T.java", line, role, key, raw, default, profile) for line, role, key, raw, default, profile in (
            (2, "READ", "gen.«t»", None, "d«k»", None), (3, "READ", "pref.«k»", None, "5", None), (4, "READ", "res.«t»", None, None, None), (5, "READ", "bnd.«u»", None, None, None), (6, "READ", "ph.«t»", None, "«k»", None),
            (7, "READ", "ap.«t»", None, "a«k»", None), (8, "METADATA", "nacos.config.id«u»", None, None, None), (9, "READ", "sip.«t»", None, None, None), (10, "READ", "java:comp/env/«k»", None, None, None),
            (11, "DEFINE", "dp.«t»", "«k»", None, None), (11, "METADATA", "spring.profiles", "prof«u»", None, "prof«u»"), (12, "DEFINE", "dm.«t»", "m«k»", None, None), (13, "DEFINE", "arg.«t»", "«k»", None, None),
            (14, "DEFINE", "rm.«t»", None, None, None))])

_SOURCED = [("V.java", "JAVA", '@PropertySource("classpath:more.properties")\nclass V {}\n'), ("src/main/resources/more.properties", "PROPERTIES", "own.«t»=«k»\nheld=${ref.«u»:z}\n")]
_reader("q76_property_sources", _SOURCED, lambda f: _java(f)[0],
        ("V.java", 1, "METADATA", "spring.property-source", "classpath:more.properties", None, None), ("src/main/resources/more.properties", 1, "DEFINE", "own.«t»", "«k»", None, None),
        ("src/main/resources/more.properties", 2, "DEFINE", "held", "${ref.«u»:z}", None, None), ("src/main/resources/more.properties", 2, "READ", "ref.«u»", None, "z", None))

_RULED = [("R.java", "JAVA", 'class R { @My(key = "mk.«t»", dflt = "d«k»") int x;\n  void f() { Center.fetch("ck.«u»", "e«k»"); Other.fetch("no", "no"); } }\n')]


@Q._query("q77_user_rules", _expected(("R.java", 1, "READ", "mk.«t»", None, "d«k»", None), ("R.java", 2, "READ", "ck.«u»", None, "e«k»", None)))
def user_rules(spark, d):
    rows = written(J.invocation_rows(_files(spark, d, *_RULED)), "query-invocations")
    methods = spark.createDataFrame([("m", "Center", "fetch", 0, 1, -1, None, None)], METHOD_RULES)
    notes = spark.createDataFrame([("a", "My", "key", None, "dflt", None, None)], ANNOTATION_RULES)
    return _found(J.user_rule_entries(rows, methods, notes)).select("event_id", *_COLUMNS)


# ---- unions ------------------------------------------------------------------------------------------------------

@Q._query("q78_checks_of_all_enrichers", f"""
with facts select side as scan_id, 'sensitive-looking-key' as type, key, count(*)::bigint as n from items where {X.SENSITIVE_SQL.format('normalized_key')} group by all
union all select side, 'remote-config-source', key, count(*) from items where {Q._REMOTE_SQL} group by all
union all select side, 'dynamic-config-key', null, count(*) from facts where kind = 'UNCERTAIN' group by all""")
def checks_of_all_enrichers(spark, d):
    inv = Q._inventory(spark, d)
    return inv.checks.groupBy("scan_id", "type", F.when(F.col("type") != "dynamic-config-key", F.col("key")).alias("key")).agg(F.count("*").alias("n"))


@Q._query("q79_detectors_as_a_bag", f"""
with e as ({_EVENTS}) select event_id, 'spring-config-file' as detector_id, 'A' as key, k as raw, 2::bigint as n from e union all select event_id, 'hocon-config-file', 'A', k, 1 from e
union all select event_id, 'dockerfile-env', 'A', t, 1 from e""")
def detectors_as_a_bag(spark, d):
    """What several detectors find is put together as it is, repeats and all; it is counted in as many tasks as the files are dealt to."""
    files = _files(spark, d, (".env", "ENV", "A=«k»\nA=«k»\n"), ("application.conf", "HOCON", "A = «k»\n"), ("Dockerfile", "DOCKERFILE", "ENV A=«t»\n"))
    found = R.resource_entries(files).withColumn("event_id", F.col("scan_id").cast("long"))
    return found.repartition(_shares(spark.read.parquet(f"{d}/events.parquet")), "event_id").groupBy("event_id", "detector_id", "key", "raw").agg(F.count("*").alias("n"))
