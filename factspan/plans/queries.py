"""The registered queries of the configuration operators, with the same questions in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.placeholders import flat_placeholders, nested_placeholders
from ..operators import export, report, rules
from ..operators import diff as D
from ..operators import findings as N
from ..operators.rank import winners_by_identity
from . import facts as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql.replace("with facts,", "with " + X.SQL + ",").replace("with facts ", "with " + X.SQL + " ")
        return f
    return keep


def _items(spark, d):
    return N.split(X.facts(spark, d))[0]


def _uncertain(spark, d):
    return N.split(X.facts(spark, d))[1]


def _diff(spark, d) -> D.Diff:
    items, uncertain = N.split(X.facts(spark, d))
    side = lambda f, s: f.where(F.col("scan_id") == s)
    return D.diff(side(items, "base"), side(items, "head"), side(uncertain, "base"), side(uncertain, "head"))


_FACT_SQL = "normalized_key, role, profile, region, namespace, raw, default_raw, path, ordinal"


# ---- scalar functions --------------------------------------------------------------------------------------------

@_query("q01_normalize_key", f"with facts select ordinal, key, {X.NORMALIZE_SQL.format('key')} as normalized_key from items")
def normalize_key(spark, d):
    return _items(spark, d).select("ordinal", "key", K.normalize_key("key").alias("normalized_key"))


_ISO_SQL = r"(?i)[-+]?P([-+]?[0-9]+D)?(T([-+]?[0-9]+H)?([-+]?[0-9]+M)?([-+]?[0-9]+([.,][0-9]{0,9})?S)?)?"
_VALUES_SQL = "select event_id, case event_id % 8 when 0 then ' TRUE ' when 1 then 'PT' || k || 'M' when 2 then k || 'ms' when 3 then '-' || k when 4 then '${' || event_type || '}' when 5 then 'P' || k || 'D' when 6 then 'PT' else event_type end as v from (select event_id, event_type, json_extract_string(props, '$.k') as k from events)"


def _values(spark, d):
    k = F.get_json_object("props", "$.k")
    v = (F.when(F.col("event_id") % 8 == 0, " TRUE ").when(F.col("event_id") % 8 == 1, F.concat(F.lit("PT"), k, F.lit("M"))).when(F.col("event_id") % 8 == 2, F.concat(k, F.lit("ms")))
         .when(F.col("event_id") % 8 == 3, F.concat(F.lit("-"), k)).when(F.col("event_id") % 8 == 4, F.concat(F.lit("${"), "event_type", F.lit("}"))).when(F.col("event_id") % 8 == 5, F.concat(F.lit("P"), k, F.lit("D")))
         .when(F.col("event_id") % 8 == 6, "PT").otherwise(F.col("event_type")))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", v.alias("v"))


_FULL_SQL = (f"case when lower(trim(v)) in ('true', 'false') then 'BOOLEAN' when regexp_full_match(trim(v), '-?[0-9]+') then 'INTEGER' "
             f"when regexp_full_match(trim(v), '[0-9]+(ns|us|ms|s|m|h|d)') or (length(trim(v)) > 1 and regexp_matches(v, '[0-9]') and regexp_full_match(trim(v), '{_ISO_SQL}') and not upper(trim(v)) like '%T') then 'DURATION' ")


@_query("q02_infer_type_full", f"with v as ({_VALUES_SQL}) select event_id, {_FULL_SQL} when starts_with(trim(v), '${{') and suffix(trim(v), '}}') then 'PLACEHOLDER' else 'STRING' end as type, {_FULL_SQL} else 'STRING' end as java_type from v")
def infer_type_full(spark, d):
    return _values(spark, d).select("event_id", K.infer_type("v").alias("type"), K.infer_type("v", placeholders=False).alias("java_type"))


@_query("q03_infer_type_lite", f"with v as ({_VALUES_SQL}) select event_id, case when lower(v) in ('true', 'false') then 'BOOLEAN' when regexp_full_match(v, '-?[0-9]+') then 'INTEGER' else 'STRING' end as type from v")
def infer_type_lite(spark, d):
    return _values(spark, d).select("event_id", K.infer_type_lite("v").alias("type"))


@_query("q04_json_flatten", "select event_id, j.key as key, json_extract_string(props, '$.' || j.key) as value from events, json_each(props) j")
def json_flatten(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.explode(F.from_json("props", "map<string,string>"))).select("event_id", "key", "value")


@_query("q05_url_properties", """
select page_id, split_part(p, '=', 1) as key, case when contains(p, '=') then substr(p, instr(p, '=') + 1) else '' end as value
from (select page_id, unnest(string_split(substr(url, instr(url, '?') + 1), '&')) as p from pages where contains(url, '?')) where p <> ''""")
def url_properties(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").where(F.col("url").contains("?"))
    p = p.select("page_id", F.explode(F.split(F.expr("substr(url, instr(url, '?') + 1)"), "&")).alias("p")).where("p <> ''")
    return p.select("page_id", F.split_part("p", F.lit("="), F.lit(1)).alias("key"), F.when(F.col("p").contains("="), F.expr("substr(p, instr(p, '=') + 1)")).otherwise("").alias("value"))


_FLAT = "'a ${' || event_type || ':' || k || '} b ${other.' || cast(user_id as varchar(20)) || '} c'"


@_query("q06_placeholder_flat", f"""
with t as (select event_id, regexp_extract_all({_FLAT}, '\\$\\{{([^${{}}]*)\\}}', 1) as bodies from (select *, json_extract_string(props, '$.k') as k from events)),
u as (select event_id, unnest(bodies) as b from t)
select event_id, case when contains(b, ':') then split_part(b, ':', 1) else b end as key, case when contains(b, ':') then substr(b, instr(b, ':') + 1) end as default_value from u""")
def placeholder_flat(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("k", F.get_json_object("props", "$.k"))
    return e.select("event_id", F.inline(flat_placeholders(F.expr(_FLAT))))




@_query("q07_placeholder_nested", """
with t as (select event_id, event_type, json_extract_string(props, '$.k') as k from events)
select event_id, event_type as key, '${NEST_' || k || ':-${deep}}' as default_value from t
union all select event_id, 'NEST_' || k, '${deep}' from t
union all select event_id, 'deep', null from t""")
def placeholder_nested(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("k", F.get_json_object("props", "$.k"))
    text = F.concat(F.lit("x ${"), "event_type", F.lit(":${NEST_"), "k", F.lit(":-${deep}}} y ${open"))
    return e.select("event_id", F.inline(nested_placeholders(text))).select("event_id", "key", "default_value")


# ---- inventory ---------------------------------------------------------------------------------------------------

@_query("q08_env_coalesce", "with facts select ordinal, coalesce(profile, 'dev') as profile, coalesce(region, 'cn') as region, namespace from facts")
def env_coalesce(spark, d):
    return N.with_hints(X.facts(spark, d), "dev", "cn").select("ordinal", F.col("environment.profile").alias("profile"), F.col("environment.region").alias("region"), F.col("environment.namespace").alias("namespace"))


@_query("q09_stable_order_ordinal", """
with facts select ordinal as event_id, side as scan_id, row_number() over (partition by side order by path, line nulls last, profile nulls last, detector_id, key, ordinal)::bigint as ordinal from facts""")
def stable_order(spark, d):
    f = X.facts(spark, d).withColumn("emit_seq", F.col("ordinal"))
    return N.with_ordinal(f).select(F.col("emit_seq").alias("event_id"), "scan_id", "ordinal")


def _inventory(spark, d):
    f = X.facts(spark, d)
    none = f.limit(0).select("scan_id", F.lit("").alias("severity"), F.lit("").alias("phase"), F.lit("").alias("message"), F.lit("").alias("component_id"))
    return N.build(f, none)


_REMOTE_SQL = ("(details_type = 'config-center' or regexp_matches(lower(normalized_key), '^(spring\\.cloud\\.(config|nacos\\.config|consul\\.config|zookeeper\\.config|etcd\\.config)\\.|apollo\\.)') "
               "or (lower(normalized_key) = 'spring.config.import' and coalesce(regexp_matches(lower(raw), '(configserver|nacos|consul|zookeeper|etcd|apollo):'), false)))")


@_query("q10_split_counts", f"""
with facts, s as (select side, count(distinct normalized_key) filter (where kind = 'CONFIG') as keys, count(*) filter (where kind = 'CONFIG') as findings, count(*) filter (where kind = 'UNCERTAIN') as uncertain,
  (count(*) filter (where kind = 'UNCERTAIN') + count(*) filter (where kind = 'CONFIG' and {X.SENSITIVE_SQL.format('normalized_key')}) + count(*) filter (where kind = 'CONFIG' and {_REMOTE_SQL})) as checks from facts group by side)
select side as scan_id, keys, findings, uncertain, checks, 0::bigint as diagnostics from s""")
def split_counts(spark, d):
    return _inventory(spark, d).summary


@_query("q11_sensitive_flag", f"select doc_id, {X.SENSITIVE_SQL.format('text')} as sensitive from documents")
def sensitive_flag(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", K.is_sensitive("text").alias("sensitive"))


@_query("q12_remote_scan", f"with facts select side as scan_id, 'Remote config center reference needs external inventory review: ' || key as message, path, ordinal % 1 as o from items where {_REMOTE_SQL}")
def remote_scan(spark, d):
    return N.remote_checks(_items(spark, d)).select("scan_id", "message", F.col("source.path").alias("path"), F.lit(0).cast("long").alias("o"))


@_query("q13_remote_diff", "with facts select ordinal from added where details_type = 'config-center' or regexp_matches(lower(normalized_key), '^spring\\.cloud\\.(nacos\\.)?config\\.') or lower(normalized_key) = 'spring.config.import'")
def remote_diff(spark, d):
    return _diff(spark, d).added.where(K.is_remote_in_diff("normalized_key", F.col("details.type"))).select("ordinal")


@_query("q14_uncertain_checks", "with facts select side as scan_id, 'ERROR' as severity, 'Dynamic configuration key requires review: ' || reason || ' via ' || case when trim(root_sink) = '' then 'unknown sink' else root_sink end || ': ' || expression as message, path from uncertain")
def uncertain_checks(spark, d):
    return N.uncertain_checks(_uncertain(spark, d)).select("scan_id", "severity", "message", F.col("source.path").alias("path"))


@_query("q15_redact_values", f"""
with facts, s as (select *, {X.SENSITIVE_SQL.format('normalized_key')} as hit from items)
select ordinal, case when hit and raw is not null then '******' else raw end as raw, type, case when hit and default_raw is not null then '******' else default_raw end as default_raw,
  case when hit and details_type in ('java-system-property', 'config-center') and default_raw is not null then '******' else default_raw end as details_default,
  case when hit and details_type = 'unknown' then '******' else raw end as details_text from s""")
def redact_values(spark, d):
    return N.redact(_items(spark, d)).select("ordinal", F.col("value.raw").alias("raw"), F.col("value.type").alias("type"), F.col("default_value.raw").alias("default_raw"),
                                             F.col("details.default_value").alias("details_default"), F.col("details.raw_text").alias("details_text"))


@_query("q16_redact_diff", f"""
with facts select key, field, case when {X.SENSITIVE_SQL.format('key')} and field in ('value', 'defaultValue') then '******' else old_value end as old_value,
  case when {X.SENSITIVE_SQL.format('key')} and field in ('value', 'defaultValue') then '******' else new_value end as new_value, new_source from changed""")
def redact_diff(spark, d):
    return D.redact_changes(_diff(spark, d).changed)


# ---- ranking and diff --------------------------------------------------------------------------------------------

@_query("q17_priority", "with facts select ordinal, priority from facts")
def priority(spark, d):
    return X.facts(spark, d).select("ordinal", K.priority(F.col("source.path"), F.col("environment.profile"), F.col("source.source_kind")).alias("priority"))


@_query("q18_dedup_identity", f"with facts select {_FACT_SQL} from h")
def dedup_identity(spark, d):
    w = winners_by_identity(_items(spark, d).where("scan_id = 'head'"))
    return w.select("normalized_key", "role", *[F.col(f"environment.{n}").alias(n) for n in ("profile", "region", "namespace")], F.col("value.raw").alias("raw"),
                    F.col("default_value.raw").alias("default_raw"), F.col("source.path").alias("path"), "ordinal")


@_query("q19_dedup_key", "with facts select normalized_key, raw, default_raw, path, ordinal, defined, has_value from winners")
def dedup_key(spark, d):
    return export.defined_winners(_items(spark, d)).select("normalized_key", F.col("value.raw").alias("raw"), F.col("default_value.raw").alias("default_raw"), F.col("source.path").alias("path"), "ordinal", "defined", "has_value")


@_query("q20_diff_added", "with facts select normalized_key, role, i_profile as profile, i_region as region, i_namespace as namespace, raw, path, ordinal from added")
def diff_added(spark, d):
    return _diff(spark, d).added.select("normalized_key", "role", "profile", "region", "namespace", F.col("value.raw").alias("raw"), F.col("source.path").alias("path"), "ordinal")


@_query("q21_diff_removed", "with facts select normalized_key, role, i_profile as profile, i_region as region, i_namespace as namespace, raw, path, ordinal from removed")
def diff_removed(spark, d):
    return _diff(spark, d).removed.select("normalized_key", "role", "profile", "region", "namespace", F.col("value.raw").alias("raw"), F.col("source.path").alias("path"), "ordinal")


@_query("q22_diff_changed", "with facts select key, field, old_value, new_value, new_source from changed")
def diff_changed(spark, d):
    return _diff(spark, d).changed


@_query("q23_uncertain_new", "with facts select ordinal, expression from uncertain_new")
def uncertain_new(spark, d):
    return _diff(spark, d).uncertain.select("ordinal", "expression")


_FILES = ["SRC\\main\\resources\\application.yml", "conf/x.xml", "missing.yml"]


@_query("q24_changed_file_filter", """
with facts, f as (select unnest(['src/main/resources/application.yml', 'conf/x.xml', 'missing.yml']) as p)
select 'added' as section, count(*) as n from added where lower(path) in (select p from f)
union all select 'removed', count(*) from removed where lower(path) in (select p from f)
union all select 'changed', count(*) from changed where lower(new_source) in (select p from f)
union all select 'uncertain', count(*) from uncertain_new where lower(path) in (select p from f)""")
def changed_file_filter(spark, d):
    out = D.only_files(_diff(spark, d), spark.createDataFrame([(p,) for p in _FILES], "path string"))
    count = lambda n, f: f.agg(F.count("*").alias("n")).select(F.lit(n).alias("section"), "n")
    return count("added", out.added).unionByName(count("removed", out.removed)).unionByName(count("changed", out.changed)).unionByName(count("uncertain", out.uncertain))


_DIFF_CHECKS_SQL = (f"(select count(*) from uncertain_new) + (select count(*) from added where {X.SENSITIVE_SQL.format('normalized_key')}) + "
                    "(select count(*) from added where details_type = 'config-center' or regexp_matches(lower(normalized_key), '^spring\\.cloud\\.(nacos\\.)?config\\.') or lower(normalized_key) = 'spring.config.import')")


@_query("q25_diff_summary", f"with facts select (select count(*) from added) as added, (select count(*) from removed) as removed, (select count(*) from changed) as changed, (select count(*) from uncertain_new) as uncertain_changed, {_DIFF_CHECKS_SQL} as checks")
def diff_summary(spark, d):
    return _diff(spark, d).summary()


# ---- export ------------------------------------------------------------------------------------------------------

_GROUP_SQL = "case when instr({0}, '.') > 1 then split_part({0}, '.', 1) else 'default' end"
_VALUE_OR, _NOTHING = "coalesce(raw, default_raw, '')", "''"
_ENTRY_SQL = f"'default' as scope, {_GROUP_SQL.format('normalized_key')} as group_name, normalized_key as config_key, {{0}} as config_value, ({X.SENSITIVE_SQL.format('normalized_key')})::int as secret, '' as sub_application_id, '1.0' as version, '1.0' as docker_version, '' as remark"


@_query("q26_export_entries", f"with facts select {_ENTRY_SQL.format(_VALUE_OR)} from winners where has_value")
def export_entries(spark, d):
    return export.entries(_items(spark, d))


@_query("q27_missing", f"with facts select {_ENTRY_SQL.format(_NOTHING)} from winners where not has_value")
def missing(spark, d):
    return export.missing(_items(spark, d))


@_query("q28_merge_filled", """
with facts, own as (select normalized_key as config_key, coalesce(raw, default_raw, '') as config_value, cast('base' as varchar) as remark from winners where has_value),
f as (select normalized_key as config_key, cast(null as varchar) as config_value, cast('filled' as varchar) as remark from winners where not has_value or length(normalized_key) % 3 = 0)
select coalesce(f.config_key, own.config_key) as config_key, case when f.config_key is not null then f.config_value else own.config_value end as config_value, case when f.config_key is not null then f.remark else own.remark end as remark
from own full join f on own.config_key = f.config_key""")
def merge_filled(spark, d):
    w = export.defined_winners(_items(spark, d))
    base = w.where("has_value").select(F.col("normalized_key").alias("config_key"), K.value_or(F.col("value.raw"), F.col("default_value.raw")).alias("config_value"), F.lit("base").alias("remark"))
    filled = w.where(~F.col("has_value") | (F.length("normalized_key") % 3 == 0)).select(F.col("normalized_key").alias("config_key"), F.lit(None).cast("string").alias("config_value"), F.lit("filled").alias("remark"))
    return export.merge(base, filled)


_RULES = [(None, "u.*", False, "by-pattern", 0), ("u1", None, False, "exact", 1), (None, "u[12]", False, "later", 2), (None, None, True, "fallback-rule", 3)]
_SCOPE_SQL = "case when profile = 'u0' then 'override' when profile = 'u1' then 'exact' when regexp_full_match(profile, 'u.*') then 'by-pattern' else 'fallback-rule' end"


def _scoped(spark, frame, profile):
    from ..schema import SCOPE_RULES
    return export.scoped(frame, profile, spark.createDataFrame(_RULES, SCOPE_RULES), spark.createDataFrame([("u0", "override")], "profile string, scope string"))


@_query("q29_scope_mapping", f"with facts select ordinal, {_SCOPE_SQL} as scope from items")
def scope_mapping(spark, d):
    f = _items(spark, d).select("ordinal", F.col("environment.profile").alias("own"))
    return _scoped(spark, f, "own").select("ordinal", F.col("resolved_scope").alias("scope"))


@_query("q30_artifact_partition", f"""
with facts, w as (select *, {X.SENSITIVE_SQL.format('normalized_key')} as hit, {_SCOPE_SQL} as s, lower(replace(replace(normalized_key, '-', '_'), '.', '_')) as u from winners)
select 'plain' as part, normalized_key as key, coalesce(raw, default_raw, '') as value, s as scope from w where not hit and has_value
union all select 'secret', u, '${{' || u || '}}', s from w where hit""")
def artifact_partition(spark, d):
    w = _scoped(spark, export.defined_winners(_items(spark, d)).withColumn("own", F.col("environment.profile")), "own")
    plain, secret = export.platform_artifact(w)
    return plain.select(F.lit("plain").alias("part"), F.col("config_key").alias("key"), F.col("config_value").alias("value"), "scope").unionByName(
        secret.select(F.lit("secret").alias("part"), "key", F.col("reference").alias("value"), "scope"))


@_query("q31_diff_artifact_first_change", """
with facts select key, field, old_value, new_value, new_source from changed where field = 'value'
qualify row_number() over (partition by key order by old_value nulls first, new_value nulls first, new_source nulls first) = 1""")
def first_change(spark, d):
    return export.first_value_changes(_diff(spark, d).changed)


@_query("q32_removed_list", f"with facts select distinct normalized_key as config_key, {_GROUP_SQL.format('normalized_key')} as group_name from removed")
def removed_list(spark, d):
    return export.removed_list(_diff(spark, d).removed)


# ---- report ------------------------------------------------------------------------------------------------------

@_query("q33_count_by_dims", """
with facts select 'confidence' as dim, confidence as value, count(*) as n from items group by 2
union all select 'role', role, count(*) from items group by 2 union all select 'source_kind', source_kind, count(*) from items group by 2""")
def count_by_dims(spark, d):
    return report.count_by_dims(_items(spark, d))


_DIRS_SQL = f"select case when contains(path, '/') then regexp_extract(path, '^(.*)/[^/]*$', 1) else '(root)' end as directory, count(*) as findings, count(distinct normalized_key) as keys, count(*) filter (where {X.SENSITIVE_SQL.format('key')}) as sensitive from items group by 1"


@_query("q34_dir_stats", f"with facts {_DIRS_SQL}")
def dir_stats(spark, d):
    return report.directory_stats(_items(spark, d))


@_query("q35_top_dirs", f"with facts, s as ({_DIRS_SQL}) select * from s order by findings desc, directory limit 2")
def top_dirs(spark, d):
    return report.top_directories(_items(spark, d), 2)


@_query("q36_multi_source_keys", f"with facts, k as (select normalized_key, count(*) as n from items group by 1) select count(*) as keys, count(*) filter (where {X.SENSITIVE_SQL.format('normalized_key')}) as sensitive_keys, count(*) filter (where n > 1) as multi_source_keys from k")
def multi_source_keys(spark, d):
    return report.key_stats(_items(spark, d))


@_query("q37_read_minus_defined", "with facts select key from items where role = 'READ' except select key from items where role = 'DEFINE'")
def read_minus_defined(spark, d):
    return rules.read_minus_defined(_items(spark, d))


@_query("q38_defined_minus_read", "with facts select key from items where role = 'DEFINE' except select key from items where role = 'READ'")
def defined_minus_read(spark, d):
    return rules.defined_minus_read(_items(spark, d))


# ---- joins with small tables -------------------------------------------------------------------------------------

@_query("q39_env_from_join", """
with m as (select o_orderpriority as name, cast(o_custkey % 50 as varchar) as key, cast(o_orderkey as varchar) as value, o_orderkey as ordinal from orders),
last as (select * from m qualify row_number() over (partition by name, key order by ordinal desc) = 1),
i as (select distinct o_orderpriority as name, 'P' || o_orderstatus || '_' as prefix, 'k8s/' || o_orderstatus || '.yaml' as path from orders)
select i.name, prefix || key as key, value, path from i join last using (name)""")
def env_from_join(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    data = o.select(F.col("o_orderpriority").alias("name"), (F.col("o_custkey") % 50).cast("string").alias("key"), F.col("o_orderkey").cast("string").alias("value"), F.col("o_orderkey").alias("ordinal"))
    imports = o.select(F.col("o_orderpriority").alias("name"), F.concat(F.lit("P"), "o_orderstatus", F.lit("_")).alias("prefix"), F.concat(F.lit("k8s/"), "o_orderstatus", F.lit(".yaml")).alias("path")).distinct()
    return rules.env_from(imports, data)


_METHOD_RULES = [("r1", "MED", "IUM", 0, 1, None, "HIGH", "READ"), ("r2", "", "MO", 0, None, 1, "MEDIUM", "DEFINE"), ("r3", "STAND", "D", 0, 1, None, "LOW", "READ")]


@_query("q40_rule_match_theta", """
with r(id, owner, method) as (values ('r1', 'MED', 'IUM'), ('r2', '', 'MO'), ('r3', 'STAND', 'D'))
select p_partkey, r.id as rule_id from part join r on suffix(p_type, r.method) and (r.owner = '' or contains(p_type, r.owner))""")
def rule_match(spark, d):
    from ..schema import METHOD_RULES
    calls = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_type").alias("owner"), F.col("p_type").alias("method"))
    return rules.match_methods(calls, spark.createDataFrame(_METHOD_RULES, METHOD_RULES)).select("p_partkey", "rule_id")


_FILE_RULES = [("yaml", "**/*.yml", "yaml", "RUNTIME", 1), ("conf", "conf/*.xml", "xml", "MAIN", 0), ("any", "**", "text", "BUILD", 2)]


@_query("q41_glob_rule_first", """
with facts select ordinal, case when regexp_full_match(path, 'conf/[^/]*\\.xml') then 'conf' when regexp_full_match(path, '(.*/)?[^/]*\\.yml') then 'yaml' else 'any' end as rule_id from facts""")
def glob_rule(spark, d):
    from ..schema import FILE_RULES
    f = X.facts(spark, d).select("ordinal", F.col("source.path").alias("path"))
    return rules.first_glob(f, spark.createDataFrame(_FILE_RULES, FILE_RULES)).select("ordinal", "rule_id")


@_query("q42_meta_annotation_join", "select p.p_partkey as line, p.p_brand as name, n.n_name as key from part p join nation n on p.p_brand = 'Brand#' || n.n_nationkey::varchar")
def meta_annotation(spark, d):
    declared = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_name").alias("key"))
    used = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("name"), F.lit("").alias("path"), F.col("p_partkey").alias("line"))
    return rules.meta_annotation_reads(declared, used).select("line", "name", "key")


@_query("q43_html_escape", "select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') as escaped from pages")
def html_escape(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", K.html_escape("html").alias("escaped"))


@_query("q44_missing_after_diff", """
with facts, c as (select * from changed where field = 'value' qualify row_number() over (partition by key order by old_value nulls first, new_value nulls first, new_source nulls first) = 1)
select normalized_key as config_key, path as source, 'added without value' as reason from added where trim(coalesce(raw, default_raw, '')) = ''
union all select key, new_source, 'changed to empty value' from c where trim(coalesce(new_value, '')) = ''""")
def missing_after_diff(spark, d):
    x = _diff(spark, d)
    return export.missing_after(x.added, x.changed)


@_query("q45_report_search", "with facts select distinct normalized_key from items where contains(lower(concat_ws(' ', normalized_key, raw, default_raw, path)), 'x.xml')")
def report_search(spark, d):
    return report.search(_items(spark, d), "X.xml")


@_query("q46_grouped_findings", """
with facts select normalized_key, ordinal, priority, case when length(raw) > 0 then raw when length(default_raw) > 0 then default_raw || ' (default)' else '-' end as shown, path, role from items""")
def grouped_findings(spark, d):
    return report.grouped(_items(spark, d))


@_query("q47_arguments", """
with a as (select event_id, unnest(string_split('--' || event_type || '=' || json_extract_string(props, '$.k') || ' -Dpool.size=' || cast(user_id as varchar) || ' plain', ' ')) as t from events)
select event_id, regexp_extract(t, '^(--|-D)([^=]+)=(.*)$', 2) as key, regexp_extract(t, '^(--|-D)([^=]+)=(.*)$', 3) as value from a where regexp_matches(t, '^(--|-D)([^=]+)=')""")
def arguments(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("k", F.get_json_object("props", "$.k"))
    t = e.select("event_id", F.explode(F.split(F.expr("'--' || event_type || '=' || k || ' -Dpool.size=' || cast(user_id as string) || ' plain'"), " ")).alias("t"))
    return t.select("event_id", K.argument_key("t").alias("key"), K.argument_value("t").alias("value")).where("key is not null")


@_query("q48_profile_of_path", """
select event_id, case event_id % 4 when 0 then event_type when 1 then event_type when 2 then null else null end as profile from events""")
def profile_of_path(spark, d):
    p = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("a/.env."), "event_type")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("b/application-"), "event_type", F.lit(".yml"))).when(F.col("event_id") % 4 == 2, "application.yml").otherwise(".env")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", K.profile_of_path(p).alias("profile"))
from . import source_queries as _sources  # noqa: E402,F401  registers the queries of the readers
from . import reader_queries as _readers  # noqa: E402,F401
