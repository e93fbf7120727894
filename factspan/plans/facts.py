"""Configuration facts derived from the driver's tables, so that every operator runs on provided data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.findings import normalize
from ..schema import DETAILS

CUT = "2024-01-16"

#: Derivations, each an expression of event_id, user_id, event_type, value and k that Spark and DuckDB read alike.
DERIVED = {
    "kind": "case when event_id % 19 = 0 then 'UNCERTAIN' else 'CONFIG' end",
    "key": "case when event_id % 23 = 0 then 'spring.config.import' when event_id % 29 = 0 then 'spring.cloud.nacos.config.' || event_type "
           "when event_id % 31 = 0 then 'apollo.' || event_type when event_id % 17 = 0 then event_type || '.propK_' || k || '.apiToken' else event_type || '.propK_' || k end",
    "raw": "case when event_id % 23 = 0 then case when event_id % 2 = 0 then 'optional:nacos:app' else 'file:./extra' end when event_id % 7 = 0 then null "
           "when event_id % 11 = 0 then 'true' when event_id % 13 = 0 then k || 'ms' when event_id % 37 = 0 then '${' || event_type || '}' "
           "else cast(cast(floor(value) as bigint) as varchar(20)) end",
    "default_raw": "case when event_id % 5 = 0 then cast(event_id % 10 as varchar(20)) else null end",
    "role": "case event_id % 4 when 0 then 'DEFINE' when 1 then 'READ' when 2 then 'CONDITION' else 'METADATA' end",
    "profile": "case when event_id % 9 = 0 then null else 'u' || cast(user_id % 3 as varchar(20)) end",
    "region": "case when event_id % 10 = 0 then 'r1' else null end",
    "namespace": "case when event_id % 14 = 0 then 'ns' else null end",
    "path": "case event_id % 6 when 0 then '.env' when 1 then 'src/main/resources/application-x.yml' when 2 then 'src/main/resources/application.yml' "
            "when 3 then 'src/main/resources/bootstrap.yml' when 4 then 'src/main/java/A.java' else 'conf/x.xml' end",
    "source_kind": "case event_id % 6 when 4 then 'JAVA' when 5 then 'XML' else 'CONFIG_FILE' end",
    "line": "case when event_id % 3 = 0 then null else cast(event_id % 100 as int) end",
    "confidence": "case event_id % 3 when 0 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end",
    "detector_id": "case event_id % 6 when 4 then 'java-source' when 5 then 'runtime-xml' else 'config-file' end",
    "expression": "'prefix + ' || k",
    "root_sink": "case when event_id % 2 = 0 then 'getProperty' else ' ' end",
    "reason": "case when event_id % 38 = 0 then 'STRING_CONCAT' else 'UNKNOWN' end",
    "details_type": "case when event_id % 41 = 0 then 'config-center' when event_id % 6 = 4 then 'java-system-property' else 'unknown' end",
}

_TYPE_SQL = (
    "case when {0} is null then null when lower(trim({0})) in ('true', 'false') then 'BOOLEAN' when regexp_full_match(trim({0}), '-?[0-9]+') then 'INTEGER' "
    "when regexp_full_match(trim({0}), '[0-9]+(ns|us|ms|s|m|h|d)') then 'DURATION' when starts_with(trim({0}), '${{') and suffix(trim({0}), '}}') then 'PLACEHOLDER' else 'STRING' end"
)
NORMALIZE_SQL = (
    r"lower(regexp_replace(replace(regexp_replace(regexp_replace({0}, '([^._\-A-Z])([A-Z])', '\1-\2', 'g'), '([A-Z])([A-Z][a-z])', '\1-\2', 'g'), '_', '-'), '-+', '-', 'g'))"
)
SENSITIVE_SQL = "regexp_matches(lower({0}), 'password|passwd|pwd|secret|token|credential|private-key')"
PRIORITY_SQL = (
    "case when starts_with({0}, '.env') then 90 when {1} is not null and regexp_matches({0}, '(^|/)(application|bootstrap)-[^/]*$') then 80 "
    "when regexp_matches({0}, '(^|/)application\\.(yml|yaml|properties)[^/]*$') then 70 when regexp_matches({0}, '(^|/)bootstrap\\.[^/]*$') then 50 when {2} = 'JAVA' then 30 else 10 end"
)

#: The same facts for DuckDB, as the common tables ``facts``, ``items``, ``base``, ``head`` and the winners of each side.
SQL = f"""
e as (select event_id, user_id, event_type, value, ts, json_extract_string(props, '$.k') as k from events),
raw_facts as (select event_id as ordinal, ts, {', '.join(f'{x} as "{n}"' for n, x in DERIVED.items())} from e),
facts as (select *, case when ts < timestamp '{CUT}' then 'base' else 'head' end as side,
  {NORMALIZE_SQL.format('key')} as normalized_key, {_TYPE_SQL.format('raw')} as type, {_TYPE_SQL.format('default_raw')} as default_type,
  {PRIORITY_SQL.format('path', 'profile', 'source_kind')} as priority from raw_facts),
items as (select * from facts where kind = 'CONFIG'),
uncertain as (select * from facts where kind = 'UNCERTAIN'),
ident as (select *, coalesce(profile, '') as i_profile, coalesce(region, '') as i_region, coalesce(namespace, '') as i_namespace from items),
best as (select * from ident qualify row_number() over (partition by side, normalized_key, role, i_profile, i_region, i_namespace order by priority desc, ordinal) = 1),
b as (select * from best where side = 'base'),
h as (select * from best where side = 'head'),
added as (select h.* from h anti join b using (normalized_key, role, i_profile, i_region, i_namespace)),
removed as (select b.* from b anti join h using (normalized_key, role, i_profile, i_region, i_namespace)),
pairs as (select h.normalized_key, b.raw as b1, h.raw as h1, b.type as b2, h.type as h2, b.default_raw as b3, h.default_raw as h3, b.default_type as b4, h.default_type as h4, b.path as b5, h.path as h5
  from b join h using (normalized_key, role, i_profile, i_region, i_namespace)),
changed as (select * from (
  select normalized_key as key, 'value' as field, b1 as old_value, h1 as new_value, h5 as new_source from pairs where b1 is distinct from h1
  union all select normalized_key, 'value.type', b2, h2, h5 from pairs where b2 is distinct from h2
  union all select normalized_key, 'defaultValue', b3, h3, h5 from pairs where b3 is distinct from h3
  union all select normalized_key, 'defaultValue.type', b4, h4, h5 from pairs where b4 is distinct from h4
  union all select normalized_key, 'source.path', b5, h5, h5 from pairs where b5 is distinct from h5)),
uncertain_new as (select * from uncertain u where side = 'head' and expression not in (select expression from uncertain where side = 'base')),
winners as (select w.*, d.defined, d.defined or w.default_raw is not null as has_value from
  (select * from items qualify row_number() over (partition by normalized_key order by priority desc, ordinal) = 1) w
  join (select normalized_key, bool_or(role = 'DEFINE') as defined from items group by 1) d using (normalized_key))
"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in the layout of ``schema.FINDINGS``; ``scan_id`` is base or head, by time."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k"))
    d = e.select(F.col("event_id").alias("ordinal"), F.when(F.col("ts") < F.lit(CUT).cast("timestamp_ntz"), "base").otherwise("head").alias("scan_id"), *[F.expr(x).alias(n) for n, x in DERIVED.items()])
    from ..functions.keys import infer_type

    value = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("raw"), F.col(c).alias("normalized"), infer_type(c).alias("type")))
    none = F.lit(None).cast("string")
    details = F.struct(
        F.col("details_type").alias("type"), F.col("default_raw").alias("default_value"), none.alias("raw_expression"), none.alias("prefix"), none.alias("bound_type"),
        F.lit(False).alias("inferred_from_fields"), F.lit(False).alias("from_constant"), none.alias("namespace"), none.alias("group"), none.alias("data_id"), none.alias("external_type"),
        none.alias("payload"), none.alias("reason"), F.col("raw").alias("raw_text"), none.alias("known_prefix"), none.alias("known_suffix")).cast(DETAILS)
    return normalize(d.select(
        "scan_id", "ordinal", "kind", "key", none.alias("normalized_key"), "role", value("raw").alias("value"), value("default_raw").alias("default_value"),
        "expression", "reason", "root_sink", F.struct("profile", "region", "namespace").alias("environment"),
        F.struct("path", "line", none.alias("symbol"), "source_kind", F.lit("MAIN").alias("scope")).alias("source"), "confidence", "detector_id", details.alias("details")))
