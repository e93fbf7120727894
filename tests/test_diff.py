from pyspark.sql import functions as F

from factspan.operators import diff as D
from factspan.operators import export, rules
from factspan.operators import findings as N
from factspan.schema import FINDINGS

EMPTY = {k: None for k in ("value", "default_value", "expression", "reason", "root_sink", "confidence", "details", "normalized_key")}


def fact(key, raw=None, path="application.yml", role="DEFINE", profile=None, region=None, ordinal=1, type_="STRING", default=None, kind="CONFIG", scan="s", details=None, **more):
    value = lambda v: None if v is None else (v, v, type_)
    none = (None,) * 15
    return EMPTY | {"scan_id": scan, "ordinal": ordinal, "kind": kind, "key": key, "role": role, "value": value(raw), "default_value": value(default), "environment": (profile, region, None),
                    "source": (path, 1, None, "YAML", "MAIN"), "detector_id": "d", "details": details and (details, default, *none[:14])} | more


def frame(spark, *facts):
    names = [x.split(" ")[0] for x in FINDINGS.split(", ")]
    return N.normalize(spark.createDataFrame([tuple(f[n] for n in names) for f in facts], FINDINGS))


def run(spark, base, head, base_u=(), head_u=()):
    return D.diff(frame(spark, *base), frame(spark, *head), frame(spark, *base_u), frame(spark, *head_u))


def changes(d):
    return {(r["key"], r["field"], r["old_value"], r["new_value"], r["new_source"]) for r in d.changed.collect()}


def test_winner_by_priority(spark):
    d = run(spark, [fact("a", "1")], [fact("a", "2", "application-prod.yml", ordinal=1), fact("a", "3", ".env", ordinal=2)])
    assert changes(d) == {("a", "value", "1", "3", ".env"), ("a", "source.path", "application.yml", ".env", ".env")}


def test_identity_has_region(spark):
    d = run(spark, [fact("a", "1", region="x")], [fact("a", "1", region="y")])
    assert d.added.count() == 1 and d.removed.count() == 1 and d.changed.count() == 0


def test_type_change_and_nulls(spark):
    d = run(spark, [fact("a", "1"), fact("b", None)], [fact("a", "1", type_="INTEGER"), fact("b", "x")])
    assert changes(d) == {("a", "value.type", "STRING", "INTEGER", "application.yml"), ("b", "value", None, "x", "application.yml"), ("b", "value.type", None, "STRING", "application.yml")}


def test_invariants(spark):
    a, b = [fact("a", "1"), fact("c", "2")], [fact("b", "1"), fact("c", "3")]
    same = run(spark, a, a)
    assert [same.added.count(), same.removed.count(), same.changed.count()] == [0, 0, 0]
    keys = lambda f: sorted(r[0] for r in f.select("normalized_key").collect())
    assert keys(run(spark, a, b).added) == keys(run(spark, b, a).removed) == ["b"]


def test_uncertain_checks_and_summary(spark):
    u = lambda e, **k: fact(None, kind="UNCERTAIN", role=None, expression=e, reason="UNKNOWN", root_sink=" ", **k)
    d = run(spark, [], [fact("db.password", "x"), fact("spring.config.import", "file:x")], [u("e1")], [u("e1"), u("e2"), u("e2")])
    assert [r["expression"] for r in d.uncertain.collect()] == ["e2", "e2"]
    messages = sorted(r["message"] for r in d.checks.collect())
    assert messages == ["New configuration key name looks sensitive: db.password"] + ["New dynamic configuration access requires review: UNKNOWN via unknown sink: e2"] * 2 + ["New remote config center reference requires review: spring.config.import"]
    assert d.summary().first().asDict() == {"added": 2, "removed": 0, "changed": 0, "uncertain_changed": 2, "checks": 4}


def test_changed_files_and_redaction(spark):
    d = run(spark, [fact("a.secret", "1", "A/B.yml"), fact("x", "1", "c.yml")], [fact("a.secret", "2", "A/B.yml"), fact("x", "2", "c.yml")])
    kept = D.only_files(d, spark.createDataFrame([(r"a\b.YML",)], "path string"))
    assert {r["key"] for r in kept.changed.collect()} == {"a.secret"}
    assert changes(D.redacted(kept)) == {("a.secret", "value", "******", "******", "A/B.yml")}


def test_redaction_of_details(spark):
    f = frame(spark, fact("my.token", "v", details="unknown"), fact("plain", "v", details="unknown"), fact("a.pwd", None, details="java-system-property", default="d"))
    got = {r["key"]: r for r in N.redact(f).collect()}
    assert got["my.token"]["value"]["raw"] == "******" and got["plain"]["value"]["raw"] == "v"
    assert got["a.pwd"]["value"] is None and got["a.pwd"]["default_value"]["raw"] == "******" and got["a.pwd"]["details"]["default_value"] == "******"


def test_order_summary_and_hints(spark):
    rows = frame(spark, fact("b", "1", "z.yml"), fact("a", "1", "a.yml", scan="t"), fact("a", "1", "a.yml"), fact("a", "1", "a.yml", profile="p")).withColumn("emit_seq", F.lit(0))
    got = {(r["scan_id"], r["ordinal"]): (r["source"]["path"], r["environment"]["profile"]) for r in N.with_ordinal(rows).collect()}
    assert got == {("s", 1): ("a.yml", "p"), ("s", 2): ("a.yml", None), ("s", 3): ("z.yml", None), ("t", 1): ("a.yml", None)}
    hinted = N.with_hints(rows, "dev", "cn").select("environment.profile", "environment.region").distinct().collect()
    assert sorted(tuple(r) for r in hinted) == [("dev", "cn"), ("p", "cn")]


def test_export_merge_and_scopes(spark):
    items = frame(spark, fact("a.x", "1"), fact("b", None, role="READ"), fact("c", None, role="READ", default="d"), fact("db.password", "pw", profile="prod"))
    entries = {r["config_key"]: (r["config_value"], r["secret"], r["group_name"]) for r in export.entries(items).collect()}
    assert entries == {"a.x": ("1", 0, "a"), "c": ("d", 0, "default"), "db.password": ("pw", 1, "db")}
    assert [r["config_key"] for r in export.missing(items).collect()] == ["b"]
    rules_ = spark.createDataFrame([(None, "p.*", False, "rx", 0), ("prod", None, False, "exact", 1), (None, None, True, "dflt", 2)], "profile string, profile_pattern string, is_default boolean, scope string, rule_order int")
    none = spark.createDataFrame([], "profile string, scope string")
    people = spark.createDataFrame([("prod",), ("pre",), ("x",), (None,)], "own string")
    scopes = lambda r, o: {x["own"]: x["resolved_scope"] for x in export.scoped(people, "own", r, o).collect()}
    assert scopes(rules_, none) == {"prod": "exact", "pre": "rx", "x": "dflt", None: "dflt"}
    assert scopes(rules_.limit(0), spark.createDataFrame([("x", "over")], "profile string, scope string")) == {"prod": export.DEFAULT_SCOPE, "pre": export.DEFAULT_SCOPE, "x": "over", None: export.DEFAULT_SCOPE}
    assert export.valid_patterns([{"profile_pattern": "("}]) == [{"profile_pattern": None}]
    plain, secret = export.platform_artifact(export.scoped(export.defined_winners(items).withColumn("own", F.col("environment.profile")), "own", rules_, none))
    assert {r["config_key"] for r in plain.collect()} == {"a.x", "c"}
    assert [tuple(r) for r in secret.collect()] == [("db_password", "mysql", "${db_password}", export.ENCRYPT_TYPE, "exact")]


def test_globs(spark):
    files = spark.createDataFrame([("conf/x.xml",), ("conf/a/x.xml",), ("a.yml",)], "path string")
    r = spark.createDataFrame([("one", "conf/*.xml", "xml", "MAIN", 1), ("two", "**/*.xml", "xml", "MAIN", 2), ("three", "?.yml", "yaml", None, 0)], "id string, pattern string, format string, scope string, rule_order int")
    assert {x["path"]: x["rule_id"] for x in rules.first_glob(files, r).collect()} == {"conf/x.xml": "one", "conf/a/x.xml": "two", "a.yml": "three"}
