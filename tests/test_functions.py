import random

import pytest
from pyspark.sql import functions as F

from factspan.functions import keys as K
from factspan.functions.placeholders import flat_placeholders, scan


def plain_normalize(k):
    out = ""
    for i, c in enumerate(k):
        p, n = k[i - 1] if i else "", k[i + 1] if i + 1 < len(k) else ""
        if c.isupper() and p and p not in ".-_" and (not p.isupper() or n.islower()):
            out += "-"
        out += "-" if c == "_" else c
    while "--" in out:
        out = out.replace("--", "-")
    return out.lower()


def column(spark, values, *columns):
    return [tuple(r) for r in spark.createDataFrame([(v,) for v in values], "v string").select(*columns).collect()]


def test_normalize_key_against_a_plain_model(spark):
    rng = random.Random(1)
    keys = ["".join(rng.choice("abAB1._-") for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["paymentTimeout", "SERVER_PORT", "HTTPServer"]
    assert [r[0] for r in column(spark, keys, K.normalize_key("v"))] == [plain_normalize(k) for k in keys]


def test_types(spark):
    got = dict(column(spark, ["true", " 5 ", "-5", "10ms", "PT5M", "P", "PT", "P1D", "${a}", "x", "1h", ""], "v", K.infer_type("v")))
    assert got == {"true": "BOOLEAN", " 5 ": "INTEGER", "-5": "INTEGER", "10ms": "DURATION", "PT5M": "DURATION", "P": "STRING", "PT": "STRING", "P1D": "DURATION", "${a}": "PLACEHOLDER", "x": "STRING", "1h": "DURATION", "": "STRING"}
    assert column(spark, [None, "${a}"], K.infer_type("v", placeholders=False)) == [("UNKNOWN",), ("STRING",)]
    assert column(spark, [" 5", "5", "FALSE"], K.infer_type_lite("v")) == [("STRING",), ("INTEGER",), ("BOOLEAN",)]


def test_names_and_paths(spark):
    assert column(spark, ["a.b", ".b", "ab", ""], K.group_of("v")) == [("a",), ("default",), ("default",), ("default",)]
    assert column(spark, ["a.b-C", None, " "], K.to_underscore("v")) == [("a_b_c",), ("config",), ("config",)]
    assert column(spark, ["my.redis.x", "db.url", "a.jdbc", "z"], K.type_hint("v")) == [("redis",), ("mysql",), ("mysql",), ("",)]
    assert column(spark, [r"A\B.yml", None], K.normalize_path("v")) == [("a/b.yml",), ("",)]
    assert column(spark, ["a/b/c.x", "c.x"], K.directory_of("v")) == [("a/b",), ("(root)",)]
    assert column(spark, ["a/.env.dev", ".env", "x/application-prod.eu.yml", "application.yml"], K.profile_of_path("v")) == [("dev",), (None,), ("prod",), (None,)]
    assert column(spark, ["DB_PASSWORD", "a.Token", "plain", None, " "], K.is_sensitive("v")) == [(True,), (True,), (False,), (False,), (False,)]
    assert column(spark, ["<a href='x'>\"&"], K.html_escape("v")) == [("&lt;a href=&#39;x&#39;&gt;&quot;&amp;",)]
    assert column(spark, ["'x'", '"x y"', "'x", "x"], K.unquote("v")) == [("x",), ("x y",), ("'x",), ("x",)]
    assert column(spark, ["a # c", "'a # c'", "a#c"], K.strip_inline_comment("v")) == [("a",), ("'a # c'",), ("a#c",)]
    assert column(spark, ["--a.b=c=d", "-Dk=", "--x", "k=v"], K.argument_key("v"), K.argument_value("v")) == [("a.b", "c=d"), ("k", ""), (None, None), (None, None)]


@pytest.mark.parametrize("path,profile,kind,expected", [
    (".env.prod", None, "ENV", 90), ("a/application-dev.yml", "dev", "YAML", 80), ("a/application-dev.yml", None, "YAML", 10), ("application.yaml", None, "YAML", 70),
    ("bootstrap.yml", None, "YAML", 50), ("A.java", None, "JAVA", 30), ("x.xml", None, "XML", 10)])
def test_priority(spark, path, profile, kind, expected):
    row = spark.createDataFrame([(path, profile, kind)], "p string, f string, k string").select(K.priority("p", "f", "k")).first()
    assert row[0] == expected


def test_placeholders(spark):
    assert scan("x ${a:${b:-c}} ${d") == [{"key": "a", "default_value": "${b:-c}", "raw": "${a:${b:-c}}"}, {"key": "b", "default_value": "c", "raw": "${b:-c}"}]
    assert scan("${a.${x}:1}")[0] == {"key": "a.${x}", "default_value": "1", "raw": "${a.${x}:1}"}
    assert scan(None) == [] and scan("no") == []
    assert column(spark, ["${a:1}-${b}"], flat_placeholders(F.col("v"))) == [([("a", "1"), ("b", None)],)]
