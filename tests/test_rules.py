"""Rules that join by equal keys: the same rows as the plain condition, and no nested loops however many rules there are."""

import random
import re

from pyspark.sql import functions as F

from factspan.operators import rules as R
from factspan.schema import ANNOTATION_RULES, FILE_RULES, METHOD_RULES


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def glob(pattern):
    out = re.escape(pattern).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return re.compile(f"^{out}$")


def test_suffix_rules_against_all_pairs(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abc.") for _ in range(rng.randint(1, 6)))
    calls = [(i, word(), word()) for i in range(200)] + [(900, "a", None), (901, None, "abc")]
    table = [(f"r{i}", rng.choice([None, "", word()[:2]]), word()[:3], 0, -1, -1, None, None) for i in range(60)] + [("all", None, "", 0, -1, -1, None, None)]
    got = R.match_methods(spark.createDataFrame(calls, "id int, owner string, method string"), spark.createDataFrame(table, METHOD_RULES)).select("id", "rule_id").collect()
    want = {(i, r[0]) for i, o, m in calls if m is not None for r in table if m.endswith(r[2]) and (not r[1] or o is not None and r[1] in o)}
    assert sorted(map(tuple, got)) == sorted(want)
    notes = [(f"a{i}", word()[:3], None, None, None, None, None) for i in range(40)]
    got = R.match_annotations(spark.createDataFrame([(i, m) for i, _, m in calls], "id int, annotation string"), spark.createDataFrame(notes, ANNOTATION_RULES)).select("id", "rule_id").collect()
    assert sorted(map(tuple, got)) == sorted((i, n[0]) for i, _, m in calls if m is not None for n in notes if m.endswith(n[1]))


def test_globs_against_all_pairs(spark):
    rng = random.Random(2)
    part = lambda: rng.choice(["a", "b", "conf", "x.yml", "y.xml", "app-1.yml", "z+[1].yml"])
    paths = sorted({"/".join(part() for _ in range(rng.randint(1, 4))) for _ in range(150)})
    patterns = ["**", "*", "**/*.yml", "conf/**", "conf/*.xml", "a/**/x.yml", "**/app-?.yml", "**/z+[1].yml", "b/*/*", "x.yml", "**/*", "a*/x.yml", "?/x.yml"]
    for _ in range(3):
        order = rng.sample(patterns, rng.randint(1, len(patterns)))
        table = [(f"r{k}", p, None, None, k) for k, p in enumerate(order)]
        got = {r["path"]: r["rule_id"] for r in R.first_glob(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(table, FILE_RULES)).collect()}
        want = {p: next(f"r{k}" for k, g in enumerate(order) if glob(g).match(p)) for p in paths if any(glob(g).match(p) for g in order)}
        assert got == want


def test_no_nested_loops(spark):
    many = spark.range(100_000)
    methods = many.select(F.concat(F.lit("m"), "id").alias("id"), F.lit(None).cast("string").alias("owner"), F.concat(F.lit("get"), "id").alias("method"), F.lit(0).alias("key_arg"))
    calls = spark.range(1000).select("id", F.lit("o").alias("owner"), F.concat(F.lit("Center.get"), F.col("id") * 3).alias("method"))
    met = R.match_methods(calls, methods)
    files = spark.range(1000).select(F.concat(F.lit("src/p"), F.col("id") % 50, F.lit("/f"), "id", F.lit(".yml")).alias("path"))
    globs = many.select(F.concat(F.lit("g"), "id").alias("id"), F.concat(F.lit("src/p"), "id", F.lit("/**/*.yml")).alias("pattern"), F.lit(None).cast("string").alias("format"), F.lit(None).cast("string").alias("scope"), F.col("id").cast("int").alias("rule_order"))
    first = R.first_glob(files, globs)
    assert "NestedLoop" not in plan_of(met) + plan_of(first) and "Cartesian" not in plan_of(met) + plan_of(first)
    assert {r["id"]: r["rule_id"] for r in met.where("rule_id = concat('m', id * 3)").select("id", "rule_id").collect()} == {i: f"m{i * 3}" for i in range(1000)}
    assert {r["path"].split("/")[1]: r["rule_id"] for r in first.collect()} == {f"p{i}": f"g{i}" for i in range(50)}
