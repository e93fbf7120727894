"""The scan: what is parsed how often, what fails alone, and the stages that can be replaced."""

import pytest

pytest.importorskip("yaml")

from pyspark.sql import functions as F  # noqa: E402

from factspan import cli  # noqa: E402
from factspan.operators import diff as D  # noqa: E402
from factspan.operators import findings as N  # noqa: E402
from factspan.plans import consumers, scan  # noqa: E402
from factspan.sources import detectors as R  # noqa: E402
from factspan.sources import files as FL  # noqa: E402
from factspan.sources import java as J  # noqa: E402
from factspan.sources import leaves as L  # noqa: E402

SMALL = {
    "src/main/resources/application.yml": "server:\n  port: 80\napi.token: t\n",
    "A.java": 'class A { @PropertySource("classpath:p.properties") void f() { x.setProperty("k", "v"); ConfigService.getConfig("ns").getProperty("ap", "d"); ConfigService.getConfig("id", "grp", 5); app.setDefaultProperties(m); } }',
    "src/main/resources/p.properties": "from.p=${IN_P:${DEEP:1}}\n",
    "broken.yml": "a: [1\n",
}


@pytest.fixture(scope="module")
def tree(spark):
    return FL.classified(spark.createDataFrame([("s", p, c) for p, c in SMALL.items()], "scan_id string, path string, content string"))


@pytest.fixture(scope="module")
def inventory(tree):
    return scan.Pipeline().scan(tree)


def nodes(frame, name):
    return frame._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_every_file_is_parsed_once(tree):
    """Readers are Python nodes of two tables; no plan over these has one of its own."""
    p = scan.Pipeline()
    parsed = p.parsed(tree)
    assert nodes(L.leaves(tree), "MapInPandas") == 1 and nodes(J.invocation_rows(tree), "MapInPandas") == 1
    found, uncertain = J.java_entries(tree, rows=parsed["invocations"], scalars=parsed["scalars"])
    for frame in (found, uncertain, R.resource_entries(tree, None, parsed["scalars"]), R.parse_diagnostics(**{"scalars": parsed["scalars"], "invocations": parsed["invocations"]})):
        assert nodes(frame, "MapInPandas") == 0


def test_java_failures_are_reported(spark, tree):
    rows = spark.createDataFrame([("s", "B.java", "MAIN", 0, None, None, "error", "", [], None, "RecursionError: deep")], J.INVOCATIONS)
    got = R.parse_diagnostics(L.leaves(tree), rows).collect()
    assert {(r["component_id"], r["message"].split(":")[0]) for r in got} == {("leaves", "broken.yml"), ("java-source-config", "B.java")}


def test_details_of_java_reads(inventory):
    rows = {r["key"]: r for r in inventory.items.collect()}
    assert rows["ap"]["details"]["namespace"] == "ns" and rows["ap"]["details"]["default_value"] == "d"
    assert (rows["nacos.config.id"]["details"]["group"], rows["nacos.config.id"]["details"]["data_id"]) == ("grp", "id")
    assert rows["from.p"]["source"]["path"].endswith("p.properties") and rows["IN_P"]["details"]["raw_expression"] == "classpath:p.properties" and "DEEP" not in rows
    assert [(r["expression"], r["reason"]) for r in inventory.uncertain.collect()] == [("m", "MAP_DRIVEN_KEY")]


def test_stages_can_be_replaced(spark, tree):
    def own(files, context):
        assert {"scalars", "invocations"} <= set(context)
        return R.findings(R.entries(files.where("name = 'A.java'").select("scan_id", "path", "scope", F.lit("packed.key").alias("key"), F.lit(str(context["mark"])).alias("raw")), "java-source-config"))

    def provider(rows):
        return R.entries(rows.limit(1).select("scan_id", "path", "scope", F.lit("provided").alias("key")), "codegraph-config-usage", "READ")

    def audited(inv):
        check = N.sensitive_checks(inv.items.where("key = 'packed.key'").withColumn("normalized_key", F.lit("token")), "audited: ")
        return N.replace(inv, checks=inv.checks.unionByName(check))

    p = scan.Pipeline().pack(scan.Pack({"own": own}, {"mark": 7})).usage_provider(provider).enricher(audited)
    p.normalized_by(lambda f: N.normalize(f).withColumn("region", F.lit("r")).drop("region")).built_by(lambda f, d, project: N.assemble(f, d, {"name": "built"}))
    inv = p.scan(tree)
    keys = {r["key"]: r["value"] for r in inv.items.select("key", "value").collect()}
    assert keys["packed.key"]["raw"] == "7" and "provided" in keys and inv.project["name"] == "built"
    messages = {r["message"] for r in inv.checks.collect()}
    assert "audited: packed.key" in messages and inv.summary.first()["checks"] == inv.checks.count()


def test_strategies(inventory):
    empty = inventory.items.where("false")
    assert D.STRATEGIES["key"](empty, inventory.items, inventory.uncertain, inventory.uncertain).added.count() > 0
    assert D.STRATEGIES["none"](empty, inventory.items, inventory.uncertain, inventory.uncertain).summary().first()["added"] == 0

    @D.strategy("swapped")
    def swapped(a, b, c, d):
        return D.diff(b, a, d, c)

    try:
        assert D.STRATEGIES["swapped"](empty, inventory.items, inventory.uncertain, inventory.uncertain).removed.count() > 0
    finally:
        del D.STRATEGIES["swapped"]


def test_sinks(spark, inventory, tmp_path):
    import yaml

    consumers.INVENTORY_CONSUMERS["yaml"](inventory, {}, str(tmp_path))
    doc = yaml.safe_load((tmp_path / "config-inventory.yaml").read_text())
    assert len(doc["items"]) == doc["summary"]["findings"] == inventory.items.count() and [d["componentId"] for d in doc["diagnostics"]] == ["leaves"]
    consumers.INVENTORY_CONSUMERS["html"](inventory, {}, str(tmp_path))
    page = (tmp_path / "report.html").read_text()
    assert page.count("<details>") == page.count("</details>") == inventory.items.select("normalized_key").distinct().count() and "conic-gradient" in page and "class=bar" in page
    consumers.INVENTORY_CONSUMERS["manifest"](inventory, {"api-version": "a/v9", "kind": "K"}, str(tmp_path))
    head = yaml.safe_load((tmp_path / "app-configs.yaml").read_text())
    assert (head["apiVersion"], head["kind"]) == ("a/v9", "K")
    consumers.INVENTORY_CONSUMERS["snapshot"](inventory, {}, str(tmp_path / "snap"))
    assert cli.main(["export", "--inventory", str(tmp_path / "snap"), "-o", str(tmp_path / "e.yaml"), "--missing", str(tmp_path / "m.yaml")], spark) == 0
    assert "server.port" in (tmp_path / "e.yaml").read_text() and cli.main(["diff", "--base", str(tmp_path / "snap"), "--head", str(tmp_path / "snap"), "--strategy", "nope"], spark) == 2


def test_lines_are_found_in_one_pass():
    lines = ["a:", "b: 1", "x.y=2", "long" * 1000 + ": 1", "b: 3"]
    assert L.lines_of(lines, ["a.b", "x.y", "none", "b[0]", "a"]) == [2, 3, None, 2, 1]


def test_pruned_folders(spark, tmp_path):
    for p in ("venv/a.properties", ".next/a.yml", "vendor/a.yml", "logs/a.yml", "tmp/a.yml", "src/a.yml"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("a: 1\n")
    assert FL.listed(spark, str(tmp_path)) == ["logs/a.yml", "src/a.yml", "tmp/a.yml", "vendor/a.yml"]
