import subprocess
from pathlib import Path

import pytest

pytest.importorskip("yaml")

from factspan import cli  # noqa: E402
from factspan.plans.scan import Pipeline  # noqa: E402
from factspan.sources import detectors as D  # noqa: E402
from factspan.sources import files as FL  # noqa: E402
from factspan.sources import java as J  # noqa: E402
from factspan.sources import leaves as L  # noqa: E402

TREE = {
'src/main/resources/application.yml':'''server:
  port: 8080
  timeout: 30s
db:
  url: ${DB_URL:jdbc:${HOST:-local}/x}
  list: [a, b]
spring.config.import: optional:file:extra.properties, configtree:tree/
---
spring.config.activate.on-profile: prod
client.endpoint: https://x
''',
'extra.properties':'a.b = 1\nmulti = x\\\n   y\n',
'tree/user.name':'bob\n',
'.env.prod':'export API_KEY="s3"\nX=1 # c\n# no\nJAVA_TOOL_OPTIONS=-Dp.q=5 -Xmx1g\nSPRING_APPLICATION_JSON={a: {b: 2}}\n',
'broken.yml':'a: [1\n',
'Dockerfile':'FROM x\nENV A=1 B="two words" \\\n  C=3\nENV K v\nENV JAVA_OPTS="-Dd.e=7"\nENTRYPOINT ["java", "-Dz=1", "--server.port=9"]\n',
'docker-compose.yml':'services:\n  web:\n    environment:\n      A: "1"\n      B: true\n    command: ["--x.y=2"]\n  db:\n    environment:\n      - P=q\n',
'k8s/d.yaml':'''apiVersion: v1
kind: ConfigMap
metadata: {name: cm}
data: {app.mode: fast}
---
apiVersion: v1
kind: Secret
metadata: {name: sec}
data: {pw: aGk=}
stringData: {tok: t}
---
apiVersion: apps/v1
kind: Deployment
metadata: {name: d}
spec:
  template:
    spec:
      containers:
      - name: c
        env:
        - {name: E1, value: "5"}
        - name: E2
          valueFrom: {secretKeyRef: {name: sec, key: pw}}
        envFrom:
        - prefix: P_
          configMapRef: {name: cm}
        args: ["--k.l=m"]
      volumes:
      - name: v
        configMap: {name: cm, items: [{key: app.mode, path: p}]}
''',
'src/main/resources/logback-spring.xml':'<configuration><springProperty name="n" source="log.level" defaultValue="INFO"/><x y="${p.q:z}"/></configuration>',
'src/main/webapp/web.xml':'<web-app><context-param><param-name>cp</param-name><param-value>cv</param-value></context-param></web-app>',
'src/main/resources/application.conf':'a = 1\nblk {\n  c = 2\n}\nd: "x"\n',
'src/main/resources/META-INF/spring-configuration-metadata.json':'{"properties":[{"name":"m.n","type":"java.lang.Integer","defaultValue":3}]}',
'src/main/java/A.java':'''package x;
@Configuration @Profile({"p1","p2"})
@PropertySource("classpath:extra2.properties")
@ConditionalOnProperty(prefix = "feat", name = {"a", "b"}, havingValue = "true")
class A {
  static final String K = "my." + "key";
  @Value("${v.w:dd}") String s;
  @Value("#{environment['spel.key']}") String t;
  void f(String n) {
    System.getProperty(K, "def"); env.getProperty("typed", Integer.class, 5);
    System.setProperty("set.me", "v1"); System.getenv("HOME_X");
    System.getProperty("a." + n); System.getenv().getOrDefault("G", "h");
    SpringApplication.run(A.class, "--run.arg=1"); config.getString("cfg.k", "cd");
    app.setDefaultProperties(Map.of("dk", "dv")); ConfigService.getConfig("data.id", "grp", 5);
    // System.getProperty("comment")
    ConfigService.getAppConfig().getProperty("ap.k", "av"); new ResourcePropertySource("file:rp.properties");
  }
}
@Value("${meta.key}") @interface Meta {}
class B { @Meta String q; }
''',
'src/main/resources/extra2.properties':'from.src=1\n',
}


@pytest.fixture(scope="module")
def tree(spark):
    return FL.classified(spark.createDataFrame([("s", p, c) for p, c in TREE.items()], "scan_id string, path string, content string")).cache()


@pytest.fixture(scope="module")
def found(tree):
    return {(r["path"], r["role"], r["key"]): r for r in D.resource_entries(tree).collect()}


def test_application_files(found):
    app = "src/main/resources/application.yml"
    assert found[app, "DEFINE", "server.port"]["line"] == 2
    assert found[app, "DEFINE", "db.list[1]"]["raw"] == "b"
    assert found[app, "READ", "DB_URL"]["default_raw"] == "jdbc:${HOST:-local}/x" and found[app, "READ", "HOST"]["default_raw"] == "local"
    assert found[app, "DEFINE", "client.endpoint"]["profile"] == "prod" and found[app, "DEFINE", "server.port"]["profile"] is None
    assert found[app, "METADATA", "spring.config.import"]


def test_imports_and_config_tree(found):
    assert found["extra.properties", "DEFINE", "multi"]["raw"] == "xy"
    assert found["tree/user.name", "DEFINE", "user.name"]["raw"] == "bob"


def test_environment_files(found):
    assert found[".env.prod", "DEFINE", "API_KEY"]["raw"] == "s3" and found[".env.prod", "DEFINE", "X"]["raw"] == "1"
    assert found[".env.prod", "DEFINE", "p.q"]["raw"] == "5" and found[".env.prod", "DEFINE", "a.b"]["raw"] == "2"
    assert found[".env.prod", "DEFINE", "X"]["profile"] == "prod"


def test_deployment_files(found):
    docker = {k[2]: r["raw"] for k, r in found.items() if k[0] == "Dockerfile"}
    assert docker == {"A": "1", "B": "two words", "C": "3", "K": "v", "JAVA_OPTS": "-Dd.e=7", "d.e": "7", "z": "1", "server.port": "9"}
    compose = {k[2]: r["raw"] for k, r in found.items() if k[0] == "docker-compose.yml"}
    assert compose == {"A": "1", "B": "true", "P": "q", "x.y": "2"}
    kube = {k[2]: (k[1], r["raw"]) for k, r in found.items() if k[0] == "k8s/d.yaml"}
    assert kube == {
        "app.mode": ("DEFINE", "fast"), "tok": ("DEFINE", "t"), "E1": ("DEFINE", "5"), "E2": ("DEFINE", "sec:pw"), "P_app.mode": ("DEFINE", "fast"), "k.l": ("DEFINE", "m"),
        "kubernetes.secret.data.sec.pw": ("METADATA", "pw"), "kubernetes.env-from.config-map.cm": ("METADATA", "cm"), "kubernetes.volume.config-map.cm": ("METADATA", "cm"),
        "kubernetes.volume.config-map.cm.app.mode": ("METADATA", "app.mode")}


def test_other_resources(found):
    assert found["src/main/resources/logback-spring.xml", "READ", "log.level"]["default_raw"] == "INFO"
    assert found["src/main/resources/logback-spring.xml", "READ", "p.q"]["default_raw"] == "z"
    assert found["src/main/webapp/web.xml", "DEFINE", "cp"]["raw"] == "cv"
    assert {k[2]: r["raw"] for k, r in found.items() if k[0].endswith(".conf")} == {"a": "1", "d": "x"}
    assert found["src/main/resources/META-INF/spring-configuration-metadata.json", "READ", "m.n"]["default_raw"] == "3"


def test_java(tree):
    found, uncertain = J.java_entries(tree, meta=True)
    rows = {(r["role"], r["key"], r["raw"], r["default_raw"]) for r in found.collect()}
    assert {
        ("METADATA", "spring.profiles", "p1", None), ("METADATA", "spring.profiles", "p2", None), ("METADATA", "spring.property-source", "classpath:extra2.properties", None), ("DEFINE", "from.src", "1", None),
        ("CONDITION", "feat.a", None, "true"), ("CONDITION", "feat.b", None, "true"), ("READ", "v.w", None, "dd"), ("READ", "spel.key", None, None), ("READ", "my.key", None, "def"), ("READ", "typed", None, "5"),
        ("DEFINE", "set.me", "v1", None), ("READ", "HOME_X", None, None), ("READ", "G", None, "h"), ("DEFINE", "run.arg", "1", None), ("READ", "cfg.k", None, "cd"), ("DEFINE", "dk", "dv", None),
        ("METADATA", "nacos.config.data.id", None, None), ("READ", "ap.k", None, "av"), ("READ", "meta.key", None, None)} <= rows
    assert "comment" not in {r[1] for r in rows}
    assert [(r["expression"], r["reason"], r["root_sink"]) for r in uncertain.collect()] == [('"a." + n', "STRING_CONCAT", "System.getProperty")]


def test_user_rules(spark, tree):
    rows = J.invocation_rows(FL.classified(spark.createDataFrame([("s", "B.java", 'class B { @My(key = "k1", dflt = "d1") int x; void f() { Center.fetch("k2", "d2"); } }')], "scan_id string, path string, content string")))
    tables = J.rule_tables(spark, {"methodCalls": [{"id": "m", "owner": "Center", "method": "fetch", "keyArg": 0, "defaultArg": 1, "valueArg": -1}], "annotations": [{"id": "a", "type": "My", "keyAttribute": "key", "defaultAttribute": "dflt"}]})
    got = {(r["key"], r["default_raw"]) for r in J.user_rule_entries(rows, tables["method_rules"], tables["annotation_rules"]).collect()}
    assert got == {("k1", "d1"), ("k2", "d2")}


def test_parsers():
    assert L.properties("a=1\n# c\nb : x\\\n  y\nc\\ d = \\u0041\na=2\n") == {"a": "2", "b": "xy", "c d": "A"}
    assert list(L.yaml_leaves("a: {b: [1, ~]}\n---\nc: TRUE")) == [(0, ["a", "b", "[0]"], "1"), (0, ["a", "b", "[1]"], None), (1, ["c"], "true")]


def test_broken_files_are_reported_alone(spark, tree):
    inv = Pipeline().scan(tree)
    assert [r["message"].split(":")[0] for r in inv.diagnostics.collect()] == ["broken.yml"]
    s = inv.summary.first()
    assert s["diagnostics"] == 1 and s["uncertain"] == 1 and s["findings"] == inv.items.count()
    assert inv.items.where("ordinal is null").count() == 0


def test_failing_detector_leaves_the_others(spark, tree):
    def fail(tree, rules):
        raise RuntimeError("no")

    inv = Pipeline().detector("bad", fail).scan(tree)
    assert "bad" in {r["component_id"] for r in inv.diagnostics.collect()} and inv.items.count() > 50


def test_command_line(spark, tmp_path, capsys):
    repo = tmp_path / "repo"
    for p, c in TREE.items():
        (repo / p).parent.mkdir(parents=True, exist_ok=True)
        (repo / p).write_text(c)
    (repo / "node_modules").mkdir()
    (repo / "node_modules/application.yml").write_text("no: 1\n")
    run = lambda *a: cli.main(list(map(str, a)), spark)
    assert run("inventory", repo, "-o", tmp_path / "o1", "--metrics", tmp_path / "m.yaml") == 0
    import yaml
    doc = yaml.safe_load((tmp_path / "o1/config-inventory.yaml").read_text())
    keys = {i["key"] for i in doc["items"]}
    assert {"server.port", "API_KEY", "my.key"} <= keys and "no" not in keys and doc["summary"]["findings"] == len(doc["items"])
    assert yaml.safe_load((tmp_path / "m.yaml").read_text())["metrics"]
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "one")
    (repo / ".env.prod").write_text("X=2\nNEW_TOKEN=t\n")
    git("add", "-A")
    git("commit", "-qm", "two")
    assert run("config-diff", "--repo", repo, "--base-ref", "HEAD~1", "--head-ref", "HEAD", "-o", tmp_path / "o2", "--redact-sensitive") == 0
    d = yaml.safe_load((tmp_path / "o2/config-diff.yaml").read_text())
    assert [i["key"] for i in d["added"]] == ["NEW_TOKEN"] and d["added"][0]["value"]["raw"] == "******"
    assert {(c["key"], c["oldValue"], c["newValue"]) for c in d["changed"] if c["field"] == "value"} == {("x", "1", "2")}
    for consumer in ("manifest", "html", "default"):
        assert run("inventory", repo, "-o", tmp_path / consumer, "--consumer", consumer, "-Dname=n") == 0
    assert "s3" not in (tmp_path / "manifest/app-configs.yaml").read_text().split("secrets")[-1]
    assert run("diff", "--base", tmp_path / "o1/config-inventory.yaml", "--head", tmp_path / "o1/config-inventory.yaml", "-o", tmp_path / "o3", "--consumer", "manifest") == 0
    assert not list(Path(tmp_path / "o3").glob("*")) if (tmp_path / "o3").exists() else True
    assert run("export", "--inventory", tmp_path / "o1/config-inventory.yaml", "-o", tmp_path / "e.yaml", "--missing", tmp_path / "miss.yaml") == 0
    assert {r["config_key"] for r in yaml.safe_load((tmp_path / "miss.yaml").read_text())["app_configs"]} >= {"home-x"}
    assert run("inventory", repo, "--consumer", "nope") == 2 and run("inventory", tmp_path / "none") == 2 and run("diff", "--base", "none", "--head", "none") == 2


def test_imports_deeper_than_any_bound(spark):
    """A chain of 18 files, whose last one imports a folder and the first file again."""
    tree = {f"f{i}.properties": f"spring.config.import=f{i + 1}.properties\nk{i}=v\n" for i in range(18)}
    tree |= {"f18.properties": "spring.config.import=more/,f0.properties\n", "more/application.properties": "last=1\n", "more/other.properties": "no=1\n"}
    tree = {"application.properties": "spring.config.import=f0.properties\n", **tree}
    rows = [("s", p, p.rsplit("/", 1)[-1], "PROPERTIES", "RUNTIME", text) for p, text in tree.items()]
    files = spark.createDataFrame(rows, "scan_id string, path string, name string, file_type string, scope string, content string")
    found = D.application_files(L.leaves(files.where("path = 'application.properties'")))
    got = {r["key"] for r in D.imports(found, files).select("key").collect()}
    assert {f"k{i}" for i in range(18)} | {"last"} <= got and "no" not in got
