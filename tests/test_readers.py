"""Trees, versions and documents read by tasks, and the readers of HOCON, XML, metadata and Java names."""

import os
import random
import subprocess

import pytest

pytest.importorskip("yaml")

from pyspark.sql import functions as F  # noqa: E402

from factspan.plans import scan  # noqa: E402
from factspan.sources import detectors as D  # noqa: E402
from factspan.sources import files as FL  # noqa: E402
from factspan.sources import git as G  # noqa: E402
from factspan.sources import inventory as V  # noqa: E402
from factspan.sources import java as J  # noqa: E402
from factspan.sources import leaves as L  # noqa: E402
from factspan.sources import tree as T  # noqa: E402


def classified(spark, **texts):
    return FL.classified(spark.createDataFrame([("s", p, c) for p, c in texts.items()], "scan_id string, path string, content string"))


# Trees


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("it's [a] tree")
    names = ["conf[1].yml", "a b.properties", "q'uote.yml", "x{1}.yml", "st*r.yml", "wh?t.yml", ".env", ".github/w.yml", "_config/c.yml", f"m2{top}/conf/application.yml", "conf/application.yml",
             "bad.yml", "bin.png", "src/test/x.yml", "node_modules/x.yml", "mount/user.name"]
    for n in names:
        (top / n).parent.mkdir(parents=True, exist_ok=True)
        (top / n).write_bytes(b"a: \xff" if n == "bad.yml" else b"bob\n" if n == "mount/user.name" else b"a: 1")
    (top / "bootstrap.properties").write_text("spring.config.import=configtree:mount/\n")
    os.symlink(top, top / "loop")
    return top, [n for n in names if not n.startswith(("node_modules", "src/test"))] + ["bootstrap.properties"]


def test_tree_of_awkward_names(spark, root):
    top, names = root
    rows = {r["path"]: r for r in FL.read_tree(spark, str(top)).collect()}
    assert set(rows) == set(names)
    assert rows["bad.yml"]["content"] == "a: �" and "byte 3" in rows["bad.yml"]["error"]
    assert rows["bin.png"]["content"] is None and all(r["content"] == "a: 1" for p, r in rows.items() if p.endswith(".yml") and p != "bad.yml")
    some = FL.read_tree(spark, f"file:{top}", include=[".github/", "conf"], exclude=["conf/application.yml"])
    assert [r["path"] for r in some.collect()] == [".github/w.yml"]
    with pytest.raises(NotADirectoryError):
        FL.read_tree(spark, str(top / "none"))


def test_filters_reach_the_source(spark, root):
    got = FL.read_tree(spark, str(root[0])).where(F.col("path").startswith("conf") & F.col("file_type").isin("YAML", "JAVA"))
    assert "StartsWith" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["path"] for r in got.collect()) == ["conf/application.yml", "conf[1].yml"]
    reader = T.TreeReader({"path": str(root[0])})
    reader.starts = ["conf/"]
    assert reader.entered("conf") and not reader.entered("src") and not reader.entered("node_modules")


def test_folders_are_dealt_to_tasks(tmp_path, monkeypatch):
    """Few folders are opened to plan; every file is in one part, however a folder's files are shared."""
    for k in range(300):
        p = tmp_path / f"d{k % 40}/e{k % 3}/f{k}.yml"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("")
    monkeypatch.setattr(T, "PARTS", 20)
    monkeypatch.setattr(T, "FILES_A_PART", 2)
    opened, entries = [], T.Files.entries
    monkeypatch.setattr(T.Files, "entries", lambda self, folder: opened.append(folder) or entries(self, folder))
    reader = T.TreeReader({"path": str(tmp_path)})
    parts = reader.partitions()
    assert len(opened) < 10 and len(parts) >= 20
    found = [p for part in parts for p in reader.found(T.Files(str(tmp_path)), part)]
    assert len(found) == len(set(found)) == 300
    flat = T.TreeReader({"path": str(tmp_path / "d1/e1")})
    assert len(flat.partitions()) > 1 and sum(len(list(flat.found(T.Files(flat.root), p))) for p in flat.partitions()) == len(os.listdir(flat.root))


def test_config_trees_are_read_where_they_lie(spark, root):
    tree = FL.read_tree(spark, str(root[0]))
    p = scan.Pipeline()
    inv = p.scan(tree)
    rows = {r["key"]: r for r in inv.items.collect()}
    assert (rows["user.name"]["value"]["raw"], rows["user.name"]["source"]["line"], rows["user.name"]["source"]["source_kind"]) == ("bob", 1, "PROPERTIES")
    assert {r["component_id"] for r in inv.diagnostics.collect()} == {"files"}
    phases = {name: rows for name, _, rows in p.metrics}
    assert {"file-indexing", "detector-execution", "finding-processing", "normalization", "inventory-building", "enrichment", "detector:resources", "detector:java"} <= set(phases)
    assert phases["file-indexing"] == len(root[1]) and phases["detector:java"] == 0 and phases["normalization"] == phases["detector:resources"] == inv.items.count()


# Versions


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    repo = tmp_path_factory.mktemp("repo")
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    for name, text in {"same.yml": "a: 1\n", "b c.yml": "x: 1\n", "gone.yml": "g: 1\n", "A.java": "class A {}", "target/no.yml": "n: 1\n", "pic.png": "p"}.items():
        (repo / name).parent.mkdir(exist_ok=True)
        (repo / name).write_text(text)
    os.symlink("same.yml", repo / "link.yml")
    git("add", "-Af")
    git("commit", "-qm", "one")
    (repo / "b c.yml").write_text("x: 2\n")
    (repo / "gone.yml").unlink()
    git("add", "-A")
    git("commit", "-qm", "two")
    return str(repo)


def test_versions_share_files(spark, repository):
    tree = G.read_versions(spark, repository, {"base": "HEAD~1", "head": "HEAD"})
    rows = sorted((r["path"], r["scan_id"].split("\u0001"), r["content"]) for r in tree.collect())
    assert rows == [("A.java", ["base", "head"], "class A {}"), ("b c.yml", ["base"], "x: 1\n"), ("b c.yml", ["head"], "x: 2\n"), ("gone.yml", ["base"], "g: 1\n"), ("pic.png", ["base", "head"], None), ("same.yml", ["base", "head"], "a: 1\n")]
    scalars = scan.Pipeline().parsed(tree)["scalars"]
    assert sorted((r["scan_id"], r["path"], r["value"]) for r in scalars.collect()) == [
        ("base", "b c.yml", "1"), ("base", "gone.yml", "1"), ("base", "same.yml", "1"), ("head", "b c.yml", "2"), ("head", "same.yml", "1")]
    assert sorted(r["path"] for r in G.changed_files(spark, repository, "HEAD~1", "HEAD").collect()) == ["b c.yml", "gone.yml"]
    assert [r["t"] for r in tree.where("path = 'pic.png'").select(T.contents(F.col("location")).alias("t")).collect()] == ["p"]
    with pytest.raises(G.GitError):
        G.read_versions(spark, repository, {"x": "no-such-ref"})


# Documents


@pytest.mark.parametrize("width", [40, 1 << 20])
def test_documents_in_ranges(spark, tmp_path, monkeypatch, width):
    import yaml

    rng = random.Random(3)
    text = lambda: rng.choice(["x", "- no item", "items:\n- none\n", "line\n  - deep\nlast", "long " * 40, "ü: é", ""])
    items = [{"key": f"k{i}", "normalizedKey": f"k{i}", "role": "define", "value": {"raw": text(), "type": "STRING"}, "source": {"path": text(), "line": i}, "other": [text(), text()]} for i in range(60)]
    whole = {"schemaVersion": "config-inventory/v1", "project": {"name": "p", "ref": "r"}, "items": items, "uncertain": [{"expression": text(), "reason": "UNKNOWN"}], "checks": [], "diagnostics": [{"severity": "error", "message": text()}]}
    monkeypatch.setattr(V, "RANGE", width if width > 100 else 700)
    facts = lambda inv: [sorted(map(str, f.drop("ordinal").collect())) for f in (inv.items, inv.uncertain, inv.checks, inv.diagnostics)]
    forms = {"block": V.dump(whole), "flow": yaml.safe_dump(whole, default_flow_style=True), "indented": V.dump({k: v for k, v in whole.items() if k != "items"}) + "items:\n# note\n" + "".join("  " + line for line in V.dump(items).splitlines(True))}
    for name, form in forms.items():
        path = tmp_path / f"{name}.yaml"
        path.write_text(form, encoding="utf-8")
        got, want = V.read_document_file(spark, str(path), "s"), V.read_document(spark, form, "s")
        assert facts(got) == facts(want) and got.project == want.project
        assert [r["key"] for r in got.items.orderBy("ordinal").collect()] == [i["key"] for i in items]


# HOCON, XML, metadata


def slow_hocon(text):
    """Lines outside blocks and their pairs, one after the other."""
    out, depth = {}, 0
    for n, line in enumerate(text.split("\n"), 1):
        s = line.strip()
        if depth > 0 or s.endswith("{"):
            depth += s.count("{") - s.count("}")
            continue
        cut = min((i for i in (s.find("="), s.find(":")) if i >= 0), default=-1)
        if s and not s.startswith(("#", "//")) and cut > 0:
            key, value = s[:cut].strip(), s[cut + 1:].strip()
            bare = lambda x: x[1:-1] if len(x) > 1 and x[0] == x[-1] == '"' else x
            if key and " " not in key and value:
                out[n] = (bare(key), bare(value))
    return out


def test_hocon(spark):
    given = 'url = ${HOST}\nb = "x-${Y}"\nblk {\n  c = "}"\n  d { e = 1 }\n}\nf = "{"\n"q k" = 1\n"qk" : v=w\nempty =\nlist = [ {\na = 1\n} ]\ng : {a: 1}\nh = 1 # kept\n  //no = 1\n#no=1\n} extra = 1\ni += 2\n = 3\nj = \\u0020'
    rng = random.Random(4)
    texts = [given] + ["\n".join(rng.choice(["a = 1", "b {", "}", "c = ${X}", "d : {x}", "{", "}}", "e = {", "# {", "f"]) for _ in range(12)) for _ in range(60)]
    files = FL.classified(spark.createDataFrame([(str(i), "application.conf", t) for i, t in enumerate(texts)], "scan_id string, path string, content string"))
    got = {}
    for r in D.hocon_files(files).collect():
        got.setdefault(int(r["scan_id"]), {})[r["line"]] = (r["key"], r["raw"])
    assert {i: h for i, t in enumerate(texts) if (h := slow_hocon(t))} == got
    assert got[0][1] == ("url", "${HOST}") and got[0][2] == ("b", "x-${Y}")
    row = D.findings(D.hocon_files(files.where("scan_id = '0'"))).where("key = 'url'").first()
    assert (row["confidence"], row["source"]["source_kind"], row["details"]["type"], row["details"]["reason"], row["details"]["raw_text"]) == ("MEDIUM", "UNKNOWN", "unknown", "hocon-config-file", "url")


def test_xml_placeholders(spark):
    body = '<a><!-- ${c:1} --><b x="${attr:${in:2}}">${text}</b>${tail:-t}</a>'
    files = classified(spark, **{"w/web.xml": body, "x/logback.xml": body, "src/main/resources/any.xml": body, "src/main/other/any.xml": body, "y/log4j2.xml": "<broken>${k}", "z/main/resources/u.xml": "${open ${x"})
    got = {}
    for r in D.xml_placeholders(files).collect():
        got.setdefault(r["path"], set()).add((r["key"], r["default_raw"], r["extra"]))
    want = {("c", "1", "c:1"), ("attr", "${in:2}", "attr:${in:2}"), ("in", "2", "in:2"), ("text", None, "text"), ("tail", "t", "tail:-t")}
    assert got == {"w/web.xml": want, "x/logback.xml": want, "src/main/resources/any.xml": want, "y/log4j2.xml": {("k", None, "k")}}


def test_metadata_types(spark):
    name = "spring-configuration-metadata.json"
    values = [("java.lang.String", '"5"', "STRING"), ("com.acme.Duration", '"1s"', "STRING"), ("java.time.Duration", '"1s"', "DURATION"), ("x", "5", "INTEGER"), ("x", "true", "BOOLEAN"), ("boolean", '"yes"', "BOOLEAN"),
              ("long", '"7"', "INTEGER"), ("x", "1.5", "STRING"), ("x", "[1]", "STRING"), ("x", "null", None)]
    doc = '{"properties": [' + ", ".join(f'{{"name": "p{i}", "type": "{t}", "defaultValue": {v}}}' for i, (t, v, _) in enumerate(values)) + ', {"type": "x"}, {"name": " "}, 3, {"name": "bare"}]}'
    files = classified(spark, **{f"a/{name}": doc, f"b/{name}": "{broken", f"c/{name}": '{"properties": 1}', f"d/{name}": "[]"})
    rows = {r["key"]: r for r in D.findings(D.metadata_files(files)).collect()}
    assert {k: r["default_value"] and r["default_value"]["type"] for k, r in rows.items()} == {f"p{i}": t for i, (_, _, t) in enumerate(values)} | {"bare": None}
    assert rows["p8"]["default_value"]["raw"] == "" and rows["p3"]["details"]["reason"] == "spring-configuration-metadata"
    faults = D.parse_diagnostics(L.leaves(files), None, files).collect()
    assert [(r["component_id"], r["message"].split(":")[0]) for r in faults] == [("spring-configuration-metadata", f"b/{name}")]


def test_resource_plan_is_small(spark):
    """The plan over all detectors names what it reads a bounded number of times."""
    files = classified(spark, **{"application.yml": "a: ${B:1}\n", ".env": "A=1\n"})
    plan = D.resource_entries(files, None, scan.Pipeline().parsed(files)["scalars"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") <= 30


def test_java_plan_is_small(spark):
    """All kinds of reading are one pass over the invocations; placeholders and property files are others."""
    files = classified(spark, **{"A.java": "class A {}"})
    parsed = scan.Pipeline().parsed(files)
    found, uncertain = J.java_entries(files, rows=parsed["invocations"], scalars=parsed["scalars"])
    counts = [f._jdf.queryExecution().optimizedPlan().toString().count("Relation ") for f in (found, uncertain)]
    assert counts[0] <= 10 and counts[1] == 1


def test_calls_without_arguments(spark):
    text = "class A { void f() { new ResourcePropertySource(); new MapPropertySource(); app.setDefaultProperties(); SpringApplication.run(); env.getProperty(); ConfigService.getConfig(); System.console().readLine(); } @Value @ConditionalOnProperty @Profile @PropertySource int x; }"
    found, uncertain = J.java_entries(classified(spark, **{"A.java": text}))
    assert found.count() == 0 and [r["reason"] for r in uncertain.collect()] == ["USER_INPUT"]


# Java names


def reads(text):
    return [(symbol, form, name, [a["literal"] for a in args]) for _, symbol, form, name, args, _ in J.invocations(text) if form in ("call", "new")]


def test_constants_by_class():
    text = """package com.acme;
class P { static final String K = "p.k"; static final String ONLY = "only." + K; class In { static final String K = "in.k"; void f() { get(K); get(P.K); get(P.In.K); get(com.acme.P.K); } } void g() { get(K); get(In.K); get(ONLY); } }
class Q { static final String K = "q.k"; static final int N = 3; void f() { get(K); get(P.K); get(X.K); get(com.other.P.K); get(K + "." + P.K); get(ONLY); get(this.K); get(LATE); run(new Runnable() { void r() { get(K); } }); after(K); } static final String LATE = "late"; }
"""
    got = reads(text)
    assert [(s, a[0]) for s, _, n, a in got if n == "get"] == [
        ("In", "in.k"), ("In", "p.k"), ("In", "in.k"), ("In", "p.k"), ("P", "p.k"), ("P", "in.k"), ("P", "only.p.k"),
        ("Q", "q.k"), ("Q", "p.k"), ("Q", None), ("Q", None), ("Q", "q.k.p.k"), ("Q", "only.p.k"), ("Q", None), ("Q", "late"), ("", "q.k")]
    assert ("Q", "call", "after", ["q.k"]) in got


def test_symbols_reach_findings(spark):
    files = classified(spark, **{"A.java": 'class A { @Value("${v}") String s; static class B { void f(String n) { System.getProperty("k"); System.getProperty("a" + n); } } }'})
    found, uncertain = J.java_entries(files)
    items = D.findings(found)
    assert {r["key"]: r["source"]["symbol"] for r in items.collect()} == {"v": "A", "k": "B"}
    assert [r["source"]["symbol"] for r in J.uncertain_findings(uncertain, items).collect()] == ["B"]


def test_annotations_by_full_name(spark):
    texts = {
        "one/Meta.java": 'package one; @Value("${one.key}") public @interface Meta {}', "two/Meta.java": 'package two; @Value("${two.key}") public @interface Meta {}',
        "A.java": "package a; import one.Meta; class A { @Meta String s; }", "B.java": "package b; import two.*; class B { @Meta String s; }", "C.java": "package one; class C { @Meta String s; }",
        "D.java": "package d; class D { @two.Meta String s; }", "E.java": "package e; class E { @Meta String s; }", "F.java": 'package f; class F { @Value("${in.key}") @interface Meta {} @Meta String s; @F.Meta String t; }',
        "G.java": "package g; @one.Meta @interface Over {} class H { @Over String s; }", "I.java": "package i; import f.F; class I { @F.Meta String s; }"}
    rows = J.invocation_rows(classified(spark, **texts))
    got = sorted((r["path"], r["key"], r["symbol"]) for r in J.meta_annotation_entries(rows).collect())
    one = [("A.java", "one.key", "A"), ("B.java", "two.key", "B"), ("C.java", "one.key", "C"), ("D.java", "two.key", "D"), ("F.java", "in.key", "F"), ("F.java", "in.key", "F"), ("G.java", "one.key", "Over"), ("I.java", "in.key", "I")]
    assert got == one
    deep = sorted((r["path"], r["key"], r["symbol"]) for r in J.meta_annotation_entries(rows, layers=5).collect())
    assert deep == sorted([*one, ("G.java", "one.key", "H")])
    other = rows.withColumn("scan_id", F.when(F.col("path") == "A.java", "other").otherwise(F.col("scan_id")))
    assert "A.java" not in {r["path"] for r in J.meta_annotation_entries(other).collect()}
