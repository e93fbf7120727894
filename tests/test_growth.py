"""Plans whose work must grow with the tables: dealt over tasks, and no side that grows is broadcast."""

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__  # noqa: E402,F401
from factspan.plans import reader_queries as RQ  # noqa: E402
from factspan.plans import source_queries as SQ  # noqa: E402
from factspan.sources import detectors as R  # noqa: E402
from factspan.sources import java as J  # noqa: E402

DATA = "/root/testdata/sf0.01"


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_files_of_one_row_group_are_dealt_to_tasks(spark):
    assert spark.read.parquet(f"{DATA}/events.parquet").rdd.getNumPartitions() == 1
    files = SQ._files(spark, DATA, *SQ._JAVA)
    assert files.rdd.getNumPartitions() == 4 and files.count() == 10_000
    assert RQ._texts(spark, DATA, "'a'", "HOCON", "'b'").rdd.getNumPartitions() == 4


def test_arguments_leave_python_as_one_text(spark):
    rows = J.invocation_rows(SQ._files(spark, "/root/testdata/sf0.001", *SQ._JAVA))
    assert "from_json" in plan(rows).lower() or "jsontostructs" in plan(rows).lower()
    row = rows.where("name = 'System.getProperty'").orderBy("scan_id", "seq").first()
    assert row["args"][0]["literal"] == "my.key" and row["args"][0]["concat"] is False and row["args"][1]["name"] is None


def test_full_names_broadcast_no_side(spark):
    rows = SQ.written(J.invocation_rows(SQ._files(spark, "/root/testdata/sf0.001", *RQ._NAMES)), "rows")
    text = plan(J.meta_annotation_entries(rows))
    assert "BroadcastHashJoin" not in text and text.count("SortMergeJoin") >= 7


def test_imports_broadcast_no_side(spark):
    files = SQ._files(spark, "/root/testdata/sf0.001", *SQ._CHAIN)
    scalars = SQ._scalars(files)
    assert "BroadcastHashJoin" not in plan(R.imports(R.application_files(scalars), files, scalars))


def test_rows_of_one_name_meet_a_rule_under_many_keys(spark):
    from factspan.operators.rules import NAME_SALTS, match_annotations
    from factspan.schema import ANNOTATION_RULES

    uses = spark.range(1000).selectExpr("cast(id as string) as scan_id", "'R.java' as path", "'My' as annotation")
    met = match_annotations(uses, spark.createDataFrame([("a", "My", "key", None, None, None, None)], ANNOTATION_RULES))
    assert met.count() == 1000 and "_salt" not in met.columns and f"({NAME_SALTS} - 1)" not in met.columns
    assert "_salt" in plan(met)


def test_lines_of_dockerfiles_need_no_window(spark):
    text = "FROM x\n ENV A=1 \\\n  B=2\n#ENV no=1\n\\\nENV C 3\nENV\nCMD [\"-Dd=4\"]\n"
    files = spark.createDataFrame([("s", "Dockerfile", "Dockerfile", "DOCKERFILE", "MAIN", text)], "scan_id string, path string, name string, file_type string, scope string, content string")
    found = R.dockerfiles(files)
    assert "Window" not in plan(found) and "Exchange" not in plan(found)
    assert sorted((r["line"], r["key"], r["raw"]) for r in found.collect()) == [(2, "A", "1"), (2, "B", "2"), (5, "C", "3"), (8, "d", "4")]


def test_kubernetes_documents_meet_their_heads_once(spark):
    scalars = SQ._scalars(SQ._files(spark, "/root/testdata/sf0.001", *[(SQ._KUBE, "YAML", "apiVersion: v1\nkind: ConfigMap\nmetadata: {name: m}\ndata: {a: «k»}\n")]))
    found = R.kubernetes_files(scalars)
    assert "apiVersion" not in plan(found) and found.count() == 1000


def test_bits_of_a_sketch_are_summed_by_all_tasks_at_once(spark, monkeypatch):
    from factspan.llm import collocations

    def jobs(wide):
        for name in ("NARROWEST", "WIDEST"):
            monkeypatch.setattr(collocations, name, wide)
        spark.sparkContext.setJobGroup(f"sketch-{wide}", "bits")
        rows = spark.createDataFrame([("en", "a b c d e " * 200)], "lang string, text string")
        found = {(r["size"], r["phrase"], r["n"]) for r in collocations.frequencies(rows).collect()}
        spark.sparkContext.setJobGroup("", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"sketch-{wide}")), found

    few, many = jobs(1 << 16), jobs(1 << 23)
    assert many[0] <= few[0] + 5 and many[1] == few[1] and (5, "b c d e a", 199) in many[1]


def test_counts_of_phrases_leave_a_task_packed(monkeypatch):
    import pyarrow as pa

    from factspan.llm import collocations

    sums, got = collocations.Sums(), {}
    monkeypatch.setattr(collocations, "HELD", 100)
    for i in range(50):
        sums.add(pa.repeat("en", 60), pa.array([1] * 60, pa.int32()), pa.array([f"w{i // 10}-{k}" for k in range(60)]), pa.array([2] * 60, pa.int64()))
    rows = [r for b in sums.out(4) for r in b.to_pylist()]
    for r in rows:
        for phrase, n in zip(r["phrases"], r["counts"]):
            assert phrase not in got
            got[phrase] = n
    assert len(rows) <= 4 and len(got) == 300 and set(got.values()) == {20} and sums.n == 0


def test_scalars_leave_python_as_arrow_columns(spark):
    texts = [("a.yml", "YAML", "a: [1, ~]\nb: {c: TRUE}\n"), ("a.properties", "PROPERTIES", "k[0]=v\n"), ("a.xml", "XML", "<a b='c'/>"), ("bad.yml", "YAML", "a: ]"), ("none.yml", "YAML", None)]
    files = spark.createDataFrame([("s", p, p, k, "MAIN", t) for p, k, t in texts], "scan_id string, path string, name string, file_type string, scope string, content string")
    found = SQ.leaves(files)
    assert "MapInArrow" in plan(found) and "MapInPandas" not in plan(found)
    rows = {(r["path"], tuple(r["segs"]), r["value"], r["line"]) for r in found.where("error is null").collect()}
    assert rows == {("a.yml", ("a", "[0]"), "1", 1), ("a.yml", ("a", "[1]"), None, 1), ("a.yml", ("b", "c"), "true", None), ("a.properties", ("k[0]",), "v", 1), ("a.xml", ("a[0]", "@b"), "c", None)}
    assert [r["path"] for r in found.where("error is not null").collect()] == ["bad.yml"]


def test_files_meet_nothing_where_nothing_is_imported(spark):
    files = SQ._files(spark, "/root/testdata/sf0.001", (".env", "ENV", "A=«k»\n"))
    found = R.imports(R.environment_files(files), files)
    assert "Join" not in plan(found) and found.count() == 0


def test_a_bag_is_counted_in_as_many_tasks_as_files_are_dealt_to(spark):
    found = RQ.detectors_as_a_bag(spark, DATA)
    assert "REPARTITION_BY_NUM" in plan(found)


def test_conditions_of_java_kinds_are_compiled(spark):
    """Names and forms are looked at by compiled code; functions over arrays see the invocations that meet a kind."""
    rows = SQ.written(J.invocation_rows(SQ._files(spark, "/root/testdata/sf0.001", *SQ._JAVA)), "rows")
    for frame in (J.invocation_entries(rows), J.uncertain_rows(rows)):
        assert re.search(r"\*\(\d+\) Project \[[^\n]* AS met#", plan(frame))
    assert "filter(" not in str(J._rule()) and "exists(" in plan(J._sourced(rows, None, None))


def test_tokens_are_told_from_lines_as_from_the_whole_text():
    text = 'class A { // c "x"\n  String s = "a\\"//b"; char c = \'"\';\n\n  void f() { g("é", 5L); } }\n'
    tokens, lines = J._lex(text)
    assert (tokens, lines) == J._lex(text + "/* end\n */") and tokens[-4:] == [")", ";", "}", "}"] and lines[-1] == 4 and 'g' in tokens and "//" not in "".join(tokens[:3])
    blocks = J._lex('a("""\n   x\n    y""",\n/* m\n */ \'\\n\', b)')
    assert blocks[1] == [1, 1, 1, 3, 5, 5, 5, 5] and J._string(blocks[0][2]) == "x\n y"


def test_arguments_are_packed_without_nulls():
    import json

    args = next(J.invocations('x.f("a\\u00e9\\"", 5L, Map.of("k", "v", K, 1), p + "q", {})'))[4]
    packed = json.loads(J._packed(args))
    assert [a.get("value") for a in packed] == ['a\u00e9"', "5", None, None, None] and "literal" not in packed[1] and packed[2]["pairs"] == [{"key": "k", "value": "v"}]
    assert [(a["strings"], a["concat"]) for a in packed] == [(a["strings"], a["concat"]) for a in args] and J._packed([]) == "[]"


def test_any_entry_may_name_a_source_of_properties(spark):
    texts = [("A.java", "JAVA", 'class A { static final String K = "spring." + "property-source"; void f() { System.setProperty(K, "classpath:a.properties"); new ResourcePropertySource("file:b.properties"); System.setProperty("x", "file:c.properties"); } }'),
             ("src/main/resources/a.properties", "PROPERTIES", "in.a=1\n"), ("b.properties", "PROPERTIES", "in.b=2\n"), ("c.properties", "PROPERTIES", "in.c=3\n")]
    files = spark.createDataFrame([("s", p, p, k, "MAIN", t) for p, k, t in texts], "scan_id string, path string, name string, file_type string, scope string, content string")
    keys = {r["key"] for r in J.java_entries(files)[0].collect()}
    assert {"in.a", "in.b"} <= keys and "in.c" not in keys
