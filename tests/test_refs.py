"""References to usage rows: the rule table, fan-out, the lexical lane and binding."""

import pytest

from refscope.operators import refs

RULES = [
    ("UsingDirective", "Other", "Namespace", "UsingDirective"),
    ("UsingDirective", "Other", "NamedType", None),
    ("IdentifierName", "VariableDeclaration", "NamedType", "VariableDeclaration"),
    ("IdentifierName", "Invocation", "Method", "MethodInvocation"),
    ("IdentifierName", "MemberAccess", "Method", "PropertyAccess"),
    ("IdentifierName", "Other", "Method", "Direct"),
    ("IdentifierName", None, "Method", "Direct"),
    ("GenericName", "Other", "NamedType", "TypeReference"),
    ("TypeArgument", "Other", "NamedType", "GenericTypeArgument"),
    ("QualifiedName", "Other", "NamedType", "TypeReference"),
    ("MemberAccess", "Other", "Method", "MethodInvocation"),
    ("MemberAccess", "Other", "Property", "PropertyAccess"),
    ("MemberAccess", "Other", "Field", "FieldAccess"),
    ("MemberAccess", "Other", "Event", "EventReference"),
    ("MemberAccess", "Other", "NamedType", "Direct"),
    ("VariableDeclaration", "Other", "NamedType", "VariableDeclaration"),
    ("Parameter", "Other", "NamedType", "ParameterType"),
    ("MethodDeclaration", "Other", "NamedType", "ReturnType"),
    ("BaseList", "Other", "NamedType", "Inheritance"),
    ("AttributeList", "Other", "Method", "Attribute"),
    ("SomethingElse", "Other", "Method", None),
]


def test_rule_table(spark):
    rows = [(i, *r[:3]) for i, r in enumerate(RULES)]
    df = spark.createDataFrame(rows, "i int, node_kind string, parent_kind string, symbol_kind string")
    found = {r["i"]: r["usage_type"] for r in refs.classify_usage(df).collect()}
    assert found == {i: r[3] for i, r in enumerate(RULES) if r[3]}


REF = (
    "solution string, project_name string, file_path string, start_line int, end_line int, node_kind string,"
    " parent_kind string, symbol_kind string, symbol_name string, namespace string, display_name string,"
    " assembly_name string, code_text string, type_args array<struct<code_text:string,symbol_name:string,"
    "namespace:string,display_name:string,assembly_name:string>>"
)


def test_generic_fanout(spark):
    args = [("A", "A", "N", "N.A", "LibA"), ("B", "B", None, "B", None)]
    rows = [
        ("s", "p", "f", 1, 1, "GenericName", "Other", "NamedType", "Map", "N", "N.Map", "Lib", "Map<A, B>", args),
        ("s", "p", "f", 2, 2, "GenericName", "Other", "NamedType", "List", "N", "N.List", "Lib", "List<>", None),
        ("s", "p", "f", 3, 3, "QualifiedName", "Other", "NamedType", "Q", "N", "N.Q", "Lib", "N.Q", args),
    ]
    out = refs.classify_usage(refs.expand_nodes(spark.createDataFrame(rows, REF))).collect()
    assert {(r["start_line"], r["usage_type"], r["symbol_name"], r["assembly_name"]) for r in out} == {
        (1, "TypeReference", "Map", "Lib"),
        (1, "GenericTypeArgument", "A", "LibA"),
        (1, "GenericTypeArgument", "B", None),
        (2, "TypeReference", "List", "Lib"),
        (3, "TypeReference", "Q", "Lib"),
    }
    assert len(out) == 5


def test_lexical_lane(spark):
    lines = [
        ("s", "p", "f", 1, "using Acme.Json;"),
        ("s", "p", "f", 2, "  var x = Acme.Json.Reader.Open(path);"),
        ("s", "p", "f", 3, "[Serializable] class C : List<Reader> {"),
    ]
    df = spark.createDataFrame(lines, "solution string, project_name string, file_path string, line_no int, line string")
    found = {(r["line_no"], r["node_kind"], r["name"]) for r in refs.lexical_refs(df).collect()}
    assert {
        (1, "UsingDirective", "Acme.Json"),
        (2, "QualifiedName", "Acme.Json.Reader.Open"),
        (2, "Invocation", "Open"),
        (3, "AttributeList", "Serializable"),
        (3, "GenericName", "List"),
        (3, "IdentifierName", "Reader"),
    } <= found


@pytest.mark.parametrize("ambiguous", [64, 0])
def test_binding_by_imports(spark, monkeypatch, ambiguous):
    monkeypatch.setattr(refs, "AMBIGUOUS", ambiguous)
    lexical = spark.createDataFrame(
        [
            ("s", "f", 2, "IdentifierName", "Reader"),
            ("s", "g", 2, "IdentifierName", "Reader"),
            ("s", "g", 3, "QualifiedName", "Acme.Json.Reader.Open"),
            ("s", "g", 4, "QualifiedName", "Acme.Json.Readers.Open"),
            ("s", "f", 1, "UsingDirective", "Acme.Json"),
        ],
        "solution string, file_path string, line_no int, node_kind string, name string",
    )
    imports = spark.createDataFrame([("s", "f", "Acme.Json"), ("s", "g", "Acme.Xml")], "solution string, file_path string, namespace string")
    catalog = spark.createDataFrame([("Acme.Json", "Reader", "Acme"), ("Acme.Old", "Reader", "Old")], "namespace string, symbol_name string, assembly_name string")
    found = {(r["file_path"], r["line_no"], r["namespace"]) for r in refs.bind_by_imports(lexical, imports, catalog).collect()}
    assert found == {("f", 2, "Acme.Json"), ("g", 3, "Acme.Json")}


def test_lexical_lane_ends_in_bound_references(spark):
    text = "global using A.B;\nusing C;\n  Run(Thing);\n  C.Thing.Go();"
    files = spark.createDataFrame([("s", "p", "f.cs", text)], "solution string, project_name string, file_path string, text string")
    catalog = spark.createDataFrame([("A.B", "Run", "L1"), ("C", "Thing", "L2"), ("X", "Run", "L3")], "namespace string, symbol_name string, assembly_name string")
    from refscope.sources.files import explode_lines

    found = refs.lexical_symbol_refs(refs.lexical_refs(explode_lines(files)), catalog)
    rows = {(r["start_line"], r["usage_type"], r["namespace"], r["symbol_name"], r["assembly_name"]) for r in refs.classify_usage(found).collect()}
    assert rows == {
        (1, "UsingDirective", "A", "B", None),
        (2, "UsingDirective", None, "C", None),
        (3, "MethodInvocation", "A.B", "Run", "L1"),
        (3, "Direct", "A.B", "Run", "L1"),
        (3, "Direct", "C", "Thing", "L2"),
        (4, "TypeReference", "C", "Thing", "L2"),
        (4, "Direct", "C", "Thing", "L2"),
    }


def test_imports_of_types_and_aliases(spark):
    texts = ["using static System.Math;", "using Json = Newtonsoft.Json;", "  global using A.B ;", "using (var x = y) {", "using var x = y;"]
    lines = spark.createDataFrame([("s", "p", "f", i, t) for i, t in enumerate(texts)], "solution string, project_name string, file_path string, line_no int, line string")
    found = refs.lexical_refs(lines).where("node_kind = 'UsingDirective'")
    assert {(r.line_no, r.name) for r in found.collect()} == {(0, "System.Math"), (1, "Newtonsoft.Json"), (2, "A.B")}


@pytest.mark.parametrize(("broadcast", "ambiguous"), [(500_000, 64), (-1, 64), (-1, 0)])
def test_only_names_of_the_catalogue_move_to_their_imports(spark, monkeypatch, broadcast, ambiguous):
    from refscope import runtime

    monkeypatch.setattr(runtime, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(refs, "AMBIGUOUS", ambiguous)
    lexical = spark.createDataFrame(
        [("s", "f", i, "IdentifierName", name) for i, name in enumerate(["Reader", "Reader", "other", "A.Reader.Open", "B.Reader.Open"])]
        + [("s", "f", 9, "UsingDirective", "A"), (None, "f", 5, "IdentifierName", "Reader"), (None, "f", 6, "QualifiedName", "A.Reader")],
        "solution string, file_path string, line_no int, node_kind string, name string",
    )
    imports = spark.createDataFrame([("s", "f", "A"), ("s", "f", "A"), ("s", "f", "C"), (None, "f", "A")], "solution string, file_path string, namespace string")
    catalog = spark.createDataFrame(
        [("A", "Reader", "L1"), ("A", "Reader", "L1"), ("C", "Reader", "L2"), ("B", "Reader", "L3"), ("A", None, "L4")],
        "namespace string, symbol_name string, assembly_name string",
    )
    bound = refs.bind_by_imports(lexical, imports, catalog)
    if broadcast > 0:
        plan = bound._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 2
    found = sorted((r["line_no"], r["namespace"], r["symbol_name"], r["assembly_name"]) for r in bound.collect())
    assert found == [(i, *home) for i in (0, 1) for home in (("A", "Reader", "L1"), ("C", "Reader", "L2"))] + [
        (3, "A", "Reader", "L1"), (4, "B", "Reader", "L3"),
    ]


def test_lines_without_the_mark_of_a_kind_are_not_searched(spark):
    from pyspark.sql import functions as F

    texts = ["a.b(c<d>[e", "using X;", "plain words", "", None, "1ab.c1.2d(x1y(_q.w", "List<Foo<Bar>>(A.B.C)(", "a..b.c .d(e.(", "a1b2c<T<u.v_"]
    slow = dict(refs.LEXICAL_PATTERNS) | {
        "QualifiedName": r"([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)",
        "Invocation": r"([A-Za-z_][A-Za-z0-9_]*)\(",
        "GenericName": r"([A-Za-z_][A-Za-z0-9_]*)<[A-Za-z_]",
    }
    lines = spark.createDataFrame([("s", "p", "f", i, t) for i, t in enumerate(texts)], "solution string, project_name string, file_path string, line_no int, line string")
    every = [lines.select("line_no", F.lit(k), F.explode(F.regexp_extract_all("line", F.lit(p), 1))).collect() for k, p in slow.items()]
    found = refs.lexical_refs(lines)
    assert sorted(map(tuple, found.select("line_no", "node_kind", "name").collect())) == sorted(tuple(r) for rows in every for r in rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(") + plan.lower().count("contains(") >= len(refs.LEXICAL_MARKS)


def test_names_become_rows_by_compiled_code(spark):
    """No name is turned into a row by one interpreted call each; an import of a namespace outside the catalogue does not move."""
    lines = spark.createDataFrame([("s", "p", "f", 1, "using A;"), ("s", "p", "f", 2, "Run(1);"), ("s", "p", "f", 3, None)], "solution string, project_name string, file_path string, line_no int, line string")
    found = refs.lexical_refs(lines)
    assert "lambdafunction" not in found._jdf.queryExecution().optimizedPlan().toString()
    catalog = spark.createDataFrame([("A", "Run", "L1"), ("A.B.C", "Run", "L2")], "namespace string, symbol_name string, assembly_name string")
    imports = spark.createDataFrame([("s", "f", "A"), ("s", "f", "A"), ("s", "f", "Z")], "solution string, file_path string, namespace string")
    chains = [("s", "p", "f", 4, "QualifiedName", name) for name in ("A.Run", "A.Run.x", "A.B.C", "A.B.C.Run", "A.B.C.Run.y.z", "A.B.C.Walk")]
    bound = refs.bind_by_imports(found.unionByName(spark.createDataFrame(chains, found.schema)), imports, catalog)
    assert "collect_set" not in bound._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted((r["line_no"], r["node_kind"], r["name"], r["assembly_name"]) for r in bound.collect())
    assert rows == [
        (2, "IdentifierName", "Run", "L1"),
        (2, "Invocation", "Run", "L1"),
        (4, "QualifiedName", "A.B.C.Run", "L2"),
        (4, "QualifiedName", "A.B.C.Run.y.z", "L2"),
        (4, "QualifiedName", "A.Run", "L1"),
        (4, "QualifiedName", "A.Run.x", "L1"),
    ]
