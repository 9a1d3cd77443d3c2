"""From bound (or lexically found) references to usage rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refscope.runtime import cut, fits_broadcast, join_bounded

# A name with more namespaces than this does not carry them along.
AMBIGUOUS = 64

# Usage type by node kind where nothing else matters.
BY_NODE = {
    "UsingDirective": "UsingDirective",
    "GenericName": "TypeReference",
    "TypeArgument": "GenericTypeArgument",
    "QualifiedName": "TypeReference",
    "VariableDeclaration": "VariableDeclaration",
    "Parameter": "ParameterType",
    "MethodDeclaration": "ReturnType",
    "BaseList": "Inheritance",
    "AttributeList": "Attribute",
}
# An identifier is judged by its parent node ...
IDENTIFIER_BY_PARENT = {
    "VariableDeclaration": "VariableDeclaration",
    "Invocation": "MethodInvocation",
    "MemberAccess": "PropertyAccess",
}
# Fixed values: ... and a member access by the kind of its symbol.
MEMBER_BY_SYMBOL = {
    "Method": "MethodInvocation",
    "Property": "PropertyAccess",
    "Field": "FieldAccess",
    "Event": "EventReference",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    entries = [F.lit(text) for pair in table.items() for text in pair]
    return F.try_element_at(F.create_map(*entries), key)


def usage_type() -> Column:
    """Usage type of a reference, by literal tables rather than a long chain of cases."""
    node = F.col("node_kind")
    return (
        F.when(node == "IdentifierName", F.coalesce(_lookup(IDENTIFIER_BY_PARENT, F.col("parent_kind")), F.lit("Direct")))
        .when(node == "MemberAccess", F.coalesce(_lookup(MEMBER_BY_SYMBOL, F.col("symbol_kind")), F.lit("Direct")))
        .otherwise(_lookup(BY_NODE, node))
    )


def is_usage() -> Column:
    """Known node kinds; an import counts only if it is bound to a namespace.

    Stated on the input columns, so that the scan can apply it.
    """
    node = F.col("node_kind")
    known = node.isin([*BY_NODE, "IdentifierName", "MemberAccess"])
    return known & ((node != "UsingDirective") | (F.col("symbol_kind") == "Namespace"))


def classify_usage(refs: DataFrame) -> DataFrame:
    """Add ``usage_type`` and drop references that are no usage."""
    return refs.where(is_usage()).withColumn("usage_type", usage_type())


def expand_nodes(refs: DataFrame) -> DataFrame:
    """A generic name also yields one row per type argument. Narrow: no shuffle."""
    if "type_args" not in refs.columns:
        return refs
    symbol = ["node_kind", "symbol_kind", "symbol_name", "namespace", "display_name", "assembly_name", "code_text"]
    keep = [c for c in refs.columns if c not in symbol and c != "type_args"]
    own = F.array(F.struct(*symbol))

    def argument(a: Column) -> Column:
        taken = [a[c].alias(c) for c in symbol[2:]]
        return F.struct(F.lit("TypeArgument").alias("node_kind"), F.lit("NamedType").alias("symbol_kind"), *taken)

    has_arguments = (F.col("node_kind") == "GenericName") & F.col("type_args").isNotNull()
    nodes = F.when(has_arguments, F.concat(own, F.transform("type_args", argument))).otherwise(own)
    return refs.select(*keep, F.explode(nodes).alias("node")).select(*keep, "node.*")


def to_usages(matched: DataFrame) -> DataFrame:
    """Project matched references (with ``job_id``) onto the usage schema, before any context."""
    return classify_usage(matched).select(
        "job_id",
        "solution",
        "project_name",
        "file_path",
        F.col("start_line").cast("int").alias("start_line"),
        F.col("end_line").cast("int").alias("end_line"),
        "code_text",
        "usage_type",
        "symbol_name",
        "namespace",
        "assembly_name",
        F.lit(0).alias("context_start_line"),
        F.lit(0).alias("context_end_line"),
        F.lit(False).alias("has_context"),
    )


# Patterns of the lexical lane, one per kind of node, over single lines. An import may name a
# namespace, the members of a type (``static``) or another name for either (``name =``). A name is tried once, from its
# start, and never given back letter by letter; a generic name may begin inside what the last match ended with.
LEXICAL_PATTERNS = [
    ("UsingDirective", r"^\s*(?:global\s+)?using\s+(?:static\s+|[A-Za-z_][A-Za-z0-9_]*\s*=\s*)?([A-Za-z_][A-Za-z0-9_.]*)\s*;"),
    ("QualifiedName", r"(?<![A-Za-z_])([A-Za-z_][A-Za-z0-9_]*+(?:\.[A-Za-z_][A-Za-z0-9_]*+)++)"),
    ("Invocation", r"(?<![A-Za-z_])([A-Za-z_][A-Za-z0-9_]*+)\("),
    ("GenericName", r"([A-Za-z_][A-Za-z0-9_]*+)<[A-Za-z_]"),
    ("AttributeList", r"\[([A-Za-z_][A-Za-z0-9_.]*)"),
    ("IdentifierName", r"([A-Za-z_][A-Za-z0-9_]*)"),
]

# What a line must hold for a match of the kind; others are not searched.
LEXICAL_MARKS = {"UsingDirective": "using", "QualifiedName": ".", "Invocation": "(", "GenericName": "<", "AttributeList": "["}


def lexical_refs(lines: DataFrame) -> DataFrame:
    """Approximate references from raw lines, where no indexer output exists.

    Over-matches (strings, comments) and knows no types; one row per match.
    ``UsingDirective`` names a namespace, the other kinds a name or dotted chain.
    """

    def names(kind: str, pattern: str) -> Column:
        found = F.regexp_extract_all("line", F.lit(pattern), 1)
        return F.when(F.col("line").contains(LEXICAL_MARKS[kind]), found) if kind in LEXICAL_MARKS else found

    # Names become rows kind by kind, all by compiled code; kinds without a match give no row.
    keys = ["solution", "project_name", "file_path", "line_no"]
    by_kind = lines.select(*keys, F.posexplode(F.array(*[names(*known) for known in LEXICAL_PATTERNS])).alias("kind", "names"))
    node_kind = F.get(F.lit([kind for kind, _ in LEXICAL_PATTERNS]), F.col("kind")).alias("node_kind")
    return by_kind.select(*keys, node_kind, F.explode("names").alias("name"))


def bind_by_imports(refs: DataFrame, imports: DataFrame, catalog: DataFrame) -> DataFrame:
    """Bind lexical names to catalogue symbols; an approximation of name binding.

    ``imports(solution, file_path, namespace)``, ``catalog(namespace, symbol_name,
    assembly_name)``. A plain name binds if its file imports the symbol's
    namespace; a dotted chain binds if it starts with ``namespace.symbol_name``.
    References without a name of the catalogue go where they are read; the others
    move once, to their file's imports. Chains do not move.
    """
    place = ["solution", "file_path"]
    names = refs.where((F.col("node_kind") != "UsingDirective") & F.col("solution").isNotNull() & F.col("file_path").isNotNull())
    held = [*place, "name", *[c for c in refs.columns if c not in (*place, "name")]]
    columns = [*held, "symbol_name", "namespace", "assembly_name"]
    catalog = cut(catalog.select("namespace", "symbol_name", "assembly_name").distinct(), "catalog")
    homes = catalog.groupBy(F.col("symbol_name").alias("name")).agg(F.count("*").alias("homes"))
    listed = catalog.withColumnRenamed("symbol_name", "name").join(homes, "name")
    plain = names.where(~F.col("name").contains("."))
    # Files are told by a hash first: their names, which mostly begin alike, are compared where that is equal.
    file = F.xxhash64(*place).alias("_file")
    place = ["_file", *place]
    imports = imports.select(file, "solution", "file_path", "namespace")
    plain = plain.select(file, *held)
    bound = None
    if fits_broadcast(catalog):
        # Nothing moves any more: imports are looked up one by one. Those of namespaces outside the catalogue bind nothing.
        common = listed.drop("homes")
        known = imports.join(F.broadcast(catalog.select("namespace")), "namespace", "left_semi")
        near = known.select(*place, "namespace").repartition(*place).distinct()
    else:
        near = imports.groupBy(*place).agg(F.collect_set("namespace").alias("near"))
        # A name of few namespaces carries them as one array; it meets its file's imports, also
        # one array, and only true bindings become rows.
        rare = listed.where(F.col("homes") <= AMBIGUOUS).groupBy("name")
        rare = cut(rare.agg(F.collect_list(F.struct("namespace", "assembly_name")).alias("homes")), "rare-names")
        bound_rare = F.filter("homes", lambda h: F.array_contains("near", h["namespace"]))
        at_home = join_bounded(plain, rare.select("name"), ["name"], "left_semi").join(near, place)
        bound = (
            join_bounded(at_home, rare, ["name"], written=True)
            .select(*held, F.explode(bound_rare).alias("home"))
            .select(*held, F.col("name").alias("symbol_name"), "home.*")
            .select(*columns)
        )
        # The few names of many namespaces meet their file's imports first.
        common = listed.where(F.col("homes") > AMBIGUOUS).drop("homes")
    common = cut(common, "common-names")
    if bound is None or not common.isEmpty():
        asked = join_bounded(plain, common.select("name").distinct(), ["name"], "left_semi").join(near, place)
        asked = asked.select(*held, "namespace" if bound is None else F.explode("near").alias("namespace"))
        found = join_bounded(asked, common, ["namespace", "name"], written=True)
        found = found.withColumn("symbol_name", F.col("name")).select(*columns)
        bound = found if bound is None else bound.unionByName(found)

    # Of a chain only prefixes of as many parts as some name of the catalogue has are looked up.
    parts = F.split("name", r"\.")
    qualified = catalog.withColumn("qualified", F.concat_ws(".", "namespace", "symbol_name"))
    sizes = F.size(F.split("qualified", r"\."))
    least, most = qualified.agg(F.min(sizes), F.max(sizes)).first()
    least, most = max(least or 2, 2), most or 2
    long = names.where(F.col("name").contains(".") & (F.size(parts) >= least) & F.lit(least <= most))
    chains = long.select(
        *held,
        F.explode(
            F.transform(
                F.sequence(F.lit(least), F.least(F.size(parts), F.lit(max(least, most)))), lambda n: F.array_join(F.slice(parts, 1, n), ".")
            )
        ).alias("qualified"),
    )
    return bound.unionByName(join_bounded(chains, qualified, ["qualified"]).select(*columns))


# What the lexical kinds are called among bound references, and under which parent.
LEXICAL_NODES = {"Invocation": ("IdentifierName", "Invocation")}


def lexical_symbol_refs(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """``symbol_refs`` of lexically found references: imports as they are written, other names bound by them.

    An import is bound to a namespace; every other symbol counts as a type, the
    lexical lane knows no kinds of symbols. ``code_text`` is the name as written.
    """
    place = ["solution", "project_name", "file_path", "line_no"]
    using = F.col("node_kind") == "UsingDirective"
    imports = refs.where(using).select("solution", "file_path", F.col("name").alias("namespace"))
    none = F.lit(None).cast("string")
    last = F.substring_index("name", ".", -1)
    directives = refs.where(using).select(
        *place, "node_kind", "name", F.lit("Namespace").alias("symbol_kind"), last.alias("symbol_name"),
        F.when(F.col("name").contains("."), F.left("name", F.char_length("name") - F.char_length(last) - 1)).alias("namespace"),
        F.col("name").alias("display_name"), none.alias("assembly_name"),
    )
    bound = bind_by_imports(refs, imports, catalog).select(
        *place, "node_kind", "name", F.lit("NamedType").alias("symbol_kind"), "symbol_name", "namespace",
        F.concat_ws(".", "namespace", "symbol_name").alias("display_name"), "assembly_name",
    )
    node, parent = F.col("node_kind"), F.lit("Other")
    for kind, (name, above) in LEXICAL_NODES.items():
        parent = F.when(F.col("node_kind") == kind, above).otherwise(parent)
        node = F.when(F.col("node_kind") == kind, name).otherwise(node)
    line = F.col("line_no").cast("int")
    return directives.unionByName(bound).select(
        "solution", "project_name", "file_path", line.alias("start_line"), line.alias("end_line"),
        node.alias("node_kind"), parent.alias("parent_kind"), "symbol_kind", "symbol_name", "namespace",
        "display_name", "assembly_name", F.col("name").alias("code_text"),
    )
