"""Shared column lists and the fixed vocabulary of usage types."""

from pyspark.sql import types as T

# The 14 kinds of usage, in declaration order.
USAGE_TYPES = [
    "Direct",
    "Indirect",
    "UsingDirective",
    "TypeReference",
    "MethodInvocation",
    "PropertyAccess",
    "FieldAccess",
    "EventReference",
    "VariableDeclaration",
    "ParameterType",
    "ReturnType",
    "GenericTypeArgument",
    "Inheritance",
    "Attribute",
]

# The order in which rows of one job count as "earlier": rows equal in all of
# these are identical, so which of them comes first cannot be seen.
USAGE_ORDER = [
    "project_name",
    "file_path",
    "start_line",
    "end_line",
    "usage_type",
    "symbol_name",
    "code_text",
]

USAGE_SCHEMA = T.StructType(
    [
        T.StructField("job_id", T.StringType(), False),
        T.StructField("solution", T.StringType(), False),
        T.StructField("project_name", T.StringType(), False),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("start_line", T.IntegerType(), False),
        T.StructField("end_line", T.IntegerType(), False),
        T.StructField("code_text", T.StringType(), False),
        T.StructField("usage_type", T.StringType(), False),
        T.StructField("symbol_name", T.StringType(), False),
        T.StructField("namespace", T.StringType(), True),
        T.StructField("assembly_name", T.StringType(), True),
        T.StructField("context_start_line", T.IntegerType(), False),
        T.StructField("context_end_line", T.IntegerType(), False),
        T.StructField("has_context", T.BooleanType(), False),
    ]
)
USAGE_COLUMNS = USAGE_SCHEMA.names
