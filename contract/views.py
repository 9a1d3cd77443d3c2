"""Engine inputs derived from the driver's tables, as SQL text both engines run.

``{name}`` stands for a table or another view. Spark gets DataFrames for the
names, DuckDB gets a chain of common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from refscope.runtime import spread

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Tables whose generated file, one row group, would keep a single core busy.
LARGE = ["orders", "lineitem", "events", "documents", "pages"]

VIEWS = {
    # Bound references: one row per syntax node.
    "symbol_refs": """
        SELECT n_name AS solution, s_name AS project_name,
         concat('src/', cast(l_orderkey AS varchar(20)), '.cs') AS file_path,
         l_linenumber AS start_line, cast(l_linenumber + l_partkey % 3 AS int) AS end_line,
         CASE l_partkey % 10 WHEN 0 THEN 'UsingDirective' WHEN 1 THEN 'IdentifierName' WHEN 2 THEN 'GenericName'
           WHEN 3 THEN 'QualifiedName' WHEN 4 THEN 'MemberAccess' WHEN 5 THEN 'VariableDeclaration' WHEN 6 THEN 'Parameter'
           WHEN 7 THEN 'MethodDeclaration' WHEN 8 THEN 'BaseList' ELSE 'AttributeList' END AS node_kind,
         CASE l_suppkey % 4 WHEN 0 THEN 'VariableDeclaration' WHEN 1 THEN 'Invocation' WHEN 2 THEN 'MemberAccess'
           ELSE 'Other' END AS parent_kind,
         CASE l_orderkey % 6 WHEN 0 THEN 'Method' WHEN 1 THEN 'Property' WHEN 2 THEN 'Field' WHEN 3 THEN 'Event'
           WHEN 4 THEN 'NamedType' ELSE 'Namespace' END AS symbol_kind,
         replace(p_name, ' ', '_') AS symbol_name,
         concat(p_brand, '.', p_type) AS namespace,
         concat(p_brand, '.', p_type, '.', replace(p_name, ' ', '_')) AS display_name,
         CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand END AS assembly_name,
         concat(p_name, '(', cast(cast(l_quantity AS int) AS varchar(10)), ')') AS code_text
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
        JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey""",
    # The same nodes with a type argument for generic names: the part numbered like the supplier.
    "generic_refs": """
        SELECT n_name AS solution, s_name AS project_name,
         concat('src/', cast(l_orderkey AS varchar(20)), '.cs') AS file_path,
         l_linenumber AS start_line, l_linenumber AS end_line,
         CASE WHEN p.p_partkey % 2 = 0 THEN 'GenericName' ELSE 'QualifiedName' END AS node_kind,
         'Other' AS parent_kind, 'NamedType' AS symbol_kind,
         replace(p.p_name, ' ', '_') AS symbol_name, concat(p.p_brand, '.', p.p_type) AS namespace,
         concat(p.p_brand, '.', replace(p.p_name, ' ', '_')) AS display_name, p.p_brand AS assembly_name,
         concat(p.p_name, '<', a.p_name, '>') AS code_text,
         a.p_name AS arg_text, replace(a.p_name, ' ', '_') AS arg_symbol, concat(a.p_brand, '.', a.p_type) AS arg_namespace,
         concat(a.p_brand, '.', replace(a.p_name, ' ', '_')) AS arg_display, a.p_brand AS arg_assembly
        FROM {lineitem} JOIN {part} p ON l_partkey = p.p_partkey JOIN {part} a ON l_suppkey = a.p_partkey
        JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey""",
    # Whole source texts: the documents, some under a binary extension.
    "source_files": """
        SELECT 'docs' AS solution, source AS project_name, concat('docs/', cast(doc_id AS varchar(20)),
         CASE WHEN doc_id % 9 = 0 THEN '.PNG' ELSE '.txt' END) AS file_path, text FROM {documents}""",
    "document_lines": """
        SELECT doc_id, max(length(t) - length(replace(t, chr(10), '')) + 1) AS n_lines FROM (
         SELECT doc_id, replace(replace(text, concat(chr(13), chr(10)), chr(10)), chr(13), chr(10)) AS t FROM {documents}) x
        GROUP BY doc_id""",
    # Positions in all documents: some in missing or binary files, some on line 0 or up to two lines beyond the end.
    "doc_usages": """
        SELECT 'docs' AS solution, concat('docs/', cast(asked AS varchar(20)),
         CASE WHEN event_id % 9 = 0 THEN '.PNG' ELSE '.txt' END) AS file_path,
         cast((event_id + user_id) % (coalesce(n_lines, 0) + 3) AS int) AS start_line,
         cast((event_id + user_id) % (coalesce(n_lines, 0) + 3) + event_id % 2 AS int) AS end_line,
         cast(1 + event_id % 3 AS int) AS context_lines, event_id, event_type AS code_text
        FROM (SELECT event_id, user_id, event_type,
          event_id % (SELECT coalesce(max(doc_id), 0) + 2 FROM {documents}) AS asked FROM {events}) e
        LEFT JOIN {document_lines} ON asked = doc_id""",
    # Text of the files the references point into: five lines each, so lines 6 and 7 are beyond the end.
    "ref_files": """
        SELECT r.solution, r.file_path,
         concat('// order ', cast(o_orderkey AS varchar(20)), chr(10), 'status  ', o_orderstatus, chr(13), chr(10),
          'priority = "', o_orderpriority, '"; /* customer', chr(10), cast(o_custkey AS varchar(20)), ' */', chr(10), 'end') AS text
        FROM (SELECT DISTINCT n_name AS solution, l_orderkey, concat('src/', cast(l_orderkey AS varchar(20)), '.cs') AS file_path
          FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey) r
        JOIN {orders} ON r.l_orderkey = o_orderkey""",
    # One job with a snippet for each item of all orders; three words, and a hash, are of the order alone.
    "order_snippets": """
        SELECT 'all' AS job_id, 'orders' AS solution, 'p' AS project_name, concat('src/', cast(l_orderkey AS varchar(20)), '.cs') AS file_path,
         l_linenumber AS start_line, cast(l_partkey AS int) AS end_line, 'Direct' AS usage_type, p_name AS symbol_name, l_orderkey,
         concat('o', cast(l_orderkey AS varchar(20)), ' k', cast(l_orderkey AS varchar(20)), ' r', cast(l_orderkey AS varchar(20)), ' ',
          p_name, ' ', replace(p_brand, '#', ''), ' ', l_returnflag, ' ', l_linestatus, ' m', cast(l_linenumber % 2 AS varchar(5)),
          ' s', cast(l_suppkey % 2 AS varchar(5))) AS code_text,
         concat(md5(concat('order ', cast(l_orderkey AS varchar(20)))), ' ', l_returnflag, l_linestatus, cast(l_linenumber AS varchar(5)),
          replace(p_name, 'u', cast(l_suppkey % 10 AS varchar(5)))) AS tagged
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "commented_code": """
        SELECT p_partkey, concat(p_name, '   // see ', p_brand, chr(10), '  ', p_type, ' /* ', p_brand, chr(10), p_name,
         ' */ end', chr(13), chr(10)) AS code_text FROM {part}""",
    # Packages with an odd number have a version 1.0; one in three archives also lists ``ref`` items.
    "package_files": """
        SELECT DISTINCT p_brand AS package, concat(cast(cast(right(p_brand, 1) AS int) % 2 AS varchar(5)), '.0') AS version,
         concat(CASE WHEN p_partkey % 3 = 0 THEN 'ref' WHEN p_partkey % 11 = 0 THEN 'tools' ELSE 'lib' END, '/net6.0/', p_brand, '.', p_type,
          CASE WHEN p_partkey % 5 = 0 THEN '.xml' WHEN p_partkey % 7 = 0 THEN '.DLL' ELSE '.dll' END) AS path,
         cast(right(p_brand, 1) AS int) % 3 <> 0 AS from_archive FROM {part}""",
    # Every part of a solution gives a path: below its own package's folder, or below another package's.
    "reference_paths": """
        SELECT DISTINCT n_name AS solution, CASE WHEN n_nationkey % 3 = cast(right(p_brand, 1) AS int) % 3
          THEN concat('/home/u/.nuget/packages/', lower(p_brand), '/1.0/lib/', p_brand, '.dll')
          ELSE concat('/home/u/.nuget/packages/', lower(p_type), '/1.0/lib/', p_name, '.dll') END AS path
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey
        JOIN {nation} ON s_nationkey = n_nationkey""",
    # What each project's manifest declares: the packages of its parts, and its customers' segments, which are no packages at all.
    "project_manifests": """
        SELECT n_name AS solution, s_name AS project_name, concat('<Project><PackageReference Include="', p_brand,
          '" Version="1.0" /></Project>') AS text
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey
        JOIN {nation} ON s_nationkey = n_nationkey
        UNION SELECT n_name, s_name, concat('<Project><PackageReference Include="', c_mktsegment, '" Version="1.0" /></Project>')
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
        JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey""",
    # Packages of projects in a tree of folders, and how each is written down (see ``tree_manifests``).
    "tree_packages": """
        SELECT DISTINCT r_name AS solution, n_nationkey AS area_key, n_name AS area, s_name AS project_name,
         replace(p_type, ' ', '.') AS package, cast((length(p_type) + s_suppkey) % 8 AS int) AS style
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey
        JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    # Project files in eight ways of writing, central versions at the top and in every second area, and one shared file.
    "tree_manifests": """
        SELECT solution, project_name, concat('src/', area, '/', project_name, '/', project_name, '.csproj') AS file_path,
         concat('<Project Sdk="Any"><ItemGroup>', string_agg(element, chr(10)), '</ItemGroup></Project>') AS text FROM (
          SELECT *, CASE style WHEN 0 THEN concat('<PackageReference Include="', package, '" Version="1.0" />')
           WHEN 1 THEN concat('<PackageReference Version=', chr(39), '2.0', chr(39), ' Include=', chr(39), package, chr(39), '></PackageReference>')
           WHEN 2 THEN concat('<PackageReference Include="', package, '">', chr(10), '<Version>3.0</Version></PackageReference>')
           WHEN 3 THEN concat('<PackageReference Include="', lower(package), '" />')
           WHEN 4 THEN concat('<!-- <PackageReference Include="', package, '" Version="9.0" /> -->')
           WHEN 5 THEN concat('<PackageReference Include="', package, '" VersionOverride="5.0" />')
           WHEN 6 THEN concat('<PackageReference Update="', package, '" Version="6.0" />')
           ELSE concat('<PackageReference Remove="', package, '" />') END AS element FROM {tree_packages}) x
        GROUP BY solution, area, project_name
        UNION ALL SELECT solution, cast(NULL AS varchar(20)), concat('src/', area, '/Directory.Packages.props'),
         concat('<Project>', string_agg(concat('<PackageVersion Include="', package, '" Version="7.0"/>'), ''), '</Project>')
        FROM (SELECT DISTINCT solution, area, package FROM {tree_packages} WHERE area_key % 2 = 0) y GROUP BY solution, area
        UNION ALL SELECT solution, cast(NULL AS varchar(20)), 'Directory.Packages.props',
         concat('<Project>', string_agg(concat('<PackageVersion Include="', package, '" Version="8.0"/>'), ''), '</Project>')
        FROM (SELECT DISTINCT solution, package FROM {tree_packages} WHERE package NOT LIKE 'PROMO%') z GROUP BY solution
        UNION ALL SELECT solution, cast(NULL AS varchar(20)), 'src/Directory.Build.props',
         concat('<Project>', string_agg(concat('<PackageReference Include="', package, '" Version="4.0"/>'), ''), '</Project>')
        FROM (SELECT DISTINCT solution, package FROM {tree_packages} WHERE package LIKE 'ECONOMY%') w GROUP BY solution""",
    # Files of orders in folders of their customers, before and after some were added, removed, renamed and edited.
    "files_before": """
        SELECT c_mktsegment AS solution, concat(n_name, '/', c_name, '/', cast(o_orderkey AS varchar(20)), '.cs') AS file_path,
         concat(o_orderstatus, ' ', o_orderpriority) AS text
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey WHERE o_orderkey % 80 <> 7""",
    "files_after": """
        SELECT c_mktsegment AS solution, concat(n_name, '/', c_name, '/', cast(o_orderkey AS varchar(20)),
          CASE WHEN o_orderkey % 60 = 5 THEN '.new.cs' ELSE '.cs' END) AS file_path,
         concat(o_orderstatus, ' ', o_orderpriority, CASE WHEN o_orderkey % 50 = 3 THEN ' edited' ELSE '' END) AS text
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey WHERE o_orderkey % 70 <> 9""",
    # The files of the references and what they refer to: before, some are not there yet; after, some are gone
    # and some are edited, so that only their odd lines refer to anything.
    "ref_files_before": "SELECT * FROM {ref_files} WHERE NOT file_path LIKE '%07.cs'",
    "ref_files_after": """
        SELECT solution, file_path, CASE WHEN file_path LIKE '%13.cs' THEN concat(text, ' // edited') ELSE text END AS text
        FROM {ref_files} WHERE NOT file_path LIKE '%19.cs'""",
    "refs_before": "SELECT * FROM {symbol_refs} WHERE NOT file_path LIKE '%07.cs'",
    "refs_after": """
        SELECT * FROM {symbol_refs} WHERE NOT file_path LIKE '%19.cs' AND NOT (file_path LIKE '%13.cs' AND start_line % 2 = 0)""",
    # Files of code: an import, written in two ways, and lines that use its names.
    "code_files": """
        SELECT DISTINCT n_name AS solution, s_name AS project_name, concat('src/', cast(l_orderkey AS varchar(20)), '-',
          cast(l_linenumber AS varchar(20)), '-', cast(l_partkey AS varchar(20)), '-', cast(l_suppkey AS varchar(20)), '.cs') AS file_path,
         concat(CASE WHEN l_partkey % 2 = 0 THEN 'using N' ELSE 'global using N' END, right(p_brand, 1), '.', replace(p_type, ' ', '_'), ';',
          chr(10), '  ', replace(p_name, ' ', '_'), '(', cast(l_linenumber AS varchar(20)), ');', chr(10), 'x = new Other();') AS text
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey
        JOIN {nation} ON s_nationkey = n_nationkey""",
    "code_catalog": """
        SELECT concat('N', right(p_brand, 1), '.', replace(p_type, ' ', '_')) AS namespace, replace(p_name, ' ', '_') AS symbol_name,
         min(p_brand) AS assembly_name FROM {part}
        GROUP BY concat('N', right(p_brand, 1), '.', replace(p_type, ' ', '_')), replace(p_name, ' ', '_')""",
    "code_targets": """
        SELECT DISTINCT concat('N', right(p_brand, 1)) AS job_id, concat('N', right(p_brand, 1)) AS target FROM {part}""",
    # Every package that occurs in a solution is a job.
    "jobs": """
        SELECT DISTINCT concat(n_name, '|', p_brand) AS job_id, n_name AS solution, p_brand AS package, '1.0' AS version,
         n_nationkey % 2 = 0 AS force_refresh
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey
        JOIN {nation} ON s_nationkey = n_nationkey""",
    "job_sets": """
        SELECT job_id, solution, lower(package) AS assembly_lc FROM {jobs}""",
    "targets": """
        SELECT * FROM (VALUES ('t1', 'Brand#1'), ('t2', 'brand#2'), ('t3', 'Brand#3.SMALL'),
         ('t4', 'Brand#4.PROMO.blue_bolt')) v(job_id, target)""",
    # Symbol jobs: each solution asks for each target.
    "symbol_jobs": """
        SELECT concat(n_name, '|', target) AS job_id, n_name AS solution, target FROM (
         SELECT n_name, 'Brand#1' AS target FROM {nation} UNION ALL SELECT n_name, 'brand#2' FROM {nation}
         UNION ALL SELECT n_name, 'Brand#3.SMALL' FROM {nation}
         UNION ALL SELECT n_name, 'Brand#4.PROMO.blue_bolt' FROM {nation}) x""",
    "projects": """
        SELECT n_name AS solution, s_name AS project_name FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "project_errors": """
        SELECT n_name AS solution, s_name AS project_name, concat('balance ', cast(cast(floor(s_acctbal) AS int) AS varchar(20))) AS error
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey WHERE s_acctbal < 0""",
    "source_state": """
        SELECT n_name AS solution, max(ts) AS mtime FROM {events} JOIN {customer} ON user_id = c_custkey
        JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name""",
    # When each job ran and for how long, from its line items.
    "analyses": """
        SELECT concat(n_name, '|', p_brand) AS job_id, n_name AS solution, p_brand AS package, '1.0' AS version,
         max(l_shipdate) AS analyzed_at, cast(sum(cast(l_quantity AS bigint) * 977) AS bigint) AS duration_ms
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey
        JOIN {nation} ON s_nationkey = n_nationkey GROUP BY n_name, p_brand""",
    "manifests": """
        SELECT page_id, url, concat('m/', cast(page_id AS varchar(20)), CASE page_id % 5 WHEN 0 THEN '.csproj'
          WHEN 1 THEN '.targets' WHEN 2 THEN '.props' WHEN 3 THEN '.tt' ELSE '/Install.ps1' END) AS file_path, html AS text
        FROM {pages}""",
    # Neighbouring snippets of one file.
    "snippet_pairs": """
        SELECT l_orderkey, l_linenumber, code_text, next_text FROM (
         SELECT l_orderkey, l_linenumber, concat(p_name, '(', cast(cast(l_quantity AS int) AS varchar(10)), ')') AS code_text,
          lead(concat(p_name, '  (', cast(cast(l_quantity AS int) AS varchar(10)), ') // ', p_brand)) OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS next_text
         FROM {lineitem} JOIN {part} ON l_partkey = p_partkey) x WHERE next_text IS NOT NULL""",
}


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view as a DataFrame."""
    if name in TABLES:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spread(table) if name in LARGE else table
    sql = VIEWS[name]
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in _names(sql)})


def with_views(sql: str) -> str:
    """Prefix DuckDB text with the views it names as ``{view}``."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in order:
            for other in _names(VIEWS[name]):
                visit(other)
            order.append(name)

    for name in _names(sql):
        visit(name)

    def plain(text: str) -> str:
        return re.sub(r"\{(\w+)\}", r"\1", text)

    body = plain(sql).strip()
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({plain(VIEWS[n]).strip()})" for n in order)
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
