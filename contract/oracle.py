"""DuckDB SQL giving the same rows as each query, written independently of the Spark plans."""

from __future__ import annotations

from contract.views import with_views
from refscope.sources.files import BINARY_EXTENSIONS

BINARY = ",".join(f"'{e}'" for e in BINARY_EXTENSIONS)

CLASSIFIED = """
  CASE node_kind
    WHEN 'UsingDirective' THEN CASE WHEN symbol_kind = 'Namespace' THEN 'UsingDirective' END
    WHEN 'IdentifierName' THEN CASE parent_kind WHEN 'VariableDeclaration' THEN 'VariableDeclaration'
      WHEN 'Invocation' THEN 'MethodInvocation' WHEN 'MemberAccess' THEN 'PropertyAccess' ELSE 'Direct' END
    WHEN 'GenericName' THEN 'TypeReference' WHEN 'QualifiedName' THEN 'TypeReference'
    WHEN 'MemberAccess' THEN CASE symbol_kind WHEN 'Method' THEN 'MethodInvocation' WHEN 'Property' THEN 'PropertyAccess'
      WHEN 'Field' THEN 'FieldAccess' WHEN 'Event' THEN 'EventReference' ELSE 'Direct' END
    WHEN 'VariableDeclaration' THEN 'VariableDeclaration' WHEN 'Parameter' THEN 'ParameterType'
    WHEN 'MethodDeclaration' THEN 'ReturnType' WHEN 'BaseList' THEN 'Inheritance' WHEN 'AttributeList' THEN 'Attribute' END"""

# All usages with one job per solution, and usages of the package jobs.
ALL_USAGES = f"""classified AS (SELECT *, {CLASSIFIED} AS usage_type FROM {{symbol_refs}}),
solution_usages AS (SELECT *, solution AS job_id FROM classified WHERE usage_type IS NOT NULL),
job_usages AS (SELECT j.job_id, c.* FROM classified c JOIN {{job_sets}} j ON j.solution = c.solution
  AND j.assembly_lc = lower(c.assembly_name) WHERE usage_type IS NOT NULL)"""

ORDER = "project_name, file_path, start_line, end_line, usage_type, symbol_name, code_text"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '//[^\\n]*', '', 'g'), '/\\*.*?\\*/', '', 'gs')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def shipped(x: str) -> str:
    return strip(squeeze(x))


def comments_first(x: str) -> str:
    return squeeze(strip(x))


def similar(a: str, b: str, edits: int = 3, ratio: float = 0.9) -> str:
    longer = f"greatest(length({a}), length({b}))"
    return (
        f"({a} = {b} OR (length({a}) > 0 AND length({b}) > 0 AND (levenshtein({a}, {b}) <= {edits} "
        f"OR 1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / {longer}::DOUBLE >= {ratio}::DOUBLE)))"
    )


def greedy(source: str, text: str, edits: int = 3, ratio: float = 0.9) -> str:
    """CTEs: distinct texts of a job in order, then the sequential filter as a list fold."""
    return f"""texts AS (SELECT *, {text} AS txt FROM {source}),
firsts AS (SELECT * FROM texts QUALIFY row_number() OVER (PARTITION BY job_id, txt ORDER BY {ORDER}) = 1),
folded AS (SELECT job_id, list_reduce(list([txt] ORDER BY {ORDER}),
  lambda kept, t: CASE WHEN len(list_filter(kept, lambda k: {similar("k", "t[1]", edits, ratio)})) > 0 THEN kept
    ELSE list_concat(kept, t) END) AS kept FROM firsts GROUP BY job_id),
kept AS (SELECT f.* FROM firsts f JOIN folded USING (job_id) WHERE list_contains(folded.kept, f.txt))"""


SPLIT = "list_distinct(regexp_extract_all({0}, '[A-Za-z0-9_]+'))"


def of_orders(text: str, alike: str) -> str:
    """The sequential filter order by order: snippets of two orders are never similar, as the words or the hash of each alone show."""
    return f"""WITH texts AS (SELECT * REPLACE ({shipped(text)} AS code_text), {text} AS raw FROM {{order_snippets}}),
firsts AS (SELECT *, code_text AS txt FROM texts QUALIFY row_number() OVER (PARTITION BY code_text ORDER BY {ORDER.replace("code_text", "raw")}) = 1),
folded AS (SELECT l_orderkey, list_reduce(list([txt] ORDER BY {ORDER.replace("code_text", "raw")}),
  lambda kept, t: CASE WHEN len(list_filter(kept, lambda k: {alike})) > 0 THEN kept ELSE list_concat(kept, t) END) AS kept FROM firsts GROUP BY l_orderkey)
SELECT file_path, start_line, end_line, raw AS code_text FROM firsts JOIN folded USING (l_orderkey) WHERE list_contains(folded.kept, txt)"""


def context(usages: str, sources: str, n: str) -> str:
    """CTE ``ctx``: the usages with their snippet; ``src`` holds the lines of each file."""
    return f"""src AS (SELECT solution, file_path, CASE WHEN lower(regexp_extract(file_path, '(\\.[^./\\\\]*)$')) IN ({BINARY})
    THEN [] ELSE regexp_split_to_array(text, '\\r\\n|\\r|\\n') END AS lines FROM {sources}),
placed AS (SELECT u.*, lines, {n} AS n, CASE WHEN start_line < 1 THEN 'bad_line' WHEN lines IS NULL THEN 'missing_file'
    WHEN len(lines) = 0 THEN 'empty_file' WHEN start_line > len(lines) THEN 'beyond_end' ELSE 'ok' END AS status
  FROM {usages} u LEFT JOIN src USING (solution, file_path)),
ctx AS (SELECT * EXCLUDE (lines), len(lines) AS n_lines,
  CASE status WHEN 'ok' THEN greatest(1, start_line - n) WHEN 'empty_file' THEN 1 ELSE start_line END::INT AS first_line,
  CASE status WHEN 'ok' THEN least(len(lines), start_line + n) WHEN 'empty_file' THEN 1 ELSE start_line END::INT AS last_line,
  CASE status WHEN 'ok' THEN start_line - n < 1 OR start_line + n > len(lines) ELSE status <> 'empty_file' END AS truncated,
  CASE status WHEN 'ok' THEN array_to_string(lines[greatest(1, start_line - n):least(len(lines), start_line + n)], chr(10))
    WHEN 'empty_file' THEN '' WHEN 'missing_file' THEN '// File not found: ' || file_path
    WHEN 'beyond_end' THEN '// Target line ' || start_line || ' is beyond file length (' || len(lines) || ' lines)'
    ELSE '// Error reading file: Target line must be 1 or greater (Parameter ''targetLine'')' END AS content FROM placed)"""


def part(value: str, width: int) -> str:
    return f"lpad(cast({value} AS varchar), {width}, '0')"


DURATION = (
    f"{part('duration_ms // 3600000 % 24', 2)} || ':' || {part('duration_ms // 60000 % 60', 2)} || ':' || "
    f"{part('duration_ms // 1000 % 60', 2)} || '.' || {part('duration_ms % 1000', 3)}"
)
STAMP = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%fZ')"

JOB_PARTS = ALL_USAGES + """,
job_projects AS (SELECT DISTINCT job_id, project_name FROM {jobs} JOIN {projects} USING (solution)),
job_errors AS (SELECT job_id, 'Project ' || project_name || ': ' || error AS error FROM {jobs} JOIN {project_errors} USING (solution))"""


def totals(analyses: str, usages: str) -> str:
    return f"""summaries AS (SELECT a.*, coalesce(u.n, 0) AS total_usage_count, coalesce(p.n, 0) AS analyzed_project_count,
  coalesce(e.n, 0) AS error_count FROM {analyses} a
  LEFT JOIN (SELECT job_id, count(*) AS n FROM {usages} GROUP BY job_id) u USING (job_id)
  LEFT JOIN (SELECT job_id, count(*) AS n FROM job_projects GROUP BY job_id) p USING (job_id)
  LEFT JOIN (SELECT job_id, count(*) AS n FROM job_errors GROUP BY job_id) e USING (job_id))"""


def report_parts(usages: str, item: str) -> str:
    """Rows of a report; ``heads`` holds the head objects."""
    place = "concat_ws('|', project_name, file_path, " + f"{part('start_line', 10)}, {part('end_line', 10)}, usage_type, symbol_name)"
    return f"""SELECT job_id, 0 AS part, '' AS position, head AS json FROM heads
  UNION ALL SELECT job_id, 1, project_name, to_json(project_name)::VARCHAR FROM job_projects
  UNION ALL SELECT job_id, 2, {place}, to_json({item})::VARCHAR FROM {usages}
  UNION ALL SELECT job_id, 3, error, to_json(error)::VARCHAR FROM job_errors"""


def document_lines(parts: str, pascal: bool) -> str:
    """Lines of one document per job, from the rows of ``parts``."""
    names = ["AnalyzedProjects", "Usages", "Errors"] if pascal else ["analyzedProjects", "usages", "errors"]
    head = "head[:-2]" if pascal else """'{"summary":' || head"""
    frame = [f"SELECT job_id, 0 AS part, 0 AS slot, '' AS position, '' AS json, {head} AS text FROM heads"]
    for i, name in enumerate(names, 1):
        frame.append(f"""SELECT job_id, {i}, 0, '', '', ',"{name}":[' FROM heads""")
        frame.append(f"SELECT job_id, {i}, 2, '', '', '{']' if i < 3 else ']}'}' FROM heads")
    return f""", parts AS ({parts}) {" UNION ALL ".join(frame)}
  UNION ALL SELECT job_id, part, 1, position, json, CASE WHEN row_number() OVER (PARTITION BY job_id, part ORDER BY position, json) = 1
    THEN json ELSE ',' || json END FROM parts JOIN heads USING (job_id) WHERE part > 0"""


NINE = (
    "{'projectName': project_name, 'filePath': file_path, 'startLine': start_line, 'endLine': end_line, "
    "'codeText': code_text, 'usageType': lower(usage_type[1:1]) || usage_type[2:], 'symbolName': symbol_name, "
    "'namespace': namespace, 'assemblyName': assembly_name}"
)
TWELVE = (
    "{'ProjectName': project_name, 'FilePath': file_path, 'StartLine': start_line, 'EndLine': end_line, "
    "'CodeText': code_text, 'Type': usage_type, 'SymbolName': symbol_name, 'Namespace': namespace, "
    "'AssemblyName': assembly_name, 'ContextStartLine': 0, 'ContextEndLine': 0, 'HasContext': false}"
)
HEAD_FIELDS = (
    f"'analyzedAt': {STAMP.format('analyzed_at')}, 'analysisDuration': {DURATION}, 'totalUsageCount': total_usage_count, "
    "'analyzedProjectCount': analyzed_project_count, 'errorCount': error_count"
)

MATCHED_SYMBOLS = """hits AS (SELECT t.job_id, r.* FROM {symbol_refs} r JOIN {targets} t
  ON r.namespace = t.target OR r.display_name = t.target OR starts_with(lower(r.namespace), lower(t.target) || '.'))"""

FOUND_SYMBOLS = f"""classified AS (SELECT *, {CLASSIFIED} AS usage_type FROM {{symbol_refs}}),
found AS (SELECT t.job_id, r.* FROM classified r JOIN {{symbol_jobs}} t ON t.solution = r.solution AND (r.namespace = t.target
  OR r.display_name = t.target OR starts_with(lower(r.namespace), lower(t.target) || '.')) WHERE usage_type IS NOT NULL),
job_projects AS (SELECT DISTINCT job_id, project_name FROM {{symbol_jobs}} JOIN {{projects}} USING (solution)),
job_errors AS (SELECT job_id, 'Project ' || project_name || ': ' || error AS error FROM {{symbol_jobs}}
  JOIN {{project_errors}} USING (solution)),
started AS (SELECT s.*, a.analyzed_at, a.duration_ms FROM {{symbol_jobs}} s JOIN (SELECT solution, max(analyzed_at) AS analyzed_at,
  max(duration_ms) AS duration_ms FROM {{analyses}} GROUP BY solution) a USING (solution)),
{totals("started", "found")}"""

RESOLVED = """listing AS (SELECT DISTINCT lower(package) AS package, lower(version) AS version,
  lower(regexp_replace(regexp_extract(path, '([^/]*)$'), '\\.[^.]*$', '')) AS assembly_lc FROM {package_files}
  WHERE CASE WHEN from_archive THEN regexp_matches(path, '^(lib|ref)/', 'i') ELSE path LIKE 'lib/%' END AND lower(path) LIKE '%.dll'),
loose AS (SELECT DISTINCT r.solution, j.package, lower(regexp_replace(regexp_extract(r.path, '([^/]*)$'), '\\.[^.]*$', '')) AS assembly_lc
  FROM {reference_paths} r JOIN (SELECT DISTINCT package FROM {jobs}) j
  ON contains(lower(r.path), lower(j.package)) AND contains(lower(r.path), 'packages')),
wanted AS (SELECT DISTINCT solution, package, version FROM {jobs}),
tiers AS (SELECT w.*, assembly_lc, 1 AS tier FROM wanted w JOIN loose USING (solution, package)
  UNION ALL SELECT w.*, l.assembly_lc, 2 FROM wanted w JOIN listing l ON l.package = lower(w.package) AND l.version = lower(w.version)
  UNION ALL SELECT w.*, lower(w.package), 3 FROM wanted w),
resolved AS (SELECT * FROM tiers QUALIFY tier = min(tier) OVER (PARTITION BY solution, package, version))"""

SHIPPED_TYPES = (
    "'MethodInvocation','PropertyAccess','TypeReference','FieldAccess','ParameterType','Attribute','Direct',"
    "'VariableDeclaration','GenericTypeArgument'"
)
KEY = "solution || '|' || package || '|' || version || '|' || strftime(mtime, '%Y-%m-%dT%H:%M:%S.%f') || '0Z|context:'"
SETTINGS = (
    "|types:Attribute,Direct,FieldAccess,GenericTypeArgument,MethodInvocation,ParameterType,PropertyAccess,TypeReference,"
    "VariableDeclaration|similarity:CommentRemover>WhitespaceNormalizer~LevenshteinDistanceComparison(3,0.9)"
)


def analysis(matched: str) -> str:
    """Context of one line, greedy filter (comments first), then the shipped usage types."""
    return f"""with_job AS ({matched}),
raw_usages AS (SELECT * FROM (SELECT *, {CLASSIFIED} AS usage_type FROM with_job) WHERE usage_type IS NOT NULL),
{context("raw_usages", "{ref_files}", "1")},
all_usages AS (SELECT * REPLACE (content AS code_text) FROM ctx),
{greedy("all_usages", comments_first("code_text"))}
SELECT job_id, project_name, file_path, start_line, usage_type, symbol_name, code_text, first_line AS context_start_line,
  last_line AS context_end_line, status = 'ok' AS has_context FROM kept WHERE usage_type IN ({SHIPPED_TYPES})"""


RULES = """lines AS (SELECT file_path, unnest(string_split(text, chr(10))) AS line,
  unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM {manifests}),
violations AS (
  SELECT file_path, 'Ad' AS "check", 'shows an ad' AS detail FROM {manifests}
    WHERE regexp_matches(file_path, '\\.(csproj|targets|props)$') AND regexp_matches(text, '<!-- ad [0-3]')
  UNION ALL SELECT file_path, 'Script', 'runs a script' FROM {manifests}
    WHERE regexp_matches(file_path, '\\.(csproj|targets|props)$') AND contains(lower(text), '<script')
  UNION ALL SELECT file_path, 'Link', no || ':' || line FROM lines
    WHERE regexp_matches(file_path, '\\.(csproj|targets|props)$') AND regexp_matches(line, '<a [^>]*href="[^"]*(er|tion)[^"]*"', 'i')
  UNION ALL SELECT file_path, 'T4', 'template present' FROM {manifests} WHERE file_path LIKE '%.tt'
  UNION ALL SELECT file_path, 'InstallScript', 'install script present' FROM {manifests} WHERE file_path ILIKE '%/install.ps1')"""

LEXICAL = [
    ("UsingDirective", r"^\s*using\s+([A-Za-z_][A-Za-z0-9_.]*)\s*;"),
    ("QualifiedName", r"([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)"),
    ("Invocation", r"([A-Za-z_][A-Za-z0-9_]*)\("),
    ("GenericName", r"([A-Za-z_][A-Za-z0-9_]*)<[A-Za-z_]"),
    ("AttributeList", r"\[([A-Za-z_][A-Za-z0-9_.]*)"),
    ("IdentifierName", r"([A-Za-z_][A-Za-z0-9_]*)"),
]
LINES = """split AS (SELECT file_path, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS a FROM {source_files}),
numbered AS (SELECT file_path, unnest(a) AS line, unnest(range(1, len(a) + 1))::INT AS line_no FROM split)"""

_SQL = {
    "drop_binary": f"""SELECT project_name, file_path FROM {{source_files}}
        WHERE lower(regexp_extract(file_path, '(\\.[^./]*)$')) NOT IN ({BINARY})""",
    "source_lines": f"WITH {LINES} SELECT file_path, line_no, line FROM numbered",
    "batch_jobs": """SELECT solution, package, version, force_refresh, solution || '|' || package || '|' || version AS job_id FROM (
        SELECT c_name AS solution, c_mktsegment AS package,
          CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 5) || '.0' ELSE '1' END AS version,
          c_custkey % 2 = 0 AND c_custkey % 3 = 0 AS force_refresh FROM customer
        UNION ALL SELECT c_name, 'Other', '2', true FROM customer WHERE c_custkey % 2 = 1)""",
    "declared_refs": """SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS package FROM pages""",
    "package_assemblies": f"WITH {RESOLVED} SELECT package, version, assembly_lc FROM listing",
    "project_inventory": """SELECT solution, project_name, count(DISTINCT file_path) AS documents FROM {source_files}
        GROUP BY solution, project_name""",
    "save_load_results": f"""WITH {ALL_USAGES}
        SELECT u.job_id, sha256({KEY} || '0') AS fingerprint, project_name, file_path, start_line, usage_type, code_text
        FROM job_usages u JOIN {{jobs}} j USING (job_id) JOIN {{source_state}} s ON s.solution = j.solution WHERE NOT force_refresh""".replace(
        "sha256(solution", "sha256(j.solution"
    ),
    "invalidate_results": f"""WITH {ALL_USAGES}, counts AS (SELECT job_id, count(*) AS n FROM job_usages GROUP BY job_id)
        SELECT j.job_id, sha256({KEY} || '0') AS fingerprint, coalesce(n, 0) AS usage_count, coalesce(n, 0) AS rows_left
        FROM {{jobs}} j JOIN {{source_state}} s USING (solution) LEFT JOIN counts USING (job_id) WHERE NOT force_refresh""",
    "lexical_refs": f"WITH {LINES} "
    + "SELECT file_path, node_kind, name, count(*) AS n FROM ("
    + " UNION ALL ".join(
        f"SELECT file_path, '{k}' AS node_kind, unnest(regexp_extract_all(line, '{p}', 1)) AS name FROM numbered" for k, p in LEXICAL
    )
    + ") GROUP BY file_path, node_kind, name",
    "bind_imports": """WITH lexical AS (SELECT solution, file_path, start_line AS line_no, node_kind,
          CASE WHEN node_kind IN ('QualifiedName', 'MemberAccess') THEN display_name || '.Run' ELSE symbol_name END AS name
          FROM {symbol_refs} WHERE node_kind <> 'UsingDirective'),
        imports AS (SELECT DISTINCT solution, file_path, namespace FROM {symbol_refs} WHERE node_kind = 'UsingDirective'),
        catalog AS (SELECT p_brand || '.' || p_type AS namespace, replace(p_name, ' ', '_') AS symbol_name,
          min(p_brand) AS assembly_name FROM part GROUP BY 1, 2)
        SELECT l.solution, l.file_path, line_no, node_kind, name, c.namespace, c.symbol_name, c.assembly_name
          FROM lexical l JOIN imports i ON i.solution = l.solution AND i.file_path = l.file_path
          JOIN catalog c ON c.namespace = i.namespace AND c.symbol_name = l.name WHERE NOT contains(name, '.')
        UNION ALL SELECT l.solution, l.file_path, line_no, node_kind, name, c.namespace, c.symbol_name, c.assembly_name
          FROM lexical l JOIN catalog c ON l.name = c.namespace || '.' || c.symbol_name || '.Run'
          WHERE contains(name, '.')""",
    "lexical_analysis": r"""WITH numbered AS (SELECT solution, project_name, file_path, i AS line_no, a[i] AS line FROM
          (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS a FROM {code_files}))),
        found AS (
          SELECT solution, project_name, file_path, 'UsingDirective' AS usage_type, regexp_extract(line, 'using\s+([A-Za-z0-9_.]+);', 1) AS name
            FROM numbered WHERE line_no = 1
          UNION ALL SELECT solution, project_name, file_path, 'MethodInvocation', unnest(regexp_extract_all(line, '([A-Za-z_][A-Za-z0-9_]*)\(', 1))
            FROM numbered WHERE line_no > 1
          UNION ALL SELECT solution, project_name, file_path, 'Direct', unnest(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*'))
            FROM numbered WHERE line_no > 1),
        symbols AS (
          SELECT solution, project_name, file_path, usage_type, regexp_extract(name, '^(.*)\.', 1) AS namespace, name AS display_name
            FROM found WHERE usage_type = 'UsingDirective'
          UNION ALL SELECT f.solution, f.project_name, f.file_path, f.usage_type, c.namespace, c.namespace || '.' || c.symbol_name FROM found f
            JOIN found i ON i.solution = f.solution AND i.file_path = f.file_path AND i.usage_type = 'UsingDirective'
            JOIN {code_catalog} c ON c.namespace = i.name AND c.symbol_name = f.name WHERE f.usage_type <> 'UsingDirective')
        SELECT t.job_id, project_name, usage_type, count(*) AS usages FROM symbols s JOIN {code_targets} t
          ON s.namespace = t.target OR s.display_name = t.target OR starts_with(lower(s.namespace), lower(t.target) || '.')
        GROUP BY ALL""",
    "generic_fanout": """SELECT project_name, file_path, start_line, 'TypeReference' AS usage_type, symbol_name, assembly_name, code_text
          FROM {generic_refs}
        UNION ALL SELECT project_name, file_path, start_line, 'GenericTypeArgument', arg_symbol, arg_assembly, arg_text
          FROM {generic_refs} WHERE node_kind = 'GenericName'""",
    "classify_usage": f"""WITH {ALL_USAGES}
        SELECT file_path, start_line, node_kind, parent_kind, symbol_kind, symbol_name, usage_type FROM solution_usages""",
    "match_assembly": """SELECT j.job_id, project_name, file_path, start_line, assembly_name, code_text FROM {symbol_refs} r
        JOIN {job_sets} j ON j.solution = r.solution AND j.assembly_lc = lower(r.assembly_name)""",
    "match_symbol": f"""WITH {MATCHED_SYMBOLS}
        SELECT job_id, project_name, file_path, start_line, namespace, display_name, code_text FROM hits""",
    "usage_type_filter": f"""WITH {ALL_USAGES}
        SELECT job_id, project_name, file_path, start_line, usage_type, code_text FROM solution_usages
        WHERE usage_type IN ({SHIPPED_TYPES})""",
    "symbol_contains": f"""WITH {ALL_USAGES}
        SELECT job_id, file_path, start_line, symbol_name, code_text FROM solution_usages WHERE contains(symbol_name, 'bolt')""",
    "assemblies_from_paths": f"""WITH {RESOLVED},
        strict AS (SELECT DISTINCT r.solution, j.package, lower(regexp_replace(regexp_extract(r.path, '([^/]*)$'), '\\.[^.]*$', '')) AS assembly_lc
          FROM {{reference_paths}} r JOIN (SELECT DISTINCT package FROM {{jobs}}) j
          ON list_contains(string_split(lower(r.path), '/'), lower(j.package)))
        SELECT *, false AS strict FROM loose UNION ALL SELECT *, true FROM strict""",
    "resolve_assemblies": f"WITH {RESOLVED} SELECT solution, package, version, assembly_lc, tier FROM resolved",
    "batch_usages": f"WITH {ALL_USAGES} SELECT job_id, count(*) AS usages FROM job_usages GROUP BY job_id",
    "unused_packages": f"""WITH declared AS (SELECT DISTINCT solution, project_name,
          regexp_extract(text, 'Include="([^"]*)"', 1) AS package, regexp_extract(text, 'Version="([^"]*)"', 1) AS version
          FROM {{project_manifests}}),
        {RESOLVED.replace("{jobs}", "declared")}
        SELECT * FROM declared EXCEPT SELECT r.solution, r.project_name, a.package, a.version
          FROM (SELECT *, {CLASSIFIED} AS usage_type FROM {{symbol_refs}}) r
          JOIN resolved a ON a.solution = r.solution AND a.assembly_lc = lower(r.assembly_name) WHERE usage_type IS NOT NULL""",
    "context_snippet": f"""WITH {context("{doc_usages}", "{source_files}", "context_lines")}
        SELECT event_id, file_path, start_line, first_line AS context_start_line, last_line AS context_end_line,
          status = 'ok' AS has_context, content AS code_text FROM ctx""",
    "context_status": f"""WITH {context("{doc_usages}", "{source_files}", "context_lines")}
        SELECT DISTINCT file_path, start_line, context_lines, first_line, last_line, truncated, status FROM ctx""",
    "context_window": f"""WITH s AS (SELECT solution, file_path, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS a FROM {{source_files}}
          WHERE lower(regexp_extract(file_path, '(\\.[^./]*)$')) NOT IN ({BINARY})),
        n AS (SELECT file_path, unnest(a) AS line, unnest(range(1, len(a) + 1))::INT AS line_no FROM s)
        SELECT file_path, line_no, string_agg(line, chr(10)) OVER (PARTITION BY file_path ORDER BY line_no
          ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS content FROM n""",
    "marked_context": f"""WITH {ALL_USAGES}, {context("solution_usages", "{ref_files}", "1")}
        SELECT project_name, file_path, start_line, end_line, symbol_name, CASE WHEN status = 'ok' AND contains(content, chr(10)) THEN
          array_to_string(list_transform(range(first_line, last_line + 1), lambda i:
            CASE WHEN i BETWEEN start_line AND end_line THEN '>>>' ELSE '   ' END || ' ' || lpad(i::VARCHAR, 4, ' ') || ': ' ||
            regexp_split_to_array(content, '\\r\\n|\\r|\\n')[i - first_line + 1]), chr(10))
          ELSE 'Code: ' || content END AS printed FROM ctx""",
    "normalize_ws": f"SELECT p_partkey, {squeeze('code_text')} AS text FROM {{commented_code}}",
    "strip_comments": f"SELECT p_partkey, {strip('code_text')} AS text FROM {{commented_code}}",
    "simplify_text": f"""SELECT p_partkey, {shipped("code_text")} AS shipped, {comments_first("code_text")} AS comments_first
        FROM {{commented_code}}""",
    "levenshtein_similar": f"""SELECT l_orderkey, l_linenumber, code_text, next_text, {similar("code_text", "next_text")} AS similar
        FROM {{snippet_pairs}}""",
    "similar_pairs": f"""SELECT l_orderkey, l_linenumber, code_text, next_text,
        {similar(shipped("code_text"), shipped("next_text"))} AS similar FROM {{snippet_pairs}}""",
    "exact_dedup": f"""WITH {ALL_USAGES}, texts AS (SELECT *, {shipped("code_text")} AS txt FROM solution_usages)
        SELECT job_id, project_name, file_path, start_line, usage_type, code_text FROM texts
        QUALIFY row_number() OVER (PARTITION BY job_id, txt ORDER BY {ORDER}) = 1""",
    "near_dedup": f"""WITH {ALL_USAGES}, {greedy("solution_usages", shipped("code_text"))}
        SELECT job_id, project_name, file_path, start_line, usage_type, code_text FROM kept""",
    "near_dedup_default": f"""WITH {ALL_USAGES}, {greedy("solution_usages", comments_first("code_text"), 10, 0.8)}
        SELECT job_id, project_name, file_path, start_line, usage_type, code_text FROM kept""",
    "registered_plugins": f"""WITH {ALL_USAGES}, texts AS (SELECT *, regexp_replace(code_text, '[0-9]', '', 'g') AS txt FROM solution_usages),
        made AS (SELECT *, array_to_string(list_sort(list_distinct(string_split(txt, ''))), '') AS chars FROM texts),
        sizes AS (SELECT job_id, txt, chars, count(*) AS copies FROM made GROUP BY ALL),
        firsts AS (SELECT job_id, chars, txt AS kept_text FROM made
          QUALIFY row_number() OVER (PARTITION BY job_id, chars ORDER BY {ORDER}) = 1)
        SELECT s.job_id, txt AS text, kept_text, copies FROM sizes s JOIN firsts f ON f.job_id = s.job_id AND f.chars = s.chars""",
    "dedup_groups": f"""WITH {ALL_USAGES}, {greedy("solution_usages", shipped("code_text"))},
        sizes AS (SELECT job_id, txt, count(*) AS copies FROM texts GROUP BY job_id, txt)
        SELECT s.job_id, s.txt AS text, (list_filter(f.kept, lambda k: {similar("k", "s.txt")}))[1] AS kept_text, s.copies
        FROM sizes s JOIN folded f USING (job_id)""",
    "usage_by_project": f"""WITH {ALL_USAGES} SELECT job_id, project_name, count(*) AS usages FROM job_usages GROUP BY ALL""",
    "usage_by_project_type": f"""WITH {ALL_USAGES}
        SELECT job_id, project_name, usage_type, count(*) AS usages FROM job_usages GROUP BY ALL""",
    "usage_rollup": f"""WITH {ALL_USAGES}
        SELECT job_id, project_name, usage_type, grouping(job_id, project_name, usage_type)::INT AS level, count(*) AS usages
        FROM job_usages GROUP BY GROUPING SETS ((job_id), (job_id, project_name), (job_id, project_name, usage_type))""",
    "summary": f"""WITH {JOB_PARTS}, {totals("{analyses}", "job_usages")} SELECT *, {DURATION} AS duration FROM summaries""",
    "merge_results": f"""WITH {ALL_USAGES}
        SELECT u.job_id, 'usages' AS kind, count(*) AS n FROM solution_usages u LEFT JOIN {{project_errors}} e
          ON e.solution = u.solution AND e.project_name = u.project_name WHERE e.error IS NULL GROUP BY u.job_id
        UNION ALL SELECT job_id, 'projects', count(DISTINCT project_name) FROM (SELECT job_id, project_name FROM solution_usages
          UNION ALL SELECT solution, project_name FROM {{project_errors}}) GROUP BY job_id
        UNION ALL SELECT DISTINCT solution, 'Project ' || project_name || ': ' || error, 1 FROM {{project_errors}}""",
    "batch_outcome": f"""WITH {JOB_PARTS}, r AS (SELECT job_id, job_id NOT IN (SELECT job_id FROM job_errors) AS success FROM {{jobs}}),
        c AS (SELECT job_id, count(*) AS n FROM job_usages GROUP BY job_id)
        SELECT count(*) AS total_jobs, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed,
          coalesce(sum(CASE WHEN success THEN coalesce(n, 0) END), 0)::BIGINT AS usages FROM r LEFT JOIN c USING (job_id)""",
    "usage_spread": f"""WITH {ALL_USAGES} SELECT job_id, count(*) AS usages, count(DISTINCT file_path) AS files,
        count(DISTINCT project_name) AS projects, count(DISTINCT symbol_name) AS symbols FROM job_usages GROUP BY job_id""",
    "usage_spread_union": f"""WITH {ALL_USAGES} SELECT package, count(*) AS usages, count(DISTINCT file_path) AS files,
        count(DISTINCT project_name) AS projects, count(DISTINCT symbol_name) AS symbols, count(*) AS merged, true AS files_near,
        true AS projects_near, true AS symbols_near FROM job_usages u JOIN {{jobs}} j USING (job_id) JOIN {{source_state}} s ON s.solution = j.solution
        GROUP BY package""",
    "usage_spread_approx": f"""WITH {ALL_USAGES} SELECT job_id, count(*) AS usages, count(DISTINCT file_path) AS files,
        count(DISTINCT project_name) AS projects, count(DISTINCT symbol_name) AS symbols, true AS files_near, true AS projects_near,
        true AS symbols_near FROM job_usages GROUP BY job_id""",
    "detailed_report": f"""WITH {ALL_USAGES} SELECT job_id, project_name, file_path, start_line, end_line, usage_type, symbol_name,
        namespace, code_text FROM job_usages ORDER BY job_id, {ORDER}""",
    "report_json": f"""WITH {JOB_PARTS}, {totals("{analyses}", "job_usages")},
        heads AS (SELECT job_id, to_json({{'solutionPath': solution, 'packageName': package,
          'packageVersion': version, {HEAD_FIELDS}}})::VARCHAR AS head FROM summaries)
        {report_parts("job_usages", NINE)}""",
    "report_documents": f"""WITH {JOB_PARTS}, {totals("{analyses}", "job_usages")},
        heads AS (SELECT job_id, to_json({{'solutionPath': solution, 'packageName': package,
          'packageVersion': version, {HEAD_FIELDS}}})::VARCHAR AS head FROM summaries){document_lines(report_parts("job_usages", NINE), False)}""",
    "result_documents": f"""WITH {JOB_PARTS}, {totals("{analyses}", "job_usages")},
        heads AS (SELECT job_id, to_json({{'SolutionPath': solution, 'PackageName': package, 'PackageVersion': version,
          'AnalyzedAt': {STAMP.format("analyzed_at")}, 'AnalysisDuration': {DURATION},
          'TotalUsageCount': total_usage_count}})::VARCHAR AS head FROM summaries){document_lines(report_parts("job_usages", TWELVE), True)}""",
    "symbol_report_json": f"""WITH {FOUND_SYMBOLS},
        heads AS (SELECT job_id, to_json({{'solutionPath': solution, 'targetSymbol': target,
          {HEAD_FIELDS}}})::VARCHAR AS head FROM summaries)
        {report_parts("found", NINE)}""",
    "result_json": f"""WITH {JOB_PARTS}, {totals("{analyses}", "job_usages")},
        heads AS (SELECT job_id, to_json({{'SolutionPath': solution, 'PackageName': package, 'PackageVersion': version,
          'AnalyzedAt': {STAMP.format("analyzed_at")}, 'AnalysisDuration': {DURATION},
          'TotalUsageCount': total_usage_count}})::VARCHAR AS head FROM summaries)
        {report_parts("job_usages", TWELVE)}""",
    "symbol_result_json": f"""WITH {FOUND_SYMBOLS},
        heads AS (SELECT job_id, to_json({{'SolutionPath': solution, 'PackageName': 'symbol:' || target, 'PackageVersion': 'N/A',
          'AnalyzedAt': {STAMP.format("analyzed_at")}, 'AnalysisDuration': {DURATION},
          'TotalUsageCount': total_usage_count}})::VARCHAR AS head FROM summaries)
        {report_parts("found", TWELVE)}""",
    "error_report": f"""SELECT job_id, to_json({{'error': error, 'solutionPath': a.solution, 'packageName': package,
        'packageVersion': version, 'timestamp': {STAMP.format("analyzed_at")}}})::VARCHAR AS json
        FROM {{analyses}} a JOIN {{project_errors}} e ON e.solution = a.solution""",
    "fingerprint": f"""SELECT job_id, sha256({KEY} || '0') AS fingerprint, sha256({KEY} || '1{SETTINGS}') AS with_settings
        FROM {{jobs}} LEFT JOIN {{source_state}} USING (solution)""",
    "jobs_to_run": """SELECT job_id, CASE WHEN force_refresh AND mtime IS NOT NULL THEN 'reuse' ELSE 'run' END AS action
        FROM {jobs} LEFT JOIN {source_state} USING (solution)""",
    "changed_files": """SELECT 'orders' AS solution, 'src/' || l_orderkey || '.cs' AS file_path, max(l_shipdate) AS mtime
        FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey
        HAVING max(l_shipdate) > max(o_orderdate) OR max(o_orderdate) IS NULL""",
    "snapshot_diff": """SELECT coalesce(b.solution, a.solution) AS solution, coalesce(b.file_path, a.file_path) AS file_path,
        CASE WHEN b.file_path IS NULL THEN 'added' WHEN a.file_path IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM {files_before} b FULL JOIN {files_after} a ON a.solution = b.solution AND a.file_path = b.file_path
        WHERE a.file_path IS NULL OR b.file_path IS NULL OR a.text <> b.text""",
    "declared_tree": """WITH own AS (SELECT *, CASE style WHEN 0 THEN '1.0' WHEN 1 THEN '2.0' WHEN 2 THEN '3.0' WHEN 5 THEN '5.0' END AS given FROM {tree_packages}),
        shared AS (SELECT DISTINCT solution, package FROM own WHERE package LIKE 'ECONOMY%'),
        projects AS (SELECT DISTINCT solution, area, area_key, project_name FROM own),
        every AS (SELECT solution, area, area_key, project_name, package, given, 'own' AS origin, style FROM own WHERE style IN (0, 1, 2, 3, 5)
          UNION ALL SELECT p.solution, p.area, p.area_key, p.project_name, s.package, CASE WHEN o.style = 6 THEN '6.0' END, 'shared', o.style
          FROM projects p JOIN shared s ON s.solution = p.solution
          LEFT JOIN own o ON o.solution = p.solution AND o.project_name = p.project_name AND o.package = s.package
          WHERE o.style IS NULL OR o.style IN (4, 6))
        SELECT solution, project_name, 'src/' || area || '/' || project_name || '/' || project_name || '.csproj' AS file_path,
        CASE WHEN style = 3 THEN lower(package) ELSE package END AS package,
        coalesce(given, CASE WHEN package LIKE 'ECONOMY%' THEN '4.0' WHEN area_key % 2 = 0 THEN '7.0' WHEN package NOT LIKE 'PROMO%' THEN '8.0' ELSE '' END) AS version,
        origin FROM every""",
    "near_dedup_tokens": of_orders("code_text", "len(list_intersect(WORDS(k), WORDS(t[1])))::DOUBLE / "
        "(len(WORDS(k)) + len(WORDS(t[1])) - len(list_intersect(WORDS(k), WORDS(t[1])))) >= 0.8".replace("WORDS(k)", SPLIT.format("k")).replace("WORDS(t[1])", SPLIT.format("t[1]"))),
    "near_dedup_unlike": of_orders("tagged", similar("k", "t[1]")),
    "rule_scan": f"""WITH {RULES} SELECT file_path, "check", detail FROM violations""",
    "scan_summary": f"""WITH {RULES} SELECT count(*) FILTER (regexp_matches(file_path, '\\.(csproj|targets|props)$')) AS manifests,
        count(*) FILTER (file_path LIKE '%.tt') AS templates, count(*) FILTER (file_path ILIKE '%/install.ps1') AS install_scripts,
        (SELECT count(*) FROM violations) AS violations, (SELECT count(*) FROM violations) = 0 AS clean FROM {{manifests}}""",
    "expectations": """SELECT check_name, lo, hi, coalesce(n, 0) AS n, coalesce(n, 0) BETWEEN lo AND hi AS passed FROM
        (VALUES ('Brand#1.ECONOMY', 1, 1000000), ('Brand#2.SMALL', 0, 3), ('Nowhere', 0, 0), ('Nobody', 1, 5)) v(check_name, lo, hi)
        LEFT JOIN (SELECT namespace AS check_name, count(*) AS n FROM {symbol_refs} GROUP BY namespace) USING (check_name)""",
    "package_report_e2e": f"""WITH {RESOLVED},
        found AS (SELECT * FROM (SELECT j.job_id, r.*, {CLASSIFIED} AS usage_type FROM {{symbol_refs}} r JOIN resolved a
          ON a.solution = r.solution AND a.assembly_lc = lower(r.assembly_name) JOIN {{jobs}} j ON j.solution = a.solution
          AND j.package = a.package AND j.version = a.version) WHERE usage_type IS NOT NULL),
        job_projects AS (SELECT DISTINCT job_id, project_name FROM {{jobs}} JOIN {{projects}} USING (solution)),
        job_errors AS (SELECT job_id, 'Project ' || project_name || ': ' || error AS error FROM {{jobs}} JOIN {{project_errors}} USING (solution)),
        {totals("{jobs}", "found")},
        heads AS (SELECT job_id, to_json({{'solutionPath': solution, 'packageName': package, 'packageVersion': version,
          'totalUsageCount': total_usage_count, 'analyzedProjectCount': analyzed_project_count,
          'errorCount': error_count}})::VARCHAR AS head FROM summaries)
        {report_parts("found", NINE)}""",
    "package_analysis": f"WITH {RESOLVED}, "
    + analysis(
        """SELECT j.job_id, r.* FROM {symbol_refs} r JOIN resolved a ON a.solution = r.solution AND a.assembly_lc = lower(r.assembly_name)
           JOIN {jobs} j ON j.solution = a.solution AND j.package = a.package AND j.version = a.version"""
    ),
    "symbol_analysis": "WITH "
    + analysis(
        """SELECT t.job_id, r.* FROM {symbol_refs} r JOIN {symbol_jobs} t ON t.solution = r.solution AND (r.namespace = t.target
           OR r.display_name = t.target OR starts_with(lower(r.namespace), lower(t.target) || '.'))"""
    ),
    "batch_analysis": f"""WITH {RESOLVED},
        with_job AS (SELECT j.job_id, r.* FROM {{symbol_refs}} r JOIN resolved a ON a.solution = r.solution
          AND a.assembly_lc = lower(r.assembly_name) JOIN {{jobs}} j ON j.solution = a.solution AND j.package = a.package AND j.version = a.version),
        all_usages AS (SELECT * FROM (SELECT *, {CLASSIFIED} AS usage_type FROM with_job) WHERE usage_type IS NOT NULL),
        {greedy("all_usages", comments_first("code_text"))},
        counts AS (SELECT job_id, count(*) AS n FROM kept WHERE usage_type IN ({SHIPPED_TYPES}) GROUP BY job_id)
        SELECT job_id, true AS success, NULL::VARCHAR AS error, coalesce(n, 0) AS usage_count FROM {{jobs}} LEFT JOIN counts USING (job_id)
        UNION ALL SELECT DISTINCT c_mktsegment || '|none', false, 'Solution not found: ' || c_mktsegment, NULL::BIGINT FROM customer""",
    "batch_isolated": f"""WITH {RESOLVED},
        with_job AS (SELECT j.job_id, r.* FROM {{symbol_refs}} r JOIN resolved a ON a.solution = r.solution
          AND a.assembly_lc = lower(r.assembly_name) JOIN {{jobs}} j ON j.solution = a.solution AND j.package = a.package AND j.version = a.version),
        all_usages AS (SELECT * FROM (SELECT *, {CLASSIFIED} AS usage_type FROM with_job) WHERE usage_type IS NOT NULL),
        {greedy("all_usages", comments_first("code_text"))},
        counts AS (SELECT job_id, count(*) AS n FROM kept WHERE usage_type IN ({SHIPPED_TYPES}) GROUP BY job_id),
        bad AS (SELECT DISTINCT job_id, 'text is not readable' AS error FROM all_usages
          WHERE file_path = (SELECT max(file_path) FROM {{symbol_refs}}))
        SELECT job_id, bad.error IS NULL AS success, bad.error, CASE WHEN bad.error IS NULL THEN coalesce(n, 0) END AS usage_count FROM {{jobs}} LEFT JOIN counts USING (job_id) LEFT JOIN bad USING (job_id)
        UNION ALL SELECT DISTINCT c_mktsegment || '|none', false, 'Solution not found: ' || c_mktsegment, NULL::BIGINT FROM customer""",
    "delta_analysis": f"""WITH {RESOLVED},
        found AS (SELECT * FROM (SELECT j.job_id, r.*, {CLASSIFIED} AS usage_type FROM {{refs_after}} r JOIN resolved a
          ON a.solution = r.solution AND a.assembly_lc = lower(r.assembly_name) JOIN {{jobs}} j ON j.solution = a.solution
          AND j.package = a.package AND j.version = a.version) WHERE usage_type IS NOT NULL)
        SELECT job_id, project_name, usage_type, count(*) AS n, count(*) AS merged FROM found GROUP BY ALL""",
    "incremental_analysis": f"""WITH {RESOLVED},
        found AS (SELECT * FROM (SELECT j.job_id, r.*, {CLASSIFIED} AS usage_type FROM {{symbol_refs}} r JOIN resolved a
          ON a.solution = r.solution AND a.assembly_lc = lower(r.assembly_name) JOIN {{jobs}} j ON j.solution = a.solution
          AND j.package = a.package AND j.version = a.version) WHERE usage_type IS NOT NULL),
        job_projects AS (SELECT DISTINCT job_id, project_name FROM {{jobs}} JOIN {{projects}} USING (solution)),
        job_errors AS (SELECT job_id FROM {{jobs}} JOIN {{project_errors}} USING (solution)),
        {totals("{jobs}", "found")}
        SELECT job_id, total_usage_count, analyzed_project_count, error_count FROM summaries""",
}

# The same rows from another store.
_SQL["context_chunks"] = _SQL["context_snippet"]

ORACLE = {name: with_views(sql) for name, sql in _SQL.items()}
