"""Regular expressions and fixed values.

Source text is UTF-8 in many languages, so character classes are spelled out as Unicode properties:
a word character is a letter, number or underscore, and white space includes the four ASCII
separators. Text that reaches these patterns has ``\\n`` as its only carriage-style line end.
"""

# Building blocks -------------------------------------------------------------------------------
# Classes list single characters where they can: Java tests those with one table lookup, while every
# range or property is one more call per character.
WORD = r"[a-zA-Z0-9_\p{L}\p{N}]"
SPACE = r"[ \t\n\x0b\f\r\x1c\x1d\x1e\x1f\p{IsWhite_Space}]"
NON_SPACE = r"[^ \t\n\x0b\f\r\x1c\x1d\x1e\x1f\p{IsWhite_Space}]"
BLANK = r"[ \t\x1f\p{Zs}]"  # white space that does not end a line
#: Characters that end a line besides ``\n``.
OTHER_EOL = r"[\x0b\f\r\x1c\x1d\x1e\x85\u2028-\u2029]"
WORD_START = rf"(?<!{WORD})"
WORD_END = rf"(?!{WORD})"

# Object references, on texts whose lines all end in \n -------------------------------------------
LINE_COMMENT = r"(?:#|--)[^\n]*"
IMPORT_LINE = rf"(?md)^{BLANK}*(?:from{BLANK}+{NON_SPACE}+{BLANK}+import{WORD_END}|import{BLANK})"
IMPORT_LINE_BODY = rf"{IMPORT_LINE}[^\n]*"
CATALOG_REF = (
    rf"(?i)(?=[fjiutv]){WORD_START}(?:from|join|into|update|table|view){BLANK}+"
    rf"([A-Za-z_]{WORD}*(?:\.[A-Za-z_]{WORD}+){{1,2}})"
)
POLICY_REF = (
    rf"(?i)(?=[fjiumdtv]){WORD_START}(?:from|join|into|update|merge{BLANK}+into|delete{BLANK}+from|table|view){BLANK}+"
    rf"([`\"]?[A-Za-z_]{WORD}*[`\"]?(?:\.[`\"]?[A-Za-z_]{WORD}*[`\"]?){{1,2}})"
)
LAYER_DECLARATION = rf"(?md)^{SPACE}*#{SPACE}*LAYER{SPACE}*[:=]{SPACE}*([A-Za-z_][A-Za-z0-9_$]*)"

# Documentation ---------------------------------------------------------------------------------
DOC_JOB_TITLE = rf"(?md)^#{SPACE}*Job:{SPACE}*(.+)$"
DOC_TITLE = rf"(?md)^#{SPACE}+(.+)$"
DOC_LABEL = rf"(?md)^\*\*([^\n]*?)\*\*:(?={SPACE}*{NON_SPACE})"
HEADER_FIELD = rf"(?md)^#{SPACE}*(STATUS|LAST_UPDATED){SPACE}*[:=]{SPACE}*(.+)$"
HEADER_KEY = rf"(?md)^#{SPACE}*(?=([^\n:=]*?){SPACE}*[:=])"

# Installs --------------------------------------------------------------------------------------
PIP_INSTALL = r"(?imd)^[ \t]*(?:#[ \t]*MAGIC[ \t]+)?%?pip[ \t]+install[ \t]+(.*)"
PIP_PINNED = r"^([A-Za-z0-9_.\[\]-]+)==([0-9][A-Za-z0-9.]*)$"
PIP_NAME = r"^[A-Za-z0-9_.\[\]-]+$"

#: Lines of a notebook that are no Python: shell and package commands.
MAGIC_LINE = r"(?md)^[ \t\f]*(?:[%!]|pip install(?![A-Za-z0-9_])).*$"

# What a denied schema may consist of, so that it can be looked for as a whole word.
IDENTIFIER = r"\A[a-zA-Z0-9_$\p{L}\p{N}]+\z"

# Keys ------------------------------------------------------------------------------------------
DEFAULT_JOB_KEY = r"[A-Z][A-Z0-9]+-\p{Nd}+"

# Secret shapes, (label, text every match contains, pattern). Shapes only, never values.
# Looking for the fixed text first keeps the patterns off almost all lines. One character before the
# ``@`` is enough to know that there is an address.
SECRET_SHAPES = [
    ("cloud account ID", "", rf"(?=[0-9]{{12}}){WORD_START}[0-9]{{12}}{WORD_END}"),
    ("AWS access key ID", "AKIA", r"AKIA[0-9A-Z]{16}"),
    ("Slack token", "xox", r"xox[baprs]-[0-9A-Za-z-]{10,}"),
    ("GitHub PAT", "gh", r"gh[pousr]_[A-Za-z0-9]{36}"),
    ("Slack channel/user ID", "C0", rf"(?=C0){WORD_START}C0[0-9A-Z]{{8,}}{WORD_END}"),
    ("private key", "PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("local home path", "/Users/", r"/Users/[a-z][a-z0-9._-]*/"),
    (
        "email address",
        "@",
        rf"[a-zA-Z0-9._%+-]@(?!example\.(?:com|org|net){WORD_END})(?!test{WORD_END})(?!invalid{WORD_END})"
        rf"(?!localhost{WORD_END})[a-zA-Z0-9-]+\.[a-zA-Z]{{2,}}",
    ),
    (
        "non-placeholder ticket key",
        "-",
        rf"(?=[A-Z]{{2,6}}-[0-9]){WORD_START}(?!JOB-|DAG-|ABC-|ENG-|PROJ-)[A-Z]{{2,6}}-[0-9]{{1,5}}{WORD_END}",
    ),
]

# File kinds and folders the secret scan leaves out.
BINARY_SUFFIXES = ["png", "jpg", "jpeg", "gif", "ico", "pdf", "whl", "gz", "zip"]
SCAN_SKIP_DIRS = [".git", "__pycache__", ".pytest_cache", ".ruff_cache", ".venv", "node_modules"]
# Folders that layout inference does not descend into (besides dot folders).
WALK_SKIP_DIRS = ["node_modules", "__pycache__", "venv", "dist", "build", "target"]

# Closed sets of the configuration.
PLATFORM_KINDS = ["databricks", "airflow", "dbt", "dagster", "prefect", "snowflake_tasks", "glue", "adf"]
DEPLOY_MODELS = ["api-reset", "git-sync", "sql-ddl"]
WAREHOUSE_DIALECTS = ["snowflake", "bigquery", "redshift", "postgres", "databricks-sql", "none"]
CONFIG_SCHEMA_VERSION = 1
STATUS_ORDER = ["ACTIVE", "TESTING", "DEPRECATED", "Unknown"]
DEFAULT_DOC_FIELDS = ["Purpose", "Schedule", "Business Owner"]
DEFAULT_HEADER_FIELDS = ["JOB", "TICKET", "PURPOSE", "STATUS"]
DEFAULT_DEPLOYABLE_DIRS = ["databricks/job_definitions/dev/", "databricks/job_definitions/prod/"]

# Platforms that have an adapter, (kind, deploy model, states of a run in progress).
ADAPTERS = [
    ("databricks", "api-reset", ["PENDING", "QUEUED", "BLOCKED", "RUNNING", "WAITING_FOR_RETRY", "TERMINATING"]),
    ("airflow", "git-sync", ["running"]),
    ("snowflake_tasks", "sql-ddl", ["EXECUTING"]),
    ("dbt", "git-sync", []),
]

# Fixed value: a scheduled task's name, alone or below a schema or a database and a schema.
TASK_REF = r"\A[A-Za-z_][A-Za-z0-9_$]*(\.[A-Za-z_][A-Za-z0-9_$]*){0,2}\z"

# Command-line clients of warehouses, in the order they are looked for.
WAREHOUSE_CLIS = ["snow", "snowsql", "bq", "dbsqlcli", "psql", "mysql", "sqlcmd", "duckdb", "redshift-data"]
DESTRUCTIVE_SQL = (
    r"(?iU)\b(CREATE\s+OR\s+REPLACE|CREATE|ALTER|DROP|DELETE|UPDATE|INSERT|TRUNCATE|MERGE|GRANT|REVOKE|"
    r"REPLACE\s+INTO)\b"
)
SQL_FILE_FLAG = r"(?U)(?:-f|-i|--file|--filename|--input-file|--query)[=\s]+([^\s;|&]+)"
SQL_STDIN = r"(?U)<\s*([^\s;|&<>]+)"

# Guarded commands per platform, (kind, order, rule name, pattern). The rule names are
# ours; the patterns decide what is asked about.
GUARD_RULES = [
    ("databricks", 0, "jobs-reset", r"databricks\s+jobs\s+reset\b"),
    ("databricks", 1, "jobs-delete", r"databricks\s+jobs\s+delete\b"),
    ("databricks", 2, "jobs-update", r"databricks\s+jobs\s+update\b"),
    ("databricks", 3, "jobs-run", r"databricks\s+jobs\s+(run-now|submit)\b"),
    ("airflow", 0, "dags-delete", r"airflow\s+dags\s+delete\b"),
    ("airflow", 1, "db-wipe", r"airflow\s+db\s+(reset|clean|downgrade)\b"),
    ("dbt", 0, "prod-run",
     r"dbt\b(?=.*\b(?:run|build|seed|snapshot)\b)(?=.*(?:--target|-t)[=\s]+prod(?![\w-]))"),
    ("dbt", 1, "run-operation", r"dbt\b(?=.*\brun-operation\b)"),
    ("snowflake_tasks", 0, "drop-task", r"\bDROP\s+TASK\b"),
    ("snowflake_tasks", 1, "replace-task", r"\bCREATE\s+OR\s+REPLACE\s+TASK\b"),
    ("snowflake_tasks", 2, "alter-task", r"\bALTER\s+TASK\b"),
    ("prefect", 0, "delete", r"prefect\s+(deployment|flow-run|work-pool)\s+delete\b"),
]

# Texts that hold guard rules: adapters in code, the copy they fall back to, and the front matter of playbooks.
CODE_KIND = r"(?md)^[ \t]*kind[ \t]*=[ \t]*[\"']([A-Za-z0-9_]+)[\"']"
CODE_PATTERN = r"""["']pattern["'][ \t]*:[ \t]*r?["]([^"\n]+)["]"""
FALLBACK_SECTION = r"""(?s)["']([A-Za-z0-9_]+)["'][ \t]*:[ \t]*\[(.*?)\n[ \t]*\]"""
FRONT_MATTER = r"(?s)\A---[ \t]*\n(.*?)\n---"
PLAYBOOK_LIST = r"(?md)^destructive_patterns:[ \t]*\n((?:[ \t]+(?:-|#).*\n?|[ \t]*\n)*)"
PLAYBOOK_ITEM = r"(?md)^[ \t]+-[ \t]+(.*?)[ \t]*$"

# Failure classes for triage, first match wins. Rule data of our own.
FAILURE_RULES = [
    ("transient", r"(?i)timed? ?out|throttl|connection (?:reset|refused)|spot (?:instance|termination)|unavailable"),
    ("upstream-data", r"(?i)no such (?:table|file)|table or view not found|schema mismatch|empty (?:input|source)"),
    ("config", r"(?i)permission denied|unauthori[sz]ed|missing (?:parameter|secret|config)|invalid (?:cluster|config)"),
    ("code", r"(?i)traceback|exception|error"),
]
