"""Explicit schemas of every table; nothing is inferred."""

SOURCE_FILE = "repo string, job_dir string, path string, ext string, text string, n_bytes bigint"
JOB_FOLDER = "repo string, job_dir string, ticket string"
JOB_DOC = "repo string, job_dir string, text string, content_sha256 string"
ENRICHMENT = (
    "repo string, ticket string, name string, summary string, owner string, status string, date string, "
    "objects array<string>, claude_md_hash string"
)
ENRICHMENT_DOC = (
    "jobs array<struct<ticket string, name string, summary string, owner string, status string, "
    "date string, objects array<string>, claude_md_hash string>>"
)
JOB_DEF = "repo string, job_key string, side string, env string, path string, stem string, ext string, raw string"
REPO_CONFIG = (
    "repo string, schema_version int, "
    "project struct<name string, key_prefixes array<string>, jobs_dir string, ticket_url_template string, "
    "graph_notes boolean>, "
    "platform struct<kind string, deploy_model string, profile string, job_def_dirs map<string,string>, "
    "dags_dir string>, "
    "warehouse struct<dialect string>, "
    "architecture struct<layers array<string>, layer_rules map<string,array<string>>, "
    "deprecated_schema_deny array<string>, read_exceptions array<string>, replace_hints map<string,string>>, "
    "governance struct<claude_md_required array<string>, header_required array<string>>"
)
COMMAND_EVENT = (
    "event_id bigint, ts timestamp_ntz, repo string, kind string, tool_name string, "
    "tool_input struct<command string>, cwd string"
)
COMMAND = "event_id bigint, ts timestamp_ntz, repo string, kind string, cwd string, cmd string"
FILE_CHANGE = "ts timestamp_ntz, repo string, path string"
ADVISORY_DOC = "package string, version string, vulns array<struct<id string>>"
ALLOW_DOC = "package string, version string, vulns array<string>"
# One export line per live job; the columns a platform does not have stay null.
LIVE_JOB_EXPORT = (
    "repo string, job_id string, settings struct<name string, schedule struct<quartz_cron_expression string, "
    "pause_status string>>, dag_id string, paused string, name string, state string, schedule string"
)
RUN_EXPORT = (
    "repo string, job_key string, run_id string, dag_run_id string, QUERY_ID string, "
    "life_cycle string, state string, STATE_NAME string, result_state string, started string, "
    "tasks array<struct<task_key string>>, logs string, error string, logs_truncated boolean, payload string"
)
