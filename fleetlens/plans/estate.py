"""A job estate derived from the given parquet tables.

The given tables hold no job code, so every table of the estate is a projection of one of them, in SQL
that Spark and DuckDB both run: the queries use it through Spark, the check SQL inlines the same text.
``@name`` stands for a given table, ``@@name`` for another table of the estate.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_bytes

NL = "chr(10)"


def _lines(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


def _opt(condition: str, *line: str) -> str:
    """A whole line where the condition holds, else nothing."""
    return f"case when {condition} then concat({', '.join(line)}, {NL}) else '' end"


_SCHEMA = "case l_suppkey % 5 when 0 then 'RAW' when 1 then 'STAGING' when 2 then 'ANALYTICS' when 3 then 'REPORTING' else 'LEGACY_STORE' end"
_OTHER = "case l_orderkey % 5 when 0 then 'RAW' when 1 then 'STAGING' when 2 then 'ANALYTICS' when 3 then 'REPORTING' else 'legacy_store' end"
_OBJECT = f"case when l_suppkey % 13 = 0 then lower(concat({_SCHEMA}, '.T_', l_orderkey % 50)) else concat({_SCHEMA}, '.T_', l_orderkey % 50) end"
_OTHER_OBJECT = f"concat({_OTHER}, '.T_', l_suppkey % 50)"

_NOTEBOOK = _lines(
    "'# JOB: JOB-'", "l_partkey", NL,
    _opt("l_returnflag = 'A'", "'# STATUS: TESTING'"),
    _opt("l_returnflag = 'R'", "'# STATUS:'"),
    _opt("l_discount > 0.05", "'# LAST_UPDATED = 2024-0'", "1 + l_orderkey % 9"),
    _opt("l_suppkey % 4 = 1", "'# LAYER: STAGING'"),
    _opt("l_suppkey % 4 = 2", "'  #LAYER = analytics'"),
    _opt("l_suppkey % 4 = 3", "'# LAYER: REPORTING'"),
    _opt("l_tax > 0.04", "'# PURPOSE: load'"),
    "'from pkg.mod import x'", NL,
    _opt("l_orderkey % 6 = 0", "'%pip install -q Pkg_'", "l_partkey % 40", "'[x]==1.'", "l_suppkey % 10", "' pip Foo.Bar'"),
    _opt("l_orderkey % 6 = 1", "'# MAGIC %pip install pkg-'", "l_partkey % 40", "'==1.'", "l_suppkey % 10", "' other_lib'"),
    "'q = \"SELECT * FROM '", _OBJECT, "' a LEFT JOIN '", _OTHER_OBJECT, "' b\"  # from OLD.GONE'", NL,
    _opt("l_orderkey % 8 = 3", "'# update LEGACY_STORE.T_'", "l_orderkey % 9"),
    _opt("l_quantity < 3", "'mail = \"p'", "l_suppkey", "'@corp'", "'.io\"'"),
    _opt("l_quantity = 4", "'key = \"ZZ-'", "l_suppkey", "'\"'"),
    _opt("l_quantity > 45", "'def f(:'"),
    "'x = 1'",
)
_QUERY_FILE = _lines(
    "'-- load '", "l_partkey", NL,
    "'insert INTO '", _OBJECT, "' select * from '", _OTHER_OBJECT, "' t;'", NL,
    "'MERGE  into \"'", _SCHEMA, "'\".\"T_'", "l_partkey % 50", "'\" using `RAW`.T_2 -- table OLD.GONE'", NL,
    "'delete from DB.'", _OTHER, "'.T_'", "l_orderkey % 9", "';'", NL,
)

#: Deploy model each platform kind goes by, in the order of the kinds.
_KIND = "case {n} % 8 when 0 then 'databricks' when 1 then 'airflow' when 2 then 'dbt' when 3 then 'dagster' when 4 then 'prefect' when 5 then 'snowflake_tasks' when 6 then 'glue' else 'adf' end"
_MODEL = "case {n} % 8 when 1 then 'git-sync' when 2 then 'git-sync' when 3 then 'git-sync' when 5 then 'sql-ddl' else 'api-reset' end"
_DEFS = "databricks/job_definitions"


def _kind(n: str) -> str:
    return _KIND.format(n=f"({n})")


_REPO_JSON = (
    "case when c_custkey % 17 = 3 then concat('{', chr(10), '\"name\": x}') "
    "when c_custkey % 19 = 5 then '[1]' "
    "when c_custkey % 23 = 7 then '{\"tasks\":[]}' "
    "else concat('{\"name\":\"Load-', c_custkey, '\",\"run_as\":{\"user_name\":\"u', c_nationkey, '\"},"
    "\"schedule\":{\"pause_status\":\"UNPAUSED\",\"quartz_cron_expression\":\"0 ', c_nationkey, ' * * * ?\",\"timezone_id\":\"UTC\"},"
    "\"tasks\":[{\"task_key\":\"a\"},{\"task_key\":\"b\"}],\"timeout\":1}') end"
)
_LIVE_JSON = (
    "concat('{\"job_id\":', c_custkey, ',\"created_time\":1,\"settings\":{\"name\":\"Load-', c_custkey, "
    "'\",\"run_as\":{\"user_name\":\"u', case when c_custkey % 7 = 0 then c_nationkey + 1 else c_nationkey end, "
    "'\"},\"schedule\":{\"pause_status\":\"', case when c_custkey % 5 = 0 then 'PAUSED' else 'UNPAUSED' end, "
    "'\",\"quartz_cron_expression\":\"0 ', c_nationkey, ' * * * ?\"', "
    "case when c_custkey % 3 = 0 then '' else ',\"timezone_id\":\"UTC\"' end, "
    "'},\"tasks\":[{\"task_key\":\"b\"},{\"task_key\":\"a\"}],\"timeout\":', "
    "case when c_custkey % 13 = 0 then '1.0' else '1' end, "
    "case when c_custkey % 11 = 0 then ',\"max_concurrent_runs\":1' else '' end, '}}')"
)
_REPO_DDL = "concat('CREATE OR REPLACE TASK T', c_custkey, chr(10), '  -- nightly', chr(10), '  AS SELECT ', chr(39), 'Prod', chr(39), ';')"
_LIVE_DDL = "concat('create or replace task t', c_custkey, ' /* x */ as select ', chr(39), case when c_custkey % 2 = 0 then 'Prod' else 'prod' end, chr(39))"


def _definition(side: str, env: str, key: str, json: str, ddl: str) -> str:
    is_ddl = "(c_custkey % 25) % 8 = 5"
    return (
        f"select concat('repo', c_custkey % 25) as repo, {key} as job_key, '{side}' as side, '{env}' as env, "
        f"concat('{_DEFS}/{env}/', {key}, '_Load.', case when {is_ddl} then 'sql' else 'json' end) as path, "
        f"concat({key}, '_Load') as stem, case when {is_ddl} then 'sql' else 'json' end as ext, "
        f"case when {is_ddl} then {ddl} else {json} end as raw from @customer"
    )


def _rule(text: str) -> str:
    """A pattern as SQL; ``~`` stands for a backslash, which the two engines read differently in a literal."""
    return "concat('" + text.replace("~", "', chr(92), '") + "')"


_RULES = [_rule(t) for t in ("tool~s+jobs~s+reset~b", "tool~s+jobs~s+delete~b", "(?i)~bdrop~s+task~b", "tool~s+(run|submit)~b")]
#: Which of the rules a place has, by the number of the repository: code, playbook (one rule may differ), fallback.
_HAS = {
    "code": ["true", "true", "true", "c_custkey % 11 <> 5"],
    "playbook": ["true", "c_custkey % 7 <> 3", "true", "true"],
    "fallback": ["c_custkey % 17 <> 6", "true", "true", "true"],
}


def _rule_lines(place: str, before: str, after: str) -> str:
    return ", ".join(_opt(has, f"'{before}'", rule, f"'{after}'") for rule, has in zip(_RULES, _HAS[place]))


_CODE_FILE = _lines("'class Adapter:'", NL, "'    kind = \"'", "kind", "'\"'", NL, "'    rules = ['", NL, _rule_lines("code", '        {"pattern": r"', '", "reason": "x"},'), "'    ]'", NL)
_FALLBACK_FILE = _lines(
    "'RULES = {'", NL, "'    \"'", "kind", "'\": ['", NL, _rule_lines("fallback", '        {"pattern": r"', '", "reason": "y"},'), "'    ],'", NL,
    "'    \"spare\": ['", NL, "'        {\"pattern\": r\"only here\"},'", NL, "'    ],'", NL, "'}'", NL,
)
_PLAYBOOK_FILE = _lines(
    "'---'", NL, "'kind: '", "kind", NL, "'destructive_patterns:'", NL, "'  # kept equal to the code'", NL, _rule_lines("playbook", "  - ", ""),
    _opt("c_custkey % 13 = 4", "'  - '", "chr(39)", "'it'", "chr(39)", "chr(39)", "'s extra'", "chr(39)"), "'---'", NL, "'# Playbook'", NL, "'  - not a rule'", NL,
)

TABLES: dict[str, str] = {
    # Rule files: an adapter, a playbook (missing in some repositories) and a fallback copy per repository.
    "rule_file": " union all ".join(
        f"select concat('repo', c_custkey) as repo, '{path}' as path, {text} as text from (select *, {_kind('c_custkey')} as kind from @customer) c where {there}"
        for path, text, there in (("adapter.py", _CODE_FILE, "true"), ("playbook.md", _PLAYBOOK_FILE, "c_custkey % 19 <> 7"), ("fallback.py", _FALLBACK_FILE, "true"))
    ),
    # Source files: one small file per line item, jobs are parts, two folders per ticket.
    "src": (
        "select concat('repo', l_partkey % 25) as repo, concat('JOB-', l_partkey, '_', l_linestatus) as job_dir, "
        "concat('jobs/JOB-', l_partkey, '_', l_linestatus, '/', case when l_linenumber = 7 then 'lib/' else '' end, "
        "'f', l_orderkey, '_', l_suppkey, '_', l_linenumber, case when l_linenumber in (2, 4, 6) then '.sql' else '.py' end) as path, "
        "case when l_linenumber in (2, 4, 6) then 'sql' else 'py' end as ext, "
        f"case when l_linenumber in (2, 4, 6) then {_QUERY_FILE} else {_NOTEBOOK} end as text from @lineitem"
    ),
    "folder": (
        "select concat('repo', p_partkey % 25) as repo, concat('JOB-', p_partkey, '_F') as job_dir, concat('JOB-', p_partkey) as ticket from @part "
        "union all select concat('repo', p_partkey % 25), concat('JOB-', p_partkey, '_O'), concat('JOB-', p_partkey) from @part"
    ),
    "doc": (
        "select repo, job_dir, text from ("
        + " union all ".join(
            f"select concat('repo', p_partkey % 25) as repo, concat('JOB-', p_partkey, '_{s}') as job_dir, "
            f"case when {missing} then null else concat("
            f"case when p_size % 2 = 0 then '# Job: ' else '# ' end, 'JOB-', p_partkey, ' ', p_name, ' {s}', {NL}, {NL}, "
            f"'**Purpose**: ', case when p_size % 4 = 0 then '' else repeat(concat(p_name, ' '), p_size) end, {NL}, "
            f"'**Schedule**: daily', {NL}, "
            f"case when p_size % 5 = 0 then '' else concat('**Business Owner**: ', p_brand, {NL}) end, "
            f"case when p_size % 3 = 0 then concat('**Status**: ACTIVE ', {NL}) else '' end) end as text from @part"
            for s, missing in (("F", "p_size % 9 = 0"), ("O", "p_size % 2 = 1"))
        )
        + ") d where text is not null"
    ),
    "curated": (
        "select concat('repo', c_custkey % 25) as repo, concat('JOB-', c_custkey) as ticket, "
        "case when c_custkey % 4 = 0 then c_name else '' end as name, "
        "case when c_custkey % 3 = 1 then concat('Loads ', c_mktsegment) else '' end as summary, "
        "case when c_custkey % 2 = 0 then c_mktsegment else '' end as owner, "
        "case when c_custkey % 6 = 0 then 'RETIRED' else '' end as status, "
        "case when c_custkey % 5 = 0 then '2023-05-01' else '' end as date, "
        "concat('raw.T_', c_custkey % 50, ', Extra.O_', c_custkey % 7) as objects, "
        "case when c_custkey % 2 = 0 then 'deadbeef' else '' end as claude_md_hash from @customer"
    ),
    "curated_doc": (
        "select concat('repo', c_custkey) as repo, case when c_custkey % 10 = 9 then '{\"jobs\": [' else "
        "concat('{\"jobs\":[{\"ticket\":\"JOB-', c_custkey, '\",\"name\":\"first\"},{\"name\":\"no ticket\"},"
        "{\"ticket\":\"JOB-', c_custkey % 2, '\",\"summary\":\"', c_mktsegment, '\"},"
        "{\"ticket\":\"JOB-', c_custkey, '\",\"name\":\"', c_name, '\",\"owner\":\"o', c_nationkey, '\"}]}') end as raw from @customer"
    ),
    "def": " union all ".join(
        [
            _definition("repo", "prod", "case when c_custkey % 10 = 9 then concat('old-', c_custkey) else concat('job-', c_custkey) end", _REPO_JSON, _REPO_DDL),
            _definition("live", "prod", "case when c_custkey % 10 = 8 then concat('ui-', c_custkey) else concat('job-', c_custkey) end", _LIVE_JSON, _LIVE_DDL),
        ]
    ),
    "dev_def": _definition("repo", "dev", "concat('job-', c_custkey)", "concat('{\"settings\":{\"name\":\"Dev-', c_custkey, '\"}}')", _REPO_DDL),
    # Flat repository configurations; lists are comma-separated.
    "conf": (
        "select concat('repo', c_custkey) as repo, c_custkey as k, case when c_custkey % 29 = 28 then 2 else 1 end as schema_version, "
        "case when c_custkey % 31 = 30 then 'JOB,BAD PREFIX' when c_custkey % 5 = 0 then '' else 'JOB' end as prefixes, "
        "case when c_custkey % 37 = 36 then '../jobs' when c_custkey % 25 = 7 then 'etl/work' else 'jobs' end as jobs_dir, "
        "case when c_custkey % 41 = 40 then 'ftp://t.example/{id}' when c_custkey % 3 = 0 then '' else 'https://t.example/b/{id}' end as url, "
        f"case when c_custkey % 43 = 42 then 'cron' else {_kind('c_custkey')} end as kind, "
        f"case when c_custkey % 9 = 4 then 'git-sync' else {_MODEL.format(n='c_custkey')} end as model, "
        "case when c_custkey % 47 = 46 then 'bad profile' else 'prod' end as profile, "
        f"case when c_custkey % 4 = 3 then '' when c_custkey % 4 = 2 then 'qa:{_DEFS}/qa,dev:{_DEFS}/dev' "
        f"when c_custkey % 4 = 1 then 'dev:{_DEFS}/dev,prod:{_DEFS}/prod' else 'prod:{_DEFS}/prod/,dev:{_DEFS}/dev' end as dirs, "
        "case when c_custkey % 6 = 1 then 'dags' when c_custkey % 10 = 7 then '/dags' else '' end as dags_dir, "
        "case when c_custkey % 53 = 52 then 'oracle' else 'snowflake' end as dialect, "
        "case c_custkey % 3 when 0 then 'LEGACY_STORE' when 1 then 'legacy_store,OLD' else '' end as deny, "
        "case when c_custkey % 2 = 1 then 'LEGACY_STORE.T_7' else '' end as exceptions, "
        "case when c_custkey % 4 < 2 then 'LEGACY_STORE:ANALYTICS,legacy_store.T_3:ANALYTICS.T_3' else '' end as hints, "
        "case when c_custkey % 7 = 6 then '' else 'STAGING:RAW+STAGING,Analytics:STAGING+ANALYTICS,REPORTING:STAGING+ANALYTICS+REPORTING' end as rules, "
        "case when c_custkey % 59 = 58 then 'bad layer' else 'RAW' end as layers, "
        "case when c_custkey % 6 = 0 then 'Purpose,Owner Team' else '' end as doc_req, "
        "case when c_custkey % 7 = 0 then 'JOB,STATUS' else '' end as header_req from @customer"
    ),
    "run": (
        f"select concat('repo', o_custkey % 25) as repo, {_kind('o_custkey % 25')} as kind, concat('JOB-', o_custkey) as job_key, "
        "concat('R-', o_orderkey) as run_id, o_orderdate as started, "
        "case when o_orderstatus = 'F' then 'TERMINATED' when (o_custkey % 25) % 8 = 1 then case when o_orderstatus = 'O' then 'queued' else 'running' end "
        "when (o_custkey % 25) % 8 = 5 then case when o_orderstatus = 'O' then 'SCHEDULED' else 'EXECUTING' end "
        "when o_orderstatus = 'O' then 'PENDING' when o_orderkey % 3 = 0 then null else 'RUNNING' end as state, "
        "case when o_orderstatus = 'F' and o_orderkey % 6 = 0 then 'FAILED' when o_orderstatus = 'F' then 'SUCCESS' else null end as result_state, "
        "case o_orderpriority when '1-URGENT' then 'Traceback (most recent call last)' when '2-HIGH' then 'Connection reset by peer' "
        "when '3-MEDIUM' then 'Table or view not found: RAW.T' else '' end as logs, "
        "case when o_orderpriority = '5-LOW' then 'Permission denied' else null end as error, "
        "o_orderkey % 2 = 0 as logs_truncated, "
        "concat('{\"run_id\":', o_orderkey, ',\"pad\":\"', repeat('x', 5000), '\"}') as payload from @orders"
    ),
    "live_job": (
        "select concat('repo', c_custkey % 25) as repo, concat('', c_custkey + 1000) as job_id, "
        "concat('Load-', case when c_custkey % 12 = 1 and c_custkey >= 25 then c_custkey - 25 else c_custkey end) as name from @customer"
    ),
    "command": (
        "select event_id, ts, concat('repo', user_id % 25) as repo, " + _kind("user_id % 25") + " as kind, '' as cwd, "
        "case when event_type = 'error' then concat('data', chr(39), 'bricks', chr(39), ' jobs reset --job-id ', user_id) "
        "when event_type = 'click' then case when user_id % 2 = 0 then 'dbt run --select m --target prod-dev' else 'dbt --target=prod snapshot' end "
        "when event_type = 'view' then case when user_id % 3 = 0 then '/usr/local/bin/snow sql -q \"SELECT 1\"' else 'snow sql -q \"Create or  Replace TASK t\"' end "
        "when event_type = 'signup' then case when user_id % 2 = 0 then 'airflow dags delete d' else concat('psql db < sql/deploy_', user_id, '.sql') end "
        "else concat('snow sql -f \"sql/deploy_', user_id, '.sql\" && echo done') end as cmd from @events"
    ),
    "sql_file": (
        "select concat('repo', s_suppkey % 25) as repo, concat('sql/deploy_', s_suppkey, '.sql') as path, "
        "case s_suppkey % 3 when 0 then concat('select 1;', chr(10), 'truncate table t;', chr(10), 'drop table u') when 1 then 'select updated from t' "
        "else concat('-- Grant', chr(10), 'select 1') end as text, "
        "case when s_suppkey % 4 = 1 then 3000000 else 100 end as n_bytes from @supplier"
    ),
    "advisory": (
        "select distinct concat('Pkg_', p_partkey % 40) as package, concat('1.', p_size % 10) as version, concat('VULN-', p_partkey % 17) as vuln_id from @part"
    ),
    "allow": (
        "select distinct concat('pkg-', p_partkey % 40) as package, concat('1.', p_size % 10) as version, "
        "case when p_size % 2 = 0 then concat('VULN-', p_partkey % 17) else 'VULN-0' end as vuln_id from @part"
    ),
    "file_change": (
        "select event_id, ts, concat('repo', user_id % 25) as repo, "
        "case when event_type = 'error' then concat('jobsX/JOB-', user_id, '/a.py') when event_type = 'view' then 'jobs/JOBS.md' "
        "when event_type = 'click' then concat('jobs/graph/JOB-', user_id, '.md') "
        "when event_type = 'signup' and user_id % 25 = 7 then concat(case when event_id % 2 = 0 then 'etl/work' else 'jobs' end, '/JOB-', user_id, '_F/a.py') "
        "when event_type = 'signup' and user_id % 25 < 20 then "
        "concat('src/../jobs/JOB-', user_id, case event_id % 3 when 0 then '_F' when 1 then '_O' else '_X' end, '/a.py') "
        "else concat('jobs/JOB-', user_id, '_F/../../lib/x.py') end as path from @events"
    ),
    # File listings of many small repositories, a few files each.
    "listing": (
        "select concat('repo', o_custkey) as repo, "
        "case o_orderkey % 12 when 0 then 'dbt_project.yml' when 1 then 'dags/team/load.py' when 2 then 'databricks/job_definitions/prod/JOB-1_x.json' "
        "when 3 then 'databricks.yml' when 4 then 'sql/tasks.sql' when 5 then concat('pipelines/ETL', o_orderkey % 9, '-', o_orderkey, '_Load/a.py') "
        "when 6 then concat('jobs/JOB-', o_orderkey, '_x/a.py') when 7 then 'node_modules/job_definitions/prod/a.json' "
        "when 8 then 'infra/job_definitions/all.json' when 9 then 'infra/job_definitions/bad env/x.json' "
        "when 10 then 'build/sql/tasks.sql' else concat('work/DAG-', o_orderkey % 5, '_a/x.sql') end as path, "
        "case o_orderkey % 12 when 1 then case when o_orderstatus = 'F' then 'x = 1' else 'd = DAG (1)' end "
        "when 4 then case when o_orderstatus = 'O' then 'select 1' else 'create or replace  task t' end "
        "when 10 then 'create task t' else '' end as text from @orders"
    ),
}

_TABLE_REF = re.compile(r"@@(\w+)")
_GIVEN_REF = re.compile(r"(?<!@)@(\w+)\b(?=\s|\)|$)")


def spark_sql(name: str, given: Callable[[str], str]) -> str:
    """SQL of a table; ``given`` names the view of a given table."""
    inner = _TABLE_REF.sub(lambda m: f"({spark_sql(m[1], given)}) {m[1]}", TABLES[name])
    return _GIVEN_REF.sub(lambda m: given(m[1]) if m[1] in GIVEN else m[0], inner)


GIVEN = {
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
}


#: Given tables whose rows take much work each.
WIDE = {"lineitem", "documents", "pages", "conversations", "events", "orders", "customer", "part"}

#: Bytes of files for each core up to which the rows of a table are dealt out anew.
SPREAD_BYTES = 4_000_000


def check_sql(body: str, more: dict[str, str] | None = None) -> str:
    """``body`` with every ``@@name`` it needs (directly or through another) as a common table
    expression, in DuckDB's SQL. ``more`` holds further named expressions."""
    known = {**TABLES, **(more or {})}
    order: list[str] = []

    def need(text: str) -> None:
        for name in _TABLE_REF.findall(text):
            if name not in order:
                need(known[name])
                order.append(name)

    need(body)
    plain = lambda t: _GIVEN_REF.sub(
        lambda m: m[1] if m[1] in GIVEN else m[0], _TABLE_REF.sub(lambda m: f"t_{m[1]}", t)
    )
    ctes = ", ".join(f"t_{name} as ({plain(known[name])})" for name in order)
    body = plain(body).strip()
    if not ctes:
        return body
    if body.lower().startswith("with "):
        return f"with {ctes}, {body[5:]}"
    return f"with {ctes} {body}"


class Estate:
    """Tables of the estate as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def given(self, name: str) -> DataFrame:
        """A given table. A small one in fewer splits than there are cores is spread over them, before its
        short rows grow into texts. A large one is read by its splits, whose size ``session.DEFAULTS`` bounds: dealing its rows
        out would shuffle, and sort, the whole table."""
        path = f"{self.sf_dir}/{name}.parquet"
        rows = self.spark.read.parquet(path)
        cores = self.spark.sparkContext.defaultParallelism
        if name not in WIDE or rows.rdd.getNumPartitions() >= cores or path_bytes(self.spark, path) > cores * SPREAD_BYTES:
            return rows
        return rows.repartition(cores)

    def _view(self, name: str) -> str:
        view = f"given_{name}_{zlib.crc32(self.sf_dir.encode()):08x}"
        self.given(name).createOrReplaceTempView(view)
        return view

    def table(self, name: str) -> DataFrame:
        return self.spark.sql(spark_sql(name, self._view))

    def files(self) -> DataFrame:
        return self.table("src").withColumn("n_bytes", F.octet_length("text").cast("bigint"))

    def docs(self) -> DataFrame:
        return self.table("doc").withColumn("content_sha256", F.sha2("text", 256))

    def definitions(self) -> DataFrame:
        return self.table("def").unionByName(self.table("dev_def"))

    def enrichment(self) -> DataFrame:
        return self.table("curated").withColumn("objects", F.split("objects", ","))

    def config(self) -> DataFrame:
        flat = self.table("conf")
        words = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
        pairs = lambda c: F.when(F.col(c) != "", F.str_to_map(F.col(c), F.lit(","), F.lit(":")))
        rules = F.transform_values(pairs("rules"), lambda _, v: F.split(v, r"\+"))
        return flat.select(
            "repo",
            F.col("schema_version"),
            F.struct(
                F.col("repo").alias("name"), words("prefixes").alias("key_prefixes"), "jobs_dir",
                F.col("url").alias("ticket_url_template"), F.lit(True).alias("graph_notes"),
            ).alias("project"),
            F.struct("kind", F.col("model").alias("deploy_model"), "profile", pairs("dirs").alias("job_def_dirs"), "dags_dir").alias("platform"),
            F.struct("dialect").alias("warehouse"),
            F.struct(
                words("layers").alias("layers"), rules.alias("layer_rules"), words("deny").alias("deprecated_schema_deny"),
                words("exceptions").alias("read_exceptions"), pairs("hints").alias("replace_hints"),
            ).alias("architecture"),
            F.struct(words("doc_req").alias("claude_md_required"), words("header_req").alias("header_required")).alias("governance"),
        )

    def runs(self) -> DataFrame:
        return self.table("run").withColumn(
            "tasks", F.when(F.col("result_state").isNotNull(), F.array(F.struct(F.col("run_id").alias("task_key"))))
        )
