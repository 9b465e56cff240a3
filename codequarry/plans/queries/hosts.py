"""Queries over processes, files and call logs of hosts."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.operators import inventory
from codequarry.plans.registry import Inputs, query

PROCS = r"""(SELECT host, line_no, regexp_extract(line, '^\s*(\S+)', 1) AS "user", regexp_extract(line, '^\s*\S+\s+(\S+)', 1) AS pid,
                    regexp_extract(line, '^\s*(?:\S+\s+){10}(.*)$', 1) AS command
             FROM {b_ps} WHERE regexp_matches(line, '^\s*(\S+\s+){10}\S'))"""
APP = r"""(CASE WHEN command LIKE '[%' AND command LIKE '%]' THEN false
               WHEN regexp_matches(lower(command), 'kworker|ksoftirqd|migration|rcu_|systemd/') THEN false
               WHEN regexp_matches(lower(command), 'python|node|java|nginx|worker|service') THEN true
               ELSE "user" NOT IN ('root', 'daemon', 'bin', 'sys', 'www-data', 'nobody') END)"""
CLASS = """(CASE WHEN contains(lower(command), 'worker') THEN 'background_worker' WHEN contains(lower(command), 'nginx') THEN 'web_server'
                 WHEN contains(lower(command), 'python') THEN 'application' ELSE 'service' END)"""
PURPOSE = """(CASE WHEN contains(lower(command), 'worker') THEN 'Background task processing' WHEN contains(lower(command), 'nginx') THEN 'Web server and reverse proxy'
                   ELSE 'Application service' END)"""


def _procs(t: Inputs):
    return inventory.parse_ps(t.b_ps, ["host"])


@query("process_rows", f"""SELECT host, line_no, "user", pid, command FROM {PROCS}""")
def process_rows(t: Inputs):
    return _procs(t).select("host", "line_no", "user", "pid", "command")


@query(
    "first_process_rows",
    f"""SELECT host, line_no, pid FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY line_no DESC) AS n FROM {{b_ps}}) l
        JOIN (SELECT line_no AS k, pid FROM {PROCS}) p ON p.k = l.line_no WHERE n <= 20""",
)
def first_process_rows(t: Inputs):
    newest = t.b_ps.withColumn("line_no", -F.col("line_no"))
    return inventory.parse_ps(newest, ["host"], cap=20).select("host", (-F.col("line_no")).alias("line_no"), "pid")


@query("application_processes", f"SELECT host, line_no, command FROM {PROCS} WHERE {APP}")
def application_processes(t: Inputs):
    return inventory.application_processes(_procs(t)).select("host", "line_no", "command")


@query("application_pids", f"SELECT host, place, pid FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY line_no) AS place FROM {PROCS} WHERE {APP}) WHERE place <= 15")
def application_pids(t: Inputs):
    return inventory.application_pids(_procs(t), ["host"], 15)


CONCERNS = """concat_ws('; ', CASE WHEN "user" = 'root' THEN 'Running as root - consider principle of least privilege' END,
    CASE WHEN contains(lower(command), 'python') AND contains(lower(command), 'worker') THEN 'Review worker process security and input validation' END,
    CASE WHEN contains(lower(command), 'nginx') THEN 'Review web server configuration and SSL/TLS settings' END)"""


@query(
    "classified_processes",
    f"""SELECT host, line_no, {CLASS} AS service_classification, {PURPOSE} AS service_purpose,
               CASE WHEN contains(lower(command), 'aws') OR contains(lower(command), 'boto') THEN 'AWS SQS; AWS S3' ELSE '' END AS integrations, {CONCERNS} AS concerns
        FROM {PROCS}""",
)
def classified_processes(t: Inputs):
    rows = inventory.classify(_procs(t))
    return rows.select("host", "line_no", "service_classification", "service_purpose", F.array_join("integrations", "; ").alias("integrations"),
                       F.array_join("security_concerns", "; ").alias("concerns"))


@query("service_classes", f"SELECT {CLASS} AS class, count(*) AS processes FROM {PROCS} GROUP BY 1")
def service_classes(t: Inputs):
    return _procs(t).groupBy(inventory.service_class(F.col("command")).alias("class")).agg(F.count(F.lit(1)).alias("processes"))


@query("service_purposes", f"SELECT {PURPOSE} AS purpose, count(DISTINCT host) AS hosts FROM {PROCS} GROUP BY 1")
def service_purposes(t: Inputs):
    return _procs(t).groupBy(inventory.service_purpose(F.col("command")).alias("purpose")).agg(F.count_distinct("host").alias("hosts"))


@query(
    "integrations_used",
    f"SELECT host, unnest(['AWS SQS', 'AWS S3']) AS integration, n AS processes FROM (SELECT host, count(*) AS n FROM {PROCS} WHERE regexp_matches(lower(command), 'aws|boto') GROUP BY host)",
)
def integrations_used(t: Inputs):
    used = _procs(t).select("host", F.explode(inventory.integrations(F.col("command"))).alias("integration"))
    return used.groupBy("host", "integration").agg(F.count(F.lit(1)).alias("processes"))


@query(
    "process_concerns",
    f"""SELECT line_no, array_to_string(list_filter(string_split({CONCERNS}, '; '), lambda c: c <> '') || ['pid ' || pid, 'host ' || host, 'seen', 'listed', 'kept', 'told'], '; ') AS concerns FROM {PROCS}""",
)
def process_concerns(t: Inputs):
    extra = F.array(F.concat(F.lit("pid "), "pid"), F.concat(F.lit("host "), "host"), *map(F.lit, ("seen", "listed", "kept", "told")))
    rows = _procs(t)
    return rows.select("line_no", F.array_join(inventory.process_concerns(F.col("command"), F.col("user"), extra), "; ").alias("concerns"))


CONFIG = r"regexp_matches(path, '/etc/|\.conf|\.service|\.yml|\.yaml')"


@query("split_files", f"SELECT DISTINCT path, CASE WHEN {CONFIG} THEN 'config' ELSE 'application' END AS part FROM {{b_listing}}")
def split_files(t: Inputs):
    app, config = inventory.split_config(t.b_listing)
    return app.withColumn("part", F.lit("application")).union(config.withColumn("part", F.lit("config")))


@query(
    "application_files",
    r"""SELECT path FROM {b_listing} WHERE NOT regexp_matches(path, '/(site-packages|venv|env|\.venv|virtualenv|__pycache__|node_modules|vendor|\.git|tmp|cache)/|\.pyc|\.pyo')
        AND regexp_matches(path, '/opt/|/srv/|/var/www/|/home/|/app/|worker|server|main|app|service')""",
)
def application_files(t: Inputs):
    return inventory.application_files(t.b_listing.select("path"))


KIND = "CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.js' THEN 'javascript' WHEN path LIKE '/etc/nginx/%.conf' THEN 'nginx' ELSE 'config' END"


@query(
    "files_capped_per_kind",
    f"""SELECT host, kind, path, place FROM (SELECT *, row_number() OVER (PARTITION BY host, kind ORDER BY doc_id) AS place FROM (SELECT *, {KIND} AS kind FROM {{b_listing}}))
        WHERE place <= CASE kind WHEN 'python' THEN 15 WHEN 'nginx' THEN 5 ELSE 10 END""",
)
def files_capped_per_kind(t: Inputs):
    files = t.b_listing.withColumn("kind", F.expr(KIND))
    return inventory.cap_per_kind(files, ["host"], ["doc_id"]).select("host", "kind", "path", "place")


LANGUAGE = "CASE regexp_extract(path, '\\.[a-z]+$') WHEN '.py' THEN 'Python' WHEN '.js' THEN 'JavaScript' WHEN '.yml' THEN 'YAML' WHEN '.json' THEN 'JSON' WHEN '.conf' THEN 'Config' ELSE 'Unknown' END"


@query("file_languages", f"SELECT path, {LANGUAGE} AS language, CASE WHEN {LANGUAGE} IN ('Python', 'JavaScript') THEN {LANGUAGE} ELSE 'Unknown' END AS simple FROM {{b_listing}}")
def file_languages(t: Inputs):
    path = F.col("path")
    return t.b_listing.select(path, inventory.file_language(path).alias("language"), inventory.file_language(path, inventory.LANGUAGES_SIMPLE).alias("simple"))


@query(
    "config_types",
    """SELECT path, CASE WHEN path LIKE '%/systemd/system%' THEN 'systemd_service' WHEN path LIKE '%/nginx/%' THEN 'nginx_config' WHEN path LIKE '%.yml' OR path LIKE '%.yaml' THEN 'yaml_config'
         WHEN path LIKE '%.json' THEN 'json_config' WHEN path LIKE '%.conf' THEN 'generic_config' ELSE 'unknown_config' END AS type FROM {b_listing}""",
)
def config_types(t: Inputs):
    return t.b_listing.select("path", inventory.config_type(F.col("path")).alias("type"))


@query(
    "key_settings",
    r"""WITH f AS (SELECT p_partkey, concat(CASE WHEN p_type = 'ECONOMY' THEN '/etc/nginx/n' WHEN p_type = 'PROMO' THEN '/etc/systemd/system/s' ELSE '/opt/x' END, p_partkey) AS path,
                   string_split(concat('[Unit]', chr(10), '  listen ', p_size, ';', chr(10), 'User=', p_brand, chr(10), 'ExecStart=/bin/', p_name, chr(10), ' root /srv/', p_name, repeat(concat(chr(10), '#'), 20), repeat(concat(chr(10), 'listen 80;'), 7), chr(10), 'User=late'), chr(10)) AS ls FROM part),
        l AS (SELECT p_partkey, path, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM f),
        k AS (SELECT p_partkey, string_agg(trim(line), '|' ORDER BY n) AS settings FROM l
              WHERE (path LIKE '/etc/systemd/%' AND regexp_matches(line, 'ExecStart=|User=|WorkingDirectory=')) OR (path LIKE '/etc/nginx/%' AND regexp_matches(line, 'server_name|listen|root|proxy_pass'))
              GROUP BY p_partkey)
        SELECT f.p_partkey AS id, coalesce(k.settings, '') AS settings FROM f LEFT JOIN k ON k.p_partkey = f.p_partkey""",
)
def key_settings(t: Inputs):
    folder = F.when(F.col("p_type") == "ECONOMY", "/etc/nginx/n").when(F.col("p_type") == "PROMO", "/etc/systemd/system/s").otherwise("/opt/x")
    content = F.concat(F.lit("[Unit]\n  listen "), "p_size", F.lit(";\nUser="), "p_brand", F.lit("\nExecStart=/bin/"), "p_name", F.lit("\n root /srv/"), "p_name", F.lit("\n#" * 20 + "\nlisten 80;" * 7 + "\nUser=late"))
    found = inventory.key_settings(F.concat(folder, "p_partkey"), content)
    return t.part.select(F.col("p_partkey").alias("id"), F.array_join(found, "|").alias("settings"))


# Links of the pages' navigation stand for endpoints.
ENDPOINTS = r"""(SELECT page_id, spot - 1 AS place, '/api' || href AS path FROM (SELECT page_id, unnest(hs) AS href, generate_subscripts(hs, 1) AS spot FROM (
    SELECT page_id, regexp_extract_all(array_to_string(regexp_extract_all(html, '(?is)<nav\b[^>]*>(.*?)</nav>', 1), chr(10)), '(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1) AS hs FROM pages)))"""
RESOURCE = "split_part(path, '/', 3)"


def _nav_links():
    """Hrefs in all navigation elements of a page, in order."""
    areas = F.array_join(F.regexp_extract_all("html", F.lit(r"(?is)<nav\b[^>]*>(.*?)</nav>"), F.lit(1)), "\n")
    return F.regexp_extract_all(areas, F.lit(r'(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"'), F.lit(1))


def _endpoints(t: Inputs):
    hrefs = _nav_links()
    rows = t.pages.select("page_id", F.posexplode(hrefs).alias("place", "href"))
    return rows.select("page_id", F.col("place").cast("bigint"), F.concat(F.lit("/api"), "href").alias("path"))


@query("endpoint_groups", f"SELECT {RESOURCE} AS resource, count(*) AS endpoints FROM {ENDPOINTS} GROUP BY 1")
def endpoint_groups(t: Inputs):
    return inventory.group_endpoints(_endpoints(t))


@query(
    "first_endpoints",
    f"""SELECT resource, page_id, CAST(place AS BIGINT) AS place_in_page, n AS place FROM (SELECT *, {RESOURCE} AS resource, row_number() OVER (PARTITION BY {RESOURCE} ORDER BY page_id, place) AS n FROM {ENDPOINTS}) WHERE n <= 2""",
)
def first_endpoints(t: Inputs):
    rows = _endpoints(t).withColumnRenamed("place", "place_in_page")
    return inventory.top_endpoints(rows, [], ["page_id", "place_in_page"]).select("resource", "page_id", "place_in_page", "place")


@query(
    "example_endpoints",
    f"""WITH e AS (SELECT *, {RESOURCE} AS resource FROM {ENDPOINTS}), g AS (SELECT resource, min((page_id, place)) AS seen FROM e GROUP BY resource)
        SELECT resource, page_id, CAST(place AS BIGINT) AS place_in_page FROM e JOIN g ON g.resource = e.resource ORDER BY seen, page_id, place LIMIT 3""".replace("SELECT resource, page_id", "SELECT e.resource, page_id"),
)
def example_endpoints(t: Inputs):
    rows = _endpoints(t).withColumnRenamed("place", "place_in_page")
    return inventory.example_endpoints(rows, [], ["page_id", "place_in_page"]).select("resource", "page_id", "place_in_page")


@query(
    "api_documents",
    f"SELECT '' || page_id AS path, 'endpoint' AS part, path AS name FROM {ENDPOINTS} UNION ALL SELECT '' || page_id, 'model', split_part(url, '/', 3) FROM pages",
)
def api_documents(t: Inputs):
    hrefs = _nav_links()
    files = t.pages.select(
        F.col("page_id").cast("string").alias("path"), F.transform(hrefs, lambda h: F.concat(F.lit("/api"), h)).alias("api_endpoints"),
        F.array(F.split_part("url", F.lit("/"), F.lit(3))).alias("database_models"))
    return inventory.api_document(files)


@query(
    "deployment_facts",
    f"""SELECT host, CASE WHEN bool_or(contains(lower(command), 'nginx')) THEN 'nginx' ELSE 'none' END AS web_server,
               CASE WHEN bool_or(NOT contains(lower(command), 'nginx') AND contains(lower(command), 'systemd')) THEN 'systemd' ELSE 'unknown' END AS service_management,
               bool_or(NOT regexp_matches(lower(command), 'nginx|systemd') AND contains(lower(command), 'docker')) AS containerization FROM {PROCS} GROUP BY host""",
)
def deployment_facts(t: Inputs):
    return inventory.deployment_facts(_procs(t), ["host"])


VARIABLES = """(SELECT source AS host, doc_id, concat('VAR_', upper(lang), '_', n_chars % 9) AS variable_name, CASE WHEN n_chars > 2000 THEN lang END AS usage_context,
                       CASE WHEN lang = 'en' THEN false WHEN lang = 'de' THEN true END AS is_required, CASE WHEN n_chars > 1000 THEN source END AS default_value FROM documents)"""


@query(
    "configuration_variables",
    f"""SELECT host, variable_name, coalesce(usage_context, '') AS description, CASE WHEN coalesce(is_required, true) THEN 'Yes' ELSE 'No' END AS required, coalesce(default_value, 'None') AS "default"
        FROM (SELECT *, row_number() OVER (PARTITION BY host, variable_name ORDER BY doc_id) AS n FROM {VARIABLES}) WHERE n = 1""",
)
def configuration_variables(t: Inputs):
    return inventory.config_variables(t.sql(f"SELECT * FROM {VARIABLES} v"), ["host"], ["doc_id"])


@query("setup_variables", f"SELECT host, variable_name, place FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY doc_id) AS place FROM {VARIABLES}) WHERE place <= 5")
def setup_variables(t: Inputs):
    return inventory.setup_variables(t.sql(f"SELECT * FROM {VARIABLES} v"), ["host"], ["doc_id"], 5).select("host", "variable_name", "place")


@query(
    "project_names",
    """WITH p AS (SELECT host, doc_id, unnest(string_split(path, '/')) AS part, generate_subscripts(string_split(path, '/'), 1) AS spot FROM {b_listing}),
       c AS (SELECT host, part, count(*) AS n, min((doc_id, spot)) AS seen FROM p WHERE part NOT IN ('', 'opt', 'srv', 'var', 'www', 'home', 'usr', 'etc') GROUP BY host, part)
       SELECT host, upper(part[1]) || lower(part[2:]) AS project_name FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n DESC, seen) AS r FROM c) WHERE r = 1""",
)
def project_names(t: Inputs):
    return inventory.project_name(t.b_listing, ["host"], "doc_id")


@query(
    "project_types",
    f"""WITH f AS (SELECT host, bool_or(contains(lower(command), 'worker')) AS has_workers, bool_or(contains(lower(command), 'nginx')) AS has_web_server FROM {PROCS} GROUP BY host),
        e AS (SELECT DISTINCT 'h' || s_nationkey AS host FROM supplier), j AS (SELECT f.*, e.host IS NOT NULL AS has_web_api FROM f LEFT JOIN e ON e.host = f.host)
        SELECT host, has_web_api, has_workers, has_web_server, CASE WHEN has_web_api AND has_workers THEN 'Full-Stack Web Service' WHEN has_web_api THEN 'Web API Service'
               WHEN has_workers THEN 'Background Processing Service' WHEN has_web_server THEN 'Web Application' ELSE 'Application Service' END AS project_type FROM j""",
)
def project_types(t: Inputs):
    return inventory.project_type(_procs(t), t.supplier.select(F.concat(F.lit("h"), "s_nationkey").alias("host")), ["host"])


@query(
    "technology_stacks",
    f"""SELECT DISTINCT host, lang AS technology FROM (SELECT source AS host, lang FROM documents) UNION
        SELECT host, {LANGUAGE} FROM {{b_listing}} UNION
        SELECT source, 'Flask-' || lang FROM documents WHERE lang <> 'en'""",
)
def technology_stacks(t: Inputs):
    given = t.documents.select(F.col("source").alias("host"), F.col("lang").alias("technology"))
    imports = F.array(F.when(F.col("lang") != "en", F.concat(F.lit("Flask-"), "lang")).otherwise(F.lit("numpy")), F.lit("os"))
    files = t.b_listing.join(t.documents.select("doc_id", "lang"), "doc_id").withColumn("imports", imports)
    return inventory.tech_stack(given, files, ["host"])


@query("language_counts", f"SELECT host, {LANGUAGE} AS language, count(*) AS files FROM {{b_listing}} GROUP BY 1, 2")
def language_counts(t: Inputs):
    return inventory.language_counts(t.b_listing, ["host"])


@query(
    "process_counts",
    f"""SELECT host, count(*) AS processes, count(*) FILTER ("user" = 'root') AS root_processes, count(*) FILTER (contains(lower(command), 'worker')) AS workers,
               count(*) FILTER ({CLASS} IN ('application', 'background_worker')) AS application_processes FROM {PROCS} GROUP BY host""",
)
def process_counts(t: Inputs):
    return inventory.process_counts(_procs(t), ["host"])


@query(
    "critical_services",
    f"""SELECT host, line_no, class AS service_classification, place FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY line_no) AS place FROM
        (SELECT *, {CLASS} AS class FROM {PROCS}) WHERE class IN ('web_server', 'background_worker') OR contains(lower(command), 'worker')) WHERE place <= 5""",
)
def critical_services(t: Inputs):
    return inventory.critical_services(_procs(t), ["host"], 5).select("host", "line_no", "service_classification", "place")


@query("core_services", f"SELECT host, line_no, {CLASS} AS class, {PURPOSE} AS purpose FROM {PROCS} WHERE {CLASS} IN ('web_server', 'service')")
def core_services(t: Inputs):
    rows = inventory.service_rows(_procs(t), inventory.CORE_CLASSES)
    return rows.select("host", "line_no", F.col("service_classification").alias("class"), F.col("service_purpose").alias("purpose"))


@query(
    "file_notes",
    """WITH n AS (SELECT source AS host, doc_id, unnest(string_split(text, '. ')) AS note, generate_subscripts(string_split(text, '. '), 1) AS spot FROM documents)
       SELECT host, place, note FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY doc_id, spot) AS place FROM n) WHERE place <= 3""",
)
def file_notes(t: Inputs):
    files = t.documents.select(F.col("source").alias("host"), "doc_id", F.split("text", r"\. ").alias("notes"))
    return inventory.notes(files, "notes", ["host"], "doc_id", 3)


@query(
    "folder_rollup",
    """WITH p AS (SELECT host, list_filter(string_split(regexp_replace(path, '/[^/]*$', ''), '/'), lambda x: x <> '') AS ds FROM {b_listing}),
       d AS (SELECT host, CAST(k AS BIGINT) AS depth, array_to_string(ds[1:k], '/') AS folder FROM (SELECT host, ds, unnest(generate_series(1, len(ds))) AS k FROM p))
       SELECT host, depth, folder, count(*) AS files FROM d GROUP BY ALL""",
)
def folder_rollup(t: Inputs):
    rows = inventory.dir_rollup(t.b_listing, ["host"])
    return rows.withColumn("depth", F.col("depth").cast("bigint"))


@query(
    "model_call_summary",
    """SELECT host, count(*) AS total_calls, count(DISTINCT stage) AS stages, CAST(0.9 AS DOUBLE) AS confidence, round(sum(duration), 2) AS total_duration, round(avg(duration) + 0.0000001, 3) AS avg_duration
       FROM {b_model_calls} GROUP BY host""",
)
def model_call_summary(t: Inputs):
    rows = inventory.model_call_summary(t.b_model_calls, ["host"])
    # the shift keeps exact halves from rounding either way
    return rows.withColumns({"total_duration": F.round("total_duration", 2), "avg_duration": F.round(F.col("avg_duration") + 0.0000001, 3)})


@query("command_rollup", "SELECT host, count(*) AS commands, count(*) FILTER (stage = 'error') AS failures, round(sum(duration), 2) AS duration FROM {b_model_calls} GROUP BY host")
def command_rollup(t: Inputs):
    commands = t.b_model_calls.withColumn("success", F.col("stage") != "error")
    return inventory.command_rollup(commands).withColumn("duration", F.round("duration", 2))


SCANS = f"""(SELECT coalesce(p.host, f.host, c.host) AS host, coalesce(p.n, 0) AS processes_analyzed, coalesce(f.n, 0) AS files_analyzed, coalesce(c.n, 0) AS total_commands_executed
    FROM (SELECT host, count(*) AS n FROM {PROCS} GROUP BY host) p FULL JOIN (SELECT replace(host, 'src', 'h') AS host, count(*) AS n FROM {{b_listing}} GROUP BY 1) f ON f.host = p.host
    FULL JOIN (SELECT 'h' || host AS host, count(*) AS n FROM {{b_model_calls}} GROUP BY 1) c ON c.host = coalesce(p.host, f.host))"""


def _scans(t: Inputs):
    files = t.b_listing.select(F.replace("host", F.lit("src"), F.lit("h")).alias("host"))
    commands = t.b_model_calls.select(F.concat(F.lit("h"), "host").alias("host"))
    return inventory.scan_stats(_procs(t), files, commands, ["host"])


@query("scan_statistics", f"SELECT *, 'standard' AS analysis_depth, true AS ai_enabled, true AS business_intelligence_enabled FROM {SCANS}")
def scan_statistics(t: Inputs):
    return _scans(t)


@query(
    "scan_stages",
    f"""SELECT host, unnest(CASE WHEN files_analyzed > 0 THEN ['connection', 'discovery', 'analysis', 'business_intelligence'] ELSE ['connection', 'discovery', 'analysis'] END) AS stage,
               'completed' AS status FROM {SCANS}""",
)
def scan_stages(t: Inputs):
    return inventory.stage_rows(_scans(t).withColumn("has_business", F.col("files_analyzed") > 0), ["host"])


@query(
    "model_fields",
    """SELECT c_name AS model_name, CAST(place AS BIGINT) AS place, name, type, '' AS description, CASE WHEN place = 0 AND c_acctbal < 0 THEN 'Yes' ELSE 'No' END AS required
       FROM customer, (VALUES (0, 'id', 'int'), (1, 'unknown', 'text')) v(place, name, type)""",
)
def model_fields(t: Inputs):
    field = lambda name, kind, nullable: F.struct(name.alias("name"), F.lit(kind).alias("type"), F.lit(None).cast("string").alias("description"), nullable.alias("nullable"))
    fields = F.array(field(F.lit("id"), "int", F.col("c_acctbal") >= 0), field(F.lit(None).cast("string"), "text", F.lit(None).cast("boolean")))
    rows = inventory.model_fields(t.customer.select(F.col("c_name").alias("model_name"), fields.alias("fields")))
    return rows.withColumn("place", F.col("place").cast("bigint"))
