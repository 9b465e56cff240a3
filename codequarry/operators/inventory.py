"""Processes, files and call logs of many hosts: classification, counts and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import paths, text
from codequarry.functions.ranking import first_per_key, top_n

# Word lists of the process and file rules.
SYSTEM_PATTERNS = ["kworker", "ksoftirqd", "migration", "rcu_", "systemd/"]
APP_INDICATORS = ["python", "node", "java", "nginx", "worker", "service"]
SYSTEM_USERS = ["root", "daemon", "bin", "sys", "www-data", "nobody"]
EXCLUDED_FILES = [
    "/site-packages/", "/venv/", "/env/", "/.venv/", "/virtualenv/", "/__pycache__/", "/node_modules/",
    "/vendor/", "/.git/", "/tmp/", "/cache/", ".pyc", ".pyo",
]
INCLUDED_FILES = ["/opt/", "/srv/", "/var/www/", "/home/", "/app/", "worker", "server", "main", "app", "service"]
CONFIG_MARKS = ["/etc/", ".conf", ".service", ".yml", ".yaml"]
LANGUAGES = {
    ".py": "Python", ".js": "JavaScript", ".java": "Java", ".yml": "YAML", ".yaml": "YAML", ".json": "JSON", ".conf": "Config",
}
LANGUAGES_SIMPLE = {".py": "Python", ".js": "JavaScript", ".java": "Java"}
KIND_CAPS = {"python": 15, "javascript": 10, "config": 10, "project": 5, "systemd": 10, "nginx": 5}
ANALYSED_CAPS = {"application": 10, "configuration": 5}
SYSTEMD_SETTINGS = ["ExecStart=", "User=", "WorkingDirectory="]
NGINX_SETTINGS = ["server_name", "listen", "root", "proxy_pass"]
STOP_PARTS = ["opt", "srv", "var", "www", "home", "usr", "etc"]
FRAMEWORKS = ["flask", "django", "fastapi"]

PS_COLUMNS = ["user", "pid", "cpu_percent", "memory_percent", "vsz", "rss", "tty", "stat", "start", "time", "command"]


def parse_ps(lines: DataFrame, by: list[str] = [], cap: int | None = None) -> DataFrame:
    """Process rows of listing lines: eleven fields, the last with its blanks; shorter lines are no processes.

    ``cap`` keeps only the first lines of every listing, before anything else.
    """
    taken = lines if cap is None else top_n(lines, by, ["line_no"], cap, "__line").drop("__line")
    fields = F.split(F.ltrim("line"), r"\s+", 11)
    keep = [c for c in lines.columns if c != "line"]
    # generated, so that later conditions on single fields do not split the line again
    rows = taken.select(*keep, F.explode(F.filter(F.array(fields), lambda f: F.size(f) >= 11)).alias("__f"))
    return rows.select(*keep, *[F.col("__f")[i].alias(c) for i, c in enumerate(PS_COLUMNS)])


def is_application(command: Column, user: Column) -> Column:
    """Kernel threads and system patterns are not, known runtimes are, else whoever is no system user."""
    lowered = F.lower(command)
    return (
        F.when(F.startswith(command, F.lit("[")) & F.endswith(command, F.lit("]")), False)
        .when(text.contains_any(lowered, SYSTEM_PATTERNS), False)
        .when(text.contains_any(lowered, APP_INDICATORS), True)
        .otherwise(~user.isin(SYSTEM_USERS))
    )


def application_processes(processes: DataFrame) -> DataFrame:
    return processes.where(is_application(F.col("command"), F.col("user")))


def application_pids(processes: DataFrame, by: list[str], n: int | None = None) -> DataFrame:
    """The first ``n`` application processes per host, all without ``n``."""
    return top_n(application_processes(processes), by, ["line_no"], n, "place").select(*by, "place", "pid")


def service_class(command: Column) -> Column:
    said = F.lower(command)
    return (
        F.when(F.contains(said, F.lit("worker")), "background_worker").when(F.contains(said, F.lit("nginx")), "web_server")
        .when(F.contains(said, F.lit("python")), "application").otherwise("service")
    )


def service_purpose(command: Column) -> Column:
    said = F.lower(command)
    return (
        F.when(F.contains(said, F.lit("worker")), "Background task processing")
        .when(F.contains(said, F.lit("nginx")), "Web server and reverse proxy").otherwise("Application service")
    )


def integrations(command: Column) -> Column:
    known = F.array(F.lit("AWS SQS"), F.lit("AWS S3"))
    return F.when(text.contains_any(F.lower(command), ["aws", "boto"]), known).otherwise(F.array().cast("array<string>"))


def process_concerns(command: Column, user: Column, extra: Column | None = None, n: int | None = None) -> Column:
    """Security remarks of a process, own rules first, then ``extra``, the first ``n`` if given."""
    said = F.lower(command)
    own = F.array_compact(F.array(
        F.when(user == "root", "Running as root - consider principle of least privilege"),
        F.when(F.contains(said, F.lit("python")) & F.contains(said, F.lit("worker")), "Review worker process security and input validation"),
        F.when(F.contains(said, F.lit("nginx")), "Review web server configuration and SSL/TLS settings"),
    ))
    every = own if extra is None else F.concat(own, F.coalesce(extra, F.array().cast("array<string>")))
    return every if n is None else F.slice(every, 1, n)


def classify(processes: DataFrame) -> DataFrame:
    """Processes with class, purpose, integrations and concerns; one pass."""
    command, user = F.col("command"), F.col("user")
    return processes.withColumns({
        "service_classification": service_class(command), "service_purpose": service_purpose(command),
        "integrations": integrations(command), "security_concerns": process_concerns(command, user),
    })


def is_config(path: Column) -> Column:
    return text.contains_any(path, CONFIG_MARKS)


def split_config(files: DataFrame, by: list[str] = []) -> tuple[DataFrame, DataFrame]:
    """Distinct application files and distinct configuration files."""
    distinct = files.select(*by, "path").distinct()
    return distinct.where(~is_config(F.col("path"))), distinct.where(is_config(F.col("path")))


def application_files(files: DataFrame) -> DataFrame:
    """Files of the application itself: no library or cache path, and an application mark."""
    path = F.col("path")
    return files.where(~text.contains_any(path, EXCLUDED_FILES) & text.contains_any(path, INCLUDED_FILES))


def cap_per_kind(files: DataFrame, by: list[str], order: list[str], caps: dict[str, int] = KIND_CAPS) -> DataFrame:
    """The first files of every kind per host, each kind with its own cap."""
    ranked = top_n(files.where(F.col("kind").isin(list(caps))), [*by, "kind"], order, max(caps.values()), "place")
    cap = F.lit(0)
    for kind, n in caps.items():
        cap = F.when(F.col("kind") == kind, n).otherwise(cap)
    return ranked.where(F.col("place") <= cap)


def file_language(path: Column, languages: dict[str, str] = LANGUAGES) -> Column:
    found = F.lit("Unknown")
    for ending, language in languages.items():
        found = F.when(paths.suffix(path) == ending, language).otherwise(found)
    return found


def config_type(path: Column) -> Column:
    return (
        F.when(F.contains(path, F.lit("/systemd/system")), "systemd_service").when(F.contains(path, F.lit("/nginx/")), "nginx_config")
        .when(F.endswith(path, F.lit(".yml")) | F.endswith(path, F.lit(".yaml")), "yaml_config")
        .when(F.endswith(path, F.lit(".json")), "json_config").when(F.endswith(path, F.lit(".conf")), "generic_config")
        .otherwise("unknown_config")
    )


def key_settings(path: Column, content: Column, n: int | None = None, head: int | None = None) -> Column:
    """The setting lines of a systemd or nginx file: the first ``n``, among the first ``head`` lines, if given."""
    lines = F.split(content, "\n")
    lines = lines if head is None else F.slice(lines, 1, head)
    pick = lambda words: F.transform(F.filter(lines, lambda x: text.contains_any(x, words)), text.squeeze_ends)
    found = (
        F.when(F.contains(path, F.lit("/systemd/system")), pick(SYSTEMD_SETTINGS)).when(F.contains(path, F.lit("/nginx/")), pick(NGINX_SETTINGS))
        .otherwise(F.array().cast("array<string>"))
    )
    return found if n is None else F.slice(found, 1, n)


def endpoint_resource(path: Column) -> Column:
    """First path part that is not ``api``, ``general`` when there is none."""
    named = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "api"))
    return F.coalesce(F.get(named, F.lit(0)), F.lit("general"))


def group_endpoints(endpoints: DataFrame, by: list[str] = []) -> DataFrame:
    """Endpoints counted per resource."""
    return endpoints.groupBy(*by, endpoint_resource(F.col("path")).alias("resource")).agg(F.count(F.lit(1)).alias("endpoints"))


def top_endpoints(endpoints: DataFrame, by: list[str], order: list[str], per_group: int = 2) -> DataFrame:
    """The first endpoints of every resource."""
    named = endpoints.withColumn("resource", endpoint_resource(F.col("path")))
    return top_n(named, [*by, "resource"], order, per_group, "place")


def example_endpoints(endpoints: DataFrame, by: list[str], order: list[str], n: int = 3) -> DataFrame:
    """The first endpoints overall, in the order their resources first occur."""
    named = endpoints.withColumn("resource", endpoint_resource(F.col("path")))
    seen = named.groupBy(*by, "resource").agg(F.min(F.struct(*order)).alias("__seen"))
    # the first n endpoints stand among the first n of each resource
    first = top_n(named, [*by, "resource"], order, n, "__place").join(seen, [*by, "resource"])
    return top_n(first, by, ["__seen", *order], n, "place").drop("__seen", "__place")


def api_document(files: DataFrame) -> DataFrame:
    """Endpoints and models of all files as rows; files without either give none."""
    endpoint = files.select("path", F.explode("api_endpoints").alias("name")).select("path", F.lit("endpoint").alias("part"), "name")
    model = files.select("path", F.explode("database_models").alias("name")).select("path", F.lit("model").alias("part"), "name")
    return endpoint.union(model)


def deployment_facts(processes: DataFrame, by: list[str] = []) -> DataFrame:
    """Web server, service manager and container use per host; a process counts for the first it shows."""
    said = F.lower("command")
    nginx, systemd, docker = (F.contains(said, F.lit(w)) for w in ("nginx", "systemd", "docker"))
    return processes.groupBy(*by).agg(
        F.when(F.bool_or(nginx), "nginx").otherwise("none").alias("web_server"),
        F.when(F.bool_or(~nginx & systemd), "systemd").otherwise("unknown").alias("service_management"),
        F.bool_or(~nginx & ~systemd & docker).alias("containerization"),
    )


def config_variables(variables: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row per variable name, with defaults for what it leaves open."""
    named = variables.withColumn("variable_name", F.coalesce("variable_name", F.lit("Unknown")))
    first = first_per_key(named, [*by, "variable_name"], order)
    return first.select(
        *by, "variable_name", F.coalesce("usage_context", F.lit("")).alias("description"),
        F.when(F.coalesce("is_required", F.lit(True)), "Yes").otherwise("No").alias("required"),
        F.coalesce("default_value", F.lit("None")).alias("default"),
    )


def setup_variables(variables: DataFrame, by: list[str], order: list[str], n: int | None = None) -> DataFrame:
    """The first ``n`` variable rows, repeated names included; all without ``n``."""
    return top_n(variables, by, order, n, "place")


def project_name(files: DataFrame, by: list[str], order: str) -> DataFrame:
    """The commonest path part outside the stop list, as a title; the one seen first wins ties."""
    parts = files.select(*by, order, F.posexplode(F.split("path", "/")).alias("__at", "part"))
    counted = parts.where((F.col("part") != "") & ~F.col("part").isin(STOP_PARTS)).groupBy(*by, "part").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(order, "__at")).alias("first"))
    best = counted.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "part")).alias("b"))
    return best.select(*by, text.title_case(F.replace(F.col("b.part"), F.lit("_"), F.lit(" "))).alias("project_name"))


def project_type(processes: DataFrame, endpoints: DataFrame, by: list[str]) -> DataFrame:
    """Project type per host from its endpoints, workers and web servers."""
    said = F.lower("command")
    flags = processes.groupBy(*by).agg(
        F.bool_or(F.contains(said, F.lit("worker"))).alias("has_workers"), F.bool_or(F.contains(said, F.lit("nginx"))).alias("has_web_server"))
    api = endpoints.select(*by).distinct().withColumn("has_web_api", F.lit(True))
    joined = flags.join(api, by, "left").withColumn("has_web_api", F.coalesce("has_web_api", F.lit(False)))
    kind = (
        F.when(F.col("has_web_api") & F.col("has_workers"), "Full-Stack Web Service").when(F.col("has_web_api"), "Web API Service")
        .when(F.col("has_workers"), "Background Processing Service").when(F.col("has_web_server"), "Web Application")
        .otherwise("Application Service")
    )
    return joined.select(*by, "has_web_api", "has_workers", "has_web_server", kind.alias("project_type"))


def tech_stack(given: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """Distinct technologies per host: given ones, file languages, and framework imports."""
    languages = files.select(*by, file_language(F.col("path")).alias("technology")).where(F.col("technology") != "Unknown")
    imported = files.select(*by, F.explode("imports").alias("technology"))
    frameworks = imported.where(text.contains_any(F.lower("technology"), FRAMEWORKS))
    return given.select(*by, "technology").union(languages).union(frameworks).distinct()


def language_counts(files: DataFrame, by: list[str] = [], languages: dict[str, str] = LANGUAGES) -> DataFrame:
    return files.groupBy(*by, file_language(F.col("path"), languages).alias("language")).agg(F.count(F.lit(1)).alias("files"))


def process_counts(processes: DataFrame, by: list[str] = []) -> DataFrame:
    """Processes in all, run by root, workers, and of application classes."""
    kind = service_class(F.col("command"))
    return processes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("processes"), F.count_if(F.col("user") == "root").alias("root_processes"),
        F.count_if(F.contains(F.lower("command"), F.lit("worker"))).alias("workers"),
        F.count_if(kind.isin("application", "background_worker")).alias("application_processes"),
    )


def critical_services(processes: DataFrame, by: list[str], n: int | None = None) -> DataFrame:
    """The first ``n`` web servers and workers per host, all without ``n``."""
    kind = service_class(F.col("command"))
    named = processes.withColumn("service_classification", kind)
    critical = F.col("service_classification").isin("web_server", "background_worker") | F.contains(F.lower("command"), F.lit("worker"))
    return top_n(named.where(critical), by, ["line_no"], n, "place")


def service_rows(processes: DataFrame, classes: list[str]) -> DataFrame:
    """Processes of the given service classes with their purpose."""
    return classify(processes).where(F.col("service_classification").isin(classes))


CORE_CLASSES = ["web_server", "service"]
COMPONENT_CLASSES = ["application", "background_worker"]
DEPLOYED_CLASSES = ["web_server", "application", "background_worker"]


def notes(files: DataFrame, column: str, by: list[str], order: str, n: int) -> DataFrame:
    """The first ``n`` notes of a host's files, in file order.

    A host's first ``n`` notes lie in its first ``n`` files that have any.
    """
    filled = top_n(files.where(F.size(column) > 0), by, [order], n, "__file")
    rows = filled.select(*by, order, F.posexplode(column).alias("__at", "note"))
    return top_n(rows, by, [order, "__at"], n, "place").select(*by, "place", "note")


def dir_rollup(files: DataFrame, by: list[str] = [], max_depth: int | None = None) -> DataFrame:
    """Files below every folder, down to ``max_depth`` levels if given."""
    folders = F.filter(F.split(paths.directory(F.col("path")), "/"), lambda d: d != "")
    depth = F.size("__dirs") if max_depth is None else F.least(F.size("__dirs"), F.lit(max_depth))
    prefixes = F.when(F.size("__dirs") > 0, F.transform(
        F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(F.col("__dirs"), F.lit(1), k), "/").alias("folder"))))
    rows = files.withColumn("__dirs", folders).select(*by, F.inline(prefixes))
    return rows.groupBy(*by, "depth", "folder").agg(F.count(F.lit(1)).alias("files"))


def model_call_summary(calls: DataFrame, by: list[str] = []) -> DataFrame:
    """Calls, stages and durations; confidence 0.9 as soon as there was a call."""
    n = F.count(F.lit(1))
    return calls.groupBy(*by).agg(
        n.alias("total_calls"), F.count_distinct("stage").alias("stages"),
        F.when(n > 0, 0.9).otherwise(0.0).alias("confidence"),
        F.coalesce(F.sum("duration"), F.lit(0.0)).alias("total_duration"), F.coalesce(F.avg("duration"), F.lit(0.0)).alias("avg_duration"),
    )


def command_rollup(commands: DataFrame) -> DataFrame:
    """Commands, failures and time spent per host."""
    return commands.groupBy("host").agg(
        F.count(F.lit(1)).alias("commands"), F.count_if(~F.col("success")).alias("failures"), F.sum("duration").alias("duration"))


def scan_stats(processes: DataFrame, files: DataFrame, commands: DataFrame, by: list[str], depth: str = "standard", ai: bool = True,
               business: bool = True) -> DataFrame:
    """One row of scan counts per host."""
    count = lambda d, name: d.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    names = ["processes_analyzed", "files_analyzed", "total_commands_executed"]
    joined = count(processes, names[0]).join(count(files, names[1]), by, "full").join(count(commands, names[2]), by, "full")
    return joined.select(
        *by, *[F.coalesce(n, F.lit(0)).alias(n) for n in names], F.lit(depth).alias("analysis_depth"), F.lit(ai).alias("ai_enabled"),
        F.lit(business).alias("business_intelligence_enabled"))


def stage_rows(scans: DataFrame, by: list[str]) -> DataFrame:
    """Completed stages per scan; the business stage only where it was done (``has_business``)."""
    stages = F.array(F.lit("connection"), F.lit("discovery"), F.lit("analysis"))
    every = F.when(F.col("has_business"), F.concat(stages, F.array(F.lit("business_intelligence")))).otherwise(stages)
    return scans.select(*by, F.explode(every).alias("stage"), F.lit("completed").alias("status"))


def model_fields(models: DataFrame) -> DataFrame:
    """Fields of data models; a field is required only when marked not nullable."""
    rows = models.select(F.coalesce("model_name", F.lit("Unknown")).alias("model_name"), F.posexplode("fields").alias("place", "f"))
    filled = lambda c, default: F.coalesce(F.col("f")[c], F.lit(default)).alias(c)
    return rows.select(
        "model_name", "place", filled("name", "unknown"), filled("type", "unknown"), filled("description", ""),
        F.when(F.coalesce(F.col("f.nullable"), F.lit(True)), "No").otherwise("Yes").alias("required"))
