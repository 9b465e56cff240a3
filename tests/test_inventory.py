from pyspark.sql import functions as F

from codequarry.operators import inventory

LISTING = [
    "USER PID %CPU %MEM VSZ RSS TTY STAT START TIME COMMAND",
    "root 1 0.0 0.1 1 2 ? Ss 10:00 0:01 /sbin/init splash",
    "  app 20 1.0 2.0 1 2 ? S 10:00 0:02 python  worker.py --boto",
    "www-data 30 0.1 0.2 1 2 ? S 10:00 0:03 nginx: master",
    "root 40 0 0 0 0 ? S 10:00 0:00 [kworker/0:1]",
    "short line", "", "bob 50 0 0 0 0 ? S 10:00 0:00 vim",
]


def processes(spark, cap=None):
    lines = spark.createDataFrame([("h", i, x) for i, x in enumerate(LISTING)], "host string, line_no int, line string")
    return inventory.parse_ps(lines, ["host"], cap)


def test_parse_ps_like_split(spark):
    want = [x.split(None, 10) for x in LISTING if len(x.split(None, 10)) >= 11]
    got = [list(r) for r in processes(spark).orderBy("line_no").select(*inventory.PS_COLUMNS).collect()]
    assert got == want
    assert processes(spark, cap=3).count() == 3


def test_applications(spark, rows):
    assert rows(inventory.application_pids(processes(spark), ["host"]), "place", "pid") == [(1, "PID"), (2, "20"), (3, "30"), (4, "50")]


def test_classes_and_concerns(spark):
    got = {r["pid"]: r for r in inventory.classify(processes(spark)).collect()}
    assert got["20"]["service_classification"] == "background_worker" and got["20"]["integrations"] == ["AWS SQS", "AWS S3"]
    assert got["20"]["security_concerns"] == ["Review worker process security and input validation"]
    assert got["30"]["service_classification"] == "web_server" and got["50"]["service_classification"] == "service"
    assert got["1"]["security_concerns"] == ["Running as root - consider principle of least privilege"]


def test_counts_and_facts(spark, rows):
    assert rows(inventory.process_counts(processes(spark), ["host"])) == [("h", 6, 2, 2, 2)]
    assert rows(inventory.deployment_facts(processes(spark), ["host"])) == [("h", "nginx", "unknown", False)]


def test_files(spark, rows):
    names = ["/opt/a/main.py", "/opt/a/venv/x.py", "/usr/lib/q.py", "/srv/x.pyc", "/etc/nginx/n.conf", "/usr/bin/app"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    assert rows(inventory.application_files(df)) == [("/opt/a/main.py",), ("/usr/bin/app",)]
    app, config = inventory.split_config(df)
    assert app.count() == 5 and rows(config) == [("/etc/nginx/n.conf",)]


def test_key_settings(spark):
    unit = "[Unit]\nUser=a\n  ExecStart=/x  \n" + "#\n" * 20 + "WorkingDirectory=/late"
    many = "\n".join(f"listen {i};" for i in range(9))
    df = spark.createDataFrame([("/etc/systemd/system/a.service", unit), ("/etc/nginx/a.conf", many), ("/opt/a.conf", many)], "p string, c string")
    got = [r[0] for r in df.select(inventory.key_settings(F.col("p"), F.col("c"))).collect()]
    assert got == [["User=a", "ExecStart=/x", "WorkingDirectory=/late"], [f"listen {i};" for i in range(9)], []]
    got = [r[0] for r in df.select(inventory.key_settings(F.col("p"), F.col("c"), 5, 20)).collect()]
    assert got == [["User=a", "ExecStart=/x"], [f"listen {i};" for i in range(5)], []]


def test_endpoints(spark, rows):
    df = spark.createDataFrame([(1, "/api/users/1"), (2, "/api"), (3, "/orders"), (4, "/api/users"), (5, "/api/users/x")], "n int, path string")
    assert rows(inventory.group_endpoints(df)) == [("general", 1), ("orders", 1), ("users", 3)]
    assert rows(inventory.top_endpoints(df, [], ["n"]), "n") == [(1,), (2,), (3,), (4,)]
    assert [r["n"] for r in inventory.example_endpoints(df, [], ["n"], 4).orderBy("place").collect()] == [1, 4, 5, 2]


def test_project_name_first_seen_wins(spark, rows):
    df = spark.createDataFrame([("h", 1, "/opt/my_app/b.py"), ("h", 2, "/srv/zeta/my_app/zeta")], "host string, n int, path string")
    assert rows(inventory.project_name(df, ["host"], "n")) == [("h", "My App")]


def test_variables(spark, rows):
    df = spark.createDataFrame([("h", 1, "A", None, None, None), ("h", 2, "A", "late", False, "1"), ("h", 3, None, "ctx", False, "x")],
                               "host string, n int, variable_name string, usage_context string, is_required boolean, default_value string")
    assert rows(inventory.config_variables(df, ["host"], ["n"])) == [("h", "A", "", "Yes", "None"), ("h", "Unknown", "ctx", "No", "x")]
    assert inventory.setup_variables(df, ["host"], ["n"]).count() == 3


def test_caps(spark, rows):
    df = spark.createDataFrame([("h", k, i) for k in ("nginx", "python", "other") for i in range(20)], "host string, kind string, n int")
    got = inventory.cap_per_kind(df, ["host"], ["n"]).groupBy("kind").count()
    assert rows(got) == [("nginx", 5), ("python", 15)]


def test_model_calls_of_nothing(spark):
    empty = spark.createDataFrame([], "stage string, duration double")
    assert inventory.model_call_summary(empty).first().asDict() == {
        "total_calls": 0, "stages": 0, "confidence": 0.0, "total_duration": 0.0, "avg_duration": 0.0}


def test_folder_rollup_depth(spark, rows):
    df = spark.createDataFrame([("/a/b/c/d/e/f.py",), ("/a/x.py",), ("root.py",)], "path string")
    assert rows(inventory.dir_rollup(df, max_depth=4)) == [(1, "a", 2), (2, "a/b", 1), (3, "a/b/c", 1), (4, "a/b/c/d", 1)]
    assert rows(inventory.dir_rollup(df))[4:] == [(5, "a/b/c/d/e", 1)]


def test_notes_in_file_order(spark, rows):
    df = spark.createDataFrame([("h", 3, ["e"]), ("h", 1, ["a", "b"]), ("h", 2, []), ("h", 4, ["f"])], "host string, n int, notes array<string>")
    assert rows(inventory.notes(df, "notes", ["host"], "n", 3), "place", "note") == [(1, "a"), (2, "b"), (3, "e")]
