import json

from pyspark.sql import functions as F

from codequarry.functions import paths
from codequarry.operators import curation
from codequarry.sources import documents


def test_site_types(spark):
    df = spark.createDataFrame([("https://x/docs", "Guide"), ("https://x", "A Tutorial"), ("https://x", "Rapid"), ("https://x", "Home")], "url string, title string")
    got = [r[0] for r in df.select(curation.site_type(F.col("url"), F.col("title"))).collect()]
    assert got == ["documentation", "tutorial", "documentation", "resource"]  # 'api' inside 'Rapid' counts


def test_titles(spark):
    df = spark.createDataFrame([("https://x/docs/getting-started_now/",), ("https://x/how-2use",)], "u string")
    assert [r[0] for r in df.select(paths.title_from_url(F.col("u"))).collect()] == ["Getting Started Now", "How 2Use"]


def test_page_links(spark, rows):
    html = '<a href="/out">x</a><nav class="m"><a class=k href="/in">x</a><a href=\'sub\'>y</a><a href="mailto:z">z</a></nav>'
    df = spark.createDataFrame([(1, "https://h.org/a/b", html)], "page_id int, url string, html string")
    assert rows(curation.page_links(df), "place", "link") == [(0, "https://h.org/in"), (1, "https://h.org/a/sub")]
    assert len(curation.page_links(df, scope=None).collect()) == 3


def test_routes(spark, rows):
    sites = spark.createDataFrame([(1, "Docs A", "u1"), (2, "Docs B", "u2"), (3, "Docs C", "u3"), (4, "Docs D", "u4"), (5, "My guide", "u5")],
                                  "site_id int, title string, url string")
    attempts = spark.createDataFrame([(1, "completed"), (2, "timeout"), (3, "error"), (4, "completed")], "site_id int, status string")
    links = spark.createDataFrame([(1, i, f"https://h/page-{i}") for i in range(60)], "site_id int, link_no int, link string")
    got = rows(curation.route_attempts(sites, attempts, links, cap=50), "site_id", "type", "priority", "extraction_method")
    assert got.count((1, "documentation", 1, "browser-use-success")) == 50
    assert curation.route_attempts(sites, attempts, links).where("type = 'documentation'").count() == 60
    assert curation.cap_per_source(links, ["site_id"], ["link_no"]).count() == 60
    assert got[50:] == [(2, "main_page", 2, "timeout-fallback"), (3, "main_page", 2, "error-fallback"), (5, "tutorial", 2, "direct-url")]


def test_rank_is_stable(spark):
    urls = [(0, 2, "High"), (1, None, "High"), (2, 1, "Low"), (3, 2, None), (4, 2, "High"), (5, 1, "Low"), (6, 3, "High")]
    df = spark.createDataFrame([(1, *u) for u in urls], "s int, pos int, priority int, relevance string")
    got = [r["pos"] for r in sorted(curation.rank_urls(df, ["s"], "pos").collect(), key=lambda r: r["rank"])]
    assert got == [u[0] for u in sorted(urls, key=lambda u: (3 if u[1] is None else u[1], u[2] != "High"))]


def test_fallback_rank(spark):
    df = spark.createDataFrame([(i,) for i in range(45)], "pos int")
    got = curation.fallback_rank(df, "pos").collect()
    assert all(r["priority"] == min(3, r["pos"] // 10 + 1) and r["relevance"] == "Medium" for r in got)


def test_approval(spark, rows):
    df = spark.createDataFrame([("s", 1, "t" * 61, "u1", None, None), ("s", 0, "short", "u0", "High", "direct-url")],
                               "session string, pos int, title string, url string, relevance string, extraction_method string")
    df = df.withColumns({"source": F.lit("S"), "type": F.lit("documentation"), "priority": F.lit(1)})
    table = curation.approval_table(df, ["session"], "pos")
    assert rows(table, "id", "title", "relevance", "method") == sorted(
        [(1, "short", "High", "direct-url"), (2, "t" * 60 + "...", "Medium", "unknown")], key=repr)
    listed = spark.createDataFrame([("s", 2), ("s", 7)], "session string, id bigint")
    yes, unknown = curation.approve(table, ["session", "id"], include=listed)
    assert rows(yes, "id") == [(2,)] and rows(unknown, "id") == [(7,)]
    no, _ = curation.approve(table, ["session", "id"], exclude=listed)
    every, none = curation.approve(table, ["session", "id"])
    assert rows(no, "id") == [(1,)] and every.count() == 2 and none.count() == 0


def test_page_text(spark):
    ten = " ".join(f"w{i}" for i in range(10))
    html = f"""<html><head><title>{ten}</title></head><header>{ten}</header><p>{ten} &amp; <b>bold</b></p><p>too short</p>
      <SCRIPT>var x = "{ten}"</SCRIPT><div>{ten}&#x41;&#10;</div><!-- {ten} --><footer>{ten}"""
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(curation.page_text(F.col("html"))).first()[0] == f"{ten} & bold\n{ten}A"


def test_summary_of_a_stored_session(spark, rows):
    # one page of 2848 words, one attempt of 31 links in 76.997 s
    asked = spark.createDataFrame([("a",), ("b",)], "session string")
    crawled = spark.createDataFrame([("a", True, 2848)], "session string, success boolean, word_count int")
    assert rows(curation.crawl_summary(asked, crawled, ["session"])) == [("a", 1, 1, 0, 2848, 2848), ("b", 1, 0, 0, 0, 0)]
    attempts = spark.createDataFrame([("completed", 31, 76.9974365234375)], "status string, urls_extracted int, duration_seconds double")
    assert rows(curation.attempt_rollup(attempts)) == [("completed", 1, 31, 77.0, 76.9974365234375)]


def test_responses(spark):
    cases = [
        ('{"a": 1}', "direct", "1"), (' {"a": 1} \n', "direct", "1"), ("{not json}", "error", None),
        ('Text ```json\n{"a": "x",}\n``` end', "fenced_json", "x"), ('```\n{"a": [1, 2,],}\n```', "fenced", "[1,2]"),
        ('so {"b": 2} then {"a": 3}', "braces", None), ("no structure", "text", None), (None, "text", None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, response string")
    got = sorted(curation.parse_responses(df, schema="a STRING").select("i", "method", "parsed.a").collect())
    assert [(r[1], r[2]) for r in got] == [(m, a) for _, m, a in cases]


def test_bullets(spark, rows):
    answer = "- before any section\nKey findings:\n- one\n* two\n\nplain\nYou should:\n1. three\n 2.four\n7. not listed\nThe pattern identified\n• five"
    df = spark.createDataFrame([(1, answer)], "id int, response string")
    assert rows(curation.sectioned_bullets(df, "id"), "line_no", "section", "item") == sorted([
        (2, "key_findings", "one"), (3, "key_findings", "two"), (7, "recommendations", ". three"), (8, "recommendations", ".four"),  # one mark is taken off
        (11, "key_findings", "five")], key=repr)


def test_read_state(spark, tmp_path):
    state = {
        "session_id": "abc12345", "search_sites": [{"title": "T", "url": "u", "description": "d"}], "extracted_urls": [],
        "crawled_content": {"results": [{"url": "u", "title": "T", "success": True, "word_count": 2848}]},
        "extraction_attempts": [{"site_title": "T", "start_time": "2025-06-20T13:24:26.672813", "duration_seconds": 76.9974365234375,
                                 "status": "completed", "urls_extracted": 31, "error_message": None, "process_terminated": False}],
        "status": "completed", "created_at": "2025-06-20T13:24:08.039890", "last_updated": "2025-06-20T13:27:40.549609"}
    (tmp_path / "state.json").write_text(json.dumps(state, indent=2))
    tables = documents.read_state(spark, str(tmp_path / "state.json"))
    assert tables["sites"].count() == 1 and tables["urls"].count() == 0
    assert tables["attempts"].select("session_id", "urls_extracted", "start_time").first()[1] == 31
    assert tables["states"].selectExpr("timestampdiff(SECOND, created_at, last_updated)").first()[0] == 212


def test_read_sessions_and_shards(spark, tmp_path, rows):
    message = lambda i, s: {"id": f"m{i}", "type": "user", "content": f"c{i}", "timestamp": f"2025-06-24T12:34:4{i}", "session_id": s}
    store = {"sessions": [{"id": "s1", "title": "t", "created_at": "x", "last_message_at": "y", "messages": [message(0, "s1"), message(1, "s1")], "attached_sources": ["a"]},
                          {"id": "s2", "title": "u", "created_at": "x", "last_message_at": "y", "messages": [], "attached_sources": []}]}
    (tmp_path / "sessions.json").write_text(json.dumps(store))
    sessions, messages = documents.read_sessions(spark, str(tmp_path / "sessions.json"))
    assert rows(messages, "session_id", "place", "content") == [("s1", 0, "c0"), ("s1", 1, "c1")]
    documents.write_sessions(sessions, messages, ["place"], str(tmp_path / "out"))
    again, same = documents.read_sessions(spark, str(tmp_path / "out"), sharded=True)
    assert rows(same) == rows(messages) and rows(again, "id", "title") == [("s1", "t"), ("s2", "u")]


def test_long_sessions_are_written_in_blocks(spark, tmp_path, rows):
    messages = spark.range(2500).selectExpr("'s' AS session_id", "id AS n", "string(id) AS id", "'user' AS type", "'c' AS content", "'t' AS timestamp")
    sessions = spark.createDataFrame([("s", "t")], "id string, title string")
    documents.write_sessions(sessions, messages, ["n"], str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "messages")).count() == 3
    _, back = documents.read_sessions(spark, str(tmp_path / "out"), sharded=True)
    assert back.where("CAST(id AS BIGINT) <> place").count() == 0 and back.count() == 2500


def test_read_analysis(spark, tmp_path, rows):
    doc = {"analysis_metadata": {"total_nodes": 2, "functions": 1},
           "nodes": [{"id": "a", "node_type": "function", "name": "f", "location": {"file_path": "p.py", "line_start": 1}, "calls": ["g"]},
                     {"id": "b", "node_type": "import", "module": "os", "imports": ["os"]}]}
    (tmp_path / "analysis.json").write_text(json.dumps(doc, indent=1))
    functions, classes, imports = documents.split_nodes(documents.read_analysis(spark, str(tmp_path / "analysis.json")))
    assert rows(functions, "id", "location.file_path", "calls", "complexity") == [("a", "p.py", ["g"], None)]
    assert classes.count() == 0 and rows(imports, "module") == [("os",)]
    assert documents.read_analysis_metadata(spark, str(tmp_path / "analysis.json")).first()["total_nodes"] == 2


def test_scan_files(spark, tmp_path, rows):
    from codequarry.sources import files

    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.py").write_bytes(b"\xef\xbb\xbfprint(1)\n")
    (tmp_path / "a" / "b" / "y.py").write_text("hé\n")
    (tmp_path / "a" / "bad.py").write_bytes(b"\xff\xfe\x00bad")
    (tmp_path / "a" / "z.txt").write_text("no")
    got = rows(files.scan_files(spark, str(tmp_path), "*.py"), "path", "content", "size")
    assert got == [("a/b/y.py", "hé\n", 4), ("a/x.py", "print(1)\n", 12)]
    assert rows(files.unreadable_files(spark, str(tmp_path), "*.py")) == [("a/bad.py", 6, "not UTF-8")]
    kept, stats = files.size_filter(files.scan_files(spark, str(tmp_path)), 4)
    assert kept.count() == 2 and stats.first()["skipped"] == 1
