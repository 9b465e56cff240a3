"""Views that present the given tables as the inputs of the operators.

Plain SQL that Spark and DuckDB read alike; ``{b_x}`` names another view.
"""

BINDINGS = {
    # documents as files of a repository
    "b_files": """
        SELECT doc_id AS idx, source AS repo_id,
               concat('/srv/', source, '/', lang, '/doc', doc_id, '.py') AS path,
               text AS content, n_chars AS size
        FROM documents""",
    # one source file per order, with imports, a class, methods and functions
    "b_source": """
        SELECT o_orderkey AS idx, o_orderstatus AS repo_id,
               concat('src/', lower(o_orderstatus), '/n', o_custkey % 40, '/mod_', o_orderkey, '.py') AS path,
               concat(
                 'import os, sys as system', chr(10),
                 'from n', (o_custkey + 1) % 40, ' import load_', (o_custkey + 1) % 50, ', Base', o_custkey % 11, ' as Parent', chr(10),
                 chr(10),
                 'class Order', o_orderkey, '(Base', o_custkey % 11, ', mixins.Log):', chr(10),
                 '    "Order of customer ', o_custkey, '"', chr(10),
                 '    def __init__(self, total=', CAST(floor(o_totalprice) AS BIGINT), ', *, status: str = None):', chr(10),
                 '        self.total = total', chr(10),
                 chr(10),
                 '    async def price_', o_custkey % 50, '(self, qty: float, tax):', chr(10),
                 '        ', chr(39), chr(39), chr(39), 'Price with tax', chr(10),
                 '        and discount', chr(39), chr(39), chr(39), chr(10),
                 '        if qty and tax or self.total :', chr(10),
                 '            return load_', (o_custkey + 1) % 50, '(qty) + round (tax)', chr(10),
                 '        for step in range(3):', chr(10),
                 '            await self.note(step)', chr(10),
                 '        return price_', o_custkey % 50, '(0, 0)', chr(10),
                 chr(10),
                 'def load_', o_custkey % 50, '(path, limit=', o_orderkey % 100, ') -> int:', chr(10),
                 '    while limit :', chr(10),
                 '        limit = step(limit) or load_', (o_custkey + 2) % 50, '(path)', chr(10),
                 chr(10),
                 '    def inner(x):', chr(10),
                 '        return x if x else None', chr(10),
                 '    return inner(limit)', chr(10),
                 'def last(): pass', chr(10),
                 'status = "', o_orderpriority, '"') AS content
        FROM orders""",
    # the parts catalogue as functions in files of at most 250
    "b_functions": """
        SELECT p_partkey AS id, 'function' AS node_type, p_name AS name,
               concat('src.', p_brand, '.m', CAST(floor(p_partkey / 250) AS BIGINT), 'x.', p_name) AS qualified_name,
               concat('src/', p_brand, '/m', CAST(floor(p_partkey / 250) AS BIGINT), 'x.py') AS file_path,
               p_partkey AS line_start, p_size AS complexity, p_type AS purpose, p_brand AS domain,
               concat(p_name, ' ', p_type) AS docstring,
               concat('def ', replace(p_name, ' ', '_'), '(', lower(p_type), '): return ', CAST(floor(p_retailprice) AS BIGINT)) AS content,
               concat('https://github.com/acme/', p_brand, '/blob/main/', p_partkey) AS github_url
        FROM part""",
    # a part calls the part numbered like each of its suppliers
    "b_calls": """
        SELECT DISTINCT l_partkey AS caller_id, p_name AS called_name
        FROM lineitem JOIN part ON p_partkey = l_suppkey""",
    # and its file imports it
    "b_imports": """
        SELECT DISTINCT a.file_path, concat(b.p_brand, '.m', CAST(floor(b.p_partkey / 250) AS BIGINT), 'x') AS module, b.p_name AS item
        FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) l
        JOIN {b_functions} a ON a.id = l.l_partkey JOIN part b ON b.p_partkey = l.l_suppkey""",
    "b_membership": """
        SELECT id AS function_id, concat(file_path, '#', complexity % 3) AS class_id FROM {b_functions}""",
    "b_classes": """
        SELECT c_custkey AS id, 'class' AS node_type, concat('C', c_custkey) AS name, concat('N', c_nationkey, '.py') AS file_path,
               concat('N', c_nationkey, '.C', c_custkey) AS qualified_name, c_custkey AS line_start,
               concat('C', CAST(floor(c_custkey / 3) AS BIGINT)) AS base,
               concat('https://github.com/acme/N', c_nationkey, '/blob/main/', c_custkey) AS github_url
        FROM customer""",
    # names repeat within and across files
    "b_typed_classes": """
        SELECT c_custkey AS id, concat(c_mktsegment, c_custkey % 7) AS name, concat('N', c_nationkey, '.py') AS file_path,
               concat('N', c_nationkey, '.', c_mktsegment, c_custkey % 7) AS qualified_name, c_custkey AS line_start,
               concat(c_mktsegment, (c_custkey + 3) % 9) AS base
        FROM customer""",
    "b_ranges": """
        SELECT c_custkey AS id, c_nationkey AS file_id, c_custkey AS lo, c_custkey + (c_custkey * 7) % 97 AS hi
        FROM customer""",
    "b_methods": """
        SELECT o_orderkey AS id, c_nationkey AS file_id, o_custkey + o_orderkey % 13 AS line
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    # entities that may be named like their file, and modules imported whole
    "b_mains": """
        SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'helper' ELSE concat('mod_', c_custkey % 300) END AS name,
               CASE WHEN c_nationkey > 12 THEN 'class' ELSE 'function' END AS node_type,
               concat('app/n', c_nationkey, '/mod_', c_custkey % 300, '.py') AS file_path
        FROM customer""",
    "b_module_imports": """
        SELECT o_orderkey AS id, concat('n', o_custkey % 25, '.mod_', o_custkey % 300) AS module
        FROM orders""",
    "b_vectors": """
        SELECT vec_id AS id, concat('v', vec_id) AS name,
               CASE WHEN label % 2 = 0 THEN 'Function' ELSE 'Class' END AS node_type, label, embedding
        FROM embeddings""",
    "b_attempts": """
        SELECT event_id AS attempt_id, user_id AS site_id, ts AS start_time, value AS duration_seconds,
               event_id % 60 AS urls_extracted,
               CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'timeout' ELSE 'completed' END AS status
        FROM events""",
    "b_urls": """
        SELECT page_id, url, concat('Page ', url) AS title, page_id AS pos, split_part(url, '/', 3) AS source,
               CASE WHEN page_id % 6 = 0 THEN NULL ELSE page_id % 6 END AS priority,
               CASE page_id % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Low' ELSE NULL END AS relevance,
               page_id % 5 AS session_id
        FROM pages""",
    "b_ps": """
        SELECT event_id AS line_no, concat('h', user_id % 20) AS host,
               concat(CASE event_type WHEN 'error' THEN 'root' ELSE concat('u', user_id) END, '  ', event_id,
                      ' 0.1 0.2 1 2 ? S 10:00 0:00 ',
                      CASE event_type WHEN 'click' THEN 'nginx: worker  process' WHEN 'purchase' THEN 'python app.py'
                           WHEN 'signup' THEN '[kworker/0:1]' WHEN 'view' THEN 'python worker.py --boto' ELSE 'sshd -D' END) AS line
        FROM events
        UNION ALL SELECT -1 - event_id AS line_no, concat('h', user_id % 20) AS host, concat('total ', event_id) AS line FROM events""",
    "b_listing": """
        SELECT doc_id, source AS host,
               concat(CASE lang WHEN 'en' THEN '/opt/app/' WHEN 'de' THEN '/srv/site-packages/' WHEN 'fr' THEN '/etc/nginx/' ELSE '/usr/lib/' END,
                      source, '/f', doc_id,
                      CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.conf' WHEN 3 THEN '.yml' ELSE '.json' END) AS path,
               n_chars AS size, text AS content
        FROM documents""",
    "b_model_calls": """
        SELECT event_id AS call_id, event_type AS stage, user_id AS host, value AS duration,
               concat('p', user_id % 7, event_type) AS prompt
        FROM events""",
    # one project per customer: its orders in date order are the chapters
    "b_concepts": """
        SELECT o_custkey AS project_id, o_orderkey AS idx, concat(o_orderpriority, ' "', o_orderkey, '" é') AS name,
               concat('Status ', o_orderstatus) AS description
        FROM orders""",
    "b_messages": """
        SELECT conv_id AS session_id, turn,
               CASE role WHEN 'system' THEN 'system' WHEN 'user' THEN 'user' ELSE 'assistant' END AS type, text AS content
        FROM conversations""",
    "b_events": """
        SELECT user_id AS session_id, event_id, ts,
               CASE event_type WHEN 'signup' THEN 'initialized' WHEN 'view' THEN 'sites_found' WHEN 'click' THEN 'urls_extracted'
                    WHEN 'purchase' THEN 'approved' ELSE 'error' END AS status
        FROM events""",
    "b_questions": """
        SELECT event_id AS query_id, concat(event_type, CASE WHEN value > 50 THEN ' with login' ELSE '' END) AS text, value
        FROM events""",
    "b_sites": """
        SELECT c_custkey AS site_id, c_name AS title,
               concat('https://', lower(c_mktsegment), '.example/', CASE WHEN c_nationkey < 15 THEN 'docs' WHEN c_nationkey < 20 THEN 'guide' ELSE 'home' END) AS url,
               CASE WHEN c_acctbal < 1000 THEN 'timeout' WHEN c_acctbal < 2000 THEN 'error' ELSE 'completed' END AS status
        FROM customer""",
    "b_links": """
        SELECT o_custkey AS site_id, o_orderkey AS link_no, concat('https://shop.example/', lower(o_orderstatus), '/the-', o_orderkey, '_page/') AS link
        FROM orders""",
    "b_responses": """
        SELECT event_id, CASE event_type WHEN 'click' THEN props
                 WHEN 'view' THEN concat('Result:', chr(10), '```json', chr(10), replace(props, '}', ',}'), chr(10), '```')
                 WHEN 'signup' THEN concat('```', chr(10), props, chr(10), '```')
                 WHEN 'purchase' THEN concat('so ', props, ' it is ', props)
                 ELSE concat('{', props) END AS response
        FROM events""",
    "b_reports": """
        SELECT conv_id * 1000 + turn AS report_id,
               concat('- too early', chr(10), 'Key Findings', chr(10), '- ', replace(text, chr(10), concat(chr(10), '* ')), chr(10), chr(10),
                      CASE role WHEN 'user' THEN 'We suggest:' ELSE 'Overall architecture' END, chr(10), '1. first ', role, chr(10), '  2. second', chr(10), 'plain') AS response
        FROM conversations""",
}
