"""Queries of the generic operators over the driver's tables, each beside the SQL that states it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import text as fn
from factloom.operators import aggregates, graphs, joins, sets, types, walks, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
SELECT d.lang AS language, count(*) AS files, CAST(sum(d.n_chars) AS BIGINT) AS lines,
       round(count(l.doc_id) / CAST(count(*) AS DOUBLE), 6) AS labelled
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY d.lang""")
def q01_language_stats(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l")).distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("language"), F.col("n_chars").alias("line_count")).join(labels, "doc_id", "left")
    stats = aggregates.language_stats(docs)
    known = docs.groupBy("language").agg(F.round(aggregates.share(F.count("l"), F.count(F.lit(1)), 1.0), 6).alias("labelled"))
    return stats.join(known, "language")


@query("""
WITH m(name, entry) AS (VALUES ('signup', 'account'), ('purchase', 'revenue'), ('view', 'traffic'), ('click', 'traffic'))
SELECT coalesce(m.entry, 'other') AS category, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS total
FROM events LEFT JOIN m ON event_type = m.name GROUP BY 1""")
def q02_dictionary_join(spark, sf_dir):
    names = spark.createDataFrame([("signup", False, "account"), ("purchase", False, "revenue"), ("view", False, "traffic"), ("click", False, "traffic")], "name string, prefix boolean, entry string")
    kinds = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    known = joins.dictionary(kinds, names, "event_type", "event_type")
    return known.groupBy(F.coalesce("entry", F.lit("other")).alias("category")).agg(F.sum("n").alias("n"), F.sum("total").cast("double").alias("total"))


@query("""
WITH p AS (SELECT page_id, rtrim(split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1), '/') AS path FROM pages),
o AS (SELECT DISTINCT split_part(path, '/', 1) AS prefix FROM p UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || l FROM p, (VALUES ('en'), ('de')) t(l)),
m AS (SELECT p.page_id, o.prefix, row_number() OVER (PARTITION BY p.page_id ORDER BY length(o.prefix) DESC) AS r
      FROM p JOIN o ON split_part(p.path, '/', 1) = split_part(o.prefix, '/', 1) AND (p.path = o.prefix OR starts_with(p.path, o.prefix || '/')))
SELECT page_id, prefix AS owner FROM m WHERE r = 1""")
def q03_longest_prefix(spark, sf_dir):
    rest = F.substring_index(F.substring_index(F.split_part("url", F.lit("://"), F.lit(2)), "?", 1), "#", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", F.rtrim(rest, F.lit("/")).alias("path"))
    hosts = pages.select(F.substring_index("path", "/", 1).alias("h")).distinct()
    owners = hosts.select(F.explode(F.array(F.col("h"), F.concat("h", F.lit("/en")), F.concat("h", F.lit("/de")))).alias("prefix")).withColumn("owner", F.col("prefix"))
    return joins.longest_prefix(pages, owners, "page_id", "path", "prefix", "owner").select("page_id", "owner")


@query(r"""
WITH p AS (SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT host, '/' || array_to_string(list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN '{}' ELSE x END), '/') AS template, count(*) AS n
FROM p GROUP BY 1, 2""")
def q04_route_templates(spark, sf_dir):
    parts = F.filter(F.split(fn.url_path(F.col("url")), "/"), lambda s: s != "")
    numbered = F.concat(F.lit("/"), F.array_join(F.transform(parts, lambda s: F.when(s.rlike("^[0-9]+$"), F.lit(":id")).otherwise(s)), "/"))
    return table(spark, sf_dir, "pages").select(fn.url_host(F.col("url")).alias("host"), fn.same_params(numbered).alias("template")).groupBy("host", "template").agg(F.count("*").alias("n"))


OPERATIONS = [
    ("com:GET /en/{id}", "com", "GET", "/en/{id}", False), ("net:GET /en/{id}", "net", "GET", "/en/{id}", False), ("org:ANY /{lang}/{id}", "org", "ANY", "/{lang}/{id}", False),
    ("hub:GET /{id}", "hub", "GET", "/{id}", True), ("api:GET /v1/de/{id}", "api", "GET", "/v1/de/{id}", False), ("all:POST /fr/{id}", "all", "POST", "/fr/{id}", False),
]


@query("""
WITH ops(operation, unit, method, path, part) AS (VALUES ('com:GET /en/{id}', 'com', 'GET', '/en/{id}', false), ('net:GET /en/{id}', 'net', 'GET', '/en/{id}', false),
  ('org:ANY /{lang}/{id}', 'org', 'ANY', '/{lang}/{id}', false), ('hub:GET /{id}', 'hub', 'GET', '/{id}', true), ('api:GET /v1/de/{id}', 'api', 'GET', '/v1/de/{id}', false), ('all:POST /fr/{id}', 'all', 'POST', '/fr/{id}', false)),
o AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS os FROM ops),
c AS (SELECT page_id AS call_id, regexp_extract(url, '://[^/?#]*[.]([a-z]+)', 1) AS unit, CASE WHEN page_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method,
             list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS cs FROM pages),
cand AS (SELECT call_id, operation, part, cs, os, len(cs) AS cn, len(os) AS n FROM c JOIN o ON c.unit <> o.unit AND (c.method = o.method OR o.method = 'ANY')),
fit AS (SELECT *, least(cn, n) AS k, len(list_filter(range(1, least(cn, n) + 1), lambda i: NOT (cs[cn - least(cn, n) + i] = os[n - least(cn, n) + i] OR starts_with(cs[cn - least(cn, n) + i], '{') OR starts_with(os[n - least(cn, n) + i], '{')))) AS bad,
               len(list_filter(range(1, least(cn, n) + 1), lambda i: cs[cn - least(cn, n) + i] = os[n - least(cn, n) + i] OR (starts_with(cs[cn - least(cn, n) + i], '{') AND starts_with(os[n - least(cn, n) + i], '{')))) AS same FROM cand),
scored AS (SELECT call_id, operation, CASE WHEN bad > 0 THEN NULL WHEN cn = n THEN 1000 + same WHEN cn > n AND n > 0 AND part THEN 500 + n WHEN n > cn AND cn > 0 THEN 100 + cn END AS score FROM fit),
best AS (SELECT call_id, max(score) AS score FROM scored GROUP BY 1)
SELECT c.call_id, b.score, CASE WHEN count(s.operation) = 1 THEN min(s.operation) END AS operation
FROM c LEFT JOIN best b USING (call_id) LEFT JOIN scored s ON s.call_id = c.call_id AND s.score = b.score GROUP BY 1, 2""")
def q05_best_match(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    calls = pages.select(
        F.col("page_id").alias("call_id"), F.regexp_extract("url", "://[^/?#]*[.]([a-z]+)", 1).alias("unit"), F.when(F.col("page_id") % 3 == 0, "POST").otherwise("GET").alias("method"), fn.url_path(F.col("url")).alias("path")
    )
    operations = spark.createDataFrame(OPERATIONS, "operation string, unit string, method string, path string, path_partial boolean")
    return joins.best_match(calls, operations).select("call_id", F.col("score").cast("long").alias("score"), "operation")


EDGES = """
WITH RECURSIVE e AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS n, min(l_orderkey) AS first_order
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS r FROM e WHERE src <> dst),
one AS (SELECT src, dst FROM ranked WHERE r = 1), two AS (SELECT src, dst, n, r FROM ranked WHERE r <= 2), three AS (SELECT src, dst FROM ranked WHERE r <= 3 AND src < dst)"""


def _shipments(spark, sf_dir) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    met = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return met.select("src", "dst", F.col("l_orderkey").alias("order"))


def _edges(spark, sf_dir, most: int) -> DataFrame:
    """Each nation's `most` busiest other nations."""
    counted = _shipments(spark, sf_dir).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return windows.top_per_group(counted, ["src"], [F.desc("n"), "dst"], most, "r")


@query("""
WITH l AS (SELECT 'n' || s_nationkey AS source, 'n' || c_nationkey AS target, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_quantity > 45 THEN 'code' WHEN l_linenumber = 1 THEN 'compose' ELSE 'manifest' END AS origin,
                  o_orderpriority AS edge_type, o_orderstatus AS label, 'o' || l_orderkey AS evidence
           FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey <> c_nationkey),
r AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY seq) AS n FROM l),
c AS (SELECT source, target, min(n) FILTER (WHERE origin = 'code') AS c FROM r GROUP BY 1, 2),
o AS (SELECT r.*, CASE WHEN n = c THEN 0 ELSE n END AS pos FROM r JOIN c USING (source, target)),
x AS (SELECT *, lag(evidence) OVER (PARTITION BY source, target ORDER BY pos) AS before FROM o),
e AS (SELECT source, target, evidence, pos, row_number() OVER (PARTITION BY source, target ORDER BY pos) AS k FROM x WHERE before IS DISTINCT FROM evidence)
SELECT o.source, o.target, arg_min(edge_type, o.pos) AS edge_type, arg_min(label, o.pos) AS label, (SELECT string_agg(DISTINCT origin, '+' ORDER BY origin) FROM l WHERE l.source = o.source AND l.target = o.target) AS sources,
       (SELECT string_agg(evidence, ',' ORDER BY pos) FROM e WHERE e.source = o.source AND e.target = o.target AND k <= 6) AS evidence FROM o GROUP BY 1, 2""")
def q06_merge_edges(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    customer, supplier = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    met = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    origin = F.when(F.col("l_quantity") > 45, "code").when(F.col("l_linenumber") == 1, "compose").otherwise("manifest")
    rows = met.select(
        F.concat(F.lit("n"), "s_nationkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target"), F.col("o_orderpriority").alias("edge_type"), F.col("o_orderstatus").alias("label"), origin.alias("origin"),
        F.concat(F.lit("o"), "l_orderkey").alias("evidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    return aggregates.merge_relationships(rows).select("source", "target", "edge_type", "label", F.array_join("sources", "+").alias("sources"), F.array_join("evidence", ",").alias("evidence"))


@query(EDGES + """,
d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM two UNION ALL SELECT dst FROM two) GROUP BY 1)
SELECT node, degree, row_number() OVER (ORDER BY degree DESC, node) = 1 AS is_focal FROM d""")
def q07_degree_focal(spark, sf_dir):
    two = _edges(spark, sf_dir, 2)
    focal = graphs.focal(two).select("node", F.lit(True).alias("f"))
    return graphs.degrees(two).join(focal, "node", "left").select("node", "degree", F.coalesce("f", F.lit(False)).alias("is_focal"))


@query(EDGES + """,
c AS (SELECT src, dst FROM one UNION SELECT c.src, one.dst FROM c JOIN one ON c.dst = one.src)
SELECT src, dst FROM c""")
def q08_closure(spark, sf_dir):
    return graphs.closure(_edges(spark, sf_dir, 1))


@query(EDGES + """,
c AS (SELECT src, dst FROM one UNION SELECT c.src, one.dst FROM c JOIN one ON c.dst = one.src),
nodes AS (SELECT src AS node FROM one UNION SELECT dst FROM one)
SELECT node, coalesce(least(node, min(a.dst)), node) AS component FROM nodes LEFT JOIN (SELECT a.src, a.dst FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src) a ON a.src = node GROUP BY node""")
def q09_strong_components(spark, sf_dir):
    return graphs.strong_components(_edges(spark, sf_dir, 1))


@query(EDGES + """,
u AS (SELECT src AS a, dst AS b FROM one UNION SELECT dst, src FROM one),
c AS (SELECT a, b FROM u UNION SELECT c.a, u.b FROM c JOIN u ON c.b = u.a)
SELECT a AS node, least(a, min(b)) AS component FROM c GROUP BY a""")
def q10_weak_components(spark, sf_dir):
    return graphs.weak_components(_edges(spark, sf_dir, 1))


@query(EDGES + """,
b AS (SELECT 0 AS node, 0 AS hops UNION SELECT two.dst, b.hops + 1 FROM b JOIN two ON two.src = b.node WHERE b.hops < 25)
SELECT node, min(hops) AS hops FROM b GROUP BY node""")
def q11_hops(spark, sf_dir):
    return graphs.hops(_edges(spark, sf_dir, 2), [0])


@query(EDGES + """,
c AS (SELECT src, dst FROM three UNION SELECT c.src, t.dst FROM c JOIN three t ON c.dst = t.src)
SELECT t.src, t.dst FROM three t WHERE EXISTS (SELECT 1 FROM three s JOIN c ON c.src = s.dst WHERE s.src = t.src AND c.dst = t.dst)""")
def q12_shortcuts(spark, sf_dir):
    return graphs.shortcuts(_edges(spark, sf_dir, 3).where("src < dst"))


@query(EDGES + """,
m AS (SELECT a.n_regionkey AS src, b.n_regionkey AS dst, CASE WHEN n % 2 = 0 THEN 'even' ELSE 'odd' END AS label, r = 1 AS is_primary
      FROM two JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst WHERE a.n_regionkey <> b.n_regionkey)
SELECT src, dst, bool_or(is_primary) AS is_primary, CASE WHEN count(DISTINCT label) = 1 THEN min(label) END AS label, count(*) AS merged FROM m GROUP BY 1, 2""")
def q13_contract(spark, sf_dir):
    edges = _edges(spark, sf_dir, 2).select("src", "dst", F.when(F.col("n") % 2 == 0, "even").otherwise("odd").alias("label"), (F.col("r") == 1).alias("is_primary"))
    groups = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("group"))
    return graphs.contract(edges, groups)


@query("""
WITH b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-04-01' GROUP BY 1),
h AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderdate < TIMESTAMP '2000-04-01' GROUP BY 1)
SELECT coalesce(h.k, b.k) AS customer, CASE WHEN b.k IS NULL THEN 'added' WHEN h.k IS NULL THEN 'removed' ELSE 'changed' END AS verb,
       CASE WHEN b.k IS NULL THEN 0 WHEN h.k IS NULL THEN 1 ELSE 2 END AS ordinal, b.n AS orders_before, h.n AS orders_after
FROM b FULL JOIN h ON b.k = h.k WHERE b.n IS DISTINCT FROM h.n""")
def q14_keyed_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), "o_orderdate")

    def quarter(since, until):
        return orders.where((F.col("o_orderdate") >= F.lit(since).cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit(until).cast("timestamp_ntz"))).groupBy("customer").agg(F.count("*").alias("orders"))

    return sets.keyed_diff(quarter("1996-01-01", "1996-04-01"), quarter("2000-01-01", "2000-04-01"), ["customer"], ["orders"])


@query("""
WITH s AS (SELECT o_custkey AS customer, list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'F') AS f, list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1)
SELECT customer, array_to_string(list_sort(list_filter(coalesce(p, []), lambda x: NOT list_contains(coalesce(f, []), x))), ',') AS gains,
       array_to_string(list_sort(list_filter(coalesce(f, []), lambda x: NOT list_contains(coalesce(p, []), x))), ',') AS losses FROM s""")
def q15_gains_losses(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(
        F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("f"), F.collect_set(F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))).alias("p")
    )
    return sets.gains_and_losses(per, "f", "p").select("customer", F.array_join("gains", ",").alias("gains"), F.array_join("losses", ",").alias("losses"))


@query("""
WITH d AS (SELECT CASE WHEN doc_id % 97 = 0 THEN NULL ELSE 'GET' END AS m, '/docs/' || (doc_id + 500) AS p, quality, toxic FROM labels),
i AS (SELECT 'GET' AS m, '/docs/' || doc_id AS p, doc_id % 3 = 0 AS less FROM documents)
SELECT coalesce(d.m, i.m) AS method, coalesce(d.p, i.p) AS path,
       CASE WHEN d.p IS NOT NULL AND d.m IS NULL THEN 'not-checkable' WHEN d.p IS NULL THEN 'unrequested' WHEN i.p IS NULL THEN 'missing' WHEN i.less AND (quality = 1 OR toxic = 1) THEN 'partial' ELSE 'matched' END AS verdict
FROM d FULL JOIN i ON d.m = i.m AND d.p = i.p""")
def q16_conform(spark, sf_dir):
    declared = table(spark, sf_dir, "labels").select(
        F.when(F.col("doc_id") % 97 != 0, "GET").alias("method"), F.concat(F.lit("/docs/"), (F.col("doc_id") + 500).cast("string")).alias("path"), F.array(F.col("quality").cast("int"), F.col("toxic").cast("int")).alias("statuses")
    )
    implemented = table(spark, sf_dir, "documents").select(
        F.lit("GET").alias("method"), F.concat(F.lit("/docs/"), F.col("doc_id").cast("string")).alias("path"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))).alias("statuses"), F.col("doc_id").alias("pos")
    )
    return sets.conform(declared, implemented).select("method", "path", "verdict")


@query("""
WITH w AS (SELECT 'w' || i AS bid, i * 180 AS lo, i * 180 + 6 AS hi FROM range(0, 14) t(i)),
o AS (SELECT l_orderkey AS k, min(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))) AS lo, max(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))) AS hi FROM lineitem GROUP BY 1)
SELECT bid AS win, count(*) AS orders, min(k) AS first_order, max(k) AS last_order FROM w JOIN o ON o.lo <= w.hi AND o.hi >= w.lo GROUP BY 1""")
def q17_interval_overlap(spark, sf_dir):
    day = F.datediff(F.col("l_shipdate"), F.lit("1995-01-01").cast("date"))
    spans = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("aid")).agg(F.min(day).alias("alo"), F.max(day).alias("ahi")).withColumn("scope", F.lit("ship"))
    wins = spark.range(14).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("bid"), (F.col("id") * 180).cast("int").alias("blo"), (F.col("id") * 180 + 6).cast("int").alias("bhi"), F.lit("ship").alias("scope"))
    met = joins.overlapping(spans, wins, "scope", 90)
    return met.groupBy(F.col("bid").alias("win")).agg(F.count("*").alias("orders"), F.min("aid").alias("first_order"), F.max("aid").alias("last_order"))


@query("""
WITH p AS (SELECT event_id, CAST(epoch(ts) / 60 AS BIGINT) - 28401120 + CASE WHEN CAST(epoch(ts) / 60 AS BIGINT) * 60 > epoch(ts) THEN -1 ELSE 0 END AS m FROM events)
SELECT event_id, CASE WHEN (m // 60) % 5 = 0 THEN 'h' || (m // 60) WHEN (m // 360) % 2 = 0 THEN 's' || (m // 360) ELSE 'd' || (m // 1440) END AS id FROM p""")
def q18_innermost(spark, sf_dir):
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000) - 28401120
    points = table(spark, sf_dir, "events").select("event_id", minute.alias("m"), F.lit(0).alias("scope"))
    spans = []
    for kind, size, every in (("d", 1440, 1), ("s", 360, 2), ("h", 60, 5)):
        n = spark.range(0, 31 * 1440 // size, every)
        spans.append(n.select(F.concat(F.lit(kind), F.col("id").cast("string")).alias("id"), (F.col("id") * size).alias("lo"), (F.col("id") * size + size - 1).alias("hi"), F.lit(0).alias("scope")))
    return joins.innermost(points, spans[0].unionByName(spans[1]).unionByName(spans[2]), "scope", "m", 60).select("event_id", "id")


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type""")
def q19_collapse_adjacent(spark, sf_dir):
    return windows.collapse_adjacent(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "event_type")


NEXT = """
WITH RECURSIVE t AS (SELECT a, b, count(*) AS n FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2)"""


def _transitions(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    moves = table(spark, sf_dir, "events").select(F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b")).where("b is not null and a <> b")
    return moves.groupBy("a", "b").agg(F.count("*").alias("n"))


@query(NEXT + """,
up AS (SELECT * FROM t WHERE a < b)
SELECT s AS state, EXISTS (SELECT 1 FROM up WHERE b = s) AS incoming, EXISTS (SELECT 1 FROM up WHERE a = s) AS outgoing,
       EXISTS (SELECT 1 FROM up WHERE b = s) AND NOT EXISTS (SELECT 1 FROM up WHERE a = s) AS terminal
FROM (SELECT a AS s FROM up UNION SELECT b FROM up)""")
def q20_state_flags(spark, sf_dir):
    from factloom.plans.states import flags

    up = _transitions(spark, sf_dir).where("a < b").select(F.lit("m").alias("machine"), F.col("a").alias("from"), F.col("b").alias("to"))
    return flags(up).select("state", "incoming", "outgoing", "terminal")


@query(NEXT + """,
best AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM t) WHERE r = 1),
c AS (SELECT 'signup' AS state, 0 AS hops UNION SELECT best.b, c.hops + 1 FROM c JOIN best ON best.a = c.state WHERE c.hops < 9)
SELECT state, min(hops) AS hops FROM c GROUP BY 1""")
def q21_reachable_states(spark, sf_dir):
    best = windows.top_per_group(_transitions(spark, sf_dir), ["a"], [F.desc("n"), "b"], 1)
    return graphs.hops(best, ["signup"], "a", "b").withColumnRenamed("node", "state")


@query("""
WITH v AS (SELECT user_id, event_type, CAST(sum(CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END) AS BIGINT) AS votes FROM events GROUP BY 1, 2)
SELECT user_id, event_type AS choice, votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) AS r FROM v) WHERE r = 1""")
def q22_weighted_vote(spark, sf_dir):
    return aggregates.vote(table(spark, sf_dir, "events"), ["user_id"], "event_type", F.when(F.col("event_type") == "purchase", 2).otherwise(1))


@query("""
WITH r AS (SELECT d.source, count(l.doc_id) / CAST(count(*) AS DOUBLE) AS a, sum(l.quality) / CAST(nullif(count(l.doc_id), 0) AS DOUBLE) AS b, sum(1 - l.toxic) / CAST(nullif(count(l.doc_id), 0) AS DOUBLE) AS c
           FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1)
SELECT source, CAST(floor(100 * (a + coalesce(b, 0) + coalesce(c, 0)) / (1 + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT)) AS BIGINT) AS score,
       CASE WHEN a <= coalesce(b, 2) AND a <= coalesce(c, 2) THEN 'labelled' WHEN b <= coalesce(c, 2) THEN 'good' ELSE 'civil' END AS weakest FROM r""")
def q23_score(spark, sf_dir):
    met = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").withColumn("l", F.lit(1)), "doc_id", "left")
    n = F.count("l")
    per = met.groupBy("source").agg(aggregates.share(n, F.count(F.lit(1))).alias("a"), aggregates.share(F.sum("quality"), n).alias("b"), aggregates.share(F.sum(1 - F.col("toxic")), n).alias("c"))
    ratios = {"labelled": F.col("a"), "good": F.col("b"), "civil": F.col("c")}
    return per.select("source", aggregates.score(list(ratios.values())).alias("score"), aggregates.weakest(ratios).alias("weakest"))


@query("""SELECT sha256(text) AS h, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text""")
def q24_first_definition(spark, sf_dir):
    # the digest stands for the text, so that texts don't move
    rows = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"), "doc_id")
    return windows.first_definition(rows, ["h"], ["doc_id"]).join(rows.groupBy("h").agg(F.count("*").alias("copies")), "h")


@query("""
WITH p AS (SELECT regexp_extract(props, '"k": ([0-9]+)', 1) AS k, 'm' || (user_id % 10) AS module, event_id, event_type FROM events),
a AS (SELECT k, module, count(*) AS p, min(event_id) AS first FROM p WHERE event_type IN ('signup', 'purchase') GROUP BY 1, 2),
b AS (SELECT k, module, count(*) AS q FROM p WHERE event_type IN ('view', 'click') GROUP BY 1, 2)
SELECT a.module AS src, b.module AS dst, CAST(sum(p * q) AS BIGINT) AS weight, min(first) AS first_at FROM a JOIN b USING (k) WHERE a.module <> b.module GROUP BY 1, 2""")
def q25_publish_listen(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("event"), F.concat(F.lit("m"), (F.col("user_id") % 10).cast("string")).alias("module"), F.col("event_id").alias("at"), "event_type")
    return joins.publish_listen(events.where(F.col("event_type").isin("signup", "purchase")), events.where(F.col("event_type").isin("view", "click")))


@query("""
WITH k AS (SELECT DISTINCT p_brand AS b FROM part), q AS (SELECT DISTINCT replace(p_brand, 'd#', '') || '0' AS a FROM part),
d AS (SELECT a, b, levenshtein(lower(a), lower(b)) AS d FROM q, k),
ok AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM d WHERE d <= greatest(1, floor(greatest(strlen(a), strlen(b)) / 3)))
SELECT q.a AS name, ok.b AS suggestion, CAST(ok.d AS INTEGER) AS distance FROM q LEFT JOIN ok ON ok.a = q.a AND ok.r = 1""")
def q26_nearest_name(spark, sf_dir):
    known = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    asked = known.select(F.concat(F.replace("name", F.lit("d#"), F.lit("")), F.lit("0")).alias("name")).distinct()
    return joins.nearest_name(asked, known)


@query("""
WITH p AS (SELECT p_brand AS brand, p_partkey AS part, CAST(round(p_retailprice * 100) AS BIGINT) AS saves FROM part),
r AS (SELECT *, CAST(sum(saves) OVER (PARTITION BY brand ORDER BY saves DESC, part ROWS UNBOUNDED PRECEDING) AS BIGINT) AS covered FROM p)
SELECT brand, part, saves, covered FROM r WHERE covered - saves < 500000 OR covered = saves""")
def q27_greedy_cover(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("part"), F.round(F.col("p_retailprice") * 100).cast("long").alias("saves"))
    return windows.greedy_cover(parts, ["brand"], [F.desc("saves"), "part"], "saves", F.lit(500000))


@query(EDGES + """,
bad AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS pos FROM one UNION ALL SELECT 0, 99, 100 UNION ALL SELECT 3, 3, 101 UNION ALL (SELECT src, dst, 102 FROM one ORDER BY src, dst LIMIT 1)),
nodes AS (SELECT n_nationkey AS node FROM nation UNION ALL SELECT 100)
SELECT 'ERR_MISSING_ENDPOINT' AS code, count(*) AS n FROM bad WHERE src NOT IN (SELECT node FROM nodes) OR dst NOT IN (SELECT node FROM nodes)
UNION ALL SELECT 'ERR_SELF_LOOP', count(*) FROM bad WHERE src = dst
UNION ALL SELECT 'WARN_DUPLICATE_EDGE', count(*) FROM (SELECT row_number() OVER (PARTITION BY src, dst ORDER BY pos) AS r FROM bad) WHERE r > 1
UNION ALL SELECT 'ERR_ORPHAN_NODE', count(*) FROM nodes WHERE node NOT IN (SELECT src FROM bad UNION ALL SELECT dst FROM bad)""")
def q28_edge_checks(spark, sf_dir):
    from factloom.plans.validate import edge_checks

    one = _edges(spark, sf_dir, 1).select("src", "dst")
    numbered = one.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("src", "dst")))  # one edge a nation
    extra = spark.createDataFrame([(0, 99, 100), (3, 3, 101)], "src int, dst int, pos int").unionByName(numbered.where("pos = 1").select("src", "dst", F.lit(102).alias("pos")))
    edges = numbered.unionByName(extra).select(F.lit("d").alias("diagram"), "pos", F.concat(F.lit("e"), "pos").alias("id"), F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"))
    nodes = table(spark, sf_dir, "nation").select(F.lit("d").alias("diagram"), F.col("n_nationkey").cast("string").alias("id")).unionByName(spark.createDataFrame([("d", "100")], "diagram string, id string"))
    return edge_checks(nodes, edges).groupBy("code").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderpriority AS priority, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def q29_matrix(spark, sf_dir):
    return aggregates.matrix(table(spark, sf_dir, "orders"), [F.col("o_orderpriority").alias("priority")], "o_orderstatus", ["F", "O", "P"], F.count(F.lit(1)))


@query("""
WITH s AS (SELECT o_custkey AS c, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS neighbours FROM orders GROUP BY 1)
SELECT neighbours, count(*) AS members, min(c) AS first_member FROM s GROUP BY 1""")
def q30_neighbourhoods(spark, sf_dir):
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("src"), F.concat(F.lit("p:"), "o_orderpriority").alias("dst"))
    near = graphs.neighbourhoods(edges).where(~F.col("node").startswith("p:"))
    named = F.array_join(F.transform("neighbours", lambda x: F.substring(x["other"], 3, 1 << 30)), ",")
    return near.groupBy(named.alias("neighbours")).agg(F.count("*").alias("members"), F.min(F.col("node").cast("long")).alias("first_member"))


@query("""
WITH m AS (SELECT page_id, regexp_extract_all(html, '<(?:h1|h2|p|li)>([^<]*)', 1) AS t, regexp_extract_all(html, '<(h1|h2|p|li)>[^<]*', 1) AS k FROM pages),
x AS (SELECT page_id, i - 1 AS pos, k[i] AS kind, t[i] AS said FROM (SELECT *, unnest(range(1, len(k) + 1)) AS i FROM m))
SELECT page_id, CAST(pos AS INTEGER) AS pos, kind, last_value(CASE WHEN kind IN ('h1', 'h2') THEN said END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS heading FROM x""")
def q31_carry_heading(spark, sf_dir):
    kinds = F.regexp_extract_all("html", F.lit("<(h1|h2|p|li)>[^<]*"), F.lit(1))
    said = F.regexp_extract_all("html", F.lit("<(?:h1|h2|p|li)>([^<]*)"), F.lit(1))
    marks = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.arrays_zip(kinds.alias("kind"), said.alias("said"))).alias("pos", "m")).select("page_id", "pos", "m.kind", "m.said")
    return windows.carry_forward(marks, ["page_id"], ["pos"], F.when(F.col("kind").isin("h1", "h2"), F.col("said")), "heading").select("page_id", "pos", "kind", "heading")


@query("""
SELECT o_orderpriority AS priority, o_orderkey AS "order", CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 24""")
def q32_top_per_group(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("order"), "o_totalprice")
    return windows.top_per_group(orders, ["priority"], [F.desc("o_totalprice"), "order"], 24).select("priority", "order", "rank")


@query("""
SELECT p_partkey AS part, CAST(floor((row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) - 1) / 12) + 1 AS INTEGER) AS chunk,
       CASE WHEN row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) = 1 THEN p_name ELSE p_name || '-' || row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) END AS id FROM part""")
def q33_chunks_and_ids(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_name").alias("id"))
    return windows.disambiguate(windows.chunked(parts, ["brand"], ["name", "part"]), ["brand"], "id", ["part"]).select("part", "chunk", "id")


@query("""
WITH k AS (SELECT p_brand AS key, p_type AS statement, min(p_partkey) AS first FROM part GROUP BY 1, 2)
SELECT key, statement, first, list_reduce(list_transform(string_split(key || ': ' || statement, ''), lambda x: CAST(ord(x) AS BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295, 2166136261) AS id32,
       'BR-' || substr(lpad(lower(format('{:x}', list_reduce(list_transform(string_split(key || ': ' || statement, ''), lambda x: CAST(ord(x) AS UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) & 18446744073709551615::UHUGEINT, 14695981039346656037::UHUGEINT)::UBIGINT)), 16, '0'), 1, 6) AS rule_id
FROM k""")
def q34_rule_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.col("p_type").alias("statement"), F.col("p_partkey").alias("evidence"))
    said = F.concat_ws(": ", "key", "statement")
    return aggregates.catalogue(rows, ["key", "statement"], ["evidence"]).select("key", "statement", "first", fn.fnv32(said).alias("id32"), F.concat(F.lit("BR-"), F.substring(fn.fnv64(said), 1, 6)).alias("rule_id"))


@query("""
WITH e AS (SELECT DISTINCT p_type AS alias, p_size AS unit, p_brand AS entity FROM part),
a AS (SELECT c_custkey AS access_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'ECONOMY' WHEN 'MACHINERY' THEN 'SMALL' ELSE 'PROMO' END AS alias, c_nationkey * 2 + 1 AS unit FROM customer),
m AS (SELECT access_id, count(DISTINCT entity) FILTER (WHERE a.unit = e.unit) AS no, min(entity) FILTER (WHERE a.unit = e.unit) AS eo, count(DISTINCT entity) AS na, min(entity) AS ea FROM a JOIN e USING (alias) GROUP BY 1)
SELECT access_id, alias, unit, CASE WHEN no = 1 THEN eo WHEN no = 0 AND na = 1 THEN ea END AS entity FROM a LEFT JOIN m USING (access_id)""")
def q35_prefer_own(spark, sf_dir):
    entities = table(spark, sf_dir, "part").select(F.col("p_type").alias("alias"), F.col("p_size").alias("unit"), F.col("p_brand").alias("entity")).distinct()
    alias = F.when(F.col("c_mktsegment") == "BUILDING", "ECONOMY").when(F.col("c_mktsegment") == "MACHINERY", "SMALL").otherwise("PROMO")
    accesses = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("access_id"), alias.alias("alias"), (F.col("c_nationkey") * 2 + 1).alias("unit"))
    return joins.prefer_own(accesses, entities).select("access_id", "alias", "unit", "entity")


@query("""
WITH s AS (SELECT source, lang, CAST(sum(n_chars) AS BIGINT) AS weight FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2)
SELECT source, lang AS language, weight FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, lang) AS r FROM s) WHERE r = 1""")
def q36_dominant(spark, sf_dir):
    return aggregates.dominant(table(spark, sf_dir, "documents").where("lang is not null"), ["source"], "lang", "n_chars", "language")


@query("""
WITH c AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2)
SELECT source, string_agg(n || ' ' || lang, ', ' ORDER BY n DESC, lang) AS census FROM c GROUP BY 1""")
def q37_census(spark, sf_dir):
    return aggregates.census(table(spark, sf_dir, "documents").where("lang is not null"), ["source"], "lang")


@query("""
WITH r AS (SELECT 't' || n_regionkey AS tab, 'u' || (n_nationkey % 3) AS unit, n_nationkey % 4 = 0 AND n_regionkey <> 2 AS physical,
                  CASE WHEN n_nationkey % 4 = 0 AND n_regionkey <> 2 THEN 'ddl' WHEN n_nationkey % 4 = 1 THEN 'alembic' ELSE 'jpa' END AS source, n_nationkey AS pos, n_name AS col FROM nation),
t AS (SELECT tab, count(DISTINCT unit) FILTER (WHERE NOT physical) AS units, bool_or(physical) AS known FROM r GROUP BY 1),
k AS (SELECT r.*, CASE WHEN units > 1 AND NOT known THEN 'entity:' || unit || '.' || tab ELSE 'entity:' || tab END AS entity, CASE WHEN physical THEN 0 ELSE 1 END AS p, CASE source WHEN 'ddl' THEN 0 WHEN 'alembic' THEN 1 ELSE 3 END AS rank FROM r JOIN t USING (tab)),
o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY p, rank, pos) AS n FROM k),
s AS (SELECT entity, string_agg(source, '+' ORDER BY rank) AS source FROM (SELECT DISTINCT entity, source, rank FROM k) GROUP BY 1)
SELECT entity, tab AS "table", s.source, string_agg(DISTINCT unit, ',' ORDER BY unit) AS declared_by, CASE WHEN bool_or(physical AND n = 1) THEN max(col) FILTER (WHERE n = 1) ELSE string_agg(col, ',' ORDER BY n) END AS columns
FROM o JOIN s USING (entity) GROUP BY 1, 2, 3""")
def q38_merge_entities(spark, sf_dir):
    physical = (F.col("n_nationkey") % 4 == 0) & (F.col("n_regionkey") != 2)
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("t"), "n_regionkey").alias("table"), F.concat(F.lit("u"), (F.col("n_nationkey") % 3).cast("string")).alias("unit"), F.when(physical, "ddl").when(F.col("n_nationkey") % 4 == 1, "alembic").otherwise("jpa").alias("source"),
        physical.alias("physical"), F.col("n_nationkey").alias("pos"), F.array(F.struct(F.col("n_name").alias("name"), none.alias("references"), none.alias("default"))).alias("columns"),
    )
    out = aggregates.merge_entities(rows)
    return out.select("entity", "table", "source", F.array_join("declared_by", ",").alias("declared_by"), F.array_join(F.transform("columns", lambda c: c["name"]), ",").alias("columns"))


@query(EDGES + """,
busy AS (SELECT src, dst FROM ranked WHERE r <= 3),
p AS (SELECT 0 AS node, [0] AS path UNION ALL SELECT busy.dst, list_append(p.path, busy.dst) FROM p JOIN busy ON busy.src = p.node WHERE len(p.path) < 8 AND NOT list_contains(p.path, busy.dst)),
best AS (SELECT path FROM p WHERE node = 10 ORDER BY len(path), path LIMIT 1)
SELECT CAST(i AS INTEGER) AS pos, path[i] AS node FROM best, LATERAL (SELECT unnest(range(1, len(path) + 1)) AS i)""")
def q39_shortest_path(spark, sf_dir):
    found = graphs.shortest_path(_edges(spark, sf_dir, 3), 0, 10)
    return spark.createDataFrame([(i, int(x)) for i, x in enumerate(found, 1)], "pos int, node int")


@query("""
WITH s AS (SELECT n_nationkey AS sid, n_nationkey % 3 AS scope, CASE n_nationkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS st, CASE WHEN n_nationkey % 2 = 1 THEN '5-LOW' END AS pr FROM nation)
SELECT sid, count(*) AS objects, min(o_orderkey) AS first_object FROM s JOIN orders ON o_custkey % 3 = scope AND o_orderstatus = st AND (pr IS NULL OR o_orderpriority = pr) GROUP BY 1""")
def q40_selected(spark, sf_dir):
    key = F.col("n_nationkey")
    status = F.when(key % 3 == 0, "F").when(key % 3 == 1, "O").otherwise("P")
    selector = F.when(key % 2 == 1, F.create_map(F.lit("status"), status, F.lit("priority"), F.lit("5-LOW"))).otherwise(F.create_map(F.lit("status"), status))
    selectors = table(spark, sf_dir, "nation").select(key.alias("sid"), (key % 3).cast("long").alias("namespace"), selector.alias("selector"))
    objects = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("oid"), (F.col("o_custkey") % 3).cast("long").alias("namespace"), F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority").alias("labels"))
    return joins.selected(selectors, objects).groupBy("sid").agg(F.count("*").alias("objects"), F.min("oid").alias("first_object"))


@query("""
WITH h AS (SELECT DISTINCT o_custkey AS class, o_custkey % 40 AS unit, o_orderpriority || o_orderstatus AS m FROM orders),
n AS (SELECT unit, interface, unnest(['1-URGENTF', '5-LOWO', '2-HIGHF', '3-MEDIUMO'][1:k]) AS m, k FROM (SELECT DISTINCT unit FROM h), (VALUES ('two', 2), ('three', 3), ('four', 4)) t(interface, k)),
f AS (SELECT n.unit, interface, class, k FROM n JOIN h USING (unit, m) GROUP BY ALL HAVING count(*) = k),
o AS (SELECT unit, interface, min(class) AS class FROM f GROUP BY 1, 2 HAVING count(*) = 1)
SELECT DISTINCT n.unit, n.interface, o.class FROM n LEFT JOIN o USING (unit, interface)""")
def q41_only_implementor(spark, sf_dir):
    classes = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("class")).agg(F.collect_set(F.concat("o_orderpriority", "o_orderstatus")).alias("methods")).withColumn("unit", F.col("class") % 40)
    wanted = ["1-URGENTF", "5-LOWO", "2-HIGHF", "3-MEDIUMO"]
    kinds = spark.createDataFrame([(name, wanted[:k]) for name, k in (("two", 2), ("three", 3), ("four", 4))], "interface string, methods array<string>")
    interfaces = classes.select("unit").distinct().join(F.broadcast(kinds))  # three rows
    return joins.only_implementor(interfaces, classes).select("unit", "interface", "class")


@query("""
WITH s AS (SELECT o_custkey AS operation, list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'F') AS f, list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY 1)
SELECT operation, CASE WHEN f IS NOT NULL THEN array_to_string(list_sort(list_filter(o, lambda x: NOT list_contains(f, x))), ',') END AS drift FROM s WHERE o IS NOT NULL""")
def q42_drift(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("operation"), "o_orderpriority", "o_orderstatus")
    calls = orders.where("o_orderstatus = 'O'").groupBy("operation").agg(F.collect_set("o_orderpriority").alias("reads"))
    served = orders.where("o_orderstatus = 'F'").groupBy("operation").agg(F.collect_set("o_orderpriority").alias("fields"))
    return sets.drift(calls, served).select("operation", F.array_join("drift", ",").alias("drift"))


@query(r"""
WITH d AS (SELECT DISTINCT split_part(split_part(url, '://', 2), '/', 1) AS host, list_filter(string_split(regexp_extract(url, '://([^?#]*)', 1), '/'), lambda x: x <> '') AS s FROM pages),
m AS (SELECT host, max(len(s)) AS most, count(*) AS paths FROM d GROUP BY 1),
e AS (SELECT d.host, k, paths, count(DISTINCT array_to_string(s[greatest(len(s) - k + 1, 1):], '/')) AS n FROM d JOIN m USING (host), LATERAL (SELECT unnest(range(1, greatest(most, 1) + 1)) AS k) GROUP BY ALL),
b AS (SELECT host, min(k) AS k FROM e WHERE n = paths GROUP BY 1)
SELECT page_id, array_to_string(s[greatest(len(s) - greatest(1, least(coalesce(k, len(s)), len(s))) + 1, 1):], '/') AS suffix
FROM (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, list_filter(string_split(regexp_extract(url, '://([^?#]*)', 1), '/'), lambda x: x <> '') AS s FROM pages) LEFT JOIN b USING (host)""")
def q43_shortest_suffix(spark, sf_dir):
    rest = F.regexp_extract("url", "://([^?#]*)", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"), rest.alias("path"))
    return windows.shortest_suffix(pages, "host", "path").select("page_id", "suffix")


@query("""
SELECT event_id, view_id FROM (SELECT *, max(CASE WHEN event_type = 'view' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS view_id FROM events) WHERE event_type = 'click'""")
def q44_nearest_before(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    marks = events.where("event_type = 'view'").select("user_id", "event_id", F.col("event_id").alias("view_id"))
    return windows.nearest_before(events.where("event_type = 'click'"), marks, ["user_id"], "event_id", "view_id").select("event_id", "view_id")


@query("""
SELECT event_id, event_type FROM (SELECT *, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS w FROM events) WHERE event_type <> 'view' OR w IS NULL OR event_id - w > 500""")
def q45_suppress_after(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "write").when(F.col("event_type") == "view", "read").otherwise("none")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", kind.alias("kind"))
    return windows.suppress_after(events, ["user_id"], "event_id", "kind", 500).select("event_id", "event_type")


SCOPED = ORACLES["q05_best_match"].replace("SELECT page_id AS call_id,", "SELECT page_id AS call_id, starts_with(url, 'https') AS area,", 1).replace("WITH ops(operation, unit, method, path, part) AS (VALUES", "WITH plain(operation, unit, method, path, part) AS (VALUES", 1).replace(
    "o AS (SELECT *,", "ops AS (SELECT area || operation AS operation, unit, method, path, part, area = 'tls ' AS area FROM plain, (VALUES ('tls '), ('bare ')) t(area) WHERE area = 'tls ' OR unit <> 'net'),\no AS (SELECT *,", 1
).replace("ON c.unit <> o.unit AND", "ON c.area = o.area AND c.unit <> o.unit AND", 1)


@query(SCOPED)
def q46_scoped_match(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    calls = pages.select(
        F.col("page_id").alias("call_id"), F.col("url").startswith("https").alias("area"), F.regexp_extract("url", "://[^/?#]*[.]([a-z]+)", 1).alias("unit"), F.when(F.col("page_id") % 3 == 0, "POST").otherwise("GET").alias("method"), fn.url_path(F.col("url")).alias("path")
    )
    both = [(f"{'tls' if area else 'bare'} {o[0]}", *o[1:], area) for area in (True, False) for o in OPERATIONS if area or o[1] != "net"]
    operations = spark.createDataFrame(both, "operation string, unit string, method string, path string, path_partial boolean, area boolean")
    return joins.best_match(calls, operations, "area").select("call_id", F.col("score").cast("long").alias("score"), "operation")


@query("""
WITH ids AS (SELECT r_name AS id FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT 'e' || (n_nationkey % 20) FROM nation)
SELECT 'ERR_INVALID_ID' AS code, count(*) AS n FROM ids WHERE NOT regexp_full_match(id, '[A-Za-z0-9][A-Za-z0-9_.-]*') HAVING count(*) > 0
UNION ALL SELECT 'ERR_DUPLICATE_ID', count(*) FROM (SELECT id FROM ids GROUP BY id HAVING count(*) > 1) HAVING count(*) > 0""")
def q47_id_checks(spark, sf_dir):
    from factloom.plans.validate import id_checks

    d = F.lit("d").alias("diagram")
    nation = table(spark, sf_dir, "nation")
    containers = table(spark, sf_dir, "region").select(d, F.col("r_name").alias("id"))
    edges = nation.select(d, F.concat(F.lit("e"), (F.col("n_nationkey") % 20).cast("string")).alias("id"))
    return id_checks(containers, nation.select(d, F.col("n_name").alias("id")), edges).groupBy("code").agg(F.count("*").alias("n"))


def _types(spark, sf_dir):
    """Types with fields and embeddings, made of nations: cycles, self-embedding and types without a field among them."""
    n, nation = F.col("n_nationkey"), table(spark, sf_dir, "nation")
    of = lambda field, to, embedded, pos, keep: nation.where(keep).select(F.col("n_regionkey").alias("scope"), n.alias("type"), F.lit(field).alias("field"), to.cast("int").alias("to"), F.lit(embedded).alias("embedded"), F.lit(pos).alias("pos"))
    parts = [of("1-URGENT", (n * 7 + 5) % 25, False, 0, n % 3 != 0), of("2-HIGH", (n + 5) % 25, False, 1, n % 4 != 1), of("3-MEDIUM", (n * 3) % 25, False, 2, n % 2 == 0), of("", (n * 2) % 25, True, 3, n % 5 != 4), of("", (n + 10) % 25, True, 4, n % 2 == 1)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])


TYPES_SQL = """
f AS (SELECT n_regionkey AS scope, n_nationkey AS type, '1-URGENT' AS field, (n_nationkey * 7 + 5) % 25 AS t, false AS embedded, 0 AS pos FROM nation WHERE n_nationkey % 3 <> 0
  UNION ALL SELECT n_regionkey, n_nationkey, '2-HIGH', (n_nationkey + 5) % 25, false, 1 FROM nation WHERE n_nationkey % 4 <> 1
  UNION ALL SELECT n_regionkey, n_nationkey, '3-MEDIUM', (n_nationkey * 3) % 25, false, 2 FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT n_regionkey, n_nationkey, '', (n_nationkey * 2) % 25, true, 3 FROM nation WHERE n_nationkey % 5 <> 4
  UNION ALL SELECT n_regionkey, n_nationkey, '', (n_nationkey + 10) % 25, true, 4 FROM nation WHERE n_nationkey % 2 = 1),
near AS (SELECT scope, type, type AS cur, CAST([] AS BIGINT[]) AS ord FROM (SELECT DISTINCT scope, type FROM f)
  UNION SELECT a.scope, a.type, f.t, list_append(a.ord, f.pos) FROM near a JOIN f ON f.scope = a.scope AND f.type = a.cur AND f.embedded WHERE len(a.ord) < 4),
prom AS (SELECT a.scope, a.type, f.field, arg_min(f.t, (len(a.ord), a.ord)) AS t FROM near a JOIN f ON f.scope = a.scope AND f.type = a.cur AND NOT f.embedded GROUP BY 1, 2, 3)"""


@query(f"""
WITH RECURSIVE {TYPES_SQL},
walk AS (SELECT o_custkey AS id, n_regionkey AS scope, o_custkey % 25 AS cur, o_names AS names, 1 AS k FROM (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey)[1:3] AS o_names FROM orders GROUP BY 1) JOIN nation ON n_nationkey = o_custkey % 25
  UNION ALL SELECT id, w.scope, p.t, names, k + 1 FROM walk w JOIN prom p ON p.scope = w.scope AND p.type = w.cur AND p.field = names[k] WHERE k <= len(names))
SELECT id AS chain, CAST(max(CASE WHEN k = len(names) + 1 THEN cur END) AS INTEGER) AS found FROM walk GROUP BY 1""")
def q48_field_chains(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.slice(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), 1, 3).alias("o"))
    chains = orders.withColumn("n_nationkey", F.col("id") % 25).join(table(spark, sf_dir, "nation"), "n_nationkey")
    chains = chains.select("id", F.col("n_regionkey").alias("scope"), F.col("n_nationkey").cast("int").alias("type"), F.col("o.o_orderpriority").alias("names"))
    return walks.chain_ends(chains, walks.promoted(_types(spark, sf_dir), 4)).select(F.col("id").alias("chain"), "found")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS src, CAST((o_custkey * 3 + o_orderkey) % 1000 AS BIGINT) AS dst, CAST(o_orderkey AS BIGINT) AS line, o_orderpriority = '1-URGENT' AS remote, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderstatus END AS via FROM orders),
t(entry, node, ord, depth, hops, vias, round) USING KEY (entry, node) AS (
  SELECT s_suppkey, s_suppkey * 7 % 1000, [s_suppkey], 0, 0, CAST([] AS VARCHAR[]), 0 FROM supplier
  UNION
  SELECT entry, node, s.o, s.d, s.h, s.v, round FROM (
    SELECT t.entry, e.dst AS node, min({'o': list_append(t.ord, e.line), 'd': CASE WHEN e.remote THEN 0 ELSE t.depth + 1 END, 'h': t.hops + CAST(e.remote AS INTEGER), 'v': CASE WHEN e.remote THEN list_append(t.vias, e.via) ELSE t.vias END}) AS s, t.round + 1 AS round
    FROM t JOIN e ON e.src = t.node
    WHERE CASE WHEN e.remote THEN t.hops < 2 AND NOT list_contains(t.vias, e.via) ELSE t.depth < 2 END AND NOT EXISTS (SELECT 1 FROM recurring.t r WHERE r.entry = t.entry AND r.node = e.dst)
    GROUP BY t.entry, e.dst, t.round))
SELECT entry, node, array_to_string(ord, '.') AS "order", depth, hops FROM t""")
def q49_traverse(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    remote = F.col("o_orderpriority") == "1-URGENT"
    edges = orders.select(F.col("o_custkey").alias("src"), ((F.col("o_custkey") * 3 + F.col("o_orderkey")) % 1000).alias("dst"), F.array("o_orderkey").alias("order"), remote.alias("remote"), F.when(remote, F.col("o_orderstatus")).alias("via"))
    key = F.col("s_suppkey")
    entries = table(spark, sf_dir, "supplier").select(key.alias("entry"), (key * 7 % 1000).alias("node"), F.array(key).alias("order"))
    out = walks.traverse(entries, edges, 2, 2)
    return out.select("entry", "node", F.array_join(F.transform("order", lambda x: x.cast("string")), ".").alias("order"), "depth", "hops")


@query("""
WITH a AS (SELECT o_orderkey AS id, o_custkey % 7 AS scope, o_custkey AS node, [o_orderkey % 900, o_orderkey % 1100] AS m FROM orders),
x AS (SELECT id, scope, node, p, m[p] AS message FROM a, (VALUES (1), (2)) t(p)),
t AS (SELECT DISTINCT s_nationkey % 7 AS scope, s_suppkey * 11 % 1100 AS message, s_suppkey AS node FROM supplier UNION SELECT DISTINCT c_custkey % 7, c_custkey % 450, c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'),
o AS (SELECT id, p, min(t.node) AS taker FROM x JOIN t USING (scope, message) WHERE x.node <> t.node GROUP BY 1, 2 HAVING count(*) = 1)
SELECT a.id AS call, b.taker FROM a LEFT JOIN (SELECT id, arg_min(taker, p) AS taker FROM o GROUP BY 1) b USING (id)""")
def q50_only_taker(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    asked = table(spark, sf_dir, "orders").select(key.alias("id"), (cust % 7).alias("scope"), cust.alias("node"), F.array(key % 900, key % 1100).alias("messages"))
    supplier = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 7).cast("long").alias("scope"), (F.col("s_suppkey") * 11 % 1100).alias("message"), F.col("s_suppkey").alias("node"))
    customer = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") % 7).alias("scope"), (F.col("c_custkey") % 450).alias("message"), F.col("c_custkey").alias("node"))
    return walks.only_taker(asked, supplier.unionByName(customer)).select(F.col("id").alias("call"), "taker")


@query("""
WITH p AS (SELECT o_orderkey AS id, o_custkey % 50 AS bus, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS topic FROM orders),
c AS (SELECT s_suppkey AS consumer, s_suppkey % 60 AS bus, CASE s_nationkey % 6 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '5-LOW' WHEN 2 THEN '2-HIGH' END AS topic, s_nationkey AS pos FROM supplier),
e AS (SELECT id, consumer, row_number() OVER (PARTITION BY id ORDER BY pos, consumer) AS n, false AS inferred FROM p JOIN c USING (bus, topic)),
l AS (SELECT id, min(consumer) AS consumer, 1 AS n, true AS inferred FROM p JOIN c USING (bus) WHERE (p.topic IS NULL OR c.topic IS NULL) AND id NOT IN (SELECT id FROM e) GROUP BY id HAVING count(*) = 1)
SELECT id, consumer, n, inferred FROM e WHERE n <= 2 UNION ALL SELECT * FROM l""")
def q51_deliver(spark, sf_dir):
    orders, nation = table(spark, sf_dir, "orders"), F.col("s_nationkey") % 6
    published = orders.select(F.col("o_orderkey").alias("id"), F.lit("s").alias("scope"), (F.col("o_custkey") % 50).alias("bus"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority")).alias("topic"))
    topic = F.when(nation == 0, "1-URGENT").when(nation == 1, "5-LOW").when(nation == 2, "2-HIGH")
    consumers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("consumer"), F.lit("s").alias("scope"), (F.col("s_suppkey") % 60).alias("bus"), topic.alias("topic"), F.col("s_nationkey").alias("order"))
    return walks.deliver(published, consumers, 2)


@query("""
WITH RECURSIVE c AS (SELECT c_mktsegment, CAST(c_custkey AS VARCHAR) AS class, CAST(c_custkey // 3 AS VARCHAR) AS parent, CASE c_custkey % 4 WHEN 3 THEN [] WHEN 2 THEN ['E'] ELSE ['K', 'E'] END AS params,
        [CASE c_nationkey % 3 WHEN 0 THEN 'E' WHEN 1 THEN 'K' ELSE c_mktsegment END, CASE c_nationkey % 2 WHEN 0 THEN 'E' ELSE 'T' || c_custkey END][1:1 + CAST(c_acctbal > 0 AS INTEGER)] AS args FROM customer),
w AS (SELECT class AS base, p AS param, class AS cur, p AS arg FROM c, LATERAL (SELECT unnest(params) AS p)
  UNION SELECT w.base, w.param, x.class, x.args[list_position(c.params, w.arg)] FROM w JOIN c ON c.class = w.cur AND list_contains(c.params, w.arg) JOIN c x ON x.parent = w.cur)
SELECT DISTINCT w.base, w.param, w.cur AS sub, w.arg AS bound FROM w JOIN c ON c.class = w.cur WHERE w.arg IS NOT NULL AND NOT list_contains(c.params, w.arg)""")
def q52_bound_parameters(spark, sf_dir):
    some = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    cust, nation = F.col("c_custkey"), F.col("c_nationkey")
    args = F.array(F.when(nation % 3 == 0, "E").when(nation % 3 == 1, "K").otherwise(F.col("c_mktsegment")), F.when(nation % 2 == 0, "E").otherwise(F.concat(F.lit("T"), cust.cast("string"))))
    rows = table(spark, sf_dir, "customer").select(
        F.lit("s").alias("scope"), cust.cast("string").alias("class"), F.floor(cust / 3).cast("string").alias("parent"), F.when(cust % 4 == 3, some()).when(cust % 4 == 2, some("E")).otherwise(some("K", "E")).alias("params"),
        F.slice(args, F.lit(1), 1 + (F.col("c_acctbal") > 0).cast("int")).alias("args"),
    )
    return walks.bound_parameters(rows.select("scope", "class", "params"), rows.select("scope", "class", "parent", "args")).select("base", "param", "sub", "bound")


CLASSES_SQL = """
c AS (SELECT c_custkey AS class, 'T' || CAST(c_custkey % 400 AS VARCHAR) AS name, c_mktsegment AS package, c_nationkey AS unit, 'f' || CAST(c_custkey % 300 AS VARCHAR) AS path, 'T' || CAST((c_custkey * 7) % 500 AS VARCHAR) AS parent FROM customer),
o AS (SELECT o_orderkey AS id, o_custkey % 25 AS unit, 'f' || CAST(o_custkey % 300 AS VARCHAR) AS path, c_mktsegment AS package, 'T' || CAST(o_orderkey % 450 AS VARCHAR) AS name, o_orderkey % 3 = 0 AS wide FROM orders JOIN customer ON c_custkey = o_custkey),
i AS (SELECT path, id AS pos, package, CASE WHEN NOT wide THEN name END AS one FROM o),
every AS (SELECT name, count(*) AS n, min(class) AS class FROM c GROUP BY 1), near AS (SELECT name, package, unit, min(class) AS class FROM c GROUP BY 1, 2, 3), home AS (SELECT name, unit, count(*) AS n, min(class) AS class FROM c GROUP BY 1, 2),
a AS (SELECT DISTINCT unit, path, package, name FROM o UNION SELECT unit, path, package, parent FROM c),
b AS (SELECT a.path, a.name, arg_min(c.class, (i.pos, c.class)) AS class FROM (SELECT DISTINCT path, name FROM a) a JOIN c ON c.name = a.name JOIN i ON i.path = a.path AND i.package = c.package AND coalesce(i.one, c.name) = c.name GROUP BY 1, 2),
r AS (SELECT a.*, CASE WHEN e.n = 1 THEN e.class ELSE coalesce(near.class, b.class, CASE WHEN home.n = 1 THEN home.class END) END AS class
      FROM a LEFT JOIN every e USING (name) LEFT JOIN near USING (name, package, unit) LEFT JOIN b USING (path, name) LEFT JOIN home USING (name, unit))"""


def _written(spark, sf_dir):
    """Classes made of customers, names asked for and imports made of orders."""
    named = lambda c: F.concat(F.lit("T"), c.cast("string"))
    cust, key, s = F.col("c_custkey"), F.col("o_orderkey"), F.lit("s").alias("scope")
    people = table(spark, sf_dir, "customer")
    classes = people.select(s, cust.alias("class"), named(cust % 400).alias("name"), F.col("c_mktsegment").alias("package"), F.col("c_nationkey").cast("long").alias("unit"), F.concat(F.lit("f"), (cust % 300).cast("string")).alias("path"), named(cust * 7 % 500).alias("parent"))
    orders = table(spark, sf_dir, "orders").join(people.select("c_custkey", F.col("c_mktsegment").alias("package")), F.col("o_custkey") == cust)
    asked = orders.select(key.alias("id"), s, (F.col("o_custkey") % 25).cast("long").alias("unit"), F.concat(F.lit("f"), (F.col("o_custkey") % 300).cast("string")).alias("path"), "package", named(key % 450).alias("name"))
    imports = asked.select("scope", "path", F.col("id").alias("pos"), F.concat("package", F.lit("."), F.when(F.col("id") % 3 == 0, "*").otherwise(F.col("name"))).alias("specifier"))
    return classes, asked, imports


@query(f"""
WITH {CLASSES_SQL}
SELECT DISTINCT o.unit, o.path, o.package, o.name, r.class FROM o JOIN r USING (unit, path, package, name)""")
def q53_resolve_types(spark, sf_dir):
    classes, asked, imports = _written(spark, sf_dir)
    return types.resolve(asked, classes, imports).drop("scope")


@query(f"""
WITH RECURSIVE {CLASSES_SQL},
k(name, value) AS (VALUES ('T7', 400), ('T77', 404), ('T421', 409)),
l AS (SELECT unit, name, arg_min(value, (ord, value)) AS value FROM (SELECT s_nationkey AS unit, 'T' || CAST(s_suppkey * 3 % 400 AS VARCHAR) AS name, 410 + s_suppkey % 10 AS value, s_suppkey AS ord FROM supplier) GROUP BY 1, 2),
e AS (SELECT 'T' || CAST(p_partkey % 90 * 5 AS VARCHAR) AS name, arg_min(500 + p_size, (p_partkey, p_size)) AS value FROM part GROUP BY 1),
w AS (SELECT o.id, o.unit, o.name, r.class, 0 AS up FROM o JOIN r USING (unit, path, package, name)
  UNION ALL SELECT w.id, w.unit, r.name, r.class, up + 1 FROM w JOIN c ON c.class = w.class JOIN r ON r.unit = c.unit AND r.path = c.path AND r.package = c.package AND r.name = c.parent WHERE up < 4),
h AS (SELECT id, up, 0 AS tier, value FROM w JOIN k USING (name) UNION ALL SELECT id, up, 1, value FROM w JOIN l USING (unit, name) UNION ALL SELECT id, up, 2, value FROM w JOIN e USING (name))
SELECT o.id, CAST(x.value AS INTEGER) AS value FROM o LEFT JOIN (SELECT id, arg_min(value, (up, tier)) AS value FROM h GROUP BY 1) x USING (id)""")
def q54_inherited_values(spark, sf_dir):
    classes, asked, imports = _written(spark, sf_dir)
    named = lambda c: F.concat(F.lit("T"), c.cast("string")).alias("name")
    key, part, s = F.col("s_suppkey"), F.col("p_partkey"), F.lit("s").alias("scope")
    known = spark.createDataFrame([("T7", 400), ("T77", 404), ("T421", 409)], "name string, value int")
    local = table(spark, sf_dir, "supplier").select(s, F.col("s_nationkey").cast("long").alias("unit"), named(key * 3 % 400), (410 + key % 10).cast("int").alias("value"), key.alias("ord"))
    every = table(spark, sf_dir, "part").select(s, named(part % 90 * 5), (500 + F.col("p_size")).cast("int").alias("value"), part.alias("ord"))
    return types.inherited(asked.withColumn("home", F.col("unit")), classes, imports, known, local, every).select("id", "value")


@query("""
WITH n AS (SELECT n_nationkey, lower(replace(n_name, ' ', '-')) AS service FROM nation),
t AS (SELECT service FROM n UNION SELECT DISTINCT split_part(split_part(url, '://', 2), '.', 1)[1:4] FROM pages WHERE regexp_full_match(split_part(split_part(url, '://', 2), '.', 1)[1:4], '[a-z0-9-]+')),
l AS (SELECT lower(replace(n_name, ' ', '-')) AS unit, page_id AS pos, url AS value FROM pages JOIN nation ON n_nationkey = page_id % 25
  UNION ALL SELECT 'u' || CAST(o_custkey % 7 AS VARCHAR), o_orderkey, upper(replace(service, '-', '_')) || CASE o_orderkey % 3 WHEN 0 THEN '_URL' WHEN 1 THEN '_HOST' ELSE '_PORT' END FROM orders JOIN n ON n_nationkey = o_custkey % 25)
SELECT unit, service, count(*) AS literals, min(pos) AS first FROM l JOIN t ON unit <> service AND (contains(value, '://' || service) OR value IN (upper(replace(service, '-', '_')) || '_URL', upper(replace(service, '-', '_')) || '_SERVICE_URL', upper(replace(service, '-', '_')) || '_HOST', upper(replace(service, '-', '_')) || '_ADDR'))
GROUP BY 1, 2""")
def q55_named_services(spark, sf_dir):
    pages, nation = table(spark, sf_dir, "pages"), table(spark, sf_dir, "nation")
    s, slug = F.lit("s").alias("repo"), F.lower(F.replace("n_name", F.lit(" "), F.lit("-")))
    host = F.substring(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("."), F.lit(1)), 1, 4)
    services = nation.select(s, slug.alias("service")).unionByName(pages.select(s, host.alias("service")).where(F.col("service").rlike("^[a-z0-9-]+$")))
    said = pages.join(nation, F.col("page_id") % 25 == F.col("n_nationkey")).select(s, slug.alias("unit"), F.col("page_id").alias("pos"), F.col("url").alias("value"))
    key = F.col("o_orderkey")
    ending = F.when(key % 3 == 0, "_URL").when(key % 3 == 1, "_HOST").otherwise("_PORT")
    orders = table(spark, sf_dir, "orders").join(nation, F.col("o_custkey") % 25 == F.col("n_nationkey"))
    said = said.unionByName(orders.select(s, F.concat(F.lit("u"), (F.col("o_custkey") % 7).cast("string")).alias("unit"), key.alias("pos"), F.concat(F.upper(F.translate(slug, "-", "_")), ending).alias("value")))
    return joins.named_services(said, services).groupBy("unit", "service").agg(F.count("*").alias("literals"), F.min("pos").alias("first"))


@query("""
WITH t AS (SELECT p_brand AS repo, CASE p_partkey % 4 WHEN 0 THEN replace(lower(p_type), ' ', 's_') ELSE replace(lower(p_type), ' ', '_') END || CASE WHEN p_partkey % 2 = 0 THEN 's' ELSE '' END AS tab, p_size % 3 > 0 AS written, p_partkey FROM part),
s AS (SELECT *, array_to_string([CASE WHEN ends_with(x, 's') AND length(x) > 3 THEN x[1:length(x) - 1] ELSE x END FOR x IN string_split(tab, '_')], '_') AS one FROM t)
SELECT DISTINCT repo, tab AS "table" FROM s WHERE written AND EXISTS (SELECT 1 FROM s c WHERE c.repo = s.repo AND c.one = s.one AND NOT c.written) AND NOT EXISTS (SELECT 1 FROM t u WHERE u.repo = s.repo AND u.tab = s.tab AND u.p_partkey % 5 = 0)""")
def q56_superseded_tables(spark, sf_dir):
    key, kind = F.col("p_partkey"), F.lower("p_type")
    name = F.concat(F.when(key % 4 == 0, F.replace(kind, F.lit(" "), F.lit("s_"))).otherwise(F.replace(kind, F.lit(" "), F.lit("_"))), F.when(key % 2 == 0, "s").otherwise(""))
    tables = table(spark, sf_dir, "part").select(F.col("p_brand").alias("repo"), name.alias("table"), (F.col("p_size") % 3 > 0).alias("written"), "p_partkey")
    return sets.superseded(tables, tables.where("p_partkey % 5 = 0"))


@query("""
WITH u AS (SELECT c_nationkey AS repo, c_custkey AS id, count(DISTINCT o_orderstatus || o_orderpriority) AS modules, any_value(c_mktsegment) IN ('BUILDING', 'MACHINERY') AS service, count(o_orderkey) AS degree, CAST(round(coalesce(max(o_totalprice), 0)) AS BIGINT) // 5000 AS lines
           FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT repo, id FROM u QUALIFY row_number() OVER (PARTITION BY repo ORDER BY modules >= 4 DESC, service DESC, degree DESC, lines DESC, id) = 1""")
def q57_busiest(spark, sf_dir):
    met = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    lines = F.floor(F.round(F.coalesce(F.max("o_totalprice"), F.lit(0.0))) / 5000)
    units = met.groupBy(F.col("c_nationkey").alias("repo"), F.col("c_custkey").alias("id")).agg(F.count_distinct(F.concat("o_orderstatus", "o_orderpriority")).alias("modules"), F.first("c_mktsegment").isin("BUILDING", "MACHINERY").alias("service"), F.count("o_orderkey").alias("degree"), lines.alias("lines"))
    return aggregates.busiest(units)


@query("""
WITH o AS (SELECT o_custkey % 40 AS unit, CASE o_orderstatus WHEN 'O' THEN 'typed' WHEN 'F' THEN 'partial' END AS c FROM orders), x AS (SELECT s_suppkey % 60 AS unit FROM supplier),
a AS (SELECT unit, count(*) AS n, count(*) FILTER (c = 'typed') AS typed, count(*) FILTER (c = 'partial') AS part FROM o GROUP BY 1), b AS (SELECT unit, count(*) AS n FROM x GROUP BY 1)
SELECT unit, coalesce(a.n, 0) AS operations, coalesce(typed, 0) AS typed, coalesce(part, 0) AS partial, coalesce(a.n - typed - part, 0) AS opaque, coalesce(b.n, 0) AS excluded FROM a FULL JOIN b USING (unit)""")
def q58_contracts(spark, sf_dir):
    status = F.col("o_orderstatus")
    operations = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("unit"), F.when(status == "O", "typed").when(status == "F", "partial").alias("confidence"))
    return aggregates.contracts(operations, table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 60).alias("unit")), ["unit"])
