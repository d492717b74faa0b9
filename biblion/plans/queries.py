"""Queries over the driver tables, each an operator of the engine on a table of like shape, and
the SQL that must give the same rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import access, dates, goals, network, text
from ..operators import analytics, cache, classify, enrich, merge
from . import fetch
from .registry import query

@query("""
WITH c AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderstatus AS status, count(*) AS n FROM orders
           WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01' GROUP BY 1, 2)
SELECT CAST(m AS DATE) AS month, s.status, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM generate_series(DATE '1996-01-01', DATE '1996-12-01', INTERVAL 1 MONTH) t(m) CROSS JOIN (SELECT DISTINCT status FROM c) s
LEFT JOIN c ON c.month = CAST(m AS DATE) AND c.status = s.status""")
def oa_status_monthly(table):
    rows = table("orders").select(F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderstatus").alias("status"))
    return analytics.status_by_month(rows, "day", "status", date(1996, 12, 1), date(1996, 1, 1))


@query("""
WITH s AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS id FROM lineitem)
SELECT x.id AS a, y.id AS b, count(*) AS w FROM s x JOIN s y ON x.k = y.k AND x.id < y.id GROUP BY 1, 2""")
def coaffiliation_edges(table):
    return analytics.edges(analytics.gathered(table("lineitem"), "l_orderkey", "l_suppkey"), "ids")


_LABEL_SQL = """
s AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS id FROM lineitem),
e AS (SELECT x.id AS a, y.id AS b, count(*) AS w FROM s x JOIN s y ON x.k = y.k AND x.id < y.id GROUP BY 1, 2),
n AS (SELECT s_suppkey AS id, n_name AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey),
g AS (SELECT least(p.label, q.label) AS a, greatest(p.label, q.label) AS b, CAST(sum(w) AS BIGINT) AS w
      FROM e JOIN n p ON p.id = e.a JOIN n q ON q.id = e.b WHERE p.label <> q.label GROUP BY 1, 2)"""


def origins(table, *suppliers: int) -> list[str]:
    """Names of the suppliers' nations."""
    chosen = table("supplier").where(F.col("s_suppkey").isin(list(suppliers)))
    return sorted({r[0] for r in chosen.join(table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name").collect()})


def _label_edges(table) -> DataFrame:
    names = table("supplier").join(table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("n_name").alias("label"))
    return analytics.label_edges(_suppliers(table), "l_orderkey", names)


def _suppliers(table) -> DataFrame:
    """Orders as rows, their suppliers as ids."""
    return table("lineitem").select("l_orderkey", F.col("l_suppkey").alias("id"))


@query(f"WITH {_LABEL_SQL} SELECT a, b, w FROM g")
def label_edges(table):
    return _label_edges(table)


@query("""
WITH s AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS id FROM lineitem),
e AS (SELECT x.id AS a, y.id AS b, count(*) AS w FROM s x JOIN s y ON x.k = y.k AND x.id < y.id GROUP BY 1, 2),
g AS (SELECT least(p.s_name, q.s_name) AS a, greatest(p.s_name, q.s_name) AS b, w FROM e JOIN supplier p ON p.s_suppkey = e.a JOIN supplier q ON q.s_suppkey = e.b)
SELECT label, CAST(sum(w) AS BIGINT) AS degree FROM (SELECT a AS label, w FROM g UNION ALL SELECT b, w FROM g) GROUP BY 1 ORDER BY degree DESC, label LIMIT 30""")
def weighted_degree_top30(table):
    names = table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"))
    return analytics.top_degrees(analytics.label_degrees(_suppliers(table), "l_orderkey", names))


@query(f"""WITH {_LABEL_SQL},
o AS (SELECT n_name AS x FROM nation JOIN supplier ON n_nationkey = s_nationkey WHERE s_suppkey IN (0, 1)),
p AS (SELECT * FROM g WHERE a IN (FROM o) OR b IN (FROM o)),
h AS (SELECT DISTINCT x FROM (SELECT a AS x FROM p UNION ALL SELECT b FROM p) WHERE x NOT IN (SELECT x FROM o)),
z AS (SELECT * FROM g WHERE a IN (FROM h) AND b IN (FROM h) AND w >= 2 ORDER BY w DESC, a, b LIMIT 20)
SELECT a, b, w, 'primary' AS kind FROM p UNION ALL SELECT a, b, w, 'secondary' FROM z""")
def primary_secondary_edges(table):
    return analytics.edge_groups(_label_edges(table), origins(table, 0, 1), least=2)


@query("""
SELECT sha256(left(text, 40)) AS key, arg_max(text, {'a': length(text), 'b': -doc_id}) AS text, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1""")
def dedup_longest_first(table):
    docs = table("documents").withColumn("_ord", F.col("doc_id"))
    return docs.groupBy(text.text_hash(F.left("text", F.lit(40))).alias("key")).agg(merge.longest("text"), F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


@query("""
WITH d AS (SELECT left(text, 12) AS key, source, min(doc_id) AS m FROM documents GROUP BY 1, 2)
SELECT key, string_agg(source, '; ' ORDER BY m) AS sources, count(*) AS source_count FROM d GROUP BY 1""")
def provenance_rollup(table):
    one = table("documents").groupBy(F.left("text", F.lit(12)).alias("key"), "source").agg(F.min("doc_id").alias("_ord"))
    return one.groupBy("key").agg(text.joined(merge.ordered(F.col("source"))).alias("sources"), F.count("*").alias("source_count"))


@query("""
WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS author, CASE WHEN p_size > 25 THEN 'Open' ELSE 'Closed' END AS access FROM part),
c AS (SELECT author, access, count(*) AS n FROM w WHERE trim(author) <> '' GROUP BY 1, 2),
t AS (SELECT author FROM c GROUP BY 1 ORDER BY sum(n) DESC, author LIMIT 20)
SELECT author, access, n FROM c WHERE author IN (FROM t)""")
def top_authors_by_flag(table):
    return analytics.author_access(table("part"), F.split("p_name", " "), F.when(F.col("p_size") > 25, "Open").otherwise("Closed"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def clean_html(table):
    return table("pages").select("page_id", text.strip_tags(F.col("html")).alias("text"))


@query()
def clean_html_entities(table):
    return table("pages").select("page_id", text.clean_html(F.col("html")).alias("text"))


@query(r"""SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents""")
def match_normalized_text(table):
    return table("documents").select("doc_id", text.match_key(F.col("text")).alias("key"))


@query("""
WITH c AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'Open access' WHEN 'O' THEN 'Closed' ELSE 'Unknown' END AS access, count(*) AS n FROM orders GROUP BY 1)
SELECT access, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS share FROM c""")
def access_ring(table):
    flag = F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "FALSE ")
    return analytics.access_ring(table("orders").select(flag.alias("flag")), "flag")


@query("""
WITH c AS (SELECT coalesce(nullif(trim(p_type), ''), 'unknown') AS type, count(*) AS n FROM part GROUP BY 1)
SELECT type, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS share FROM c""")
def type_distribution(table):
    return analytics.type_distribution(table("part"), "p_type")


@query("""
WITH r AS (SELECT event_id, CAST(round_even(value % 1.0 * 100, 0) AS BIGINT) AS pct, CAST(user_id % 17 + 1 AS VARCHAR) AS code FROM events),
k AS (SELECT code, CAST(sum(pct) AS DOUBLE) AS total, 'SDG ' || code || ' (Goal ' || code || ')' AS label FROM r WHERE pct >= 3 GROUP BY 1)
SELECT code, total, label, round(total * 100.0 / sum(total) OVER (), 6) AS share FROM k""")
def sdg_share(table):
    code = (F.col("user_id") % 17 + 1).cast("string")
    score = F.bround((F.col("value") % 1.0) * 100, 0).cast("bigint").cast("string")
    rows = table("events").select("event_id", F.concat(score, F.lit("% SDG "), code, F.lit(" (Goal "), code, F.lit(")")).alias("formatted"))
    return analytics.goal_share(rows, "formatted", "event_id")


@query("""
SELECT event_id, CAST(round_even(p * 100, 0) AS BIGINT) || '% SDG 1 (One)' || chr(10) || '5% SDG 2' AS formatted
FROM (SELECT event_id, CAST(user_id % 80 AS DOUBLE) / 100 + 0.1 AS p FROM events)""")
def ranked_predictions(table):
    p = ((F.col("user_id") % 80).cast("double") / 100 + 0.1).cast("string")
    body = F.concat(F.lit('{"predictions":[{"prediction":0.05,"sdg":{"code":"2","name":""}},null,{"prediction":"x","sdg":{"code":"9"}},{"prediction":'), p, F.lit(',"sdg":{"code":"1","name":"One"}}]}'))
    return table("events").select("event_id", goals.ranked_text(body).alias("formatted"))


@query("""
WITH t AS (SELECT o_orderkey, left(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), CASE o_orderkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 7 ELSE 10 END) AS d FROM orders),
b AS (SELECT o_orderkey, d, CAST(d || CASE length(d) WHEN 4 THEN '-01-01' WHEN 7 THEN '-01' ELSE '' END AS DATE) AS lo FROM t)
SELECT o_orderkey, d AS partial FROM b
WHERE lo <= DATE '1996-04-20' AND CASE length(d) WHEN 4 THEN make_date(year(lo), 12, 31) WHEN 7 THEN last_day(lo) ELSE lo END >= DATE '1996-03-10'""")
def partial_date_overlap(table):
    day = F.col("o_orderdate").cast("date").cast("string")
    cut = F.left(day, F.when(F.col("o_orderkey") % 3 == 0, 4).when(F.col("o_orderkey") % 3 == 1, 7).otherwise(10))
    rows = table("orders").select("o_orderkey", cut.alias("partial"))
    return rows.where(dates.overlaps(F.col("partial"), F.lit(date(1996, 3, 10)), F.lit(date(1996, 4, 20))))


@query("""SELECT o_orderkey, '10.' || (1000 + o_orderkey % 9000) || '/ab.' || o_custkey AS doi, '10.' || (1000 + o_orderkey % 9000) || '/ab.' || o_custkey AS strict FROM orders""")
def doi_normalize(table):
    bare = F.concat(F.lit("10."), (1000 + F.col("o_orderkey") % 9000).cast("string"), F.lit("/AB."), F.col("o_custkey").cast("string"))
    raw = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "https://doi.org/").when(F.col("o_orderkey") % 3 == 1, "doi: ").otherwise(""), bare, F.lit(".,"))
    return table("orders").select("o_orderkey", text.doi(raw).alias("doi"), text.strict_doi(raw).alias("strict"))


@query("""
SELECT CASE WHEN c_custkey % 4 = 0 THEN 'doi:10.1234/c.' || c_custkey ELSE 'metadata:' || sha256(trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) || chr(10) || '1999' || chr(10) || lower(c_mktsegment)) END AS key, c_custkey FROM customer""")
def dedup_key(table):
    d = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("DOI:10.1234/C."), F.col("c_custkey").cast("string"))).otherwise("")
    return table("customer").select(merge.publication_key(d, F.col("c_name"), F.lit("1999-05"), F.concat("c_mktsegment", F.lit(", X; Y, Z")), F.lit("x")).alias("key"), "c_custkey")


@query("""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders ORDER BY day DESC, o_orderkey DESC LIMIT 100""")
def recency_topk(table):
    return analytics.newest(table("orders").select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day")), "day", "o_orderkey", 100)


@query("""SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS row FROM orders ORDER BY row OFFSET 50 LIMIT 25""")
def preview_page(table):
    return analytics.page(table("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 2)


@query("""
WITH o AS (SELECT o_orderkey, o_orderpriority AS p, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0),
n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE lower(o_orderpriority) END AS p, o_totalprice + 1 AS v FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(nullif(n.p, ''), o.p) AS p, greatest(n.v, o.v) AS v FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey""")
def cache_upsert(table):
    orders = table("orders")
    old = orders.where("o_orderkey % 3 <> 0").select("o_orderkey", F.col("o_orderpriority").alias("p"), F.col("o_totalprice").alias("v")).alias("o")
    new = orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.lower("o_orderpriority")).alias("p"), (F.col("o_totalprice") + 1).alias("v")).alias("n")
    both = old.join(new, F.col("o.o_orderkey") == F.col("n.o_orderkey"), "full_outer")
    return both.select(F.coalesce("n.o_orderkey", "o.o_orderkey").alias("o_orderkey"), cache.filled(F.col("n.p"), F.col("o.p")).alias("p"), F.greatest("n.v", "o.v").alias("v"))


@query("""
WITH x AS (SELECT d.doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words, sha256(text) AS h, CASE WHEN quality = 1 THEN sha256(text) ELSE 'old' END AS ch,
           CASE WHEN l.doc_id IS NOT NULL THEN '{}' END AS r FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT CASE WHEN words < 50 THEN 'too_short' WHEN r IS NOT NULL AND ch = h THEN 'reuse' ELSE 'call' END AS decision, count(*) AS n FROM x GROUP BY 1""".replace("\\\\", "\\"))
def classification_reuse(table):
    labels = table("labels").select("doc_id", "quality", F.lit("{}").alias("response"))
    rows = table("documents").join(labels, "doc_id", "left").withColumn("h", text.text_hash(F.col("text")))
    cached = F.when(F.col("quality") == 1, F.col("h")).otherwise("old")
    made = classify.decision("osdg", text.word_count(F.col("text")), F.col("h"), cached, F.col("response"), F.lit(False))
    return rows.groupBy(made.alias("decision")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' et al.' ELSE c_name END AS short, trim(regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
CASE WHEN c_custkey % 2 = 0 THEN 'a; b' ELSE 'a; b; c' END AS flags FROM customer""")
def names_and_flags(table):
    authors = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit("; Other, A."))).otherwise(F.col("c_name"))
    flag = F.when(F.col("c_custkey") % 2 == 0, "b").otherwise("c")
    return table("customer").select("c_custkey", text.abbreviated(authors).alias("short"), text.slug(F.concat("c_name", F.lit(" / "), "c_mktsegment")).alias("slug"), text.with_flag(F.lit("a; b"), flag).alias("flags"))


@query("""
WITH x AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS f, CASE o_orderstatus WHEN 'F' THEN 'gold' WHEN 'O' THEN 'closed' ELSE '' END AS s FROM orders),
y AS (SELECT o_orderkey, s, coalesce(f, CASE s WHEN 'gold' THEN TRUE WHEN 'closed' THEN FALSE END) AS is_oa FROM x)
SELECT o_orderkey, CAST(is_oa AS VARCHAR) AS is_oa, CASE WHEN is_oa THEN CASE s WHEN 'gold' THEN 'gold' ELSE 'open' END WHEN NOT is_oa THEN 'closed' ELSE s END AS oa_status FROM y""")
def oa_repair(table):
    flag = F.when(F.col("o_orderkey") % 3 == 0, True).when(F.col("o_orderkey") % 3 == 1, False)
    status = F.when(F.col("o_orderstatus") == "F", "gold").when(F.col("o_orderstatus") == "O", "closed").otherwise("")
    rows = table("orders").select("o_orderkey", flag.alias("is_oa"), status.alias("oa_status"))
    return cache.repair_access(rows).withColumn("is_oa", F.col("is_oa").cast("string"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_props(table):
    return table("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1""")
def latest_per_key(table):
    rows = table("events").select("user_id", "event_type", "event_id", F.col("event_id").alias("_o"))
    return analytics.latest(rows, ["user_id"], "_o").drop("_o")


@query("""SELECT count(*) - count(DISTINCT sha256(text)) AS duplicates_removed FROM documents""")
def duplicates_removed(table):
    return merge.duplicates_removed(table("documents").select(text.text_hash(F.col("text")).alias("publication_key")))


@query("""SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '1') OR contains(lower(s_name), 'r#00000002')""")
def label_filter(table):
    return table("supplier").where(analytics.labels_matching(F.col("s_name"), "1, R#00000002")).select("s_suppkey", "s_name")


@query("""
WITH o AS (SELECT c_custkey, 'old' AS v FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT c_custkey, 'new' AS v FROM customer WHERE c_custkey % 3 = 0)
SELECT c_custkey, v FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT c_custkey, v FROM n""")
def keyed_override(table):
    c = table("customer").select("c_custkey")
    return cache.upsert_latest(c.where("c_custkey % 2 = 0").withColumn("v", F.lit("old")), c.where("c_custkey % 3 = 0").withColumn("v", F.lit("new")), ["c_custkey"])


@query("""
WITH o AS (SELECT c_custkey, 'old' AS v FROM customer WHERE c_custkey % 2 = 0)
SELECT c_custkey, v FROM o UNION ALL SELECT c_custkey, 'legacy' FROM customer WHERE c_custkey % 2 <> 0""")
def additive_migration(table):
    c = table("customer").select("c_custkey")
    return cache.add_missing(c.where("c_custkey % 2 = 0").withColumn("v", F.lit("old")), c.withColumn("v", F.lit("legacy")), ["c_custkey"])


@query("""
WITH s AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)
SELECT count(*) FILTER (n >= 2) AS eligible, count(*) AS total FROM s""")
def coaffiliation_coverage(table):
    return analytics.coverage(analytics.gathered(table("lineitem"), "l_orderkey", "l_suppkey"), "ids")


@query(f"""WITH {_LABEL_SQL}
SELECT a, b, round(least(10.0, 4.0 + 2.0 * log2(greatest(w, 1))), 6) AS width, round(least(0.96, 0.82 + 0.05 * log2(greatest(w, 1))), 6) AS alpha FROM g""")
def edge_scales(table):
    return _label_edges(table).select("a", "b", F.round(network.edge_width(F.col("w")), 6).alias("width"), F.round(network.edge_alpha(F.col("w")), 6).alias("alpha"))


@query(f"""WITH {_LABEL_SQL}, d AS (SELECT label, CAST(sum(w) AS BIGINT) AS degree FROM (SELECT a AS label, w FROM g UNION ALL SELECT b, w FROM g) GROUP BY 1),
o AS (SELECT n_name FROM nation JOIN supplier ON n_nationkey = s_nationkey WHERE s_suppkey = 0),
t AS (SELECT label FROM (SELECT label FROM d WHERE contains(lower(label), 'n_1') OR contains(lower(label), '2') OR label IN (FROM o) ORDER BY degree DESC, label LIMIT 5) UNION SELECT label FROM d WHERE label IN (FROM o))
SELECT a, b, w FROM g WHERE a IN (FROM t) AND b IN (FROM t)""")
def filtered_network(table):
    edge = _label_edges(table)
    return analytics.between(edge, analytics.top_nodes(edge, 5, "N_1, 2", origins(table, 0))).select("a", "b", "w")


@query("""
SELECT s_nationkey AS id, arg_min(s_name, s_suppkey) AS label FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY 1
UNION ALL SELECT s_nationkey, NULL FROM supplier GROUP BY 1 HAVING count(*) FILTER (s_suppkey % 3 <> 0) = 0""")
def first_named_label(table):
    rows = table("supplier").withColumn("name", F.when(F.col("s_suppkey") % 3 == 0, " ").otherwise(F.col("s_name")))
    return analytics.first_named(rows, "s_nationkey", "name", "s_suppkey")


@query("""SELECT DISTINCT n_name AS label FROM nation WHERE n_nationkey IN (1, 2, 3)""")
def resolved_labels(table):
    nations = table("nation").select(F.concat(F.lit("https://x.org/I"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("label"))
    spelled = F.when(F.col("n_nationkey") == 1, "I1").when(F.col("n_nationkey") == 2, "https://x.org/I2/").otherwise("https://x.org/I3")
    return fetch.resolved_labels(nations, table("nation").where("n_nationkey in (1, 2, 3)").select(spelled.alias("id")))


@query("""
SELECT c_custkey, 'I' || c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'PL' END AS country FROM customer
UNION ALL SELECT c_custkey, 'J', c_mktsegment, NULL FROM customer""")
def zipped_affiliations(table):
    ids = F.concat(F.lit("I"), F.col("c_custkey").cast("string"), F.lit("; J"))
    country = F.when(F.col("c_custkey") % 2 == 0, "PL").otherwise("")
    c = table("customer").select("c_custkey", ids.alias("institution_ids"), F.concat_ws("; ", "c_name", "c_mktsegment").alias("institution_names_raw"), country.alias("institution_countries"))
    one = c.select("c_custkey", F.explode(fetch.zipped_affiliations()).alias("x"))
    return one.select("c_custkey", "x.id", "x.name", text.nullify(F.col("x.country")).alias("country"))


@query("""
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE trim(p_type) END AS own, CASE WHEN p_partkey % 2 = 0 THEN trim(p_name) ELSE '' END AS old FROM part)
SELECT 'k' || p_partkey AS publication_key, CASE WHEN length(old) > length(own) THEN old ELSE own END AS abstract, 'skipped: user selected ''skip''' AS sdg_note FROM p""")
def enriched_from_cache(table):
    part, blank = table("part"), F.lit("")
    key = F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("publication_key")
    abstract = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_type")).alias("abstract")
    pubs = part.select(key, F.lit("openalex").alias("source"), blank.alias("source_record_keys"), F.col("p_name").alias("title"), blank.alias("authors"), blank.alias("doi"), blank.alias("publication_date"), abstract)
    cached = part.where("p_partkey % 2 = 0").select(key, F.col("p_name").alias("abstract"), blank.alias("source_record_keys"))
    stored = pubs.sparkSession.createDataFrame([], "publication_key string, model string, sdg_response string, sdg_formatted string, sdg_note string, text_hash string")
    return enrich.enrich(pubs, cached, stored, classify.SKIP).rows.select("publication_key", "abstract", "sdg_note")


@query("""
WITH b AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, CAST(unnest(generate_series(CAST(date_trunc('month', d) AS DATE), CAST(date_trunc('month', d + INTERVAL 70 DAY) AS DATE), INTERVAL 1 MONTH)) AS DATE) AS month FROM b""")
def month_ranges(table):
    day = F.col("o_orderdate").cast("date")
    return table("orders").select("o_orderkey", F.explode(dates.months(F.date_add(day, 70), day)).alias("month"))
