"""Windows, matching and graphs over events, conversations, documents and pages."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from factline.functions import scalars as S
from factline.operators import facts, graph, matching, nearest, windows
from factline.plans.registry import query, table

LINES_SQL = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line_text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents"


def lines(spark, sf_dir):
    """Text split into numbered lines, from 1."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line_text"))
    return d.select("doc_id", "line_text", (F.col("k") + 1).alias("line"))


@query("line_regex_scan", f"SELECT doc_id, line, line_text FROM ({LINES_SQL}) WHERE regexp_matches(line_text, '(?i)licen[sc]e|token')")
def line_regex_scan(spark, sf_dir):
    return lines(spark, sf_dir).filter(F.col("line_text").rlike("(?i)licen[sc]e|token")).select("doc_id", F.col("line").cast("long").alias("line"), "line_text")


@query(
    "islands_ge3",
    """WITH e AS (SELECT user_id, event_id, event_type = 'click' AS hit, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS a FROM events),
       r AS (SELECT *, a - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM e WHERE hit) SELECT user_id, min(event_id) AS event_id, count(*) AS length FROM r GROUP BY user_id, g HAVING count(*) >= 3""",
)
def islands_ge3(spark, sf_dir):
    return windows.islands(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], F.col("event_type") == "click", 3)


@query("lookback_guard", "SELECT event_id, coalesce(bool_or(event_type = 'signup') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), false) AS guarded FROM events")
def lookback_guard(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", windows.look_back(["user_id"], ["event_id"], F.col("event_type") == "signup", 3).alias("guarded"))


@query("lookahead_exists", "SELECT conv_id, turn, coalesce(bool_or(role = 'user') OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS asked_later FROM conversations")
def lookahead_exists(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", windows.look_ahead(["conv_id"], ["turn", "role", "text"], F.col("role") == "user").alias("asked_later"))


@query("asof_role", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM events")
def asof_role(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", windows.as_of(["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("event_id"))).alias("heading"))


@query("asof_join", "WITH l AS (SELECT user_id, event_id, value FROM events WHERE event_type <> 'signup'), r AS (SELECT user_id, event_id, value AS signup_value FROM events WHERE event_type = 'signup') SELECT l.event_id, l.value, r.signup_value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.event_id >= r.event_id")
def asof_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.filter("event_type <> 'signup'").select("user_id", "event_id", "value")
    right = e.filter("event_type = 'signup'").select("user_id", "event_id", F.col("value").alias("signup_value"))
    return windows.as_of_join(left, right, ["user_id"], "event_id", ["signup_value"]).select("event_id", "value", "signup_value")


@query(
    "depth_inherit",
    """WITH h AS (SELECT user_id, event_id, 1 + event_id % 5 AS depth FROM events) SELECT h.event_id, (SELECT max(p.event_id) FROM h p WHERE p.user_id = h.user_id AND p.event_id < h.event_id AND p.depth < h.depth) AS parent FROM h""",
)
def depth_inherit(spark, sf_dir):
    h = table(spark, sf_dir, "events").select("user_id", "event_id", (1 + F.col("event_id") % 5).alias("depth"))
    return windows.parent_by_depth(h, ["user_id"], "event_id", "depth", 5).select("event_id", "parent")


@query("fence_mask", f"WITH l AS (SELECT doc_id, line, line_text LIKE '%token%' AS f FROM ({LINES_SQL})) SELECT doc_id, line, f OR sum(f::INT) OVER (PARTITION BY doc_id ORDER BY line) % 2 = 1 AS fenced FROM l")
def fence_mask(spark, sf_dir):
    l = lines(spark, sf_dir)
    return l.select("doc_id", F.col("line").cast("long").alias("line"), windows.fence_mask(["doc_id"], ["line"], F.col("line_text").contains("token")).alias("fenced"))


@query("leading_block", f"WITH l AS (SELECT doc_id, line, length(line_text) > 40 AS hit FROM ({LINES_SQL})), f AS (SELECT doc_id, min(line) FILTER (WHERE hit) AS a FROM l GROUP BY 1), e AS (SELECT l.doc_id, min(line) AS z FROM l JOIN f ON f.doc_id = l.doc_id WHERE NOT hit AND line > a GROUP BY 1) SELECT l.doc_id, count(*) AS n FROM l JOIN f ON f.doc_id = l.doc_id LEFT JOIN e ON e.doc_id = l.doc_id WHERE hit AND line >= a AND (z IS NULL OR line < z) GROUP BY 1")
def leading_block(spark, sf_dir):
    l = lines(spark, sf_dir).withColumn("hit", windows.leading_run(["doc_id"], ["line"], F.length("line_text") > 40))
    return l.filter("hit").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("creation_intent", f"SELECT doc_id, line, bool_or(line_text LIKE '%token%') OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near FROM ({LINES_SQL})")
def creation_intent(spark, sf_dir):
    hit = F.col("line_text").contains("token")
    return lines(spark, sf_dir).select("doc_id", F.col("line").cast("long").alias("line"), (windows.look_back(["doc_id"], ["line"], hit, 2) | hit).alias("near"))


@query("context_lines", "SELECT event_id, list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS around FROM events QUALIFY event_type = 'error'")
def context_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", windows.context_lines(["user_id"], ["event_id"], F.col("event_type"), 3, 3).alias("around"))
    return e.filter("event_type = 'error'").select("event_id", "around")


@query("name_normalise", "SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS name FROM documents")
def name_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.normalise_name(F.col("text")).alias("name"))


_TOKENS = "list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 2))"


@query(
    "jaccard_pairs",
    f"""WITH t AS (SELECT p_partkey AS k, p_brand AS b, p_size AS s, {_TOKENS} AS t FROM part)
        SELECT x.k AS a, y.k AS b, len(list_intersect(x.t, y.t))::DOUBLE / len(list_distinct(list_concat(x.t, y.t))) AS jaccard FROM t x JOIN t y ON x.b = y.b AND x.s = y.s AND x.k < y.k WHERE len(list_intersect(x.t, y.t))::DOUBLE / len(list_distinct(list_concat(x.t, y.t))) >= 0.3""",
)
def jaccard_pairs(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey", S.name_tokens(F.col("p_name")).alias("words"))
    return matching.jaccard_pairs(t, ["p_brand", "p_size"], "p_partkey", "words", 0.3)


@query(
    "overlap_pairs",
    """WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
       x AS (SELECT item_id, doc_id, count(*) AS k FROM (SELECT item_id, unnest(w) AS t FROM b) JOIN (SELECT doc_id, unnest(w) AS t FROM d) USING (t) GROUP BY 1, 2)
       SELECT item_id, doc_id, k::DOUBLE / greatest(len(b.w), len(d.w)) AS overlap FROM x JOIN b USING (item_id) JOIN d USING (doc_id) WHERE k::DOUBLE / greatest(len(b.w), len(d.w)) >= 0.2""",
)
def overlap_pairs(spark, sf_dir):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("words")
    b, d = table(spark, sf_dir, "benchmark").select("item_id", words), table(spark, sf_dir, "documents").select("doc_id", words)
    return matching.overlap_join(b, d, "item_id", "doc_id", "words", 0.2)


_HALVES = "WITH b AS (SELECT user_id, event_id, event_type, value FROM events WHERE event_id % 2 = 0), a AS (SELECT user_id, event_id, event_type, value FROM events WHERE event_id % 2 = 1)"


def _halves(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    b = e.filter("event_id % 2 = 0").select("user_id", "event_type", F.col("event_id").alias("b"), F.col("value").alias("vb"))
    a = e.filter("event_id % 2 = 1").select("user_id", "event_type", F.col("event_id").alias("a"), F.col("value").alias("va"))
    return b, a


def _matched(spark, sf_dir, choose, **more):
    """Pairs of a user and kind score 1 less a hundredth of the difference of their values, and 0.6 at least."""
    b, a = _halves(spark, sf_dir)
    return nearest.match(b, a, ["user_id", "event_type"], "b", "a", "vb", "va", partial(choose, scale=100.0, least=0.6, **more))


@query("greedy_match")
def greedy_match(spark, sf_dir):
    """Best first and one to one, within a user and kind."""
    return _matched(spark, sf_dir, nearest.greedy, head_start=matching.HEAD_START)


@query("sequential_match")
def sequential_match(spark, sf_dir):
    return _matched(spark, sf_dir, nearest.sequential)


@query("kth_occurrence_match", f"{_HALVES} SELECT x.event_id AS b, y.event_id AS a, x.k FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id)::INT AS k FROM b) x JOIN (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id)::INT AS k FROM a) y ON x.user_id = y.user_id AND x.event_type = y.event_type AND x.k = y.k")
def kth_occurrence_match(spark, sf_dir):
    b, a = _halves(spark, sf_dir)
    return matching.kth_occurrence(b, a, ["user_id", "event_type"], "b", "a").select("b", "a", "k")


@query(
    "pair_similarity",
    f"""{_HALVES}, p AS (SELECT b.event_id AS b, a.event_id AS a, 0.5 * CASE WHEN b.user_id = a.user_id THEN 1.0 ELSE 0.7 END + 0.35 * (floor(b.value) = floor(a.value))::INT + 0.15 * exp(-abs(b.event_id - a.event_id) / 50.0::DOUBLE) AS score FROM b JOIN a ON b.event_type = a.event_type)
        SELECT b, a, floor(score * 1000000 + 0.5)::BIGINT AS score FROM p WHERE score >= 0.8""",
)
def pair_similarity(spark, sf_dir):
    """All pairs of a kind that score 0.8 or more. Without equal evidence a pair has 0.65 at most; with it, one of
    equal users always has 0.85, any other 0.7 and 0.15 exp(-d / 50), which is enough up to a distance of 20."""
    b, a = _halves(spark, sf_dir)
    left = b.select("event_type", F.floor("vb").alias("v"), "user_id", F.col("b").alias("at"))
    right = a.select("event_type", F.floor("va").alias("v"), "user_id", F.col("a").alias("at"))
    same = left.join(right.withColumnsRenamed({"at": "at_r"}), ["event_type", "v", "user_id"]).withColumn("user_id_r", F.col("user_id"))
    near = facts.band_join(left, right, ["event_type", "v"], "at", 20).filter("NOT user_id <=> user_id_r")
    p = same.unionByName(near)
    s = matching.similarity(F.col("user_id") == F.col("user_id_r"), F.lit(True), F.array("v"), F.array("v"), F.col("at"), F.col("at_r"))
    return p.withColumn("s", s).filter("s >= 0.8D").select(F.col("at").alias("b"), F.col("at_r").alias("a"), F.floor(F.col("s") * 1000000 + 0.5).alias("score"))


@query(
    "accuracy",
    """WITH p AS (SELECT doc_id, (length(text) > 200)::INT AS guess FROM documents) SELECT toxic, count(*) AS n, count(*) FILTER (WHERE guess = quality) AS correct, avg((guess = quality)::INT)::DOUBLE AS accuracy FROM labels JOIN p USING (doc_id) GROUP BY toxic""",
)
def accuracy(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select("doc_id", (F.length("text") > 200).cast("int").alias("guess"))
    right = F.col("guess") == F.col("quality")
    return table(spark, sf_dir, "labels").join(p, "doc_id").groupBy("toxic").agg(F.count("*").alias("n"), F.count_if(right).alias("correct"), F.avg(right.cast("double")).alias("accuracy"))


@query("band_accuracy", "WITH l AS (SELECT user_id, event_id FROM events WHERE event_type = 'error'), p AS (SELECT user_id, event_id FROM events WHERE value > 80) SELECT l.event_id, count(p.event_id) AS hits FROM l JOIN p ON p.user_id = l.user_id AND abs(p.event_id - l.event_id) <= 200 GROUP BY 1")
def band_accuracy(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    l, p = e.filter("event_type = 'error'").select("user_id", "event_id"), e.filter("value > 80").select("user_id", "event_id")
    return facts.band_join(l, p, ["user_id"], "event_id", 200).groupBy("event_id").agg(F.count("*").alias("hits"))


# Links between pages ------------------------------------------------------

_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
_LINKS = "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS target FROM pages"


def links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("target")).distinct()


@query("link_edges", _LINKS)
def link_edges(spark, sf_dir):
    return links(spark, sf_dir)


@query("consumer_count", f"SELECT target, count(*) AS n, count(*) = 1 AS fragile FROM ({_LINKS}) GROUP BY 1")
def consumer_count(spark, sf_dir):
    return links(spark, sf_dir).groupBy("target").agg(F.count("*").alias("n"), (F.count("*") == 1).alias("fragile"))


@query("consumer_map", f"SELECT target, list_sort(list(page_id)) AS consumers FROM ({_LINKS}) GROUP BY 1")
def consumer_map(spark, sf_dir):
    return links(spark, sf_dir).groupBy("target").agg(F.array_sort(F.collect_list("page_id")).alias("consumers"))


@query("directory_stats", f"SELECT {_HOST} AS dir, count(*) AS n, count(*) FILTER (WHERE length(html) > 2000) AS long, floor(100.0::DOUBLE * count(*) FILTER (WHERE length(html) > 2000) / count(*) + 0.5)::BIGINT AS percent FROM pages GROUP BY 1")
def directory_stats(spark, sf_dir):
    long = F.count_if(F.length("html") > 2000)
    p = table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("dir"))
    return p.agg(F.count("*").alias("n"), long.alias("long"), S.round_half_up(F.lit(100.0) * long / F.count("*")).cast("long").alias("percent"))


_FILES = "SELECT p_partkey, concat(p_brand, ' ', p_size) AS file, p_type AS name, p_size FROM part"


@query("dead_exports", f"WITH p AS ({_FILES}), e AS (SELECT DISTINCT file, name FROM p), u AS (SELECT p.file AS dst, CASE WHEN n.p_size = 1 THEN '*' WHEN n.p_size = 2 THEN concat('* as ', n.name) ELSE n.name END AS name FROM p JOIN p n ON n.p_partkey = p.p_partkey + 1) SELECT file, name FROM e WHERE NOT EXISTS (SELECT 1 FROM u WHERE dst = file AND (u.name = e.name OR u.name = '*' OR u.name = concat('* as ', e.name)))")
def dead_exports(spark, sf_dir):
    """Each part's file exports its type, and uses of it take the next part's."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_size").alias("file"), F.col("p_type").alias("name"), "p_size")
    used = F.when(F.col("p_size") == 1, "*").when(F.col("p_size") == 2, F.concat(F.lit("* as "), "name")).otherwise(F.col("name"))
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), used.alias("name"))
    u = p.select("p_partkey", F.col("file").alias("dst")).join(nxt, "p_partkey").select("dst", "name").distinct()
    return graph.used_exports(p.select("file", "name").distinct(), u)


_BOLD = "concat('/', unnest(regexp_extract_all(html, '<b>([A-Za-z]+)', 1)))"


@query("symbol_lookup", f"WITH a AS ({_LINKS}), t AS (SELECT DISTINCT page_id, {_BOLD} AS target FROM pages) SELECT target, page_id, 'link' AS via FROM a UNION ALL SELECT target, page_id, 'text' FROM t WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.page_id = t.page_id AND a.target = t.target)")
def symbol_lookup(spark, sf_dir):
    """Every symbol's pages: those that link it, and those that only name it in bold."""
    a = links(spark, sf_dir)
    bold = F.explode(F.regexp_extract_all("html", F.lit("<b>([A-Za-z]+)"), F.lit(1)))
    t = table(spark, sf_dir, "pages").select("page_id", bold.alias("word")).select("page_id", F.concat(F.lit("/"), "word").alias("target")).distinct()
    out = a.withColumn("via", F.lit("link")).unionByName(t.join(a, ["page_id", "target"], "left_anti").withColumn("via", F.lit("text")))
    return out.select("target", "page_id", "via")


_DAG = "SELECT p_partkey AS src, unnest(list_distinct([p_partkey // 2, p_partkey // 3])) AS dst FROM part WHERE p_partkey > 0"


def dag(spark, sf_dir):
    """Each part needs those of half and of a third of its key; the first needs none."""
    dst = F.array_distinct(F.array(F.expr("p_partkey div 2"), F.expr("p_partkey div 3")))
    return table(spark, sf_dir, "part").filter("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.explode(dst).alias("dst"))


@query("longest_chain", f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({_DAG})), r(node, depth) AS (SELECT src, 0 FROM e UNION SELECT dst, 0 FROM e UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node) SELECT node, max(depth)::INT AS depth FROM r GROUP BY 1")
def longest_chain(spark, sf_dir):
    return graph.longest_chain(dag(spark, sf_dir))


@query("fan_out", f"SELECT dst AS node, count(*) AS n FROM ({_DAG}) GROUP BY 1")
def fan_out(spark, sf_dir):
    return graph.fan_out(dag(spark, sf_dir))


@query("reachability", f"WITH RECURSIVE e AS ({_DAG}), r(root, node, steps) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION SELECT r.root, e.dst, r.steps + 1 FROM r JOIN e ON e.src = r.node) SELECT root, node, min(steps)::INT AS steps FROM r GROUP BY 1, 2")
def reachability(spark, sf_dir):
    """What every part needs, in how many steps."""
    return graph.reach(dag(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")))


_RING = "SELECT n_nationkey AS src, (n_nationkey * 3 + 1) % 25 AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey + 5) % 25 FROM nation WHERE n_nationkey % 2 = 0"


@query(
    "graph_cycles",
    f"""WITH RECURSIVE e AS ({_RING}), r(path, last) AS (SELECT [src, dst], dst FROM e WHERE dst > src UNION ALL SELECT list_append(path, dst), dst FROM r JOIN e ON e.src = r.last WHERE dst > path[1] AND NOT list_contains(path, dst))
        SELECT path, len(path)::INT AS length FROM r JOIN e ON e.src = r.last AND e.dst = path[1] UNION ALL SELECT [src], 1 FROM e WHERE src = dst""",
)
def graph_cycles(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"))
    e = n.select("src", ((F.col("src") * 3 + 1) % 25).alias("dst")).union(n.filter("src % 2 = 0").select("src", ((F.col("src") + 5) % 25).alias("dst")))
    return graph.cycles(e)


@query("one_hop_consumers", f"WITH e AS ({_DAG}), s AS (SELECT p_brand AS change, p_partkey AS node FROM part) SELECT change, node FROM s UNION SELECT s.change, src FROM e JOIN s ON e.dst = s.node")
def one_hop_consumers(spark, sf_dir):
    """Each brand's parts as one change: what changes, and what needs any of it."""
    s = table(spark, sf_dir, "part").select(F.col("p_brand").alias("change"), F.col("p_partkey").alias("node"))
    return s.union(dag(spark, sf_dir).join(s, F.col("dst") == F.col("node")).select("change", "src")).distinct()


@query("contains_join", "WITH t AS (SELECT n_nationkey AS k, lower(n_name) AS part FROM nation), p AS (SELECT s_suppkey, lower(concat(n_name, ' ', r_name)) AS text FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey) SELECT s_suppkey, arg_min(part, k) AS part FROM p JOIN t ON contains(p.text, t.part) GROUP BY 1")
def contains_join(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    t = n.select(F.col("n_nationkey").alias("k"), F.lower("n_name").alias("part"))
    p = table(spark, sf_dir, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    p = p.select("s_suppkey", F.lower(F.concat_ws(" ", "n_name", "r_name")).alias("text"))
    return facts.first_containing(p, t, "text", "part", "k").select("s_suppkey", "part")


@query("template_truncate", "SELECT doc_id, CASE WHEN length(t) > 80 THEN concat(left(t, 77), '...') ELSE t END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)")
def template_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.truncate_text(F.col("text"), 80).alias("short"))


@query("content_hash_cache", "WITH h AS (SELECT doc_id, sha256(text) AS sha, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents) SELECT doc_id, sha, n - 1 AS hits FROM h WHERE k = 1")
def content_hash_cache(spark, sf_dir):
    """Documents whose content isn't in the cache when their turn comes, and how often the cache serves it after."""
    sha = F.sha2("text", 256).alias("sha")
    return table(spark, sf_dir, "documents").groupBy(sha).agg(F.min("doc_id").alias("doc_id"), (F.count("*") - 1).alias("hits")).select("doc_id", "sha", "hits")


@query("directory_hash", "SELECT source, sha256(string_agg(sha, ':' ORDER BY sha)) AS hash FROM (SELECT source, sha256(text) AS sha FROM documents) GROUP BY 1")
def directory_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2("text", 256))), ":"), 256).alias("hash"))


@query("path_functions", "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir FROM pages")
def path_functions(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.base_name(F.col("url")).alias("base"), S.dir_name(F.col("url")).alias("dir"))
