"""Queries over paths, packages and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from ..operators import files as FL
from ..operators import filters as FT
from ..operators import graph as G
from ..operators import tree as TR
from .registry import query

_PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"
_FILES = f"files AS (SELECT page_id AS id, 'r' || (page_id % 3) AS repo_id, {_PATH} AS path FROM pages)"


def _files(t):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return t("pages").select(F.col("page_id").alias("id"), F.concat(F.lit("r"), F.col("page_id") % 3).alias("repo_id"), path.alias("path"), F.length("html").alias("size"))


NEEDLES = [(1, "exam"), (2, "then/en"), (3, "wwcom"), (4, "bl"), (5, "ORG/fr"), (6, "a.b")]
_NEEDLES = ", ".join(f"({i}, '{n}')" for i, n in NEEDLES)


def _asked(t):
    return t("pages").sparkSession.createDataFrame(NEEDLES, "query_id int, needle string")


def _complete_sql(boost: str) -> str:
    return rf"""WITH {_FILES}, q(query_id, needle) AS (VALUES {_NEEDLES}),
    f AS (SELECT *, lower(path) AS p, regexp_extract(lower(path), '[^/]*$') AS b FROM files),
    g AS (SELECT id, list_distinct(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))) AS tri FROM f),
    n AS (SELECT query_id, lower(needle) AS needle, '.*' || array_to_string(list_transform(string_split(lower(needle), ''), lambda c: regexp_replace(c, '([^a-z0-9 ])', '\\\1')), '.*') || '.*' AS re,
        list_distinct(list_transform(range(1, length(needle) - 1), lambda i: substr(lower(needle), i, 3))) AS tri FROM q WHERE length(needle) >= 3),
    s AS (SELECT query_id, id, path, round((CASE WHEN regexp_full_match(b, re) THEN 20 ELSE 0 END + 10 + 2 * len(list_intersect(g.tri, n.tri)) - length(p) / 100.0)::DOUBLE * {boost}, 6) AS score
        FROM f JOIN g USING (id), n WHERE regexp_full_match(p, re))
    SELECT query_id, position, id, path, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, id)::INT AS position FROM s) WHERE position <= 5"""


@query(_complete_sql("1"))
def filename_complete(t):
    return FL.complete(_files(t), _asked(t))


@query(_complete_sql("CASE WHEN repo_id = 'r1' THEN 1.2 ELSE 1.0 END").replace("SELECT query_id, id, path, round", "SELECT query_id, id, path, repo_id, round"))
def filename_complete_boosted(t):
    return FL.complete(_files(t), _asked(t), boost_repo="r1")


@query(f"WITH {_FILES} SELECT id, repo_id, path FROM files WHERE path GLOB 'www.*/en/*' ORDER BY path, id LIMIT 50")
def glob_list(t):
    return FL.glob_list(_files(t), "www.*/en/*").select("id", "repo_id", "path")


@query(f"WITH {_FILES} SELECT id, repo_id, path FROM files WHERE path GLOB '[bm]*.example.[!n]*/[0-9]*' OR path GLOB '*/?r/*' ORDER BY CASE WHEN repo_id = 'r2' THEN 0 ELSE 1 END, path, id LIMIT 50")
def glob_repo_first(t):
    f = _files(t)
    both = f.filter(P.glob_match(F.col("path"), "[bm]*.example.[!n]*/[0-9]*") | P.glob_match(F.col("path"), "*/?r/*"))
    return FL.glob_list(both, "*", first_repo="r2").select("id", "repo_id", "path")


@query(f"WITH {_FILES} SELECT id, count(*) AS n FROM (SELECT DISTINCT id, substr(lower(path), i, 3) AS g FROM (SELECT id, path, unnest(range(1, greatest(length(path) - 1, 1))) AS i FROM files)) GROUP BY id")
def trigram_index(t):
    return FL.trigram_index(_files(t)).groupBy("id").agg(F.count("*").alias("n"))


@query(f"WITH {_FILES}, q(query_id, needle) AS (VALUES {_NEEDLES}), g AS (SELECT DISTINCT id, substr(lower(path), i, 3) AS g FROM (SELECT id, path, unnest(range(1, greatest(length(path) - 1, 1))) AS i FROM files)), n AS (SELECT DISTINCT query_id, substr(lower(needle), i, 3) AS g FROM (SELECT query_id, needle, unnest(range(1, greatest(length(needle) - 1, 1))) AS i FROM q)) SELECT query_id, id, count(*) AS hits FROM g JOIN n USING (g) GROUP BY ALL")
def trigram_hits(t):
    return FL.trigram_hits(_files(t), _asked(t))


@query(f"WITH {_FILES}, f AS (SELECT f.*, length(html) AS size FROM files f JOIN pages p ON p.page_id = f.id) SELECT lower(regexp_extract(path, '[^/.][^/]*?(\\.[^./]*)$', 1)) AS suffix, count(*) AS n, sum(size)::BIGINT AS total, round(avg(size), 6) AS average FROM f GROUP BY 1")
def suffix_stats(t):
    return FL.suffix_stats(_files(t), "size")


@query(f"WITH {_FILES} SELECT id, v, CASE WHEN starts_with(v, '.virtual-path/') THEN string_split(v, '/')[2] ELSE 'r0' END AS repo, path FROM (SELECT *, CASE WHEN repo_id = 'r0' THEN path ELSE '.virtual-path/' || repo_id || '/' || path END AS v FROM files)")
def virtual_paths(t):
    v = _files(t).select("id", P.virtual_path(F.col("repo_id"), F.col("path"), "r0").alias("v"))
    return v.withColumn("s", P.split_virtual_path(F.col("v"), "r0")).select("id", "v", "s.repo", "s.path")


_LANGS = ["python", "go", "c", "typescript", "terraform"]


@query(f"""WITH f AS (SELECT doc_id, [{', '.join(repr(x) for x in _LANGS)}][1 + doc_id % 5] AS language, lang || '/' || source || CASE WHEN doc_id % 10 = 0 THEN '/__init__.py' ELSE '/m' || doc_id || '.py' END AS path FROM documents),
g AS (SELECT *, regexp_replace(path, '\\.py$', '') AS stem FROM f)
SELECT doc_id, v AS virtual_path, regexp_extract(v, '[^/]*$') AS package FROM (SELECT doc_id, CASE language WHEN 'python' THEN regexp_replace(replace(stem, '/', '.'), '\\.__init__$', '') WHEN 'typescript' THEN replace(stem, '/', '.')
WHEN 'c' THEN path WHEN 'terraform' THEN stem ELSE regexp_replace(path, '/[^/]*$', '') END AS v FROM g)""")
def module_paths(t):
    lang = F.element_at(F.array(*[F.lit(x) for x in _LANGS]), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat("lang", F.lit("/"), "source", F.when(F.col("doc_id") % 10 == 0, "/__init__.py").otherwise(F.concat(F.lit("/m"), "doc_id", F.lit(".py"))))
    v = t("documents").select("doc_id", P.module_path(path, lang).alias("virtual_path"))
    return v.withColumn("package", P.package_name(F.col("virtual_path")))


@query(r"""WITH o AS (SELECT doc_id, text, least(length(text), 1 + (doc_id * 37) % 500) AS pos FROM documents)
SELECT doc_id, (length(regexp_replace(substr(text, 1, pos), '[^\n]', '', 'g')) + 1)::INT AS line, octet_length(encode(substr(text, 1, pos)))::INT AS byte FROM o""")
def text_positions(t):
    d = t("documents").withColumn("at", F.least(F.length("text"), 1 + (F.col("doc_id") * 37) % 500).cast("int"))
    return d.select("doc_id", X.line_at(F.col("text"), F.col("at")).cast("int").alias("line"), X.byte_at(F.col("text"), F.col("at")).cast("int").alias("byte"))


# --- packages and repositories: nations are repositories, regions projects


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def repos_of_project(t):
    repos = t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    links = t("nation").select(F.col("n_regionkey").alias("project_id"), F.col("n_nationkey").alias("repo_id"))
    return FT.in_project(repos, links, 2)


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def orphan_packages(t):
    return FT.orphans(t("customer").select(F.col("c_custkey").alias("id")), t("orders").select(F.col("o_custkey").alias("package_id")))


@query("SELECT * FROM part WHERE p_partkey IN (1, 5, 9, 13) UNION ALL SELECT * FROM part WHERE false")
def ids_lookup(t):
    return FT.by_values(t("part"), "p_partkey", [1, 5, 9, 13]).unionAll(FT.by_values(t("part"), "p_partkey", []))


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_nationkey = (SELECT min(s_nationkey) FROM supplier) ORDER BY s_suppkey LIMIT 1")
def equality_lookup(t):
    s = t("supplier")
    least = s.agg(F.min("s_nationkey")).first()[0]
    return FT.first_by(s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_nationkey"), s_nationkey=least).select("id", "name")


@query("SELECT id FROM (SELECT o_orderkey AS id, o_custkey % 7 AS repo, o_orderstatus AS kind, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS parent FROM orders) WHERE repo IN (1, 2) AND kind IN ('F') AND parent IS NULL ORDER BY id LIMIT 100 OFFSET 10")
def node_filter(t):
    o = t("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 7).alias("repo"), F.col("o_orderstatus").alias("kind"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("parent_node_id"))
    return FT.optional(o, top_level=True, limit=100, offset=10, repo=[1, 2], kind=["F"], name=[]).select("id")


_EDGES_OLD = "SELECT DISTINCT o_custkey AS k, o_orderpriority AS alias, o_orderstatus AS dot FROM orders WHERE o_orderkey % 3 <> 0"
_EDGES_NEW = "SELECT DISTINCT o_custkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS alias, o_orderstatus AS dot FROM orders WHERE o_orderkey % 2 = 0"


@query(f"""WITH a AS ({_EDGES_OLD}), b AS ({_EDGES_NEW})
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN a.alias ELSE b.alias END AS alias, coalesce(a.dot, b.dot) AS dot, CASE WHEN a.k IS NULL THEN 'create' WHEN b.k IS NULL THEN 'delete' ELSE 'update' END AS action
FROM a FULL OUTER JOIN b ON a.k = b.k AND a.alias IS NOT DISTINCT FROM b.alias AND a.dot = b.dot""")
def edge_diff(t):
    o = t("orders")
    old = o.filter("o_orderkey % 3 <> 0").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("alias"), F.col("o_orderstatus").alias("dot"))
    new = o.filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("alias"), F.col("o_orderstatus").alias("dot"))
    return G.diff(old, new, ["k", "alias", "dot"])


@query("""WITH p AS (SELECT s_suppkey AS id, s_nationkey % 3 AS repo_id, s_name AS v, 'dir/' || s_suppkey AS ph FROM supplier),
e AS (SELECT l_orderkey, l_linenumber, l_suppkey % 3 AS repo_id, 'Supplier#' || lpad((l_suppkey % 40)::VARCHAR, 9, '0') AS v, 'dir/' || (l_suppkey % 30) AS ph, l_returnflag = 'R' AS external FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN NOT external THEN coalesce((SELECT min(id) FROM p WHERE p.repo_id = e.repo_id AND p.v = e.v), (SELECT min(id) FROM p WHERE p.repo_id = e.repo_id AND p.ph = e.ph)) END, -1) AS to_package_id FROM e""")
def import_resolution(t):
    p = t("supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 3).alias("repo_id"), F.col("s_name").alias("virtual_path"), F.concat(F.lit("dir/"), "s_suppkey").alias("physical_path"))
    e = t("lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_suppkey") % 3).alias("repo_id"), F.concat(F.lit("Supplier#"), F.lpad((F.col("l_suppkey") % 40).cast("string"), 9, "0")).alias("to_package_virtual_path"),
        F.concat(F.lit("dir/"), F.col("l_suppkey") % 30).alias("to_package_physical_path"), (F.col("l_returnflag") == "R").alias("external"),
    )
    return G.resolve_imports(e, p).select("l_orderkey", "l_linenumber", F.coalesce("to_package_id", F.lit(-1)).alias("to_package_id"))


_PREFIXES = ["www.", "www.th", "www.then", "blog.", "m.th", "m.thertion.example.com/en", "spam-farm"]


@query(f"WITH {_FILES}, m(prefix) AS (VALUES {', '.join(f'({p!r})' for p in _PREFIXES)}) SELECT id, path, (SELECT max_by(prefix, length(prefix)) FROM m WHERE starts_with(path, prefix)) AS prefix FROM files")
def longest_prefix(t):
    m = t("pages").sparkSession.createDataFrame([(p,) for p in _PREFIXES], "prefix string")
    return G.longest_prefix(_files(t).select("id", "path"), m)


@query("SELECT l_orderkey, l_linenumber, o_orderpriority AS file_path FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderkey % 2 = 0")
def path_enrichment(t):
    f = t("orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("path"), F.lit(None).cast("long").alias("package_id"))
    rows = t("lineitem").select(F.col("l_orderkey").alias("file_id"), "l_linenumber")
    return G.with_paths(rows, f).select(F.col("file_id").alias("l_orderkey"), "l_linenumber", "file_path")


# --- trees: the parent of a conversation's turn is the turn before

_TREE = "n AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent_id, CASE WHEN turn % 4 = 3 THEN 'literal' ELSE role END AS kind FROM conversations)"


def _tree(t):
    i = F.col("conv_id") * 1000 + F.col("turn")
    return t("conversations").select(i.alias("id"), F.when(F.col("turn") > 0, i - 1).alias("parent_id"), F.when(F.col("turn") % 4 == 3, "literal").otherwise(F.col("role")).alias("kind"))


@query(f"WITH {_TREE} SELECT parent_id AS id, list(id ORDER BY id) AS children FROM n WHERE parent_id IS NOT NULL GROUP BY parent_id")
def tree_children(t):
    return TR.children(_tree(t))


@query(f"WITH RECURSIVE {_TREE}, a AS (SELECT n.id, p.id AS ancestor, 1 AS distance, p.parent_id AS up FROM n JOIN n p ON p.id = n.parent_id WHERE n.id % 5 = 0 AND p.kind <> 'literal' UNION ALL SELECT a.id, p.id, distance + 1, p.parent_id FROM a JOIN n p ON p.id = a.up WHERE p.kind <> 'literal') SELECT id, ancestor, distance FROM a")
def tree_ancestors(t):
    n = _tree(t)
    return TR.ancestors(n, n.filter("id % 5 = 0"))


@query(f"WITH {_TREE}, h AS (SELECT * FROM n WHERE id % 3 <> 0) SELECT id FROM h WHERE id NOT IN (SELECT parent_id FROM h WHERE parent_id IS NOT NULL)")
def parent_suppression(t):
    return TR.without_parents(_tree(t).filter("id % 3 <> 0")).select("id")


@query(f"WITH {_TREE}, h AS (SELECT * FROM n WHERE id % 3 = 0), b AS (SELECT * FROM h UNION SELECT n.* FROM n JOIN h ON n.parent_id = h.id WHERE h.kind <> 'literal') SELECT id, kind FROM b WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM h)")
def include_children(t):
    n = _tree(t)
    return TR.with_children(n, n.filter("id % 3 = 0")).select("id", "kind")


@query(f"""WITH {_TREE}, h AS (SELECT *, row_number() OVER (ORDER BY id) AS position FROM n WHERE id % 3 <> 1),
k AS (SELECT * FROM h WHERE id NOT IN (SELECT parent_id FROM h WHERE parent_id IS NOT NULL) ORDER BY position LIMIT 50)
SELECT id, coalesce((SELECT list(n.id ORDER BY n.id) FROM n WHERE n.parent_id = k.id AND k.kind <> 'literal'), []) AS children FROM k""")
def expand_hits(t):
    n = _tree(t)
    h = n.filter("id % 3 <> 1").withColumn("position", F.col("id"))  # the order is what counts
    return TR.expand_hits(n, h, 50).select("id", "children")
