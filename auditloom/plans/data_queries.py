"""Queries over the data-processing operators of the core, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators import hierarchy as H
from auditloom.operators import nested as N
from auditloom.operators import references as R
from auditloom.operators import snapshots as S
from auditloom.session import materialise, table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    h = H.hierarchy(table(spark, d, "type_defs"))
    return h.select(F.col("tree").alias("registry"), "name", "path")


def p4_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    h = H.hierarchy(table(spark, d, "type_defs"))
    return h.select(F.col("tree").alias("registry"), "name", "status", "root", F.col("depth").cast("long").alias("depth"),
                    F.when(F.col("status") == "tree", F.col("size")).alias("size"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    h = materialise(H.hierarchy(table(spark, d, "type_defs")).select("tree", "name", "names"))
    return H.descendants(h).select(F.col("tree").alias("registry"), "ancestor", "descendant", F.col("distance").cast("long").alias("distance"))


def _emitted(spark: SparkSession, d: str) -> DataFrame:
    """The tagged rows with their payloads, written once for all queries over the same files, partitioned by tag."""
    return N.written_once(table(spark, d, "crawl_results"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _emitted(spark, d).select("crawl_id", "kind", "pos", "sub", "item_key").distinct()


def _p5_table(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return N.flat_table(_emitted(spark, d), kind).drop("site")

    return run


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return R.orphan_references(_p6_pages(spark, d)).select("seq", "link", "kind").distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return R.orphan_report(R.orphan_references(_p6_pages(spark, d)))


def _p6_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("seq", "site", "url", "status_code", "links", "fetched_at")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return S.issue_changes(table(spark, d, "baselines"), table(spark, d, "baseline_issues"))


def p7_summary(spark: SparkSession, d: str) -> DataFrame:
    return p7_found(spark, d).groupBy("check_name", "change").agg(F.count("*").alias("n"))


QUERIES = {
    "p4_found": p4_found,
    "p4_hierarchy": p4_hierarchy,
    "p4_descendants": p4_descendants,
    "p5_found": p5_found,
    **{f"p5_{k}_table": _p5_table(k) for k in N.TAG_SCHEMAS},
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p7_found": p7_found,
    "p7_summary": p7_summary,
}

_TREE = """
WITH RECURSIVE defs AS (
  SELECT registry, name, NULLIF(trim(parent), '') AS parent FROM type_defs
  WHERE registry IS NOT NULL AND name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY registry, name ORDER BY loaded_at DESC, row_id DESC) = 1),
linked AS (
  SELECT a.registry, a.name, b.name AS parent FROM defs a LEFT JOIN defs b ON a.registry = b.registry AND a.parent = b.name),
tree AS (
  SELECT registry, name, [name] AS names FROM linked WHERE parent IS NULL
  UNION ALL
  SELECT l.registry, l.name, list_append(t.names, l.name) FROM linked l JOIN tree t ON l.registry = t.registry AND l.parent = t.name)
"""
_ORPHANS = r"""
WITH l AS (
  SELECT DISTINCT seq, site, fetched_at, link FROM (SELECT seq, site, fetched_at, unnest(links) AS link FROM pages)
  WHERE lower(regexp_replace(regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), ':\d*$', '')) = lower(site)),
k AS (SELECT *, lower(regexp_extract(link, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1)) || regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)', 1) AS key FROM l),
u AS (SELECT lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1)) || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)', 1) AS key, seq, status_code, fetched_at FROM pages WHERE url IS NOT NULL),
t AS (SELECT key, min(fetched_at) AS first_at, arg_max(status_code, (fetched_at, seq)) AS status_code FROM u GROUP BY key),
found AS (
  SELECT k.seq, k.link, k.site, strftime(k.fetched_at, '%Y-%m') AS month,
    CASE WHEN t.key IS NULL THEN 'missing' WHEN t.status_code IN (404, 410) THEN 'deleted'
         WHEN t.first_at > k.fetched_at + INTERVAL 24 HOUR THEN 'late' END AS kind
  FROM k LEFT JOIN t ON k.key = t.key)
"""
_CHANGES = """
WITH one AS (
  SELECT * FROM baseline_issues QUALIFY row_number() OVER (PARTITION BY baseline_id, seq ORDER BY row_id) = 1),
chain AS (
  SELECT baseline_id AS cur, lag(baseline_id) OVER (PARTITION BY seed_url ORDER BY created_at, baseline_id) AS prev FROM baselines),
c AS (SELECT chain.cur AS pair, check_name, url, list_sort(list(severity || chr(1) || message || chr(1) || coalesce(detail, ''))) AS v
      FROM one JOIN chain ON baseline_id = cur WHERE prev IS NOT NULL GROUP BY ALL),
p AS (SELECT chain.cur AS pair, check_name, url, list_sort(list(severity || chr(1) || message || chr(1) || coalesce(detail, ''))) AS v
      FROM one JOIN chain ON baseline_id = prev GROUP BY ALL),
changes AS (
  SELECT coalesce(c.pair, p.pair) AS baseline_id, coalesce(c.check_name, p.check_name) AS check_name, coalesce(c.url, p.url) AS url,
    CASE WHEN p.pair IS NULL THEN 'added' WHEN c.pair IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM c FULL JOIN p ON c.pair = p.pair AND c.check_name = p.check_name AND c.url = p.url
  WHERE c.pair IS NULL OR p.pair IS NULL OR c.v <> p.v)
"""
def _items(x: str) -> str:
    """A JSON value as a list: of its members, of itself if it is no array, empty if null or absent."""
    return f"CASE coalesce(json_type({x}), 'NULL') WHEN 'ARRAY' THEN CAST({x} AS JSON[]) WHEN 'NULL' THEN CAST([] AS JSON[]) ELSE [{x}] END"


def _scalar(x: str) -> str:
    return f"CASE coalesce(json_type({x}), 'NULL') WHEN 'NULL' THEN '' WHEN 'VARCHAR' THEN {x} ->> '$' ELSE CAST({x} AS VARCHAR) END"


_FLAT = f"""
WITH latest AS (SELECT crawl_id, arg_max(payload, (received_at, payload)) AS payload FROM crawl_results WHERE crawl_id IS NOT NULL GROUP BY 1),
j AS (SELECT crawl_id, CAST(payload AS JSON) AS j FROM latest WHERE json_valid(payload)),
r AS (SELECT crawl_id, CASE WHEN json_type(j -> '$.result') = 'OBJECT' THEN j -> '$.result' ELSE j END AS r FROM j WHERE json_type(j) = 'OBJECT'),
p AS (SELECT crawl_id, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT crawl_id, {_items("r -> '$.pages'")} AS l FROM r)),
pages_ AS (SELECT * FROM p WHERE json_type(e) = 'OBJECT'),
i AS (SELECT crawl_id, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT crawl_id, {_items("r -> '$.issues'")} AS l FROM r)),
s AS (SELECT crawl_id, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT crawl_id, {_items("r -> '$.lighthouse'")} AS l FROM r)),
ln AS (SELECT crawl_id, pos, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS sub FROM (SELECT crawl_id, pos, {_items("e -> '$.links'")} AS l FROM pages_)),
rd AS (SELECT crawl_id, pos, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS sub FROM (SELECT crawl_id, pos, {_items("e -> '$.redirect_chain'")} AS l FROM pages_)),
hk AS (SELECT crawl_id, pos, e -> '$.headers' AS h, unnest(json_keys(e -> '$.headers')) AS k, generate_subscripts(json_keys(e -> '$.headers'), 1) - 1 AS n FROM pages_ WHERE json_type(e -> '$.headers') = 'OBJECT'),
hv AS (SELECT crawl_id, pos, k, n, CAST(h AS MAP(VARCHAR, JSON))[k] AS v FROM hk),
hd AS (SELECT crawl_id, pos, k, n, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS sub FROM (SELECT crawl_id, pos, k, n, {_items("v")} AS l FROM hv)),
flat AS (
  SELECT crawl_id, 'page' AS kind, pos, -1 AS sub, {_scalar("e -> '$.url'")} AS item_key FROM pages_
  UNION ALL SELECT crawl_id, 'issue', pos, -1, {_scalar("e -> '$.check_name'")} FROM i WHERE json_type(e) = 'OBJECT'
  UNION ALL SELECT crawl_id, 'lighthouse', pos, -1, {_scalar("e -> '$.url'")} FROM s WHERE json_type(e) = 'OBJECT'
  UNION ALL SELECT crawl_id, 'link', pos, sub, {_scalar("e")} FROM ln WHERE coalesce(json_type(e), 'NULL') <> 'NULL'
  UNION ALL SELECT crawl_id, 'redirect', pos, sub, {_scalar("e")} FROM rd WHERE coalesce(json_type(e), 'NULL') <> 'NULL'
  UNION ALL SELECT crawl_id, 'header', pos, sub, k FROM hd WHERE coalesce(json_type(e), 'NULL') <> 'NULL')
"""
def _table_sql(kind: str) -> str:
    sql_type = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
    if kind in ("link", "redirect"):
        rel = "ln" if kind == "link" else "rd"
        return f"""SELECT crawl_id, CAST(pos AS INTEGER) AS pos, CAST(sub AS INTEGER) AS sub, 'page/' || pos || '/{kind}/' || sub AS pk, 'page/' || pos AS parent_pk, {_scalar('e')} AS value
            FROM {rel} WHERE coalesce(json_type(e), 'NULL') <> 'NULL'"""
    if kind == "header":
        return f"""SELECT crawl_id, CAST(pos AS INTEGER) AS pos, CAST(sub AS INTEGER) AS sub, 'page/' || pos || '/header/' || n || '/' || sub AS pk, 'page/' || pos AS parent_pk, k AS name, {_scalar('e')} AS value
            FROM hd WHERE coalesce(json_type(e), 'NULL') <> 'NULL'"""
    rel = {"page": "pages_", "issue": "i", "lighthouse": "s"}[kind]
    cols = [c.split() for c in N.TAG_SCHEMAS[kind].split(", ")]
    fields = ", ".join(f"TRY_CAST(e ->> '$.{n}' AS {sql_type[t]}) AS {n}" for n, t in cols)
    return f"SELECT crawl_id, CAST(pos AS INTEGER) AS pos, -1 AS sub, '{kind}/' || pos AS pk, '' AS parent_pk, {fields} FROM {rel} WHERE json_type(e) = 'OBJECT'"


SQL = {
    **{f"p5_{k}_table": _FLAT + _table_sql(k) for k in N.TAG_SCHEMAS},
    "p4_hierarchy": _TREE + """, sizes AS (SELECT registry, a AS name, count(*) AS size FROM (SELECT registry, unnest(names) AS a FROM tree) GROUP BY ALL),
        lost AS (SELECT l.* FROM linked l WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.registry = l.registry AND t.name = l.name)),
        walk AS (SELECT registry, name AS start, parent AS cur FROM lost UNION SELECT w.registry, w.start, l.parent FROM walk w JOIN lost l ON l.registry = w.registry AND l.name = w.cur)
        SELECT registry, name, 'tree' AS status, names[1] AS root, CAST(len(names) AS BIGINT) AS depth, CAST(size AS BIGINT) AS size FROM tree JOIN sizes USING (registry, name)
        UNION ALL SELECT registry, name, CASE WHEN EXISTS (SELECT 1 FROM walk w WHERE w.registry = lost.registry AND w.start = lost.name AND w.cur = lost.name) THEN 'cycle' ELSE 'below_cycle' END, NULL, NULL, NULL FROM lost""",
    "p5_found": _FLAT + "SELECT DISTINCT crawl_id, kind, CAST(pos AS INTEGER) AS pos, CAST(sub AS INTEGER) AS sub, item_key FROM flat",
    "p4_found": _TREE + "SELECT l.registry, l.name, coalesce(array_to_string(t.names, '/'), '(cycle)') AS path FROM linked l LEFT JOIN tree t ON l.registry = t.registry AND l.name = t.name",
    "p4_descendants": _TREE + """SELECT registry, names[i] AS ancestor, name AS descendant, CAST(len(names) - i AS BIGINT) AS distance
        FROM (SELECT registry, name, names, unnest(range(1, len(names))) AS i FROM tree)""",
    "p6_found": _ORPHANS + "SELECT seq, link, kind FROM found WHERE kind IS NOT NULL",
    "p6_report": _ORPHANS + "SELECT site, month, kind, count(*) AS n_links, count(DISTINCT seq) AS n_pages FROM found WHERE kind IS NOT NULL GROUP BY ALL",
    "p7_found": _CHANGES + "SELECT baseline_id, check_name, url, change FROM changes",
    "p7_summary": _CHANGES + "SELECT check_name, change, count(*) AS n FROM changes GROUP BY ALL",
}
