"""Registry of the named queries and of their SQL oracles.

Each query runs an operator over a table adapter; the SQL beside it states the
same result over the plain tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefold.functions.text import canonical_order, matches_filters
from codefold.operators import account as A
from codefold.operators import audits, edges, graph, search, web
from codefold.operators import stacktrace as S
from codefold.operators import symbols as Y
from codefold.sources import tables as T
from codefold.sources.repo import document_files, facts, relations, stale

QUERIES: dict = {}
SQL: dict[str, str] = {}

LINES = "lines AS (SELECT CAST(doc_id AS VARCHAR) AS file, CAST(i AS INTEGER) AS line, parts[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) u)"
SYMBOLS = """sym AS (SELECT CAST(p_partkey AS VARCHAR) AS symbol_id, p_name AS name, CASE WHEN p_size % 10 = 0 THEN 'class' ELSE 'function' END AS kind,
    CASE p_type WHEN 'SMALL' THEN 'tests/' WHEN 'LARGE' THEN 'lib/' WHEN 'MEDIUM' THEN 'examples/' ELSE 'app/' END || replace(p_brand, '#', '_') || '.py' AS rel,
    CAST(p_partkey * 100 + 1 AS INTEGER) AS start_line, CAST(p_partkey * 100 + 1 + p_size AS INTEGER) AS end_line, CASE WHEN p_size % 2 = 1 THEN p_brand END AS owner, p_size, p_type, p_retailprice FROM part)"""
EDGES = """ev AS (SELECT CAST(l_orderkey AS VARCHAR) AS file, l_linenumber AS line, CAST(l_partkey AS VARCHAR) AS to_id, l_suppkey, CAST(l_quantity AS INTEGER) AS quantity, l_returnflag AS flag,
    CASE WHEN l_quantity < 3 THEN 1 WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 2 WHEN l_discount = 0 THEN 3 WHEN l_returnflag = 'A' THEN 4 WHEN l_quantity > 45 THEN 5 WHEN l_tax >= 0.07 THEN 6 WHEN l_discount >= 0.05 THEN 8 WHEN l_tax = 0 THEN 9 ELSE 10 END AS rung FROM lineitem),
  tiers AS (SELECT *, CASE WHEN rung IN (4, 5, 6, 8) THEN 'confirmed' ELSE 'unverified' END AS tier,
    CASE rung WHEN 1 THEN 'uncertain' WHEN 2 THEN 'possible-dispatch' WHEN 3 THEN 'method-ambiguous' WHEN 4 THEN 'exact-binding' WHEN 5 THEN 'same-class' WHEN 6 THEN 'receiver-hint' WHEN 8 THEN 'scope-match' WHEN 9 THEN 'uncertain' ELSE 'name-only' END AS resolution,
    CAST(CASE rung WHEN 1 THEN 0.25 WHEN 2 THEN 0.5 WHEN 3 THEN 0.35 WHEN 4 THEN 0.98 WHEN 5 THEN 0.92 WHEN 6 THEN 0.8 WHEN 8 THEN 0.65 WHEN 9 THEN 0.25 ELSE 0.4 END AS DOUBLE) AS score FROM ev)"""
FOREST = """forest AS (SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""
RING = """ring AS (SELECT CAST(p_partkey AS VARCHAR) AS src, CAST(p_partkey - p_partkey % 10 + (p_partkey * 7 + p_size) % 10 AS VARCHAR) AS dst FROM part UNION SELECT CAST(p_partkey AS VARCHAR), CAST(p_partkey + 1 AS VARCHAR) FROM part WHERE p_size < 10 AND p_partkey % 10 < 9)"""
POSSIBLE = """possible AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier UNION ALL SELECT DISTINCT 't' || l_linenumber, 's' || l_suppkey FROM lineitem)"""
DOCS = """sym AS (SELECT doc_id AS k, CAST(doc_id AS VARCHAR) AS symbol_id, 'doc' || doc_id AS name, CASE doc_id % 10 WHEN 0 THEN 'class' WHEN 3 THEN 'constructor' WHEN 1 THEN 'method' WHEN 2 THEN 'method' ELSE 'function' END AS kind, CASE WHEN doc_id % 10 BETWEEN 1 AND 3 THEN 'doc' || (doc_id - doc_id % 10) END AS owner,
    CASE WHEN (doc_id // 10) % 11 = 4 THEN 'tests/' ELSE 'app/' END || 'src' || ((doc_id // 10) % 4) || '/' || (doc_id // 10) || '.src' AS rel, ['python', 'java', 'go', 'rust', 'csharp', 'c', 'javascript'][CAST((doc_id // 10) % 7 + 1 AS INTEGER)] AS language, doc_id % 10 * 20 + 1 AS start_line FROM documents)"""
BOUND = "(^|[^A-Za-z0-9_])the($|[^A-Za-z0-9_])"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# text


@query("search", f"WITH {LINES} SELECT file, line, text FROM lines WHERE contains(lower(text), 'ertion')")
def _search(spark, sf):
    return search.search(T.doc_lines(spark, sf), "erTION")


@query("search_regex", f"WITH {LINES} SELECT file, line, text FROM lines WHERE regexp_matches(text, '[0-9]{{3}}-[0-9]{{4}}')")
def _search_regex(spark, sf):
    return search.search(T.doc_lines(spark, sf), "[0-9]{3}-[0-9]{4}", regex=True, case_sensitive=True)


@query("search_top", f"WITH {LINES} SELECT file, line, text FROM lines WHERE contains(lower(text), 'the') ORDER BY lower(file), file, line LIMIT 20")
def _search_top(spark, sf):
    return search.search(T.doc_lines(spark, sf), "the", top=20)


@query("search_context", f"""WITH {LINES}, m AS (SELECT * FROM lines WHERE contains(text, '@mail'))
SELECT m.file, m.line, m.text, coalesce(string_agg(CASE WHEN l.line < m.line THEN l.text END, '|' ORDER BY l.line), '') AS before, coalesce(string_agg(CASE WHEN l.line > m.line THEN l.text END, '|' ORDER BY l.line), '') AS after
FROM m JOIN lines l ON l.file = m.file AND l.line BETWEEN m.line - 2 AND m.line + 2 GROUP BY ALL""")
def _search_context(spark, sf):
    lines = T.doc_lines(spark, sf)
    found = search.with_context(search.search(lines, "@mail", case_sensitive=True), lines, 2)
    return found.select("file", "line", "text", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


@query("ground_set", f"WITH {LINES} SELECT DISTINCT file, line FROM lines WHERE regexp_matches(text, '\\bé\\b')")
def _ground(spark, sf):
    return search.ground_set(T.doc_lines(spark, sf), "é")


@query("usages", f"WITH {LINES} SELECT file, line, text FROM lines WHERE regexp_matches(text, '(^|[^A-Za-z0-9_$])on([^A-Za-z0-9_$]|$)')")
def _usages(spark, sf):
    return search.textual_usages(T.doc_lines(spark, sf), "on")


@query("source_range", f"WITH {LINES} SELECT file, line, text FROM lines WHERE file = '0' AND line BETWEEN 2 AND 4")
def _range(spark, sf):
    return search.source_range(T.doc_lines(spark, sf), "0", 4, 2)


@query("file_lengths", "SELECT CAST(doc_id AS VARCHAR) AS file, CAST(len(string_split(text, chr(10))) - CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 1 ELSE 0 END AS INTEGER) AS lines FROM documents")
def _lengths(spark, sf):
    return search.file_lengths(T.doc_lines(spark, sf))


@query("path_filters", "SELECT source || '/' || lang || '/' || doc_id || '.txt' AS rel FROM documents WHERE NOT regexp_matches(lower(source || '/' || lang || '/' || doc_id || '.txt'), '(^|[/._-])fr?s?([/._-]|$)') AND starts_with(source || '/' || lang || '/', 'src0/')")
def _filters(spark, sf):
    return T.doc_files(spark, sf).filter(matches_filters(F.col("rel"), ["fr", "f"], "src0")).select("rel")


@query("stats", f"""WITH {LINES} SELECT d.lang AS language, count(*) AS files, CAST(sum(len(string_split(d.text, chr(10))) - CASE WHEN d.text = '' OR d.text LIKE '%' || chr(10) THEN 1 ELSE 0 END) AS BIGINT) AS lines, CAST(0 AS BIGINT) AS symbols FROM documents d GROUP BY 1""")
def _stats(spark, sf):
    return Y.stats(T.doc_files(spark, sf), T.symbols(spark, sf))


@query("canonical_files", "SELECT source || '/' || lang || '/' || doc_id || '.txt' AS rel, lang AS language FROM documents ORDER BY lower(rel), rel")
def _canonical(spark, sf):
    return T.doc_files(spark, sf).select("rel", "language").orderBy(*canonical_order())


# symbols


@query("find", f"WITH {SYMBOLS} SELECT symbol_id, name, kind, rel FROM sym WHERE regexp_matches(lower(name), '^s.*ring$')")
def _find(spark, sf):
    return Y.find(T.symbols(spark, sf), "s*ring").select("symbol_id", "name", "kind", "rel")


@query("find_fuzzy", f"""WITH {SYMBOLS} SELECT symbol_id, name, round(CASE WHEN name = 'red' THEN 1000 WHEN lower(name) = 'red' THEN 900 WHEN starts_with(lower(name), 'red') THEN 800 + 300.0 / length(name) WHEN contains(lower(name), 'red') THEN 400 + 300.0 / length(name) ELSE 0 END, 6)::DOUBLE AS score FROM sym WHERE contains(lower(name), 'red')""")
def _fuzzy(spark, sf):
    return Y.find(T.symbols(spark, sf), "red").select("symbol_id", "name", F.round("score", 6).alias("score"))


@query("resolve_symbol", f"""WITH {SYMBOLS}, s AS (SELECT *, CASE WHEN kind = 'class' THEN 1000 ELSE 0 END - CASE WHEN starts_with(rel, 'tests/') THEN 500 ELSE 0 END - CASE WHEN starts_with(rel, 'examples/') THEN 300 ELSE 0 END + CASE WHEN starts_with(rel, 'lib/') THEN 200 ELSE 0 END + CASE WHEN kind = 'function' THEN least(end_line - start_line, 100) ELSE 0 END + 40 AS score FROM sym),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, lower(rel), rel, start_line, kind, symbol_id) AS n, count(*) OVER (PARTITION BY name) AS definitions FROM s)
SELECT name, symbol_id, rel, start_line, kind, CAST(score AS INTEGER) AS score, definitions FROM r WHERE n = 1""")
def _resolve(spark, sf):
    return Y.resolve_symbol(T.symbols(spark, sf))


@query("typedef", f"WITH {SYMBOLS} SELECT symbol_id, rel FROM sym WHERE name = 'red widget' AND kind = 'class'")
def _typedef(spark, sf):
    return Y.typedef(T.symbols(spark, sf), "red widget").select("symbol_id", "rel")


@query("structural_search", f"WITH {SYMBOLS} SELECT symbol_id, name FROM sym WHERE kind = 'function' AND p_size % 4 >= 2 AND contains(lower(p_type), 'econ') AND p_retailprice >= 950")
def _structural(spark, sf):
    return Y.structural_search(T.symbols(spark, sf), kind="function", param="a2", returns="ECON", exported=True).select("symbol_id", "name")


@query("unused", f"WITH {DOCS} SELECT symbol_id FROM sym WHERE k NOT IN (SELECT doc_id FROM labels)")
def _unused(spark, sf):
    used = T.table(spark, sf, "labels").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"))
    return Y.structural_search(T.doc_symbols(spark, sf), unused_against=used).select("symbol_id")


@query("toc", f"""WITH {SYMBOLS}, f AS (SELECT rel, count(*) FILTER (kind = 'function') AS functions, count(*) FILTER (kind = 'class') AS types, CAST(max(end_line) AS BIGINT) AS lines FROM sym GROUP BY rel)
SELECT rel, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(functions) AS BIGINT) AS functions, CAST(sum(types) AS BIGINT) AS types, CAST(0 AS BIGINT) AS state FROM f GROUP BY ROLLUP (rel)""")
def _toc(spark, sf):
    own = T.symbols(spark, sf)
    files = own.groupBy("file", "rel").agg(F.max("end_line").cast("long").alias("lines"))
    return Y.toc(files, own)


@query("api", f"WITH {SYMBOLS} SELECT symbol_id, name FROM sym")
def _api(spark, sf):
    return Y.exported_symbols(T.symbols(spark, sf)).select("symbol_id", "name")


@query("evidence_sample", f"WITH {SYMBOLS}, r AS (SELECT symbol_id, kind, rel, row_number() OVER (PARTITION BY kind, rel ORDER BY start_line) AS round FROM sym) SELECT symbol_id, kind, rel, CAST(round AS INTEGER) AS round FROM r ORDER BY round, kind, rel LIMIT 100")
def _sample(spark, sf):
    return Y.stratified_sample(T.symbols(spark, sf).select("symbol_id", "kind", "rel", "start_line"), ["kind", "rel"], 100, ["start_line"]).select("symbol_id", "kind", "rel", "round")


@query("related", f"""WITH {SYMBOLS}, t AS (SELECT * FROM sym WHERE name = 'red widget' ORDER BY rel, start_line LIMIT 1)
SELECT s.name, s.rel, s.start_line, CASE WHEN s.rel = t.rel THEN abs(s.start_line - t.start_line) END AS distance, CAST(CASE WHEN contains(s.name, 'widget') THEN 1 ELSE 0 END AS INTEGER) AS shared
FROM sym s, t WHERE s.symbol_id <> t.symbol_id AND (s.rel = t.rel OR contains(s.name, 'widget')) ORDER BY distance ASC NULLS LAST, shared DESC, s.rel, s.start_line LIMIT 10""")
def _related(spark, sf):
    return Y.related(T.symbols(spark, sf), "red widget")


@query("members", f"WITH {SYMBOLS} SELECT symbol_id, name FROM sym WHERE owner = 'Brand#7' AND kind = 'function'")
def _members(spark, sf):
    return Y.members(T.symbols(spark, sf), "Brand#7").select("symbol_id", "name")


@query("extensions", "SELECT '.txt' AS extension, count(*) AS files, CAST(sum(len(string_split(text, chr(10))) - CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 1 ELSE 0 END) AS BIGINT) AS lines FROM documents")
def _extensions(spark, sf):
    return Y.extensions(T.doc_files(spark, sf))


@query("usage_counts", """WITH d AS (SELECT p_name AS name, count(*) AS definitions FROM part GROUP BY 1), c AS (SELECT p_name AS name, count(*) AS calls FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1), i AS (SELECT p_name AS name, count(*) AS imports FROM customer JOIN part ON p_partkey = c_custkey GROUP BY 1)
SELECT name, definitions, coalesce(calls, 0) AS calls, coalesce(imports, 0) AS imports, definitions + coalesce(calls, 0) + coalesce(imports, 0) AS total FROM d LEFT JOIN c USING (name) LEFT JOIN i USING (name)""")
def _usage_counts(spark, sf):
    own = T.symbols(spark, sf)
    names = own.select(F.col("symbol_id").alias("to_id"), "name")
    calls = T.evidence(spark, sf).select("to_id").join(names, "to_id")
    imports = T.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("to_id")).join(names, "to_id").select(F.array("name", F.lit("other")).alias("names"))
    return Y.usage_counts(own, calls, imports)


@query("call_patterns", """WITH c AS (SELECT CAST(l_partkey AS VARCHAR) AS to_id, l_returnflag, l_linestatus, CAST(l_quantity AS INTEGER) % 5 AS args, l_tax FROM lineitem)
SELECT to_id, count(*) AS sites, count(*) FILTER (l_returnflag = 'A') AS awaited, count(*) FILTER (l_linestatus = 'O') AS in_loop, CAST(0 AS BIGINT) AS in_try, count(*) AS method, CAST(0 AS BIGINT) AS spread, count(*) FILTER (l_tax > 0) AS assigned, count(*) FILTER (args = 0) AS no_arguments, CAST(0 AS BIGINT) AS passed_on FROM c GROUP BY to_id""")
def _patterns(spark, sf):
    own = T.table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("to_id"), (F.col("l_returnflag") == "A").alias("awaited"), (F.col("l_linestatus") == "O").alias("in_loop"), F.lit(False).alias("in_try"), F.lit(True).alias("is_method"), F.lit(False).alias("arg_spread"),
        F.when(F.col("l_tax") > 0, F.lit("x")).alias("assigned_to"), (F.col("l_quantity").cast("int") % 5).alias("arg_count"), F.lit(False).alias("is_function_ref"),
    )
    return edges.call_patterns(own, ["to_id"])


@query("diverse_examples", """WITH c AS (SELECT p_name AS name, 's' || CAST(l_quantity AS INTEGER) % 7 AS shape, CAST(l_orderkey AS VARCHAR) AS file, l_linenumber AS line FROM lineitem JOIN part ON p_partkey = l_partkey),
g AS (SELECT name, shape, count(*) AS sites, min(ROW(file, line)) AS b FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY sites DESC, shape) AS rank FROM g)
SELECT name, shape, sites, CAST(rank AS INTEGER) AS rank, struct_extract(b, 1) AS file, struct_extract(b, 2) AS line, CAST(0 AS INTEGER) AS score FROM r WHERE rank <= 3""")
def _examples(spark, sf):
    parts = T.symbols(spark, sf).select(F.col("symbol_id").alias("to_id"), "name")
    own = T.evidence(spark, sf).join(parts, "to_id").select("name", F.concat(F.lit("s"), (F.col("quantity") % 7).cast("string")).alias("shape"), "file", "line", F.lit(0).alias("seq"), F.lit(None).cast("string").alias("assigned_to"), F.lit(False).alias("awaited"), F.lit(False).alias("in_try"))
    return edges.diverse_examples(own)


# edges and accounts

CALLS = f"""{SYMBOLS}, n AS (SELECT count(*) AS parts FROM part),
own AS (SELECT CAST(symbol_id AS BIGINT) AS k, symbol_id, name || '_' || (p_size % 7) AS name, kind, rel AS file, start_line, owner, CASE WHEN CAST(regexp_extract(rel, '_([0-9]+)', 1) AS INTEGER) % 2 = 0 THEN 'java' ELSE 'python' END AS language, p_size % 4 AS params, p_size FROM sym),
calls AS (SELECT c.file, c.start_line + 1 AS line, l_linenumber AS seq, t.name, l_returnflag <> 'N' AS m, CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_linestatus = 'O' THEN 'self' WHEN CAST(l_quantity AS INTEGER) % 4 = 0 THEN 'Brand#' || (l_suppkey % 25 + 1) WHEN CAST(l_quantity AS INTEGER) % 4 = 1 THEN 'os' WHEN CAST(l_quantity AS INTEGER) % 4 = 2 THEN 'obj' END AS recv,
    l_discount, 'Brand#' || (l_partkey % 25 + 1) AS maybe_type, CAST(l_quantity AS INTEGER) % 5 AS args, l_tax = 0.07 AS spread, l_tax = 0.08 AS ref, l_discount = 0.1 AND l_returnflag = 'N' AS shadow, CASE l_linenumber WHEN 1 THEN 'str' WHEN 2 THEN 'num' ELSE 'id' END AS shape,
    CASE WHEN c.kind = 'function' THEN c.owner END AS own_class, c.language AS own_language, CAST(regexp_extract(c.file, '_([0-9]+)', 1) AS INTEGER) AS brand
  FROM lineitem, n JOIN own t ON t.k = l_partkey JOIN own c ON c.k = l_orderkey % n.parts),
sites AS (SELECT *, CASE WHEN recv = 'obj' AND l_discount >= 0.05 THEN maybe_type END AS rtype, coalesce(recv = 'obj' AND brand % 10 = 0, false) AS ext, coalesce(recv = 'obj' AND brand % 5 = 0, false) AS modr FROM calls),
inh AS (SELECT 'Brand#' || k AS child, 'Brand#' || (k % 5 + 1) AS parent FROM (SELECT unnest(range(6, 26)) AS k)),
imp AS (SELECT DISTINCT a.file AS src, b.file AS dst FROM own a JOIN own b ON b.k = a.k + 1 WHERE a.p_size < 25 AND a.file <> b.file),
nm AS (SELECT name, count(DISTINCT coalesce(owner, '')) AS owners, count(*) AS definitions FROM own WHERE kind = 'function' GROUP BY name),
ov AS (SELECT name, file, coalesce(owner, '') AS o, params, count(*) AS overloads FROM own WHERE kind = 'function' AND language = 'java' GROUP BY ALL),
free AS (SELECT DISTINCT file, name FROM own WHERE owner IS NULL),
reach AS (SELECT DISTINCT src AS file, name FROM imp JOIN free ON free.file = imp.dst),
pairs AS (SELECT s.file, s.line, s.seq, s.name, s.m, s.recv, s.rtype, s.ext, s.modr, s.args, s.spread, s.ref, s.shadow, s.shape, s.own_class, d.symbol_id AS to_id, d.owner AS o, d.kind AS kind, d.language AS lang, d.params, s.file = d.file AS same, i.src IS NOT NULL AS imported, lf.file IS NOT NULL AS local_def, r.file IS NOT NULL AS import_def, nm.owners, nm.definitions, coalesce(ov.overloads, 1) > 1 AS over,
    h1.child IS NOT NULL AS inherits, h2.child IS NOT NULL AS inherited, h3.child IS NOT NULL AS overrides, coalesce(s.recv = 'self', false) AS own, coalesce(s.recv = 'os', false) AS builtin,
    coalesce(s.rtype = d.owner, false) OR coalesce(s.recv = d.owner, false) AS typed, d.owner IS NULL AS alone
  FROM sites s JOIN own d ON d.name = s.name AND d.language = s.own_language LEFT JOIN imp i ON i.src = s.file AND i.dst = d.file LEFT JOIN free lf ON lf.file = s.file AND lf.name = s.name LEFT JOIN reach r ON r.file = s.file AND r.name = s.name LEFT JOIN nm ON nm.name = d.name
  LEFT JOIN ov ON ov.name = d.name AND ov.file = d.file AND ov.o = coalesce(d.owner, '') AND ov.params = d.params AND d.kind = 'function'
  LEFT JOIN inh h1 ON h1.child = s.own_class AND h1.parent = d.owner LEFT JOIN inh h2 ON h2.child = s.rtype AND h2.parent = d.owner LEFT JOIN inh h3 ON h3.child = d.owner AND h3.parent = s.rtype),
ruled AS (SELECT *, CASE WHEN shadow THEN 'local-shadow' WHEN m AND (builtin OR ext) THEN 'external-package' WHEN NOT m AND NOT same AND local_def THEN 'other-definition' WHEN NOT m AND NOT same AND NOT imported AND import_def THEN 'other-definition-import'
    WHEN NOT m AND NOT alone AND kind <> 'class' AND o <> coalesce(own_class, '') AND NOT inherits THEN 'kind-mismatch' WHEN m AND modr AND NOT alone AND NOT typed THEN 'kind-mismatch'
    WHEN m AND alone AND recv IS NOT NULL AND NOT modr AND kind = 'function' AND lang = 'java' THEN 'kind-mismatch' WHEN m AND own AND NOT alone AND own_class IS NOT NULL AND o <> own_class AND NOT inherits THEN 'other-class'
    WHEN kind = 'function' AND NOT spread AND (args < least(params, 2) OR args > params) THEN 'arity-mismatch' WHEN over AND shape = 'str' AND params >= 1 THEN 'overload-mismatch' END AS reason,
  CASE WHEN m AND rtype IS NOT NULL AND NOT typed AND NOT inherited AND NOT overrides AND NOT alone AND NOT inherits THEN 1 WHEN m AND NOT typed AND ((own AND inherits AND owners > 1) OR overrides) THEN 2
    WHEN (m AND NOT own AND NOT typed AND NOT inherited AND NOT alone AND owners > 1 AND rtype IS NULL) OR (over AND shape = 'id') THEN 3
    WHEN NOT m AND alone AND (same OR (imported AND definitions = 1)) AND NOT ref THEN 4 WHEN (m AND own AND coalesce(o = own_class, false)) OR (NOT m AND NOT ref AND coalesce(o = own_class, false) AND lang = 'java') THEN 5
    WHEN m AND (typed OR inherited) THEN 6 WHEN ref AND (same OR imported) THEN 7 WHEN ref THEN 10 WHEN imported OR same OR (m AND NOT builtin AND NOT alone AND owners = 1) THEN 8 WHEN m AND recv IS NULL THEN 9 ELSE 10 END AS rung FROM pairs),
resolved AS (SELECT file || ':' || line || ':' || seq || ':' || name AS call_id, file, line, name, to_id, o AS to_owner, reason, CASE WHEN reason IS NOT NULL THEN 'excluded' WHEN rung IN (4, 5, 6, 7, 8) THEN 'confirmed' ELSE 'unverified' END AS tier,
    CASE rung WHEN 1 THEN 'uncertain' WHEN 2 THEN 'possible-dispatch' WHEN 3 THEN 'method-ambiguous' WHEN 4 THEN 'exact-binding' WHEN 5 THEN 'same-class' WHEN 6 THEN 'receiver-hint' WHEN 7 THEN 'scope-match' WHEN 8 THEN 'scope-match' WHEN 9 THEN 'uncertain' ELSE 'name-only' END AS resolution FROM ruled)"""


def _resolved(spark, sf, explain=True):
    f = T.call_facts(spark, sf)
    return edges.resolve_calls(f["calls"], f["symbols"], f["import_edges"], edges.ancestors(f["inherit"]), f["files"], bound=f["bound"], explain=explain)


def _outcomes(f):
    return edges.call_outcomes(f["calls"], f["symbols"], f["import_edges"], edges.ancestors(f["inherit"]), f["files"], bound=f["bound"])


@query("resolve_calls", f"WITH {CALLS} SELECT call_id, to_id, tier, resolution, reason FROM resolved")
def _resolve_calls(spark, sf):
    return _resolved(spark, sf).select("call_id", "to_id", "tier", "resolution", "reason")


@query("resolve_reasons", f"WITH {CALLS} SELECT tier, resolution, coalesce(reason, '') AS reason, count(*) AS edges, count(DISTINCT call_id) AS sites FROM resolved GROUP BY ALL")
def _resolve_reasons(spark, sf):
    found = _outcomes(T.call_facts(spark, sf)).withColumn("reason", F.coalesce("reason", F.lit("")))
    return found.groupBy("tier", "resolution", "reason").agg(F.sum("edges").alias("edges"), F.countDistinct("call_id").alias("sites"))


@query("resolve_bound", f"WITH {CALLS} SELECT call_id, to_id, tier, resolution, reason FROM resolved WHERE coalesce(reason, '') NOT IN ('other-definition', 'other-definition-import', 'local-shadow', 'kind-mismatch')")
def _resolve_bound(spark, sf):
    found = _resolved(spark, sf, explain=False).select("call_id", "to_id", "tier", "resolution", "reason")
    return found.filter("coalesce(reason, '') NOT IN ('other-definition', 'other-definition-import', 'local-shadow', 'kind-mismatch')")


@query("call_tiers", f"WITH {EDGES} SELECT resolution, tier, score, count(*) AS sites FROM tiers GROUP BY ALL")
def _tiers(spark, sf):
    return edges.with_tier(T.evidence(spark, sf)).groupBy("resolution", "tier", "score").agg(F.count("*").alias("sites"))


@query("histogram", f"WITH {EDGES} SELECT to_id, count(*) FILTER (score > 0.8) AS high, count(*) FILTER (score BETWEEN 0.5 AND 0.8) AS medium, count(*) FILTER (score < 0.5) AS low FROM tiers GROUP BY to_id")
def _histogram(spark, sf):
    return edges.histogram(edges.with_tier(T.evidence(spark, sf)), ["to_id"])


@query("min_confidence", f"WITH {EDGES} SELECT tier, count(*) AS kept FROM tiers WHERE score >= 0.6 GROUP BY tier")
def _least(spark, sf):
    return edges.min_confidence(edges.with_tier(T.evidence(spark, sf)), 0.6).groupBy("tier").agg(F.count("*").alias("kept"))


@query("impact", f"WITH {EDGES}, {SYMBOLS} SELECT to_id, file, tier, count(DISTINCT file || ':' || line || ':' || l_suppkey) AS sites FROM tiers WHERE to_id IN (SELECT symbol_id FROM sym WHERE name = 'red widget') GROUP BY ALL")
def _impact(spark, sf):
    own = edges.with_tier(T.evidence(spark, sf)).withColumn("call_id", F.concat_ws(":", "file", "line", "receiver"))
    return edges.impact(own, T.symbols(spark, sf).filter("name = 'red widget'").select(F.col("symbol_id").alias("to_id")))


@query("callees", f"WITH {EDGES} SELECT file AS enclosing_id, to_id, count(*) AS calls, CASE WHEN count(*) >= 10 THEN 'core' WHEN count(*) >= 3 THEN 'regular' WHEN count(*) = 1 THEN 'utility' ELSE 'normal' END AS weight FROM tiers WHERE tier = 'confirmed' GROUP BY ALL")
def _callees(spark, sf):
    own = edges.with_tier(T.evidence(spark, sf)).select(F.col("file").alias("enclosing_id"), "to_id", F.col("to_id").alias("to_name"), F.lit("").alias("to_file"), "tier")
    return edges.callees(own).select("enclosing_id", "to_id", "calls", "weight")


@query("verify_arity", f"""WITH {EDGES}, {SYMBOLS} SELECT v AS verdict, count(*) AS sites FROM (SELECT CASE WHEN quantity % 5 < least(p_size % 4, 2) OR quantity % 5 > p_size % 4 THEN 'mismatch' ELSE 'valid' END AS v FROM ev JOIN sym ON sym.symbol_id = ev.to_id) GROUP BY v""")
def _verify(spark, sf):
    sites = T.evidence(spark, sf).select("to_id", "arg_count", F.lit(False).alias("arg_spread"), F.array().cast("array<string>").alias("keywords")).join(T.symbols(spark, sf).select(F.col("symbol_id").alias("to_id"), edges.signature().alias("signature")), "to_id")
    return edges.verify(sites).groupBy("verdict").agg(F.count("*").alias("sites"))


@query("innermost", f"""WITH {SYMBOLS}, s AS (SELECT DISTINCT rel, CAST(start_line + 3 AS INTEGER) AS line FROM sym), j AS (SELECT s.rel, s.line, y.symbol_id, y.name, row_number() OVER (PARTITION BY s.rel, s.line ORDER BY y.end_line - y.start_line, y.start_line, y.name, y.symbol_id) AS n FROM s JOIN sym y ON y.rel = s.rel AND y.kind = 'function' AND s.line BETWEEN y.start_line AND y.end_line)
SELECT rel AS file, line, symbol_id AS enclosing_id, name AS enclosing FROM j WHERE n = 1""")
def _innermost(spark, sf):
    own = T.symbols(spark, sf)
    return edges.innermost(own.select("file", (F.col("start_line") + 3).alias("line")), own)


@query("account", f"WITH {LINES}, g AS (SELECT file, line, text FROM lines WHERE regexp_matches(text, '\\bthe\\b')) SELECT count(*) AS total, count(*) FILTER (contains(text, 'the,')) AS confirmed, count(*) FILTER (NOT contains(text, 'the,') AND contains(text, 'the of')) AS unverified, CAST(0 AS BIGINT) AS excluded, count(*) FILTER (NOT contains(text, 'the,') AND NOT contains(text, 'the of')) AS non_call, CAST(0 AS BIGINT) AS unparsed, CAST(0 AS BIGINT) AS unsupported, CAST(0 AS BIGINT) AS unaccounted, (SELECT count(*) FROM lines WHERE (contains(text, 'the,') OR contains(text, 'the of')) AND NOT regexp_matches(text, '\\bthe\\b')) AS beyond_text, true AS text_complete FROM g")
def _account(spark, sf):
    lines = T.doc_lines(spark, sf)
    ground = search.ground_set(lines, "the")
    claim = F.when(F.col("text").contains("the,"), "confirmed").when(F.col("text").contains("the of"), "unverified")
    claims = lines.select("file", "line", claim.alias("bucket"), F.lit("").alias("reason")).filter("bucket IS NOT NULL")
    return A.account(ground, claims)


@query("account_buckets", f"""WITH {EDGES}, g AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS file, i AS line FROM orders, (SELECT unnest(range(1, 8)) AS i)),
c AS (SELECT file, line, min(CASE WHEN flag = 'N' THEN 2 WHEN tier = 'confirmed' THEN 0 ELSE 1 END) AS b FROM tiers GROUP BY ALL)
SELECT CASE c.b WHEN 0 THEN 'confirmed' WHEN 1 THEN 'unverified' WHEN 2 THEN 'excluded' ELSE 'unclassified' END AS bucket, count(*) AS lines FROM g LEFT JOIN c USING (file, line) GROUP BY 1""")
def _buckets(spark, sf):
    ground = T.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("file"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("line"))
    own = edges.with_tier(T.evidence(spark, sf))
    claims = own.select("file", "line", F.when(F.col("flag") == "N", "excluded").otherwise(F.col("tier")).alias("bucket"), F.col("resolution").alias("reason"))
    return A.assigned(ground, claims).groupBy("bucket").agg(F.count("*").alias("lines"))


@query("account_resolved", f"""WITH {CALLS}, c AS (SELECT file, line, min(CASE tier WHEN 'confirmed' THEN 0 WHEN 'unverified' THEN 1 ELSE 2 END) AS b FROM resolved GROUP BY ALL), d AS (SELECT DISTINCT file, start_line AS line FROM own),
g AS (SELECT DISTINCT file, line FROM calls UNION SELECT file, line FROM d), x AS (SELECT g.*, c.b, d.line IS NOT NULL AS def, CAST(regexp_extract(g.file, '_([0-9]+)', 1) AS INTEGER) = 3 AS bad FROM g LEFT JOIN c USING (file, line) LEFT JOIN d USING (file, line))
SELECT count(*) AS total, count(*) FILTER (NOT bad AND b = 0) AS confirmed, count(*) FILTER (NOT bad AND b = 1) AS unverified, count(*) FILTER (NOT bad AND b = 2) AS excluded, count(*) FILTER (NOT bad AND b IS NULL) AS non_call, count(*) FILTER (bad) AS unparsed, CAST(0 AS BIGINT) AS unsupported, CAST(0 AS BIGINT) AS unaccounted, CAST(0 AS BIGINT) AS beyond_text, false AS text_complete FROM x""")
def _account_resolved(spark, sf):
    f = T.call_facts(spark, sf)
    own = _outcomes(f)
    defined = f["symbols"].select("file", F.col("start_line").alias("line"))
    ground = f["calls"].select("file", "line").unionByName(defined).distinct()
    claims = own.select("file", "line", F.col("tier").alias("bucket"), F.coalesce("reason", "resolution").alias("reason"))
    issues = f["files"].filter(F.regexp_extract("file", "_([0-9]+)", 1) == "3").select("file", F.lit("unparsed").alias("kind"))
    return A.account(ground, claims, defined.withColumn("usage_type", F.lit("definition")), issues)


# graphs


@query("trace", f"""WITH RECURSIVE {FOREST}, t AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION ALL SELECT t.root, f.dst, t.depth + 1 FROM t JOIN forest f ON f.src = t.node WHERE t.depth < 3),
k AS (SELECT t.root, f.src AS parent, f.dst AS node, t.depth + 1 AS depth, row_number() OVER (PARTITION BY f.src ORDER BY f.dst) AS ord, count(*) OVER (PARTITION BY f.src) AS children FROM t JOIN forest f ON f.src = t.node WHERE t.depth < 3)
SELECT root, parent, node, depth, CAST(ord AS INTEGER) AS ord, false AS shown_before, children FROM k WHERE ord <= 10""")
def _trace(spark, sf):
    roots = T.table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return graph.tree(T.forest(spark, sf), roots, depth=3)


@query("blast", """SELECT 'c' || c_custkey AS root, 'c' || c_custkey AS node, 0 AS depth, 'confirmed' AS tier FROM customer UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 1, 'confirmed' FROM customer UNION ALL SELECT 'c' || c_custkey, 'r' || n_regionkey, 2, 'confirmed' FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 'c' || c_custkey, 's' || s_suppkey, 2, 'unverified' FROM customer JOIN supplier ON s_nationkey = c_nationkey""")
def _blast(spark, sf):
    targets = T.table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    return graph.blast(T.forest(spark, sf), T.possible_calls(spark, sf), targets, depth=2).select("root", "node", "depth", "tier")


@query("reverse_trace", "SELECT 'r' || n_regionkey AS node, 'o' || o_orderkey AS root, 3 AS depth FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def _reverse(spark, sf):
    targets = T.table(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    return graph.reverse_to_roots(T.forest(spark, sf), targets, depth=5).select("node", "root", "depth")


@query("reachable", f"WITH RECURSIVE {RING}, t AS (SELECT CAST(p_partkey AS VARCHAR) AS node FROM part WHERE p_type = 'PROMO' UNION SELECT r.dst FROM t JOIN ring r ON r.src = t.node) SELECT node FROM t")
def _reachable(spark, sf):
    return graph.reachable(T.user_graph(spark, sf), T.table(spark, sf, "part").filter("p_type = 'PROMO'").select(F.col("p_partkey").cast("string").alias("node")))


@query("deps", f"WITH RECURSIVE {RING}, t AS (SELECT src AS root, src AS node, 0 AS depth FROM (SELECT DISTINCT src FROM ring) UNION SELECT t.root, r.dst, t.depth + 1 FROM t JOIN ring r ON r.src = t.node WHERE t.depth < 5) SELECT root, node, min(depth) AS depth FROM t GROUP BY ALL")
def _deps(spark, sf):
    own = T.user_graph(spark, sf)
    return graph.closure(own, own.select(F.col("src").alias("node")).distinct(), depth=5)


@query("cycles", f"""WITH RECURSIVE {RING}, e AS (SELECT * FROM ring WHERE src <> dst), t AS (SELECT src AS a, dst AS b FROM e UNION SELECT t.a, e.dst FROM t JOIN e ON e.src = t.b)
SELECT x.a AS node, min(x.b) AS component FROM t x JOIN t y ON y.a = x.b AND y.b = x.a WHERE x.a IN (SELECT a FROM t WHERE a = b) GROUP BY x.a""")
def _cycles(spark, sf):
    return graph.components(T.user_graph(spark, sf))


@query("short_cycles", f"""WITH {RING}, e AS (SELECT * FROM ring WHERE src <> dst)
SELECT a.src || ',' || a.dst AS cycle, 2 AS length FROM e a JOIN e b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst
UNION ALL SELECT a.src || ',' || a.dst || ',' || b.dst, 3 FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND b.dst <> a.dst""")
def _short(spark, sf):
    return graph.short_cycles(T.user_graph(spark, sf), 3).select(F.array_join("cycle", ",").alias("cycle"), "length")


@query("affected_tests", """SELECT 'r' || n_regionkey AS test, count(DISTINCT n_nationkey) AS confirmed, CAST(0 AS BIGINT) AS possible FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) GROUP BY 1
UNION ALL SELECT 't' || l_linenumber, CAST(0 AS BIGINT), count(DISTINCT l_suppkey) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey IN (SELECT c_nationkey FROM customer) GROUP BY 1""")
def _affected(spark, sf):
    mark = lambda m, c: F.concat(F.lit(m), F.col(c).cast("string"))
    targets = T.table(spark, sf, "customer").select(mark("c", "c_custkey").alias("node"))
    tests = T.table(spark, sf, "region").select(mark("r", "r_regionkey").alias("node")).unionByName(T.table(spark, sf, "lineitem").select(mark("t", "l_linenumber").alias("node")).distinct())
    return graph.affected_tests(T.forest(spark, sf), T.possible_calls(spark, sf), targets, tests, depth=3)


# audits


@query("deadcode", f"""WITH {DOCS}, called AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS symbol_id FROM labels WHERE toxic = 0),
far AS (SELECT DISTINCT name FROM sym WHERE k % 30 IN (0, 10) AND (k % 30 = 0 OR k - 10 IN (SELECT k FROM sym))),
v AS (SELECT s.*, CASE WHEN s.k IN (SELECT item_id * 21 FROM benchmark) THEN 'unsupported-mention' WHEN s.rel LIKE 'tests/%' THEN 'test' WHEN s.k IN (SELECT page_id * 3 FROM pages) OR s.k % 19 = 2 THEN 'entry-point' WHEN s.k % 13 IN (4, 5) THEN 'decorated' WHEN s.k % 7 = 3 THEN 'exported' WHEN c.symbol_id IS NOT NULL THEN 'called'
    WHEN s.kind = 'constructor' AND EXISTS (SELECT 1 FROM sym o JOIN called USING (symbol_id) WHERE o.name = s.owner AND o.rel = s.rel) THEN 'constructor' WHEN EXISTS (SELECT 1 FROM sym m JOIN called USING (symbol_id) WHERE m.owner = s.name AND m.rel = s.rel) THEN 'live-member'
    WHEN s.k IN (SELECT conv_id * 4 FROM conversations) THEN 'mentioned' WHEN s.owner IN (SELECT 'doc' || vec_id FROM embeddings WHERE label = 1) AND s.rel LIKE 'app/src1/%' THEN 'dynamic-dispatch' WHEN s.kind <> 'class' AND s.owner IN (SELECT name FROM far) THEN 'external-contract' ELSE 'candidate' END AS verdict FROM sym s LEFT JOIN called c USING (symbol_id))
SELECT symbol_id, verdict FROM v""")
def _deadcode(spark, sf):
    own, text = T.doc_symbols(spark, sf), lambda c: F.concat(F.lit("doc"), c.cast("string"))
    calls = T.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("to_id"), F.lit(None).cast("string").alias("enclosing_id"), F.when(F.col("toxic") == 1, "excluded").otherwise("confirmed").alias("tier"))
    tokens = T.table(spark, sf, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("file"), F.col("turn").cast("int").alias("line"), text(F.col("conv_id") * 4).alias("token")).distinct()
    entries = T.table(spark, sf, "pages").select((F.col("page_id") * 3).cast("string").alias("symbol_id"))
    issues = T.table(spark, sf, "region").select(F.lit("unparsed").alias("kind"))
    gaps = T.table(spark, sf, "benchmark").select(text(F.col("item_id") * 21).alias("token"))
    holders = own.filter("rel LIKE 'app/src1/%'").select("file").distinct().join(T.table(spark, sf, "embeddings").filter("label = 1").select(text(F.col("vec_id")).alias("holder")).join(own.select(F.col("owner").alias("holder"), "file").distinct(), "holder").select("file", "holder"), "file")
    return audits.deadcode(own, calls, tokens, entries, issues, gaps=gaps, holders=holders).select("symbol_id", "verdict")


@query("entrypoints", f"""WITH {DOCS}, tagged AS (SELECT symbol_id, name, rel, start_line, CASE WHEN language = 'python' AND k % 13 = 4 THEN 'flask-route' WHEN language = 'csharp' AND k % 13 = 5 THEN 'csharp-test' WHEN language IN ('java', 'rust') AND k % 17 = 5 THEN CASE language WHEN 'java' THEN 'java-junit-test' ELSE 'rust-test-attr' END WHEN language = 'java' AND k % 17 = 6 THEN 'spring-mapping' END AS rule, 0.95 AS confidence FROM sym),
routed AS (SELECT symbol_id, name, rel, start_line, 'express-route' AS rule, 0.9 AS confidence FROM sym WHERE k IN (SELECT page_id FROM pages)),
files AS (SELECT DISTINCT CAST(NULL AS VARCHAR) AS symbol_id, 'bin/' || lang || '.js' AS name, 'bin/' || lang || '.js' AS rel, 1 AS start_line, 'js-shebang-main' AS rule, 0.95 AS confidence FROM documents UNION ALL SELECT DISTINCT CAST(NULL AS VARCHAR), rel, rel, 1, 'js-test-file', 0.9 FROM sym WHERE language = 'javascript' AND rel LIKE 'tests/%'),
e AS (SELECT * FROM tagged WHERE rule IS NOT NULL UNION ALL SELECT * FROM routed UNION ALL SELECT * FROM files), b AS (SELECT *, row_number() OVER (PARTITION BY coalesce(symbol_id, name) ORDER BY confidence DESC, rule) AS n FROM e)
SELECT symbol_id, name, rel AS file, CAST(start_line AS INTEGER) AS line, rule, CAST(confidence AS DOUBLE) AS confidence FROM b WHERE n = 1""")
def _entry(spark, sf):
    own = T.doc_symbols(spark, sf)
    sites = T.table(spark, sf, "pages").select(F.lit("web.js").alias("file"), F.col("page_id").cast("int").alias("line"), F.col("page_id"))
    no = F.lit(None).cast("string")
    routed = sites.select("file", "line", F.lit("get").alias("name"), F.lit(True).alias("is_method"), F.lit("app").alias("receiver"), F.lit("/x").alias("first_string_arg"), F.lit(False).alias("is_function_ref"), no.alias("shape"))
    handlers = sites.select("file", "line", F.concat(F.lit("doc"), F.col("page_id").cast("string")).alias("name"), F.lit(False).alias("is_method"), no.alias("receiver"), no.alias("first_string_arg"), F.lit(True).alias("is_function_ref"), no.alias("shape"))
    scripts = T.table(spark, sf, "documents").select(F.concat(F.lit("bin/"), F.col("lang"), F.lit(".js")).alias("file")).distinct()
    files = own.select("file", F.col("file").alias("rel"), "language").distinct().unionByName(scripts.select("file", F.col("file").alias("rel"), F.lit("javascript").alias("language"))).unionByName(sites.select("file", F.col("file").alias("rel"), F.lit("javascript").alias("language")).distinct())
    lines = scripts.select("file", F.lit(1).alias("line"), F.lit("#!/usr/bin/env node").alias("text"))
    imports = files.filter("language = 'python'").select("file", F.lit("flask").alias("module"))
    found = audits.entry_points(own, routed.unionByName(handlers), files, imports, audits.rules_table(spark), lines)
    return found.select("symbol_id", "name", "file", "line", "rule", "confidence")


@query("diff_lines", """WITH h AS (SELECT CAST(l_orderkey AS VARCHAR) AS file, l_partkey AS a, l_linenumber % 3 AS an, l_suppkey AS b, CASE WHEN l_linenumber = 1 THEN 1 ELSE l_linenumber % 4 END AS bn FROM lineitem)
SELECT file, side, count(*) AS n, CAST(sum(line) AS BIGINT) AS total FROM (SELECT file, 'deleted' AS side, unnest(range(a, a + an)) AS line FROM h UNION ALL SELECT file, 'added', unnest(range(b, b + bn)) FROM h) GROUP BY ALL""")
def _diff(spark, sf):
    return audits.diff_lines(T.diffs(spark, sf)).groupBy("file", "side").agg(F.count("*").alias("n"), F.sum("line").alias("total"))


@query("stacktrace", """SELECT o_orderkey AS trace_id, CASE o_orderkey % 3 WHEN 0 THEN 'f' || o_orderkey WHEN 1 THEN 'run' || o_orderkey ELSE 'com.x.C' || o_orderkey || '.go' END AS function,
CASE o_orderkey % 3 WHEN 0 THEN 'app/m' || o_orderkey || '.py' WHEN 1 THEN 'src/a' || o_orderkey || '.js' ELSE 'C' || o_orderkey || '.java' END AS path, CAST(o_custkey AS INTEGER) AS line, CASE o_orderkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'node' ELSE 'java' END AS runtime FROM orders""")
def _stack(spark, sf):
    return S.parse(T.traces(spark, sf)).select("trace_id", "function", "path", "line", "runtime")


@query("stale", "SELECT CAST(doc_id AS VARCHAR) AS rel, CASE doc_id % 4 WHEN 0 THEN 'deleted' WHEN 1 THEN 'changed' ELSE 'added' END AS change FROM documents WHERE doc_id % 4 < 3")
def _stale(spark, sf):
    every = T.doc_files(spark, sf).select(F.col("file").alias("rel"), "hash")
    k = F.col("rel").cast("long") % 4
    now = every.filter(k != 0)
    before = every.filter(k != 2).withColumn("hash", F.when(k == 1, F.lit("")).otherwise(F.col("hash")))
    return stale(now, before)


# web

PAGES = """p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages),
rt AS (SELECT CAST(page_id AS VARCHAR) AS file, CASE WHEN page_id % 5 = 0 THEN 'ALL' ELSE 'GET' END AS method, regexp_replace(CASE WHEN page_id % 2 = 0 THEN regexp_replace(path, '[0-9]+$', '*') ELSE path END, '(.)/$', '\\1') AS np FROM p),
rq AS (SELECT 'q' || page_id AS file, CASE WHEN page_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, regexp_replace(CASE WHEN page_id % 7 = 0 THEN path || '/gone/away' ELSE path END, '(.)/$', '\\1') AS np FROM p),
br AS (SELECT rq.file AS request_file, rt.file AS route_file, rt.method AS route_method, CASE WHEN rt.np = rq.np THEN 'exact' ELSE 'partial' END AS match,
  CAST(round(CASE WHEN rt.np = rq.np THEN 1.0 ELSE 0.85 END - CASE WHEN rt.method = 'ALL' THEN 0.1 ELSE 0 END, 2) AS DOUBLE) AS confidence
  FROM rq JOIN rt ON (rt.method = 'ALL' OR rt.method = rq.method) AND rq.np <> '' AND (rt.np = rq.np OR (contains(rt.np, '*') AND regexp_full_match(rq.np, replace(regexp_replace(rt.np, '([.+?^${}()|])', '\\\\\\1', 'g'), '*', '[^/]+')))))"""


@query("endpoint_bridge", f"WITH {PAGES} SELECT request_file, route_file, match, confidence FROM br")
def _bridge(spark, sf):
    return web.bridge(T.page_routes(spark, sf), T.page_requests(spark, sf)).select("request_file", "route_file", "match", "confidence")


@query("unmatched_routes", f"WITH {PAGES} SELECT file FROM rt WHERE file NOT IN (SELECT route_file FROM br)")
def _unrouted(spark, sf):
    return web.routes_left(T.page_routes(spark, sf), T.page_requests(spark, sf)).select("file")


@query("unmatched_requests", f"WITH {PAGES} SELECT file FROM rq WHERE file NOT IN (SELECT request_file FROM br)")
def _unrequested(spark, sf):
    return web.requests_left(T.page_routes(spark, sf), T.page_requests(spark, sf)).select("file")


@query("page_calls", "SELECT page_id || '.html' AS file, 1 + length(substr(html, 1, strpos(html, 'track(') - 1)) - length(replace(substr(html, 1, strpos(html, 'track(') - 1), chr(10), '')) AS line, 'track' AS name, CAST(1 AS INTEGER) AS arg_count FROM pages")
def _page_calls(spark, sf):
    pages = document_files(T.table(spark, sf, "pages"), "page_id", "html", "html", ".html")
    return relations(facts(pages, ("calls",)))["calls"].filter("NOT is_function_ref").select("file", F.col("line").cast("long").alias("line"), "name", "arg_count")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def run(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    return QUERIES[name](spark, sf_dir)
