"""Plain tables seen as fact relations: select and explode only.

documents -> files and lines; part -> symbols; lineitem -> calls with evidence;
region, nation, customer, orders -> a call forest; pages -> routes, requests and
HTML facts; orders and lineitem -> diffs and traces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefold.functions.text import normal_route
from codefold.operators.search import lines_of
from codefold.schemas import PARAMS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    return lines_of(docs)


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = F.size(F.split("text", "\n", -1)) - F.col("text").endswith("\n").cast("int") - (F.col("text") == "").cast("int")
    return docs.select(F.col("doc_id").cast("string").alias("file"), F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("rel"), F.concat_ws("/", "source", "lang").alias("dir"), F.col("lang").alias("language"), size.alias("lines"), F.md5("text").alias("hash"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.when(F.col("p_type") == "SMALL", "tests/").when(F.col("p_type") == "LARGE", "lib/").when(F.col("p_type") == "MEDIUM", "examples/").otherwise("app/")
    rel = F.concat(folder, F.regexp_replace("p_brand", "#", "_"), F.lit(".py"))
    kind = F.when(F.col("p_size") % 10 == 0, "class").otherwise("function")
    start = (F.col("p_partkey") * 100 + 1).cast("int")
    param = F.struct(F.lit("a").alias("name"), F.lit("int").alias("type"), F.lit(False).alias("optional"), F.lit(None).cast("string").alias("default"), F.lit(False).alias("rest"), F.lit(False).alias("keyword_only"), F.lit(False).alias("positional_only"))
    params = F.when(F.col("p_size") % 4 == 0, F.array().cast(PARAMS)).otherwise(F.transform(F.sequence(F.lit(1), F.col("p_size") % 4), lambda i: param.withField("name", F.concat(F.lit("a"), i.cast("string"))).withField("optional", i > 2)))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("symbol_id"), F.col("p_name").alias("name"), kind.alias("kind"), F.when(kind == "class", "type").otherwise("callable").alias("family"), rel.alias("file"), rel.alias("rel"), F.lit("python").alias("language"),
        start.alias("start_line"), (start + F.col("p_size")).alias("end_line"), start.alias("name_line"), F.when(F.col("p_size") % 2 == 1, F.col("p_brand")).alias("owner"), F.lit(None).cast("string").alias("receiver"), F.lit(None).cast("string").alias("params"), params.alias("params_structured"),
        F.col("p_type").alias("return_type"), F.array().cast("array<string>").alias("modifiers"), F.when(F.col("p_size") == 7, F.array(F.lit("app.route"))).otherwise(F.array().cast("array<string>")).alias("decorators"), F.array().cast("array<string>").alias("bases"),
        (F.col("p_size") % 3 == 0).alias("is_async"), (F.col("p_retailprice") >= 950).alias("is_exported"), F.lit(None).cast("string").alias("entry_kind"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges from orders to parts; each line's columns are its evidence."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").cast("string").alias("file"), c("l_linenumber").alias("line"), c("l_partkey").cast("string").alias("to_id"), c("l_suppkey").cast("string").alias("receiver"), c("l_quantity").cast("int").alias("quantity"), (c("l_quantity").cast("int") % 5).alias("arg_count"), c("l_returnflag").alias("flag"),
        (c("l_quantity") < 3).alias("type_mismatch"), ((c("l_returnflag") == "R") & (c("l_linestatus") == "O")).alias("possible_dispatch"), (c("l_discount") == 0.0).alias("method_ambiguous"), (c("l_returnflag") == "A").alias("has_binding"), (c("l_quantity") > 45).alias("same_class"), (c("l_tax") >= 0.07).alias("receiver_hint"), (c("l_discount") >= 0.05).alias("in_scope"), (c("l_tax") == 0.0).alias("is_uncertain"),
    )


def call_facts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Order lines as call sites inside parts, with receivers, types, shapes and shadows: ``calls, symbols, files, import_edges, inherit, bound``.

    A part's name gets its size's remainder, so a name has a few definitions; files
    of even brands are Java. The order picks the part that calls.
    """
    c, number = F.col, F.regexp_extract("file", "_([0-9]+)", 1).cast("int")
    own = symbols(spark, sf_dir).join(table(spark, sf_dir, "part").select(c("p_partkey").cast("string").alias("symbol_id"), "p_partkey", "p_size"), "symbol_id")
    own = own.withColumns({"name": F.concat_ws("_", "name", (c("p_size") % 7).cast("string")), "language": F.when(number % 2 == 0, "java").otherwise("python")})
    total = F.broadcast(own.agg(F.count("*").alias("parts")))
    target = own.select(c("p_partkey").alias("l_partkey"), c("name"))
    caller = own.select(c("p_partkey").alias("by"), "file", (c("start_line") + 1).alias("line"))
    brand = lambda k: F.concat(F.lit("Brand#"), (c(k) % 25 + 1).cast("string"))
    sites = table(spark, sf_dir, "lineitem").crossJoin(total).withColumn("by", c("l_orderkey") % c("parts")).join(target, "l_partkey").join(caller, "by").withColumns({"q": c("l_quantity").cast("int"), "is_method": c("l_returnflag") != "N"})
    receiver = F.when(~c("is_method"), None).when(c("l_linestatus") == "O", "self").when(c("q") % 4 == 0, brand("l_suppkey")).when(c("q") % 4 == 1, "os").when(c("q") % 4 == 2, "obj")
    sites = sites.withColumn("receiver", receiver).withColumns({
        "receiver_type": F.when((c("receiver") == "obj") & (c("l_discount") >= 0.05), brand("l_partkey")), "seq": c("l_linenumber"), "arg_count": c("q") % 5, "arg_spread": c("l_tax") == 0.07, "is_function_ref": c("l_tax") == 0.08, "local_shadow": (c("l_discount") == 0.1) & ~c("is_method"),
        "resolved_names": F.array().cast("array<string>"), "shape": F.when(c("l_linenumber") == 1, "str").when(c("l_linenumber") == 2, "num").otherwise("id"),
    })
    calls = sites.select("file", "line", "seq", "name", "resolved_names", "is_method", "receiver", "receiver_type", "arg_count", "arg_spread", "is_function_ref", "local_shadow", "shape")
    following = own.select((c("p_partkey") - 1).alias("p_partkey"), c("file").alias("dst"))
    edges = own.filter("p_size < 25").select("p_partkey", c("file").alias("src")).join(following, "p_partkey").filter("src <> dst").select("src", "dst").distinct()
    brands = spark.range(1, 26).select(c("id").cast("int").alias("k"))
    inherit = brands.filter("k > 5").select(F.concat(F.lit("Brand#"), c("k").cast("string")).alias("child"), F.concat(F.lit("Brand#"), (c("k") % 5 + 1).cast("string")).alias("parent"))
    files = own.select("file", "language").distinct()
    bound = files.filter(number % 5 == 0).select("file", F.lit("obj").alias("name"), (number % 10 == 0).alias("external"))
    return {"calls": calls, "symbols": own.drop("p_partkey", "p_size"), "files": files, "import_edges": edges, "inherit": inherit, "bound": bound}


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst``: regions call nations, these customers, these orders."""
    r, n, c, o = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    name = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    return (
        r.select(name("r", "r_regionkey").alias("src"), F.col("r_regionkey").alias("k")).join(n.select(F.col("n_regionkey").alias("k"), name("n", "n_nationkey").alias("dst")), "k").select("src", "dst")
        .unionByName(c.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst")))
        .unionByName(o.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst")))
    )


def user_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst`` with cycles: each part leads to one of its ten neighbours by key arithmetic, small ones to the next too."""
    p, k = table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("p_partkey")
    name = lambda c: c.cast("long").cast("string")
    one = p.select(name(k).alias("src"), name(k - k % 10 + (k * 7 + F.col("p_size")) % 10).alias("dst"))
    return one.unionByName(p.filter((F.col("p_size") < 10) & (k % 10 < 9)).select(name(k).alias("src"), name(k + 1).alias("dst"))).distinct()


def possible_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst``: edges beside the forest's: suppliers call nations, line numbers suppliers."""
    text = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    nations = table(spark, sf_dir, "supplier").select(text("s", "s_suppkey").alias("src"), text("n", "s_nationkey").alias("dst"))
    return nations.unionByName(table(spark, sf_dir, "lineitem").select(text("t", "l_linenumber").alias("src"), text("s", "l_suppkey").alias("dst")).distinct())


def doc_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as symbols of seven languages: every tenth a class that the next two belong to, some decorated, exported, tests or with a base outside."""
    k = F.col("doc_id")
    lang = F.element_at(F.array(*map(F.lit, ("python", "java", "go", "rust", "csharp", "c", "javascript"))), (F.floor(k / 10) % 7 + 1).cast("int"))
    kind = F.when(k % 10 == 0, "class").when(k % 10 == 3, "constructor").when(k % 10 <= 2, "method").otherwise("function")
    owner = F.when((k % 10).between(1, 3), F.concat(F.lit("doc"), (k - k % 10).cast("string")))
    ten = F.floor(k / 10)
    rel = F.concat(F.when(ten % 11 == 4, "tests/").otherwise("app/"), F.lit("src"), (ten % 4).cast("string"), F.lit("/"), ten.cast("string"), F.lit(".src"))
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "documents").select(
        k.cast("string").alias("symbol_id"), F.concat(F.lit("doc"), k.cast("string")).alias("name"), kind.alias("kind"), F.when(k % 10 == 0, "type").otherwise("callable").alias("family"), rel.alias("file"), rel.alias("rel"), lang.alias("language"),
        (k % 10 * 20 + 1).cast("int").alias("start_line"), (k % 10 * 20 + 9).cast("int").alias("end_line"), (k % 10 * 20 + 1).cast("int").alias("name_line"), owner.alias("owner"), F.lit(None).cast("string").alias("receiver"), F.lit(None).cast("string").alias("params"), F.lit(None).cast(PARAMS).alias("params_structured"),
        F.col("lang").alias("return_type"), F.when(k % 17 == 5, F.array(F.lit("test"))).when(k % 17 == 6, F.array(F.lit("static"), F.lit("getmapping"))).otherwise(none).alias("modifiers"),
        F.when(k % 13 == 4, F.array(F.lit("app.route('/x')"))).when(k % 13 == 5, F.array(F.lit("Fact"))).when(k % 13 == 6, F.array(F.lit("staticmethod"))).otherwise(none).alias("decorators"),
        F.when(k % 30 == 0, F.array(F.lit("Outside"))).when(k % 30 == 10, F.array(F.concat(F.lit("doc"), (k - 10).cast("string")))).otherwise(none).alias("bases"), F.lit(False).alias("is_async"), (k % 7 == 3).alias("is_exported"), F.when(k % 19 == 2, "main").alias("entry_kind"),
    )


def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as routes: their path; numeric last parts are parameters on every other page."""
    path = F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1)
    path = F.when(F.col("page_id") % 2 == 0, F.regexp_replace(path, "[0-9]+$", ":id")).otherwise(path)
    return table(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 5 == 0, "ALL").otherwise("GET").alias("method"), path.alias("path"), normal_route(path).alias("norm_path"), F.lit("page").alias("handler"), F.col("page_id").cast("string").alias("file"), F.lit(1).alias("line"))


def page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each page's path; one of seven asks for something below it that is no route."""
    path = F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1)
    p = table(spark, sf_dir, "pages").select(F.col("page_id"), F.when(F.col("page_id") % 7 == 0, F.concat(path, F.lit("/gone/away"))).otherwise(path).alias("path"))
    return p.select(F.when(F.col("page_id") % 3 == 0, "POST").otherwise("GET").alias("method"), "path", normal_route(F.col("path")).alias("norm_path"), F.lit(False).alias("interp"), F.concat(F.lit("q"), F.col("page_id").cast("string")).alias("file"), F.lit(1).alias("line"), F.lit(False).alias("method_inferred"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stack trace for each order, in the style its priority picks."""
    k = F.col("o_orderkey").cast("string")
    text = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('Traceback:\n  File "app/m'), k, F.lit('.py", line '), F.col("o_custkey").cast("string"), F.lit(", in f"), k))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Error: x\\n    at run"), k, F.lit(" (src/a"), k, F.lit(".js:"), F.col("o_custkey").cast("string"), F.lit(":7)")))
        .otherwise(F.concat(F.lit("\tat com.x.C"), k, F.lit(".go(C"), k, F.lit(".java:"), F.col("o_custkey").cast("string"), F.lit(")\nnothing here")))
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trace_id"), text.alias("stack"))


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One patch for each order line: a hunk from its part, supplier and quantity."""
    s = lambda c: F.col(c).cast("long").cast("string")
    hunk = F.concat(F.lit("@@ -"), s("l_partkey"), F.lit(","), (F.col("l_linenumber") % 3).cast("string"), F.lit(" +"), s("l_suppkey"), F.when(F.col("l_linenumber") == 1, F.lit("")).otherwise(F.concat(F.lit(","), (F.col("l_linenumber") % 4).cast("string"))), F.lit(" @@ f()"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("file"), hunk.alias("diff"))
