"""Endpoints: server routes, client requests, and the bridge between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefold.functions.text import joined_route, normal_route
from codefold.operators.pairs import dealt

#: Call patterns: side, language, receiver, method, framework. Fixed values.
_VERBS = "get|post|put|delete|patch|options|head"
PATTERNS = [
    *[("server", lang, "(?i)^(app|router|server|api|fastify|koaRouter|koa)$", f"^({_VERBS}|all)$", "express") for lang in ("javascript", "typescript", "tsx", "html")],
    ("server", "go", r"(?i)^(r|router|engine|app|e|api|v\d+|group|mux|serveMux|http)$", "^(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|Any|Handle|HandleFunc)$", "go-http"),
    ("server", "rust", "(?i)^(router|app|api|r)$", "^route$", "axum"),
    ("server", "csharp", "(?i)^(app|endpoints|routes)$", "^Map(Get|Post|Put|Delete|Patch|Methods|Fallback)$", "aspnet-minimal"),
    *[("client", lang, "(?i)^(axios|client|http|api|httpClient)$", f"^({_VERBS}|request)$", "axios") for lang in ("javascript", "typescript", "tsx", "html")],
    *[("client", lang, "^$", "^(fetch|axios)$", "fetch") for lang in ("javascript", "typescript", "tsx", "html")],
    ("client", "python", "^(requests|httpx|client|session|s)$", f"^({_VERBS}|request)$", "requests"),
    ("client", "go", "(?i)^(http|client|c)$", "^(Get|Post|PostForm|Head|Do|NewRequest)$", "go-http"),
    ("client", "java", "(?i)^(restTemplate|client|webClient|http|httpClient)$", "^(getForObject|postForObject|putForObject|exchange|getForEntity|postForEntity|uri|send)$", "spring-client"),
    ("client", "rust", "(?i)^(client|reqwest|c|http)$", "^(get|post|put|delete|patch|head|request)$", "reqwest"),
    ("client", "csharp", "(?i)^(client|http|httpClient)$", "^(GetAsync|PostAsync|PutAsync|DeleteAsync|PatchAsync|SendAsync)$", "dotnet-httpclient"),
]
#: Decorators whose name ends in a verb give its method; these give a prefix on a class.
PREFIXES = ("Controller", "RequestMapping", "Path", "Route")
VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH", "OPTIONS", "HEAD")


def patterns_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PATTERNS, "side string, language string, receiver_pattern string, method_pattern string, framework string")


def _method(name, both: bool):
    """The HTTP method in a call's name; without one, ALL for servers and an inferred GET for clients."""
    verb = F.upper(F.regexp_extract(name, "(?i)(get|post|put|delete|patch|options|head)", 1))
    return F.when(verb != "", verb).otherwise("ALL" if both else "GET")


def call_routes(calls: DataFrame, files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Routes registered by calls with a literal path: ``method, path, norm_path, handler, file, line, framework``. A getter with one argument is no route."""
    sites = calls.filter("first_string_arg IS NOT NULL AND is_method").join(files.select("file", "language"), "file").join(F.broadcast(patterns.filter("side = 'server'")), "language")
    sites = sites.filter(F.expr("receiver rlike receiver_pattern AND name rlike method_pattern") & ~((F.col("framework") == "express") & (F.col("arg_count") < 2)))
    handlers = calls.filter("is_function_ref").groupBy("file", "line").agg(F.min("name").alias("handler"))
    return sites.join(handlers, ["file", "line"], "left").select(_method(F.col("name"), True).alias("method"), F.col("first_string_arg").alias("path"), normal_route(F.col("first_string_arg")).alias("norm_path"), "handler", "file", "line", "framework")


def decorator_routes(symbols: DataFrame) -> DataFrame:
    """Routes of decorators such as ``app.get('/x')``, ``route('/x', methods=['A', 'B'])`` (one row for each) and ``GetMapping("/x")``, behind their class's prefix."""
    path = r"""\(\s*(?:(?:value|path)\s*=\s*)?["']([^"']*)["']"""
    own = symbols.select("file", "owner", "name", F.col("start_line").alias("line"), F.explode("decorators").alias("d"))
    parts = own.withColumn("path", F.regexp_extract("d", path, 1)).withColumn("head", F.regexp_extract("d", r"^([\w.]+)", 1)).withColumn("last", F.regexp_extract("head", r"(\w+)$", 1))
    prefix = parts.filter(F.col("last").isin(*PREFIXES)).groupBy("file", F.col("name").alias("owner")).agg(F.min("path").alias("prefix"))
    inside = F.regexp_extract("d", r"methods\s*=\s*[\[({]([^\])}]*)", 1)
    listed = F.transform(F.regexp_extract_all(inside, F.lit(r"""["']([A-Za-z]+)["']"""), F.lit(1)), lambda x: F.upper(x))
    verb = F.upper(F.regexp_extract("last", "(?i)^(?:Http)?(get|post|put|delete|patch|options|head|all)(?:Mapping)?$", 1))
    methods = F.when(verb != "", F.array(verb)).when(F.lower("last") == "route", F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("GET")))).when(F.col("last") == "RequestMapping", F.array(F.lit("ALL")))
    found = parts.withColumn("method", F.explode(methods)).filter((F.col("path") != "") | F.col("d").contains("("))
    found = found.join(prefix, ["file", "owner"], "left")
    whole = joined_route(F.col("prefix"), F.col("path"))
    return found.select("method", whole.alias("path"), normal_route(whole).alias("norm_path"), F.col("name").alias("handler"), "file", "line", F.when(F.col("head").contains("."), F.regexp_extract("head", r"^(\w+)", 1)).otherwise("decorator").alias("framework"))


def mounted(routes: DataFrame, mounts: DataFrame, depth: int = 8) -> DataFrame:
    """Routes behind the prefixes of their routers: ``mounts``: ``parent, router, prefix``; composed up to ``depth`` mounts, cycles end there."""
    chain = mounts.select(F.col("router"), F.col("parent"), F.col("prefix"))
    full = chain
    out = full
    for _ in range(depth - 1):
        full = full.select("router", F.col("parent").alias("p"), F.col("prefix").alias("own")).join(chain.select(F.col("router").alias("p"), "parent", F.col("prefix").alias("above")), "p").filter("router <> parent").select("router", "parent", joined_route(F.col("above"), F.col("own")).alias("prefix"))
        out = out.unionByName(full)
    roots = out.join(chain.select(F.col("router").alias("parent")).distinct(), "parent", "left_anti").select("router", "prefix").distinct()
    return routes.join(roots, "router", "left").withColumn("path", joined_route(F.col("prefix"), F.col("path"))).withColumn("norm_path", normal_route(F.col("path"))).drop("prefix")


def file_routes(files: DataFrame, exports: DataFrame) -> DataFrame:
    """Routes of files under ``app/``: one for each exported method of ``route.*``."""
    own = files.filter(F.col("rel").rlike(r"(^|/)app/(.*/)?route\.(js|ts|jsx|tsx)$")).select("file", F.regexp_replace(F.regexp_extract("rel", r"(?:^|/)app/(.*?)/?route\.\w+$", 1), r"\[\.*([^\]]+)\]", ":$1").alias("p"))
    verbs = exports.filter(F.col("name").isin(*VERBS))
    path = F.concat(F.lit("/"), F.regexp_replace("p", r"\([^)]*\)/?", ""))
    return own.join(verbs, "file").select(F.col("name").alias("method"), path.alias("path"), normal_route(path).alias("norm_path"), F.col("name").alias("handler"), "file", "line", F.lit("next").alias("framework"))


def requests(calls: DataFrame, files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Client requests with a literal address: ``method, path, norm_path, interp, file, line, method_inferred``. Python's need ``/`` or ``://``."""
    sites = calls.filter("first_string_arg IS NOT NULL").join(files.select("file", "language"), "file").join(F.broadcast(patterns.filter("side = 'client'")), "language")
    sites = sites.filter(F.expr("coalesce(receiver, '') rlike receiver_pattern AND name rlike method_pattern") & ((F.col("language") != "python") | F.col("first_string_arg").contains("/")))
    path = F.regexp_replace(F.col("first_string_arg"), "^[a-z]+://[^/]*", "")
    path = F.when(path == "", "/").otherwise(path)
    explicit = F.upper(F.coalesce("options_method", F.regexp_extract("name", "(?i)(get|post|put|delete|patch|options|head)", 1)))
    return sites.select(F.when(explicit != "", explicit).otherwise("GET").alias("method"), F.col("first_string_arg").alias("path"), normal_route(F.regexp_replace(path, r"\$\{[^}]*\}", "*")).alias("norm_path"), F.coalesce("first_string_interp", F.lit(False)).alias("interp"), "file", "line", (explicit == "").alias("method_inferred"), "framework").dropDuplicates(["file", "line", "path", "method"])


def bridge(routes: DataFrame, requests_: DataFrame) -> DataFrame:
    """Requests with the routes they may reach: ``match`` exact, partial or uncertain, and ``confidence``.

    Paths meet first, each once. Equal ones meet by an equi-join. A wildcard path
    and another meet if the other begins with the whole segments before the first
    wildcard: one side's stem is joined with the other's prefixes. A wildcard is
    one segment, so where the pattern must fit the sizes are equal too. The
    regular expression then looks at few pairs of paths. Methods are compared, and
    confidences found, once for each pair of kinds (path and method). The rows of
    either side meet last, by these pairs, dealt so that a frequent path is no
    single task's; every pair of rows made is one of the result.
    """
    left = requests_.filter("norm_path <> ''").select(F.col("file").alias("request_file"), F.col("line").alias("request_line"), F.col("method").alias("request_method"), F.col("norm_path").alias("request_path"), "interp", "method_inferred")
    right = routes.filter("norm_path <> ''").select(F.col("file").alias("route_file"), F.col("line").alias("route_line"), F.col("method").alias("route_method"), F.col("norm_path").alias("route_path"), "handler")
    wild = lambda c: F.col(c).contains("*")
    size = lambda c: F.size(F.split(c, "/"))
    stem = lambda c: F.regexp_extract(c, r"^([^*]*/|)", 1)
    prefixes = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.greatest(size(c) - 1, F.lit(0))), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(F.split(c, "/"), 1, i), "/"), F.lit("/")))))
    as_regex = lambda c: F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.col(c), r"([.+?^${}()|\[\]\\])", r"\\$1"), r"\*", "[^/]+"), F.lit("$"))
    left = left.withColumn("guessed", F.coalesce("method_inferred", F.lit(False)))
    ask, serve = ["request_path", "request_method", "guessed"], ["route_path", "route_method"]
    asked, served = left.select("request_path").distinct(), right.select("route_path").distinct()
    pair = lambda match, base: ["request_path", "route_path", match.alias("match"), base.alias("base")]
    differ = F.col("request_path") != F.col("route_path")
    star = wild("request_path")
    equal = asked.withColumn("route_path", F.col("request_path")).select(pair(F.when(star, F.lit("partial")).otherwise(F.lit("exact")), F.when(star, 0.85).otherwise(1.0)))
    patterns = served.filter(wild("route_path")).withColumn("stem", stem("route_path")).withColumn("size", size("route_path")).withColumn("rx", as_regex("route_path"))
    server = asked.withColumn("size", size("request_path")).withColumn("stem", prefixes("request_path")).join(patterns, ["stem", "size"]).filter(differ & F.expr("request_path rlike rx"))
    server = server.select(pair(F.lit("partial"), F.lit(0.85)))
    open_ = left.filter(star & F.col("interp"))
    loose = open_.select("request_path").distinct().withColumn("stem", stem("request_path")).withColumn("rx", as_regex("request_path")).withColumn("open", F.regexp_replace("request_path", r"\*+$", ""))
    fits = F.expr("route_path rlike rx") | (F.expr("startswith(route_path, open)") & wild("route_path"))
    client = loose.join(served.withColumn("stem", prefixes("route_path")), "stem").withColumn("own", as_regex("route_path")).filter(differ & fits & ~(wild("route_path") & F.expr("request_path rlike own")))
    client = client.select(pair(F.lit("uncertain"), F.lit(0.6)))
    inferred = F.col("route_method").isin("ALL", "USE") | (F.col("request_method") == "ALL")
    meets = inferred & ((F.col("route_method") != "USE") | F.col("guessed")) | (F.col("route_method") == F.col("request_method"))
    confidence = F.round(F.when(inferred, F.greatest(F.lit(0.0), F.col("base") - 0.1)).otherwise(F.col("base")), 2).alias("confidence")
    kinds = lambda paths, rows: paths.join(rows.select(*ask).distinct(), "request_path").join(right.select(*serve).distinct(), "route_path").filter(meets).select(*ask, *serve, "match", confidence)
    columns = [*(c for c in left.columns if c != "guessed"), *right.columns, "match", "confidence"]
    both = dealt(left.join(kinds(equal.unionByName(server), left), ask), right, serve).select(*columns)
    return both.unionByName(dealt(right.join(kinds(client, open_), serve), open_, ask).select(*columns))


def _kinds(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row for each combination of what a bridge looks at."""
    return rows.groupBy(*by).agg(*(F.min(c).alias(c) for c in rows.columns if c in ("file", "line", "handler")))


def kind_bridge(routes: DataFrame, requests_: DataFrame) -> DataFrame:
    """The bridge between the distinct methods and paths of either side, for what asks only whether something matches."""
    return bridge(_kinds(routes, ["method", "norm_path"]), _kinds(requests_, ["method", "norm_path", "interp", "method_inferred"]))


def routes_left(routes: DataFrame, requests_: DataFrame) -> DataFrame:
    """``unmatched_routes`` without making the pairs."""
    found = kind_bridge(routes, requests_).select(F.col("route_method").alias("method"), F.col("route_path").alias("norm_path")).distinct()
    met = routes.join(found, ["method", "norm_path"], "left_semi").select("file", "line", "method").distinct()
    return routes.join(met, ["file", "line", "method"], "left_anti")


def requests_left(routes: DataFrame, requests_: DataFrame) -> DataFrame:
    """``unmatched_requests`` without making the pairs."""
    key = ["method", "norm_path", "interp", "method_inferred"]
    found = kind_bridge(routes, requests_).select(F.col("request_method").alias("method"), F.col("request_path").alias("norm_path"), "interp", "method_inferred").distinct()
    same = [requests_[k].eqNullSafe(found[k]) for k in key]
    met = requests_.join(found, same, "left_semi").select("file", "line").distinct()
    return requests_.join(met, ["file", "line"], "left_anti")


def unmatched_routes(routes: DataFrame, bridges: DataFrame) -> DataFrame:
    return routes.join(bridges.select(F.col("route_file").alias("file"), F.col("route_line").alias("line"), F.col("route_method").alias("method")).distinct(), ["file", "line", "method"], "left_anti")


def unmatched_requests(requests_: DataFrame, bridges: DataFrame) -> DataFrame:
    return requests_.join(bridges.select(F.col("request_file").alias("file"), F.col("request_line").alias("line")).distinct(), ["file", "line"], "left_anti")


def file_mounts(calls: DataFrame, imports: DataFrame, import_edges: DataFrame) -> DataFrame:
    """``parent, router, prefix``: files mounted by ``x.use('/p', router)`` and the like, the router found through its import."""
    sites = calls.filter("is_method AND name IN ('use', 'register_blueprint', 'include_router', 'mount') AND first_string_arg LIKE '/%'").select("file", "line", F.col("first_string_arg").alias("prefix"))
    refs = calls.filter("is_function_ref").select("file", "line", F.col("name").alias("local"))
    called = imports.select("file", "module", F.posexplode("names").alias("k", "name"), "aliases").select("file", "module", F.coalesce(F.nullif(F.get("aliases", F.col("k")), F.lit("")), F.col("name")).alias("local"))
    dst = import_edges.filter("dst IS NOT NULL").select(F.col("src").alias("file"), "module", "dst")
    return sites.join(refs, ["file", "line"]).join(called, ["file", "local"]).join(dst, ["file", "module"]).select(F.col("file").alias("parent"), F.col("dst").alias("router"), "prefix").distinct()
