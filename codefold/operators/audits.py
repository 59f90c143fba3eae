"""Audits: entry points, dead code, missing await, diffs, plans and checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codefold.functions.text import identifier_pattern, is_test_path

JS = ("javascript", "typescript", "tsx", "html")
_VERBS = "get|post|put|delete|patch"


def _any(words: str, start: str = "^", end: str = "$") -> str:
    return f"{start}({'|'.join(words.split())}){end}"


#: Annotations (lower-cased) and hooks of the rules below. Fixed values.
SPRING_MAPPING = "getmapping postmapping putmapping deletemapping patchmapping requestmapping"
SPRING_DI = (
    "bean component service controller repository configuration restcontroller restcontrolleradvice controlleradvice springbootapplication springbootconfiguration "
    "enableautoconfiguration componentscan conditional(on\\w+)? profile primary qualifier autowired inject value scope lazy order dependson import importresource propertysource"
)
SPRING_MVC = "initbinder modelattribute exceptionhandler sessionattributes requestbody responsebody responsestatus crossorigin pathvariable requestparam requestheader requestattribute cookievalue matrixvariable validated valid validator"
JPA = (
    "entity mappedsuperclass embeddable embedded table secondarytable column id generatedvalue sequencegenerator tablegenerator version enumerated temporal lob basic transient access "
    "onetomany manytoone onetoone manytomany joincolumn joincolumns jointable orderby orderColumn inheritance discriminatorcolumn discriminatorvalue namedquery namedqueries namednativequery "
    "sqlresultsetmapping fieldresultsetmapping attributeoverride attributeoverrides associationoverride cacheable maptkey mapkeyenumerated mapkeycolumn maptemporal elementcollection collectiontable converter convert cascade"
)
SPRING_TX = "transactional cacheable cacheevict cacheput caching enabletransactionmanagement enablecaching enableasync enablescheduling enableaspectjautoproxy"
JAX = (
    "path produces consumes provider webservice webmethod webparam webresult xmlrootelement xmlelement xmlattribute xmlaccessortype xmltype xmltransient "
    "xmlid xmlidref xmlschematype xmlseealso xmlanyelement xmlanyattribute"
)
JUNIT = (
    "test parameterizedtest repeatedtest testfactory testtemplate beforeall beforeeach afterall aftereach nested disabled enabled enabledon\\w* disabledon\\w* tag displayname "
    "extendwith registerextension testmethodorder testinstance timeout csvsource valuesource methodsource enumsource argumentssource csvfilesource"
)
SPRING_TEST = (
    "springboottest webmvctest datajpatest datamongotest dataredistest datacassandratest jsontest jdbctest jooqtest webfluxtest restclienttest graphqltest autoconfiguremockmvc autoconfiguredatajpa "
    "autoconfigurewebmvc mockbean spybean mockitobean spymockitobean sqlgroup sql testpropertysource activeprofiles dirtiescontext recordapplicationevents contextconfiguration "
    "webappconfiguration importautoconfiguration bootstrapwith testexecutionlisteners transactionalconfiguration repeatedtests"
)
COBRA = "Run RunE PreRun PreRunE PostRun PostRunE PersistentPreRun PersistentPreRunE PersistentPostRun PersistentPostRunE"
FLASK_HOOKS = "before_request after_request teardown_request before_app_request after_app_request teardown_app_request context_processor url_value_preprocessor url_defaults errorhandler"
#: Entry-point rules: id, languages, type, framework, detection, pattern, second pattern, needed import. Fixed values.
RULES = [
    ("express-route", JS, "http", "express", "callPattern", "(?i)^(app|router|server)$", f"^({_VERBS}|all|use|options|head)$", None),
    ("fastify-route", JS, "http", "fastify", "callPattern", "(?i)^fastify$", f"^({_VERBS}|all|use|options|head|route)$", None),
    ("koa-route", JS, "http", "koa", "callPattern", "(?i)^(koaRouter|koa)$", f"^({_VERBS}|all|use|options|head)$", None),
    ("nestjs-handler", JS, "http", "nestjs", "decorator", "^(Get|Post|Put|Delete|Patch|Options|Head|All|Controller|Injectable|Module)$", None, None),
    ("flask-route", ("python",), "http", "flask", "decorator", f"^(app|bp|blueprint)\\.(route|{_VERBS})", None, None),
    ("fastapi-route", ("python",), "http", "fastapi", "decorator", f"^(app|router)\\.({_VERBS}|options|head)", None, None),
    ("django-view", ("python",), "http", "django", "decorator", "^(api_view|action|permission_classes|login_required|csrf_exempt)", None, None),
    ("spring-mapping", ("java",), "http", "spring", "modifier", _any(SPRING_MAPPING), None, None),
    ("gin-route", ("go",), "http", "gin", "callPattern", r"(?i)^(router|r|g|group|engine|api|v\d+)$", "^(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|Any|Handle)$", None),
    ("go-http", ("go",), "http", "net/http", "callPattern", "(?i)^(http|mux|serveMux)$", "^(HandleFunc|Handle)$", None),
    ("actix-main", ("rust",), "runtime", "actix", "modifier", "^actix_web::main$", None, None),
    ("actix-test", ("rust",), "test", "actix", "modifier", "^actix_web::test$", None, None),
    ("actix-route", ("rust",), "http", "actix", "modifier", f"^({_VERBS})$", None, None),
    ("aspnet-controller-route", ("csharp",), "http", "aspnet", "decorator", "^(ApiController|Route|Http(Get|Post|Put|Delete|Patch|Head|Options)|AcceptVerbs)$", None, None),
    ("azure-function", ("csharp",), "http", "azure-functions", "decorator", "^(FunctionName|Function|HttpTrigger)$", None, None),
    ("aspnet-minimal-route", ("csharp",), "http", "aspnet-minimal", "callPattern", "(?i)^(app|endpoints|routes)$", "^Map(Get|Post|Put|Delete|Patch|Methods|Fallback)$", None),
    ("spring-di", ("java",), "di", "spring", "modifier", _any(SPRING_DI), None, None),
    ("spring-mvc-method", ("java",), "http", "spring-mvc", "modifier", _any(SPRING_MVC), None, None),
    ("jpa-entity", ("java",), "di", "jpa", "modifier", _any(JPA), None, None),
    ("spring-data-query", ("java",), "di", "spring-data", "modifier", "^(query|modifying|procedure|namedquery|param|lock|querytype|entitygraph|projection)$", None, None),
    ("spring-tx", ("java",), "di", "spring", "modifier", _any(SPRING_TX), None, None),
    ("jax-binding", ("java",), "http", "jax-rs", "modifier", _any(JAX), None, None),
    ("spring-jobs", ("java",), "jobs", "spring", "modifier", "^(scheduled|eventlistener|async)$", None, None),
    ("celery-task", ("python",), "jobs", "celery", "decorator", r"^(?:[A-Za-z_]\w*\.)?task(?!\w)|^shared_task(?!\w)", None, r"^celery(?!\w)"),
    ("pytest-fixture", ("python",), "test", "pytest", "decorator", r"^pytest\.fixture", None, None),
    ("pytest-test", ("python",), "test", "pytest", "namePattern", "^(test_|pytest_)", None, None),
    ("c-family-test", ("c", "cpp"), "test", "native-test", "namePattern", "^(test_|Test|TEST_)", None, None),
    ("tokio-main", ("rust",), "runtime", "tokio", "modifier", "^tokio::main$", None, None),
    ("go-main", ("go",), "runtime", "go", "namePattern", "^main$", "free", None),
    ("go-init", ("go",), "runtime", "go", "namePattern", "^init$", "free", None),
    ("go-test", ("go",), "test", "go", "namePattern", "^(Test|Benchmark|Example|Fuzz)[A-Z_]", None, None),
    ("java-main", ("java",), "runtime", "java", "namePattern", "^main$", "static", None),
    ("java-junit-test", ("java",), "test", "junit", "modifier", _any(JUNIT), None, None),
    ("spring-boot-test", ("java",), "test", "spring-boot-test", "modifier", _any(SPRING_TEST), None, None),
    ("spring-http-mapping", ("java",), "http", "spring", "modifier", _any(SPRING_MAPPING), None, None),
    ("rust-main", ("rust",), "runtime", "rust", "namePattern", "^main$", "free", None),
    ("rust-test-attr", ("rust",), "test", "rust", "modifier", r"^(test|tokio::test|cfg\(test\))$", None, None),
    ("c-family-main", ("c", "cpp"), "runtime", "native", "namePattern", "^(main|WinMain|wWinMain|DllMain)$", "free", None),
    ("csharp-main", ("csharp",), "runtime", "dotnet", "namePattern", "^Main$", "static", None),
    ("csharp-test", ("csharp",), "test", "dotnet-test", "decorator", "^(Fact|Theory|Test|TestMethod|TestCase|TestCaseSource|SetUp|OneTimeSetUp)$", None, None),
    ("cobra-command", ("go",), "cli", "cobra", "compositePattern", r"^cobra\.Command$", _any(COBRA), None),
    ("js-cli-main", JS, "runtime", "node", "filePath", r"(^|/)bin/[^/]+\.(js|ts|mjs|cjs)$|(^|/)(main|cli|server)\.(js|ts|mjs|cjs)$", None, None),
    ("js-shebang-main", JS, "runtime", "node", "shebang", r"^#![^\n]*node(?!\w)", None, None),
    ("js-test-file", JS, "test", "jest", "filePath", r"(^|/)(__tests__|tests?)/|\.(test|spec)\.(js|ts|jsx|tsx|mjs|cjs)$", None, None),
    ("next-page", JS, "runtime", "next", "filePath", r"(^|/)(pages|app)/.*\.(js|ts|jsx|tsx|mjs|cjs)$", None, None),
    ("python-main-module", ("python",), "runtime", "python", "filePath", r"(^|/)__main__\.py$", None, None),
    ("django-command", ("python",), "cli", "django", "filePath", r"(^|/)management/commands/[^/]+\.py$", None, None),
    ("flask-event-hook", ("python",), "events", "flask", "decorator", _any(FLASK_HOOKS, r"^(app|bp|blueprint)\.", ""), None, None),
    ("click-command", ("python",), "cli", "click", "decorator", r"^(click\.)?(command|group)|^[A-Za-z_]\w*\.(command|group)$", None, None),
]


#: Imports that prefer a rule where several match a symbol. Fixed values.
SIGNALS = {"flask-route": r"^flask(?!\w)", "fastapi-route": r"^fastapi(?!\w)", "flask-event-hook": r"^flask(?!\w)"}


def rules_table(spark: SparkSession) -> DataFrame:
    """The fixed rules as a table: rule, language, type, framework, detection, patterns, place. Its size does not depend on data."""
    rows = [(i, lang, t, f, d, p, q, m, SIGNALS.get(i), k) for k, (i, langs, t, f, d, p, q, m) in enumerate(RULES) for lang in langs]
    return spark.createDataFrame(rows, "rule string, language string, type string, framework string, detection string, pattern string, pattern2 string, needs string, signal string, place int")


def entry_points(symbols: DataFrame, calls: DataFrame, files: DataFrame, imports: DataFrame, rules: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Symbols and files that something outside calls: ``symbol_id, name, file, line, rule, type, framework, confidence``, the surest rule for each.

    ``calls`` with a ``shape`` like ``pkg.Type{Field}`` are functions given to a
    composite literal's field; ``lines`` (``file, line, text``) show shebangs.
    """
    rule = F.broadcast(rules)
    modules = imports.groupBy("file").agg(F.collect_set("module").alias("modules"))
    own = symbols.join(modules, "file", "left")
    tagged = own.join(rule.filter("detection in ('decorator', 'modifier')"), "language")
    hit = F.when(F.col("detection") == "decorator", F.expr("exists(coalesce(decorators, array()), d -> d rlike pattern)")).otherwise(F.expr("exists(coalesce(modifiers, array()), m -> lower(m) rlike pattern OR m rlike pattern)"))
    tagged = tagged.filter(hit & (F.col("needs").isNull() | F.expr("exists(coalesce(modules, array()), m -> m rlike needs)"))).withColumn("confidence", F.lit(0.95)).withColumn("backed", F.expr("coalesce(exists(modules, m -> m rlike signal), false)"))
    named = own.filter("family = 'callable'").join(rule.filter("detection = 'namePattern'"), "language")
    free = F.col("owner").isNull() & F.col("receiver").isNull()
    named = named.filter(F.expr("name rlike pattern") & (F.col("pattern2").isNull() | ((F.col("pattern2") == "free") & free) | ((F.col("pattern2") == "static") & F.expr("array_contains(modifiers, 'static')")))).withColumns({"confidence": F.lit(1.0), "backed": F.lit(False)})
    columns = ["symbol_id", "name", "file", F.col("start_line").alias("line"), "rule", "type", "framework", "confidence", "place", "backed"]
    found = tagged.select(*columns).unionByName(named.select(*columns))
    # a handler named on the line of a route call with a literal path
    routed = calls.filter("is_method AND first_string_arg IS NOT NULL").join(files.select("file", "language"), "file").join(rule.filter("detection = 'callPattern'"), "language").filter(F.expr("receiver rlike pattern AND name rlike pattern2"))
    handlers = calls.filter("is_function_ref").select("file", "line", F.col("name").alias("handler"))
    given = routed.select("file", "line", "rule", "type", "framework", "place").join(handlers, ["file", "line"])
    if "shape" in calls.columns:
        fields = calls.filter(F.col("is_function_ref") & F.col("shape").rlike(r"^[\w.]+\{\w+\}$")).join(files.select("file", "language"), "file").join(rule.filter("detection = 'compositePattern'"), "language")
        fields = fields.filter(F.expr(r"regexp_extract(shape, '^([^{]*)', 1) rlike pattern AND regexp_extract(shape, '[{](\\w+)[}]$', 1) rlike pattern2"))
        given = given.unionByName(fields.select("file", "line", "rule", "type", "framework", "place", F.col("name").alias("handler")))
    handled = given.join(symbols.select("symbol_id", F.col("name").alias("handler"), F.col("file").alias("def_file"), "start_line"), "handler")
    best = F.min(F.struct((F.col("def_file") != F.col("file")).alias("other"), "def_file", "start_line", "symbol_id"))
    handled = handled.groupBy("handler", "file", "line", "rule", "type", "framework", "place").agg(best.alias("b")).select(F.col("b.symbol_id").alias("symbol_id"), F.col("handler").alias("name"), F.col("b.def_file").alias("file"), F.col("b.start_line").alias("line"), "rule", "type", "framework", F.lit(0.9).alias("confidence"), "place", F.lit(False).alias("backed"))
    paths = files.join(rule.filter("detection = 'filePath'"), "language").filter(F.expr("rel rlike pattern")).select(F.lit(None).cast("string").alias("symbol_id"), F.col("rel").alias("name"), "file", F.lit(1).alias("line"), "rule", "type", "framework", F.lit(0.9).alias("confidence"), "place", F.lit(False).alias("backed"))
    every = found.unionByName(handled).unionByName(paths)
    if lines is not None:
        first = lines.filter("line = 1 AND text LIKE '#!%'").select("file", "text").join(files.select("file", "rel", "language"), "file").join(rule.filter("detection = 'shebang'"), "language").filter(F.expr("text rlike pattern"))
        every = every.unionByName(first.select(F.lit(None).cast("string").alias("symbol_id"), F.col("rel").alias("name"), "file", F.lit(1).alias("line"), "rule", "type", "framework", F.lit(0.95).alias("confidence"), "place", F.lit(False).alias("backed")))
    order = F.min(F.struct((-F.col("confidence")).alias("worse"), (~F.col("backed")).alias("bare"), "place", "rule", "type", "framework"))
    return every.groupBy("symbol_id", "name", "file", "line").agg(order.alias("b")).select("symbol_id", "name", "file", "line", F.col("b.rule").alias("rule"), F.col("b.type").alias("type"), F.col("b.framework").alias("framework"), (-F.col("b.worse")).alias("confidence"))


def token_table(lines: DataFrame, text: str = "masked") -> DataFrame:
    """``file, line, token``: identifiers of each line once, so a scan for very many names is an equi-join."""
    return lines.select("file", "line", F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit("[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0)))).alias("token"))


#: Decorators that register nothing.
QUIET = ("staticmethod", "classmethod", "property", "abstractmethod", "override", "Override", "functools.wraps", "cached_property", "dataclass", "overload")
#: Methods that Go's standard interfaces call, with their numbers of parameters. Fixed values.
GO_PROTOCOL = {
    "Len": 0, "Less": 2, "Swap": 2, "ServeHTTP": 2, "Error": 0, "String": 0, "Read": 1, "Write": 1, "Close": 0, "Seek": 2, "ReadAt": 2, "WriteAt": 2, "ReadByte": 0, "WriteByte": 1, "ReadRune": 0, "UnreadByte": 0, "UnreadRune": 0,
    "MarshalJSON": 0, "UnmarshalJSON": 1, "MarshalText": 0, "UnmarshalText": 1, "MarshalBinary": 0, "UnmarshalBinary": 1, "Scan": 1, "Value": 0, "LogValue": 0, "Unwrap": 0, "Is": 1, "As": 1,
}
#: Bases that call nothing of their children.
_ROOTS = ("object", "Object", "ABC", "Protocol", "Generic", "Enum")
#: Issues after which a file's text is known to nobody.
UNREAD = ("unreadable", "skipped")


def external_heritage(symbols: DataFrame, depth: int = 8) -> DataFrame:
    """``owner``: types with an ancestor, up to ``depth`` levels, that the index doesn't define."""
    types = symbols.filter("family = 'type'").select("name", F.explode("bases").alias("base"))
    pairs = types.select("name", F.regexp_extract(F.regexp_replace("base", "<.*$", ""), r"([A-Za-z_$][\w$]*)$", 1).alias("base")).filter((F.col("base") != "") & ~F.col("base").isin(*_ROOTS)).distinct()
    known = symbols.filter("family = 'type'").select(F.col("name").alias("base")).distinct()
    found = pairs.join(known, "base", "left_anti").select("name").distinct()
    for _ in range(max(1, depth).bit_length()):  # each round joins paths of twice the length
        found = found.union(pairs.join(found.select(F.col("name").alias("base")), "base", "left_semi").select("name")).distinct()
        pairs = pairs.union(pairs.join(pairs.select(F.col("name").alias("base"), F.col("base").alias("far")), "base").select("name", F.col("far").alias("base"))).distinct()
    return found.select(F.col("name").alias("owner"))


def dispatch_holders(lines: DataFrame, text: str = "masked") -> DataFrame:
    """``file, holder``: names whose members code picks at run time and calls: ``x[key](...)``, ``getattr(x, key)(...)``, or first into a variable."""
    holder = r"([A-Za-z_$][A-Za-z0-9_$]*)\[\s*[A-Za-z_$][^\]]*\]\s*\("
    direct = lines.select("file", F.explode(F.regexp_extract_all(F.col(text), F.lit(holder), F.lit(1))).alias("holder"))
    got = lines.select("file", F.explode(F.regexp_extract_all(F.col(text), F.lit(r"getattr\(\s*([A-Za-z_][A-Za-z0-9_.]*)\s*,\s*[A-Za-z_]"), F.lit(1))).alias("holder"))
    kept = r"([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*([A-Za-z_$][A-Za-z0-9_$]*)\[\s*[A-Za-z_$][^\]]*\]\s*;?\s*$"
    held = lines.select("file", F.regexp_extract(F.col(text), kept, 1).alias("local"), F.regexp_extract(F.col(text), kept, 2).alias("holder")).filter("local <> ''")
    used = lines.select("file", F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?<![A-Za-z0-9_$.])([A-Za-z_$][A-Za-z0-9_$]*)\("), F.lit(1))).alias("local")).distinct()
    return direct.unionByName(got).unionByName(held.join(used, ["file", "local"], "left_semi").select("file", "holder")).distinct()


def deadcode(symbols: DataFrame, edges: DataFrame, tokens: DataFrame, entries: DataFrame, issues: DataFrame, include_exported: bool = False, include_decorated: bool = False, include_tests: bool = False, gaps: DataFrame | None = None, holders: DataFrame | None = None) -> DataFrame:
    """Every callable and type with why it is kept, or ``candidate``: the first rule of the policy that holds.

    A file that nobody read withdraws all claims. A name that occurs as a token
    outside its own definitions is used, and so is one in ``gaps`` (``token``:
    those of readable files in languages without an adapter). Members of what
    code dispatches on at run time (``holders``: ``file, holder``), and methods
    whose type has an ancestor outside the index, or that a protocol calls, are
    kept unless ``include_exported``. Each rule's count is the report's.
    """
    audited = symbols.filter("family in ('callable', 'type')")
    own = edges.filter("tier <> 'excluded'").filter(F.col("enclosing_id").isNull() | (F.col("enclosing_id") != F.col("to_id")))
    called = own.select(F.col("to_id").alias("symbol_id")).distinct().withColumn("called", F.lit(True))
    unread = issues.filter(F.col("kind").isin(*UNREAD)).agg((F.count("*") > 0).alias("withdrawn"))
    spans = audited.select("symbol_id", F.col("name").alias("token"), "file", "start_line", "end_line")
    names = audited.select(F.col("name").alias("token"), "file", F.coalesce("name_line", "start_line").alias("line")).distinct()
    # a mention is an occurrence off the name's definition lines; used, if there are more than inside the symbol itself.
    # Counts meet by name, and only a file's own occurrences meet its spans, so a common name multiplies nothing.
    mentions = tokens.join(names.select("token").distinct(), "token", "left_semi").join(names, ["token", "file", "line"], "left_anti")
    total = mentions.groupBy("token").agg(F.count("*").alias("everywhere"))
    inside = mentions.join(spans, ["token", "file"]).filter(F.col("line").between(F.col("start_line"), F.col("end_line"))).groupBy("symbol_id").agg(F.count("*").alias("inside"))
    used = spans.select("symbol_id", "token").join(total, "token").join(inside, "symbol_id", "left").filter(F.col("everywhere") > F.coalesce("inside", F.lit(0))).select("symbol_id").withColumn("mentioned", F.lit(True))
    live_owner = symbols.filter("owner IS NOT NULL").join(called, "symbol_id").select(F.col("owner").alias("name"), "file").distinct().withColumn("live_member", F.lit(True))
    made = symbols.filter("family = 'type'").join(called, "symbol_id").select(F.col("name").alias("owner"), "file").distinct().withColumn("made", F.lit(True))
    starts = entries.filter("symbol_id IS NOT NULL").select("symbol_id").distinct().withColumn("entry", F.lit(True))
    rows = audited.join(called, "symbol_id", "left").join(used, "symbol_id", "left").join(starts, "symbol_id", "left").join(live_owner, ["name", "file"], "left").join(made, ["owner", "file"], "left")
    rows = rows.join(external_heritage(symbols).withColumn("external", F.lit(True)), "owner", "left").crossJoin(F.broadcast(unread))
    none = F.lit(None).cast("boolean")
    rows = rows.join(gaps.select(F.col("token").alias("name")).distinct().withColumn("elsewhere", F.lit(True)), "name", "left") if gaps is not None else rows.withColumn("elsewhere", none)
    rows = rows.join(holders.select("file", F.col("holder").alias("owner")).distinct().withColumn("picked", F.lit(True)), ["file", "owner"], "left") if holders is not None else rows.withColumn("picked", none)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    decorated = F.exists(F.coalesce("decorators", F.array().cast("array<string>")), lambda d: ~d.isin(*QUIET))
    sizes = F.create_map(*(F.lit(x) for pair in GO_PROTOCOL.items() for x in pair))
    protocol = (F.col("language") == "go") & F.col("owner").isNotNull() & F.coalesce(F.col("params_structured").isNull() & F.col("name").isin(*GO_PROTOCOL) | (F.try_element_at(sizes, F.col("name")) == F.size("params_structured")), F.lit(False))
    verdict = (
        F.when(F.col("withdrawn"), "withdrawn")
        .when(yes("elsewhere"), "unsupported-mention")
        .when(F.lit(not include_tests) & (is_test_path(F.col("rel")) | (F.coalesce("entry_kind", F.lit("")) == "test")), "test")
        .when(yes("entry") | F.col("entry_kind").isNotNull(), "entry-point")
        .when(F.lit(not include_decorated) & decorated, "decorated")
        .when(F.lit(not include_exported) & yes("is_exported"), "exported")
        .when(yes("called"), "called")
        .when((F.col("kind") == "constructor") & yes("made"), "constructor")
        .when(yes("live_member"), "live-member")
        .when(yes("mentioned"), "mentioned")
        .when(yes("picked"), "dynamic-dispatch")
        .when(F.lit(not include_exported) & (F.col("family") == "callable") & (yes("external") | protocol), "external-contract")
        .otherwise("candidate")
    )
    return rows.select("symbol_id", "name", "kind", "rel", "start_line", "end_line", verdict.alias("verdict"))


def missing_awaits(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls in an async function to an async one, neither awaited nor otherwise handled; a file's own definition wins, else all must be async."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    own = symbols.filter("family = 'callable'")
    local = own.groupBy("file", "name").agg(F.min(yes("is_async")).alias("local_async"))
    every = own.groupBy("name").agg(F.min(yes("is_async")).alias("all_async"))
    inside = own.filter(yes("is_async")).select("file", F.col("name").alias("enclosing_name"), F.col("start_line").alias("enclosing_start"))
    sites = calls.filter(~yes("awaited") & ~yes("handled") & F.col("assigned_to").isNull() & ~yes("is_function_ref"))
    found = sites.join(inside, ["file", "enclosing_name", "enclosing_start"], "left_semi").join(local, ["file", "name"], "left").join(every, "name", "left")
    return found.filter(F.coalesce("local_async", "all_async", F.lit(False))).select("file", "line", "name", "enclosing_name")


_HUNK = r"@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"


def diff_lines(diffs: DataFrame, text: str = "diff") -> DataFrame:
    """Changed lines of zero-context unified diffs: ``file, side, line``; sides ``deleted`` and ``added``.

    ``diffs``: one row for each file's patch, ``file`` and the text.
    """
    hunks = diffs.select("file", F.explode(F.regexp_extract_all(F.col(text), F.lit(_HUNK), F.lit(0))).alias("h"))
    part = lambda k: F.regexp_extract("h", _HUNK, k)
    size = lambda k: F.when(part(k) == "", 1).otherwise(part(k).cast("int"))
    sides = hunks.select("file", F.explode(F.array(F.struct(F.lit("deleted").alias("side"), part(1).cast("int").alias("first"), size(2).alias("n")), F.struct(F.lit("added").alias("side"), part(3).cast("int").alias("first"), size(4).alias("n")))).alias("s")).select("file", "s.*")
    return sides.filter("n > 0").select("file", "side", F.explode(F.expr("sequence(first, first + n - 1)")).alias("line"))


def changed_symbols(changes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Symbols that a diff touches: ``rel, owner, name, change`` (changed, new, deleted). Identity is (file, owner, name), with overload counts."""
    keys = ["rel", "owner", "name"]
    base = lambda df, side: df.filter("family = 'callable'").join(changes.filter(F.col("side") == side).withColumnRenamed("file", "rel"), "rel").filter(F.col("line").between(F.col("start_line"), F.col("end_line"))).select("rel", F.coalesce("owner", F.lit("")).alias("owner"), "name").distinct()
    n = lambda df, c: df.filter("family = 'callable'").groupBy("rel", F.coalesce("owner", F.lit("")).alias("owner"), "name").agg(F.count("*").alias(c))
    touched = base(before, "deleted").unionByName(base(after, "added")).distinct()
    both = touched.join(n(before, "was"), keys, "left").join(n(after, "now"), keys, "left")
    was, now = F.coalesce("was", F.lit(0)), F.coalesce("now", F.lit(0))
    return both.select(*keys, F.when(was < now, "new").when(was > now, "deleted").otherwise("changed").alias("change"))


def diff_impact(changed: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Callers of changed symbols by tier; for deleted ones, the remaining sites of the name."""
    ids = symbols.select(F.col("symbol_id").alias("to_id"), "rel", F.coalesce("owner", F.lit("")).alias("owner"), "name")
    hit = changed.join(ids, ["rel", "owner", "name"], "left")
    by_id = hit.filter("change <> 'deleted'").join(edges.select("to_id", "call_id", "tier"), "to_id")
    by_name = hit.filter("change = 'deleted'").drop("to_id").join(edges.select(F.col("name"), "call_id").distinct().withColumn("tier", F.lit("unverified")), "name")
    return by_id.select("rel", "owner", "name", "change", "tier", "call_id").unionByName(by_name.select("rel", "owner", "name", "change", "tier", "call_id")).groupBy("rel", "owner", "name", "change", "tier").agg(F.countDistinct("call_id").alias("sites"))


def check(changed: DataFrame, sites: DataFrame, accounts: DataFrame | None = None, truncated: bool = False) -> DataFrame:
    """Findings for a change set: ``action, severity, n`` and the verdict of the worst.

    ``sites``: verified sites with ``tier, verdict, change``. ``accounts``: rows with ``unaccounted``.
    """
    one = lambda name, severity, n: F.struct(F.lit(name).alias("action"), F.lit(severity).alias("severity"), n.cast("long").alias("n"))
    sums = sites.agg(F.count_if(F.col("tier") == "unverified").alias("unverified"), F.count_if((F.col("verdict") == "mismatch") & (F.col("tier") == "confirmed")).alias("drift"))
    orphans = changed.filter("change = 'new'").join(sites.select("name").distinct(), "name", "left_anti").agg(F.count("*").alias("orphans"))
    gaps = accounts.agg(F.coalesce(F.sum("unaccounted"), F.lit(0)).alias("gaps")) if accounts is not None else changed.agg(F.lit(0).alias("gaps"))
    rows = sums.crossJoin(F.broadcast(orphans)).crossJoin(F.broadcast(gaps))
    found = rows.select(F.explode(F.array(one("incomplete_account", "error", F.col("gaps")), one("unverified_callers", "warn", F.col("unverified")), one("signature_drift", "warn", F.col("drift")), one("orphan_new", "warn", F.col("orphans")), one("truncated_change_set", "error", F.lit(int(truncated))))).alias("f")).select("f.*").filter("n > 0")
    return found


def verdict(findings: DataFrame) -> DataFrame:
    worst = F.max(F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warn", 1).otherwise(0))
    return findings.agg(F.coalesce(worst, F.lit(0)).alias("w")).select(F.element_at(F.array(F.lit("READY_FOR_TOOLCHAIN"), F.lit("REVIEW_REQUIRED"), F.lit("BLOCKED")), F.col("w") + 1).alias("verdict"))


_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*\Z")
#: Words that no language here takes as a name.
RESERVED = frozenset("if else for while return class def function import from as try except finally with yield await async var let const new delete switch case break continue default in is not and or lambda pass raise func type struct interface package fn pub mut impl use mod static void int public private protected".split())


def plan_rename(symbol: DataFrame, edges: DataFrame, imports: DataFrame, lines: DataFrame, old: str, new: str) -> DataFrame:
    """Edits that rename a symbol: ``file, line, what, before, after, needs_review``. A preview; nothing is written."""
    if not _NAME.match(new) or new in RESERVED:
        raise ValueError(f"not a usable name: {new}")
    at = symbol.select("file", F.coalesce("name_line", "start_line").alias("line"), F.lit("definition").alias("what"), F.lit(False).alias("needs_review"))
    sites = edges.join(symbol.select(F.col("symbol_id").alias("to_id")), "to_id", "left_semi").filter("tier <> 'excluded'").select("file", "line", F.lit("call").alias("what"), (F.col("tier") == "unverified").alias("needs_review"))
    named = imports.filter(F.array_contains("names", old)).select("file", "line", F.lit("import").alias("what"), F.lit(False).alias("needs_review"))
    every = at.unionByName(sites).unionByName(named).groupBy("file", "line").agg(F.min("what").alias("what"), F.min("needs_review").alias("needs_review"))
    return every.join(lines, ["file", "line"]).select("file", "line", "what", F.col("text").alias("before"), F.regexp_replace("text", identifier_pattern(old), new.replace("$", "\\$")).alias("after"), "needs_review")


def plan_parameter(symbol: DataFrame, edges: DataFrame, add: str | None = None, remove: str | None = None, default: str | None = None) -> DataFrame:
    """What adding or removing a parameter asks of each call: exactly one of ``add`` and ``remove``."""
    if (add is None) == (remove is None):
        raise ValueError("one operation at a time")
    sites = edges.join(symbol.select(F.col("symbol_id").alias("to_id"), "params_structured"), "to_id").filter("tier <> 'excluded'")
    if add is not None:
        action = F.lit("none" if default is not None else f"append argument for {add}")
    else:
        action = F.when(F.array_position(F.transform("params_structured", lambda p: p["name"]), remove) <= F.col("arg_count"), F.lit(f"drop argument for {remove}")).otherwise("none")
    return sites.select("file", "line", action.alias("action"), (F.col("tier") == "unverified").alias("needs_review"))


def side_effects(symbols: DataFrame, imports: DataFrame, code: DataFrame) -> DataFrame:
    """Effects that a symbol's code or its file's imports suggest: ``symbol_id, effects``."""
    #: Modules and calls of each effect.
    modules = {"fs": "^(node:)?(fs|fs/promises|path|os|io|shutil|pathlib|tempfile)$", "network": "^(node:)?(https?|net|axios|node-fetch|requests|httpx|urllib|urllib3|socket|aiohttp)", "process": "^(node:)?(child_process|subprocess|process|signal|multiprocessing)"}
    bodies = {"fs": r"\b(open|readFile|writeFile|unlink|mkdir|rename)\w*\s*\(", "network": r"\b(fetch|urlopen|request)\s*\(|\.(get|post|put|delete)\s*\(\s*[\"']https?:", "process": r"\b(spawn|exec|system|popen|fork)\w*\s*\(", "global_mutation": r"\bglobal\s+\w|\b(window|globalThis|process\.env)\.\w+\s*=[^=]"}
    text = symbols.select("symbol_id", "file").join(code.select("symbol_id", "code"), "symbol_id").join(imports.groupBy("file").agg(F.collect_set("module").alias("modules")), "file", "left")
    own = F.coalesce("modules", F.array().cast("array<string>"))
    found = [F.when(F.col("code").rlike(p), F.lit(k)) for k, p in bodies.items()]
    suggested = [F.when(F.exists(own, (lambda p: lambda m: m.rlike(p))(p)) & ~F.col("code").rlike(bodies[k]), F.lit(f"{k}?")) for k, p in modules.items()]
    return text.select("symbol_id", F.array_compact(F.array(*found, *suggested)).alias("effects"))
