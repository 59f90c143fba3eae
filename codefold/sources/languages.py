"""Languages: extensions, test names and behaviour as data."""

from __future__ import annotations

#: Extension to language.
EXTENSIONS = {
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx", ".py": "python", ".pyi": "python", ".go": "go", ".rs": "rust", ".java": "java",
    ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".cs": "csharp", ".html": "html", ".htm": "html",
}
#: Source that no adapter reads.
UNSUPPORTED = {".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".lua": "lua", ".pl": "perl", ".r": "r", ".jl": "julia", ".dart": "dart", ".ex": "elixir", ".exs": "elixir", ".erl": "erlang", ".hs": "haskell", ".clj": "clojure", ".ml": "ocaml", ".fs": "fsharp", ".vb": "visualbasic", ".sh": "shell", ".bash": "shell", ".ps1": "powershell", ".sql": "sql", ".vue": "vue", ".svelte": "svelte", ".zig": "zig", ".nim": "nim", ".m": "objective-c", ".mm": "objective-c++", ".groovy": "groovy", ".sol": "solidity"}
MARKERS = (".git", "package.json", "pyproject.toml", "setup.py", "go.mod", "Cargo.toml", "pom.xml", "build.gradle", "CMakeLists.txt", "Makefile", "tsconfig.json", "composer.json", ".hg")
IGNORED = ("node_modules", ".git", "dist", "build", "out", "target", "vendor", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", "coverage", ".next", ".nuxt", ".idea", ".vscode", "bower_components", ".cache", "obj")

#: Behaviour of each language that operators branch on.
TRAITS = [
    ("javascript", False, "module", False, False), ("typescript", True, "module", False, False), ("tsx", True, "module", False, False), ("html", False, "module", False, False),
    ("python", False, "module", True, False), ("go", True, "directory", False, False), ("rust", True, "module", False, False), ("java", True, "package", False, True), ("c", True, "include", False, False), ("cpp", True, "include", False, True), ("csharp", True, "namespace", True, True),
]
TRAITS_SCHEMA = "language string, typed boolean, package_scope string, keyword_arguments boolean, arity_overloads boolean"


def language_of(path: str) -> str | None:
    dot = path.rfind(".")
    return EXTENSIONS.get(path[dot:].lower()) if dot > path.rfind("/") else None


def test_names(rel: str) -> list[str]:
    """Names that a test of this file usually has."""
    folder, _, base = rel.rpartition("/")
    stem, _, ext = base.rpartition(".")
    at = f"{folder}/" if folder else ""
    language = language_of(rel)
    if language == "python":
        return [f"{at}test_{base}", f"{at}{stem}_test.py", f"{at}tests/test_{base}", f"tests/test_{base}"]
    if language == "go":
        return [f"{at}{stem}_test.go"]
    if language in ("java", "csharp"):
        return [f"{at}{stem}Test.{ext}", f"{at}{stem}Tests.{ext}", rel.replace("/main/", "/test/").replace(base, f"{stem}Test.{ext}")]
    if language == "rust":
        return [f"{at}{stem}_test.rs", f"tests/{base}"]
    return [f"{at}{stem}.test.{ext}", f"{at}{stem}.spec.{ext}", f"{at}__tests__/{stem}.test.{ext}", f"test/{stem}.test.{ext}", f"tests/{stem}.test.{ext}"]
