"""Repository layout: cache folders, language counts, sizes. Reports only; nothing is deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PolicyConfig
from ..functions import globs
from .findings import finding

#: Files that prove a folder of a kind.
_JS = ["package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "bun.lock"]
_GRADLE = ["build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "gradlew", "gradlew.bat"]
_NUXT = ["nuxt.config.js", "nuxt.config.ts", "nuxt.config.mjs"]
_NEXT = ["next.config.js", "next.config.ts", "next.config.mjs", "next.config.cjs"]
#: Cache and build folders by name. A folder is one if any of the files stands beside it.
BESIDE = {
    "node_modules": _JS,
    "dist": [*_JS, "go.mod", "Cargo.toml"],
    "out": [*_NEXT, "package.json"],
    "build": ["package.json", "Cargo.toml", *_GRADLE, "pubspec.yaml", "wails.json", "CMakeLists.txt"],
    "target": ["Cargo.toml", "pom.xml", "build.sbt"],
    "vendor": ["go.mod", "Cargo.toml", "composer.json", "Gemfile", "package.json"],
    ".gradle": _GRADLE,
    ".next": [*_NEXT, "package.json"],
    ".nuxt": _NUXT,
    ".output": _NUXT,
    ".svelte-kit": ["svelte.config.js", "svelte.config.ts", "svelte.config.cjs"],
    ".yarn": ["yarn.lock", "package.json"],
    ".bun": ["bun.lockb", "bun.lock", "package.json"],
    "__pycache__": ["*.py", "pyproject.toml", "setup.py", "setup.cfg", "requirements.txt"],
    ".pytest_cache": ["pytest.ini", "pyproject.toml", "setup.cfg", "tox.ini", "requirements.txt", "conftest.py"],
    ".mypy_cache": ["mypy.ini", ".mypy.ini", "pyproject.toml", "setup.cfg"],
    ".ruff_cache": ["ruff.toml", "pyproject.toml"],
    ".turbo": ["turbo.json", "package.json"],
    ".parcel-cache": ["package.json"],
    ".tox": ["tox.ini", "setup.cfg", "pyproject.toml"],
    ".nox": ["noxfile.py"],
    ".embuild": ["sdkconfig.defaults", "sdkconfig", "idf_component.yml"],
    ".dart_tool": ["pubspec.yaml"],
}
#: Or if any of these stands in it (a folder with a slash).
INSIDE = {"build": ["CMakeCache.txt", "build.ninja"], ".venv": ["pyvenv.cfg"], ".embuild": ["espressif/"], ".dart_tool": ["package_config.json"]}
CACHE_DIRS = sorted({*BESIDE, *INSIDE})
#: Fixed value: the entry that makes a folder of any name a Python environment.
MARKER = "pyvenv.cfg"
#: Folders of version control, never entered.
VCS_DIRS = [".git", ".svn", ".hg", ".bzr"]
#: Languages by extension, for counts.
LANGUAGE_BY_EXT = {
    ".go": "Go",
    ".ts": "TypeScript/JavaScript", ".tsx": "TypeScript/JavaScript", ".js": "TypeScript/JavaScript", ".jsx": "TypeScript/JavaScript", ".mjs": "TypeScript/JavaScript", ".cjs": "TypeScript/JavaScript",
    ".py": "Python", ".java": "Java", ".kt": "Kotlin", ".kts": "Kotlin", ".rs": "Rust",
    ".c": "C/C++", ".cpp": "C/C++", ".cc": "C/C++", ".h": "C/C++", ".hpp": "C/C++",
    ".swift": "Swift", ".cs": "C#", ".rb": "Ruby", ".php": "PHP", ".yaml": "YAML", ".yml": "YAML", ".json": "JSON", ".xml": "XML", ".html": "HTML",
    ".css": "CSS", ".scss": "CSS", ".sh": "Shell", ".bash": "Shell", ".md": "Markdown",
}
#: Linter configurations by language, in order of priority.
LINT_CONFIGS = {
    "Go": [".golangci.yml", ".golangci.yaml", ".golangci.toml", ".golangci.json"],
    "TypeScript/JavaScript": [".eslintrc", ".eslintrc.json", ".eslintrc.yml", ".eslintrc.yaml", ".eslintrc.js", ".eslintrc.cjs", "eslint.config.js", "eslint.config.mjs", "eslint.config.cjs", "eslint.config.ts", "biome.json", "biome.jsonc", ".prettierrc", ".prettierrc.json", ".prettierrc.yml"],
    "Python": [".pylintrc", ".flake8", ".ruff.toml", "ruff.toml", "pyproject.toml", "setup.cfg", ".pyre_configuration"],
    "Java": ["checkstyle.xml", "pmd.xml", ".checkstyle", "spotbugs.xml"],
    "Kotlin": ["detekt.yml", "detekt.yaml", ".detekt.yml"],
    "Rust": ["rustfmt.toml", ".rustfmt.toml", "clippy.toml"],
    "C/C++": [".clang-format", ".clang-tidy"],
    "Swift": [".swiftlint.yml", ".swiftformat"],
    "C#": [".editorconfig", "omnisharp.json", "Directory.Build.props"],
}
PROJECT_FILES = ["package.json", "go.mod", "Cargo.toml", "pyproject.toml", "setup.py", "pom.xml", "build.gradle", "Gemfile", "composer.json", "Dockerfile", "Makefile"]


def ancestors(paths: DataFrame) -> DataFrame:
    """path, dir, depth, name of every folder above a path."""
    parts = F.split("path", "/")
    rows = paths.where(F.size(parts) > 1).select("path", parts.alias("p")).select("path", "p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("depth"))
    return rows.select("path", F.array_join(F.slice("p", F.lit(1), F.col("depth")), "/").alias("dir"), "depth", F.element_at("p", F.col("depth")).alias("name"))


def _parent(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, r"^(.*)/[^/]+$", 1), F.lit("")), F.lit("."))


def _above(paths: DataFrame, wanted: list[str]) -> DataFrame:
    """(dir, depth, name) of the folders of these names above the paths: no other folder is made a row."""
    p = F.split("path", "/")
    rows = paths.where(F.arrays_overlap(p, F.array(*[F.lit(w) for w in wanted]))).select(p.alias("p"))
    at = F.filter(F.sequence(F.lit(1), F.size("p")), lambda i: (i < F.size("p")) & F.element_at("p", i).isin(wanted))
    rows = rows.select("p", F.explode(at).alias("depth"))
    return rows.select(F.array_join(F.slice("p", F.lit(1), F.col("depth")), "/").alias("dir"), "depth", F.element_at("p", F.col("depth")).alias("name")).distinct()


def cache_dirs(paths: DataFrame) -> DataFrame:
    """(dir, name, depth): folders that a rule proves to be caches, judged by the known paths."""
    # one row a rule: the entry that must stand beside (or inside) a folder of the name
    rules = [(n, x, False) for n, xs in BESIDE.items() for x in xs] + [(n, x, True) for n, xs in INSIDE.items() for x in xs]
    asked = sorted({x for _, x, _ in rules})
    table = F.broadcast(paths.sparkSession.createDataFrame(rules, "name string, entry string, inside boolean"))
    base = globs.base(F.col("path"))
    kinds = F.array_compact(F.array(F.when(base.isin(asked), base), F.when(base.endswith(".py"), F.lit("*.py"))))
    files = paths.where(base.isin(asked) | base.endswith(".py")).select(_parent(F.col("path")).alias("at"), F.explode(kinds).alias("entry"))
    folders = _above(paths, [x[:-1] for x in asked if x.endswith("/")]).select(_parent(F.col("dir")).alias("at"), F.concat("name", F.lit("/")).alias("entry"))
    there = files.unionByName(folders).distinct()
    place = _above(paths, CACHE_DIRS).join(table, "name").withColumn("at", F.when(F.col("inside"), F.col("dir")).otherwise(_parent(F.col("dir"))))
    return place.join(there, ["at", "entry"], "left_semi").select("dir", "name", "depth").distinct()


def environments(paths: DataFrame) -> DataFrame:
    """(dir, name, depth): folders of any name with an entry ``pyvenv.cfg``."""
    p = F.split("path", "/")
    rows = paths.where(F.array_contains(p, MARKER)).select(p.alias("p"))
    at = F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda i: (i > 0) & (F.element_at("p", i + 1) == MARKER))
    rows = rows.select("p", F.explode(at).alias("depth"))
    return rows.select(F.array_join(F.slice("p", F.lit(1), F.col("depth")), "/").alias("dir"), F.element_at("p", F.col("depth")).alias("name"), "depth").distinct()


def verified(paths: DataFrame) -> DataFrame:
    """(dir, name, depth): proven cache folders and environments, wherever they lie."""
    return cache_dirs(paths).unionByName(environments(paths)).distinct()


def nearest_cache_dir(paths: DataFrame, caches: DataFrame) -> DataFrame:
    """(path, cache_dir): the deepest of ``caches(dir, name, depth)`` above a path."""
    met = ancestors(paths).join(caches.select("dir"), "dir")
    return met.groupBy("path").agg(F.max_by("dir", "depth").alias("cache_dir"))


def _closed(c: Column) -> Column:
    """A folder of this name is not entered."""
    return c.startswith(".") | c.isin([*CACHE_DIRS, *VCS_DIRS])


def walked(paths: DataFrame) -> DataFrame:
    """(dir, name, depth): cache folders and environments that a walk from the root comes to.

    The walk never enters version control, hidden folders, folders of a known cache name (proven or not) and
    environments; of those it reports the proven ones and environments. Names close a path by
    themselves, without a join; what the names leave open meets the environments above it.
    """
    p = F.split("dir", "/")
    marked = environments(paths)
    open_ = ~F.exists(F.slice(p, F.lit(1), F.size(p) - 1), _closed) & ~F.col("name").isin(VCS_DIRS)
    found = cache_dirs(paths).unionByName(marked).distinct().where(open_)
    above = ancestors(found.select(F.col("dir").alias("path"))).select(F.col("path").alias("dir"), F.col("dir").alias("up"))
    within = above.join(marked.select(F.col("dir").alias("up")), "up", "left_semi").select("dir")
    return found.join(within.distinct(), "dir", "left_anti")


def _under(paths: DataFrame, found: DataFrame) -> DataFrame:
    """``paths`` with the one folder of a walk that they lie in, if any: down to the first name that closes, no further."""
    p = F.split("path", "/")
    folders = F.slice(p, F.lit(1), F.size(p) - 1)
    # the walk reports no folder below the first one that its name closes
    first = F.aggregate(folders, F.struct(F.lit(0).alias("n"), F.lit(False).alias("shut")), lambda a, x: F.when(a["shut"], a).otherwise(F.struct((a["n"] + 1).alias("n"), _closed(x).alias("shut"))), lambda a: a["n"])
    rows = paths.where(F.size(p) > 1).select("*", p.alias("_p"), first.alias("_n"))
    rows = rows.withColumn("_d", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    rows = rows.withColumn("cache_dir", F.array_join(F.slice("_p", F.lit(1), F.col("_d")), "/"))
    return rows.join(found.select(F.col("dir").alias("cache_dir"), "name"), "cache_dir").drop("_p", "_n", "_d")


def staged_cache_dirs(files: DataFrame, paths: DataFrame, cfg: PolicyConfig) -> DataFrame:
    """One finding for each cache folder or environment with a changed file: the file that comes first (``seq``, else the path).

    A file counts for the nearest such folder above it; where that one's name is ignored, it counts for none.
    """
    rows = files.where("not is_deleted").where(~globs.matches_any(F.col("path"), cfg.global_ignore))
    seq = F.col("seq") if "seq" in files.columns else F.col("path")
    rows = rows.select("path", seq.alias("seq"))
    found = nearest_cache_dir(rows.select("path").distinct(), verified(paths))
    found = found.where(~globs.base(F.col("cache_dir")).isin(cfg.cache_dir_ignore)).join(rows, "path")
    one = found.groupBy("cache_dir").agg(F.min_by("path", "seq").alias("path"))
    return finding(one, "cache_dir", "cache_dir_staged", dir=F.col("cache_dir"))


def committed_cache_dirs(paths: DataFrame, cfg: PolicyConfig) -> DataFrame:
    """Cache folders and environments of the walk that hold tracked files, with how many."""
    tracked = paths.where("tracked") if "tracked" in paths.columns else paths
    found = walked(paths)
    found = found.where(~F.col("name").isin(cfg.cache_dir_ignore)).where(~globs.matches_any(F.col("dir"), cfg.global_ignore))
    counts = _under(tracked.select("path"), found).groupBy("cache_dir").agg(F.count("*").alias("n"))
    return finding(counts, "cache_dir", "cache_dir_committed", path="cache_dir", files=F.col("n"))


def format_bytes(n: Column) -> Column:
    out = F.when(n < 1024, F.format_string("%d B", n.cast("long")))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        # exact halves go to the even digit
        scaled = F.concat(F.call_function("format_number", n / float(1024**i), F.lit("0.0")), F.lit(f" {unit}"))
        out = out.when(n < 1024 ** (i + 1), scaled) if i < 4 else out.otherwise(scaled)
    return out


def cache_sizes(paths: DataFrame) -> DataFrame:
    """``paths(path, size, tracked)``: the walk's cache folders and environments with size, tracked and untracked files, largest first."""
    in_dir = _under(paths.select("path", "size", "tracked"), walked(paths))
    out = in_dir.groupBy("cache_dir").agg(F.sum("size").alias("size"), F.sum(F.col("tracked").cast("long")).alias("tracked_files"), F.sum((~F.col("tracked")).cast("long")).alias("untracked_files"))
    return out.withColumn("shown", format_bytes(F.col("size"))).orderBy(F.desc("size"), "cache_dir")


def language_counts(paths: DataFrame) -> DataFrame:
    """language, n_files; the most frequent first."""
    pairs = [F.lit(x) for kv in LANGUAGE_BY_EXT.items() for x in kv]
    lang = F.try_element_at(F.create_map(*pairs), globs.ext_of(F.col("path")))
    return paths.select(lang.alias("language")).where("language is not null").groupBy("language").agg(F.count("*").alias("n_files")).orderBy(F.desc("n_files"), "language")


def lint_configs(paths: DataFrame) -> DataFrame:
    """language, config: each language's first linter configuration in the root."""
    rows = [(tool, name, i) for tool, names in LINT_CONFIGS.items() for i, name in enumerate(names)]
    table = F.broadcast(paths.sparkSession.createDataFrame(rows, "language string, path string, priority int"))
    return paths.select("path").distinct().join(table, "path").groupBy("language").agg(F.min_by("path", "priority").alias("config"))


def project_files(paths: DataFrame) -> DataFrame:
    return paths.where(F.col("path").isin(PROJECT_FILES)).select("path").distinct()


def data_files(paths: DataFrame) -> DataFrame:
    """kind, n_files of the data formats that can be linted."""
    kind = F.regexp_replace(F.ltrim(globs.ext_of(F.col("path")), F.lit(".")), "^yml$", "yaml")
    return paths.select(kind.alias("kind")).where(F.col("kind").isin("yaml", "json", "jsonc", "xml", "toml")).groupBy("kind").agg(F.count("*").alias("n_files"))
