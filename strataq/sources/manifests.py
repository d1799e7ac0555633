"""Manifest discovery and readers.

A source of manifests is a DataFrame (path, text), such as
``spark.read.text(dir, wholetext=True, recursiveFileLookup=True)`` with
``input_file_name()``. Readers give (path, dep_seq, name, version, ecosystem,
direct); malformed manifests give no row and are reported by ``invalid``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataq.functions import dims, text


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of all files below a folder."""
    return spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def discover(paths: DataFrame, path_col: str = "path", *keys: str) -> DataFrame:
    """Distinct paths of manifests, outside directories that are never entered
    (dot directories among them)."""
    inner = F.slice(F.split(path_col, "/"), 1, F.size(F.split(path_col, "/")) - 1)
    skipped = F.exists(inner, lambda d: d.isin(dims.SKIP_DIRS) | (d.startswith(".") & ~d.isin(".", "..")))
    return paths.where(base_name(F.col(path_col)).isin(dims.MANIFEST_NAMES) & (base_name(F.col(path_col)) != "go.work") & ~skipped).select(*keys, path_col).distinct()


def preferred(paths: DataFrame, *keys: str) -> DataFrame:
    """The manifest of each folder that comes first in the order of preference."""
    place = F.array_position(F.array(*map(F.lit, dims.MANIFEST_PRIORITY)), base_name(F.col("path")))
    return paths.withColumn("_p", place).where("_p > 0").groupBy(*keys, folder(F.col("path")).alias("folder")).agg(F.min_by("path", "_p").alias("path"))


def ecosystem_of(path: Column) -> Column:
    return text.first_match(lambda n: F.lower(base_name(path)) == n, dims.MANIFEST_ECOSYSTEM.items())


def is_valid(path: Column, content: Column) -> Column:
    """Not empty, and of the shape its name promises."""
    name = base_name(path)
    json = F.coalesce(F.schema_of_variant(F.try_parse_json(content)).startswith("OBJECT"), F.lit(False))
    return (F.length(F.trim(content)) > 0) & F.when(name == "package.json", json).when(name == "go.mod", content.contains("module ")).when(name == "pom.xml", content.contains("<project")).otherwise(True)


def invalid(files: DataFrame) -> DataFrame:
    return files.where(~F.coalesce(is_valid(F.col("path"), F.col("text")), F.lit(False))).select("path")


def lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("ln", "line"))


def go_mod(files: DataFrame) -> DataFrame:
    """require lines, single or in blocks. Once a block has an indirect entry, all
    later entries of that block are indirect too. A file is one window, as large
    as one record."""
    rows = lines(files).withColumn("line", F.regexp_replace("line", r"^\s+|(?<!\s)\s+$", "")).where("line <> '' and line not like '//%'")
    w = Window.partitionBy("path").orderBy("ln")
    mark = F.when(F.col("line").rlike(r"^require\s*\("), 1).when(F.col("line").startswith(")"), 0)
    rows = rows.withColumn("_mark", mark)
    rows = rows.withColumn("_in", F.coalesce(F.last("_mark", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("_block", F.count("_mark").over(w))
    single = r"^require\s+(\S+)\s+(\S+)"
    rows = rows.withColumn("_single", F.col("line").rlike(single) & F.col("_mark").isNull())
    entry = r"^(\S+)\s+(\S+)"
    rows = rows.withColumn("_indirect", F.col("line").contains("// indirect"))
    sticky = F.max("_indirect").over(Window.partitionBy("path", "_block").orderBy("ln"))
    rows = rows.withColumn("_sticky", sticky).where(F.col("_single") | ((F.col("_in") == 1) & F.col("_mark").isNull() & F.col("line").rlike(entry)))
    name = F.when(F.col("_single"), F.regexp_extract("line", single, 1)).otherwise(F.regexp_extract("line", entry, 1))
    version = F.when(F.col("_single"), F.regexp_extract("line", single, 2)).otherwise(F.regexp_extract("line", entry, 2))
    out = rows.select("path", F.col("ln").cast("bigint").alias("dep_seq"), name.alias("name"), text.go_version(version).alias("version"), F.lit("go").alias("ecosystem"), F.when(F.col("_single"), ~F.col("_indirect")).otherwise(~F.col("_sticky")).alias("direct"))
    return out.where(~F.col("name").isin("module", "go", "toolchain"))


def package_json(files: DataFrame) -> DataFrame:
    """Dependencies of the four maps, in this order, all direct, none merged."""
    kinds = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
    parsed = files.select("path", F.from_json("text", ", ".join(f"{k} map<string,string>" for k in kinds)).alias("j"))
    maps = F.array(*[F.coalesce(F.map_entries(f"j.{k}"), F.map_entries(F.create_map().cast("map<string,string>"))) for k in kinds])
    rows = parsed.select("path", F.posexplode(F.flatten(maps)).alias("dep_seq", "e"))
    return rows.select("path", F.col("dep_seq").cast("bigint").alias("dep_seq"), F.col("e.key").alias("name"), text.npm_version(F.col("e.value")).alias("version"), F.lit("npm").alias("ecosystem"), F.lit(True).alias("direct"))


def requirements(files: DataFrame) -> DataFrame:
    """One dependency per requirement line; other formats that go through this
    reader are read the same way."""
    name, version = text.requirement_line(F.col("line"))
    return lines(files).select("path", F.col("ln").cast("bigint").alias("dep_seq"), name.alias("name"), version.alias("version"), F.lit("pypi").alias("ecosystem"), F.lit(True).alias("direct")).where("name is not null")


def resolve_properties(value: Column, props: Column) -> Column:
    """${name} replaced from the map, with dots as hyphens as a second try; once,
    so values that hold ${..} stay as they are, as do unknown names."""
    parts = F.regexp_extract_all(value, F.lit(r"(\$\{[^}]+\}|[^$]+|\$)"), 1)

    def fill(t: Column) -> Column:
        key = F.regexp_extract(t, r"^\$\{([^}]+)\}$", 1)
        return F.when(key != "", F.coalesce(F.try_element_at(props, key), F.try_element_at(props, F.translate(key, ".", "-")), t)).otherwise(t)

    return F.array_join(F.transform(parts, fill), "")


POM = "version string, groupId string, artifactId string, parent struct<version: string, groupId: string>, properties map<string,string>, dependencies struct<dependency: array<struct<groupId: string, artifactId: string, version: string, scope: string>>>"


def pom_xml(files: DataFrame) -> DataFrame:
    """Direct dependencies of the project element; test scope isn't direct."""
    parsed = files.where("text like '%<project%'").select("path", F.from_xml("text", POM).alias("p"))
    own = F.map_filter(F.map_from_arrays(F.array(F.lit("project.version"), F.lit("project.groupId"), F.lit("project.artifactId")), F.array(F.coalesce("p.version", "p.parent.version"), F.coalesce("p.groupId", "p.parent.groupId"), F.col("p.artifactId"))), lambda k, v: v.isNotNull())
    given = F.coalesce("p.properties", F.create_map().cast("map<string,string>"))
    props = F.map_concat(F.map_filter(given, lambda k, v: ~F.map_contains_key(own, k)), own)
    rows = parsed.select("path", props.alias("props"), F.posexplode("p.dependencies.dependency").alias("dep_seq", "d"))
    sub = lambda c: resolve_properties(F.coalesce(F.col(f"d.{c}"), F.lit("")), F.col("props"))
    return rows.select("path", F.col("dep_seq").cast("bigint").alias("dep_seq"), F.concat(sub("groupId"), F.lit(":"), sub("artifactId")).alias("name"), sub("version").alias("version"), F.lit("maven").alias("ecosystem"), (F.coalesce("d.scope", F.lit("")) != "test").alias("direct"))


READERS = {"go.mod": go_mod, "package.json": package_json, "requirements.txt": requirements, "pyproject.toml": requirements, "pipfile": requirements, "pom.xml": pom_xml}


def parse_all(files: DataFrame) -> DataFrame:
    """All supported manifests of a source, each by its reader."""
    valid = files.where(is_valid(F.col("path"), F.col("text")))
    out = None
    for reader in dict.fromkeys(READERS.values()):
        names = [n for n, r in READERS.items() if r is reader]
        part = reader(valid.where(F.lower(base_name(F.col("path"))).isin(names)))
        out = part if out is None else out.unionByName(part)
    return out


def glob_regex(pattern: Column) -> Column:
    """A workspace glob as a regular expression over relative folders."""
    escaped = F.regexp_replace(F.regexp_replace(F.rtrim(pattern, F.lit("/")), r"([.+()\[\]{}^$|\\])", r"\\$1"), r"\?", "[^/]")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(escaped, r"\*+", "\u0001"), "\u0001", "[^/]*"), F.lit("$"))


def workspace_globs(files: DataFrame) -> DataFrame:
    """(path, layer, seq, pattern) of workspace declarations: npm (a list, or an
    object with packages), pnpm (negations left out), go.work."""
    v = F.try_parse_json("text")
    npm = files.where(base_name(F.col("path")) == "package.json")
    globs = F.coalesce(F.try_variant_get(v, "$.workspaces", "array<string>"), F.try_variant_get(v, "$.workspaces.packages", "array<string>"))
    a = npm.select("path", F.lit(1).alias("layer"), F.posexplode(globs).alias("seq", "pattern"))
    pnpm = lines(files.where(base_name(F.col("path")) == "pnpm-workspace.yaml")).where(F.col("line").rlike(r"^\s*-\s"))
    b = pnpm.select("path", F.lit(2).alias("layer"), F.col("ln").alias("seq"), F.regexp_extract("line", r"^\s*-\s+[\"']?([^\"'#]+?)[\"']?\s*$", 1).alias("pattern")).where("pattern <> '' and pattern not like '!%'")
    work = lines(files.where(base_name(F.col("path")) == "go.work")).withColumn("line", F.regexp_replace("line", r"\s*//.*$|^\s+|(?<!\s)\s+$", ""))
    w = Window.partitionBy("path").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("line").rlike(r"^use\s*\("), 1).when(F.col("line").startswith(")"), 0)
    work = work.withColumn("_mark", mark).withColumn("_in", F.coalesce(F.last("_mark", ignorenulls=True).over(w), F.lit(0)))
    used = F.when(F.col("_mark").isNull() & (F.col("_in") == 1), F.col("line")).when(F.col("line").rlike(r"^use\s+[^(]"), F.regexp_extract("line", r"^use\s+(.*)$", 1))
    c = work.select("path", F.lit(3).alias("layer"), F.col("ln").alias("seq"), F.trim(F.regexp_replace(used, "^\"|\"$", "")).alias("pattern")).where("pattern <> ''")
    return a.unionByName(b).unionByName(c)


def workspace_manifests(files: DataFrame) -> DataFrame:
    """(path, layer, seq): manifests that workspace declarations in the top folder
    name: each pattern against the folders that hold the manifest, the top
    package.json last; paths are relative to the top folder. A go.work entry names
    one folder. Folders are matched by their depth and pattern, never all with all:
    a pattern of k parts meets the folders of k parts."""
    top = files.where(~F.regexp_replace("path", r"^\./", "").contains("/"))
    depth = lambda c: F.when(c == ".", 0).otherwise(F.size(F.split(c, "/")))
    clean = lambda c: F.when(F.regexp_replace(F.regexp_replace(c, r"^(\./)+", ""), r"/+$", "").isin("", "."), ".").otherwise(F.regexp_replace(F.regexp_replace(c, r"^(\./)+", ""), r"/+$", ""))
    globs = workspace_globs(top).select("layer", "seq", clean(F.col("pattern")).alias("pattern"))
    globs = globs.select("*", F.when(F.col("layer") == 3, "go.mod").otherwise("package.json").alias("_name"), depth(F.col("pattern")).alias("_depth"))
    listed = files.select(F.regexp_replace("path", r"^\./", "").alias("path")).select("path", base_name(F.col("path")).alias("_name"), folder(F.col("path")).alias("_folder")).withColumn("_depth", depth(F.col("_folder")))
    matches = F.when(F.col("layer") == 3, F.col("_folder") == F.col("pattern")).otherwise(F.expr("_folder rlike _regex"))
    found = globs.withColumn("_regex", glob_regex(F.col("pattern"))).join(listed, ["_name", "_depth"]).where(matches).select("path", "layer", F.col("seq").cast("bigint").alias("seq"))
    declared = globs.where("layer < 3").select("layer").distinct()
    roots = declared.join(listed.where("path = 'package.json'").select("path", F.lit(True).alias("_top")), F.col("_top"))
    return found.unionByName(roots.select("path", "layer", F.lit(2**31).cast("bigint").alias("seq")))


def all_manifests(files: DataFrame) -> DataFrame:
    """(path, layer): valid manifests of a project, from workspace declarations
    (layers 1 to 3) and from its tree (layer 4); each once, at its first layer."""
    tree = discover(files.select(F.regexp_replace("path", r"^\./", "").alias("path"))).select("path", F.lit(4).alias("layer"))
    first = workspace_manifests(files).select("path", "layer").unionByName(tree).groupBy("path").agg(F.min("layer").alias("layer"))
    texts = files.select(F.regexp_replace("path", r"^\./", "").alias("path"), "text")
    return first.join(texts, "path").where(F.coalesce(is_valid(F.col("path"), F.col("text")), F.lit(False))).select("path", "layer")


def parse_report(files: DataFrame) -> DataFrame:
    """(path, problem) of manifests that give no dependencies: those that no reader
    supports, and those that are empty or malformed."""
    supported = F.lower(base_name(F.col("path"))).isin(*READERS)
    problem = F.when(~supported, "unsupported").when(~F.coalesce(is_valid(F.col("path"), F.col("text")), F.lit(False)), "malformed")
    return files.where(base_name(F.col("path")).isin(dims.MANIFEST_NAMES)).select("path", problem.alias("problem")).where("problem is not null")


# fixed values: forms of references to a hosted repository, in order of trial: address, address of a branch and folder, without a protocol, owner and name
GITHUB = (
    r"^https?://github\.com/([^/]+)/([^/]+?)(?:\.git)?/?$",
    r"^https?://github\.com/([^/]+)/([^/]+)/tree/([^/]+)(?:/(.*))?$",
    r"^github\.com/([^/]+)/([^/]+?)(?:\.git)?/?$",
    r"^([a-zA-Z0-9_-]+)/([a-zA-Z0-9_.-]+)$",
)


def github_reference(ref: Column) -> Column:
    """struct(owner, repo, branch, folder), null where it is none; branch and folder
    are empty where the form has none."""
    out = None
    for p in GITHUB:
        part = lambda i: F.regexp_extract(ref, p, i) if "tree" in p or i < 3 else F.lit("")  # noqa: E731, B023
        one = F.struct(*[part(i).alias(n) for i, n in enumerate(("owner", "repo", "branch", "folder"), 1)])
        out = F.when(ref.rlike(p), one) if out is None else out.when(ref.rlike(p), one)
    return out
