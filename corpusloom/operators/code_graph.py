"""The code graph as two tables: nodes by label and key, edges by kind; writing modules, deleting repositories, resolving names.

Nodes (label, key, name, full_name, detail): Repository, File, Class, Method, Attribute, Function, Interface, Type, Branch, Commit.
Edges (kind, src_label, src, dst_label, dst): CONTAINS, DEFINES, HAS_METHOD, HAS_ATTRIBUTE, IMPORTS, HAS_BRANCH, HAS_COMMIT.
A node's key is its name in the graph; of several modules that give one key, the first path's node stays.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import prefixes

#: Branches of a repository that are kept.
BRANCHES = 10
#: What is deleted with a repository, part by part, by the edges that lead to it.
_CASCADE = (("HAS_BRANCH", "HAS_COMMIT", "CONTAINS"), ("DEFINES",), ("HAS_METHOD", "HAS_ATTRIBUTE"))


def _parts(modules: DataFrame, column: str, label: str, edge: str, key: Column, owner: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the structs in an array column; key is made of `path`, `module`, `parent` and `item`."""
    items = modules.select("path", "module", owner[1], F.explode(column).alias("item")).where("item.name IS NOT NULL")
    keyed = items.select("*", key.alias("key"))
    detail = F.to_json(F.struct(*[f"item.{f.name}" for f in modules.schema[column].dataType.elementType.fields if f.name not in ("name", "full_name", "methods", "attributes")]))
    nodes = keyed.select(F.lit(label).alias("label"), "key", "item.name", F.replace("key", F.lit("::"), F.lit(".")).alias("full_name") if label != "Class" else F.col("key").alias("full_name"), detail.alias("detail"), "path")
    edges = keyed.select(F.lit(edge).alias("kind"), F.lit(owner[0]).alias("src_label"), F.col(owner[1]).alias("src"), F.lit(label).alias("dst_label"), F.col("key").alias("dst"))
    return nodes, edges


def shred(modules: DataFrame, branches: DataFrame | None = None, commits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of modules (repo, path, module, imports, classes, functions, interfaces, types).

    imports: names. classes: structs of name, full_name, methods and attributes (structs with a name); functions,
    interfaces and types: structs with a name. Keys: a class's full name (module.name if it has none), class::name of
    its methods and attributes, path::name of the others. branches: (repo, name, at), the newest BRANCHES of each
    repository stay; commits: (repo, hash). Null or empty lists give nothing.
    """
    named = lambda m: F.coalesce(m["full_name"], F.concat(F.col("module"), F.lit("."), m["name"]))
    classes = modules.select("path", "module", F.explode("classes").alias("c")).where("c.name IS NOT NULL").select("path", "module", named(F.col("c")).alias("class"), "c.methods", "c.attributes")
    under = lambda c: F.concat(F.col(c), F.lit("::"), F.col("item.name"))
    pieces = [
        _parts(modules, "classes", "Class", "DEFINES", named(F.col("item")), ("File", "path")),
        _parts(classes, "methods", "Method", "HAS_METHOD", under("class"), ("Class", "class")),
        _parts(classes, "attributes", "Attribute", "HAS_ATTRIBUTE", under("class"), ("Class", "class")),
        *[_parts(modules, c, label, "DEFINES", under("path"), ("File", "path")) for c, label in (("functions", "Function"), ("interfaces", "Interface"), ("types", "Type"))],
    ]
    node = lambda df, label, key, name, full, path: df.select(F.lit(label).alias("label"), F.col(key).alias("key"), F.col(name).alias("name"), F.col(full).alias("full_name"), F.lit(None).cast("string").alias("detail"), F.col(path).alias("path"))
    edge = lambda df, kind, src, label, dst: df.select(F.lit(kind).alias("kind"), F.lit("Repository").alias("src_label"), F.col(src).alias("src"), F.lit(label).alias("dst_label"), F.col(dst).alias("dst"))
    nodes = [n for n, _ in pieces] + [node(modules, "Repository", "repo", "repo", "repo", "path"), node(modules, "File", "path", "path", "module", "path")]
    edges = [e for _, e in pieces] + [edge(modules, "CONTAINS", "repo", "File", "path")]
    if branches is not None:
        newest = branches.groupBy("repo").agg(F.slice(F.sort_array(F.collect_set(F.struct("at", "name")), asc=False), 1, BRANCHES).alias("b")).select("repo", F.explode("b.name").alias("name"))
        own = newest.withColumn("key", F.concat("repo", F.lit("::"), "name"))
        nodes.append(node(own, "Branch", "key", "name", "key", "repo"))
        edges.append(edge(own, "HAS_BRANCH", "repo", "Branch", "key"))
    if commits is not None:
        nodes.append(node(commits, "Commit", "hash", "hash", "hash", "repo"))
        edges.append(edge(commits, "HAS_COMMIT", "repo", "Commit", "hash"))
    imports = modules.select("path", F.explode("imports").alias("name"))
    found = resolve_imports(imports, modules.select("path", "module")).where("target IS NOT NULL")
    edges.append(found.select(F.lit("IMPORTS").alias("kind"), F.lit("File").alias("src_label"), F.col("path").alias("src"), F.lit("File").alias("dst_label"), F.col("target").alias("dst")))
    union = functools.partial(functools.reduce, DataFrame.unionByName)
    merged = union(nodes).groupBy("label", "key").agg(F.min_by(F.struct("name", "full_name", "detail"), F.struct("path", "detail")).alias("n")).select("label", "key", "n.*")
    return merged, union(edges).distinct()


def delete(nodes: DataFrame, edges: DataFrame, repos: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, counts): the graph without the repositories (repo) and what they hold, and the nodes deleted by label.

    A class that files of two repositories define goes with the first one of them that goes. Edges to or from deleted nodes go.
    """
    level = repos.select(F.lit("Repository").alias("label"), F.col("repo").alias("key")).distinct()
    gone = level
    for kinds in _CASCADE:
        level = level.join(edges.where(F.col("kind").isin(*kinds)), (F.col("label") == F.col("src_label")) & (F.col("key") == F.col("src"))).select(F.col("dst_label").alias("label"), F.col("dst").alias("key")).distinct()
        gone = gone.unionByName(level)
    gone = gone.distinct()
    counts = nodes.join(gone, ["label", "key"], "left_semi").groupBy("label").agg(F.count(F.lit(1)).alias("deleted"))
    rest = nodes.join(gone, ["label", "key"], "left_anti")
    touched = lambda side: gone.select(F.col("label").alias(f"{side}_label"), F.col("key").alias(side))
    left = edges.join(touched("src"), ["src_label", "src"], "left_anti").join(touched("dst"), ["dst_label", "dst"], "left_anti")
    return rest, left, counts


def functions_of(edges: DataFrame) -> DataFrame:
    """(repo, path, function): repositories, their files and the functions these define."""
    held = edges.where("kind = 'CONTAINS'").select(F.col("src").alias("repo"), F.col("dst").alias("path"))
    return held.join(edges.where("kind = 'DEFINES' AND dst_label = 'Function'").select(F.col("src").alias("path"), F.col("dst").alias("function")), "path").select("repo", "path", "function")


def files_importing(nodes: DataFrame, edges: DataFrame, target: Column | str) -> DataFrame:
    """(file, imports): files with an import that ends at a module whose name holds `target`."""
    modules = nodes.where("label = 'File'").where(F.contains("full_name", F.lit(target) if isinstance(target, str) else target)).select(F.col("key").alias("dst"), F.col("full_name").alias("imports"))
    return edges.where("kind = 'IMPORTS'").join(modules, "dst").select(F.col("src").alias("file"), "imports")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, name, target): each different import of a file with the file it ends at, or null.

    files: (path, module). First the file whose module is the longest leading part of the name (`a.b.C` ends at a.b); else, as a package
    stands for what it holds, the file with the shortest module that the name leads (`a` ends at a.b before a.b.c). Equal ones:
    the first module and path by name, so the order of rows decides nothing. Names lead at whole parts; an import that ends at its own file is kept.
    """
    asked = imports.where("name <> ''").select("path", "name").distinct()
    parts = F.size(F.split("module", "\\."))
    one = files.where("module <> ''").groupBy("module").agg(F.min("path").alias("target"))
    exact = asked.select("path", "name", F.posexplode(prefixes(F.col("name"), ".")).alias("length", "module")).join(one, "module").groupBy("path", "name").agg(F.max_by("target", "length").alias("longest"))
    # one file for each leading part, before it meets the imports
    led = one.select("target", "module", parts.alias("n"), F.explode(prefixes(F.col("module"), ".")).alias("name")).groupBy("name").agg(F.min_by("target", F.struct("n", "module")).alias("held"))
    return asked.join(exact, ["path", "name"], "left").join(led, "name", "left").select("path", "name", F.coalesce("longest", "held").alias("target"))


def resolve_classes(asked: DataFrame, classes: DataFrame, modules: DataFrame) -> DataFrame:
    """(name, full_name): each different name asked for with the class it stands for, or null.

    classes: (name, full_name, repo); modules: (module, repo). First a class of that name or full name (of several
    the first full name); else the part before the last dot is looked up as a module, whose repository is the one with
    most files under its first part, and a class of the last part is taken from there.
    """
    one = asked.where("name <> ''").select("name").distinct()
    same = classes.select(F.col("full_name").alias("name"), "full_name").unionByName(classes.select("name", "full_name")).groupBy("name").agg(F.min("full_name").alias("same"))
    head = lambda c: F.split(c, "\\.")[0]
    owner = modules.groupBy(head("module").alias("head"), "repo").agg(F.count(F.lit(1)).alias("n")).groupBy("head").agg(F.min_by("repo", F.struct(-F.col("n"), "repo")).alias("repo"))
    inside = classes.groupBy("repo", F.col("name").alias("last")).agg(F.min("full_name").alias("inside"))
    dotted = one.where(F.contains("name", F.lit("."))).select("name", head("name").alias("head"), F.element_at(F.split("name", "\\."), -1).alias("last")).join(owner, "head").join(inside, ["repo", "last"])
    return one.join(same, "name", "left").join(dotted.select("name", "inside"), "name", "left").select("name", F.coalesce("same", "inside").alias("full_name"))
