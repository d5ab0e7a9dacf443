"""Binding names at call sites to declarations: equi-joins in order of their rules, the first that fires wins.

Facts, one table each with ``repo_id``:

* declarations: id, file_id, kind, name, chain (array of names from the outermost container to the declaration itself)
* imports: file_id, local_name, target_id (a declaration's or an external's id), seq
* call_sites: site_id, file_id, scope (chain of the enclosing declaration, empty at the top of the file), root, member (null
  for a bare name), is_construction
* extends: child_id, parent_id
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.traversal import reach

CONTAINERS = ["Class", "Interface", "Enum", "Namespace"]


def merged_declarations(parts: DataFrame) -> DataFrame:
    """Parts of one declaration (same id) put together: sorted lines, any modifier, first visibility, container kind first."""
    return parts.groupBy("repo_id", "id").agg(
        F.min_by("kind", F.struct(F.when(F.col("kind").isin(*CONTAINERS), 0).otherwise(1), "seq")).alias("kind"),
        F.min_by("visibility", F.when(F.col("visibility").isNotNull(), F.col("seq"))).alias("visibility"),
        F.bool_or("is_exported").alias("is_exported"),
        F.array_sort(F.collect_list("line")).alias("lines"),
    )


def last_imports(imports: DataFrame) -> DataFrame:
    """What each local name of a file stands for: the last import of it."""
    return imports.groupBy("repo_id", "file_id", "local_name").agg(F.max_by("target_id", "seq").alias("target_id"))


def scoped(names: DataFrame, declarations: DataFrame) -> DataFrame:
    """(repo_id, key, file_id, scope, name) looked up from the innermost container outwards: (repo_id, key, found_id)."""
    levels = F.transform(F.sequence(F.lit(0), F.size("scope")), lambda n: F.array_join(F.concat(F.slice("scope", 1, n), F.array("name")), "."))
    asked = names.select("repo_id", "key", "file_id", F.posexplode(levels).alias("depth", "path"))
    known = declarations.select("repo_id", "file_id", F.array_join("chain", ".").alias("path"), "id").groupBy("repo_id", "file_id", "path").agg(F.min("id").alias("id"))
    return asked.join(known, ["repo_id", "file_id", "path"]).groupBy("repo_id", "key").agg(F.max_by("id", "depth").alias("found_id"))


def inherited_members(declarations: DataFrame, extends: DataFrame) -> DataFrame:
    """Members that classes have from themselves (depth 0) and their bases, the nearest base first, ties by id."""
    members = declarations.where(F.size("chain") > 1).select(
        "repo_id", "file_id", F.array_join(F.slice("chain", 1, F.size("chain") - 1), ".").alias("owner"), "name", F.col("id").alias("member_id")
    )
    owners = declarations.where(F.col("kind").isin(*CONTAINERS)).select("repo_id", "file_id", F.array_join("chain", ".").alias("owner"), F.col("id").alias("class_id"))
    own = members.join(owners, ["repo_id", "file_id", "owner"]).select("repo_id", F.col("class_id").alias("id"), "name", "member_id")
    roots = owners.select("repo_id", F.col("class_id").alias("id"), F.col("class_id").alias("of"))
    edges = extends.select("repo_id", F.col("child_id").alias("source_id"), F.col("parent_id").alias("target_id"))
    found = reach(edges, roots, group=["of"]).join(own, ["repo_id", "id"])
    return found.groupBy("repo_id", F.col("of").alias("class_id"), "name").agg(
        F.min(F.struct("depth", "member_id")).alias("best")
    ).select("repo_id", "class_id", "name", F.col("best.member_id").alias("member_id"), F.col("best.depth").alias("depth"))


def bind_calls(call_sites: DataFrame, declarations: DataFrame, imports: DataFrame, extends: DataFrame) -> DataFrame:
    """(repo_id, site_id, outcome, target_id, rule): each call site once, as ``call``, ``external`` or ``unresolved``.

    Rules in order: a bare name in scope, a bare name imported; ``this`` or ``self`` with a member of the enclosing class
    or its bases; an imported root whose member is a declaration's; an imported external root. A construction of a class
    goes to its constructor if it has one. ``rule`` of an unresolved site tells why.
    """
    local = last_imports(imports)
    sites = call_sites.withColumn("key", F.col("site_id"))
    bare = sites.where("member is null")
    in_scope = scoped(bare.select("repo_id", "key", "file_id", "scope", F.col("root").alias("name")), declarations).withColumnRenamed("found_id", "scope_id")
    roots = local.select("repo_id", "file_id", F.col("local_name").alias("root"), F.col("target_id").alias("import_id"))
    holders = declarations.where(F.col("kind").isin(*CONTAINERS)).select("repo_id", "file_id", F.array_join("chain", ".").alias("class_path"), F.col("id").alias("class_id"))
    members = inherited_members(declarations, extends)
    own = (
        sites.where("root in ('this', 'self', 'cls') and member is not null")
        .withColumn("up", F.explode(F.sequence(F.lit(1), F.greatest(F.size("scope"), F.lit(1)))))
        .withColumn("class_path", F.array_join(F.slice("scope", 1, F.col("up")), "."))
        .join(holders, ["repo_id", "file_id", "class_path"])
        .groupBy("repo_id", "site_id", "member")
        .agg(F.max_by("class_id", "up").alias("class_id"))
        .join(members.select("repo_id", "class_id", F.col("name").alias("member"), F.col("member_id").alias("self_id")), ["repo_id", "class_id", "member"])
        .select("repo_id", "site_id", "self_id")
    )
    constructors = members.where("name = 'constructor'").select("repo_id", "class_id", F.col("member_id").alias("constructor_id"))
    by_import = members.select("repo_id", F.col("class_id").alias("import_id"), F.col("name").alias("member"), F.col("member_id").alias("import_member_id"))
    joined = (
        sites.join(in_scope.withColumnRenamed("key", "site_id"), ["repo_id", "site_id"], "left")
        .join(roots, ["repo_id", "file_id", "root"], "left")
        .join(own, ["repo_id", "site_id"], "left")
        .join(by_import, ["repo_id", "import_id", "member"], "left")
    )
    is_external = F.col("import_id").startswith("ext:")
    bare_name = F.col("member").isNull()
    target = F.coalesce(
        F.when(bare_name, F.coalesce("scope_id", "import_id")), F.col("self_id"), F.when(~bare_name & is_external, F.col("import_id")), F.when(~bare_name, F.col("import_member_id"))
    )
    rule = (
        F.when(bare_name & F.col("scope_id").isNotNull(), "scope")
        .when(bare_name & F.col("import_id").isNotNull(), "import")
        .when(F.col("self_id").isNotNull(), "member")
        .when(~bare_name & is_external, "external-root")
        .when(F.col("import_member_id").isNotNull(), "imported-member")
        .when(bare_name, "name-not-bound")
        .when(F.col("import_id").isNotNull(), "member-not-found")
        .otherwise("root-not-bound")
    )
    bound = joined.select("repo_id", "site_id", "is_construction", target.alias("target_id"), rule.alias("rule"))
    built = bound.join(constructors.withColumnRenamed("class_id", "target_id"), ["repo_id", "target_id"], "left")
    final = F.when(F.col("is_construction"), F.coalesce("constructor_id", "target_id")).otherwise(F.col("target_id"))
    outcome = F.when(final.isNull(), "unresolved").when(final.startswith("ext:"), "external").otherwise("call")
    return built.select("repo_id", "site_id", outcome.alias("outcome"), final.alias("target_id"), "rule")


def ambiguous(resolved: DataFrame) -> DataFrame:
    """Facts with several targets (repo_id, id, targets) as one row for each target, sharing a candidate group."""
    many = F.size("targets") > 1
    return resolved.select(
        "repo_id",
        "id",
        F.explode("targets").alias("target_id"),
        F.when(many, "AMBIGUOUS").otherwise("RESOLVED").alias("confidence"),
        F.when(many, F.concat_ws("|", "id", F.array_join(F.array_sort("targets"), ","))).alias("candidate_group"),
    )


def external_of(specifier):
    """(kind, name, confidence) of a module specifier as a struct; null for a relative one."""
    parts = F.split(specifier, "/")
    package = F.when(specifier.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(parts[0])
    return (
        F.when(specifier.startswith(".") | specifier.startswith("/"), F.lit(None))
        .when(specifier.startswith("node:"), F.struct(F.lit("stdlib").alias("kind"), F.substring(specifier, 6, 1000).alias("name"), F.lit("CERTAIN").alias("confidence")))
        .otherwise(F.struct(F.lit("npm").alias("kind"), package.alias("name"), F.lit("INFERRED").alias("confidence")))
    )
