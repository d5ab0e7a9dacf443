"""Technologies of regions from dependencies, lockfiles, file names and contents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import base_name, ecosystem_of
from lodestone.plans.graph import confidence_rank

#: Technology, category and the packages that show it (fixed values).
PACKAGES = [
    ("react", "frontend", "react react-dom"), ("nextjs", "frontend", "next"), ("vue", "frontend", "vue @vue/runtime-core"), ("nuxt", "frontend", "nuxt"),
    ("svelte", "frontend", "svelte"), ("sveltekit", "frontend", "@sveltejs/kit"), ("angular", "frontend", "@angular/core"), ("solid", "frontend", "solid-js"),
    ("astro", "frontend", "astro"), ("express", "backend", "express"), ("nestjs", "backend", "@nestjs/core @nestjs/common @nestjs/platform-express @nestjs/platform-fastify"),
    ("fastify", "backend", "fastify"), ("hono", "backend", "hono"), ("koa", "backend", "koa"), ("hapi", "backend", "@hapi/hapi"), ("trpc", "backend", "@trpc/server"),
    ("apollo-server", "backend", "@apollo/server"), ("flask", "backend", "flask Flask"), ("fastapi", "backend", "fastapi"), ("django", "backend", "django Django"),
    ("spring-boot", "backend", "spring-boot-starter-web spring-boot-starter"), ("gin", "backend", "github.com/gin-gonic/gin"), ("echo", "backend", "github.com/labstack/echo/v4"),
    ("fiber", "backend", "github.com/gofiber/fiber/v2"), ("turborepo", "build", "turbo"), ("nx", "build", "nx @nx/workspace"), ("vite", "build", "vite"),
    ("webpack", "build", "webpack"), ("esbuild", "build", "esbuild"), ("rollup", "build", "rollup"), ("vitest", "testing", "vitest"), ("jest", "testing", "jest"),
    ("playwright", "testing", "@playwright/test playwright"), ("cypress", "testing", "cypress"), ("pytest", "testing", "pytest"), ("junit", "testing", "junit-jupiter junit-jupiter-api junit"),
    ("prisma", "data", "prisma @prisma/client"), ("typeorm", "data", "typeorm"), ("drizzle", "data", "drizzle-orm"), ("mongoose", "data", "mongoose"),
    ("sqlalchemy", "data", "sqlalchemy SQLAlchemy"), ("postgres", "data", "pg psycopg2 psycopg2-binary postgres"), ("redis", "data", "redis ioredis"), ("sqlite", "data", "better-sqlite3 sqlite3"),
]
#: Package prefixes that show a technology (fixed values).
PREFIXES = [("spring-boot", "backend", "spring-boot-starter")]
#: Package manager of each lockfile (fixed values).
LOCKFILES = {
    "package-lock.json": "npm", "pnpm-lock.yaml": "pnpm", "yarn.lock": "yarn", "bun.lockb": "bun", "bun.lock": "bun", "poetry.lock": "poetry", "uv.lock": "uv",
    "pipfile.lock": "pipenv", "cargo.lock": "cargo", "gemfile.lock": "bundler", "composer.lock": "composer", "go.sum": "go-modules",
}
#: Pieces of evidence kept for a technology, and characters of a file looked at for a resource (fixed values).
EVIDENCE, PROBE = 12, 2048


def declared_dependencies(contents: Column, name: Column) -> Column:
    """Sorted distinct names of the dependencies that a manifest declares, by its file name; none for an unknown one."""
    def keys(field: str) -> Column:
        return F.coalesce(F.map_keys(F.from_json(F.get_json_object(contents, f"$.{field}"), "map<string,string>")), F.array().cast("array<string>"))

    def found(pattern: str) -> Column:
        return F.coalesce(F.regexp_extract_all(contents, F.lit(pattern), 1), F.array().cast("array<string>"))

    npm = F.concat(*[keys(f) for f in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")])
    composer = F.filter(F.concat(keys("require"), keys("require-dev")), lambda x: x.contains("/"))
    lists = {
        "package.json": npm,
        "composer.json": composer,
        "requirements.txt": found(r"(?m)^[ \t]*([A-Za-z0-9][A-Za-z0-9._-]*)"),
        "go.mod": found(r"(?m)^[ \t]*(?:require[ \t]+)?([a-z0-9.-]+\.[a-z]+/[^\s]+)[ \t]+v"),
        "cargo.toml": F.concat(*[found(p) for p in (r"(?s)\[(?:dev-|build-)?dependencies\][^\[]*?\n([A-Za-z0-9_-]+)[ \t]*=",)]),
        "pom.xml": found(r"(?s)<dependency>.*?<artifactId>\s*([^<\s]+)"),
        "build.gradle": found(r"(?m)(?:implementation|api|compileOnly|testImplementation|runtimeOnly)[ \t(]+[\"']([^:\"']+:[^:\"']+)"),
        "gemfile": found(r"(?m)^[ \t]*gem[ \t]+[\"']([^\"']+)"),
    }
    out = F.array().cast("array<string>")
    for k, v in lists.items():
        out = F.when(name == k, v).otherwise(out)
    return F.array_sort(F.array_distinct(out))


def declared_name(contents: Column, name: Column) -> Column:
    return F.when(name.isin("package.json", "composer.json"), F.get_json_object(contents, "$.name")).when(
        name == "go.mod", F.nullif(F.regexp_extract(contents, r"(?m)^module[ \t]+(\S+)", 1), F.lit(""))
    )


def manifests(files: DataFrame) -> DataFrame:
    """Manifests (repo_id, path, contents) with ecosystem, declared dependencies and name."""
    name = base_name(F.col("path"))
    return files.withColumn("ecosystem", ecosystem_of(F.col("path"))).where("ecosystem is not null").select(
        "repo_id", "path", "ecosystem", declared_dependencies(F.col("contents"), name).alias("dependencies"), declared_name(F.col("contents"), name).alias("declared_name")
    )


def detect(files: DataFrame, placed: DataFrame) -> DataFrame:
    """(repo_id, region, id, category, confidence, evidence): technologies of each region.

    files: repo_id, path, contents. placed: repo_id, path, region. Several pieces of evidence for one technology are put
    together: the strongest confidence, and paths in order, ``EVIDENCE`` at most. A package matches by its name or by
    what follows its last colon; a manifest's own name counts as well.
    """
    spark = files.sparkSession
    rules = spark.createDataFrame([(i, c, p) for i, c, ps in PACKAGES for p in ps.split()], "id string, category string, package string")
    named = manifests(files).select("repo_id", "path", F.explode(F.array_distinct(F.concat("dependencies", F.array_compact(F.array("declared_name"))))).alias("name"))
    both = named.select("repo_id", "path", F.explode(F.array_distinct(F.array("name", F.element_at(F.split("name", ":"), -1)))).alias("package"))
    exact = both.join(F.broadcast(rules), "package").select("repo_id", "path", "id", "category", F.lit("CERTAIN").alias("confidence"))  # a fixed table
    prefixed = [
        both.where(F.col("package").startswith(p)).select("repo_id", "path", F.lit(i).alias("id"), F.lit(c).alias("category"), F.lit("CERTAIN").alias("confidence")) for i, c, p in PREFIXES
    ]
    locks = F.create_map(*[F.lit(x) for kv in LOCKFILES.items() for x in kv])
    name = base_name(F.col("path"))
    locked = files.withColumn("id", F.element_at(locks, name)).where("id is not null").select("repo_id", "path", "id", F.lit("build").alias("category"), F.lit("CERTAIN").alias("confidence"))
    file_rules = [("docker", "infrastructure", name.rlike(r"^(dockerfile(\..*)?|.*\.dockerfile)$")), ("terraform", "infrastructure", name.endswith(".tf")), ("github-actions", "infrastructure", F.col("path").startswith(".github/workflows/") & name.rlike(r"\.ya?ml$"))]
    by_file = [files.where(test).select("repo_id", "path", F.lit(i).alias("id"), F.lit(c).alias("category"), F.lit("CERTAIN").alias("confidence")) for i, c, test in file_rules]
    head = F.substring(F.col("contents"), 1, PROBE)
    resource = files.where(
        name.rlike(r"\.ya?ml$") & ~name.contains("compose") & ~F.col("path").startswith(".github/") & head.rlike(r"(?m)^apiVersion:\s*\S") & head.rlike(r"(?m)^kind:\s*\S")
    ).select("repo_id", "path", F.lit("kubernetes").alias("id"), F.lit("infrastructure").alias("category"), F.lit("INFERRED").alias("confidence"))
    union = reduce(DataFrame.unionByName, [exact, *prefixed, locked, *by_file, resource])
    return (
        union.join(placed, ["repo_id", "path"])
        .groupBy("repo_id", "region", "id")
        .agg(
            F.min("category").alias("category"),
            F.min_by("confidence", confidence_rank(F.col("confidence"))).alias("confidence"),
            F.slice(F.array_sort(F.collect_set("path")), 1, EVIDENCE).alias("evidence"),
        )
    )


def region_class(categories: DataFrame) -> DataFrame:
    """What a region is, from its technologies' categories and whether it has a manifest and source: repo_id, region, class.

    categories: repo_id, region, categories (array), has_manifest, has_source.
    """
    has = lambda c: F.array_contains("categories", c)
    return categories.select(
        "repo_id",
        "region",
        F.when(has("frontend"), "application")
        .when(has("backend"), "service")
        .when(F.col("has_manifest") & F.col("has_source"), "library")
        .when(has("infrastructure"), "infrastructure")
        .when(has("build"), "tooling")
        .when(F.col("has_source"), "library")
        .otherwise("unknown")
        .alias("class"),
    )
