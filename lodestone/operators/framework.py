"""Routes, middleware, client calls and environment reads from call sites and member accesses.

call_sites: repo_id, file_id, scope_id (enclosing declaration), root, member, args (array of struct text, value), line, col.
member_accesses: repo_id, file_id, scope_id, root, path (array), line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.construct import env_id, route_id

#: Methods that routers and clients have, and clients that are called bare (fixed values).
VERBS = "get post put patch delete options head all".split()
CLIENTS = "fetch axios request ky got superagent".split()


def express_routes(call_sites: DataFrame, declarations: DataFrame) -> DataFrame:
    """``router.verb('/path', handlers...)``: one row for each handler with its ordinal, linked to a declaration of the same file.

    A call without a literal path or without handlers is none. All handlers but the last are middleware.
    """
    calls = call_sites.where(F.col("member").isin(*VERBS) & F.col("args")[0]["value"].startswith("/") & (F.size("args") > 1))
    rows = calls.select(
        "repo_id", "file_id", "line", route_id(F.col("member"), F.col("args")[0]["value"]).alias("route_id"), (F.size("args") - 1).alias("n"), F.posexplode(F.slice("args", 2, F.size("args"))).alias("ordinal", "arg")
    )
    top = declarations.where("size(chain) = 1").select("repo_id", "file_id", F.col("name").alias("handler"), F.col("id").alias("handler_id"))
    return (
        rows.withColumn("handler", F.col("arg.text"))
        .join(top, ["repo_id", "file_id", "handler"], "left")
        .select("repo_id", "file_id", "line", "route_id", "ordinal", "handler", "handler_id", F.when(F.col("ordinal") == F.col("n") - 1, "handler").otherwise("middleware").alias("position"))
    )


def mounted_middleware(call_sites: DataFrame, declarations: DataFrame) -> DataFrame:
    """Arguments of ``.use(...)`` that aren't texts, linked to declarations of the same file."""
    used = call_sites.where("member = 'use'").select("repo_id", "file_id", F.explode("args").alias("arg")).where("arg.value is null")
    top = declarations.where("size(chain) = 1").select("repo_id", "file_id", F.col("name").alias("handler"), F.col("id").alias("handler_id"))
    return used.select("repo_id", "file_id", F.col("arg.text").alias("handler")).join(top, ["repo_id", "file_id", "handler"])


def _stated_method(options: Column) -> Column:
    found = F.lower(F.regexp_extract(options, "\\bmethod\\s*:\\s*['\"`]([A-Za-z]+)['\"`]", 1))
    return F.when(found.isin(*VERBS), F.upper(found))


def client_calls(call_sites: DataFrame) -> DataFrame:
    """Calls of clients with a literal address: (repo_id, caller_id, method, url); the method is null where it isn't stated."""
    url = F.col("args")[0]["value"]
    bare = F.col("member").isNull() & F.col("root").isin(*CLIENTS)
    verb = F.lower("member").isin(*VERBS)
    return call_sites.where((F.size("args") > 0) & (url.startswith("/") | url.rlike("(?i)^https?://")) & (bare | verb)).select(
        "repo_id",
        F.coalesce("scope_id", "file_id").alias("caller_id"),
        F.when(verb, F.upper("member")).otherwise(F.when(F.size("args") > 1, _stated_method(F.get(F.col("args"), 1)["text"]))).alias("method"),
        url.alias("url"),
    )


def environment_reads(member_accesses: DataFrame) -> DataFrame:
    """``process.env.NAME``: (repo_id, reader_id, env_id); a bare ``process.env`` reads nothing."""
    path = F.col("path")
    return (
        member_accesses.where((F.col("root") == "process") & (path[0] == "env") & (F.size(path) > 1))
        .select("repo_id", F.coalesce("scope_id", "file_id").alias("reader_id"), env_id(F.get(path, 1)).alias("env_id"), "line")
        .where("env_id is not null")
    )
