"""Source files that do not parse."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.syntax import LANGUAGES, accepts, check
from lodestone.plans.staging import ship, spread
from lodestone.plans.standing import standing

#: Language of each extension that is checked.
EXTENSIONS = {"py": "python", "js": "javascript", "ts": "typescript", "java": "java", "go": "go", "json": "json"}
#: Other spellings of languages, in lower case.
SPELLINGS = {"js": "javascript", "ecmascript": "javascript", "node": "javascript", "ts": "typescript", "py": "python", "python3": "python", "golang": "go", "md": "markdown", "yml": "yaml"}

SCHEMA = (
    "repo_id bigint, file_id string, language string, scanned_at timestamp_ntz, tie bigint, valid boolean, line int, cause string, "
    "errors array<struct<line:int,message:string>>, accepted_by array<string>"
)
_ERRORS = pa.list_(pa.struct([("line", pa.int32()), ("message", pa.string())]))


def plain_language(column: Column) -> Column:
    """A language in lower case without blanks, other spellings put right."""
    low = F.lower(F.trim(column))
    out = low
    for k, v in SPELLINGS.items():
        out = F.when(low == k, v).otherwise(out)
    return out


def verdict(text: str, language: str) -> tuple[bool, list[tuple[int, str]]]:
    errors = check(text, language)
    return not errors, errors


def accepting(text: str, language: str, valid: bool) -> list[str]:
    """The languages whose parsers accept a text that is (not) valid in its own."""
    return [x for x in LANGUAGES if (valid if x == language else accepts(text, x))]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        valid, line, cause, every, accepted = [], [], [], [], []
        for language, text in zip(batch.column("language").to_pylist(), batch.column("contents").to_pylist()):
            ok, errors = (None, []) if text is None else verdict(text, language)
            valid.append(ok)
            line.append(errors[0][0] if errors else None)
            cause.append(errors[0][1] if errors else None)
            every.append([{"line": n, "message": m} for n, m in errors])
            accepted.append([] if text is None else accepting(text, language, ok))
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in ("repo_id", "file_id", "language", "scanned_at", "tie")],
                pa.array(valid, pa.bool_()),
                pa.array(line, pa.int32()),
                pa.array(cause, pa.string()),
                pa.array(every, _ERRORS),
                pa.array(accepted, pa.list_(pa.string())),
            ],
            names=["repo_id", "file_id", "language", "scanned_at", "tie", "valid", "line", "cause", "errors", "accepted_by"],
        )


def check_files(files: DataFrame) -> DataFrame:
    """The syntax of every file whose extension has a parser.

    files: repo_id, file_id, path, contents, scanned_at. Result, one row per (repo_id, file_id): ``language`` of the
    extension, ``valid``, ``line`` and ``cause`` of the first error, all ``errors``, lexical ones included, and
    ``accepted_by``, the languages whose parser accepts the text (a file under a wrong extension shows its own there).

    The row with the greatest scanned_at stands; at equal times the one whose contents have the greater hash. Texts are
    parsed where they are read, and only verdicts are shuffled. ``valid`` is null only where contents are null. A text
    nested deeper than some 3,000 levels has an error that says so; JSON may nest without bound, and Python has an error
    beyond 200 open brackets. An empty text is judged like any other: valid in all but JSON and Go. Null
    paths and other extensions give no row; extra columns are ignored; an empty table gives an empty result.
    """
    ship(files.sparkSession)
    extension = F.lower(F.regexp_extract(F.col("path"), r"\.([A-Za-z0-9]+)$", 1))
    language = F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), extension)
    picked = files.where(extension.isin(*EXTENSIONS)).select(
        F.col("repo_id").cast("bigint").alias("repo_id"),
        "file_id",
        language.alias("language"),
        F.col("scanned_at").cast("timestamp_ntz").alias("scanned_at"),
        F.xxhash64("contents").alias("tie"),
        "contents",
    )
    checked = spread(picked).mapInArrow(_run, SCHEMA)
    return standing(checked, ["repo_id", "file_id"], "scanned_at", [F.col("tie").desc()]).drop("scanned_at", "tie")


def validity_rates(files: DataFrame, regions: DataFrame) -> DataFrame:
    """(repo_id, language, listed, checked, invalid, rate, listed_rate): invalid files per repository and language.

    regions: repo_id, region_path, language, files. Spellings of a language are taken together, and of repeated rows of a
    region and language the greatest count holds. Every language that is listed or has a checked file has a row: one that
    isn't listed has a null ``listed``, one without checked files 0 of them. ``rate`` is invalid by checked files,
    ``listed_rate`` invalid by listed ones; either is null where it would divide by nothing.
    """
    counted = (
        check_files(files)
        .where("valid is not null")
        .groupBy("repo_id", "language")
        .agg(F.count(F.lit(1)).alias("checked"), F.count_if(~F.col("valid")).alias("invalid"))
    )
    listed = (
        regions.groupBy("repo_id", "region_path", plain_language(F.col("language")).alias("language"))
        .agg(F.max("files").alias("files"))
        .where("language is not null")
        .groupBy("repo_id", "language")
        .agg(F.sum("files").alias("listed"))
    )
    none = F.lit(0).cast("bigint")
    joined = counted.join(listed, ["repo_id", "language"], "full").withColumns({"checked": F.coalesce("checked", none), "invalid": F.coalesce("invalid", none)})
    return joined.select(
        "repo_id",
        "language",
        "listed",
        "checked",
        "invalid",
        F.try_divide("invalid", "checked").alias("rate"),
        F.try_divide("invalid", "listed").alias("listed_rate"),
    )
