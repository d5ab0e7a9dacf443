from datetime import datetime

from lodestone.llm.validity import check_files, validity_rates

from ..conftest import rows

SCHEMA = "repo_id bigint, file_id string, path string, contents string, scanned_at timestamp, valid int"


def t(n):
    return datetime(2031, 1, 1, 0, 0, n)


FILES = [
    (1, "file:a.py", "a.py", "x = 1\n", t(2), 0),
    (1, "file:a.py", "a.py", "x = (\n", t(1), 0),  # an older state
    (1, "file:b.py", "b.py", "import * as x from 'y';\n", t(1), 0),
    (1, "file:b.py", "b.py", "import * as x from 'y';\n", t(1), 0),  # twice
    (1, "file:c.GO", "c.GO", "", t(1), 0),
    (1, "file:d.json", "d.json", None, t(1), 0),
    (1, "file:e.txt", "e.txt", "(", t(1), 0),
    (1, None, None, "(", t(1), 0),
    (2, "file:a.py", "a.py", "def f(:\n\nx = = 1\n", None, 0),
]


def test_files(spark):
    df = spark.createDataFrame(FILES, SCHEMA)
    got = {(r.repo_id, r.file_id): r for r in check_files(df).collect()}
    assert len(got) == 5
    assert got[1, "file:a.py"].valid is True and got[1, "file:a.py"].accepted_by == ["python", "javascript", "typescript"]
    assert got[1, "file:b.py"].valid is False and got[1, "file:b.py"].accepted_by == ["javascript", "typescript"]
    assert got[1, "file:c.GO"].valid is False
    assert got[1, "file:d.json"].valid is None
    assert got[2, "file:a.py"].valid is False
    assert rows(check_files(df.limit(0))) == []


def test_rates(spark):
    df = spark.createDataFrame(FILES, SCHEMA)
    regions = spark.createDataFrame(
        [(1, ".", "Python", 2), (1, ".", " python", 1), (1, "src", "py", 3), (1, ".", "golang", None), (2, ".", "Java", 9)],
        "repo_id bigint, region_path string, language string, files int",
    )
    got = rows(validity_rates(df, regions))
    assert got == [(1, "go", None, 1, 1, 1.0, None), (1, "python", 5, 2, 1, 0.5, 0.2), (2, "java", 9, 0, 0, None, 0.0), (2, "python", None, 1, 1, 1.0, None)]
    assert rows(validity_rates(df.limit(0), regions.limit(0))) == []
