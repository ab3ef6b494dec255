"""Tables with the awkward cases that every operator has to stand, and a comparison with SQL."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from check_queries import compare  # noqa: E402

LONG = "\n".join(f"line {i % 997} of a very long text, word {i}" for i in range(20000))
SHARED = "a first line that many texts have\nand a second one, so it is a chunk\nand a third that ends it\nand a fourth for the window"
AWKWARD = [
    (1, "one two three four five six seven eight nine ten", "en", "a", 48),
    (1, "one two three four five six seven eight nine ten", "en", "a", 48),
    (2, "one two three four five six seven eight nine ten", "en", None, 48),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \n\t ", "en", "b", 4),
    (6, LONG, "en", "b", len(LONG)),
    (7, LONG + " tail", "en", "b", len(LONG) + 5),
    (None, "a text without an id", "en", "c", 20),
    (None, None, "en", "c", None),
    (8, SHARED + "\nown end of eight", "de", "a", 150),
    (9, "own start of nine\n" + SHARED + "\nmore of nine", "de", "a", 170),
    (10, SHARED, "de", "a", 130),
    (11, "Straße ÉTÉ été x y 🙂 <|endoftext|> 漢字", "fr", "c", 40),
    (-12, "word", "en", "a", 4),
    (13, "word", "en", "a", 4),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["kept", "n_words", "score", "slot", "shard", "component_id", "th", "cuts", "block", "_id", "_th", "_cuts", "_text", "_n", "_source", "_copies", "_copy", "gone_id"]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def clashing(awkward):
    from pyspark.sql import functions as F

    return awkward.withColumns({c: F.lit(f"extra {c}") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture
def same_as_sql(tmp_path):
    def check(got, sql, **tables):
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        for name, source in tables.items():
            if not isinstance(source, str):
                path = str(tmp_path / name)
                source.coalesce(1).write.parquet(path)
                source = f"{path}/*.parquet"
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
        rel = con.sql(sql)
        columns = sorted(got.columns)
        assert columns == sorted(rel.columns)
        order = [list(rel.columns).index(c) for c in columns]
        rows = [tuple(r) for r in got.select(*columns).collect()]
        assert compare(rows, [tuple(r[i] for i in order) for r in rel.fetchall()]) == ""
        return rows

    return check
