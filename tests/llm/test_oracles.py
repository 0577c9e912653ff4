"""Operators' queries against their SQL, on the smallest tables and on hand-made ones."""

import os

import duckdb
import pytest

from lodeframe.llm import queries
from tests.conftest import TESTDATA
from tests.test_oracle import duck, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    ours, theirs = queries.QUERIES[name](spark, TESTDATA).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and rows(ours) == rows(theirs)


def test_quotes_equal_sql_where_there_are_quotes(spark, tmp_path):
    said = ["how do range joins work in this engine?", "they sort both sides\nand then sweep over them once", "what about memory use of the sweep?", "bounded by the depth of nesting"]
    lines = []
    for conv in range(12):
        for turn in range(8):
            text = said[(conv + turn) % 4] + (f" {conv % 2}" if turn % 3 else "")
            if turn:
                earlier = lines[-1 - (conv * turn) % min(turn, 3)][3]
                quoted = "\n".join("> " + x for x in earlier.split("\n"))
                text = f"On Friday, X wrote:\n{quoted}\n\n{text}" if turn % 2 else f"{text}\n{quoted}\n\nthanks {turn}"
            lines.append((conv, turn, "user", text))
    frame = spark.createDataFrame(lines, "conv_id long, turn long, role string, text string")
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    ours, theirs = queries.op1_quotes(spark, str(tmp_path)).toPandas(), con.sql(queries.ORACLES["op1_quotes"]).df()
    assert rows(ours) == rows(theirs) and ours["n_linked"].sum() > 50 and ours["depth"].max() > 2
    assert os.path.exists(tmp_path)
