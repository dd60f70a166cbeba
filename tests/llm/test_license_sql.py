"""The SQL of the license scan against the operator, on notices that are wrapped and lines that only look like one."""

from __future__ import annotations

import duckdb

from shelfmargin.llm.license_scan import OP10_SQL, SHORT_FORMS, TEMPLATES, scan


def test_sql_and_operator_agree_on_wrapped_notices(spark):
    texts = [None, "", " ", "x", "all rights\nreserved CC-BY", "Er kam mit der License.", "the license of apache under"]
    for notice in [text for group in (TEMPLATES, SHORT_FORMS) for found in group.values() for text in found]:
        words = notice.split()
        texts += [notice.upper(), "\n// ".join(words), " ".join(reversed(words)), f" {'x ' * 30}".join(words)]
        texts += ["y " * k + " ".join(words[k:]) + "\nz" * 40 for k in range(0, len(words), 2)]
    rows = [(k, text) for k, text in enumerate(texts)] + [(3, "x"), (None, "under the mit license")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = scan(table)
    with duckdb.connect() as connection:
        connection.register("documents", table.toArrow())
        relation = connection.sql(OP10_SQL)
        assert got.columns == relation.columns
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, relation.fetchall()))
    labels = {row.doc_id: row.labels for row in got.collect()}
    assert (labels[4], labels[5], labels[6], labels[None]) == ("cc-by,reserved", "", "", "mit")
    assert {name for row in labels.values() for name in row.split(",") if name} == {*TEMPLATES, "reserved"}
