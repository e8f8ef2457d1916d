"""Operators that SQL can express, against it, on rows with what the tables hardly have."""

import pytest

from glyphsift.llm import licenses, queries
from tests.llm.test_operators import ITEM, prose
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    other = ITEM.replace("Anna", "Maria").replace("12", "40").replace("Tom", "Bob").replace("dollars", "euros")
    texts = [None, "", ITEM, other, other.replace("gave 40", "gave 41"), prose(90, 1) + " " + ITEM.lower(), "x short item text y", ITEM + " so " + other, " ".join(ITEM.split()[4:18])]
    texts += [n for _, n in licenses.NOTICES] + [n.replace(" of ", " of the ") for _, n in licenses.NOTICES] + ["under the MIT License " * 3 + "cc-by-nc, apache license version 2"]
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    write(list(enumerate(texts)), "doc_id bigint, text string", "documents")
    write([(1, ITEM), (2, "Short item text."), (3, None), (4, prose(12, 8))], "item_id bigint, text string", "benchmark")
    write([(k, [float(k % 7), k / 10, -1.0]) for k in range(250)] + [(300, None), (400, [float("nan")] * 3)], "vec_id bigint, embedding array<float>", "embeddings")
    return at


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, folder, name):
    assert_same(connect(folder, ["documents", "benchmark", "embeddings"]), queries.queries()[name](spark, str(folder)), queries.oracle_sql()[name])
