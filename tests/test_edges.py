"""Questions whose words end at letters beyond ASCII, or at points, held against the queries' own SQL."""

import pytest
from oracle import by_sql, rows

from sparkwell.catalogue import ORACLE, QUERIES

STOPS = ["La. Ètion ré. Ouier, an", "La. Ai. un", "La-b Ou&c un", "A.B.é C.D.e un", "Ab- Cd& un", "Abc Déf", "Abc. Def.", "$5 un", "12.é"]
ACRONYMS = ["die ungö SSö tzß er heit keit", "ÉTAT de la vie pour une que", "UN de la vie pour une que", "XX_ de la vie pour une que", "aBB de la vie pour une que", "ö ß"]


def with_questions(data, folder, spark, texts) -> str:
    import os

    for name in os.listdir(data):
        if not name.startswith("benchmark"):
            os.symlink(f"{data}/{name}", f"{folder}/{name}")
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("name, texts", [("hybrid_weighted", ACRONYMS), ("query_routes", STOPS)])
def test_edges_of_words(spark, data, tmp_path, name, texts):
    folder = with_questions(data, tmp_path, spark, texts)
    assert rows(QUERIES[name](spark, folder).toPandas()) == rows(by_sql(ORACLE[name], folder))
