import pytest

from terroir.llm import queries
from tests.compare import same

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, sf_dir, duck):
    same(queries.queries()[name](spark, sf_dir), duck, SQL[name])


COLUMNS = {
    "p1_found": ["lot_id", "match_numero", "match_etiquette", "match_periode"], "p2_found": ["mart", "edition", "lieu", "annee", "type_local"], "p3_found": ["lot_id", "numero_dpe"], "p5_found": ["lot_a", "lot_b"], "p7_ids": ["doc_id", "ids"],
    "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs(name, spark, sf_dir):
    df = queries.queries()[name](spark, sf_dir)
    assert df.count() > 0
    assert name not in COLUMNS or df.columns == COLUMNS[name]
