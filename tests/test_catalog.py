import pytest
from oracle import of_spark, of_sql
from pyspark.sql import functions as F

from lectern.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    assert of_spark(catalog.QUERIES[name](spark, SF)) == of_sql(catalog.SQL[name], SF)


def test_flagship(spark):
    out = catalog.flagship(spark, SF)
    assert out.columns == ["chunk_id", "document_id", "score", "rank_no"]
    assert [r.rank_no for r in out.orderBy("rank_no").collect()] == list(range(1, out.count() + 1))


def test_entry_point():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_document_permissions_reach_what_collections_grant(spark):
    out = {r.document_id: r for r in catalog.QUERIES["document_permissions"](spark, SF).collect()}
    readable = {r.id for r in catalog.QUERIES["readable_documents"](spark, SF).collect()}
    assert "ROLE_COLLECTION_GRANT" in out[12].rules and out[12].can_read
    cached = {r.document_id for r in catalog.Tables(spark, SF).access_cache.filter("user_id = 7").collect()}
    assert readable - cached <= {d for d, r in out.items() if r.can_read}


def test_whole_tables_are_covered(spark):
    t = catalog.Tables(spark, SF)
    count = lambda name: catalog.QUERIES[name](spark, SF).count()
    assert count("all_user_role_codes") == t.users.count()
    assert {r.user_id % 2 for r in catalog.QUERIES["insert_all_absent"](spark, SF).collect()} == {0, 1}
    assert count("align_all_series") >= t.events.filter("event_type <> 'click'").select(F.date_trunc("hour", "ts")).distinct().count()
