import pytest
from support import SMALL, same_rows

from vellum.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    same_rows(catalogue.QUERIES[name](spark, SMALL).toPandas(), duck.execute(catalogue.ORACLES[name]).fetchdf())
