import pytest


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import session

    s = session("local[4]", 4, **{"spark.driver.memory": "4g", "spark.sql.warehouse.dir": "/tmp/tidemark-warehouse"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
