import pytest

from basketry.llm._ship import ship


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)
