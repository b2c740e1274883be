import os
import sys
from dataclasses import replace

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from demandspark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def case_sensitive(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")


@pytest.fixture(scope="module")
def one_ranking_input(spark):
    """Let the queries of a module share the written ranking input instead of rebuilding it each time."""
    from demandspark.plans import registry

    build, built = registry.ranking_data, {}

    def shared(session, sf):
        if sf not in built:
            built[sf] = build(session, sf)
        return built[sf]

    whole = registry.STUDY
    registry.ranking_data = shared
    registry.STUDY = replace(whole, forecast_iterations=2, ranker_iterations=2)  # the statements hold for any fit
    yield
    registry.ranking_data, registry.STUDY = build, whole
