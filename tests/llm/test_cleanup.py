import os

from keelmark import session
from keelmark.llm import runtime
from keelmark.llm.exact_dedup import exact_duplicates
from keelmark.llm.fuzzy_lines import fuzzy_lines
from keelmark.llm.passages import remove_repeats
from tests.llm.cases import edge_frame


def test_nothing_is_left_behind(spark):
    folders, tables = list(session._folders), list(runtime._tables)
    session._folders[:], runtime._tables[:] = [], []
    before = {t.name for t in spark.catalog.listTables()}
    try:
        for made in (fuzzy_lines, remove_repeats, exact_duplicates):
            assert made(edge_frame(spark)).count()
        written = list(session._folders)
        assert all(os.path.exists(path) for path in written) and {t.name for t in spark.catalog.listTables()} > before
        runtime.remove_intermediates(spark)
        assert not any(os.path.exists(path) for path in written)
        assert {t.name for t in spark.catalog.listTables()} == before
        assert not session._folders and not runtime._tables
    finally:
        session._folders[:], runtime._tables[:] = folders, tables
