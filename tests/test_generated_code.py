"""The JVM interprets methods of 8,000 bytes and more; queries should not generate one."""

import re

import pytest

from wardlens.catalog.queries import QUERIES


@pytest.fixture
def planned_at_once(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", before)


#: Still longer, by 400 to 800 bytes: q16 formats the 27 indicators; the others make labels and texts in the one
#: step that unfolds the slots. Their line packing is compiled.
LONGER = {"q16_indicator_table", "q35_ward_listing", "q39_ward_listing_rest", "q59_text_dates"}


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - LONGER))
def test_methods_are_small_enough_to_be_compiled(spark, sample, planned_at_once, name):
    plan = QUERIES[name](spark, sample)._jdf.queryExecution()
    told = spark._jvm.PythonSQLUtils.explainString(plan, "codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", told)]
    assert sizes and max(sizes) < 8000
