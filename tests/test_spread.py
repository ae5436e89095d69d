"""Work on each row runs in as many tasks as shuffles have, also where one task reads a file; and each text is judged once."""

import pytest

from glossaria.operators import chains, joins
from glossaria.plans import projects, registry
from glossaria.sources import locales

Q = registry.queries()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["best_component_texts", "selection_keys", "harvested_texts", "best_harvested_text"])
def test_harvest_is_spread(spark, sf, name):
    text = plan(Q[name](spark, sf))
    assert 0 <= text.find("Generate explode") < text.find("RepartitionByExpression")


def test_keys_are_looked_up_without_sorting_tries(spark):
    items = spark.createDataFrame([(1, "A", "button", "Save"), (1, "A", "link", "Go"), (2, "B", "link", "Go"), (3, None, "link", None)], "id int, ns string, kind string, text string")
    keys = spark.createDataFrame([("Commons", "button", "Save", "c"), ("A", "link", "Go", "b"), ("A", "link", "Go", "a"), ("Commons", "text", "Go", "t")], "ns string, kind string, text string, key string")
    found = joins.key_lookup(items, keys)
    assert {(r.id, r.text, r.key) for r in found.collect()} == {(1, "Go", "a"), (1, "Save", "c"), (2, "Go", "t"), (3, None, None)}
    assert "min_by" not in plan(found)


def test_shapes_of_distinct_words_only(spark, sf):
    """No word is judged below the step that makes words distinct."""
    lines = plan(Q["word_shapes"](spark, sf)).split("\n")
    at = next(i for i, x in enumerate(lines) if "Aggregate [word" in x)
    assert "RLIKE" in "".join(lines[: at + 1]) and "RLIKE" not in "".join(lines[at + 1 :])


def test_a_line_is_split_once(spark, sf):
    text = plan(Q["english_words"](spark, sf))
    assert text.count("split(trim") == 1 and text.find("Generate explode") < text.find("RepartitionByExpression")


def test_scanned_components_are_spread(spark, sf):
    text = plan(Q["component_texts"](spark, sf))
    assert 0 <= text.find("MapInPandas") < text.find("RepartitionByExpression")


def test_flattened_rows_are_spread(spark):
    rows = spark.createDataFrame([(i, '{"a": {"b": "x"}, "c": "y"}') for i in range(50)], "id int, props string").coalesce(1)
    found = locales.flatten(rows, "props", ["id"])
    assert "RepartitionByExpression" in plan(found)
    assert sorted(map(tuple, found.collect())) == sorted([(i, "a.b", "x") for i in range(50)] + [(i, "c", "y") for i in range(50)])


def test_innermost_without_other_columns_joins_once(spark):
    rows = spark.createDataFrame([("a", 1, 9), ("a", 2, 3), ("a", 2, 3), ("a", 4, 5), ("a", None, 5), ("a", 6, None), ("b", 1, 1)], "file string, start long, end long")
    found = chains.innermost(rows)
    assert sorted(map(tuple, found.collect())) == [("a", 4, 5), ("b", 1, 1)]
    assert "LeftSemi" not in plan(found)


def test_pages_are_written_by_several_tasks(spark, sf):
    names = [p.rsplit("/part-", 1)[1] for p, _ in locales.listed(spark, projects._tree(spark, sf), "*.txt", ())]
    assert len({n[:5] for n in names}) > 1 and len(names) == spark.read.parquet(f"{sf}/pages.parquet").count()


def test_scanned_paths_are_looked_at_by_few_tasks(spark, sf):
    tasks, path = "spark.sql.sources.parallelPartitionDiscovery.parallelism", projects._tree(spark, sf)
    before, track = spark.conf.get(tasks), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("scanned", "")
    try:
        found = locales.scan(spark, path, "*.txt")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = [track.getStageInfo(k).numTasks for j in track.getJobIdsForGroup("scanned") for k in track.getJobInfo(j).stageIds]
    assert jobs and max(jobs) <= 4
    assert spark.conf.get(tasks) == before
    assert found.count() == len(locales.listed(spark, path, "*.txt")) > 32
