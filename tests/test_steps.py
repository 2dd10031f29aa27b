"""Plans and steps of queries that grow with the tables: what is read once, computed once and dealt over all tasks."""

import pytest
from pyspark.sql import SparkSession

from loomseq.jobs.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_event_strings_are_made_in_one_pass(spark):
    assert plan(QUERIES["a6_inputs"](spark, SF)).count("Relation") == 4  # fragments, support, records and events


def test_each_latent_state_is_a_step_of_its_own(spark):
    assert plan(QUERIES["f39_latent"](spark, SF)).count("Generate explode") >= 6


def test_flanks_are_dealt_over_all_tasks(spark):
    assert QUERIES["f_flanks"](spark, SF).rdd.getNumPartitions() == 4


def test_events_of_a_segmentation_are_made_once(spark):
    assert plan(QUERIES["f30_segmentation"](spark, SF)).count("n_chars#") <= 3  # the reference's chunks only; windows, places and results read what was written


def test_a_clip_is_compared_once(spark):
    assert plan(QUERIES["f32_concordance"](spark, SF)).count("levenshtein(") == 1
