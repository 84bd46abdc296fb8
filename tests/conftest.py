from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


SALES_COLUMNS = "id string, day string, region string, product string, units int, revenue long, cost double"


@pytest.fixture(scope="session")
def shop(spark):
    """A small shop whose figures are easy to add up by hand."""
    rows = [
        ("S-1", "2025-01-05", "North", "Tea", 2, 100, 60.0),
        ("S-2", "2025-01-20", "North", "Cake", 1, 50, 20.0),
        ("S-3", "2025-02-03", "South", "Tea", 4, 200, 120.0),
        ("S-4", "2025-02-14", "north ", "Coffee", 3, 90, 45.0),
        ("S-5", "2025-03-09", "South", "Cake", 2, 100, 40.0),
        ("S-6", "2025-03-30", "West", "Coffee", 10, 300, 150.0),
        ("S-7", "2025-04-01", None, "Tea", None, None, 5.0),
    ]
    return spark.createDataFrame(rows, SALES_COLUMNS)
