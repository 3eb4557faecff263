import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

import pytest  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def corpus4(spark):
    rows = [
        (1, "Python Basics", "Python is a high level programming language. Python supports machine learning and data science.", "test1"),
        (2, "Java Guide", "Java is a programming language for enterprise software. Java runs on a virtual machine.", "test2"),
        (3, "Web Development", "Web development with Python frameworks and Javascript tools.", "test3"),
        (4, "Data Science", "Data science combines statistics, machine learning and programming.", "test4"),
    ]
    return spark.createDataFrame([(*r, None) for r in rows], "doc_id long, title string, body string, source string, created_at timestamp")
