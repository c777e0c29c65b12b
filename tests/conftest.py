import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    # tiny tables: compiling whole stages would take longer than running them
    s = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").config("spark.sql.codegen.wholeStage", "false")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s
