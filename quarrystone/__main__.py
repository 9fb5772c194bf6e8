import sys

from pyspark.sql import SparkSession

from quarrystone.cli import main

sys.exit(main(sys.argv[1:], SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()))
