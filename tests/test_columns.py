import datetime

import pytest
from pyspark.sql import functions as F

from packetlake.functions.columns import bounded_int, parse_captured_at
from packetlake.operators.labels import normalize_label


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize("text, number", [
    ("12", 12), (" 12 ", 12), ("12.0", 12), ("1e3", 1000), ("12d", None), ("12f", None), ("1.5", None),
    ("", None), ("nan", None), (None, None),
])
def test_whole_numbers(spark, text, number):
    assert one(spark, text, bounded_int) == number


@pytest.mark.parametrize("text, want", [
    ("14/02/2018 08:31:01", (2018, 2, 14, 8, 31, 1)), ("02/14/2018 08:31:01 PM", (2018, 2, 14, 20, 31, 1)),
    ("2018-02-14T08:31:01Z", (2018, 2, 14, 8, 31, 1)), ("14/02/2018 8:31", (2018, 2, 14, 8, 31)),
    ("12:00", None), ("not-a-time", None), (None, None),
])
def test_times(spark, text, want):
    assert one(spark, text, parse_captured_at) == (want and datetime.datetime(*want))


@pytest.mark.parametrize("text, code", [
    ("DDoS\t", "DOS"), (" DDoS\n", "DOS"), ("\tbot", "R2L"), ("\r\n", "BENIGN"), (None, "BENIGN"),
])
def test_labels_between_white_space(spark, text, code):
    assert one(spark, text, normalize_label) == code
