"""Micro table M (FIXTURES.md section 4): twelve hand-made readings around a year end."""

import datetime as dt

ROWS = [
    (1, dt.datetime(2020, 12, 31, 23, 30), 100),
    (2, dt.datetime(2021, 1, 1, 0, 10), 0),
    (3, dt.datetime(2021, 1, 1, 21, 30), 20000),
    (4, dt.datetime(2021, 1, 3, 3, 0), 0),
    (5, dt.datetime(2021, 1, 3, 10, 0), 499),
    (6, dt.datetime(2021, 1, 3, 10, 45), 500),
    (7, dt.datetime(2021, 1, 4, 3, 0), 0),
    (8, dt.datetime(2021, 1, 4, 17, 59), 4999),
    (9, dt.datetime(2021, 1, 4, 18, 0), 5000),
    (10, dt.datetime(2021, 1, 10, 10, 0), 19999),
    (11, dt.datetime(2021, 1, 10, 21, 0), 31549),
    (12, dt.datetime(2021, 1, 11, 11, 0), 31550),
]


def micro_readings(spark):
    from hourwise.sources.readings import READINGS_SCHEMA

    return spark.createDataFrame(ROWS, READINGS_SCHEMA)
