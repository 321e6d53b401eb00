"""Sources and sinks: CSV with a fixed schema, malformed lines, result
tables, and the stream's dead-letter branch."""

import os
import tempfile

from innsight.sources.bookings import read_bookings
from innsight.sources.tables import read_table, write_table
from innsight.schema import BOOKING_COLUMNS

HEADER = ",".join(n for n, _ in BOOKING_COLUMNS)
GOOD = ("INN00001,2,0,1,2,Meal Plan 1,0,Room_Type 1,30,2018,6,15,Online,0,0,0,99.5,1,"
        "Not_Canceled")
BAD = "INN00002,two,0,1,2,Meal Plan 1,0,Room_Type 1,30,2018,6,15,Online,0,0,0,99.5,1,Canceled"


def test_csv_fixed_schema_and_corrupt_lines(spark):
    d = tempfile.mkdtemp(prefix="innsight-csv-", dir="/tmp")
    with open(os.path.join(d, "b.csv"), "w") as fh:
        fh.write("\n".join([HEADER, GOOD, BAD]) + "\n")
    df = read_bookings(spark, d, "csv", corrupt_col="_corrupt").cache()
    rows = {r["Booking_ID"]: r for r in df.collect()}
    assert rows["INN00001"]["avg_price_per_room"] == 99.5 and rows["INN00001"]["_corrupt"] is None
    assert rows["INN00002"]["no_of_adults"] is None and rows["INN00002"]["_corrupt"] == BAD
    from innsight.operators.audit import missingness
    nulls = {r["column_name"]: r["n_null"] for r in missingness(df.drop("_corrupt")).collect()}
    assert nulls["no_of_adults"] == 1


def test_result_table_round_trip(spark):
    df = spark.createDataFrame([("a", 1.5, 2)], "k string, v double, n bigint")
    for fmt in ("parquet", "csv"):
        path = write_table(df, f"t_{fmt}", fmt=fmt)
        back = read_table(spark, path, df.schema, fmt)
        assert back.collect() == df.collect()


def test_stream_dead_letter_for_malformed_requests(spark):
    from innsight.streaming.score_stream import REQUEST_SCHEMA
    from innsight.operators.audit import split_valid, validate_bookings
    d = tempfile.mkdtemp(prefix="innsight-req-", dir="/tmp")
    with open(os.path.join(d, "r.json"), "w") as fh:
        fh.write('{"Booking_ID": "x1", "no_of_adults": "many"}\n{not json\n')
    batch = spark.read.schema(REQUEST_SCHEMA).json(d)
    ok, bad = split_valid(validate_bookings(batch))
    assert ok.count() == 0 and bad.count() == 2
    assert all("field required" in " ".join(r["errors"]) for r in bad.collect())
