"""Invoice CSV ingestion: null spellings, id as double, lenient dates, file rank."""

import datetime as dt
import os
import tempfile

from tillroll.operators import clean
from tillroll.sources.retail import csv_bad_counts, csv_bad_fields, read_invoice_csv

HEADER = "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"


def _write(text):
    d = tempfile.mkdtemp(prefix="tillroll-csv-")
    p = os.path.join(d, "f.csv")
    with open(p, "w") as fh:
        fh.write(HEADER + text)
    return p


def test_null_spellings_and_id(spark):
    p1 = _write('489434,85048,"",12,12/1/2009 7:45,6.95,13085.0,United Kingdom\n'
                '489435,22350,,2,12/1/2009 7:46,2.1,NA,France\n'
                '489436,22351,NA,3,bad,2.5,,EIRE\n')
    p2 = _write('489434,85048,"other",12,12/1/2009 7:45,6.95,13085.0,United Kingdom\n')
    df = read_invoice_csv(spark, [p1, p2])
    rows = sorted(df.collect(), key=lambda r: (r["src_rank"], r["Invoice"]))
    assert [r["Description"] for r in rows[:3]] == [None, None, None]
    assert rows[0]["CustomerID"] == 13085 and rows[1]["CustomerID"] is None
    assert [r["src_rank"] for r in rows] == [1, 1, 1, 2]
    sc = clean.clean_lines(df).collect()
    dates = sorted(((r["Invoice"], r["InvoiceDate"]) for r in sc), key=lambda x: x[0])
    assert dates[0] == ("489434", dt.datetime(2009, 12, 1, 7, 45))
    assert dates[2] == ("489436", None)
    # the duplicate of 489434 from the second file is dropped; the first file's row is kept
    assert len([r for r in sc if r["Invoice"] == "489434"]) == 1


def test_bad_fields_are_quarantined(spark):
    p1 = _write('1,A,"x, y",12,12/1/2009 7:45,6.95,13085.0,France\n'
                '2,A,x,1O,12/1/2009 7:45,6.95,13085.0,France\n'
                '3,A,x,3,tomorrow,cheap,NA,France\n'
                '4,A,x,3\n'
                '5,A,x,3,12/1/2009 7:45,1,2,France,more,fields\n'
                '6,A,,NA,,,,\n')
    p2 = _write('1,A,x,?,12/1/2009 7:45,1,abc,France\n')
    bad = csv_bad_fields(spark, [p1, p2]).collect()
    assert sorted((r["src_rank"], r["column"] or "", r["value"] or "") for r in bad) == [
        (1, "", ""), (1, "", ""), (1, "InvoiceDate", "tomorrow"), (1, "Price", "cheap"), (1, "Quantity", "1O"),
        (2, "Customer ID", "abc"), (2, "Quantity", "?")]
    lines = {r["line"] for r in bad if r["column"] is None}
    assert lines == {"4,A,x,3", "5,A,x,3,12/1/2009 7:45,1,2,France,more,fields"}
    assert next(r["line"] for r in bad if r["value"] == "1O") == "2|A|x|1O|12/1/2009 7:45|6.95|13085.0|France"
    counts = {(r["src_rank"], r["column"]): (r["n_fields"], r["n_values"]) for r in csv_bad_counts(
        csv_bad_fields(spark, [p1, p2])).collect()}
    assert counts[1, "Quantity"] == (1, 1) and counts[1, None] == (2, 0)
    rows = {(r["src_rank"], r["Invoice"]): r for r in read_invoice_csv(spark, [p1, p2]).collect()}
    assert len(rows) == 7 and rows[1, "2"]["Quantity"] is None and rows[2, "1"]["CustomerID"] is None
    assert csv_bad_fields(spark, _write("")).count() == 0
