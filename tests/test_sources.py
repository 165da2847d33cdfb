"""Payroll books as they come: quoted line breaks, ragged rows, many files."""

import csv
import io
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from anualia import jobs
from anualia.operators.quality import ValidationError
from anualia.params import Declaration
from anualia.plans import payroll
from anualia.sources import quoted_records
from anualia.sources.listing import list_files
from anualia.sources.payroll_csv import book_rejects, payroll_book
from workload.queries import split_size

MONTHS = ["octubre", "noviembre", "diciembre"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.booleans()), min_size=1, max_size=20), st.booleans())
def test_states_after_lines(lines, start):
    state, want = start, []
    for opens, stays in lines:
        state = stays if state else opens
        want.append(state)
    opens, stays = (np.array(c) for c in zip(*lines))
    assert quoted_records._after(opens, stays, start).tolist() == want


CELLS = ["", "a", 'a"b', '"', '""', "x;y", "l1\nl2", "\n", 'q"\n;"', "\r\n", "é\nñ", "tail\n\n", '";"']


def book(rows, encoding="utf-8"):
    """Cells of the contract end in a book, quoted where they need it."""
    out = io.StringIO()
    writer = csv.writer(out, delimiter=";", lineterminator="\r\n")
    writer.writerow(payroll.BOOK_COLUMNS)
    for n, end in enumerate(rows):
        writer.writerow([f"{n}-1", end, *["1000"] * (len(payroll.BOOK_COLUMNS) - 2)])
    return out.getvalue().encode(encoding)


def write_books(folder, books):
    paths = []
    for month, text in zip(MONTHS, books):
        (folder / f"lre_{month}.csv").write_bytes(text)
        paths.append(str(folder / f"lre_{month}.csv"))
    return paths


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1", "utf-8-sig"])
def test_quoted_line_breaks_over_splits(spark, tmp_path, encoding):
    rng = random.Random(len(encoding))
    rows = [[rng.choice(CELLS) for _ in range(400)] for _ in MONTHS]
    rows[1][5] = "very long\n" * 3000  # a cell over several whole splits
    rows[2][-1] = "last\nline"
    books = [book(r, encoding) for r in rows]
    books[2] = books[2].removesuffix(b"\r\n")
    paths = write_books(tmp_path, books)
    with split_size(spark, "7k"):
        got = payroll_book(spark, paths).orderBy("ord").select("ARCHIVO_ORIGEN", F.col(f"`{payroll.COL_RUT}`"), F.col(f"`{payroll.COL_CONTRACT_END}`")).collect()
    want = [(f"lre_{m}.csv", f"{n}-1", end or None) for m, own in zip(MONTHS, rows) for n, end in enumerate(own)]
    assert [tuple(r) for r in got] == want


def test_books_with_and_without_line_breaks_together(spark, tmp_path):
    paths = write_books(tmp_path, [book(["a", "b"]), book(["c\nd"]), book(["e"], "latin-1")])
    ends = [r[0] for r in payroll_book(spark, paths).orderBy("ord").select(F.col(f"`{payroll.COL_CONTRACT_END}`")).collect()]
    assert ends == ["a", "b", "c\nd", "e"]


def test_rows_with_too_many_cells_stop_the_job(spark, tmp_path):
    plain, broken = book(["a"]), book(["b\nb"])
    short = plain + b"2-2;x\r\n"
    for name, books in {
        "line": [plain, plain + b"9-9;" + b"1;" * 20 + b"1\r\n", plain], "record": [plain, broken + b'8-8;"x\ny";' + b"1;" * 19 + b"1\r\n", plain],
    }.items():
        (tmp_path / name).mkdir()
        paths = write_books(tmp_path / name, books)
        with pytest.raises(ValidationError, match="more cells") as caught:
            jobs.run_payroll(spark, paths, str(tmp_path / name / "out"), Declaration("Ana", "12.345.678-5"))
        found = caught.value.issues.collect()
        assert [(r["file_name"], r["cells"], r["expected"]) for r in found] == [("lre_noviembre.csv", 22, 21)]
        assert found[0]["record"].startswith({"line": "9-9;1;", "record": '8-8;"x\ny";'}[name])
    (tmp_path / "fine").mkdir()
    paths = write_books(tmp_path / "fine", [plain, short, plain])
    assert book_rejects(spark, paths).count() == 0
    assert payroll_book(spark, paths).where(F.col(f"`{payroll.COL_TAX}`").isNull()).count() == 1


def test_a_cell_that_never_ends_stops_the_job(spark, tmp_path):
    paths = write_books(tmp_path, [book(["a"]), book(["a"]), book(["a"]) + b'3-3;"open\r\nand on'])
    with pytest.raises(ValidationError, match="never ends"):
        payroll_book(spark, paths)


def test_other_files_are_no_books(spark, tmp_path):
    paths = write_books(tmp_path, [book(["a"]), b"a;b\n1;2\n", book(["a"])])
    with pytest.raises(ValidationError, match="not a payroll book"):
        payroll_book(spark, paths)


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    def jobs_of(parts):
        paths = []
        for month in MONTHS:
            folder = tmp_path / f"{parts}" / f"lre {month} +1"
            folder.mkdir(parents=True)
            for k in range(parts):
                (folder / f"part {k:03d}%.csv").write_bytes(book([f"{month}{k}"]))
            paths.append(str(folder))
        spark.sparkContext.setJobGroup(f"books-{parts}", "")
        rows = payroll_book(spark, paths).collect()
        ran = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"books-{parts}"))
        spark.sparkContext.setJobGroup("", "")
        assert len(rows) == 3 * parts and {r["ARCHIVO_ORIGEN"] for r in rows} == {f"lre {m} +1" for m in MONTHS}
        return ran

    assert jobs_of(12) == jobs_of(40)


def test_files_of_inputs_in_order(spark, tmp_path):
    for p in ("b/x/2.txt", "b/1.txt", "a.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("t")
    inputs = [str(tmp_path / "b") + "/", f"file://{tmp_path}/a.txt"]
    rows = list_files(spark, inputs).orderBy("file_no").collect()
    assert [(r["file_path"].rsplit("/", 1)[-1], r["file_no"], r["input_no"], r["file_name"]) for r in rows] == [
        ("1.txt", 0, 0, "b"), ("2.txt", 1, 0, "b"), ("a.txt", 2, 1, "a.txt"),
    ]
