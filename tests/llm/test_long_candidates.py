"""Candidates whose first digit or letter comes late."""

from policylake.llm import secrets


def test_late_digit_and_late_letter(spark):
    runs = ["a" * 201 + "1" * 20, "1" * 300 + "b", "x" * 50_000 + "7", "c" * 400, "2" * 400]
    d = spark.createDataFrame([(i, f"key = {r} end") for i, r in enumerate(runs)], "doc_id long, text string")
    got = {r.doc_id: (r.start, r.candidate) for r in secrets.candidates(d, keep=("doc_id",)).collect()}
    assert got == {i: (6, runs[i]) for i in range(3)}
