from __future__ import annotations

from claimsieve.sources import statements


def test_statement_file(spark, tmp_path):
    lines = [
        '1.json\tmostly-true\tHe said "no" twice\ttax\tann\tNone\tOhio\tparty\t1\t2.0\t3\t4\t5\thall',
        '2.json\tfalse\t"Two ""quoted""\nlines"\ttax\tbob\tNA\t\tnone\t0\t0\t0\t0\t0\tna',
        "3.json\ttrue\tN/A\ttax\tcy\tclerk\tOhio\tparty\t0\t0\t0\t0\t0\thall",
        "4.json\t\tshort row",
    ]
    path = tmp_path / "rows.tsv"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    rows = {r["id"]: r for r in statements.load_statements(spark, str(path)).collect()}
    assert set(rows) == {"1.json", "2.json", "4.json"}
    assert rows["1.json"]["statement"] == 'He said "no" twice' and rows["1.json"]["job"] is None
    assert rows["2.json"]["statement"] == 'Two "quoted"\nlines' and rows["2.json"]["party"] == "none"
    assert rows["2.json"]["state"] is None and rows["2.json"]["venue"] == "na"
    assert [rows[i]["label"] for i in ("1.json", "2.json", "4.json")] == [1, 0, 0]
    assert rows["1.json"]["false_c"] == 2.0 and rows["4.json"]["false_c"] is None
