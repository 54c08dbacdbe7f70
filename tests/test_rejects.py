import pyarrow as pa

from helixframe.operators import rejects

SEQ = "ACGTACGTACGTACGTAC"


def run(lines):
    reason, fields, bad = rejects.parse_block(pa.array(lines, pa.string()), rejects.SRNA_LINES)
    return reason.to_pylist(), [f.to_pylist() for f in fields], bad.to_pylist()


def test_reasons_in_order_of_precedence():
    lines = [
        f"m\t{SEQ}", f"m\t{SEQ}\r", f'"a\tb"\t{SEQ}', f'"a ""x"""\t {SEQ.lower()} ', f'a"b\t{SEQ}', f'"a\t{SEQ}', f'"a"x\t{SEQ}',
        f"a {SEQ}", f"a\t{SEQ}\tx", "a\tACGT", "a\t", "", " \t ", None, "#x", "  # y", "Name\t sequence ", '"name"\t"SEQUENCE"', f"\t{SEQ}",
    ]
    reason, (name, seq), bad = run(lines)
    assert reason == [None, None, None, None, "quoting", "quoting", "quoting", "column_count", "column_count", "invalid_value", "invalid_value",
                      "skip", "skip", "skip", "skip", "skip", "skip", "skip", None]
    assert name[:4] == ["m", "m", "a\tb", 'a "x"'] and seq[3] == SEQ.lower() and name[-1] == ""
    assert bad[9] == "sequence"


def test_line_breaks_byte_order_marks_and_long_lines_are_text():
    long = "x" * 2_000_000
    lines = [f"﻿m\t{SEQ}", f"a\nb\t{SEQ}", f"a\rb\t{SEQ}", f"{long}\t{SEQ}", f'"a\nb"\t{SEQ}', f"\n\t{SEQ}"]
    reason, (name, _), _ = run(lines)
    assert reason == [None] * 6
    assert name == ["﻿m", "a\nb", "a\rb", long, "a\nb", ""]


def test_only_rejected_lines_and_empty_input():
    assert run(["x", "y"])[0] == ["column_count"] * 2
    assert run([])[0] == []


def test_casts_label_the_failing_cell():
    fmt = rejects.LineFormat(fields=("a", "b"), casts={"a": "bigint", "b": "double"}, skip_header=False)
    reason, _, bad = rejects.parse_block(pa.array(["1\t2.5", "x\t1", "1\tx"]), fmt)
    assert reason.to_pylist() == [None, "invalid_value", "invalid_value"] and bad.to_pylist() == [None, "a", "b"]


def test_clashing_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "keep", f"m\t{SEQ}"), (2, None, "bad"), (2, None, "bad"), (3, "n", None)], "id long, name string, reason string")
    out = rejects.parse_lines(df, "reason", ["id", "name"], rejects.SRNA_LINES)
    rows = sorted((r.id, r.name, r.record and r.record.name, r.reason) for r in out.collect())
    assert rows == [(1, "keep", "m", None), (2, None, None, "column_count"), (2, None, None, "column_count")]
    assert rejects.parse_lines(df.limit(0), "reason", ["id"], rejects.SRNA_LINES).count() == 0


def test_the_plan_has_no_exchange(spark, sf):
    from helixframe.plans.data_queries import p1_found

    plan = p1_found(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
