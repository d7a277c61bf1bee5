from __future__ import annotations

import io
from contextlib import redirect_stdout
from datetime import datetime, timedelta

from tallyrun.operators import lists

START = datetime(2024, 1, 1)


def runs(spark, rows):
    return spark.createDataFrame([(i, p, s, START + timedelta(minutes=m)) for i, p, s, m in rows], "id long, player_id long, scenario_id long, written_at timestamp")


def test_pages_by_cursor_make_the_list(spark):
    rows = [(i, i % 3, i % 2, i // 7) for i in range(120)]  # many runs written at once
    table = lists.page_table(runs(spark, rows))
    for whose in ({"player_id": 1}, {"player_id": 2, "scenario_id": 0}):
        wanted = [i for m, i in sorted(((m, i) for i, p, s, m in rows if p == whose["player_id"] and s == whose.get("scenario_id", s)), reverse=True)]
        got, at = [], None
        while True:
            shown = lists.page(table, before=at, size=7, **whose)
            got += [r["id"] for r in shown.where("NOT ahead").orderBy("row_no").collect()]
            at = lists.cursor(shown, 7)
            if at is None:
                break
        assert got == wanted
    assert lists.cursor(lists.page(table.limit(0))) is None


def test_cursor_reaches_the_scan(spark):
    table = lists.page_table(runs(spark, [(i, 1, 1, i) for i in range(50)]))
    out = io.StringIO()
    with redirect_stdout(out):
        lists.page(table, player_id=1, before=(START, 5)).explain("formatted")
    pushed = next(line for line in out.getvalue().splitlines() if "PushedFilters" in line)
    assert "LessThanOrEqual(written_at" in pushed and "EqualTo(player_id,1)" in pushed
