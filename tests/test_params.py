from datetime import date, datetime

import pytest

from tidemark.operators.filters import parse_server_filter
from tidemark.params import ChartParams, StatsParams, resolve_window


def test_chart_arguments_are_clamped():
    p = ChartParams.parse({"days_to_show": "999", "maps_to_show": "0", "percision": "x", "top_servers": "77",
                           "only_maps_containing": " a, ,b", "bias_exponent": "nan?"}, today=date(2024, 2, 1))
    assert (p.days_to_show, p.maps_to_show, p.precision, p.top_servers) == (365, 1, 2, 50)
    assert p.only_maps_containing == ("a", "b") and p.bias_exponent == 1.2
    assert ChartParams.parse({}, today=date(2024, 1, 7)).start_date == "2024-01-01"
    with pytest.raises(ValueError):
        ChartParams(days_to_show=366)


def test_pages():
    low, high = StatsParams.parse({"page": "0", "limit": "5"}), StatsParams.parse({"limit": "500"})
    assert (low.page, low.limit, high.limit) == (1, 10, 100)
    for bad in ({"page": 0}, {"limit": 5}, {"limit": 101}):
        with pytest.raises(ValueError):
            StatsParams(**bad)
    assert StatsParams().total_pages(0) == 1 and StatsParams(limit=10).total_pages(21) == 3


def test_windows_are_whole_buckets():
    newest = datetime(2024, 1, 20, 13, 37)
    assert resolve_window(None, "2024-01-01", 7) is None
    assert resolve_window(newest, "2024-01-01", 7) == (datetime(2024, 1, 1), datetime(2024, 1, 8))
    assert resolve_window(newest, "2024-02-01", 7) == (datetime(2024, 1, 13, 12), datetime(2024, 1, 20, 14))
    assert resolve_window(newest, None, 1) == (datetime(2024, 1, 19, 12), datetime(2024, 1, 20, 14))


def test_server_filter():
    assert parse_server_filter("1.2.3.4: 27015") == ("1.2.3.4", 27015)
    assert [parse_server_filter(v) for v in ("all", None, "x", "a:-1", "a:b", ":1")] == [None] * 6
