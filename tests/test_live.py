"""Histories kept in state: zeros between windows, bounded length, nothing twice."""

from ivnflow.streaming.live import advanced


def test_history_advances_with_zeros_and_stays_bounded():
    rows, h = advanced(None, [], {100: 3, 130: 5}, 130, 10, 3)
    assert rows == [(100, 3, [3]), (110, 0, [3, 0]), (120, 0, [3, 0, 0]), (130, 5, [0, 0, 5])] and h == [0, 0, 5]
    rows, h = advanced(130, h, {150: 1}, 150, 10, 3)
    assert rows == [(140, 0, [0, 5, 0]), (150, 1, [5, 0, 1])] and len(h) == 3
