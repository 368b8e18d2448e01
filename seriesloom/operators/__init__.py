"""Operators: DataFrame in, DataFrame out.

A *panel* is ``(series_id, d DATE, value DOUBLE)`` with one row per series and day. That key is
what bounds every per-series window here: a series can never hold more rows than the calendar has
days, whatever the size of the raw rows behind it (``align.to_panel`` reduces them map-side first).
"""
