"""Operators on time series: resampling, pivots, alerts, replay, clients' APIs."""
