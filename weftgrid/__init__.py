"""A data grid on Spark: fuse, wrangle, profile, pivot and mine tables and texts at cluster scale."""

from weftgrid.operators.ujoin import ujoin, ujoin_all
from weftgrid.plans.grid import Grid
from weftgrid.session import build_session

__all__ = ["Grid", "build_session", "ujoin", "ujoin_all"]
