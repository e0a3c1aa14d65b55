"""tidepanel: forecasting operators for panels of related time series, written as Spark jobs.

A panel is a long DataFrame ``(panel_id, series, ds, t, value)``. Every operator is a plain function
from DataFrame to DataFrame and stays lazy unless its docstring says otherwise.
"""
