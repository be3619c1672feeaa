"""panelgrid: panel time series and gridded model ensembles on Spark DataFrames."""

__version__ = "0.1.0"
