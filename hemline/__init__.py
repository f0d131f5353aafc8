"""hemline: demand-forecasting data work as Spark DataFrame operators.

Sales lines, attribute sheets, file catalogs and vectors go in; modelling
tables, neighbour features, predictions and metric reports come out.  Every
operator takes DataFrames and returns DataFrames.
"""

__version__ = "0.1.0"
