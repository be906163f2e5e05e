"""riskweave: customer credit-risk analytics as Spark DataFrame operators.

Every public operator takes DataFrames plus column names and returns a
DataFrame; the heavy lifting is left to Catalyst/Tungsten.
"""

__version__ = "0.1.0"
