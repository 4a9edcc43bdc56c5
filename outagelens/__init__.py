"""outagelens: county-level outage analytics and risk modelling on Spark.

Every operator is a DataFrame -> DataFrame (or Column) function built from
Spark SQL / DataFrame primitives so Catalyst plans it and the cluster runs it.
"""

__version__ = "0.1.0"
