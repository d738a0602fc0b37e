"""fleetscope: Spark-native analytics for fleets of accelerator devices.

Every operator is a pure function ``op(df, ..., as_of=...) -> DataFrame`` over the
whole fleet at once. Nothing loops over devices on the driver; no Python UDF sits
in a hot path.
"""

__version__ = "0.1.0"
