"""Analytics over fleets of thermostat time series, written as PySpark DataFrame operators."""
