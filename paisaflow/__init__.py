"""Payment-settlement analytics as plain ``DataFrame -> DataFrame`` functions on Spark."""
