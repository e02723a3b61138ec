"""keyloft: schema-on-read data on Spark."""
