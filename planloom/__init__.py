"""planloom: troubleshooting-plan analytics as Spark DataFrame queries."""
