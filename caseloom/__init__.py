"""Support-conversation analytics as Spark DataFrame transforms."""
