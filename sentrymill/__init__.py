"""PySpark analytics over SSH honeypot telemetry, plus corpus operators in ``sentrymill.llm``."""
