"""Job-lifecycle analytics as DataFrame operators."""
