"""plans of the audit engine."""
