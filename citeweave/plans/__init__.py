"""Multi-stage pipelines and the registered queries."""
