"""sigmill: disproportionate-reporting analysis of spontaneous adverse-event reports on Spark."""

__version__ = "0.1.0"
