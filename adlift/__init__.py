"""adlift: campaign measurement and steering as Spark DataFrame operators."""

__version__ = "0.1.0"
