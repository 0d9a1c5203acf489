"""tidemark: declarative transformation, change capture and metrics on PySpark."""

__version__ = "0.1.0"
