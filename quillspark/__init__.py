"""quillspark: lexical lookup, dictionary-data pipelines and corpus operators on PySpark."""

__version__ = "0.1.0"
