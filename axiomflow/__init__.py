"""axiomflow: description-logic saturation and ontology analytics on Spark DataFrames."""

__version__ = "0.1.0"
