"""tallyforge: audits and scores structured data extracted from document transcripts, on Spark DataFrames."""

__version__ = "0.1.0"
