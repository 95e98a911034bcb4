"""A spreadsheet-formula analytics engine on Spark DataFrames."""
