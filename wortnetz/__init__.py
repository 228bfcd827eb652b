"""wortnetz: word-association and survey-response analytics on Spark DataFrames."""
