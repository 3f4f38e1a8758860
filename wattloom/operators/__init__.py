"""Jobs on power tables: every function takes and returns DataFrames."""
