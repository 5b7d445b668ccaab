"""helixframe: sequence analytics and corpus operators on PySpark DataFrames."""
