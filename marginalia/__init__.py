"""Record linkage, corpus selection and reporting on Spark DataFrames."""
