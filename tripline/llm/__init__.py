"""Training-data operators: one module for each, with its registered query beside it.

Nothing else in the library imports this subpackage. Every operator takes and returns DataFrames; what is
kept between Spark jobs lies in the folder named by ``spark.checkpoint.dir`` (see :mod:`tripline.llm.common`).
"""
