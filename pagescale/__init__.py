"""pagescale: recognised text and page layout as Spark tables.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing here starts a job unless its docstring says so.
"""
