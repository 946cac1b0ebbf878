"""Operations of a training-data pipeline: ten operators over documents, pages and vectors.

Nothing outside this subpackage imports it. Shared conventions:

* every operator takes a DataFrame plus column names, selects the columns it
  needs (so extra columns, whatever they are called, never clash) and returns a
  new DataFrame;
* a null text counts as an empty one unless the operator says otherwise;
* what has to outlive a stage is written as Parquet or as files of the
  operator's own format below the folder in ``spark.checkpoint.dir``.
"""
