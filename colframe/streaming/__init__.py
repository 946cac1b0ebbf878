"""Nothing yet: the operators work on tables. Those that are expressions or keyed aggregations (``functions``,
``operators.aggregate``, ``operators.tables.apply_boolean_mask``) also run on a streaming DataFrame as they are."""
