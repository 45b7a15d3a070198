"""veilspark: find, grade and remove sensitive content in large text tables with Spark.

Every public function takes and returns DataFrames or Columns.  The packages are

- ``functions``: Column builders (text helpers, rules, hit extraction, locations, grades, keywords),
- ``operators``: DataFrame operators (units, detection, plan, redaction, mining, curation, models, feedback),
- ``sources``: readers and writers,
- ``plans``: end-to-end batch flows,
- ``streaming``: Structured Streaming flows.
"""
