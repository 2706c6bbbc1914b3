"""quarrylight: a PySpark-first analytics engine for free-text safety reports and text corpora."""
