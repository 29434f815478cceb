"""Claims-document analytics on Spark: lazily composed DataFrame stages over nested, typed columns."""
