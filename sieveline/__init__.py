"""Curation, auditing and paired evaluation of text datasets as Spark DataFrame operators."""
