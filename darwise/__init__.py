"""Bilingual (Arabic/English) sales, contract and document analytics on Spark.

Every public function takes and returns DataFrames or Columns; nothing keeps a
hidden session.
"""
