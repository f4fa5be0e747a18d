"""Toponym analytics on PySpark: gazetteer build, name search, recognition, resolution, evaluation."""
